"""Language identification, word first, with back-off to character n-grams.

A word is a run of letters, in lower case. A word seen in training scores, in each
language, its smoothed log frequency there. Any other word falls back to its character
4-grams (with marks at its ends); if none of them was seen, to its 3-grams, 2-grams, and
single letters. A text's score is the sum over its words plus the languages' log priors.

Training counts all words and n-grams of a bounded sample of labelled texts on executors, with an equal share for
each language, so a rare language is there as well. The model is sparse: of each word, the languages that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.textbytes import U, chunks, mix, powers, ragged

ORDERS = (4, 3, 2, 1)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


class Words:
    """The words of some texts: hashes, rows, and the places of their letters."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join([t.lower() if t else "" for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        breaks = np.cumsum([len(t.lower()) + 1 if t else 1 for t in texts]) - 1
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = _is_letter()[points]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.row = np.searchsorted(breaks, self.start, "left")
        self.values = mix(points.astype(U) + U(7))
        n = len(points)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(self.values * powers(n)[0][:n], out=self.sums[1:])
        self.hash = self._hash(self.start, self.end)

    def _hash(self, s: np.ndarray, e: np.ndarray, mark: np.ndarray | int = 0) -> np.ndarray:
        h = (self.sums[e] - self.sums[s]) * powers(len(self.sums))[1][s]
        return mix(h + (e - s).astype(U) + np.asarray(mark, U) * U(0x51ED270B9D3C1F67))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of some words: hashes, and for each the place in ``which``.

        A gram knows whether it begins or ends its word; a word shorter than n has none.
        """
        s, e = self.start[which], self.end[which]
        count = np.maximum(0, e - s - n + 1)
        at = ragged(s, count)
        owner = np.repeat(np.arange(len(which)), count)
        mark = 1 + (at == s[owner]) + 2 * (at + n == e[owner]) if n > 1 else np.ones(len(at), int)
        return self._hash(at, at + n, mark + 8 * n), owner


def count_grams(labelled: DataFrame) -> DataFrame:
    """``labelled(text, lang)`` -> (lang, n, hash, c); n is 0 for words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                langs, code = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
                w = Words(b.column(0).to_pylist())
                lang = code[w.row]
                for n in (0, *ORDERS):
                    h, of = (w.hash, lang) if n == 0 else (lambda g: (g[0], lang[g[1]]))(w.grams(np.arange(len(w.start)), n))
                    for k in range(len(langs)):
                        keys, c = np.unique(h[of == k], return_counts=True)
                        if len(keys):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([langs[k]] * len(keys)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))],
                                names=["lang", "n", "hash", "c"],
                            )

    return labelled.select("text", "lang").mapInArrow(count, "lang string, n int, hash long, c long").groupBy("hash", "n", "lang").agg(F.sum("c").alias("c"))


class Model:
    """Log frequencies of words and n-grams in each language, where they were seen.

    ``counts``: for each order the hashes, languages and counts of what was seen, in any order.
    """

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], alpha: float = 0.1):
        self.langs, self.tables, self.unseen = langs, {}, {}
        for n, (keys, lang, c) in counts.items():
            order = np.lexsort((lang, keys))
            keys, lang, c = keys[order], lang[order], c[order].astype(float)
            distinct, first = np.unique(keys, return_index=True)
            total = np.bincount(lang, c, len(langs)) + alpha * (len(distinct) + 1)
            #: Hashes, the bounds of their entries, and the entries: language and how much above an unseen one's score.
            self.tables[n] = distinct, np.r_[first, len(keys)], lang, np.log((c + alpha) / alpha)
            self.unseen[n] = np.log(alpha / total)
            if n == 0:
                share = np.bincount(lang, c, len(langs)) + 1
                self.prior = np.log(share / share.sum())

    def _find(self, n: int, h: np.ndarray) -> np.ndarray:
        keys = self.tables[n][0]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def _add(self, n: int, at: np.ndarray, owner: np.ndarray, scores: np.ndarray) -> None:
        """Add the scores of entries to the rows of their owners."""
        _, bounds, lang, value = self.tables[n]
        many = bounds[at + 1] - bounds[at]
        entry = ragged(bounds[at], many)
        np.add.at(scores, (np.repeat(owner, many), lang[entry]), value[entry])
        scores += np.bincount(owner, minlength=len(scores))[:, None] * self.unseen[n]

    def word_scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and for each word which of them it is."""
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        scores = np.zeros((len(first), len(self.langs)))
        at = self._find(0, w.hash[first])
        known = np.flatnonzero(at >= 0)
        self._add(0, at[known], known, scores)
        left = np.flatnonzero(at < 0)
        for n in ORDERS:
            if not len(left):
                break
            h, owner = w.grams(first[left], n)
            at = self._find(n, h)
            hit = at >= 0
            sums = np.zeros((len(left), len(self.langs)))
            self._add(n, at[hit], owner[hit], sums)
            number = np.bincount(owner[hit], minlength=len(left))
            done = number > 0
            scores[left[done]] = sums[done] / number[done, None]
            left = left[~done]
        return scores, inverse

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        w = Words(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        scores, inverse = self.word_scores(w)
        total = np.zeros((len(texts), len(self.langs)))
        has = np.bincount(w.row, minlength=len(texts)) > 0
        if len(w.row):
            begin = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
            total[w.row[begin]] = np.add.reduceat(scores[inverse], begin, axis=0)
        total += self.prior
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, p, 0.0)


def train(labelled: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit on ``labelled(text, lang)``.

    ``max_rows`` bounds the texts learned from, about an equal share of it for each language (those of least hash of
    their texts; a language with fewer texts gives all). A repeated text teaches once for each of its languages. Everything in
    those texts is kept. Rows with a null text or language teach nothing.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))  # a row for each language
    each = sizes.withColumn("share", F.lit(max_rows) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / F.col("n")).select("lang", (F.col("share") * float(1 << 40)).alias("below"))
    chosen = labelled.join(F.broadcast(each), "lang").where(place <= F.col("below")).groupBy("text", "lang").count().select("text", "lang")
    rows = count_grams(chosen).toArrow()  # what max_rows texts hold
    lang, n, key, c = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("lang", "n", "hash", "c"))
    langs, code = np.unique(lang.astype(str), return_inverse=True) if len(lang) else (np.zeros(0, str), np.zeros(0, int))
    return Model(langs.tolist(), {order: (key[n == order].view(U), code[n == order], c[n == order]) for order in (0, *ORDERS)})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the probability of that language).

    A null text, or one without a letter, is ``und`` with score 0. Columns of these
    names in docs are replaced; all others stay. Empty table: empty result.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, text):
                pred, score = model.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
