"""Benchmark decontamination: passages query a BM25 index of test items.

*Index.* Items are indexed by their words; a posting holds the item's BM25 weight for the word,
as a share of the score that the item itself would get, so one threshold suits
all items. Postings are cut into blocks with their greatest weight.

*Retrieval.* Texts are cut into overlapping passages, long enough that any item lies whole
in one. Frequent words that no item needs for half the threshold are set aside; from the others an
array operation sums, for every passage and item at once, an upper bound of the score, and passages where
none reaches the threshold are passed over. The rest run block-max WAND: lists are kept in order of their
next items, the pivot is where summed bounds reach the threshold, and blocks whose greatest
weights fall short are skipped. Every item at or above the threshold is found.

*Verification.* An item leaks if the passage holds at least 0.8 of its question, and of its
answer (its last sentences, five words at least). A part is held as far as its word 5-grams are. In a part
of fewer than 25 of them one changed word would cost more than a fifth, so there its words may count instead: the
share of them that stand in the passage in step, with at most one word put in or left out.

*Large benchmarks.* Word frequencies, mean length and number of items are those of the whole benchmark; items
are searched in parts of a bounded size, one pass over the texts for each. A part's index uses those
same figures, so an item's score doesn't depend on which items share its part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.textbytes import U, chunks, column_bytes, prefix, ragged, span_hash, words
from lodestone.session import drop, written

_K1, _B = 1.2, 0.75  # BM25's usual constants
_END = 1 << 62


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    buf, bounds = column_bytes(pa.array(texts, pa.large_string()))
    s, e, row = words(buf, bounds)
    h = span_hash(prefix(buf, lower=True), s, e) if len(s) else np.zeros(0, U)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [h[cut[i] : cut[i + 1]] for i in range(len(texts))]


def split_item(text: str, least: int = 5) -> tuple[str, str]:
    """Question and answer: the answer is the last sentences, with at least so many words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if p.strip()]
    answer: list[str] = []
    while parts and sum(len(x) for x in _word_hashes(answer)) < least:
        answer.insert(0, parts.pop())
    return " ".join(parts), " ".join(answer)


def _grams(h: np.ndarray, size: int) -> set[bytes]:
    return {h[i : i + size].tobytes() for i in range(len(h) - size + 1)}


def _in_step(part: np.ndarray, passage: np.ndarray) -> float:
    """The greatest share of a part's words that stand in a passage at one offset or the next."""
    own, there = np.nonzero(part[:, None] == passage[None, :])
    if not len(own):
        return 0.0
    n = len(part)
    offset = np.unique((there - own + n) * n + own)
    both = np.unique(np.r_[offset, offset + n])  # a word at an offset also counts for the next
    return float(np.bincount(both // n).max() / n)


@dataclass
class Statistics:
    """Of a whole benchmark: how many items have a word, their mean and greatest length, and in how many items a word is."""

    items: int
    mean: float
    longest: int
    frequency: dict[int, int]

    @staticmethod
    def of(texts: list[str | None], size: int = 5) -> Statistics:
        found = [np.concatenate(_word_hashes(list(split_item(t or "", size)))) for t in texts]
        n = sum(1 for x in found if len(x)) or 1
        return Statistics(n, sum(map(len, found)) / n or 1, max(map(len, found), default=0), Counter(int(w) for x in found for w in np.unique(x)))


class Index:
    """Inverted index of items, with block-max WAND retrieval."""

    def __init__(self, ids: list[int], texts: list[str], statistics: Statistics | None = None, block: int = 32, size: int = 5, least: float = 0.5, least_words: int = 8):
        self.ids, self.size, self.block, self.least = ids, size, block, least
        parts = [split_item(t or "", size) for t in texts]
        self.question = _word_hashes([q for q, _ in parts])
        self.answer = _word_hashes([a for _, a in parts])
        items = [np.concatenate(x) for x in zip(self.question, self.answer, strict=True)]
        items = [x if len(x) >= least_words else x[:0] for x in items]
        whole = statistics or Statistics.of(texts, size)
        self.longest = whole.longest if any(len(x) for x in items) else 0
        found: list[tuple[np.ndarray, np.ndarray]] = []  # an item's words and its share of weight in each
        for x in items:
            w, tf = np.unique(x, return_counts=True)
            c = np.array([whole.frequency[k] for k in w.tolist()], float)
            weight = np.log(1 + (whole.items - c + 0.5) / (c + 0.5)) * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * len(x) / whole.mean))
            found.append((w, weight / weight.sum()))
        word = np.concatenate([w for w, _ in found]) if found else np.zeros(0, U)
        share = np.concatenate([v for _, v in found]) if found else np.zeros(0)
        item = np.repeat(np.arange(len(items)), [len(w) for w, _ in found])
        order = np.lexsort((item, word))
        #: Postings of all words, one list after another, with the bounds of the lists.
        self.items, self.weights = item[order].astype(np.int32), share[order]
        self.words, at = np.unique(word[order], return_index=True)
        self.bounds = np.r_[at, len(word)].astype(np.int64)
        length = np.diff(self.bounds)
        self.block_first = np.cumsum(-(-length // block)) - -(-length // block)
        edges = np.repeat(self.bounds[:-1], -(-length // block)) + block * ragged(np.zeros(len(length), np.int64), -(-length // block))
        self.block_best = np.maximum.reduceat(self.weights, edges) if len(edges) else np.zeros(0)
        self.best = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        # frequent words are set aside while no item would get half the threshold from them
        aside, rare = np.zeros(len(items)), np.ones(len(self.words), bool)
        for t in np.argsort(-length, kind="stable").tolist():
            lo, hi = self.bounds[t], self.bounds[t + 1]
            if hi - lo > 1 and (aside[self.items[lo:hi]] + self.weights[lo:hi] <= least / 2).all():
                aside[self.items[lo:hi]] += self.weights[lo:hi]
                rare[t] = False
        self.need = least - aside
        self.count = np.where(rare, length, 0)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index's numbers of words; -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def reachable(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of (passage, word) pairs: passages in which some item may reach the threshold."""
        many = self.count[term]
        at = ragged(self.bounds[term], many)
        key = np.repeat(passage, many) * len(self.need) + self.items[at]
        keys, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, weights=self.weights[at], minlength=len(keys))
        return np.unique(keys[total >= self.need[keys % len(self.need)] - 1e-9] // len(self.need))

    def search(self, terms: list[int], least: float | None = None) -> list[tuple[int, float]]:
        """(item number, score) of all items at or above a threshold for a set of words."""
        least = self.least if least is None else least
        found = []
        lists = {t: self.items[self.bounds[t] : self.bounds[t + 1]].tolist() for t in terms}
        at = dict.fromkeys(terms, 0)
        while True:
            live = sorted((lists[t][at[t]], t) for t in terms if at[t] < len(lists[t]))
            bound, pivot = 0.0, None
            for k, (_, t) in enumerate(live):
                bound += float(self.best[t])
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            target = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == target:
                pivot += 1
            # bounds of the blocks that the target would lie in, and where the first of them ends
            bound, nxt = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else _END
            for _, t in live[: pivot + 1]:
                k = bisect_left(lists[t], target, at[t]) // self.block
                if k * self.block < len(lists[t]):
                    bound += float(self.block_best[self.block_first[t] + k])
                    nxt = min(nxt, lists[t][min((k + 1) * self.block, len(lists[t])) - 1] + 1)
            if bound >= least:
                score = 0.0
                for _, t in live[: pivot + 1]:
                    k = bisect_left(lists[t], target, at[t])
                    if k < len(lists[t]) and lists[t][k] == target:
                        score += float(self.weights[self.bounds[t] + k])
                        k += 1
                    at[t] = k
                if score >= least:
                    found.append((target, score))
            else:
                nxt = max(nxt, target + 1)
                for _, t in live[: pivot + 1]:
                    at[t] = bisect_left(lists[t], nxt, at[t])

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """How far a passage holds the question and the answer (an empty part: 1)."""
        out = []
        for part in (self.question[item], self.answer[item]):
            size = min(self.size, len(part))
            own = _grams(part, size) if size else set()
            held = len(own & _grams(passage, size)) / len(own) if own else 1.0
            out.append(held if len(own) >= 25 or held == 1.0 else max(held, _in_step(part, passage)))
        return out[0], out[1]


def _leaks(index: Index, overlap: float, column: pa.Array) -> list[list[dict]]:
    buf, bounds = column_bytes(column)
    n = len(bounds) - 1
    out: list[dict[int, dict]] = [{} for _ in range(n)]
    s, e, row = words(buf, bounds)
    if not len(s) or not index.longest:
        return [[] for _ in range(n)]
    h = span_hash(prefix(buf, lower=True), s, e)
    term = index.find(h)
    size = max(64, 2 * index.longest)
    step = size // 2
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    per = np.where(count > 0, np.maximum(1, -(-(count - size) // step) + 1), 0)
    before = np.cumsum(per) - per  # passages of earlier rows
    doc = np.repeat(np.arange(n), per)
    start = first[doc] + step * (np.arange(len(doc)) - before[doc])
    end = np.minimum(start + size, first[doc] + count[doc])
    # a word lies in the passage that begins in its step, and in the one before
    at = np.flatnonzero(term >= 0)
    at = at[index.count[term[at]] > 0]
    d = row[at]
    own = (at - first[d]) // step
    pairs = [(before[d[ok]] + own[ok] - k, term[at[ok]]) for k in (0, 1) for ok in [(own - k >= 0) & (own - k < per[d])]]
    for k in index.reachable(*(np.concatenate(x) for x in zip(*pairs, strict=True))):
        a, b, i = start[k], end[k], doc[k]
        terms = np.unique(term[a:b])
        for item, score in index.search(terms[terms >= 0].tolist()):
            q, r = index.overlaps(item, h[a:b])
            if q >= overlap and r >= overlap and (round(score, 9), q, r) > out[i].get(item, ((-1.0,),))[0]:
                out[i][item] = (round(score, 9), q, r), {"item_id": index.ids[item], "score": float(score), "question_overlap": q, "answer_overlap": r}
    return [[x[k][1] for k in sorted(x)] for x in out]


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))]))
LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _frequencies(items: DataFrame, size: int = 5) -> DataFrame:
    """(item_id, text) -> (part, hash, n, words, longest): in how many items of a part a word is; without a hash: the part's items and words, and the most words of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                part = np.array(b.column("part").to_pylist())
                for p in np.unique(part):
                    st = Statistics.of(b.column("text").filter(pa.array(part == p)).to_pylist(), size)
                    keys = np.array(list(st.frequency), U).view(np.int64)
                    any_ = 1 if len(keys) else 0
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([int(p)] * (len(keys) + any_), pa.int32()), "hash": pa.array([*keys.tolist(), *[None] * any_], pa.int64()),
                            "n": pa.array([*st.frequency.values(), *[st.items] * any_], pa.int64()), "words": pa.array([0] * len(keys) + [round(st.items * st.mean)] * any_, pa.int64()),
                            "longest": pa.array([0] * len(keys) + [st.longest] * any_, pa.int64()),
                        }
                    )

    return items.select("part", "text").mapInArrow(run, "part int, hash long, n long, words long, longest long").groupBy("part", "hash").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = 0.5, overlap: float = 0.8, index_bytes: int = 32 << 20, least_words: int = 8) -> DataFrame:
    """``docs`` with ``leaks``: the items of ``benchmark(item_id, text)`` that a text gives away.

    An array of (item_id, score, question_overlap, answer_overlap), in order of items; empty if
    clean. Null and empty texts and items leak nothing, nor do items of fewer than ``least_words`` words, which
    say nothing about where a text is from; repeated items are found each. ``least`` is
    a share of an item's own BM25 score. The benchmark's size is checked: an index holds
    ``index_bytes`` of its text, and a larger benchmark is searched in parts, with a pass over
    docs for each, written before the next part is loaded; parts share one set of statistics. A column ``leaks`` of
    docs is replaced; all others stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // index_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    words_ = written(_frequencies(items), "words")
    figures = words_.where("hash is null").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
    whole = words_.where("hash is not null").groupBy("hash").agg(F.sum("n").alias("n"))
    n = int(figures["n"] or 0) or 1
    mean, longest = float(figures["words"] or 0) / n or 1.0, int(figures["longest"] or 0)
    out = docs
    for part in range(parts):
        rows = items.where(F.col("part") == part).orderBy("item_id", "text").collect()  # about index_bytes of text
        mine = words_.where((F.col("part") == part) & F.col("hash").isNotNull()).select("hash").join(whole, "hash").toArrow()  # the words of these items
        seen = dict(zip(mine.column("hash").to_numpy().view(U).tolist(), mine.column("n").to_pylist(), strict=True))
        index = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], Statistics(n, mean, longest, seen), least=least, least_words=least_words))
        names = out.columns
        at, earlier = names.index(text), names.index("leaks") if part else None

        def run(batches: Iterator[pa.RecordBatch], index=index, names=names, at=at, earlier=earlier) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in chunks(batch, text):
                    found = _leaks(index.value, overlap, b.column(at))
                    cols = list(b.columns)
                    if earlier is None:
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(LEAK))], names=[*names, "leaks"])
                    else:
                        cols[earlier] = pa.array([x + y for x, y in zip(cols[earlier].to_pylist(), found, strict=True)], pa.list_(LEAK))
                        yield pa.RecordBatch.from_arrays(cols, names=names)

        found = out.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("leaks", LEAKS)]))
        if part + 1 < parts:
            before, out = out, written(found, "leaks")
            index.destroy()
            drop(before)
        else:
            out = found
    return out.withColumn("leaks", F.array_sort("leaks")) if parts > 1 else out
