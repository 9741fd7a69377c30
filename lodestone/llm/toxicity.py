"""Toxic passages as maximum-scoring segments of token log-odds.

*Token scores.* Labelled documents give log-odds of being found in a toxic against a clean document, for words
and for their stems (first bytes, as words of one root end in many ways), with a Dirichlet prior in
proportion to how many documents have them. Where the lower confidence bound of a word or of one of its stems exceeds ``margin``, the
token scores the greatest such bound. Any other token scores its word's upper bound, if that is below zero, and a small
drift downwards besides; so every word's own log-odds count, as far as they are sure.

*Segments.* A linear scan finds all maximal scoring segments of a text (Ruzzo and
Tompa). Only tokens with a positive score can begin or end one, so the scan visits those.

*Calibration.* Scores of segments by chance follow an extreme-value law: a text of n
words has K n exp(-lambda S) segments of score S or more by chance. lambda solves
sum p exp(lambda s) = 1 over the token scores of clean documents; K is fitted by maximum likelihood to the greatest
segments of clean documents, those without any being censored. A segment is significant if fewer than ``alpha`` such are expected. A
document's evidence is the log-sum of its segments over that law's location; a logistic curve
turns it into a probability. For both fits each half of the labelled rows is scored by the other half's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.textbytes import U, WORD, chunks, column_bytes, mix, prefix, settle, span_hash, words
from lodestone.session import drop, written

#: Lengths of stems in bytes; a word has those that are shorter than itself.
STEMS = (4, 6, 8)
#: Token scores are counted by steps of this size.
STEP = 1 / 16


def maximal_segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a row of scores, as (first, last, score), by a linear scan."""
    at = np.flatnonzero(x > 0)
    upto = np.cumsum(x)
    segs: list[list[float]] = []  # first, last, sum before, sum up to the end
    stack: list[int] = []  # for a segment: the nearest earlier one with a smaller left sum
    for p, left, total in zip(at.tolist(), (upto[at] - x[at]).tolist(), upto[at].tolist(), strict=True):
        new = [p, p, left, total]
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][2] >= new[2]:
                j = stack[j]
            if j < 0 or segs[j][3] >= new[3]:
                segs.append(new)
                stack.append(j)
                break
            new = [segs[j][0], new[1], segs[j][2], new[3]]
            del segs[j:], stack[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in segs]


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))  # hashes of words and stems, ascending
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))  # their scores
    drift: float = 0.1
    lam: float = 1.0
    k: float = 1.0
    alpha: float = 0.05
    a: float = -2.0
    b: float = 1.0

    def token_scores(self, forms: list[np.ndarray]) -> np.ndarray:
        """Scores of tokens by the hashes of their forms, words first."""
        out = np.zeros(len(forms[0]))
        if len(self.keys):
            for f in forms:
                at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
                own = np.where(self.keys[at] == f, self.values[at], 0.0)
                out = np.where(out > 0, np.maximum(out, own), np.where(own > 0, own, out if f is not forms[0] else own))
        return np.where(out > 0, out, out - self.drift)

    def evidence(self, n: int, scores: np.ndarray) -> float:
        """Log of one plus the summed odds of segments' scores against chance, in [0, 60]."""
        if not len(scores):
            return 0.0
        z = self.lam * np.asarray(scores) - np.log(max(self.k * n, 1e-9))
        return float(min(60.0, np.logaddexp.reduce(np.append(z, 0.0))))

    def expected(self, n: int, score: float) -> float:
        """How many segments of such a score a text of n words has by chance."""
        return float(self.k * n * np.exp(-self.lam * score))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * evidence)))


def _tokens(col: pa.Array):
    """Hashes of the tokens' forms (0: none), their rows and bounds, and the texts' bounds."""
    buf, bounds = column_bytes(col)
    s, e, row = words(buf, bounds, WORD)
    h = prefix(buf, lower=True)
    forms = [span_hash(h, s, e)] + [np.where(e - s > n, mix(span_hash(h, s, np.minimum(e, s + n)) + U(n)), U(0)) for n in STEMS]
    return forms, row, s, e, bounds


def _scan(model: Model, col: pa.Array):
    """For each row: its tokens' scores, segments, and the byte bounds of its tokens within the text."""
    forms, row, s, e, bounds = _tokens(col)
    x = model.token_scores(forms)
    cut = np.searchsorted(row, np.arange(len(col) + 1))
    for i in range(len(col)):
        own = slice(cut[i], cut[i + 1])
        yield x[own], maximal_segments(x[own]), (s[own] - bounds[i], e[own] - bounds[i])


def _class_counts(labelled: DataFrame, stems: np.ndarray | None) -> DataFrame:
    """(hash, c00, c01, c10, c11): rows of each half and label that have a word, or a stem.

    Without ``stems``: all words, and the stems of toxic rows. With them: those stems in clean rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                forms, row, *_ = _tokens(b.column("text"))
                label, half = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "half"))
                toxic = label[row] == 1
                if stems is None:
                    pairs = [(forms[0], row)] + [(f[toxic & (f != 0)], row[toxic & (f != 0)]) for f in forms[1:]]
                else:
                    own = [~toxic & np.isin(f, stems) for f in forms[1:]]
                    pairs = [(f[o], row[o]) for f, o in zip(forms[1:], own, strict=True)]
                key, of = (np.concatenate(x) for x in zip(*pairs, strict=True))
                o = np.lexsort((of, key))
                o = o[np.r_[True, (key[o][1:] != key[o][:-1]) | (of[o][1:] != of[o][:-1])][: len(o)]]
                keys, inv = np.unique(key[o], return_inverse=True)
                kind = 2 * half[of[o]] + label[of[o]]
                counts = [np.bincount(inv[kind == k], minlength=len(keys)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c) for c in counts)], names=["hash", "c00", "c01", "c10", "c11"])

    counted = labelled.select("text", "toxic", "half").mapInArrow(count, "hash long, c00 long, c01 long, c10 long, c11 long")
    return counted.groupBy("hash").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")])


def _score(c0: Column, c1: Column, n0: int, n1: int, prior: float, z: float, margin: float) -> Column:
    """The lower bound of the log-odds if above the margin, else the upper bound if below zero, else 0."""
    p = F.lit(prior / max(n0 + n1, 1)) * (c0 + c1) + F.lit(0.05)
    y0, y1 = c0 + p, c1 + p
    odds = F.log(y1 / (n1 + prior + 1 - y1)) - F.log(y0 / (n0 + prior + 1 - y0))
    sd = F.sqrt(1 / y0 + 1 / y1)
    return F.when(odds - z * sd > margin, odds - z * sd).otherwise(F.least(F.lit(0.0), odds + sd))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps, with a weak ridge."""
    w, design = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, prior: float = 10.0, z: float = 2.0, margin: float = 1.0, drift: float = 0.1) -> Model:
    """Fit on labelled rows: ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    ``max_rows`` bounds the labelled rows that are used (those of least hash of their ids); the model's size is that of
    their vocabulary. A score is a bound of log-odds, ``z`` standard deviations below them, and counts above ``margin``. Rows with null ids, texts or labels teach
    nothing. With no toxic or no clean row the model finds nothing and scores all texts alike.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    # at most max_rows narrow rows are broadcast
    known = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    sample = written(known.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "labelled")
    size = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [[size.get((h, y), 0) for y in (0, 1)] for h in (0, 1)]
    n0, n1 = n[0][0] + n[1][0], n[0][1] + n[1][1]
    if not n0 or not n1:
        drop(sample)
        return Model(drift=drift, a=-2.0 if not n1 else 2.0, b=0.0)
    counts = written(_class_counts(sample, None), "counts")
    # a stem of one toxic row has no sure log-odds
    stems = counts.where("c00 + c10 = 0 and c01 + c11 > 1").select("hash").toArrow().column(0).to_numpy().view(U)  # at most those of the labelled rows
    every = counts.unionByName(_class_counts(sample, stems)).groupBy("hash").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")])
    col = {c: F.col(c) for c in ("c00", "c01", "c10", "c11")}
    scored = every.select(
        "hash", _score(col["c00"] + col["c10"], col["c01"] + col["c11"], n0, n1, prior, z, margin).alias("all"),
        *[_score(col[f"c{h}0"], col[f"c{h}1"], n[h][0], n[h][1], prior, z, margin).alias(f"half{h}") for h in (0, 1)],
    )
    table = scored.where("all <> 0 or half0 <> 0 or half1 <> 0").orderBy("hash").toArrow()
    keys = table.column("hash").to_numpy().view(U)
    order = np.argsort(keys)
    models = {c: Model(keys[order], table.column(c).to_numpy()[order], drift) for c in ("all", "half0", "half1")}
    model = models["all"]
    fit = sample.mapInArrow(_fitting(models["half1"], models["half0"]), "toxic int, n long, scores array<double>, steps array<long>, tokens array<long>").toPandas()  # at most max_rows rows
    drop(sample, counts)
    steps: dict[int, int] = {}
    for at, tokens in zip(fit["steps"], fit["tokens"], strict=True):
        for k, c in zip(at, tokens, strict=True):
            steps[k] = steps.get(k, 0) + c
    model.lam = _karlin(np.array(list(steps), float) * STEP, np.array(list(steps.values()), float))
    clean = fit[fit["toxic"] == 0]
    model.k = _censored_k(clean["n"].to_numpy(float), np.array([max(s, default=0.0) for s in clean["scores"]]), model.lam)
    x = np.array([model.evidence(int(m), s) for m, s in zip(fit["n"], fit["scores"], strict=True)])
    model.a, model.b = _logistic(x, fit["toxic"].to_numpy(float))
    return model


def _karlin(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 over clean tokens; 1 if none scores above zero."""
    if not len(score) or score.max() <= 0 or (score * weight).sum() >= 0:
        return 1.0
    p = weight / weight.sum()
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * score)).sum() < 1 and hi < 50:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * score)).sum() < 1 else (lo, mid)
    return max(lo, 0.05)


def _censored_k(n: np.ndarray, top: np.ndarray, lam: float) -> float:
    """Maximum likelihood of K, where P(greatest < s) = exp(-K n exp(-lambda s)); texts without a segment lie below 0."""
    seen = top > 0
    return float(max(seen.sum(), 0.5) / max((n * np.exp(-lam * np.where(seen, top, 0.0))).sum(), 1.0))


def _fitting(first: Model, second: Model):
    """Each row's segments by the model of the other half, and counts of clean tokens' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                half, toxic = b.column("half").to_pylist(), b.column("toxic").to_pylist()
                n, scores, clean = [], [], [np.zeros(0, np.int64)]
                for h, y, one, two in zip(half, toxic, _scan(first, b.column("text")), _scan(second, b.column("text")), strict=True):
                    x, segs, _ = two if h else one
                    n.append(len(x))
                    scores.append([s for *_, s in segs])
                    if not y:
                        clean.append(np.rint(x / STEP).astype(np.int64))
                at, many = np.unique(np.concatenate(clean), return_counts=True)
                empty = [[]] * (b.num_rows - 1)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic, pa.int32()), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array([at.tolist(), *empty], kind), pa.array([many.tolist(), *empty], kind)],
                    names=["toxic", "n", "scores", "steps", "tokens"],
                )

    return run


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages``.

    ``passages``: the significant segments as (first byte, end byte, score, e_value)
    of the text's UTF-8. A null or empty text has no evidence and gets the base score.
    Columns of these names in docs are replaced; all others stay.
    """
    docs = docs.drop("score", "predicted", "passages")
    names = docs.columns
    at = names.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for b in chunks(batch, text):
                ev, spans = [], []
                for x, segs, (s, e) in _scan(model, b.column(at)):
                    ev.append(model.evidence(len(x), [v for *_, v in segs]))
                    found = [(i, j, v, model.expected(len(x), v)) for i, j, v in segs]
                    spans.append([{"start": int(s[i]), "end": int(e[j]), "score": v, "e_value": w} for i, j, v, w in found if w < model.alpha])
                p = model.probability(np.array(ev))
                cols = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, "score", "predicted", "passages"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", PASSAGES)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
