"""An n-gram language model by deleted interpolation, trained and applied in one corpus.

    P2(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1)
    Pk(w | h) = mk c(h w) / c(h) + (1 - mk) Pk-1(w | h without its first word)     for k = 3 to the order

The weights l and m depend on the bucket of the context's frequency, c(v) or c(h): 0, 1, 2-3, 4-7 and so
on. They are learned by expectation-maximisation on held-out counts, the lowest order first: an eighth of
the training documents is deleted from the counts, and its events are explained by
the rest. Scores then use the counts of all training documents. Contexts begin
with start marks, and every document ends with an end token, so the weights of
all texts sum to one.

How it scales. Documents become blocks of codes, written once. Each block sends its
*distinct* n-grams to buckets by a hash, packed as sorted differences; a bucket adds up
the counts and sends them back to each block in the same order. So a frequent word or
pair costs a block one entry, no bucket is hot, no table of counts is broadcast or
collected, and scores are made where the tokens are. Hashes are as wide as the corpus asks:
with n training tokens, a word has log2(n) + 30 bits and a longer gram log2(n) + 20, so at every size
the same share of grams (one in a million at most) is expected to share its hash with another. The driver sees the number
of tokens and types, and for each order a histogram of held-out events of bounded size: events are
put together where both their probabilities fall into one of ``BINS`` classes to a doubling, and
a class stands in the maximisation with the exact means of its events' probabilities.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbytes import NOT_SPACE, U, chunks, column_bytes, mix, pack, prefix, span_hash, unpack, words
from lodestone.session import written

START, END = U(0x8B1A9953C4611296), U(0x5D41402ABC4B2A76)
#: Held-out events are put together by the base-2 logarithms of their probabilities, this many classes to a doubling.
BINS = 16
BLOCK = "block string, deleted boolean, n_train long, doc_ids array<long>, sizes binary, trained binary, vocabulary binary, codes binary"


def blocks(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs(doc_id, text, train, deleted)`` as blocks of codes into their own vocabularies.

    Words part at ASCII white space, with A-Z in lower case. A block holds deleted
    training documents only, or none of them.
    """

    def block(held: list[pa.RecordBatch], deleted: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        buf, bounds = column_bytes(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        s, e, row = words(buf, bounds, NOT_SPACE)
        h = span_hash(prefix(buf, lower=True), s, e)
        sizes = np.bincount(row, minlength=t.num_rows)
        h = np.insert(h, np.cumsum(sizes), END)
        sizes = sizes + 1
        train = t.column("train").to_numpy().astype(bool)
        keys, codes = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_pydict(
            {
                "block": [uuid.uuid4().hex], "deleted": [deleted], "n_train": pa.array([int(sizes[train].sum())], pa.int64()),
                "doc_ids": pa.array([t.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "sizes": [pack(sizes)], "trained": [pack(train)], "vocabulary": [pack(np.diff(keys, prepend=U(0)))], "codes": [pack(codes)],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        for batch in batches:
            for b in chunks(batch, "text", block_bytes):
                flag = b.column("deleted")
                for d in (True, False):
                    part = b.filter(flag if d else pc.invert(flag))
                    if part.num_rows:
                        held[d].append(part)
                        size[d] += part.nbytes
                        if size[d] >= block_bytes:
                            yield block(held[d], d)
                            held[d], size[d] = [], 0
        for d in (True, False):
            if held[d]:
                yield block(held[d], d)

    return docs.select("doc_id", "text", "train", "deleted").mapInArrow(run, BLOCK)


def key_bits(total: int, k: int) -> int:
    """Bits of a hash of k words, for a corpus of so many training tokens."""
    return min(64, max(total, 1).bit_length() + (30 if k == 1 else 20))


def bucket_of(key: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Buckets are equal ranges of hashes, so sorted hashes lie in sorted buckets."""
    top = key >> U(bits - 32) if bits > 32 else key << U(32 - bits)
    return ((top * U(buckets)) >> U(32)).astype(np.int64)


class Block:
    """A block's tokens with its distinct n-grams of each order.

    ``gram[k]`` is each token's n-gram of order k, and ``context[k]`` the one of order k - 1 before it;
    the code after the last stands for a context of start marks alone.
    """

    def __init__(self, row: dict, buckets: int, order: int, total: int):
        self.doc_ids, self.deleted = row["doc_ids"], row["deleted"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.trained = unpack(row["trained"]).astype(bool)
        self.vocabulary = np.cumsum(unpack(row["vocabulary"]))
        self.w = unpack(row["codes"]).astype(np.int64)
        n = len(self.vocabulary)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.in_train = np.repeat(self.trained, self.sizes)
        names = np.r_[self.vocabulary, START]
        self.keys, self.gram, self.context = {1: mix(names)}, {1: self.w}, {}
        before, starts = names, n  # names of contexts, and the code of start marks
        for k in range(2, order + 1):
            h = np.r_[starts, self.gram[k - 1][:-1]] if len(self.w) else self.w
            h[self.begin] = starts
            pair, self.gram[k] = np.unique(h * (n + 1) + self.w, return_inverse=True)
            self.keys[k] = mix(before[pair // (n + 1)] * U(0x9E3779B97F4A7C15) + names[pair % (n + 1)])
            self.context[k], starts = h, len(pair)
            before = np.r_[self.keys[k], START]
        self.order, self.bucket = {}, {}
        for k in self.keys:
            self.keys[k] = self.keys[k] >> U(64 - key_bits(total, k))
            self.order[k] = np.argsort(self.keys[k], kind="stable")
            self.bucket[k] = bucket_of(self.keys[k][self.order[k]], buckets, key_bits(total, k))

    def own_counts(self, k: int) -> np.ndarray:
        c = np.bincount(self.gram[k][self.in_train], minlength=len(self.keys[k]))
        if k == 1:
            c[-1] = self.trained.sum()
        return c

    def counts(self, k: int, rows: list[dict], name: str) -> np.ndarray:
        out = np.zeros(len(self.keys[k]), np.int64)
        for r in rows:
            if r["n"] == k:
                lo, hi = np.searchsorted(self.bucket[k], [r["bucket"], r["bucket"] + 1])
                out[self.order[k][lo:hi]] = unpack(r[name])
        return out


def exchange(table: DataFrame, buckets: int, order: int, total: int) -> DataFrame:
    """Counts of each block's n-grams over all blocks.

    (n, bucket, block, deleted, kept, whole, types): ``whole`` over all training documents, ``kept``
    without the deleted ones (for blocks of those only). A bucket's number of types
    with a count stands in a row without a block.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, buckets, order, total)
                out = {x: [] for x in ("n", "bucket", "block", "deleted", "keys", "counts")}
                for k in range(1, order + 1):
                    own = b.own_counts(k)[b.order[k]]
                    keys, bucket = b.keys[k][b.order[k]], b.bucket[k]
                    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else np.zeros(0, int)
                    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        # the first key is whole, the others are differences
                        for col, v in zip(out.values(), (k, int(bucket[lo]), row["block"], b.deleted, int(keys[lo]).to_bytes(8, "little") + pack(np.diff(keys[lo:hi])), pack(own[lo:hi])), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_pydict({"n": pa.array(out["n"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.string()), "deleted": pa.array(out["deleted"], pa.bool_()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(np.r_[np.frombuffer(x[:8], U), unpack(x[8:])]) for x in t.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        deleted = t.column("deleted").to_pylist()
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        whole, gone = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        parts = np.split(at, np.cumsum(sizes)[:-1])
        for x, part, d in zip(t.column("counts"), parts, deleted, strict=True):
            own = unpack(x.as_py()).astype(np.int64)
            np.add.at(whole, part, own)  # two of a block's keys may share a value
            if d:
                np.add.at(gone, part, own)
        n = t.column("n")[0].as_py()
        types = int((whole > 0).sum())
        if n == 1:  # the mark of a start is no type
            types -= int((whole[distinct == mix(np.array([START]))[0] >> U(64 - key_bits(total, 1))] > 0).sum())
        kept = whole - gone
        return pa.table(
            {
                "n": pa.array([n] * (len(parts) + 1), pa.int32()), "bucket": pa.array([t.column("bucket")[0].as_py()] * (len(parts) + 1), pa.int32()),
                "block": pa.array([*t.column("block").to_pylist(), None], pa.string()), "deleted": pa.array([*deleted, None], pa.bool_()),
                "kept": pa.array([*[pack(kept[p]) if d else None for p, d in zip(parts, deleted, strict=True)], None], pa.binary()),
                "whole": pa.array([*[pack(whole[p]) for p in parts], None], pa.binary()), "types": pa.array([*[None] * len(parts), types], pa.int64()),
            }
        )

    sent = table.mapInArrow(send, "n int, bucket int, block string, deleted boolean, keys binary, counts binary")
    return sent.groupBy("n", "bucket").applyInArrow(add, "n int, bucket int, block string, deleted boolean, kept binary, whole binary, types long")


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the base-2 logarithm of its count."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(int) + 1, 0)


def _estimates(b: Block, rows: list[dict], name: str, total: int, order: int):
    """For each token: its contexts' buckets and the estimates, each by order, and the word's count."""
    c = b.counts(1, rows, name)
    cw, starts, before = c[b.w], c[-1], c
    ctx, p = {}, {1: cw / max(total, 1)}
    for k in range(2, order + 1):
        c = b.counts(k, rows, name)
        ch = before[b.context[k]]
        ctx[k], p[k] = context_bucket(ch), c[b.gram[k]] / np.maximum(ch, 1)
        before = np.r_[c, starts]
    return ctx, p, cw


def _mixed(ctx: dict, p: dict, weights: dict[int, np.ndarray], types: int, order: int) -> np.ndarray:
    """Each token's probability by the model of an order."""
    w = weights[2][np.minimum(ctx[2], 63)]
    out = w[:, 0] * p[2] + w[:, 1] * p[1] + w[:, 2] / (types + 1)
    for k in range(3, order + 1):
        w = weights[k][np.minimum(ctx[k], 63)]
        out = w[:, 0] * p[k] + w[:, 1] * out
    return out


def held_out_histogram(table: DataFrame, counts: DataFrame, buckets: int, total: int, kept: int, types: int, order: int, weights: dict[int, np.ndarray]) -> DataFrame:
    """(bucket, p, lower, n): held-out events by their context's bucket, the estimate of an order and the next lower one's.

    The lower one is the word's own for order two, else the probability by the model of the order below, whose ``weights`` are known.
    Events whose two probabilities fall into the same classes are one row, with their means.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, parts = right.to_pylist(), []
        for row in left.to_pylist():
            b = Block(row, buckets, order, total)
            ctx, p, _ = _estimates(b, rows, "kept", kept, order)
            both = p[order], p[1] if order == 2 else _mixed(ctx, p, weights, types, order - 1)
            code = ctx[order].astype(np.int64)
            for x in both:
                code = code * 4096 + np.where(x > 0, 2048 + np.round(np.log2(np.maximum(x, 1e-30)) * BINS).astype(int), 0)
            keys, at, n = np.unique(code, return_inverse=True, return_counts=True)
            parts.append((keys, *(np.bincount(at, x, len(keys)) for x in both), n))
        code, p, lower, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
        return pa.table({"code": pa.array(code, pa.int64()), "p": pa.array(p, pa.float64()), "lower": pa.array(lower, pa.float64()), "n": pa.array(n, pa.int64())})

    needed = counts.where(F.col("deleted") & (F.col("n") <= order)).select("n", "bucket", "block", "kept")
    held = table.where("deleted").groupBy("block").cogroup(needed.groupBy("block"))
    summed = held.applyInArrow(run, "code long, p double, lower double, n long").groupBy("code").agg(*[F.sum(x).alias(x) for x in ("p", "lower", "n")])
    return summed.select(F.shiftright("code", 24).cast("int").alias("bucket"), (F.col("p") / F.col("n")).alias("p"), (F.col("lower") / F.col("n")).alias("lower"), "n")


def _maximise(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, first: list[float], unseen: list[float], rounds: int) -> np.ndarray:
    """Weights of the columns of ``p`` for each bucket up to 63; bucket 0 has no estimate of the order itself, the first column."""
    out = np.zeros((64, p.shape[1]))
    last = np.array(first)
    for k in range(64):
        own = bucket == k
        w = np.array(unseen) if k == 0 else last.copy()
        if own.any():
            w = np.full(p.shape[1], 1.0) if k else (w > 0).astype(float)
            w /= w.sum()
            pk, nk = p[own], n[own].astype(float)
            for _ in range(rounds):
                share = w * pk
                new = (nk[:, None] * share / share.sum(1, keepdims=True)).sum(0)
                new = np.maximum(new, 1e-6 * nk.sum()) * (w > 0)  # no weight dies out
                new /= new.sum()
                if np.abs(new - w).max() < 1e-9:
                    break
                w = new
            if k:
                last = w
        out[k] = w
    return out


def learn_weights(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, n: np.ndarray, types: int, rounds: int = 1000) -> np.ndarray:
    """Expectation-maximisation; weights (l2, l1, l0) for each bucket up to 63.

    A bucket without events takes the weights of the nearest lower bucket that has some
    (bucket 0, without a bigram estimate: no weight for it).
    """
    p = np.stack([p2, p1, np.full(len(n), 1 / (types + 1))], 1)
    return _maximise(bucket, p, n, [0.4, 0.4, 0.2], [0.0, 0.7, 0.3], rounds)


def learn_shares(bucket: np.ndarray, p: np.ndarray, lower: np.ndarray, n: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Weights (m, 1 - m) of an order above two and of the model below it, by the same maximisation."""
    return _maximise(bucket, np.stack([p, lower], 1), n, [0.4, 0.6], [0.0, 1.0], rounds)


def score(docs: DataFrame, order: int = 3, deleted_of: int = 8, block_bytes: int = 2 << 20, keys_per_bucket: int = 600_000) -> DataFrame:
    """Log10 probability of each text of ``docs(doc_id, text, train)`` by n-grams up to an ``order`` of two or more.

    (doc_id, n_tokens, n_known, train_tokens, base_score, score). Documents with ``train``
    teach the model; one in ``deleted_of`` of them, by a hash of id and text, is held out for the
    weights. A null text is empty: its end token alone is scored. Rows with equal or null
    ids are documents of their own. Without training documents all scores are 0.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    docs = docs.withColumn("deleted", F.col("train") & (F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(deleted_of)) == 0))
    table = written(blocks(docs, block_bytes), "blocks")
    size = table.groupBy().agg(F.sum("n_train").alias("n"), F.sum(F.when(~F.col("deleted"), F.col("n_train"))).alias("kept"), F.count(F.lit(1)).alias("blocks")).first()
    total, kept = int(size["n"] or 0), int(size["kept"] or 0)
    buckets = int(min(1 << 24, max(64, total // keys_per_bucket)))
    counts = written(exchange(table, buckets, order, total), "counts")
    types = int(counts.where("block is null and n = 1").agg(F.sum("types")).first()[0] or 0)
    counts = counts.where("block is not null")
    weights: dict[int, np.ndarray] = {}
    for k in range(2, order + 1):
        hist = held_out_histogram(table, counts, buckets, total, kept, types, k, weights).toArrow()  # bounded: buckets times classes squared
        bucket, p, lower, n = (hist.column(c).to_numpy() for c in ("bucket", "p", "lower", "n"))
        weights[k] = learn_weights(bucket, p, lower, n, types) if k == 2 else learn_shares(bucket, p, lower, n)
    if not total:
        weights[2][:] = [0.0, 0.0, 1.0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {x: [] for x in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        rows = right.to_pylist()
        for row in left.to_pylist():
            b = Block(row, buckets, order, total)
            ctx, p, cw = _estimates(b, rows, "whole", total, order)
            logp = np.log10(_mixed(ctx, p, weights, types, order))
            base = np.log10((cw + 1) / (total + types + 1))
            cols["doc_id"] += b.doc_ids
            cols["n_tokens"].append(b.sizes)
            for name, x in (("n_known", (cw > 0).astype(np.int64)), ("base_score", base), ("score", logp)):
                cols[name].append(np.add.reduceat(x, b.begin))
        arrays = [pa.array(cols.pop("doc_id"), pa.int64())] + [pa.array(np.concatenate(x)) for x in cols.values()]
        return pa.Table.from_arrays(arrays, names=["doc_id", *cols])

    out = table.groupBy("block").cogroup(counts.select("n", "bucket", "block", "whole").groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
