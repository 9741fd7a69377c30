"""Removal of bytes that lie in a long string that also starts earlier.

*Anchors.* In every window of ``length`` bytes the rightmost least hash of its ``GRAM``-byte
strings is its anchor. Equal windows have equal anchors at equal places, and an anchor
serves neighbouring windows, whose union is its *support* (``length`` bytes and some more).
Windows are thus parted by their anchors' hashes, without loss.

*Verdicts.* Blocks of documents send each distinct (anchor, support) once to a bucket of the
anchor. An anchor met once is left alone. Of equal supports all but the first go wholly.
Supports that share an anchor but differ meet in suffix arrays. An anchor with very many of those is *hot*:
its windows are parted once more, by their own hashes, and go to as many tasks as there are; a block
sends each of its distinct windows once.

*Suffix arrays.* For each such anchor, the distinct supports (each at its first place) are one text (for a hot one:
its windows of one hash);
its suffix array is made by linear grouping (see :mod:`suffixes`). Neighbours in it that
agree in ``length`` bytes are one window; all but its first place go.

Texts are written once, in compressed blocks, and never sorted or grouped by content; what
moves is a few bytes for each anchor, and the bytes of supports that differ. The hashes
of anchors and supports together have 96 bits or more; suffix arrays compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.suffixes import suffix_arrays
from lodestone.llm.textbytes import U, chunks, column_bytes, mix, pack, prefix, ragged, settle, span_hash, unpack
from lodestone.session import written

GRAM = 64
_LOW = U((1 << 48) - 1)
#: An anchor with more distinct supports than this is hot.
HOT = 400
#: Symbols in one lot of suffix arrays.
LOT = 400_000
#: Bytes of documents whose anchors are found at a time; temporary arrays take some 90 bytes for each.
RUN = 1 << 16


def _least(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of each w neighbours, by doubling."""
    n, s = len(x) - w + 1, 1
    while 2 * s <= w:
        x = pick(x[:-s], x[s:])
        s *= 2
    return pick(x[:n], x[w - s : w - s + n])


def anchors(buf: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, and the first and last start of the windows that each serves."""
    none = np.zeros(0, np.int64)
    w = length - GRAM + 1
    if len(buf) < length:
        return none, none, none
    n = len(buf) - GRAM + 1
    sums = prefix(buf)
    h = span_hash(sums, np.arange(n), np.arange(n) + GRAM)
    least = _least(h, w)  # of the window that starts here
    edge = np.zeros(w - 1, U)
    best = _least(np.concatenate([edge, least, edge]), w, np.maximum)
    q = np.flatnonzero(h == best)
    hq = h[q]
    first = np.maximum(np.where(hq[1:] > hq[:-1], q[:-1] + 1, q[1:] - w + 1), 0)
    first = np.maximum.accumulate(np.r_[0, first])
    last = np.minimum(np.r_[first[1:] - 1, len(least) - 1], q)
    # windows stay within their document; the one of the last start or else of the first
    for side in (last, first):
        d = np.clip(np.searchsorted(bounds, side, "right") - 1, 0, len(bounds) - 2)
        lo, hi = np.maximum(first, bounds[d]), np.minimum(last, bounds[d + 1] - length)
        if side is last:
            lo1, hi1 = lo, hi
        else:
            use = lo1 > hi1
            lo, hi = np.where(use, lo, lo1), np.where(use, hi, hi1)
    ok = lo <= hi
    return q[ok], lo[ok], hi[ok]


def anchors_by_runs(buf: np.ndarray, bounds: np.ndarray, length: int) -> list[np.ndarray]:
    """:func:`anchors`, for some documents at a time: no window crosses their bounds."""
    parts, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN, "right")) - 1)
        own = bounds[at : to + 1]
        parts.append([x + own[0] for x in anchors(buf[own[0] : own[-1]], own - own[0], length)])
        at = to
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class Block:
    def __init__(self, row: dict, buckets: int, length: int):
        self.row, self.length = row, length
        self.batch = pa.ipc.open_stream(row["payload"]).read_all().combine_chunks()
        text = self.batch.column("text")
        self.buf, self.bounds = column_bytes(text.combine_chunks() if isinstance(text, pa.ChunkedArray) and text.num_chunks != 1 else text.chunk(0))
        q, lo, hi = (unpack(row[x]).astype(np.int64) for x in ("anchors", "back", "ahead"))
        q = np.cumsum(q)
        self.q, self.lo, self.hi = q, q - lo, q - hi
        sums = prefix(self.buf)
        key = span_hash(sums, q, q + GRAM)
        whole = span_hash(sums, self.lo, self.hi + length) + (q - self.lo).astype(U) * U(0x9E3779B97F4A7C15)
        bucket = ((key >> U(48)) % U(buckets)).astype(np.int64)
        low, whole = key & _LOW, whole & _LOW
        # the first place of each distinct (anchor, support); places ascend with the order of documents
        o = np.lexsort((q, whole, low, bucket))
        new = np.ones(len(o), bool)
        new[1:] = (bucket[o][1:] != bucket[o][:-1]) | (low[o][1:] != low[o][:-1]) | (whole[o][1:] != whole[o][:-1])
        self.again = o[~new]  # served by an earlier equal support of this block
        self.o = o[new]
        self.low, self.whole = low[self.o], whole[self.o]
        self.cut = np.searchsorted(bucket[self.o], np.arange(buckets + 1))
        self.doc = np.searchsorted(self.bounds, q, "right") - 1
        self.ids = np.array([np.iinfo(np.int64).max if x is None else x for x in row["doc_ids"]], np.int64)

    def verdicts(self, rows: list[dict], stage: int) -> list[tuple[int, bytes]]:
        return sorted((r["bucket"], r["out"]) for r in rows if r["stage"] == stage)

    def marks(self, rows: list[dict]) -> np.ndarray:
        """0, 1 (all windows go), 2 (look closer) or 3 (look closer, by windows) for each distinct support."""
        out = np.zeros(len(self.o), np.uint8)
        for bucket, packed in self.verdicts(rows, 1):
            out[self.cut[bucket] : self.cut[bucket + 1]] = unpack(packed)
        return out

    def pieces(self, marks: np.ndarray, buckets: int) -> Pieces:
        """What to look at: supports, and distinct windows of hot anchors; by the second buckets."""
        length = self.length
        two, three = self.o[marks == 2], self.o[marks == 3]
        many = self.hi[three] - self.lo[three] + 1
        start, anchor = ragged(self.lo[three], many), np.repeat(self.low[marks == 3], many)
        sums = prefix(self.buf)
        h = span_hash(sums, start, start + length) if len(start) else np.zeros(0, U)
        o = np.lexsort((start, h, anchor))
        start, anchor, h = start[o], anchor[o], h[o]
        new = np.r_[True, (h[1:] != h[:-1]) | (anchor[1:] != anchor[:-1])][: len(o)]
        again = np.flatnonzero(~new)
        for k in range(0, len(again), 1 << 14):  # of equal hashes, those whose bytes differ stay apart
            at = start[again[k : k + (1 << 14)]]
            before = start[again[k : k + (1 << 14)] - 1]
            span = np.arange(length)
            new[again[k : k + (1 << 14)]] = (self.buf[at[:, None] + span] != self.buf[before[:, None] + span]).any(1)
        key = np.r_[self.low[marks == 2], mix(anchor[new] * U(0x9E3779B97F4A7C15) + h[new]) & _LOW]
        first = np.r_[self.lo[two], start[new]]
        size = np.r_[self.hi[two] - self.lo[two] + length, np.full(int(new.sum()), length)]
        bucket = (key % U(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        return Pieces(first[o], size[o], key[o], np.searchsorted(bucket[o], np.arange(buckets + 1)), start[~new])


@dataclass
class Pieces:
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    cut: np.ndarray  # bounds of the buckets
    again: np.ndarray  # windows that an earlier one of this block equals


def blocks(docs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, [("doc_id", "ascending")])).combine_chunks()
        buf, bounds = column_bytes(t.column("text").chunk(0))
        q, lo, hi = anchors_by_runs(buf, bounds, length)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
        return pa.RecordBatch.from_pydict(
            {
                "block": [f"{TaskContext.get().partitionId():09d}-{number:09d}"], "doc_ids": pa.array([t.column("doc_id").to_pylist()], pa.list_(pa.int64())), "n_anchors": pa.array([len(q)], pa.int64()),
                "anchors": [pack(np.diff(q, prepend=0))], "back": [pack(q - lo)], "ahead": [pack(q - hi)],
                "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held, size, number = [], 0, 0
        for batch in batches:
            for b in chunks(batch, "text", block_bytes // 4):
                held.append(b)
                size += b.nbytes
                if size >= block_bytes:
                    yield block(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return docs.mapInArrow(run, "block string, doc_ids array<long>, n_anchors long, anchors binary, back binary, ahead binary, payload binary")


SENT = "bucket int, block string, a binary, b binary, ids binary, doc binary"


def first_pass(table: DataFrame, buckets: int, length: int) -> DataFrame:
    """(stage, bucket, block, out, closer): a verdict for each distinct support of each block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, buckets, length)
                cols = {x.split()[0]: [] for x in SENT.split(", ")}
                for k in range(buckets):
                    lo, hi = b.cut[k], b.cut[k + 1]
                    if lo < hi:
                        docs, which = np.unique(b.doc[b.o[lo:hi]], return_inverse=True)
                        for col, v in zip(cols.values(), (k, row["block"], pack(np.diff(b.low[lo:hi], prepend=U(0))), pack(b.whole[lo:hi]), b.ids[docs].tobytes(), pack(which)), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols["bucket"], pa.int32()), pa.array(cols["block"], pa.string()), *(pa.array(cols[x], pa.binary()) for x in ("a", "b", "ids", "doc"))], names=list(cols))

    def judge(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        rows = t.to_pylist()
        low = [np.cumsum(unpack(r["a"])) for r in rows]
        sizes = [len(x) for x in low]
        whole = np.concatenate([unpack(r["b"]) for r in rows])
        doc = np.concatenate([np.frombuffer(r["ids"], np.int64)[unpack(r["doc"]).astype(int)] for r in rows])
        low = np.concatenate(low)
        o = np.lexsort((doc, whole, low))  # stable: blocks by name among equal ids
        anchor = np.r_[True, low[o][1:] != low[o][:-1]]
        support = anchor | np.r_[True, whole[o][1:] != whole[o][:-1]]
        kinds = np.add.reduceat(support.astype(int), np.flatnonzero(anchor))[np.cumsum(anchor) - 1]
        mark = np.zeros(len(o), np.uint8)
        mark[o] = np.where(~support, 1, np.where(kinds > HOT, 3, np.where(kinds > 1, 2, 0)))
        parts = np.split(mark, np.cumsum(sizes)[:-1])
        n = len(rows)
        return pa.table(
            {
                "stage": pa.array([1] * n, pa.int32()), "bucket": t.column("bucket"), "block": t.column("block"),
                "out": pa.array([pack(p) for p in parts], pa.binary()), "closer": pa.array([int((p == 2).sum() + 8 * (p == 3).sum()) for p in parts], pa.int64()),
            }
        )

    return table.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(judge, "stage int, bucket int, block string, out binary, closer long")


def _window_runs(texts: list[np.ndarray], instance: np.ndarray, length: int):
    """For all windows of the texts: instance-wise classes of equal windows, by suffix arrays.

    Returns (text, offset, class) of each window.
    """
    parts, lens, at = [], [], 0
    order = np.argsort(instance, kind="stable")
    starts = np.zeros(len(texts), np.int64)
    cuts = np.flatnonzero(np.diff(instance[order])) + 1
    for own in np.split(order, cuts):
        begin = at
        for i in own:
            starts[i] = at
            parts += [texts[i].astype(np.int16) + 2, np.ones(1, np.int16)]
            at += len(texts[i]) + 1
        parts.append(np.zeros(1, np.int16))
        at += 1
        lens.append(at - begin)
    symbols = np.concatenate(parts)
    sa = suffix_arrays(symbols, np.array(lens))
    size = np.array([len(x) for x in texts])
    owner = np.full(len(symbols), -1)
    windows = ragged(starts, size - length + 1)
    owner[windows] = np.repeat(np.arange(len(texts)), size - length + 1)
    sa = sa[owner[sa] >= 0]
    same = np.zeros(len(sa), bool)
    step = 1 << 15
    span = np.arange(length)
    for k in range(1, len(sa), step):
        to = min(len(sa), k + step)
        here = symbols[sa[k - 1 : to, None] + span]
        same[k:to] = (here[1:] == here[:-1]).all(1)
    same[1:] &= instance[owner[sa[1:]]] == instance[owner[sa[:-1]]]
    return owner[sa], sa - starts[owner[sa]], np.cumsum(~same)


def second_pass(table: DataFrame, verdicts: DataFrame, buckets: int, deeper: int, length: int) -> DataFrame:
    """(stage, bucket, block, out): for each piece that was looked at, which of its windows go."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {x: [] for x in ("bucket", "block", "a", "ids", "doc", "at", "size", "bytes")}
        rows = right.to_pylist()
        squeeze = zstandard.ZstdCompressor(level=1)
        for row in left.to_pylist():
            b = Block(row, buckets, length)
            p = b.pieces(b.marks(rows), deeper)
            for k in np.flatnonzero(np.diff(p.cut)):
                own = slice(p.cut[k], p.cut[k + 1])
                start = p.start[own]
                doc = np.searchsorted(b.bounds, start, "right") - 1
                docs, of = np.unique(doc, return_inverse=True)
                data = b.buf[ragged(start, p.size[own])].tobytes()
                for col, v in zip(cols.values(), (int(k), row["block"], pack(p.key[own]), b.ids[docs].tobytes(), pack(of), pack(start - b.bounds[doc]), pack(p.size[own]), squeeze.compress(data)), strict=True):
                    col.append(v)
        return pa.table({"bucket": pa.array(cols["bucket"], pa.int32()), "block": pa.array(cols["block"], pa.string()), **{x: pa.array(cols[x], pa.binary()) for x in list(cols)[2:]}})

    def sort_windows(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        rows = t.to_pylist()
        key = [unpack(r["a"]) for r in rows]
        sizes = [len(x) for x in key]
        _, instance = np.unique(np.concatenate(key), return_inverse=True)
        doc = np.concatenate([np.frombuffer(r["ids"], np.int64)[unpack(r["doc"]).astype(int)] for r in rows])
        name = np.repeat(np.arange(len(rows)), sizes)
        at = np.concatenate([unpack(r["at"]).astype(np.int64) for r in rows])
        size = np.concatenate([unpack(r["size"]).astype(np.int64) for r in rows])
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"]) for r in rows), np.uint8)
        begin = np.cumsum(size) - size
        windows = size - length + 1
        gone = np.zeros(int(windows.sum()), bool)
        first_window = np.cumsum(windows) - windows
        # instances of like size together: a lot takes as many steps as its longest one has symbols
        o = np.lexsort((instance, np.bincount(instance, size)[instance]))
        edges = np.flatnonzero(np.r_[True, instance[o][1:] != instance[o][:-1]])
        total = np.cumsum(size[o])
        k = 0
        while k < len(edges):  # whole instances, at most about LOT symbols at a time
            base = total[edges[k]] - size[o[edges[k]]]
            nxt = max(k + 1, int(np.searchsorted(total[edges], base + LOT)))
            lot = o[edges[k] : edges[nxt] if nxt < len(edges) else len(o)]
            text, offset, kind = _window_runs([data[s : s + m] for s, m in zip(begin[lot], size[lot], strict=True)], instance[lot], length)
            s = lot[text]
            order = np.lexsort((at[s] + offset, name[s], doc[s], kind))
            later = np.r_[False, kind[order][1:] == kind[order][:-1]]
            gone[(first_window[s] + offset)[order[later]]] = True
            k = nxt
        bits = np.split(gone, np.cumsum(np.bincount(name, windows, len(rows)).astype(int))[:-1])
        n = len(rows)
        return pa.table({"stage": pa.array([2] * n, pa.int32()), "bucket": t.column("bucket"), "block": t.column("block"), "out": pa.array([pack(np.packbits(x)) for x in bits], pa.binary()), "closer": pa.array([0] * n, pa.int64())})

    sent = table.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(send, "bucket int, block string, a binary, ids binary, doc binary, at binary, size binary, bytes binary")
    # a set number of tasks: few bytes here are much work
    return sent.repartition(max(1, deeper // 4), "bucket").groupBy("bucket").applyInArrow(sort_windows, "stage int, bucket int, block string, out binary, closer long")


def remove_repeats(docs: DataFrame, length: int = 100, block_bytes: int = 2 << 20, keys_per_bucket: int = 400_000, closer_per_bucket: int = 2_500) -> DataFrame:
    """``docs`` with each byte gone that lies in a ``length``-byte string that also starts earlier.

    Earlier: in a document of smaller doc_id, or earlier in the same; rows with null ids come
    last, and rows with equal ids follow one another in the order of the input's partitions. Strings are judged on the
    input texts as UTF-8 (null: empty) and never cross documents. All columns stay, ``text`` is
    replaced, and these are added (columns of their names are replaced): ``n_bytes``,
    ``spans`` (maximal removed runs, as byte offsets [start, end)), and ``kept``, the
    bytes left. ``text`` is those bytes as text; a character that lost some of its bytes is left out.
    """
    docs = docs.drop("n_bytes", "spans", "kept")
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("doc_id", F.col("doc_id").cast("long"))
    table = written(blocks(docs, length, block_bytes), "texts")
    total = int(table.agg(F.sum("n_anchors")).first()[0] or 0)
    buckets = int(min(1 << 16, max(64, total // keys_per_bucket)))
    one = written(first_pass(table, buckets, length), "verdicts")
    closer = int(one.agg(F.sum("closer")).first()[0] or 0)
    deeper = int(max(48, closer // closer_per_bucket))
    two = written(second_pass(table, one, buckets, deeper, length), "windows")
    names = docs.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = []
        rows = right.to_pylist()
        for row in left.to_pylist():
            b = Block(row, buckets, length)
            marks = b.marks(rows)
            cover = np.zeros(len(b.buf) + 1, np.int32)

            def remove(s: np.ndarray, e: np.ndarray, cover=cover) -> None:
                np.add.at(cover, s, 1)
                np.add.at(cover, e, -1)

            whole = np.concatenate([b.again, b.o[marks == 1]])
            remove(b.lo[whole], b.hi[whole] + length)
            p = b.pieces(marks, deeper)
            remove(p.again, p.again + length)
            for bucket, packed in b.verdicts(rows, 2):
                own = slice(p.cut[bucket], p.cut[bucket + 1])
                n = p.size[own] - length + 1
                gone = np.unpackbits(unpack(packed).astype(np.uint8))[: int(n.sum())].astype(bool)
                at = ragged(p.start[own], n)[gone]
                remove(at, at + length)
            keep = np.cumsum(cover[:-1]) == 0
            edge = np.diff(np.concatenate([[1], keep, [1]]).astype(np.int8))
            start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            # runs end where documents do
            inner = b.bounds[1:-1]
            split = inner[(inner > 0) & (inner < len(keep))]
            split = np.unique(split[~keep[split] & ~keep[split - 1]]) if len(split) else split
            start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
            doc = np.searchsorted(b.bounds, start, "right") - 1
            per = np.searchsorted(doc, np.arange(len(b.bounds)))
            kept = [b.buf[s:e][keep[s:e]].tobytes() for s, e in zip(b.bounds[:-1], b.bounds[1:], strict=True)]
            spans = [[{"start": int(s - b.bounds[d]), "end": int(e - b.bounds[d])} for s, e in zip(start[per[d] : per[d + 1]], end[per[d] : per[d + 1]], strict=True)] for d in range(len(kept))]
            t = b.batch
            at = names.index("text")
            t = t.set_column(at, "text", pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
            t = t.append_column("n_bytes", pa.array(np.diff(b.bounds)))
            t = t.append_column("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            outs.append(t.append_column("kept", pa.array(kept, pa.binary())))
        return pa.concat_tables(outs)

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    both = one.unionByName(two)
    return table.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)
