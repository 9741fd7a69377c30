"""Best-fit packing of documents into sequences, after Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram: one count
for each length, however many documents there are. The driver plans on that histogram:

1. *Reduction*: for the longest lengths first, a set of one, two or three pieces that
   dominates every other set with that piece (each alternative's pieces can be
   exchanged for the set's own) is fixed for good, as many times as there are pieces for it.
2. *Best fit*: what is left goes, longest first, into the fullest open
   sequence that holds it, whole groups of equal sequences at a time.

A plan is a list of patterns (which lengths, how often), so its size depends on the
capacity alone. Executors then number the pieces of each length (salted, so that a hot
length is no one task's) and look up the place of each number in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.session import written

Pattern = tuple[tuple[int, int], ...]  # (length, copies) ...


def _times(counts: dict[int, int], chosen: list[int]) -> int:
    return min(counts.get(x, 0) // chosen.count(x) for x in set(chosen))


def _smallest(lengths: list[int], counts: dict[int, int], skip: int, n: int) -> list[int]:
    """The n smallest pieces besides one of length ``skip``; fewer if there aren't so many."""
    out: list[int] = []
    for x in lengths:
        out += [x] * min(n - len(out), counts[x] - (x == skip))
        if len(out) == n:
            break
    return out


def _largest(lengths: list[int], counts: dict[int, int], used: list[int], most: int) -> int:
    """The largest length up to ``most`` of which a piece is left besides ``used``; 0 if none."""
    i = bisect_left(lengths, most + 1) - 1
    while i >= 0:
        x = lengths[i]
        if counts[x] > used.count(x):
            return x
        i -= 1
    return 0


def _dominating(w: int, lengths: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """A set with a piece of length w that dominates all others with it, or none."""
    room = capacity - w
    best = _largest(lengths, counts, [w], room)
    if not best:
        return [w]
    if best == room:
        return [w, best]
    small = _smallest(lengths, counts, w, 3)
    if len(small) < 2 or small[0] + small[1] > room:
        return [w, best]
    if len(small) < 3 or sum(small) > room:  # two others at most
        second = _largest(lengths, counts, [w, best], room - best)
        if not second:
            return []
        for x in lengths:
            if x > best:
                break
            y = _largest(lengths, counts, [w, x], min(x, room - x)) if counts[x] > (x == w) else 0
            if y > second and x + y > best:
                return []
        return [w, best, second]
    return []


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix dominating sets; the patterns fixed and the counts left over."""
    counts = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(counts, reverse=True):
            while counts.get(w, 0) > 0:
                lengths = sorted(k for k, v in counts.items() if v > 0)
                chosen = _dominating(w, lengths, counts, capacity)
                n = _times(counts, chosen) if chosen else 0
                if not n:
                    break
                for x in chosen:
                    counts[x] -= n
                    if not counts[x]:
                        del counts[x]
                fixed.append((tuple((x, chosen.count(x)) for x in sorted(set(chosen), reverse=True)), n))
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram; equal sequences are handled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            room = min((r for r in open_ if r >= w), default=capacity)
            if room in open_:
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                pattern, n = (), left  # as many new sequences as it takes
            each = room // w
            full = min(n, left // each)
            if full:
                open_.setdefault(room - each * w, []).append((pattern + ((w, each),), full))
                left -= full * each
            if left and full < n:  # the last sequence gets fewer
                open_.setdefault(room - left * w, []).append((pattern + ((w, left),), 1))
                left, full = 0, full + 1
            if n > full and pattern:
                open_.setdefault(room, []).append((pattern, n - full))
    return [x for group in open_.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def lookup(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length, intervals of piece numbers and the places that they get."""
    rows, used, first = [], {}, 0
    for pattern, n in patterns:
        at = 0
        for w, copies in pattern:
            start = used.get(w, 0)
            rows.append((w, start, first, copies, at))
            used[w] = start + n * copies
            at += w * copies
        first += n
    rows.sort()
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return dict(zip(("length", "start", "first", "copies", "at"), (np.array(c, np.int64) for c in cols), strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and number (from 0) among equals."""
    lo = np.searchsorted(table["length"], length, "left")
    hi = np.searchsorted(table["length"], length, "right")
    while (open_ := hi - lo > 1).any():  # halve the intervals of all pieces at once
        mid = (lo + hi) // 2
        up = open_ & (table["start"][np.minimum(mid, len(table["start"]) - 1)] <= rank)
        lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
    nth = rank - table["start"][lo]
    return table["first"][lo] + nth // table["copies"][lo], table["at"][lo] + nth % table["copies"][lo] * length


PIECE = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` ids, a piece a row.

    A null text is empty; it still has its end id, so every document has a piece.
    ``with_ids`` keeps the ids themselves (array of int).
    """
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.tokenizer(path)
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [], [], [])
            n = 0
            for i, text in enumerate(batch.column(1)):
                coded = t.encode(text.as_py() or "") + end
                for at in range(0, len(coded), step):
                    part = coded[at : at + step]
                    for col, v in zip(out, (i, at // step, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(v)
                n += len(coded)
                if n > 8 << 20 or i + 1 == batch.num_rows:
                    arrays = [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    out, n = ([], [], [], [], [], []), 0

    schema = f"doc_id {kind}, {PIECE}" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int, rows_per_salt: int = 20_000) -> DataFrame:
    """``pieces`` (as of :func:`token_pieces`) with ``sequence_id`` and ``offset``.

    Every piece gets a place, nothing overlaps, and a sequence has no gaps from offset
    0. Rows with equal ids and null ids are pieces like any other; an empty table gives an
    empty table. ``pieces`` is read twice, so it should be a written table.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = lookup(plan(counts, capacity))
    salts = 1 << max(8, (sum(counts.values()) // rows_per_salt).bit_length())
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    group = ["length", "_salt"]
    before = (
        salted.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    )
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*keys)) - 1)
    ranked = ranked.join(before.hint("merge"), group).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")
    names = pieces.columns

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("length")
            seq, off = place(table, b.column(at).to_numpy(), b.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(places, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack; a row for each piece with its sequence and offset."""
    return pack(written(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)
