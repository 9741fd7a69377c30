"""Join of texts whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. *Classes.* Rows with the same words in the same order are one class; from here on
   a class stands for all its copies.
2. *Bands.* MinHash signatures are cut into bands; band and row counts are the
   sharpest that reach the target recall at the threshold. Classes are shuffled by band hashes, and
   those that share one are a bucket.
3. *Candidates.* A pair of classes belongs to its first common band. Each bucket finds which of its
   classes have such a pair there, from the classes' lists of buckets alone; only those send their n-gram sets there.
4. *Verification.* A bucket compares the full n-gram sets of the pairs that belong to it, so each pair that shares a band
   is verified once and no other pair is. A task returns for each class its number of links and
   edges of a spanning forest, not the pairs.
5. *Groups.* Components of the verified edges.

A large bucket is cut into chunks by a hash, bounded in classes and in n-grams, and each pair of chunks is a task of
its own, so no task grows with it; small buckets share tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.graph import components
from lodestone.llm.textbytes import U, chunks, column_bytes, mix, prefix, ragged, settle, span_hash, words
from lodestone.session import written


def choose_bands(threshold: float, recall: float, most_hashes: int = 240) -> tuple[int, int]:
    """(bands, rows): the most rows in a band with which few enough bands reach the recall."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no such recall with so few hashes")


def shingles(col: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words (a shorter text: of all its words) and their rows; word hashes and their bounds."""
    buf, bounds = column_bytes(col)
    s, e, row = words(buf, bounds)
    n = len(bounds) - 1
    h = span_hash(prefix(buf, lower=True), s, e) if len(s) else np.zeros(0, U)
    count = np.bincount(row, minlength=n)
    upto = np.concatenate([[0], np.cumsum(count)])
    grams = np.maximum(count - size + 1, (count > 0).astype(int))
    first = np.cumsum(grams) - grams
    owner = np.repeat(np.arange(n), grams)
    at = np.arange(int(grams.sum())) - first[owner] + upto[owner]
    end = upto[1:][owner]
    out = np.full(len(at), U(size))
    for k in range(size):
        place = at + k
        inside = place < end
        out = np.where(inside, mix(out * U(0x100000001B3) + h[np.minimum(place, len(h) - 1)]), out) if len(h) else out
    return out, owner, h, upto


def _keys_of(h: np.ndarray, upto: np.ndarray) -> list[str | None]:
    """Names of sequences of words, 128 bits; none without a word."""
    return [xxhash.xxh3_128_hexdigest(h[a:b].tobytes()) if a < b else None for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def _keys(col: pa.Array) -> list[str | None]:
    buf, bounds = column_bytes(col)
    s, e, row = words(buf, bounds)
    h = span_hash(prefix(buf, lower=True), s, e) if len(s) else np.zeros(0, U)
    return _keys_of(h, np.searchsorted(row, np.arange(len(bounds))))


def _hash_numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(5))
    return r.integers(0, 2**32, n, dtype=np.uint32), r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(docs: DataFrame, bands: int, rows: int, size: int = 5) -> DataFrame:
    """(doc_id, text_hash, key, n, bands): the class of each row, null without a word, and its band hashes."""
    xor, mul = _hash_numbers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for b in chunks(batch, "text"):
                g, owner, h, upto = shingles(b.column(1), size)
                n = b.num_rows
                keys = _keys_of(h, upto)
                has = np.flatnonzero(np.diff(upto) > 0)
                out = np.zeros((n, bands), U)
                if len(has):
                    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    x = (g >> U(32)).astype(np.uint32)
                    x ^= x >> np.uint32(15)
                    for band in range(bands):
                        acc = np.full(len(has), U(band + 1))
                        for k in range(band * rows, (band + 1) * rows):
                            acc = mix(acc * U(0x100000001B3) + np.minimum.reduceat((x ^ xor[k]) * mul[k], begin))
                        out[has, band] = acc
                flat = pa.array(out.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.string()), pa.array(np.diff(upto)), lists], names=["doc_id", "text_hash", "key", "n", "bands"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return kept.mapInArrow(run, "doc_id long, text_hash long, key string, n long, bands array<long>")


def _shared(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    both = [np.concatenate(a), np.concatenate(b)]
    common = np.intersect1d(np.unique(both[0]), np.unique(both[1]), assume_unique=True)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    cols = [np.searchsorted(common, x) for x in both]
    hit = [(c < len(common)) & (common[np.minimum(c, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for c, x in zip(cols, both, strict=True)]
    for at in range(0, len(common), width):
        m = []
        for k, x in enumerate((a, b)):
            own = hit[k] & (cols[k] >= at) & (cols[k] < at + width)
            dense = np.zeros((len(x), min(width, len(common) - at)), np.float32)
            dense[rows[k][own], cols[k][own] - at] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out


def _pairs(value: np.ndarray, chunk: np.ndarray, left: int, right: int, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal value, of which one is in the left and one in the right chunk, some at a time."""
    first = np.flatnonzero(chunk == left)
    first = first[np.argsort(value[first], kind="stable")]
    if left == right:
        second, start = first, np.arange(len(first)) + 1
    else:
        second = np.flatnonzero(chunk == right)
        second = second[np.argsort(value[second], kind="stable")]
        start = np.searchsorted(value[second], value[first], "left")
    count = np.searchsorted(value[second], value[first], "right") - start
    upto = np.cumsum(count)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield np.repeat(first[at:to], count[at:to]), second[ragged(start[at:to], count[at:to])]
        at = to


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and its rows' lengths."""
    col = t.column(name).combine_chunks()
    col = col if isinstance(col, pa.Array) else col.chunk(0)
    return col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets_of(t: pa.Table, bands: int) -> np.ndarray:
    """For each row and band, the class's bucket there (0: a bucket of its own)."""
    out = np.zeros((t.num_rows, bands), np.int64)
    band, n = _flat(t, "shared_bands")
    out[np.repeat(np.arange(t.num_rows), n), band] = _flat(t, "shared")[0]
    return out


def _here(of: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have their first common band here."""
    return ((of[i] == of[j]) & (of[i] != 0)).argmax(1) == band[i]


def find_members(bands: int):
    """Of the classes of buckets, those with a pair that belongs there."""

    def run(t: pa.Table) -> pa.Table:
        value, band, chunk = (t.column(c).to_numpy() for c in ("value", "band", "chunk"))
        of, needed = _buckets_of(t, bands), np.zeros(t.num_rows, bool)
        for i, j in _pairs(value, chunk, t.column("left")[0].as_py(), t.column("right")[0].as_py()):
            own = _here(of, band, i, j)
            needed[i[own]] = needed[j[own]] = True
        return t.select(["value", "band", "node"]).filter(pa.array(needed))

    return run


def _common(sets: np.ndarray, begin: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, which lie in one array."""
    out = np.zeros(len(i), np.int64)
    upto = np.cumsum(size[i] + size[j])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        which = np.r_[np.repeat(np.arange(at, to), size[i[at:to]]), np.repeat(np.arange(at, to), size[j[at:to]])]
        x = np.r_[sets[ragged(begin[i[at:to]], size[i[at:to]])], sets[ragged(begin[j[at:to]], size[j[at:to]])]]
        key = x + which.astype(U) * U(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        same = (key[order[1:]] == key[order[:-1]]) & (which[order[1:]] == which[order[:-1]])
        np.add.at(out, which[order[1:][same]], 1)
        at = to
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least one that it is linked with, by any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for x in (i, j, root[i], root[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(threshold: float, bands: int, dense: int = 2_000):
    def run(t: pa.Table) -> pa.Table:
        value, band, chunk = (t.column(c).to_numpy() for c in ("value", "band", "chunk"))
        left, right = t.column("left")[0].as_py(), t.column("right")[0].as_py()
        keys, place = np.unique(t.column("key").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        of = _buckets_of(t, bands)
        raw = t.column("grams").to_pylist()
        size = np.array([len(x) // 8 for x in raw], np.int64)
        sets = np.frombuffer(b"".join(raw), U)
        begin = np.cumsum(size) - size
        links, edges = np.zeros(len(keys), np.int64), []

        def linked(i: np.ndarray, j: np.ndarray, common: np.ndarray) -> None:
            ok = common >= threshold * (size[i] + size[j] - common) - 1e-6
            x, y = place[i[ok]], place[j[ok]]
            np.add.at(links, x, 1)
            np.add.at(links, y, 1)
            if len(x):
                some, at = np.unique(np.r_[x, y], return_inverse=True)
                root = _forest(len(some), at[: len(x)], at[len(x) :])
                edges.append((some, some[root]))

        for i, j in _pairs(value, chunk, left, right):
            own = _here(of, band, i, j) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6)
            i, j = i[own], j[own]
            many = np.unique(value[i], return_counts=True)
            large = np.isin(value[i], many[0][many[1] > dense])
            linked(i[~large], j[~large], _common(sets, begin, size, i[~large], j[~large]))
            for v in many[0][many[1] > dense]:  # many pairs of few sets: products of incidence matrices
                x, y = i[value[i] == v], j[value[i] == v]
                rows, at = np.unique(x, return_inverse=True)
                cols, to = np.unique(y, return_inverse=True)
                get = [[sets[begin[k] : begin[k] + size[k]] for k in own] for own in (rows, cols)]
                linked(x, y, np.rint(_shared(*get)[at, to]).astype(np.int64))
        parent = np.arange(len(keys))
        if edges:
            parent = _forest(len(keys), *(np.concatenate(x) for x in zip(*edges, strict=True)))
        has = np.flatnonzero(links)
        return pa.table({"key": pa.array(keys[has], pa.string()), "links": pa.array(links[has]), "parent": pa.array(keys[parent[has]], pa.string())})

    return run


def _in_chunks(df: DataFrame, chunks: Column, bundles: int, key: str) -> DataFrame:
    """Rows with their chunk of their bucket, once for each pair of chunks that they belong to."""
    df = df.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    # small buckets share tasks; the tasks of a large one are spread
    df = df.withColumn("bundle", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("value"), F.lit(bundles))).otherwise(F.col("value")))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return df.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other")).drop("chunks", "other")


def _classes(docs: DataFrame, threshold: float, recall: float, size: int) -> tuple[DataFrame, DataFrame, int]:
    """Each row with its class's key, the classes, and the number of bands."""
    bands, rows = choose_bands(threshold, recall)
    sig = written(signatures(docs, bands, rows, size), "signatures")
    worded = sig.where("key is not null")
    classes = worded.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("text_id"))
    return sig, written(classes.select("key", F.conv(F.substring("key", 17, 16), 16, -10).cast("long").alias("node"), "r.doc_id", "r.text_hash", "bands", "n", "n_copies", "text_id"), "classes"), bands


def _links(docs: DataFrame, classes: DataFrame, bands: int, threshold: float, size: int, chunk_grams: int, chunk_classes: int) -> DataFrame:
    """(key, links, parent) of the classes that are similar to others; a class may have several rows."""
    exploded = classes.select("node", F.posexplode("bands").alias("band", "value"))
    common = exploded.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = written(exploded.join(common, "value"), "shared")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("band", "value", "c"))).alias("l"))
    lists = lists.select("node", F.col("l.band").alias("shared_bands"), F.col("l.value").alias("shared"), "l")
    rows = lists.select("node", "shared_bands", "shared", F.explode("l").alias("x")).select("node", "shared_bands", "shared", "x.band", "x.value", "x.c")
    rows = _in_chunks(rows, F.ceil(F.col("c") / chunk_classes).cast("int"), max(64, shared.count() // 50_000), "node")
    found = rows.groupBy("bundle", "left", "right").applyInArrow(find_members(bands), "value long, band int, node long").distinct()
    member = written(found.join(classes.select("node", "n"), "node"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                g, owner, _, _ = shingles(b.column(b.schema.get_field_index("text")), size)
                cut = np.searchsorted(owner, np.arange(b.num_rows + 1))
                grams = pa.array([np.unique(g[cut[i] : cut[i + 1]]).tobytes() for i in range(b.num_rows)], pa.binary())
                kept = b.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, grams], names=[*kept.schema.names, "grams"])

    # rows that are repeated whole are one before they move
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    text = text.groupBy("_id", "text_hash").agg(F.first("text").alias("text"))
    wanted = member.select("node").distinct().join(classes.select("node", "key", F.coalesce("doc_id", F.lit(-1)).alias("_id"), "text_hash"), "node")
    full = text.join(wanted, ["_id", "text_hash"]).select("node", "key", "text").mapInArrow(sets, "node long, key string, grams binary")
    sizes = member.groupBy("value").agg(F.greatest(F.ceil(F.sum("n") / chunk_grams), F.ceil(F.count(F.lit(1)) / chunk_classes)).cast("int").alias("pieces"))
    total = member.agg(F.sum("n")).first()[0] or 0
    placed = _in_chunks(member.select("node", "band", "value").join(sizes, "value"), F.col("pieces"), max(64, int(total // (2 * chunk_grams))), "node")
    placed = placed.join(lists.drop("l"), "node").join(full, "node")
    return written(placed.groupBy("bundle", "left", "right").applyInArrow(verify(threshold, bands), "key string, links long, parent string"), "links")


def _groups(docs: DataFrame, classes: DataFrame, bands: int, threshold: float, size: int, chunk_grams: int, chunk_classes: int) -> DataFrame:
    """(key, n_copies, text_id, n_links, root): each class with the root of its group, itself if it has no link."""
    checked = _links(docs, classes, bands, threshold, size, chunk_grams, chunk_classes)
    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    groups = components(checked.select(F.col("key").alias("u"), F.col("parent").alias("v")))
    info = classes.select("key", "n_copies", "text_id").join(links, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    return info.select("key", "n_copies", "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "key").alias("root"))


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, size: int = 5, chunk_grams: int = 500_000, chunk_classes: int = 1024) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, class_id, text_id, n_links, n_copies.

    class_id: the least doc_id of the group of texts that links join (its own without a link).
    text_id: the least doc_id with the same words in the same order; n_copies: rows with
    them. n_links: how many *different* texts are similar; every copy has its text's
    links. Texts of fewer than ``size`` words are one gram of all their words; a text
    without a word (null, empty, signs only) is similar to none and a class of its own. Rows
    with null ids count, but never give their group its id. ``chunk_grams`` and ``chunk_classes`` bound a task's sets.
    """
    sig, classes, bands = _classes(docs, threshold, recall, size)
    info = _groups(docs, classes, bands, threshold, size, chunk_grams, chunk_classes)
    ids = info.groupBy("root").agg(F.min("text_id").alias("class_id"))
    info = info.join(ids, "root").drop("root")
    out = sig.select("doc_id", "key").join(info, "key", "left")
    bare = F.col("key").isNull()
    return out.select(
        "doc_id", F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(bare, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, size: int = 5, chunk_grams: int = 500_000, chunk_classes: int = 1024) -> DataFrame:
    """``docs`` with one row of each group that :func:`join` finds; all columns stay.

    It is a row of the group's least doc_id (null ids last, then by a hash of all columns), and one row only, whether ids are
    repeated, shared by other texts, or null. Rows whose text has no word (null, empty, signs only) all stay.
    """
    _, classes, bands = _classes(docs, threshold, recall, size)
    info = written(_groups(docs, classes, bands, threshold, size, chunk_grams, chunk_classes), "groups")
    first = info.groupBy("root").agg(F.min_by("key", F.struct(F.col("text_id").isNull(), "text_id", "key")).alias("key"))
    gone = info.where("n_links > 0").select("key").join(first, "key", "left_anti")
    names = docs.columns
    at = names.index("text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_keys(b.column(at)), pa.string())], names=[*names, "_class_key"])

    bare = ~F.coalesce("text", F.lit("")).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")
    keyed = docs.where(~bare).mapInArrow(name, T.StructType([*docs.schema.fields, T.StructField("_class_key", T.StringType())]))
    every = [F.col(f"`{c}`") for c in names]
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*every))
    kept = keyed.groupBy("_class_key").agg(F.min_by(F.struct(*every), rank).alias("r"))  # a partition sends a row of each text at most
    kept = kept.join(gone.withColumnRenamed("key", "_class_key"), "_class_key", "left_anti").select("r.*")
    return docs.where(bare).unionByName(kept)
