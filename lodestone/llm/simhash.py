"""SimHash fingerprints, and search for all of them within a Hamming radius.

Terms are pairs of neighbouring words in lower case (the first word pairs with the
text's start). A term votes on each bit of the fingerprint with its hash's bits, as often as
its weight says (longer pairs say more); the sign of the sum is the bit. Votes are
summed in byte lanes of 64-bit words, 8 bits at an addition.

Search: a fingerprint is cut into radius + 1 blocks. Two within the radius agree in at least
one whole block, so tables keyed by each block (the permuted tables) find all of them.
A pair is verified where its first common block meets, so no pair comes twice; that and the distance are conditions of the join,
which gives no other pairs. A block value that many fingerprints share is parted by a second hash: its fingerprints are spread,
and queries go to each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.textbytes import U, chunks, column_bytes, mix, prefix, span_hash, words

BITS = 128
#: A byte's bits, each in a byte of its own.
_LANES = np.array([sum(((v >> (7 - i)) & 1) << (8 * i) for i in range(8)) for v in range(256)], U)
_START = U(0xD6E8FEB86659FD93)


def fingerprint_column(col: pa.Array, bits: int = BITS) -> np.ndarray:
    """Fingerprints of a string column, a row of bits/8 bytes each. Texts without a word get zeros."""
    buf, bounds = column_bytes(col)
    s, e, row = words(buf, bounds)
    out = np.zeros((len(bounds) - 1, bits // 8), np.uint8)
    if not len(s):
        return out
    h = span_hash(prefix(buf, lower=True), s, e)
    first = np.r_[True, row[1:] != row[:-1]]
    before = np.where(first, _START, np.r_[U(0), h[:-1]])
    term = mix(before * U(3) + h)
    weight = np.minimum(3, 1 + (e - s + np.where(first, 0, np.r_[0, (e - s)[:-1]])) // 8).astype(U)
    # runs of at most 80 terms of one row: a byte lane holds 3 * 80
    place = np.arange(len(s)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    begin = np.flatnonzero(place % 80 == 0)
    owner = row[begin]
    total = np.add.reduceat(weight, begin).astype(np.int64)
    rows = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = np.add.reduceat(total, rows)
    for word in range(bits // 64):
        hashed = mix(term + U((word + 1) * 0x9E3779B97F4A7C15 % 2**64)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(_LANES[hashed[:, byte]] * weight, begin).view(np.uint8).reshape(-1, 8)
            votes = np.add.reduceat(lanes.astype(np.int64), rows, axis=0)
            out[owner[rows], word * 8 + byte] = np.packbits(2 * votes > total[:, None], axis=1)[:, 0]
    return out


def hexes(fp: np.ndarray) -> list[str]:
    return [bytes(x).hex() for x in fp]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits estimates, 0 at least; 1 for equal fingerprints."""
    apart = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.maximum(0.0, np.cos(np.pi * apart / (8 * a.shape[1])))


def fingerprints(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with ``fingerprint`` (hex). Null texts count as empty; other columns stay."""
    docs = docs.drop("fingerprint")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hexes(fingerprint_column(b.column(at), bits)), pa.string())], names=[*names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def neighbours(queries: DataFrame, index: DataFrame, radius: int, bits: int = BITS, per_part: int = 10_000) -> DataFrame:
    """All pairs of distinct fingerprints of two tables within a Hamming radius.

    Both tables have a ``fingerprint``; the result is (query, found, distance, n_found), once for each
    pair of values, so copies of a fingerprint make no pairs of their own: n_found says how many rows of the index
    have it. Equal values are found at distance 0; null fingerprints are left out. ``per_part`` bounds the
    fingerprints of a block value that stay together.
    """
    blocks, n_words = radius + 1, bits // 64
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def prepared(df: DataFrame, name: str) -> DataFrame:
        as_bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 8 * i + 1, 8), 16, 2), 32, "0") for i in range(bits // 32)])
        df = df.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias(f"{name}_n"))
        words_ = [F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long").alias(f"{name}_{i}") for i in range(n_words)]
        keys = F.transform(F.array(*[F.substring(as_bits, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(blocks)]), lambda x: F.xxhash64(x) if bits // blocks >= 63 else F.conv(x, 2, 10).cast("long"))
        return df.select(*words_, f"{name}_n", F.posexplode(keys).alias("block", "key"))

    found, query = prepared(index, "found"), prepared(queries, "query")
    large = found.groupBy("block", "key").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    found = found.join(large, ["block", "key"], "left").withColumn("part", F.pmod(F.xxhash64(*[f"found_{i}" for i in range(n_words)]), parts).cast("int")).drop("parts")
    query = query.join(large, ["block", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    apart = [F.col(f"query_{i}").bitwiseXOR(F.col(f"found_{i}")) for i in range(n_words)]
    distance = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
    first = F.lit(True)
    for k in range(blocks - 1):  # no earlier block is common
        mask = sum(1 << (bits - 1 - b) for b in range(edges[k], edges[k + 1]))
        differs = F.lit(False)
        for i, x in enumerate(apart):
            own = mask >> (64 * (n_words - 1 - i)) & ((1 << 64) - 1)
            differs = differs | (x.bitwiseAND(F.lit(signed(own))) != 0) if own else differs
        first = first & ((query["block"] <= k) | differs)
    on = (query["block"] == found["block"]) & (query["key"] == found["key"]) & (query["part"] == found["part"]) & first & (distance <= radius)
    text = lambda name: F.lower(F.concat(*[F.lpad(F.hex(f"{name}_{i}"), 16, "0") for i in range(n_words)]))
    return query.join(found, on).select(text("query").alias("query"), text("found").alias("found"), distance.cast("int").alias("distance"), F.col("found_n").alias("n_found"))


def with_neighbours(rows: DataFrame, is_query: Column, radius: int, bits: int = BITS) -> DataFrame:
    """``rows`` (with a ``fingerprint``) and ``n_near``: of a query row, how many other rows lie within the radius; else null.

    ``rows`` is read several times, so it should be a written table. Rows with a null query flag are no queries.
    """
    asked = rows.where(is_query)
    near = neighbours(asked.select("fingerprint"), rows.select("fingerprint"), radius, bits).groupBy("query").agg((F.sum("n_found") - 1).alias("n_near"))
    answered = asked.join(near.withColumnRenamed("query", "fingerprint"), "fingerprint", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "n_near")
    return rows.where(~F.coalesce(is_query, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")).unionByName(answered)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, bucket, extra) so that, sorted by all but the text, each row's successor stands below it.

    Order: descending doc_id, null ids last, rows of equal ids by a hash of their
    texts. The rows are cut into ranges; the first row of the range after (after the
    last: of the first) is added to each as an ``extra`` row. The driver gets a key for each range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    edges = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + F.pmod(F.shiftright("tie", 58) + 32, F.lit(64))).otherwise(F.size(F.filter(edges, lambda c: c >= F.col("doc_id"))))
    docs = docs.withColumn("bucket", own.cast("int"))
    first = F.min(F.struct((-F.col("doc_id")).alias("minus"), F.col("tie").alias("tie"))).alias("first")
    keys = sorted((r["bucket"], r["first"]["minus"], r["first"]["tie"]) for r in docs.groupBy("bucket").agg(first).collect())
    spark = docs.sparkSession
    rows = [(b, None if m is None else -m, t, keys[i - 1][0]) for i, (b, m, t) in enumerate(keys)]
    heads = F.broadcast(spark.createDataFrame(rows, "bucket int, head_id long, head_tie long, back int"))  # a row for each range
    tagged = docs.join(heads, "bucket", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    places = F.when(is_head, F.array(F.struct(F.col("bucket"), F.lit(0).alias("extra")), F.struct(F.col("back").alias("bucket"), F.lit(1).alias("extra")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(0).alias("extra")))
    )
    out = tagged.select("doc_id", "text", "tie", F.explode(places).alias("p")).select("doc_id", "text", "tie", "p.bucket", "p.extra")
    return out.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "tie")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of texts and of their edits, a row for each row of ``docs``.

    The edit: the last third of a text (n_chars // 3 code points) gives way to as many first code
    points (or all) of the next text in descending order of doc_id; after the last comes the
    first, so a table of one row edits it with itself. Null texts are empty.
    """
    buckets = max(32, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def done(rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
        edited = []
        for t, after in zip(texts, texts[1:], strict=False):
            k = len(t) // 3
            edited.append(t[: len(t) - k] + after[:k])
        own = fingerprint_column(pa.array(texts, pa.large_string()), bits)
        other = fingerprint_column(pa.array(edited, pa.large_string()), bits)
        nearby, following = likeness(own[:-1], other), likeness(own[:-1], own[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexes(own[:-1])), pa.array(hexes(other)), pa.array(nearby), pa.array(following),
            ],
            names=[x.split()[0] for x in EDITED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, bucket = [], [], 0, None
        for b in batches:
            for i, t, at, extra in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if extra and at != bucket:
                    continue  # a second copy of the head row
                t = t.as_py()
                texts.append(t)
                if extra:  # the bucket's end
                    yield done(ids, texts)
                    ids, texts, size, bucket = [], [], 0, None
                    continue
                ids.append(i)
                bucket = at
                size += len(t)
                if size > 4 << 20 and len(ids) > 1:
                    yield done(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    return with_next(docs, buckets).select("doc_id", "text", "bucket", "extra").mapInArrow(run, EDITED)
