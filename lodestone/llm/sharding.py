"""Uniform sharding with exact sizes, by a hypergeometric communication matrix.

1. Every row falls by a hash into one of 2**levels source partitions, which are counted.
2. A matrix of exact partition-to-shard counts is drawn. A binary tree over the
   partitions halves the shards' places again and again: of a shard's places, those
   that a left half gets are hypergeometric, given the rows of that half. Each level is a
   projection and an ``explode``, so the matrix is made on executors, never collected.
3. Each partition is permuted by a random key; the row of rank r goes to the shard
   whose drawn interval holds r.
4. After that exchange each shard is permuted again by a second key, in pieces: the
   pieces are counted, and a row's slot is the rows of earlier pieces plus its rank.

All of it is SQL: no Python, pandas, Arrow or RDD code touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once, under a name, for ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric_sql(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for a hypergeometric draw: marked ones among ``drawn`` of ``total``.

    Inverse transform with ``u`` in (0, 1), from the mode upwards, then from the mode
    downwards. Weights are relative to the mode's, by the ratio of neighbours, so
    no factorials are needed. Places beyond 12 standard deviations and 40 from
    the mode have less weight than a double resolves.
    """
    ratio_up = "((a.k - x + 1) * (a.d - x + 1)) / (x * (a.t - a.k - a.d + x))"  # weight(x) / weight(x - 1)
    ratio_down = "((x + 1) * (a.t - a.k - a.d + x + 1)) / ((a.k - x) * (a.d - x))"  # weight(x) / weight(x + 1)
    up = "if(b.hi > b.m, sequence(b.m + 1, b.hi), array())"
    down = "if(b.lo < b.m, sequence(b.m - 1, b.lo), array())"

    def mass(over: str, ratio: str) -> str:
        return f"aggregate({over}, named_struct('w', 1D, 's', 0D), (z, x) -> {let(f'z.w * {ratio}', 'w', 'named_struct(\"w\", w, \"s\", z.s + w)')}).s"

    def walk(over: str, ratio: str, start: str) -> str:
        step = let(f"z.w * {ratio}", "w", 'named_struct("w", w, "r", z.r - w, "x", if(z.x is null and z.r <= w, x, z.x))')
        return f"aggregate({over}, named_struct('w', 1D, 'r', {start}, 'x', cast(null as bigint)), (z, x) -> {step})"

    pick = let(
        walk(up, ratio_up, "c.r - 1"), "p",
        "coalesce(if(c.r <= 1, b.m, null), p.x, " + walk(down, ratio_down, "p.r") + ".x, b.lo)",
    )
    body = let(f"named_struct('r', b.u * (1 + {mass(up, ratio_up)} + {mass(down, ratio_down)}))", "c", pick)
    bounds = let(
        "named_struct('m', cast(greatest(a.l, least(a.h, floor((a.d + 1D) * (a.k + 1D) / (a.t + 2D)))) as bigint), 'w', cast(ceil(12 * sqrt(a.d * (a.k / a.t) * (1 - a.k / a.t))) + 40 as bigint))", "q",
        let("named_struct('m', q.m, 'lo', cast(greatest(a.l, q.m - q.w) as bigint), 'hi', cast(least(a.h, q.m + q.w) as bigint), 'u', " + u + ")", "b", body),
    )
    outer = f"named_struct('t', cast({total} as double), 'k', cast({marked} as double), 'd', cast({drawn} as double), 'l', greatest(0, {drawn} + {marked} - {total}), 'h', least({drawn}, {marked}))"
    return let(outer, "a", f"if(a.l >= a.h, cast(a.l as bigint), {bounds})")


def split_sql(places: str, rows: str, seed: int) -> str:
    """SQL: of an array of shards' places, how many go to the left half that has so many rows."""
    u = f"(pmod(xxhash64({seed}, path, level, i), 9007199254740992) + 0.5D) / 9007199254740992D"
    draw = hypergeometric_sql("s.total", "k", "s.left", u)
    step = let(f"element_at({places}, i)", "k", let(draw, "y", 'named_struct("total", s.total - k, "left", s.left - y, "out", concat(s.out, array(y)))'))
    total = f"aggregate({places}, 0L, (x, y) -> x + y)"
    return f"aggregate(sequence(1, size({places})), named_struct('total', {total}, 'left', {rows}, 'out', cast(array() as array<bigint>)), (s, i) -> {step}).out"


def communication_matrix(counts: DataFrame, shards: int, levels: int, seed: int) -> DataFrame:
    """``counts(part, n)`` of at most 2**levels partitions -> ``(part, take)``.

    take[s] rows of the partition go to shard s. Rows sum to n; columns sum to shard
    sizes that differ by one at most. Partitions without rows may be missing.
    """
    spark = counts.sparkSession
    parts = 1 << levels
    total = "aggregate(ns, 0L, (x, y) -> x + y)"
    tree = (
        spark.range(parts).withColumnRenamed("id", "part").join(counts, "part", "left")
        .groupBy().agg(F.expr("transform(array_sort(collect_list(struct(part, coalesce(n, 0L) as n))), x -> x.n) as ns"))
        .select(F.lit(0).cast("long").alias("path"), "ns", F.expr(f"transform(sequence(0, {shards - 1}), s -> {total} div {shards} + if(s < {total} % {shards}, 1L, 0L)) as places"))
    )
    for level in range(levels):
        half = parts >> (level + 1)
        tree = tree.withColumn("level", F.lit(level)).withColumn("left_n", F.expr(f"slice(ns, 1, {half})"))
        tree = tree.withColumn("gets", F.expr(split_sql("places", "aggregate(left_n, 0L, (x, y) -> x + y)", seed)))
        tree = tree.selectExpr(
            f"explode(array(struct(path * 2 as path, left_n as ns, gets as places), "
            f"struct(path * 2 + 1 as path, slice(ns, {half + 1}, {half}) as ns, zip_with(places, gets, (x, y) -> x - y) as places))) as t"
        ).select("t.*")
        if level in (5, 11):  # enough nodes to share out
            tree = tree.repartition("path")
    return tree.select(F.col("path").alias("part"), F.col("places").alias("take"))


def uniform_shards(
    df: DataFrame, shards: int, key: list[str] | None = None, rows_per_partition: int = 1024, seed: int = 17,
    shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """``df`` with a shard (0 to shards-1) and a gapless slot in it, a uniform shuffle.

    Shard sizes differ by one at most. ``key`` names the columns whose values
    randomise a row (default: all); rows equal in them all are interchangeable.
    Nulls are ordinary values; an empty table gives an empty table; helper columns get names that
    df doesn't have. Existing columns named ``shard_col``/``slot_col`` are replaced.
    """
    df = df.drop(shard_col, slot_col)
    own = "_hg"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    cols = [F.col(f"`{c}`") for c in (key or df.columns)]
    levels = max(10, min(22, (max(1, df.count() // rows_per_partition)).bit_length()))
    hashed: Column = F.xxhash64(F.lit(seed), *cols)
    base = df.withColumn(f"{own}_part", F.pmod(hashed, F.lit(1 << levels)))
    counts = base.groupBy(F.col(f"{own}_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    take = communication_matrix(counts, shards, levels, seed).select(
        F.col("part").alias(f"{own}_part"),
        F.expr(f"transform(sequence(1, size(take)), i -> aggregate(slice(take, 1, i), 0L, (x, y) -> x + y)) as {own}_ends"),
    )
    ranked = base.withColumn(f"{own}_rank", F.row_number().over(Window.partitionBy(f"{own}_part").orderBy(F.xxhash64(F.lit(seed + 1), *cols), *cols)))
    sent = ranked.join(take.hint("merge"), f"{own}_part").withColumn(shard_col, F.expr(f"size(filter({own}_ends, x -> x < {own}_rank))"))
    pieces = max(1, (1 << levels) // shards)
    sent = sent.drop(f"{own}_part", f"{own}_ends", f"{own}_rank").withColumn(f"{own}_key", F.xxhash64(F.lit(seed + 2), *cols))
    sent = sent.withColumn(f"{own}_piece", F.pmod(F.shiftrightunsigned(f"{own}_key", 3), F.lit(pieces)))
    sent = written(sent, "sharding")  # read twice below: counted, then ranked
    by_piece = [F.col(shard_col), F.col(f"{own}_piece")]
    offsets = (
        sent.groupBy(*by_piece).agg(F.count(F.lit(1)).alias("n"))
        .select(*by_piece, (F.sum("n").over(Window.partitionBy(shard_col).orderBy(f"{own}_piece")) - F.col("n")).alias(f"{own}_before"))
    )
    local = sent.withColumn(f"{own}_rank", F.row_number().over(Window.partitionBy(*by_piece).orderBy(f"{own}_key", *cols)))
    out = local.join(offsets.hint("merge"), [shard_col, f"{own}_piece"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(shard_col), (F.col(f"{own}_before") + F.col(f"{own}_rank") - 1).alias(slot_col))


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write each shard as files of its own, whose names ascend with the slots that they hold.

    A shard is cut into ``files_per_shard`` ranges of slots, a task each, so no task holds a whole shard of a large corpus.
    """
    last = sharded.groupBy(shard_col).agg((F.max(slot_col) + 1).alias("_n"))  # a row for each shard
    piece = F.floor(F.col(slot_col) * files_per_shard / F.col("_n"))
    shards = max(1, last.count())
    placed = sharded.join(F.broadcast(last), shard_col).withColumn("_piece", piece).drop("_n")
    placed = placed.repartitionByRange(shards * files_per_shard, shard_col, "_piece").sortWithinPartitions(shard_col, slot_col)
    placed.drop("_piece").write.partitionBy(shard_col).parquet(path)
