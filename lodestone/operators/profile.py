"""Profiles of columns and of JSON paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import values as V
from lodestone.session import written


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return "string"


def column_profile(df: DataFrame, source: str, exact_distinct: bool = True) -> DataFrame:
    """One row for each column, from one pass over the table.

    (source, position, column, type, seen, nulls, n_distinct, distinct_overflow, num_min, num_max,
    num_avg, len_min, len_max). Distinct values count to 256, then overflow is set and 257
    stands for more. Nested columns have no distinct count. With ``exact_distinct`` false a
    sketch counts them, which needs no shuffle of values at any size.
    """
    parts: list[Column] = []
    for i, f in enumerate(df.schema):
        c, kind = F.col(f"`{f.name}`"), _kind(f.dataType)
        numeric, text, flat = kind in ("integer", "number"), kind == "string", kind not in ("array", "object")
        finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if kind == "number" and not isinstance(f.dataType, T.DecimalType) else c
        distinct = F.approx_count_distinct(c) if flat and not exact_distinct else F.lit(None).cast("long")
        none = F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(source).alias("source"), F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(kind).alias("type"),
                F.count(F.lit(1)).alias("seen"), F.count_if(c.isNull()).alias("nulls"), distinct.alias("d"),
                (F.min(finite).cast("double") if numeric else none).alias("num_min"), (F.max(finite).cast("double") if numeric else none).alias("num_max"),
                (F.round(F.avg(finite.cast("decimal(28,6)")), 4).cast("double") if numeric else none).alias("num_avg"),
                (F.min(F.length(c)) if text else F.lit(None).cast("int")).alias("len_min"), (F.max(F.length(c)) if text else F.lit(None).cast("int")).alias("len_max"),
            )
        )
    wide = df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)])
    rows = wide.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(parts))])).alias("r")).select("r.*")
    if exact_distinct:
        rows = rows.drop("d").join(F.broadcast(_distinct(df, V.MAX_DISTINCT)), "position", "left")  # a row for each column
    d = F.col("d")
    return rows.select(
        "source", "position", "column", "type", "seen", "nulls", F.least(d, F.lit(V.MAX_DISTINCT + 1)).alias("n_distinct"), (d > V.MAX_DISTINCT).alias("distinct_overflow"),
        "num_min", "num_max", "num_avg", "len_min", "len_max",
    )


def _distinct(df: DataFrame, most: int) -> DataFrame:
    """(position, d): distinct values of each flat column, those beyond ``most`` counted as ``most`` + 1.

    Each partition keeps the least ``most`` + 1 hashes of a column's values, and so does what adds them up, so a column
    moves some hundred numbers for each partition however many values it has. Up to ``most`` the count is exact
    (64-bit hashes of so few values differ).
    """
    flat = [(i, f) for i, f in enumerate(df.schema) if _kind(f.dataType) not in ("array", "object")]
    if not flat:
        return df.sparkSession.createDataFrame([], "position int, d long")
    hashes = df.select(*[F.when(F.col(f"`{f.name}`").isNotNull(), F.xxhash64(F.lit(7), F.col(f"`{f.name}`"))).alias(f"_{i}") for i, f in flat])
    names = [f"_{i}" for i, _ in flat]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {n: np.zeros(0, np.int64) for n in names}
        for b in batches:
            for n, col in zip(names, b.columns, strict=True):
                kept[n] = np.unique(np.concatenate([kept[n], col.drop_null().to_numpy(zero_copy_only=False)]))[: most + 1]
        yield pa.RecordBatch.from_arrays([pa.array([int(n[1:]) for n in names], pa.int32()), pa.array([v.tolist() for v in kept.values()], pa.list_(pa.int64()))], names=["position", "least"])

    each = hashes.mapInArrow(least, "position int, least array<long>").select("position", F.explode("least").alias("h"))
    return each.groupBy("position").agg(F.least(F.count_distinct("h"), F.lit(most + 1)).alias("d"))


def schema_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(source, position, column, type) of several tables, from their schemas alone."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(s, i, f.name, _kind(f.dataType)) for s, df in frames.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "source string, position int, column string, type string")


def few_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of columns with at most 8 distinct values whose texts fit in 160 characters."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("r")
    counted = df.select(each).select("r.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counted.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum(F.length("value")).alias("chars")).where(f"d <= {V.MAX_SHOWN_VALUES} and chars <= {V.MAX_SHOWN_CHARS}")
    return counted.join(few.select("column"), "column", "left_semi")


def type_summary(types: Column) -> Column:
    """Types in their fixed order, ``integer`` within ``number``."""
    merged = F.when(F.array_contains(types, "number"), F.array_remove(types, "integer")).otherwise(types)
    return F.array_join(F.filter(F.array(*[F.lit(t) for t in V.TYPE_ORDER]), lambda t: F.array_contains(merged, t)), "|")


def json_paths(records: DataFrame, json: str, levels: int = 2) -> DataFrame:
    """Leaves and containers of JSON records: (record, path, type, value), to the last level.

    ``*`` stands for any place in an array. A text that is no JSON, or repeats a key, is the single
    path ``$`` of type ``invalid``. What lies below so many ``levels`` is written, and the walk goes on from there.
    """
    level = records.select("record", F.lit("$").alias("path"), F.try_parse_json(json).alias("v"), F.col(json).isNotNull().alias("given"))
    bad = level.where("v is null and given").select("record", "path", F.lit("invalid").alias("type"), F.lit(None).cast("string").alias("value"))
    level = level.where("v is not null").select("record", "path", "v")
    found = []
    while True:
        for _ in range(levels):
            kind = F.schema_of_variant("v")
            typed = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "BOOLEAN", "boolean").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number").when(kind == "VOID", "null").otherwise("string")
            scalar = F.when(typed.isin("object", "array", "null"), F.lit(None)).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
            found.append(level.select("record", "path", typed.alias("type"), scalar.alias("value")))
            level = level.sparkSession.sql(
                "select record, path || case when key is null then '/*' else '/' || replace(replace(key, '~', '~0'), '/', '~1') end as path, value as v "
                "from {nested}, lateral variant_explode(v)",
                nested=level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")),
            )
        level = written(level, "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, [bad, *found])


def path_profile(paths: DataFrame) -> DataFrame:
    """(path, seen, nulls, types, presence, n_distinct): presence is the share of parents that have the path."""
    own = paths.groupBy("path").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("type") == "null").alias("nulls"), type_summary(F.collect_set("type")).alias("types"), F.count_distinct("value").alias("n_distinct")
    )
    own = own.withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    parents = own.select(F.col("path").alias("parent"), F.col("seen").alias("of"))
    return own.join(parents, "parent", "left").select("path", "seen", "nulls", "types", F.round(F.col("seen") / F.coalesce("of", "seen"), 6).alias("presence"), F.least("n_distinct", F.lit(V.MAX_DISTINCT + 1)).alias("n_distinct"))
