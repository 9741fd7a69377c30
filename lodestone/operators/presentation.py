"""What is shown of a collection, and what is counted instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"brief": 0, "standard": 6, "deep": 24, "all": None}
SOURCES = {"brief": 8, "standard": 24, "deep": None, "all": None}


def presented_units(units: DataFrame, cited: DataFrame, order: list[Column], detail: str) -> DataFrame:
    """Cited units, and the best others as the detail allows."""
    marked = units.join(cited.select("unit_id").distinct().withColumn("_cited", F.lit(True)), "unit_id", "left")
    if UNITS[detail] is None:
        return marked.drop("_cited")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return marked.withColumn("_rank", rank).where(F.col("_cited") | (F.col("_rank") <= UNITS[detail])).drop("_rank", "_cited")


def presented_sources(sources: DataFrame, detail: str) -> DataFrame:
    """The first sources, those that could not be read before others."""
    ordered = sources.orderBy(F.col("status") == "extracted", "source")
    return ordered if SOURCES[detail] is None else ordered.limit(SOURCES[detail])


def capped(rows: DataFrame, group: str, order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of each group, and (group, suppressed) where some were left out."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    over = ranked.where(F.col("_rank") > most).groupBy(group).agg(F.count(F.lit(1)).alias("suppressed"))
    return ranked.where(F.col("_rank") <= most).drop("_rank"), over


def first_and_more(rows: DataFrame, group: str, value: str, most: int = 8) -> DataFrame:
    """(group, text): the first distinct values, then how many more there are."""
    ranked = rows.select(group, value).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(value)))
    kept = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.col(value)))).alias("xs"))
    text = F.array_join("xs", ", ")
    return kept.select(group, F.when(F.col("n") > most, F.concat(text, F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(text).alias("text"))


def unique_headers(headers: DataFrame) -> DataFrame:
    """``headers(source, position, name)`` with repeats numbered from two."""
    k = F.row_number().over(Window.partitionBy("source", "name").orderBy("position"))
    return headers.withColumn("name", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ["), k.cast("string"), F.lit("]"))))
