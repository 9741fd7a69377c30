"""Ranking, budgets, claims and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X


PARTS = 64


def _within_parts(units: DataFrame, group: str, measure: Column, order: list[Column], most: Column | int, rows: bool) -> DataFrame:
    """Rows of a running measure up to a bound in their part of their group, so that a large group is cut down by many tasks first."""
    dealt = units.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    w = Window.partitionBy(group, "_part").orderBy(*order)
    return dealt.withColumn("_m", measure.over(w.rowsBetween(Window.unboundedPreceding, 0) if rows else w)).where(F.col("_m") <= most).drop("_part", "_m")


def semantic_rounds(units: DataFrame, source: str, order: list[Column], n_sources: int) -> DataFrame:
    """``units`` with ``round`` per source, those beyond the cap left out (W9): cap = max(4, min(16, 48 // sources))."""
    cap = max(4, min(16, 48 // max(1, n_sources)))
    units = _within_parts(units, source, F.row_number(), order, cap, rows=False)
    return units.withColumn("round", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("round") <= cap)


def prefix_budget(units: DataFrame, group: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group whose summed size fits (W13), with ``used``; sizes are never below zero."""
    # in a part of a group, what stands behind the first row beyond the budget is beyond it in the group as well
    units = _within_parts(units, group, F.sum(size), order, F.lit(budget) + size, rows=True)
    return units.withColumn("used", F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept (P1): two semi-joins."""
    k = kept.select(F.col("node").alias("_k"))
    return edges.join(k, edges["u"] == k["_k"], "left_semi").join(k, F.col("v") == k["_k"], "left_semi")


def unsupported_words(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, claim words that no evidence of the key has)."""
    have = evidence.select(key, F.explode(X.word_set(F.col("text"))).alias("word")).distinct()
    said = claims.select(key, F.explode(X.word_set(F.col("text"))).alias("word")).distinct()
    return said.join(have, [key, "word"], "left_anti")


def admit(files: DataFrame, group: str, order: list[Column], size: str, most_files: int, most_each: int, most_total: int) -> DataFrame:
    """Admission under limits, in order (A13): each row with ``status``.

    A file beyond its own limit is declined and the next is tried; one that would pass the total is
    declined too, so admission is a fold, not a running sum. A group is folded in one task;
    groups are collections, whose number of files ``most_files`` bounds.
    """
    ranked = files.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    inside = ranked.where(F.col("_n") <= most_files)
    folded = inside.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(size).alias("s")))).alias("xs")).select(
        group,
        F.explode(
            F.expr(
                f"aggregate(xs, named_struct('t', 0L, 'out', cast(array() as array<struct<n:int,ok:boolean>>)), (a, x) -> named_struct("
                f"'t', a.t + if(x.s <= {most_each} and a.t + x.s <= {most_total}, x.s, 0L), "
                f"'out', concat(a.out, array(named_struct('n', x._n, 'ok', x.s <= {most_each} and a.t + x.s <= {most_total}))))).out"
            )
        ).alias("r"),
    ).select(group, F.col("r.n").alias("_n"), F.col("r.ok").alias("ok"))
    status = F.when(F.col("_n") > most_files, "declined-members").when(F.col(size) > most_each, "declined-bytes").when(F.col("ok"), "admitted").otherwise("declined-total")
    return ranked.join(folded, [group, "_n"], "left").withColumn("status", status).drop("_n", "ok")


def merge_listing(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of two listings of (path, hash): added, changed, unchanged or removed."""
    b, n = before.select("path", F.col("hash").alias("b")), now.select("path", F.col("hash").alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") == F.col("n"), "unchanged").otherwise("changed")
    return b.join(n, "path", "full").select("path", change.alias("change"))


def precision_recall(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """TP, FP, FN, precision, recall, F1 and Wilson bounds of two key tables, by ``task``."""
    g = gold.select("task", *keys).distinct().withColumn("g", F.lit(1))
    p = predicted.select("task", *keys).distinct().withColumn("p", F.lit(1))
    c = g.join(p, ["task", *keys], "full").groupBy("task").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    z = 1.959963984540054

    def wilson(n: Column, sign: int) -> Column:
        r = tp / n
        return F.round(F.when(n > 0, (r + z * z / (2 * n) + sign * z * F.sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6)

    return c.select(
        "task", "tp", "fp", "fn", F.round(F.when(tp + fp > 0, tp / (tp + fp)), 6).alias("precision"), F.round(F.when(tp + fn > 0, tp / (tp + fn)), 6).alias("recall"),
        F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)), 6).alias("f1"), wilson(F.when(tp + fp > 0, tp + fp), -1).alias("precision_low"), wilson(F.when(tp + fp > 0, tp + fp), 1).alias("precision_high"),
    )


def drop_inventory(dropped: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n, digest) of what was left out: a hash of the items in order."""
    return dropped.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), "\n"), 256).alias("digest"))
