"""Lines, paragraphs and outlines of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

LEVELS = 6


def _running(sizes: Column) -> Column:
    """What the entries before each one of an array of sizes add up to.

    An array grows by copies, so sums run within blocks of about the root of n entries, and over the blocks.
    """
    before = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    width = F.ceil(F.sqrt(F.size(sizes))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(sizes), width), lambda at: F.slice(sizes, at, width))
    sums = F.transform(blocks, lambda block: before(block))
    shifted = lambda own: F.zip_with(own, F.slice(before(F.transform(own, lambda x: F.element_at(x, -1))), F.lit(1), F.size(own)), lambda x, head: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + head))
    return F.flatten(X.let(sums, shifted))


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content): lines in order, from 0."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "content"))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, content): lines with their first character's offset."""
    split = docs.select(key, F.split(F.col(text), "\n", -1).alias("_lines"))
    # lengths are summed up within the row, so no line moves, and by the JVM, which holds a row at a time
    starts = X.let(F.transform("_lines", lambda x: (F.length(x) + 1).cast("long")), _running)
    each = split.select(key, F.posexplode(F.arrays_zip(starts.alias("start"), F.col("_lines").alias("content"))).alias("line", "_at"))
    return each.select(key, "line", "_at.start", "_at.content")


def paragraphs(numbered: DataFrame, key: str) -> DataFrame:
    """(key, paragraph, first_line, n_lines, content): lines between blank ones, joined by spaces."""
    w = Window.partitionBy(key).orderBy("line")
    blank = F.trim("content") == ""
    marked = numbered.withColumn("group", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
    grouped = marked.groupBy(key, "group").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line", F.trim("content").alias("t")))).alias("parts"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("group")) - 1
    return grouped.select(key, number.alias("paragraph"), "first_line", "n_lines", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("content"))


def outline(blocks: DataFrame, key: str, at: str, level: str, title: str) -> DataFrame:
    """``blocks`` with ``path``, the headings above a block (a heading's own included).

    ``level`` is 1 to 6 for headings and null for others. A heading closes those of its level
    and below; that is, entry k of the path lives while no higher one is newer.
    """
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for k in range(1, LEVELS + 1):
        here = F.col(level) == k
        out = out.withColumn(f"_at{k}", F.max(F.when(here, F.col(at))).over(w)).withColumn(f"_h{k}", F.last(F.when(here, F.col(title)), ignorenulls=True).over(w))
    entries = []
    for k in range(1, LEVELS + 1):
        newer = [F.coalesce(F.col(f"_at{j}"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"_at{k}").isNotNull() & (F.col(f"_at{k}") > (F.greatest(F.lit(-1), *newer) if newer else F.lit(-1)))
        entries.append(F.when(alive, F.col(f"_h{k}")))
    return out.withColumn("path", F.array_compact(F.array(*entries))).drop(*[f"_{x}{k}" for k in range(1, LEVELS + 1) for x in ("at", "h")])


def html_headings(pages: DataFrame) -> DataFrame:
    """(page_id, at, level, title) of the h1 to h6 elements of pages, in order."""
    found = F.expr(r"regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)"), F.expr(r"regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)")
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(found[0].alias("level"), found[1].alias("title"))).alias("at", "h"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("h.title", "<[^>]*>", ""), r"\s+", " "))
    return rows.select("page_id", "at", F.col("h.level").cast("int").alias("level"), plain.alias("title"))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, at, href): targets of anchors in order."""
    return pages.select("page_id", "url", F.posexplode(F.expr(r"regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1)")).alias("at", "href"))
