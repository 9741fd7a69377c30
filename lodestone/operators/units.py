"""Rules over units, relations, catalogs and gaps of a collection.

Null arguments of a predicate make it false. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

DETAIL_MODALITIES = ["code", "equation", "record", "table"]
EXACT_PHYSICAL_TYPES = ["BOOLEAN", "INT32", "INT64", "FLOAT", "DOUBLE"]


def is_semantic(modality: Column) -> Column:
    """Whether a unit says something itself."""
    return F.coalesce(~modality.isin("source", "reference"), F.lit(False))


def is_specific(modality: Column, content: Column, structure: Column) -> Column:
    """Whether a semantic unit is detail and no mere heading.

    Code, equations, records and tables are; a schema unit with a path; prose of six words that isn't its section's title.
    """
    title = F.lower(F.trim(F.regexp_replace(F.trim(content), "^#+", "")))
    heading = (F.size(structure) > 0) & (title == F.lower(F.trim(F.try_element_at(structure, F.lit(-1)))))
    words = F.size(F.regexp_extract_all(content, F.lit(r"(\S+)")))
    return F.coalesce(
        F.when(modality.isin(*DETAIL_MODALITIES), True).when(modality == "schema", F.size(structure) > 0).when(modality == "prose", ~F.coalesce(heading, F.lit(False)) & (words >= 6)).otherwise(True), F.lit(False)
    )


def range_is_semantic(physical: Column, logical: Column) -> Column:
    """Whether a column's least and greatest value mean something: numbers, dates, times, decimals; never texts."""
    low = F.lower(logical)
    return F.coalesce(F.upper(physical).isin(*EXACT_PHYSICAL_TYPES) | (low.rlike("date|time|decimal") & ~low.rlike("string|json|bson|uuid")), F.lit(False))


def salience_rank(units: DataFrame, cited: DataFrame, group: str) -> DataFrame:
    """``units(…, unit_id, seq, salience, confidence)`` with ``rank`` in their group: cited units in the order of claims, then by weight.

    ``cited(unit_id, place)``: a unit's first place counts. Then by descending salience, descending confidence and input order.
    """
    first = cited.groupBy("unit_id").agg(F.min("place").alias("_place"))
    order = [F.col("_place").asc_nulls_last(), F.desc("salience"), F.desc("confidence"), F.col("seq")]
    return units.join(first, "unit_id", "left").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).drop("_place")


def stable_ordinals(dropped: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Items with ``ordinal`` from 0 in their group."""
    return dropped.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def per_source(ranked: DataFrame, group: str, order: list[Column], most: int = 2) -> DataFrame:
    """The best ``most`` of each source of a group."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(group, "source").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def gap_supports(gaps: DataFrame, units: DataFrame, most: int = 2) -> DataFrame:
    """(source, ref, unit_id): units that stand exactly where a gap was found, the best first, at most two of a source."""
    met = gaps.select("source", "ref").distinct().join(units.where(is_semantic(F.col("modality"))), ["source", "ref"])
    return per_source(met.withColumn("_g", F.lit(0)), "_g", [F.desc("salience"), F.col("ref"), F.col("unit_id")], most).select("source", "ref", "unit_id")


def dangling(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Relations with an end that no unit is (J23): (src, dst, missing)."""
    ends = relations.select("src", "dst", F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(units.select(F.col("unit_id").alias("missing")).distinct(), "missing", "left_anti").select("src", "dst", "missing").distinct()


def timings(traces: DataFrame) -> DataFrame:
    """(key, total) of ``traces(key, seconds)``, summed as decimals so the order never matters."""
    return traces.groupBy("key").agg(F.sum(F.col("seconds").cast("decimal(38,9)")).alias("total"))


def dominant_size(spans: DataFrame, group: str) -> DataFrame:
    """(group, size): the font size with most text, the smaller of equals (G13); ``spans(group, size, text)``."""
    weighed = spans.groupBy(group, "size").agg(F.sum(F.length("text")).alias("n"))
    return weighed.groupBy(group).agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("least"))).alias("size"))


def catalog_counts(units: DataFrame, of: str = "kind") -> DataFrame:
    """(source, kind, n): how many tables, views, keys, formulas … a source has."""
    return units.groupBy("source", of).agg(F.count(F.lit(1)).alias("n"))


def conflicting_namespaces(named: DataFrame) -> DataFrame:
    """Names of ``named(canonical, namespace)`` that stand in several namespaces; a null one is none."""
    return named.groupBy("canonical").agg(F.sort_array(F.collect_set("namespace")).alias("namespaces")).where("size(namespaces) > 1")


def first_names(names: DataFrame, name: str, most: int) -> DataFrame:
    """(name, truncated): the ``most`` least distinct names; one more is asked for to see whether any was left out."""
    probe = names.select(F.col(name).alias("name")).where("name is not null").distinct().orderBy("name").limit(most + 1)
    more = probe.agg((F.count(F.lit(1)) > most).alias("truncated"))
    return probe.orderBy("name").limit(most).join(F.broadcast(more))  # one row


def unquoted(name: Column) -> Column:
    """A SQL identifier without its quotes, doubled ones inside undone."""
    inner = F.regexp_extract(name, r"^[\"`\[](.*)[\"`\]]$", 1)
    plain = F.regexp_replace(F.regexp_replace(inner, '""', '"'), "``", "`")
    return F.when(name.rlike(r'^(".*"|`.*`|\[.*\])$'), plain).otherwise(name)


def sql_dependencies(sql: Column) -> Column:
    """Names that stand after FROM and JOIN, in order, each once; comments and texts are left out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), "'(?:[^']|'')*'", "''")
    part = r'(?:"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|[A-Za-z_][A-Za-z0-9_$]*)'
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"(?i)\b(?:from|join)\s+({part}(?:\s*\.\s*{part})*)")))


def view_edges(views: DataFrame, tables: DataFrame) -> DataFrame:
    """(view, table, schema): what views read.

    ``views(schema, name, sql)`` and ``tables(schema, name)``. A qualified name must be that table; a bare one is the table of the view's own
    schema, else the only table of that name; names that several schemas have stay open.
    """
    split = F.transform(F.split(F.col("raw"), r"\s*\.\s*"), unquoted)
    each = views.select(F.col("schema").alias("home"), F.col("name").alias("view"), F.explode(sql_dependencies(F.col("sql"))).alias("raw")).withColumn("parts", split)
    each = each.select("home", "view", F.try_element_at("parts", F.lit(-1)).alias("table"), F.when(F.size("parts") > 1, F.try_element_at("parts", F.lit(-2))).alias("asked"))
    met = each.join(tables.select("schema", F.col("name").alias("table")).distinct(), "table").where("asked is null or asked = schema")
    found = met.groupBy("home", "view", "table", "asked").agg(F.max(F.col("schema") == F.col("home")).alias("own"), F.count(F.lit(1)).alias("n"), F.min("schema").alias("only"))
    schema = F.when(F.col("asked").isNotNull(), F.col("asked")).when(F.col("own"), F.col("home")).when(F.col("n") == 1, F.col("only"))
    return found.select("view", "table", schema.alias("schema")).where("schema is not null").distinct()


def key_members(keys: DataFrame, columns: DataFrame) -> DataFrame:
    """(table, key, place, column) of ``keys(table, key, members)``, for the columns that exist."""
    each = keys.select("table", "key", F.posexplode("members").alias("place", "column"))
    return each.join(columns.select("table", "column").distinct(), ["table", "column"], "left_semi").select("table", "key", "place", "column")


def foreign_keys(keys: DataFrame, primary: DataFrame) -> DataFrame:
    """(table, column, target, target_column) of ``keys(table, target, members, target_members)``.

    Without named target columns those of the target's primary key stand for them, place by place: ``primary(table, members)``.
    """
    own = primary.select(F.col("table").alias("target"), F.col("members").alias("own"))
    named = keys.join(own, "target", "left").withColumn("to", F.when(F.size(F.coalesce("target_members", F.array().cast("array<string>"))) > 0, F.col("target_members")).otherwise(F.col("own")))
    pairs = named.select("table", "target", F.explode(F.arrays_zip(F.col("members").alias("column"), F.col("to").alias("target_column"))).alias("p"))
    return pairs.select("table", "p.column", "target", "p.target_column").where("target_column is not null and column is not null")


def postings_with_all(postings: DataFrame, needles: DataFrame) -> DataFrame:
    """(canonical, unit): units whose postings hold all tokens of a name (J6); ``postings(token, unit)``, ``needles(canonical)``."""
    tokens = needles.select("canonical", F.array_distinct(F.split("canonical", " ")).alias("ts")).select("canonical", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    return postings.distinct().join(tokens, "token").groupBy("canonical", "unit", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n").select("canonical", "unit")


def holds_run(tokens: Column, needle: Column) -> Column:
    """Whether tokens hold a needle's tokens one after another (J7); an empty needle is nowhere."""
    return (F.size(needle) > 0) & (F.size(tokens) >= F.size(needle)) & F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(needle, " "), F.lit(" ")))


def related_pairs(matches: DataFrame) -> DataFrame:
    """Pairs of sources that any signal joins, each once, the lesser first."""
    return matches.where("left <> right").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def array_lengths(paths: DataFrame) -> DataFrame:
    """(path, least, most) of arrays in JSON paths (G4): ``paths(record, path, type)`` as of ``profile.json_paths``; places of one array count for it."""
    arrays = paths.where("type = 'array'").select("record", "path")
    items = paths.where("path like '%/*'").select("record", F.regexp_replace("path", r"/\*$", "").alias("path")).groupBy("record", "path").agg(F.count(F.lit(1)).alias("n"))
    counted = arrays.join(items, ["record", "path"], "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.groupBy("path").agg(F.min("n").alias("least"), F.max("n").alias("most"))


def role_scores(gold: DataFrame) -> DataFrame:
    """(role, support, precision, recall, f1) of ``gold(role, predicted)``, for every role that occurs."""
    roles = gold.select("role").union(gold.select("predicted")).where("role is not null").distinct()
    tp = gold.where("role = predicted").groupBy("role").agg(F.count(F.lit(1)).alias("tp"))
    has = gold.groupBy("role").agg(F.count(F.lit(1)).alias("support"))
    said = gold.where("predicted is not null").groupBy(F.col("predicted").alias("role")).agg(F.count(F.lit(1)).alias("said"))
    all_ = roles.join(tp, "role", "left").join(has, "role", "left").join(said, "role", "left").na.fill(0)
    n = {c: F.col(c).cast("double") for c in ("tp", "support", "said")}
    part = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return all_.select("role", "support", part(n["tp"], n["said"]).alias("precision"), part(n["tp"], n["support"]).alias("recall"), part(2 * n["tp"], n["said"] + n["support"]).alias("f1"))


def fallback_claims(units: DataFrame, group: str, most: int = 4) -> DataFrame:
    """What is said without a model (M7): the best specific units of a group, cut to 320 bytes, each its own evidence: (group, place, content, evidence)."""
    own = units.where(is_semantic(F.col("modality")) & is_specific(F.col("modality"), F.col("content"), F.col("structure")))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("salience"), "source", "ref", "unit_id")))
    return ranked.where(F.col("place") <= most).select(group, "place", X.bounded(X.one_space(F.col("content")), 160).alias("content"), F.array("unit_id").alias("evidence"))
