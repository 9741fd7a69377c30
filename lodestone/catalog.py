"""Every query of the engine itself, with the SQL that checks it.

A query reads whole tables. Its SQL says the same in another engine's words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import cases
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import fusion, profile, selection, text_units
from lodestone.session import table

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FLAGSHIP = "profile_orders_columns"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.schema_rows({t: table(spark, sf_dir, t) for t in TABLES})


def _words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    rows = []
    for i, (c, kind) in enumerate(columns):
        n = f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), round(CAST(avg({c}) AS DOUBLE), 4)" if kind in ("integer", "number") else "NULL, NULL, NULL"
        t = f"CAST(min(length({c})) AS INTEGER), CAST(max(length({c})) AS INTEGER)" if kind == "string" else "NULL, NULL"
        rows.append(f"SELECT '{name}', CAST({i} AS INTEGER), '{c}', '{kind}', count(*), count(*) FILTER (WHERE {c} IS NULL), least(count(DISTINCT {c}), 257), count(DISTINCT {c}) > 256, {n}, {t} FROM {name}")
    names = "source, position, \"column\", type, seen, nulls, n_distinct, distinct_overflow, num_min, num_max, num_avg, len_min, len_max"
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) AS p({names})"


_ORDERS = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "number"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")]
_LINEITEM = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime")]


@query(_profile_sql("orders", _ORDERS))
def profile_orders_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "orders"), "orders")


@query(_profile_sql("lineitem", _LINEITEM))
def profile_lineitem_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "lineitem"), "lineitem")


_KIND_SQL = "CASE WHEN data_type IN ('BIGINT','INTEGER','SMALLINT','TINYINT') THEN 'integer' WHEN data_type IN ('DOUBLE','FLOAT') OR data_type LIKE 'DECIMAL%' THEN CASE WHEN data_type LIKE '%[]' THEN 'array' ELSE 'number' END WHEN data_type LIKE '%[]' THEN 'array' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type = 'DATE' THEN 'date' ELSE 'string' END"
_SCHEMA_SQL = f"s AS (SELECT table_name AS source, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS \"column\", {_KIND_SQL} AS type FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}))"
_TOKENS_SQL = "regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[a-z0-9]+')"
_CONCEPT_SQL = (
    f"c1 AS (SELECT *, {_TOKENS_SQL.format(c='\"column\"')} AS t0 FROM s), "
    f"c2 AS (SELECT * EXCLUDE t0, CASE WHEN len(t0) > 1 AND list_contains({_words(V.ACTION_PREFIXES)}, t0[1]) THEN t0[2:] ELSE t0 END AS t1 FROM c1), "
    f"c3 AS (SELECT * EXCLUDE t1, CASE WHEN len(t1) > 1 AND list_contains({_words(V.MEASUREMENT_SUFFIXES)}, t1[-1]) THEN t1[:-2] ELSE t1 END AS tokens FROM c2)"
)
_ELIGIBLE_SQL = (
    f"i1 AS (SELECT *, list_filter(tokens, lambda x: NOT list_contains({_words(V.COMMON_WORDS)}, x)) AS m FROM c3), "
    "i2 AS (SELECT source, \"column\", type, array_to_string(tokens, ' ') AS canonical, CASE WHEN len(m) = 0 THEN len(tokens) >= 2 AND tokens[-1] = 'id' AND len(list_filter(tokens[:-2], lambda x: length(x) >= 3)) > 0 "
    "WHEN len(m) = 1 THEN length(m[1]) >= 6 AND NOT regexp_full_match(m[1], '[0-9]+') ELSE len(list_filter(m, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+'))) >= 2 END AS eligible FROM i1)"
)


@query(f"WITH {_SCHEMA_SQL} SELECT * FROM s")
def table_column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from tables to their columns, from schemas alone."""
    return _schema(spark, sf_dir)


@query(f"WITH {_SCHEMA_SQL}, {_CONCEPT_SQL}, {_ELIGIBLE_SQL} SELECT source, \"column\", canonical, eligible FROM i2")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.identifiers(_schema(spark, sf_dir))


@query(
    f"WITH {_SCHEMA_SQL.replace('s AS (', 's0 AS (')}, s AS (SELECT source, position, regexp_replace(\"column\", '^[a-z]{{1,2}}_', '') AS \"column\", type FROM s0), {_CONCEPT_SQL}, {_ELIGIBLE_SQL}, b AS (SELECT source, canonical, min(\"column\") AS \"column\" FROM i2 WHERE eligible GROUP BY source, canonical), "
    "k AS (SELECT canonical, min(source) AS anchor_source, arg_min(\"column\", source) AS anchor_column FROM b GROUP BY canonical HAVING count(*) >= 2 AND count(*) <= greatest(4, floor(0.75 * (SELECT count(DISTINCT source) FROM s)))) "
    f"SELECT canonical, source, \"column\", anchor_source, anchor_column, CASE WHEN array_to_string({_TOKENS_SQL.format(c='\"column\"')}, ' ') = canonical THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence FROM b JOIN k USING (canonical) WHERE source <> anchor_source"
)
def identifier_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without the short prefixes of their tables, as names that several tables share."""
    bare = _schema(spark, sf_dir).withColumn("column", F.regexp_replace("column", "^[a-z]{1,2}_", ""))
    return fusion.identifier_correspondence(bare)


_FIELDS_SQL = (
    f"{_SCHEMA_SQL}, {_CONCEPT_SQL}, f1 AS (SELECT source, array_to_string(tokens, ' ') AS field, type, len(list_filter(tokens, lambda x: NOT list_contains({_words(V.GENERIC_FIELD_WORDS)}, x) AND length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+'))) = 0 AS generic FROM c3 WHERE len(tokens) > 0), "
    "f2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source, field) AS n FROM f1) WHERE n = 1), f3 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source) AS size FROM f2) WHERE size >= 3), "
    "p AS (SELECT a.source AS \"left\", b.source AS \"right\", count(*) AS shared, count(*) FILTER (WHERE NOT a.generic) AS telling, count(*) FILTER (WHERE a.type = b.type OR (a.type IN ('integer','number') AND b.type IN ('integer','number'))) AS compatible, min(a.size) AS ls, min(b.size) AS rs FROM f3 a JOIN f3 b ON a.field = b.field AND a.source < b.source GROUP BY 1, 2), "
    "q AS (SELECT *, shared / (ls + rs - shared) AS j FROM p)"
)


@query(
    f"WITH {_FIELDS_SQL}, r AS (SELECT *, CASE WHEN telling < 3 THEN 'too-few-telling-fields' WHEN j < 0.75 THEN 'low-jaccard' WHEN compatible * 5 < shared * 4 THEN 'types-differ' ELSE 'accepted' END AS status FROM q) "
    "SELECT \"left\", \"right\", shared, telling, round(j, 6) AS jaccard, compatible, status, CASE WHEN status = 'accepted' THEN round(least(0.98, 0.8 + 0.18 * j), 6) END AS confidence FROM r"
)
def structural_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tables with a common field, accepted or with the reason it was not."""
    return fusion.structural_pairs(_schema(spark, sf_dir))


@query(f"WITH {_FIELDS_SQL} SELECT CASE WHEN telling < 3 THEN 'too-few-telling-fields' WHEN j < 0.75 THEN 'low-jaccard' WHEN compatible * 5 < shared * 4 THEN 'types-differ' ELSE 'accepted' END AS status, count(*) AS n FROM q GROUP BY 1")
def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.structural_pairs(_schema(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FIELDS_SQL} SELECT DISTINCT source FROM s WHERE source NOT IN (SELECT \"left\" FROM q UNION SELECT \"right\" FROM q)")
def orphan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _schema(spark, sf_dir)
    return fusion.orphans(s, fusion.structural_pairs(s).select("left", "right"))


@query(
    f"WITH {_SCHEMA_SQL}, {_CONCEPT_SQL}, {_ELIGIBLE_SQL} SELECT canonical, count(DISTINCT source) AS n_sources FROM i2 WHERE canonical <> '' GROUP BY canonical ORDER BY n_sources DESC, canonical LIMIT 2"
)
def concepts_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fusion.identifiers(_schema(spark, sf_dir)).where("canonical <> ''")
    return named.groupBy("canonical").agg(F.count_distinct("source").alias("n_sources")).orderBy(F.desc("n_sources"), "canonical").limit(2)


_FEW = ["o_orderstatus", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) <= 8 AND sum(DISTINCT 0) = 0 FROM orders) GROUP BY {c}" for c in _FEW))
def column_values_le8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.few_values(table(spark, sf_dir, "orders"), [*_FEW, "o_custkey"])


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_paths(table(spark, sf_dir, "events").withColumnRenamed("event_id", "record"), "props")


_PROPS_SQL = (
    "e AS (SELECT event_id, CAST(props AS JSON) AS j FROM events WHERE props IS NOT NULL), r AS (SELECT '$' AS path, 'object' AS type, CAST(NULL AS VARCHAR) AS value, NULL AS parent FROM e UNION ALL "
    "SELECT '$/' || k, CASE json_type(json_extract(j, '$.\"' || k || '\"')) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' ELSE 'array' END, json_extract_string(j, '$.\"' || k || '\"'), '$' FROM (SELECT j, unnest(json_keys(j)) AS k FROM e))"
)


@query(
    f"WITH {_PROPS_SQL}, g AS (SELECT path, any_value(parent) AS parent, count(*) AS seen, count(*) FILTER (WHERE type = 'null') AS nulls, string_agg(DISTINCT type, '|' ORDER BY type) AS types, least(count(DISTINCT value), 257) AS n_distinct FROM r GROUP BY path) "
    "SELECT g.path, g.seen, g.nulls, g.types, round(g.seen / coalesce(p.seen, g.seen), 6) AS presence, g.n_distinct FROM g LEFT JOIN g p ON g.parent = p.path"
)
def json_path_profile_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.path_profile(_props(spark, sf_dir))


_TYPE_SQL = (
    "CASE WHEN {t} IS NULL OR trim({t}) = '' OR lower(trim({t})) IN ('none', 'null') THEN 'null' WHEN lower(trim({t})) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(trim({t}), '" + V.INTEGER_RE + "') THEN 'integer' "
    "WHEN regexp_matches(trim({t}), '" + V.NUMBER_RE + "') THEN 'number' WHEN regexp_matches(trim({t}), '" + V.DATETIME_RE + "') AND try_cast(replace(trim({t}), 'T', ' ') AS TIMESTAMP) IS NOT NULL THEN 'datetime' "
    "WHEN regexp_matches(trim({t}), '" + V.DATE_RE + "') AND try_cast(trim({t}) AS DATE) IS NOT NULL THEN 'date' WHEN regexp_matches(trim({t}), '" + V.TIME_RE + "') THEN 'time' ELSE 'string' END"
)


@query(f"WITH {_PROPS_SQL} SELECT path, {_TYPE_SQL.replace('{t}', 'value')} AS text_type, count(*) AS n FROM r WHERE path <> '$' GROUP BY 1, 2")
def type_counts_coerced_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _props(spark, sf_dir).where("path <> '$'")
    return leaves.groupBy("path", X.text_type(F.col("value")).alias("text_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, substr(sha256(concat_ws('', lpad(lower(to_hex(strlen('documents'))), 16, '0'), 'documents', lpad(lower(to_hex(strlen(CAST(doc_id AS VARCHAR)))), 16, '0'), CAST(doc_id AS VARCHAR), lpad(lower(to_hex(strlen(text))), 16, '0'), text)), 1, 32) AS unit_id FROM documents")
def unit_ids_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.framed_id(F.lit("documents"), F.col("doc_id").cast("string"), F.col("text")).alias("unit_id"))


_LINES_SQL = "l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, ls[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) AS u(i))"


@query(f"WITH {_LINES_SQL} SELECT doc_id, line, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, content FROM l")
def doc_lines_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_units.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"WITH {_LINES_SQL}, m AS (SELECT *, sum(CASE WHEN trim(content, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM l), p AS (SELECT doc_id, g, min(line) AS first_line, count(*) AS n_lines, string_agg(trim(content, ' '), ' ' ORDER BY line) AS content FROM m WHERE trim(content, ' ') <> '' GROUP BY doc_id, g) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS paragraph, first_line, n_lines, content FROM p"
)
def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_units.paragraphs(text_units.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(
    f"SELECT doc_id, regexp_matches(text, '{V.DEFINITION_RE}') AS definition, regexp_matches(text, '(?i){V.CAVEAT_RE.replace(chr(39), chr(39) * 2)}') AS caveat, "
    "substr(regexp_replace(text, '^\\s+', ''), 1, 2) IN ('1.', '1)', '- ', '* ') AS procedure, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents"
)
def doc_cues_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.prose_cues(t).alias("cues"), X.token_estimate(t).alias("tokens"), F.octet_length(t).alias("n_bytes")).select("doc_id", "cues.*", "tokens", "n_bytes")


_LINKS_SQL = "k AS (SELECT page_id, url, CAST(i - 1 AS INTEGER) AS at, hs[i] AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1) AS hs FROM pages) p, unnest(range(1, len(hs) + 1)) AS u(i))"


@query(f"WITH {_LINKS_SQL} SELECT * FROM k")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_units.html_links(table(spark, sf_dir, "pages"))


@query(r"SELECT page_id, regexp_extract(lower(url), '^(https?)://', 1) || '://' || regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), ':(80|443)$', '') || regexp_replace(CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END, '/+', '/', 'g') || regexp_extract(url, '(\?[^#]*)', 1) AS canonical, regexp_extract(lower(url), '^https?://[^/?#]*', 0) AS origin FROM pages")
def page_url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(u).alias("canonical"), X.url_origin(u).alias("origin"))


_HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"


@query(
    f"WITH x AS (SELECT page_id, regexp_extract_all(html, '{_HEADING}', 1) AS ls, regexp_extract_all(html, '{_HEADING}', 2) AS ts FROM pages), "
    "h AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS at, CAST(ls[i] AS INTEGER) AS level, trim(regexp_replace(regexp_replace(ts[i], '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM x, unnest(range(1, len(ls) + 1)) AS u(i)), "
    "p AS (SELECT a.page_id, a.at, list(b.title ORDER BY b.\"at\") AS path FROM h a JOIN h b ON a.page_id = b.page_id AND b.at <= a.at AND NOT EXISTS (SELECT 1 FROM h c WHERE c.page_id = a.page_id AND c.at > b.at AND c.at <= a.at AND c.level <= b.level) GROUP BY 1, 2) "
    "SELECT h.page_id, h.\"at\", h.level, h.title, p.path FROM h JOIN p ON h.page_id = p.page_id AND h.\"at\" = p.\"at\""
)
def page_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages with the headings above them: those that no later one of their level or a higher one closed."""
    return text_units.outline(text_units.html_headings(table(spark, sf_dir, "pages")), "page_id", "at", "level", "title")


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").cast("string").alias("ref"), F.concat(F.lit("customer:"), F.col("o_custkey")).alias("target"), F.lit("label").alias("kind"))


@query("SELECT 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS ref, 'customer:' || o_custkey AS target, CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN c_custkey IS NOT NULL THEN 'customer' END AS target_source, CAST(c_custkey AS VARCHAR) AS unit FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def literal_resolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("target"), F.lit("customer").alias("target_source"), F.col("c_custkey").cast("string").alias("unit"))
    return fusion.resolve(_refs(spark, sf_dir), ids)


@query("SELECT 'lineitem' AS source, CAST(l_partkey AS VARCHAR) AS ref, p_name AS target, CASE n WHEN 1 THEN 'resolved' ELSE 'ambiguous-target' END AS status, CASE n WHEN 1 THEN 'part' END AS target_source, CASE n WHEN 1 THEN u END AS unit FROM (SELECT DISTINCT l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN (SELECT p_name, count(*) AS n, min(CAST(p_partkey AS VARCHAR)) AS u FROM part GROUP BY p_name) USING (p_name)")
def literal_ambiguous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    refs = used.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("lineitem").alias("source"), F.col("l_partkey").cast("string").alias("ref"), F.col("p_name").alias("target"), F.lit("label").alias("kind")).where("target is not null").distinct()
    ids = part.select(F.col("p_name").alias("target"), F.lit("part").alias("target_source"), F.col("p_partkey").cast("string").alias("unit"))
    return fusion.resolve(refs, ids, rows=True)


@query(f"WITH {_LINKS_SQL} SELECT k.page_id, k.at, k.href FROM k WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = k.href)")
def literal_unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    refs = text_units.html_links(pages).select(F.col("page_id").cast("string").alias("source"), F.concat_ws("/", "page_id", "at").alias("ref"), F.col("href").alias("target"), F.lit("path").alias("kind"))
    ids = pages.select(F.col("url").alias("target"), F.col("page_id").cast("string").alias("target_source"), F.col("url").alias("unit"))
    open_ = fusion.resolve(refs, ids).where("status = 'unresolved'")
    return open_.select(F.split("ref", "/")[0].cast("long").alias("page_id"), F.split("ref", "/")[1].cast("int").alias("at"), F.col("target").alias("href"))


@query(
    f"WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT DISTINCT a.page_id AS u, b.page_id AS v FROM k a JOIN k b ON a.href = b.href AND a.page_id <> b.page_id), w(node, depth) AS (SELECT min(page_id), 0 FROM pages UNION SELECT e.v, w.depth + 1 FROM w JOIN e ON w.node = e.u WHERE w.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node"
)
def link_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within three steps of the first page, a step being any link that both pages hold."""
    pages = table(spark, sf_dir, "pages")
    return _pages_by_links(pages, text_units.html_links(pages))


def _pages_by_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    # a page steps to a link and from there to its pages, so a link's pages are never paired
    to_link = links.select(F.concat(F.lit("p"), "page_id").alias("u"), F.concat(F.lit("l"), "href").alias("v"))
    edges = to_link.union(to_link.select(F.col("v"), F.col("u")))
    start = pages.agg(F.min("page_id").alias("p")).select(F.concat(F.lit("p"), "p").alias("node"))
    return fusion.reach(edges, start, 6).where("node like 'p%'").select(F.expr("cast(substring(node, 2) as bigint)").alias("node"), (F.col("depth") / 2).cast("int").alias("depth"))


_HEAD = r"^\s*(?:[-*]\s+)?(`[^`]{1,64}`|[A-Za-z][A-Za-z0-9_.-]{0,63})\s*[=:]\s*"
_SCALAR = r"""^("(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|(?i:true|false)|[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))(?:\s+([A-Za-z%][A-Za-z0-9%/_-]{0,15}))?$"""
_NUMBER_SQL = (
    "CASE WHEN raw LIKE '-%' AND regexp_matches(raw, '[1-9]') THEN '-' ELSE '' END || CASE WHEN ltrim(regexp_extract(raw, '^[-+]?([0-9]*)', 1), '0') = '' THEN '0' ELSE ltrim(regexp_extract(raw, '^[-+]?([0-9]*)', 1), '0') END "
    "|| CASE WHEN rtrim(regexp_extract(raw, '[.]([0-9]*)$', 1), '0') = '' THEN '' ELSE '.' || rtrim(regexp_extract(raw, '[.]([0-9]*)$', 1), '0') END"
)
_FACTS_SQL = (
    f"l AS (SELECT source, unnest(string_split(regexp_replace(text, '([A-Za-z_]+ = \"[^\"\n]*\")', chr(10) || '\\1' || chr(10), 'g'), chr(10))) AS content FROM documents), a AS (SELECT source, trim(regexp_extract(content, '{_HEAD}', 1), '`') AS name, regexp_replace(regexp_replace(content, '{_HEAD}', ''), '\\s*[.;]?\\s*$', '') AS body FROM l WHERE regexp_matches(content, '{_HEAD}')), "
    f"b AS (SELECT source, name, regexp_extract(body, '{_SCALAR}', 1) AS raw, nullif(lower(regexp_extract(body, '{_SCALAR}', 2)), '') AS unit FROM a), "
    "c AS (SELECT source, name, unit, CASE WHEN raw LIKE '\"%' OR raw LIKE '''%' THEN 'string' WHEN lower(raw) IN ('true', 'false') THEN 'boolean' ELSE 'number' END AS value_type, "
    "CASE WHEN raw LIKE '\"%' THEN CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$') END WHEN raw LIKE '''%' THEN replace(raw[2:-2], '\\''', '''') WHEN lower(raw) IN ('true', 'false') THEN lower(raw) "
    f"ELSE {_NUMBER_SQL} END AS value FROM b WHERE raw <> ''), "
    f"t AS (SELECT *, list_filter({_TOKENS_SQL.format(c='name')}, lambda x: NOT list_contains({_words(V.FACT_KEY_STOPS)}, x)) AS tokens FROM c WHERE value IS NOT NULL), "
    "f AS (SELECT source, array_to_string(tokens, ' ') AS key, value_type, value, unit, len(tokens) >= 2 OR regexp_matches(name, '[._-]') AS qualified, "
    f"len(list_filter(tokens, lambda x: NOT list_contains({_words(V.COMMON_WORDS)}, x))) >= 2 AS telling, len(tokens) AS n FROM t WHERE len(tokens) > 0)"
)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # running text is parted around assignments, so that they stand on lines of their own; all of the text is read
    parted = F.regexp_replace("text", '([A-Za-z_]+ = "[^"\n]*")', "\n$1\n")
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split(parted, "\n")).alias("content"))
    return fusion.prose_facts(lines, "source")


@query(f"WITH {_FACTS_SQL} SELECT source, key, value_type, value, unit, qualified, count(*) AS n FROM f GROUP BY ALL")
def prose_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that lines of documents state."""
    return _facts(spark, sf_dir).groupBy("source", "key", "value_type", "value", "unit", "qualified").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_FACTS_SQL}, g AS (SELECT key, source, min(value_type) AS t, min(value) AS v, min(unit) AS u, max(qualified) AS q, max(telling) AS m FROM f WHERE n >= 2 GROUP BY key, source HAVING count(DISTINCT (value_type, value, unit)) = 1) "
    "SELECT a.key, a.source AS \"left\", b.source AS \"right\", a.v AS left_value, b.v AS right_value, a.t AS value_type, a.u AS unit, 'exact-qualified-specific-key' AS context FROM g a JOIN g b ON a.key = b.key AND a.t = b.t AND a.u IS NOT DISTINCT FROM b.u AND a.source < b.source AND a.v <> b.v WHERE a.q AND b.q AND a.m"
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents that state one fact differently."""
    return fusion.contradictions(_facts(spark, sf_dir))


@query("SELECT doc_id, source, round FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS INTEGER) AS round, (SELECT greatest(4, least(16, 48 // count(DISTINCT source))) FROM documents) AS cap FROM documents) WHERE round <= cap")
def semantic_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents of each source in rounds; the cap is the feature."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count_distinct("source")).first()[0]
    return selection.semantic_rounds(docs, "source", [F.desc(F.length("text")), F.col("doc_id")], n).select("doc_id", "source", "round")


_SIZE_SQL = "SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM documents"


@query(f"SELECT * FROM ({_SIZE_SQL}) WHERE used <= 48000")
def prefix_budget_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    return selection.prefix_budget(docs, "source", [F.col("doc_id")], F.col("n_bytes"), V.DETAIL_PROFILES["deep"][0])


@query(f"SELECT source, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM ({_SIZE_SQL}) WHERE used > 48000 GROUP BY source")
def dropped_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    kept = selection.prefix_budget(docs, "source", [F.col("doc_id")], F.col("n_bytes"), V.DETAIL_PROFILES["deep"][0])
    return selection.drop_inventory(docs.join(kept.select("doc_id"), "doc_id", "left_anti"), "source", "doc_id")


@query("SELECT o_orderkey AS u, o_custkey AS v FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def induced_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("v"))
    left = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    right = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return edges.join(left, edges["u"] == left["k"], "left_semi").join(right, F.col("v") == right["k"], "left_semi")


@query(r"WITH c AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM conversations WHERE role = 'assistant'), e AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM conversations WHERE role <> 'assistant') SELECT * FROM c ANTI JOIN e USING (conv_id, word)")
def claim_unsupported_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return selection.unsupported_words(conv.where("role = 'assistant'"), conv.where("role <> 'assistant'"), "conv_id")


@query("SELECT event_id, regexp_extract_all('took ' || CAST(CAST(value AS INTEGER) AS VARCHAR) || ' ms, ' || event_type || ' 5% more', '([0-9]+(?:\\.[0-9]+)? ?(?:ms|sec|s|kb|mb|gb|hz|mbps|gbps|%))(?:[^A-Za-z0-9]|$)', 1) AS quantities FROM (SELECT event_id, floor(value) AS value, event_type FROM events)")
def measurement_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = F.concat(F.lit("took "), F.floor("value").cast("int").cast("string"), F.lit(" ms, "), F.col("event_type"), F.lit(" 5% more"))
    return table(spark, sf_dir, "events").select("event_id", X.quantities(sentence).alias("quantities"))


@query(f"WITH {_SCHEMA_SQL} SELECT source, position, CASE WHEN regexp_full_match(\"column\", '[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+') THEN [\"column\"] ELSE [] END AS found FROM s")
def snake_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("Column "), F.col("column"), F.lit(": "), F.col("type"), F.lit("."))
    return _schema(spark, sf_dir).select("source", "position", X.snake_identifiers(content).alias("found"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)")
def changed_files_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings made from all documents: some only in one, some with another text."""
    docs = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    before = docs.where("doc_id % 7 <> 0").select(path, F.sha2("text", 256).alias("hash"))
    now = docs.where("doc_id % 5 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return selection.merge_listing(before, now)


@query(
    "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g"
)
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, parted by half an hour of quiet."""
    events = table(spark, sf_dir, "events")
    grouped = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return grouped.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


@query(None)
def pr_metrics_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality as gold, long documents as prediction."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = labels.where("quality = 1").select(F.lit("quality").alias("task"), "doc_id")
    found = docs.where("n_chars > 1000").join(labels, "doc_id", "left_semi").select(F.lit("quality").alias("task"), "doc_id")
    return selection.precision_recall(gold, found, ["doc_id"])


_SQL["pr_metrics_wilson"] = (
    "WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND n_chars > 1000) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality <> 1 AND n_chars > 1000) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND n_chars <= 1000) AS BIGINT) AS fn FROM labels JOIN documents USING (doc_id)), d AS (SELECT *, tp / (tp + fp) AS r, tp + fp AS n, 1.959963984540054 AS z FROM c) "
    "SELECT 'quality' AS task, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((r + z*z/(2*n) - z * sqrt(r*(1-r)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS precision_low, round((r + z*z/(2*n) + z * sqrt(r*(1-r)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS precision_high FROM d"
)


@query("SELECT gold, predicted, count(*) AS n FROM (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS gold, CASE WHEN n_chars > 1000 THEN 'good' ELSE 'poor' END AS predicted FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def role_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    good = lambda c: F.when(c, "good").otherwise("poor")
    return rows.groupBy(good(F.col("quality") == 1).alias("gold"), good(F.col("n_chars") > 1000).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 40 AS u, (o_custkey * 7 + 3) % 40 AS v FROM orders), w AS (SELECT u AS root, v AS last, [u, v] AS path FROM e WHERE u < v UNION ALL SELECT w.root, e.v, list_append(w.path, e.v) FROM w JOIN e ON w.last = e.u WHERE len(w.path) <= 8 AND w.last <> w.root AND (e.v = w.root OR (e.v > w.root AND NOT list_contains(w.path, e.v)))) "
    "SELECT path[:-2] AS cycle, CAST(len(path) - 1 AS INTEGER) AS length FROM w WHERE last = root UNION ALL SELECT [u], 1 FROM e WHERE u = v"
)
def cycle_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles in a dependency graph made from all orders, folded to 40 nodes."""
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("u"), ((F.col("o_custkey") * 7 + 3) % 40).alias("v")).distinct()
    return fusion.cycles(e)


@query(
    "WITH RECURSIVE d AS (SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS n_bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), "
    "r AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, false AS ok FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT d.source, d.n, r.t + CASE WHEN d.n_bytes <= 16384 AND r.t + d.n_bytes <= 65536 THEN d.n_bytes ELSE 0 END, d.n_bytes <= 16384 AND r.t + d.n_bytes <= 65536 FROM r JOIN d ON d.source = r.source AND d.n = r.n + 1 WHERE d.n <= 2048) "
    "SELECT doc_id, d.source, n_bytes, CASE WHEN d.n > 2048 THEN 'declined-members' WHEN n_bytes > 16384 THEN 'declined-bytes' WHEN ok THEN 'admitted' ELSE 'declined-total' END AS status FROM d LEFT JOIN r ON r.source = d.source AND r.n = d.n"
)
def limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of collections (sources), admitted under limits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    return selection.admit(docs, "source", [F.col("doc_id")], "n_bytes", 2048, 16_384, 65_536)


@query(
    f"WITH {_SCHEMA_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS seen, \"column\", n FROM (UNPIVOT (SELECT count(COLUMNS(*)) AS \"\\0\" FROM {t}) ON COLUMNS(*) INTO NAME \"column\" VALUE n)" for t in TABLES)
    + ") SELECT c.source, c.\"column\", type, seen, seen - n AS nulls FROM c JOIN s ON c.source = s.source AND c.\"column\" = s.\"column\""
)
def profile_all_tables_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen and null counts of every column of every table."""
    parts = [profile.column_profile(table(spark, sf_dir, t), t, exact_distinct=False).select("source", "column", "type", "seen", "nulls") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


_QUERIES.update(cases.QUERIES)
_SQL.update(cases.SQL)
