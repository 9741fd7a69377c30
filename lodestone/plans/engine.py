"""From files to an answer: acquire, fuse, select, render."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import fusion, selection
from lodestone.sources import files, formats


class Evidence:
    """A collection as tables: ``sources``, ``units``, ``relations`` and ``gaps``."""

    def __init__(self, sources: DataFrame, units: DataFrame, relations: DataFrame | None = None):
        self.sources = sources
        self.units = units.where("modality <> 'gap'")
        self.gaps = units.where("modality = 'gap'").select("source", "content", "ref")
        self.relations = containment(self.units) if relations is None else relations


def containment(units: DataFrame) -> DataFrame:
    """``describes`` edges from a unit to the ones it contains."""
    u = units.select("source", F.col("ref").alias("parent"), F.col("unit_id").alias("src"))
    return units.select("source", "parent", F.col("unit_id").alias("dst")).join(u, ["source", "parent"]).select("src", "dst", F.lit("describes").alias("kind"), F.lit(1.0).alias("confidence"))


def acquire(
    spark: SparkSession, path: str | list[str], extra: dict[str, Callable] | None = None, most_files: int | None = None, most_each: int | None = None, most_total: int | None = None,
    connectors: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None,
) -> Evidence:
    """Read all files below some paths, archives included.

    A path given twice, or one that holds another, is an error. ``extra`` registers readers of further kinds (E1) and
    ``connectors`` what reads ``scheme:rest`` as (source, content) rows (A15, E2); both are named explicitly, never discovered.
    ``most_*`` are limits of admission in the order of names: what they decline is a source with a reason (A13). A database with a
    non-empty side file of unfinished writes is declined and not read (A16).
    """
    formats.READERS.update(extra or {})
    paths = [path] if isinstance(path, str) else list(path)
    own = [p.rstrip("/") for p in paths]
    if any(i != k and (a == b or a.startswith(f"{b}/")) for i, a in enumerate(own) for k, b in enumerate(own)):
        raise ValueError("a source is given twice")
    parts = []
    for p in paths:
        scheme = p.split(":", 1)[0]
        if connectors and scheme in connectors:
            rows = connectors[scheme](spark, p).select("source", F.length("content").cast("long").alias("bytes"), "content")
            parts.append(rows.withColumn("sha256", F.sha2("content", 256)))
        else:
            parts.append(files.scan(spark, p))
    found = reduce(DataFrame.unionByName, parts).withColumn("kind", files.kind_of(F.col("source"), F.col("content")))
    reason = F.lit(None).cast("string")
    if most_files or most_each or most_total:
        none = 1 << 62
        listed = selection.admit(found.select("source", "bytes").withColumn("_c", F.lit(0)), "_c", [F.col("source")], "bytes", most_files or (1 << 31) - 1, most_each or none, most_total or none)
        found = found.join(listed.select("source", F.nullif("status", F.lit("admitted")).alias("declined")), "source", "left")
        reason = F.col("declined")
    dirty = files.unclean_databases(found.select("source", "bytes")).withColumn("dirty", F.lit(True))
    found = found.join(dirty, "source", "left").withColumn("reason", F.coalesce(reason, F.when(F.col("dirty"), "unclean-database")))
    held = found.where("reason is not null").select("source", "bytes", "sha256", "kind", F.lit("declined").alias("status"), "reason")
    found = found.where("reason is null").select("source", "bytes", "content", "sha256", "kind")
    inner = files.members(found.where("kind in ('zip', 'tar', 'gzip')"))
    opened = inner.where("reason is null").select("source", "bytes", "content", "sha256").withColumn("kind", files.kind_of(F.col("source"), F.col("content")))
    plain = found.where("kind not in ('zip', 'tar', 'gzip')").unionByName(opened)
    units = formats.extract(plain).withColumn("unit_id", X.framed_id(F.col("source"), F.col("ref"), F.col("modality"), F.col("content")))
    declined = inner.where("reason is not null").select("source", "bytes", "sha256", F.lit(None).cast("string").alias("kind"), F.lit("declined").alias("status"), "reason")
    ok = plain.select("source", "bytes", "sha256", "kind", F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("reason"))
    return Evidence(ok.unionByName(declined).unionByName(held), units)


def references(evidence: Evidence) -> DataFrame:
    """Every literal reference of a collection with its outcome."""
    meta = lambda key: F.get_json_object("meta", f"$.{key}")
    u = evidence.units
    refs = u.where("modality = 'reference'").select("source", "ref", F.coalesce(meta("target"), F.col("content")).alias("target"), F.coalesce(meta("ref_kind"), F.lit("unknown")).alias("kind")).distinct()
    labels = u.select("source", "unit_id", F.explode(F.from_json(meta("labels"), "array<string>")).alias("label"))
    named = labels.select(F.concat(F.lit("label:"), "label").alias("key"), F.col("source").alias("target_source"), F.col("unit_id").alias("unit"))
    return fusion.resolve_references(refs, fusion.source_identities(evidence.sources.where("status = 'extracted'")).unionByName(named))


def analyze(evidence: Evidence) -> dict[str, DataFrame]:
    """All signals across sources: ``matches`` (signal, left, right, confidence), ``references`` and ``contradictions``.

    References, shared identifiers and alike tables first; facts contradict where those relate their sources, or where their keys say enough.
    """
    meta = lambda key: F.get_json_object("meta", f"$.{key}")
    u = evidence.units
    met = references(evidence)
    literal = met.where("status = 'resolved'").select(F.lit("literal").alias("signal"), F.col("source").alias("left"), F.col("target_source").alias("right"), "confidence").distinct()
    named = u.where("modality = 'schema'").select("source", F.coalesce(meta("name"), X.last_segment(meta("schema_path"))).alias("column"), F.lit("string").alias("type")).where("column is not null").distinct()
    n_sources = evidence.sources.where("status = 'extracted'").select(F.count_distinct("source"))
    shared = fusion.identifier_matches(u, n_sources).select(F.lit("identifier").alias("signal"), "left", "right", "confidence")
    alike = fusion.structural_pairs(named).where("status = 'accepted'").select(F.lit("structural").alias("signal"), "left", "right", "confidence")
    matches = literal.unionByName(shared).unionByName(alike)
    prose = u.where("modality = 'prose'").select("source", F.explode(F.split("content", "\n")).alias("content"))
    facts = fusion.prose_facts(prose, "source").unionByName(fusion.constant_facts(u))
    return {"matches": matches, "references": met, "contradictions": fusion.contradictions(facts, matches.select("left", "right"))}


def fuse(evidence: Evidence) -> DataFrame:
    """(signal, left, right, confidence): references, shared identifiers and alike tables across sources.

    What is shipped (P5): of identifiers those that both sources name themselves (mentions in content have a confidence of 0.82), and no contradictions; :func:`analyze` has all.
    """
    return analyze(evidence)["matches"].where("signal <> 'identifier' or confidence >= 0.9")


def open_references(evidence: Evidence) -> DataFrame:
    """References that nothing resolves and that are reported (P5, J2): local paths that no source has."""
    return references(evidence).where("branch = 'path' and status = 'unresolved'").select("source", "ref", "target")


def statements(evidence: Evidence, fused: DataFrame) -> DataFrame:
    """Three sentences about a collection, from counts alone (M3)."""
    n = evidence.sources.agg(F.count(F.lit(1)).alias("s"), F.count_distinct("kind").alias("k"))
    r = fused.agg(F.count_if(F.col("signal") == "literal").alias("l"), F.count_if(F.col("signal") == "identifier").alias("i"), F.count_if(F.col("signal") == "structural").alias("t"))
    g = evidence.gaps.agg(F.count(F.lit(1)).alias("g"))
    row = n.join(F.broadcast(r)).join(F.broadcast(g))  # one row each
    return row.select(F.explode(F.array(
        F.format_string("The collection has %d source(s) of %d kind(s).", "s", "k"), F.format_string("It has %d literal, %d identifier and %d structural relation(s).", "l", "i", "t"), F.format_string("%d gap(s) are reported.", "g"),
    )).alias("content"))


def evidence_pack(units: DataFrame, collection: str, budget: int, most: int = 48) -> DataFrame:
    """Units that fit a byte budget, tried in rounds over the sources, a unit that doesn't fit being passed over.

    (collection, unit_id, place, used). A collection's candidates are first cut to the rounds that
    can matter, so a fold sees a bounded number of rows.
    """
    per = Window.partitionBy(collection, "source").orderBy(F.desc("salience"), "seq")
    ranked = units.withColumn("round", F.row_number().over(per)).where(F.col("round") <= 16)
    order = Window.partitionBy(collection).orderBy("round", F.desc("salience"), "source", "seq")
    ranked = ranked.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= 4096)
    sized = ranked.select(F.col(collection).alias("collection"), "turn", "unit_id", (F.octet_length("content") + F.octet_length("ref") + F.octet_length("source") + 64).alias("size"))

    def fold(t: pa.Table) -> pa.Table:
        used, out = 0, []
        for turn, c, unit, size in sorted(zip(t.column("turn").to_pylist(), t.column("collection").to_pylist(), t.column("unit_id").to_pylist(), t.column("size").to_pylist(), strict=True)):
            if len(out) < most and used + size <= budget:
                used += size
                out.append((c, unit, len(out), used))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"collection": pa.array(cols[0], pa.string()), "unit_id": pa.array(cols[1], pa.string()), "place": pa.array(cols[2], pa.int32()), "used": pa.array(cols[3], pa.int64())})

    return sized.groupBy("collection").applyInArrow(fold, "collection string, unit_id string, place int, used long")


def claim_policy(claims: DataFrame, units: DataFrame, most_bytes: int = 320) -> DataFrame:
    """``claims(claim, content, evidence)`` with the first reason to drop each, or null."""
    cited = claims.select("claim", F.explode("evidence").alias("unit_id")).join(units.select("unit_id", F.col("content").alias("said")), "unit_id", "left")
    found = cited.groupBy("claim").agg(F.count_if(F.col("said").isNull()).alias("missing"), F.array_distinct(F.flatten(F.collect_list(X.word_set(F.col("said"))))).alias("have"))
    number = lambda w: F.filter(w, lambda x: x.rlike("[0-9]"))
    out = claims.join(found, "claim", "left").withColumn("alone", F.row_number().over(Window.partitionBy("content").orderBy("claim")) == 1)
    reason = (
        F.when(F.size("evidence") < 1, "no-evidence").when(F.col("missing") > 0, "unknown-evidence").when((F.octet_length("content") > most_bytes) | F.col("content").contains("\n"), "form")
        .when(~F.col("alone"), "repeated").when(F.size(F.array_except(number(X.word_set(F.col("content"))), "have")) > 0, "unsupported-number")
    )
    return out.select("claim", "content", "evidence", reason.alias("reason"))


def render_jsonl(evidence: Evidence) -> DataFrame:
    """One JSON line for each unit (K2); write it with ``.write.text``."""
    return evidence.units.select(F.to_json(F.struct("unit_id", "source", "kind", "modality", "content", "ref", "salience", "parent")).alias("value"))


def render_markdown(units: DataFrame, detail: str = "standard") -> str:
    """The best units of a collection as Markdown (K3), within the detail's byte budget."""
    budget, _ = V.DETAIL_PROFILES[detail]
    out, used = [], 0
    for r in units.orderBy(F.desc("salience"), "source", "seq").limit(512).toLocalIterator():
        line = f"- {r['content']} — `{r['source']}#{r['ref']}`\n"
        if used + len(line.encode()) > budget:
            continue
        out.append(line)
        used += len(line.encode())
    return "".join(out)


def from_records(spark: SparkSession, rows: Iterator[tuple[str, str, bytes]]) -> Evidence:
    """A collection from (source, kind, content) at hand (A3)."""
    df = spark.createDataFrame([(s, k, bytearray(c)) for s, k, c in rows], "source string, kind string, content binary")
    units = formats.extract(df).withColumn("unit_id", X.framed_id(F.col("source"), F.col("ref"), F.col("modality"), F.col("content")))
    return Evidence(df.select("source", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "kind", F.lit("extracted").alias("status")), units)
