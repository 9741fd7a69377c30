from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import fusion, profile, selection, text_units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    assert one(spark, X.identifier_tokens(F.lit("HTTPServerPort80"))) == ["http", "server", "port", "80"]
    assert one(spark, X.identifier_tokens(F.lit("get_tput_mbps"), True)) == ["throughput"]
    assert one(spark, X.identifier_tokens(F.lit("x" * 129))) == []
    assert one(spark, X.eligible_identifier(F.array(F.lit("run"), F.lit("id"))))
    assert not one(spark, X.eligible_identifier(F.array(F.lit("name"))))


def test_text_types(spark):
    given = {"": "null", "None": "null", "TRUE": "boolean", "-7": "integer", "007": "string", "1.50": "number", "2e3": "number", "2024-02-30": "string", "2024-02-28": "date", "12:30": "time", "2024-02-28T10:00:00Z": "datetime", "abc": "string"}
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "t string, kind string")
    assert [(r["t"], r["g"]) for r in df.withColumn("g", X.text_type(F.col("t"))).collect()] == list(given.items())


def test_urls(spark):
    given = {"HTTP://Example.COM:80/a/./b/../c?x=1#f": "http://example.com/a/c?x=1", "https://a.b": "https://a.b/", "ftp://a/b": None, "https://u:p@a/b": None, "http://a/b/": "http://a/b/"}
    df = spark.createDataFrame(list(given.items()), "u string, want string")
    assert {r["u"]: r["c"] for r in df.withColumn("c", X.canonical_url(F.col("u"))).collect()} == given


def test_outline(spark):
    rows = [(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, "p"), (1, 3, 3, "C"), (1, 4, 2, "D"), (1, 5, 1, "E"), (1, 6, 3, "F")]
    out = text_units.outline(spark.createDataFrame(rows, "k int, at int, level int, t string"), "k", "at", "level", "t")
    assert [r["path"] for r in out.orderBy("at").collect()] == [["A"], ["A", "B"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"]]


def test_resolution(spark):
    refs = spark.createDataFrame([("a", "1", "t1", "path"), ("a", "2", "t2", "path"), ("a", "3", "t3", "url"), ("a", "4", "t4", "path"), ("a", "5", "t5", "label")], "source string, ref string, target string, kind string")
    ids = spark.createDataFrame([("t1", "b", "u1"), ("t2", "b", "u2"), ("t2", "c", "u3"), ("t5", "a", "own"), ("t5", "b", "other")], "target string, target_source string, unit string")
    got = {r["ref"]: (r["status"], r["unit"]) for r in fusion.resolve(refs, ids).collect()}
    assert got == {"1": ("resolved", "u1"), "2": ("ambiguous-target", None), "3": ("external-reference", None), "4": ("unresolved", None), "5": ("resolved-intra-source", "own")}


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (3, 4)], "u int, v int")
    assert sorted(r["cycle"] for r in fusion.cycles(e).collect()) == [[1, 2, 3], [3]]


def test_long_cycles_and_deep_json(spark):
    e = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)] + [(3, 0), (5, 5)], "u int, v int")
    assert sorted(r["cycle"] for r in fusion.cycles(e).collect()) == [[0, 1, 2, 3], list(range(12)), [5]]
    deep = spark.createDataFrame([(1, '{"a":' * 20 + "7" + "}" * 20), (2, "3")], "record int, j string")
    got = {(r["record"], r["path"], r["type"], r["value"]) for r in profile.json_paths(deep, "j").collect()}
    assert got == {(1, "$" + "/a" * k, "object", None) for k in range(20)} | {(1, "$" + "/a" * 20, "integer", "7"), (2, "$", "integer", "3")}


def test_admission_skips_and_goes_on(spark):
    files = spark.createDataFrame([("c", i, n) for i, n in enumerate([50, 30, 200, 40, 10])], "c string, i int, n long")
    got = {r["i"]: r["status"] for r in selection.admit(files, "c", [F.col("i")], "n", 4, 100, 100).collect()}
    assert got == {0: "admitted", 1: "admitted", 2: "declined-bytes", 3: "declined-total", 4: "declined-members"}


def test_fact_conflicts(spark):
    lines = spark.createDataFrame([("a", "max_size = 3"), ("b", "max_size: 4"), ("c", "max_size = 3"), ("d", "max_size = 1"), ("d", "max_size = 2"), ("a", "not a fact")], "source string, content string")
    got = {(r["left"], r["right"]) for r in fusion.contradictions(fusion.prose_facts(lines, "source")).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_depths_over_all_links(spark):
    """Against brute force over every link of the pages, not only the first."""
    import re
    from collections import defaultdict

    import pyarrow.parquet as pq

    from lodestone import catalog

    sf = "/root/testdata/sf0.01"
    pages, holders = {}, defaultdict(set)
    for p in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        pages[p["page_id"]] = re.findall(r'(?i)<a [^>]*href="([^"]*)"', p["html"] or "")
        for href in pages[p["page_id"]]:
            holders[href].add(p["page_id"])
    want = {min(pages): 0}
    front = set(want)
    for depth in (1, 2, 3):
        front = {q for p in front for href in pages[p] for q in holders[href]} - set(want)
        want |= dict.fromkeys(front, depth)
    got = catalog.queries()["link_bfs_depth"](spark, sf).collect()
    assert {r["node"]: r["depth"] for r in got} == want and len(got) == len(want)


def most_rows(plan):
    """The most rows that any step of a finished plan made."""
    name = plan.getClass().getSimpleName()
    inner = [plan.finalPhysicalPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_references_never_meet_every_unit_of_their_key(spark):
    refs = spark.range(600).selectExpr("'a' as source", "cast(id as string) as ref", "'t' as target", "'label' as kind")
    ids = spark.range(500).selectExpr("'t' as target", "'b' as target_source", "cast(id as string) as unit")
    by_kind = fusion.resolve_references(refs, ids.selectExpr("concat('label:', target) as key", "target_source", "unit"))
    for out in (fusion.resolve(refs, ids), by_kind):
        rows = out.collect()
        assert len(rows) == 600 and {r["status"] for r in rows} == {"ambiguous-target"}
        assert most_rows(out._jdf.queryExecution().executedPlan()) <= 1200


def test_resolution_against_every_pair(spark):
    """References and identities of few values, with nulls and repeated rows, against a program that looks at every pair."""
    import random

    rng = random.Random(7)
    some = lambda values: rng.choice([*values, None])
    kinds = ["label", "path", "url"]
    for _ in range(3):
        refs = [(some("abc"), str(i // 2), some("stuvwxyz"), kinds[i // 2 % 3]) for i in range(160)]
        refs += refs[:20]
        ids = [(some("stuvw"), some("abcd"), some("123")) for _ in range(18)]
        want = []
        for source, ref, target, kind in refs:
            hits = {(s, u) for t, s, u in ids if t is not None and t == target and s is not None and source is not None}
            own, other = sorted((h for h in hits if h[0] == source), key=lambda h: h[1] or ""), [h for h in hits if h[0] != source]
            status, hit = ("resolved-intra-source", own[0]) if own and (not other or kind == "label") else ("resolved", other[0]) if len(other) == 1 else ("ambiguous-target", None) if other else ("unresolved" if kind != "url" else "external-reference", None)
            want.append((source, ref, target, status, *(hit or (None, None))))
        out = fusion.resolve(spark.createDataFrame(refs, "source string, ref string, target string, kind string"), spark.createDataFrame(ids, "target string, target_source string, unit string"))
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_lines_and_paragraphs_without_python_workers(spark, tmp_path):
    """Offsets of odd and long texts against Python's own split, by plans that hold one row at a time."""
    texts = ["", "\n", "a", "a\nb\n", "é\n\n  \nüß x\n y ", "\n".join("xy" * (i % 7) for i in range(5000)), "\n" * 4999, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    by_line = text_units.lines(docs, "doc_id", "text")
    want = []
    for k, t in enumerate(texts):
        at = 0
        for i, x in enumerate(t.split("\n") if t is not None else []):
            want.append((k, i, at, x))
            at += len(x) + 1
    assert sorted(map(tuple, by_line.collect())) == want
    found = text_units.paragraphs(text_units.numbered_lines(docs, "doc_id", "text"), "doc_id")
    got = [tuple(r) for r in found.where("doc_id < 5").orderBy("doc_id", "paragraph").collect()]
    assert got == [(2, 0, 0, 1, "a"), (3, 0, 0, 2, "a b"), (4, 0, 0, 1, "é"), (4, 1, 3, 2, "üß x y")]
    from lodestone import catalog

    for out in (by_line, found, *(catalog.queries()[q](spark, "/root/testdata/sf0.001") for q in ("doc_paragraphs", "doc_lines_offsets"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan
