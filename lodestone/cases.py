"""Queries over small tables of cases: every branch of a rule once, with the rows it must give.

The engine's other queries run over whole tables; rules about files, formats, catalogs and presentation have no
table there, so their cases are written down here. Expected rows are stated, not computed.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import cells, fusion, presentation, units
from lodestone.plans import budget, engine, extensions
from lodestone.session import shared_dir
from lodestone.sources import files, formats
from lodestone.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def case(columns: str, rows: list[tuple]):
    """Register a query of no arguments but the session, with its rows: ``columns`` are "name type, …" in SQL's words."""
    names, kinds = zip(*[c.split(" ", 1) for c in columns.split(", ")], strict=True)
    body = " UNION ALL ".join("SELECT " + ", ".join(f'CAST({_literal(v)} AS {k}) AS "{n}"' for n, k, v in zip(names, kinds, r, strict=True)) for r in rows)

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(spark).select(*[F.col(f"`{n}`") for n in names])
        SQL[name] = body
        return f

    return add


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _files(spark: SparkSession, given: dict[str, bytes]) -> DataFrame:
    return _rows(spark, "source string, content binary", [(k, bytearray(v)) for k, v in given.items()])


def _zip(members: dict[str, str | bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return b.getvalue()


def _read(spark: SparkSession, kind: str, data: bytes | str) -> DataFrame:
    content = data.encode() if isinstance(data, str) else data
    return formats.extract(_rows(spark, "source string, kind string, content binary", [("f", kind, bytearray(content))]))


# -- detection and archives


@case(
    "source VARCHAR, kind VARCHAR",
    [
        ("a.md", "markdown"), ("noext", "json"), ("page", "html"), ("feed", "xml"), ("plain", "text"), ("noise", "unknown"), ("p.txt", "parquet"), ("cut.parquet", "parquet"), ("cut.bin", "unknown"), ("arrow.bin", "arrow"), ("old.bin", "feather-v1"),
        ("orc.bin", "orc"), ("n.bin", "npy"), ("f.bin", "fits"), ("s.bin", "sqlite"), ("d.bin", "duckdb"), ("h.bin", "hdf5"), ("z.pdf", "pdf"), ("book.zip", "xlsx"), ("text.zip", "docx"), ("both.zip", "ambiguous"), ("some.zip", "zip"), ("x.TSV", "tsv"), ("y.rs", "code"),
    ],
)
def case_detection(spark: SparkSession) -> DataFrame:
    """Kinds by signature, member, ending and look, in that order."""
    given = {
        "a.md": b"# hi", "noext": b'{"a": 1}', "page": b"<!DOCTYPE html><p>", "feed": b"<?xml version='1.0'?><r/>", "plain": b"plain words", "noise": b"\0\1\2\xff", "p.txt": b"PAR1....PAR1", "cut.parquet": b"PAR1....", "cut.bin": b"PAR1\0\0..",
        "arrow.bin": b"ARROW1\0\0..ARROW1", "old.bin": b"FEA1....FEA1\0", "orc.bin": b"ORC.....ORC\x17", "n.bin": b"\x93NUMPY\x01\0", "f.bin": b"SIMPLE  =                    T", "s.bin": b"SQLite format 3\0....", "d.bin": b"\0" * 8 + b"DUCK" + b"\0" * 8,
        "h.bin": b"\x89HDF\r\n\x1a\n..", "z.pdf": b"%PDF-1.7", "book.zip": _zip({"xl/workbook.xml": "<w/>"}), "text.zip": _zip({"word/document.xml": "<w/>"}), "both.zip": _zip({"xl/workbook.xml": "<w/>", "word/document.xml": "<w/>"}), "some.zip": _zip({"a.txt": "a"}),
        "x.TSV": b"a\tb\n", "y.rs": b"fn main() {}",
    }
    return _files(spark, given).select("source", files.kind_of(F.col("source"), F.col("content")).alias("kind"))


@case("name VARCHAR, reason VARCHAR", [("", "empty"), ("/etc/x", "absolute"), ("C:x", "absolute"), ("a\\b", "backslash"), ("a/../b", "traversal"), ("..", "traversal"), ("a\tb", "control"), ("a/b.txt", None), ("a..b", None)])
def case_unsafe_members(spark: SparkSession) -> DataFrame:
    """Names of archive members that are refused, and why (P10)."""
    return _rows(spark, "name string", [(x,) for x in ("", "/etc/x", "C:x", "a\\b", "a/../b", "..", "a\tb", "a/b.txt", "a..b")]).select("name", files.unsafe_member(F.col("name")).alias("reason"))


@case(
    "source VARCHAR, bytes BIGINT, reason VARCHAR",
    [("o.zip!/../evil.txt", 1, "unsafe-member"), ("o.zip!/a.txt", 5, None), ("o.zip!/bomb.txt", 2_000_000, "limit"), ("o.zip!/in.zip!/deep.txt", 4, None), ("o.zip!/in.zip!/in.zip!/deeper.txt", 6, None), ("o.zip!/small.txt", 1000, None), ("t.tar!/l", 0, "unsafe-member"), ("t.tar!/m.txt", 3, None)],
)
def case_members(spark: SparkSession) -> DataFrame:
    """Members of nested ZIP and TAR files (A8 to A10, P11): a ratio above 200 counts beyond 1024 bytes only."""
    deep = _zip({"deep.txt": "deep", "in.zip": _zip({"deeper.txt": "deeper"})})
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
        own = tarfile.TarInfo("m.txt")
        own.size = 3
        t.addfile(own, io.BytesIO(b"abc"))
    given = {"o.zip": _zip({"a.txt": "hello", "../evil.txt": "x", "bomb.txt": b"0" * 2_000_000, "small.txt": b"0" * 1000, "in.zip": deep}), "t.tar": tar.getvalue()}
    return files.members(_files(spark, given)).select("source", "bytes", "reason")


@case("files BIGINT, bytes BIGINT, digest VARCHAR", [(2, 5, "d9fb0b2aa3cb4b3b2f3e7a3b4f9f1c1a")])
def case_manifest(spark: SparkSession) -> DataFrame:
    """Files, bytes and a digest over names and hashes in order."""
    return files.manifest(_rows(spark, "source string, bytes long, sha256 string", [("b", 2, "22"), ("a", 3, "11")]))


SQL["case_manifest"] = "SELECT CAST(2 AS BIGINT) AS files, CAST(5 AS BIGINT) AS bytes, sha256('a' || chr(9) || '11' || chr(10) || 'b' || chr(9) || '22') AS digest"


@case("source VARCHAR", [("a.db",), ("b.duckdb",), ("c.sqlite",)])
def case_unclean_databases(spark: SparkSession) -> DataFrame:
    """Databases with unfinished writes beside them (A16); an empty side file is harmless."""
    given = [("a.db", 9), ("a.db-wal", 1), ("b.duckdb", 9), ("b.duckdb.wal", 4), ("c.sqlite", 9), ("c.sqlite-journal", 4), ("d.db", 9), ("d.db-wal", 0), ("e.db", 9), ("gone.db-wal", 7)]
    return files.unclean_databases(_rows(spark, "source string, bytes long", given))


# -- readers: modality, content and weight of each unit


@case(
    "modality VARCHAR, content VARCHAR, salience DOUBLE, parent VARCHAR",
    [
        ("prose", "Study", 0.9, None), ("prose", "Some text wrapped, see [data](results.csv).", 0.5, "line:1"), ("reference", "results.csv", 0.3, "line:3"), ("prose", "Method", 0.8, "line:1"),
        ("code", "x = 1\n\ny = 2", 0.7, "line:6"), ("prose", "See https://a.b/c.", 0.5, "line:6"), ("reference", "https://a.b/c", 0.3, "line:12"), ("prose", "Deep", 0.4, "line:6"), ("prose", "Next", 0.9, None),
    ],
)
def case_markdown(spark: SparkSession) -> DataFrame:
    """Headings, wrapped paragraphs, fences and references of Markdown."""
    return _read(spark, "markdown", "# Study\n\nSome text\nwrapped, see [data](results.csv).\n\n## Method\n```py\nx = 1\n\ny = 2\n```\nSee https://a.b/c.\n\n###### Deep\n# Next\n")


@case("ref VARCHAR", [("$",), ("$/a",), ("$/a/*",), ("$/a/*/b",), ("$/c~1d",)])
def case_json_paths(spark: SparkSession) -> DataFrame:
    """Schema paths of JSON, escaped as pointers are."""
    return _read(spark, "json", '{"a": [{"b": 1}, {"b": 2.5}], "c/d": null}').where("modality <> 'gap'").select("ref")


@case("data VARCHAR, read BOOLEAN", [('{"a": 1, "a": 2}', False), ("[NaN]", False), ("[1e2]", True), ("[", False), ("null", True)])
def case_strict_json(spark: SparkSession) -> DataFrame:
    """JSON that repeats a key or holds no number is refused (X40); one bad file is a gap of its own."""
    given = ['{"a": 1, "a": 2}', "[NaN]", "[1e2]", "[", "null"]
    found = formats.extract(_rows(spark, "source string, kind string, content binary", [(x, "json", bytearray(x.encode())) for x in given]))
    return found.groupBy(F.col("source").alias("data")).agg((F.count_if(F.col("content").startswith("extraction-error")) == 0).alias("read"))


@case("kind VARCHAR, ref VARCHAR", [("jsonl", "$"), ("jsonl", "$/a"), ("toml", "$"), ("toml", "$/a"), ("toml", "$/t"), ("toml", "$/t/b"), ("xml", "/r"), ("xml", "/r/x"), ("xml", "/r/x/@k"), ("xml", "/r/x/#text")])
def case_record_paths(spark: SparkSession) -> DataFrame:
    """Schema paths of JSON lines, TOML and XML."""
    given = [("jsonl", '{"a": 1}\n\n{"a": "x"}\n'), ("toml", "a = 1\n[t]\nb = 'x'\n"), ("xml", "<r><x k='1'>t</x></r>")]
    rows = [("f", k, bytearray(d.encode())) for k, d in given]
    return formats.extract(_rows(spark, "source string, kind string, content binary", rows)).where("modality <> 'gap'").select("kind", "ref")


@case("modality VARCHAR, content VARCHAR", [("reference", "os"), ("code", "class A: doc"), ("code", "def A.f(self, x=1)")])
def case_python(spark: SparkSession) -> DataFrame:
    """Imports, classes and functions of Python."""
    return _read(spark, "python", "import os\nclass A:\n    'doc'\n    def f(self, x=1): pass\n")


@case("modality VARCHAR, content VARCHAR, parent VARCHAR", [("prose", "T", None), ("reference", "x.html", "block:1"), ("prose", "one link", "block:1")])
def case_html(spark: SparkSession) -> DataFrame:
    """Blocks and links of a page, without its chrome."""
    return _read(spark, "html", "<html><nav>skip</nav><h1>T</h1><p id='p1'>one <a href='x.html'>link</a></p></html>")


@case("content VARCHAR", [("1+1",), ("2",)])
def case_notebook(spark: SparkSession) -> DataFrame:
    """Cells and their outputs."""
    return _read(spark, "notebook", json.dumps({"cells": [{"cell_type": "code", "source": ["1+1"], "outputs": [{"data": {"text/plain": ["2"]}}]}]})).select("content")


@case(
    "modality VARCHAR, content VARCHAR, ref VARCHAR, salience DOUBLE",
    [
        ("table", 'Sheet "Sum up": 3 cell(s), 2 formula(s).', "sheet:Sum up", 0.9), ("record", "Total =SUM(Model!$B$1:C2)*0.87 -> 2741", "cell:Sum up!B1", 0.6), ("gap", "Sum up!B1 has 0.87 in its formula and not in a cell of its own", "cell:Sum up!B1", 0.0),
        ("record", "B2 =B1+1 -> 2742", "cell:Sum up!B2", 0.75), ("table", 'Sheet "Model": 4 cell(s), 0 formula(s).', "sheet:Model", 0.9), ("record", "Rate = 450", "cell:Model!B1", 0.85), ("record", "Price = 7", "cell:Model!C2", 0.85),
    ],
)
def case_workbook(spark: SparkSession) -> DataFrame:
    """Sheets by relationship, formulas, inputs on other sheets, labels left and above, buried numbers."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(at: str, v, f: str | None = None) -> str:
        return f'<c r="{at}" t="{"str" if isinstance(v, str) else "n"}">' + (f"<f>{f}</f>" if f else "") + f"<v>{v}</v></c>"

    sheet = lambda *c: f'<worksheet xmlns="{main}"><sheetData>{"".join(c)}</sheetData></worksheet>'
    book = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sum up" r:id="rId2"/><sheet name="Model" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet(cell("A1", "Rate"), cell("B1", 450), cell("C1", "Price"), cell("C2", 7)),
        "xl/worksheets/sheet2.xml": sheet(cell("A1", "Total"), cell("B1", 2741, "SUM(Model!$B$1:C2)*0.87"), cell("B2", 2742, "B1+1")),
    }
    return _read(spark, "xlsx", _zip(book))


def _sheet(spark: SparkSession) -> DataFrame:
    rows = [("M", 2, 1, "Nodes", None), ("M", 2, 2, "8", None), ("M", 3, 1, "Rate", None), ("M", 3, 2, "450", None), ("M", 7, 1, "Total", None), ("M", 7, 2, "3600", "B2*$B$3*0.87"), ("S", 1, 2, "x", "SUM(M!B7,'M'!B2)+1"), ("S", 1, 7, "far", None), ("S", 2, 7, "5", None)]
    return _rows(spark, "sheet string, row int, col int, value string, formula string", rows)


@case("sheet VARCHAR, row INTEGER, col INTEGER, label VARCHAR", [("M", 2, 2, "Nodes"), ("M", 3, 2, "Rate"), ("M", 7, 2, "Total"), ("S", 2, 7, "far")])
def case_cell_labels(spark: SparkSession) -> DataFrame:
    """The nearest text within three columns to the left, else above."""
    return cells.labels(_sheet(spark)).where("label is not null and value rlike '^[0-9]'")


@case("sheet VARCHAR, row INTEGER, col INTEGER, p_sheet VARCHAR, p_row INTEGER, p_col INTEGER", [("M", 7, 2, "M", 2, 2), ("M", 7, 2, "M", 3, 2), ("S", 1, 2, "M", 7, 2), ("S", 1, 2, "M", 2, 2)])
def case_precedents(spark: SparkSession) -> DataFrame:
    return cells.precedents(_sheet(spark))


@case("sheet VARCHAR, row INTEGER, col INTEGER, kind VARCHAR", [("M", 2, 2, "input"), ("M", 3, 2, "input"), ("S", 1, 2, "output")])
def case_inputs_outputs(spark: SparkSession) -> DataFrame:
    """Cells that formulas use but none makes, and formulas that none uses."""
    s = _sheet(spark)
    return cells.inputs(s).withColumn("kind", F.lit("input")).unionByName(cells.outputs(s).withColumn("kind", F.lit("output")))


@case("sheet VARCHAR, functions VARCHAR[], literals VARCHAR[]", [("M", [], ["0.87"]), ("S", ["SUM"], [])])
def case_formula_parts(spark: SparkSession) -> DataFrame:
    return cells.functions_used(_sheet(spark))


@case("letters VARCHAR, n INTEGER", [("A", 1), ("Z", 26), ("AA", 27), ("xfd", 16384)])
def case_column_numbers(spark: SparkSession) -> DataFrame:
    return _rows(spark, "letters string", [("A",), ("Z",), ("AA",), ("xfd",)]).select("letters", cells.column_number(F.col("letters")).alias("n"))


# -- catalogs


@case("table VARCHAR, column VARCHAR, target VARCHAR, target_column VARCHAR", [("s", "p", "p", "id"), ("t", "a", "q", "x"), ("t", "b", "q", "y")])
def case_foreign_keys(spark: SparkSession) -> DataFrame:
    """Named target columns, else the target's primary key place by place."""
    keys = _rows(spark, "table string, target string, members array<string>, target_members array<string>", [("s", "p", ["p"], None), ("t", "q", ["a", "b"], ["x", "y"]), ("u", "none", ["z"], [])])
    return units.foreign_keys(keys, _rows(spark, "table string, members array<string>", [("p", ["id"]), ("q", ["x", "y"])]))


@case("table VARCHAR, key VARCHAR, place INTEGER, column VARCHAR", [("t", "pk", 0, "a"), ("t", "pk", 1, "b"), ("u", "uq", 0, "c")])
def case_key_members(spark: SparkSession) -> DataFrame:
    keys = _rows(spark, "table string, key string, members array<string>", [("t", "pk", ["a", "b"]), ("u", "uq", ["c", "gone"])])
    return units.key_members(keys, _rows(spark, "table string, column string", [("t", "a"), ("t", "b"), ("u", "c")]))


@case("sql VARCHAR, names VARCHAR[]", [("select 1 from a join b.c on x", ["a", "b.c"]), ("select 'from z' from \"q t\" -- join y", ['"q t"']), ("/* from k */ select * from m, n", ["m"]), ("select 1", [])])
def case_sql_dependencies(spark: SparkSession) -> DataFrame:
    """Names after FROM and JOIN, without comments and texts."""
    given = ["select 1 from a join b.c on x", "select 'from z' from \"q t\" -- join y", "/* from k */ select * from m, n", "select 1"]
    return _rows(spark, "sql string", [(x,) for x in given]).select("sql", units.sql_dependencies(F.col("sql")).alias("names"))


@case("view VARCHAR, table VARCHAR, schema VARCHAR", [("v1", "t", "main"), ("v2", "t", "other"), ("v3", "only", "other")])
def case_view_edges(spark: SparkSession) -> DataFrame:
    """What views read (J14): the own schema first, the named one, the only one; names of several schemas stay open."""
    views = _rows(spark, "schema string, name string, sql string", [("main", "v1", "select * from t"), ("main", "v2", "select * from other.t"), ("main", "v3", "select * from only"), ("third", "v4", "select * from t"), ("main", "v5", "select * from gone")])
    return units.view_edges(views, _rows(spark, "schema string, name string", [("main", "t"), ("other", "t"), ("other", "only")]))


@case("physical VARCHAR, logical VARCHAR, semantic BOOLEAN", [("INT64", "", True), ("double", "", True), ("BYTE_ARRAY", "String", False), ("BYTE_ARRAY", "Decimal(9, 2)", True), ("INT96", "Timestamp", True), ("BYTE_ARRAY", "JSON date", False), ("FIXED", "UUID", False)])
def case_semantic_ranges(spark: SparkSession) -> DataFrame:
    given = [("INT64", ""), ("double", ""), ("BYTE_ARRAY", "String"), ("BYTE_ARRAY", "Decimal(9, 2)"), ("INT96", "Timestamp"), ("BYTE_ARRAY", "JSON date"), ("FIXED", "UUID")]
    return _rows(spark, "physical string, logical string", given).select("physical", "logical", units.range_is_semantic(F.col("physical"), F.col("logical")).alias("semantic"))


@case("name VARCHAR, truncated BOOLEAN", [("a", True), ("b", True)])
def case_first_names(spark: SparkSession) -> DataFrame:
    """The least names, and whether one more was there."""
    return units.first_names(_rows(spark, "n string", [("c",), ("a",), ("b",), ("a",), (None,)]), "n", 2)


# -- units and selection


@case(
    "unit_id VARCHAR, semantic BOOLEAN, specific BOOLEAN",
    [("u0", False, True), ("u1", False, True), ("u2", True, True), ("u3", True, False), ("u4", True, True), ("u5", True, False), ("u6", True, False), ("u7", True, True)],
)
def case_unit_predicates(spark: SparkSession) -> DataFrame:
    """Semantic and specific units."""
    rows = [
        ("u0", "source", "a", []), ("u1", "reference", "b", []), ("u2", "code", "x", []), ("u3", "schema", "x", []), ("u4", "schema", "x", ["$", "x"]), ("u5", "prose", "## A title of six words here", ["a title of six words here"]),
        ("u6", "prose", "Only five words are here", ["T"]), ("u7", "prose", "This one has six words indeed", ["T"]),
    ]
    df = _rows(spark, "unit_id string, modality string, content string, structure array<string>", rows)
    return df.select("unit_id", units.is_semantic(F.col("modality")).alias("semantic"), units.is_specific(F.col("modality"), F.col("content"), F.col("structure")).alias("specific"))


def _units(spark: SparkSession) -> DataFrame:
    rows = [("a", "u0", 0, 0.5, 1.0, "r0"), ("a", "u1", 1, 0.9, 0.5, "r1"), ("a", "u2", 2, 0.9, 0.9, "r1"), ("b", "u3", 3, 0.4, 1.0, "r1"), ("b", "u4", 4, 0.4, 1.0, "r1"), ("b", "u5", 5, 0.1, 1.0, "r1")]
    df = _rows(spark, "source string, unit_id string, seq int, salience double, confidence double, ref string", rows)
    return df.withColumn("c", F.lit("all")).withColumn("modality", F.lit("prose")).withColumn("content", F.concat(F.lit("unit "), "unit_id"))


@case("unit_id VARCHAR, rank INTEGER", [("u5", 1), ("u0", 2), ("u2", 3), ("u1", 4), ("u3", 5), ("u4", 6)])
def case_salience_rank(spark: SparkSession) -> DataFrame:
    """Cited units in the order of claims, then weight, confidence, input order."""
    return units.salience_rank(_units(spark), _rows(spark, "unit_id string, place int", [("u0", 2), ("u5", 1), ("u5", 7)]), "c")


@case("unit_id VARCHAR", [("u1",), ("u2",), ("u3",), ("u4",)])
def case_per_source_cap(spark: SparkSession) -> DataFrame:
    """Two of each source."""
    return units.per_source(_units(spark), "c", [F.desc("salience"), F.col("seq")])


@case("unit_id VARCHAR, ordinal INTEGER", [("u0", 0), ("u1", 1), ("u2", 2), ("u3", 0), ("u4", 1), ("u5", 2)])
def case_stable_ordinals(spark: SparkSession) -> DataFrame:
    return units.stable_ordinals(_units(spark), "source", [F.col("seq")])


@case("source VARCHAR, ref VARCHAR, unit_id VARCHAR", [("a", "r1", "u1"), ("a", "r1", "u2"), ("b", "r1", "u3"), ("b", "r1", "u4")])
def case_gap_supports(spark: SparkSession) -> DataFrame:
    """Units at a gap's very place, two of a source."""
    return units.gap_supports(_rows(spark, "source string, ref string", [("a", "r1"), ("b", "r1"), ("b", "r9")]), _units(spark))


@case("src VARCHAR, dst VARCHAR, missing VARCHAR", [("u0", "gone", "gone"), ("no", "way", "no"), ("no", "way", "way")])
def case_dangling(spark: SparkSession) -> DataFrame:
    """Relations whose ends no unit is."""
    return units.dangling(_rows(spark, "src string, dst string", [("u0", "u1"), ("u0", "gone"), ("no", "way")]), _units(spark))


@case("unit_id VARCHAR", [("u0",), ("u1",), ("u2",), ("u3",), ("u4",), ("u5",), ("u6",), ("u9",)])
def case_presented_units(spark: SparkSession) -> DataFrame:
    """What is cited, and the first six of a source."""
    df = _rows(spark, "unit_id string, source string, i int", [(f"u{i}", "s", i) for i in range(10)])
    return presentation.presented_units(df, df.where("i in (6, 9)"), [F.col("i")], "standard")


@case("source VARCHAR", [("s00",), ("s01",), ("s02",), ("s03",), ("s04",), ("s05",), ("s06",), ("s11",)])
def case_presented_sources(spark: SparkSession) -> DataFrame:
    """Eight sources, those that could not be read first."""
    return presentation.presented_sources(_rows(spark, "source string, status string", [(f"s{i:02}", "declined" if i == 11 else "extracted") for i in range(12)]), "brief")


@case("source VARCHAR, suppressed BIGINT", [("s", 6)])
def case_suppressed(spark: SparkSession) -> DataFrame:
    """How many rows a cap leaves out."""
    df = _rows(spark, "source string, i int", [("s", i) for i in range(10)] + [("t", 1)])
    return presentation.capped(df, "source", [F.col("i")], 4)[1]


@case("source VARCHAR, text VARCHAR", [("s", "u0, u1, u2, u3, u4, u5, u6, u7 and 2 more"), ("t", "x")])
def case_first_and_more(spark: SparkSession) -> DataFrame:
    """The first eight, and how many more."""
    return presentation.first_and_more(_rows(spark, "source string, u string", [("s", f"u{i}") for i in range(10)] + [("s", "u1"), ("t", "x")]), "source", "u")


@case("position INTEGER, name VARCHAR", [(0, "a"), (1, "a [2]"), (2, "b"), (3, "a [3]")])
def case_unique_headers(spark: SparkSession) -> DataFrame:
    return presentation.unique_headers(_rows(spark, "source string, position int, name string", [("s", 0, "a"), ("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a")]))


@case("source VARCHAR, modality VARCHAR, n BIGINT", [("a", "prose", 3), ("b", "prose", 3)])
def case_catalog_counts(spark: SparkSession) -> DataFrame:
    return units.catalog_counts(_units(spark), "modality")


@case("key VARCHAR, total DECIMAL(38,9)", [("fuse", 0.3), ("read", 1.25)])
def case_timings(spark: SparkSession) -> DataFrame:
    """Sums of decimals (G11): a tenth and two tenths are three tenths."""
    return units.timings(_rows(spark, "key string, seconds string", [("fuse", "0.1"), ("fuse", "0.2"), ("read", "1.25")]))


@case("page INTEGER, size DOUBLE", [(1, 10.0), (2, 8.0)])
def case_dominant_size(spark: SparkSession) -> DataFrame:
    """The size with most text, the smaller of equals."""
    return units.dominant_size(_rows(spark, "page int, size double, text string", [(1, 20.0, "Title"), (1, 10.0, "body text"), (1, 10.0, "more"), (2, 8.0, "ab"), (2, 9.0, "cd")]), "page")


@case("role VARCHAR, support BIGINT, precision DOUBLE, recall DOUBLE, f1 DOUBLE", [("caveat", 2, 1.0, 0.5, 0.666667), ("procedure", 1, 0.5, 1.0, 0.666667), ("definition", 1, 0.0, 0.0, 0.0)])
def case_role_scores(spark: SparkSession) -> DataFrame:
    """Precision, recall and F1 of each role."""
    return units.role_scores(_rows(spark, "role string, predicted string", [("caveat", "caveat"), ("caveat", "procedure"), ("procedure", "procedure"), ("definition", None)]))


@case("path VARCHAR, least BIGINT, most BIGINT", [("$/a", 0, 3), ("$/a/*", 1, 2)])
def case_array_lengths(spark: SparkSession) -> DataFrame:
    """Least and greatest length of arrays (G4); the arrays inside an array are counted place by place of their parent."""
    rows = [(1, "$", "object"), (1, "$/a", "array"), (1, "$/a/*", "integer"), (1, "$/a/*", "integer"), (1, "$/a/*", "integer"), (2, "$", "object"), (2, "$/a", "array"), (3, "$/a", "array"), (3, "$/a/*", "array"), (3, "$/a/*/*", "null"), (4, "$/a", "array"), (4, "$/a/*", "array"), (4, "$/a/*/*", "null"), (4, "$/a/*/*", "null")]
    return units.array_lengths(_rows(spark, "record int, path string, type string", rows))


@case("c VARCHAR, place INTEGER, content VARCHAR, evidence VARCHAR[]", [("all", 1, "This one has six words indeed", ["u1"]), ("all", 2, "x = 1", ["u0"])])
def case_fallback(spark: SparkSession) -> DataFrame:
    """What is said without a model (M7)."""
    rows = [("all", "s", "r0", "u0", "code", "x = 1", [], 0.7), ("all", "s", "r1", "u1", "prose", "This one  has six words\nindeed", ["T"], 0.8), ("all", "s", "r2", "u2", "prose", "T", ["T"], 0.9), ("all", "s", "r3", "u3", "reference", "y", [], 0.9)]
    return units.fallback_claims(_rows(spark, "c string, source string, ref string, unit_id string, modality string, content string, structure array<string>, salience double", rows), "c")


@case("collection VARCHAR, unit_id VARCHAR, place INTEGER", [("all", "u1", 0), ("all", "u3", 1), ("all", "u2", 2)])
def case_evidence_pack(spark: SparkSession) -> DataFrame:
    """Units tried in rounds over the sources, one that doesn't fit being passed over (R3, M2): 73 bytes each, and a large one."""
    df = _units(spark).withColumn("content", F.when(F.col("unit_id") == "u4", F.repeat(F.lit("x"), 500)).otherwise(F.col("content")))
    return engine.evidence_pack(df, "c", 230)


@case("claim INTEGER, reason VARCHAR", [(1, "unsupported-number"), (2, None), (3, "unknown-evidence"), (4, "no-evidence"), (5, "repeated"), (6, "form")])
def case_claim_policy(spark: SparkSession) -> DataFrame:
    """Reasons to drop a claim, the first that holds."""
    rows = [(1, "There are 77 things.", ["u0"]), (2, "Fine.", ["u0"]), (3, "Other.", ["nothing"]), (4, "x", []), (5, "Fine.", ["u1"]), (6, "two\nlines", ["u0"])]
    return engine.claim_policy(_rows(spark, "claim int, content string, evidence array<string>", rows), _units(spark))


@case("most INTEGER, units INTEGER, used_is_size BOOLEAN", [(10_000, 5, True), (90, 3, True), (60, 1, True)])
def case_exact_budget(spark: SparkSession) -> DataFrame:
    """A bundle states its own size and is the longest prefix that fits (M1, K1)."""
    out = []
    for most in (10_000, 90, 60):
        text = budget.bundle_json([{"c": "é" * k} for k in range(5)], most)
        body = json.loads(text)
        out.append((most, len(body["units"]), body["used"] == len(text.encode()) <= most))
    return _rows(spark, "most int, units int, used_is_size boolean", out)


# -- fusion


@case(
    "target VARCHAR, kind VARCHAR, branch VARCHAR, status VARCHAR, target_source VARCHAR, confidence DOUBLE",
    [
        ("data.csv", "path", "path", "resolved", "/c/data.csv", 0.95), ("../data.csv", "path", "path", "resolved", "/c/data.csv", 1.0), ("./b.py#l3", "unknown", "path", "resolved", "/c/docs/b.py", 1.0), ("same.txt", "path", "path", "ambiguous-target", None, None), ("nowhere.csv", "image", "path", "unresolved", None, None),
        ("HTTP://Site.org:80/p/%7Eq#x", "url", "url", "resolved", "http://site.org/p/~q", 1.0), ("https://other.org/x/data.csv", "url", "url", "external-reference", None, None), ("doi:10.1000/AbC", "doi", "doi", "resolved", "https://doi.org/10.1000/abc", 1.0), ("10.1000/zzz", "unknown", "doi", "external-reference", None, None),
        (".b", "import", "import", "resolved", "/c/docs/b.py", 0.99), ("..pkg", "from-import", "import", "resolved", "/c/pkg/__init__.py", 0.99), (".gone", "import", "import", "unresolved", None, None), ("os", "import", "import", "external-reference", None, None),
        ("fig:1", "label", "label", "resolved", "/c/docs/b.py", 1.0), ("own", "label", "label", "resolved-intra-source", "/c/docs/a.md", 1.0), ("none", "label", "label", "unresolved", None, None), ("smith20", "citation", "citation", "unresolved", None, None), ("just words", "unknown", "unsupported", "unsupported-reference-kind", None, None),
    ],
)
def case_references(spark: SparkSession) -> DataFrame:
    """Literal references by kind."""
    given = [
        ("data.csv", "path"), ("../data.csv", "path"), ("./b.py#l3", "unknown"), ("same.txt", "path"), ("nowhere.csv", "image"), ("HTTP://Site.org:80/p/%7Eq#x", "url"), ("https://other.org/x/data.csv", "url"), ("doi:10.1000/AbC", "doi"), ("10.1000/zzz", "unknown"),
        (".b", "import"), ("..pkg", "from-import"), (".gone", "import"), ("os", "import"), ("fig:1", "label"), ("own", "label"), ("none", "label"), ("smith20", "citation"), ("just words", "unknown"), ("  ", "path"),
    ]
    refs = _rows(spark, "source string, ref string, target string, kind string", [("/c/docs/a.md", f"r{i}", t, k) for i, (t, k) in enumerate(given)])
    sources = ["/c/docs/a.md", "/c/docs/b.py", "/c/data.csv", "/c/pkg/__init__.py", "/c/x/same.txt", "/c/y/same.txt", "http://site.org/p/~q", "https://doi.org/10.1000/abc"]
    labels = _rows(spark, "key string, target_source string, unit string", [("label:fig:1", "/c/docs/b.py", "u"), ("label:own", "/c/docs/a.md", "u"), ("label:own", "/c/docs/b.py", "v")])
    found = fusion.resolve_references(refs, fusion.source_identities(_rows(spark, "source string", [(s,) for s in sources])).unionByName(labels))
    return found.join(refs.select("ref", "kind"), "ref")


@case(
    "line VARCHAR, key VARCHAR, value_type VARCHAR, value VARCHAR, unit VARCHAR, qualified BOOLEAN",
    [
        ("max_size = 3", "max size", "number", "3", None, True), ("- `Batch Size`: 3.0 MB.", "batch size", "number", "3", "mb", True), ("retry: TRUE", "retry", "boolean", "true", None, False), ("x.y = 'it\\'s'", "x y", "string", "it's", None, True), ('name = "a\\n\\"b\\""', "name", "string", 'a\n"b"', None, False),
        ("rate = .5 %", "rate", "number", "0.5", "%", False), ("low = -0.0;", "low", "number", "0", None, False), ("big = +007.250", "big", "number", "7.25", None, False), ("document.key = 4", None, None, None, None, None), ("bad = \"\\q\"", None, None, None, None, None), ("words = some words", None, None, None, None, None),
    ],
)
def case_prose_facts(spark: SparkSession) -> DataFrame:
    """Lines that state facts, in every form."""
    given = ["max_size = 3", "- `Batch Size`: 3.0 MB.", "retry: TRUE", "x.y = 'it\\'s'", 'name = "a\\n\\"b\\""', "rate = .5 %", "low = -0.0;", "big = +007.250", "document.key = 4", 'bad = "\\q"', "words = some words"]
    lines = _rows(spark, "line string", [(x,) for x in given])
    return lines.join(fusion.prose_facts(lines.withColumn("content", F.col("line")), "line").withColumnRenamed("source", "line"), "line", "left")


@case(
    "key VARCHAR, left VARCHAR, right VARCHAR, left_value VARCHAR, right_value VARCHAR, unit VARCHAR, context VARCHAR",
    [("batch limit", "a", "b", "3", "4", None, "exact-qualified-specific-key"), ("retry count", "b", "c", "2", "5", None, "exact-qualified-specific-key"), ("status value", "a", "c", "1", "9", None, "accepted-cross-source-relation"), ("wait time", "a", "b", "5", "6", "ms", "exact-qualified-specific-key")],
)
def case_contradictions(spark: SparkSession) -> DataFrame:
    """Conflicting facts (J10, J11, P14, G18): one-token keys, equal decimals, other units, ambiguous and unrelated sources give none."""
    given = [
        ("a", "batch_limit = 3"), ("b", "batch_limit = 4.0"), ("c", "batch_limit = 3.0"), ("c", "batch_limit = 7"), ("a", "size = 3"), ("b", "size = 4"), ("b", "retry.count: 2"), ("c", "retry.count: 5"), ("a", "retry.count: 2 ms"), ("a", "status value text = 1"), ("a", "status_value = 1"), ("b", "status_value = 2"), ("c", "status_value = 9"),
        ("a", "wait_time = 5 ms"), ("b", "wait_time = 6 MS"), ("c", "wait_time = 7 s"), ("a", "row_count = 1"), ("b", "row_count = '1'"),
    ]
    facts = fusion.prose_facts(_rows(spark, "source string, content string", given), "source")
    return fusion.contradictions(facts, _rows(spark, "left string, right string", [("c", "a")]))


@case("source VARCHAR, key VARCHAR, value_type VARCHAR, value VARCHAR, qualified BOOLEAN", [("s1", "limits batch", "number", "3", True), ("s2", "mode", "string", "fast", True), ("s3", "on", "boolean", "true", False)])
def case_constant_facts(spark: SparkSession) -> DataFrame:
    """Facts of schema units with one distinct value."""
    rows = [
        ("s1", "schema", {"schema_path": "$/limits/batch", "types": ["integer", "null"], "values": ["3.0"]}), ("s2", "schema", {"schema_path": "$/mode", "types": ["string"], "values": ['"fast"']}), ("s3", "schema", {"name": "on", "types": ["boolean"], "values": ["true"]}),
        ("s4", "schema", {"name": "two", "types": ["integer"], "values": ["1", "2"]}), ("s5", "prose", {"name": "no", "types": ["integer"], "values": ["1"]}), ("s6", "schema", {"name": "mix", "types": ["integer", "string"], "values": ["1"]}), ("s7", "schema", {"name": "cut", "types": ["string"], "values": ['"abc…"']}),
    ]
    df = _rows(spark, "source string, modality string, meta string", [(s, m, json.dumps(v, ensure_ascii=False)) for s, m, v in rows])
    return fusion.constant_facts(df)


@case("left VARCHAR, right VARCHAR, confidence DOUBLE", [("a.csv", "b.md", 0.82), ("a.csv", "c.py", 0.9)])
def case_identifier_matches(spark: SparkSession) -> DataFrame:
    """Names and mentions across sources (J5 to J7, W7, W8, X32, G17): names of two namespaces are rejected."""
    return engine.analyze(_collection(spark))["matches"].where("signal = 'identifier'")


@case("left VARCHAR, right VARCHAR, signal VARCHAR", [("a.csv", "c.py", "identifier")])
def case_shipped_matches(spark: SparkSession) -> DataFrame:
    """What fusion ships (P5): of identifiers those that both sources name."""
    return engine.fuse(_collection(spark))


def _collection(spark: SparkSession) -> engine.Evidence:
    rows = [
        ("a.csv", "csv", b"capacity_mah,name\n1,2\n"), ("b.md", "markdown", b"# Notes\n\nThe capacity mah of a cell.\n"), ("c.py", "python", b"def getCapacityMah():\n    return 1\n"),
        ("d.json", "json", b'{"rocket": {"thrust_level": 1}}'), ("e.json", "json", b'{"boat": {"thrust_level": 1}}'), ("f.md", "markdown", b"Here mah capacity and thrust level.\n"),
    ]
    return engine.from_records(spark, rows)


@case("content VARCHAR", [("The collection has 6 source(s) of 4 kind(s).",), ("It has 0 literal, 1 identifier and 0 structural relation(s).",), ("0 gap(s) are reported.",)])
def case_statements(spark: SparkSession) -> DataFrame:
    """Three sentences about a collection (M3)."""
    e = _collection(spark)
    e.gaps = e.gaps.where("source like '%.json'")
    return engine.statements(e, engine.fuse(e))


@case("path VARCHAR, namespace VARCHAR", [("$/rocket/thrust", "rocket"), ("$/items/*/thrust", None), ("$/data/hullPlan/x", "hull plan"), ("x", None)])
def case_namespaces(spark: SparkSession) -> DataFrame:
    """The first telling part before a path's last one."""
    return _rows(spark, "path string", [("$/rocket/thrust",), ("$/items/*/thrust",), ("$/data/hullPlan/x",), ("x",)]).select("path", F.nullif(fusion.namespace(F.col("path")), F.lit("")).alias("namespace"))


@case("canonical VARCHAR, namespaces VARCHAR[]", [("thrust level", ["boat", "rocket"])])
def case_conflicting_namespaces(spark: SparkSession) -> DataFrame:
    return units.conflicting_namespaces(_rows(spark, "canonical string, namespace string", [("thrust level", "rocket"), ("thrust level", "boat"), ("mass", "boat"), ("mass", None)]))


@case("canonical VARCHAR, unit VARCHAR", [("a b", "u1"), ("a b", "u2"), ("a a", "u1"), ("a a", "u2"), ("a a", "u3")])
def case_postings(spark: SparkSession) -> DataFrame:
    """Units whose postings hold all tokens of a name."""
    postings = _rows(spark, "token string, unit string", [("a", "u1"), ("b", "u1"), ("a", "u1"), ("b", "u2"), ("a", "u2"), ("a", "u3")])
    return units.postings_with_all(postings, _rows(spark, "canonical string", [("a b",), ("a a",), ("a c",)]))


@case("needle VARCHAR, there BOOLEAN", [("b c", True), ("a c", False), ("c d e", False), ("d", True), ("", False), ("a b c d", True)])
def case_contained_runs(spark: SparkSession) -> DataFrame:
    """Tokens one after another."""
    df = _rows(spark, "needle string", [(x,) for x in ("b c", "a c", "c d e", "d", "", "a b c d")])
    return df.select("needle", units.holds_run(F.split(F.lit("a b c d"), " "), F.filter(F.split("needle", " "), lambda t: t != "")).alias("there"))


@case("left VARCHAR, right VARCHAR", [("a", "b"), ("a", "c")])
def case_related_pairs(spark: SparkSession) -> DataFrame:
    return units.related_pairs(_rows(spark, "left string, right string", [("b", "a"), ("a", "b"), ("c", "a"), ("c", "c")]))


# -- scalars


@case(
    "given VARCHAR, bounded VARCHAR, one_space VARCHAR, joined VARCHAR, path VARCHAR, last VARCHAR",
    [
        ("a  b\n c", "a  b\n c", "a b c", "a  b\n c", "a  b\n c", "a  b\n c"), ("inter-\n national", "inter-\n national", "inter- national", "international", "inter-\n national", "inter-\n national"), ("x" * 61, "x" * 57 + "...", "x" * 61, "x" * 61, "x" * 61, "x" * 61),
        ("/a/./b/../c", "/a/./b/../c", "/a/./b/../c", "/a/./b/../c", "/a/c", "c"), ("$/rows/*/price", "$/rows/*/price", "$/rows/*/price", "$/rows/*/price", "$/rows/*/price", "price"),
    ],
)
def case_text_scalars(spark: SparkSession) -> DataFrame:
    """X8, X10, X12, X21, X37."""
    df = _rows(spark, "given string", [("a  b\n c",), ("inter-\n national",), ("x" * 61,), ("/a/./b/../c",), ("$/rows/*/price",)])
    g = F.col("given")
    return df.select("given", X.bounded(g).alias("bounded"), X.one_space(g).alias("one_space"), X.dehyphenate(g).alias("joined"), X.path_normalised(g).alias("path"), X.last_segment(g).alias("last"))


@case("given VARCHAR, doi VARCHAR", [("doi: 10.1000/AbC", "10.1000/abc"), ("https://dx.doi.org/10.1000/x.y", "10.1000/x.y"), ("10.99/short", None), ("not one", None)])
def case_dois(spark: SparkSession) -> DataFrame:
    return _rows(spark, "given string", [("doi: 10.1000/AbC",), ("https://dx.doi.org/10.1000/x.y",), ("10.99/short",), ("not one",)]).select("given", X.doi(F.col("given")).alias("doi"))


@case("given VARCHAR, plain VARCHAR", [("3.0", "3"), ("-0", "0"), ("+.50", "0.5"), ("007", "7"), ("1e3", None), ("12345678901234567890123456789012345678901234567890.10", "12345678901234567890123456789012345678901234567890.1")])
def case_plain_numbers(spark: SparkSession) -> DataFrame:
    """Equal numbers are equal texts."""
    given = ["3.0", "-0", "+.50", "007", "1e3", "12345678901234567890123456789012345678901234567890.10"]
    return _rows(spark, "given string", [(x,) for x in given]).select("given", X.plain_number(F.col("given")).alias("plain"))


@case("level INTEGER, weight DOUBLE", [(1, 0.9), (2, 0.8), (6, 0.4), (9, 0.4)])
def case_salience(spark: SparkSession) -> DataFrame:
    return _rows(spark, "level int", [(1,), (2,), (6,), (9,)]).select("level", X.salience(F.col("level")).alias("weight"))


@case("given VARCHAR, tokens VARCHAR[]", [("HTTPServer run2go", ["http", "server", "run2go"]), ("snake_case x", ["snake", "case", "x"]), ("Größe 5", ["Größe", "5"])])
def case_text_tokens(spark: SparkSession) -> DataFrame:
    """Tokens of running text keep digits and letters together."""
    return _rows(spark, "given string", [("HTTPServer run2go",), ("snake_case x",), ("Größe 5",)]).select("given", X.text_tokens(F.col("given")).alias("tokens"))


@case("given VARCHAR, definition BOOLEAN, caveat BOOLEAN, procedure BOOLEAN", [("**Term** — a thing", True, False, False), ("- **Term**: a thing", True, False, True), ("Note that it is slow", False, True, False), ("You must not stop", False, True, False), ("1. Start", False, False, True), ("A term means a thing", False, False, False)])
def case_prose_cues(spark: SparkSession) -> DataFrame:
    """Cues of definitions, caveats and procedures."""
    given = ["**Term** — a thing", "- **Term**: a thing", "Note that it is slow", "You must not stop", "1. Start", "A term means a thing"]
    return _rows(spark, "given string", [(x,) for x in given]).select("given", X.prose_cues(F.col("given")).alias("c")).select("given", "c.*")


@case("given VARCHAR, valid BOOLEAN", [("ok", True), ("bad", False)])
def case_utf8(spark: SparkSession) -> DataFrame:
    """Whether bytes are UTF-8."""
    return _rows(spark, "given string, data binary", [("ok", bytearray("é".encode())), ("bad", bytearray(b"\xc3("))]).select("given", F.is_valid_utf8(F.col("data").cast("string")).alias("valid"))


# -- extensions and watching


@case("step VARCHAR, outcome VARCHAR", [("register a set with a clash", "refused whole"), ("register", "kept"), ("signature at the start", "true"), ("signature at the end", "true"), ("no signature", "false"), ("read", "hi"), ("unit without content", "refused"), ("load", "refused")])
def case_extensions(spark: SparkSession) -> DataFrame:
    """Readers registered whole or not at all, found by signature, checked."""
    r, out = extensions.Registry(), []
    good = extensions.ReaderSpec("mine", "mine", lambda data: iter([("prose", data.decode(), "all", 0.5, None, {})]), ("mine",), ((0, b"MY"), (-2, b"ME")))
    empty = extensions.ReaderSpec("w", "w", lambda data: iter([("prose", "", "a", 0.5, None, {})]))
    try:
        r.register(good, extensions.ReaderSpec("other", "json", lambda data: iter(()), ("zzz",)))
    except ValueError:
        out.append(("register a set with a clash", "kept some" if r.readers else "refused whole"))
    r.register(good)
    out += [("register", "kept" if r.readers else "lost"), *((f"{n}", str(good.matches(d)).lower()) for n, d in (("signature at the start", b"MYxx"), ("signature at the end", b"xxME"), ("no signature", b"xx")))]
    out.append(("read", next(iter(r.kind_readers()["mine"](b"hi")))[1]))
    try:
        list(extensions.checked(empty)(b""))
    except ValueError:
        out.append(("unit without content", "refused"))
    try:
        extensions.load("lodestone.plans.nothing:here")
    except ImportError:
        out.append(("load", "refused"))
    return _rows(spark, "step string, outcome string", out)


@case(
    "run INTEGER, added BIGINT, changed BIGINT, unchanged BIGINT, removed BIGINT, failed BIGINT",
    [(1, 3, 0, 0, 0, 1), (2, 0, 1, 2, 0, 0), (3, 0, 0, 2, 1, 0)],
)
def case_watch_runs(spark: SparkSession) -> DataFrame:
    """What passes over a folder count (T4 to T6, T9 to T11): new, changed, touched only, removed and refused files."""
    root = f"{shared_dir(spark)}/lodestone/watched-{uuid.uuid4().hex}"
    store = f"{root}-store"

    def put(name: str, data: str) -> None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data.encode()))
        out.close()

    def remove(name: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)

    for name, data in (("a.md", "# A"), ("b.txt", "one"), ("c.json", "{")):
        put(name, data)
    watch.run_once(spark, root, store)
    put("b.txt", "longer")
    put("a.md", "# A")  # touched only
    watch.run_once(spark, root, store)
    remove("c.json")
    watch.run_once(spark, root, store)
    watch.run_once(spark, root, store, idle=False)  # leaves no run
    return watch.status(spark, store)[0]
