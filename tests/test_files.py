import io
import json
import sqlite3
import struct
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion
from lodestone.plans import engine
from lodestone.sources import files, formats
from lodestone.streaming import watch


def units(kind, data):
    return list(formats.READERS[kind](data if isinstance(data, bytes) else data.encode()))


def test_markdown():
    got = units("markdown", "# Study\n\nSome text\nwrapped, see [data](results.csv).\n\n## Method\n```py\nx = 1\n```\nSee https://a.b/c.\n")
    assert [(m, c) for m, c, *_ in got] == [("prose", "Study"), ("prose", "Some text wrapped, see [data](results.csv)."), ("reference", "results.csv"), ("prose", "Method"), ("code", "x = 1"), ("prose", "See https://a.b/c."), ("reference", "https://a.b/c")]
    assert got[4][4] == "line:6" and got[3][3] == 0.8


def test_records():
    assert {u[2] for u in units("json", '{"a": [{"b": 1}, {"b": 2.5}], "c/d": null}')} == {"$", "$/a", "$/a/*", "$/a/*/b", "$/c~1d"}
    assert {u[2] for u in units("jsonl", '{"a": 1}\n\n{"a": "x"}\n')} == {"$", "$/a"}
    assert {u[2] for u in units("toml", "a = 1\n[t]\nb = 'x'\n")} == {"$", "$/a", "$/t", "$/t/b"}
    assert {u[2] for u in units("xml", "<r><x k='1'>t</x></r>")} == {"/r", "/r/x", "/r/x/@k", "/r/x/#text"}
    for bad in ('{"a": 1, "a": 2}', "[NaN]"):
        with pytest.raises(ValueError):
            units("json", bad)


def test_tables():
    got = units("csv", "a,a,b\n1,2,\n3,4\n")
    assert [u[2] for u in got] == ["table:", "column:1", "column:2", "column:3", "row:3"] and '"a [2]"' in got[2][1]


def test_code_and_pages():
    assert [u[1] for u in units("python", "import os\nclass A:\n    'doc'\n    def f(self, x=1): pass\n")] == ["os", "class A: doc", "def A.f(self, x=1)"]
    got = units("html", "<html><nav>skip</nav><h1>T</h1><p id='p1'>one <a href='x.html'>link</a></p></html>")
    assert [(u[0], u[1], u[4]) for u in got] == [("prose", "T", None), ("reference", "x.html", "block:1"), ("prose", "one link", "block:1")]
    assert [u[5].get("target") for u in units("latex", "\\section{A}\\label{s}\nsee \\ref{s}")][1:] == ["s", "s"]
    book = {"cells": [{"cell_type": "code", "source": ["1+1"], "outputs": [{"data": {"text/plain": ["2"]}}]}]}
    assert [u[1] for u in units("notebook", json.dumps(book))] == ["1+1", "2"]


def test_binary_formats(tmp_path):
    b = io.BytesIO()
    np.save(b, np.zeros((2, 3)))
    assert "shape (2, 3)" in units("npy", b.getvalue())[0][1]
    t = pa.table({"x": [1, 2], "secret": ["canary", None]})
    import pyarrow.parquet as pq
    from pyarrow import orc

    for kind, write in (("parquet", lambda o: pq.write_table(t, o)), ("orc", lambda o: orc.write_table(t, o)), ("arrow", lambda o: pa.ipc.new_file(o, t.schema).close())):
        o = io.BytesIO()
        write(o)
        got = units(kind, o.getvalue())
        assert len(got) == 3 and "canary" not in str(got)
    c = sqlite3.connect(tmp_path / "a.db")
    c.executescript("CREATE TABLE p(id INTEGER PRIMARY KEY, n TEXT NOT NULL); CREATE TABLE s(p INTEGER REFERENCES p(id)); INSERT INTO p VALUES (1, 'canary');")
    c.close()
    got = units("sqlite", (tmp_path / "a.db").read_bytes())
    assert "s.p -> p.id" in [u[1] for u in got] and "canary" not in str(got)
    import duckdb

    d = duckdb.connect(str(tmp_path / "a.duckdb"))
    d.execute("CREATE TABLE t(x INTEGER NOT NULL, y VARCHAR)")
    d.execute("INSERT INTO t VALUES (1, 'canary')")
    d.close()
    got = units("duckdb", (tmp_path / "a.duckdb").read_bytes())
    assert [u[1] for u in got] == ["table main.t", "t.x: INTEGER; not null", "t.y: VARCHAR"]
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    1", "NAXIS1  =                    4", "END"]
    head = "".join(x.ljust(80) for x in cards).ljust(2880).encode()
    assert "axes [4]" in units("fits", head + struct.pack(">4h", 1, 2, 3, 4).ljust(2880, b"\0"))[0][1]
    with pytest.raises(ValueError):
        units("fits", head)


def test_workbook_sheets_by_relationship():
    """Sheets are parts by their relationships; inputs on other sheets count; labels stand left within three columns, else above."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda at, v=None, f=None: f'<c r="{at}" t="{"str" if isinstance(v, str) and not f else "n"}">' + (f"<f>{f}</f>" if f else "") + (f"<v>{v}</v>" if v is not None else "") + "</c>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sum up" r:id="rId2"/><sheet name="Model" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>' + cell("A1", "Rate") + cell("B1", 450) + cell("C1", "Price") + cell("C2", 7) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>' + cell("A1", "Total") + cell("B1", 2741, "SUM(Model!$B$1:C2)*0.87") + cell("B2", 2742, "B1+1") + "</sheetData></worksheet>")
    got = [(u[0], u[1], u[2]) for u in units("xlsx", b.getvalue())]
    assert got == [
        ("table", 'Sheet "Sum up": 3 cell(s), 2 formula(s).', "sheet:Sum up"), ("record", "Total =SUM(Model!$B$1:C2)*0.87 -> 2741", "cell:Sum up!B1"),
        ("gap", "Sum up!B1 has 0.87 in its formula and not in a cell of its own", "cell:Sum up!B1"), ("record", "B2 =B1+1 -> 2742", "cell:Sum up!B2"),
        ("table", 'Sheet "Model": 4 cell(s), 0 formula(s).', "sheet:Model"), ("record", "Rate = 450", "cell:Model!B1"), ("record", "Price = 7", "cell:Model!C2"),
    ]


def test_workbook():
    b = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Model"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Nodes</t></si><si><t>Total</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A2" t="s"><v>0</v></c><c r="B2"><v>8</v></c></row><row><c r="A3" t="s"><v>1</v></c><c r="B3"><f>B2*2</f><v>16</v></c></row></sheetData></worksheet>')
    assert [(u[1], u[3]) for u in units("xlsx", b.getvalue())] == [('Sheet "Model": 4 cell(s), 1 formula(s).', 0.9), ("Nodes = 8", 0.85), ("Total =B2*2 -> 16", 0.75)]


def test_archives(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("a.txt", b"hello"), ("../evil.txt", b"x"), ("bomb.txt", b"0" * 2_000_000), ("in.zip", inner.getvalue())):
            z.writestr(name, data)
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("l")
        info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(info)
    df = spark.createDataFrame([("o.zip", bytearray(outer.getvalue())), ("t.tar", bytearray(tar.getvalue())), ("bad.zip", bytearray(b"PK\3\4broken"))], "source string, content binary")
    got = {r["source"]: r["reason"] for r in files.members(df).collect()}
    assert got.pop("bad.zip").startswith("extraction-error")
    assert got == {"o.zip!/../evil.txt": "unsafe-member", "o.zip!/a.txt": None, "o.zip!/bomb.txt": "limit", "o.zip!/in.zip!/deep.txt": None, "t.tar!/l": "unsafe-member"}


def test_detection(spark):
    given = {"x.md": (b"# hi", "markdown"), "noext": (b'{"a": 1}', "json"), "p.txt": (b"PAR1....PAR1", "parquet"), "w.xlsx": (b"PK\3\4", "xlsx"), "y": (b"<!DOCTYPE html><p>", "html"), "z.pdf": (b"%PDF-1.7", "pdf"), "t": (b"plain", "text"), "b": (b"\0\1\2\xff", "unknown")}
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in given.items()], "source string, content binary")
    assert {r["source"]: r["k"] for r in df.withColumn("k", files.kind_of(F.col("source"), F.col("content"))).collect()} == {k: v[1] for k, v in given.items()}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "run.csv").write_text("cycle_index,capacity_mah,resistance_mohm\n1,2,3\n")
    (root / "run.json").write_text(json.dumps([{"cycle_index": 1, "capacity_mah": 2, "resistance_mohm": 3}]))
    (root / "notes.md").write_text("# Notes\n\nSee [data](run.csv).\n")
    (root / "bad.json").write_text("{")
    return root


def test_engine(spark, folder):
    e = engine.acquire(spark, str(folder))
    assert e.sources.count() == 4 and e.gaps.count() == 1
    assert e.relations.join(e.units.select(F.col("unit_id").alias("dst")), "dst", "left_anti").count() == 0
    got = {(r["signal"], r["left"].rpartition("/")[2], r["right"].rpartition("/")[2]) for r in engine.fuse(e).collect()}
    assert ("literal", "notes.md", "run.csv") in got and ("structural", "run.csv", "run.json") in got and ("identifier", "run.csv", "run.json") in got
    assert engine.statements(e, engine.fuse(e)).count() == 3
    pack = engine.evidence_pack(e.units.withColumn("c", F.lit("all")), "c", 600).collect()
    assert pack and max(r["used"] for r in pack) <= 600
    claims = spark.createDataFrame([(1, "There are 77 things.", [pack[0]["unit_id"]]), (2, "Fine.", [pack[0]["unit_id"]]), (3, "Fine.", ["nothing"]), (4, "x", [])], "claim int, content string, evidence array<string>")
    assert {r["claim"]: r["reason"] for r in engine.claim_policy(claims, e.units).collect()} == {1: "unsupported-number", 2: None, 3: "unknown-evidence", 4: "no-evidence"}
    assert "notes.md" in engine.render_markdown(e.units) and engine.render_jsonl(e).count() == e.units.count()


def test_references_by_kind(spark):
    rows = [
        ("/c/docs/a.md", "markdown", b"[d](data.csv) [up](../data.csv) [far](https://other.org/x/data.csv) [home](HTTP://Site.org:80/p/%7Eq#x) [gone](nowhere.csv) [dup](same.txt)"),
        ("/c/data.csv", "csv", b"x\n1\n"), ("/c/other/same.txt", "text", b"one"), ("/c/third/same.txt", "text", b"two"), ("http://site.org/p/~q", "html", b"<p>hello</p>"),
    ]
    e = engine.from_records(spark, rows)
    got = {r["target"]: (r["status"], r["target_source"], r["confidence"]) for r in engine.references(e).collect()}
    assert got == {
        "data.csv": ("resolved", "/c/data.csv", 0.95), "../data.csv": ("resolved", "/c/data.csv", 1.0), "https://other.org/x/data.csv": ("external-reference", None, None),
        "HTTP://Site.org:80/p/%7Eq#x": ("resolved", "http://site.org/p/~q", 1.0), "nowhere.csv": ("unresolved", None, None), "same.txt": ("ambiguous-target", None, None),
    }
    assert [r["target"] for r in engine.open_references(e).collect()] == ["nowhere.csv"]


def test_admission_connectors_and_unclean_databases(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, n in (("a.txt", 5), ("b.txt", 50), ("c.txt", 5), ("d.db", 5), ("d.db-wal", 3), ("e.db", 5), ("e.db-wal", 0)):
        (root / name).write_bytes(b"x" * n)
    got = {r["source"].rpartition("/")[2]: r["reason"] for r in engine.acquire(spark, str(root), most_each=20).sources.collect()}
    assert got == {"a.txt": None, "b.txt": "declined-bytes", "c.txt": None, "d.db": "unclean-database", "d.db-wal": None, "e.db": None}  # an empty file has no row
    own = {"mem": lambda s, p: s.createDataFrame([("mem:one.md", bytearray(b"# One"))], "source string, content binary")}
    e = engine.acquire(spark, [str(root), "mem:all"], connectors=own)
    assert e.units.where("content = 'One'").count() == 1
    for twice in ([str(root), str(root)], [str(root), f"{root}/a.txt"]):
        with pytest.raises(ValueError, match="twice"):
            engine.acquire(spark, twice)


def test_only_catalogs_are_limited(spark):
    n = 5000
    sheet = io.BytesIO()
    pq.write_table(pa.table({f"c{i}": [1] for i in range(2100)}), sheet)
    rows = [("a.md", "markdown", b"\n\n".join(b"block %d" % i for i in range(n))), ("b.parquet", "parquet", sheet.getvalue())]
    e = engine.from_records(spark, rows)
    text = e.units.where("source = 'a.md'").orderBy("seq").collect()
    assert [r["content"] for r in text] == [f"block {i}" for i in range(n)] and [r["seq"] for r in text] == list(range(n))
    gaps = [(r["source"], r["content"]) for r in e.gaps.collect()]
    assert len(gaps) == 1 and gaps[0][0] == "b.parquet" and gaps[0][1].endswith("more unit(s)")
    assert e.units.where("source = 'b.parquet'").count() == 2048


def test_identifiers_in_code_and_prose(spark):
    rows = [
        ("a.csv", "csv", b"capacity_mah,name\n1,2\n"), ("b.md", "markdown", b"# Notes\n\nThe capacity mah of a cell.\n"), ("c.py", "python", b"def getCapacityMah():\n    return 1\n"),
        ("d.json", "json", b'{"rocket": {"thrust_level": 1}}'), ("e.json", "json", b'{"boat": {"thrust_level": 1}}'), ("f.md", "markdown", b"Here mah capacity and thrust level.\n"),
    ]
    e = engine.from_records(spark, rows)
    named = lambda df: {(r["left"], r["right"], r["confidence"]) for r in df.where("signal = 'identifier'").collect()}
    assert named(engine.analyze(e)["matches"]) == {("a.csv", "b.md", 0.82), ("a.csv", "c.py", 0.9)}
    assert named(engine.fuse(e)) == {("a.csv", "c.py", 0.9)}  # mentions are no shipped signal


def test_identifier_spread_is_rounded_up(spark):
    tables = lambda n: spark.createDataFrame([(f"t{i:02}", "capacity_mah" if i < n else f"other_{i}") for i in range(14)], "source string, column string")
    assert fusion.identifier_correspondence(tables(11)).count() == 10 and fusion.identifier_correspondence(tables(12)).count() == 0


def test_watch_sees_late_and_gone_files(spark, tmp_path):
    """A lone file is read once it has settled, and a deletion is seen, without any other file arriving."""
    import time

    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    (root / "one.md").write_text("# One")
    query = watch.watch(spark, str(root), store, str(tmp_path / "ck"), quiet_seconds=3)

    def until(what):
        end = time.time() + 90
        while time.time() < end:
            if query.exception():
                raise query.exception()
            last = watch.status(spark, store)[0].first()
            if last and what(last):
                return True
            time.sleep(1)
        return False

    try:
        assert until(lambda r: r["added"] == 1)
        (root / "one.md").unlink()
        assert until(lambda r: r["removed"] == 1)
    finally:
        query.stop()
    runs = [r.asDict() for r in watch.status(spark, store)[0].collect()]
    assert [(r["added"], r["removed"]) for r in runs] == [(0, 1), (1, 0)], runs  # polls that found nothing left no run


def test_watch(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    counts = lambda: {k: v for k, v in watch.run_once(spark, str(folder), store).items() if v}
    assert counts() == {"run": 1, "added": 4, "failed": 1}
    assert counts() == {"run": 2, "unchanged": 4}
    old = (folder / "notes.md").read_text()
    (folder / "notes.md").write_text("# New\n")
    (folder / "bad.json").unlink()
    assert counts() == {"run": 3, "changed": 1, "unchanged": 2, "removed": 1}
    (folder / "notes.md").write_text(old)  # back to an older content fires again
    query = watch.watch(spark, str(folder), store, str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    runs, now = watch.status(spark, store)
    assert runs.first()["changed"] == 1 and now.count() == 3
    assert watch.latest_units(spark, store).where("source like '%notes.md' and content = 'Notes'").count() == 1
