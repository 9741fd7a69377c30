import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import cells, presentation
from lodestone.plans import budget, extensions


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [("M", 2, 1, "Nodes", None), ("M", 2, 2, "8", None), ("M", 3, 1, "Rate", None), ("M", 3, 2, "450", None), ("M", 7, 1, "Total", None), ("M", 7, 2, "3600", "B2*$B$3*0.87"), ("S", 1, 2, "x", "SUM(M!B7,'M'!B2)+1")]
    return spark.createDataFrame(rows, "sheet string, row int, col int, value string, formula string")


def test_cells(sheet):
    at = lambda df: sorted((r["sheet"], r["row"], r["col"]) for r in df.collect())
    assert {(r["row"], r["label"]) for r in cells.labels(sheet).where("sheet = 'M' and col = 2").collect()} == {(2, "Nodes"), (3, "Rate"), (7, "Total")}
    assert {(r["p_sheet"], r["p_row"], r["p_col"]) for r in cells.precedents(sheet).where("sheet = 'S'").collect()} == {("M", 7, 2), ("M", 2, 2)}
    assert at(cells.inputs(sheet)) == [("M", 2, 2), ("M", 3, 2)] and at(cells.outputs(sheet)) == [("S", 1, 2)]
    used = {r["sheet"]: (r["functions"], r["literals"]) for r in cells.functions_used(sheet).collect()}
    assert used == {"M": ([], ["0.87"]), "S": (["SUM"], [])}


def test_column_numbers(spark):
    df = spark.createDataFrame([("A", 1), ("Z", 26), ("AA", 27), ("xfd", 16384)], "c string, n int")
    assert df.where(cells.column_number(F.col("c")) != F.col("n")).count() == 0


def test_presentation(spark):
    units = spark.createDataFrame([(f"u{i}", "s", i) for i in range(10)], "unit_id string, source string, i int")
    got = presentation.presented_units(units, units.where("i = 9"), [F.col("i")], "standard")
    assert sorted(r["i"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 9]
    kept, more = presentation.capped(units, "source", [F.col("i")], 4)
    assert kept.count() == 4 and more.first()["suppressed"] == 6
    assert presentation.first_and_more(units, "source", "unit_id").first()["text"].endswith("u7 and 2 more")
    heads = spark.createDataFrame([("s", 0, "a"), ("s", 1, "a"), ("s", 2, "b")], "source string, position int, name string")
    assert [r["name"] for r in presentation.unique_headers(heads).orderBy("position").collect()] == ["a", "a [2]", "b"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=30), st.integers(60, 900))
def test_budgets_are_exact_and_tight(texts, most):
    units = [{"content": t} for t in texts]
    text = budget.bundle_json(units, most)
    got = json.loads(text)
    assert got["used"] == len(text.encode()) <= most
    k = len(got["units"])
    if k < len(units):
        body = {"schema": 2, "omitted": len(units) - k - 1, "units": units[: k + 1], "used": 10**9}
        assert len(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()) > most - 10


def test_budget_too_small():
    with pytest.raises(budget.TooSmall) as e:
        budget.bundle_json([{"content": "x"}], 10)
    assert len(budget.bundle_json([{"content": "x"}], e.value.least).encode()) <= e.value.least


def test_registry():
    r = extensions.Registry()
    good = extensions.ReaderSpec("mine", "mine", lambda data: iter([("prose", data.decode(), "all", 0.5, None, {})]), ("mine",), ((0, b"MY"), (-2, b"ME")))
    bad = extensions.ReaderSpec("other", "json", lambda data: iter(()), ("zzz",))
    with pytest.raises(ValueError):
        r.register(good, bad)
    assert not r.readers
    r.register(good)
    assert good.matches(b"MYxx") and good.matches(b"xxME") and not good.matches(b"xx")
    assert [u[1] for u in r.kind_readers()["mine"](b"hi")] == ["hi"]
    with pytest.raises(ValueError):
        list(extensions.checked(extensions.ReaderSpec("w", "w", lambda data: iter([("prose", "", "a", 0.5, None, {})])))(b""))
