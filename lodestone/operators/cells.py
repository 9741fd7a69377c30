"""Spreadsheet cells as a table: labels, formulas and what they depend on.

``cells(sheet, row, col, value, formula)``: ``row`` and ``col`` count from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import formulas


def column_number(letters: Column) -> Column:
    """Number of a column's letters: A is 1, Z 26, AA 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def labels(cells: DataFrame, reach: int = 3) -> DataFrame:
    """``cells`` with ``label``: the nearest text to the left within ``reach`` columns, else the nearest above."""
    text = F.when(F.col("formula").isNull() & F.col("value").isNotNull() & ~F.col("value").rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"), F.col("value"))
    left = Window.partitionBy("sheet", "row").orderBy("col").rangeBetween(-reach, -1)
    above = Window.partitionBy("sheet", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    found = cells.withColumn("_text", text)
    return found.withColumn("label", F.coalesce(F.last("_text", True).over(left), F.last("_text", True).over(above))).drop("_text")


def _per_formula(cells: DataFrame, schema: str, rows) -> DataFrame:
    """Rows made from each formula cell's (sheet, row, col, formula)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[x.split()[1]]) for x in schema.split(", ")])
        for b in batches:
            out = [r for cell in b.to_pylist() for r in rows(cell)]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return cells.where("formula is not null").select("sheet", "row", "col", "formula").mapInArrow(run, schema)


def precedents(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, p_sheet, p_row, p_col): cells that each formula names; of a range, its corners."""

    def rows(c: dict):
        for sheet, letters, row in formulas.cells_of(c["formula"], c["sheet"]):
            yield {"sheet": c["sheet"], "row": c["row"], "col": c["col"], "p_sheet": sheet, "p_row": row, "p_col": formulas.column_number(letters)}

    return _per_formula(cells, "sheet string, row int, col int, p_sheet string, p_row int, p_col int", rows)


def inputs(cells: DataFrame) -> DataFrame:
    """Cells with a value that formulas use but no formula makes."""
    used = precedents(cells).select(F.col("p_sheet").alias("sheet"), F.col("p_row").alias("row"), F.col("p_col").alias("col")).distinct()
    return cells.where("formula is null and value is not null").join(used, ["sheet", "row", "col"], "left_semi")


def outputs(cells: DataFrame) -> DataFrame:
    """Formula cells that no other formula uses."""
    used = precedents(cells).where("not (sheet = p_sheet and row = p_row and col = p_col)").select(F.col("p_sheet").alias("sheet"), F.col("p_row").alias("row"), F.col("p_col").alias("col"))
    return cells.where("formula is not null").join(used, ["sheet", "row", "col"], "left_anti")


def functions_used(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, functions, literals): function names and telling bare numbers in each formula."""

    def rows(c: dict):
        yield {"sheet": c["sheet"], "row": c["row"], "col": c["col"], "functions": formulas.functions_of(c["formula"]), "literals": formulas.numbers_of(c["formula"])}

    return _per_formula(cells, "sheet string, row int, col int, functions array<string>, literals array<string>", rows)
