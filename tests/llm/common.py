"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows."""

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "The cat sat on the mat and looked at the idiot dog.", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "A row without an id that has some words.", "en", "a", 1),
    (5, "The cat sat on the mat and looked at the idiot dog.", "en", "a", 10), (6, LONG, "en", "c", 5), (7, "Straße über Öl, dürfen!", "de", "c", 5), (7, "Straße über Öl, dürfen!", "de", "c", 5), (8, "?!", "fr", "c", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def table(sf, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()
