"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes the documents that its predecessor kept and returns their columns, whatever those are;
the last returns the packed pieces. Stages decide by rows: null, repeated and shared ids are rows like any other. Null and empty texts are
kept by every filter and have a piece of their end id alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, jaccard, packing, repeats, toxicity
from lodestone.llm.queries import held_out, vocabulary
from lodestone.session import ship, table, written


def _aside(docs: DataFrame) -> DataFrame:
    """The text and the id, with all other columns put away in one, whatever their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row"))


def _back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; all columns stay."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return _back(toxicity.score(_aside(docs), model).where("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies, one row stays: one of the least id, whether ids are repeated, shared or null."""
    ship(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 100-byte strings that also start earlier go; documents stay, with what is left of them."""
    ship(spark)
    out = _back(repeats.remove_repeats(_aside(docs), 100), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    ship(spark)
    found = decontam.find_leaks(_aside(docs), table(spark, sf_dir, "benchmark"))
    return _back(found.where(F.size("leaks") == 0), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, each with its sequence and its offset there."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary(), 2048, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained models, suffix arrays and packing are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
