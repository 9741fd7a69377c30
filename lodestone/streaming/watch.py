"""Watching a folder (T1 to T11): what changed since the last run, kept as tables.

A store is a folder of Parquet tables parted by run: ``files`` (path, hash), ``units`` of changed
files, and ``runs`` with the accounting. A run counts once its row in ``runs`` is written,
which comes last; what an interrupted run left behind is never read and is written anew.
Contents are compared by hash with the latest run, so a file that returns to an older
content fires again, and one that was only touched does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.selection import merge_listing
from lodestone.sources import files, formats

LISTING = "path string, modificationTime timestamp, length long, content binary"
RUNS = "run int, added long, changed long, unchanged long, removed long, failed long"
FILES = "path string, hash string, length long, modified timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def last_run(spark: SparkSession, store: str) -> int:
    if not _exists(spark, f"{store}/runs"):
        return 0
    return spark.read.schema(RUNS).parquet(f"{store}/runs").agg(F.max("run")).first()[0] or 0


def run_once(spark: SparkSession, root: str, store: str, quiet_seconds: int = 0, idle: bool = True) -> dict[str, int]:
    """One pass: extract what is new or changed, forget what is gone; the run's counts.

    The folder is listed first; only files whose length or time differ from the last run's are opened (T1). Files that changed within
    the last ``quiet_seconds`` wait for a later pass (T2, T3). With ``idle`` false a pass that finds nothing to do leaves no run.
    """
    n = last_run(spark, store)
    run = n + 1
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")  # files may go while a pass runs
    seen = there.load(root) if _exists(spark, root) else spark.createDataFrame([], LISTING)
    seen = seen.where(~F.col("path").rlike(r"/[._][^/]*$"))
    settled = F.col("modificationTime") <= F.expr(f"current_timestamp() - interval {int(quiet_seconds)} seconds")
    listing = seen.select("path", "length", F.col("modificationTime").alias("modified"), settled.alias("settled"))
    before = spark.read.schema(FILES).parquet(f"{store}/files/run={n}") if n else spark.createDataFrame([], FILES)
    old = before.select("path", F.col("hash").alias("old"), F.col("length").alias("old_length"), F.col("modified").alias("old_modified"))
    listed = listing.join(old, "path", "left").withColumn("touched", F.col("old").isNull() | (F.col("length") != F.col("old_length")) | (F.col("modified") != F.col("old_modified")))
    listed = listed.withColumn("open", F.col("touched") & F.col("settled")).cache()  # a row for each file
    try:
        todo = listed.where("open").count()
        gone = before.join(listing.select("path"), "path", "left_anti").count()
        if not idle and not todo and not gone:
            return {"run": n, "added": 0, "changed": 0, "unchanged": listed.where("old is not null").count(), "removed": 0, "failed": 0}
        hashed = seen.join(listed.where("open").select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("hash"), "length", F.col("modificationTime").alias("modified"))
        # a file that is still being written keeps its old entry, if it has one
        kept = listed.where("not open and old is not null").select("path", F.col("old").alias("hash"), F.col("old_length").alias("length"), F.col("old_modified").alias("modified"))
        kept.unionByName(hashed).write.mode("overwrite").parquet(f"{store}/files/run={run}")
    finally:
        listed.unpersist()
    current = spark.read.schema(FILES).parquet(f"{store}/files/run={run}")
    change = merge_listing(before.select("path", "hash"), current.select("path", "hash"))
    fresh = seen.join(change.where("change in ('added', 'changed')").select("path"), "path", "left_semi").select(F.col("path").alias("source"), "content")
    units = formats.extract(fresh.withColumn("kind", files.kind_of(F.col("source"), F.col("content"))))
    units.write.mode("overwrite").parquet(f"{store}/units/run={run}")
    counts = {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not idle and not any(counts.get(c) for c in ("added", "changed", "removed")):  # what was to be read went meanwhile
        return {"run": n, "added": 0, "changed": 0, "unchanged": counts.get("unchanged", 0), "removed": 0, "failed": 0}
    failed = spark.read.parquet(f"{store}/units/run={run}").where("modality = 'gap' and content like 'extraction-error%'").select("source").distinct().count()
    row = [run] + [counts.get(c, 0) for c in ("added", "changed", "unchanged", "removed")] + [failed]
    spark.createDataFrame([tuple(row)], RUNS).write.mode("append").parquet(f"{store}/runs")
    return dict(zip(("run", "added", "changed", "unchanged", "removed", "failed"), row, strict=True))


def status(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Finished runs, newest first, and the files of the last one (T11); none before the first run is finished."""
    n = last_run(spark, store)
    if not n:
        return spark.createDataFrame([], RUNS), spark.createDataFrame([], FILES)
    return spark.read.schema(RUNS).parquet(f"{store}/runs").orderBy(F.desc("run")), spark.read.schema(FILES).parquet(f"{store}/files/run={n}")


def latest_units(spark: SparkSession, store: str) -> DataFrame:
    """Units of all files that are there now, each from the last run that read it."""
    n = last_run(spark, store)
    units = spark.read.parquet(f"{store}/units").where(F.col("run") <= n)
    newest = units.groupBy("source").agg(F.max("run").alias("run"))
    here = spark.read.schema(FILES).parquet(f"{store}/files/run={n}").select(F.col("path").alias("source"))
    return units.join(newest, ["source", "run"], "left_semi").join(here, "source", "left_semi")


def errors(spark: SparkSession, store: str, most: int = 20) -> DataFrame:
    """The last ``most`` files that a reader refused, newest runs first (T11): (run, source, content)."""
    units = spark.read.parquet(f"{store}/units").where((F.col("run") <= last_run(spark, store)) & (F.col("modality") == "gap") & F.col("content").startswith("extraction-error"))
    return units.select("run", "source", "content").orderBy(F.desc("run"), "source", "content").limit(most)


def watch(spark: SparkSession, root: str, store: str, checkpoint: str, quiet_seconds: int = 30, once: bool = False, poll_seconds: int = 1):
    """A streaming query that makes passes (T1, T8): one whenever the folder differs; ``once`` ends after what is there.

    A clock drives it, not the arrival of files, so a file that has just settled and one that was deleted are seen without any other
    arriving. A poll lists the folder; it opens nothing and leaves no run where nothing differs.
    """
    if once:
        stream = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", "true").load(root).select("path")
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: run_once(df.sparkSession, root, store))
        return query.trigger(availableNow=True).start()
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = clock.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: run_once(df.sparkSession, root, store, quiet_seconds, idle=False))
    return query.trigger(processingTime=f"{poll_seconds} seconds").start()
