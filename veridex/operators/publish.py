"""Snapshot publishing without MERGE: validation by anti joins, the next snapshot as a union, then a new version folder.

A version becomes current by one rename of a small pointer file; pointers are numbered and never overwritten, so a crash at
any point leaves the last complete version current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def next_snapshot(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Staged rows as active, current rows that were not staged as inactive; a repeated staged key keeps one row.

    Of repeated keys the row with the largest content hash stays, so that the result does not depend on row order.
    """
    columns = [c for c in staged.columns if c != "is_active"]
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.xxhash64(*columns))))
    fresh = staged.where(F.col(key).isNotNull()).withColumn("turn", turn).where("turn = 1").select(*columns, F.lit(True).alias("is_active"))
    stale = current.join(staged.select(key).distinct(), key, "left_anti").select(*columns, F.lit(False).alias("is_active"))
    return fresh.unionByName(stale)


def publish_counts(current: DataFrame, staged: DataFrame, key: str, content: list[str]) -> DataFrame:
    """One row: inserted, updated, unchanged and deactivated keys of a publish."""
    a = current.select(F.col(key), F.xxhash64(*content).alias("old")).where(F.col(key).isNotNull()).groupBy(key).agg(F.max("old").alias("old"))
    b = staged.select(F.col(key), F.xxhash64(*content).alias("new")).where(F.col(key).isNotNull()).groupBy(key).agg(F.max("new").alias("new"))
    both = a.join(b, key, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(
        n(F.col("old").isNull()).alias("n_inserted"), n((F.col("old") != F.col("new"))).alias("n_updated"), n(F.col("old") == F.col("new")).alias("n_unchanged"), n(F.col("new").isNull()).alias("n_deactivated")
    )


def superseded(runs: DataFrame, by: str, started: str, run: str) -> DataFrame:
    """Runs that a later run of the same source overtook: (by, run, started)."""
    later = runs.select(F.col(by).alias("b"), F.col(started).alias("s")).groupBy("b").agg(F.max("s").alias("latest"))
    return runs.join(later, F.col(by) == F.col("b")).where(F.col(started) < F.col("latest")).select(by, run, started)


def rejections(runs: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, code, n) of staged runs that must not be published.

    ``runs`` has run, source, started, status; ``documents`` run, id, source; ``chunks`` run, id, document_id. Codes:
    not_running; superseded by a later succeeded run of its source; source_mismatch of staged documents; dangling_chunk
    whose document is not in the same run. A batch of runs is checked by joins, none of them one run at a time.
    """
    waiting = runs.where("status = 'running'")
    idle = runs.where("status not in ('running', 'succeeded')").groupBy("run").agg(F.count("*").alias("n")).select("run", F.lit("not_running").alias("code"), "n")
    newer = runs.where("status = 'succeeded'").groupBy("source").agg(F.max("started").alias("latest"))
    late = waiting.join(newer, "source").where("started < latest").groupBy("run").agg(F.count("*").alias("n")).select("run", F.lit("superseded").alias("code"), "n")
    other = documents.withColumnRenamed("source", "staged_source").join(waiting.select("run", "source"), "run").where(~F.col("staged_source").eqNullSafe(F.col("source")))
    other = other.groupBy("run").agg(F.count("*").alias("n")).select("run", F.lit("source_mismatch").alias("code"), "n")
    loose = chunks.join(waiting.select("run"), "run").join(documents.select("run", F.col("id").alias("document_id")).distinct(), ["run", "document_id"], "left_anti")
    loose = loose.groupBy("run").agg(F.count("*").alias("n")).select("run", F.lit("dangling_chunk").alias("code"), "n")
    return idle.unionByName(late).unionByName(other).unionByName(loose)


def publish_runs(runs: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, source, status, records_seen, chunks_seen, problems): the ledger rows of staged runs after publishing.

    Runs without rejection succeed with their counts; others fail with their codes and publish nothing.
    """
    bad = rejections(runs, documents, chunks).groupBy("run").agg(F.array_join(F.sort_array(F.collect_set("code")), "|").alias("problems"))
    n = lambda df, name: df.groupBy("run").agg(F.count("*").alias(name))
    rows = runs.where("status <> 'succeeded'").join(bad, "run", "left").join(n(documents, "d"), "run", "left").join(n(chunks, "c"), "run", "left")
    fine = F.col("problems").isNull()
    count = lambda c: F.when(fine, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return rows.select("run", "source", F.when(fine, "succeeded").otherwise("failed").alias("status"), count(F.col("d")).alias("records_seen"), count(F.col("c")).alias("chunks_seen"), F.coalesce("problems", F.lit("")).alias("problems"))


def aborted(runs: DataFrame, run: str, message: str) -> DataFrame:
    """The ledger with one running run marked failed and its message cut at 500 signs; other runs are as they were."""
    hit = (F.col("run") == run) & (F.col("status") == "running")
    old = F.col("error_message") if "error_message" in runs.columns else F.lit(None).cast("string")
    return runs.withColumn("error_message", F.when(hit, F.lit(message[:500])).otherwise(old)).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))


class NoSnapshot(LookupError):
    """Nothing has been published yet."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of complete pointer files in order; each is number-version."""
    fs, place = _files(spark, f"{root}/pointers")
    return sorted(f.getPath().getName() for f in fs.listStatus(place) if not f.getPath().getName().startswith((".", "_"))) if fs.exists(place) else []


def point_to(spark: SparkSession, root: str, run_id: str) -> None:
    """Makes a complete version current: an empty file is written aside and renamed to the next number."""
    number = int(_pointers(spark, root)[-1].split("-", 1)[0]) + 1 if _pointers(spark, root) else 1
    fs, aside = _files(spark, f"{root}/aside/{run_id}")
    fs.create(aside, True).close()
    _, folder = _files(spark, f"{root}/pointers")
    fs.mkdirs(folder)
    _, target = _files(spark, f"{root}/pointers/{number:012d}-{run_id}")
    if not fs.rename(aside, target):
        raise OSError(f"cannot make {run_id} current")


def current_version(spark: SparkSession, root: str) -> str | None:
    names = _pointers(spark, root)
    return names[-1].split("-", 1)[1] if names else None


def is_complete(spark: SparkSession, root: str, run_id: str) -> bool:
    fs, done = _files(spark, f"{root}/versions/{run_id}/_SUCCESS")
    return bool(fs.exists(done))


def write_version(spark: SparkSession, snapshot: DataFrame, root: str, run_id: str) -> str:
    """Writes the snapshot to its own folder and makes it current; readers of an older version are not disturbed.

    Parts of a version that a crash left behind are replaced; a complete one is not written again.
    """
    path = f"{root}/versions/{run_id}"
    if not is_complete(spark, root, run_id):
        snapshot.write.mode("overwrite").parquet(path)
    if current_version(spark, root) != run_id:
        point_to(spark, root, run_id)
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The current snapshot. Raises NoSnapshot only where nothing was ever published; a failed read stays an error."""
    run_id = current_version(spark, root)
    if run_id is None:
        raise NoSnapshot(root)
    return spark.read.parquet(f"{root}/versions/{run_id}")
