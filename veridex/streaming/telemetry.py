"""Structured Streaming: windowed telemetry with late data, and incremental snapshot publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridex.operators.publish import NoSnapshot, current_version, is_complete, next_snapshot, point_to, read_current, write_version
from veridex.session import Stage

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a folder of Parquet files, or of one file through its folder."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def stage_windows(events: DataFrame, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """(bucket, event_type, n, total): events and summed values per window.

    An event that is later than ``late`` behind the newest event of earlier batches is dropped, and the state of windows
    that old is given up, so state does not grow with the stream. Run it in update mode.
    """
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def run_available(spark: SparkSession, stream: DataFrame, *keys: str) -> DataFrame:
    """Runs a stream over what is available in update mode; the last row of each key as a table of the shared folder.

    A batch writes only the windows it changed. Results are kept per batch, so a batch that runs again after a failure
    takes the place of its own rows.
    """
    stage = Stage(spark, "stream")
    keys = keys or ("bucket", "event_type")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{stage.root}/batches/number={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{stage.root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{stage.root}/batches")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{stage.root}/batches").drop("number")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("turn", last).where("turn = 1").drop("turn", "batch")


def publish_stream(spark: SparkSession, staged: DataFrame, root: str, key: str, progress: str) -> None:
    """Publishes each batch of a stream of staged rows as the next snapshot version.

    A batch whose version is complete but not yet current, as a crash between the two leaves it, only becomes current; one
    that is current, or was before a later one, is skipped. Only a store without any version starts empty: if the current
    one cannot be read, the stream fails and nothing is published.
    """

    def publish(batch: DataFrame, number: int) -> None:
        run = f"batch-{number:08d}"
        now = current_version(spark, root)
        if now is not None and now.startswith("batch-") and now >= run:
            return
        if is_complete(spark, root, run):
            point_to(spark, root, run)
            return
        try:
            current = read_current(spark, root)
        except NoSnapshot:
            current = batch.limit(0).withColumn("is_active", F.lit(True))
        write_version(spark, next_snapshot(current, batch, key), root, run)

    staged.writeStream.foreachBatch(publish).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
