"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from veridex.shipping import ship


def build_session(cpus: int | str = "*", app: str = "veridex") -> SparkSession:
    """Local session for tests, bench and examples; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or a temporary one on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


class Stage:
    """Cuts lineage by writing a table to the shared folder and reading it back.

    Each write gets its own folder, so a lost executor only means that a file is read again.
    ``drop`` removes tables of earlier rounds of an iterative job. Operators that need a stage also need their code where
    they run, so the package is sent to the workers once.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veridex_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables, and lets the driver collect its garbage, on which the files of finished shuffles go."""
        for table in tables:
            path = getattr(table, "_veridex_path", None)
            if path:
                self._delete(path)
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # waiting events hold on to finished jobs
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Deletes every table of this stage; for jobs whose result has been written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
