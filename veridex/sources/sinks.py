"""Writers: JSON snapshots, the vector index with its sidecar, append-only run records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions import vector


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_records(rows: DataFrame, path: str, *by: str) -> None:
    """Appends run records in folders per arm and repeat; question texts are not part of a record."""
    rows.drop("question", "text").write.mode("append").partitionBy(*by).json(path)


def write_vector_index(items: DataFrame, root: str, corpus_version: str, model: str) -> str:
    """Normalised vectors and a sidecar row; an existing version is never overwritten. Bad vectors raise an error."""
    unit = items.select("id", "source", F.col("vec"), vector.unit(F.col("vec")).alias("unit"))
    shape = unit.agg(F.count("*").alias("n"), F.count("unit").alias("good"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.bit_xor(F.xxhash64("id", "unit")).alias("checksum")).first()
    if shape["n"] != shape["good"] or shape["low"] != shape["high"]:
        raise ValueError("vectors must be finite, not zero, and of one length")
    path = f"{root}/{corpus_version}/{model}"
    unit.select("id", "source", F.col("unit").alias("vec")).write.mode("errorifexists").parquet(f"{path}/vectors")
    side = [(corpus_version, model, int(shape["low"] or 0), int(shape["n"]), int(shape["checksum"] or 0))]
    items.sparkSession.createDataFrame(side, "corpus_version string, model string, dimension int, item_count long, checksum long").coalesce(1).write.mode("errorifexists").json(f"{path}/meta")
    return path


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """The index after its count, dimension and checksum have been held against the sidecar."""
    vectors = spark.read.parquet(f"{path}/vectors")
    meta = spark.read.schema("corpus_version string, model string, dimension int, item_count long, checksum long").json(f"{path}/meta").first()
    own = vectors.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.bit_xor(F.xxhash64("id", "vec")).alias("x")).first()
    if (own["n"], own["x"] or 0) != (meta["item_count"], meta["checksum"]) or (own["n"] and not own["low"] == own["high"] == meta["dimension"]):
        raise ValueError("the vector index does not agree with its sidecar")
    return vectors


def write_cache(documents: DataFrame, root: str, key: str) -> str:
    """Writes cached documents aside and renames them into place, so that readers see a whole entry or none."""
    spark = documents.sparkSession
    aside, target = f"{root}/aside-{uuid.uuid4().hex}", f"{root}/{key}"
    documents.coalesce(1).write.json(aside)
    old, new = spark._jvm.org.apache.hadoop.fs.Path(aside), spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(new):
        fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"cannot place {target}")
    return target


def write_report(rows: DataFrame, root: str) -> None:
    """A report as JSON lines and as CSV with a header; an existing report is an error."""
    rows.write.mode("errorifexists").json(f"{root}/json")
    flat = rows.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("errorifexists").option("header", True).csv(f"{root}/csv")


def write_blind(items: DataFrame, public: list[str], key: str, alias: str, open_root: str, private_root: str) -> None:
    """Blind package: whitelisted columns under their alias to one folder, the mapping of aliases to keys to another."""
    if open_root.rstrip("/").startswith(private_root.rstrip("/")) or private_root.rstrip("/").startswith(open_root.rstrip("/")):
        raise ValueError("the mapping must not lie in the public folder")
    if key in public:
        raise ValueError("the key itself is not public")
    items.select(alias, *public).write.mode("errorifexists").json(open_root)
    items.select(alias, key).write.mode("errorifexists").json(private_root)


def stage_rows(rows: DataFrame, root: str, run_id: str, table: str, key: str) -> str:
    """Staged rows of a run as (id, payload) with the row as JSON; staging the same table of a run again replaces it."""
    path = f"{root}/staging/{run_id}/{table}"
    rows.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct("*")).alias("payload")).write.mode("overwrite").parquet(path)
    return path


def staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a staged table in the columns of a schema; payload fields that are not in it are left out."""
    return spark.read.parquet(path).select(F.from_json("payload", schema).alias("s")).select("s.*")


def write_candidate(documents: DataFrame, chunks: DataFrame, root: str, corpus_version: str, parser_version: str) -> str:
    """A corpus candidate as an immutable version: documents, chunks whose document is there, and a manifest with counts and digests."""
    path = f"{root}/{corpus_version}"
    kept = chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    documents.write.mode("errorifexists").parquet(f"{path}/documents")
    kept.write.mode("errorifexists").parquet(f"{path}/chunks")
    spark = documents.sparkSession
    sides = []
    for name in ("documents", "chunks"):
        table = spark.read.parquet(f"{path}/{name}")
        sides.append(table.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(*table.columns)).alias("digest")))
    manifest = sides[0].unionByName(sides[1]).select(F.lit(corpus_version).alias("corpus_version"), F.lit(parser_version).alias("parser_version"), "table", "n", "digest")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return path
