"""SQL names for the engine's functions, so that plain Spark SQL can use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex import engine
from veridex.functions import text
from veridex.functions import vocabulary as V
from veridex.operators import retrieval

_PLAIN = r"regexp_replace(regexp_replace(lower(query), '(?U)\\s+', ' '), '^ | $', '')"
_WORDS = rf"""concat(regexp_extract_all({_PLAIN}, '([a-z][a-z0-9+.-]{{1,}})', 1),
    flatten(transform(regexp_extract_all({_PLAIN}, '([\\x{{4e00}}-\\x{{9fff}}]+)', 1), r -> if(length(r) <= 2, array(r), transform(sequence(1, length(r) - 1), i -> substring(r, i, 2))))),
    regexp_extract_all({_PLAIN}, '(?U)(\\b[0-9]+(?:\\.[0-9]+)?\\b)', 1))"""


def register_search(documents: DataFrame, view: str = "search", index: retrieval.Index | None = None) -> retrieval.Index:
    """Registers the tables of an index for SQL, and a table function ``<view>(query, k)`` that ranks documents by BM25.

    Tables are ``<view>_postings`` (term, id, tf, len, norm), ``<view>_terms`` (term, df) and ``<view>_shape`` (n, avg_len).
    The function gives (id, score, published_year, place): at most 1 to 100 rows by score, later year first, then id.
    """
    spark = documents.sparkSession
    register_text(spark)
    index = index or engine.document_index(documents)
    index.postings.createOrReplaceTempView(f"{view}_postings")
    index.terms.createOrReplaceTempView(f"{view}_terms")
    index.shape.createOrReplaceTempView(f"{view}_shape")
    documents.select(F.col("doc_id").cast("long").alias("id"), F.col("published_year").cast("int").alias("published_year")).createOrReplaceTempView(f"{view}_documents")
    stop = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
    k1, b = V.BM25_K1, V.BM25_B
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {view}(query STRING, k INT) RETURNS TABLE (id BIGINT, score DOUBLE, published_year INT, place INT) RETURN
        SELECT id, score, published_year, place FROM (
            SELECT s.id, s.score, d.published_year, row_number() OVER (ORDER BY s.score DESC, d.published_year DESC NULLS LAST, s.id) AS place FROM (
                SELECT p.id, round(sum(a.qtf * ln(1 + (h.n - t.df + 0.5) / (t.df + 0.5)) * p.tf * {k1 + 1} / (p.tf + {k1} * (1 - {b} + {b} * p.len / h.avg_len))), 9) AS score
                FROM (SELECT term, count(*) AS qtf FROM (SELECT explode({_WORDS}) AS term) WHERE term NOT IN ({stop}) GROUP BY term) a
                JOIN {view}_terms t ON t.term = a.term JOIN {view}_postings p ON p.term = a.term AND p.folder = pmod(xxhash64(a.term), {index.folders}) CROSS JOIN {view}_shape h GROUP BY p.id) s
            JOIN {view}_documents d ON d.id = s.id) WHERE place <= least(greatest(k, 1), 100)""")
    return index


def register_text(spark: SparkSession) -> None:
    """``veridex_normalize(text)`` and ``veridex_hash(text)`` as SQL functions; both stay inside the JVM."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION veridex_normalize(t STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(t), '(?U)\\s+', ' '), '^ | $', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION veridex_hash(t STRING) RETURNS STRING RETURN sha2(veridex_normalize(t), 256)")


def same_as_columns(spark: SparkSession, rows: DataFrame, column: str) -> bool:
    """Whether the SQL functions agree with the column builders on every row."""
    register_text(spark)
    return rows.where(~F.expr(f"veridex_hash({column})").eqNullSafe(text.text_hash(F.col(column)))).isEmpty()
