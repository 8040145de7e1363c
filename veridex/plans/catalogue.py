"""Queries of the engine's own operators over the whole given tables; the SQL that answers the same is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridex import engine
from veridex.functions import identity, text
from veridex.operators import audit, components, evaluation, gates, governance, pool, publish, retrieval, verification
from veridex.plans.oracle import oracle_sql  # noqa: F401 - part of this module's contract
from veridex.session import Stage, read_table
from veridex.sources.readers import document_chunks
from veridex.streaming import telemetry

Query = Callable[[SparkSession, str], DataFrame]
YEAR = 2025


def golden(spark: SparkSession, d: str) -> DataFrame:
    """The stated set of searches: golden questions whose number is divisible by 100, each id once."""
    rows = read_table(spark, d, "test_set").where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 100 == 0)
    return rows.groupBy("id").agg(F.min("question").alias("question"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the text that searches read; nulls read as empty."""
    return read_table(spark, d, "documents").withColumn("searchable", engine.searchable(F.col("title"), F.col("topic"), F.col("text")))


def document_index(spark: SparkSession, d: str) -> retrieval.Index:
    return retrieval.kept_index(spark, "documents", [f"{d}/documents.parquet"], lambda: engine.document_index(read_table(spark, d, "documents")))


def field_index(spark: SparkSession, d: str) -> retrieval.Index:
    return retrieval.kept_index(spark, "fields", [f"{d}/documents.parquet"], lambda: retrieval.build_index(read_table(spark, d, "documents"), "doc_id", [(F.col("title"), 1.4), (F.col("text"), 1.0)]))


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """(id, doc_id, text): the latest row of each chunk id. Only rows of ids that are repeated meet."""
    chunks = read_table(spark, d, "chunks").select("id", "doc_id", "text", "updated_at")
    repeated = retrieval.near(Stage(spark, "repeated").write(chunks.groupBy("id").count().where("count > 1 and id is not null").select("id")))
    once = chunks.where("id is not null").join(repeated, "id", "left_anti").select("id", "doc_id", "text")
    again = chunks.join(repeated, "id", "left_semi").unionByName(chunks.where("id is null"))
    return once.unionByName(again.groupBy("id").agg(F.max(F.struct("updated_at", "text", "doc_id")).alias("x")).select("id", "x.doc_id", "x.text"))


def chunk_index(spark: SparkSession, d: str) -> retrieval.Index:
    return retrieval.kept_index(spark, "chunks", [f"{d}/chunks.parquet"], lambda: retrieval.build_index(latest_chunks(spark, d), "id", F.col("text")))


def _best(spark: SparkSession, d: str, *kinds: str, index: retrieval.Index | None = None) -> DataFrame:
    return retrieval.best(retrieval.query_terms(golden(spark, d), "id", F.col("question")), index or document_index(spark, d), kinds=kinds)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_bm25(_best(spark, d, "bm25")).select("q", "id", "bm25", "rank")


def tfidf_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_cosine(_best(spark, d, "cosine")).select("q", "id", "cosine", "rank")


def _rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both rankings of one pass over the index."""
    found = Stage(spark, "rankings").write(_best(spark, d, "bm25", "cosine"))
    return retrieval.top_bm25(found).select("q", "id", "bm25", "rank"), retrieval.top_cosine(found).select("q", "id", "cosine", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    lists = _rankings(spark, d)
    return retrieval.rrf(lists[0].select("q", "id", "rank").union(lists[1].select("q", "id", "rank")))


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """Written once, because the metrics and gates built on it read it several times."""
    return Stage(spark, "lexical").write(retrieval.lexical_search(golden(spark, d), "id", F.col("question"), document_index(spark, d), 40))


def fts_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.field_search(golden(spark, d), "id", F.col("question"), field_index(spark, d))


def per_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    owners = latest_chunks(spark, d).select("id", "doc_id")
    top = retrieval.top_bm25(_best(spark, d, "bm25", index=chunk_index(spark, d))).join(owners, "id")
    return retrieval.cap_per_document(top, "doc_id").select("q", "id", "doc_id", "rank")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def dense_knn(spark: SparkSession, d: str) -> DataFrame:
    every = _vectors(spark, d)
    return retrieval.dense_knn(every.where("id % 100 = 0").withColumnRenamed("id", "q"), every, 30)


def dense_multi_variant_rrf(spark: SparkSession, d: str) -> DataFrame:
    every = _vectors(spark, d)
    variants = every.where("id % 100 in (0, 1)").select((F.col("id") - F.col("id") % 100).alias("q"), (F.col("id") % 100).alias("variant"), "vec")
    return retrieval.dense_search(variants, every, 30)


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    words, angles = _rankings(spark, d)
    lists = [words.withColumnRenamed("bm25", "score"), angles.withColumnRenamed("cosine", "score")]
    owner = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("nlm_unique_id", F.lit("")).alias("doc"))
    return retrieval.hybrid_fusion([x.where("rank <= 30") for x in lists], owner)


def static_merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    words, angles = _rankings(spark, d)
    return retrieval.merge_unseen(words.where("rank <= 25"), angles)


def _pool_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    own = identity.document_identity(F.col("source"), F.col("record_id"), F.col("record_id"), F.lit(""))
    return docs.select(F.col("title"), F.coalesce("topic", F.lit("")).alias("q"), F.col("record_id").alias("id"), own.alias("identity"), "text", "source", F.round(F.col("n_chars") / 1000.0, 6).alias("score"), F.coalesce("nlm_unique_id", F.lit("")).alias("family"), F.col("doc_id").alias("pos"))


def pool_source_preserving(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose identity stands with two different titles are set aside as conflicted."""
    rows = _pool_rows(spark, d)
    conflicted = pool.conflicts(rows.select("identity", F.lit("title").alias("kind"), text.normalize(F.col("title")).alias("value")))
    kept = pool.preserve_sources(rows.select("q", "id", "identity", "text", "source", "score"), conflicted)
    return kept.groupBy("q", "reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def pool_legacy(spark: SparkSession, d: str) -> DataFrame:
    kept = pool.legacy_pool(_pool_rows(spark, d))
    return kept.groupBy("q", "reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    values = {"journal": F.col("journal"), "published_year": F.col("published_year").cast("string"), "title": text.normalize(F.col("title"))}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])
    aliases = docs.select(F.regexp_extract("record_id", r"(\d+)$", 1).alias("identity"), F.explode(kinds).alias("x")).select("identity", "x.kind", "x.value")
    return pool.conflicts(aliases)


def independent_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.coalesce("topic", F.lit("")).alias("q"), F.col("doc_id").cast("string").alias("item"), "record_id", "title", "nlm_unique_id")
    keys = F.array(F.concat(F.lit("r"), F.regexp_extract("record_id", r"(\d+)$", 1)), F.concat(F.lit("t"), F.col("title")))
    return components.independent_sources(docs.select("q", "item", F.explode(keys).alias("key")))


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    """(q, id, rank, score, role): the first 40 of each question, scored again with statistics over the question's own pool.
    Written, without texts."""
    docs = engine.described(read_table(spark, d, "documents"))

    def score(found: DataFrame) -> DataFrame:
        rows = retrieval.near(found).join(docs, "id")
        local = retrieval.local_scores(retrieval.of_rows(golden(spark, d), "id", found), "id", F.col("question"), rows, F.col("searchable"))
        return pool.rerank(rows.select("q", "id", "retrieval", "source", "level").join(local, ["q", "id"]), 40)

    ranking = retrieval.in_blocks(lexical_search(spark, d).select("q", "id", F.col("score").alias("retrieval")), "q", score)
    return ranking.select("q", "id", "rank", "score", "role")


def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).where("rank <= 8").select("q", "id", "rank", "score", "role")


def _described(spark: SparkSession, d: str, rows: DataFrame, *columns: str | Column, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """What ``then`` makes of written rows (q, id, ...) with columns of their documents, which are read for them where they lie."""
    docs = engine.described(read_table(spark, d, "documents")).select("id", *columns)
    return retrieval.in_blocks(rows, "q", lambda own: then(retrieval.near(own).join(docs, "id")))


def topk_document_diverse(spark: SparkSession, d: str) -> DataFrame:
    entries = _described(spark, d, _reranked(spark, d).select("q", "id", "score"), "identity", "family")
    return pool.document_diverse(entries.withColumn("id", F.col("id").cast("string")))


def mmr_packet(spark: SparkSession, d: str) -> DataFrame:
    top = _reranked(spark, d).where("rank <= 8").select("q", "id", F.col("rank").alias("citation_number"), "role", "score")
    named = _described(spark, d, top, "study").withColumnRenamed("study", "family")
    return _described(spark, d, named, "text", then=pool.packet)


def _specs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "test_set").groupBy("id").agg(F.min("question").alias("question"))
    return gates.specify(rows, "id", "question", YEAR)


def query_spec(spark: SparkSession, d: str) -> DataFrame:
    s = _specs(spark, d)
    return s.select("q", F.sha2("safe_query", 256).alias("safe_hash"), F.array_join("domains", "|").alias("domains"), F.array_join("expected_types", "|").alias("expected_types"), "contains_phi", "personalized", "out_of_scope", "unverifiable", "needs_latest")


def safety_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates.safety(_specs(spark, d))


def coverage_partition(spark: SparkSession, d: str) -> DataFrame:
    ranking = _reranked(spark, d).select("q", "id")
    asked = Stage(spark, "focus").write(gates.focused(retrieval.of_rows(_specs(spark, d), "q", ranking)))
    return _described(spark, d, ranking, "topic", "text", then=lambda rows: gates.coverage(rows.join(retrieval.near(asked), "q")))


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    asked = golden(spark, d).select(F.col("id").alias("q"))
    out = gates.evidence_gate(_specs(spark, d).join(asked, "q"), _described(spark, d, _reranked(spark, d).where("rank <= 8"), "topic", "level", "source", "identity", "family", "aliases", "text"))
    return out.select("q", "code", F.col("n_entries").cast("long").alias("n_entries"), F.col("n_sources").cast("long").alias("n_sources"), F.array_join("levels", "|").alias("levels"))


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return gates.query_variants(_specs(spark, d)).select("q", "variant", F.sha2("text", 256).alias("text_hash"))


def _citations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Key points and questions of the golden set as claims on the documents they name, some of them unknown or without an address."""
    rows = read_table(spark, d, "test_set").groupBy("id").agg(F.min(F.struct("question", "relevant_doc_ids", "expected_key_points")).alias("x"))
    texts = F.array_distinct(F.concat(F.array("x.question"), F.coalesce("x.expected_key_points", F.array().cast("array<string>"))))
    claims = rows.select("id", F.col("x.relevant_doc_ids").alias("citations"), F.posexplode(texts).alias("at", "text"))
    docs = engine.described(read_table(spark, d, "documents"))
    entries = docs.select(F.col("id").alias("citation"), "title", F.col("published_year").alias("year"), F.lit(None).cast("string").alias("status"), "text", "source", F.col("canonical").alias("identity"), "url")
    return claims.select(F.concat_ws("/", "id", F.col("at").cast("string")).alias("claim_id"), "id", "text", "citations"), entries


def _verified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    claims, entries = _citations(spark, d)
    return claims, verification.verify(claims, entries)


def claim_verify(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d)[1]


def claim_overlap(spark: SparkSession, d: str) -> DataFrame:
    claims, entries = _citations(spark, d)
    spread = claims.select("claim_id", F.col("text").alias("claim"), F.explode("citations").alias("citation")).distinct()
    return spread.join(entries.select("citation", "title", "text"), "citation").select("claim_id", "citation", F.round(text.overlap(F.col("claim"), F.concat_ws(" ", "title", "text")), 6).alias("overlap"))


def sanitize_claims(spark: SparkSession, d: str) -> DataFrame:
    return verification.sanitise(*_verified(spark, d)).select("claim_id", "text", F.array_join("citations", "|").alias("citations"))


def answer_failure(spark: SparkSession, d: str) -> DataFrame:
    claims, verified = _verified(spark, d)
    return verification.answer_checks(claims, verification.claim_checks(verified), "id")


def numeric_consistency(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks").where("text is not null").select("id", "doc_id", F.col("text").alias("claim")).distinct()
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    ok = F.size(F.array_except(text.numbers(F.col("claim")), text.numbers(F.col("text")))) == 0
    return chunks.join(docs, "doc_id").groupBy("id").agg(F.min(ok.cast("int")).alias("numbers_agree"))


def polarity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Denials of titles held against their documents: a text that states its title contradicts the denial."""
    docs = read_table(spark, d, "documents").select("source", F.concat(F.lit("not "), F.coalesce("title", F.lit(""))).alias("claim"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(text.polarity_conflict(F.col("claim"), F.col("text")), 1)).alias("n_conflicts"))


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    asked = golden(spark, d).select(F.col("id").alias("q"))
    return read_table(spark, d, "test_set").select(F.col("id").alias("q"), F.explode("relevant_doc_ids").alias("id")).distinct().join(asked, "q")


def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.binary_metrics(lexical_search(spark, d).select("q", "id", "rank"), _relevant(spark, d))


def graded_metrics(spark: SparkSession, d: str) -> DataFrame:
    topics = read_table(spark, d, "test_set").select(F.col("id").alias("q"), F.explode("relevant_topics").alias("topic")).distinct().withColumn("on_topic", F.lit(1))
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "topic")
    ranking = lexical_search(spark, d).select("q", "id", "rank")
    found = ranking.select("q", "id").join(docs, "id").where("topic <> ''").join(topics, ["q", "topic"], "left").select("q", "id", F.coalesce("on_topic", F.lit(0)).alias("grade"))
    grades = found.union(_relevant(spark, d).withColumn("grade", F.lit(3))).groupBy("q", "id").agg(F.max("grade").alias("grade"))
    return evaluation.graded_metrics(ranking, grades)


def key_point_coverage(spark: SparkSession, d: str) -> DataFrame:
    points = read_table(spark, d, "test_set").select(F.col("id").alias("q"), F.explode("expected_key_points").alias("point"), "relevant_doc_ids").distinct()
    cited = points.select("q", "point", F.explode("relevant_doc_ids").alias("doc_id")).join(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    hit = cited.groupBy("q", "point").agg(F.max((text.overlap(F.col("point"), F.col("text")) > 0).cast("double")).alias("hit"))
    return points.select("q", "point").distinct().join(hit, ["q", "point"], "left").groupBy("q").agg(F.count("*").alias("n_points"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("coverage"))


def slice_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("evidence_level", F.lit("")).alias("evidence_level"), F.col("n_chars").cast("double").alias("n_chars"), F.col("page_count").cast("double").alias("page_count"))
    return evaluation.slices(docs, ["topic", "evidence_level"], ["n_chars", "page_count"])


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quantiles(read_table(spark, d, "events"), "event_type", "value")


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read_table(spark, d, "events").withColumn("k", k)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 10, 1)).alias("n_slow"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("k").alias("max_k"))


def question_macro(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "review_template").select(F.col("labels.support_rate").alias("support"), F.col("question_id").alias("question"), "rubric_version")
    return evaluation.macro_means(rows, "question", 1, "support", "rubric_version")


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_discount").alias("baseline"), F.col("l_tax").alias("candidate"))
    return evaluation.paired_bootstrap(items)


def review_adjudication(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "review_template")
    own = r.select(F.col("item_id").alias("item"), F.lower(F.trim("reviewer_id")).alias("reviewer"), F.lower(F.trim("labels.behavior")).alias("label"))
    return evaluation.adjudicate(own.where("label <> ''").groupBy("item", "reviewer").agg(F.max("label").alias("label")))


def corpus_distribution(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    parts = [audit.distribution(docs, c).withColumn("field", F.lit(c)) for c in ("topic", "evidence_level", "extraction_status")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def corpus_gates(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return docs.groupBy("source").agg(
        F.count("*").alias("n"), share(F.col("extraction_status") == "full_text").alias("full_text_share"), share(F.col("n_chars") >= 300).alias("long_share"), share(F.col("n_chars") == F.length("text")).alias("length_agrees"),
        F.min("published_year").alias("first_year"), F.max("published_year").alias("last_year"), F.countDistinct("topic").alias("n_topics"),
    )


def orphan_anti_join(spark: SparkSession, d: str) -> DataFrame:
    lost = audit.orphans(read_table(spark, d, "review_template").select("item_id", "question_id"), "question_id", read_table(spark, d, "questions"), "id")
    return lost.groupBy("question_id").agg(F.count("*").alias("n"))


def index_except_check(spark: SparkSession, d: str) -> DataFrame:
    return audit.two_way_difference(read_table(spark, d, "questions").select("id"), read_table(spark, d, "independent_synthetic_v1").select("id"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_keys(read_table(spark, d, "chunks"), "id")


def _split(c: str = "split") -> Column:
    return F.lower(F.trim(F.col(c)))


def leakage_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "independent_synthetic_v1")
    out = audit.shared_across(rows, F.lower(F.trim("question_group_id")), _split())
    return out.select("key", "n_rows", F.array_join("splits", "|").alias("splits"))


def leakage_text(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "independent_synthetic_v1")
    out = audit.shared_across(rows, text.text_hash(F.col("question")), _split())
    return out.select("key", "n_rows", F.array_join("splits", "|").alias("splits"))


def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of up to 20 generations, as this query's SQL asks for; the operator itself has no limit."""
    return audit.ancestors(read_table(spark, d, "questions").select("id", F.explode("derived_from").alias("parent")), 20)


def asset_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "independent_synthetic_v1")
    return audit.issues(
        rows,
        "id",
        {
            "split_unknown": ~F.coalesce(F.col("split"), F.lit("")).isin("train", "dev", "blind", "synthetic"),
            "group_missing": F.trim(F.coalesce("question_group_id", F.lit(""))) == "",
            "date_not_iso": F.try_to_date("as_of_date", "yyyy-MM-dd").isNull() | ~F.coalesce(F.col("as_of_date"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$"),
            "hash_not_sha256": ~F.coalesce(F.col("corpus_manifest_hash"), F.lit("")).rlike("^[0-9a-f]{64}$"),
            "refusal_without_code": (F.col("expected_behavior") == "refuse") & (F.size("allowed_refusal_codes") == 0),
            "code_without_refusal": (F.col("expected_behavior") != "refuse") & (F.size("allowed_refusal_codes") > 0),
        },
    )


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = read_table(spark, d, "questions").where("updated_at is not null").select("id", "topic", "language", "expected_behavior", "annotation_status", "updated_at").distinct()
    order = Window.partitionBy("id")
    cuts = q.withColumn("first", F.min("updated_at").over(order)).withColumn("last", F.max("updated_at").over(order))
    drop = ["updated_at", "first", "last"]
    old = cuts.where("updated_at = first and first < timestamp'2025-01-01'").drop(*drop)
    new = cuts.where("updated_at = last and last >= timestamp'2024-06-01'").drop(*drop)
    return old, new


def snapshot_publish(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return publish.publish_counts(old, new, "id", ["topic", "language", "expected_behavior", "annotation_status"])


def stale_deactivate(spark: SparkSession, d: str) -> DataFrame:
    current = read_table(spark, d, "customer")
    active = read_table(spark, d, "orders").where("o_orderdate >= timestamp'1997-01-01'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return publish.next_snapshot(current, current.join(active, "c_custkey", "left_semi"), "c_custkey").select("c_custkey", "c_name", "is_active")


def superseded_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = read_table(spark, d, "documents").select("source", F.date_format("retrieved_at", "yyyy-MM").alias("started")).distinct().withColumn("run", F.concat_ws("/", "source", "started"))
    return publish.superseded(runs, "source", "started", "run")


def evidence_levels(spark: SparkSession, d: str) -> DataFrame:
    types = F.when(F.col("study_type").isNotNull(), F.array("study_type")).otherwise(F.array().cast("array<string>"))
    level = identity.classification(types, F.lower(F.coalesce("study_type", F.lit(""))) == "preprint")
    return read_table(spark, d, "documents").select("doc_id", level["evidence_level"].alias("level"), level["review_status"].alias("review_status"))


def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    own = identity.canonical_source(F.col("record_id"), F.lit(""), F.lit(""))
    parts = identity.identifiers(F.col("record_id"))
    return read_table(spark, d, "documents").select("doc_id", own.alias("canonical"), parts["pmid"].alias("pmid"), parts["nct_id"].alias("nct_id"))


def detect_topic(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", text.topic(F.col("text")).alias("detected"))


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_terms"))


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.postings(read_table(spark, d, "documents"), "doc_id", F.col("text"))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


def text_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.groupBy(text.text_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = document_chunks(read_table(spark, d, "documents").select("doc_id", F.col("text").alias("abstract")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("longest"))


def page_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(text.windows(F.col("text"))).alias("at", "window")).select("doc_id", "at", F.length("window").alias("n_chars"), F.sha2("window", 256).alias("window_hash"))


def number_sets(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_sort(text.numbers(F.col("text")))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.size(found).cast("long").alias("n_numbers"), F.sha2(F.array_join(found, "|"), 256).alias("numbers_hash"))


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(text.title_key(F.col("title")).alias("title_key")).groupBy("title_key").agg(F.count("*").alias("n"))


def per_doc_ordinal(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("id")
    return read_table(spark, d, "chunks").select("doc_id", "id").distinct().select("doc_id", "id", F.row_number().over(order).alias("ordinal"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    stream = telemetry.stage_windows(telemetry.event_stream(spark, f"{d}/events.parquet"))
    out = telemetry.run_available(spark, stream)
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: read_table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n_items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def large_orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("quantity")).where("quantity > 200")


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_orderdate >= timestamp'1998-01-01'")
    return audit.orphans(c.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", o, "o_custkey")


def recent_order_exists(spark: SparkSession, d: str) -> DataFrame:
    """Orders that a later order of the same customer overtook: a semi join with a range, as one grouped maximum."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return o.join(last, "o_custkey").where("o_orderdate < last").groupBy("o_custkey").agg(F.count("*").alias("n_overtaken"))


def weighted_median_year(spark: SparkSession, d: str) -> DataFrame:
    return governance.weighted_median(read_table(spark, d, "documents"), "source", "published_year", "n_chars")


def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = read_table(spark, d, "documents"), read_table(spark, d, "chunks").where("content_kind = 'full_text'")
    return governance.reconcile(docs, chunks, "doc_id", "nlm_unique_id")


def run_row_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "review_template").select("item_id", "reviewer_id", "rubric_version", "output_hash", F.coalesce("labels.behavior", F.lit("")).alias("behavior"))
    checked = governance.void_repeated(rows, ["item_id", "reviewer_id"], F.concat_ws("|", "output_hash", "behavior"))
    return checked.groupBy("rubric_version").agg(F.count("*").alias("n"), F.sum(F.col("void").cast("long")).alias("n_void"), F.sum(F.col("differs").cast("long")).alias("n_differs"))


def label_binding(spark: SparkSession, d: str) -> DataFrame:
    runs = read_table(spark, d, "review_template").select(F.col("question_id").alias("id"), F.lower("labels.behavior").alias("digest"))
    labels = read_table(spark, d, "independent_synthetic_v1").select("id", F.col("expected_behavior").alias("digest"))
    return governance.bind_labels(labels, runs.where("digest is not null"), ["id"], "digest").groupBy("status").agg(F.count("*").alias("n"))


def repeat_consistency(spark: SparkSession, d: str) -> DataFrame:
    return governance.repeat_consistency(read_table(spark, d, "review_template"), "question_id", "output_hash")


def metric_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "review_template").select("rubric_version", *[F.col(f"labels.{m}").alias(m) for m in ("support_rate", "key_point_coverage", "numeric_correctness", "refusal_quality")])
    return governance.metric_gates(rows, "rubric_version", "dual-review-v1", "dual-review-v2", ["support_rate", "key_point_coverage", "numeric_correctness", "refusal_quality"])


def blind_aliases(spark: SparkSession, d: str) -> DataFrame:
    return governance.blind_aliases(read_table(spark, d, "review_template"), "question_id", "item_id", "blind-7")


def degraded_profile(spark: SparkSession, d: str) -> DataFrame:
    return governance.weakest(_reranked(spark, d))


def excerpt_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each chunk stands in its document, blanks disregarded; 0 where the chunk's text is damaged or another one."""
    chunks = read_table(spark, d, "chunks").where("text is not null").select("id", "doc_id", F.col("text").alias("excerpt")).distinct()
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    at = governance.bare_position(F.col("text"), F.col("excerpt"))
    return chunks.join(docs, "doc_id").groupBy("id").agg(F.max(at).alias("position"))


def rerank_local(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the first 40 with statistics over the question's own pool, as the reranker wants them."""
    items = corpus(spark, d).select(F.col("doc_id").alias("id"), "searchable")
    return retrieval.local_scores(golden(spark, d), "id", F.col("question"), retrieval.near(lexical_search(spark, d).select("q", "id")).join(items, "id"), F.col("searchable"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain for the golden questions."""
    return engine.ask(golden(spark, d), read_table(spark, d, "documents"), index=document_index(spark, d))


def queries() -> dict[str, Query]:
    own = [
        lexical_search, bm25_topk, tfidf_cosine_topk, rrf_fusion, fts_weighted_topk, per_doc_cap, dense_knn, dense_multi_variant_rrf, hybrid_fusion, static_merge_dedupe, query_variants,
        pool_source_preserving, pool_legacy, identity_conflicts, independent_sources, rerank_blend, topk_document_diverse, mmr_packet,
        query_spec, safety_gate, coverage_partition, evidence_gate, claim_verify, claim_overlap, sanitize_claims, answer_failure, numeric_consistency, polarity_conflicts,
        recall_mrr_ndcg, graded_metrics, key_point_coverage, slice_grouping_sets, latency_quantiles, arm_summary, question_macro, paired_bootstrap, review_adjudication,
        corpus_distribution, corpus_gates, orphan_anti_join, index_except_check, duplicate_ids, leakage_groups, leakage_text, ancestor_closure, asset_issues,
        snapshot_publish, stale_deactivate, superseded_runs, evidence_levels, canonical_ids, detect_topic, tokenize_stats, doc_frequency, text_hash_dedup, sentence_counts,
        chunked_documents, page_windows, number_sets, title_keys, per_doc_ordinal, event_windows, nation_revenue, large_orders, customers_without_orders, recent_order_exists,
        weighted_median_year, ledger_reconcile, run_row_checks, label_binding, repeat_consistency, metric_gates, blind_aliases, degraded_profile, excerpt_positions, rerank_local, answers,
    ]
    return {query.__name__: query for query in own}


