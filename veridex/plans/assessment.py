"""Queries of ingestion, governance and evaluation over the whole given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex import engine
from veridex.functions import identity, text
from veridex.functions import vocabulary as V
from veridex.operators import audit, evaluation, gates, governance, publish, retrieval, verification
from veridex.plans import catalogue as C
from veridex.plans import oracle as O
from veridex.session import Stage, read_table
from veridex.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
SCORED = ["support_rate", "key_point_coverage", "numeric_correctness", "refusal_quality"]
REPORT_METRICS = [*SCORED, "behavior_accuracy", "serious_error_rate"]


# --- questions and retrieval -------------------------------------------------------------------------------------------


def query_plan(spark: SparkSession, d: str) -> DataFrame:
    """What the rewriting of a question gives besides its domains: parts, interface queries, registry query, full-text words."""
    s = C._specs(spark, d)
    return s.select(
        "q", F.col("pico")["P"].alias("population"), F.col("pico")["I"].alias("intervention"), F.col("pico")["C"].alias("comparison"), F.array_join("api_queries", "|").alias("api_queries"), F.array_join("local_terms", "|").alias("local_terms"),
        gates.trial_query(F.col("local_terms"), F.col("original")).alias("trial_query"), F.array_join(retrieval.query_words(F.col("local_terms")), " ").alias("words"), "time_from", "time_to",
    )


def question_focus(spark: SparkSession, d: str) -> DataFrame:
    f = gates.focus(F.col("safe_query"))
    s = C._specs(spark, d).select("q", f.alias("f"))
    return s.select("q", F.array_join("f.concepts", "|").alias("concepts"), F.array_join("f.literals", "|").alias("literals"), F.array_join("f.populations", "|").alias("populations"), F.col("f.broad").alias("broad"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Specifications of the stated set of searches."""
    return gates.specify(C.golden(spark, d), "id", "question", C.YEAR)


def fts_two_stage(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.latest_chunks(spark, d)
    titles = read_table(spark, d, "documents").select("doc_id", "title", "topic")
    named = chunks.join(titles, "doc_id", "left")
    build = lambda: retrieval.build_index(named, "id", [(F.col("title"), 1.4), (F.col("text"), 1.0)])
    index = retrieval.kept_index(spark, "titled chunks", [f"{d}/chunks.parquet", f"{d}/documents.parquet"], build)
    return retrieval.full_text_search(_asked(spark, d), index, chunks, titles, engine.searchable(F.col("title"), F.col("topic"), F.col("text")))


def mode_routing(spark: SparkSession, d: str) -> DataFrame:
    """All branches of the hybrid mode, each a search over its own sources with its own statistics."""
    rankings = {}
    for name, (sources, top) in V.BRANCHES.items():
        build = lambda sources=sources: engine.document_index(retrieval.allowed(read_table(spark, d, "documents"), sources))
        index = retrieval.kept_index(spark, f"branch {name}", [f"{d}/documents.parquet"], build)
        rankings[name] = retrieval.lexical_search(C.golden(spark, d), "id", F.col("question"), index, top)
    return retrieval.routed(rankings, "hybrid").select("q", "branch", "id", "rank", "score")


def store_search(spark: SparkSession, d: str) -> DataFrame:
    asked = C.golden(spark, d).select(F.col("id").alias("q"), "question")
    return retrieval.search_store(asked, read_table(spark, d, "documents"), C.document_index(spark, d), 25)


def cross_encoder_blend(spark: SparkSession, d: str) -> DataFrame:
    """Given scores stand for a cross-encoder's: a linear function of the cosine; rows without a published year have none."""
    entries = C._described(spark, d, C._reranked(spark, d).select("q", "id", "score"), "published_year")
    given = C.tfidf_cosine_topk(spark, d).join(entries.select("q", "id", "published_year"), ["q", "id"]).where("published_year is not null")
    return retrieval.cross_rerank(entries.select("q", "id", "score"), given.select("q", "id", (F.col("cosine") * 8 - 2).alias("logit")), 12)


def live_decision(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.live_wanted(_asked(spark, d), C._reranked(spark, d).where("rank <= 8").select("q", "score"), "hybrid", 0.3)


def static_selection(spark: SparkSession, d: str) -> DataFrame:
    """Dense stands for the cosine ranking, cloud for the BM25 one; an unknown backend falls back to the lexical list."""
    words, angles = [x.withColumnRenamed(c, "score") for x, c in zip(C._rankings(spark, d), ("bm25", "cosine"), strict=True)]
    parts = []
    for backend in ("legacy", "dense", "hybrid", "other"):
        rows, status = retrieval.select_static(backend, words, angles, words.where("rank <= 20"))
        parts.append(rows.select(F.lit(backend).alias("backend"), F.lit(status["actual"]).alias("actual"), "q", "id", "rank"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    top = C._described(spark, d, C._reranked(spark, d).where("rank <= 5").select("q", "id", "rank"), "title", "level", "source", "published_year", "text", "url")
    entries = top.select("q", F.col("rank").alias("citation_number"), "title", F.coalesce("level", F.lit("")).alias("level"), "source", F.col("published_year").alias("year"), F.lit(None).cast("string").alias("status"), "text", "url")
    made = verification.prompts(C.golden(spark, d).select(F.col("id").alias("q"), "question"), entries)
    return made.select("q", F.length("prompt").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_hash"))


def refusal_texts(spark: SparkSession, d: str) -> DataFrame:
    coded = gates.safety(C._specs(spark, d)).select("q", "code", F.lit(0).cast("long").alias("n_entries"), F.lit(0).cast("long").alias("n_sources"))
    out = gates.refusals(coded)
    return out.select("q", "refused", "code", F.size("found").alias("n_found"), F.array_join("missing", "|").alias("missing"), F.array_join("next_steps", "|").alias("next_steps"))


def public_sources(spark: SparkSession, d: str) -> DataFrame:
    claims, entries = C._citations(spark, d)
    return verification.public_projection(verification.verify(claims, entries), entries).select("claim_id", "citation", "title", F.sha2("excerpt", 256).alias("excerpt_hash"), "url")


# --- ingestion ---------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each source's month of retrieval is a run; 2024 and before have succeeded but for June, which still runs, later ones run."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", F.date_format("retrieved_at", "yyyy-MM").alias("started")).where("started is not null")
    run = F.concat_ws("/", "source", "started")
    status = F.when(F.col("started").endswith("-06"), "running").when(F.col("started").endswith("-07"), "cancelled").when(F.col("started") < "2025-01", "succeeded").otherwise("running")
    runs = docs.select(run.alias("run"), "source", "started", status.alias("status")).distinct()
    staged = docs.select(run.alias("run"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 0, F.lit("pubmed")).otherwise(F.col("source")).alias("source"))
    # chunks stay with the run of the month they were made in, so late ones have no document there
    chunks = read_table(spark, d, "chunks").select("id", "doc_id", F.date_format("created_at", "yyyy-MM").alias("made")).distinct()
    placed = chunks.join(docs.select("doc_id", "source"), "doc_id").select(F.concat_ws("/", "source", "made").alias("run"), "id", F.col("doc_id").alias("document_id"))
    return runs, staged, placed


def publish_rejections(spark: SparkSession, d: str) -> DataFrame:
    return publish.rejections(*_runs(spark, d))


def publish_ledger(spark: SparkSession, d: str) -> DataFrame:
    return publish.publish_runs(*_runs(spark, d))


def visible_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents whose source is enabled, by document."""
    on = read_table(spark, d, "source_catalog").where("enabled").select(F.col("id").alias("source"))
    docs = read_table(spark, d, "documents").join(on, "source", "left_semi").select("doc_id")
    return read_table(spark, d, "chunks").join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def staged_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON payloads and back, in the columns of the store; a digest of each."""
    schema = "record_id string, title string, source string, published_year int, authors array<string>"
    rows = read_table(spark, d, "documents").select("doc_id", F.to_json(F.struct("record_id", "title", "source", "published_year", "authors", "lang")).alias("payload"))
    back = rows.select("doc_id", F.from_json("payload", schema).alias("s")).select("doc_id", "s.*")
    return back.select("doc_id", "published_year", F.size(F.coalesce("authors", F.array().cast("array<string>"))).alias("n_authors"), F.sha2(F.concat_ws("|", "record_id", "title", "source", F.array_join("authors", ";")), 256).alias("content_hash"))


def document_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    rows = docs.select(F.col("record_id").alias("id"), F.col("source").alias("source_id"), "title", F.col("text").alias("abstract"), "journal", "published_year", "authors", "study_type", F.lit(None).cast("string").alias("status"), "evidence_level", F.lit(None).cast("string").alias("url"), "topic", F.col("source_updated_at").alias("retrieved_at"), "doc_id")
    out = readers.cloud_documents(rows).groupBy("id").agg(F.count("*").alias("n"), F.max("retrieved_at").alias("retrieved_at"), F.max(F.size("authors")).alias("most_authors"), F.min("evidence_level").alias("level"))
    return out


def content_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", governance.digest("title", "source", "lang", "topic").alias("digest"), identity.slug(F.coalesce("journal", F.lit(""))).alias("slug"), identity.cache_key(F.col("source"), F.coalesce("title", F.lit("")), F.lit(5), F.lit("v1")).alias("cache_key"))


def cache_ages(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved documents as cache entries with a life of 90 days before the last retrieval."""
    docs = read_table(spark, d, "documents").select("source", "retrieved_at").where("retrieved_at is not null")
    last = F.broadcast(docs.agg(F.max("retrieved_at").alias("now")))
    fresh = F.unix_timestamp("now") - F.unix_timestamp("retrieved_at") <= 90 * 86400
    return docs.crossJoin(last).groupBy("source").agg(F.count(F.when(fresh, 1)).alias("n_fresh"), F.count(F.when(~fresh, 1)).alias("n_stale"))


def pmid_lookup(spark: SparkSession, d: str) -> DataFrame:
    cited = read_table(spark, d, "review_template").select("item_id", F.posexplode("source_ids").alias("at", "record"))
    cited = cited.where("record like 'pmid:%'").select(F.substring("record", 6, 100).alias("pmid"), F.col("item_id").alias("source"), F.concat_ws("/", "item_id", F.col("at").cast("string")).alias("position"))
    known = read_table(spark, d, "documents").where("record_id like 'pmid:%'").select(F.substring("record_id", 6, 100).alias("pmid"))
    return readers.cited_pmids(cited, known)


def longest_versions(spark: SparkSession, d: str) -> DataFrame:
    """Of the feeds of one record the longest text stays, the earlier corpus on ties."""
    docs = read_table(spark, d, "documents").select("record_id", "doc_id", "source", "text")
    frames = [docs.where("source = 'pdf_collection'"), docs.where("source = 'pubmed_snapshot'"), docs.where("source not in ('pdf_collection', 'pubmed_snapshot')")]
    return readers.longest_wins(frames, "record_id", "text").select("record_id", F.length("text").alias("n_chars"))


def topic_references(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.coalesce("topic", F.lit("")).alias("topic"), "record_id", "journal", "evidence_level")
    return docs.groupBy("topic").agg(F.countDistinct("record_id").alias("n_references"), F.countDistinct("journal").alias("n_journals"), F.array_join(F.array_sort(F.collect_set("evidence_level")), "|").alias("levels"))


# --- governance --------------------------------------------------------------------------------------------------------


def ledger_issues(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    basis = F.when(F.col("study_type").isNotNull(), F.array("study_type")).otherwise(F.array().cast("array<string>"))
    records = docs.select(
        F.col("record_id").alias("canonical_source_id"), F.col("extraction_status").alias("content_status"), basis.alias("classification_basis"), F.when(F.col("evidence_level").isNull(), "metadata_missing").otherwise("metadata_mapped").alias("review_status"),
        F.when(F.col("page_count").isNull(), "unknown").otherwise(F.sha2("text", 256)).alias("file_sha256"), F.sha2("title", 256).alias("metadata_sha256"), identity.address(F.col("record_id")).alias("source_url"),
        F.when(F.col("source_updated_at").isNull(), "v0").otherwise("v1").alias("index_version"), F.when(F.col("lang") == "en", "p1").alias("parser_version"),
    )
    return governance.ledger_issues(records, "v1", "p1")


def output_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "review_template").select(F.col("labels.behavior").alias("behavior"), F.col("labels.rationale").alias("answer"), F.get("labels.error_types", F.lit(0)).alias("code"))
    issue = governance.output_issue(F.col("behavior"), F.col("answer"), F.col("code"))
    return rows.groupBy(F.coalesce(issue, F.lit("none")).alias("issue")).agg(F.count("*").alias("n"))


def locator_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk as a quote of its document, at the offset where it stands if it does, else at its start."""
    chunks = C.latest_chunks(spark, d).where("text is not null").select("id", "doc_id", F.col("text").alias("quote"))
    rows = chunks.join(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    start = F.greatest(F.call_function("instr", F.col("text"), F.col("quote")) - 1, F.lit(0))
    issue = governance.locator_issue(F.col("text"), F.col("quote"), start, start + F.length("quote"))
    return rows.where("text is not null").groupBy(F.coalesce(issue, F.lit("none")).alias("issue")).agg(F.count("*").alias("n"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "questions").select("id", F.lower(F.trim("semantic_family_id")).alias("family")).where("family <> ''").distinct()


def leakage_families(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "independent_synthetic_v1").select("id", "split").join(_families(spark, d), "id")
    out = audit.shared_across(rows, F.col("family"), C._split())
    return out.select("key", "n_rows", F.array_join("splits", "|").alias("splits"))


def conflicting_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "independent_synthetic_v1")
    group = F.nullif(F.lower(F.trim("question_group_id")), F.lit(""))
    return audit.conflicting_groups(rows, text.text_hash(F.col("question")), C._split(), group)


def derived_leakage(spark: SparkSession, d: str) -> DataFrame:
    splits = read_table(spark, d, "independent_synthetic_v1").select("id", C._split().alias("split"))
    return audit.derived_leakage(C.ancestor_closure(spark, d), splits)


def blind_package(spark: SparkSession, d: str) -> DataFrame:
    """Items under their alias with whitelisted fields only, by question."""
    r = read_table(spark, d, "review_template").where("item_id is not null")
    named = r.join(governance.blind_aliases(r, "question_id", "item_id", "blind-7"), ["question_id", "item_id"])
    return named.select("question_id", "alias", "rubric_version", F.size("source_ids").alias("n_sources")).distinct()


# --- evaluation --------------------------------------------------------------------------------------------------------


def _behavior(c: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(c))), "[ -]+", "_")


def _generations(spark: SparkSession, d: str) -> DataFrame:
    """One row per review with its question, its metrics, and whether its behavior is the expected one."""
    expected = _questions(spark, d).select("q", "behavior")
    r = read_table(spark, d, "review_template").select(F.col("question_id").alias("q"), "rubric_version", "output_hash", _behavior("labels.behavior").alias("said"), F.col("labels.serious_error").cast("double").alias("serious_error_rate"), *[F.col(f"labels.{m}").alias(m) for m in SCORED])
    known = F.when(F.col("said").isin("answer", "qualified_answer", "refuse"), (F.col("said") == F.col("behavior")).cast("double"))
    return r.join(expected, "q").withColumn("behavior_accuracy", known)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "independent_synthetic_v1").where("id is not null")
    one = rows.groupBy("id").agg(F.min(F.struct("expected_behavior", "topic", "risk", F.col("applicability.retrieval").alias("retrieval"), F.col("applicability.answer_quality").alias("answer"), F.col("applicability.refusal").alias("refusal"))).alias("x"))
    return one.select(F.col("id").alias("q"), F.col("x.expected_behavior").alias("behavior"), "x.topic", "x.risk", "x.retrieval", "x.answer", "x.refusal")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quality_report(_questions(spark, d), _generations(spark, d), REPORT_METRICS, ["topic", "risk"])


def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    means = _generations(spark, d).groupBy("q", "rubric_version").agg(*[F.avg(m).alias(m) for m in REPORT_METRICS])
    return evaluation.compare_versions(means, _questions(spark, d), "rubric_version", "dual-review-v1", "dual-review-v2", REPORT_METRICS)


def run_alignment(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "review_template")
    return evaluation.alignment(r.where("rubric_version = 'dual-review-v1'"), r.where("rubric_version = 'dual-review-v2'"), "question_id", "output_hash")


def result_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _generations(spark, d)
    status = F.when(F.col("said").isNull() | (F.col("said") == ""), "error").when(F.col("said").isin("answer", "qualified_answer", "refuse"), "success").otherwise("skipped")
    return evaluation.result_summary(rows.withColumn("run_status", status), {m: F.col(m) for m in REPORT_METRICS}, F.col("behavior") != "refuse")


def family_recall(spark: SparkSession, d: str) -> DataFrame:
    family = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), identity.research_family(F.col("record_id"), F.col("record_id"), F.lit("")).alias("family"))
    return evaluation.family_recall(C.lexical_search(spark, d).select("q", "id", "rank"), C._relevant(spark, d), family)


def profile_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Three retrieval profiles of the stated searches; latencies are the mean values of three kinds of events."""
    words, angles = C._rankings(spark, d)
    profiles = {"bm25": (words, "view"), "cosine": (angles, "click"), "fused": (C.lexical_search(spark, d), "error")}
    relevant = Stage(spark, "relevant").write(C._relevant(spark, d))
    parts = [evaluation.binary_metrics(rows.select("q", "id", "rank"), relevant).withColumn("profile", F.lit(name)) for name, (rows, _) in profiles.items()]
    topics = read_table(spark, d, "test_set").select(F.col("id").alias("q"), F.explode("relevant_topics").alias("topic")).distinct()
    kinds = F.create_map(*[F.lit(x) for name, (_, kind) in profiles.items() for x in (kind, name)])
    latency = read_table(spark, d, "events").groupBy(kinds[F.col("event_type")].alias("profile")).agg(F.avg("value").alias("ms")).where("profile is not null")
    return evaluation.profile_scores(parts[0].unionByName(parts[1]).unionByName(parts[2]), topics, latency)


def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    """Independent sources among the documents that each golden question names."""
    named = read_table(spark, d, "test_set").select(F.col("id").alias("q"), F.explode("relevant_doc_ids").alias("id")).distinct()
    rows = named.join(engine.described(read_table(spark, d, "documents")), "id")
    keys = gates.source_keys(F.col("source"), F.col("identity"), F.col("family"), F.col("aliases"))
    return rows.withColumn("keys", keys).groupBy("q").agg(F.count("*").alias("n_documents"), gates.independent_count(F.collect_list("keys")).alias("n_sources"))


def selection_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which pool policy keeps how many of each question's candidates."""
    rows = Stage(spark, "decisions").write(retrieval.near(C.lexical_search(spark, d).select("q", "id", F.col("score").alias("retrieval"))).join(engine.described(read_table(spark, d, "documents")), "id"))
    parts = [engine.candidates(rows, policy).groupBy("q").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("policy", F.lit(policy)) for policy in ("source_preserving", "legacy")]
    return parts[0].unionByName(parts[1])


def queries() -> dict[str, Query]:
    own = [
        query_plan, question_focus, fts_two_stage, mode_routing, store_search, cross_encoder_blend, live_decision, static_selection, prompt_text, refusal_texts, public_sources,
        publish_rejections, publish_ledger, visible_chunks, staged_payloads, document_rows, content_digests, cache_ages, pmid_lookup, longest_versions, topic_references,
        ledger_issues, output_issues, locator_checks, leakage_families, conflicting_groups, derived_leakage, blind_package,
        quality_report, version_comparison, run_alignment, result_summary, family_recall, profile_benchmark, evidence_sources, selection_decisions,
    ]
    return {query.__name__: query for query in own}


# --- the same in SQL ---------------------------------------------------------------------------------------------------

_LOCAL_TERMS = "list_concat(list_concat([safe], flatten([" + ", ".join(f"CASE WHEN contains(safe, {O._q(zh)}) THEN {O._text([zh, en])} ELSE []::VARCHAR[] END" for zh, en in V.TRANSLATIONS.items()) + "])), flatten([" + ", ".join(f"CASE WHEN list_contains(domains, {O._q(n)}) THEN {O._text(t)} ELSE []::VARCHAR[] END" for n, t in V.DOMAINS.items()) + "]))"


def _unique(items: str) -> str:
    """Order-keeping distinct without letter case, blanks trimmed and empty items left out."""
    clean = f"list_filter(list_transform({items}, lambda t: trim(t, ' ')), lambda t: t <> '')"
    return f"list_filter({clean}, lambda t, i: list_position(list_transform({clean}, lambda u: lower(u)), lower(t)) = i)"


_EXPANDED = "flatten([" + ", ".join(f"CASE WHEN contains(lower(safe), {O._q(zh)}) THEN {O._text([en])} ELSE []::VARCHAR[] END" for zh, en in V.TRANSLATIONS.items()) + "])"
_LATIN = "flatten([" + ", ".join(f"CASE WHEN list_contains(domains, {O._q(n)}) THEN {O._text([x for x in t if any('a' <= ch <= 'z' for ch in x)])} ELSE []::VARCHAR[] END" for n, t in V.DOMAINS.items()) + "])"
_STARTED = r"coalesce(year(make_date(2025, 1, 1)) - try_cast(nullif(regexp_extract(safe, '近\s*([0-9]{1,2})\s*年', 1), '') AS INT), try_cast(nullif(regexp_extract(safe, '((?:19|20)[0-9]{2})\s*年?(?:以后|之后|至今)', 1), '') AS INT), CASE WHEN needs_latest THEN 2015 END)"
_OLD = r"(contains(safe, '老年') OR regexp_matches(regexp_replace(safe, '[^\x00-\x7F\pP\pS\pZ岁]', '_', 'g'), '\b(?:6[5-9]|[7-9][0-9])\s*岁'))"
_PLAN = f"""{O.SPECS}, terms AS MATERIALIZED (SELECT *, {_unique(_LOCAL_TERMS)} AS local_terms, array_to_string({_unique(f'list_concat({_EXPANDED}, {_LATIN})')}, ' ') AS english FROM specs),
    latin AS MATERIALIZED (SELECT *, {_unique("list_transform(list_filter(local_terms[2:], lambda t: regexp_matches(t, '[A-Za-z]')), lambda t: t)")}[1:6] AS lt, CASE WHEN english = '' THEN safe ELSE english END AS eng,
        list_filter(list_transform(regexp_extract_all(array_to_string(local_terms, ' '), '[A-Za-z][A-Za-z0-9]+'), lambda w: lower(w)), lambda w: NOT list_contains({O._text(V.QUERY_STOP_WORDS)}, w)) AS ws FROM terms),
    plan AS MATERIALIZED (SELECT *, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:{V.QUERY_WORDS}] AS words FROM latin)"""
_PICO = V.PICO

_RUNS = """docs AS (SELECT doc_id, source, strftime(retrieved_at AT TIME ZONE 'UTC', '%Y-%m') AS started FROM documents WHERE retrieved_at IS NOT NULL),
    runs AS (SELECT DISTINCT source || '/' || started AS run, source, started, CASE WHEN started LIKE '%-06' THEN 'running' WHEN started LIKE '%-07' THEN 'cancelled' WHEN started < '2025-01' THEN 'succeeded' ELSE 'running' END AS status FROM docs),
    sd AS (SELECT source || '/' || started AS run, doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN 'pubmed' ELSE source END AS staged_source FROM docs),
    sc AS (SELECT d.source || '/' || c.made AS run, c.id, c.doc_id AS document_id FROM (SELECT DISTINCT id, doc_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS made FROM chunks) c JOIN docs d USING (doc_id)),
    rej AS MATERIALIZED (SELECT run, 'not_running' AS code, count(*) AS n FROM runs WHERE status NOT IN ('running', 'succeeded') GROUP BY run
        UNION ALL SELECT run, 'superseded', count(*) FROM runs r WHERE status = 'running' AND EXISTS (SELECT 1 FROM runs o WHERE o.source = r.source AND o.status = 'succeeded' AND o.started > r.started) GROUP BY run
        UNION ALL SELECT run, 'source_mismatch', count(*) FROM sd JOIN runs USING (run) WHERE status = 'running' AND staged_source IS DISTINCT FROM source GROUP BY run
        UNION ALL SELECT run, 'dangling_chunk', count(*) FROM sc JOIN runs USING (run) WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.run = sc.run AND sd.id = sc.document_id) GROUP BY run)"""
_ONE = "one AS (SELECT id, min({'b': expected_behavior, 't': topic, 'k': risk, 'r': applicability.retrieval, 'a': applicability.answer_quality, 'f': applicability.refusal}) AS x FROM independent_synthetic_v1 WHERE id IS NOT NULL GROUP BY id), qs AS (SELECT id AS q, x.b AS behavior, x.t AS topic, x.k AS risk, x.r AS retrieval, x.a AS answer, x.f AS refusal FROM one)"
_GENS = f"""{_ONE}, g0 AS (SELECT question_id AS q, rubric_version, output_hash, regexp_replace(lower(trim(labels.behavior, ' ')), '[ -]+', '_', 'g') AS said, labels.serious_error::DOUBLE AS serious_error_rate, {', '.join(f'labels.{m} AS {m}' for m in SCORED)} FROM review_template),
    gens AS MATERIALIZED (SELECT g0.*, behavior, CASE WHEN said IN ('answer', 'qualified_answer', 'refuse') THEN (said = behavior)::INT::DOUBLE END AS behavior_accuracy FROM g0 JOIN qs USING (q))"""


def _on(metric: str) -> str:
    if metric in ("behavior_accuracy", "serious_error_rate"):
        return "TRUE"
    return "coalesce(refusal, FALSE)" if metric == "refusal_quality" else "coalesce(behavior <> 'refuse' AND answer, FALSE)"


def _branch(name: str) -> str:
    sources, top = V.BRANCHES[name]
    items = O.ITEMS.replace("FROM documents)", f"FROM documents WHERE source IN ({', '.join(O._q(s) for s in sources)}))")
    return f"SELECT q, '{name}' AS branch, id, rank, score FROM (WITH {O.scoring(items)} SELECT q, id, rank, score FROM lex WHERE rank <= {top})"


def oracle_sql() -> dict[str, str]:
    url = "CASE lower(split_part(record_id, ':', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}' || substring(record_id, {len(k) + 2})" for k, v in identity.ADDRESSES.items()) + " END"
    reliable = f"CASE WHEN regexp_matches({O.FAMILY}, '^(?:pmid:[0-9]{{5,9}}|trial:NCT[0-9]{{8}}|doi:10[.].*/.*)$') THEN {O.FAMILY} END"
    family_docs = "fd AS (SELECT *, CASE WHEN regexp_matches(record_id, '(?i)pmid:[0-9]{5,9}') THEN 'pmid:' || regexp_extract(record_id, '(?i)pmid:([0-9]{5,9})', 1) ELSE NULL END AS pm FROM documents)"
    chosen = "chosen AS (SELECT id, max({'u': updated_at, 't': text, 'd': doc_id}) AS x FROM chunks GROUP BY id), ch AS (SELECT id, x.d AS doc_id, x.t AS text FROM chosen)"
    refusal = lambda i: "CASE code " + " ".join(f"WHEN '{c}' THEN {O._q(t[i])}" for c, t in V.REFUSALS.items()) + " ELSE '' END"
    report = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{dim}' AS dimension, {col} AS value, count(*) AS expected_questions, count(*) FILTER (WHERE n_{m} = repeats AND repeats > 0) AS valid_questions, CASE WHEN count(*) = count(*) FILTER (WHERE n_{m} = repeats AND repeats > 0) THEN 'scored' ELSE 'evidence_insufficient' END AS status, CASE WHEN count(*) = count(*) FILTER (WHERE n_{m} = repeats AND repeats > 0) THEN round(avg(m_{m}), 6) END AS score, round(avg(m_{m}), 6) AS observed_mean FROM rep WHERE {_on(m)} GROUP BY 3"
        for m in REPORT_METRICS
        for dim, col in (("topic", "coalesce(topic, '')"), ("risk", "coalesce(risk, '')"), ("all", "''"))
    )
    compare = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CASE WHEN count(*) = count(b.{m} + a.{m}) THEN 'compared' ELSE 'evidence_insufficient' END AS status, count(*) AS expected, count(b.{m} + a.{m}) AS paired, count(*) - count(b.{m} + a.{m}) AS missing, round(avg(b.{m} - a.{m}), 6) AS mean_difference FROM qs LEFT JOIN (SELECT * FROM mm WHERE rubric_version = 'dual-review-v1') a USING (q) LEFT JOIN (SELECT * FROM mm WHERE rubric_version = 'dual-review-v2') b USING (q)"
        for m in REPORT_METRICS
    )
    summary = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(coalesce(sum({m}) FILTER (WHERE st = 'success'), 0), 6) AS numerator, count({m}) FILTER (WHERE st = 'success') AS denominator, round(sum({m}) FILTER (WHERE st = 'success') / nullif(count({m}) FILTER (WHERE st = 'success'), 0), 6) AS value, round(coalesce(sum(CASE WHEN st = 'success' THEN coalesce({m}, 0) ELSE 0 END) FILTER (WHERE st <> 'skipped' AND behavior <> 'refuse'), 0), 6) AS itt_numerator, count(*) FILTER (WHERE st <> 'skipped' AND behavior <> 'refuse') AS itt_denominator, round(sum(CASE WHEN st = 'success' THEN coalesce({m}, 0) ELSE 0 END) FILTER (WHERE st <> 'skipped' AND behavior <> 'refuse') / nullif(count(*) FILTER (WHERE st <> 'skipped' AND behavior <> 'refuse'), 0), 6) AS itt_value FROM s"
        for m in REPORT_METRICS
    )
    binary = lambda rows, name: f"SELECT '{name}' AS profile, t.q, round(coalesce(hits, 0) / n_relevant::DOUBLE, 9) AS recall, round(coalesce(1.0::DOUBLE / f, 0), 9) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 8) + 1), lambda i: 3.0::DOUBLE / log2(i + 1))), 9) AS ndcg FROM tot t LEFT JOIN (SELECT q, count(*) FILTER (WHERE rank <= 8) AS hits, min(rank) AS f, sum(CASE WHEN rank <= 8 THEN 3.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM {rows} JOIN rel USING (q, id) GROUP BY q) h USING (q)"
    dig = "'{\"lang\":' || to_json(coalesce(lang, ''))::VARCHAR || ',\"source\":' || to_json(coalesce(source, ''))::VARCHAR || ',\"title\":' || to_json(coalesce(title, ''))::VARCHAR || ',\"topic\":' || to_json(coalesce(topic, ''))::VARCHAR || '}'"
    slug = "regexp_replace(regexp_replace(coalesce(journal, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g')"
    rule = lambda code, bad: f"SELECT '{code}' AS code, count(*) AS n FROM documents WHERE {bad} HAVING count(*) > 0"
    return {
        "query_plan": f"""WITH {_PLAN} SELECT q, CASE WHEN {_OLD} THEN '{_PICO['older']}' WHEN contains(safe, '孕') THEN '{_PICO['pregnant']}' ELSE '{_PICO['adult']}' END AS population,
            array_to_string(list_filter([{', '.join(f"CASE WHEN contains(safe, {O._q(zh)}) THEN {O._q(zh)} END" for zh in V.TRANSLATIONS)}], lambda t: t IS NOT NULL)[1:4], '、') AS intervention,
            CASE WHEN {O.HAS('lower(safe)', V.PICO_COMPARISONS)} THEN '{_PICO['comparison']}' ELSE '' END AS comparison, array_to_string({_unique("['(' || eng || ') AND (guideline OR trial OR meta-analysis)', '(' || eng || ') AND Guideline[pt]']")}, '|') AS api_queries, array_to_string(local_terms, '|') AS local_terms,
            CASE WHEN len(lt) = 0 THEN '"' || trim(regexp_replace(replace(replace(original, '"', ' '), chr(92), ' '), '{O.WS}', ' ', 'g'), ' ') || '"' WHEN len(lt) = 1 THEN '"' || lt[1] || '"' ELSE '"' || lt[1] || '" AND (' || array_to_string(list_transform(lt[2:], lambda t: '"' || t || '"'), ' OR ') || ')' END AS trial_query,
            array_to_string(words, ' ') AS words, {_STARTED} AS time_from, CASE WHEN {_STARTED} IS NOT NULL THEN 2025 END AS time_to FROM plan""",
        "query_variants": rf"""WITH {_PLAN}, v AS (SELECT q, list_filter([trim(regexp_replace(safe, '{O.WS}', ' ', 'g'), ' '), trim(regexp_replace(original, '{O.WS}', ' ', 'g'), ' '), trim(regexp_replace(array_to_string(local_terms[1:24], ' '), '{O.WS}', ' ', 'g'), ' ')], lambda x: x <> '') AS l FROM plan),
            vd AS (SELECT q, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS l FROM v) SELECT q, i - 1 AS variant, sha256(l[i]) AS text_hash FROM vd, unnest(range(1, len(l) + 1)) AS u(i)""",
        "question_focus": f"WITH {O.SPECS} SELECT q, array_to_string({O.CONCEPT('safe')}, '|') AS concepts, array_to_string(list_filter(list_concat({O.CODES}, regexp_extract_all(safe, {O._q(V.NAMED_FOCUS)}, 1)), lambda t, i: list_position(list_concat({O.CODES}, regexp_extract_all(safe, {O._q(V.NAMED_FOCUS)}, 1)), t) = i), '|') AS literals, array_to_string(list_filter([{', '.join(f'CASE WHEN {O.HAS(O.ASKED_PEOPLE, w)} THEN {O._q(n)} END' for n, w in V.POPULATIONS.items())}], lambda t: t IS NOT NULL), '|') AS populations, {O.HAS('safe', V.DIET_PHRASES)} AND NOT contains(safe, '{V.INTERVENTION_FIELD}') AS broad FROM specs",
        "fts_two_stage": f"""WITH {_PLAN}, {O.GOLDEN}, {chosen}, cd AS MATERIALIZED (SELECT ch.*, d.title, d.topic FROM ch LEFT JOIN documents d USING (doc_id)),
            qt AS MATERIALIZED (SELECT q, unnest(words) AS term, 1.0::DOUBLE AS qtf FROM plan JOIN (SELECT id AS q FROM golden) USING (q)),
            tk AS MATERIALIZED (SELECT id, {O.tokens("coalesce(title,'')")} AS a, {O.tokens("coalesce(text,'')")} AS b, {O.tokens("concat_ws(' ', coalesce(title,''), coalesce(topic,''), coalesce(text,''))")} AS toks FROM cd),
            post AS MATERIALIZED (SELECT id, term, sum(x) AS tf FROM (SELECT id, unnest(a) AS term, 1.4::DOUBLE AS x FROM tk UNION ALL SELECT id, unnest(b), 1.0::DOUBLE FROM tk) GROUP BY id, term),
            z0 AS (SELECT id, len(a) * 1.4::DOUBLE + len(b) AS z FROM tk), shape AS (SELECT count(*)::DOUBLE AS n, greatest(avg(z), 1.0) AS avg_len FROM z0), dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
            st1 AS MATERIALIZED (SELECT q, p.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * z / avg_len))), 9) AS s, row_number() OVER (PARTITION BY q ORDER BY s DESC, p.id) AS before FROM qt JOIN dfs USING (term) JOIN post p USING (term) JOIN z0 ON z0.id = p.id, shape GROUP BY q, p.id QUALIFY before <= 100),
            lt0 AS MATERIALIZED (SELECT q, term, count(*)::DOUBLE AS qtf FROM (SELECT q, unnest({O.tokens("array_to_string(local_terms, ' ')")}) AS term FROM plan JOIN (SELECT id AS q FROM golden) USING (q)) GROUP BY q, term),
            ix AS MATERIALIZED (SELECT q, id, term, count(*)::DOUBLE AS tf FROM (SELECT q, st1.id, unnest(toks) AS term FROM st1 JOIN tk USING (id)) GROUP BY q, id, term), sz AS (SELECT q, st1.id, len(toks) AS z FROM st1 JOIN tk USING (id)),
            sh2 AS (SELECT q, count(*)::DOUBLE AS n, greatest(avg(z), 1.0) AS a FROM sz GROUP BY q), d2 AS (SELECT q, term, count(*)::DOUBLE AS df FROM ix GROUP BY q, term),
            asked AS MATERIALIZED (SELECT lt0.q, lt0.term, qtf, n, a, coalesce(df, 0) AS df FROM lt0 JOIN sh2 USING (q) LEFT JOIN d2 USING (q, term)), hits AS MATERIALIZED (SELECT * FROM asked JOIN ix USING (q, term) JOIN sz USING (q, id)),
            b AS (SELECT q, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * z / a))), 9) AS s FROM hits GROUP BY q, id), bb AS (SELECT q, id, round(s / max(s) OVER (PARTITION BY q), 9) AS bm25 FROM b),
            nm AS (SELECT ix.q, ix.id, sum(pow(tf * (ln((n + 2) / (d2.df + CASE WHEN lt0.term IS NULL THEN 0 ELSE 1 END + 1)) + 1), 2)) AS norm FROM ix JOIN sh2 USING (q) JOIN d2 USING (q, term) LEFT JOIN lt0 USING (q, term) GROUP BY ix.q, ix.id),
            qn AS (SELECT q, sum(pow(qtf * (ln((n + 2) / (df + 2)) + 1), 2)) AS q_norm FROM asked GROUP BY q), dt AS (SELECT q, id, sum(qtf * tf * pow(ln((n + 2) / (df + 2)) + 1, 2)) AS dot FROM hits GROUP BY q, id),
            cl AS (SELECT q, id, round(dot / sqrt(norm * q_norm), 9) AS cosine FROM dt JOIN nm USING (q, id) JOIN qn USING (q)),
            rk AS (SELECT st1.q, st1.id, before, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine, row_number() OVER (PARTITION BY st1.q ORDER BY coalesce(bm25, 0) DESC, before) AS r1, row_number() OVER (PARTITION BY st1.q ORDER BY coalesce(cosine, 0) DESC, before) AS r2 FROM st1 LEFT JOIN bb USING (q, id) LEFT JOIN cl USING (q, id)),
            fz AS (SELECT *, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 12) AS f0 FROM rk), fs AS (SELECT *, round(f0 / max(f0) OVER (PARTITION BY q), 9) AS fused FROM fz),
            od AS (SELECT fs.q, fs.id, ch.doc_id, round(0.55 * fused + 0.25 * bm25 + 0.20 * cosine, 9) AS score, row_number() OVER (PARTITION BY fs.q ORDER BY fused DESC, bm25 DESC, cosine DESC, before) AS r FROM fs JOIN ch USING (id)),
            cp AS (SELECT * FROM od QUALIFY row_number() OVER (PARTITION BY q, doc_id ORDER BY r) <= 2)
            SELECT q, id, doc_id, row_number() OVER (PARTITION BY q ORDER BY r) AS rank, score FROM cp QUALIFY rank <= 14""",
        "mode_routing": " UNION ALL ".join(_branch(name) for name in V.BRANCHES),
        "store_search": f"WITH {O.BASE} SELECT q, raw.id, s AS score, published_year, row_number() OVER (PARTITION BY q ORDER BY s DESC, published_year DESC NULLS LAST, raw.id) AS rank FROM raw JOIN documents d ON d.doc_id = raw.id QUALIFY rank <= 25",
        "cross_encoder_blend": f"""WITH {O.RERANK}, e AS (SELECT rer.q, rer.id, sc, d.published_year FROM rer JOIN documents d ON d.doc_id = rer.id WHERE rank <= 40), g AS (SELECT e.*, CASE WHEN published_year IS NOT NULL THEN cosine * 8 - 2 END AS logit FROM e LEFT JOIN csr USING (q, id)),
            m AS (SELECT *, bool_or(logit IS NULL) OVER (PARTITION BY q) AS degraded FROM g), z AS (SELECT q, id, degraded, CASE WHEN degraded THEN sc ELSE round(greatest(0, least(1, 0.80 / (1 + exp(-logit)) + 0.20 * sc)), 9) END AS score FROM m)
            SELECT q, id, degraded, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM z QUALIFY rank <= 12""",
        "live_decision": f"WITH {O.ENTRIES}, t AS (SELECT q, max(sc) AS top FROM rer WHERE rank <= 8 GROUP BY q) SELECT q, (needs_latest OR coalesce(top, -1) < 0.3) AND NOT out_of_scope AS live FROM specs JOIN (SELECT id AS q FROM golden) USING (q) LEFT JOIN t USING (q)",
        "static_selection": f"""WITH {O.BASE}, head AS (SELECT q, id, rank FROM csr WHERE rank <= 40), tail AS (SELECT q, id, rank FROM bmr b WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM head h WHERE h.q = b.q AND h.id = b.id)),
            every AS (SELECT q, id, rank, bm25 AS score FROM bmr WHERE rank <= 30 UNION ALL SELECT q, id, rank, cosine FROM csr), f AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS f, max(score) AS best FROM every GROUP BY q, id), z AS (SELECT q, id, round(f / max(f) OVER (PARTITION BY q), 9) AS fz, best FROM f),
            dense AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY branch, r, id) AS rank FROM (SELECT q, id, rank AS r, 0 AS branch FROM head UNION ALL SELECT q, id, rank, 1 FROM tail))
            SELECT 'legacy' AS backend, 'legacy' AS actual, q, id, rank FROM bmr UNION ALL SELECT 'other', 'legacy', q, id, rank FROM bmr UNION ALL SELECT 'dense', 'dense', q, id, rank FROM dense
            UNION ALL SELECT 'hybrid', 'hybrid', q, id, rank FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY fz DESC, best DESC, id) AS rank FROM z QUALIFY rank <= 40)""",
        "prompt_text": f"""WITH {O.RERANK}, e AS (SELECT rer.q, rer.rank, '[' || rer.rank || '] ' || coalesce(d.title, '') || chr(10) || '元数据：' || concat_ws(' | ', coalesce(d.evidence_level, ''), d.source, d.published_year::VARCHAR) || chr(10) || '内容：' || coalesce(d.text, '') || chr(10) || 'URL：' || coalesce({url.replace('record_id', 'd.record_id')}, '') AS b FROM rer JOIN documents d ON d.doc_id = rer.id WHERE rer.rank <= 5),
            l AS (SELECT q, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS listed FROM e GROUP BY q), p AS (SELECT g.id AS q, '用户问题：' || coalesce(question, '') || chr(10) || chr(10) || '可引用列表：' || chr(10) || coalesce(listed, '') AS prompt FROM golden g LEFT JOIN l ON l.q = g.id)
            SELECT q, length(prompt) AS n_chars, sha256(prompt) AS prompt_hash FROM p""",
        "refusal_texts": f"WITH {O.SPECS}, c AS (SELECT q, CASE WHEN contains_phi THEN 'PHI_BLOCKED' WHEN personalized THEN 'PERSONALIZED_TREATMENT' WHEN out_of_scope THEN 'OUT_OF_SCOPE' WHEN unverifiable THEN 'UNVERIFIABLE_INTERVENTION' END AS code FROM specs) SELECT q, code IS NOT NULL AS refused, code, 0 AS n_found, {refusal(0)} AS missing, {refusal(1)} AS next_steps FROM c",
        "public_sources": f"WITH {O.VERIFIED} SELECT DISTINCT claim_id, citation, title, sha256(substring(text, 1, 800)) AS excerpt_hash, {url} AS url FROM verified JOIN documents ON doc_id = citation WHERE usable",
        "publish_rejections": f"WITH {_RUNS} SELECT run, code, n FROM rej",
        "publish_ledger": f"""WITH {_RUNS}, p AS (SELECT run, array_to_string(list_sort(list(DISTINCT code)), '|') AS problems FROM rej GROUP BY run), a AS (SELECT run, count(*) AS d FROM sd GROUP BY run), c AS (SELECT run, count(*) AS c FROM sc GROUP BY run)
            SELECT run, source, CASE WHEN problems IS NULL THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN problems IS NULL THEN coalesce(d, 0) ELSE 0 END AS records_seen, CASE WHEN problems IS NULL THEN coalesce(c, 0) ELSE 0 END AS chunks_seen, coalesce(problems, '') AS problems FROM runs LEFT JOIN p USING (run) LEFT JOIN a USING (run) LEFT JOIN c USING (run) WHERE status <> 'succeeded'""",
        "visible_chunks": "SELECT doc_id, count(*) AS n_chunks FROM chunks c WHERE EXISTS (SELECT 1 FROM documents d JOIN source_catalog s ON s.id = d.source WHERE d.doc_id = c.doc_id AND s.enabled) GROUP BY doc_id",
        "staged_payloads": "SELECT doc_id, published_year, len(coalesce(authors, [])) AS n_authors, sha256(concat_ws('|', record_id, title, source, array_to_string(authors, ';'))) AS content_hash FROM documents",
        "document_rows": "SELECT record_id AS id, count(*) AS n, max(coalesce(strftime(source_updated_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), 'offline-snapshot')) AS retrieved_at, max(len(coalesce(authors, []))) AS most_authors, min(coalesce(evidence_level, 'Other')) AS level FROM documents GROUP BY 1",
        "content_digests": f"SELECT doc_id, sha256({dig}) AS digest, CASE WHEN {slug} = '' THEN 'value' ELSE {slug} END || '-' || substring(sha256(coalesce(journal, '')), 1, 8) AS slug, substring(sha256(concat_ws('|', source, coalesce(title, ''), '5', 'v1')), 1, 20) AS cache_key FROM documents",
        "cache_ages": "WITH m AS (SELECT max(retrieved_at) AS now FROM documents) SELECT source, count(*) FILTER (WHERE floor(epoch(now)) - floor(epoch(retrieved_at)) <= 7776000) AS n_fresh, count(*) FILTER (WHERE floor(epoch(now)) - floor(epoch(retrieved_at)) > 7776000) AS n_stale FROM documents, m WHERE retrieved_at IS NOT NULL GROUP BY source",
        "pmid_lookup": "WITH c AS (SELECT item_id, unnest(source_ids) AS r, generate_subscripts(source_ids, 1) - 1 AS pos FROM review_template), p AS (SELECT substring(r, 6) AS pmid, arg_max(item_id, item_id || '/' || pos) AS source FROM c WHERE r LIKE 'pmid:%' GROUP BY 1) SELECT pmid, source, NOT EXISTS (SELECT 1 FROM documents WHERE record_id = 'pmid:' || pmid) AS missing FROM p",
        "longest_versions": "SELECT record_id, max(length(text)) AS n_chars FROM documents WHERE record_id IS NOT NULL GROUP BY 1",
        "topic_references": "SELECT coalesce(topic, '') AS topic, count(DISTINCT record_id) AS n_references, count(DISTINCT journal) AS n_journals, coalesce(array_to_string(list_sort(list(DISTINCT evidence_level) FILTER (WHERE evidence_level IS NOT NULL)), '|'), '') AS levels FROM documents GROUP BY 1",
        "ledger_issues": " UNION ALL ".join(
            [
                rule("id_missing", "trim(coalesce(record_id, '')) = ''"), rule("status_missing", "trim(coalesce(extraction_status, '')) = ''"), rule("basis_missing", "study_type IS NULL AND evidence_level IS NOT NULL"), rule("basis_blank", "trim(study_type) = ''"),
                rule("full_text_without_digest", "extraction_status = 'full_text' AND page_count IS NULL"), rule("file_digest_invalid", "page_count IS NOT NULL AND text IS NULL"), rule("metadata_digest_invalid", "title IS NULL"), rule("address_invalid", f"NOT regexp_matches(coalesce({url}, ''), '^https?://[^/\\s]+')"),
                rule("index_version_differs", "source_updated_at IS NULL"), rule("parser_version_differs", "lang IS DISTINCT FROM 'en'"),
            ]
        ),
        "output_issues": "SELECT CASE WHEN coalesce(labels.behavior, '') NOT IN ('answer', 'qualified_answer', 'refuse') THEN 'behavior_invalid' WHEN trim(coalesce(labels.rationale, '')) = '' THEN 'answer_missing' WHEN labels.behavior = 'refuse' AND trim(coalesce(labels.error_types[1], '')) = '' THEN 'refusal_code_missing' ELSE 'none' END AS issue, count(*) AS n FROM review_template GROUP BY 1",
        "locator_checks": f"WITH {chosen} SELECT CASE WHEN ch.text = '' OR strpos(d.text, ch.text) = 0 THEN 'locator_mismatch' ELSE 'none' END AS issue, count(*) AS n FROM ch JOIN documents d USING (doc_id) WHERE ch.text IS NOT NULL AND d.text IS NOT NULL GROUP BY 1",
        "leakage_families": f"WITH f AS (SELECT DISTINCT id, lower(trim(semantic_family_id)) AS family FROM questions WHERE trim(semantic_family_id) <> '') SELECT family AS key, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT {O.BLANKS})), '|') AS splits FROM independent_synthetic_v1 JOIN f USING (id) WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {O.BLANKS}) > 1",
        "conflicting_groups": f"SELECT {O.HASH('question')} AS key, {O.BLANKS} AS split, count(DISTINCT lower(trim(question_group_id))) AS n_groups FROM independent_synthetic_v1 WHERE question IS NOT NULL AND split IS NOT NULL AND trim(question_group_id) <> '' GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(question_group_id))) > 1",
        "derived_leakage": f"""WITH RECURSIVE l AS (SELECT DISTINCT id, unnest(derived_from) AS parent FROM questions), c(id, ancestor, distance) AS (SELECT id, parent, 1 FROM l WHERE parent IS NOT NULL UNION SELECT c.id, l.parent, c.distance + 1 FROM c JOIN l ON l.id = c.ancestor WHERE c.distance < 20 AND l.parent IS NOT NULL),
            s AS (SELECT id, min({O.BLANKS}) AS split FROM independent_synthetic_v1 WHERE id IS NOT NULL AND split IS NOT NULL GROUP BY id)
            SELECT DISTINCT c.id, ancestor, a.split, b.split AS ancestor_split FROM c JOIN s a ON a.id = c.id JOIN s b ON b.id = c.ancestor WHERE a.split <> b.split""",
        "blind_package": "WITH a AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY sha256('blind-7|' || question_id || '|' || item_id), item_id) AS alias FROM (SELECT DISTINCT question_id, item_id FROM review_template WHERE item_id IS NOT NULL)) SELECT DISTINCT question_id, alias, rubric_version, len(source_ids) AS n_sources FROM review_template JOIN a USING (question_id, item_id)",
        "quality_report": f"WITH {_GENS}, v AS (SELECT q, count(*) AS repeats, {', '.join(f'count({m}) AS n_{m}, avg({m}) AS m_{m}' for m in REPORT_METRICS)} FROM gens GROUP BY q), rep AS MATERIALIZED (SELECT * FROM qs LEFT JOIN v USING (q)) {report}",
        "version_comparison": f"WITH {_GENS}, mm AS MATERIALIZED (SELECT q, rubric_version, {', '.join(f'avg({m}) AS {m}' for m in REPORT_METRICS)} FROM gens GROUP BY 1, 2) {compare}",
        "run_alignment": """WITH a AS (SELECT question_id AS k, list_sort(list(DISTINCT output_hash)) AS x FROM review_template WHERE rubric_version = 'dual-review-v1' AND output_hash IS NOT NULL GROUP BY 1), b AS (SELECT question_id AS k, list_sort(list(DISTINCT output_hash)) AS y FROM review_template WHERE rubric_version = 'dual-review-v2' AND output_hash IS NOT NULL GROUP BY 1)
            SELECT CASE WHEN x IS NULL THEN 'only_after' WHEN y IS NULL THEN 'only_before' WHEN x = y THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1""",
        "result_summary": f"WITH {_GENS}, s AS MATERIALIZED (SELECT *, CASE WHEN coalesce(said, '') = '' THEN 'error' WHEN said IN ('answer', 'qualified_answer', 'refuse') THEN 'success' ELSE 'skipped' END AS st FROM gens) {summary}",
        "family_recall": f"""WITH {O.BINARY}, {family_docs}, wn AS (SELECT rel.q, rel.id, {O.FAMILY} AS family FROM rel JOIN fd ON fd.doc_id = rel.id), h AS (SELECT wn.q, count(DISTINCT family) AS n FROM wn JOIN lex USING (q, id) WHERE rank <= 8 GROUP BY wn.q)
            SELECT q, count(DISTINCT family) AS n_families, coalesce(any_value(h.n), 0) AS n_found, round(coalesce(any_value(h.n), 0) / count(DISTINCT family)::DOUBLE, 9) AS family_recall FROM wn LEFT JOIN h USING (q) GROUP BY q""",
        "profile_benchmark": f"""WITH {O.BINARY}, m AS MATERIALIZED ({binary('bmr', 'bm25')} UNION ALL {binary('csr', 'cosine')} UNION ALL {binary('lex', 'fused')}), tp AS (SELECT DISTINCT id AS q, unnest(relevant_topics) AS topic FROM test_set),
            wo AS (SELECT profile, min(r) AS worst FROM (SELECT profile, coalesce(topic, 'unclassified') AS t, avg(recall) AS r FROM m LEFT JOIN tp USING (q) GROUP BY 1, 2) GROUP BY 1), ms AS (SELECT CASE event_type WHEN 'view' THEN 'bm25' WHEN 'click' THEN 'cosine' WHEN 'error' THEN 'fused' END AS profile, avg(value) AS ms FROM events GROUP BY 1)
            SELECT profile, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(any_value(worst), 6) AS worst_topic, round(0.45 * avg(recall) + 0.25 * avg(ndcg) + 0.15 * avg((rr = 1)::INT::DOUBLE) + 0.10 * any_value(worst) + 0.05 / (1 + coalesce(any_value(ms), 0) / 2500), 6) AS score FROM m JOIN wo USING (profile) LEFT JOIN ms USING (profile) GROUP BY profile""",
        "evidence_sources": f"WITH {family_docs}, n AS (SELECT DISTINCT id AS q, unnest(relevant_doc_ids) AS doc_id FROM test_set) SELECT q, count(*) AS n_documents, count(DISTINCT {reliable}) AS n_sources FROM n JOIN fd USING (doc_id) GROUP BY q",
    }
