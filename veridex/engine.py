"""Questions in, verified answers out: the whole chain over a batch of questions.

Refused questions leave the chain early and come back with their code at the end; every stage is a DataFrame keyed by q.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import identity
from veridex.operators import gates, pool, retrieval, verification
from veridex.session import Stage
from veridex.shipping import ship


@dataclass(frozen=True)
class Settings:
    """Budgets, thresholds and policies of the chain."""

    retrieve_k: int = 40
    top_k: int = 8
    generation_top_k: int = 5
    most_claims: int = 4
    least_sources: int = 3
    pre_threshold: float = 0.18
    most_failures: float = 0.5
    selection: str = "legacy"  # or document_diverse
    pool_policy: str = "source_preserving"  # or legacy
    mode: str = "hybrid"  # or knowledge, rag: which sources are read, where a source list is given
    sources: tuple[str, ...] = ()  # sources that may be read; empty for all
    degraded: bool = False  # evaluation only: the last rows of the ranking in reverse
    this_year: int = 2025


def searchable(title: Column, topic: Column, text: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, topic, text)])


def document_index(documents: DataFrame, root: str | None = None) -> retrieval.Index:
    """The search index of documents (doc_id, title, topic, text), to be kept between batches of questions. Where documents
    have a published_year, rankings may prefer later ones."""
    year = F.col("published_year") if "published_year" in documents.columns else None
    return retrieval.build_index(documents, "doc_id", searchable(F.col("title"), F.col("topic"), F.col("text")), root, year)


def described(documents: DataFrame) -> DataFrame:
    """Columns that the chain reads of documents (doc_id, record_id, source, title, text, topic, evidence_level,
    published_year), with identity, reliable family, aliases and address; url is taken from the record id where missing."""
    record = F.col("record_id")
    url = F.coalesce(F.col("url"), identity.address(record)) if "url" in documents.columns else identity.address(record)
    base = documents.withColumn("address", F.coalesce(url, F.lit("")))
    study = identity.research_family(record, record, F.col("address"))
    own = identity.document_identity(F.col("source"), record, record, F.col("address"))
    family = identity.reliable_family(study)
    ids = F.when(F.col("source") == "knowledge_page", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(identity.aliases(F.concat_ws(" ", record, "address")))
    return base.select(
        F.col("doc_id").alias("id"), "record_id", "source", "title", "text", "topic", F.col("evidence_level").alias("level"), "published_year", searchable(F.col("title"), F.col("topic"), F.col("text")).alias("searchable"),
        own.alias("identity"), family.alias("family"), study.alias("study"), ids.alias("ids"), identity.alias_names(ids).alias("aliases"), F.col("address").alias("url"), identity.canonical_source(record, record, F.col("address")).alias("canonical"),
    )


def conflicted(rows: DataFrame) -> DataFrame:
    """(identity) of documents whose rows (identity, ids) name two different values of one kind."""
    return pool.conflicts(rows.select("identity", F.explode("ids").alias("x")).select("identity", "x.kind", "x.value"))


def candidates(rows: DataFrame, policy: str = "source_preserving", conflicts: DataFrame | None = None) -> DataFrame:
    """(q, id) of rows (q, id, identity, ids, study, text, source, retrieval) that a pool policy keeps; unknown policies raise.
    ``conflicts`` are those of more rows than these."""
    named = rows.withColumn("name", F.col("id").cast("string"))
    if policy == "source_preserving":
        kept = pool.preserve_sources(named.select("q", F.col("name").alias("id"), "identity", "text", "source", F.col("retrieval").alias("score")), conflicted(rows) if conflicts is None else conflicts)
    elif policy == "legacy":
        kept = pool.legacy_pool(named.select("q", F.col("name").alias("id"), F.col("study").alias("family"), "text", "source", F.col("retrieval").alias("score"), F.col("id").alias("pos")))
    else:
        raise ValueError(f"unknown pool policy {policy}")
    kind = dict(rows.dtypes)["id"]
    return kept.where("reason = 'retained'").select("q", F.col("id").cast(kind).alias("id"))


def ask(questions: DataFrame, documents: DataFrame, settings: Settings | None = None, index: retrieval.Index | None = None, bound: int = retrieval.POOL_ROWS) -> DataFrame:
    """(q, code, n_entries, n_sources, claims) per question of (id, question); a null code is an answer.

    ``index`` is the kept index of the same documents; without one they are indexed here. Claims are extracts with the
    document they cite; each has been held against its source again. A null question reads as empty and is refused.
    After the search, questions with at most ``bound`` candidates go through the chain at a time.
    """
    settings = settings or Settings()
    if settings.selection not in ("legacy", "document_diverse"):
        raise ValueError(f"unknown selection {settings.selection}")
    spark = questions.sparkSession
    ship(spark)
    stage = Stage(spark, "ask")
    specs = stage.write(gates.specify(questions, "id", "question", settings.this_year))
    refused = gates.safety(specs)
    open_ = stage.write(specs.join(refused.where("code is null").select("q"), "q"))
    documents = retrieval.allowed(documents, list(settings.sources))
    index = index or document_index(documents)
    found = retrieval.lexical_search(open_, "q", F.array_join("local_terms", " "), index, settings.retrieve_k)
    found = stage.write(found.select("q", "id", F.col("score").alias("retrieval")))
    documents = described(documents)
    conflicts = stage.write(conflicted(retrieval.near(stage.write(found.select("id").distinct())).join(documents, "id")))
    answered = retrieval.in_blocks(specs, "q", lambda own: _answered(own, open_, found, documents, conflicts, settings), max(1, bound // settings.retrieve_k))
    stage.clear()
    return answered


def _answered(specs: DataFrame, asked: DataFrame, found: DataFrame, documents: DataFrame, conflicts: DataFrame, settings: Settings) -> DataFrame:
    """Written answers to questions, of all those asked, the rows (q, id, retrieval) found and their conflicts. Texts stay with the
    documents until the entries of a question are chosen."""
    spark = specs.sparkSession
    stage = Stage(spark, "answer")
    refused = gates.safety(specs)
    open_ = stage.write(retrieval.of_rows(asked, "q", specs))
    found = stage.write(retrieval.of_rows(found, "q", open_))
    kept = candidates(retrieval.near(found).join(documents, "id"), settings.pool_policy, conflicts)
    found = stage.write(found.join(kept, ["q", "id"]))
    rows = retrieval.near(found).join(documents, "id")
    scores = retrieval.local_scores(open_, "q", F.col("safe_query"), rows, F.col("searchable"))
    ranking = pool.rerank(rows.select("q", "id", "retrieval", "source", "level").join(scores, ["q", "id"]), settings.retrieve_k)
    entries = stage.write(ranking.select("q", "id", "rank", "score", "role"))
    if settings.degraded:
        last = retrieval.ranked(entries.select("q", "id", F.col("rank").alias("before")), settings.top_k, F.desc("before"))
        entries = entries.drop("rank").join(last.select("q", "id", "rank"), ["q", "id"])
    elif settings.selection == "document_diverse":
        named = retrieval.near(entries).join(documents.select("id", "identity", "family"), "id")
        picks = pool.document_diverse(named.withColumn("id", F.col("id").cast("string")), settings.top_k)
        entries = entries.drop("rank").join(picks.select("q", F.col("id").cast("long").alias("id"), F.col("citation_number").alias("rank")), ["q", "id"])
    else:
        entries = entries.where(F.col("rank") <= settings.top_k)
    entries = stage.write(retrieval.near(stage.write(entries)).join(documents.drop("searchable"), "id"))

    coverage = stage.write(gates.partition_coverage(open_, entries))
    uncovered = gates.coverage_gate(open_, coverage).withColumnRenamed("code", "cover_code")
    covered = entries.join(coverage.where("coverage <> 'none'"), ["q", "id"])
    # citation numbers stay those of the first entries; the gate counts places among what is left
    covered = stage.write(retrieval.ranked(covered.withColumn("citation_number", F.col("rank").cast("int")).drop("rank"), settings.top_k, F.asc("citation_number")))
    evidence = stage.write(gates.evidence_gate(open_, covered, settings.pre_threshold, settings.least_sources))
    passing = covered.join(evidence.where("code is null").select("q"), "q").join(uncovered.where("cover_code is null").select("q"), "q")
    chosen = stage.write(passing.drop("rank").join(pool.packet(passing.withColumn("family", F.col("study")), settings.generation_top_k).select("q", "id"), ["q", "id"]))
    packet = stage.write(retrieval.ranked(chosen, settings.generation_top_k, F.asc("citation_number")))
    second = stage.write(gates.evidence_gate(open_.join(packet.select("q").distinct(), "q"), packet, settings.pre_threshold, settings.least_sources))
    packet = packet.join(second.where("code is null").select("q"), "q")

    extracts = verification.extractive(packet, settings.most_claims).join(packet.select("q", "id", "text"), ["q", "id"])
    said = extracts.select(F.struct("q", "position").alias("claim_id"), "q", "text", F.array(F.struct("q", "id")).alias("citations"))
    claims = stage.write(gates.claims_in_focus(open_, said))
    sources = packet.select(F.struct("q", "id").alias("citation"), "title", F.col("published_year").alias("year"), F.lit(None).cast("string").alias("status"), "text", "source", F.col("canonical").alias("identity"), "url")
    verified = stage.write(verification.verify(claims, sources))
    checks = verification.answer_checks(claims, verification.claim_checks(verified), "q")
    clean = verification.sanitise(claims, verified).select("claim_id.q", F.struct(F.col("claim_id.position").alias("position"), "text", F.transform("citations", lambda c: c["id"]).alias("documents")).alias("claim"))
    answers = clean.groupBy("q").agg(F.sort_array(F.collect_list("claim")).alias("claims"))
    # what is left after sanitising decides whether anything can be said
    asked = second.where("code is null").select("q").join(checks, "q", "left").select("q", F.lit(False).alias("refused"), F.coalesce("n_kept", F.lit(0)).alias("n_claims"), F.coalesce("failure_ratio", F.lit(1.0)).alias("failure_ratio"))
    after = gates.post_gate(asked, settings.most_failures).withColumnRenamed("code", "post_code")

    whole = refused.withColumnRenamed("code", "safety_code").join(uncovered, "q", "left").join(evidence, "q", "left").join(second.select("q", F.col("code").alias("second_code")), "q", "left").join(after, "q", "left").join(answers, "q", "left")
    code = F.coalesce("safety_code", "cover_code", "code", "second_code", "post_code")
    out = whole.select("q", code.alias("code"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), F.when(code.isNull(), F.col("claims")).alias("claims"))
    answered = Stage(spark, "answers").write(out)
    stage.clear()
    return answered
