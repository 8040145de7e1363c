"""Claim verification: citation mapping, existence of sources, numbers, polarity, lexical support, sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions import vocabulary as V
from veridex.functions.text import numeric_consistency, overlap, polarity_conflict

CITATIONS = "array<struct<type: string, source: string, pmid: string, doi: string, nct_id: string, chapter: string, url: string, verified_at: string>>"
DOUBTFUL = ("unverified", "not_checked")


def evidence_text(title: Column, year: Column, status: Column, text: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c.cast("string"), F.lit("")) for c in (title, year, status, text)])


def existence(source: Column, identity: Column, url: Column, citations: Column | None = None) -> Column:
    """How well a cited source can be looked up: verified_snapshot, manual_review, source_record or unverified.

    A knowledge page stands on its citations: all its PMIDs need an address and a date of verification, else all its
    citations an address. Other sources need an address and an identity (canonical id) of the right shape.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    linked = filled(url)
    cites = F.coalesce(citations, F.array().cast(CITATIONS)) if citations is not None else F.array().cast(CITATIONS)
    numbered = F.filter(cites, lambda c: c["type"] == "pmid")
    checked = F.forall(numbered, lambda c: filled(c["pmid"]) & filled(c["url"]) & filled(c["verified_at"]))
    page = F.when(F.size(numbered) > 0, F.when(checked, "verified_snapshot").otherwise("unverified")).when((F.size(cites) > 0) & F.forall(cites, lambda c: filled(c["url"])), "manual_review").otherwise("unverified")
    shaped = identity.rlike(r"^(?:pmid:[0-9]{5,9}|nct:NCT[0-9]{8})$") | ~identity.rlike(r"^(?:pmid|nct):")
    return F.when(source == "knowledge_page", page).when(linked & filled(identity) & shaped, "source_record").otherwise("unverified")


def support(claim: Column, evidence: Column, text: Column, generator: str = "extractive") -> Column:
    """unsupported, partial or support: numbers first, then identical text of an extractive generator, denial, token overlap."""
    shared = overlap(claim, evidence)
    label = F.when(~numeric_consistency(claim, evidence), "unsupported")
    if generator == "extractive":
        label = label.when(F.trim(claim) == F.trim(text), "support")
    return label.when(polarity_conflict(claim, text), "unsupported").when(shared >= V.SUPPORT, "support").when(shared >= V.PARTIAL, "partial").otherwise("unsupported")


def verify(claims: DataFrame, entries: DataFrame, generator: str = "extractive") -> DataFrame:
    """One row per claim and cited id: (claim_id, citation, mapped, existence, support, numbers_agree, usable).

    ``claims`` has claim_id, text, citations; ``entries`` has citation, title, year, status, text, source, identity, url and
    may have citations (of knowledge pages). Repeated citations of a claim count once; a claim without citations has one
    row with a null citation. A citation is usable if it is mapped, its source exists, it supports the claim wholly and
    every number agrees.
    """
    spread = claims.select("claim_id", F.col("text").alias("claim"), F.explode_outer(F.array_distinct("citations")).alias("citation"))
    own = F.col("citations") if "citations" in entries.columns else None
    known = entries.select(
        "citation", F.lit(True).alias("mapped"), F.coalesce("text", F.lit("")).alias("entry_text"), evidence_text(F.col("title"), F.col("year"), F.col("status"), F.col("text")).alias("evidence"),
        existence(F.col("source"), F.col("identity"), F.col("url"), own).alias("existence"),
    )
    rows = spread.join(known, "citation", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    claim = F.coalesce("claim", F.lit(""))
    agree = F.coalesce(F.col("mapped") & numeric_consistency(claim, F.col("evidence")), F.lit(False))
    label = F.when(F.col("mapped"), support(claim, F.col("evidence"), F.col("entry_text"), generator)).otherwise("unsupported")
    checked = rows.select("claim_id", "citation", "mapped", F.coalesce("existence", F.lit("not_checked")).alias("existence"), label.alias("support"), agree.alias("numbers_agree"))
    return checked.withColumn("usable", F.col("mapped") & ~F.col("existence").isin(*DOUBTFUL) & (F.col("support") == "support") & F.col("numbers_agree"))


def claim_checks(verified: DataFrame) -> DataFrame:
    """(claim_id, n_citations, n_usable, kept): a claim stays if one of its citations can be used."""
    per = verified.groupBy("claim_id").agg(F.count("citation").alias("n_citations"), F.sum(F.col("usable").cast("long")).alias("n_usable"))
    return per.withColumn("kept", F.col("n_usable") > 0)


def answer_checks(claims: DataFrame, checks: DataFrame, by: str) -> DataFrame:
    """(by, n_claims, n_kept, failure_ratio, n_removed, valid): claims that fail over all claims of an answer, and citations removed."""
    rows = claims.select("claim_id", by).join(checks, "claim_id")
    per = rows.groupBy(by).agg(
        F.count("*").alias("n_claims"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.round(F.avg((~F.col("kept")).cast("double")), 9).alias("failure_ratio"),
        F.sum(F.col("n_citations") - F.col("n_usable")).alias("n_removed"),
    )
    return per.withColumn("valid", (F.col("failure_ratio") == 0) & (F.col("n_removed") == 0))


def sanitise(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """(claim_id, text, citations): claims with their usable citations only; claims without any are dropped."""
    good = verified.where("usable").groupBy("claim_id").agg(F.array_sort(F.collect_set("citation")).alias("citations"))
    return claims.select("claim_id", "text").join(good, "claim_id")


def extractive(entries: DataFrame, most: int = 4, prefix: int = 80) -> DataFrame:
    """(q, id, position): direct entries in order, distinct by the first signs of their text, at most ``most``."""
    first = entries.where("coverage = 'direct'").withColumn("turn", F.row_number().over(Window.partitionBy("q", F.substring("text", 1, prefix)).orderBy("rank")))
    kept = first.where("turn = 1").withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("rank")))
    return kept.where(F.col("position") <= most).select("q", "id", "position")


def prompts(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(q, prompt): the question with its numbered evidence, from (q, question) and (q, citation_number, title, level, source,
    year, status, text, url). Entries of a question are a small packet; a question without entries lists none."""
    filled = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", c.cast("string"))
    meta = F.concat_ws(" | ", F.col("level"), F.col("source"), filled(F.col("year")), F.concat(F.lit("status="), filled(F.col("status"))))
    block = F.concat(F.lit("["), F.col("citation_number").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n元数据："), meta, F.lit("\n内容："), F.coalesce("text", F.lit("")), F.lit("\nURL："), F.coalesce("url", F.lit("")))
    listed = entries.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("citation_number").alias("n"), block.alias("b")))).alias("x")).select("q", F.array_join("x.b", "\n\n").alias("listed"))
    body = F.concat(F.lit("用户问题："), F.coalesce("question", F.lit("")), F.lit("\n\n可引用列表：\n"), F.coalesce("listed", F.lit("")))
    return questions.select("q", "question").join(listed, "q", "left").select("q", body.alias("prompt"))


def public_projection(verified: DataFrame, entries: DataFrame, excerpt: int = 800) -> DataFrame:
    """(claim_id, citation, title, excerpt, url): the sources that a shown claim cites, and nothing of the others."""
    shown = entries.select("citation", "title", F.substring("text", 1, excerpt).alias("excerpt"), "url")
    return verified.where("usable").select("claim_id", "citation").distinct().join(shown, "citation")
