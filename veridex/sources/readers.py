"""Readers of the corpus formats; schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridex.functions.identity import classification
from veridex.functions.text import split_text

CITATION = "struct<type: string, source: string, pmid: string, doi: string, nct_id: string, chapter: string, url: string, verified_at: string>"
PAGE = f"id string, title string, topic string, keywords array<string>, summary string, claims array<struct<id: string, text: string, evidence_level: string, applicable: string, exceptions: string, citations: array<{CITATION}>>>, limitations string, updated_at string"
DOCUMENT = "id string, source string, title string, abstract string, journal string, year int, authors array<string>, study_type string, status string, evidence_level string, url string, retrieved_at string, topic string"


def knowledge_pages(spark: SparkSession, path: str) -> DataFrame:
    """One chunk per claim of JSON pages: text with its population and exceptions, keywords kept as a search hint.

    Claims without an id take the page's id and their position from 1; pages without claims give no rows.
    """
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path)
    rows = pages.select(F.col("id").alias("doc_id"), "title", "topic", F.concat_ws(" ", F.coalesce("keywords", F.array())).alias("hint"), F.posexplode("claims").alias("at", "claim"))
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    text = F.concat_ws(" ", F.nullif(F.col("claim.text"), F.lit("")), part("适用人群：", F.col("claim.applicable")), part("例外：", F.col("claim.exceptions")))
    return rows.select(
        F.coalesce(F.nullif(F.col("claim.id"), F.lit("")), F.concat_ws(":", "doc_id", (F.col("at") + 1).cast("string"))).alias("id"), "doc_id", F.lit("knowledge_page").alias("source"), "title", text.alias("text"),
        F.coalesce("claim.evidence_level", F.lit("Other")).alias("evidence_level"), F.get("claim.citations", F.lit(0))["url"].alias("url"), "topic", "hint", "claim.citations",
    )


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array; an empty retrieval time reads as offline-snapshot."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return rows.withColumn("retrieved_at", F.coalesce(F.nullif("retrieved_at", F.lit("")), F.lit("offline-snapshot")))


def document_chunks(documents: DataFrame, text: str = "abstract", most: int = 900) -> DataFrame:
    """(id, doc_id, position, text): chunks of whole sentences, ids count from 1 within the document."""
    key = "id" if "id" in documents.columns else "doc_id"
    spread = documents.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(split_text(F.col(text), most)).alias("at", "text"))
    return spread.select(F.concat_ws(":", "doc_id", F.lit("chunk"), (F.col("at") + 1).cast("string")).alias("id"), "doc_id", (F.col("at") + 1).alias("position"), "text")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV manifest with its byte order mark; raises if a pmid is empty, no number, or repeated."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").schema("pmid string, title string, dest_pdf string, nlm_unique_id string, pub_year string").csv(path)
    rows = rows.withColumn("pmid", F.trim(F.regexp_replace("pmid", "^\\x{FEFF}", "")))
    bad = rows.agg(F.count("*").alias("n"), F.countDistinct("pmid").alias("d"), F.count(F.when(~F.coalesce(F.col("pmid"), F.lit("")).rlike("^[0-9]+$"), 1)).alias("b")).first()
    if bad["b"] or bad["d"] != bad["n"]:
        raise ValueError("every pmid of a manifest must be a number that stands there once")
    return rows


def pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles of PubMed XML: id, title, abstract (the title where there is none), types with their level, first year."""
    schema = (
        "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>, "
        "PublicationTypeList: struct<PublicationType: array<string>>, AuthorList: struct<Author: array<struct<CollectiveName: string, ForeName: string, LastName: string>>>>>"
    )
    article = F.col("MedlineCitation.Article")
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    types = article["PublicationTypeList"]["PublicationType"]
    level = classification(types, F.lit(False))
    date = article["Journal"]["JournalIssue"]["PubDate"]
    name = lambda a: F.coalesce(a["CollectiveName"], F.concat_ws(" ", a["ForeName"], a["LastName"]))
    return rows.select(
        F.concat(F.lit("pmid:"), F.col("MedlineCitation.PMID")).alias("id"), article["ArticleTitle"].alias("title"), F.coalesce(F.nullif(F.concat_ws(" ", article["Abstract"]["AbstractText"]), F.lit("")), article["ArticleTitle"]).alias("abstract"),
        article["Journal"]["Title"].alias("journal"), F.nullif(F.regexp_extract(F.coalesce(date["Year"], date["MedlineDate"], F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int").alias("year"),
        F.transform(article["AuthorList"]["Author"], name).alias("authors"), level["evidence_level"].alias("evidence_level"), level["review_status"].alias("review_status"),
    )


def europe_pmc(spark: SparkSession, path: str, drop_preprints: bool = True) -> DataFrame:
    """Results of Europe PMC JSON; preprints are dropped if asked; ids prefer the pmid."""
    schema = "resultList struct<result: array<struct<id: string, source: string, pmid: string, title: string, abstractText: string, journalTitle: string, pubYear: string, pubTypeList: struct<pubType: array<string>>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("resultList.result").alias("r"))
    preprint = (F.col("r.source") == "PPR") | F.exists(F.coalesce(F.col("r.pubTypeList.pubType"), F.array().cast("array<string>")), lambda t: F.lower(t).contains("preprint"))
    rows = r.withColumn("preprint", F.coalesce(preprint, F.lit(False)))
    kept = rows.where(~F.col("preprint")) if drop_preprints else rows
    level = classification(F.col("r.pubTypeList.pubType"), F.col("preprint"))
    return kept.select(
        F.coalesce(F.concat(F.lit("pmid:"), F.nullif(F.col("r.pmid"), F.lit(""))), F.concat_ws(":", F.lit("europepmc"), "r.source", "r.id")).alias("id"), F.col("r.title").alias("title"), F.coalesce("r.abstractText", F.lit("")).alias("abstract"),
        F.col("r.journalTitle").alias("journal"), F.when(F.col("r.pubYear").rlike("^[0-9]{4}$"), F.col("r.pubYear").cast("int")).alias("year"), level["evidence_level"].alias("evidence_level"),
    )


def clinical_trials(spark: SparkSession, path: str) -> DataFrame:
    """Studies of trial registry JSON: id, title, summary, status, start year."""
    schema = "studies array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string>, statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>>, descriptionModule: struct<briefSummary: string>, designModule: struct<studyType: string>>>>"
    s = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("studies.protocolSection").alias("s"))
    return s.select(
        F.concat(F.lit("nct:"), F.col("s.identificationModule.nctId")).alias("id"), F.col("s.identificationModule.briefTitle").alias("title"), F.coalesce("s.descriptionModule.briefSummary", F.lit("")).alias("abstract"),
        F.col("s.statusModule.overallStatus").alias("status"), F.nullif(F.regexp_extract(F.coalesce("s.statusModule.startDateStruct.date", F.lit("")), r"^(\d{4})", 1), F.lit("")).cast("int").alias("year"), F.lit("ClinicalTrial").alias("evidence_level"),
    )


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, is_pdf): files by whether a PDF mark stands in their first 1024 bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", (F.locate("%PDF-", F.decode(F.substring("content", 1, 1024), "ISO-8859-1")) > 0).alias("is_pdf"))


def order_blocks(blocks: DataFrame) -> DataFrame:
    """Reading order of page blocks (doc_id, page, width, x0, y0, x1, y1, text): adds position from 1.

    Blocks wider than 62 % of the page are anchors that part it into regions; in a two-column region the left column comes
    before the right one, else blocks run from top to bottom. A page is two-column if both sides hold 120 signs or more.
    """
    page = Window.partitionBy("doc_id", "page")
    wide = (F.col("x1") - F.col("x0")) > 0.62 * F.col("width")
    left, right = ~wide & (F.col("x1") <= F.col("width") * 0.55), ~wide & (F.col("x0") >= F.col("width") * 0.45)
    sized = blocks.withColumn("wide", wide).withColumn("two", (F.sum(F.when(left, F.length("text")).otherwise(0)).over(page) >= 120) & (F.sum(F.when(right, F.length("text")).otherwise(0)).over(page) >= 120))
    down = page.orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)
    region = F.sum(F.when(F.col("wide"), 2).otherwise(0)).over(down) - F.when(F.col("wide"), 1).otherwise(0)
    placed = sized.withColumn("region", F.when(F.col("two"), region).otherwise(0)).withColumn("column", F.when(F.col("two") & right, 1).otherwise(0))
    return placed.withColumn("position", F.row_number().over(page.orderBy("region", "column", F.round("y0", 1), "x0"))).drop("wide", "two", "region", "column")


def first_wins(frames: list[DataFrame], key: str, text: str, target: int | None = None, position: str | None = None) -> DataFrame:
    """Union of sources in order; a key keeps its first row with a text; ``target`` is the collector's wanted count.

    Rows of one key inside a source go by ``position``, then by the hash of the whole row, so the choice never depends on
    the order in which files are read.
    """
    every = frames[0].withColumn("arrival", F.lit(0))
    for i, frame in enumerate(frames[1:], 1):
        every = every.unionByName(frame.withColumn("arrival", F.lit(i)), allowMissingColumns=True)
    whole = F.xxhash64(*[c for c in every.columns if c != "arrival"])
    order = [F.asc("arrival"), *([F.asc_nulls_last(position)] if position else []), F.asc(whole)]
    kept = every.where(F.coalesce(F.trim(F.col(text)), F.lit("")) != "").withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("turn = 1").drop("turn")
    return kept.orderBy("arrival", key).limit(target) if target is not None else kept


def longest_wins(frames: list[DataFrame], key: str, text: str) -> DataFrame:
    """Union of corpora; a key keeps its longest text, the earlier corpus on ties, then the smaller hash of the row."""
    every = frames[0].withColumn("arrival", F.lit(0))
    for i, frame in enumerate(frames[1:], 1):
        every = every.unionByName(frame.withColumn("arrival", F.lit(i)), allowMissingColumns=True)
    order = [F.desc(F.length(F.coalesce(F.col(text), F.lit("")))), F.asc("arrival"), F.asc(F.xxhash64(*[c for c in every.columns if c != "arrival"]))]
    return every.where(F.col(key).isNotNull()).withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("turn = 1").drop("turn", "arrival")


def cached_documents(spark: SparkSession, path: str, ttl_seconds: int, now: str | None = None) -> DataFrame:
    """Documents of the cached JSON files under a path that are not older than the time to live; stale files give no rows."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select("*", "_metadata.file_modification_time")
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return rows.where(F.unix_timestamp(clock) - F.unix_timestamp("file_modification_time") <= ttl_seconds).drop("file_modification_time")


def cloud_documents(rows: DataFrame) -> DataFrame:
    """Documents of stored rows (id, source_id, title, abstract, journal, published_year, authors, study_type, status,
    evidence_level, url, topic, retrieved_at): renamed, with the defaults of missing values; authors may be JSON text."""
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    authors = F.from_json("authors", "array<string>") if dict(rows.dtypes)["authors"] == "string" else F.col("authors")
    return rows.select(
        "id", text("source_id").alias("source"), text("title").alias("title"), text("abstract").alias("abstract"), "journal", F.col("published_year").cast("int").alias("year"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        "study_type", "status", text("evidence_level", "Other").alias("evidence_level"), text("url").alias("url"), F.coalesce(F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("offline-snapshot")).alias("retrieved_at"), text("topic").alias("topic"),
    )


TABLES = {
    "questions": "id string, question_group_id string, split string, question string, topic string, language string, scenario string, risk string, as_of_date string, corpus_profile string, corpus_manifest_hash string, expected_behavior string, allowed_refusal_codes array<string>, annotation_status string",
    "sources": "id string, text string, locator map<string,string>",
    "qrels": "question_id string, source_id string, grade int, study_family_id string, evidence_role string, rationale string",
    "key_points": "id string, question_id string, text string, necessity string, weight double, support_source_ids array<string>",
}


def evaluation_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an evaluation bundle: <table>.jsonl or <table>.json of a folder, one frame per table that is there.

    A table that stands in both forms raises an error, as do lines that are no JSON object of the table's columns.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {f.getPath().getName() for f in fs.listStatus(place)}
    out = {}
    for table, schema in TABLES.items():
        forms = [x for x in (f"{table}.jsonl", f"{table}.json") if x in names]
        if len(forms) > 1:
            raise ValueError(f"{table} stands in two forms")
        if forms:
            reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", forms[0].endswith(".json"))
            out[table] = reader.json(f"{folder}/{forms[0]}")
    return out


def question_set(spark: SparkSession, path: str, schema: str = "id string, question string, type string, should_answer boolean, relevant_topics array<string>") -> DataFrame:
    """Questions of a JSON list, or of an object whose field ``questions`` is one; raises unless ids are there and unique."""
    listed = spark.read.schema(f"{schema}, questions array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(', '))}>>").option("multiLine", True).json(path)
    inner = listed.where("questions is not null").select(F.explode("questions").alias("x")).select("x.*")
    rows = listed.where("questions is null").drop("questions").unionByName(inner)
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.count(F.when(F.coalesce("id", F.lit("")) == "", 1)).alias("b")).first()
    if n["b"] or n["n"] != n["d"]:
        raise ValueError("every question needs an id of its own")
    return rows


def cited_pmids(cited: DataFrame, records: DataFrame) -> DataFrame:
    """(pmid, source, missing) of cited ids (pmid, source, position): each once with its last source, and whether no record
    (pmid) is there."""
    last = cited.where("pmid is not null and pmid <> ''").groupBy("pmid").agg(F.max_by("source", "position").alias("source"))
    known = records.select("pmid").distinct().withColumn("found", F.lit(True))
    return last.join(known, "pmid", "left").select("pmid", "source", F.col("found").isNull().alias("missing"))
