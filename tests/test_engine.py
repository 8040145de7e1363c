"""The whole chain on a small corpus."""

import pytest
from pyspark.sql import functions as F

from veridex import engine

DOCS = "doc_id long, record_id string, source string, title string, text string, topic string, evidence_level string, published_year int"


def corpus(spark):
    rows = []
    for i, level in enumerate(["Guideline", "RCT", "Meta-analysis", "Review", "Other", "RCT"]):
        rows.append((i, f"pmid:1000{i}0", "pubmed", f"他汀 study {i}", f"他汀 statin lowers cholesterol by {i + 10}% in 血脂 patients, report number {i}.", "血脂", level, 2000 + i))
    rows.append((99, "pmid:999999", "pubmed", "Walking", "Walking is healthy.", "生活方式", "Other", 2001))
    return spark.createDataFrame(rows, DOCS)


def test_answers_and_refusals(spark):
    asked = spark.createDataFrame([("a", "他汀 statin 对血脂 cholesterol 的作用"), ("b", "姓名：张三 他汀"), ("c", "weather tomorrow"), ("d", None), ("e", "高血压 antihypertensive xqzw")], "id string, question string")
    got = {r.q: r for r in engine.ask(asked, corpus(spark)).collect()}
    assert got["a"].code is None and 1 <= len(got["a"].claims) <= 4
    assert all(len(c.documents) == 1 and f"report number {c.documents[0]}" in c.text for c in got["a"].claims)
    assert {q: got[q].code for q in "bcde"} == {"b": "PHI_BLOCKED", "c": "OUT_OF_SCOPE", "d": "OUT_OF_SCOPE", "e": "QUESTION_NOT_COVERED"}
    assert all(got[q].claims is None for q in "bcde")
    diverse = {r.q: r.code for r in engine.ask(asked, corpus(spark), engine.Settings(selection="document_diverse")).collect()}
    assert diverse["a"] is None
    for bad in (engine.Settings(selection="other"), engine.Settings(pool_policy="other")):
        with pytest.raises(ValueError):
            engine.ask(asked, corpus(spark), bad)
    legacy = {r.q: r.code for r in engine.ask(asked, corpus(spark), engine.Settings(pool_policy="legacy")).collect()}
    assert legacy["a"] is None


def test_sources_that_are_one_study_or_have_no_address(spark):
    """Copies of one publication, or records without a reliable identity, are too few sources."""
    asked = spark.createDataFrame([("a", "他汀 statin 对血脂 cholesterol 的作用")], "id string, question string")
    same = corpus(spark).where("doc_id < 6").withColumn("record_id", F.concat(F.lit("pmid:10000"), (F.col("doc_id") % 2).cast("string")))
    assert [r.code for r in engine.ask(asked, same).collect()] == ["INSUFFICIENT_SOURCES"]
    local = corpus(spark).where("doc_id < 6").withColumn("record_id", F.concat(F.lit("kb_"), F.col("doc_id").cast("string")))
    assert [r.code for r in engine.ask(asked, local).collect()] == ["INSUFFICIENT_SOURCES"]


def test_conflicted_documents_leave_the_pool(spark):
    rows = engine.described(corpus(spark).where("doc_id < 2").withColumn("url", F.when(F.col("doc_id") == 0, "https://pubmed.ncbi.nlm.nih.gov/555555"))).withColumn("q", F.lit("a")).withColumn("retrieval", F.lit(0.5))
    assert [r.id for r in engine.candidates(rows).collect()] == [1]
    assert engine.candidates(rows, "legacy").count() == 2


def test_empty_corpus_and_questions(spark):
    asked = spark.createDataFrame([("a", "他汀 statin")], "id string, question string")
    docs = corpus(spark)
    assert [r.code for r in engine.ask(asked, docs.limit(0)).collect()] == ["QUESTION_NOT_COVERED"]
    assert engine.ask(asked.limit(0), docs).count() == 0


def test_questions_in_blocks_are_answered_alike(spark):
    """Conflicts are those of the whole batch, however few questions go through the chain at a time."""
    asked = spark.createDataFrame([(f"q{i}", f"他汀 statin 对血脂 cholesterol 的作用 {i}") for i in range(6)] + [("x", "weather tomorrow"), ("y", None)], "id string, question string")
    whole, cut = (sorted(map(str, engine.ask(asked, corpus(spark), bound=n).collect())) for n in (250_000, 160))
    assert whole == cut and len(whole) == 8
