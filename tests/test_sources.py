"""Readers, writers and streams on small files."""

import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from veridex.sources import readers, sinks
from veridex.streaming import telemetry


def test_knowledge_pages(spark, tmp_path):
    page = {"id": "p", "title": "T", "topic": "高血压", "keywords": ["a", "b"], "claims": [{"id": "", "text": "Claim.", "applicable": "成人", "exceptions": "", "citations": [{"type": "pmid", "pmid": "1", "url": "u"}]}, {"id": "x", "text": "Two"}]}
    (tmp_path / "p.json").write_text(json.dumps(page, ensure_ascii=False, indent=1))
    got = {r.id: (r.text, r.url, r.hint) for r in readers.knowledge_pages(spark, str(tmp_path)).collect()}
    assert got == {"p:1": ("Claim. 适用人群：成人", "u", "a b"), "x": ("Two", None, "a b")}


def test_snapshot_and_chunks(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "d1", "abstract": "One. Two.", "retrieved_at": ""}, {"id": "d2", "abstract": None}]))
    docs = readers.snapshot(spark, str(tmp_path / "s.json"))
    assert {r.id: r.retrieved_at for r in docs.collect()} == {"d1": "offline-snapshot", "d2": "offline-snapshot"}
    assert [(r.id, r.text) for r in readers.document_chunks(docs).collect()] == [("d1:chunk:1", "One. Two.")]


def test_manifest(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_bytes("﻿pmid,title,dest_pdf,nlm_unique_id,pub_year\n1,a,x.pdf,n,2000\n2,b,y.pdf,n,2001\n".encode())
    assert readers.manifest(spark, str(good)).count() == 2
    good.write_text("pmid,title,dest_pdf,nlm_unique_id,pub_year\n1,a,x,n,2000\n1,b,y,n,2001\n")
    with pytest.raises(ValueError):
        readers.manifest(spark, str(good))


def test_pubmed_xml(spark, tmp_path):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract>
    <Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2001 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList>
    <AuthorList><Author><ForeName>F</ForeName><LastName>L</LastName></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    (tmp_path / "a.xml").write_text(xml)
    r = readers.pubmed_xml(spark, str(tmp_path / "a.xml")).first()
    assert (r.id, r.abstract, r.year, r.authors, r.evidence_level) == ("pmid:7", "A B", 2001, ["F L", "G"], "Review")


def test_europe_pmc_and_trials(spark, tmp_path):
    result = [{"id": "1", "source": "MED", "pmid": "9", "title": "t", "pubYear": "2020", "pubTypeList": {"pubType": ["Review"]}}, {"id": "2", "source": "PPR", "title": "p", "pubYear": "x"}]
    (tmp_path / "e.json").write_text(json.dumps({"resultList": {"result": result}}))
    assert [r.id for r in readers.europe_pmc(spark, str(tmp_path / "e.json")).collect()] == ["pmid:9"]
    assert readers.europe_pmc(spark, str(tmp_path / "e.json"), False).where("evidence_level = 'preprint'").count() == 1
    study = {"studies": [{"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "b"}, "statusModule": {"overallStatus": "DONE", "startDateStruct": {"date": "2019-05"}}}}]}
    (tmp_path / "c.json").write_text(json.dumps(study))
    r = readers.clinical_trials(spark, str(tmp_path / "c.json")).first()
    assert (r.id, r.year, r.abstract) == ("nct:NCT00000001", 2019, "")


def test_pdf_mark_and_block_order(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"junk%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"x" * 2000 + b"%PDF-")
    assert sorted(r.is_pdf for r in readers.pdf_files(spark, str(tmp_path / "*.pdf")).collect()) == [False, True]
    long = "x" * 130
    blocks = [("d", 1, 100.0, 5.0, 0.0, 95.0, 5.0, "head"), ("d", 1, 100.0, 55.0, 10.0, 95.0, 20.0, "R" + long), ("d", 1, 100.0, 5.0, 12.0, 45.0, 30.0, "L" + long), ("d", 1, 100.0, 5.0, 40.0, 95.0, 50.0, "foot")]
    df = spark.createDataFrame(blocks, "doc_id string, page int, width double, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.text[:1] for r in readers.order_blocks(df).orderBy("position").collect()] == ["h", "L", "R", "f"]


def test_first_wins(spark):
    a = spark.createDataFrame([("1", "a"), ("2", "")], "id string, text string")
    b = spark.createDataFrame([("1", "late"), ("2", "b"), ("3", "c")], "id string, text string")
    assert sorted((r.id, r.text) for r in readers.first_wins([a, b], "id", "text").collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_choice_does_not_depend_on_row_order(spark):
    data = [("1", "late", 2), ("1", "early", 1), ("2", "x", None)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "id string, text string, at int")
        assert sorted((r.id, r.text) for r in readers.first_wins([df], "id", "text", position="at").collect()) == [("1", "early"), ("2", "x")]
    one = {r.text for order in (data, data[::-1]) for r in readers.first_wins([spark.createDataFrame(order, "id string, text string, at int")], "id", "text").where("id = '1'").collect()}
    assert len(one) == 1
    a, b = (spark.createDataFrame(x, "id string, text string") for x in ([("1", "ab"), ("2", "a"), (None, "z")], [("1", "cd"), ("2", "abc"), ("3", None)]))
    assert sorted((r.id, r.text) for r in readers.longest_wins([a, b], "id", "text").collect()) == [("1", "ab"), ("2", "abc"), ("3", None)]


def test_cache_lives_for_a_time(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "pubmed", "T")], "id string, source string, title string")
    path = sinks.write_cache(docs, str(tmp_path / "cache"), "k1")
    assert sinks.write_cache(docs, str(tmp_path / "cache"), "k1") == path  # an entry is replaced as a whole
    assert readers.cached_documents(spark, path, 3600).first().title == "T"
    assert readers.cached_documents(spark, path, 3600, "2999-01-01 00:00:00").count() == 0


def test_stored_rows_have_defaults(spark):
    row = [("r", "s", None, None, None, 2001, '["A", "B"]', None, None, None, None, None, None), ("t", None, "x", "y", "j", None, None, "z", "w", "RCT", "u", "top", None)]
    schema = "id string, source_id string, title string, abstract string, journal string, published_year int, authors string, study_type string, status string, evidence_level string, url string, topic string, retrieved_at timestamp"
    got = {r.id: r for r in readers.cloud_documents(spark.createDataFrame(row, schema)).collect()}
    assert (got["r"].title, got["r"].authors, got["r"].evidence_level, got["r"].retrieved_at, got["t"].source, got["t"].authors) == ("", ["A", "B"], "Other", "offline-snapshot", "", [])


def test_bundles_and_question_sets(spark, tmp_path):
    (tmp_path / "questions.jsonl").write_text('{"id": "a", "split": "dev"}\n{"id": "b"}\n')
    (tmp_path / "qrels.json").write_text('[{"question_id": "a", "source_id": "s", "grade": 2}]')
    bundle = readers.evaluation_bundle(spark, str(tmp_path))
    assert set(bundle) == {"questions", "qrels"} and bundle["questions"].count() == 2 and bundle["qrels"].first().grade == 2
    (tmp_path / "qrels.jsonl").write_text("")
    with pytest.raises(ValueError):
        readers.evaluation_bundle(spark, str(tmp_path))
    for text in ('[{"id": "a", "question": "x"}, {"id": "b"}]', '{"questions": [{"id": "a", "question": "x"}, {"id": "b"}]}'):
        (tmp_path / "set.json").write_text(text)
        assert sorted(r.id for r in readers.question_set(spark, str(tmp_path / "set.json")).collect()) == ["a", "b"]
    (tmp_path / "set.json").write_text('[{"id": "a"}, {"id": "a"}]')
    with pytest.raises(ValueError):
        readers.question_set(spark, str(tmp_path / "set.json"))


def test_reports_packages_and_staging(spark, tmp_path):
    df = spark.createDataFrame([("i1", 1, "x", ["a"]), ("i2", 2, "y", None)], "item string, alias int, rubric string, parts array<string>")
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/csv")).count() == 2 == spark.read.json(str(tmp_path / "report/json")).count()
    with pytest.raises(Exception):
        sinks.write_report(df, str(tmp_path / "report"))
    sinks.write_blind(df, ["rubric"], "item", "alias", str(tmp_path / "open"), str(tmp_path / "private"))
    assert spark.read.json(str(tmp_path / "open")).columns == ["alias", "rubric"]
    for public, key, roots in ((["item"], "item", ("o2", "p2")), (["rubric"], "item", ("o3", "o3/inside"))):
        with pytest.raises(ValueError):
            sinks.write_blind(df, public, key, "alias", *[str(tmp_path / x) for x in roots])
    path = sinks.stage_rows(df, str(tmp_path), "r1", "items", "item")
    assert sorted(tuple(r) for r in sinks.staged(spark, path, "item string, alias long").collect()) == [("i1", 1), ("i2", 2)]
    docs, chunks = spark.createDataFrame([(1, "t")], "doc_id int, text string"), spark.createDataFrame([("c", 1), ("lost", 9)], "id string, doc_id int")
    out = sinks.write_candidate(docs, chunks, str(tmp_path / "corpus"), "v1", "p1")
    assert {r.table: r.n for r in spark.read.json(f"{out}/manifest").collect()} == {"documents": 1, "chunks": 1}
    with pytest.raises(Exception):
        sinks.write_candidate(docs, chunks, str(tmp_path / "corpus"), "v1", "p1")


def test_vector_index(spark, tmp_path):
    items = spark.createDataFrame([("a", "s", [3.0, 4.0])], "id string, source string, vec array<double>")
    path = sinks.write_vector_index(items, str(tmp_path), "v1", "m")
    assert sinks.read_vector_index(spark, path).first().vec == [0.6, 0.8]
    with pytest.raises(Exception):
        sinks.write_vector_index(items, str(tmp_path), "v1", "m")
    with pytest.raises(ValueError):
        sinks.write_vector_index(spark.createDataFrame([("a", "s", [0.0])], items.schema), str(tmp_path), "v2", "m")


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 02:00:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    out = telemetry.run_available(spark, telemetry.stage_windows(telemetry.event_stream(spark, str(tmp_path / "events.parquet"))))
    assert sorted((r.event_type, r.n, r.total) for r in out.collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    stage = tmp_path / "stage"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(str(stage))
    stream = lambda: spark.readStream.schema("id int, v string").parquet(str(stage))
    root, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    telemetry.publish_stream(spark, stream(), root, "id", progress)
    spark.createDataFrame([(2, "B")], "id int, v string").coalesce(1).write.mode("append").parquet(str(stage))
    telemetry.publish_stream(spark, stream(), root, "id", progress)
    from veridex.operators.publish import read_current

    assert sorted((r.id, r.v, r.is_active) for r in read_current(spark, root).collect()) == [(1, "a", False), (2, "B", True)]


def test_late_events_are_dropped(spark, tmp_path):
    """The last file's old event is behind the watermark of the first; its new one, and one late within bounds, count."""
    path = str(tmp_path / "events.parquet")

    def add(*events):
        rows = spark.createDataFrame(list(events), "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        rows.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their times

    add((1, "2024-05-01 00:10:00", "a", 1.0), (2, "2024-05-01 00:50:00", "a", 2.0))
    add((6, "2024-05-01 00:30:00", "b", 1.0))  # a watermark holds from the second batch after its event on
    add((3, "2024-01-01 00:10:00", "a", 9.0), (4, "2024-04-20 00:10:00", "a", 4.0), (5, "2024-05-01 00:20:00", "a", 8.0))
    out = telemetry.run_available(spark, telemetry.stage_windows(telemetry.event_stream(spark, path, 1)))
    assert sorted((r.n, r.total) for r in out.collect()) == [(1, 1.0), (1, 4.0), (3, 11.0)]


def publish_all(spark, tmp_path):
    stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "stage"))
    telemetry.publish_stream(spark, stream, str(tmp_path / "store"), "id", str(tmp_path / "progress"))


def stage_file(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "stage"))


def test_a_snapshot_that_cannot_be_read_is_not_replaced(spark, tmp_path):
    from veridex.operators import publish

    root = str(tmp_path / "store")
    stage_file(spark, tmp_path, (1, "a"), (2, "b"))
    publish_all(spark, tmp_path)
    shutil.move(f"{root}/versions/batch-00000000", str(tmp_path / "away"))
    stage_file(spark, tmp_path, (2, "B"))
    with pytest.raises(Exception):
        publish_all(spark, tmp_path)
    assert publish.current_version(spark, root) == "batch-00000000"
    shutil.move(str(tmp_path / "away"), f"{root}/versions/batch-00000000")
    publish_all(spark, tmp_path)
    assert sorted((r.id, r.v, r.is_active) for r in publish.read_current(spark, root).collect()) == [(1, "a", False), (2, "B", True)]


def test_a_crash_between_version_and_pointer_loses_nothing(spark, tmp_path):
    from veridex.operators import publish

    root = str(tmp_path / "store")
    stage_file(spark, tmp_path, (1, "a"), (2, "b"))
    publish_all(spark, tmp_path)
    # the second version is complete, its pointer is not written; the stream sees the batch again
    publish.next_snapshot(publish.read_current(spark, root), spark.createDataFrame([(2, "B")], "id int, v string"), "id").write.parquet(f"{root}/versions/batch-00000001")
    assert publish.current_version(spark, root) == "batch-00000000"
    stage_file(spark, tmp_path, (2, "B"))
    publish_all(spark, tmp_path)
    assert publish.current_version(spark, root) == "batch-00000001"
    assert sorted((r.id, r.v, r.is_active) for r in publish.read_current(spark, root).collect()) == [(1, "a", False), (2, "B", True)]
    # parts of a version that a crash left behind are written anew
    (tmp_path / "store/versions/batch-00000002").mkdir()
    (tmp_path / "store/versions/batch-00000002/part-x.parquet").write_bytes(b"half")
    stage_file(spark, tmp_path, (3, "c"))
    publish_all(spark, tmp_path)
    assert sorted((r.id, r.is_active) for r in publish.read_current(spark, root).collect()) == [(1, False), (2, False), (3, True)]
