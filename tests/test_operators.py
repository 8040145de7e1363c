"""Operators on hand-made rows: ranking rules, pools, selection, gates, metrics, components, publishing."""

import math

import pytest
from pyspark.sql import functions as F

from veridex.operators import audit, components, evaluation, gates, pool, publish, retrieval, verification


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def bm25_plain(query, docs):
    n, avg = len(docs), max(sum(map(len, docs.values())) / len(docs), 1)
    out = {}
    for key, tokens in docs.items():
        s = 0.0
        for term in query:
            tf, df = tokens.count(term), sum(term in t for t in docs.values())
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avg))
        out[key] = s
    top = max(out.values())
    return {k: round(v / top, 6) for k, v in out.items() if v}


def test_bm25_and_cosine_against_plain_code(spark):
    docs = {1: "statin lowers cholesterol statin", 2: "stroke care stroke unit care", 3: "cholesterol stroke", 4: "nothing here"}
    items = spark.createDataFrame(list(docs.items()), "id int, text string")
    asked = spark.createDataFrame([("a", "statin cholesterol cholesterol")], "q string, text string")
    found = retrieval.scores(retrieval.query_terms(asked, "q", F.col("text")), retrieval.build_index(items, "id", F.col("text")))
    plain = bm25_plain("statin cholesterol cholesterol".split(), {k: v.split() for k, v in docs.items()})
    assert {r.id: round(r.bm25, 6) for r in retrieval.top_bm25(found).collect()} == plain
    words = {k: v.split() for k, v in docs.items()} | {0: "statin cholesterol cholesterol".split()}
    idf = lambda t: math.log((len(words) + 1) / (sum(t in w for w in words.values()) + 1)) + 1
    vec = {k: {t: w.count(t) * idf(t) for t in set(w)} for k, w in words.items()}
    cos = lambda a, b: sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = {r.id: r.cosine for r in found.collect()}
    assert got == pytest.approx({k: cos(vec[0], vec[k]) for k in (1, 3)}, abs=1e-8)


def test_empty_and_null_items(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "id int, text string")
    asked = spark.createDataFrame([("a", "x y"), ("b", None)], "q string, text string")
    assert retrieval.lexical_search(asked, "q", F.col("text"), retrieval.build_index(items, "id", F.col("text"))).count() == 0
    assert retrieval.lexical_search(asked, "q", F.col("text"), retrieval.build_index(items.limit(0), "id", F.col("text"))).count() == 0


def test_index_is_kept_until_a_table_changes(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []

    def kept():
        return retrieval.kept_index(spark, "t", [path], lambda: built.append(1) or retrieval.build_index(spark.read.parquet(path), "id", F.col("text"), str(tmp_path / f"index{len(built)}")))

    spark.createDataFrame([(1, "statin")], "id int, text string").write.parquet(path)
    first = kept()
    assert kept() is first and len(built) == 1 and first.folders >= 8
    spark.createDataFrame([(2, "statin")], "id int, text string").write.mode("append").parquet(path)
    assert kept() is not first and kept().terms.first().df == 2 and len(built) == 2
    __import__("shutil").rmtree(tmp_path / "index2" / "postings")
    assert kept().of(spark.createDataFrame([("statin",)], "term string")).count() == 2 and len(built) == 3


def test_first_rows_are_those_of_all_scores(spark):
    words = "statin cholesterol stroke care unit aspirin diet walking".split()
    items = spark.createDataFrame([((i * 7919) % 3001, " ".join(words[j] for j in range(8) if (i * (j + 3)) % (j + 2) == 0) + f" w{i % 40}", 2000 + i % 3 if i % 5 else None) for i in range(3000)], "id int, text string, year int")
    asked = spark.createDataFrame([("a", "statin stroke w3"), ("b", "diet diet walking unheard"), ("c", "statin stroke w3"), ("d", "aspirin"), ("e", "unheard"), (None, "statin")], "q string, text string")
    terms, index = retrieval.query_terms(asked, "q", F.col("text")), retrieval.build_index(items, "id", F.col("text"), prefer=F.col("year"))
    every = retrieval.scores(terms, index)
    for kinds, block in ((("bm25", "cosine"), 16), (("bm25",), 1), (("cosine",), 16)):
        found = retrieval.best(terms, index, 5, kinds, block=block)
        assert found.count() <= 4 * 5 * len(kinds) * spark.sparkContext.defaultParallelism < 3000
        for k in kinds:
            first = lambda df, k=k: rows(retrieval.ranked(df, 5, F.desc(k), F.asc("id")), "q", "rank", "id", "bm25", "cosine")
            assert first(found) == first(every) and len(first(found)) == 20
    later = [F.desc("bm25"), F.desc_nulls_last("year"), F.asc("id")]
    year = items.select("id", "year")
    assert rows(retrieval.ranked(retrieval.best(terms, index, 5, ("bm25",), True).join(year, "id"), 5, *later), "q", "rank", "id") == rows(retrieval.ranked(every.join(year, "id"), 5, *later), "q", "rank", "id")


def test_repeated_ids_are_one_item(spark):
    items = spark.createDataFrame([("x", "statin"), ("x", "statin care"), ("y", "care"), ("z", None), (None, "statin")], "id string, text string")
    index = retrieval.build_index(items, "id", [(F.col("text"), 1.4), (F.col("text"), 1.0)])
    assert rows(index.postings, "id", "term", "tf", "len") == [("x", "care", 2.4, pytest.approx(7.2)), ("x", "statin", 4.8, pytest.approx(7.2)), ("y", "care", 2.4, pytest.approx(2.4))]
    assert index.shape.first()["n"] == 3 and rows(index.terms, "term", "df") == [("care", 2), ("statin", 1)]
    asked = spark.createDataFrame([(7, "statin care")], "q int, text string")
    assert [r.id for r in retrieval.lexical_search(asked, "q", F.col("text"), index).orderBy("rank").collect()] == ["x", "y"]


def test_no_text_is_shuffled_to_search_or_rerank(spark):
    """Neither postings nor a corpus cross the network: only counts, ids and first rows are exchanged."""
    items = spark.createDataFrame([(i, "statin care") for i in range(9)], "id int, text string")
    asked = spark.createDataFrame([("a", "statin")], "q string, text string")
    found = retrieval.best(retrieval.query_terms(asked, "q", F.col("text")), retrieval.build_index(items, "id", F.col("text")), 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    pool = retrieval.near(retrieval.top_bm25(found, 5).select("q", "id")).join(items, "id")
    assert "SortMergeJoin" not in pool._jdf.queryExecution().executedPlan().toString()
    local = retrieval.local_scores(asked, "q", F.col("text"), pool, F.col("text"))
    assert rows(local, "id", "bm25") == [(i, 1.0) for i in range(5)]


def test_texts_of_pools_stay_with_their_documents(spark, small):
    """Rankings are written without texts, and their blocks give the rows of one whole."""
    from veridex.plans import catalogue

    ranking = catalogue._reranked(spark, small)
    assert ranking.columns == ["q", "id", "rank", "score", "role"]
    texts = catalogue._described(spark, small, ranking, "text", then=lambda x: x.where("text is not null").select("q", "id"))
    assert not hasattr(texts, "text") and texts.count() > 0
    short = spark.createDataFrame([(f"q{i}", i % 7) for i in range(50)], "q string, id int")
    seen = []
    got = retrieval.in_blocks(short, "q", lambda own: (seen.append(own.count()), own)[1], 10)
    assert len(seen) == 5 and sum(seen) == 50 and rows(got, "q", "id") == rows(short, "q", "id")
    assert retrieval.in_blocks(short.limit(0), "q", lambda own: own, 10).count() == 0


def test_full_text_search_in_blocks(spark):
    chunks = spark.createDataFrame([(f"c{i}", i // 3, f"statin care {'trial ' * (i % 4)}number {i}") for i in range(30)], "id string, doc_id int, text string")
    titles = spark.createDataFrame([(i, f"title {i} statin", None) for i in range(0, 10, 2)], "doc_id int, title string, topic string")
    named = chunks.join(titles, "doc_id", "left")
    index = retrieval.build_index(named, "id", [(F.col("title"), 1.4), (F.col("text"), 1.0)])
    asked = spark.createDataFrame([(f"q{i}", ["statin", word]) for i, word in enumerate(["trial", "care", "number", "title"])], "q string, local_terms array<string>")
    searchable = F.concat_ws(" ", "title", "topic", "text")
    whole = retrieval.full_text_search(asked, index, chunks, titles, searchable)
    cut = retrieval.full_text_search(asked, index, chunks, titles, searchable, bound=60)
    columns = ("q", "id", "doc_id", "rank", "score")
    assert rows(cut, *columns) == rows(whole, *columns) and whole.count() == 4 * 14


def test_cap_keeps_rank_order(spark):
    df = spark.createDataFrame([("q", i, d, i) for i, d in enumerate("AAABBC", 1)], "q string, id int, doc string, rank int")
    assert rows(retrieval.cap_per_document(df, "doc", 2, 4), "rank", "id") == [(1, 1), (2, 2), (3, 4), (4, 5)]


def test_knn_ignores_bad_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0])], "id int, vec array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0])], "q string, vec array<double>")
    assert rows(retrieval.dense_knn(asked, items, 5), "q", "id", "rank") == [("a", 1, 1), ("a", 4, 2)]
    assert retrieval.dense_knn(asked.limit(0), items, 5).count() == 0 == retrieval.dense_knn(asked, items.limit(0), 5).count()


def test_knn_in_blocks_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(90, 4)), 1)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vec array<double>").repartition(5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    want = [(q, int(i), r) for q in range(90) for r, i in enumerate(sorted(range(90), key=lambda i, q=q: (-s[q, i], i))[:6], 1)]
    got = retrieval.dense_knn(items.withColumnRenamed("id", "q"), items, 6, block=32)
    assert rows(got, "q", "id", "rank") == sorted(want)


def test_pool_decisions(spark):
    data = [("q", "c1", "A", "same text", "s", 0.9), ("q", "c1", "A", "other", "s", 0.5), ("q", "c2", "A", "Same  text", "s", 0.4), ("q", "c3", "B", "x", "s", 0.3), ("q", "c3", "C", "y", "s", 0.2), ("q", "c4", "D", "z", "s", 0.1)]
    df = spark.createDataFrame(data, "q string, id string, identity string, text string, source string, score double")
    want = [("c1", 0.5, "duplicate_id"), ("c1", 0.9, "retained"), ("c2", 0.4, "duplicate_text"), ("c3", 0.2, "identity_conflict"), ("c3", 0.3, "identity_conflict"), ("c4", 0.1, "retained")]
    assert rows(pool.preserve_sources(df), "id", "score", "reason") == want
    bad = spark.createDataFrame([("D",)], "identity string")
    assert ("c4", "identity_conflict") in rows(pool.preserve_sources(df, bad), "id", "reason")


def test_document_diverse_folds(spark):
    # an entry refused by the family cap leaves its document free
    data = [("q", 9.0, "d1", "a", "f"), ("q", 8.0, "d2", "b", "f"), ("q", 7.0, "d3", "c", "f"), ("q", 6.0, "d3", "d", ""), ("q", 5.0, "d1", "e", "")]
    df = spark.createDataFrame(data, "q string, score double, identity string, id string, family string")
    assert rows(pool.document_diverse(df), "citation_number", "id") == [(1, "a"), (2, "b"), (3, "d")]


def test_packet_covers_roles(spark):
    data = [("q", f"e{i}", i, role, fam, 1 - i / 10, f"word{i} shared") for i, (role, fam) in enumerate([("overview", "f1"), ("overview", "f2"), ("overview", "f3"), ("causal", "f1"), ("boundary", "f4"), ("causal", "f5"), ("boundary", "f6")], 1)]
    df = spark.createDataFrame(data, "q string, id string, citation_number int, role string, family string, score double, text string")
    got = [r[0] for r in rows(pool.packet(df), "id")]
    assert len(got) == 5 and {"e1", "e6", "e5"} <= set(got)


def test_gates(spark):
    asked = spark.createDataFrame([("a", "姓名：张三 高血压"), ("b", "我该吃什么药 高血压"), ("c", "weather"), ("d", "高血压 xyz"), ("e", "最新高血压指南"), ("f", None)], "id string, question string")
    specs = gates.specify(asked, "id", "question", 2025)
    assert rows(gates.safety(specs), "q", "code")[:4] == [("a", "PHI_BLOCKED"), ("b", "PERSONALIZED_TREATMENT"), ("c", "OUT_OF_SCOPE"), ("d", "UNVERIFIABLE_INTERVENTION")]
    spec = {r.q: r for r in specs.collect()}["e"]
    assert (spec.time_from, spec.time_to, spec.expected_types) == (2015, 2025, ["Guideline"])
    schema = "q string, rank int, score double, topic string, level string, source string, identity string, family string, aliases array<string>, text string"
    entry = lambda r, family, aliases=(): ("e", r, 0.5, "高血压", "Guideline" if r == 1 else "RCT", "s", f"d{r}", family, list(aliases), "t")
    code = lambda entries: {r.q: r.code for r in gates.evidence_gate(specs, spark.createDataFrame(entries, schema)).collect()}
    three = [entry(r, f"pmid:1000{r}") for r in (1, 2, 3)]
    assert code(three)["e"] is None and code(three)["a"] == "NO_EVIDENCE"
    # two publications of one trial, or entries without a reliable family, are no independent sources
    assert code([*three[:2], entry(3, "pmid:99999", ["pmid:10001"])])["e"] == "INSUFFICIENT_SOURCES"
    assert code([*three[:2], entry(3, "")])["e"] == "INSUFFICIENT_SOURCES"
    checks = spark.createDataFrame([("x", True, 1, 0.0), ("y", False, 0, 1.0), ("z", False, 2, 0.5), ("w", False, 2, 0.6)], "q string, refused boolean, n_claims int, failure_ratio double")
    assert rows(gates.post_gate(checks).fillna("ok"), "q", "code") == [("w", "CITATION_FAILURE"), ("x", "GENERATOR_REFUSAL"), ("y", "NO_SUPPORTED_CLAIMS"), ("z", "ok")]


def coverage(spark, question, *entries):
    specs = gates.specify(spark.createDataFrame([("q", question)], "id string, question string"), "id", "question", 2025)
    df = spark.createDataFrame([("q", i, text, topic) for i, (text, topic) in enumerate(entries)], "q string, id int, text string, topic string")
    return [c for _, c in rows(gates.partition_coverage(specs, df), "id", "coverage")]


def test_question_focus(spark):
    """Interventions, unknown codes, named mechanisms, populations and broad diet questions."""
    bp = "高血压"
    assert coverage(spark, "阿司匹林与氯吡格雷用于卒中", ("阿司匹林和氯吡格雷合用", "脑卒中"), ("只有阿司匹林", "脑卒中"), ("阿司匹林 例外：氯吡格雷", "x")) == ["direct", "background", "none"]
    assert coverage(spark, "高血压 ABC123 有效吗", ("高血压与abc123试验", bp), ("高血压治疗", bp), (None, bp)) == ["direct", "background", "background"]
    assert coverage(spark, "关于 瞬时受体 通路的高血压研究", ("瞬时受体与血压", bp), ("血压", bp)) == ["direct", "background"]
    assert coverage(spark, "高血压用药\n人群：孕妇", ("妊娠期血压", bp), ("非妊娠患者；孕妇除外", bp), ("成人血压", bp)) == ["direct", "background", "background"]
    assert coverage(spark, "高血压 饮食模式：地中海饮食还是限钠", ("限钠摄入", bp), ("限钠摄入", "其他"), ("散步", bp)) == ["direct", "none", "background"]
    assert coverage(spark, "高血压怎么办", ("文中提到高血压", "其他"), ("无关", bp), ("无关", "其他")) == ["direct", "direct", "none"]


def test_not_covered_questions(spark):
    specs = gates.specify(spark.createDataFrame([("a", "高血压"), ("b", "血脂")], "id string, question string"), "id", "question", 2025)
    cover = spark.createDataFrame([("a", 1, "direct"), ("b", 2, "background")], "q string, id int, coverage string")
    assert rows(gates.coverage_gate(specs, cover), "q", "code") == [("a", None), ("b", "QUESTION_NOT_COVERED")]
    coded = gates.coverage_gate(specs, cover).withColumn("n_entries", F.lit(2).cast("long")).withColumn("n_sources", F.lit(1).cast("long"))
    told = {r.q: r for r in gates.refusals(coded).collect()}
    assert not told["a"].refused and told["a"].found == told["a"].missing == [] and told["b"].refused and len(told["b"].found) == len(told["b"].next_steps) == 1


def test_words_of_a_question(spark):
    df = spark.createDataFrame([(["q", " Statin ", "statin", "", "B"],)], "x array<string>")
    assert df.select(gates.unique(F.col("x"))).first()[0] == ["q", "Statin", "B"]
    asked = spark.createDataFrame([("a", "老年人 高血压 阿司匹林 对比 他汀"), ("b", "weather")], "id string, question string")
    got = {r.q: r for r in gates.specify(asked, "id", "question", 2025).collect()}
    assert got["a"].pico == {"P": "老年成人", "I": "高血压、血压、他汀、阿司匹林", "C": "问题中指定的对照方案", "O": "临床获益、风险与适用条件"}
    assert got["b"].api_queries == ["(weather) AND (guideline OR trial OR meta-analysis)", "(weather) AND Guideline[pt]"]
    df = spark.createDataFrame([(["q", 'a "b"', "A b", "中文", "c"], "o"), (["q"], 'x "y"'), (["q", "z"], "o")], "t array<string>, o string")
    assert [r[0] for r in df.select(gates.trial_query(F.col("t"), F.col("o"))).collect()] == ['"a b" AND ("c")', '"x y"', '"z"']


ENTRY = "citation int, title string, year int, status string, text string, source string, identity string, url string"


def test_verification(spark):
    claims = spark.createDataFrame([("c1", "statin lowers cholesterol by 5%", [1, 1, 9]), ("c2", "statin lowers cholesterol by 6%", [1]), ("c3", "uncited", []), ("c4", "statin lowers cholesterol by 5%", [2])], "claim_id string, text string, citations array<int>")
    body = "statin lowers cholesterol by 5%"
    entries = spark.createDataFrame([(1, "Statin study", 2020, None, body, "pubmed", "pmid:12345", "https://x.org"), (2, "Statin study", 2020, None, body, "pubmed", "pmid:12345", "")], ENTRY)
    seen = verification.verify(claims, entries)
    want = {("c1", 1, "source_record", "support", True), ("c1", 9, "not_checked", "unsupported", False), ("c2", 1, "source_record", "unsupported", False), ("c3", None, "not_checked", "unsupported", False), ("c4", 2, "unverified", "support", False)}
    assert {(r.claim_id, r.citation, r.existence, r.support, r.usable) for r in seen.collect()} == want
    assert rows(verification.claim_checks(seen), "claim_id", "kept") == [("c1", True), ("c2", False), ("c3", False), ("c4", False)]
    assert rows(verification.sanitise(claims, seen), "claim_id", "citations") == [("c1", [1])]
    one = verification.answer_checks(claims.withColumn("a", F.lit("x")), verification.claim_checks(seen), "a").first()
    assert (one.n_claims, one.n_kept, one.failure_ratio, one.n_removed, one.valid) == (4, 1, 0.75, 3, False)


def test_partial_support_is_not_usable(spark):
    """A claim that shares few words with its source is partial; identical text counts only for extracts."""
    entries = spark.createDataFrame([(1, "", None, None, "statin therapy", "pubmed", "pmid:12345", "https://x.org")], ENTRY)
    words = "statin alpha beta gamma delta epsilon zeta eta theta iota"
    claims = spark.createDataFrame([("p", words, [1]), ("same", "statin therapy", [1])], "claim_id string, text string, citations array<int>")
    assert rows(verification.verify(claims, entries), "claim_id", "support", "usable") == [("p", "partial", False), ("same", "support", True)]
    denied = spark.createDataFrame([(1, "", None, None, "no statin therapy. statin therapy", "pubmed", "pmid:12345", "https://x.org")], ENTRY)
    same = spark.createDataFrame([("same", "no statin therapy. statin therapy", [1])], claims.schema)
    assert rows(verification.verify(same, denied), "support") == [("support",)] and rows(verification.verify(same, denied, "llm:x"), "support") == [("unsupported",)]


def test_existence_of_sources(spark):
    cite = lambda *c: [(k, None, p, None, None, None, u, v) for k, p, u, v in c]
    data = [
        ("knowledge_page", "page", "u", cite(("pmid", "1", "u", "2024"))), ("knowledge_page", "page", "u", cite(("pmid", "1", "u", ""))), ("knowledge_page", "page", "u", cite(("book", None, "u", None))), ("knowledge_page", "page", "u", []),
        ("pubmed", "pmid:123456", "u", None), ("pubmed", "pmid:12", "u", None), ("ctgov", "nct:NCT00000001", "", None), ("x", "doi:10.1/a", "u", None), ("x", "kb", "u", None), ("x", "", "u", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i int, source string, identity string, url string, citations {verification.CITATIONS}")
    got = [r[1] for r in sorted(df.select("i", verification.existence(F.col("source"), F.col("identity"), F.col("url"), F.col("citations"))).collect())]
    assert got == ["verified_snapshot", "unverified", "manual_review", "unverified", "source_record", "unverified", "unverified", "source_record", "source_record", "unverified"]


def test_binary_and_graded_metrics(spark):
    ranking = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("a", 3, 4)], "q string, id int, rank int")
    relevant = spark.createDataFrame([("a", 2), ("a", 4), ("b", 1)], "q string, id int")
    got = {r.q: r for r in evaluation.binary_metrics(ranking, relevant).collect()}
    assert (got["a"].recall, got["a"].reciprocal_rank, got["b"].recall, got["b"].ndcg) == (0.5, 0.5, 0.0, 0.0)
    grades = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("a", 3, 1), ("c", 5, 2)], "q string, id int, grade int")
    got = {r.q: r for r in evaluation.graded_metrics(ranking, grades).collect()}
    assert (got["a"].status, got["a"].n_duplicates, got["a"].recall, got["a"].mrr) == ("scored", 1, 1.0, 0.5)
    assert got["a"].ndcg == pytest.approx((7 / math.log2(3) + 1 / math.log2(5)) / (7 + 1 / math.log2(3)), abs=1e-6)
    assert (got["c"].status, got["c"].recall) == ("scored", 0.0)
    got = {r.q: r for r in evaluation.graded_metrics(ranking, grades.where("id <> 3")).collect()}
    assert (got["a"].status, got["a"].recall, got["a"].n_unjudged) == ("unjudged_candidates", None, 1)


def test_quantiles_and_bootstrap(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(1, 16)] + [("s", None)], "stage string, ms double")
    r = evaluation.quantiles(df, "stage", "ms").first()
    assert (r.n, r.p50, r.p95, r.median) == (15, 8.0, 15.0, 8.0)
    pairs = spark.createDataFrame([(g, 0.5, 0.7) for g in range(40)] + [(1, None, 1.0)], "g int, baseline double, candidate double")
    r = evaluation.paired_bootstrap(pairs).first()
    assert (r.n_groups, r.n_questions) == (40, 40) and r.mean_difference == r.ci_low == r.ci_high == 0.2


def test_bootstrap_takes_2000_draws(spark):
    pairs = spark.createDataFrame([(g, 0.0, (g * 37 % 101) / 101) for g in range(60)], "g int, baseline double, candidate double")
    whole, few = evaluation.paired_bootstrap(pairs, draws=2000).first(), evaluation.paired_bootstrap(pairs, draws=200).first()
    assert evaluation.paired_bootstrap(pairs).first() == whole != few


def test_macro_needs_all_repeats(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 0.0), ("y", 2, 1.0), ("y", 2, None)], "arm string, question int, score double")
    assert rows(evaluation.macro_means(df, "question", 2, "score", "arm"), "arm", "macro_score") == [("x", 0.5), ("y", None)]


def test_quantiles_of_many_values_and_groups(spark):
    rng = __import__("random").Random(4)
    data = [(g, round(rng.choice([rng.random(), 5.0, 1e6 * rng.random()]), 3)) for g in "abc" for _ in range(rng.randint(1, 400))] + [("n", None), ("one", 7.0)]
    got = {r.g: r for r in evaluation.quantiles(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    for g in "abc":
        own = sorted(v for k, v in data if k == g)
        nearest = lambda p, own=own: own[math.ceil(p * len(own)) - 1]
        n = len(own)
        assert (got[g].n, got[g].p50, got[g].p95, got[g].p99) == (n, nearest(0.5), nearest(0.95), nearest(0.99))
        assert got[g].median == pytest.approx((own[(n - 1) // 2] + own[n // 2]) / 2, abs=1e-6)
    assert got["one"].median == 7.0 and got["n"].n == 0 and got["n"].p50 is None


def test_adjudication_counts_every_reviewer(spark):
    data = [("i", "r1", "a"), ("i", "r2", "b"), ("i", "r3", "b"), ("i", "r4", "b"), ("i", "r5", "a"), ("j", "r1", "a"), ("j", "r2", "b"), ("j", "r3", "a"), ("j", "r4", "b"), ("k", "r1", "a"), ("k", "r2", "a"), ("l", "r1", "a"), ("m", "r1", None)]
    got = rows(evaluation.adjudicate(spark.createDataFrame(data, "item string, reviewer string, label string")), "item", "final", "status", "n_reviewers")
    assert got == [("i", "b", "adjudicated", 5), ("j", None, "open", 4), ("k", "a", "agreed", 2), ("l", None, "single", 1)]


def test_quality_report(spark):
    questions = spark.createDataFrame([("a", "answer", True, True, False, "t"), ("b", "refuse", True, True, True, "t"), ("c", "answer", None, None, None, None)], "q string, behavior string, retrieval boolean, answer boolean, refusal boolean, topic string")
    values = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.0, None), ("b", 0.5, 1.0), ("zz", 0.0, 0.0)], "q string, support_rate double, behavior_accuracy double")
    got = {(r.metric, r.dimension, r.value): r for r in evaluation.quality_report(questions, values, ["support_rate", "behavior_accuracy"], ["topic"]).collect()}
    assert got["support_rate", "all", ""][3:] == (1, 1, "scored", 0.5, 0.5)  # refusals and questions that don't say are out
    assert got["behavior_accuracy", "all", ""][3:] == (3, 1, "evidence_insufficient", None, 1.0)
    assert ("support_rate", "topic", "") not in got and got["behavior_accuracy", "topic", ""].expected_questions == 1


def test_summary_and_rules(spark):
    from veridex.operators import governance

    runs = spark.createDataFrame([("success", 1.0, True), ("success", None, True), ("error", 1.0, True), ("skipped", 1.0, True), ("success", 0.0, False)], "run_status string, m double, should boolean")
    assert evaluation.result_summary(runs, {"m": F.col("m")}, F.col("should")).first()[:] == ("m", 1.0, 2, 0.5, 1.0, 3, 0.333333)
    with pytest.raises(Exception):
        evaluation.result_summary(spark.createDataFrame([("odd", 1.0, True)], runs.schema), {"m": F.col("m")}, F.col("should")).collect()
    spots = spark.createDataFrame([("abcdef", "cd", 2, 4), ("abcdef", "cd", 1, 3), ("abcdef", "xx", None, None), ("abcdef", None, 0, 9), ("abcdef", None, None, None), ("abcdef", "cd", None, None), ("abcdef", None, 0, 6)], "t string, q string, a int, b int")
    assert [r[0] for r in spots.select(governance.locator_issue(F.col("t"), F.col("q"), F.col("a"), F.col("b"))).collect()] == [None, "locator_mismatch", "locator_mismatch", "locator_mismatch", "missing_locator", None, None]
    rows_ = spark.createDataFrame([("k", "x"), ("k", "x"), ("m", "y")], "key string, c string")
    assert rows(governance.void_repeated(rows_, ["key"], F.col("c")), "key", "void", "differs") == [("k", True, False), ("k", True, False), ("m", False, False)]
    labels = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("e", None)], "id string, d string")
    have = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1"), ("e", None)], "id string, d string")
    assert rows(governance.bind_labels(labels, have, ["id"], "d"), "id", "status") == [("a", "bound"), ("b", "hash_mismatch"), ("c", "run_missing"), ("d", "label_missing"), ("e", "hash_mismatch")]


def test_given_cross_encoder_scores(spark):
    entries = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1), ("b", 1, 0.9), ("b", 2, 0.1)], "q string, id int, score double")
    logits = spark.createDataFrame([("a", 1, -500.0), ("a", 2, 500.0), ("b", 1, 1.0)], "q string, id int, logit double")
    assert rows(retrieval.cross_rerank(entries, logits), "q", "id", "rank", "degraded") == [("a", 1, 2, False), ("a", 2, 1, False), ("b", 1, 1, True), ("b", 2, 2, True)]
    assert retrieval.cross_rerank(entries, logits).where("q = 'a' and id = 2").first().score == 0.82


def test_backends_and_modes(spark):
    lexical = spark.createDataFrame([("q", i, i, 1 - i / 10) for i in (1, 2, 3)], "q string, id int, rank int, score double")
    dense = spark.createDataFrame([("q", 3, 1, 0.9), ("q", 4, 2, 0.8)], "q string, id int, rank int, score double")
    got, status = retrieval.select_static("dense", lexical, dense, lexical)
    assert rows(got, "rank", "id") == [(1, 3), (2, 4), (3, 1), (4, 2)] and not status["degraded"]
    assert retrieval.select_static("odd", lexical, dense)[1] == {"requested": "invalid", "actual": "legacy", "degraded": True, "reason": "retrieval_backend_invalid"}
    assert retrieval.select_static("hybrid", lexical)[1]["reason"] == "retrieval_backend_unavailable"
    assert rows(retrieval.select_static("hybrid", lexical, dense)[0], "rank", "id")[0] == (1, 3)
    branches = {"knowledge": lexical, "snapshot": dense}
    assert {r.branch for r in retrieval.routed(branches, "rag").collect()} == {"snapshot"} and retrieval.routed(branches, "nonsense").count() == 5
    assert retrieval.allowed(lexical.withColumn("source", F.lit("s")), []).count() == 3


def test_independent_count(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"], ["b", "d"], [], ["d", "c"], ["e"]],), ([],)], "k array<array<string>>")
    assert [r[0] for r in df.select(components.independent_count(F.col("k"))).collect()] == [2, 0]


def test_components_and_sources(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)], "a string, b string")
    got = dict(rows(components.connected_components(edges), "node", "root"))
    assert [got[k] for k in "abcxy"] == list("aaaxx") and {got[f"n{i:02d}"] for i in range(31)} == {"n00"}
    assert components.connected_components(edges.limit(0)).count() == 0
    links = spark.createDataFrame([("q", "1", "k1"), ("q", "2", "k1"), ("q", "3", None), ("r", "1", "k1")], "q string, item string, key string")
    assert rows(components.independent_sources(links), "q", "n_sources") == [("q", 2), ("r", 1)]


def test_ancestors(spark):
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", None)], "id string, parent string")
    assert rows(audit.ancestors(links), "id", "ancestor", "distance") == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("x", "x", 2), ("x", "y", 1), ("y", "x", 1), ("y", "y", 2)]


def test_ancestors_of_long_chains(spark, tmp_path):
    links = spark.createDataFrame([(f"q{i:02}", f"q{i + 1:02}") for i in range(25)], "id string, parent string")
    assert rows(audit.ancestors(links), "distance") == sorted((d,) for d in range(1, 26) for _ in range(26 - d))
    assert rows(audit.ancestors(links, 3), "distance") == sorted((d,) for d in (1, 2, 3) for _ in range(26 - d))


@pytest.mark.parametrize("name", ["ancestor_closure", "derived_leakage"])
def test_long_chains_as_in_sql(spark, tmp_path, name):
    import compare

    from veridex.plans import assessment, catalogue

    spark.createDataFrame([(f"q{i:02}", [f"q{i + 1:02}"]) for i in range(25)], "id string, derived_from array<string>").coalesce(1).write.parquet(str(tmp_path / "made/questions"))
    spark.createDataFrame([(f"q{i:02}", "train" if i % 3 else "dev") for i in range(26)], "id string, split string").coalesce(1).write.parquet(str(tmp_path / "made/independent_synthetic_v1"))
    (tmp_path / "d").mkdir()
    for table in (tmp_path / "made").iterdir():
        (tmp_path / f"d/{table.name}.parquet").symlink_to(next(table.glob("*.parquet")))
    queries, sql = catalogue.queries() | assessment.queries(), catalogue.oracle_sql() | assessment.oracle_sql()
    assert compare.difference(spark, queries[name], sql[name], str(tmp_path / "d")) is None


def test_publish(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "C"), (4, "d"), (4, "d"), (None, "n")], "id int, v string")
    assert publish.publish_counts(old, new, "id", ["v"]).first()[:] == (1, 1, 1, 1)
    nxt = publish.next_snapshot(old, new, "id")
    assert rows(nxt, "id", "v", "is_active") == [(1, "a", False), (2, "b", True), (3, "C", True), (4, "d", True)]
    root = str(tmp_path / "store")
    publish.write_version(spark, nxt, root, "r1")
    publish.write_version(spark, nxt.where("is_active"), root, "r2")
    assert publish.read_current(spark, root).count() == 3
    publish.write_version(spark, nxt, root, "r2")  # a complete version is not written again
    assert publish.read_current(spark, root).count() == 3
    with pytest.raises(publish.NoSnapshot):
        publish.read_current(spark, str(tmp_path / "none"))


def test_publish_runs(spark):
    runs = spark.createDataFrame([("r1", "s", "01", "running"), ("r2", "s", "02", "succeeded"), ("r3", "s", "03", "running"), ("r4", "t", "01", "running"), ("r5", "t", "02", "failed"), ("r6", "u", "01", "running")], "run string, source string, started string, status string")
    docs = spark.createDataFrame([("r3", "d1", "s"), ("r4", "d2", "s"), ("r4", "d3", None), ("r1", "d1", "s")], "run string, id string, source string")
    chunks = spark.createDataFrame([("r3", "c1", "d1"), ("r4", "c2", "d1"), ("r5", "c3", "d9")], "run string, id string, document_id string")
    assert rows(publish.rejections(runs, docs, chunks), "run", "code", "n") == [("r1", "superseded", 1), ("r4", "dangling_chunk", 1), ("r4", "source_mismatch", 2), ("r5", "not_running", 1)]
    got = {r.run: (r.status, r.records_seen, r.chunks_seen) for r in publish.publish_runs(runs, docs, chunks).collect()}
    assert got["r3"] == ("succeeded", 1, 1) and got["r6"] == ("succeeded", 0, 0) and got["r4"] == ("failed", 0, 0) and "r2" not in got
    ended = {r.run: (r.status, r.error_message) for r in publish.aborted(runs, "r1", "x" * 900).collect()}
    assert ended["r1"] == ("failed", "x" * 500) and ended["r3"] == ("running", None)


def test_governance(spark):
    from veridex.operators import governance

    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("a", 9, 5), ("b", 4, None), ("b", 5, 1)], "g string, v int, w int")
    assert rows(governance.weighted_median(df, "g", "v", "w"), "g", "median") == [("a", 2), ("b", 5)]
    df = spark.createDataFrame([("one  two\nthree", "two three"), ("abc", "x"), (None, "x"), ("abc", " ")], "t string, e string")
    got = [(r.x.start, r.x.stop) for r in df.select(governance.excerpt_offsets(F.col("t"), F.col("e")).alias("x")).collect()]
    assert got == [(5, 14), (None, None), (None, None), (None, None)]
    urls = ["https://a.org/x", "ftp://a.org", "http://user@a.org", "http://127.0.0.1/", "http://localhost", "http://a b", "http://8.8.8.8:99999", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(governance.safe_address(F.col("u"))).collect()] == ["https://a.org/x"] + [None] * 8
    cite = [("pmid", "12", "https://x.org", ""), ("doi", None, "x", "2024")]
    df = spark.createDataFrame([("c1", cite), ("c1", []), ("c2", None)], "id string, citations array<struct<type: string, pmid: string, url: string, verified_at: string>>")
    assert dict(rows(governance.page_issues(df), "code", "n")) == {"claim_id_repeated": 2, "claim_without_source": 2, "pmid_malformed": 1, "pmid_not_verified": 1, "address_malformed": 1}
