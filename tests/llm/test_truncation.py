import random

import numpy as np

from veridex.llm import truncation

DOCS = "doc_id long, source string, title string, text string, length string"


def test_limits_and_posterior():
    rng = np.random.default_rng(1)
    x = np.minimum(np.exp(rng.normal(6, 0.8, 4000)).astype(int), 1000)
    lengths, n = np.unique(x, return_counts=True)
    limits, posterior = truncation.fit_censored(lengths, n.astype(float))
    assert limits == [1000] and posterior[lengths == 1000][0] > 0.95 and posterior[lengths < 990].max() == 0
    assert truncation.fit_censored(np.array([5]), np.array([3.0]))[0] == []


def test_a_rare_limit_under_many_frequent_lengths():
    """More than 200 ordinary lengths are each more frequent than the spike of the limit."""
    lengths = np.arange(100, 3001)
    n = np.where(lengths < 500, 1000.0, 2.0)
    n[lengths == 2000] = 300.0
    assert truncation.candidate_limits(lengths, n) == [2000]


def test_a_limit_needs_more_texts_among_more_lengths():
    few, many = np.array([300, 900]), np.concatenate([[300], np.arange(9_000, 900_000, 300)])
    spike = lambda x: np.where(x == 300, 4.0, 1.0)
    assert truncation.candidate_limits(few, spike(few)) == [300] and truncation.candidate_limits(many, spike(many)) == []


def test_endings(spark):
    rng = random.Random(2)
    body = lambda: " ".join(f"Sentence {rng.randrange(99)} of the text reports a result." for _ in range(rng.randint(3, 30)))
    whole = [(i, "a", f"Title {i}", body(), "x") for i in range(150)]
    cut = [(1000 + i, "b", f"Title {i}", ((body() + " ") * 9)[:400], "x") for i in range(60)]
    special = [
        (2000, "a", "A study of sleep", "A study of sleep", "x"), (2001, "a", "A study of sleep", "A study of sl", "x"), (2002, "a", "T", body() + " [12]", "x"), (2003, "a", "T", body() + " Keywords: sleep, walking", "x"),
        (2004, "a", "T", body() + " Smith for the writing group", "x"), (2005, "a", "T", body() + "\n- statin 20 mg", "x"), (2006, "a", "T", body()[:-3] + " [...]", "x"), (2007, "a", "T", body() + " The pressure was", "x"),
        (2008, "a", "T", "血压下降。研究对象来自医院，随访两", "x"), (2009, "a", "T", "血压下降。研究对象来自医院。", "x"), (2010, "a", "T", None, "x"), (2011, "a", "T", "  ", "x"), (None, "a", "T", "cut of", "x"),
        (2012, None, None, "no title and no end", "x"), (2013, "a", "T", body() + " Keywords: sleep, walking", "x"), (2014, "a", "T", body() + "\n(Smith, 2004)", "x"), (2015, "a", "T", body() + " Registered as ABCDEF", "x"),
    ]
    df = spark.createDataFrame(whole + cut + special, DOCS)
    got = {r.doc_id for r in truncation.found(spark, df).collect()}
    expect = {r[0] for r in cut if not r[3].rstrip().endswith(".")} | {2001, 2006, 2007, 2008, 2012}
    assert got == expect
    assert {r.source: r.n_truncated for r in truncation.rates(df).collect()}["b"] == len(expect & {r[0] for r in cut})
    assert truncation.found(spark, df.limit(0)).count() == 0
