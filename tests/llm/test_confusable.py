from veridex.llm import confusable

TITLES = ["Effect of statin on blood pressure", "Оценка давления крови", "Τα αποτελέσματα της μελέτης", "cop case score", "naïve use of x²"]


def canon(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES * 5 + texts)], "id int, text string")
    got = {r.id: r.canonical for r in confusable.canonical(df, "text").collect()}
    return [got[len(TITLES) * 5 + i] for i in range(len(texts))]


def test_equal_looks_become_equal(spark):
    want = "Effect of statin on blood pressure"
    odd = ["Εffесt of statin on blооd рressure", "Ｅｆｆｅｃｔ of statin on blood pressure", "Effect of sta​tin on­ blood pressure", "Effect of statin on blood pressure", " Effect of statin on blood pressure", "Eﬀect of statin on blood pressure"]
    assert canon(spark, odd) == [want] * len(odd)
    assert canon(spark, ["naïve", "⾼血压", "open‑label", "在dοtradοna基础上"]) == ["naïve", "高血压", "open-label", "在dotradona基础上"]


def test_visible_differences_stay(spark):
    odd = ["x²", "x2", "Naive", "naïve", "STATIN", "statin", "①", "1", "Оценка", "", None, "​"]
    assert canon(spark, odd) == ["x²", "x2", "Naive", "naïve", "STATIN", "statin", "①", "1", "Оценка", "", None, ""]


def test_pairs(spark):
    rows = [("1", "blood score"), ("2", "blооd score"), ("3", "blood score"), ("4", "Blood score"), ("5", None), (None, "blood score"), ("1", "blood score")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(f"w{i}", t, "x") for i, t in enumerate(TITLES)], "id string, text string, canonical string")
    assert {tuple(r) for r in confusable.look_alikes(df, "f").collect()} == {("f", "1", "2"), ("f", "2", "3")}
    assert confusable.look_alikes(df.limit(0), "f").count() == 0


def test_one_title_of_many_rows_meets_its_variant_once(spark):
    """50,000 copies of a title and one variant give as many pairs, and no pair among the copies is looked at."""
    from pyspark.sql import functions as F

    copies = spark.range(50_000).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("blood score").alias("text"))
    rest = spark.createDataFrame([("odd", "blооd score")] + [(f"w{i}", t) for i, t in enumerate(TITLES)], "id string, text string")
    pairs = confusable.look_alikes(copies.union(rest), "f")
    assert pairs.count() == 50_000 and pairs.where("id_a <> 'odd' and id_b <> 'odd'").count() == 0
