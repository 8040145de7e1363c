import random
from datetime import datetime

import compare
from veridex.llm import grouping, queries

RECORDS = "id string, question_group_id string, split string, expected_behavior string, component string, label string"
QUESTIONS = "id string, semantic_family_id string, derived_from array<string>, updated_at timestamp, ingested_at timestamp"
TARGETS = "plan string, split string, target_share double"


def record(i, g=None, split="train", b="answer"):
    return (i, g, split, b, "clash", "clash")


def question(i, f=None, d=None, day=1):
    return (i, f, d, datetime(2024, 1, day), datetime(2024, 1, day))


def test_links(spark):
    records = [record("a", "G1"), record("b", " g1 "), record("c", "N/A"), record("d", ""), record("e", "tbd"), record("f"), record("g"), record("h"), record("a", "G1"), record(None, "g1"), record("z")]
    questions = [question("c", "F"), question("d", "f "), question("e", "unknown"), question("f", None, ["dq"]), question("dq", None, ["g"]), question("h", "F", None, 1), question("h", "other", None, 2), question("x1", "F", ["b"]), question(None, "F")]
    got = {(r.id_a, r.id_b) for r in grouping.found(spark, spark.createDataFrame(records, RECORDS), spark.createDataFrame(questions, QUESTIONS)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("f", "g")}


def test_assignment_keeps_components_and_shares(spark):
    rng = random.Random(1)
    records = [record(f"r{i:04d}", f"g{i // rng.choice([1, 2, 3])}", rng.choice(["train", "dev", "blind", None]), rng.choice(["answer", "refuse"])) for i in range(900)]
    records += [record(f"big{i:03d}", "giant") for i in range(450)]  # one component holds a third
    targets = spark.createDataFrame([("p", "train", 0.6), ("p", "validation", 0.2), ("p", "test", 0.2)], TARGETS)
    df, none = spark.createDataFrame(records, RECORDS), spark.createDataFrame([], QUESTIONS)
    out = grouping.assign(df, none, targets).toPandas()
    assert len(out) == 1350 and (out.groupby("component")["assigned_split"].nunique() == 1).all()
    share = out["assigned_split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.6) < 0.02 and abs(share["test"] - 0.2) < 0.02
    assert out[out["id"] == "big000"]["assigned_split"].item() == "train"


def test_empty(spark):
    df, none, t = spark.createDataFrame([], RECORDS), spark.createDataFrame([], QUESTIONS), spark.createDataFrame([], TARGETS)
    assert grouping.found(spark, df, none).count() == 0 and grouping.assign(df, none, t).count() == 0


def test_found_of_the_sql(spark, small):
    assert compare.difference(spark, queries.queries()["p3_found"], queries.oracle_sql()["p3_found"], small) is None


def test_many_labels_are_balanced(spark):
    """More labels than cells: every record is placed, shares hold, and no round ends worse than the start."""
    rng = random.Random(2)
    records = [record(f"r{i:04d}", f"g{i // 2}", "train", f"label{rng.randrange(150)}") for i in range(1200)]
    targets = spark.createDataFrame([("p", "train", 0.5), ("p", "test", 0.5)], TARGETS)
    out = grouping.assign(spark.createDataFrame(records, RECORDS), spark.createDataFrame([], QUESTIONS), targets).toPandas()
    assert len(out) == 1200 and (out.groupby("component")["assigned_split"].nunique() == 1).all()
    assert abs((out["assigned_split"] == "train").mean() - 0.5) < 0.02
