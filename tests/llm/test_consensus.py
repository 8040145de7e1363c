import random
from datetime import datetime

import compare
from veridex.llm import consensus, queries

SCHEMA = "item_id string, question_id string, reviewer_id string, labels struct<behavior: string>, reviewed_at timestamp, received_at timestamp, k int"
NAMES = consensus.BEHAVIORS


def review(item, reviewer, label, day=1):
    return (item, "q", reviewer, (label,) if label is not None else None, datetime(2024, 1, day), datetime(2024, 1, day), 5)


def test_votes_are_read_and_latest_counts(spark):
    rows = [review("i", " REV-1 ", "Answer"), review("i", "rev-1", "Qualified answer", 2), review("i", "rev-2", "REFUSE"), review("i", "rev-3", "cannot_judge"), review("i", None, "answer"), review(None, "rev-1", "answer"), review("i", "rev-4", None), review("i", "n/a", "answer")]
    df = spark.createDataFrame(rows + rows, SCHEMA)
    assert sorted((r.annotator, r.k) for r in consensus.usable_votes(df).collect()) == [("rev-1", 1), ("rev-2", 2)]
    assert consensus.found(spark, df).count() == 0  # two reviewers only


def test_beats_majority_with_bad_annotators(spark):
    rng = random.Random(4)
    truth = {f"i{n}": rng.randrange(3) for n in range(250)}
    skill = [0.92, 0.9, 0.88, 0.4, 0.35]
    rows = []
    for item, t in truth.items():
        for a, s in enumerate(skill):
            label = t if rng.random() < s else (0 if a >= 3 else rng.randrange(3))
            rows.append(review(item, f"rev-{a}", NAMES[label]))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.item_id: r.behavior for r in consensus.found(spark, df).collect()}
    votes = {}
    for item, _, _, label, *_ in rows:
        votes.setdefault(item, []).append(label[0])
    model = sum(got[i] == NAMES[t] for i, t in truth.items())
    majority = sum(max(NAMES, key=votes[i].count) == NAMES[t] for i, t in truth.items())
    assert model > majority and model / len(truth) > 0.93
    quality = {r.reviewer_id: r.reliability for r in consensus.reliability(df).collect()}
    assert min(quality[f"rev-{a}"] for a in range(3)) > max(quality["rev-3"], quality["rev-4"])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert consensus.consensus(df).count() == 0 and consensus.reliability(df).count() == 0
    assert consensus.agreement(df).first().n_items == 0


def test_agreement_of_the_sql(spark, small):
    assert compare.difference(spark, queries.queries()["p1_agreement"], queries.oracle_sql()["p1_agreement"], small) is None
