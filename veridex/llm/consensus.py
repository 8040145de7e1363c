"""Consensus of several annotators by regularised minimax conditional entropy.

Every vote is explained by the item's true class c through P(k | c) ~ exp(sigma[annotator][c, k] + tau[item][c, k]).
The dual of the minimax problem is climbed by coordinates: Newton steps for the annotators, Newton steps for the items,
then the posterior of every item's class. Penalties ``alpha`` on sigma and, scaled by the votes per annotator over the
votes per item, on tau follow the published rule. All sums are grouped aggregates of one row per vote, so neither a
busy annotator nor a much-voted item is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm.keys import BEHAVIORS, behavior, key
from veridex.session import Stage

CLASSES = range(len(BEHAVIORS))
CELLS = [(c, k) for c in CLASSES for k in CLASSES]
BROADCAST_ANNOTATORS = 100_000
ROUNDS = 30  # at most
TOLERANCE = 1e-3  # rounds end when the mean change of a posterior falls below it


def usable_votes(reviews: DataFrame) -> DataFrame:
    """(item, annotator, k): per item and annotator the usable submission with the latest reviewed_at.

    Null or unusable behavior, item or reviewer: no vote. Ties of reviewed_at go to the later received_at, then to the
    later label in BEHAVIORS, so the result never depends on row order. Exact duplicates collapse.
    """
    label = behavior(F.col("labels.behavior"))
    votes = reviews.select(
        F.col("item_id").alias("item"),
        key(F.col("reviewer_id")).alias("annotator"),
        F.col("reviewed_at"),
        F.col("received_at"),
        F.array_position(F.array(*map(F.lit, BEHAVIORS)), label).cast("int").alias("k1"),
    ).where("item is not null and annotator is not null and k1 > 0")
    return (
        votes.groupBy("item", "annotator")
        .agg(F.max(F.struct(F.coalesce("reviewed_at", F.timestamp_seconds(F.lit(0))).alias("a"), F.coalesce("received_at", F.timestamp_seconds(F.lit(0))).alias("b"), "k1")).alias("last"))
        .select("item", "annotator", (F.col("last.k1") - 1).alias("k"))
    )


def _softmax(votes: DataFrame) -> DataFrame:
    """Adds p_ck, the model's probability of label k given class c, for sigma and tau joined on the row."""
    logits = {(c, k): F.col(f"s{c}{k}") + F.col(f"t{c}{k}") for c, k in CELLS}
    votes = votes.select("*", *[F.greatest(*[logits[c, k] for k in CLASSES]).alias(f"m{c}") for c in CLASSES])
    votes = votes.select("*", *[F.exp(logits[c, k] - F.col(f"m{c}")).alias(f"e{c}{k}") for c, k in CELLS])
    total = {c: sum((F.col(f"e{c}{k}") for k in CLASSES[1:]), F.col(f"e{c}0")) for c in CLASSES}
    return votes.select("item", "annotator", "k", *[c for c in votes.columns if c in ("q0", "q1", "q2")], *[(F.col(f"e{c}{k}") / total[c]).alias(f"p{c}{k}") for c, k in CELLS])


def _pick(prefix: str, c: int) -> Column:
    """Value of the cell of class c at the vote's own label."""
    return F.when(F.col("k") == 0, F.col(f"{prefix}{c}0")).when(F.col("k") == 1, F.col(f"{prefix}{c}1")).otherwise(F.col(f"{prefix}{c}2"))


def _step(name: str, c: int, k: int, weight: Column, penalty: Column | float) -> Column:
    """Damped Newton step of one tilting parameter from its summed gradient g and curvature h."""
    old = F.col(f"{name}{c}{k}")
    return (old + (weight * F.col(f"g{c}{k}") - F.lit(penalty) * old) / (F.lit(1.5) * weight * F.col(f"h{c}{k}") + F.lit(penalty))).alias(f"{name}{c}{k}")


def _sums(weights: dict[int, Column]) -> list[Column]:
    out = []
    for c, k in CELLS:
        hit = (F.col("k") == k).cast("double")
        out.append(F.sum(weights[c] * (hit - F.col(f"p{c}{k}"))).alias(f"g{c}{k}"))
        out.append(F.sum(weights[c] * F.col(f"p{c}{k}") * (1 - F.col(f"p{c}{k}"))).alias(f"h{c}{k}"))
    return out


def minimax_entropy(votes: DataFrame, alpha: float = 1.0, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(items, annotators): posteriors q0..q2, tilts t_ck and the round's change per item; tilts s_ck per annotator.

    ``votes`` has item, annotator, k. Empty input gives two empty frames. Rounds end when the mean over items of the
    largest change of a posterior is below TOLERANCE, after ``rounds`` at the latest.
    """
    spark = votes.sparkSession
    stage = Stage(spark, "consensus")
    votes = stage.write(votes)
    one = F.lit(1.0)
    # The votes that stand for one item or annotator are at most one per pair, so counts need no distinct.
    shape = votes.agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"), F.countDistinct("annotator").alias("annotators")).first()
    n, n_items, n_annotators = shape["n"], max(shape["items"], 1), max(shape["annotators"], 1)
    beta = alpha * (max(n, 1) / n_annotators) / (max(n, 1) / n_items)
    small = n_annotators <= BROADCAST_ANNOTATORS
    shares = [(F.sum((F.col("k") == c).cast("double")) + 0.1).alias(f"n{c}") for c in CLASSES]
    items = votes.groupBy("item").agg(*shares)
    total = F.col("n0") + F.col("n1") + F.col("n2")
    items = stage.write(items.select("item", *[(F.col(f"n{c}") / total).alias(f"q{c}") for c in CLASSES], *[F.lit(0.0).alias(f"t{c}{k}") for c, k in CELLS]))
    annotators = stage.write(votes.select("annotator").distinct().select("annotator", *[F.lit(0.0).alias(f"s{c}{k}") for c, k in CELLS]))
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    for _ in range(rounds):
        rows = _softmax(votes.join(items, "item").join(hint(annotators), "annotator"))
        grown = rows.groupBy("annotator").agg(*_sums({c: F.col(f"q{c}") for c in CLASSES}))
        old_annotators = annotators
        annotators = stage.write(annotators.join(grown, "annotator").select("annotator", *[_step("s", c, k, one, alpha) for c, k in CELLS]))

        # log likelihoods and the items' gradients come from one pass; the class weight of an item is constant over its votes
        rows = _softmax(votes.join(items, "item").join(hint(annotators), "annotator"))
        seen = rows.groupBy("item").agg(*[F.sum(F.log(F.greatest(_pick("p", c), F.lit(1e-12)))).alias(f"l{c}") for c in CLASSES], *_sums({c: one for c in CLASSES}))
        prior = items.agg(*[F.log(F.avg(f"q{c}")).alias(f"r{c}") for c in CLASSES])
        joined = items.select("item", *[F.col(f"q{c}").alias(f"b{c}") for c in CLASSES], *[f"t{c}{k}" for c, k in CELLS]).join(seen, "item").crossJoin(F.broadcast(prior))
        score = {c: F.col(f"l{c}") + F.col(f"r{c}") for c in CLASSES}
        top = F.greatest(*score.values())
        joined = joined.select("*", *[F.exp(score[c] - top).alias(f"u{c}") for c in CLASSES])
        norm = F.col("u0") + F.col("u1") + F.col("u2")
        joined = joined.select("*", *[(F.col(f"u{c}") / norm).alias(f"q{c}") for c in CLASSES])
        old_items = items
        change = F.greatest(*[F.abs(F.col(f"q{c}") - F.col(f"b{c}")) for c in CLASSES])
        items = stage.write(joined.select("item", "q0", "q1", "q2", change.alias("change"), *[_step("t", c, k, F.col(f"q{c}"), beta) for c, k in CELLS]))
        stage.drop(old_annotators, old_items)
        if (items.agg(F.avg("change").alias("m")).first()["m"] or 0.0) < TOLERANCE:
            break
    stage.drop(votes)
    return items, annotators


def _label(prefix: str) -> Column:
    """Most likely class of a row; ties go to the first in BEHAVIORS."""
    best = F.greatest(*[F.col(f"{prefix}{c}") for c in CLASSES])
    return F.when(F.col(f"{prefix}0") == best, BEHAVIORS[0]).when(F.col(f"{prefix}1") == best, BEHAVIORS[1]).otherwise(BEHAVIORS[2])


def consensus(reviews: DataFrame, least_annotators: int = 1, alpha: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """One row per item: behavior, its posterior, votes, and the observed pairwise agreement (null for one vote)."""
    votes = usable_votes(reviews)
    items, _ = minimax_entropy(votes, alpha, rounds)
    counts = votes.groupBy("item").agg(F.count("*").alias("n_votes"), *[F.sum((F.col("k") == c).cast("long")).alias(f"n{c}") for c in CLASSES])
    pairs = sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in CLASSES[1:]), F.col("n0") * (F.col("n0") - 1))
    return (
        items.join(counts, "item")
        .where(F.col("n_votes") >= least_annotators)
        .select(
            F.col("item").alias("item_id"),
            _label("q").alias("behavior"),
            F.round(F.greatest("q0", "q1", "q2"), 6).alias("confidence"),
            "n_votes",
            F.when(F.col("n_votes") > 1, pairs / (F.col("n_votes") * (F.col("n_votes") - 1))).alias("agreement"),
        )
    )


def agreement(reviews: DataFrame) -> DataFrame:
    """One row: observed agreement over all pairs of votes on one item, Krippendorff's nominal alpha, counts.

    Needs no model, so it is reported apart from the consensus. Items with one vote have no pairs and do not count.
    """
    n = [F.col(f"n{c}") for c in CLASSES]
    per_item = (
        usable_votes(reviews)
        .groupBy("item")
        .agg(*[F.sum((F.col("k") == c).cast("double")).alias(f"n{c}") for c in CLASSES])
        .withColumn("m", n[0] + n[1] + n[2])
        .where("m > 1")
    )
    same = sum((x * (x - 1) for x in n[1:]), n[0] * (n[0] - 1))
    total = per_item.agg(
        F.count("*").alias("n_items"),
        F.sum("m").alias("n_votes"),
        F.sum(same).alias("agreeing"),
        F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"),
        F.sum(F.col("m") - same / (F.col("m") - 1)).alias("disagree"),
        *[F.sum(f"n{c}").alias(f"n{c}") for c in CLASSES],
    )
    expected = F.col("n_votes") * F.col("n_votes") - sum((x * x for x in n[1:]), n[0] * n[0])
    return total.select(
        "n_items",
        F.coalesce(F.col("n_votes").cast("long"), F.lit(0).cast("long")).alias("n_votes"),
        F.round(F.try_divide(F.col("agreeing"), F.col("pairs")), 6).alias("observed_agreement"),
        F.round(1 - F.try_divide(F.col("disagree") * (F.col("n_votes") - 1), expected), 6).alias("krippendorff_alpha"),
    )


def reliability(reviews: DataFrame, alpha: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """One row per annotator: votes, expected accuracy under the items' posteriors, and its fitted diagonal."""
    votes = usable_votes(reviews)
    items, annotators = minimax_entropy(votes, alpha, rounds)
    seen = (
        votes.join(items.select("item", "q0", "q1", "q2"), "item")
        .groupBy("annotator")
        .agg(F.count("*").alias("n_votes"), F.avg(F.when(F.col("k") == 0, F.col("q0")).when(F.col("k") == 1, F.col("q1")).otherwise(F.col("q2"))).alias("reliability"))
    )
    own = {c: F.exp(F.col(f"s{c}{c}")) / sum((F.exp(F.col(f"s{c}{k}")) for k in CLASSES[1:]), F.exp(F.col(f"s{c}0"))) for c in CLASSES}
    return annotators.join(seen, "annotator").select(
        F.col("annotator").alias("reviewer_id"), "n_votes", F.round("reliability", 6).alias("reliability"), *[F.round(own[c], 6).alias(f"hit_{BEHAVIORS[c]}") for c in CLASSES]
    )


def found(spark, reviews: DataFrame) -> DataFrame:
    """p1_found: items with usable behaviors of at least three reviewers and the fitted behavior of each."""
    return consensus(reviews, least_annotators=3).select("item_id", "behavior")
