"""Retrieval and answer evaluation: binary and graded metrics, quantiles, slices, paired bootstrap, review adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 9
RANGES = 64


def binary_metrics(ranking: DataFrame, relevant: DataFrame, k: int = 8) -> DataFrame:
    """(q, n_relevant, recall, reciprocal_rank, ndcg) of rankings (q, id, rank) against (q, id); only a document's first hit counts.

    Questions with relevant documents but an empty ranking score 0; questions without relevant documents have no row.
    The reciprocal rank looks at the whole list.
    """
    first = ranking.groupBy("q", "id").agg(F.min("rank").alias("rank"))
    total = relevant.select("q", "id").distinct().groupBy("q").agg(F.count("*").alias("n_relevant"))
    hits = first.join(relevant.select("q", "id").distinct(), ["q", "id"])
    gain = F.when(F.col("rank") <= k, 3.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = hits.groupBy("q").agg(F.sum((F.col("rank") <= k).cast("long")).alias("hits"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    rows = total.join(per, "q", "left").fillna(0, ["hits"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 3.0 / F.log2(i + 1.0))
    return rows.select("q", "n_relevant", F.round(F.col("hits") / F.col("n_relevant"), SCALE).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), SCALE).alias("reciprocal_rank"), F.round(F.col("dcg") / ideal, SCALE).alias("ndcg"))


def graded_metrics(ranking: DataFrame, grades: DataFrame, k: int = 8) -> DataFrame:
    """(q, status, hits, total_relevant, n_duplicates, n_unjudged, recall, completion, mrr, ndcg) with grades 0..3.

    A repeated document uses its place and gains nothing. An unjudged document in the first k, or no document of grade 2
    or more, makes the scores null: missing judgments are never negative ones.
    """
    place = Window.partitionBy("q", "id").orderBy("rank")
    head = ranking.where(F.col("rank") <= k).withColumn("turn", F.row_number().over(place)).join(grades.select("q", "id", "grade"), ["q", "id"], "left")
    fresh = F.col("turn") == 1
    good = fresh & (F.col("grade") >= 2)
    per = head.groupBy("q").agg(
        F.sum((~fresh).cast("long")).alias("n_duplicates"), F.sum((fresh & F.col("grade").isNull()).cast("long")).alias("n_unjudged"), F.sum(F.coalesce(good, F.lit(False)).cast("long")).alias("hits"),
        F.min(F.when(good & (F.col("rank") <= 8), F.col("rank"))).alias("first"), F.sum(F.when(fresh & F.col("grade").isNotNull(), (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    order = Window.partitionBy("q").orderBy(F.desc("grade"), "id")
    ideal = grades.withColumn("r", F.row_number().over(order)).groupBy("q").agg(F.sum((F.col("grade") >= 2).cast("long")).alias("total_relevant"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1.0)).otherwise(0.0)).alias("idcg"))
    rows = per.join(ideal, "q", "full_outer").fillna(0, ["n_duplicates", "n_unjudged", "hits", "total_relevant"]).fillna(0.0, ["dcg"])
    status = F.when(F.col("n_unjudged") > 0, "unjudged_candidates").when(F.col("total_relevant") == 0, "no_relevant_qrels").otherwise("scored")
    scored = lambda value: F.when(status == "scored", F.round(value, SCALE))
    return rows.select(
        "q", status.alias("status"), "hits", "total_relevant", "n_duplicates", "n_unjudged", scored(F.try_divide(F.col("hits"), F.col("total_relevant"))).alias("recall"),
        scored(F.try_divide(F.col("hits"), F.least(F.col("total_relevant"), F.lit(k)))).alias("completion"), scored(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), scored(F.try_divide(F.col("dcg"), F.col("idcg"))).alias("ndcg"),
    )


def slices(metrics: DataFrame, dimensions: list[str], values: list[str]) -> DataFrame:
    """Means of the values per value of each dimension and over all, as grouping sets (dimension, value, n, means)."""
    sets = metrics.groupingSets([[F.col(d)] for d in dimensions] + [[]], *[F.col(d) for d in dimensions])
    means = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *[F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values])
    width = len(dimensions)
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        own = F.col("g") == F.lit((1 << width) - 1 - (1 << (width - 1 - i)))
        name, value = F.when(own, F.lit(d)).otherwise(name), F.when(own, F.col(d)).otherwise(value)
    return means.select(name.alias("dimension"), value.alias("value"), "n", *[f"mean_{v}" for v in values])


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 and the interpolated median per group; nulls don't count.

    Values are counted first, ranges of values get running counts, and only the ranges that hold a wanted rank are ordered
    inside, so a group of any size is spread over RANGES tasks.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    ends = counted.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("c").alias("n"))
    spot = F.when(F.col("high") > F.col("low"), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).otherwise(0).cast("int")
    dealt = counted.join(ends, by).withColumn("range", spot)
    sums = dealt.groupBy(by, "range").agg(F.sum("c").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(by, "range").orderBy(value))
    placed = dealt.join(before, [by, "range"]).withColumn("upto", upto)
    n = F.col("n")
    nearest = lambda p: F.min(F.when(F.col("upto") >= F.ceil(n * F.lit(p)), F.col(value)))
    middle = lambda r: F.min(F.when(F.col("upto") >= r, F.col(value)))
    per = placed.groupBy(by).agg(F.first("n").alias("n"), nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), nearest(0.99).alias("p99"), middle(F.floor((n + 1) / 2)).alias("a"), middle(F.floor(n / 2) + 1).alias("b"))
    every = rows.select(by).distinct().join(per, by, "left") if rows.where(F.col(value).isNull()).limit(1).count() else per
    return every.select(by, F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95", "p99", F.round((F.col("a") + F.col("b")) / 2, 6).alias("median"))


def paired_bootstrap(pairs: DataFrame, seed: int = 7, draws: int = 2000) -> DataFrame:
    """One row: mean difference and its 95 % percentile interval, resampling whole groups, from (g, baseline, candidate).

    Groups collapse to a sum and a count before they are drawn. A draw takes each group a Poisson(1) number of times,
    seeded by draw and group, so draws are made where the groups are and only partial sums meet.
    """
    groups = pairs.where("baseline is not null and candidate is not null").groupBy("g").agg(F.sum(F.col("candidate") - F.col("baseline")).alias("d"), F.count("*").alias("n"))
    spread = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("g").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    bounds, p, total = [], 0.36787944117144233, 0.0
    for i in range(8):
        total += p
        bounds.append(total)
        p /= i + 1
    times = sum(((u > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    means = spread.withColumn("t", times).groupBy("draw").agg((F.sum(F.col("t") * F.col("d")) / F.sum(F.col("t") * F.col("n"))).alias("m"))
    whole = groups.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_questions"), F.round(F.sum("d") / F.sum("n"), 6).alias("mean_difference"))
    interval = means.agg(F.round(F.percentile("m", 0.025), 6).alias("ci_low"), F.round(F.percentile("m", 0.975), 6).alias("ci_high"))
    return whole.crossJoin(interval)


def macro_means(rows: DataFrame, question: str, repeats: int, value: str, by: str) -> DataFrame:
    """Mean of question means per group; a question counts only if all its repeats are valid, else the group's mean is null."""
    per = rows.groupBy(by, question).agg(F.count(value).alias("valid"), F.avg(value).alias("mean"))
    whole = F.col("valid") >= repeats
    grouped = per.groupBy(by).agg(F.count("*").alias("n_questions"), F.sum((~whole).cast("long")).alias("n_excluded"), F.avg(F.when(whole, F.col("mean"))).alias("m"))
    return grouped.select(by, "n_questions", "n_excluded", F.when(F.col("n_excluded") == 0, F.round("m", 6)).alias(f"macro_{value}"))


def adjudicate(labels: DataFrame) -> DataFrame:
    """(item, first, second, final, status, n_reviewers) of (item, reviewer, label): two reviewers agree, or others decide, else open.

    Reviewers are ordered by id; the first two review. Where they differ, the label of most further reviewers decides, and
    a tie between them stays open. Null labels take no part.
    """
    order = Window.partitionBy("item").orderBy("reviewer")
    turned = labels.where("label is not null").withColumn("turn", F.row_number().over(order))
    votes = turned.where("turn > 2").groupBy("item", "label").agg(F.count("*").alias("v"))
    ahead = votes.groupBy("item").agg(F.max("v").alias("most")).join(votes, "item").where("v = most").groupBy("item").agg(F.count("*").alias("tied"), F.max("label").alias("third"))
    pick: list[Column] = [F.max(F.when(F.col("turn") == i, F.col("label"))).alias(n) for i, n in ((1, "first"), (2, "second"))]
    rows = turned.groupBy("item").agg(*pick, F.count("*").alias("n_reviewers")).join(ahead, "item", "left")
    agreed = F.col("first") == F.col("second")
    decided = F.coalesce(F.col("tied") == 1, F.lit(False))
    status = F.when(F.col("second").isNull(), "single").when(agreed, "agreed").when(decided, "adjudicated").otherwise("open")
    return rows.select("item", "first", "second", F.when(agreed, F.col("first")).when(F.col("second").isNotNull() & decided, F.col("third")).alias("final"), status.alias("status"), "n_reviewers")


def applicable(metric: str, behavior: Column, retrieval: Column, answer: Column, refusal: Column) -> Column:
    """Whether a question counts for a metric: refusal targets never enter retrieval or answer denominators."""
    if metric in ("behavior_accuracy", "serious_error_rate"):
        return F.lit(True)
    if metric == "refusal_quality":
        return F.coalesce(refusal, F.lit(False))
    return F.coalesce((behavior != "refuse") & (retrieval if metric.startswith("recall") else answer), F.lit(False))


def quality_report(questions: DataFrame, values: DataFrame, metrics: list[str], dimensions: list[str]) -> DataFrame:
    """(metric, dimension, value, expected_questions, valid_questions, status, score, observed_mean) over all and per slice.

    ``questions`` has q, behavior, retrieval, answer, refusal and the dimensions; ``values`` one row per generation with q and
    the metrics, null for no judgment. A question's generations are averaged before questions are; a score is given only
    if every applicable question has a value for each of its generations, else the evidence is insufficient.
    """
    means = values.groupBy("q").agg(F.count("*").alias("repeats"), *[F.count(m).alias(f"n_{m}") for m in metrics], *[F.avg(m).alias(f"m_{m}") for m in metrics])
    rows = questions.join(means, "q", "left")
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dimensions], F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")))
    each = [F.struct(F.lit(m).alias("metric"), applicable(m, F.col("behavior"), F.col("retrieval"), F.col("answer"), F.col("refusal")).alias("on"), F.coalesce((F.col(f"n_{m}") == F.col("repeats")) & (F.col("repeats") > 0), F.lit(False)).alias("whole"), F.col(f"m_{m}").alias("mean")) for m in metrics]
    spread = rows.select(cells.alias("cells"), F.array(*each).alias("each")).select(F.explode("cells").alias("c"), "each").select("c.*", F.explode("each").alias("e")).where("e.on")
    per = spread.groupBy("e.metric", "dimension", "value").agg(F.count("*").alias("expected_questions"), F.sum(F.col("e.whole").cast("long")).alias("valid_questions"), F.avg(F.when(F.col("e.whole"), F.col("e.mean"))).alias("m"), F.avg("e.mean").alias("o"))
    whole = F.col("expected_questions") == F.col("valid_questions")
    return per.select("metric", "dimension", "value", "expected_questions", "valid_questions", F.when(whole, "scored").otherwise("evidence_insufficient").alias("status"), F.when(whole, F.round("m", 6)).alias("score"), F.round("o", 6).alias("observed_mean"))


def compare_versions(means: DataFrame, questions: DataFrame, by: str, before: str, after: str, metrics: list[str]) -> DataFrame:
    """(metric, status, expected, paired, missing, mean_difference) of question means (q, by, metrics) of two versions.

    Only questions with a mean in both versions are paired; the others are counted as missing.
    """
    side = lambda v, end: means.where(F.col(by) == v).select("q", *[F.col(m).alias(f"{m}_{end}") for m in metrics])
    both = questions.select("q").distinct().join(side(before, "a"), "q", "left").join(side(after, "b"), "q", "left")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in metrics]))
    per = both.select(each.alias("x")).select("x.*").groupBy("metric").agg(F.count("*").alias("expected"), F.count(F.col("a") + F.col("b")).alias("paired"), F.avg(F.col("b") - F.col("a")).alias("d"))
    status = F.when(F.col("expected") == F.col("paired"), "compared").otherwise("evidence_insufficient")
    return per.select("metric", status.alias("status"), "expected", "paired", (F.col("expected") - F.col("paired")).alias("missing"), F.round("d", 6).alias("mean_difference"))


def result_summary(rows: DataFrame, metrics: dict[str, Column], answerable: Column) -> DataFrame:
    """(metric, numerator, denominator, value, itt_numerator, itt_denominator, itt_value) of runs (run_status, ...).

    Means are over successful runs with a value; as asked (itt), errors count 0 and skipped runs not at all, among the
    answerable. Any other run_status raises an error.
    """
    valid = F.coalesce(F.col("run_status").isin("success", "error", "skipped"), F.lit(False))
    rows = rows.withColumn("run_status", F.when(valid, F.col("run_status")).otherwise(F.raise_error(F.lit("every run needs success, error or skipped")).cast("string")))
    won, tried = F.col("run_status") == "success", (F.col("run_status") != "skipped") & F.coalesce(answerable, F.lit(False))
    parts = []
    for name, value in metrics.items():
        own = value.cast("double")
        parts += [F.sum(F.when(won, own)).alias(f"s_{name}"), F.count(F.when(won, own)).alias(f"n_{name}"), F.sum(F.when(tried, F.when(won, F.coalesce(own, F.lit(0.0))).otherwise(0.0))).alias(f"i_{name}"), F.count(F.when(tried, 1)).alias(f"j_{name}")]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(f"s_{m}"), F.lit(0.0)).alias("s"), F.col(f"n_{m}").alias("n"), F.coalesce(F.col(f"i_{m}"), F.lit(0.0)).alias("i"), F.col(f"j_{m}").alias("j")) for m in metrics]))
    out = rows.agg(*parts).select(each.alias("x"))
    r = lambda c: F.round(c, 6)
    return out.select("x.metric", r("x.s").alias("numerator"), F.col("x.n").alias("denominator"), r(F.try_divide("x.s", "x.n")).alias("value"), r("x.i").alias("itt_numerator"), F.col("x.j").alias("itt_denominator"), r(F.try_divide("x.i", "x.j")).alias("itt_value"))


def family_recall(ranking: DataFrame, relevant: DataFrame, family_of: DataFrame, k: int = 8) -> DataFrame:
    """(q, n_families, n_found, family_recall): distinct study families among the relevant documents, and those in the first k."""
    wanted = relevant.select("q", "id").distinct().join(family_of, "id")
    total = wanted.groupBy("q").agg(F.countDistinct("family").alias("n_families"))
    hit = wanted.join(ranking.where(F.col("rank") <= k).select("q", "id").distinct(), ["q", "id"]).groupBy("q").agg(F.countDistinct("family").alias("n_found"))
    rows = total.join(hit, "q", "left").fillna(0, ["n_found"])
    return rows.select("q", "n_families", "n_found", F.round(F.col("n_found") / F.col("n_families"), SCALE).alias("family_recall"))


def profile_scores(metrics: DataFrame, topics: DataFrame, latency: DataFrame) -> DataFrame:
    """(profile, n, recall, mrr, ndcg, worst_topic, score) of question metrics (profile, q, recall, reciprocal_rank, ndcg).

    ``topics`` has (q, topic), a question without one counts as unclassified; ``latency`` has (profile, ms). The score
    weighs recall 0.45, nDCG 0.25, support 0.15 (the share of questions with a relevant first row), the worst topic's
    recall 0.10 and latency 0.05.
    """
    named = metrics.join(topics, "q", "left").withColumn("topic", F.coalesce("topic", F.lit("unclassified")))
    worst = named.groupBy("profile", "topic").agg(F.avg("recall").alias("r")).groupBy("profile").agg(F.min("r").alias("worst"))
    per = metrics.groupBy("profile").agg(F.count("*").alias("n"), F.avg("recall").alias("r"), F.avg("reciprocal_rank").alias("m"), F.avg("ndcg").alias("d"), F.avg((F.col("reciprocal_rank") == 1).cast("double")).alias("s"))
    rows = per.join(worst, "profile").join(latency, "profile", "left").fillna(0.0, ["ms"])
    score = 0.45 * F.col("r") + 0.25 * F.col("d") + 0.15 * F.col("s") + 0.10 * F.col("worst") + 0.05 / (1 + F.col("ms") / 2500)
    return rows.select("profile", "n", F.round("r", 6).alias("recall"), F.round("m", 6).alias("mrr"), F.round("d", 6).alias("ndcg"), F.round("worst", 6).alias("worst_topic"), F.round(score, 6).alias("score"))


def alignment(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """(status, n) of runs of two versions: the sets of digests per key are equal, differ, or stand on one side only."""
    own = lambda df, name: df.where(F.col(digest).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(digest)).alias(name))
    status = F.when(F.col("x").isNull(), "only_after").when(F.col("y").isNull(), "only_before").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return own(a, "x").join(own(b, "y"), key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
