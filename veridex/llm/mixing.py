"""Mixing sources to target weights.

Shares come from temperature mixing: sources share ~ t^(1 - x) * w^x between their natural token share t and their weight
w, one exponent x for all sources of a mix. x is bisected from natural shares towards the weights until a source meets
its repetition limit; that source stays at its limit and the exponent of the others is raised further, until they reach
their weights. The end is the mix nearest to the weights (in relative entropy) that no limit forbids. Shares are then
realised as budgeted block permutations: whole passes over a source, then a pass over the head of a pseudo-random order
of its records, found by two levels of running sums (blocks, then records of a block), so no source is ever sorted in one
task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.tokens import VOCABULARY, token_count
from veridex.session import Stage

BLOCK_TOKENS = 200_000
MOST_BLOCKS = 20_000


def bisect(rises, low: float = 0.0, high: float = 1.0, turns: int = 60) -> float:
    """Largest x in [low, high] for which rises(x) is not above 0."""
    for _ in range(turns):
        middle = (low + high) / 2
        low, high = (middle, high) if rises(middle) <= 0 else (low, middle)
    return low


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def temperature_for_entropy(tokens: list[float], goal: float) -> float:
    """Exponent a of shares ~ tokens^a whose entropy is ``goal``: 1 is natural, 0 is even, bisected in between and up to 8."""

    def shares(a: float) -> list[float]:
        raw = [math.exp(a * math.log(t)) if t > 0 else 0.0 for t in tokens]
        return [x / sum(raw) for x in raw]

    return bisect(lambda a: goal - entropy(shares(a)), 0.0, 8.0)


def tempered(natural: list[float], want: list[float], free: list[int], mass: float, x: float) -> dict[int, float]:
    """Shares ~ natural^(1 - x) * want^x of the free sources, together ``mass``; sources without tokens or weight have 0."""
    raw = {i: math.exp((1 - x) * math.log(natural[i]) + x * math.log(want[i])) if natural[i] > 0 and want[i] > 0 else 0.0 for i in free}
    total = sum(raw.values())
    return {i: mass * v / total if total > 0 else 0.0 for i, v in raw.items()}


def temper(tokens: list[float], weights: list[float], repeats: list[int], size: float) -> tuple[list[float], list[float]]:
    """(shares, exponents) of the sources of one mix.

    An exponent is the x at which a source met its limit, 1 where it reaches its weight, 0 where its natural share already
    breaks the limit. Shares sum to less than 1 only if all sources at their limits can't fill the mix.
    """
    total = sum(weights)
    if total <= 0 or size <= 0:
        return [0.0] * len(weights), [1.0] * len(weights)
    want = [w / total for w in weights]
    whole = sum(tokens)
    natural = [t / whole if whole > 0 else 0.0 for t in tokens]
    limit = [r * t / size for r, t in zip(repeats, tokens, strict=True)]
    held: dict[int, tuple[float, float]] = {i: (0.0, 0.0) for i in range(len(want)) if natural[i] <= 0 or want[i] <= 0}
    x = 0.0
    while True:
        free = [i for i in range(len(want)) if i not in held]
        mass = max(0.0, 1 - sum(p for p, _ in held.values()))
        share = lambda v, free=free, mass=mass: tempered(natural, want, free, mass, v)
        over = [i for i, p in share(1.0).items() if p > limit[i] * (1 + 1e-12)]
        if not over:
            break
        # only a source whose weight itself breaks its limit is held; the others reach their weights at the end
        excess = lambda v, share=share, over=over: max(share(v)[i] - limit[i] * (1 + 1e-12) for i in over)
        x = bisect(excess, x, 1.0) if excess(x) <= 0 else x
        now = share(x)
        # the bisected point lies just under the limit of the source that breaks it next
        for i in [i for i in over if now[i] >= limit[i] * (1 - 1e-9)] or [max(over, key=lambda i: now[i] - limit[i])]:
            held[i] = (limit[i], x)
    last = share(1.0)
    return [held[i][0] if i in held else last[i] for i in range(len(want))], [held[i][1] if i in held else 1.0 for i in range(len(want))]


_PLAN = "mix string, source string, wanted_share double, planned_share double, exponent double, mix_temperature double, tokens double, n_documents long, budget double, max_repeats int"


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Shares of one mix; a row per source of the mix, so the group is as small as source_mix."""
    pdf = pdf.sort_values("source")
    size = float(pdf["size_factor"].iloc[0] * pdf["all_tokens"].iloc[0])
    tokens, weights = pdf["tokens"].tolist(), pdf["weight"].tolist()
    shares, exponents = temper(tokens, weights, pdf["max_repeats"].tolist(), size)
    total = sum(weights)
    own = [p / sum(shares) for p in shares] if sum(shares) > 0 else shares
    heat = temperature_for_entropy(tokens, entropy(own)) if sum(tokens) > 0 else 1.0
    return pd.DataFrame(
        {
            "mix": pdf["mix"], "source": pdf["source"], "wanted_share": [w / total if total > 0 else 0.0 for w in weights], "planned_share": shares, "exponent": exponents, "mix_temperature": heat,
            "tokens": tokens, "n_documents": pdf["n_documents"], "budget": [p * size for p in shares], "max_repeats": pdf["max_repeats"],
        }
    )


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), written once because every later step reads it."""
    return Stage(documents.sparkSession, "sizes").write(documents.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")))


def plans(sizes: DataFrame, mixes: DataFrame) -> DataFrame:
    """Planned shares and token budgets per mix and source.

    Null weights, factors or limits count as 0; a repeated source of a mix keeps its largest weight. The size of a mix
    is size_factor times the tokens of all documents. Sources without records plan a share of 0.
    """
    per = sizes.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("n_documents"))
    everything = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("all_tokens"))
    asked = mixes.where("mix is not null and source is not null").groupBy("mix", "source").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("weight", "max_repeats", "size_factor")])
    rows = asked.join(per, "source", "left").fillna({"tokens": 0.0, "n_documents": 0}).crossJoin(F.broadcast(everything))
    return rows.groupBy("mix").applyInPandas(_plan, _PLAN)


def realise(sizes: DataFrame, planned: DataFrame, seed: int = 42) -> DataFrame:
    """(mix, doc_id, source, times, tokens): how often each document of a mix's sources is used, 0 included.

    Every record of a source is used floor(budget / tokens of the source) times, then those at the head of the mix's own
    permutation once more until the rest of the budget is spent; the record that crosses the budget is used if at least
    half of it fits. No record exceeds max_repeats. Records without tokens are not used.
    """
    cells = sizes.where("doc_id is not null and source is not null").join(F.broadcast(planned.select("mix", "source", "budget", F.col("tokens").alias("source_tokens"), "max_repeats")), "source")
    passes = F.when(F.col("source_tokens") > 0, F.least(F.floor(F.col("budget") / F.col("source_tokens") + 1e-9), F.col("max_repeats").cast("long"))).otherwise(F.lit(0))
    cells = cells.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_tokens"))
    order = F.xxhash64("mix", "source", "doc_id", F.lit(seed))
    # blocks grow rather than multiply beyond MOST_BLOCKS, so that the running sum over a source's blocks stays short
    blocks = F.greatest(F.lit(1), F.least(F.ceil(F.col("source_tokens") / F.lit(float(BLOCK_TOKENS))).cast("long"), F.lit(MOST_BLOCKS)))
    cells = cells.withColumn("o", order).withColumn("block", F.floor((F.col("o").cast("double") / F.lit(2.0**64) + 0.5) * blocks).cast("long"))
    cells = Stage(sizes.sparkSession, "mix").write(cells)
    per_block = cells.groupBy("mix", "source", "block").agg(F.sum("tokens").alias("block_tokens"))
    before = Window.partitionBy("mix", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("before", F.coalesce(F.sum("block_tokens").over(before), F.lit(0))).drop("block_tokens")
    inside = Window.partitionBy("mix", "source", "block").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(per_block, ["mix", "source", "block"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    more = (F.col("passes") < F.col("max_repeats")) & (F.col("ahead") + F.col("tokens") / 2 <= F.col("rest"))
    times = F.when(F.col("tokens") > 0, F.col("passes") + more.cast("long")).otherwise(F.lit(0)).cast("int")
    return placed.select("mix", "doc_id", "source", times.alias("times"), "tokens")


def mix(documents: DataFrame, mixes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Use counts per mix and document; empty documents or mixes give an empty frame."""
    sizes = sized(documents, vocabulary)
    return realise(sizes, plans(sizes, mixes))


def shares(documents: DataFrame, mixes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per mix and source: wanted, planned and actual share of the mix's tokens, its size, and the most uses of a record."""
    sizes = sized(documents, vocabulary)
    planned = Stage(documents.sparkSession, "plans").write(plans(sizes, mixes))
    used = realise(sizes, planned).groupBy("mix", "source").agg(F.sum(F.col("times") * F.col("tokens")).alias("used_tokens"), F.max("times").alias("most_uses"))
    rows = planned.join(used, ["mix", "source"], "left").fillna({"used_tokens": 0, "most_uses": 0})
    total = F.sum("used_tokens").over(Window.partitionBy("mix"))
    return rows.select(
        "mix", "source", F.round("wanted_share", 6).alias("wanted_share"), F.round("planned_share", 6).alias("planned_share"), F.round(F.try_divide(F.col("used_tokens"), total), 6).alias("actual_share"),
        "used_tokens", F.round("budget").cast("long").alias("budget_tokens"), "most_uses", F.round("exponent", 6).alias("exponent"), F.round("mix_temperature", 6).alias("mix_temperature"),
    )
