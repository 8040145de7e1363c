"""Splits that keep related records together.

Records and registry questions are linked through shared keys; connected components come from alternating
large-star / small-star rounds, each a grouped minimum and a join, so a key that a third of all rows share is only a
star. A component search then assigns whole components to splits: hashed start, moves and swaps of components under
simulated annealing in many bounded blocks and chains at once, the best chain of a block kept, a few rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.keys import key, squeezed
from veridex.operators.components import connected_components
from veridex.session import Stage

SPLITS = ("train", "validation", "test")
# How the present split names read in terms of split_targets.
PRESENT = {"train": "train", "dev": "validation", "validation": "validation", "blind": "test", "test": "test"}
HEAD_PARTS = 500
BLOCK = 2000
LABEL_CELLS = 64
CHAINS = 4
ROUNDS = 3


def latest_questions(questions: DataFrame) -> DataFrame:
    """Per id the row with the latest updated_at (ties: later ingested_at, then the larger family)."""
    zero = F.timestamp_seconds(F.lit(0))
    last = F.max(F.struct(F.coalesce("updated_at", zero).alias("a"), F.coalesce("ingested_at", zero).alias("b"), F.col("semantic_family_id").alias("f"), F.col("derived_from").alias("d"))).alias("x")
    return questions.where("id is not null").groupBy(squeezed(F.col("id")).alias("id")).agg(last).select("id", F.col("x.f").alias("semantic_family_id"), F.col("x.d").alias("derived_from"))


def record_links(records: DataFrame, questions: DataFrame) -> DataFrame:
    """Star edges (a, b): each record to the smallest record of each of its keys, and child to parent.

    Registry questions without a record carry links between records that have one; unknown parents are just nodes.
    Null, blank and filler keys link nothing.
    """
    last = latest_questions(questions)
    groups = records.select(F.col("id"), key(F.col("question_group_id")).alias("g")).where("id is not null and g is not null").select("id", F.concat(F.lit("g:"), "g").alias("k"))
    families = last.select("id", key(F.col("semantic_family_id")).alias("f")).where("f is not null").select("id", F.concat(F.lit("f:"), "f").alias("k"))
    keyed = groups.union(families).distinct()
    stars = keyed.join(keyed.groupBy("k").agg(F.min("id").alias("b")), "k").select(F.col("id").alias("a"), "b")
    parents = last.select(F.col("id").alias("a"), F.explode("derived_from").alias("p")).select("a", key(F.col("p")).alias("b")).where("b is not null")
    return stars.union(parents).where("a <> b")


def components(records: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, component): component is the smallest record id of its set; lone records are their own component."""
    own = records.where("id is not null").select("id").distinct()
    linked = connected_components(record_links(records, questions)).join(own, F.col("node") == F.col("id")).select("id", "root")
    named = linked.groupBy("root").agg(F.min("id").alias("component"))
    return own.join(linked.join(named, "root").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def found(spark, records: DataFrame, questions: DataFrame) -> DataFrame:
    """p3_found: for each set of two or more records, its smallest id with each other member."""
    return components(records, questions).where("component <> id").select(F.col("component").alias("id_a"), F.col("id").alias("id_b"))


def _cost(now: np.ndarray, want: np.ndarray, scale: np.ndarray) -> float:
    return float((np.abs(now - want) * scale).sum())


def _anneal(sizes: np.ndarray, start: np.ndarray, want: np.ndarray, scale: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Moves and swaps of whole components; sizes is components x (1 + labels), want is splits x (1 + labels)."""
    rng = np.random.default_rng(seed)
    at, n_splits = start.copy(), len(want)
    now = np.zeros_like(want)
    np.add.at(now, at, sizes)
    cost = best = _cost(now, want, scale)
    kept, n = at.copy(), len(at)
    heat = max(cost, 1e-9) / 20
    picks, others, dice, kinds, goals = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.random(steps), rng.random(steps), rng.integers(0, n_splits, steps)
    for i in range(steps):
        x, s = picks[i], at[picks[i]]
        if kinds[i] < 0.5:
            y, t = -1, goals[i]
            delta = sizes[x]
        else:
            y = others[i]
            t = at[y]
            delta = sizes[x] - sizes[y]
        if s == t:
            continue
        gone, come = now[s] - delta, now[t] + delta
        new = cost + float(((np.abs(gone - want[s]) - np.abs(now[s] - want[s])) * scale[s]).sum() + ((np.abs(come - want[t]) - np.abs(now[t] - want[t])) * scale[t]).sum())
        if new <= cost or dice[i] < np.exp((cost - new) / heat):
            now[s], now[t], cost = gone, come, new
            at[x] = t
            if y >= 0:
                at[y] = s
            if cost < best - 1e-12:
                best, kept = cost, at.copy()
        heat *= 0.9985
    return kept, best


def assign(records: DataFrame, questions: DataFrame, targets: DataFrame, label: str = "expected_behavior", seed: int = 42) -> DataFrame:
    """(plan, id, component, assigned_split, present_split, parted): one row per plan and distinct record id.

    parted tells that the present splits of the component's members differ. Records whose present split is null or
    another name keep null there and part nothing. Target shares of a plan are normalised; null shares count as 0.
    """
    spark = records.sparkSession
    stage = Stage(spark, "grouping")
    rows = records.where("id is not null").select("id", F.coalesce(squeezed(F.col(label)), F.lit("")).alias("label"), F.create_map(*[F.lit(x) for kv in PRESENT.items() for x in kv])[squeezed(F.col("split"))].alias("present"))
    one = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("present").alias("present_split"))
    members = stage.write(one.join(components(records, questions), "id"))

    # every label is balanced besides size; beyond LABEL_CELLS labels several share a cell by their hash, so rows stay narrow
    labels = members.select("label").distinct()
    n_labels = labels.count()
    if n_labels <= LABEL_CELLS:
        order = {r["label"]: i for i, r in enumerate(labels.orderBy("label").collect())}
        cell = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("label")] if order else F.lit(0)
    else:
        cell = F.pmod(F.xxhash64("label"), F.lit(LABEL_CELLS)).cast("int")
    n_cells = min(n_labels, LABEL_CELLS)
    counts = [F.sum((F.col("cell") == i).cast("double")).alias(f"l{i}") for i in range(n_cells)]
    parts = members.withColumn("cell", cell).groupBy("component").agg(F.count("*").cast("double").alias("n"), *counts)
    cells = ["n", *[f"l{i}" for i in range(n_cells)]]
    total = parts.agg(F.count("*").alias("parts"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cells]).first()
    n_parts, all_sizes = total["parts"], np.array([total[c] for c in cells])
    if not n_parts:
        return members.select(F.lit("").alias("plan"), "id", "component", F.lit("").alias("assigned_split"), "present_split", F.lit(False).alias("parted"))
    n_blocks = max(1, -(-n_parts // BLOCK))

    plans: dict[str, dict[str, float]] = {}
    for r in targets.where("plan is not null and split is not null").groupBy("plan", "split").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share")).collect():
        plans.setdefault(r["plan"], {})[r["split"]] = r["share"]
    wants: dict[str, np.ndarray] = {}
    names: dict[str, list[str]] = {}
    for plan, shares in plans.items():
        names[plan] = sorted(shares, key=lambda s: (-shares[s], s))
        share = np.array([shares[s] for s in names[plan]])
        wants[plan] = np.outer(share / max(share.sum(), 1e-12), all_sizes)
    scale = 1 / np.maximum(all_sizes, 1)
    scale[1:] *= 0.5

    # hashed start: the hash of the component falls into the cumulated shares of the plan
    bounds = [(p, i, float(x)) for p in plans for i, x in enumerate(np.cumsum(wants[p][:, 0]) / all_sizes[0])]
    bound = spark.createDataFrame(pd.DataFrame(bounds, columns=["plan", "i", "upto"]), "plan string, i int, upto double")
    spot = F.pmod(F.xxhash64(F.col("component"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    start = parts.withColumn("spot", spot).crossJoin(F.broadcast(bound.groupBy("plan").agg(F.sort_array(F.collect_list(F.struct("upto", "i"))).alias("steps"))))
    # components above N / HEAD_PARTS are at most HEAD_PARTS; they are settled first, alone, against the whole deviation
    head = F.col("n") >= F.lit(float(all_sizes[0]) / HEAD_PARTS)
    block = F.when(head, F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col("component")), F.lit(n_blocks)).cast("int"))
    chosen = F.coalesce(F.filter("steps", lambda s: s["upto"] > F.col("spot"))[0]["i"], F.lit(0))
    current = stage.write(start.select("plan", "component", *cells, chosen.alias("s"), block.alias("block")))

    def missing(table: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, float]]:
        """What each split of each plan lacks, and the cost of it: one row per plan and split reaches the driver."""
        lack = {p: wants[p].copy() for p in plans}
        for r in table.groupBy("plan", "s").agg(*[F.sum(c).alias(c) for c in cells]).collect():
            lack[r["plan"]][r["s"]] -= np.array([r[c] for c in cells])
        return lack, {p: float((np.abs(x) * scale).sum()) for p, x in lack.items()}

    miss, cost = missing(current)
    for turn in range(ROUNDS):
        # the head is settled first, alone; after it each block mends its share of what is left, so rounds can't overshoot
        whole = turn == 0
        chains = current.where("block = -1" if whole else "block >= 0")
        chains = chains.withColumn("chain", F.explode(F.array(*map(F.lit, range(CHAINS)))))

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            plan, where, chain = pdf["plan"].iloc[0], int(pdf["block"].iloc[0]), int(pdf["chain"].iloc[0])
            pdf = pdf.sort_values("component")
            sizes, at = pdf[cells].to_numpy(float), pdf["s"].to_numpy(int)
            now = np.zeros_like(miss[plan])
            np.add.at(now, at, sizes)
            want = now + miss[plan] * (1.0 if whole else 1.0 / n_blocks)
            kept, cost = _anneal(sizes, at, want, np.tile(scale, (len(want), 1)), seed + 31 * chain + 7919 * turn + where, 4000)
            return pd.DataFrame({"plan": plan, "block": where, "chain": chain, "component": pdf["component"].to_numpy(), "t": kept, "cost": cost})

        tried = stage.write(chains.groupBy("plan", "block", "chain").applyInPandas(search, "plan string, block int, chain int, component string, t int, cost double"))
        best = tried.groupBy("plan", "block").agg(F.min(F.struct("cost", "chain")).alias("x")).select("plan", "block", F.col("x.chain").alias("chain"))
        moved = tried.join(best, ["plan", "block", "chain"]).select("plan", "component", "t")
        after = stage.write(current.join(moved, ["plan", "component"], "left").select("plan", "component", *cells, F.coalesce("t", "s").alias("s"), F.col("s").alias("was"), "block"))
        now_miss, now_cost = missing(after)
        # a plan keeps its best round
        worse = [p for p in plans if now_cost[p] > cost[p]]
        kept_at = F.when(F.col("plan").isin(*worse), F.col("was")).otherwise(F.col("s")) if worse else F.col("s")
        before, current = current, stage.write(after.select("plan", "component", *cells, kept_at.alias("s"), "block"))
        miss = {p: miss[p] if p in worse else now_miss[p] for p in plans}
        cost = {p: cost[p] if p in worse else now_cost[p] for p in plans}
        stage.drop(before, after, tried)

    split_names = spark.createDataFrame(pd.DataFrame([(p, i, s) for p in plans for i, s in enumerate(names[p])], columns=["plan", "s", "assigned_split"]), "plan string, s int, assigned_split string")
    placed = current.join(F.broadcast(split_names), ["plan", "s"]).select("plan", "component", "assigned_split")
    parted = members.groupBy("component").agg((F.min("present_split") != F.max("present_split")).alias("parted"))
    return members.join(parted, "component").join(placed, "component").select("plan", "id", "component", "assigned_split", "present_split", F.coalesce("parted", F.lit(False)).alias("parted"))


def balance(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan and split: records, actual and target share, and components that the present split parts."""
    per = assigned.groupBy("plan", F.col("assigned_split").alias("split")).agg(F.count("*").alias("n_records"), F.countDistinct(F.when(F.col("parted"), F.col("component"))).alias("n_parted_now"))
    total = F.sum("n_records").over(Window.partitionBy("plan"))
    share = targets.groupBy("plan", "split").agg(F.max("target_share").alias("target_share"))
    return per.withColumn("actual_share", F.round(F.col("n_records") / total, 6)).join(F.broadcast(share), ["plan", "split"], "left")
