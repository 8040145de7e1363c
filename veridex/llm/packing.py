"""Filling fixed-capacity containers with items by bin completion.

Items are dealt into blocks of bounded token mass by a hash, so a block is a fair sample of all sizes. A block's first
incumbent is its best-fit decreasing packing. Branch and bound then completes one container after the other: around the
largest item left, the fillings of least waste that no other filling dominates are the branches, the least waste first; a
node is cut when its containers and the lower bound of what is left reach the incumbent, and the search ends when the
incumbent meets the lower bound of the block. Containers that stay under the fill goal are opened again and packed across
blocks in a second pass. Items above the capacity are cut into full pieces and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.mixing import sized
from veridex.llm.tokens import VOCABULARY
from veridex.session import Stage

BLOCK_CONTAINERS = 400
FILL_NODES = 600  # items tried per container
BRANCHES = 3  # fillings tried per container
TREE_NODES = 2_000  # containers completed per block, beyond its first complete packing
GOAL = 0.995


def dominated(sizes: list[int], counts: list[int], taken: list[int], slack: int) -> bool:
    """Whether an unused item can stand for one or two items of a filling and fit: such a filling is never better.

    The swapped-out items then fit wherever the larger one went (dominance of feasible sets, for sets of one and two).
    """
    parts = sorted(set(taken))
    sums = {sizes[i] for i in parts}
    head = parts[:8]  # pairs of the smallest parts; more pairs would only cut more
    sums |= {sizes[i] + sizes[j] for x, i in enumerate(head) for j in head[x:] if i != j or taken.count(i) > 1}
    for total in sums:
        # equal size changes nothing for a single item, so it must be larger; a pair may be replaced by its exact sum
        at = bisect_right(sizes, total) if total in {sizes[i] for i in parts} else bisect_left(sizes, total)
        while at < len(sizes) and sizes[at] <= total + slack:
            if counts[at] > 0:
                return True
            at += 1
    return False


def completions(sizes: list[int], counts: list[int], room: int, branches: int = BRANCHES, nodes: int = FILL_NODES) -> list[tuple[int, list[int]]]:
    """(waste, indices into sizes) of the undominated fillings of ``room`` with the least waste, at most ``branches``.

    Depth first from large to small, so the first one is the greedy filling. A branch is cut by the waste bound: when
    even all smaller items together leave more waste than the worst filling kept. Ends at ``nodes`` items tried or
    when a filling without waste is found. ``counts`` is the same afterwards.
    """
    mass = [0]
    for size, count in zip(sizes, counts, strict=True):
        mass.append(mass[-1] + size * count)
    kept: list[tuple[int, list[int]]] = []
    seen: set[tuple[int, ...]] = set()
    taken: list[int] = []
    rest, at = room, len(sizes) - 1
    while True:
        at = min(at, bisect_right(sizes, rest) - 1)
        while at >= 0 and counts[at] == 0:
            at -= 1
        worst = kept[-1][0] if len(kept) >= branches else room + 1
        if at >= 0 and rest - mass[at + 1] < worst and nodes > 0:
            nodes -= 1
            counts[at] -= 1
            taken.append(at)
            rest -= sizes[at]
            continue
        if rest < worst and tuple(taken) not in seen and (not kept or not dominated(sizes, counts, taken, rest)):
            seen.add(tuple(taken))
            kept.append((rest, taken.copy()))
            kept.sort(key=lambda x: x[0])
            del kept[branches:]
            if rest == 0:
                break
        if not taken or nodes <= 0:
            break
        at = taken.pop()
        counts[at] += 1
        rest += sizes[at]
        at -= 1
    for i in taken:
        counts[i] += 1
    return kept


def best_fit(sizes: list[int], counts: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every item, large to small, goes where the least room is left."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(counts[i]):
            at = bisect_left(rooms, (sizes[i], -1))
            if at == len(rooms):
                bins.append([i])
                insort(rooms, (capacity - sizes[i], len(bins) - 1))
            else:
                room, b = rooms.pop(at)
                bins[b].append(i)
                insort(rooms, (room - sizes[i], b))
    return bins


def least_needed(sizes: list[int], counts: list[int], capacity: int) -> int:
    """Lower bound on containers: by total size, and by items of more than half a container, which never share one."""
    mass = sum(s * c for s, c in zip(sizes, counts, strict=True))
    return max(-(-mass // capacity), sum(counts[bisect_right(sizes, capacity // 2) :]))


def bin_completion(sizes: list[int], counts: list[int], capacity: int, nodes: int = TREE_NODES) -> list[list[int]]:
    """Containers as lists of indices into sizes (ascending, distinct), by branch and bound over completed containers.

    ``nodes`` bounds the completions after the first dive; what stands then is the incumbent. The first dive replaces an
    equal best-fit packing, as its unused space lies together in the last containers, where other blocks can use it.
    """
    counts = counts.copy()
    best = best_fit(sizes, counts, capacity)
    least = least_needed(sizes, counts, capacity)
    mass = sum(s * c for s, c in zip(sizes, counts, strict=True))
    # one level per container of the path: its fillings not tried yet, and the one that is in place
    path: list[tuple[list[list[int]], list[int]]] = []
    dived = False

    def put(filling: list[int], sign: int) -> None:
        nonlocal mass
        for i in filling:
            counts[i] -= sign
            mass -= sign * sizes[i]

    while len(best) > least or not dived:
        if mass and len(path) + -(-mass // capacity) < len(best) + (not dived) and (nodes > 0 or not dived):
            nodes -= dived
            top = max(i for i in range(len(sizes)) if counts[i]) if len(sizes) <= 64 else next(i for i in range(len(sizes) - 1, -1, -1) if counts[i])
            counts[top] -= 1
            # the last alternative is tried last, so the list is a stack
            options = [[top, *f] for _, f in completions(sizes, counts, capacity - sizes[top])][::-1] or [[top]]
            counts[top] += 1
            filling = options.pop()
            put(filling, 1)
            path.append((options, filling))
            continue
        if not mass and len(path) < len(best) + (not dived):
            best = [f for _, f in path]
        dived = True
        if nodes <= 0:
            break
        while path:  # back to the deepest container with another filling
            options, filling = path.pop()
            put(filling, -1)
            if options:
                filling = options.pop()
                put(filling, 1)
                path.append((options, filling))
                break
        if not path:
            break
    return best


def pack(items: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Containers, as lists of item keys, for (key, size) with 0 < size <= capacity."""
    by_size: dict[int, list[int]] = {}
    for key, size in sorted(items, key=lambda x: (x[1], x[0]), reverse=True):
        by_size.setdefault(size, []).append(key)
    sizes = sorted(by_size)
    return [[by_size[sizes[i]].pop() for i in inside] for inside in bin_completion(sizes, [len(by_size[s]) for s in sizes], capacity)]


_PACKED = "container_kind string, block long, bin int, doc_id long, piece int, size int, capacity int"


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"]).reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    bins = pack(list(enumerate(pdf["size"].tolist())), capacity)
    at = [0] * len(pdf)
    for b, keys in enumerate(bins):
        for k in keys:
            at[k] = b
    return pdf.assign(bin=at)[["container_kind", "block", "bin", "doc_id", "piece", "size", "capacity"]]


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity, doc_id, piece, size): one row per item and kind, several where it exceeds the capacity.

    Piece sizes are the capacity and a rest. Documents without tokens need no container and have no row; container kinds
    with a null or non-positive capacity hold nothing.
    """
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    rows = sizes.where("doc_id is not null and tokens > 0").crossJoin(F.broadcast(kinds))
    parts = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "container_kind", "capacity", "doc_id", "piece", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity").cast("long")).cast("int").alias("size")
    )


def _blocks(items: DataFrame, mass: DataFrame, seed: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col("mass") / (F.col("capacity") * F.lit(float(BLOCK_CONTAINERS)))).cast("long"))
    return items.join(F.broadcast(mass), "container_kind").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), n)).drop("mass")


def fill_containers(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, size, capacity, unused): the container of every document or piece.

    Repeated doc_ids with different texts are distinct pieces only if their rows differ in size; exact repeats collapse.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "containers")
    items = stage.write(pieces(sized(documents, vocabulary).groupBy("doc_id").agg(F.max("tokens").alias("tokens")), containers))
    mass = items.groupBy("container_kind").agg(F.sum("size").cast("double").alias("mass"))
    full = items.where("size = capacity").select("container_kind", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("bin"), "doc_id", "piece", "size", "capacity")
    loose = _blocks(items.where("size < capacity"), mass, 1).select("container_kind", "capacity", "doc_id", "piece", "size", "block")
    first = stage.write(loose.groupBy("container_kind", "block").applyInPandas(_pack_block, _PACKED))
    load = first.groupBy("container_kind", "block", "bin", "capacity").agg(F.sum("size").alias("load"))
    # containers under the goal are few per block (the tail of its search); their items are packed again across blocks
    poor = load.where(F.col("load") < F.col("capacity") * F.lit(GOAL)).select("container_kind", "block", "bin")
    again = first.join(poor, ["container_kind", "block", "bin"], "left_semi").select("container_kind", "capacity", "doc_id", "piece", "size")
    again = stage.write(again)
    second = _blocks(again, again.groupBy("container_kind").agg(F.sum("size").cast("double").alias("mass")), 2).select("container_kind", "capacity", "doc_id", "piece", "size", "block")
    repacked = second.groupBy("container_kind", "block").applyInPandas(_pack_block, _PACKED)
    named = [
        full.withColumn("container_id", F.concat_ws("-", F.lit("w"), "doc_id", "piece")),
        first.join(poor, ["container_kind", "block", "bin"], "left_anti").withColumn("container_id", F.concat_ws("-", F.lit("a"), "block", "bin")),
        repacked.withColumn("container_id", F.concat_ws("-", F.lit("b"), "block", "bin")),
    ]
    placed = stage.write(named[0].unionByName(named[1]).unionByName(named[2]))
    stage.drop(items, first, again)
    used = placed.groupBy("container_kind", "container_id").agg(F.sum("size").alias("used"))
    return placed.join(used, ["container_kind", "container_id"]).select("container_kind", "container_id", "doc_id", "piece", "size", "capacity", (F.col("capacity") - F.col("used")).cast("int").alias("unused"))


def waste(filled: DataFrame) -> DataFrame:
    """Per kind: containers used, the lower bound (total size over capacity), and the share of unused space."""
    per = filled.groupBy("container_kind", "container_id", "capacity").agg(F.sum("size").alias("used"))
    return per.groupBy("container_kind", "capacity").agg(
        F.count("*").alias("n_containers"),
        F.ceil(F.sum("used") / F.col("capacity")).alias("least_containers"),
        F.round(1 - F.sum("used") / (F.count("*") * F.col("capacity")), 6).alias("unused_share"),
    )
