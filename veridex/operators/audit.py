"""Corpus and asset audit: distributions, gates, orphans, set differences, leakage, lineage, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.session import Stage


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column; nulls and blanks read as '' and count."""
    value = F.coalesce(F.trim(F.col(column)), F.lit(""))
    counted = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return counted.crossJoin(total).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose key no parent has; a null key is an orphan."""
    return children.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def two_way_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): distinct rows of a that b lacks, and of b that a lacks."""
    left = a.subtract(b).agg(F.lit("left").alias("side"), F.count("*").alias("n"))
    return left.unionByName(b.subtract(a).agg(F.lit("right").alias("side"), F.count("*").alias("n")))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, distinct_rows hashed): keys that stand on more than one row."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shared_across(rows: DataFrame, key: Column, split: Column) -> DataFrame:
    """(key, n_rows, splits): keys whose rows stand in more than one split; null keys or splits take no part."""
    named = rows.select(key.alias("key"), split.alias("split")).where("key is not null and split is not null")
    per = named.groupBy("key", "split").agg(F.count("*").alias("n"))
    return per.groupBy("key").agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def ancestors(links: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor, distance) of (id, parent): the closure of parents with the shortest distance.

    A record that is its own ancestor is a cycle and keeps that row. Rounds end when no new pair appears, so the closure is
    whole however long a chain is; a ``depth`` asks for the ancestors of so many generations only. Each round writes its
    new pairs once.
    """
    stage = Stage(links.sparkSession, "ancestors")
    edges = stage.write(links.where("id is not null and parent is not null").select("id", "parent").distinct())
    front = known = stage.write(edges.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    step = 1
    while (depth is None or step < depth) and not front.isEmpty():
        step += 1
        further = front.select("id", F.col("ancestor").alias("via")).join(edges.select(F.col("id").alias("via"), F.col("parent").alias("ancestor")), "via")
        front = stage.write(further.select("id", "ancestor").distinct().join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti").withColumn("distance", F.lit(step)))
        known = known.unionByName(front)
    return known


def issues(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(code, n, first_key): rows that break each rule; a rule is a condition that holds for bad rows, null is fine."""
    flags = rows.select(F.col(key).cast("string").alias("k"), F.explode(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()])).alias("code"))
    return flags.where("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


def conflicting_groups(rows: DataFrame, key: Column, split: Column, group: Column) -> DataFrame:
    """(key, split, n_groups): equal content in one split under several groups; nulls take no part."""
    named = rows.select(key.alias("key"), split.alias("split"), group.alias("g")).where("key is not null and split is not null and g is not null").distinct()
    return named.groupBy("key", "split").agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def derived_leakage(closure: DataFrame, splits: DataFrame) -> DataFrame:
    """(id, ancestor, split, ancestor_split) of (id, ancestor) pairs whose records stand in different splits of (id, split)."""
    own = splits.where("id is not null and split is not null").groupBy("id").agg(F.min("split").alias("split"))
    far = own.select(F.col("id").alias("ancestor"), F.col("split").alias("ancestor_split"))
    return closure.select("id", "ancestor").distinct().join(own, "id").join(far, "ancestor").where("split <> ancestor_split")
