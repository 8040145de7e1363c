"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.session import Stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node of the component.

    Null ends and self loops link nothing; repeated edges count once; an empty list gives an empty frame. A round is two
    grouped minima and joins; rounds end when the edges stop changing, by their count and a hash of all of them.
    """
    stage = Stage(edges.sparkSession, "components")
    pair = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    current = stage.write(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stage.write(linked)
        sums = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        stage.drop(current)
        current = after
        if (sums["n"], sums["x"]) == state:
            break
        state = (sums["n"], sums["x"])
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def source_keys(source: Column, identity: Column, family: Column, aliases: Column | None = None) -> Column:
    """Keys that link an entry to others of the same study: its document, its reliable family, its aliases.

    A page links nothing by its own identity; an entry without a reliable family has no keys and counts as no source.
    """
    none = F.array().cast("array<string>")
    known = F.coalesce(family, F.lit("")) != ""
    own = F.when(source == "knowledge_page", none).otherwise(F.array(F.concat(F.lit("document/"), identity)))
    others = F.transform(F.coalesce(aliases, none), lambda a: F.concat(F.lit("family/"), a)) if aliases is not None else none
    return F.when(known, F.concat(own, F.array(F.concat(F.lit("family/"), family)), others)).otherwise(none)


def independent_count(keys: Column) -> Column:
    """Components among the key arrays of a few entries, merged one by one where they share a key; for bounded packets."""
    start = F.array().cast("array<array<string>>")

    def merge(acc: Column, x: Column) -> Column:
        touching = F.filter(acc, lambda c: F.arrays_overlap(c, x))
        apart = F.filter(acc, lambda c: ~F.arrays_overlap(c, x))
        return F.when(F.size(x) == 0, acc).otherwise(F.concat(apart, F.array(F.array_distinct(F.concat(F.flatten(touching), x)))))

    return F.size(F.aggregate(keys, start, merge))


def independent_sources(links: DataFrame) -> DataFrame:
    """(q, n_sources): components of (q, item, key) per question; items without a key count alone, null items not at all."""
    named = links.where("q is not null and item is not null").select("q", F.concat_ws("\x1f", "q", F.lit("i"), "item").alias("i"), F.when(F.col("key").isNotNull(), F.concat_ws("\x1f", "q", F.lit("k"), "key")).alias("k"))
    roots = connected_components(named, "i", "k")
    owned = named.select("q", "i").distinct().join(roots, F.col("i") == F.col("node"), "left").select("q", F.coalesce("root", "i").alias("root"))
    return owned.distinct().groupBy("q").agg(F.count("*").alias("n_sources"))
