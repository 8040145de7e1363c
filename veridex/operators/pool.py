"""Candidate pools: versions, identity conflicts, duplicates, independent sources, reranking and selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions import vocabulary as V
from veridex.functions.identity import evidence_role
from veridex.functions.text import normalize, text_hash, tokenize
from veridex.functions.vector import clamp
from veridex.operators.retrieval import DIGITS, ranked


def conflicts(aliases: DataFrame) -> DataFrame:
    """(identity) of documents with two different values of one kind, from (identity, kind, value)."""
    return aliases.where("identity is not null and value is not null").groupBy("identity", "kind").agg((F.min("value") != F.max("value")).alias("several")).where("several").select("identity").distinct()


def preserve_sources(rows: DataFrame, conflicted: DataFrame | None = None) -> DataFrame:
    """Decision per row of (q, id, identity, text, source, score): identity_conflict, duplicate_id, duplicate_text or retained.

    Rows of one id with several identities, or of a conflicted document, are set aside whole. Of an id's versions the
    best stays, of equal texts of one document the best stays. Exact ties fall to the order of identity, text, source.
    """
    by_id = Window.partitionBy("q", "id")
    marked = rows.withColumn("hash", text_hash(F.col("text"))).withColumn("split", F.min("identity").over(by_id) != F.max("identity").over(by_id))
    if conflicted is not None:
        marked = marked.join(conflicted.select("identity", F.lit(True).alias("bad")), "identity", "left").withColumn("split", F.col("split") | F.coalesce(F.max("bad").over(by_id), F.lit(False))).drop("bad")
    order = [F.desc("score"), F.asc("identity"), F.asc("hash"), F.asc("source"), F.asc("id")]
    best = marked.withColumn("version", F.row_number().over(Window.partitionBy("q", "id", "split").orderBy(*order)))
    stands = (~F.col("split")) & (F.col("version") == 1)
    same = Window.partitionBy("q", "identity", "hash", stands).orderBy(*order)
    turned = best.withColumn("copy", F.row_number().over(same)).withColumn("survivor", F.first("id").over(same))
    reason = F.when(F.col("split"), "identity_conflict").when(F.col("version") > 1, "duplicate_id").when(F.col("copy") > 1, "duplicate_text").otherwise("retained")
    survivor = F.when(F.col("split"), F.lit(None)).when(F.col("version") > 1, F.col("id")).otherwise(F.col("survivor"))
    return turned.select("q", "id", "identity", "source", "score", reason.alias("reason"), survivor.alias("survivor"))


def legacy_pool(rows: DataFrame, prefix: int = 600, cap: int = 2) -> DataFrame:
    """Decision per row of (q, id, family, text, source, score, pos): first text prefix, best score of an id, family cap."""
    text = F.substring(normalize(F.col("text")), 1, prefix)
    first = rows.withColumn("seen", F.row_number().over(Window.partitionBy("q", text).orderBy("pos", "id")))
    fresh = F.col("seen") == 1
    by_id = Window.partitionBy("q", "id", fresh).orderBy(F.desc("score"), F.asc("pos"))
    chosen = first.withColumn("version", F.row_number().over(by_id))
    stands = fresh & (F.col("version") == 1)
    order = [F.desc((F.col("source") == "knowledge_page").cast("int")), F.desc("score"), F.desc(F.length("text")), F.asc("pos"), F.asc("id")]
    capped = chosen.withColumn("turn", F.row_number().over(Window.partitionBy("q", "family", stands).orderBy(*order)))
    reason = F.when(~fresh, "text_prefix").when(F.col("version") > 1, "duplicate_id").when(F.col("turn") > cap, "family_cap").otherwise("retained")
    return capped.select("q", "id", "family", "source", "score", reason.alias("reason"))


def rerank(parts: DataFrame, top_k: int = 8) -> DataFrame:
    """(q, id, rank, score, role) of (q, id, bm25, cosine, retrieval, source, level): weighted blend with priors, 0..1."""
    prior = F.coalesce(F.create_map(*[F.lit(x) for kv in V.EVIDENCE_PRIOR.items() for x in kv])[F.col("level")], F.lit(0.0))
    page = F.when(F.col("source") == "knowledge_page", V.PAGE_PRIOR).otherwise(0.0)
    x, y, z = V.RERANK_BLEND
    scored = parts.withColumn("score", F.round(clamp(x * F.col("bm25") + y * F.col("cosine") + z * F.col("retrieval") + page + prior), DIGITS)).withColumn("role", evidence_role(F.coalesce("level", F.lit("Other")), V.OVERVIEW_LEVELS))
    return ranked(scored, top_k, F.desc("score"), F.asc("id"))


def document_diverse(entries: DataFrame, top_k: int = 8, per_family: int = 2) -> DataFrame:
    """(q, id, citation_number): one row per document and at most two per family, in order of score.

    An entry refused by the family cap does not use up its document, so this is a fold over the ordered entries of one
    question, which are a bounded pool.
    """
    item = F.struct((-F.col("score")).alias("o"), F.col("identity").alias("doc"), F.col("id").alias("id"), F.coalesce("family", F.lit("")).alias("family"))
    pool = entries.groupBy("q").agg(F.sort_array(F.collect_list(item)).alias("pool"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("ids"), none.alias("docs"), none.alias("families"))

    def add(acc: Column, x: Column) -> Column:
        used = F.size(F.filter(acc["families"], lambda f: (f == x["family"]) & (f != "")))
        fits = (F.size(acc["ids"]) < top_k) & ~F.array_contains(acc["docs"], x["doc"]) & (used < per_family)
        more = lambda old, value: F.when(fits, F.concat(old, F.array(value.cast("string")))).otherwise(old)
        return F.struct(more(acc["ids"], x["id"]).alias("ids"), more(acc["docs"], x["doc"]).alias("docs"), more(acc["families"], x["family"]).alias("families"))

    picked = pool.select("q", F.aggregate("pool", start, add)["ids"].alias("ids"))
    return picked.select("q", F.posexplode("ids").alias("at", "id")).select("q", "id", (F.col("at") + 1).alias("citation_number"))


def packet(entries: DataFrame, most: int = 5) -> DataFrame:
    """(q, id, citation_number): one entry per role first, then by score less redundancy, unseen families before others.

    ``entries`` are the numbered top entries of a question (q, id, citation_number, role, family, score, text), a few rows.
    """
    reward, toll = V.MMR_BLEND
    rows = entries.withColumn("tokens", F.array_distinct(tokenize(F.col("text"))))

    def overlap(a: set, b: set) -> float:
        return max(len(a & b) / len(a), len(a & b) / len(b)) if a and b else 0.0

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("citation_number").reset_index(drop=True)
        if len(pdf) > most:
            words = [set(x) for x in pdf["tokens"]]
            chosen: list[int] = []
            families: set[str] = set()
            for role in ("overview", "causal", "boundary"):
                for i in range(len(pdf)):
                    if i not in chosen and pdf["role"][i] == role and pdf["family"][i] not in families:
                        chosen.append(i)
                        families.add(pdf["family"][i])
                        break
            while len(chosen) < most:
                left = [i for i in range(len(pdf)) if i not in chosen]
                fresh = [i for i in left if pdf["family"][i] not in families] or left
                best = max(fresh, key=lambda i: (reward * pdf["score"][i] - toll * max((overlap(words[i], words[j]) for j in chosen), default=0.0), -i))
                chosen.append(best)
                families.add(pdf["family"][best])
            pdf = pdf.loc[sorted(chosen)]
        return pdf[["q", "id", "citation_number"]]

    kinds = dict(rows.dtypes)
    return rows.select("q", "id", "citation_number", "role", "family", "score", "tokens").groupBy("q").applyInPandas(choose, f"q {kinds['q']}, id {kinds['id']}, citation_number int")
