"""Texts cut off by field limits or in transfer.

Per source a right-censored log-normal length model is fitted by maximum likelihood on the histogram of lengths: a share
of the texts is subject to each candidate limit, the rest is free (EM with truncated-normal moments). The censoring
posterior of a length is the prior that a text of this length is cut. How cut and whole texts end is learned from it: the
texts that the lengths call cut give the first picture of cut endings, and EM over counts of (posterior, ending) refines
it together with the share of texts cut in transfer, whose lengths tell nothing. Every text is then judged by Bayes' rule
from its own censoring posterior and its ending.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm.confusable import TWIN, fold
from veridex.session import Stage

# Signs of a cut that feeds append, and how whole texts may end without a sentence mark.
MARK = r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\((?:truncated|cut|more|continued)\)|<truncated>|\[truncated\])\s*$"
BULLET = r"^\s*(?:[-•*·‣◦–]|\d{1,3}[.)])\s+"
UNITS = r"(?:mg|g|kg|µg|mcg|ml|l|mmol|mmHg|%|IU|h|min|d)"
WINDOW = 3
CHANCE = 1e-4
ENDINGS = ("marked", "broken", "terminal", "digit_dot", "reference", "identifier", "registration", "keywords", "keywords_odd", "signature", "list_item", "list_odd", "title", "title_cut", "open")
# What each ending is believed to be before any text is seen, worth BELIEF_TEXTS texts; the data outweigh it. CERTAIN ones hold the text against its own sign or title.
START = {"marked": 0.99, "broken": 0.99, "terminal": 0.005, "digit_dot": 0.03, "reference": 0.02, "identifier": 0.02, "registration": 0.03, "keywords": 0.05, "keywords_odd": 0.9, "signature": 0.02, "list_item": 0.05, "list_odd": 0.9, "title": 0.02, "title_cut": 0.99, "open": 0.97}
BELIEF_TEXTS = 4.0
LEVELS = 100  # steps of the censoring posterior in the table of counts; texts are judged by their exact posterior
CERTAIN = ("marked", "broken", "title_cut")


def _tail() -> Column:
    """Last line of the text without outer blanks."""
    return F.trim(F.substring_index("body", "\n", -1))


def _relations(text: pd.Series, title: pd.Series) -> pd.Series:
    """'title', 'title_cut' or null, after look-alike folding, without letter case and accents."""

    def bare(t: str) -> str:
        plain = "".join(TWIN.get(ch, ch) for ch in fold(t))
        return "".join(ch for ch in unicodedata.normalize("NFKD", plain.casefold()) if not unicodedata.combining(ch))

    def relation(a: str | None, b: str | None) -> str | None:
        if not a or not b:
            return None
        x, y = bare(a), bare(b)
        if x == y:
            return "title"
        return "title_cut" if y.startswith(x) else None

    return pd.Series([relation(a, b) for a, b in zip(text, title, strict=True)])


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, ending): sizes without an appended sign of a cut; blank or null texts are left out."""
    spark = documents.sparkSession
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "title", "text")
    rows = rows.withColumn("marked", F.col("text").rlike(MARK)).withColumn("stored", F.when(F.col("marked"), F.regexp_replace("text", MARK, "")).otherwise(F.col("text")))
    rows = rows.withColumn("chars", F.length("stored")).withColumn("bytes", F.octet_length("stored")).withColumn("body", F.regexp_replace("stored", r"(?U)\s+$", "")).where("body <> '' or marked")
    tail = _tail()
    closed = r"[.!?。！？；;]['\"”’»)\]）】]*$"
    lone = ~F.col("body").contains("\n")
    rows = rows.select("doc_id", "source", "title", "chars", "bytes", "marked", tail.alias("tail"), lone.alias("lone"))
    known = (
        F.when(F.col("marked"), "marked")
        .when(F.col("tail").rlike("�$"), "broken")
        .when(F.col("tail").rlike(r"(?U)(?:^|[\s(（=<>±])\d+\.$"), "digit_dot")
        .when(F.col("tail").rlike(closed), "terminal")
        .when(F.col("tail").rlike(r"(?:^|[\s.。])\[\d{1,4}(?:[,–-]\s?\d{1,4})*\]$") | F.col("tail").rlike(r"(?U)(?:^|[.。]\s*)\(\p{Lu}[^()]{1,80}[,，]\s*(?:19|20)\d\d[a-z]?\)$"), "reference")
        .when(F.col("tail").rlike(r"(?i)(?:doi:\s*10\.\d{4,}/\S*\d|https?://\S+|PMID:?\s*\d{5,}|NCT\d{8})$"), "identifier")
        .when(F.col("tail").rlike(r"(?i)(?:^|[.。]\s*)(?:registered as|registration:?|registro:?|registriert als|enregistré sous|注册号[:：]?)\s+\S{4,}$"), "registration")
        .when(F.col("tail").rlike(r"(?i)\bfor the \p{L}[\p{L} -]* group$|(?i)\bon behalf of the \p{L}[\p{L} -]*$"), "signature")
        .when(F.col("tail").rlike(r"(?i)(?:^|[.。]\s*)(?:key ?words|schlüsselwörter|mots[- ]clés|palabras clave|关键词)\s*[:：]"), "keywords")
        .when(F.col("tail").rlike(BULLET), F.when(F.col("tail").rlike(rf"(?i)\d\s*{UNITS}$"), "list_item").otherwise("list_odd"))
    )
    rows = Stage(spark, "endings").write(rows.withColumn("ending", known))
    # single lines without any known ending are compared with the title
    single = rows.where("ending is null and lone").withColumn("ending", F.coalesce(F.pandas_udf(_relations, "string")("tail", "title"), F.lit("open")))
    other = rows.where("ending is not null or not lone").withColumn("ending", F.coalesce("ending", F.lit("open")))
    # the last keyword must be a keyword elsewhere too, else the line is cut inside it
    terms = F.transform(F.split(F.lower(F.regexp_extract("tail", r"(?i)[:：]\s*([^:：]*)$", 1)), r"[,;，；、]\s*"), lambda x: F.trim(x))
    lines = other.where("ending = 'keywords'").withColumn("terms", terms).withColumn("last", F.element_at("terms", -1))
    seen = lines.select(F.explode("terms").alias("last")).groupBy("last").count().where("count > 1").select("last", F.lit(True).alias("known"))
    lines = lines.join(seen, "last", "left").withColumn("ending", F.when(F.col("known") & (F.length("last") > 2), "keywords").otherwise("keywords_odd"))
    columns = ["doc_id", "source", "chars", "bytes", "ending"]
    return single.select(columns).unionByName(other.where("ending <> 'keywords'").select(columns)).unionByName(lines.select(columns))


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


_erf = np.vectorize(math.erf)


def _survival(z: np.ndarray) -> np.ndarray:
    return np.maximum(0.5 * (1 - _erf(z / math.sqrt(2))), 1e-300)


def candidate_limits(lengths: np.ndarray, n: np.ndarray) -> list[int]:
    """Lengths whose last WINDOW values hold far more texts than their surroundings would give.

    Every length is tested: five times its surroundings, and beyond chance by the Chernoff bound of a Poisson count at
    level CHANCE over all lengths of the source; surroundings count WINDOW values of one more text in the narrowest width.
    """
    order = np.argsort(lengths)
    lengths, n = lengths[order], n[order]
    total = np.concatenate([[0.0], np.cumsum(n)])
    upto = lambda x: total[np.searchsorted(lengths, x, "right")]
    width = np.maximum(25, (lengths * 0.1).astype(int))
    here = upto(lengths) - upto(lengths - WINDOW)
    around = (upto(lengths + width - 1) - upto(lengths - width) - here) / (2 * width - WINDOW) * WINDOW
    mean = around + WINDOW / (2 * 25 - WINDOW)
    chance = here - mean + here * np.log(mean / here)
    spikes = np.flatnonzero((here > 5 * mean) & (chance <= math.log(CHANCE / max(len(lengths), 1))))
    out: list[int] = []
    for x in lengths[spikes[np.argsort(-n[spikes], kind="stable")]]:
        if not any(abs(x - o) < 2 * WINDOW for o in out):
            out.append(int(x))
    return sorted(out)


def fit_censored(lengths: np.ndarray, n: np.ndarray, turns: int = 60) -> tuple[list[int], np.ndarray]:
    """(limits, censoring posterior per length) of one source's histogram of lengths."""
    limits = candidate_limits(lengths, n)
    posterior = np.zeros(len(lengths))
    if not limits:
        return limits, posterior
    x = np.log(np.maximum(lengths, 1).astype(float))
    at = np.full(len(lengths), -1)
    for k, c in enumerate(limits):
        at[(lengths > c - WINDOW) & (lengths <= c)] = k
    share = np.full(len(limits), 0.5 / len(limits))
    mu, sigma = float(np.average(x, weights=n)), max(0.3, float(np.sqrt(np.cov(x, aweights=n)))) if n.sum() > 1 else 1.0
    for _ in range(turns):
        z = (x - mu) / sigma
        density = np.maximum(_phi(z) / (sigma * np.maximum(lengths, 1)), 1e-300)  # per unit of length
        zc = (np.log(np.array(limits, float)) - mu) / sigma
        beyond = _survival(zc)
        for k, c in enumerate(limits):
            here = at == k
            # a text subject to a lower limit can't be as long as this one
            possible = 1 - sum(share[j] for j in range(len(limits)) if limits[j] < c)
            cut = share[k] * beyond[k] / WINDOW
            posterior[here] = cut / (cut + max(possible, 1e-9) * density[here])
        weight = n * posterior
        # the share of texts under limit k: its cut texts over the chance that a text under it is cut
        for k in range(len(limits)):
            share[k] = min(0.98, weight[at == k].sum() / max(n.sum() * beyond[k], 1e-9))
        if share.sum() > 0.98:
            share *= 0.98 / share.sum()
        hazard = _phi(zc) / beyond
        first = np.where(at >= 0, mu + sigma * hazard[at], 0.0)
        second = np.where(at >= 0, mu * mu + sigma * sigma + sigma * (np.log(np.array(limits, float))[at] + mu) * hazard[at], 0.0)
        m1 = (n * (1 - posterior) * x + weight * first).sum() / n.sum()
        m2 = (n * (1 - posterior) * x * x + weight * second).sum() / n.sum()
        mu, sigma = float(m1), float(np.sqrt(max(m2 - m1 * m1, 1e-3)))
    return limits, posterior


def censoring(ends: DataFrame) -> DataFrame:
    """(source, measure, length, censored): censoring posterior of each length of each source.

    Fields are limited in characters or in bytes; a source is modelled in the measure that explains more of its texts
    as cut. Only its histograms reach a task, and they have at most as many rows as there are different lengths.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        best, mass = None, -1.0
        for measure in ("chars", "bytes"):
            own = pdf[pdf["measure"] == measure].sort_values("length")
            _, posterior = fit_censored(own["length"].to_numpy(), own["n"].to_numpy(float))
            if (posterior * own["n"]).sum() > mass + 0.5:
                best, mass = own[["source", "measure", "length"]].assign(censored=posterior), float((posterior * own["n"]).sum())
        return best

    sizes = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes")]))
    histogram = ends.select("source", sizes.alias("x")).groupBy("source", "x.measure", "x.length").agg(F.count("*").alias("n"))
    return histogram.groupBy("source").applyInPandas(fit, "source string, measure string, length int, censored double")


def ending_evidence(counts: pd.DataFrame, turns: int = 60) -> tuple[dict[str, float], float]:
    """(log likelihood ratio of each ending, share of texts cut in transfer) by EM over counts (level, ending, n).

    A level is the censoring posterior in LEVELS steps. The first picture of cut endings comes from the lengths alone: texts
    count as cut by their censoring posterior. ENDINGS and LEVELS bound the table, not the rows.
    """
    grid = np.zeros((LEVELS + 1, len(ENDINGS)))
    for r in counts.itertuples():
        grid[r.level, ENDINGS.index(r.ending)] += r.n
    level = np.clip(np.arange(LEVELS + 1) / LEVELS, 0, 0.98)[:, None]
    start = np.array([START[e] for e in ENDINGS])
    certain, terminal = np.array([e in CERTAIN for e in ENDINGS]), ENDINGS.index("terminal")
    belief, moving = np.where(certain, 0.999, np.broadcast_to(level, grid.shape)), 0.05
    ratio = np.zeros(len(ENDINGS))
    for _ in range(turns):
        cut, whole = (grid * belief).sum(0) + BELIEF_TEXTS * start, (grid * (1 - belief)).sum(0) + BELIEF_TEXTS * (1 - start)
        cut[terminal] = BELIEF_TEXTS * start[terminal]  # a text that ends with a whole sentence is complete by definition
        ratio = np.log(cut / cut.sum()) - np.log(whole / whole.sum())
        prior = 1 - (1 - level) * (1 - moving)
        odds = prior / (1 - prior) * np.exp(ratio)
        belief = np.where(certain, 0.999, odds / (1 + odds))
        free = grid[level[:, 0] < 0.2]
        moving = float(np.clip((free * belief[level[:, 0] < 0.2]).sum() / max(free.sum(), 1), 0.001, 0.5))
    return dict(zip(ENDINGS, ratio.tolist(), strict=True)), moving


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, source, length, ending, censored, p_truncated): one row per row with a text; empty input, no rows."""
    spark = documents.sparkSession
    stage = Stage(spark, "truncation")
    ends = stage.write(endings(documents))
    fitted = stage.write(censoring(ends).where("censored > 0"))
    measures = fitted.groupBy("source").agg(F.first("measure").alias("measure"))
    sized = ends.join(measures, "source", "left").withColumn("length", F.when(F.col("measure") == "bytes", F.col("bytes")).otherwise(F.col("chars")))
    scored = sized.join(fitted.select("source", "length", "censored"), ["source", "length"], "left").fillna({"censored": 0.0})
    scored = stage.write(scored)
    counts = scored.groupBy(F.round(F.col("censored") * LEVELS).cast("int").alias("level"), "ending").agg(F.count("*").alias("n")).toPandas()
    ratios, moving = ending_evidence(counts) if len(counts) else ({e: 0.0 for e in ENDINGS}, 0.05)
    ratio = F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv])[F.col("ending")]
    prior = 1 - (1 - F.least(F.col("censored"), F.lit(0.98))) * (1 - F.lit(moving))
    odds = prior / (1 - prior) * F.exp(ratio)
    p = F.when(F.col("ending").isin(*CERTAIN), 0.999).otherwise(odds / (1 + odds))
    return scored.select("doc_id", "source", "length", "ending", F.round("censored", 6).alias("censored"), F.round(p, 6).alias("p_truncated"))


def rates(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source: texts, truncated texts and their share. Null sources count under ''."""
    cut = (F.col("p_truncated") > threshold).cast("long")
    return detect(documents).groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(cut).alias("n_truncated"), F.round(F.avg(cut.cast("double")), 6).alias("truncated_share"))


def found(spark, documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """p8_found: documents whose text stops in the middle of a word or sentence."""
    return detect(documents).where(F.col("p_truncated") > threshold).select("doc_id").distinct()
