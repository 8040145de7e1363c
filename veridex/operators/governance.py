"""Checks around evaluation runs and ingestion: reconciliation, row rules, label binding, gates, excerpts, addresses."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_median(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, median): smallest value at which half of the group's weight is reached. Null values and weights don't count.

    Weights are summed per distinct value first, so the running sum is over distinct values only.
    """
    per = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(by, value).agg(F.sum(weight).alias("w"))
    group = Window.partitionBy(by)
    running = per.withColumn("upto", F.sum("w").over(group.orderBy(value))).withColumn("half", F.sum("w").over(group) / 2)
    return running.where("upto >= half").groupBy(by).agg(F.min(value).alias("median"))


def reconcile(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    """(status, n) over a full outer join of keys: missing in b, extra in b, field differs, equal."""
    left = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(field).alias("x")).withColumn("in_a", F.lit(True))
    right = b.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(field).alias("y")).withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.col("x").eqNullSafe(F.col("y")), "equal").otherwise("differs")
    return left.join(right, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def void_repeated(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Adds copies, differs and void: a key that stands on several rows voids all of them, exact copies too."""
    group = Window.partitionBy(*keys)
    copies = F.count("*").over(group)
    return rows.withColumn("copies", copies).withColumn("differs", F.min(content).over(group) != F.max(content).over(group)).withColumn("void", copies > 1)


def bind_labels(labels: DataFrame, runs: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, status): final labels against run rows: bound, hash_mismatch, label_missing or run_missing.

    Several labels or runs of one key are bound only if all their digests are one; a null digest binds nothing.
    """
    own = lambda df, end: df.groupBy(*keys).agg(F.min(digest).alias(f"low_{end}"), F.max(digest).alias(f"high_{end}"), F.lit(True).alias(f"has_{end}"))
    one = (F.col("low_l") == F.col("high_l")) & (F.col("low_r") == F.col("high_r")) & (F.col("low_l") == F.col("low_r"))
    status = F.when(F.col("has_r").isNull(), "run_missing").when(F.col("has_l").isNull(), "label_missing").when(F.coalesce(one, F.lit(False)), "bound").otherwise("hash_mismatch")
    return own(labels, "l").join(own(runs, "r"), keys, "full_outer").select(*keys, status.alias("status"))


def repeat_consistency(runs: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, n, consistent): whether all runs of a key gave one digest; one run proves nothing and is null."""
    per = runs.where(F.col(digest).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), (F.min(digest) == F.max(digest)).alias("same"))
    return per.select(key, "n", F.when(F.col("n") > 1, F.col("same")).alias("consistent"))


def metric_gates(rows: DataFrame, arm: str, baseline: str, candidate: str, metrics: list[str]) -> DataFrame:
    """(metric, baseline, candidate, passed): a mean of the candidate arm must not fall; null where an arm has no value."""
    means = rows.where(F.col(arm).isin(baseline, candidate)).agg(*[F.round(F.avg(F.when(F.col(arm) == a, F.col(m))), 6).alias(f"{side}_{m}") for side, a in (("b", baseline), ("c", candidate)) for m in metrics])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(f"c_{m}").alias("candidate")) for m in metrics]))
    return means.select(each.alias("x")).select("x.metric", "x.baseline", "x.candidate", (F.col("x.candidate") >= F.col("x.baseline")).alias("passed"))


def blind_aliases(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """(group, key, alias): position of a key in a seeded pseudo-random order within its group; repeated keys share one."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(group), F.col(key)), 256)
    return rows.select(group, key).where(F.col(key).isNotNull()).distinct().withColumn("alias", F.row_number().over(Window.partitionBy(group).orderBy(order, key)))


def weakest(ranking: DataFrame, k: int = 8) -> DataFrame:
    """(q, id, rank): the last k of each ranking in reverse, ranked anew; the profile of a degraded ranker."""
    back = ranking.withColumn("back", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rank"))))
    return back.where(F.col("back") <= k).select("q", "id", F.col("back").alias("rank"))


def bare_position(original: Column, excerpt: Column) -> Column:
    """Position from 1 of an excerpt in a text, blanks of both left out; 0 if it is not there or empty."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.when(bare(excerpt) == "", 0).otherwise(F.coalesce(F.call_function("locate", bare(excerpt), bare(original)), F.lit(0)))


def excerpt_offsets(original: Column, excerpt: Column) -> Column:
    """Struct of start and stop offsets of an excerpt in the original text, blanks disregarded; null if it is not there."""

    def locate(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for text, part in zip(a, b, strict=True):
            at = [i for i, ch in enumerate(text or "") if not ch.isspace()]
            bare, want = "".join(text[i] for i in at) if text else "", "".join((part or "").split())
            found = bare.find(want) if want else -1
            out.append((at[found], at[found + len(want) - 1] + 1) if found >= 0 else (None, None))
        return pd.DataFrame(out, columns=["start", "stop"], dtype="Int64")

    return F.pandas_udf(locate, "start long, stop long")(original, excerpt)


def safe_address(url: Column) -> Column:
    """The address if it is http(s) of a public host without credentials, blanks or control signs, else null."""

    def check(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            if not value or any(ch.isspace() or ch == "\\" or ord(ch) < 32 or ord(ch) == 127 for ch in value):
                return None
            try:
                parts = urlsplit(value)
                host, _ = parts.hostname, parts.port
            except ValueError:
                return None
            if parts.scheme.lower() not in ("http", "https") or not host or parts.username or parts.password or host.lower().startswith("localhost"):
                return None
            try:
                return value if ipaddress.ip_address(host).is_global else None
            except ValueError:
                return value

        return values.map(one)

    return F.pandas_udf(check, "string")(url)


def page_issues(claims: DataFrame) -> DataFrame:
    """(code, n): broken rules of knowledge-page claims (id, doc_id, text, citations), each claim and citation counted."""
    same = Window.partitionBy("id")
    rows = claims.withColumn("copies", F.count("*").over(same))
    cites = rows.select("id", F.explode("citations").alias("c"))
    n = lambda df, code, bad: df.where(F.coalesce(bad, F.lit(False))).agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    parts = [
        n(rows, "claim_id_repeated", (F.coalesce("id", F.lit("")) == "") | (F.col("copies") > 1)),
        n(rows, "claim_without_source", F.coalesce(F.size("citations"), F.lit(0)) <= 0),
        n(cites, "pmid_malformed", (F.col("c.type") == "pmid") & ~F.coalesce("c.pmid", F.lit("")).rlike(r"^\d{5,9}$")),
        n(cites, "pmid_not_verified", (F.col("c.type") == "pmid") & (F.coalesce("c.verified_at", F.lit("")) == "")),
        n(cites, "address_malformed", ~F.coalesce("c.url", F.lit("")).rlike(r"^https?://[^/\s]+")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


def locator_issue(text: Column, quote: Column, start: Column, stop: Column) -> Column:
    """missing_locator, locator_mismatch or null: a quote must stand in the text, and at its offsets where these are given."""
    some = quote.isNotNull() | start.isNotNull() | stop.isNotNull()
    bad_quote = quote.isNotNull() & ((quote == "") | (F.call_function("instr", text, quote) == 0))
    spans = start.isNotNull() | stop.isNotNull()
    valid = F.coalesce((start >= 0) & (start < stop) & (stop <= F.length(text)), F.lit(False))
    same = F.coalesce(quote.isNull() | (F.substring(text, start + 1, stop - start) == quote), F.lit(False))
    return F.when(~some, "missing_locator").when(bad_quote | (spans & ~(valid & same)), "locator_mismatch")


def output_issue(behavior: Column, answer: Column, refusal_code: Column) -> Column:
    """The first broken rule of an output: behavior_invalid, answer_missing, refusal_code_missing, or null."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(~F.coalesce(behavior.isin("answer", "qualified_answer", "refuse"), F.lit(False)), "behavior_invalid").when(~filled(answer), "answer_missing").when((behavior == "refuse") & ~filled(refusal_code), "refusal_code_missing")


def ledger_issues(records: DataFrame, corpus_version: str, parser_version: str) -> DataFrame:
    """(code, n): broken rules of a corpus ledger's records, each record and rule counted.

    ``records`` has canonical_source_id, content_status, classification_basis, review_status, file_sha256, metadata_sha256,
    source_url, index_version, parser_version.
    """
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    digest = lambda c: F.coalesce(F.col(c), F.lit("")).rlike("^[0-9a-f]{64}$") | (F.coalesce(F.col(c), F.lit("")) == "unknown")
    basis = F.coalesce("classification_basis", F.array().cast("array<string>"))
    rules = {
        "id_missing": ~filled("canonical_source_id"),
        "status_missing": ~filled("content_status"),
        "basis_missing": (F.size(basis) == 0) & ~F.coalesce(F.col("review_status").isin("metadata_missing", "unknown"), F.lit(False)),
        "basis_blank": F.exists(basis, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""),
        "file_digest_invalid": ~digest("file_sha256"),
        "metadata_digest_invalid": ~digest("metadata_sha256"),
        "full_text_without_digest": (F.col("content_status") == "full_text") & (F.col("file_sha256") == "unknown"),
        "address_invalid": ~(F.coalesce(F.col("source_url"), F.lit("")).rlike(r"^https?://[^/\s]+") | (F.coalesce(F.col("source_url"), F.lit("")) == "unknown")),
        "index_version_differs": ~F.col("index_version").eqNullSafe(F.lit(corpus_version)),
        "parser_version_differs": ~F.col("parser_version").eqNullSafe(F.lit(parser_version)),
    }
    flags = records.select(F.explode(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()])).alias("code"))
    return flags.where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


def header_identity(evidence: Column) -> Column:
    """Whether a title was found as the complete, prominent header of the first page: struct of method, page, bbox,
    body_font_size, minimum_title_font_size, before_section_boundary_y."""
    box = evidence["bbox"]
    at = lambda i: F.get(box, F.lit(i))
    placed = (F.size(box) == 4) & (at(0) >= 0) & (at(0) < at(2)) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) < evidence["before_section_boundary_y"])
    sized = (evidence["minimum_title_font_size"] > evidence["body_font_size"]) & (evidence["body_font_size"] > 0)
    return F.coalesce((evidence["method"] == "exact_complete_prominent_header_title") & (evidence["page"] == 1) & placed & sized, F.lit(False))


def allowed_notes(notes: Column, allowed: list[str]) -> Column:
    """The notes of a generated answer that are among the application's own sentences, in order."""
    return F.filter(F.coalesce(notes, F.array().cast("array<string>")), lambda x: x.isin(*allowed))


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object with its keys in order; the same content gives the same digest."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)
