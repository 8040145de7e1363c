"""Identities of sources: publication ids, research families, document identities, evidence levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of publication ids.
PMID = r"(?i)(?:pmid[:/]|pubmed\.ncbi\.nlm\.nih\.gov/)([0-9]{5,9})"
NCT = r"(?i)\b(NCT[0-9]{8})\b"
DOI = r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _doi(text: Column) -> Column:
    return F.lower(F.regexp_replace(_first(text, DOI), r"[.,)]+$", ""))


def canonical_source(doc_id: Column, chunk_id: Column, url: Column) -> Column:
    """pmid, then nct, then doi found in the ids and the address, else the document id in lower case."""
    joined = F.concat_ws(" ", F.coalesce(doc_id, F.lit("")), F.coalesce(chunk_id, F.lit("")), F.coalesce(url, F.lit("")))
    return F.coalesce(F.concat(F.lit("pmid:"), _first(joined, PMID)), F.concat(F.lit("nct:"), F.upper(_first(joined, NCT))), F.concat(F.lit("doi:"), _doi(joined)), F.lower(F.coalesce(F.nullif(doc_id, F.lit("")), chunk_id)))


def research_family(doc_id: Column, chunk_id: Column, url: Column) -> Column:
    """A trial registration anywhere names the family, else the canonical source."""
    joined = F.concat_ws(" ", F.coalesce(doc_id, F.lit("")), F.coalesce(chunk_id, F.lit("")), F.coalesce(url, F.lit("")))
    return F.coalesce(F.concat(F.lit("trial:"), F.upper(_first(joined, NCT))), canonical_source(doc_id, chunk_id, url))


def document_identity(source: Column, doc_id: Column, chunk_id: Column, url: Column) -> Column:
    """Pages are themselves; publications go by their own pmid, then doi, then canonical source."""
    own = F.concat_ws(" ", F.coalesce(doc_id, F.lit("")), F.coalesce(url, F.lit("")))
    other = F.coalesce(F.concat(F.lit("document:pmid:"), _first(own, PMID)), F.concat(F.lit("document:doi:"), _doi(own)), F.concat(F.lit("document:"), canonical_source(doc_id, chunk_id, url)))
    return F.when(source == "knowledge_page", F.concat(F.lit("page:"), doc_id)).otherwise(other)


def aliases(text: Column) -> Column:
    """Array of (kind, value) of all publication ids in a document's own id and address; for conflicts between them."""
    every = lambda kind, pattern, shape: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), shape(v).alias("value")))
    return F.array_distinct(F.concat(every("pmid", PMID, lambda v: v), every("doi", DOI, lambda v: F.lower(F.regexp_replace(v, r"[.,)]+$", ""))), every("nct", NCT, F.upper)))


def alias_names(ids: Column) -> Column:
    """Names of (kind, value) ids as families are named: pmid:, doi:, trial:; malformed values are left out."""
    named = F.transform(ids, lambda x: F.concat(F.when(x["kind"] == "nct", "trial:").otherwise(F.concat(x["kind"], F.lit(":"))), x["value"]))
    return F.filter(named, lambda n: n.rlike(r"^(?:pmid:[0-9]{5,9}|trial:NCT[0-9]{8}|doi:10\.[0-9]{4,9}/\S+)$"))


def address(record_id: Column) -> Column:
    """Public address of a record by the prefix of its id; null for other records."""
    value = F.regexp_replace(record_id, "^[^:]*:", "")
    kind = F.when(record_id.contains(":"), F.lower(F.substring_index(record_id, ":", 1)))
    known = F.create_map(*[F.lit(x) for kv in ADDRESSES.items() for x in kv])[kind]
    return F.concat(known, value)


def slug(value: Column) -> Column:
    """A name that is safe in a path: its plain signs and 8 signs of its hash, so that different names stay apart."""
    plain = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^[.-]+|[.-]+$", "")
    return F.concat_ws("-", F.when(plain != "", plain).otherwise("value"), F.substring(F.sha2(value, 256), 1, 8))


def cache_key(source: Column, query: Column, top_k: Column, version: Column) -> Column:
    """The first 20 hexadecimal signs of the SHA-256 of source|query|k|version."""
    return F.substring(F.sha2(F.concat_ws("|", source, query, top_k.cast("string"), version), 256), 1, 20)


def reliable_family(family: Column) -> Column:
    """The family if its shape can be trusted, else an empty string."""
    good = family.rlike(r"^(?:pmid:[0-9]{5,9}|(?:trial|nct):NCT[0-9]{8})$") | (family.startswith("doi:10.") & family.contains("/"))
    return F.when(good, family).otherwise(F.lit(""))


def identifiers(record_id: Column) -> Column:
    """Struct of pmid, doi and nct_id by the prefix of a record id."""
    kind, value = F.lower(F.substring_index(record_id, ":", 1)), F.regexp_replace(record_id, "^[^:]*:", "")
    has = record_id.contains(":")
    pick = lambda name: F.when(has & (kind == name), value)
    return F.struct(pick("pmid").alias("pmid"), pick("doi").alias("doi"), pick("nct").alias("nct_id"))


# Addresses behind the prefixes of record ids.
ADDRESSES = {"pmid": "https://pubmed.ncbi.nlm.nih.gov/", "nct": "https://clinicaltrials.gov/study/", "doi": "https://doi.org/"}

# Publication types behind each level.
GUIDELINES = ["guideline", "practice guideline"]
CONSENSUS = ["consensus development conference", "consensus development conference, nih", "consensus statement"]
REVIEWS = ["review", "systematic review"]
TRIAL, META = "randomized controlled trial", "meta-analysis"


def classification(types: Column, preprint: Column) -> Column:
    """Struct of evidence_level, basis (sorted types) and review_status of a list of publication types.

    A trial label beside a synthesis label is a conflict and left open; null or blank types count as none.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"(?U)\s+", " "), "^ | $", "")), lambda t: t != "")))
    has = lambda names: F.arrays_overlap(clean, F.array(*map(F.lit, names)))
    conflict = has([TRIAL]) & has([META, *GUIDELINES, *CONSENSUS, *REVIEWS])
    level = F.when(preprint, "preprint").when(conflict, "Other").when(has([META]), "Meta-analysis").when(has(GUIDELINES), "Guideline").when(has([TRIAL]), "RCT").when(has(CONSENSUS), "Consensus").when(has(REVIEWS), "Review").otherwise("Other")
    mapped = preprint | has([META, TRIAL, *GUIDELINES, *CONSENSUS, *REVIEWS])
    status = F.when(~preprint & conflict, "classification_conflict").when(mapped, "metadata_mapped").when(F.size(clean) > 0, "unmapped_publication_type").otherwise("metadata_missing")
    return F.struct(level.alias("evidence_level"), clean.alias("basis"), status.alias("review_status"))


def evidence_role(level: Column, overview: list[str]) -> Column:
    return F.when(level.isin(*overview), "overview").when(level == "RCT", "causal").otherwise("boundary")
