"""Question analysis and gates: query specification, safety, coverage, evidence sufficiency, post check."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import vocabulary as V
from veridex.functions.text import contains_any, matches_any, redact
from veridex.operators.components import independent_count, source_keys


def _list_if(condition: Column, values: list[str]) -> Column:
    return F.when(condition, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))


def domains(text: Column, vocabulary: dict[str, list[str]] = V.DOMAINS) -> Column:
    """Domains of which a term stands in the text, in the vocabulary's order."""
    low = F.lower(text)
    return F.flatten(F.array(*[_list_if(contains_any(low, terms), [name]) for name, terms in vocabulary.items()]))


def expected_types(text: Column) -> Column:
    """Evidence types that the question's words ask for; comparisons ask for syntheses and trials."""
    low = F.lower(text)
    named = F.array_distinct(F.flatten(F.array(*[_list_if(contains_any(low, words), types) for words, types in V.EXPECTED_TYPES])))
    return F.when(F.size(named) > 0, named).otherwise(_list_if(contains_any(low, V.COMPARISON_TERMS), ["Meta-analysis", "RCT"]))


def time_range(text: Column, this_year: int) -> Column:
    """Struct of time_from and time_to: the last n years, since a year, or ten years for the latest evidence."""
    recent = F.try_to_number(F.nullif(F.regexp_extract(text, r"近\s*([0-9]{1,2})\s*年", 1), F.lit("")), F.lit("99")).cast("int")
    since = F.nullif(F.regexp_extract(text, r"((?:19|20)[0-9]{2})\s*年?(?:以后|之后|至今)", 1), F.lit("")).cast("int")
    latest = F.when(contains_any(F.lower(text), V.LATEST_TERMS), F.lit(this_year - 10))
    start = F.coalesce(F.lit(this_year) - recent, since, latest)
    return F.struct(start.alias("time_from"), F.when(start.isNotNull(), F.lit(this_year)).alias("time_to"))


def specify(questions: DataFrame, q_col: str, text_col: str, this_year: int, vocabulary: dict[str, list[str]] = V.DOMAINS) -> DataFrame:
    """(q, original, safe_query, domains, expected_types, local_terms, pico, api_queries, contains_phi, personalized, out_of_scope, unverifiable, needs_latest, time_from, time_to).

    A null question reads as empty. Identifying data is found on the original and redacted before anything else reads it.
    """
    base = questions.select(F.col(q_col).alias("q"), F.trim(F.coalesce(F.col(text_col), F.lit(""))).alias("original"))
    base = base.withColumn("contains_phi", matches_any(F.col("original"), V.PHI_PATTERNS)).withColumn("safe_query", redact(F.col("original")))
    found = base.withColumn("domains", domains(F.col("safe_query"), vocabulary)).withColumn("low", F.lower("safe_query"))
    translated = F.flatten(F.array(*[_list_if(F.col("safe_query").contains(zh), [zh, en]) for zh, en in V.TRANSLATIONS.items()]))
    owned = F.flatten(F.transform("domains", lambda d: F.create_map(*[x for name, terms in vocabulary.items() for x in (F.lit(name), F.array(*map(F.lit, terms)))])[d]))
    period = time_range(F.col("safe_query"), this_year)
    return found.select(
        "q", "original", "safe_query", "domains", expected_types(F.col("safe_query")).alias("expected_types"), unique(F.concat(F.array("safe_query"), translated, owned)).alias("local_terms"), pico(F.col("safe_query")).alias("pico"), api_queries(F.col("safe_query"), F.col("domains"), vocabulary).alias("api_queries"),
        "contains_phi", matches_any(F.col("safe_query"), V.PERSONAL_PATTERNS).alias("personalized"), (contains_any(F.col("low"), V.ANIMAL_TERMS) | (F.size("domains") == 0)).alias("out_of_scope"),
        F.col("original").rlike(V.UNVERIFIABLE).alias("unverifiable"), contains_any(F.col("low"), V.LATEST_TERMS).alias("needs_latest"), period["time_from"].alias("time_from"), period["time_to"].alias("time_to"),
    )


def safety(specs: DataFrame) -> DataFrame:
    """(q, code): the first reason to refuse before any search, null for none."""
    code = F.when(F.col("contains_phi"), "PHI_BLOCKED").when(F.col("personalized"), "PERSONALIZED_TREATMENT").when(F.col("out_of_scope"), "OUT_OF_SCOPE").when(F.col("unverifiable"), "UNVERIFIABLE_INTERVENTION")
    return specs.select("q", code.alias("code"))


def unique(items: Column) -> Column:
    """Trimmed items without blanks and, letter case apart, without repeats; the first spelling stays."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(clean, F.array().cast("array<string>"), keep)


def pico(text: Column) -> Column:
    """Map of P, I, C and O as a question's words give them."""
    old = text.contains("老年") | text.rlike(r"(?U)\b(?:6[5-9]|[7-9]\d)\s*岁")
    population = F.when(old, V.PICO["older"]).when(text.contains("孕"), V.PICO["pregnant"]).otherwise(V.PICO["adult"])
    named = F.slice(F.filter(F.array(*[F.when(text.contains(zh), F.lit(zh)) for zh in V.TRANSLATIONS]), lambda x: x.isNotNull()), 1, 4)
    compared = contains_any(F.lower(text), V.PICO_COMPARISONS)
    return F.create_map(F.lit("P"), population, F.lit("I"), F.array_join(named, "、"), F.lit("C"), F.when(compared, V.PICO["comparison"]).otherwise(""), F.lit("O"), F.lit(V.PICO["outcome"]))


def api_queries(text: Column, found: Column, vocabulary: dict[str, list[str]] = V.DOMAINS) -> Column:
    """Two boolean queries for literature interfaces: English expansions and Latin domain terms, once with study types, once for guidelines."""
    low = F.lower(text)
    expanded = F.flatten(F.array(*[_list_if(low.contains(zh), [en]) for zh, en in V.TRANSLATIONS.items()]))
    latin = F.flatten(F.array(*[F.when(F.array_contains(found, name), F.array(*map(F.lit, [t for t in terms if re.search("[a-z]", t)]))).otherwise(F.array().cast("array<string>")) for name, terms in vocabulary.items()]))
    words = F.array_join(unique(F.concat(expanded, latin)), " ")
    english = F.when(words == "", text).otherwise(words)
    return unique(F.array(F.concat(F.lit("("), english, F.lit(") AND (guideline OR trial OR meta-analysis)")), F.concat(F.lit("("), english, F.lit(") AND Guideline[pt]"))))


def trial_query(local_terms: Column, original: Column) -> Column:
    """Query of a trial registry: the first six Latin terms after the question itself, the first one and any of the others;
    the quoted question where there are none."""
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r'["\\\\]', " "), r"(?U)\s+", " "))
    quote = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    latin = F.slice(unique(F.transform(F.filter(F.slice(local_terms, 2, 1000), lambda t: t.rlike("[A-Za-z]")), clean)), 1, 6)
    quoted = F.transform(latin, quote)
    rest = F.array_join(F.slice(quoted, 2, 6), " OR ")
    first = F.get(quoted, F.lit(0))
    return F.when(F.size(quoted) == 0, quote(clean(original))).when(F.size(quoted) == 1, first).otherwise(F.concat(first, F.lit(" AND ("), rest, F.lit(")")))


def concepts(text: Column, vocabulary: dict[str, list[str]] = V.CONCEPTS) -> Column:
    low = F.lower(text)
    return F.flatten(F.array(*[_list_if(contains_any(low, words), [name]) for name, words in vocabulary.items()]))


def focus(text: Column) -> Column:
    """Struct of what a question asks about: concepts, literals, populations, and whether it is broadly about diet.

    Literals are unknown codes (upper-case words, words with digits) after known aliases are taken out, and named pathways,
    mechanisms or therapies; an entry must hold them word by word.
    """
    known = text
    for alias in (a for names in V.CONCEPTS.values() for a in sorted(names, key=len, reverse=True)):
        known = F.regexp_replace(known, "(?i)" + re.escape(alias), " ")
    words = F.regexp_extract_all(known, F.lit(r"(?U)\b([A-Za-z][A-Za-z0-9-]{2,})\b"), F.lit(1))
    codes = F.transform(F.filter(words, lambda w: ~F.lower(w).isin(*V.GENERIC_CODES) & ((F.upper(w) == w) | w.rlike("[0-9]"))), lambda w: F.lower(w))
    named = F.regexp_extract_all(text, F.lit(V.NAMED_FOCUS), F.lit(1))
    asked = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(V.POPULATION_FIELD), F.lit(1)), " "))
    populations = F.flatten(F.array(*[_list_if(contains_any(asked, words), [name]) for name, words in V.POPULATIONS.items()]))
    broad = contains_any(text, V.DIET_PHRASES) & ~text.contains(V.INTERVENTION_FIELD)
    return F.struct(concepts(text).alias("concepts"), F.array_distinct(F.concat(codes, named)).alias("literals"), populations.alias("populations"), broad.alias("broad"))


def covers(asked: Column, text: Column, exception_mark: str = "例外：") -> Column:
    """Whether the text before its exceptions holds every concept, literal and population of a focus; a broad question
    about diet wants one of its concepts and a word of diet instead of all concepts."""
    main = F.lower(F.split(text, exception_mark, 2)[0])
    held = concepts(main)
    whole = F.size(F.array_except(asked["concepts"], held)) == 0
    diet = F.arrays_overlap(asked["concepts"], held) & contains_any(main, V.DIET_WORDS)
    literal = F.forall(asked["literals"], lambda x: main.contains(x))
    peopled = F.lit(True)
    for name, words in V.POPULATIONS.items():
        there = contains_any(main, words)
        if name == "pregnancy":
            there = there & ~contains_any(main, V.NOT_PREGNANT)
        peopled = peopled & (~F.array_contains(asked["populations"], name) | there)
    return F.coalesce(F.when(asked["broad"], diet).otherwise(whole), F.lit(False)) & literal & peopled


def focused(specs: DataFrame) -> DataFrame:
    """(q, domains, asked): what the entries of a question are held against."""
    return specs.select("q", "domains", focus(F.col("safe_query")).alias("asked"))


def partition_coverage(specs: DataFrame, entries: DataFrame) -> DataFrame:
    """(q, id, coverage) of entries (q, id, topic, text) of questions, see ``coverage``."""
    return coverage(entries.join(focused(specs), "q"))


def coverage(rows: DataFrame) -> DataFrame:
    """(q, id, coverage) of rows (q, id, topic, text, domains, asked): direct if the entry covers the question's focus, or
    its domain where it has none; background if only the topic is one of the question's domains; else none. Null texts
    read as empty."""
    in_domain = F.coalesce(F.array_contains("domains", F.col("topic")), F.lit(False))
    body = F.coalesce("text", F.lit(""))
    narrow = (F.size("asked.concepts") > 0) | (F.size("asked.literals") > 0) | (F.size("asked.populations") > 0)
    named = in_domain | F.exists("domains", lambda d: body.contains(d))
    direct = covers(F.col("asked"), body) & F.when(F.col("asked.broad"), in_domain).when(narrow, F.lit(True)).otherwise(named)
    return rows.select("q", "id", F.when(direct, "direct").when(in_domain, "background").otherwise("none").alias("coverage"))


def claims_in_focus(specs: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (q, text, ...) whose text covers their question's focus."""
    asked = specs.select("q", focus(F.col("safe_query")).alias("asked"))
    return claims.join(asked, "q").where(covers(F.col("asked"), F.coalesce("text", F.lit("")))).drop("asked")


def coverage_gate(specs: DataFrame, coverage: DataFrame) -> DataFrame:
    """(q, code): QUESTION_NOT_COVERED where no entry is direct, else null; questions without entries are not covered."""
    direct = coverage.where("coverage = 'direct'").select("q").distinct().withColumn("covered", F.lit(True))
    return specs.select("q").join(direct, "q", "left").select("q", F.when(F.col("covered").isNull(), "QUESTION_NOT_COVERED").alias("code"))


def refusals(gates: DataFrame) -> DataFrame:
    """(q, refused, code, found, missing, next_steps) of (q, code, n_entries, n_sources): what a refused question is told.

    Sentences are one per code; a null code is not refused and has empty lists.
    """
    lookup = lambda i: F.create_map(*[F.lit(x) for code, texts in V.REFUSALS.items() for x in (code, texts[i])])[F.col("code")]
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    counted = F.format_string("检索到 %d 个候选片段，来自 %d 个独立来源。", F.col("n_entries"), F.col("n_sources"))
    found = F.when(F.col("code").isNotNull() & (F.col("n_entries") > 0), F.array(counted)).otherwise(F.array().cast("array<string>"))
    return gates.select("q", F.col("code").isNotNull().alias("refused"), "code", found.alias("found"), one(lookup(0)).alias("missing"), one(lookup(1)).alias("next_steps"))


def evidence_gate(specs: DataFrame, entries: DataFrame, threshold: float = 0.18, least_sources: int = 3) -> DataFrame:
    """(q, code, n_entries, n_sources, levels) from entries (q, rank, score, topic, level, source, identity, family, text); null code passes.

    ``family`` is the reliable research family, '' or null for none; sources are independent if no document, family or
    alias (optional array column) links them. Entries are the few kept for a question. Questions without entries keep a
    row. Order: no evidence, low relevance, too few sources, missing type, conflict.
    """
    topics = F.collect_set(F.when(F.col("rank") <= 3, F.nullif("topic", F.lit(""))))
    marked = contains_any(F.lower(F.coalesce("text", F.lit(""))), V.CONFLICT_MARKERS) & (F.col("rank") <= 5)
    keys = source_keys(F.col("source"), F.col("identity"), F.col("family"), F.col("aliases") if "aliases" in entries.columns else None)
    per = entries.withColumn("keys", keys).groupBy("q").agg(
        F.count("*").alias("n"), F.max_by("score", -F.col("rank")).alias("top"), topics.alias("topics"), independent_count(F.collect_list("keys")).alias("sources"),
        F.array_sort(F.collect_set(F.nullif("level", F.lit("")))).alias("levels"), F.max(marked.cast("int")).alias("conflict"),
    )
    rows = specs.select("q", "domains", "expected_types").join(per, "q", "left")
    n = F.coalesce("n", F.lit(0))
    off_topic = (F.size("domains") > 0) & ~F.arrays_overlap("domains", "topics")
    code = (
        F.when(n == 0, "NO_EVIDENCE").when((F.col("top") < threshold) | off_topic, "LOW_RELEVANCE").when(F.col("sources") < least_sources, "INSUFFICIENT_SOURCES")
        .when((F.size("expected_types") > 0) & ~F.arrays_overlap("expected_types", "levels"), "MISSING_EVIDENCE_TYPE").when(F.col("conflict") == 1, "UNRESOLVED_CONFLICT")
    )
    return rows.select("q", code.alias("code"), n.alias("n_entries"), F.coalesce("sources", F.lit(0)).alias("n_sources"), F.coalesce("levels", F.array().cast("array<string>")).alias("levels"))


def post_gate(checks: DataFrame, most_failures: float = 0.5) -> DataFrame:
    """(q, code) from (q, refused, n_claims, failure_ratio): generator refusal, no claims, or more failures than allowed."""
    code = F.when(F.col("refused"), "GENERATOR_REFUSAL").when(F.col("n_claims") == 0, "NO_SUPPORTED_CLAIMS").when(F.col("failure_ratio") > most_failures, "CITATION_FAILURE")
    return checks.select("q", code.alias("code"))


def query_variants(specs: DataFrame, most: int = 6) -> DataFrame:
    """(q, variant, text): distinct phrasings of a question for dense search, in order of preference."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")
    every = F.array(tidy(F.col("safe_query")), tidy(F.col("original")), tidy(F.array_join(F.slice("local_terms", 1, 24), " ")))
    kept = F.slice(F.array_distinct(F.filter(every, lambda v: v != "")), 1, most)
    return specs.select("q", F.posexplode(kept).alias("variant", "text"))
