"""Queries of the training-data operators, each over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm import confusable, consensus, crosssplit, grouping, mixing, ocr, packing, truncation
from veridex.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def over(operator: Callable[..., DataFrame], *tables: str) -> Query:
        return lambda spark, sf_dir: operator(*[read_table(spark, sf_dir, t) for t in tables])

    def found(operator: Callable[..., DataFrame], *tables: str) -> Query:
        return lambda spark, sf_dir: operator(spark, *[read_table(spark, sf_dir, t) for t in tables])

    records, registry = "independent_synthetic_v1", "questions"
    return {
        "p1_found": found(consensus.found, "review_template"),
        "p1_consensus": over(consensus.consensus, "review_template"),
        "p1_agreement": over(consensus.agreement, "review_template"),
        "p1_reliability": over(consensus.reliability, "review_template"),
        "p2_found": found(crosssplit.found, records),
        "p2_report": over(crosssplit.report, records),
        "p3_found": found(grouping.found, records, registry),
        "p3_assign": over(grouping.assign, records, registry, "split_targets"),
        "p3_balance": lambda spark, sf_dir: grouping.balance(grouping.assign(*[read_table(spark, sf_dir, t) for t in (records, registry, "split_targets")]), read_table(spark, sf_dir, "split_targets")),
        "p4_found": found(confusable.found, "documents", "test_set"),
        "p4_titles": lambda spark, sf_dir: confusable.canonical(read_table(spark, sf_dir, "documents").select("doc_id", "title"), "title"),
        "p4_questions": lambda spark, sf_dir: confusable.canonical(read_table(spark, sf_dir, "test_set").select("id", "question").distinct(), "question"),
        "p5_found": found(ocr.found, "chunks", "documents"),
        "p5_paragraphs": over(ocr.paragraphs, "chunks", "documents"),
        "p6_containers": over(packing.fill_containers, "documents", "container_sizes"),
        "p6_waste": lambda spark, sf_dir: packing.waste(packing.fill_containers(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "container_sizes"))),
        "p7_mix": over(mixing.mix, "documents", "source_mix"),
        "p7_shares": over(mixing.shares, "documents", "source_mix"),
        "p8_found": found(truncation.found, "documents"),
        "p8_rates": over(truncation.rates, "documents"),
    }


_BLANK = r"'^[\s\x{00A0}\x{2000}-\x{200B}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200B}\x{3000}]+$', '', 'g'"
_FILLERS = "('', 'n/a', 'na', '-', '--', 'tbd', 'unknown', 'none', 'null', 'nan', '?', 'pending_owner_assignment', 'pending', 'unassigned', 'not assigned', 'todo')"


def oracle_sql() -> dict[str, str]:
    squeezed = lambda c: f"lower(regexp_replace({c}, {_BLANK}))"
    votes = f"""
        SELECT item, annotator, label FROM (
            SELECT item_id AS item, {squeezed('reviewer_id')} AS annotator, reviewed_at, received_at,
                   replace(replace({squeezed('labels.behavior')}, ' ', '_'), '-', '_') AS label
            FROM review_template)
        WHERE item IS NOT NULL AND annotator IS NOT NULL AND annotator NOT IN {_FILLERS} AND label IN ('answer', 'qualified_answer', 'refuse')
        QUALIFY row_number() OVER (PARTITION BY item, annotator ORDER BY coalesce(reviewed_at, TIMESTAMPTZ '1970-01-01') DESC, coalesce(received_at, TIMESTAMPTZ '1970-01-01') DESC, label DESC) = 1"""
    return {
        "p1_agreement": f"""
            WITH v AS ({votes}),
            n AS (SELECT item, count(*)::DOUBLE AS m, sum((label = 'answer')::INT)::DOUBLE AS a, sum((label = 'qualified_answer')::INT)::DOUBLE AS b, sum((label = 'refuse')::INT)::DOUBLE AS c FROM v GROUP BY item HAVING count(*) > 1),
            s AS (SELECT count(*) AS n_items, sum(m) AS votes, sum(a*(a-1)+b*(b-1)+c*(c-1)) AS agreeing, sum(m*(m-1)) AS pairs,
                         sum(m - (a*(a-1)+b*(b-1)+c*(c-1))/(m-1)) AS disagree, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc FROM n)
            SELECT n_items, coalesce(votes, 0)::BIGINT AS n_votes, round(agreeing/pairs, 6) AS observed_agreement,
                   round(1 - disagree*(votes-1)/nullif(votes*votes-sa*sa-sb*sb-sc*sc, 0), 6) AS krippendorff_alpha FROM s""",
        "p3_found": f"""
            WITH RECURSIVE last AS (
                SELECT {squeezed('id')} AS id, semantic_family_id, derived_from FROM questions WHERE id IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY {squeezed('id')} ORDER BY coalesce(updated_at, TIMESTAMPTZ '1970-01-01') DESC, coalesce(ingested_at, TIMESTAMPTZ '1970-01-01') DESC, semantic_family_id DESC NULLS LAST) = 1),
            half AS (
                SELECT id AS u, 'g:' || {squeezed('question_group_id')} AS v FROM independent_synthetic_v1 WHERE id IS NOT NULL AND {squeezed('question_group_id')} NOT IN {_FILLERS}
                UNION SELECT id, 'f:' || {squeezed('semantic_family_id')} FROM last WHERE {squeezed('semantic_family_id')} NOT IN {_FILLERS}
                UNION SELECT id, {squeezed('p')} FROM (SELECT id, unnest(derived_from) AS p FROM last) WHERE {squeezed('p')} NOT IN {_FILLERS}),
            edges AS (SELECT u, v FROM half UNION SELECT v, u FROM half),
            own AS (SELECT DISTINCT id FROM independent_synthetic_v1 WHERE id IS NOT NULL),
            reach(a, b) AS (SELECT id, id FROM own UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b),
            sets AS (SELECT a AS id, min(b) AS component FROM reach JOIN own ON own.id = b GROUP BY a)
            SELECT component AS id_a, id AS id_b FROM sets WHERE component <> id""",
    }
