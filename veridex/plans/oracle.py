"""SQL over the same tables that gives the same rows as the catalogue's queries."""

from __future__ import annotations

from veridex.functions import vocabulary as V

WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _text(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '{WS}', ' ', 'g'), '^ | $', '', 'g')"


def tokens(c: str) -> str:
    """Tokens of a column in the order Latin, Chinese, numbers; letters outside of ASCII bound numbers as words do."""
    n = norm(c)
    pairs = rf"flatten(list_transform(regexp_extract_all({n}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: CASE WHEN length(r) <= 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i::INT, 2)) END))"
    numbers = rf"regexp_extract_all(regexp_replace({n}, '[^\x00-\x7F\pP\pS\pZ\x{{00B2}}\x{{00B3}}\x{{00B9}}]', 'x', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b')"
    return f"list_filter(list_concat(list_concat(regexp_extract_all({n}, '[a-z][a-z0-9+.-]{{1,}}'), {pairs}), {numbers}), lambda t: NOT list_contains({_text(V.STOP_WORDS)}, t))"


GOLDEN = r"golden AS (SELECT id, min(question) AS question FROM test_set WHERE CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT) % 100 = 0 GROUP BY id)"
ITEMS = f"""items AS MATERIALIZED (SELECT doc_id AS id, {tokens("coalesce(title,'') || ' ' || coalesce(topic,'') || ' ' || coalesce(text,'')")} AS toks FROM documents)"""


def scoring(items: str, prefix: str = "") -> str:
    """BM25 and cosine over a table items(id, toks) for the golden questions."""
    return f"""{GOLDEN}, {items},
    qt AS MATERIALIZED (SELECT q, term, count(*)::DOUBLE AS qtf FROM (SELECT id AS q, unnest({tokens('question')}) AS term FROM golden) GROUP BY q, term),
    post AS MATERIALIZED (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(toks) AS term FROM items) GROUP BY id, term),
    sizes AS (SELECT id, len(toks) AS n_toks FROM items),
    shape AS (SELECT count(*)::DOUBLE AS n, greatest(avg(n_toks), 1.0) AS avg_len FROM sizes),
    dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
    raw AS (SELECT q, p.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n_toks / avg_len))), 9) AS s
            FROM qt JOIN dfs USING (term) JOIN post p USING (term) JOIN sizes z ON z.id = p.id, shape GROUP BY q, p.id),
    bm AS MATERIALIZED (SELECT q, id, s, round(CASE WHEN max(s) OVER (PARTITION BY q) > 0 THEN s / max(s) OVER (PARTITION BY q) ELSE 0 END, 9) AS bm25 FROM raw),
    w AS (SELECT q, qt.term, qtf, ln((n + 2) / (coalesce(df, 0) + 2)) + 1 AS w, ln((n + 2) / (coalesce(df, 0) + 1)) + 1 AS w0 FROM qt LEFT JOIN dfs USING (term), shape),
    base AS (SELECT id, sum(pow(tf * (ln((n + 2) / (df + 1)) + 1), 2)) AS base FROM post JOIN dfs USING (term), shape GROUP BY id),
    qn AS (SELECT q, sqrt(sum(pow(qtf * w, 2))) AS qn FROM w GROUP BY q),
    sh AS (SELECT q, id, sum(qtf * tf * w * w) AS dot, sum(tf * tf * (w * w - w0 * w0)) AS shift FROM w JOIN post USING (term) GROUP BY q, id),
    cs AS MATERIALIZED (SELECT q, id, round(dot / (qn * sqrt(base + shift)), 9) AS cosine FROM sh JOIN base USING (id) JOIN qn USING (q)),
    bmr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rank FROM bm QUALIFY rank <= 100),
    csr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM cs QUALIFY rank <= 100),
    rr AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS f FROM (SELECT q, id, rank FROM bmr UNION ALL SELECT q, id, rank FROM csr) GROUP BY q, id),
    fused AS MATERIALIZED (SELECT q, id, round(f / max(f) OVER (PARTITION BY q), 9) AS fused FROM rr),
    lex AS MATERIALIZED (SELECT q, id, fused, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine,
            round(0.55 * fused + 0.25 * coalesce(bm25, 0) + 0.20 * coalesce(cosine, 0), 9) AS score,
            row_number() OVER (PARTITION BY q ORDER BY fused DESC, greatest(coalesce(bm25, 0), coalesce(cosine, 0)) DESC, id) AS rank
            FROM fused LEFT JOIN bm USING (q, id) LEFT JOIN cs USING (q, id) QUALIFY rank <= 40)"""


BASE = scoring(ITEMS)
PRIOR = "CASE evidence_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.EVIDENCE_PRIOR.items()) + " ELSE 0.0 END"
LOCAL = f"""{BASE}, pl AS MATERIALIZED (SELECT l.q, l.id, unnest(i.toks) AS term FROM lex l JOIN items i USING (id)), ix AS MATERIALIZED (SELECT q, id, term, count(*)::DOUBLE AS tf FROM pl GROUP BY q, id, term),
    sz AS (SELECT l.q, l.id, len(i.toks) AS z FROM lex l JOIN items i USING (id)), sh2 AS (SELECT q, count(*)::DOUBLE AS n, greatest(avg(z), 1.0) AS a FROM sz GROUP BY q), d2 AS (SELECT q, term, count(*)::DOUBLE AS df FROM ix GROUP BY q, term),
    asked AS MATERIALIZED (SELECT qt.q, qt.term, qtf, n, a, coalesce(df, 0) AS df FROM qt JOIN sh2 USING (q) LEFT JOIN d2 USING (q, term)), hits AS MATERIALIZED (SELECT * FROM asked JOIN ix USING (q, term) JOIN sz USING (q, id)),
    b AS (SELECT q, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * z / a))), 9) AS s FROM hits GROUP BY q, id), bb AS (SELECT q, id, round(CASE WHEN max(s) OVER (PARTITION BY q) > 0 THEN s / max(s) OVER (PARTITION BY q) ELSE 0 END, 9) AS bm25 FROM b),
    nm AS (SELECT ix.q, ix.id, sum(pow(tf * (ln((n + 2) / (d2.df + CASE WHEN qt.term IS NULL THEN 0 ELSE 1 END + 1)) + 1), 2)) AS norm FROM ix JOIN sh2 USING (q) JOIN d2 USING (q, term) LEFT JOIN qt USING (q, term) GROUP BY ix.q, ix.id),
    qn2 AS (SELECT q, sum(pow(qtf * (ln((n + 2) / (df + 2)) + 1), 2)) AS q_norm FROM asked GROUP BY q), dt AS (SELECT q, id, sum(qtf * tf * pow(ln((n + 2) / (df + 2)) + 1, 2)) AS dot FROM hits GROUP BY q, id),
    cl AS (SELECT q, id, round(dot / sqrt(norm * q_norm), 9) AS cosine FROM dt JOIN nm USING (q, id) JOIN qn2 USING (q)),
    loc AS MATERIALIZED (SELECT l.q, l.id, l.score, coalesce(bb.bm25, 0) AS bm25, coalesce(cl.cosine, 0) AS cosine FROM lex l LEFT JOIN bb USING (q, id) LEFT JOIN cl USING (q, id))"""
RERANK = f"""{LOCAL}, rer AS MATERIALIZED (
    SELECT q, l.id, round(greatest(0.0, least(1.0, 0.40 * bm25 + 0.30 * cosine + 0.18 * score + CASE WHEN source = 'knowledge_page' THEN 0.04 ELSE 0.0 END + {PRIOR})), 9) AS sc,
           CASE WHEN coalesce(evidence_level, 'Other') IN ('Guideline', 'Meta-analysis', 'Review', 'Consensus') THEN 'overview' WHEN evidence_level = 'RCT' THEN 'causal' ELSE 'boundary' END AS role,
           topic, evidence_level AS level, text, record_id, row_number() OVER (PARTITION BY q ORDER BY sc DESC, l.id) AS rank
    FROM loc l JOIN documents d ON d.doc_id = l.id)"""

DOMAIN_LIST = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(safe), {_q(t)})" for t in terms) + f" THEN '{name}' END" for name, terms in V.DOMAINS.items()) + "], lambda d: d IS NOT NULL)"
CONCEPT = lambda c: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({c}), {_q(t)})" for t in terms) + f" THEN '{name}' END" for name, terms in V.CONCEPTS.items()) + "], lambda d: d IS NOT NULL)"
REDACT = "question"
for _p in V.PHI_PATTERNS:
    REDACT = f"regexp_replace({REDACT}, {_q(_p)}, {_q(V.PHI_MARK)}, 'g')"
ANY = lambda c, patterns: "(" + " OR ".join(f"regexp_matches({c}, {_q(p)})" for p in patterns) + ")"
HAS = lambda c, words: "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"
NAMED = "list_distinct(flatten([" + ", ".join(f"CASE WHEN {HAS('lower(safe)', words)} THEN {_text(types)} ELSE []::VARCHAR[] END" for words, types in V.EXPECTED_TYPES) + "]))"
# list_distinct keeps no order, so the few type names are listed in their vocabulary's order
TYPE_ORDER = ["Guideline", "Meta-analysis", "Review", "RCT", "ClinicalTrial"]
SPECS = f"""specs AS MATERIALIZED (
    SELECT q, original, safe, {DOMAIN_LIST} AS domains,
           CASE WHEN len({NAMED}) > 0 THEN list_filter({_text(TYPE_ORDER)}, lambda t: list_contains({NAMED}, t)) WHEN {HAS('lower(safe)', V.COMPARISON_TERMS)} THEN ['Meta-analysis', 'RCT'] ELSE []::VARCHAR[] END AS expected,
           {ANY('original', V.PHI_PATTERNS)} AS contains_phi, {ANY('safe', V.PERSONAL_PATTERNS)} AS personalized,
           ({HAS('lower(safe)', V.ANIMAL_TERMS)} OR len({DOMAIN_LIST}) = 0) AS out_of_scope, regexp_matches(original, {_q(V.UNVERIFIABLE)}) AS unverifiable, {HAS('lower(safe)', V.LATEST_TERMS)} AS needs_latest
    FROM (SELECT q, original, {REDACT.replace('question', 'original')} AS safe FROM (SELECT id AS q, trim(coalesce(min(question), '')) AS original FROM test_set GROUP BY id)))"""
ENTRIES = f"{RERANK}, {SPECS}, entries AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(record_id, '(?i)pmid:[0-9]{{5,9}}') THEN 'pmid:' || regexp_extract(record_id, '(?i)pmid:([0-9]{{5,9}})', 1) ELSE NULL END AS pm FROM rer)"
FAMILY = r"CASE WHEN regexp_matches(record_id, '(?i)\bNCT[0-9]{8}\b') THEN 'trial:' || upper(regexp_extract(record_id, '(?i)\b(NCT[0-9]{8})\b', 1)) WHEN pm IS NOT NULL THEN pm WHEN regexp_matches(record_id, '(?i)\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+') THEN 'doi:' || lower(regexp_replace(regexp_extract(record_id, '(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)', 1), '[.,)]+$', '')) ELSE lower(record_id) END"
CANONICAL = FAMILY.replace("pm IS NOT NULL THEN pm", "FALSE THEN NULL").replace("'trial:'", "'nct:'")
CANONICAL = r"CASE WHEN regexp_matches(record_id, '(?i)pmid[:/][0-9]{5,9}') THEN 'pmid:' || regexp_extract(record_id, '(?i)pmid[:/]([0-9]{5,9})', 1) ELSE " + CANONICAL + " END"
OWN = r"CASE WHEN source = 'knowledge_page' THEN 'page:' || record_id WHEN regexp_matches(record_id, '(?i)pmid[:/][0-9]{5,9}') THEN 'document:pmid:' || regexp_extract(record_id, '(?i)pmid[:/]([0-9]{5,9})', 1) WHEN regexp_matches(record_id, '(?i)\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+') THEN 'document:doi:' || lower(regexp_replace(regexp_extract(record_id, '(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)', 1), '[.,)]+$', '')) ELSE 'document:' || " + CANONICAL + " END"
HASH = lambda c: f"sha256({norm(c)})"
POOL = f"pool AS (SELECT title, coalesce(topic, '') AS q, record_id AS id, {OWN} AS identity, text, source, round(n_chars / 1000.0::DOUBLE, 6) AS score, coalesce(nlm_unique_id, '') AS family, doc_id AS pos FROM documents)"
NUMBERS = lambda c: rf"list_distinct(list_transform(list_transform(regexp_extract_all({c}, '(?:^|[^A-Za-z0-9_.])([0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?(?:\s*%)?)', 1), lambda n: regexp_replace(n, '[,\s]', '', 'g')), lambda n: CASE regexp_replace(n, '^0+', '') WHEN '' THEN '0' WHEN '%' THEN '0%' ELSE regexp_replace(n, '^0+', '') END))"
DISTRIBUTION = lambda c: f"SELECT coalesce(trim({c}), '') AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share, '{c}' AS field FROM documents GROUP BY 1"
BLANKS = r"trim(lower(split), ' ')"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
UNITS = "units AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
TOPIC_SCORE = lambda words: " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}.0" for w in words)
BINARY = f"""{BASE}, rel AS (SELECT DISTINCT q, id FROM (SELECT id AS q, unnest(relevant_doc_ids) AS id FROM test_set) JOIN (SELECT id AS q FROM golden) USING (q)),
    tot AS (SELECT q, count(*) AS n_relevant FROM rel GROUP BY q)"""
CLAIMS = """c0 AS (SELECT id, min({'q': question, 'r': relevant_doc_ids, 'e': expected_key_points}) AS x FROM test_set GROUP BY id), c1 AS (SELECT id, x.r AS r, list_concat([x.q], list_filter(coalesce(x.e, []), lambda e: e <> x.q)) AS t FROM c0),
    claims AS (SELECT id AS q, id || '/' || (i - 1) AS claim_id, t[i] AS claim, r FROM c1, unnest(range(1, len(t) + 1)) AS u(i))"""


def quantities(c: str) -> str:
    """Distinct 'number unit' strings; marks before numbers stand for the look-behind, which this SQL has not."""
    marked = rf"regexp_replace({c}, '(^|[^A-Za-z0-9_.])([0-9])', '\1' || chr(1) || chr(1) || '\2', 'g')"
    pattern = rf"(?i)\x01+([0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?)\s*({V.UNITS})(?:[^a-z]|$)"
    found = lambda i: f"regexp_extract_all({marked}, '{pattern}', {i})"
    return f"list_distinct(list_transform(list_zip({found(1)}, {found(2)}), lambda z: regexp_replace(replace(z[1], ',', ''), '^0+([0-9.])', '\\1') || ' ' || lower(z[2])))"


def clause_list(c: str) -> str:
    """Clauses as {p: predicate, n: negated}; words are marked, so that a denial in Latin letters must be a whole word."""
    words = rf"regexp_replace({c}, '([\pL\pN\pM_]+)', chr(2) || '\1' || chr(3), 'g')"
    denial = r"(?i)未能|未|不|没有|无|不能|\x02(?:not|no|never|without)\x03"
    blank = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000},，:：\x02\x03]"
    return rf"list_filter(list_transform(regexp_split_to_array({words}, '[。！？.!?;；\n]'), lambda k: {{'p': lower(regexp_replace(regexp_replace(k, '{denial}', '', 'g'), '{blank}', '', 'g')), 'n': regexp_matches(k, '{denial}')}}), lambda k: k.p <> '')"


ADDRESSED = r"regexp_matches(record_id, '(?i)^(?:pmid|nct|doi):')"
EVIDENCE = "concat_ws(' ', nullif(title, ''), published_year::VARCHAR, nullif(text, ''))"
VERIFIED = f"""{CLAIMS}, spread AS (SELECT DISTINCT q, claim_id, claim, citation FROM (SELECT q, claim_id, claim, unnest(CASE WHEN len(r) > 0 THEN r ELSE [NULL]::BIGINT[] END) AS citation FROM claims)),
    d AS (SELECT doc_id, coalesce(text, '') AS body, {EVIDENCE} AS evidence, CASE WHEN source = 'knowledge_page' THEN 'unverified' WHEN {ADDRESSED} AND (regexp_matches({CANONICAL}, '^(?:pmid:[0-9]{{5,9}}|nct:NCT[0-9]{{8}})$') OR NOT regexp_matches({CANONICAL}, '^(?:pmid|nct):')) THEN 'source_record' ELSE 'unverified' END AS existence FROM documents),
    near AS MATERIALIZED (SELECT s.*, d.doc_id IS NOT NULL AS mapped, body, coalesce(existence, 'not_checked') AS existence, {NUMBERS('coalesce(claim, $$$$)')} AS na, {NUMBERS('evidence')} AS nb, {quantities('coalesce(claim, $$$$)')} AS qa, {quantities('evidence')} AS qb,
        list_distinct({tokens('coalesce(claim, $$$$)')}) AS ta, list_distinct({tokens('evidence')}) AS tb, {clause_list('coalesce(claim, $$$$)')} AS ca, {clause_list('body')} AS cb FROM spread s LEFT JOIN d ON d.doc_id = s.citation),
    judged AS MATERIALIZED (SELECT *, mapped AND len(list_filter(na, lambda x: NOT list_contains(nb, x))) = 0 AND len(list_filter(qa, lambda x: NOT list_contains(qb, x))) = 0 AS numbers_agree,
        len(list_filter(ca, lambda x: length(x.p) >= 4 AND list_contains(cb, {{'p': x.p, 'n': NOT x.n}}))) > 0 AS denied, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / len(ta)::DOUBLE ELSE 0 END AS overlap FROM near),
    labelled AS (SELECT *, CASE WHEN NOT mapped OR NOT numbers_agree THEN 'unsupported' WHEN trim(coalesce(claim, ''), ' ') = trim(body, ' ') THEN 'support' WHEN denied THEN 'unsupported' WHEN overlap >= {V.SUPPORT} THEN 'support' WHEN overlap >= {V.PARTIAL} THEN 'partial' ELSE 'unsupported' END AS support FROM judged),
    verified AS MATERIALIZED (SELECT *, mapped AND existence NOT IN ('unverified', 'not_checked') AND support = 'support' AND numbers_agree AS usable FROM labelled)"""

KNOWN = "safe"
for _alias in (a for _names in V.CONCEPTS.values() for a in sorted(_names, key=len, reverse=True)):
    KNOWN = f"regexp_replace({KNOWN}, {_q('(?i)' + _alias)}, ' ', 'g')"
CODES = rf"list_transform(list_filter(regexp_extract_all(regexp_replace({KNOWN}, '[^\x00-\x7F\pP\pS\pZ]', '_', 'g'), '\b([A-Za-z][A-Za-z0-9-]{{2,}})\b', 1), lambda w: NOT list_contains({_text(V.GENERIC_CODES)}, lower(w)) AND (upper(w) = w OR regexp_matches(w, '[0-9]'))), lambda w: lower(w))"
ASKED_PEOPLE = f"lower(array_to_string(regexp_extract_all(safe, {_q(V.POPULATION_FIELD)}, 1), ' '))"
PEOPLE = lambda name, words: f"(NOT {HAS(ASKED_PEOPLE, words)} OR ({HAS('main', words)}" + (f" AND NOT {HAS('main', V.NOT_PREGNANT)}" if name == "pregnancy" else "") + "))"
ANY_PEOPLE = "(" + " OR ".join(HAS(ASKED_PEOPLE, words) for words in V.POPULATIONS.values()) + ")"
COVERAGE = f"""held AS (SELECT e.q, e.id, s.safe, s.domains, coalesce(e.text, '') AS body, lower(split_part(coalesce(e.text, ''), '例外：', 1)) AS main, coalesce(list_contains(s.domains, e.topic), FALSE) AS dom FROM entries e JOIN specs s USING (q)),
    focus AS MATERIALIZED (SELECT *, {CONCEPT('safe')} AS asked, {CONCEPT('main')} AS there, list_concat({CODES}, regexp_extract_all(safe, {_q(V.NAMED_FOCUS)}, 1)) AS literals, {HAS('safe', V.DIET_PHRASES)} AND NOT contains(safe, '{V.INTERVENTION_FIELD}') AS broad FROM held),
    covered AS (SELECT *, CASE WHEN broad THEN list_has_any(asked, there) AND {HAS('main', V.DIET_WORDS)} ELSE len(list_filter(asked, lambda a: NOT list_contains(there, a))) = 0 END
        AND len(list_filter(literals, lambda l: NOT contains(main, l))) = 0 AND {' AND '.join(PEOPLE(n, w) for n, w in V.POPULATIONS.items())} AS covers FROM focus),
    coverage AS MATERIALIZED (SELECT q, id, CASE WHEN covers AND CASE WHEN broad THEN dom WHEN len(asked) > 0 OR len(literals) > 0 OR {ANY_PEOPLE} THEN TRUE ELSE dom OR len(list_filter(domains, lambda x: contains(body, x))) > 0 END THEN 'direct' WHEN dom THEN 'background' ELSE 'none' END AS coverage FROM covered)"""


def oracle_sql() -> dict[str, str]:
    level = """CASE WHEN lower(coalesce(study_type, '')) = 'preprint' THEN 'preprint' ELSE CASE lower(study_type) WHEN 'meta-analysis' THEN 'Meta-analysis' WHEN 'guideline' THEN 'Guideline' WHEN 'practice guideline' THEN 'Guideline'
        WHEN 'randomized controlled trial' THEN 'RCT' WHEN 'consensus statement' THEN 'Consensus' WHEN 'consensus development conference' THEN 'Consensus' WHEN 'review' THEN 'Review' WHEN 'systematic review' THEN 'Review' ELSE 'Other' END END"""
    topic_cases = " ".join(f"WHEN {TOPIC_SCORE(words)} = best THEN '{name}'" for name, words in V.TOPIC_KEYWORDS.items())
    best = "greatest(" + ", ".join(TOPIC_SCORE(words) for words in V.TOPIC_KEYWORDS.values()) + ")"
    issue = lambda code, bad: f"SELECT '{code}' AS code, count(*) AS n, min(id) AS first_key FROM independent_synthetic_v1 WHERE {bad} HAVING count(*) > 0"
    return {
        "lexical_search": f"WITH {BASE} SELECT q, id, fused, bm25, cosine, score, rank FROM lex",
        "bm25_topk": f"WITH {BASE} SELECT q, id, bm25, rank FROM bmr",
        "tfidf_cosine_topk": f"WITH {BASE} SELECT q, id, cosine, rank FROM csr",
        "rrf_fusion": f"WITH {BASE} SELECT q, id, fused FROM fused",
        "fts_weighted_topk": f"""WITH {GOLDEN},
            qt AS MATERIALIZED (SELECT q, term, count(*)::DOUBLE AS qtf FROM (SELECT id AS q, unnest({tokens('question')}) AS term FROM golden) GROUP BY q, term),
            tk AS MATERIALIZED (SELECT doc_id AS id, {tokens("coalesce(title,'')")} AS a, {tokens("coalesce(text,'')")} AS b FROM documents),
            post AS MATERIALIZED (SELECT id, term, sum(x) AS tf FROM (SELECT id, unnest(a) AS term, 1.4::DOUBLE AS x FROM tk UNION ALL SELECT id, unnest(b), 1.0::DOUBLE FROM tk) GROUP BY id, term),
            sizes AS (SELECT id, len(a) * 1.4::DOUBLE + len(b) AS z FROM tk), shape AS (SELECT count(*)::DOUBLE AS n, greatest(avg(z), 1.0) AS avg_len FROM sizes),
            dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)
            SELECT q, p.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * z / avg_len))), 9) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, p.id) AS rank
            FROM qt JOIN dfs USING (term) JOIN post p USING (term) JOIN sizes s ON s.id = p.id, shape GROUP BY q, p.id QUALIFY rank <= 100""",
        "per_doc_cap": f"""WITH chosen AS (SELECT id, max({{'u': updated_at, 't': text, 'd': doc_id}}) AS x FROM chunks GROUP BY id),
            {scoring("items AS MATERIALIZED (SELECT id, " + tokens("coalesce(x.t, '')") + " AS toks FROM chosen)")},
            capped AS (SELECT b.q, b.id, c.x.d AS doc_id, b.rank AS before FROM bmr b JOIN chosen c USING (id) QUALIFY row_number() OVER (PARTITION BY b.q, c.x.d ORDER BY b.rank) <= 2)
            SELECT q, id, doc_id, row_number() OVER (PARTITION BY q ORDER BY before) AS rank FROM capped QUALIFY rank <= 14""",
        "dense_knn": f"""WITH {UNITS} SELECT a.id AS q, b.id, round({DOT.format(a='a.v', b='b.v')}, 9) AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, b.id) AS rank
            FROM units a, units b WHERE a.id % 100 = 0 QUALIFY rank <= 30""",
        "dense_multi_variant_rrf": f"""WITH {UNITS}, near AS (SELECT a.id - a.id % 100 AS q, a.id % 100 AS variant, b.id, round({DOT.format(a='a.v', b='b.v')}, 9) AS s, row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) AS rank
            FROM units a, units b WHERE a.id % 100 IN (0, 1) QUALIFY rank <= 30),
            r AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS f, max(s) AS best FROM near GROUP BY q, id), z AS (SELECT q, id, round(f / max(f) OVER (PARTITION BY q), 9) AS fused, best FROM r)
            SELECT q, id, fused, best, round(0.65 * fused + 0.35 * greatest(0.0, least(1.0, (best + 1) / 2)), 9) AS score, row_number() OVER (PARTITION BY q ORDER BY fused DESC, best DESC, id) AS rank FROM z QUALIFY rank <= 30""",
        "hybrid_fusion": f"""WITH {BASE}, every AS (SELECT q, id, rank, bm25 AS score FROM bmr WHERE rank <= 30 UNION ALL SELECT q, id, rank, cosine FROM csr WHERE rank <= 30),
            f AS (SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS f, max(score) AS best FROM every GROUP BY q, id), z AS (SELECT q, id, round(f / max(f) OVER (PARTITION BY q), 9) AS fz, best FROM f),
            o AS (SELECT q, z.id, coalesce(nlm_unique_id, '') AS doc, round(0.70 * fz + 0.30 * best, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY fz DESC, best DESC, z.id) AS before FROM z JOIN documents d ON d.doc_id = z.id),
            c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY q, doc ORDER BY before) <= 2)
            SELECT q, id, doc, row_number() OVER (PARTITION BY q ORDER BY before) AS rank, score FROM c QUALIFY rank <= 40""",
        "static_merge_dedupe": f"""WITH {BASE}, h AS (SELECT q, id, rank, 0 AS branch FROM bmr WHERE rank <= 25), t AS (SELECT q, id, rank, 1 AS branch FROM csr c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.q = c.q AND h.id = c.id))
            SELECT q, id, branch, row_number() OVER (PARTITION BY q ORDER BY branch, rank, id) AS rank FROM (SELECT * FROM h UNION ALL SELECT * FROM t) x QUALIFY rank <= 40""".replace("ORDER BY branch, rank, id", "ORDER BY branch, x.rank, id"),
        "pool_source_preserving": f"""WITH {POOL}, bad AS (SELECT identity FROM pool GROUP BY identity HAVING min({norm('title')}) <> max({norm('title')})),
            m AS (SELECT *, {HASH('text')} AS h, min(identity) OVER (PARTITION BY q, id) <> max(identity) OVER (PARTITION BY q, id) OR bool_or(identity IN (FROM bad)) OVER (PARTITION BY q, id) AS split FROM pool),
            v AS (SELECT *, row_number() OVER (PARTITION BY q, id, split ORDER BY score DESC, identity, h, source, id) AS version FROM m),
            c AS (SELECT *, row_number() OVER (PARTITION BY q, identity, h, (NOT split AND version = 1) ORDER BY score DESC, identity, h, source, id) AS copy FROM v)
            SELECT q, CASE WHEN split THEN 'identity_conflict' WHEN version > 1 THEN 'duplicate_id' WHEN copy > 1 THEN 'duplicate_text' ELSE 'retained' END AS reason, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM c GROUP BY 1, 2""",
        "pool_legacy": f"""WITH {POOL}, s AS (SELECT *, row_number() OVER (PARTITION BY q, substring({norm('text')}, 1, 600) ORDER BY pos, id) = 1 AS fresh FROM pool),
            v AS (SELECT *, row_number() OVER (PARTITION BY q, id, fresh ORDER BY score DESC, pos) AS version FROM s),
            c AS (SELECT *, row_number() OVER (PARTITION BY q, family, (fresh AND version = 1) ORDER BY (source = 'knowledge_page')::INT DESC, score DESC, length(text) DESC, pos, id) AS turn FROM v)
            SELECT q, CASE WHEN NOT fresh THEN 'text_prefix' WHEN version > 1 THEN 'duplicate_id' WHEN turn > 2 THEN 'family_cap' ELSE 'retained' END AS reason, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM c GROUP BY 1, 2""",
        "identity_conflicts": r"""SELECT DISTINCT identity FROM (SELECT regexp_extract(record_id, '(\d+)$', 1) AS identity, 'j' AS kind, journal AS value FROM documents UNION ALL SELECT regexp_extract(record_id, '(\d+)$', 1), 'y', published_year::VARCHAR FROM documents UNION ALL SELECT regexp_extract(record_id, '(\d+)$', 1), 't', """ + norm("title") + r""" FROM documents)
            WHERE value IS NOT NULL GROUP BY identity, kind HAVING min(value) <> max(value)""",
        "independent_sources": r"""WITH RECURSIVE k AS (SELECT coalesce(topic, '') AS q, doc_id AS item, 'r' || regexp_extract(record_id, '(\d+)$', 1) AS key FROM documents UNION SELECT coalesce(topic, ''), doc_id, 't' || title FROM documents WHERE title IS NOT NULL),
            e AS (SELECT DISTINCT a.q, a.item AS u, b.item AS v FROM k a JOIN k b ON a.q = b.q AND a.key = b.key), reach(q, a, b) AS (SELECT q, u, v FROM e UNION SELECT r.q, r.a, e.v FROM reach r JOIN e ON e.q = r.q AND e.u = r.b)
            SELECT q, count(DISTINCT root) AS n_sources FROM (SELECT q, a, min(b) AS root FROM reach GROUP BY q, a) GROUP BY q""",
        "rerank_blend": f"WITH {RERANK} SELECT q, id, rank, sc AS score, role FROM rer WHERE rank <= 8",
        "query_spec": f"WITH {SPECS} SELECT q, sha256(safe) AS safe_hash, array_to_string(domains, '|') AS domains, array_to_string(expected, '|') AS expected_types, contains_phi, personalized, out_of_scope, unverifiable, needs_latest FROM specs",
        "safety_gate": f"WITH {SPECS} SELECT q, CASE WHEN contains_phi THEN 'PHI_BLOCKED' WHEN personalized THEN 'PERSONALIZED_TREATMENT' WHEN out_of_scope THEN 'OUT_OF_SCOPE' WHEN unverifiable THEN 'UNVERIFIABLE_INTERVENTION' END AS code FROM specs",
        "coverage_partition": f"WITH {ENTRIES}, {COVERAGE} SELECT q, id, coverage FROM coverage",
        "evidence_gate": f"""WITH {ENTRIES}, p AS (SELECT q, count(*) AS n, max(CASE WHEN rank = 1 THEN sc END) AS top, list(DISTINCT topic) FILTER (WHERE rank <= 3 AND topic <> '') AS topics, count(DISTINCT CASE WHEN regexp_matches({FAMILY}, '^(?:pmid:[0-9]{{5,9}}|trial:NCT[0-9]{{8}}|doi:10[.].*/.*)$') THEN {FAMILY} END) AS sources,
                list_sort(list(DISTINCT nullif(level, '')) FILTER (WHERE nullif(level, '') IS NOT NULL)) AS levels, bool_or(rank <= 5 AND {HAS("lower(coalesce(text, ''))", V.CONFLICT_MARKERS)}) AS conflict FROM entries WHERE rank <= 8 GROUP BY q)
            SELECT s.q, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_EVIDENCE' WHEN top < 0.18 OR (len(domains) > 0 AND NOT list_has_any(domains, coalesce(topics, []::VARCHAR[]))) THEN 'LOW_RELEVANCE' WHEN sources < 3 THEN 'INSUFFICIENT_SOURCES'
                WHEN len(expected) > 0 AND NOT list_has_any(expected, levels) THEN 'MISSING_EVIDENCE_TYPE' WHEN conflict THEN 'UNRESOLVED_CONFLICT' END AS code, coalesce(n, 0) AS n_entries, coalesce(sources, 0) AS n_sources, coalesce(array_to_string(levels, '|'), '') AS levels
            FROM specs s JOIN (SELECT id AS q FROM golden) USING (q) LEFT JOIN p USING (q)""",
        "claim_overlap": f"""WITH {CLAIMS}, s AS (SELECT DISTINCT claim_id, claim, unnest(r) AS citation FROM claims), t AS (SELECT claim_id, citation, list_distinct({tokens('claim')}) AS a, list_distinct({tokens("concat_ws(' ', title, text)")}) AS b FROM s JOIN documents d ON d.doc_id = citation)
            SELECT claim_id, citation, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END, 6) AS overlap FROM t""",
        "claim_verify": f"WITH {VERIFIED} SELECT claim_id, citation, mapped, existence, support, numbers_agree, usable FROM verified",
        "sanitize_claims": f"WITH {VERIFIED} SELECT claim_id, claim AS text, array_to_string(list_sort(list(DISTINCT citation)), '|') AS citations FROM verified WHERE usable GROUP BY 1, 2",
        "answer_failure": f"""WITH {VERIFIED}, k AS (SELECT q, claim_id, count(citation) AS n, count(*) FILTER (WHERE usable) AS u FROM verified GROUP BY 1, 2)
            SELECT q AS id, count(*) AS n_claims, count(*) FILTER (WHERE u > 0) AS n_kept, round(avg((u = 0)::INT::DOUBLE), 9) AS failure_ratio, sum(n - u)::BIGINT AS n_removed, bool_and(u > 0) AND sum(n - u) = 0 AS valid FROM k GROUP BY 1""",
        "numeric_consistency": f"""WITH c AS (SELECT DISTINCT id, doc_id, text AS claim FROM chunks WHERE text IS NOT NULL), n AS (SELECT id, {NUMBERS('claim')} AS a, {NUMBERS('d.text')} AS b FROM c JOIN documents d USING (doc_id))
            SELECT id, min((len(list_filter(a, lambda v: NOT list_contains(b, v))) = 0)::INT) AS numbers_agree FROM n GROUP BY id""",
        "recall_mrr_ndcg": f"""WITH {BINARY}, hit AS (SELECT q, count(*) FILTER (WHERE rank <= 8) AS hits, min(rank) AS f, sum(CASE WHEN rank <= 8 THEN 3.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM lex JOIN rel USING (q, id) GROUP BY q)
            SELECT q, n_relevant, round(coalesce(hits, 0) / n_relevant::DOUBLE, 9) AS recall, round(coalesce(1.0::DOUBLE / f, 0), 9) AS reciprocal_rank,
                round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 8) + 1), lambda i: 3.0::DOUBLE / log2(i + 1))), 9) AS ndcg FROM tot LEFT JOIN hit USING (q)""",
        "graded_metrics": f"""WITH {BINARY}, ont AS (SELECT DISTINCT id AS q, unnest(relevant_topics) AS topic FROM test_set),
            g AS (SELECT q, id, max(grade) AS grade FROM (SELECT l.q, l.id, (o.topic IS NOT NULL)::INT AS grade FROM lex l JOIN documents d ON d.doc_id = l.id LEFT JOIN ont o ON o.q = l.q AND o.topic = d.topic WHERE d.topic <> '' UNION ALL SELECT q, id, 3 FROM rel) GROUP BY q, id),
            h AS (SELECT l.q, count(*) FILTER (WHERE grade IS NULL) AS n_unjudged, count(*) FILTER (WHERE grade >= 2) AS hits, min(rank) FILTER (WHERE grade >= 2) AS f, sum(coalesce((pow(2.0, grade) - 1) / log2(rank + 1), 0)) AS dcg FROM lex l LEFT JOIN g USING (q, id) WHERE rank <= 8 GROUP BY l.q),
            i AS (SELECT q, count(*) FILTER (WHERE grade >= 2) AS total_relevant, sum(CASE WHEN r <= 8 THEN (pow(2.0, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, id) AS r FROM g) GROUP BY q),
            s AS (SELECT q, coalesce(hits, 0) AS hits, coalesce(total_relevant, 0) AS total_relevant, 0::BIGINT AS n_duplicates, coalesce(n_unjudged, 0) AS n_unjudged, coalesce(f, 0) AS f, coalesce(dcg, 0) AS dcg, idcg,
                CASE WHEN coalesce(n_unjudged, 0) > 0 THEN 'unjudged_candidates' WHEN coalesce(total_relevant, 0) = 0 THEN 'no_relevant_qrels' ELSE 'scored' END AS status FROM h FULL JOIN i USING (q))
            SELECT q, status, hits, total_relevant, n_duplicates, n_unjudged, CASE WHEN status = 'scored' THEN round(hits / total_relevant::DOUBLE, 9) END AS recall, CASE WHEN status = 'scored' THEN round(hits / least(total_relevant, 8)::DOUBLE, 9) END AS completion,
                CASE WHEN status = 'scored' THEN round(CASE WHEN f > 0 THEN 1.0::DOUBLE / f ELSE 0 END, 9) END AS mrr, CASE WHEN status = 'scored' THEN round(dcg / idcg, 9) END AS ndcg FROM s""",
        "key_point_coverage": f"""WITH p AS (SELECT DISTINCT q, point, r FROM (SELECT id AS q, unnest(expected_key_points) AS point, relevant_doc_ids AS r FROM test_set)), c AS (SELECT q, point, unnest(r) AS doc_id FROM p),
            h AS (SELECT q, point, max((len(list_intersect(list_distinct({tokens('point')}), list_distinct({tokens('text')}))) > 0)::INT)::DOUBLE AS hit FROM c JOIN documents USING (doc_id) GROUP BY q, point)
            SELECT q, count(*) AS n_points, round(avg(coalesce(hit, 0)), 6) AS coverage FROM (SELECT DISTINCT q, point FROM p) LEFT JOIN h USING (q, point) GROUP BY q""",
        "slice_grouping_sets": """WITH d AS (SELECT coalesce(topic, '') AS topic, coalesce(evidence_level, '') AS evidence_level, n_chars::DOUBLE AS n_chars, page_count::DOUBLE AS page_count FROM documents)
            SELECT 'topic' AS dimension, topic AS value, count(*) AS n, round(avg(n_chars), 6) AS mean_n_chars, round(avg(page_count), 6) AS mean_page_count FROM d GROUP BY topic
            UNION ALL SELECT 'evidence_level', evidence_level, count(*), round(avg(n_chars), 6), round(avg(page_count), 6) FROM d GROUP BY evidence_level UNION ALL SELECT 'all', NULL, count(*), round(avg(n_chars), 6), round(avg(page_count), 6) FROM d""",
        "latency_quantiles": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type",
        "arm_summary": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS n_slow, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean_value, max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k FROM events GROUP BY event_type",
        "question_macro": """WITH p AS (SELECT rubric_version, question_id, count(labels.support_rate) AS valid, avg(labels.support_rate) AS m FROM review_template GROUP BY 1, 2)
            SELECT rubric_version, count(*) AS n_questions, count(*) FILTER (WHERE valid < 1) AS n_excluded, CASE WHEN count(*) FILTER (WHERE valid < 1) = 0 THEN round(avg(CASE WHEN valid >= 1 THEN m END), 6) END AS macro_support FROM p GROUP BY 1""",
        "review_adjudication": """WITH l AS (SELECT item_id AS item, lower(trim(reviewer_id)) AS reviewer, max(lower(trim(labels.behavior))) AS label FROM review_template WHERE lower(trim(labels.behavior)) <> '' GROUP BY 1, 2),
            t AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY reviewer) AS turn FROM l), p AS (SELECT item, max(CASE WHEN turn = 1 THEN label END) AS a, max(CASE WHEN turn = 2 THEN label END) AS b, count(*) AS n_reviewers FROM t GROUP BY item),
            v AS (SELECT item, label, count(*) AS v FROM t WHERE turn > 2 GROUP BY 1, 2), w AS (SELECT item, max(label) AS c, count(*) AS tied FROM (SELECT * FROM v QUALIFY v = max(v) OVER (PARTITION BY item)) GROUP BY 1)
            SELECT item, a AS first, b AS second, CASE WHEN a = b THEN a WHEN b IS NOT NULL AND tied = 1 THEN c END AS final, CASE WHEN b IS NULL THEN 'single' WHEN a = b THEN 'agreed' WHEN tied = 1 THEN 'adjudicated' ELSE 'open' END AS status, n_reviewers FROM p LEFT JOIN w USING (item)""",
        "corpus_distribution": " UNION ALL ".join(DISTRIBUTION(c) for c in ("topic", "evidence_level", "extraction_status")),
        "corpus_gates": """SELECT source, count(*) AS n, round(avg(CASE WHEN extraction_status = 'full_text' THEN 1.0::DOUBLE ELSE 0 END), 6) AS full_text_share, round(avg(CASE WHEN n_chars >= 300 THEN 1.0::DOUBLE ELSE 0 END), 6) AS long_share,
            round(avg(CASE WHEN n_chars = length(text) THEN 1.0::DOUBLE ELSE 0 END), 6) AS length_agrees, min(published_year) AS first_year, max(published_year) AS last_year, count(DISTINCT topic) AS n_topics FROM documents GROUP BY source""",
        "orphan_anti_join": "SELECT question_id, count(*) AS n FROM review_template r WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.id = r.question_id) GROUP BY question_id",
        "index_except_check": "SELECT 'left' AS side, count(*) AS n FROM (SELECT id FROM questions EXCEPT SELECT id FROM independent_synthetic_v1) UNION ALL SELECT 'right', count(*) FROM (SELECT id FROM independent_synthetic_v1 EXCEPT SELECT id FROM questions)",
        "duplicate_ids": "SELECT id, count(*) AS n FROM chunks WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
        "leakage_groups": f"SELECT lower(trim(question_group_id)) AS key, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT {BLANKS})), '|') AS splits FROM independent_synthetic_v1 WHERE question_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {BLANKS}) > 1",
        "leakage_text": f"SELECT {HASH('question')} AS key, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT {BLANKS})), '|') AS splits FROM independent_synthetic_v1 WHERE question IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {BLANKS}) > 1",
        "ancestor_closure": """WITH RECURSIVE l AS (SELECT DISTINCT id, unnest(derived_from) AS parent FROM questions), c(id, ancestor, distance) AS (SELECT id, parent, 1 FROM l WHERE parent IS NOT NULL UNION SELECT c.id, l.parent, c.distance + 1 FROM c JOIN l ON l.id = c.ancestor WHERE c.distance < 20 AND l.parent IS NOT NULL)
            SELECT id, ancestor, min(distance) AS distance FROM c GROUP BY id, ancestor""",
        "asset_issues": " UNION ALL ".join(
            [
                issue("split_unknown", "coalesce(split, '') NOT IN ('train', 'dev', 'blind', 'synthetic')"),
                issue("group_missing", "trim(coalesce(question_group_id, '')) = ''"),
                issue("date_not_iso", r"try_cast(as_of_date AS DATE) IS NULL OR NOT regexp_matches(coalesce(as_of_date, ''), '^\d{4}-\d{2}-\d{2}$')"),
                issue("hash_not_sha256", "NOT regexp_matches(coalesce(corpus_manifest_hash, ''), '^[0-9a-f]{64}$')"),
                issue("refusal_without_code", "expected_behavior = 'refuse' AND len(allowed_refusal_codes) = 0"),
                issue("code_without_refusal", "expected_behavior <> 'refuse' AND len(allowed_refusal_codes) > 0"),
            ]
        ),
        "snapshot_publish": """WITH q AS (SELECT DISTINCT id, topic, language, expected_behavior, annotation_status, updated_at FROM questions WHERE updated_at IS NOT NULL AND id IS NOT NULL), c AS (SELECT *, min(updated_at) OVER (PARTITION BY id) AS f, max(updated_at) OVER (PARTITION BY id) AS l FROM q),
            a AS (SELECT id, {'t': topic, 'l': language, 'e': expected_behavior, 's': annotation_status} AS o FROM c WHERE updated_at = f AND f < TIMESTAMPTZ '2025-01-01 00:00:00+00'), b AS (SELECT id, {'t': topic, 'l': language, 'e': expected_behavior, 's': annotation_status} AS n FROM c WHERE updated_at = l AND l >= TIMESTAMPTZ '2024-06-01 00:00:00+00')
            SELECT count(*) FILTER (WHERE o IS NULL) AS n_inserted, count(*) FILTER (WHERE o <> n) AS n_updated, count(*) FILTER (WHERE o = n) AS n_unchanged, count(*) FILTER (WHERE n IS NULL) AS n_deactivated FROM a FULL JOIN b USING (id)""",
        "stale_deactivate": "SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01') AS is_active FROM customer",
        "superseded_runs": """WITH r AS (SELECT DISTINCT source, strftime(retrieved_at AT TIME ZONE 'UTC', '%Y-%m') AS started FROM documents WHERE retrieved_at IS NOT NULL)
            SELECT source, source || '/' || started AS run, started FROM r QUALIFY started < max(started) OVER (PARTITION BY source)""",
        "evidence_levels": f"""SELECT doc_id, {level} AS level, CASE WHEN study_type IS NULL THEN 'metadata_missing' WHEN {level} = 'Other' THEN 'unmapped_publication_type' ELSE 'metadata_mapped' END AS review_status FROM documents""",
        "canonical_ids": f"SELECT doc_id, {CANONICAL} AS canonical, CASE WHEN lower(record_id) LIKE 'pmid:%' THEN substring(record_id, 6) END AS pmid, CASE WHEN lower(record_id) LIKE 'nct:%' THEN substring(record_id, 5) END AS nct_id FROM documents",
        "detect_topic": f"SELECT doc_id, CASE WHEN best = 0 THEN '其他' {topic_cases} END AS detected FROM (SELECT doc_id, text, {best} AS best FROM documents WHERE text IS NOT NULL)",
        "tokenize_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL)",
        "doc_frequency": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY term",
        "text_hash_dedup": f"SELECT {HASH('text')} AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "sentence_counts": r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n_sentences FROM documents WHERE text IS NOT NULL",
        "number_sets": f"SELECT doc_id, len(n) AS n_numbers, sha256(array_to_string(list_sort(n), '|')) AS numbers_hash FROM (SELECT doc_id, {NUMBERS('text')} AS n FROM documents WHERE text IS NOT NULL)",
        "per_doc_ordinal": "SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS ordinal FROM (SELECT DISTINCT doc_id, id FROM chunks)",
        "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "nation_revenue": """SELECT r_name, n_name, count(*) AS n_items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
        "large_orders": "SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200",
        "customers_without_orders": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')",
        "weighted_median_year": """WITH p AS (SELECT source, published_year AS y, sum(n_chars) AS w FROM documents WHERE published_year IS NOT NULL AND n_chars > 0 GROUP BY 1, 2), r AS (SELECT source, y, sum(w) OVER (PARTITION BY source ORDER BY y) AS upto, sum(w) OVER (PARTITION BY source) / 2.0 AS half FROM p)
            SELECT source, min(y) AS median FROM r WHERE upto >= half GROUP BY source""",
        "ledger_reconcile": """WITH a AS (SELECT doc_id, min(nlm_unique_id) AS x FROM documents GROUP BY 1), b AS (SELECT doc_id, min(nlm_unique_id) AS y FROM chunks WHERE content_kind = 'full_text' AND doc_id IS NOT NULL GROUP BY 1)
            SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' WHEN x IS NOT DISTINCT FROM y THEN 'equal' ELSE 'differs' END AS status, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""",
        "run_row_checks": """WITH r AS (SELECT rubric_version, count(*) OVER w AS copies, min(concat_ws('|', output_hash, coalesce(labels.behavior, ''))) OVER w <> max(concat_ws('|', output_hash, coalesce(labels.behavior, ''))) OVER w AS differs FROM review_template WINDOW w AS (PARTITION BY item_id, reviewer_id))
            SELECT rubric_version, count(*) AS n, count(*) FILTER (WHERE copies > 1) AS n_void, count(*) FILTER (WHERE differs) AS n_differs FROM r GROUP BY 1""",
        "label_binding": """WITH l AS (SELECT id, min(expected_behavior) AS a, max(expected_behavior) AS b FROM independent_synthetic_v1 GROUP BY 1), r AS (SELECT question_id AS id, min(lower(labels.behavior)) AS c, max(lower(labels.behavior)) AS d FROM review_template WHERE labels.behavior IS NOT NULL GROUP BY 1)
            SELECT CASE WHEN r.id IS NULL THEN 'run_missing' WHEN l.id IS NULL THEN 'label_missing' WHEN a = b AND c = d AND a = c THEN 'bound' ELSE 'hash_mismatch' END AS status, count(*) AS n FROM l FULL JOIN r ON l.id = r.id GROUP BY 1""",
        "paired_bootstrap": """WITH g AS (SELECT l_suppkey AS g, sum(l_tax - l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT draw, d, n, (('0x' || substring(md5(g || '|' || draw || '|7'), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE AS u FROM g, range(1, 2001) AS t(draw)),
            p AS (SELECT list_transform(range(0, 8), lambda i: list_sum(list_transform(range(0, i + 1), lambda k: 0.36787944117144233::DOUBLE / factorial(k::INT)))) AS b), t AS (SELECT draw, d, n, len(list_filter(b, lambda x: u > x)) AS t FROM u, p), m AS (SELECT draw, sum(t * d) / sum(t * n) AS m FROM t GROUP BY draw)
            SELECT (SELECT count(*) FROM g) AS n_groups, (SELECT sum(n) FROM g)::BIGINT AS n_questions, (SELECT round(sum(d) / sum(n), 6) FROM g) AS mean_difference, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m""",
        "topk_document_diverse": f"""WITH RECURSIVE {ENTRIES}, e AS MATERIALIZED (SELECT q, id::VARCHAR AS id, sc, coalesce(CASE WHEN regexp_matches({FAMILY}, '^(?:pmid:[0-9]{{5,9}}|trial:NCT[0-9]{{8}}|doi:10[.].*/.*)$') THEN {FAMILY} END, '') AS family, {OWN} AS doc FROM (SELECT en.*, d.source FROM entries en JOIN documents d ON d.doc_id = en.id WHERE rank <= 40)),
            o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sc DESC, doc, id) AS r FROM e),
            wk(q, r, ids, docs, fams) AS (SELECT DISTINCT q, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM o
                UNION ALL SELECT q, r, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(docs, doc) ELSE docs END, CASE WHEN ok THEN list_append(fams, family) ELSE fams END
                FROM (SELECT wk.q, o.r, ids, docs, fams, o.id, o.doc, o.family, len(ids) < 8 AND NOT list_contains(docs, o.doc) AND (o.family = '' OR len(list_filter(fams, lambda f: f = o.family)) < 2) AS ok FROM wk JOIN o ON o.q = wk.q AND o.r = wk.r + 1) x),
            l AS (SELECT q, arg_max(ids, r) AS ids FROM wk GROUP BY q) SELECT q, ids[i] AS id, i AS citation_number FROM l, unnest(range(1, len(ids) + 1)) AS u(i)""",
        "polarity_conflicts": f"""WITH t AS (SELECT source, {clause_list("'not ' || coalesce(title, '')")} AS ca, {clause_list("coalesce(text, '')")} AS cb FROM documents)
            SELECT source, count(*) AS n, count(*) FILTER (WHERE len(list_filter(ca, lambda x: length(x.p) >= 4 AND list_contains(cb, {{'p': x.p, 'n': NOT x.n}}))) > 0) AS n_conflicts FROM t GROUP BY 1""",
        "repeat_consistency": "SELECT question_id, count(*) AS n, CASE WHEN count(*) > 1 THEN min(output_hash) = max(output_hash) END AS consistent FROM review_template WHERE output_hash IS NOT NULL GROUP BY 1",
        "metric_gates": " UNION ALL ".join(
            f"SELECT '{m}' AS metric, b AS baseline, c AS candidate, c >= b AS passed FROM (SELECT round(avg(labels.{m}) FILTER (WHERE rubric_version = 'dual-review-v1'), 6) AS b, round(avg(labels.{m}) FILTER (WHERE rubric_version = 'dual-review-v2'), 6) AS c FROM review_template)"
            for m in ("support_rate", "key_point_coverage", "numeric_correctness", "refusal_quality")
        ),
        "blind_aliases": "SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY sha256('blind-7|' || question_id || '|' || item_id), item_id) AS alias FROM (SELECT DISTINCT question_id, item_id FROM review_template WHERE item_id IS NOT NULL)",
        "degraded_profile": f"WITH {RERANK} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank DESC) AS rank FROM rer WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY q ORDER BY rer.rank DESC) <= 8".replace("ORDER BY rank DESC) AS rank", "ORDER BY rer.rank DESC) AS rank").replace("WHERE rank <= 40 QUALIFY", "WHERE rer.rank <= 40 QUALIFY"),
        "rerank_local": f"WITH {LOCAL} SELECT q, id, bm25, cosine FROM loc",
        "excerpt_positions": f"""WITH c AS (SELECT DISTINCT id, doc_id, text AS excerpt FROM chunks WHERE text IS NOT NULL)
            SELECT id, max(CASE WHEN regexp_replace(excerpt, '{WS}', '', 'g') = '' THEN 0 ELSE coalesce(strpos(regexp_replace(text, '{WS}', '', 'g'), regexp_replace(excerpt, '{WS}', '', 'g')), 0) END) AS position FROM c JOIN documents USING (doc_id) GROUP BY id""",
        "recent_order_exists": "SELECT o_custkey, count(*) AS n_overtaken FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate > o.o_orderdate) GROUP BY o_custkey",
    }
