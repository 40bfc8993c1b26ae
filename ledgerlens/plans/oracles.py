"""Independent SQL (DuckDB dialect) for every registered query.

The stand-in derivations of ``sources/standins.py`` are restated here as CTEs
so that the oracle shares no code with the Spark plans.
"""

from __future__ import annotations

from ..sources.standins import REFUSAL_PHRASES


def _ts(s: str) -> str:
    return f"TIMESTAMP '{s}'"


_REV = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))"
_PROFIT = f"({_REV}) * CAST(l_discount AS DECIMAL(15,2))"


def _period_sum(expr: str, lo: str, hi: str) -> str:
    return f"SUM(CASE WHEN l_shipdate >= {_ts(lo)} AND l_shipdate < {_ts(hi)} THEN {expr} END)"


COMPANIES_CTE = f"""
facts AS (
  SELECT l_suppkey,
    {_period_sum(_REV, '2000-01-01', '2000-07-01')} AS r_h1_25,
    {_period_sum(_PROFIT, '2000-01-01', '2000-07-01')} AS p_h1_25,
    {_period_sum(_REV, '1999-07-01', '2000-07-01')} AS r_fy_25,
    {_period_sum(_PROFIT, '1999-07-01', '2000-07-01')} AS p_fy_25,
    {_period_sum(_REV, '1999-01-01', '1999-07-01')} AS r_h1_24,
    {_period_sum(_PROFIT, '1999-01-01', '1999-07-01')} AS p_h1_24,
    {_period_sum(_REV, '1998-07-01', '1999-07-01')} AS r_fy_24,
    {_period_sum(_PROFIT, '1998-07-01', '1999-07-01')} AS p_fy_24,
    SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS price_sum,
    COUNT(*) AS price_n
  FROM lineitem
  WHERE l_shipdate >= {_ts('1998-07-01')} AND l_shipdate < {_ts('2000-07-01')}
  GROUP BY l_suppkey
),
cbase AS (
  SELECT s_suppkey AS row_id, s_name AS company_name,
    CAST(s_suppkey AS VARCHAR) AS company_code, n_name AS industry,
    'Supplier based in ' || n_name || ', ' || r_name AS description,
    'Region: ' || r_name AS additional_info,
    'www.' || lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '.com.au' AS website,
    CAST(NULL AS VARCHAR) AS asx_page,
    s_acctbal AS equity,
    CAST(1 + s_suppkey % 50 AS DOUBLE) AS shares_mn,
    CAST(ROUND(r_h1_25, 2) AS DOUBLE) AS rev_h1_2025,
    CAST(ROUND(r_h1_24, 2) AS DOUBLE) AS rev_h1_2024,
    CAST(ROUND(p_h1_25, 2) AS DOUBLE) AS profit_h1_2025,
    CAST(ROUND(p_h1_24, 2) AS DOUBLE) AS profit_h1_2024,
    CAST(ROUND(r_fy_25, 2) AS DOUBLE) AS rev_fy_2025,
    CAST(ROUND(r_fy_24, 2) AS DOUBLE) AS rev_fy_2024,
    CAST(ROUND(p_fy_25, 2) AS DOUBLE) AS profit_fy_2025,
    CAST(ROUND(p_fy_24, 2) AS DOUBLE) AS profit_fy_2024,
    CAST(price_sum AS DOUBLE) / NULLIF(CAST(price_n AS DOUBLE), 0) / 1000.0 AS market_price
  FROM supplier
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN facts ON s_suppkey = l_suppkey
),
cratio AS (
  SELECT *,
    (rev_h1_2025 - rev_h1_2024) / NULLIF(rev_h1_2024, 0) * 100.0 AS rev_h1_change,
    (profit_h1_2025 - profit_h1_2024) / NULLIF(profit_h1_2024, 0) * 100.0 AS profit_h1_change,
    (rev_fy_2025 - rev_fy_2024) / NULLIF(rev_fy_2024, 0) * 100.0 AS rev_fy_change,
    (profit_fy_2025 - profit_fy_2024) / NULLIF(profit_fy_2024, 0) * 100.0 AS profit_fy_change,
    profit_h1_2025 / NULLIF(shares_mn, 0) AS eps_h1_2025,
    profit_h1_2024 / NULLIF(shares_mn, 0) AS eps_h1_2024,
    equity / NULLIF(shares_mn, 0) AS bvps
  FROM cbase
),
companies AS (
  SELECT row_id, company_name, company_code, industry, description, additional_info,
    website, asx_page,
    rev_h1_2025, rev_h1_2024, rev_h1_change,
    profit_h1_2025, profit_h1_2024, profit_h1_change,
    rev_fy_2025, rev_fy_2024, rev_fy_change,
    profit_fy_2025, profit_fy_2024, profit_fy_change,
    equity, shares_mn, market_price, eps_h1_2025, eps_h1_2024,
    market_price / NULLIF(eps_h1_2025, 0) AS pe, bvps,
    market_price / NULLIF(bvps, 0) AS pb
  FROM cratio
)"""


def _top5(order: str) -> str:
    return f"""WITH {COMPANIES_CTE}
SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY {order} DESC NULLS LAST, row_id) AS INTEGER) AS rank,
    row_id, company_name, rev_fy_2024, rev_fy_2025,
    greatest(rev_fy_2024, rev_fy_2025) AS max_revenue
  FROM companies) t
WHERE rank <= 5"""



QUESTIONS_CTE = f"""
questions AS (
  SELECT conv_id * 4294967296 + turn AS question_id, conv_id AS session_id, turn,
    text || CASE conv_id % 6
      WHEN 0 THEN ' chart revenue 2024'
      WHEN 1 THEN ' plot'
      WHEN 2 THEN ' visualize ' || coalesce(s_name, '') || ' 2025'
      WHEN 3 THEN ''
      WHEN 4 THEN ' ' || coalesce(s_name, '')
      ELSE ' graph 2024 and 2025 for ' || coalesce(s_name, '') END AS question
  FROM conversations LEFT JOIN supplier
    ON (conv_id * 7919 + turn) % (SELECT count(*) FROM supplier) = s_suppkey
  WHERE role = 'user'
)"""

_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in REFUSAL_PHRASES) + "]"


def _outkb(k: int) -> str:
    n = len(REFUSAL_PHRASES)
    null3 = "WHEN conv_id % 11 = 0 THEN CAST(NULL AS VARCHAR)" if k == 3 else ""
    return (f"CASE WHEN conv_id % 7 = 0 THEN '' "
            f"WHEN (conv_id + {k}) % 4 = 0 THEN {_PHRASES}[((conv_id + turn + {k}) % {n}) + 1] "
            f"{null3} ELSE gold END")


SHEETS_CTE = f"""
conv_next AS (
  SELECT conv_id, turn, role, text,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
    lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn
  FROM conversations
),
pairs AS (
  SELECT conv_id, turn, text AS query, next_text AS gold FROM conv_next
  WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1
),
sheets AS (
  SELECT CASE conv_id % 3 WHEN 0 THEN 'Known' WHEN 1 THEN 'Infered' ELSE 'Out-of-KB' END AS sheet,
    conv_id * 4294967296 + turn AS row_id, query, s_name AS expected_company, gold,
    CASE WHEN conv_id % 3 = 2 THEN {_outkb(1)}
         WHEN conv_id % 13 = 0 THEN CAST(NULL AS VARCHAR) ELSE query END AS pred_k1,
    CASE WHEN conv_id % 3 = 2 THEN {_outkb(3)} ELSE gold || ' ' || query END AS pred_k3,
    CASE WHEN conv_id % 3 = 2 THEN {_outkb(5)} ELSE gold END AS pred_k5
  FROM pairs LEFT JOIN supplier
    ON conv_id * 7919 % (SELECT count(*) FROM supplier) = s_suppkey
)"""


ORACLES: dict[str, str] = {
    "company_financials": f"WITH {COMPANIES_CTE} SELECT * FROM companies",
    "top5_2025": _top5("rev_fy_2025"),
    "top5_2024": _top5("rev_fy_2024"),
    "top5_max": _top5("greatest(rev_fy_2024, rev_fy_2025)"),
    "questions": f"WITH {QUESTIONS_CTE} SELECT * FROM questions",
    "eval_sheets": f"WITH {SHEETS_CTE} SELECT * FROM sheets",
}


DIRECTORY_CTE = """
drows AS (
  SELECT o_orderkey AS row_id, c_name AS company_name,
    'C' || CAST(c_custkey AS VARCHAR) AS company_code, c_mktsegment AS industry,
    CASE WHEN o_orderstatus = 'P' THEN ''
         ELSE 'Customer with order status ' || o_orderstatus || ', priority ' || o_orderpriority
    END AS description
  FROM orders JOIN customer ON o_custkey = c_custkey
),
ddedup AS (
  SELECT row_id, company_name, company_code, industry, description FROM (
    SELECT *, row_number() OVER (PARTITION BY company_code, company_name ORDER BY row_id) AS rn
    FROM drows) t WHERE rn = 1
),
doverrides AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS company_code,
    'Account in debit (' || c_mktsegment || ')' AS short_description
  FROM customer WHERE c_acctbal < 0
),
directory AS (
  SELECT d.row_id, d.company_name, d.company_code, d.industry, d.description,
    coalesce(o.short_description, d.description) AS short_description
  FROM ddedup d LEFT JOIN doverrides o ON d.company_code = o.company_code
),
dsearch AS (
  SELECT * FROM directory WHERE
    coalesce(contains(lower(company_name), 'building'), false)
    OR coalesce(contains(lower(company_code), 'building'), false)
    OR coalesce(contains(lower(industry), 'building'), false)
    OR coalesce(contains(lower(description), 'building'), false)
    OR coalesce(contains(lower(short_description), 'building'), false)
)"""

_CHART = "(" + " OR ".join(f"contains(lower(question), '{k}')" for k in
                           ("chart", "plot", "graph", "visualize")) + ")"

ROUTE_CTE = f"""
routed AS (
  SELECT question_id, question, {_CHART} AS is_chart,
    contains(question, '2024') OR NOT (contains(question, '2024') OR contains(question, '2025')) AS show_2024,
    contains(question, '2025') OR NOT (contains(question, '2024') OR contains(question, '2025')) AS show_2025
  FROM questions
),
routes AS (
  SELECT *, CASE WHEN show_2024 AND show_2025 THEN 'both' WHEN show_2025 THEN '2025' ELSE '2024' END AS mode
  FROM routed
),
cnames AS (
  SELECT company_name AS name, min(row_id) AS first_row FROM companies
  WHERE company_name IS NOT NULL GROUP BY company_name
),
detected AS (
  SELECT question_id, arg_min(name, first_row) AS company
  FROM questions LEFT JOIN cnames ON contains(lower(question), lower(name))
  GROUP BY question_id
),
req AS (
  SELECT r.question_id, d.company, r.show_2024, r.show_2025, r.mode
  FROM routes r JOIN detected d ON r.question_id = d.question_id WHERE r.is_chart
),
cand AS (
  SELECT q.question_id, c.row_id, c.company_name, c.rev_fy_2024, c.rev_fy_2025,
    CASE q.mode WHEN '2025' THEN c.rev_fy_2025 WHEN '2024' THEN c.rev_fy_2024
      ELSE greatest(c.rev_fy_2024, c.rev_fy_2025) END AS k
  FROM req q JOIN companies c
    ON q.company IS NULL OR contains(lower(c.company_name), lower(q.company))
),
bars AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id
      ORDER BY k DESC NULLS LAST, row_id) AS INTEGER) AS rank FROM cand) t
  WHERE rank <= 5
)"""

_Q_ALL = f"WITH {COMPANIES_CTE}, {QUESTIONS_CTE}, {ROUTE_CTE}"

ORACLES.update({
    "directory_prune": f"WITH {COMPANIES_CTE} SELECT row_id, company_name, company_code, "
                       "industry, description FROM companies",
    "directory_dedup": f"WITH {DIRECTORY_CTE} SELECT * FROM ddedup",
    "directory_override": f"WITH {DIRECTORY_CTE} SELECT * FROM directory",
    "directory_sorted": f"WITH {DIRECTORY_CTE} SELECT * FROM directory "
                        "ORDER BY company_name NULLS LAST, company_code NULLS LAST, row_id",
    "directory_search": f"WITH {DIRECTORY_CTE} SELECT * FROM dsearch",
    "directory_search_indexed": f"WITH {DIRECTORY_CTE} SELECT * FROM dsearch",
    "directory_count": f"WITH {DIRECTORY_CTE} SELECT count(*) AS n_records FROM dsearch",
    "directory_cards": f"""WITH {DIRECTORY_CTE}
SELECT row_id,
  coalesce(company_name, '?') || ' (' || coalesce(company_code, '?') || ')' AS title,
  'Industry: ' || coalesce(industry, '—') AS caption,
  coalesce(nullif(short_description, ''), nullif(description, ''), 'No description provided.') AS body
FROM directory""",
    "clean_text": r"""SELECT doc_id,
  trim(regexp_replace(coalesce(text, ''), '[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS cleaned
FROM documents""",
    "route_questions": f"{_Q_ALL} SELECT question_id, is_chart, show_2024, show_2025, mode FROM routes",
    "detect_company": f"{_Q_ALL} SELECT question_id, company FROM detected",
    "distinct_companies": f"{_Q_ALL} SELECT name, first_row FROM cnames",
    "chart_answer": f"""{_Q_ALL},
nb AS (SELECT question_id, count(*) AS n FROM bars GROUP BY question_id)
SELECT q.question_id, q.company, q.show_2024, q.show_2025,
  CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'no_data' END AS status,
  CASE WHEN coalesce(n, 0) > 0 THEN 'Here is the bar chart you requested 📊'
       ELSE 'Sorry, I couldn’t generate a chart for that query.' END AS message,
  CAST(coalesce(n, 0) AS BIGINT) AS n_bars
FROM req q LEFT JOIN nb ON q.question_id = nb.question_id""",
    "chart_series": f"""{_Q_ALL}
SELECT b.question_id, b.rank, b.row_id, b.company_name, 'Revenue in 2024' AS series, b.rev_fy_2024 AS value
FROM bars b JOIN req q ON b.question_id = q.question_id WHERE q.show_2024
UNION ALL
SELECT b.question_id, b.rank, b.row_id, b.company_name, 'Revenue in 2025' AS series, b.rev_fy_2025 AS value
FROM bars b JOIN req q ON b.question_id = q.question_id WHERE q.show_2025""",
    "chart_half_year_answers": f"""{_Q_ALL},
counted AS (
  SELECT question_id, company, show_2024, show_2025,
    (SELECT count(*) FROM companies c
     WHERE req.company IS NULL OR contains(lower(c.company_name), lower(req.company))) AS n_companies
  FROM req)
SELECT *, CASE WHEN n_companies > 0 THEN 'ok' ELSE 'no_data' END AS status,
  CASE WHEN n_companies > 0 THEN 'Here is the bar chart you requested 📊'
       ELSE 'Sorry, I couldn’t generate a chart for that query.' END AS message
FROM counted""",
    "chart_half_year": f"""{_Q_ALL},
specs AS (SELECT DISTINCT company, show_2024, show_2025 FROM req),
hrows AS (
  SELECT s.company, s.show_2024, s.show_2025, c.row_id, c.company_name, c.rev_h1_2024, c.rev_h1_2025
  FROM specs s JOIN companies c
    ON s.company IS NULL OR contains(lower(c.company_name), lower(s.company))
)
SELECT company, show_2024, show_2025, row_id, company_name, 'Revenue H1 2024' AS series, rev_h1_2024 AS value
FROM hrows WHERE show_2024
UNION ALL
SELECT company, show_2024, show_2025, row_id, company_name, 'Revenue H1 2025' AS series, rev_h1_2025 AS value
FROM hrows WHERE show_2025""",
})


# ---- retrieval ---------------------------------------------------------------
from ..constants import DOC_FIRST_LINE, DOC_LINES, PROMPT_TEMPLATE  # noqa: E402
from ..functions.embed import DEFAULT_DIM  # noqa: E402


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _doc_sql() -> str:
    p0, f0, p1, f1, p2 = DOC_FIRST_LINE
    parts = [f"{_sql_str(p0)} || coalesce({f0}, 'nan') || {_sql_str(p1)} || "
             f"coalesce({f1}, 'nan') || {_sql_str(p2)}"]
    for label, field in DOC_LINES:
        end = " || '       '" if field == "rev_fy_2025" else ""
        parts.append(f"'        ' || {_sql_str(label)} || coalesce(CAST({field} AS VARCHAR), 'nan'){end}")
    return " || chr(10) || ".join(parts)


DOCS_CTE = f"""
docs AS (
  SELECT CAST(row_id AS VARCHAR) AS doc_id, row_id, company_code, industry,
    {_doc_sql()} AS content
  FROM companies
)"""


def _hash_vectors(name: str, src: str, id_col: str, text_col: str) -> str:
    return f"""
{name}_tok AS (
  SELECT {id_col} AS id, unnest(string_split_regex(lower(coalesce({text_col}, '')), '[^a-z0-9]+')) AS tok
  FROM {src}
),
{name}_cnt AS (
  SELECT id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {DEFAULT_DIM} AS INTEGER) AS b,
    CAST(count(*) AS DOUBLE) AS c
  FROM {name}_tok WHERE tok <> '' GROUP BY 1, 2
),
{name}_vec AS (
  SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}_cnt
)"""


def _hash_knn(qsrc: str, qid: str, qtext: str, dsrc: str, did: str, dtext: str,
              k: int = 5) -> str:
    return f"""{_hash_vectors('hq', qsrc, qid, qtext)},
{_hash_vectors('hd', dsrc, did, dtext)},
hsc AS (
  SELECT q.id AS qid, d.id AS did, sum(q.w * d.w) AS s
  FROM hq_vec q JOIN hd_vec d ON q.b = d.b GROUP BY 1, 2
),
hall AS (
  SELECT q.{qid} AS qid, d.{did} AS did, round(coalesce(hsc.s, 0), 9) AS score
  FROM {qsrc} q CROSS JOIN {dsrc} d
  LEFT JOIN hsc ON hsc.qid = q.{qid} AND hsc.did = d.{did}
),
hits AS (
  SELECT * FROM (
    SELECT qid, did, score,
      CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS INTEGER) AS rank
    FROM hall) t WHERE rank <= {k}
)"""


TEXTQ_CTE = f"""
textq AS (SELECT question_id, question FROM questions WHERE NOT {_CHART})"""

_RAG = (f"WITH {COMPANIES_CTE}, {QUESTIONS_CTE}, {TEXTQ_CTE}, {DOCS_CTE}, "
        f"{_hash_knn('textq', 'question_id', 'question', 'docs', 'row_id', 'content')},"
        """
hd AS (
  SELECT h.qid AS question_id, h.did AS row_id, h.score, h.rank, d.company_code, d.industry, d.content
  FROM hits h LEFT JOIN docs d ON h.did = d.row_id
),
ctx AS (
  SELECT question_id,
    string_agg('[Doc ' || CAST(rank AS VARCHAR) || '] Company Code: ' || coalesce(company_code, '?')
      || ' | Industry: ' || coalesce(industry, '?') || chr(10) || coalesce(content, ''),
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
    arg_min(content, rank) AS top
  FROM hd GROUP BY question_id
)""")

_P_HEAD, _P_REST = PROMPT_TEMPLATE.split("{reviews}")
_P_MID, _P_TAIL = _P_REST.split("{question}")

ORACLES.update({
    "render_documents": f"WITH {COMPANIES_CTE}, {DOCS_CTE} SELECT * FROM docs",
    "knn_dense": """
SELECT query_id, vec_id, score, rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
    round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS score,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) DESC,
      d.vec_id) AS INTEGER) AS rank
  FROM embeddings q CROSS JOIN embeddings d) t
WHERE rank <= 5""",
    "doc_search": "WITH " + _hash_knn("benchmark", "item_id", "text", "documents", "doc_id", "text")
                  + " SELECT qid AS item_id, did AS doc_id, score, rank FROM hits",
    "knn_k_sweep": _RAG + """,
ks AS (SELECT unnest([1, 3, 5]) AS k)
SELECT question_id, k, rank, row_id, score FROM hd JOIN ks ON rank <= k""",
    "build_context": _RAG + " SELECT question_id, context FROM ctx",
    "retrieved_records": _RAG + """
SELECT question_id, rank, row_id, coalesce(company_code, '?') AS company_code,
  coalesce(industry, '?') AS industry,
  'Doc ' || CAST(rank AS VARCHAR) || ' — Company Code: ' || coalesce(company_code, '?')
    || ' | Industry: ' || coalesce(industry, '?') AS header,
  substring(coalesce(content, ''), 1, 1200) AS preview
FROM hd""",
    "rag_answers": _RAG + f"""
SELECT q.question_id, q.question, c.context,
  {_sql_str(_P_HEAD)} || coalesce(c.context, '') || {_sql_str(_P_MID)} || coalesce(q.question, '')
    || {_sql_str(_P_TAIL)} AS prompt,
  coalesce(split_part(c.top, chr(10), 1), '') AS answer
FROM textq q LEFT JOIN ctx c ON q.question_id = c.question_id""",
})


# ---- evaluation ----------------------------------------------------------------
from .stem_sql import stem_ctes  # noqa: E402
from ..constants import (ALIASES_INFERRED, ALIASES_KNOWN, ALIASES_OUT_OF_KB,  # noqa: E402
                         REFUSAL_PATTERNS)


def _clean_sql(x: str) -> str:
    return (rf"trim(regexp_replace(coalesce({x}, ''), "
            r"'[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))")


def _norm_sql(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '[^a-z0-9]+', '', 'g')"


def _tokens_sql(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            "lambda t: t <> '')")


def _lcs_sql(a: str, b: str) -> str:
    """LCS length by Hunt–Szymanski thresholds: for each token of b, the
    positions where a has it (descending) lower the first threshold ≥ pos."""
    pos = "list_position(list_transform(T2, lambda x: x >= t), true)"
    return f"""len(list_reduce({b},
  lambda T, tok: list_reduce(list_reverse(list_filter(range(1, len({a}) + 1), lambda i: {a}[i] = tok)),
     lambda T2, t: CASE WHEN {pos} IS NULL THEN list_append(T2, t)
       ELSE list_concat(list_slice(T2, 1, {pos} - 1), [t], list_slice(T2, {pos} + 1, len(T2))) END,
     T),
  CAST([] AS BIGINT[])))"""


_ALIAS_ROWS = ", ".join(f"({_sql_str(c)}, {i}, {_sql_str(a)})"
                        for c, al in (("Known", ALIASES_KNOWN), ("Inferred", ALIASES_INFERRED),
                                      ("Out of KB", ALIASES_OUT_OF_KB))
                        for i, a in enumerate(al))
_REFUSAL_RE = _sql_str("|".join(f"(?:{p})" for p in REFUSAL_PATTERNS))

EVAL_CTE = f"""{SHEETS_CTE},
present AS (SELECT sheet, min(row_id) AS first_row FROM sheets GROUP BY sheet),
latest AS (SELECT {_norm_sql('sheet')} AS norm, arg_max(sheet, first_row) AS sheet FROM present GROUP BY 1),
aliases AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) t(cohort, alias_order, alias)),
resolved AS (
  SELECT arg_min(l.sheet, a.alias_order) AS sheet, a.cohort
  FROM aliases a JOIN latest l ON {_norm_sql('a.alias')} = l.norm GROUP BY a.cohort
),
tagged AS (SELECT s.*, r.cohort FROM sheets s JOIN resolved r ON s.sheet = r.sheet),
elong AS (
  SELECT sheet, row_id, query, expected_company, gold, cohort, 1 AS k, pred_k1 AS pred FROM tagged
  UNION ALL SELECT sheet, row_id, query, expected_company, gold, cohort, 3, pred_k3 FROM tagged
  UNION ALL SELECT sheet, row_id, query, expected_company, gold, cohort, 5, pred_k5 FROM tagged
),
ki AS (
  SELECT cohort, row_id, k, {_clean_sql('query')} AS query,
    {_clean_sql('expected_company')} AS expected_company,
    {_clean_sql('gold')} AS gold, {_clean_sql('pred')} AS pred
  FROM elong WHERE cohort <> 'Out of KB'
),
ki_tok AS (SELECT *, {_tokens_sql('gold')} AS tr, {_tokens_sql('pred')} AS tp FROM ki),
ki_lcs AS (SELECT *, {_lcs_sql('tr', 'tp')} AS lcs FROM ki_tok),
ki_rouge AS (
  SELECT *, CASE WHEN gold = '' OR pred = '' OR len(tp) = 0 OR len(tr) = 0 OR lcs = 0 THEN 0.0
    ELSE 2 * (lcs / len(tp)) * (lcs / len(tr)) / ((lcs / len(tp)) + (lcs / len(tr))) END AS rougeL
  FROM ki_lcs
),
{_hash_vectors('cp', 'ki', "cohort || ':' || CAST(row_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)", 'pred')},
{_hash_vectors('cg', 'ki', "cohort || ':' || CAST(row_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)", 'gold')},
cos AS (SELECT p.id, sum(p.w * g.w) AS s FROM cp_vec p JOIN cg_vec g ON p.id = g.id AND p.b = g.b GROUP BY p.id),
ki_scored AS (
  SELECT r.*, CASE WHEN gold = '' OR pred = '' THEN 0.0 ELSE round(coalesce(c.s, 0), 9) END AS semantic_cosine
  FROM ki_rouge r LEFT JOIN cos c
    ON c.id = r.cohort || ':' || CAST(r.row_id AS VARCHAR) || ':' || CAST(r.k AS VARCHAR)
),
okb AS (
  SELECT row_id, k, {_clean_sql('pred')} AS pred,
    regexp_matches(lower({_clean_sql('pred')}), {_REFUSAL_RE}) AS refusal
  FROM elong WHERE cohort = 'Out of KB'
),
per_query AS (
  SELECT rougeL, semantic_cosine, CAST(NULL AS DOUBLE) AS good_refusal,
    CAST(NULL AS DOUBLE) AS hallucination_rate, cohort, CAST(row_id AS BIGINT) AS row_id,
    CAST(k AS INTEGER) AS k, query, expected_company, gold, pred
  FROM ki_scored
  UNION ALL
  SELECT CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(refusal AS DOUBLE),
    CAST(pred <> '' AND NOT refusal AS DOUBLE), 'Out of KB', CAST(row_id AS BIGINT),
    CAST(k AS INTEGER), '', '', '', pred
  FROM okb
)"""

_EV = f"WITH {EVAL_CTE}"

# the same with every word replaced by its stem
_STEMMED = f"""vocabulary AS (
  SELECT DISTINCT unnest(list_concat(tr, tp)) AS t FROM ki_tok),
{stem_ctes('vocabulary')},
ki_words AS (
  SELECT cohort, row_id, k, side, list(stem ORDER BY place) AS words
  FROM (SELECT cohort, row_id, k, 'r' AS side, unnest(tr) AS t,
          unnest(generate_series(1, len(tr))) AS place FROM ki_tok
        UNION ALL SELECT cohort, row_id, k, 'p', unnest(tp),
          unnest(generate_series(1, len(tp))) FROM ki_tok)
  JOIN stems USING (t) GROUP BY ALL),
ki_stem AS (
  SELECT k.* REPLACE (coalesce(r.words, []) AS tr, coalesce(p.words, []) AS tp)
  FROM ki_tok k
  LEFT JOIN ki_words r ON r.side = 'r' AND r.cohort = k.cohort AND r.row_id = k.row_id AND r.k = k.k
  LEFT JOIN ki_words p ON p.side = 'p' AND p.cohort = k.cohort AND p.row_id = k.row_id AND p.k = k.k),
ki_lcs AS (SELECT *, {_lcs_sql('tr', 'tp')} AS lcs FROM ki_stem),"""
_EV_STEMMED = "WITH " + EVAL_CTE.replace(
    f"ki_lcs AS (SELECT *, {_lcs_sql('tr', 'tp')} AS lcs FROM ki_tok),", _STEMMED)
_COHORT_MEANS = """
SELECT cohort, k, avg(rougeL) AS rougeL, avg(semantic_cosine) AS semantic_cosine,
  avg(good_refusal) AS good_refusal, avg(hallucination_rate) AS hallucination_rate
FROM per_query GROUP BY cohort, k ORDER BY cohort, k"""

ORACLES.update({
    "eval_embedding_store": f"{_EV} SELECT * FROM per_query",
    "eval_workbook": f"{_EV} SELECT * FROM per_query",
    "rouge_l": f"{_EV_STEMMED} SELECT row_id, CAST(k AS INTEGER) AS k, rougeL FROM ki_rouge",
    "metrics_by_cohort_stemmed": _EV_STEMMED + _COHORT_MEANS,
    "cohort_alias": f"{_EV} SELECT sheet, cohort FROM resolved",
    "eval_unpivot": f"{_EV} SELECT sheet, row_id, query, expected_company, gold, cohort, "
                    "CAST(k AS INTEGER) AS k, pred FROM elong",
    "refusal_flag": f"{_EV} SELECT row_id, CAST(k AS INTEGER) AS k, "
                    f"regexp_matches(lower({_clean_sql('pred')}), {_REFUSAL_RE}) AS refusal FROM elong",
    "rouge_l_nostem": f"{_EV} SELECT row_id, CAST(k AS INTEGER) AS k, rougeL FROM ki_rouge",
    "semantic_cosine": f"{_EV} SELECT row_id, CAST(k AS INTEGER) AS k, semantic_cosine FROM ki_scored",
    "score_outkb": f"{_EV} SELECT * FROM per_query WHERE cohort = 'Out of KB'",
    "eval_union": f"{_EV} SELECT * FROM per_query",
    "metrics_by_cohort": _EV + _COHORT_MEANS,
})


# ---- trends ----------------------------------------------------------------------
TREND_CTE = f"""{EVAL_CTE},
pq AS (
  SELECT CASE WHEN cohort = 'Infered' THEN 'Inferred' ELSE cohort END AS cohort,
    row_id, k, rougeL, semantic_cosine FROM per_query
),
mlong AS (
  SELECT 'rougeL' AS metric, cohort, row_id, k, rougeL AS value FROM pq WHERE rougeL IS NOT NULL
  UNION ALL
  SELECT 'semantic_cosine', cohort, row_id, k, semantic_cosine FROM pq WHERE semantic_cosine IS NOT NULL
),
tstats AS (
  SELECT metric, cohort, k, avg(value) AS mean, stddev_samp(value) AS std,
    CAST(count(value) AS BIGINT) AS n
  FROM mlong GROUP BY metric, cohort, k HAVING count(value) > 0
),
tci AS (
  SELECT *, CAST(1.96 AS DOUBLE) * (std / NULLIF(sqrt(CAST(n AS DOUBLE)), 0)) AS ci95 FROM tstats
)"""

_TR = f"WITH {TREND_CTE}"

ORACLES.update({
    "label_fix": f"{_EV} SELECT CASE WHEN cohort = 'Infered' THEN 'Inferred' ELSE cohort END AS cohort, "
                 "row_id, k FROM per_query",
    "trend_stats": f"{_TR} SELECT metric, cohort, k, mean, std, n, ci95, mean - ci95 AS lo, "
                   "mean + ci95 AS hi FROM tci",
    "trend_stats_merged": f"{_TR} SELECT metric, cohort, k, mean, std, n, ci95, mean - ci95 AS lo, "
                          "mean + ci95 AS hi FROM tci",
    "panel_order": f"""{_TR},
base AS (SELECT metric, cohort, avg(CASE WHEN k = 1 THEN value END) AS baseline
         FROM mlong GROUP BY metric, cohort)
SELECT metric, cohort, baseline,
  CAST(row_number() OVER (PARTITION BY metric ORDER BY baseline ASC NULLS LAST, cohort) AS INTEGER) AS panel
FROM base""",
    "axis_range": f"""{_TR},
ranked AS (
  SELECT metric, value,
    row_number() OVER (PARTITION BY metric ORDER BY value, cohort, row_id, k) - 1 AS rnk,
    count(*) OVER (PARTITION BY metric) AS n
  FROM mlong
),
qs AS (SELECT unnest(CAST([0.02, 0.98] AS DOUBLE[])) AS q),
tg AS (SELECT DISTINCT metric, n FROM ranked),
t2 AS (
  SELECT metric, q, (n - 1) * q AS h, floor((n - 1) * q) AS lo,
    least(ceil((n - 1) * q), n - 1) AS hi
  FROM tg CROSS JOIN qs
),
quant AS (
  SELECT t2.metric, t2.q, a.value + (t2.h - t2.lo) * (b.value - a.value) AS quantile
  FROM t2 JOIN ranked a ON a.metric = t2.metric AND a.rnk = t2.lo
          JOIN ranked b ON b.metric = t2.metric AND b.rnk = t2.hi
),
wide AS (
  SELECT metric, max(CASE WHEN q = CAST(0.02 AS DOUBLE) THEN quantile END) AS q_lo,
    max(CASE WHEN q = CAST(0.98 AS DOUBLE) THEN quantile END) AS q_hi
  FROM quant GROUP BY metric
)
SELECT metric, q_lo, q_hi,
  greatest(CAST(0.0 AS DOUBLE), q_lo - CAST(0.08 AS DOUBLE) * CASE WHEN q_hi > q_lo THEN q_hi - q_lo ELSE 1.0 END) AS y_min,
  least(CAST(1.0 AS DOUBLE), q_hi + CAST(0.08 AS DOUBLE) * CASE WHEN q_hi > q_lo THEN q_hi - q_lo ELSE 1.0 END) AS y_max
FROM wide""",
    # up to 4096 values a sketch holds them all: the least value whose rank reaches q * n
    "axis_range_sketch": f"""{_TR},
placed AS (
  SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS rnk,
    count(*) OVER (PARTITION BY metric) AS n FROM mlong),
wide AS (
  SELECT metric, min(value) FILTER (rnk >= n * 0.02::DOUBLE) AS q_lo,
    min(value) FILTER (rnk >= n * 0.98::DOUBLE) AS q_hi FROM placed GROUP BY metric)
SELECT metric, q_lo, q_hi,
  greatest(0.0::DOUBLE, q_lo - 0.08::DOUBLE * CASE WHEN q_hi > q_lo THEN q_hi - q_lo ELSE 1 END) AS y_min,
  least(1.0::DOUBLE, q_hi + 0.08::DOUBLE * CASE WHEN q_hi > q_lo THEN q_hi - q_lo ELSE 1 END) AS y_max
FROM wide""",
    "delta_k": f"""{_TR},
d AS (
  SELECT metric, cohort, max(CASE WHEN k = 1 THEN mean END) AS m1,
    max(CASE WHEN k = 5 THEN mean END) AS m5, arg_max(mean, k) AS last_mean, max(k) AS last_k
  FROM tstats GROUP BY metric, cohort
),
d2 AS (SELECT *, CASE WHEN isfinite(m1) AND isfinite(m5) THEN m5 - m1 END AS delta_1_5 FROM d)
SELECT metric, cohort, delta_1_5, last_mean, last_k,
  CASE WHEN delta_1_5 IS NOT NULL THEN 'Δ(1→5) = ' || printf('%.2f', delta_1_5) END AS delta_label,
  printf('%.2f', last_mean) AS last_label
FROM d2""",
    "trend_labels": f"{_TR} SELECT metric, cohort, k, 'n=' || CAST(n AS VARCHAR) AS n_label FROM tstats",
})


# ---- sources, sinks, streaming -------------------------------------------------------
_STREAM = f"""{_RAG}, {ROUTE_CTE},
nb AS (SELECT question_id, count(*) AS n FROM bars GROUP BY question_id),
chartmsg AS (
  SELECT q.question_id,
    CASE WHEN coalesce(nb.n, 0) > 0 THEN 'Here is the bar chart you requested 📊'
         ELSE 'Sorry, I couldn’t generate a chart for that query.' END AS answer
  FROM req q LEFT JOIN nb ON q.question_id = nb.question_id
),
textans AS (
  SELECT q.question_id, coalesce(split_part(c.top, chr(10), 1), '') AS answer
  FROM textq q LEFT JOIN ctx c ON q.question_id = c.question_id
),
allans AS (SELECT * FROM chartmsg UNION ALL SELECT * FROM textans),
answered AS (
  SELECT qs.question_id, qs.session_id, qs.turn, qs.question, r.is_chart, a.answer
  FROM questions qs JOIN routes r ON qs.question_id = r.question_id
  LEFT JOIN allans a ON qs.question_id = a.question_id
)"""

ORACLES.update({
    "eval_scan": f"WITH {SHEETS_CTE} SELECT sheet, row_id, query, expected_company, gold, "
                 "pred_k1, pred_k3, pred_k5 FROM sheets",
    "eval_csv_roundtrip": f"""{_EV}
SELECT rougeL, semantic_cosine, good_refusal, hallucination_rate, nullif(cohort, '') AS cohort,
  row_id, k, nullif(query, '') AS query, nullif(expected_company, '') AS expected_company,
  nullif(gold, '') AS gold, nullif(pred, '') AS pred
FROM per_query""",
    "index_build": f"""WITH {COMPANIES_CTE}, {DOCS_CTE}, {_hash_vectors('ix', 'docs', 'row_id', 'content')}
SELECT doc_id, row_id, company_code, industry, md5(content) AS content_md5,
  'hashing-md5-256' AS embedder, b AS bucket, round(w, 9) AS weight
FROM docs JOIN ix_vec ON ix_vec.id = docs.row_id""",
    "stream_answers": f"{_STREAM} SELECT * FROM answered",
    "chat_replay": f"""{_STREAM},
msgs AS (
  SELECT session_id, question_id, 0 AS seq, 'user' AS role, question AS content FROM answered
  UNION ALL
  SELECT session_id, question_id, 1, 'assistant', coalesce(answer, '') FROM answered
)
SELECT session_id,
  CAST(row_number() OVER (PARTITION BY session_id ORDER BY question_id, seq) AS INTEGER) AS position,
  role, content, question_id
FROM msgs""",
})


# ---- single operators with their own key ------------------------------------------
from ..constants import COMPANY_SHEET_HEADINGS  # noqa: E402

ORACLES.update({
    "scan_companies": f"WITH {COMPANIES_CTE} SELECT "
                      + ", ".join(c for c, _ in COMPANY_SHEET_HEADINGS) + " FROM companies",
    "filter_company": f"""{_Q_ALL},
named AS (SELECT DISTINCT company FROM detected WHERE company IS NOT NULL)
SELECT n.company, c.row_id, c.company_name
FROM named n JOIN companies c ON contains(lower(c.company_name), lower(n.company))""",
    "detect_years": f"{_Q_ALL} SELECT question_id, show_2024, show_2025 FROM routes",
    "render_prompt": _RAG + f"""
SELECT q.question_id,
  {_sql_str(_P_HEAD)} || coalesce(c.context, '') || {_sql_str(_P_MID)} || coalesce(q.question, '')
    || {_sql_str(_P_TAIL)} AS prompt
FROM textq q LEFT JOIN ctx c ON q.question_id = c.question_id""",
    "score_known": f"{_EV} SELECT * FROM per_query WHERE cohort <> 'Out of KB'",
    "knn_blocked": ORACLES["knn_dense"],
})

# exact cell search returns the brute-force rows
ORACLES["knn_ivf"] = ORACLES["knn_dense"]
ORACLES["cohort_summary_csv"] = ORACLES["metrics_by_cohort"]

# every pattern against every name
ORACLES["filter_company_patterns"] = f"""{_Q_ALL},
named AS (
  SELECT DISTINCT c.row_id, c.company_code, c.company_name
  FROM companies c JOIN detected d ON c.company_name = d.company),
wanted AS (
  SELECT row_id AS pattern_id, CASE row_id % 4
    WHEN 0 THEN '^supplier[#-]0*' || company_code || '$'
    WHEN 1 THEN '(0' || company_code || '|1' || company_code || ')$'
    WHEN 2 THEN replace(company_name, '#', '.')
    ELSE regexp_replace(lpad(company_code, 4, '0'), '(.)', '[\\1]', 'g') || '$' END AS pattern
  FROM named)
SELECT w.pattern_id, c.row_id
FROM wanted w JOIN companies c ON regexp_matches(c.company_name, w.pattern, 'i')"""
