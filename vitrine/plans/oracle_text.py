"""DuckDB SQL for the search oracles: the analyzer and a brute-force scorer.

The scorer compares every query term with every dictionary term
(``damerau_levenshtein``) and scans every document, i.e. the plain
definition, independent of the Spark plan (deletion neighbourhoods, postings
joins). Only meant for the small correctness tables.
"""

from __future__ import annotations

from vitrine.functions.text import MULTI_CHAR_FOLDS, STOP_WORDS

# What each word of the contract's synonym groups is indexed as.
_PHONE = "['phone', 'mobile', 'smartphone', 'cell']"
_LAPTOP = "['laptop', 'computer', 'notebook']"
_HEADPHONES = "['headphones', 'earphones', 'earbuds']"
_TV = "['tv', 'television']"
_CAR = "['car', 'automobile', 'vehicle']"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def sql_fold(x: str) -> str:
    s = f"lower({x})"
    for k, v in MULTI_CHAR_FOLDS.items():
        s = f"replace({s}, '{k}', '{v}')"
    return f"strip_accents({s})"


def sql_raw_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def sql_synonyms(t: str) -> str:
    """The words that the word ``t`` is indexed as."""
    return "CASE " + " ".join(f"WHEN list_contains({g}, {t}) THEN {g}" for g in (
        _PHONE, _LAPTOP, _HEADPHONES, _TV, _CAR)) + f" ELSE [{t}] END"


def sql_analyze_query(x: str) -> str:
    return f"list_filter({sql_raw_tokens(x)}, lambda t: NOT list_contains({_STOP}, t))"


def sql_analyze(x: str) -> str:
    return f"flatten(list_transform({sql_analyze_query(x)}, lambda t: {sql_synonyms('t')}))"


def sql_positions(x: str) -> str:
    """Rows (pos, term) of a text as typed, stop words left out."""
    return (f"unnest(list_filter(list_transform({sql_raw_tokens(x)}, "
            f"lambda t, i: {{'pos': i - 1, 'term': t}}), lambda s: NOT list_contains({_STOP}, s.term)))")


def sql_analyze_sku(x: str) -> str:
    return sql_fold(x)


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def sql_idf(df="df", n="n_docs") -> str:
    return f"ln({_d(1.0)} + (CAST({n} - {df} AS DOUBLE) + {_d(0.5)}) / (CAST({df} AS DOUBLE) + {_d(0.5)}))"


def sql_bm25(tf="tf", df="df", n="n_docs", dl="dl", avgdl="avgdl", idf: str | None = None) -> str:
    idf = idf or sql_idf(df, n)
    norm = f"coalesce({_d(0.25)} + {_d(0.75)} * {dl} / {avgdl}, {_d(1.0)})"
    return f"{idf} * (CAST({tf} AS DOUBLE) * {_d(2.2)}) / (CAST({tf} AS DOUBLE) + {_d(1.2)} * {norm})"


def field_terms_sql(docs: str, key: str, field: str, kind: str) -> str:
    """(doc_id, field, term) rows of one field (one row per token)."""
    if kind == "text":
        return f"SELECT {key} AS doc_id, '{field}' AS field, unnest({sql_analyze(field)}) AS term FROM {docs}"
    if kind == "keyword_array":
        return f"SELECT {key} AS doc_id, '{field}' AS field, unnest({field}) AS term FROM {docs}"
    if kind == "sku":
        return (f"SELECT {key} AS doc_id, '{field}' AS field, {sql_analyze_sku(field)} AS term FROM {docs} "
                f"WHERE {field} IS NOT NULL")
    raise ValueError(kind)


def query_terms_sql(queries: str, field: str, kind: str, raw: bool) -> str:
    if raw or kind == "keyword_array":
        arr = "[q]"
    elif kind == "text":
        arr = f"list_distinct({sql_analyze_query('q')})"
    else:
        arr = f"[{sql_analyze_sku('q')}]"
    return (f"SELECT query_id, '{field}' AS field, qterm FROM (SELECT query_id, unnest({arr}) AS qterm "
            f"FROM {queries}) WHERE qterm IS NOT NULL AND length(qterm) > 0")


def index_ctes(docs: str, key: str, fields: dict[str, str], prefix: str = "ix") -> str:
    """CTEs {prefix}_tok, _post, _len, _df, _fs (comma-led)."""
    toks = "\n  UNION ALL ".join(field_terms_sql(docs, key, f, k) for f, k in fields.items())
    keyword = [f for f, k in fields.items() if k != "text"] or ["-"]
    kw = ", ".join(f"'{f}'" for f in keyword)
    return f""",
{prefix}_tok AS ({toks}),
{prefix}_post AS (SELECT field, term, doc_id, count(*) AS tf FROM {prefix}_tok GROUP BY ALL),
{prefix}_len0 AS (SELECT field, doc_id, count(*) AS dl FROM {prefix}_tok GROUP BY ALL),
{prefix}_len AS (SELECT field, doc_id, CASE WHEN field IN ({kw}) THEN NULL ELSE dl END AS dl FROM {prefix}_len0),
{prefix}_df AS (SELECT field, term, count(*) AS df FROM {prefix}_post GROUP BY ALL),
{prefix}_fs AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM {prefix}_len0 GROUP BY ALL)"""


def score_ctes(queries: str, fields: dict[str, tuple[str, float]], operator: str, fuzzy: bool,
               raw: bool = False, prefix: str = "ix", out: str = "scored") -> str:
    """CTE ``out``(query_id, doc_id, score) with the best-fields semantics of
    ``operators.search.score_fields`` (comma-led)."""
    qt = "\n  UNION ALL ".join(query_terms_sql(queries, f, k, raw) for f, (k, _) in fields.items())
    if fuzzy:
        exp = f"""
{out}_cand AS (SELECT q.query_id, q.field, q.qterm, d.term,
                      CASE WHEN q.qterm = d.term THEN 0 ELSE damerau_levenshtein(q.qterm, d.term) END AS edits,
                      CASE WHEN length(q.qterm) <= 2 THEN 0 WHEN length(q.qterm) <= 5 THEN 1 ELSE 2 END AS k
               FROM {out}_qt q JOIN {prefix}_df d ON d.field = q.field),
{out}_exp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field, qterm ORDER BY edits, term) AS r
                             FROM {out}_cand WHERE edits <= k))"""
    else:
        exp = f"""
{out}_exp AS (SELECT q.query_id, q.field, q.qterm, q.qterm AS term, 0 AS edits
              FROM {out}_qt q JOIN {prefix}_df d ON d.field = q.field AND d.term = q.qterm)"""
    boost = "CASE " + " ".join(f"WHEN field = '{f}' THEN {_d(float(b))}" for f, (_, b) in fields.items()) + " END"
    weight = (f"CASE WHEN e.edits = 0 THEN {_d(1.0)} ELSE {_d(1.0)} - e.edits / "
              f"least(length(e.qterm), length(e.term)) END")
    and_filter = ""
    if operator == "and":
        and_filter = (f" JOIN (SELECT query_id, field, count(*) AS n_terms FROM {out}_qt GROUP BY ALL) n "
                      f"USING (query_id, field) WHERE matched = n_terms")
    return f""",
{out}_qt AS ({qt}),{exp},
{out}_hits AS (SELECT e.query_id, e.field, p.doc_id, e.qterm,
                      max({weight} * {sql_bm25('p.tf', 'd.df', 'fs.n_docs', 'l.dl', 'fs.avgdl')}) AS ts
               FROM {out}_exp e JOIN {prefix}_post p ON p.field = e.field AND p.term = e.term
               JOIN {prefix}_df d ON d.field = e.field AND d.term = e.term
               JOIN {prefix}_fs fs ON fs.field = e.field
               JOIN {prefix}_len l ON l.field = e.field AND l.doc_id = p.doc_id
               GROUP BY ALL),
{out}_pf AS (SELECT query_id, field, doc_id, sum(ts) AS fs, count(*) AS matched FROM {out}_hits GROUP BY ALL),
{out} AS (SELECT query_id, doc_id, max(fs * {boost}) AS score FROM {out}_pf{and_filter} GROUP BY query_id, doc_id)"""


def top_k_sql(src: str, key: str, k: int) -> str:
    return (f"SELECT {key}, doc_id, rank, round(score, 4) AS score FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 6) DESC, doc_id) AS rank "
            f"FROM {src}) WHERE rank <= {k}")
