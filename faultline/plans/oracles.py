"""DuckDB SQL oracles, one per registered query (same column names).

The stand-in views are written once as SQL fragments generated from the same
parameter values the Spark side uses, so both engines state the same rules.
"""

from __future__ import annotations

from faultline.plans.analysis import (CATEGORIES, DEP_CATEGORIES, DOMAIN_ORDER, EDGE_THRESHOLD,
                                      FANOUT_TYPE)
from faultline.plans.standins import AS_OF_DATE, ATTRS, EVENT_LABEL_MAP, TYPE_ORDER


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_map(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {expr} {whens} END, {expr})"


BUGS = f"""SELECT event_id, user_id AS project, {_case_map('trim(event_type)', EVENT_LABEL_MAP)} AS bug_type
FROM events"""

PROJECTS = f"""SELECT c.c_custkey AS project, trim(c.c_mktsegment) AS domain,
  CASE WHEN o._cents IS NOT NULL THEN format('{{:,}}', o._cents) END AS loc_text,
  TRY_CAST(replace(CASE WHEN o._cents IS NOT NULL THEN format('{{:,}}', o._cents) END, ',', '') AS DOUBLE) AS loc,
  CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS stars,
  CAST(coalesce(o._orders, 0) AS DOUBLE) AS commits,
  CAST(coalesce(o._open, 0) AS DOUBLE) AS issues,
  o.start_date,
  round_even(datediff('day', o.start_date, DATE '{AS_OF_DATE}') / 365.25::DOUBLE, 6) AS age_years
FROM customer c LEFT JOIN (
  SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS _cents, count(*) AS _orders,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS _open, min(CAST(o_orderdate AS DATE)) AS start_date
  FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey"""

VALID_BUGS = f"""SELECT * FROM ({BUGS}) b WHERE project IS NOT NULL AND CAST(project AS VARCHAR) <> ''
  AND bug_type IS NOT NULL AND bug_type <> ''"""

MATRIX = ("SELECT project, "
          + ", ".join(f"count(*) FILTER (WHERE bug_type = {q(t)}) AS {t}" for t in TYPE_ORDER)
          + f", count(*) AS total FROM ({VALID_BUGS}) vb GROUP BY project")

MERGED = f"SELECT m.*, p.* EXCLUDE (project) FROM ({MATRIX}) m JOIN ({PROJECTS}) p USING (project)"


def _with(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


def _unpivot(src: str, ids: list[str], cols: list[str], name: str, value: str, cast: str = "DOUBLE") -> str:
    parts = [f"SELECT {', '.join(ids)}, {q(c)} AS {name}, CAST({c} AS {cast}) AS {value} FROM {src}"
             for c in cols]
    return " UNION ALL ".join(parts)


def _midrank(part: str, value: str) -> str:
    return (f"CAST(rank() OVER (PARTITION BY {part} ORDER BY {value}) AS DOUBLE)"
            f" + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0")


def _corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _lower_pairs(names):
    return [(names[i], names[j]) for i in range(len(names)) for j in range(i)]


def _spearman_listwise_sql(src: str, rows, cols) -> str:
    names = list(dict.fromkeys(rows + cols))
    notnull = " AND ".join(f"{n} IS NOT NULL" for n in names)
    complete = f"SELECT * FROM ({src}) s WHERE {notnull}"
    long = _unpivot("complete", ["project"], names, "name", "value")
    pairs = " UNION ALL ".join(f"SELECT {q(a)} AS row_name, {q(b)} AS col_name" for a in rows for b in cols)
    return _with(complete=complete, long=long,
                 ranked=f"SELECT project, name, {_midrank('name', 'value')} AS r FROM long",
                 pairs=pairs) + f"""
SELECT p.row_name, p.col_name, round({_corr('a.r', 'b.r')}, 6) AS rho, count(*) AS n
FROM pairs p JOIN ranked a ON a.name = p.row_name JOIN ranked b ON b.name = p.col_name AND b.project = a.project
GROUP BY p.row_name, p.col_name"""


def _medians(src: str, cols) -> str:
    return ("SELECT domain, " + ", ".join(
        f"CASE WHEN count({c}) = count(*) THEN median({c}) END AS {c}" for c in cols)
        + f" FROM ({src}) s GROUP BY domain")


ZSCORES = _with(
    med=_medians(MERGED, TYPE_ORDER),
    long=_unpivot("med", ["domain"], TYPE_ORDER, "category", "median")) + """
SELECT domain, category, median,
  round((median - avg(median) OVER (PARTITION BY category))
        / nullif(stddev_samp(median) OVER (PARTITION BY category), 0), 6) AS z
FROM long"""


def _chi2_upper_sql(x: str, df: str, terms: int = 400) -> str:
    """Chi-square upper tail via the regularized lower gamma series
    P(a, y) = y^a e^-y / Gamma(a+1) * sum_n y^n Gamma(a+1) / Gamma(a+n+1),
    a = df/2, y = x/2 (all terms positive)."""
    a = f"({df} / 2.0)"
    y = f"({x} / 2.0)"
    series = (f"list_sum(list_transform(range(0, {terms}), lambda k: "
              f"exp(k * ln({y}) + lgamma({a} + 1) - lgamma({a} + k + 1))))")
    lower = f"exp({a} * ln({y}) - {y} - lgamma({a} + 1)) * {series}"
    return (f"CASE WHEN {x} IS NULL OR {df} IS NULL OR {df} <= 0 THEN NULL "
            f"WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - {lower}) END")


def _beta_series_sql(z: str, p: str, qq: str, terms: int = 4000) -> str:
    """I_z(p, q) by the power series
    z^p (1-z)^q / (p B(p, q)) * sum_k [Gamma(p+q+k) Gamma(p+1) / (Gamma(p+q) Gamma(p+1+k))] z^k."""
    front = (f"exp({p} * ln({z}) + {qq} * ln(1 - {z}) + lgamma({p} + {qq}) - lgamma({p}) - lgamma({qq})) / {p}")
    series = (f"list_sum(list_transform(range(0, {terms}), lambda k: exp(lgamma({p} + {qq} + k) - lgamma({p} + {qq})"
              f" - lgamma({p} + 1 + k) + lgamma({p} + 1) + k * ln({z}))))")
    return f"({front} * {series})"


def _t_p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: I_{1-r^2}((n-2)/2, 1/2), evaluated on
    the side where the series converges fast (the symmetry
    I_x(a, b) = 1 - I_{1-x}(b, a))."""
    a = f"(({n} - 2) / 2.0)"
    x = f"(1 - {r} * {r})"
    direct = _beta_series_sql(x, a, "0.5")
    mirrored = f"(1 - {_beta_series_sql(f'({r} * {r})', '0.5', a)})"
    return (f"CASE WHEN {r} IS NULL OR {n} < 5 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
            f"WHEN {r} = 0 THEN 1.0 "
            f"WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {direct} ELSE {mirrored} END")


def analysis_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["project_matrix"] = (
        f"SELECT p.project, p.domain, {', '.join('m.' + t for t in TYPE_ORDER)}, m.total "
        f"FROM ({PROJECTS}) p LEFT JOIN ({MATRIX}) m USING (project)")
    o["type_counts"] = f"SELECT project, bug_type, count(*) AS n FROM ({VALID_BUGS}) v GROUP BY project, bug_type"
    o["label_recode"] = BUGS
    o["matrix_long"] = _with(m=MATRIX) + _unpivot("m", ["project"], TYPE_ORDER, "bug_type", "n", "BIGINT")
    sums = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in CATEGORIES)
    means = ", ".join(f"round_even(avg({c}), 2) AS {c}" for c in CATEGORIES)
    o["matrix_summary"] = (_with(m=MATRIX) + f"SELECT 'Total' AS row_kind, {sums} FROM m "
                           f"UNION ALL SELECT 'Mean' AS row_kind, {means} FROM m")
    o["type_share"] = (f"SELECT project, bug_type, n, round(n / sum(n) OVER (PARTITION BY project), 6) AS share "
                       f"FROM (SELECT project, bug_type, count(*) AS n FROM ({VALID_BUGS}) v GROUP BY ALL) t")
    norm = "regexp_replace(lower(trim({})), '[^a-z0-9-]', '', 'g')"
    facts = (f"SELECT s_suppkey, 'Nation #' || CAST(s_nationkey AS VARCHAR) AS nation_raw, "
             f"{norm.format(chr(39) + 'Nation #' + chr(39) + ' || CAST(s_nationkey AS VARCHAR)')} AS nation_key FROM supplier")
    dim = f"SELECT DISTINCT {norm.format('n_name')} AS nation_key, n_name, n_regionkey FROM nation"
    o["key_normalize_join"] = (_with(f=facts, d=dim) +
                               "SELECT f.nation_key, f.s_suppkey, f.nation_raw, d.n_name, d.n_regionkey "
                               "FROM f LEFT JOIN d USING (nation_key)")
    o["unmatched_keys"] = ("SELECT DISTINCT c_name AS name FROM customer WHERE NOT EXISTS "
                           "(SELECT 1 FROM events WHERE events.user_id = customer.c_custkey)")
    lvl = " ".join(f"WHEN {q(d)} THEN {i + 1}" for i, d in enumerate(DOMAIN_ORDER))
    o["project_order"] = (_with(p=PROJECTS) + f"""
SELECT project, domain, loc, CAST(domain_level AS BIGINT) AS domain_level,
  row_number() OVER (ORDER BY domain_level ASC NULLS LAST, domain ASC NULLS LAST, loc DESC NULLS LAST, project ASC) AS position
FROM (SELECT project, domain, loc, CASE domain {lvl} END AS domain_level FROM p
      WHERE project IN (SELECT project FROM ({BUGS}) b)) x""")
    o["typed_attributes"] = PROJECTS
    prof_cols = ["loc", "stars", "commits", "issues", "age_years"]
    o["numeric_profile"] = (_with(p=PROJECTS, long=_unpivot("p", ["project"], prof_cols, "attribute", "value"))
                            + "SELECT attribute, count(value) AS n, round(avg(value), 6) AS mean, "
                              "min(value) AS min, max(value) AS max FROM long GROUP BY attribute")
    o["attribute_overview"] = (_with(p=PROJECTS, long=_unpivot("p", ["project"], ATTRS, "attribute", "value"))
                               + "SELECT attribute, round(avg(value), 6) AS mean, "
                                 "round(CASE WHEN count(value) = count(*) THEN sum(value) END, 6) AS total, "
                                 "count(value) AS n, count(*) - count(value) AS n_missing "
                                 "FROM long GROUP BY attribute")
    o["domain_medians"] = _medians(MERGED, CATEGORIES + ["stars"])
    o["domain_zscores"] = ZSCORES
    o["domain_matrix"] = (_with(z=ZSCORES) + "SELECT domain, " + ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE category = {q(t)}) = 0 THEN 0.0 ELSE max(z) FILTER (WHERE category = {q(t)}) END AS {t}" for t in TYPE_ORDER)
        + " FROM z GROUP BY domain")
    o["domain_distance"] = (_with(z=ZSCORES) + f"""
SELECT a.domain AS item_a, b.domain AS item_b,
  round(sqrt(sum(pow(a.z - b.z, 2)) * {float(len(TYPE_ORDER))} / count(*)), 6) AS distance
FROM z a JOIN z b ON a.category = b.category AND a.domain < b.domain
WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY a.domain, b.domain""")
    o["midranks"] = (_with(m=MATRIX, long=_unpivot("m", ["project"], CATEGORIES, "category", "n"))
                     + f"SELECT project, category, n, {_midrank('category', 'n')} AS rank FROM long")
    o["spearman_attrs"] = _spearman_listwise_sql(MERGED, TYPE_ORDER, ATTRS)
    inner = _spearman_listwise_sql(MERGED, TYPE_ORDER, ATTRS)
    o["spearman_pvalues"] = (f"SELECT row_name, col_name, round(rho_raw, 6) AS rho, n, "
                             f"round({_t_p_sql('rho_raw', 'n')}, 6) AS p_value FROM ("
                             + inner.replace("round(" + _corr('a.r', 'b.r') + ", 6) AS rho",
                                             _corr('a.r', 'b.r') + " AS rho_raw") + ") s")
    o["corr_transposed"] = ("SELECT col_name AS attribute, " + ", ".join(
        f"max(rho) FILTER (WHERE row_name = {q(t)}) AS {t}" for t in TYPE_ORDER)
        + f" FROM ({inner}) s GROUP BY col_name")
    pairs = _lower_pairs(CATEGORIES)
    pair_rows = " UNION ALL ".join(
        f"SELECT project, {q(a)} AS row_name, {q(b)} AS col_name, CAST({a} AS DOUBLE) AS x, "
        f"CAST({b} AS DOUBLE) AS y FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    types_sql = (_with(m=MATRIX, pr=pair_rows) + f"""
SELECT row_name, col_name, round({_corr('rx', 'ry')}, 6) AS rho, count(*) AS n FROM (
  SELECT row_name, col_name, {_midrank('row_name, col_name', 'x')} AS rx,
         {_midrank('row_name, col_name', 'y')} AS ry FROM pr) t
GROUP BY row_name, col_name""")
    o["spearman_types"] = types_sql
    o["corr_edges"] = (f"SELECT row_name AS node_a, col_name AS node_b, rho, round(abs(rho) * 5.0, 6) AS width, "
                       f"CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS sign "
                       f"FROM ({types_sql}) t WHERE abs(rho) > {EDGE_THRESHOLD}")
    deps = ("SELECT o_custkey AS project, " + ", ".join(
        f'count(*) FILTER (WHERE o_orderpriority = {q(d)}) AS "{d}"' for d in DEP_CATEGORIES)
        + " FROM orders GROUP BY o_custkey")
    dep_fill = ", ".join(f'coalesce(d."{c}", 0) AS "{c}"' for c in DEP_CATEGORIES)
    cross_src = f"SELECT m.*, {dep_fill} FROM ({MATRIX}) m LEFT JOIN ({deps}) d USING (project)"
    qd = [f'"{d}"' for d in DEP_CATEGORIES]
    cross = _spearman_listwise_sql(cross_src, TYPE_ORDER, qd)
    for d in DEP_CATEGORIES:
        cross = cross.replace(f"'\"{d}\"'", q(d))
    o["spearman_cross"] = cross
    o["fanout_sum"] = f"""
SELECT d.project, d.dep_category, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS type_bugs
FROM (SELECT o_custkey AS project, o_orderpriority AS dep_category FROM orders) d
LEFT JOIN (SELECT project, count(*) AS n FROM ({VALID_BUGS}) v WHERE bug_type = {q(FANOUT_TYPE)} GROUP BY project) n
  USING (project)
GROUP BY d.project, d.dep_category"""
    kw_long = _unpivot("mg", ["project", "domain"], CATEGORIES, "category", "value")
    o["kruskal_wallis"] = (_with(mg=MERGED, long=kw_long,
                                 r=f"SELECT category, domain, value, {_midrank('category', 'value')} AS rk, "
                                   f"count(*) OVER (PARTITION BY category, value) AS t FROM long WHERE value IS NOT NULL")
                           + """,
g AS (SELECT category, domain, sum(rk) AS rsum, count(*) AS ni FROM r GROUP BY category, domain),
ties AS (SELECT category, sum((CAST(t AS DOUBLE) * t * t - t) / t) AS tie FROM r GROUP BY category),
h AS (SELECT g.category, sum(g.rsum * g.rsum / g.ni) AS qsum, sum(g.ni) AS n, count(*) AS k
      FROM g GROUP BY g.category),
hh AS (SELECT h.category, h.n, h.k - 1 AS df,
  (12.0 / (CAST(h.n AS DOUBLE) * (h.n + 1)) * h.qsum - 3.0 * (h.n + 1))
    / nullif(1.0 - ties.tie / (CAST(h.n AS DOUBLE) * h.n * h.n - h.n), 0) AS hstat
  FROM h JOIN ties USING (category))
SELECT category, round(hstat, 6) AS h, CAST(df AS INTEGER) AS df,
  round(""" + _chi2_upper_sql("hstat", "df") + """, 6) AS p_value, CAST(n AS BIGINT) AS n
FROM hh""")
    return o


# ---------------------------------------------------------------------------
# Corpus queries: the cleaning chain stated in DuckDB SQL from the same values.

def _clean_sql(text_expr: str, lemmas: bool = True) -> str:
    from faultline.functions.text import (LEMMA_EXCEPTIONS, PUNCTUATION, STOP_WORDS, SYMBOL_PATTERN,
                                          TOKEN_PATTERN, ASCII_ONLY_PATTERN)
    stops = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"
    exc = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LEMMA_EXCEPTIONS.items())
    g = "length(t) > 3 AND regexp_matches(t, '^[a-z]+$')"
    rules = (f"CASE WHEN {g} AND regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y') "
             f"WHEN {g} AND regexp_matches(t, '(ch|sh|x|z|ss)es$') THEN regexp_replace(t, 'es$', '') "
             f"WHEN {g} AND regexp_matches(t, 'men$') THEN regexp_replace(t, 'men$', 'man') "
             f"WHEN {g} AND regexp_matches(t, '[^sui]s$') THEN regexp_replace(t, 's$', '') "
             "ELSE t END")
    lemma = f"coalesce(CASE t {exc} END, {rules})"
    keep = (f"NOT contains({q(PUNCTUATION)}, t) AND regexp_matches(t, {q(ASCII_ONLY_PATTERN)}) "
            f"AND NOT list_contains({stops}, t) AND NOT regexp_matches(t, {q(SYMBOL_PATTERN)})")
    kept = f"list_filter(regexp_extract_all(lower({text_expr}), {q(TOKEN_PATTERN)}), lambda t: {keep})"
    return f"list_transform({kept}, lambda t: {lemma})" if lemmas else kept


def corpus_oracles() -> dict[str, str]:
    from faultline.functions.html import ENTITIES
    from faultline.functions.text import ISSUE_TITLE_PREFIX, SEGMENT_SEPARATOR
    from faultline.functions.urls import HREF_PATTERN
    from faultline.plans import corpus as C
    o: dict[str, str] = {}
    o["clean_tokens"] = (f"SELECT doc_id, array_to_string(toks, ' ') AS tokens, CAST(len(toks) AS INTEGER) AS n_tokens "
                         f"FROM (SELECT doc_id, {_clean_sql('text')} AS toks FROM documents) t")
    o["token_counts"] = (f"SELECT token, count(*) AS n FROM (SELECT unnest({_clean_sql('text')}) AS token "
                         f"FROM documents) t GROUP BY token")
    from faultline.functions.text import LEMMA_EXCEPTIONS
    from faultline.operators.lemmas import LEVELS, NOUN_RULES
    rules = ", ".join(f"CASE WHEN word LIKE '%{a}' AND length(word) + {len(b)} > {len(a)} THEN left(word, length(word) - {len(a)}) || '{b}' END" for a, b in NOUN_RULES)
    irregular = ", ".join(f"({q(a)}, {q(b)})" for a, b in LEMMA_EXCEPTIONS.items())
    lemmas = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_clean_sql('text', False)} AS toks FROM documents),
v AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM w) x GROUP BY token),
held AS (SELECT token AS word FROM v WHERE n >= {C.LEXICON_COUNT}),
irr(form, lemma) AS (VALUES {irregular}),
p AS (SELECT token, 0 AS step, token AS word FROM v
      UNION ALL SELECT token, step + 1, unnest(list_filter([{rules}], lambda x: x IS NOT NULL)) FROM p WHERE step < {LEVELS} AND token NOT IN (SELECT form FROM irr)),
c AS (SELECT token, greatest(step, 1) - 1 AS level, word FROM p UNION ALL SELECT form, 0, lemma FROM irr WHERE form IN (SELECT token FROM v)),
lem AS (SELECT token, arg_min(word, (level, length(word))) AS lemma FROM c WHERE word IN (SELECT word FROM held) GROUP BY token)"""
    o["lexicon_lemmas"] = lemmas + " SELECT v.token, coalesce(lemma, v.token) AS lemma, n FROM v LEFT JOIN lem USING (token)"
    o["lexicon_tokens"] = lemmas + """,
e AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS k FROM w)
SELECT doc_id, coalesce(t.tokens, '') AS tokens FROM w LEFT JOIN
  (SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY k) AS tokens FROM e LEFT JOIN lem USING (token) GROUP BY doc_id) t USING (doc_id)"""
    wanted = " OR ".join(f"list_contains(toks, {q(w)})" for w in C.TITLE_WANTED)
    excluded = "[" + ", ".join(q(w) for w in C.TITLE_EXCLUDED) + "]"
    o["fix_title_filter"] = f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, title FROM (
  SELECT doc_id, line_no, title, {_clean_sql('title')} AS toks FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS title,
           unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no
    FROM documents) l) t
WHERE ({wanted}) AND NOT list_has_any(toks, {excluded})"""
    seg = (f"CASE WHEN toks IS NULL THEN NULL "
           f"WHEN role = 'system' THEN CASE WHEN len(toks) > 0 THEN array_to_string(toks, ' ') END "
           f"WHEN role = 'user' THEN {q(ISSUE_TITLE_PREFIX)} || array_to_string(toks, ' ') "
           f"ELSE array_to_string(toks, ' ') END")
    o["conversation_text"] = f"""
SELECT conv_id, string_agg(seg, {q(SEGMENT_SEPARATOR)} ORDER BY turn) AS text FROM (
  SELECT conv_id, turn, {seg} AS seg FROM (
    SELECT conv_id, turn, role, {_clean_sql('text')} AS toks FROM conversations) c) s
WHERE seg IS NOT NULL GROUP BY conv_id"""
    o["conversation_size"] = """
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role <> 'system') AS total_discussions,
  count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant
FROM conversations GROUP BY conv_id"""
    o["nested_record"] = f"""
SELECT conv_id, CAST(to_json({{'total_discussions': CAST(len(ds) AS INTEGER),
                         'discussions': CASE WHEN len(ds) > 0 THEN ds END}}) AS VARCHAR) AS record_json FROM (
  SELECT conv_id, list({{'discussion_number': CAST(turn + 1 AS INTEGER),
    'comments': [{{'type': CASE WHEN first THEN 'description' END, 'content': toks,
                   'author': CASE WHEN first THEN role END}}]}} ORDER BY turn) AS ds
  FROM (SELECT conv_id, turn, role, turn = min(turn) OVER (PARTITION BY conv_id) AS first,
               {_clean_sql('text')} AS toks FROM conversations) c
  GROUP BY conv_id) r"""
    bot = " OR ".join(f"(contains(para, {q(a)}) AND contains(para, {q(b)}))" for a, b in C.BOT_PHRASE_PAIRS)
    o["bot_filter"] = f"""
SELECT conv_id, turn, 1 AS discussion_number FROM conversations WHERE turn = 0
UNION ALL
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS INTEGER)
FROM (SELECT conv_id, turn, split_part(text, chr(10), 1) AS para FROM conversations WHERE turn > 0) c
WHERE NOT coalesce({bot}, false)"""
    o["role_filter"] = """
SELECT c.conv_id, c.turn, coalesce(c.role, 'Unknown') AS author
FROM conversations c LEFT JOIN (SELECT conv_id, role AS issue_author FROM conversations WHERE turn = 0) o
  USING (conv_id)
WHERE c.turn > 0 AND c.role IS DISTINCT FROM 'system' AND trim(c.text) <> ''
  AND coalesce(c.role, 'Unknown') IS DISTINCT FROM o.issue_author"""
    o["before_after_pairs"] = """
SELECT i.conv_id, i.turn, b.text AS before, a.text AS after
FROM (SELECT conv_id, turn FROM conversations WHERE turn >= 1) i
LEFT JOIN conversations b ON b.conv_id = i.conv_id AND b.turn + 1 = i.turn
LEFT JOIN conversations a ON a.conv_id = i.conv_id AND a.turn = i.turn"""
    o["event_props_json"] = ("SELECT event_id, CASE WHEN json_valid(props) THEN "
                             "TRY_CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
    o["time_window_limit"] = f"""
SELECT event_id, user_id, ts, CAST(rn AS INTEGER) AS rn FROM (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ASC) AS rn
  FROM events WHERE ts BETWEEN TIMESTAMP '{C.WINDOW_SINCE}' AND TIMESTAMP '{C.WINDOW_UNTIL}') e
WHERE rn <= {C.LISTING_CAP}"""
    origin = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1)"
    resolved = (f"list_transform(list_transform(regexp_extract_all(html, {q(HREF_PATTERN)}, 1), "
                f"lambda h: replace(h, chr(10), '')), lambda h: CASE WHEN h LIKE '/%' AND h NOT LIKE '//%' "
                f"THEN {origin} || h ELSE h END)")
    hosts = " OR ".join(f"contains(u, {q(h)})" for h in C.PAGE_LINK_HOSTS)
    keep = f"({hosts}) AND NOT contains(u, 'tree/HEAD/') AND NOT coalesce(contains(u, url), false)"
    links = f"list_sort(list_distinct(list_filter({resolved}, lambda u: {keep})))"
    page_links = f"SELECT page_id, url, {links} AS links FROM pages"
    o["page_links"] = (f"SELECT page_id, CAST(len(links) AS INTEGER) AS n_links, array_to_string(links, ' ') AS links "
                       f"FROM ({page_links}) p")

    def unesc(x):
        for ent, ch in ENTITIES:
            x = f"replace({x}, {q(ent)}, {q(ch)})"
        return x

    def strip(x):
        no_tags = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
        return f"trim(regexp_replace({unesc(no_tags)}, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))"

    title = unesc("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
    sep = C.TITLE_SEPARATOR
    o["page_title"] = (f"SELECT page_id, CASE WHEN strpos(t, {q(sep)}) > 0 THEN trim(split_part(t, {q(sep)}, 1)) "
                       f"ELSE '' END AS title FROM (SELECT page_id, {title} AS t FROM pages) p")
    article = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
    paras = (f"list_filter(list_transform(regexp_split_to_array({article}, '<p[^>]*>')[2:], "
             f"lambda p: {strip('split_part(p, ' + q('</p>') + ', 1)')}), lambda t: t <> '')")
    nav = ("list_sort(list_distinct(list_transform(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1), "
           f"lambda t: trim({unesc('t')}))))")
    o["page_main_text"] = f"""
SELECT page_id,
  {strip("regexp_extract(html, '(?s)<div[^>]*class=" + '"(?:[^"]* )?ad(?: [^"]*)?"' + "[^>]*>(.*?)</div>', 1)")} AS ad_text,
  {strip("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  array_to_string(paras, chr(10)) AS body, CAST(len(paras) AS INTEGER) AS n_paragraphs,
  array_to_string({nav}, '|') AS nav_labels
FROM (SELECT page_id, html, {paras} AS paras FROM pages) p"""
    # The whole given page without comments, scripts and styles, between the words of the blocks around it.
    bare = "regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    block = strip("'page first ' || " + bare + " || ' second third ' || chr(8217) || ' end'")
    o["page_block_text"] = f"SELECT page_id, {block} AS block_text FROM pages"
    o["event_props_keys"] = ("SELECT event_id, k AS key, CASE json_type(props, '$.' || k) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' "
                             "WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(props, '$.' || k) END AS type, json_extract_string(props, '$.' || k) AS value "
                             "FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) e")
    hrefs = f"list_transform(regexp_extract_all(html, {q(HREF_PATTERN)}, 1), lambda h: replace(h, chr(10), ''))"
    o["page_quarantine"] = f"""
SELECT * FROM (
  SELECT page_id, url, n_paragraphs, n_links, html_chars,
    CASE WHEN n_paragraphs < {C.MIN_PARAGRAPHS} THEN 'no_paragraphs'
         WHEN n_links < {C.MIN_LINKS} THEN 'few_links' END AS reason
  FROM (SELECT page_id, url, CAST(len({paras}) AS INTEGER) AS n_paragraphs,
               CAST(len(list_distinct({hrefs})) AS INTEGER) AS n_links,
               CAST(length(html) AS INTEGER) AS html_chars FROM pages) x) y
WHERE reason IS NOT NULL"""
    o["two_hop_links"] = f"""
WITH p AS ({page_links}),
e AS (SELECT url AS src, unnest(links) AS dst FROM p),
h2 AS (SELECT e1.src, e2.dst FROM e e1 JOIN p ON p.url = e1.dst JOIN e e2 ON e2.src = p.url WHERE e2.dst <> e1.src),
b AS (SELECT src, dst, min(hop) AS hop FROM (SELECT src, dst, 1 AS hop FROM e UNION ALL SELECT src, dst, 2 FROM h2) u
      GROUP BY src, dst)
SELECT p.page_id, b.dst, b.hop FROM b JOIN p ON p.url = b.src"""
    path = "'^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+"
    o["url_parts"] = f"""
SELECT page_id, CASE WHEN o <> '' AND r <> '' THEN o END AS owner, CASE WHEN o <> '' AND r <> '' THEN r END AS repo,
  nullif(regexp_extract(url, {q(C.PAGE_URL_PATTERN)}, 1), '') AS host,
  nullif(regexp_extract(url, {q(C.PAGE_URL_PATTERN)}, 2), '') AS lang,
  nullif(regexp_extract(url, {q(C.PAGE_URL_PATTERN)}, 3), '') AS num
FROM (SELECT page_id, url, regexp_extract(trim(url), {path}/([^/?#]+)', 1) AS o,
             regexp_extract(trim(url), {path}/[^/?#]+/([^/?#]+)', 1) AS r FROM pages) x"""
    return o


def labelling_oracles() -> dict[str, str]:
    from faultline.plans import labelling as L
    from faultline.functions.text import SEGMENT_SEPARATOR
    o: dict[str, str] = {}
    gold = "SELECT doc_id, 'quality_' || CAST(min(quality) AS VARCHAR) AS gold FROM labels GROUP BY doc_id"
    pred = (f"SELECT doc_id, CASE WHEN n_chars >= {L.PRED_MIN_CHARS} THEN 'quality_1' ELSE 'quality_0' END "
            f"AS predicted FROM documents")
    ver = (f"SELECT p.doc_id, p.predicted, g.gold, p.predicted = g.gold AS is_correct "
           f"FROM ({pred}) p JOIN ({gold}) g USING (doc_id)")
    o["verify_predictions"] = ver
    o["confusion_counts"] = (f"SELECT gold, predicted, count(*) AS n, first(is_correct) AS is_correct "
                             f"FROM ({ver}) v GROUP BY gold, predicted")
    o["category_summary"] = (f"SELECT predicted, count(*) AS n, min(doc_id) AS first_index, "
                             f"max(doc_id) AS last_index FROM ({pred}) p GROUP BY predicted")
    o["coverage_summary"] = f"""
SELECT count(*) AS total_tasks, count(*) FILTER (WHERE g.doc_id IS NOT NULL) AS tasks_with_labels,
  count(*) FILTER (WHERE g.doc_id IS NULL) AS tasks_without_labels, count(DISTINCT predicted) AS total_categories
FROM ({pred}) p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) g USING (doc_id)"""
    repos = "[" + ", ".join(q(r) for r in L.REPOS) + "]"
    o["category_by_repo"] = f"""
WITH p AS ({pred}),
lk AS (SELECT doc_id, min(source) AS repo FROM documents GROUP BY doc_id),
c AS (SELECT predicted, repo, count(*) AS n FROM p JOIN lk USING (doc_id) WHERE list_contains({repos}, repo)
      GROUP BY predicted, repo),
grid AS (SELECT predicted, unnest({repos}) AS repo FROM (SELECT DISTINCT predicted FROM p) d)
SELECT grid.predicted, grid.repo, coalesce(c.n, 0) AS n FROM grid LEFT JOIN c USING (predicted, repo)"""
    o["label_set_ops"] = """
SELECT doc_id, 'both' AS membership FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a
UNION ALL SELECT doc_id, 'documents_only' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b
UNION ALL SELECT doc_id, 'labels_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) c"""
    msg = _clean_sql("split_part(text, chr(10), 1)")
    rest = _clean_sql("CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END")
    task = f"""SELECT doc_id, CASE WHEN len(segs) > 0 THEN array_to_string(segs, {q(SEGMENT_SEPARATOR)}) END AS text
FROM (SELECT doc_id, list_filter([array_to_string({msg}, ' '), array_to_string({rest}, ' ')], lambda s: s <> '') AS segs
      FROM documents) d"""
    o["train_set"] = (f"SELECT t.doc_id, t.text, g.gold AS label FROM ({task}) t JOIN ({gold}) g USING (doc_id) "
                      f"WHERE t.text IS NOT NULL")
    o["predict_set"] = (f"SELECT doc_id, text FROM ({task}) t WHERE text IS NOT NULL "
                        f"AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
    # Stated from the rule: ten rounds; in each a partner of the same label other than the
    # example, and one of another label, both taken in turn in order of id.
    o["contrastive_pairs"] = """
WITH e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p,
                  count(*) OVER (PARTITION BY label) AS n, dense_rank() OVER (ORDER BY label) - 1 AS l FROM embeddings),
c AS (SELECT label, max(n) AS n, max(l) AS l FROM e GROUP BY label),
k AS (SELECT count(*) AS classes FROM c),
r AS (SELECT e.*, classes, unnest(range(1, 11)) AS j FROM e, k)
SELECT r.vec_id AS a_id, b.vec_id AS b_id, 1 AS target, CAST(j AS INT) AS j FROM r JOIN e b
  ON b.label = r.label AND b.p = (r.p + 1 + (j - 1) % (r.n - 1)) % r.n WHERE r.n > 1
UNION ALL
SELECT r.vec_id, b.vec_id, 0, CAST(j AS INT) FROM r
  JOIN c ON c.l = (r.l + 1 + (j - 1) % (classes - 1)) % classes
  JOIN e b ON b.label = c.label AND b.p = (r.p + j - 1) % c.n WHERE classes > 1"""
    o["classify_checks"] = "SELECT count(*) AS n_rows, count(*) AS n_sum_one, count(*) AS n_argmax, count(*) AS n_maximum FROM embeddings"
    o["prediction_accuracy"] = """
SELECT count(*) FILTER (WHERE p = g) AS correct, count(*) FILTER (WHERE p <> g) AS wrong,
       round(count(*) FILTER (WHERE p = g) / count(*), 6) AS accuracy
FROM (SELECT CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS p, quality AS g FROM documents JOIN labels USING (doc_id)) x"""
    o["task_category_pairs"] = "SELECT CASE WHEN n_chars >= 300 THEN 'quality_1' ELSE 'quality_0' END AS category, doc_id AS index FROM documents"
    o["class_measures"] = f"""
WITH p AS (SELECT g.gold, n_chars / (n_chars + {float(L.PRED_MIN_CHARS)}) AS good FROM documents JOIN
           (SELECT doc_id, 'quality_' || CAST(quality AS VARCHAR) AS gold FROM labels WHERE quality IS NOT NULL) g USING (doc_id) WHERE n_chars IS NOT NULL),
x AS (SELECT 'quality_0' AS class, gold = 'quality_0' AS y, 1 - good AS p, 1 - good >= good AS top FROM p
      UNION ALL SELECT 'quality_1', gold = 'quality_1', good, good > 1 - good FROM p),
b AS (SELECT class, least(CAST(floor(p * 1000) AS INT), 999) AS bin, y, p, top FROM x),
auc AS (SELECT a.class, sum(CASE WHEN a.bin > n.bin THEN 1.0 WHEN a.bin = n.bin THEN 0.5 ELSE 0 END * a.k * n.k) / (sum(a.k * n.k)) AS area
        FROM (SELECT class, bin, count(*) AS k FROM b WHERE y GROUP BY ALL) a JOIN (SELECT class, bin, count(*) AS k FROM b WHERE NOT y GROUP BY ALL) n USING (class)
        GROUP BY a.class),
cal AS (SELECT class, sum(off) AS off FROM (SELECT class, bin, abs(count(*) FILTER (WHERE y) - sum(p)) AS off FROM b GROUP BY class, bin) t GROUP BY class),
s AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE y AND top) AS tp, count(*) FILTER (WHERE top) AS chosen FROM b GROUP BY class)
SELECT class, n, pos AS n_class, tp AS n_correct, chosen AS n_predicted, round(tp / nullif(chosen, 0), 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall,
  round(2.0 * tp / nullif(chosen + pos, 0), 6)::DOUBLE AS f1, round(area, 6)::DOUBLE AS roc_area, round(off / n, 6) AS calibration_error
FROM s JOIN auc USING (class) JOIN cal USING (class)"""
    # All pairs listed in the order of their numbers, then the drawn ones picked.
    o["oversampled_pairs"] = f"""
WITH g AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS at FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT {L.PAIRS_A_ROW} * count(*) AS n FROM embeddings),
same AS (SELECT row_number() OVER (ORDER BY a.label, b.at, a.at) - 1 AS q, a.vec_id AS a_id, b.vec_id AS b_id FROM g a JOIN g b ON a.label = b.label AND a.at < b.at),
other AS (SELECT row_number() OVER (ORDER BY a.at, b.at) - 1 AS q, a.vec_id AS a_id, b.vec_id AS b_id FROM g a JOIN g b ON a.label < b.label),
k AS (SELECT unnest(range(n)) AS k, n FROM m),
t AS (SELECT (SELECT count(*) FROM same) AS p1, (SELECT count(*) FROM other) AS p0)
SELECT k, a_id, b_id, 1 AS target FROM k, t JOIN same ON q = CASE WHEN n <= p1 THEN k * p1 // n ELSE k % p1 END
UNION ALL SELECT k, a_id, b_id, 0 FROM k, t JOIN other ON q = CASE WHEN n <= p0 THEN k * p0 // n ELSE k % p0 END"""
    o["projection_checks"] = ("SELECT count(*) AS n_rows, count(*) AS n_sum_one, count(*) AS n_argmax, count(*) AS n_maximum, CAST(2 AS BIGINT) AS n_falling "
                              "FROM embeddings")
    return o
