"""DuckDB SQL for every registered query (the correctness oracle).

The stand-in rules, tokenizer steps and scorers are restated here in DuckDB's
dialect (lambda syntax, 'g' regex flag, HUGEINT sums cast back to BIGINT).
The lexicon, separators and rationales are shared constants; the patterns for
literals, tables, CTE names and page elements are written anew here, and
literal answers for fixed texts are in the tests.
"""

from __future__ import annotations

from sqlscore.functions.sqltext import LEXICON, MULTIWORD, SEP1, SEPARATORS, fused
from sqlscore.operators.keywords import FAIL, NO_GOLD, PASS
from sqlscore.operators.metrics import CORE_SHARE, CORE_WEIGHTS, CUSTOM_SHARE
from sqlscore.plans import pairs as P
from sqlscore.plans import queries as Q

R = Q.R  # rounding decimals, shared with the Spark outputs


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def kv(s: str) -> str:  # text with newlines as chr(10) concatenation
    return " || chr(10) || ".join(lit(x) for x in s.split("\n"))


# ------------------------------------------------------------ stand-ins

def _k():
    return "CAST(o_custkey AS VARCHAR)"


EVALS = f"""evals AS (
  SELECT o_orderkey AS eval_id, q AS question, q AS original_question,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE g END AS gold_sql,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Use the order date, not the ship date' END AS issues
  FROM (SELECT o_orderkey, o_custkey,
    CASE o_orderkey % 4
      WHEN 0 THEN 'How many orders per priority does customer ' || {_k()} || ' have?'
      WHEN 1 THEN 'What is the total spend of customer ' || {_k()} || ' by order status?'
      WHEN 2 THEN 'Which are the three largest orders of customer ' || {_k()} || '?'
      ELSE 'What is the average order value of customer ' || {_k()} || ' per year?' END AS q,
    CASE o_orderkey % 4
      WHEN 0 THEN 'SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_custkey = ' || {_k()} || ' GROUP BY o_orderpriority ORDER BY n DESC'
      WHEN 1 THEN 'SELECT o_orderstatus, SUM(o_totalprice) AS total FROM orders WHERE o_custkey = ' || {_k()} || ' GROUP BY o_orderstatus'
      WHEN 2 THEN 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ' || {_k()} || ' ORDER BY o_totalprice DESC LIMIT 3'
      ELSE 'WITH o AS (SELECT YEAR(o_orderdate) AS y, o_totalprice FROM orders WHERE o_custkey = ' || {_k()} || ') SELECT y, AVG(o_totalprice) AS avg_total FROM o GROUP BY y ORDER BY y' END AS g
  FROM orders))"""

CANDS = f"""cands AS (
  SELECT eval_id, original_question AS question, gold_sql,
    CASE eval_id % 5 WHEN 0 THEN g
      WHEN 1 THEN lower(g) || ' -- group by customer; order by nothing'
      WHEN 2 THEN 'SELECT t.* FROM (' || g || ') t JOIN customer c ON c.c_custkey = ' || regexp_extract(g, 'o_custkey = ([0-9]+)', 1)
        || ' WHERE c.c_name <> ' || chr(39) || 'GROUP BY x' || chr(39)
      WHEN 3 THEN 'SELECT `o_custkey`, last_join FROM `db`.`orders` o, customer AS c WHERE c_name = ' || chr(39) || 'it' || chr(92) || chr(39)
        || 's GROUP BY' || chr(39) || ' AND `o_custkey` = ' || CAST(eval_id AS VARCHAR)
      ELSE 'WITH RECURSIVE y (a, b) AS (SELECT EXTRACT(YEAR FROM o_orderdate), o_custkey FROM orders) SELECT * FROM y WHERE a IS DISTINCT FROM b AND b = '
        || CAST(eval_id AS VARCHAR) END AS candidate_sql
  FROM (SELECT *, coalesce(gold_sql, 'SELECT 1') AS g FROM evals))"""

_ONE = ("'{\"conversation_id\": \"c' || CAST(eval_id AS VARCHAR) || '\", \"created_timestamp\": ' || "
        "CAST(eval_id * 1000 AS VARCHAR) || ', \"attachments\": [{\"query\": {\"query\": ' || CAST(to_json(candidate_sql) AS VARCHAR) || "
        "', \"description\": \"answer\"}, \"row_count\": ' || CAST(eval_id % 50 AS VARCHAR) || '}]}'")
REPLIES = f"""replies AS (
  SELECT eval_id AS reply_id, question, CASE eval_id % 5
    WHEN 0 THEN '{{"conversation_id": "c' || CAST(eval_id AS VARCHAR) || '", "created_timestamp": 0, "attachments": [{{"text": "Which customer do you mean?"}}]}}'
    WHEN 1 THEN '{{"conversation_id": "c' || CAST(eval_id AS VARCHAR) || '", "created_timestamp": 0, "attachments": [{{"query": {{"query": "SELECT 1"}}}}, {{"text": "x"}}]}}'
    WHEN 2 THEN CASE eval_id % 3 WHEN 0 THEN '{{}}' WHEN 1 THEN NULL
      ELSE 'service unavailable for ' || CAST(eval_id AS VARCHAR) END
    ELSE {_ONE} END AS reply
  FROM cands)"""

CYCLE = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER)"
CM = f"""cm AS (SELECT user_id AS run_id, {CYCLE} AS cycle, event_type || '/mean' AS metric,
  avg(value) AS value, count(*) AS n FROM events GROUP BY ALL)"""


def _weight_case(weights: dict[str, float]) -> str:
    return "CASE metric " + " ".join(f"WHEN {lit(k)} THEN {float(v)!r}" for k, v in weights.items()) + " END"


QUALITY = f"""q AS (SELECT run_id, cycle,
  sum(value * coalesce({_weight_case(Q.QUALITY_WEIGHTS)}, 0.0)) / count(*) AS quality,
  count(*) AS n_metrics FROM cm GROUP BY ALL)"""

_U = "'u' || CAST(user_id AS VARCHAR)"
_D = "strftime(ts, '%Y%m%d')"
RUNS = f"""runs AS (
  SELECT 'r' || CAST(event_id AS VARCHAR) AS run_id, {_U} || '-d' || {_D} AS parent_run_id, {_U} AS root_run_id,
    event_type || ' run ' || CAST(event_id AS VARCHAR) AS run_name, 'optimization' AS mode FROM events
  UNION ALL SELECT DISTINCT {_U} || '-d' || {_D}, {_U}, {_U}, 'cycle ' || {_D}, 'cycle' FROM events
  UNION ALL SELECT DISTINCT {_U}, CAST(NULL AS VARCHAR), {_U}, 'experiment ' || {_U}, 'root' FROM events)"""


# ------------------------------------------------------------ tokenizer

def sq(s: str) -> str:
    """SQL text for a string that may contain the separator character."""
    parts = s.split(SEP1)
    out = []
    for i, part in enumerate(parts):
        if i:
            out.append("chr(1)")
        if part:
            out.append(lit(part))
    return "(" + " || ".join(out) + ")"


def chars(s: str) -> str:
    """SQL text for any string: printable runs as literals, the rest as chr(n)."""
    out, run = [], ""
    for ch in s:
        if 32 <= ord(ch) < 127:
            run += ch
        else:
            if run:
                out.append(lit(run))
                run = ""
            out.append(f"chr({ord(ch)})")
    if run:
        out.append(lit(run))
    return "(" + " || ".join(out) + ")"


# quoted text with backslash escapes, line comment, block comment
QUOTED = r"""('([^'\\]|\\.)*'|"([^"\\]|\\.)*"|--[^\n]*|/\*([^*]|\*+[^*/])*\*+/)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(QUOTED + '|`[^`]*`')}, ' ', 'g')"


def bare(x: str) -> str:
    """Quoted texts and comments out, quoted names without their quotes."""
    marked = f"regexp_replace({x}, {lit(QUOTED + '|(`[^`]*`)')}, {lit(chr(92) + '5 ')}, 'g')"
    return f"replace(regexp_replace({marked}, ' *[.] *', '.', 'g'), '`', '')"


def norm(x: str, whole: bool = False) -> str:
    """``whole``: all statements, and the words of quoted names."""
    s = f"replace({bare(x)}, ';', ' ')" if whole else f"split_part({strip(x)}, ';', 1)"
    s = f"translate({s}, {chars(SEPARATORS)}, {chars(SEP1 * len(SEPARATORS))})"
    s = f"regexp_replace({s}, chr(1) || chr(1) || '+', chr(1), 'g')"
    s = f"(chr(1) || chr(1) || upper(replace({s}, chr(1), chr(1) || chr(1))) || chr(1) || chr(1))"
    for phrase in MULTIWORD:
        search, repl = fused(phrase)
        s = f"replace({s}, {sq(search)}, {sq(repl)})"
    return s


def tokens(x: str, whole: bool = False) -> str:
    return f"string_split({norm(x, whole)}, chr(1))"


LEX = "(" + ", ".join(lit(k) for k in LEXICON) + ")"

HIST = f"""hist AS (
  SELECT eval_id, side, keyword, count(*) AS n FROM (
    SELECT eval_id, 'gold' AS side, unnest({tokens('gold_sql')}) AS keyword FROM cands
    UNION ALL SELECT eval_id, 'candidate' AS side, unnest({tokens('candidate_sql')}) AS keyword FROM cands) t
  WHERE keyword IN {LEX} GROUP BY ALL)"""

DIFF = """diff AS (
  SELECT eval_id, keyword,
    CAST(coalesce(sum(n) FILTER (WHERE side = 'gold'), 0) AS BIGINT) AS gold_n,
    CAST(coalesce(sum(n) FILTER (WHERE side = 'candidate'), 0) AS BIGINT) AS cand_n
  FROM hist GROUP BY ALL)"""

VERDICT = f"""kverdict AS (
  SELECT c.eval_id, CASE WHEN gold_sql IS NOT NULL THEN coalesce(p.nd, 0) = 0 END AS value,
    CASE WHEN gold_sql IS NOT NULL THEN CAST(coalesce(p.nd, 0) AS BIGINT) END AS n_diff_keywords,
    CASE WHEN gold_sql IS NULL THEN {lit(NO_GOLD)} WHEN coalesce(p.nd, 0) = 0 THEN {lit(PASS)} ELSE {lit(FAIL)} END AS rationale
  FROM cands c LEFT JOIN (SELECT eval_id, count(*) FILTER (WHERE gold_n <> cand_n) AS nd FROM diff GROUP BY 1) p
  USING (eval_id))"""


def join_count(x: str) -> str:
    return f"CAST(len(list_filter({tokens(x)}, lambda t: t = 'JOIN' OR ends_with(t, ' JOIN'))) AS INTEGER)"


def has_select(x: str) -> str:
    return f"coalesce(list_contains({tokens(x)}, 'SELECT'), false)"


def tables_used(x: str) -> str:
    """After FROM or JOIN a name, and one after each comma that follows a name and its alias."""
    no_calls = f"replace(regexp_replace(lower({bare(x)}), 'extract *[(][^()]*[)]|is distinct from', ' ', 'g'), ' join ', ' ; join ')"
    chains = (f"regexp_extract_all(' ' || {no_calls}, '[^a-z0-9_](from|join) +([a-z_][a-z0-9_.]*"
              "( +as)?( +[a-z_][a-z0-9_]*)?( *, *[a-z_][a-z0-9_.]*( +as)?( +[a-z_][a-z0-9_]*)?)*)', 2)")
    found = f"flatten(list_transform({chains}, lambda c: list_transform(string_split(c, ','), lambda y: split_part(trim(y), ' ', 1))))"
    ctes = (f"regexp_extract_all(' ' || {no_calls}, '(?:[^a-z0-9_]with|[^a-z0-9_]with +recursive|,) *([a-z_][a-z0-9_]*)"
            " *(?:[(][^()]*[)] *)?as *[(]', 1)")
    return f"list_sort(list_distinct(list_filter({found}, lambda y: NOT list_contains({ctes}, y))))"


def except_text(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE "
            f"array_to_string(list_filter({a}, lambda y: NOT list_contains({b}, y)), ',') END")


DIMS = "[" + ", ".join(lit(d) for d in Q.REQUIRED_DIMS) + "]"
RULES = f"""r_joins AS (SELECT eval_id, {join_count('gold_sql')} AS gold_joins, {join_count('candidate_sql')} AS cand_joins FROM cands),
r_select AS (SELECT eval_id, {has_select('gold_sql')} AS gold_has_select, {has_select('candidate_sql')} AS cand_has_select FROM cands),
r_tab0 AS (SELECT eval_id, {tables_used('gold_sql')} AS gt, {tables_used('candidate_sql')} AS ct FROM cands),
r_tables AS (SELECT eval_id, {except_text('gt', 'ct')} AS missing_tables, {except_text('ct', 'gt')} AS extra_tables FROM r_tab0),
r_dims AS (SELECT eval_id, array_to_string(list_filter({DIMS}, lambda d: NOT list_contains(list_transform({tokens('candidate_sql', True)}, lambda t: lower(t)), d)), ',') AS missing_dims FROM cands)"""


# ------------------------------------------------------------ results

def _strip(t: str) -> str:
    t = t.strip()
    while t.endswith(";"):
        t = t[:-1].rstrip()
    return t


def _pair_rows(kind: str) -> str:
    parts = []
    for pid, (g, c) in P.PAIRS.items():
        err = P.EXPECTED_ERRORS.get(pid)
        if err is not None:
            if kind == "verdict":
                parts.append(f"SELECT {lit(pid)} AS pair_id, CAST(NULL AS BIGINT) AS gold_rows, CAST(NULL AS BIGINT) AS cand_rows, "
                             f"CAST(NULL AS BIGINT) AS only_in_gold, CAST(NULL AS BIGINT) AS only_in_candidate, "
                             f"false AS value, {lit(err)} AS error")
            else:
                parts.append(f"SELECT {lit(pid)} AS pair_id, CAST(NULL AS BIGINT) AS gold_rows, CAST(NULL AS BIGINT) AS cand_rows, false AS fp_match")
            continue
        body = (f"WITH g AS ({_strip(g)}), c AS ({_strip(c)}), "
                f"s AS (SELECT (SELECT count(*) FROM g) AS gr, (SELECT count(*) FROM c) AS cr, "
                f"(SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM c) x) AS og, "
                f"(SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM g) y) AS oc) ")
        if kind == "verdict":
            body += (f"SELECT {lit(pid)} AS pair_id, gr AS gold_rows, cr AS cand_rows, og AS only_in_gold, "
                     f"oc AS only_in_candidate, (og = 0 AND oc = 0) AS value, CAST(NULL AS VARCHAR) AS error FROM s")
        else:
            body += f"SELECT {lit(pid)} AS pair_id, gr AS gold_rows, cr AS cand_rows, (og = 0 AND oc = 0) AS fp_match FROM s"
        parts.append(f"SELECT * FROM ({body})")
    return "\nUNION ALL\n".join(parts)


def _result_scores() -> str:
    names = sorted(P.PAIRS)
    pick = " ".join(f"WHEN {i} THEN {lit(n)}" for i, n in enumerate(names))
    return (f"WITH v AS ({_pair_rows('verdict')}), p AS (SELECT o_orderkey AS eval_id, CASE o_orderkey % {len(names)} {pick} END AS pair FROM orders) "
            "SELECT eval_id, pair, value, only_in_gold, only_in_candidate, error, "
            "CAST(CASE WHEN value OR error IS NOT NULL THEN 0 ELSE least(5, only_in_gold) END AS INTEGER) AS n_sample_gold, "
            "CAST(CASE WHEN value OR error IS NOT NULL THEN 0 ELSE least(5, only_in_candidate) END AS INTEGER) AS n_sample_candidate, "
            "CASE WHEN error IS NOT NULL THEN 'Not compared: ' || error || '.' "
            "WHEN value THEN 'Both queries return the same ' || gold_rows || ' rows.' "
            "ELSE only_in_gold || ' of ' || gold_rows || ' gold rows and ' || only_in_candidate || ' of ' || cand_rows "
            "|| ' candidate rows have no partner.' END AS rationale FROM p JOIN v ON p.pair = v.pair_id")


def _ordered_rows() -> str:
    parts = []
    for pid, (g, c, g_place, c_place) in P.ORDERED_PAIRS.items():
        sides = []
        for text, place in ((g, g_place), (c, c_place)):
            n = 1 if "MAX(" in text or "s_name" in text or "LIMIT 1" in text else 2
            cols = ", ".join(f"c{i}" for i in range(n))
            sides.append(f"SELECT {cols}, {place} AS place FROM ({text}) t({cols})")
        parts.append(f"SELECT * FROM (WITH g AS ({sides[0]}), c AS ({sides[1]}), s AS (SELECT (SELECT count(*) FROM g) AS gr, "
                     "(SELECT count(*) FROM c) AS cr, (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM c) x) AS og, "
                     "(SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM g) y) AS oc) "
                     f"SELECT {lit(pid)} AS pair_id, gr AS gold_rows, cr AS cand_rows, og AS only_in_gold, oc AS only_in_candidate, "
                     "(og = 0 AND oc = 0) AS value, CAST(NULL AS VARCHAR) AS error FROM s)")
    return "\nUNION ALL\n".join(parts)


def _confirmed() -> str:
    cols = "l_orderkey AS _c0, l_linenumber AS _c1, l_partkey AS _c2, l_quantity AS _c3"
    sides = [f"SELECT {cols}, {lit(side)} AS side, count(*) AS mult FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) GROUP BY ALL"
             for side, a, b in (("gold", "g", "c"), ("candidate", "c", "g"))]
    return f"WITH g AS ({P.ALTERED_GOLD}), c AS ({P.ALTERED_CAND}) " + " UNION ALL ".join(sides)


def _many() -> str:
    """The verdicts by plain counts per nation: the second candidate leaves customers
    without a positive balance out, the third is about suppliers, the fourth has no GROUP BY."""
    return """
        WITH g AS (SELECT c_nationkey AS k, c_mktsegment AS v, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS m FROM customer GROUP BY ALL),
             s AS (SELECT s_nationkey AS k, s_name AS v, count(*) AS n FROM supplier GROUP BY ALL),
             t AS (SELECT n_nationkey, unnest([0, 1, 2, 3]) AS variant FROM nation),
             a AS (SELECT k, count(*) AS gr, count(*) FILTER (m > 0) AS cr, count(*) FILTER (m <> n) AS og,
                          count(*) FILTER (m <> n AND m > 0) AS oc FROM g GROUP BY k),
             b AS (SELECT k, count(*) AS sr FROM s GROUP BY k),
             r AS (SELECT n_nationkey, variant, coalesce(gr, 0) AS gold_rows,
                     CASE variant WHEN 0 THEN coalesce(gr, 0) WHEN 1 THEN coalesce(cr, 0) ELSE coalesce(sr, 0) END AS cand_rows,
                     CASE variant WHEN 0 THEN 0 WHEN 1 THEN coalesce(og, 0) ELSE coalesce(gr, 0) END AS only_in_gold,
                     CASE variant WHEN 0 THEN 0 WHEN 1 THEN coalesce(oc, 0) ELSE coalesce(sr, 0) END AS only_in_candidate
                   FROM t LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey WHERE variant < 3)
        SELECT n_nationkey, CAST(variant AS INTEGER) AS variant, only_in_gold = 0 AND only_in_candidate = 0 AS value, gold_rows, cand_rows,
               only_in_gold, only_in_candidate, CAST(NULL AS VARCHAR) AS error,
               CAST(least(5, only_in_gold) AS INTEGER) AS n_sample_gold, CAST(least(5, only_in_candidate) AS INTEGER) AS n_sample_candidate FROM r
        UNION ALL SELECT n_nationkey, 3, false, NULL, NULL, NULL, NULL, 'candidate:missing_group_by', 0, 0 FROM nation"""


def _judged() -> str:
    """Feedback per pair of texts, dealt out over the orders as the rows are."""
    names = sorted(P.PAIRS)
    text = lambda t: "CAST(NULL AS VARCHAR)" if t is None else lit(t)
    cands = " UNION ALL ".join(f"SELECT {i} AS eval_id, {lit(n)} AS pair, {text(P.PAIRS[n][0])} AS gold_sql, {text(P.PAIRS[n][1])} AS candidate_sql"
                               for i, n in enumerate(names))
    guidelines = ", ".join(f"({lit('judged_' + k)}, {lit(v)})" for k, v in Q.GUIDELINES.items())
    weights = " ".join(f"WHEN {lit(k)} THEN {v!r}" for k, v in CORE_WEIGHTS.items())
    return f"""WITH v AS ({_pair_rows('verdict')}), cands AS ({cands}), {HIST}, {DIFF}, {VERDICT},
        j AS (SELECT eval_id, scorer, length(request) AS n FROM (SELECT eval_id, scorer, 'Guideline: ' || guideline || chr(10) || 'Expected SQL: '
                || coalesce(gold_sql, '') || chr(10) || 'Candidate SQL: ' || coalesce(candidate_sql, '') AS request
              FROM cands, (VALUES {guidelines}) g(scorer, guideline))),
        fb AS (SELECT eval_id, 'count_joins' AS scorer, CAST({join_count('gold_sql')} = {join_count('candidate_sql')} AS DOUBLE) AS x,
                 concat_ws(' ', 'joins:', {join_count('gold_sql')}, 'and', {join_count('candidate_sql')}) AS line FROM cands
               UNION ALL SELECT eval_id, 'sql_clauses_distribution_equivalence', CAST(value AS DOUBLE), rationale FROM kverdict
               UNION ALL SELECT eval_id, 'sql_results_equivalence', CAST(value AS DOUBLE), CASE WHEN error IS NOT NULL THEN 'Not compared: ' || error || '.'
                 WHEN value THEN 'Both queries return the same ' || gold_rows || ' rows.' ELSE only_in_gold || ' of ' || gold_rows
                 || ' gold rows and ' || only_in_candidate || ' of ' || cand_rows || ' candidate rows have no partner.' END
                 FROM v JOIN cands ON pair = pair_id
               UNION ALL SELECT eval_id, scorer, CASE WHEN n % 7 < 2 THEN NULL WHEN n % 7 = 2 THEN CAST(n % 2 AS DOUBLE) ELSE (n % 5) / 4.0 END,
                 CASE n % 7 WHEN 0 THEN 'parse' WHEN 1 THEN 'score' ELSE 'length ' || n END FROM j),
        m AS (SELECT eval_id, x, CASE scorer || '/mean' {weights} END AS w FROM fb WHERE x IS NOT NULL),
        s AS (SELECT eval_id, count(*) AS n_metrics, coalesce(sum(x * w), 0.0) AS core, count(*) FILTER (w IS NULL) AS n_custom,
                coalesce(sum(x) FILTER (w IS NULL), 0.0) AS custom FROM m GROUP BY 1),
        t AS (SELECT eval_id, string_agg(scorer || ': ' || line, chr(10) ORDER BY scorer) AS feedback, count(*) AS n_feedback FROM fb GROUP BY 1)
        SELECT o_orderkey AS eval_id, feedback, n_feedback, coalesce(n_metrics, 0) AS n_metrics,
               round({CORE_SHARE!r} * core / n_metrics + {CUSTOM_SHARE!r} * CASE WHEN n_custom = 0 THEN 0.0 ELSE custom / n_custom / n_metrics END, {R}) AS composite
        FROM orders JOIN t ON t.eval_id = o_orderkey % {len(names)} LEFT JOIN s ON s.eval_id = t.eval_id"""


_LATE = """WITH e AS (SELECT *, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6, 4) AS step FROM events),
        a AS (SELECT *, event_id % 40 = 7 AND step < 4 AS late FROM e),
        w AS (SELECT max(ts) FILTER (NOT late AND step < 4 AND event_id % 40 <> 7) - INTERVAL 1 HOUR AS before_last, max(ts) - INTERVAL 1 HOUR AS at_end FROM a),
        k AS (SELECT *, NOT late OR date_trunc('day', ts) + INTERVAL 1 DAY > before_last AS kept FROM a, w
              WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= at_end)
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, round(avg(value) FILTER (kept), {R}) AS mean,
               count(*) FILTER (kept) AS n, count(*) FILTER (NOT kept) AS n_late FROM k GROUP BY ALL HAVING count(*) FILTER (kept) > 0"""


def _diff_rows(sample: bool) -> str:
    sides = []
    for side, a, b in (("gold", "g", "c"), ("candidate", "c", "g")):
        q = (f"SELECT _c0, _c1, _c2, {lit(side)} AS side, count(*) AS mult FROM "
             f"(SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) t(_c0, _c1, _c2) GROUP BY ALL")
        if sample:
            q = f"SELECT * FROM ({q}) ORDER BY _c0, _c1, _c2 LIMIT 5"
        sides.append(f"SELECT * FROM ({q})")
    return f"WITH g AS ({P.DIFF_GOLD}), c AS ({P.DIFF_CAND}) " + " UNION ALL ".join(sides)


# ------------------------------------------------------------ the map

def oracle_sql() -> dict[str, str]:
    W = f"WITH {EVALS}"
    WC = f"WITH {EVALS}, {CANDS}"
    prompt = Q.PROMPT
    lvl = ("CASE WHEN value < 50 THEN 'DEBUG' WHEN value < 150 THEN 'INFO' "
           "WHEN value < 300 THEN 'WARNING' ELSE 'ERROR' END")
    sql = {
        "result_equiv": _pair_rows("verdict"),
        "result_fingerprint": _pair_rows("fingerprint"),
        "result_equiv_ordered": _ordered_rows(),
        "result_confirm_diff": _confirmed(),
        "evaluate_many": _many(),
        "evaluate_judged": _judged(),
        "row_context": f"{WC}, {RULES} SELECT c.eval_id, question, 2 AS n, 'count_joins,has_select' AS scorers, "
                       "CAST(coalesce(gold_joins = cand_joins, false) AS INTEGER) + CAST(gold_has_select AS INTEGER) AS n_true "
                       "FROM cands c JOIN r_joins j ON c.eval_id = j.eval_id JOIN r_select s ON c.eval_id = s.eval_id",
        "model_resume": f"{W} SELECT eval_id, question, 'SELECT ' || length(question) || ' AS n' AS answer, CAST(NULL AS VARCHAR) AS error, "
                        "CAST(1 AS BIGINT) AS n_calls FROM evals",
        "eval_null_issues": f"{W} SELECT eval_id, question, CAST(NULL AS VARCHAR) AS issues, count(*) OVER () AS n_rows FROM evals",
        "eval_split_stratified": f"{W}, l AS (SELECT eval_id, CASE WHEN eval_id % 3 = 0 THEN 'hot' ELSE 'l' || (eval_id % 211) END AS label FROM evals), "
                                 "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(CAST(eval_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT), "
                                 "eval_id) AS nth, count(*) OVER (PARTITION BY label) AS n FROM l) SELECT eval_id, label, CASE WHEN nth <= "
                                 "CASE WHEN n = 1 THEN 0 ELSE least(greatest(floor(n * 0.3 + 0.5), 1), n - 1) END THEN 'test' ELSE 'train' END AS split FROM r",
        "stream_late_means": _LATE,
        "result_diff_rows": _diff_rows(False),
        "result_diff_sample": _diff_rows(True),
        "eval_set": f"{W} SELECT * FROM evals",
        "eval_replicate": f"{W} SELECT eval_id, question, CAST(r AS INTEGER) AS replica FROM evals, range(3) t(r)",
        "eval_prefix": f"{W} SELECT eval_id, {kv(Q.INSTRUCTION)} || chr(10) || original_question AS question, original_question FROM evals",
        "eval_replace_terms": f"{W} SELECT eval_id, gold_sql, "
                              + "regexp_replace(regexp_replace(gold_sql, 'orders', 'orders_v2', 'g'), 'o_custkey', 'o_customer_key', 'g') "
                              + "AS updated_gold_sql FROM evals",
        "eval_split": f"{W} SELECT eval_id, CASE WHEN CAST('0x' || substr(md5(CAST(eval_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 1000 < 300 "
                      "THEN 'test' ELSE 'train' END AS split FROM evals",
        "eval_questions": f"{W} SELECT eval_id, question, original_question FROM evals",
        "eval_request": f"{W} SELECT eval_id, question, CAST(CASE WHEN issues IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_guidelines, "
                        "issues AS guideline, gold_sql AS expected_response FROM evals",
        "eval_prepare": f"{W} SELECT eval_id, question, CAST(r AS INTEGER) AS replica FROM "
                        "(SELECT eval_id, question FROM evals ORDER BY eval_id LIMIT 500) e, range(2) t(r)",
        "eval_batches": f"{W} SELECT eval_id, CAST(floor((row_number() OVER (ORDER BY eval_id) - 1) / 64) AS BIGINT) AS batch FROM evals",
        "guideline_requests": f"{WC}, g(guideline, guideline_text) AS (VALUES "
                              + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in Q.GUIDELINES.items())
                              + ") SELECT eval_id, guideline, concat_ws(chr(10), guideline_text, question, candidate_sql) AS request "
                              "FROM cands, g",
        "gold_lookup": f"{WC}, g AS (SELECT original_question AS question, min(eval_id) AS gold_eval_id FROM evals GROUP BY 1) "
                       "SELECT c.eval_id, c.question, g.gold_eval_id, e.gold_sql FROM cands c LEFT JOIN g USING (question) "
                       "LEFT JOIN evals e ON e.eval_id = g.gold_eval_id",
        "user_questions": "SELECT conv_id, turn, text AS question, CAST(NULL AS VARCHAR) AS gold_sql, CAST(NULL AS VARCHAR) AS issues "
                          "FROM conversations WHERE role = 'user' AND text IS NOT NULL AND trim(text) <> ''",
        "keyword_hist": f"{WC}, {HIST} SELECT * FROM hist",
        "keyword_diff": f"{WC}, {HIST}, {DIFF} SELECT eval_id, keyword, gold_n, cand_n, gold_n - cand_n AS diff FROM diff",
        "keyword_metadata": f"{WC}, {HIST.replace('FROM cands', 'FROM cands WHERE gold_sql IS NOT NULL')}, {DIFF}, "
                            "d AS (SELECT *, max(CAST(gold_n <> cand_n AS INTEGER)) OVER (PARTITION BY eval_id) AS differs FROM diff) "
                            "SELECT eval_id, keyword, CAST(gold_n - cand_n AS INTEGER) AS diff FROM d WHERE differs = 1",
        "keyword_verdict": f"{WC}, {HIST}, {DIFF}, {VERDICT} SELECT * FROM kverdict",
        "rule_count_joins": f"{WC}, {RULES} SELECT eval_id, gold_joins, cand_joins, gold_joins = cand_joins AS value FROM r_joins",
        "rule_has_select": f"{WC}, {RULES} SELECT eval_id, gold_has_select, cand_has_select, gold_has_select AS value FROM r_select",
        "rule_tables": f"{WC}, {RULES} SELECT eval_id, missing_tables, extra_tables, "
                       "(missing_tables = '') AND (extra_tables = '') AS value FROM r_tables",
        "rule_required_dims": f"{WC}, {RULES} SELECT eval_id, missing_dims, missing_dims = '' AS value FROM r_dims",
        # literal answers by construction of the texts
        "rule_tables_nested": "SELECT o_orderkey AS eval_id, CASE o_orderkey % 6 WHEN 0 THEN 'orders' WHEN 1 THEN 'customer,orders' "
                              "WHEN 2 THEN 'my db.my table,orders' WHEN 3 THEN 'customer,nation,orders' WHEN 4 THEN 'orders' "
                              "ELSE 'nation,orders' END AS tables FROM orders",
        "keyword_nested": "SELECT o_orderkey AS eval_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['FROM', 'SELECT'] "
                          "WHEN 1 THEN ['FROM', 'SELECT', 'WHERE'] ELSE ['AND', 'FROM', 'SELECT', 'WHERE'] END) AS keyword, CAST(1 AS BIGINT) AS n FROM orders",
        "rule_limit_without_order": f"{WC} SELECT eval_id, "
                                    f"list_contains({tokens('gold_sql')}, 'LIMIT') AND NOT list_contains({tokens('gold_sql')}, 'ORDER BY') "
                                    "AS gold_sql_unordered_limit, "
                                    f"list_contains({tokens('candidate_sql')}, 'LIMIT') AND NOT list_contains({tokens('candidate_sql')}, 'ORDER BY') "
                                    "AS candidate_sql_unordered_limit FROM cands",
        "evaluate_all": f"{WC}, {HIST}, {DIFF}, {VERDICT}, {RULES}, fb AS ("
                        "SELECT 'sql_clauses_distribution_equivalence' AS scorer, value FROM kverdict "
                        "UNION ALL SELECT 'count_joins', gold_joins = cand_joins FROM r_joins "
                        "UNION ALL SELECT 'has_select', gold_has_select FROM r_select "
                        "UNION ALL SELECT 'dimension_ambiguity', (missing_tables = '') AND (extra_tables = '') FROM r_tables "
                        "UNION ALL SELECT 'required_dims', missing_dims = '' FROM r_dims) "
                        "SELECT scorer, 'avg_' || scorer AS metric_name, round(avg(CAST(value AS DOUBLE)), {R}) AS mean, "
                        "count(*) AS n FROM fb GROUP BY ALL",
        "metric_means": f"SELECT user_id AS run_id, {CYCLE} AS cycle, event_type AS scorer, 'avg_' || event_type AS metric_name, "
                        "round(avg(CAST(value >= 100 AS DOUBLE)), {R}) AS mean, count(*) AS n FROM events GROUP BY ALL",
        "label_means": "WITH lab AS (SELECT doc_id, scorer, value FROM labels UNPIVOT INCLUDE NULLS (value FOR scorer IN (quality, toxic))) "
                       "SELECT d.source AS run_id, scorer, 'avg_' || scorer AS metric_name, round(avg(CAST(value AS DOUBLE)), {R}) AS mean, "
                       "count(*) AS n FROM lab JOIN documents d USING (doc_id) GROUP BY ALL",
        "quality_score": f"WITH {CM}, {QUALITY} SELECT run_id, cycle, round(quality, {R}) AS quality, n_metrics FROM q",
        "composite_score": f"WITH {CM}, c AS (SELECT run_id, cycle, count(*) AS n_metrics, "
                           f"count(*) FILTER (WHERE {_weight_case(Q.COMPOSITE_CORE)} IS NULL) AS n_custom, "
                           f"sum(value * coalesce({_weight_case(Q.COMPOSITE_CORE)}, 0.0)) AS core_sum, "
                           f"coalesce(sum(value) FILTER (WHERE {_weight_case(Q.COMPOSITE_CORE)} IS NULL), 0.0) AS custom_sum "
                           "FROM cm GROUP BY ALL), s AS (SELECT *, 0.7 * (core_sum / n_metrics) AS core_score, "
                           "CASE WHEN n_custom = 0 THEN 0.0 ELSE 0.3 * (custom_sum / n_custom / n_metrics) END AS custom_score FROM c) "
                           "SELECT run_id, cycle, n_metrics, n_custom, round(core_score, {R}) AS core_score, "
                           "round(custom_score, {R}) AS custom_score, round(core_score + custom_score, {R}) AS composite FROM s",
        "feedback_text": "SELECT conv_id, role, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS text, count(*) AS n_items "
                         "FROM conversations GROUP BY conv_id, role",
        "feedback_text_parts": "WITH a AS (SELECT *, coalesce(length(text), 0) AS l FROM conversations), "
                               "b AS (SELECT *, CAST(floor((sum(l) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN "
                               f"UNBOUNDED PRECEDING AND CURRENT ROW) - l) / {Q.TEXT_PART_CHARS}) AS BIGINT) AS part FROM a) "
                               "SELECT conv_id, role, part, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS text, "
                               "count(*) AS n_items FROM b GROUP BY conv_id, role, part",
        "quality_gate": f"WITH {CM}, {QUALITY} SELECT run_id, cycle, round(quality, {R}) AS quality, quality >= {Q.GATE!r} AS passes FROM q",
        "runs_vs_baseline": f"WITH {CM}, b AS (SELECT run_id, metric, arg_min(value, cycle) AS baseline FROM cm GROUP BY ALL) "
                            "SELECT run_id, cycle, metric, round(value, {R}) AS value, round(baseline, {R}) AS baseline, "
                            "round(value - baseline, {R}) AS delta FROM cm LEFT JOIN b USING (run_id, metric)",
        "cycle_lookback": f"WITH {CM}, {QUALITY} SELECT run_id, cycle, round(quality, {R}) AS quality, "
                          "array_to_string(list(CAST(cycle AS VARCHAR)) OVER w, ',') AS context_cycles, "
                          "round(avg(quality) OVER w, {R}) AS context_mean FROM q "
                          "WINDOW w AS (PARTITION BY run_id ORDER BY cycle ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
        "cycle_lookback_texts": "WITH v AS (SELECT concat_ws('/', conv_id, role) AS thread, turn, text FROM conversations) "
                                "SELECT thread, turn, array_to_string(list(coalesce(text, '')) OVER w, chr(10)) AS context, "
                                "round(avg(length(text)) OVER w, {R}) AS context_mean FROM v "
                                "WINDOW w AS (PARTITION BY thread ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
        "cycle_prev_curr": f"WITH {CM}, {QUALITY} SELECT run_id, cycle, round(quality, {R}) AS quality, "
                           "round(lag(quality) OVER (PARTITION BY run_id ORDER BY cycle), {R}) AS prev_quality FROM q",
        "cycle_drift": f"WITH {CM}, d AS (SELECT *, lag(value) OVER (PARTITION BY run_id, metric ORDER BY cycle) AS prev_value FROM cm) "
                       "SELECT run_id, cycle, metric, round(value, {R}) AS value, round(prev_value, {R}) AS prev_value, "
                       "round(value - prev_value, {R}) AS diff, round((value - prev_value) / NULLIF(prev_value, 0), {R}) AS rel_change FROM d",
        "prompt_token_diff": "WITH v AS (SELECT concat_ws('/', conv_id, role) AS thread, turn, text FROM conversations), "
                             "a AS (SELECT thread, turn, text, lag(turn) OVER (PARTITION BY thread ORDER BY turn) AS prev_turn FROM v), "
                             "t AS (SELECT thread, turn, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS token FROM a), "
                             "c AS (SELECT thread, turn, token, count(*) AS n FROM t GROUP BY ALL), "
                             "s AS (SELECT thread, prev_turn AS f, turn AS t FROM a WHERE prev_turn IS NOT NULL), "
                             "b AS (SELECT c.thread, c.turn, c.token, c.n AS curr_n, 0 AS prev_n FROM c JOIN s "
                             "ON c.thread = s.thread AND c.turn = s.t "
                             "UNION ALL SELECT c.thread, s.t AS turn, c.token, 0 AS curr_n, c.n AS prev_n FROM c JOIN s "
                             "ON c.thread = s.thread AND c.turn = s.f) "
                             "SELECT thread, turn, token, CAST(sum(curr_n) AS BIGINT) AS curr_n, CAST(sum(prev_n) AS BIGINT) AS prev_n, "
                             "CAST(sum(curr_n) - sum(prev_n) AS BIGINT) AS diff FROM b GROUP BY ALL HAVING sum(curr_n) <> sum(prev_n)",
        "latest_instruction": "SELECT concat_ws('/', conv_id, role) AS thread, max(turn) AS turn, arg_max(text, turn) AS text "
                              "FROM conversations GROUP BY 1",
        "best_cycle": f"WITH {CM}, {QUALITY} SELECT run_id, cycle, round(quality, {R}) AS quality FROM "
                      "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY quality DESC, cycle) AS rn FROM q) WHERE rn = 1",
        "best_cycles_top10": f"WITH {CM}, {QUALITY} SELECT run_id, cycle, round(quality, {R}) AS quality FROM q "
                             "ORDER BY quality DESC, run_id, cycle LIMIT 10",
        "cycle_numbering": f"WITH {RUNS} SELECT run_id, root_run_id, CAST(dense_rank() OVER (PARTITION BY root_run_id "
                           "ORDER BY substr(run_name, 7, 8)) AS INTEGER) AS cycle FROM runs WHERE mode = 'cycle'",
        # a parent's name follows from the event's user and day, so no join is needed here
        "runs_parent_name": f"SELECT 'r' || CAST(event_id AS VARCHAR) AS run_id, {_U} || '-d' || {_D} AS parent_run_id, "
                            f"event_type || ' run ' || CAST(event_id AS VARCHAR) AS run_name, 'cycle ' || {_D} AS parent_run_name FROM events "
                            f"UNION ALL SELECT DISTINCT {_U} || '-d' || {_D}, {_U}, 'cycle ' || {_D}, 'experiment ' || {_U} FROM events "
                            f"UNION ALL SELECT DISTINCT {_U}, CAST(NULL AS VARCHAR), 'experiment ' || {_U}, CAST(NULL AS VARCHAR) FROM events",
        "runs_under_roots": f"WITH {RUNS} SELECT run_id, root_run_id, mode FROM runs WHERE root_run_id IN "
                            "(SELECT 'u' || CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error')",
        "runs_clean_columns": f"WITH {RUNS} SELECT run_id, run_name, mode AS run_mode, CAST(length(run_name) AS INTEGER) AS name_length FROM runs",
        "pack_documents": f"WITH n AS (SELECT CAST(greatest(1, ceil(sum(n_chars) / {float(Q.PACK_TARGET_CHARS)!r})) AS BIGINT) AS n "
                          "FROM documents) SELECT doc_id % n AS group_id, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
                          "string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents, n GROUP BY 1",
        "sectionise": "WITH x AS (SELECT page_id, regexp_extract_all(html, "
                      "'(?is)(?:<h[1-6]>|<h[1-6]\\s[^>]*>).*?</h[1-6]\\s*>|(?:<li>|<li\\s[^>]*>).*?</li\\s*>') AS els FROM pages), "
                      "e AS (SELECT page_id, generate_subscripts(els, 1) - 1 AS pos, unnest(els) AS el FROM x), "
                      "m AS (SELECT page_id, pos, starts_with(lower(el), '<h') AS is_h, trim(regexp_replace(regexp_replace("
                      "el, '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS txt0 FROM e), "
                      "m2 AS (SELECT page_id, pos, is_h, CASE WHEN is_h THEN regexp_replace(trim(txt0), '^:+|:+$', '', 'g') ELSE txt0 END AS txt, "
                      "sum(CAST(is_h AS INTEGER)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM m), "
                      "s AS (SELECT page_id, section, max(CASE WHEN is_h THEN txt END) AS heading, "
                      "coalesce(list(txt ORDER BY pos) FILTER (WHERE NOT is_h), CAST([] AS VARCHAR[])) AS items "
                      "FROM m2 WHERE section > 0 GROUP BY ALL), "
                      "l AS (SELECT page_id, heading, arg_max(items, section) AS items FROM s GROUP BY ALL) "
                      "SELECT page_id, heading, CAST(len(items) AS INTEGER) AS n_bullets, array_to_string(items, chr(10)) AS bullets FROM l",
        "url_message_id": "SELECT page_id, url, CASE WHEN strpos(url, 'm=') > 0 THEN regexp_extract(url, '^.*m=(.*)$', 1) "
                          "ELSE url END AS message_id FROM pages",
        "prompt_render": f"{W} SELECT eval_id, " + _render_sql(prompt) + " AS prompt FROM evals",
        "reply_parse": "WITH p AS (SELECT event_id, props, json_valid(props) AS ok FROM events) "
                       "SELECT event_id, CASE WHEN ok THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, "
                       "CASE WHEN ok THEN json_extract_string(props, '$.ai_system_instruction') END AS instruction, "
                       "props IS NOT NULL AND NOT ok AS parse_error FROM p",
        "reply_status": f"{WC}, {REPLIES}, {_STATUS} SELECT reply_id, status FROM st",
        "telemetry_flatten": f"{WC}, {REPLIES}, {_STATUS} SELECT reply_id, status, "
                             "CASE WHEN ok THEN json_extract_string(reply, '$.conversation_id') END AS conversation_id, "
                             "CASE WHEN status = 'ok' THEN json_extract_string(reply, '$.attachments[0].query.query') END AS candidate_sql, "
                             "CASE WHEN status = 'ok' THEN CAST(json_extract(reply, '$.attachments[0].row_count') AS BIGINT) END AS row_count, "
                             "CASE WHEN ok THEN CAST(floor(CAST(json_extract(reply, '$.created_timestamp') AS BIGINT) / 1000) AS BIGINT) END AS created_s "
                             "FROM st",
        "model_apply": f"{W} SELECT eval_id, CASE WHEN eval_id % 53 = 0 OR eval_id % 101 = 0 THEN NULL "
                       "ELSE 'SELECT ' || CAST(length(question) AS VARCHAR) || ' AS n' END AS output, "
                       "CASE WHEN eval_id % 53 <> 0 AND eval_id % 101 = 0 THEN 'ValueError: cannot answer' END AS error FROM evals",
        "model_ai_query": f"{W} SELECT eval_id, 'SELECT ' || CAST(length('Answer briefly: ' || question) AS VARCHAR) || ' AS n' AS answer FROM evals",
        "followup_answers": f"{WC}, {REPLIES}, {_STATUS}, g AS (SELECT original_question AS question, min(eval_id) AS gold_eval_id FROM evals GROUP BY 1), "
                            "h AS (SELECT st.*, length('Question: ' || coalesce(st.question, '') || chr(10) || 'The service asks: ' "
                            "|| coalesce(CASE WHEN ok THEN json_extract_string(reply, '$.attachments[0].text') END, '') || chr(10) || 'Reference SQL: ' "
                            "|| coalesce(e.gold_sql, '')) AS helped FROM st LEFT JOIN g ON st.question = g.question "
                            "LEFT JOIN evals e ON e.eval_id = g.gold_eval_id) "
                            "SELECT reply_id, CASE WHEN status = 'followup' THEN 'answered' ELSE status END AS status, "
                            "CASE WHEN status = 'followup' THEN 'SELECT ' || CAST(length(question || chr(10) || 'answer ' || CAST(helped AS VARCHAR)) "
                            "AS VARCHAR) || ' AS n' WHEN status = 'ok' THEN json_extract_string(reply, '$.attachments[0].query.query') END AS candidate_sql "
                            "FROM h",
        "trace_assessments": "SELECT doc_id AS trace_id, scorer, value FROM labels UNPIVOT (value FOR scorer IN (quality, toxic)) "
                             "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality <> 0) "
                             "UNION ALL SELECT doc_id, NULL, NULL FROM labels WHERE quality = 0",
        "run_feedback": "SELECT user_id AS run_id, event_id AS item_id, event_type AS scorer, value >= 100 AS value FROM events "
                        "WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
        "evaluate_results": _result_scores(),
        "log_levels": f"SELECT event_type AS logger_name, {lvl} AS level, count(*) AS n FROM events "
                      "WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL",
        "stream_dedup": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn "
                        "FROM events) WHERE rn = 1",
        "stream_scorer_means": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, round(avg(value), {R}) AS mean, "
                               "count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= "
                               "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL",
    }
    return {k: v.replace("{R}", str(Q.R)) for k, v in sql.items()}


_STATUS = """st AS (SELECT *, CASE WHEN reply IS NULL THEN 'no_reply'
    WHEN NOT ok THEN 'parse_error'
    WHEN json_extract(reply, '$.attachments') IS NULL OR json_array_length(reply, '$.attachments') = 0 THEN 'no_attachment'
    WHEN json_array_length(reply, '$.attachments') > 1 THEN 'multiple_attachments'
    WHEN json_extract(reply, '$.attachments[0].query') IS NULL THEN 'followup'
    ELSE 'ok' END AS status FROM (SELECT *, json_valid(reply) AS ok FROM replies))"""


def _render_sql(template: str, question: str = "question", gold: str = "gold_sql", issues: str = "issues") -> str:
    """The template as a concatenation (placeholders -> coalesced columns)."""
    import re
    cols = {"question": question, "gold_sql": gold, "issues": issues}
    out = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            out.append(f"coalesce(CAST({cols[piece[1:-1]]} AS VARCHAR), '')")
        elif piece:
            out.append(kv(piece))
    return " || ".join(out)
