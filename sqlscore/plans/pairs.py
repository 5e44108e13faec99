"""Gold / candidate SQL pairs over the driver tables.

Each pair re-casts one query shape users score (filter + top-k, grouped
averages, IN lists, CTE chains, ranking windows, joins with duplicate
column names, ILIKE, semi-join sub-queries, date ranges, broken and
missing gold).  Every text reads whole tables, so its cost grows with the
data; the texts stay in the subset of SQL that Spark and DuckDB share, so
the DuckDB oracle can run the same pair.
"""

from __future__ import annotations

from sqlscore.operators.equivalence import Pair

# pair_id -> (gold, candidate).  None = missing text.
PAIRS: dict[str, tuple[str | None, str | None]] = {
    # filter + top-10
    "m1_top10": (
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
        "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        "SELECT o.o_orderkey AS k, o.o_totalprice AS price FROM orders o "
        "WHERE o.o_orderstatus IN ('F') ORDER BY 2 DESC, 1 LIMIT 10;",
    ),
    # month-start filter, average by key, top-1
    "m2_avg_top1": (
        "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 2) AS avg_price FROM orders "
        "WHERE o_orderdate >= DATE_TRUNC('month', TIMESTAMP '1997-03-17 10:00:00') "
        "GROUP BY o_orderpriority ORDER BY avg_price DESC, o_orderpriority LIMIT 1",
        "SELECT o_orderpriority, ROUND(SUM(o_totalprice) / COUNT(*), 2) FROM orders "
        "WHERE o_orderdate >= TIMESTAMP '1997-03-01 00:00:00' "
        "GROUP BY o_orderpriority ORDER BY 2 DESC, 1 LIMIT 1",
    ),
    # COUNT(*) with two IN lists and a time predicate
    "m3_count_in": (
        "SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') "
        "AND l_linestatus IN ('F') AND l_shipdate < TIMESTAMP '1998-06-17 00:00:00'",
        "SELECT SUM(1) AS cnt FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') "
        "AND l_linestatus = 'F' AND l_shipdate <= TIMESTAMP '1998-06-16 23:59:59'",
    ),
    # broken gold: stray bracket in a column name
    "m4_broken_gold": (
        "SELECT COUNT(*) FROM orders WHERE o_orderdate] BETWEEN CURRENT_TIMESTAMP "
        "AND CURRENT_TIMESTAMP + INTERVAL 24 HOURS",
        "SELECT COUNT(*) FROM orders",
    ),
    # group count, top-5 (the minimum slice)
    "m5_group_top5": (
        "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority "
        "ORDER BY n DESC, o_orderpriority LIMIT 5",
        "WITH per_prio AS (SELECT o_orderpriority AS prio, COUNT(o_orderkey) AS cnt FROM orders "
        "GROUP BY o_orderpriority) SELECT prio, cnt FROM per_prio ORDER BY cnt DESC, prio LIMIT 5",
    ),
    # CTE filter -> SUM by two keys; candidate forgets the filter (differs)
    "m6_cte_sum_wrong": (
        "WITH shipped AS (SELECT * FROM lineitem WHERE l_discount > 0.05) "
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty FROM shipped "
        "GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem "
        "GROUP BY l_returnflag, l_linestatus",
    ),
    # CTE chain, IS NOT NULL, AVG, top-1
    "m7_cte_chain": (
        "WITH c AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL), "
        "o AS (SELECT o_custkey, o_totalprice FROM orders) "
        "SELECT c_mktsegment, ROUND(AVG(o_totalprice), 2) AS avg_total FROM c JOIN o ON c.c_custkey = o.o_custkey "
        "GROUP BY c_mktsegment ORDER BY avg_total DESC, c_mktsegment LIMIT 1",
        "SELECT c.c_mktsegment, ROUND(AVG(o.o_totalprice), 2) FROM orders o JOIN customer c "
        "ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment ORDER BY 2 DESC, 1 LIMIT 1",
    ),
    # previous-month half-open range vs inclusive BETWEEN
    "m8_month_range": (
        "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01 00:00:00' "
        "AND o_orderdate < TIMESTAMP '1996-03-01 00:00:00'",
        "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-02-01 00:00:00' "
        "AND TIMESTAMP '1996-03-01 00:00:00'",
    ),
    # AVG by key, rows in another order
    "m9_avg_by_key": (
        "SELECT c_nationkey, ROUND(AVG(c_acctbal), 2) AS bal FROM customer GROUP BY c_nationkey "
        "ORDER BY c_nationkey",
        "SELECT c_nationkey AS nation, ROUND(AVG(c_acctbal), 2) AS avg_bal FROM customer "
        "GROUP BY c_nationkey ORDER BY avg_bal DESC",
    ),
    # ranking window <= 3 per group
    "m10_rank_top3": (
        "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, ROW_NUMBER() OVER "
        "(PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
        "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, RANK() OVER "
        "(PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r < 4",
    ),
    # join with duplicate names in the gold result
    "m11_join_dup_names": (
        "SELECT c.c_custkey, n.n_name, c.c_nationkey AS k, n.n_nationkey AS k FROM customer c "
        "JOIN nation n ON c.c_nationkey = n.n_nationkey",
        "SELECT c_custkey, n_name, c_nationkey, n_nationkey FROM nation, customer "
        "WHERE n_nationkey = c_nationkey",
    ),
    # ILIKE, scalar sub-query, IN sub-query (semi join)
    "m12_ilike_semi": (
        "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' "
        "AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) "
        "AND p_retailprice > (SELECT AVG(p_retailprice) FROM part)",
        "SELECT p.p_partkey, p.p_name FROM part p WHERE LOWER(p.p_name) LIKE '%red%' "
        "AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45) "
        "AND p.p_retailprice > (SELECT AVG(p_retailprice) FROM part)",
    ),
    # CTE join on id; candidate joins the wrong key (differs)
    "m13_cte_join_wrong": (
        "WITH s AS (SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE 'supplier%') "
        "SELECT s_name, COUNT(*) AS n FROM lineitem JOIN s ON l_suppkey = s_suppkey GROUP BY s_name",
        "WITH s AS (SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE 'supplier%') "
        "SELECT s_name, COUNT(*) AS n FROM lineitem JOIN s ON l_partkey = s_suppkey GROUP BY s_name",
    ),
    # LOWER(x) LIKE LOWER(...) OR ... vs plain LIKE OR
    "m14_like_or": (
        "SELECT p_partkey FROM part WHERE LOWER(p_name) LIKE LOWER('%Widget%') OR LOWER(p_type) LIKE LOWER('%small%')",
        "SELECT p_partkey FROM part WHERE p_name LIKE '%widget%' OR p_type LIKE '%SMALL%'",
    ),
    # equality + date predicate against CURRENT_DATE
    "m15_current_date": (
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < CURRENT_DATE",
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'",
    ),
    # no gold query
    "m16_no_gold": (None, "SELECT COUNT(*) FROM orders"),
    # not a query
    "m17_not_a_query": ("SELECT COUNT(*) FROM orders", "DROP TABLE orders"),
    # one duplicate row missing on the candidate side (bag vs set)
    "m18_dup_missing": (
        "SELECT o_orderpriority FROM orders",
        "SELECT o_orderpriority FROM orders WHERE NOT (o_orderkey = (SELECT MIN(o_orderkey) FROM orders))",
    ),
}


def pairs() -> list[Pair]:
    return [Pair(k, g, c) for k, (g, c) in PAIRS.items()]


# Pair whose rows differ in volume (used for the diff-rows query).
DIFF_GOLD = (
    "SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) "
    "AS DECIMAL(18,4)) AS revenue, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey"
)
DIFF_CAND = (
    "SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) "
    "AS DECIMAL(18,4)) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_linenumber > 1 OR l_returnflag <> 'R' "
    "GROUP BY l_orderkey"
)

# Pairs whose verdict is an error row (text never reaches execution).
EXPECTED_ERRORS = {
    "m4_broken_gold": "gold:not_a_query_or_unparsable",
    "m16_no_gold": "gold:no_gold",
    "m17_not_a_query": "candidate:not_a_query_or_unparsable",
}

# Ordered comparison: pair_id -> (gold, candidate, place of a gold row, place of a candidate row).  The places
# are DuckDB expressions over the result columns (c0, c1, ...), for the oracle only; Spark takes them from the plan.
ORDERED_PAIRS: dict[str, tuple[str, str, str, str]] = {
    # the same keys and directions in other words
    "o1_same_order": (
        "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey",
        "WITH c AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer) SELECT k, b FROM c ORDER BY 2 DESC NULLS LAST, k",
        "dense_rank() OVER (ORDER BY c1 DESC NULLS LAST, c0)", "dense_rank() OVER (ORDER BY c1 DESC NULLS LAST, c0)"),
    # only the direction differs
    "o2_direction": (
        "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey",
        "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC",
        "dense_rank() OVER (ORDER BY c0)", "dense_rank() OVER (ORDER BY c0 DESC)"),
    # only the values of the key differ
    "o3_key_values": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey",
        "SELECT o_orderkey + 1000000 AS o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey",
        "dense_rank() OVER (ORDER BY c0)", "dense_rank() OVER (ORDER BY c0)"),
    # only the order among ties differs (settled by a further key)
    "o4_ties": (
        "SELECT c_nationkey, c_name FROM customer ORDER BY c_nationkey",
        "SELECT c_nationkey, c_name FROM customer ORDER BY c_nationkey, c_name DESC",
        "dense_rank() OVER (ORDER BY c0)", "dense_rank() OVER (ORDER BY c0)"),
    # the candidate leaves open what the gold settles
    "o5_left_open": (
        "SELECT c_nationkey, c_name FROM customer ORDER BY c_nationkey, c_name",
        "SELECT c_nationkey, c_name FROM customer ORDER BY c_nationkey",
        "dense_rank() OVER (ORDER BY c0, c1)", "dense_rank() OVER (ORDER BY c0)"),
    # the candidate asks for no order
    "o6_unordered": (
        "SELECT n_nationkey, n_name FROM nation ORDER BY n_name",
        "SELECT n_nationkey, n_name FROM nation",
        "dense_rank() OVER (ORDER BY c1)", "1"),
    # the gold asks for none, so any order will do
    "o7_any_order": (
        "SELECT n_nationkey, n_name FROM nation",
        "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC",
        "1", "1"),
    # the gold is ordered by a column it does not return: its rows stand at fixed positions
    "o8_hidden_key": (
        "SELECT s_name FROM supplier ORDER BY s_suppkey",
        "SELECT s_name FROM supplier ORDER BY s_name",
        "dense_rank() OVER (ORDER BY c0)", "dense_rank() OVER (ORDER BY c0)"),
    # one row needs no order
    "o9_single_row": (
        "SELECT MAX(o_totalprice) AS m FROM orders ORDER BY m",
        "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1",
        "1", "1"),
}


def ordered_pairs() -> list[Pair]:
    return [Pair(k, v[0], v[1]) for k, v in ORDERED_PAIRS.items()]


# A result and its copy with one altered row (for the bucketed diff).
ALTERED_GOLD = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem"
ALTERED_CAND = (
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey = (SELECT MAX(l_orderkey) FROM lineitem) "
    "AND l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem"
)

# Four texts for each nation (``{nation}``); the third reads the supplier table instead and the fourth is no query.
NATION_GOLD = "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_nationkey = {nation} GROUP BY c_mktsegment"
NATION_CANDS = (
    "SELECT c_mktsegment AS s, SUM(1) AS n FROM customer WHERE c_nationkey = {nation} GROUP BY 1",
    "SELECT c_mktsegment, COUNT(*) FROM customer WHERE c_nationkey = {nation} AND c_acctbal > 0 GROUP BY c_mktsegment",
    "SELECT s_name, COUNT(*) FROM supplier WHERE s_nationkey = {nation} GROUP BY s_name",
    "SELECT c_mktsegment, COUNT(*) FROM customer WHERE c_nationkey = {nation}",
)
