"""The engine's queries over the star tables, each with SQL for an independent check.

SAME holds texts that both sides run, with {table} for a table. OWN holds pairs: ours and
the check's. FRAMES holds queries by DataFrame operators, with the check's text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.aggregates import aggregate, exact_sum, register, register_fold, text_sum
from .functions.scalar import call
from .operators import changes, joins, relational
from .plans import joins as planned
from .plans import predicates as p
from .plans import text
from .plans.access import IndexedTable
from .session import Catalog, linq
from .sources.storage import shared_dir
from .sources.tables import from_files, save

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SAME: dict[str, str] = {
    "scan_project": "SELECT n_nationkey, n_name, n_regionkey FROM {nation}",
    "const_select": "SELECT 1 AS one, 'x' AS letter, 1 + 2 AS three",
    "filter_and_in": "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 3)",
    "filter_or_not": "SELECT c_custkey FROM {customer} WHERE NOT (c_nationkey = 1 OR c_acctbal > 2000)",
    "filter_not_in": "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (1, 2, 3, 5, 8, 13, 21)",
    "filter_between": "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000",
    "filter_not_between": "SELECT o_orderkey FROM {orders} WHERE o_totalprice NOT BETWEEN 1000 AND 50000",
    "filter_is_null": "SELECT o_orderkey FROM {orders} WHERE NULLIF(o_orderstatus, 'P') IS NULL",
    "filter_is_not_null": "SELECT o_orderkey FROM {orders} WHERE NULLIF(o_orderstatus, 'P') IS NOT NULL",
    "filter_null_compare": "SELECT o_orderkey FROM {orders} WHERE NULLIF(o_orderstatus, 'P') <> 'F'",
    "filter_like": "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE 'ECO%'",
    "filter_cmp_ops": "SELECT p_partkey FROM {part} WHERE p_size < 40 AND p_size <= 39 AND p_size > 3 AND p_size >= 5 AND p_size <> 7",
    "expr_arith": "SELECT o_orderkey, o_orderkey + 1 AS plus, o_orderkey - 7 AS minus, o_custkey * 3 AS times, o_totalprice / 4 AS quarter, o_orderkey % 7 AS rest, -o_custkey AS opposite FROM {orders}",
    "expr_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM {orders}",
    "expr_case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 10000 THEN 'middle' ELSE 'small' END AS class FROM {orders}",
    "expr_null_logic": "SELECT c_custkey, (NULLIF(c_nationkey, 3) = 4) AND c_acctbal > 0 AS conj, (NULLIF(c_nationkey, 3) = 4) OR c_acctbal > 0 AS disj, NOT (NULLIF(c_nationkey, 3) = 4) AS neg FROM {customer}",
    "fn_variadic": "SELECT o_orderkey, GREATEST(o_orderkey, o_custkey, 500) AS most, LEAST(o_orderkey, o_custkey) AS least_key, COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS state FROM {orders}",
    "group_sum": "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 1) AS sum_price FROM {lineitem} GROUP BY l_returnflag",
    "group_count": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 1)) AS n_later FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "group_min": "SELECT l_returnflag, MIN(l_extendedprice) AS least_price, MIN(l_linestatus) AS least_status FROM {lineitem} GROUP BY l_returnflag",
    "group_max": "SELECT l_returnflag, MAX(l_extendedprice) AS most_price, MAX(l_linestatus) AS most_status FROM {lineitem} GROUP BY l_returnflag",
    "group_avg": "SELECT l_returnflag, ROUND(AVG(l_quantity), 4) AS mean_qty FROM {lineitem} GROUP BY l_returnflag",
    "group_by_expr": "SELECT o_custkey % 10 AS digit, COUNT(*) AS n, MAX(o_orderkey) AS last FROM {orders} GROUP BY o_custkey % 10",
    "global_agg": "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 1) AS total, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM {orders}",
    "global_agg_empty": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total FROM {orders} WHERE o_orderkey < 0",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "sort_multi": "SELECT c_nationkey, c_custkey FROM {customer} ORDER BY c_nationkey ASC NULLS FIRST, c_custkey DESC NULLS LAST",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 495",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "join_left_residual": "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45",
    "join_multi_key": "SELECT c.c_custkey, s.s_suppkey FROM {customer} c JOIN {supplier} s ON c.c_nationkey = s.s_nationkey AND c.c_custkey % 100 = s.s_suppkey",
    "join_computed_key": "SELECT c.c_custkey, s.s_suppkey FROM {customer} c JOIN {supplier} s ON CEIL(c.c_custkey / 10 + 5) = FLOOR(s.s_suppkey * 10 - 3)",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_theta_left": "SELECT a.n_nationkey, r.r_regionkey FROM {nation} a LEFT JOIN {region} r ON a.n_nationkey < r.r_regionkey",
    "join_cross": "SELECT n_nationkey, r_regionkey FROM {nation} CROSS JOIN {region}",
    "join_comma_where": "SELECT o.o_orderkey, c.c_custkey FROM {orders} o, {customer} c WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = 3",
    "join_natural": "SELECT doc_id, n_chars, quality, toxic FROM {documents} NATURAL JOIN {labels}",
    "join_right": "SELECT l.doc_id AS labelled, d.doc_id FROM {labels} l RIGHT JOIN {documents} d ON l.doc_id = d.doc_id",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey * 30",
    "join_three_way": "SELECT r.r_name, n.n_name, COUNT(*) AS n_orders FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY r.r_name, n.n_name",
    "join_lateral": "SELECT n.n_nationkey, x.n_rich FROM {nation} n, LATERAL (SELECT COUNT(*) AS n_rich FROM {customer} c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000) x",
    "join_lateral_left": "SELECT n.n_nationkey, x.best FROM {nation} n LEFT JOIN LATERAL (SELECT MAX(c.c_acctbal) AS best FROM {customer} c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900) x ON TRUE",
    "join_semi_exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = c.c_custkey)",
    "join_semi_in": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT user_id FROM {events})",
    "join_anti_not_exists": "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "join_anti_not_in": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT user_id FROM {events})",
    "join_anti_not_in_null": "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT NULLIF(user_id, 3) FROM {events})",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}",
    "except": "SELECT n_nationkey + 5 AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier}",
    "derived_table": "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey) t WHERE t.n > 50",
    "where_on_alias": "SELECT k FROM (SELECT o_custkey + 1 AS k FROM {orders}) t WHERE k = 10",
    "wildcard": "SELECT r.*, n.n_name FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey",
    "subq_scalar": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM {orders})",
    "subq_scalar_corr": "SELECT c_custkey, (SELECT COUNT(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS n_done FROM {customer} c",
    "subq_exists_col": "SELECT c_custkey, EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = c.c_custkey) AS active FROM {customer} c",
    "subq_in_col": "SELECT c_custkey, c_custkey IN (SELECT user_id FROM {events}) AS active FROM {customer}",
    "subq_nested": "SELECT n_name FROM {nation} WHERE n_nationkey IN (SELECT c_nationkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > (SELECT MAX(o_totalprice) * 0.99 FROM {orders})))",
    "subq_any": "SELECT p_partkey FROM {part} WHERE p_size > ANY (SELECT n_nationkey + 10 FROM {nation} WHERE n_regionkey = 1)",
    "subq_all": "SELECT p_partkey FROM {part} WHERE p_size > ALL (SELECT n_nationkey FROM {nation})",
    "subq_all_null": "SELECT p_partkey FROM {part} WHERE p_size >= ALL (SELECT NULLIF(n_nationkey, 3) FROM {nation})",
    "subq_all_empty": "SELECT p_partkey FROM {part} WHERE p_size < ALL (SELECT n_nationkey FROM {nation} WHERE n_nationkey > 99)",
    "subq_all_computed": "SELECT p_partkey FROM {part} WHERE p_size + 1 > ALL (SELECT n_nationkey FROM {nation}) AND 2 * p_size <> ANY (SELECT n_regionkey FROM {nation})",
    "subq_any_null": "SELECT p_partkey, p_size < ANY (SELECT NULLIF(n_nationkey, 24) FROM {nation}) AS below FROM {part}",
    "str_position": "SELECT p_partkey, CAST(POSITION('a' IN p_name) AS BIGINT) AS at FROM {part}",
    "date_extract": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM {orders}",
    "flagship": "SELECT c.c_custkey AS user_id, ROUND(SUM(o.o_totalprice), 2) AS score FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey ORDER BY score DESC, user_id",
    "flagship_full": "SELECT n.n_name, l.l_returnflag, COUNT(*) AS n_lines, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 20000 GROUP BY n.n_name, l.l_returnflag HAVING COUNT(*) > 5 ORDER BY n_lines DESC NULLS LAST, n.n_name, l.l_returnflag LIMIT 40",
}

OWN: dict[str, tuple[str, str]] = {
    "expr_bitwise": (
        "SELECT p_partkey, ~p_size AS inverse, p_size << 3 AS up, p_size >> 1 AS down, p_size ^ 5 AS apart FROM {part}",
        "SELECT p_partkey, ~p_size AS inverse, CAST(p_size << 3 AS INTEGER) AS up, p_size >> 1 AS down, xor(p_size, 5) AS apart FROM part",
    ),
    "fn_trig": (
        "SELECT c_custkey, ROUND(SIN(c_acctbal), 6) AS s, ROUND(COS(c_acctbal), 6) AS c, ROUND(TAN(c_custkey / 7), 4) AS t, ROUND(ASIN(c_nationkey / 25), 8) AS a_s, ROUND(ACOS(c_nationkey / 25), 8) AS a_c, ROUND(ATAN(c_acctbal), 8) AS a_t, ROUND(ATAN2(c_custkey, c_nationkey + 1), 8) AS a_2, ROUND(COT(c_nationkey + 1), 6) AS ct FROM {customer}",
        "SELECT c_custkey, ROUND(SIN(c_acctbal), 6) AS s, ROUND(COS(c_acctbal), 6) AS c, ROUND(TAN(c_custkey / 7), 4) AS t, ROUND(ASIN(c_nationkey / 25), 8) AS a_s, ROUND(ACOS(c_nationkey / 25), 8) AS a_c, ROUND(ATAN(c_acctbal), 8) AS a_t, ROUND(ATAN2(c_custkey, c_nationkey + 1), 8) AS a_2, ROUND(COT(c_nationkey + 1), 6) AS ct FROM customer",
    ),
    "fn_round": (
        "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(SIGN(c_acctbal) AS INT) AS s, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, CEILING(c_acctbal) AS c2, ROUND(SQRT(ABS(c_acctbal)), 6) AS r, MOD(c_custkey, 7) AS m FROM {customer}",
        "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(SIGN(c_acctbal) AS INTEGER) AS s, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, CAST(CEIL(c_acctbal) AS BIGINT) AS c, CAST(CEIL(c_acctbal) AS BIGINT) AS c2, ROUND(SQRT(ABS(c_acctbal)), 6) AS r, MOD(c_custkey, 7) AS m FROM customer",
    ),
    "fn_exp_log": (
        "SELECT p_partkey, ROUND(EXP(p_size / 10), 6) AS e, ROUND(POWER(p_size, 2), 4) AS p, ROUND(LN(p_size), 8) AS l, ROUND(LOG10(p_size), 8) AS l10, ROUND(LOG(2, p_size), 8) AS l2 FROM {part}",
        "SELECT p_partkey, ROUND(EXP(p_size / 10), 6) AS e, ROUND(POWER(p_size, 2), 4) AS p, ROUND(LN(p_size), 8) AS l, ROUND(LOG10(p_size), 8) AS l10, ROUND(LN(p_size) / LN(2), 8) AS l2 FROM part",
    ),
    "group_distinct": (
        "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, SUM(DISTINCT o_custkey) AS s, ROUND(AVG(DISTINCT o_custkey), 4) AS a FROM {orders} GROUP BY o_orderstatus",
        "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s, ROUND(AVG(DISTINCT o_custkey), 4) AS a FROM orders GROUP BY o_orderstatus",
    ),
    "group_sum_int": (
        "SELECT l_returnflag, SUM(l_linenumber) AS s FROM {lineitem} GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "str_substr": (
        "SELECT p_partkey, SUBSTR(p_name FROM 3) AS tail, SUBSTR(p_type FROM 2 FOR 4) AS middle FROM {part}",
        "SELECT p_partkey, SUBSTR(p_name, 3) AS tail, SUBSTR(p_type, 2, 4) AS middle FROM part",
    ),
    "str_trim": (
        "SELECT p_partkey, TRIM(BOTH 'E' FROM p_type) AS b, TRIM(LEADING 'E' FROM p_type) AS l, TRIM(TRAILING 'D' FROM p_type) AS t, TRIM('P' FROM p_type) AS p FROM {part}",
        "SELECT p_partkey, trim(p_type, 'E') AS b, ltrim(p_type, 'E') AS l, rtrim(p_type, 'D') AS t, trim(p_type, 'P') AS p FROM part",
    ),
    "str_regexp": (
        "SELECT p_partkey, p_type REGEXP '^(ECO|PRO)' AS yes, p_type NOT REGEXP 'O$' AS no, p_brand RLIKE '[13]$' AS odd FROM {part}",
        "SELECT p_partkey, regexp_matches(p_type, '^(ECO|PRO)') AS yes, NOT regexp_matches(p_type, 'O$') AS no, regexp_matches(p_brand, '[13]$') AS odd FROM part",
    ),
    "int_div_mod": (
        "SELECT o_orderkey, (o_orderkey - 500) DIV 7 AS whole, (o_orderkey - 500) MOD 7 AS rest FROM {orders}",
        "SELECT o_orderkey, (o_orderkey - 500) // 7 AS whole, (o_orderkey - 500) % 7 AS rest FROM orders",
    ),
    "date_add_sub": (
        "SELECT o_orderkey, ADDDATE(o_orderdate, INTERVAL 1 MONTH) AS later, DATE_SUB(o_orderdate, INTERVAL 3 DAY) AS earlier, DATE_ADD(o_orderdate, INTERVAL 2 HOUR) AS soon, SUBDATE(o_orderdate, INTERVAL 1 YEAR) AS before FROM {orders}",
        "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS later, o_orderdate - INTERVAL 3 DAY AS earlier, o_orderdate + INTERVAL 2 HOUR AS soon, o_orderdate - INTERVAL 1 YEAR AS before FROM orders",
    ),
    "cast_types": (
        "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS t, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_custkey AS DOUBLE) AS d, HEX(BINARY o_orderstatus) AS raw FROM {orders}",
        "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS DOUBLE) AS d, hex(encode(o_orderstatus)) AS raw FROM orders",
    ),
    "null_safe_is": (
        "SELECT c_custkey FROM {customer} WHERE NULLIF(c_nationkey, 3) IS NULLIF(c_nationkey, 4)",
        "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) IS NOT DISTINCT FROM NULLIF(c_nationkey, 4)",
    ),
    "divide_by_zero": (
        "SELECT o_orderkey, try_divide(o_totalprice, o_orderkey % 3) AS part, try_mod(o_orderkey, o_custkey % 2) AS rest FROM {orders}",
        "SELECT o_orderkey, o_totalprice / NULLIF(o_orderkey % 3, 0) AS part, o_orderkey % NULLIF(o_custkey % 2, 0) AS rest FROM orders",
    ),
}

C = p.Col


def _frames() -> dict[str, tuple[Callable[..., DataFrame], str | None]]:
    """name: (function of a table getter, the check's SQL)."""

    def strategy(kind: str, how: str):
        def run(t):
            line, order = t("lineitem"), t("orders")
            return joins.join(order, line, (order.o_orderkey == line.l_orderkey) & (line.l_quantity > 40), how, kind).select("o_orderkey", "l_linenumber", "l_quantity")

        return run

    def side(how: str) -> str:
        return f"SELECT o_orderkey, l_linenumber, l_quantity FROM orders {how} JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40"

    def or_arms(t, mixed: bool, how: str):
        c, s = t("customer").alias("c"), t("supplier").alias("s")
        nation, own = F.nullif(F.col("c.c_nationkey"), F.lit(3)), F.col("s.s_nationkey")
        arms = [[nation == own, F.col("c.c_custkey") % 20 == F.col("s.s_suppkey") % 20], [F.col("c.c_custkey") == F.col("s.s_suppkey")]] if mixed else [[nation == own], [F.col("c.c_custkey") == F.col("s.s_suppkey")]]
        rest = F.col("c.c_acctbal") > F.col("s.s_acctbal")
        return joins.or_join(c, s, arms, rest, how, salts=[16, 1]).select("c_custkey", "s_suppkey")  # nations are few

    def or_sql(mixed: bool, how: str) -> str:
        first = "NULLIF(c_nationkey, 3) = s_nationkey" + " AND c_custkey % 20 = s_suppkey % 20" * mixed
        return f"SELECT c_custkey, s_suppkey FROM customer {how} JOIN supplier ON (({first}) OR c_custkey = s_suppkey) AND c_acctbal > s_acctbal"

    def filtered(name: str, tree, columns: list[str]):
        return lambda t: (lambda df: df.filter(p.column(p.optimized(tree, df.schema))).select(*columns))(t(name))

    def first_order(t):
        return relational.group_with_first(t("orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), aggregate("count").alias("n")).select("o_custkey", F.col("o_orderkey").alias("first_key"), F.col("o_totalprice").alias("first_price"), "n")

    def registered(t):
        register("middle", lambda v: F.exp(F.avg(F.ln(v))))
        register_fold("mark", lambda: 0, lambda state, v: state ^ int(v), int, "long")
        marks = relational.group(t("orders"), ["o_orderstatus"], aggregate("mark", "o_custkey").alias("mark"))
        return relational.group(t("orders"), ["o_orderstatus"], F.round(aggregate("middle", "o_totalprice"), 4).alias("middle")).join(marks, "o_orderstatus")

    def materialized(t):
        orders = t("orders")
        catalog = Catalog(orders.sparkSession)
        # The totals are compared: added exactly here, so that the text's SUM has one value a customer.
        catalog.add("veldt_orders", relational.group(orders, ["o_custkey"], exact_sum(F.col("o_totalprice")).alias("o_totalprice")))
        rich = catalog.materialize("veldt_rich", "SELECT o_custkey, SUM(o_totalprice) AS total FROM veldt_orders GROUP BY o_custkey")
        return linq("SELECT a.o_custkey, COUNT(*) AS n_above FROM {rich} a JOIN {rich} b ON a.o_custkey % 50 = b.o_custkey % 50 AND a.total < b.total GROUP BY a.o_custkey", rich=rich)

    def by_index(t):
        orders = t("orders")
        table = IndexedTable(orders)
        for columns in (["o_custkey", "o_orderkey"], ["o_orderkey"]):
            table.add_index("_".join(columns), columns, f"{shared_dir(orders.sparkSession)}/veldt-index-{uuid.uuid4().hex[:12]}", files=8)
        return table.where(text.condition("(o_custkey = 7 AND o_orderkey > 100) OR o_orderkey BETWEEN 20 AND 40 OR o_custkey * 2 = 26")).select("o_orderkey", "o_custkey")

    def spans(tree):
        arms = [p.both(*(p.Compare(sign, own, p.Lit(v)) for own, r in arm.items() for sign, v in ((">=" if r.low_in else ">", r.low), ("<=" if r.high_in else "<", r.high)) if v is not None)) for arm in p.ranges(tree)]
        return p.column(p.either(*arms))

    def written(t):
        nation = t("nation")
        path = f"{shared_dir(nation.sparkSession)}/veldt-files-{uuid.uuid4().hex[:12]}"
        save(nation, path, "orc", partition_by=["n_regionkey"])
        return from_files(nation.sparkSession, path, "orc").select("n_regionkey", "n_nationkey", "n_name")

    key = C("o_orderkey")
    return {
        "project_ordinal_names": (lambda t: relational.project(t("nation"), F.col("n_nationkey"), (F.col("n_name"), "name"), F.col("n_regionkey") + 1), 'SELECT n_nationkey AS "0", n_name AS name, n_regionkey + 1 AS "2" FROM nation'),
        "fn_rand": (lambda t: t("nation").select("n_nationkey", call("rand").between(0, 1).alias("inside")), "SELECT n_nationkey, random() BETWEEN 0 AND 1 AS inside FROM nation"),
        "project_nested": (
            lambda t: t("nation").alias("n").join(t("region").alias("r"), F.col("n.n_regionkey") == F.col("r.r_regionkey")).select(*relational.nested(("n", t("nation")), ("r", t("region")))).select("n.n_nationkey", "r.r_name"),
            "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        ),
        "group_registered": (registered, "SELECT o_orderstatus, ROUND(EXP(AVG(LN(o_totalprice))), 4) AS middle, BIT_XOR(o_custkey) AS mark FROM orders GROUP BY o_orderstatus"),
        "subq_materialized": (materialized, "WITH rich AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT a.o_custkey, COUNT(*) AS n_above FROM rich a JOIN rich b ON a.o_custkey % 50 = b.o_custkey % 50 AND a.total < b.total GROUP BY a.o_custkey"),
        "access_by_index": (
            by_index,
            "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey = 7 AND o_orderkey > 100) OR o_orderkey BETWEEN 20 AND 40 OR o_custkey * 2 = 26",
        ),
        "ranges_as_filter": (
            lambda t: t("orders").filter(spans(text.condition("o_orderkey > 14900 OR (o_orderkey = 3 AND o_custkey >= 2) OR 10 - o_orderkey > 7"))).select("o_orderkey"),
            "SELECT o_orderkey FROM orders WHERE o_orderkey > 14900 OR (o_orderkey = 3 AND o_custkey >= 2) OR 10 - o_orderkey > 7",
        ),
        "plan_where_on": (
            lambda t: planned.plan(
                ["c", "o", "l"],
                text.condition("c.c_nationkey IN (1, 3) AND o.o_orderkey > 52 AND l.l_quantity * 2 > 30"),
                (text.condition("l.l_orderkey = o.o_orderkey"), text.condition("o.o_custkey = c.c_custkey")),
            ).frame({"c": t("customer"), "o": t("orders"), "l": t("lineitem")}).select("c_custkey", "o_orderkey", "l_linenumber"),
            "SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey IN (1, 3) AND o_orderkey > 52 AND l_quantity * 2 > 30",
        ),
        "graph_as_filter": (
            lambda t: t("orders").filter(p.column(p.graph(text.condition("o_orderkey = o_custkey AND o_custkey > 3 AND o_orderstatus <> 'P' AND NOT o_totalprice < 100")).tree())).select("o_orderkey"),
            "SELECT o_orderkey FROM orders WHERE o_orderkey = o_custkey AND o_custkey > 3 AND o_orderstatus <> 'P' AND NOT o_totalprice < 100",
        ),
        "join_not_in_frame": (lambda t: joins.not_in(t("customer"), t("events"), "c_custkey", "user_id").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
        "join_not_in_null_frame": (lambda t: joins.not_in(t("customer"), t("events").select(F.nullif("user_id", F.lit(3)).alias("user_id")), "c_custkey", "user_id").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(user_id, 3) FROM events)"),
        "files_written": (
            written,
            "SELECT n_regionkey, n_nationkey, n_name FROM nation",
        ),
        "fn_by_name": (lambda t: t("part").select("p_partkey", F.round(call("LOG", F.col("p_size"), F.lit(2)), 8).alias("l2"), call("greatest", F.col("p_size"), F.lit(9)).alias("g")), "SELECT p_partkey, ROUND(LN(p_size) / LN(2), 8) AS l2, GREATEST(p_size, 9) AS g FROM part"),
        "group_sum_text": (
            lambda t: relational.group(t("part").withColumn("mixed", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))), ["p_type"], text_sum(F.col("mixed")).alias("s")),
            "SELECT p_type, SUM(TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS DOUBLE)) AS s FROM part GROUP BY p_type",
        ),
        "group_first_row": (first_order, "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price, COUNT(*) AS n FROM orders GROUP BY o_custkey"),
        "group_having_frame": (lambda t: relational.group(t("orders"), ["o_orderstatus"], aggregate("count").alias("n"), aggregate("count", "o_custkey", distinct=True).alias("customers"), having=F.col("n") > 10), "SELECT o_orderstatus, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus HAVING COUNT(*) > 10"),
        "join_inner_hash": (strategy("hash", "inner"), side("")),
        "join_left_hash": (strategy("hash", "left"), side("LEFT")),
        "join_merge_inner": (strategy("merge", "inner"), side("")),
        "join_merge_left": (strategy("merge", "left"), side("LEFT")),
        "join_merge_right": (strategy("merge", "right"), side("RIGHT")),
        "join_merge_full": (strategy("merge", "full"), side("FULL")),
        "join_or_keys": (lambda t: or_arms(t, False, "inner"), or_sql(False, "")),
        "join_or_left": (lambda t: or_arms(t, False, "left"), or_sql(False, "LEFT")),
        "join_or_and_mixed": (lambda t: or_arms(t, True, "inner"), or_sql(True, "")),
        "join_or_and_left": (lambda t: or_arms(t, True, "left"), or_sql(True, "LEFT")),
        "join_natural_frame": (lambda t: joins.natural(t("documents"), t("labels"), "left").select("doc_id", "quality"), "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
        "join_null_safe": (
            lambda t: (lambda a, b: a.join(b, joins.null_safe(a.ka, b.kb)).select("a_key", "b_key"))(
                t("nation").select(F.col("n_nationkey").alias("a_key"), F.nullif(F.col("n_regionkey"), F.lit(2)).alias("ka")), t("nation").select(F.col("n_nationkey").alias("b_key"), F.nullif(F.col("n_regionkey"), F.lit(2)).alias("kb"))
            ),
            "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 2) IS NOT DISTINCT FROM NULLIF(b.n_regionkey, 2)",
        ),
        "join_salted": (lambda t: joins.spread_join(t("events").withColumnRenamed("user_id", "c_custkey"), t("customer"), ["c_custkey"]).select("event_id", "c_name"), "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey"),
        "limit_frame": (lambda t: relational.limit(relational.sort(t("orders"), F.desc("o_totalprice"), "o_orderkey"), 10, 5).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5"),
        "intersect_all": (lambda t: relational.intersect(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), all=True), "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier"),
        "except_all": (lambda t: relational.subtract(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), all=True), "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier"),
        "dml_insert": (lambda t: changes.insert(t("region"), t("nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation"),
        "dml_delete": (lambda t: changes.delete(t("nation"), F.nullif(F.col("n_regionkey"), F.lit(1)) > 2), "SELECT * FROM nation WHERE NOT coalesce(NULLIF(n_regionkey, 1) > 2, FALSE)"),
        "dml_update": (lambda t: changes.update(t("nation"), {"n_name": F.upper(F.concat("n_name", F.lit("x")))}, F.col("n_regionkey") == 1), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name || 'x') ELSE n_name END AS n_name, n_regionkey FROM nation"),
        "sarg_isolate": (
            filtered("orders", p.either(p.Compare("=", p.Op("*", key, p.Lit(5)), p.Lit(25)), p.Compare("<", p.Lit(1490), C("o_custkey")), p.Compare(">", p.Op("-", p.Lit(20), p.Op("*", p.Lit(2), key)), p.Lit(14))), ["o_orderkey", "o_custkey"]),
            "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey * 5 = 25 OR 1490 < o_custkey OR 20 - 2 * o_orderkey > 14",
        ),
        "pred_not_pushdown": (
            filtered("orders", p.Not(p.either(p.Between(key, p.Lit(10), p.Lit(14000)), p.In(C("o_orderstatus"), (p.Lit("F"), p.Lit("O"))))), ["o_orderkey"]),
            "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey BETWEEN 10 AND 14000 OR o_orderstatus IN ('F', 'O'))",
        ),
        "pred_or_ranges": (
            filtered("orders", p.either(p.Compare(">", key, p.Lit(14900)), p.both(p.Compare("=", key, p.Lit(3)), p.Compare(">=", C("o_custkey"), p.Lit(2)))), ["o_orderkey"]),
            "SELECT o_orderkey FROM orders WHERE o_orderkey > 14900 OR (o_orderkey = 3 AND o_custkey >= 2)",
        ),
        "pred_contradiction": (filtered("orders", p.both(p.Compare("=", key, p.Lit(1)), p.Compare("=", key, p.Lit(2))), ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2"),
        "pred_transitive": (
            lambda t: (lambda o, l, tree: o.filter(p.column(p.for_table(tree, "o"))).join(l.filter(p.column(p.for_table(tree, "l"))), F.col("o.o_orderkey") == F.col("l.l_orderkey")).select("o_orderkey", "l_linenumber"))(
                t("orders").alias("o"), t("lineitem").alias("l"), p.both(p.Compare("=", C("o_orderkey", "o"), C("l_orderkey", "l")), p.Compare(">", C("o_orderkey", "o"), p.Lit(52)), p.Compare("<", C("l_quantity", "l"), p.Lit(9)))
            ),
            "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey > 52 AND l_quantity < 9",
        ),
        "linq_rows": (lambda t: linq("SELECT l.name, COUNT(*) AS n FROM {pairs} l JOIN {orders} o ON o.o_orderstatus = l.code GROUP BY l.name", orders=t("orders"), pairs=[{"code": "F", "name": "done"}, {"code": "O", "name": "open"}]), "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS name, COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL"),
        "linq_params": (lambda t: linq("SELECT o_orderkey FROM {orders} WHERE o_custkey = :who AND o_orderstatus <> :not_state", {"who": 7, "not_state": "it's"}, orders=t("orders")), "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    }


def _by_text(text: str):
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return lambda spark, sf_dir: linq(text, spark=spark, **{n: table(spark, sf_dir, n) for n in names})


def _by_frame(make):
    return lambda spark, sf_dir: make(lambda name: table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _by_text(sql) for name, sql in SAME.items()}
    out |= {name: _by_text(ours) for name, (ours, _) in OWN.items()}
    return out | {name: _by_frame(make) for name, (make, _) in _frames().items()}


def oracle_sql() -> dict[str, str]:
    out = {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in SAME.items()}
    out |= {name: theirs for name, (_, theirs) in OWN.items()}
    return out | {name: sql for name, (_, sql) in _frames().items() if sql}
