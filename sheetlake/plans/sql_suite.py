"""Registered queries: the SQL surface, one statement per operator family.

Statements aggregate before they join, rank or order, so that a key holding a
third of all rows is combined in each task before it is shuffled, and windows
run over months, days, brands or types and not over raw rows of one key.
Dates compare against DATE literals, which reach the parquet scan as filters.
Money is summed as DECIMAL, so results do not depend on the order of addition.
"""

from __future__ import annotations

from ..operators.query import run_sql
from ..sources.tables import register_views
from .registry import registry

QUERIES, ORACLES, register = registry()

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings")


def statement(name: str, text: str, oracle: str | None = None, args: dict | None = None) -> None:
    """Register one SQL text; ``oracle`` is given where DuckDB spells it differently."""
    tables = [t for t in ALL_TABLES if t in text]

    def run(spark, folder):
        register_views(spark, folder, tables)
        return run_sql(spark, text, args=args)

    register(name, oracle or text)(run)


_MONEY = "CAST({} AS DECIMAL(15,2))"
PRICE = _MONEY.format("l_extendedprice")
TOTAL = _MONEY.format("o_totalprice")
REVENUE = "CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2))"


def total(expression: str, scale: int = 2) -> str:
    return f"CAST(sum({expression}) AS DECIMAL(38,{scale}))"


# ---- projection and filters -----------------------------------------------------

statement("sql_project", """
SELECT l_orderkey AS order_key, l_linenumber, l_quantity * 2 AS double_quantity,
       upper(l_returnflag) || l_linestatus AS flags, l_discount > 0.05 AS discounted,
       l_extendedprice * (1 - l_discount) AS net
FROM lineitem""")

statement("sql_filter", """
SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus NOT IN ('P')
  AND o_orderpriority LIKE '%-%' AND o_orderpriority NOT ILIKE '%low'
  AND o_totalprice BETWEEN 50000 AND 200000 AND o_orderdate >= DATE '1996-01-01'
  AND o_orderdate < DATE '1999-01-01' AND o_custkey IS NOT NULL""")

statement("sql_null_logic", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS price_class,
       nullif(o_orderpriority, '5-LOW') IS NULL AS is_low
FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'
  AND nullif(o_orderpriority, '1-URGENT') IS NOT DISTINCT FROM o_orderpriority""")

# ---- joins ----------------------------------------------------------------------

statement("sql_join_inner", f"""
WITH spend AS (SELECT o_custkey, count(*) AS order_count, {total(TOTAL)} AS spent FROM orders GROUP BY o_custkey),
     buyers AS (SELECT c_custkey AS o_custkey, c_nationkey AS nationkey FROM customer),
     nations AS (SELECT n_nationkey AS nationkey, n_name, n_regionkey AS regionkey FROM nation),
     regions AS (SELECT r_regionkey AS regionkey, r_name FROM region)
SELECT r_name, n_name, CAST(sum(order_count) AS BIGINT) AS order_count, {total('spent')} AS spent
FROM spend JOIN buyers USING (o_custkey) JOIN nations USING (nationkey) NATURAL JOIN regions
GROUP BY r_name, n_name""")

_OPEN = "SELECT o_custkey, count(*) AS open_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey"
statement("sql_join_left", f"""
SELECT c_custkey, c_name, coalesce(open_orders, 0) AS open_orders, open_orders IS NULL AS none_open
FROM customer LEFT JOIN ({_OPEN}) p ON o_custkey = c_custkey""")

statement("sql_join_right", f"""
SELECT c_custkey, c_mktsegment, open_orders
FROM ({_OPEN}) p RIGHT OUTER JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")

statement("sql_join_full", """
SELECT coalesce(ordered, shipped) AS day, order_count, line_count
FROM (SELECT CAST(o_orderdate AS DATE) AS ordered, count(*) AS order_count FROM orders GROUP BY 1) o
FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS shipped, count(*) AS line_count FROM lineitem GROUP BY 1) l ON ordered = shipped""")

statement("sql_join_semi", """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) big
              WHERE big.o_custkey = c_custkey)
  AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))""")

statement("sql_join_anti", """
SELECT c.c_custkey, c.c_name FROM customer c
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') p ON p.o_custkey = c.c_custkey
WHERE p.o_custkey IS NULL
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 490000) big
                  WHERE big.o_custkey = c.c_custkey)""")

# The intervals are cut into bins of 100, so the join has an equality to shuffle on;
# points are counted per whole price first, which bounds what one bin can hold.
statement("sql_join_range", """
WITH bands AS (SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand),
     bins AS (SELECT p_brand, low, high,
                     explode(sequence(CAST(floor(low / 100) AS INT), CAST(floor(high / 100) AS INT))) AS bin FROM bands),
     points AS (SELECT floor(l_extendedprice / l_quantity) AS price, count(*) AS line_count
                FROM lineitem GROUP BY 1)
SELECT p_brand, CAST(sum(line_count) AS BIGINT) AS line_count, count(*) AS price_count
FROM points JOIN bins ON bin = CAST(floor(price / 100) AS INT) AND price >= low AND price <= high
GROUP BY p_brand""", """
WITH bands AS (SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand),
     points AS (SELECT floor(l_extendedprice / l_quantity) AS price FROM lineitem)
SELECT p_brand, count(*) AS line_count, count(DISTINCT price) AS price_count
FROM points JOIN bands ON price >= low AND price <= high GROUP BY p_brand""")

# The right side is an aggregate without grouping: exactly one row, at any scale.
statement("sql_join_cross", f"""
SELECT o_orderpriority, status_total, CAST(status_total / all_total AS DECIMAL(18,9)) AS share
FROM (SELECT o_orderpriority, CAST({total(TOTAL)} AS DOUBLE) AS status_total FROM orders GROUP BY o_orderpriority) p
CROSS JOIN (SELECT CAST({total(TOTAL)} AS DOUBLE) AS all_total FROM orders) a""")

statement("sql_lateral", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer,
LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey
         ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) best""", """
SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN (
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2) ON o_custkey = c_custkey""")

# As-of: the latest view of the same user before each purchase, none of the same time. The window is cut
# into minutes and the last view of earlier minutes is carried over, so a user
# with very many events is spread over as many tasks as the user has minutes.
statement("sql_asof", """
WITH marked AS (
    SELECT event_id, user_id, ts, event_type, value,
           datediff(CAST(ts AS DATE), DATE '1970-01-01') * 1440 + hour(ts) * 60 + minute(ts) AS minute,
           CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT) AS micros,
           CASE WHEN event_type = 'view' THEN struct(ts, event_id, value) END AS seen
    FROM events WHERE event_type IN ('view', 'purchase')),
near AS (
    SELECT *, max(seen) OVER (PARTITION BY user_id, minute ORDER BY micros
                              RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_minute FROM marked),
last_seen AS (SELECT user_id, minute, max(seen) AS seen FROM marked GROUP BY user_id, minute),
carried AS (
    SELECT user_id, minute, max(seen) OVER (PARTITION BY user_id ORDER BY minute
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM last_seen)
SELECT event_id, user_id, coalesce(in_minute, earlier).event_id AS view_id,
       coalesce(in_minute, earlier).ts AS view_ts, coalesce(in_minute, earlier).value AS view_value
FROM near JOIN carried USING (user_id, minute) WHERE event_type = 'purchase'""", """
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.ts AS view_ts, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""")

# ---- aggregates -----------------------------------------------------------------

statement("sql_group", f"""
SELECT l_returnflag, l_linestatus, count(*) AS line_count,
       {total('CAST(l_quantity AS DECIMAL(15,2))')} AS sum_qty, {total(PRICE)} AS sum_base,
       {total(REVENUE, 4)} AS sum_net,
       CAST({total('CAST(l_quantity AS DECIMAL(15,2))')} AS DOUBLE) / count(*) AS avg_qty,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")

statement("sql_having", f"""
SELECT l_partkey, count(*) AS line_count, {total(PRICE)} AS sold FROM lineitem
GROUP BY l_partkey HAVING count(*) > 25 AND max(l_quantity) >= 49""")

statement("sql_distinct", """
SELECT l_returnflag, count(*) AS pair_count, count(DISTINCT l_partkey) AS part_count, count(DISTINCT l_suppkey) AS supplier_count
FROM (SELECT DISTINCT l_returnflag, l_partkey, l_suppkey FROM lineitem) pairs GROUP BY l_returnflag""")

statement("sql_agg_filter", f"""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
       CAST(sum({TOTAL}) FILTER (WHERE o_totalprice > 250000) AS DECIMAL(38,2)) AS big_total
FROM orders GROUP BY o_orderpriority""")

statement("sql_grouping_sets", f"""
SELECT l_returnflag, l_linestatus, CAST(extract(YEAR FROM l_shipdate) AS INT) AS ship_year,
       CAST(grouping(l_returnflag) AS INT) AS no_flag, count(*) AS line_count, {total(PRICE)} AS sold
FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (CAST(extract(YEAR FROM l_shipdate) AS INT)), ())""")

statement("sql_rollup", f"""
SELECT r_name, n_name, CAST(sum(customers) AS BIGINT) AS customers, {total('balance')} AS balance
FROM (SELECT c_nationkey, count(*) AS customers, {total('CAST(c_acctbal AS DECIMAL(15,2))')} AS balance
      FROM customer GROUP BY c_nationkey) c
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name)""")

statement("sql_cube", """
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS INT) AS level,
       count(*) AS order_count, max(o_totalprice) AS highest
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")

statement("sql_stats", """
SELECT l_returnflag, CAST(stddev_samp(l_quantity) AS DECIMAL(18,6)) AS qty_stddev,
       CAST(var_pop(l_quantity) AS DECIMAL(18,6)) AS qty_variance,
       CAST(corr(l_quantity, l_extendedprice) AS DECIMAL(18,6)) AS qty_price_corr,
       bool_or(l_discount > 0.09) AS any_deep, bool_and(l_quantity > 0) AS all_positive
FROM lineitem GROUP BY l_returnflag""")

# Quantities are whole numbers up to 50, so each group's value counts stay small.
statement("sql_percentile", """
SELECT l_linestatus, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS DECIMAL(10,4)) AS median_qty,
       CAST(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS DECIMAL(10,4)) AS p90_qty,
       percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS quarter_qty,
       mode() WITHIN GROUP (ORDER BY l_quantity) AS common_qty
FROM lineitem GROUP BY l_linestatus""", """
WITH counted AS (SELECT l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
common AS (SELECT l_linestatus, l_quantity AS common_qty FROM counted
           QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, l_quantity) = 1)
SELECT l_linestatus, CAST(quantile_cont(l_quantity, 0.5) AS DECIMAL(10,4)) AS median_qty,
       CAST(quantile_cont(l_quantity, 0.9) AS DECIMAL(10,4)) AS p90_qty,
       quantile_disc(l_quantity, 0.25) AS quarter_qty, any_value(common_qty) AS common_qty
FROM lineitem JOIN common USING (l_linestatus) GROUP BY l_linestatus""")

# Distinct nations per segment: the list is bounded by the number of nations.
statement("sql_listagg", """
SELECT c_mktsegment, listagg(DISTINCT n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations,
       array_join(array_sort(collect_set(c_nationkey % 5)), '-') AS groups
FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) c
JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment""", """
SELECT c_mktsegment, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations,
       string_agg(DISTINCT c_nationkey % 5, '-' ORDER BY c_nationkey % 5) AS groups
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment""")

# ---- windows --------------------------------------------------------------------

_BY_TYPE = f"""
by_part AS (SELECT l_partkey, {total(REVENUE, 4)} AS revenue, count(*) AS line_count FROM lineitem GROUP BY l_partkey),
by_type AS (SELECT p_brand, p_type, {total('revenue', 4)} AS revenue, CAST(sum(line_count) AS BIGINT) AS line_count
            FROM by_part JOIN part ON p_partkey = l_partkey GROUP BY p_brand, p_type)"""
statement("sql_rank", f"""
WITH {_BY_TYPE}
SELECT p_brand, p_type, revenue,
       CAST(row_number() OVER w AS BIGINT) AS place, CAST(rank() OVER r AS BIGINT) AS rank_lines,
       CAST(dense_rank() OVER r AS BIGINT) AS dense_lines, CAST(ntile(3) OVER w AS BIGINT) AS third,
       percent_rank() OVER w AS percent_place, cume_dist() OVER w AS cumulative
FROM by_type
WINDOW w AS (PARTITION BY p_brand ORDER BY revenue DESC, p_type),
       r AS (PARTITION BY p_brand ORDER BY line_count DIV 20 DESC)""", f"""
WITH {_BY_TYPE}
SELECT p_brand, p_type, revenue,
       CAST(row_number() OVER w AS BIGINT) AS place, CAST(rank() OVER r AS BIGINT) AS rank_lines,
       CAST(dense_rank() OVER r AS BIGINT) AS dense_lines, CAST(ntile(3) OVER w AS BIGINT) AS third,
       percent_rank() OVER w AS percent_place, cume_dist() OVER w AS cumulative
FROM by_type
WINDOW w AS (PARTITION BY p_brand ORDER BY revenue DESC, p_type),
       r AS (PARTITION BY p_brand ORDER BY line_count // 20 DESC)""")


def _windowed(name: str, select: str, source: str, month: bool = True) -> None:
    """A window over monthly or daily totals; only the month function differs in DuckDB."""
    spark_day = "trunc(CAST(l_shipdate AS DATE), 'MONTH')" if month else "CAST(l_shipdate AS DATE)"
    duck_day = "CAST(date_trunc('month', l_shipdate) AS DATE)" if month else "CAST(l_shipdate AS DATE)"
    statement(name, source.format(period=spark_day) + select, source.format(period=duck_day) + select)


_BY_PERIOD = ("WITH periods AS (SELECT l_returnflag, {period} AS period, " + total(PRICE) + " AS sold, "
              "count(*) AS line_count FROM lineitem GROUP BY 1, 2)")
_windowed("sql_lag_lead", """
SELECT l_returnflag, period, sold, lag(sold, 1) OVER w AS before, lead(sold, 2) OVER w AS after_next,
       lag(line_count, 1, 0) OVER w AS lines_before,
       first_value(sold) OVER w AS first_sold,
       last_value(sold) OVER (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_sold,
       nth_value(sold, 3) OVER (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third_sold
FROM periods WINDOW w AS (PARTITION BY l_returnflag ORDER BY period)""", _BY_PERIOD)

_windowed("sql_frame_rows", """
SELECT l_returnflag, period,
       CAST(sum(sold) OVER (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
            AS DECIMAL(38,2)) AS three_months,
       CAST(sum(sold) OVER (PARTITION BY l_returnflag ORDER BY period ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS so_far,
       max(line_count) OVER (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak
FROM periods""", _BY_PERIOD)

_windowed("sql_frame_range", """
SELECT l_returnflag, period,
       CAST(sum(sold) OVER (PARTITION BY l_returnflag ORDER BY period
            RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS week_sold,
       count(*) OVER (PARTITION BY l_returnflag ORDER BY period
            RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS days_before
FROM periods""", _BY_PERIOD, month=False)

# ---- order, limits, sets --------------------------------------------------------

# The unique key ends the order, so range partitions can split a heavy priority.
statement("sql_sort", """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority FROM orders
ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderpriority ASC NULLS FIRST, o_orderkey""")

statement("sql_topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10""")

statement("sql_union", """
SELECT 'distinct' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) u
UNION ALL
SELECT 'all', o_custkey FROM orders
UNION ALL
SELECT 'all', c_custkey FROM customer""", """
SELECT 'distinct' AS kind, CAST(k AS BIGINT) AS k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) u
UNION ALL
SELECT 'all', o_custkey FROM orders
UNION ALL
SELECT 'all', c_custkey FROM customer""")

# With ALL, copies are counted per key and side in each task first.
for _name, _word in (("sql_intersect", "INTERSECT"), ("sql_except", "EXCEPT")):
    statement(_name, f"""
SELECT 'distinct' AS kind, k FROM (SELECT l_suppkey AS k FROM lineitem {_word} SELECT o_custkey FROM orders) d
UNION ALL
SELECT 'all', k FROM (SELECT l_orderkey AS k FROM lineitem {_word} ALL SELECT o_orderkey FROM orders) a""")

# ---- subqueries -----------------------------------------------------------------

statement("sql_cte", f"""
WITH yearly AS (SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS order_year, o_orderpriority,
                       {total(TOTAL)} AS ordered FROM orders GROUP BY 1, 2),
     best AS (SELECT order_year, max(ordered) AS ordered FROM yearly GROUP BY order_year)
SELECT y.order_year, y.o_orderpriority, y.ordered FROM yearly y
JOIN best b ON b.order_year = y.order_year AND b.ordered = y.ordered""")

# Every month between the first and the last order, with months that sold nothing big. The span is halved at
# every level, so the depth is the logarithm of its months and no level does one month alone.
_MONTHS = """
WITH RECURSIVE monthly AS (
    SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month,
           sum(CASE WHEN o_totalprice > 499000 THEN 1 ELSE 0 END) AS order_count FROM orders GROUP BY 1),
calendar(low, high) AS (
    SELECT min(month) AS low, max(month) AS high FROM monthly
    UNION ALL
    SELECT CASE WHEN side = 0 THEN low ELSE (low + high) {div} 2 + 1 END, CASE WHEN side = 0 THEN (low + high) {div} 2 ELSE high END
    FROM (SELECT low, high, {sides} AS side FROM calendar WHERE low < high) AS halves)
SELECT CAST(low {div} 12 AS INT) AS year, CAST(low % 12 + 1 AS INT) AS month,
       CAST(coalesce(order_count, 0) AS BIGINT) AS order_count
FROM calendar LEFT JOIN monthly ON monthly.month = low WHERE low = high"""
statement("sql_recursive", _MONTHS.format(div="div", sides="explode(array(0, 1))").replace(
    "(low + high) div 2", "CAST((low + high) div 2 AS INT)"), _MONTHS.format(div="//", sides="unnest([0, 1])"))

# Correlated on priority and status: the averages are a handful of rows at any scale (5 priorities times 3 statuses),
# so they are sent to the orders and not the orders to them.
_AVERAGE = f"CAST(sum({_MONEY.format('o_totalprice')}) AS DOUBLE) / count(*)"
statement("sql_subquery", f"""
SELECT /*+ BROADCAST(usual) */ o_orderkey, o_custkey, o_totalprice, (SELECT max(c_acctbal) FROM customer) AS best_balance
FROM orders JOIN (SELECT o_orderpriority AS priority, o_orderstatus AS status, {_AVERAGE} AS average FROM orders GROUP BY 1, 2) usual
  ON o_orderpriority = priority AND o_orderstatus = status AND o_totalprice > 1.5 * average""", f"""
SELECT o_orderkey, o_custkey, o_totalprice,
       (SELECT max(c_acctbal) FROM customer) AS best_balance
FROM orders o
WHERE o_totalprice > 1.5 * (SELECT CAST(sum({_MONEY.format('o2.o_totalprice')}) AS DOUBLE) / count(*)
                            FROM orders o2 WHERE o2.o_orderpriority = o.o_orderpriority
                            AND o2.o_orderstatus = o.o_orderstatus)""")

# ---- functions ------------------------------------------------------------------

statement("sql_string", r"""
SELECT doc_id, upper(lang) AS lang, length(text) AS char_count, md5(regexp_replace(text, '[ \n\t]+', ' ')) AS text_md5,
       lpad(source, 8, '.') AS padded, split_part(source, 'c', 2) AS source_number, reverse(source) AS backwards,
       replace(source, 'src', 'S') AS short_source, position('.' IN text) AS first_stop,
       concat_ws('/', lang, source) AS place, substring(source, 2, 2) AS middle, initcap(lang) AS titled
FROM documents""", r"""
SELECT doc_id, upper(lang) AS lang, CAST(length(text) AS INT) AS char_count, md5(regexp_replace(text, '[ \n\t]+', ' ', 'g')) AS text_md5,
       lpad(source, 8, '.') AS padded, split_part(source, 'c', 2) AS source_number, reverse(source) AS backwards,
       replace(source, 'src', 'S') AS short_source, CAST(position('.' IN text) AS INT) AS first_stop,
       concat_ws('/', lang, source) AS place, substring(source, 2, 2) AS middle,
       upper(lang[1]) || lang[2:] AS titled
FROM documents""")

statement("sql_date", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ordered, CAST(date_part('YEAR', o_orderdate) AS INT) AS y,
       quarter(o_orderdate) AS q, extract(DAYOFWEEK_ISO FROM o_orderdate) AS weekday,
       trunc(CAST(o_orderdate AS DATE), 'QUARTER') AS quarter_start, last_day(o_orderdate) AS month_end,
       date_add(CAST(o_orderdate AS DATE), 45) AS due, add_months(CAST(o_orderdate AS DATE), 2) AS renewal,
       datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS age_days,
       date_format(o_orderdate, 'yyyy-MM') AS month_text, o_orderdate + INTERVAL 36 HOURS AS later
FROM orders""", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ordered, CAST(year(o_orderdate) AS INT) AS y,
       CAST(quarter(o_orderdate) AS INT) AS q, CAST(isodow(o_orderdate) AS INT) AS weekday,
       CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, last_day(o_orderdate) AS month_end,
       CAST(o_orderdate AS DATE) + 45 AS due, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS renewal,
       CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS age_days,
       strftime(o_orderdate, '%Y-%m') AS month_text, o_orderdate + INTERVAL 36 HOURS AS later
FROM orders""")

statement("sql_math", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 0) AS rounded, CAST(ceil(l_quantity / 7) AS BIGINT) AS boxes,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands, l_partkey % 7 AS rest, l_partkey DIV 7 AS whole,
       abs(l_quantity - 25) AS off_middle, CAST(sign(l_quantity - 25) AS INT) AS side,
       CAST(power(l_quantity, 2) AS DECIMAL(18,4)) AS squared, CAST(sqrt(l_quantity) AS DECIMAL(18,9)) AS root,
       CAST(ln(l_quantity) AS DECIMAL(18,9)) AS log_qty, width_bucket(l_quantity, 0, 50, 5) AS bucket,
       greatest(l_discount, l_tax) AS larger
FROM lineitem""", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 0) AS rounded, CAST(ceil(l_quantity / 7) AS BIGINT) AS boxes,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands, l_partkey % 7 AS rest, l_partkey // 7 AS whole,
       abs(l_quantity - 25) AS off_middle, CAST(sign(l_quantity - 25) AS INT) AS side,
       CAST(power(l_quantity, 2) AS DECIMAL(18,4)) AS squared, CAST(sqrt(l_quantity) AS DECIMAL(18,9)) AS root,
       CAST(ln(l_quantity) AS DECIMAL(18,9)) AS log_qty, CAST(floor(l_quantity / 10) + 1 AS BIGINT) AS bucket,
       greatest(l_discount, l_tax) AS larger
FROM lineitem""")

statement("sql_array", """
SELECT label, place, count(*) AS vector_count, count_if(entry > 0) AS positive_count,
       max(entry) AS highest, min(size(embedding)) AS dimensions,
       bool_or(array_contains(slice(embedding, 1, 4), entry)) AS in_front
FROM (SELECT label, embedding, posexplode(embedding) AS (place, entry) FROM embeddings) e
GROUP BY label, place""", """
SELECT label, CAST(i - 1 AS INT) AS place, count(*) AS vector_count, count(*) FILTER (WHERE embedding[i] > 0) AS positive_count,
       max(embedding[i]) AS highest, CAST(min(len(embedding)) AS INT) AS dimensions,
       bool_or(list_contains(embedding[1:4], embedding[i])) AS in_front
FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e
GROUP BY label, i""")

statement("sql_json", """
SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS event_count,
       max(variant_get(parse_json(props), '$.k', 'bigint')) AS k_again
FROM events GROUP BY 1, 2""", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS event_count,
       max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_again
FROM events GROUP BY 1, 2""")

statement("sql_pivot", f"""
SELECT * FROM (SELECT o_orderpriority, o_orderstatus, {TOTAL} AS price FROM orders)
PIVOT (CAST(sum(price) AS DECIMAL(38,2)) AS total, count(price) AS orders FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""",
f"""
SELECT o_orderpriority, {', '.join(
    f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN {TOTAL} END) AS DECIMAL(38,2)) AS {s.lower()}_total, "
    f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS {s.lower()}_orders" for s in 'FOP')}
FROM orders GROUP BY o_orderpriority""")

statement("sql_params", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND :high AND o_orderdate >= CAST(:since AS DATE)""", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderdate >= DATE '1997-06-01'""",
          args={"status": "F", "low": 1000, "high": 90000, "since": "1997-06-01"})

statement("sql_cast", """
SELECT o_orderkey, o_orderkey::string AS key_text, CAST(o_totalprice AS INT) AS whole, o_totalprice::decimal(12,1) AS tenth,
       try_cast(substring(o_orderpriority, 1, 1) AS INT) AS level, try_cast(o_orderpriority AS INT) AS not_a_number,
       CAST(o_orderdate AS DATE)::string AS date_text, CAST(o_orderkey % 2 AS BOOLEAN) AS odd, typeof(o_custkey) AS key_type
FROM orders""", """
SELECT o_orderkey, o_orderkey::VARCHAR AS key_text, CAST(trunc(o_totalprice) AS INT) AS whole,
       CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(12,1)) AS tenth,
       try_cast(substring(o_orderpriority, 1, 1) AS INT) AS level, try_cast(o_orderpriority AS INT) AS not_a_number,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_text, CAST(o_orderkey % 2 AS BOOLEAN) AS odd,
       lower(typeof(o_custkey)) AS key_type
FROM orders""")
