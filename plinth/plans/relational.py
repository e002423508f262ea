"""Queries in the engine's dialect. Sums of money are exact: whole units and millionths are added as integers, so no order of rows changes them."""

LINES = "events lineitem orders customer supplier nation region part documents embeddings pages benchmark labels conversations"


def parts(x: str) -> tuple[str, str]:
    """Sums of whole units and of millionths, as 64-bit integers: unboxed, and room for 9e12 times 1e6 units."""
    return f"sum(CAST(floor({x}) AS BIGINT))", f"sum(CAST(floor((({x}) - floor({x})) * 1000000 + 0.5) AS BIGINT))"


def total(x: str) -> str:
    whole, rest = parts(x)
    return f"(CAST({whole} AS DOUBLE) + CAST({rest} AS DOUBLE) / 1000000)"


def mean(x: str) -> str:
    return f"{total(x)} / count(*)"


REVENUE = "l_extendedprice * (1 - l_discount)"
PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ps_availqty, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey) ps"

#: name -> SQL that the engine and the oracle both run, or (engine's, oracle's).
SQL: dict = {
    "q01": f"""SELECT l_returnflag, l_linestatus, {total("l_quantity")} AS sum_qty, {total("l_extendedprice")} AS sum_base_price, {total(REVENUE)} AS sum_disc_price, {total(REVENUE + " * (1 + l_tax)")} AS sum_charge, {mean("l_quantity")} AS avg_qty, {mean("l_extendedprice")} AS avg_price, {mean("l_discount")} AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '2001-08-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q02": f"""SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost FROM part, supplier, {PS}, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size BETWEEN 10 AND 20 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
        AND ps_supplycost = (SELECT min(l_extendedprice) FROM lineitem, supplier s2, nation n2, region r2 WHERE l_partkey = p_partkey AND s2.s_suppkey = l_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, ps_supplycost LIMIT 100""",
    "q03": f"""SELECT l_orderkey, {total(REVENUE)} AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'MACHINERY' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-24' AND l_shipdate > DATE '1998-03-24'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "q04": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05": f"""SELECT n_name, {total(REVENUE)} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA'
        AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "q06": f"""SELECT {total("l_extendedprice * l_discount")} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q07": f"""SELECT supp_nation, cust_nation, l_year, {total("volume")} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2, region r1, region r2
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND n2.n_regionkey = r2.r_regionkey AND ((r1.r_name = 'ASIA' AND r2.r_name = 'EUROPE') OR (r1.r_name = 'EUROPE' AND r2.r_name = 'ASIA')) AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08": f"""SELECT o_year, {total("CASE WHEN s_region = 'ASIA' THEN volume ELSE 0 END")} / {total("volume")} AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, r2.r_name AS s_region FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region r1, region r2
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND r1.r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND p_type = 'ECONOMY') all_nations GROUP BY o_year ORDER BY o_year""",
    "q09": f"""SELECT nation, o_year, {total("amount")} AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} - ps_supplycost * 0.1 AS amount FROM part, supplier, lineitem, {PS}, orders, nation
        WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%small%') profit GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q10": f"""SELECT c_custkey, c_name, {total(REVENUE)} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": f"""SELECT ps_partkey, {total("ps_supplycost * ps_availqty")} AS value FROM {PS}, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name < 'NATION_15' GROUP BY ps_partkey
        HAVING {total("ps_supplycost * ps_availqty")} > (SELECT {total("ps_supplycost * ps_availqty")} * 0.001 FROM {PS}, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name < 'NATION_15') ORDER BY value DESC, ps_partkey""",
    "q12": """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem
        WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate + INTERVAL '60' DAY AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_returnflag ORDER BY l_returnflag""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus NOT LIKE '%F%' GROUP BY c_custkey) c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14": f"""SELECT 100.0 * {total("CASE WHEN p_type LIKE 'PROMO%' THEN " + REVENUE + " ELSE 0 END")} / {total(REVENUE)} AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "q15": f"""WITH revenue (supplier_no, total_revenue) AS (SELECT l_suppkey, {total(REVENUE)} FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "q16": f"""SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {PS}, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17": f"""SELECT {total("l_extendedprice")} / 7.0 AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "q18": f"""SELECT c_name, c_custkey, o_orderkey, o_totalprice, {total("l_quantity")} AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "q19": f"""SELECT {total(REVENUE)} AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15) OR (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 10 AND l_quantity <= 40 AND p_size BETWEEN 1 AND 30)""",
    "q20": f"""SELECT s_name, s_suppkey FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM {PS} WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01')) AND s_nationkey = n_nationkey AND n_name < 'NATION_20' ORDER BY s_name""",
    "q21": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL '60' DAY) AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": f"""SELECT c_mktsegment, count(*) AS numcust, {total("c_acctbal")} AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment ORDER BY c_mktsegment""",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    "join_left": "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY o_orderkey",
    "join_right": "SELECT o_orderkey, max(l_linenumber) AS last_line FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "join_full": "SELECT a.k AS a_k, b.k AS b_k FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey % 3 = 0) a FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) b ON a.k = b.k",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta": "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND b.p_retailprice < a.p_retailprice - 500",
    "join_using": "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'P') o USING (l_orderkey) GROUP BY l_orderkey",
    "join_semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "join_semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "join_anti_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "join_anti_not_in": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 48)",
    "scalar_subquery": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)",
    "correlated_subquery": "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders",
    # aggregates
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "agg_global": f"SELECT count(*) AS n, {total('l_quantity')} AS qty, min(l_shipdate) > DATE '1990-01-01' AS recent FROM lineitem",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n FROM events GROUP BY event_type",
    "agg_having_subquery": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > (SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem)",
    "agg_two_level": "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) x GROUP BY n",
    "agg_string": ("SELECT r_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey"),
    "agg_jsonb": ("SELECT n_regionkey, jsonb_agg(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey"),
    "agg_conditional": f"SELECT o_orderpriority, {total('CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN o_totalprice ELSE 0 END')} AS finished FROM orders GROUP BY o_orderpriority",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    # order, sets, CTEs
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20",
    "nulls_last": "SELECT v FROM (SELECT nullif(n_nationkey % 5, 0) AS v, n_nationkey FROM nation) x ORDER BY v, n_nationkey",
    "distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(sum(n) AS BIGINT) AS total FROM t",
    # scalar functions
    "json_arrow_text": "SELECT event_id, props->>'k' AS k FROM events",
    "json_arrow": ("SELECT event_id, props->'k' AS k FROM events", "SELECT event_id, CAST(props->'k' AS VARCHAR) AS k FROM events"),
    "json_exists": ("SELECT event_id FROM events WHERE props ? 'k'", "SELECT event_id FROM events WHERE json_exists(props, '$.k')"),
    "json_filter": "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND props->>'k' IN ('1', '2', '3')",
    "json_build_object": ("SELECT n_nationkey, json_build_object('name', n_name, 'region', n_regionkey) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('name', n_name, 'region', n_regionkey) AS VARCHAR) AS j FROM nation"),
    "to_char": ("SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"),
    "date_trunc": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, count(*) AS n FROM orders GROUP BY 1",
    "extract": "SELECT CAST(extract(month FROM l_shipdate) AS BIGINT) AS m, count(*) AS n FROM lineitem GROUP BY 1",
    "interval": "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS VARCHAR) AS d FROM orders",
    "split_part": "SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part",
    "substring": "SELECT p_partkey, substring(p_name FROM 2 FOR 4) AS w, trim(both 's' FROM p_name) AS t FROM part",
    "regex": ("SELECT p_partkey FROM part WHERE p_name ~ '^s.*g$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^s.*g$')"),
    "regex_not_ci": ("SELECT p_partkey FROM part WHERE NOT p_name ~* '^S'", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^S', 'i')"),
    "format": ("SELECT n_nationkey, format('%s in %s', n_name, n_regionkey) AS f FROM nation", "SELECT n_nationkey, printf('%s in %d', n_name, n_regionkey) AS f FROM nation"),
    "sha256": ("SELECT doc_id, encode(sha256(text), 'hex') AS h FROM documents", "SELECT doc_id, sha256(text) AS h FROM documents"),
    "any_array": "SELECT n_nationkey FROM nation WHERE n_name = ANY(ARRAY['NATION_1', 'NATION_7'])",
    "any_literal": ("SELECT n_nationkey FROM nation WHERE n_name = ANY('{NATION_1,NATION_7}')", "SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_1', 'NATION_7')"),
    "all_array": ("SELECT n_nationkey FROM nation WHERE n_name <> ALL('{NATION_1,NATION_7}'::text[])", "SELECT n_nationkey FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_7')"),
    "array_upper": ("SELECT vec_id, array_upper(embedding, 1) AS n FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings"),
    "array_subscript": "SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS x FROM embeddings",
    "array_to_string": ("SELECT n_nationkey, array_to_string(ARRAY[n_name, 'x'], '-') AS s FROM nation", "SELECT n_nationkey, array_to_string([n_name, 'x'], '-') AS s FROM nation"),
    "array_subquery": ("SELECT r_regionkey, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name), ',') AS s FROM region", "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = 1) AS s FROM region"),
    "generate_series": "SELECT CAST(n AS BIGINT) AS n FROM generate_series(1, 100) AS t(n) WHERE n % 7 = 0",
    "case_coalesce": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer",
    "cast": "SELECT p_partkey, p_size::text AS s, CAST(p_retailprice AS BIGINT) > 1000 AS dear, '17'::int4 AS n FROM part",
    "values": "SELECT x, y FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)",
    "quote_ident": ("SELECT quote_ident(n_name) AS q FROM nation", "SELECT '\"' || n_name || '\"' AS q FROM nation"),
    "like": "SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND p_name NOT LIKE 's%'",
    # windows
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders",
    "window_lag": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "window_running": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events",
    "window_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer",
}


def _of(parts_: str) -> str:
    """PS of some parts only: the filter goes below the aggregate."""
    return PS.replace(" GROUP BY", f" WHERE l_partkey IN ({parts_}) GROUP BY")


_VALUE = parts("ps_supplycost * ps_availqty")
#: Texts that say the same as those above with less work: filters below aggregates, one pass over lineitem in place of self joins.
FASTER = {
    "q02": f"""SELECT s_acctbal, s_name, n_name, ps_partkey AS p_partkey, ps_supplycost FROM (SELECT s_acctbal, s_name, n_name, ps_partkey, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY ps_partkey) AS least
        FROM {_of("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")}, supplier, nation, region WHERE s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE') x
        WHERE ps_supplycost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, ps_supplycost LIMIT 100""",
    "q09": f"""SELECT nation, o_year, {total("amount")} AS sum_profit FROM (SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} - ps_supplycost * 0.1 AS amount FROM supplier, lineitem, {_of("SELECT p_partkey FROM part WHERE p_name LIKE '%small%'")}, orders, nation
        WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey) profit GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q11": f"""WITH v AS (SELECT ps_partkey, {_VALUE[0]} AS whole, {_VALUE[1]} AS rest FROM {PS}, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name < 'NATION_15' GROUP BY ps_partkey)
        SELECT ps_partkey, CAST(whole AS DOUBLE) + CAST(rest AS DOUBLE) / 1000000 AS value FROM v WHERE CAST(whole AS DOUBLE) + CAST(rest AS DOUBLE) / 1000000 > (SELECT (CAST(sum(whole) AS DOUBLE) + CAST(sum(rest) AS DOUBLE) / 1000000) * 0.001 FROM v) ORDER BY value DESC, ps_partkey""",
    "q21": """WITH l AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_shipdate > o_orderdate + INTERVAL '60' DAY THEN l_suppkey END AS late FROM lineitem, orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F'),
        g AS (SELECT l_orderkey, min(l_suppkey) AS first_supp, max(l_suppkey) AS last_supp, min(late) AS first_late, max(late) AS last_late, count(late) AS n FROM l GROUP BY l_orderkey)
        SELECT s_name, CAST(sum(n) AS BIGINT) AS numwait FROM g, supplier, nation WHERE first_late = last_late AND first_supp < last_supp AND s_suppkey = first_late AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
}
SQL |= {name: (faster, SQL[name]) for name, faster in FASTER.items()}
