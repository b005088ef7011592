"""Queries in SQL: one text for both engines, or a pair (Spark's, the oracle's) where the dialects differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.register import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str | tuple[str, str]] = {
    # scans, filters, slices
    "scan_filter_compound": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 45 AND l_discount < 0.03) OR (l_returnflag = 'R' AND NOT l_tax > 0.01)",
    "filter_in_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000 AND o_custkey NOT IN (1, 2, 3) AND o_orderkey NOT BETWEEN 10 AND 20",
    "filter_like_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_name NOT ILIKE 'Z%'",
    "filter_null_truth": "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS pos, (c_acctbal > 0) IS NOT FALSE AS nf, nullif(c_nationkey, 3) IS NULL AS isn FROM customer WHERE nullif(c_nationkey, 5) IS NOT NULL",
    "filter_cast_typed_literal": ("SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, try_cast(o_orderpriority AS INT) AS bad FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < DATE '1997-01-01'", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, try_cast(o_orderpriority AS INT) AS bad FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < DATE '1997-01-01'"),
    "filter_regex": ("SELECT doc_id FROM documents WHERE regexp_match(text, '^[A-Z][a-z]+ [a-z]+')", "SELECT doc_id FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]+ [a-z]+')"),
    "arithmetic_integer_division": ("SELECT l_orderkey, l_linenumber, l_orderkey div l_linenumber AS d, l_orderkey % l_linenumber AS m, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // l_linenumber AS d, l_orderkey % l_linenumber AS m, -l_linenumber AS neg FROM lineitem"),
    "limit_offset_ordered": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100 OFFSET 50",
    "order_by_nulls": "SELECT k, n, rank() OVER (ORDER BY n DESC NULLS LAST, k NULLS FIRST) AS r FROM (SELECT nullif(p_size, 10) AS n, p_partkey AS k FROM part) t",
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "distinct_values": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
    "count_rows_filter": "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01 00:00:00' AND l_quantity < 20",
    # TPC-H
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey < 12 AND o_orderdate < TIMESTAMP '1996-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1996-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24",
    # joins
    "join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 15) s FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey < 400) c ON s_suppkey = c_custkey",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_custkey % 3 <> 0", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_custkey % 3 <> 0"),
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_natural": "SELECT r_regionkey, r_name, n FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) x",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_self": "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderstatus = 'P'",
    # aggregation
    "agg_group": ("SELECT l_suppkey, count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_tax), 6) AS a, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_tax), 6) AS a, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp FROM lineitem GROUP BY l_suppkey"),
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supp, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_filter_having": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "agg_correlation": "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_linestatus",
    "agg_bool_bit": "SELECT l_returnflag, bool_and(l_quantity > 0) AS ba, bool_or(l_tax > 0.07) AS bo, bit_and(l_linenumber) AS bnd, bit_or(l_linenumber) AS bor, bit_xor(l_linenumber) AS bx FROM lineitem GROUP BY l_returnflag",
    "agg_median_percentile": ("SELECT l_returnflag, median(l_quantity) AS med, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag"),
    "agg_array_string": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, size(collect_set(n_nationkey)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, len(list(DISTINCT n_nationkey)) AS n FROM nation GROUP BY n_regionkey"),
    "agg_first_last": ("SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS f, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS l FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey"),
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    # windows
    "window_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_lag_lead": "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS prev, lead(o_orderkey, 2) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_running": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS mov FROM lineitem",
    "window_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part",
    "window_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "window_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    # set operations and sub-queries
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "subquery_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "subquery_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "subquery_scalar": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "cte_chain": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT o_custkey, round(t, 2) AS t FROM a, b WHERE t > 1.5 * m",
    "case_expression": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS class FROM part",
    "unnest_values": ("SELECT label, count(*) AS n, round(sum(x), 3) AS s FROM (SELECT label, explode(embedding) AS x FROM embeddings) t GROUP BY label", "SELECT label, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 3) AS s FROM (SELECT label, unnest(embedding) AS x FROM embeddings) t GROUP BY label"),
    # functions
    "fn_string": ("SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, trim(concat('  ', p_name, ' ')) AS tr, char_length(p_name) AS cl, octet_length(p_name) AS ol, substr(p_name, 2, 3) AS ss, left(p_name, 3) AS le, right(p_name, 3) AS ri, lpad(p_name, 30, '*') AS lp, rpad(p_name, 30, '-') AS rp, replace(p_name, 'a', 'X') AS re, translate(p_name, 'abc', 'xyz') AS tl, reverse(p_name) AS rv, repeat(p_brand, 2) AS rt, split_part(p_name, ' ', 1) AS sp, strpos(p_name, 'e') AS st, startswith(p_name, 'a') AS sw, endswith(p_name, 'e') AS ew, contains(p_name, 'ee') AS ct, concat_ws('-', p_brand, p_name) AS cw, initcap(lower(p_name)) IS NOT NULL AS ic, ascii(p_name) AS asc, chr(65 + p_size % 20) AS ch, levenshtein(p_name, p_brand) AS lv, to_hex(p_partkey) AS hx FROM part", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, trim(concat('  ', p_name, ' ')) AS tr, length(p_name) AS cl, octet_length(encode(p_name)) AS ol, substr(p_name, 2, 3) AS ss, left(p_name, 3) AS le, right(p_name, 3) AS ri, lpad(p_name, 30, '*') AS lp, rpad(p_name, 30, '-') AS rp, replace(p_name, 'a', 'X') AS re, translate(p_name, 'abc', 'xyz') AS tl, reverse(p_name) AS rv, repeat(p_brand, 2) AS rt, split_part(p_name, ' ', 1) AS sp, strpos(p_name, 'e') AS st, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, contains(p_name, 'ee') AS ct, concat_ws('-', p_brand, p_name) AS cw, TRUE AS ic, ascii(p_name) AS asc, chr(CAST(65 + p_size % 20 AS INT)) AS ch, levenshtein(p_name, p_brand) AS lv, lower(to_hex(p_partkey)) AS hx FROM part"),
    "fn_regex": ("SELECT doc_id, md5(regexp_replace(text, '[aeiou]+', '_')) AS r, regexp_count(text, 'th') AS c, regexp_extract(text, '([A-Z][a-z]+)', 1) AS f, size(regexp_extract_all(text, '[a-z]+ing', 0)) AS n FROM documents", "SELECT doc_id, md5(regexp_replace(text, '[aeiou]+', '_', 'g')) AS r, len(regexp_extract_all(text, 'th')) AS c, regexp_extract(text, '([A-Z][a-z]+)', 1) AS f, len(regexp_extract_all(text, '[a-z]+ing')) AS n FROM documents"),
    "fn_datetime": ("SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, extract(year FROM o_orderdate) AS y, extract(dow FROM o_orderdate) - 1 AS dw, extract(doy FROM o_orderdate) AS dy, CAST(o_orderdate AS DATE) AS d, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS dd, o_orderdate + INTERVAL 3 DAYS AS plus, make_date(2020, 2, 29) AS md, unix_timestamp(o_orderdate) AS u, timestamp_seconds(floor(unix_timestamp(o_orderdate) / 604800) * 604800) AS bin FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, extract(year FROM o_orderdate) AS y, extract(dow FROM o_orderdate) AS dw, extract(doy FROM o_orderdate) AS dy, CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS dd, o_orderdate + INTERVAL 3 DAY AS plus, make_date(2020, 2, 29) AS md, CAST(epoch(o_orderdate) AS BIGINT) AS u, make_timestamp(CAST(floor(epoch(o_orderdate) / 604800) * 604800000000 AS BIGINT)) AS bin FROM orders"),
    "fn_math": ("SELECT p_partkey, abs(p_size - 25) AS ab, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(p_retailprice, 1) AS ro, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_retailprice), 6) AS cb, round(power(p_size, 1.5), 4) AS po, round(exp(p_size / 10.0), 4) AS ex, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(log2(p_retailprice), 6) AS l2, round(sin(p_size), 6) AS si, sign(p_size - 25) AS sg, factorial(CAST(p_size % 10 AS INT)) AS fa, isnan(p_retailprice) AS na, round(pi(), 6) AS p FROM part", "SELECT p_partkey, abs(p_size - 25) AS ab, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(p_retailprice, 1) AS ro, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_retailprice), 6) AS cb, round(power(p_size, 1.5), 4) AS po, round(exp(p_size / 10.0), 4) AS ex, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(log2(p_retailprice), 6) AS l2, round(sin(p_size), 6) AS si, CAST(sign(p_size - 25) AS DOUBLE) AS sg, CAST(factorial(CAST(p_size % 10 AS INT)) AS BIGINT) AS fa, isnan(p_retailprice) AS na, round(pi(), 6) AS p FROM part"),
    "fn_array": ("SELECT doc_id, size(w) AS n, array_has(w, 'the') AS h, array_has_any(w, array('and', 'of')) AS ha, array_has_all(w, array('the', 'of')) AS hl, array_position(w, 'the') AS p, size(array_distinct(w)) AS d, array_join(slice(w, 2, 3), ',') AS s, element_at(w, 1) AS f, array_join(sort_array(array_distinct(slice(w, 1, 5))), ',') AS so, array_join(array_remove(slice(w, 1, 5), 'the'), ',') AS rm, array_join(array_append(slice(w, 1, 2), 'z'), ',') AS ap, array_join(flatten(array(slice(w, 1, 2), slice(w, 1, 1))), ',') AS fl, size(array_union(slice(w, 1, 6), array('the'))) AS un, size(array_intersect(w, array('the', 'of'))) AS it FROM (SELECT doc_id, split(lower(text), ' ') AS w FROM documents) t", "SELECT doc_id, len(w) AS n, list_contains(w, 'the') AS h, list_has_any(w, ['and', 'of']) AS ha, list_has_all(w, ['the', 'of']) AS hl, coalesce(list_position(w, 'the'), 0) AS p, len(list_distinct(w)) AS d, array_to_string(w[2:4], ',') AS s, w[1] AS f, array_to_string(list_sort(list_distinct(w[1:5])), ',') AS so, array_to_string(list_filter(w[1:5], lambda x: x <> 'the'), ',') AS rm, array_to_string(list_append(w[1:2], 'z'), ',') AS ap, array_to_string(flatten([w[1:2], w[1:1]]), ',') AS fl, len(list_distinct(list_concat(w[1:6], ['the']))) AS un, len(list_intersect(w, ['the', 'of'])) AS it FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents) t"),
    "fn_conditional": "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS co, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, nullif(c_nationkey, 4) AS nf FROM customer",
    "fn_hash_encode": ("SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, base64(encode(c_name, 'utf-8')) AS b, hex(encode(c_name, 'utf-8')) AS h FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, base64(encode(c_name)) AS b, hex(encode(c_name)) AS h FROM customer"),
    "fn_struct": ("SELECT n_nationkey, s.name AS name, s.k AS k, size(array(s.k, 1, 2)) AS n FROM (SELECT n_nationkey, named_struct('name', n_name, 'k', n_regionkey) AS s FROM nation) t", "SELECT n_nationkey, s.name AS name, s.k AS k, len([s.k, 1, 2]) AS n FROM (SELECT n_nationkey, {'name': n_name, 'k': n_regionkey} AS s FROM nation) t"),
    "contains_tokens": ("SELECT doc_id, contains_tokens(text, 'the of.') AS c FROM documents", "SELECT doc_id, list_has_all(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), ['the', 'of']) AS c FROM documents"),
    "list_predicates_any_all": ("SELECT vec_id FROM embeddings WHERE arrays_overlap(array(label, label + 1), array(3, 7)) OR array_contains(array(label), 5)", "SELECT vec_id FROM embeddings WHERE list_has_any([label, label + 1], [3, 7]) OR list_contains([label], 5)"),
    "events_tumbling": ("SELECT window.start AS w, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS w, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2"),
    "events_sessions": ("SELECT user_id, session_window.start AS s, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", "SELECT user_id, min(ts) AS s, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g"),
}


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    register(spark)


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(text)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _run(t if isinstance(t, str) else t[0]) for n, t in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: t if isinstance(t, str) else t[1] for n, t in SQL.items()}
