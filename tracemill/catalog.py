"""Registered queries over the driver's tables, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analyses
from .operators import heap as heaps
from .session import Session, of_tables

TIMED = "SELECT *, epoch_us(ts)*1000 AS startTime, CAST(value*1000000000 AS BIGINT) AS duration, user_id AS thread FROM events"
#: The frames of a part, leaf first: two words, a type that recurs, a brand that some lack, and the same frame at the bottom.
STACK = "list_concat(string_split(p_name,' '), list_transform(range(p_size % 3), lambda i: p_type), [CASE WHEN p_size % 4 <> 0 THEN p_brand END, 'main'])"
FRAMES = f"list_filter({STACK}, lambda x: x IS NOT NULL)"

#: name: (query, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "scan_filter": ("events/lineitem[l_quantity > 45 and l_returnflag = \"R\"] | select(l_orderkey, l_linenumber, l_quantity)", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"),
    "scan_union": ("events/(click|purchase)[value > 1] | groupBy(event_type, agg=count)", "SELECT event_type AS key, count(*) AS count FROM events WHERE event_type IN ('click','purchase') AND value > 1 GROUP BY 1"),
    "scan_limit": ("events/orders | head(25) | select(o_orderkey)", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25"),
    "path_projection": ("events/all_events/eventThread/javaThreadId | count()", "SELECT count(user_id) AS count FROM events"),
    "path_slice": ("events/stacks/stackTrace[1:4]", f"SELECT value FROM (SELECT unnest({STACK}[2:4]) AS value FROM part) WHERE value IS NOT NULL"),
    "path_index": ("events/stacks/stackTrace[2] | groupBy(value)", f"SELECT key, count(*) AS count FROM (SELECT {STACK}[3] AS key FROM part) WHERE key IS NOT NULL GROUP BY 1"),
    "filter_regex": ("events/part[p_name ~ \".*bolt\"] | groupBy(p_type)", "SELECT p_type AS key, count(*) AS count FROM part WHERE regexp_full_match(p_name, '.*bolt') GROUP BY 1"),
    "filter_matches": ("events/part[matches(p_name, \"^RED.*T$\", \"i\")] | count()", "SELECT count(*) AS count FROM part WHERE regexp_matches(p_name, '^RED.*T$', 'i')"),
    "filter_functions": ("events/orders[startsWith(o_orderpriority, \"1\") or (endsWith(o_orderpriority, \"LOW\") and contains(o_orderpriority, \"5\"))] | groupBy(o_orderpriority)", "SELECT o_orderpriority AS key, count(*) AS count FROM orders WHERE starts_with(o_orderpriority,'1') OR (ends_with(o_orderpriority,'LOW') AND contains(o_orderpriority,'5')) GROUP BY 1"),
    "filter_any": ("events/stacks[any:stackTrace = \"STANDARD\"] | count()", f"SELECT count(*) AS count FROM part WHERE list_contains({STACK}, 'STANDARD')"),
    "filter_none": ("events/stacks[none:stackTrace ~ \"B.*\"] | count()", f"SELECT count(*) AS count FROM part WHERE len(list_filter({STACK}, lambda x: regexp_full_match(x,'B.*'))) = 0"),
    "filter_all": ("events/stacks[all:stackTrace ~ \"[a-zA-Z]+\"] | count()", f"SELECT count(*) AS count FROM part WHERE len(list_filter({STACK}, lambda x: NOT coalesce(regexp_full_match(x,'[a-zA-Z]+'), false))) = 0"),
    "filter_not": ("events/lineitem[not (l_returnflag = \"N\") and l_linestatus != \"O\"] | count()", "SELECT count(*) AS count FROM lineitem WHERE NOT l_returnflag = 'N' AND l_linestatus <> 'O'"),
    "filter_between": ("events/lineitem[between(l_discount, 0.02, 0.05)] | count()", "SELECT count(*) AS count FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05"),
    "filter_before": ("events/all_events[before(startTime, \"2024-01-10\")] | count()", "SELECT count(*) AS count FROM events WHERE ts < TIMESTAMP '2024-01-10'"),
    "filter_on": ("events/all_events[on(startTime, \"2024-01-05\")] | count()", "SELECT count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'"),
    "filter_len": ("events/part[len(p_name) > 8] | count()", "SELECT count(*) AS count FROM part WHERE length(p_name) > 8"),
    "filter_exists": ("events/part[exists(p_brand) and not empty(p_type)] | count()", "SELECT count(*) AS count FROM part WHERE p_brand IS NOT NULL AND p_type <> ''"),
    "pipe_filter": ("events/orders | filter(o_totalprice >= 100000) | groupBy(o_orderstatus)", "SELECT o_orderstatus AS key, count(*) AS count FROM orders WHERE o_totalprice >= 100000 GROUP BY 1"),
    "select_expressions": ("events/lineitem | select(l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, \"${l_returnflag}-${l_linestatus}\" as flags)", "SELECT l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) AS net, l_returnflag||'-'||l_linestatus AS flags FROM lineitem"),
    "select_functions": ("events/part | select(p_partkey, if(p_size > 25, \"big\", \"small\") as size, upper(p_name) as up, substring(p_brand, 0, 5) as brand, length(p_type) as n, coalesce(p_brand, \"?\") as b)", "SELECT p_partkey, CASE WHEN p_size>25 THEN 'big' ELSE 'small' END AS size, upper(p_name) AS up, substr(p_brand,1,5) AS brand, length(p_type) AS n, coalesce(p_brand,'?') AS b FROM part"),
    "select_truncate": ("events/all_events | select(event_id, truncate(startTime, \"hour\") as hour, truncate(startTime, \"week\") as week)", "SELECT event_id, epoch_us(date_trunc('hour',ts))*1000 AS hour, epoch_us(date_trunc('week',ts))*1000 AS week FROM events"),
    "select_duration": ("events/all_events | select(event_id, asDateTime(startTime, \"yyyy-MM-dd HH:mm:ss\") as at)", "SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M:%S') AS at FROM events"),
    "count_rows": ("events/lineitem | count()", "SELECT count(*) AS count FROM lineitem"),
    "sum_first": ("events/lineitem | sum(l_quantity)", "SELECT sum(l_quantity) AS sum, count(l_quantity) AS count FROM lineitem"),
    "stats_path": ("events/orders | stats(o_totalprice)", "SELECT count(x) AS count, min(x) AS min, max(x) AS max, avg(x) AS avg, stddev_pop(x) AS stddev FROM (SELECT o_totalprice AS x FROM orders)"),
    "quantiles_default": ("events/lineitem | quantiles(0.25, 0.5, 0.9, 0.99, path=l_extendedprice)", "SELECT count(x) AS count, quantile_disc(x,0.25) AS p25, quantile_cont(x,0.5) AS p50, quantile_disc(x,0.9) AS p90, quantile_disc(x,0.99) AS p99 FROM (SELECT l_extendedprice AS x FROM lineitem)"),
    "sketch": ("events/part | sketch(p_retailprice)", "SELECT count(x) AS count, min(x) AS min, max(x) AS max, avg(x) AS avg, stddev_pop(x) AS stddev, quantile_cont(x,0.5) AS p50, quantile_disc(x,0.9) AS p90, quantile_disc(x,0.99) AS p99 FROM (SELECT p_retailprice AS x FROM part)"),
    "group_avg": ("events/lineitem[l_quantity > 10] | groupBy(l_returnflag, agg=avg, value=l_quantity, sortBy=key, asc=true)", "SELECT l_returnflag AS key, avg(l_quantity) AS avg FROM lineitem WHERE l_quantity > 10 GROUP BY 1"),
    "group_sum": ("events/lineitem | groupBy(l_shipdate, agg=sum, value=l_quantity)", "SELECT l_shipdate AS key, sum(l_quantity) AS sum FROM lineitem GROUP BY 1"),
    "group_max_expr": ("events/lineitem | groupBy(l_suppkey, agg=max, value=l_extendedprice * l_discount)", "SELECT l_suppkey AS key, max(l_extendedprice*l_discount) AS max FROM lineitem GROUP BY 1"),
    "group_min": ("events/orders | groupBy(o_orderpriority, agg=min, value=o_totalprice)", "SELECT o_orderpriority AS key, min(o_totalprice) AS min FROM orders GROUP BY 1"),
    "group_array_key": ("events/stacks | groupBy(stackTrace, agg=sum, value=p_size)", f"SELECT key, sum(p_size)::DOUBLE AS sum FROM (SELECT unnest({STACK}) AS key, p_size FROM part) WHERE key IS NOT NULL GROUP BY 1"),
    "top_groups": ("events/lineitem | groupBy(l_partkey, agg=sum, value=l_quantity) | sortBy(sum, key) | head(15)", "SELECT l_partkey AS key, sum(l_quantity) AS sum FROM lineitem GROUP BY 1 ORDER BY sum DESC, key DESC LIMIT 15"),
    "top_rows": ("events/orders | top(20, by=o_totalprice) | select(o_orderkey, o_totalprice)", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "tail_rows": ("events/orders | tail(12) | select(o_orderkey)", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 12"),
    "distinct_first": ("events/lineitem | distinct(l_suppkey) | select(l_suppkey, l_orderkey, l_linenumber)", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey*16+l_linenumber) AS n FROM lineitem) WHERE n = 1"),
    "timerange": ("events/all_events | timerange(startTime, duration=duration) | select(count, minEpochNanos, maxEpochNanos, durationNanos)", f"SELECT count(*) AS count, min(startTime) AS minEpochNanos, max(startTime+duration) AS maxEpochNanos, max(startTime+duration)-min(startTime) AS durationNanos FROM ({TIMED})"),
    "op_len": ("events/part | len(p_name)", "SELECT length(p_name) AS len FROM part"),
    "op_upper": ("events/nation/n_name | lowercase()", "SELECT lower(n_name) AS value FROM nation"),
    "op_round": ("events/lineitem | round(l_extendedprice)", "SELECT CAST(floor(l_extendedprice+0.5) AS BIGINT) AS value FROM lineitem"),
    "op_abs": ("events/customer | abs(c_acctbal)", "SELECT abs(c_acctbal) AS value FROM customer"),
    "op_replace": ("events/part | select(p_partkey, p_name) | replace(p_name, \"ring\", \"RING\")", "SELECT p_partkey, replace(p_name,'ring','RING') AS p_name FROM part"),
    "op_contains_later": ("events/part | select(p_partkey, p_name) | contains(p_name, \"bolt\")", "SELECT p_partkey, p_name FROM part WHERE contains(p_name,'bolt')"),
    "decorate_key": ("events/orders | decorateByKey(customer, key=o_custkey, decoratorKey=c_custkey, fields=c_mktsegment) | select(o_orderkey, $decorator.c_mktsegment as segment)", "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "decorate_time": ("events/error | decorateByTime(view, fields=event_id) | select(event_id, $decorator.event_id as view_id)", f"WITH e AS ({TIMED}) SELECT p.event_id, arg_min(d.event_id, (d.startTime, d.event_id)) AS view_id FROM e p LEFT JOIN e d ON d.event_type='view' AND p.thread=d.thread AND p.startTime < d.startTime+d.duration AND p.startTime+p.duration > d.startTime WHERE p.event_type='error' GROUP BY 1"),
    "flame_nodes": ("events/stacks | flamegraph(direction=top-down) | select(path, count)", f"SELECT array_to_string(list_reverse(s)[1:i],';') AS path, count(*) AS count FROM (SELECT s, unnest(range(1, len(s)+1)) AS i FROM (SELECT {FRAMES} AS s FROM part)) GROUP BY 1"),
    "call_edges": ("events/stacks | callgraph() | select(caller, callee, count)", f"SELECT s[i+1] AS caller, s[i] AS callee, count(*) AS count FROM (SELECT s, unnest(range(1, len(s))) AS i FROM (SELECT {FRAMES} AS s FROM part)) GROUP BY 1,2"),
    "samples_group": ("samples | groupBy(thread, sum(cpu))", "SELECT p_brand AS key, sum(p_size)::DOUBLE AS sum_cpu FROM part GROUP BY 1"),
    "samples_leaf": ("samples[cpu > 10] | groupBy(stackTrace/0/name, sum(cpu))", "SELECT string_split(p_name,' ')[1] AS key, sum(p_size)::DOUBLE AS sum_cpu FROM part WHERE p_size > 10 GROUP BY 1"),
    "samples_folded": ("samples | stackprofile(cpu)", f"SELECT array_to_string(list_reverse({FRAMES}),';') AS stack, sum(p_size)::BIGINT AS cpu FROM part GROUP BY 1"),
    "samples_stats": ("samples | stats(cpu)", "SELECT 'cpu' AS field, count(*) AS count, sum(p_size)::BIGINT AS sum, min(p_size)::BIGINT AS min, max(p_size)::BIGINT AS max, floor(avg(p_size)+0.5)::BIGINT AS avg FROM part"),
    "samples_distinct": ("samples | distinct(thread)", "SELECT DISTINCT p_brand AS thread FROM part"),
    "filter_after": ("events/all_events[after(startTime, \"2024-01-20T12:00:00Z\")] | groupBy(event_type)", "SELECT event_type AS key, count(*) AS count FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1"),
    "filter_size_suffix": ("events/lineitem[l_extendedprice > 50K] | groupBy(l_returnflag)", "SELECT l_returnflag AS key, count(*) AS count FROM lineitem WHERE l_extendedprice > 51200 GROUP BY 1"),
    "filter_not_equal_text": ("events/orders[o_orderstatus != \"F\" and o_orderpriority = \"1-URGENT\"] | groupBy(o_orderstatus, agg=sum, value=o_totalprice)", "SELECT o_orderstatus AS key, sum(o_totalprice) AS sum FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1"),
    "filter_arithmetic_path": ("events/all_events[eventThread/javaThreadId <= 20 and duration >= 5000000000] | groupBy(eventThread/osName)", "SELECT 't' || user_id AS key, count(*) AS count FROM events WHERE user_id <= 20 AND CAST(value*1000000000 AS BIGINT) >= 5000000000 GROUP BY 1"),
    "filter_any_index": ("events/stacks[any:stackTrace = \"main\" and stackTrace[0] = \"red\"] | groupBy(p_type)", "SELECT p_type AS key, count(*) AS count FROM part WHERE p_name LIKE 'red %' GROUP BY 1"),
    "filter_array_len": ("events/stacks[len(stackTrace) > 4] | groupBy(p_type)", f"SELECT p_type AS key, count(*) AS count FROM part WHERE len({STACK}) > 4 GROUP BY 1"),
    "path_tail_slice": ("events/stacks/stackTrace[2:] | groupBy(value)", f"SELECT value AS key, count(*) AS count FROM (SELECT unnest({STACK}[3:]) AS value FROM part) WHERE value IS NOT NULL GROUP BY 1"),
    "select_format_duration": ("events/all_events | select(event_id, formatDuration(duration) as text)", "SELECT event_id, CASE WHEN n < 1000 THEN n || 'ns' WHEN n < 1000000 THEN printf('%.2fus', n/1000.0) WHEN n < 1000000000 THEN printf('%.2fms', n/1000000.0) WHEN n < 60000000000 THEN printf('%.2fs', n/1000000000.0) WHEN n < 3600000000000 THEN printf('%dm %ds', n//60000000000, n//1000000000%60) ELSE printf('%dh %dm %ds', n//3600000000000, n//1000000000%3600//60, n//1000000000%60) END AS text FROM (SELECT event_id, CAST(value*1000000000 AS BIGINT) AS n FROM events)"),
    "select_months": ("events/all_events | select(event_id, truncate(startTime, \"day\") as day, truncate(startTime, \"month\") as month, truncate(startTime, \"minute\") as minute)", "SELECT event_id, epoch_us(date_trunc('day',ts))*1000 AS day, epoch_us(date_trunc('month',ts))*1000 AS month, epoch_us(date_trunc('minute',ts))*1000 AS minute FROM events"),
    "select_lower_template": ("events/part | select(p_partkey, lower(p_brand) as low, \"${p_name} (${p_type})\" as text, p_retailprice / p_size as each)", "SELECT p_partkey, lower(p_brand) AS low, p_name || ' (' || p_type || ')' AS text, p_retailprice / p_size AS each FROM part"),
    "select_nested": ("events/all_events | select(event_id, eventThread/osName as thread, eventThread/javaThreadId as id)", "SELECT event_id, 't' || user_id AS thread, user_id AS id FROM events"),
    "group_two_keys": ("events/lineitem | groupBy(l_returnflag, l_linestatus, agg=sum, value=l_quantity)", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum FROM lineitem GROUP BY 1,2"),
    "group_expression_count": ("events/all_events | groupBy(eventThread/osName, agg=count)", "SELECT 't' || user_id AS key, count(*) AS count FROM events GROUP BY 1"),
    "group_of_groups": ("events/orders | groupBy(o_custkey, agg=count) | groupBy(count, agg=count)", "SELECT n AS key, count(*) AS count FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1"),
    "sum_later": ("events/lineitem | select(l_quantity, l_discount) | sum(l_discount)", "SELECT sum(l_discount) AS \"sum(l_discount)\" FROM lineitem"),
    "stats_values": ("events/stacks/p_size | stats()", "SELECT count(x) AS count, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, avg(x) AS avg, stddev_pop(x) AS stddev FROM (SELECT p_size AS x FROM part)"),
    "quantiles_extreme": ("events/orders | quantiles(0.0, 0.001, 0.5, 0.999, 1.0, path=o_totalprice)", "SELECT count(x) AS count, min(x) AS p0, quantile_disc(x,0.001) AS \"p0.1\", quantile_cont(x,0.5) AS p50, quantile_disc(x,0.999) AS \"p99.9\", max(x) AS p100 FROM (SELECT o_totalprice AS x FROM orders)"),
    "quantiles_ties": ("events/part | quantiles(0.1, 0.5, 0.9, path=p_size)", "SELECT count(x) AS count, quantile_disc(x,0.1)::DOUBLE AS p10, quantile_cont(x,0.5)::DOUBLE AS p50, quantile_disc(x,0.9)::DOUBLE AS p90 FROM (SELECT p_size AS x FROM part)"),
    "sort_ascending": ("events/customer | sortBy(c_acctbal, asc=true) | head(30) | select(c_custkey, c_acctbal)", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 30"),
    "sort_two_fields": ("events/part | sortBy(p_size, p_retailprice) | head(40) | select(p_partkey)", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 40"),
    "top_ascending": ("events/supplier | top(7, by=s_acctbal, asc=true) | select(s_suppkey, s_acctbal)", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7"),
    "tail_order": ("events/orders | tail(9) | head(4) | select(o_orderkey)", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9) ORDER BY 1 LIMIT 4"),
    "tail_sorted": ("events/customer | sortBy(c_acctbal) | tail(11) | select(c_custkey)", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 11"),
    "tail_union": ("events/(click|purchase|error) | tail(20) | select(event_id, event_type)", "SELECT event_id, event_type FROM events WHERE event_type IN ('click','purchase','error') ORDER BY event_id DESC LIMIT 20"),
    "head_union": ("events/(nation|region) | head(9) | select(n_nationkey, r_regionkey)", "SELECT n_nationkey, r_regionkey FROM (SELECT n_nationkey, NULL::INT AS r_regionkey, n_nationkey AS o, 0 AS t FROM nation UNION ALL SELECT NULL, r_regionkey, r_regionkey, 1 FROM region) ORDER BY o, t LIMIT 9"),
    "distinct_union": ("events/(view|signup) | distinct(eventThread/javaThreadId) | select(event_id, user_id)", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view','signup')) WHERE n = 1"),
    "distinct_sorted": ("events/customer | sortBy(c_acctbal) | distinct(c_mktsegment) | select(c_mktsegment, c_custkey)", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1"),
    "op_floor": ("events/lineitem | floor(l_extendedprice)", "SELECT floor(l_extendedprice) AS value FROM lineitem"),
    "op_ceil": ("events/lineitem | ceil(l_extendedprice)", "SELECT ceil(l_extendedprice) AS value FROM lineitem"),
    "op_floor_later": ("events/customer | select(c_custkey, c_acctbal) | floor(c_acctbal)", "SELECT c_custkey, floor(c_acctbal) AS c_acctbal FROM customer"),
    "op_uppercase": ("events/part/p_name | uppercase()", "SELECT upper(p_name) AS value FROM part"),
    "op_trim": ("events/nation | trim(n_name)", "SELECT trim(n_name) AS value FROM nation"),
    "op_contains_first": ("events/part | contains(p_name, \"ring\")", "SELECT contains(p_name,'ring') AS value FROM part"),
    "op_len_later": ("events/part | select(p_partkey, p_name) | len(p_name)", "SELECT p_partkey, p_name, length(p_name) AS len FROM part"),
    "op_duration_later": ("events/all_events | select(event_id, startTime) | truncate(startTime, \"hour\")", "SELECT event_id, epoch_us(date_trunc('hour',ts))*1000 AS startTime FROM events"),
    "decorate_key_missing": ("events/customer[c_custkey < 200] | decorateByKey(nation, key=c_nationkey, decoratorKey=n_regionkey, fields=n_name,nothing) | select(c_custkey, $decorator.n_name as name, $decorator.nothing as no)", "SELECT c_custkey, n_name AS name, NULL::VARCHAR AS no FROM customer LEFT JOIN (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) ON n_regionkey = c_nationkey WHERE c_custkey < 200"),
    "decorate_time_union": ("events/(error|signup) | decorateByTime(purchase, fields=event_id) | select(event_id, $decorator.event_id as other)", f"WITH e AS ({TIMED}) SELECT p.event_id, arg_min(d.event_id, (d.startTime, d.event_id)) AS other FROM e p LEFT JOIN e d ON d.event_type='purchase' AND p.thread=d.thread AND p.startTime < d.startTime+d.duration AND p.startTime+p.duration > d.startTime WHERE p.event_type IN ('error','signup') GROUP BY 1"),
    "timerange_rows": ("events/all_events | select(startTime) | timerange(startTime) | select(count, minTicks, maxTicks, durationTicks)", f"SELECT count(*) AS count, min(startTime) AS minTicks, max(startTime) AS maxTicks, max(startTime)-min(startTime) AS durationTicks FROM ({TIMED})"),
    "flame_bottom_up": ("events/stacks | flamegraph() | select(path, name, depth, count, self)", f"SELECT array_to_string(s[1:i],';') AS path, s[i] AS name, i AS depth, count(*) AS count, sum((i = len(s))::BIGINT)::BIGINT AS self FROM (SELECT s, unnest(range(1, len(s)+1)) AS i FROM (SELECT {FRAMES} AS s FROM part)) GROUP BY 1,2,3"),
    "call_edges_callers": ("events/stacks[p_size > 20] | callgraph() | select(caller, callee, count, callers)", f"WITH e AS (SELECT s[i+1] AS caller, s[i] AS callee, count(*) AS count FROM (SELECT s, unnest(range(1, len(s))) AS i FROM (SELECT {FRAMES} AS s FROM part WHERE p_size > 20)) GROUP BY 1,2) SELECT caller, callee, count, count(*) OVER (PARTITION BY callee) AS callers FROM e"),
    "stack_profile": ("events/timed_stacks | stackprofile(minPct=2) | select(path, depth, total, self)", f"WITH t AS (SELECT list_reverse({FRAMES}) AS s FROM part) SELECT array_to_string(s[1:i],';') AS path, i AS depth, count(*) AS total, sum((i = len(s))::BIGINT)::BIGINT AS self FROM (SELECT s, unnest(range(1, len(s)+1)) AS i FROM t) GROUP BY 1,2 HAVING count(*) * 100 >= (SELECT count(*) FROM t) * 2"),
    "samples_select": ("samples[thread ~ \"Brand#1\"] | select(thread, cpu)", "SELECT p_brand AS thread, p_size::BIGINT AS cpu FROM part WHERE regexp_matches(p_brand, 'Brand#1')"),
    "samples_top": ("samples | top(8, cpu) | select(thread, cpu)", "SELECT p_brand AS thread, p_size::BIGINT AS cpu FROM part ORDER BY p_size DESC, p_partkey LIMIT 8"),
    "samples_sorted": ("samples | sortBy(cpu, asc=true) | head(12) | select(thread, cpu)", "SELECT p_brand AS thread, p_size::BIGINT AS cpu FROM part ORDER BY p_size, p_partkey LIMIT 12"),
    "samples_group_count": ("samples[cpu >= 25] | groupBy(stackTrace/1/name)", "SELECT string_split(p_name,' ')[2] AS key, count(*) AS count FROM part WHERE p_size >= 25 GROUP BY 1"),
    "samples_or": ("samples[thread = \"Brand#2\" or cpu < 5] | count()", "SELECT count(*) AS count FROM part WHERE p_brand = 'Brand#2' OR p_size < 5"),
}


def run_query(text: str):
    return lambda spark, sf_dir: of_tables(spark, sf_dir).query(text)


def key_heap(spark: SparkSession, sf_dir: str) -> heaps.Heap:
    """The foreign keys of regions, nations, suppliers and customers as an object graph; regions are its roots."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tag = {"region": 1, "nation": 2, "supplier": 3, "customer": 4}
    node = lambda kind, key: (F.lit(tag[kind] * 1_000_000_000) + F.col(key)).cast("long")
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey"}
    objects = edges = None
    for kind, key in keys.items():
        o = t(kind).select(node(kind, key).alias("id"), F.lit(tag[kind]).cast("long").alias("class_id"), F.lit(16 * tag[kind]).cast("long").alias("shallow"), F.lit(None).cast("int").alias("array_length"), F.lit(None).cast("string").alias("string_value"))
        objects = o if objects is None else objects.union(o)
    for kind, key, above, ref in (("nation", "n_nationkey", "region", "n_regionkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("customer", "c_custkey", "nation", "c_nationkey")):
        e = t(kind).select(node(above, ref).alias("src"), node(kind, key).alias("dst"), F.lit(kind).alias("field"), F.lit(0).alias("ord"), F.lit(True).alias("strong"))
        edges = e if edges is None else edges.union(e)
    above = {"supplier": 9, "customer": 9}
    classes = spark.createDataFrame([(v, f"db/{k.title()}", above.get(k), 16 * v, False) for k, v in tag.items()] + [(9, "db/Party", None, 0, False)], "class_id long, name string, super_id long, instance_size int, is_array boolean")
    roots = t("region").select(F.lit("STICKY_CLASS").alias("type"), node("region", "r_regionkey").alias("object_id"))
    return heaps.Heap(objects, edges, classes, roots)


SIZES = "SELECT n_nationkey, n_regionkey, 32 + coalesce(s,0)*48 + coalesce(c,0)*64 AS r FROM nation LEFT JOIN (SELECT s_nationkey k, count(*) s FROM supplier GROUP BY 1) ON k = n_nationkey LEFT JOIN (SELECT c_nationkey k2, count(*) c FROM customer GROUP BY 1) ON k2 = n_nationkey"
#: All objects of the key graph.
ALL = "SELECT 1000000000 + r_regionkey AS id, 'db/Region' AS c, 16 AS s FROM region UNION ALL SELECT 2000000000 + n_nationkey, 'db/Nation', 32 FROM nation UNION ALL SELECT 3000000000 + s_suppkey, 'db/Supplier', 48 FROM supplier UNION ALL SELECT 4000000000 + c_custkey, 'db/Customer', 64 FROM customer"
#: name: (query over the key graph, SQL)
HEAP_QUERIES: dict[str, tuple[str, str]] = {
    "heap_group": ("objects | groupBy(class, sum(shallow))", "SELECT 'db/Region' AS class, count(*)*16.0 AS shallow FROM region UNION ALL SELECT 'db/Nation', count(*)*32.0 FROM nation UNION ALL SELECT 'db/Supplier', count(*)*48.0 FROM supplier UNION ALL SELECT 'db/Customer', count(*)*64.0 FROM customer"),
    "heap_glob": ("objects/db.*er | count()", "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS count"),
    "heap_retained": ("objects/db.Nation | select(id, retained as size)", f"SELECT 2000000000 + n_nationkey AS id, r::BIGINT AS size FROM ({SIZES})"),
    "heap_dominators": ("objects | dominators(groupBy=class, minRetained=0) | select(class, count, retainedSize)", f"SELECT 'db.Region' AS class, (SELECT count(*) FROM region) AS count, ((SELECT count(*) FROM region)*16 + sum(r))::BIGINT AS retainedSize FROM ({SIZES}) UNION ALL SELECT 'db.Nation', count(*), sum(r)::BIGINT FROM ({SIZES}) UNION ALL SELECT 'db.Supplier', count(*), (count(*)*48)::BIGINT FROM supplier UNION ALL SELECT 'db.Customer', count(*), (count(*)*64)::BIGINT FROM customer"),
    "heap_paths": ("objects/db.Customer | retentionPaths() | select(path, count)", "SELECT 'db.Region → db.Nation → db.Customer' AS path, count(*) AS count FROM customer"),
    "heap_roots": ("gcroots | groupBy(type)", "SELECT 'STICKY_CLASS' AS type, count(*) AS count FROM region"),
    "heap_classes": ("classes[instanceCount > 0] | sortBy(instanceCount) | select(name, instanceCount)", "SELECT 'db/Region' AS name, count(*) AS instanceCount FROM region UNION ALL SELECT 'db/Nation', count(*) FROM nation UNION ALL SELECT 'db/Supplier', count(*) FROM supplier UNION ALL SELECT 'db/Customer', count(*) FROM customer"),
    "heap_breakdown": ("objects/db.Region | retainedBreakdown(2) | select(depth, class, count)", "SELECT 0 AS depth, 'db/Region' AS class, count(*) AS count FROM region UNION ALL SELECT 1, 'db/Nation', count(*) FROM nation UNION ALL SELECT 2, 'db/Supplier', count(*) FROM supplier UNION ALL SELECT 2, 'db/Customer', count(*) FROM customer"),
    "heap_ages": ("ages | groupBy(ageBucket)", "SELECT 'medium' AS ageBucket, (SELECT count(*) FROM region)+(SELECT count(*) FROM nation)+(SELECT count(*) FROM supplier)+(SELECT count(*) FROM customer) AS count"),
    "heap_predicate": ("objects[shallow > 32 and className != \"db/Supplier\"] | groupBy(class)", f"SELECT c AS class, count(*) AS count FROM ({ALL}) WHERE s > 32 AND c <> 'db/Supplier' GROUP BY 1"),
    "heap_select": ("objects/db.Supplier | select(id, shallow * 2 as twice, lower(className) as name)", "SELECT 3000000000 + s_suppkey AS id, 96 AS twice, 'db/supplier' AS name FROM supplier"),
    "heap_stats": ("objects | stats(shallow)", f"SELECT count(*) AS count, sum(s)::DOUBLE AS shallow_sum, min(s)::DOUBLE AS shallow_min, max(s)::DOUBLE AS shallow_max, avg(s) AS shallow_avg FROM ({ALL})"),
    "heap_sum": ("objects/db.* | sum(shallow)", f"SELECT sum(s)::DOUBLE AS sum, count(*) AS count FROM ({ALL})"),
    "heap_top": ("objects | top(9, shallow) | select(id)", f"SELECT id FROM ({ALL}) ORDER BY s DESC, id LIMIT 9"),
    "heap_sorted": ("objects/db.Nation | sortBy(retained) | head(6) | select(id)", f"SELECT 2000000000 + n_nationkey AS id FROM ({SIZES}) ORDER BY r, 1 LIMIT 6"),
    "heap_upper": ("classes[instanceCount > 0] | select(name, instanceCount) | uppercase(name)", f"SELECT upper(c) AS name, count(*) AS \"instanceCount\" FROM ({ALL}) GROUP BY 1"),
    "heap_whatif": ("objects/db.Nation[retained > 2000] | whatif() | select(targetCount, freedBytes, freedObjects)", f"SELECT count(*) AS \"targetCount\", coalesce(sum(r), 0)::BIGINT AS \"freedBytes\", coalesce(sum(1 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)), 0)::BIGINT AS \"freedObjects\" FROM ({SIZES}) WHERE r > 2000"),
    "heap_path_to_root": ("objects/db.Customer[id < 4000000020] | pathToRoot() | select(object, step, id)", "WITH c AS (SELECT 4000000000 + c_custkey AS object, 2000000000 + n_nationkey AS n, 1000000000 + n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey < 20) SELECT object, 0 AS step, r AS id FROM c UNION ALL SELECT object, 1, n FROM c UNION ALL SELECT object, 2, object FROM c"),
    "heap_dominated": ("objects/db.Nation[id = 2000000003] | dominators(objects) | select(id, dominator, retainedSize)", "SELECT 3000000000 + s_suppkey AS id, 2000000003 AS dominator, 48 AS \"retainedSize\" FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 4000000000 + c_custkey, 2000000003, 64 FROM customer WHERE c_nationkey = 3"),
    "heap_tree": ("objects/db.Region | dominators(tree) | select(dominator, dominatedCount, retainedSize)", f"SELECT 1000000000 + n_regionkey AS dominator, count(*) AS \"dominatedCount\", sum(r)::BIGINT AS \"retainedSize\" FROM ({SIZES}) GROUP BY n_regionkey UNION ALL SELECT 2000000000 + n_nationkey, (r - 32 - s * 48) // 64 + s, (r - 32)::BIGINT FROM (SELECT n_nationkey, r, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM ({SIZES})) WHERE r > 32"),
    "heap_root_sizes": ("gcroots | dominatedSize() | select(objectId, dominated, dominatedCount)", f"SELECT 1000000000 + n_regionkey AS \"objectId\", (16 + sum(r))::BIGINT AS dominated, (1 + sum(1 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)))::BIGINT AS \"dominatedCount\" FROM ({SIZES}) GROUP BY n_regionkey"),
    "heap_instanceof": ("objects/instanceof/db.Party | groupBy(class)", "SELECT 'db/Supplier' AS class, count(*) AS count FROM supplier UNION ALL SELECT 'db/Customer', count(*) FROM customer"),
    "heap_age_values": ("ages | groupBy(estimatedAge)", f"SELECT CASE c WHEN 'db/Region' THEN 40 WHEN 'db/Nation' THEN 41 ELSE 40 END AS \"estimatedAge\", count(*) AS count FROM ({ALL}) GROUP BY 1"),
    "heap_join_self": ("classes[instanceCount > 0] | join(session=base, by=name) | select(name, instanceCountDelta)", f"SELECT c AS name, count(*) - count(*) FILTER (WHERE id % 2 = 0) AS \"instanceCountDelta\" FROM ({ALL}) GROUP BY 1"),
}


def run_heap_query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session, heap = of_tables(spark, sf_dir), key_heap(spark, sf_dir)
        session.set("base", Session(spark).add_heap(heaps.Heap(heap.objects.where("id % 2 = 0"), heap.edges, heap.classes, heap.gcroots)))
        return session.add_heap(heap).query(text)

    return run


def recording(spark: SparkSession, sf_dir: str) -> Session:
    """The star schema as a recording: parts are execution samples and orders exceptions, lineitems file I/O, customers CPU loads."""
    s = of_tables(spark, sf_dir)
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    state = F.concat(F.lit("STATE_"), F.element_at(F.array(*map(F.lit, STATES)), (F.col("p_size") % len(STATES) + 1).cast("int")))
    samples = s.event_type("timed_stacks").withColumn("state", state)
    made = F.array(F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("app.O"), F.substring("o_orderpriority", 1, 1), F.lit("Exception.<init>"))))
    stack = F.concat(F.array(F.when(F.col("o_orderkey") % 5 != 0, "java.lang.Throwable.<init>")), made, F.array(F.lit("app.Site.<init>"), F.concat(F.lit("app.Site.of"), F.col("o_orderstatus"))))
    thrown = t("orders").select(F.col("o_orderkey").alias("_ord"), F.struct(F.lit("app/Thrown").alias("name")).alias("thrownClass"), stack.alias("stackTrace"))
    io = t("lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("_ord"), "l_returnflag", (F.col("l_quantity") * 500_000).cast("long").alias("duration"), F.col("l_extendedprice").cast("long").alias("bytesRead"), F.col("l_orderkey").cast("long").alias("startTime"))
    load = t("customer").select(F.col("c_custkey").alias("_ord"), F.col("c_custkey").cast("long").alias("startTime"), (F.abs("c_acctbal") / 10_000).alias("machineTotal"))
    gc = t("supplier").select(F.col("s_suppkey").alias("_ord"), F.col("s_suppkey").cast("long").alias("startTime"), (F.abs("s_acctbal") * 1000).cast("long").alias("sumOfPauses"), (F.abs("s_acctbal") * 1000).cast("long").alias("duration"))
    monitors = t("nation").select(F.col("n_nationkey").alias("_ord"), F.col("n_nationkey").cast("long").alias("startTime"), F.concat(F.lit("lock/"), F.col("n_regionkey").cast("string")).alias("monitorClass"), (F.col("n_nationkey") * 1000).cast("long").alias("duration"))
    for name, df in (("jdk.ExecutionSample", samples), ("jdk.JavaExceptionThrow", thrown), ("jdk.FileRead", io.where("l_returnflag = 'R'")), ("jdk.SocketRead", io.where("l_returnflag = 'N'")), ("jdk.CPULoad", load), ("jdk.GarbageCollection", gc), ("jdk.JavaMonitorEnter", monitors)):
        s.add_events(name, df)
    s.samples = s.samples()
    return s


#: States of threads that samples are given in turn.
STATES = ("RUNNABLE", "BLOCKED_ON_MONITOR_ENTER", "SLEEPING", "IN_OBJECT_WAIT", "PARKED")
STATE = "['RUNNABLE','BLOCKED','TIMED_WAITING','WAITING','WAITING'][p_size % 5 + 1]"
IO_SQL = "SELECT {0} AS type, count(*) AS operations, sum(l_extendedprice::BIGINT)::DOUBLE AS bytes, avg(d) AS \"avgNanos\", max(d)::DOUBLE AS \"maxNanos\", sum((d > 10000000)::BIGINT)::BIGINT AS slow FROM (SELECT trunc(l_extendedprice) AS l_extendedprice, CAST(l_quantity*500000 AS BIGINT) AS d FROM lineitem WHERE l_returnflag = {1}) HAVING count(*) > 0"
OF = "sum(CASE WHEN state IN ({0}) THEN 1 ELSE 0 END)::BIGINT"
THREADS = f"SELECT p_brand AS thread, count(*) AS samples, {OF.format(chr(39) + 'RUNNABLE' + chr(39))} AS runnable, sum((state LIKE '%WAITING')::BIGINT)::BIGINT AS waiting, sum((state = 'BLOCKED')::BIGINT)::BIGINT AS blocked FROM (SELECT *, {STATE} AS state FROM part) GROUP BY 1"
THROWN = "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'app.O' || substr(o_orderpriority,1,1) || 'Exception' ELSE 'app.Thrown' END AS type, 'app.Site.of' || o_orderstatus AS site FROM orders"
#: name: (report of a recording, SQL)
REPORTS: dict[str, tuple] = {
    "report_hot_methods": (lambda s: analyses.hot_methods(s, limit=10).select("method", "samples", "pct"), "SELECT method, samples, round(100.0 * samples / (SELECT count(*) FROM part), 1) AS pct FROM (SELECT string_split(p_name,' ')[1] AS method, count(*) AS samples FROM part GROUP BY 1) ORDER BY samples DESC, method LIMIT 10"),
    "report_flamegraph": (lambda s: analyses.flamegraph(s, "jdk.ExecutionSample", min_samples=2, max_depth=3), f"SELECT array_to_string(list_reverse({FRAMES}[1:3]),';') AS stack, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 2"),
    "report_exceptions": (lambda s: analyses.exceptions(s)["types"].select("type", "count", "pct"), f"SELECT type, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS pct FROM ({THROWN}) GROUP BY 1"),
    "report_throw_sites": (lambda s: analyses.exceptions(s)["sites"], f"SELECT site, count(*) AS count FROM ({THROWN}) GROUP BY 1 ORDER BY count DESC, site LIMIT 20"),
    "report_cpu": (lambda s: analyses.use(s)["cpu"], "SELECT avg(x) AS avg, min(x) AS min, max(x) AS max, quantile_disc(x, 0.95) AS p95, quantile_disc(x, 0.99) AS p99, CASE WHEN avg(x) < 30 THEN 'LOW' WHEN avg(x) < 70 THEN 'MODERATE_UTILIZATION' WHEN avg(x) < 90 THEN 'HIGH_UTILIZATION' ELSE 'SATURATED' END AS assessment FROM (SELECT abs(c_acctbal)/10000*100 AS x FROM customer)"),
    "report_io": (lambda s: analyses.use(s)["io"], IO_SQL.format("'jdk.FileRead'", "'R'") + " UNION ALL " + IO_SQL.format("'jdk.SocketRead'", "'N'")),
    "report_io_window": (lambda s: analyses.use(s, 100, 300)["io"].select("type", "operations"), "SELECT CASE l_returnflag WHEN 'R' THEN 'jdk.FileRead' ELSE 'jdk.SocketRead' END AS type, count(*) AS operations FROM lineitem WHERE l_returnflag IN ('R','N') AND l_orderkey BETWEEN 100 AND 300 GROUP BY 1"),
    "report_thread_use": (lambda s: analyses.use(s)["threads"], "SELECT state, count(*) AS samples, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS pct FROM (SELECT ['RUNNABLE','BLOCKED_ON_MONITOR_ENTER','SLEEPING','IN_OBJECT_WAIT','PARKED'][p_size % 5 + 1] AS state FROM part) GROUP BY 1"),
    "report_states": (lambda s: analyses.tsa(s)["states"], f"SELECT state, count(*) AS samples, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS pct FROM (SELECT {STATE} AS state FROM part) GROUP BY 1"),
    "report_threads": (lambda s: analyses.tsa(s, min_samples=6)["threads"], f"SELECT *, CASE WHEN runnable*100.0/samples > 80 THEN 'CPU_INTENSIVE' WHEN waiting*100.0/samples > 70 THEN 'IO_WAITING' WHEN blocked*100.0/samples > 20 THEN 'LOCK_CONTENTION' ELSE 'BALANCED' END AS behaviour FROM ({THREADS}) WHERE samples >= 6 ORDER BY samples DESC, thread LIMIT 20"),
    "report_state_leaders": (lambda s: analyses.tsa(s, top_threads=3)["top"].select("thread", "state", "n", "rank"), f"SELECT thread, state, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, thread) AS rank FROM (SELECT p_brand AS thread, {STATE} AS state, count(*) AS n FROM part GROUP BY 1, 2)) WHERE rank <= 3"),
    "report_monitors": (lambda s: analyses.tsa(s)["monitors"], "SELECT 'lock/' || n_regionkey AS monitor, count(*) AS events, sum(n_nationkey*1000)::DOUBLE AS \"totalNanos\", avg(n_nationkey*1000) AS \"avgNanos\" FROM nation GROUP BY 1"),
    "report_collections": (lambda s: analyses.summary(s)["gc"], "SELECT count(*) AS collections, sum(d)::DOUBLE AS \"totalPause\", avg(d) AS \"avgPause\", max(d)::DOUBLE AS \"maxPause\" FROM (SELECT trunc(abs(s_acctbal)*1000) AS d FROM supplier)"),
    "report_types": (lambda s: s.type_counts().where("type IN ('jdk.CPULoad', 'orders', 'jdk.FileRead', 'error')"), "SELECT 'jdk.CPULoad' AS type, count(*) AS count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'jdk.FileRead', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'error', count(*) FROM events WHERE event_type = 'error'"),
    "report_sample_methods": (lambda s: analyses.sample_hot_methods(s, limit=5), "SELECT method, cpu, round(100.0 * cpu / (SELECT sum(p_size) FROM part), 1) AS pct FROM (SELECT string_split(p_name,' ')[1] AS method, sum(p_size)::BIGINT AS cpu FROM part GROUP BY 1) ORDER BY cpu DESC, method LIMIT 5"),
    "report_sample_states": (lambda s: analyses.sample_states(s), "SELECT 'RUNNING' AS state, sum(p_size)::BIGINT AS value, 100.0 AS pct FROM part"),
    "report_sample_totals": (lambda s: analyses.sample_use(s)["cpu"], "SELECT 'cpu' AS type, count(*) AS samples, sum(p_size)::BIGINT AS total FROM part"),
    "report_sample_summary": (lambda s: analyses.sample_summary(s)["threads"], "SELECT p_brand AS thread, count(*) AS samples FROM part GROUP BY 1 ORDER BY samples DESC, thread LIMIT 20"),
    "report_sample_flamegraph": (lambda s: analyses.sample_flamegraph(s, min_value=40, max_depth=2), "SELECT array_to_string(list_reverse(string_split(p_name,' ')), ';') AS stack, sum(p_size)::BIGINT AS cpu FROM part GROUP BY 1 HAVING sum(p_size) >= 40"),
    "report_map": (lambda s: s.query("events/nation | toMap(n_name, n_regionkey)").select(F.explode("map").alias("key", "value")), "SELECT n_name AS key, n_regionkey AS value FROM nation"),
}


def run_report(report):
    return lambda spark, sf_dir: report(recording(spark, sf_dir))


def queries() -> dict:
    return {n: run_query(q) for n, (q, _) in QUERIES.items()} | {n: run_heap_query(q) for n, (q, _) in HEAP_QUERIES.items()} | {n: run_report(r) for n, (r, _) in REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in (QUERIES | HEAP_QUERIES | REPORTS).items()}
