"""Relational constructs: projections, joins, aggregates, windows, sorts, set operations, scalar functions."""

from __future__ import annotations

from tidelog.plans.registry import sql_query

# Projections, filters, predicates.
sql_query("f01_exclude_columns", "SELECT * EXCEPT (props) FROM {events}", "SELECT * EXCLUDE (props) FROM {events}")
sql_query("f02_case_first_match", "SELECT row_id, CASE WHEN alarm THEN 'alarm' WHEN state = 'signup' THEN 'normal' WHEN value < 0 THEN 'negative' ELSE 'other' END AS category FROM {ev}")
sql_query("f03_null_safe_equality", "SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END) <=> (CASE WHEN c_acctbal < 100 THEN NULL ELSE c_nationkey END) AS same FROM {customer}", "SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END) IS NOT DISTINCT FROM (CASE WHEN c_acctbal < 100 THEN NULL ELSE c_nationkey END) AS same FROM {customer}")
sql_query("f04_in_between_half_open", "SELECT row_id, channel_id, ts FROM {ev} WHERE state IN ('error', 'signup') AND value BETWEEN 10 AND 60 AND ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'", "SELECT row_id, channel_id, ts FROM {ev} WHERE state IN ('error', 'signup') AND value BETWEEN 10 AND 60 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
sql_query("f05_source_archive", r"SELECT s, element_at(split(replace(s, '\\', '/'), '/'), -1) = concat('ext-journal-', CAST(year(ts) AS STRING), '.7z') AS in_archive, count(*) AS n FROM (SELECT ts, CASE WHEN row_id % 3 = 0 THEN concat('C:\\in\\ext-journal-', CAST(year(ts) AS STRING), '.7z') WHEN row_id % 3 = 1 THEN '/data/ext-journal-2019.7z' ELSE 'sample.csv' END AS s FROM {ev}) GROUP BY s, ts IS NULL, element_at(split(replace(s, '\\', '/'), '/'), -1) = concat('ext-journal-', CAST(year(ts) AS STRING), '.7z')", r"SELECT s, split_part(replace(s, '\', '/'), '/', -1) = concat('ext-journal-', year(ts), '.7z') AS in_archive, count(*) AS n FROM (SELECT ts, CASE WHEN row_id % 3 = 0 THEN concat('C:\in\ext-journal-', year(ts), '.7z') WHEN row_id % 3 = 1 THEN '/data/ext-journal-2019.7z' ELSE 'sample.csv' END AS s FROM {ev}) GROUP BY ALL")
sql_query("f08_hash_ordered_sample", "SELECT row_id, sha2(CAST(row_id AS STRING), 256) AS digest FROM {ev} ORDER BY digest, row_id LIMIT 100", "SELECT row_id, sha256(CAST(row_id AS VARCHAR)) AS digest FROM {ev} ORDER BY digest, row_id LIMIT 100")
sql_query("f07_hash_sample_keeps_positives", "SELECT row_id, alarm FROM {ev} WHERE alarm OR substring(md5(CAST(row_id AS STRING)), 1, 2) < '20'", "SELECT row_id, alarm FROM {ev} WHERE alarm OR substring(md5(CAST(row_id AS VARCHAR)), 1, 2) < '20'")
sql_query("f11_missing_masks", "SELECT row_id, CAST(v IS NULL AS INT) AS missing__value, coalesce(v, -1) AS value FROM (SELECT row_id, CASE WHEN state <> 'view' THEN value END AS v FROM {ev})")
sql_query("f12_text_search", "SELECT c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '00007') OR contains(lower(n_name), 'nation_1') OR contains(lower(c_mktsegment), 'auto')")
sql_query("f13_group_filter", "SELECT channel_id, g FROM (SELECT channel_id, CASE WHEN max(CAST(alarm AS INT)) = 0 THEN 'healthy' WHEN avg(CAST(alarm AS INT)) > 0.25 THEN 'warning' ELSE 'unavailable' END AS g FROM {ev} GROUP BY channel_id) WHERE g = 'warning'")

# Joins.
sql_query("j01_inner_using", "SELECT o_orderkey, l_linenumber, l_quantity FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 40")
sql_query("j02_left_dimension", "SELECT e.row_id, c.c_name, n.n_name FROM {ev} e LEFT JOIN (SELECT * FROM {customer} WHERE c_mktsegment <> 'BUILDING') c ON e.channel_id = CAST(c.c_custkey AS VARCHAR(20)) LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey")
sql_query("j03_full_outer_compare", "SELECT sum(CAST(a.k IS NULL AS INT)) AS only_b, sum(CAST(b.k IS NULL AS INT)) AS only_a, sum(CAST(a.k = b.k AND NOT (a.v <=> b.v) AS INT)) AS different FROM (SELECT event_id AS k, value AS v FROM {events} WHERE event_id % 3 <> 0) a FULL OUTER JOIN (SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM {events} WHERE event_id % 4 <> 0) b ON a.k = b.k", "SELECT CAST(sum(CAST(a.k IS NULL AS INT)) AS BIGINT) AS only_b, CAST(sum(CAST(b.k IS NULL AS INT)) AS BIGINT) AS only_a, CAST(sum(CAST(a.k = b.k AND a.v IS DISTINCT FROM b.v AS INT)) AS BIGINT) AS different FROM (SELECT event_id AS k, value AS v FROM {events} WHERE event_id % 3 <> 0) a FULL OUTER JOIN (SELECT event_id AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM {events} WHERE event_id % 4 <> 0) b ON a.k = b.k")
sql_query("j04_left_semi", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
sql_query("j04_left_semi_range", "SELECT e.row_id FROM {ev} e WHERE e.alarm AND EXISTS (SELECT 1 FROM {ev} f WHERE f.channel_id = e.channel_id AND f.state = 'signup' AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL '6' HOUR)")
sql_query("j05_left_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 150000) ON o_custkey = c_custkey", "SELECT c_custkey FROM {customer} ANTI JOIN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 150000) ON o_custkey = c_custkey")
sql_query("j06_self_join_first", "WITH f AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS first_key, o_totalprice FROM {orders}) SELECT a.o_orderkey, b.o_totalprice AS first_price FROM f a JOIN {orders} b ON a.first_key = b.o_orderkey WHERE a.o_orderkey <> a.first_key")
sql_query("j07_null_safe_multi_key", "WITH k AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS u FROM {events}), g AS (SELECT t, u, min(event_id) AS first_id FROM k GROUP BY t, u) SELECT k.event_id, g.first_id FROM k JOIN g ON k.t <=> g.t AND k.u <=> g.u", "WITH k AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS u FROM {events}), g AS (SELECT t, u, min(event_id) AS first_id FROM k GROUP BY t, u) SELECT k.event_id, g.first_id FROM k JOIN g ON k.t IS NOT DISTINCT FROM g.t AND k.u IS NOT DISTINCT FROM g.u")
sql_query("j15_dictionary_match", "WITH d AS (SELECT s_nationkey AS k, count(*) AS c, count(DISTINCT s_acctbal > 0) AS v FROM {supplier} GROUP BY s_nationkey) SELECT n_nationkey, CASE WHEN d.k IS NULL THEN 'unmapped_type' WHEN v > 1 THEN 'conflicting' WHEN c > 1 THEN 'multiple' ELSE 'exact' END AS status FROM {nation} LEFT JOIN d ON n_nationkey = d.k")
sql_query("j16_one_to_one", "SELECT a.event_id, a.value, b.k FROM (SELECT event_id, value FROM {events}) a JOIN (SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}) b ON a.event_id = b.event_id", "SELECT a.event_id, a.value, b.k FROM (SELECT event_id, value FROM {events}) a JOIN (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}) b ON a.event_id = b.event_id")
sql_query("j18_key_alignment", "SELECT (SELECT count(*) FROM {orders} LEFT ANTI JOIN {customer} ON o_custkey = c_custkey) AS only_left, (SELECT count(*) FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey) AS only_right", "SELECT (SELECT count(*) FROM {orders} ANTI JOIN {customer} ON o_custkey = c_custkey) AS only_left, (SELECT count(*) FROM {customer} ANTI JOIN {orders} ON o_custkey = c_custkey) AS only_right")
TREE = "SELECT concat('n', CAST(n_nationkey AS VARCHAR(9))) AS id, CASE WHEN n_nationkey < 20 THEN concat('n', CAST(n_nationkey + 5 AS VARCHAR(9))) WHEN n_nationkey < 23 THEN concat('n', CAST(20 + (n_nationkey - 19) % 3 AS VARCHAR(9))) ELSE 'missing' END AS parent FROM {nation}"
_tree_body = "SELECT id AS root, parent AS node, 1 AS depth FROM t UNION ALL SELECT w.root, t.parent, w.depth + 1 FROM w JOIN t ON w.node = t.id WHERE w.depth < 12) SELECT root, max(depth) AS depth, max(CASE WHEN node = root THEN 1 ELSE 0 END) AS in_cycle, max(CASE WHEN node = 'missing' THEN 1 ELSE 0 END) AS missing_parent FROM w GROUP BY root"
sql_query("j20_parent_chains", f"WITH RECURSIVE t AS ({TREE}), w AS ({_tree_body}")

# Aggregations.
sql_query("g01_counts_and_fractions", "SELECT state, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, round(avg(CAST(alarm AS INT)), 6) AS alarm_share, round(avg(value), 6) AS mean FROM {ev} GROUP BY state")
sql_query("g02_channel_statistics", "SELECT channel_id, count(*) AS n, count(value) AS numeric_n, count(state) AS state_n, count(CASE WHEN alarm THEN 1 END) AS alarms, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT state) AS states FROM {ev} GROUP BY channel_id")
sql_query("g03_count_distinct", "SELECT count(DISTINCT channel_id) AS channels, count(DISTINCT state) AS states FROM {ev}")
sql_query("g04_count_distinct_tuple", "SELECT date_trunc('HOUR', ts) AS hour, count(DISTINCT struct(CASE WHEN value < 20 THEN NULL ELSE state END, alarm)) AS variants FROM {ev} GROUP BY date_trunc('HOUR', ts)", "SELECT date_trunc('hour', ts) AS hour, count(DISTINCT (CASE WHEN value < 20 THEN NULL ELSE state END, alarm)) AS variants FROM {ev} GROUP BY 1")
sql_query("g05_having", "SELECT channel_id, date_trunc('HOUR', ts) AS hour, count(DISTINCT state) AS states FROM {ev} GROUP BY channel_id, date_trunc('HOUR', ts) HAVING count(DISTINCT state) > 1")
sql_query("g06_filtered_aggregates", "SELECT channel_id, count(*) FILTER (WHERE alarm) AS alarms, count(*) FILTER (WHERE value > 50) AS high, max(ts) FILTER (WHERE state = 'signup') AS last_normal FROM {ev} GROUP BY channel_id")
sql_query("g07_group_by_all", "SELECT state, alarm, count(*) AS n FROM {ev} GROUP BY ALL")
sql_query("g08_bool_or_and", "SELECT channel_id, bool_or(alarm) AS any_alarm, bool_and(value > 1) AS all_over_one FROM {ev} GROUP BY channel_id")
sql_query("g09_min_max_distinctness", "SELECT channel_id, date_trunc('HOUR', ts) AS hour, min(state) <> max(state) AS ambiguous FROM {ev} GROUP BY channel_id, date_trunc('HOUR', ts)")
sql_query("g10_any_value", "SELECT o_custkey, any_value(c_name) AS name, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey")
sql_query("g11_bottom_n_structs", "SELECT channel_id, array_join(transform(array_sort(collect_list(struct(r, row_id))), x -> CAST(x.row_id AS STRING)), ',') AS lowest FROM (SELECT channel_id, row_id, row_number() OVER (PARTITION BY channel_id ORDER BY value, row_id) AS r FROM {ev}) WHERE r <= 3 GROUP BY channel_id", "SELECT channel_id, array_to_string(list_transform(list_slice(list_sort(list({{'v': value, 'r': row_id}})), 1, 3), lambda x: CAST(x.r AS VARCHAR)), ',') AS lowest FROM {ev} GROUP BY channel_id".replace("{{", "{").replace("}}", "}").replace("{'v': value, 'r': row_id}", "struct_pack(v := value, r := row_id)"))
sql_query("g12_nest_structs", "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_orderdate, o_orderkey))), x -> CAST(x.o_orderkey AS STRING)), '>') AS path FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '>' ORDER BY o_orderdate, o_orderkey) AS path FROM {orders} GROUP BY o_custkey")
sql_query("g13_unnest_histogram", "SELECT flag, count(*) AS n FROM (SELECT explode(filter(array(CASE WHEN alarm THEN 'alarm' END, CASE WHEN value > 80 THEN 'high' END, CASE WHEN value < 5 THEN 'low' END), x -> x IS NOT NULL)) AS flag FROM {ev}) GROUP BY flag", "SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN alarm THEN 'alarm' END, CASE WHEN value > 80 THEN 'high' END, CASE WHEN value < 5 THEN 'low' END]) AS flag FROM {ev}) WHERE flag IS NOT NULL GROUP BY flag")
sql_query("g15_quantiles", "SELECT channel_id, round(percentile(value, 0.1), 6) AS q10, round(percentile(value, 0.9), 6) AS q90, round(percentile(value, 0.75) - percentile(value, 0.25), 6) AS iqr FROM {ev} GROUP BY channel_id", "SELECT channel_id, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM {ev} GROUP BY channel_id")
sql_query("g16_population_stddev", "SELECT channel_id, state, CASE WHEN count(*) >= 2 THEN round(stddev_pop(value), 6) END AS sd FROM {ev} GROUP BY channel_id, state")
sql_query("g18_first_last_delta", "SELECT channel_id, round(max_by(value, ts) - min_by(value, ts), 6) AS delta FROM {ev} GROUP BY channel_id", "SELECT channel_id, round(arg_max(value, ts) - arg_min(value, ts), 6) AS delta FROM {ev} GROUP BY channel_id")
sql_query("g19_mode_by_text", "SELECT channel_id, state FROM (SELECT channel_id, state, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, state) AS r FROM {ev} GROUP BY channel_id, state) WHERE r = 1")
sql_query("g20_mode_by_first_seen", "SELECT channel_id, state FROM (SELECT channel_id, state, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, min(ts)) AS r FROM {ev} GROUP BY channel_id, state) WHERE r = 1")
sql_query("g21_top_value_counts", "SELECT value, count(*) AS n FROM {ev} GROUP BY value ORDER BY n DESC, value LIMIT 10")
sql_query("g22_channel_days", "SELECT state, count(DISTINCT struct(channel_id, CAST(ts AS DATE))) AS channel_days FROM {ev} GROUP BY state", "SELECT state, count(DISTINCT (channel_id, CAST(ts AS DATE))) AS channel_days FROM {ev} GROUP BY state")
sql_query("g23_observed_bounds", "SELECT channel_id, state, year(ts) AS y, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE alarm) AS alarms FROM {ev} GROUP BY channel_id, state, year(ts)", "SELECT channel_id, state, CAST(year(ts) AS INT) AS y, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE alarm) AS alarms FROM {ev} GROUP BY channel_id, state, year(ts)")
sql_query("g24_state_histogram", "SELECT month(ts) AS m, state, alarm, count(*) AS n FROM {ev} GROUP BY month(ts), state, alarm", "SELECT CAST(month(ts) AS INT) AS m, state, alarm, count(*) AS n FROM {ev} GROUP BY month(ts), state, alarm")
sql_query("g25_pivot", "SELECT * FROM (SELECT channel_id, state, row_id FROM {ev}) PIVOT (count(row_id) FOR state IN ('error' AS error, 'signup' AS signup, 'view' AS view))", "SELECT channel_id, nullif(count(*) FILTER (WHERE state = 'error'), 0) AS error, nullif(count(*) FILTER (WHERE state = 'signup'), 0) AS signup, nullif(count(*) FILTER (WHERE state = 'view'), 0) AS view FROM {ev} GROUP BY channel_id")
sql_query("g26_grouped_minimum", "SELECT event_type, user_id, min(event_id) AS first_id, count(*) AS copies FROM (SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id % 10 = 0) GROUP BY event_type, user_id")
sql_query("g27_weighted_counts", "SELECT state, CAST(sum(n) AS BIGINT) AS total FROM (SELECT channel_id, state, count(*) AS n FROM {ev} GROUP BY channel_id, state) GROUP BY state")
sql_query("g29_multiset_fingerprint", "SELECT count(*) AS n, CAST(sum(h) AS BIGINT) AS total, bit_xor(h) AS x, min(h) AS least, max(h) AS most FROM (SELECT CAST(conv(substring(md5(concat(CAST(row_id AS STRING), '|', state)), 1, 8), 16, 10) AS BIGINT) AS h FROM {ev})", "SELECT count(*) AS n, CAST(sum(h) AS BIGINT) AS total, bit_xor(h) AS x, min(h) AS least, max(h) AS most FROM (SELECT CAST(concat('0x', substring(md5(concat(CAST(row_id AS VARCHAR), '|', state)), 1, 8)) AS BIGINT) AS h FROM {ev})")
sql_query("g31_concentration", "SELECT round(sum(CASE WHEN r <= 1 THEN n ELSE 0 END) / sum(n), 6) AS top1, round(sum(CASE WHEN r <= 5 THEN n ELSE 0 END) / sum(n), 6) AS top5, round(sum(CASE WHEN r <= 10 THEN n ELSE 0 END) / sum(n), 6) AS top10 FROM (SELECT channel_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, channel_id) AS r FROM {ev} WHERE alarm GROUP BY channel_id)")
sql_query("g32_grouping_sets", "SELECT coalesce(state, 'all') AS state, coalesce(month(ts), -1) AS m, count(*) AS n FROM {ev} GROUP BY GROUPING SETS ((), (state), (state, month(ts)))", "SELECT coalesce(state, 'all') AS state, CAST(coalesce(month(ts), -1) AS INT) AS m, count(*) AS n FROM {ev} GROUP BY GROUPING SETS ((), (state), (state, month(ts)))")

# Windows.
sql_query("w01_global_duplicates", "WITH r AS (SELECT event_id, user_id, event_type, value FROM {events} UNION ALL SELECT event_id + 1000000, user_id, event_type, value FROM {events} WHERE event_id % 4 = 0) SELECT event_id, CASE WHEN event_id <> min(event_id) OVER (PARTITION BY user_id, event_type, value) THEN 'exact_duplicate' ELSE 'first' END AS disposition FROM r")
sql_query("w02_top_n_per_group", "SELECT channel_id, row_id, value FROM (SELECT *, row_number() OVER w AS r FROM {ev} WINDOW w AS (PARTITION BY channel_id ORDER BY value DESC, row_id)) WHERE r <= 3")
sql_query("w03_qualify", "SELECT channel_id, row_id FROM (SELECT channel_id, row_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, row_id DESC) AS r FROM {ev}) WHERE r = 1", "SELECT channel_id, row_id FROM {ev} QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, row_id DESC) = 1")
sql_query("w04_run_compression", "SELECT channel_id, ts, state FROM (SELECT channel_id, ts, state, lag(state) OVER (PARTITION BY channel_id ORDER BY ts) AS p FROM {ev}) WHERE state = 'signup' OR NOT (p <=> state)", "SELECT channel_id, ts, state FROM (SELECT channel_id, ts, state, lag(state) OVER (PARTITION BY channel_id ORDER BY ts) AS p FROM {ev}) WHERE state = 'signup' OR p IS DISTINCT FROM state")
sql_query("w05_running_sums", "SELECT row_id, CAST(sum(CAST(alarm AS INT)) OVER (PARTITION BY channel_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS alarms_so_far FROM {ev}")
sql_query("w06_last_true_at", "SELECT row_id, max(CASE WHEN state = 'signup' THEN ts END) OVER (PARTITION BY channel_id ORDER BY ts) AS last_normal_at FROM {ev}")
sql_query("w07_conflict_so_far", "SELECT row_id, min(state) OVER (PARTITION BY channel_id ORDER BY ts) <> max(state) OVER (PARTITION BY channel_id ORDER BY ts) AS conflict FROM {ev}")
sql_query("w09_rolling_range", "SELECT row_id, round(max(value) OVER w - min(value) OVER w, 6) AS span FROM {ev} WINDOW w AS (PARTITION BY channel_id ORDER BY ts RANGE BETWEEN INTERVAL '0 05:59:59.999999' DAY TO SECOND PRECEDING AND CURRENT ROW)", "SELECT row_id, round(max(value) OVER w - min(value) OVER w, 6) AS span FROM {ev} WINDOW w AS (PARTITION BY channel_id ORDER BY ts RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW)")
sql_query("w10_gap_to_previous", "SELECT row_id, coalesce(CAST(timestampdiff(MICROSECOND, lag(ts) OVER (PARTITION BY channel_id ORDER BY ts), ts) AS BIGINT), -1) AS gap_us FROM {ev}", "SELECT row_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY channel_id ORDER BY ts), ts), -1) AS gap_us FROM {ev}")
sql_query("w14_segments_by_gap", "SELECT row_id, CAST(sum(b) OVER (PARTITION BY channel_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT row_id, channel_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL '24' HOUR OR state = 'view' OR coalesce(lag(state) OVER w, 'view') = 'view' THEN 1 ELSE 0 END AS b FROM {ev} WINDOW w AS (PARTITION BY channel_id ORDER BY ts))")
sql_query("w15_last_change", "SELECT row_id, last(CASE WHEN c THEN ts END, true) OVER (PARTITION BY channel_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS changed_at FROM (SELECT *, NOT (lag(state) OVER (PARTITION BY channel_id ORDER BY ts) <=> state) AS c FROM {ev})", "SELECT row_id, last_value(CASE WHEN c THEN ts END IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS changed_at FROM (SELECT *, lag(state) OVER (PARTITION BY channel_id ORDER BY ts) IS DISTINCT FROM state AS c FROM {ev})")
sql_query("w20_time_reversals", "SELECT source, count(*) AS reversals FROM (SELECT user_id % 5 AS source, ts < lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY md5(CAST(event_id AS VARCHAR(20)))) AS back FROM {events}) WHERE back GROUP BY source")
sql_query("w22_mode_changes", "SELECT row_id, coalesce(state <> p AND ts - q <= INTERVAL '24' HOUR, false) AS changed FROM (SELECT row_id, ts, state, lag(state) OVER w AS p, lag(ts) OVER w AS q FROM {ev} WINDOW w AS (PARTITION BY channel_id, ts >= CAST('2024-01-16' AS TIMESTAMP_NTZ) ORDER BY ts))", "SELECT row_id, coalesce(state <> p AND ts - q <= INTERVAL '24' HOUR, false) AS changed FROM (SELECT row_id, ts, state, lag(state) OVER w AS p, lag(ts) OVER w AS q FROM {ev} WINDOW w AS (PARTITION BY channel_id, ts >= CAST('2024-01-16' AS TIMESTAMP) ORDER BY ts))")
sql_query("w23_order_check", "SELECT f, count(*) AS decreases FROM (SELECT f, k, lag(k) OVER (PARTITION BY f ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS p FROM (SELECT l_returnflag AS f, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, struct(l_shipdate, l_partkey, l_suppkey) AS k FROM {lineitem})) WHERE p > k GROUP BY f", "SELECT f, count(*) AS decreases FROM (SELECT f, k, lag(k) OVER (PARTITION BY f ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS p FROM (SELECT l_returnflag AS f, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row(l_shipdate, l_partkey, l_suppkey) AS k FROM lineitem)) WHERE p > k GROUP BY f")
sql_query("w24_stratified_sample", "SELECT channel_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(CAST(row_id AS VARCHAR(20)))) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY md5(CAST(row_id AS VARCHAR(20)))) AS r FROM {ev}) WHERE r <= 2) WHERE r2 <= 20")
sql_query("w25_top_quartile_hash", "SELECT channel_id FROM (SELECT channel_id, n, row_number() OVER (ORDER BY n DESC, channel_id) AS r, count(*) OVER () AS c FROM (SELECT channel_id, count(*) AS n FROM {ev} GROUP BY channel_id)) WHERE r <= floor((c + 3) / 4) ORDER BY md5(channel_id) LIMIT 10")

# Sorts, limits, set operations.
sql_query("o01_multi_key_sort", "SELECT row_id, state, value FROM {ev} ORDER BY state, value DESC, row_id")
sql_query("o02_limit", "SELECT row_id, ts FROM {ev} ORDER BY ts, row_id LIMIT 25")
sql_query("o03_latest_per_key", "SELECT channel_id, row_id, state FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts DESC, row_id DESC) AS r FROM {ev}) WHERE r = 1")
sql_query("o04_latest_time_per_key", "SELECT channel_id, max(ts) AS last_at FROM {ev} GROUP BY channel_id")
sql_query("o05_dashboard_sort", "SELECT channel_id, warning, score FROM (SELECT channel_id, max(CAST(alarm AS INT)) AS warning, CASE WHEN count(*) > 60 THEN round(avg(value), 4) END AS score FROM {ev} GROUP BY channel_id) ORDER BY warning DESC, score IS NOT NULL DESC, coalesce(nullif(score, 0), -1) DESC, channel_id DESC")
sql_query("o06_lexicographic_argmax", "SELECT max_by(state, struct(n, -v)) AS best FROM (SELECT state, count(*) AS n, min(row_id) AS v FROM {ev} GROUP BY state)", "SELECT arg_max(state, (n, -v)) AS best FROM (SELECT state, count(*) AS n, min(row_id) AS v FROM {ev} GROUP BY state)")
sql_query("o07_union_all", "SELECT s_suppkey AS k, 's' AS kind FROM {supplier} UNION ALL SELECT p_partkey, 'p' FROM {part}")
sql_query("o08_union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql_query("o09_except_all", "SELECT count(*) AS differences FROM (SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_linenumber >= 2)")
sql_query("o10_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}")
sql_query("o11_distinct", "SELECT DISTINCT channel_id, state FROM {ev}")
sql_query("o12_replace_subset", "SELECT event_id, value FROM {events} LEFT ANTI JOIN (SELECT event_id AS k FROM {events} WHERE event_id % 9 = 0) ON event_id = k UNION ALL SELECT event_id, -value FROM {events} WHERE event_id % 9 = 0", "SELECT event_id, value FROM {events} ANTI JOIN (SELECT event_id AS k FROM {events} WHERE event_id % 9 = 0) ON event_id = k UNION ALL SELECT event_id, -value FROM {events} WHERE event_id % 9 = 0")

# Scalar functions.
sql_query("x11_list_operations", "SELECT row_id, array_join(a, ',') AS flags, size(a) AS n, array_contains(a, 'alarm') AS has_alarm, coalesce(arrays_overlap(a, array('high', 'low')), false) AS has_level FROM (SELECT row_id, array_sort(concat(CASE WHEN alarm THEN array('alarm') ELSE CAST(array() AS ARRAY<STRING>) END, CASE WHEN value > 80 THEN array('high') ELSE CAST(array() AS ARRAY<STRING>) END)) AS a FROM {ev})", "SELECT row_id, array_to_string(a, ',') AS flags, CAST(len(a) AS INT) AS n, list_contains(a, 'alarm') AS has_alarm, list_has_any(a, ['high', 'low']) AS has_level FROM (SELECT row_id, list_sort(list_concat(CASE WHEN alarm THEN ['alarm'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN value > 80 THEN ['high'] ELSE CAST([] AS VARCHAR[]) END)) AS a FROM {ev})")
sql_query("x13_date_parts", "SELECT row_id, year(ts) AS y, month(ts) AS m, date_trunc('DAY', ts) AS d, date_format(ts, 'yyyy-MM') AS ym, ts + INTERVAL '24' HOUR AS later FROM {ev}", "SELECT row_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, strftime(ts, '%Y-%m') AS ym, ts + INTERVAL '24' HOUR AS later FROM {ev}")
sql_query("x14_seconds_between", "SELECT row_id, CAST(timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts) AS DOUBLE) / 1000000 AS seconds FROM {ev}", "SELECT row_id, date_diff('microsecond', date_trunc('day', ts), ts) / 1000000.0::DOUBLE AS seconds FROM {ev}")
sql_query("x15_strings", "SELECT c_custkey, element_at(split(c_name, '#'), -1) AS last_part, replace(c_name, '#', '/') AS path, substring(c_name, 1, 4) AS head FROM {customer}", "SELECT c_custkey, split_part(c_name, '#', -1) AS last_part, replace(c_name, '#', '/') AS path, substring(c_name, 1, 4) AS head FROM {customer}")
sql_query("x16_hash_ids", "SELECT row_id, concat('episode-', substring(sha1(concat(channel_id, '|', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"))), 1, 16)) AS id FROM {ev}", "SELECT row_id, concat('episode-', substring(sha1(concat(channel_id, '|', strftime(ts, '%Y-%m-%dT%H:%M:%S'))), 1, 16)) AS id FROM {ev}")
sql_query("x17_greatest_skips_null", "SELECT row_id, greatest(CASE WHEN alarm THEN ts END, CASE WHEN value > 50 THEN ts - INTERVAL '1' HOUR END) AS evidence_at FROM {ev}")
sql_query("x18_math", "SELECT row_id, ceil(value) AS up, round(log1p(value), 9) AS l, round(exp(-value / 24), 9) AS freshness, round(sqrt(value), 9) AS root, round(sin(2 * pi() * hour(ts) / 24), 9) AS hour_sin FROM {ev}", "SELECT row_id, CAST(ceil(value) AS BIGINT) AS up, round(ln(1 + value), 9) AS l, round(exp(-value / 24), 9) AS freshness, round(sqrt(value), 9) AS root, round(sin(2 * pi() * hour(ts) / 24), 9) AS hour_sin FROM {ev}")
sql_query("x19_finite", "SELECT row_id, coalesce(NOT isnan(v) AND abs(v) <> double('infinity'), false) AS finite FROM (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN double('NaN') WHEN row_id % 5 = 1 THEN double('infinity') WHEN row_id % 5 = 2 THEN NULL ELSE value END AS v FROM {ev})", "SELECT row_id, coalesce(isfinite(v), false) AS finite FROM (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN row_id % 5 = 1 THEN 'infinity'::DOUBLE WHEN row_id % 5 = 2 THEN NULL ELSE value END AS v FROM {ev})")
sql_query("x20_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, get_json_object(props, '$.absent') AS absent FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.absent') AS absent FROM {events}")
sql_query("x21_nullable_bool", "SELECT c_custkey, coalesce(CAST(CASE WHEN t IN ('true', '1', 'yes', 'да') THEN true WHEN t IN ('false', '0', 'no', 'нет') THEN false END AS VARCHAR(5)), 'unknown') AS b FROM (SELECT c_custkey, lower(CASE c_custkey % 5 WHEN 0 THEN 'Да' WHEN 1 THEN 'НЕТ' WHEN 2 THEN '1' WHEN 3 THEN 'False' ELSE '?' END) AS t FROM {customer})")
sql_query("x22_maps", "SELECT event_id, array_join(map_keys(map_filter(map('f24', value, 'f168', value - 50), (k, v) -> v > 0)), ',') AS terms FROM {events}", "SELECT event_id, concat_ws(',', CASE WHEN value > 0 THEN 'f24' END, CASE WHEN value - 50 > 0 THEN 'f168' END) AS terms FROM {events}")
sql_query("x12_ordered_distinct", "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(f, o_orderpriority))), x -> x.o_orderpriority), ',') AS seen FROM (SELECT o_custkey, o_orderpriority, min(struct(o_orderdate, o_orderkey)) AS f FROM {orders} GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY f) AS seen FROM (SELECT o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) AS f FROM {orders} GROUP BY 1, 2) GROUP BY o_custkey")

# Further constructs.
sql_query("z01_value_bands", "SELECT CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS band, count(*) AS n FROM {ev} GROUP BY CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END")
sql_query("z02_category_rows", "SELECT category, count(*) AS n FROM (SELECT explode(concat(transform(array(state), x -> concat('state:', x)), CASE WHEN alarm THEN array('alarm') ELSE CAST(array() AS ARRAY<STRING>) END)) AS category FROM {ev}) GROUP BY category", "SELECT category, count(*) AS n FROM (SELECT unnest(list_concat(list_transform([state], lambda x: concat('state:', x)), CASE WHEN alarm THEN ['alarm'] ELSE CAST([] AS VARCHAR[]) END)) AS category FROM {ev}) GROUP BY category")
sql_query("z03_min_hash_row", "SELECT state, substring(md5(channel_id), 1, 1) AS bucket, min_by(row_id, md5(CAST(row_id AS STRING))) AS row_id FROM {ev} GROUP BY state, substring(md5(channel_id), 1, 1)", "SELECT state, substring(md5(channel_id), 1, 1) AS bucket, arg_min(row_id, md5(CAST(row_id AS VARCHAR))) AS row_id FROM {ev} GROUP BY 1, 2")
sql_query("z04_union_of_arrays", "SELECT channel_id, array_join(array_sort(collect_set(x)), ',') AS seen FROM (SELECT channel_id, explode(array(state, CASE WHEN alarm THEN 'alarm' ELSE 'calm' END)) AS x FROM {ev}) GROUP BY channel_id", "SELECT channel_id, array_to_string(list_sort(list_distinct(flatten(list([state, CASE WHEN alarm THEN 'alarm' ELSE 'calm' END])))), ',') AS seen FROM {ev} GROUP BY channel_id")
sql_query("z05_scalar_subqueries", "SELECT (SELECT count(*) FROM {orders}) AS orders, (SELECT max(ts) FROM {events}) AS last_at, (SELECT count(*) FROM {customer}) AS customers")
sql_query("z06_full_join_violations", "SELECT count(*) AS violations FROM (SELECT coalesce(a.k, b.k) AS k, a.n AS an, b.n AS bn FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey) b ON a.k = b.k) j LEFT JOIN {customer} c ON j.k = c.c_custkey WHERE NOT (an <=> bn) AND c_acctbal > 0", "SELECT count(*) AS violations FROM (SELECT coalesce(a.k, b.k) AS k, a.n AS an, b.n AS bn FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey) b ON a.k = b.k) j LEFT JOIN {customer} c ON j.k = c.c_custkey WHERE an IS DISTINCT FROM bn AND c_acctbal > 0")
sql_query("z07_guard_predicate", "SELECT count(*) AS violations FROM (SELECT ts, array(state, CASE WHEN alarm THEN 'alarm' END) AS a FROM {ev}) WHERE size(filter(a, x -> x NOT IN ('view', 'click'))) > 1 AND NOT (a <=> array('error', 'other')) AND ts > TIMESTAMP_NTZ '2024-01-10 00:00:00'", "SELECT count(*) AS violations FROM (SELECT ts, [state, CASE WHEN alarm THEN 'alarm' END] AS a FROM {ev}) WHERE len(list_filter(a, lambda x: coalesce(x NOT IN ('view', 'click'), false))) > 1 AND a IS DISTINCT FROM ['error', 'other'] AND ts > TIMESTAMP '2024-01-10 00:00:00'")
sql_query("z08_overlay", "SELECT f.event_id, CASE WHEN c.k IS NOT NULL THEN c.v ELSE f.value END AS value FROM {events} f LEFT JOIN (SELECT event_id AS k, CASE WHEN event_id % 14 = 0 THEN NULL ELSE value * 2 END AS v FROM {events} WHERE event_id % 7 = 0) c ON f.event_id = c.k")
sql_query("z09_closed_range_join", "SELECT e.row_id, w.k FROM {ev} e JOIN (SELECT CAST(c_custkey AS VARCHAR(20)) AS channel_id, c_custkey AS k FROM {customer}) w ON e.channel_id = w.channel_id AND e.ts BETWEEN TIMESTAMP_NTZ '2024-01-03 00:00:00' AND TIMESTAMP_NTZ '2024-01-04 00:00:00'", "SELECT e.row_id, w.k FROM {ev} e JOIN (SELECT CAST(c_custkey AS VARCHAR(20)) AS channel_id, c_custkey AS k FROM {customer}) w ON e.channel_id = w.channel_id AND e.ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00'")
sql_query("z10_ordered_lookup", "SELECT CAST(o.ordinal AS BIGINT) AS ordinal, o.o_orderkey, c.c_name FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM {orders}) o JOIN {customer} c ON o.o_custkey = c.c_custkey ORDER BY c.c_name, o.ordinal")
sql_query("z11_head_and_largest", "SELECT DISTINCT row_id FROM (SELECT row_id FROM (SELECT row_id FROM {ev} ORDER BY ts, row_id LIMIT 20) UNION ALL SELECT row_id FROM (SELECT row_id FROM {ev} ORDER BY value DESC, row_id LIMIT 20) UNION ALL SELECT row_id FROM (SELECT row_id FROM {ev} WHERE alarm ORDER BY ts, row_id LIMIT 20))")
sql_query("z13_admission_keys", "SELECT e.row_id FROM {ev} e JOIN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') c ON e.channel_id = CAST(c.c_custkey AS VARCHAR(20)) WHERE e.state IN ('error', 'signup') AND e.ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'", "SELECT e.row_id FROM {ev} e JOIN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') c ON e.channel_id = CAST(c.c_custkey AS VARCHAR(20)) WHERE e.state IN ('error', 'signup') AND e.ts < TIMESTAMP '2024-01-20 00:00:00'")
sql_query("z14_tolerance_compare", "SELECT count(*) AS n, count(CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 END) AS missing, count(CASE WHEN abs(a.v - b.v) > 0.005 THEN 1 END) AS different FROM (SELECT event_id AS k, value AS v FROM {events}) a FULL OUTER JOIN (SELECT event_id AS k, CASE WHEN event_id % 50 = 0 THEN value + 0.01 ELSE value + 0.001 END AS v FROM {events} WHERE event_id % 100 <> 1) b ON a.k = b.k")
sql_query("z17_per_second_co_occurrence", "SELECT hour, count(*) FILTER (WHERE n AND f) AS both, count(*) AS groups FROM (SELECT date_trunc('HOUR', ts) AS hour, channel_id, bool_or(state = 'signup') AS n, bool_or(alarm) AS f FROM {ev} GROUP BY date_trunc('HOUR', ts), channel_id) GROUP BY hour", "SELECT hour, count(*) FILTER (WHERE n AND f) AS both, count(*) AS groups FROM (SELECT date_trunc('hour', ts) AS hour, channel_id, bool_or(state = 'signup') AS n, bool_or(alarm) AS f FROM {ev} GROUP BY 1, 2) GROUP BY hour")
sql_query("z20_burst_drill_down", "SELECT hour(ts) AS h, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS d, count(*) AS n FROM {ev} WHERE alarm GROUP BY hour(ts), CAST(ts AS DATE) ORDER BY n DESC, d, h LIMIT 10", "SELECT CAST(hour(ts) AS INT) AS h, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS d, count(*) AS n FROM {ev} WHERE alarm GROUP BY hour(ts), CAST(ts AS DATE) ORDER BY n DESC, d, h LIMIT 10")
sql_query("z22_threshold_grid", "SELECT i, round(q, 6) AS q FROM (SELECT posexplode(percentile(value, array(0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999))) AS (i, q) FROM {ev})", "SELECT CAST(i - 1 AS INT) AS i, round(a[i], 6) AS q FROM (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]) AS a FROM {ev}), (SELECT unnest(generate_series(1, 7)) AS i)")
sql_query("z23_dictionary_audit", "SELECT count(*) AS n, count(*) - count(DISTINCT c_custkey) AS duplicates, count(CASE WHEN trim(c_name) = '' THEN 1 END) AS blanks, count(CASE WHEN trim(c_name) <> c_name THEN 1 END) AS padded, count(CASE WHEN NOT c_name RLIKE '^Customer#[0-9]+$' THEN 1 END) AS odd FROM {customer}", "SELECT count(*) AS n, count(*) - count(DISTINCT c_custkey) AS duplicates, count(CASE WHEN trim(c_name) = '' THEN 1 END) AS blanks, count(CASE WHEN trim(c_name) <> c_name THEN 1 END) AS padded, count(CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]+') THEN 1 END) AS odd FROM {customer}")
sql_query("z24_field_comparison", "SELECT count(*) AS n, count(CASE WHEN a.event_type <=> b.event_type THEN 1 END) AS same_type, count(CASE WHEN a.value <=> b.value THEN 1 END) AS same_value FROM {events} a JOIN (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM {events}) b ON a.event_id = b.event_id", "SELECT count(*) AS n, count(CASE WHEN a.event_type IS NOT DISTINCT FROM b.event_type THEN 1 END) AS same_type, count(CASE WHEN a.value IS NOT DISTINCT FROM b.value THEN 1 END) AS same_value FROM {events} a JOIN (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM {events}) b ON a.event_id = b.event_id")
sql_query("z25_time_format", "SELECT count(*) AS n, count(CASE WHEN date_format(ts, 'HH:mm:ss') RLIKE '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$' THEN 1 END) AS good FROM {ev}", "SELECT count(*) AS n, count(CASE WHEN regexp_full_match(strftime(ts, '%H:%M:%S'), '[0-2][0-9]:[0-5][0-9]:[0-5][0-9]') THEN 1 END) AS good FROM {ev}")
sql_query("z26_days_with_any", "SELECT channel_id, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE alarm) AS days FROM {ev} GROUP BY channel_id")
sql_query("z28_ctes", "WITH a AS (SELECT channel_id, count(*) AS n FROM {ev} GROUP BY channel_id), b AS (SELECT avg(n) AS m FROM a) SELECT a.channel_id FROM a, b WHERE a.n > b.m")
sql_query("z30_cast_validation", "SELECT count(*) AS n, count(try_cast(trim(s) AS DOUBLE)) AS numeric FROM (SELECT CASE WHEN event_id % 4 = 0 THEN ' 12.5 ' WHEN event_id % 4 = 1 THEN 'x' ELSE CAST(event_id AS VARCHAR(20)) END AS s FROM {events})")
sql_query("z31_negative_sampling", "SELECT e.row_id, e.alarm FROM {ev} e JOIN (SELECT c_custkey, c_mktsegment FROM {customer}) c ON e.channel_id = CAST(c.c_custkey AS VARCHAR(20)) AND NOT (c.c_mktsegment <=> 'FURNITURE') WHERE e.alarm OR substring(md5(CAST(e.row_id AS VARCHAR(20))), 1, 1) = '0'", "SELECT e.row_id, e.alarm FROM {ev} e JOIN (SELECT c_custkey, c_mktsegment FROM {customer}) c ON e.channel_id = CAST(c.c_custkey AS VARCHAR(20)) AND c.c_mktsegment IS DISTINCT FROM 'FURNITURE' WHERE e.alarm OR substring(md5(CAST(e.row_id AS VARCHAR(20))), 1, 1) = '0'")
