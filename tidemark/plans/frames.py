"""Filters, projections, joins, unions, sorts and scalar functions over the supplied tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import curves, dates, nulls, text
from ..operators import aggs, filters, joins, sets, sorting, windows
from ..sources import export
from .registry import query, round_all, rounded


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag IS DISTINCT FROM 'N' AND l_linestatus IN ('O', 'F')
AND l_shipdate >= TIMESTAMP '1996-01-01' AND (l_discount NOT IN (0.05) OR l_discount IS NULL)""")
def filter_tuples(t):
    rules = [("l_quantity", "between", (10, 30)), [("l_returnflag", "!=", "N"), ("l_linestatus", "in", ["O", "F"])], ("l_shipdate", ">=", "1996-01-01"), ("l_discount", "not in", [0.05])]
    return filters.filter_frame(t.lineitem, rules).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("""WITH x AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') s, o_totalprice p FROM orders)
SELECT o_orderkey, coalesce(s = 'F', false) AND coalesce(p > 100000, false) AS _scorable,
concat_ws(', ', CASE WHEN NOT coalesce(s = 'F', false) THEN 's == F' END, CASE WHEN NOT coalesce(p > 100000, false) THEN 'p > 100000' END) AS _skip_reason FROM x""")
def filter_tagging(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_totalprice").alias("p"))
    return filters.tag_rows(df, [("s", "==", "F"), ("p", ">", 100000), ("absent", "==", 1)]).select("o_orderkey", "_scorable", "_skip_reason")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) lo, quantile_cont(l_extendedprice, 0.95) hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS clipped FROM lineitem, q""")
def clip_quantile(t):
    rules = filters.learn_clips(t.lineitem, [filters.Clip("l_extendedprice", lower_q=0.05, upper_q=0.95, output="clipped")])
    return filters.apply_clips(t.lineitem, rules).select("l_orderkey", "l_linenumber", rounded("clipped", 4).alias("clipped"))


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'high' END AS tier,
CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 END AS tier_idx FROM part""")
def category_mapping(t):
    m = filters.Category("p_type", "tier", ["low", "high"], {"ECONOMY": "low", "PROMO": "high"})
    return filters.map_categories(t.part, [m]).select("p_partkey", "tier", F.col("tier_idx").cast("int").alias("tier_idx"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * l_tax, 4) AS tax FROM lineitem""")
def feature_rules(t):
    rules = [filters.FeatureRule(["l_extendedprice", "l_discount", "l_tax"], ["net", "tax"], lambda p, d, x: [p * (1 - d), p * x])]
    return round_all(filters.generate_features(t.lineitem, rules).select("l_orderkey", "l_linenumber", "net", "tax"), 4)


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(event_type AS DOUBLE) AS bad, CAST(ts AS DATE) AS day FROM events""")
def coerce_types(t):
    df = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"), F.col("ts").alias("day"))
    return filters.coerce_types(df, {"k": "int", "bad": "float", "day": "date"})


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, round(least(greatest(l_quantity, lo), hi), 6) AS bounded FROM
(SELECT *, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 5.0 WHEN l_returnflag = 'R' THEN 10.0 WHEN l_linestatus = 'O' THEN 2.0 ELSE 1.0 END lo,
CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 20.0 WHEN l_returnflag = 'R' THEN 30.0 WHEN l_linestatus = 'O' THEN 40.0 ELSE 45.0 END hi FROM lineitem)""")
def cap_floor_rules(t):
    rows = [("l_quantity", "A", "F", 5.0, 20.0), ("l_quantity", "R", "*", 10.0, 30.0), ("l_quantity", "*", "O", 2.0, 40.0), ("l_quantity", "*", "*", 1.0, 45.0)]
    rules = t.spark.createDataFrame(rows, "feature string, l_returnflag string, l_linestatus string, floor double, cap double")
    # Dimensions rank by name: the line status is the first, so its exact rules win over those of the flag alone.
    rules = rules.select("feature", F.col("l_returnflag").alias("a_flag"), F.col("l_linestatus").alias("b_status"), "floor", "cap")
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.col("l_returnflag").alias("a_flag"), F.col("l_linestatus").alias("b_status"))
    return joins.cap_floor(df, rules, "l_quantity", ["a_flag", "b_status"], "bounded").select("l_orderkey", "l_linenumber", "l_returnflag", rounded("bounded").alias("bounded"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE false OR l_orderkey % 100 IN (0, 7)""")
def filter_callable(t):
    return filters.filter_frame(t.lineitem, [("l_orderkey", "f", lambda c: (c % 100).isin(0, 7))]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""WITH r AS (SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'P' || (o_orderkey % 3000) WHEN 1 THEN 'S' || (o_orderkey % 200) WHEN 2 THEN 'BAD' || (o_orderkey % 7) ELSE 'X' || o_orderkey END AS id FROM orders),
k AS (SELECT id, min(struct_pack(rank := rank, target := target)).target AS key FROM (
SELECT 'P' || p_partkey id, 0 rank, p_name target FROM part UNION ALL SELECT 'S' || s_suppkey, 1, s_name FROM supplier) GROUP BY id)
SELECT pos, r.id, k.key, CASE WHEN k.key IS NOT NULL THEN 'Success' WHEN r.id LIKE 'BAD%' THEN 'Invalid' ELSE 'NotFound' END AS status FROM r LEFT JOIN k ON r.id = k.id""")
def id_resolve_mixed(t):
    o = F.col("o_orderkey")
    say = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    ids = t.orders.select(o.alias("pos"), F.when(o % 4 == 0, say("P", o % 3000)).when(o % 4 == 1, say("S", o % 200)).when(o % 4 == 2, say("BAD", o % 7)).otherwise(say("X", o)).alias("id"))
    parts = t.part.select(say("P", F.col("p_partkey")).alias("a"), F.lit(None).cast("string").alias("b"), F.col("p_name").alias("key"))
    table = parts.unionByName(t.supplier.select(F.lit(None).cast("string").alias("a"), say("S", F.col("s_suppkey")).alias("b"), F.col("s_name").alias("key")))
    bad = ids.where(F.col("id").startswith("BAD")).select("id").distinct()
    return joins.resolve_mixed(ids, table, ["a", "b"], "key", bad)


@query("""SELECT o_orderkey AS pos, o_custkey AS id, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey""")
def id_lookup(t):
    ids = t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return joins.lookup(ids, t.customer.withColumn("c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name"))), "c_custkey", "c_name")


@query("""SELECT o_orderkey AS pos, CAST(o_custkey AS VARCHAR) AS id, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey) OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = o_custkey) AS "exists" FROM orders""")
def id_exists(t):
    ids = t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("id"))
    known = t.supplier.select(F.col("s_suppkey").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(t.nation.select(F.lit(None).cast("bigint").alias("a"), F.col("n_nationkey").cast("bigint").alias("b")))
    return joins.exist_flags(ids, known, ["a", "b"])


@query("""WITH s AS (SELECT c_custkey + 700 AS c_custkey, c_name || '!' AS c_name, c_acctbal * 2 AS c_acctbal FROM customer)
SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE c.c_name END AS c_name,
round(CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE c.c_acctbal END, 4) AS c_acctbal, c.c_mktsegment FROM customer c FULL JOIN s ON c.c_custkey = s.c_custkey""")
def upsert_mappings(t):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = t.customer.select((F.col("c_custkey") + 700).alias("c_custkey"), F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return joins.upsert(base, new, ["c_custkey"]).withColumn("c_acctbal", rounded("c_acctbal", 4))


@query("""SELECT count(*) FILTER (WHERE c_custkey + 700 NOT IN (SELECT c_custkey FROM customer)) AS inserted, count(*) FILTER (WHERE c_custkey + 700 IN (SELECT c_custkey FROM customer)) AS updated FROM customer""")
def upsert_counts(t):
    return joins.upsert_counts(t.customer, t.customer.select((F.col("c_custkey") + 700).alias("c_custkey")), ["c_custkey"])


@query("""SELECT n_nationkey AS k FROM nation UNION ALL SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)""")
def insert_ignore(t):
    base = t.nation.select(F.col("n_nationkey").cast("long").alias("k"))
    return joins.insert_ignore(base, t.customer.select(F.col("c_custkey").alias("k")).union(t.customer.select("c_custkey")), ["k"])


@query("""WITH b AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, b.event_id AS last_purchase, round(b.value, 6) AS last_value FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts WHERE e.event_type = 'view'""")
def asof_last_state(t):
    left = t.events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_purchase"), F.col("value").alias("last_value"))
    out = joins.as_of(left, right, ["user_id"], "ts", "at", ["last_purchase", "last_value"], slices="week")
    return round_all(out.select("event_id", "user_id", "last_purchase", "last_value"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) d, max(value) v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
a AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')
SELECT event_id, round(v * exp(-ln(2) / 10 * date_diff('day', d, day)), 6) AS v FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.day >= b.d""")
def asof_decayed(t):
    day = F.to_date("ts")
    right = t.events.where("event_type = 'purchase'").groupBy("user_id", day.alias("d")).agg(F.max("value").alias("v"))
    left = t.events.where("event_type = 'error'").select("event_id", "user_id", day.alias("day"))
    return round_all(joins.as_of_decayed(left, right, ["user_id"], "day", "d", "v", 10).select("event_id", "v"))


_CAL = "WITH e AS (SELECT *, CAST(ts AS DATE) d FROM events), c AS (SELECT d, row_number() OVER (ORDER BY d) rk FROM (SELECT DISTINCT d FROM e)), m AS (SELECT max(rk) top FROM c)"


@query(_CAL + """ SELECT r.d AS run_date, count(*) AS n, round(avg(value), 6) AS mean, min(e.d) AS first_day FROM c r, m, c x, e WHERE r.rk >= 5 AND r.rk < top AND x.rk BETWEEN r.rk - 4 AND r.rk AND e.d = x.d GROUP BY 1""")
def rolling_window_band(t):
    df = t.events.withColumn("d", F.to_date("ts")).select("d", "value")
    out = joins.rolling_windows(df, "d", 5).groupBy("run_date").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("d").alias("first_day"))
    return round_all(out)


@query(_CAL + """ SELECT r.d AS run_date, x.d AS d, count(*) AS n, round(sum(value), 4) AS total FROM c r, c x, e WHERE x.rk = r.rk + 1 AND r.rk >= 3 AND e.d = x.d GROUP BY 1, 2""")
def next_day_pairs(t):
    df = t.events.withColumn("d", F.to_date("ts")).select("d", "value")
    return round_all(joins.next_day_rows(df, "d", 3).groupBy("run_date", "d").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("""SELECT round(avg(b) - avg(a), 6) AS shift FROM (SELECT o_custkey k, avg(o_totalprice) a FROM orders GROUP BY 1) JOIN (SELECT c_custkey k, c_acctbal b FROM customer) USING (k)""")
def constant_shift(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("a"))
    return round_all(joins.constant_shift(a, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b")), ["k"], "a", "b"))


@query("""SELECT n_nationkey, unnest(range(0, n_regionkey + 1)) AS period FROM nation""")
def expand_periods(t):
    return joins.expand_periods(t.nation, "n_regionkey").select("n_nationkey", F.col("period").cast("long").alias("period"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id q_id, p.vec_id p_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE), 2)))) dist FROM q, embeddings p)
SELECT q_id, p_id, round(dist, 6) AS distance, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9), p_id) - 1 AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(dist, 9), p_id) <= 5""")
def knn_neighbors(t):
    e = t.embeddings
    out = joins.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", "embedding", 5)
    return out.select("q_id", "p_id", rounded("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("""SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation""")
def stack(t):
    return sets.stack([t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))])


@query("""SELECT r_regionkey AS k, r_name AS name, NULL AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def concat_align(t):
    return sets.concat([t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("parent"))])


@query("""(SELECT 'common' AS kind, c_custkey AS k FROM customer INTERSECT SELECT 'common', o_custkey FROM orders) UNION ALL (SELECT 'missing', c_custkey FROM customer EXCEPT SELECT 'missing', o_custkey FROM orders)""")
def setops(t):
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    return sets.common_keys(a, b, ["k"]).select(F.lit("common").alias("kind"), "k").unionByName(sets.missing_keys(a, b, ["k"]).select(F.lit("missing").alias("kind"), "k"))


@query("""(SELECT 'both' AS kind, n_regionkey AS k FROM nation INTERSECT ALL SELECT 'both', r_regionkey FROM region) UNION ALL (SELECT 'rest', n_regionkey FROM nation EXCEPT ALL SELECT 'rest', r_regionkey FROM region)""")
def setops_all(t):
    a, b = t.nation.select(F.col("n_regionkey").alias("k")), t.region.select(F.col("r_regionkey").alias("k"))
    return sets.intersect_all(a, b).select(F.lit("both").alias("kind"), "k").unionByName(sets.except_all(a, b).select(F.lit("rest").alias("kind"), "k"))


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS place FROM orders""")
def sort_hierarchy(t):
    order = ["1-URGENT", "5-LOW", "3-MEDIUM"]
    out = sorting.sort_by_hierarchy(t.orders, {"o_orderpriority": order}, ["o_orderkey", "o_orderpriority"])
    return out.select("o_orderkey", "o_orderpriority", sorting.category_key("o_orderpriority", order).cast("int").alias("place"))


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25""")
def topk_abs(t):
    return aggs.top_by_size(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 25, "c_custkey")


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate END AS DATE) AS day FROM orders""")
def parse_dates(t):
    o = F.col("o_orderkey")
    raw = F.when(o % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(o % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("n/a"))
    return t.orders.select("o_orderkey", dates.parse_date(raw).alias("day"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) d FROM orders)
SELECT o_orderkey, d + CAST((5 - dayofweek(d) + 7) % 7 AS INTEGER) AS friday, last_day(d) AS month_end, CAST(floor(date_diff('day', DATE '1995-01-01', d) / 7.0) AS BIGINT) AS weeks, strftime(d, '%Y/%m') AS ym, CAST(year(d) AS INTEGER) AS vintage FROM x""")
def date_tricks(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.next_friday(d).alias("friday"), dates.month_end(d).alias("month_end"), dates.weeks_between(d, F.lit("1995-01-01").cast("date")).alias("weeks"), dates.date_text(d, "%Y/%m").alias("ym"), dates.year_of(d).alias("vintage"))


@query("""SELECT c_custkey, format('{:,.2f}', c_acctbal) AS money, printf('%.4f', c_acctbal / 100) || '%' AS pct FROM customer""")
def number_formats(t):
    return t.customer.select("c_custkey", text.number_format("c_acctbal").alias("money"), text.number_format(F.col("c_acctbal") / 10000, 4, False, True).alias("pct"))


@query("""SELECT event_id, to_json({'event_id': event_id, 'safe': CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END, 'type': event_type}) AS js, value AS strict FROM events""")
def json_rows(t):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    df = t.events.withColumn("safe", text.json_safe(v)).withColumn("type", F.col("event_type"))
    return df.select("event_id", text.to_json("event_id", "safe", "type").alias("js"), text.strict_number("value").alias("strict"))


@query("""SELECT l_orderkey, l_linenumber, round(least(l_quantity, 10.0), 6) AS r0, round(least(greatest(l_quantity, 10), 30) - 10, 6) AS r1, round(greatest(l_quantity, 30) - 30, 6) AS r2, CAST(l_quantity BETWEEN 10 AND 30 AS DOUBLE) AS d1 FROM lineitem""")
def flat_ramp(t):
    cols = curves.flat_ramps("l_quantity", [10, 30], dummies=[1])
    return round_all(t.lineitem.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(cols, ("r0", "r1", "r2", "d1"), strict=True)]))


@query("""SELECT p_partkey, round(0.1 + 0.8 / (1 + exp(-0.3 * (p_size - 25))), 6) AS sig, round(2 - 1.5 * exp(-0.1 * p_size), 6) AS plateau,
round(1 + 2 * exp(-pow(p_size / 10.0, 0.7)), 6) AS stretched, round(5 * pow(p_size, 2) / (pow(20, 2) + pow(p_size, 2)), 6) AS hill, round(0.5 + CASE WHEN p_size < 25 THEN 0.01 ELSE 0.02 END * pow(p_size - 25, 2), 6) AS quad FROM part""")
def param_curves(t):
    x = F.col("p_size").cast("double")
    return round_all(t.part.select("p_partkey", curves.sigmoid(x, 0.1, 0.9, 0.3, 25).alias("sig"), curves.exponential_plateau(x, 0.5, 2.0, 0.1).alias("plateau"), curves.stretched_exponential(x, 1.0, 2.0, 10.0, 0.7).alias("stretched"), curves.hill(x, 5.0, 20.0, 2.0).alias("hill"), curves.asymmetric_quadratic(x, 25, 0.01, 0.02, 0.5).alias("quad")))


@query("""SELECT p_partkey, round(CAST(CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 20 THEN 1 + (p_size - 10) * 0.2 WHEN p_size <= 40 THEN 3 - (p_size - 20) * 0.1 ELSE 1.0 END AS DOUBLE), 6) AS flat FROM part""")
def curve_eval(t):
    return round_all(t.part.select("p_partkey", curves.interpolate("p_size", [10, 20, 40], [1.0, 3.0, 1.0]).alias("flat")))


@query("""WITH z AS (SELECT p_partkey, (least(greatest(p_size, 5), 45) - 5) / 40.0 z FROM part)
SELECT p_partkey, round(0.2 + 0.5 * z + 1.5 * greatest(z - 0.3, 0) - 2 * greatest(z - 0.7, 0), 6) AS h FROM z""")
def hinge_eval(t):
    return round_all(t.part.select("p_partkey", curves.hinge(F.col("p_size").cast("double"), 5, 45, 0.2, 0.5, [0.3, 0.7], [1.5, -2.0]).alias("h")))


@query("""SELECT l_orderkey, l_linenumber, round(1 - pow(1 - l_discount, 12), 6) AS cpr, round(l_discount * 12, 6) AS yearly, round(ln((l_discount + 0.01) / (0.99 - l_discount)), 6) AS logit FROM lineitem""")
def unit_transforms(t):
    d = F.col("l_discount")
    return round_all(t.lineitem.select("l_orderkey", "l_linenumber", curves.cpr(d).alias("cpr"), curves.annualized(d).alias("yearly"), curves.logit(d + 0.01).alias("logit")))


@query("""SELECT 's__price__by__' || c_mktsegment AS term, 'price' AS feature, c_mktsegment AS level, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def term_names(t):
    df = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("term", text.term_name("s", "price", by="segment", level="c_mktsegment"))
    p = text.parse_term("term")
    return df.select(F.replace("term", F.lit("segment__"), F.lit("")).alias("term"), p["features"][0].alias("feature"), p["level"].alias("level"), "n")


@query("""SELECT '<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>' AS html FROM region""")
def html_rows(t):
    return t.region.select(export.html_rows(t.region).alias("html"))


@query("""SELECT c_custkey, decrypted FROM (SELECT c_custkey, c_name AS decrypted FROM customer)""")
def encrypt_roundtrip(t):
    key = F.lit("0123456789abcdef")
    return t.customer.select("c_custkey", text.decrypt(text.encrypt("c_name", key), key).alias("decrypted"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer""")
def drop_duplicate_columns(t):
    wide = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("x")).toDF("c_custkey", "c_name", "c_acctbal", "c_name")
    return filters.drop_duplicate_columns(wide)


@query("""SELECT max(d) AS last_day, count(DISTINCT d) AS days, CAST(max(idx) AS BIGINT) AS top FROM (SELECT CAST(ts AS DATE) d, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 idx FROM events)""")
def date_index(t):
    days = t.events.select(F.to_date("ts").alias("d"))
    known = windows.date_index(days.where(F.col("d") < dt.date(2024, 1, 10)), "d")
    return windows.date_index(days, "d", known).agg(F.max("d").alias("last_day"), F.count("*").alias("days"), F.max("idx").cast("bigint").alias("top"))


@query("""SELECT c_mktsegment, count(*) FILTER (WHERE NOT (b IS NULL)) AS present, count(*) FILTER (WHERE b IS DISTINCT FROM 0) AS not_zero FROM (SELECT c_mktsegment, nullif(c_nationkey, 3) b FROM customer) GROUP BY 1""")
def null_rules(t):
    df = t.customer.select("c_mktsegment", F.nullif("c_nationkey", F.lit(3)).cast("double").alias("b"))
    df = df.withColumn("b", nulls.clean(F.when(F.col("b").isNull(), F.lit(float("nan"))).otherwise(F.col("b"))))
    return df.groupBy("c_mktsegment").agg(F.count("b").alias("present"), F.count(F.when(nulls.ne("b", 0.0), 1)).alias("not_zero"))
