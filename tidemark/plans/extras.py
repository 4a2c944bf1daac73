"""Further operators over the supplied tables: weights, folds, curves, checks, registries and layered models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, curves, dates, text
from ..models import gam, linear, product, spread
from ..operators import aggs, filters, folds, joins, ledger, smoothing, windows
from .registry import query, round_all, rounded, rounded_scaled

U, O = ["user_id"], ["ts", "event_id"]
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query("""SELECT o_orderkey, round(1 / (1 + exp(0.01 * (date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) - 365))), 6) AS weight FROM orders""")
def recency_weights(t):
    return round_all(windows.recency_weights(t.orders, "o_orderdate", 0.01, 365).select("o_orderkey", "weight"))


@query(f"""WITH x AS (SELECT event_id, user_id, ts, value, value / lag(value) {_W}) - 1 r FROM events)
SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN -1 ELSE 0 END * r, 6) AS strategy_return FROM x""")
def strategy_returns(t):
    pos = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, -1).otherwise(0)
    out = windows.strategy_returns(t.events.withColumn("pos", pos), "pos", "value", U, O)
    return out.select("event_id", (rounded_scaled("strategy_return") + 0.0).alias("strategy_return"))


@query("""SELECT c_mktsegment, c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) AS c_acctbal FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def standardized(t):
    return round_all(windows.standardize(t.customer, ["c_acctbal"], ["c_mktsegment"]).select("c_mktsegment", "c_custkey", "c_acctbal"))


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 4) AS prediction FROM orders GROUP BY 1""")
def group_mean_model(t):
    fitted = linear.group_means(t.orders, ["o_orderpriority"], "o_totalprice")
    return linear.predict_group_means(t.orders.select("o_orderpriority").distinct(), fitted, ["o_orderpriority"]).select("o_orderpriority", rounded("prediction", 4).alias("prediction"))


@query("""SELECT round(avg(o_totalprice), 4) AS prediction FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def last_value_model(t):
    return round_all(folds.last_value(t.orders, "o_orderdate", "o_totalprice"), 4)


@query("""SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS "min", max(o_totalprice) AS "max", round(max(o_totalprice) - min(o_totalprice), 4) AS "range" FROM orders GROUP BY 1""")
def curve_summary(t):
    return round_all(aggs.curve_summary(t.orders, ["o_orderstatus"], "o_totalprice"), 4)


@query("""SELECT n_nationkey AS k, min(n_name) AS name FROM nation GROUP BY 1""")
def key_mapping(t):
    return aggs.mapping(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k", "name")


@query("""SELECT 'status' AS name, (SELECT bool_and(o_orderstatus IN ('F', 'O', 'P')) FROM orders) AS ok UNION ALL SELECT 'flag', (SELECT bool_and(l_returnflag IN ('A', 'N')) FROM lineitem) UNION ALL SELECT 'sorted', (SELECT bool_and(p <= event_id) FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) p FROM events)) UNION ALL SELECT 'range', true""")
def value_checks(t):
    say = lambda n, d: d.select(F.lit(n).alias("name"), "ok")
    parts = [say("status", checks.only_values(t.orders, "o_orderstatus", ["F", "O", "P"])), say("flag", checks.only_values(t.lineitem, "l_returnflag", ["A", "N"])), say("sorted", checks.is_sorted(t.events, U, ["ts"], "event_id")), say("range", checks.is_range(t.nation, "n_nationkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN printf('%d', 0) ELSE '' END AS t0, CASE WHEN p_retailprice >= 1000 THEN regexp_replace(regexp_replace(printf('%.2f', p_retailprice / 1000), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || 'K' ELSE regexp_replace(regexp_replace(printf('%.2f', p_retailprice), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END AS human FROM part WHERE p_partkey % 10 = 0 OR true""")
def human_numbers(t):
    p = F.col("p_retailprice")
    return t.part.select("p_partkey", F.when(p < 1000, "0").otherwise("").alias("t0"), text.human_number(F.round(p, 2)).alias("human"))


@query("""SELECT p_partkey, round(1 / (1 + exp(-(p_size - 10) / 2.0)) * 1 / (1 + exp(-(40 - p_size) / 2.0)), 6) AS bump, round(1 / (1 + exp(-(p_size - 25) / 3.0)), 6) AS gate FROM part""")
def bumps_and_gates(t):
    x = F.col("p_size").cast("double")
    return round_all(t.part.select("p_partkey", curves.bump(x, 10, 40, 2).alias("bump"), curves.gate(x, 25, 3).alias("gate")))


@query("""WITH k AS (SELECT p_partkey, least(greatest(CAST(p_size AS DOUBLE), 0), 50) x FROM part)
SELECT p_partkey, round(CASE WHEN x <= 10 THEN 0 + x * (m0 + x * ((3 * 0.1 - 2 * m0 - m1) / 10 + x * (m0 + m1 - 0.2) / 100)) ELSE 1 + (x - 10) * (m1 + (x - 10) * ((3 * 0.025 - 2 * m1 - m2) / 40 + (x - 10) * (m1 + m2 - 0.05) / 1600)) END, 6) AS y
FROM k, (SELECT ((2 * 10 + 40) * 0.1 - 10 * 0.025) / 50 m0, (60 + 90) / (90 / 0.1 + 60 / 0.025) m1, 0.0 m2)""")
def pchip_eval(t):
    return round_all(t.part.select("p_partkey", curves.pchip("p_size", [0.0, 10.0, 50.0], [0.0, 1.0, 2.0]).alias("y")))


@query("""SELECT c_custkey, CAST(o_orderdate AS DATE) AS "first" FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) o_orderdate FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def align_series(t):
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("first"))
    both = joins.align(t.customer.select("c_custkey"), first, ["c_custkey"])
    return both.unionByName(t.customer.select("c_custkey").join(first, "c_custkey", "left_anti").withColumn("first", F.lit(None).cast("date")))


@query("""SELECT event_id, event_type, round(value, 6) AS value, CAST(ts AS DATE) AS day, CAST(year(ts) AS INTEGER) AS vintage FROM events WHERE event_type IN ('view', 'click')""")
def role_projection(t):
    rows = filters.filter_frame(t.events, [("event_type", "in", ["view", "click"])])
    return rows.select("event_id", "event_type", rounded("value").alias("value"), F.to_date(dates.midnight("ts")).alias("day"), dates.year_of("ts").alias("vintage"))


@query("""SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) < 1288490188""")
def hash_sample(t):
    """Three in ten rows by the place of their hashed id."""
    return filters.sample_fraction(t.events, 0.3, "event_id").select("event_id", "event_type")


@query("""SELECT l_orderkey, l_linenumber, round((1 + 0.01 * least(l_quantity, 20)) * (2 - l_discount) * 3 * CASE l_returnflag WHEN 'A' THEN 0.5 ELSE 1 END, 6) AS prediction FROM lineitem""")
def product_scoring(t):
    """Scores of a product model with given coefficients."""
    import numpy as np

    m = product.ProductModel([product.Block("q", lambda: [F.lit(1.0), F.least("l_quantity", F.lit(20.0))]), product.Block("d", lambda: [F.lit(1.0), F.col("l_discount")])], scalar=3.0, fixed={"flag": F.when(F.col("l_returnflag") == "A", 0.5).otherwise(1.0)})
    m.coefficients = {"q": {None: np.array([1, 0.01])}, "d": {None: np.array([2, -1.0])}}
    return t.lineitem.select("l_orderkey", "l_linenumber", rounded(m.column()).alias("prediction"))


@query("""WITH x AS (SELECT p_partkey, p_type, p_size - 1.0 a, p_size - 25.0 b FROM part),
m AS (SELECT (73 / 24.0 + 24 * 0.02) / 49 m0, (-74 * 0.02 - 25 / 24.0) / 49 m2),
c AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0.25 WHEN 'PROMO' THEN -0.5 ELSE 0 END f, CASE WHEN b <= 0 THEN a * (m0 + a * ((3 / 24.0 - 2 * m0) / 24 + a * (m0 - 2 / 24.0) / 576)) ELSE 1 + b * b * ((-0.06 - m2) / 25 + b * (m2 + 0.04) / 625) END s FROM x, m)
SELECT p_partkey, round(s, 6) AS s__p_size, round(f, 6) AS f__p_type, round(0.5 + s + f, 6) AS pred FROM c""")
def gam_decompose(t):
    """Replay of an exported curve and a factor, term by term."""
    r = gam.Replay([gam.Term("spline", "p_size", [1.0, 25.0, 50.0], [0.0, 1.0, 0.5]), gam.Term("factor", "p_type", levels={"ECONOMY": 0.25, "PROMO": -0.5})], 0.5)
    return round_all(r.decompose(t.part).select("p_partkey", "s__p_size", "f__p_type", "pred"))


@query()
def layered_spread(t):
    """A layered model of event values by hour, with users as keys and types as buckets."""
    df = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), F.hour("ts").cast("double").alias("hour"), "value")
    cfg = spread.Config("value", "user_id", "day", "hour", "event_type", 0, 23, monotone=0, width=3.0, filters=[("value", "<", 480)])
    m = spread.LayeredModel(cfg).fit(df)
    out = m.predict(df, *m.layers(df))
    return round_all(out.select("event_id", "_scorable", "_skip_reason", "structural", "adjustment", "delta", "prediction"), 5)


@query("""WITH e AS (SELECT event_type, CAST(ts AS DATE) "day", CAST(hour(ts) AS DOUBLE) h, value FROM events), g AS (SELECT unnest([0, 6, 12, 18]) :: DOUBLE g),
r AS (SELECT event_type, "day", g, sum(w * value) / sum(w) * (1 - exp(-sum(w))) raw FROM (SELECT *, exp(-(h - g) * (h - g) / 18) w FROM e, g) GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER o p, lead("day") OVER o AS after FROM r WINDOW o AS (PARTITION BY event_type, g ORDER BY "day")),
c AS (SELECT a.event_type, a.g, a."day", a.after, sum(0.7 * pow(0.3, a.p - b.p) * b.raw) delta FROM n a JOIN n b ON a.event_type = b.event_type AND a.g = b.g AND b.p <= a.p GROUP BY 1, 2, 3, 4)
SELECT c.event_type, d."day", c.g AS grid_x, round(delta, 6) AS delta FROM c JOIN (SELECT DISTINCT "day" FROM e) d ON d."day" >= c."day" AND (c.after IS NULL OR d."day" < c.after)""")
def daily_kernel_curves(t):
    """Each type's curve over the hours, blended with the day before's, one row per grid point."""
    grid = [0.0, 6.0, 12.0, 18.0]
    df = t.events.select("event_type", F.to_date("ts").alias("day"), F.hour("ts").cast("double").alias("hour"), "value")
    out = smoothing.daily_curves(df, "day", "event_type", "hour", "value", grid, 3.0, 0.7)
    points = out.select("event_type", "day", F.explode(F.arrays_zip(F.array(*map(F.lit, grid)).alias("grid_x"), F.col("curve").alias("delta"))).alias("p"))
    return round_all(points.select("event_type", "day", F.col("p.grid_x").alias("grid_x"), F.col("p.delta").alias("delta")))


@query("""WITH e AS (SELECT event_id, value, CAST(ts AS DATE) d, CAST(event_id % 17 AS DOUBLE) x FROM events), m AS (SELECT d, row_number() OVER (ORDER BY d) rk FROM e GROUP BY 1), r AS (SELECT * FROM e JOIN m USING (d)),
f AS (SELECT m.rk, m.d run_date, regr_slope(value, x) k, regr_intercept(value, x) c FROM m JOIN r ON r.rk BETWEEN m.rk - 6 AND m.rk WHERE m.rk >= 7 GROUP BY 1, 2)
SELECT run_date, r.d, event_id, round(c + k * x, 5) AS prediction, round(value - c - k * x, 5) AS residual FROM r JOIN f ON f.rk = r.rk - 1""")
def rolling_backtest(t):
    import numpy as np

    def line(a, b):
        k, c = np.polyfit(a["x"].astype(float), a["value"].astype(float), 1)
        return c + k * b["x"].astype(float)

    df = t.events.select("event_id", "value", F.to_date("ts").alias("d"), (F.col("event_id") % 17).cast("double").alias("x"))
    return round_all(folds.rolling_backtest(df, "d", "value", ["x"], 7, line, "event_id"), 5)


@query("""SELECT p_partkey, round(1 + CASE p_type WHEN 'ECONOMY' THEN -1 + (p_size - 1) * 2 / 49.0 + 1 WHEN 'PROMO' THEN -1 + (p_size - 1) * 2 / 49.0 + 2 ELSE 0 END, 6) AS pred, round(CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN -1 + (p_size - 1) * 2 / 49.0 ELSE 0 END, 6) AS s__p_size__by__p_type FROM part""")
def gam_centered(t):
    r = gam.Replay([gam.Term("by", "p_size", by="p_type", groups={k: {"x": [1.0, 50.0], "y": [float(i), float(i + 2)]} for i, k in enumerate(("ECONOMY", "PROMO"))})], 1.0).centered()
    return round_all(r.decompose(t.part).select("p_partkey", "pred", "s__p_size__by__p_type"))


@query("""WITH r AS (SELECT l_quantity > 48 AS event, CAST('0x' || substr(md5('42:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey), 1, 8) AS BIGINT) AS place, l_orderkey, l_linenumber, l_partkey FROM lineitem),
w AS (SELECT least(1.0, CAST(count(*) FILTER (event) AS DOUBLE) * 0.5 / 0.5 / count(*) FILTER (NOT event)) w FROM r) SELECT l_orderkey, l_linenumber, l_partkey, event FROM r, w WHERE event OR place < floor(w * 4294967296)""")
def case_control(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    kept, _ = filters.case_control(t.lineitem.withColumn("key", key), F.col("l_quantity") > 48, 0.5, "key")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 48).alias("event"))


@query("""WITH tr AS (SELECT user_id, event_type, ts, event_id, value AS price, CASE WHEN event_id % 7 = 6 THEN 0 WHEN event_id % 7 < 3 THEN 1 ELSE -1 END::DOUBLE AS shares FROM events),
h AS (SELECT *, sum(shares) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) held FROM tr), e AS (SELECT *, coalesce(sum(CASE WHEN held = 0 AND shares <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ep FROM h),
c AS (SELECT *, CASE WHEN held = 0 THEN 0.0 ELSE sum(shares * price) OVER (PARTITION BY user_id, event_type, ep ORDER BY ts, event_id) END AS cost, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) i FROM e)
SELECT user_id, round(sum(held * price), 4) AS market_value, round(sum(held * price - cost), 4) AS pnl, CAST(count(*) FILTER (held <> 0) AS BIGINT) AS open_positions FROM c WHERE i = 1 GROUP BY 1""")
def account_totals(t):
    n = F.col("event_id") % 7
    q = F.when(n == 6, 0).when(n < 3, 1).otherwise(-1).cast("double")
    rows = t.events.select("user_id", "event_type", "ts", "event_id", F.col("value").alias("price"), q.alias("shares"))
    return round_all(ledger.totals(ledger.positions(rows, ["user_id", "event_type"], O), U, "event_type", O), 4)


@query("""WITH s AS (SELECT event_type, stddev_pop(value) FILTER (event_id % 10 < 4) lo, stddev_pop(value) FILTER (event_id % 10 >= 4) hi FROM events GROUP BY 1)
SELECT event_id, coalesce(lo > hi, false) AS flipped, round(CASE WHEN lo > hi THEN 1 - event_id % 10 / 10.0 ELSE event_id % 10 / 10.0 END, 6) AS p FROM events JOIN s USING (event_type)""")
def two_state_flip(t):
    df = t.events.withColumn("p", (F.col("event_id") % 10) / 10.0)
    return aggs.flip_two_states(df, "value", "p", ["event_type"], 0.4).select("event_id", "flipped", rounded("p").alias("p"))


@query("""WITH s AS (SELECT event_type, event_id % 3 AS state, stddev_pop(value) sd, avg(value) m FROM events GROUP BY 1, 2), o AS (SELECT event_type, m <= lag(m) OVER (PARTITION BY event_type ORDER BY sd, state) ok FROM s) SELECT event_type, bool_and(coalesce(ok, true)) AS agrees FROM o GROUP BY 1""")
def state_order(t):
    return aggs.order_agrees(t.events.withColumn("state", F.col("event_id") % 3), "value", "value", "state", ["event_type"])


@query("""SELECT c_custkey, CAST(ntile(4) OVER w AS INTEGER) AS tile, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist, nth_value(c_custkey, 3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)""")
def group_ranks(t):
    """Tiles, relative ranks and the third value of every segment."""
    keys, order = ["c_mktsegment"], ["c_acctbal", "c_custkey"]
    out = windows.nth(windows.ranks(t.customer, keys, order, 4), "c_custkey", keys, order, 3, "third")
    return round_all(out.select("c_custkey", "tile", "percent_rank", "cume_dist", "third"), 9)


@query("""SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS orders_30d, max(o_totalprice) OVER w AS largest_30d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)""")
def trailing_days(t):
    """Orders of a customer's last thirty days, by a frame of days and not of rows."""
    keys, day = ["o_custkey"], F.unix_date(F.to_date("o_orderdate"))
    out = windows.within(t.orders, F.count("*"), keys, day, 30, out="orders_30d")
    return windows.within(out, F.max("o_totalprice"), keys, day, 30, out="largest_30d").select("o_orderkey", "orders_30d", "largest_30d")


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 36 HOUR""")
def events_after_purchase(t):
    """Every event with the purchases of its user in the 36 hours before it."""
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("since"), F.expr("ts + INTERVAL 36 HOURS").alias("until"))
    return joins.interval_join(t.events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "since", "until", 129600).select("event_id", "purchase_id")


@query("""WITH x AS (SELECT p_partkey, p_type, (p_size - 1) / 49.0 z FROM part)
SELECT p_partkey, round(2 * z - 1, 6) AS s__p_size, round(CASE p_type WHEN 'ECONOMY' THEN z WHEN 'PROMO' THEN 3 - z ELSE 0 END, 6) AS s__p_size__by__p_type, round(CASE p_type WHEN 'PROMO' THEN 0.25 ELSE 0 END, 6) AS f__p_type, round(10 + 2 * z - 1 + CASE p_type WHEN 'ECONOMY' THEN z WHEN 'PROMO' THEN 3 - z + 0.25 ELSE 0 END, 6) AS pred FROM x""")
def gam_components(t):
    """Scores from exported smooth components: a curve, a curve by type and a factor."""
    import json

    smooth = lambda fit, **more: {"x": [1.0, 50.0], "fit": fit, "se": [0.1, 0.1], "var": "p_size"} | more
    smooths = {"s(p_size)": smooth([-1.0, 1.0]), "s(p_size):ECONOMY": smooth([0.0, 1.0], by_var=["p_type"], by_level=["ECONOMY"]), "s(p_size):PROMO": smooth([3.0, 2.0], by_var="p_type", by_level="PROMO")}
    parametric = {"term": ["(Intercept)", "p_typePROMO"], "Estimate": [10.0, 0.25], "Std. Error": [0.1, 0.1]}
    r = gam.Replay.from_components(json.dumps({"intercept": 10.0, "smooths": smooths, "parametric": parametric, "xlevels": {"p_type": ["ECONOMY", "PROMO"]}}))
    return round_all(r.decompose(t.part).select("p_partkey", "s__p_size", "s__p_size__by__p_type", "f__p_type", "pred"))
