"""Aggregations, windows, ledgers, folds and models over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import gam, jump, linear, neighbors, product, tsa
from ..operators import aggs, folds, ledger, smoothing, windows
from ..streaming import state
from .registry import query, round_all, rounded

U = ["user_id"]
O = ["ts", "event_id"]


def _series(t):
    return t.events.select("user_id", "ts", "event_id", "event_type", "value")


def _returns(t):
    """Returns per user, small enough that products stay finite."""
    return _series(t).withColumn("r", (F.col("value") - 100) / 10000)


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_R = "WITH x AS (SELECT user_id, ts, event_id, event_type, value, (value - 100) / 10000 r FROM events) "


@query("""SELECT l_returnflag, round_even(l_quantity / 10, 0) * 10 AS bin_val, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS l_discount_mean,
round(sum(l_tax * l_extendedprice) / sum(l_extendedprice), 6) AS l_tax_mean, count(*) AS "count" FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2""")
def binned_step(t):
    from ..operators import filters

    rows = filters.filter_frame(t.lineitem, [("l_shipdate", ">=", "1996-01-01")])
    return round_all(aggs.binned_means(rows, "l_quantity", "l_discount", ["l_tax"], "l_extendedprice", ["l_returnflag"], "step", step=10))


@query("""WITH q AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) e0 FROM lineitem), e AS (SELECT list_sort(e0) e FROM q),
b AS (SELECT l.*, e.e[greatest(2, 1 + len(list_filter(e.e, lambda v: v < l_extendedprice)))] bin_val FROM lineitem l, e)
SELECT round(bin_val, 4) AS bin_val, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount_mean, count(*) AS "count" FROM b GROUP BY 1""")
def binned_quantile(t):
    out = aggs.binned_means(t.lineitem, "l_extendedprice", "l_discount", [], "l_quantity", [], "quantile", n_bins=10)
    return out.select(rounded("bin_val", 4).alias("bin_val"), rounded("l_discount_mean").alias("l_discount_mean"), "count")


@query("""SELECT l_linestatus, CAST(l_linenumber AS DOUBLE) AS bin_val, round(avg(l_tax), 6) AS l_tax_mean, count(*) AS "count" FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 100""")
def binned_discrete(t):
    return round_all(aggs.binned_means(t.lineitem, "l_linenumber", "l_tax", facet=["l_linestatus"], strategy="discrete", min_count=100))


@query("""SELECT CAST(CASE WHEN l_quantity <= 10 THEN 10 WHEN l_quantity <= 25 THEN 25 ELSE 40 END AS DOUBLE) AS bin_val, round(avg(l_discount), 6) AS l_discount_mean, count(*) AS "count",
round(10 + coalesce((count(*) - min(count(*)) OVER ()) / nullif(CAST(max(count(*)) OVER () - min(count(*)) OVER () AS DOUBLE), 0), 1) * 90, 6) AS bubble_size FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 40 GROUP BY 1""")
def binned_custom(t):
    return round_all(aggs.binned_means(t.lineitem, "l_quantity", "l_discount", strategy="custom", edges=[5, 10, 25, 40], sizes=(10, 100)))


@query("""SELECT CASE WHEN l_quantity <= 10 THEN '<10' WHEN l_quantity <= 30 THEN '10-30' ELSE '>30' END AS label, CAST(CASE WHEN l_quantity <= 10 THEN 10 WHEN l_quantity <= 30 THEN 20 ELSE 30 END AS DOUBLE) AS center, count(*) AS "count",
round(avg(l_tax), 6) AS l_tax_mean, round(avg(l_tax) - 2 * stddev_samp(l_tax) / sqrt(count(*)), 6) AS l_tax_low, round(avg(l_tax) + 2 * stddev_samp(l_tax) / sqrt(count(*)), 6) AS l_tax_high FROM lineitem GROUP BY 1, 2""")
def binned_band(t):
    return round_all(aggs.binned_band(t.lineitem, "l_quantity", ["l_tax"], [10, 30], err="sem", k=2))


@query("""SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS o_orderstatus, max_by(o_orderpriority, o_orderkey) AS o_orderpriority, round(sum(o_totalprice), 4) AS o_totalprice, round(sum(w * o_totalprice) / sum(o_totalprice), 6) AS w FROM (SELECT *, CAST(o_orderkey % 7 AS DOUBLE) w FROM orders) GROUP BY 1""")
def agg_flex(t):
    df = t.orders.withColumn("w", (F.col("o_orderkey") % 7).cast("double")).withColumn("weight", F.col("o_totalprice"))
    out = aggs.aggregate_flex(df, ["o_custkey"], ["o_orderkey"], "weight", "first", {"o_orderpriority": "last", "o_totalprice": "sum", "w": "wavg"})
    return out.select("o_custkey", "o_orderstatus", "o_orderpriority", rounded("o_totalprice", 4).alias("o_totalprice"), rounded("w").alias("w"))


@query("""SELECT user_id, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS value, arg_min(event_type, event_id) AS event_type, max(event_id) AS event_id FROM (SELECT *, CASE WHEN event_type <> 'view' THEN value END v FROM events) GROUP BY 1""")
def collapse_dups(t):
    df = t.events.select("user_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), "event_type", "event_id")
    return aggs.collapse_duplicates(df, ["user_id"], ["event_id"], {"event_id": "max"})


@query("""SELECT l_linenumber, CASE WHEN abs(sum(m * m)) < 1e-8 THEN 0.0 ELSE round(sum(m * y) / sum(m * m), 6) END AS implied, round(avg(m), 4) AS model_mean, count(*) AS "count" FROM (SELECT l_linenumber, l_extendedprice y, l_quantity * 1000 m FROM lineitem) GROUP BY 1""")
def implied_actual_mse(t):
    df = t.lineitem.withColumn("m", F.col("l_quantity") * 1000)
    out = aggs.implied_actual(df, ["l_linenumber"], "l_extendedprice", "m")
    return out.select("l_linenumber", rounded("implied").alias("implied"), rounded("model_mean", 4).alias("model_mean"), "count")


@query("""SELECT l_returnflag, round(sum(w * y / p) / sum(w * m / p), 6) AS implied, round(avg(m), 6) AS model_mean, count(*) AS "count" FROM (SELECT l_returnflag, l_quantity y, 1 + l_discount m, greatest(1 + l_discount, 1e-10) p, l_extendedprice w FROM lineitem) GROUP BY 1""")
def implied_actual_poisson(t):
    df = t.lineitem.withColumn("m", 1 + F.col("l_discount"))
    return round_all(aggs.implied_actual(df, ["l_returnflag"], "l_quantity", "m", "l_extendedprice", "poisson"))


@query("""WITH d AS (SELECT CAST(CASE WHEN o_totalprice <= 100000 THEN 100000 WHEN o_totalprice <= 300000 THEN 200000 ELSE 300000 END AS DOUBLE) AS point, CAST(o_custkey % 10 AS DOUBLE) y, exp(-ln(2) * date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 365) w FROM orders)
SELECT point, round(sum(y * w) / sum(w), 6) AS value, round(sum(w), 6) AS "count" FROM d GROUP BY 1""")
def decay_curve(t):
    df = t.orders.withColumn("y", (F.col("o_custkey") % 10).cast("double"))
    return round_all(aggs.decayed_means(df, "o_totalprice", "y", "o_orderdate", [100000, 300000], F.lit("2001-08-01").cast("date"), 365))


@query("""SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS "min", max(o_totalprice) AS "max" FROM orders""")
def numeric_summary(t):
    return round_all(aggs.numeric_summary(t.orders, "o_totalprice"), 4)


@query("""WITH m AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi, count(*) n FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 30)), 29) AS INTEGER) i, lo, hi, n FROM customer, m)
SELECT round(i * ((hi - lo) / 30) + lo, 4) AS "left", count(*) AS "count" FROM b GROUP BY i, lo, hi""")
def histogram(t):
    return aggs.histogram(t.customer, "c_acctbal").select(rounded("left", 4).alias("left"), "count")


@query("""WITH c AS (SELECT p_brand v, count(*) n, row_number() OVER (ORDER BY count(*) DESC, p_brand) rk FROM part GROUP BY 1) SELECT CASE WHEN rk <= 9 THEN v ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS "count" FROM c GROUP BY 1""")
def value_counts_other(t):
    return aggs.top_values(t.part, "p_brand", 10)


@query("""WITH s AS (SELECT o_orderpriority k, o_orderstatus st, avg(o_totalprice) m, stddev_pop(o_totalprice) sd FROM orders GROUP BY 1, 2) SELECT k AS o_orderpriority, CAST(row_number() OVER (PARTITION BY k ORDER BY sd, st) - 1 AS INTEGER) AS state, round(m, 4) AS mean, round(sd, 4) AS std FROM s""")
def state_relabel(t):
    df = t.orders.select("o_orderpriority", F.col("o_orderstatus").alias("state"), "o_totalprice")
    out = aggs.relabel_states(df, "o_totalprice", "state", ["o_orderpriority"])
    return round_all(aggs.state_stats(out, "o_totalprice", "state", ["o_orderpriority"]), 4)


@query("""SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT o_orderstatus, avg(CAST(o_orderstatus = CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS DOUBLE)) r FROM orders GROUP BY 1)""")
def balanced_accuracy(t):
    df = t.orders.withColumn("p", F.when(F.col("o_totalprice") > 250000, "F").otherwise("O"))
    return round_all(aggs.balanced_accuracy(df, "o_orderstatus", "p"))


@query("""SELECT round(avg(abs(l_tax - l_discount)), 6) AS mae, round(avg(pow(l_tax - l_discount, 2)), 6) AS mse, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS logloss, round(avg(2 * (CASE WHEN l_tax > 0 THEN l_tax * ln(l_tax / p) ELSE 0 END - (l_tax - p))), 6) AS deviance,
round(sum(greatest(abs(l_tax - l_discount) - 0.02, 0) * l_quantity) / sum(l_quantity), 6) AS eps FROM (SELECT *, CAST(l_returnflag = 'R' AS DOUBLE) y, 0.2 + l_discount p FROM lineitem)""")
def losses(t):
    df = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("double")).withColumn("p", 0.2 + F.col("l_discount"))
    a = ("l_tax", "l_discount")
    return round_all(df.agg(aggs.mean_absolute_error(*a).alias("mae"), aggs.mse(*a).alias("mse"), aggs.log_loss("y", "p").alias("logloss"), aggs.poisson_deviance("l_tax", "p").alias("deviance"), aggs.epsilon_insensitive(*a, 0.02, "l_quantity").alias("eps")))


@query("""SELECT l_linenumber, round(sum(CAST(l_returnflag = 'R' AS DOUBLE) * l_quantity) / sum(l_quantity), 6) AS smm, count(*) AS loans, round(1 - pow(1 - sum(CAST(l_returnflag = 'R' AS DOUBLE) * l_quantity) / sum(l_quantity), 12), 6) AS cpr FROM lineitem GROUP BY 1""")
def loan_performance(t):
    return round_all(aggs.loan_performance(t.lineitem.withColumn("paid", F.col("l_returnflag") == "R"), ["l_linenumber"], "paid", "l_quantity"))


@query("""WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) d0, count(*) n FROM orders GROUP BY 1), c AS (SELECT year(d0) cohort, count(*) size FROM f GROUP BY 1),
l AS (SELECT year(d0) cohort, date_diff('year', d0, d1) age, count(*) paid FROM f JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) d1 FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1, 2)
SELECT CAST(cohort AS INTEGER) AS cohort, CAST(age AS INTEGER) AS age, round(1 - sum(paid) OVER (PARTITION BY cohort ORDER BY age) / CAST(size AS DOUBLE), 6) AS survival FROM l JOIN c USING (cohort)""")
def cohort_survival(t):
    spans = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("d0"), F.max("o_orderdate").alias("d1"))
    rows = spans.select(F.year("d0").alias("cohort"), (F.year("d1") - F.year("d0")).alias("age"), F.lit(1.0).alias("paid"))
    sizes = rows.groupBy("cohort").agg(F.count("*").alias("size"))
    return round_all(aggs.survival(rows.join(sizes, "cohort"), ["cohort"], "age", "paid", "size").select("cohort", "age", "survival"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(t):
    return round_all(aggs.rollups(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity"), 2)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_totals(t):
    return round_all(aggs.rollups(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", "cube"), 2)


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) <= 3""")
def latest_n(t):
    return windows.latest_n(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", 3, ["o_orderkey"])


@query("""WITH a AS (SELECT user_id, event_type, event_id, value, 0 s FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, -value, 1 FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, event_id, value FROM a QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY s DESC, event_id DESC) = 1""")
def combine_latest(t):
    e = t.events.select("user_id", "event_type", "event_id", "value")
    return windows.combine_latest([e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("value", -F.col("value"))], ["user_id", "event_type"], ["event_id"])


@query(f"""SELECT event_id, round(ln(value / lag(value) {_W})), 6) AS log_return FROM events""")
def log_returns(t):
    return round_all(windows.log_returns(_series(t), "value", U, O).select("event_id", "log_return"))


@query(f"""SELECT event_id, CASE WHEN count(*) {_W} ROWS 4 PRECEDING) = 5 THEN sign(sum(value - 100) {_W} ROWS 4 PRECEDING)) END AS signal FROM events""")
def momentum(t):
    out = windows.momentum(_series(t).withColumn("r", F.col("value") - 100), "r", U, O, 5)
    return out.select("event_id", F.col("signal").cast("tinyint").alias("signal"))


@query(f"""WITH w AS (SELECT event_id, value, count(*) {_W} ROWS 9 PRECEDING) n, avg(value) {_W} ROWS 9 PRECEDING) m, stddev_samp(value) {_W} ROWS 9 PRECEDING) s FROM events)
SELECT event_id, round(CASE WHEN n = 10 THEN m END, 6) AS ma, round(CASE WHEN n = 10 THEN m + 1.5 * s END, 6) AS upper, round(CASE WHEN n = 10 THEN m - 1.5 * s END, 6) AS lower, round(CASE WHEN n = 10 THEN (value - m) / s END, 5) AS z,
CASE WHEN n = 10 AND value <= m - 1.5 * s THEN 1 WHEN n = 10 AND value >= m + 1.5 * s THEN -1 END AS signal FROM w""")
def bollinger(t):
    out = windows.bollinger(_series(t), "value", U, O, 10, 1.5)
    return out.select("event_id", *[rounded(c).alias(c) for c in ("ma", "upper", "lower")], rounded("z", 5).alias("z"), "signal")


@query(f"""WITH d AS (SELECT *, abs(value - lag(value) {_W})) ad FROM events), w AS (SELECT *, lag(ad) {_W}) pad, avg(value) {_W} ROWS 5 PRECEDING) m6, count(*) {_W} ROWS 5 PRECEDING) n6, avg(value) {_W} ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) ml, count(*) {_W} ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) nl, stddev_samp(value) {_W} ROWS 6 PRECEDING) sr FROM d)
SELECT event_id, round(ad, 6) AS abs_diff, round(pad, 6) AS prev_abs_diff, round(m6, 6) AS mean_6, round(ml, 6) AS mean_left_14, round(sr, 6) AS std_right_14 FROM w WHERE pad IS NOT NULL AND n6 = 6 AND nl = 7""")
def regime_features(t):
    out = windows.regime_features(_series(t), "value", U, O)
    return round_all(out.select("event_id", "abs_diff", "prev_abs_diff", "mean_6", "mean_left_14", "std_right_14"))


@query(_R + f""", w AS (SELECT *, exp(sum(ln(1 + r)) {_W})) wealth FROM x), d AS (SELECT *, wealth / max(wealth) {_W}) - 1 dd FROM w) SELECT event_id, round(wealth, 6) AS wealth, round(dd, 6) AS drawdown FROM d""")
def drawdown(t):
    out = windows.drawdown(_returns(t), "r", U, O).select("event_id", "wealth", "drawdown")
    return out.select("event_id", rounded("wealth").alias("wealth"), (rounded("drawdown") + 0.0).alias("drawdown"))


@query(_R + f""", w AS (SELECT *, exp(sum(ln(1 + r)) {_W})) wealth FROM x), d AS (SELECT *, wealth / max(wealth) {_W}) - 1 dd FROM w)
SELECT user_id, round(avg(r) * 252, 6) AS annual_return, round(stddev_samp(r) * sqrt(252), 6) AS annual_volatility, round(sqrt(252) * avg(r) / stddev_samp(r), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, count(*) FILTER (WHERE r <> 0) AS trades FROM d GROUP BY 1""")
def perf_metrics(t):
    return round_all(aggs.performance(_returns(t), "r", U, O))


@query(f"""WITH l AS (SELECT user_id, k, value x, CASE WHEN k >= 0 THEN lag(y, greatest(k, 0)) OVER w ELSE lead(y, greatest(-k, 0)) OVER w END y FROM (SELECT *, value * (event_id % 5) y FROM events), (SELECT unnest(range(-2, 3)) k) WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id))
SELECT user_id, CAST(k AS INTEGER) AS lag, round(corr(x, y), 6) AS corr FROM l GROUP BY 1, 2""")
def xcorr(t):
    df = _series(t).withColumn("y", F.col("value") * (F.col("event_id") % 5))
    return round_all(windows.cross_correlation(df, "value", "y", U, O, 2))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
f AS (SELECT user_id, event_id, i, value AS num, 1.0::DOUBLE AS den FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, f.num * 0.75 + s.value, f.den * 0.75 + 1 FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1),
m AS (SELECT s.*, pow(s.value - f.num / f.den, 2) q, f.num / f.den e FROM s JOIN f ON s.user_id = f.user_id AND s.i = f.i),
g AS (SELECT user_id, event_id, i, e, q AS num, 1.0::DOUBLE AS den FROM m WHERE i = 1 UNION ALL SELECT m.user_id, m.event_id, m.i, m.e, g.num * 0.75 + m.q, g.den * 0.75 + 1 FROM g JOIN m ON m.user_id = g.user_id AND m.i = g.i + 1)
SELECT event_id, round(e, 5) AS ewma, round(sqrt(num / den * 261), 4) AS volatility FROM g""")
def ewma_vol(t):
    df = windows.ex_ante_volatility(windows.ewma(_series(t), "value", U, O, 3), "value", U, O, 3, 261)
    return df.select("event_id", rounded("ewma", 5).alias("ewma"), rounded("volatility", 4).alias("volatility"))


@query(f"""SELECT event_id, round(lag(value) {_W}), 6) AS shifted, round(CASE WHEN count(*) {_W} ROWS 2 PRECEDING) = 3 THEN avg(value) {_W} ROWS 2 PRECEDING) END, 6) AS rolling, round(avg(value) OVER (PARTITION BY user_id), 6) AS group_mean,
round((value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id), 6) AS z, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS avg_rank FROM events""")
def group_features(t):
    out = windows.group_features(_series(t), "value", U, O)
    return round_all(out.select("event_id", "shifted", "rolling", "group_mean", "z", "avg_rank"))


_T = """WITH tr AS (SELECT user_id, event_type, event_id, ts, value AS price, CASE event_type WHEN 'purchase' THEN 1 + event_id % 3 WHEN 'view' THEN 1 + event_id % 3 WHEN 'click' THEN -1 - event_id % 2 ELSE 0 END::DOUBLE AS shares FROM events) """


def _trades(t):
    n = F.col("event_id")
    q = F.when(F.col("event_type").isin("purchase", "view"), 1 + n % 3).when(F.col("event_type") == "click", -1 - n % 2).otherwise(0)
    return t.events.select("user_id", "event_type", "event_id", "ts", F.col("value").alias("price"), q.cast("double").alias("shares"))


@query(_T + f""", h AS (SELECT *, sum(shares) {_W}) held FROM tr), e AS (SELECT *, coalesce(sum(CASE WHEN held = 0 AND shares <> 0 THEN 1 ELSE 0 END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ep FROM h),
c AS (SELECT *, CASE WHEN held = 0 THEN 0.0 ELSE sum(shares * price) OVER (PARTITION BY user_id, ep ORDER BY ts, event_id) END AS cost FROM e)
SELECT event_id, held, round(CASE WHEN held = 0 THEN 0 ELSE cost / held END, 8) AS avg_cost, round(held * price, 4) AS market_value, round(held * price - cost, 4) AS pnl FROM c""")
def position_ledger(t):
    out = ledger.positions(_trades(t), U, O)
    return out.select("event_id", "held", rounded("avg_cost", 8).alias("avg_cost"), rounded("market_value", 4).alias("market_value"), (rounded("pnl", 4) + 0.0).alias("pnl"))


@query(_T + f"""SELECT event_id, round(100000 - sum(shares * price) {_W}), 4) AS cash FROM tr""")
def account_cash(t):
    return round_all(ledger.cash(_trades(t), U, O, F.lit(100000.0)).select("event_id", "cash"), 4)


@query(_T + """SELECT user_id, event_type, sum(shares) AS held, round(sum(shares) * max_by(price, ts), 4) AS market_value FROM tr WHERE shares >= 0 GROUP BY 1, 2""")
def position_snapshot(t):
    led = ledger.positions(_trades(t).where("shares >= 0"), ["user_id", "event_type"], O)
    out = ledger.snapshot(led, ["user_id"], "event_type", O)
    return out.select("user_id", "event_type", "held", rounded("market_value", 4).alias("market_value"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, CASE WHEN value > 150 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END g, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
f AS (SELECT user_id, event_id, i, CASE WHEN c = 1 THEN 0 ELSE g END p FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, CASE WHEN s.c = 1 THEN 0 WHEN f.p = 0 THEN s.g WHEN s.g = -f.p THEN 0 ELSE f.p END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT event_id, CAST(p AS INTEGER) AS position FROM f""")
def signal_machine(t):
    v = F.col("value")
    df = _series(t).withColumn("sig", F.when(v > 150, 1).when(v < 20, -1).otherwise(0)).withColumn("close", ((F.col("event_type") == "error") & (v > 60)).cast("int"))
    return ledger.signal_positions(df, "sig", U, O, "close").select("event_id", "position")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, (value - 100) / 100 r, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
f AS (SELECT user_id, event_id, i, d, 0.0::DOUBLE AS adj, 0.3 * r AS ema, 1.0::DOUBLE AS n FROM s WHERE i = 1 UNION ALL
SELECT s.user_id, s.event_id, s.i, s.d, (f.n * k) / (f.n * k + 2) * (f.ema * k), 0.3 * s.r + 0.7 * f.ema * k, f.n * k + 1 FROM f JOIN (SELECT *, exp(-ln(2) / 5 * (d - lag(d) OVER (PARTITION BY user_id ORDER BY i))) k FROM s) s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT event_id, round(adj, 6) AS adjustment, round(ema, 6) AS ema, round(n, 6) AS n FROM f""")
def bond_memory(t):
    df = _series(t).withColumn("r", (F.col("value") - 100) / 100)
    out = smoothing.keyed_memory(df.withColumn("day", F.to_date("ts")), "r", "day", U, O, 0.3, 2.0, 5.0)
    return round_all(out.select("event_id", "adjustment", "ema", "n"))


@query("""WITH g AS (SELECT unnest([0.0, 6.0, 12.0, 18.0]) x), w AS (SELECT event_type, CAST(ts AS DATE) AS day, x, exp(-pow((hour(ts) - x) / 3.0, 2) / 2) w, value FROM events, g)
SELECT event_type, day, CAST(x AS DOUBLE) AS grid_x, round(sum(w * value) / sum(w) * (1 - exp(-sum(w))), 5) AS delta FROM w GROUP BY 1, 2, 3""")
def kernel_delta(t):
    df = t.events.select("event_type", F.to_date("ts").alias("day"), F.hour("ts").cast("double").alias("h"), "value")
    return round_all(smoothing.kernel_curves(df, ["event_type", "day"], "h", "value", [0.0, 6.0, 12.0, 18.0], 3.0), 5)


@query("""WITH g AS (SELECT unnest([6.0, 12.0, 18.0]) x), w AS (SELECT event_type, x, exp(-pow((hour(ts) - x) / 4.0, 2) / 2) w, hour(ts) - x z, value v FROM events, g),
s AS (SELECT event_type, x, sum(w) a, sum(w * z) b, sum(w * z * z) c, sum(w * v) d, sum(w * z * v) e FROM w GROUP BY 1, 2) SELECT event_type, CAST(x AS DOUBLE) AS grid_x, round((c * d - b * e) / (a * c - b * b), 5) AS value FROM s""")
def local_linear(t):
    df = t.events.select("event_type", F.hour("ts").cast("double").alias("h"), "value")
    return round_all(smoothing.local_linear(df, ["event_type"], "h", "value", [6.0, 12.0, 18.0], 4.0), 5)


_D = "WITH e AS (SELECT event_id, value, CAST(ts AS DATE) d FROM events), m AS (SELECT d, avg(value) m, count(*) n, row_number() OVER (ORDER BY d) rk FROM e GROUP BY 1) "


@query(_D + """SELECT event_id, round(p.m, 6) AS prediction FROM e JOIN m USING (d) LEFT JOIN m p ON p.rk = m.rk - 1""")
def walk_forward_last_value(t):
    df = t.events.select("event_id", "value", F.to_date("ts").alias("d"))
    return round_all(folds.last_value_forecast(df, "d", "value").select("event_id", "prediction"))


@query(_D + """SELECT d, CAST(n AS BIGINT) AS test_rows, CAST(coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS train_rows FROM m QUALIFY coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 500""")
def daily_folds(t):
    return folds.daily_folds(t.events.select(F.to_date("ts").alias("d")), "d", 500)


@query(_D + """, f AS (SELECT r.rk, r.d run_date, sum(x.m * x.n) / sum(x.n) p FROM m r JOIN m x ON x.rk BETWEEN r.rk - 4 AND r.rk WHERE r.rk >= 5 GROUP BY 1, 2)
SELECT event_id, run_date, round(p, 6) AS prediction, round(value - p, 6) AS residual FROM e JOIN m USING (d) JOIN f ON f.rk = m.rk - 1""")
def rolling_mean_backtest(t):
    df = t.events.select("event_id", "value", F.to_date("ts").alias("d"))
    return round_all(folds.rolling_mean_backtest(df, "d", "value", 5).select("event_id", "run_date", "prediction", "residual"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def ols_group(t):
    out = linear.group_lines(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", rounded("slope", 4).alias("slope"), rounded("intercept", 3).alias("intercept"), rounded("r2").alias("r2"), "n")


@query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""")
def ols_gram(t):
    m = linear.least_squares(t.lineitem, "l_extendedprice", ["l_quantity"])
    return t.spark.createDataFrame([(round(m.intercept, 3), round(float(m.coefficients[0]), 4), round(m.r2, 6), m.rows)], "intercept double, slope double, r2 double, n long")


@query(f"""WITH p AS (SELECT value y, lag(value) {_W}) x FROM events) SELECT round(regr_intercept(y, x), 5) AS a0, round(regr_slope(y, x), 6) AS a1, CAST(regr_count(y, x) AS BIGINT) AS n FROM p""")
def ar1(t):
    m = linear.autoregression(_series(t), "value", U, O, 1)
    return t.spark.createDataFrame([(round(m.intercept, 5), round(float(m.coefficients[0]), 6), m.rows)], "a0 double, a1 double, n long")


@query(f"""WITH p AS (SELECT user_id, value y, lag(value) {_W}) x FROM events), r AS (SELECT user_id, regr_slope(y, x) a1, regr_intercept(y, x) a0, regr_syy(y, x) syy, regr_sxy(y, x) sxy, regr_count(y, x) n FROM p GROUP BY 1)
SELECT user_id, round(1 - a1, 6) AS theta, round(a0 / (1 - a1), 5) AS mu, round(sqrt(greatest((syy - a1 * sxy) / n, 0)), 5) AS sigma, CAST(n AS BIGINT) AS n FROM r""")
def ou_params(t):
    out = linear.mean_reversion(_series(t), "value", U, O)
    return out.select("user_id", rounded("theta").alias("theta"), rounded("mu", 5).alias("mu"), rounded("sigma", 5).alias("sigma"), "n")


@query("""WITH f AS (SELECT user_id, event_id, ts, value y, sqrt(1 + event_id % 11) x FROM events), r AS (SELECT *, regr_slope(y, x) OVER w s, regr_intercept(y, x) OVER w c, regr_r2(y, x) OVER w q, count(*) OVER w n FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING))
SELECT user_id, event_id, round(CASE WHEN n = 20 THEN s END, 7) AS slope, round(CASE WHEN n = 20 THEN c END, 7) AS intercept, round(CASE WHEN n = 20 THEN q END, 7) AS r2, round(CASE WHEN n = 20 THEN y - c - s * x END, 7) AS residual FROM r""")
def rolling_regression(t):
    """Irrational x, so that no result is a decimal tie that the order of sums would decide."""
    df = _series(t).withColumn("x", F.sqrt(1 + F.col("event_id") % 11))
    out = windows.rolling_regression(df, "value", "x", U, O, 19)
    return round_all(out.select("user_id", "event_id", "slope", "intercept", "r2", "residual"), 7)


@query("""WITH w AS (SELECT CAST(o_orderdate AS DATE) d, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 1e6 a, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 1e6 b FROM orders GROUP BY 1), r AS (SELECT d, a, CASE WHEN a > b THEN a + 0.01 ELSE b END b2 FROM w),
s AS (SELECT d, a, CASE WHEN b2 - a < 0 THEN a ELSE b2 END b3 FROM r) SELECT d, round(a, 8) AS a, round(CASE WHEN b3 - a > 1 THEN a + 1 ELSE b3 END, 8) AS b FROM s""")
def constraint_repair(t):
    s = lambda k: (F.sum(F.when(F.col("o_orderstatus") == k, F.col("o_totalprice"))) / 1e6)
    df = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(s("F").alias("a"), s("O").alias("b"))
    return round_all(smoothing.repair_order(df, ["a", "b"], [("a", "b", 0.0, 1.0)]).select("d", "a", "b"), 8)


@query("""SELECT l_orderkey, l_linenumber, round(1.5 + CASE WHEN l_quantity <= 10 THEN 0.0 WHEN l_quantity >= 40 THEN 3.0 ELSE (l_quantity - 10) * 0.1 END + CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'R' THEN -0.25 ELSE 0 END, 6) AS pred FROM lineitem""")
def gam_replay_linear(t):
    r = gam.Replay([gam.Term("spline", "l_quantity", [10.0, 40.0], [0.0, 3.0]), gam.Term("factor", "l_returnflag", levels={"A": 0.5, "R": -0.25})], 1.5)
    return round_all(r.decompose(t.lineitem).select("l_orderkey", "l_linenumber", "pred"))


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(t):
    out = state.windowed(t.events, "ts", ["event_type"], "value", "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) i FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, i""")
def session_windows(t):
    out = state.sessions(t.events, "ts", U, "value", "4 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", rounded("total", 4).alias("total"))


# --- fitted models: no SQL form; tested by invariants and brute force ----------------------------------------------------


@query("""WITH m AS (SELECT avg(p_size) ma, stddev_pop(p_size) sa, avg(sqrt(p_partkey)) mb, stddev_pop(sqrt(p_partkey)) sb FROM part WHERE p_partkey % 20 <> 0),
z AS (SELECT p_partkey k, p_retailprice y, (p_size - ma) / sa * sqrt(0.5) a, (sqrt(p_partkey) - mb) / sb * sqrt(0.5) b FROM part, m), n AS (SELECT q.k, p.y, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2) d, row_number() OVER (PARTITION BY q.k ORDER BY sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2), p.k) i FROM z q JOIN z p ON q.k % 20 = 0 AND p.k % 20 <> 0)
SELECT k AS p_partkey, round(sum(y / d) / sum(1 / d), 4) AS prediction FROM n WHERE i <= 5 GROUP BY 1""")
def knn_predict(t):
    parts = t.part.withColumn("x", F.col("p_size").cast("double")).withColumn("z", F.sqrt("p_partkey"))
    m = neighbors.Neighbors(["x", "z"], "p_retailprice", 5, weights="distance").fit(parts.where("p_partkey % 20 <> 0"), "p_partkey")
    return round_all(m.predict(parts.where("p_partkey % 20 = 0"), "p_partkey"), 4)


@query()
def product_regression(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag")
    m = product.ProductModel([product.Block.ramps("quantity", "l_quantity", [10, 30]), product.Block.ramps("discount", "l_discount", [0.05])]).fit(df, "l_extendedprice", rounds=6)
    return df.select("l_orderkey", "l_linenumber", rounded(m.column(), 2).alias("prediction"))


@query()
def jump_model(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return jump.jump_states(daily, ["event_type"], ["d"], ["m", "s"], 2, 20.0, 4)


@query()
def gam_fit(t):
    terms = [gam.Spline("l_quantity", 1, 50, 6), gam.Factor("l_returnflag", ["A", "N", "R"])]
    m = gam.fit(t.lineitem, "l_extendedprice", terms)
    return t.lineitem.select("l_orderkey", "l_linenumber", rounded(m.column(), 2).alias("prediction"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) d, avg(value) a, CAST(count(*) AS DOUBLE) b FROM events GROUP BY 1, 2), l AS (SELECT a, b, lag(a) OVER w x, lag(b) OVER w z FROM d WINDOW w AS (PARTITION BY event_type ORDER BY d)),
c AS (SELECT avg(a) ma, avg(b) mb, avg(x) mx, avg(z) mz, var_pop(x) vx, var_pop(z) vz, covar_pop(x, z) xz, covar_pop(a, x) ax, covar_pop(a, z) az, covar_pop(b, x) bx, covar_pop(b, z) bz FROM l WHERE x IS NOT NULL),
k AS (SELECT *, (ax * vz - az * xz) / (vx * vz - xz * xz) ka, (az * vx - ax * xz) / (vx * vz - xz * xz) la, (bx * vz - bz * xz) / (vx * vz - xz * xz) kb, (bz * vx - bx * xz) / (vx * vz - xz * xz) lb FROM c)
SELECT term, series, round(v, 5) AS coefficient FROM (SELECT 0 AS term, 0 AS series, ma - ka * mx - la * mz AS v FROM k UNION ALL SELECT 0, 1, mb - kb * mx - lb * mz FROM k UNION ALL SELECT 1, 0, ka FROM k UNION ALL SELECT 1, 1, kb FROM k UNION ALL SELECT 2, 0, la FROM k UNION ALL SELECT 2, 1, lb FROM k)""")
def var_coefficients(t):
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("b"))
    m = tsa.vector_autoregression(daily, ["a", "b"], ["event_type"], ["d"], 1)
    rows = [(i, j, round(float(v), 5)) for i, r in enumerate(m["coefficients"]) for j, v in enumerate(r)]
    return t.spark.createDataFrame(rows, "term int, series int, coefficient double")


@query(f"""WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) d FROM events), l AS (SELECT user_id, d, lag(d) {_W}) d1, lag(d, 2) {_W}) d2, lag(d, 3) {_W}) d3 FROM d),
s AS (SELECT user_id, count(*) n, sum(d * d) v, sum(d * d1) c1, sum(d * d2) c2, sum(d * d3) c3 FROM l GROUP BY 1), r AS (SELECT user_id, n * (n + 2.0) k, (c1 / v) ** 2 / (n - 1) q1, (c2 / v) ** 2 / (n - 2) q2, (c3 / v) ** 2 / (n - 3) q3 FROM s)
SELECT user_id, 1 AS lag, round(k * q1, 5) AS q FROM r UNION ALL SELECT user_id, 2, round(k * (q1 + q2), 5) FROM r UNION ALL SELECT user_id, 3, round(k * (q1 + q2 + q3), 5) FROM r""")
def ljung_box(t):
    return round_all(tsa.ljung_box(_series(t), "value", U, O, 3).select("user_id", "lag", "q"), 5)


def _smoother() -> str:
    """SQL of the least-squares parabola of seven rows at each of them: the middle one, or the end window's."""
    hat = lambda i, j: 1 / 7 + (i - 3) * (j - 3) / 28 + ((i - 3) ** 2 - 4) * ((j - 3) ** 2 - 4) / 84
    at = lambda i, place, frame: " + ".join(f"{hat(i, j)!r} * nth_value(value, {place}{j + 1}) OVER {frame}" for j in range(7))
    cases = " ".join([*[f"WHEN i = {k + 1} THEN {at(k, '', 'h')}" for k in range(3)], *[f"WHEN n - i = {k} THEN {at(6 - k, 'n - 7 + ', 'h')}" for k in range(3)]])
    return f"""WITH e AS (SELECT *, row_number() {_W}) i, count(*) OVER (PARTITION BY user_id) n FROM events) SELECT event_id, round(CASE WHEN n < 7 THEN NULL {cases} ELSE {at(3, '', 'm')} END, 6) AS smooth FROM e
WINDOW h AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), m AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


@query(_smoother())
def savgol(t):
    return round_all(smoothing.savgol(_series(t).drop("event_type"), "value", U, O, 7, 2).select("event_id", "smooth"))


@query(f"""WITH e AS (SELECT event_id, user_id, CAST(event_id % 13 AS DOUBLE) x, CASE WHEN event_id % 4 <> 0 THEN value END y, row_number() {_W}) i FROM events),
p AS (SELECT a.event_id, b.x, b.y, CAST(row_number() OVER (PARTITION BY a.event_id ORDER BY b.i DESC) - 1 AS DOUBLE) k, count(*) OVER (PARTITION BY a.event_id) n FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 8 AND a.i - 1 WHERE a.i > 8 AND b.y IS NOT NULL),
w AS (SELECT *, exp(-k / (n - 1)) w FROM p WHERE n >= 4), m AS (SELECT *, sum(w * x) OVER g / sum(w) OVER g mx, sum(w * y) OVER g / sum(w) OVER g my FROM w WINDOW g AS (PARTITION BY event_id)),
l AS (SELECT event_id, sum(w * (x - mx) * (y - my)) / (sum(w * (x - mx) * (x - mx)) + 1) s, min(mx) mx, min(my) my FROM m GROUP BY 1)
SELECT event_id, round(last_value(s IGNORE NULLS) OVER f * x + last_value(my - s * mx IGNORE NULLS) OVER f, 6) AS imputed FROM e LEFT JOIN l USING (event_id) WINDOW f AS (PARTITION BY user_id ORDER BY i)""")
def ridge_imputer(t):
    df = _series(t).withColumn("x", (F.col("event_id") % 13).cast("double")).withColumn("y", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return round_all(smoothing.rolling_ridge_impute(df, "y", "x", U, O, 8, 1.0).select("event_id", "imputed"))
