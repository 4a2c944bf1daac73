"""Stores, caches, files, streams and fitted curves over the supplied tables: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, curves, dates, text
from ..models import fits, gam, linear, product, tsa
from ..operators import filters, folds, smoothing, windows
from ..sources import export, identifiers, readers, registry
from ..streaming import state
from .registry import query, round_all, rounded

U, O = ["user_id"], ["ts", "event_id"]
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query("""SELECT 'C' || c_custkey AS cusip, CASE WHEN c_custkey % 2 = 0 THEN 'new' || c_nationkey ELSE 'I' || c_custkey END AS isin, CASE WHEN c_custkey % 2 = 1 THEN 'T' || c_custkey END AS ticker, c_custkey % 3 = 0 AS invalid FROM customer""")
def identifier_store(t):
    """Mappings added and in part overwritten, with the ids known to be invalid."""
    store = identifiers.IdentifierStore(t.spark, readers.scratch(t.spark))
    key = F.col("c_custkey").cast("string")
    store.add(t.customer.select(F.concat(F.lit("C"), key).alias("CUSIP"), F.concat(F.lit("I"), key).alias("isin"), F.concat(F.lit("T"), key).alias("ticker")))
    even = t.customer.where("c_custkey % 2 = 0")
    store.add(even.select(F.concat(F.lit("C"), key).alias("cusip"), F.concat(F.lit("new"), F.col("c_nationkey").cast("string")).alias("isin")))
    bad = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("C"), key).alias("identifier"), F.current_timestamp().alias("first_seen"))
    store.bad.replace(bad)
    known = store.invalid().select(F.col("identifier").alias("cusip"), F.lit(True).alias("invalid"))
    return store.mappings().select("cusip", "isin", "ticker").join(known, "cusip", "left").withColumn("invalid", F.coalesce("invalid", F.lit(False)))


@query("""SELECT * FROM (SELECT 'written' AS step, count(*) AS "rows" FROM orders UNION ALL SELECT 'replaced', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'cleared', 0)""")
def table_versions(t):
    """Row counts of a table that is written, replaced by a part of itself, and cleared."""
    table = readers.Table(t.spark, readers.scratch(t.spark), "o_orderkey long, o_orderstatus string")
    counts = [("written", table.replace(t.orders.select("o_orderkey", "o_orderstatus")))]
    counts.append(("replaced", table.replace(table.read().where("o_orderstatus = 'F'"))))
    table.clear()
    counts.append(("cleared", table.count()))
    table.drop()
    return t.spark.createDataFrame(counts, "step string, rows long")


@query("""SELECT l_returnflag, l_orderkey, l_quantity FROM lineitem WHERE l_returnflag <> 'N'""")
def partitioned_files(t):
    """A pruned copy in folders by flag, read through the registry of named datasets."""
    path = readers.scratch(t.spark)
    readers.write(filters.select_for_formula(t.lineitem, "l_quantity ~ l_returnflag", ["l_orderkey"]), path, partition_by=("l_returnflag",))
    pins, name = registry.Pins(t.spark), "lines_by_flag"
    pins.drop(name)
    readers.read(t.spark, path).createOrReplaceTempView("pin_" + name)
    return pins.get(name).where("l_returnflag <> 'N'").select("l_returnflag", "l_orderkey", "l_quantity")


@query("""SELECT 'csv' AS form, c_custkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 'json', c_custkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 'orc', c_custkey, c_acctbal, c_mktsegment FROM customer""")
def file_formats(t):
    df, schema = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey long, c_acctbal double, c_mktsegment string"
    out = None
    for form in ("csv", "json", "orc"):
        path = readers.scratch(t.spark)
        readers.write(df, path, form, **({"header": "true"} if form == "csv" else {}))
        part = readers.read(t.spark, path, form, schema).select(F.lit(form).alias("form"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def cached_result(t):
    """A total whose second call reads the first one's file."""
    cache, made = registry.ResultCache(t.spark, readers.scratch(t.spark), 3600.0), []

    def totals(df):
        made.append(1)
        return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    cache.get("totals", totals, t.orders)
    out = cache.get("totals", totals, t.orders)
    if len(made) != 1:
        raise AssertionError("the second call was computed again")
    return out


@query("""SELECT c_custkey::VARCHAR AS "Key", c_mktsegment AS "Segment", format('{:,.1f}', c_acctbal * 2) AS "Twice", strftime(DATE '2024-01-01' + c_nationkey::INTEGER, '%Y-%m-%d') AS "Day" FROM customer""")
def sheet_rows(t):
    """A sheet written by its column schema, as text."""
    rows = t.customer.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey")))
    spec = export.ColumnSpec
    schema = export.ColumnSchema([spec("c_custkey", "Key"), spec("c_mktsegment", "Segment"), spec("c_acctbal", "Twice", "number", 1, lambda c: c * 2), spec("day", "Day", "date"), spec("c_name", "Name")])
    path = readers.scratch(t.spark)
    export.write_sheets(path, {"customers": rows}, {"customers": schema.where(lambda s: s.title != "Name")})
    return readers.read(t.spark, f"{path}/customers", "csv", "Key string, Segment string, Twice string, Day string")


@query("""SELECT DATE '2023-01-02' + d::INTEGER AS date, printf('L%06d', d * 4 + i) AS loan_id, true AS priced, true AS funded FROM range(30) a(d), range(40) b(i)""")
def generated_loans(t):
    """Generated loans: which are quoted on a day is fixed, and prices and balances keep their ranges."""
    loans = registry.loan_prices(t.spark, 30, 40, 0.9)
    return loans.select("date", "loan_id", F.col("price").between(90, 108).alias("priced"), F.col("balance").between(100_000, 999_999).alias("funded"))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '1-URGENT'""")
def filter_criteria(t):
    """Conditions as objects, in nested lists."""
    c = filters.Criteria
    rows = filters.filter_frame(t.orders, [c("o_totalprice", ">", 50000), [c("o_orderstatus", "in", ["F", "O"]), c("o_orderpriority", "!=", "1-URGENT")]])
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50""")
def sorted_head(t):
    """The first fifty rows of a filter sorted up, down and up: the sort decides which they are."""
    rows = filters.filter_frame(t.orders, [("o_totalprice", ">", 1000)], ["o_orderstatus", "o_totalprice", "o_orderkey"], [True, False, True])
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice").limit(50)


@query("""WITH f AS (SELECT *, l_extendedprice / (l_quantity + 0.3) AS unit FROM lineitem WHERE l_returnflag <> 'R'), q AS (SELECT quantile_cont(unit, 0.05) lo, quantile_cont(unit, 0.9) hi FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(lo, least(hi, unit)), 5) AS unit, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'filled' END AS state, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS state_idx FROM f, q""")
def preprocessed(t):
    """A derived feature, a filter, clips learnt on what the filter kept, and a category with its place."""
    steps = filters.Preprocessor(
        derived={"unit": lambda df: F.col("l_extendedprice") / (F.col("l_quantity") + 0.3)},
        filters=[("l_returnflag", "!=", "R")],
        clips=[filters.Clip("unit", lower_q=0.05, upper_q=0.9)],
        categories=[filters.Category("l_linestatus", "state", ["open", "filled"], {"O": "open", "F": "filled"})],
    )
    out = steps.fit_transform(t.lineitem)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rounded("unit", 5).alias("unit"), "state", F.col("state_idx").cast("int").alias("state_idx"))


@query("""SELECT event_id, value * 2 AS val, user_id FROM events""")
def alias_columns(t):
    """Of columns that mean the same, the last named stays."""
    df = t.events.select("event_id", "value", (F.col("value") * 2).alias("val"), "user_id")
    return filters.drop_aliases(df, [["value", "val"], ["user", "user_id"]], "last")


@query("""SELECT l_orderkey, l_tax, l_quantity, l_discount, l_extendedprice, l_returnflag FROM lineitem""")
def formula_columns(t):
    """The columns that a model formula and its extra key need."""
    return filters.select_for_formula(t.lineitem, "l_tax ~ s(l_quantity, k=5) + te(l_discount, l_extendedprice) + l_returnflag", ["l_orderkey"])


@query("""SELECT event_id, event_type FROM events ORDER BY CAST('0x' || substr(md5('7:' || event_id), 1, 8) AS BIGINT), event_id LIMIT 150""")
def sampled_rows(t):
    """Exactly 150 rows by the place of their hashed id."""
    return filters.sample_rows(t.events, 150, "event_id", 7).select("event_id", "event_type")


@query(f"""SELECT event_id, lead(value) {_W}) AS next_value, round(lead(epoch_us(ts)) {_W}) / 1e6 - epoch_us(ts) / 1e6, 3) AS seconds FROM events""")
def next_rows(t):
    """Each row with its user's next one."""
    w = windows.over(U, O)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("event_id", F.lead("value").over(w).alias("next_value"), F.round(F.lead(at).over(w) - at, 3).alias("seconds"))


@query("""SELECT cut, round(avg(score), 9) AS score FROM (SELECT cut, o_orderpriority, avg(CASE WHEN (o_totalprice > cut) = (o_orderstatus = 'F') THEN 1.0 ELSE 0.0 END) AS score FROM orders, (VALUES (50000.0), (100000.0), (200000.0), (400000.0)) g(cut) GROUP BY 1, 2) GROUP BY 1""")
def grid_scores(t):
    """Mean score per parameter of a search over a small grid, folds being the priorities."""
    grid = t.spark.createDataFrame([(50000.0,), (100000.0,), (200000.0,), (400000.0,)], "cut double")
    right = (F.col("o_totalprice") > F.col("cut")) == (F.col("o_orderstatus") == "F")
    score = lambda df: df.groupBy("cut", "o_orderpriority").agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("score"))
    return round_all(folds.mean_scores(folds.grid_search(t.orders, ["cut"], grid, score), "cut"), 9)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y') AS short, strftime(o_orderdate, '%Y%m%d') AS packed, (SELECT min(o_orderdate) = min(l_shipdate) AND max(o_orderdate) = max(l_shipdate) FROM orders, (SELECT min(l_shipdate) l_shipdate FROM lineitem UNION ALL SELECT max(l_shipdate) FROM lineitem)) AS same_span FROM orders""")
def date_texts(t):
    """Dates as text by C-style directives, and whether orders and shipments span the same days."""
    span = checks.same_range(t.orders.select(F.col("o_orderdate").alias("d")), t.lineitem.select(F.col("l_shipdate").alias("d")), "d")
    rows = t.orders.select("o_orderkey", dates.date_text("o_orderdate", "%d/%m/%y").alias("short"), dates.date_text("o_orderdate", "%Y%m%d").alias("packed"))
    return rows.join(F.broadcast(span.withColumnRenamed("ok", "same_span")))


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1000.0 WHEN 1 THEN c_custkey * 1000 + 0.25 WHEN 2 THEN (c_custkey + 0.5) * 1e6 + 0.125 ELSE (c_custkey + 1) / 1048576.0 END v FROM customer)
SELECT c_custkey, CASE WHEN v = round(v) THEN format('{:,.0f}', v) WHEN v >= 1e-4 AND v < 1e6 AND abs(round(v, 2) - v) <= v * 1e-3 THEN printf('%.2f', v) WHEN v >= 1e-4 AND v < 1e6 AND abs(round(v, 4) - v) <= v * 1e-3 THEN printf('%.4f', v) ELSE printf('%.2e', v) END AS label FROM x""")
def adaptive_numbers(t):
    """Numbers over many sizes as text that keeps a thousandth."""
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, k * 1000.0).when(k % 4 == 1, k * 1000 + F.lit(0.25)).when(k % 4 == 2, (k + 0.5) * 1e6 + F.lit(0.125)).otherwise((k + 1) / F.lit(1048576.0))
    return t.customer.select("c_custkey", text.adaptive_number(v).alias("label"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN value END AS safe, value AS strict FROM events""")
def finite_numbers(t):
    """NaN and infinity become null where a text format has none; finite numbers pass the strict check."""
    m = F.col("event_id") % 5
    odd = F.when(m == 3, F.lit(float("nan"))).when(m == 4, F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", text.json_safe(odd).alias("safe"), text.strict_number("value").alias("strict"))


@query("""WITH x AS (SELECT p_partkey, p_size / 25.0 a, (50 - p_size) / 25.0 b FROM part)
SELECT p_partkey, round(CASE WHEN a <= 1 THEN 1 * (1 - a) * (1 - a) + 3 * (a * (1 - a) + a * (2 - a) / 2) + 2 * a * a / 2 ELSE 5 * (1 - b) * (1 - b) + 2 * (b * (1 - b) + b * (2 - b) / 2) + 3 * b * b / 2 END, 6) AS y FROM x""")
def bspline_eval(t):
    """A quadratic B-spline with one inner knot."""
    return round_all(t.part.select("p_partkey", curves.bspline("p_size", [0, 0, 0, 25, 50, 50, 50], [1, 3, 2, 5], 2).alias("y")))


@query("""SELECT p_partkey, round((p_size - 25.5) / 14.5, 6) AS z, round(0.2 * s / (0.2 * s + 1 - s), 6) AS corrected FROM (SELECT *, p_size / 51.0 s FROM part)""")
def given_scales(t):
    """A feature by a given mean and scale, and a score of a thinned sample back on the whole population."""
    return round_all(t.part.select("p_partkey", curves.standardized("p_size", 25.5, 14.5).alias("z"), curves.prior_corrected(F.col("p_size") / 51.0, 0.2).alias("corrected")))


@query("""WITH z AS (SELECT p_partkey, least(greatest(p_size, 10), 40) / 10.0 - 1 z FROM part) SELECT p_partkey, round(CASE WHEN z < 1 THEN 5 - 3 * z WHEN z < 2 THEN 2 - (z - 1) ELSE 1 - 0.5 * (z - 2) END, 6) AS level FROM z""")
def curve_lookup(t):
    """A stored curve on an even grid, read at each part's size and held at its ends."""
    curve = F.array(*[F.lit(v) for v in (5.0, 2.0, 1.0, 0.5)])
    return round_all(t.part.select("p_partkey", smoothing.curve_value(curve, "p_size", 10, 40, 4).alias("level")))


@query(f"""WITH p AS (SELECT user_id, value y, lag(value) {_W}) x FROM events),
f AS (SELECT user_id, 1 - regr_slope(y, x) theta, regr_intercept(y, x) / (1 - regr_slope(y, x)) mu, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / regr_count(y, x)) sigma FROM p GROUP BY 1),
v AS (SELECT *, 2 * theta - theta * theta AS v FROM f) SELECT user_id, CASE WHEN v > 0 THEN round(mu - 2 * sigma / sqrt(v), 5) END AS lower, CASE WHEN v > 0 THEN round(mu + 2 * sigma / sqrt(v), 5) END AS upper FROM v""")
def reversion_bands(t):
    """Bands of two stationary deviations about each user's mean-reverting level."""
    got = linear.mean_reversion(t.events, "value", U, O)
    return round_all(linear.reversion_bands(got, 2).select("user_id", "lower", "upper"), 5)


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) k, avg(l_extendedprice) ym, avg(l_quantity) xm FROM lineitem), b AS (SELECT *, least(greatest(k, 0), 1000) c FROM f) SELECT round(c, 6) AS slope, round(ym - c * xm, 4) AS intercept FROM b""")
def bounded_slope(t):
    """Least squares whose slope is held to a range that binds."""
    line = linear.constrained(t.lineitem, "l_extendedprice", ["l_quantity"], {"l_quantity": (0.0, 1000.0)})
    return round_all(t.spark.createDataFrame([(float(line.coefficients[0]), line.intercept)], "slope double, intercept double").select(rounded("slope").alias("slope"), rounded("intercept", 4).alias("intercept")), 6)


@query(f"""WITH a AS (SELECT user_id, ts, event_id, value - lag(value) {_W}) y, lag(value) {_W}) x FROM events), b AS (SELECT y, x, lag(y) {_W}) z FROM a), r AS (SELECT * FROM b WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
s AS (SELECT count(*) n, var_pop(x) * count(*) xx, var_pop(z) * count(*) zz, var_pop(y) * count(*) yy, covar_pop(x, z) * count(*) xz, covar_pop(x, y) * count(*) xy, covar_pop(z, y) * count(*) zy FROM r),
k AS (SELECT *, xx * zz - xz * xz det, (xy * zz - zy * xz) / (xx * zz - xz * xz) kx, (zy * xx - xy * xz) / (xx * zz - xz * xz) kz FROM s)
SELECT n AS "rows", round(kx / sqrt((yy - kx * xy - kz * zy) / (n - 3) * zz / det), 5) AS t FROM k""")
def unit_root(t):
    """The unit-root statistic of the users' pooled values with one lagged step."""
    got = tsa.adf(t.events, "value", U, O, 1)
    return t.spark.createDataFrame([(got["rows"], round(got["t"], 5))], "rows long, t double")


@query("""SELECT l_returnflag, round(regr_intercept(l_extendedprice / 1000, l_quantity), 3) AS a, round(regr_slope(l_extendedprice / 1000, l_quantity), 3) AS b FROM lineitem GROUP BY 1""")
def curve_fits(t):
    """A curve of given form fitted to each flag's points; a straight one, so that regression gives the same."""
    df = t.lineitem.withColumn("y", F.col("l_extendedprice") / 1000)
    points = fits.points_of(df, "l_quantity", "y", keys=["l_returnflag"])
    return round_all(fits.fit_groups(points, ["l_returnflag"], lambda x, a, b: a + b * x, ["a", "b"], [1.0, 1.0]), 3)


@query("""SELECT p_partkey, round(0.5 + (p_size - 1) / 49.0 + CASE p_type WHEN 'ECONOMY' THEN 0.25 WHEN 'PROMO' THEN -0.5 ELSE 0 END, 6) AS pred, round(2 * (1 + 0.02 * p_size), 6) AS product FROM part""")
def stored_models(t):
    """Scores of an additive and of a product model that went through their JSON."""
    import numpy as np

    r = gam.Replay([gam.Term("spline", "p_size", [1.0, 50.0], [0.0, 1.0]), gam.Term("factor", "p_type", levels={"ECONOMY": 0.25, "PROMO": -0.5})], 0.5)
    again = gam.Replay.from_json(r.to_json())
    make = lambda: product.ProductModel([product.Block("size", lambda: [F.lit(1.0), F.col("p_size")])], scalar=2.0)
    m = make()
    m.coefficients = {"size": {None: np.array([1, 0.02])}}
    return round_all(t.part.select("p_partkey", again.column().alias("pred"), make().load(m.to_json()).column().alias("product")))


def _streamed(t, columns):
    """events as a stream of one file."""
    rows = t.events.select(*columns)
    path = readers.scratch(t.spark)
    readers.write(rows, path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


@query("""SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def streamed_latest(t):
    """Each user's latest event, kept by a stream's upserting sink."""
    table = readers.Table(t.spark, readers.scratch(t.spark), "user_id long, event_id long, value double")
    stream = _streamed(t, ["user_id", "event_id", "value"])
    run = stream.writeStream.foreachBatch(state.upserting(table, U, "event_id")).option("checkpointLocation", readers.scratch(t.spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()


@query("""SELECT event_type, round(avg(value), 6) AS level, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 3""")
def streamed_daily(t):
    """Daily levels that a stream appends in a folder per batch."""
    path = readers.scratch(t.spark)
    make = lambda b: b.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("level"))
    run = _streamed(t, ["event_type", "ts", "value"]).writeStream.foreachBatch(state.appending_curves(path, make, "day")).option("checkpointLocation", readers.scratch(t.spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema("event_type string, day date, level double, batch long").parquet(path).drop("batch")
