"""Position and cash ledgers and the signal machine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]
CASH = "CASH"


def positions(df: DataFrame, keys: Names, order: Names, shares: str = "shares", price: str = "price", digits: int = 9) -> DataFrame:
    """A snapshot after every event (shares of 0 or null is a mark of the price alone).

    The average cost is that of all trades since the position was last flat. In closed form: shares are a running sum, an
    epoch counts the flat points before a row, and cost is a running sum within the epoch. Sums of shares are rounded to
    digits, so that a closed position is exactly flat.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    q = F.coalesce(F.col(shares), F.lit(0.0)).cast("double")
    df = df.withColumn("held", F.round(F.sum(q).over(w), digits))
    flat = ((F.col("held") == 0) & (q != 0)).cast("int")
    df = df.withColumn("__flat", flat)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__epoch", F.coalesce(F.sum("__flat").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "__epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = F.sum(q * F.coalesce(F.col(price), F.lit(0.0))).over(within)
    df = df.withColumn("cost", F.when(F.col("held") == 0, F.lit(0.0)).otherwise(cost))
    df = df.withColumn("avg_cost", F.when(F.col("held") == 0, F.lit(0.0)).otherwise(F.try_divide("cost", "held")))
    df = df.withColumn("market_price", F.last(price, ignorenulls=True).over(w))
    df = df.withColumn("market_value", F.col("held") * F.col("market_price"))
    return df.withColumn("pnl", F.col("market_value") - F.col("cost")).drop("__flat", "__epoch")


def cash(df: DataFrame, account: Names, order: Names, initial: Column, shares: str = "shares", price: str = "price") -> DataFrame:
    """The account's cash after every trade."""
    w = Window.partitionBy(*account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    paid = F.coalesce(F.col(shares) * F.col(price), F.lit(0.0))
    return df.withColumn("cash", initial - F.sum(paid).over(w))


def snapshot(ledger: DataFrame, account: Names, ticker: str, order: Names) -> DataFrame:
    """The last state of each position: shares, average cost, price, value, profit, by value in each account."""
    last = lambda c: F.max_by(c, F.struct(*order)).alias(c)
    return ledger.groupBy(*account, ticker).agg(*[last(c) for c in ("held", "avg_cost", "market_price", "market_value", "pnl")])


def totals(ledger: DataFrame, account: Names, ticker: str, order: Names) -> DataFrame:
    """Market value, profit and number of open positions of each account; the cash line is no position."""
    s = snapshot(ledger.where(F.col(ticker) != CASH), account, ticker, order)
    return s.groupBy(*account).agg(F.sum("market_value").alias("market_value"), F.sum("pnl").alias("pnl"), F.sum((F.col("held") != 0).cast("long")).alias("open_positions"))


def signal_positions(df: DataFrame, signal: str, keys: Names, order: Names, closing: str | None = None, out: str = "position") -> DataFrame:
    """-1, 0 or 1 after each row: flat takes the signal's side; the opposite signal closes and doesn't flip; a closing
    signal of 1 makes flat after that. Missing signals are 0. A state machine over the ordered series, so it runs in
    grouped Arrow batches, one series at a time."""
    from .windows import series

    def make(f):
        state, got = 0, []
        close = f[closing].fillna(0).to_numpy() if closing else [0] * len(f)
        for s, c in zip(f[signal].fillna(0).astype(int).to_numpy(), close, strict=True):
            state = s if state == 0 else 0 if s == -state else state
            if c == 1:
                state = 0
            got.append(state)
        return {out: got}

    return series(df, keys, order, {out: "int"}, make)
