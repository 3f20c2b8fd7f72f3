"""Order and transition plans over portfolios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tapeline.functions.finance import decision, mirror_label, order_side, whole_shares
from tapeline.operators.portfolio import P, normalise
from tapeline.operators.skew import salted_join


def _side_by_side(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Two holdings tables, one row per symbol in either, absent = 0."""
    return (a.select("portfolio_id", "symbol", F.col("value").alias(left))
            .join(b.select("portfolio_id", "symbol", F.col("value").alias(right)),
                  ["portfolio_id", "symbol"], "full")
            .na.fill(0.0, [left, right]))


def rebalance_orders(current: DataFrame, target: DataFrame, min_trade: float = 1.0) -> DataFrame:
    """Dollars to trade per symbol; positive buys, negative sells; tiny trades are skipped."""
    both = _side_by_side(current, target, "now", "target")
    change = F.col("target") - F.col("now")
    orders = both.withColumn("change", change).where(F.abs("change") >= min_trade)
    return orders.withColumn("side", order_side(F.col("change"), F.col("target")))


def mirror_status(paper: DataFrame, real: DataFrame, tolerance_pct: float = 5.0,
                  cannot_mirror: DataFrame | None = None) -> DataFrame:
    """Paper account against the real one. `cannot_mirror(portfolio_id, symbol)` names holdings that cannot
    be bought in paper; with none held they are marked so."""
    both = _side_by_side(real, paper, "real", "paper")
    both = both.withColumn("difference", F.col("paper") - F.col("real"))
    status = mirror_label(F.col("real"), F.col("difference"), tolerance_pct)
    if cannot_mirror is None:
        return both.withColumn("status", status)
    flagged = both.join(cannot_mirror.select("portfolio_id", "symbol", F.lit(True).alias("_no")),
                        ["portfolio_id", "symbol"], "left")
    blocked = F.coalesce("_no", F.lit(False)) & (F.col("paper") == 0)
    return flagged.withColumn("status", F.when(blocked, "can't mirror").otherwise(status)).drop("_no")


def mirror_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("portfolio_id").agg(
        F.count_if(F.col("status") == "in sync").alias("in_sync"),
        F.count_if(~F.col("status").isin("extra", "can't mirror")).alias("mirrorable"),
        F.count_if(F.col("status") == "extra").alias("extra"))


def scale_to_total(target: DataFrame, total: float) -> DataFrame:
    share = F.col("value") / F.sum("value").over(Window.partitionBy("portfolio_id"))
    return target.withColumn("value", share * F.lit(float(total)))


def screen_tradable(target: DataFrame, assets: DataFrame) -> DataFrame:
    """Target holdings with the reason they cannot be traded, null when they can."""
    joined = salted_join(target, assets.select("symbol", "tradable", "fractionable"), ["symbol"], "left")
    reason = (F.when(F.col("tradable").isNull(), "not found")
              .when(~F.col("tradable"), "not tradable")
              .when(~F.col("fractionable"), "whole shares only"))
    return joined.withColumn("reason", reason).drop("tradable", "fractionable")


def without_open_orders(plan: DataFrame, open_orders: DataFrame) -> DataFrame:
    """Any waiting order blocks the whole plan of its account."""
    return plan.join(open_orders.select("portfolio_id").distinct(), "portfolio_id", "left_anti")


def transition_plan(holdings: DataFrame, split: DataFrame, funds: DataFrame, months: int,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Value of every holding at month 0..n while single stocks are sold evenly into funds.

    `split(portfolio_id, symbol, weight)` is scaled to one. Each month is a straight line from
    today's value, so no month depends on the one before.
    """
    flagged = salted_join(holdings.select("portfolio_id", "symbol", "value"),
                          funds.select("symbol", F.lit(True).alias("_fund")), ["symbol"], "left")
    sold = F.col("_fund").isNull()
    if keep:
        sold = sold & ~F.col("symbol").isin(*keep)
    flagged = flagged.withColumn("_sold", sold).drop("_fund")
    slices = flagged.groupBy("portfolio_id").agg(
        (F.coalesce(F.sum(F.when(F.col("_sold"), F.col("value"))), F.lit(0.0)) / months).alias("_slice"))
    shares = normalise(split.select("portfolio_id", "symbol", "weight"))
    lines = (flagged.join(shares, ["portfolio_id", "symbol"], "full")
             .join(slices, "portfolio_id")
             .na.fill(0.0, ["value", "weight"]).na.fill(False, ["_sold"]))
    slope = (F.col("_slice") * F.col("weight")
             - F.when(F.col("_sold"), F.col("value") / months).otherwise(F.lit(0.0)))
    each = lines.withColumn("_slope", slope).withColumn(
        "month", F.explode(F.sequence(F.lit(0), F.lit(months))))
    return each.select("portfolio_id", "month", "symbol",
                       F.greatest(F.lit(0.0), F.col("value") + F.col("month") * F.col("_slope"))
                       .alias("value"), F.col("_sold").alias("sold"))


def monthly_orders(plan: DataFrame) -> DataFrame:
    """The order list every month repeats: month 1 minus month 0, to the cent (the first rounding
    takes off the noise of the subtraction, so half cents go one way)."""
    step = F.sum(F.when(F.col("month") == 1, F.col("value")).otherwise(-F.col("value")))
    steps = plan.where(F.col("month").isin(0, 1)).groupBy("portfolio_id", "symbol").agg(
        F.round(F.round(step, 6), 2).alias("change"))
    return (steps.where(F.col("change") != 0)
            .withColumn("side", F.when(F.col("change") < 0, "sell").otherwise("buy")))


def order_fees(holdings: DataFrame, orders: DataFrame, steps: Sequence[int], fee: float) -> DataFrame:
    """Cost of spreading the move over more or fewer steps."""
    total = holdings.groupBy("portfolio_id").agg(F.sum("value").alias("total"))
    per_step = orders.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("orders_per_step"))
    each = per_step.join(total, "portfolio_id").withColumn(
        "steps", F.explode(F.array(*[F.lit(int(s)) for s in steps])))
    fees = F.col("steps") * F.col("orders_per_step") * F.lit(float(fee))
    return each.select("portfolio_id", "steps", (F.col("steps") * F.col("orders_per_step")).alias("orders"),
                       fees.alias("fees"), (F.try_divide(fees, F.col("total")) * 100.0).alias("fees_pct"))


def plan_checkpoints(months: int) -> list[int]:
    return sorted({0, months // 4, months // 2, 3 * months // 4, months})


def _spend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether each row's cost fits into what its account has left, which starts from the account's opening
    row; null for rows that cost nothing and accounts without cash. An account may go on in the next batch."""
    account, left = None, None
    for batch in batches:
        fits: list[bool | None] = []
        for key, cost, cash in zip(*(batch.column(c).to_pylist() for c in ("portfolio_id", "_cost", "_cash"))):
            if key != account:
                account, left = key, None
            left = left if cash is None else cash
            fit = None if cost is None or left is None else cost <= left
            if fit:
                left -= cost
            fits.append(fit)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.bool_())], [*batch.schema.names, "_fits"])


def purchase_plan(signals: DataFrame, cash: DataFrame, budget: float, min_days: int) -> DataFrame:
    """Decide every watchlist entry in order, spending only the cash that is left.

    `signals(portfolio_id, pos, symbol, days, own, price, average, held, pending)`. Whether an entry
    fits depends on which earlier ones did: rows lie sorted by account and position, and a task walks
    them once with the cash that is left, so a watchlist of any length is never held as a whole.
    """
    action = decision(F.col("own"), F.col("held"), F.col("pending"))
    rows = (signals.withColumn("action", F.when(F.col("days") < min_days, "SHORT").otherwise(action))
            .withColumn("_wanted", whole_shares(F.lit(float(budget)), F.col("price")))
            .withColumn("_cost", F.when((F.col("action") == "BUY") & (F.col("_wanted") > 0),
                                        (F.col("_wanted") * F.col("price")).cast("double")))
            .select("portfolio_id", "pos", "symbol", "action", "price", "average", "held", "_wanted", "_cost",
                    F.lit(None).cast("double").alias("_cash")))
    # an account's cash is its first row. The shuffle is by a hash of the account: one by the account itself may
    # be taken over from a join before it, which adaptive execution is free to read in other pieces
    opening = cash.where(F.col("cash").isNotNull()).select("portfolio_id", F.col("cash").cast("double").alias("_cash"))
    lined_up = (rows.unionByName(opening, allowMissingColumns=True).repartition(F.xxhash64("portfolio_id"))
                .sortWithinPartitions("portfolio_id", F.col("_cash").asc_nulls_last(), "pos"))
    schema = T.StructType(lined_up.schema.fields + [T.StructField("_fits", T.BooleanType())])
    out = lined_up.mapInArrow(_spend, schema).where(F.col("_cash").isNull())
    buying = F.col("action") == "BUY"
    final = (F.when(F.col("action") == "SHORT", "SKIPPED")
             .when(buying & ~F.coalesce("_fits", F.lit(False)), "SKIPPED").otherwise(F.col("action")))
    note = (F.when(F.col("action") == "SHORT", "not enough price history")
            .when(buying & (F.col("_wanted") == 0), "one share costs more than the budget")
            .when(buying & ~F.col("_fits"), "not enough cash").otherwise(""))
    shares = (F.when(final == "BUY", F.col("_wanted")).when(final.isin("SELL", "HOLD"), F.col("held"))
              .otherwise(F.lit(0)).cast("bigint"))
    short = F.col("action") == "SHORT"
    zero = F.lit(0.0)
    return out.select("portfolio_id", "pos", "symbol", final.alias("action"), shares.alias("shares"),
                      F.when(short, zero).otherwise(F.col("price")).alias("price"),
                      F.when(short, zero).otherwise(F.col("average")).alias("average"),
                      note.alias("note"))


def decision_counts(decisions: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    return decisions.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n"))


def pending_flag(positions: DataFrame, open_orders: DataFrame) -> DataFrame:
    waiting = open_orders.select("portfolio_id", "symbol").distinct().withColumn("_w", F.lit(True))
    return (positions.join(waiting, ["portfolio_id", "symbol"], "left")
            .withColumn("pending", F.col("_w").isNotNull()).drop("_w"))
