"""Scalar column expressions for prices, risk and planning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapeline.functions import fixed


def pct(ratio: Column) -> Column:
    """Share or return as a percentage."""
    return ratio * F.lit(100.0)


def annualise(daily_std: Column) -> Column:
    """Daily standard deviation -> yearly volatility in %."""
    return daily_std * F.sqrt(F.lit(float(fixed.TRADING_DAYS_PER_YEAR))) * F.lit(100.0)


def typical_month(volatility: Column) -> Column:
    """Move that next month stays within in about two months out of three."""
    return volatility / F.sqrt(F.lit(12.0))


def bad_month(volatility: Column) -> Column:
    """Roughly one month in twenty is worse than this."""
    return -F.lit(fixed.BAD_MONTH_FACTOR) * typical_month(volatility)


def euro_return(usd_return: Column, fx_return: Column) -> Column:
    """Return in euros; a missing currency change counts as none."""
    return (1.0 + usd_return) / (1.0 + F.coalesce(fx_return, F.lit(0.0))) - 1.0


def euro_total_pct(usd_pct: Column, fx_pct: Column) -> Column:
    return ((1.0 + usd_pct / 100.0) / (1.0 + fx_pct / 100.0) - 1.0) * 100.0


def currency_part_pct(usd_pct: Column, fx_pct: Column) -> Column:
    return euro_total_pct(usd_pct, fx_pct) - usd_pct


def verdict(p_value: Column) -> Column:
    return (F.when(p_value < 0.01, "very unlikely to be luck")
            .when(p_value < 0.05, "unlikely to be luck")
            .when(p_value < 0.20, "weak - could be luck")
            .when(p_value.isNotNull(), "looks like luck"))


def decision(rule_own: Column, held: Column, pending: Column) -> Column:
    """Bot action: a waiting order blocks; otherwise the rule against what is held."""
    return (F.when(pending, "WAIT")
            .when(rule_own & (held > 0), "HOLD")
            .when(rule_own, "BUY")
            .when(held > 0, "SELL")
            .otherwise("STAY OUT"))


def simple_decision(rule_own: Column, held: Column, pending: Column) -> Column:
    """Variant without STAY OUT: already where the rule wants us is HOLD."""
    return (F.when(pending, "WAIT")
            .when(rule_own & (held == 0), "BUY")
            .when(~rule_own & (held > 0), "SELL")
            .otherwise("HOLD"))


def whole_shares(budget: Column, price: Column) -> Column:
    return F.when(price > 0, F.floor(budget / price)).otherwise(F.lit(0)).cast("bigint")


def mirror_label(real: Column, difference: Column, tolerance_pct: float = 5.0) -> Column:
    gap = F.try_divide(difference, real) * 100.0
    return (F.when(real == 0, "extra")
            .when(F.abs(gap) <= tolerance_pct, "in sync")
            .when(gap > 0, "too much")
            .otherwise("too little"))


def risk_flag(risk_pct: Column, money_pct: Column) -> Column:
    """True where a holding carries far more risk than money."""
    return risk_pct > money_pct * 1.5


def order_side(change: Column, target: Column) -> Column:
    return (F.when(F.coalesce(target, F.lit(0.0)) == 0, "SELL ALL")
            .when(change < 0, "SELL")
            .otherwise("BUY"))
