"""Small fixtures shared by the tests."""

import datetime as dt

import pandas as pd

CLOSES = "symbol string, day date, close double"
RETURNS = "symbol string, day date, r double"


def weekdays(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def closes(spark, **series):
    """One keyword per symbol: its prices on consecutive weekdays, None for a gap."""
    rows = [(s, d, None if p is None else float(p)) for s, values in series.items()
            for d, p in zip(weekdays(len(values)), values)]
    return spark.createDataFrame(rows, CLOSES)


def returns(spark, frame: pd.DataFrame):
    """A wide frame of daily returns, one column per symbol, on consecutive weekdays."""
    days = weekdays(len(frame))
    rows = [(s, d, float(x)) for s in frame for d, x in zip(days, frame[s]) if x == x]
    return spark.createDataFrame(rows, RETURNS)


def utc(text):
    return dt.datetime.fromisoformat(text)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
