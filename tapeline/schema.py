"""Table contracts. Every source is read with one of these; nothing is inferred.

`closes` is unique on (symbol, day): sources aggregate to that grain before any window, so a
window per symbol is bounded by the number of trading days whatever the symbol's share of trades.
"""

from __future__ import annotations

CLOSES = "symbol string, day date, close double"
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
TRADES = "symbol string, ts timestamp, price double, size double, trade_id bigint"
NEWS = ("url string, headline string, summary string, source string, published timestamp, "
        "symbols array<string>")
ARCHIVE = ("published timestamp, symbols array<string>, source string, headline string, "
           "summary string, url string, text_status string")
ARTICLES = "article_id string, url string, text string, n_chars int"
SCORES = "text string, positive double, negative double, neutral double"
HOLDINGS = "portfolio_id bigint, symbol string, name string, value double, profit double"
HOLDINGS_CSV = "symbol string, name string, value_eur double, profit_eur double"
WEIGHTS = "portfolio_id bigint, symbol string, weight double"
DIVIDENDS = "symbol string, ex_date date, payable_date date, rate double, special boolean"
EQUITY = "portfolio_id bigint, ts bigint, equity double"
DECISIONS = ("time timestamp, symbol string, action string, shares bigint, price double, "
             "average double, note string, sent boolean, run_date date")
ROBOTS = "host string, ord int, path_prefix string, allow boolean"
RSS_ITEM = "title string, link string, pubDate string, description string"
POSITIONS = "symbol string, asset_class string, qty string, market_value string, unrealized_plpc string"
