"""Fixed values. They must equal the published tables for results to agree."""

from __future__ import annotations

# The market's calendar, and the parameters of forecasts, costs and the crawl.
TRADING_DAYS_PER_YEAR = 252
MARKET_ZONE = "America/New_York"
CLOSE_HOUR = 16
SESSION_OPEN, SESSION_LAST_MINUTE = "09:30", "15:59"
MONTH_ROWS = 21
BAD_MONTH_FACTOR = 1.65
EWMA_LAMBDA = 0.94
SWITCH_COST = 0.001
ETF_SWAP_DEFAULT = 0.20
FX_SYMBOL = "FXE"
MIN_ARTICLE_CHARS = 300
SKIP_SITES = ("finance.yahoo.com",)

# Look-back rows of the volatility methods.
VOLATILITY_WINDOWS = {"last month": 21, "3 months": 63, "1 year": 252}

# Look-back rows of the performance periods.
PERIODS = {"1 week": 5, "1 month": 21, "3 months": 63, "1 year": 252}

# Moving-average settings of the sweep.
SWEEP_WINDOWS = tuple(range(10, 201, 5))

# Sector of each known symbol.
SECTORS = {
    "AAPL": "Tech", "MSFT": "Tech", "NVDA": "Tech", "AMD": "Tech", "INTC": "Tech",
    "GOOGL": "Tech", "META": "Tech", "LITE": "Tech", "AVGO": "Tech",
    "AMZN": "Consumer", "TSLA": "Consumer", "NFLX": "Consumer", "WMT": "Consumer",
    "COST": "Consumer", "KO": "Consumer", "PEP": "Consumer", "HD": "Consumer",
    "JPM": "Finance", "BAC": "Finance", "GS": "Finance",
    "XOM": "Energy", "CVX": "Energy", "JNJ": "Health", "PFE": "Health", "CAT": "Industrial",
    "ORCL": "Tech", "ZS": "Tech", "MRVL": "Tech", "QBTS": "Tech",
    "CEG": "Utilities", "BAYRY": "Health", "SPCX": "Industrial",
    "SPY": "Fund: S&P 500", "QQQ": "Fund: Nasdaq 100", "URTH": "Fund: MSCI World",
}

# Symbols treated as funds.
FUNDS = ("SPY", "VOO", "IVV", "VTI", "QQQ", "URTH", "ACWI", "VT", "VEA", "VWO",
         "IEFA", "EFA", "AGG", "BND")

# Names of the market and sector funds in the overview.
MARKET_NAMES = {
    "SPY": "S&P 500", "URTH": "MSCI World", "QQQ": "Nasdaq 100", "XLK": "Tech",
    "XLF": "Finance", "XLV": "Health", "XLE": "Energy", "XLU": "Utilities",
    "XLI": "Industrial", "XLY": "Consumer",
}

# The sentiment word lists.
POSITIVE_WORDS = (
    "beat", "beats", "surge", "surges", "soar", "soars", "jump", "jumps", "rally", "rallies",
    "gain", "gains", "rise", "rises", "climb", "climbs", "record", "strong", "stronger",
    "upgrade", "upgrades", "upgraded", "outperform", "bullish", "boost", "boosts", "raises",
    "growth", "profit", "profits", "win", "wins", "approval", "approved", "high", "higher",
)
NEGATIVE_WORDS = (
    "miss", "misses", "fall", "falls", "drop", "drops", "plunge", "plunges", "slump", "slumps",
    "sink", "sinks", "tumble", "tumbles", "decline", "declines", "loss", "losses", "weak",
    "weaker", "downgrade", "downgrades", "downgraded", "underperform", "bearish", "cut", "cuts",
    "lawsuit", "probe", "investigation", "recall", "layoffs", "warning", "warns", "low", "lower",
    "fine", "fined", "ban", "concerns", "fears",
)

LABELS = ("positive", "negative", "neutral")
