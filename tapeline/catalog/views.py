"""The driver's tables seen as market data, once for Spark and once for SQL.

Daily averages of invented prices jump by orders of magnitude, so they are scaled and lifted to
look like prices: growth over years then stays a number that can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline.operators.prices import trade_bars

# Words that occur in the invented prose, standing in for a lexicon of its language.
GOOD = ("and", "with", "pour", "mit", "para", "with", "avec", "sur")
BAD = ("was", "not", "nicht", "pas", "sin", "without", "der", "que")

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a plain path must be a folder there, and a
    filter on names would meet the names in it, but a pattern may stand for either."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("trade_id"))


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    return trade_bars(trades(spark, sf), F.to_date("ts"))


def order_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Five symbols over six and a half years, with gaps on small scales."""
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(
        (F.avg("o_totalprice") / 4000.0 + 60.0).alias("close"))


def supplier_closes(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol per supplier, so the number of series grows with the data."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("day")).agg((F.avg(unit) / 1000.0 + 50.0).alias("close"))


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """One portfolio per customer."""
    total = F.sum("o_totalprice")
    return table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol")).agg(
        total.alias("value"),
        ((total - F.count(F.lit(1)) * 120000.0) * 0.1).alias("profit")).withColumn(
        "name", F.concat(F.lit("Priority "), F.col("symbol")))


def holdings_by_status(spark: SparkSession, sf: str, status: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == status).groupBy(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol")).agg(
        F.sum("o_totalprice").alias("value"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    return as_news(table(spark, sf, "documents"))


def as_news(documents: DataFrame) -> DataFrame:
    """Documents as stories: the whole text is the headline."""
    kinds = F.array(*[F.lit(t) for t in EVENT_TYPES])
    doc = F.col("doc_id")
    tags = F.transform(F.sequence(F.lit(0).cast("bigint"), doc % 4),
                       lambda j: F.get(kinds, ((doc * 3 + j) % 5).cast("int")))
    when = F.expr("timestamp_ntz'2024-01-01 00:00:00'"
                  " + make_dt_interval(0, 0, cast((doc_id * doc_id * 7 + doc_id * 37) % 43200 as int), 0)")
    return documents.select(
        "doc_id", when.alias("published"), tags.alias("symbols"), "source",
        F.col("text").alias("headline"), F.col("lang").alias("summary"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example/"), F.col("lang"),
                 F.lit("/"), F.col("n_chars").cast("string")).alias("url"))


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    """At most one payment per supplier and day."""
    return table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("ex_date")).agg(
        F.max("l_tax").alias("rate"), (F.max("l_discount") >= 0.10).alias("special"))


def supplier_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Portfolio per nation of the supplier's account."""
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("portfolio_id"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
        F.abs("s_acctbal").alias("value"))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("day")).agg((F.avg("l_extendedprice") / 30000.0).alias("rate"))


_TYPES = "[" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + "]"

# The same views in SQL; each entry may use the ones before it.
VIEWS = {
    "trades": """SELECT event_type AS symbol, ts, value AS price,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS size, event_id AS trade_id FROM events""",
    "bars": """SELECT symbol, CAST(ts AS DATE) AS day, first(price ORDER BY ts, trade_id) AS open,
        max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close,
        sum(size) AS volume FROM trades GROUP BY 1, 2""",
    "order_closes": """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day,
        avg(o_totalprice) / CAST(4000 AS DOUBLE) + 60 AS close FROM orders GROUP BY 1, 2""",
    "supplier_closes": """SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day,
        avg(l_extendedprice / l_quantity) / CAST(1000 AS DOUBLE) + 50 AS close FROM lineitem GROUP BY 1, 2""",
    "holdings": """SELECT o_custkey AS portfolio_id, o_orderpriority AS symbol,
        sum(o_totalprice) AS value,
        (sum(o_totalprice) - count(*) * CAST(120000 AS DOUBLE)) * CAST(0.1 AS DOUBLE) AS profit,
        'Priority ' || o_orderpriority AS name FROM orders GROUP BY 1, 2""",
    "news": f"""SELECT doc_id,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * doc_id * 7 + doc_id * 37) % 43200 AS INTEGER)) AS published,
        [{_TYPES}[CAST(1 + (doc_id * 3 + j) % 5 AS INTEGER)] for j in generate_series(0, doc_id % 4)]
            AS symbols,
        source, text AS headline, lang AS summary,
        'https://www.' || source || '.example/' || lang || '/' || n_chars AS url FROM documents""",
    "dividends": """SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date,
        max(l_tax) AS rate, max(l_discount) >= CAST(0.10 AS DOUBLE) AS special
        FROM lineitem GROUP BY 1, 2""",
    "supplier_holdings": """SELECT s_nationkey AS portfolio_id, 'S' || s_suppkey AS symbol,
        abs(s_acctbal) AS value FROM supplier""",
    "rates": """SELECT CAST(l_shipdate AS DATE) AS day,
        avg(l_extendedprice) / CAST(30000 AS DOUBLE) AS rate
        FROM lineitem GROUP BY 1""",
}


def with_views(body: str, *names: str, **more: str) -> str:
    """SQL with the named views, then the query's own steps, in front of its body."""
    wanted = set(names) | ({"trades"} if "bars" in names else set())
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted]
    parts += [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
