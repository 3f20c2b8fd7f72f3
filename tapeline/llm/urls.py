"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

Each URL is expanded into expressions host suffix + path prefix, for the numbers of host labels and the path
lengths that occur in the rules. The first digits of the expression's SHA-256 are equi-joined with those of
the rules; the full digest confirms, and the longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8                       # hex digits of the digest that are joined on
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url",
          default: str = "allow") -> DataFrame:
    """`keep`, host, path, rule, verdict for every row. `rules` has host, path, verdict; a rule fits its host
    and all subdomains if the path starts with the rule's. The longest rule (host and path together, then the
    longer host; of the same rule twice, block) wins; no rule: null and `default`. Rules with a null or empty
    host fit nothing. Repeated rows stay; no rules, no matches."""
    marked = rules.filter("host is not null and host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    marked = marked.withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)).withColumn(
        "r_short", F.substring("r_digest", 1, SHORT))
    # how many labels hosts have and how long paths are in the rules: a few hundred numbers at most, as
    # host names and paths are bounded in length
    shape = marked.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.char_length("r_path")).alias("lengths")).first()
    named = pages.select(F.struct(*keep).alias("__keep"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn(
        "__row", F.monotonically_increasing_id())
    labels = F.filter(F.array(*[F.lit(x) for x in sorted(shape["labels"])]).cast("array<int>"), lambda n: n <= F.size(F.split("host", r"\.")))
    lengths = F.filter(F.array(*[F.lit(x) for x in sorted(shape["lengths"])]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    made = named.withColumn("__n", F.explode_outer(labels)).withColumn("__l", F.explode_outer(lengths))
    made = made.withColumn("__digest", F.sha2(F.concat_ws(
        "\n", F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("__n")), F.substring(F.col("path"), F.lit(1), F.col("__l"))), 256))
    met = made.join(marked, (F.substring("__digest", 1, SHORT) == F.col("r_short")) & (F.col("__digest") == F.col("r_digest")), "left")
    # the expressions of one row lie side by side: the first aggregation folds them before anything moves
    best = F.max(F.when(F.col("r_host").isNotNull(), F.struct(
        (F.char_length("r_host") + F.char_length("r_path")).alias("size"), F.char_length("r_host").alias("host_size"),
        F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))))
    return (met.groupBy("__row").agg(F.first("__keep").alias("__keep"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
            .select("__keep.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
