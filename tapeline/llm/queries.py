"""Registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline.llm import alignment, fingerprints, html_text, language, licenses, mixing, neighbours, packing, periodic, quality, repeats, simhash, urls
from tapeline.llm.common import NO_ID, table, word_count

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op9_substring_dedup", f"""
WITH words AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
single AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM single ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_multiset_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_twins(table(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _sized(docs: DataFrame, spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as doc_id, source, size, quality: 2 for those labelled good, 0.5 for bad, 1 for the rest."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"))
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), *more).join(labels, "doc_id", "left")
    quality = F.when(F.col("good") == 1, 2.0).when(F.col("good") == 0, 0.5).otherwise(1.0)
    return sized.select("doc_id", "source", "size", *more, quality.alias("quality"))


@query("op3_source_mixing", f"""
WITH good AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size,
             CASE q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS quality
      FROM documents LEFT JOIN good USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, row_number() OVER o AS place, coalesce(sum(cap) OVER b, 0) AS full_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, sum(source_size) OVER () * 1.5::DOUBLE AS wanted
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST),
                    b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (wanted - full_before::DOUBLE) / weight_left::DOUBLE AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN g IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, g * weight) END AS target
      FROM l, (SELECT arg_min(level, place) FILTER (WHERE level * weight <= cap) AS g FROM l)),
k AS (SELECT d.*, t.source_size, t.target, floor(least(t.target / nullif(t.source_size, 0), 2)) AS e,
             -ln((('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, CAST(coalesce(e, 0) AS BIGINT) AS epochs,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM k)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(CAST(round(target - epochs * source_size) AS BIGINT) - upto, 0), size) AS BIGINT) AS taken FROM u""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_sized(table(spark, sf_dir, "documents"), spark, sf_dir), quality="quality")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it, columns unchanged; those of no words go. Rows that
    repeat doc_id and text all get the largest of their counts."""
    marked = docs.withColumn("__mark", F.xxhash64("text")).withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
    taken = mixing.mix(_sized(marked, spark, sf_dir, "__id", "__mark"), quality="quality", whole=True)
    times = taken.filter("taken > 0").groupBy("__id", "__mark").agg(F.max(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
    joined = marked.join(times, ["__id", "__mark"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def _tree(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / thousands / id; every tenth is its folder's LICENSE."""
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"))
    own = F.concat(F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE.")).otherwise(F.lit("file.")), F.col("doc_id").cast("string"))
    return docs.select(F.concat_ws("/", folder, own).alias("path"), "text")


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_tree(table(spark, sf_dir, "documents")), licenses.templates_table(spark))


@query("op7_url_filters", r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS v
      FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark))


@query("op8_nearest_neighbours", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors, vectors.filter(F.col("key") % 100 == 0))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def collapsed_rows(docs: DataFrame) -> DataFrame:
    """Runs and digests of documents, of which every tenth by a checksum of its id gets a periodic tail."""
    told = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.collapse(docs, ["doc_id"], told, text=False).drop("n_words", "collapsed")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed_rows(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), first, second, ["doc_id"]).drop("groups")


@query("op11_quality_rules")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
