"""Merging new stories into a news archive.

A new story counts as seen when its link or its headline key is already registered; only stories
that are added register their keys, so the outcome depends on the order `seq`. Seen as a graph
whose points are links and headline keys and whose lines are stories, the stories added are the
greedy matching by `seq`. It is found in rounds: a story first at both its points can be decided
at once, and everything touching it falls away. A story that only one earlier story can block is added
exactly if that one is not; such chains are followed by doubling, so their length does not matter. What is left
of `SMALL` stories and fewer is replayed in order. No group of copies is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tapeline.functions.textual import headline_key
from tapeline.operators.skew import salted_join
from tapeline.session import cut_lineage

SMALL = 100_000       # stories that one task replays


def _keys(stories: DataFrame) -> DataFrame:
    """Fixed-length keys: headlines can be whole posts."""
    return (stories.withColumn("_u", F.sha2(F.col("url"), 256))
            .withColumn("_h", F.sha2(headline_key(F.col("headline")), 256)))


def _spread_join(big: DataFrame, lookup: DataFrame, key: str, how: str) -> DataFrame:
    """Join on one key, spreading the keys that hold much of `big` (a written table)."""
    return salted_join(big, lookup, [key], how)


def _second(lines: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """(seq, to): the second story at each point and the first one there."""
    later = _spread_join(lines.select(key, "seq"), first.withColumnRenamed("seq", "to"), key, "inner").where(F.col("seq") > F.col("to"))
    return later.groupBy(key).agg(F.min("seq").alias("seq"), F.min("to").alias("to")).select("seq", "to")


def _follow(blocked: DataFrame, sure: DataFrame) -> DataFrame:
    """The stories (seq) of chains that are added: an even number of steps `to` before a sure one. A chain that leads
    to a story with several blockers stays undecided."""
    steps = cut_lineage(blocked.withColumn("odd", F.lit(True)))
    while True:
        onward = steps.select(F.col("seq").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        longer = cut_lineage(steps.join(onward, "to", "left"))
        if longer.where(F.col("_to").isNotNull()).isEmpty():
            break
        steps = longer.select("seq", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"))
    return steps.where(~F.col("odd")).join(sure.select(F.col("seq").alias("to")), "to", "left_semi").select("seq")


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stories added, of one sorted partition."""
    links, heads = set(), set()
    for frame in frames:
        free = []
        for u, h in zip(frame["_u"], frame["_h"]):
            free.append(u not in links and h not in heads)
            if free[-1]:
                links.add(u)
                heads.add(h)
        yield frame[free]


def first_stories(lines: DataFrame, small: int = SMALL) -> DataFrame:
    """Greedy matching of lines(_u, _h, seq), unique on (_u, _h), by increasing seq."""
    left, turn = cut_lineage(lines.select("seq", "_u", "_h")), 0
    chosen = left.limit(0)
    while (n := left.count()) > small:
        first_u = left.groupBy("_u").agg(F.min("seq").alias("seq"))
        first_h = left.groupBy("_h").agg(F.min("seq").alias("seq"))
        # seq is unique, so these two meet one to one however many copies a key has
        picked = cut_lineage(first_u.join(first_h, "seq").select("seq", "_u", "_h"))
        if turn >= 2:                   # plain rounds settle most of what there is
            blocked = _second(left, first_u, "_u").join(first_h.select("seq"), "seq", "left_semi").unionByName(
                _second(left, first_h, "_h").join(first_u.select("seq"), "seq", "left_semi"))
            picked = cut_lineage(picked.unionByName(left.join(_follow(blocked, picked), "seq", "left_semi").select("seq", "_u", "_h")))
        chosen = chosen.unionByName(picked)
        rest = _spread_join(left, picked.select("_u"), "_u", "left_anti")
        left = cut_lineage(_spread_join(rest, picked.select("_h"), "_h", "left_anti").select("seq", "_u", "_h"))
        turn += 1
    if n:
        chosen = chosen.unionByName(left.repartition(1).sortWithinPartitions("seq").mapInPandas(_replay, left.schema))
    return chosen


#: known(key, asked): (key, pos) of the `asked` keys (`_u` or `_h`) that the archive holds; more may be given.
Known = Callable[[str, DataFrame], DataFrame]
COLUMNS = ["published", "symbols", "source", "headline", "summary", "url", "text_status"]


def with_tickers(own: Column, more: Column) -> Column:
    """A story's tickers with those found later; `more` is null where there are none."""
    return F.when(more.isNull(), own).otherwise(F.array_sort(F.array_distinct(F.concat(own, more))))


def changes(new: DataFrame, known: Known) -> tuple[DataFrame, DataFrame]:
    """What `new` (with `seq`, its order, and one `symbol`) adds to an archive: the stories that enter, in archive
    columns, and (pos, _more), the tickers found for stories already there."""
    fresh = _keys(new.where(F.coalesce(F.col("url"), F.lit("")) != ""))
    slim = cut_lineage(fresh.select("seq", "_u", "_h", "symbol"))

    old_u = known("_u", slim.select("_u").distinct()).withColumnRenamed("pos", "old_u")
    old_h = known("_h", slim.select("_h").distinct()).withColumnRenamed("pos", "old_h")
    lines = slim.groupBy("_u", "_h").agg(F.min("seq").alias("seq"))
    lines = _spread_join(lines, old_u, "_u", "left_anti")
    lines = _spread_join(lines, old_h, "_h", "left_anti")
    added = cut_lineage(first_stories(lines).select("seq", "_u", "_h"))

    # who answers for each story: the link if registered before it came, else the headline
    links = old_u.join(added.select("_u", F.col("seq").alias("new_u")), "_u", "full")
    heads = old_h.join(added.select("_h", F.col("seq").alias("new_h")), "_h", "full")
    seen = _spread_join(slim, links, "_u", "left")
    seen = _spread_join(seen, heads, "_h", "left")
    seen = seen.where(~(F.col("seq") == F.coalesce("new_u", F.lit(-1))))
    by_link = F.col("old_u").isNotNull() | (F.col("new_u") < F.col("seq"))
    owner = seen.select(
        F.when(by_link, F.col("old_u")).otherwise(F.col("old_h")).alias("pos"),
        F.when(by_link, F.when(F.col("old_u").isNull(), F.col("new_u")))
        .otherwise(F.when(F.col("old_h").isNull(), F.col("new_h"))).alias("seq"), "symbol")
    tickers = cut_lineage(owner.distinct().groupBy("pos", "seq")
                          .agg(F.collect_set("symbol").alias("_more")))

    entering = (new.join(added.select("seq"), "seq", "left_semi")
                .join(tickers.where(F.col("seq").isNotNull()).select("seq", "_more"), "seq", "left")
                .withColumn("symbols", with_tickers(F.array("symbol"), F.col("_more")))
                .withColumn("text_status", F.lit("")).select(*COLUMNS))
    return entering, tickers.where(F.col("pos").isNotNull()).select("pos", "_more")


def merge(archive: DataFrame, new: DataFrame) -> DataFrame:
    """Archive with the unseen stories added and the tickers of seen ones joined in.

    `archive` has `pos` (its row order) and an array `symbols`; `new` has `seq` (its order) and one
    `symbol`. Result: the archive columns plus `is_new`; rows added have an empty text_status. When
    the archive holds a key twice, its later row answers for it.
    """
    old = cut_lineage(_keys(archive).select("pos", "_u", "_h"))
    entering, tickers = changes(new, lambda key, asked: old.groupBy(key).agg(F.max("pos").alias("pos")))
    kept = (archive.join(tickers, "pos", "left")
            .withColumn("symbols", with_tickers(F.col("symbols"), F.col("_more")))
            .select(*COLUMNS, F.lit(False).alias("is_new")))
    return kept.unionByName(entering.withColumn("is_new", F.lit(True)))


def keyed(stories: DataFrame) -> DataFrame:
    """Archive rows with their keys, as an archive of runs stores them."""
    return _keys(stories)


def settled(stories: DataFrame, tickers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed stories with the `tickers` (_u, _more) found for them since, and the tickers of stories that are not
    among these."""
    more = tickers.groupBy("_u").agg(F.array_distinct(F.flatten(F.collect_set("_more"))).alias("_more"))
    told = stories.join(more, "_u", "left").withColumn("symbols", with_tickers(F.col("symbols"), F.col("_more")))
    return told.select(*COLUMNS, "_u", "_h"), more.join(stories.select("_u"), "_u", "left_anti")
