"""Scalar column expressions for headlines, links and page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tapeline.functions import fixed


def site_of(url: Column) -> Column:
    """Network location of a link without a leading `www.`; empty when there is none."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")),
                            r"^www\.", "")


def headline_key(headline: Column) -> Column:
    """Lower-case letters and digits only, so small spelling differences do not matter."""
    return F.regexp_replace(F.lower(F.coalesce(headline, F.lit("None"))), r"[^\p{L}\p{N}]", "")


def article_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def lexicon_hits(text: Column, listed: Sequence[str]) -> Column:
    """How many words of the text, repeats included, are in the list."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def sentiment(text: Column, positive: Sequence[str] = fixed.POSITIVE_WORDS,
              negative: Sequence[str] = fixed.NEGATIVE_WORDS) -> Column:
    """Listed good words minus listed bad words, in one walk over the words of the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.aggregate(words, F.lit(0), lambda total, w: total + w.isin(*positive).cast("int")
                       - w.isin(*negative).cast("int"))


def sign_label(score: Column) -> Column:
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def mood_bucket(mood: Column) -> Column:
    """Right-closed bins (-99, -.001], (-.001, .001], (.001, 99]."""
    return (F.when((mood > -99) & (mood <= -0.001), "bad news")
            .when((mood > -0.001) & (mood <= 0.001), "neutral")
            .when((mood > 0.001) & (mood <= 99), "good news"))


def top_label(positive: Column, negative: Column, neutral: Column) -> Column:
    """Most likely class; ties go to the first of positive, negative, neutral."""
    return (F.when((positive >= negative) & (positive >= neutral), "positive")
            .when(negative >= neutral, "negative")
            .otherwise("neutral"))


def label_score(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).otherwise(0)


def confidence(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.greatest(positive, negative, neutral)


def shorten(text: Column, limit: int = 140) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def page_text(html: Column) -> Column:
    """Readable text of a page: boilerplate elements and tags removed, entities decoded."""
    dropped = "script|style|nav|header|footer|aside|form|noscript|template|svg|head"
    out = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in dropped.split("|"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                          ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.btrim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def article_status(text: Column, min_chars: int = fixed.MIN_ARTICLE_CHARS) -> Column:
    return F.when(F.length(text) >= min_chars, "saved").otherwise("no_article_text")
