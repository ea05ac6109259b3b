"""News: cleaning, categories, windows, sentiment and its aggregates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.expr import divide

C = F.col
#: Categories in order with their keywords, matched as substrings; the first match counts.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "quarterly_earnings": ("quarterly results", "q1 results", "q2 results", "q3 results", "q4 results", "quarterly ", "q1 ", "q2 ", "q3 ", "q4 ", "q1:", "q2:", "q3:", "q4:", "quarterly earnings"),
    "earnings": ("net profit", "revenue", "ebitda", "eps", "financial results", "topline", "bottomline", "q1fy", "q2fy", "q3fy", "q4fy", "fy2025", "fy25"),
    "ipo": ("ipo", "initial public offering", "listing", "pre-ipo", "price band", "subscription status"),
    "regulation": ("rbi", "sebi", "regulation", "ban", "penalty", "compliance", "circular"),
    "macroeconomy": ("inflation", "gdp", "interest rate", "repo rate", "global economy", "macroeconomic"),
    "mna": ("acquisition", "merger", "stake buy", "stake sale", "takeover", "deal"),
}
#: Weight of each category; any other has 1.
WEIGHTS = {"quarterly_earnings": 5.0, "earnings": 1.5, "ipo": 1.3, "regulation": 1.2, "macroeconomy": 1.1, "mna": 1.4, "general": 1.0}
#: Small lexicon of the default scorer.
LEXICON = {"gain": 1, "rise": 1, "profit": 1, "growth": 1, "strong": 1, "beat": 1, "loss": -1, "fall": -1, "weak": -1, "penalty": -1, "miss": -1, "fraud": -1}


def clean_text(text: Column) -> Column:
    """Without punctuation, without dates, with broken quotes made whole, in lower case, trimmed; in this order."""
    plain = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    undated = F.regexp_replace(plain, r"(?U)\d{1,2}\s\w+\s\d{4}", "")
    return F.trim(F.lower(F.regexp_replace(undated, "[â€™”“œ\u009d¦]", "'")))


def _trie_pattern(words: list[str]) -> str:
    """A pattern that matches the first of ``words`` (by their order) that begins at a place, with common beginnings written once."""
    branches: dict[str, list[str]] = {}
    for k, w in enumerate(words):
        if not w:
            words = words[:k]  # what is longer and comes later never counts
            tail = [""]
            break
        branches.setdefault(w[0], []).append(w[1:])
    else:
        tail = []
    parts = [re.escape(first) + _trie_pattern(rest) for first, rest in branches.items()] + tail
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def categorize(text: Column, categories: dict[str, tuple[str, ...]] | None = None, whole_words: bool = False) -> Column:
    """First category of which a keyword stands in the text, else general.

    One pattern of all keywords, with common beginnings written once, is looked for at every place of the text in one pass. Where keywords of several categories
    begin at one place, that of the first category is taken.
    """
    known = categories or CATEGORIES
    ranked = list(dict.fromkeys((w, k) for k, words in enumerate(known.values()) for w in words))
    first = {w: k for w, k in reversed(ranked)}
    # a place tells one keyword: one that begins another of no later category stands for it
    told = [w for w in first if not any(w != v and w.startswith(v) and first[v] <= first[w] for v in first)] if not whole_words else list(first)
    told.sort(key=lambda w: (first[w], -len(w)))
    edge = r"\b" if whole_words else ""
    pattern = f"{edge}(?=({_trie_pattern(told) if not whole_words else '|'.join(re.escape(w) for w in told)}){edge})"
    ranks = F.create_map(*(F.lit(x) for w in told for x in (w, first[w])))
    best = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.element_at(ranks, w)))
    names = F.array(*(F.lit(x) for x in known))
    return F.coalesce(F.get(names, best), F.lit("general"))


def weight_of(category: Column, weights: dict[str, float] | None = None) -> Column:
    known = F.create_map(*(F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair))
    return F.coalesce(F.try_element_at(known, category), F.lit(1.0))


def keyword_filter(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Items whose title (or summary, if there is one) has a keyword, in any case; ``keyword`` is the first match."""
    pattern = "(?i)(" + "|".join(rf"\Q{k}\E" for k in keywords) + ")"
    text = F.concat_ws(" ", *(c for c in ("title", "summary") if c in df.columns))
    return df.withColumn("keyword", F.lower(F.regexp_extract(text, pattern, 1))).filter("keyword <> ''")


def sentiment_bucket(score: Column) -> Column:
    return F.when(score <= -50, "Very Bearish").when(score <= -10, "Bearish").when(score < 10, "Neutral").when(score < 50, "Bullish").otherwise("Very Bullish")


def published_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Items from ``start`` to ``end`` (UTC), both included."""
    return df.filter(C("published").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def with_trading_day(df: DataFrame) -> DataFrame:
    """``day``: date on which the item's daily window, 09:15 to 09:15 IST, begins; and ``published_ist``."""
    window = F.window("published", "1 day", startTime="3 hours 45 minutes")
    return df.withColumn("day", F.to_date(F.from_utc_timestamp(window["start"], "Asia/Kolkata"))).withColumn("published_ist", F.date_format(F.from_utc_timestamp("published", "Asia/Kolkata"), "yyyy-MM-dd HH:mm"))


def lexicon_score(text: Column, lexicon: dict[str, int] | None = None) -> Column:
    """Share of positive less share of negative words among the lexicon's, times 100; 0 where none stands in the text. Words are read once."""
    signs = F.create_map(*(F.lit(x) for pair in (lexicon or LEXICON).items() for x in pair))
    found = F.filter(F.transform(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.try_element_at(signs, w)), lambda v: v.isNotNull())
    both = F.aggregate(found, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + 1).alias("n")))
    share = F.transform(F.array(both), lambda b: F.try_divide(100.0 * b["sum"], b["n"]))[0]
    return F.round(F.coalesce(share, F.lit(0.0)), 2)


def score_sentiment(df: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None = None, column: str = "clean_title", lexicon: dict[str, int] | None = None) -> DataFrame:
    """``score`` of each item: by a lexicon, or by a scorer of whole batches, such as a model that is loaded once per task."""
    if scorer is None:
        return df.withColumn("score", lexicon_score(C(column), lexicon))
    schema = StructType([*df.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=scorer(b[column]))

    return df.mapInPandas(run, schema)


def prepared(df: DataFrame) -> DataFrame:
    """Items with a title and a stock, cleaned, with category and weight."""
    df = df.dropna(subset=["title", "stock"]).withColumn("clean_title", clean_text(C("title")))
    df = df.withColumn("category", categorize(C("clean_title")))
    return df.withColumn("weight", weight_of(C("category")))


def sentiment_by(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and weighted mean of the score, mean weight and number of items."""
    return scored.groupBy(*keys).agg(
        F.round(F.avg("score"), 2).alias("mean_score"), F.round(F.avg(C("score") * C("weight")), 2).alias("mean_weighted"), F.round(F.avg("weight"), 2).alias("mean_weight"), F.count("*").alias("items")
    )


def market_index(scored: DataFrame) -> DataFrame:
    """One row: the weighted mean of all scores and its label."""
    value = divide(F.sum(C("score") * C("weight")), F.sum("weight"))
    return scored.agg(F.round(value, 2).alias("market_index")).withColumn("mood", sentiment_bucket(C("market_index")))


def parse_date(text: Column, formats: tuple[str, ...] = ("dd-MMM-yy", "dd-MMM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd MMM yyyy")) -> Column:
    """A date by the first of several formats that fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))
