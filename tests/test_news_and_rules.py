"""Keywords in one pass, learned sentiment and rules by column names against naive versions."""

import random

from pyspark.sql import functions as F

from quantloom.operators import evaluate, news, sentiment


def first_category(text, categories):
    return next((name for name, words in categories.items() if any(w in text for w in words)), "general")


def test_keywords_are_those_of_naive_search(spark):
    odd = {"a": ("abc", "b c", "q1 "), "b": ("ab", "bcd", "q1 results", "c."), "c": ("a", "b", "zz"), "d": ("abcd", "q")}
    r = random.Random(1)
    for categories in (odd, news.CATEGORIES, {"x": ("bcd",), "y": ("bc",), "z": ("bcde", "d")}):
        words = [w for group in categories.values() for w in group]
        texts = ["", "zebra", *("".join(r.choice("abcdq1 .z") for _ in range(r.randint(1, 12))) for _ in range(300)), *(" ".join(r.choice([*words, w[1:], w[:-1], "of"]) for _ in range(3)) for w in words for _ in range(4))]
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", news.categorize(F.col("t"), categories).alias("c"))
        for row in df.collect():
            assert row["c"] == first_category(row["t"], categories), row
    assert spark.range(1).select(news.categorize(F.lit(None).cast("string")).alias("c")).first()["c"] == "general"
    whole = spark.createDataFrame([("a bank",), ("a ban.",), ("pre-ipo",), ("shipon",)], "t string").select(news.categorize(F.col("t"), whole_words=True).alias("c"))
    assert [x["c"] for x in whole.collect()] == ["general", "regulation", "ipo", "general"]


def test_learned_sentiment_holds_on_unseen_texts(spark):
    r, rows = random.Random(2), []
    good, bad, other = ("gain", "rise", "beat", "strong"), ("loss", "fall", "fraud", "weak"), [f"w{k}" for k in range(200)]
    for k in range(400):
        own = good if k % 2 else bad
        rows.append((k, " ".join([r.choice(own) if r.random() < 0.25 else r.choice(other) for _ in range(25)]), k % 2))
    df = spark.createDataFrame([*rows, (400, None, 1), (401, "", 0), (402, "gain", None)], "k long, clean_title string, positive int")
    known = sentiment.bounded_sample(df.filter("k < 300 OR k > 399"), "positive", "k", 100)
    assert {(x["positive"], x["count"]) for x in known.groupBy("positive").count().collect()} == {(0, 100), (1, 100)}
    assert sorted(x["k"] for x in known.collect()) == sorted(x["k"] for x in sentiment.bounded_sample(df.filter("k < 300 OR k > 399").repartition(5), "positive", "k", 100).collect())
    scored = sentiment.score_learned(df, sentiment.fit_sentiment(known)).collect()
    unseen = [x for x in scored if 300 <= x["k"] < 400]
    pairs = [(a["score"], b["score"]) for a in unseen if a["positive"] for b in unseen if not b["positive"]]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) > 0.9
    assert len(scored) == 403 and all(-100 <= x["score"] <= 100 for x in scored)


def test_ranges_by_name(spark):
    assert evaluate.rules_by_name(["x_rel", "MACD_diff_NIFTY", "MACD", "log_ATR_vs_NIFTY", "Close", "NIFTY_RSI_14"]) == {
        "x_rel": (-5, 5), "MACD_diff_NIFTY": (-1000, 1000), "MACD": (-5000, 5000), "log_ATR_vs_NIFTY": (0, 20), "NIFTY_RSI_14": (0, 100),
    }
    df = spark.createDataFrame([("A", 101.0, 1), (None, None, 2), ("B", float("inf"), 3)], "RSI_14 string, RSI_14_b double, n int")
    assert [tuple(r) for r in evaluate.validate_by_name(df).collect()] == [("RSI_14_b", 1, 1, 0, 2)]
