"""Recurrences, memory, selection, as-of and swing points against pandas, numpy and plain loops."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import evaluate, labels, levels, news, recursive, regime, windows

WANTED = [
    recursive.span("a", 20), recursive.span("b", 200), recursive.span("c", 2), recursive.wilder("w", 14, "Close"), recursive.span("adjusted", 20, adjust=True),
    recursive.span("sma", 10, min_periods=10, seed="sma"), recursive.span("signal", 9, "a", minus="b"), recursive.span("slow", 3000),
]


@pytest.fixture(scope="module")
def series():
    """Tickers with gaps in dates and in values; C and E are short, F has no value at all."""
    r, rows = np.random.default_rng(1), []
    for ticker, n, missing in (("A", 1500, 0), ("B", 900, 0.3), ("C", 5, 0), ("D", 700, 0.9), ("E", 1, 0), ("F", 300, 1.0)):
        day = date(1990, 1, 1)
        for _ in range(n):
            day += timedelta(days=int(r.integers(1, 4)) + (700 if r.random() < 0.002 else 0))
            rows.append((ticker, day, None if r.random() < missing else float(100 + 10 * r.standard_normal())))
    return rows


def by_pandas(x, a):
    if a.seed == "sma":
        there = x.dropna()
        start = there.index[a.min_periods - 1] if len(there) >= a.min_periods else len(x)
        x = x.where(x.index >= start)
        if start < len(x):
            x.loc[start] = there.iloc[: a.min_periods].mean()
        return x.ewm(alpha=a.alpha, adjust=False).mean()
    return x.ewm(alpha=a.alpha, adjust=a.adjust, min_periods=a.min_periods).mean()


@pytest.mark.parametrize("blocks", [False, True])
def test_averages_equal_pandas_on_every_row(spark, series, blocks):
    df = spark.createDataFrame(series, "Ticker string, Date date, Close double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = recursive.averages(df, WANTED, blocks).toPandas().sort_values(["Ticker", "Date"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    given = pd.DataFrame(series, columns=["Ticker", "Date", "Close"])
    for ticker, own in given.groupby("Ticker"):
        own, out, known = own.sort_values("Date", ignore_index=True), found[found["Ticker"] == ticker].reset_index(drop=True), {}
        for a in WANTED:
            value = lambda c: known[c] if c in known else own[c].astype(float)  # noqa: B023, E731
            known[a.name] = by_pandas(value(a.column) if a.minus is None else value(a.column) - value(a.minus), a)
            np.testing.assert_allclose(out[a.name].to_numpy(dtype=float), known[a.name].to_numpy(), rtol=1e-9, atol=1e-9, err_msg=f"{ticker} {a.name}")


def test_suite_in_one_pass_equals_plain_windows(spark):
    """To the last digit, over batches shorter than a window, tickers of any length, missing values and flat prices; no window but the order is left in the plan."""
    r, rows = np.random.default_rng(3), []
    for ticker, n, missing in (("A", 400, 0), ("B", 300, 0.05), ("C", 5, 0), ("D", 60, 0), ("E", 1, 0), ("F", 40, 1.0), ("G", 25, 0)):
        for k in range(n):
            low, high, close, volume = sorted(r.uniform(1, 50, 2)) + list(r.uniform(1, 50, 2))
            values = [7.0, 7.0, 7.0, 0.0] if ticker == "D" else [float(high), float(low), float(close), float(volume)]
            rows.append((ticker, date(1990, 1, 1) + timedelta(days=k), 1.0, *(None if r.random() < missing else x for x in values)))
    df = spark.createDataFrame(rows, "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double").repartition(5)
    plain = windows.vwap(windows.stochastic(windows.bollinger(windows.atr(windows.rsi(windows.sma(df)))))).orderBy("Ticker", "Date").collect()
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = recursive.indicator_suite(df)
            found = out.orderBy("Ticker", "Date").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [tuple(x)[: len(plain[0])] for x in found] == [tuple(x) for x in plain]
    assert out.columns == [*plain[0].asDict(), "EMA_20", "EMA_50", "EMA_200", "MACD_signal", "MACD"]
    assert out._jdf.queryExecution().executedPlan().toString().count("windowspecdefinition") == 1


def test_one_long_series_of_times_in_blocks(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("A").alias("Ticker"), F.timestamp_seconds(F.col("id") * 60).alias("Date"), (100 + F.sin(F.col("id") / 50) * 10).alias("Close"))
    found = recursive.averages(rows, [recursive.span("b", 200), recursive.span("f", 12), recursive.span("s", 9, "f", minus="b")], blocks=True).orderBy("Date").toPandas()
    b, f = (found["Close"].ewm(span=k, adjust=False).mean() for k in (200, 12))
    for name, x in (("b", b), ("f", f), ("s", (f - b).ewm(span=9, adjust=False).mean())):
        np.testing.assert_allclose(found[name], x, rtol=1e-9, atol=1e-9)


def test_alpha_out_of_range(spark, series):
    df = spark.createDataFrame(series[:5], "Ticker string, Date date, Close double")
    with pytest.raises(ValueError, match="alpha"):
        recursive.averages(df, [recursive.span("x", 1)])


def regimes_by_loop(raw, hold):
    last, repeats, out = "", 0, []
    for own in raw:
        now = own or (last if last in ("Bullish", "Bearish") and repeats < hold else "Neutral")
        repeats = repeats + 1 if now == last else 0
        last = now
        out.append(now)
    return out


@pytest.mark.parametrize(("blocks", "hold"), [(False, 5), (True, 5), (True, 0), (False, 1)])
def test_memory_of_regimes(spark, blocks, hold):
    r, rows = random.Random(hold), []
    for ticker, n, rare in (("A", 1200, 0.8), ("B", 300, 0.3), ("C", 1, 0.0), ("D", 600, 0.95)):
        for k in range(n):
            rows.append((ticker, date(2000, 1, 1) + timedelta(days=k), 1.0, "" if r.random() < rare else r.choice(["Bullish", "Bearish", "High Volatility"])))
    bullish, bearish, wild = (F.col("own") == x for x in ("Bullish", "Bearish", "High Volatility"))
    one, two = F.lit(1.0), F.lit(2.0)
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double, own string").repartition(5)
    df = df.withColumns({
        "EMA_50": F.when(bullish, 3.0).otherwise(two), "EMA_200": F.when(bearish, 3.0).otherwise(F.when(bullish, one).otherwise(two)), "MACD": F.when(bullish | wild, two).when(bearish, F.lit(-2.0)).otherwise(F.lit(0.0)),
        "MACD_signal": F.when(wild, F.lit(-100.0)).otherwise(F.lit(0.0)), "RSI_14": F.when(bullish, 60.0).when(bearish, 30.0).otherwise(50.0), "ATR_14": F.when(wild, two).otherwise(one), "ATR_50": one, "BB_Upper": two, "BB_Lower": one,
    })
    found = regime.regime_stateful(df, hold=hold, confirm=0, blocks=blocks).orderBy("Ticker", "Date").select("Ticker", "own", "regime").toPandas()
    assert len(found) == len(rows)
    for _, own in found.groupby("Ticker"):
        assert own["regime"].tolist() == regimes_by_loop(own["own"], hold)


@pytest.mark.parametrize("few", [1000, 5])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(evaluate, "FEW", few)
    r = np.random.default_rng(2)
    data = pd.DataFrame({"a": r.standard_normal(3000), "b": r.integers(0, 4, 3000).astype(float), "c": 10.0 ** r.integers(-300, 300, 3000), "d": np.where(np.arange(3000) < 7, np.arange(3000), np.nan), "e": np.nan})
    df = spark.createDataFrame(data).select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in data))
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
    found = evaluate.exact_quantiles(df.repartition(4), {c: F.col(c) for c in data}, shares)
    for c in "abd":
        assert found[c] == pytest.approx(list(data[c].dropna().quantile(list(shares))), rel=1e-12)
    assert found["c"][0] == data["c"].min() and found["c"][-1] == data["c"].max() and found["e"] == [None] * 7
    assert evaluate.exact_quantiles(df.filter("false"), {"a": F.col("a")}, (0.5,)) == {"a": [None]}


def test_as_of_of_later_days(spark):
    r, rows = random.Random(4), []
    for ticker in "ABC":
        day = date(2020, 1, 1)
        for _ in range(60):
            day += timedelta(days=r.choice([1, 1, 2, 9]))
            rows.append((ticker, day, float(r.randint(1, 99)), "x"))
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double, v string").repartition(3)
    found = {(x["Ticker"], x["Date"]): x["later"] for x in labels.first_at_or_after(df, F.date_add("Date", 10), "Close", "later").collect()}
    for ticker, day, _, _ in rows:
        later = [(d, c) for t, d, c, _ in rows if t == ticker and d >= day + timedelta(days=10)]
        assert found[ticker, day] == (min(later)[1] if later else None)


def test_peaks_and_their_prominence():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 40, 200):
        for distance, prominence in ((1, 0.0), (5, 2.0), (3, 1.0)):
            x = r.integers(0, 9, n).astype(float)
            tops, k = [], 1
            while k < n - 1:
                e = k
                while e < n - 1 and x[e + 1] == x[k]:
                    e += 1
                if e < n - 1 and x[k - 1] < x[k] > x[e + 1]:
                    tops.append((k + e) // 2)
                k = e + 1
            kept = []
            for i in sorted(tops, key=lambda i: (-x[i], -i)):
                if all(abs(i - j) >= distance for j in kept):
                    kept.append(i)
            wanted = []
            for i in sorted(kept):
                left = next((j for j in range(i, -1, -1) if x[j] > x[i]), -1)
                right = next((j for j in range(i, n) if x[j] > x[i]), n)
                if x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min()) >= prominence:
                    wanted.append(i)
            assert levels._peaks(x, distance, prominence).tolist() == wanted


def test_first_threshold_of_the_grid(spark):
    rows = [(0.3, 1)] * 20 + [(0.6, 0)] * 10 + [(0.95, 1)] * 10 + [(None, 1)]
    df = spark.createDataFrame(rows, "prob double, target int")
    table = {round(r["threshold"], 6): (r["trades"], r["precision"]) for r in evaluate.threshold_table(df).collect()}
    assert len(table) == 50 and min(table) == 0.5 and table[0.95] == (10, 1.0) and table[0.5] == (20, 0.5)
    first = evaluate.select_threshold(df, 5, 0.9).first()["threshold"]
    assert first == next(t for t in np.linspace(0.5, 0.95, 50) if t > 0.6)
    assert evaluate.select_threshold(df, 15, 0.9).first()["threshold"] == 0.5
    assert evaluate.performance(spark.createDataFrame([(0.1,), (-0.05,)], "trade_return double"), 100.0).first()["final_value"] == pytest.approx(100 * 1.025**2)


def test_publication_window_holds_both_ends(spark):
    at = [datetime(2024, 1, 1, 9, 45), datetime(2024, 1, 2, 3, 45), datetime(2024, 1, 2, 3, 45, 1), datetime(2024, 1, 1, 9, 44, 59)]
    df = spark.createDataFrame([(x,) for x in at], "published timestamp")
    assert news.published_between(df, "2024-01-01 09:45:00", "2024-01-02 03:45:00").count() == 2
    mood = lambda x: spark.range(1).select(news.sentiment_bucket(F.lit(x)).alias("m")).first()["m"]
    assert [mood(x) for x in (-50.0, -10.0, 0.0, 10.0, 50.0)] == ["Very Bearish", "Bearish", "Neutral", "Bullish", "Very Bullish"]
