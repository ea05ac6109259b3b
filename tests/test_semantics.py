"""Small hand-made series: warm-up, ties, zero ranges, last bars, memory, late rows."""

import subprocess
import sys
import time
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import bars, context, evaluate, labels, levels, news, options, recursive, regime, windows
from quantloom.sources import files
from quantloom.streaming import streams


def series(spark, closes, ticker="A", spread=1.0):
    rows = [(ticker, date(2024, 1, 1) + timedelta(days=k), float(c), c + spread, c - spread, float(c), 10.0 + k) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("Ticker", "Date").collect()]


def test_windows_are_null_until_full(spark):
    assert column(windows.sma(series(spark, range(1, 6)), 3), "SMA_3") == [None, None, 2.0, 3.0, 4.0]


def test_rsi_without_losses_is_100_and_without_moves_null(spark):
    assert column(windows.rsi(series(spark, range(5)), 3), "RSI_3")[-1] == 100.0
    assert column(windows.rsi(series(spark, [5] * 5), 3), "RSI_3")[-1] is None


def test_zero_range_has_no_stochastic(spark):
    assert set(column(windows.stochastic(series(spark, [5] * 20, spread=0.0)), "%K")) == {None}


def test_averages_equal_pandas(spark):
    closes = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    found = column(recursive.ema(series(spark, closes), 4), "EMA_4")
    assert found == pytest.approx(pd.Series(closes, dtype=float).ewm(span=4, adjust=False).mean().tolist())


def test_a_future_bar_changes_no_feature_of_the_past(spark):
    closes = [10 + (k * 7) % 5 for k in range(40)]
    suite = lambda n: windows.candle_patterns(recursive.indicator_suite(series(spark, closes[:n]))).orderBy("Date").collect()
    assert suite(39) == suite(40)[:39]


def test_order_of_rows_does_not_matter(spark):
    b = series(spark, [4, 2, 6, 3, 8, 1, 9]).unionByName(series(spark, [1, 2, 3], "B"))
    assert recursive.ema(b, 3).orderBy("Ticker", "Date").collect() == recursive.ema(b.orderBy(F.rand(3)).repartition(3), 3).orderBy("Ticker", "Date").collect()


def test_brackets_on_the_last_bar_and_on_one_day(spark):
    b = series(spark, [100, 100], spread=10.0)
    assert column(labels.bracket_label(b, 2), "bracket_label") == [0, None]
    assert column(labels.bracket_outcome(b, 2), "future_bracket_outcome") == ["BOTH", "NONE"]
    assert column(labels.bracket_trade(b, F.lit(105.0), F.lit(95.0), 1), "outcome") == ["Target", None]
    assert column(labels.bracket_trade(b, F.lit(105.0), F.lit(95.0), 1, same_bar="stop"), "outcome") == ["Stop", None]


def test_stateful_regime_holds_a_trend(spark):
    rows = [("A", date(2024, 1, k + 1), 1.0, *x) for k, x in enumerate([(2, 1, 1, 0, 60)] + [(2, 1, 1, 0, 50)] * 7)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double, EMA_50 int, EMA_200 int, MACD int, MACD_signal int, RSI_14 int")
    df = df.withColumns({c: F.lit(1.0) for c in ("ATR_14", "ATR_50", "BB_Upper", "BB_Lower")})
    assert column(regime.regime_stateful(df), "regime") == ["Bullish"] * 6 + ["Neutral"] * 2


def test_forecast_rows_fall_on_business_days(spark):
    df = spark.createDataFrame([("A", date(2024, 1, 5), "Bullish")], "Ticker string, Date date, regime string")
    out = regime.append_forecast(df, spark.createDataFrame([("A", 1, "Bullish", 1.0), ("A", 2, "Bearish", 1.0)], "Ticker string, day int, regime string, p double")).orderBy("Date").collect()
    assert [(r["Date"].isoformat(), r["regime"]) for r in out[1:]] == [("2024-01-08", "Bullish"), ("2024-01-09", "Bearish")]


def test_forecast_moves_each_ticker_by_its_own_transitions(spark):
    rows = [("A", date(2024, 1, k + 1), x) for k, x in enumerate("UUDUDDUUDU")] + [("B", date(2024, 1, k + 1), x) for k, x in enumerate("DDD")] + [("C", date(2024, 1, 1), "U")]
    df = spark.createDataFrame(rows, "Ticker string, Date date, regime string")
    share = spark.createDataFrame([("A", "D", 0.7), ("A", "U", 0.3)], "Ticker string, regime string, share double")
    plain = {(r["Ticker"], r["day"], r["regime"]): r["p"] for r in regime.forecast(df, 2).collect()}
    p = {"U": {"U": 2 / 5, "D": 3 / 5}, "D": {"U": 3 / 4, "D": 1 / 4}}  # counted by hand
    assert plain["A", 1, "D"] == pytest.approx(3 / 5) and plain["A", 2, "D"] == pytest.approx(2 / 5 * 3 / 5 + 3 / 5 * 1 / 4)
    assert plain["B", 2, "D"] == 1 and plain["C", 1, "U"] == 1
    blended = {(r["Ticker"], r["day"], r["regime"]): r["p"] for r in regime.forecast(df, 2, share).collect()}
    one = {x: 0.3 * p["U"][x] + 0.7 * {"D": 0.7, "U": 0.3}[x] for x in "UD"}
    assert blended["A", 1, "D"] == pytest.approx(one["D"]) and blended["A", 2, "U"] == pytest.approx(0.3 * (one["U"] * p["U"]["U"] + one["D"] * p["D"]["U"]) + 0.7 * 0.3)


def test_stocks_without_a_sector(spark):
    b = series(spark, [1]).unionByName(series(spark, [1], "B"))
    found = context.add_sector(b, spark.createDataFrame([("A", "X")], "Ticker string, Sector string"))
    assert [(r["Sector"], r["Sector_code"]) for r in found.orderBy("Ticker").collect()] == [("X", 1), ("OTHERS", 0)]


def test_scorers_of_batches(spark):
    df = spark.createDataFrame([("gain gain loss",), ("none",), (None,)], "clean_title string")
    assert [r["score"] for r in news.score_sentiment(df).collect()] == [33.33, 0.0, 0.0]
    assert [r["score"] for r in news.score_sentiment(df, lambda x: x.str.len().fillna(0).astype(float)).collect()] == [14.0, 4.0, 0.0]


def test_zigzag_of_a_saw(spark):
    found = levels.zigzag(series(spark, [1, 5, 1, 5, 1, 5, 1]), distance=1, prominence=1.0).orderBy("Date").collect()
    assert [r["kind"] for r in found] == ["peak", "trough", "peak", "trough", "peak"]


def test_backtest_compounds_by_date(spark):
    rows = [(date(2024, 1, 1), "A", 100.0, 110.0, 90.0, "TP_HIT"), (date(2024, 1, 1), "B", 100.0, 110.0, 90.0, "SL_HIT"), (date(2024, 1, 2), "A", 100.0, 110.0, 90.0, "TP_HIT"), (date(2024, 1, 2), "B", 0.0, 110.0, 90.0, "TP_HIT"), (date(2024, 1, 3), "A", 1.0, 2.0, 0.5, "NONE")]
    df = spark.createDataFrame(rows, "Date date, Ticker string, Close double, tp_level double, sl_level double, future_bracket_outcome string")
    out = {r["Date"].day: r["cumulative_equity"] for r in evaluate.bracket_backtest(df, 1000.0).collect()}
    assert out == pytest.approx({1: 1000.0, 2: 1050.0, 3: 1050.0})


def test_vendor_columns_and_missing_ones(spark):
    raw = spark.createDataFrame([("1,234.5", "x")], "OpenPrice string, ClosePrice string")
    assert bars.normalize_ohlcv(raw).select("Open", "Close", "Volume").first() == (1234.5, None, None)
    with pytest.raises(ValueError, match="Nope"):
        bars.require(raw, ["Nope"])


def test_greeks_of_bad_inputs_are_null(spark):
    rows = [(date(2024, 1, 1), 100.0, 100.0, 0.0, 20.0)]
    df = spark.createDataFrame(rows, "expiry date, strike double, spot double, CE_iv double, PE_iv double").withColumn("underlying", F.lit("X"))
    assert options.greeks(df, "2024-01-01").select("Call_Delta", "Put_Delta").first() == (None, None)


def test_cleaning_and_dates(spark):
    df = spark.createDataFrame([("RBI's  ban, 12 May 2024!", "05-Jan-24"), (None, "junk")], "t string, d string")
    out = df.select(news.clean_text(F.col("t")).alias("t"), news.parse_date(F.col("d")).alias("d")).collect()
    assert out[0] == ("rbis  ban", date(2024, 1, 5)) and out[1] == (None, None)
    assert df.select(news.categorize(F.lit("a bank")).alias("c")).first()["c"] == "regulation"
    assert df.select(news.categorize(F.lit("a bank"), whole_words=True).alias("c")).first()["c"] == "general"


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    day = lambda h: f"2024-01-01 {h:02d}:00:00"
    ticks = spark.createDataFrame([("A", day(10), 1.0, 1, 1.0), ("A", day(10), 3.0, 2, 1.0), ("A", day(15), 2.0, 3, 1.0)], "Ticker string, ts string, price double, order int, size double").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "in")
    for rows in (ticks, ticks.filter("order = 3"), ticks.filter("order = 1")):  # the last one comes too late
        files.write_table(rows.coalesce(1), path, mode="append")
        time.sleep(1.1)
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.run_available(streams.stream_bars(source), str(tmp_path / "out"), str(tmp_path / "c1"), "append")
    assert [tuple(r) for r in out.filter("hour(Date) = 10").select("Open", "Close", "Volume").collect()] == [(1.0, 3.0, 2.0)]
    assert streams.stream_bars(ticks).filter("hour(Date) = 10").select("Open", "Close", "Volume").first() == (1.0, 3.0, 2.0)


def test_entry_works_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op1_') for k in e.queries())"
    code = code.replace("sys.modules['corpus_pipeline'] = None; ", "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name in ('corpus_pipeline', 'quantloom.llm'): raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
