"""Figures beyond a double's range, ties that rounding must not break, and work that is done once."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import evaluate as E
from quantloom.operators import levels as V
from quantloom.operators import options as O
from quantloom.operators import windows as W
from quantloom.plans import library, q_market, q_research
from quantloom.sources import vendor


def test_performance_beyond_a_doubles_range(spark):
    trades = spark.range(40_000).select(F.lit(0.5).alias("trade_return"))
    found = E.performance(trades, 1_000_000.0).first()
    assert found["final_value"] == math.inf
    assert found["final_log10"] == pytest.approx(6 + 40_000 * math.log10(1.5), rel=1e-12)


@pytest.fixture
def tied(spark):
    """Two strikes at the same distance from the spot, of which doubles put the upper one nearer."""
    low, spot, high = 999.9, 1000.07, 1000.24
    assert abs(low - spot) > abs(high - spot)
    rows = [("a", "e", low, spot, 0.0, 3.0, 4.0), ("a", "e", high, spot, 0.0, 1.0, 2.0)]
    return low, spark.createDataFrame(rows, "underlying string, expiry string, strike double, spot double, PE_iv double, CE_price double, PE_price double")


def test_strikes_as_far_on_both_sides_are_a_tie(tied):
    found = O.ltp_probability(tied[1]).filter("distance = 0").first()
    assert (found["call_strike"], found["put_strike"]) == (tied[0], tied[0])


def test_iron_condor_takes_the_lower_of_two_strikes_at_the_money(tied):
    found = O.iron_condor(tied[1]).first()
    assert (found["short_put"], found["short_call"], found["credit"]) == (tied[0], tied[0], 7.0)


def test_atr_zones_strength_is_summed_by_date(spark):
    # 0.3 as a decimal, from the first day on: other orders, and 1 - 0.7 in doubles, end in another last digit
    day, rows = datetime.date(2024, 1, 1), {}
    for t in range(30):
        closes = [9.0 + (k * 7 % (11 + t)) / 5 for k in range(60 + t)]
        rows[str(t)] = [(str(t), day + datetime.timedelta(k), c + 0.4 * (k % 3), c - 0.4 * (k % 2), c) for k, c in enumerate(closes)]
    found = V.atr_zones(spark.createDataFrame([r for x in rows.values() for r in x], "Ticker string, Date date, High double, Low double, Close double").repartition(7)).collect()
    assert len(found) > 50
    for zone in found:
        own, total = rows[zone["Ticker"]], 0.0
        for k, row in enumerate(own):
            if zone["low"] <= row[4] <= zone["high"]:
                total += 0.7 + (3 * k / 10) / (len(own) - 1)
        assert zone["strength"] == total


def test_positions_in_a_range_are_rounded_once(spark):
    # 100 x / y, as the screens' SQL has it: 100 (x / y) is off by a last digit, which decides where %K and its mean tie
    rows = [("a", datetime.date(2024, 1, 1) + datetime.timedelta(k), 30.0 + (k * 37 % 101) / 100, 20.0 - (k * 53 % 97) / 100, 20.0 + (k * 61 % 1009) / 100) for k in range(300)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, High double, Low double, Close double")
    found = V.fib_position_by_bar(W.stochastic(df), 14).orderBy("Date").collect()
    for k in range(13, 300):
        low, high = min(r[3] for r in rows[k - 13 : k + 1]), max(r[2] for r in rows[k - 13 : k + 1])
        assert found[k]["%K"] == 100 * (rows[k][4] - low) / (high - low)
        assert found[k]["fib_percent"] == 100 * (high - rows[k][4]) / (high - low)


def test_scores_on_thresholds_count_for_them(spark):
    grid = [0.5 + 0.45 / 49 * k for k in range(49)] + [0.95]
    grid[1:49] = [0.5 + (0.95 - 0.5) / 49 * k for k in range(1, 49)]
    probs = [x for t in grid for x in (t, math.nextafter(t, 0), math.nextafter(t, 1))] + [0.0, 1.0, 2.0]
    scored = spark.createDataFrame([(p, k % 2) for k, p in enumerate(probs)], "prob double, target int")
    found = {r["threshold"]: (r["trades"], r["precision"]) for r in E.threshold_table(scored).collect()}
    for t in grid:
        taken = [k % 2 for k, p in enumerate(probs) if p >= t]
        assert found[t] == (len(taken), pytest.approx(sum(taken) / len(taken)))


def test_select_threshold_makes_one_table(spark, data, monkeypatch):
    made, table = [], E.threshold_table
    monkeypatch.setattr(E, "threshold_table", lambda *a, **b: made.append(1) or table(*a, **b))
    assert library.QUERIES["ag5_select_threshold"](spark, data).count() == 1
    assert len(made) == 1


@pytest.mark.parametrize("name", ["s14_entries", "r9_next_state_accuracy"])
def test_bars_are_read_once(spark, data, name):
    assert _plan(library.QUERIES[name](spark, data)).count("FileScan parquet") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [q_market._ml, q_market._regimes])
def test_learners_rows_are_settled(spark, data, rows):
    plan = _plan(rows(spark, data))
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("name", ["p11_select_stocks", "ag3_performance_by_outcome", "ag6_probability_distribution", "r7_r8_forecast"])
def test_what_is_used_again_is_settled(spark, data, name):
    assert "lineitem" not in _plan(library.QUERIES[name](spark, data))


@pytest.mark.parametrize("name", ["p2_relational_features", "p3_relative_to_base"])
def test_the_index_suite_is_made_once(spark, data, name):
    assert _plan(library.QUERIES[name](spark, data)).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["s2_fib_band", "s8_high_volatility", "s15_move_probability"])
def test_screens_of_last_bars_make_bars_once(spark, data, monkeypatch, name):
    made, bars = [], q_research.bars
    monkeypatch.setattr(q_research, "bars", lambda *place: made.append(place) or bars(*place))
    library.QUERIES[name](spark, data)
    assert len(made) == 1


def test_learned_sentiment_cleans_its_sample_once(spark, data, monkeypatch):
    """The learner goes over a settled table of the sampled texts."""
    settled, fitted = [], q_market.fit_sentiment
    monkeypatch.setattr(q_market, "fit_sentiment", lambda df: settled.append(df._jdf.queryExecution().optimizedPlan().toString()) or fitted(df))
    assert library.QUERIES["n3_learned_sentiment"](spark, data).count() > 0
    assert "Join" not in settled[0] and "regexp_replace" not in settled[0]


def test_vendor_reader_lists_folders_of_wanted_tickers_only(tmp_path, monkeypatch):
    for ticker in ("A", "B", "C%2F1"):
        (tmp_path / f"symbol={ticker}").mkdir()
        (tmp_path / f"symbol={ticker}" / "x.csv").write_text("Date,ClosePrice\n")
    listed, real = [], vendor.fs.FileSelector
    monkeypatch.setattr(vendor.fs, "FileSelector", lambda path, **more: listed.append((path, more)) or real(path, **more))
    reader = vendor.VendorReader({"path": str(tmp_path)})
    assert sorted(x.ticker for x in reader.partitions()) == ["A", "B", "C/1"]
    listed.clear()
    assert list(reader.pushFilters([vendor.In(("Ticker",), ("B", "C/1"))])) == []
    assert sorted(x.ticker for x in reader.partitions()) == ["B", "C/1"]
    assert len(listed) == 3 and not any(more.get("recursive") for _, more in listed)
