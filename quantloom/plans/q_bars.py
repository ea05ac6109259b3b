"""Queries over bars: sources, windows, patterns and recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import recursive as R
from quantloom.operators import windows as W
from quantloom.plans.inputs import BARS, P, bars, ewm, frame, full
from quantloom.plans.registry import query

KEY = ["Ticker", "Date"]
ALL = f"({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
TR = f"greatest(High - Low, abs(High - lag(Close) OVER ({P})), abs(Low - lag(Close) OVER ({P})))"


def over(select: str, source: str = "bars", more: str = "") -> str:
    return f"WITH {BARS}{', ' + more if more else ''} SELECT {select} FROM {source}"


@query(over("Ticker, Date, Open, High, Low, Close, Volume"))
def bars_from_trades(spark, sf_dir):
    return bars(spark, sf_dir)


@query(over("Ticker, Date, Open, High, Low, Close, Volume"))
def io3_normalize_vendor_columns(spark, sf_dir):
    vendor = bars(spark, sf_dir).select("Ticker", "Date", *(F.col(c).cast("string").alias(a) for c, a in (("Open", "OpenPrice"), ("High", "HighPrice"), ("Low", "LowPrice"), ("Close", "ClosePrice"))), F.format_number("Volume", 0).alias("TotalTradedQuantity"))
    return B.normalize_ohlcv(vendor)


_YEARLY = "yb AS (SELECT Ticker || '-' || year(Date) AS Ticker, Date, Close, Volume FROM bars)"


@query(over("Ticker, Date, Close", "yb WHERE Ticker IN (SELECT Ticker FROM yb GROUP BY Ticker HAVING count(CASE WHEN Volume > 80 THEN Close END) > 0)", _YEARLY))
def io4_drop_empty_tickers(spark, sf_dir):
    """A ticker for each supplier and year, for over all years every supplier has a close."""
    yearly = bars(spark, sf_dir).withColumn("Ticker", F.concat("Ticker", F.lit("-"), F.year("Date").cast("string")))
    thin = yearly.withColumn("Kept", F.col("Close")).withColumn("Close", F.when(F.col("Volume") > 80, F.col("Close")))
    return B.drop_empty_tickers(thin).select("Ticker", "Date", F.col("Kept").alias("Close"))


@query(f"""WITH {BARS}, few AS (SELECT * FROM bars WHERE day(Date) <= 3)
    SELECT Ticker, month FROM (SELECT DISTINCT Ticker FROM few), (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS DATE) AS month)
    WHERE (Ticker, month) NOT IN (SELECT Ticker, CAST(date_trunc('month', Date) AS DATE) FROM few)""")
def io5_coverage_gaps(spark, sf_dir):
    return B.coverage_gaps(bars(spark, sf_dir).filter("day(Date) <= 3"), "1995-01-15", "1996-12-20")


@query(f"""WITH {BARS} SELECT Ticker, Date, CASE WHEN day(Date) <= 20 THEN Close ELSE -Close END AS Close FROM bars""")
def io5_u3_merge_sources(spark, sf_dir):
    b = bars(spark, sf_dir).select("Ticker", "Date", "Close")
    return B.merge_sources(b.filter("day(Date) <= 20"), b.withColumn("Close", -F.col("Close")))


_MANIFEST = f"""manifest AS (SELECT Ticker AS symbol, '5y' AS period, '1d' AS interval, max(Date) AS last_updated FROM bars GROUP BY Ticker)"""


def _manifest(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("Ticker").agg(F.max("Date").alias("last_updated")).select(F.col("Ticker").alias("symbol"), F.lit("5y").alias("period"), F.lit("1d").alias("interval"), "last_updated")


@query(f"""WITH {BARS}, {_MANIFEST} SELECT symbol, period, interval, CASE WHEN length(symbol) = 2 THEN DATE '2000-01-03' ELSE last_updated END AS last_updated FROM manifest""")
def io6_manifest_upsert(spark, sf_dir):
    old = _manifest(spark, sf_dir)
    return B.upsert_manifest(old, old.filter("length(symbol) = 2").withColumn("last_updated", F.lit("2000-01-03").cast("date")))


@query(f"""WITH {BARS}, {_MANIFEST}, top AS (SELECT max(last_updated) AS d FROM manifest)
    SELECT symbol, period, interval, last_updated FROM manifest WHERE last_updated NOT IN (DATE '1998-11-30', DATE '1998-11-27')""")
def io6_stale_symbols(spark, sf_dir):
    return B.stale_symbols(_manifest(spark, sf_dir), "1998-11-30")


@query(f"WITH {BARS} SELECT Ticker, Date, Close FROM bars QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) <= 30")
def io2_t5_last_n_rows(spark, sf_dir):
    return B.last_n(bars(spark, sf_dir), 30).select("Ticker", "Date", "Close")


@query(f"WITH {BARS} SELECT Ticker, Date, Open, High, Low, Close, Volume FROM bars QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) = 1")
def s1_latest_row(spark, sf_dir):
    return B.latest(bars(spark, sf_dir))


@query(f"WITH {BARS} SELECT Ticker, Date, Close, CAST(NULL AS DOUBLE) AS Extra FROM bars UNION ALL SELECT Ticker, Date, NULL, Volume FROM bars WHERE Volume > 45")
def u1_u2_union_aligned(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("Ticker", "Date", "Close").unionByName(b.filter("Volume > 45").select("Ticker", "Date", F.col("Volume").alias("Extra")), allowMissingColumns=True)


@query(over(f"Ticker, Date, {full('avg', 'Close', 20)} AS SMA_20"), "SMA_20")
def w1_sma(spark, sf_dir):
    return W.sma(bars(spark, sf_dir)).select(*KEY, "SMA_20")


_NUMBERED = f"nb AS (SELECT *, row_number() OVER ({P}) AS rn FROM bars)"


@query(over(f"Ticker, Date, {ewm('Close', 2 / 21)} AS EMA_20", "nb", _NUMBERED), "EMA_20", 4)
def w2_ema(spark, sf_dir):
    return R.ema(bars(spark, sf_dir), 20).select(*KEY, "EMA_20")


@query(over(f"Ticker, Date, {ewm('Close', 2 / 51)} AS EMA_50", "nb", _NUMBERED), "EMA_50", 4)
def w2_ema_in_blocks(spark, sf_dir):
    """The same recurrence as a prefix scan over blocks of dates."""
    return R.ema(bars(spark, sf_dir), 50, blocks=True).select(*KEY, "EMA_50")


_MOVES = f"{_NUMBERED}, mv AS (SELECT *, Close - lag(Close) OVER ({P}) AS m, {TR} AS tr FROM nb)"
_WILDER = f"{_MOVES}, up AS (SELECT Ticker, Date, rn - 1 AS rn, greatest(m, 0.0) AS g, greatest(-m, 0.0) AS l FROM mv WHERE rn > 1)"


@query(f"""WITH {BARS}, {_WILDER}, x AS (SELECT Ticker, Date, rn, {ewm('g', 1 / 14)} AS g, {ewm('l', 1 / 14)} AS l FROM up)
    SELECT b.Ticker, b.Date, CASE WHEN rn >= 14 THEN CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END END AS RSI_14w
    FROM bars b LEFT JOIN x ON b.Ticker = x.Ticker AND b.Date = x.Date""", "RSI_14w", 4)
def w3_w5_rsi_wilder(spark, sf_dir):
    return R.rsi_wilder(bars(spark, sf_dir)).select(*KEY, "RSI_14w")


@query(over(f"Ticker, Date, CASE WHEN rn >= 14 THEN {ewm('tr', 1 / 14)} END AS ATR_14w", "mv", _MOVES).replace("SELECT Ticker, Date, CASE", "SELECT Ticker, Date, ATR_14w, " + full("avg", "ATR_14w", 50) + " AS ATR_50 FROM (SELECT Ticker, Date, CASE") + ")", "ATR_14w ATR_50", 4)
def w7_atr_wilder(spark, sf_dir):
    return R.atr_wilder(bars(spark, sf_dir)).select(*KEY, "ATR_14w", "ATR_50")


_RSI = f"""mv AS (SELECT Ticker, Date, Close - lag(Close) OVER ({P}) AS m FROM bars),
    gl AS (SELECT Ticker, Date, {full('avg', 'greatest(m, m * 0)', 14)} AS g, {full('avg', 'greatest(-m, m * 0)', 14)} AS l FROM mv)"""


@query(over("Ticker, Date, CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS RSI_14", "gl", _RSI), "RSI_14", 4)
def w4_rsi(spark, sf_dir):
    return W.rsi(bars(spark, sf_dir)).select(*KEY, "RSI_14")


@query(over(f"Ticker, Date, {full('avg', 'tr', 14)} AS ATR_14, avg(tr) OVER {frame(14)} AS ATR_any", "t", f"t AS (SELECT *, {TR} AS tr FROM bars)"), "ATR_14 ATR_any")
def w6_atr(spark, sf_dir):
    b = W.atr(W.atr(bars(spark, sf_dir)).withColumnRenamed("ATR_14", "full"), min_periods=1)
    return b.select(*KEY, F.col("full").alias("ATR_14"), F.col("ATR_14").alias("ATR_any"))


_MACD = f"{_NUMBERED}, fs AS (SELECT Ticker, Date, rn, ({ewm('Close', 2 / 13)}) - ({ewm('Close', 2 / 27)}) AS MACD FROM nb), sg AS (SELECT *, {ewm('MACD', 2 / 10)} AS MACD_signal FROM fs)"


@query(over("Ticker, Date, MACD, MACD_signal, MACD - MACD_signal AS MACD_hist", "sg", _MACD), "MACD MACD_signal MACD_hist", 4)
def w8_macd(spark, sf_dir):
    return R.macd(bars(spark, sf_dir)).select(*KEY, "MACD", "MACD_signal", "MACD_hist")


_BB = f"bb AS (SELECT *, {full('avg', 'Close', 20)} AS mid, {full('stddev_samp', 'Close', 20)} AS sd FROM bars)"


@query(over("Ticker, Date, mid AS BB_Mid, mid + 2 * sd AS BB_Upper, mid - 2 * sd AS BB_Lower, 4 * sd / mid AS BB_Width", "bb", _BB), "BB_Mid BB_Upper BB_Lower BB_Width")
def w9_bollinger(spark, sf_dir):
    return W.bollinger(bars(spark, sf_dir)).select(*KEY, "BB_Mid", "BB_Upper", "BB_Lower", "BB_Width")


_STOCH = f"""lh AS (SELECT *, {full('min', 'Low', 14)} AS lo, {full('max', 'High', 14)} AS hi FROM bars), st AS (SELECT *, 100 * (Close - lo) / nullif(hi - lo, 0) AS k FROM lh)"""


@query(over(f'Ticker, Date, k AS "%K", {full("avg", "k", 3)} AS "%D"', "st", _STOCH), "%K %D")
def w10_stochastic(spark, sf_dir):
    return W.stochastic(bars(spark, sf_dir)).select(*KEY, "%K", "%D")


_VWAP = f"vw AS (SELECT *, sum((High + Low + Close) / 3 * Volume) OVER {ALL} AS Cum_TPV, sum(Volume) OVER {ALL} AS Cum_Vol FROM bars)"


@query(over("Ticker, Date, Cum_TPV, Cum_Vol, Cum_TPV / nullif(Cum_Vol, 0) AS VWAP", "vw", _VWAP), "Cum_TPV Cum_Vol VWAP", 4)
def w11_vwap(spark, sf_dir):
    return W.vwap(bars(spark, sf_dir)).select(*KEY, "Cum_TPV", "Cum_Vol", "VWAP")


@query(over(f"Ticker, Date, sum(s) OVER {ALL} AS OBV", "o", f"o AS (SELECT *, sign(Close - lag(Close) OVER ({P})) * Volume AS s FROM bars)"), "OBV")
def w12_obv(spark, sf_dir):
    return W.obv(bars(spark, sf_dir)).select(*KEY, "OBV")


@query(over(f"Ticker, Date, {full('max', 'High', 20)} AS Donchian_Upper, {full('min', 'Low', 20)} AS Donchian_Lower, ({full('max', 'High', 20)} + {full('min', 'Low', 20)}) / 2 AS Donchian_Mid".replace("END + CASE", "END) + (CASE").replace(", (CASE", ", ((CASE").replace("END) / 2", "END)) / 2")))
def w13_donchian(spark, sf_dir):
    return W.donchian(bars(spark, sf_dir)).select(*KEY, "Donchian_Upper", "Donchian_Lower", "Donchian_Mid")


def _around(agg, x, left, right):
    w = f"({P} ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    return f"CASE WHEN count({x}) OVER {w} >= {left + right + 1} THEN {agg}({x}) OVER {w} END"


_LEVELS = f"lv AS (SELECT *, {_around('min', 'Low', 10, 9)} AS Support, {_around('max', 'High', 10, 9)} AS Resistance, {full('avg', 'High - Low', 20)} AS mr FROM bars)"


@query(over("Ticker, Date, Support, Resistance, coalesce(abs(Close - Support) / Close < 0.01, false) AS near_support, coalesce(abs(Close - Resistance) / Close < 0.01, false) AS near_resistance, coalesce(abs(Close - Open) > 1.5 * mr, false) AS big_candle", "lv", _LEVELS))
def w14_w15_levels_and_context(spark, sf_dir):
    return W.context_flags(bars(spark, sf_dir)).select(*KEY, "Support", "Resistance", "near_support", "near_resistance", "big_candle")


_LAGGED = f"""lg AS (SELECT *, lag(Open) OVER w AS o1, lag(High) OVER w AS h1, lag(Low) OVER w AS l1, lag(Close) OVER w AS c1, lag(Open, 2) OVER w AS o2, lag(Close, 2) OVER w AS c2,
    abs(Close - Open) AS body, High - Low AS size FROM bars WINDOW w AS ({P}))"""


@query(over("""Ticker, Date, coalesce(c1 < o1 AND Close > Open AND Close > o1 AND Open < c1, false) AS bullish_engulfing, coalesce(c1 > o1 AND Close < Open AND Close < o1 AND Open > c1, false) AS bearish_engulfing,
    size > 3 * body AND (Close - Low) / (1e-6 + High - Low) > 0.6 AND (Open - Low) / (1e-6 + High - Low) > 0.6 AS hammer, body <= 0.1 * size AS doji,
    coalesce(High < h1 AND Low > l1, false) AS inside_bar, coalesce(High > h1 AND Low < l1, false) AS outside_bar,
    coalesce(c2 < o2 AND abs(c1 - o1) <= 0.3 * (h1 - l1) AND Close > (o2 + c2) / 2, false) AS morning_star, coalesce(c2 > o2 AND abs(c1 - o1) <= 0.3 * (h1 - l1) AND Close < (o2 + c2) / 2, false) AS evening_star,
    High - greatest(Open, Close) > 2 * body OR least(Open, Close) - Low > 2 * body AS pin_bar""", "lg", _LAGGED))
def w16_candle_patterns(spark, sf_dir):
    found = W.candle_patterns(bars(spark, sf_dir))
    return found.select(*KEY, *found.columns[7:])


@query(over("""Ticker, Date, CASE WHEN c1 < o1 AND Close > Open AND Open < c1 AND Close > o1 THEN Close END AS Bullish_Engulfing, CASE WHEN c1 > o1 AND Close < Open AND Open > c1 AND Close < o1 THEN Close END AS Bearish_Engulfing,
    CASE WHEN c1 IS NOT NULL AND body <= size * 0.1 THEN Close END AS Doji, CASE WHEN c1 IS NOT NULL AND Close > Open AND Open - Low > 2 * body AND High - Close < 0.3 * size THEN Close END AS Hammer,
    CASE WHEN c1 IS NOT NULL AND Close < Open AND High - Open > 2 * body AND Close - Low < 0.3 * size THEN Close END AS Shooting_Star""", "lg", _LAGGED))
def w17_candle_patterns_as_prices(spark, sf_dir):
    found = W.candle_patterns_alt(bars(spark, sf_dir))
    return found.select(*KEY, *found.columns[7:])


@query(over(f"Ticker, Date, coalesce(Close = {_around('max', 'Close', 2, 2)}, false) AS swing_high, coalesce(Close = {_around('min', 'Close', 2, 2)}, false) AS swing_low"))
def w18_swings(spark, sf_dir):
    return W.swings(bars(spark, sf_dir)).select(*KEY, "swing_high", "swing_low")


@query(over(f"Ticker, Date, coalesce(High = {_around('max', 'High', 5, 5)}, false) AS swing_high, coalesce(Low = {_around('min', 'Low', 5, 5)}, false) AS swing_low"))
def w19_pivots(spark, sf_dir):
    return W.swings(bars(spark, sf_dir), 5, 5, "High", "Low").select(*KEY, "swing_high", "swing_low")


@query(over("Ticker, Date, p AS pivot, 2 * p - Low AS R1, 2 * p - High AS S1", "(SELECT *, (High + Low + Close) / 3 AS p FROM bars)"), "pivot R1 S1")
def w20_pivot_points(spark, sf_dir):
    return W.pivot_points(bars(spark, sf_dir)).select(*KEY, "pivot", "R1", "S1")


@query(over(f"Ticker, Date, (Volume - {full('avg', 'Volume', 20, 5)}) / nullif({full('stddev_samp', 'Volume', 20, 5)}, 0) AS Volume_z".replace("- CASE", "- (CASE").replace("END) /", "END)) /")), "Volume_z")
def w21_rolling_zscore(spark, sf_dir):
    return W.rolling_zscore(bars(spark, sf_dir), ["Volume"]).select(*KEY, "Volume_z")


@query(over(f"Ticker, Date, coalesce(ln(Close / lag(Close) OVER ({P})), 0) AS log_return, coalesce(Close / lag(Close) OVER ({P}) - 1, 0) AS pct_change, coalesce(Cum_TPV / Cum_Vol - lag(Cum_TPV / Cum_Vol) OVER ({P}), 0) AS VWAP_slope", "vw", _VWAP), "log_return pct_change VWAP_slope")
def w22_returns(spark, sf_dir):
    return W.returns(W.vwap(bars(spark, sf_dir))).select(*KEY, "log_return", "pct_change", "VWAP_slope")


@query(over("Ticker, Date, CASE WHEN len(h) = 20 THEN (len(list_filter(h, lambda x: x < Volume)) + (len(list_filter(h, lambda x: x = Volume)) + 1) / 2.0) / 20 ELSE 0 END AS Volume_rank", "h", f"h AS (SELECT *, list(Volume) OVER {frame(20)} AS h FROM bars)"), "Volume_rank")
def w23_percent_rank(spark, sf_dir):
    return W.rolling_pct_rank(bars(spark, sf_dir)).select(*KEY, "Volume_rank")


@query(over(f"Ticker, Date, avg(Close) OVER {frame(3)} AS Close"), "Close")
def w24_smooth(spark, sf_dir):
    return W.smooth(bars(spark, sf_dir), ["Close"]).select(*KEY, "Close")


@query(over(f"Ticker, Date, lag(r, 1) OVER ({P}) AS Range_pct_lag1, lag(r, 2) OVER ({P}) AS Range_pct_lag2, lag(r, 3) OVER ({P}) AS Range_pct_lag3", "(SELECT *, (High - Low) / Close AS r FROM bars)"), "Range_pct_lag1 Range_pct_lag2 Range_pct_lag3")
def w25_p1_range_lags(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("Range_pct", (F.col("High") - F.col("Low")) / F.col("Close"))
    return W.lags(b, ["Range_pct"]).select(*KEY, "Range_pct_lag1", "Range_pct_lag2", "Range_pct_lag3")


_HOLES = f"ho AS (SELECT Ticker, Date, CASE WHEN Volume > 20 THEN Close END AS x FROM bars), f1 AS (SELECT Ticker, Date, coalesce(x, lag(x) OVER ({P})) AS x FROM ho)"


@query(over(f"Ticker, Date, coalesce(x, lead(x) OVER ({P})) AS x", "f1", _HOLES))
def w26_fill_limit(spark, sf_dir):
    b = bars(spark, sf_dir).select(*KEY, F.when(F.col("Volume") > 20, F.col("Close")).alias("x"))
    return W.fill_limit(b, ["x"])


@query(over(f"Ticker, Date, s FROM (SELECT *, row_number() OVER ({P}) AS rn, min(CASE WHEN s IS NOT NULL THEN n END) OVER (PARTITION BY Ticker) AS a, max(CASE WHEN t IS NOT NULL THEN n END) OVER (PARTITION BY Ticker) AS b FROM (SELECT *, {full('avg', 'Close', 20)} AS s, lead(Close, 5) OVER ({P}) AS t, row_number() OVER ({P}) AS n FROM bars)) WHERE n BETWEEN a AND b --", ""), "s")
def w27_trim(spark, sf_dir):
    b = W.sma(bars(spark, sf_dir)).withColumnRenamed("SMA_20", "s").withColumn("t", W.F.lead("Close", 5).over(W.by_date()))
    return W.trim(b, ["s"], "t").select(*KEY, "s")


_RV = f"rv AS (SELECT Ticker, Date, {full('stddev_samp', 'r', 30)} * sqrt(252) AS realized_vol FROM (SELECT *, ln(Close / lag(Close) OVER ({P})) AS r FROM bars))".replace("END * sqrt", "END) * sqrt").replace("Date, CASE", "Date, (CASE")


@query(over("Ticker, Date, realized_vol", "rv", _RV) + " QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) = 1", "realized_vol")
def w28_realized_vol_latest(spark, sf_dir):
    return B.latest(W.realized_vol(bars(spark, sf_dir)).select(*KEY, "realized_vol"))


@query(over(f"Ticker, Date, a AS volume_mean, quantile_cont(Volume, 0.5) OVER {frame(20)} AS volume_median, Volume / a AS volume_ratio, coalesce(Volume > 4 * a, false) AS volume_burst", f"(SELECT *, {full('avg', 'Volume', 20)} AS a FROM bars)"), "volume_mean volume_median volume_ratio")
def w29_volume_ratio(spark, sf_dir):
    return W.volume_ratio(bars(spark, sf_dir)).select(*KEY, "volume_mean", "volume_median", "volume_ratio", "volume_burst")


@query(over(f"Ticker, Date, 100 * (Close / lag(Close, 5) OVER ({P}) - 1) AS ROC_5, 100 * ({full('avg', 'tr', 14)}) / Close AS ATR_pct, 100 * 4 * sd / Close AS BB_Width_pct", f"(SELECT *, {TR} AS tr, {full('stddev_samp', 'Close', 20)} AS sd FROM bars)"), "ROC_5 ATR_pct BB_Width_pct")
def w30_momentum(spark, sf_dir):
    return W.momentum(bars(spark, sf_dir)).select(*KEY, "ROC_5", "ATR_pct", "BB_Width_pct")


@query(over(f"Ticker, Date, ({ewm('Close', 2 / 21)}) AS EMA_20, ({ewm('Close', 2 / 51)}) AS EMA_50, ({ewm('Close', 2 / 201)}) AS EMA_200, {full('avg', 'Close', 20)} AS SMA_20", "nb", _NUMBERED), "EMA_20 EMA_50 EMA_200 SMA_20", 4)
def w31_indicator_suite(spark, sf_dir):
    return R.indicator_suite(bars(spark, sf_dir)).select(*KEY, "EMA_20", "EMA_50", "EMA_200", "SMA_20")
