"""Queries over labels, context, regimes, levels, signals and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import context as X
from quantloom.operators import evaluate as E
from quantloom.operators import labels as L
from quantloom.operators import levels as V
from quantloom.operators import recursive as R
from quantloom.operators import regime as G
from quantloom.operators import signals as S
from quantloom.operators import windows as W
from quantloom.operators.bars import last_n
from quantloom.plans.inputs import BARS, INDEX, SECTORS, P, bars, ewm, frame, full, index_bars, sectors
from quantloom.plans.q_bars import _BB, _LAGGED, ALL, KEY, TR, over
from quantloom.plans.registry import query
from quantloom.sources import files

C = F.col


@query(over(f"Ticker, Date, lead(Close, 10) OVER ({P}) / Close - 1 AS future_return, first_value(Close) OVER (PARTITION BY Ticker ORDER BY Date RANGE BETWEEN INTERVAL 14 DAY FOLLOWING AND UNBOUNDED FOLLOWING) / Close - 1 AS calendar_return"), "future_return calendar_return")
def l1_j4_future_return(spark, sf_dir):
    b = L.future_return(bars(spark, sf_dir), 14, calendar=True).withColumnRenamed("future_return", "calendar_return")
    return L.future_return(b, 10).select(*KEY, "future_return", "calendar_return")


_AHEAD = f"({P} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"


@query(over(f"Ticker, Date, max(High) OVER {_AHEAD} AS future_max_high, min(Low) OVER {_AHEAD} AS future_min_low, max(High) OVER {_AHEAD} / Close - 1 AS future_max_pct, min(Low) OVER {_AHEAD} / Close - 1 AS future_min_pct"), "future_max_pct future_min_pct")
def l2_future_extremes(spark, sf_dir):
    return L.future_extremes(bars(spark, sf_dir)).select(*KEY, "future_max_high", "future_min_low", "future_max_pct", "future_min_pct")


_HITS = f"""ah AS (SELECT *, list(High) OVER {_AHEAD} AS hs, list(Low) OVER {_AHEAD} AS ls, Close * 1.05 AS tp, Close * (1 - 0.03) AS sl FROM bars),
    hd AS (SELECT *, list_min(list_filter(list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN hs[i] >= tp THEN i END), lambda i: i IS NOT NULL)) AS td,
                  list_min(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] <= sl THEN i END), lambda i: i IS NOT NULL)) AS sd FROM ah)"""


@query(over("Ticker, Date, CASE WHEN hs IS NULL OR len(hs) = 0 THEN NULL WHEN coalesce(td, 11) < coalesce(sd, 11) THEN 1 WHEN coalesce(sd, 11) < coalesce(td, 11) THEN -1 ELSE 0 END AS bracket_label, CAST(least(td, sd) AS INT) AS hit_day", "hd", _HITS))
def l3_bracket_label(spark, sf_dir):
    return L.bracket_label(bars(spark, sf_dir)).select(*KEY, "bracket_label", "hit_day")


_OUT = f"{_HITS}, oc AS (SELECT *, CASE WHEN coalesce(td, 11) < coalesce(sd, 11) THEN 'TP_HIT' WHEN coalesce(sd, 11) < coalesce(td, 11) THEN 'SL_HIT' WHEN td IS NOT NULL THEN 'BOTH' ELSE 'NONE' END AS o FROM hd)"


@query(over("Ticker, Date, o AS future_bracket_outcome, CASE WHEN o = 'TP_HIT' THEN tp - Close WHEN o = 'NONE' THEN 0 ELSE sl - Close END AS PL, CASE WHEN o = 'TP_HIT' THEN 100 * (tp - Close) / Close WHEN o = 'SL_HIT' THEN 100 * (sl - Close) / Close END AS PL_percent", "oc", _OUT), "PL PL_percent")
def l4_bracket_outcome(spark, sf_dir):
    return L.bracket_outcome(bars(spark, sf_dir)).select(*KEY, "future_bracket_outcome", "PL", "PL_percent")


_TRADE = f"""dc AS (SELECT *, {full('max', 'High', 20)} AS up, ({full('min', 'Low', 20)}) * 0.99 AS st, list(struct_pack(d := Date, h := High, l := Low, c := Close)) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS ah FROM bars),
    ht AS (SELECT *, list_filter(ah, lambda b: b.h >= up OR b.l <= st)[1] AS hit FROM dc)"""


@query(over("Ticker, Date, CASE WHEN hit.h >= up THEN 'Target' WHEN hit.l <= st THEN 'Stop' WHEN len(ah) > 0 THEN 'Time' END AS outcome, CASE WHEN hit.h >= up THEN up WHEN hit.l <= st THEN st ELSE ah[-1].c END / Close - 1 AS trade_return, coalesce(hit.d, ah[-1].d) AS exit_date", "ht", _TRADE), "trade_return")
def l5_j5_bracket_trade(spark, sf_dir):
    d = W.donchian(bars(spark, sf_dir))
    return L.bracket_trade(d, C("Donchian_Upper"), C("Donchian_Lower") * 0.99).select(*KEY, "outcome", "trade_return", "exit_date")


@query(over(f"Ticker, Date, lead(Close) OVER ({P}) / Close - 1 AS next_return, lead(Close) OVER ({P}) / Close - 1 > 0 AS success"), "next_return")
def l6_next_close(spark, sf_dir):
    return L.next_close(bars(spark, sf_dir)).select(*KEY, "next_return", "success")


_IDX = f"""ix AS (SELECT *, row_number() OVER ({P}) AS rn FROM idx), ie AS (SELECT Ticker, Date, Close, {ewm('Close', 2 / 21)} AS EMA_20, {ewm('Close', 2 / 51)} AS EMA_50 FROM ix),
    wide AS (SELECT coalesce(a.Date, b.Date) AS Date, a.Close AS NIFTY_Close, CASE WHEN a.EMA_20 > a.EMA_50 THEN 'Bullish' WHEN a.Date IS NOT NULL THEN 'Bearish' END AS NIFTY_Trend, b.Close AS BANKNIFTY_Close
             FROM (SELECT * FROM ie WHERE Ticker = 'ALL') a FULL JOIN (SELECT * FROM ie WHERE Ticker = 'R0') b ON a.Date = b.Date)"""


def _index(spark, sf_dir):
    idx = R.averages(index_bars(spark, sf_dir).select(*KEY, "Close"), [R.span("EMA_20", 20), R.span("EMA_50", 50)])
    return X.index_features(idx, "ALL", "R0", ("NIFTY_", "BANKNIFTY_")).select("Date", "NIFTY_Close", "NIFTY_Trend", "BANKNIFTY_Close")


@query(f"WITH {INDEX}, {_IDX} SELECT * FROM wide")
def j2_index_features(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"WITH {BARS}, {INDEX}, {_IDX} SELECT Ticker, bars.Date, Close, NIFTY_Trend, Close / NIFTY_Close AS Close_vs_NIFTY_Close, Close / BANKNIFTY_Close AS Close_vs_BANKNIFTY_Close FROM bars LEFT JOIN wide ON bars.Date = wide.Date", "Close_vs_NIFTY_Close Close_vs_BANKNIFTY_Close")
def j1_p7_join_index(spark, sf_dir):
    return X.index_relatives(X.join_index(bars(spark, sf_dir), _index(spark, sf_dir))).select(*KEY, "Close", "NIFTY_Trend", "Close_vs_NIFTY_Close", "Close_vs_BANKNIFTY_Close")


@query(f"WITH {BARS}, {INDEX}, b AS (SELECT CAST(Date + 30 AS DATE) AS Date, Close FROM idx WHERE Ticker = 'ALL') SELECT coalesce(a.Date, b.Date) AS Date, a.Ticker, a.Close, b.Close AS nifty50_Close FROM bars a FULL JOIN b ON a.Date = b.Date")
def j3_outer_with_regime(spark, sf_dir):
    # the index as of 30 days later, so that some dates stand on one side only
    ahead = index_bars(spark, sf_dir).filter("Ticker = 'ALL'").select(F.date_add("Date", 30).alias("Date"), "Close")
    return X.outer_with_regime(bars(spark, sf_dir).select(*KEY, "Close"), ahead)


@query(f"WITH {BARS}, {SECTORS}, n AS (SELECT bars.Ticker, Date, coalesce(Sector, 'OTHERS') AS Sector FROM bars LEFT JOIN sectors ON bars.Ticker = sectors.Ticker) SELECT *, CAST(dense_rank() OVER (ORDER BY Sector) - 1 AS INT) AS Sector_code FROM n")
def p10_add_sector(spark, sf_dir):
    return X.add_sector(bars(spark, sf_dir).select(*KEY), sectors(spark, sf_dir))


@query(over("Ticker, Date, CASE WHEN Volume IS NOT NULL THEN ln(1 + greatest(Volume, 0)) END AS log_Volume, High / Low AS High_Low_ratio, Close / Open AS Close_Open_ratio, coalesce((Close - Low) / nullif(High - Low, 0), 0) AS Close_position, Volume / Close AS Volume_price_ratio"), "log_Volume High_Low_ratio Close_Open_ratio Close_position Volume_price_ratio")
def p4_p5_price_volume_features(spark, sf_dir):
    return X.price_volume_features(bars(spark, sf_dir)).select(*KEY, "log_Volume", "High_Low_ratio", "Close_Open_ratio", "Close_position", "Volume_price_ratio")


@query(over("Ticker, Date, coalesce(abs(Close - Open) / nullif(High - Low, 0), 0) AS body_pct, coalesce((High - greatest(Close, Open)) / nullif(High - Low, 0), 0) AS upper_wick_pct, coalesce((least(Close, Open) - Low) / nullif(High - Low, 0), 0) AS lower_wick_pct, coalesce(((Close + Open) / 2 - (High + Low) / 2) / nullif(High - Low, 0), 0) AS body_vs_mid"), "body_pct upper_wick_pct lower_wick_pct body_vs_mid", 5)
def p6_candle_features(spark, sf_dir):
    return X.candle_features(bars(spark, sf_dir)).select(*KEY, "body_pct", "upper_wick_pct", "lower_wick_pct", "body_vs_mid")


#: The suite of both indices and the bars, side by side by date.
_SUITE_COLUMNS = ("Close", "EMA_20", "EMA_50", "RSI_14", "MACD", "ATR_14", "BB_Upper", "BB_Lower", "BB_Mid")


def suite(spark, sf_dir):
    return R.indicator_suite(bars(spark, sf_dir))


def suite_with_index(spark, sf_dir):
    idx = files.settled(R.indicator_suite(index_bars(spark, sf_dir)).select(*KEY, *_SUITE_COLUMNS), "rows")  # two rows a date
    return X.join_index(suite(spark, sf_dir), X.index_features(idx, "ALL", "R0", ("NIFTY_", "BANKNIFTY_")))


def _suite_sql(name: str, source: str) -> str:
    """SQL of the indicator suite of a bar table as a table ``name``."""
    return f"""{name} AS (SELECT *, MACD_of.MACD AS MACD FROM (
        SELECT *, {ewm('Close', 2 / 21)} AS EMA_20, {ewm('Close', 2 / 51)} AS EMA_50, {ewm('Close', 2 / 201)} AS EMA_200, struct_pack(MACD := ({ewm('Close', 2 / 13)}) - ({ewm('Close', 2 / 27)})) AS MACD_of,
            {full('avg', 'Close', 20)} AS BB_Mid, ({full('avg', 'Close', 20)}) + 2 * ({full('stddev_samp', 'Close', 20)}) AS BB_Upper, ({full('avg', 'Close', 20)}) - 2 * ({full('stddev_samp', 'Close', 20)}) AS BB_Lower,
            {full('avg', 'tr', 14)} AS ATR_14, {full('avg', 'greatest(m, m * 0)', 14)} AS g, {full('avg', 'greatest(-m, m * 0)', 14)} AS l, 100 * (Close - ({full('min', 'Low', 14)})) / nullif(({full('max', 'High', 14)}) - ({full('min', 'Low', 14)}), 0) AS K,
            sum((High + Low + Close) / 3 * Volume) OVER {ALL} / sum(Volume) OVER {ALL} AS VWAP, {full('avg', 'Volume', 20)} AS volume_mean
        FROM (SELECT *, {TR} AS tr, Close - lag(Close) OVER ({P}) AS m, row_number() OVER ({P}) AS rn FROM {source}))),
    {name}_s AS (SELECT *, {ewm('MACD', 2 / 10)} AS MACD_signal, CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS RSI_14, {full('avg', 'K', 3)} AS D, {full('avg', 'ATR_14', 20)} AS atr_mean FROM {name})"""


_BASE = f"WITH {BARS}, {_suite_sql('s', 'bars')}"
_WITH_INDEX = f"{_BASE}, {INDEX}, {_suite_sql('i', 'idx')}, j AS (SELECT s_s.*, {', '.join(f'{p}.{c} AS {n}_{c}' for p, n in (('a', 'NIFTY'), ('b', 'BANKNIFTY')) for c in _SUITE_COLUMNS)} FROM s_s LEFT JOIN (SELECT * FROM i_s WHERE Ticker = 'ALL') a ON s_s.Date = a.Date LEFT JOIN (SELECT * FROM i_s WHERE Ticker = 'R0') b ON s_s.Date = b.Date)"


#: SQL of the relational features; RSI over MACD is left out, for MACD is near 0 so often that rounding decides its value.
_RELATIONAL = {
    "EMA_diff": "EMA_20 - EMA_50", "NIFTY_EMA_diff": "NIFTY_EMA_20 - NIFTY_EMA_50", "BANKNIFTY_EMA_diff": "BANKNIFTY_EMA_20 - BANKNIFTY_EMA_50", "MACD_diff": "MACD - MACD_signal",
    "RSI_diff_NIFTY": "RSI_14 - NIFTY_RSI_14", "RSI_diff_BANKNIFTY": "RSI_14 - BANKNIFTY_RSI_14", "MACD_diff_NIFTY": "MACD - NIFTY_MACD", "MACD_diff_BANKNIFTY": "MACD - BANKNIFTY_MACD",
    "VWAP_diff": "VWAP - Close", "VWAP_NIFTY_diff": "VWAP - NIFTY_EMA_20", "VWAP_BANKNIFTY_diff": "VWAP - BANKNIFTY_EMA_20",
    "BB_Width": "(BB_Upper - BB_Lower) / nullif(BB_Mid, 0)", "BB_Pos": "(Close - BB_Lower) / (BB_Upper - BB_Lower + 1e-6)", "NIFTY_BB_Width": "(NIFTY_BB_Upper - NIFTY_BB_Lower) / nullif(NIFTY_BB_Mid, 0)",
    "BANKNIFTY_BB_Width": "(BANKNIFTY_BB_Upper - BANKNIFTY_BB_Lower) / nullif(BANKNIFTY_BB_Mid, 0)", "Close_vs_EMA20": "Close / EMA_20 - 1", "Close_vs_EMA50": "Close / EMA_50 - 1",
    "BB_Mid_Dev": "(Close - BB_Mid) / (BB_Upper - BB_Lower + 1e-6)", "RSI_vs_NIFTY": "RSI_14 - NIFTY_RSI_14", "RSI_vs_BANKNIFTY": "RSI_14 - BANKNIFTY_RSI_14",
    "Range_over_ATR": "(High - Low) / (ATR_14 + 1e-6)", "Range_over_Close": "(High - Low) / Close", "VWAP_minus_Close": "VWAP - Close", "VWAP_minus_EMA20": "VWAP - EMA_20",
    "ATR_vs_NIFTY": "ATR_14 / (NIFTY_ATR_14 + 1e-6)", "ATR_vs_BANKNIFTY": "ATR_14 / (BANKNIFTY_ATR_14 + 1e-6)", "log_ATR_vs_NIFTY": "ln(1 + ATR_14 / (NIFTY_ATR_14 + 1e-6))",
}
_ML = {
    "MACD_minus_signal": "MACD - MACD_signal", "Close_vs_EMA20": "Close - EMA_20", "Close_vs_EMA50": "Close - EMA_50", "RSI_vs_NIFTY": "RSI_14 / (NIFTY_RSI_14 + 1e-6)", "RSI_vs_BANKNIFTY": "RSI_14 / (BANKNIFTY_RSI_14 + 1e-6)",
    "MACD_vs_NIFTY": "MACD - NIFTY_MACD", "MACD_vs_BANKNIFTY": "MACD - BANKNIFTY_MACD", "VWAP_vs_Close": "VWAP / (Close + 1e-6) - 1", "Range_over_ATR": "((High - Low) / Close) / (ATR_14 + 1e-6)",
    "ATR_vs_NIFTY": "ATR_14 / (NIFTY_ATR_14 + 1e-6)", "ATR_vs_BANKNIFTY": "ATR_14 / (BANKNIFTY_ATR_14 + 1e-6)", "log_ATR": "ln(1 + ATR_14)",
}
_listed = lambda columns: ", ".join(f"{x} AS {name}" for name, x in columns.items())


@query(f"{_WITH_INDEX} SELECT Ticker, Date, {_listed(_RELATIONAL)} FROM j", " ".join(_RELATIONAL), 3)
def p2_relational_features(spark, sf_dir):
    return X.relational_features(suite_with_index(spark, sf_dir)).select(*KEY, *_RELATIONAL)


_BASED = {"EMA_20": "Close", "EMA_50": "Close", "BB_Mid": "Close", "BB_Upper": "Close", "BB_Lower": "Close", "VWAP": "Close", "NIFTY_EMA_20": "NIFTY_Close", "NIFTY_BB_Mid": "NIFTY_Close", "BANKNIFTY_EMA_50": "BANKNIFTY_Close"}


@query(f"{_WITH_INDEX} SELECT Ticker, Date, {', '.join(f'{c} / {base} - 1 AS {c}_rel' for c, base in _BASED.items())} FROM j", " ".join(f"{c}_rel" for c in _BASED), 4)
def p3_relative_to_base(spark, sf_dir):
    return X.relative_to_base(suite_with_index(spark, sf_dir), list(_BASED)).select(*KEY, *(f"{c}_rel" for c in _BASED))


@query(f"{_WITH_INDEX} SELECT Ticker, Date, {_listed(_ML)} FROM j", " ".join(_ML), 3)
def p8_ml_features(spark, sf_dir):
    return X.ml_features(suite_with_index(spark, sf_dir)).select(*KEY, *_ML)


@query(f"{_BASE}, p AS (SELECT Ticker, Volume, Close AS PE, RSI_14 AS RSI FROM s_s QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) = 1) SELECT 'other' AS regime, Ticker FROM p WHERE Volume > (SELECT avg(Volume) FROM p) UNION ALL SELECT 'Bearish', Ticker FROM p WHERE PE / 75 < 20 UNION ALL SELECT 'Bullish', Ticker FROM p WHERE RSI > 50")
def p11_select_stocks(spark, sf_dir):
    # prices here are in the thousands: a ratio of price to one of 75 stands in for earnings
    last = files.settled(S.latest(suite(spark, sf_dir)).select("Ticker", "Volume", (C("Close") / 75).alias("PE"), C("RSI_14").alias("RSI")), "rows")
    kinds = (("Neutral", "other"), ("Bearish", "Bearish"), ("Bullish", "Bullish"))
    first, *rest = (X.select_stocks(last, regime).select(F.lit(name).alias("regime"), "Ticker") for regime, name in kinds)
    for other in rest:
        first = first.unionByName(other)
    return first


@query(over(f"Ticker, Date, CAST(r > 0.01 AS INT) AS long_target, CAST(r < -0.01 AS INT) AS short_target", f"(SELECT *, lead(Close, 5) OVER ({P}) / Close - 1 AS r FROM bars)"))
def p12_binary_target(spark, sf_dir):
    b = X.binary_target(L.future_return(bars(spark, sf_dir), 5), 0.01).withColumnRenamed("target", "long_target")
    return X.binary_target(b, 0.01, "short").withColumnRenamed("target", "short_target").select(*KEY, "long_target", "short_target")


_R8 = f"""CASE WHEN EMA_50 > EMA_200 AND MACD > MACD_signal AND RSI_14 > 60 THEN 'Strong Bull' WHEN EMA_50 > EMA_200 AND MACD < MACD_signal AND RSI_14 < 60 THEN 'Weak Bull' WHEN EMA_50 < EMA_200 AND MACD < MACD_signal AND RSI_14 < 40 THEN 'Strong Bear'
    WHEN EMA_50 < EMA_200 AND MACD > MACD_signal AND RSI_14 > 40 THEN 'Weak Bear' WHEN Close > BB_Upper THEN 'Overbought' WHEN Close < BB_Lower THEN 'Oversold' WHEN ATR_14 > avg(ATR_14) OVER {frame(50)} THEN 'High Volatility' ELSE 'Mean Reversion' END"""
_R5 = f"""CASE WHEN EMA_50 > EMA_200 AND MACD > MACD_signal AND RSI_14 > 55 THEN 'Bullish' WHEN EMA_50 < EMA_200 AND MACD < MACD_signal AND RSI_14 < 45 THEN 'Bearish' WHEN ATR_14 > avg(ATR_14) OVER {frame(50)} AND abs(MACD - MACD_signal) > 50 THEN 'High Volatility'
    WHEN Close < BB_Upper AND Close > BB_Lower AND RSI_14 > 40 AND RSI_14 < 60 THEN 'Mean Reversion' ELSE 'Neutral' END"""


@query(f"{_BASE} SELECT Ticker, Date, {_R8} AS regime_8, {_R5} AS regime_5 FROM s_s")
def r1_r2_regimes_by_row(spark, sf_dir):
    return G.regime_5(G.regime_8(suite(spark, sf_dir))).select(*KEY, "regime_8", "regime_5")


def _stateful(spark, sf_dir):
    needed = ["EMA_50", "EMA_200", "MACD", "MACD_signal", "RSI_14", "ATR_14", "BB_Upper", "BB_Lower"]
    return G.regime_stateful(suite(spark, sf_dir).select(*KEY, "Close", *needed).withColumn("ATR_50", W.mean(C("ATR_14"), 50)))


@query(f"""{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, ra AS (SELECT *, {full('avg', 'ATR_14', 50)} AS ATR_50 FROM s_s),
    rb AS (SELECT *, MACD - MACD_signal AS hist FROM ra WHERE BB_Upper IS NOT NULL AND RSI_14 IS NOT NULL AND ATR_14 IS NOT NULL AND ATR_50 IS NOT NULL),
    rc AS (SELECT *, row_number() OVER ({P}) AS pos, hist < 0 AND coalesce(lag(hist) OVER ({P}) < 0, false) AND coalesce(lag(hist, 2) OVER ({P}) < 0, false) AS falling FROM rb),
    rd AS (SELECT Ticker, Date, pos, CASE WHEN EMA_50 > EMA_200 AND hist > 0 AND RSI_14 > 55 THEN 'Bullish' WHEN EMA_50 < EMA_200 AND hist < 0 AND RSI_14 < 40 AND falling AND pos > 3 AND Close < EMA_50 THEN 'Bearish' WHEN ATR_14 > ATR_50 AND abs(hist) > 50 THEN 'High Volatility' END AS own FROM rc),
    re AS (SELECT Ticker, Date, pos, coalesce(own, 'Neutral') AS regime, 0 AS again FROM rd WHERE pos = 1
           UNION ALL SELECT Ticker, Date, pos, now, CASE WHEN now = before THEN again + 1 ELSE 0 END FROM (
               SELECT rd.*, re.regime AS before, re.again, coalesce(own, CASE WHEN re.regime IN ('Bullish', 'Bearish') AND re.again < 5 THEN re.regime ELSE 'Neutral' END) AS now FROM re JOIN rd ON re.Ticker = rd.Ticker AND rd.pos = re.pos + 1))
    SELECT Ticker, Date, regime, CASE regime WHEN 'Bearish' THEN -1 WHEN 'Bullish' THEN 1 WHEN 'High Volatility' THEN 2 ELSE 0 END AS regime_code FROM re""")
def r3_regime_stateful(spark, sf_dir):
    return X.regime_code(_stateful(spark, sf_dir), "regime").select(*KEY, "regime", "regime_code")


@query(f"""{_BASE} SELECT Ticker, Date, CASE WHEN Close > EMA_20 AND EMA_20 > EMA_50 AND RSI_14 > 60 THEN 'bullish' WHEN Close < EMA_20 AND EMA_20 < EMA_50 AND RSI_14 < 40 THEN 'bearish' ELSE 'neutral' END AS trend,
    CASE WHEN Volume < 12 THEN 'low' WHEN Volume > 18 THEN 'high' ELSE 'medium' END AS volatility, CAST(Date + CASE isodow(Date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT AS DATE) AS next_day FROM s_s QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) = 1""")
def r4_x3_snapshot(spark, sf_dir):
    return G.snapshot_regime(suite(spark, sf_dir).withColumn("vix", C("Volume"))).select(*KEY, "trend", "volatility", "next_day")


@query(f"{_BASE}, r AS (SELECT Ticker, Date, {_R5} AS regime FROM s_s), p AS (SELECT lag(regime) OVER ({P}) AS before, regime AS after FROM r) SELECT before, after, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY before) AS p FROM p WHERE before IS NOT NULL GROUP BY before, after", "p")
def r5_transition_matrix(spark, sf_dir):
    return G.transition_matrix(G.regime_5(suite(spark, sf_dir)), "regime_5")


_FORECAST = f"""{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, r AS (SELECT Ticker, Date, {_R5} AS regime FROM s_s),
    ls AS (SELECT Ticker, max(Date) AS last, arg_max(regime, Date) AS start FROM r GROUP BY Ticker),
    pa AS (SELECT Ticker, before AS x, after AS y, count(*) AS n FROM (SELECT Ticker, lag(regime) OVER ({P}) AS before, regime AS after FROM r) WHERE before IS NOT NULL GROUP BY ALL),
    sh AS (SELECT Ticker, regime AS y, count(*) / sum(count(*)) OVER (PARTITION BY Ticker) AS share FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) <= 10) GROUP BY Ticker, regime),
    nm AS (SELECT Ticker, start AS y FROM ls UNION SELECT Ticker, x FROM pa UNION SELECT Ticker, y FROM pa UNION SELECT Ticker, y FROM sh),
    wt AS (SELECT Ticker, least(0.9, max(share)) AS w FROM sh GROUP BY Ticker),
    tp AS (SELECT a.Ticker, a.y AS x, b.y, w, coalesce(share, 0) AS share, CASE WHEN sum(pa.n) OVER (PARTITION BY a.Ticker, a.y) > 0 THEN coalesce(pa.n, 0) / sum(pa.n) OVER (PARTITION BY a.Ticker, a.y) ELSE 1 / count(*) OVER (PARTITION BY a.Ticker, a.y) END AS p
        FROM nm a JOIN nm b ON a.Ticker = b.Ticker JOIN wt ON wt.Ticker = a.Ticker LEFT JOIN pa ON pa.Ticker = a.Ticker AND pa.x = a.y AND pa.y = b.y LEFT JOIN sh ON sh.Ticker = a.Ticker AND sh.y = b.y),
    st AS (SELECT nm.Ticker, 0 AS day, y, (y = start)::INT::DOUBLE AS q FROM nm JOIN ls ON ls.Ticker = nm.Ticker
           UNION ALL SELECT st.Ticker, day + 1, tp.y, (1 - any_value(w)) * sum(q * p) + any_value(w) * any_value(share) FROM st JOIN tp ON st.Ticker = tp.Ticker AND st.y = tp.x WHERE day < 15 GROUP BY st.Ticker, day, tp.y),
    be AS (SELECT Ticker, day, arg_max(y, (round(q, 12), y)) AS regime FROM st WHERE day > 0 GROUP BY Ticker, day)"""


@query(f"""{_FORECAST} SELECT Ticker, Date, regime, false AS is_forecast FROM r
    UNION ALL SELECT ls.Ticker, CAST(list_filter(list_transform(range(1, 2 * day + 8), lambda k: last + k::INT), lambda d: isodow(d) < 6)[day] AS DATE), regime, true FROM ls JOIN be ON ls.Ticker = be.Ticker""")
def r7_r8_forecast(spark, sf_dir):
    found = files.settled(G.regime_5(suite(spark, sf_dir)).select(*KEY, C("regime_5").alias("regime")), "rows")
    return G.append_forecast(found, G.forecast(found, 15, G.recent_share(found)))


@query(f"{_BASE}, r AS (SELECT Ticker, Date, {_R5} AS regime FROM s_s), p AS (SELECT Date, lag(regime) OVER ({P}) AS before, regime AS after FROM r), b AS (SELECT before, after AS likely FROM p WHERE before IS NOT NULL AND Date < DATE '1996-01-01' GROUP BY before, after QUALIFY row_number() OVER (PARTITION BY before ORDER BY count(*) DESC, after) = 1) SELECT count(*) AS n, count(*) FILTER (likely = after) AS hits, count(*) FILTER (likely = after) / count(*) AS accuracy FROM p LEFT JOIN b ON p.before = b.before WHERE p.before IS NOT NULL AND Date >= DATE '1996-01-01'", "accuracy")
def r9_next_state_accuracy(spark, sf_dir):
    return G.next_state_accuracy(G.regime_5(suite(spark, sf_dir)), "1996-01-01", "regime_5")


@query(f"{_BASE} SELECT Ticker, Date, CASE {_R5} WHEN 'Bearish' THEN -1 WHEN 'Bullish' THEN 1 WHEN 'High Volatility' THEN 2 ELSE 0 END AS regime_5_code FROM s_s")
def p9_regime_code(spark, sf_dir):
    return X.regime_code(G.regime_5(suite(spark, sf_dir)), "regime_5").select(*KEY, "regime_5_code")


@query(f"{_BASE}, r AS (SELECT Ticker, Date, {_R5} AS regime FROM s_s) SELECT regime, count(*) AS n FROM r GROUP BY regime")
def r9_regime_distribution(spark, sf_dir):
    return G.regime_5(suite(spark, sf_dir)).groupBy(C("regime_5").alias("regime")).agg(F.count("*").alias("n"))


_FIB = f"""nt AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS nth FROM bars),
    fb AS (SELECT Ticker, max(CASE WHEN nth <= 100 THEN High END) AS sh, min(CASE WHEN nth <= 100 THEN Low END) AS sl, arg_max(Close, Date) AS last_close, max(CASE WHEN nth > 1 THEN Close END) AS hb, count(*) AS n FROM nt GROUP BY Ticker HAVING count(*) >= 100),
    fl AS (SELECT *, unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]) AS x, unnest(['0%', '23%', '38%', '50%', '61%', '78%', '100%']) AS label, unnest([1, 2, 3, 4, 5, 6, 7]) AS k FROM fb),
    fn AS (SELECT *, sh - (sh - sl) * x AS price FROM fl QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY abs(last_close - (sh - (sh - sl) * x)), k) = 1)"""


@query(over("Ticker, sh AS swing_high, sl AS swing_low, last_close, label AS nearest_level, price AS nearest_price, 100 * (last_close - price) / price AS percent_offset, CASE WHEN last_close < price THEN 'approaching' WHEN last_close > price THEN CASE WHEN hb > price THEN 'crossed then approaching' ELSE 'crossed' END ELSE 'at level' END AS status, 100 * (sh - last_close) / (sh - sl) AS fib_percent", "fn", _FIB), "nearest_price percent_offset fib_percent")
def f1_f2_fib_snapshot(spark, sf_dir):
    return V.fib_position(V.fib_snapshot(bars(spark, sf_dir))).drop("levels")


_SW = f"""sw AS (SELECT *, High = CASE WHEN count(*) OVER w >= 11 THEN max(High) OVER w END AS hi, Low = CASE WHEN count(*) OVER w >= 11 THEN min(Low) OVER w END AS lo FROM bars WINDOW w AS ({P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    tp AS (SELECT Ticker, max(Date) AS d, arg_max(High, Date) AS h FROM sw WHERE hi GROUP BY Ticker)"""


@query(over("tp.Ticker, h AS swing_high, coalesce(arg_max(Low, sw.Date) FILTER (sw.Date < d), arg_max(Low, sw.Date)) AS swing_low", "tp JOIN sw ON sw.Ticker = tp.Ticker AND lo GROUP BY tp.Ticker, h", _SW))
def f3_fib_from_swings(spark, sf_dir):
    return V.fib_from_swings(bars(spark, sf_dir)).drop("levels")


_RUNS = """ix AS (SELECT *, row_number() OVER (PARTITION BY Ticker, kind ORDER BY Date) - 1 AS i FROM sr),
    ic AS (SELECT *, (y IS DISTINCT FROM lag(y) OVER (PARTITION BY Ticker, kind ORDER BY i))::INT AS new FROM ix),
    ir AS (SELECT *, sum(new) OVER (PARTITION BY Ticker, kind ORDER BY i) AS run FROM ic),
    rn AS (SELECT Ticker, kind, run, min(i) AS a, max(i) AS b, any_value(y) AS y FROM ir GROUP BY ALL),
    cd AS (SELECT Ticker, kind, (a + b) // 2 AS pos, y FROM rn QUALIFY lag(y) OVER (PARTITION BY Ticker, kind ORDER BY run) < y AND lead(y) OVER (PARTITION BY Ticker, kind ORDER BY run) < y)"""
_ZZ = f"""sr AS (SELECT Ticker, Date, 'peak' AS kind, Close AS y FROM bars UNION ALL SELECT Ticker, Date, 'trough', -Close FROM bars), {_RUNS},
    cr AS (SELECT *, row_number() OVER (PARTITION BY Ticker, kind ORDER BY y DESC, pos DESC) AS r FROM cd),
    pk AS (SELECT Ticker, kind, r, [pos] AS kept FROM cr WHERE r = 1
           UNION ALL SELECT pk.Ticker, pk.kind, cr.r, CASE WHEN len(list_filter(kept, lambda k: abs(k - pos) < 5)) > 0 THEN kept ELSE list_append(kept, pos) END FROM pk JOIN cr ON pk.Ticker = cr.Ticker AND pk.kind = cr.kind AND cr.r = pk.r + 1),
    kp AS (SELECT Ticker, kind, unnest(arg_max(kept, r)) AS pos FROM pk GROUP BY Ticker, kind),
    ky AS (SELECT kp.*, ix.y, ix.Date FROM kp JOIN ix ON kp.Ticker = ix.Ticker AND kp.kind = ix.kind AND pos = i),
    lb AS (SELECT ky.*, coalesce(max(ix.i) FILTER (ix.i < pos AND ix.y > ky.y), 0) AS l, coalesce(min(ix.i) FILTER (ix.i > pos AND ix.y > ky.y), 1000000000) AS r FROM ky JOIN ix ON ky.Ticker = ix.Ticker AND ky.kind = ix.kind GROUP BY ALL),
    pr AS (SELECT lb.*, min(ix.y) FILTER (ix.i BETWEEN l AND pos) AS lm, min(ix.y) FILTER (ix.i BETWEEN pos AND lb.r) AS rm FROM lb JOIN ix ON lb.Ticker = ix.Ticker AND lb.kind = ix.kind GROUP BY ALL),
    zz AS (SELECT Ticker, Date, abs(y) AS price, kind FROM pr WHERE y - greatest(lm, rm) >= 1.0)"""
_LEGS = "lg AS (SELECT Ticker, lag(Date) OVER w AS start_date, Date AS end_date, lag(price) OVER w AS start_price, price AS end_price FROM zz WINDOW w AS (PARTITION BY Ticker ORDER BY Date, kind))"


def _grouped(points: str, tolerance: str) -> str:
    """SQL of sorted prices in groups around their running mean."""
    return f"""zs AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY price) AS k FROM {points}),
    zc AS (SELECT Ticker, k, price, 1 AS c, price AS total, 1 AS n FROM zs WHERE k = 1
           UNION ALL SELECT zs.Ticker, zs.k, zs.price, CASE WHEN near THEN c ELSE c + 1 END, CASE WHEN near THEN total + zs.price ELSE zs.price END, CASE WHEN near THEN n + 1 ELSE 1 END
           FROM (SELECT zc.*, x.price AS next, abs(x.price - total / n) <= {tolerance} AS near FROM zc JOIN zs x ON zc.Ticker = x.Ticker AND x.k = zc.k + 1) q JOIN zs ON q.Ticker = zs.Ticker AND zs.k = q.k + 1),
    zg AS (SELECT Ticker, c, min(price) AS low, max(price) AS high, count(*) AS n FROM zc GROUP BY Ticker, c)"""


@query(f"WITH RECURSIVE {BARS}, {_ZZ} SELECT * FROM zz")
def f4_zigzag(spark, sf_dir):
    return V.zigzag(bars(spark, sf_dir))


@query(f"WITH RECURSIVE {BARS}, {_ZZ}, {_grouped('zz', '0.01 * (total / n)')} SELECT Ticker, row_number() OVER (PARTITION BY Ticker ORDER BY n DESC, c)::INT AS zone_rank, low, high, n::DOUBLE AS strength FROM zg WHERE n >= 2 AND (high - low) / low > 0.001 AND (high - low) / low < 0.03 QUALIFY zone_rank <= 5")
def f5_zones(spark, sf_dir):
    return V.zones(V.zigzag(bars(spark, sf_dir)))


@query(f"WITH RECURSIVE {BARS}, {_ZZ}, {_LEGS} SELECT Ticker, start_date, end_date, label, end_price - (end_price - start_price) * x AS price FROM lg, (VALUES (0.0::DOUBLE, '0%'), (0.236, '23%'), (0.382, '38%'), (0.5, '50%'), (0.618, '61%'), (0.786, '78%'), (1.0, '100%')) v(x, label) WHERE abs((end_price - start_price) / start_price) >= 0.01", "price")
def f6_fib_legs(spark, sf_dir):
    return V.fib_legs(V.zigzag(bars(spark, sf_dir)))


@query(f"""WITH RECURSIVE {BARS}, sr AS (SELECT Ticker, Date, 'peak' AS kind, High AS y FROM bars UNION ALL SELECT Ticker, Date, 'trough', -Low FROM bars), {_RUNS},
    tn AS (SELECT Ticker, Date, Close, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY Ticker) AS nt, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS nth, {TR} AS tr FROM bars),
    tl AS (SELECT Ticker, avg(tr) / 2 AS tol FROM tn WHERE nth <= 14 AND nt >= 14 GROUP BY Ticker), zp AS (SELECT Ticker, abs(y) AS price, tol FROM cd JOIN tl USING (Ticker)), {_grouped('zp', 'x.tol')},
    zi AS (SELECT zg.Ticker, low, high, n AS touches, sum(CASE WHEN nt > 1 THEN 0.7 + (1 - 0.7) * (rn - 1) / (nt - 1) ELSE 0.7 END) AS strength FROM zg JOIN tn ON zg.Ticker = tn.Ticker AND Close BETWEEN low AND high WHERE n >= 2 GROUP BY ALL)
    SELECT Ticker, row_number() OVER (PARTITION BY Ticker ORDER BY strength DESC, low)::INT AS zone_rank, low, high, touches::INT AS touches, strength FROM zi QUALIFY zone_rank <= 5""", "strength")
def f7_j7_atr_zones(spark, sf_dir):
    return V.atr_zones(bars(spark, sf_dir)).select("Ticker", "zone_rank", "low", "high", "touches", "strength")


_PIVOTS = f"""pv AS (SELECT *, Close = CASE WHEN count(*) OVER w >= 11 THEN max(Close) OVER w END AS hi, Close = CASE WHEN count(*) OVER w >= 11 THEN min(Close) OVER w END AS lo FROM bars WINDOW w AS ({P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    pr AS (SELECT Ticker, Date, hi, CASE WHEN hi THEN High ELSE Low END AS level FROM pv WHERE hi OR lo QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) <= 250),
    pn AS (SELECT Ticker, hi, level FROM pr GROUP BY Ticker, hi, level QUALIFY row_number() OVER (PARTITION BY Ticker, hi ORDER BY max(Date) DESC) <= 5),
    nc AS (SELECT Ticker, arg_max(Close, Date) AS Close FROM bars GROUP BY Ticker),
    nl AS (SELECT nc.Ticker, nc.Close, coalesce(max(level) FILTER (NOT hi AND level <= nc.Close), max(level) FILTER (NOT hi)) AS support, coalesce(min(level) FILTER (hi AND level >= nc.Close), min(level) FILTER (hi)) AS resistance FROM nc LEFT JOIN pn ON nc.Ticker = pn.Ticker GROUP BY ALL),
    nd AS (SELECT *, greatest(least(coalesce((Close - support) / Close, 1.0), 0.5), -0.5) AS support_distance, greatest(least(coalesce((resistance - Close) / Close, 1.0), 0.5), -0.5) AS resistance_distance FROM nl)"""


@query(f"WITH {BARS}, {_PIVOTS} SELECT * FROM nd", "support_distance resistance_distance")
def f8_nearest_levels(spark, sf_dir):
    return V.nearest_levels(bars(spark, sf_dir))


@query(f"WITH RECURSIVE {BARS}, {_ZZ}, {_LEGS} SELECT *, CAST(start_date + (datediff('day', start_date, end_date) // 2)::INT AS DATE) AS mid_date, (start_price + end_price) / 2 AS mid_price FROM lg WHERE start_date IS NOT NULL", "mid_price")
def f9_leg_midpoints(spark, sf_dir):
    return V.leg_midpoints(V.zigzag(bars(spark, sf_dir)))


def _last(spark, sf_dir):
    """Screen columns and the Fibonacci position of each ticker's last bar; their means are of its last 20 bars."""
    b = files.settled(bars(spark, sf_dir), "bars")
    ended = last_n(R.indicator_suite(b).select(*KEY, "Close", "Volume", "VWAP", "EMA_20", "EMA_50", "RSI_14", "ATR_14"), 20)
    return S.last_with(S.with_screen_columns(ended), V.fib_position(V.fib_snapshot(b)).select("Ticker", "fib_percent"))


def _every(spark, sf_dir):
    """Screen columns and the Fibonacci position of every bar, for few last bars fulfil all conditions."""
    return V.fib_position_by_bar(S.with_screen_columns(suite(spark, sf_dir)), 10)


_EVERY = f"{_BASE}, la AS (SELECT *, 100 * ({full('max', 'High', 10)} - Close) / nullif({full('max', 'High', 10)} - {full('min', 'Low', 10)}, 0) AS fib_percent FROM s_s)"
_LAST = f"{_BASE}, {_FIB}, la AS (SELECT s_s.*, 100 * (sh - last_close) / (sh - sl) AS fib_percent FROM s_s LEFT JOIN fn ON s_s.Ticker = fn.Ticker QUALIFY row_number() OVER (PARTITION BY s_s.Ticker ORDER BY Date DESC) = 1)"
_LABELS = """CASE WHEN EMA_20 > EMA_50 THEN 'Bullish' ELSE 'Bearish' END AS ema_label, CASE WHEN RSI_14 > 70 THEN 'Overbought' WHEN RSI_14 < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_label,
    CASE WHEN Close > VWAP THEN 'Reclaimed' ELSE 'Below' END AS vwap_label, CASE WHEN Volume > volume_mean THEN 'High' ELSE 'Low' END AS volume_label"""


@query(f"{_LAST} SELECT Ticker, Date, fib_percent, {_LABELS} FROM la WHERE fib_percent BETWEEN 50 AND 65", "fib_percent")
def s2_fib_band(spark, sf_dir):
    return S.screen_fib_band(_last(spark, sf_dir)).select(*KEY, "fib_percent", "ema_label", "rsi_label", "vwap_label", "volume_label")


@query(f"{_LAST} SELECT Ticker, Date, fib_percent, {_LABELS} FROM la WHERE fib_percent BETWEEN 50 AND 61", "fib_percent")
def s2_fib_band_narrow(spark, sf_dir):
    return S.screen_fib_band(_last(spark, sf_dir), 50, 61).select(*KEY, "fib_percent", "ema_label", "rsi_label", "vwap_label", "volume_label")


@query(f"{_LAST} SELECT Ticker, Date FROM la WHERE EMA_20 > EMA_50 AND RSI_14 > 40 AND RSI_14 < 60 AND Close > VWAP AND Volume > volume_mean")
def s3_trend_volume(spark, sf_dir):
    return S.screen_trend_volume(_last(spark, sf_dir)).select(*KEY)


@query(f"{_LAST} SELECT Ticker, Date, {_LABELS} FROM la")
def s4_annotated_scan(spark, sf_dir):
    return S.annotate(_last(spark, sf_dir)).select(*KEY, "ema_label", "rsi_label", "vwap_label", "volume_label")


@query(f"{_EVERY} SELECT Ticker, Date FROM la WHERE EMA_20 > EMA_50 AND MACD > MACD_signal AND Close > VWAP AND RSI_14 > 45 AND RSI_14 < 60 AND Volume > volume_mean AND fib_percent BETWEEN 45 AND 61")
def s5_bullish(spark, sf_dir):
    return S.screen_bullish(_every(spark, sf_dir)).select(*KEY)


@query(f"{_EVERY} SELECT Ticker, Date FROM la WHERE EMA_20 < EMA_50 AND MACD < MACD_signal AND Close < VWAP AND RSI_14 > 40 AND RSI_14 < 55 AND Volume > volume_mean AND fib_percent BETWEEN 38 AND 50")
def s6_bearish(spark, sf_dir):
    return S.screen_bearish(_every(spark, sf_dir)).select(*KEY)


@query(f"{_BASE} SELECT Ticker, Date, Close, CASE WHEN Close > BB_Upper THEN 'Bullish' ELSE 'Bearish' END AS direction FROM s_s WHERE (Close >= BB_Upper * 0.99 OR Close <= BB_Lower * 1.01) AND Volume >= volume_mean * 1.5")
def s7_neutral_breakout(spark, sf_dir):
    # over all bars, for few last ones break out
    return S.screen_neutral_breakout(S.with_screen_columns(W.atr(W.bollinger(bars(spark, sf_dir))))).select(*KEY, "Close", "direction")


@query(f"{_LAST} SELECT Ticker, Date FROM la WHERE ATR_14 > atr_mean * 1.5 AND ((RSI_14 < 30 AND fib_percent >= 61) OR (RSI_14 > 70 AND fib_percent <= 38))")
def s8_high_volatility(spark, sf_dir):
    return S.screen_high_volatility(_last(spark, sf_dir)).select(*KEY)


@query(f"{_BASE}, {_PIVOTS} SELECT s_s.Ticker, Date FROM s_s LEFT JOIN nd ON s_s.Ticker = nd.Ticker WHERE EMA_20 > EMA_50 AND MACD > MACD_signal AND RSI_14 BETWEEN 40 AND 60 AND K > D AND s_s.Close > VWAP AND Volume > volume_mean AND (support IS NULL OR s_s.Close >= support)")
def s9_multi_confluence(spark, sf_dir):
    # over all bars, for few last ones fulfil all conditions
    support = V.nearest_levels(bars(spark, sf_dir)).select("Ticker", C("support").alias("zone_low"))
    return S.screen_multi_confluence(S.with_screen_columns(suite(spark, sf_dir)).join(support, "Ticker", "left")).select(*KEY)


@query(over("Ticker, Date, Volume", f"(SELECT *, {full('avg', 'Volume', 20)} AS volume_mean FROM bars) WHERE Volume >= volume_mean * 4"))
def s10_volume_burst(spark, sf_dir):
    # over all bars, for few last ones burst
    return S.screen_volume_burst(S.with_screen_columns(W.atr(bars(spark, sf_dir)))).select(*KEY, "Volume")


@query(f"""{_BASE} SELECT Ticker, Date FROM (SELECT *, {full('avg', 'ATR_14', 14)} AS a14, {full('avg', 'ATR_14', 5)} AS a5, {full('min', 'Low', 3)} AS l3, lag(RSI_14) OVER ({P}) AS r1 FROM s_s)
    WHERE EMA_20 > EMA_50 AND RSI_14 < 45 AND K < 40 AND ATR_14 > a14 * 1.05 AND ATR_14 < a5 * 1.15 AND Volume < volume_mean AND (coalesce(RSI_14 > r1, false) OR coalesce(K > D, false)) AND Close > l3 * 1.03""")
def s11_signal_c(spark, sf_dir):
    return S.signal_c(suite(spark, sf_dir)).filter("take_trade").select(*KEY)


_SMOOTH = f"WITH {BARS}, sm AS (SELECT Ticker, Date, {', '.join(f'avg({c}) OVER {frame(10)} AS {c}' for c in ('Open', 'High', 'Low', 'Close'))}, Volume FROM bars), {_suite_sql('s', 'sm')}"


@query(f"""{_SMOOTH} SELECT Ticker, Date FROM (SELECT *, {full('avg', 'ATR_14', 14)} AS a14, lag(RSI_14) OVER ({P}) AS r1, lag(Close) OVER ({P}) AS c1 FROM s_s)
    WHERE EMA_20 >= EMA_50 * 0.985 AND RSI_14 < 45 AND K < 40 AND Close <= BB_Lower * 1.02 AND Volume < volume_mean * 0.9 AND ATR_14 > a14 * 1.05 AND Close - Low > High - Close AND coalesce(RSI_14 > r1, false)::INT + coalesce(K > D, false)::INT + coalesce(Close > c1, false)::INT >= 2""")
def s12_signal_c_plus(spark, sf_dir):
    # prices of ten bars' mean, for single trades never close so far below their band
    smooth = bars(spark, sf_dir).withColumns({c: F.avg(c).over(W.rolling(10)) for c in ("Open", "High", "Low", "Close")})
    return S.signal_c_plus(R.indicator_suite(smooth)).filter("take_trade").select(*KEY)


@query(f"""{_BASE} SELECT Ticker, Date FROM (SELECT *, lag(RSI_14) OVER ({P}) AS r1 FROM s_s)
    WHERE EMA_20 > EMA_50 AND EMA_50 > EMA_200 AND (coalesce(Low <= EMA_20 - ATR_14 * 0.5, false) OR (Close / EMA_20 >= 0.97 AND Close / EMA_20 <= 1.02)) AND (MACD > MACD_signal OR (coalesce(RSI_14 BETWEEN 45 AND 65, false) AND (coalesce(RSI_14 > r1, false) OR coalesce(K > D, false)))) AND Volume > volume_mean * 0.8 AND Close < EMA_20 * 1.04""")
def s13_signal_d(spark, sf_dir):
    return S.signal_d(suite(spark, sf_dir)).filter("take_trade").select(*KEY)


_ENTRIES = f"""{_BASE}, {_LAGGED}, en AS (SELECT s_s.*, {_R5} AS regime, {full('max', 'High', 20)} AS up, {full('min', 'Low', 20)} AS dn FROM s_s),
    eb AS (SELECT en.*, lag(up) OVER (PARTITION BY en.Ticker ORDER BY en.Date) AS up1, (up + dn) / 2 AS mid, coalesce(c1 < o1 AND lg.Close > lg.Open AND lg.Close > o1 AND lg.Open < c1, false)
        OR (size > 3 * body AND (lg.Close - lg.Low) / (1e-6 + lg.High - lg.Low) > 0.6 AND (lg.Open - lg.Low) / (1e-6 + lg.High - lg.Low) > 0.6) OR coalesce(c2 < o2 AND abs(c1 - o1) <= 0.3 * (h1 - l1) AND lg.Close > (o2 + c2) / 2, false) AS pattern FROM en JOIN lg ON en.Ticker = lg.Ticker AND en.Date = lg.Date)"""


@query(f"""{_ENTRIES} SELECT Ticker, Date, 'pattern' AS entry FROM eb WHERE regime = 'Bullish' AND pattern UNION ALL SELECT Ticker, Date, 'pullback' FROM eb WHERE regime = 'Bullish' AND Close <= dn * (1 + 0.02) AND Close > Open
    UNION ALL SELECT Ticker, Date, 'neutral' FROM eb WHERE regime = 'Neutral' AND Close > mid AND RSI_14 > 50 UNION ALL SELECT Ticker, Date, 'non_bearish' FROM eb WHERE regime <> 'Bearish' AND Close > mid UNION ALL SELECT Ticker, Date, 'breakout' FROM eb WHERE regime <> 'Bearish' AND Close > up1""")
def s14_entries(spark, sf_dir):
    df = W.candle_patterns(W.donchian(G.regime_5(suite(spark, sf_dir)).withColumnRenamed("regime_5", "regime")))
    return S.entries(df).select(*KEY, "entry")


_MOVE = f"""{_BASE}, {_PIVOTS}, mv AS (SELECT s_s.*, quantile_cont(Volume, 0.5) OVER {frame(20)} AS vm FROM s_s QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) = 1),
    mp AS (SELECT mv.Ticker, Date, 1 / (1 + exp(-(2.0 * (mv.Close - VWAP) / VWAP + 1.2 * (RSI_14 - 50) / 50 + sign(MACD - MACD_signal) + (MACD - MACD_signal) / (abs(mv.Close) + 1e-9) - 3.0 * ATR_14 / mv.Close + 0.8 * (Volume / (vm + 1e-9) - 1)
        + 2.5 * (1 - abs(support_distance)) * CASE WHEN support_distance >= 0 THEN 1 ELSE -1 END - 2.5 * (1 - abs(resistance_distance)) * CASE WHEN resistance_distance <= 0 THEN 1 ELSE -1 END))) AS p_up FROM mv JOIN nd ON mv.Ticker = nd.Ticker)"""


@query(f"{_MOVE} SELECT *, CASE WHEN p_up > 0.65 THEN 'LONG' WHEN 1 - p_up > 0.65 THEN 'SHORT' ELSE 'WAIT' END AS signal FROM mp", "p_up", 5)
def s15_move_probability(spark, sf_dir):
    b = files.settled(bars(spark, sf_dir), "bars")
    # the last bar's mean and median of volume are of its last 20 bars
    ended = last_n(R.indicator_suite(b).select(*KEY, "Close", "Volume", "VWAP", "RSI_14", "ATR_14", "MACD", "MACD_signal"), 20)
    last = S.last_with(W.volume_ratio(ended), V.nearest_levels(b).drop("Close"))
    return S.move_probability(last).select(*KEY, "p_up", "signal")


def _outcomes(spark, sf_dir):
    return L.bracket_outcome(bars(spark, sf_dir))


_BT = f"""WITH {BARS}, {_OUT}, v AS (SELECT *, o IN ('TP_HIT', 'SL_HIT') AS valid, CASE WHEN o = 'TP_HIT' THEN (tp - Close) / Close WHEN o = 'SL_HIT' THEN (sl - Close) / Close END AS gain FROM oc),
    dy AS (SELECT Date, count(*) FILTER (valid) AS nv, 1 + coalesce(sum(gain) / nullif(count(*) FILTER (valid), 0), 0) AS f FROM v GROUP BY Date), eq AS (SELECT Date, nv, exp(sum(ln(f)) OVER (ORDER BY Date)) AS e FROM dy), e2 AS (SELECT *, coalesce(lag(e) OVER (ORDER BY Date), 1.0) AS b FROM eq),
    tr AS (SELECT Ticker, v.Date, o, gain, 100 * gain AS pnl_percent, CASE WHEN gain IS NOT NULL THEN b / nv * gain END AS trade_pnl, ln(e) AS log_equity FROM v JOIN e2 ON v.Date = e2.Date)"""


@query(f"{_BT} SELECT Ticker, Date, o AS future_bracket_outcome, pnl_percent, log_equity FROM tr", "pnl_percent log_equity", 5)
def ag1_bracket_backtest(spark, sf_dir):
    found = E.bracket_backtest(_outcomes(spark, sf_dir), 1.0)
    return found.select(*KEY, "future_bracket_outcome", "pnl_percent", F.log("cumulative_equity").alias("log_equity"))


@query(f"{_BT.replace('(tp - Close) / Close', '(Close - tp) / Close').replace('(sl - Close) / Close', '(Close - sl) / Close')} SELECT Ticker, Date, o AS future_bracket_outcome, pnl_percent, log_equity FROM tr", "pnl_percent log_equity", 5)
def ag1_bracket_backtest_short(spark, sf_dir):
    found = E.bracket_backtest(_outcomes(spark, sf_dir), 1.0, "short")
    return found.select(*KEY, "future_bracket_outcome", "pnl_percent", F.log("cumulative_equity").alias("log_equity"))


@query(f"{_BT} SELECT count(*) AS signals, count(*) FILTER (o = 'TP_HIT') AS tp_hit, count(*) FILTER (o = 'SL_HIT') AS sl_hit, count(*) FILTER (o = 'BOTH') AS both, count(*) FILTER (o = 'NONE') AS none, count(trade_pnl) AS trades, 100.0 * count(*) FILTER (trade_pnl > 0) / count(trade_pnl) AS win_rate, avg(trade_pnl) AS expectancy, max(trade_pnl) AS max_win, min(trade_pnl) AS max_loss, sum(trade_pnl) AS total_pnl FROM tr", "win_rate expectancy max_win max_loss total_pnl", 5)
def ag2_pnl_summary(spark, sf_dir):
    return E.pnl_summary(E.bracket_backtest(_outcomes(spark, sf_dir), 1.0))


@query(over("outcome, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.75) AS p75, max(r) AS max FROM (SELECT CASE WHEN hit.h >= up THEN 'Target' WHEN hit.l <= st THEN 'Stop' WHEN len(ah) > 0 THEN 'Time' END AS outcome, CASE WHEN hit.h >= up THEN up WHEN hit.l <= st THEN st ELSE ah[-1].c END / Close - 1 AS r FROM ht) GROUP BY outcome --", "ht", _TRADE), "mean std min p25 p50 p75 max")
def ag3_performance_by_outcome(spark, sf_dir):
    d = W.donchian(bars(spark, sf_dir))
    trades = L.bracket_trade(d, C("Donchian_Upper"), C("Donchian_Lower") * 0.99).select("outcome", "trade_return")
    return E.performance_by_outcome(files.settled(trades, "rows"))


@query(f"WITH {BARS}, {_OUT}, r AS (SELECT CASE o WHEN 'TP_HIT' THEN tp WHEN 'NONE' THEN Close ELSE sl END / Close - 1 AS r FROM oc) SELECT count(r) AS trades, count(*) FILTER (r > 0) / count(r) AS success_rate, avg(r) AS mean_return, 6 + count(r) * log10(1 + avg(r)) AS final_log10 FROM r", "success_rate mean_return final_log10", 5)
def ag3_performance(spark, sf_dir):
    return E.performance(_outcomes(spark, sf_dir).withColumn("trade_return", C("PL") / C("Close")), 1_000_000.0).drop("final_value")


def _scored(spark, sf_dir):
    b = X.binary_target(L.future_return(bars(spark, sf_dir), 5), 0.0).dropna(subset=["future_return"])
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "Ticker", C("Date").cast("string"))), 1, 6), 16, 10).cast("double") / 16777216.0
    return b.select(*KEY, "future_return", "target", digest.alias("prob"))


_SCORED = f"sc AS (SELECT * FROM (SELECT Ticker, Date, lead(Close, 5) OVER ({P}) / Close - 1 AS future_return, CAST(lead(Close, 5) OVER ({P}) / Close - 1 > 0 AS INT) AS target, CAST('0x' || substring(md5(Ticker || '|' || CAST(Date AS VARCHAR)), 1, 6) AS BIGINT) / 16777216.0 AS prob FROM bars) WHERE future_return IS NOT NULL)"


@query(over("count(*) FILTER (t AND g) AS tp, count(*) FILTER (t AND NOT g) AS fp, count(*) FILTER (t AND g) / count(*) FILTER (t) AS precision, count(*) FILTER (t AND g) / count(*) FILTER (g) AS recall, avg(future_return) FILTER (t AND g) AS avg_win, avg(future_return) FILTER (t AND NOT g) AS avg_loss, count(*) FILTER (t AND g) / count(*) FILTER (t) * coalesce(avg(future_return) FILTER (t AND g), 0) + (1 - count(*) FILTER (t AND g) / count(*) FILTER (t)) * coalesce(avg(future_return) FILTER (t AND NOT g), 0) AS expectation, count(*) FILTER (t) / count(*) AS coverage", "(SELECT *, prob >= 0.7 AS t, future_return > 0 AS g FROM sc)", _SCORED), "precision recall avg_win avg_loss expectation coverage")
def ag4_trade_metrics(spark, sf_dir):
    return E.trade_metrics(_scored(spark, sf_dir), 0.7)


_GRID = """gr AS (SELECT k, CASE WHEN k = 49 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE + (0.95::DOUBLE - 0.5::DOUBLE) / 49::DOUBLE * k END AS threshold FROM range(50) t(k)),
    tt AS (SELECT threshold, count(prob) AS trades, count(*) FILTER (target = 1) / nullif(count(prob), 0) AS precision FROM gr LEFT JOIN sc ON prob >= threshold GROUP BY threshold)"""


@query(over("threshold, CAST(trades AS BIGINT) AS trades, precision", "tt", f"{_SCORED}, {_GRID}"), "threshold precision")
def ag5_threshold_table(spark, sf_dir):
    return E.threshold_table(_scored(spark, sf_dir))


@query(over("coalesce(min(threshold), 0.5) AS threshold", "tt WHERE trades >= 100 AND precision >= (SELECT max(precision) - 0.002 FROM tt WHERE trades >= 100)", f"{_SCORED}, {_GRID}"), "threshold")
def ag5_select_threshold(spark, sf_dir):
    # the floor is just below the best precision, so that the first threshold is seldom the one
    table = E.threshold_table(_scored(spark, sf_dir))
    best = F.max(F.when(C("trades") >= 100, C("precision"))).over(Window.partitionBy())  # 50 rows
    return E.select_from(table.withColumn("floor", best - 0.002), 100, C("floor"))


@query(over("count(prob) AS n, avg(prob) AS mean, stddev_samp(prob) AS std, min(prob) AS min, " + ", ".join(f"quantile_cont(prob, 0.{x}) AS p{x}" for x in (25, 50, 75, 90, 95, 99)) + ", max(prob) AS max", "sc", _SCORED), "mean std min p25 p50 p75 p90 p95 p99 max")
def ag6_probability_distribution(spark, sf_dir):
    return E.probability_distribution(files.settled(_scored(spark, sf_dir).select("prob"), "rows"))


@query(over("target, CAST(prob >= 0.5 AS INT) AS predicted, count(*) AS n", "sc GROUP BY ALL", _SCORED))
def ag7_confusion(spark, sf_dir):
    return E.confusion(_scored(spark, sf_dir))


@query(over("count(*) FILTER (target = 1) AS positives, count(*) FILTER (target = 0) AS negatives, count(*) FILTER (target = 0) / count(*) FILTER (target = 1) AS positive_weight", "sc", _SCORED), "positive_weight")
def ag7_class_counts(spark, sf_dir):
    return E.class_counts(_scored(spark, sf_dir))


@query(over("""avg(CAST((prob >= 0.5) = (target = 1) AS INT)) AS accuracy, 2.0 * count(*) FILTER (prob >= 0.5 AND target = 1) / (2 * count(*) FILTER (prob >= 0.5 AND target = 1) + count(*) FILTER ((prob >= 0.5) <> (target = 1))) AS f1,
    (sum(r) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0) / (1.0 * count(*) FILTER (target = 1) * count(*) FILTER (target = 0)) AS auc""", "(SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM sc)", _SCORED), "accuracy f1 auc")
def ag7_quality(spark, sf_dir):
    return E.quality(_scored(spark, sf_dir))


def _profile_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, quantile_cont({c}, 0.5)::DOUBLE AS median, max({c})::DOUBLE AS max, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS distinct FROM bars"


@query(f"WITH {BARS} {_profile_sql('Close')} UNION ALL {_profile_sql('Volume')}", "mean std min median max")
def ag8_profile(spark, sf_dir):
    return E.profile(bars(spark, sf_dir), ["Close", "Volume"])


@query(f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM bars, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM bars)" for c in ("Close", "Volume")))
def ag9_iqr_outliers(spark, sf_dir):
    return E.iqr_outliers(bars(spark, sf_dir), ["Close", "Volume"])


@query(over("Ticker, Date, least(greatest(Close, a), b) AS Close", "bars, (SELECT quantile_cont(Close, 0.01) AS a, quantile_cont(Close, 0.99) AS b FROM bars)"), "Close")
def ag10_clip_percentiles(spark, sf_dir):
    return E.clip_percentiles(bars(spark, sf_dir), ["Close"]).select(*KEY, "Close")


@query(f"WITH {BARS} SELECT 'Close' AS \"column\", count(*) FILTER (Close IS NULL) AS nulls, 0::BIGINT AS infinite, count(*) FILTER (abs(Close) > 1e12) AS huge, count(*) FILTER (Close < 20 OR Close > 1500) AS outside FROM bars UNION ALL SELECT 'Volume', count(*) FILTER (Volume IS NULL), 0, 0, count(*) FILTER (Volume < 1 OR Volume > 60) FROM bars")
def ag11_validate_ranges(spark, sf_dir):
    return E.validate_ranges(bars(spark, sf_dir), {"Close": (20, 1500), "Volume": (1, 60)})


_RULED = {"RSI_14": (0, 100), "MACD": (-5000, 5000), "MACD_signal": (-5000, 5000), "ATR_14": (0, 5000), "BB_Width": (0, 10), "Range_pct": (0, 2), "EMA_20_rel": (-5, 5), "High_Low_ratio": (1, 5)}


@query(f"{_BASE}, ru AS (SELECT RSI_14, MACD, MACD_signal, ATR_14, (BB_Upper - BB_Lower) / BB_Mid AS BB_Width, (High - Low) / Close AS Range_pct, EMA_20 / Close - 1 AS EMA_20_rel, High / Low AS High_Low_ratio, Close FROM s_s) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, 0::BIGINT AS infinite, count(*) FILTER (abs({c}) > 1e12) AS huge, count(*) FILTER ({c} < {a} OR {c} > {b}) AS outside FROM ru" for c, (a, b) in _RULED.items()))
def ag11_validate_by_name(spark, sf_dir):
    """Ranges that column names tell; Close has none and is left out."""
    s = suite(spark, sf_dir)
    table = s.select("RSI_14", "MACD", "MACD_signal", "ATR_14", "BB_Width", ((C("High") - C("Low")) / C("Close")).alias("Range_pct"), (C("EMA_20") / C("Close") - 1).alias("EMA_20_rel"), (C("High") / C("Low")).alias("High_Low_ratio"), "Close")
    return E.validate_by_name(table)


@query(over("Ticker, Date, (Close - a) / (b - a) AS Close_scaled", "bars, (SELECT min(Close) AS a, max(Close) AS b FROM bars)"), "Close_scaled")
def ag12_minmax(spark, sf_dir):
    b = bars(spark, sf_dir)
    return E.apply_minmax(b, E.fit_minmax(b, ["Close"])).select(*KEY, "Close_scaled")


@query(over("Ticker, Date, (Close - a) / b AS Close_std", "bars, (SELECT avg(Close) AS a, stddev_pop(Close) AS b FROM bars)"), "Close_std")
def ag13_standardize(spark, sf_dir):
    return E.standardize(bars(spark, sf_dir), ["Close"]).select(*KEY, "Close_std")


@query(over("Ticker, Date, SMA_20, Close", f"(SELECT *, {full('avg', 'Close', 20)} AS SMA_20 FROM bars) WHERE SMA_20 IS NOT NULL"), "SMA_20")
def ag14_drop_incomplete(spark, sf_dir):
    return E.drop_incomplete(W.sma(bars(spark, sf_dir)), ["SMA_20", "Close"])


@query(over("Ticker, Date, CAST('0x' || substring(md5(Ticker), 1, 4) AS INT) < 13107 AS is_test"))
def m1_j8_split_by_ticker(spark, sf_dir):
    return E.split_by_ticker(bars(spark, sf_dir).select(*KEY))


_VOTES = f"""{_SCORED}, vo AS (SELECT sc.Ticker, sc.Date, prob AS a, 1 / (1 + exp(-10 * m)) AS b, 1 / (1 + exp(-Volume / 50)) AS c FROM sc JOIN (SELECT Ticker, Date, Volume, coalesce(Close / lag(Close, 5) OVER ({P}) - 1, 0) AS m FROM bars) USING (Ticker, Date))"""


@query(over("Ticker, Date, (a * 0.4 + b * 0.3 + c * 0.3) / 1.0 AS prob", "vo", _VOTES), "prob")
def m4_ensemble(spark, sf_dir):
    """Weights over three scores that know nothing of what comes: a digest, the last five bars' return, the volume."""
    b = bars(spark, sf_dir)
    own = b.select(*KEY, (1 / (1 + F.exp(-10 * F.coalesce(C("Close") / F.lag("Close", 5).over(W.by_date()) - 1, F.lit(0.0))))).alias("b"), (1 / (1 + F.exp(-C("Volume") / 50))).alias("c"))
    s = _scored(spark, sf_dir).select(*KEY, C("prob").alias("a")).join(own, KEY)
    return E.ensemble(s, {"a": 0.4, "b": 0.3, "c": 0.3}).select(*KEY, "prob")


@query(over("Ticker, Date, future_return, prob", "sc WHERE prob >= 0.7 ORDER BY prob DESC, Ticker, Date LIMIT 100", _SCORED), "future_return")
def t1_m5_top_trades(spark, sf_dir):
    return E.top_n(_scored(spark, sf_dir).filter("prob >= 0.7"), 100).select(*KEY, "future_return", "prob")


@query(over("Ticker, Date, prob", "sc WHERE prob >= (SELECT quantile_cont(prob, 0.9) FROM sc)", _SCORED))
def t6_top_share(spark, sf_dir):
    return E.top_share(_scored(spark, sf_dir)).select(*KEY, "prob")


@query(over("Ticker, Date, prob", "sc WHERE target = 1 AND prob < 0.5", _SCORED))
def m6_false_negatives(spark, sf_dir):
    return E.false_negatives(_scored(spark, sf_dir)).select(*KEY, "prob")
