"""Screens over the last bar of each ticker, and row-wise trade signals. Thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.expr import divide, is_true, lag, mean, rolling, sigmoid
from quantloom.operators.bars import latest

C = F.col


def with_screen_columns(df: DataFrame, n: int = 20) -> DataFrame:
    """Mean volume and mean ATR, which the screens compare with."""
    return df.withColumns({"volume_mean": mean(C("Volume"), n), "atr_mean": mean(C("ATR_14"), n)})


def annotate(df: DataFrame) -> DataFrame:
    """Labels of the unfiltered scan."""
    return df.withColumns({
        "ema_label": F.when(C("EMA_20") > C("EMA_50"), "Bullish").otherwise("Bearish"),
        "rsi_label": F.when(C("RSI_14") > 70, "Overbought").when(C("RSI_14") < 30, "Oversold").otherwise("Neutral"),
        "vwap_label": F.when(C("Close") > C("VWAP"), "Reclaimed").otherwise("Below"),
        "volume_label": F.when(C("Volume") > C("volume_mean"), "High").otherwise("Low"),
    })


def _fib_between(low: float, high: float) -> Column:
    return C("fib_percent").between(low, high)


def screen_fib_band(last: DataFrame, low: float = 50, high: float = 65) -> DataFrame:
    return annotate(last.filter(_fib_between(low, high)))


def screen_trend_volume(last: DataFrame) -> DataFrame:
    return last.filter((C("EMA_20") > C("EMA_50")) & (C("RSI_14") > 40) & (C("RSI_14") < 60) & (C("Close") > C("VWAP")) & (C("Volume") > C("volume_mean")))


def screen_bullish(last: DataFrame) -> DataFrame:
    rising = (C("EMA_20") > C("EMA_50")) & (C("MACD") > C("MACD_signal")) & (C("Close") > C("VWAP"))
    return last.filter(rising & (C("RSI_14") > 45) & (C("RSI_14") < 60) & (C("Volume") > C("volume_mean")) & _fib_between(45, 61))


def screen_bearish(last: DataFrame) -> DataFrame:
    falling = (C("EMA_20") < C("EMA_50")) & (C("MACD") < C("MACD_signal")) & (C("Close") < C("VWAP"))
    return last.filter(falling & (C("RSI_14") > 40) & (C("RSI_14") < 55) & (C("Volume") > C("volume_mean")) & _fib_between(38, 50))


def screen_neutral_breakout(last: DataFrame, tolerance: float = 0.01, volume_multiple: float = 1.5) -> DataFrame:
    """At or near a Bollinger band on raised volume, with the direction."""
    soft = (C("Close") >= C("BB_Upper") * (1 - tolerance)) | (C("Close") <= C("BB_Lower") * (1 + tolerance))
    found = last.filter(soft & (C("Volume") >= C("volume_mean") * volume_multiple))
    return found.withColumn("direction", F.when(C("Close") > C("BB_Upper"), "Bullish").otherwise("Bearish"))


def screen_high_volatility(last: DataFrame, multiple: float = 1.5) -> DataFrame:
    fade = ((C("RSI_14") < 30) & (C("fib_percent") >= 61)) | ((C("RSI_14") > 70) & (C("fib_percent") <= 38))
    return last.filter((C("ATR_14") > C("atr_mean") * multiple) & fade)


def screen_multi_confluence(last: DataFrame) -> DataFrame:
    """Needs ``zone_low``, the low of the weakest zone, null where a ticker has none."""
    rising = (C("EMA_20") > C("EMA_50")) & (C("MACD") > C("MACD_signal")) & C("RSI_14").between(40, 60) & (C("%K") > C("%D"))
    return last.filter(rising & (C("Close") > C("VWAP")) & (C("Volume") > C("volume_mean")) & (C("zone_low").isNull() | (C("Close") >= C("zone_low"))))


def screen_volume_burst(last: DataFrame, multiple: float = 4.0) -> DataFrame:
    return last.filter(C("Volume") >= C("volume_mean") * multiple)


def _index_ok(required: bool) -> Column:
    return is_true(F.lower("NIFTY_Trend").contains("bullish")) if required else F.lit(True)


def signal_c(df: DataFrame, require_index_bullish: bool = False) -> DataFrame:
    """Relaxed mean reversion in an uptrend."""
    spike = (C("ATR_14") > mean(C("ATR_14"), 14) * 1.05) & (C("ATR_14") < mean(C("ATR_14"), 5) * 1.15)
    turn = is_true(C("RSI_14") > lag("RSI_14")) | is_true(C("%K") > C("%D"))
    recovered = C("Close") > F.when(F.count("Low").over(rolling(3)) >= 3, F.min("Low").over(rolling(3))) * 1.03
    every = (C("EMA_20") > C("EMA_50")) & (C("RSI_14") < 45) & (C("%K") < 40) & spike & (C("Volume") < mean(C("Volume"), 20)) & turn & recovered
    return df.withColumn("take_trade", is_true(every & _index_ok(require_index_bullish)))


def signal_c_plus(df: DataFrame, require_index_bullish: bool = False) -> DataFrame:
    """Mean reversion with two of three confirmations."""
    signs = [C("RSI_14") > lag("RSI_14"), C("%K") > C("%D"), C("Close") > lag("Close")]
    confirmed = sum((is_true(s).cast("int") for s in signs[1:]), is_true(signs[0]).cast("int")) >= 2
    every = (
        (C("EMA_20") >= C("EMA_50") * 0.985) & (C("RSI_14") < 45) & (C("%K") < 40) & (C("Close") <= C("BB_Lower") * 1.02) & (C("Volume") < mean(C("Volume"), 20) * 0.9)
        & (C("ATR_14") > mean(C("ATR_14"), 14) * 1.05) & (C("Close") - C("Low") > C("High") - C("Close")) & confirmed
    )
    return df.withColumn("take_trade", is_true(every & _index_ok(require_index_bullish)))


def signal_d(df: DataFrame, atr_multiple: float = 0.5, pullback: float = 0.03, rsi_min: float = 45, rsi_max: float = 65, volume_multiple: float = 0.8, require_index_bullish: bool = False) -> DataFrame:
    """Pullback in a stacked uptrend with momentum and volume."""
    ratio = divide(C("Close"), C("EMA_20"))
    back = is_true(C("Low") <= C("EMA_20") - C("ATR_14") * atr_multiple) | is_true((ratio >= 1 - pullback) & (ratio <= 1.02))
    push = is_true(C("MACD") > C("MACD_signal")) | is_true(C("RSI_14").between(rsi_min, rsi_max) & (is_true(C("RSI_14") > lag("RSI_14")) | is_true(C("%K") > C("%D"))))
    every = (C("EMA_20") > C("EMA_50")) & (C("EMA_50") > C("EMA_200")) & back & push & (C("Volume") > mean(C("Volume"), 20) * volume_multiple) & (C("Close") < C("EMA_20") * 1.04)
    return df.withColumn("take_trade", is_true(every & _index_ok(require_index_bullish)))


def _in(regime: str) -> Column:
    return F.lower("regime") == regime


def _entry_rules(tolerance: float = 0.02) -> dict[str, Column]:
    """When to enter, by the entry's name. ``upper_before`` is the channel's upper end at the bar before."""
    return {
        "pattern": _in("bullish") & (C("bullish_engulfing") | C("hammer") | C("morning_star")),
        "pullback": _in("bullish") & (C("Close") <= C("Donchian_Lower") * (1 + tolerance)) & (C("Close") > C("Open")),
        "neutral": _in("neutral") & (C("Close") > C("Donchian_Mid")) & (C("RSI_14") > 50),
        "non_bearish": ~_in("bearish") & (C("Close") > C("Donchian_Mid")),
        "breakout": ~_in("bearish") & (C("Close") > C("upper_before")),
    }


def entry_regime_pattern(df: DataFrame) -> DataFrame:
    """Bullish regime and a bullish pattern."""
    return df.filter(_entry_rules()["pattern"])


def entry_donchian_pullback(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Bullish regime, close near the lower channel and turning up."""
    return df.filter(_entry_rules(tolerance)["pullback"])


def entry_neutral(df: DataFrame) -> DataFrame:
    return df.filter(_entry_rules()["neutral"])


def entry_non_bearish(df: DataFrame) -> DataFrame:
    return df.filter(_entry_rules()["non_bearish"])


def entry_donchian_breakout(df: DataFrame) -> DataFrame:
    """Close above the channel of the bars before."""
    return df.withColumn("upper_before", lag("Donchian_Upper")).filter(_entry_rules()["breakout"]).drop("upper_before")


def entries(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """A row per bar and ``entry`` that it fulfils, all kinds from one pass."""
    met = F.array_compact(F.array(*(F.when(rule, name) for name, rule in _entry_rules(tolerance).items())))
    return df.withColumn("upper_before", lag("Donchian_Upper")).withColumn("entry", F.explode(met)).drop("upper_before")


#: Weights of the features of ``move_probability``.
WEIGHTS = {"vwappos": 2.0, "rsi_norm": 1.2, "macd_sign": 1.0, "macd_magnitude": 1.0, "atr_norm": -3.0, "vol_spike": 0.8, "dist_support": 2.5, "dist_resistance": -2.5}


def move_probability(last: DataFrame, weights: dict[str, float] | None = None, bias: float = 0.0, cut: float = 0.65) -> DataFrame:
    """``p_up`` by a logistic curve over a weighted sum of eight features of the last bar, and LONG, SHORT or WAIT.

    Needs ``VWAP, RSI_14, MACD, MACD_signal, ATR_14``, ``volume_median`` (of 20 bars) and the distances of ``nearest_levels``. The
    nearer a level, the more it counts. Where a feature is missing so is ``p_up``, and the signal is WAIT.
    """
    w = WEIGHTS | (weights or {})
    price, gap = C("Close"), C("MACD") - C("MACD_signal")
    toward = lambda distance, ahead: (1 - F.abs(distance)) * F.when(ahead, 1).otherwise(-1)
    features = {
        "vwappos": divide(price - C("VWAP"), C("VWAP")), "rsi_norm": (C("RSI_14") - 50) / 50, "macd_sign": F.signum(gap), "macd_magnitude": gap / (F.abs(price) + 1e-9),
        "atr_norm": divide(C("ATR_14"), price), "vol_spike": C("Volume") / (C("volume_median") + 1e-9) - 1,
        "dist_support": toward(C("support_distance"), C("support_distance") >= 0), "dist_resistance": toward(C("resistance_distance"), C("resistance_distance") <= 0),
    }
    score = F.lit(bias)
    for name, x in features.items():
        score = score + w[name] * x
    out = last.withColumn("p_up", sigmoid(score))
    return out.withColumn("signal", F.when(C("p_up") > cut, "LONG").when(1 - C("p_up") > cut, "SHORT").otherwise("WAIT"))


def last_with(df: DataFrame, *others: DataFrame) -> DataFrame:
    """The last bar of each ticker with the columns of snapshots joined by ticker."""
    out = latest(df)
    for other in others:
        out = out.join(other, "Ticker", "left")
    return out

