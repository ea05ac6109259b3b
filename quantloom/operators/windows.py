"""Indicators and row features that plain windows express. Null until a window is full, never NaN; always by ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import by_date, divide, guarded, is_true, lag, mean, rolling, true_range

C = F.col


def sma(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn(f"SMA_{n}", mean(C("Close"), n))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """RSI of simple means of gains and losses; no loss but gains gives 100, neither gives null."""
    df = df.withColumn("move", C("Close") - lag("Close"))
    gain, loss = mean(F.greatest(C("move"), C("move") * 0), n), mean(F.greatest(-C("move"), C("move") * 0), n)
    df = df.withColumns({"gain": gain, "loss": loss})
    value = F.when((C("loss") == 0) & (C("gain") > 0), F.lit(100.0)).when(C("loss") > 0, 100 - 100 / (1 + C("gain") / C("loss")))
    return df.withColumn(f"RSI_{n}", value).drop("move", "gain", "loss")


def atr(df: DataFrame, n: int = 14, min_periods: int | None = None) -> DataFrame:
    return df.withColumn("tr", true_range()).withColumn(f"ATR_{n}", mean(C("tr"), n, min_periods)).drop("tr")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, ddof: int = 1) -> DataFrame:
    spread = guarded(F.stddev_samp if ddof else F.stddev_pop, C("Close"), n)
    df = df.withColumns({"BB_Mid": mean(C("Close"), n), "spread": spread})
    df = df.withColumns({"BB_Upper": C("BB_Mid") + k * C("spread"), "BB_Lower": C("BB_Mid") - k * C("spread")})
    return df.withColumn("BB_Width", divide(C("BB_Upper") - C("BB_Lower"), C("BB_Mid"))).drop("spread")


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    low, high = guarded(F.min, C("Low"), k), guarded(F.max, C("High"), k)
    return df.withColumn("%K", divide(100 * (C("Close") - low), high - low)).withColumn("%D", mean(C("%K"), d))


def vwap(df: DataFrame) -> DataFrame:
    """VWAP anchored at each ticker's first bar, with its running sums."""
    so_far = by_date().rowsBetween(Window.unboundedPreceding, 0)
    typical = (C("High") + C("Low") + C("Close")) / 3
    df = df.withColumns({"Cum_TPV": F.sum(typical * C("Volume")).over(so_far), "Cum_Vol": F.sum("Volume").over(so_far)})
    return df.withColumn("VWAP", divide(C("Cum_TPV"), C("Cum_Vol")))


def obv(df: DataFrame) -> DataFrame:
    df = df.withColumn("signed", F.signum(C("Close") - lag("Close")) * C("Volume"))
    return df.withColumn("OBV", F.sum("signed").over(by_date().rowsBetween(Window.unboundedPreceding, 0))).drop("signed")


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumns({"Donchian_Upper": guarded(F.max, C("High"), n), "Donchian_Lower": guarded(F.min, C("Low"), n)})
    return df.withColumn("Donchian_Mid", (C("Donchian_Upper") + C("Donchian_Lower")) / 2)


def _around(agg, column: str, left: int, right: int) -> Column:
    w = by_date().rowsBetween(-left, right)
    return F.when(F.count(column).over(w) >= left + right + 1, agg(column).over(w))


def centered_levels(df: DataFrame, n: int = 20) -> DataFrame:
    """Support and resistance in a centred window; looks ahead, so it is no feature. An even window reaches one bar less ahead."""
    left, right = n // 2, n - 1 - n // 2
    return df.withColumns({"Support": _around(F.min, "Low", left, right), "Resistance": _around(F.max, "High", left, right)})


def context_flags(df: DataFrame, tolerance: float = 0.01, n: int = 20) -> DataFrame:
    """Near support, near resistance, and a body of over 1.5 times the mean range."""
    df = centered_levels(df, n)
    near = lambda level: is_true(divide(F.abs(C("Close") - C(level)), C("Close")) < tolerance)
    big = F.abs(C("Close") - C("Open")) > 1.5 * mean(C("High") - C("Low"), n)
    return df.withColumns({"near_support": near("Support"), "near_resistance": near("Resistance"), "big_candle": is_true(big)})


def swings(df: DataFrame, left: int = 2, right: int = 2, high: str = "Close", low: str = "Close") -> DataFrame:
    """Bars that are the highest or lowest of their surroundings; edges are none."""
    flags = {"swing_high": is_true(C(high) == _around(F.max, high, left, right)), "swing_low": is_true(C(low) == _around(F.min, low, left, right))}
    return df.withColumns(flags)


def rolling_zscore(df: DataFrame, columns: list[str], n: int = 20, min_periods: int = 5) -> DataFrame:
    return df.withColumns({f"{c}_z": divide(C(c) - mean(C(c), n, min_periods), guarded(F.stddev_samp, C(c), n, min_periods)) for c in columns})


def returns(df: DataFrame) -> DataFrame:
    """Log return, relative change and, where there is one, the slope of VWAP; the first bar has 0."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    found = {"log_return": zero(F.log(divide(C("Close"), lag("Close")))), "pct_change": zero(divide(C("Close"), lag("Close")) - 1)}
    if "VWAP" in df.columns:
        found["VWAP_slope"] = zero(C("VWAP") - lag("VWAP"))
    return df.withColumns(found)


def rolling_pct_rank(df: DataFrame, column: str = "Volume", n: int = 20) -> DataFrame:
    """Share of the last ``n`` values that are smaller, ties at their mean rank; 0 until the window is full."""
    df = df.withColumn("held", F.collect_list(column).over(rolling(n)))
    rank = F.expr(f"(size(filter(held, x -> x < `{column}`)) + (size(filter(held, x -> x = `{column}`)) + 1) / 2) / {n}")
    return df.withColumn(f"{column}_rank", F.when((F.size("held") == n) & C(column).isNotNull(), rank).otherwise(F.lit(0.0))).drop("held")


def smooth(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    return df.withColumns({c: F.avg(c).over(rolling(n)) for c in columns})


def lags(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": lag(c, k) for c in columns for k in ks})


def fill_limit(df: DataFrame, columns: list[str], back: bool = True) -> DataFrame:
    """Fill one missing value from the bar before, then, with ``back``, from the bar after."""
    df = df.withColumns({c: F.coalesce(C(c), lag(c)) for c in columns})
    return df.withColumns({c: F.coalesce(C(c), F.lead(c).over(by_date())) for c in columns}) if back else df


def trim(df: DataFrame, critical: list[str], target: str | None = None) -> DataFrame:
    """Bars from the first one on that has all ``critical`` values, up to the last one with a ``target``; tickers without such a bar go."""
    w = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ready = F.lit(True)
    for c in critical:
        ready = ready & C(c).isNotNull()
    df = df.withColumn("rn", F.row_number().over(by_date()))
    df = df.withColumns({"first_ok": F.min(F.when(ready, C("rn"))).over(w), "last_ok": F.max(F.when(C(target).isNotNull() if target else F.lit(True), C("rn"))).over(w)})
    return df.filter("rn >= first_ok AND rn <= last_ok").drop("rn", "first_ok", "last_ok")


def realized_vol(df: DataFrame, n: int = 30) -> DataFrame:
    df = df.withColumn("r", F.log(divide(C("Close"), lag("Close"))))
    return df.withColumn("realized_vol", guarded(F.stddev_samp, C("r"), n) * (252**0.5)).drop("r")


def volume_ratio(df: DataFrame, n: int = 20, burst: float = 4.0) -> DataFrame:
    """Volume against its mean and rolling median, and bursts above ``burst`` times the mean."""
    df = df.withColumns({"volume_mean": mean(C("Volume"), n), "volume_median": F.percentile("Volume", F.lit(0.5)).over(rolling(n))})
    return df.withColumns({"volume_ratio": divide(C("Volume"), C("volume_mean")), "volume_burst": is_true(C("Volume") > burst * C("volume_mean"))})


def momentum(df: DataFrame, n: int = 5) -> DataFrame:
    """Rate of change, and ATR and band width in percent of the close."""
    out = atr(bollinger(df))
    return out.withColumns({
        f"ROC_{n}": 100 * (divide(C("Close"), lag("Close", n)) - 1),
        "ATR_pct": 100 * divide(C("ATR_14"), C("Close")),
        "BB_Width_pct": 100 * divide(C("BB_Upper") - C("BB_Lower"), C("Close")),
    })


def candle_patterns(df: DataFrame) -> DataFrame:
    """Candlestick patterns of one to three bars; where a bar before is missing a pattern is false."""
    o, h, l, c = (C(x) for x in ("Open", "High", "Low", "Close"))
    o1, h1, l1, c1, o2, c2 = lag("Open"), lag("High"), lag("Low"), lag("Close"), lag("Open", 2), lag("Close", 2)
    body, size = F.abs(c - o), h - l
    small_before, middle = F.abs(c1 - o1) <= 0.3 * (h1 - l1), (o2 + c2) / 2
    in_range = lambda x: (x - l) / (1e-6 + h - l)
    found = {
        "bullish_engulfing": (c1 < o1) & (c > o) & (c > o1) & (o < c1),
        "bearish_engulfing": (c1 > o1) & (c < o) & (c < o1) & (o > c1),
        "hammer": (size > 3 * body) & (in_range(c) > 0.6) & (in_range(o) > 0.6),
        "doji": body <= 0.1 * size,
        "inside_bar": (h < h1) & (l > l1),
        "outside_bar": (h > h1) & (l < l1),
        "morning_star": (c2 < o2) & small_before & (c > middle),
        "evening_star": (c2 > o2) & small_before & (c < middle),
        "pin_bar": (h - F.greatest(o, c) > 2 * body) | (F.least(o, c) - l > 2 * body),
    }
    return df.withColumns({k: is_true(v) for k, v in found.items()})


def candle_patterns_alt(df: DataFrame) -> DataFrame:
    """Patterns as prices: the close where the pattern is, else null; the first bar has none."""
    o, h, l, c = (C(x) for x in ("Open", "High", "Low", "Close"))
    o1, c1 = lag("Open"), lag("Close")
    body, size = F.abs(o - c), h - l
    found = {
        "Bullish_Engulfing": (c1 < o1) & (c > o) & (o < c1) & (c > o1),
        "Bearish_Engulfing": (c1 > o1) & (c < o) & (o > c1) & (c < o1),
        "Doji": body <= size * 0.1,
        "Hammer": (c > o) & (o - l > 2 * body) & (h - c < 0.3 * size),
        "Shooting_Star": (c < o) & (h - o > 2 * body) & (c - l < 0.3 * size),
    }
    return df.withColumns({k: F.when(c1.isNotNull() & v, c) for k, v in found.items()})


def pivot_points(df: DataFrame) -> DataFrame:
    p = (C("High") + C("Low") + C("Close")) / 3
    return df.withColumn("pivot", p).withColumns({"R1": 2 * C("pivot") - C("Low"), "S1": 2 * C("pivot") - C("High")})
