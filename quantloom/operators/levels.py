"""Fibonacci levels, zigzag points, zones and nearest levels. These are snapshots: they look over the whole series."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import by_date, divide, guarded, true_range
from quantloom.operators.windows import swings

C = F.col
#: Retracement levels; labels are cut to whole percents.
LEVELS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


def label_of(level: float) -> str:
    return f"{int(level * 100)}%"


def _levels(high, low):
    return F.array(*(F.struct(F.lit(label_of(x)).alias("label"), (high - (high - low) * x).alias("price")) for x in LEVELS))


def fib_snapshot(df: DataFrame, lookback: int = 100) -> DataFrame:
    """One row per ticker of at least ``lookback`` bars: swing high and low, levels (0 % is the high), the level nearest to the
    last close (the first one on ties), the offset from it in percent and the close's status against it."""
    rows = df.withColumns({"nth": F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("Date")))})
    found = rows.groupBy("Ticker").agg(
        F.max(F.when(C("nth") <= lookback, C("High"))).alias("swing_high"), F.min(F.when(C("nth") <= lookback, C("Low"))).alias("swing_low"),
        F.max_by("Close", "Date").alias("last_close"), F.max(F.when(C("nth") > 1, C("Close"))).alias("highest_before"), F.count("*").alias("n"),
    ).filter(C("n") >= lookback)
    found = found.withColumn("levels", _levels(C("swing_high"), C("swing_low")))
    nearest = F.array_min(F.transform("levels", lambda x, i: F.struct(F.abs(C("last_close") - x["price"]).alias("far"), i.alias("i"), x.alias("level"))))
    found = found.withColumn("nearest", nearest["level"])
    price = C("nearest.price")
    status = F.when(C("last_close") < price, "approaching").when(C("last_close") > price, F.when(C("highest_before") > price, "crossed then approaching").otherwise("crossed")).otherwise("at level")
    return found.select("Ticker", "swing_high", "swing_low", "last_close", "levels", C("nearest.label").alias("nearest_level"), price.alias("nearest_price"), (100 * divide(C("last_close") - price, price)).alias("percent_offset"), status.alias("status"))


def fib_position(snapshot: DataFrame) -> DataFrame:
    """Where the last close stands between the 0 % and the 100 % level, in percent."""
    return snapshot.withColumn("fib_percent", divide(100 * (C("swing_high") - C("last_close")), C("swing_high") - C("swing_low")))


def fib_position_by_bar(df: DataFrame, lookback: int = 100) -> DataFrame:
    """``fib_percent`` of every bar: where its close stands between the swing high (0) and low (100) of its last ``lookback`` bars."""
    high, low = guarded(F.max, C("High"), lookback), guarded(F.min, C("Low"), lookback)
    return df.withColumns({"swing_high": high, "swing_low": low}).withColumn("fib_percent", divide(100 * (C("swing_high") - C("Close")), C("swing_high") - C("swing_low"))).drop("swing_high", "swing_low")


def fib_from_swings(df: DataFrame, depth: int = 5) -> DataFrame:
    """Levels between the last confirmed swing high and the last swing low before it, else after it."""
    marked = swings(df, depth, depth, "High", "Low")
    tops = marked.filter("swing_high").groupBy("Ticker").agg(F.max_by(F.struct("Date", "High"), "Date").alias("top"))
    lows = marked.filter("swing_low").select("Ticker", C("Date").alias("low_date"), "Low")
    near = lows.join(tops, "Ticker").groupBy("Ticker", "top").agg(
        F.max_by("Low", F.when(C("low_date") < C("top.Date"), C("low_date"))).alias("before"), F.max_by("Low", "low_date").alias("any")
    )
    low = F.coalesce("before", "any")
    return near.select("Ticker", C("top.High").alias("swing_high"), low.alias("swing_low")).withColumn("levels", _levels(C("swing_high"), C("swing_low")))


def _base(x: np.ndarray) -> np.ndarray:
    """For each value the least one since the last larger value, by a stack of falling values that hold the least one below them."""
    out, above, low = np.empty(len(x)), [], []
    for k, v in enumerate(x.tolist()):
        least = v
        while above and above[-1] <= v:
            above.pop()
            least = min(least, low.pop())
        above.append(v)
        low.append(least)
        out[k] = least
    return out


def _peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (of plateaus the middle), those too close to a higher one left out, of at least ``prominence``."""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(x)]])
    value = x[starts] if len(x) else x
    inner = np.flatnonzero((value[:-2] < value[1:-1]) & (value[1:-1] > value[2:])) + 1
    at = (starts[inner] + ends[inner] - 1) // 2
    keep = np.ones(len(at), dtype=bool)
    for k in np.argsort(x[at], kind="stable")[::-1] if distance > 1 else ():
        if keep[k]:
            for step in (-1, 1):
                j = k + step
                while 0 <= j < len(at) and abs(at[j] - at[k]) < distance:
                    keep[j] = False
                    j += step
    at = at[keep]
    if not len(at):
        return at
    return at[x[at] - np.maximum(_base(x)[at], _base(x[::-1])[::-1][at]) >= prominence]


def _clusters(values: np.ndarray, tolerance: float, relative: bool) -> list[np.ndarray]:
    """Sorted values in groups: each next one joins while it is within tolerance of the group's mean, kept as a running sum."""
    ordered, cuts, total, n = np.sort(values), [], 0.0, 0
    for k, v in enumerate(ordered.tolist()):
        mean = total / n if n else 0.0
        if n and abs(v - mean) <= (tolerance * mean if relative else tolerance):
            total, n = total + v, n + 1
        else:
            total, n = v, 1
            cuts.append(k)
    return np.split(ordered, cuts[1:]) if cuts else []


def zigzag(df: DataFrame, distance: int = 5, prominence: float = 1.0) -> DataFrame:
    """``Ticker, Date, price, kind`` of the peaks and troughs of the close."""

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("Date", kind="stable")
        x = bars["Close"].to_numpy(dtype=float)
        found = [(i, k) for k, y in (("peak", x), ("trough", -x)) for i in _peaks(y, distance, prominence)]
        at = [i for i, _ in found]
        return pd.DataFrame({"Ticker": bars["Ticker"].iloc[at].to_numpy(), "Date": bars["Date"].iloc[at].to_numpy(), "price": x[at], "kind": [k for _, k in found]})

    return df.select("Ticker", "Date", "Close").groupBy("Ticker").applyInPandas(run, "Ticker string, Date date, price double, kind string")


def zones(points: DataFrame, tolerance: float = 0.01, min_points: int = 2, min_width: float = 0.001, max_width: float = 0.03, max_zones: int = 5) -> DataFrame:
    """``Ticker, zone_rank, low, high, strength``: groups of zigzag prices, the strongest first (of equal ones the lower)."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        found = [(c.min(), c.max(), len(c)) for c in _clusters(own["price"].to_numpy(), tolerance, True) if len(c) >= min_points]
        found = [z for z in found if min_width < (z[1] - z[0]) / z[0] < max_width]
        best = sorted(found, key=lambda z: -z[2])[:max_zones]
        return pd.DataFrame([(own["Ticker"].iloc[0], k + 1, *z) for k, z in enumerate(best)], columns=["Ticker", "zone_rank", "low", "high", "strength"])

    return points.groupBy("Ticker").applyInPandas(run, "Ticker string, zone_rank int, low double, high double, strength double")


def leg_midpoints(points: DataFrame) -> DataFrame:
    """Between neighbouring zigzag points: middle of the dates and of the prices, and the move."""
    w = Window.partitionBy("Ticker").orderBy("Date", "kind")
    legs = points.withColumns({"start_date": F.lag("Date").over(w), "start_price": F.lag("price").over(w)}).filter("start_date IS NOT NULL")
    middle = F.date_add("start_date", F.floor(F.datediff("Date", "start_date") / 2).cast("int"))
    return legs.select("Ticker", "start_date", C("Date").alias("end_date"), "start_price", C("price").alias("end_price"), middle.alias("mid_date"), ((C("start_price") + C("price")) / 2).alias("mid_price"))


def fib_legs(points: DataFrame, min_move: float = 0.01) -> DataFrame:
    """``Ticker, start_date, end_date, label, price``: levels of every leg that moves by at least ``min_move``."""
    legs = leg_midpoints(points).filter(F.abs(divide(C("end_price") - C("start_price"), C("start_price"))) >= min_move)
    return legs.select("Ticker", "start_date", "end_date", F.explode(_levels(C("end_price"), C("start_price"))).alias("l")).select("Ticker", "start_date", "end_date", "l.label", "l.price")


def atr_zones(df: DataFrame, n: int = 14, min_touches: int = 2, recent: float = 0.7, top: int = 5) -> DataFrame:
    """Zones of highs and lows within half an ATR, by the recency-weighted number of closes inside (weights from ``recent`` to 1)."""
    ranged = df.withColumn("tr", true_range()).withColumn("nth", F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("Date"))))

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("Date", kind="stable")
        high, low = bars["High"].to_numpy(dtype=float), bars["Low"].to_numpy(dtype=float)
        levels = np.concatenate([high[_peaks(high, 1, 0.0)], low[_peaks(-low, 1, 0.0)]])
        tr = bars["tr"].to_numpy(dtype=float)
        found = _clusters(levels, sum(tr[-n:].tolist()) / n / 2, False) if len(tr) >= n and len(levels) else []
        rows = [(bars["Ticker"].iloc[0], c.min(), c.max(), len(c)) for c in found if len(c) >= min_touches]
        return pd.DataFrame(rows, columns=["Ticker", "low", "high", "touches"])

    levels = ranged.select("Ticker", "Date", "High", "Low", "tr").groupBy("Ticker").applyInPandas(run, "Ticker string, low double, high double, touches int")
    sized = df.select("Ticker", "Date", "Close").withColumns({"rn": F.row_number().over(by_date()), "n": F.count("*").over(Window.partitionBy("Ticker"))})
    inside = closes_in_zones(sized, levels)
    # zones tie often, so what rounding leaves must not hang on the order of a shuffle: 1 - recent as a decimal, and a sum from the first day on
    rise = Decimal(1) - Decimal(str(recent))
    weight = F.when(C("n") > 1, recent + (F.lit(rise) * (C("rn") - 1)).cast("double") / (C("n") - 1)).otherwise(F.lit(recent))
    in_order = F.array_sort(F.collect_list(F.struct("rn", weight.alias("w"))))
    scored = inside.groupBy("Ticker", "low", "high", "touches").agg(in_order.alias("days"))
    scored = scored.withColumn("strength", F.aggregate("days", F.lit(0.0), lambda total, x: total + x["w"])).drop("days")
    ranked = scored.withColumn("zone_rank", F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("strength"), "low")))
    return ranked.filter(C("zone_rank") <= top)


def closes_in_zones(df: DataFrame, found: DataFrame) -> DataFrame:
    """Bars whose close lies inside a zone of their ticker, a row per zone; zones are tens per ticker."""
    return df.join(found, "Ticker").filter(C("Close").between(C("low"), C("high")))


def nearest_levels(df: DataFrame, lookback: int = 250, left: int = 5, right: int = 5, n_levels: int = 5) -> DataFrame:
    """``Ticker, Close, support, resistance, support_distance, resistance_distance`` of each ticker's last bar.

    Pivots are highs and lows of the close; of the last ``lookback`` pivots the ``n_levels`` newest distinct highs are
    resistances and as many lows supports. A support is the nearest one not above the close, else the highest; a resistance
    the nearest one not below, else the lowest. Distances are shares of the close, clipped to half of it; no level is as far.
    """
    pivots = swings(df, left, right).filter("swing_high OR swing_low").withColumn("nth", F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("Date")))).filter(C("nth") <= lookback)
    levels = pivots.groupBy("Ticker", C("swing_high").alias("above"), F.when(C("swing_high"), C("High")).otherwise(C("Low")).alias("level")).agg(F.max("Date").alias("Date"))
    recent = levels.withColumn("nth", F.row_number().over(Window.partitionBy("Ticker", "above").orderBy(F.desc("Date")))).filter(C("nth") <= n_levels)
    last = df.groupBy("Ticker").agg(F.max_by("Close", "Date").alias("Close"))
    supports, resistances = F.when(~C("above"), C("level")), F.when(C("above"), C("level"))
    both = last.join(recent.select("Ticker", "above", "level"), "Ticker", "left").groupBy("Ticker", "Close").agg(
        F.coalesce(F.max(F.when(supports <= C("Close"), supports)), F.max(supports)).alias("support"), F.coalesce(F.min(F.when(resistances >= C("Close"), resistances)), F.min(resistances)).alias("resistance")
    )
    far = lambda x: F.greatest(F.least(F.coalesce(divide(x, C("Close")), F.lit(1.0)), F.lit(0.5)), F.lit(-0.5))
    return both.withColumns({"support_distance": far(C("Close") - C("support")), "resistance_distance": far(C("resistance") - C("Close"))})
