"""Labels, which use future bars on purpose. Outcomes come from one window over the ticker's bars, never from a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import by_date, divide, lead

C = F.col


def future_return(df: DataFrame, h: int = 10, calendar: bool = False) -> DataFrame:
    """Return to the bar ``h`` rows on, or with ``calendar`` to the first bar at least ``h`` days on."""
    if not calendar:
        return df.withColumn("future_return", divide(lead("Close", h), C("Close")) - 1)
    found = first_at_or_after(df, F.date_add("Date", h), "Close", "__ql_ahead")
    return found.withColumn("future_return", divide(C("__ql_ahead"), C("Close")) - 1).drop("__ql_ahead")


def first_at_or_after(df: DataFrame, when: Column, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the ``column`` of the ticker's first bar on or after the day ``when`` of each bar; null if there is none.

    An as-of join in one pass: each bar is there as itself and as a marker on its day ``when``. Read from the last day back, bars before markers, the
    last bar read is the one that a marker asks for. So the work is linear in a ticker's bars however far ``when`` is.
    """
    bars = df.select("Ticker", C("Date").alias("__ql_at"), F.lit(False).alias("__ql_asks"), F.struct(C(column).alias("v")).alias("__ql_v"))
    asks = df.select("Ticker", when.alias("__ql_at"), F.lit(True).alias("__ql_asks"), F.struct(*(C(c) for c in df.columns)).alias("__ql_row"))
    back = Window.partitionBy("Ticker").orderBy(F.desc("__ql_at"), "__ql_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = bars.unionByName(asks, allowMissingColumns=True).withColumn("__ql_next", F.last("__ql_v", ignorenulls=True).over(back))
    return both.filter("__ql_asks").select("__ql_row.*", C("__ql_next.v").alias(name))


def future_extremes(df: DataFrame, h: int = 10) -> DataFrame:
    """Highest high and lowest low of the next ``h`` bars, fewer at the end; null only on the last bar."""
    ahead = by_date().rowsBetween(1, h)
    df = df.withColumns({"future_max_high": F.max("High").over(ahead), "future_min_low": F.min("Low").over(ahead)})
    return df.withColumns({"future_max_pct": divide(C("future_max_high"), C("Close")) - 1, "future_min_pct": divide(C("future_min_low"), C("Close")) - 1})


def _first_day(hit, h: int) -> Column:
    """The first of the next ``h`` days on which ``hit(day)`` holds."""
    return F.least(*(F.when(hit(k), k) for k in range(1, h + 1))) if h > 1 else F.when(hit(1), 1)


def _hits(df: DataFrame, h: int, tp_pct: float, sl_pct: float) -> DataFrame:
    df = df.withColumns({"tp_level": C("Close") * (1 + tp_pct), "sl_level": C("Close") * (1 - sl_pct)})
    return df.withColumns({"tp_day": _first_day(lambda k: lead("High", k) >= C("tp_level"), h), "sl_day": _first_day(lambda k: lead("Low", k) <= C("sl_level"), h)})


def bracket_label(df: DataFrame, h: int = 10, tp_pct: float = 0.05, sl_pct: float = 0.03) -> DataFrame:
    """1 where take-profit comes first, -1 where stop-loss does, 0 for neither or both on one day, null on the last bar; and the day."""
    df = _hits(df, h, tp_pct, sl_pct)
    tp, sl = F.coalesce("tp_day", F.lit(h + 1)), F.coalesce("sl_day", F.lit(h + 1))
    label = F.when(lead("Close").isNull(), None).when(tp < sl, 1).when(sl < tp, -1).otherwise(0)
    return df.withColumns({"bracket_label": label, "hit_day": F.least("tp_day", "sl_day")})


def bracket_outcome(df: DataFrame, h: int = 10, tp_pct: float = 0.05, sl_pct: float = 0.03) -> DataFrame:
    """TP_HIT, SL_HIT, BOTH or NONE, with the profit or loss of a share: for BOTH that of the stop, for NONE 0; in percent null for these two."""
    df = _hits(df, h, tp_pct, sl_pct)
    tp, sl = F.coalesce("tp_day", F.lit(h + 1)), F.coalesce("sl_day", F.lit(h + 1))
    outcome = F.when(tp < sl, "TP_HIT").when(sl < tp, "SL_HIT").when(C("tp_day").isNotNull(), "BOTH").otherwise("NONE")
    df = df.withColumn("future_bracket_outcome", outcome)
    won, lost = C("tp_level") - C("Close"), C("sl_level") - C("Close")
    out = C("future_bracket_outcome")
    return df.withColumns({
        "PL": F.when(out == "TP_HIT", won).when(out.isin("SL_HIT", "BOTH"), lost).otherwise(F.lit(0.0)),
        "PL_percent": F.when(out == "TP_HIT", 100 * divide(won, C("Close"))).when(out == "SL_HIT", 100 * divide(lost, C("Close"))),
    })


def bracket_trade(df: DataFrame, target: Column, stop: Column, n: int = 20, same_bar: str = "target") -> DataFrame:
    """Trade from each bar's close to ``target`` or ``stop``, whichever a bar of the next ``n`` reaches first; where one bar
    reaches both, ``same_bar`` decides. Else the exit is the last close in the window."""
    ahead = by_date().rowsBetween(1, n)
    df = df.withColumns({"target": target, "stop": stop, "ahead": F.collect_list(F.struct("Date", "High", "Low", "Close")).over(ahead)})
    hit = F.get(F.filter("ahead", lambda b: (b["High"] >= C("target")) | (b["Low"] <= C("stop"))), 0)
    df = df.withColumn("hit", hit)
    at_target, at_stop = C("hit.High") >= C("target"), C("hit.Low") <= C("stop")
    first, second = (("Target", at_target, C("target")), ("Stop", at_stop, C("stop")))[:: 1 if same_bar == "target" else -1]
    last = F.try_element_at("ahead", F.lit(-1))
    outcome = F.when(first[1], first[0]).when(second[1], second[0]).when(last.isNotNull(), "Time")
    df = df.withColumns({"outcome": outcome, "exit": F.when(first[1], first[2]).when(second[1], second[2]).otherwise(last["Close"]), "exit_date": F.coalesce("hit.Date", last["Date"])})
    return df.withColumn("trade_return", divide(C("exit"), C("Close")) - 1).drop("ahead", "hit")


def next_close(df: DataFrame) -> DataFrame:
    """Next day's return and whether it is a gain, on the whole timeline: filter afterwards."""
    return df.withColumn("next_return", divide(lead("Close"), C("Close")) - 1).withColumn("success", C("next_return") > 0)
