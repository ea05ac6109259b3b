"""Exponential recurrences in bounded memory: by a stream of sorted bars, or as a parallel prefix scan over blocks of dates.

**Stream.** Bars come to a task sorted by ticker and date, as windows leave them, so what else is computed by ticker shares the exchange and sort. All averages
that a caller asks for are carried from batch to batch; a task holds a batch, whatever a ticker's length.

**Blocks** (``blocks=True``), for few and very long series, window functions only. One step of an average is an affine map of the value before it. Within a block of dates of a ticker the maps compose by running sums: the logarithm
of what is left of the block's first value, and what has come since. A block is then one map itself. The table of blocks, a row per
``BLOCK`` days, is scanned in the same way by ticker, cut where less than ``exp(-REACH)`` of an earlier value is left, for nothing further back counts
in a double. Last, each block takes the value it starts from by a join, and a row's value is one expression.

So the work on rows is dealt by ticker and block, a ticker of any length over as many tasks as it has blocks, unless the rows are dealt by ticker already.
Both give what pandas gives for the whole series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType

from quantloom.functions.expr import by_date, true_range
from quantloom.operators import windows

C = F.col
#: Days of a block, or rows where ``Date`` is a time. What an average leaves of a value after so many rows is above 1e-300 for any ``alpha`` up to 0.93.
BLOCK = 256
#: Logarithm beyond which what is left of an earlier value is nothing.
REACH = 300.0


@dataclass(frozen=True)
class Average:
    """An exponential average of ``column``: weight ``alpha`` of the newest value, null until ``min_periods`` values are there.

    ``seed`` "first" starts from the first value, "sma" from the mean of the first ``min_periods``. ``column`` can be an average
    listed before, and with ``minus`` the average is of the difference of two columns.
    """

    name: str
    column: str
    alpha: float
    min_periods: int = 1
    seed: str = "first"
    adjust: bool = False
    minus: str | None = None


def span(name: str, n: int, column: str = "Close", **more) -> Average:
    return Average(name, column, 2 / (n + 1), **more)


def wilder(name: str, n: int, column: str) -> Average:
    return Average(name, column, 1 / n, min_periods=n)


def block_of(df: DataFrame) -> Column:
    """Number of a bar's block: by days, so that no order is needed; by rows where bars have times."""
    if isinstance(df.schema["Date"].dataType, DateType):
        return F.floor(F.unix_date("Date") / BLOCK).cast("long")
    return F.floor(F.row_number().over(by_date()) / BLOCK).cast("long")


def _seeded(df: DataFrame, x: Column, n: int) -> Column:
    """``x`` with nothing before its ``n``-th value, and there the mean of the first ``n``."""
    so_far = by_date().rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count(x).over(so_far)
    return F.when(x.isNull(), None).when(seen > n, x).when(seen == n, F.sum(x).over(so_far) / n)


def _log_kept(a: Average, gap: Column) -> Column:
    """Logarithm of the share of the last value in the next one, ``gap`` rows on."""
    faded = F.pow(F.lit(1 - a.alpha), gap)
    return gap * math.log(1 - a.alpha) if a.adjust else F.when(gap == 1, math.log(1 - a.alpha)).otherwise(F.log(faded / (faded + a.alpha)))


def _added(a: Average, x: Column, gap: Column) -> Column:
    """What a new value ``x`` adds, ``gap`` rows after the last one."""
    faded = F.pow(F.lit(1 - a.alpha), gap)
    return F.when(gap.isNotNull(), x) if a.adjust else F.when(gap == 1, x * a.alpha).otherwise(x * a.alpha / (faded + a.alpha))


def _scan(df: DataFrame, wanted: list[Average]) -> DataFrame:
    """``df`` with the averages of ``wanted``, none of which needs another one's values."""
    key, block = ["Ticker", "__ql_block"], Window.partitionBy("Ticker", "__ql_block").orderBy("Date")
    run, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__ql_block", block_of(df))

    # inputs: those of equal definition once; for adjusted averages a sum of weights runs beside the weighted sum
    inputs: dict[tuple, int] = {}
    scans: list[tuple[Average, int, str]] = []  # average, input, "value" or "weight"
    columns: dict[str, Column] = {"__ql_pos": F.row_number().over(block)}
    for a in wanted:
        of = (a.column, a.minus, a.min_periods if a.seed == "sma" else 0)
        if of not in inputs:
            inputs[of] = len(inputs)
            x = C(a.column).cast("double") - (0.0 if a.minus is None else C(a.minus).cast("double"))
            x = F.when(~F.isnan(x), x)
            columns[f"__ql_x{inputs[of]}"] = _seeded(df, x, a.min_periods) if a.seed == "sma" else x
        scans += [(a, inputs[of], what) for what in (("value", "weight") if a.adjust else ("value",))]
    df = df.withColumns(columns)
    x = lambda i: C(f"__ql_x{i}")
    value = lambda i, what: x(i) if what == "value" else F.when(x(i).isNotNull(), 1.0)
    df = df.withColumns({f"__ql_gap{i}": F.when(x(i).isNotNull(), C("__ql_pos") - F.max(F.when(x(i).isNotNull(), C("__ql_pos"))).over(before)) for i in inputs.values()} | {f"__ql_n{i}": F.count(x(i)).over(run) for i in inputs.values()})
    gap = lambda i: C(f"__ql_gap{i}")
    df = df.withColumns({f"__ql_p{k}": F.sum(F.coalesce(_log_kept(a, gap(i)), F.lit(0.0))).over(run) for k, (a, i, _) in enumerate(scans)})
    df = df.withColumns({f"__ql_z{k}": F.exp(C(f"__ql_p{k}")) * F.sum(F.coalesce(_added(a, value(i, what), gap(i)) * F.exp(-C(f"__ql_p{k}")), F.lit(0.0))).over(run) for k, (a, i, what) in enumerate(scans)})

    # a block as one map
    held = lambda i: F.when(x(i).isNotNull(), F.struct("__ql_pos", x(i).alias("x")))
    ends = F.max(F.struct("__ql_pos", *(C(f"__ql_{c}{k}") for k in range(len(scans)) for c in "pz"))).alias("end")
    own = df.groupBy(*key).agg(ends, *(F.min(held(i)).alias(f"first{i}") for i in inputs.values()), *(F.max(held(i))["__ql_pos"].alias(f"last{i}") for i in inputs.values()), *(F.max(f"__ql_n{i}").alias(f"n{i}") for i in inputs.values()))
    order = Window.partitionBy("Ticker").orderBy("__ql_block")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"at": F.coalesce(F.sum("end.__ql_pos").over(earlier), F.lit(0))} | {f"seen{i}": F.coalesce(F.sum(f"n{i}").over(earlier), F.lit(0)) for i in inputs.values()})
    own = own.withColumns({f"gap{i}": C("at") + C(f"first{i}")["__ql_pos"] - F.max(C("at") + C(f"last{i}")).over(earlier) for i in inputs.values()})
    start = lambda i, what: C(f"first{i}")["x"] if what == "value" else F.lit(1.0)
    met = lambda a, i, what: F.when(C(f"gap{i}").isNull(), start(i, what)).otherwise(_added(a, start(i, what), C(f"gap{i}")))  # noqa: E731  of the first value, without what came before
    own = own.withColumns({f"l{k}": F.sum(F.coalesce(_log_kept(a, C(f"gap{i}")) + C(f"end.__ql_p{k}"), F.lit(0.0))).over(so_far) for k, (a, i, _) in enumerate(scans)})
    own = own.withColumns({f"far{k}": F.floor(-C(f"l{k}") / REACH) for k in range(len(scans))})
    for k, (a, i, what) in enumerate(scans):
        near, l = Window.partitionBy("Ticker", f"far{k}").orderBy("__ql_block").rowsBetween(Window.unboundedPreceding, 0), C(f"l{k}") + C(f"far{k}") * REACH  # noqa: E741
        out = F.exp(C(f"end.__ql_p{k}")) * met(a, i, what) + C(f"end.__ql_z{k}")
        own = own.withColumns({f"z{k}": F.exp(l) * F.sum(out * F.exp(-l)).over(near), f"over{k}": F.coalesce(F.lead(f"far{k}").over(order) != C(f"far{k}"), F.lit(True))})
    last = lambda k, c: F.last(F.when(C(f"over{k}"), c), ignorenulls=True).over(earlier)  # noqa: E731  of the stretch before
    own = own.withColumns({f"y{k}": C(f"z{k}") + F.coalesce(F.exp(C(f"l{k}") - last(k, C(f"l{k}"))) * last(k, C(f"z{k}")), F.lit(0.0)) for k in range(len(scans))})
    into = {f"__ql_in{k}": F.last(C(f"y{k}"), ignorenulls=True).over(earlier) for k in range(len(scans))}
    own = own.withColumns(into)
    started = {f"__ql_start{k}": met(a, i, what) + F.when(C(f"gap{i}").isNull(), 0.0).otherwise(F.exp(_log_kept(a, C(f"gap{i}"))) * C(f"__ql_in{k}")) for k, (a, i, what) in enumerate(scans)}
    own = own.withColumns(started).select(*key, *into, *started, *(C(f"first{i}")["__ql_pos"].alias(f"__ql_first{i}") for i in inputs.values()), *(C(f"seen{i}").alias(f"__ql_seen{i}") for i in inputs.values()))

    df = df.join(own, key)
    at = lambda k, i: F.when(C("__ql_pos") >= C(f"__ql_first{i}"), F.exp(C(f"__ql_p{k}")) * C(f"__ql_start{k}") + C(f"__ql_z{k}")).otherwise(C(f"__ql_in{k}"))
    found: dict[str, Column] = {}
    for k, (a, i, what) in enumerate(scans):
        if what == "value":
            y = at(k, i) / at(k + 1, i) if a.adjust else at(k, i)
            found[a.name] = F.when(C(f"__ql_seen{i}") + C(f"__ql_n{i}") >= (1 if a.seed == "sma" else a.min_periods), y)
    df = df.withColumns(found)
    return df.drop(*(c for c in df.columns if c.startswith("__ql_")))


class _Carried:
    """One average of one ticker, continued from piece to piece of its values."""

    def __init__(self, a: Average) -> None:
        self.a, self.y, self.weight, self.gap, self.seen, self.total = a, math.nan, 0.0, 0, 0, 0.0

    def go(self, x: np.ndarray) -> np.ndarray:
        a, valid = self.a, ~np.isnan(x)
        seen = self.seen + np.cumsum(valid)
        if a.seed == "sma" and self.seen < a.min_periods:
            early = valid & (seen <= a.min_periods)
            self.total += float(x[early].sum())
            at = np.flatnonzero(early & (seen == a.min_periods))
            x = np.where(early, math.nan, x)
            x[at] = self.total / a.min_periods
        y = self._adjusted(x) if a.adjust else self._plain(x)
        self.seen = int(seen[-1])
        return y if a.seed == "sma" else np.where(seen >= a.min_periods, y, math.nan)

    def _plain(self, x: np.ndarray) -> np.ndarray:
        """The last value and the rows without one since stand before the piece; nothing is left after 65,536 of these."""
        n = 0 if math.isnan(self.y) else 1 + min(self.gap, 1 << 16)
        before = np.full(n, math.nan)
        before[:1] = self.y
        y = pd.Series(np.concatenate([before, x])).ewm(alpha=self.a.alpha, adjust=False).mean().to_numpy()[n:]
        last = np.flatnonzero(~np.isnan(x))
        self.y, self.gap = float(y[-1]), len(x) - 1 - int(last[-1]) if len(last) else self.gap + len(x)
        return y

    def _adjusted(self, x: np.ndarray) -> np.ndarray:
        y = np.empty(len(x))
        for k, v in enumerate(x.tolist()):
            self.weight *= 1 - self.a.alpha
            if v == v:
                self.y = v if self.y != self.y else (self.weight * self.y + v) / (self.weight + 1)
                self.weight += 1
            y[k] = self.y
        return y


def segments(batch: pa.RecordBatch, last: object) -> Iterator[tuple[int, int, bool]]:
    """``start, end, new`` of each ticker's rows in a sorted batch; ``new`` is false for a first one that goes on from the ticker ``last``."""
    tickers = batch["Ticker"].to_pandas().to_numpy(dtype=object)
    same = tickers[1:] == tickers[:-1]
    edges = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), len(tickers)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        yield a, b, bool(k or tickers[0] != last)


def in_streams(df: DataFrame) -> DataFrame:
    """``df`` with each ticker's bars in one task, by date: as a window leaves them, which needs no exchange where one was before."""
    return df.withColumn("__ql_nth", F.row_number().over(by_date()))


def _carry(batches: Iterator[pa.RecordBatch], wanted: list[Average]) -> Iterator[pa.RecordBatch]:
    last, states = object(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        inputs = {c: batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in {a.column for a in wanted} | {a.minus for a in wanted} if c in batch.schema.names}
        found = {a.name: np.empty(batch.num_rows) for a in wanted}
        value = lambda c: found[c] if c in found else inputs[c]
        nth = batch["__ql_nth"].to_numpy()
        for start, end, new in segments(batch, last):
            if new:
                states = [_Carried(a) for a in wanted]
            if nth[start] != 1 and new or (np.diff(nth[start:end]) != 1).any():
                raise ValueError("bars of a ticker came out of order")
            for state, a in zip(states, wanted, strict=True):
                x = value(a.column)[start:end]
                found[a.name][start:end] = state.go(x if a.minus is None else x - value(a.minus)[start:end])
        last = batch["Ticker"][-1].as_py()
        keep = [c for c in batch.schema.names if c != "__ql_nth"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(found[a.name], from_pandas=True) for a in wanted)], [*keep, *(a.name for a in wanted)])


def averages(df: DataFrame, wanted: list[Average], blocks: bool = False) -> DataFrame:
    """Add every average of ``wanted``, as pandas defines them: a missing value carries the last one on, and weighs as a row in between.

    An average can be of one listed before. With ``blocks`` the bars of a ticker are dealt over tasks.
    """
    for a in wanted:
        if not 0 < a.alpha <= 0.93:
            raise ValueError(f"{a.name}: alpha must be above 0 and at most 0.93")
    if not blocks:
        schema = StructType([*df.schema.fields, *(StructField(a.name, DoubleType()) for a in wanted)])
        return in_streams(df).mapInArrow(partial(_carry, wanted=wanted), schema)
    todo = list(wanted)
    while todo:
        later = {a.name for a in todo}
        now = [a for a in todo if a.column not in later and a.minus not in later]
        df, todo = _scan(df, now), [a for a in todo if a not in now]
    return df


def ema(df: DataFrame, n: int = 20, adjust: bool = False, blocks: bool = False) -> DataFrame:
    return averages(df, [span(f"EMA_{n}", n, adjust=adjust)], blocks)


def _macd(fast: int, slow: int, signal: int) -> list[Average]:
    return [span("fast", fast), span("slow", slow), span("MACD_signal", signal, "fast", minus="slow")]


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD, signal line and histogram, from one pass."""
    df = averages(df, _macd(fast, slow, signal)).withColumn("MACD", C("fast") - C("slow")).drop("fast", "slow")
    return df.withColumn("MACD_hist", C("MACD") - C("MACD_signal"))


def _moves(df: DataFrame) -> DataFrame:
    move = C("Close") - F.lag("Close").over(windows.by_date())
    return df.withColumn("move", move).withColumns({"up": F.greatest(C("move"), C("move") * 0), "down": F.greatest(-C("move"), C("move") * 0), "tr": true_range()}).drop("move")


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    df = averages(_moves(df), [wilder("gain", n, "up"), wilder("loss", n, "down")])
    value = F.when((C("loss") == 0) & (C("gain") > 0), F.lit(100.0)).when(C("loss") > 0, 100 - 100 / (1 + C("gain") / C("loss")))
    return df.withColumn(f"RSI_{n}w", value).drop("up", "down", "tr", "gain", "loss")


def atr_wilder(df: DataFrame, n: int = 14, long: int = 50) -> DataFrame:
    """Wilder's ATR and its plain mean over ``long`` bars."""
    df = averages(_moves(df), [wilder(f"ATR_{n}w", n, "tr")]).drop("up", "down", "tr")
    return df.withColumn(f"ATR_{long}", windows.mean(C(f"ATR_{n}w"), long))


#: Bars before a batch that the suite's windows look back on at most.
BACK = 32
_WINDOWED = ("SMA_20", "RSI_14", "ATR_14", "BB_Mid", "BB_Upper", "BB_Lower", "BB_Width", "%K", "%D", "Cum_TPV", "Cum_Vol", "VWAP")


def _running(x: np.ndarray, nth: np.ndarray, so_far: float) -> np.ndarray:
    """Sums of each ticker's values so far, from ``so_far`` on for a ticker that goes on; missing until there is a value."""
    out, starts = np.empty(len(x)), np.flatnonzero(nth == 1).tolist()
    for a, b in zip([0, *starts], [*starts, len(x)], strict=True):
        if a < b:
            before = so_far if a == 0 and nth[0] != 1 else math.nan
            there = ~np.isnan(x[a:b])
            total = np.cumsum(np.concatenate([[0.0 if before != before else before], np.where(there, x[a:b], 0.0)]))[1:]
            out[a:b] = total if before == before else np.where(np.logical_or.accumulate(there), total, math.nan)
    return out


def _windowed(bars: dict[str, np.ndarray], nth: np.ndarray) -> dict[str, np.ndarray]:
    """What ``windows.sma, rsi, atr, bollinger`` and ``stochastic`` say of sorted bars, added up in their order, so to the last digit.

    ``nth`` numbers a ticker's bars; a window that reaches over a ticker's first bar, or over a missing value, gives none.
    """
    h, l, c = (bars[x] for x in ("High", "Low", "Close"))  # noqa: E741

    def past(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.full(min(k, len(x)), math.nan), x[: len(x) - k]]) if k else x

    def over(x: np.ndarray, n: int, step, start) -> np.ndarray:
        padded = np.concatenate([np.full(n - 1, math.nan), x])
        for k in range(n):
            start = step(start, padded[k : k + len(x)])
        return np.where(nth >= n, start, math.nan)

    mean = lambda x, n: over(x, n, np.add, 0.0) / n
    divided = lambda x, y: np.where(y == 0, math.nan, x / np.where(y == 0, 1.0, y))
    before = np.where(nth == 1, math.nan, past(c, 1))
    move, mid, average, square = c - before, mean(c, 20), 0.0, 0.0
    padded = np.concatenate([np.full(19, math.nan), c])
    for k in range(20):
        x = padded[k : k + len(c)]
        delta = x - average
        share = delta / (k + 1)
        average, square = average + share, square + delta * (delta - share)
    spread = np.where(nth >= 20, np.sqrt(square / 19), math.nan)
    gain, loss = mean(np.maximum(move, 0.0), 14), mean(np.maximum(-move, 0.0), 14)
    rsi = np.where((loss == 0) & (gain > 0), 100.0, np.where(loss > 0, 100 - 100 / (1 + divided(gain, loss)), math.nan))
    upper, lower = mid + 2.0 * spread, mid - 2.0 * spread
    low, high = over(l, 14, np.minimum, math.inf), over(h, 14, np.maximum, -math.inf)
    k = divided(100 * (c - low), high - low)
    atr = mean(np.fmax(np.fmax(h - l, np.abs(h - before)), np.abs(l - before)), 14)
    return {"SMA_20": mid, "RSI_14": rsi, "ATR_14": atr, "BB_Mid": mid, "BB_Upper": upper, "BB_Lower": lower, "BB_Width": divided(upper - lower, mid), "%K": k, "%D": mean(k, 3)}


def _with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches with ``_WINDOWED``; the last ``BACK`` bars and the running sums are what goes on from batch to batch."""
    names, sums = ("High", "Low", "Close", "Volume"), (math.nan, math.nan)
    kept, kept_nth = {c: np.empty(0) for c in names}, np.empty(0, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, size = batch["__ql_nth"].to_numpy().astype(np.int64), len(kept_nth)
        bars = {c: np.concatenate([kept[c], batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False)]) for c in names}
        nth = np.concatenate([kept_nth, own])
        with np.errstate(all="ignore"):
            found = {c: x[size:] for c, x in _windowed(bars, nth).items()}
            h, l, c, v = (bars[x][size:] for x in ("High", "Low", "Close", "Volume"))  # noqa: E741
            worth, volume = _running((h + l + c) / 3 * v, own, sums[0]), _running(v, own, sums[1])
            found |= {"Cum_TPV": worth, "Cum_Vol": volume, "VWAP": np.where(volume == 0, math.nan, worth / np.where(volume == 0, 1.0, volume))}
        sums, kept, kept_nth = (float(worth[-1]), float(volume[-1])), {c: x[-BACK:] for c, x in bars.items()}, nth[-BACK:]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c], from_pandas=True) for c in _WINDOWED)], [*batch.schema.names, *_WINDOWED])


def _suite(batches: Iterator[pa.RecordBatch], wanted: list[Average]) -> Iterator[pa.RecordBatch]:
    return _carry(_with_windows(batches), wanted)


def indicator_suite(df: DataFrame) -> DataFrame:
    """The full suite, from one pass over the stream of sorted bars: windows add up a batch's columns at once, averages go on from batch to batch."""
    wanted = [span("EMA_20", 20), span("EMA_50", 50), span("EMA_200", 200), *_macd(12, 26, 9)]
    schema = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in (*_WINDOWED, *(a.name for a in wanted)))])
    df = in_streams(df).mapInArrow(partial(_suite, wanted=wanted), schema)
    return df.withColumn("MACD", C("fast") - C("slow")).drop("fast", "slow")
