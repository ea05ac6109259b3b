"""Indicators and regimes over a stream of bars: what a ticker's past leaves is state, so a new bar costs the same however long the past.

The state of a ticker is a few exponential averages, the last values that plain windows need (50 at most) and the regime's memory. It lives in
Spark's state store (RocksDB) under the query's checkpoint, so a query that starts again goes on from there, and lost executors lose nothing. Bars of one micro-batch
are taken by date. Bars not later than the ticker's last one, and bars without a close, are dropped. The values are those of the batch suite.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import fmean, stdev
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Exponential averages by name: weight of the newest close. MACD is fast less slow.
ALPHAS = {"EMA_20": 2 / 21, "EMA_50": 2 / 51, "EMA_200": 2 / 201, "fast": 2 / 13, "slow": 2 / 27}
SIGNAL = 2 / 10
OUTPUT = "Ticker string, Date timestamp, Close double, EMA_20 double, EMA_50 double, EMA_200 double, MACD double, MACD_signal double, RSI_14 double, ATR_14 double, BB_Upper double, BB_Lower double, regime string"
_STATE = "last timestamp, bars long, averages array<double>, closes array<double>, moves array<double>, ranges array<double>, atrs array<double>, hists array<double>, ready long, regime string, again long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _mean(values: list[float], n: int) -> float | None:
    return fmean(values) if len(values) == n else None


class Past:
    """What the bars so far leave of a ticker."""

    def __init__(self, kept: tuple | None = None) -> None:
        self.last, self.bars, self.averages, self.closes, self.moves, self.ranges, self.atrs, self.hists, self.ready, self.regime, self.again = (
            (x if not isinstance(x, (list, tuple)) else list(x) for x in kept) if kept else (None, 0, [], [], [], [], [], [], 0, "", 0)
        )

    def kept(self) -> tuple:
        return (self.last, self.bars, self.averages, self.closes, self.moves, self.ranges, self.atrs, self.hists, self.ready, self.regime, self.again)

    def add(self, date: Any, high: float, low: float, close: float) -> tuple:
        """The indicators of the next bar."""
        before = self.closes[-1] if self.closes else None
        own = [close if not self.averages else (1 - a) * y + a * close for a, y in zip(ALPHAS.values(), self.averages or [0.0] * len(ALPHAS), strict=False)]
        macd = own[3] - own[4]
        signal = macd if not self.averages else (1 - SIGNAL) * self.averages[5] + SIGNAL * macd
        self.averages = [*own, signal]
        self.closes = [*self.closes, close][-20:]
        if before is not None:
            self.moves = [*self.moves, close - before][-14:]
        self.ranges = [*self.ranges, max(high - low, *(abs(x - before) for x in (high, low) if before is not None), high - low)][-14:]
        gain, loss = (_mean([max(s * m, 0.0) for m in self.moves], 14) for s in (1, -1))
        rsi = None if gain is None or not (gain or loss) else 100.0 if not loss else 100 - 100 / (1 + gain / loss)
        atr = _mean(self.ranges, 14)
        if atr is not None:
            self.atrs = [*self.atrs, atr][-50:]
        middle = _mean(self.closes, 20)
        spread = 2 * stdev(self.closes) if middle is not None else 0.0
        upper, lower = (None, None) if middle is None else (middle + spread, middle - spread)
        long_atr = _mean(self.atrs, 50)
        told = None
        if None not in (rsi, atr, middle, long_atr):
            told = self._regime(close, own[1], own[2], macd - signal, rsi, atr, long_atr)
        self.last, self.bars = date, self.bars + 1
        return (date, close, own[0], own[1], own[2], macd, signal, rsi, atr, upper, lower, told)

    def _regime(self, close: float, ema_50: float, ema_200: float, hist: float, rsi: float, atr: float, long_atr: float, gap: float = 50.0, confirm: int = 3, hold: int = 5) -> str:
        """The rule of ``regime_stateful``, bar by bar."""
        self.hists, self.ready = [*self.hists, hist][-confirm:], self.ready + 1
        falling = self.ready > confirm and all(h < 0 for h in self.hists)
        if ema_50 > ema_200 and hist > 0 and rsi > 55:
            now = "Bullish"
        elif ema_50 < ema_200 and hist < 0 and rsi < 40 and falling and close < ema_50:
            now = "Bearish"
        elif atr > long_atr and abs(hist) > gap:
            now = "High Volatility"
        else:
            now = self.regime if self.regime in ("Bullish", "Bearish") and self.again < hold else "Neutral"
        self.again = self.again + 1 if now == self.regime else 0
        self.regime = now
        return now


class _Indicators(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        past = Past(self.past.get() if self.past.exists() else None)
        bars = pd.concat(list(rows)).dropna(subset=["Date", "Close"]).sort_values("Date", kind="stable").drop_duplicates("Date")
        out = []
        for date, high, low, close in zip(bars["Date"].dt.to_pydatetime(), bars["High"], bars["Low"], bars["Close"], strict=True):
            if past.last is None or date > past.last:
                out.append((key[0], *past.add(date, float(high), float(low), float(close))))
        self.past.update(past.kept())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame) -> DataFrame:
    """The suite and the regime of every bar of a stream ``Ticker, Date, High, Low, Close``."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = bars.selectExpr("Ticker", "cast(Date as timestamp) as Date", "cast(High as double) as High", "cast(Low as double) as Low", "cast(Close as double) as Close")
    return rows.groupBy("Ticker").transformWithStateInPandas(statefulProcessor=_Indicators(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
