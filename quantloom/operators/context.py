"""Index context, sectors and relational features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import divide

C = F.col
EPS = 1e-6
#: Regimes as numbers; any other is 0.
REGIMES = {"Bearish": -1, "Neutral": 0, "Bullish": 1, "High Volatility": 2}


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("Date", *(C(c).alias(f"{prefix}{c}") for c in df.columns if c not in ("Date", "Ticker")))


def index_features(df: DataFrame, first: str, second: str, prefixes: tuple[str, str]) -> DataFrame:
    """One row per date with both indices' columns under their prefixes, and each one's ``Trend`` from its averages."""
    trend = F.when(C("EMA_20") > C("EMA_50"), "Bullish").otherwise("Bearish")
    df = df.withColumn("Trend", trend)
    a, b = (prefixed(df.filter(C("Ticker") == t), p) for t, p in zip((first, second), prefixes, strict=True))
    return a.join(b, "Date", "full")


def join_index(df: DataFrame, idx: DataFrame) -> DataFrame:
    """Bars with the index columns of their date. ``idx`` has a row per date; Spark broadcasts it where its size allows."""
    return df.join(idx, "Date", "left")


def outer_with_regime(df: DataFrame, regimes: DataFrame, prefix: str = "nifty50_") -> DataFrame:
    """Bars with the index's regimes of their date; dates that only the index has, as forecasts do, stay, without a ticker."""
    return df.join(prefixed(regimes, prefix), "Date", "full")


def add_sector(df: DataFrame, sectors: DataFrame, default: str = "OTHERS") -> DataFrame:
    """``Sector`` by ticker, and ``Sector_code``: its place among the sectors that occur, in alphabetical order.

    The sector map has a row per ticker; Spark broadcasts it where its size allows.
    """
    named = df.join(sectors.select("Ticker", "Sector").dropDuplicates(["Ticker"]), "Ticker", "left").withColumn("Sector", F.coalesce("Sector", F.lit(default)))
    codes = named.select("Sector").distinct().withColumn("Sector_code", F.row_number().over(Window.orderBy("Sector")) - 1)  # as many rows as sectors
    return named.join(codes, "Sector")


def relational_features(df: DataFrame) -> DataFrame:
    """Derived relations of a bar's indicators to its close and to both indices, as plain differences and ratios."""
    width, nwidth, bwidth = (C(f"{p}BB_Upper") - C(f"{p}BB_Lower") for p in ("", "NIFTY_", "BANKNIFTY_"))
    size = C("High") - C("Low")
    out = {
        "EMA_diff": C("EMA_20") - C("EMA_50"), "NIFTY_EMA_diff": C("NIFTY_EMA_20") - C("NIFTY_EMA_50"), "BANKNIFTY_EMA_diff": C("BANKNIFTY_EMA_20") - C("BANKNIFTY_EMA_50"),
        "MACD_diff": C("MACD") - C("MACD_signal"), "RSI_diff_NIFTY": C("RSI_14") - C("NIFTY_RSI_14"), "RSI_diff_BANKNIFTY": C("RSI_14") - C("BANKNIFTY_RSI_14"),
        "MACD_diff_NIFTY": C("MACD") - C("NIFTY_MACD"), "MACD_diff_BANKNIFTY": C("MACD") - C("BANKNIFTY_MACD"),
        "VWAP_diff": C("VWAP") - C("Close"), "VWAP_NIFTY_diff": C("VWAP") - C("NIFTY_EMA_20"), "VWAP_BANKNIFTY_diff": C("VWAP") - C("BANKNIFTY_EMA_20"),
        "BB_Width": divide(width, C("BB_Mid")), "BB_Pos": (C("Close") - C("BB_Lower")) / (width + EPS),
        "NIFTY_BB_Width": divide(nwidth, C("NIFTY_BB_Mid")), "BANKNIFTY_BB_Width": divide(bwidth, C("BANKNIFTY_BB_Mid")),
        "Close_vs_EMA20": divide(C("Close"), C("EMA_20")) - 1, "Close_vs_EMA50": divide(C("Close"), C("EMA_50")) - 1, "BB_Mid_Dev": (C("Close") - C("BB_Mid")) / (width + EPS),
        "RSI_vs_MACD": divide(C("RSI_14"), C("MACD") + EPS), "RSI_vs_NIFTY": C("RSI_14") - C("NIFTY_RSI_14"), "RSI_vs_BANKNIFTY": C("RSI_14") - C("BANKNIFTY_RSI_14"),
        "Range_over_ATR": divide(size, C("ATR_14") + EPS), "Range_over_Close": divide(size, C("Close")),
        "VWAP_minus_Close": C("VWAP") - C("Close"), "VWAP_minus_EMA20": C("VWAP") - C("EMA_20"),
        "ATR_vs_NIFTY": divide(C("ATR_14"), C("NIFTY_ATR_14") + EPS), "ATR_vs_BANKNIFTY": divide(C("ATR_14"), C("BANKNIFTY_ATR_14") + EPS),
        "log_ATR_vs_NIFTY": F.log1p(divide(C("ATR_14"), C("NIFTY_ATR_14") + EPS)),
    }
    return df.withColumns(out)


def relative_to_base(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_rel``: an indicator against the close of what it belongs to, by its prefix, less 1."""
    base = lambda c: next((f"{p}Close" for p in ("BANKNIFTY_", "NIFTY_") if c.startswith(p)), "Close")
    return df.withColumns({f"{c}_rel": divide(C(c), C(base(c))) - 1 for c in columns if base(c) in df.columns})


def _log_volume(c: str) -> Column:
    return F.when(C(c).isNotNull(), F.log1p(F.greatest(C(c), F.lit(0.0))))


def price_volume_features(df: DataFrame) -> DataFrame:
    """Logarithms of volumes and ratios of prices and volume within a bar."""
    size = C("High") - C("Low")
    return df.withColumns({
        **{f"log_{c}": _log_volume(c) for c in ("Volume", "Cum_Vol") if c in df.columns},
        "High_Low_ratio": divide(C("High"), C("Low")), "Close_Open_ratio": divide(C("Close"), C("Open")),
        "Close_position": F.coalesce(divide(C("Close") - C("Low"), size), F.lit(0.0)), "Volume_price_ratio": divide(C("Volume"), C("Close")),
    })


def candle_features(df: DataFrame) -> DataFrame:
    """Body and wicks against the range; 0 where there is no range."""
    size, top, bottom = C("High") - C("Low"), F.greatest("Close", "Open"), F.least("Close", "Open")
    share = lambda x: F.coalesce(divide(x, size), F.lit(0.0))
    return df.withColumns({"body_pct": share(F.abs(C("Close") - C("Open"))), "upper_wick_pct": share(C("High") - top), "lower_wick_pct": share(bottom - C("Low")), "body_vs_mid": share((C("Close") + C("Open")) / 2 - (C("High") + C("Low")) / 2)})


def index_relatives(df: DataFrame, prefixes: tuple[str, ...] = ("NIFTY_", "BANKNIFTY_")) -> DataFrame:
    """The close against each index's."""
    return df.withColumns({f"Close_vs_{p}Close": divide(C("Close"), C(f"{p}Close")) for p in prefixes})


def ml_features(df: DataFrame) -> DataFrame:
    """The relational set of the machine-learning table. Names shared with ``relational_features`` have other formulas here."""
    ratio = lambda a, b: divide(a, b + EPS)
    size = C("High") - C("Low")
    return df.withColumns({
        "MACD_minus_signal": C("MACD") - C("MACD_signal"), "Close_vs_EMA20": C("Close") - C("EMA_20"), "Close_vs_EMA50": C("Close") - C("EMA_50"),
        "RSI_vs_NIFTY": ratio(C("RSI_14"), C("NIFTY_RSI_14")), "RSI_vs_BANKNIFTY": ratio(C("RSI_14"), C("BANKNIFTY_RSI_14")),
        "MACD_vs_NIFTY": C("MACD") - C("NIFTY_MACD"), "MACD_vs_BANKNIFTY": C("MACD") - C("BANKNIFTY_MACD"),
        "VWAP_vs_Close": ratio(C("VWAP"), C("Close")) - 1, "Range_over_ATR": ratio(divide(size, C("Close")), C("ATR_14")),
        "ATR_vs_NIFTY": ratio(C("ATR_14"), C("NIFTY_ATR_14")), "ATR_vs_BANKNIFTY": ratio(C("ATR_14"), C("BANKNIFTY_ATR_14")), "log_ATR": F.log1p("ATR_14"),
    })


def regime_code(df: DataFrame, column: str) -> DataFrame:
    codes = F.create_map(*(F.lit(x) for pair in REGIMES.items() for x in pair))
    return df.withColumn(f"{column}_code", F.coalesce(F.try_element_at(codes, C(column)), F.lit(0)))


def select_stocks(df: DataFrame, regime: str) -> DataFrame:
    """Stocks for a regime: RSI above 50 if bullish, PE below 20 if bearish, else volume above the mean of all."""
    if regime == "Bullish":
        return df.filter("RSI > 50")
    if regime == "Bearish":
        return df.filter("PE < 20")
    level = df.agg(F.avg("Volume").alias("level")).first()["level"]
    return df.filter(C("Volume") > (level if level is not None else 0.0))


def binary_target(df: DataFrame, threshold: float, side: str = "long") -> DataFrame:
    return df.withColumn("target", (C("future_return") > threshold if side == "long" else C("future_return") < -threshold).cast("int"))
