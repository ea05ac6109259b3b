"""Back-test, evaluation of scored trades, data checks, scaling and splitting. What is global is one aggregate, not a loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import divide

C = F.col


def _share(x: Column, of: Column) -> Column:
    return divide(x, of)


def _doubles(values: list[float | None]) -> Column:
    return F.array(*(F.lit(v).cast("double") for v in values))


#: Values of a rank's range that are few enough to be read whole.
FEW = 1000


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact quantiles of expressions over all rows, between two ranks by linear interpolation; null without values.

    A distributed selection: for every rank an approximate sketch proposes two values around it, one aggregate counts what is below, at, between
    and above these, and the range that holds the rank is taken on. Each round leaves about a thousandth, and whatever the values are less than
    before; ranges of ``FEW`` rows are read. The driver sees a few numbers a rank, and no task all values.
    """
    rows = df.select(*(x.cast("double").alias(f"c{k}") for k, x in enumerate(columns.values()))).persist()
    try:
        counts = list(rows.agg(*(F.count(f"c{k}") for k in range(len(columns)))).first())
        at = {(k, share): share * (n - 1) for k, n in enumerate(counts) if n for share in shares}
        ranks = {(k, r) for (k, _), p in at.items() for r in (math.floor(p), math.ceil(p))}
        values = _select(rows, ranks, counts)
        out = {}
        for k, name in enumerate(columns):
            pairs = [(values[k, math.floor(at[k, s])], values[k, math.ceil(at[k, s])], at[k, s] % 1) if counts[k] else (None, None, 0) for s in shares]
            out[name] = [a if a == b else a + (b - a) * part for a, b, part in pairs]
        return out
    finally:
        rows.unpersist()


def _select(rows: DataFrame, ranks: set[tuple[int, int]], counts: list[int]) -> dict[tuple[int, int], float]:
    """The values of ``(column, rank)``."""
    values: dict[tuple[int, int], float] = {}
    ranges: dict[tuple[int, int], tuple] = {(k, r): (None, None, 0, counts[k]) for k, r in ranks}  # least, largest, rows below, rows in it
    within = lambda k, low, high: F.lit(True) if low is None else C(f"c{k}").between(low, high)
    while ranges:
        few = {key: x for key, x in ranges.items() if x[3] <= FEW}
        if few:
            kinds = {(key[0], *x[:2]): None for key, x in few.items()}
            tagged = F.array(*(F.when(within(k, low, high), F.struct(F.lit(i).alias("i"), C(f"c{k}").alias("v"))) for i, (k, low, high) in enumerate(kinds)))
            read: dict[int, list] = {}
            for r in rows.select(F.explode(tagged).alias("x")).filter("x.v IS NOT NULL").groupBy("x.i", "x.v").count().collect():
                read.setdefault(r["i"], []).append((r["v"], r["count"]))
            for i, kind in enumerate(kinds):
                ordered = [v for v, n in sorted(read.get(i, [])) for _ in range(n)]
                values |= {key: ordered[key[1] - x[2]] for key, x in few.items() if (key[0], *x[:2]) == kind}
            ranges = {key: x for key, x in ranges.items() if key not in few}
            continue
        near = lambda key, x: [min(1.0, max(0.0, (key[1] - x[2] + 0.5) / x[3] + d)) for d in (-3e-4, 3e-4)]
        keys = list(ranges)
        proposed = rows.agg(*(F.percentile_approx(F.when(within(k, *ranges[k, r][:2]), C(f"c{k}")), near((k, r), ranges[k, r]), 10_000) for k, r in keys)).first()
        parts = []
        for (k, r), (a, b) in zip(keys, proposed, strict=True):
            inside, v = within(k, *ranges[k, r][:2]), C(f"c{k}")
            for cut in (v < a, v == a, (v > a) & (v < b), v == b, v > b):
                parts.append(F.struct(F.count_if(inside & cut), F.min(F.when(inside & cut, v)), F.max(F.when(inside & cut, v))))
        told = rows.agg(*parts).first()
        for j, key in enumerate(keys):
            below = ranges.pop(key)[2]
            for i, (n, least, most) in enumerate(told[5 * j : 5 * j + 5]):
                if i == 3 and proposed[j][0] == proposed[j][1]:
                    continue
                if key[1] < below + n:
                    if least == most:
                        values[key] = least
                    else:
                        ranges[key] = (least, most, below, n)
                    break
                below += n
    return values


def bracket_backtest(df: DataFrame, capital: float = 100_000.0, direction: str = "long") -> DataFrame:
    """Equal-allocation back-test of ``Date, Ticker, Close, tp_level, sl_level, future_bracket_outcome``.

    A date's equity is divided over its TP_HIT and SL_HIT rows; those without a positive entry price get none of
    the gain, yet count in the division. Equity compounds by date over a table of one row per date.
    """
    hit = C("future_bracket_outcome")
    exit_price = F.when(hit == "TP_HIT", C("tp_level")).otherwise(C("sl_level"))
    gain = divide(exit_price - C("Close"), C("Close")) * (1 if direction == "long" else -1)
    rows = df.withColumn("valid", hit.isin("TP_HIT", "SL_HIT"))
    rows = rows.withColumn("gain", F.when(C("valid") & (C("Close") > 0), gain))
    days = rows.groupBy("Date").agg(F.count_if("valid").alias("n_valid"), F.sum("gain").alias("gains"))
    days = days.withColumn("factor", 1 + F.coalesce(divide(C("gains"), C("n_valid")), F.lit(0.0)))
    order = Window.orderBy("Date")  # one row per date
    days = days.withColumn("cumulative_equity", capital * F.product("factor").over(order))
    days = days.withColumn("equity_before", F.coalesce(F.lag("cumulative_equity").over(order), F.lit(capital)))
    out = rows.join(days.select("Date", "n_valid", "cumulative_equity", "equity_before"), "Date")
    taken = C("gain").isNotNull()
    return out.withColumns({
        "allocated_capital": F.when(taken, C("equity_before") / C("n_valid")), "trade_pnl": F.when(taken, C("equity_before") / C("n_valid") * C("gain")), "pnl_percent": 100 * C("gain"),
    }).drop("valid", "gain", "n_valid", "equity_before")


def pnl_summary(trades: DataFrame) -> DataFrame:
    """One row: signals by outcome, win rate, expectancy and extremes."""
    p, out = C("trade_pnl"), C("future_bracket_outcome")
    n = F.count(p)
    return trades.agg(
        F.count("*").alias("signals"), *(F.count_if(out == x).alias(x.lower()) for x in ("TP_HIT", "SL_HIT", "BOTH", "NONE")), n.alias("trades"),
        (100 * _share(F.count_if(p > 0), n)).alias("win_rate"), F.avg(p).alias("expectancy"), F.max(p).alias("max_win"), F.min(p).alias("max_loss"), F.sum(p).alias("total_pnl"),
    )


def performance(trades: DataFrame, capital: float = 1.0) -> DataFrame:
    """One row: trades, success rate, mean return, and what ``capital`` becomes if every trade returns the mean.

    Over millions of trades that passes what a double holds; ``final_log10``, its logarithm, never does.
    """
    r = C("trade_return")
    n, mean = F.count(r), F.avg(r)
    grown = F.log10(F.lit(float(capital))) + n * F.log10(1 + mean)
    return trades.agg(n.alias("trades"), _share(F.count_if(r > 0), n).alias("success_rate"), mean.alias("mean_return"), (capital * F.pow(1 + mean, n)).alias("final_value"), grown.alias("final_log10"))


def performance_by_outcome(trades: DataFrame) -> DataFrame:
    """A row per outcome (these are few): number, mean, deviation and quartiles of the returns."""
    r = C("trade_return")
    outcomes = [x["outcome"] for x in trades.select("outcome").distinct().collect()]
    found = exact_quantiles(trades, {str(k): F.when(C("outcome").eqNullSafe(F.lit(x)), r) for k, x in enumerate(outcomes)}, (0.25, 0.5, 0.75))
    per = F.lit(None).cast("array<double>")
    for k, x in enumerate(outcomes):
        per = F.when(C("outcome").eqNullSafe(F.lit(x)), _doubles(found[str(k)])).otherwise(per)
    flat = trades.groupBy("outcome").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"))
    return flat.select("outcome", "n", "mean", "std", "min", *(F.get(per, F.lit(k)).alias(q) for k, q in enumerate(("p25", "p50", "p75"))), "max")


def trade_metrics(scored: DataFrame, threshold: float = 0.5, target: float = 0.0, side: str = "long") -> DataFrame:
    """One row for the rows of ``prob`` at least ``threshold``: hits, precision, recall, mean win and loss, expectation, coverage."""
    gain = C("future_return") * (1 if side == "long" else -1)
    taken, good = C("prob") >= threshold, gain > target
    tp, fp = F.count_if(taken & good), F.count_if(taken & ~good)
    precision = _share(tp, tp + fp)
    win, loss = F.avg(F.when(taken & good, gain)), F.avg(F.when(taken & ~good, gain))
    return scored.agg(
        tp.alias("tp"), fp.alias("fp"), precision.alias("precision"), _share(tp, F.count_if(good)).alias("recall"), win.alias("avg_win"), loss.alias("avg_loss"),
        (precision * F.coalesce(win, F.lit(0.0)) + (1 - precision) * F.coalesce(loss, F.lit(0.0))).alias("expectation"), _share(tp + fp, F.count("*")).alias("coverage"),
    )


def threshold_table(scored: DataFrame, steps: int = 50, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """``threshold, trades, precision`` for ``steps`` evenly spaced thresholds, ``low`` and ``high`` among them: a row counts for the last
    one that it reaches, then counts are summed from above."""
    grid = [low + (high - low) / (steps - 1) * k for k in range(steps - 1)] + [high]
    marks = F.array(*map(F.lit, grid))
    # the step next to where the score stands, and the marks around it, for rounding can be off by one
    near = F.least(F.floor((C("prob") - low) / (high - low) * (steps - 1)), F.lit(steps - 1)).cast("int")
    reached = F.when(C("prob") < F.get(marks, near), near - 1).when(C("prob") >= F.get(marks, near + 1), near + 1).otherwise(near)
    counted = scored.filter(C("prob") >= low).groupBy(reached.alias("step")).agg(F.count("*").alias("n"), F.count_if(C("target") == 1).alias("good"))
    table = scored.sparkSession.range(steps).select(C("id").cast("int").alias("step")).join(counted, "step", "left").fillna(0)
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)  # ``steps`` rows
    table = table.withColumns({"trades": F.sum("n").over(above), "hits": F.sum("good").over(above)})
    return table.select(F.get(marks, C("step")).alias("threshold"), "trades", divide(C("hits"), C("trades")).alias("precision"))


def select_threshold(scored: DataFrame, min_trades: int = 100, precision_floor: float = 0.6, steps: int = 50, most_trades: bool = False, low: float = 0.5, high: float = 0.95) -> DataFrame:
    """One row: the first threshold with enough trades and precision, or with ``most_trades`` the one that keeps the most trades; else 0.5."""
    return select_from(threshold_table(scored, steps, low, high), min_trades, F.lit(precision_floor), most_trades)


def select_from(table: DataFrame, min_trades: int, precision_floor: Column, most_trades: bool = False) -> DataFrame:
    """The same from a ``threshold_table``."""
    good = table.filter((C("trades") >= min_trades) & (C("precision") >= precision_floor))
    best = F.max_by("threshold", F.struct("trades", "threshold")) if most_trades else F.min("threshold")
    return good.agg(F.coalesce(best, F.lit(0.5)).alias("threshold"))


def probability_distribution(scored: DataFrame, column: str = "prob") -> DataFrame:
    """One row: number, mean, deviation, extremes and exact percentiles."""
    marks = (25, 50, 75, 90, 95, 99)
    found = exact_quantiles(scored, {column: C(column)}, tuple(x / 100 for x in marks))[column]
    level = [F.lit(v).cast("double").alias(f"p{x}") for x, v in zip(marks, found, strict=True)]
    return scored.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")).select("n", "mean", "std", "min", *level, "max")


def class_counts(scored: DataFrame) -> DataFrame:
    """One row: class sizes and the weight that balances them."""
    pos, neg = F.count_if(C("target") == 1), F.count_if(C("target") == 0)
    return scored.agg(pos.alias("positives"), neg.alias("negatives"), divide(neg, pos).alias("positive_weight"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.groupBy("target", (C("prob") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def quality(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, F1 and AUC. The AUC comes from counts per distinct score, ties at half."""
    p, y = (C("prob") >= threshold).cast("int"), C("target")
    tp, fp, fn = F.count_if((p == 1) & (y == 1)), F.count_if((p == 1) & (y == 0)), F.count_if((p == 0) & (y == 1))
    flat = scored.agg(_share(F.count_if(p == y), F.count("*")).alias("accuracy"), divide(2 * tp, 2 * tp + fp + fn).alias("f1"))
    by_score = scored.groupBy("prob").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    # scores are dealt into ranges; within one a window counts what is below, and ranges are summed before
    ranges = by_score.withColumn("range", F.floor(C("prob") * 1000))
    w = Window.partitionBy("range").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    per = inside.groupBy("range").agg(F.sum(C("pos") * (C("below") + C("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = F.coalesce(F.sum("neg").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 1001 rows
    auc = per.withColumn("before", before).agg(divide(F.sum(C("won") + C("pos") * C("before")), F.sum("pos") * F.sum("neg")).alias("auc"))
    return flat.crossJoin(auc)  # one row each


def profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """A row per column: counts, mean, deviation, extremes, median, missing and distinct values, from one aggregate."""
    parts, middles = [], exact_quantiles(df, {c: C(c).cast("double") for c in columns}, (0.5,)) if exact else {}
    for c in columns:
        distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
        middle = F.lit(middles[c][0]) if exact else F.percentile_approx(c, 0.5)
        parts.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), middle.cast("double").alias("median"), F.max(c).cast("double").alias("max"), F.count_if(C(c).isNull()).alias("missing"), distinct.alias("distinct")).alias(f"p{len(parts)}"))
    return df.agg(*parts).select(F.explode(F.array(*(C(f"p{k}") for k in range(len(parts))))).alias("p")).select("p.*")


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """``column, outliers``: values outside the quartiles by more than ``k`` times their distance."""
    q = exact_quantiles(df, {c: C(c).cast("double") for c in columns}, (0.25, 0.75))
    counts = []
    for c in columns:
        low, high = q[c] if q[c][0] is not None else (0.0, 0.0)
        gap = high - low
        counts.append(F.struct(F.lit(c).alias("column"), F.count_if((C(c) < low - k * gap) | (C(c) > high + k * gap)).alias("outliers")).alias(c))
    return df.agg(*counts).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def clip_percentiles(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    q = exact_quantiles(df, {c: C(c).cast("double") for c in columns}, (low, high))
    return df.withColumns({c: F.when(C(c).isNotNull(), F.least(F.greatest(C(c), F.lit(q[c][0])), F.lit(q[c][1]))) for c in columns if q[c][0] is not None})


def validate_ranges(df: DataFrame, rules: dict[str, tuple[float, float]], huge: float = 1e12) -> DataFrame:
    """``column, nulls, infinite, huge, outside``: a row per column of ``rules``, from one aggregate."""
    checks = []
    for c, (low, high) in rules.items():
        x = C(c).cast("double")
        infinite = F.isnan(x) | (F.abs(x) == float("inf"))
        checks.append(F.struct(F.lit(c).alias("column"), F.count_if(x.isNull()).alias("nulls"), F.count_if(infinite).alias("infinite"), F.count_if(~infinite & (F.abs(x) > huge)).alias("huge"), F.count_if((x < low) | (x > high)).alias("outside")).alias(c))
    return df.agg(*checks).select(F.explode(F.array(*(C(f"`{c}`") for c in rules))).alias("p")).select("p.*")


#: Ranges that values should be in by what a column's name contains; the first one that fits counts.
EXPECTED_RANGES: dict[str, tuple[float, float]] = {
    "_rel": (-5, 5), "EMA_diff": (-1000, 1000), "MACD_diff": (-1000, 1000), "MACD_diff_": (-1000, 1000), "BB_Width": (0, 10), "BB_Pos": (0, 1), "BB_Mid_Dev": (-10, 10),
    "RSI_14": (0, 100), "RSI_diff": (-100, 100), "RSI_vs_": (-100, 100), "MACD": (-5000, 5000), "Range_pct": (0, 2), "Range_over_ATR": (0, 20), "Range_over_Close": (0, 1),
    "ATR_14": (0, 5000), "ATR_vs_NIFTY": (0, 20), "ATR_vs_BANKNIFTY": (0, 20), "log_ATR_vs_NIFTY": (-5, 5), "Volume_log": (0, 20), "_Vol_log": (0, 25), "Close_range_pos": (0, 1),
    "vol_change_pct": (-10, 10), "High_Low_ratio": (1, 5), "Close_Open_ratio": (0.2, 5), "MACD_diff_NIFTY": (-2000, 2000), "MACD_diff_BANKNIFTY": (-2000, 2000), "future_return": (-1, 1),
    "Enhanced_Regime_for_RD": (-2, 3),
}


def rules_by_name(columns: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[float, float]]:
    """The range of every column whose name contains one of the patterns."""
    known = (ranges or EXPECTED_RANGES).items()
    found = {c: next((bounds for pattern, bounds in known if pattern in c), None) for c in columns}
    return {c: bounds for c, bounds in found.items() if bounds is not None}


def validate_by_name(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``validate_ranges`` with the rules that the numeric columns' names tell."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    return validate_ranges(df, rules_by_name(numeric, ranges))


def fit_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, low, high``: a small table to store and apply."""
    both = df.agg(*(F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns))
    return both.select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def apply_minmax(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``<c>_scaled`` in [0, 1]; 0 for a column without width. ``bounds`` has a row per column."""
    out = {}
    for r in bounds.collect():
        scaled = (C(r["column"]) - r["low"]) / (r["high"] - r["low"]) if r["low"] is not None and r["high"] > r["low"] else C(r["column"]) * 0
        out[f"{r['column']}_scaled"] = F.when(C(r["column"]).isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    return df.withColumns(out)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_std``: zero mean and unit population deviation; 0 for a constant column."""
    r = df.agg(*(F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns)).first()
    return df.withColumns({f"{c}_std": (C(c) - (r[c][0] or 0.0)) / (r[c][1] or 1.0) for c in columns})


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys and ``columns``, in order, of the rows that have them all."""
    return df.dropna(subset=columns).select("Ticker", "Date", *columns)


def split_by_ticker(df: DataFrame, test_share: float = 0.2) -> DataFrame:
    """``is_test`` by a digest of the ticker, so that all bars of a ticker fall on one side."""
    bucket = F.conv(F.substring(F.md5(C("Ticker").cast("binary")), 1, 4), 16, 10).cast("int")
    return df.withColumn("is_test", bucket < int(test_share * 65536))


def ensemble(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum(weights.values())
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + C(c) * w
    return df.withColumn("prob", score / total)


def top_n(df: DataFrame, n: int, by: str = "prob", ties: tuple[str, ...] = ("Ticker", "Date")) -> DataFrame:
    """The ``n`` best rows: partial tops per task, never a full sort."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def top_share(df: DataFrame, share: float = 0.1, by: str = "prob") -> DataFrame:
    level = exact_quantiles(df, {by: C(by).cast("double")}, (1 - share,))[by][0]
    return df.filter(C(by) >= (level if level is not None else 0.0))


def false_negatives(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.filter((C("target") == 1) & (C("prob") < threshold))
