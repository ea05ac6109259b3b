"""Indicator streams with restarts, the vendor source's pruning, the store's commits, and models with folds by ticker."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models, recursive, regime, windows
from quantloom.sources import files, store, vendor
from quantloom.streaming import indicators, streams


def walk(seed, n, ticker, start=datetime(2024, 1, 1)):
    r, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        price *= math.exp(r.gauss(0.001 * math.sin(k / 40), 0.02))
        rows.append((ticker, start + timedelta(hours=k), price, price * (1 + r.random() / 50), price * (1 - r.random() / 50), price * (1 + r.uniform(-0.01, 0.01)), float(r.randint(1, 50))))
    return rows


BARS = "Ticker string, Date timestamp, Open double, High double, Low double, Close double, Volume double"


def test_stream_of_indicators_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [*walk(1, 260, "A"), *walk(2, 150, "B"), *walk(3, 5, "C")]
    random.Random(1).shuffle(rows)
    middle = datetime(2024, 1, 1) + timedelta(hours=100)
    df, path, out = spark.createDataFrame(rows, BARS), str(tmp_path / "in"), str(tmp_path / "out")
    whole = recursive.indicator_suite(df).withColumn("ATR_50", windows.mean(F.col("ATR_14"), 50))
    told = {(r["Ticker"], r["Date"]): r["regime"] for r in regime.regime_stateful(whole).collect()}
    wanted = {(r["Ticker"], r["Date"]): r for r in whole.collect()}

    def run():
        arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return streams.run_available(indicators.stream_indicators(arriving), out, str(tmp_path / "checkpoint"), "append")

    files.write_table(df.filter(F.col("Date") < F.lit(middle)).coalesce(1), path)
    assert run().count() == df.filter(F.col("Date") < F.lit(middle)).count()
    files.write_table(df.filter(F.col("Date") >= F.lit(middle)).coalesce(1), path, mode="append")
    files.write_table(df.filter("Ticker = 'A'").limit(3).coalesce(1), path, mode="append")  # late: dropped
    found = run().collect()
    assert len(found) == len(rows) and len(told) > 150
    for r in found:
        own = wanted[r["Ticker"], r["Date"]]
        for c in ("EMA_20", "EMA_50", "EMA_200", "MACD", "MACD_signal", "RSI_14", "ATR_14", "BB_Upper", "BB_Lower"):
            assert (r[c] is None) == (own[c] is None) and (r[c] is None or r[c] == pytest.approx(own[c], rel=1e-9, abs=1e-9)), (r["Ticker"], r["Date"], c)
        assert r["regime"] == told.get((r["Ticker"], r["Date"]))


def test_vendor_source_leaves_out_files_and_rows(spark, tmp_path):
    for ticker in ("A", "B&C", "D"):
        (tmp_path / f"symbol={ticker.replace('&', '%26')}").mkdir()
        lines = [f"2024-01-{k:02d},\"1,0{k:02d}.5\",2,1,1.5,x" for k in range(1, 11)]
        (tmp_path / f"symbol={ticker.replace('&', '%26')}" / "part.csv").write_text("\n".join(["Date,OpenPrice,HighPrice,LowPrice,ClosePrice,TotalTradedQuantity", *lines, ",1,1,1,1,1"]))
    vendor.register(spark)
    df = spark.read.format("vendor_bars").load(str(tmp_path))
    assert df.count() == 30 and df.rdd.getNumPartitions() == 3
    some = df.filter((F.col("Ticker") == "B&C") & (F.col("Date") > F.lit(date(2024, 1, 8))) & (F.col("Date") <= F.lit(date(2024, 1, 9))))
    assert [tuple(r) for r in some.collect()] == [("B&C", date(2024, 1, 9), 1009.5, 2.0, 1.0, 1.5, None)]
    assert some.rdd.getNumPartitions() == 1
    assert df.filter(F.col("Ticker").isin("A", "D") & (F.col("Open") > 1005)).count() == 12
    assert df.filter("Ticker = 'Z'").count() == 0


def test_store_counts_only_what_is_committed(spark, tmp_path):
    folder, schema = str(tmp_path / "store"), "Ticker string, Date date, Close double"
    make = lambda *rows: spark.createDataFrame([(t, date(y, 5, 1), float(c)) for t, y, c in rows], schema)
    read = lambda: sorted((r["Ticker"], r["Date"].year, r["Close"]) for r in store.read_store(spark, folder, schema).collect())
    assert read() == []
    assert store.upsert(spark, folder, make(("A", 2020, 1), ("B", 2021, 2), ("B", 2021, 2))) == 0
    assert store.upsert(spark, folder, make(("A", 2021, 3), ("B", 2021, 4))) == 1
    assert read() == [("A", 2020, 1.0), ("A", 2021, 3.0), ("B", 2021, 4.0)]

    class Lost(Exception):
        pass

    real = spark.createDataFrame
    try:  # the writer is lost between the bars and their commit
        object.__setattr__(spark, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(Lost()) if a[1:] == ("year int, version int",) else real(*a, **b))
        with pytest.raises(Lost):
            store.upsert(spark, folder, make(("A", 2020, 9)))
    finally:
        object.__delattr__(spark, "createDataFrame")
    assert read() == [("A", 2020, 1.0), ("A", 2021, 3.0), ("B", 2021, 4.0)]
    assert store.upsert(spark, folder, make(("C", 2022, 5))) == 2
    assert read() == [("A", 2020, 1.0), ("A", 2021, 3.0), ("B", 2021, 4.0), ("C", 2022, 5.0)]


@pytest.fixture(scope="module")
def rows(spark):
    r, out = random.Random(7), []
    for t in range(30):
        for k in range(40):
            x, y = r.gauss(0, 1), r.gauss(0, 1)
            out.append((f"T{t}", date(2024, 1, 1) + timedelta(days=k), x, y, int(x + 0.3 * r.gauss(0, 1) > 0), "Up" if x > 0.5 else "Down" if x < -0.5 else "Flat"))
    return spark.createDataFrame(out, "Ticker string, Date date, x double, y double, target int, regime string")


def test_folds_and_grids_by_ticker(rows):
    folds = models.with_folds(rows).groupBy("Ticker").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("fold")).collect()
    assert {r["n"] for r in folds} == {1} and {r["fold"] for r in folds} == {0, 1, 2}
    assert math.prod(map(len, models.GRID.values())) == 48
    found = models.grid_search(models.with_class_weight(rows), ["x", "y"], kind="logistic", grid={"regParam": (0.0, 10.0), "elasticNetParam": (1.0,)})
    assert len(found.avgMetrics) == 2 and found.avgMetrics[0] > 0.8 > found.avgMetrics[1]
    with pytest.raises(ValueError, match="boosted, forest, logistic"):
        models.learner("other", ["x"])


def test_saved_models_score_alike(rows, tmp_path):
    settings = {"boosted": {"maxIter": 3, "maxDepth": 2}, "forest": {"numTrees": 4, "maxDepth": 3}, "logistic": {}}
    models.train_and_save(rows, ["x", "y"], str(tmp_path / "m"), settings)
    weights = {"boosted": 1.0, "forest": 2.0, "logistic": 1.0}
    found = models.score_with_saved(rows, str(tmp_path / "m"), weights)
    assert found.columns == [*rows.columns, "prob_boosted", "prob_forest", "prob_logistic", "prob"] and found.count() == rows.count()
    for r in found.limit(50).collect():
        assert r["prob"] == pytest.approx((r["prob_boosted"] + 2 * r["prob_forest"] + r["prob_logistic"]) / 4)
    again = models.learner("logistic", ["x", "y"]).fit(models.with_class_weight(rows))
    both = models.probabilities(again, found, "again").select("again", "prob_logistic").collect()
    assert max(abs(r["again"] - r["prob_logistic"]) for r in both) < 1e-9
    right = found.filter((F.col("prob") > 0.5) == (F.col("target") == 1)).count()
    assert right > 0.85 * found.count()


def test_forest_probabilities_move_the_forecast(rows, tmp_path):
    model, test = models.regime_forest(rows, ["x", "y"], trees=5, depth=3)
    model.write().save(str(tmp_path / "forest"))
    loaded = models.load_model(str(tmp_path / "forest"))
    shares = {(r["Ticker"], r["regime"]): r["share"] for r in models.recent_probabilities(loaded, rows).collect()}
    last = rows.filter("Ticker = 'T3'").orderBy("Date", ascending=False).limit(10)
    by_hand = np.mean([r["probability"].toArray() for r in model.transform(last).collect()], axis=0)
    for name, p in zip(model.stages[0].labels, by_hand, strict=False):
        assert shares.get(("T3", name), 0.0) == pytest.approx(p)
    assert sum(v for (t, _), v in shares.items() if t == "T3") == pytest.approx(1.0) and test.count() > 100
    moved = {r["regime"]: r["p"] for r in regime.forecast(rows.select("Ticker", "Date", "regime"), 1, models.recent_probabilities(loaded, rows)).filter("Ticker = 'T3'").collect()}
    own = rows.filter("Ticker = 'T3'").orderBy("Date").select("regime").toPandas()["regime"].tolist()
    names = sorted(set(own))
    counts = np.array([[sum(a == x and b == y for a, b in zip(own, own[1:], strict=False)) for y in names] for x in names], dtype=float)
    chain = counts[names.index(own[-1])] / counts[names.index(own[-1])].sum()
    blend = np.array([shares.get(("T3", x), 0.0) for x in names])
    weight = min(0.9, blend.max())
    assert [moved[x] for x in names] == pytest.approx(list((1 - weight) * chain + weight * blend))


def test_trees_on_cells_are_those_on_rows(rows):
    """Every row is in a cell, none is too heavy, and trees that draw nothing come out as on the rows themselves."""
    many = models.with_class_weight(rows.unionAll(rows.withColumn("x", F.lit(5.0)).limit(600)).unionAll(rows.limit(1).withColumn("y", F.lit(None).cast("double"))))
    bins = models.binned(many, ["x", "y"])
    found = models.cells(many, bins, "target").toPandas()
    assert found["n"].sum() == many.count() - 1 and found["n"].max() <= max(1.0, many.count() / models.PARTS)
    assert found["class_weight"].sum() == pytest.approx(many.dropna().agg(F.sum("class_weight")).first()[0])
    assert found["x_bin"].nunique() <= models.BINS and found["y_bin"].nunique() <= models.BINS
    setting = {"maxIter": 4, "maxDepth": 3, "subsamplingRate": 1.0}
    model = models.fitted("boosted", many, ["x", "y"], **setting)
    plain = models.learner("boosted", ["x_bin", "y_bin"], **setting).fit(bins.transform(many))
    both = models.probabilities(plain, bins.transform(models.probabilities(model, many, "on_cells")), "on_rows").collect()
    assert len(both) == many.count() - 1 and max(abs(r["on_cells"] - r["on_rows"]) for r in both) < 1e-9
    search = models.grid_search(many, ["x", "y"], grid={"maxDepth": (1, 3)}, maxIter=3, subsamplingRate=1.0)
    folds = models.with_folds(bins.transform(many))
    own = []
    for k in range(3):
        one = models.learner("boosted", ["x_bin", "y_bin"], maxDepth=3, maxIter=3, subsamplingRate=1.0).fit(folds.filter(f"fold <> {k}"))
        told = one.transform(folds.filter(f"fold = {k} AND y IS NOT NULL")).filter("prediction_boosted = 1")
        own.append(told.filter("target = 1").count() / told.count())
    assert search.avgMetrics[1] == pytest.approx(np.mean(own))
