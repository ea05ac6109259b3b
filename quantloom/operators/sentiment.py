"""A learned scorer of news: hashed words, inverse document frequencies and a logistic regression; score = (P(positive) - P(negative)) * 100."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts of each class that are fitted on at most; they are chosen by a digest, so every run takes the same.
MAX_LABELLED = 5000


def bounded_sample(labelled: DataFrame, label: str, key: str, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` rows of each class: those of the smallest digests of ``key``."""
    ranked = labelled.filter(F.col(label).isin(0, 1)).withColumn("__ql_digest", F.xxhash64(F.lit("sentiment"), key))
    nth = F.row_number().over(Window.partitionBy(label).orderBy("__ql_digest", key))
    return ranked.withColumn("__ql_nth", nth).filter(F.col("__ql_nth") <= most).drop("__ql_digest", "__ql_nth")


def fit_sentiment(labelled: DataFrame, text: str = "clean_title", label: str = "positive", features: int = 1 << 15) -> PipelineModel:
    """A model of ``label`` 1 from labelled texts, which the caller has bounded."""
    rows = labelled.withColumn("__ql_text", F.coalesce(text, F.lit("")))
    stages = [
        RegexTokenizer(inputCol="__ql_text", outputCol="__ql_words", pattern=r"\s+"), HashingTF(inputCol="__ql_words", outputCol="__ql_counts", numFeatures=features), IDF(inputCol="__ql_counts", outputCol="__ql_weights", minDocFreq=2),
        LogisticRegression(featuresCol="__ql_weights", labelCol=label, regParam=0.02, maxIter=50, probabilityCol="__ql_p", predictionCol="__ql_label", rawPredictionCol="__ql_raw"),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_learned(df: DataFrame, model: PipelineModel, text: str = "clean_title") -> DataFrame:
    """``df`` with ``score`` from -100 to 100, in hundredths; a null text is an empty one."""
    found = model.transform(df.withColumn("__ql_text", F.coalesce(text, F.lit(""))))
    p = vector_to_array("__ql_p")
    return found.withColumn("score", F.round(100 * (p[1] - p[0]), 2)).select(*df.columns, "score")
