"""Convergence model over spread features (logistic regression on standardised columns)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossquote.functions.pricing import convergence_heuristic
from crossquote.operators.series import FEATURE_COLUMNS, convergence_labels, running_features

MIN_ROWS = 10        # fixed value
INVERSE_PENALTY = 1.0  # fixed value


def training_rows(spreads: DataFrame) -> DataFrame:
    """Features at every point joined with its look-ahead label."""
    labels = convergence_labels(spreads).select("pair_id", "hour", "label")
    return running_features(spreads).join(labels, ["pair_id", "hour"])


def fit(rows: DataFrame) -> PipelineModel | None:
    """Fitted pipeline, or None when there are too few rows or only one class."""
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if n < MIN_ROWS or not 0 < (ones or 0) < n:
        return None
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol="label", maxIter=1000, standardization=False,
                           regParam=1.0 / (INVERSE_PENALTY * n), elasticNetParam=0.0,
                           probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y"),
    ]).fit(rows)


def predictor(model: PipelineModel | None) -> Callable[[DataFrame], DataFrame]:
    """Adds ``base_probability`` to feature rows: the model's, or the rule heuristic without one."""
    def predict(df: DataFrame) -> DataFrame:
        if model is None:
            return df.withColumn("base_probability", convergence_heuristic(*[
                F.col(c) for c in ("current_spread", "velocity", "z_score", "days_to_close", "volume_ratio")]))
        scored = model.transform(df)
        return scored.withColumn("base_probability", vector_to_array("_p")[1]).drop(
            "_raw", "_x", "_p", "_r", "_y")
    return predict
