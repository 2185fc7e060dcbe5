"""Deciding which paths have dynamic keys."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: profile columns a trained classifier sees.
FEATURES = ["datatype_entropy", "key_entropy", "parent_frequency", "num_nested_keys", "depth"]


def entropy_rule(profiles: DataFrame, datatype: int = 1, threshold: float = 1.0) -> DataFrame:
    """Add ``pred``: 1 where the datatype entropy is ``datatype`` and the key entropy exceeds the
    threshold. ``datatype=0`` is the older form of the rule."""
    rule = (F.col("datatype_entropy") == datatype) & (F.col("key_entropy") > threshold)
    return profiles.withColumn("pred", rule.cast("int"))


def true_dynamic_paths(scored: DataFrame) -> DataFrame:
    """Paths predicted dynamic that are dynamic."""
    return scored.filter((F.col("pred") == 1) & (F.col("label") == 1)).select("dataset", "path")


def argmax(scores: Column) -> Column:
    """Position of the highest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fit_key_classifier(labelled: DataFrame, features: list[str] | None = None, label: str = "label") -> PipelineModel:
    """Train a logistic classifier on profile columns."""
    columns = features or FEATURES
    stages = [
        VectorAssembler(inputCols=columns, outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol=label, probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_prediction",
        ),
    ]
    return Pipeline(stages=stages).fit(labelled)


def score(model: PipelineModel, profiles: DataFrame) -> DataFrame:
    """Add ``prob`` (of class 1) and ``pred`` from a trained classifier."""
    scored = model.transform(profiles)
    probabilities = vector_to_array("_probability")
    return (
        scored.withColumn("prob", probabilities[1])
        .withColumn("pred", argmax(probabilities))
        .drop("_features", "_probability", "_raw", "_prediction")
    )
