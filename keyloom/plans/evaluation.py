"""How well dynamic keys are found, and how much smaller schemas become."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keyloom.operators import classify, metrics, nest


def entropy_report(labelled: DataFrame, datatype: int = 1, threshold: float = 1.0) -> DataFrame:
    """Classification report of the entropy rule on labelled profiles."""
    return metrics.classification_report(classify.entropy_rule(labelled, datatype, threshold))


def abstraction_report(keys: DataFrame, scored: DataFrame, keep_keys: bool = False) -> DataFrame:
    """Schema sizes per dataset before and after abstracting the correctly found dynamic paths.

    ``keys`` are materialized key statistics of the same datasets as ``scored``.
    """
    dynamic = classify.true_dynamic_paths(scored)
    original = nest.schema_lines(nest.nest_schema(keys))
    abstracted = nest.schema_lines(nest.nest_schema(keys, dynamic, keep_keys))
    return nest.schema_sizes(original, abstracted)
