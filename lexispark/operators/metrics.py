"""Citation metrics over sets, in the evaluation and the analysis convention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import harmonic, ratio_or


def _set(c: str) -> Column:
    return F.coalesce(F.array_distinct(c), F.array().cast("array<string>"))


def confusion(df: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Adds tp, fp and fn of two citation arrays."""
    p, g = _set(predicted), _set(gold)
    return df.withColumns({"tp": F.size(F.array_intersect(p, g)).cast("long"), "fp": F.size(F.array_except(p, g)).cast("long"), "fn": F.size(F.array_except(g, p)).cast("long")})


def evaluation_scores(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; an empty denominator gives 0."""
    p, r = ratio_or(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), ratio_or(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def per_query(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Metrics of every gold query; a query without prediction counts as empty.

    gold: (query_id, gold array); predictions: (query_id, predicted array).
    """
    return evaluation_scores(confusion(gold.join(predictions.select("query_id", "predicted"), "query_id", "left"))).drop("gold", "predicted")


def macro(metrics: DataFrame) -> DataFrame:
    """Unweighted means and summed counts over all queries; 0 without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return metrics.agg(F.count(F.lit(1)).alias("queries"), mean("precision"), mean("recall"), mean("f1"), total("tp"), total("fp"), total("fn"))


def analysis_precision(gold: str, predicted: str) -> Column:
    """Precision; 1 if both sets are empty."""
    p, g = _set(predicted), _set(gold)
    return F.when(F.size(p) == 0, F.when(F.size(g) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(p, g)).cast("double") / F.size(p))


def analysis_recall(gold: str, predicted: str) -> Column:
    """Recall; 1 if the gold set is empty."""
    p, g = _set(predicted), _set(gold)
    return ratio_or(F.size(F.array_intersect(p, g)), F.size(g), 1.0)


def context_precision(gold: str, context: Column) -> Column:
    """Share of a ranked context that is gold; an empty context is right only if nothing is gold."""
    g = _set(gold)
    return F.when(F.size(context) == 0, F.when(F.size(g) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(g, context)).cast("double") / F.size(context))


def faithfulness(context: Column, predicted: str) -> Column:
    """Share of the predictions that the context holds; 1 without predictions."""
    p = F.col(predicted)
    return ratio_or(F.size(F.array_intersect(context, p)), F.size(p), 1.0)


def strict_mean(df: DataFrame, column: str) -> float:
    """The mean of a column; an empty table is an error."""
    found = df.agg(F.avg(column)).first()[0]
    if found is None:
        raise ValueError(f"no values in {column}")
    return found
