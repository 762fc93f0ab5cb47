"""Scores, precision and recall in the two conventions that evaluation and analysis use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio_or(numerator: Column, denominator: Column, otherwise: float) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(otherwise))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Logistic function that overflows for no argument."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


@F.pandas_udf(T.StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """One decimal, rounded from the binary value as Python does."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def query_seed(seed: int, query_id: Column) -> Column:
    """The first 8 bytes of SHA-256(seed NUL query_id) as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}\0"), query_id).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
