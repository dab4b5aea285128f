"""Columns that lambdas refer to, computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns behind a barrier that keeps Spark from inlining them into lambdas.

    A higher-order function evaluates what its lambda refers to for every element; an
    array of one element that is exploded is evaluated once.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df
