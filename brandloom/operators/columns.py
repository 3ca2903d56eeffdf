"""Schema checks that every stage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has these columns; else ValueError."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing required column(s): {missing}")
    return df


def with_default(df: DataFrame, column: str, value: str | int = "") -> DataFrame:
    """df with a constant column where it has none of this name."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def percent(part, whole):
    """100 * part / whole, by 1 where whole is 0."""
    return 100.0 * part / F.greatest(whole, F.lit(1))
