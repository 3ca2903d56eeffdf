"""Roots for blocking, and checks of short ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.functions import text
from brandloom.functions.vocabulary import DEFAULT, Vocabulary
from brandloom.operators.columns import percent, require

LEAST_LETTERS = 3


def cleaned(roots: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """roots plus clean_root and whether it has letters enough to be kept."""
    before = F.coalesce(F.col("brand_root"), F.lit(""))
    rows = require(roots, "brand_root").withColumn("before", before).withColumn("clean_root", text.clean_root(F.col("before"), v))
    return rows.withColumn("keep", F.length(text.letters_only(F.col("clean_root"))) >= LEAST_LETTERS)


def clean_roots(roots: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """(brand_root): the distinct cleaned roots that are kept."""
    return cleaned(roots, v).where("keep").select(F.col("clean_root").alias("brand_root")).distinct()


def clean_root_stats(roots: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    return (
        cleaned(roots, v)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("clean_root") != F.col("before")).alias("changed"),
            F.count_if(~F.col("keep")).alias("dropped"),
            F.countDistinct("before").alias("distinct_before"),
            F.countDistinct(F.when(F.col("keep"), F.col("clean_root"))).alias("distinct_after"),
        )
        .select("n_rows", "changed", F.round(percent(F.col("changed"), F.col("n_rows")), 4).alias("changed_pct"), "dropped", "distinct_before", "distinct_after", (F.col("distinct_before") - F.col("distinct_after")).alias("fewer"))
    )


def short_root_histogram(collisions: DataFrame, under: int = 4) -> DataFrame:
    """(is_short, n_roots): distinct roots under and from a length on; a null is not short."""
    return collisions.groupBy(F.coalesce(F.length("brand_root") < under, F.lit(False)).alias("is_short")).agg(F.countDistinct("brand_root").alias("n_roots"))


def short_roots(collisions: DataFrame, order: str, under: int = 4, k: int = 40) -> DataFrame:
    """The first k distinct short roots by a column of order."""
    first = collisions.where(F.length("brand_root") < under).groupBy("brand_root").agg(F.min(order).alias("at"))
    return first.orderBy("at", "brand_root").limit(k).select("brand_root")


def tiny_roots(collisions: DataFrame, most: int = 2) -> DataFrame:
    return collisions.where(F.length("brand_root") <= most).select("brand_root", "composition", "example_name")


def tiny_root_stats(collisions: DataFrame, most: int = 2) -> DataFrame:
    return tiny_roots(collisions, most).agg(F.countDistinct("brand_root").alias("n_roots"), F.count(F.lit(1)).alias("n_rows"))
