"""Scores of candidate pairs, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from brandloom.functions.similarity import edit_similarity, jaro_winkler_similarity
from brandloom.operators.columns import require
from brandloom.session import ship

W_JW, W_EDIT = 0.4, 0.6


def score_pairs(pairs: DataFrame) -> DataFrame:
    """(root_a, root_b, jw, edit_sim), both to four places; equal roots are left out."""
    ship(pairs.sparkSession)
    named = require(pairs, "root_a", "root_b").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("root_a", "root_b")))
    a, b = F.col("root_a"), F.col("root_b")
    return named.where(a != b).select("root_a", "root_b", F.bround(jaro_winkler_similarity(a, b), 4).alias("jw"), F.bround(edit_similarity(a, b), 4).alias("edit_sim"))


def weighted(w_jw: float = W_JW, w_edit: float = W_EDIT) -> Column:
    return w_jw * F.col("jw") + w_edit * F.col("edit_sim")


def without_digits(scored: DataFrame) -> DataFrame:
    digit = r"(?U)\d"
    return scored.where(~F.col("root_a").rlike(digit) & ~F.col("root_b").rlike(digit))


def rank(scored: DataFrame, top: int = 50, w_jw: float = W_JW, w_edit: float = W_EDIT, no_digits: bool = False) -> DataFrame:
    """The `top` pairs by weighted score; equal scores go by root_a, root_b."""
    rows = without_digits(scored) if no_digits else scored
    best = rows.withColumn("score", weighted(w_jw, w_edit)).orderBy(F.desc("score"), "root_a", "root_b").limit(top)
    return best.withColumn("score", F.bround("score", 4))


def observed(scored: DataFrame, name: str = "scored") -> tuple[DataFrame, Observation]:
    """scored, and an Observation that has the number of its pairs once they are written."""
    seen = Observation(name)
    return scored.observe(seen, F.count(F.lit(1)).alias("pairs")), seen


def scan_stats(scored: DataFrame, no_digits: bool = False) -> DataFrame:
    """Pairs scanned, and those that may be ranked."""
    digit = F.col("root_a").rlike(r"(?U)\d") | F.col("root_b").rlike(r"(?U)\d")
    return scored.agg(F.count(F.lit(1)).alias("scanned"), (F.count_if(~digit) if no_digits else F.count(F.lit(1))).alias("eligible"))
