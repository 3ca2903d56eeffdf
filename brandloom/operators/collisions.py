"""Brand roots that are sold with more than one composition or strength."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.operators.columns import percent
from brandloom.operators.products import ROW


def root_summary(work: DataFrame) -> DataFrame:
    return work.groupBy("brand_root").agg(
        F.count(F.lit(1)).alias("n_products"), F.countDistinct("mol_sig").alias("n_distinct_molecule_sets"), F.countDistinct("full_sig").alias("n_distinct_full_sigs")
    )


def molecule_collisions(work: DataFrame) -> DataFrame:
    """A row for each composition of a root with two or more.

    The example is the composition's first row, nulls included. One
    aggregation by (root, composition) feeds both the example and the count of
    compositions, so no root is looked up again.
    """
    detail = work.groupBy("brand_root", F.col("mol_sig").alias("composition")).agg(
        F.count(F.lit(1)).alias("n_products"), F.min_by(F.struct("name", "manufacturer_name"), ROW).alias("first")
    )
    roots = detail.groupBy("brand_root").agg(F.count(F.lit(1)).alias("n_distinct_molecule_sets")).where("n_distinct_molecule_sets >= 2")
    return detail.join(roots, "brand_root").select(
        "brand_root", "n_distinct_molecule_sets", "composition", "n_products", F.col("first.name").alias("example_name"), F.col("first.manufacturer_name").alias("example_manufacturer")
    )


def strength_collisions(summary: DataFrame) -> DataFrame:
    return summary.where("n_distinct_molecule_sets = 1 AND n_distinct_full_sigs >= 2")


def collision_headline(summary: DataFrame) -> DataFrame:
    """Roots with several compositions, the products under them, and strength-only roots."""
    several = F.col("n_distinct_molecule_sets") >= 2
    return summary.agg(
        F.count(F.lit(1)).alias("n_roots"),
        F.count_if(several).alias("molecule_roots"),
        F.coalesce(F.sum(F.when(several, F.col("n_products"))), F.lit(0)).alias("products_involved"),
        F.count_if((F.col("n_distinct_molecule_sets") == 1) & (F.col("n_distinct_full_sigs") >= 2)).alias("strength_roots"),
    ).withColumn("molecule_roots_pct", F.round(percent(F.col("molecule_roots"), F.col("n_roots")), 4))


def worst_roots(work: DataFrame, k: int = 15, shown: int = 5) -> DataFrame:
    """The k roots with most compositions, the first `shown` in row order, and how many more."""
    top = root_summary(work).where("n_distinct_molecule_sets >= 2").orderBy(F.desc("n_distinct_molecule_sets"), "brand_root").limit(k)
    first = work.groupBy("brand_root", "mol_sig").agg(F.min(ROW).alias("at"))
    ordered = first.join(F.broadcast(top.select("brand_root")), "brand_root").groupBy("brand_root").agg(F.array_sort(F.collect_list(F.struct("at", "mol_sig"))).alias("sigs"))
    return top.join(ordered, "brand_root").select(
        "brand_root",
        "n_distinct_molecule_sets",
        "n_products",
        F.array_join(F.transform(F.slice("sigs", 1, shown), lambda s: s["mol_sig"]), " | ").alias("compositions"),
        F.greatest(F.size("sigs") - shown, F.lit(0)).cast("long").alias("n_more"),
    )
