"""What molecules and compositions there are, and under how many brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.operators.products import ROW


def molecule_inventory(work: DataFrame) -> DataFrame:
    """(molecule, product_count, example_brand): the first non-null name in row order.

    A molecule that stands twice in a product counts twice.
    """
    rows = work.select(ROW, "name", F.explode("molecules").alias("molecule"))
    return rows.groupBy("molecule").agg(F.count(F.lit(1)).alias("product_count"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col(ROW))).alias("example_brand"))


def top_molecules(inventory: DataFrame, k: int = 10) -> DataFrame:
    return inventory.orderBy(F.desc("product_count"), "molecule").limit(k)


def brand_roots_export(work: DataFrame) -> DataFrame:
    """(brand_root, n_products, compositions): sorted distinct compositions, joined by " | "."""
    return work.groupBy("brand_root").agg(F.count(F.lit(1)).alias("n_products"), F.array_join(F.array_sort(F.collect_set("mol_sig")), " | ").alias("compositions"))


def namespace_shape(work: DataFrame) -> DataFrame:
    """Distinct compositions and roots, and roots per composition."""
    return work.agg(F.countDistinct("mol_sig").alias("n_compositions"), F.countDistinct("brand_root").alias("n_roots")).withColumn(
        "roots_per_composition", F.round(F.col("n_roots") / F.greatest("n_compositions", F.lit(1)), 4)
    )


def brands_per_composition(work: DataFrame, k: int = 10) -> DataFrame:
    return work.groupBy("mol_sig").agg(F.countDistinct("brand_root").alias("n_brands")).orderBy(F.desc("n_brands"), "mol_sig").limit(k)
