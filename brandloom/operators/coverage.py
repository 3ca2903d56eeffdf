"""How many molecules, and how much of the products, a classification covers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.functions.text import ordered_unique
from brandloom.operators.columns import percent, require, with_default

# The first level of the anatomical classification.
LEVEL_1 = {
    "A": "alimentary/metabolism",
    "B": "blood",
    "C": "cardiovascular",
    "D": "dermatological",
    "G": "genitourinary",
    "H": "hormones",
    "J": "anti-infectives",
    "L": "antineoplastic/immuno",
    "M": "musculoskeletal",
    "N": "nervous system",
    "P": "antiparasitic",
    "R": "respiratory",
    "S": "sensory organs",
    "V": "various",
}
NOT_ATTEMPTED = "not_attempted"


def deduplicated(lookup: DataFrame) -> DataFrame:
    """lookup with each molecule's codes once, in order, the first name winning."""
    zipped = F.arrays_zip(F.col("atc_codes").alias("code"), F.col("atc_names").alias("label"))
    kept = ordered_unique(F.filter(zipped, lambda p: F.coalesce(p["code"], F.lit("")) != ""), "code")
    return lookup.withColumn("_kept", kept).withColumns({"atc_codes": F.transform("_kept", lambda p: p["code"]), "atc_names": F.transform("_kept", lambda p: p["label"])}).drop("_kept")


def atc_mapping(inventory: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every molecule with its identifier, codes and first-level codes.

    inventory: (molecule, product_count 0 where missing); lookup: (molecule,
    rxcui, match_method, atc_codes, atc_names). A molecule that was never
    looked up is "not_attempted" without codes. Empty tables give no rows.
    """
    rows = with_default(require(inventory, "molecule"), "product_count", 0).select("molecule", F.col("product_count").cast("long").alias("product_count"))
    none = F.array().cast("array<string>")
    codes = F.coalesce("atc_codes", none)
    first = F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.left(c, F.lit(1)))))
    return rows.join(lookup, "molecule", "left").select(
        "molecule",
        "product_count",
        "rxcui",
        F.coalesce("match_method", F.lit(NOT_ATTEMPTED)).alias("match_method"),
        F.size(codes).cast("long").alias("n_atc_codes"),
        F.array_join(codes, ";").alias("atc_codes"),
        F.array_join(F.coalesce("atc_names", none), ";", "").alias("atc_names"),
        F.array_join(first, ";").alias("atc_level1"),
    )


def unmapped(mapping: DataFrame) -> DataFrame:
    return mapping.where("n_atc_codes = 0")


def unmapped_top(mapping: DataFrame, k: int = 20) -> DataFrame:
    return unmapped(mapping).orderBy(F.desc("product_count"), "molecule").limit(k).select("molecule", "product_count")


def atc_coverage(mapping: DataFrame) -> DataFrame:
    """One row of counts and shares.

    The weighted share counts a product once for each of its molecules.
    """
    mapped = F.col("n_atc_codes") > 0
    return (
        mapping.agg(
            F.count(F.lit(1)).alias("attempted"),
            F.count("rxcui").alias("with_rxcui"),
            F.count_if(mapped).alias("with_atc"),
            F.count_if(F.col("match_method") == "exact").alias("exact"),
            F.count_if(F.startswith(F.col("match_method"), F.lit("approx"))).alias("approximate"),
            F.coalesce(F.sum("product_count"), F.lit(0)).alias("products"),
            F.coalesce(F.sum(F.when(mapped, F.col("product_count"))), F.lit(0)).alias("products_covered"),
        )
        .withColumn("rxcui_pct", F.round(percent(F.col("with_rxcui"), F.col("attempted")), 4))
        .withColumn("atc_pct", F.round(percent(F.col("with_atc"), F.col("attempted")), 4))
        .withColumn("molecule_weighted_pct", F.round(percent(F.col("products_covered"), F.col("products")), 4))
    )


def level1_histogram(mapping: DataFrame) -> DataFrame:
    """(code, n, label) of first-level codes; a code without a label has an empty one."""
    labels = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LEVEL_1.items()))
    codes = mapping.where("n_atc_codes > 0").select(F.explode(F.split("atc_level1", ";")).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.coalesce(F.try_element_at(labels, F.col("code")), F.lit("")))


def not_yet_looked_up(inventory: DataFrame, lookup: DataFrame) -> DataFrame:
    """Molecules without a row in the lookup, or whose last look-up failed."""
    done = lookup if "status" not in lookup.columns else lookup.where("status <> 'failed'")
    return inventory.join(done.select("molecule"), "molecule", "left_anti")
