"""Product rows: filters, parsed compositions, signatures and brand roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.functions import text
from brandloom.functions.vocabulary import DEFAULT, Vocabulary
from brandloom.operators.columns import percent, require, with_default

ROW = "row_id"


def with_rows(products: DataFrame) -> DataFrame:
    """products with row_id, the order that "first" goes by, where it is missing."""
    return products if ROW in products.columns else products.withColumn(ROW, F.monotonically_increasing_id())


def of_type(products: DataFrame, kind: str | None = "allopathy") -> DataFrame:
    """Rows whose type is `kind`, whatever its case and outer white space; all without the column."""
    if kind is None or "type" not in products.columns:
        return products
    return products.where(F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", "")) == kind)


def load_stats(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("columns", F.lit(",".join(c for c in products.columns if c != ROW)))


def filter_stats(products: DataFrame, kind: str | None = "allopathy") -> DataFrame:
    """Rows kept by of_type, of how many, in percent, and discontinued ones among them."""
    marked = with_default(products, "Is_discontinued")
    kept = F.lit(True) if kind is None or "type" not in products.columns else F.coalesce(F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", "")) == kind, F.lit(False))
    return marked.agg(
        F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("before"), F.count_if(kept & (F.upper(F.col("Is_discontinued").cast("string")) == "TRUE")).alias("discontinued")
    ).withColumn("kept_pct", F.round(percent(F.col("kept"), F.col("before")), 4))


def parse(products: DataFrame, keep_salts: bool = False, kind: str | None = "allopathy", v: Vocabulary = DEFAULT) -> DataFrame:
    """products of one kind plus molecules, mol_sig, full_sig, n_molecules and brand_root.

    Needs name and short_composition1; short_composition2 and
    manufacturer_name are empty where the table has none.
    """
    rows = with_rows(of_type(require(products, "name", "short_composition1"), kind))
    rows = with_default(with_default(rows, "short_composition2"), "manufacturer_name")
    parts = F.filter(
        F.array(text.parse_composition(F.col("short_composition1"), keep_salts, v), text.parse_composition(F.col("short_composition2"), keep_salts, v)), lambda p: p.isNotNull()
    )
    molecules = F.transform(F.col("parts"), lambda p: p["molecule"])
    # the cells are parsed once, below the columns that use them
    return (
        rows.withColumn("parts", parts)
        .select(
            *rows.columns,
            molecules.alias("molecules"),
            text.molecule_signature(molecules).alias("mol_sig"),
            text.full_signature(F.col("parts")).alias("full_sig"),
            F.size("parts").cast("long").alias("n_molecules"),
            text.brand_root(F.col("name"), v).alias("brand_root"),
        )
    )


def parsed(rows: DataFrame) -> DataFrame:
    """The rows with at least one molecule."""
    return rows.where("n_molecules > 0")


def parse_failures(rows: DataFrame) -> DataFrame:
    return rows.where("n_molecules = 0").select("name", "short_composition1", "short_composition2")


def parse_stats(rows: DataFrame) -> DataFrame:
    ok = F.col("n_molecules") > 0
    return rows.agg(
        F.count_if(ok).alias("parsed_ok"), F.count_if(~ok).alias("failures"), F.count_if(F.col("n_molecules") == 1).alias("single"), F.count_if(F.col("n_molecules") == 2).alias("double"), F.count(F.lit(1)).alias("n")
    ).select("parsed_ok", F.round(percent(F.col("parsed_ok"), F.col("n")), 4).alias("parsed_pct"), "failures", "single", "double")
