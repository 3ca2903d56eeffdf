"""Tables in files: CSV at the edges, Parquet between stages, JSON for lookups.

Schemas are explicit; nothing is inferred. Only empty fields are null: texts
such as NA, nan or null stay what they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PRODUCTS = "name string, short_composition1 string, short_composition2 string, type string, Is_discontinued string, manufacturer_name string"
ROOTS = "brand_root string"
PAIRS = "root_a string, root_b string"
SCORED = "root_a string, root_b string, jw double, edit_sim double"
MOLECULES = "molecule string, product_count long, example_brand string"
LOOKUP = "molecule string, rxcui string, match_method string, atc_codes array<string>, atc_names array<string>, status string"
COLLISIONS = "brand_root string, n_distinct_molecule_sets long, composition string, n_products long, example_name string, example_manufacturer string"


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path, samplingRatio=None).columns


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The file's columns that `schema` knows, typed; others are strings.

    A missing required column is a ValueError; columns of the schema that the
    file hasn't got are left out.
    """
    names = header(spark, path)
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing required column(s): {missing}")
    known = {f.name: f.dataType for f in StructType.fromDDL(schema)}
    full = StructType()
    for name in names:
        full = full.add(name, known.get(name, "string"))
    return spark.read.schema(full).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns of a CSV file as strings in which nothing is null."""
    rows = read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns), columns)
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, places: int | None = None, single: bool = False) -> None:
    """Write with a header, even without rows; doubles to `places` decimals, halves to even.

    Outer white space of a text is kept, as everything else in it.
    """
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"} if places is not None else set()
    out = df.select(*(F.bround(c, places).cast(f"decimal(38,{places})").alias(c) if c in doubles else F.col(c) for c in df.columns))
    (out.coalesce(1) if single or out.isEmpty() else out).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only when there is a row; tells whether there was."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def write_report(lines: list[str], spark: SparkSession, path: str) -> None:
    """A short text report, by Spark, so that any file system will do."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOKUP).json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A lookup from one JSON object of molecule -> record."""
    record = "map<string, struct<rxcui:string, match_method:string, atc_codes:array<string>, atc_names:array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", record)).alias("molecule", "r"))
    return whole.select("molecule", "r.*", F.when(F.col("r.match_method") == "none", F.lit("none")).otherwise(F.lit("found")).alias("status"))


def write_lookup(lookup: DataFrame, path: str) -> None:
    """A new snapshot; readers of the old one must have finished."""
    lookup.write.mode("overwrite").json(path)
