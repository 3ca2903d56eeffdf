"""Views that give the driver's tables the shape of product and root tables.

Each is one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names with digits, strength chains, glued and parted units and cut-off forms;
#: compositions with salts, protected inorganics and older spellings. Not every
#: product has a manufacturer.
PRODUCTS_SQL = """
SELECT p_partkey AS row_id,
  CASE p_partkey % 7
    WHEN 0 THEN concat(p_type, ' ', p_name, ' ', cast(p_size AS varchar(10)), 'mg Tablet')
    WHEN 1 THEN concat(p_name, ' 5mg/', cast(p_size AS varchar(10)), 'mg/30mg Tablet SR')
    WHEN 2 THEN concat(p_type, ' ', p_name, ' ', cast(p_size AS varchar(10)), ' mg Syrup')
    WHEN 3 THEN concat(p_name, '-', cast(p_size AS varchar(10)), ' Forte Cap')
    WHEN 4 THEN concat(p_name, cast(p_size AS varchar(10)), ' Dry Syrup (', p_type, ') 100 ml')
    WHEN 5 THEN concat(p_name, ' Sugar Free Oral Drops')
    ELSE concat(p_type, ' ', p_name, ' ', cast(p_size AS varchar(10)), ' Tablet')
  END AS name,
  CASE WHEN p_partkey % 97 = 0 THEN ' '
    WHEN p_partkey % 11 = 1 THEN concat('Acetaminophen (', cast(p_size AS varchar(10)), 'mg)')
    WHEN p_partkey % 11 = 2 THEN concat('Calcium Carbonate (', cast(p_size * 10 AS varchar(10)), 'mg)')
    WHEN p_partkey % 11 = 3 THEN 'Frusemide Sodium (40 mg)'
    WHEN p_partkey % 11 = 4 THEN concat('Ferrous Sulphate (Dried) (', cast(p_size AS varchar(10)), '.5mg/5ml)')
    WHEN p_partkey % 11 = 5 THEN 'Amoxycillin Trihydrate (250mg)'
    ELSE concat(p_name, ' Hydrochloride (', cast(p_size AS varchar(10)), 'mg)') END AS short_composition1,
  CASE WHEN p_partkey % 5 = 0 THEN concat(p_type, ' Sodium (Plain) (', cast(p_size * 2 AS varchar(10)), 'mg/5ml)') END AS short_composition2,
  CASE WHEN p_partkey % 10 = 9 THEN 'ayurveda' ELSE ' Allopathy' END AS type,
  CASE WHEN p_partkey % 4 = 0 THEN 'TRUE' ELSE 'FALSE' END AS Is_discontinued,
  s_name AS manufacturer_name
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 1009
"""

#: Words of the benchmark's texts, in order of appearance, some with a digit behind.
ROOTS_SPARK_SQL = """
SELECT CASE WHEN pos % 9 = 4 THEN concat(word, cast(pos % 10 AS varchar(1))) ELSE word END AS brand_root, item_id * 100000 + pos AS row_id
FROM benchmark LATERAL VIEW posexplode(split(lower(text), '[^a-z]+')) w AS pos, word
WHERE length(word) >= 2
"""
ROOTS_DUCKDB_SQL = """
SELECT CASE WHEN pos % 9 = 4 THEN concat(word, cast(pos % 10 AS varchar)) ELSE word END AS brand_root, item_id * 100000 + pos AS row_id
FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word, unnest(range(len(regexp_split_to_array(lower(text), '[^a-z]+')))) AS pos FROM benchmark)
WHERE length(word) >= 2
"""

#: All words of the documents' texts: at a scale factor of 0.1 as many names as a national register has.
WIDE_SPARK_SQL = """
SELECT word AS brand_root, doc_id * 10000000 + pos AS row_id
FROM documents LATERAL VIEW posexplode(split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) w AS pos, word
WHERE length(word) >= 2
"""
WIDE_DUCKDB_SQL = """
SELECT word AS brand_root, doc_id * 10000000 + pos AS row_id
FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+') AS ws FROM documents))
WHERE length(word) >= 2
"""

#: Pairs as a file may hold them: names that are equal, empty or missing among them.
PAIRS_SQL = """
SELECT p_name AS root_a, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN lower(p_brand) ELSE concat(substring(p_name, 2, 20), 'NA') END AS root_b
FROM part
"""

#: An invented classification of the part names' words, so that no network is needed.
LOOKUP_ROWS = [
    ("amoxicillin", "109", "exact", "J01CA|J01CA|J01CR", "a|b|c"),
    ("blue", "101", "exact", "N02BE|A01AA|N02BE", "one|two|three"),
    ("calcium", "110", "approx:7.0", "A12AA", "d"),
    ("cold", "102", "approx:9.5", "R06AB|J01CA", "four|five"),
    ("economy", "103", "exact", "A02BC|A02BD", "six|seven"),
    ("furosemide", "111", "exact", "C03CA|G01AE", "e|f"),
    ("hot", "104", "approx:0.0", "", ""),
    ("large", "105", "exact", "Q99ZZ", "eight"),
    ("medium", None, "none", "", ""),
    ("new", "106", "exact", "V03AB|V03AC", "nine|ten"),
    ("paracetamol", "112", "exact", "N02BE", "g"),
    ("promo", "107", "exact", "M01AE", "eleven"),
    ("red", None, "none", "", ""),
    ("standard", "108", "approx:12.3", "D07AA|C07AB", "twelve|thirteen"),
]


def _view(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "part", "supplier")
    return spark.sql(PRODUCTS_SQL)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "benchmark")
    return spark.sql(ROOTS_SPARK_SQL)


def wide_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "documents")
    return spark.sql(WIDE_SPARK_SQL)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "part")
    return spark.sql(PAIRS_SQL)


class TableProvider:
    """A terminology service that knows LOOKUP_ROWS, by a molecule's first word; no network."""

    def __init__(self):
        self.rows = {word: row for word, *row in LOOKUP_ROWS}
        self.by_id = {row[0]: row for row in self.rows.values() if row[0]}

    def exact(self, name: str) -> str | None:
        rxcui, method, *_ = self.rows.get(name.split(" ")[0], (None, "none"))
        return json.dumps({"idGroup": {"rxnormId": [rxcui, "0"]} if method == "exact" else {}})

    def approximate(self, name: str) -> str | None:
        rxcui, method, *_ = self.rows.get(name.split(" ")[0], (None, "none"))
        if not method.startswith("approx:"):
            return None
        return json.dumps({"approximateGroup": {"candidate": [{"rxcui": rxcui, "score": method.partition(":")[2]}, {"rxcui": "0", "score": "1"}]}})

    def classes(self, rxcui: str) -> str | None:
        _, _, codes, names = self.by_id[rxcui]
        items = [{"rxclassMinConceptItem": {"classId": c, "className": n}} for c, n in zip(codes.split("|"), names.split("|"), strict=True)]
        return json.dumps({"rxclassDrugInfoList": {"rxclassDrugInfo": items}})


def lookup(inventory: DataFrame) -> DataFrame:
    """The invented classification of an inventory's molecules, by their first words."""
    split = lambda s: s.split("|") if s else []
    rows = [(w, r, m, split(c), split(n)) for w, r, m, c, n in LOOKUP_ROWS]
    known = inventory.sparkSession.createDataFrame(rows, "word string, rxcui string, match_method string, atc_codes array<string>, atc_names array<string>")
    words = inventory.select("molecule", F.split_part("molecule", F.lit(" "), F.lit(1)).alias("word"))
    return words.join(F.broadcast(known), "word").drop("word")  # the rows above


def _sql(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


LOOKUP_SQL = "(VALUES " + ", ".join(f"({', '.join(map(_sql, r))})" for r in LOOKUP_ROWS) + ") AS lookup(word, rxcui, match_method, codes, names)"
