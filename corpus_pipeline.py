"""A corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents and only drop rows; the last returns the
pieces of the documents left, with their places in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brandloom.llm import decontaminate, language_id, near_dedup, packing, quality
from brandloom.llm.common import read, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or between two languages' codewords.

    Null and empty texts go. Where no row has a language, nothing can be learned
    and all stay. Other columns, nulls in them included, pass through.
    """
    return language_id.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the scorer trained on weak labels rates under its threshold.

    Null and empty texts are rated as texts without words. Repeated rows share
    their fate.
    """
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and 0.8, the least id stays.

    Null and empty texts are linked with nothing and stay; of rows with one id,
    one stays; rows without an id stay.
    """
    return near_dedup.keep_first(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of the benchmark.

    Null and empty texts hold none and stay, as do all with an empty benchmark.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences of 4096.

    Null and empty texts are an end id alone; an empty table gives no row.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned models and packing have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
