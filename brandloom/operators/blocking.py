"""Candidate pairs of look-alike and sound-alike roots by multi-pass blocking.

Keys are a long table (id, pass, key); blocks are groups of it, pairs its self
join. Ids keep the order of first appearance, so the earlier root of a pair is
always root_a; they need not be dense, so no global numbering is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.functions import phonetic, text
from brandloom.operators.columns import require
from brandloom.session import ship

NATIVE = ("soundex", "prefix4", "suffix4", "del1")
PHONETIC = ("metaphone", "dmeta", "nysiis")
PASSES = (*PHONETIC, *NATIVE)
SKEWED = 1500


def numbered(roots: DataFrame, order: str = "row_id") -> DataFrame:
    """(id, root): distinct non-null roots, by first appearance."""
    return require(roots, "brand_root", order).where("brand_root IS NOT NULL").groupBy(F.col("brand_root").alias("root")).agg(F.min(order).cast("long").alias("id")).select("id", "root")


def block_keys(roots: DataFrame, passes: tuple[str, ...] = PASSES) -> DataFrame:
    """(id, pass, key) of (id, root); a root of under two letters has none.

    Native passes are expressions; phonetic ones run in Arrow batches. A name
    with a run of equal letters gives a del1 key more than once, which is kept.
    """
    rows = roots.select("id", text.letters_only(F.col("root")).alias("s")).where("length(s) >= 2")
    s, n = F.col("s"), F.length("s")
    one = lambda name, key: F.array(F.struct(F.lit(name).alias("pass"), key.alias("key")))
    band = F.floor(n / 3)
    tail = F.right(s, F.lit(4))
    made = {
        "soundex": lambda: one("soundex", F.soundex(s)),
        "prefix4": lambda: one("prefix4", F.substring(s, 1, 4)),
        "suffix4": lambda: F.concat(one("suffix4", F.concat_ws("#", tail, band.cast("string"))), one("suffix4", F.concat_ws("#", tail, (band + 1).cast("string")))),
        "del1": lambda: F.when(
            n.between(3, 14),
            F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("del1").alias("pass"), F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, n)).alias("key"))),
        ).otherwise(F.array().cast("array<struct<pass:string,key:string>>")),
        "metaphone": lambda: one("metaphone", phonetic.metaphone_code(s)),
        "dmeta": lambda: one("dmeta", phonetic.double_metaphone_code(s)),
        "nysiis": lambda: one("nysiis", phonetic.nysiis_code(s)),
    }
    if unknown := [p for p in passes if p not in made]:
        raise ValueError(f"unknown passes: {unknown}")
    if set(passes) & set(PHONETIC):
        ship(roots.sparkSession)
    return rows.select("id", F.inline(F.concat(*(made[p]() for p in passes)))).where("key <> ''")


def blocks(keys: DataFrame) -> DataFrame:
    """(pass, key, size): keys with their rows, repeats of an id included."""
    return keys.groupBy("pass", "key").agg(F.count(F.lit(1)).alias("size"))


def candidate_pairs(keys: DataFrame, max_block: int = 0, include_self_pairs: bool = False) -> DataFrame:
    """(id_a, id_b) distinct, id_a first: ids that share a key in any pass.

    Keys of blocks over `max_block` (0: no limit) are left out before the
    join. With self pairs, an id that has a key twice is paired with itself.
    A block of b rows makes b * b / 2 pairs: that is the search itself. Spark's
    adaptive skew join splits the blocks that are much larger than others.
    """
    held = keys
    if max_block:
        held = keys.join(blocks(keys).where(F.col("size").between(2, max_block)).select("pass", "key"), ["pass", "key"], "left_semi")
    # one shuffle of the keys serves both sides; a key that an id has twice only repeats a pair
    a, b = held.alias("a"), held.alias("b")
    pairs = a.join(b, F.expr("a.pass = b.pass AND a.key = b.key AND a.id < b.id")).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    if include_self_pairs:
        twice = held.groupBy("pass", "key", "id").agg(F.count(F.lit(1)).alias("times")).where("times >= 2")
        pairs = pairs.union(twice.select("id", F.col("id").alias("same")))
    return pairs.distinct()


def named(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_a, root_b) of (id_a, id_b)."""
    side = lambda x: roots.select(F.col("id").alias(f"id_{x}"), F.col("root").alias(f"root_{x}"))
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b").select("root_a", "root_b")


def pass_contribution(keys: DataFrame, max_block: int = 0, passes: tuple[str, ...] = PASSES) -> DataFrame:
    """(pass, pairs) before pairs found twice are dropped, 0 for a pass without any."""
    sized = blocks(keys).where(F.col("size") >= 2)
    if max_block:
        sized = sized.where(F.col("size") <= max_block)
    found = sized.groupBy("pass").agg(F.sum(F.expr("size * (size - 1) div 2")).alias("pairs"))
    wanted = roots_of(keys, passes)
    return wanted.join(found, "pass", "left").select("pass", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"))


def roots_of(keys: DataFrame, passes: tuple[str, ...]) -> DataFrame:
    return keys.sparkSession.createDataFrame([(p,) for p in passes], "pass string")


def block_stats(roots: DataFrame, keys: DataFrame, max_block: int = 0) -> DataFrame:
    """One row: sizes of the search and of its blocks.

    The median is the lower one for an even number of blocks; blocks that
    `max_block` skips still count among the sizes.
    """
    sizes = blocks(keys).where("size > 1").agg(
        F.count(F.lit(1)).alias("non_singleton_blocks"),
        F.max("size").alias("largest_block"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").cast("long").alias("median_block"),
        F.count_if((F.col("size") > max_block) if max_block else F.lit(False)).alias("skipped_blocks"),
    )
    n = roots.agg(F.count(F.lit(1)).alias("n_roots"))
    c = candidate_pairs(keys, max_block, include_self_pairs=True).agg(F.count(F.lit(1)).alias("candidates"))
    # three tables of one row each
    every = F.expr("n_roots * (n_roots - 1) div 2")
    return (
        n.join(c, F.lit(True)).join(sizes, F.lit(True)).withColumn("all_pairs", every)
        .withColumn("reduction_pct", F.when(F.col("all_pairs") > 0, F.round(100 * (1 - F.col("candidates") / F.col("all_pairs")), 6)).otherwise(F.lit(0.0)))
        .withColumn("per_root", F.round(2 * F.col("candidates") / F.greatest("n_roots", F.lit(1)), 4))
    )


def big_blocks(keys: DataFrame, over: int = SKEWED, k: int = 8) -> DataFrame:
    return blocks(keys).where(F.col("size") > over).orderBy(F.desc("size"), F.desc("pass"), F.desc("key")).limit(k)


def recall_probe(known: DataFrame, roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """known (root_a, root_b) plus outcome: kept, blocked apart, or not in roots."""
    side = lambda x: roots.select(F.col("id").alias(f"id_{x}"), F.col("root").alias(f"root_{x}"))
    ids = known.join(side("a"), "root_a", "left").join(side("b"), "root_b", "left")
    ids = ids.withColumn("lo", F.when(F.col("id_a").isNotNull() & F.col("id_b").isNotNull(), F.least("id_a", "id_b"))).withColumn("hi", F.greatest("id_a", "id_b"))
    found = pairs.select(F.col("id_a").alias("lo"), F.col("id_b").alias("hi"), F.lit(True).alias("found"))
    outcome = F.when(F.col("lo").isNull(), "not in roots").when(F.col("found"), "kept").otherwise("blocked apart")
    return ids.join(found, ["lo", "hi"], "left").select("root_a", "root_b", outcome.alias("outcome"))


def recall(probe: DataFrame) -> DataFrame:
    return probe.agg(F.count_if(F.col("outcome") == "kept").alias("kept"), F.count(F.lit(1)).alias("known"))
