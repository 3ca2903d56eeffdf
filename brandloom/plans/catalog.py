"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.operators import blocking, collisions, coverage, inventory, products, ranking, roots
from brandloom.plans import adapters
from brandloom.session import scratch_dir
from brandloom.sources import tables, terminology

Query = Callable[[SparkSession, str], DataFrame]
#: Blocks over this size are skipped in the wide search, as its option says.
WIDE_BLOCK = 250
#: Names that each phonetic pass has a published code for.
VECTORS = {
    "metaphone": "catherine katherine peter phone robert smith thumb wright",
    "dmeta": "catherine michael peter phone robert schmidt school smith thomas thumb wright",
    "nysiis": "catherine katherine knight macintosh peter robert smith thompson",
}
PROBES = [("the", "then"), ("the", "nowhere"), ("ing", "tion"), ("er", "ers"), ("that", "this")]


def _parsed(spark: SparkSession, sf_dir: str, keep_salts: bool = False) -> DataFrame:
    return products.parse(adapters.products(spark, sf_dir), keep_salts)


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.parsed(_parsed(spark, sf_dir))


def _of_work(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_work(spark, sf_dir))


def _of_summary(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(collisions.root_summary(_work(spark, sf_dir)))


def _of_inventory(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(inventory.molecule_inventory(_work(spark, sf_dir)))


def _mapping(work: DataFrame) -> DataFrame:
    molecules = inventory.molecule_inventory(work)
    return coverage.atc_mapping(molecules, coverage.deduplicated(adapters.lookup(molecules)))


def _of_mapping(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_mapping(_work(spark, sf_dir)))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("molecules", F.array_join("molecules", "|"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names as roots to clean: they hold digits, units and forms."""
    return adapters.products(spark, sf_dir).select(F.col("name").alias("brand_root")).distinct()


def _keys(spark: SparkSession, sf_dir: str, passes: tuple[str, ...] = blocking.NATIVE) -> tuple[DataFrame, DataFrame]:
    numbered = blocking.numbered(adapters.roots(spark, sf_dir))
    return numbered, blocking.block_keys(numbered, passes)


def _of_keys(f: Callable[[DataFrame], DataFrame], passes: tuple[str, ...] = blocking.NATIVE) -> Query:
    return lambda spark, sf_dir: f(_keys(spark, sf_dir, passes)[1])


def _scored(spark: SparkSession, sf_dir: str, passes: tuple[str, ...] = blocking.NATIVE) -> DataFrame:
    numbered, keys = _keys(spark, sf_dir, passes)
    return ranking.score_pairs(blocking.named(blocking.candidate_pairs(keys), numbered))


def _of_scored(f: Callable[[DataFrame], DataFrame], passes: tuple[str, ...] = blocking.NATIVE) -> Query:
    return lambda spark, sf_dir: f(_scored(spark, sf_dir, passes))


def _as_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = blocking.numbered(adapters.roots(spark, sf_dir))
    return numbered.select(F.col("root").alias("brand_root"), F.col("root").alias("composition"), F.col("root").alias("example_name"), "id")


def _probe(spark: SparkSession, sf_dir: str, passes: tuple[str, ...] = blocking.NATIVE) -> DataFrame:
    numbered, keys = _keys(spark, sf_dir, passes)
    known = spark.createDataFrame(PROBES, "root_a string, root_b string")
    return blocking.recall_probe(known, numbered, blocking.candidate_pairs(keys))


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, keys = _keys(spark, sf_dir)
    return blocking.named(blocking.candidate_pairs(keys), numbered)


def _all7(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, keys = _keys(spark, sf_dir, blocking.PASSES)
    return blocking.named(blocking.candidate_pairs(keys), numbered)


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    numbered = blocking.numbered(adapters.wide_roots(spark, sf_dir))
    return numbered, blocking.block_keys(numbered, blocking.NATIVE)


def _wide_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered, keys = _wide(spark, sf_dir)
    return ranking.score_pairs(blocking.named(blocking.candidate_pairs(keys, WIDE_BLOCK), numbered))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.molecule_inventory(_work(spark, sf_dir))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products written as CSV, read with a schema and parsed."""
    path = f"{scratch_dir(spark)}/products"
    tables.write_csv(adapters.products(spark, sf_dir), path)
    return _flat(products.parse(tables.read_csv(spark, path, f"{tables.PRODUCTS}, row_id long", ("name", "short_composition1"))))


def _scored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs written with four places and read with their types."""
    path = f"{scratch_dir(spark)}/scored"
    tables.write_csv(_scored(spark, sf_dir), path, places=4)
    return tables.read_csv(spark, path, tables.SCORED, ("root_a", "root_b", "jw", "edit_sim"))


def _pairs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as CSV, read as strings in which nothing is null, and scored."""
    path = f"{scratch_dir(spark)}/pairs"
    tables.write_csv(adapters.pairs(spark, sf_dir), path)
    return ranking.score_pairs(tables.read_strings(spark, path, ("root_a", "root_b"))).distinct()


def _conditional_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables with and without a row were written, and the rows that a report has."""
    folder, work = scratch_dir(spark), _work(spark, sf_dir)
    rows = [("failures", tables.write_if_any(products.parse_failures(_parsed(spark, sf_dir)), f"{folder}/failures")), ("nothing", tables.write_if_any(work.where("false"), f"{folder}/nothing"))]
    tables.write_report([f"{name}: {there}" for name, there in rows], spark, f"{folder}/report")
    return spark.read.text(f"{folder}/report")


def _cached_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup from one JSON object of molecule -> record."""
    path, found = f"{scratch_dir(spark)}/cache", _inventory(spark, sf_dir)
    record = F.struct("molecule", F.struct("rxcui", "match_method", "atc_codes", "atc_names"))
    whole = coverage.deduplicated(adapters.lookup(found)).agg(F.to_json(F.map_from_entries(F.collect_list(record)), {"ignoreNullFields": "false"}).alias("value"))
    whole.write.text(path)  # one object, as the file is by its format
    return coverage.atc_mapping(found, tables.read_cache(spark, path).drop("status"))


def _lookup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup written as JSON lines and read back."""
    path, found = f"{scratch_dir(spark)}/lookup", _inventory(spark, sf_dir)
    tables.write_lookup(adapters.lookup(found).withColumn("status", F.lit("found")), path)
    return coverage.atc_mapping(found, coverage.deduplicated(tables.read_lookup(spark, path).drop("status")))


def _enriched_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every molecule asked for at a service, in saved batches, and its JSON answers read."""
    found = _inventory(spark, sf_dir)
    answers = terminology.refresh_store(found, f"{scratch_dir(spark)}/store", adapters.TableProvider)
    return coverage.atc_mapping(found, coverage.deduplicated(answers.drop("status")))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a next look-up would ask for: what it hasn't got, and what failed."""
    found = _inventory(spark, sf_dir)
    known = adapters.lookup(found).withColumn("status", F.when(F.col("match_method") == "none", "failed").otherwise("found"))
    return coverage.not_yet_looked_up(found, known)


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of the molecules with most products."""
    found = _inventory(spark, sf_dir).orderBy(F.desc("product_count"), "molecule").limit(5)
    return coverage.atc_mapping(found, coverage.deduplicated(adapters.lookup(found)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the phonetic passes for names whose codes are published."""
    rows = [(p, name) for p, names in VECTORS.items() for name in names.split()]
    wanted = spark.createDataFrame(rows, "pass string, name string")
    names = wanted.select("name").distinct().select(F.xxhash64("name").alias("id"), F.col("name").alias("root"))
    keys = blocking.block_keys(names, blocking.PHONETIC).join(names, "id").select(F.col("root").alias("name"), "pass", "key")
    return keys.join(wanted, ["name", "pass"], "left_semi").select("name", "pass", "key")


def queries() -> dict[str, Query]:
    return {
        "load_stats": lambda spark, sf_dir: products.load_stats(adapters.products(spark, sf_dir)),
        "filter_stats": lambda spark, sf_dir: products.filter_stats(adapters.products(spark, sf_dir)),
        "parse_products": lambda spark, sf_dir: _flat(_parsed(spark, sf_dir)),
        "parse_products_keep_salts": lambda spark, sf_dir: _flat(_parsed(spark, sf_dir, True)),
        "parse_failures": lambda spark, sf_dir: products.parse_failures(_parsed(spark, sf_dir)),
        "parse_stats": lambda spark, sf_dir: products.parse_stats(_parsed(spark, sf_dir)),
        "molecule_inventory": _of_inventory(lambda x: x),
        "top_molecules": _of_inventory(inventory.top_molecules),
        "brand_root_summary": _of_summary(lambda x: x),
        "brand_roots_export": _of_work(inventory.brand_roots_export),
        "collisions_molecule": _of_work(collisions.molecule_collisions),
        "collisions_strength": _of_summary(collisions.strength_collisions),
        "collision_headline": _of_summary(collisions.collision_headline),
        "worst_roots_top15": _of_work(collisions.worst_roots),
        "namespace_shape": _of_work(inventory.namespace_shape),
        "brands_per_composition_top10": _of_work(inventory.brands_per_composition),
        "clean_roots": lambda spark, sf_dir: roots.clean_roots(_names(spark, sf_dir)),
        "clean_root_stats": lambda spark, sf_dir: roots.clean_root_stats(_names(spark, sf_dir)),
        "short_root_histogram": lambda spark, sf_dir: roots.short_root_histogram(_as_collisions(spark, sf_dir)),
        "short_roots_first40": lambda spark, sf_dir: roots.short_roots(_as_collisions(spark, sf_dir), "id"),
        "tiny_roots": lambda spark, sf_dir: roots.tiny_roots(_as_collisions(spark, sf_dir)),
        "tiny_root_stats": lambda spark, sf_dir: roots.tiny_root_stats(_as_collisions(spark, sf_dir)),
        "block_keys_native": _of_keys(lambda x: x),
        "phonetic_keys": lambda spark, sf_dir: _keys(spark, sf_dir, blocking.PHONETIC)[1],
        "candidate_pairs_native": _native,
        "candidate_pairs_self": _of_keys(lambda k: blocking.candidate_pairs(k, include_self_pairs=True)),
        "candidate_pairs_all7": _all7,
        "candidate_pairs_maxblock": _of_keys(lambda k: blocking.candidate_pairs(k, max_block=12)),
        "pass_contribution": _of_keys(lambda k: blocking.pass_contribution(k, passes=blocking.NATIVE)),
        "block_stats": lambda spark, sf_dir: blocking.block_stats(*_keys(spark, sf_dir)),
        "big_blocks_top8": _of_keys(lambda k: blocking.big_blocks(k, over=10)),
        "recall_probe": _probe,
        "score_pairs": _scored,
        "rank_top50": _of_scored(ranking.rank),
        "rank_no_digits": _of_scored(lambda s: ranking.rank(s, 20, 0.3, 0.7, no_digits=True)),
        "scan_stats": _of_scored(lambda s: ranking.scan_stats(s, no_digits=True)),
        "rank_top0": _of_scored(lambda s: ranking.rank(s, 0)),
        "recall_total": lambda spark, sf_dir: blocking.recall(_probe(spark, sf_dir)),
        "block_stats_maxblock": lambda spark, sf_dir: blocking.block_stats(*_keys(spark, sf_dir), max_block=12),
        "pass_contribution_maxblock": _of_keys(lambda k: blocking.pass_contribution(k, 12, blocking.NATIVE)),
        "score_given_pairs": lambda spark, sf_dir: ranking.score_pairs(adapters.pairs(spark, sf_dir)).distinct(),
        "phonetic_vectors": _vectors,
        # the names of a whole register, all but the largest blocks of them
        "wide_block_stats": lambda spark, sf_dir: blocking.block_stats(*_wide(spark, sf_dir), max_block=WIDE_BLOCK),
        "wide_scan_stats": lambda spark, sf_dir: ranking.scan_stats(_wide_scored(spark, sf_dir)),
        "wide_rank_top50": lambda spark, sf_dir: ranking.rank(_wide_scored(spark, sf_dir)),
        # through files
        "csv_round_trip": _csv_round_trip,
        "scored_round_trip": _scored_round_trip,
        "pairs_round_trip": _pairs_round_trip,
        "conditional_sinks": _conditional_sinks,
        "cached_mapping": _cached_mapping,
        "lookup_round_trip": _lookup_round_trip,
        "enriched_mapping": _enriched_mapping,
        "lookup_missing": _missing,
        "atc_mapping_top5": _limited,
        "atc_coverage_of_nothing": lambda spark, sf_dir: coverage.atc_coverage(_mapping(_work(spark, sf_dir).where("false"))),
        # by all seven passes, three of which SQL can't express; above, what has SQL is by the four native ones
        "pass_contribution_all7": _of_keys(blocking.pass_contribution, blocking.PASSES),
        "block_stats_all7": lambda spark, sf_dir: blocking.block_stats(*_keys(spark, sf_dir, blocking.PASSES)),
        "big_blocks_top8_all7": _of_keys(lambda k: blocking.big_blocks(k, over=10), blocking.PASSES),
        "recall_probe_all7": lambda spark, sf_dir: _probe(spark, sf_dir, blocking.PASSES),
        "score_pairs_all7": lambda spark, sf_dir: _scored(spark, sf_dir, blocking.PASSES),
        "rank_top50_all7": _of_scored(ranking.rank, blocking.PASSES),
        "rank_no_digits_all7": _of_scored(lambda s: ranking.rank(s, 20, 0.3, 0.7, no_digits=True), blocking.PASSES),
        "scan_stats_all7": _of_scored(lambda s: ranking.scan_stats(s, no_digits=True), blocking.PASSES),
        "atc_mapping": _of_mapping(lambda x: x),
        "atc_unmapped": _of_mapping(coverage.unmapped),
        "atc_unmapped_top20": _of_mapping(coverage.unmapped_top),
        "atc_coverage": _of_mapping(coverage.atc_coverage),
        "atc_level1_histogram": _of_mapping(coverage.level1_histogram),
    }
