"""Command lines of the audit's stages: python -m brandloom.plans.cli STAGE ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from brandloom.operators import blocking, collisions, coverage, inventory, products, ranking, roots
from brandloom.sources import tables, terminology


def census(spark: SparkSession, a: argparse.Namespace) -> None:
    source = tables.read_csv(spark, a.csv, tables.PRODUCTS, ("name", "short_composition1"))
    rows = products.parse(source, a.keep_salts, None if a.all_types else "allopathy").persist()  # five tables come from it
    work = products.parsed(rows)
    found = inventory.molecule_inventory(work)
    summary = collisions.root_summary(work)
    tables.write_if_any(products.parse_failures(rows), f"{a.outdir}/parse_failures")
    tables.write_csv(found.orderBy("product_count", ascending=False), f"{a.outdir}/molecules")
    tables.write_csv(inventory.brand_roots_export(work), f"{a.outdir}/brand_roots")
    tables.write_csv(collisions.molecule_collisions(work), f"{a.outdir}/collisions_molecule")
    tables.write_csv(collisions.strength_collisions(summary), f"{a.outdir}/collisions_strength")
    show(products.load_stats(source), products.filter_stats(source), products.parse_stats(rows), inventory.top_molecules(found))
    show(collisions.collision_headline(summary), collisions.worst_roots(work), inventory.namespace_shape(work), inventory.brands_per_composition(work))
    rows.unpersist()


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_csv(spark, a.csv, tables.ROOTS, ("brand_root",))
    tables.write_csv(roots.clean_roots(rows), f"{a.outdir}/brand_roots_clean")
    show(roots.clean_root_stats(rows))


def block(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = products.with_rows(tables.read_csv(spark, a.csv, tables.ROOTS, ("brand_root",)))
    found = blocking.numbered(rows).persist()
    keys = blocking.block_keys(found).persist()
    pairs = blocking.candidate_pairs(keys, a.max_block, include_self_pairs=True)
    tables.write_csv(blocking.named(pairs, found), f"{a.outdir}/candidate_pairs")
    stats = blocking.block_stats(found, keys, a.max_block)
    contribution, large = blocking.pass_contribution(keys, a.max_block), blocking.big_blocks(keys)
    # a row of figures, seven passes and eight blocks
    lines = [f"{k}: {v}" for k, v in stats.first().asDict().items()] + [f"{r['pass']}: {r['pairs']}" for r in contribution.collect()] + [f"{r['size']} {r['pass']}:{r['key']}" for r in large.collect()]
    tables.write_report(lines, spark, f"{a.outdir}/block_report")
    print("\n".join(lines))
    if a.check:
        probe = blocking.recall_probe(tables.read_strings(spark, a.check, ("root_a", "root_b")), found, pairs)
        show(blocking.recall(probe), probe.where("outcome <> 'kept'"))


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    scored, seen = ranking.observed(ranking.score_pairs(tables.read_strings(spark, a.csv, ("root_a", "root_b"))))
    tables.write_csv(scored, f"{a.outdir}/scored_pairs", places=4)
    print(f"{seen.get['pairs']} pairs scored")


def rank(spark: SparkSession, a: argparse.Namespace) -> None:
    scored = tables.read_csv(spark, a.csv, tables.SCORED, ("root_a", "root_b", "jw", "edit_sim"))
    best = ranking.rank(scored, a.top, a.w_jw, a.w_edit, a.no_digits)
    show(ranking.scan_stats(scored, a.no_digits))
    best.show(a.print or a.top, truncate=False)
    if a.out:
        tables.write_csv(best, a.out, places=4, single=True)


def cover(spark: SparkSession, a: argparse.Namespace) -> None:
    found = tables.read_csv(spark, a.csv, tables.MOLECULES, ("molecule",))
    if a.limit:
        found = found.orderBy("product_count", ascending=False).limit(a.limit)
    lookup = tables.read_lookup(spark, a.lookup) if a.lookup else spark.createDataFrame([], tables.LOOKUP)
    if a.service:
        base = a.service
        lookup = terminology.refresh_store(found, f"{a.outdir}/lookup", lambda: terminology.HttpProvider(base), batch=a.batch, lookup=lookup, progress=print)
    mapping = coverage.atc_mapping(found, coverage.deduplicated(lookup.drop("status")))
    tables.write_csv(mapping, f"{a.outdir}/molecules_atc")
    tables.write_csv(coverage.unmapped(mapping), f"{a.outdir}/molecules_no_atc")
    show(coverage.atc_coverage(mapping), coverage.level1_histogram(mapping).orderBy("n", ascending=False), coverage.unmapped_top(mapping))


def short(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = products.with_rows(tables.read_csv(spark, a.csv, tables.COLLISIONS, ("brand_root",)))
    show(roots.short_root_histogram(rows), roots.short_roots(rows, products.ROW), roots.tiny_root_stats(rows), roots.tiny_roots(rows))


def show(*frames: DataFrame) -> None:
    for df in frames:
        df.show(50, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    stages = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, run, *, outdir: bool = True) -> argparse.ArgumentParser:
        s = stages.add_parser(name)
        s.add_argument("csv")
        if outdir:
            s.add_argument("--outdir", default="results")
        s.set_defaults(run=run)
        return s

    s = stage("census", census)
    s.add_argument("--keep-salts", action="store_true")
    s.add_argument("--all-types", action="store_true")
    stage("clean", clean)
    s = stage("block", block)
    s.add_argument("--max-block", type=int, default=0)
    s.add_argument("--check", default="")
    stage("score", score)
    s = stage("rank", rank, outdir=False)
    s.add_argument("--top", type=int, default=50)
    s.add_argument("--w-jw", type=float, default=ranking.W_JW)
    s.add_argument("--w-edit", type=float, default=ranking.W_EDIT)
    s.add_argument("--out", default="")
    s.add_argument("--print", type=int, default=0)
    s.add_argument("--no-digits", action="store_true")
    s = stage("coverage", cover)
    s.add_argument("--lookup", default="")
    s.add_argument("--service", default="", help="base address of the terminology service")
    s.add_argument("--limit", type=int, default=0)
    s.add_argument("--batch", type=int, default=25, help="molecules looked up before the answers are saved")
    stage("short-roots", short, outdir=False)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("brandloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
