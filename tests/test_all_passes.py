"""Queries by all seven passes against brute force, since SQL has no metaphone, dmeta or nysiis."""

import re
from itertools import combinations

import pytest

from brandloom.functions.phonetic import double_metaphone, metaphone, nysiis
from brandloom.functions.similarity import jaro_winkler
from brandloom.operators import blocking
from brandloom.plans import adapters, catalog

DATA = "/root/testdata/sf0.001"
CODES = {"metaphone": metaphone, "dmeta": double_metaphone, "nysiis": nysiis}


@pytest.fixture(scope="module")
def world(spark):
    """Roots by id, and the ids of each block: native keys as SQL checks them, phonetic ones from the plain functions."""
    roots = {r["id"]: r["root"] for r in blocking.numbered(adapters.roots(spark, DATA)).collect()}
    blocks = {}
    for r in catalog.queries()["block_keys_native"](spark, DATA).collect():
        blocks.setdefault((r["pass"], r["key"]), []).append(r["id"])
    for i, root in roots.items():  # some have a digit, which no key goes by
        letters = re.sub("[^a-z]", "", root)
        for name, code in CODES.items():
            if len(letters) >= 2 and code(letters):
                blocks.setdefault((name, code(letters)), []).append(i)
    pairs = {tuple(sorted(p)) for ids in blocks.values() for p in combinations(ids, 2)}
    return roots, blocks, pairs


def run(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def named(world):
    roots, _, pairs = world
    return {(roots[a], roots[b]) for a, b in pairs if a != b}


def test_the_phonetic_passes_add_pairs(spark, world):
    got = {(r["root_a"], r["root_b"]) for r in run(spark, "score_pairs_all7")}
    assert got == named(world)
    assert got > {(r["root_a"], r["root_b"]) for r in run(spark, "score_pairs")}
    rows = sorted(run(spark, "score_pairs_all7"))
    scores = jaro_winkler([r["root_a"] for r in rows], [r["root_b"] for r in rows])
    assert all(abs(r["jw"] - s) <= 0.000051 for r, s in zip(rows, scores, strict=True))


def test_contribution(spark, world):
    got = {r["pass"]: r["pairs"] for r in run(spark, "pass_contribution_all7")}
    assert got == {p: sum(len(x) * (len(x) - 1) // 2 for (q, _), x in world[1].items() if q == p) for p in blocking.PASSES}


def test_block_sizes(spark, world):
    roots, blocks, pairs = world
    sizes = sorted(len(x) for x in blocks.values() if len(x) > 1)
    (got,) = run(spark, "block_stats_all7")
    assert (got["n_roots"], got["candidates"], got["non_singleton_blocks"], got["largest_block"]) == (len(roots), len(pairs), len(sizes), sizes[-1])
    assert got["median_block"] == sizes[(len(sizes) - 1) // 2]
    big = sorted(((len(x), *k) for k, x in blocks.items() if len(x) > 10), reverse=True)[:8]
    assert [(r["size"], r["pass"], r["key"]) for r in run(spark, "big_blocks_top8_all7")] == big


def test_ranks(spark, world):
    scored = run(spark, "score_pairs_all7")
    plain = [r for r in scored if not re.search("[0-9]", r["root_a"] + r["root_b"])]
    for name, rows, top, jw, edit in (("rank_top50_all7", scored, 50, 0.4, 0.6), ("rank_no_digits_all7", plain, 20, 0.3, 0.7)):
        best = sorted(rows, key=lambda r: (-(jw * r["jw"] + edit * r["edit_sim"]), r["root_a"], r["root_b"]))[:top]
        assert [(r["root_a"], r["root_b"]) for r in run(spark, name)] == [(r["root_a"], r["root_b"]) for r in best]
    assert tuple(run(spark, "scan_stats_all7")[0]) == (len(named(world)), len(plain)) and 0 < len(plain) < len(scored)


def test_probes(spark, world):
    roots, _, pairs = world
    ids = {root: i for i, root in roots.items()}
    for r in run(spark, "recall_probe_all7"):
        a, b = ids.get(r["root_a"]), ids.get(r["root_b"])
        assert r["outcome"] == ("not in roots" if a is None or b is None else "kept" if (min(a, b), max(a, b)) in pairs else "blocked apart")
