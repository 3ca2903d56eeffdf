from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brandloom.functions.phonetic import double_metaphone, metaphone, nysiis
from brandloom.operators import blocking, ranking


def keys_of(spark, names, passes=blocking.NATIVE):
    roots = spark.createDataFrame(list(enumerate(names)), "id long, root string")
    return roots, blocking.block_keys(roots, passes)


def keys_by_name(spark, names):
    _, keys = keys_of(spark, names)
    out = {n: {} for n in names}
    for r in keys.collect():
        out[names[r["id"]]].setdefault(r["pass"], []).append(r["key"])
    return out


def test_keys(spark):
    got = keys_by_name(spark, ["olez-d", "aab", "a", "ab", "abcdefghijklmno", "dopamine", "dobutamine", ""])
    assert got["olez-d"]["prefix4"] == ["olez"]
    assert sorted(got["olez-d"]["suffix4"]) == ["lezd#1", "lezd#2"]
    assert got["olez-d"]["del1"] == ["lezd", "oezd", "olzd", "oled", "olez"]
    assert got["aab"]["del1"] == ["ab", "ab", "aa"]
    assert got["a"] == got[""] == {}
    assert sorted(got["ab"]["suffix4"]) == ["ab#0", "ab#1"] and "del1" not in got["ab"]
    assert "del1" not in got["abcdefghijklmno"]
    assert set(got["dopamine"]["suffix4"]) & set(got["dobutamine"]["suffix4"]) == {"mine#3"}


@pytest.mark.parametrize(("name", "code"), [("robert", "R163"), ("ashcraft", "A261"), ("tymczak", "T522"), ("pfister", "P236"), ("honeyman", "H555"), ("lloyd", "L300"), ("gutierrez", "G362")])
def test_soundex(spark, name, code):
    assert keys_by_name(spark, [name])[name]["soundex"] == [code]


def test_phonetic_codes():
    assert metaphone("thumb") == "0M" and metaphone("phone") == "FN" and metaphone("wright") == "RT"
    assert double_metaphone("smith") == "SM0" and double_metaphone("knight") == "NT" and double_metaphone("school") == "SKL"
    assert nysiis("macintosh") == "MCANT" and nysiis("knight") == "NAGT"
    assert metaphone("") == double_metaphone("") == nysiis("") == ""


def test_pairs_equal_brute_force(spark):
    names = ["olez", "olex", "olezd", "aab", "azithral", "azithrel", "dopamine", "dobutamine", "zzz", "olez"]
    _, keys = keys_of(spark, names)
    blocks = {}
    for r in keys.collect():
        blocks.setdefault((r["pass"], r["key"]), []).append(r["id"])
    every = {tuple(sorted(p)) for ids in blocks.values() for p in combinations(ids, 2)}
    got = {(r["id_a"], r["id_b"]) for r in blocking.candidate_pairs(keys, include_self_pairs=True).collect()}
    assert got == every and any(a == b for a, b in every)
    plain = {(r["id_a"], r["id_b"]) for r in blocking.candidate_pairs(keys).collect()}
    assert plain == {p for p in every if p[0] < p[1]}
    small = {tuple(sorted(p)) for ids in blocks.values() if len(ids) <= 2 for p in combinations(ids, 2) if p[0] != p[1]}
    assert {(r["id_a"], r["id_b"]) for r in blocking.candidate_pairs(keys, max_block=2).collect()} == small
    sizes = sorted((len(x) for x in blocks.values() if len(x) > 1), reverse=True)
    roots, keys = keys_of(spark, names)
    stats = blocking.block_stats(roots, keys, max_block=2).first()
    assert (stats["n_roots"], stats["all_pairs"], stats["non_singleton_blocks"], stats["largest_block"], stats["median_block"]) == (10, 45, len(sizes), sizes[0], sizes[len(sizes) // 2])
    assert stats["skipped_blocks"] == sum(s > 2 for s in sizes)
    got = {r["pass"]: r["pairs"] for r in blocking.pass_contribution(keys, passes=blocking.NATIVE).collect()}
    assert got == {p: sum(len(x) * (len(x) - 1) // 2 for (q, _), x in blocks.items() if q == p) for p in blocking.NATIVE}


def test_numbering_keeps_the_first_appearance(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "brand_root string, row_id long")
    assert {(r["id"], r["root"]) for r in blocking.numbered(rows).collect()} == {(1, "b"), (2, "a")}
    with pytest.raises(ValueError, match="brand_root"):
        blocking.numbered(rows.drop("brand_root"))


def test_recall_probe(spark):
    roots, keys = keys_of(spark, ["olez", "olex", "zzzzz"])
    known = spark.createDataFrame([("olex", "olez"), ("olez", "zzzzz"), ("olez", "nowhere")], "root_a string, root_b string")
    probe = blocking.recall_probe(known, roots, blocking.candidate_pairs(keys))
    assert {(r["root_b"], r["outcome"]) for r in probe.collect()} == {("olez", "kept"), ("zzzzz", "blocked apart"), ("nowhere", "not in roots")}
    assert tuple(blocking.recall(probe).first()) == (1, 3)


def test_scores(spark):
    pairs = spark.createDataFrame([("kitten", "sitting"), ("martha", "marhta"), ("dwayne", "duane"), ("abcd", "abxyzq"), ("ab", "ba"), ("same", "same"), (None, "x")], "root_a string, root_b string")
    got = {r["root_a"]: (r["jw"], r["edit_sim"]) for r in ranking.score_pairs(pairs).collect()}
    assert got["kitten"][1] == 0.5714 and got["martha"][0] == 0.9611 and got["dwayne"][0] == 0.84
    assert got["abcd"][0] == 0.6111 and got["ab"][0] == 0.0 and "same" not in got and got[""] == (0.0, 0.0)


def test_ranking(spark):
    rows = [("a", "b", 0.9, 0.8), ("c", "d", 0.9, 0.8), ("b", "c", 0.9, 0.8), ("x1", "y", 1.0, 1.0)]
    scored = spark.createDataFrame(rows, "root_a string, root_b string, jw double, edit_sim double")
    best = ranking.rank(scored, 2, no_digits=True).collect()
    assert [(r["root_a"], r["score"]) for r in best] == [("a", 0.84), ("b", 0.84)]
    assert ranking.rank(scored, 0).count() == 0 and ranking.rank(scored, 1).first()["root_a"] == "x1"
    assert tuple(ranking.scan_stats(scored, no_digits=True).first()) == (4, 3)


def test_observed(spark):
    scored = spark.createDataFrame([("a", "b", 0.9, 0.8)] * 3, "root_a string, root_b string, jw double, edit_sim double")
    rows, seen = ranking.observed(scored)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"pairs": 3}


def test_substitutions_share_a_key(spark):
    names = ["abcdefgh"] + ["abcdefgh"[:i] + "z" + "abcdefgh"[i + 1 :] for i in range(8)]
    _, keys = keys_of(spark, names)
    pairs = blocking.candidate_pairs(keys).where("id_a = 0").select(F.col("id_b"))
    assert {r["id_b"] for r in pairs.collect()} == set(range(1, 9))
