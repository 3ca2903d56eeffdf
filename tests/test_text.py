import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brandloom.functions import text
from brandloom.functions.vocabulary import DEFAULT

CELLS = [
    ("Amoxycillin (500mg)", False, ("amoxicillin", "500mg")),
    ("Progesterone (Natural Micronized) (25mg)", False, ("progesterone", "25mg")),
    ("Doxorubicin (Plain) (50mg)", False, ("doxorubicin", "50mg")),
    ("Chlorpheniramine Maleate (4mg)", False, ("chlorphenamine", "4mg")),
    ("Chlorpheniramine Maleate (4mg)", True, ("chlorpheniramine maleate", "4mg")),
    ("Calcium Carbonate (500mg)", False, ("calcium carbonate", "500mg")),
    ("Calcium (500mg)", False, ("calcium", "500mg")),
    ("Ferrous Sulphate (10mg)", False, ("ferrous sulphate", "10mg")),
    ("Ferrous Sulfate (10mg)", False, ("ferrous sulfate", "10mg")),
    ("Thyroxine Sodium (100 mcg)", False, ("levothyroxine", "100mcg")),
    ("Thyroxine Sodium (100 mcg)", False, ("levothyroxine", "100mcg")),
    ("Diclofenac Sodium (1% w/w)", False, ("diclofenac", "")),
    ("Ambroxol (0.5mg/ml)", False, ("ambroxol", "")),
    ("Ambroxol (30MG/5ml)", False, ("ambroxol", "30mg/5ml")),
    ("(500mg)", False, None),
    ("  ", False, None),
    (None, False, None),
]
ROOTS = [
    ("Azithral 500 Tablet", "azithral"),
    ("Ascoril LS Syrup", "ascoril ls"),
    ("Augmentin 625 Duo Tablet", "augmentin 625 duo"),
    ("Oral Rehydration Powder", "oral rehydration"),
    ("Zincovit Syrup Sugar Free", "zincovit"),
    ("Betnovate 0.1% Cream", "betnovate"),
    ("Dolo-650 Tablet", "dolo-650"),
    ("Tablet", "tablet"),
    (None, ""),
]
CLEANED = [
    ("amox 1 gm", "amox"),
    ("abc 5mg/500mg/30mg", "abc"),
    ("b12", "b12"),
    ("vitamin b12", "vitamin"),
    ("b12 so", "b12"),
    ("calpol so tablet", "calpol so"),
    ("calpol 500 so", "calpol"),
    ("ascoril ls", "ascoril"),
    ("augmentin 625 duo", "augmentin 625 duo"),
    ("foo 5 lotion", "foo"),
    ("5mg/500mg", " "),
    (None, ""),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("keep", [False, True])
def test_cells(spark, keep):
    cases = [c for c in CELLS if c[1] == keep]
    got = column(spark, [c[0] for c in cases], lambda x: text.parse_composition(x, keep))
    assert [tuple(g) if g else None for g in got] == [c[2] for c in cases]


def test_brand_roots(spark):
    assert column(spark, [a for a, _ in ROOTS], text.brand_root) == [b for _, b in ROOTS]


def test_clean_roots(spark):
    assert column(spark, [a for a, _ in CLEANED], text.clean_root) == [b for _, b in CLEANED]


def test_strengths(spark):
    good = "500mg 30mg/5ml 10meq 12/5 625 0.1% 1w/w".split()
    bad = "1gm 0.5mg/ml 1%w/w 5million 1,000iu .5mg 10mg+5mg".split()
    got = column(spark, [f"x ({s})" for s in good + bad], lambda c: text.parse_composition(c)["strength"])
    assert got == good + [""] * len(bad)
    assert column(spark, ["30 MG / 5 ml", None], text.normalise_strength) == ["30mg/5ml", ""]


def test_signatures(spark):
    rows = spark.sql("SELECT array(named_struct('molecule','zinc','strength','10mg'), named_struct('molecule','iron','strength','')) AS p")
    got = rows.select(text.full_signature(F.col("p")).alias("f"), text.molecule_signature(F.transform("p", lambda x: x["molecule"])).alias("m")).first()
    assert (got["f"], got["m"]) == ("iron@ + zinc@10mg", "iron + zinc")


def loop_root(name):
    """The tail strip as a plain loop."""
    s = re.sub(r"[^a-z0-9\s\-/+.]", " ", name.lower().strip())
    kept = s.split()
    while kept and (kept[-1] in DEFAULT.forms or re.match("(?i)" + DEFAULT.strength, kept[-1])):
        kept = kept[:-1]
    return " ".join(kept) or s


def loop_clean(tokens):
    """The cleaner's rules on tokens, dropping one at a time from the end."""
    words = {*DEFAULT.forms, *DEFAULT.more_forms, *DEFAULT.modifiers}
    soft = lambda t: t in words or re.match("(?i)" + DEFAULT.cleaner_strength, t)
    kept = list(tokens)
    while kept:
        last, many = kept[-1], len(kept) > 1
        digit = lambda t: many and any(c.isdigit() for c in t)  # noqa: E731, B023
        short = many and last.isalpha() and len(last) <= 2 and (soft(kept[-2]) or digit(kept[-2]))
        if not (soft(last) or digit(last) or short):
            break
        kept.pop()
    return " ".join(kept)


TOKENS = st.lists(st.sampled_from(["amox", "b12", "500mg", "so", "p", "tablet", "forte", "duo", "5", "x-2", "vitamin"]), min_size=1, max_size=7)


@settings(max_examples=3, deadline=None)
@given(st.lists(TOKENS, min_size=60, max_size=60))
def test_tail_strips_equal_plain_loops(spark, names):
    plain = [" ".join(t) for t in names]
    assert column(spark, plain, text.brand_root) == [loop_root(x) for x in plain]
    # amounts next to each other may be glued or chained first, so tokens are taken after that
    glued = [re.sub(DEFAULT.chain, " ", re.sub(DEFAULT.glue, r"\1\2", x)) for x in plain]
    assert column(spark, plain, text.clean_root) == [loop_clean(g.split()) or g for g in glued]


def test_ordered_unique(spark):
    rows = spark.sql("SELECT array(named_struct('code','b','label','1'), named_struct('code','a','label','2'), named_struct('code','b','label','3')) AS p")
    got = rows.select(text.ordered_unique(F.col("p"), "code").alias("u")).first()["u"]
    assert [(x["code"], x["label"]) for x in got] == [("b", "1"), ("a", "2")]
