import json

import pytest

from brandloom.operators import collisions, coverage, inventory, products, roots
from brandloom.sources import tables, terminology
from brandloom.streaming import pairs as stream

ROWS = [
    ("Dolo 500 Tablet", "Paracetamol (500mg)", None, " Allopathy ", "TRUE", None),
    ("Dolo Syrup", "Ibuprofen (100mg/5ml)", "Zinc (10mg)", "allopathy", "FALSE", "second"),
    ("Dolo Forte Tablet", "Paracetamol (650mg)", None, "ALLOPATHY", "true", "third"),
    ("Zinco Tablet", "Zinc (10mg)", "Zinc (10mg)", "allopathy", "FALSE", "fourth"),
    ("Zinco 20 Tablet", "Zinc (20mg)", "Zinc (10mg)", "allopathy", "FALSE", "fifth"),
    ("Blank", " ", None, "allopathy", "FALSE", "sixth"),
    ("Herb", "Neem (1g)", None, "ayurveda", "TRUE", "seventh"),
    ("Untyped", "Neem (1g)", None, None, "TRUE", "eighth"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, f"row_id long, {tables.PRODUCTS}").coalesce(1)


def test_filters_and_parsing(table):
    assert tuple(products.filter_stats(table).first()) == (6, 8, 2, 75.0)
    rows = products.parse(table)
    assert tuple(products.parse_stats(rows).first())[:1] == (5,)
    assert [r["name"] for r in products.parse_failures(rows).collect()] == ["Blank"]
    assert products.parse(table, kind=None).count() == 8
    bare = products.parse(table.select("name", "short_composition1"))
    assert bare.count() == 8 and {r["manufacturer_name"] for r in bare.collect()} == {""}
    with pytest.raises(ValueError, match="short_composition1"):
        products.parse(table.drop("short_composition1"))
    assert products.load_stats(table).first()["n_rows"] == 8


def test_inventory(table):
    work = products.parsed(products.parse(table))
    got = {r["molecule"]: (r["product_count"], r["example_brand"]) for r in inventory.molecule_inventory(work).collect()}
    assert got == {"paracetamol": (2, "Dolo 500 Tablet"), "ibuprofen": (1, "Dolo Syrup"), "zinc": (5, "Dolo Syrup")}
    assert [r["molecule"] for r in inventory.top_molecules(inventory.molecule_inventory(work), 2).collect()] == ["zinc", "paracetamol"]
    export = {r["brand_root"]: r["compositions"] for r in inventory.brand_roots_export(work).collect()}
    assert export == {"dolo": "ibuprofen + zinc | paracetamol", "dolo forte": "paracetamol", "zinco": "zinc + zinc"}
    assert inventory.brands_per_composition(work, 1).first()["mol_sig"] == "paracetamol"


def test_collisions(table):
    work = products.parsed(products.parse(table))
    detail = {r["composition"]: (r["n_products"], r["example_name"], r["example_manufacturer"]) for r in collisions.molecule_collisions(work).collect()}
    assert detail == {"paracetamol": (1, "Dolo 500 Tablet", None), "ibuprofen + zinc": (1, "Dolo Syrup", "second")}
    summary = collisions.root_summary(work)
    assert [r["brand_root"] for r in collisions.strength_collisions(summary).collect()] == ["zinco"]
    head = collisions.collision_headline(summary).first()
    assert (head["n_roots"], head["molecule_roots"], head["products_involved"], head["strength_roots"]) == (3, 1, 2, 1)
    worst = collisions.worst_roots(work, shown=1).first()
    assert (worst["brand_root"], worst["compositions"], worst["n_more"]) == ("dolo", "paracetamol", 1)
    none = work.where("false")
    assert collisions.molecule_collisions(none).count() == 0
    assert collisions.collision_headline(collisions.root_summary(none)).first()["products_involved"] == 0


def test_roots(spark):
    rows = spark.createDataFrame([("amox 1 gm",), ("amox",), ("b1",), (None,), ("nan",)], "brand_root string")
    assert {r["brand_root"] for r in roots.clean_roots(rows).collect()} == {"amox", "nan"}
    stats = roots.clean_root_stats(rows).first()
    assert (stats["n_rows"], stats["changed"], stats["dropped"], stats["distinct_before"], stats["distinct_after"]) == (5, 1, 2, 5, 2)
    short = spark.createDataFrame([("ab", 3), ("abc", 1), ("abcd", 0), (None, 2), ("ab", 9)], "brand_root string, at long")
    assert [r["brand_root"] for r in roots.short_roots(short, "at", k=2).collect()] == ["abc", "ab"]
    assert {(r["is_short"], r["n_roots"]) for r in roots.short_root_histogram(short).collect()} == {(True, 2), (False, 1)}


LOOKUP = [("paracetamol", "1", "exact", ["N02BE", "N02BE", "A01AA"], ["x", "y", "z"]), ("zinc", "2", "approx:9.0", [], [])]


def test_coverage(spark):
    inv = spark.createDataFrame([("paracetamol", 5), ("zinc", 3), ("neem", 2)], "molecule string, product_count long")
    look = spark.createDataFrame(LOOKUP, "molecule string, rxcui string, match_method string, atc_codes array<string>, atc_names array<string>")
    mapping = coverage.atc_mapping(inv, coverage.deduplicated(look))
    got = {r["molecule"]: (r["match_method"], r["n_atc_codes"], r["atc_codes"], r["atc_names"], r["atc_level1"]) for r in mapping.collect()}
    assert got == {"paracetamol": ("exact", 2, "N02BE;A01AA", "x;z", "A;N"), "zinc": ("approx:9.0", 0, "", "", ""), "neem": ("not_attempted", 0, "", "", "")}
    c = coverage.atc_coverage(mapping).first()
    assert (c["attempted"], c["with_rxcui"], c["with_atc"], c["exact"], c["approximate"], c["products_covered"], c["products"]) == (3, 2, 1, 1, 1, 5, 10)
    assert [r["molecule"] for r in coverage.unmapped_top(mapping, 1).collect()] == ["zinc"]
    assert {(r["code"], r["label"]) for r in coverage.level1_histogram(mapping).collect()} == {("A", "alimentary/metabolism"), ("N", "nervous system")}
    empty = coverage.atc_coverage(coverage.atc_mapping(inv.where("false"), look)).first()
    assert empty["attempted"] == 0 and empty["molecule_weighted_pct"] == 0


def test_refresh_lookup(spark):
    class Table:
        """A provider that answers from literals."""

        def exact(self, name):
            if name == "down":
                raise terminology.LookupFailed(name)
            return json.dumps({"idGroup": {"rxnormId": ["7", "8"]} if name == "aspirin" else {}})

        def approximate(self, name):
            return json.dumps({"approximateGroup": {"candidate": [{"rxcui": "9", "score": "x"}] if name == "asprin" else []}}) if name != "lost" else None

        def classes(self, rxcui):
            item = lambda c, n: {"rxclassMinConceptItem": {"classId": c, "className": n}}
            return json.dumps({"rxclassDrugInfoList": {"rxclassDrugInfo": [item("N02BA", "one"), item("", "no"), item("N02BA", "two"), item("B01AC", "three")]}})

    inv = spark.createDataFrame([("aspirin", 5), ("asprin", 4), ("nothing", 3), ("lost", 2), ("down", 1), ("zinc", 9)], "molecule string, product_count long")
    old = spark.createDataFrame([("zinc", "2", "exact", ["A12CB"], ["z"], "found")], tables.LOOKUP)
    got = {r["molecule"]: (r["rxcui"], r["match_method"], r["atc_codes"], r["status"]) for r in terminology.refresh_lookup(inv, old, Table).collect()}
    codes = ["N02BA", "B01AC"]
    assert got == {
        "zinc": ("2", "exact", ["A12CB"], "found"),
        "aspirin": ("7", "exact", codes, "found"),
        "asprin": ("9", "approx:0.0", codes, "found"),
        "nothing": (None, "none", [], "none"),
        "lost": (None, "none", [], "none"),
        "down": (None, "none", [], "failed"),
    }
    assert {r["molecule"] for r in terminology.refresh_lookup(inv, old, Table, limit=2).collect()} == {"zinc", "aspirin"}


class Counting:
    """Answers from literals, writes every question down, and breaks after some."""

    def __init__(self, log, breaks_after=None):
        self.log, self.breaks_after = log, breaks_after

    def exact(self, name):
        with open(self.log, "a") as f:
            f.write(name + "\n")
        if self.breaks_after is not None and sum(1 for _ in open(self.log)) > self.breaks_after:
            raise RuntimeError("the machine went away")
        if name == "m7":
            raise terminology.LookupFailed(name)
        return json.dumps({"idGroup": {"rxnormId": ["1"]}})

    def approximate(self, name):
        raise AssertionError

    def classes(self, rxcui):
        return json.dumps({})


def test_every_molecule_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")
    inv = spark.createDataFrame([(f"m{k}", k) for k in range(5)], "molecule string, product_count long")
    old = spark.createDataFrame([], tables.LOOKUP)
    assert len(terminology.refresh_lookup(inv, old, lambda: Counting(log)).collect()) == 5
    assert sorted(open(log).read().split()) == [f"m{k}" for k in range(5)]


def test_a_broken_run_resumes(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    inv = spark.createDataFrame([(f"m{k}", k) for k in range(40)], "molecule string, product_count long")
    known = spark.createDataFrame([("m3", "9", "exact", ["A"], ["a"], "found")], tables.LOOKUP)
    with pytest.raises(Exception, match="went away"):
        terminology.refresh_store(inv, store, lambda: Counting(log, 25), batch=4, lookup=known)
    before = terminology.read_store(spark, store)
    saved = {r["molecule"] for r in before.collect()}
    assert 10 <= len(saved) <= 25
    first = open(log).read().split()
    open(log, "w").close()
    seen = []
    got = {r["molecule"]: r for r in terminology.refresh_store(inv, store, lambda: Counting(log), batch=4, lookup=known, progress=seen.append).collect()}
    again = open(log).read().split()
    # nothing that was saved is asked for again, but for what failed; nothing is asked for twice
    assert len(again) == len(set(again)) and not set(again) & (saved - {"m7"}) and "m3" not in [*first, *again]
    assert got.keys() == {f"m{k}" for k in range(40)} and got["m3"]["rxcui"] == "9" and got["m7"]["status"] == "failed"
    assert seen[-1]["done"] == seen[-1]["of"] == len(again) and sum(x["failed"] for x in seen) == 1
    open(log, "w").close()
    terminology.refresh_store(inv, store, lambda: Counting(log), batch=4, lookup=known)
    assert open(log).read().split() == ["m7"]


class Session:
    def __init__(self, *codes):
        self.codes, self.seen = list(codes), []

    def get(self, url, **kw):
        self.seen.append((url, kw["params"]))
        code = self.codes.pop(0)
        if code is None:
            raise OSError
        return type("R", (), {"status_code": code, "text": "{}"})()


def test_http_provider():
    make = lambda *codes: terminology.HttpProvider("http://host/", pause=0, wait=0, session=Session(*codes))
    p = make(500, None, 200)
    assert p.exact("x") == "{}" and p.session.seen[0] == ("http://host/rxcui.json", {"name": "x", "search": 1})
    p = make(404, 200)
    assert p.approximate("x") is None and len(p.session.seen) == 1
    with pytest.raises(terminology.LookupFailed):
        make(500, 500, None).classes("1")


def test_files(spark, tmp_path):
    source = tmp_path / "p.csv"
    source.write_text('name,short_composition1,extra\n"A, ""b""",Zinc (10mg),1\nNA,null,\n')
    rows = tables.read_csv(spark, str(source), tables.PRODUCTS, ("name", "short_composition1"))
    assert [tuple(r) for r in rows.collect()] == [('A, "b"', "Zinc (10mg)", "1"), ("NA", "null", None)]
    with pytest.raises(ValueError, match="manufacturer"):
        tables.read_csv(spark, str(source), tables.PRODUCTS, ("manufacturer",))
    scored = spark.createDataFrame([("a", "b", 0.03125, 0.5)], tables.SCORED)
    tables.write_csv(scored, str(tmp_path / "s"), places=4)
    assert tables.read_csv(spark, str(tmp_path / "s"), tables.SCORED).first()["jw"] == 0.0312
    tables.write_csv(scored.where("false"), str(tmp_path / "e"), places=4)
    assert tables.header(spark, str(tmp_path / "e")) == ["root_a", "root_b", "jw", "edit_sim"]
    assert not tables.write_if_any(scored.where("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    (tmp_path / "q.csv").write_text('root_a,root_b\n"",NA\nx,\n')
    assert [tuple(r) for r in tables.read_strings(spark, str(tmp_path / "q.csv"), ("root_a", "root_b")).collect()] == [("", "NA"), ("x", "")]
    (tmp_path / "cache.json").write_text(json.dumps({"zinc": {"rxcui": "1", "match_method": "exact", "atc_codes": ["A"], "atc_names": ["z"]}, "x": {"rxcui": None, "match_method": "none", "atc_codes": [], "atc_names": []}}, indent=1))
    cache = tables.read_cache(spark, str(tmp_path / "cache.json"))
    tables.write_lookup(cache, str(tmp_path / "lookup"))
    assert {(r["molecule"], r["status"], tuple(r["atc_codes"])) for r in tables.read_lookup(spark, str(tmp_path / "lookup")).collect()} == {("zinc", "found", ("A",)), ("x", "none", ())}
    tables.write_report(["one", "two"], spark, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["one", "two"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "pairs"
    first = spark.createDataFrame([("kitten", "sitting"), ("martha", "marhta")], tables.PAIRS)
    second = spark.createDataFrame([("dwayne", "duane"), ("olez", "olex"), ("same", "same")], tables.PAIRS)
    first.coalesce(1).write.parquet(str(folder))
    second.coalesce(1).write.mode("append").parquet(str(folder))
    stream.score_stream(stream.read_pairs(spark, str(folder)), str(tmp_path / "scored"), str(tmp_path / "c1")).awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "scored"))
    assert scored.count() == 4
    stream.top_stream(stream.read_pairs(spark, str(folder)), str(tmp_path / "top"), str(tmp_path / "c2"), top=2).awaitTermination()
    from brandloom.operators.ranking import rank

    want = [(r["root_a"], r["score"]) for r in rank(scored, 2).collect()]
    got = spark.read.parquet(str(tmp_path / "top" / "batch=1")).orderBy("score", ascending=False).collect()
    assert [(r["root_a"], r["score"]) for r in got] == want
