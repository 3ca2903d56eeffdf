import random

import duckdb
import pytest

import corpus_pipeline
from brandloom.llm import decontaminate, language_id, queries
from tests.llm.helpers import ODD, documents, prose, row
from tests.llm.test_dedup import plain_groups
from tests.llm.test_decontaminate_pack import check_packed, plain_scan
from tests.llm.test_language_quality import plain_decode, plain_scores

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_stages(spark, tmp_path):
    r = random.Random(6)
    good = [row(i, prose(r, ["en", "de", "fr", "es"][i % 4], r.randint(30, 90)), ["en", "de", "fr", "es"][i % 4]) for i in range(100, 220)]
    item = prose(random.Random(77), "en", 14)
    copies = [row(300 + i, good[i][1] + " end.", good[i][2]) for i in range(10)]
    leaks = [row(400 + i, prose(r, "en", 20) + "\n" + item + "\n" + prose(r, "en", 20), "en") for i in range(5)]
    shout = [row(500 + i, prose(r, "en", 30).upper().replace(" ", "!! "), "en") for i in range(20)]
    rows = good + copies + leaks + shout + ODD
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), f"test-{name}")
        seen.append(name)
        if name == "packing":
            break
        assert docs.columns == columns and docs.exceptAll(before).isEmpty()
        ids = {x["doc_id"] for x in docs.collect()}
        was = before.collect()
        if name == "language_id":
            assert ids.isdisjoint({1, 2, 3, 4}) and ids >= {x[0] for x in good}
            model = language_id.fit(before.where(~language_id.held_out()))
            decoded = [(x["doc_id"], *plain_decode(model, x["text"])) for x in was]
            assert ids == {i for i, name_, first, second in decoded if name_ != "und" and first - second >= model.margin}
        elif name == "quality":
            assert ids.isdisjoint({x[0] for x in shout}) and ids >= {x[0] for x in good}
            _, _, score = plain_scores([x["text"] or "" for x in was])
            assert all(abs(s - 0.4) < 0.002 or (x["doc_id"] in ids) == (s >= 0.4) for x, s in zip(was, score, strict=True))
        elif name == "near_dedup":
            label, _ = plain_groups([tuple(x) for x in was], 5)
            assert ids - {None} == {i for i in label if label[i] == i} and docs.where("doc_id = 7").count() == 1
        elif name == "decontaminate":
            assert ids == {x["doc_id"] for x in was if plain_scan(x["text"], [(1, item)])[1] == 0}
    assert seen == ["language_id", "quality", "near_dedup", "decontaminate", "packing"]
    out = docs.collect()
    check_packed(out, 4096)
    assert {x["doc_id"] for x in out} == ids


def test_run_and_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.WINDOW == 10 and corpus_pipeline.queries().keys() == {"pipeline"}
