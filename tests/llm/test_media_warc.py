import hashlib
import os
import random

import pytest

from brandloom.llm import matroska as mk
from brandloom.llm import warc
from tests.llm.helpers import ODD, documents


@pytest.mark.parametrize("units", [1, 2, 8, 9, 64, 65, 600])
def test_round_trip(units):
    payload = os.urandom(mk.UNIT * units)
    file = mk.mux(payload)
    movie = mk.demux(file)
    assert b"".join(file[p.offset : p.offset + p.size] for p in movie.packets) == payload
    assert [c[2] for c in movie.cues] == movie.clusters and movie.codecs == {1: "A_PCM/INT/LIT"}
    times = [p.timestamp for p in movie.packets]
    assert times == [k * mk.FRAME * 10**9 // mk.RATE for k in range(len(times))]
    assert movie.duration == len(payload) * 10**9 // mk.RATE


@pytest.mark.parametrize("kind", [mk.NO_LACING, mk.XIPH, mk.FIXED, mk.EBML_LACING])
def test_lacing(kind):
    r = random.Random(kind)
    frames = {mk.NO_LACING: [b"abc"], mk.FIXED: [b"abcd"] * 5}.get(kind) or [os.urandom(r.choice([0, 5, 254, 255, 256, 510, 9000, 70000])) for _ in range(9)]
    block = mk.simple_block(300, 7, frames, kind)
    ((_, _, body, end),) = mk.elements(block, 0, len(block))
    track, at = mk.read_size(block, body)
    assert track == 300 and [block[o : o + n] for o, n in mk.frames_of(block, at + 3, end, kind)] == frames


def test_unknown_sizes_and_block_groups():
    block = mk.element(mk.BLOCK, mk.size_bytes(2) + b"\x00\x05\x00" + b"xyz")
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.number(mk.TIMESTAMP, 100) + mk.element(mk.BLOCK_GROUP, block)
    segment = mk.SEGMENT.to_bytes(4, "big") + b"\xff" + mk.element(mk.INFO, mk.number(mk.SCALE, 1000)) + cluster + cluster + mk.element(mk.VOID, b"0")
    movie = mk.demux(mk._HEADER + segment)
    assert [(p.track, p.timestamp, p.size, p.cluster, p.keyframe) for p in movie.packets] == [(2, 105_000, 3, 0, False), (2, 105_000, 3, 1, False)]


def test_broken_files():
    file = mk.mux(bytes(640))
    for bad in (b"", b"\x00" * 20, file[:-1], file[:60], file[10:], b"\xff" * 40):
        with pytest.raises(ValueError):
            mk.demux(bad)


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**40])
def test_sizes(n):
    data = mk.size_bytes(n)
    assert mk.read_size(data, 0) == (n, len(data))


def test_media_columns(spark):
    media = mk.encode(documents(spark, ODD))
    got = {r["doc_id"]: r for r in mk.describe(media).collect()}
    assert mk.describe(media).count() == len(ODD)
    for i, t, *_ in ODD:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
    assert got[1]["media_sha256"] == got[2]["media_sha256"]
    table = mk.packets(media).where("doc_id = 6").orderBy("packet").collect()
    assert sum(p["size"] for p in table) == got[6]["payload_bytes"] and table[-1]["timestamp"] > table[0]["timestamp"]
    assert mk.describe(mk.encode(documents(spark, []))).count() == 0 and mk.packets(media.where("false")).count() == 0


PAGES = [
    (5, "https://www.Example.com:443/b?q=1#x", "<p>same</p>"),
    (3, "http://example.com/a", "<p>same</p>"),
    (9, "http://sub.example.com:8080/", "<p>other</p>"),
    (1, None, None),
    (2, "", ""),
    (-4, "http://[bad", "<p>bad host é</p>"),
    (7, "http://example.com/a", "<p>" + "long " * 50_000 + "</p>"),
    (8, "http://example.com/a b\r\nX: y", "<p>same</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark):
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark)).collect()}
    first = {}
    for i, _, h in sorted(PAGES):
        first.setdefault(h or "", i)
    for i, _, h in PAGES:
        data = (h or "").encode()
        own = first[h or ""]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), warc.digest_of(data))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if own == i else ("revisit", own))
    assert len(got) == len(PAGES)
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages(spark), least_bytes=10_000).collect()}
    assert set(small.values()) == {"response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 4}.example.com/{i % 7}", f"page {i % 11}") for i in range(100)]
    folder = warc.new_path(spark, "warc-test")
    shards = warc.write_index(warc.write_archives(pages(spark, rows), folder), folder)
    wanted = spark.createDataFrame([(warc.line_key(u, i),) for i, u, _ in rows[::9]] + [("zzz",), ("",), (warc.line_key("http://h1.example.com/1", 999),)], "line_key string")
    got = sorted(r["page_id"] for r in warc.lookup(wanted, shards, folder).collect())
    assert got == [i for i, _, _ in rows[::9]]


def test_keys_and_records():
    assert warc.surt("https://www.Example.co.uk/a/b?x=1#f") == "uk,co,example)/a/b?x=1" and warc.surt(None) == ")/"
    assert warc.line_key("u:", -5) < warc.line_key("u:", 3)
    for i in (0, 7, -9, 2**62):
        assert warc.page_of(warc.record_id(i, warc.digest_of(b""))) == i
    record = warc.build_record(4, "http://x/ \r\nEvil: 1", b"payload", None)
    parsed = warc.parse_record(record)
    assert warc.payload_of(parsed) == (7, b"payload") and "evil" not in parsed.headers
    with pytest.raises(ValueError):
        warc.parse_record(record[: len(record) // 2])
    with pytest.raises(ValueError):
        warc.parse_record(b"nothing")


def test_null_page_ids(spark):
    rows = [(None, "http://x/", "same"), (None, "http://x/", "same"), (None, "http://x/", "other"), (None, None, None), (3, "http://x/", "same"), (5, "http://y/", "same")]
    got = warc.round_trip(pages(spark, rows)).collect()
    found = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in got)
    want = [(i or 0, len(h or ""), warc.digest_of((h or "").encode()), "revisit" if i == 5 else "response", 3 if i == 5 else 0) for i, _, h in rows]
    assert found == sorted(want) and [r["page_id"] for r in got].count(None) == 4
    ids = {warc.record_id(i, warc.digest_of((h or "").encode()), u) for i, u, h in rows}
    assert len(ids) == 5 and sum(warc.page_of(x) is None for x in ids) == 3


def test_read_back_is_dealt_out_by_bytes(spark):
    rows = [(i, f"http://h{i % 7}/{i}", random.Random(i).randbytes(1500).hex()) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages)
    parts = got.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(parts) == 3000 and len(parts) > 1 and max(parts) < 2400
    assert warc._tasks(spark, 0, 100) == 1 and warc._tasks(spark, 100 * 1000, 100) == 1000


def test_laces_without_a_size_are_malformed():
    with pytest.raises(ValueError):
        mk.frames_of(b"\x02\xff\x81\x81" + bytes(20), 0, 24, mk.EBML_LACING)


def test_clashing_columns(spark):
    text = spark.createDataFrame([(1, "abc", b"x", "f", 7)], "doc_id long, text string, media binary, feature string, n_bytes int")
    assert [r["n_bytes"] for r in mk.describe(mk.encode(text)).collect()] == [3]
    pages = spark.createDataFrame([(1, "http://x/", "a", "k", "f", 5, "s", 3)], "page_id long, url string, html string, line_key string, file string, offset long, sha1 string, refers_to long")
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.round_trip(pages).collect()] == [(1, 1, None)]
