import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brandloom.llm import decontaminate, packing
from tests.llm.helpers import ODD, documents, prose, row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, t in items:
        x = plain_words(t)
        n = min(len(x), 10)
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [
    (1, "The river runs under the bright stone bridge, and nobody in the market sees it!"),
    (2, "under the bright stone bridge and nobody in the market sees it at night"),
    (3, "Straße ÜBER wasser"),
    (4, None),
    (5, "?!"),
    (6, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"),
]
TEXTS = [
    "Intro. the RIVER runs -- under the bright stone bridge and nobody in the market sees it at night, so.",
    "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 no, but x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 yes",
    "x1 x2 x3 x4 x5 x6 x7 x8 x9 nearly",
    "an der straße ÜBER wasser",
    "an der straße über wasser",
    "clean text of no interest",
]


def tables(spark, items=ITEMS, texts=TEXTS):
    return documents(spark, [row(100 + i, t) for i, t in enumerate(texts)] + ODD), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block,hold", [(1 << 20, 1 << 20), (40, 1 << 20), (40, 100), (7, 1)])
def test_scan_equals_brute_force(spark, block, hold):
    docs, benchmark = tables(spark)
    got = decontaminate.scan(docs, benchmark, block_bytes=block, hold_bytes=hold).collect()
    assert len(got) == len(TEXTS) + len(ODD)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == plain_scan(r["text"], ITEMS)
        inside = [w for s in r["spans"] for w in plain_words(r["text"][s["start"] : s["end"]])]
        assert len(inside) == r["n_hit"]


def test_clean_documents_stay(spark):
    docs, benchmark = tables(spark)
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    clean = {100 + i for i, t in enumerate(TEXTS) if not plain_scan(t, ITEMS)[1]}
    assert clean == {102, 104, 105} and {r["doc_id"] for r in kept.collect()} == clean | {x[0] for x in ODD}
    none = benchmark.where("false")
    assert decontaminate.keep_clean(docs, none).count() == docs.count()
    assert decontaminate.scan(docs.where("false"), benchmark).count() == 0
    clash = docs.withColumnRenamed("source", "N_hit").withColumnRenamed("lang", "items")
    assert decontaminate.scan(clash, benchmark).columns.count("n_hit") == 1
    again = decontaminate.keep_clean(clash, benchmark)
    assert again.columns == clash.columns and {x["N_hit"] for x in again.collect()} == {"src"}


def test_one_pass_for_many_blocks(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(5, 60)))) for k in range(200)]
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(50)) + " " + (items[r.randrange(200)][1] if k % 2 else "") for k in range(60)]
    docs, benchmark = tables(spark, items, texts)
    assert decontaminate.write_items(benchmark, block_bytes=500)[1] > 20
    found = decontaminate.scan(docs, benchmark, block_bytes=500, hold_bytes=5000)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for x in found.collect():
        assert (x["n_words"], x["n_hit"], x["items"]) == plain_scan(x["text"], items)


def test_long_and_repeated_items(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(50_000)}" for _ in range(5000)]
    benchmark = spark.createDataFrame([(1, " ".join(words))] * 50 + [(2, " ".join(words[40:47])), (None, "one two three")], "item_id long, text string")
    for piece in (10, 11, 64, 4991, 5000, 1 << 14):
        folder, blocks = decontaminate.write_items(benchmark, piece=piece)
        items = [(x["item"], x["words"].split()) for x in spark.read.parquet(folder).collect()]
        long = [w for i, w in items if i == "1"]
        assert {tuple(w[i : i + 10]) for w in long for i in range(len(w) - 9)} == {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
        assert all(10 <= len(w) <= max(piece, 10) for w in long) and sum(map(len, long)) < 11 * len(words) and blocks == 1 and ("", ["one", "two", "three"]) in items


def lower_bound(lengths, capacity):
    return -(-sum(lengths) // capacity)


def test_best_fit():
    r = random.Random(1)
    lengths = np.array(sorted((r.randint(1, 60) for _ in range(500)), reverse=True))
    b, place, fill = packing.best_fit(lengths, 64)
    assert fill.max() <= 64 and fill.sum() == lengths.sum()
    for k in range(len(fill)):
        mine = np.flatnonzero(b == k)
        assert place[mine].tolist() == [0, *np.cumsum(lengths[mine])[:-1].tolist()]
    # the tightest bin that fits, tried one by one
    free: list[int] = []
    for n in lengths:
        fits = [(f, k) for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(64 - n)
    assert len(free) == len(fill)


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [32, 4096])
def test_packing_round_trip(spark, capacity):
    r = random.Random(2)
    rows = [row(100 + i, prose(r, r.choice(["en", "de", "fr"]), r.randint(1, 60))) for i in range(200)] + ODD
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            own = ids[s : s + capacity]
            key = (i, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = packing.pack(documents(spark, rows).repartition(7), PATH, capacity).collect()
    have = {}
    for x in got:
        key = (x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])
        have[key] = have.get(key, 0) + 1
    assert have == want
    n = check_packed(got, capacity)
    assert n <= lower_bound([x["length"] for x in got], capacity) * 1.02 + 1
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_what_cannot_merge_ends(spark):
    rows = [row(i, "word " * 19) for i in range(40)]  # 20 tokens each, one to a sequence of 32
    got = packing.pack(documents(spark, rows).repartition(9), PATH, 32).collect()
    assert check_packed(got, 32) == 40


def test_ids_of_odd_words():
    ids, tokenizer = packing.Ids(PATH), Tokenizer.from_file(PATH)
    r = random.Random(5)
    texts = ["it's IT'S don't!! <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b İstanbul H̱a 12ab34 a\x1cb x's. ''' ...a.b.. Σας 😀!!"]
    texts += ["".join(r.choices("aB'sSt.,!<|>1é İΣ́\t\n日", k=50)) for _ in range(200)]
    for t, found in zip(texts, ids(pa.array([*texts, "", " x "]).slice(0, len(texts))), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_best_fit_of_counts():
    r = random.Random(6)
    for capacity in (7, 32, 64):
        for _ in range(60):
            counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 12))}
            plan = packing.best_fit_counts(counts, capacity)
            bins: dict[int, list[tuple[int, int]]] = {}
            for n, count in counts.items():
                own = [p for p in plan if p[0] == n]
                for rank in range(count):
                    _, start, first, each, offset = [p for p in own if p[1] <= rank][-1]
                    j = rank - start
                    bins.setdefault(first + j // each, []).append((offset + j % each * n, n))
            for items in bins.values():
                items.sort()
                assert [o for o, _ in items] == [0, *itertools.accumulate(n for _, n in items)][:-1] and sum(n for _, n in items) <= capacity
            least = sorted(sum(n for _, n in items) for items in bins.values())
            assert len(least) < 2 or least[0] + least[1] > capacity
            lengths = np.array(sorted((n for n, c in counts.items() for _ in range(c)), reverse=True))
            assert len(bins) == len(packing.best_fit(lengths, capacity)[2])


def test_sequences_in_many_tasks_all_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER", 16)  # so that what one task takes is small
    few = {40 * k for k in range(8)}
    rows = [row(i, "word " * (10 if i in few else 27)) for i in range(400)]  # 11 or 28 tokens; only the few merge
    got = packing.pack(documents(spark, rows).repartition(20), PATH, 32).collect()
    assert len(got) == 400 and check_packed(got, 32) == 392 + 4
