import math
import random

import numpy as np
import pyarrow as pa
import pytest

from brandloom.llm import language_id, quality
from brandloom.llm.common import read
from tests.llm.helpers import ODD, WORDS, documents, prose, row


def corpus(n=240):
    r = random.Random(4)
    return [row(i, prose(r, lang, r.randint(8, 120)), lang) for i, lang in zip(range(100, 100 + n), list(WORDS) * n, strict=False)]


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 6, 7, 8, 9, 40, 128):
        code = language_id.codewords(n)
        columns = {tuple(c * c[0]) for c in code.T}
        assert len(columns) == code.shape[1] and all(len(set(c)) == 2 for c in columns)  # distinct, not even opposite, none constant
        least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert least == language_id.distance(code) and least >= {2: 1, 3: 2}.get(n, 4)
    assert language_id.codewords(1).shape == (1, 0)


LETTERS = {"en": "the of and with from", "de": "der und nicht über straße", "fr": "le des être déjà garçon", "es": "el niño señal años mañana", "it": "gli perché della città più", "pl": "się który żeby łódź będzie", "cs": "který není však při řeka"}


def trained(names, words=400):
    texts = [prose(random.Random(k), lang, words) if lang in WORDS else " ".join(random.Random(k).choices(LETTERS[lang].split(), k=words)) for k, lang in enumerate(names)]
    counts = np.stack([np.bincount(language_id.grams(pa.array([t]))[0], minlength=language_id.BUCKETS) for t in texts]).astype(float)
    return language_id.model_of(names, counts, 0.0, 0.5), texts


@pytest.mark.parametrize("names", [sorted(WORDS), sorted(LETTERS), sorted(LETTERS)[:5]])
def test_a_wrong_bit_is_corrected(names):
    model, texts = trained(names)
    assert language_id.decode(model, pa.array(texts))[0] == names
    for bit in range(model.code.shape[1]):
        # every copy of the dichotomy: there is but one
        same = [k for k in range(model.code.shape[1]) if abs((model.code[:, k] * model.code[:, bit]).sum()) == len(names)]
        assert same == [bit]
        weights = model.weights.copy()
        weights[:, bit] *= -1
        assert language_id.decode(model._replace(weights=weights), pa.array(texts))[0] == names


def plain_grams(text):
    b = [c if 97 <= c <= 122 or c > 127 else 32 for c in (" " + text.lower() + " ").encode()]
    out = [((b[i] << 8 | b[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 17 for i in range(len(b) - 1) if (b[i], b[i + 1]) != (32, 32)]
    return out + [(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x85EBCA6B + 0x27D4EB2F) & 0xFFFFFFFF) >> 17 for i in range(len(b) - 2) if (b[i], b[i + 1]) != (32, 32) and (b[i + 1], b[i + 2]) != (32, 32)]


def plain_decode(model, text):
    """Language, score and the second best score, letter by letter and bit by bit."""
    grams = plain_grams(text or "")
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, 0.0
    losses = []
    for i in range(len(model.languages)):
        loss = 0.0
        for bit in range(model.code.shape[1]):
            margin = sum(float(model.weights[g, bit]) for g in grams) * min(len(grams), language_id.STRENGTH) / len(grams)
            margin = max(-language_id.LIMIT, min(language_id.LIMIT, margin))
            loss += model.reliability[bit] * math.log1p(math.exp(-margin * model.code[i, bit]))
        losses.append(loss)
    likely = [math.exp(-4 * (x - min(losses))) for x in losses]
    first, second = sorted((x / sum(likely) for x in likely), reverse=True)[:2]
    return model.languages[losses.index(min(losses))], first, second


def test_fit_against_plain_counts(spark):
    rows = corpus(80)
    model = language_id.fit(documents(spark, rows))
    counts = np.zeros((4, language_id.BUCKETS))
    for _, text, lang, *_ in rows:
        for g in plain_grams(text):
            counts[sorted(WORDS).index(lang), g] += 1
    wanted = language_id.model_of(sorted(WORDS), counts, 0.1, 0.5)
    assert model.languages == wanted.languages and np.allclose(model.weights, wanted.weights) and np.allclose(model.reliability, wanted.reliability)
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    for bit in range(model.code.shape[1]):
        one, zero = share[model.code[:, bit] > 0].mean(0), share[model.code[:, bit] < 0].mean(0)
        assert np.allclose(model.weights[:, bit], np.log(one / zero), atol=1e-5)


def test_against_a_plain_decoder():
    r = random.Random(6)
    for names in (sorted(WORDS), sorted(LETTERS)):
        model, _ = trained(names)
        texts = [prose(r, lang, r.randint(1, 30)) for lang in WORDS for _ in range(10)] + ["a", "é", "", "12", "Ab c", "日本", "ok?", "x " * 3000]
        found, score, _ = language_id.decode(model, pa.array(texts))
        for t, f, s in zip(texts, found, score, strict=True):
            name, wanted, _ = plain_decode(model, t)
            assert f == name and abs(s - wanted) < 2e-4, t


def test_a_dirty_column_makes_a_bounded_model(spark):
    rows = corpus() + [row(1000 + i, f"text number {i}", f"lang-{i:05d}") for i in range(300)]
    model = language_id.fit(documents(spark, rows), max_languages=10)
    assert len(model.languages) == 10 and set(WORDS) <= set(model.languages)


def test_held_out_accuracy(spark):
    docs = documents(spark, corpus())
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert len(got) > 50 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_never_reads_the_other_columns(spark):
    model = language_id.fit(documents(spark, corpus()))
    a = language_id.predict(documents(spark, [row(1, "the river of the market", "de")]), model).first()
    b = language_id.predict(documents(spark, [(9, "the river of the market", None, "other", None)]), model).first()
    assert (a["lang_pred"], a["score"]) == (b["lang_pred"], b["score"]) == ("en", a["score"])


def test_language_odd_rows(spark):
    model = language_id.fit(documents(spark, corpus()))
    got = {r["doc_id"]: r for r in language_id.predict(documents(spark, ODD), model).collect()}
    assert language_id.predict(documents(spark, ODD), model).count() == len(ODD)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["ambiguous"] for i in (1, 2, 3, 4))
    assert got[5]["lang_pred"] != "und"
    nothing = language_id.fit(documents(spark, [row(1, None, "en"), row(2, "x y", None)]))
    assert {r["lang_pred"] for r in language_id.predict(documents(spark, ODD), nothing).collect()} == {"und"}
    assert language_id.predict(documents(spark, []), model).count() == 0
    assert language_id.keep_identified(documents(spark, [])).count() == 0
    kept = language_id.keep_identified(documents(spark, corpus() + ODD))
    assert kept.columns == documents(spark, []).columns and {1, 2, 3, 4}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_every_letter_counts_whatever_the_batch(spark):
    model = language_id.fit(documents(spark, corpus()))
    texts = ["A", "ok", "é", "x 1", "the river of the market", "", " ", "12", "日"]
    names, score, unsure = language_id.decode(model, pa.array(texts))
    assert [n == "und" for n in names] == [t in ("", " ", "12") for t in texts]
    for i, t in enumerate(texts):
        own = language_id.decode(model, pa.array([t]))
        assert (own[0][0], own[1][0], own[2][0]) == (names[i], score[i], unsure[i])
    got = {r["doc_id"]: r for r in language_id.predict(documents(spark, [row(1, "A")]), model).collect()}
    assert got[1]["lang_pred"] != "und" and got[1]["score"] > 0


JUNK = [
    lambda r: " ".join(w.upper() + "!!" for w in prose(r, "en", 40).split()),
    lambda r: " ".join(w + r.choice(["***", "%%%", "&&&"]) for w in prose(r, "en", 40).split()),
    lambda r: " | ".join(prose(r, "en", 40).split()),
    lambda r: " ".join(w for x in prose(r, "en", 6).split() for w in [x] * 9),
]


def labelled(n=300):
    r = random.Random(8)
    rows = []
    for i in range(n):
        bad = i % 6 == 0
        text = JUNK[i // 6 % 4](r) if bad else prose(r, r.choice(list(WORDS)), r.randint(3, 150))
        rows.append((row(1000 + i, text), bad))
    return rows


def test_votes():
    f = quality.features(pa.array(["THE RIVER OF STONE IS HERE!!", "the river of stone is here.", ""]))
    v = quality.votes(f)
    assert v[0][0] == quality.BAD and v[1][0] == quality.GOOD and v[2][quality.LABELLERS.index("length")] == quality.BAD


def planted(r, chances, abstains, prior=0.75, n=30_000):
    """Counts of votes of labellers with known chances of a bad vote, (good texts, bad texts)."""
    bad = (r.random(n) > prior).astype(int)
    fires = r.random((n, chances.shape[1])) < chances[bad]
    v = np.where(r.random(fires.shape) < abstains[bad], 0, 1 + fires)
    names, many = np.unique(quality._patterns(v.astype(np.int8)), return_counts=True)
    return {k.decode(): int(m) for k, m in zip(names, many, strict=True)}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kinds", [False, True])
def test_estimate_recovers_planted_accuracies(seed, kinds):
    r = np.random.default_rng(seed)
    # a mixture of kinds needs labellers that seldom cry wolf; two classes do without
    chances = np.stack([r.uniform(0.001, 0.02 if kinds else 0.15, 9), r.uniform(0.3, 0.9, 9)])
    abstains = r.uniform(0, 0.4, (2, 9))
    weak = quality.estimate(planted(r, chances, abstains), kinds)
    voted = weak.right[:, :, 1:].sum(2)
    assert np.abs(weak.right[:, :, quality.BAD] / voted - chances).max() < 0.05
    assert np.abs(weak.right[:, :, quality.ABSTAIN] - abstains).max() < 0.05 and abs(weak.prior - 0.75) < 0.02


def test_estimate_with_kinds_that_never_meet():
    r = np.random.default_rng(1)
    n = 20_000
    kind = np.where(r.random(n) < 0.2, r.integers(0, 3, n), 9)
    fires = r.random((n, 9)) < np.where(kind[:, None] == np.arange(9), 0.95, 0.001)
    names, many = np.unique(quality._patterns((1 + fires).astype(np.int8)), return_counts=True)
    weak = quality.estimate({k.decode(): int(m) for k, m in zip(names, many, strict=True)})
    assert all((p < 0.5) == ("2" in k[:3]) for k, p in weak.posterior.items() if k.count("2") < 2)
    assert np.abs(weak.right[1, :3, quality.BAD] - 0.95 / 3).max() < 0.05 and weak.right[0, :, quality.BAD].max() < 0.01
    clean = quality.estimate({"1" * 9: 1000, "011000001": 50})
    assert min(clean.posterior.values()) > 0.99 and clean.prior > 0.99
    assert quality.estimate({}).posterior == {}


def plain_estimate(counts, kinds):
    """The same steps, a pattern, class and labeller at a time."""
    many = len(next(iter(counts)))
    classes = 1 + (many if kinds else 1)
    prior = lambda c, k: quality.ON_OTHER if not kinds or c and c - 1 != k else quality.ON_OWN if c else quality.ON_GOOD
    share = {}
    for p in counts:
        fired = [k for k in range(many) if p[k] == "2"]
        share[p] = [float(not fired)] + [float(k in fired) / max(len(fired), 1) if kinds else float(bool(fired)) for k in range(classes - 1)]
    for _ in range(300):
        size, chance = [0.1] * classes, []
        for c in range(classes):
            size[c] += sum(n * share[p][c] for p, n in counts.items())
            row = []
            for k in range(many):
                no, yes = prior(c, k)
                yes += sum(n * share[p][c] for p, n in counts.items() if p[k] == "2")
                no += sum(n * share[p][c] for p, n in counts.items() if p[k] == "1")
                row.append(yes / (yes + no))
            chance.append(row)
        new = {}
        for p in counts:
            like = [math.log(size[c] / sum(size)) + sum(math.log(chance[c][k] if p[k] == "2" else 1 - chance[c][k]) for k in range(many) if p[k] != "0") for c in range(classes)]
            e = [math.exp(x - max(like)) for x in like]
            new[p] = [x / sum(e) for x in e]
        moved = max(abs(a - b) for p in counts for a, b in zip(new[p], share[p], strict=True))
        share = new
        if moved < 1e-7:
            break
    return {p: x[0] for p, x in share.items()}


@pytest.mark.parametrize("kinds", [False, True])
def test_estimate_against_plain_steps(kinds):
    r = random.Random(3)
    counts = {"".join(r.choices("0112", k=9)): r.randint(1, 40) for _ in range(25)} | {"1" * 9: 500}
    got, wanted = quality.estimate(counts, kinds).posterior, plain_estimate(counts, kinds)
    assert got.keys() == wanted.keys() and all(abs(got[p] - wanted[p]) < 1e-6 for p in got)


def plain_features(text):
    b = text.encode()
    words, lines = b.split(), [x for x in b.split(b"\n") if x]
    count = lambda chars: sum(c in chars for c in b)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    solid = sum(c not in b"\t\n\x0b\x0c\r " for c in b)
    seen, again = set(), 0
    for x in lines:
        again += len(x) if x in seen else 0
        seen.add(x)
    part = lambda a, w: a / max(w, 1)
    return {
        "words": len(words), "upper": part(upper, upper + lower), "odd": part(count(b"#$%&*@^_~=+<>{}[]\\/|"), solid), "cells": part(count(b"|"), len(words)),
        "stutter": part(sum(a == c for a, c in zip(words, words[1:], strict=False)), len(words) - 1), "endings": part(count(b".!?"), len(words)),
        "variety": part(len(set(words)), len(words)), "again": part(again, sum(map(len, lines))), "letters": part(upper + lower + count(range(128, 256)), solid),
    }


def plain_votes(f):
    n = f["words"]
    rules = [
        (n >= 5 and f["upper"] < 0.3, n >= 5 and f["upper"] > 0.5),
        (f["odd"] < 0.03, n >= 10 and f["odd"] > 0.12),
        (f["cells"] < 0.02, n >= 5 and f["cells"] > 0.2),
        (n >= 5 and f["stutter"] < 0.05, n >= 5 and f["stutter"] > 0.3),
        (n >= 5 and 0.02 < f["endings"] < 0.35, n >= 40 and f["endings"] < 0.005 or n >= 10 and f["endings"] > 0.8),
        (n >= 20, n == 0),
        (n >= 5 and f["variety"] > 0.3, 40 <= n < 1000 and f["variety"] < 0.12),
        (n >= 5 and f["again"] < 0.2, n >= 5 and f["again"] > 0.6),
        (f["letters"] > 0.85, n >= 20 and f["letters"] < 0.6 or n > 0 and f["letters"] < 0.2),
    ]
    return "".join("2" if bad else "1" if good else "0" for good, bad in rules)


def plain_row(text):
    """Hashed features of one text: bigrams of bytes by their share, steps of its figures."""
    b = [128 if c >= 128 else c for c in text.encode()]
    out = {}
    for x, y in zip(b, b[1:], strict=False):
        k = (x * 129 + y) % 4093
        out[k] = out.get(k, 0) + 1
    out = {k: math.sqrt(n / max(len(b), 1)) for k, n in out.items()}
    f = plain_features(text)
    for k, name in enumerate(sorted(f)):
        step = int(min(math.log2(1 + f[name]) if name == "words" else f[name] * 10, 15)) + 1000 * (k + 1)
        at = 4096 + int(quality.mix(np.array([step], np.uint64))[0]) % (quality.BUCKETS - 4096)
        out[at] = out.get(at, 0) + 0.5
    return out


def plain_scores(texts, rounds=200):
    rows = [plain_row(t) for t in texts]
    patterns = [plain_votes(plain_features(t)) for t in texts]
    counts = {p: patterns.count(p) for p in patterns}
    weak = plain_estimate(counts, True)
    target = np.array([weak[p] for p in patterns])
    x = np.zeros((len(texts), quality.BUCKETS))
    for i, r in enumerate(rows):
        for k, v in r.items():
            x[i, k] = v
    w, bias, pull, pull_b = np.zeros(quality.BUCKETS), 0.0, np.zeros(quality.BUCKETS), 0.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(x @ w + bias))) - target
        pull = 0.9 * pull + x.T @ off / len(texts) + 1e-4 * w
        pull_b = 0.9 * pull_b + off.mean()
        w, bias = w - 2.0 * pull, bias - 0.4 * pull_b
    return patterns, target, 1 / (1 + np.exp(-(x @ w + bias)))


def test_the_query_against_a_plain_version(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").orderBy("doc_id")
    rows = docs.collect()
    patterns, target, score = plain_scores([r["text"] or "" for r in rows])
    got = {r["doc_id"]: r for r in quality.rate(docs, *quality.fit(docs)).collect()}
    for r, p, t, s in zip(rows, patterns, target, score, strict=True):
        mine = got[r["doc_id"]]
        assert mine["votes"] == p and abs(mine["weak_prob"] - t) < 1e-5 and abs(mine["score"] - s) < 1e-3 and mine["keep"] == (mine["score"] >= 0.4)


def test_accuracies_are_a_result(spark):
    docs = documents(spark, [x for x, _ in labelled()])
    rows = quality.accuracies(spark, quality.weak_labels(docs)).collect()
    assert len(rows) == 2 * len(quality.LABELLERS) and all(abs(r["abstains"] + r["votes_good"] + r["votes_bad"] - 1) < 1e-4 for r in rows)
    assert all(r["right"] is None or r["right"] > 0.9 for r in rows if r["class"] == "good")
    clash = spark.createDataFrame([(1, "a text", 0.1, "x", True)], "doc_id long, text string, score double, votes string, keep boolean")
    assert quality.rate(clash, *quality.fit(clash)).count() == 1 and quality.keep_good(clash).columns == clash.columns
    assert language_id.predict(clash.withColumn("lang_pred", quality.F.lit("x")), language_id.fit(documents(spark, corpus()))).count() == 1


def test_scorer(spark):
    rows = labelled()
    docs = documents(spark, [x for x, _ in rows])
    bad = {x[0] for x, b in rows if b}
    got = quality.rate(docs, *quality.fit(docs)).collect()
    assert sum((r["doc_id"] in bad) != r["keep"] for r in got) >= 0.98 * len(got)
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert not {i for i, in [(x[0],) for x, b in rows if not b]} - kept


def test_quality_odd_rows(spark):
    docs = documents(spark, ODD + [x for x, _ in labelled(60)])
    got = quality.rate(docs, *quality.fit(docs)).collect()
    assert len(got) == len(ODD) + 60 and all(0 <= r["score"] <= 1 for r in got)
    twice = [r["score"] for r in got if r["doc_id"] == 7]
    assert len(set(twice)) == 1
    empty = documents(spark, [])
    assert quality.rate(empty, *quality.fit(empty)).count() == 0 and quality.keep_good(empty).count() == 0
