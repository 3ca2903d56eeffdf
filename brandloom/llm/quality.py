"""Quality classifier from weak labels.

Overlapping heuristics each vote good, bad or abstain on every text. Votes of
the whole corpus are counted by pattern in Spark (at most 3 ** heuristics
patterns), and expectation-maximisation on those counts estimates a confusion
table of each heuristic, how often it is right on good and on bad texts, and the
posterior of each pattern. Nothing of these is set beforehand but weak priors.
The posteriors then label a bounded sample (`max_train_rows`, by a hash of the
id) on which a hashed linear scorer is trained; that scorer rates every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.llm.common import raw, release, slices, tune
from brandloom.llm.wordhash import SPACE, mix, words

ABSTAIN, GOOD, BAD = 0, 1, 2
LABELLERS = ("shout", "symbols", "cells", "stutter", "endings", "length", "variety", "lines", "letters")
BUCKETS = 1 << 13

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_ODD = np.zeros(256, bool)
_ODD[[*b"#$%&*@^_~=+<>{}[]\\/|"]] = True
_END = np.zeros(256, bool)
_END[[*b".!?"]] = True
_HIGH = np.arange(256) >= 128
_LINE = np.zeros(256, bool)
_LINE[10] = True


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float


class Weak(NamedTuple):
    prior: float  # of good
    right: np.ndarray  # class (good, bad) x labeller x vote (abstain, good, bad): share of votes, the confusion tables
    kinds: np.ndarray  # share of texts in each latent class, good first
    posterior: dict[str, float]  # pattern: chance of good


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The shape figures of each text that the heuristics look at."""
    data, offsets = raw(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    count = lambda mask: np.bincount(row[mask], minlength=n)
    w = words(data, offsets)
    n_words = np.bincount(w.row, minlength=n)
    same = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
    order = np.lexsort((w.hashes, w.row))
    h, r = w.hashes[order], w.row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    lines = words(data, offsets, _LINE)
    order = np.lexsort((lines.hashes, lines.row))
    lh, lr, ll = lines.hashes[order], lines.row[order], lines.length[order]
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[1:] == lh[:-1]) & (lr[1:] == lr[:-1])
    upper, lower, solid = count(_UPPER[data]), count(_LOWER[data]), count(~SPACE[data])
    return {
        "words": n_words,
        "upper": _share(upper, upper + lower),
        "odd": _share(count(_ODD[data]), solid),
        "cells": _share(count(data == 124), n_words),
        "stutter": _share(np.bincount(w.row[1:][same], minlength=n), n_words - 1),
        "endings": _share(count(_END[data]), n_words),
        "variety": _share(np.bincount(r[fresh], minlength=n), n_words),
        "again": _share(np.bincount(lr[again], weights=ll[again], minlength=n), np.bincount(lr, weights=ll, minlength=n)),
        "letters": _share(upper + lower + count(_HIGH[data]), solid),
    }


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.int8)


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """rows x LABELLERS: GOOD, BAD or ABSTAIN."""
    n = f["words"]
    some = n >= 5
    return np.stack(
        [
            _vote(some & (f["upper"] < 0.3), some & (f["upper"] > 0.5)),
            _vote(f["odd"] < 0.03, (n >= 10) & (f["odd"] > 0.12)),
            _vote(f["cells"] < 0.02, some & (f["cells"] > 0.2)),
            _vote(some & (f["stutter"] < 0.05), some & (f["stutter"] > 0.3)),
            _vote(some & (f["endings"] > 0.02) & (f["endings"] < 0.35), (n >= 40) & (f["endings"] < 0.005) | (n >= 10) & (f["endings"] > 0.8)),
            _vote(n >= 20, n == 0),
            _vote(some & (f["variety"] > 0.3), (n >= 40) & (n < 1000) & (f["variety"] < 0.12)),
            _vote(some & (f["again"] < 0.2), some & (f["again"] > 0.6)),
            _vote(f["letters"] > 0.85, (n >= 20) & (f["letters"] < 0.6) | (n > 0) & (f["letters"] < 0.2)),
        ],
        1,
    )


def _patterns(v: np.ndarray) -> np.ndarray:
    return (v + 48).astype(np.uint8).view(f"S{v.shape[1]}").ravel()


#: Weak priors in texts, (good votes, bad votes): of good texts, of a kind of junk by
#: the labeller that looks for it, and of a kind by any other labeller.
ON_GOOD, ON_OWN, ON_OTHER = (300.0, 1.0), (1.0, 4.0), (1.0, 1.0)


def estimate(counts: dict[str, int], kinds: bool = True, rounds: int = 300) -> Weak:
    """Expectation-maximisation over vote patterns.

    Good texts are one latent class. Bad ones are another or, with `kinds`, a
    mixture of as many as there are labellers, since a text is seldom junk of
    two kinds at once: labellers that never fire together then are no evidence
    against each other. Each class has a chance of a bad vote for every
    labeller; all of them and the classes' sizes are learned from the counts,
    from where texts that any labeller calls bad are bad, and the ON_ priors
    only weigh as much as some texts. That a labeller abstains says which texts
    it applies to, mostly long ones, and is no evidence for a class; the tables
    have its share. Without any pattern there are no posteriors.
    """
    names = sorted(counts)
    if not names:
        return Weak(0.5, np.full((2, len(LABELLERS), 3), 1 / 3), np.array([0.5, 0.5]), {})
    n = np.array([counts[x] for x in names], float)
    hot = np.eye(3)[[[int(c) for c in x] for x in names]]  # patterns x labellers x votes
    good, bad = hot[:, :, GOOD], hot[:, :, BAD]
    many = hot.shape[1]
    classes = 1 + (many if kinds else 1)
    prior = np.empty((classes, many, 2))
    prior[0], prior[1:] = ON_GOOD if kinds else ON_OTHER, ON_OTHER
    if kinds:
        prior[1 + np.arange(many), np.arange(many)] = ON_OWN
    share = np.zeros((len(names), classes))  # of each class in each pattern
    fired = bad.sum(1)
    share[:, 0] = fired == 0
    share[:, 1:] = bad / np.maximum(fired, 1)[:, None] if kinds else (fired > 0)[:, None]
    for _ in range(rounds):
        weight = share.T * n
        yes, no = weight @ bad + prior[:, :, 1], weight @ good + prior[:, :, 0]
        chance = yes / (yes + no)
        size = weight.sum(1) + 0.1
        log = bad @ np.log(chance).T + good @ np.log1p(-chance).T + np.log(size / size.sum())
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-7:
            break
    weight = np.stack([share[:, 0] * n, (1 - share[:, 0]) * n])
    right = np.einsum("cp,plk->clk", weight, hot) / np.maximum(weight.sum(1), 1e-300)[:, None, None]
    return Weak(float(weight[0].sum() / n.sum()), right, size / size.sum(), dict(zip(names, share[:, 0].tolist(), strict=True)))


def accuracies(spark: SparkSession, weak: Weak) -> DataFrame:
    """The confusion tables, a row for each labeller and class.

    (labeller, class, abstains, votes_good, votes_bad, right): shares of the
    class's texts, and of its votes on them the share that is right.
    """
    rows = []
    for c, name in enumerate(("good", "bad")):
        for k, labeller in enumerate(LABELLERS):
            abstains, good, bad = (float(round(x, 6)) for x in weak.right[c, k])
            rows.append((labeller, name, abstains, good, bad, round((good, bad)[c] / (good + bad), 6) if good + bad else None))
    return spark.createDataFrame(rows, "labeller string, class string, abstains double, votes_good double, votes_bad double, right double")


def hashed(texts: pa.Array, f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: byte bigrams by square root of their share, and shape steps."""
    data, offsets = raw(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = np.where(_HIGH[data], 128, data).astype(np.int64)
    edge = np.zeros(len(data), bool)
    edge[offsets[1:-1][offsets[1:-1] < len(data)]] = True
    keep = ~edge[1:]
    two = (kind[:-1] * 129 + kind[1:])[keep] % 4093
    size = np.int64(4096)
    cell, many = np.unique(row[:-1][keep] * size + two, return_counts=True)
    rows, ids = cell // size, cell % size
    value = np.sqrt(many / np.maximum(np.bincount(row, minlength=n), 1)[rows])
    extra = []
    for k, name in enumerate(sorted(f)):
        step = np.minimum(np.log2(1 + f[name]) if name == "words" else f[name] * 10, 15).astype(np.uint64)
        with np.errstate(over="ignore"):
            extra.append(4096 + (mix(step + np.uint64(1000 * (k + 1))) % np.uint64(BUCKETS - 4096)).astype(np.int64))
    shape = np.stack(extra, 1) if n else np.zeros((0, len(f)), np.int64)
    return (
        np.concatenate([rows, np.repeat(np.arange(n), shape.shape[1])]),
        np.concatenate([ids, shape.ravel()]),
        np.concatenate([value, np.full(shape.size, 0.5)]),
    )


def train(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, target: np.ndarray, rounds: int = 200, step: float = 2.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, by gradient descent with momentum."""
    w, bias, pull, pull_b = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    n = max(len(target), 1)
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[ids] * values, minlength=len(target)) + bias
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        pull = 0.9 * pull + np.bincount(ids, weights=off[rows] * values, minlength=BUCKETS) / n + decay * w
        pull_b = 0.9 * pull_b + off.mean() if len(off) else 0.0
        w -= step * pull
        bias -= step * 0.2 * pull_b
    return Scorer(w, float(bias))


def score(model: Scorer, texts: pa.Array, f: dict[str, np.ndarray]) -> np.ndarray:
    rows, ids, values = hashed(texts, f)
    z = np.bincount(rows, weights=model.weights[ids] * values, minlength=len(texts)) + model.bias
    # equal texts get equal scores wherever they stand: vectorised exp may differ in its last bit
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    total: dict[bytes, int] = {}
    for batch in batches:
        for _, texts in slices(batch, "text", 2 << 20):
            for p, n in zip(*np.unique(_patterns(votes(features(texts))), return_counts=True), strict=True):
                total[p] = total.get(p, 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array([p.decode() for p in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["votes", "n"])


def pattern_counts(docs: DataFrame) -> dict[str, int]:
    """How many rows have each pattern of votes: at most 3 ** labellers patterns."""
    tune(docs.sparkSession)
    found = docs.select("text").mapInArrow(_count, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    return {r["votes"]: r["n"] for r in found}


def weak_labels(docs: DataFrame) -> Weak:
    """Accuracies and posteriors from the votes of all rows."""
    return estimate(pattern_counts(docs))


def fit(docs: DataFrame, max_train_rows: int = 8_000) -> tuple[Weak, Scorer]:
    """Weak labels of all rows, and the scorer trained on about `max_train_rows`."""
    counts = pattern_counts(docs)
    weak, rows = estimate(counts), sum(counts.values())
    share = min(1.0, max_train_rows / max(rows, 1))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1 << 30))
    chosen = docs if share == 1 else docs.where(part < int(share * (1 << 30)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text", 2 << 20):
                f = features(texts)
                at, ids, values = hashed(texts, f)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(np.bincount(at, minlength=len(texts)))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.decode() for x in _patterns(votes(f))], pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(ids[order].astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(values[order].astype(np.float32))),
                    ],
                    ["votes", "ids", "vals"],
                )

    got = chosen.select("text").mapInArrow(gather, "votes string, ids array<int>, vals array<float>").toArrow()
    target = np.array([weak.posterior.get(x, 0.5) for x in got.column("votes").to_pylist()])
    lists = got.column("ids").combine_chunks()
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = lambda name: got.column(name).combine_chunks().flatten().to_numpy()
    return weak, train(np.repeat(np.arange(len(target)), sizes), flat("ids").astype(np.int64), flat("vals").astype(float), target)


def rate(docs: DataFrame, weak: Weak, scorer: Scorer, threshold: float = 0.4) -> DataFrame:
    """(doc_id, votes, weak_prob, score, keep) of every row of docs (doc_id, text).

    A null or empty text is rated like any other: it has no words, so `length`
    votes bad. A text of any length is rated by all of it, equal ones alike; a
    score at the threshold is kept. Repeated rows are each rated; an empty table
    gives none.
    """
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast((weak.posterior, scorer))  # patterns and buckets, both fixed in number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, model = known.value
        release()
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                f = features(texts)
                names = [x.decode() for x in _patterns(votes(f))]
                s = score(model, texts, f)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array([posterior.get(x, 0.5) for x in names], pa.float64()), pa.array(s), pa.array(s >= threshold)], ["doc_id", "votes", "weak_prob", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes string, weak_prob double, score double, keep boolean")


def keep_good(docs: DataFrame, max_train_rows: int = 8_000, threshold: float = 0.4) -> DataFrame:
    """The rows of documents that the scorer doesn't reject, unchanged.

    A null or empty text is rated as a text without words; an empty table stays so.
    """
    weak, scorer = fit(docs, max_train_rows)
    known = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                yield part.filter(pa.array(score(known.value, texts, features(texts)) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema) if weak.posterior else docs
