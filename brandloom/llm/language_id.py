"""Language identification with error-correcting output codes.

Every language gets a codeword whose bits are distinct dichotomies of the
languages: all of them for a few languages, drawn ones for more, so that any
two codewords differ in four bits or more from four languages on, and a wrong
bit is outvoted. One binary classifier over hashed byte bigrams and trigrams
predicts each bit; a text's language is the codeword with the least weighted
logistic loss, where a bit weighs as much as its classifier is reliable and no
bit's loss goes beyond that of a margin of LIMIT. Texts whose two best
codewords are close are flagged.

Learning reads a bounded sample (`max_train_rows`, by a hash of the id) of the
`max_languages` most frequent languages in it; gram counts are summed in Spark,
so the driver sees languages x buckets numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import raw, release, slices, tune

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Evidence of this many grams at most counts for one text.
STRENGTH = 24.0
#: A bit's margin counts up to this much either way, so that no bit outvotes all others.
LIMIT = 4.0
#: Languages whose dichotomies all become bits; beyond, BITS bits for each doubling are drawn.
EXHAUSTIVE = 6
BITS = 12

# Letters of any alphabet keep their bytes; all else becomes one space.
_LETTER = np.zeros(256, np.uint8)
_LETTER[:] = 32
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    reliability: np.ndarray  # of each bit
    margin: float


def distance(code: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    n, bits = code.shape
    apart = (bits - code @ code.T) / 2
    return int(apart[~np.eye(n, dtype=bool)].min()) if n > 1 else bits


def codewords(n: int, tries: int = 20) -> np.ndarray:
    """n codewords of +1 and -1; no column is constant, or equal or opposite to another.

    Up to EXHAUSTIVE languages, all dichotomies; any two codewords then differ
    in 2 ** (n - 2) bits. Beyond, drawn ones, the best of several fixed draws
    by that distance.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:  # the first language is always on the positive side, so no column has its opposite
        return np.array([[-1.0 if i and j >> (i - 1) & 1 else 1.0 for j in range(1, 1 << (n - 1))] for i in range(n)])
    bits, best = int(np.ceil(BITS * np.log2(n))), np.ones((n, 0))
    for seed in range(tries):
        r = np.random.default_rng(seed)
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = r.choice([-1.0, 1.0], n)
            if abs(c.sum()) < n:
                columns.setdefault((c * c[0]).tobytes(), c * c[0])
        code = np.stack(list(columns.values()), 1)
        if not best.size or distance(code) > distance(best):
            best = code
    return best


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed gram ids of all texts, and the row that each belongs to.

    A space stands at either end of every text, so a letter alone has grams.
    """
    data, offsets = raw(pc.binary_join_element_wise("", pc.utf8_lower(texts), "", " "))
    if len(data) < 3:  # no text with a character
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LETTER[data].astype(np.uint32)
    edge = np.zeros(len(b), bool)
    edge[offsets[1:-1][offsets[1:-1] < len(b)]] = True  # a gram may not cross into the next text
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    ok2 = ~edge[1:] & (two != 0x2020)
    ok3 = ~edge[1:-1] & ~edge[2:] & (two[:-1] != 0x2020) & (two[1:] != 0x2020)
    ids2 = (two[ok2] * np.uint32(0x9E3779B1)) >> np.uint32(17)
    ids3 = (three[ok3] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) >> np.uint32(17)
    return np.concatenate([ids2, ids3]).astype(np.int64), np.concatenate([row[:-1][ok2], row[:-2][ok3]])


def lettered(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, texts in slices(batch, "text"):
            ids, row = grams(texts)
            names = np.array(part.column("lang").to_pylist(), object)
            for name in set(names):
                mine = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                mine += np.bincount(ids[names[row] == name], minlength=BUCKETS)
    for name, mine in total.items():
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, max_train_rows: int = 20_000, margin: float = 0.1, smooth: float = 0.5, max_languages: int = 128) -> Model:
    """Learn from `docs` (doc_id, text, lang); rows with null lang or text are skipped.

    About `max_train_rows` rows at most are read, chosen by a hash of doc_id,
    so the choice is the same on every run. Of these, the `max_languages`
    languages with most rows are learned (of equal ones the first by name), so
    a dirty column of names makes no model without bound. With no labelled row
    the model knows no language and predicts `und` for all.
    """
    tune(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL").count()  # without reading a text
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    share = min(1.0, max_train_rows / max(rows, 1))
    chosen = known if share == 1 else known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    names = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(names) > max_languages:
        chosen = chosen.where(F.col("lang").isin([r["lang"] for r in names[:max_languages]]))
    counted = chosen.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = sorted(table["lang"].unique())
    n = np.zeros((len(languages), BUCKETS))
    for i, name in enumerate(languages):
        own = table[table["lang"] == name]
        n[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    return model_of(languages, n, margin, smooth)


def model_of(languages: list[str], counts: np.ndarray, margin: float, smooth: float) -> Model:
    code = codewords(len(languages))
    share = (counts + smooth) / (counts + smooth).sum(1, keepdims=True) if len(languages) else counts
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    reliability = np.zeros(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] > 0, code[:, bit] < 0
        if one.any() and zero.any():
            weights[:, bit] = np.log(share[one].mean(0)) - np.log(share[zero].mean(0))
            # how well a mean text of each language falls on its side, at worst
            reliability[bit] = max(0.0, (code[:, bit] * (share @ weights[:, bit])).min())
    if reliability.any():
        reliability /= reliability.sum()
    return Model(list(languages), code, weights, reliability, margin)


def decode(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score from 0 to 1 and the ambiguity flag of each text."""
    n = len(texts)
    known = lettered(texts)
    ids, row = grams(texts)
    total = np.bincount(row, minlength=n).astype(float)
    known &= total > 0
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    margins = np.zeros((n, model.code.shape[1]))
    for bit in range(model.code.shape[1]):
        margins[:, bit] = np.bincount(row, weights=model.weights[ids, bit], minlength=n)
    margins *= (np.minimum(total, STRENGTH) / np.maximum(total, 1))[:, None]
    margins = np.clip(margins, -LIMIT, LIMIT)
    plus, minus = model.code > 0, model.code < 0
    loss = (np.logaddexp(0, -margins) * model.reliability) @ plus.T + (np.logaddexp(0, margins) * model.reliability) @ minus.T
    likely = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
    likely /= likely.sum(1, keepdims=True)
    order = np.sort(likely, 1)
    score = np.round(order[:, -1], 6)  # vectorised exp may differ in its last bit by place
    second = order[:, -2] if order.shape[1] > 1 else np.zeros(n)
    unsure = ~known | (score - second < model.margin)
    best = likely.argmax(1)
    return [model.languages[best[i]] if known[i] else UNKNOWN for i in range(n)], np.where(known, score, 0.0), unsure


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row of `docs` (doc_id, text).

    A null, empty or letterless text is `und` with score 0 and ambiguous; any
    other gets a learned language, by all of it however long. Of codewords that
    are equally near, the first language by name is predicted, and the text is
    ambiguous. Repeated rows are each predicted; an empty table gives none.
    """
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                names, score, unsure = decode(known.value, texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out() -> F.Column:
    """True for the third of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, max_train_rows: int = 20_000) -> DataFrame:
    """The rows of documents whose language is found, unchanged.

    Null and empty texts are rejected; with no labelled row all rows stay.
    Rejected are texts without a letter and those that stand between two
    codewords. `lang`, `source` and `doc_id` don't bear on a row's fate.
    """
    model = fit(docs.where(~held_out()), max_train_rows)
    tune(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                names, _, unsure = decode(known.value, texts)
                fine = np.array([x != UNKNOWN for x in names], bool) & ~unsure
                yield part.filter(pa.array(fine, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema) if model.languages else docs


__all__ = ["Model", "codewords", "decode", "fit", "held_out", "keep_identified", "model_of", "predict"]
