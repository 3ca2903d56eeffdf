"""Near-duplicate groups: SetSketch bands propose, likelihood sifts, full sets confirm.

1. Every text becomes its set of word shingles and a SetSketch of it; texts
   with the very same set are one from here on.
2. Documents that agree in a band of registers share a bucket. Each is held
   against the least document of each of its buckets, its hub: the joint
   likelihood of the two sketches and the two set sizes estimates their
   similarity, and pairs that may reach the threshold are confirmed on their
   full sets, first every document's likeliest hub, then the hubs that are not
   yet in the document's component. A group of near copies is done here, with a
   few rows a document.
3. A bucket whose documents are now in one component has nothing left to find.
   In the others, the documents outside the bucket's largest component are held
   against all of it, in pairs of blocks of BLOCK documents, one task each:
   first by sketches alone, then those that found a likely partner by their
   full sets. Pairs within a component, with the hub, or that an earlier band
   has already brought together are passed over. A task returns no pairs but a
   spanning forest of the confirmed links, at most one edge a document.
4. Connected components of all confirmed links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import discard, raw, release, slices, stage, tune
from brandloom.llm.components import components
from brandloom.llm.setsketch import BANDS, REGISTERS, ROWS, likely_jaccard, shingles, sketches

#: Estimates this far under the threshold go no further. At a similarity of 0.8 an estimate
#: from REGISTERS registers has a standard deviation of 0.026, so a link is lost here
#: with a chance under one in 10 ** 8, far less often than by sharing no band.
DOUBT = 0.15
BLOCK = 128
#: Blocks of a bucket's largest component are so many times as large.
WIDER = 4
#: Rows of pairs of blocks in one task, of sketches and of full sets.
TASK_ROWS, TASK_SETS = 1 << 13, 1 << 10
#: Columns of a membership matrix at a time.
WIDTH = 4096


def digests(row: np.ndarray, hashes: np.ndarray, rows: int) -> list[bytes]:
    """A 128-bit digest of each set, which comes sorted."""
    ends = np.cumsum(np.bincount(row, minlength=rows)).tolist()
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if rows else []


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                row, hashes = shingles(*raw(texts), size)
                n = np.bincount(row, minlength=len(texts))
                stored = sketches(row, hashes, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(digests(row, hashes, len(texts)), pa.binary()), pa.array([x.tobytes() for x in stored], pa.binary())],
                    ["doc_id", "n", "digest", "sketch"],
                )
        release()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                row, hashes = shingles(*raw(texts), size)
                ends = np.cumsum(np.bincount(row, minlength=len(texts)))
                members = [hashes[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]).tolist() if len(ends) else [], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(members, pa.binary())], ["id", "members"])
        release()

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of `a` with every one of `b`.

    Only hashes that occur more than once matter; they are the columns of two
    membership matrices, WIDTH at a time, whose product counts what is shared.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    flat = np.concatenate([*a, *b])
    seen, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    size = np.array([len(x) for x in [*a, *b]])
    row = np.repeat(np.arange(len(size)), size)
    keep = times[code] > 1
    row, column = row[keep], column[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, [first, first + WIDTH])
        matrix = np.zeros((len(size), min(WIDTH, int(column[-1]) + 1 - first)), np.float32)
        matrix[row[lo:hi], column[lo:hi] - first] = 1
        out += matrix[: len(a)] @ matrix[len(a) :].T
    return out.astype(np.int64)


def forest(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric boolean matrix, each row's least index reachable."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _sketches_of(column: pa.Array) -> np.ndarray:
    return raw(column)[0].reshape(-1, REGISTERS)


def _likely(percent: int):
    """Pairs (a, b) whose sizes and likelihood allow a link, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            fine = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            batch, n_a, n_b = batch.filter(pa.array(fine)), n_a[fine], n_b[fine]
            likely = likely_jaccard(_sketches_of(batch.column("s_a")), _sketches_of(batch.column("s_b")), n_a.astype(float), n_b.astype(float))
            fine = pa.array(likely >= percent / 100 - DOUBT)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(fine), batch.column("b").filter(fine), pa.array(likely).filter(fine)], ["a", "b", "likely"])

    return run


def _confirmed(percent: int):
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column("m_a"), batch.column("m_b"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                fine.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return run


class _Block:
    """The documents of one pair of blocks of a bucket."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("id").to_numpy()
        self.n = rows.column("n").to_numpy().astype(np.int64)
        self.component = rows.column("component").to_numpy()
        self.side = rows.column("side").to_numpy()
        self.hub = rows.column("hub")[0].as_py()
        self.band = rows.column("place")[0].as_py()
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows to be confirmed: of both sides, or within the only side."""
        own, other = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        two = len(other) > 0
        i, j = np.nonzero(np.ones((len(own), len(other)), bool)) if two else np.triu_indices(len(own), 1)
        i, j = own[i], (other if two else own)[j]
        n = self.n
        fine = (self.component[i] != self.component[j]) & (self.ids[i] != self.hub) & (self.ids[j] != self.hub)
        fine &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fine], j[fine]
        for b in range(self.band):  # an earlier band holds these two together
            if not len(i):
                break
            part = self.sketch[:, b * ROWS : (b + 1) * ROWS]
            new = (part[i] != part[j]).any(1)
            i, j = i[new], j[new]
        step = 1 << 15
        fine = [likely_jaccard(self.sketch[i[k : k + step]], self.sketch[j[k : k + step]], n[i[k : k + step]].astype(float), n[j[k : k + step]].astype(float)) >= percent / 100 - DOUBT for k in range(0, len(i), step)]
        fine = np.concatenate(fine) if fine else np.zeros(0, bool)
        return i[fine], j[fine]


_KEY = ["band", "i", "j"]
_ROW = "band long, i int, j int, side int, place int, hub long, id long, component long, n long, sketch binary"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one key, which come sorted."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _KEY], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[lo])
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _promising(percent: int):
    """The rows of each pair of blocks that have a likely partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            i, j = _Block(rows).pairs(percent)
            if len(i):
                yield from rows.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    return run


def _search_blocks(percent: int):
    """A spanning forest of the links within each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            block = _Block(rows)
            i, j = block.pairs(percent)
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
            left, right = np.unique(i), np.unique(j)
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
            shared = both[np.searchsorted(left, i), np.searchsorted(right, j)]
            fine = 100 * shared >= percent * (block.n[i] + block.n[j] - shared)
            linked = np.zeros((len(sets), len(sets)), bool)
            linked[i[fine], j[fine]] = True
            root = forest(linked | linked.T)
            at = np.flatnonzero(root != np.arange(len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[at]), pa.array(block.ids[root[at]])], ["a", "b"])

    return run


def _block_counts(block: int) -> tuple[Column, Column]:
    return F.ceil(F.col("k_rest") / block), F.ceil(F.col("k_large") / (WIDER * block))


def _deal(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets (band, id, large, k_large, k_rest) to pairs of blocks (i, j), side 0 or 1.

    A small bucket is one block. Of others, the rest is dealt out in blocks,
    numbered from 0, and the largest component in WIDER times as large blocks
    behind them. Every block of the rest meets every other and every block of
    that component, but the component's blocks don't meet each other.
    """
    rest, large = (x.cast("int") for x in _block_counts(block))
    small = F.col("k_rest") + F.col("k_large") <= block
    mine = F.when(F.col("large"), rest + F.pmod(F.xxhash64("id"), large).cast("int")).otherwise(F.pmod(F.xxhash64("id"), rest).cast("int"))
    others = F.when(F.col("large"), F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), rest + large - 1))
    dealt = rows.withColumn("mine", F.when(small, 0).otherwise(mine)).withColumn("other", F.explode(F.when(small, F.array(F.lit(0))).otherwise(others)))
    return dealt.select(
        "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "place", "hub", "id", "component"
    )


def _component(found: DataFrame, column: str, name: str) -> DataFrame:
    return found.select(F.col("id").alias(column), F.col("component").alias(name))


def _at(name: str, column: str) -> Column:
    return F.coalesce(F.col(name), F.col(column))


def groups(docs: DataFrame, percent: int = 80, size: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Rows with the same set, or whose sets of `size`-word shingles share at
    least `percent` of their union, are linked; component_id is the least
    doc_id reachable and kept tells whether it is the row's own. A null or
    empty text has no set and stays alone; a text of any length has its whole
    set. Repeated rows get equal results; of rows with one doc_id and different
    texts, one text counts. A row without doc_id counts in no group: its
    component_id is null. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = stage(docs.mapInArrow(_sketched(size), "doc_id long, n long, digest binary, sketch binary"), "sketches")
    # Aggregates that a join follows are staged, so that both sides of the join come
    # from plain shuffles and Spark can split the partition of a key with many rows.
    same = drawn.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 AND first IS NOT NULL").select("digest", "first")
    same = stage(same, "copies")
    copies = drawn.join(same, "digest", "left")
    repeated = stage(drawn.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    # every row and the least document with the very same set, which alone keeps the sketch
    rep = F.when(F.col("n") > 0, F.coalesce("first", "doc_id"))
    rows = stage(copies.select("doc_id", "n", rep.alias("rep"), "sketch").withColumn("sketch", F.expr("IF(doc_id = rep, sketch, NULL)")), "rows")
    discard(drawn, same)
    sets = rows.where("doc_id = rep AND n > 0").select(F.col("rep").alias("id"), "n", "sketch")
    bands = sets.select(
        "id",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("sketch"), i * ROWS + 1, F.lit(ROWS)), i))).alias("place", "band"),
    )
    hubs = stage(bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("k")).where("hub <> last").select("band", "hub", "k"), "hubs")
    shared = stage(bands.join(hubs, "band").select("band", "place", "hub", "k", "id"), "shared")
    discard(hubs)
    pointers = stage(shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pointers")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    candidates = stage(pointers.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_likely(percent), "a long, b long, likely double"), "candidates")
    discard(pointers)

    members = _members(docs, candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")), repeated, size)
    best = stage(candidates.groupBy("a").agg(F.max_by("b", F.struct("likely", -F.col("b"))).alias("b")), "best")
    found = stage(components(_confirm(best, members, percent)), "first")
    apart = candidates.join(_component(found, "a", "c_a"), "a", "left").join(_component(found, "b", "c_b"), "b", "left").where(_at("c_a", "a") != _at("c_b", "b")).select("a", "b")
    found = _joined(found, _confirm(apart.join(best, ["a", "b"], "left_anti"), members, percent), "second")
    discard(best, candidates, members)

    # buckets of three or more documents in two or more components
    held = shared.where("k > 2").join(_component(found, "id", "c"), "id", "left").select("band", "place", "hub", "id", _at("c", "id").alias("component"))
    held = stage(held, "held")
    discard(shared)
    parts = held.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    open_ = parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", -F.col("component"))).alias("most"), F.sum("k").alias("k")).where("parts > 1")
    open_ = stage(open_.select("band", (-F.col("most.col2")).alias("main"), F.col("most.k").alias("k_large"), (F.col("k") - F.col("most.k")).alias("k_rest")), "open")
    rest, large = _block_counts(block)
    copies_of = F.when(F.col("k") <= block, F.col("k")).otherwise(F.col("k_rest") * (rest + large) + F.col("k_large") * rest)
    n_dealt = open_.withColumn("k", F.col("k_rest") + F.col("k_large")).agg(F.sum(copies_of).alias("n")).first()["n"] or 0
    dealt = _deal(held.join(open_, "band").withColumn("large", F.col("component") == F.col("main")), block).join(sets, "id")
    # the work goes by rows, not by their bytes, so Spark isn't to choose the number of tasks
    ordered = lambda df, n: df.repartition(1 + int(n), *_KEY).sortWithinPartitions(*_KEY, "side", "id")
    fields = [x.split()[0] for x in _ROW.split(", ")]
    promising = stage(ordered(dealt.select(*fields), n_dealt // TASK_ROWS).mapInArrow(_promising(percent), _ROW), "promising")
    discard(held, open_)
    n_promising = promising.count()
    if n_promising:
        members = _members(docs, promising.select(F.col("id").alias("doc_id")), repeated, size)
        searched = ordered(promising.join(members, "id").select(*fields, "members"), n_promising // TASK_SETS)
        found = _joined(found, stage(searched.mapInArrow(_search_blocks(percent), "a long, b long").distinct(), "links"), "third")
        discard(members)
    discard(promising, repeated)

    out = rows.join(found, rows["rep"] == found["id"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _members(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """(id, members): the full sets of the wanted documents, one for each id.

    Only ids that stand in several rows are brought together for that.
    """
    ids = stage(wanted.distinct(), "wanted")
    made = lambda df: df.join(ids.hint("shuffle_hash"), "doc_id").mapInArrow(_sets(size), "id long, members binary")
    if repeated.isEmpty():
        out = made(docs)
    else:
        again = made(docs.join(repeated.hint("shuffle_hash"), "doc_id", "left_semi")).dropDuplicates(["id"])
        out = made(docs.join(repeated.hint("shuffle_hash"), "doc_id", "left_anti")).union(again)
    out = stage(out, "sets")
    discard(ids)
    return out


def _confirm(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their full sets link."""
    side = lambda x: members.select(F.col("id").alias(x), F.col("members").alias(f"m_{x}"))
    return stage(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")


def _joined(found: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """Components with further links."""
    if links.isEmpty():
        return found
    out = stage(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links.select("a", "b"))), label)
    discard(found, links)
    return out


def keep_first(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of documents that stay: of each group that with the least doc_id.

    Of rows with one doc_id, one stays. Rows without doc_id all stay.
    """
    ids = stage(groups(docs, percent, size).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept")
    mine = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    again = mine.groupBy("doc_id").count().where("count > 1")
    if not again.isEmpty():
        twice = stage(again.select("doc_id"), "twice")
        mine = mine.join(twice, "doc_id", "left_anti").union(mine.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return mine.select(*docs.columns).union(docs.where("doc_id IS NULL").select(*docs.columns))
