"""Best-fit packing of tokenised documents by hierarchical residuals.

Every input partition packs its own pieces best-fit, longest first. Nearly full
sequences are final there; the others become items (sequence, fill) of the next
round, in which an eighth as many partitions pack them again, and so on up the
tree. At its root, where all that are left meet, they are counted by their
fills and the counts are packed: all have met without being in one place,
however many they are. Only those small items move between machines: the pieces
stay where they are until one join at the end tells each its final sequence and
shift.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brandloom.llm.common import keep, raw, slices, stage, tune

CAPACITY = 4096
END_ID = 1
#: Pieces that a task packs at a time, and sequences that one task of a later
#: round takes; both bound its memory.
BUFFER = 1 << 17
FAN_IN = 8
#: A sequence with this few free places is final.
SLACK = 1
#: Words whose ids a Python worker remembers: about 250 bytes each.
MEMO = 1_000_000
#: Plain words that are tokenised as one text.
_TOGETHER = 256
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Ids:
    """Token ids of whole texts as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and never joins what white
    space parts, so the ids of a text are those of its words in turn. Each word
    is tokenised once and then remembered; MEMO words bound the memory. A new
    word with capitals or with punctuation behind its letters is put together
    from its plain form, and plain words are tokenised many at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.four = [i.to_bytes(4, "little") for i in range(len(self.last))]
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.before: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, distinct))
        new = [w for w, x in zip(distinct, ids, strict=True) if x is None]
        if new:
            if len(self.memo) + len(new) > MEMO // 2:  # words that are used again come back from what was before
                self.before, self.memo = self.memo, {b"": b""}
                new = distinct
            again = list(map(self.before.get, new))
            self.memo.update((w, x) for w, x in zip(new, again, strict=True) if x is not None)
            self._learn([w for w, x in zip(new, again, strict=True) if x is None])
            ids = list(map(self.memo.__getitem__, distinct))
        found = pa.array(ids, pa.binary())
        data, offsets = raw(found.take(words.indices))
        whole, ends = data.tobytes(), offsets[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [whole[a:b] for a, b in itertools.pairwise(ends)]

    def _encoded(self, texts: list[str], most: int) -> Iterator[np.ndarray]:
        """Ids of each text, `most` texts at a time, since what the tokenizer returns is large."""
        for k in range(0, len(texts), most):
            for x in self.tokenizer.encode_batch_fast(texts[k : k + most], add_special_tokens=False):
                yield np.array(x.ids, "<u4")

    def _learn(self, new: list[bytes]) -> None:
        memo, made, need = self.memo, [], set()
        add = need.add
        for w in new:
            if not w:
                continue
            # special tokens are told from text by case and by "<|"
            if w.isascii() and b"<|" not in w:
                plain = w.lower()
                base = plain.rstrip(_MARKS)
                if base and base != w and base[-1:].isalnum():
                    tail = plain[len(base) :]
                    made.append((w, base, tail))
                    if base not in memo:
                        add(base)
                    if tail and tail not in memo:
                        add(tail)
                    continue
            add(w)
        words, others = [], []
        model, four = self.tokenizer.model.tokenize, self.four
        for w in need:
            if w.isalpha() and w.islower():  # letters from a to z are one piece, and their own byte-level form
                memo[w] = b"".join([four[x.id] for x in model(w.decode())])
            elif w.isalpha() or not w.isascii() and w.decode().isalpha():
                words.append(w)
            else:
                others.append(w)
        parts = [words[k : k + _TOGETHER] for k in range(0, len(words), _TOGETHER)]
        for part, ids in zip(parts, self._encoded([b" ".join(x).decode() for x in parts], 32), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # a letter's lower case may be more than a letter
                others.extend(part)
                continue
            flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            memo.update(zip(part, [flat[a:b] for a, b in itertools.pairwise(cuts)], strict=True))
        for w, ids in zip(others, self._encoded([w.decode() for w in others], 4096), strict=True):
            memo[w] = ids.tobytes()
        for w, base, tail in made:
            memo[w] = memo[base] + memo[tail] if tail else memo[base]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit in the given order: bin and offset of each item, fill of each bin.

    Open bins are stacked by free space, and the bits of one integer tell which
    stacks hold any: the tightest bin for an item is the lowest bit from its
    length on.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    where, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        above = open_ >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ ^= 1 << free
        else:
            b, free = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        left = free - n
        if left:
            stacks[left].append(b)
            open_ |= 1 << left
    return where, offset, np.array(fill, np.int64)


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """best_fit of `counts` items of each length, longest first, many at a time.

    Rows (length, rank, bin, each, offset) in this order: of the items of a
    length, the one j after rank is in bin + j // each, at offset + j % each
    times its length. As with best_fit, no two bins fit into one.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free places: first bin, bins
    open_ = made = 0
    plan = []
    for length, n in sorted(counts.items(), reverse=True):
        rank = 0
        while rank < n:
            above = open_ >> length
            if above:
                free = length + (above & -above).bit_length() - 1
                first, bins = groups[free].pop()
                if not groups[free]:
                    open_ ^= 1 << free
            else:
                free, first, bins = capacity, made, -(-(n - rank) // (capacity // length))
                made += bins
            each = free // length
            items = min(n - rank, bins * each)
            plan.append((length, rank, first, each, capacity - free))
            full, rest = divmod(items, each)
            partly = min(rest, 1)
            for left, at, some in ((free - each * length, first, full), (free - rest * length, first + full, partly), (free, first + full + partly, bins - full - partly)):
                if left and some:
                    groups[left].append((at, some))
                    open_ |= 1 << left
            rank += items
    return sorted(plan)


def _number(counter: int) -> int:
    """Bins are numbered apart in every task of one round."""
    return (TaskContext.get().partitionId() << 36) + counter


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("fill", pa.int64())])


def _pack_pieces(path: str, capacity: int):
    def flush(parts: list[tuple], counter: int) -> tuple[pa.RecordBatch, int]:
        null, doc, piece, start, length, crc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((crc, piece, doc, -length))
        null, doc, piece, start, length, crc = (x[order] for x in (null, doc, piece, start, length, crc))
        b, place, fill = best_fit(length, capacity)
        arrays = [pa.array(doc, mask=null), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(b + _number(counter)), pa.array(place), pa.array(fill[b])]
        return pa.RecordBatch.from_arrays(arrays, schema=_PIECES), counter + len(fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, parts, held, counter = keep(("ids", path), lambda: Ids(path)), [], 0, 0
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                end = np.array([END_ID], "<u4").tobytes()
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(texts)):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                column = part.column("doc_id")
                ids64 = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                empty = column.is_null().to_numpy(zero_copy_only=False)
                at_row = np.array(row, np.int64)
                parts.append((empty[at_row], ids64[at_row], *(np.array(x, np.int64) for x in (piece, start, length, crc))))
                held += len(row)
                if held >= BUFFER:
                    out, counter = flush(parts, counter)
                    yield out
                    parts, held = [], 0
        if parts:
            yield flush(parts, counter)[0]

    return run


_MERGED = pa.schema([("bin", pa.int64()), ("into", pa.int64()), ("shift", pa.int64()), ("into_fill", pa.int64())])


def _pack_bins(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("bin", pa.int64()), ("fill", pa.int64())]))
        bins, fills = (table.column(c).to_numpy() for c in ("bin", "fill"))
        counter = 0
        order = np.lexsort((bins, -fills))
        for k in range(0, len(bins), BUFFER):
            mine = order[k : k + BUFFER]
            b, shift, fill = best_fit(fills[mine], capacity)
            yield pa.RecordBatch.from_arrays([pa.array(bins[mine]), pa.array(b + _number(counter)), pa.array(shift), pa.array(fill[b])], schema=_MERGED)
            counter += len(fill)

    return run


def _rank(capacity: int):
    """Number the sequences of each fill within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            fills = batch.column("fill").to_numpy()
            order = np.argsort(fills, kind="stable")
            ordered = fills[order]
            rank = np.empty(len(fills), np.int64)
            rank[order] = np.arange(len(fills)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(fills, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column("bin"), batch.column("fill"), pa.array(np.full(len(fills), task, np.int64)), pa.array(rank)], ["bin", "fill", "task", "rank"])

    return run


def _place(plan: list[tuple[int, int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, start, first, each, offset = np.array(plan, np.int64).T
        keys = (length << 44) + start
        for batch in batches:
            fill, rank = (batch.column(c).to_numpy() for c in ("fill", "rank"))
            k = np.searchsorted(keys, (fill << 44) + rank, "right") - 1
            j = rank - start[k]
            yield pa.RecordBatch.from_arrays([batch.column("bin"), pa.array(first[k] + j // each[k]), pa.array(offset[k] + j % each[k] * fill)], ["bin", "into", "shift"])

    return run


def _pack_counts(waiting: DataFrame, capacity: int) -> DataFrame | None:
    """(bin, into, shift) of all waiting (bin, fill) packed together; None if none of them merge.

    The driver sees a count for each fill; each sequence finds its place by its
    rank among those of its fill.
    """
    ranked = stage(waiting.select("bin", "fill").mapInArrow(_rank(capacity), "bin long, fill long, task long, rank long"), "ranked")
    own = ranked.groupBy("task", "fill").agg(F.count(F.lit(1)).alias("n"))
    before = stage(own.select("task", "fill", "n", (F.sum("n").over(Window.partitionBy("fill").orderBy("task")) - F.col("n")).alias("before")), "ranks")
    counts = {r["fill"]: r["n"] for r in before.groupBy("fill").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_counts(counts, capacity)
    if all(each == 1 and offset == 0 for *_, each, offset in plan):
        return None
    at = ranked.join(before.drop("n"), ["task", "fill"]).select("bin", "fill", (F.col("rank") + F.col("before")).alias("rank"))
    return at.mapInArrow(_place(plan), "bin long, into long, shift long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Pieces of `docs` (doc_id, text) and their places in sequences.

    A document's ids, then END_ID; only a longer one is cut, into pieces of
    `capacity`, whatever its length. Result: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. A null or empty text is END_ID alone.
    Repeated rows are each packed; a null doc_id stays null; an empty table
    gives no row. Pieces of one length fill the sequences in the order of
    doc_id, piece and checksum within a task.
    """
    tune(docs.sparkSession)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(ready.mapInArrow(_pack_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"), "pieces")
    # one row for each underfull sequence: the piece at its start
    waiting = pieces.where((F.col("place") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
    parts = pieces.rdd.getNumPartitions()
    moves = None  # bin -> into, shift: only of underfull sequences
    level = 0
    while True:
        level += 1
        parts = -(-parts // FAN_IN)
        if parts == 1:  # the root of the tree, where all that are left meet, however many
            merged = _pack_counts(waiting, capacity)
            if merged is None:
                break
        else:
            merged = waiting.repartition(parts).mapInArrow(_pack_bins(capacity), "bin long, into long, shift long, into_fill long")
        # a sequence number of this level: negative, so it can't equal one of the first
        merged = stage(merged, f"merge-{level}").withColumn("into", -(F.col("into") * 64 + level))
        if moves is None:
            moves = merged.select("bin", "into", "shift")
        else:
            now = merged.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = stage(
                moves.join(now, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")),
                f"moves-{level}",
            )
        if parts == 1:
            break
        waiting = merged.where((F.col("shift") == 0) & (F.col("into_fill") < capacity - slack)).select(F.col("into").alias("bin"), F.col("into_fill").alias("fill"))
    base = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "place")
    if moves is None:
        return base.withColumnsRenamed({"bin": "sequence_id", "place": "offset"})
    return base.join(moves, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
