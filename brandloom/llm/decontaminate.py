"""Benchmark decontamination with one Aho-Corasick automaton.

Item windows (10 consecutive normalised words, or a shorter item whole) become
strings with one character per word, and so does every text: the automaton
then reads each text once, a match's position is a word's position, and word
positions lead back to offsets in the original text.

The benchmark's words lie in the shared folder, in blocks of about `BLOCK_BYTES`;
very long items are cut into pieces that overlap by a window less a word, so
nothing that could match is cut. With one block a worker builds the automaton
once. With more, so that its size has a bound, a task takes some texts at a
time and runs every block's automaton over them before it goes on: the
documents are read once, and nothing is written between blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brandloom.llm.common import keep, new_path, raw, slices, tune

WINDOW = 10
#: Of benchmark text in one automaton: about 100 bytes of nodes a byte.
BLOCK_BYTES = 1 << 20
#: Texts that a task holds while it runs several blocks over them.
HOLD_BYTES = 24 << 20
#: Words of an item in one piece.
PIECE = 1 << 14

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 text; bytes over 127 are word bytes."""
    return text.translate(_FOLD).split()


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Offsets in the original text of ranges of word positions."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    """The automaton over some items: (id as text, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.letter: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            w = "".join(self._letter(x) for x in words_of((text or "").encode()))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(w[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word(w, (len(w), frozenset(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letter:
            n = len(self.letter) + 1
            self.letter[word] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        return self.letter[word]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words, merged ranges of hit words, and the items that occur."""
        w = words_of(text)
        if self.empty or not w:
            return len(w), [], set()
        get = self.letter.get
        ranges, items = [], set()
        for end, (length, ids) in self.automaton.iter("".join([get(x, "\0") for x in w])):
            ranges.append((end + 1 - length, end + 1))
            items |= ids
        return len(w), merged(ranges) if ranges else [], items


def matcher(folder: str, block: int, window: int) -> Matcher:
    """The automaton of a block of items; a Python worker holds the last one it needed."""

    def make() -> Matcher:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
        tables = [pyarrow.parquet.read_table(x.path, filesystem=fs, columns=["item", "words"], partitioning=None) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".parquet")]
        return Matcher(sorted((i, w) for t in tables for i, w in zip(t.column("item").to_pylist(), t.column("words").to_pylist(), strict=True)), window)

    return keep(("items", folder, block, window), make)


def write_items(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> tuple[str, int]:
    """Write the benchmark's words (item, words) to the shared folder by block; the folder and the number of blocks.

    An item's pieces have `piece` words at most, each but the last with all
    windows that start before the next one's first word. Repeated items stand
    once, so a block has about `block_bytes` and a piece at most.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(F.regexp_replace(lower, _SEPARATORS, " "), " "), lambda w: w != "")
    piece = max(piece, window)
    step = piece - window + 1
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).where("size(w) > 0")
    last = F.greatest(F.ceil((F.size("w") - F.lit(window - 1)) / step).cast("int"), F.lit(1)) - 1
    pieces = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("w", k * step + 1, F.lit(piece)), " "))).alias("words")).distinct()
    size = pieces.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    folder = new_path(benchmark.sparkSession, "items")
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
    numbered.repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


_HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _scan(folder: str, blocks: int, window: int, hold: int, names: list[str]):
    def done(held: list[tuple], order: list[int]) -> Iterator[pa.RecordBatch]:
        """Rows of the held slices, by every block in this order."""
        state = []
        for _, texts in held:
            data, offsets = raw(texts)
            at = offsets.tolist()
            state.append((data.tobytes(), at, [0] * (len(at) - 1), [[] for _ in at[1:]], [set() for _ in at[1:]]))
        for block in order:
            found = matcher(folder, block, window)
            for whole, at, n_words, ranges, items in state:
                for i in range(len(at) - 1):
                    n_words[i], hits, ids = found.scan(whole[at[i] : at[i + 1]])
                    if hits:
                        ranges[i] = merged(ranges[i] + hits) if ranges[i] else hits
                        items[i] |= ids
        struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for (part, _), (whole, at, n_words, ranges, items) in zip(held, state, strict=True):
            spans = [spans_of(whole[at[i] : at[i + 1]].decode(), r) for i, r in enumerate(ranges)]
            n_hit = [sum(b - a for a, b in r) for r in ranges]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, struct)],
                [*names, "n_words", "n_hit", "items", "spans"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, order = [], 0, list(range(blocks))
        for batch in batches:
            for part, texts in slices(batch, "text"):
                held.append((part, texts))
                size += texts.nbytes
                if blocks == 1 or size >= hold:
                    yield from done(held, order)
                    held, size = [], 0
                    order.reverse()  # the block at hand comes first next time
        yield from done(held, order)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """`docs` (with a text) plus what of `benchmark` (item_id, text) occurs in it.

    Added: n_words long, n_hit long (words inside any occurrence), items
    array<string> (sorted ids), spans array<struct<start,end>> (code points of
    the original text). Null and empty texts have no words, hence no hits; null
    items are skipped and an empty benchmark hits nothing; a null item_id is an
    empty one. Texts and items of any length are read whole. Repeated rows are
    each scanned; an empty table gives no rows. An added column takes the place
    of one of `docs` with its name.
    """
    tune(docs.sparkSession)
    docs = docs.drop(*_clashing(docs))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(_HITS).fields])
    return docs.mapInArrow(_scan(*write_items(benchmark, window, block_bytes), window, hold_bytes, docs.columns), schema)


def _clashing(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c.lower() in ("n_words", "n_hit", "items", "spans")]


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents that hold no window of the benchmark, unchanged."""
    aside = {c: f"_own_{c}" for c in _clashing(docs)}
    kept = scan(docs.withColumnsRenamed(aside), benchmark, window).where("n_hit = 0")
    return kept.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
