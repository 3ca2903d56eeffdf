"""Media columns: Matroska files in a binary column, written and parsed without libraries.

`mux` wraps bytes as 8-bit PCM samples: EBML header, one segment with info,
one audio track, cues and clusters of laced blocks. `demux` reads any file of
that kind back into packets with track, timestamp and byte range: variable
length ids and sizes, unknown sizes, simple blocks and block groups, and all
four kinds of lacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandloom.llm.common import new_path, raw, slices, tune

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, TRACK_NUMBER, DEFAULT_DURATION, CODEC = 0x2AD7B1, 0x4489, 0xD7, 0x23E383, 0x86
SEEK_HEAD, TAGS, ATTACHMENTS, CHAPTERS, VOID = 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770, 0xEC
TOP = frozenset({INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, ATTACHMENTS, CHAPTERS})

UNIT = 64  #: payloads are padded to a multiple of it
RATE = 8000  #: samples, one byte each, a second
FRAME = 8 * UNIT  #: 64 ms
LACED = 8  #: frames in a block
BLOCKS = 8  #: blocks in a cluster
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)


class Packet(NamedTuple):
    track: int
    timestamp: int  # ns
    duration: int  # ns, 0 if the track doesn't say
    offset: int  # of its bytes in the file
    size: int
    cluster: int
    keyframe: bool


class Movie(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, offset of the cluster in the file
    clusters: list[int]  # offsets
    codecs: dict[int, str]
    duration: int  # ns


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of a block with their sizes, after the block's header."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            step = n - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
            head += size_bytes(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def simple_block(track: int, ms: int, frames: list[bytes], kind: int | None = None) -> bytes:
    if kind is None:
        sizes = {len(x) for x in frames}
        kind = NO_LACING if len(frames) == 1 else FIXED if len(sizes) == 1 else EBML_LACING
    return element(SIMPLE_BLOCK, size_bytes(track) + struct.pack(">hB", ms, 0x80 | kind << 1) + lace(frames, kind))


_HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK,
        number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + number(0x9F, 1) + number(0x6264, 8)),
    ),
)


def padded(text: bytes) -> bytes:
    """Zero bytes behind, up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def mux(payload: bytes) -> bytes:
    """A file whose packets, in order, are the payload."""
    per_ms = RATE // 1000
    clusters, times = [], []
    span = FRAME * LACED * BLOCKS
    for c in range(0, len(payload), span):
        blocks = []
        for b in range(c, min(c + span, len(payload)), FRAME * LACED):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + FRAME * LACED, len(payload)), FRAME)]
            blocks.append(simple_block(1, (b - c) // per_ms, frames))
        times.append(c // per_ms)
        clusters.append(element(CLUSTER, number(TIMESTAMP, c // per_ms) + b"".join(blocks)))
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / per_ms)) + element(0x4D80, b"brandloom") + element(0x5741, b"brandloom"))

    def cues(first: int) -> bytes:
        points, at = [], first
        for ms, cluster in zip(times, clusters, strict=True):
            where = element(CUE_CLUSTER, at.to_bytes(8, "big"))  # a fixed width, so the cues' size doesn't hang on it
            points.append(element(CUE_POINT, number(CUE_TIME, ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + where)))
            at += len(cluster)
        return element(CUES, b"".join(points))

    before = len(info) + len(_TRACKS)
    index = cues(before + len(cues(0)))
    return _HEADER + element(SEGMENT, info + _TRACKS + index + b"".join(clusters))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element id with its length marker, and what follows it."""
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer without its marker (None: unknown), and what follows."""
    if at >= len(data):
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no size at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") ^ (1 << 7 * width)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, end) of each element in a range; one of unknown size
    ends where an element of `stop` begins, or with the range."""
    while at < end:
        start = at
        kind, at = read_id(data, at)
        size, at = read_size(data, at)
        body = at
        if size is None:
            at = end
            if kind == CLUSTER:
                for k, s, _, _ in elements(data, body, end):
                    if k in stop:
                        at = s
                        break
        else:
            at = body + size
            if at > end:
                raise ValueError(f"the element at byte {start} goes beyond its parent")
        yield kind, start, body, at


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[b - a], data[a:b])[0] if b > a else 0.0


def frames_of(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames in a block's body from its lacing on."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACING:
        if n > 1:
            size, at = read_size(data, at)
            if size is None:
                raise ValueError(f"the first laced frame at byte {at} has no size")
            sizes.append(size)
            for _ in range(n - 2):
                width = 9 - data[at].bit_length()
                step = int.from_bytes(data[at : at + width], "big") ^ (1 << 7 * width)
                sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
                at += width
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or kind == FIXED and len(set(sizes)) > 1:
        raise ValueError(f"the laces of the block at byte {at} don't fit")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Movie:
    """Packets and cues of a file; ValueError if it isn't well formed."""
    try:
        return _demux(data)
    except (IndexError, KeyError, OverflowError, struct.error) as e:
        raise ValueError(f"a part of the file is missing: {e}") from e


def _demux(data: bytes) -> Movie:
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    packets: list[Packet] = []
    cues, clusters, codecs, each = [], [], {}, {}
    scale, duration = 1_000_000, 0.0
    for kind, _, body, end in top:
        if kind != SEGMENT:
            continue
        base = body
        for part, start, a, z in elements(data, body, end, TOP):
            if part == INFO:
                for k, _, x, y in elements(data, a, z):
                    if k == SCALE:
                        scale = _unsigned(data, x, y)
                    elif k == DURATION:
                        duration = _float(data, x, y)
            elif part == TRACKS:
                for k, _, x, y in elements(data, a, z):
                    if k == TRACK:
                        own = {i: (p, q) for i, _, p, q in elements(data, x, y)}
                        track = _unsigned(data, *own[TRACK_NUMBER])
                        codecs[track] = data[slice(*own[CODEC])].decode("ascii", "replace") if CODEC in own else ""
                        each[track] = _unsigned(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0
            elif part == CUES:
                for k, _, x, y in elements(data, a, z):
                    if k == CUE_POINT:
                        time = 0
                        for i, _, p, q in elements(data, x, y):
                            if i == CUE_TIME:
                                time = _unsigned(data, p, q)
                            elif i == CUE_POSITIONS:
                                own = {e: (s, t) for e, _, s, t in elements(data, p, q)}
                                cues.append((time * scale, _unsigned(data, *own[CUE_TRACK]), base + _unsigned(data, *own[CUE_CLUSTER])))
            elif part == CLUSTER:
                clusters.append(start)
                since = 0
                for k, _, x, y in elements(data, a, z):
                    if k == TIMESTAMP:
                        since = _unsigned(data, x, y)
                        continue
                    if k == BLOCK_GROUP:
                        inner = next(((p, q) for i, _, p, q in elements(data, x, y) if i == BLOCK), None)
                        if inner is None:
                            continue
                        x, y = inner
                    elif k != SIMPLE_BLOCK:
                        continue
                    track, x = read_size(data, x)
                    if track is None:
                        raise ValueError(f"the block at byte {x} has no track")
                    relative, flags = struct.unpack_from(">hB", data, x)
                    step = each.get(track, 0)
                    time = (since + relative) * scale
                    for i, (offset, size) in enumerate(frames_of(data, x + 3, y, flags >> 1 & 3)):
                        packets.append(Packet(track, time + i * step, step, offset, size, len(clusters) - 1, k == SIMPLE_BLOCK and bool(flags & 0x80)))
    return Movie(packets, cues, clusters, codecs, int(duration * scale))


def feature(payload: bytes, movie: Movie) -> str:
    """Packets, clusters, cues, length and simple statistics of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    total, squares = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    return f"packets={len(movie.packets)};clusters={len(movie.clusters)};cues={len(movie.cues)};ms={movie.duration // 1_000_000};sum={total};squares={squares};crossings={crossings};peak={int(x.max(initial=0))}"


def encode(docs: DataFrame, compression: str = "zstd") -> DataFrame:
    """(doc_id, n_bytes, media) of docs (doc_id, text), written and read back.

    media is each whole text's file, however long; a null or empty text gives
    one unit of zeros. Repeated rows are each stored, equal texts as equal
    files; a null doc_id stays null, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                data, offsets = raw(texts)
                whole, at = data.tobytes(), offsets.tolist()
                media = [mux(padded(whole[a:b])) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    spark = tune(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    path = new_path(spark, "media")
    made.write.option("compression", compression).parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def packets(media: DataFrame) -> DataFrame:
    """The packet table of media (doc_id, media): one row per packet.

    (doc_id, packet, track, codec, timestamp, duration, offset, size, cluster,
    keyframe); times in ns. A null file has no packets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, file in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if file is not None:
                    movie = demux(file)
                    rows += [(doc, i, p.track, movie.codecs.get(p.track, ""), p.timestamp, p.duration, p.offset, p.size, p.cluster, p.keyframe) for i, p in enumerate(movie.packets)]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            names = ["doc_id", "packet", "track", "codec", "timestamp", "duration", "offset", "size", "cluster", "keyframe"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    tune(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, packet int, track int, codec string, timestamp long, duration long, offset long, size long, cluster int, keyframe boolean"
    )


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of media (doc_id, n_bytes, media), one row each.

    The payload is put together from the packets' byte ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column("media").to_pylist():
                movie = demux(file)
                payload = b"".join([file[p.offset : p.offset + p.size] for p in movie.packets])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(payload, movie)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names]
            )

    tune(media.sparkSession)
    return media.where("media IS NOT NULL").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
