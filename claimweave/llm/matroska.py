"""Matroska files in binary columns: parse EBML into packet tables, and write 8-bit sound as packets.

The parser walks variable-length elements, those of unknown size included, and lists each frame of each block with
its track, timestamp and byte range: unlaced, Xiph-, EBML- and fixed-size-laced. Cues are listed as they stand.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import table

# Fixed values of the format: element ids with their length marks.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: Elements of the top level, at which a cluster of unknown size ends.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}


class Malformed(ValueError):
    pass


def read_vint(data: bytes, at: int, end: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """(value, position after it, whether all its value bits are 1, which as a size means unknown)."""
    if at >= end or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise Malformed(f"the integer at {at} is cut off")
    value = int.from_bytes(data[at : at + length], "big")
    bits = value & ((1 << 7 * length) - 1)
    return value if keep_mark else bits, at + length, bits == (1 << 7 * length) - 1


def elements(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of the body, end of it, whether its size is unknown) of each element; an element in stop ends the list."""
    while at < end:
        ident, body, _ = read_vint(data, at, end, keep_mark=True)
        if ident in stop:
            return
        size, body, unknown = read_vint(data, body, end)
        if unknown:
            yield ident, body, end, True
            return
        if body + size > end:
            raise Malformed(f"the element at {at} is longer than what holds it")
        yield ident, body, body + size, False
        at = body + size


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of a block's frames; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise Malformed("a lace has no count of frames")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % count:
            raise Malformed("a fixed-size lace doesn't divide its block")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if kind == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Malformed("a lace is cut off")
                    size += data[at]
                    at += 1
                    if data[at - 1] < 255:
                        break
            else:
                start = at
                value, at, _ = read_vint(data, at, end)
                size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laces are longer than their block")
    starts = np.cumsum([at, *sizes])
    return [(int(s), n) for s, n in zip(starts, sizes, strict=False)]


@dataclass
class Parsed:
    scale: int = 1_000_000
    tracks: list[tuple[int, str]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)  # track, time in ns, offset, size, cluster, key frame
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, the cluster's offset
    error: str | None = None


def _number(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise Malformed("a number has more than eight bytes")
    return int.from_bytes(data[at:end], "big")


def _fits(*values: int) -> tuple[int, ...]:
    """The values, which tables hold as signed 64-bit numbers."""
    if any(not -(1 << 63) <= v < 1 << 63 for v in values):
        raise Malformed("a value is beyond 64 bits")
    return values


def _block(data: bytes, at: int, end: int, base: int, cluster: int, out: Parsed, key_frame: bool | None, frame_ns: dict[int, int]) -> None:
    """List a block's frames. key_frame: whether they are, or None where the block's flags say it."""
    track, at, _ = read_vint(data, at, end)
    if at + 3 > end:
        raise Malformed("a block is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    time = (base + relative) * out.scale
    for k, (offset, size) in enumerate(laces(data, at + 3, end, flags >> 1 & 3)):
        out.packets.append((*_fits(track, time + k * frame_ns.get(track, 0)), offset, size, cluster, bool(flags & 0x80) if key_frame is None else key_frame))


def parse(data: bytes) -> Parsed:
    """Tables of a whole file. What stands before damage is kept, and error says where reading ended."""
    out, frame_ns = Parsed(), {}
    number = lambda a, b: _number(data, a, b)

    def cluster(at: int, end: int, index: int) -> int:
        base = 0
        for ident, a, b, _ in elements(data, at, end, TOP):
            at = b
            if ident == CLUSTER_TIMESTAMP:
                base = number(a, b)
            elif ident == SIMPLE_BLOCK:
                _block(data, a, b, base, index, out, None, frame_ns)
            elif ident == BLOCK_GROUP:
                inner = list(elements(data, a, b))
                for kind, c, d, _ in inner:
                    if kind == BLOCK:  # a frame that refers to another one is no key frame
                        _block(data, c, d, base, index, out, all(x[0] != REFERENCE_BLOCK for x in inner), frame_ns)
        return at

    def segment(at: int, end: int) -> None:
        origin, index = at, 0
        while at < end:
            ident, a, b, unknown = next(elements(data, at, end))
            if ident == CLUSTER:
                at = cluster(a, b, index) if unknown else b
                if not unknown:
                    cluster(a, b, index)
                index += 1
                continue
            if ident == INFO:
                out.scale = next((number(c, d) for i, c, d, _ in elements(data, a, b) if i == TIMESTAMP_SCALE), out.scale)
            elif ident == TRACKS:
                for i, c, d, _ in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        own = {x: (p, q) for x, p, q, _ in elements(data, c, d)}
                        track = number(*own.get(TRACK_NUMBER, (0, 0)))
                        out.tracks.append((track, data[slice(*own.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")))
                        frame_ns[track] = number(*own.get(DEFAULT_DURATION, (0, 0)))
            elif ident == CUES:
                for i, c, d, _ in elements(data, a, b):
                    own = [(x, p, q) for x, p, q, _ in elements(data, c, d)] if i == CUE_POINT else []
                    time = next((number(p, q) for x, p, q in own if x == CUE_TIME), 0)
                    for x, p, q in own:
                        if x == CUE_TRACK_POSITIONS:
                            place = {y: number(r, s) for y, r, s, _ in elements(data, p, q)}
                            out.cues.append(_fits(time * out.scale, place.get(CUE_TRACK, 0), origin + place.get(CUE_CLUSTER_POSITION, 0)))
            at = b

    try:
        for ident, a, b, _ in elements(data, 0, len(data)):
            if ident == SEGMENT:
                segment(a, b)
    except Malformed as e:
        out.error = str(e)
    return out


def _id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


def vint(value: int, length: int = 0) -> bytes:
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    body = body.encode() if isinstance(body, str) else body
    return _id(ident) + vint(len(body)) + body


#: Samples a second, samples in a frame, frames in a block, blocks in a cluster. A frame lasts 512 ms, and a block's time in its cluster fits 16 bits.
RATE, FRAME, LACED, BLOCKS = 8_000, 4_096, 8, 7


def lace_block(track: int, relative: int, frames: list[bytes], kind: int | None = None) -> bytes:
    """A SimpleBlock's body. kind as in laces(); by itself fixed for frames of one size, else EBML."""
    sizes = [len(f) for f in frames]
    if kind is None:
        kind = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = vint(track) + struct.pack(">hB", relative, 0x80 | kind << 1)
    if kind == 0:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(b - a) < 1 << 7 * n - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def write_sound(samples: bytes) -> bytes:
    """A file of one track of unsigned 8-bit samples; equal samples give equal files."""
    head = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(EBML_MAX_ID, 4) + element(EBML_MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
    sound = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8)
    entry = element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + element(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(AUDIO, sound)
    parts = [element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, "claimweave") + element(WRITING_APP, "claimweave")), element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    step = FRAME * LACED * BLOCKS
    for start in range(0, len(samples), step):
        time, blocks = start * 1000 // RATE, []
        for block in range(start, min(start + step, len(samples)), FRAME * LACED):
            frames = [samples[k : k + FRAME] for k in range(block, min(block + FRAME * LACED, len(samples)), FRAME)]
            blocks.append(element(SIMPLE_BLOCK, lace_block(1, block * 1000 // RATE - time, frames)))
        parts.append(element(CLUSTER, element(CLUSTER_TIMESTAMP, time) + b"".join(blocks)))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


PACKET = "struct<track: long, time_ns: long, offset: long, size: long, cluster: int, key_frame: boolean>"
CUE = "struct<time_ns: long, track: long, cluster_offset: long>"
BATCH = 200


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def packets(media: DataFrame, keys: list[str], media_col: str = "media") -> DataFrame:
    """(keys, media, packets array, cues array, error): the tables of each row's file; explode them for rows.

    A null file has no packets and no error. Damaged files, also those with times or places beyond 64 bits, keep what
    stands before the damage. Repeated rows each keep their row, an empty table gives none; a file is parsed in one
    piece, however long. keys may have any name but those of the results.
    """
    kinds = [pa.list_(pa.struct([("track", pa.int64()), ("time_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("cluster", pa.int32()), ("key_frame", pa.bool_())])), pa.list_(pa.struct([("time_ns", pa.int64()), ("track", pa.int64()), ("cluster_offset", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            found = [parse(v.as_py()) if v.is_valid else Parsed() for v in batch.column("media")]
            tables = [pa.array([[dict(zip([f.name for f in kind.value_type], row, strict=True)) for row in rows] for rows in got], kind) for kind, got in zip(kinds, ([p.packets for p in found], [p.cues for p in found]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *tables, pa.array([p.error for p in found], pa.string())], [*batch.schema.names, "packets", "cues", "error"])

    wanted = media.select(*keys, F.col(media_col).alias("media"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.mapInArrow(run, f"{kept}, packets array<{PACKET}>, cues array<{CUE}>, error string")


def sound_column(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as samples.

    Null texts count as empty; equal texts give equal files; very long ones take more clusters; null keys and repeated
    rows stay; an empty table gives no rows; keys may have any name but n_bytes and media. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            raw = [(v.as_py() or "").encode() for v in batch.column("text")]
            media = [write_sound(x + bytes(max(64, -len(x) // 64 * -64) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names[:-1], "n_bytes", "media"])

    wanted = docs.select(*keys, F.col(text_col).alias("text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(run, f"{kept}n_bytes long, media binary")


def sound_features(samples: bytes, n_packets: int) -> str:
    if not samples:
        return f"packets={n_packets};ms=0;peak=0;energy=0;crossings=0"
    centred = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"packets={n_packets};ms={len(samples) * 1000 // RATE};peak={int(np.abs(centred).max())};energy={int((centred * centred).sum()) // len(samples)};crossings={crossings}"


def payload_digests(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Digests and features of the samples that the packets' byte ranges hold: one row for each row of parsed.

    A null file has null figures; one without packets, such as a damaged one, those of no samples. Null keys and
    repeated rows stay; an empty table gives no rows; columns of parsed beyond keys, media and packets aren't read.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, table_ in zip(batch.column("media"), batch.column("ranges"), strict=True):
                if not media.is_valid:
                    rows.append((None,) * 6)
                    continue
                stored, ranges = media.as_py(), table_.values
                read = b"".join(stored[a : a + n] for a, n in zip(ranges.field("offset").to_pylist(), ranges.field("size").to_pylist(), strict=True))
                rows.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), sound_features(read, len(ranges))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keys, *names])

    wanted = parsed.select(*keys, "media", F.transform("packets", lambda p: F.struct(p["offset"].alias("offset"), p["size"].alias("size"))).alias("ranges"))
    kept = "".join(f"`{k}` {parsed.schema[k].dataType.simpleString()}, " for k in keys)
    return wanted.mapInArrow(run, kept + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["doc_id", "n_bytes"]
    return payload_digests(packets(sound_column(table(spark, sf_dir, "documents"), ["doc_id"]), keys), keys)
