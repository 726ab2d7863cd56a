"""Operator 7: Matroska media columns, written, parsed into packet tables and described.

Texts become payloads of 8-bit samples in a Matroska file: EBML header, Info, one audio track, clusters of laced
SimpleBlocks and cues. The parser walks variable-length EBML elements (of known or unknown size), clusters, SimpleBlocks
and BlockGroups with Xiph, fixed-size or EBML lacing, and the cues; it returns one row per packet with track, timestamp
and byte range. Everything is per row: no shuffle, memory bounded by the largest value.

Defined results: a null text is empty; every payload is padded with spaces to a positive multiple of 192 bytes; a null or
malformed media value has no packets; equal texts give equal values; other columns are ignored.
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

from .common import table

#: Fixed values of the format: element ids of EBML and Matroska.
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_AT = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
UNIT, LACED, BLOCKS, SAMPLES = 192, 64, 8, 8000  # bytes a frame, frames a block, blocks a cluster, samples a second


def size_field(n: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of a width is kept for 'unknown'."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_field(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], style: str) -> tuple[int, bytes]:
    """Flag bits and the body of a block that holds these frames."""
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if style == "fixed":
        if len({len(f) for f in frames}) > 1:
            raise ValueError("fixed-size lacing needs equal frames")
        return 0x04, head + b"".join(frames)
    if style == "xiph":
        return 0x02, head + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    out = head + size_field(len(frames[0]))
    for a, b in zip(frames[:-2], frames[1:-1], strict=True):
        d, width = len(b) - len(a), 1
        while abs(d) > (1 << 7 * width - 1) - 1:
            width += 1
        out += size_field(d + (1 << 7 * width - 1) - 1, width)
    return 0x06, out + b"".join(frames)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    return payload + b" " * (max(unit, -(-len(payload) // unit) * unit) - len(payload))


def write_matroska(payload: bytes, unit: int = UNIT, style: str = "fixed", rate: int = SAMPLES) -> bytes:
    """A one-track Matroska file of 8-bit samples; payload is a multiple of unit."""
    track = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">f", rate)) + number(CHANNELS, 1) + number(DEPTH, 8))
    head = element(INFO, number(SCALE, 1_000_000)) + element(TRACKS, element(TRACK, track))
    clusters, cues, at = [], [], len(head)
    span = unit * LACED * BLOCKS
    for first in range(0, len(payload), span):
        start = first * 1000 // rate
        body = number(TIME, start)
        for a in range(first, min(first + span, len(payload)), unit * LACED):
            part = payload[a : min(a + unit * LACED, first + span)]
            flags, data = lace([part[i : i + unit] for i in range(0, len(part), unit)], style)
            body += element(SIMPLE, b"\x81" + struct.pack(">hB", a * 1000 // rate - start, 0x80 | flags) + data)
        clusters.append(element(CLUSTER, body))
        cues.append(element(POINT, number(CUE_TIME, start) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_AT, at))))
        at += len(clusters[-1])
    kind = element(0x4286, b"\x01") + element(0x42F7, b"\x01") + element(0x42F2, b"\x04") + element(0x42F3, b"\x08") + element(0x4282, b"matroska") + element(0x4287, b"\x04") + element(0x4285, b"\x02")
    return element(EBML, kind) + element(SEGMENT, head + b"".join(clusters) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """Packets as columns (byte ranges refer to the file), tracks, and cues as (time, track, cluster offset in the file)."""

    track: list[np.ndarray] = field(default_factory=list)
    time: list[np.ndarray] = field(default_factory=list)
    at: list[np.ndarray] = field(default_factory=list)
    size: list[np.ndarray] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000

    def columns(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.track, self.time, self.at, self.size))


def vint(data: bytes, at: int, marker: bool) -> tuple[int, int, int]:
    """Value, next position and width of a variable-length integer; marker keeps the length bit, as ids do."""
    if at >= len(data) or not data[at]:
        raise ValueError("malformed EBML integer")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("malformed EBML integer")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if marker else n & (1 << 7 * width) - 1), at + width, width


def packets_of_block(data: bytes, at: int, end: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Track, relative time, positions and sizes of a block's frames."""
    track, at, _ = vint(data, at, False)
    if at + 3 > end:
        raise ValueError("a block ends in its head")
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    style = flags >> 1 & 3
    if not style:
        return track, rel, np.array([at]), np.array([end - at])
    n, at = data[at] + 1, at + 1
    if style == 2:
        each, odd = divmod(end - at, n)
        if odd:
            raise ValueError("fixed-size lacing doesn't divide its block")
        return track, rel, at + each * np.arange(n), np.full(n, each)
    sizes: list[int] = []
    for i in range(n - 1):
        if style == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            v, at, width = vint(data, at, False)
            sizes.append(v if i == 0 else sizes[-1] + v - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes exceed their block")
    s = np.array(sizes)
    return track, rel, at + np.cumsum(s) - s, s


def read_matroska(data: bytes) -> Media:
    """Parse a whole file; unknown sizes reach to the end of what holds them. Raises ValueError where it is malformed."""
    kind, at, _ = vint(data, 0, True)
    if kind != EBML:
        raise ValueError("not an EBML file")
    out = Media()
    state = {"segment": 0, "time": 0, "track": {}, "cue": {}}

    def walk(at: int, end: int, parent: int) -> None:
        while at < end:
            begin = at
            kind, at, _ = vint(data, at, True)
            size, at, width = vint(data, at, False)
            stop = end if size == (1 << 7 * width) - 1 else at + size
            if stop > end:
                raise ValueError("an element exceeds its parent")
            value = lambda: int.from_bytes(data[at:stop], "big")  # noqa: B023, E731
            if kind in MASTERS:
                if kind == SEGMENT:
                    state["segment"] = at
                elif kind == CLUSTER:
                    out.clusters.append(begin)
                elif kind == TRACK:
                    state["track"] = {}
                elif kind == POSITIONS:
                    state["cue"].update(track=0, at=0)
                walk(at, stop, kind)
                if kind == TRACK:
                    out.tracks[state["track"].get("number", 0)] = dict(state["track"])
                elif kind == POSITIONS:
                    out.cues.append((state["cue"].get("time", 0), state["cue"]["track"], state["cue"]["at"] + state["segment"]))
            elif kind in (SIMPLE, BLOCK):
                track, rel, where, sizes = packets_of_block(data, at, stop)
                info = out.tracks.get(track, {})
                before = np.cumsum(sizes) - sizes if info.get("depth") else np.zeros(len(sizes), np.int64)
                a_second = max(1, int(info.get("rate", 1)) * int(info.get("channels", 1)) * int(info.get("depth", 8)) // 8)
                out.track.append(np.full(len(where), track))
                out.time.append(state["time"] + rel + before * 1_000_000_000 // (a_second * out.scale))
                out.at.append(where)
                out.size.append(sizes)
            elif kind == TIME and parent == CLUSTER:
                state["time"] = value()
            elif kind == SCALE:
                out.scale = max(1, value())
            elif kind == NUMBER:
                state["track"]["number"] = value()
            elif kind == CODEC:
                state["track"]["codec"] = data[at:stop].decode("ascii", "replace")
            elif kind == RATE:
                state["track"]["rate"] = struct.unpack(">f" if size == 4 else ">d", data[at:stop])[0]
            elif kind == CHANNELS:
                state["track"]["channels"] = value()
            elif kind == DEPTH:
                state["track"]["depth"] = value()
            elif kind == CUE_TIME:
                state["cue"] = {"time": value()}
            elif kind == CUE_TRACK:
                state["cue"]["track"] = value()
            elif kind == CUE_AT:
                state["cue"]["at"] = value()
            at = stop

    size, at, _ = vint(data, at, False)
    try:
        walk(at + size, len(data), 0)
    except (IndexError, struct.error) as e:
        raise ValueError("malformed Matroska file") from e
    return out


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    number, _, at, size = media.columns()
    mine = number == track
    at, size = at[mine], size[mine]
    if len(at) and (size == size[0]).all():
        rows = np.frombuffer(data, np.uint8)
        return rows[(at[:, None] + np.arange(size[0]))].tobytes()
    return b"".join(data[a : a + s] for a, s in zip(at.tolist(), size.tolist(), strict=True))


def tail_of(data: bytes, media: Media, n: int, track: int = 1) -> bytes:
    """The last n bytes of a track: from the cluster of its last cue on, earlier cues only where that holds too little."""
    out = b""
    for _, _, start in sorted((c for c in media.cues if c[1] == track), key=lambda c: -c[2]):
        kind, at, _ = vint(data, start, True)
        size, at, _ = vint(data, at, False)
        if kind != CLUSTER:
            raise ValueError("a cue points to no cluster")
        parts, end = [], at + size
        while at < end:
            kind, at, _ = vint(data, at, True)
            size, at, _ = vint(data, at, False)
            if kind == SIMPLE:
                number, _, where, sizes = packets_of_block(data, at, at + size)
                if number == track:
                    parts.append(data[int(where[0]) : int(where[-1] + sizes[-1])])  # frames of a block stand together
            at += size
        out = b"".join(parts) + out
        if len(out) >= n:
            break
    return out[-n:]


def describe(payload: bytes, media: Media) -> str:
    """Features of the packets and the samples read back."""
    _, time, _, size = media.columns()
    x = np.frombuffer(payload, np.uint8).astype(np.int16)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / max(1, len(x))
    centred = x >= 128
    return (
        f"packets={len(size)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={int(time[-1]) if len(time) else 0}"
        f";mean={x.mean() if len(x) else 0:.6f};std={x.std() if len(x) else 0:.6f};peak={int(x.max(initial=0))}"
        f";crossings={int((centred[1:] != centred[:-1]).sum())};entropy={float(-(p * np.log2(p)).sum()):.6f}"
    )


def packet_table(df: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet of a binary Matroska column: (key, track, timestamp_ms, first_byte, n_bytes, cue)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                data = value.as_py()
                try:
                    media = read_matroska(data) if data else Media()
                except ValueError:
                    media = Media()
                track, time, at, size = media.columns()
                starts = {int(np.searchsorted(at, c)) for _, _, c in media.cues}
                for a in range(0, len(at), 50_000):
                    b = min(a + 50_000, len(at))
                    keys = pa.array([batch.column(0)[i].as_py()] * (b - a), batch.column(0).type)
                    ms = time[a:b] * media.scale // 1_000_000
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(x.astype(np.int64)) for x in (track[a:b], ms, at[a:b], size[a:b])), pa.array([j in starts for j in range(a, b)])], [key, "track", "timestamp_ms", "first_byte", "n_bytes", "cue"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, track long, timestamp_ms long, first_byte long, n_bytes long, cue boolean")


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            for a in range(0, len(raw), 256):
                part = raw[a : a + 256]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array([len(r) for r in part], pa.int64()), pa.array([write_matroska(pad(r)) for r in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, n_bytes, media), all from the parsed file."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                data = value.as_py() or b""
                try:
                    media = read_matroska(data)
                except ValueError:
                    media = Media()
                payload = payload_of(data, media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail_of(data, media, 16)), len(data), hashlib.sha256(data).hexdigest(), describe(payload, media)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            found = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], [c.split()[0] for c in schema.split(", ")])

    return stored.mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table(spark, sf_dir, "documents")))
