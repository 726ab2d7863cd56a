"""Operator 8: token-id files, a concatenated id array with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by doc_id and a hash of the text, so a repeated or null doc_id is spread too;
partitions follow the input's bytes as the plan estimates them. Every task encodes its documents and writes shards of at
most SHARD_IDS ids (one longer document makes a longer shard), one binary value each, in a table in the shared folder:
files reach any store Spark reaches, and a retried task leaves no half-written shard. Offsets inside a shard are selected
from its Elias-Fano code: the bits between two of its samples (every SAMPLE documents) give the boundaries in between, so
a reader goes through a shard in steps and never holds a table of all offsets. A shard holds its place within its
partition, and one row per partition (at most 100,000, or spark.sql.shuffle.partitions) places the partitions.

Defined results: a null text is empty and yields the end id alone; null doc_ids come first; repeated doc_ids stay
separate documents, ordered by a hash of their text; an empty table yields no shard and no row; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, table
from .tokens import memo

SHARD_IDS, PARTITION = 1 << 20, 1 << 27
END = 2
SAMPLE = 256
MAGIC = b"ZEF1"


@dataclass
class EliasFano:
    """A non-decreasing sequence below 2**63 in about n * (2 + log2(universe / n)) bits, with sampled select."""

    n: int
    bits: int
    low: np.ndarray  # packed low bits
    high: np.ndarray  # unary high parts, packed
    samples: np.ndarray  # bit position of every SAMPLE-th one

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.bits, last * self.bits
        bit = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a].reshape(-1, self.bits)
        return (bit.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def between(self, first: int, last: int) -> np.ndarray:
        """The values numbered first to last - 1, from the bits between the samples around them only."""
        block, stop = first // SAMPLE, -(-last // SAMPLE)
        if first >= last:
            return np.zeros(0, np.int64)
        at = int(self.samples[block])
        end = int(self.samples[stop]) if stop < len(self.samples) else len(self.high) * 8
        byte = at // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (end + 7) // 8], bitorder="little")[at % 8 :]) + at
        number = np.arange(first, last)
        return ((ones[number - block * SAMPLE] - number).astype(np.uint64) << np.uint64(self.bits) | self._lows(first, last)).astype(np.int64)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.between(i, i + 1)[0])

    def dumps(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def loads(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high, samples = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (samples, np.dtype("<u4"))):
            parts.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(n, bits, *parts), at


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """doc_ids ascending with nulls first; ids of each document, all of one unsigned type of two or four bytes."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    keys = EliasFano.of((known - least).astype(np.uint64))
    ends = EliasFano.of(np.cumsum([0, *map(len, ids)]))
    body = np.concatenate(ids)
    return MAGIC + struct.pack("<BQq", body.itemsize, len(doc_ids) - len(known), least) + keys.dumps() + ends.dumps() + body.tobytes()


@dataclass
class Shard:
    """A shard as it is stored: document keys and boundaries stay Elias-Fano coded, ids stay in their array."""

    nulls: int
    least: int
    keys: EliasFano
    ends: EliasFano
    ids: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        width, nulls, least = struct.unpack_from("<BQq", data, 4)
        keys, at = EliasFano.loads(data, 4 + struct.calcsize("<BQq"))
        ends, at = EliasFano.loads(data, at)
        return cls(nulls, least, keys, ends, np.frombuffer(data, f"<u{width}", -1, at))

    def __len__(self) -> int:
        return self.ends.n - 1

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        known = self.keys.between(max(0, first - self.nulls), max(0, last - self.nulls)) + self.least
        return [None] * (min(last, self.nulls) - min(first, self.nulls)) + known.tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select."""
        a, b = self.ends.between(i, i + 2)
        return self.ids[a:b]


def write_token_files(docs: DataFrame, tokenizer: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shard table (part, shard, base, n_docs, n_ids, content) of docs (doc_id, text); base counts ids before it in its part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part = memo(tokenizer), TaskContext.get().partitionId()
        width = 2 if m.model_size <= 1 << 16 and end < 1 << 16 else 4
        keys: list[int | None] = []
        rows: list[np.ndarray] = []
        size = base = shard = 0

        def flush() -> pa.RecordBatch:
            out = {"part": [part], "shard": [shard], "base": [base], "n_docs": [len(keys)], "n_ids": [size], "content": [write_shard(keys, rows)]}
            return pa.RecordBatch.from_pydict(out, schema=SHARDS)

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), m.encode_column(batch.column(1), end), strict=True):
                if rows and size + len(x) > shard_ids:
                    yield flush()
                    base, shard, size, keys, rows = base + size, shard + 1, 0, [], []
                keys.append(key)
                rows.append(x.astype(f"<u{width}"))
                size += len(x)
        if rows:
            yield flush()

    SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the plan's estimate; no job
    most = max(partitions(docs), min(-(-known // PARTITION), 100_000)) if known < 1 << 60 else partitions(docs)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(most, *order).sortWithinPartitions(*order)
    return materialise(dealt.mapInArrow(write, "part int, shard int, base long, n_docs long, n_ids long, content binary"), "token-files")


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the shards' own boundaries and ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard.of(content.as_py())
                for first in range(0, len(shard), 16 * SAMPLE):
                    last = min(first + 16 * SAMPLE, len(shard))
                    at = shard.ends.between(first, last + 1)
                    crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(first, last), pa.int64()), pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per partition
    places = [(r["part"], r["n"]) for r in parts.orderBy("part").collect()]
    before, rows = 0, []
    for part, n in places:
        rows.append((part, before))
        before += n
    first = shards.sparkSession.createDataFrame(rows, "part int, before long")
    placed = shards.join(F.broadcast(first), "part").select((F.col("before") + F.col("base")).alias("first"), "content")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(shards)
