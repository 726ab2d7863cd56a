"""Operator 5: removal of repeated passages by fixed-block anchors.

A repeat of `window` words holds, wherever it starts, a whole block of half as many words that starts at a multiple of
that number in its own document. These non-overlapping blocks are the index; every rolling window of their length probes
it. Blocks met at two places or more are anchors. A window of `window` words can repeat only if every block inside it is
an anchor; such windows, together the maximal extensions of anchors, are then counted by 64-bit hashes, and those met at
two places once more by a second, independent hash. Words under a window that starts at two places are removed.

So windows are equal if 128 bits are. Of N windows, M of them met twice by the first hash, each is taken wrongly with a
probability of at most N * M / 2**128: at 100 TB (N about 1.6e13, M a tenth of it) not one in the whole corpus is to be
expected, even without the anchors' selection.

Scale: documents are gathered in packs of about PACK words, compressed and written once; the pack is the unit of all
passes. A pack sends each hash range that it has hashes in its sorted distinct ones, coded as differences; a range answers
with a bit per hash. So hot passages cost one entry per pack, a pass moves about three bytes per word once and bits back,
and every task holds one pack or one range (their number follows the corpus). A pack takes the places that it still asks about to
its next pass, a bit per word, so no pass does an earlier one's work again. The anchor pass cuts hashes to the bits that
keep chance meetings rare; it only selects.

Defined results: a null or empty text has no words, 0 removed and the digest of nothing; documents of fewer words than the
window are kept whole; repeated rows remove each other's windows (all copies, the first included); rows with a null doc_id
take part; an empty table gives no rows; other columns are ignored; a very long text is a pack of its own, held whole in
memory of some 60 bytes per character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix, partitions, table, text_buffers
from .words import byte_sums, prefix_sums, run_hashes, word_hashes

WINDOW, PACK, RANGE, NOTE = 35, 400_000, 6_000_000, -1
PACK_SCHEMA = "pack long, words long, body binary"


def make_packs(docs: DataFrame, size: int = PACK) -> DataFrame:
    """(pack, words, body): documents of about `size` words together, as compressed Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        words = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            body = zstandard.compress(sink.getvalue().to_pybytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([words], pa.int64()), pa.array([body], pa.binary())], ["pack", "words", "body"])

        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            first = 0
            while first < batch.num_rows:  # about six bytes a word
                last = int(np.searchsorted(offsets, offsets[first] + max(1, size - words) * 6, side="right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                held.append(batch.slice(first, last - first))
                words += int(offsets[last] - offsets[first]) // 6 + last - first
                first = last
                if words >= size:
                    yield flush()
                    number, held, words = number + 1, [], 0
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PACK_SCHEMA)


class Pack:
    """Words of a pack and the hashes of runs of them."""

    def __init__(self, body: bytes):
        self.table = pa.ipc.open_stream(zstandard.decompress(body)).read_all().combine_chunks()
        column = self.table["text"].combine_chunks() if self.table.num_rows else pa.array([], pa.string())
        self.raw, self.offsets = text_buffers(column)
        h, self.row, self.start, self.end = word_hashes(self.raw, self.offsets)
        self.sums = prefix_sums(h)
        self.count = np.bincount(self.row, minlength=len(self.offsets) - 1)
        first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.row)) - np.repeat(first, self.count)  # of a word in its document
        self.left = np.repeat(self.count, self.count) - self.place  # words from here to the document's end

    def runs(self, length: int) -> np.ndarray:
        """Where runs of `length` words start."""
        return np.flatnonzero(self.left >= length)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return run_hashes(self.sums, at, at + length)

    def second(self, at: np.ndarray, length: int) -> np.ndarray:
        """Other 64-bit hashes of the same runs, from other hashes of the words and joined with the first."""
        if not len(at):
            return np.zeros(0, np.uint64)
        sums = prefix_sums(run_hashes(byte_sums(self.raw, 1), self.start, self.end, 1), 1)
        return mix(run_hashes(sums, at, at + length, 1) + self.hashes(at, length) * np.uint64(0x9E3779B97F4A7C15))


def code(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 as differences, in byte planes, so that their idle upper bytes compress."""
    d = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def decode(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, -1, 1).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    return np.cumsum(d.view("<u8").ravel().astype(np.uint64))


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x, bitorder="little").tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


def ask(number: int, values: np.ndarray, wanted: np.ndarray | None, ranges: int, width: int) -> Iterator[tuple]:
    """Rows (range, pack, hashes, twice, wanted) for the values of a pack; wanted marks those to be answered (all)."""
    order = np.argsort(values)
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    distinct = v[at]
    twice = np.diff(np.append(at, len(v))) > 1
    asked = np.ones(len(at), bool) if wanted is None else np.logical_or.reduceat(wanted[order], at) if len(at) else np.zeros(0, bool)
    # ranges divide the values evenly by their upper 32 bits; only those that hold a value are gone through
    upper = distinct >> np.uint64(width - 32) if width > 32 else distinct << np.uint64(32 - width)
    own = (upper * np.uint64(ranges)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(own, prepend=own[:1] - np.uint64(1)) != 0)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(distinct)], strict=True) if len(distinct) else ():
        yield int(own[a]), number, code(distinct[a:b]), bits(twice[a:b]), bits(asked[a:b])


def note(number: int, at: np.ndarray, n: int, ranges: int) -> tuple:
    """A row beside those of ask() that brings places among n words to the pack's next pass."""
    marks = np.zeros(n, bool)
    marks[at] = True
    return -1 - number % ranges, number, bits(marks), b"", b""


def answer(asked: DataFrame, ranges: int) -> DataFrame:
    """(pack, range, hits): a bit for each asked-for hash of a pack in a range, set where it starts at two places; notes as they are."""
    schema = "pack long, range int, hits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            sets = [decode(x[1]) for x in held]
            size = [len(s) for s in sets]
            every = np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            v = every[order]
            new = np.ones(len(v), bool)
            new[1:] = v[1:] != v[:-1]
            at = np.flatnonzero(new)
            twice = np.concatenate([unbits(x[2], n) for x, n in zip(held, size, strict=True)])
            many = (np.diff(np.append(at, len(v))) > 1) | np.logical_or.reduceat(twice[order], at)
            hit = np.empty(len(v), bool)
            hit[order] = np.repeat(many, np.diff(np.append(at, len(v))))
            first = 0
            for x, n in zip(held, size, strict=True):
                wanted = unbits(x[3], n)
                yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([now], pa.int32()), pa.array([bits(hit[first : first + n][wanted])], pa.binary())], ["pack", "range", "hits"])
                first += n

        for batch in batches:
            for i, r in enumerate(batch.column(0).to_pylist()):
                if r < 0:  # a pack's own note
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), pa.array([NOTE], pa.int32()), batch.column(2).slice(i, 1)], ["pack", "range", "hits"])
                    continue
                if r != now and held:
                    yield from done()
                    held = []
                now = r
                held.append(tuple(batch.column(j)[i].as_py() for j in range(1, 5)))
        if held:
            yield from done()

    dealt = asked.repartition(ranges, "range").sortWithinPartitions("range", "pack")
    return dealt.mapInArrow(run, schema)


def settle(values: np.ndarray, wanted: np.ndarray | None, answers: list[tuple[int, bytes]], ranges: int, width: int) -> np.ndarray:
    """For every value of a pack whether it was a hit, from the ranges' answers to ask()."""
    out = np.zeros(len(values), bool)
    got = dict(answers)
    for r, _, hashes, _, asked in ask(0, values, wanted, ranges, width):
        distinct = decode(hashes)
        mine = distinct[unbits(asked, len(distinct))]
        hit = mine[unbits(got[r], len(mine))]
        if len(hit):
            at = np.minimum(np.searchsorted(hit, values), len(hit) - 1)
            out |= hit[at] == values
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of docs (doc_id, text); see the module."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    packs = materialise(make_packs(docs), "packs", "none")
    words = packs.agg(F.sum("words")).first()[0] or 0
    ranges = max(partitions(docs), -(-words // RANGE))
    width = min(64, max(1, words).bit_length() + 9)
    cut = np.uint64(64 - width)
    fields = "range int, pack long, hashes binary, twice binary, wanted binary"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for x in found:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], names)

    def probes(p: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of rolling windows in documents long enough, their cut hashes, and which of them are blocks."""
        at = p.runs(block)
        at = at[p.count[p.row[at]] >= window]
        return at, p.hashes(at, block) >> cut, p.place[at] % block == 0

    def anchored(p: Pack, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Starts of the windows whose blocks are all anchors."""
        at, values, own = probes(p)
        bad = np.zeros(len(p.row) + 1, np.int64)  # blocks that are no anchors, by start
        miss = own & ~settle(values, own, answers, ranges, width)
        bad[at[miss] + 1] = 1
        bad = np.cumsum(bad)
        whole = p.runs(window)
        return whole[bad[whole + window - block + 1] == bad[whole]]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, values, own = probes(Pack(body.as_py()))
                yield from rows(ask(number, values, own, ranges, width))

    def noted(p: Pack, got: list) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        """The places that the last pass noted, and the answers to it."""
        answers = {x["range"]: x["hits"] for x in got or ()}
        marks = answers.pop(NOTE, b"")
        return np.flatnonzero(unbits(marks, len(p.row))) if marks else np.zeros(0, np.int64), list(answers.items())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body, got in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                p = Pack(body.as_py())
                at = anchored(p, [(x["range"], x["hits"]) for x in got or ()])
                if len(at):
                    yield from rows(chain(ask(number, p.hashes(at, window), None, ranges, 64), [note(number, at, len(p.row), ranges)]))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body, got in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                p = Pack(body.as_py())
                at, answers = noted(p, got)
                at = at[settle(p.hashes(at, window), None, answers, ranges, 64)]
                if len(at):
                    yield from rows(chain(ask(number, p.second(at, window), None, ranges, 64), [note(number, at, len(p.row), ranges)]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, got in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                p = Pack(body.as_py())
                at, answers = noted(p, got)
                hit = settle(p.second(at, window), None, answers, ranges, 64)
                cover = np.zeros(len(p.row) + 1, np.int64)
                np.add.at(cover, at[hit], 1)
                np.add.at(cover, at[hit] + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                yield result(p, keep)

    def result(p: Pack, keep: np.ndarray) -> pa.RecordBatch:
        data, last = p.raw.tobytes(), np.cumsum(p.count)
        kept, digest, gone = [], [], []
        for n, b in zip(p.count.tolist(), last.tolist(), strict=True):
            mine = np.flatnonzero(keep[b - n : b]) + b - n
            text = b" ".join([data[s:e] for s, e in zip(p.start[mine].tolist(), p.end[mine].tolist(), strict=True)])
            kept.append(text.decode())
            digest.append(hashlib.sha256(text).hexdigest())
            gone.append(n - len(mine))
        return pa.RecordBatch.from_arrays([p.table["doc_id"].combine_chunks(), pa.array(p.count), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    def answered(given: DataFrame) -> DataFrame:
        """(pack, body, answers): the packs with what they were answered and have noted."""
        lists = given.groupBy("pack").agg(F.collect_list(F.struct("range", "hits")).alias("answers"))  # a bit per hash of the pack
        return packs.join(lists.hint("merge"), "pack", "left").select("pack", "body", "answers")  # one plan at every size

    anchors = materialise(answer(packs.select("pack", "body").mapInArrow(first, fields), ranges), "anchors")
    windows = materialise(answer(answered(anchors).mapInArrow(second, fields), ranges), "windows")
    sure = materialise(answer(answered(windows).mapInArrow(third, fields), ranges), "sure")
    return answered(sure).mapInArrow(last, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
