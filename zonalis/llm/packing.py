"""Operator 4: sequence packing by non-negative least squares over shallow length combinations.

Each task streams its documents, encodes them and packs buffers of GROUP_TOKENS (`group`) ids; nothing is shuffled or collected,
and memory is bounded by a buffer and the longest document. Per buffer: documents of a window or more give whole windows;
the other pieces are counted in bins of QUANTUM ids; all combinations of at most DEPTH bins that fill the window are the
columns of a non-negative least-squares fit to that histogram; its rounded solution is laid out with real pieces; the
residual pieces are cut into the gaps that are left, then joined to further windows. What fills no window is carried into
the next buffer; a task's last ids are laid out as sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is one end id; repeated rows are packed as separate documents, told apart by their
place; an empty table yields no row; other columns are ignored. sequence_id is unique over the result (task in the upper
bits); offsets in a sequence run from 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import memo
from .words import lean, release

WINDOW, QUANTUM, DEPTH, GROUP_TOKENS, END = 4096, 64, 4, 1 << 22, 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int]  # document, start, length


@lru_cache(4)
def combinations(total: int, depth: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All multisets of at most `depth` bins 1..total that sum to total, and their bin counts as columns."""
    found: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(prefix)
        elif len(prefix) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(prefix)) >= left:
                    extend((*prefix, x), left - x, x)

    extend((), total, total)
    a = np.zeros((total, len(found)))
    for j, combo in enumerate(found):
        for x in combo:
            a[x - 1, j] += 1
    return found, a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |a x - b| with x >= 0, by accelerated projected gradients; stops when steps are below a thousandth."""
    gram = a @ a.T
    v = np.ones(len(gram))
    for _ in range(30):
        v = gram @ v
        v /= np.linalg.norm(v)
    step = 1 / (1.02 * float(v @ gram @ v))
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        moved = np.abs(new - x).max(initial=0)
        x, t = new, t2
        if moved < 1e-3:
            break
    return x


def fill(gap: int, spare: list[Piece]) -> list[Piece]:
    """Take `gap` ids from the end of spare, cutting the last piece taken; less if spare runs out."""
    out: list[Piece] = []
    while gap and spare:
        doc, start, length = spare.pop()
        if length > gap:
            spare.append((doc, start + gap, length - gap))
            length = gap
        out.append((doc, start, length))
        gap -= length
    return out


def pack(pieces: list[Piece], window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces of less than a window that are left over."""
    done: list[list[Piece]] = []
    bins: list[list[Piece]] = [[] for _ in range(window // quantum)]
    for doc, start, length in pieces:
        while length >= window:
            done.append([(doc, start, window)])
            start, length = start + window, length - window
        if length:
            bins[-(-length // quantum) - 1].append((doc, start, length))
    for b in bins:
        b.sort(key=lambda p: (p[2], -p[0], -p[1]))
    combos, a = combinations(window // quantum, depth)
    solved = nnls(a, np.array([len(b) for b in bins], float))
    laid: list[list[Piece]] = []
    for j in np.argsort(-solved, kind="stable"):
        times = int(solved[j] + 0.5)
        if not times:
            break
        need = {x: combos[j].count(x) for x in set(combos[j])}
        for _ in range(min(times, *(len(bins[x - 1]) // n for x, n in need.items()))):
            laid.append([bins[x - 1].pop() for x in combos[j]])
    spare = sorted((p for b in bins for p in b), key=lambda p: p[2])
    gaps = sorted(((window - sum(p[2] for p in s), i) for i, s in enumerate(laid)), reverse=True)
    gone: set[int] = set()
    for k, (gap, i) in enumerate(gaps):
        if i in gone:
            continue
        got = fill(gap, spare)
        laid[i] += got
        gap -= sum(p[2] for p in got)
        while gap:  # no residual piece is left: another laid sequence gives its own
            giver = next((j for _, j in gaps[k + 1 :] if j not in gone), None)
            if giver is None:
                break
            gone.add(giver)
            spare.extend(laid[giver])
            got = fill(gap, spare)
            laid[i] += got
            gap -= sum(p[2] for p in got)
        if gap:
            spare, gone = laid[i], gone | {i}
    done += [s for i, s in enumerate(laid) if i not in gone]
    while sum(p[2] for p in spare) >= window:
        done.append(fill(window, spare))
    return done, spare


def tail(spare: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are the powers of two in the sum of the pieces."""
    out, spare = [], spare[::-1]
    left = sum(p[2] for p in spare)
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append(fill(size, spare))
        left -= size
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, group: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece of docs (doc_id, text); see the module."""
    if window & (window - 1) or window < QUANTUM:
        raise ValueError("the window must be a power of two, 64 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = memo(tokenizer)
        number = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int | None, bytes]] = {}
        pieces: list[Piece] = []
        count = tokens = 0
        spare: list[Piece] = []

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for s in sequences:
                at = 0
                for doc, start, length in s:
                    key, ids = held[doc]
                    out.append((key, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, number, at))
                    at += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), m.encode_column(batch.column(1), end), strict=True):
                held[count] = key, x.tobytes()
                pieces.append((count, 0, len(x)))
                count, tokens = count + 1, tokens + len(x)
                if tokens >= group:
                    sequences, spare = pack(pieces, window)
                    yield rows(sequences)
                    pieces, held = list(spare), {p[0]: held[p[0]] for p in spare}
                    tokens = sum(p[2] for p in spare)
        sequences, spare = pack(pieces, window)
        yield rows(sequences + tail(spare))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
