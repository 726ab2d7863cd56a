"""Operator 6: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words, and word beginnings of 4 to 6 bytes (stems that recur with other endings), that are
commoner in toxic training texts than chance allows, with their weight of evidence. Dense features of a text are then
lexicon densities and strengths, nearness of lexicon words to second-person words, capitals, punctuation, obfuscation (the
lexicon is also sought in words with their disguise undone), length and repetition. Trees are boosted on features whose
lexicon counts leave the row's own fold out, and calibrated on predictions for folds left out of the trees.

Scale: the fit uses at most SAMPLE labelled rows (the least by a seeded hash, whatever the input's size) and CANDIDATES
lexicon entries; both are parameters. Scoring is one pass over all rows without a shuffle; whole texts are read, in
buffers of bounded size.

Defined results: a null or empty text is scored as a text without words; null labels are not used; a doc_id labelled twice
counts as toxic if any of its labels does; without labels of both kinds every score is the share of toxic ones, or 0;
repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, table, text_buffers
from .gbdt import Isotonic, Trees, fit, isotonic
from .words import SPACE, boundaries, byte_sums, lean, run_hashes

SAMPLE, CANDIDATES, FOLDS, CHUNK, SEED = 8000, 40_000, 4, 1 << 18, 5
STEMS = (4, 5, 6)
#: Second-person words of the languages at hand.
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ti tú usted ustedes vosotros vuestro tus".split()
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
GAP = ~LETTER
#: What a disguised letter stands for; 0 drops the byte.
PLAIN = np.zeros(256, np.uint8)
PLAIN[LETTER] = np.flatnonzero(LETTER)
for _a, _b in zip(b"013457@$!|", b"oieastasil", strict=True):
    PLAIN[_a] = _b
PLAIN[SPACE] = 32


def lowered(column: pa.Array) -> pa.Array:
    return pa.array([(t.as_py() or "").lower() for t in column], pa.string())


def stem_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, hash) of every word, then of the beginnings of longer ones, told apart by an odd offset."""
    if not len(start):
        return
    sums = byte_sums(raw)
    yield np.arange(len(start)), run_hashes(sums, start, end)
    for k in STEMS:
        long = np.flatnonzero(end - start > k)
        yield long, run_hashes(sums, start[long], start[long] + k) * np.uint64(2 * k + 1) + np.uint64(k)


def undisguised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the words that hold digits or marks between letters, as a buffer, its offsets, and their number per row."""
    n = len(offsets) - 1
    start, end, row = boundaries(raw, offsets)
    letter, odd = LETTER[raw], ~LETTER[raw] & ~SPACE[raw]
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = odd[1:-1] & letter[2:] & (letter[:-2] | odd[:-2])
        inner[np.minimum(offsets[:-1], len(raw) - 1)] = inner[np.maximum(offsets[1:] - 1, 0)] = False
    total = np.concatenate([[0], np.cumsum(inner)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    hit = np.flatnonzero((total[end] > total[start]) & (letters[end] - letters[start] >= 2))
    parts, at, rows = [], [0], row[hit]
    for s, e in zip(start[hit].tolist(), end[hit].tolist(), strict=True):
        x = PLAIN[raw[s:e]]
        parts.append(np.append(x[x > 0], np.uint8(32)))
    size = np.zeros(n, np.int64)
    if parts:
        np.add.at(size, rows, [len(p) for p in parts])
    at = np.concatenate([[0], np.cumsum(size)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), at, np.bincount(rows, minlength=n)


@dataclass
class Lexicon:
    """Sorted entry hashes; weight and strength by fold left out, the last row with none left out."""

    keys: np.ndarray
    weight: np.ndarray
    strength: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


def second_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(SECOND).encode(), np.uint8)
    start, end, _ = boundaries(raw, np.array([0, len(raw)]), GAP)
    return np.sort(run_hashes(byte_sums(raw), start, end))


FEATURES = 22


def features(original: pa.Array, fold: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Rows x FEATURES for the texts of a batch; fold chooses the lexicon's row."""
    n = len(original)
    out = np.zeros((n, FEATURES))
    low = lowered(original)
    raw0, off0 = text_buffers(original)
    size = np.maximum(np.diff(off0), 1)

    def rate(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off0[1:]] - c[off0[:-1]]) / size

    capital = (raw0 >= 65) & (raw0 <= 90)
    out[:, 0] = rate(capital)
    out[:, 1] = rate(raw0 == 33)
    out[:, 2] = rate(raw0 == 63)
    out[:, 3] = rate((raw0 > 32) & (raw0 < 48) | (raw0 > 57) & (raw0 < 65) | (raw0 > 90) & (raw0 < 97) | (raw0 > 122) & (raw0 < 128))
    out[:, 4] = rate((raw0 >= 48) & (raw0 < 58))
    same = np.zeros(len(raw0), bool)
    if len(raw0) > 2:
        same[2:] = (raw0[2:] == raw0[1:-1]) & (raw0[1:-1] == raw0[:-2])
        for ahead in (0, 1):  # a run ends with its text
            same[np.minimum(off0[:-1] + ahead, len(raw0) - 1)] = False
    out[:, 5] = rate(same)
    second = second_hashes()
    raw, off = text_buffers(low)
    plain2, off2, disguised = undisguised(raw, off)
    for shift, (data, at) in ((6, (raw, off)), (16, (plain2, off2))):
        start, end, row = boundaries(data, at, GAP)
        words = np.bincount(row, minlength=n)
        per = np.maximum(words, 1)
        weight, strength = np.zeros(len(start)), np.zeros(len(start))
        you = np.zeros(len(start), bool)
        for k, (which, h) in enumerate(stem_hashes(data, start, end)):
            if not k and len(h):
                you = second[np.minimum(np.searchsorted(second, h), len(second) - 1)] == h
            found = lexicon.find(h)
            hit = found >= 0
            which, found = which[hit], found[hit]
            w, s = lexicon.weight[fold[row[which]], found], lexicon.strength[fold[row[which]], found]
            better = s > strength[which]
            weight[which[better]], strength[which[better]] = w[better], s[better]
        strong = (strength >= 30) & (weight > 2)
        out[:, shift] = np.bincount(row, strong, n)
        out[:, shift + 1] = out[:, shift] / per
        out[:, shift + 2] = np.bincount(row, np.where(weight > 1, weight, 0), n) / per
        for j, v in ((3, strength), (4, np.where(strength > 10, weight, 0))):
            np.maximum.at(out[:, shift + j], row, v)
        if shift == 6:
            out[:, 11] = np.log1p(words)
            out[:, 12] = np.bincount(row, you, n) / per
            near = np.full(n, 50.0)
            a, b = np.flatnonzero(strong), np.flatnonzero(you)
            if len(a) and len(b):
                for side in (-1, 0):
                    k = np.clip(np.searchsorted(b, a) + side, 0, len(b) - 1)
                    ok = row[a] == row[b[k]]
                    np.minimum.at(near, row[a[ok]], np.abs(a[ok] - b[k[ok]]).astype(float))
            out[:, 13] = near
            out[:, 14] = disguised / per
            out[:, 15] = np.bincount(row, (strength >= 12) & (weight > 1), n)
            total = np.zeros(n)
            np.add.at(total, row, strength > 100)
            out[:, 21] = total
    return out


def token_sets(batch_texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the distinct lexicon candidates of each text, by buffers of bounded size."""
    low = lowered(batch_texts)
    raw, off = text_buffers(low)
    for a, b in chunks(off, CHUNK):
        data, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        rows, hashes = [], []
        for buffer, where in ((data, at), undisguised(data, at)[:2]):
            start, end, row = boundaries(buffer, where, GAP)
            for which, h in stem_hashes(buffer, start, end):
                rows.append(row[which])
                hashes.append(h)
        if rows:
            r, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            yield r[new] + a, h[new]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    scale: Isotonic | None
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.trees is None:
            return out
        _, off = text_buffers(texts)
        for a, b in chunks(off, CHUNK):
            x = features(texts.slice(a, b - a), np.full(b - a, FOLDS), self.lexicon)
            out[a:b] = self.scale(self.trees.raw(x))
        return out


def in_test(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> Model:
    """Fit on at most `sample` labelled rows of docs (doc_id, text) outside the test fifth."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~in_test(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = known.orderBy(order, "doc_id").limit(sample).withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int"))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h in token_sets(batch.column(0)):
                v, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["h", "n"])

    common = rows.where("toxic = 1").select("text").mapInArrow(lean(positives), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    entries = common.where("n >= 3").orderBy(F.desc("n"), "h").limit(candidates).toPandas()
    keys = np.sort(entries["h"].to_numpy(np.int64).view(np.uint64))
    lexicon = Lexicon(keys, np.zeros((1, len(keys))), np.zeros((1, len(keys))))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            total = np.zeros((2 * FOLDS, len(keys)), np.int64)
            for r, h in token_sets(batch.column(0)):
                at = lexicon.find(h)
                hit = at >= 0
                np.add.at(total, (toxic[r[hit]] * FOLDS + fold[r[hit]], at[hit]), 1)
            kind, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(total[kind, at])], ["kind", "at", "n"])

    found = rows.selectExpr("text", "int(toxic > 0) toxic", "fold").mapInArrow(lean(counts), "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2 * FOLDS, len(keys)))
    total[found["kind"], found["at"]] = found["n"]
    docs_of = np.zeros(2 * FOLDS)
    for r in rows.selectExpr("int(toxic > 0) t", "fold").groupBy("t", "fold").count().collect():
        docs_of[r["t"] * FOLDS + r["fold"]] = r["count"]

    def evidence(keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and signed likelihood ratio of every entry over some folds."""
        bad, good = total[[FOLDS + f for f in keep]].sum(0), total[keep].sum(0)
        nb, ng = docs_of[[FOLDS + f for f in keep]].sum(), docs_of[keep].sum()
        w = np.log((bad + 0.5) / (nb + 1)) - np.log((good + 0.5) / (ng + 1))
        rate = (bad + good) / max(1.0, nb + ng)

        def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
            return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)

        g = 2 * (part(bad, nb * rate) + part(good, ng * rate) + part(nb - bad, nb * (1 - rate)) + part(ng - good, ng * (1 - rate)))
        return w, np.where(w > 0, np.maximum(g, 0), 0)

    every = list(range(FOLDS))
    both = [evidence([f for f in every if f != left]) for left in every] + [evidence(every)]
    weight, strength = np.stack([w for w, _ in both]), np.stack([g for _, g in both])
    keep = strength[-1] >= 8
    lexicon = Lexicon(keys[keep], weight[:, keep], strength[:, keep])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = text_buffers(batch.column(0))
            for a, b in chunks(off, CHUNK):
                x = features(batch.column(0).slice(a, b - a), batch.column(2).to_numpy()[a:b].astype(np.int64), lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    frame = rows.selectExpr("text", "int(toxic > 0) toxic", "fold", "doc_id").mapInArrow(lean(describe), "doc_id long, toxic int, fold int, x array<double>").toPandas()
    frame = frame.sort_values(["doc_id", "toxic"], kind="stable")
    y = frame["toxic"].to_numpy(float)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, prior)
    x, fold = np.array(frame["x"].tolist()), frame["fold"].to_numpy()
    raw = np.zeros(len(y))
    for f in every:
        if (fold == f).any() and (fold != f).any():
            raw[fold == f] = fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(lexicon, fit(x, y), isotonic(raw, y), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, with all their columns, whatever they are called."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) < limit))

    return docs.mapInArrow(lean(run), docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(in_test(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
