"""Operator 2: near-duplicate documents by one-permutation MinHash.

A document's shingles are hashed once; the upper bits choose a bin and each bin keeps its least hash. Empty bins copy a
non-empty one that a fixed random sequence picks, the same for all documents (optimal densification). A small set would
fill few bins and make a rough sketch, so sets are dealt into tiers by size: below 192 shingles the BINS bins belong to 8
permutations, below 24 to as many as bins; sizes near a tier's end are in both tiers, so what can link shares one. Rows of
the sketch form banded buckets. Documents with equal shingle sets are one class, known by the set's digest, and one
representative of it goes on. In a bucket, candidate edges are stars: around the members with most likely partners, and
around every member towards its most alike one. Every edge is confirmed on full shingle sets before it links; a second
round offers edges between the components still apart in a bucket, from each member to its eight most alike (left out where
few pairs are apart). In a last round all the rest of a bucket is compared where it stands, each pair in the first bucket
it shares: pairs with a hopeful estimate by their least LEAST shingle hashes, which is the whole set of all but long texts,
and only what links by them is offered. So in the end every pair of a bucket whose estimate is hopeful is in one component
or tried, and edges grow with members and links, not with the pairs of a family of texts just too unlike.

A link at the threshold is missed if its sides share no bucket (5 in 100,000) or if the estimate is four standard
deviations off (3 in 100,000), and if nothing else joins the two.

Scale: sketches are a few hundred bytes a document; only members of shared buckets move on. A bucket above BLOCK members
is split into blocks at random, differently in each band, with a star across its blocks; later rounds cover the pairs of
blocks, as far as components are still apart. Joins are on unique right sides, so skewed keys can be split; rows without
a set are joined with nothing; components are found by distributed min steps. Tables of the search are deleted at its end.

Defined results: a null text, or one without words, has no shingles, links with nothing and is its own component; fewer
words than a shingle are one shingle; each row is judged by its own text, also where a doc_id repeats with other texts; a
null doc_id links with nothing and has null component; an empty table gives no rows; other columns are ignored. Very long
texts are hashed whole, one at a time, in memory of some 60 bytes per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, files_for, in_files, inner_name, materialise, mix, odd_constants, table, text_buffers
from .components import connected_components
from .words import lean, lower_ascii, word_hashes

BINS, LEAST, BLOCK, SIDE, FEW, CHUNK, PROBES = 128, 1024, 4096, 32, 1024, 1 << 19, 64
#: Tiers of set sizes: below so many shingles, a sketch is of so many permutations; the last tier has no end.
TIERS = ((24, 128), (192, 8), (1 << 62, 1))


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words; documents link from a share of num/den of their union on. rows * bands <= BINS."""

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    bands: int = 25

    @property
    def hopeful(self) -> float:
        """Least estimated share worth a look: four standard deviations below the threshold."""
        p = self.num / self.den
        return p - 4 * (p * (1 - p) / BINS) ** 0.5


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, sorted by row, then hash."""
    h, row, _, _ = word_hashes(lower_ascii(raw), offsets)
    c = odd_constants(words, words + 2)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    m = len(h) - words + 1
    parts, rows = [], []
    if m > 0:
        x = np.zeros(m, np.uint64)
        for k in range(words):
            x += h[k : k + m] * c[k]
        inside = row[:m] == row[words - 1 :]
        parts.append(x[inside])
        rows.append(row[:m][inside])
    for size in range(1, words):
        few = np.flatnonzero(count == size)
        if len(few):
            x = np.full(len(few), c[-1] * np.uint64(size), np.uint64)
            for k in range(size):
                x += h[first[few] + k] * c[k]
            parts.append(x)
            rows.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    z, r = mix(np.concatenate(parts)), np.concatenate(rows)
    order = np.argsort(z)
    order = order[np.argsort(r[order].astype(np.uint16), kind="stable")]
    z, r = z[order], r[order]
    keep = np.ones(len(z), bool)
    keep[1:] = (z[1:] != z[:-1]) | (r[1:] != r[:-1])
    return z[keep], r[keep]


def one_permutation(z: np.ndarray, r: np.ndarray, n: int, bins: int, seed: int) -> np.ndarray:
    """The sketch of one permutation with densification: n x bins; rows without shingles stay zero."""
    bits = np.uint64(64 - bins.bit_length() + 1)
    cell = r * bins + ((z >> bits).astype(np.int64) if bins > 1 else 0)
    sig = np.full(n * bins, ~np.uint64(0))
    np.minimum.at(sig, cell, z)
    full = np.zeros(n * bins, bool)
    full[cell] = True
    sig, full = sig.reshape(n, bins), full.reshape(n, bins)
    some = full.any(1)
    sig[~some] = 0
    left = ~full & some[:, None]
    probe = (odd_constants(77 + seed, bins * PROBES) >> np.uint64(20)).reshape(PROBES, bins) % np.uint64(bins)
    steps = [p.astype(np.int64) for p in probe] + [(probe[0].astype(np.int64) + s) % bins for s in range(bins)]
    for at in steps:
        if not left.any():
            break
        rows, cols = np.nonzero(left)
        hit = full[rows, at[cols]]
        rows, cols = rows[hit], cols[hit]
        sig[rows, cols] = sig[rows, at[cols]]
        left[rows, cols] = False
    return sig


def sketches(z: np.ndarray, r: np.ndarray, n: int, permutations: int) -> np.ndarray:
    """n x BINS from so many permutations of BINS / permutations bins each; the first is the hash itself."""
    bins = BINS // permutations
    c = odd_constants(123, permutations)
    parts = []
    for k in range(permutations):
        x = z if not k else mix(z * c[k])
        y = one_permutation(x, r, n, bins, k)
        parts.append(y if permutations == 1 else mix(y + np.uint64(k)))
    return np.concatenate(parts, axis=1)


def tiers(size: np.ndarray, like: Likeness) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, permutations, rows) of the tiers of set sizes; a row near a tier's upper end is in the next one too, so that
    any two sets that can link share a tier."""
    least = 1
    for k, (most, permutations) in enumerate(TIERS):
        low = -(-least * like.num // like.den) if k else 1
        yield k, permutations, np.flatnonzero((size >= low) & (size < most))
        least = most


def sketch_table(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest of the set, sketches: tier, bands, 8 bits of each bin) per row."""
    schema = "doc_id long, text_key binary, n_shingles long, digest binary, sketches array<struct<tier: int, bands: array<long>, sig: binary>>"
    kind = pa.struct([("tier", pa.int32()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = odd_constants(5, like.rows + 1)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for a, b in chunks(offsets, CHUNK):
                n = b - a
                z, r = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], like.words)
                size = np.bincount(r, minlength=n)
                at = np.concatenate([[0], np.cumsum(size)])
                digest = [xxhash.xxh3_128_digest(z[i:j].tobytes()) if j > i else None for i, j in zip(at[:-1], at[1:], strict=True)]
                tier, row, bands, sigs = [], [], [], []
                for k, permutations, rows in tiers(size, like):
                    if not len(rows):
                        continue
                    place = np.full(n, -1)
                    place[rows] = np.arange(len(rows))
                    own = place[r] >= 0
                    sig = sketches(z[own], place[r[own]], len(rows), permutations)
                    band = np.zeros((len(rows), like.bands), np.uint64)
                    for i in range(like.rows):
                        band += sig[:, i : like.rows * like.bands : like.rows] * c[i]
                    bands.append(mix(band + (np.arange(like.bands, dtype=np.uint64) + np.uint64(like.bands * k)) * c[-1]))
                    sigs.append(mix(sig.copy()).astype(np.uint8))
                    tier.append(np.full(len(rows), k, np.int32))
                    row.append(rows)
                found = np.concatenate([np.zeros(0, np.int64), *row])
                order = np.argsort(found, kind="stable")
                many = np.bincount(found, minlength=n)
                if len(found):
                    all_bands, all_sigs, all_tiers = np.concatenate(bands)[order], np.concatenate(sigs)[order], np.concatenate(tier)[order]
                else:
                    all_bands, all_sigs, all_tiers = np.zeros((0, like.bands), np.uint64), np.zeros((0, BINS), np.uint8), np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * like.bands), pa.array(all_bands.ravel().view(np.int64)))
                each = pa.StructArray.from_arrays([pa.array(all_tiers), lists, pa.array([x.tobytes() for x in all_sigs], pa.binary())], fields=list(kind))
                nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(size), pa.array(digest, pa.binary()), nested], ["doc_id", "text_key", "n_shingles", "digest", "sketches"])

    return docs.select(F.col("doc_id").cast("long"), text_key(), "text").mapInArrow(lean(run), schema)


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.unhex(F.md5("text")).alias("text_key")


def star_edges(comp: np.ndarray, sig: np.ndarray, role: np.ndarray, hopeful: float, each: int) -> tuple[list[tuple[int, int]], bool]:
    """Candidate edges (i, j), i < j, between components within one block: stars, and the most alike few of each member that asks.

    Also whether a member that asks has partners beyond those. Members of role 0 are asked, those of role 1 ask and are asked, those of role 2 ask only.

    A star's centre is the member likest, in sum, to those that ask and are in no star yet, so what they are all alike to
    is found even if they aren't alike to each other.
    """
    n = len(comp)
    out: set[tuple[int, int]] = set()
    put = lambda i, j: out.add((int(min(i, j)), int(max(i, j))))
    least = int(np.ceil(hopeful * sig.shape[1]))
    ask, near = np.flatnonzero(role > 0), np.flatnonzero(role < 2)
    cols = np.ascontiguousarray(sig[near].T)
    weight, left = np.zeros(len(near), np.int64), np.zeros(n, bool)
    k, more = min(each, len(near)), False
    for a in range(0, len(ask), 256):
        mine = ask[a : a + 256]
        same = np.zeros((len(mine), len(near)), np.uint8)
        for c, own in zip(cols, sig[mine].T, strict=True):
            same += own[:, None] == c[None, :]
        same[comp[mine, None] == comp[None, near]] = 0
        same[same < least] = 0
        degree = (same > 0).sum(1)
        left[mine] = degree > 0
        more |= bool((degree > k).any())
        weight += same.sum(0, dtype=np.int64)
        top = np.argpartition(-same.astype(np.int16), k - 1, axis=1)[:, :k] if k else np.zeros((len(mine), 0), int)
        for i, row in enumerate(top):
            for j in row[same[i, row] > 0]:
                put(mine[i], near[j])
    while left.any():
        at = int(weight.argmax())
        weight[at], centre = -1, near[at]
        hit = left & ((sig == sig[centre]).sum(1) >= least) & (comp != comp[centre])
        if hit.any():
            for j in np.flatnonzero(hit):
                put(centre, j)
            left &= ~hit
            left[centre] = False
    return list(out), more


def least_hashes(texts: DataFrame, like: Likeness) -> DataFrame:
    """(id, least, size) of texts (id, text): the upper halves of the LEAST least shingle hashes, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                z, r = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], like.words)
                at = np.searchsorted(r, np.arange(b - a + 1))
                few = [(z[i : min(j, i + LEAST)] >> np.uint64(32)).astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(few, pa.binary()), pa.array(np.diff(at))], ["id", "least", "size"])

    return texts.select("id", "text").mapInArrow(lean(run), "id binary, least binary, size long")


def all_edges(comp: np.ndarray, sig: np.ndarray, role: np.ndarray, bands: np.ndarray, bucket: int, least: list[bytes], size: np.ndarray, like: Likeness) -> np.ndarray:
    """Rows (i, j), i < j, of the pairs between components of a block that link, but for those that share an earlier band's bucket.

    Pairs with a hopeful sketch are compared by their least hashes: sets of LEAST shingles at most as a whole, so that but for
    chance meetings only true links are left, larger ones by an estimate, with four standard deviations to spare.
    """
    hope = int(np.ceil(like.hopeful * sig.shape[1]))
    ask, near = np.flatnonzero(role > 0), np.flatnonzero(role < 2)
    cols, number = np.ascontiguousarray(sig[near].T), int(np.argmax(bands[0] == bucket))
    held = [np.frombuffer(x, "<u4") for x in least]
    many = np.array([len(x) for x in held])
    end = np.array([int(x[-1]) if len(x) < n else 1 << 32 for x, n in zip(held, size.tolist(), strict=True)])  # hashes up to here are known
    _, flat = np.unique(np.concatenate(held), return_inverse=True)
    value, start = np.concatenate(held), np.cumsum(many) - many
    mark = np.zeros(int(flat.max()) + 1, bool)
    p = like.num / like.den
    out = [np.zeros((0, 2), np.int64)]
    for a in range(0, len(ask), 256):
        mine = ask[a : a + 256]
        same = np.zeros((len(mine), len(near)), np.uint8)
        for c, own in zip(cols, sig[mine].T, strict=True):
            same += own[:, None] == c[None, :]
        hopeful = (same >= hope) & (comp[mine, None] != comp[None, near])
        for i, row in zip(mine.tolist(), hopeful):
            j = near[row]
            first = np.ones(len(j), bool)
            for k in range(number):
                first &= bands[i, k] != bands[j, k]
            j = j[first]
            if not len(j):
                continue
            where = np.repeat(start[j] - (np.cumsum(many[j]) - many[j]), many[j]) + np.arange(int(many[j].sum()))
            cut = np.cumsum(many[j]) - many[j]
            mark[flat[start[i] : start[i] + many[i]]] = True
            both = np.add.reduceat(mark[flat[where]], cut, dtype=np.int64)
            mark[flat[start[i] : start[i] + many[i]]] = False
            upto = np.minimum(end[i], end[j])
            own = np.searchsorted(held[i], upto, side="right")
            theirs = np.where(end[j] <= end[i], many[j], np.add.reduceat(value[where] <= end[i], cut, dtype=np.int64))
            union = own + theirs - both
            whole = upto == 1 << 32
            limit = np.where(whole, p, p - 4 * np.sqrt(p * (1 - p) / np.maximum(1, union)))
            j = j[both >= limit * union - 1e-9]
            out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
    return np.unique(np.concatenate(out), axis=0)


def candidates(members: DataFrame, like: Likeness, each: int | None) -> DataFrame:
    """Distinct edges (a, b, place), a < b, and a row of nulls where pairs of likely partners were not offered, from members (bucket, block, part, id, comp, sig, role), sorted.

    each: partners that a member asks for beside the stars; None offers all, and needs the members' bands and least hashes.
    place (bucket, at): at is the same for the edges between SIDE members and SIDE others that stand together in a block.
    """
    c = odd_constants(9, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts(t: pa.Table) -> np.ndarray:
            """Where a block begins, other than at 0."""
            keys = [t[c].to_numpy() for c in ("bucket", "block", "part")]
            return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

        def edges(t: pa.Table) -> pa.RecordBatch:
            ids, role = t["id"].combine_chunks(), t["role"].to_numpy()
            comp = t["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
            at = np.concatenate([[0], starts(t), [len(ids)]])
            size = np.diff(at)
            two = at[:-1][size == 2]
            near = (sig[two] == sig[two + 1]).sum(1) >= like.hopeful * sig.shape[1]
            two = two[near & (comp[two] != comp[two + 1])]
            bands = least = size_of = None
            if each is None:
                bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
                least, size_of = t["least"].to_pylist(), t["size"].to_numpy()
            found, more = [np.stack([two, two + 1], 1)], False
            most = 1 if bands is not None else 2
            if bands is not None:
                found = [np.zeros((0, 2), np.int64)]
            for a, b in zip(at[:-1][size > most].tolist(), at[1:][size > most].tolist(), strict=True):
                if bands is not None:
                    found.append(all_edges(comp[a:b], sig[a:b], role[a:b], bands[a:b], int(t["bucket"][a].as_py()), least[a:b], size_of[a:b], like) + a)
                    continue
                some, rest = star_edges(comp[a:b], sig[a:b], role[a:b], like.hopeful, each)
                more |= rest
                if some:
                    found.append(np.array(some) + a)
            m = np.concatenate(found)  # rows of a block are in the order of their ids
            first = at[np.searchsorted(at, m[:, 0], side="right") - 1]
            where = [*(t[k].to_numpy()[first] for k in ("bucket", "block", "part")), (m[:, 0] - first) // SIDE, (m[:, 1] - first) // SIDE]
            place = mix(np.sum([x.astype(np.uint64) * y for x, y in zip(where, c, strict=True)], axis=0, dtype=np.uint64)).view(np.int64)
            columns = [*(ids.take(pa.array(m[:, k])) for k in (0, 1)), pa.array(where[0]), pa.array(place)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.nulls(int(more), x.type)]) for x in columns], ["a", "b", "bucket", "at"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            cut = starts(t)
            if len(cut):  # all but the last block are whole
                n = int(cut[-1])
                yield edges(t.slice(0, n))
                held = t.slice(n).to_batches()
        if held:
            yield edges(pa.Table.from_batches(held))

    found = members.mapInArrow(lean(run), "a binary, b binary, bucket long, at long")
    return found.groupBy("a", "b").agg(F.min(F.struct("bucket", "at")).alias("place"))


def still_apart(dealt: DataFrame) -> DataFrame:
    """Members (bucket, block, n, id, comp, sig) dealt for the rounds after the first: (bucket, block, part, id, comp, sig, role).

    Of two components in a bucket one is not its largest, so the members outside that ask all others: every pair apart
    meets. In a bucket above BLOCK members those that ask go in parts of about BLOCK to each of its blocks.
    """
    sizes = dealt.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("top"))
    apart = sizes.select("bucket", F.col("top.comp").alias("largest"), (F.col("all") - F.col("top.m")).alias("few")).where("few > 0")
    blocks, parts = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("few") / BLOCK).cast("int")
    asks = F.col("comp") != F.col("largest")
    place = lambda block, part, role: F.struct(block.alias("block"), part.alias("part"), role.cast("int").alias("role"))
    asked = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: place(F.col("block"), i, F.lit(0)))
    mine = F.pmod(F.xxhash64("id", "bucket", F.lit("part")), parts).cast("int")
    asking = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: place(j, mine, F.lit(2)))
    places = F.when(F.col("n") <= BLOCK, F.array(place(F.col("block"), F.lit(0), asks))).when(asks, F.concat(asked, asking)).otherwise(asked)
    kept = [c for c in dealt.columns if c not in ("block", "n")]
    return dealt.join(apart.hint("merge"), "bucket").select(*kept, F.explode(places).alias("p")).select(*kept, "p.block", "p.part", "p.role")


def confirm(edges: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The edges (a, b) of edges (a, b, place) whose full shingle sets are alike enough; texts (id, text) has unique ids.

    The edges of a place share its texts: 2 * SIDE at most, each sent there once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        here = None
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for i, (place, a, b) in enumerate(zip(places, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if place != here:
                    known.clear()
                    here = place
                if b is None:
                    raw = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8)
                    known[a] = shingles(raw, np.array([0, len(raw)]), like.words)[0]
                    continue
                x, y = known[a], known[b]
                if like.den * min(len(x), len(y)) < like.num * max(len(x), len(y)):
                    continue
                z = np.concatenate([x, y])
                z.sort(kind="stable")  # two sorted runs are merged
                both = int((z[1:] == z[:-1]).sum())
                if like.den * both >= like.num * (len(z) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    pairs = edges.select("place.bucket", "place.at", "a", "b")
    ends = pairs.select("bucket", "at", F.explode(F.array("a", "b")).alias("a")).distinct()
    given = ends.join(texts.select(F.col("id").alias("a"), "text").hint("merge"), "a").select("bucket", "at", "a", F.lit(None).cast("binary").alias("b"), "text")
    rows = given.unionByName(pairs.withColumn("text", F.lit(None).cast("string")))
    dealt = rows.repartition("bucket", "at").sortWithinPartitions("bucket", "at", F.col("b").asc_nulls_first())
    return dealt.select("bucket", "at", "a", "b", "text").mapInArrow(lean(run), "a binary, b binary")


def similar_rows(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, text_key, n_shingles, group, component_id) per row of docs (doc_id, text); see the module. Rows that link with
    nothing because they have no words or no doc_id have no group."""
    return _search(docs, like)[0]


def _search(docs: DataFrame, like: Likeness) -> tuple[DataFrame, int]:
    """The rows of similar_rows, and files enough for a table on docs."""
    sketch = materialise(sketch_table(docs, like), "sketch")
    files = files_for(docs.sparkSession, *sketch.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first())
    full = sketch.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("rep")).select(F.col("digest").alias("id"), F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key"))
    classes = materialise(classes, "classes", files=files)
    own = (F.col("rep") == F.col("doc_id")) & (F.col("rep_key") == F.col("text_key")) & (F.col("id") == F.col("digest"))
    reps = full.join(classes.hint("merge"), own).select("id", "sketches").dropDuplicates(["id"])  # rows repeated whole
    reps = materialise(reps.select("id", F.explode("sketches").alias("s")).select("id", "s.tier", "s.bands", "s.sig"), "representatives", files=files)
    rows = reps.select("id", "tier", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    inside = rows.join(shared.hint("merge"), "bucket")
    block = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / BLOCK))).otherwise(0).cast("int")
    members = materialise(inside.select("bucket", block.alias("block"), "id", "tier", "n").join(reps.select("id", "tier", "sig").hint("merge"), ["id", "tier"]), "members", files=files)
    wide = members.where(F.col("n") > BLOCK)  # a star across the blocks of a wide bucket
    hubs = wide.groupBy("bucket").agg(F.min("id").alias("hub"))
    some = F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SIDE)))
    across = wide.select("bucket", "id", "n").join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.struct("bucket", some.alias("at")).alias("place"))
    across = across.groupBy("a", "b").agg(F.min("place").alias("place"))
    nodes = members.select("id").distinct()
    wanted = classes.join(nodes.hint("merge"), "id").select("id", F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key"))
    texts = docs.select(F.col("doc_id").cast("long"), text_key(), "text").join(wanted.hint("merge"), ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"])
    texts = materialise(texts, "texts", files=files)
    links = tried = known = None
    comp = nodes.withColumn("comp", F.col("id"))
    done = [reps, members, texts]
    rounds = [1, 8, None]
    while rounds:
        each = rounds.pop(0)
        dealt = members.join(comp.hint("merge"), "id")
        if tried is None:
            dealt = dealt.withColumns({"part": F.lit(0), "role": F.lit(1)})
        else:
            dealt = still_apart(dealt)
        if each is None:
            dealt = materialise(dealt, "apart", files=files)
            done.append(dealt)
            least = least_hashes(texts.join(dealt.select("id").distinct().hint("merge"), "id", "left_semi"), like)
            dealt = dealt.join(reps.select("id", "tier", "bands").hint("merge"), ["id", "tier"]).join(least.hint("merge"), "id")
        dealt = dealt.repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "id")
        edges = candidates(dealt, like, each)
        edges = edges.unionByName(across).groupBy("a", "b").agg(F.min("place").alias("place")) if tried is None else edges.join(tried, ["a", "b"], "left_anti")
        edges = materialise(edges, "edges", files=files)
        more = tried is None or not edges.where("a is null").isEmpty()  # the first round covers no pairs of blocks
        pairs = edges.where("a is not null")
        new = materialise(confirm(pairs, texts, like), "links", files=files)
        done += [edges, new]
        links = new if links is None else links.unionByName(new)
        pairs = pairs.select("a", "b")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not new.isEmpty():
            known = materialise(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), files), "components", files=files)
            comp = nodes.join(known.hint("merge"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("comp"))
        if not more:
            break
        if each == 1:
            parts = members.join(comp.hint("merge"), "id").groupBy("bucket", "comp").agg(F.count("*").alias("m"))
            parts = parts.groupBy("bucket").agg(F.sum("m").alias("n"), F.max("m").alias("top"))
            rows, apart = parts.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - F.col("top")))).first()
            if not apart:  # every bucket is one component
                break
            if apart <= FEW * rows:  # the round of eight is there to join components before many pairs are compared
                rounds = [None]
    classes = classes.withColumn("group", F.col("id"))
    if known is not None:
        classes = classes.drop("group").join(known.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = classes.groupBy("group").agg(F.min("rep").alias("component_id"))
    by_class = materialise(classes.join(least.hint("merge"), "group").select(F.col("id").alias("digest"), "group", "component_id"), "groups", files=files)
    discard(*done)
    names = ["doc_id", "text_key", "n_shingles", "group", "component_id"]
    out = full.join(by_class, "digest").select(names)
    alone = sketch.where("digest is null or doc_id is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone), files


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text); see the module."""
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False))
    return similar_rows(docs, like).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row of each group of near duplicates, with all columns of docs: that of the least doc_id, then text key; of rows
    with both alike, one. Rows without a doc_id or without words stay, each."""
    found, files = _search(docs, like)
    found = found.where("group is not null")
    least = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    key, text = inner_name(docs, "own_id"), inner_name(docs, "own_text")
    stay = materialise(least.select(F.col("r.doc_id").alias(key), F.col("r.text_key").alias(text)), "kept", files=files)
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), text: text_key()})
    one = marked.join(stay, [key, text], "left_semi").dropDuplicates([key, text])
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return in_files(one.select(docs.columns), files).unionByName(docs.where(F.col("doc_id").isNull() | wordless))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Likeness(words=3, num=85, rows=6, bands=21))
