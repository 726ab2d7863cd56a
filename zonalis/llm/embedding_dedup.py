"""Operator 10: near-duplicate vectors by random-hyperplane sign hashing in several tables.

Identical vectors are one class with a weight, known by a 128-bit digest. In every table a class falls into the bucket of
its sign bits; bits grow with the logarithm of the number of classes, and tables with them, so that a pair at the threshold
is missed by all tables with probability MISS at most. Within a bucket all pairs are compared by exact cosines in double
precision, in blocks of BLOCK rows: a larger bucket is dealt out as pairs of blocks over many tasks. A pair counts in the
first table it shares only; a class carries its sign bits, computed once, so all tables agree on that. What leaves a block
is a row per vector (links counted, one edge to the least vector it reaches in the block), never a pair; distributed
connected components join these edges.

Scale: every table shuffles the vectors that share a bucket once, single precision staying single; with some 10**9 vectors
that is up to a hundred times the table, the price of comparing by hashing without candidate lists.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing (0 links,
own component); vectors of different length never link; rows that repeat a vec_id are separate vectors under one id, and
each links by its own components; a null vec_id links with nothing and has null component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .components import connected_components

COSINE, MISS, BLOCK, FILL, SEED = 0.95, 0.001, 1024, 32, 11


def tables_for(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Sign bits of a table, and tables, for that many classes."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, classes) / FILL))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket keys, rows x tables; the hyperplanes depend on the seed and the length of the vectors only."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    on = (x @ planes > 0).reshape(len(x), tables, bits)
    return (on.astype(np.int64) << np.arange(bits)).sum(2)


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as unit vectors in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def reach(near: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_blocks(dealt: DataFrame, cosine: float) -> DataFrame:
    """(id, n, low) from rows (dim, number, bucket, i, j, side, id, weight, keys, embedding), sorted by block, then id."""

    def block(t: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array] | None:
        k = int(t["number"][0].as_py())
        ids, weight, side = t["id"].combine_chunks(), t["weight"].to_numpy(), t["side"].to_numpy()
        x = vectors(t["embedding"].combine_chunks())
        near = x @ x.T >= cosine
        near |= near.T
        np.fill_diagonal(near, False)
        if t["i"][0].as_py() != t["j"][0].as_py():
            near &= side[:, None] != side[None, :]
        if not near.any():
            return None
        low = ids.take(pa.array(reach(near)))  # rows are in the order of their ids
        rows = np.flatnonzero(near.any(1))
        near = near[np.ix_(rows, rows)]
        if k:  # pairs that met in an earlier table are counted there
            keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)[rows]
            for s in range(k):
                near &= keys[:, s][:, None] != keys[:, s][None, :]
        at = pa.array(rows)
        return ids.take(at), near @ weight[rows], low.take(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ("dim", "number", "bucket", "i", "j")

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in names:
                v = t[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            at = np.append(np.flatnonzero(new), t.num_rows)
            found = [f for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a > 1 and (f := block(t.slice(a, b - a)))]
            if found:
                ids, n, low = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(n).astype(np.int64)), pa.concat_arrays(low)], ["id", "n", "low"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            differs = np.zeros(t.num_rows, bool)
            for c in names:
                v = t[c].to_numpy()
                differs |= v != v[-1]
            cut = np.flatnonzero(differs)
            if len(cut):
                n = int(cut[-1]) + 1
                yield from done(t.slice(0, n))
                held = t.slice(n).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "id binary, n long, low binary")


def near_vectors(vecs: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vecs (vec_id, embedding); see the module."""
    kind = "array<float>" if dict(vecs.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0)
    one_zero = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0).cast(kind[6:-1])).otherwise(v))
    digest = F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), one_zero, F.size("embedding"))), 16, "0") for k in (1, 2))))
    rows = materialise(rows.select("vec_id", "embedding", F.when(F.coalesce(sound, F.lit(False)), digest).alias("digest")), "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = materialise(classes, "classes")
    bits, tables = tables_for(classes.count(), cosine, miss)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                key = signs(vectors(part.column(3)), bits, tables).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * tables), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["id", "weight", "dim", "embedding", "keys"])

    same = (rows["digest"] == classes["digest"]) & (rows["vec_id"] == classes["least"])
    reps = rows.join(classes, same).select(classes["digest"].alias("id"), "weight", F.size("embedding").alias("dim"), "embedding").dropDuplicates(["id"])
    reps = materialise(reps.mapInArrow(keys, f"id binary, weight long, dim int, embedding {kind}, keys array<int>"), "representatives")
    place = reps.select("id", "dim", F.posexplode("keys").alias("number", "bucket"))
    sizes = place.groupBy("dim", "number", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    place = place.join(sizes, ["dim", "number", "bucket"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    place = place.select("*", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id", "number"), F.col("blocks")).cast("int"))
    # a bucket of k blocks is k * (k + 1) / 2 tasks' work; a row goes to the k that hold its block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    place = place.select("dim", "number", "bucket", "id", "own", other)
    place = place.select("dim", "number", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "id")
    block = ["dim", "number", "bucket", "i", "j"]
    dealt = place.join(reps.drop("dim"), "id").select(*block, "side", "id", "weight", "keys", "embedding")
    dealt = dealt.repartition(*block).sortWithinPartitions(*block, "id")
    found = materialise(compare_blocks(dealt, cosine), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
    by_class = classes.withColumnRenamed("digest", "id").join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    by_class = by_class.select("id", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("group"))
    least = by_class.groupBy("group").agg(F.min("least").alias("component_id"))
    by_class = materialise(by_class.join(least, "group").select(F.col("id").alias("digest"), "n", "component_id"), "groups")
    discard(reps, found)
    kept = F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    linked = rows.where("digest is not null").join(by_class, "digest").select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id", kept)
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
