"""Operator 3: mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). Weights are shares among siblings at each of the three levels and multiply down the
tree; a token budget is propagated with them. A leaf can give its supply times the most epochs; what it can't give goes to
its siblings by their weights first, then to its parent's siblings, then to the domains. A leaf's budget is met with whole
passes (epochs) over its documents and, in the last epoch, the shortest prefix that reaches it of an order seeded by that
epoch's number.

Scale: supplies are one aggregate per leaf; the tree of leaves is planned on the driver in one pass (some hundred bytes a
leaf), and its rows are broadcast up to BROADCAST_LEAVES, else joined. The cut of the last epoch is found without ordering
a leaf: tokens are summed by leaf and by range of the seeded key, and only the range that holds the cut is summed again,
finer, until it holds one key. Documents are then kept by comparing their key with their leaf's cut: no document is
shuffled, and a leaf with a third of all rows costs no more than others.

Defined results: a null text counts 0 tokens and is chosen by its key like others; null lang or source is
a value of its own; documents with equal keys (repeated rows) are kept or left together; a leaf with no weight or no
tokens is left out; an empty table gives no rows; very long texts are counted whole; all columns are kept, whatever their
names. Documents have no domain: unless an expression for it is given, it is derived from the source.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import inner_name, materialise, table

Leaf = tuple[str, str, str]
SPLITS, BITS, BROADCAST_LEAVES = 1 << 12, 62, 50_000
LEAF = ["_domain", "_lang", "_source"]


def tokens_of(text: Column) -> Column:
    """Words: the tokens that budgets count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """A domain from the source, where no catalogue of domains is given."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit(""))), F.lit(domains)).cast("string"))


def epoch_key(row: Column, epoch: Column, seed: int) -> Column:
    """The place of a row, by its hash, in the order of one epoch: from 0, below 2**BITS."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), row), 64 - BITS)


def share(total: float, weights: dict, most: dict) -> dict:
    """Split total by weights under each one's most; what one can't take goes to the others by their weights."""
    out = dict.fromkeys(weights, 0.0)
    open_ = {k for k, w in weights.items() if w > 0 and most[k] > 0}
    left = total
    while open_ and left > 1e-9:
        whole = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / whole >= most[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in sorted(full, key=str):
            left -= most[k]
            out[k] = most[k]
        open_ -= full
    return out


def plan(supply: dict[Leaf, int], weights: dict[tuple, float], total: float, epochs: float) -> dict[Leaf, float]:
    """Budget of each leaf. weights: by path ((domain,), (domain, lang), leaf); 1 where not given."""
    children: dict[tuple, set[tuple]] = defaultdict(set)
    can: dict[tuple, float] = defaultdict(float)  # what a path can give through paths of some weight below it
    for leaf, n in supply.items():
        for k in range(3):
            children[leaf[:k]].add(leaf[: k + 1])
        can[leaf] = n * epochs
        for k in (2, 1):
            if weights.get(leaf[: k + 1], 1.0) <= 0:
                break
            can[leaf[:k]] += n * epochs
    out: dict[Leaf, float] = {}
    budgets: dict[tuple, float] = {(): total}
    for _ in range(3):
        spent: dict[tuple, float] = {}
        for path, budget in budgets.items():
            below = sorted(children[path], key=str)
            spent |= share(budget, {c: weights.get(c, 1.0) for c in below}, {c: can[c] for c in below})
        budgets = spent
    for leaf, b in budgets.items():
        out[leaf] = min(b, can[leaf])
    return out


def mix_sources(docs: DataFrame, weights: dict[tuple, float] | None = None, total: float | None = None, epochs: float = 2.0, temperature: float = 0.7, seed: int = 17, domain: Column | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """The chosen rows of docs, which has doc_id, text, lang and source, once for every epoch they are chosen in.

    Without weights, siblings weigh as their supply to the power `temperature`; without a total, it is the whole supply.
    names: columns for the domain and the epoch (from 0), if wanted.
    """
    spark = docs.sparkSession
    paths = [F.coalesce(c.cast("string"), F.lit("\0")).alias(n) for n, c in zip(LEAF, (domain_of(F.col("source")) if domain is None else domain, F.col("lang"), F.col("source")), strict=True)]
    row = F.xxhash64("doc_id", "text")
    light = materialise(docs.select(*paths, row.alias("_row"), tokens_of(F.col("text")).alias("_n")), "supply")
    supply = {(r[0], r[1], r[2]): r[3] for r in light.groupBy(*LEAF).agg(F.sum("_n")).collect()}  # a row per leaf of the tree
    if weights is None:
        sums: dict[tuple, float] = defaultdict(float)
        for path, n in supply.items():
            for k in (1, 2, 3):
                sums[path[:k]] += n
        weights = {path: n**temperature for path, n in sums.items()}
    budgets = plan(supply, weights, float(sum(supply.values()) if total is None else total), epochs)
    hint = F.broadcast if len(supply) <= BROADCAST_LEAVES else lambda df: df
    whole = {p: int(b // supply[p]) if supply[p] else 0 for p, b in budgets.items()}
    rest = {p: b - whole[p] * supply[p] for p, b in budgets.items()}
    cut = {p: -1 for p in budgets}  # last key kept in the last epoch
    open_ = {p: (0, BITS, rest[p]) for p in budgets if rest[p] > 0.5}  # first key of the range, its bits, tokens still wanted
    fields = ", ".join(f"{n} string" for n in LEAF)
    step = SPLITS.bit_length() - 1
    while open_:  # six rounds at most: each narrows the range of every leaf by SPLITS
        rows = [(*p, base, bits, whole[p]) for p, (base, bits, _) in open_.items()]
        at = hint(spark.createDataFrame(rows, f"{fields}, _base long, _bits int, _whole int"))
        keyed = light.join(at, LEAF).withColumn("_key", epoch_key(F.col("_row"), F.col("_whole"), seed))
        inside = keyed.where(F.expr("_key >= _base and shiftright(_key - _base, _bits) = 0"))
        slot = F.expr(f"shiftright(_key - _base, greatest(_bits - {step}, 0))")
        width = F.greatest(F.col("_bits") - step, F.lit(0))
        sums_ = inside.groupBy(*LEAF, slot.alias("slot"), width.alias("width")).agg(F.sum("_n").alias("n"))
        wanted = hint(spark.createDataFrame([(*p, float(w)) for p, (_, _, w) in open_.items()], f"{fields}, want double"))
        run = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("slot"))  # SPLITS rows a leaf at most
        cuts = sums_.withColumn("run", run).join(wanted, LEAF).where("run >= want").groupBy(*LEAF).agg(F.min(F.struct("slot", "run", "n", "width")).alias("m"))
        found = {(r[0], r[1], r[2]): r["m"] for r in cuts.collect()}  # a row per leaf
        following = {}
        for p, (base, bits, want) in open_.items():
            if p not in found:
                cut[p] = base + (1 << bits) - 1
                continue
            m = found[p]
            first = base + (m["slot"] << m["width"])
            if m["width"] == 0:
                cut[p] = first
            else:
                following[p] = (first, m["width"], want - (m["run"] - m["n"]))
        open_ = following
    rows = [(*p, whole[p], cut[p]) for p in budgets if budgets[p] > 0]
    own = {n: inner_name(docs, n) for n in (*LEAF, "_whole", "_cut", "_epoch")}
    limits = hint(spark.createDataFrame(rows, f"{fields}, _whole int, _cut long").withColumnsRenamed(own))
    marked = docs.withColumns({own[n]: c for n, c in zip(LEAF, paths, strict=True)}).join(limits, [own[n] for n in LEAF])
    whole_, cut_ = F.col(own["_whole"]), F.col(own["_cut"])
    times = whole_ + F.when(epoch_key(row, whole_, seed) <= cut_, 1).otherwise(0)
    chosen = marked.withColumn(own["_epoch"], F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    if not names:
        return chosen.select([F.col(f"`{c}`") for c in docs.columns])
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(own["_domain"]).alias(names[0]), F.col(own["_epoch"]).alias(names[1]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix_sources(docs, names=("domain", "epoch"))
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", tokens_of(F.col("text")).alias("n_tokens"))
