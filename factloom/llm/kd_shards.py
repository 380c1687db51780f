"""Sharding by a k-d tree over metadata, with distributed weighted medians.

Every row gets a shard. Null texts weigh nothing but the row's overhead; ties in a
dimension are broken by a hash of the row and its place in the input, so that equal
values and repeated rows are divided too. An empty table gives no rows. Repeated rows
each get a slot of their own. Very long texts are whole: only their sizes are moved.
Columns named _row, _k0, _k1, ..., _b, _at, _from, shard and slot are taken.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, table

BINS = 4096


class Tree:
    """Inner nodes (dimension, key at or below which rows go left) and the leaves' (first shard, number of shards)."""

    def __init__(self, shards):
        self.cuts, self.leaves, self.flat = {}, {0: (0, shards)}, None

    def nodes(self, keys):
        """The leaf of each row of a matrix of keys: all rows go down a level at once, by gathers."""
        at, rows = np.zeros(len(keys), np.int64), np.arange(len(keys))
        if self.flat is None:
            inner, self.flat = np.array(sorted(self.cuts), np.int64), [0, 0]
            size = int(inner.max(initial=-1)) * 2 + 3
            self.flat = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            for node, (i, key) in self.cuts.items():
                self.flat[0][node], self.flat[1][node] = i, key
        dimension, key = self.flat
        while len(rows):
            rows = rows[dimension[at[rows]] >= 0]
            here = at[rows]
            at[rows] = 2 * here + 1 + (keys[rows, dimension[here]] > key[here])
        return at

    def split(self, cuts):
        """Give each leaf with several shards two children; one without a cut keeps all its rows on the left."""
        self.flat = None
        for node, (first, n) in list(self.leaves.items()):
            if n > 1:
                self.cuts[node] = cuts.get(node, (0, 1 << 62))
                self.leaves |= {2 * node + 1: (first, n // 2), 2 * node + 2: (first + n // 2, n - n // 2)}
                del self.leaves[node]


def extents(keyed, keys, tree, weight):
    """Per leaf: weight, least and greatest key of each dimension."""
    names = [f"{f}{i}" for i in range(len(keys)) for f in ("a", "b")]

    def part(frames):
        for frame in frames:
            k = frame[keys].to_numpy(np.int64)
            wide = pd.DataFrame({n: k[:, i // 2] for i, n in enumerate(names)}).assign(node=tree.nodes(k), w=frame[weight].to_numpy(np.int64))
            yield wide.groupby("node", as_index=False).agg({"w": "sum"} | {n: "min" if n[0] == "a" else "max" for n in names})

    parts = keyed.select(*keys, weight).mapInPandas(part, "node bigint, w bigint, " + ", ".join(f"{n} bigint" for n in names))
    found = parts.groupBy("node").agg(F.sum("w").alias("w"), *((F.min if n[0] == "a" else F.max)(n).alias(n) for n in names))
    return {r["node"]: r for r in found.collect()}


def weighted_cuts(keyed, keys, tree, weight, goals, slack):
    """{leaf: (dimension, key)} that divide leaves as goals = {leaf: (dimension, low, high, weight on the left, slack)} ask.

    Each round counts BINS bins of each leaf's range in Spark, where a window finds the
    bin that holds the goal: a row a leaf comes back, which narrows the range, until
    one row or less than the slack is left.
    """
    done, open_ = {}, {n: (i, lo, hi, goal, 0) for n, (i, lo, hi, goal) in goals.items()}
    while open_:
        ask = {n: (i, lo, max(1, -(-(hi - lo + 1) // BINS))) for n, (i, lo, hi, _, _) in open_.items()}
        asked = np.array(sorted(ask), np.int64)
        which, lows, steps = (np.array([ask[n][j] for n in asked.tolist()], np.int64) for j in range(3))

        def part(frames, asked=asked, which=which, lows=lows, steps=steps):
            for frame in frames:
                k, w = frame[keys].to_numpy(np.int64), frame[weight].to_numpy(np.int64)
                at = tree.nodes(k)
                j = np.minimum(np.searchsorted(asked, at), len(asked) - 1)
                rows = np.flatnonzero(asked[j] == at)
                j = j[rows]
                b = (k[rows, which[j]] - lows[j]) // steps[j]
                inside = (b >= 0) & (b < BINS)
                values, where, n = np.unique(j[inside] * BINS + b[inside], return_inverse=True, return_counts=True)
                sums = np.zeros(len(values), np.int64)
                np.add.at(sums, where, w[rows][inside])
                yield pd.DataFrame({"node": asked[values // BINS], "bin": values % BINS, "w": sums, "n": n})

        bins = keyed.select(*keys, weight).mapInPandas(part, "node bigint, bin bigint, w bigint, n bigint").groupBy("node", "bin").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        wanted = keyed.sparkSession.createDataFrame([(n, float(goal), int(before)) for n, (_, _, _, goal, before) in open_.items()], "node bigint, goal double, before bigint")
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("before")
        found = bins.join(wanted, "node").withColumn("upto", upto).groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", "w", "n", "upto"))), F.max(F.struct("bin", "w", "n", "upto"))).alias("r"))
        answers = dict(found.collect())
        for node, (b, w, n, above) in answers.items():
            i, _, _, goal, _ = open_.pop(node)
            _, low, step = ask[node]
            first, last = low + b * step, low + (b + 1) * step - 1
            if step == 1 or n == 1 or w <= slack:
                done[node] = (i, last if abs(above - goal) <= abs(above - w - goal) else first - 1)
            else:
                open_[node] = (i, first, last, goal, above - w)
        for node in set(ask) - set(answers):
            done[node] = (open_[node][0], open_.pop(node)[1] - 1)
    return done


def shard(rows, dimensions, shards, weight="size", slack=2e-4):
    """Add `shard` to rows by a k-d tree of `shards` leaves of near equal weight.

    dimensions: bigint columns in [0, 2^30). Leaves are split level by level, each
    along its widest dimension relative to the whole table's, at the weight that
    its share of shards asks for. Only a range and a bin of each leaf reach the driver.
    Rows also get `_row`, a number of their own, by which `with_slots` deals them out.
    """
    salt = F.xxhash64("_row", *rows.columns).bitwiseAND(F.lit(0x3FFFFFFF))
    keys = [f"_k{i}" for i in range(len(dimensions))]
    keyed = cut(rows.withColumn("_row", F.monotonically_increasing_id()).select("*", *(F.shiftleft(F.coalesce(F.col(d), F.lit(0)).cast("long"), 30).bitwiseOR(salt).alias(k) for d, k in zip(dimensions, keys, strict=True))))
    tree, spans = Tree(shards), None
    while any(n > 1 for _, n in tree.leaves.values()):
        found = extents(keyed, keys, tree, weight)
        if not found:
            break
        spans = spans or [max(1, found[0][f"b{i}"] - found[0][f"a{i}"]) for i in range(len(keys))]
        goals = {}
        for node, (_, n) in tree.leaves.items():
            if n > 1 and (r := found.get(node)):
                i = max(range(len(keys)), key=lambda i: (r[f"b{i}"] - r[f"a{i}"]) / spans[i])
                goals[node] = (i, r[f"a{i}"], r[f"b{i}"], r["w"] * (n // 2) / n)
        each = sum(r["w"] for r in found.values()) / shards
        tree.split(weighted_cuts(keyed, keys, tree, weight, goals, each * slack))

    @F.pandas_udf("int")
    def place(*columns: pd.Series) -> pd.Series:
        at = tree.nodes(np.column_stack([c.to_numpy(np.int64) for c in columns]))
        return pd.Series([tree.leaves[n][0] for n in at.tolist()], dtype="int32")

    return keyed.withColumn("shard", place(*keys)).drop(*keys)


def with_slots(rows, buckets=256):
    """Number the rows of each shard from 0 without gaps: buckets are counted, then numbered apart. Drops `_row`."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("n"))
    before = counts.withColumn("_from", F.sum("n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("n")).drop("n")
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_row")) - 1)
    return numbered.join(before, ["shard", "_b"]).withColumn("slot", (F.col("_from") + F.col("_at")).cast("long")).drop("_b", "_at", "_from", "_row")


def op8_kd_shards(spark, sf_dir, shards=40):
    """Every document's shard among 40 of near equal bytes, by id, length and source."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(
        "doc_id", (size + 16).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.least(F.log2(size + 1) * (1 << 24), F.lit((1 << 30) - 1)).cast("long").alias("d_size"),
        (F.crc32(F.coalesce("source", F.lit(""))) % (1 << 20)).alias("d_source"),
        F.pmod(F.col("doc_id"), F.lit(1 << 30)).alias("d_id"),
    )
    out = with_slots(shard(rows, ["d_size", "d_source", "d_id"], shards).drop("d_size", "d_source", "d_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
