"""Jaccard join on word shingles, size-aware: subsets for small sets, inverted lists for large ones.

A null or empty text has an empty set and no links; a text shorter than a shingle
is one shingle. Equal sets are one class, known by 128 bits of its set and its size,
and are compared once, whatever ids their rows have: rows that share an id but not a
text are documents of their own. Rows with a null id are left out of links and get a
null component; repeated rows repeat. Very long texts are whole. Sets are held as
64-bit hashes. Only the id and the text are read, so other columns cannot clash.
An empty table gives no rows.
"""

from functools import reduce
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, cut, map_columns, mix, remove, steps, stored, table, windows

#: Shingles are counted in 2 ** BUCKET_BITS buckets, in blocks of BLOCK, by groups of GROUP tasks first.
BUCKET_BITS, BLOCK, GROUP = 20, 4096, 1024
#: Rows of ids that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows of links (two ids each), some 2 MB, that are one partition: so many need no shuffle, however many partitions shuffles have.
LINKS = 1 << 17
#: 64-bit words in a set's sketch, at least; large sets have a bit for two elements.
SKETCH = 8
#: Keys of a set by which a pair's first common list is found; pairs without a common one there come from every list.
FIRST = 16
#: Turns in which unconnected lists are compared with one of their classes, at most; after one that finds less than a link for WORTH rows of lists, what is left is compared pair by pair.
TURNS, WORTH = 8, 200


def shingles(text, n, hashes):
    """Sorted distinct hashes of a text's runs of n words."""
    words = (text or "").encode().lower().split()
    return np.unique(windows(hashes.of(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def least(percent, n):
    """The smallest overlap that a set of n can have with a linked one."""
    return -(-percent * n // 100)


def subsets(percent, n):
    """How many fixed-size subsets a small set of n gives."""
    return sum(comb(n, c) for c in range(least(percent, n), n + 1))


def boundary(percent, list_length, most=20):
    """The largest size up to which subsets cost no more than scanning the prefix's lists."""
    n = 1
    while n < most and subsets(percent, n + 1) <= max(n + 2, (n + 2 - least(percent, n + 1)) * list_length):
        n += 1
    return n


def keys_of(made, counts, percent, light):
    """Hash keys of a set: its subsets if small, the shingles of its emptiest buckets if it may meet a large set."""
    n, keys = len(made), []
    if n <= light:
        for c in range(least(percent, n), n + 1):
            keys += [hash_run(np.array(s, np.uint64), c) for s in combinations(made.tolist(), c)]
    if n and n * 100 >= percent * (light + 1):
        common = counts[made >> np.uint64(64 - BUCKET_BITS)]
        keys += made[np.argsort(common, kind="stable")[: n - least(percent, n) + 1]].tolist()
    return np.array(keys, np.uint64).view(np.int64)


def hash_run(values, salt):
    """One hash of a sorted run of hashes."""
    if not len(values):
        return 0
    both = np.array([np.bitwise_xor.reduce(mix(values + np.uint64(7))), values.sum(dtype=np.uint64)]) * np.array([1, 3], np.uint64)
    return int(mix(both[:1] + both[1:] + np.uint64(salt))[0])


def about(made):
    """(two 64-bit prints, sketch) of a set; the sketch's bits are parities, so an element that differs flips one bit at most."""
    mixed, size = mix(made), 64 * SKETCH
    prints = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed) if len(made) else 0], np.uint64).view(np.int64)
    while size < len(made) / 2:
        size *= 2
    bits = np.bincount((mixed >> np.uint64(36)).astype(np.int64) % size, minlength=size) % 2
    return *prints.tolist(), np.packbits(bits.astype(np.uint8)).view(np.int64)


def differing(x, y):
    """How many elements differ at least, by two sketches; a longer one is folded to half. Null if that is not enough."""
    fold = lambda s: F.zip_with(F.slice(s, F.lit(1), F.floor(F.size(s) / 2).cast("int")), F.slice(s, F.floor(F.size(s) / 2).cast("int") + 1, F.size(s)), lambda p, q: p.bitwiseXOR(q))
    x, y = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)


def shingle_counts(docs, text, n):
    """Counts of all sets' shingles by the leading bits of their hashes, and the mean length of a shingle's list.

    With N shingles in w buckets a shingle seems too frequent by N / w on average and
    stands out from the others from about sqrt(N / w) on. Only the order of keys and
    the boundary follow from the counts, so links do not depend on them. Tasks sum
    their vectors first, then groups of tasks, then all: 4 MB reach the driver.
    """

    def count(batches):
        hashes, sums = WordHashes(), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in steps(batches):
            held = [shingles(t, n, hashes) for t in batch[0].to_pylist()]
            sums += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(sums))
        blocks = sums.astype(np.uint32).reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        group = TaskContext.get().partitionId() // GROUP
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "grp": pa.array([group] * len(some), pa.int32()), "counts": [blocks[k].tobytes() for k in some]})

    def added(got):
        first = got.slice(0, 1)
        total = sum(np.frombuffer(c.as_buffer(), np.uint32).astype(np.uint64) for c in got["counts"])
        return first.set_column(first.schema.get_field_index("counts"), "counts", [[np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]])

    schema = "part int, grp int, counts binary"
    sums = docs.select(text).mapInArrow(count, schema).groupBy("part", "grp").applyInArrow(added, schema).groupBy("part").applyInArrow(added, schema)
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)
    for r in sums.collect():
        counts[r["part"] * BLOCK : (r["part"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    # the second moment of the lists' lengths, from that of the buckets
    total, squares = float(counts.sum(dtype=np.uint64)), float((counts.astype(np.float64) ** 2).sum())
    return counts, max(1.0, (squares - total**2 / len(counts)) / max(1.0, total))


def described(docs, n, percent, counts, light, doc_id, text):
    """Per row: a key of its own, id, hash of the text, size, prints of the set, keys and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        hashes, at = WordHashes(), TaskContext.get().partitionId() << 33

        def step(ids, texts, hashed):
            nonlocal at
            out = []
            for t in texts:
                made = shingles(t, n, hashes)
                p, q, sketch = about(made)
                out.append((at, len(made), p, q, keys_of(made, shared.value, percent, light), sketch))
                at += 1
            rows, *rest = map(list, zip(*out, strict=True))
            return [rows, ids, hashed, *rest]

        return step

    return map_columns(docs, [F.col(doc_id).cast("bigint"), text, F.xxhash64(text)], make, "row bigint, id bigint, hashed bigint, n bigint, p bigint, q bigint, keys array<bigint>, sketch array<bigint>")


def sized(df):
    """A side of a join, broadcast only if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Sets:
    """The classes of equal sets, the lists of keys that several classes share, and exact tests of pairs of classes.

    A class is known by `c`, the least key of its rows. Lists hold only keys and
    classes; sizes and sketches are fetched for distinct pairs, whole sets for the
    pairs that these let pass.
    """

    def __init__(self, docs, n, percent, doc_id, text):
        self.docs, self.n, self.percent, self.doc_id, self.text = docs, n, percent, doc_id, text
        counts, length = shingle_counts(docs, text, n)
        self.rows = stored(described(docs, n, percent, counts, boundary(percent, length), doc_id, text), "sets")
        known = self.rows.where("n > 0 and id is not null")
        self.classes = stored(known.groupBy("p", "q", "n").agg(F.min("row").alias("c"), F.min("id").alias("rep")), "classes")
        chosen = known.join(sized(self.classes.select(F.col("c").alias("row"))), "row", "left_semi")
        members = chosen.select(F.explode("keys").alias("key"), F.col("row").alias("c"))
        lists = members.groupBy("key").agg(F.min("c").alias("hub"), F.count("*").alias("k")).where("k > 1")
        self.held = stored(members.join(lists, "key"), "lists")
        some = self.held.select(F.col("c").alias("row")).distinct()
        self.facts = stored(chosen.join(some, "row", "left_semi").select(F.col("row").alias("c"), "id", "n", "p", "q", "sketch"), "facts")

    def side(self, name):
        """Facts with the class as `name` and other columns marked by it."""
        return self.facts.select(F.col("c").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))

    def fits(self):
        """Whether sizes and sketches of a and b allow a link; a link allows few elements that differ."""
        n, m = F.col("a_n"), F.col("b_n")
        few = differing(F.col("a_sketch"), F.col("b_sketch")) * (100 + self.percent) <= (n + m) * (100 - self.percent)
        return (n * 100 >= m * self.percent) & (m * 100 >= n * self.percent) & F.coalesce(few, F.lit(True))

    def fitting(self, pairs):
        """Those of the pairs (a, b) that sizes and sketches let pass."""
        return pairs.join(self.side("a"), "a").join(self.side("b"), "b").where(self.fits()).select("a", "b")

    def verified(self, pairs):
        """(a, b, overlap) of the pairs that link, by exact comparison of whole sets.

        Each set is made once from its class's text; a pair meets the set of b, and
        then that of a, its hub, which is loaded once for all its partners.
        """
        ids = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        wanted = self.facts.join(ids, "c", "left_semi").select("c", F.col("id").alias("_id"), "p", "q")
        texts = self.docs.select(F.col(self.doc_id).alias("_id"), F.col(self.text).alias("_text")).join(sized(wanted), "_id")
        n = self.n

        def make():
            hashes = WordHashes()

            def step(classes, ps, qs, texts):
                out = [(c, made.view(np.int64)) for c, p, q, t in zip(classes, ps, qs, texts, strict=True) for made in [shingles(t, n, hashes)] if about(made)[:2] == (p, q)]
                return list(zip(*out, strict=True)) or [[], []]

            return step

        sets = map_columns(texts, ["c", "p", "q", "_text"], make, "c bigint, made array<bigint>").dropDuplicates(["c"])
        left = sets.select(F.col("c").alias("a"), F.col("made").alias("x"))
        right = sets.select(F.col("c").alias("b"), F.col("made").alias("y"))
        both = pairs.join(right, "b").join(left, "a").withColumn("overlap", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("overlap") * 100 >= (F.size("x") + F.size("y") - F.col("overlap")) * self.percent).select("a", "b", "overlap")

    def crossed(self, members, apart):
        """Distinct fitting pairs of the members (key, c, ...) of each list for which `apart` holds of the columns l_ and r_.

        A list is joined with itself by cells of size: sets that link lie in the same
        or in neighbouring cells, so a list of many sizes is cut. A pair comes from
        the first list that both are in, where their first keys tell which that is.
        """
        first = self.held.join(members.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST).alias("first"))
        cell = F.floor(F.log(F.col("n").cast("double")) / log(100 / min(self.percent, 99)) * 0.999)
        whole = stored(members.join(self.facts, "c").join(first, "c").withColumn("cell", cell), "open")
        kept = [c for c in whole.columns if c not in ("key", "cell")]
        mark = lambda side: {"c": side, "n": f"{side}_n", "sketch": f"{side}_sketch"}
        left = whole.select("key", "cell", *(F.col(c).alias(mark("a").get(c, f"l_{c}")) for c in kept))
        right = whole.select("key", F.explode(F.array("cell", F.col("cell") - 1)).alias("cell"), *(F.col(c).alias(mark("b").get(c, f"r_{c}")) for c in kept))
        smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
        both = F.array_min(F.array_intersect("l_first", "r_first"))
        found = left.join(right, ["key", "cell"]).where(smaller & self.fits() & apart & F.coalesce(both == F.col("key"), F.lit(True)))
        return found.select("a", "b").distinct(), whole

    def forget(self):
        remove(self.held, self.facts)


def looked_up(rows, known, few):
    """`rows` with the value of each one's key in `known` (key, value): few of both as one partition without a shuffle, more by a join, whose large keys Spark divides."""
    if not few:
        return rows.join(known, "key", "left")
    asked = rows.withColumn("asked", F.lit(True)).unionByName(known.withColumn("asked", F.lit(False)), allowMissingColumns=True).coalesce(1)
    return asked.withColumn("value", F.max("value").over(Window.partitionBy("key"))).where("asked")


def components(edges):
    """(id, comp): the smallest id that links reach, by least labels and pointer jumping.

    A turn of few links is a task, not a task for each partition of each of its shuffles.
    """
    links = edges.select("a", "b").union(edges.select("b", "a"))
    few = links.count() <= LINKS
    folded = lambda df: df.coalesce(1) if few else df
    both = folded(cut(folded(links).distinct()))
    labels = folded(cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id")))
    while True:
        near = looked_up(both.select("a", F.col("b").alias("key")), labels.select(F.col("id").alias("key"), F.col("comp").alias("value")), few)
        near = near.select(F.col("a").alias("id"), F.lit(None).cast("bigint").alias("comp"), F.col("value").alias("low"))
        hooked = folded(near.union(labels.select("id", "comp", F.col("comp").alias("low")))).groupBy("id").agg(F.max("comp").alias("comp"), F.min("low").alias("low"))
        jumped = looked_up(hooked.select("id", "comp", F.col("low").alias("key")), hooked.select(F.col("id").alias("key"), F.col("low").alias("value")), few)
        jumped = folded(cut(jumped.select("id", F.col("comp").alias("was"), F.least("key", "value").alias("comp"))))
        labels = jumped.select("id", "comp")
        if not jumped.where("was != comp").limit(1).count():
            return labels


def placed(docs, n, percent, doc_id, text):
    """Per row: id, hashed, n, component.

    Each list's classes are compared with one of them, which then leaves the list, and
    those of a list that stays unconnected with another one, drawn anew for each list,
    for as long as such turns connect many. All pairs of the others that are still
    unconnected are compared then, so no component is missed while a list of copies
    gives few pairs. A pair is tested once.
    """
    sets = Sets(docs, n, percent, doc_id, text)
    edges, tested, opened = [], [], []

    def labelled(members, labels):
        return members.join(sized(labels.withColumnRenamed("id", "c")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    def linked(pairs, labels=None):
        """Labels by these fitting pairs and by the labels so far, which stand for all links found before."""
        if tested:
            t = reduce(DataFrame.union, tested).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            pairs = pairs.join(t, (F.least("a", "b") == t["x"]) & (F.greatest("a", "b") == t["y"]), "left_anti")
        tested.append(stored(pairs, "pairs"))
        edges.append(stored(sets.verified(tested[-1]).select("a", "b"), "links"))
        return components(edges[-1] if labels is None else edges[-1].union(labels.where("id != comp").select("id", "comp")))

    labels = linked(sets.fitting(sets.held.where("c != hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()))
    members = sets.held.where("c != hub and k > 2").select("key", "c")
    for _ in range(TURNS):
        now = labelled(members, labels)
        drawn = now.groupBy("key").agg(F.min_by(F.struct("c", "comp"), F.xxhash64("key", "c")).alias("h"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1")
        opened.append(stored(now.join(drawn.select("key", F.col("h.c").alias("a"), F.col("h.comp").alias("other")), "key"), "open"))
        labels = linked(sets.fitting(opened[-1].where("comp != other").select("a", F.col("c").alias("b")).distinct()), labels)
        members = opened[-1].where("c != a").select("key", "c")
        if edges[-1].count() * WORTH < opened[-1].count():
            break
    now = labelled(members, labels)
    apart = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
    pairs, whole = sets.crossed(now.join(apart, "key"), F.col("l_comp") != F.col("r_comp"))
    labels = linked(pairs, labels)
    remove(whole, *opened, *tested, *edges)
    sets.forget()
    classes = labelled(sets.classes, labels)
    lowest = classes.join(classes.groupBy("comp").agg(F.min("rep").alias("component")), "comp").select("p", "q", "n", "component")
    out = sets.rows.select("id", "hashed", "p", "q", "n").join(lowest, ["p", "q", "n"], "left")
    return out.select("id", "hashed", "n", F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component"))


def jaccard_components(docs, n=4, percent=85, doc_id="doc_id", text="text"):
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    return placed(docs, n, percent, doc_id, text).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def jaccard_pairs(docs, n=4, percent=85, doc_id="doc_id", text="text"):
    """(pairs, members): all linked pairs (a, b, overlap) of classes of equal sets, and each row's id, n_shingles and class c.

    No pair is left out because its classes are connected otherwise, so a group of
    near copies gives as many pairs as it has links.
    """
    sets = Sets(docs, n, percent, doc_id, text)
    pairs, whole = sets.crossed(sets.held.select("key", "c"), F.lit(True))
    pairs = stored(pairs, "pairs")
    remove(whole)
    members = sets.rows.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "p", "q", "n").join(sets.classes.select("p", "q", "n", "c"), ["p", "q", "n"], "left")
    return sets.verified(pairs), members.select(doc_id, "n_shingles", F.when(F.col(doc_id).isNotNull(), F.col("c")).alias("c"))


def one_of_each(docs, n=4, percent=85, doc_id="doc_id", text="text"):
    """The documents of which none with a smaller id is in the same component; all columns, null ids kept.

    Repeated rows of one id and text stay together.
    """
    gone = placed(docs, n, percent, doc_id, text).where("id != component").select(F.col("id").alias("_gone"), F.col("hashed").alias("_hashed")).distinct()
    return docs.join(gone, (docs[doc_id] == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_hashed"]), "left_anti")


def op6_ngram_join(spark, sf_dir):
    """Set size and component of every document: four-word shingles, 85 of 100."""
    return jaccard_components(table(spark, sf_dir, "documents"))
