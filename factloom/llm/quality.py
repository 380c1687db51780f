"""Quality classifier: histogram gradient-boosted trees over document statistics.

A null text counts as empty and gets a score; rows with labels that are null are
not learned from; of repeated labels the lowest counts. Without labels every
document scores the prior, which keeps it. Ties in the bounded sample are broken
by the id's hash, so a run repeats; of a repeated document one row is learned from,
the one with the least text hash. Very long texts are whole. An empty table has no
scores. Other columns are passed through unread; one that has the score's name is
replaced.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import remainder, table

KEEP = 0.7
#: Bytes counted together: capitals, digits, bars, marks, ends of sentences, white space, non-ASCII.
GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#$%&*@~^<>{}[]\\/=+_", b".!?", b",;:", b" \t", b"\n", bytes(range(128, 256))]
GROUP_OF = np.array([[b in g for b in range(256)] for g in GROUPS], np.float64).T
FEATURES = len(GROUPS) + 10


def statistics(text):
    """Numbers that describe one text; none depends on anything else."""
    data = (text or "").encode()
    if not data:
        return np.zeros(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    share = counts / len(data)
    words, lines = data.split(), data.split(b"\n")
    n, different = max(1, len(words)), len(set(words))
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines)
    return np.concatenate([share @ GROUP_OF, [np.log1p(len(data)), np.log1p(n), len(data) / n, different / n, different / n**0.8, len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)), ended / len(lines), -(share[share > 0] * np.log(share[share > 0])).sum(), max(map(len, words), default=0) / len(data)]])


def matrix(texts):
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, FEATURES))


class Trees:
    """Boosted trees as flat arrays: feature, threshold, left child and value of every node."""

    def __init__(self, prior):
        self.prior, self.roots = prior, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []

    def fit(self, x, y, trees=80, depth=4, rate=0.15, bins=64, least=5.0, ridge=1.0):
        """Second-order boosting of the logistic loss on histograms of quantile bins."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
        total = np.full(len(y), self.prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            self.roots.append(len(self.feature))
            self.grow(edges, binned, np.arange(len(y)), p - y, p * (1 - p), total, depth, (rate, bins, least, ridge))
        return self.packed()

    def grow(self, edges, binned, rows, gradient, curve, total, depth, how):
        rate, bins, least, ridge = how
        node, g, h = len(self.feature), gradient[rows].sum(), curve[rows].sum()
        for column, value in ((self.feature, 0), (self.threshold, np.inf), (self.left, -1), (self.value, -rate * g / (h + ridge))):
            column.append(value)
        best = (1e-6, None)
        for f, e in enumerate(edges if depth else []):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], curve[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(e) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            if gain[k := int(gain.argmax())] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            total[rows] += self.value[node]
            return
        f, k = best[1]
        self.feature[node], self.threshold[node] = f, edges[f][k]
        below = binned[rows, f] <= k
        rights = []
        for side in (below, ~below):
            rights.append(len(self.feature))
            self.grow(edges, binned, rows[side], gradient, curve, total, depth - 1, how)
        self.left[node] = rights

    def packed(self):
        pairs = np.array([p if p != -1 else (i, i) for i, p in enumerate(self.left)], np.int32).reshape(-1, 2)
        return Flat(self.prior, np.array(self.roots, np.int32), np.array(self.feature, np.int32), np.array(self.threshold), pairs, np.array(self.value))


class Flat:
    """Fitted trees; a leaf's children are itself, so all rows take the same steps."""

    def __init__(self, prior, roots, feature, threshold, children, value):
        self.prior, self.roots, self.feature, self.threshold, self.children, self.value = prior, roots, feature, threshold, children, value

    def score(self, x):
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while len(x) and len(self.roots):
            after = self.children[at, (x[rows, self.feature[at]] > self.threshold[at]).astype(int)]
            if (after == at).all():
                break
            at = after
        total = self.prior + (self.value[at].sum(axis=1) if len(self.roots) else 0.0)
        return 1 / (1 + np.exp(-(total + np.zeros(len(x)))))


def fit_quality(docs, labels, training, max_rows=20_000, text="text"):
    """Trees fitted to `labels.quality` on at most `max_rows` labelled documents for which `training` holds."""
    chosen = labels.where(training & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts.tolist())))

    known = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("doc_id").agg(F.min("_label").alias("_label"), F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = known.select("doc_id", "_label", described("_text").alias("x")).toArrow().to_pandas().sort_values("doc_id", kind="stable")
    y = rows["_label"].to_numpy(np.float64)
    share = (y.sum() + 1) / (len(y) + 1.01)
    trees = Trees(float(np.log(share / (1 - share))))
    return trees.fit(np.stack(rows["x"]), y) if len(y) else trees.packed()


def with_quality(docs, model, text="text", name="score"):
    """The documents with a column of scores from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(matrix(texts.tolist())), dtype="float64")

    return docs.withColumn(name, score(F.col(text)))


def op10_quality(spark, sf_dir):
    """Every document's score, learned from labels of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    scored = with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
