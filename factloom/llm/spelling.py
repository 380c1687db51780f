"""Spelling variants: words one insertion, deletion or replacement apart, by a symmetric-delete join.

Every word emits a key for itself and one for each distinct deletion of one code point.
Two words are near if one's own key is a deletion of the other, or if they share a deletion
taken at the same place; so each near pair meets at one key, and a key of L code points is
shared by no more than (L + 1) times the letters that there are. Keys are 128-bit sums of
letters weighted by place, so that all deletions of a word take one pass over it and no
row carries a text. Words have numbers in code-point order, by which ties are settled.

The form of a word is its near word of most occurrences, if it has TIMES as many; roots
are found by joining forms with forms until the longest chain that the counts allow is met.

Null and empty texts have no words; a null id counts as the empty text where a word's slip
is drawn. Repeated rows count again; an empty table gives no rows; other columns are not
read. Very long words are whole.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, mix, stored, table

#: Letters of words, and A-Z with what they become. Fixed values.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run of letters in SLIPS loses a letter.
SLIPS = 31
TIMES = 10
KEYS = "k bigint, c bigint, id bigint, n bigint, low int, high int"
#: Letters of words whose keys are made at once.
STEP = 1 << 18


def word_counts(docs, min_chars=7, min_count=2):
    """(word, n) of the words of all texts, slips included."""
    # shorter runs can't give words that are long enough
    run = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("w"))
    h = run.select("w", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "w")).alias("h"))
    at = F.expr("cast(h % length(w) as int)")
    word = F.when(F.col("h") % SLIPS != 0, F.col("w")).otherwise(F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2)))
    return h.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def numbered(counts):
    """(id, word, n), ids rising in code-point order; written once, so that they stay."""
    return stored(counts.sort("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def places(size, seed):
    """Weights of the places in a key."""
    return mix(np.arange(size, dtype=np.uint64) * np.uint64(2) + np.uint64(seed))


def keys_of(letters):
    """For words of one length, as rows of code points: (rows, k, c, low, high) of their keys; low is -1 for a word's own."""
    m, size = letters.shape
    value = mix(letters.astype(np.uint64) + np.uint64(1 << 40))
    sums = []
    for seed in (1 << 50, 1 << 51):
        w = places(size, seed)
        before = np.zeros((m, size + 1), np.uint64)
        np.cumsum(value * w, axis=1, out=before[:, 1:])
        # a letter behind the deleted one stands one place further ahead
        moved = np.zeros((m, size + 1), np.uint64)
        np.cumsum(value[:, 1:] * w[:-1], axis=1, out=moved[:, 2:])
        gone = before[:, :-1] + moved[:, -1:] - moved[:, 1:]
        sums.append((before[:, -1], gone))
    # equal neighbours give one deletion: that of the first, which stands for all up to `high`
    first = np.ones((m, size), bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, low = np.nonzero(first)
    high = np.append(low[1:], size) - 1
    high[np.append(row[1:] != row[:-1], True)] = size - 1
    rows = np.concatenate([np.arange(m), row])
    k, c = (np.concatenate([own, gone[row, low]]) for own, gone in sums)
    none = np.full(m, -1)
    return rows, k.view(np.int64), c.view(np.int64), np.concatenate([none, low]), np.concatenate([none, high])


def emitted(words):
    """(k, c, id, n, low, high) for each word's own key and its distinct deletions."""

    fields = StructType.fromDDL(KEYS)

    def run(batches):
        schema = to_arrow_schema(fields)
        for batch in batches:
            ids, n = batch["id"].to_numpy(), batch["n"].to_numpy()
            texts = batch["word"].to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for size in np.unique(sizes).tolist():
                alike = np.flatnonzero(sizes == size)
                for some in np.array_split(alike, -(-len(alike) * size // STEP)):
                    if len(some):
                        letters = np.frombuffer("".join([texts[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), size)
                        rows, k, c, low, high = keys_of(letters)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((k, c, ids[some][rows], n[some][rows], low, high), schema.types, strict=True)], schema=schema)

    return words.select("id", "word", "n").mapInArrow(run, fields)


def near_pairs(keys):
    """(id, n, near_id, near_n) of words at a distance of exactly one, both ways round."""
    a, b = keys.alias("a"), keys.alias("b")
    own = (F.col("a.low") < 0) | (F.col("b.low") < 0)
    # two deletions come from words that differ in one place if they can be taken at one place
    same_place = (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.id") != F.col("b.id")) & (own | same_place)
    return a.join(b, on).select("a.id", "a.n", F.col("b.id").alias("near_id"), F.col("b.n").alias("near_n"))


def forms(pairs, times=TIMES):
    """(id, n_near, form_id, form_n): the near word of most occurrences, the first of equals, if it has `times` as many."""
    fits = F.when(F.col("near_n") >= times * F.col("n"), F.struct((-F.col("near_n")).alias("less"), "near_id"))
    best = pairs.groupBy("id").agg(F.count("*").alias("n_near"), F.min(fits).alias("best"))
    return best.select("id", "n_near", F.col("best.near_id").alias("form_id"), (-F.col("best.less")).alias("form_n"))


def roots(found, most, times=TIMES, least=2):
    """(id, root_id) of the words with a form; `most` is the greatest count of a word, `least` the smallest."""
    out = found.where(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("root_id"))
    # counts rise by `times` from form to form, and a step doubles the way
    longest = max(1, math.floor(math.log(max(1, most / least), times) + 1e-9))
    for _ in range(math.ceil(math.log2(longest))):
        out = cut(out)
        on = out.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        out = out.join(on, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"))
    return out


def variants(docs, min_chars=7, min_count=2, times=TIMES):
    """Per word: word, form, root, n, n_near, form_n."""
    words = numbered(word_counts(docs, min_chars, min_count))
    found = cut(forms(near_pairs(emitted(words)), times))
    most = words.agg(F.max("n")).collect()[0][0] or 0
    name = lambda kind: words.select(F.col("id").alias(f"{kind}_id"), F.col("word").alias(kind))
    rooted = roots(found, most, times, min_count)
    with_form = found.where(F.col("form_id").isNotNull()).join(rooted, "id").join(name("form"), "form_id").join(name("root"), "root_id").select("id", "form", "root")
    all_ = words.join(found.select("id", "n_near", "form_n"), "id", "left").join(with_form, "id", "left")
    return all_.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def op12_spelling(spark, sf_dir):
    """Form, root and counts of every word of the documents."""
    return variants(table(spark, sf_dir, "documents"))
