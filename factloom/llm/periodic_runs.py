"""Periodic runs of words, found by comparing a text's word numbers with themselves at every lag.

A run is a stretch of consecutive words with smallest period q and a length of at least
LEAST and of MIN_EXP * q, that no neighbouring word extends with the period kept. At a lag
of q it is a stretch of equal pairs (i, i + q) of length max(LEAST - q, (MIN_EXP - 1) * q)
or more, so two neighbouring ones of pairs taken at half that distance lie in it. A task
compares these pairs of all lags up to n / MIN_EXP at once, then what lies between them,
and measures the stretches that are left word by word. A stretch that several lags find
has the smallest of them as its period: a multiple of a run's period gives the same
stretch, no other lag does.

Texts of up to WHOLE bytes are searched where they are. A longer one is dealt out over the
cluster in ranges of RANGE lags; the stretches of its ranges meet by text and place.

A null or empty text has no words and no runs; a null id changes no words. Repeated rows
repeat; an empty table gives no rows; other columns are not read.
"""

import zlib
from fractions import Fraction
from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import functions as F

from .common import map_columns, sha, table

LEAST, MIN_EXP = 24, 3
#: Bytes of texts that one task searches whole, and lags of a range of longer ones.
WHOLE, RANGE = 1 << 19, 1 << 14
#: Pairs compared at once.
PAIRS = 1 << 20
FOUND = "array<struct<start: bigint, length: bigint, period: bigint>>"
RESULT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def planted(doc_id, words):
    """The words of a document with the repeats that its id calls for."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def distance(lag):
    """How far apart the pairs of a lag may be taken: half of the shortest stretch that is a run."""
    return np.maximum(LEAST - lag, (MIN_EXP - 1) * lag) // 2


@lru_cache(maxsize=64)
def pairs(n, low, high):
    """(places, lags, distances) of the pairs to compare for the lags from low to high in n words, lag by lag."""
    lags = np.arange(low, high)
    apart = distance(lags)
    count = np.maximum(0, (n - lags + apart - 1) // apart)
    lag, far = np.repeat(lags, count), np.repeat(apart, count)
    nth = np.arange(len(lag)) - np.repeat(np.cumsum(count) - count, count)
    return nth * far, lag, far


def blocks(n, low, high):
    """Ranges of lags with about PAIRS pairs, one lag at least."""
    while low < high:
        # the first lags have most pairs, so those of `low` bound the rest
        to = min(high, low + max(1, PAIRS * int(distance(np.array(low))) // n))
        yield low, to
        low = to


def differs(ids, at, lag, step, end):
    """The first place from `at` on, going by `step` of 1 or -1 up to `end`, where the pair is not equal."""
    size = 64
    while at != end:
        some = min(size, abs(end - at))
        place = slice(at, at + some) if step > 0 else slice(at - some + 1, at + 1)
        unequal = np.flatnonzero(ids[place] != ids[place.start + lag : place.stop + lag])
        if len(unequal):
            return place.start + int(unequal[0 if step > 0 else -1])
        at, size = at + step * some, size * 4
    return end


def stretches(ids, low, high):
    """{(start, end): smallest period found} of the runs at lags from low to high in an array of word numbers."""
    n, found, longest = len(ids), {}, None
    high = min(high, n // MIN_EXP + 1)
    if n < LEAST or low >= high:
        return found
    # short texts share their pairs with others of about their length: numbers below zero equal nothing
    size = 1 << (n - 1).bit_length() if n <= 1 << 12 else n
    padded = np.concatenate([ids, np.arange(-1, n - size - 1, -1, dtype=ids.dtype)]) if size > n else ids
    top = size // MIN_EXP + 1 if size > n and low == 1 and high == n // MIN_EXP + 1 else high
    for a, b in blocks(size, low, top):
        # padded lengths are few, so what they need is remembered
        place, lag, far = pairs(size, a, b) if size > n else pairs.__wrapped__(size, a, b)
        equal = padded[place] == padded[place + lag]
        first = np.flatnonzero(equal[:-1] & equal[1:] & (lag[:-1] == lag[1:]))
        for part in (2, 4, 3, 5, 7):  # what lies between two equal pairs has to be equal
            between = place[first] + far[first] // part
            first = first[padded[between] == padded[between + lag[first]]]
        place, lag = place[first], lag[first]
        cuts = [*np.flatnonzero(np.diff(lag, prepend=-1)).tolist(), len(lag)]
        for x, y in pairwise(cuts):
            q, at, end, k = int(lag[x]), place[x:y], 0, 0
            while k < len(at):
                here = int(at[k])
                # pairs within a run whose period divides the lag are that run's own stretch
                if longest and q % longest[2] == 0 and longest[0] <= here and here + q < longest[1]:
                    end = longest[1] - q
                else:
                    start, end = differs(ids, here, q, -1, end - 1) + 1, differs(ids, here, q, 1, n - q)
                    if end - start >= max(LEAST - q, (MIN_EXP - 1) * q):
                        found.setdefault((start, end + q), q)
                        if not longest or end + q - start > longest[1] - longest[0]:
                            longest = start, end + q, q
                k = int(np.searchsorted(at, end))
    return found


def word_numbers(words):
    """Words as numbers, equal for equal words."""
    numbers = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def best(runs):
    """The run with the greatest length a period; of equals the first, then that of the smallest period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words, runs):
    """The words outside runs and those of each run's first period, joined by spaces."""
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s]) if runs else b" ".join(words)


def summary(words, runs):
    """The columns of RESULT for words and their runs of (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    top = best(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(listed), sha(collapsed(words, runs)))


def words_of(text):
    # bytes are split at the white space of ASCII, nothing else
    return (text or "").encode().split()


def as_runs(found):
    return [(s, e - s, q) for (s, e), q in found.items()]


def periodic_runs(docs, change=planted, whole=WHOLE, lags=RANGE):
    """Per row: doc_id and the columns of RESULT; `change(doc_id, words)` gives the words to search."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def search(ids, texts):
        out = []
        for i, t in zip(ids, texts, strict=True):
            words = change(i, words_of(t))
            out.append((i, *summary(words, as_runs(stretches(word_numbers(words), 1, len(words))))))
        return list(map(list, zip(*out, strict=True))) if out else [[] for _ in range(8)]

    def part(ids, keys, texts, ranges):
        found = [as_runs(stretches(word_numbers(change(i, words_of(t))), 1 + r * lags, 1 + (r + 1) * lags)) for i, t, r in zip(ids, texts, ranges, strict=True)]
        return ids, keys, [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]

    def finish(ids, texts, runs):
        out = [(i, *summary(change(i, words_of(t)), [(r["start"], r["length"], r["period"]) for r in found or []])) for i, t, found in zip(ids, texts, runs, strict=True)]
        return list(map(list, zip(*out, strict=True))) if out else [[] for _ in range(8)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    here = map_columns(docs.where(size <= whole), ["doc_id", "text"], lambda: search, f"doc_id {kind}, {RESULT}")
    long = docs.where(size > whole).select("doc_id", "text", F.xxhash64("text").alias("_t"))
    # a word and the space after it have two bytes at least
    count = F.ceil(F.octet_length("text") / (2 * MIN_EXP * lags)).cast("int")
    dealt = long.dropDuplicates(["doc_id", "_t"]).select("doc_id", "_t", "text", F.explode(F.sequence(F.lit(0), count)).alias("range")).repartition("doc_id", "_t", "range")
    found = map_columns(dealt, ["doc_id", "_t", "text", "range"], lambda: part, f"doc_id {kind}, _t bigint, runs {FOUND}")
    one = found.select("doc_id", "_t", F.inline("runs")).groupBy("doc_id", "_t", "start", "length").agg(F.min("period").alias("period"))
    of_text = one.groupBy(F.col("doc_id").alias("_doc"), F.col("_t").alias("_u")).agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    joined = long.join(of_text, long["doc_id"].eqNullSafe(of_text["_doc"]) & (long["_t"] == of_text["_u"]), "left")
    return here.unionByName(map_columns(joined, ["doc_id", "text", "runs"], lambda: finish, f"doc_id {kind}, {RESULT}"))


def op13_periodic_runs(spark, sf_dir):
    """Runs, the strongest of them, and the digest of the collapsed text, of every whole document."""
    return periodic_runs(table(spark, sf_dir, "documents"))
