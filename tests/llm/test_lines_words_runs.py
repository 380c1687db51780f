"""Line dedup, spelling variants and periodic runs against plain brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from factloom.llm import line_dedup, periodic_runs, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, h1 string, _t int, word string, n int, id string, line string, period string"


def table(spark, rows):
    """Documents with columns named as the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "x", 1, "x", "x", "x") for i, t in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- lines


def deduped(rows):
    keys = lambda t: [(x, x.strip(" \t\n\x0b\x0c\r").translate(LOW)) for x in (t or "").split("\n")]
    found = defaultdict(set)
    for i, t in rows:
        for _, k in keys(t):
            found[k].add(-1 if i is None else i)
    goes = lambda i, k: len(k) >= 40 and len(found[k]) >= 5 and (-1 if i is None else i) != max(found[k])
    out = []
    for i, t in rows:
        each = keys(t)
        stay = [x for x, k in each if not goes(i, k)]
        out.append((i, len(each), len(each) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=str)


def line_rows():
    r, long = random.Random(4), [f"{c} shared line that is long enough to be a key {c}" for c in "abcdefgh"]
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, "É" * 40), (4, "x" * 39)]
    rows += [(k, "\n".join(r.choice([long[r.randrange(8)], long[0].upper(), f" \t{long[1]}\r", "short", f"own {k} " * 9, "é" * 40, "É" * 40]) for _ in range(r.choice([1, 3, 9, 140])))) for k in range(5, 45)]
    # repeated rows, two texts of one id, and null ids with and without shared lines
    return [*rows, rows[9], (7, long[2]), (7, long[2] + "\n" + long[3]), (None, long[0]), (None, long[0] + "\nother"), (99, "\n".join(long))]


@pytest.mark.parametrize("hot", [2000, 4])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = line_rows()
    found = line_dedup.line_bitmaps(table(spark, rows))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in found.select("doc_id", "n_lines", "n_dropped", line_dedup.kept(found["text"], found["words"]).alias("text")).collect()]
    assert sorted(got, key=str) == deduped(rows)
    assert any(r["words"] and len(r["words"]) > 2 for r in found.collect())


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_bitmaps(table(spark, [])).count() == 0


def test_line_dedup_stays_in_the_jvm(spark, tmp_path):
    table(spark, line_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    plan = line_dedup.op11_line_dedup(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---- words


def slipped(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            k = h % len(w)
            count[w if h % 31 else w[:k] + w[k + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def grouped(n):
    form = {}
    around = {w: [x for x in n if near(w, x)] for w in n}
    for w, words in around.items():
        best = min(words, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return sorted([(w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n], key=str)


def word_rows():
    r = random.Random(8)
    base = ["abababab", "aaaaaaaa", "internationa", "étéétéét", "wordsword", "abcdefgh"]
    rows = [(None, None), (0, ""), (1, "  12 _ "), (2, "İı Straßenbahn straßenbahn STRAßENBAHN ××××××× ×××××××"), (3, ("a" * 3000 + " ") * 2 + ("a" * 3001 + " ") * 30)]
    for k in range(4, 60):
        words = []
        for _ in range(r.randrange(60)):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
                at, c = r.randrange(len(w)), r.choice("abé")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]]) or w
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((k if k % 9 else None, " ".join(words)))
    # chains of forms: each has ten times as many as the one before
    rows += [(100, " ".join(["chainone"] * 400 + ["chainons"] * 40 + ["chaixons"] * 4)), (101, "chaixonsq chaixonsq"), (102, "abcdefgz abcdefgz abcdefgy abcdefgy")]
    return [*rows, rows[10], rows[10]]


def test_spelling_equals_brute_force(spark):
    rows = word_rows()
    got = sorted((tuple(r) for r in spelling.variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == grouped(slipped(rows))
    assert any(form and form != root for _, form, root, *_ in got)


def test_spelling_of_nothing(spark):
    assert spelling.variants(table(spark, [])).count() == 0 and spelling.variants(table(spark, [(1, None), (2, "short")])).count() == 0


def test_keys_of_deletions():
    import numpy as np

    words = ["abcabc", "aabbcc", "cccccc"]
    rows, k, c, low, high = spelling.keys_of(np.array([[ord(x) for x in w] for w in words], np.uint32))
    for w, own in ((w, i) for i, w in enumerate(words)):
        mine = [(int(k[x]), int(c[x]), int(low[x]), int(high[x])) for x in np.flatnonzero(rows == own)]
        assert len(mine) == 1 + len({w[:i] + w[i + 1 :] for i in range(6)}) and sorted(x for _, _, a, b in mine if a >= 0 for x in range(a, b + 1)) == list(range(6))
        for kk, cc, a, _ in mine:
            short = w if a < 0 else w[:a] + w[a + 1 :]
            _, k1, c1, low1, _ = spelling.keys_of(np.array([[ord(x) for x in short]], np.uint32))
            assert (kk, cc) == (int(k1[0]), int(c1[0])) and low1[0] == -1


# ---- runs


def runs_of(w):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(24, 3 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.add((i, len(s), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def told(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_of(w)
    top = None
    for s, size, q in found:
        if top is None or (size * top[2], -s, -q) > (top[1] * q, -top[0], -top[2]):
            top = s, size, q
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


def run_rows():
    r = random.Random(6)
    rows = [(None, None), (0, ""), (1, " \t\x0b"), (2, "a " * 500), (3, "a b " * 24), (4, "a b " * 11 + "a"), (5, "a b " * 12)]
    for k in range(6, 90):
        words = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randrange(160))]
        for _ in range(r.randrange(4)):
            a, p = r.randrange(len(words) + 1), r.randint(1, 30)
            for i in range(a + p, min(len(words), a + r.randint(24, 110))):
                words[i] = words[i - p]
        rows.append((k, r.choice([" ", "\n", " \x1c "]).join(words)))
    return [*rows, rows[8], rows[8], (8, "another text of the same id"), (None, "a " * 30)]


@pytest.mark.parametrize("how", [{}, {"whole": 60, "lags": 5}])
def test_periodic_runs_equal_brute_force(spark, how):
    rows = run_rows()
    got = [tuple(r) for r in periodic_runs.periodic_runs(table(spark, rows), **how).collect()]
    assert sorted(got, key=str) == sorted([told(*r) for r in rows], key=str)


def test_periodic_runs_of_long_texts(spark):
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(words * 5 + ["x"] * 60000 + words[:100] * 7)
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.periodic_runs(table(spark, [(3, text), (4, None)]), change=lambda _, w: w, whole=1000, lags=1000).collect()}
    assert got[3][1:6] == (3, 15000, 60000, 1, 60_000_000) and got[4][1] == 0
    assert periodic_runs.periodic_runs(table(spark, [])).count() == 0
