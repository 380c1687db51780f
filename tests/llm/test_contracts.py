"""The columns of query results against plain Python, on whole tables of the smallest scale."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import bloom_lm, html_text, kd_shards, quality, tiff

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def by_id(rows, key="doc_id"):
    found = rows.collect()
    out = {r[key]: r.asDict() for r in found}
    assert len(out) == len(found)
    return out


def test_op1_lengths(spark):
    rows = by_id(html_text.op1_html_text(spark, DIR), "page_id")
    assert len(rows) == spark.read.parquet(f"{DIR}/pages.parquet").count()
    for r in rows.values():
        assert r["n_chars"] == len(r["text"]) and "<" not in re.sub(r"<(?![a-z/])", "", r["text"])
        assert all(b == b.strip() and not re.search(r"\s\s", b) for b in r["text"].split("\n\n")) and r["url"]


def test_op4_payloads(spark, texts):
    rows = by_id(tiff.op4_tiff(spark, DIR))
    assert rows.keys() == texts.keys()
    features = {}
    for i, t in texts.items():
        data, r = t.encode(), rows[i]
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        wanted = len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == wanted
        assert re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["media_bytes"] > 0
        assert features.setdefault(t, (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])


def test_op8_law(spark, texts):
    rows = by_id(kd_shards.op8_kd_shards(spark, DIR))
    assert rows.keys() == texts.keys()
    bytes_, counts, slots = Counter(), Counter(), {}
    for i, t in texts.items():
        r = rows[i]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 16, zlib.crc32(t.encode())) and 0 <= r["shard"] < 40
        bytes_[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r["law"] for r in rows.values()}) == 1
    law = next(iter(rows.values()))["law"]
    assert law == "bytes" and all(r["grown_shard"] is None for r in rows.values())
    assert max(bytes_.values()) <= sum(bytes_.values()) / 40 + max(r["size"] for r in rows.values())


def test_op9_base_scores(spark, texts):
    rows = by_id(bloom_lm.op9_bloom_lm(spark, DIR))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", t.translate(low)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_op10_scores(spark, texts):
    rows = by_id(quality.op10_quality(spark, DIR))
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
