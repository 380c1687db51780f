"""The pipeline against planted documents and brute force of the stages after the classifier."""

import re
from itertools import combinations

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def words(text, pattern):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    made, folder = np.random.default_rng(8), tmp_path_factory.mktemp("corpus")
    prose = lambda n: ". ".join(" ".join(made.choice(WORDS, 9)).capitalize() for _ in range(n)) + "."
    good = [prose(6) for _ in range(150)]
    items = [(k, prose(2)) for k in range(3)]
    copies = [good[0], good[1] + " Once more.", good[2].replace("alpha", "alfa", 1)]
    leaks = [good[3] + " " + items[1][1], items[2][1] + " " + good[4]]
    junk = ["### ".join(made.choice(WORDS, 40)) for _ in range(80)]
    texts = [*good, *copies, *leaks, *junk]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 155), 0) for i in range(len(texts)) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, items


def test_run_equals_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, folder).collect()}
    assert kept == set(range(155))
    sets = {}
    for i in kept:
        w = words(texts[i], r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    comp = {i: i for i in kept}
    for a, b in combinations(sorted(kept), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    plain = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words(t, plain)] for k in range(max(1, len(w) - 9))}
    clean = [i for i in kept if comp[i] == i and not any(tuple(w[k : k + 10]) in windows for w in [words(texts[i], plain)] for k in range(len(w)))]
    theirs = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()}
    wanted = {i: theirs.encode(texts[i], add_special_tokens=False).ids for i in clean}
    assert got == {i: (len(ids), " ".join(map(str, ids))) for i, ids in wanted.items()}
    assert {0, 1, 2, 3, 4} <= kept and not {150, 151, 152, 153, 154} & set(got)


def test_a_score_column_of_the_user_stays(spark, corpus):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").withColumn("_score", F.lit("mine"))
    assert corpus_pipeline.keep_quality(spark, docs, corpus[0]).select("_score").distinct().collect()[0][0] == "mine"
