"""Corpus pipeline: quality, near copies, benchmark passages, tokens; each stage is written and read again."""

from uuid import uuid4

import public_tokenizers
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, ngram_join, quality
from factloom.llm.common import remainder, shared_folder, table


def keep_quality(spark, docs, sf_dir):
    """Documents that the classifier does not reject; labels are learned from rows that are not held out."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    scored = quality.with_quality(docs, model, name=(name := f"_score_{uuid4().hex}"))
    return scored.where(F.col(name) >= quality.KEEP).drop(name)


def keep_one_of_each(spark, docs, sf_dir):
    """One document, the one with the least id, of each component of five-word shingles at 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def keep_uncontaminated(spark, docs, sf_dir):
    """Documents without a window of ten benchmark words."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """Each document's ids, decimal and joined by a space, with digests of them and of the decoded text."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", keep_quality), ("near_copies", keep_one_of_each), ("decontaminate", keep_uncontaminated), ("bpe", tokens)]
#: SQL has no form of the classifier; tests/llm/test_pipeline.py holds the other stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; each result is written to the shared folder and read as the next one's input."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
