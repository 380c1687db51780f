"""Token counts of documents in flat token files without an index.

A file is a run of identifiers of one width (16 bits, or 32 by `kind`) in which a
separator ends each document; it is held as blocks, rows of (file, block, tokens).
Each block finds its separators at once and tells how many tokens stand before,
between and after them; a prefix scan joins what crosses the bounds of blocks, within
groups of GROUP blocks and then over the groups, so no file is one task's work.
Tokens after a file's last separator are a document if there are any. Empty documents
count 0; empty files and an empty table have none. A null text is empty, repeated rows
repeat, very long texts cross blocks. Only the id and the text are read.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

SEPARATOR = 65535
BLOCK_TOKENS, GROUP = 1 << 19, 1024
ORACLE_SQL = "select doc_id, octet_length(encode(coalesce(text, ''))) as n_tokens from documents"


def write_flat(docs, folder, separator=SEPARATOR, text="text", kind="<u2", block_tokens=BLOCK_TOKENS):
    """Write the texts' bytes as tokens: blocks of files (Parquet), and the ids in file order beside them."""

    def run(frames):
        from pyspark import TaskContext

        file, block, held, size, order = TaskContext.get().partitionId(), 0, [], 0, 0
        for frame in frames:
            ids = []
            for doc_id, t in zip(frame["doc_id"], frame[text], strict=True):
                made = np.append(np.frombuffer((t or "").encode(), np.uint8).astype(kind), np.array(separator, kind))
                held.append(made)
                size += len(made)
                ids.append((file, None, None, order, doc_id))
                order += 1
            while size >= block_tokens:
                flat = np.concatenate(held)
                ids.append((file, block, flat[:block_tokens].tobytes(), None, None))
                held, size, block = [flat[block_tokens:]], size - block_tokens, block + 1
            yield pd.DataFrame(ids, columns=["file", "block", "tokens", "ordinal", "doc_id"])
        if size:
            yield pd.DataFrame([(file, block, np.concatenate(held).tobytes(), None, None)], columns=["file", "block", "tokens", "ordinal", "doc_id"])

    docs.select("doc_id", text).mapInPandas(run, "file int, block int, tokens binary, ordinal bigint, doc_id bigint").write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def carries(rows, part, order):
    """Add `first`, the separators before a row of its part, and `carried`, the tokens since the last of them."""
    earlier = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    # rows with as many separators before them share an unended document
    open_ = Window.partitionBy(*part, "first").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("head")).otherwise(0)).over(open_), F.lit(0))
    last_tail = F.last(F.when(F.col("ends") > 0, F.col("tail")), True).over(earlier)
    return rows.withColumn("carried", F.coalesce(last_tail, F.lit(0)) + waiting)


def joined(rows, part, order):
    """Rows with their carries as one row a part: separators, tokens before the first and after the last."""
    last = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    return rows.groupBy(*part).agg(F.sum("ends").alias("ends"), F.sum(F.when(F.col("first") == 0, F.col("head")).otherwise(0)).alias("head"), F.max_by(last, order).alias("tail"))


def count_tokens(blocks, separator=SEPARATOR, kind="<u2", group=GROUP):
    """(file, ordinal, n_tokens) of every document in flat files given as (file, block, tokens) rows."""

    def scan(frames):
        for frame in frames:
            out = []
            for file, block, data in frame.itertuples(index=False):
                tokens = np.frombuffer(data, kind)
                ends = np.flatnonzero(tokens == separator)
                inner = np.diff(ends) - 1
                head, tail = (int(ends[0]), len(tokens) - int(ends[-1]) - 1) if len(ends) else (len(tokens), len(tokens))
                out.append((file, block, len(ends), head, tail, inner))
            yield pd.DataFrame(out, columns=["file", "block", "ends", "head", "tail", "inner"])

    found = stored(blocks.select("file", "block", "tokens").mapInPandas(scan, "file int, block int, ends bigint, head bigint, tail bigint, inner array<bigint>"), "scan")
    # only one short row a block goes through the scan
    short = carries(found.select("file", "block", F.floor(F.col("block") / group).alias("grp"), "ends", "head", "tail"), ["file", "grp"], "block")
    groups = carries(joined(short, ["file", "grp"], "block"), ["file"], "grp")
    before = groups.select("file", "grp", F.col("first").alias("g_first"), F.col("carried").alias("g_carried"))
    at = short.join(before, ["file", "grp"]).select("file", "block", (F.col("g_first") + F.col("first")).alias("first"), (F.col("carried") + F.when(F.col("first") == 0, F.col("g_carried")).otherwise(0)).alias("carried"))
    ends = found.where("ends > 0").join(at, ["file", "block"])
    ended = ends.select("file", "first", F.posexplode(F.concat(F.array(F.col("carried") + F.col("head")), "inner")).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    final = joined(groups, ["file"], "grp").select("file", F.col("ends").alias("ordinal"), F.col("tail").alias("n_tokens"))
    return ended.unionByName(final.where("n_tokens > 0"))


def op2_token_counts(spark, sf_dir):
    """Tokens (here bytes) of every whole document, found again in flat files."""
    from uuid import uuid4

    rows = write_flat(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/flat-{uuid4().hex}")
    ids = rows.where("ordinal is not null").select("file", "ordinal", "doc_id")
    return count_tokens(rows.where("block is not null")).join(ids, ["file", "ordinal"]).select("doc_id", "n_tokens")
