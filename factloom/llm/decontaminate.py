"""Benchmark decontamination: n-gram windows of test items looked up in training texts.

Null texts and texts without words hit nothing. Items with the same id count once;
items with a null id are searched, but cannot be listed. Repeated documents give
repeated rows. Only hash tables of test windows are broadcast: above `max_windows`
they go in blocks, whose hits are merged row by row. A window takes some 30 bytes.
Very long texts are whole; an empty table gives no rows, an empty benchmark no hits.
Only ids and texts are read, so other columns cannot clash.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import WordHashes, cut, map_columns, steps, table, windows

#: Bytes that belong to words stay, capitals become small, all others become spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text):
    """Lower-cased words of a text, as bytes."""
    return (text or "").encode().translate(WORDS).split()


class Windows:
    """Hash tables of windows by length: sorted hashes, and the item and place that each stands for."""

    def __init__(self, items, n):
        hashes = WordHashes()
        self.vocabulary = {w: hashes.__missing__(w) or 1 for w in {w for _, words in items for w in words}}
        shared = {w: w for w in self.vocabulary}  # one object a word
        self.items = [(item, [shared[w] for w in words]) for item, words in items]
        lengths = {}
        for k, (_, words) in enumerate(self.items):
            lengths.setdefault(min(n, len(words)), []).append(k)
        self.tables = {}
        for k, some in lengths.items():
            made = [windows(np.array([self.vocabulary[w] for w in self.items[i][1]], np.uint64), k) for i in some]
            flat = np.concatenate(made)
            order = np.argsort(flat, kind="stable")
            item = np.repeat(np.array(some, np.int32), list(map(len, made)))
            place = np.concatenate([np.arange(len(m), dtype=np.int32) for m in made])
            self.tables[k] = flat[order], item[order], place[order]

    def hits(self, words):
        """(positions of hit words, items with a window in it). Every hash hit is verified by its words."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.uint64, len(words))
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        if known.any():
            for k, (hashes, item, place) in self.tables.items():
                if len(words) < k:
                    continue
                full = np.cumsum(np.concatenate([[0], known != 0]))
                starts = np.flatnonzero(full[k:] - full[:-k] == k)
                if not len(starts):
                    continue
                made = windows(known, k)[starts]
                low, high = np.searchsorted(hashes, made), np.searchsorted(hashes, made, "right")
                for j in np.flatnonzero(high > low).tolist():
                    i, window = int(starts[j]), words[starts[j] : starts[j] + k]
                    same = [m for m in range(low[j], high[j]) if self.items[item[m]][1][place[m] : place[m] + k] == window]
                    if same:
                        hit[i] += 1
                        hit[i + k] -= 1
                        items.update(self.items[item[m]][0] for m in same)
        return np.flatnonzero(np.cumsum(hit)[:-1] > 0), items


def item_blocks(benchmark, n, item_id, text, max_windows):
    """Lists of (id, words), each list of at most `max_windows` windows or one item."""
    block, total = [], 0
    for row in benchmark.select(item_id, text).distinct().toLocalIterator():
        if words := words_of(row[1]):
            more = max(1, len(words) - n + 1)
            if block and total + more > max_windows:
                yield block
                block, total = [], 0
            block.append((row[0], words))
            total += more
    yield block


def decontaminate(docs, benchmark, n=10, doc_id="doc_id", text="text", item_id="item_id", item_text="text", max_windows=2_000_000):
    """Per document: the id, n_words, hit_words (positions), items (ids, sorted)."""
    blocks = item_blocks(benchmark, n, item_id, item_text, max_windows)
    first, second = next(blocks), next(blocks, None)
    out, columns, schema = None, [doc_id, text], f"{doc_id} bigint, n_words bigint, hit_words array<int>, items array<bigint>"
    if second is not None:  # rows are known by a key, which must not change between the blocks
        docs = cut(docs.select(*columns).withColumn("_row", F.monotonically_increasing_id()))
        columns, schema = ["_row", *columns], f"_row bigint, {schema}"
    for block in [first] if second is None else chain([first, second], blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, n))

        def make(shared=shared):
            found = shared.value

            def step(*given):
                *keys, texts = given
                rows = []
                for t in texts:
                    words = words_of(t)
                    hit, items = found.hits(words)
                    rows.append((len(words), hit.astype(np.int32), sorted(items - {None})))
                return [*keys, *map(list, zip(*rows, strict=True))] if rows else [[]] * (len(keys) + 3)

            return step

        part = map_columns(docs, columns, make, schema)
        out = part if out is None else out.unionByName(part)
    if second is not None:
        out = out.groupBy("_row", doc_id, "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select(doc_id, "n_words", "hit_words", "items")


def clean_documents(docs, benchmark, n=10, text="text", item_id="item_id", item_text="text", max_windows=2_000_000):
    """The rows without a hit word, with all their columns: each row is judged by its own text, whatever its id, and moves nowhere."""
    for block in item_blocks(benchmark, n, item_id, item_text, max_windows):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, n))

        def run(batches, shared=shared):
            found = shared.value
            for part in steps(batches):
                clean = [not len(found.hits(words_of(t))[0]) for t in part[text].to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def remove_spans(text, hit):
    """The text without its hit words, each with the bytes that follow it up to the next word."""
    data, cut, i, k = (text or "").encode(), bytearray(), 0, -1
    marked, inside = set(hit), False
    flat = data.translate(WORDS)
    for i, b in enumerate(flat):
        if b != 32 and not inside:
            k += 1
        inside = b != 32
        if k not in marked:
            cut.append(data[i])
    return cut.decode()


def op7_decontaminate(spark, sf_dir):
    """Windows of ten benchmark words in every whole document."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
