"""Line dedup: lines that many documents share stay in one of them, told by keep bitmaps.

A line's key is the line without white space at its ends, A-Z lower-cased. A key of at
least `min_chars` code points that stands in at least `min_docs` documents loses its lines
in all documents but the one of the largest id. Keys are known by 128 bits of their hash.

Keys that hold more than one of HOT-th of all lines, HOT at most, are counted by document
and settled by a broadcast. The others are range-partitioned by hash, with a secondary sort
by document and position, and read as a stream: the first document of a key keeps its
lines. No text is moved but in `kept`, which joins texts with their bitmaps.

A null or empty text is one empty line. Documents of one id are one document for the
counts; a null id is a document of its own, smaller than all others. Rows that repeat get
the same bitmap each. An empty table gives no rows. Other columns are not read. A text's
bitmap and its lines are the largest things held at once.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, stored, table

#: White space at a line's ends. Fixed values.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of more than one HOT-th of all lines are broadcast: fewer than HOT of them can be.
HOT = 2000


def lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_keys(docs):
    """The documents with `_t`, which tells texts of one id apart."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))


def line_keys(docs, min_chars=40):
    """(h1, h2, doc_id, _t, pos) of the lines whose keys have at least `min_chars` code points."""
    low = F.translate("text", UPPER, LOWER)
    each = row_keys(docs).where(F.length("text") >= min_chars).select("doc_id", "_t", F.posexplode(lines(low)).alias("pos", "line"))
    key = each.select("doc_id", "_t", "pos", F.trim("line", F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "_t", "pos")


def dropped_lines(docs, min_docs=5, min_chars=40):
    """(doc_id, _t, pos) of the lines that go."""
    found = stored(line_keys(docs, min_chars), "lines")
    total = found.count()
    hot = F.broadcast(cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select("h1", "h2")))
    id_ = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    of_hot = found.join(hot, ["h1", "h2"], "left_semi").select("h1", "h2", id_.alias("doc")).distinct()
    settled = of_hot.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    # at most as many rows as there are hot keys
    from_hot = found.join(F.broadcast(settled), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper.id")))
    latest = F.desc_nulls_last("doc_id")
    cold = found.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", latest, "pos")
    of_key = Window.partitionBy("h1", "h2").orderBy(latest)
    ranked = cold.withColumn("nth", F.dense_rank().over(of_key))
    counted = ranked.withColumn("n_docs", F.last("nth").over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    from_cold = counted.where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1))
    return from_hot.select("doc_id", "_t", "pos").unionByName(from_cold.select("doc_id", "_t", "pos"))


def bitmaps(dropped):
    """(doc_id, _t, n_dropped, words): 64 lines a word, lowest bit first, a set bit for a line that goes.

    Words after the last line that goes are left out, as are documents that keep all.
    """
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc_id", "_t", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    each = words.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("each"), F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"))
    gap = "array_repeat(0L, cast(e.word - if(i = 0, -1L, each[greatest(i - 1, 0)].word) - 1 as int))"
    return each.select("doc_id", "_t", "n_dropped", F.expr(f"flatten(transform(each, (e, i) -> concat({gap}, array(e.bits))))").alias("words"))


def line_bitmaps(docs, min_docs=5, min_chars=40):
    """The documents' rows with `n_lines`, `n_dropped` and `words`, null where no line goes."""
    found = bitmaps(dropped_lines(docs, min_docs, min_chars)).withColumnRenamed("doc_id", "_doc").withColumnRenamed("_t", "_u")
    rows = row_keys(docs)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["_t"] == found["_u"]), "left")
    return joined.select("doc_id", "text", F.size(lines(F.col("text"))).cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), "words")


def kept(text, words):
    """The text of the lines that stay."""
    stays = lambda _, i: F.coalesce(F.getbit(F.get(words, F.floor(i / 64).cast("int")), i % 64) == 0, F.lit(True))
    return F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines(text), stays), "\n"))


def op11_line_dedup(spark, sf_dir):
    """Lines before and dropped, and the digest of what stays, of every document."""
    rows = line_bitmaps(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(kept(F.col("text"), F.col("words")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = """
with l as (select doc_id, i, t[i] as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as t from documents), unnest(range(1, len(t) + 1)) as u(i)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
d as (select k.*, keeper is not null and k.doc_id <> keeper as goes from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (goes) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not goes), '')) as kept_sha256 from d group by doc_id"""
