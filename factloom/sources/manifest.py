"""Files as a manifest: paths, names and sizes first, bytes only where a task needs them.

A manifest is a listing without content, so it can be filtered, joined and shuffled at the
cost of its paths. `packed` deals its files to tasks by their bytes; `sources.packages`
then opens each file in its task and reads the ranges that a request takes.
"""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.sources.inputs import COLUMNS
from factloom.sources.ranges import Damaged, opened


def listed(spark, path, glob=None, recursive=False):
    """(path, display_name, file_size, modified) of the files below a path; no content is read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]*)/*$", 1).alias("display_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def inputs(manifest):
    """Files of a manifest as inputs, to be read by path."""
    none = F.lit(None)
    return manifest.select(
        F.col("path").alias("input_id"), "display_name", F.lit("local_file").alias("source_kind"), "file_size", none.cast("binary").alias("content"),
        none.cast("string").alias("error_code"), none.cast("string").alias("error_message"), "path",
    )


def packed(rows, size="file_size", bytes_per_task=64 << 20, files_per_task=10_000):
    """Rows dealt out so that a task has about `bytes_per_task` of files, `files_per_task` at most and one file at least.

    A running sum of bytes over all rows, in two levels: within the partitions of a sort by
    path, and over these partitions' totals, of which there is a row each.
    """
    cost = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(bytes_per_task // files_per_task))
    placed = rows.repartitionByRange("path").withColumns({"_cost": F.least(cost, F.lit(bytes_per_task)), "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    within = placed.withColumn("_sum", F.sum("_cost").over(Window.partitionBy("_part").orderBy("_at")))
    totals = within.groupBy("_part").agg(F.max("_sum").alias("_all"))
    before = totals.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))
    summed = within.join(before, "_part").withColumn("_task", F.floor((F.col("_before") + F.col("_sum") - F.col("_cost")) / bytes_per_task).cast("int"))
    total = summed.agg(F.max("_task")).collect()[0][0]
    return summed.repartitionById((total or 0) + 1, F.col("_task")).drop("_cost", "_part", "_at", "_sum", "_before", "_task")


def with_paths(recs, manifest):
    """JSONL records whose paths are looked up in a manifest: size and path of each, SOURCE_IO where there is no such file.

    Only paths and sizes are joined. Content is that of records with bytes of their own.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    known = manifest.groupBy(plain(F.col("path")).alias("_path")).agg(F.max("file_size").alias("_size"))
    by_path, own = recs.where(F.col("path").isNotNull()), recs.where(F.col("path").isNull())
    joined = by_path.withColumn("_want", plain(F.col("path"))).join(known, F.col("_want") == F.col("_path"), "left")
    lost = F.col("_path").isNull()
    more = [c for c in recs.columns if c not in (*COLUMNS, "path")]
    found = joined.select(
        *more, "input_id", "display_name", "source_kind", F.col("_size").alias("file_size"), "content",
        F.when(lost, "SOURCE_IO").otherwise(F.col("error_code")).alias("error_code"),
        F.when(lost, F.concat(F.lit("cannot open "), "path")).otherwise(F.col("error_message")).alias("error_message"), F.col("_path").alias("path"),
    )
    return found.unionByName(own.select(*found.columns))


def with_sizes(recs):
    """JSONL records whose paths are opened in tasks for their size, where a stream has no listing to join; SOURCE_IO where a file cannot be opened."""
    kept = [c for c in recs.columns if c not in ("file_size", "error_code", "error_message")]
    schema = StructType([*(recs.schema[c] for c in kept), *StructType.fromDDL("file_size bigint, error_code string, error_message string").fields])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = []
            for path, size, code, said in zip(*(batch[c].to_pylist() for c in ("path", "file_size", "error_code", "error_message")), strict=True):
                if path is not None and code is None:
                    try:
                        size = opened(path).size
                    except Damaged as e:
                        code, said = "SOURCE_IO", e.args[1]
                found.append((size, code, said))
            more = zip(zip(*found, strict=True) if found else ((), (), ()), (pa.int64(), pa.string(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(c, t) for c, t in more)], schema=arrow)

    return recs.mapInArrow(run, schema)
