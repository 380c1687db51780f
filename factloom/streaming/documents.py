"""Documents as a stream: files that arrive below a folder become reports, each once.

A batch is a manifest of new files. Their bytes are read by ranges in the tasks that
report on them, as in the batch form. A batch's reports go to a folder of its number,
which a batch that runs again after a failure replaces: none is lost, none stands twice.
"""

from pyspark.sql import functions as F

from factloom.operators.probe import probe
from factloom.operators.report import full_json, values_json
from factloom.sources.manifest import inputs, packed

#: What a stream of files has; a stream infers no schema. Content is never selected, so that no batch reads it whole.
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark, source, glob=None, files_per_batch=None):
    """(path, display_name, file_size, modified) of the files that arrive below `source`, as a stream."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true")
    for option, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", files_per_batch)):
        if value is not None:
            reader = reader.option(option, value)
    return reader.load(source).select("path", F.regexp_extract("path", r"([^/]*)/*$", 1).alias("display_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def start(spark, source, out, checkpoint, view="full", glob=None, files_per_batch=None, available_now=True, **request):
    """Start a query that writes (path, value, exit_code) of each file's report below `out`; request: as of `probe`."""

    def write(batch, number):
        rows = probe(inputs(packed(batch)), **request)
        value = values_json() if view == "values" else full_json()
        rows.select(F.col("input_id").alias("path"), value.alias("value"), "exit_code").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving(spark, source, glob, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
