"""JSONL records as a stream: files of lines that arrive in a folder become lines of reports.

Probing needs no state, so the stream is the batch form line by line; records with
paths are looked up in a listing of files if one is given, or opened by the tasks.
"""

from pyspark.sql import functions as F

from factloom.operators.probe import probe
from factloom.operators.report import full_json, values_json
from factloom.sources.inputs import records, with_files, within
from factloom.sources.manifest import with_sizes


def reports(lines, view="full", known_files=None, max_bytes=16 << 20, by_path=False, **request):
    """(line_no, value, exit_code) of (line_no, value) lines, batch or stream; paths are SOURCE_IO errors without `known_files`, unless by_path has tasks open them."""
    recs = records(lines)
    if by_path:
        recs = with_sizes(recs)
    elif known_files is None:
        lost = F.col("path").isNotNull()
        recs = recs.withColumns({"error_code": F.when(lost, "SOURCE_IO").otherwise(F.col("error_code")), "error_message": F.when(lost, F.concat(F.lit("cannot open "), "path")).otherwise(F.col("error_message"))}).drop("path")
    else:
        recs = with_files(recs, known_files)
    rows = probe(within(recs, max_bytes), **request)
    return rows.select("line_no", (values_json() if view == "values" else full_json()).alias("value"), "exit_code")


def start(spark, source, out, checkpoint, view="full", available_now=True, by_path=True, **request):
    """Start a query that reads new files of lines below `source` and writes their reports below `out`; tasks open the files of paths."""
    lines = spark.readStream.text(source).select(F.lit(None).cast("bigint").alias("line_no"), "value")  # lines of a stream have no numbers
    writer = reports(lines, view, by_path=by_path, **request).select("value").writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
