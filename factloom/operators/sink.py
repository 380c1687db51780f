"""Reports as ordered JSONL files."""

from pyspark.sql import functions as F

from factloom.operators.report import full_json, values_json
from factloom.sources.shared import stored


def write_lines(reports, path, view="full", order=("file", "line_no"), strict=False):
    """Write one JSON line a report below `path`, in order over its files, and return the greatest exit code.

    The lines are range-partitioned by the order's columns, so that the files' names and the
    lines in them are in that order. They are stored first: the bounds of the ranges are
    drawn from them, and no document is read twice for that.
    """
    value = values_json() if view == "values" else full_json()
    partial = F.when(F.col("status") == "partial", 5).otherwise(0) if strict else F.lit(0)
    rows = stored(reports.select(*order, value.alias("value"), F.greatest(F.col("exit_code"), partial).alias("exit")), "lines")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return rows.agg(F.max("exit")).collect()[0][0] or 0
