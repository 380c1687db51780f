"""Inputs as rows of (input_id, display_name, source_kind, file_size, content, error_code, error_message).

Files, bytes at hand and JSONL records become the same rows; a record that cannot be
read is a row with its error, never an exception. Content is null where there is an error.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

COLUMNS = ["input_id", "display_name", "source_kind", "file_size", "content", "error_code", "error_message"]


def files(spark, path, glob=None, recursive=False):
    """Regular files below a path, each a row; `file_size` can be filtered before content is read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = F.regexp_extract("path", r"([^/]*)/*$", 1)
    return _rows(found.select(F.col("path").alias("input_id"), named.alias("display_name"), F.lit("local_file").alias("source_kind"), F.col("length").alias("file_size"), "content"))


def in_memory(df, input_id, name, content, kind="memory"):
    """Rows of any DataFrame with a name and a binary column; kind `stdin` is what a pipe gives."""
    return _rows(df.select(F.col(input_id).cast("string").alias("input_id"), F.col(name).alias("display_name"), F.lit(kind).alias("source_kind"), F.octet_length(content).cast("bigint").alias("file_size"), F.col(content).alias("content")))


def _rows(df):
    return df.select("*", F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"))


def jsonl_lines(spark, path):
    """(file, line_no, value) of the lines of text files that are not blank; line n of each file is n.

    A split's lines have consecutive ids, so a line's place in it needs no sort; splits'
    counts, a row each, are summed up file by file. No line crosses a shuffle unless the
    table of splits is too large to be broadcast, which the optimizer decides by its size.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = read.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    placed = read.join(splits.select("file", "_block", "_first", earlier.alias("_before")), ["file", "_block"])
    return placed.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value").where(F.trim("value") != "")


def records(lines):
    """Lines of (line_no, value) as inputs, and `path` for those to be read from a file.

    A line is a path as a JSON string, an object with a path and maybe a name, or one
    with a name and data_base64 (or base64). Blank lines are left out; further columns
    of the lines stay.
    """
    v = F.try_parse_json("value")
    at = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    kind = lambda x: F.schema_of_variant(x)
    text = lambda key: F.when(kind(at(key)) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    wrong = lambda key: F.coalesce(~kind(at(key)).isin("STRING", "VOID"), F.lit(False))
    more = [c for c in lines.columns if c not in ("line_no", "value", *COLUMNS, "path")]
    made = lines.where(F.trim("value") != "").select(*more, "line_no", "value", v.alias("_v"), kind(v).alias("_kind"), text("path").alias("_path"), text("name").alias("_name"), F.coalesce(text("data_base64"), text("base64")).alias("_data"), (wrong("path") | wrong("name") | wrong("data_base64") | wrong("base64")).alias("_wrong"))
    is_text, is_object = F.col("_kind") == "STRING", F.col("_kind").startswith("OBJECT") & ~F.col("_wrong")
    by_path = is_object & F.col("_path").isNotNull() & F.col("_data").isNull()
    by_data = is_object & F.col("_path").isNull() & F.col("_name").isNotNull() & F.col("_data").isNotNull()
    # the standard alphabet with its padding, nothing else
    clean = F.col("_data").rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    content = F.when(by_data & clean, F.try_to_binary("_data", F.lit("base64")))
    path = F.when(is_text, F.try_variant_get("_v", "$", "string")).when(by_path, F.col("_path"))
    message = (
        F.when(is_text | by_path | (by_data & content.isNotNull()), F.lit(None))
        .when(by_data, "invalid JSONL base64 payload")
        .when(is_object, "JSONL object must contain either path, or name plus data_base64")
        .otherwise(F.concat_ws(" ", F.lit("JSONL line"), F.col("line_no").cast("string"), F.lit("is invalid")))
    )
    return made.select(
        *more, "line_no", F.col("line_no").cast("string").alias("input_id"), F.coalesce(F.when(by_path | by_data, F.col("_name")), F.regexp_extract(path, r"([^/]*)/*$", 1)).alias("display_name"),
        F.when(path.isNotNull(), "local_file").when(by_data, "jsonl_bytes").alias("source_kind"), F.octet_length(content).cast("bigint").alias("file_size"), content.alias("content"),
        F.when(message.isNotNull(), "INVALID_REQUEST").alias("error_code"), message.alias("error_message"), path.alias("path"),
    )


def with_files(recs, found):
    """Records whose paths are looked up among `files`; a path without a file is a SOURCE_IO error."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    f = found.select(plain("input_id").alias("_path"), F.col("file_size").alias("_size"), F.col("content").alias("_content"))
    joined = recs.join(f, plain("path") == F.col("_path"), "left")
    lost = F.col("path").isNotNull() & F.col("_path").isNull()
    return joined.select(
        "line_no", "input_id", "display_name", "source_kind", F.coalesce("file_size", "_size").alias("file_size"), F.coalesce("content", "_content").alias("content"),
        F.when(lost, "SOURCE_IO").otherwise(F.col("error_code")).alias("error_code"), F.when(lost, F.concat(F.lit("cannot open "), "path")).otherwise(F.col("error_message")).alias("error_message"),
    )


def within(inputs, max_bytes):
    """Inputs larger than `max_bytes` lose their content and get a BUDGET_EXCEEDED error, by their size alone."""
    over = F.col("error_code").isNull() & (F.col("file_size") > max_bytes)
    said = F.concat(F.lit("payload size "), F.col("file_size").cast("string"), F.lit(f" exceeds physical read budget {max_bytes}"))
    return inputs.withColumns({"content": F.when(~F.coalesce(over, F.lit(False)), F.col("content")), "error_code": F.when(over, "BUDGET_EXCEEDED").otherwise(F.col("error_code")), "error_message": F.when(over, said).otherwise(F.col("error_message"))})
