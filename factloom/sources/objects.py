"""iWork objects as rows: a document's archive is a table, and references between objects are joins.

A row is (keys, entry, ordinal, identifier, type, document, fields); a document that is
damaged gives what came before the damage and a last row with its error. Tasks hold one
entry of a document and a batch of rows at a time, however many objects there are. Joins
are by key and identifier, so that a large document's objects spread by themselves.
"""

from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.operators.facts import field, first_bytes, label
from factloom.sources.packages import FIELDS, each_object, failure
from factloom.sources.ranges import Damaged, held, opened

ROWS = f"entry string, ordinal bigint, identifier decimal(20,0), type decimal(20,0), document boolean, fields {FIELDS}, error_code string, error_message string"
#: Objects of a batch of rows.
STEP = 4096


def object_rows(routed, *keys, max_entries=50_000, max_bytes=256 << 20, max_read=None, types=None):
    """The objects of the rows' iWork documents; other rows, and rows with an error, give none. types: only these message types."""
    schema = StructType([*(routed.schema[k] for k in keys), *StructType.fromDDL(ROWS).fields])
    names = [f.name for f in schema.fields[len(keys) :]]
    by_path = "path" in routed.columns

    def of_document(content, path):
        try:
            source = opened(path, max_read) if path is not None else held(content, max_read)
            for entry, k, o in each_object(source, max_entries, max_bytes):
                if types is None or o["type"] in types:
                    yield {"entry": entry, "ordinal": k, "identifier": o["id"], "type": o["type"], "document": o["document"], "fields": o["fields"]}
        except Damaged as e:
            yield {"error_code": e.args[0], "error_message": e.args[1]}
        except Exception as e:  # a document's fault, not the job's
            yield dict(zip(("error_code", "error_message"), failure(e).values(), strict=True))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            paths = batch["path"].to_pylist() if by_path else [None] * batch.num_rows
            wanted = [i for i, (f, e) in enumerate(zip(batch["family"].to_pylist(), batch["error_code"].to_pylist(), strict=True)) if f == "iwork" and e is None]
            found = chain.from_iterable(((i, o) for o in of_document(None if paths[i] else batch["content"][i].as_buffer(), paths[i])) for i in wanted)
            while some := list(islice(found, STEP)):
                at = pa.array([i for i, _ in some])
                yield pa.RecordBatch.from_arrays([*(batch[k].take(at) for k in keys), *(pa.array([o.get(n) for _, o in some], arrow.field(n).type) for n in names)], schema=arrow)

    return routed.mapInArrow(run, schema)


def _is(rows, *types):
    return rows.where(F.col("type").isin(*types))


def logical_tables(rows, *keys):
    """A row for each table model that a table info of its document refers to: keys, identifier, name, rows, columns and what is hidden."""
    o = F.struct("fields")
    refs = _is(rows, 6000, 6007).select(*keys, F.when(F.col("type") == 6000, first_bytes(o, 2)["ref"]).otherwise(first_bytes(o, 1)["sub"]).alias("identifier")).distinct()
    number = lambda n: F.coalesce(field(o, n, "v"), F.lit(0)).cast("bigint")
    models = _is(rows, 6001).where(field(o, 6, "v").isNotNull() & field(o, 7, "v").isNotNull())
    named = models.select(
        *keys, "identifier", F.coalesce(label(o, 8), label(o, 1), F.lit("")).alias("name"), number(6).alias("rows"), number(7).alias("columns"),
        number(14).alias("hidden_rows"), number(15).alias("hidden_columns"), number(40).alias("filtered_rows"),
    )
    return named.join(refs, [*keys, "identifier"], "left_semi")


def ordered_sheets(rows, *keys):
    """(keys, position, identifier, name) of the sheets that the document's root refers to, in its order; a lost reference has no name."""
    o = F.struct("fields")
    roots = _is(rows, 1).where("document")
    order = roots.select(*keys, "ordinal", F.posexplode(F.transform(F.filter("fields", lambda f: (f["n"] == 1) & f["ref"].isNotNull()), lambda f: f["ref"])).alias("position", "identifier"))
    first = order.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"))
    sheets = _is(rows, 2).where("document").select(*keys, "identifier", "ordinal", label(o, 1).alias("name")).where(F.col("name").isNotNull())
    # of sheets with one identifier the last counts
    last = sheets.groupBy(*keys, "identifier").agg(F.max_by("name", "ordinal").alias("name"))
    return order.join(first, [*keys, "ordinal"], "left_semi").drop("ordinal").join(last, [*keys, "identifier"], "left")


def type_counts(rows, *keys):
    """(keys, type, n): how often a message type stands in a document."""
    return rows.where(F.col("type").isNotNull()).groupBy(*keys, "type").agg(F.count("*").alias("n"))
