"""Helpers shared by the operators of this subpackage."""

import hashlib
import tempfile
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of texts that a step in a task works on at once; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark, sf_dir, name):
    """The Parquet table `name` below `sf_dir`, read by Spark; for its long texts, Arrow batches of a session that has Spark's default of 64 MB become 8 MB."""
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set(key, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batches):
    """Arrow batches cut into pieces of about STEP_BYTES, a row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * STEP_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_columns(df, columns, make, schema):
    """Apply `make()` once a task; its result maps lists of column values to lists of output columns."""
    fields = StructType.fromDDL(schema)
    names = fields.names

    def run(batches):
        step = make()
        arrow = to_arrow_schema(fields)
        for batch in steps(batches):
            made = step(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_pydict(dict(zip(names, made, strict=True)), schema=arrow)

    return df.select(*columns).mapInArrow(run, fields)


def shared_folder(spark):
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    if (path := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", path := "file://" + tempfile.mkdtemp(prefix="shared-"))
    return path.rstrip("/")


def cut(df):
    """Cut lineage with a checkpoint in the shared folder; Spark removes it with its DataFrame if it cleans checkpoints."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df, name="table"):
    """`df` written to the shared folder as Parquet and read again: computed once, read by column."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(*tables):
    """Delete what `stored` wrote; nothing may read these tables any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sha(data):
    """Lower-case hex SHA-256 of bytes or of a text's UTF-8."""
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def remainder(doc_id, n):
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1))


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered while there is room."""

    ROOM = 400_000

    def __missing__(self, word):
        if len(self) >= self.ROOM:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words):
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x):
    """Spread 64-bit values: multiply and fold twice."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes, n):
    """Hash of each run of n consecutive word hashes; order matters."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total = mix(total + hashes[k : len(hashes) - n + 1 + k])
    return total
