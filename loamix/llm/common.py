"""Shared helpers of the training-data operators: scratch tables, folds, Arrow access."""

from __future__ import annotations

import atexit
import functools
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a local master, which has no other machine, a private one if it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or private_root()).rstrip("/")


@functools.cache
def private_root() -> str:
    root = tempfile.mkdtemp(prefix="loamix-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends here."""
    return stored(df, name, partition_by)[0]


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


#: Bytes of texts that a Python worker works on at a time; a longer text is alone.
SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, *columns: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes in its string or binary columns of that name, without copying.

    Spark bounds a batch by bytes on its way to Python (spark.sql.execution.arrow.maxBytesPerBatch);
    this bounds what is made of it there.
    """
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in columns:
        column = batch.column(batch.schema.get_field_index(name))
        sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets into them); a null is an empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null("").cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; a null is an empty text."""
    raw, at = utf8(column)
    whole, cuts = raw.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ..., so that none clashes with an operator's own, and those names in order."""
    inner = [f"c{i}" for i in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(df.columns, inner)]), inner


class Shared:
    """A broadcast of a driver-side model of bounded size; `get` gives the worker's copy."""

    def __init__(self, spark: SparkSession, model):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def get(self):
        return pickle.loads(self.sent.value)
