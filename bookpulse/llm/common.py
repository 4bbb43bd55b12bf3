"""What the training-data operators share: shared storage, row-wise Arrow maps, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their texts, turned into Python objects at a time inside a task; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20

_fallback_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor and the driver can reach.

    Where that setting is absent, a session in one process (tests) gets a temporary folder of this machine, and any
    other an error: its executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _fallback_dir:
            _fallback_dir.append(tempfile.mkdtemp(prefix="bookpulse-"))
        base = "file://" + _fallback_dir[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no frame still to be run reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sealed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``docs`` with columns named by place, so that no added column clashes with one; their new names; the way back."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names)), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path inside it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def put_atomically(uri: str, write: Callable) -> int:
    """Call ``write(stream)`` on a file that gets its name only when complete; gives its size.

    A task that is run again replaces the file by an equal one, so a lost executor leaves no half file behind.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as stream:
        write(stream)
        size = stream.tell()
    fs.move(part, path)
    return size


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``rows`` rows and ``size`` bytes of a text or list column, one row at least."""
    c = batch.column(column)
    while pa.types.is_struct(c.type):
        c = c.field(0)
    lengths = pc.binary_length(c) if pa.types.is_string(c.type) or pa.types.is_binary(c.type) else pc.list_value_length(c)
    ends = np.cumsum(np.asarray(pc.fill_null(lengths, 0)), dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        done = int(ends[i - 1]) if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, done + size, side="right"))), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def map_text(df: DataFrame, column: str, new: T.StructType, make: Callable[[], Callable], raw: bool = False, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """Add columns that a function of one column gives, through Arrow batches, without a shuffle.

    ``make()`` runs once a task and gives ``f(values) -> [pyarrow array per new field]``; values are a list, or with
    ``raw`` the Arrow array, of at most ``rows`` rows and ``size`` bytes (or one row). All other columns pass
    through; a column of ``df`` with the name of a new one (in any case) is replaced.
    """
    named = {f.name.lower() for f in new}
    keep = [c for c in df.columns if c.lower() not in named]
    where, at = [df.columns.index(c) for c in keep], df.columns.index(column)
    schema = T.StructType([df.schema[c] for c in keep] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for b in slices(whole, at, rows, size):
                arrays = [b.column(k) for k in where] + f(b.column(at) if raw else b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.mapInArrow(run, schema)
