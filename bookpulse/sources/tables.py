"""Parquet in and out, stage boundaries, and discovery of inputs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> str:
    """zstd Parquet, replaced whole; sorted inside partitions so that row-group statistics are of use."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a dataset was written to its end."""
    fs, p = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def version(spark: SparkSession, path: str) -> tuple:
    """Path, size and time of change of a file or of all files below a folder, those that Spark doesn't read left out."""
    fs, p = file_system(spark, path)
    found, each = [], fs.listFiles(p, True)
    while each.hasNext():
        f = each.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _read_json(spark: SparkSession, path: str):
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _write_json(spark: SparkSession, path: str, value) -> None:
    """Under its name only when whole."""
    fs, p = file_system(spark, path)
    part = file_system(spark, f"{path}.{uuid.uuid4().hex}")[1]
    stream = fs.create(part)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    fs.delete(p, False)
    fs.rename(part, p)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """A folder takes another's place; nothing happens if that was done before."""
    fs, a = file_system(spark, source)
    b = file_system(spark, target)[1]
    if fs.exists(a):
        fs.delete(b, True)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"{source} can't be moved to {target}")


def stage(spark: SparkSession, outputs: dict[str, str], build: Callable[[dict[str, str]], dict[str, DataFrame]], force: bool = False, inputs: Sequence[str] = (), parameters=None) -> dict[str, str]:
    """Build a stage's outputs unless all are there, made from the same files below ``inputs`` with the same parameters.

    ``build`` gets a folder for each output and gives frames that are written there; it may write some itself. When all
    are written, a note of what moves where is left beside the first output, then they take the old ones' places: a run
    that breaks off before the note leaves the old set, after it the next run ends the move. The manifest lies there too.
    """
    note, manifest = (f"{next(iter(outputs.values()))}.{what}.json" for what in ("moving", "manifest"))
    made_from = hashlib.sha256(json.dumps([[version(spark, i) for i in inputs], parameters, sorted(outputs.items())], default=str).encode()).hexdigest()
    if begun := _read_json(spark, note):
        _settle(spark, note, manifest, begun)
    if force or _read_json(spark, manifest) != made_from or not all(exists(spark, p) for p in outputs.values()):
        fresh = {n: f"{p}.new-{uuid.uuid4().hex}" for n, p in outputs.items()}
        try:
            for name, df in build(fresh).items():
                write_parquet(df, fresh[name])
        except BaseException:
            for p in fresh.values():
                fs, path = file_system(spark, p)
                fs.delete(path, True)
            raise
        begun = {"moves": [[fresh[n], outputs[n]] for n in outputs], "made_from": made_from}
        _write_json(spark, note, begun)
        _settle(spark, note, manifest, begun)
    return outputs


def _settle(spark: SparkSession, note: str, manifest: str, begun: dict) -> None:
    for source, target in begun["moves"]:
        _move(spark, source, target)
    _write_json(spark, manifest, begun["made_from"])
    fs, p = file_system(spark, note)
    fs.delete(p, False)


def read_many(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet files below a root, whatever the depth; FileNotFoundError where there is no such root."""
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(root)
    return spark.read.option("recursiveFileLookup", "true").parquet(root)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in a session of one process, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="bookpulse-"))
        base = "file://" + _fallback[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the folder that all executors share and read back. Cuts deep plans, whose constraints Catalyst can't digest."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
