"""What files say of themselves, read by tasks: Parquet footers and the header lines of CSV files.

The driver lists names, as Spark itself does, and no file is opened there: a job opens each file, reads its footer or
first line and nothing else. Files are opened through Arrow's file systems; of CSV files below a scheme that Arrow
doesn't know the driver reads the first lines through Hadoop's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.sources.tables import file_system

#: Files that a task opens, about.
FILES_A_TASK = 64


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, and the path as it takes it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _opened(paths: DataFrame, n: int, read: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``read(path)`` gives of each path of a column, over as many tasks as there are files for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p in b.column(0).to_pylist() for r in read(p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in schema.split(", ")])

    return paths.repartition(max(1, -(-n // FILES_A_TASK))).mapInArrow(run, schema)


def _footer(path: str) -> list[tuple]:
    from pyspark.sql.pandas.types import from_arrow_type

    fs, at = located(path)
    with fs.open_input_file(at) as f:
        footer = pq.ParquetFile(f)
        return [(path, c.name, from_arrow_type(c.type).simpleString(), footer.metadata.num_rows) for c in footer.schema_arrow]


def parquet_files(spark: SparkSession, root: str) -> list[str]:
    """All Parquet files below a root, whatever the depth; FileNotFoundError where there is none."""
    fs, p = file_system(spark, root)
    found = []
    if fs.exists(p):
        each = fs.listFiles(p, True)
        while each.hasNext():
            f = each.next().getPath()
            if f.getName().endswith(".parquet") and not f.getName().startswith(("_", ".")):
                found.append(f.toString())
    if not found:
        raise FileNotFoundError(f"no Parquet files below {root}")
    return sorted(found)


def footers(spark: SparkSession, root: str) -> DataFrame:
    """file, column, type, rows: a row for each column of each Parquet file below a root."""
    names = parquet_files(spark, root)
    return _opened(spark.createDataFrame([(n,) for n in names], "path string"), len(names), _footer, "file string, column string, type string, rows long")


def odd_files(found: DataFrame, required: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """file, rows, problem: the files of ``footers`` that lack a required column, or have another type than a number in a numeric one."""
    number = "^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
    listed = lambda names: F.array(*map(F.lit, sorted(set(names)))).cast("array<string>")
    files = found.groupBy("file").agg(
        F.max("rows").alias("rows"), F.collect_set("column").alias("_have"), F.collect_set(F.when(F.col("type").rlike(number), F.col("column"))).alias("_numbers")
    )
    missing = F.array_except(listed(required), "_have")
    wrong = F.array_except(F.array_intersect(listed(numeric), "_have"), "_numbers")
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))).when(F.size(wrong) > 0, F.concat(F.lit("not numeric: "), F.array_join(wrong, ", ")))
    return files.select("file", "rows", problem.alias("problem")).where("problem is not null")


def drifted(found: DataFrame) -> DataFrame:
    """file, column, type, usual: cells of ``footers`` whose type isn't the one that most files have of the column (of equals the first by name)."""
    usual = found.groupBy("column", "type").agg(F.count("*").alias("n")).groupBy("column").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("usual"))
    return found.join(usual, "column").where(F.col("type") != F.col("usual")).select("file", "column", "type", "usual")


def _header(path: str) -> list[tuple]:
    fs, at = located(path)
    with fs.open_input_stream(at) as f:
        line = b""
        while b"\n" not in line and (more := f.read(1 << 16)):
            line += more
    return [(path, line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8"))]


def by_header(spark: SparkSession, files: Iterable[str]) -> list[list[str]]:
    """Files in groups of equal header lines, in the order of their names."""
    names = sorted(files)
    try:
        located(names[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):  # a scheme of Hadoop's alone
        return _by_header_here(spark, names)
    heads = _opened(spark.createDataFrame([(n,) for n in names], "path string"), len(names), _header, "path string, header string")
    return sorted(sorted(r.paths) for r in heads.groupBy("header").agg(F.collect_list("path").alias("paths")).collect())


def _by_header_here(spark: SparkSession, names: Sequence[str]) -> list[list[str]]:
    groups: dict[str, list[str]] = {}
    for n in names:
        fs, p = file_system(spark, n)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        groups.setdefault(reader.readLine() or "", []).append(n)
        reader.close()
    return sorted(groups.values())
