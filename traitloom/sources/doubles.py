"""Matrices of little-endian doubles, row after row: read by byte range or by row, written in parts.

A folder of parts is one matrix in the order of the parts' names. Where a part begins is the sum of the sizes before it,
so a row's place follows from its number alone: a read of single rows fetches their bytes and no others.

Defined cases: a file that doesn't hold whole rows is an error, and so is a row of another length; rows beyond the end are
none; null values are written as NaN; an empty folder has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import store

#: Single rows that one task fetches.
SEEKS = 1000


@dataclass
class Rows(InputPartition):
    """Rows ``begin`` to before ``end`` of a part, or those of ``some``; ``base`` is the number of rows before the part."""

    path: str
    base: int
    begin: int
    end: int
    some: list[int] | None = None


class DoublesSource(DataSource):
    """``format("doubles")``: ``row`` and ``values`` (an array); options ``columns``, ``rows`` (JSON: row numbers) and
    ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "doubles"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema: StructType) -> DoublesReader:
        return DoublesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DoublesWriter:
        return DoublesWriter(dict(self.options))


class DoublesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.columns = options["path"], int(options["columns"])
        self.goal = int(options.get("partition_bytes", 32 << 20))
        self.rows = sorted(set(json.loads(options["rows"]))) if options.get("rows") else None

    def parts(self) -> list[tuple[str, int, int]]:
        """Path, first row and rows of each part."""
        out, base = [], 0
        for path, size in store.files(self.path):
            if size % (8 * self.columns):
                raise ValueError(f"{path} doesn't hold whole rows")
            n = size // (8 * self.columns)
            out.append((path, base, n))
            base += n
        return out

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        step = max(1, self.goal // (8 * self.columns))
        for path, base, n in self.parts():
            if self.rows is None:
                out += [Rows(path, base, k, min(n, k + step)) for k in range(0, n, step)]
            else:
                some = [r - base for r in self.rows if base <= r < base + n]
                out += [Rows(path, base, 0, n, some[k : k + SEEKS]) for k in range(0, len(some), SEEKS)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Rows):
            return
        disk, _ = store.opened(self.path)
        width = 8 * self.columns
        with disk.open_input_file(partition.path) as f:
            if partition.some is not None:
                raw = [f.read_at(width, r * width) for r in partition.some]
                yield self.batch(np.array(partition.some) + partition.base, b"".join(raw))
                return
            step = max(1, (4 << 20) // width)
            for a in range(partition.begin, partition.end, step):
                b = min(partition.end, a + step)
                yield self.batch(np.arange(a, b) + partition.base, f.read_at((b - a) * width, a * width))

    def batch(self, rows: np.ndarray, raw: bytes) -> pa.RecordBatch:
        values = pa.array(np.frombuffer(raw, "<f8"))
        at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * self.columns)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.ListArray.from_arrays(at, values)], names=["row", "values"])


class DoublesWriter(DataSourceArrowWriter):
    """A part for each task, in the order of the tasks."""

    def __init__(self, options: dict[str, str]):
        self.path, self.columns = options["path"], int(options["columns"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        disk, root = store.opened(self.path)
        disk.create_dir(root, recursive=True)
        names, n = [store.hidden(task, ".bin")], 0
        with disk.open_output_stream(f"{root}/{names[0][0]}") as out:
            for b in iterator:
                values = b.column(b.schema.get_field_index("values"))
                if values.null_count or (np.diff(values.offsets.to_numpy()) != self.columns).any():
                    raise ValueError(f"a row hasn't {self.columns} values")
                out.write(values.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                n += b.num_rows
        return store.Part(task, names, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store.publish(self.path, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store.discard(self.path, messages)


def read(spark: SparkSession, path: str, columns: int, rows: list[int] | None = None, partition_bytes: int = 32 << 20) -> DataFrame:
    """``row values`` of a matrix with so many columns; with ``rows`` these alone, a read of one row's bytes each."""
    spark.dataSource.register(DoublesSource)
    d = spark.read.format("doubles").option("columns", columns).option("partition_bytes", partition_bytes)
    return (d if rows is None else d.option("rows", json.dumps(rows))).load(path)


def long_form(matrix: DataFrame) -> DataFrame:
    """``row sample_ix value``."""
    d = matrix.select("row", F.posexplode("values").alias("sample_ix", "value"))
    return d.select("row", F.col("sample_ix").cast("bigint").alias("sample_ix"), "value")


def gathered(cells: DataFrame) -> DataFrame:
    """``row values`` from ``row sample_ix value``, samples in order."""
    d = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("sample_ix", "value"))).alias("v"))
    return d.select("row", F.transform("v", lambda x: x["value"].cast("double")).alias("values"))


def write(matrix: DataFrame, path: str, columns: int) -> None:
    """Parts of ``row values`` in ascending order of ``row``; retried tasks leave nothing that is read."""
    spark = matrix.sparkSession
    spark.dataSource.register(DoublesSource)
    d = matrix.select("row", "values").repartitionByRange("row").sortWithinPartitions("row")
    d.select("values").write.format("doubles").option("columns", columns).mode("append").save(path)


def join_parts(spark: SparkSession, path: str, target: str) -> int:
    """Copy the parts of a folder into one file that all executors reach as a local path; returns its bytes.

    For tools that want one file. Tasks write each part at its offset, so a retried task writes the same bytes there.
    """
    found, at = [], 0
    for p, n in store.files(path):
        found.append((p, at, n))
        at += n
    with open(target, "wb") as f:
        f.truncate(at)

    def run(batches):
        disk, _ = store.opened(path)
        for b in batches:
            for p, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with disk.open_input_stream(p) as src, open(target, "r+b") as out:
                    out.seek(begin)
                    while part := src.read(4 << 20):
                        out.write(part)
            yield pa.RecordBatch.from_arrays([b.column(2)], names=["n"])

    if found:
        d = spark.createDataFrame(found, "path string, at long, n long").repartition(min(len(found), 1000))
        assert d.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] == at
    return at
