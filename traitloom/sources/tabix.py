"""Position-sorted tables of text in blocked gzip with a bin index: written in parts, read by region.

The files are ordinary gzip text to other readers. With a region a read fetches the ranges of each file that its index
(``.tbi`` beside it) names, and keeps the lines that overlap it; the rest of a file isn't touched. A chunk over
``partition_bytes`` is cut at lines that the index knows, each cut a partition.

Defined cases: positions are one-based, both ends included; lines that begin with the comment mark are left out; a file
without an index, or whose index lacks the sequence, is an error or has no lines; lines may be longer than a block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import bgzf, store


@dataclass
class Layout:
    """Where an index says that a line has its sequence, begin and end (columns from one; 0 for none)."""

    form: int
    chrom: int
    begin: int
    end: int
    mark: str

    def range(self, line: str) -> tuple[str, int, int]:
        """Sequence and range [begin, end) from zero; of variant records (form 2) the end is that of the reference allele."""
        f = line.split("\t")
        a = int(f[self.begin - 1]) - (0 if self.form & 0x10000 else 1)
        if self.form & 0xFFFF == 2:
            return f[self.chrom - 1], a, a + max(1, len(f[3]))
        return f[self.chrom - 1], a, max(a + 1, int(f[self.end - 1])) if self.end and self.end != self.begin else a + 1


def load_index(disk, path: str) -> tuple[bgzf.Index, list[str], Layout]:
    if not disk.get_file_info(path + ".tbi").is_file:
        raise FileNotFoundError(f"{path} has no index")
    with disk.open_input_stream(path + ".tbi", compression=None) as f:
        raw, out = f.read(), b""
    while raw:  # blocked gzip is a row of members
        d = zlib.decompressobj(31)
        out += d.decompress(raw)
        raw = d.unused_data
    magic, n, form, chrom, begin, end, mark, _, size = struct.unpack_from("<4s8i", out)
    if magic != b"TBI\1":
        raise ValueError("not an index of a table")
    names = out[36 : 36 + size].split(b"\0")[:-1]
    return bgzf.Index.parse(out, 36 + size, n), [x.decode() for x in names], Layout(form, chrom, begin, end, chr(mark))


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int


class TabixSource(DataSource):
    """``format("tabix")``: reads ``path value`` of a ``region`` (JSON: sequence, first and last position); writes rows
    ``chrom pos value`` with the lines of ``header`` (JSON) at the top of each part."""

    @classmethod
    def name(cls) -> str:
        return "tabix"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema: StructType) -> TabixReader:
        return TabixReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TabixWriter:
        return TabixWriter(dict(self.options))


class TabixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.goal = options["path"], int(options.get("partition_bytes", 32 << 20))
        self.chrom, self.first, self.last = json.loads(options["region"])

    def spans(self) -> list[Span]:
        disk, _ = store.opened(self.path)
        out = []
        for path, _ in store.files(self.path, ".gz"):
            index, names, _ = load_index(disk, path)
            if self.chrom in names:
                out += [Span(path, a, b) for a, b in index.chunks(names.index(self.chrom), self.first - 1, self.last, self.goal)]
        return out

    def partitions(self) -> list[InputPartition]:
        return [*self.spans()] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Span):
            return
        disk, _ = store.opened(self.path)
        _, _, layout = load_index(disk, partition.path)
        blocks = bgzf.Reader(disk.open_input_file(partition.path), 1 << 16)
        kept: list[str] = []
        for line in lines(blocks, partition.begin, partition.end):
            if not line or line.startswith(layout.mark):
                continue
            chrom, a, b = layout.range(line)
            if chrom == self.chrom and a < self.last and b >= self.first:
                kept.append(line)
            if len(kept) >= 2000:
                yield self.batch(partition.path, kept)
                kept = []
        if kept:
            yield self.batch(partition.path, kept)

    @staticmethod
    def batch(path: str, kept: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(kept)), pa.array(kept)], names=["path", "value"])


def lines(blocks: bgzf.Reader, begin: int, end: int) -> Iterator[str]:
    """Lines that begin at a virtual offset from ``begin`` to before ``end``."""
    rest, rest_at = b"", begin
    for text, places in blocks.stream(begin, end):
        buffer = rest + text
        known = [(0, rest_at)] * bool(rest) + [(max(0, b) + len(rest), (a << 16) - min(0, b)) for b, a in places]
        p, k = 0, 0
        while True:
            while k + 1 < len(known) and known[k + 1][0] <= p:
                k += 1
            at = known[k][1] + p - known[k][0]
            if p < len(buffer) and at >= end:
                return
            q = buffer.find(b"\n", p)
            if q < 0:
                break
            yield buffer[p:q].decode()
            p = q + 1
        rest, rest_at = buffer[p:], at
    if rest:
        yield rest.decode()


class TabixWriter(DataSourceArrowWriter):
    """A file and its index for each task; rows come by sequence, then position."""

    def __init__(self, options: dict[str, str]):
        self.path, self.header = options["path"], json.loads(options.get("header", "[]"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        disk, root = store.opened(self.path)
        disk.create_dir(root, recursive=True)
        names = [store.hidden(task, ".vcf.gz"), store.hidden(task, ".vcf.gz.tbi")]
        refs: dict[str, int] = {}
        index, layout, last, n = bgzf.Index(), Layout(2, 1, 2, 0, "#"), (-1, -1), 0
        with disk.open_output_stream(f"{root}/{names[0][0]}", compression=None) as raw:
            out = bgzf.Writer(raw)
            out.write("".join(f"{x}\n" for x in self.header).encode(), whole=False)
            if out.buffer:
                out.flush()
            for b in iterator:
                for value in b.column(b.schema.get_field_index("value")).to_pylist():
                    line = value.encode() + b"\n"
                    if out.buffer and len(out.buffer) + len(line) > bgzf.MOST:
                        out.flush()
                    at = out.tell()
                    out.write(line)
                    chrom, a, z = layout.range(value)
                    ref = refs.setdefault(chrom, len(refs))
                    if (ref, a) < last:
                        raise ValueError("rows must come by sequence and position")
                    last, n = (ref, a), n + 1
                    index.add(ref, a, z, at, out.tell())
            out.close()
        text = b"".join(k.encode() + b"\0" for k in refs)
        with disk.open_output_stream(f"{root}/{names[1][0]}", compression=None) as raw:
            out = bgzf.Writer(raw)
            out.write(struct.pack("<4s8i", b"TBI\1", len(refs), layout.form, layout.chrom, layout.begin, layout.end, ord(layout.mark), 0, len(text)) + text + index.body(len(refs)), whole=False)
            out.close()
        return store.Part(task, names, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store.publish(self.path, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store.discard(self.path, messages)


def write(records: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Sorted files and indexes of variant records: ``value`` is the line, ``chrom`` and ``pos`` what it is sorted by."""
    spark = records.sparkSession
    spark.dataSource.register(TabixSource)
    d = records.select("chrom", "pos", "value").repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "value")
    d.write.format("tabix").option("header", json.dumps(header or [])).mode("append").save(path)


def read(spark: SparkSession, path: str, region: tuple[str, int, int], partition_bytes: int = 32 << 20) -> DataFrame:
    """``value``: the lines of a file or folder that overlap a region, by their indexes."""
    spark.dataSource.register(TabixSource)
    return spark.read.format("tabix").option("region", json.dumps(region)).option("partition_bytes", partition_bytes).load(path).select("value")


def bytes_of(path: str, region: tuple[str, int, int]) -> tuple[int, int]:
    """Compressed bytes of the blocks that hold the region's lines, and bytes of all files."""
    disk, _ = store.opened(path)
    spans = TabixReader({"path": path, "region": json.dumps(region)}).spans()
    some = sum((s.end >> 16) - (s.begin >> 16) + (bgzf.Reader(disk.open_input_file(s.path)).length(s.end >> 16) or 0) for s in spans)
    return some, sum(n for _, n in store.files(path, ".gz"))
