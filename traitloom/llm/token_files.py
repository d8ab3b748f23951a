"""Token ids of documents in binary files: a concatenated id array and document boundaries in Elias-Fano code.

A folder has shards, in order, and ``_index.json`` with a line of figures a shard. A shard is a head of 8 bytes, the ids of
its documents one after another (2 or 4 bytes each, little-endian), two Elias-Fano sequences, and a foot of JSON with
their sizes. The first sequence is where each document ends in the array, the second the document ids. Such a sequence of n
numbers up to u takes n * (2 + log2(u / n)) bits and a 32-bit sample every 256 numbers; ``select`` finds the i-th
without a table of offsets.

Tasks write shards under names of their own and the commit lists those of the attempts that count, so retried and
speculative tasks neither lose nor repeat documents. Readers cut shards into ranges of documents, read the boundaries of
their shard and the ids of their range; filters on ``doc_id`` choose shards by the index and ranges by binary search.

Defined cases: a null or empty text is its end id alone; documents without an id come first; documents that share an id
are in the order of a hash of their texts, equal ones adjacent; a text may have any length; an empty table gives an
empty folder, which reads as no rows; other columns are ignored, whatever their names. Ids of documents are integers of
64 bits.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import common, packing

HEAD = b"TOKIDS01"
END = 2
#: Numbers between two samples of ``select``.
SAMPLE = 256
INDEX = "_index.json"
#: Bytes of text that make a shard, about; bytes of ids that make a partition of a read.
SHARD = 64 << 20
READ = 32 << 20
BATCH = 4 << 20


@dataclass
class EliasFano:
    """A sequence of n numbers that never falls: ``low`` has the last ``bits`` of each, ``high`` a one for each at its rest plus its place."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: unsigned 64-bit numbers in order."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.samples]

    def select(self, begin: int, end: int) -> np.ndarray:
        """Numbers ``begin`` to before ``end``: the samples give where to look in ``high``."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        first, last = begin // SAMPLE, -(-end // SAMPLE)
        from_ = int(self.samples[first])
        to = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        byte = from_ // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : -(-to // 8)], bitorder="little")[from_ - 8 * byte :])
        ones = ones[begin - first * SAMPLE : end - first * SAMPLE] + from_
        high = (ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.bits)
        if not self.bits:
            return high
        a, b = begin * self.bits, end * self.bits
        cut = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a - a // 8 * 8 :][: b - a].reshape(-1, self.bits).astype(np.uint64)
        return high | (cut << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def at_least(self, x: int) -> int:
        """How many numbers are below x."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            if int(self.select(m, m + 1)[0]) < x:
                a = m + 1
            else:
                b = m
        return a


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenSource(DataSource):
    """``format("token_ids")``: writes ``doc_id`` and ``ids`` (an int array), reads ``doc_id start n_tokens ids``.

    Options: ``width`` (bytes an id in the files, 2 or 4), ``form`` of the ids as read: ``array``, ``binary`` (unsigned
    little-endian 32-bit numbers) or ``none``, and ``pushdown``, with which every query on the loaded table must have a
    filter on ``doc_id`` (Spark keeps what it pushed for later queries without filters); ``read`` sees to this.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        form = self.options.get("form", "array")
        return "doc_id long, start long, n_tokens long" + {"array": ", ids array<int>", "binary": ", ids binary", "none": ""}[form]

    def reader(self, schema: StructType) -> TokenReader:
        options = dict(self.options)
        return (FilteredReader if options.get("pushdown", "false").lower() == "true" else TokenReader)(options)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)


@dataclass
class Shard(WriterCommitMessage):
    """A line of the index; ``base`` is the number of ids in the shards before it."""

    task: int
    file: str
    docs: int
    nulls: int
    ids: int
    width: int
    least: int | None
    most: int | None
    base: int = 0


class TokenWriter(DataSourceArrowWriter):
    """Rows come in ascending order of ``doc_id`` (nulls first), within a task and over tasks."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.width, self.overwrite = options["path"], int(options.get("width", 2)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{task:06d}-{uuid.uuid4().hex}.ids"
        most = (1 << 8 * self.width) - 1
        ends: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        nulls = total = 0
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(HEAD)
            for b in iterator:
                if not b.num_rows:
                    continue
                key, ids = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), b.column(b.schema.get_field_index("ids"))
                nulls += key.null_count
                keys.append(key.drop_null().to_numpy(zero_copy_only=False))
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (int(flat.min()) < 0 or int(flat.max()) > most):
                    raise ValueError(f"an id doesn't fit {self.width} bytes; set the option width")
                sizes = np.diff(ids.offsets.to_numpy())
                ends.append(total + np.cumsum(sizes, dtype=np.int64))
                total += int(sizes.sum())
                out.write(flat.astype(f"<u{self.width}").tobytes())
            end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            if (key[1:] < key[:-1]).any():
                raise ValueError("documents must come in ascending order of doc_id")
            least = int(key[0]) if len(key) else None
            two = [EliasFano.of(end.astype(np.uint64)), EliasFano.of(key.astype(np.uint64) - np.uint64((least or 0) % (1 << 64)))]
            foot = {"docs": len(end), "nulls": nulls, "ids": total, "width": self.width, "least": least, "sequences": []}
            for s in two:
                foot["sequences"].append({"n": s.n, "bits": s.bits, "bytes": [p.nbytes for p in s.parts()]})
                for p in s.parts():
                    out.write(p.tobytes())
            raw = json.dumps(foot).encode()
            out.write(raw + struct.pack("<I", len(raw)))
        return Shard(task, name, len(end), nulls, total, self.width, least, int(key[-1]) if len(key) else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        shards, old, base = [], [], 0
        if index := read_index(self.path):
            if not self.overwrite:
                raise ValueError("the folder has documents; write elsewhere or overwrite")
            old = [s.file for s in index]
        for s in sorted((m for m in messages if m), key=lambda m: m.task):
            if s.docs:
                s.base = base
                base += s.ids
                shards.append(s)
            else:
                old.append(s.file)
        store.create_dir(root, recursive=True)
        temp = f"{root}/.{INDEX}-{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as out:
            out.write("\n".join(json.dumps(s.__dict__) for s in shards).encode())
        store.move(temp, f"{root}/{INDEX}")
        for name in old:
            store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        for s in messages:
            if s:
                store.delete_file(f"{root}/{s.file}")


def read_index(path: str) -> list[Shard]:
    """The shards of a folder in their order; none where there is no index."""
    store, root = store_of(path)
    if not store.get_file_info(f"{root}/{INDEX}").is_file:
        return []
    with store.open_input_stream(f"{root}/{INDEX}") as f:
        return [Shard(**json.loads(line)) for line in f.read().decode().splitlines() if line]


class Opened:
    """A shard open for reading: its two sequences, and ids by range."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        (n,) = struct.unpack("<I", self.file.read_at(4, size - 4))
        foot = json.loads(self.file.read_at(n, size - 4 - n))
        self.docs, self.nulls, self.width, self.least = foot["docs"], foot["nulls"], foot["width"], foot["least"] or 0
        at = len(HEAD) + foot["ids"] * self.width
        found = []
        for s in foot["sequences"]:
            parts = []
            for size in s["bytes"]:
                parts.append(np.frombuffer(self.file.read_at(size, at), np.uint8))
                at += size
            found.append(EliasFano(s["n"], s["bits"], parts[0], parts[1], parts[2].view("<u4")))
        self.ends, self.keys = found

    def bounds(self, begin: int, end: int) -> np.ndarray:
        """Where documents ``begin`` to before ``end`` start, and where the last ends."""
        ends = self.ends.select(max(0, begin - 1), end).astype(np.int64)
        return ends if begin else np.concatenate([np.zeros(1, np.int64), ends])

    def doc_ids(self, begin: int, end: int) -> list[int | None]:
        found = self.keys.select(max(0, begin - self.nulls), max(0, end - self.nulls)) + np.uint64(self.least % (1 << 64))
        return [None] * max(0, min(end, self.nulls) - begin) + found.view(np.int64).tolist()

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to before ``end`` of the array."""
        return np.frombuffer(self.file.read_at((end - begin) * self.width, len(HEAD) + begin * self.width), f"<u{self.width}")

    def range(self, least: int | None, most: int | None) -> tuple[int, int]:
        """The documents whose id lies between these; documents without an id are in none but the whole range."""
        if least is None and most is None:
            return 0, self.docs
        begin = self.nulls + (self.keys.at_least(least - self.least) if least is not None else 0)
        return begin, self.nulls + (self.keys.at_least(most - self.least + 1) if most is not None else self.keys.n)


@dataclass
class Range(InputPartition):
    """Part ``k`` of ``parts`` equal ranges of a shard's documents."""

    shard: Shard
    k: int
    parts: int


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.form = options["path"], options.get("form", "array")
        self.goal = int(options.get("partition_bytes", READ))
        self.least: int | None = None
        self.most: int | None = None

    def partitions(self) -> list[InputPartition]:
        bounded = self.least is not None or self.most is not None
        out: list[InputPartition] = []
        for s in read_index(self.path):
            if bounded and (s.least is None or (self.least is not None and s.most < self.least) or (self.most is not None and s.least > self.most)):
                continue
            parts = max(1, min(s.docs, s.ids * s.width // self.goal))
            out += [Range(s, k, parts) for k in range(parts)]
        return out or [InputPartition(None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):
            return
        store, root = store_of(self.path)
        shard = Opened(store, f"{root}/{partition.shard.file}")
        first, last = shard.range(self.least, self.most)
        last = max(first, last)
        begin, end = (first + (last - first) * k // partition.parts for k in (partition.k, partition.k + 1))
        names = ["doc_id", "start", "n_tokens", *(["ids"] if self.form != "none" else [])]
        while begin < end:
            bounds = shard.bounds(begin, min(end, begin + 4096))
            n = max(1, int(np.searchsorted(bounds, bounds[0] + BATCH // 4, "right")) - 1) if self.form != "none" else len(bounds) - 1
            bounds = bounds[: n + 1]
            cols = [pa.array(shard.doc_ids(begin, begin + n), pa.int64()), pa.array(partition.shard.base + bounds[:-1]), pa.array(np.diff(bounds))]
            if self.form != "none":
                ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<i4")
                at = bounds - bounds[0]
                if self.form == "array":
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                else:
                    raw = memoryview(ids.tobytes())
                    cols.append(pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)
            begin += n


class FilteredReader(TokenReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of ``doc_id`` choose ranges; Spark still holds each row against lists."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("doc_id",):
                yield f
            elif isinstance(f, In) and value and all(type(v) is int for v in value):
                self.bound(min(value), max(value))
                yield f
            elif type(value) is int and type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                low = {EqualTo: value, GreaterThan: value + 1, GreaterThanOrEqual: value}.get(type(f))
                high = {EqualTo: value, LessThan: value - 1, LessThanOrEqual: value}.get(type(f))
                self.bound(low, high)
            else:
                yield f

    def bound(self, least: int | None, most: int | None) -> None:
        self.least = least if self.least is None else self.least if least is None else max(least, self.least)
        self.most = most if self.most is None else self.most if most is None else min(most, self.most)


def encode(docs: DataFrame, vocab: tuple | None = None, end: int = END) -> DataFrame:
    """``doc_id ids``: the ids of each whole text, then the end id; rows keep their order."""
    vocab = vocab or packing.vocabulary()

    def run(batches):
        for b in batches:
            key, texts, begin = b.column(0), b.column(1), 0
            rows: list[np.ndarray] = []
            held = 0
            for i, t in enumerate(texts):
                rows.append(np.array([*packing.ids_of(t.as_py() or "", vocab), end], np.int32))
                held += rows[-1].nbytes
                if held >= BATCH or i + 1 == len(texts):
                    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([key.slice(begin, len(rows)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows)))], names=["doc_id", "ids"])
                    begin, rows, held = i + 1, [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def write(docs: DataFrame, path: str, vocab: tuple | None = None, end: int = END, width: int = 2, shard_bytes: int = SHARD) -> None:
    """Files of all documents in ascending order of ``doc_id``, in shards of about ``shard_bytes`` of text.

    Texts are range-sorted before they are encoded, so one shuffle has the texts once. Rows of one id are split by the
    hash of their texts and then by row, so that no task gets an id as a whole.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))
    d = d.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_r"))
    d = d.repartitionByRange(n, F.asc_nulls_first("doc_id"), "_h", "_r").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_h", "_r")
    with common.small_batches(spark):
        encode(d, vocab, end).write.format("token_ids").option("width", width).mode("append").save(path)


def read(spark: SparkSession, path: str, form: str = "array", least: int | None = None, most: int | None = None) -> DataFrame:
    """Files as rows, those with ``doc_id`` from ``least`` to ``most``: shards and ranges beyond these aren't read.

    With bounds this turns on the session's ``spark.sql.python.filterPushdown.enabled``, as ``warc.read`` does.
    """
    spark.dataSource.register(TokenSource)
    rows = spark.read.format("token_ids").option("form", form)
    if least is None and most is None:
        return rows.load(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    d = rows.option("pushdown", "true").load(path)
    for cond in ([F.col("doc_id") >= least] if least is not None else []) + ([F.col("doc_id") <= most] if most is not None else []):
        d = d.filter(cond)
    return d


def round_trip(docs: DataFrame) -> DataFrame:
    """``doc_id start n_tokens ids_crc32`` of files that are written and read back."""
    path = common.scratch(docs.sparkSession, "tokens")
    write(docs, path)
    return read(docs.sparkSession, path, "binary").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
