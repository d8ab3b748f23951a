"""Binary alignments (BAM), read in parts and written in parts, in the shape of ``sources.sam``.

A file is cut at byte ranges; each task starts at the first block border of its range and there at the first place from
which records follow one another plausibly (sizes, references, positions, names and CIGARs all valid, two records at
least or up to the end). It takes the records that begin before the next range. With a region, a file's index (``.bai``
beside it) gives the ranges of virtual offsets to read instead, and flags and positions are tested before the rest of a
record is decoded.

Defined cases: ``*`` for a missing name, CIGAR, sequence or reference, 0 for a missing position, as in the text form;
a mate on the same reference has `=`; tags keep their order and become ``XX:T:value`` with all integers as ``i``; empty files have no records; a file that is
cut off is an error. The files of a sample are one or a folder of them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import bgzf, store

SCHEMA = "path string, qname string, flag int, chrom string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, tags array<string>, mate int"
#: Letters of the base codes and of the CIGAR operations.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
LETTERS = np.array([[ord(a), ord(b)] for a in BASES for b in BASES], np.uint8)
HEX = bytes(ord("0123456789abcdef"[BASES.find(chr(c).upper()) if BASES.find(chr(c).upper()) >= 0 else 15]) for c in range(256))
FORMS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
HEAD = struct.Struct("<iiiBBHHHiiii")
FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("ref2", "<i4"), ("pos2", "<i4"), ("tlen", "<i4")])


def header(blocks: bgzf.Reader) -> tuple[list[str], list[int], int]:
    """Names and lengths of the references, and the virtual offset of the first record."""
    places: list[tuple[int, int]] = []
    buffer, at = b"", 0

    def need(n: int) -> None:
        nonlocal buffer, at
        while len(buffer) < n:
            if at >= blocks.size:
                raise EOFError("the header is cut off")
            places.append((len(buffer), at))
            text, at = blocks.member(at)
            buffer += text

    need(8)
    if buffer[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    p = 12 + struct.unpack_from("<i", buffer, 4)[0]
    need(p)
    names, lengths = [], []
    for _ in range(struct.unpack_from("<i", buffer, p - 4)[0]):
        need(p + 4)
        (k,) = struct.unpack_from("<i", buffer, p)
        need(p + 8 + k)
        names.append(buffer[p + 4 : p + 3 + k].decode())
        lengths.append(struct.unpack_from("<i", buffer, p + 4 + k)[0])
        p += 8 + k
    return names, lengths, offset(places, p) if p < len(buffer) else at << 16


def offset(places: list[tuple[int, int]], p: int) -> int:
    """The virtual offset of byte p of a text, from where in it members begin and their addresses."""
    begin, address = next(x for x in reversed(places) if x[0] <= p)
    return address << 16 | p - begin


def plausible(buffer: bytes, p: int, lengths: list[int]) -> int | None:
    """Where the record at p would end, if its fields are valid; None if they aren't. Needs 36 bytes there."""
    size, ref, pos, name, _, _, ops, _, seq, ref2, pos2, _ = HEAD.unpack_from(buffer, p)
    n = len(lengths)
    if size < 33 or not name or seq < 0 or not -1 <= ref < n or not -1 <= ref2 < n or pos < -1 or pos2 < -1:
        return None
    if (ref >= 0 and pos >= lengths[ref]) or (ref2 >= 0 and pos2 >= lengths[ref2]) or 32 + name + 4 * ops + (seq + 1) // 2 + seq > size:
        return None
    at = p + 36
    text = buffer[at : at + name]
    if len(text) == name and (text[-1] or any(not 33 <= c <= 126 for c in text[:-1])):
        return None
    if any(c & 15 > 8 for c in buffer[at + name : at + name + 4 * ops : 4]):
        return None
    return p + 4 + size


def first_record(blocks: bgzf.Reader, at: int, lengths: list[int]) -> int:
    """The virtual offset of the first record that begins in the member at ``at`` or a later one."""
    places: list[tuple[int, int]] = []
    buffer, p, goal = b"", 0, 1 << 18
    while True:
        while at < blocks.size and len(buffer) < goal:
            places.append((len(buffer), at))
            text, at = blocks.member(at)
            buffer += text
        more = at < blocks.size
        while p + 36 <= len(buffer):
            q, seen = p, 0
            while q is not None and seen < 64 and q + 36 <= len(buffer):
                q, seen = plausible(buffer, q, lengths), seen + 1
            if q is None:
                p += 1
            elif seen >= 2 or (q == len(buffer) and not more):
                return offset(places, p)
            elif more:  # a record longer than what is at hand: see what follows it
                break
            else:
                p += 1
        if not more:
            return blocks.size << 16
        goal = 2 * len(buffer)


def records(blocks: bgzf.Reader, begin: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts and where in them the records begin whose virtual offset is from ``begin`` to before ``end``."""
    rest, rest_at = b"", 0  # a record of which the texts so far have a part, and its offset
    if begin >= end:
        return
    for text, places in blocks.stream(begin, end):
        buffer = rest + text
        known = [(0, rest_at)] * bool(rest) + [(max(0, b) + len(rest), (a << 16) - min(0, b)) for b, a in places]
        starts, offsets = (np.array(x, np.int64) for x in zip(*known, strict=True))
        p, found = 0, []
        while p + 4 <= len(buffer):
            n = 4 + int.from_bytes(buffer[p : p + 4], "little", signed=True)
            if n < 36:
                raise ValueError("a record's size is wrong")
            if p + n > len(buffer):
                break
            found.append(p)
            p += n
        at = np.array([*found, p], np.int64)
        k = np.searchsorted(starts, at, "right") - 1
        where = offsets[k] + at - starts[k]
        good = where[:-1] < end
        if good.any():
            yield buffer, at[:-1][good]
        rest, rest_at = buffer[p:], int(where[-1])
        if not good.all() or (rest and rest_at >= end):
            return
    if rest:
        raise EOFError("a record is cut off")


def tags_of(raw: bytes) -> list[str]:
    out, p = [], 0
    while p + 3 <= len(raw):
        name, kind = raw[p : p + 2].decode("latin-1"), chr(raw[p + 2])
        p += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(raw[p])}")
            p += 1
        elif kind in "ZH":
            q = raw.index(0, p)
            out.append(f"{name}:{kind}:{raw[p:q].decode('latin-1')}")
            p = q + 1
        elif kind == "B":
            sub, (n,) = chr(raw[p]), struct.unpack_from("<i", raw, p + 1)
            values = struct.unpack_from(f"<{n}{FORMS[sub]}", raw, p + 5)
            out.append(f"{name}:B:" + ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)]))
            p += 5 + struct.calcsize(f"<{n}{FORMS[sub]}")
        else:
            (v,) = struct.unpack_from("<" + FORMS[kind], raw, p)
            out.append(f"{name}:f:{v:g}" if kind == "f" else f"{name}:i:{v}")
            p += struct.calcsize("<" + FORMS[kind])
    return out


@lru_cache(1 << 14)
def tag_bytes(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    head = name.encode("latin-1") + kind.encode()
    if kind == "i":
        return head + struct.pack("<i", int(value))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    if kind == "A":
        return head + value.encode("latin-1")
    if kind == "B":
        sub, *values = value.split(",")
        return head + sub.encode() + struct.pack(f"<i{len(values)}{FORMS[sub]}", len(values), *(float(v) if sub == "f" else int(v) for v in values))
    return head + value.encode("latin-1") + b"\0"


def cigar_of(ops: tuple[int, ...]) -> str:
    return "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"


@lru_cache(1 << 14)
def cigar_bytes(cigar: str) -> tuple[int, bytes, int]:
    """Number and bytes of a CIGAR's operations, and the bases of the reference that it covers."""
    ops, number = [], ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            number += c
        else:
            ops.append(int(number) << 4 | OPS.index(c))
            number = ""
    return len(ops), struct.pack(f"<{len(ops)}I", *ops), reach(tuple(ops))


@lru_cache(1 << 14)
def seq_bytes(seq: str) -> tuple[bytes, int]:
    """A sequence's codes, two a byte, and qualities that aren't known; its length."""
    if seq == "*":
        return b"", 0
    codes = seq.encode("latin-1").translate(HEX)
    return bytes.fromhex((codes + b"0" * (len(codes) % 2)).decode()) + b"\xff" * len(codes), len(codes)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def text(data: np.ndarray, count: np.ndarray) -> pa.Array:
    """Strings of ``count`` bytes each (Latin-1)."""
    to = np.concatenate([[0], np.cumsum(count)])
    if len(data) and data.max() > 127:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("latin-1") for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.string())
    return pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def distinct(buffer: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different pieces of a buffer, and which of them each range is: CIGARs and tags repeat."""
    found: dict[bytes, int] = {}
    which = [found.setdefault(buffer[a:b], len(found)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return list(found), np.array(which, np.int64)


def reach(ops: tuple[int, ...]) -> int:
    """Bases of the reference that a CIGAR covers."""
    return sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))


@dataclass
class Span(InputPartition):
    """Virtual offsets of a file to read, or a byte range whose border the task finds."""

    path: str
    begin: int
    end: int
    bytes: bool


class BamSource(DataSource):
    """``format("bam")``; options ``region`` (JSON: chrom, first and last position, one-based), ``exclude`` and ``require``
    (flags of which none and all must be set), ``partition_bytes``. To write: ``references`` (JSON: name, length)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.goal = int(options.get("partition_bytes", 32 << 20))
        self.region = json.loads(options["region"]) if options.get("region") else None
        self.exclude, self.require = int(options.get("exclude", 0)), int(options.get("require", 0))

    def spans(self) -> list[Span]:
        disk, _ = store.opened(self.path)
        out: list[Span] = []
        for path, size in store.files(self.path, ".bam"):
            if self.region:
                chrom, first, last = self.region
                names, _, start = header(bgzf.Reader(disk.open_input_file(path), 1 << 16))
                if chrom not in names:
                    continue
                index = next((x for x in (path + ".bai", path[:-4] + ".bai") if disk.get_file_info(x).is_file), None)
                if index:
                    with disk.open_input_stream(index) as f:
                        raw = f.read()
                    (n,) = struct.unpack_from("<i", raw, 4)
                    out += [Span(path, a, b, False) for a, b in bgzf.Index.parse(raw, 8, n).chunks(names.index(chrom), first - 1, last, self.goal)]
                    continue
            n = max(1, size // self.goal)
            out += [Span(path, size * k // n, size * (k + 1) // n, True) for k in range(n)]
        return out

    def partitions(self) -> list[InputPartition]:
        return [*self.spans()] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Span):
            return
        disk, _ = store.opened(self.path)
        blocks = bgzf.Reader(disk.open_input_file(partition.path))
        names, lengths, start = header(blocks)
        begin, end = partition.begin, partition.end
        if partition.bytes:
            end = blocks.border(end) << 16
            first = blocks.border(begin)
            begin = start if first <= start >> 16 else first_record(blocks, first, lengths) if first << 16 < end else end
        for buffer, at in records(blocks, begin, end):
            for k in range(0, len(at), 4096):
                yield self.batch(partition.path, buffer, at[k : k + 4096], names)

    def batch(self, path: str, buffer: bytes, at: np.ndarray, names: list[str]) -> pa.RecordBatch:
        fixed = np.frombuffer(buffer, np.uint8)[at[:, None] + np.arange(36)]
        col = lambda i, kind: fixed[:, i : i + np.dtype(kind).itemsize].copy().view(kind)[:, 0]
        ref, pos, flag = col(4, "<i4"), col(8, "<i4").astype(np.int64), col(18, "<u2").astype(np.int32)
        good = (flag & self.exclude == 0) & (flag & self.require == self.require)
        if self.region:
            chrom, first, last = self.region
            good &= (ref == (names.index(chrom) if chrom in names else -2)) & (pos < last)
        rows = np.flatnonzero(good)
        name, ops, seq, size = col(12, "u1").astype(np.int64), col(16, "<u2").astype(np.int64), col(20, "<i4").astype(np.int64), col(0, "<i4").astype(np.int64)
        begin = at + 36 + name
        cigars, which = distinct(buffer, begin[rows], begin[rows] + 4 * ops[rows])
        cigars = [struct.unpack(f"<{len(x) // 4}I", x) for x in cigars]
        if self.region:
            near = pos[rows] + np.array([max(1, reach(x)) for x in cigars], np.int64)[which] >= self.region[1]
            rows, which = rows[near], which[near]
        packed, n = begin[rows] + 4 * ops[rows], seq[rows]
        half = (n + 1) // 2
        whole = np.frombuffer(buffer, np.uint8)
        letters = LETTERS[whole[ranges(packed, half)]].ravel()
        odd = np.cumsum(2 * half)[n % 2 == 1] - 1
        bases = pc.if_else(pa.array(n == 0), "*", text(np.delete(letters, odd) if len(odd) else letters, n))
        tags, tagged = distinct(buffer, packed + half + n, at[rows] + 4 + size[rows])
        names_ = pa.array([*names, "*"], pa.string())
        ref, ref2 = ref[rows], col(24, "<i4")[rows]
        chrom = names_.take(pa.array(np.where(ref < 0, len(names), ref)))
        rnext = pc.if_else(pa.array((ref2 == ref) & (ref2 >= 0)), "=", names_.take(pa.array(np.where(ref2 < 0, len(names), ref2))))
        mate = np.where(flag[rows] & 128, 2, 1).astype(np.int32)
        columns = [
            pa.repeat(pa.scalar(path, pa.string()), len(rows)), text(whole[ranges(at[rows] + 36, name[rows] - 1)], name[rows] - 1), pa.array(flag[rows]), chrom, pa.array(pos[rows] + 1), pa.array(col(13, "u1")[rows].astype(np.int32)),
            pa.array([cigar_of(x) for x in cigars], pa.string()).take(pa.array(which)), rnext, pa.array(col(28, "<i4")[rows].astype(np.int64) + 1), pa.array(col(32, "<i4")[rows].astype(np.int64)), bases,
            pa.array([tags_of(x) for x in tags], pa.list_(pa.string())).take(pa.array(tagged)), pa.array(mate),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class BamWriter(DataSourceArrowWriter):
    """A file and its index for each task; rows of a task must come by reference and position for the index to be written."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.references = [(str(a), int(b)) for a, b in json.loads(options["references"])]
        self.whole = options.get("whole", "true").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        disk, root = store.opened(self.path)
        disk.create_dir(root, recursive=True)
        refs = {name: i for i, (name, _) in enumerate(self.references)} | {"*": -1}
        names = [store.hidden(task, ".bam")]
        index, last, n = bgzf.Index(), (-1, -1), 0
        with disk.open_output_stream(f"{root}/{names[0][0]}") as raw:
            out = bgzf.Writer(raw)
            text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{a}\tLN:{b}\n" for a, b in self.references)
            head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs) - 1)
            head += b"".join(struct.pack("<i", len(a) + 1) + a.encode() + b"\0" + struct.pack("<i", b) for a, b in self.references)
            out.write(head, whole=False)
            out.flush()
            for b in iterator:
                for record, ref, begin, end, where in self.encoded(b, refs):
                    at = out.tell() if len(out.buffer) + len(record) <= bgzf.MOST else None
                    if at is None and self.whole and out.buffer:
                        out.flush()
                    at = out.tell() if at is None else at
                    out.write(record, self.whole)
                    if index and ref >= 0:
                        if (ref, begin) < last or end > bgzf.REACH:  # no index has such positions: readers scan
                            index = None
                        else:
                            index.add(ref, begin, end, at, out.tell(), where)
                            last = (ref, begin)
                    n += 1
            out.close()
        if index:
            names.append(store.hidden(task, ".bam.bai"))
            with disk.open_output_stream(f"{root}/{names[1][0]}") as f:
                f.write(b"BAI\1" + struct.pack("<i", len(self.references)) + index.body(len(self.references)))
        return store.Part(task, names, n)

    @staticmethod
    def encoded(b: pa.RecordBatch, refs: dict[str, int]) -> Iterator[tuple[bytes, int, int, int, int]]:
        """Rows as records, with the reference, the range of positions and its bin."""
        col = lambda c: b.column(b.schema.get_field_index(c))
        number = lambda c: pc.fill_null(col(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        strings = lambda c: [v or "*" for v in col(c).to_pylist()]
        ref = [refs[v] for v in strings("chrom")]
        ref2 = [r if v == "=" else refs[v] for r, v in zip(ref, strings("rnext"), strict=True)]
        names = [v.encode("latin-1") + b"\0" for v in strings("qname")]
        cigars, bases = [cigar_bytes(v) for v in strings("cigar")], [seq_bytes(v) for v in strings("seq")]
        tags = [tag_bytes(v) for v in col("tags").flatten().to_pylist()]
        to = np.cumsum(pc.fill_null(pc.list_value_length(col("tags")), 0).to_numpy(zero_copy_only=False)).tolist()
        rest = [b"".join((x, c[1], q[0], *tags[i:j])) for x, c, q, i, j in zip(names, cigars, bases, [0, *to[:-1]], to, strict=True)]
        pos = number("pos") - 1
        after = pos + np.maximum(1, np.array([c[2] for c in cigars], np.int64))
        begin, end = np.maximum(0, pos), np.maximum(np.maximum(after, pos + 1), 1)
        where = np.where(np.array(ref, np.int64) >= 0, bgzf.bins_at(begin, end), 4680)
        head = np.zeros(len(rest), FIXED)
        for field, v in (
            ("size", [len(x) + 32 for x in rest]), ("ref", ref), ("pos", pos), ("name", [len(x) for x in names]), ("mapq", number("mapq")), ("bin", np.where(where < 1 << 16, where, 0)), ("ops", [c[0] for c in cigars]),
            ("flag", number("flag")), ("seq", [q[1] for q in bases]), ("ref2", ref2), ("pos2", number("pnext") - 1), ("tlen", number("tlen")),
        ):
            v = np.asarray(v, np.int64)
            info = np.iinfo(FIXED[field])
            if len(v) and (v.min() < info.min or v.max() > info.max):
                raise ValueError(f"{field}: beyond what a record holds")
            head[field] = v
        heads = head.tobytes()
        for i, (x, *place) in enumerate(zip(rest, ref, begin.tolist(), end.tolist(), where.tolist(), strict=True)):
            yield heads[36 * i : 36 * i + 36] + x, *place

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store.publish(self.path, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store.discard(self.path, messages)


def read(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, exclude: int = 0, require: int = 0, partition_bytes: int = 32 << 20) -> DataFrame:
    """Alignments of a file or folder, with the ``path`` of each; with ``region`` those that overlap it."""
    spark.dataSource.register(BamSource)
    d = spark.read.format("bam").option("exclude", exclude).option("require", require).option("partition_bytes", partition_bytes)
    return (d.option("region", json.dumps(region)) if region else d).load(path)


def scan(spark: SparkSession, samples: DataFrame, **options) -> DataFrame:
    """Alignments of all files of ``samples`` (sample_ix, path), without secondary ones unless asked for."""
    out = None
    for r in samples.select("sample_ix", "path").collect():  # a row a file
        d = read(spark, r["path"], **({"exclude": 256} | options)).select(F.lit(r["sample_ix"]).cast("long").alias("sample_ix"), "*").drop("path")
        out = d if out is None else out.unionByName(d)
    return out


def write(alignments: DataFrame, path: str, references: Iterable[tuple[str, int]], whole: bool = True) -> None:
    """A sorted file and index for each range of positions."""
    spark = alignments.sparkSession
    spark.dataSource.register(BamSource)
    references = list(references)
    order = spark.createDataFrame([(a, i) for i, (a, _) in enumerate(references)], "chrom string, _ref int")  # a row a reference
    d = alignments.join(F.broadcast(order), "chrom", "left").withColumn("_ref", F.coalesce("_ref", F.lit(1 << 30)))
    d = d.repartitionByRange("_ref", "pos").sortWithinPartitions("_ref", "pos")
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:-1]
    d.select(*names).write.format("bam").option("references", json.dumps(references)).option("whole", str(whole).lower()).mode("append").save(path)
