"""WARC archives: a writer over Spark's text sink and a Python data source that reads them.

The writer makes each record a string, header and payload, and lets the sink end it with the record's last line
breaks; commits, retries and any file system are then Spark's. A compressed archive is one gzip member a file.

The source plans partitions of whole files, small ones together. It parses the header of a record first, drops the
record if its type or headers fail the filters that Spark pushed down, and only then touches the block: an unwanted
payload is passed over, neither decoded nor copied. With option ``payload`` false no payload is read at all.

Defined cases: a null payload is empty; null URLs have no WARC-Target-URI; line breaks in a URL are percent-encoded; a
null id is written as ``null``; rows that share the largest id of a payload are all responses, a null id is below all
others; payloads of any length; an empty table writes archives without records; other columns are ignored. Of foreign
records, a number that isn't one is null, and a filter on it drops the record; an HTTP block without a blank line is all
header, its payload empty; a length that is missing or no number counts as 0, and whatever else lies before a ``WARC/``
line is passed over; a record that the file's end cuts off is an error. A record that doesn't state the length of its
payload has that of its HTTP header, if there is one, else that of what follows.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterable, Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from . import common

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALL = 1000
DATE = "2026-01-01T00:00:00Z"
BREAK = "\r\n\r\n"
#: Bytes of what lies between records that are looked at together.
LINE = 1 << 16
SCHEMA = "record_id string, warc_type string, target_uri string, date string, content_type string, payload_digest string, payload_length long, refers_to string, content_length long, file string, payload binary"
#: Columns that come from headers alone, so that filters on them are decided before the block.
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to", "content_length": "content-length"}
NUMBERS = {"payload_length", "content_length"}
LENGTH = HEADERS["payload_length"]


def records(pages: DataFrame, least: int = SMALL) -> DataFrame:
    """``record``: a WARC record a row of ``page_id url html``, without the two line breaks at its end.

    Of equal payloads of ``least`` bytes or more, all but that of the largest id are revisits without a payload.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    # digests that occur more than once: counted before the shuffle, so a payload of many pages is a row a task
    again = p.filter(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1")
    again = common.materialize(again.select(F.col("digest").alias("_d"), "first"), "repeats")
    p = p.join(again, (p["digest"] == again["_d"]) & (p["bytes"] >= least), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"), F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("_block").cast("string")),
    ]
    p = p.select("*", block.alias("_block"))
    return p.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), F.col("_block")).alias("record"))


def write(pages: DataFrame, path: str, compression: str = "gzip", per_file: int = 100_000) -> None:
    """Archives of at most ``per_file`` records under ``path``."""
    records(pages).write.option("lineSep", BREAK).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload`` (true), ``partition_bytes`` (64 MB) and ``pushdown``.

    With ``pushdown`` filters on headers are decided by the reader. Spark keeps what it pushed with the loaded table, also
    for a later query without filters, so every query on that table must have one; ``read`` sees to this.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        options = dict(self.options)
        return (FilteredReader if options.get("pushdown", "false").lower() == "true" else WarcReader)(options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.goal = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[tuple[str, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")) and x.size)
        out, group, size = [], [], 0
        for path, n in files:
            if group and size + n > self.goal:
                out.append(Files(group))
                group, size = [], 0
            group.append(path)
            size += n
        return [*out, Files(group)] if group else out

    def wanted(self, head: dict[str, str]) -> bool:
        """Whether the filters on the headers at hand hold; the payload's length may come later."""
        for key, op, (number, value) in self.filters:
            if key == LENGTH and key not in head:
                continue
            x = integer(head.get(key)) if number else head.get(key)
            if x is None or not {"=": lambda a, b: a == b, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "some": lambda a, b: True}[op](x, value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        names = [*HEADERS, "file", "payload"]
        types = [pa.int64() if c in NUMBERS else pa.string() for c in HEADERS] + [pa.string(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
                while (head := header(stream)) is not None:
                    n = max(0, integer(head.get("content-length")) or 0)
                    wanted, payload = self.wanted(head), None
                    if wanted:
                        inner: dict[str, str] = {}
                        if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
                            n, inner = inner_header(stream, n)
                        if LENGTH not in head:
                            head[LENGTH] = inner.get("content-length", str(n))
                            wanted = self.wanted(head)
                    if wanted and self.payload:
                        payload = stream.read(n)
                        if len(payload) < n:
                            raise EOFError("a record is cut off")
                    else:
                        skip(stream, n)
                    if not wanted:
                        continue
                    rows.append((*(integer(head.get(h)) if c in NUMBERS else head.get(h) for c, h in HEADERS.items()), path.rsplit("/", 1)[-1], payload))
                    held += len(payload or b"")
                    if len(rows) >= 2000 or held >= 16 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class FilteredReader(WarcReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        ops = {EqualTo: "=", In: "in", StringStartsWith: "starts", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "some"}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append((HEADERS[f.attribute[0]], ops[type(f)], (f.attribute[0] in NUMBERS, getattr(f, "value", None))))
            else:
                yield f


def integer(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"[+-]?[0-9]{1,18}", x) else None


def fields(lines: Iterable[bytes]) -> dict[str, str]:
    """Header lines as names in lower case and values."""
    parts = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {key.strip().lower(): value.strip() for key, _, value in parts}


def header(stream: io.BufferedReader) -> dict[str, str] | None:
    """The header of the next record; None at the end."""
    line = stream.readline(LINE)
    while line and not line.startswith(b"WARC/"):
        line = stream.readline(LINE)
    return fields(takewhile(bytes.strip, iter(stream.readline, b""))) if line else None


def inner_header(stream: io.BufferedReader, n: int) -> tuple[int, dict[str, str]]:
    """The header of an HTTP message of n bytes, and how many bytes follow it."""
    lines = []
    while n:
        line = stream.readline(n)
        if not line:
            raise EOFError("a record is cut off")
        n -= len(line)
        if not line.strip():
            break
        lines.append(line)
    return n, fields(lines)


def skip(stream: io.BufferedReader, n: int) -> None:
    while n:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise EOFError("a record is cut off")
        n -= got


def read(spark: SparkSession, path: str, payload: bool = True, where: str | None = None) -> DataFrame:
    """Archives as rows, those that ``where`` keeps. Its conditions on headers are decided before the block.

    With ``where`` this turns on the session's ``spark.sql.python.filterPushdown.enabled``, without which Spark hands no
    filters to sources in Python; it must still be on when the rows are asked for.
    """
    spark.dataSource.register(WarcSource)
    rows = spark.read.format("warc").option("payload", str(payload).lower())
    if where is None:
        return rows.load(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return rows.option("pushdown", "true").load(path).filter(where)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id payload_bytes payload_digest record_type refers_to`` of archives that are written and read back.

    Of responses, length and digest are those of the payload as read; of revisits, those that the record states.
    """
    spark = pages.sparkSession
    path = common.scratch(spark, "warc")
    write(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    full = read(spark, path, where="warc_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "target_uri")
    again = read(spark, path, payload=False, where="warc_type = 'revisit'")
    again = again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring("payload_digest", 6, 40).alias("payload_digest"), F.lit("revisit").alias("record_type"), page("refers_to").alias("refers_to"), "target_uri")
    return full.unionByName(again)
