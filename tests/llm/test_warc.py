import hashlib

from pyspark.sql import functions as F

from traitloom.llm import common, warc

SCHEMA = "page_id long, url string, html string, record string, digest string"
BIG = "é" * 600


def pages(spark):
    return spark.createDataFrame(
        [(1, "http://a/x", BIG, "r", "d"), (5, "http://a/y\r\nZ: 1", BIG, "r", "d"), (3, None, BIG, "r", "d"), (4, "http://b", "small", "r", "d"), (6, "http://b", "small", "r", "d"), (7, "http://c", None, "r", "d"), (8, "http://c", "", "r", "d"), (None, "http://d", BIG, "r", "d"), (9, "http://e", "\r\n\r\nWARC/1.1\r\n" * 90, "r", "d")],
        SCHEMA,
    )


def test_round_trip_states_digests_and_revisits(spark):
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark)).collect()}
    assert len(got) == 9
    big = hashlib.sha1(BIG.encode()).hexdigest()
    assert got[5]["record_type"] == "response" and got[5]["refers_to"] is None and got[5]["payload_bytes"] == 1200
    for i in (1, 3, None):
        assert (got[i]["record_type"], got[i]["refers_to"], got[i]["payload_digest"], got[i]["payload_bytes"]) == ("revisit", 5, big, 1200)
    assert all(got[i]["record_type"] == "response" for i in (4, 6, 7, 8, 9))
    assert got[7]["payload_digest"] == hashlib.sha1(b"").hexdigest() and got[7]["payload_bytes"] == 0
    assert got[9]["payload_digest"] == hashlib.sha1(("\r\n\r\nWARC/1.1\r\n" * 90).encode()).hexdigest()


def test_ties_for_the_largest_id_are_all_responses(spark):
    df = spark.createDataFrame([(2, "u", BIG), (2, "u", BIG), (1, "u", BIG)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"]) for r in warc.round_trip(df).collect())
    assert got == [(1, "revisit"), (2, "response"), (2, "response")]


def test_source_pushes_filters_and_passes_over_payloads(spark):
    path = common.scratch(spark, "w")
    warc.write(pages(spark), path, compression="none", per_file=3)
    df = warc.read(spark, path)
    assert df.count() == 9
    some = warc.read(spark, path, where="warc_type = 'revisit' and startswith(target_uri, 'http://a')")
    plan = some._jdf.queryExecution().toString()
    assert "WARC" in plan.upper()
    rows = some.collect()
    assert [r["payload"] for r in rows] == [b""] and rows[0]["refers_to"] == "<urn:page:5>"
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())
    assert sorted(r["payload"] for r in df.filter(F.col("payload_length") < 1000).collect()) == [b"", b"", b"small", b"small"]


def test_reader_decides_on_headers_alone():
    reader = warc.FilteredReader({"path": "file:///nowhere"})
    left = list(reader.pushFilters([warc.EqualTo(("warc_type",), "response"), warc.GreaterThan(("content_length",), 10), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1
    assert reader.wanted({"warc-type": "response", "content-length": "11"})
    assert not reader.wanted({"warc-type": "response", "content-length": "9"})
    assert not reader.wanted({"content-length": "11"})


def test_filters_of_one_query_leave_the_next_alone(spark):
    path = common.scratch(spark, "w")
    warc.write(pages(spark), path)
    df = warc.read(spark, path)
    assert [df.filter("warc_type = 'revisit'").count(), df.count(), df.filter("warc_type = 'none'").count(), df.count()] == [3, 9, 0, 9]
    some = warc.read(spark, path, where="warc_type = 'response'")
    assert [some.count(), some.filter("target_uri = 'http://b'").count(), some.count()] == [6, 2, 6]


def test_foreign_and_broken_records(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    rec = lambda kind, block, *lines: b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, *lines, b"", b""]) + block + b"\r\n\r\n"
    size = lambda b: b"Content-Length: %d" % len(b)
    reply = b"Content-Type: application/http; msgtype=response"
    (tmp_path / "x.warc").write_bytes(
        rec(b"response", http, reply, size(http)) + rec(b"response", b"HTTP/1.1 200 OK", reply, b"Content-Length: 15") + rec(b"resource", b"plain", size(b"plain"))
        + rec(b"metadata", b"not counted", b"Content-Length: many") + rec(b"response", http, reply, size(http), b"X-Payload-Length: ?")
    )
    df = warc.read(spark, f"file://{tmp_path}/x.warc")
    got = [(r["warc_type"], r["payload_length"], r["content_length"], bytes(r["payload"])) for r in df.collect()]
    assert got == [("response", 5, len(http), b"hello"), ("response", 0, 15, b""), ("resource", 5, 5, b"plain"), ("metadata", 0, None, b""), ("response", None, len(http), b"hello")]
    assert df.filter(F.col("payload_length") == 5).count() == 2
    assert warc.read(spark, f"file://{tmp_path}/x.warc", payload=False, where="payload_length < 5").count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0
