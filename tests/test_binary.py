"""Binary alignments, indexed tables and matrices of doubles against plain rows."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.sources import bam, bgzf, doubles, matrices, sam, store, tabix, vcf

REFS = [("chr1", 3_000_000), ("chr2", 500_000)]
COLUMNS = [c.split()[0] for c in bam.SCHEMA.split(", ")][1:]


def lines(n, seed, longest=0):
    """SAM lines of all kinds, unsorted."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([1, 2, 75, 76, 150]) if not longest or rnd.random() < 0.9 else rnd.randint(1, longest)
        seq = "".join(rnd.choices("ACGTN", k=size)) if rnd.random() < 0.95 else "*"
        cigar = rnd.choice([f"{size}M", "*", "10M5N10M", "3S4M2I1D5M", "5H7=2X1P"])
        chrom = rnd.choice(["chr1", "chr1", "chr2", "*"])
        pos = 0 if chrom == "*" else rnd.randint(1, 400_000)
        rnext = rnd.choice(["=", "*", "chr2" if chrom == "chr1" else "chr1"]) if chrom != "*" else "*"
        tags = [t for t in (f"XM:i:{rnd.randint(-5, 70000)}", "XA:A:q", "RG:Z:a b", "XF:f:1.5", "XB:B:s,1,-2,3", "XH:H:1AE3") if rnd.random() < 0.4]
        out.append("\t".join([f"read{i % (n - 3)}", str(rnd.choice([0, 16, 99, 147, 256, 355, 4, 2048])), chrom, str(pos), str(rnd.randint(0, 255)), cigar, rnext, str(0 if rnext == "*" else rnd.randint(1, 400_000)), str(rnd.randint(-500, 500)), seq, "*", *tags]))
    return out


def reads(spark, text):
    return sam.parse(spark.createDataFrame([(x,) for x in text], "value string")).select(*COLUMNS)


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("whole", [True, False])
def test_parts_of_a_file_lose_and_repeat_nothing(spark, tmp_path, whole):
    """Records within blocks and over them, cut at every size of range; ranges without a record of their own included."""
    text = lines(4000, 1)
    d = reads(spark, text)
    bam.write(d.coalesce(2), f"file://{tmp_path}/x", REFS, whole=whole)
    want = rows(d)
    for size in (1 << 30, 100_000, 7_001):
        assert rows(bam.read(spark, f"file://{tmp_path}/x", partition_bytes=size)) == want
    assert rows(bam.read(spark, f"{tmp_path}/x")) == want


def test_records_longer_than_many_blocks(spark, tmp_path):
    d = reads(spark, lines(120, 2, longest=400_000))
    bam.write(d.coalesce(1), f"file://{tmp_path}/x", REFS, whole=False)
    for size in (1 << 30, 50_000, 20_011):
        assert rows(bam.read(spark, f"file://{tmp_path}/x", partition_bytes=size)) == rows(d)


def over(d, chrom, first, last, exclude=0):
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))
    return d.filter((F.col("chrom") == chrom) & (F.col("pos") <= last) & (F.col("pos") + F.greatest(F.lit(1), span) - 1 >= first) & (F.col("flag").bitwiseAND(F.lit(exclude)) == 0))


def test_regions_by_index_and_without(spark, tmp_path):
    d = reads(spark, lines(6000, 3)).cache()
    bam.write(d, f"file://{tmp_path}/x", REFS)
    cases = [("chr1", 1, 400_100), ("chr1", 100_000, 120_000), ("chr2", 16_385, 16_385), ("chr2", 450_000, 500_000), ("chr9", 1, 100), ("chr1", 399_990, 3_000_000)]
    for case in cases:
        for size in (1 << 30, 5_000):
            assert rows(bam.read(spark, f"file://{tmp_path}/x", case, exclude=256, partition_bytes=size)) == rows(over(d, *case, exclude=256))
    n = sum(x[1] for x in store.files(f"{tmp_path}/x", ".bam"))
    few = bam.BamReader({"path": f"{tmp_path}/x", "region": '["chr1", 100000, 110000]'}).spans()
    assert sum((s.end >> 16) - (s.begin >> 16) for s in few) < n / 4
    for p, _ in store.files(f"{tmp_path}/x", ".bai"):
        (tmp_path / "x" / p.rsplit("/", 1)[1]).unlink()
    assert rows(bam.read(spark, f"file://{tmp_path}/x", cases[1], partition_bytes=9_000)) == rows(over(d, *cases[1]))


def test_samples_empty_files_and_broken_ones(spark, tmp_path):
    d = reads(spark, lines(50, 4))
    bam.write(d, f"file://{tmp_path}/a", REFS)
    bam.write(d.limit(0), f"file://{tmp_path}/b", REFS)
    both = bam.scan(spark, spark.createDataFrame([(0, f"{tmp_path}/a"), (1, f"{tmp_path}/b")], "sample_ix long, path string"))
    assert rows(both) == rows(d.filter(F.col("flag").bitwiseAND(F.lit(256)) == 0)) and {r[0] for r in both.select("sample_ix").distinct().collect()} == {0}
    whole = (tmp_path / "a").glob("*.bam")
    raw = max((p.read_bytes() for p in whole), key=len)
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) * 2 // 3])
    with pytest.raises(Exception, match="cut off|isn't blocked"):
        bam.read(spark, f"file://{tmp_path}/cut.bam").collect()
    with pytest.raises(Exception, match="has files"):
        bam.write(d, f"file://{tmp_path}/a", REFS)


def test_bins_hold_and_meet_ranges():
    rnd = random.Random(5)
    for _ in range(2000):
        a = rnd.randint(0, bgzf.REACH - 2)
        b = min(bgzf.REACH, a + rnd.choice([1, 100, 20_000, 10**6, 10**8]))
        assert bgzf.bin_of(a, b) in bgzf.bins_of(a, b)
        c = rnd.randint(max(0, a - 10**5), min(bgzf.REACH - 2, b + 10**5))
        if a < c + 1 and c < b:
            assert bgzf.bin_of(a, b) in bgzf.bins_of(c, c + 1)
    assert bgzf.bin_of(0, 1) == 4681 and bgzf.bin_of(0, 1 << 29) == 0 and bgzf.bin_of(16383, 16385) == 585


def table(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ref = rnd.choice(["A", "AT", "A" * 50, "G" * 30_000 if rnd.random() < 0.02 else "C"])
        out.append((rnd.choice(["chr1", "chr2"]), rnd.randint(1, 300_000), f"v{i}", ref, "G", ".", "PASS", "RSQ=0.9", "GT", "0|1", "x" * rnd.choice([1, 300])))
    return out


def test_indexed_tables_give_the_lines_of_a_region(spark, tmp_path):
    made = table(5000, 6)
    d = spark.createDataFrame([(r[0], r[1], "\t".join(map(str, r))) for r in made], "chrom string, pos long, value string")
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1"]
    path = f"file://{tmp_path}/v"
    tabix.write(d, path, head)
    assert vcf.sample_names(spark, path) == ["s0", "s1"]
    assert sorted(r["variant_id"] for r in vcf.records(spark, path + "/*.gz").collect()) == sorted(r[2] for r in made)
    for chrom, first, last in (("chr1", 1, 300_000), ("chr1", 50_000, 60_000), ("chr2", 16_384, 16_385), ("chr2", 310_000, 320_000), ("chrX", 1, 9)):
        want = sorted(r[2] for r in made if r[0] == chrom and r[1] <= last and r[1] + len(r[3]) - 1 >= first)
        for size in (1 << 30, 2_000):
            got = tabix.read(spark, path, (chrom, first, last), partition_bytes=size)
            assert sorted(r[0].split("\t")[2] for r in got.collect()) == want
        assert sorted(r["variant_id"] for r in vcf.records(spark, path, (chrom, first, last)).collect()) == want
    some, every = tabix.bytes_of(path, ("chr1", 50_000, 60_000))
    assert 0 < some < every


def test_matrices_by_byte_range_and_row(spark, tmp_path):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(503, 7))
    d = spark.createDataFrame([(3 * i, [float(v) for v in x]) for i, x in enumerate(m)], "row long, values array<double>").repartition(5)
    path = f"file://{tmp_path}/m"
    doubles.write(d, path, 7)
    for size in (1 << 30, 999, 57, 1):
        got = doubles.read(spark, path, 7, partition_bytes=size).orderBy("row").collect()
        assert [r["row"] for r in got] == list(range(503)) and np.array_equal([r["values"] for r in got], m)
    some = doubles.read(spark, path, 7, [5, 500, 5, 0, 503, 9999]).orderBy("row").collect()
    assert [r["row"] for r in some] == [0, 5, 500] and np.array_equal([r["values"] for r in some], m[[0, 5, 500]])
    assert doubles.join_parts(spark, path, f"{tmp_path}/one.bin") == m.nbytes
    assert (tmp_path / "one.bin").read_bytes() == m.astype("<f8").tobytes()
    with pytest.raises(Exception, match="whole rows"):
        doubles.read(spark, path, 5).collect()
    with pytest.raises(Exception, match="hasn't 6 values"):
        doubles.write(d, f"file://{tmp_path}/bad", 6)


def test_attempts_that_fail_or_repeat_leave_nothing_that_is_read(spark, tmp_path):
    """The first attempt of each task writes and dies; files of dead attempts stay hidden."""
    d = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "row long, values array<double>")
    path = f"file://{tmp_path}/m"
    doubles.write(d, path, 1)
    (tmp_path / "m" / store.hidden(0, ".bin")[0]).write_bytes(struct.pack("<3d", 7, 8, 9))
    assert [r["values"] for r in doubles.read(spark, path, 1).orderBy("row").collect()] == [[float(i)] for i in range(40)]
    writer = doubles.DoublesWriter({"path": path + "2", "columns": "1"})
    disk, root = store.opened(path + "2")
    disk.create_dir(root)
    parts = [store.Part(k, [store.hidden(k, ".bin")], 1) for k in (1, 0)]
    for p in parts:
        with disk.open_output_stream(f"{root}/{p.names[0][0]}") as f:
            f.write(struct.pack("<d", p.task))
    writer.commit(parts)
    assert [r["values"] for r in doubles.read(spark, path + "2", 1).orderBy("row").collect()] == [[0.0], [1.0]]


def test_long_form_and_one_file(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(9) for c in range(4)], "row long, sample_ix long, value double")
    assert matrices.write_binary(cells, f"{tmp_path}/x.bin") == 36
    assert sorted(map(tuple, matrices.read_binary(spark, f"{tmp_path}/x.bin", 4).collect())) == sorted(map(tuple, cells.collect()))
    assert [tuple(r) for r in matrices.read_binary(spark, f"{tmp_path}/x.bin", 4, rows=[3]).orderBy("sample_ix").collect()] == [(3, c, 30.0 + c) for c in range(4)]
    assert {r["column"] for r in matrices.read_binary(spark, f"{tmp_path}/x.bin", 9, by_sample=False).collect()} == {0, 1, 2, 3}
    assert matrices.write_binary(cells.limit(0), f"{tmp_path}/none.bin") == 0


def test_records_are_encoded_and_decoded_by_columns(tmp_path, monkeypatch):
    """Many rows take few passes: no row is decoded on its own, and what repeats is decoded once a batch."""
    import json

    import pyarrow as pa
    import pyspark

    class Task:
        def partitionId(self):  # noqa: N802
            return 0

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Task))
    n = 3000
    names = [c.split()[0] for c in bam.SCHEMA.split(", ")][1:-1]
    rows = [
        ["", "r\xe9ad"][i % 500 == 3] + f"q{i}" for i in range(n)
    ], [99 if i % 2 else 147 for i in range(n)], [None if i % 700 == 9 else "chr1" for i in range(n)], [None if i % 700 == 9 else 10 * i + 1 for i in range(n)], [i % 61 for i in range(n)], [None if i % 11 == 0 else f"{1 + i % 3}M2N1I" for i in range(n)], [("=", "*", "chr2", None)[i % 4] for i in range(n)], [i for i in range(n)], [i - 50 for i in range(n)], [None if i % 13 == 0 else "ACGTN"[: i % 6] or "*" for i in range(n)], [None if i % 17 == 0 else [f"NM:i:{i % 3}", f"XZ:Z:v{i % 2}", "XB:B:c,1,-2"][: i % 4] for i in range(n)]
    types = {"flag": pa.int32(), "pos": pa.int64(), "mapq": pa.int32(), "pnext": pa.int64(), "tlen": pa.int64(), "tags": pa.list_(pa.string())}
    table = pa.table({c: pa.array(v, types.get(c, pa.string())) for c, v in zip(names, rows, strict=True)})
    w = bam.BamWriter({"path": str(tmp_path / "x"), "references": json.dumps([["chr1", 10**6], ["chr2", 10**6]])})
    w.commit([w.write(iter([table.slice(0, 1000).to_batches()[0], *table.slice(1000).to_batches()]))])
    calls, plain = [], bam.tags_of
    monkeypatch.setattr(bam, "tags_of", lambda raw: calls.append(1) or plain(raw))
    r = bam.BamReader({"path": str(tmp_path / "x")})
    got = pa.Table.from_batches([b for s in r.partitions() for b in r.read(s)]).to_pydict()
    assert len(calls) < 60
    refs = [c or "*" for c in rows[2]]
    want = {"qname": rows[0], "flag": rows[1], "chrom": refs, "pos": [p or 0 for p in rows[3]], "mapq": rows[4], "cigar": [c or "*" for c in rows[5]], "pnext": rows[7], "tlen": rows[8], "seq": [x or "*" for x in rows[9]], "tags": [t or [] for t in rows[10]]}
    for c, v in want.items():
        assert got[c] == v, c
    assert got["rnext"] == [("=" if a in ("=", b) and b != "*" else "*" if a in (None, "*", "=") else a) for a, b in zip(rows[6], refs, strict=True)]


def test_many_bins_are_those_of_each(tmp_path):
    import numpy as np

    from traitloom.sources import bgzf

    rnd = np.random.default_rng(1)
    begin = rnd.integers(0, 1 << 29, 500)
    end = np.minimum(begin + rnd.integers(1, 1 << 20, 500), 1 << 29)
    assert bgzf.bins_at(begin, end).tolist() == [bgzf.bin_of(int(a), int(b)) for a, b in zip(begin, end, strict=True)]
