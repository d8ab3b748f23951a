"""Whitening, the prefix trie and token files against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF

from traitloom.llm import common, packing, prefix_trie, token_files, whitening
from traitloom.llm.queries import QUERIES


def plain_whitening(rows):
    """vec_id -> (deviation, 8 whitened values up to sign), and shares of the trace."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    z = (c @ u / np.sqrt(np.maximum(e, 1e-300)))[:, ::-1]
    return n, [(i, sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True)), z[k]) for k, (i, v) in enumerate(kept)], e[::-1] / e.sum()


def held_against_plain(rows, got, components=8):
    n, want, share = plain_whitening(rows)
    by = defaultdict(dict)
    for r in got:
        assert r["n"] == n and abs(r["explained"] - share[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
        by[r["component"]].setdefault(r["vec_id"], []).append((r["deviation"], r["whitened"]))
    assert sorted(by) == list(range(1, components + 1)) and len(got) == components * len(want)
    for k, found in by.items():
        mine = defaultdict(list)
        for i, dev, z in want:
            mine[i].append((dev, z[k - 1]))
        pairs = [(a, b) for i in found for a, b in zip(sorted(found[i]), sorted(mine[i]), strict=True)]
        sign = 1 if sum(a[1] * b[1] for a, b in pairs) > 0 else -1
        pairs = [(a, b) for i in found for a, b in zip(sorted(found[i]), sorted((d, sign * v) for d, v in mine[i]), strict=True)]
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in pairs)


def test_whitening_query_matches_numpy(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    held_against_plain(rows, QUERIES["op11_whitening"](spark, SF).collect())


def test_whitening_of_repeats_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 5)) * [3, 2, 1, 0.5, 0.25]
    rows = [(i, [float(v) for v in base[i % 40]]) for i in range(90)] + [(None, [1.0, 2.0, 0.5, 0.0, 0.25]), (7, [1.0, 2.0, 0.5, 0.0, 0.25])] + [(500 + i, [0.5, 0.5, 0.25, 1.0, 0.0]) for i in range(60)]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, 1, "k") for i, e in rows + bad + [(205, [1.0, 2.0])]], "vec_id long, embedding array<double>, w int, key string").repartition(5)
    held_against_plain(rows, whitening.whiten(df, components=5).collect(), 5)
    once = {r["component"]: r["explained"] for r in whitening.whiten(df, components=5, weights="one").collect()}
    _, _, share = plain_whitening([*{tuple(e): (i, e) for i, e in rows}.values()])
    assert max(abs(once[k + 1] - share[k]) for k in range(5)) < 1e-9


def test_whitening_without_spread_and_of_large_entries(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)]  # one component has spread
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(line, kind)).collect()} == {1}
    large = whitening.whiten(spark.createDataFrame([(1, [1e8, 0.0]), (2, [-1e8, 1.0]), (3, [1e300, 5.0])], kind)).collect()
    assert {r["vec_id"] for r in large} == {1, 2, 3} and {r["deviation"] for r in large} == {None}


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), (r or "", x or "")))
    conv = {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in conv.items()}
    made = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = conv.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, kids, below = defaultdict(list), defaultdict(list), {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k in sorted(members, key=len, reverse=True):
        below[k] = (sum(below[x][0] for x in kids[k]) or 1, sum(below[x][1] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0))
        ends = ",".join(map(str, sorted(c for c in members[k] if len(made[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(df):
    return sorted(repr(tuple(r)) for r in prefix_trie.trie(prefix_trie.rebuilt(df)).select(*NODE).collect())


@pytest.mark.parametrize(("rows", "run"), [(20_000, 10_000), (3, 2)])
def test_trie_of_hard_conversations(spark, monkeypatch, rows, run):
    """Nodes are the same whether a block has all conversations or three, and a run all ids or two."""
    monkeypatch.setattr(prefix_trie, "ROWS", rows)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    rng = random.Random(3)
    ids = [0, 100, 101, 102, 103, -5, -101, 7, 250, 251, None, *range(300, 330)]
    made = {(rng.choice(ids), rng.choice([None, 0, 1, 2, 3])): (rng.choice(["u", "a", None]), rng.choice(["x", "é\n", None])) for _ in range(300)}
    made = [(*k, *v) for k, v in made.items()]
    for data in (made, [], [(5, 0, "u", "é")], [(400 + i, 0, None, "q") for i in range(60)]):
        df = spark.createDataFrame([(*r, "other", 1) for r in data], "conv_id long, turn long, role string, text string, key string, block int")
        assert found_trie(df) == plain_trie(data)


def test_trie_of_repeated_rows_and_a_long_conversation(spark):
    long = [(500, i, "u", str(i)) for i in range(3000)] + [(501, i, "u", str(i)) for i in range(2990)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    assert found_trie(df) == plain_trie(long)
    twice = [(600, 1, "u", "a"), (600, 1, "u", "a"), (600, None, "u", "b")]
    df = spark.createDataFrame(twice, "conv_id long, turn long, role string, text string")
    assert found_trie(df) == plain_trie(twice)


def test_member_intervals_are_nested(spark):
    t = prefix_trie.trie(prefix_trie.sequences(common.table(spark, SF, "conversations"))).collect()
    root = [r for r in t if r["depth"] == 0]
    assert len(root) == 1 and root[0]["first_row"] == 0 and root[0]["last_row"] == max(r["last_row"] for r in t)
    by_depth = defaultdict(list)
    for r in t:
        by_depth[r["depth"]].append((r["first_row"], r["last_row"]))
    for spans in by_depth.values():
        assert all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))


def test_elias_fano_against_arrays():
    rng = np.random.default_rng(1)
    for v in ([], [0], [5, 5, 5], [0, 1, 2, 3], np.sort(rng.integers(0, 1 << 62, 1000)), np.sort(rng.integers(0, 3000, 1000)), [0, 2**64 - 1]):
        v = np.array(v, np.uint64)
        e = token_files.EliasFano.of(v)
        for a, b in [(0, len(v)), *np.sort(rng.integers(0, len(v) + 1, (40, 2)), 1)]:
            assert (e.select(int(a), int(b)) == v[a:b]).all()
        assert all(e.at_least(int(x)) == (v < x).sum() for x in [0, 7, *v[:20]])
    v = np.cumsum(rng.integers(1, 900, 100_000)).astype(np.uint64)
    assert 8 * sum(p.nbytes for p in token_files.EliasFano.of(v).parts()) < 11.5 * len(v)  # 2 + log2(450) bits and samples


def plain_ids(texts):
    whole = packing.whole(packing.vocabulary()[3])
    return [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def test_token_files_query_matches_tokenizers(spark):
    rows = sorted(tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect())
    want, at = [], 0
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, SF).collect())) == want


def test_token_files_of_hard_documents(spark, tmp_path):
    texts = {None: "no id", -(1 << 63): "least", 5: None, 6: "", 7: "wörd " * 40_000, 8: "<|endoftext|> x", (1 << 63) - 1: "most"}
    rows = [*texts.items(), *[(9, "same")] * 30, *[(9, f"other {i}") for i in range(30)], (None, "no id"), (None, "none")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, ids int").repartition(5)
    path = f"file://{tmp_path}/out"
    token_files.write(docs, path, shard_bytes=40_000)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert sorted((repr(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((repr(i), tuple(x.tolist())) for (i, _), x in zip(rows, plain_ids([t for _, t in rows]), strict=True))
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    some = token_files.read(spark, path, "none")
    assert some.columns == ["doc_id", "start", "n_tokens"]
    for least, most in ((7, 7), (7, 9), (None, -1), (1000, 1000), (8, None), (None, None)):
        part = token_files.read(spark, path, "none", least, most)
        for cond in ("true", "doc_id in (5, 8)", "doc_id is null", "doc_id <> 9 or start = 0", "true"):  # one after another: none may leave its mark
            want = [tuple(r)[:3] for r in got if least is most is None or (r["doc_id"] is not None and (least is None or r["doc_id"] >= least) and (most is None or r["doc_id"] <= most))]
            assert sorted(map(repr, part.filter(cond).collect())) == sorted(map(repr, spark.createDataFrame(want, some.schema).filter(cond).collect()))
    with pytest.raises(Exception, match="has documents"):
        token_files.write(docs, path)


def test_token_files_of_empty_tables_and_wide_ids(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(none, f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").collect() == []
    spark.dataSource.register(token_files.TokenSource)
    wide = spark.createDataFrame([(1, [70_000, 3]), (2, [])], "doc_id long, ids array<int>").coalesce(1)
    with pytest.raises(Exception, match="doesn't fit"):
        wide.write.format("token_ids").mode("append").save(f"file://{tmp_path}/narrow")
    wide.write.format("token_ids").option("width", 4).mode("append").save(f"file://{tmp_path}/wide")
    assert [tuple(r) for r in token_files.read(spark, f"file://{tmp_path}/wide").orderBy("doc_id").collect()] == [(1, 0, 2, [70_000, 3]), (2, 2, 0, [])]


def test_files_of_attempts_that_do_not_count_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    token_files.write(docs, f"file://{tmp_path}/out")
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".ids")
    (tmp_path / "out" / "part-000000-left-over.ids").write_bytes(part.read_bytes())
    assert token_files.read(spark, f"file://{tmp_path}/out").agg(F.count("*")).first()[0] == 20
