import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.llm import mixing, packing, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string"


def documents(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        source = rnd.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"])
        rows.append((i, " ".join("w%d" % rnd.randint(0, 9) for _ in range(rnd.choice([0, 1, 7, 30, 200]))) if i % 17 else None, "en", source, 1, "x"))
    rows += [(None, "a b c", "en", "a", 1, "x"), (5, "t u", "en", "a", 1, "x"), (5, "t u", "en", "a", 1, "x"), (200, "", "en", "only empty", 1, "x"), (201, "x\x1fy z \t v", "en", "z", 1, "x")]
    return rows, spark.createDataFrame(rows, DOC)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3 * sizes[s] if s in capped else weights[s] * left / sum(weights[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix_meets_targets(spark):
    rows, df = documents(spark)
    n = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + n(r[1])
    want = plain_targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert t - 1 <= taken[s] <= t
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(3)).collect()))
    m = mixing.mixed(df)
    words = sum(r["n"] for r in m.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).collect())
    assert words == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_packing_keeps_every_id_once(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as p

    rnd = random.Random(2)
    texts = [None, "", "a", "<|endoftext|> x", "é😀\n\n  b", "z" * 3000, "x" + " " * 1_000_000 + "y", "\n" * 300_000, "a \u00a0" * 20_000 + "\t" * 12_000 + "b", "q" * 1_000_000] + [" ".join(rnd.choice(["foo", "barbaz", "it's", "12 345", "ß"]) for _ in range(rnd.choice([1, 50, 400, 1500]))) for _ in range(60)]
    rows = [(None if i == 3 else i % 60, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df).collect()
    t = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    want = []
    for d, x, _ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=key) == sorted(want, key=key)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
    assert packing.pack(df.limit(0)).count() == 0


def test_plan_uses_the_histogram_up_with_little_padding():
    rnd = random.Random(3)
    hist = {}
    for _ in range(20_000):
        x = rnd.randint(1, 1023)
        hist[x] = hist.get(x, 0) + 1
    layout = packing.plan(dict(hist))
    used = {}
    for combo, n in layout:
        assert sum(combo) <= 1024 and n > 0
        for x in combo:
            used[x] = used.get(x, 0) + n
    assert used == hist
    room = sum(1024 * n for _, n in layout)
    assert sum(x * n for x, n in hist.items()) / room > 0.98


def test_toxicity_learns_and_locates(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        s = [" ".join(word() for _ in range(8)) for _ in range(rnd.randint(1, 20))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                s.insert(rnd.randrange(len(s) + 1), f"{word()} you {rnd.choice(['vileword', 'scoundrel'])} {word()}")
        rows.append((i, ". ".join(s), "en", 0.5))
        labels.append((i, int(bad)))
    rows += [(1000, "", "en", 0.5), (1001, None, "en", 0.5), (None, "plain words", "en", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = toxicity.train(df, spark.createDataFrame([*labels, (5, 1), (None, 1), (7, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.95
    assert got[1000] < 0.1 and got[1001] < 0.1
    found = toxicity.offending(df, model).collect()
    assert {r["doc_id"] for r in found} == {i for i, y in labels if y}
    assert all("vileword" in r["sentence"] or "scoundrel" in r["sentence"] for r in found)
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df.limit(0), none).count() == 0


@pytest.mark.parametrize("n", [3, 300])
def test_topk_is_brute_force(spark, n):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=64).round(3).tolist(), 1) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(30)] + [(1000, None, 1), (1020, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int")
    ok = [(i, np.array(v) >= 0) for i, v, _ in rows if i is not None and v and len(v) == 64]
    want = []
    for q, b in ok:
        if q % 20 == 0:
            near = sorted((int((b != c).sum()), i) for i, c in ok)[:5]
            want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
