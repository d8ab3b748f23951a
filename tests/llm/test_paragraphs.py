"""Paragraph vectors against plain Python: equality, insertion, deletion, hard cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from traitloom.llm import fingerprint as fp


def plain(text):
    """Lane sums of the lines, two lanes of 30 bits a number, and the number of lines."""
    lines = (text or "").split("\n")
    low, high = [0] * fp.WIDE, [0] * fp.WIDE
    known = {}
    for line in lines:
        if line not in known:
            own = hashlib.sha256(line.encode()).hexdigest()
            parts = [hashlib.sha256(f"{own}:{i}".encode()).hexdigest() for i in range(fp.WIDE // fp.WORDS)]
            known[line] = [int(h[15 * k : 15 * k + 15], 16) for h in parts for k in range(fp.WORDS)]
        low = [(a + w % 2**30) % 2**30 for a, w in zip(low, known[line])]
        high = [(a + w // 2**30) % 2**30 for a, w in zip(high, known[line])]
    return [a + b * 2**30 for a, b in zip(low, high)], len(lines)


def one_row(spark, **texts):
    d = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    for k in texts:
        d = fp.with_fingerprint(d, k, f"f_{k}")
    return d


def test_sums_are_those_of_plain_python(spark):
    rnd = random.Random(3)
    texts = [None, "", "\n", "é😀", "a\n", "same\n" * 40_000, "x" * 300_000] + ["\n".join(rnd.choice(["a", "b b", "c. d", ""]) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "i long, t string, p int, sums int")
    got = {r["i"]: (r["f"]["sums"], r["f"]["p"]) for r in fp.with_fingerprint(df, "t", "f").collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    assert fp.with_fingerprint(df.limit(0), "t", "f").count() == 0


def test_equality_sees_paragraphs_not_sentences(spark):
    texts = {"a": "A. B. C.\nD. E. F.", "b": "D. B. C.\nA. E. F.", "c": "D. E. F.\nA. B. C.", "e": "A. B. C.\nD. F. E.", "g": "A. B. C.\nD. E. F.\nD. E. F."}
    same = lambda x, y: fp.same_paragraphs(F.col(f"f_{x}"), F.col(f"f_{y}"))
    got = one_row(spark, **texts).select(same("a", "a"), same("a", "c"), same("a", "b"), same("a", "e"), same("a", "g")).first()
    assert tuple(got) == (True, True, False, False, False)


def test_paragraphs_go_in_and_out(spark):
    d = one_row(spark, whole="x\ny\nz\ny", part="y\ny", rest="z\nx")
    w, p, r = (F.col(f"f_{c}") for c in ("whole", "part", "rest"))
    got = d.select(fp.same_paragraphs(fp.plus(p, r), w), fp.same_paragraphs(fp.minus(w, r), p), fp.same_paragraphs(fp.minus(w, p), r), fp.same_paragraphs(fp.plus(p, p), w)).first()
    assert tuple(got) == (True, True, True, False)


def test_whole_fingerprints_go_in_and_out(spark):
    d = one_row(spark, whole="x. u\ny\nz\ny", part="y\ny", rest="z\nx. u")
    w, p, r = (F.col(f"f_{c}") for c in ("whole", "part", "rest"))
    assert tuple(d.select(fp.plus(p, r) == w, fp.minus(w, r) == p, fp.minus(w, p) == r).first()) == (True, True, True)


def test_fingerprint_text_tells_paragraphs_apart(spark):
    d = one_row(spark, a="A. B. C.\nD. E. F.", b="D. B. C.\nA. E. F.", c="D. E. F.\nA. B. C.", g="A. B", h="A. B. ")
    a, b, c, g, h = d.select(*(fp.text_of(F.col(f"f_{x}")) for x in "abcgh")).first()
    assert a != b and a == c and g != h


def test_counts_of_many_equal_lines_dont_wrap(spark):
    d = one_row(spark, a="same\n" * 40_000, b="same\n" * 20_000, c="other\n" * 70_000)
    near, far = d.select(fp.likeness(F.col("f_a"), F.col("f_b")), fp.likeness(F.col("f_a"), F.col("f_c"))).first()
    assert near == pytest.approx(1.0) and far < 0.3


def test_bit_counts_are_those_of_plain_python(spark):
    rnd = random.Random(4)
    texts = [None, "", "\n", ". . ", "a. b", *("\n".join(str(rnd.random()) for _ in range(n)) for n in (1, 30, 31, 32, 61, 62, 63, 500))]

    def counts(text):
        hs = [hashlib.sha256(x.encode()).hexdigest() for x in re.split(fp.SENTENCE, text or "") if x]
        ws = [[int(h[15 * k : 15 * k + 15], 16) for k in range(fp.WORDS)] for h in hs]
        return [sum((w[k] >> j & 1) + ((w[k] >> j + fp.BITS & 1) << fp.BITS) for w in ws) for k in range(fp.WORDS) for j in range(fp.BITS)], len(hs)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: (r["f"]["lanes"], r["f"]["n"]) for r in fp.with_fingerprint(df, "t", "f").collect()}
    assert [got[i] for i in range(len(texts))] == [counts(t) for t in texts]


@pytest.mark.parametrize("shape", ["unique", "one", "equal", "hot", "hot_first", "hot_last", "several"])
def test_successors_where_ids_repeat(spark, shape):
    """An id may have most rows, all rows equal or not, and be the first, the last or between others."""
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 3)
    rows = {
        "unique": [(i, word()) for i in range(400)],
        "one": [(7, word()) for _ in range(300)],
        "equal": [(7, "same")] * 300 + [(i, word()) for i in range(40)],
        "hot": [(200, word()) for _ in range(300)] + [(i, word()) for i in range(400)],
        "hot_first": [(-5, word()) for _ in range(300)] + [(i, word()) for i in range(200)],
        "hot_last": [(999, word()) for _ in range(300)] + [(i, word()) for i in range(200)],
        "several": [(i // 100 if i < 500 else i, word()) for i in range(600)],
    }[shape]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, t string").withColumn("v", F.concat("k", F.lit(":"), "t"))
    want = sorted(rows)
    want = sorted((k, t, f"{a}:{b}") for (k, t), (a, b) in zip(want, [*want[1:], want[0]], strict=True))
    for pieces, least in ((16, 1), (16, 64)):
        assert sorted(tuple(r) for r in fp.with_next(df, "k", "t", ["v"], pieces, least).select("k", "t", "next_v").collect()) == want
