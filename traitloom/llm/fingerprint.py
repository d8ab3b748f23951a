"""Document fingerprints by a homomorphic multiset hash.

A paragraph is a line. Its wide vector has ``2 * WIDE`` lanes of 30 bits, hashed from the whole line; a document's
``sums`` are the lane-wise sums of its paragraphs' vectors modulo 2^30, with the number ``p`` of paragraphs. Sums
commute, so equal multisets of paragraphs have equal sums whatever their order, and a paragraph is inserted or deleted
by adding or subtracting its own fingerprint (``plus``, ``minus``). Full-width lanes of different paragraphs are
independent: distinct multisets agree in all of them by a chance of 2^-1920.

Such sums tell equal from unequal but not how near two long paragraphs are, so a second part of the fingerprint
counts, in ``lanes``, bits of the hashes of sentences (240 of each), with their number ``n``; it adds and subtracts
likewise. Read as +1 and -1, the bits of different sentences are independent: the cosine of two such vectors estimates
that of the documents' sentence multisets, within about 1 / sqrt(240).

Built-in functions only. Two lanes of 30 bits are packed in a bigint. A text has fewer than 2^30 sentences and lines, so
that no count of one text wraps, and sums of lanes stay within a bigint until the modulus is taken, once.

Defined cases: a null text is the empty one: one empty paragraph and no sentence; a last line end begins another
paragraph. Two texts without sentences are alike, one of them and another text not; ids ascend with null first, rows
with one id by text, also where one id has most of the rows; any length of text; a table of one row has
itself next; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Numbers of 60 bits in a SHA-256, and those of a paragraph's vector.
WORDS = 4
WIDE = 32
#: Width of a lane; the second lane of a bigint is this far up.
BITS = 30
LOW = (1 << BITS) - 1
ONE = 1 | 1 << BITS
#: Width of the fields in which a block's bits are counted; it divides ``BITS``, so that both lanes are cut alike.
FIELD = 5
SENTENCE = r"\. |\n"


def numbers(digest: Column) -> list[Column]:
    """The ``WORDS`` numbers of 60 bits in the hexadecimal ``digest``."""
    return [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("bigint") for k in range(WORDS)]


def sentence_hashes(text: Column) -> Column:
    """For each sentence its numbers."""
    some = F.filter(F.split(text, SENTENCE, -1), lambda s: F.length(s) > 0)
    return F.transform(F.transform(some, lambda s: F.sha2(s, 256)), lambda h: F.array(*numbers(h)))


def paragraph_hashes(text: Column) -> Column:
    """For each paragraph the ``WIDE`` numbers of its vector, expanded from one hash of the whole line."""
    own = F.transform(F.split(text, "\n", -1), lambda s: F.sha2(s, 256))
    parts = F.transform(own, lambda h: F.array(*(F.sha2(F.concat(h, F.lit(f":{i}")), 256) for i in range(WIDE // WORDS))))
    return F.transform(parts, lambda hs: F.array(*(x for i in range(WIDE // WORDS) for x in numbers(hs[i]))))


def lanes(hashes: Column) -> Column:
    """How many sentences have each bit, two counts to a bigint.

    Sentences are counted by blocks of as many as a field of ``FIELD`` bits can count: one addition counts every
    ``FIELD``-th bit of a number, and only the blocks' counts are taken apart bit by bit.
    """
    zero = F.lit(0).cast("bigint")
    ones = F.lit(sum(1 << i for i in range(0, 2 * BITS, FIELD)))
    size = (1 << FIELD) - 1
    pair = F.lit(size | size << BITS)

    def counted(block: Column, k: int, j: int) -> Column:
        return F.aggregate(block, zero, lambda a, w: a + F.shiftright(w[k], j).bitwiseAND(ones))

    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(hashes) - 1) / size)).cast("int"))
    blocks = F.transform(numbers, lambda c: F.slice(hashes, c * size + 1, size))
    blocks = F.transform(blocks, lambda b: F.array(*(counted(b, k, j) for k in range(WORDS) for j in range(FIELD))))

    def total(bs: Column, k: int, j: int) -> Column:
        return F.aggregate(bs, zero, lambda a, x: a + F.shiftright(x[k * FIELD + j % FIELD], j - j % FIELD).bitwiseAND(pair))

    return F.transform(F.array(blocks), lambda bs: F.array(*(total(bs, k, j) for k in range(WORDS) for j in range(BITS))))[0]


def wide_sums(hashes: Column) -> Column:
    """The lane sums of the paragraphs' vectors modulo 2^30, two to a bigint."""
    zero = F.lit(0).cast("bigint")

    def summed(k: int) -> Column:
        low = F.aggregate(hashes, zero, lambda a, w: a + w[k].bitwiseAND(F.lit(LOW)))
        high = F.aggregate(hashes, zero, lambda a, w: a + F.shiftright(w[k], BITS))
        return packed(low, high)

    return F.array(*(summed(k) for k in range(WIDE)))


def packed(low: Column, high: Column) -> Column:
    """Two lanes, each taken modulo 2^30, as one bigint."""
    return low.bitwiseAND(F.lit(LOW)) + F.shiftleft(high.bitwiseAND(F.lit(LOW)), BITS)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: a struct of ``sums`` and ``p`` of paragraphs, ``lanes`` and ``n`` of sentences."""
    cols = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(*cols, sentence_hashes(t).alias("_s"), paragraph_hashes(t).alias("_p"))
    return d.select(*cols, F.struct(wide_sums(F.col("_p")).alias("sums"), F.size("_p").alias("p"), lanes(F.col("_s")).alias("lanes"), F.size("_s").alias("n")).alias(name))


def text_of(f: Column) -> Column:
    """The fingerprint as a string: paragraphs, sentences, lane sums, counts."""
    sums = F.array_join(F.transform(f["sums"], lambda v: F.lpad(F.hex(v), 15, "0")), "")
    counts = F.array_join(F.transform(f["lanes"], lambda v: F.hex(v)), ",")
    return F.concat_ws(":", f["p"].cast("string"), f["n"].cast("string"), F.lower(sums), F.lower(counts))


def combined(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` on the numbers of paragraphs and sentences and, modulo 2^30, on every lane."""
    both = lambda x, y: packed(f(x.bitwiseAND(F.lit(LOW)), y.bitwiseAND(F.lit(LOW))), f(F.shiftright(x, BITS), F.shiftright(y, BITS)))
    return F.struct(F.zip_with(a["sums"], b["sums"], both).alias("sums"), f(a["p"], b["p"]).alias("p"), F.zip_with(a["lanes"], b["lanes"], both).alias("lanes"), f(a["n"], b["n"]).alias("n"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets of paragraphs."""
    return combined(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint after the paragraphs of ``b``, which are among those of ``a``, go."""
    return combined(a, b, lambda x, y: x - y)


def same_paragraphs(a: Column, b: Column) -> Column:
    """Whether two texts have the same multiset of paragraphs."""
    return (a["p"] == b["p"]) & (a["sums"] == b["sums"])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the counts read as sums of +1 and -1."""

    def signed(f: Column) -> Column:
        lane = lambda c: (2 * c - f["n"]).cast("double")
        return F.flatten(F.transform(f["lanes"], lambda v: F.array(lane(v.bitwiseAND(F.lit(LOW))), lane(F.shiftright(v, BITS)))))

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    squares = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x * x)

    def measured(v: Column) -> Column:
        return F.struct((F.sqrt(squares(v["a"])) * F.sqrt(squares(v["b"]))).alias("size"), total(F.zip_with(v["a"], v["b"], lambda x, y: x * y)).alias("dot"))

    def cosine(m: Column) -> Column:
        near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), m["dot"] / m["size"]))
        return F.when(m["size"] > 0, near).otherwise(F.when((a["n"] == 0) & (b["n"] == 0), 1.0).otherwise(0.0))

    # arrays and sums are made once, then met by their names
    both = F.array(F.struct(signed(a).alias("a"), signed(b).alias("b")))
    return F.transform(F.transform(both, measured), cosine)[0]


def with_next(df: DataFrame, key: str, tie: str, values: list[str], pieces: int, least: int = 64) -> DataFrame:
    """Add ``next_<v>`` of the row that follows in the order of ``key`` (not null) and ``tie``; the first follows the last.

    Keys are cut into at most ``pieces`` ranges of about ``least`` rows or more, at approximate quantiles, which are keys
    that occur. A key at which two cuts fall has more rows than a range: such keys, fewer than ``pieces``, are sorted
    apart, over all tasks (``within_keys``), and only the first and the last row of each take their places in the ranges.
    """
    share = [i / pieces for i in range(pieces)]
    got = df.agg(F.min(key).alias("low"), F.count(key).alias("rows"), F.percentile_approx(key, share, 100 * pieces).alias("q")).first()  # at most ``pieces`` keys
    if got["low"] is None:
        return df.select("*", *(F.col(v).alias(f"next_{v}") for v in values))
    cuts = [got["low"], *got["q"][:: -(-pieces // max(1, got["rows"] // least))]]
    heavy = [k for k, times in Counter(cuts[1:]).items() if times > 1]
    whole = F.lit(0).alias("_end")
    if not heavy:
        return in_ranges(df.select("*", whole), key, tie, values, sorted(set(cuts))).drop("_end")
    among, ends = within_keys(df.filter(F.col(key).isin(heavy)), key, tie, values, pieces)
    rest = df.filter(~F.col(key).isin(heavy)).select("*", whole).unionByName(ends)
    return in_ranges(rest, key, tie, values, sorted(set(cuts))).filter("_end <> 1").drop("_end").unionByName(among)


def in_ranges(df: DataFrame, key: str, tie: str, values: list[str], bounds: list[int]) -> DataFrame:
    """``next_<v>`` in the order of ``key``, ``tie`` and ``_end``, a window a range; ranges begin at ``bounds``.

    The rows of a bound are the first of their range, and a second copy of them ends the range before. So each range
    knows its last row's successor and no task sorts more than a range.
    """
    n = len(bounds)
    at = F.array(*map(F.lit, bounds))
    powers = [1 << i for i in reversed(range(n.bit_length()))]
    where = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda lo, p: F.when(F.when(lo + p < n, F.try_element_at(at, lo + p + 1) <= F.col(key)).otherwise(False), lo + p).otherwise(lo))
    d = df.select("*", where.alias("_b"))
    ends = F.when(F.col(key) == bounds[0], F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")), F.struct(F.lit(n - 1).alias("b"), F.lit(2).alias("g"))))
    ends = ends.when(F.col(key).isin(bounds[1:]), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g")), F.struct((F.col("_b") - 1).alias("b"), F.lit(1).alias("g"))))
    d = d.select(*df.columns, F.explode(ends.otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))))).alias("_at"))
    w = Window.partitionBy("_at.b").orderBy("_at.g", key, tie, "_end")
    d = d.select(*df.columns, F.col("_at.g").alias("_g"), *(F.lead(v).over(w).alias(f"next_{v}") for v in values))
    return d.filter("_g = 0").drop("_g")


def within_keys(df: DataFrame, key: str, tie: str, values: list[str], pieces: int) -> tuple[DataFrame, DataFrame]:
    """Of keys with many rows: the rows that aren't the last of their key, with ``next_<v>``, and the outermost rows, with
    ``_end`` 1 for the first and 2 for the last (also where that is the only one).

    Rows are range-partitioned by key, tie and place in the input, so that even equal rows are spread. The successor of a
    partition's last row is the first of the next one: one row a partition crosses over.
    """
    order = [key, tie, "_row"]
    d = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(pieces, *order)
    d = common.materialize(d.withColumn("_part", F.spark_partition_id()), "repeats")
    seen = d.groupBy(key).agg(F.min(F.struct(tie, "_row"))["_row"].alias("_first"), F.max(F.struct(tie, "_row"))["_row"].alias("_last"))
    d = d.join(F.broadcast(common.materialize(seen, "outermost")), key)  # a row a key
    last = F.col("_row") == F.col("_last")
    ends = d.filter(last | (F.col("_row") == F.col("_first"))).select(*df.columns, F.when(last, 2).otherwise(1).alias("_end"))
    heads = d.groupBy("_part").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    heads = heads.select("_part", F.lead("_v").over(Window.orderBy("_part")).alias("_over"))
    w = Window.partitionBy("_part").orderBy(*order)
    d = d.select("*", F.lead(F.struct(*values)).over(w).alias("_next")).join(heads, "_part")
    after = F.coalesce("_next", "_over")
    return d.filter(~last).select(*df.columns, *(after[v].alias(f"next_{v}") for v in values)), ends


def edits(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and the likeness to it and to the next document.

    The edited text has, for its last floor(n / 2) code points, the first as many of the next document.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_key"))
    d = with_fingerprint(d, "text", "fp")
    d = with_next(d, "_key", "text", ["text", "fp"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    d = with_fingerprint(d, "edited", "edited_fp")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        F.round(likeness(F.col("fp"), F.col("edited_fp")), 6).alias("near_edited"), F.round(likeness(F.col("fp"), F.col("next_fp")), 6).alias("near_next"),
    )
