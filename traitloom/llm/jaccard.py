"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles; two link when intersection / union is at least ``percent`` / 100.
Sets are put in one global order: tokens that the corpus sketch finds frequent come last, then by hash. Sets of sizes
x and y that link share at least o = ceil(percent (x + y) / (100 + percent)) tokens, so their prefixes of x - o + 1
and y - o + 1 tokens share one, and extended by m more, 1 + m. Either the shared token of the plain prefixes is of the
rare class, where tokens are indexed alone; or both plain prefixes hold a frequent token: then, as frequent tokens
fall into m subclasses by hash, the extended prefixes share a rare token or two frequent ones of a subclass, indexed
as 2-combinations. m grows with the size class of the set, which holds a document to about ten combinations a prefix
token; a set that can link into the size class below is indexed under that class too. Stored prefixes are as long as
the smallest possible partner asks for, and each pair is held to the prefixes that its own sizes give. A set with fewer
than 1 + m tokens that others have as well can't link and leaves early; candidates that don't share 1 + m are dropped,
the others verified on their whole texts.

No pair is made inside a group that is known to be one component: copies collapse to one set first; then each token
links its sets only to the one where it stands first (a star; in a group of near copies that is the set with the
fewest tokens of its own), and after these links are verified and contracted, pairs are made only across components
that still meet in a token. Frequency classes count components, not documents.

Shingles are 64-bit hashes, sets 128-bit digests of them. Defined cases: a null or empty text, or one without words,
has the empty set and links with nothing; fewer words than a shingle make one shingle; repeated rows are copies; a
null id takes part but never becomes a component id unless there is no other (then it is null); an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BINS = 1 << 20
#: Bins of a row that carries a part of the sketch, and the groups in which rows of a part are first added up.
CHUNK = 1 << 13
SALTS = 64
#: Shingles among which a task looks for repeated ones (32 MB).
SPAN = 1 << 22
#: Earlier shared tokens that a posting carries, so that a pair shows itself about once; how many changes no result.
BACK = 16
RARE = 16
#: Components that must still meet in a token for the second star.
CROWD = 4
#: Part of its shorter plain prefix that a pair must show in stars to be verified first; the others wait for the second pass.
STAR = 0.25
#: Documents whose ids (24 bytes each) are broadcast rather than shuffled with the texts.
SMALL = 300_000
NULL_ID = -(1 << 63)
ODD = (np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; ASCII letters fold case, words are cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    w = min(k, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - w + 1, np.uint64(w), np.uint64)
        for j in range(w):
            acc = acc + h[j : n - w + 1 + j] * (ODD[j % 8] + np.uint64(2 * (j // 8)))
        return np.unique(mixed(acc))


def size_class(n: np.ndarray | int):
    """Subclasses m of the frequent tokens by set size: 1 below 64, then n // 32 rounded down to a power of two."""
    n = np.maximum(np.asarray(n), 1)
    return np.where(n < 64, 1, 1 << np.maximum(np.floor(np.log2(n)).astype(int) - 5, 0))


def reach(n: int, percent: int) -> int:
    """The subclasses of the smallest set that a set of size n can link to."""
    return int(size_class(-(-percent * n // 100)))


def prefix_length(n: int, percent: int, m: int) -> int:
    return min(n, n - (-(-percent * n // 100)) + 1 + m)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def cells(s: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's two cells: one in each half of a sketch of ``2 * bins`` counts."""
    return (s >> np.uint64(40)).astype(np.int64) % bins, bins + (s & np.uint64(0xFFFFFF)).astype(np.int64) % bins


def repeated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur several times, and how often; sorts ``x`` in place."""
    x.sort()
    again = np.flatnonzero(x[1:] == x[:-1])  # places whose value comes again right after
    if not len(again):
        return x[:0], np.zeros(0, np.int64)
    begin = np.flatnonzero(np.append(True, np.diff(again) > 1))
    return x[again[begin]], np.diff(np.append(begin, len(again))) + 1


def profile(docs: DataFrame, k: int, bins: int = BINS) -> DataFrame:
    """One pass: for each document ``doc_id th f1 f2 n`` (``th``: hash of the text), and rows of the corpus sketch.

    The sketch counts the shingles that repeat among the different sets of a window of ``SPAN`` shingles; as the
    others, by far the most, don't enter, it isn't drowned by their number. Its rows hold a run of bins: their number
    ``doc_id``, a salt ``f1`` and the counts ``part``, compressed; a task makes ``2 * bins / CHUNK`` of them however
    much it reads.
    """

    def run(batches):
        sketch = np.zeros(2 * bins, np.int64)
        names = ["doc_id", "f1", "f2", "n", "part", "th"]
        salt = held = 0
        window = np.zeros(SPAN, np.uint64)
        seen: set[tuple[int, int]] = set()

        def close() -> None:
            toks, count = repeated(window[:held])
            for at in cells(toks, bins):
                np.add.at(sketch, at, count)
            seen.clear()

        for batch in batches:
            d1, d2, size = [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), k)
                a, b = digest(s)
                d1.append(a), d2.append(b), size.append(len(s))
                salt = a % SALTS
                if held + len(s) > SPAN:
                    close()
                    held = 0
                if (a, b) not in seen and len(s) <= SPAN:  # a window that a single set fills repeats nothing
                    seen.add((a, b))
                    window[held : held + len(s)] = s
                    held += len(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (d1, d2, size)), pa.nulls(len(d1), pa.binary()), batch.column(2)], names=names)
        close()
        if sketch.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(-1, CHUNK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([salt] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(parts, pa.binary()), pa.nulls(n, pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, f1 long, f2 long, n long, part binary, th long")


def corpus_sketch(profiled: DataFrame, bins: int) -> np.ndarray:
    """The counts of all cells: parts are added up within salts, then across them; ``2 * bins`` numbers reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("part"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "salt": table.column("salt").slice(0, 1), "part": [zlib.compress(total.tobytes(), 1)]})

    kind = "chunk long, salt long, part binary"
    parts = profiled.filter("part is not null").select(F.col("doc_id").alias("chunk"), F.col("f1").alias("salt"), "part")
    parts = parts.groupBy("chunk", "salt").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
    sketch = np.zeros(2 * bins, np.int64)
    for r in parts.toLocalIterator():
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["part"]), np.int64)
    return sketch


def levels(sketch: np.ndarray) -> np.ndarray:
    """How frequent the shingles of a cell are, in powers of two above the noise of the others; 0 for rare ones.

    A shingle's level is the lower one of its two cells, so a rare one is seldom taken for frequent.
    """
    mean = sketch.mean()
    above = np.maximum(0.0, (sketch - mean) / np.sqrt(mean + 1) - 4)
    return np.floor(np.log2(1 + above)).astype(np.uint8)


def parities(s: np.ndarray) -> np.ndarray:
    """A bitmap of at least as many bits as shingles, a power of two; a bit is the parity of the shingles that fall on it."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(docs: DataFrame, k: int, percent: int, level) -> DataFrame:
    """``f1 f2 doc_id th n bits toks``: digest, id, hash of the text, size, parities and the ordered, extended prefix; empty sets go."""

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))

    def run(batches):
        rank = level.value
        bins = len(rank) // 2
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1)):
                s = shingles(t.as_py(), k)
                n = len(s)
                if not n:
                    continue
                first, second = cells(s, bins)
                order = np.argsort(np.minimum(rank[first], rank[second]), kind="stable")
                toks = s[order[: prefix_length(n, percent, int(size_class(n)))]].view(np.int64)
                rows.append((i, *digest(s), n, parities(s), toks))
            at = pa.array([r[0] for r in rows], pa.int64())
            f1, f2, n = (pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3))
            bits, toks = (lists([r[c] for r in rows]) for c in (4, 5))
            yield pa.RecordBatch.from_arrays([f1, f2, batch.column(0).take(at), batch.column(2).take(at), n, bits, toks], names=["f1", "f2", "doc_id", "th", "n", "bits", "toks"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "f1 long, f2 long, doc_id long, th long, n long, bits array<long>, toks array<long>")


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, from the whole texts of the sets' smallest documents."""
    key = sets.select("node", "doc_id", "th")
    pairs = common.materialize(pairs.select("a", "b"), "pairs")
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(key, "node")
    need = many = common.materialize(need.select("node", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("th").alias("_th")), "needed")
    if need.count() <= SMALL:  # then they are few enough to broadcast, and no text of other documents moves
        need = F.broadcast(need)
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th"), "text")
    texts = common.materialize(text.join(need, ["_id", "_th"]).select("node", "text"), "texts")
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")

    def run(batches):
        last, last_set = None, None
        for batch in batches:
            hit = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x = x.as_py()
                if x != last:
                    last, last_set = x, shingles(x, k)
                other = shingles(y.as_py(), k)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * both >= percent * (len(last_set) + len(other) - both):
                    hit.append(i)
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    links = common.materialize(two.mapInArrow(run, "a long, b long"), "links")
    common.release(pairs, many, texts)
    return links


def components(links: list[DataFrame]) -> DataFrame:
    """``node comp``: the smallest node that each linked node reaches, by alternating large and small stars."""
    links = [x.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) for x in links]
    e = common.materialize(reduce(DataFrame.unionByName, links).filter("u <> v").distinct(), "edges")
    while True:
        # large star: each neighbour above a node moves to the smallest of its neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.materialize(large, "large")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = common.materialize(small, "edges")
        mark = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))]
        same = e.agg(*mark).first() == new.agg(*mark).first()
        common.release(e, large)
        if same:
            return common.materialize(new.select(F.col("u").alias("node"), F.col("v").alias("comp")), "comp")
        e = new


def firsts(kinds: np.ndarray, most: int) -> np.ndarray:
    """Where a value of ``kinds`` occurs for the ``most``-th time or earlier."""
    order = np.argsort(kinds, kind="stable")
    x = kinds[order]
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    rank = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    return np.sort(order[rank < most])


def combos(frequent: DataFrame, percent: int) -> DataFrame:
    """``sig m pos node n comp first prev``: the 2-combinations of frequent prefix tokens in a subclass, for each size class.

    ``frequent`` has a row a set: ``node n comp toks pos kinds``, the frequent tokens of its prefix in order, their
    places, and numbers that are the same for tokens that the same sets hold: of such tokens two in a subclass are
    enough. ``pos`` of a combination is the place of its later token, ``prev`` the last ``BACK`` tokens before that in
    the subclass, ``first`` the place of the set's first frequent token.
    """

    def run(batches):
        for batch in batches:
            out, prev, long = [], [], []
            for node, n, comp, toks, pos, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                toks, pos, kinds = np.array(toks, np.int64), np.array(pos), np.array(kinds, np.int64)
                for m in sorted({int(size_class(n)), reach(n, percent)}):
                    keep = pos < prefix_length(n, percent, m)
                    if keep.sum() <= m:  # a pair that only frequent tokens show shares 1 + m of them
                        continue
                    part = mixed(toks.view(np.uint64)) % np.uint64(m)
                    for c in np.unique(part[keep]):
                        at = np.flatnonzero(keep & (part == c))
                        at = at[firsts(kinds[at], 2)]
                        x = toks[at]
                        j, i = np.tril_indices(len(x), -1)
                        with np.errstate(over="ignore"):
                            sig = mixed(x[i].view(np.uint64) * ODD[0] + x[j].view(np.uint64) * ODD[1] + np.uint64(m)).view(np.int64)
                        out.append((sig, pos[at][j], m, node, n, comp, pos[0]))
                        prev += [np.tile(x[max(0, b - BACK) : b], b) for b in range(1, len(x))]
                        long.append(np.minimum(j, BACK))
            sizes = [len(x[0]) for x in out]
            cat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
            before = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cat(long))).astype(np.int32)), pa.array(cat(prev)))
            yield pa.RecordBatch.from_arrays([*(pa.array(cat([x[c] for x in out])) for c in (0, 1)), *(pa.array(np.repeat(np.array([x[c] for x in out], np.int64), sizes)) for c in (2, 3, 4, 5, 6)), before], names=["sig", "pos", "m", "node", "n", "comp", "first", "prev"])

    return frequent.select("node", "n", "comp", "toks", "pos", "kinds").mapInArrow(run, "sig long, pos long, m long, node long, n long, comp long, first long, prev array<long>")


def overlap(n1: Column, n2: Column, percent: int) -> Column:
    """The least number of shared tokens with which sets of these sizes link."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent))


def fits(n1: Column, n2: Column, percent: int) -> Column:
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def subclasses(n: Column) -> Column:
    """``size_class`` as a column."""
    return F.when(n < 64, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) - 5)).cast("long")


def largest(n: Column, place: Column, percent: int) -> Column:
    """The size of the largest set for whose pair with a set of size n ``place`` lies in the plain prefix of the latter."""
    return F.least(F.floor(100 * n / percent), F.floor((n - place) * (100 + percent) / percent) - n)


def sides(postings: DataFrame, key: str, others: list[str], most: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a self-join, columns numbered: smaller sets go to the size buckets ``b1`` of their partners,
    up to size ``most``; larger ones to their own bucket ``b2``. So sets of sizes that don't fit never meet."""
    names = [key, *others]
    bucket = lambda n: F.floor(F.ln(n.cast("double")) * (4 / (math.log(100 / percent) + 0.01))).cast("int")
    small = postings.select(*names, most.alias("most")).filter(F.col("most") >= F.col("n"))
    small = small.select(*(F.col(c).alias(f"{c}1") for c in names), F.explode(F.sequence(bucket(F.col("n")), bucket(F.col("most")))).alias("b1"))
    return small, postings.select(*(F.col(c).alias(f"{c}2") for c in names), bucket(F.col("n")).alias("b2"))


def able(postings: DataFrame, percent: int) -> DataFrame:
    """The rows of sets with enough tokens for a link: one more than the subclasses of their smallest partner."""
    need = 1 + subclasses(F.ceil(percent * F.col("n") / F.lit(100)))
    some = postings.groupBy("node", "n").agg(F.count("*").alias("_c")).filter(F.col("_c") >= need).select("node")
    return postings.join(some, "node", "left_semi")


def open_tokens(postings: DataFrame, percent: int, name: str) -> DataFrame:
    """The rows of tokens in which components still meet, with ``comps``, how many; of sets with enough such tokens."""
    s = common.materialize(postings, f"{name}-meet")
    heads = common.materialize(s.groupBy("tok", "comp").agg(F.count("*").alias("_c")).groupBy("tok").agg(F.count("*").alias("comps")).filter("comps > 1"), f"{name}-heads")
    out = common.materialize(able(s.join(heads, "tok"), percent), name)
    common.release(s, heads)
    return out


def stars(postings: DataFrame, percent: int, least: int, part: float) -> DataFrame:
    """Pairs (a, b) of a set and a token's ``pivot`` (node, n, pos), both within the plain prefixes of their sizes.

    A star shows only some of a pair's shared tokens: those pairs are given that show ``least``, and ``part`` of the
    shorter prefix.
    """
    star = postings.filter("node <> pivot.node").select(F.col("pivot.node").alias("a"), F.col("node").alias("b"), F.col("pivot.n").alias("n1"), F.col("n").alias("n2"), F.col("pivot.pos").alias("pos1"), F.col("pos").alias("pos2"))
    o = overlap(F.col("n1"), F.col("n2"), percent)
    star = star.filter(fits(F.col("n1"), F.col("n2"), percent) & (F.col("pos1") <= F.col("n1") - o) & (F.col("pos2") <= F.col("n2") - o))
    pairs = star.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("c"), F.min(F.least(F.col("n1") - o, F.col("n2") - o)).alias("r"))
    return pairs.filter(F.col("c") >= F.greatest(F.lit(least), F.col("r") * part)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) without those whose parities show that they can't link.

    Each shingle that only one of two sets holds turns one bit, so bits that differ are at most as many as such
    shingles, which links bound. The bitmap of the larger set may be twice as long: its halves are added first.
    """
    d = pairs
    for i, c in ((1, "a"), (2, "b")):
        d = d.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"w{i}")), c)
    short = F.least(F.size("w1"), F.size("w2"))
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda w: F.when(F.size(w) == F.col("s"), F.col(w)).otherwise(F.zip_with(F.slice(w, F.lit(1), F.col("s")), F.slice(w, F.col("s") + 1, F.col("s")), xor))
    d = d.filter(fits(F.col("n1"), F.col("n2"), percent)).select("a", "b", "n1", "n2", "w1", "w2", short.alias("s"))
    apart = F.aggregate(F.zip_with(half("w1"), half("w2"), xor), F.lit(0), lambda t, x: t + F.bit_count(x))
    return d.filter(apart <= F.col("n1") + F.col("n2") - 2 * overlap(F.col("n1"), F.col("n2"), percent)).select("a", "b")


def holders(postings: DataFrame) -> DataFrame:
    """``tok low high at kind``: the first and last component of a token, its first set and place there, and a number
    that is the same for tokens that the same sets hold."""
    h = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).cast("string") for i in range(2)]
    t = postings.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("node", "pos")).alias("at"), F.xxhash64(F.count("*"), F.min("node"), *h).alias("kind"))
    return t.filter("low <> high")


def leading(postings: DataFrame) -> DataFrame:
    """``postings`` of the tokens in which components meet; of tokens that the same sets hold only the first in order.

    What a later one of them shows, the first shows as well, at earlier places. Adds ``prev``: the ``BACK`` tokens of
    the set before a token, of those that are left.
    """
    tokens = holders(postings).groupBy("kind").agg(F.min_by("tok", "at.pos").alias("tok")).select("tok")
    p = postings.join(common.materialize(tokens, "leading"), "tok")
    return p.withColumn("prev", F.collect_list("tok").over(Window.partitionBy("node").orderBy("pos").rowsBetween(-BACK, -1)))


def link(docs: DataFrame, k: int = 5, percent: int = 80, rare: int = RARE, bins: int = BINS) -> DataFrame:
    """One row a document: ``doc_id n_shingles component_id set_id``.

    ``component_id`` is the smallest id that links reach, the document itself included; ``set_id`` numbers the distinct
    sets (null for the empty set).
    """
    return linked(docs, k, percent, rare, bins).select("doc_id", "n_shingles", "component_id", "set_id")


def linked(docs: DataFrame, k: int, percent: int, rare: int = RARE, bins: int = BINS) -> DataFrame:
    """The rows of ``link`` with ``th``, the hash of the text, and ``first_th``, that of the row that stands for the component.

    That row has the component's id; ``first_th`` is null for the empty set.
    """
    if percent <= 50:
        raise ValueError("percent must be above 50")
    spark = docs.sparkSession
    both = common.materialize(profile(docs, k, bins), "profile")
    level = spark.sparkContext.broadcast(levels(corpus_sketch(both, bins)))  # two bytes a bin
    p = prefixes(docs, k, percent, level)
    # copies collapse; map-side aggregation keeps one row of a set and task
    sets = p.groupBy("f1", "f2").agg(F.min_by(F.struct("doc_id", "th"), F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("d"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.first("toks").alias("toks"))
    sets = common.materialize(sets.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "d.doc_id", "d.th", "n", "bits", "toks"), "sets")
    level.destroy()

    # tokens of two sets or more, each with the set where it stands first
    post = sets.select("node", "n", F.posexplode("toks").alias("pos", "tok"))
    pivots = post.groupBy("tok").agg(F.count("*").alias("_c"), F.min(F.struct("pos", "node", "n")).alias("pivot")).filter("_c > 1").select("tok", "pivot")
    pivots = common.materialize(pivots, "pivots")
    held = common.materialize(post.join(pivots, "tok"), "common")
    shared = common.materialize(able(held, percent), "shared")
    common.release(pivots, held)
    links = [verify(docs, sets, near(stars(shared, percent, 2, STAR), sets, percent), k, percent)]
    comp = components(links)
    # a second star, without that measure, where many components still meet in a token
    s = open_tokens(shared.drop("pivot").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), percent, "again")
    many = s.filter(F.col("comps") > CROWD)
    pivots = common.materialize(many.groupBy("tok").agg(F.min(F.struct("pos", "node", "n", "comp")).alias("pivot")), "pivots")
    found = common.materialize(stars(many.join(pivots, "tok").filter("comp <> pivot.comp"), percent, 1, 0.0), "stars")
    links.append(verify(docs, sets, near(found, sets, percent), k, percent))
    common.release(s, pivots, found, comp)
    comp = components(links)

    # what still meets across components
    s = open_tokens(shared.drop("pivot").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), percent, "open")
    common.release(shared, comp)
    s = s.withColumn("often", F.col("comps") > rare)
    last = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100))  # of the longest plain prefix
    frequent = s.filter("often").join(common.materialize(holders(s.filter("often")).select("tok", "kind"), "kinds"), "tok")
    frequent = frequent.groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("pos", "tok", "kind"))).alias("x"))
    frequent = frequent.select("node", "n", "comp", F.col("x.tok").alias("toks"), F.col("x.pos").alias("pos"), F.col("x.kind").alias("kinds"))
    frequent = common.materialize(frequent.filter(F.col("pos")[0] <= last), "frequent")  # a link over frequent tokens needs one there

    # tokens of the rare class alone: in plain prefixes, or in extended ones where both sets have frequent tokens early
    tail = F.lit(1 << 40)
    later = s.withColumn("after", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("pos"))) - 1)
    alone = later.filter("not often").join(frequent.select("node", F.col("pos")[0].cast("long").alias("first")), "node", "left")
    alone = alone.select("tok", "node", "n", "pos", "comp", "after", F.coalesce("first", tail).alias("first")).filter((F.col("pos") <= last) | (F.col("first") <= last))
    alone = common.materialize(alone, "alone")
    o = overlap(F.col("n1"), F.col("n2"), percent)
    r1, r2 = F.col("n1") - o, F.col("n2") - o  # the last places of the plain prefixes
    m, own = subclasses(F.col("n1")), subclasses(F.col("n"))
    until = lambda place: largest(F.col("n"), place, percent)
    apart = (F.col("comp1") != F.col("comp2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))) & fits(F.col("n1"), F.col("n2"), percent)
    most = F.greatest(until(F.col("pos")), F.least(until(F.col("first")), until(F.col("pos") - own)))
    x, y = sides(leading(alone), "tok", ["node", "n", "pos", "comp", "after", "first", "prev"], most, percent)
    # if the first token that a pair shares is of the rare class it stands for the pair, and m more come after it
    plain = (F.col("pos1") <= r1) & (F.col("pos2") <= r2) & (F.least("after1", "after2") >= m)
    longer = (F.col("first1") <= r1) & (F.col("first2") <= r2) & (F.col("pos1") <= r1 + m) & (F.col("pos2") <= r2 + m)
    # where an earlier token is shared too that one has shown the pair: the conditions hold at earlier places if at later ones
    new = ~F.arrays_overlap("prev1", "prev2")
    pairs = x.join(y, (F.col("tok1") == F.col("tok2")) & (F.col("b1") == F.col("b2")) & apart & (plain | longer) & new)
    pairs = pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b"))

    # tokens of the frequent class by two
    most = F.when(F.col("m") == own, F.least(until(F.col("first")), until(F.col("pos") - own))).otherwise(0)
    by_two = common.materialize(combos(frequent, percent), "combos")
    x, y = sides(by_two, "sig", ["pos", "m", "node", "n", "comp", "first", "prev"], most, percent)
    early = (F.col("first1") <= r1) & (F.col("first2") <= r2) & (F.col("pos1") <= r1 + m) & (F.col("pos2") <= r2 + m)
    new = F.size(F.array_intersect("prev1", "prev2")) < 2
    more = x.join(y, (F.col("sig1") == F.col("sig2")) & (F.col("m1") == F.col("m2")) & (F.col("b1") == F.col("b2")) & apart & early & new)
    more = more.select(F.col("node1").alias("a"), F.col("node2").alias("b"))
    candidates = common.materialize(pairs.unionByName(more).distinct(), "candidates")
    links.append(verify(docs, sets, near(candidates, sets, percent), k, percent))
    common.release(s, frequent, alone, by_two, candidates)
    comp = components(links)
    common.release(*links)

    small = sets.select("node", "doc_id", "th").join(comp, "node", "left").select("node", "doc_id", "th", F.coalesce("comp", "node").alias("comp"))
    root = small.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("d")).select("comp", F.col("d.doc_id").alias("component_id"), F.col("d.th").alias("first_th"))
    of = common.materialize(small.join(root, "comp").select("node", "component_id", "first_th").join(sets.select("node", "f1", "f2"), "node"), "of")
    common.release(sets, comp)
    rows = both.filter("n is not null").select("doc_id", "th", "f1", "f2", F.col("n").alias("n_shingles"))
    out = rows.join(of, ["f1", "f2"], "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("node").alias("set_id"), "first_th")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: one of the smallest id; texts without words link with nothing and all stay.

    A row without an id stays only if its component has no id. Rows are told apart by id and text.
    """
    cols = docs.columns
    key = ["doc_id", "th"]
    found = common.materialize(linked(docs, k, percent).filter("n_shingles > 0"), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th"))
    gone = found.filter(~stays).select(*key).distinct()
    again = common.materialize(found.filter(stays).groupBy(*key).agg(F.count("*").alias("_c")).filter("_c > 1").select(*key), "again")
    d = docs.withColumn("_th", F.xxhash64("text"))

    def among(rows: DataFrame, how: str) -> DataFrame:
        r = rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_of"))
        return d.join(r, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of")), how)

    # of rows that repeat both id and text one stays
    twice = among(again, "left_semi").dropDuplicates(["doc_id", "_th"])
    return among(gone.unionByName(again), "left_anti").select(*cols).unionByName(twice.select(*cols))
