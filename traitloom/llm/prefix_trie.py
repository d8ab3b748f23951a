"""Trie of the conversations' prefixes: members, children, leaves and tokens saved of every node.

A conversation is the list of its turns' digests (128 bits of SHA-256 over role and text). Equal conversations become one
row with a weight; the distinct ones are range-sorted into blocks. Each block has the numbers of leading turns that
neighbours share (LCP) and a sparse table of their minima: a prefix of i with d turns has as members the rows around i up
to where the LCP falls below d, and both ends are binary-searched on the table, each on its own, without a stack. What a
node counts is then a difference of prefix sums, or a minimum over the range:

- of weights, for members; of leaf flags, for leaves; of LCPs equal to d, for children;
- saved tokens are (members - 1) * length over a subtree: the lengths below the prefix of all members, less those of all
  distinct nodes.

A node whose range reaches the end of a block goes on in the next one; the parts add up, and there are at most as many
such parts as blocks times turns that neighbours at the blocks' ends share.

A digest of all members' ids is a hash of one sequence, so it can't be cut: ids go in runs of ``RUN``, and one task
streams a sequence's runs in order, holding none.

Defined cases: rows without ``conv_id`` are in no conversation; turns without a number come first, equal numbers go by
digest; null roles and texts are empty; repeated rows are turns of their own; no conversations give no nodes, not even the
root; other columns are ignored. The digests of one conversation are in one row (about 50 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hex digits of a turn's digest.
WIDE = 32
#: Ids in a run; distinct conversations and turns in a block.
RUN = 10_000
ROWS = 20_000
TURNS = 200_000
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id turns``: an array of (digest, chars) in the order of the turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDE)
    t = turns.filter("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return t.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"], x["chars"])).alias("turns"))


def with_shared_starts(convs: DataFrame, kept: Column, start: Column) -> DataFrame:
    """Each conversation's first ``kept`` turns give way to as many of the conversation ``start``, or to none if that is absent."""
    other = convs.select(F.col("conv_id").alias("_id"), F.col("turns").alias("_turns"))
    c = convs.withColumn("_h", kept.cast("int")).withColumn("_start", start)
    first = other.join(c.select("_start", "_h").groupBy("_start").agg(F.max("_h").alias("_most")), F.col("_id") == F.col("_start")).select("_start", F.slice("_turns", F.lit(1), F.col("_most")).alias("_turns"))
    c = c.join(first, "_start", "left")
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return c.select("conv_id", F.concat(F.coalesce(F.slice("_turns", F.lit(1), F.col("_h")), F.slice("turns", 1, 0)), own).alias("turns"))


def runs(convs: DataFrame) -> DataFrame:
    """``key chars first n ids``: conversations in the order of their keys and ids, equal ones in runs of at most ``RUN`` ids."""
    c = convs.select(F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id")
    c = c.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            new = np.flatnonzero([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))])
            begin = np.concatenate([np.arange(x, y, RUN) for x, y in zip(new, [*new[1:], len(keys)], strict=True)])
            end = [*begin[1:].tolist(), len(keys)]
            at, ids = pa.array(begin), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.array(end) - begin), pa.array([",".join(map(str, ids[x:y])) for x, y in zip(begin, end, strict=True)])],
                names=["key", "chars", "first", "n", "ids"],
            )

    return c.mapInArrow(run, "key string, chars array<bigint>, first long, n long, ids string")


def blocks(parts: DataFrame, n: int) -> DataFrame:
    """``block key chars first n ends``: distinct conversations, range-sorted into at most ``n`` blocks; ``ends`` is the digest of their ids."""
    p = parts.repartitionByRange(n, "key").sortWithinPartitions("key", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        names = ["block", "key", "chars", "first", "n", "ends"]
        types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        held, digest = None, None  # the conversation at hand: its ids go to the digest as they come

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for key, chars, first, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[1] == key:
                    held[4] += n
                    digest.update(b"," + ids.encode())
                    continue
                if held:
                    rows.append((*held, digest.hexdigest()))
                held, digest = [block, key, chars, first, n], hashlib.sha256(ids.encode())
            if len(rows) >= 2_000:
                yield batch()
                rows = []
        if held:
            rows.append((*held, digest.hexdigest()))
            yield batch()

    return p.mapInArrow(run, "block long, key string, chars array<bigint>, first long, n long, ends string")


def shared(a: str, b: str) -> int:
    """Leading turns that two keys share."""
    most = min(len(a), len(b)) // WIDE
    if a[: most * WIDE] == b[: most * WIDE]:
        return most
    low, high = 0, most  # low turns are shared, high aren't
    while high - low > 1:
        m = (low + high) // 2
        if a[low * WIDE : m * WIDE] == b[low * WIDE : m * WIDE]:
            low = m
        else:
            high = m
    return low


class Minima:
    """Sparse table: level k has the minima of ranges of 2^k numbers."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minimum of the numbers a to b, both included."""
        k = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.levels[level][a[at]], self.levels[level][b[at] - (1 << level) + 1])
        return out

    def right(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The last r >= i such that the numbers i+1 to r are all d or more."""
        r = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = r + 1 < len(level)
            ok[ok] = level[r[ok] + 1] >= d[ok]
            r[ok] += 1 << k
        return r

    def left(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The first l <= i such that the numbers l+1 to i are all d or more."""
        m = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            begin = m - (1 << k) + 1
            ok = begin >= 1
            ok[ok] = level[begin[ok]] >= d[ok]
            m[ok] -= 1 << k
        return m


NODE = "first_row long, last_row long, conv_id long, depth long, parent_conv_id long, n_convs long, all_chars long, own_chars long, above long, n_children long, n_leaves long, ends string, own string, parent string"


def nodes_of(rows: pa.Table, edge: pa.Table) -> pa.Table:
    """Nodes that begin in a block, or go on in it from the block before; ``edge`` has the keys before and after it and the number of rows before."""
    order = pa.compute.sort_indices(rows["key"])
    rows = rows.take(order)
    keys = rows["key"].to_pylist()
    m = len(keys)
    before, after, base = (edge[c][0].as_py() for c in ("before", "after", "base"))
    lcp = np.array([shared(before, keys[0]) if before is not None else -1, *(shared(a, b) for a, b in zip(keys, keys[1:], strict=False))], np.int64)
    next_lcp = shared(keys[-1], after) if after is not None else -1
    size = np.array([len(k) // WIDE for k in keys], np.int64)
    chars = rows["chars"].combine_chunks()
    flat, at = chars.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0], np.cumsum(flat)])
    up_to = lambda i, d: total[at[i] + np.maximum(d, 0)] - total[at[i]]  # noqa: E731  chars of the first d turns of row i
    weight, first = rows["n"].to_numpy().astype(np.int64), rows["first"].to_numpy().astype(np.int64)
    every = np.arange(m)
    whole = up_to(every, size)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    weights, weighted, own = sums(weight), sums(weight * whole), sums(whole - up_to(every, lcp))
    leaf = sums(np.append(lcp[1:], next_lcp) < size)
    places = np.sort(lcp * (m + 1) + every)  # places of each LCP, in order
    lcps, ids = Minima(lcp), Minima(first)

    # candidates: what a row doesn't share with the row before it; and all that the first row shares with the block before
    low = np.where(every == 0, -1, lcp)
    count = size - low
    i = np.repeat(every, count)
    d = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i] + 1
    new = d > lcp[i]

    def extent(i, d):
        left, right = lcps.left(i, d), lcps.right(i, d)
        return left, right, ((left == 0) & (lcp[0] >= d)) | ((right == m - 1) & (next_lcp >= d))

    left, right, open_ = extent(i, d)
    up_left, up_right, up_open = extent(i, np.maximum(d - 1, 0))
    kids = np.searchsorted(places, d * (m + 1) + right, "right") - np.searchsorted(places, d * (m + 1) + left, "left") + (new & (size[left] > d))
    above = up_to(i, d - 1)
    spread = lambda x: x[right + 1] - x[left]
    owned = spread(own) + np.where(new, up_to(left, lcp[left]) - above, 0)
    names = [keys[a][: b * WIDE] if o else None for a, b, o in zip(i, d, open_, strict=True)]
    parents = [keys[a][: (b - 1) * WIDE] if o and b else None for a, b, o in zip(i, d, up_open, strict=True)]
    parent = pa.array(ids.least(up_left, up_right), mask=(d == 0) | up_open)
    ends = rows["ends"].combine_chunks().take(pa.array(i, mask=size[i] != d))
    columns = [base + left, base + right, ids.least(left, right), d, parent, spread(weights), spread(weighted), owned, above, kids, spread(leaf), ends, pa.array(names, pa.string()), pa.array(parents, pa.string())]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in NODE.split(", ")])


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of all ``convs`` (``conv_id turns``, a row a conversation): ``conv_id depth parent_conv_id n_convs
    n_children n_leaves saved_tokens ends_sha256``, and the rows of its members among the sorted distinct conversations.
    """
    parts = common.materialize(runs(convs), "runs")
    rows, turns = parts.agg(F.count("*"), F.sum(F.size("chars"))).first()
    b = common.materialize(blocks(parts, max(1, -(-rows // ROWS), -(-(turns or 0) // TURNS))), "blocks")
    w = Window.orderBy("block")  # a row a block
    edges = b.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))
    edges = edges.select("block", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"), F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    nodes = common.materialize(b.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(nodes_of, NODE), "nodes")
    joined = nodes.filter("own is not null").groupBy("own").agg(
        F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "all_chars", "own_chars")), F.max("above").alias("above"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves")), F.max("ends").alias("ends"), F.max("parent").alias("parent"),
    )
    joined = common.materialize(joined, "joined")
    found = nodes.filter("own is null").unionByName(joined, allowMissingColumns=True)
    over = joined.select(F.col("own").alias("_own"), F.col("conv_id").alias("_conv"))
    found = found.join(over, F.col("parent") == F.col("_own"), "left")
    return found.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("all_chars") - F.col("n_convs") * F.col("above") - F.col("own_chars")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"), "first_row", "last_row",
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations whose first crc32(conv_id) mod 6 turns are those of the first one of their hundred."""
    convs = common.materialize(sequences(conversations), "conversations")
    return with_shared_starts(convs, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.col("conv_id") - F.col("conv_id") % 100)
