"""Packing token sequences by non-negative least squares over the length histogram.

A document's ids are cut into windows and a rest; rests go by the histogram of their lengths (at most one bin a length,
so the driver's part is bounded by the window). All combinations of up to three lengths that fill the window are
enumerated, repeat counts are solved by non-negative least squares against the histogram, rounded down to what is
there, and what is left is packed best-fit, longest first, histogram and all. Pieces then meet their slots by their
rank within their length, which distributed prefix sums give.

Defined cases: a null or empty text is its end id alone; repeated rows and null ids are documents of their own; any
length of text is cut into windows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
END = 0


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The byte-level vocabulary as ranks; tests hold its ids against the tokenizers library's."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=2)
def whole(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A run of white space from this length on is left to the tokenizers library: the faster one gives up on long ones.
LONG_RUN = re.compile(r"\s{400}")


def ids_of(text: str, vocab: tuple) -> list[int]:
    if LONG_RUN.search(text):
        return whole(vocab[3]).encode(text, add_special_tokens=False).ids
    return encoder(*vocab[:3]).encode(text, allowed_special="all")


def vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...], str]:
    """Ranks, split pattern and special ids, and the same vocabulary in the tokenizers library's form."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN, (("<|endoftext|>", 50256),), p.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, vocab: tuple | None = None, window: int = WINDOW) -> DataFrame:
    """``doc_id start length ids_crc32 doc_tokens``: the windows of each document, then its rest."""
    vocab = vocab or vocabulary()
    schema = docs.select("doc_id").schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long")

    def run(batches):
        for b in batches:
            row, start, length, crc, tokens = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.array([*ids_of(t.as_py() or "", vocab), END], dtype="<u4")
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), window):
                    n = min(window, len(ids) - s)
                    row.append(i), start.append(s), length.append(n), tokens.append(len(ids))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def solve(hist: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin ||A x - hist||, x >= 0, by accelerated projected gradients; a column of A counts the lengths of a combo.

    ``combos`` has three lengths a row; length 0 stands for none.
    """
    n = len(hist)

    def times(x):
        out = sum(np.bincount(combos[:, j], x, n) for j in range(combos.shape[1]))
        out[0] = 0
        return out

    target = hist.astype(float)
    target[0] = 0
    x = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A
        y = times(x)
        x = sum(y[combos[:, j]] for j in range(combos.shape[1]))
        scale = np.linalg.norm(x)
        x /= scale
    step, x = 1 / scale, np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        r = times(y) - target
        r[0] = 0
        new = np.maximum(0, y - step * sum(r[combos[:, j]] for j in range(combos.shape[1])))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(hist: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such) that use up the histogram exactly."""
    left = np.zeros(window + 1, np.int64)
    for k, v in hist.items():
        left[k] = v
    out: dict[tuple[int, ...], int] = {}

    def take(combo: tuple[int, ...], n: int) -> None:
        if n > 0:
            out[combo] = out.get(combo, 0) + n
            for x in combo:
                left[x] -= n

    take((window,), int(left[window]))
    there = np.flatnonzero(left[1:]) + 1
    if len(there):
        a, b = np.meshgrid(there, there, indexing="ij")
        c = window - a - b
        ok = (a >= b) & (b >= c) & (c >= 0)
        ok &= (c == 0) | (left[np.maximum(c, 0)] > 0)
        combos = np.stack([a[ok], b[ok], c[ok]], 1)
        if len(combos):
            x = solve(left, combos)
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 1:
                    break
                combo = tuple(int(v) for v in combos[i] if v)
                most = min(int(left[v]) // combo.count(v) for v in set(combo))
                take(combo, min(int(x[i]), most))
    # the residuals: best fit, longest first, on counts
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for x in range(window, 0, -1):
        n = int(left[x])
        left[x] = 0
        while n:
            space = min((s for s in bins if s >= x), default=None)
            if space is None:
                k = window // x
                q, r = divmod(n, k)
                for combo, count in (((x,) * k, q), ((x,) * r, int(r > 0))):
                    if count:
                        d = bins.setdefault(window - x * len(combo), {})
                        d[combo] = d.get(combo, 0) + count
                break
            combo, count = next(iter(bins[space].items()))
            use = min(n, count)
            d = bins[space]
            d[combo] -= use
            if not d[combo]:
                del d[combo]
            if not d:
                del bins[space]
            d = bins.setdefault(space - x, {})
            d[(*combo, x)] = d.get((*combo, x), 0) + use
            n -= use
    for d in bins.values():
        for combo, count in d.items():
            out[combo] = out.get(combo, 0) + count
    return sorted(out.items())


def slots(layout: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where ranks begin that share a slot, the first sequence of these, and the offset there."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for combo, count in layout:
        offset = 0
        for x in combo:
            found.setdefault(x, []).append((used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + count
            offset += x
        base += count
    return {x: tuple(np.array(v, np.int64) for v in zip(*rows, strict=True)) for x, rows in found.items()}


def pack(docs: DataFrame, vocab: tuple | None = None, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id offset`` to ``pieces``."""
    p = common.materialize(pieces(docs, vocab, window), "pieces")
    bins = p.groupBy("length").count()
    hist = {int(r["length"]): int(r["count"]) for r in bins.collect()}  # at most ``window`` rows
    where = docs.sparkSession.sparkContext.broadcast(slots(plan(hist, window)))
    counts = docs.sparkSession.createDataFrame(sorted(hist.items()), "length long, _rows long")
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    p = p.withColumn("_key", F.shiftrightunsigned(key, 1)).join(F.broadcast(counts), "length").withColumn("_one", F.lit(1))
    p = common.before(p, "length", F.shiftright("_key", 39), F.col("_rows"), ["_key", "doc_id", "start"], "_one", "_rank")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = p.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for b in batches:
            size, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size):
                begin, base, offset = where.value[int(x)]
                at = np.flatnonzero(size == x)
                k = np.searchsorted(begin, rank[at], "right") - 1
                seq[at], off[at] = base[k] + rank[at] - begin[k], offset[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=schema.names)

    return p.select(*names, "_rank").mapInArrow(run, schema)
