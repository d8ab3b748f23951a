"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score of the terms in it, the document's
is their noisy-or, and both are trained together from document labels alone; the sentences with the highest
probability are then the offending ones.

Terms are whole words and the first four and six characters of longer words. The ``max_terms`` that tell the classes
apart best by likelihood ratio (``least`` at the least) carry weights (not negative); a sentence with none of them has probability 0, so text
without evidence adds nothing however long it is.

The model is fitted in one task on a bounded sample: about ``max_docs`` labelled documents of at most ``max_chars``
characters, and about ``max_total`` characters together, picked by a hash of the id; the driver gets the weights alone.
Scoring covers every whole text.

Defined cases: null and empty texts score ``leak``, the model's floor; a null id counts as the empty text for the fold
(held out) and never trains; labels repeated for an id count as toxic if one is; of rows that repeat an id the least
text trains; with one class only, all scores are the leak; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SENTENCE = re.compile(r"[.!?\n]+")
TERM = re.compile(r"\w+")


@dataclass
class Model:
    leak: float = 0.01
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def sentences(self, text: str | None) -> list[tuple[float, str]]:
        """The probability of each sentence that has any."""
        out = []
        for s in SENTENCE.split((text or "").lower()):
            hit = terms(s) & self.weights.keys()
            if hit:
                out.append((1 / (1 + math.exp(-self.bias - sum(self.weights[t] for t in hit))), s))
        return out

    def score(self, text: str | None) -> float:
        rest = 1 - self.leak
        w, b = self.weights, self.bias
        for s in SENTENCE.split((text or "").lower()):
            words = TERM.findall(s)
            hit = {t for x in words for t in (x, x[:4], x[:6]) if t in w}
            if hit:
                rest *= 1 / (1 + math.exp(b + sum(w[t] for t in hit)))
        return 1 - rest


def terms(sentence: str) -> set[str]:
    return {t for x in TERM.findall(sentence) for t in (x, x[:4], x[:6])}


def fit(rows: list[tuple[str, int]], max_terms: int = 4096, least: float = 15.0, rounds: int = 300, l1: float = 2e-5) -> Model:
    """Train on (text, label) rows; the order of the rows doesn't matter."""
    rows = sorted({(t or "", int(y)) for t, y in rows})
    n = [sum(1 - y for _, y in rows), sum(y for _, y in rows)]
    if not all(n):
        return Model(leak=float(n[1] > 0) * 0.98 + 0.01)
    # terms of toxic documents first: only those that recur there are counted elsewhere, so memory stays small
    seen = [Counter(), Counter()]
    for text, y in rows:
        if y:
            seen[1].update(terms(text.lower()))
    recur = {t for t, a in seen[1].items() if a >= 3}
    for text, y in rows:
        if not y:
            seen[0].update(terms(text.lower()) & recur)

    def ratio(t: str) -> float:
        a, b = seen[1][t], seen[0][t]
        e = (a + b) / (n[0] + n[1])
        return 2 * sum(x * math.log(x / m) for x, m in ((a, e * n[1]), (b, e * n[0])) if x)

    good = sorted(((-ratio(t), t) for t in recur if ratio(t) >= least and seen[1][t] / n[1] > 3 * seen[0][t] / n[0]))
    index = {t: i for i, (_, t) in enumerate(good[:max_terms])}
    at, feature, doc = [], [], []  # sentence of each term, term, document of each sentence
    for d, (text, _) in enumerate(rows):
        for s in SENTENCE.split(text.lower()):
            if hit := sorted(index[t] for t in terms(s) & index.keys()):
                at.extend([len(doc)] * len(hit))
                feature.extend(hit)
                doc.append(d)
    at, feature, doc = np.array(at, np.int64), np.array(feature, np.int64), np.array(doc, np.int64)
    y = np.array([b for _, b in rows], float)
    w, b, m, v = np.full(len(index), 0.5), -2.0, np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    leak = 0.01
    for step in range(1, rounds + 1):
        z = np.bincount(at, w[feature], len(doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        logq = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + math.log(1 - leak)  # log P(label 0)
        q = np.exp(logq)
        # dL/dz of -y log(1-q) - (1-y) log q, with d logq / dz = -p
        g_doc = np.where(y > 0, q / np.maximum(1 - q, 1e-9), -1.0)
        g_z = -p * g_doc[doc]
        g = np.append(np.bincount(feature, g_z[at], len(index)), g_z.sum()) / len(y)
        g[:-1] += l1
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), min(b - move[-1], -2.0)
    return Model(leak, float(b), {t: float(w[i]) for t, i in index.items() if w[i] > 1e-3})


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, max_chars: int = 20_000, max_total: int = 40_000_000) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = min(1.0, max_docs / max(1, known.count()))
    # about max_docs rows, so it can be broadcast
    known = F.broadcast(known.filter(place < int(share * 1_000_000)))
    some = docs.select("doc_id", "text").filter(F.length("text") <= max_chars).join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    some = common.materialize(some, "sample")
    total = some.agg(F.sum(F.length("text"))).first()[0] or 0
    some = some.filter(place < int(share * min(1.0, max_total / max(1, total)) * 1_000_000))

    def run(batches):
        rows = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(fit(rows)))])], names=["model"])

    # the sample is bounded: one task
    with common.small_batches(docs.sparkSession):
        return Model(**json.loads(some.select("text", "toxic").repartition(1).mapInArrow(run, "model string").first()[0]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (double, 0 to 1) to the columns ``keep`` of ``docs``; a column of that name gives way."""
    keep = ["doc_id"] if keep is None else [c for c in keep if c != "score"]
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("_text"))
            s = pa.array([model.score(t.as_py()) for t in text], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id sentence probability``: the sentences to which the model ascribes the label."""

    def run(batches):
        for b in batches:
            hit = [(i, s.strip(), p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p, s in model.sentences(t) if p >= least]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.string()), pa.array([h[2] for h in hit], pa.float64())], names=["doc_id", "sentence", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence string, probability double")
