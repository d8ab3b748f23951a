"""The five stages of the pipeline, and toxicity scores, against plain Python on whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_native import luhn
from test_queries import SF

import corpus_pipeline
from traitloom.llm import common, packing, pii, toxicity
from traitloom.llm.queries import QUERIES


def plain_score(model, text):
    """Noisy-or over sentences, from the weights alone: no sentence may be the cause, each with its own probability."""
    free = 1 - model.leak
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        parts = {p for word in re.findall(r"\w+", sentence) for p in (word, word[:4], word[:6])}
        z = [model.weights[p] for p in sorted(parts) if p in model.weights]
        if z:
            free *= 1 - 1 / (1 + math.exp(-(model.bias + sum(z))))
    return 1 - free


def test_scores_are_those_of_plain_python(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    assert model.weights
    want = {i: plain_score(model, t) for i, t in map(tuple, docs.select("doc_id", "text").collect())}
    got = QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (want[r["doc_id"]] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def without_copies(docs):
    """Of documents whose sets of five words overlap by 0.8 or more the smallest id of each linked group."""
    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return [d for d in docs if root(d[0]) == d[0]]


def remainder(number):
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def without_personal_data(text):
    text = text or ""
    near = lambda kind, a, b: any(w in text[max(0, a - 40) : b + 40].lower() for w in pii.CONTEXT[kind])
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    spans += [(m.start(), 4, m.end(), "iban") for m in re.finditer(pii.MORE["iban"][0], text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and remainder(x) == 1]
    spans += [(m.start(), 5, m.end(), "ssn") for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text) if near("ssn", m.start(), m.end())]
    out, at = [], 0
    for a, _, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join(out) + text[at:]


def mixture(docs):
    """(doc_id, text) of the mix: whole copies, and at each source's cut the first words."""
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    sources = defaultdict(list)
    for d in docs:
        sources[d[3]].append(d)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[d[0]] for d in sources[s]) for s in order}
    left, free, target = sum(total.values()), [*order], {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if 3 * total[s] <= weight[s] * level]
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    out = []
    for s in order:
        if not total[s]:
            continue
        epochs = math.floor(target[s]) // total[s]
        rest = math.floor(target[s]) - epochs * total[s]
        for d in sorted(sources[s], key=lambda d: (hashlib.md5(f"mix1:{epochs}:{d[0]}".encode()).hexdigest(), d[0])):
            part = max(0, min(size[d[0]], rest))
            rest -= part
            copies = epochs + (part == size[d[0]])
            out += [(d[0], d[1])] * (copies if size[d[0]] else 0)
            if 0 < part < size[d[0]]:
                out.append((d[0], "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", d[1])[:part])))
    return out


def test_stages_are_those_of_plain_python(spark):
    """Each stage on what the plain version of those before it leaves; then the pieces, and the layout of the sequences."""
    table = common.table(spark, SF, "documents")
    rows = [tuple(r) for r in table.select(*corpus_pipeline.COLUMNS).collect()]
    model = toxicity.train(table, common.table(spark, SF, "labels"))
    rows = [r for r in rows if plain_score(model, r[1]) < 0.5]
    rows = without_copies(rows)
    rows = [(i, t if t is None else without_personal_data(t), *more) for i, t, *more in rows]
    mixed = mixture(rows)
    whole = packing.whole(packing.vocabulary()[3])
    want = Counter()
    for i, t in mixed:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 1024):
            want[i, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    laid = defaultdict(list)
    for r in got:
        laid[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in laid.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
