import random

import pytest

from traitloom.llm import jaccard

SCHEMA = "doc_id long, text string, node long, n long, f1 string"


def brute(docs, k, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed):
    """Groups of edited copies, chains, shared passages, frequent word runs, short texts and copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 3)))
    passage = [word() for _ in range(30)]
    docs = ["", None, "  \t", "one", "ONE", "one two", "one\ttwo", "one two three"]
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([12, 40, 90, 150]))]
        for e in range(rnd.choice([3, 12])):
            w = list(base)
            for _ in range(rnd.randint(0, 1 + e // 2)):
                w[rnd.randrange(len(w))] = word()
            docs.append(" ".join(w))
    for _ in range(15):
        own = [word() for _ in range(rnd.randint(0, 12))]
        docs.append(" ".join(passage + own if rnd.random() < 0.5 else own + passage))
    chain = [word() for _ in range(60)]
    for i in range(8):
        docs.append(" ".join(chain[i : i + 52]))
    docs += docs[8:14]
    rnd.shuffle(docs)
    return list(enumerate(docs, 100))


@pytest.mark.parametrize(("seed", "k", "percent", "rare"), [(1, 4, 85, 8), (2, 2, 70, 1), (3, 3, 80, 2), (4, 1, 85, 1), (5, 5, 80, 0)])
def test_components_are_those_of_all_pairs(spark, seed, k, percent, rare):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], SCHEMA)
    got = jaccard.link(df, k, percent, rare=rare, bins=1 << 14)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(docs, k, percent)


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "x y z q"), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df, 4, 85, bins=1 << 14).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (None, 1, None), (3, 0, 3)], key=str)


def test_empty_table(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string"), 4, 85, bins=1 << 14).count() == 0


def test_one_of_each_group_stays(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until night"
    df = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (2, text, "en"), (3, "other words here", "en"), (3, "other words here", "en"), (4, "", "en"), (5, None, "en"), (None, text, "en")], "doc_id long, text string, lang string")
    got = jaccard.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([1, 3, 4, 5], key=str)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    word = lambda c: [c + str(i) for i in range(60)]
    near = lambda c, n: " ".join(word(c) + [f"end{n}"])
    rows = [
        (1, near("a", 0)), (None, near("a", 1)), (None, near("b", 0)),  # a null id linked to an id, and a clean one
        (None, near("c", 0)), (None, near("c", 1)), (None, near("c", 1)),  # near copies without ids
        (7, near("d", 0)), (7, near("d", 1)),  # near copies that share an id
        (9, near("e", 0)), (9, near("a", 2)),  # an id with a clean text and a near copy
        (None, ""), (None, ""), (None, None), (3, " "), (3, " "),
    ]
    got = [(r["doc_id"], r["text"]) for r in jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    first = lambda c: sorted({str(d) for d, t in got if t and t.startswith(f"{c}0 ")})
    assert [first(c) for c in "abcde"] == [["1"], ["None"], ["None"], ["7"], ["9"]]
    assert sorted((g for g in got if not (g[1] or "").strip()), key=str) == sorted(rows[-5:], key=str)
    assert len(got) == 5 + 5
