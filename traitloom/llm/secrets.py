"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what any match must contain, as an OR of ANDs. The
index lists, for each trigram that some query names, the documents that hold it; a query intersects the postings of
its ANDs and unites the results, and only such candidates are searched with the pattern itself. Rules without a
mandatory trigram search every text. Letters are folded in the index, so it serves rules in either case.

Built-in functions only. Offsets count code points of the whole text, end exclusive.

A pattern that could try a run of its own characters again from each place is run in another form (``LED``) that finds
the same matches in linear time.

Defined cases: a null or empty text has no spans; documents are known to the index by their id: rows that share one
(or a null one) are candidates together, and verified each on its own text; any length of text; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, native

#: Pattern, the group that is measured, the least length of that group.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", 0, 20),
    "pem": (r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0, 20),
}
#: Patterns from the start of a run, whose last group is the match: if the first place in a run where a match could begin
#: fails, so do the later ones in it.
WORD = "[A-Za-z0-9_-]"
LED: dict[str, str] = {"jwt": rf"(?<!{WORD})(?>{WORD}*?(?=eyJ))(eyJ{WORD}{{5,}}+\.{WORD}{{5,}}+\.{WORD}{{5,}}+)"}
BASE = ["assign", "access", "hex"]
KINDS = [*RULES]
#: Alternatives of a part of a pattern that are spelled out; beyond, the part is taken as unknown.
SPELLED = 24
#: Candidates whose ids are broadcast; more are joined by a shuffle.
SMALL = 100_000


def required(pattern: str) -> list[list[str]]:
    """The Boolean trigram query of a pattern: any of these lists holds in full in any match; [[]] if nothing must.

    The pattern is parsed; parts that have few spellings are spelled out and joined with their neighbours, and a run of
    such parts between unknown ones is one clause: an OR over its spellings of all their trigrams.
    """
    parser = re._parser

    def spell(node) -> set[str] | None:
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
                return None
            chars = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            return chars if len(chars) <= 8 else None
        if name == "SUBPATTERN":
            return whole(arg[3])
        if name == "BRANCH":
            each = [whole(x) for x in arg[1]]
            return None if None in each else set().union(*each)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            one = whole(inner)
            if one is None or high == parser.MAXREPEAT or high > 4:
                return None
            return {"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)}
        return None

    def whole(nodes) -> set[str] | None:
        out = {""}
        for n in nodes:
            s = spell(n)
            if s is None or len(out) * len(s) > SPELLED:
                return None
            out = {a + b for a in out for b in s}
        return out

    clauses, run = [], {""}

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            clauses.append([sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(run)])
        run = {""}

    for node in parser.parse(pattern):
        s = spell(node)
        if s is None:
            close()
        elif len(run) * len(s) > SPELLED:
            close()
            run = s
        else:
            run = {a + b for a in run for b in s}
    close()
    best = min(clauses, key=len, default=[[]])
    # further clauses must hold too: with one spelling each they join every list
    extra = [c[0] for c in clauses if c is not best and len(c) == 1]
    full = {frozenset({*x, *(t for e in extra for t in e)}) for x in best}
    return sorted(sorted(x) for x in full if not any(y < x for y in full))  # a list that holds another is implied


def long_enough(least: int, span: Column) -> Column:
    return F.length(span["part"]) >= least


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index ``trigram doc_id`` over the given trigrams, whole texts, letters folded."""
    low = F.lower("text")
    d = docs.select("doc_id", low.alias("_low"))
    hits = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_low"), t))
    return d.select("doc_id", F.explode(hits).alias("trigram"))


def candidates(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``doc_id rules``: for each document the rules whose trigram query it satisfies; rules without one are left out."""
    wanted = [(k, i, t, len(conj)) for k, p in patterns.items() for i, conj in enumerate(required(p)) for t in conj]
    terms = docs.sparkSession.createDataFrame(wanted, "rule string, part int, trigram string, need int")
    postings = index(docs, sorted({w[2] for w in wanted})).distinct()
    # as many rows as the rules have trigrams: a bound that no data changes
    hits = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "rule", "part").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return hits.filter("n = need").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """``doc_id`` and a column for each rule: an array of (start, end, text, part)."""
    rules = RULES if rules is None else rules
    free = {k for k, r in rules.items() if required(r[0]) == [[]]}
    c = common.materialize(candidates(docs, {k: r[0] for k, r in rules.items() if k not in free}), "candidates")
    few = c.count() <= SMALL
    c = c.select(F.col("doc_id").alias("_c"), "rules")
    d = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(c) if few else c, F.col("doc_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    guards: dict[str, Column] = {k: F.coalesce(F.array_contains("rules", k), F.lit(False)) for k in rules if k not in free}
    led = {k: LED[k] for k, r in rules.items() if k in LED and r == RULES[k]}
    m = native.matches(d, "_text", {k: (led[k], 1) if k in led else (p, g) for k, (p, g, _) in rules.items()}, guards)
    own = lambda s: F.struct((s["end"] - F.char_length(s["part"])).alias("start"), s["end"].alias("end"), s["part"].alias("text"), s["part"].alias("part"))
    return m.select("doc_id", *(F.filter(F.transform(k, own) if k in led else F.col(k), partial(long_enough, n)).alias(k) for k, (_, _, n) in rules.items()))
