"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built-in functions only. Spans of the base kinds stay as their pattern and condition find them, with a score; the other
kinds need a valid checksum or context to reach ``LEAST``. An account number may be printed in groups of four: a word of
four capitals or digits right after such a number reads as one more group and fails the checksum. Offsets count code
points of the whole text, end exclusive.

Patterns that could rescan a long run start only where a run starts or where the last match ended, and repeat groups
without backtracking: the matches are the same, the time is linear.

Defined cases: a null or empty text has no spans; repeated rows and null ids are rows like others; any length of text;
an empty table gives an empty table; columns of other names pass through where asked for, whatever they are called in
``redact``; in ``detect`` those that are named like a kind are an error.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native

LOCAL = "A-Za-z0-9._%+-"
BASE: dict[str, tuple[str, int]] = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", 0),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0),
}
MORE: dict[str, tuple[str, int]] = {
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]+|(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?)", 0),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0),
}
KINDS = [*BASE, *MORE]
#: Words near a span that speak for its kind.
CONTEXT = {"email": ["mail", "contact"], "ip": ["ip ", "address", "host"], "card": ["card", "credit", "visa"], "phone": ["phone", "tel", "call"], "iban": ["iban", "account", "bank"], "ssn": ["ssn", "social"]}
#: What pattern and condition alone are worth.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
NEAR = 40
BOOST = 0.3
LEAST = 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum of payment cards."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes its checksum: the country and check digits go last, letters count from 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + (c - 48)).otherwise(rest * 100 + (c - 55)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s["text"], r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = digits(s["text"])
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(s["text"])).between(9, 15)
    if kind == "iban":
        bare = F.translate(s["text"], " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def scored(kind: str, pieces: Column, s: Column) -> Column:
    """A span with its score: the prior, more if a context word is within ``NEAR`` code points before or after it."""
    around = F.lower(native.within(pieces, F.greatest(F.lit(0), s["start"] - NEAR), s["end"] + NEAR))
    near = F.exists(F.array(around), lambda x: reduce(or_, (F.contains(x, F.lit(w)) for w in CONTEXT[kind])))
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.lit(PRIOR[kind]) + F.when(near, BOOST).otherwise(0.0)).alias("score"))


def spans(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``_row``, a struct of the columns ``keep``, and for each kind ``_s_<kind>``: an array of (start, end, score)."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.col(text).alias("_text"))
    guards = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+")), "ssn": F.contains("_text", F.lit("-"))}
    m = native.matches(d, "_text", BASE | MORE, guards)
    m = m.select("_row", "_text", *(F.filter(k, partial(valid, k)).alias(k) for k in KINDS))
    some = reduce(or_, (F.size(k) > 0 for k in KINDS))
    m = m.select("_row", *KINDS, F.when(some, native.cut(F.col("_text"))).alias("_cut"))
    m = m.select("_row", *(F.transform(k, partial(scored, k, F.col("_cut"))).alias(k) for k in KINDS))
    return m.select("_row", *((F.col(k) if k in BASE else F.filter(k, lambda s: s["score"] >= LEAST)).alias(f"_s_{k}") for k in KINDS))


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` and a column for each kind: an array of (start, end, score)."""
    keep = ["doc_id"] if keep is None else keep
    if clash := set(keep) & set(KINDS):
        raise ValueError(f"columns named like kinds: {sorted(clash)}")
    return spans(docs, keep, "text").select(*(F.col("_row")[c].alias(c) for c in keep), *(F.col(f"_s_{k}").alias(k) for k in KINDS))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; of overlapping spans the first rules.

    ``n_chars`` follows the text where there is such a column.
    """
    cols = docs.columns
    d = spans(docs, cols, "text")

    def tagged(i: int, k: str) -> Column:
        return F.transform(f"_s_{k}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(f"<{k}>").alias("tag")))

    every = F.array_sort(F.concat(*(tagged(i, k) for i, k in enumerate(KINDS))))
    d = d.select("_row", every.alias("_spans"))

    # the spans that begin after the last one kept, each with the end of that one
    def step(at: Column, s: Column) -> Column:
        free = s["start"] >= at
        out = F.when(free, F.struct(at.alias("from"), s["start"].alias("to"), s["end"].alias("end"), s["tag"].alias("tag")))
        return F.struct(F.when(free, s["end"]).otherwise(at).alias("state"), out.alias("out"))

    kind = "struct<from:bigint,to:bigint,end:bigint,tag:string>"
    kept = F.filter(native.folded(F.col("_spans"), F.lit(0).cast("bigint"), kind, step), lambda x: x.isNotNull())
    some, whole = F.size("_spans") > 0, F.col("_row")["text"]
    d = d.select("_row", F.when(some, kept).alias("_kept"), F.when(some, native.cut(whole)).alias("_cut"))
    before = F.array_join(F.transform("_kept", lambda x: F.concat(native.within(F.col("_cut"), x["from"], x["to"]), x["tag"])), "")
    rest = native.within(F.col("_cut"), F.element_at("_kept", -1)["end"], F.length(whole).cast("bigint"))
    d = d.select("_row", F.when(F.col("_kept").isNull(), whole).otherwise(F.concat(before, rest)).alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return d.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in cols))
