"""Positions of regular-expression matches with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix sums append within blocks of so many matches, and over blocks: linear in practice for any number of them.
BLOCK = 512


def prefix_sums(xs: Column) -> Column:
    """Running totals of an array of bigint."""
    zero = F.array().cast("array<bigint>")

    def run(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK)).cast("int")), lambda c: run(F.slice(xs, c * BLOCK + 1, BLOCK)))
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<array<bigint>>").alias("a")),
        lambda acc, b: F.struct((acc["t"] + F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))).alias("t"), F.array_append(acc["a"], F.transform(b, lambda v: v + acc["t"])).alias("a")),
    )
    return F.flatten(joined["a"])


def folded(xs: Column, state: Column, kind: str, step) -> Column:
    """What ``step(state, x)``, a struct of ``state`` and ``out``, gives for each x in turn: the array of all ``out``, of type ``kind``.

    As in ``prefix_sums`` blocks are appended to blocks, so long arrays take linear time in practice.
    """
    none = F.array().cast(f"array<{kind}>")

    def block(c: Column, begin: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return F.transform(F.array(step(acc["state"], x)), lambda s: F.struct(s["state"].alias("state"), F.array_append(acc["out"], s["out"]).alias("out")))[0]

        return F.aggregate(F.slice(xs, c * BLOCK + 1, BLOCK), F.struct(begin.alias("state"), none.alias("out")), one)

    first = F.array(F.struct(state.alias("state"), none.alias("out")))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK)).cast("int"))
    done = F.aggregate(numbers, first, lambda acc, c: F.array_append(acc, block(c, F.element_at(acc, -1)["state"])))
    return F.flatten(F.transform(done, lambda b: b["out"]))


#: Code points of a piece of ``cut``.
PIECE = 1024


def cut(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points: ``within`` finds a place in it without going over the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def within(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to before ``end`` of a text that was cut; places beyond it are none."""
    first, last = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    from_, to = (begin % PIECE).cast("int"), (end % PIECE).cast("int")
    at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    several = F.concat(F.substring(at(first), from_ + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(at(last), F.lit(1), to))
    return F.when(first == last, F.substring(at(first), from_ + 1, to - from_)).otherwise(several)


def matches(df: DataFrame, text: str, rules: dict[str, tuple[str, int]], guards: dict[str, Column] | None = None) -> DataFrame:
    """Add for each rule, named by its key, an array of (start, end, text, part): its leftmost non-overlapping matches.

    A rule is a pattern that never matches the empty string, and the group that ``part`` shows. Offsets count code
    points, ``end`` is exclusive. Where a guard is false the rule is not run. A null text has no matches.

    The text is split by the pattern; lengths of what lies between and of the matches, summed, are the positions.
    Each step is a projection of its own, so that no regular expression runs twice.
    """
    guards = guards or {}
    none = F.array().cast("array<string>")
    keep = df.columns
    t = F.col(text)
    step = df
    found = [F.coalesce(F.when(guards.get(k, F.lit(True)), F.regexp_extract_all(t, F.lit(p), 0)), none).alias(f"_m_{k}") for k, (p, _) in rules.items()]
    step = step.select(*keep, *found)
    some = {k: F.size(f"_m_{k}") > 0 for k in rules}
    step = step.select(
        *keep,
        *(f"_m_{k}" for k in rules),
        *(F.when(some[k], F.split(t, p, -1)).alias(f"_p_{k}") for k, (p, _) in rules.items()),
        *(F.when(some[k], F.regexp_extract_all(t, F.lit(p), g)).alias(f"_g_{k}") for k, (p, g) in rules.items() if g),
    )

    def lengths(k: str) -> Column:
        return F.transform(f"_m_{k}", lambda m, i: (F.char_length(m) + F.char_length(F.col(f"_p_{k}")[i])).cast("bigint"))

    step = step.select(*step.columns, *(F.when(some[k], prefix_sums(lengths(k))).alias(f"_e_{k}") for k in rules))
    kind = "array<struct<start:bigint,end:bigint,text:string,part:string>>"

    def spans(k: str, group: int) -> Column:
        def one(m: Column, i: Column) -> Column:
            end = F.col(f"_e_{k}")[i]
            return F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("text"), (F.col(f"_g_{k}")[i] if group else m).alias("part"))

        return F.when(some[k], F.transform(f"_m_{k}", one)).otherwise(F.array().cast(kind)).alias(k)

    return step.select(*keep, *(spans(k, g) for k, (_, g) in rules.items()))


def listing(kinds: list[str]) -> Column:
    """``kind:start:end`` of the arrays in the columns ``kinds``, by start, then in the order of ``kinds``, joined by commas."""

    def tagged(i: int, k: str) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(k).alias("kind")))

    every = F.concat(*(tagged(i, k) for i, k in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
