"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens that go with a label; rules pruned by support, confidence and lift
are looked up through an inverted index from token to rules. Listed rules for hosts and paths come first.

Built-in functions only. Mining sees a bounded sample of labelled pages, judging sees every URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens and no listed rule, and is
allowed; repeated rows and null ids are rows like others; an empty table, or no labels, mines no rule; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
LISTED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LABEL = "!block"


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host path`` and the rest of the URL as ``_tail``."""
    cols = df.columns
    at = F.locate("://", F.col(url))
    d = df.select(*cols, F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("").alias("_rest"))
    d = d.select(*cols, F.coalesce("_rest", F.lit("")).alias("_rest"))
    return d.select(
        *cols, F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("_rest", r"^[^?#]*((?s).*)$", 1).alias("_tail"),
    )


def tokens() -> Column:
    """What a URL's parts say, each thing once: host and its suffixes, path segments, query keys, a fragment; digits count as one kind."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: F.length(s) > 0), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "0")))
    keys = F.transform(F.filter(F.split(F.regexp_extract("_tail", r"^\?([^#]*)", 1), "&"), lambda s: F.length(s) > 0), lambda s: F.concat(F.lit("q:"), F.regexp_extract(s, "^[^=]*", 0)))
    mark = F.when(F.contains("_tail", F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, segments, keys, mark)))


def mined(pages: DataFrame, labels: DataFrame, max_pages: int = 50_000, support: float = 0.002, confidence: float = 0.6, lift: float = 2.0) -> DataFrame:
    """``tokens confidence support``: rules from labelled pages (``labels``: page_id, bad); the sample has about
    ``max_pages`` of them, by a hash of the id.

    All rules that pass support, confidence and lift stay, but for those that a shorter one implies.
    """
    known = labels.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    share = min(1.0, max_pages / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    items = F.concat(tokens(), F.when(F.col("bad"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>")))
    baskets = with_parts(pages.select("page_id", "url").join(known, "page_id")).select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    return minimal(model.associationRules.filter((F.element_at("consequent", 1) == LABEL) & (F.col("lift") >= lift)))


def mine(*args, **options) -> list[Rule]:
    """The rules of ``mined`` as a list, the surest first."""
    found = (Rule(tuple(r["tokens"]), float(r["confidence"]), float(r["support"])) for r in mined(*args, **options).collect())
    return sorted(found, key=lambda r: (-r.confidence, -r.support, r.tokens))


def minimal(rules: DataFrame) -> DataFrame:
    """``tokens confidence support`` of the rules whose antecedent holds no other one's: by size, shortest first."""
    rest = common.materialize(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    out = rest.limit(0)
    while (n := rest.agg(F.min(F.size("tokens"))).first()[0]) is not None:
        level = rest.filter(F.size("tokens") == n)
        out = out.unionByName(level)  # none implies another of them
        held = rest.select("tokens", F.explode("tokens").alias("t")).join(level.select(F.col("tokens")[0].alias("t"), F.col("tokens").alias("part")), "t")
        held = held.filter(F.size(F.array_except("part", "tokens")) == 0).select("tokens").distinct()
        rest = common.materialize(rest.join(held, "tokens", "left_anti"), "rules")
    return out


def matched(d: DataFrame, rules: DataFrame) -> DataFrame:
    """``_url``: the URLs of ``d`` (``_url _tokens``) that hold all tokens of some rule.

    The inverted index has a row for each rule and token of it; the URLs' tokens join it, and a rule is held whose tokens
    all came. URLs without a token of any rule end at that join.
    """
    index = rules.select(F.array_join(F.array_sort("tokens"), " ").alias("rule"), F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    hits = d.select("_url", F.explode("_tokens").alias("token")).join(index, "token").distinct()
    return hits.groupBy("_url", "rule", "need").agg(F.count("*").alias("n")).filter("n = need").select("_url").distinct()


def judge(pages: DataFrame, rules: DataFrame | list[Rule], listed: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``page_id host path rule verdict``: the longest listed rule that fits rules, else the mined ones."""
    listed = LISTED if listed is None else listed
    if isinstance(rules, list):
        rules = pages.sparkSession.createDataFrame([(list(r.tokens), r.confidence, r.support) for r in rules], "tokens array<string>, confidence double, support double")
    d = with_parts(pages.select("page_id", "url"))
    hits = matched(d.select(F.col("url").alias("_url"), tokens().alias("_tokens")), rules)
    d = d.join(hits, F.col("url") == F.col("_url"), "left").select("page_id", "host", "path", F.col("_url").isNotNull().alias("_hit"))
    rule = verdict = None
    for v, h, p in sorted(listed, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    mined = F.when(F.col("_hit"), "block").otherwise("allow")
    if rule is None:
        return d.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), mined.alias("verdict"))
    return d.select("page_id", "host", "path", rule.alias("rule"), verdict.otherwise(mined).alias("verdict"))
