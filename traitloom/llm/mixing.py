"""Mixing sources to target weights.

Each document gets a hash-random key; within a source the keys are range-sorted, distributed prefix sums of the
token counts run along them, and the cut falls at the source's exact budget. A budget above the source's size takes
whole epochs first.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source of size 0 has target
0; repeated doc_ids are taken as rows of their own; an empty table gives an empty table. Columns other than
``doc_id text source`` play no part and only pass through when asked for by ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row a source: its rank ``sid``, row count, size and target.

    Targets share the sum of all sizes by weight, stop at ``epochs`` times the source's size, and what is above goes to
    the others by weight: the water level L with sum(min(cap, weight * L)) = total. In the order of cap / weight, a
    source is capped as long as its cap is within its share of what the earlier ones left. ``sizes`` has columns
    ``source size``; only sums by source reach the windows here.
    """
    scale = 1
    for x in weights:
        scale *= x
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size").cast("decimal(25,0)") * epochs)
    o = Window.orderBy(F.col("cap") * (F.lit(scale) / F.col("w")).cast("int"), "sid")
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(25,0)"))
    s = s.withColumn("w_left", F.sum("w").over(o.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(12,0)"))
    s = s.withColumn("capped", F.col("cap") * F.col("w_left") <= (F.col("total") - F.col("caps_before")) * F.col("w"))
    left = F.col("total").cast("double") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)).cast("double")
    level = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything).cast("double")
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * left / level))
    return s.select("source", "sid", "rows", "source_size", "target")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row a document: ``doc_id source size source_size target taken`` and the columns of ``carry``; of these, such as
    have one of those names give way.

    ``taken`` counts the words that the mix takes of it: whole epochs, then those before the cut of the last one.
    """
    carry = tuple(c for c in carry if c not in ("doc_id", "source", "size", "source_size", "target", "taken"))
    sized = docs.select("doc_id", "source", common.words_in(F.col("text")).alias("size"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    if not carry:
        sized = common.materialize(sized, "sizes")
    t = common.materialize(targets(sized, weights, epochs), "sources")
    d = sized.withColumnRenamed("source", "_s").join(t.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    d = d.withColumn("budget", F.floor("target")).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
    d = d.withColumn("rest", F.col("budget") - F.col("full") * F.col("source_size"))
    d = d.withColumn("key", F.md5(F.concat_ws(":", F.lit(SEED), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    d = common.before(d, "sid", F.conv(F.substring("key", 1, 6), 16, 10).cast("long"), F.col("rows"), ["key", "doc_id", "size"], "size", "ahead")
    taken = F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return d.select("doc_id", F.col("_s").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"_c_{c}").alias(c) for c in carry))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and of the document at the cut its first words.

    A row for each copy; ``n_chars`` follows the text. Documents of which nothing is taken go.
    """
    m = mix(docs, carry=("text", "lang"))
    copies = F.floor(F.col("taken") / F.col("size"))
    m = m.filter("taken > 0").withColumn("_e", F.explode(F.sequence(F.lit(0), copies - F.when(F.col("taken") % F.col("size") == 0, 1).otherwise(0))))
    part = F.when(F.col("_e") < copies, F.lit(None)).otherwise((F.col("taken") % F.col("size")).cast("int"))
    #  the first words with the white space before them
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    text = F.when(part.isNull(), F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.coalesce(part, F.lit(0))), ""))
    m = m.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return m.select(*(c for c in ("doc_id", "text", "lang", "source", "n_chars")))
