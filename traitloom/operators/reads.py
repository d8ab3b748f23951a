"""Aligned reads: flags, tags, quality control, pairing, CIGAR arithmetic and allele counting, all as expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .intervals import bins

MISSING = 10_000_000
OPS = r"([0-9]+)([MIDNSHPX=])"


@dataclass(frozen=True)
class Quality:
    """Limits of read quality; ``skip_missing`` fails reads without a tag, else a missing tag passes."""

    min_mapq: int = 10
    min_insert: int = 1
    max_insert: int = 270_000_000
    max_mismatch: int = 3
    max_gap: int = 0
    max_best: int = 1
    skip_missing: bool = False
    best_hits_from_tag: bool = False


#: Insert sizes by assay.
INSERTS = {"atac": (37, 10_000), "rna": (37, 2_473_537), "other": (1, 270_000_000)}


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def tag_map(tags: Column) -> Column:
    """Tags such as XM:i:3 as a map from name to the last part."""
    return F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2), F.substring_index(t, ":", -1))))


def tag_value(tags: Column, name: str, limit: int, q: Quality) -> Column:
    """A tag's number; where it is missing, the limit itself or a number beyond any limit."""
    return F.coalesce(F.try_element_at(tag_map(tags), F.lit(name)).try_cast("int"), F.lit(MISSING if q.skip_missing else limit))


def tags_pass(q: Quality) -> Column:
    t = F.col("tags")
    best = tag_value(t, "X0", q.max_best, q) if q.best_hits_from_tag else F.lit(q.max_best)
    return (tag_value(t, "XM", q.max_mismatch, q) <= q.max_mismatch) & (tag_value(t, "XO", q.max_gap, q) <= q.max_gap) & (best <= q.max_best)


def passes_single(q: Quality) -> Column:
    return (F.col("mapq") >= q.min_mapq) & tags_pass(q)


def passes_paired(q: Quality) -> Column:
    """Also insert size, same chromosome, and opposite strands with the forward one left."""
    back, mate_back = has(F.col("flag"), 16), has(F.col("flag"), 32)
    facing = (~back & mate_back & (F.col("pos") <= F.col("pnext"))) | (back & ~mate_back & (F.col("pnext") <= F.col("pos")))
    return passes_single(q) & F.abs("tlen").between(q.min_insert, q.max_insert) & (F.col("rnext") == "=") & facing


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op)."""
    n, op = F.regexp_extract_all(cigar, F.lit(OPS), 1), F.regexp_extract_all(cigar, F.lit(OPS), 2)
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("op")))


def ref_length(cigar: Column) -> Column:
    """Reference bases that an alignment spans."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, o: s + F.when(o["op"].isin(*"MDNP=X"), o["n"]).otherwise(0))


def truncate(start: Column, cigar: Column, seq: Column, stop: Column) -> Column:
    """Struct (cigar, seq) of an alignment from ``start`` cut before reference position ``stop``."""
    first = F.struct(start.cast("bigint").alias("at"), F.lit(0).alias("read"), F.lit("").alias("cigar"), F.lit(-1).alias("cut"))

    def step(a: Column, o: Column) -> Column:
        on_ref, on_read = o["op"].isin(*"MDNP=X"), o["op"].isin(*"MISH=X")
        inside = on_ref & (a["at"] + o["n"] > stop)
        room = (stop - a["at"]).cast("int")
        both = o["op"].isin(*"M=X")
        kept = F.when(room > 0, F.concat(a["cigar"], room.cast("string"), o["op"])).otherwise(a["cigar"])
        cut = F.struct(stop.cast("bigint").alias("at"), a["read"].alias("read"), kept.alias("cigar"), (a["read"] + F.when(both, room).otherwise(0)).alias("cut"))
        go = F.struct(
            (a["at"] + F.when(on_ref, o["n"]).otherwise(0)).alias("at"), (a["read"] + F.when(on_read, o["n"]).otherwise(0)).alias("read"),
            F.concat(a["cigar"], o["n"].cast("string"), o["op"]).alias("cigar"), F.lit(-1).alias("cut"),
        )
        return F.when(a["cut"] >= 0, a).when(inside, cut).otherwise(go)

    end = F.aggregate(cigar_ops(cigar), first, step)
    return F.struct(end["cigar"].alias("cigar"), F.when(end["cut"] >= 0, F.substring(seq, F.lit(1), end["cut"])).otherwise(seq).alias("seq"))


def pair(alignments: DataFrame, q: Quality) -> DataFrame:
    """Fragments ``qname chrom left right cigar seq`` of mates, one at least of which passes.

    Mates are rows of one name whose template lengths are opposite, next to each other by position. A gap between them
    becomes a skip; where they overlap the left one is cut at the start of the right one.
    """
    a = alignments.filter(~has(F.col("flag"), 256)).withColumn("pass", passes_paired(q))
    w = Window.partitionBy("chrom", "qname").orderBy("pos", "mate")
    before = F.lag(F.struct("pos", "tlen", "cigar", "seq", "pass")).over(w)
    p = a.withColumn("l", before).filter(F.col("l.tlen").isNotNull() & (F.col("l.tlen") == -F.col("tlen")) & (F.col("l.pass") | F.col("pass")))
    gap = F.col("pos") - F.col("l.pos") - ref_length(F.col("l.cigar"))
    p = p.withColumn("gap", gap).withColumn("cut", F.when(F.col("gap") < 0, truncate(F.col("l.pos"), F.col("l.cigar"), F.col("l.seq"), F.col("pos"))).otherwise(F.struct(F.col("l.cigar").alias("cigar"), F.col("l.seq").alias("seq"))))
    skip = F.when(F.col("gap") > 0, F.concat(F.col("gap").cast("string"), F.lit("N"))).otherwise("")
    return p.select("qname", "sample_ix", "chrom", F.col("l.pos").alias("left"), (F.col("l.pos") + F.abs("tlen") - 1).alias("right"), F.concat("cut.cigar", skip, "cigar").alias("cigar"), F.concat("cut.seq", "seq").alias("seq"))


def single(alignments: DataFrame, q: Quality) -> DataFrame:
    """Fragments of single reads; a leading ``chr`` goes from the name."""
    a = alignments.filter(~has(F.col("flag"), 256) & passes_single(q))
    chrom = F.when(F.startswith("chrom", F.lit("c")), F.expr("substring(chrom, 4)")).otherwise(F.col("chrom"))
    return a.select("qname", "mate", chrom.alias("chrom"), F.col("pos").alias("left"), (F.col("pos") + ref_length(F.col("cigar")) - 1).alias("right"), "cigar", "seq")


def blocks(fragments: DataFrame) -> DataFrame:
    """A row for each matching block: ``start end`` on the reference, ``read`` its first base in ``seq`` (0-based)."""
    first = F.struct(F.col("left").cast("bigint").alias("at"), F.lit(0).alias("read"), F.array().cast("array<struct<start:bigint,end:bigint,read:int>>").alias("out"))

    def step(a: Column, o: Column) -> Column:
        match = o["op"].isin(*"M=X")
        on_ref, on_read = o["op"].isin(*"MDNP=X"), o["op"].isin(*"MISH=X")
        block = F.struct(a["at"].alias("start"), (a["at"] + o["n"] - 1).alias("end"), a["read"].alias("read"))
        return F.struct(
            (a["at"] + F.when(on_ref, o["n"]).otherwise(0)).alias("at"), (a["read"] + F.when(on_read, o["n"]).otherwise(0)).alias("read"),
            F.when(match, F.array_append(a["out"], block)).otherwise(a["out"]).alias("out"),
        )

    out = F.aggregate(cigar_ops(F.col("cigar")), first, step)["out"]
    return fragments.select("*", F.posexplode(out).alias("block", "b")).select("*", "b.start", "b.end", "b.read").drop("b")


def covered(fragments: DataFrame, markers: DataFrame, width: int = 512) -> DataFrame:
    """A row for each countable marker inside a matching block, with the base read there.

    ``markers``: chrom, pos, variant_id, a1, a2; those coded 0 are not countable.
    """
    b = blocks(fragments).withColumn("_bin", bins(F.col("start"), F.col("end"), width)).withColumnRenamed("chrom", "_chrom")
    m = markers.filter("a1 <> '0'").withColumn("_b", F.floor(F.col("pos") / width))
    on = (b["_chrom"] == m["chrom"]) & (b["_bin"] == m["_b"]) & F.col("pos").between(F.col("start"), F.col("end"))
    base = F.substring(F.col("seq"), (F.col("read") + F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1))
    return b.join(m, on).select("qname", "sample_ix", "block", "chrom", "pos", "variant_id", "a1", "a2", base.alias("base"))


def allele_counts(cover: DataFrame, *more: str) -> DataFrame:
    """Reference, alternative and other reads of each marker (and of ``more``)."""
    ref, alt = F.col("base") == F.col("a1"), F.col("base") == F.col("a2")
    return cover.groupBy("chrom", "pos", "variant_id", *more).agg(F.count_if(ref).alias("n_ref"), F.count_if(~ref & alt).alias("n_alt"), F.count_if(~ref & ~alt).alias("n_other"))


def expected_dosage(cover: DataFrame) -> DataFrame:
    """Each covering block counts one over the number of its fragment's blocks that hold a marker."""
    cover = store.written(cover.select("qname", "block", "chrom", "pos", "variant_id"), "cover")  # pairing and blocks once
    n = cover.groupBy("qname").agg(F.count_distinct("block").alias("_n"))
    return cover.join(n, "qname").groupBy("chrom", "pos", "variant_id").agg(F.sum(1.0 / F.col("_n")).alias("ds"))


def overlapping(fragments: DataFrame, markers: DataFrame, anti: bool = False, width: int = 512) -> DataFrame:
    """Fragments with a countable marker in a matching block, or those without. They are paired once and written."""
    fragments = store.written(fragments, "fragments")
    return fragments.join(touched(fragments, markers, width), "qname", "left_anti" if anti else "left_semi")


def touched(fragments: DataFrame, markers: DataFrame, width: int = 512) -> DataFrame:
    """``qname`` of the fragments with a countable marker in a matching block, each once."""
    return covered(fragments, markers, width).select("qname").distinct()


def overlap_tally(fragments: DataFrame, markers: DataFrame, width: int = 512) -> DataFrame:
    """How many ``fragments`` there are, and how many are ``overlapping``. They are paired once and written."""
    fragments = store.written(fragments.select("qname", "sample_ix", "chrom", "left", "cigar", "seq"), "fragments")
    hit = touched(fragments, markers, width).withColumn("hit", F.lit(1))
    return fragments.select("qname").join(hit, "qname", "left").agg(F.count("*").alias("fragments"), F.count("hit").alias("overlapping"))
