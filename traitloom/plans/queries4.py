"""Queries that write the study's reads, variants and counts in binary files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads as R
from ..sources import bam, doubles, store, tabix
from . import queries3
from .queries2 import LEN
from .queries import ORACLE, QUERIES, query, sql

__all__ = ["ORACLE", "QUERIES", "queries3"]

#: A region of the study that alignments and variants overlap.
REGION = ("chr1", 4000, 8000)


def references(s):
    """Names and lengths of the study's chromosomes: a row each."""
    d = s.variants().groupBy("chrom").agg((F.max("pos") + 1_000_000).alias("n"))
    return [(r["chrom"], r["n"]) for r in d.orderBy(F.length("chrom"), "chrom").collect()]


def as_bam(s) -> str:
    """Alignments in sorted files with indexes; the sample is a tag."""
    path = store.scratch(s.spark, "bam")
    bam.write(s.alignments().withColumn("tags", F.concat("tags", F.array(F.concat(F.lit("RG:Z:"), F.col("sample_ix").cast("string"))))), path, references(s))
    return path


def with_sample(d):
    return d.withColumn("sample_ix", F.try_element_at(R.tag_map(F.col("tags")), F.lit("RG")).cast("bigint"))


FIELDS = "qname, mate, flag, chrom, pos, mapq, cigar, rnext, pnext, tlen, seq, sample_ix"


@query(sql(f"SELECT {FIELDS}, array_to_string(tags, ' ') || ' RG:Z:' || sample_ix AS tags FROM alignments"))
def bam_scan(s):
    d = with_sample(bam.read(s.spark, as_bam(s), partition_bytes=8 << 20))
    return d.select(*FIELDS.split(", "), F.array_join("tags", " ").alias("tags"))


@query(sql(f"SELECT {FIELDS} FROM alignments WHERE chrom = '{REGION[0]}' AND pos <= {REGION[2]} AND pos + {LEN.format('cigar')} - 1 >= {REGION[1]} AND (flag & 256) = 0"))
def bam_region(s):
    """Alignments without secondary ones that overlap a region, by the files' indexes."""
    return with_sample(bam.read(s.spark, as_bam(s), REGION, exclude=256)).select(*FIELDS.split(", "))


CELLS = "SELECT variant_ix, string_agg(cell, chr(9) ORDER BY sample_ix) AS cells FROM cells GROUP BY variant_ix"


@query(sql(f"SELECT variant_id, pos, ref, alt, info, format, cells FROM records JOIN l USING (variant_ix) WHERE chrom = '{REGION[0]}' AND pos <= {REGION[2]} AND pos + length(ref) - 1 >= {REGION[1]}", l=CELLS))
def variant_region(s):
    """Variant records that overlap a region, by the files' indexes."""
    from ..sources import vcf

    cells = s.cells().groupBy("variant_ix").agg(F.array_sort(F.collect_list(F.struct("sample_ix", "cell"))).alias("c"))
    d = s.records().join(cells, "variant_ix")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "variant_id", "ref", "alt", F.lit("."), F.lit("PASS"), "info", "format", F.array_join(F.transform("c", lambda x: x["cell"]), "\t"))
    path = store.scratch(s.spark, "variants")
    tabix.write(d.select("chrom", "pos", line.alias("value")), path, ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{i}" for i in range(25))])])
    return vcf.records(s.spark, path, REGION).select("variant_id", "pos", "ref", "alt", "info", "format", F.array_join("cells", "\t").alias("cells"))


def as_doubles(s) -> str:
    """Counts, features by samples: a row of 25 a feature."""
    d = s.counts().groupBy("feature_ix").agg(F.map_from_entries(F.collect_list(F.struct("sample_ix", "y"))).alias("m"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0)).cast("double"))
    path = store.scratch(s.spark, "counts")
    doubles.write(d.select(F.col("feature_ix").alias("row"), cell.alias("values")), path, 25)
    return path


MATRIX = "SELECT row_number() OVER (ORDER BY feature_ix) - 1 AS \"row\", feature_ix FROM (SELECT DISTINCT feature_ix FROM counts)"
DENSE = "SELECT \"row\", m.feature_ix, r.n AS sample_ix, coalesce(y, 0)::DOUBLE AS value FROM m CROSS JOIN range(25) r(n) LEFT JOIN counts c ON c.feature_ix = m.feature_ix AND c.sample_ix = r.n"


@query(sql('SELECT "row", sample_ix, value FROM dense', m=MATRIX, dense=DENSE))
def binary_matrix(s):
    """All counts, by byte ranges of the parts."""
    return doubles.long_form(doubles.read(s.spark, as_doubles(s), 25, partition_bytes=64 << 10))


@query(sql('SELECT "row", sample_ix, value FROM dense WHERE feature_ix IN (SELECT feature_ix FROM counts GROUP BY feature_ix HAVING sum(y) = (SELECT max(t) FROM (SELECT sum(y) AS t FROM counts GROUP BY feature_ix)))', m=MATRIX, dense=DENSE))
def binary_row_seek(s):
    """The features with the most reads: their rows alone are fetched."""
    t = s.counts().groupBy("feature_ix").agg(F.sum("y").alias("t"))
    most = [r["feature_ix"] for r in t.join(F.broadcast(t.agg(F.max("t").alias("t"))), "t").collect()]  # one, or those that tie
    rows = t.agg(*(F.count_if(F.col("feature_ix") < f) for f in most)).first()
    return doubles.long_form(doubles.read(s.spark, as_doubles(s), 25, list(rows)))
