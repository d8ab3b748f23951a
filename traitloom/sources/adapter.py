"""The star schema's tables in the shapes of the domain: samples, features, variants, genotypes, counts, reads.

Formulae are deterministic in the keys; SQL for another engine builds the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHROM = "concat('chr', cast(1 + cast(floor({0}) as bigint) as string))"
CIGARS = ("75M", "30M200N45M", "20M2I53M", "10S65M")
SPANS = (75, 275, 73, 65)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Study:
    """Lazily built views over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def held(self, kind: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, by name: the place where a study that serves many steps writes it once."""
        return make()

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def samples(self) -> DataFrame:
        return self.raw("nation").selectExpr("cast(n_nationkey as bigint) as sample_ix", "n_name as sample_id")

    def features(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey as feature_ix", "s_name as feature_id", CHROM.format("s_suppkey / 10") + " as chrom", "2000 * s_suppkey + 999 as tss",
            "array(named_struct('start', 2000 * s_suppkey + 100, 'end', 2000 * s_suppkey + 799), named_struct('start', 2000 * s_suppkey + 1200, 'end', 2000 * s_suppkey + 1899)) as exons",
        )

    def exons(self) -> DataFrame:
        return self.features().select("feature_ix", "chrom", F.explode("exons").alias("e")).select("feature_ix", "chrom", "e.start", "e.end")

    def variants(self) -> DataFrame:
        """A row a variant. They meet other tables by shuffles: the size of a compressed file says little about their rows."""
        return self.raw("part").hint("merge").selectExpr(
            "p_partkey as variant_ix", CHROM.format("p_partkey / 200") + " as chrom", "100 * p_partkey + 50 as pos", "concat('rs', cast(p_partkey as string)) as variant_id",
            "case when p_partkey % 37 = 0 then 'AT' else substring('ACGT', cast(1 + p_partkey % 4 as int), 1) end as ref",
            "substring('ACGT', cast(1 + (p_partkey + 1 + p_size % 3) % 4 as int), 1) as alt",
            "case when p_partkey % 10 = 0 then null else (50 + p_partkey % 50) / 100D end as rsq", "p_size",
        )

    def genotypes(self) -> DataFrame:
        """A row a variant and sample: the samples are a fixed panel of 25, so each variant meets all of them.

        The panel is joined rather than exploded, because estimates of size count a join's rows but not an explosion's: the
        rows of all variants would pass for a small table and be sent to the driver. Variants are dealt out before they
        grow, as a small file is read by few tasks.
        """
        v = self.raw("part").select("p_partkey", "p_size").repartition("p_partkey")
        v = v.crossJoin(F.broadcast(self.spark.range(25).withColumnRenamed("id", "n")))
        return v.selectExpr(
            "p_partkey as variant_ix", "n as sample_ix",
            "cast((7 * p_partkey + 13 * n + 3) % 11 < 2 + p_size % 7 as int) as h1", "cast((5 * p_partkey + 17 * n + 1) % 13 < 3 + p_size % 7 as int) as h2",
        )

    def _lines(self) -> DataFrame:
        """Lines with the sample of their order's customer. Orders meet customers before lines do, by a shuffle: customers grow with the input."""
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.raw("customer").hint("merge").selectExpr("c_custkey", "cast(c_nationkey as bigint) as sample_ix")
        o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "sample_ix")
        return self.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    def counted(self) -> DataFrame:
        """The lines in the columns that are counted."""
        return self.held("lines", lambda: self._lines().select("l_suppkey", "l_partkey", "l_linestatus", "l_quantity", "sample_ix"))

    def counts(self) -> DataFrame:
        return self.held("counts", lambda: self.counted().groupBy(F.col("l_suppkey").alias("feature_ix"), "sample_ix").agg(F.count("*").alias("y")))

    def as_counts(self) -> DataFrame:
        return self.held("as_counts", lambda: self.counted().groupBy(F.col("l_partkey").alias("variant_ix"), "sample_ix").agg(F.count_if(F.col("l_linestatus") == "O").alias("as_ref"), F.count_if(F.col("l_linestatus") == "F").alias("as_alt")))

    def size_factor(self) -> DataFrame:
        t = self.counts().groupBy("sample_ix").agg(F.sum("y").alias("total"))
        return t.select("sample_ix", (F.col("total") / F.avg("total").over(Window.partitionBy())).alias("sf"))

    def offsets(self) -> DataFrame:
        """Offsets before the per-feature mean is taken out: the size factor, bent a little by feature and sample. A size factor is a row a sample."""
        return self.counts().join(F.broadcast(self.size_factor()), "sample_ix").selectExpr("feature_ix", "sample_ix", "y", "sf * (1 + ((feature_ix * 7 + sample_ix * 3) % 5) / 20D) as k")

    def covariates(self) -> DataFrame:
        return self.raw("customer").groupBy(F.col("c_nationkey").cast("bigint").alias("sample_ix")).agg(F.avg("c_acctbal").alias("x1"), F.avg((F.col("c_custkey") % 17).cast("double")).alias("x2"))

    def gc(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey as feature_ix", "((s_suppkey * 37) % 101) / 101D as gc")

    def alignments(self) -> DataFrame:
        """Two mates for each line: SAM fields, tags as an array of strings, ``sample_ix`` of the order's customer."""
        rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"))
        r = self._lines().withColumn("rid", F.col("l_orderkey") * 100 + rank)
        r = r.selectExpr("*", "100 * l_partkey + cast(l_quantity as bigint) as pos1", "100 * l_partkey + cast(l_quantity as bigint) + 20 + 2 * cast(l_quantity as bigint) as pos2", "cast(l_linenumber % 4 as int) as c")
        cigar, span = F.array(*map(F.lit, CIGARS))[F.col("c")], F.array(*map(F.lit, SPANS))[F.col("c")]
        r = r.select("*", cigar.alias("cigar"), (F.col("pos2") + span - F.col("pos1")).cast("bigint").alias("insert"))
        tags = "concat(array(concat('XM:i:', cast(l_linenumber as string))), case when l_returnflag <> 'N' then array('XO:i:1') else array() end, case when l_orderkey % 3 = 0 then array('X0:i:2') else array() end)"
        mates = "explode(array(named_struct('mate', 1, 'flag', 99, 'pos', pos1, 'pnext', pos2, 'tlen', insert), named_struct('mate', 2, 'flag', 147, 'pos', pos2, 'pnext', pos1, 'tlen', -insert))) as m"
        r = r.selectExpr("rid", "sample_ix", CHROM.format("l_partkey / 200") + " as chrom", "cast(l_quantity as int) as mapq", "cigar", "l_orderkey", "l_returnflag", tags + " as tags", mates)
        return r.selectExpr(
            "concat('r', cast(rid as string)) as qname", "m.mate", "cast(m.flag + case when l_orderkey % 23 = 0 then 256 else 0 end as int) as flag", "chrom", "m.pos", "mapq", "cigar",
            "case when l_orderkey % 29 = 0 then '*' else '=' end as rnext", "m.pnext", "m.tlen", "substring(repeat('ACGTTGCA', 12), cast(1 + l_orderkey % 8 as int), 75) as seq", "tags", "sample_ix",
        )

    def records(self) -> DataFrame:
        """Variant records with INFO and FORMAT strings of several kinds."""
        v = self.variants()
        return v.selectExpr(
            "variant_ix", "chrom", "pos", "variant_id", "ref", "alt",
            "case variant_ix % 4 when 0 then concat('VT=SNP;RSQ=0.', cast(50 + variant_ix % 50 as string), ';AF=0.4') when 1 then 'IMP2=0.2,0.8,0.01' when 2 then 'DR2=0.7;VT=SNP' else concat('RSQ=0.9;DR2=0.', cast(10 + variant_ix % 80 as string)) end as info",
            "case variant_ix % 4 when 0 then 'GT:AS' when 1 then 'GT:GL:AS' when 2 then 'GT:DS:AS' else 'AP:AS' end as format",
        )

    def cells(self) -> DataFrame:
        """A genotype cell for each record and sample, in the record's format."""
        d = self.genotypes().join(self.as_counts(), ["variant_ix", "sample_ix"], "left").join(self.records().select("variant_ix", "format"), "variant_ix")
        gt = "case when (variant_ix + sample_ix) % 53 = 0 then '.' else concat(cast(h1 as string), '|', cast(h2 as string)) end"
        counts = "concat(cast(coalesce(as_ref, 0) as string), ',', cast(coalesce(as_alt, 0) as string))"
        gl = "case h1 + h2 when 0 then '-0.1,-1,-4' when 1 then '-2,-0.1,-1' else '-4,-1,-0.1' end"
        ds = "case h1 + h2 when 0 then '0.1' when 1 then '1.1' else '1.9' end"
        ap = "concat(case when h1 = 1 then '-0.05' when sample_ix % 2 = 0 then '-5' else '-1.3' end, ',', case when h2 = 1 then '-0.05' when sample_ix % 2 = 0 then '-5' else '-1.3' end)"
        cell = f"case variant_ix % 4 when 0 then concat({gt}, ':', {counts}) when 1 then concat({gt}, ':', {gl}, ':', {counts}) when 2 then concat({gt}, ':', {ds}, ':', {counts}) else concat({ap}, ':', {counts}) end as cell"
        return d.selectExpr("variant_ix", "sample_ix", "format", cell)
