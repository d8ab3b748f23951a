"""Queries over genotype cells, reads, likelihoods and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .oracle import CHROM
from .queries import DELTA, EXONIC, FEAT, HWE, MOMENTS, ORACLE, PHI, PI, PRI, QUAL, QUERIES, TESTED, G, I, L, O, P, R, S, Study, exonic, held, kept, lbeta, lgamma, normed, priors, query, r, rd, sql, tested

__all__ = ["ORACLE", "QUERIES"]

# --- parsing ----------------------------------------------------------------------------------------------------

SPLIT = "list_filter(string_split(info, ';'), lambda x: regexp_matches(x, '^({0})='))[-1]"
VALUE = "CASE WHEN starts_with({0}, 'IMP2=') THEN TRY_CAST(string_split(substr({0}, 6), ',')[{1}] AS DOUBLE) ELSE TRY_CAST(regexp_extract({0}, '=(.*)$', 1) AS DOUBLE) END"


@query(sql(f"""SELECT variant_ix, regexp_extract({SPLIT.format('VT')}, '=(.*)$', 1) AS vt, {VALUE.format(SPLIT.format('RSQ|DR2|IMP2'), 2)} AS rsq, {VALUE.format(SPLIT.format('AF|IMP2'), 1)} AS af,
  TRY_CAST(string_split(substr({SPLIT.format('IMP2')}, 6), ',')[3] AS DOUBLE) AS cer FROM records"""))
def parse_info(s):
    return s.records().select("variant_ix", G.parse_info(F.col("info")).alias("i")).select("variant_ix", "i.*")


@query(sql("SELECT variant_ix, list_position(string_split(format, ':'), 'GT')::BIGINT AS gt_ix, list_position(string_split(format, ':'), 'GL')::BIGINT AS gl_ix, list_position(string_split(format, ':'), 'AS')::BIGINT AS as_ix FROM records"))
def parse_format(s):
    at = lambda k: F.nullif(F.array_position(F.split("format", ":"), k), F.lit(0))
    return s.records().select("variant_ix", *(at(k).alias(f"{k.lower()}_ix") for k in ("GT", "GL", "AS")))


def parsed(s: Study) -> DataFrame:
    f, c = F.col("format"), F.col("cell")
    gt, gl, ds, ap, ct = (G.field(f, c, *k) for k in (("GT",), ("GL",), ("DS",), ("AP",), ("AS",)))
    d = s.cells().select("variant_ix", "sample_ix", G.hard_call(gt, 0).alias("h1"), G.hard_call(gt, 1).alias("h2"), G.likelihoods(gl).alias("gl"), ds.try_cast("double").alias("ds"), G.allelic(ap, 0).alias("ap1"), G.allelic(ap, 1).alias("ap2"), G.numbers(ct).alias("ct"), gt.isNotNull().alias("has_gt"))
    return d.select("*", F.col("ct")[0].cast("bigint").alias("as_ref"), F.col("ct")[1].cast("bigint").alias("as_alt"))


PARSED = """SELECT variant_ix, sample_ix, k <> 3 AS has_gt, CASE WHEN k <> 3 AND gt <> '.' THEN h1 END AS h1, CASE WHEN k <> 3 AND gt <> '.' THEN h2 END AS h2, as_ref, as_alt,
  CASE WHEN k = 1 THEN [power(10, x1) / (power(10, x1) + power(10, x2) + power(10, x3)), power(10, x2) / (power(10, x1) + power(10, x2) + power(10, x3)), power(10, x3) / (power(10, x1) + power(10, x2) + power(10, x3))] END AS gl,
  CASE WHEN k = 2 THEN ds::DOUBLE END AS ds, CASE WHEN k = 3 THEN CASE WHEN a1 <= -5 THEN 0 ELSE power(10, a1) END END AS ap1, CASE WHEN k = 3 THEN CASE WHEN a2 <= -5 THEN 0 ELSE power(10, a2) END END AS ap2
  FROM (SELECT *, variant_ix % 4 AS k, string_split(gl, ',')[1]::DOUBLE AS x1, string_split(gl, ',')[2]::DOUBLE AS x2, string_split(gl, ',')[3]::DOUBLE AS x3, string_split(ap, ',')[1]::DOUBLE AS a1, string_split(ap, ',')[2]::DOUBLE AS a2 FROM raw_cells)"""


@query(sql(f"SELECT variant_ix, sample_ix, h1, h2, {r('gl[1]')} AS g0, {r('gl[2]')} AS g1, {r('gl[3]')} AS g2, ds, {r('ap1')} AS ap1, {r('ap2')} AS ap2, as_ref, as_alt FROM parsed", parsed=PARSED))
def parse_cell(s):
    d = parsed(s)
    return d.select("variant_ix", "sample_ix", "h1", "h2", *(rd(F.col("gl")[i]).alias(f"g{i}") for i in range(3)), "ds", rd(F.col("ap1")).alias("ap1"), rd(F.col("ap2")).alias("ap2"), "as_ref", "as_alt")


@query(sql("SELECT variant_ix, sample_ix, CASE WHEN h1 = 0 THEN 0.0 WHEN h1 IS NOT NULL THEN 1.0 END::DOUBLE AS ap1, CASE WHEN h2 = 0 THEN 0.0 WHEN h2 IS NOT NULL THEN 1.0 END::DOUBLE AS ap2 FROM parsed", parsed=PARSED))
def gt2ap(s):
    return parsed(s).select("variant_ix", "sample_ix", G.gt2ap(F.col("h1")).alias("ap1"), G.gt2ap(F.col("h2")).alias("ap2"))


DOSE = "SELECT variant_ix, sample_ix, CASE WHEN h1 = h2 THEN ds / 2 WHEN h1 > h2 THEN least(ds, 1) WHEN h1 < h2 THEN greatest(ds - 1, 0) ELSE 0.5 END AS ap1, CASE WHEN h1 = h2 THEN ds / 2 WHEN h1 > h2 THEN greatest(ds - 1, 0) WHEN h1 < h2 THEN least(ds, 1) ELSE 0.5 END AS ap2 FROM parsed WHERE ds IS NOT NULL"


@query(sql(f"SELECT variant_ix, sample_ix, {r('ap1')} AS ap1, {r('ap2')} AS ap2 FROM d", parsed=PARSED, d=DOSE))
def dose2ap(s):
    a, b = G.dose2ap(F.col("h1"), F.col("h2"), F.col("ds"))
    return parsed(s).filter("ds is not null").select("variant_ix", "sample_ix", rd(a).alias("ap1"), rd(b).alias("ap2"))


# the limit of the iteration: the roots of x^2 - (2 g2 + g1) x + g2 where they are real, else the double root
GLAP = """SELECT variant_ix, sample_ix, h1, h2, gl, (2 * gl[3] + gl[2]) / 2 AS mid, sqrt(greatest(power((2 * gl[3] + gl[2]) / 2, 2) - gl[3], 0)) AS w FROM parsed WHERE gl IS NOT NULL AND h1 IS NOT NULL"""


@query(sql("SELECT variant_ix, sample_ix, round(CASE WHEN h1 + h2 <> 1 THEN mid WHEN h1 = 0 THEN mid - w ELSE mid + w END, 4) + 0.0 AS ap1, round(CASE WHEN h1 + h2 <> 1 THEN mid WHEN h1 = 0 THEN mid + w ELSE mid - w END, 4) + 0.0 AS ap2 FROM g", parsed=PARSED, g=GLAP))
def gl2ap(s):
    d = parsed(s).filter("gl is not null and h1 is not null")
    return d.select("variant_ix", "sample_ix", G.gl2ap(F.col("gl"), F.col("h1"), F.col("h2")).alias("a")).select("variant_ix", "sample_ix", rd(F.col("a.ap1"), 4).alias("ap1"), rd(F.col("a.ap2"), 4).alias("ap2"))


@query(sql(f"""SELECT p.variant_ix, p.sample_ix, CASE WHEN p.ap1 IS NOT NULL THEN 'AP' WHEN p.gl IS NOT NULL THEN 'GL' WHEN p.ds IS NOT NULL THEN 'DS' WHEN has_gt THEN 'GT' ELSE 'AF' END AS source,
  round(CASE WHEN p.ap1 IS NOT NULL THEN p.ap1 WHEN p.gl IS NOT NULL THEN CASE WHEN h1 IS NULL THEN 0.5 WHEN p.h1 + p.h2 <> 1 THEN mid WHEN p.h1 = 0 THEN mid - w ELSE mid + w END WHEN p.ds IS NOT NULL THEN d.ap1 ELSE CASE WHEN p.h1 = 0 THEN 0.0 WHEN p.h1 IS NOT NULL THEN 1.0 END END, 4) + 0.0 AS ap1,
  {r('CASE WHEN p.ap1 IS NOT NULL THEN p.ap1 + p.ap2 ELSE p.h1 + p.h2 END')} AS dose
  FROM parsed p LEFT JOIN (SELECT variant_ix, sample_ix, mid, w FROM g) g USING (variant_ix, sample_ix) LEFT JOIN d USING (variant_ix, sample_ix)""", parsed=PARSED, g=GLAP, d=DOSE))
def ap_precedence(s):
    d = parsed(s)
    h1, h2 = F.col("h1"), F.col("h2")
    gl = F.when(h1.isNull(), 0.5).otherwise(G.gl2ap(F.col("gl"), h1, h2)["ap1"])
    source = F.when(F.col("ap1").isNotNull(), "AP").when(F.col("gl").isNotNull(), "GL").when(F.col("ds").isNotNull(), "DS").when(F.col("has_gt"), "GT").otherwise("AF")
    ap = F.when(F.col("ap1").isNotNull(), F.col("ap1")).when(F.col("gl").isNotNull(), gl).when(F.col("ds").isNotNull(), G.dose2ap(h1, h2, F.col("ds"))[0]).otherwise(G.gt2ap(h1))
    dose = F.when(F.col("ap1").isNotNull(), F.col("ap1") + F.col("ap2")).otherwise((h1 + h2).cast("double"))
    return d.select("variant_ix", "sample_ix", source.alias("source"), rd(ap, 4).alias("ap1"), rd(dose).alias("dose"))


@query(sql("SELECT variant_ix, sample_ix, as_ref || ',' || as_alt AS cell FROM as_counts"))
def as_cell(s):
    return s.as_counts().select("variant_ix", "sample_ix", F.concat_ws(",", "as_ref", "as_alt").alias("cell"))


WIDE = ", ".join(f"coalesce(max(CASE WHEN sample_ix = {i} THEN as_ref || ',' || as_alt END), '0,0') AS s{i}" for i in range(25))


@query(sql(f"SELECT variant_ix, {WIDE} FROM as_counts GROUP BY variant_ix"))
def as_pivot(s):
    d = s.as_counts().select("variant_ix", "sample_ix", F.concat_ws(",", "as_ref", "as_alt").alias("c"))
    p = d.groupBy("variant_ix").pivot("sample_ix", list(range(25))).agg(F.first("c"))
    return p.select("variant_ix", *(F.coalesce(F.col(str(i)), F.lit("0,0")).alias(f"s{i}") for i in range(25)))


@query(sql("SELECT variant_ix, format || ':AS' AS format, sample_ix, cell || ':' || as_ref || ',' || as_alt AS cell FROM cells JOIN (SELECT variant_ix, sample_ix, as_ref, as_alt FROM raw_cells) USING (variant_ix, sample_ix) JOIN records USING (variant_ix)"))
def vcf_append_as(s):
    d = s.cells().join(s.as_counts(), ["variant_ix", "sample_ix"], "left")
    more = F.concat_ws(",", F.coalesce("as_ref", F.lit(0)), F.coalesce("as_alt", F.lit(0)))
    return d.select("variant_ix", "sample_ix", F.concat("format", F.lit(":AS")).alias("format"), F.concat("cell", F.lit(":"), more).alias("cell"))


@query(sql("SELECT chrom, count(*) AS n_markers, CAST(sum(as_ref) AS BIGINT) AS as_ref, CAST(sum(as_alt) AS BIGINT) AS as_alt FROM as_counts JOIN variants USING (variant_ix) GROUP BY chrom"))
def as_union_chroms(s):
    d = s.as_counts().join(s.variants().select("variant_ix", "chrom"), "variant_ix")
    return d.groupBy("chrom").agg(F.count("*").alias("n_markers"), F.sum("as_ref").alias("as_ref"), F.sum("as_alt").alias("as_alt"))


# --- reads ------------------------------------------------------------------------------------------------------

Q = R.Quality(min_mapq=10, min_insert=37, max_insert=10_000, max_mismatch=5, max_gap=0)
TAG = "CASE WHEN len(list_filter(tags, lambda t: starts_with(t, '{0}'))) > 0 THEN CAST(string_split(list_filter(tags, lambda t: starts_with(t, '{0}'))[1], ':')[3] AS INT) END"
QC1 = f"mapq >= 10 AND coalesce({TAG.format('XM')}, 5) <= 5 AND coalesce({TAG.format('XO')}, 0) <= 0"
QC2 = f"{QC1} AND abs(tlen) BETWEEN 37 AND 10000 AND rnext = '=' AND (((flag & 16) = 0 AND (flag & 32) > 0 AND pos <= pnext) OR ((flag & 16) > 0 AND (flag & 32) = 0 AND pnext <= pos))"
LEN = "CASE {0} WHEN '75M' THEN 75 WHEN '30M200N45M' THEN 275 WHEN '20M2I53M' THEN 73 ELSE 65 END"


@query(sql("SELECT qname, mate, (flag & 16) > 0 AS reverse, (flag & 32) > 0 AS mate_reverse, (flag & 256) > 0 AS secondary FROM alignments"))
def flag_bits(s):
    return s.alignments().select("qname", "mate", R.has(F.col("flag"), 16).alias("reverse"), R.has(F.col("flag"), 32).alias("mate_reverse"), R.has(F.col("flag"), 256).alias("secondary"))


@query(sql("SELECT qname, mate FROM alignments WHERE (flag & 256) = 0"))
def secondary_filter(s):
    return s.alignments().filter(~R.has(F.col("flag"), 256)).select("qname", "mate")


@query(sql(f"SELECT qname, mate, {TAG.format('XM')} AS xm, {TAG.format('XO')} AS xo, {TAG.format('X0')} AS x0 FROM alignments"))
def sam_tags(s):
    m = R.tag_map(F.col("tags"))
    return s.alignments().select("qname", "mate", *(F.try_element_at(m, F.lit(k)).cast("int").alias(k.lower()) for k in ("XM", "XO", "X0")))


@query(sql(f"SELECT qname, mate, coalesce({TAG.format('XO')}, 0) <= 0 AS kept_if_missing, coalesce({TAG.format('XO')}, 10000000) <= 0 AS dropped_if_missing FROM alignments"))
def tag_policy(s):
    a, b = (R.tag_value(F.col("tags"), "XO", 0, R.Quality(skip_missing=k)) <= 0 for k in (False, True))
    return s.alignments().select("qname", "mate", a.alias("kept_if_missing"), b.alias("dropped_if_missing"))


@query(sql(f"SELECT qname, mate FROM alignments WHERE {QC2}"))
def read_qc_paired(s):
    return s.alignments().filter(R.passes_paired(Q)).select("qname", "mate")


@query(sql(f"SELECT qname, mate FROM alignments WHERE {QC1}"))
def read_qc_single(s):
    return s.alignments().filter(R.passes_single(Q)).select("qname", "mate")


@query(sql(f"SELECT count(*) AS found, count(*) FILTER (WHERE NOT ({QC2})) AS removed, count(*) FILTER (WHERE {QC2}) AS remaining FROM alignments"))
def read_tally(s):
    return s.alignments().agg(F.count("*").alias("found"), F.count_if(~R.passes_paired(Q)).alias("removed"), F.count_if(R.passes_paired(Q)).alias("remaining"))


@query(sql(f"SELECT qname, mate, cigar, {LEN.format('cigar')} AS ref_len FROM alignments"))
def cigar_ref_len(s):
    return s.alignments().select("qname", "mate", "cigar", R.ref_length(F.col("cigar")).alias("ref_len"))


# an alignment cut d bases after its start, by kind of CIGAR
CUT = """SELECT *, CASE cigar
    WHEN '75M' THEN CASE WHEN d < 75 THEN d || 'M' ELSE cigar END
    WHEN '30M200N45M' THEN CASE WHEN d < 30 THEN d || 'M' WHEN d = 30 THEN '30M' WHEN d < 230 THEN '30M' || (d - 30) || 'N' WHEN d = 230 THEN '30M200N' WHEN d < 275 THEN '30M200N' || (d - 230) || 'M' ELSE cigar END
    WHEN '20M2I53M' THEN CASE WHEN d < 20 THEN d || 'M' WHEN d = 20 THEN '20M2I' WHEN d < 73 THEN '20M2I' || (d - 20) || 'M' ELSE cigar END
    ELSE CASE WHEN d < 65 THEN '10S' || d || 'M' ELSE cigar END END AS c2,
  substr(seq, 1, CASE cigar WHEN '75M' THEN least(d, 75) WHEN '30M200N45M' THEN CASE WHEN d <= 30 THEN d WHEN d <= 230 THEN 30 ELSE least(d - 200, 75) END
    WHEN '20M2I53M' THEN CASE WHEN d < 20 THEN d ELSE least(d + 2, 75) END ELSE least(d + 10, 75) END) AS q2"""


@query(sql("SELECT qname, cigar, c2 AS cut_cigar, q2 AS cut_seq FROM cut", cut=f"{CUT} FROM (SELECT *, pnext - pos AS d FROM alignments WHERE mate = 1)"))
def cigar_truncate(s):
    d = s.alignments().filter("mate = 1").select("qname", "cigar", R.truncate(F.col("pos"), F.col("cigar"), F.col("seq"), F.col("pnext")).alias("t"))
    return d.select("qname", "cigar", F.col("t.cigar").alias("cut_cigar"), F.col("t.seq").alias("cut_seq"))


FRAGS = f"""SELECT a.qname, a.sample_ix, a.chrom, a.pos AS "left", a.pos + abs(a.tlen) - 1 AS "right",
  CASE WHEN gap < 0 THEN a.c2 ELSE a.cigar END || CASE WHEN gap > 0 THEN gap || 'N' ELSE '' END || b.cigar AS cigar, CASE WHEN gap < 0 THEN a.q2 ELSE a.seq END || b.seq AS seq
  FROM (SELECT *, pnext - pos - ({LEN.format('cigar')}) AS gap, ({QC2}) AS ok FROM cut) a JOIN (SELECT qname, cigar, seq, ({QC2}) AS ok FROM alignments WHERE mate = 2 AND (flag & 256) = 0) b ON a.qname = b.qname WHERE (flag & 256) = 0 AND (a.ok OR b.ok)"""
FR = {"cut": f"{CUT} FROM (SELECT *, pnext - pos AS d FROM alignments WHERE mate = 1)", "frags": FRAGS}


# each insert has both mates, so the pair needs no join: mate 1 is cut where mate 2 begins, or a gap lies between them
PAIRED = f"""SELECT 'r' || rid AS qname, {CHROM.format('l_partkey / 200')} AS chrom, pos1 AS pos, pos2 - pos1 AS d, pos2, ins, cigar, substr(repeat('ACGTTGCA', 12), 1 + l_orderkey % 8, 75) AS seq
  FROM inserts WHERE l_orderkey % 23 <> 0 AND l_orderkey % 29 <> 0 AND l_quantity >= 10 AND l_linenumber <= 5 AND l_returnflag = 'N' AND abs(ins) BETWEEN 37 AND 10000 AND pos1 <= pos2"""


@query(sql(f"""SELECT qname, chrom, pos AS "left", pos + abs(ins) - 1 AS "right", CASE WHEN gap < 0 THEN c2 ELSE cigar END || CASE WHEN gap > 0 THEN gap || 'N' ELSE '' END || cigar AS cigar, CASE WHEN gap < 0 THEN q2 ELSE seq END || seq AS seq
  FROM (SELECT *, d - ({LEN.format('cigar')}) AS gap FROM ({CUT} FROM ({PAIRED})))"""))
def mate_pairs(s):
    return R.pair(s.alignments(), Q).select("qname", "chrom", "left", "right", "cigar", "seq")


@query(sql(f"SELECT qname, mate, substr(chrom, 4) AS chrom, pos AS \"left\", pos + ({LEN.format('cigar')}) - 1 AS \"right\", cigar, seq FROM alignments WHERE (flag & 256) = 0 AND {QC1}"))
def single_end_frags(s):
    return R.single(s.alignments(), Q).select("qname", "mate", "chrom", F.col("left").cast("bigint").alias("left"), F.col("right").cast("bigint").alias("right"), "cigar", "seq")


# matching blocks by walking the CIGAR one operation at a time
WALK = """SELECT qname, sample_ix, chrom, seq, ops, 0 AS i, "left" AS p, 0 AS rd, CAST(NULL AS VARCHAR) AS op, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s0, 0 AS r0 FROM (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]') AS ops FROM frags)
  UNION ALL SELECT qname, sample_ix, chrom, seq, ops, i + 1, p + CASE WHEN right(ops[i + 1], 1) IN ('M', 'D', 'N', 'P', '=', 'X') THEN CAST(ops[i + 1][:-2] AS BIGINT) ELSE 0 END,
    rd + CASE WHEN right(ops[i + 1], 1) IN ('M', 'I', 'S', 'H', '=', 'X') THEN CAST(ops[i + 1][:-2] AS INT) ELSE 0 END, right(ops[i + 1], 1), CAST(ops[i + 1][:-2] AS BIGINT), p, rd FROM walk WHERE i < len(ops)"""
COVERED = """SELECT w.qname, w.sample_ix, w.i AS block, m.chrom, m.pos, m.variant_id, m.ref AS a1, m.alt AS a2, substr(w.seq, CAST(w.r0 + m.pos - w.s0 + 1 AS INT), 1) AS base FROM walk w JOIN variants m ON m.chrom = w.chrom AND m.pos BETWEEN w.s0 AND w.s0 + w.n - 1 AND length(m.ref) = 1 WHERE w.op IN ('M', '=', 'X')"""


def walked(body: str) -> str:
    return sql(body, **FR, walk=WALK, covered=COVERED).replace("WITH ", "WITH RECURSIVE ", 1)


def markers(s: Study) -> DataFrame:
    a, b = G.marker_alleles(F.col("ref"), F.col("alt"))
    return s.variants().select("chrom", "pos", "variant_id", a.alias("a1"), b.alias("a2"))


def bare(s: Study) -> DataFrame:
    """Fragments without their bases, of which their place and blocks tell nothing: most bytes of an alignment."""
    return R.pair(s.alignments().withColumn("seq", F.lit("")), Q)


def cover(s: Study) -> DataFrame:
    return R.covered(R.pair(s.alignments(), Q), markers(s))


@query(walked("SELECT variant_id, count(*) FILTER (WHERE base = a1) AS n_ref, count(*) FILTER (WHERE base <> a1 AND base = a2) AS n_alt, count(*) FILTER (WHERE base <> a1 AND base <> a2) AS n_other FROM covered GROUP BY variant_id"))
def as_count(s):
    return R.allele_counts(cover(s)).select("variant_id", "n_ref", "n_alt", "n_other")


@query(walked(f"SELECT variant_id, {r('sum(1.0::DOUBLE / n)')} AS ds FROM covered JOIN (SELECT qname, count(DISTINCT block) AS n FROM covered GROUP BY qname) USING (qname) GROUP BY variant_id"))
def as_dosage(s):
    return R.expected_dosage(R.covered(bare(s), markers(s))).select("variant_id", rd(F.col("ds")).alias("ds"))


@query(walked("SELECT qname, cigar FROM frags WHERE qname IN (SELECT qname FROM covered)"))
def frag_overlap_semi(s):
    return R.overlapping(bare(s), markers(s)).select("qname", "cigar")


@query(walked("SELECT qname, cigar FROM frags WHERE qname NOT IN (SELECT qname FROM covered)"))
def frag_overlap_anti(s):
    return R.overlapping(bare(s), markers(s), anti=True).select("qname", "cigar")


@query(walked("SELECT (SELECT count(*) FROM frags) AS fragments, (SELECT count(DISTINCT qname) FROM covered) AS overlapping"))
def frag_tally(s):
    return R.overlap_tally(bare(s), markers(s))


# --- priors and likelihoods -------------------------------------------------------------------------------------

STATES = "(VALUES " + ", ".join(f"({j}, {c[0]}, {c[1]}, {x[0]}, {x[1]})" for j, c, x in G.STATES) + ") st(j, c1, c2, x1, x2)"


def prior_sql(z1: str, z2: str, x1: str, x2: str) -> str:
    """Prior of the state in columns c1 c2 x1 x2 (alias st)."""
    hap = lambda c, x, z, f: f"(CASE st.{c} WHEN 1 THEN {z} ELSE 1 - ({z}) END) * (CASE st.{x} WHEN 1 THEN {f} ELSE 1 - ({f}) END)"
    one = f"{hap('c1', 'x1', z1, x1)} * {hap('c2', 'x2', z2, x2)}"
    two = f"{hap('c2', 'x2', z1, x1)} * {hap('c1', 'x1', z2, x2)}"
    return f"({one} + CASE WHEN st.c1 = st.c2 AND st.x1 = st.x2 THEN 0 ELSE {two} END)"


PHASED = """SELECT a.variant_ix, a.sample_ix, CAST(greatest(2 * a.h1 + b.h1, 2 * a.h2 + b.h2) AS INT) AS first, CAST(least(2 * a.h1 + b.h1, 2 * a.h2 + b.h2) AS INT) AS second FROM genotypes a JOIN genotypes b ON b.variant_ix = a.variant_ix + 1 AND b.sample_ix = a.sample_ix"""


@query(sql(f"SELECT variant_ix, sample_ix, CAST(j AS INT) AS j, CAST(c1 + c2 AS INT) AS g, CAST(x1 + x2 AS INT) AS xg FROM ph JOIN {STATES} ON greatest(2 * c1 + x1, 2 * c2 + x2) = first AND least(2 * c1 + x1, 2 * c2 + x2) = second", ph=PHASED))
def diplotype_states(s):
    """The state of each sample's calls at a variant and the next one: haplotypes as an unordered pair."""
    g = s.genotypes()
    x = g.select((F.col("variant_ix") - 1).alias("variant_ix"), "sample_ix", F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    a, b = (2 * F.col(f"h{i}") + F.col(f"x{i}") for i in (1, 2))
    key = 4 * F.greatest(a, b) + F.least(a, b)
    known = {4 * max(p, q) + min(p, q): j for j, c, x in G.STATES for p, q in [(2 * int(c[0]) + int(x[0]), 2 * int(c[1]) + int(x[1]))]}
    j = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))[key]
    return g.join(x, ["variant_ix", "sample_ix"]).select("variant_ix", "sample_ix", j.alias("j"), (F.col("h1") + F.col("h2")).alias("g"), (F.col("x1") + F.col("x2")).alias("xg"))


@query(sql(f"SELECT variant_ix, sample_ix, {r('(1 - z1) * (1 - z2)')} AS p0, {r('1 - (1 - z1) * (1 - z2) - z1 * z2')} AS p1, {r('z1 * z2')} AS p2 FROM priors", **PRI))
def genotype_prior(s):
    p = G.genotype_prior(F.col("z1"), F.col("z2"))
    return priors(s).select("variant_ix", "sample_ix", *(rd(x).alias(f"p{i}") for i, x in enumerate(p)))


def neighbours(s: Study) -> DataFrame:
    """A variant with the next one, as tested and feature variant."""
    p = priors(s)
    x = p.select((F.col("variant_ix") - 1).alias("variant_ix"), "sample_ix", F.col("z1").alias("x1"), F.col("z2").alias("x2"))
    return p.join(x, ["variant_ix", "sample_ix"])


NEXT = "SELECT p.variant_ix, p.sample_ix, p.z1, p.z2, x.z1 AS f1, x.z2 AS f2 FROM priors p JOIN priors x ON x.variant_ix = p.variant_ix + 1 AND x.sample_ix = p.sample_ix"


def by_state(d: DataFrame, prior: list) -> DataFrame:
    return d.select("variant_ix", "sample_ix", F.posexplode(F.array(*prior)).alias("j", "p")).select("variant_ix", "sample_ix", "j", rd(F.col("p")).alias("p"))


@query(sql(f"SELECT variant_ix, sample_ix, CAST(st.j AS INT) AS j, {r(prior_sql('z1', 'z2', 'f1', 'f2'))} AS p FROM nxt, {STATES}", **PRI, nxt=NEXT))
def diplotype_prior(s):
    return by_state(neighbours(s), G.diplotype_prior(F.col("z1"), F.col("z2"), F.col("x1"), F.col("x2")))


@query(sql(f"SELECT variant_ix, sample_ix, CAST(st.j AS INT) AS j, {r('CASE st.j WHEN 0 THEN (1 - z1) * (1 - z2) WHEN 5 THEN z1 * (1 - z2) + z2 * (1 - z1) WHEN 9 THEN z1 * z2 ELSE 0 END')} AS p FROM priors, {STATES}", **PRI))
def diplotype_prior_self(s):
    return by_state(priors(s), G.diplotype_prior_self(F.col("z1"), F.col("z2")))


@query(sql(f"SELECT variant_ix, sample_ix, CAST(st.j AS INT) AS j, {r(prior_sql('0.5::DOUBLE', '0.5::DOUBLE', 'z1', 'z2'))} AS p FROM priors, {STATES}", **PRI))
def diplotype_prior_null(s):
    return by_state(priors(s), G.diplotype_prior_null(F.col("z1"), F.col("z2")))


@query(sql(f"SELECT variant_ix, sample_ix, CAST(st.j AS INT) AS j, {r('CASE st.j WHEN 3 THEN (1 - z1) * (1 - z2) WHEN 4 THEN 0.5 * (z1 * (1 - z2) + z2 * (1 - z1)) WHEN 5 THEN 0.5 * (z1 * (1 - z2) + z2 * (1 - z1)) WHEN 6 THEN z1 * z2 ELSE 0 END')} AS p FROM priors, {STATES}", **PRI))
def diplotype_prior_imprint(s):
    return by_state(priors(s), G.diplotype_prior_imprint(F.col("z1"), F.col("z2")))


def weight_sql(pi: str, delta: str, phi: str) -> tuple[str, str]:
    part = lambda c, x, b: f"4 * (CASE st.{c} WHEN 1 THEN {pi} ELSE 1 - {pi} END) * (CASE st.{x} WHEN 1 THEN {'1 - ' + delta if b else delta} ELSE {delta if b else '1 - ' + delta} END) * ({phi if b else '1 - ' + phi})"
    return tuple(f"({part('c1', 'x1', b)} + {part('c2', 'x2', b)})" for b in (0, 1))


GRID = "(SELECT variant_ix, 0.05 + variant_ix % 10 / 10.0::DOUBLE AS pi, 0.01 + variant_ix % 7 / 20.0::DOUBLE AS delta, 0.3 + variant_ix % 5 / 10.0::DOUBLE AS phi FROM variants)"
WA, WB = weight_sql("pi", "delta", "phi")


@query(sql(f"SELECT variant_ix, CAST(st.j AS INT) AS j, {r(WA)} AS a, {r(WB)} AS b FROM {GRID}, {STATES}"))
def allelic_weights(s):
    d = s.variants().selectExpr("variant_ix", "0.05D + variant_ix % 10 / 10D as pi", "0.01D + variant_ix % 7 / 20D as delta", "0.3D + variant_ix % 5 / 10D as phi")
    w = [G.allelic_weights(F.col("pi"), F.col("delta"), F.col("phi"), j) for j in range(10)]
    d = d.select("variant_ix", F.posexplode(F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in w))).alias("j", "w"))
    return d.select("variant_ix", "j", rd(F.col("w.a")).alias("a"), rd(F.col("w.b")).alias("b"))


def nb_sql(y: str, mean: str, size: str) -> str:
    return f"({lgamma(f'{size} + {y}')} - {lgamma(f'{y} + 1')} - {lgamma(size)} + {y} * ln({mean}) + {size} * ln({size}) - ({y} + {size}) * ln({mean} + {size}))"


def bb_sql(a: str, b: str, x: str, z: str) -> str:
    return f"(-ln({a} + {b} + 1) - {lbeta(f'{a} + 1', f'{b} + 1')} + {lbeta(f'{a} + {x}', f'{b} + {z}')} - {lbeta(x, z)})"


@query(sql(f"SELECT feature_ix, {r('sum(' + nb_sql('y', 'exp(beta) * k', 'theta * k') + ')', 4)} AS loglik FROM norm JOIN moments USING (feature_ix) GROUP BY feature_ix", moments=MOMENTS))
def nb_loglik(s):
    n = O.normalise(s.offsets())
    d = n.join(O.moment_init(n), "feature_ix")
    term = L.nb_log(F.col("y").cast("double"), F.exp("beta") * F.col("k"), F.col("theta") * F.col("k"))
    return d.groupBy("feature_ix").agg(rd(F.sum(term), 4).alias("loglik"))


@query(sql(f"SELECT variant_ix, {r('sum(' + bb_sql('as_ref', 'as_alt', '5.0', '6.5') + ')', 4)} AS loglik FROM as_counts GROUP BY variant_ix"))
def bb_loglik(s):
    term = L.bb_log(F.col("as_ref").cast("double"), F.col("as_alt").cast("double"), F.lit(5.0), F.lit(6.5))
    return s.as_counts().groupBy("variant_ix").agg(rd(F.sum(term), 4).alias("loglik"))


THETA = 5.0


def reads_of_features(s: Study) -> DataFrame:
    """``feature_ix sample_ix feature_variant x1 x2 as_ref as_alt``: reads of feature variants, with the priors there."""
    z = priors(s).select(F.col("variant_ix").alias("feature_variant"), "sample_ix", F.col("z1").alias("x1"), F.col("z2").alias("x2"))
    x = kept(s).select("feature_ix", F.col("variant_ix").alias("feature_variant")).join(z, "feature_variant")
    return x.join(s.as_counts().withColumnRenamed("variant_ix", "feature_variant"), ["feature_variant", "sample_ix"])


def e_input(s: Study) -> tuple[DataFrame, DataFrame]:
    s = held(s)
    n = normed(s)
    beta = O.moment_init(n).select("feature_ix", "beta")
    z = priors(s).select("variant_ix", "sample_ix", "z1", "z2")
    base = tested(s).select("feature_ix", "variant_ix").join(n.join(beta, "feature_ix"), "feature_ix").join(z, ["variant_ix", "sample_ix"]).withColumn("theta", F.lit(THETA))
    x = reads_of_features(s).join(n.select("feature_ix", "sample_ix", "k"), ["feature_ix", "sample_ix"]).withColumn("theta", F.lit(THETA))
    return base, x


def stepped(s: Study) -> DataFrame:
    return L.e_step(*e_input(s), PI, DELTA, PHI)


AA, BB = weight_sql(str(PI), str(DELTA), str(PHI))
ESTEP = {
    "moments": MOMENTS,
    "near": TESTED,
    "base": f"SELECT n.feature_ix, t.variant_ix, n.sample_ix, y, k, z1, z2, beta, {THETA}::DOUBLE AS theta FROM near t JOIN norm n USING (feature_ix) JOIN priors p ON p.variant_ix = t.variant_ix AND p.sample_ix = n.sample_ix JOIN moments m ON m.feature_ix = n.feature_ix",
    "st10": f"SELECT *, {AA} AS a, {BB} AS b FROM {STATES}",
    "pr": f"""SELECT b.feature_ix, b.variant_ix, b.sample_ix, x.variant_ix AS fv, st.j, st.c1 + st.c2 AS g, CASE st.c1 + st.c2 WHEN 0 THEN (1 - b.z1) * (1 - b.z2) WHEN 2 THEN b.z1 * b.z2 ELSE 1 - (1 - b.z1) * (1 - b.z2) - b.z1 * b.z2 END AS own,
      CASE WHEN b.variant_ix = x.variant_ix THEN CASE st.j WHEN 0 THEN (1 - b.z1) * (1 - b.z2) WHEN 5 THEN b.z1 * (1 - b.z2) + b.z2 * (1 - b.z1) WHEN 9 THEN b.z1 * b.z2 ELSE 0 END ELSE {prior_sql('b.z1', 'b.z2', 'f.z1', 'f.z2')} END AS prior,
      as_ref, as_alt, theta * k * st.a AS a, theta * k * st.b AS bb FROM base b JOIN kept x USING (feature_ix) JOIN priors f ON f.variant_ix = x.variant_ix AND f.sample_ix = b.sample_ix JOIN as_counts c ON c.variant_ix = x.variant_ix AND c.sample_ix = b.sample_ix, st10 st""",
    "tm": f"SELECT *, ln(prior) - ln(own) + {bb_sql('as_ref', 'as_alt', 'a', 'bb')} AS t FROM pr WHERE prior > 0",
    "ls": "SELECT feature_ix, variant_ix, sample_ix, fv, g, ln(sum(exp(t - top))) + any_value(top) AS s FROM (SELECT *, max(t) OVER (PARTITION BY feature_ix, variant_ix, sample_ix, fv, g) AS top FROM tm) GROUP BY ALL",
    "sm": "SELECT feature_ix, variant_ix, sample_ix, sum(s) FILTER (WHERE g = 0) AS s0, sum(s) FILTER (WHERE g = 1) AS s1, sum(s) FILTER (WHERE g = 2) AS s2 FROM ls GROUP BY ALL",
    "dd": f"""SELECT b.*, ln((1 - z1) * (1 - z2)) + {nb_sql('y', f'exp(beta) * k * {2 * (1 - PI)}', f'theta * k * {2 * (1 - PI)}')} + coalesce(s0, 0) AS d0, ln(1 - (1 - z1) * (1 - z2) - z1 * z2) + {nb_sql('y', 'exp(beta) * k', 'theta * k')} + coalesce(s1, 0) AS d1,
      ln(z1 * z2) + {nb_sql('y', f'exp(beta) * k * {2 * PI}', f'theta * k * {2 * PI}')} + coalesce(s2, 0) AS d2 FROM base b LEFT JOIN sm USING (feature_ix, variant_ix, sample_ix)""",
    "es": "SELECT *, greatest(d0, d1, d2) + ln(exp(d0 - greatest(d0, d1, d2)) + exp(d1 - greatest(d0, d1, d2)) + exp(d2 - greatest(d0, d1, d2))) AS ll FROM dd",
}
ES = PRI | ESTEP


@query(sql(f"SELECT feature_ix, variant_ix, sample_ix, {r('exp(d0 - ll)')} AS p0, {r('exp(d1 - ll)')} AS p1, {r('exp(d2 - ll)')} AS p2 FROM es", **ES))
def em_estep_posterior(s):
    return stepped(s).select("feature_ix", "variant_ix", "sample_ix", *(rd(F.col(f"p{g}")).alias(f"p{g}") for g in range(3)))


def const_prior() -> float:
    import math

    h = L.Hyper()
    c = h.kappa / 2 * math.log(h.omega / 2) - math.lgamma(h.kappa / 2) - 0.5 * math.log(2 * math.pi) - 0.5 * math.log(h.sigma2)
    c += (h.adelta - 1) * math.log(DELTA) + (h.bdelta - 1) * math.log(1 - DELTA) + (h.abpi - 1) * (math.log(PI) + math.log(1 - PI)) + (h.abphi - 1) * (math.log(PHI) + math.log(1 - PHI))
    return c + (h.kappa / 2 - 1) * math.log(THETA) - h.omega * THETA / 2 + 0.5 * math.log(THETA)


@query(sql(f"SELECT feature_ix, variant_ix, {r(f'sum(ll) + {const_prior()!r}', 4)} AS loglik FROM es GROUP BY feature_ix, variant_ix", **ES))
def em_estep_loglik(s):
    d = stepped(s).groupBy("feature_ix", "variant_ix").agg(F.sum("loglik").alias("ll"), F.first("theta").alias("theta"), F.first("beta").alias("beta"))
    prior = L.log_prior(PI, DELTA, PHI, F.col("theta"), F.col("beta"), F.col("beta"), L.Hyper())
    return d.select("feature_ix", "variant_ix", rd(F.col("ll") + prior, 4).alias("loglik"))


@query(sql(f"""SELECT feature_ix, variant_ix, {r('power(v01 - m0 * m1, 2) / nullif(v0 - m0 * m0, 0) / nullif(v1 - m1 * m1, 0)', 4)} AS r2 FROM (SELECT feature_ix, variant_ix, avg(2 * q2 + q1) AS m0, avg(2 * p2 + p1) AS m1, avg(4 * q2 + q1) AS v0, avg(4 * p2 + p1) AS v1, avg(4 * p2 * q2 + 2 * (p2 * q1 + p1 * q2) + p1 * q1) AS v01
  FROM (SELECT *, z1 * z2 AS q2, 1 - (1 - z1) * (1 - z2) - z1 * z2 AS q1, exp(d1 - ll) AS p1, exp(d2 - ll) AS p2 FROM es) GROUP BY ALL)""", **ES))
def posterior_r2(s):
    q = G.genotype_prior(F.col("z1"), F.col("z2"))
    d = stepped(s).select("*", *(x.alias(f"q{i}") for i, x in enumerate(q)))
    d = L.r2(d, ["feature_ix", "variant_ix"], ["q0", "q1", "q2"], ["p0", "p1", "p2"])
    return d.select("feature_ix", "variant_ix", rd(F.col("r2"), 4).alias("r2"))


@query(sql("SELECT feature_ix, variant_ix, sample_ix, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS g FROM es", **ES))
def map_genotype(s):
    p = F.array("p0", "p1", "p2")
    return stepped(s).select("feature_ix", "variant_ix", "sample_ix", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("g"))


FIX = "SELECT variant_ix, sample_ix, (1 - z1) * (1 - z2) AS p0, 1 - (1 - z1) * (1 - z2) - z1 * z2 AS p1, z1 * z2 AS p2, z1, z2, as_ref, as_alt FROM priors JOIN (SELECT variant_ix, sample_ix, as_ref, as_alt FROM raw_cells) USING (variant_ix, sample_ix)"


@query(sql("""SELECT variant_ix, sample_ix, CASE WHEN z1 > 0.5 THEN '1' ELSE '0' END || '|' || CASE WHEN z2 > 0.5 THEN '1' ELSE '0' END || ':' || printf('%.6f', round(p0, 6)) || ',' || printf('%.6f', round(p1, 6)) || ',' || printf('%.6f', round(p2, 6))
  || ':' || printf('%.6f', log10(greatest(z1, 1e-5))) || ',' || printf('%.6f', log10(greatest(z2, 1e-5))) || ':' || as_ref || ',' || as_alt AS cell FROM fix""", **PRI, fix=FIX))
def posterior_vcf_cells(s):
    d = priors(s).join(s.as_counts(), ["variant_ix", "sample_ix"], "left")
    p = G.genotype_prior(F.col("z1"), F.col("z2"))
    call = lambda z: F.when(F.col(z) > 0.5, "1").otherwise("0")
    logs = F.format_string("%.6f,%.6f", *(F.log10(F.greatest(F.col(z), F.lit(1e-5))) for z in ("z1", "z2")))
    cell = F.concat_ws(":", F.concat_ws("|", call("z1"), call("z2")), F.format_string("%.6f,%.6f,%.6f", *(F.round(x, 6) for x in p)), logs, F.concat_ws(",", F.coalesce("as_ref", F.lit(0)), F.coalesce("as_alt", F.lit(0))))
    return d.select("variant_ix", "sample_ix", cell.alias("cell"))


@query(sql("SELECT variant_ix, CAST(CASE WHEN variant_ix % 3 = 0 THEN 0 ELSE 1000000 END + CASE WHEN variant_ix % 2 = 0 THEN 10000 ELSE 0 END + CASE WHEN variant_ix % 5 = 0 THEN 1000 ELSE 0 END + CASE WHEN variant_ix % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS code FROM variants"))
def conv_code(s):
    v = F.col("variant_ix")
    return s.variants().select("variant_ix", G.conv_code(v % 3 == 0, [v % 2 == 0, v % 5 == 0, F.lit(False), F.lit(False), v % 7 == 0]).alias("code"))


@query(sql(f"SELECT variant_ix, {r('ln(p / (1 - p))')} AS logit, {r('1 / (1 + exp(-(10 * p - 5)))')} AS expit FROM (SELECT variant_ix, (1 + variant_ix % 97) / 98.0::DOUBLE AS p FROM variants)"))
def logit_expit(s):
    p = (1 + F.col("variant_ix") % 97) / F.lit(98.0)
    return s.variants().select("variant_ix", rd(S.logit(p)).alias("logit"), rd(S.expit(10 * p - 5)).alias("expit"))


@query(sql("SELECT sample_ix, array_to_string(list_transform(list_sort(list_distinct(list(y))), lambda v: CAST(v AS VARCHAR)), ',') AS ys FROM counts GROUP BY sample_ix"))
def sort_uniq(s):
    return s.counts().groupBy("sample_ix").agg(F.collect_set("y").alias("ys")).select("sample_ix", F.array_join(F.transform(F.array_sort("ys"), lambda v: v.cast("string")), ",").alias("ys"))


# --- association and reports ------------------------------------------------------------------------------------

LR = """SELECT feature_ix, variant_ix, variant_id, chrom, pos, tss, coalesce(CASE WHEN isnan(x) THEN 0 ELSE x END, 0) AS lr FROM (SELECT t.*, -count(*) * ln(1 - corr(ln((y + 1) / k), (h1 + h2)::DOUBLE) * corr(ln((y + 1) / k), (h1 + h2)::DOUBLE)) AS x
  FROM tested t JOIN norm n USING (feature_ix) JOIN genotypes g ON g.variant_ix = t.variant_ix AND g.sample_ix = n.sample_ix GROUP BY ALL)"""
A = QUAL | {"assoc": LR}
POLY = "-0.82215223 + t * 0.17087277"
for _c in (1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    POLY = f"{_c} + t * ({POLY})"
RANK = "SELECT *, row_number() OVER (PARTITION BY feature_ix ORDER BY round(lr, 8) DESC, pos, variant_id) AS rank, count(*) FILTER (WHERE lr > 0) OVER (PARTITION BY feature_ix) AS np, 1.0::DOUBLE / (1 + 0.5 * sqrt(lr / 2)) AS t FROM assoc"
RAW = f"SELECT *, CASE WHEN lr > 0 THEN (ln(t) - lr / 2 + {POLY}) / ln(10) - log10(rank) + log10(np) END AS raw FROM rk"
BH = "SELECT *, CASE WHEN lr > 0 THEN least(0, min(raw) OVER (PARTITION BY feature_ix ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) ELSE 0 END AS q FROM rw"
LEAD = "SELECT * FROM (SELECT *, count(*) FILTER (WHERE kk = best) OVER (PARTITION BY feature_ix) - 1 AS n_ties, row_number() OVER (PARTITION BY feature_ix ORDER BY kk DESC, abs(pos - tss), pos, variant_id) AS rn FROM (SELECT *, round(lr * 100000) AS kk, max(round(lr * 100000)) OVER (PARTITION BY feature_ix) AS best FROM assoc)) WHERE rn = 1"
B = A | {"rk": RANK, "rw": RAW, "bh": BH, "ld": LEAD}


def assoc(s: Study) -> DataFrame:
    return P.association_lr(O.normalise(s.offsets()), s.genotypes(), tested(s))


@query(sql("SELECT feature_ix, variant_ix, round(lr, 5) + 0.0 AS lr, rank FROM rk", **B))
def lr_rank(s):
    return P.ranked(assoc(s)).select("feature_ix", "variant_ix", rd(F.col("lr"), 5).alias("lr"), F.col("rank").cast("bigint").alias("rank"))


@query(sql(f"SELECT feature_ix, variant_ix, {r('q', 5)} AS log10_q FROM bh", **B))
def bh_qvalue(s):
    return P.with_q(assoc(s)).select("feature_ix", "variant_ix", rd(F.col("log10_q"), 5).alias("log10_q"))


@query(sql(f"SELECT feature_ix, {r('min(q)', 5)} AS min_q FROM bh GROUP BY feature_ix", **B))
def bh_min(s):
    return P.with_q(assoc(s)).groupBy("feature_ix").agg(rd(F.min("log10_q"), 5).alias("min_q"))


@query(sql(f"SELECT feature_ix, variant_id, pos, {r('lr', 5)} AS lr, n_ties FROM ld", **B))
def lead_snp(s):
    return P.lead(assoc(s)).select("feature_ix", "variant_id", "pos", rd(F.col("lr"), 5).alias("lr"), "n_ties")


@query(sql(f"""SELECT f.feature_ix, CASE WHEN l.lr > 0 THEN l.variant_id WHEN n > 0 THEN 'rs' ELSE 'SKIPPED' END AS variant_id, f.chrom, CASE WHEN l.lr > 0 THEN l.pos ELSE 0 END AS pos, {r('CASE WHEN l.lr > 0 THEN l.lr ELSE -1 END', 5)} AS lr, {r('CASE WHEN l.lr > 0 THEN mq ELSE 0 END', 5)} AS log10_q,
  coalesce(n, 0) AS n_tested, CASE WHEN l.lr > 0 THEN n_ties ELSE 0 END AS n_ties FROM features f LEFT JOIN ld l USING (feature_ix) LEFT JOIN (SELECT feature_ix, count(*) AS n, min(q) AS mq FROM bh GROUP BY 1) b USING (feature_ix)""", **B))
def lead_report(s):
    d = P.lead_report(assoc(s), s.features().select("feature_ix", "chrom"))
    return d.select("feature_ix", "variant_id", "chrom", "pos", rd(F.col("lr"), 5).alias("lr"), rd(F.col("log10_q"), 5).alias("log10_q"), "n_tested", "n_ties")


@query(sql(f"""SELECT feature_ix, variant_ix FROM (SELECT *, 2.0::DOUBLE / count(*) OVER (PARTITION BY feature_ix) AS p, 1.0::DOUBLE / (1 + 0.5 * sqrt(lr / 2)) AS t FROM assoc)
  WHERE lr > 0 AND (p >= 1 OR (ln(t) - lr / 2 + {POLY}) / ln(10) < log10(p)) AND feature_ix IN (SELECT feature_ix FROM kept)""", **(FEAT | {"assoc": LR})))
def joint_gate(s):
    """Variants that get the joint model: those whose population ratio passes for two expected by chance, in features that have feature variants."""
    return P.passes(assoc(s), 2.0).join(kept(s).select("feature_ix").distinct(), "feature_ix", "left_semi").select("feature_ix", "variant_ix")
