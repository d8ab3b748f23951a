"""The adapter's views in DuckDB's dialect, for checking queries against another engine."""

from __future__ import annotations

CHROM = "'chr' || CAST(1 + CAST(floor({0}) AS BIGINT) AS VARCHAR)"

VIEWS: dict[str, str] = {
    "samples": "SELECT CAST(n_nationkey AS BIGINT) AS sample_ix, n_name AS sample_id FROM nation",
    "features": f"SELECT s_suppkey AS feature_ix, s_name AS feature_id, {CHROM.format('s_suppkey / 10')} AS chrom, 2000 * s_suppkey + 999 AS tss FROM supplier",
    "exons": "SELECT feature_ix, chrom, 2000 * feature_ix + o.s AS \"start\", 2000 * feature_ix + o.e AS \"end\" FROM features, (VALUES (100, 799), (1200, 1899)) o(s, e)",
    "variants": f"""SELECT p_partkey AS variant_ix, {CHROM.format('p_partkey / 200')} AS chrom, 100 * p_partkey + 50 AS pos, 'rs' || p_partkey AS variant_id,
      CASE WHEN p_partkey % 37 = 0 THEN 'AT' ELSE substr('ACGT', 1 + p_partkey % 4, 1) END AS ref, substr('ACGT', 1 + (p_partkey + 1 + p_size % 3) % 4, 1) AS alt,
      CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE (50 + p_partkey % 50) / 100::DOUBLE END AS rsq, p_size FROM part""",
    "genotypes": """SELECT p_partkey AS variant_ix, n AS sample_ix, CAST((7 * p_partkey + 13 * n + 3) % 11 < 2 + p_size % 7 AS INT) AS h1,
      CAST((5 * p_partkey + 17 * n + 1) % 13 < 3 + p_size % 7 AS INT) AS h2 FROM part, range(25) r(n)""",
    "joined": "SELECT l.*, CAST(c_nationkey AS BIGINT) AS sample_ix FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "counts": "SELECT l_suppkey AS feature_ix, sample_ix, count(*) AS y FROM joined GROUP BY ALL",
    "as_counts": "SELECT l_partkey AS variant_ix, sample_ix, count(*) FILTER (WHERE l_linestatus = 'O') AS as_ref, count(*) FILTER (WHERE l_linestatus = 'F') AS as_alt FROM joined GROUP BY ALL",
    "totals": "SELECT sample_ix, CAST(sum(y) AS BIGINT) AS total FROM counts GROUP BY sample_ix",
    "size_factor": "SELECT sample_ix, total / avg(total) OVER () AS sf FROM totals",
    "offsets": "SELECT feature_ix, sample_ix, y, sf * (1 + ((feature_ix * 7 + sample_ix * 3) % 5) / 20::DOUBLE) AS k FROM counts JOIN size_factor USING (sample_ix)",
    "norm": "SELECT feature_ix, sample_ix, y, k / avg(k) OVER (PARTITION BY feature_ix) AS k FROM offsets",
    "covariates": "SELECT CAST(c_nationkey AS BIGINT) AS sample_ix, avg(c_acctbal) AS x1, avg(CAST(c_custkey % 17 AS DOUBLE)) AS x2 FROM customer GROUP BY 1",
    "gc": "SELECT s_suppkey AS feature_ix, ((s_suppkey * 37) % 101) / 101::DOUBLE AS gc FROM supplier",
    "rids": """SELECT *, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rid,
      100 * l_partkey + CAST(l_quantity AS BIGINT) AS pos1, 100 * l_partkey + CAST(l_quantity AS BIGINT) + 20 + 2 * CAST(l_quantity AS BIGINT) AS pos2, l_linenumber % 4 AS c FROM joined""",
    "inserts": "SELECT *, ['75M', '30M200N45M', '20M2I53M', '10S65M'][c + 1] AS cigar, pos2 + [75, 275, 73, 65][c + 1] - pos1 AS ins FROM rids",
    "alignments": f"""SELECT 'r' || rid AS qname, mate, CAST(CASE mate WHEN 1 THEN 99 ELSE 147 END + CASE WHEN l_orderkey % 23 = 0 THEN 256 ELSE 0 END AS INT) AS flag, {CHROM.format('l_partkey / 200')} AS chrom,
      CASE mate WHEN 1 THEN pos1 ELSE pos2 END AS pos, CAST(l_quantity AS INT) AS mapq, cigar, CASE WHEN l_orderkey % 29 = 0 THEN '*' ELSE '=' END AS rnext, CASE mate WHEN 1 THEN pos2 ELSE pos1 END AS pnext,
      CASE mate WHEN 1 THEN ins ELSE -ins END AS tlen, substr(repeat('ACGTTGCA', 12), 1 + l_orderkey % 8, 75) AS seq,
      ['XM:i:' || l_linenumber] || CASE WHEN l_returnflag <> 'N' THEN ['XO:i:1'] ELSE [] END || CASE WHEN l_orderkey % 3 = 0 THEN ['X0:i:2'] ELSE [] END AS tags, sample_ix
      FROM inserts, (VALUES (1), (2)) m(mate)""",
    "records": """SELECT variant_ix, chrom, pos, variant_id, ref, alt,
      CASE variant_ix % 4 WHEN 0 THEN 'VT=SNP;RSQ=0.' || (50 + variant_ix % 50) || ';AF=0.4' WHEN 1 THEN 'IMP2=0.2,0.8,0.01' WHEN 2 THEN 'DR2=0.7;VT=SNP' ELSE 'RSQ=0.9;DR2=0.' || (10 + variant_ix % 80) END AS info,
      CASE variant_ix % 4 WHEN 0 THEN 'GT:AS' WHEN 1 THEN 'GT:GL:AS' WHEN 2 THEN 'GT:DS:AS' ELSE 'AP:AS' END AS format FROM variants""",
    "raw_cells": """SELECT variant_ix, sample_ix, h1, h2, coalesce(as_ref, 0) AS as_ref, coalesce(as_alt, 0) AS as_alt,
      CASE WHEN (variant_ix + sample_ix) % 53 = 0 THEN '.' ELSE h1 || '|' || h2 END AS gt, coalesce(as_ref, 0) || ',' || coalesce(as_alt, 0) AS ct,
      CASE h1 + h2 WHEN 0 THEN '-0.1,-1,-4' WHEN 1 THEN '-2,-0.1,-1' ELSE '-4,-1,-0.1' END AS gl, CASE h1 + h2 WHEN 0 THEN '0.1' WHEN 1 THEN '1.1' ELSE '1.9' END AS ds,
      CASE WHEN h1 = 1 THEN '-0.05' WHEN sample_ix % 2 = 0 THEN '-5' ELSE '-1.3' END || ',' || CASE WHEN h2 = 1 THEN '-0.05' WHEN sample_ix % 2 = 0 THEN '-5' ELSE '-1.3' END AS ap
      FROM genotypes LEFT JOIN as_counts USING (variant_ix, sample_ix)""",
    "cells": "SELECT variant_ix, sample_ix, CASE variant_ix % 4 WHEN 0 THEN gt || ':' || ct WHEN 1 THEN gt || ':' || gl || ':' || ct WHEN 2 THEN gt || ':' || ds || ':' || ct ELSE ap || ':' || ct END AS cell FROM raw_cells",
}


def sql(body: str, **more: str) -> str:
    """A statement over the views; ``more`` adds views of its own, in order."""
    views = VIEWS | more
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + f" {body}"


def r(x: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"round(({x})::DOUBLE, {digits}) + 0.0"


def lgamma(x: str) -> str:
    return f"lgamma(({x})::DOUBLE)"


def lbeta(a: str, b: str) -> str:
    return f"({lgamma(a)} + {lgamma(b)} - {lgamma(f'({a}) + ({b})')})"
