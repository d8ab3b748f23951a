"""The operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fingerprint, jaccard, mixing, native, packing, pii, prefix_trie, secrets, token_files, topk, toxicity, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages")).drop("target_uri")


ORACLE["op1_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM f AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM f AND f IS NOT NULL THEN f END AS refers_to
FROM f
"""


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(common.table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE["op2_ngram_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), f AS (
  SELECT *, count(*) OVER (PARTITION BY g) AS c FROM e
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.c > 1 AND b.c > 1
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.y FROM r JOIN p ON r.other = p.x
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""


@query
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(common.table(spark, sf_dir, "documents"))


def fingerprint_sql(text: str, name: str) -> str:
    """``<name>_h`` numbers, then ``<name>`` with sums, p, lanes and n, in DuckDB."""
    fp = fingerprint
    words = lambda h: ", ".join(f"('0x' || substr({h}, {1 + 15 * k}, 15))::BIGINT" for k in range(fp.WORDS))
    total = lambda l, e: f"coalesce(list_sum(list_transform({l}, lambda w: {e})), 0)::BIGINT"
    wide = ", ".join(words(f"sha256(d || ':{i}')") for i in range(fp.WIDE // fp.WORDS))
    sums = ", ".join(f"({total('ph', f'w[{k + 1}] & {fp.LOW}')} & {fp.LOW}) + (({total('ph', f'w[{k + 1}] >> {fp.BITS}')} & {fp.LOW}) << {fp.BITS})" for k in range(fp.WIDE))
    lanes = ", ".join(total("sh", f"(w[{k + 1}] >> {j}) & {fp.ONE}") for k in range(fp.WORDS) for j in range(fp.BITS))
    return f"""{name}_h AS (SELECT *, list_transform(list_transform(list_filter(string_split_regex({text}, '\\. |\\n'), lambda s: length(s) > 0), lambda s: sha256(s)), lambda d: [{words("d")}]) AS sh,
    list_transform(list_transform(string_split({text}, chr(10)), lambda s: sha256(s)), lambda d: [{wide}]) AS ph FROM {name}_in),
{name} AS (SELECT * EXCLUDE (sh, ph), {{'sums': [{sums}], 'p': len(ph), 'lanes': [{lanes}], 'n': len(sh)}} AS {name} FROM {name}_h)"""


def likeness_sql(a: str, b: str) -> str:
    low, bits = fingerprint.LOW, fingerprint.BITS
    signed = lambda f: f"list_transform(flatten(list_transform({f}.lanes, lambda v: [v & {low}, v >> {bits}])), lambda c: (2 * c - {f}.n)::DOUBLE)"
    dot = lambda x, y: f"list_sum(list_transform(list_zip({signed(x)}, {signed(y)}), lambda q: q[1] * q[2]))"
    size = f"sqrt({dot(a, a)}) * sqrt({dot(b, b)})"
    return f"round(CASE WHEN {size} > 0 THEN least(1.0, greatest(0.0, {dot(a, b)} / ({size}))) WHEN {a}.n = 0 AND {b}.n = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 6) + 0.0"


def hex_sql(f: str) -> str:
    return f"{f}.p || ':' || {f}.n || ':' || array_to_string(list_transform({f}.sums, lambda v: printf('%015x', v)), '') || ':' || array_to_string(list_transform({f}.lanes, lambda v: printf('%x', v)), ',')"


ORACLE["op3_fingerprint"] = f"""
WITH fp_in AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {fingerprint_sql("text", "fp")},
l AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text,
    coalesce(lead(fp) OVER w, first_value(fp) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_fp
  FROM fp WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
),
ed_in AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM l), {fingerprint_sql("edited", "ed")}
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {hex_sql("fp")} AS fingerprint, {hex_sql("ed")} AS edited_fingerprint,
  {likeness_sql("fp", "ed")} AS near_edited, {likeness_sql("fp", "next_fp")} AS near_next
FROM ed
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_mixing"] = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS w, 3::HUGEINT * source_size AS cap, sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap * (10 // w), sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    sum(w) OVER (ORDER BY cap * (10 // w), sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w
), c AS (
  SELECT *, cap * w_left <= (total - caps_before) * w AS capped FROM o
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w *
    (CAST(total AS DOUBLE) - CAST(coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS DOUBLE)) / CAST(sum(w) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target FROM c
), b AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS full_epochs FROM t
), k AS (
  SELECT d.doc_id, d.size, b.source, b.source_size, b.target, b.full_epochs, CAST(floor(target) AS BIGINT) - full_epochs * source_size AS rest,
    md5('mix1:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(full_epochs * size + greatest(0, least(size, rest - coalesce(
  sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    s = toxicity.score(docs, model)
    return s.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def listed(d: DataFrame, base: list[str], kinds: list[str], more: list[str] | None = None) -> DataFrame:
    """``doc_id``, a count for each base kind, the digest of the base spans, and all spans."""
    return d.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base), F.sha2(native.listing(base), 256).alias("base_sha256"), native.listing(kinds).alias("spans"), *(more or []))


def found_sql(kind: str, pattern: str, group: int) -> str:
    """An array of (start, end, text, part) in DuckDB: what lies between matches gives their positions."""
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': list_sum(list_transform(p_{kind}[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m_{kind}[:i - 1], lambda x: length(x))), 0)::BIGINT, 't': m_{kind}[i], 'g': g_{kind}[i]}})"""


def spans_sql(table: str, rules: dict[str, tuple[str, int]], valid: dict[str, str], base: list[str], scores: dict[str, str] | None = None) -> str:
    """``doc_id``, counts, digest and spans in DuckDB; ``valid`` has the condition on a match x for each kind, ``scores`` its score."""
    esc = lambda p: p.replace("'", "''")
    first = ", ".join(f"regexp_extract_all(t, '{esc(p)}') AS m_{k}, string_split_regex(t, '{esc(p)}') AS p_{k}, regexp_extract_all(t, '{esc(p)}', {g}) AS g_{k}" for k, (p, g) in rules.items())
    second = ", ".join(f"{found_sql(k, p, g)} AS f_{k}" for k, (p, g) in rules.items())
    third = ", ".join(f"list_filter(f_{k}, lambda x: {valid[k]}) AS k_{k}" for k in rules)
    every = lambda kinds: "list_sort(" + " || ".join(f"list_transform(k_{k}, lambda x: {{'s': x.s, 'i': {i}, 'e': x.s + length(x.t), 'k': '{k}', 'n': {(scores or {}).get(k, '0')}}})" for i, k in enumerate(kinds)) + ")"
    text = lambda kinds: f"array_to_string(list_transform({every(kinds)}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    tenths = f", coalesce(array_to_string(list_transform({every([*rules])}, lambda x: x.n), ','), '') AS scores" if scores else ""
    counts = ", ".join(f"CAST(len(k_{k}) AS BIGINT) AS n_{k}" for k in base)
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}), b AS (SELECT *, {first} FROM a), c AS (SELECT doc_id, t, {second} FROM b),
d AS (SELECT doc_id, t, {third} FROM c)
SELECT doc_id, {counts}, sha256(coalesce({text(base)}, '')) AS base_sha256, coalesce({text([*rules])}, '') AS spans{tenths} FROM d
"""


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(secrets.scan(common.table(spark, sf_dir, "documents")), secrets.BASE, secrets.KINDS)


# the base patterns as their definition has them
ORACLE["op7_secrets"] = spans_sql(
    "documents",
    {k: (p, g) for k, (p, g, _) in secrets.RULES.items()} | {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2), "hex": ("[0-9a-f]+", 0)},
    {k: f"length(x.g) >= {n}" for k, (_, _, n) in secrets.RULES.items()},
    secrets.BASE,
)


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``scores``: those of all spans in tenths, in their order."""
    d = pii.detect(common.table(spark, sf_dir, "documents"))
    tenths = [F.transform(k, lambda s, i=i: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.round(10 * s["score"]).cast("int").alias("tenths"))) for i, k in enumerate(pii.KINDS)]
    scores = F.array_join(F.transform(F.array_sort(F.concat(*tenths)), lambda s: s["tenths"].cast("string")), ",")
    return listed(d.withColumn("scores", scores), [*pii.BASE], pii.KINDS, ["scores"])


LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({d})[i] AS INT) ELSE (CAST(reverse({d})[i] AS INT) * 2) // 10 + (CAST(reverse({d})[i] AS INT) * 2) % 10 END)) % 10 = 0"
BARE = "replace(x.t, ' ', '')"
TURNED = f"(substr({BARE}, 5) || substr({BARE}, 1, 4))"
MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split({TURNED}, ''), lambda c: CAST(CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INT))), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
DIGITS = "regexp_replace(x.t, '[^0-9]', '', 'g')"
AROUND = "lower(substr(t, greatest(1, x.s + 1 - 40), x.s + length(x.t) - greatest(1, x.s + 1 - 40) + 1 + 40))"
ORACLE["op8_pii"] = spans_sql(
    "documents",
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0),
        "card": (r"[0-9]([\x20-]?[0-9])+", 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0),
    }
    | pii.MORE,
    {
        "email": "true",
        "ip": "len(list_filter(string_split(x.t, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR TRY_CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN.format(d=DIGITS)}",
        "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
        "iban": f"CASE WHEN length({BARE}) BETWEEN 15 AND 34 THEN {MOD97} ELSE false END",
        "ssn": f"contains({AROUND}, 'ssn') OR contains({AROUND}, 'social')",
    },
    [*pii.BASE],
    {k: f"{round(10 * pii.PRIOR[k])} + CASE WHEN {' OR '.join(f"contains({AROUND}, '{w}')" for w in pii.CONTEXT[k])} THEN {round(10 * pii.BOOST)} ELSE 0 END" for k in pii.KINDS},
)


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page whose document has quality 0 or is toxic is bad."""
    pages = common.table(spark, sf_dir, "pages")
    bad = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(pages, urls.mined(pages, bad))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op10_topk"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(len(list_filter(list_zip(q.b, e.b), lambda z: z[1] <> z[2])) AS INT) AS distance
  FROM e q, e WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(common.table(spark, sf_dir, "conversations"))).drop("first_row", "last_row")


CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)"
ORACLE["op12_prefix_trie"] = f"""
WITH o AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, length(text)::BIGINT AS chars, sha256(strlen(role) || ':' || role || text)[:32] AS digest, turn FROM o
), p AS (
  SELECT conv_id, chars, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM t
), h AS (
  SELECT conv_id, ({CRC32.format(x="conv_id::VARCHAR")}) % 6 AS h FROM p GROUP BY conv_id
), r AS (
  SELECT h.conv_id, p, digest, chars FROM h JOIN p ON p.conv_id = h.conv_id - h.conv_id % 100 AND p <= h
  UNION ALL
  SELECT h.conv_id, p, digest, chars FROM h JOIN p ON p.conv_id = h.conv_id AND p > h
), l AS (
  SELECT h.conv_id, list(digest ORDER BY p) FILTER (WHERE p IS NOT NULL) AS k, list(chars ORDER BY p) FILTER (WHERE p IS NOT NULL) AS c FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id
), m AS (
  SELECT conv_id, d, coalesce(len(k), 0) AS size, array_to_string(coalesce(k, [])[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(k[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN c[d] ELSE 0 END AS chars
  FROM l, LATERAL (SELECT unnest(range(coalesce(len(k), 0) + 1)) AS d)
), n AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256 FROM m GROUP BY node
), k AS (
  SELECT n.*, coalesce(x.kids, 0) AS n_children FROM n LEFT JOIN (SELECT parent, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent) x ON n.node = x.parent
), s AS (
  SELECT node[:32 * d] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM k, LATERAL (SELECT unnest(range(depth + 1)) AS d) GROUP BY 1
)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s ON k.node = s.top LEFT JOIN k q ON k.parent = q.node
"""


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
