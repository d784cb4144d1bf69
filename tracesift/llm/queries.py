"""Queries opN_<name>: each operator with its production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import embedding, langid, mixing, neardup, packing, secrets, substrings, topk, toxicity, urlfilter
from tracesift.llm.scratch import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold_of(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def dated_list(pages: DataFrame) -> DataFrame:
    """A block list made from the pages' own hosts by rule: hosts, parent domains and first path segments come and go."""
    host, first = urlfilter.host_of(F.col("url")), F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*(/[^/?#]+)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    keys = pages.select(F.explode(F.array(host, domain, F.concat(host, first))).alias("key")).where("key <> ''").distinct()
    n = keys.select("key", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long").alias("n")).where("n % 4 = 0")
    day = lambda e: F.expr(f"CAST(date_add(DATE'2024-01-01', CAST({e} AS INT)) AS TIMESTAMP)")
    moves = F.array(
        F.struct(day("n % 250").alias("at"), F.lit("add").alias("action")),
        F.struct(day("n % 250 + 10 + n DIV 7 % 90").alias("at"), F.lit("remove").alias("action")),
        F.struct(F.when(F.col("n") % 3 == 0, day("n % 250 + 120")).alias("at"), F.lit("add").alias("action")),
    )
    return n.select("key", F.explode(moves).alias("m")).select("key", "m.at", "m.action").where("at IS NOT NULL")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page at its fetch time against the dated list: page_id, host, fetched, blocked, entry, since. A null URL matches nothing."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("CAST(date_add(DATE'2024-01-01', CAST(page_id * 37 % 365 AS INT)) AS TIMESTAMP)").alias("fetched"))
    out = urlfilter.evaluate(pages, dated_list(pages))
    return out.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "blocked", "entry", F.date_format("since", "yyyy-MM-dd").alias("since"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')) AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^/?#]*(/[^/?#]+)', 1), '') AS seg
  FROM pages),
k AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM p UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM p UNION ALL SELECT host || seg FROM p)
  WHERE key <> ''),
n AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM k),
e AS (
  SELECT key, DATE '2024-01-01' + CAST(n % 250 AS INTEGER) AS moved, 1 AS on_ FROM n WHERE n % 4 = 0
  UNION ALL SELECT key, DATE '2024-01-01' + CAST(n % 250 + 10 + (n // 7) % 90 AS INTEGER), 0 FROM n WHERE n % 4 = 0
  UNION ALL SELECT key, DATE '2024-01-01' + CAST(n % 250 + 120 AS INTEGER), 1 FROM n WHERE n % 4 = 0 AND n % 3 = 0),
i AS (
  SELECT key, moved AS valid_from, lead(moved) OVER (PARTITION BY key ORDER BY moved) AS valid_to, on_
  FROM (SELECT *, coalesce(lag(on_) OVER (PARTITION BY key ORDER BY moved), 0) AS was FROM (SELECT key, moved, min(on_) AS on_ FROM e GROUP BY ALL)) WHERE on_ <> was),
m AS (
  SELECT p.page_id, i.key, i.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.key) DESC, i.key DESC) AS r
  FROM p JOIN i ON on_ = 1 AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
   AND (('.' || host) LIKE ('%.' || split_part(i.key, '/', 1)))
   AND (strpos(i.key, '/') = 0 OR starts_with(path || '/', substr(i.key, strpos(i.key, '/')) || '/')))
SELECT p.page_id, host, strftime(fetched, '%Y-%m-%d') AS fetched, m.key IS NOT NULL AS blocked, m.key AS entry, strftime(valid_from, '%Y-%m-%d') AS since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND r = 1
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors of each vec_id divisible by 100, by integer inner product. Vectors null or with null or non-finite components take no part."""
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 100 == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.t, v.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of whole texts: three words, 85 of 100. Null and wordless texts have 0 shingles and are linked with nothing."""
    return neardup.classes(_table(spark, sf_dir, "documents"), width=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def _neardup_sql(width: int, num: int, den: int) -> str:
    """CTEs: w (words), g (shingles), n (set sizes), c (component of each doc_id that has links), by plain pairs."""
    parts = " || chr(31) || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (
  SELECT DISTINCT doc_id, {parts} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM w WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, array_to_string(w, chr(31)) FROM w WHERE len(w) BETWEEN 1 AND {width - 1}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * n_both >= {num} * (x.n + y.n - n_both)),
r(id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT * FROM documents), {_neardup_sql(3, 85, 100)}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from four folds of five; ``und`` with score 0 for null texts and those without a letter."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learn(docs, fold_of(5) != 0))
    return out.select("doc_id", F.coalesce(fold_of(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text by kind and place; a null text has none."""
    docs = _table(spark, sf_dir, "documents")
    # as over two deliveries: the first had a share of the versions and the base rules; the second has all versions and rules,
    # and scans what the ledger hasn't seen. Every version meets every rule
    ledger = cut(secrets.scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0), rules=secrets.BASE))
    found = secrets.findings(docs, ledger.union(cut(secrets.scan(docs, ledger))))
    n = lambda k: F.size(F.filter("spans", lambda s: s["no"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["no"] < len(secrets.BASE))
    out = found.select("doc_id", "spans", base.alias("base"))
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.described("base"), 256).alias("base_sha256"), secrets.described("spans").alias("spans"))


def _any_case(pattern: str) -> str:
    """RE2 folds beyond ASCII, so letters of either case are spelled out."""
    head, tail = pattern[len("((?i:") :].split("))", 1)
    return "(" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail


def _spans_sql() -> str:
    """CTE f (doc_id, no, s, e): spans of d(doc_id, text)."""
    rows = []
    for no, r in enumerate(secrets.RULES):
        p = (_any_case(r.pattern) if "(?i:" in r.pattern else r.pattern).replace("'", "''")
        least = f"length(regexp_extract(h, '{p}', {r.group})) >= {r.least}" if r.least else "true"
        rows.append(f"""SELECT doc_id, {no} AS no, stop - length(h) AS s, stop AS e FROM (
  SELECT doc_id, h, sum(length(h) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(h) AS h, unnest(g[1:len(h)]) AS g, generate_subscripts(h, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}', 0) AS h, string_split_regex(coalesce(text, ''), '{p}') AS g FROM d) WHERE len(h) > 0)) WHERE {least}""")
    return "f AS (" + "\nUNION ALL ".join(rows) + ")"


_KINDS = "[" + ", ".join(f"'{r.name}'" for r in secrets.RULES) + "]"
OP5_SQL = f"""
WITH d AS (SELECT * FROM documents), {_spans_sql()},
a AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg({_KINDS}[no + 1] || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER (no < 3) AS base,
  string_agg({_KINDS}[no + 1] || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from three folds of four; null and empty texts get the score of a text without a hit."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), fold_of(4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold_of(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _crc32(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4").tobytes()
    return pa.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.int64())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of every whole text and their places in sequences of 4,096; a null text is the end id alone."""
    pieces = packing.tokenise(_table(spark, sf_dir, "documents"), tokenizer_path(), keep=_crc32).withColumnRenamed("ids", "ids_crc32")
    return packing.pack(cut(pieces))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that are covered by a run of 50 that also starts in a smaller document; null texts have none."""
    return substrings.removed(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN m USING (h) WHERE least < doc_id),
y AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(len(gone), 0) AS n_removed, len(w) AS n_words,
  CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE k.t END AS kept
  FROM w LEFT JOIN y USING (doc_id) LEFT JOIN (
    SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY p) FILTER (x.p IS NULL), '') AS t
    FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM y)) u LEFT JOIN x USING (doc_id, p) GROUP BY doc_id) k USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; null texts have size 0, a null source is one of its own, the last."""
    return mixing.take(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _mix_sql(docs: str, extra: str = "") -> str:
    """CTE t (doc_id, size, source_size, target, taken and ``extra`` columns) over the named relation."""
    return rf"""
z AS (SELECT doc_id, source, {extra}len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM {docs}),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM z GROUP BY source),
v AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rank % 3 + 1] AS w FROM s),
u AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
q AS (SELECT *, cap / w <= level AS full_, arg_min(level, [cap / w, rank]) FILTER (NOT cap / w <= level) OVER () AS common FROM u),
b AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE common * w END AS target FROM q),
e AS (SELECT z.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
   coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source),
t AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS taken FROM e)"""


OP9_SQL = f"""
WITH {_mix_sql("documents")}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken FROM t
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links and component of every vector at a cosine of 0.9; unusable vectors link with nothing."""
    return embedding.classes(_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM e LEFT JOIN n ON a = vec_id LEFT JOIN c ON c.id = vec_id
"""

QUERIES = {
    "op1_url_filters": op1,
    "op2_exact_topk": op2,
    "op3_minhash_neardup": op3,
    "op4_language_id": op4,
    "op5_secret_scans": op5,
    "op6_toxicity": op6,
    "op7_best_fit_packing": op7,
    "op8_substring_dedup": op8,
    "op9_source_mixing": op9,
    "op10_embedding_neardup": op10,
}
ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op2_exact_topk": OP2_SQL,
    "op3_minhash_neardup": OP3_SQL,
    "op5_secret_scans": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_source_mixing": OP9_SQL,
    "op10_embedding_neardup": OP10_SQL,
}
