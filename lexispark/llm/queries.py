"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import alignment, decontamination, maxscore, mixing, neardup, packing, periodic, quality, secrets, suffixes, tokens, toxicity, warc
from lexispark.llm.common import WORD

#: The tokenizer file that op3 uses, and the installed package that knows its place.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.filter(F.col("record_type") != "gap").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """The contract's rewriting: where h % 10 is 0, the n words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("_words"), F.floor(h / 10)
    a = F.pmod(g, n)
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(i < a, i).otherwise(a + F.pmod(i - a, period)).cast("int")))
    # Only the texts to be rewritten are split here.
    planted = F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", planted.alias("_words"))
    return rows.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(_with_planted_periods(table(spark, sf_dir, "documents")))
    # The longest run; of those, the first, then that of the smallest period.
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict:
    import corpus_pipeline

    ops = [op1_mixing, op2_quality, op3_tokens, op4_suffixes, op5_secrets, op6_neardup, op7_warc, op8_maxscore, op9_decontamination, op10_toxicity, op11_periodic, op12_alignment, op13_packing]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || left(md5('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS hash FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * max(level) FILTER (level <= ratio) OVER ()) AS target FROM levels),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
passed AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
buckets AS (
  SELECT source, hash // 65536 AS bucket, sum(size) AS in_bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash // 65536) AS upto, any_value(extra) AS extra
  FROM passed GROUP BY source, hash // 65536),
cuts AS (SELECT source, min(bucket) FILTER (upto > extra) AS cut FROM buckets GROUP BY source)
SELECT p.doc_id, p.size, p.source_size, p.target,
  (p.size * (p.whole + CASE WHEN p.extra > 0 AND p.size > 0 AND (c.cut IS NULL OR p.hash // 65536 < c.cut OR (p.hash // 65536 = c.cut AND p.words + p.size / 2 <= p.extra)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM passed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
"""

_WARC = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(html) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM pages)
"""

_MAXSCORE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_SECRETS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT doc_id, text, kind, rank, least_size, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS m, regexp_extract_all(text, pattern, grp) AS v
  FROM t, (VALUES
    ('assign', 0, 8, 2, '((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('access', 1, 16, 0, 'AKIA[A-Z0-9]+'),
    ('hex', 2, 32, 0, '[0-9a-f]{32,}'),
    ('entropy', 3, 20, 0, '[A-Za-z0-9+/_=-]{20,}')) AS k(kind, rank, least_size, grp, pattern)),
one AS (SELECT doc_id, kind, rank, least_size, gaps, m, v, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, kind, rank, m[i] AS found,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
  FROM one WHERE length(v[i]) >= least_size),
placed AS (SELECT *, s + length(found) AS e FROM spans),
base AS (SELECT * FROM placed WHERE rank < 3),
entropic AS (
  SELECT p.* FROM placed p WHERE rank = 3
    AND regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]')
    AND NOT regexp_matches(found, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND NOT regexp_matches(found, '(?i)example|placeholder|changeme|dummy|your[-_]?(key|token)|xxxxx|00000')
    AND NOT regexp_matches(found, '0123456789|(?i)abcdefghij')
    AND NOT regexp_matches(found, '^[0-9+/_=-]+$')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s < p.e AND p.s < b.e)
    AND round(list_max(list_transform(range(1, length(found) - 18), lambda i: list_entropy(string_split(substring(found, i, 20), '')))), 9)
      >= CASE WHEN regexp_matches(found, '^[0-9a-fA-F]+$') THEN 2.9 WHEN regexp_matches(found, '^[A-Za-z0-9]+$') THEN 3.6 ELSE 3.8 END),
every AS (SELECT * FROM base UNION ALL SELECT * FROM entropic),
joined AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (doc_id)
"""


#: Equal words three in a row at a distance of q, in stretches without a gap, are the words that repeat with period q.
_PERIODIC = r"""
WITH bits AS (
  SELECT doc_id, text, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(substring(doc_id::VARCHAR, i, 1)) >> b) & 1))) AS bits
  FROM documents),
hashed AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bits::BIGINT[]), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS h
  FROM bits),
places AS (SELECT *, len(words)::BIGINT AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM hashed),
shaped AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM places),
word AS (
  SELECT row, i, CASE WHEN p IS NULL OR i < a THEN words[i + 1] ELSE words[1 + a + (i - a) % p] END AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM shaped)),
three AS (
  SELECT row, i, hash(w, lead(w) OVER o, lead(w, 2) OVER o) AS t FROM word WINDOW o AS (PARTITION BY row ORDER BY i)
  QUALIFY lead(w, 2) OVER o IS NOT NULL),
pairs AS (SELECT x.row, y.i - x.i AS q, x.i FROM three x JOIN three y ON x.row = y.row AND x.t = y.t AND x.i < y.i),
stretches AS (
  SELECT row, q, min(i) AS start, count(*) + 2 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island),
runs AS (SELECT row, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
each AS (
  SELECT row, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT s.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.l AS length, best.p AS period, (1000 * best.l) // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM shaped s LEFT JOIN each USING (row) LEFT JOIN kept USING (row)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op1_mixing": _MIX, "op5_secrets": _SECRETS, "op7_warc": _WARC, "op8_maxscore": _MAXSCORE, "op11_periodic": _PERIODIC}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
