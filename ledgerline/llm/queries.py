"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, divergence, fingerprint, jaccard, licenses, lm, mixing, packing, pii, secrets, token_count, topk, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"))


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(table(spark, folder, "embeddings"))


def op6_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), kept_bytes=128 << 20)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scans": op3_secret_scans,
    "op4_fingerprints": op4_fingerprints,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_lm_scores": op6_lm_scores,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scans": op9_license_scans,
    "op10_source_mix": op10_source_mix,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_divergence": op12_source_divergence,
    "op13_personal_data": op13_personal_data,
    "pipeline": pipeline,
}

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM w
), n AS (
  SELECT w.doc_id, count(sh.doc_id) AS n FROM w LEFT JOIN sh ON sh.doc_id = w.doc_id GROUP BY w.doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS key FROM d GROUP BY source
), w AS (
  SELECT *, [1.0, 2.0, 3.0][(key - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s
), c AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), g AS (
  SELECT *, CASE WHEN level > cap / weight THEN cap ELSE least(cap, weight * (SELECT arg_min(level, cap / weight) FROM c WHERE level <= cap / weight)) END AS target FROM c
), b AS (
  SELECT *, CAST(greatest(16, least(4096, total // 65536)) AS BIGINT) AS block FROM g
), h AS (
  SELECT *, CAST(greatest(ceil(source_size / block), least(source_size, 64)) AS BIGINT) AS blocks FROM b
), i AS (
  SELECT *, source_size // nullif(blocks, 0) AS words, source_size - source_size // nullif(blocks, 0) * blocks AS longer, coalesce(least(CAST(round(target * blocks / nullif(source_size, 0)) AS BIGINT), 3 * blocks), 0) AS slots FROM h
), m AS (
  SELECT key, block_no, slots // blocks + CASE WHEN block_no < slots % blocks THEN 1 ELSE 0 END AS times, block_no * words + least(block_no, longer) AS low, (block_no + 1) * words + least(block_no + 1, longer) AS high
  FROM (SELECT *, unnest(range(blocks)) AS block_no FROM i WHERE blocks > 0)
), p AS (
  SELECT d.doc_id, d.size, i.source_size, i.target, i.key, CAST(sum(d.size) OVER (PARTITION BY i.key ORDER BY md5('mix:' || d.doc_id), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS begins
  FROM d JOIN i ON i.source IS NOT DISTINCT FROM d.source
), y AS (
  SELECT p.doc_id, sum((least(p.begins + p.size, m.high) - greatest(p.begins, m.low)) * m.times) AS taken FROM p JOIN m ON m.key = p.key AND m.low < p.begins + p.size AND m.high > p.begins GROUP BY p.doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(y.taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN y ON y.doc_id = p.doc_id
"""

#: One round of the codebooks: parts to their nearest entry, entries to the floor of their parts' mean.
ROUND = """a{n} AS (
  SELECT vec_id, label, part, v, entry, d FROM (
    SELECT p.vec_id, p.label, p.part, p.v, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT AS d
    FROM p JOIN b{n} b ON b.part = p.part
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
)"""
MOVE = """b{m} AS (
  SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM b{n} b LEFT JOIN (
    SELECT part, entry, list(x ORDER BY i) AS v FROM (
      SELECT part, entry, i, CAST(floor(sum(v[i])::HUGEINT / count(*)) AS BIGINT) AS x FROM a{n}, unnest(range(1, len(v) + 1)) t(i) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) s ON s.part = b.part AND s.entry = b.entry
)"""
CODES = (
    """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v FROM k, unnest(range(16)) t(part)
), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64
), b0 AS (SELECT p.part, f.entry, p.v FROM p JOIN f ON f.vec_id = p.vec_id
), """
    + ", ".join([ROUND.format(n=0), MOVE.format(n=0, m=1), ROUND.format(n=1), MOVE.format(n=1, m=2), ROUND.format(n=2)])
    + """, c AS (
  SELECT vec_id, any_value(label) AS label, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""
)

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT id, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, source, t.term
), v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang
), g AS (SELECT g.lang, g.source, any_value(v.v) AS v, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.n)::BIGINT + 2)) // (any_value(l.n) + 2 * any_value(l.v)) AS q
  FROM c JOIN (SELECT lang, sum(n)::BIGINT AS n, any_value(v) AS v FROM g GROUP BY lang) l ON l.lang = c.lang GROUP BY c.lang, c.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (
    SELECT x.lang, x.source AS one, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY x.lang, x.source, y.source
  ) s ON s.lang = a.lang AND s.one = a.source AND s.other = b.source GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.count > 0 AND p.p > q.q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op5_exact_top_k": TOP_K, "op8_jaccard_join": JACCARD, "op10_source_mix": MIX, "op11_vector_codes": CODES, "op12_source_divergence": DIVERGENCE}
