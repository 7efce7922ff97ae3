"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read, word_count


def op1_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import ann_search

    vectors = read(spark, sf_dir, "embeddings")
    return ann_search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def quality_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_doc, weight): 2 for a document labelled good, 0.5 for one labelled bad; others are not listed."""
    good = F.max("quality")
    return read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("label_doc")).agg(F.when(good == 1, 2.0).when(good == 0, 0.5).alias("weight"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    rated = docs.join(quality_of(spark, sf_dir), F.col("doc_id") == F.col("label_doc"), "left")
    return mix_sources(rated, quality="weight", tie="tie").select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
l AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0)
         / (CASE good WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, (no - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS wsum,
         coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capahead,
         coalesce(sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wahead FROM w),
c AS (SELECT *, (total - capahead)::DOUBLE / (wsum - wahead)::DOUBLE > cap::DOUBLE / w AS capped FROM r),
f AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS capsum, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS free FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE least(w * ((total - capsum)::DOUBLE / free::DOUBLE), cap::DOUBLE) END AS target FROM f),
b AS (
  SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.budget, b.epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - ahead, 0), size))::BIGINT AS taken FROM p
"""


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import usable
    from .hamming import hamming_topk, sign_code

    codes = usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("id", sign_code("v").alias("code"))
    found = hamming_topk(codes, codes.filter("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP10_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id,
         list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS lo,
         list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 33)) ELSE 0 END))::BIGINT AS hi
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, (bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)))::INTEGER AS distance
  FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def op3_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score_texts

    docs = read(spark, sf_dir, "documents")
    scored = score_texts(docs, fold(F.col("doc_id"), 5) != 1)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op8_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read_back

    return archive_and_read_back(read(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_language_model, predict_language

    docs = read(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(fold(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")
    found = predict_language(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import find_runs

    return find_runs(read(spark, sf_dir, "documents"), repeat_tails=True, texts_out=False).withColumnRenamed("id", "doc_id")


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .part_codes import compress, with_label_errors

    found = compress(read(spark, sf_dir, "embeddings"), label_col="label")
    rows = with_label_errors(found.rows).withColumn("codebooks_sha256", F.lit(found.sha256))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds in full, each from all rows: entries ``b``, parts told ``t``."""
    gap = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    told = """
t{n} AS MATERIALIZED (
  SELECT x.no, x.p, arg_min(b.e, {d} * 1024 + b.e) AS e, min({d})::BIGINT AS far
  FROM x JOIN b{n} AS b ON x.p = b.p GROUP BY x.no, x.p)"""
    moved = """
b{next} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n} AS b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS v FROM (
      SELECT x.p, t.e, u.i, floor(sum(x.v[u.i])::DOUBLE / count(*))::BIGINT AS mean
      FROM x JOIN t{n} AS t ON x.no = t.no AND x.p = t.p CROSS JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM x))) AS i) AS u
      GROUP BY x.p, t.e, u.i) GROUP BY p, e) AS m ON b.p = m.p AND b.e = m.e)"""
    steps = [f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS no, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT no, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM k CROSS JOIN (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, no - 1 AS e, v FROM x WHERE no <= {entries})"""]
    for n in range(rounds):
        steps += [told.format(n=n, d=gap), moved.format(n=n, next=n + 1)]
    steps.append(told.format(n=rounds, d=gap))
    return ",".join(steps) + f""",
c AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(t.e)), 2, '0'), '' ORDER BY t.p) AS code, sum(t.far)::BIGINT AS error
  FROM k JOIN t{rounds} AS t ON k.no = t.no GROUP BY k.no, k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c
"""


QUERIES = {
    "op3_context_tree_score": op3_context_tree_score,
    "op4_toxicity": op4_toxicity,
    "op5_parity_join": op5_parity_join,
    "op6_pack_windows": op6_pack_windows,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_capture_index": op8_capture_index,
    "op9_language_id": op9_language_id,
    "op1_cross_polytope_search": op1_cross_polytope_search,
    "op2_mix_sources": op2_mix_sources,
    "op10_hamming_topk": op10_hamming_topk,
    "op11_weighted_fingerprints": op11_weighted_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_part_codes": op13_part_codes,
}
ORACLES = {"op2_mix_sources": OP2_SQL, "op10_hamming_topk": OP10_SQL, "op13_part_codes": _op13_sql()}
