"""The registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bpe, embedding_dedup, language, minhash_dedup, packing, quality, suffix_dedup, token_output, topk, toxicity
from inkveil.llm.common import documents, id_fold


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    ids = documents(spark, sf_dir).select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    both = ids.withColumn("decoded", bpe.decode(F.col("ids"), path))
    return both.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether labels of a document are not for learning; those of a null identifier never are."""
    return F.coalesce(id_fold(F.col("doc_id"), modulus) == remainder, F.lit(True)).alias("held_out")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_on_labels(docs, labels(spark, sf_dir), id_fold(F.col("doc_id"), 4) != 2)
    out = docs.select("doc_id", held_out(4, 2), quality.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.KEEP).cast("int"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output.shard_folder(spark)
    shards = token_output.write_shards(documents(spark, sf_dir), out, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_output.read_back(spark, out, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_on_labels(docs, labels(spark, sf_dir), id_fold(F.col("doc_id"), 5) != 0)
    out = docs.select("doc_id", held_out(5, 0), toxicity.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), words=2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit_on_documents(docs, id_fold(F.col("doc_id"), 5) != 0)
    said = docs.select("doc_id", held_out(5, 0), language.predict(F.col("text"), model).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_quality, op3_token_shards, op4_toxicity, op5_suffix_dedup, op6_embedding_dedup, op7_top_k, op8_minhash_dedup, op9_packing, op10_language)
}

ORACLE_SQL: dict[str, str] = {
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS p FROM e)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
edge AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 100 AS fresh FROM hit),
run AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM edge),
span AS (SELECT doc_id, r, min(p) AS a, max(p) + 100 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, r, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY r), 0) AS from_ FROM span),
cut AS (SELECT e.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY r) || substr(any_value(h), 2 * max(z) + 1) AS rest FROM gap JOIN e USING (doc_id) GROUP BY e.doc_id)
SELECT e.doc_id, e.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM e LEFT JOIN cut USING (doc_id)""",
    "op6_embedding_dedup": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id)::BIGINT AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(low, v.vec_id)) AS kept
FROM v LEFT JOIN reach ON reach.a = v.vec_id""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_minhash_dedup": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(low, n.doc_id)) AS kept
FROM n LEFT JOIN reach ON reach.a = n.doc_id""",
}
