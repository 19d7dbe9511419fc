"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import collocations, divergence, mtree, neargraph, oracles, packing, quality, rans, secrets, simhash, sketches, tokens, toxicity, transducer
from loamline.llm import pipeline as stages
from loamline.llm.base import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return assessed.select("doc_id", "lang", "perplexity", "most", "accepted")


def op4_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write_corpus(table(spark, sf_dir, "documents"), end_id=2)
    return rans.read_corpus(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document, from one encoding of the whole text."""
    return tokens.section_token_counts(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=0)


def op9_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digest(transducer.encode_and_decode(table(spark, sf_dir, "documents")))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


DEALT = [
    op1_document_fingerprints, op2_toxicity, op3_quality_classifier, op4_rans_token_files, op5_simhash_near_dedup, op6_token_counts, op7_exact_top_k,
    op8_best_fit_packing, op9_byte_bpe_transducer, op10_secret_scans, op11_collocations, op12_embedding_near_dedup, op13_source_divergence_audit, pipeline,
]
QUERIES = {f.__name__: f for f in DEALT}
ORACLES: dict[str, str] = {
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_embedding_near_dedup": oracles.NEAR_EMBEDDINGS,
    "op13_source_divergence_audit": oracles.DIVERGENCE,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
}
