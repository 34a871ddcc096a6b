"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.clustering import cluster_vectors, with_inertia
from parlance.llm.common import table
from parlance.llm.decontaminate import contamination
from parlance.llm.extraction import extract_text
from parlance.llm.importance import resample
from parlance.llm.merkle import fingerprint_documents
from parlance.llm.oracles import ORACLES  # noqa: F401 - for __spark_entry__
from parlance.llm.packing import pack_documents
from parlance.llm.quality import apply_rules
from parlance.llm.ranking import rank_documents
from parlance.llm.secrets import find_secrets, listing
from parlance.llm.setjoin import near_duplicates
from parlance.llm.sharding import shard_documents
from parlance.llm.toxicity import held_out, score_documents, train
from parlance.llm.warc import pages_round_trip
from parlance.session import ensure_checkpoint_dir, ship_package


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "kept", "n_grams", "log_weight", "key")


def op2_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_exact_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op6_winnowed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listing(F.col("spans"), "assign", "access", "hex").cast("binary"), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings"))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_automaton_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


_QUERIES = [op1_importance_resampling, op2_noisy_or, op3_boundary_chain, op4_exact_complement, op5_shingle_join, op6_winnowed_overlap, op7_token_efficiency, op8_divergence_rules, op9_ring_shards, op10_block_tree, op11_threshold_centroids, op12_automaton_rank, op13_merkle_fingerprints]


def _ready(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _ready(fn) for fn in _QUERIES}
