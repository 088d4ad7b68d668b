"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stateflux.llm import bpe, divergence, exact_dedup, langid, licenses, merkle, near_dedup, packing, pfor, pii, quality, topk, warc
from stateflux.llm.common import load

BYTE_BPE, MULTI_BPE, WORD_BPE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def vocabulary(name: str) -> tuple[str, str]:
    """Where a public tokenizer's file is, and the pattern that splits texts for byte-level BPE."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(load(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), *vocabulary(BYTE_BPE), end=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), *vocabulary(MULTI_BPE))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.stored_ids(load(spark, sf_dir, "documents"), vocabulary(WORD_BPE)[0], None, end=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    profiles = langid.learned(docs, "text", "lang", ~langid.held_out())
    return langid.identified(docs.withColumn("held_out", langid.held_out()), profiles, "text", ["doc_id", "held_out"])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.audit(load(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_minhash, op3_packing, op4_quality, op5_exact_dedup, op6_bpe, op7_token_files, op8_warc, op9_licenses, op10_language_id, op11_merkle, op12_pii, op13_divergence)}
