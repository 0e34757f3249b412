"""Registered queries of this subpackage: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, lm, media, minhash, mixing, ngram_join, packing, quality, suffix, toxicity, trie, urls
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), size=1024, end_id=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = _remainder(3)
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=rest == 1)


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = _remainder(3)
    return quality.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=rest == 1)


def op4_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"), width=400, passages=51)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), held_out=_remainder(10) == 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def _remainder(n: int):
    """crc32 of the document's id as text, mod n; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_quality_crf, op4_hnsw_search, op5_media_columns, op6_mix_sources, op7_url_filter, op8_minhash_near_dedup, op9_suffix_array_dedup, op10_lm_scoring, op11_vector_codes, op12_conversation_trie, op13_ngram_join)}
ORACLES: dict[str, str] = {"op8_minhash_near_dedup": minhash.SQL, "op11_vector_codes": codes.sql(), "op12_conversation_trie": trie.SQL, "op13_ngram_join": ngram_join.SQL}
