"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents, and any others that
docs has, whatever their names. A null id passes; a null text is an empty
document, which passes until the mix, that takes no words of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.llm import minhash, mixing, packing, quality, suffix
from trussline.llm.common import flagged, table, written

#: No stage of this pipeline is one that SQL can express; the tests hold them against brute-force versions.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with names of our own for all columns that no stage works on, and what gives them their names back."""
    own = ("doc_id", "text", "source", "n_chars")
    names = {c: c if c in own else f"_extra_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()]), [F.col(k).alias(c) for c, k in names.items()]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good; it learns from all labels. Documents without a line have nothing to judge and pass."""
    docs, back = _plain(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    scored = quality.document_quality(docs, table(spark, sf_dir, "labels"), held_out=F.lit(False), keep_columns=("text", *rest))
    return scored.where("predicted = 1 or text is null or not text rlike '[^\\r\\n]'").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest id.

    Documents without words have no duplicates. Rows that share an id are one document and stay together.
    """
    docs, back = _plain(docs)
    dropped = written(minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "dropped")
    rows = flagged(docs, "doc_id", dropped, "_gone")
    # Only rows that the filter can't clear take part in the exact join.
    doubtful = rows.where("_hit").join(dropped, F.col("doc_id") == F.col("_gone"), "leftanti")
    return rows.where("not _hit").select(*back).unionByName(doubtful.select(*back))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 256 bytes (some 40 words) found elsewhere cover; n_chars follows."""
    docs, back = _plain(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix.suffix_dedup(docs, width=256, with_text=True, carry=rest)
    return cut.select("doc_id", F.col("kept_text").alias("text"), *rest, F.length("kept_text").cast("long").alias("n_chars")).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole repetitions, and for the one on which a source's target falls its first words."""
    docs, back = _plain(docs)
    mixed = mixing.mix_sources(docs, weights=(5, 2, 1), epochs=3, keep=docs.columns)
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.where("taken > 0").select(*docs.columns, "size", F.explode(copies).alias("_words"))
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1)), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("size"), first_words).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.best_fit_packing(docs, size=1024, end_id=2)


STAGES = [("quality classifier", classify), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", remove_repeats), ("mixing sources to target weights", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
