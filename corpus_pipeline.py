"""From raw documents to packed windows: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import decontamination, langid, lines, minhash, packing
from portcullis.llm.lineage import cut
from portcullis.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no language (``und``: no text, or no letter in it) go; a null lang is filled in by the model.

    Rows are judged one by one, so null ids and repeated rows need no rule; an empty table stays empty. Where no row of
    the training folds has a lang there is no model, and documents with letters stay with the lang they have.
    """
    model = langid.fit(docs, ~langid.held_out())
    if model is None:
        return docs.select(*COLUMNS).where(langid.has_letter("text"))
    known = langid.identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays (by doc_id, null ones first); n_chars follows the text.

    Documents that lose every line go; those that had none (null or blank text) stay as they are. Rows equal in doc_id
    and text are treated alike.
    """
    kept = lines.dedup_lines(docs.select(*COLUMNS)).where("n_lines = 0 or n_dropped < n_lines")
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one of least doc_id (five-word shingles, similarity 0.8).

    Of rows equal in doc_id and text one stays. Rows of one doc_id and different texts are judged each by its own text:
    ids are replaced by row numbers of (doc_id, text) for the search. Null ids come last, and texts without words are
    like nothing but their own repetitions.
    """
    named = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    keys = cut(named.groupBy("doc_id", "th").agg(F.count("*").alias("n")))
    found = minhash.near_duplicates(named.select(F.col("th").alias("doc_id"), "text").where("text is not null"), size=5, part=80, whole=100)
    texts = found.select(F.col("doc_id").alias("th"), F.col("component_id").alias("c"), "n_shingles").distinct()
    # the first of each component of texts, by doc_id; a text without words stands for itself
    placed = keys.join(texts, "th", "left").withColumn("c", F.when(F.col("n_shingles") > 0, F.col("c")))
    heads = placed.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("head"))
    gone = placed.join(heads, "c").where("not (doc_id <=> head.doc_id and th = head.th)").select(F.col("doc_id").alias("gid"), F.col("th").alias("gth"))
    kept = named.join(gone, F.col("doc_id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left_anti")
    again = keys.where("n > 1").select("doc_id", "th").isEmpty()
    return (kept if again else kept.dropDuplicates(["doc_id", "th"])).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go.

    Rows are judged by their texts alone, so null and repeated ids are judged like others; null texts stay.
    """
    named = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    found = decontamination.contamination(named.select(F.col("th").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where(decontamination.contaminated()).select(F.col("doc_id").alias("gone")).distinct()
    return named.join(gone, F.col("th") == F.col("gone"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens; null texts are empty ones, and repeated rows are packed each."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: A SQL form would need the language model and the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
