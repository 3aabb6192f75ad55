"""Corpus preparation: language ID, near-duplicate removal, passage dedup, mixing, tokenising.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, language_id, piece_codec, source_mixing, substring_dedup
from lodestone.llm.shared import bounded, cut, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a predicted language, which becomes their lang; texts without a letter or a clear language go."""
    predicted = language_id.predict(docs, language_id.fit(docs))
    return predicted.filter("lang_pred <> 'und' and score >= 0.5").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least by (doc_id, text), rows with a doc_id before those without.

    Rows are told apart by two hashes of doc_id and text (128 bits), so rows that share a doc_id, or have none, are judged one by one.
    Rows alike in both are copies of each other if they have a word, else they link with nothing and all stay.
    """
    key = ["row_key", "row_tag"]
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("row_tag", F.xxhash64(F.lit(1), "text", "doc_id"))
    groups = jaccard_join.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text", "row_tag"), tag="row_tag")
    linked = cut(groups.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("row_key"), F.col("tag").alias("row_tag"), F.col("component_id").alias("grp")).count())
    many = cut(linked.groupBy("grp").agg(F.sum("count").alias("n")).filter("n > 1").select("grp"))
    linked = cut(linked.join(bounded(many), "grp", "left_semi"))

    # the row to keep: by doc_id alone where that decides, else by text too
    ids = keyed.select(*key, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("id")).join(bounded(linked), key).select("grp", *key, "id").distinct()
    ids = cut(ids)
    first = ids.groupBy("grp").agg(F.min("id").alias("least"))
    first = cut(ids.join(first, "grp").filter("id = least").select("grp", *key))
    tied = cut(first.groupBy("grp").count().filter("count > 1").select("grp"))
    if not tied.isEmpty():
        texts = keyed.select(*key, "text").join(bounded(first.join(bounded(tied), "grp", "left_semi")), key)
        by_text = texts.groupBy("grp").agg(F.min(F.struct("text", *key)).alias("x")).select("grp", *(f"x.{k}" for k in key))
        first = cut(first.join(bounded(tied), "grp", "left_anti").unionByName(by_text))
    gone = cut(linked.select(key).join(first, key, "left_anti"))
    kept = keyed.join(bounded(gone), key, "left_anti")
    again = cut(linked.filter("count > 1").select(key).join(first, key, "left_semi"))
    if not again.isEmpty():  # rows alike in doc_id and text: one stays
        rows = kept.join(bounded(again), key, "left_semi").groupBy(key).agg(F.min(F.struct(*COLUMNS)).alias("x"))
        kept = kept.join(bounded(again), key, "left_anti").select(COLUMNS).unionByName(rows.select("x.*"))
    return kept.select(COLUMNS)


def shared_ids(docs: DataFrame) -> DataFrame:
    """The values of doc_id, null included, that more than one row has."""
    return cut(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("shared_id"), F.lit(True).alias("shared")))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; texts of which nothing is left go.

    Where rows share a doc_id, every row's place in the order of (doc_id, text) stands for its doc_id, so that they are dealt evenly.
    """
    placed = docs.withColumn("place", F.col("doc_id"))
    if not shared_ids(docs).isEmpty():
        ordered = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        placed = written(ordered.withColumn("place", F.monotonically_increasing_id()), "places")
    placed = placed.withColumnsRenamed({"doc_id": "id", "place": "doc_id"})
    kept = substring_dedup.remove_repeats(placed, carry=("id", "lang", "source"), verbatim=True)
    kept = kept.filter("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept_text")).withColumn("doc_id", F.col("id"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that tempered source weights ask for: every document at least once, no source over 1.5 times.

    Rows that share a doc_id are dealt by doc_id and text, so that they fall into different blocks.
    """
    shared = shared_ids(docs)
    named = docs.withColumn("id", F.col("doc_id"))
    if not shared.isEmpty():
        own = F.concat_ws(":", F.col("id").cast("string"), F.md5(F.col("text").cast("binary")))
        named = named.join(bounded(shared), F.col("id").eqNullSafe(F.col("shared_id")), "left")
        named = named.withColumn("doc_id", F.when(F.col("shared"), own).otherwise(F.col("id").cast("string"))).drop("shared", "shared_id")
    mixed = source_mixing.realised(source_mixing.mix(named, entropy=0.98, max_epochs=1.5))
    return mixed.withColumn("doc_id", F.col("id")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy's text, for training."""
    ids = piece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_tokens"), "decodes")


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("source_mixing", mixed_sources),
    ("piece_codec", encoded),
]

#: The language model and the encoder are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each reading what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
