"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() hands each stage's rows on as Parquet in the shared checkpoint folder, and deletes what a stage has read once its own rows are written.

Defined cases: a null text is an empty one, which the first stage rejects; a null doc_id is a key of its own, and rows without one, or with one that other rows have, are each judged
and packed for themselves; a null source is a source; of equal texts the row with the least doc_id stays; an empty table gives empty tables and an empty result; a text of any length is
worked on whole; extra columns pass to the mix untouched, and the last stage reads the key, source and text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.llm.common import read_table, removed, scratch, shared_path, staged
from codonspark.llm.decontaminate import decontaminate
from codonspark.llm.mixing import mixed_documents
from codonspark.llm.ngrams import jaccard_components
from codonspark.llm.quality import quality_filter
from codonspark.llm.sharding import shard
from codonspark.llm.simhash import components, near_duplicates

SHARDS = 40
#: Words of a shingle, and percent of Jaccard similarity, of near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least doc_id, rows without one last, then the least text hash. Rows are named by an id of their own, so different texts under one doc_id or none are each judged for themselves.

    Rows link whose SimHash fingerprints over five-word shingles differ in three bits at most, which joins large groups of copies at once, or whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, which the anchors of three bits can't reach and an exact join finds whole.
    """
    named = staged(docs.withColumn("__row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), F.col("__row").alias("row"))
    keyed, path = named.select("__row", "text"), shared_path(spark, "staged")
    with scratch(spark):  # what the two paths have written goes as soon as the rows to drop are known
        near = near_duplicates(keyed, key="__row", words=NEAR_WORDS).select("__row", "component_id")
        alike = jaccard_components(keyed, key="__row", words=NEAR_WORDS, percent=NEAR_PERCENT).select("__row", "component_id")
        roots = components(near.union(alike).select(F.col("__row").alias("a"), F.col("component_id").alias("b")))
        members = roots.union(roots.select("root", "root").distinct())  # a root has no row of its own
        placed = named.select("__row", order.alias("place")).join(members, F.col("__row") == F.col("node"))
        first = placed.groupBy("root").agg(F.min("place").alias("first"))
        gone = staged(placed.join(first, "root").where("first.row <> __row").select("__row"), path)
    return named.join(gone, "__row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, with the words that the pass takes."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix; size in UTF-8 bytes."""
    sized = docs.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shard(sized, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Fingerprints and pseudorandom draws can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
