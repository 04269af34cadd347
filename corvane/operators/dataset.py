"""Normalise, hash, de-duplicate (first row wins), split, and the counts of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.hashing import SPLIT_SEED, bucket, fnv1a_fast, normalize, split_of


def hashed(df: DataFrame) -> DataFrame:
    """Adds norm and h; rows whose normalised text is empty are dropped. df: (..., text)."""
    return df.withColumn("norm", normalize(F.col("text"))).where("norm <> ''").withColumn("h", fnv1a_fast(F.col("norm")))


def dedup(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row per hash, the first by `order`: (doc_id, text, label, h, copies, conflicts).

    copies counts the later rows of the hash, conflicts those whose label is not the
    first row's. Partial aggregation keeps one candidate and four label counters per
    hash and task, so a hash of very many rows is no hot group. Null labels never conflict.
    """
    rows = hashed(df)
    first = F.min_by(F.struct(F.col(order).alias("doc_id"), "text", "label"), order)
    g = rows.groupBy("h").agg(first.alias("f"), F.count("*").alias("n"), *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(3)])
    agree = F.when(F.col("f.label") == 0, F.col("n0")).when(F.col("f.label") == 1, F.col("n1")).when(F.col("f.label") == 2, F.col("n2")).otherwise(F.lit(0))
    return g.select("f.doc_id", "f.text", "f.label", "h", (F.col("n") - 1).alias("copies"), F.when(F.col("f.label").isNull(), F.lit(0)).otherwise(F.col("n0") + F.col("n1") + F.col("n2") - agree).cast("bigint").alias("conflicts"))


def dedup_stats(df: DataFrame, order: str = "doc_id") -> DataFrame:
    return dedup(df, order).agg(F.count("*").alias("unique_rows"), F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicting_duplicates"))


def with_split(df: DataFrame, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds bucket and split to rows with h: 80 / 10 / 10 by (h xor seed) modulo 1000."""
    return df.withColumn("bucket", bucket(F.col("h"), seed)).withColumn("split", split_of(F.col("bucket")))


def split_rows(df: DataFrame, order: str = "doc_id", seed: int = SPLIT_SEED) -> DataFrame:
    """(doc_id, text, label, h, bucket, split) of the distinct rows."""
    return with_split(dedup(df, order).select("doc_id", "text", "label", "h"), seed)


def class_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
