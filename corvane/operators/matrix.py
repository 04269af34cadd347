"""Sparse matrices in long form (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def build(entries: DataFrame, rows: int, cols: int) -> DataFrame:
    """Non-zero entries; an index out of range raises."""
    ok = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    return entries.select(F.when(ok, F.col("row")).otherwise(F.raise_error(F.lit("matrix index out of range")).cast("bigint")).alias("row"), "col", "value").where("value <> 0")


def row_pointers(entries: DataFrame, rows: int) -> DataFrame:
    """(row, start, n): where each row starts in row order. Rows are numbered within chunks first, so no task sees them all but as one count per chunk."""
    spark = entries.sparkSession
    chunk = 1 << 16
    counts = spark.range(rows).withColumnRenamed("id", "row").join(entries.where("value <> 0").groupBy("row").agg(F.count("*").alias("n")), "row", "left").fillna(0, ["n"]).withColumn("chunk", F.floor(F.col("row") / chunk))
    before = counts.groupBy("chunk").agg(F.sum("n").alias("total"))
    offsets = before.withColumn("offset", F.coalesce(F.sum("total").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("chunk", "offset")
    inner = F.coalesce(F.sum("n").over(W.partitionBy("chunk").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.join(offsets, "chunk").select("row", (F.col("offset") + inner).alias("start"), "n")


def dot_rows(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, dot) of the rows with a weight for any of their columns. weights: (col, w)."""
    return entries.join(weights, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("w")).alias("dot"))
