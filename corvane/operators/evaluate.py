"""Confusion matrix and metrics of (actual, predicted) rows, over three fixed classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame) -> DataFrame:
    """(actual, predicted, n) for all nine cells; pairs with a class outside 0..2 are in none."""
    counts = df.where(F.col("actual").between(0, 2) & F.col("predicted").between(0, 2)).agg(*[F.count_if((F.col("actual") == a) & (F.col("predicted") == p)).alias(f"n{a}{p}") for a in range(3) for p in range(3)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n")) for a in range(3) for p in range(3)]))
    return counts.select(cells.alias("c")).select("c.*")


def _ratio(a, b):
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)


def _classes(df: DataFrame) -> DataFrame:
    """One row of counters, from one pass."""
    ok = F.col("actual").between(0, 2) & F.col("predicted").between(0, 2)
    cols = [F.count("*").alias("total"), F.count_if(F.col("actual") == F.col("predicted")).alias("correct")]
    for c in range(3):
        cols += [F.count_if(ok & (F.col("actual") == c) & (F.col("predicted") == c)).alias(f"hit{c}"), F.count_if(ok & (F.col("actual") == c)).alias(f"real{c}"), F.count_if(ok & (F.col("predicted") == c)).alias(f"said{c}")]
    return df.agg(*cols)


def _f1(c: int):
    p, r = _ratio(F.col(f"hit{c}"), F.col(f"said{c}")), _ratio(F.col(f"hit{c}"), F.col(f"real{c}"))
    return p, r, F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(0.0)


def class_metrics(df: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support); 0 where a denominator is 0."""
    rows = []
    for c in range(3):
        p, r, f = _f1(c)
        rows.append(F.struct(F.lit(c).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col(f"real{c}").alias("support")))
    return _classes(df).select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def summary(df: DataFrame) -> DataFrame:
    """One row: total_samples, accuracy, macro_f1, weighted_f1. An empty table gives zeros.

    Pairs outside the classes count in the total and the accuracy's denominator only.
    """
    f = [_f1(c)[2] for c in range(3)]
    support = F.col("real0") + F.col("real1") + F.col("real2")
    weighted = sum((f[c] * F.col(f"real{c}") for c in (1, 2)), f[0] * F.col("real0"))
    return _classes(df).select(F.col("total").alias("total_samples"), _ratio(F.col("correct"), F.col("total")).alias("accuracy"), ((f[0] + f[1] + f[2]) / 3).alias("macro_f1"), _ratio(weighted, support).alias("weighted_f1"))
