"""The prediction record: label, scores, probabilities, confidence, margin, level, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.scores import argmax, label_name, level, margin, policy, softmax


def record(scored: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A narrow projection of (keep..., s0, s1, s2); it runs on streams as on tables."""
    s = [F.col(f"s{c}") for c in range(3)]
    base = scored.select(*keep, *s, argmax(s).alias("label"), *[p.alias(f"p{c}") for c, p in enumerate(softmax(s))], margin(s).alias("margin"))
    confidence = F.element_at(F.array("p0", "p1", "p2"), F.col("label") + 1)
    full = base.withColumn("confidence", confidence).withColumn("score", F.element_at(F.array("s0", "s1", "s2"), F.col("label") + 1))
    return full.select(*keep, "label", label_name(F.col("label")).alias("label_name"), "s0", "s1", "s2", "p0", "p1", "p2", "score", "confidence", "margin", level(F.col("confidence")).alias("level"), policy(F.col("confidence"), F.col("margin")).alias("policy"))
