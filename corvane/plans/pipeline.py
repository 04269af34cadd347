"""Whole runs: train, evaluate and predict over tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corvane.operators import dataset, evaluate, predict, svm, vectorizer
from corvane.sources.labelled import read_labelled


@dataclass
class Trained:
    vectorizer: vectorizer.VectorizerModel
    model: svm.LinearModel
    history: list
    test: DataFrame


def split(reviews: DataFrame, order: str = "doc_id", strict: bool = False) -> DataFrame:
    """Labelled source -> distinct rows with split."""
    return dataset.split_rows(read_labelled(reviews, keep=(order,), strict=strict).withColumnRenamed(order, "doc_id"))


def train(rows: DataFrame, params: vectorizer.VectorizerParams = vectorizer.VectorizerParams(), epochs: int = svm.EPOCHS, rate_scale: float = 1.0) -> Trained:
    """Fit the vocabulary on the train split only, train, keep the best weights by validation, evaluate on test."""
    part = {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}
    v = vectorizer.fit(part["train"], params)
    arrays = {s: v.transform_arrays(p, ("doc_id", "label")) for s, p in part.items()}
    model, history = svm.fit(arrays["train"], arrays["validation"], v.size, epochs, rate_scale)
    return Trained(v, model, history, evaluate_model(arrays["test"], model))


def evaluate_model(arrays: DataFrame, model: svm.LinearModel) -> DataFrame:
    """One-row metrics of (doc_id, label, indices, values); rows without features are scored by the bias."""
    scored = svm.score_arrays(arrays, model, ("doc_id", "label"))
    record = predict.record(scored.withColumnRenamed("label", "actual"), ("doc_id", "actual"))
    return evaluate.summary(record.select("actual", F.col("label").alias("predicted")))


def predict_texts(docs: DataFrame, v: vectorizer.VectorizerModel, model: svm.LinearModel, keep: tuple[str, ...] = ("doc_id",), empty: str = "flag") -> DataFrame:
    """Prediction records with has_features; a vocabulary of another size than the model raises.

    Texts without a known feature are scored by the bias and flagged, or with `empty="raise"` an error.
    """
    if v.size != model.features:
        raise ValueError("vocabulary and model differ in size")
    if empty not in ("flag", "raise"):
        raise ValueError("empty must be flag or raise")
    out = predict.record(svm.score_arrays(v.transform_arrays(docs, keep), model, keep), (*keep, "has_features"))
    if empty == "raise":
        known = F.when(F.col("has_features"), F.lit(True)).otherwise(F.raise_error(F.lit("a text holds no known feature")).cast("boolean"))
        out = out.withColumn("has_features", known)
    return out
