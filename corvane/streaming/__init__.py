"""Scoring of streams: vectorising and scoring are narrow, so the batch transforms serve a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.operators.predict import record
from corvane.operators.svm import LinearModel, score_arrays
from corvane.operators.vectorizer import VectorizerModel


def score_stream(stream: DataFrame, vectorizer: VectorizerModel, model: LinearModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Prediction records of a (streaming) table with a text column. Needs no state and no watermark."""
    if vectorizer.size != model.features:
        raise ValueError("vocabulary and model differ in size")
    scored = score_arrays(vectorizer.transform_arrays(stream, keep), model, keep)
    return record(scored, (*keep, "has_features"))
