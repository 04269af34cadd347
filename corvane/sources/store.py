"""Split cache, vocabulary and model as tables, each with a one-row manifest that is checked on reading."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.hashing import SPLIT_SEED, signed
from corvane.operators.svm import LinearModel
from corvane.operators.vectorizer import VectorizerModel

CACHE_VERSION = 3
MAX_TEXT_BYTES = 10_000_000
MAX_TERM_BYTES = 1_000_000


def file_state(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(bytes, newest modification time) of a table's files, from file metadata."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    r = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"), F.max("file_modification_time").cast("string").alias("time")).first()
    return r["size"], r["time"]


def write_cache(rows: DataFrame, path: str, source: str | None = None, seed: int = SPLIT_SEED) -> None:
    """Split rows (text, label, split, ...) partitioned by split, and the manifest with the counts of each."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    counts = {r["split"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("split").count().collect()}
    size, time = file_state(spark, source) if source else (0, None)
    values = (CACHE_VERSION, size, time, signed(seed), *(counts.get(s, 0) for s in ("train", "validation", "test")))
    spark.createDataFrame([values], "version int, dataset_size bigint, dataset_timestamp string, split_seed bigint, train_rows bigint, validation_rows bigint, test_rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def paths(base: str, name: str = "model") -> dict[str, str]:
    """Where the tables of a run stand below a base folder."""
    base = base.rstrip("/")
    return {"cache": f"{base}/cache", **{k: f"{base}/{name}/{k}" for k in ("vocabulary", "weights", "report", "metrics")}}


def _counts(spark: SparkSession, path: str) -> dict[str, int] | None:
    """Rows of each split of a cache, or None where there is none."""
    try:
        return {r["split"]: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("split").count().collect()}
    except AnalysisException:
        return None


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest's row, or None where there is no manifest."""
    try:
        table = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        return None
    row = table.first()
    return row.asDict() if row else None


def cache_is_valid(spark: SparkSession, path: str, source: str | None = None, seed: int = SPLIT_SEED) -> bool:
    """Whether version, source size and time, seed and the stored counts all hold."""
    m = read_manifest(spark, path)
    if m is None or m["version"] != CACHE_VERSION or m["split_seed"] != signed(seed):
        return False
    if source and (m["dataset_size"], m["dataset_timestamp"]) != file_state(spark, source):
        return False
    counts = _counts(spark, path)
    return counts is not None and all(counts.get(s, 0) == m[f"{s}_rows"] for s in ("train", "validation", "test"))


def read_cache(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split (partition-pruned); another version, labels outside 0..2 and over-long texts raise."""
    manifest = read_manifest(spark, path)
    if manifest is None or manifest["version"] != CACHE_VERSION:
        raise ValueError("no cache of this version")
    label = F.when(F.col("label").between(0, 2), F.col("label")).otherwise(F.raise_error(F.lit("cached label out of range")).cast("int"))
    text = F.when(F.octet_length("text") <= MAX_TEXT_BYTES, F.col("text")).otherwise(F.raise_error(F.lit("cached text too long")))
    return spark.read.parquet(f"{path}/rows").where(F.col("split") == split).withColumns({"label": label, "text": text})


def write_vocabulary(model: VectorizerModel, path: str) -> None:
    if not model.fitted:
        raise ValueError("vectorizer is not fitted")
    spark = model.vocabulary.sparkSession
    model.vocabulary.write.mode("overwrite").parquet(f"{path}/terms")
    p = model.params
    spark.createDataFrame([(2, model.size, p.min_df, p.ngram_min, p.ngram_max, p.sublinear)], "version int, features bigint, min_df int, ngram_min int, ngram_max int, sublinear boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_vocabulary(spark: SparkSession, path: str) -> VectorizerModel:
    """Validates everything before a model is made: dense distinct ids, distinct non-empty terms, positive finite idf."""
    from corvane.operators.vectorizer import VectorizerParams

    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != 2:
        raise ValueError("unsupported vocabulary version")
    terms = spark.read.parquet(f"{path}/terms")
    c = terms.agg(
        F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.countDistinct("fid").alias("ids"), F.min("fid").alias("low"), F.max("fid").alias("high"),
        F.count_if(F.col("term").isNull() | (F.col("term") == "") | (F.octet_length("term") > MAX_TERM_BYTES)).alias("bad_terms"), F.count_if(F.isnan("idf") | (F.col("idf") <= 0) | (F.col("idf") == float("inf"))).alias("bad_idf"),
    ).first()
    if not c["n"] or c["n"] != meta["features"] or c["terms"] != c["n"] or c["ids"] != c["n"] or c["low"] != 0 or c["high"] != c["n"] - 1:
        raise ValueError("vocabulary ids or terms are damaged")
    if c["bad_terms"] or c["bad_idf"]:
        raise ValueError("vocabulary holds bad terms or weights")
    params = VectorizerParams(max_features=c["n"], min_df=meta["min_df"], ngram_min=meta["ngram_min"], ngram_max=meta["ngram_max"], sublinear=meta["sublinear"])
    return VectorizerModel(params, terms, c["n"])


def write_model(model: LinearModel, spark: SparkSession, path: str) -> None:
    import numpy as np

    rows = [(k, *map(float, model.weights[:, k])) for k in np.flatnonzero(model.weights.any(0)).tolist()]
    spark.createDataFrame(rows, "fid int, w0 double, w1 double, w2 double").write.mode("overwrite").parquet(f"{path}/weights")
    meta = (5, model.features, *map(float, model.bias), *map(float, model.class_weights), bool(model.trained), int(model.steps), int(model.violations))
    spark.createDataFrame([meta], "version int, feature_count int, b0 double, b1 double, b2 double, cw0 double, cw1 double, cw2 double, trained boolean, training_steps bigint, margin_violations bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> LinearModel:
    """Checks version, class weights and that every number is finite before the model is made."""
    import numpy as np

    m = spark.read.parquet(f"{path}/meta").first()
    if m["version"] != 5:
        raise ValueError("unsupported model version")
    weights = np.zeros((3, m["feature_count"]))
    for r in spark.read.parquet(f"{path}/weights").collect():
        if not 0 <= r["fid"] < m["feature_count"]:
            raise ValueError("model holds a feature out of range")
        weights[:, r["fid"]] = r[1:]
    bias = np.array([m["b0"], m["b1"], m["b2"]])
    class_weights = (m["cw0"], m["cw1"], m["cw2"])
    if not np.isfinite(weights).all() or not np.isfinite(bias).all():
        raise ValueError("model holds numbers that are not finite")
    if any(not math.isfinite(x) or not 0.5 <= x <= 5 for x in class_weights):
        raise ValueError("class weights out of range")
    model = LinearModel(m["feature_count"], class_weights)
    model.weights, model.bias, model.trained, model.steps, model.violations = weights, bias, m["trained"], m["training_steps"], m["margin_violations"]
    return model
