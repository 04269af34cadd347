"""Document frequency, vocabulary, TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.functions.text import ngrams, tokens

#: A vocabulary up to this many terms is sent to every executor; a larger one is joined by shuffle.
BROADCAST_TERMS = 1_000_000


@dataclass(frozen=True)
class VectorizerParams:
    max_features: int = 500_000
    min_df: int = 3
    ngram_min: int = 1
    ngram_max: int = 2
    sublinear: bool = True

    def __post_init__(self):
        if self.max_features < 1:
            raise ValueError("max_features must be positive")
        if self.ngram_min < 1 or self.ngram_max < self.ngram_min or self.ngram_max > 2:
            raise ValueError("n-gram range must lie in 1..2")
        object.__setattr__(self, "min_df", max(1, self.min_df))


def terms(df: DataFrame, params: VectorizerParams, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term), one row per occurrence. Null and token-less texts give none."""
    return df.select(F.col(id_col).alias("doc_id"), F.explode(ngrams(tokens(F.col("text")), params.ngram_min, params.ngram_max)).alias("term"))


def term_frequency(df: DataFrame, params: VectorizerParams = VectorizerParams(), id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf) counted inside each document's sorted array: no shuffle. Rows are documents, also of a repeated identifier."""
    t = F.array_sort(ngrams(tokens(F.col("text")), params.ngram_min, params.ngram_max))
    # where each run of equal terms begins, and how far the next one is
    runs = df.select(F.col(id_col).alias("doc_id"), t.alias("t")).where(F.size("t") > 0)
    runs = runs.withColumn("at", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i] <> get(t, i - 1))"))
    return runs.select("doc_id", F.expr("inline(transform(at, (p, k) -> struct(t[p] as term, cast(coalesce(get(at, k + 1), size(t)) - p as bigint) as tf)))"))


def document_frequency(df: DataFrame, params: VectorizerParams = VectorizerParams()) -> DataFrame:
    """(term, df): documents that hold the term. One shuffle, pre-aggregated by task."""
    own = F.array_distinct(ngrams(tokens(F.col("text")), params.ngram_min, params.ngram_max))
    return df.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def fit(df: DataFrame, params: VectorizerParams = VectorizerParams()) -> VectorizerModel:
    """Terms of at least min_df documents, the max_features most frequent, ties by term.

    N counts all documents, those without tokens too. The window that numbers the terms
    runs over the limited vocabulary only.
    """
    n = df.count()
    top = document_frequency(df, params).where(F.col("df") >= params.min_df).orderBy(F.desc("df"), "term").limit(params.max_features)
    numbered = top.withColumn("fid", (F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1).cast("int"))
    idf = F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + 1
    vocabulary = numbered.select("fid", "term", "df", idf.alias("idf")).persist()
    return VectorizerModel(params, vocabulary, vocabulary.count())


class VectorizerModel:
    """Vocabulary table (fid, term, df, idf) with the transforms over it."""

    def __init__(self, params: VectorizerParams, vocabulary: DataFrame, size: int):
        self.params, self.vocabulary, self.size = params, vocabulary, size

    def release(self) -> None:
        """Give the cached vocabulary back; the model can still be used."""
        self.vocabulary.unpersist()

    def term(self, fid: int) -> str:
        """The term of an identifier; one outside the vocabulary raises."""
        row = self.vocabulary.where(F.col("fid") == fid).select("term").first() if 0 <= fid < self.size else None
        if row is None:
            raise IndexError(f"no term {fid} in a vocabulary of {self.size}")
        return row["term"]

    def report(self, df: DataFrame) -> dict[str, int]:
        """Terms of the documents before the filters, of enough documents, and in the vocabulary."""
        r = document_frequency(df, self.params).agg(F.count("*").alias("terms"), F.count_if(F.col("df") >= self.params.min_df).alias("frequent")).first()
        return {"terms": r["terms"], "frequent": r["frequent"], "kept": self.size}

    @property
    def fitted(self) -> bool:
        return self.size > 0

    def _side(self) -> DataFrame:
        return F.broadcast(self.vocabulary) if self.size <= BROADCAST_TERMS else self.vocabulary

    def contains(self, df: DataFrame) -> DataFrame:
        """(term, fid) of the given terms that are in the vocabulary."""
        return df.select("term").distinct().join(self._side().select("term", "fid"), "term")

    def unknown_terms(self, df: DataFrame) -> DataFrame:
        """(term, df) of the documents' terms outside the vocabulary."""
        return document_frequency(df, self.params).join(self._side().select("term"), "term", "left_anti")

    def term_ids(self, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(doc_id, fid), one row per known occurrence."""
        return terms(df, self.params, id_col).join(self._side().select("term", "fid"), "term").select("doc_id", "fid")

    def transform(self, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(doc_id, fid, x): L2-normalised TF-IDF in long form. Unfitted gives no rows."""
        tf = term_frequency(df, self.params, id_col).join(self._side(), "term")
        weight = (1 + F.log("tf") if self.params.sublinear else F.col("tf").cast("double")) * F.col("idf")
        value = tf.select("doc_id", "fid", weight.alias("v")).where(~F.isnan("v") & (F.col("v") != 0) & (F.abs("v") < float("inf")))
        norm = F.sum(F.col("v") * F.col("v")).over(W.partitionBy("doc_id"))
        return value.withColumn("s", norm).select("doc_id", "fid", F.when((F.col("s") > 0) & (F.col("s") < float("inf")), F.col("v") / F.sqrt("s")).otherwise(F.col("v")).alias("x"))

    def transform_arrays(self, df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """(keep..., indices, values) per document, empty arrays where no term is known.

        The vocabulary goes to each executor once and documents are vectorised where
        they are, without a shuffle; beyond BROADCAST_TERMS the long form is grouped.
        """
        if self.size > BROADCAST_TERMS:
            x = self.transform(df).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("fid", "x"))).alias("v"))
            empty = F.coalesce(F.col("v"), F.array().cast("array<struct<fid:int,x:double>>"))
            return df.select(*keep).join(x, "doc_id", "left").select(*keep, empty["fid"].alias("indices"), empty["x"].alias("values"))
        rows = self.vocabulary.select("term", "fid", "idf").collect()
        shared = df.sparkSession.sparkContext.broadcast(({r["term"].encode(): r["fid"] for r in rows}, np.array([r["idf"] for r in sorted(rows, key=lambda r: r["fid"])])))
        params = self.params
        table = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, idf = shared.value
            for batch in batches:
                indices, values = [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    tk = (text or "").encode("utf-8", "replace").translate(table).split()
                    grams = (tk if params.ngram_min == 1 else []) + ([a + b"_" + b for a, b in zip(tk, tk[1:])] if params.ngram_max == 2 else [])
                    found = [c for g in grams if (c := code.get(g)) is not None]
                    fid, tf = np.unique(np.array(found, np.int64), return_counts=True)
                    v = (1 + np.log(tf) if params.sublinear else tf.astype(float)) * idf[fid]
                    s = float(v @ v)
                    indices.append(fid)
                    values.append(v / np.sqrt(s) if s > 0 else v)
                cols = [batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "indices", "values"])

        src = df.select(*keep, F.col("text").alias("__text"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
        return src.mapInArrow(run, f"{schema}, indices array<int>, values array<double>")

    def transform_dense(self, df: DataFrame) -> DataFrame:
        """(doc_id, values): one array of vocabulary size per document, for small vocabularies."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, size))
                lengths = np.diff(batch.column("indices").offsets.to_numpy())
                out[np.repeat(np.arange(len(lengths)), lengths), batch.column("indices").flatten().to_numpy()] = batch.column("values").flatten().to_numpy()
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(size, 1), np.int32)[: len(lengths) + 1] if size else np.zeros(len(lengths) + 1, np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "values"])

        known = self.transform_arrays(df)
        return known.mapInArrow(run, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, values array<double>")


def model_from_table(vocabulary: DataFrame, params: VectorizerParams = VectorizerParams()) -> VectorizerModel:
    """A model over a given (fid, term, df, idf) table. An empty table, bad idf values, identifiers
    other than 0..n-1 and repeated or null terms make it unfitted."""
    bad = F.count_if(F.col("idf").isNull() | F.isnan("idf") | (F.col("idf") <= 0) | (F.col("idf") == float("inf")) | F.col("term").isNull() | F.col("fid").isNull())
    c = vocabulary.agg(F.count("*").alias("n"), bad.alias("bad"), F.countDistinct("term").alias("terms"), F.countDistinct("fid").alias("ids"), F.min("fid").alias("low"), F.max("fid").alias("high")).first()
    ok = c["n"] and not c["bad"] and c["terms"] == c["ids"] == c["n"] and c["low"] == 0 and c["high"] == c["n"] - 1
    return VectorizerModel(params, vocabulary, c["n"] if ok else 0)
