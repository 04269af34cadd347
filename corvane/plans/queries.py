"""Queries of the core operators, each with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import scores as sc
from corvane.functions.hashing import bucket, fnv1a_fast, normalize, split_of
from corvane.functions.text import ngrams, tokens
from corvane.operators import dataset, evaluate, matrix, predict, svm, vectorizer
from corvane.plans import pipeline
from corvane.sources import labelled, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PARAMS = vectorizer.VectorizerParams()
#: Dense vectors are for small vocabularies.
DENSE = vectorizer.VectorizerParams(max_features=2000)


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews (doc_id, text, label); unknown labels are left out."""
    return labelled.read_labelled(_table(spark, sf_dir, "reviews"), keep=("review_id",), strict=False).withColumnRenamed("review_id", "doc_id")


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='corvane-')).rstrip('/')}/corvane/{uuid.uuid4().hex}"


_DOCS = """docs as (select review_id as doc_id, review_text as text, case lower(sentiment) when 'negative' then 0 when 'neutral' then 1 when 'positive' then 2 end as label
  from reviews where review_text is not null and sentiment is not null and review_text <> '' and lower(sentiment) in ('negative', 'neutral', 'positive'))"""
_TK = _DOCS + ", tk as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda t: lower(t)) as tk from docs)"
_GRAMS = _TK + ", grams as (select doc_id, list_concat(tk, list_transform(range(1, greatest(len(tk), 1)), lambda i: tk[i] || '_' || tk[i + 1])) as g from tk)"
_TERMS = _GRAMS + ", terms as (select doc_id, unnest(g) as term from grams)"
_DF = _TERMS + ", dfs as (select term, count(distinct doc_id) as df from terms group by term)"
_VOCAB = _DF + """, top as (select term, df from dfs where df >= 3 order by df desc, term limit 500000),
vocab as (select cast(row_number() over (order by df desc, term) - 1 as int) as fid, term, df, ln((1.0 + (select count(*) from docs)) / (1.0 + df)) + 1 as idf from top)"""


_SMALL = _VOCAB.replace("limit 500000)", "limit 2000)")


def _tfidf(weight: str = "1 + ln(tf)", vocab: str = _VOCAB) -> str:
    return f"""{vocab}, tf as (select doc_id, term, count(*) as tf from terms group by doc_id, term),
v as (select doc_id, fid, ({weight}) * idf as v from tf join vocab using (term)),
vec as (select doc_id, fid, v / sqrt(sum(v * v) over (partition by doc_id)) as x from v)"""


_BIGRAM = _VOCAB.replace("list_concat(tk, list_transform(range(1, greatest(len(tk), 1)), lambda i: tk[i] || '_' || tk[i + 1]))", "list_transform(range(1, greatest(len(tk), 1)), lambda i: tk[i] || '_' || tk[i + 1])")


# --- scan, text


@query("labelled_scan", f"with {_DOCS} select doc_id, text, cast(label as int) as label from docs")
def labelled_scan(spark, sf_dir):
    return _docs(spark, sf_dir)


@query("read_stats", """select count(*) as total_rows, count(*) filter (review_text is null) as null_text, count(*) filter (review_text is not null and sentiment is null) as null_label,
  count(*) filter (review_text = '' and sentiment is not null) as empty_text, count(*) filter (review_text <> '' and sentiment is not null) as kept_rows from reviews""")
def read_stats(spark, sf_dir):
    return labelled.read_stats(_table(spark, sf_dir, "reviews"))


@query("tokenize", f"with {_TK} select doc_id, array_to_string(tk, ' ') as tokens, cast(len(tk) as int) as n from tk")
def tokenize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("tk")).select("doc_id", F.array_join("tk", " ").alias("tokens"), F.size("tk").alias("n"))


@query("ngrams", f"with {_GRAMS} select doc_id, array_to_string(g, ' ') as grams from grams")
def ngrams_query(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(ngrams(tokens(F.col("text"))), " ").alias("grams"))


# --- vocabulary and vectors


@query("document_frequency", f"with {_DF} select term, df from dfs")
def document_frequency(spark, sf_dir):
    return vectorizer.document_frequency(_docs(spark, sf_dir))


@query("vocabulary_topk_idf", f"with {_VOCAB} select fid, term, df, round(idf, 6) as idf from vocab")
def vocabulary_topk_idf(spark, sf_dir):
    return vectorizer.fit(_docs(spark, sf_dir), PARAMS).vocabulary.withColumn("idf", F.round("idf", 6))


@query("term_frequency", f"with {_TERMS} select doc_id, term, count(*) as tf from terms group by doc_id, term")
def term_frequency(spark, sf_dir):
    return vectorizer.term_frequency(_docs(spark, sf_dir))


@query("tfidf_sparse", f"with {_tfidf()} select doc_id, fid, round(x, 6) as x from vec")
def tfidf_sparse(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    arrays = vectorizer.fit(docs, PARAMS).transform_arrays(docs)
    return arrays.select("doc_id", F.explode(F.arrays_zip("indices", "values")).alias("z")).select("doc_id", F.col("z.indices").alias("fid"), F.round("z.values", 6).alias("x"))


@query("tfidf_long_form", f"with {_tfidf()} select doc_id, fid, round(x, 6) as x from vec")
def tfidf_long_form(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return vectorizer.fit(docs, PARAMS).transform(docs).withColumn("x", F.round("x", 6))


@query("tfidf_raw_tf", f"with {_tfidf('tf')} select doc_id, fid, round(x, 6) as x from vec")
def tfidf_raw_tf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    params = vectorizer.VectorizerParams(sublinear=False)
    return vectorizer.fit(docs, params).transform(docs).withColumn("x", F.round("x", 6))


@query("tfidf_bigram_only", f"with {_tfidf(vocab=_BIGRAM)} select doc_id, fid, round(x, 6) as x from vec")
def tfidf_bigram_only(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    params = vectorizer.VectorizerParams(ngram_min=2)
    return vectorizer.fit(docs, params).transform(docs).withColumn("x", F.round("x", 6))


@query("tfidf_dense", f"with {_tfidf(vocab=_SMALL)}, n as (select doc_id, count(*) as nonzero, sum(x) as total from vec group by doc_id) select d.doc_id, cast((select count(*) from vocab) as int) as size, cast(coalesce(nonzero, 0) as int) as nonzero, round(coalesce(total, 0), 6) as total from docs d left join n using (doc_id)")
def tfidf_dense(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    dense = vectorizer.fit(docs, DENSE).transform_dense(docs)
    return dense.select("doc_id", F.size("values").alias("size"), F.size(F.filter("values", lambda v: v != 0)).alias("nonzero"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("oov_terms", f"with {_VOCAB} select term, df from dfs where term not in (select term from vocab)")
def oov_terms(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return vectorizer.fit(docs, PARAMS).unknown_terms(docs)


@query("term_ids", f"with {_VOCAB} select doc_id, fid, count(*) as n from terms join vocab using (term) group by doc_id, fid")
def term_ids(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return vectorizer.fit(docs, PARAMS).term_ids(docs).groupBy("doc_id", "fid").agg(F.count("*").alias("n"))


@query("vocabulary_roundtrip", f"with {_VOCAB} select fid, term, df, round(idf, 6) as idf from vocab")
def vocabulary_roundtrip(spark, sf_dir):
    path = _folder(spark)
    store.write_vocabulary(vectorizer.fit(_docs(spark, sf_dir), PARAMS), path)
    return store.read_vocabulary(spark, path).vocabulary.withColumn("idf", F.round("idf", 6))


# --- hash, dedup, split

_NORM = _DOCS + ", norm as (select doc_id, text, label, lower(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 \\t\\n\\x0B\\f\\r]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) as norm from docs)"
_HASH = _NORM + """, hu as (select *, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(string_split(norm, ''), lambda c: ascii(c)::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as u from norm where norm <> ''),
hs as (select doc_id, text, label, norm, u, cast(case when u >= 9223372036854775808::hugeint then u - 18446744073709551616::hugeint else u end as bigint) as h, cast(xor(u, 11400714819323198485::hugeint) % 1000 as int) as bucket from hu)"""
_FIRST = _HASH + """, numbered as (select *, row_number() over (partition by h order by doc_id) as k, first_value(label) over (partition by h order by doc_id) as first_label from hs),
firsts as (select *, case when bucket < 800 then 'train' when bucket < 900 then 'validation' else 'test' end as split from numbered where k = 1)"""


@query("normalize_text", f"with {_NORM} select doc_id, norm from norm")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("norm"))


@query("fnv1a_hash", f"with {_HASH} select doc_id, h from hs")
def fnv1a_hash(spark, sf_dir):
    return dataset.hashed(_docs(spark, sf_dir)).select("doc_id", "h")


@query("hash_split", f"with {_HASH} select doc_id, bucket, case when bucket < 800 then 'train' when bucket < 900 then 'validation' else 'test' end as split from hs")
def hash_split(spark, sf_dir):
    return dataset.with_split(dataset.hashed(_docs(spark, sf_dir))).select("doc_id", "bucket", "split")


@query("dedup_first_wins", f"with {_FIRST} select doc_id, cast(label as int) as label, h, split from firsts")
def dedup_first_wins(spark, sf_dir):
    return dataset.split_rows(_docs(spark, sf_dir)).select("doc_id", "label", "h", "split")


@query("dedup_stats", f"with {_FIRST} select count(*) filter (k = 1) as unique_rows, count(*) filter (k > 1) as duplicate_rows, count(*) filter (k > 1 and label <> first_label) as conflicting_duplicates from numbered")
def dedup_stats(spark, sf_dir):
    return dataset.dedup_stats(_docs(spark, sf_dir))


@query("class_distribution", f"with {_FIRST} select cast(label as int) as label, count(*) as n from firsts group by label")
def class_distribution(spark, sf_dir):
    return dataset.class_distribution(dataset.dedup(_docs(spark, sf_dir)))


@query("split_sizes", f"with {_FIRST} select split, count(*) as n from firsts group by split")
def split_sizes(spark, sf_dir):
    return dataset.split_sizes(dataset.split_rows(_docs(spark, sf_dir)))


@query("cache_roundtrip", f"with {_FIRST} select doc_id, text, cast(label as int) as label, h, split from firsts where split = 'validation'")
def cache_roundtrip(spark, sf_dir):
    path, source = _folder(spark), f"{sf_dir}/reviews.parquet"
    store.write_cache(dataset.split_rows(_docs(spark, sf_dir)), path, source)
    if not store.cache_is_valid(spark, path, source):
        raise ValueError("the cache just written does not hold")
    return store.read_cache(spark, path, "validation").select("doc_id", "text", "label", "h", "split")


@query("cached_bucket_check", """select doc_id, bucket, split from split_rows where h is not null and bucket is not null and split is not null""")
def cached_bucket_check(spark, sf_dir):
    """Stored splits recomputed from the stored hash and the manifest's own seed."""
    rows, seeds = _table(spark, sf_dir, "split_rows"), _table(spark, sf_dir, "cache_manifest").select("manifest_id", "split_seed")
    known = rows.where("h is not null and bucket is not null and split is not null").join(F.broadcast(seeds), "manifest_id")
    b = bucket(F.col("h"), F.col("split_seed"))
    return known.select("doc_id", b.alias("bucket"), split_of(b).alias("split"))


# --- scores, predictions

_WEIGHTS = ", w as (select fid, ((fid * 7) % 11 - 5) / 10.0 as w0, ((fid * 5 + 3) % 13 - 6) / 10.0 as w1, ((fid * 3 + 1) % 7 - 3) / 10.0 as w2 from vocab)"
_SCORES = _tfidf() + _WEIGHTS + """, dots as (select doc_id, sum(x * w0) as d0, sum(x * w1) as d1, sum(x * w2) as d2 from vec join w using (fid) group by doc_id),
sc as (select d.doc_id, 0.1 + coalesce(d0, 0) as s0, 0.05 + coalesce(d1, 0) as s1, -0.1 + coalesce(d2, 0) as s2 from docs d left join dots using (doc_id))"""
_BIAS = (0.1, 0.05, -0.1)


def _weights(v: vectorizer.VectorizerModel) -> DataFrame:
    f = F.col("fid")
    return v.vocabulary.select("fid", ((f * 7 % 11 - 5) / F.lit(10.0)).alias("w0"), (((f * 5 + 3) % 13 - 6) / F.lit(10.0)).alias("w1"), (((f * 3 + 1) % 7 - 3) / F.lit(10.0)).alias("w2"))


def _scored(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    v = vectorizer.fit(docs, PARAMS)
    return svm.decision_scores(v.transform(docs), _weights(v), _BIAS, docs)


@query("decision_scores", f"with {_SCORES} select doc_id, round(s0, 6) as s0, round(s1, 6) as s1, round(s2, 6) as s2 from sc")
def decision_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", *[F.round(f"s{c}", 6).alias(f"s{c}") for c in range(3)])


@query("predict_argmax", f"with {_SCORES} select doc_id, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as label from sc")
def predict_argmax(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", sc.argmax([F.col("s0"), F.col("s1"), F.col("s2")]).alias("label"))


_RECORD = """with p as (select doc_id, scored_at, s0, s1, s2, greatest(s0, s1, s2) as top, exp(s0 - greatest(s0, s1, s2)) as e0, exp(s1 - greatest(s0, s1, s2)) as e1, exp(s2 - greatest(s0, s1, s2)) as e2,
  case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as label, top - list_sort([s0, s1, s2])[2] as margin from predictions),
r as (select *, 1 / (e0 + e1 + e2) as confidence from p)"""


@query("prediction_record", _RECORD + """ select doc_id, scored_at, label, ['Negative', 'Neutral', 'Positive'][label + 1] as label_name, round(e0 * confidence, 6) as p0, round(e1 * confidence, 6) as p1, round(e2 * confidence, 6) as p2, round(top, 6) as score,
  round(confidence, 6) as confidence, round(margin, 6) as margin, case when confidence >= 0.8 then 'HIGH' when confidence >= 0.6 then 'MEDIUM' when confidence >= 0.45 then 'LOW' else 'UNCERTAIN' end as level,
  case when confidence < 0.45 then 'ABSTAIN' when confidence < 0.6 or margin < 0.15 then 'REVIEW' else 'ACCEPT' end as policy from r""")
def prediction_record(spark, sf_dir):
    out = predict.record(_table(spark, sf_dir, "predictions").select("doc_id", "scored_at", "s0", "s1", "s2"), ("doc_id", "scored_at"))
    return out.drop("s0", "s1", "s2").withColumns({c: F.round(c, 6) for c in ("p0", "p1", "p2", "score", "confidence", "margin")})


@query("softmax_confidence", _RECORD + " select doc_id, scored_at, round(confidence, 6) as confidence from r")
def softmax_confidence(spark, sf_dir):
    s = [F.col("s0"), F.col("s1"), F.col("s2")]
    return _table(spark, sf_dir, "predictions").select("doc_id", "scored_at", F.round(sc.clamped_confidence(s), 6).alias("confidence"))


@query("level_counts", "select level, policy, count(*) as n from predictions where confidence is not null group by level, policy")
def level_counts(spark, sf_dir):
    p = _table(spark, sf_dir, "predictions").where("confidence is not null")
    return p.groupBy(sc.level(F.col("confidence")).alias("level"), sc.policy(F.col("confidence"), F.col("margin")).alias("policy")).agg(F.count("*").alias("n"))


# --- evaluation

_EVAL = "with e as (select s.label as actual, p.label as predicted from predictions p join split_rows s using (doc_id))"
_PER = _EVAL + """, k as (select unnest([0, 1, 2]) as c), g as (select c, (select count(*) from e where actual = c and predicted = c) as hit, (select count(*) from e where actual = c and predicted in (0, 1, 2)) as support, (select count(*) from e where predicted = c and actual in (0, 1, 2)) as said from k),
m as (select c, case when said > 0 then hit * 1.0 / said else 0 end as p, case when support > 0 then hit * 1.0 / support else 0 end as r, support from g), f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from m)"""


def _pairs(spark, sf_dir) -> DataFrame:
    truth = _table(spark, sf_dir, "split_rows").select("doc_id", F.col("label").alias("actual"))
    return _table(spark, sf_dir, "predictions").select("doc_id", F.col("label").alias("predicted")).join(truth, "doc_id")


@query("confusion_matrix", _EVAL + " select a.c as actual, b.c as predicted, (select count(*) from e where actual = a.c and predicted = b.c) as n from (select unnest([0, 1, 2]) as c) a, (select unnest([0, 1, 2]) as c) b")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_pairs(spark, sf_dir))


@query("class_metrics", _PER + " select c as class, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, support from f")
def class_metrics(spark, sf_dir):
    return evaluate.class_metrics(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("summary_metrics", _PER + " select (select count(*) from e) as total_samples, round((select count(*) from e where actual = predicted) * 1.0 / (select count(*) from e), 6) as accuracy, round(sum(f1) / 3, 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from f")
def summary_metrics(spark, sf_dir):
    return evaluate.summary(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1", "weighted_f1")})


# --- training


@query("svm_batch_step", f"""with {_tfidf()}, t as (select fid, x, label, least(0.001 * case label when 1 then 2.4 else 1.0 end / 2, 0.005) as u from vec join docs using (doc_id))
select fid, round(sum(case when label = 0 then u * x else -u * x end), 6) + 0.0 as g0, round(sum(case when label = 1 then u * x else -u * x end), 6) + 0.0 as g1, round(sum(case when label = 2 then u * x else -u * x end), 6) + 0.0 as g2 from t group by fid""")
def svm_batch_step(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    step = svm.batch_step(vectorizer.fit(docs, PARAMS).transform(docs), docs.select("doc_id", "label"), None, (0.0, 0.0, 0.0), 0.001)
    return step.select("fid", *[(F.round(f"g{c}", 6) + F.lit(0.0)).alias(f"g{c}") for c in range(3)])


@query("svm_sequential_fit")
def svm_sequential_fit(spark, sf_dir):
    rows = dataset.split_rows(_docs(spark, sf_dir)).persist()
    t = pipeline.train(rows)
    return t.test.withColumns({"steps": F.lit(t.model.steps), "violations": F.lit(t.model.violations)})


@query("model_roundtrip", f"with {_VOCAB}{_WEIGHTS} select fid, round(w0, 6) as w0, round(w1, 6) as w1, round(w2, 6) as w2 from w where w0 <> 0 or w1 <> 0 or w2 <> 0")
def model_roundtrip(spark, sf_dir):
    v = vectorizer.fit(_docs(spark, sf_dir), PARAMS)
    model = svm.LinearModel(v.size)
    for r in _weights(v).collect():
        model.weights[:, r["fid"]] = r[1:]
    path = _folder(spark)
    store.write_model(model, spark, path)
    return store.read_model(spark, path).table(spark).select("fid", *[F.round(f"w{c}", 6).alias(f"w{c}") for c in range(3)])


@query("lr_schedule", "select cast(e as int) as epoch, round(greatest(0.00008, 0.001 / (1 + 0.12 * (e - 1))), 12) as rate from range(1, 501) t(e)")
def lr_schedule(spark, sf_dir):
    return spark.range(1, 501).select(F.col("id").cast("int").alias("epoch"), F.round(sc.learning_rate_column(F.col("id")), 12).alias("rate"))


# --- matrix

_M = "m as (select l_orderkey % 1000 as row, l_partkey % 50 as col, l_quantity as value from lineitem)"


def _matrix(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("row"), (F.col("l_partkey") % 50).alias("col"), F.col("l_quantity").alias("value"))
    return matrix.build(e, 1000, 50)


@query("csr_row_ptr", f"with {_M}, c as (select r as row, (select count(*) from m where m.row = r and value <> 0) as n from range(0, 1000) t(r)) select row, cast(coalesce(sum(n) over (order by row rows between unbounded preceding and 1 preceding), 0) as bigint) as start, n from c")
def csr_row_ptr(spark, sf_dir):
    return matrix.row_pointers(_matrix(spark, sf_dir), 1000)


@query("csr_dot_row", f"with {_M} select row, round(sum(value * (col + 1) / 10.0), 4) as dot from m where value <> 0 group by row")
def csr_dot_row(spark, sf_dir):
    weights = spark.range(50).select(F.col("id").alias("col"), ((F.col("id") + 1) / F.lit(10.0)).alias("w"))
    return matrix.dot_rows(_matrix(spark, sf_dir), F.broadcast(weights)).withColumn("dot", F.round("dot", 4))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scan, dedup, split, vocabulary, training, scoring: prediction records of the test split."""
    rows = dataset.split_rows(_docs(spark, sf_dir)).persist()
    t = pipeline.train(rows)
    return pipeline.predict_texts(rows.where("split = 'test'"), t.vectorizer, t.model)


@query("predict_pipeline")
def predict_pipeline(spark, sf_dir):
    return flagship(spark, sf_dir)
