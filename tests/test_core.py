import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import scores as sc
from corvane.functions.hashing import SPLIT_SEED, bucket, fnv1a, fnv1a_fast, fnv1a_py, normalize, normalize_py, signed, split_of, split_py
from corvane.functions.text import bigrams, tokens
from corvane.operators import dataset, evaluate, matrix, predict, svm, vectorizer
from corvane.sources import labelled, store
from corvane.streaming import score_stream

GOLD = [
    ("a", "a", 12638187200555641996, 529, "train"), ("Good product", "good product", 9088367557022198295, 354, "train"), ("  GOOD,   product!! ", "good product", 9088367557022198295, 354, "train"),
    ("Don't stop", "dont stop", 9507202569351105170, 143, "train"), ("a - b", "a b", 16591147884985137298, 599, "train"), ("café 5", "caf 5", 5221904229312236118, 35, "train"),
    ("x y", "xy", 644383116220033818, 399, "train"), ("product 9", "product 9", 4259330443079065799, 802, "validation"), ("good", "good", 11305396749966545176, 973, "test"),
]


def test_tokens(spark):
    rows = [("Don't STOP-it 3x", "don t stop it x"), ("caféÉ o", "caf o"), ("aKb", "a b"), ("İx", "x"), ("123 !!", ""), ("", "")]
    df = spark.createDataFrame(rows, "text string, want string").select(F.array_join(tokens(F.col("text")), " ").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    two = spark.createDataFrame([("a b c",), ("a",)], "text string").select(bigrams(tokens(F.col("text"))).alias("b")).collect()
    assert [r["b"] for r in two] == [["a_b", "b_c"], []]


def test_hash_and_split(spark):
    for text, norm, h, b, split in GOLD:
        assert normalize_py(text) == norm and fnv1a_py(norm) == h and split_py(text, SPLIT_SEED) == split
    df = spark.createDataFrame([(g[0],) for g in GOLD], "text string").withColumn("n", normalize(F.col("text")))
    got = df.select("n", fnv1a(F.col("n")).alias("h"), fnv1a_fast(F.col("n")).alias("f")).withColumn("b", bucket(F.col("h"))).withColumn("s", split_of(F.col("b"))).collect()
    for r, (_, norm, h, b, split) in zip(got, GOLD):
        assert (r["n"], r["h"], r["f"], r["b"], r["s"]) == (norm, signed(h), signed(h), b, split)
    assert split_py("!!!", SPLIT_SEED) is None
    odd = spark.createDataFrame([(None,), ("",), ("x" * 5000,)], "t string").select(fnv1a_fast("t").alias("f"), fnv1a(F.col("t")).alias("h")).collect()
    assert [r["f"] for r in odd] == [r["h"] for r in odd]


def test_labelled_source(spark):
    df = spark.createDataFrame([("t", "POSITIVE", 1), (None, "bad", 2), ("t", None, 3), ("", "bad", 4)], "review_text string, sentiment string, extra int")
    assert [tuple(r) for r in labelled.read_labelled(df).collect()] == [("t", 2)]
    assert tuple(labelled.read_stats(df).first()) == (4, 1, 1, 1, 1)
    with pytest.raises(Exception, match="Unknown sentiment label"):
        labelled.read_labelled(spark.createDataFrame([("t", " positive")], "review_text string, sentiment string")).collect()
    with pytest.raises(ValueError):
        labelled.read_labelled(df.drop("sentiment"))
    with pytest.raises(ValueError):
        labelled.validate_schema(spark.createDataFrame([(1, "x")], "review_text int, sentiment string").schema)
    numbers = spark.createDataFrame([("t", 1), ("t", 2)], "review_text string, sentiment int")
    assert sorted(r["label"] for r in labelled.read_labelled(numbers).collect()) == [1, 2]
    with pytest.raises(Exception, match="Unknown"):
        labelled.read_labelled(spark.createDataFrame([("t", 3)], "review_text string, sentiment int")).collect()


def test_dedup(spark):
    rows = [(1, "Good product", 2), (2, "GOOD product!", 2), (3, "good, product", 0), (4, "Don't stop", 1), (5, "!!!", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").repartition(3)
    assert tuple(dataset.dedup_stats(df).first()) == (2, 2, 1)
    assert sorted((r["doc_id"], r["label"]) for r in dataset.dedup(df).collect()) == [(1, 2), (4, 1)]
    assert dataset.dedup(df.limit(0)).count() == 0 and tuple(dataset.dedup_stats(df.limit(0)).first()) == (0, 0, 0)
    splits = dataset.split_rows(df)
    assert splits.where("split is null").count() == 0


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (4, "c")], "doc_id bigint, text string")
    v = vectorizer.fit(docs, vectorizer.VectorizerParams(min_df=3))
    assert [(r["fid"], r["term"], r["df"]) for r in v.vocabulary.orderBy("fid").collect()] == [(0, "a", 3), (1, "a_b", 3), (2, "b", 3)]
    assert abs(v.vocabulary.first()["idf"] - (math.log(5 / 4) + 1)) < 1e-12
    some = spark.createDataFrame([(1, "a a b"), (2, "z"), (3, ""), (4, None)], "doc_id bigint, text string")
    x = {(r["doc_id"], r["fid"]): r["x"] for r in v.transform(some).collect()}
    assert set(x) == {(1, 0), (1, 1), (1, 2)} and abs(x[1, 0] - 0.767495) < 1e-6 and abs(x[1, 1] - 0.453295) < 1e-6
    arrays = {r["doc_id"]: r for r in v.transform_arrays(some).collect()}
    assert arrays[1]["indices"] == [0, 1, 2] and abs(arrays[1]["values"][0] - 0.767495) < 1e-6 and arrays[2]["indices"] == [] and arrays[4]["values"] == []
    dense = {r["doc_id"]: r["values"] for r in v.transform_dense(some).collect()}
    assert dense[2] == [0.0, 0.0, 0.0] and abs(dense[1][2] - 0.453295) < 1e-6
    assert [r["term"] for r in v.unknown_terms(some).collect()] and v.term_ids(some).count() == 4
    again = vectorizer.fit(docs.union(spark.createDataFrame([(5, "123")], "doc_id bigint, text string")), vectorizer.VectorizerParams(min_df=3))
    assert abs(again.vocabulary.first()["idf"] - (math.log(6 / 4) + 1)) < 1e-12
    assert not vectorizer.fit(docs, vectorizer.VectorizerParams(min_df=9)).fitted
    for bad in ({"max_features": 0}, {"ngram_min": 0}, {"ngram_max": 3}, {"ngram_min": 2, "ngram_max": 1}):
        with pytest.raises(ValueError):
            vectorizer.VectorizerParams(**bad)


def test_one_step():
    x = (np.array([0]), np.array([1.0]))
    m = svm.LinearModel(1)
    m.step(*x, 1, 0.001)
    assert np.allclose(m.weights[:, 0], [-0.0012, 0.0012, -0.0012]) and np.allclose(m.bias, [-0.00012, 0.00012, -0.00012]) and (m.steps, m.violations) == (1, 2)
    m = svm.LinearModel(1)
    m.step(*x, 0, 0.001)
    assert np.allclose(m.weights[:, 0], [0.0005, -0.0005, -0.0005])
    m = svm.LinearModel(1)
    m.step(*x, 1, 0.01)
    assert np.allclose(m.weights[1, 0], 0.005)
    m.bias[:] = [2, 0, 0]
    m.weights[:] = 0
    m.step(*x, 0, 0.01)
    assert not m.weights.any() and m.steps == 2
    assert svm.LinearModel(1, (10, 0.1, 1)).class_weights == (5, 0.5, 1)
    for bad in (0, -1, math.nan):
        with pytest.raises(ValueError):
            svm.LinearModel(1, (bad, 1, 1))
    for e, rate in ((1, 0.001), (2, 0.000892857), (10, 0.000480769), (96, 0.0000806452), (97, 0.00008)):
        assert abs(sc.learning_rate(e) - rate) < 1e-9
    assert svm.early_stop([0.5, 0.5002, 0.5001, 0.499]) == (0.5, 4)
    assert svm.early_stop([0.5, 0.5002, 0.5004, 0.5001])[0] == 0.5004


def corpus(spark):
    import random

    rng = random.Random(3)
    lexicon = {2: "good great fine", 0: "bad awful poor", 1: "okay average plain"}
    rows = [(k * 30 + i, f"the {rng.choice(lexicon[k].split())} {rng.choice('app was it'.split())} {rng.choice('app was it'.split())}", k) for k in lexicon for i in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_training_and_round_trips(spark, tmp_path):
    docs = corpus(spark)
    v = vectorizer.fit(docs)
    arrays = v.transform_arrays(docs, ("doc_id", "label"))
    model, history = svm.fit_sequential(arrays, arrays, v.size, epochs=20, rate_scale=100)
    assert history[-1].macro_f1 > 0.99
    again, _ = svm.fit_sequential(arrays.repartition(5), arrays, v.size, epochs=20, rate_scale=100)
    assert np.array_equal(model.weights, again.weights)
    store.write_vocabulary(v, str(tmp_path / "v"))
    store.write_model(model, spark, str(tmp_path / "m"))
    v2, m2 = store.read_vocabulary(spark, str(tmp_path / "v")), store.read_model(spark, str(tmp_path / "m"))
    assert v2.size == v.size and np.array_equal(m2.weights, model.weights) and m2.steps == model.steps
    bias = tuple(model.bias)
    a = {r["doc_id"]: (r["s0"], r["s1"], r["s2"]) for r in svm.decision_scores(v.transform(docs), model.table(spark), bias, docs).collect()}
    b = {r["doc_id"]: (r["s0"], r["s1"], r["s2"]) for r in svm.score_arrays(v.transform_arrays(docs), model).collect()}
    assert all(np.allclose(a[k], b[k]) for k in a)
    docs.write.parquet(str(tmp_path / "in"))
    got = score_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), v2, m2)
    q = got.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 90
    with pytest.raises(ValueError):
        score_stream(docs, v, svm.LinearModel(v.size + 1))


def test_batch_step_matches_formula(spark):
    docs = corpus(spark)
    v = vectorizer.fit(docs)
    got = {r["fid"]: np.array(r[1:]) for r in svm.batch_step(v.transform(docs), docs.select("doc_id", "label"), None, (0.0, 0.0, 0.0), 0.001).collect()}
    want: dict = {}
    labels = {r["doc_id"]: r["label"] for r in docs.collect()}
    for r in v.transform(docs).collect():
        y = labels[r["doc_id"]]
        u = min(0.001 * svm.CLASS_WEIGHTS[y] / 2, 0.005)
        want[r["fid"]] = want.get(r["fid"], np.zeros(3)) + np.array([u * r["x"] if c == y else -u * r["x"] for c in range(3)])
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in got)


def test_cache(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "src"))
    store.write_cache(dataset.split_rows(docs), str(tmp_path / "c"), str(tmp_path / "src"))
    assert store.cache_is_valid(spark, str(tmp_path / "c"), str(tmp_path / "src"))
    assert not store.cache_is_valid(spark, str(tmp_path / "c"), str(tmp_path / "src"), seed=5)
    assert not store.cache_is_valid(spark, str(tmp_path / "nothing"))
    m = store.read_manifest(spark, str(tmp_path / "c"))
    assert sum(store.read_cache(spark, str(tmp_path / "c"), s).count() for s in ("train", "validation", "test")) == m["train_rows"] + m["validation_rows"] + m["test_rows"]


def test_evaluator(spark):
    df = spark.createDataFrame(list(zip([2, 2, 1, 1, 0, 0], [2, 1, 1, 1, 0, 2])), "actual int, predicted int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df).collect()}
    assert [[cells[a, p] for p in range(3)] for a in range(3)] == [[1, 0, 1], [0, 2, 0], [0, 1, 1]]
    f1 = {r["class"]: round(r["f1"], 6) for r in evaluate.class_metrics(df).collect()}
    assert f1 == {0: 0.666667, 1: 0.8, 2: 0.5}
    s = evaluate.summary(df).first()
    assert round(s["accuracy"], 6) == 0.666667 and round(s["macro_f1"], 6) == round(s["weighted_f1"], 6) == 0.655556
    assert tuple(evaluate.summary(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0)
    only = evaluate.summary(spark.createDataFrame([(0, 0), (0, 0)], "actual int, predicted int")).first()
    assert (only["accuracy"], round(only["macro_f1"], 6), only["weighted_f1"]) == (1.0, 0.333333, 1.0)
    outside = evaluate.summary(spark.createDataFrame([(0, 0), (0, 7)], "actual int, predicted int")).first()
    assert outside["total_samples"] == 2 and outside["accuracy"] == 0.5


def test_prediction_record(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, 0.1, 0.2, 0.9), (3, -1.0, 0.0, 1.5), (4, 2.0, -1.0, -1.0)]
    got = {r["doc_id"]: r for r in predict.record(spark.createDataFrame(rows, "doc_id int, s0 double, s1 double, s2 double")).collect()}
    want = {1: (0, 0.0, "UNCERTAIN", "ABSTAIN"), 2: (2, 0.7, "LOW", "REVIEW"), 3: (2, 1.5, "MEDIUM", "ACCEPT"), 4: (0, 3.0, "HIGH", "ACCEPT")}
    for k, (label, gap, level, policy) in want.items():
        r = got[k]
        assert (r["label"], round(r["margin"], 9), r["level"], r["policy"]) == (label, gap, level, policy)
    assert round(got[2]["confidence"], 6) == 0.513897 and abs(got[4]["p0"] + got[4]["p1"] + got[4]["p2"] - 1) < 1e-12


def test_matrix(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0), (2, 1, 0.0)], "row bigint, col bigint, value double")
    assert [(r["row"], r["start"], r["n"]) for r in matrix.row_pointers(matrix.build(e, 3, 2), 3).orderBy("row").collect()] == [(0, 0, 1), (1, 1, 0), (2, 1, 1)]
    with pytest.raises(Exception, match="out of range"):
        matrix.build(e, 2, 2).collect()


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_batch_training_beyond_the_sequential_bound(spark, monkeypatch):
    rows = [(k, k % 3, [k % 3], [1.0]) for k in range(60)] + [(60, 0, [], [])]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, indices array<int>, values array<double>").repartition(3)
    monkeypatch.setattr(svm, "SEQUENTIAL_NONZEROS", 10)
    model, history = svm.fit(df, df, 3, epochs=20, rate_scale=10.0)
    assert [int(np.argmax(model.scores(np.array([c]), np.array([1.0])))) for c in range(3)] == [0, 1, 2]
    assert len(history) == 4 and [h.accepted for h in history] == [True, False, False, False] and model.steps == 8 * 60
    one, _ = svm.fit_batch(df.coalesce(1), df, 3, epochs=2)
    assert one.steps == 120 and svm.fit_batch(df.limit(0), df.limit(0), 3, epochs=2)[0].steps == 0


def test_whole_runs_use_the_default_parameters(monkeypatch):
    from corvane.operators.vectorizer import VectorizerParams
    from corvane.plans import pipeline, queries

    class Stop(Exception):
        pass

    def fit(df, params):
        assert params == VectorizerParams()
        raise Stop

    class Rows:
        persist = where = lambda self, *_: self

    monkeypatch.setattr(queries, "_docs", lambda *_: None)
    monkeypatch.setattr(dataset, "split_rows", lambda *_: Rows())
    monkeypatch.setattr(pipeline.F, "col", lambda *_: None)
    monkeypatch.setattr(pipeline.vectorizer, "fit", fit)
    for query in (queries.predict_pipeline, queries.svm_sequential_fit):
        with pytest.raises(Stop):
            query(None, "")


def test_commands(spark, tmp_path):
    from corvane.__main__ import main

    rows = []
    for k in range(400):
        word, label = [("good great", "positive"), ("bad awful", "negative"), ("okay plain", "neutral")][k % 3]
        rows.append((k, f"{word} number{chr(97 + k % 26)}{chr(97 + k // 26)} app", label))
    source = str(tmp_path / "source")
    spark.createDataFrame([*rows, (900, None, "positive"), (901, "", "negative")], "review_id bigint, review_text string, sentiment string").write.parquet(source)
    base, out = str(tmp_path / "run"), str(tmp_path / "out")
    assert main(["train", source, base, "--epochs", "3", "--max-features", "50", "--min-df", "2"], spark) == 0
    assert main(["predict", source, base, out], spark) == 0
    assert spark.read.parquet(out).count() == 400
    assert main(["evaluate", source, base], spark) == 0
    unknown = str(tmp_path / "unknown")
    spark.createDataFrame([(1, "zzz")], "review_id bigint, review_text string").write.parquet(unknown)
    assert main(["predict", unknown, base, out + "2", "--empty", "raise"], spark) == 1
    assert main(["predict", unknown, base, out + "3"], spark) == 0
    assert main(["train", str(tmp_path / "none"), base], spark) == 1 and main(["nothing"], spark) == 2


def test_guards(spark, tmp_path):
    import pytest

    from corvane.operators import svm, vectorizer
    from corvane.sources import store

    model = svm.LinearModel(2)
    model.weights[:, 0] = (1.0, 2.0, 3.0)
    odd = spark.createDataFrame([(1, [0, 7, -1], [1.0, 5.0, 5.0]), (2, [], [])], "doc_id bigint, indices array<int>, values array<double>")
    got = {r["doc_id"]: (r["s0"], r["s1"], r["s2"], r["has_features"]) for r in svm.score_arrays(odd, model).collect()}
    assert got == {1: (1.0, 2.0, 3.0, True), 2: (0.0, 0.0, 0.0, False)}
    path = str(tmp_path / "m")
    store.write_model(model, spark, path)
    spark.createDataFrame([(9, 1.0, 1.0, 1.0)], "fid int, w0 double, w1 double, w2 double").write.mode("append").parquet(f"{path}/weights")
    with pytest.raises(ValueError):
        store.read_model(spark, path)
    with pytest.raises(ValueError):
        store.read_cache(spark, str(tmp_path / "nothing"), "train")
    good = spark.createDataFrame([(0, "a", 3, 1.5), (1, "b", 3, 1.5)], "fid int, term string, df bigint, idf double")
    v = vectorizer.model_from_table(good)
    assert v.size == 2 and v.term(1) == "b"
    with pytest.raises(IndexError):
        v.term(2)
    assert not vectorizer.model_from_table(good.limit(0)).fitted and not vectorizer.model_from_table(good.withColumn("term", good["df"].cast("string"))).fitted
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "1 2")], "doc_id bigint, text string")
    assert {tuple(r) for r in vectorizer.term_frequency(docs, vectorizer.VectorizerParams(ngram_max=1)).collect()} == {(1, "a", 1), (1, "b", 2)}
