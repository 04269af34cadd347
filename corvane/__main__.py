"""Commands: train, predict and evaluate over tables. Exit codes: 0 done, 1 failed, 2 wrong call."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from corvane.operators import svm, vectorizer
from corvane.plans import pipeline
from corvane.sources import store


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("train", "fit vocabulary and model on labelled Parquet"), ("predict", "write prediction records"), ("evaluate", "print the metrics of a model over labelled Parquet")):
        c = sub.add_parser(name, help=text)
        c.add_argument("source", help="Parquet with review_text, and sentiment unless predicting")
        c.add_argument("base", help="folder of the run's tables")
        c.add_argument("--id", default="review_id")
        if name == "train":
            c.add_argument("--max-features", type=int, default=500_000)
            c.add_argument("--min-df", type=int, default=3)
            c.add_argument("--epochs", type=int, default=svm.EPOCHS)
        if name == "predict":
            c.add_argument("output")
            c.add_argument("--empty", choices=("flag", "raise"), default="flag", help="what a text without known features is")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    at = store.paths(a.base)
    source = spark.read.parquet(a.source)
    if a.command == "train":
        if not store.cache_is_valid(spark, at["cache"], a.source):
            store.write_cache(pipeline.split(source, a.id), at["cache"], a.source)
        rows = spark.read.parquet(f"{at['cache']}/rows")
        done = pipeline.train(rows, vectorizer.VectorizerParams(max_features=a.max_features, min_df=a.min_df), a.epochs)
        store.write_vocabulary(done.vectorizer, at["vocabulary"])
        store.write_model(done.model, spark, at["weights"])
        svm.report(spark, done.history).coalesce(1).write.mode("overwrite").parquet(at["report"])
        done.test.coalesce(1).write.mode("overwrite").parquet(at["metrics"])
        print("vocabulary", done.vectorizer.report(rows.where("split = 'train'")))
        done.vectorizer.release()
        for h in done.history:
            print(f"epoch {h.epoch}: macro-F1 {h.macro_f1:.4f}, rate {h.rate:.3g}, {h.seconds:.1f} s{'' if h.accepted else ', not better'}")
        return
    v, model = store.read_vocabulary(spark, at["vocabulary"]), store.read_model(spark, at["weights"])
    if a.command == "predict":
        docs = source.where(F.col("review_text").isNotNull() & (F.col("review_text") != "")).select(F.col(a.id).alias("doc_id"), F.col("review_text").alias("text"))
        pipeline.predict_texts(docs, v, model, empty=a.empty).write.mode("overwrite").parquet(a.output)
        return
    rows = pipeline.split(source, a.id)
    print(pipeline.evaluate_model(v.transform_arrays(rows, ("doc_id", "label")), model).first().asDict())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = arguments().parse_args(argv)
    except SystemExit as wrong:
        return 0 if wrong.code == 0 else 2
    try:
        run(spark or SparkSession.builder.appName("corvane").getOrCreate(), a)
    except Exception as failed:
        print(f"corvane {a.command}: {str(failed).splitlines()[0] if str(failed) else type(failed).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
