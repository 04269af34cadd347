"""Three-class linear model with weighted hinge loss: sequential and batch training, scoring."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from corvane.functions.scores import argmax, learning_rate

# Fixed values of the update rule and of the training loop.
CLASS_WEIGHTS = (1.0, 2.4, 1.0)
MARGIN, STEP_CAP, BIAS_SCALE = 1.0, 0.005, 0.1
REGULARIZATION = 0.00005
EPOCHS, VALIDATE_EVERY, PATIENCE, LEAST_GAIN = 500, 2, 3, 0.0003
#: Non-zero values that sequential training may gather in one place (about 12 bytes each).
SEQUENTIAL_NONZEROS = 20_000_000
#: Weight rows that are broadcast; more are joined by shuffle.
BROADCAST_WEIGHTS = 1_000_000


class LinearModel:
    def __init__(self, features: int, class_weights: tuple[float, float, float] = CLASS_WEIGHTS):
        if any(not math.isfinite(w) or w <= 0 for w in class_weights):
            raise ValueError("class weights must be finite and positive")
        self.features = features
        self.class_weights = tuple(min(5.0, max(0.5, w)) for w in class_weights)
        self.weights, self.bias = np.zeros((3, features)), np.zeros(3)
        self.trained, self.steps, self.violations = False, 0, 0

    def scores(self, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Bias + w.x of each class; indices outside the model count nothing."""
        ok = (indices >= 0) & (indices < self.features)
        return self.bias + self.weights[:, indices[ok]] @ values[ok]

    def step(self, indices: np.ndarray, values: np.ndarray, label: int, rate: float, regularization: float = REGULARIZATION) -> None:
        """One sample: every class within the margin of its own is pushed away, its own is drawn near.

        Only the sample's features decay, and only in classes that take part. Without
        violation nothing changes but the step count.
        """
        if not self.features or not 0 < rate < math.inf or not 0 <= regularization < math.inf or len(indices) != len(values) or not 0 <= label < 3:
            raise ValueError("bad training sample or rate")
        s = self.scores(indices, values)
        wrong = [c for c in range(3) if c != label and s[label] - s[c] < MARGIN]
        self.steps += 1
        self.trained = True
        if not wrong:
            return
        self.violations += len(wrong)
        u = min(rate * self.class_weights[label] / len(wrong), STEP_CAP)
        decay = min(1.0, max(0.0, 1 - rate * regularization))
        ok = (indices < self.features) & np.isfinite(values)
        at, x = indices[ok], values[ok]
        for c, sign in [(label, 1.0), *((c, -1.0) for c in wrong)]:
            self.weights[c, at] = self.weights[c, at] * decay + sign * u * x
            self.bias[c] += sign * BIAS_SCALE * u

    def table(self, spark) -> DataFrame:
        """(fid, w0, w1, w2) of the features with any weight."""
        at = np.flatnonzero(self.weights.any(0))
        return spark.createDataFrame([(int(k), *map(float, self.weights[:, k])) for k in at], "fid int, w0 double, w1 double, w2 double")


def decision_scores(vectors: DataFrame, weights: DataFrame, bias: tuple[float, float, float], docs: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(doc_id, s0, s1, s2). With `docs`, documents without features are kept and scored by the bias alone.

    Weights are counted and broadcast up to BROADCAST_WEIGHTS rows; `small` skips the count.
    """
    small = weights.count() <= BROADCAST_WEIGHTS if small is None else small
    w = F.broadcast(weights) if small else weights
    sums = vectors.join(w, "fid").groupBy("doc_id").agg(*[F.sum(F.col("x") * F.col(f"w{c}")).alias(f"d{c}") for c in range(3)])
    if docs is not None:
        sums = docs.select("doc_id").join(sums, "doc_id", "left")
    return sums.select("doc_id", *[(F.lit(float(bias[c])) + F.coalesce(f"d{c}", F.lit(0.0))).alias(f"s{c}") for c in range(3)])


def score_arrays(df: DataFrame, model: LinearModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., s0, s1, s2, has_features) of (…, indices, values) rows, where they are. The weights sent are 3 x features numbers."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            k = batch.num_columns
            index, value = batch.column(k - 2), batch.column(k - 1)
            lengths = np.diff(index.offsets.to_numpy())
            flat, x = index.flatten().to_numpy(), value.flatten().to_numpy()
            doc = np.repeat(np.arange(len(lengths)), lengths)
            # indices outside the model count nothing
            ok = (flat >= 0) & (flat < w.shape[1])
            if not ok.all():
                doc, flat, x = doc[ok], flat[ok], x[ok]
            s = [b[c] + np.bincount(doc, weights=w[c, flat] * x, minlength=len(lengths)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k - 2)), *map(pa.array, s), pa.array(lengths > 0)], [*batch.schema.names[:-2], "s0", "s1", "s2", "has_features"])

    src = df.select(*keep, "indices", "values")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    return src.mapInArrow(run, f"{schema}, s0 double, s1 double, s2 double, has_features boolean")


def batch_step(vectors: DataFrame, labels: DataFrame, weights: DataFrame | None, bias: tuple[float, float, float], rate: float, class_weights: tuple[float, float, float] = CLASS_WEIGHTS) -> DataFrame:
    """(fid, g0, g1, g2): what one pass over all samples from fixed weights would add, summed.

    A different algorithm from sequential training, for data of any size: the weights
    stay fixed during the pass, so the pass is one join and one pre-aggregated sum.
    labels: (doc_id, label).
    """
    own = vectors.join(labels, "doc_id")
    if weights is None:
        s = [F.lit(float(b)) for b in bias]
        scored = own.select("doc_id", "fid", "x", "label", *[c.alias(f"s{k}") for k, c in enumerate(s)])
    else:
        scored = own.join(decision_scores(vectors, weights, bias), "doc_id")
    mine = F.when(F.col("label") == 0, F.col("s0")).when(F.col("label") == 1, F.col("s1")).otherwise(F.col("s2"))
    wrong = [((F.col("label") != c) & (mine - F.col(f"s{c}") < MARGIN)).cast("int") for c in range(3)]
    count = wrong[0] + wrong[1] + wrong[2]
    cw = F.when(F.col("label") == 0, class_weights[0]).when(F.col("label") == 1, class_weights[1]).otherwise(class_weights[2])
    u = F.when(count > 0, F.least(F.lit(rate) * cw / F.greatest(count, F.lit(1)), F.lit(STEP_CAP))).otherwise(0.0)
    sign = [F.when(F.col("label") == c, F.when(count > 0, 1.0).otherwise(0.0)).otherwise(-wrong[c].cast("double")) for c in range(3)]
    return scored.select("fid", *[(sign[c] * u * F.col("x")).alias(f"g{c}") for c in range(3)]).groupBy("fid").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(3)])


@dataclass
class History:
    epoch: int
    macro_f1: float
    accepted: bool
    rate: float = 0.0
    seconds: float = 0.0


def report(spark, history: list[History]) -> DataFrame:
    """(epoch, macro_f1, accepted, rate, seconds): the validations of a training, seconds since its start."""
    return spark.createDataFrame([(h.epoch, h.macro_f1, h.accepted, h.rate, h.seconds) for h in history], "epoch int, macro_f1 double, accepted boolean, rate double, seconds double")


def early_stop(values: list[float], patience: int = PATIENCE, gain: float = LEAST_GAIN) -> tuple[float, int]:
    """(best accepted value, validations until the stop); a value is accepted if it beats the last accepted one by more than `gain`."""
    best, waited = -math.inf, 0
    for k, v in enumerate(values, 1):
        if v > best + gain:
            best, waited = v, 0
        else:
            waited += 1
            if waited >= patience:
                return best, k
    return best, len(values)


def macro_f1(actual: np.ndarray, predicted: np.ndarray) -> float:
    total = 0.0
    for c in range(3):
        hit = int(((actual == c) & (predicted == c)).sum())
        p, r = int((predicted == c).sum()), int((actual == c).sum())
        total += 2 * hit / (p + r) if p + r and hit else 0.0
    return total / 3


def nonzeros(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0)).alias("n")).first()["n"]


def gather(df: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature arrays, labels and ids of (doc_id, label, indices, values), after a check of their size."""
    size = nonzeros(df)
    if size > SEQUENTIAL_NONZEROS:
        raise ValueError(f"{size} values are too many for sequential training; use fit_batch")
    t = df.select("doc_id", "label", "indices", "values").toArrow()
    order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
    # views of the flat columns: lists of Python numbers would take several times the values' size
    lengths = pa.compute.list_value_length(t.column("indices")).to_numpy()
    ends = np.cumsum(lengths)
    ind, val = (pa.compute.list_flatten(t.column(c)).to_numpy() for c in ("indices", "values"))
    spans = [(ends[k] - lengths[k], ends[k]) for k in order]
    return [ind[a:b] for a, b in spans], [val[a:b] for a, b in spans], t.column("label").to_numpy()[order], t.column("doc_id").to_numpy()[order]


def fit_sequential(train: DataFrame, validation: DataFrame, features: int, epochs: int = EPOCHS, rate_scale: float = 1.0, class_weights: tuple[float, float, float] = CLASS_WEIGHTS, seed: int = 1) -> tuple[LinearModel, list[History]]:
    """Sample-by-sample training with early stop on macro-F1; the best weights are restored.

    Samples of an epoch are ordered by a hash of identifier and epoch, so the result does
    not depend on partitioning. Samples without features are skipped in training and
    scored by bias in validation.
    """
    model = LinearModel(features, class_weights)
    ind, val, labels, ids = gather(train)
    vi, vv, vl, _ = gather(validation)
    best, best_state, waited, history, began = -math.inf, None, 0, [], time.time()
    for epoch in range(1, epochs + 1):
        rate = learning_rate(epoch) * rate_scale
        keys = (ids.astype(np.uint64) + np.uint64((epoch * 0x9E3779B97F4A7C15 + seed) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(31)
        for k in np.lexsort((ids, keys)).tolist():
            if len(ind[k]):
                model.step(ind[k], val[k], int(labels[k]), rate)
        if epoch % VALIDATE_EVERY == 0 or epoch == epochs:
            predicted = np.array([int(np.argmax(model.scores(i, v))) for i, v in zip(vi, vv)], int)
            f1 = macro_f1(vl, predicted)
            good = f1 > best + LEAST_GAIN
            history.append(History(epoch, f1, good, learning_rate(epoch) * rate_scale, time.time() - began))
            if good:
                best, waited, best_state = f1, 0, (model.weights.copy(), model.bias.copy())
            else:
                waited += 1
                if waited >= PATIENCE:
                    break
    if best_state:
        model.weights, model.bias = best_state
    return model, history


def fit_batch(train: DataFrame, validation: DataFrame, features: int, epochs: int = EPOCHS, rate_scale: float = 1.0, class_weights: tuple[float, float, float] = CLASS_WEIGHTS) -> tuple[LinearModel, list[History]]:
    """Training of any size: in every epoch each partition takes its samples one by one from the shared
    weights, and the weights become the mean of the partitions', by their samples.

    Update rule, rates, validation and early stop are those of `fit_sequential`, but the result
    depends on the partitioning. No samples are gathered; a task holds 3 x features numbers.
    """
    model = LinearModel(features, class_weights)
    spark = train.sparkSession
    train = train.select("label", "indices", "values").persist()
    validation = validation.select("label", "indices", "values").persist()

    def one_pass(rate: float) -> None:
        shared = spark.sparkContext.broadcast((model.weights, model.bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = LinearModel(features, class_weights)
            own.weights, own.bias = (x.copy() for x in shared.value)
            for batch in batches:
                for label, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                    if i:
                        own.step(np.array(i, np.int64), np.array(v), label, rate)
            if own.steps:
                at = np.flatnonzero(own.weights.any(0))
                fid = np.concatenate([at, [-1, -2]])
                cols = [np.concatenate([own.weights[c, at] * own.steps, [own.bias[c] * own.steps, (own.steps, own.violations, 0)[c]]]) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(fid, pa.int64()), *map(pa.array, cols)], ["fid", "w0", "w1", "w2"])

        sums = train.mapInArrow(run, "fid bigint, w0 double, w1 double, w2 double").groupBy("fid").agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in range(3)]).toArrow()
        shared.unpersist()
        fid, w = sums.column("fid").to_numpy(), np.array([sums.column(f"w{c}").to_numpy() for c in range(3)])
        if not len(fid):
            return
        steps, violations, _ = w[:, fid == -2][:, 0]
        model.trained, model.steps, model.violations = True, model.steps + int(steps), model.violations + int(violations)
        model.bias = w[:, fid == -1][:, 0] / steps
        model.weights = np.zeros((3, features))
        model.weights[:, fid[fid >= 0]] = w[:, fid >= 0] / steps

    best, best_state, waited, history, began = -math.inf, None, 0, [], time.time()
    for epoch in range(1, epochs + 1):
        one_pass(learning_rate(epoch) * rate_scale)
        if epoch % VALIDATE_EVERY == 0 or epoch == epochs:
            scored = score_arrays(validation, model, ("label",)).select("label", argmax([F.col(f"s{c}") for c in range(3)]).alias("predicted"))
            cells = scored.groupBy("label", "predicted").count().collect()
            actual, predicted = (np.repeat([r[k] for r in cells], [r["count"] for r in cells]) if cells else np.array([], int) for k in ("label", "predicted"))
            f1 = macro_f1(actual, predicted)
            good = f1 > best + LEAST_GAIN
            history.append(History(epoch, f1, good, learning_rate(epoch) * rate_scale, time.time() - began))
            if good:
                best, waited, best_state = f1, 0, (model.weights.copy(), model.bias.copy())
            else:
                waited += 1
                if waited >= PATIENCE:
                    break
    if best_state:
        model.weights, model.bias = best_state
    train.unpersist()
    validation.unpersist()
    return model, history


def fit(train: DataFrame, validation: DataFrame, features: int, epochs: int = EPOCHS, rate_scale: float = 1.0) -> tuple[LinearModel, list[History]]:
    """`fit_sequential` where all values can be gathered, else `fit_batch`."""
    small = max(nonzeros(train), nonzeros(validation)) <= SEQUENTIAL_NONZEROS
    return (fit_sequential if small else fit_batch)(train, validation, features, epochs, rate_scale)
