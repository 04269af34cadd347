"""Problem 4: a sample with wanted category shares.

1. The usable records are counted by cell (label x source x language); only these
   counts, whose number is bounded by the category values, are gathered per plan.
2. Iterative proportional fitting rakes the cells of each plan to several margins at
   once: the plan's label shares, and the observed source and language shares of its
   records. No cell gets more than it has.
3. The raked cells are the quotas. Their label sums are repaired up to the minimum and
   down to what there is, and rounded within each label to whole records.
4. Every record draws an exponential key -ln(u)/w with its raked weight; a cell's sample
   is its records of the smallest keys.
5. The report states wanted, drawn and missing records per plan and class; the margins
   state the gap that is left for every category of every margin.

The k smallest keys of a cell are found without sorting it: a histogram of the keys
(pre-aggregated, about BIN_ROWS records to a bin) gives the bin that holds the k-th, and
only that bin's records are ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.llm.common import cut, norm_source

NO_SOURCE = "\x00"
LABELS = ("negative", "neutral", "positive")
#: Records of one bin of the key histogram: what is ranked in one task at most, but for chance.
BIN_ROWS = 2000
#: Plans x classes are broadcast; beyond this many rows they are joined by shuffle.
PLAN_ROWS = 100_000


def usable(reviews: DataFrame) -> DataFrame:
    """(review_id, label, source, lang) of records with a known class and a text.

    The class is `negative`/`0`, `neutral`/`1` or `positive`/`2`, ignoring case and
    surrounding whitespace; other and null classes, null and '' texts are left out.
    """
    s = F.lower(F.regexp_replace("sentiment", r"^\s+|\s+$", ""))
    label = F.coalesce(*[F.when(s.isin(name, str(k)), F.lit(k)) for k, name in enumerate(LABELS)])
    return (
        reviews.where(F.col("review_text").isNotNull() & (F.col("review_text") != ""))
        .select("review_id", label.alias("label"), norm_source("source").alias("source"), F.lower(F.coalesce("lang", F.lit("?"))).alias("lang"))
        # a missing source is a category of its own, which no plan names
        .withColumn("source", F.coalesce("source", F.lit(NO_SOURCE)))
        .where(F.col("label").isNotNull())
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= PLAN_ROWS else df


def fill(w: np.ndarray, n: np.ndarray, total: float) -> np.ndarray:
    """Masses in proportion to w, at most n each, that sum to `total` or to all there is."""
    out, open_, left = np.zeros(len(w)), n > 0, min(total, float(n.sum()))
    w = np.where(n > 0, np.maximum(w, 1e-300), 0.0)
    while left > 0 and open_.any():
        give = w * open_ * (left / (w * open_).sum())
        full = open_ & (give >= n)
        if not full.any():
            return out + give
        out[full] = n[full]
        open_ &= ~full
        left = min(total, float(n.sum())) - out.sum()
    return out


def rake(n: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Iterative proportional fitting of cells that hold n records to wanted masses per category, the last margin exactly.

    axes[k] holds each cell's category on margin k, targets[k] the wanted mass of each.
    No cell gets more than n; what a category can't hold goes to no other of its margin.
    """
    w = n.astype(float)
    for _ in range(rounds):
        before = w
        for axis, target in zip(axes, targets):
            after = np.zeros(len(w))
            for c in np.unique(axis).tolist():
                at = axis == c
                after[at] = fill(w[at], n[at], float(target[c]))
            w = after
        if np.abs(w - before).max(initial=0.0) < tol * max(1.0, w.sum()):
            break
    return w


def whole(w: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Whole records for masses w, at most n each, that sum to `total`: the largest remainders are rounded up."""
    q = np.minimum(np.floor(w + 1e-9), n).astype(np.int64)
    order = np.lexsort((np.arange(len(w)), q - w))
    while q.sum() < total:
        room = order[(q < n)[order]]
        if not len(room):
            break
        q[room[: total - int(q.sum())]] += 1
    return q


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["label", "source", "lang"]).reset_index(drop=True)
    n = pdf["n"].to_numpy(dtype=float)
    labels, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
    share, frac, least = (pdf.groupby("label")[c].first().reindex(labels).fillna(0.0).to_numpy(dtype=float) for c in ("target_share", "sample_frac", "min_rows"))
    available = np.bincount(label, weights=n)
    wanted = share * frac * n.sum()
    size = np.minimum(wanted, available).sum()
    axes, targets = [], []
    for name in ("source", "lang"):
        values, x = np.unique(pdf[name].to_numpy(dtype=str), return_inverse=True)
        axes.append(x)
        targets.append(np.bincount(x, weights=n) / n.sum() * size)
    axes.append(label)
    targets.append(np.minimum(wanted, available))
    raked = rake(n, axes, targets)
    # minimums are repaired, then the cells of each label rounded to whole records
    drawn = np.minimum(np.maximum(np.floor(wanted + 0.5), least), available)
    quota = np.zeros(len(n), np.int64)
    for k in range(len(labels)):
        at = label == k
        quota[at] = whole(fill(np.where(raked[at] > 0, raked[at], n[at] * 1e-9), n[at], drawn[k]), n[at], int(drawn[k]))
    return pdf.assign(raked=raked, quota=quota, weight=np.divide(raked, n, out=np.ones_like(n), where=raked > 0))[["plan_id", "label", "source", "lang", "n", "raked", "quota", "weight"]]


CELL = "plan_id int, label int, source string, lang string, n bigint, raked double, quota bigint, weight double"


def cells(reviews: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, label, source, lang, n, raked, quota, weight): what each cell holds and gives to a plan."""
    counts = usable(reviews).groupBy("label", "source", "lang").agg(F.count("*").alias("n"))
    p = plans.select("plan_id", norm_source("source").alias("plan_source"), F.col("label").alias("plan_label"), "target_share", "sample_frac", "min_rows")
    # plans of all sources and plans of one are both found by equal keys
    of = _small(p.select("plan_id", F.struct(F.col("plan_source").isNull().alias("all"), F.coalesce("plan_source", F.lit("")).alias("source")).alias("key")).distinct())
    keyed = counts.withColumn("key", F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("source")), F.struct(F.lit(False).alias("all"), F.col("source").alias("source")))))
    share = _small(p.select("plan_id", F.col("plan_label").alias("label"), "target_share", "sample_frac", "min_rows"))
    return keyed.join(of, "key").drop("key").join(share, ["plan_id", "label"], "left").groupBy("plan_id").applyInPandas(_fit, CELL)


def report(reviews: DataFrame, plans: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """One row per plan and class, classes without records included.

    wanted = target_share * sample_frac * |U| as a number with a fraction; raked = what the
    fitted cells can give of it; drawn = the cells' quotas after the repair of minimums;
    gap = how many records fail to reach the larger of wanted and min_rows, rounded up (0
    when met).
    """
    fitted = cells(reviews, plans) if fitted is None else fitted
    have = fitted.groupBy("plan_id", "label").agg(F.sum("n").alias("available"), F.sum("raked").alias("raked"), F.sum("quota").alias("drawn"))
    total = fitted.groupBy("plan_id").agg(F.sum("n").alias("usable"))
    out = plans.select("plan_id", "source", "label", "target_share", "sample_frac", "min_rows").join(have, ["plan_id", "label"], "left").join(total, "plan_id", "left")
    out = out.fillna(0, ["available", "usable", "drawn"]).fillna(0.0, ["raked"])
    wanted = F.col("target_share") * F.col("sample_frac") * F.col("usable")
    need = F.greatest(wanted, F.col("min_rows").cast("double"))
    # a class is unmet if even all of its cells, the most that raking and repair can give, fall short
    unmet = (F.col("drawn") >= F.col("available")) & (F.col("available") < need)
    return out.select(
        "plan_id", F.col("label").cast("int").alias("label"), norm_source("source").alias("source"), "usable", "available",
        wanted.alias("wanted"), F.col("min_rows").cast("int").alias("min_rows"), "raked", "drawn",
        F.greatest(F.ceil(need) - F.col("available"), F.lit(0)).cast("bigint").alias("gap"), unmet.alias("unmet"),
    )


def margins(reviews: DataFrame, plans: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """(plan_id, margin, category, records, drawn, wanted, gap): for each margin of a plan, the category's
    observed share of all that is drawn (labels: of the raked size) and what is left to it.
    """
    fitted = cells(reviews, plans) if fitted is None else fitted
    long = fitted.select("plan_id", "n", "quota", F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("category")) for m in ("label", "source", "lang")])).alias("m"))
    by = long.groupBy("plan_id", "m.margin", "m.category").agg(F.sum("n").alias("records"), F.sum("quota").alias("drawn"))
    total = fitted.groupBy("plan_id").agg(F.sum("n").alias("n"), F.sum("quota").alias("q"))
    share = plans.select("plan_id", F.lit("label").alias("margin"), F.col("label").cast("string").alias("category"), (F.col("target_share") * F.col("sample_frac")).alias("f"))
    out = by.join(total, "plan_id").join(share, ["plan_id", "margin", "category"], "left")
    wanted = F.when(F.col("margin") == "label", F.coalesce("f", F.lit(0.0)) * F.col("n")).otherwise(F.col("records") / F.col("n") * F.col("q"))
    return out.select("plan_id", "margin", "category", "records", "drawn", wanted.alias("wanted"), (wanted - F.col("drawn")).alias("gap"))


def sample(reviews: DataFrame, plans: DataFrame, seed: int = 1) -> DataFrame:
    """(plan_id, label, review_id) of the drawn records.

    The draw depends only on identifiers and seed, not on partitioning. Equal keys are
    ordered by identifier. A plan without records gives none.
    """
    w = _small(cut(cells(reviews, plans).where("quota > 0")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "plan_id", "review_id"), 11) + F.lit(1)) / F.lit(float(2**53 + 1))
    keyed = usable(reviews).join(w, ["label", "source", "lang"]).withColumn("key", -F.log(u) / F.col("weight"))
    cell = ["plan_id", "label", "source", "lang"]
    # keys of a cell are exponential with its weight, so these bins hold about equally many
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / BIN_ROWS))
    keyed = keyed.select(*cell, "review_id", "key", "quota", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("weight"))) * bins), bins - 1).alias("bin"))
    counted = keyed.groupBy(*cell, "bin").agg(F.count("*").alias("n"), F.first("quota").alias("quota"))
    over = W.partitionBy(*cell).orderBy("bin")
    below = counted.withColumn("before", F.sum("n").over(over) - F.col("n"))
    last = below.where("before < quota and before + n >= quota").select(*cell, F.col("bin").alias("last"), (F.col("quota") - F.col("before")).alias("more"))
    at = keyed.join(_small(cut(last)), cell).where("bin <= last")
    rank = F.row_number().over(W.partitionBy(*cell).orderBy("key", "review_id"))
    inside = at.where("bin < last").select("plan_id", "label", "review_id")
    edge = at.where("bin = last").withColumn("r", rank).where("r <= more").select("plan_id", "label", "review_id")
    return inside.unionByName(edge)
