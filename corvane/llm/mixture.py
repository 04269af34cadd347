"""Problem 8: mixing sources to target weights by pivotal rounding.

Every document of a source is due c copies, c = the source's target tokens over its
tokens, at most `max_repeats`. floor(c) copies are certain; the fraction is rounded by
the pivotal method: two documents meet, token mass moves between them at random,
without bias, until one of their fractions is 0 or 1, and the other goes on. Moving
mass, not probability, keeps the tokens drawn equal to the target but for one document.

Documents are spread over nodes by a hash of their identifier, as many as their number
asks for. A node runs the tournament over its rows in order of identifiers and leaves at
most one unsettled document for each mix and source; these meet in a reduction tree of
fixed fan-in until one node is left. The draw depends on identifiers, sizes and the seed,
not on how the rows are partitioned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import cut, norm_source

FAN_IN = 32
#: Documents of a node on the average.
NODE_DOCS = 20_000
EPS = 1e-12
#: Mix rows are broadcast; beyond this many they are joined by shuffle.
MIX_ROWS = 100_000


def duel(rng: random.Random, a: list, b: list) -> tuple[list, list]:
    """a, b: [id, tokens, fraction]. Returns (settled, unsettled); fractions in 0..1."""
    (_, na, pa_), (_, nb, pb) = a, b
    up = min((1 - pa_) * na, pb * nb)  # mass that can move from b to a
    down = min(pa_ * na, (1 - pb) * nb)
    move = up if rng.random() * (up + down) < down else -down
    a[2] = pa_ + move / na
    b[2] = pb - move / nb
    for x in (a, b):
        if x[2] < EPS:
            x[2] = 0.0
        elif x[2] > 1 - EPS:
            x[2] = 1.0
    return (a, b) if a[2] in (0.0, 1.0) else (b, a)


def _settle(rng: random.Random, rows: list[list], carry: list | None, out: list) -> list | None:
    """Runs rows through the tournament; settled ones go to out, the open one is returned."""
    for row in rows:
        if row[2] in (0.0, 1.0):
            out.append(row)
            continue
        if carry is None:
            carry = row
            continue
        done, carry = duel(rng, carry, row)
        out.append(done)
        if carry[2] in (0.0, 1.0):
            out.append(carry)
            carry = None
    return carry


PAIRS = "mix_id int, source string, doc_id bigint, tokens bigint, whole bigint, fraction double, node bigint"


def _local(seed: int):
    """Rows (mix_id, source, doc_id, tokens, copies, node) of whole nodes, sorted by node and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict = {}
        whole: dict = {}
        now = None

        def emit(rows):
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(c, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                ["mix_id", "source", "doc_id", "tokens", "whole", "fraction", "node"],
            )

        def rest():
            out = [(*key, x[0], x[1], whole[key], x[2], now) for key, x in carry.items() if x is not None]
            carry.clear()
            rngs.clear()
            return out

        rngs: dict = {}
        for batch in batches:
            rows = []
            for mix, source, doc, tokens, copies, node in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if node != now:
                    rows += rest()
                    now = node
                key = (mix, source)
                base = whole[key] = int(copies)
                rng = rngs.get(key) or rngs.setdefault(key, random.Random(f"{seed}:{key}:{node}"))
                done: list = []
                carry[key] = _settle(rng, [[doc, tokens, copies - base]], carry.get(key), done)
                rows += [(*key, d, n, base, p, node) for d, n, p in done]
            if rows:
                yield emit(rows)
        rows = rest()
        if rows:
            yield emit(rows)

    return run


def _merge(seed: int, last: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "doc_id", "tokens"])
        done: list = []
        items = [[d, t, p] for d, t, p in zip(pdf["doc_id"], pdf["tokens"], pdf["fraction"])]
        carry = _settle(random.Random(f"{seed}:merge:{key}"), items, None, done)
        if carry is not None:
            if last:
                carry[2] = float(random.Random(f"{seed}:last:{key}").random() < carry[2])
            done.append(carry)
        got = pd.DataFrame(done, columns=["doc_id", "tokens", "fraction"])
        first = pdf.iloc[0]
        return got.assign(mix_id=first["mix_id"], source=first["source"], whole=first["whole"], node=key[2])[["mix_id", "source", "doc_id", "tokens", "whole", "fraction", "node"]]

    return run


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens); documents without a positive token count have no size and are left out."""
    return documents.select("doc_id", norm_source("source").alias("source"), F.col("n_tokens").cast("bigint").alias("tokens")).where("tokens > 0")


def plan(documents: DataFrame, mixes: DataFrame) -> DataFrame:
    """One row per mix and source with its target and the copies due to each document."""
    of = sizes(documents).groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    all_tokens = documents.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("t")).first()["t"]
    m = mixes.select("mix_id", F.col("source").alias("source_name"), norm_source("source").alias("source"), "target_share", "max_repeats", "budget_frac")
    out = m.join(of, "source", "left").fillna(0, ["source_tokens", "source_docs"])
    target = F.col("target_share") * F.col("budget_frac") * F.lit(all_tokens)
    most = F.col("max_repeats") * F.col("source_tokens")
    copies = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), target / F.greatest(F.col("source_tokens"), F.lit(1)))).otherwise(0.0)
    return out.select("mix_id", "source_name", "source", "target_share", "max_repeats", "source_docs", "source_tokens", target.alias("target_tokens"), copies.alias("copies"), (most < target).alias("short"))


def mix(documents: DataFrame, planned: DataFrame, seed: int = 1) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies), one row per document drawn at least once.

    Ties and repeated rows are separate documents. An empty table gives no row. Of every
    mix and source the tokens drawn differ from what is due by less than one document.
    """
    few = planned.select(F.col("mix_id").cast("int").alias("mix_id"), "source", "copies").where("copies > 0 and source is not null")
    small = few.count() <= MIX_ROWS
    src = sizes(documents)
    nodes = max(1, -(-src.count() // NODE_DOCS))
    placed = src.withColumn("node", F.pmod(F.xxhash64("doc_id"), F.lit(nodes)))
    # where the mixes are few, sizes are shuffled before they are multiplied by them
    ordered = placed.repartition("node").join(F.broadcast(few), "source") if small else placed.join(few, "source").repartition("node")
    ordered = ordered.sortWithinPartitions("node", "doc_id", "tokens")
    state = cut(ordered.select("mix_id", "source", "doc_id", "tokens", "copies", "node").mapInArrow(_local(seed), PAIRS))
    done = state.where("fraction in (0.0, 1.0)")
    rest = state.where("fraction > 0.0 and fraction < 1.0")
    while True:
        nodes = -(-nodes // FAN_IN)
        rest = rest.withColumn("up", F.floor(F.col("node") / FAN_IN)).groupBy("mix_id", "source", "up").applyInPandas(_merge(seed, nodes == 1), PAIRS)
        if nodes == 1:
            break
        rest = cut(rest)
        done = done.unionByName(rest.where("fraction in (0.0, 1.0)"))
        rest = rest.where("fraction > 0.0 and fraction < 1.0")
    out = done.unionByName(rest).select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.col("fraction").cast("bigint")).alias("copies"))
    return out.where("copies > 0")


def report(documents: DataFrame, mixes: DataFrame, seed: int = 1) -> DataFrame:
    """One row per mix row: target and reached tokens and shares, and whether the source falls short.

    Sources without documents reach 0. The share reached is of the mix's drawn tokens.
    """
    planned = cut(plan(documents, mixes))
    drawn = mix(documents, planned, seed).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    out = planned.join(drawn, ["mix_id", "source"], "left").fillna(0, ["drawn_tokens", "most_copies"])
    total = out.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    share = F.when(F.col("mix_tokens") > 0, F.col("drawn_tokens") / F.col("mix_tokens")).otherwise(0.0)
    return out.join(total, "mix_id").select(
        "mix_id", F.col("source_name").alias("source"), "target_share", share.alias("actual_share"), "target_tokens", "drawn_tokens", "source_tokens", "source_docs", "copies", "most_copies", "max_repeats", "short"
    )
