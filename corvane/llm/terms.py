"""Problem 3: occurrences and document frequency of every term.

Vertical layout: each term owns compressed bitmaps of record identifiers, one
container for every 65,536 consecutive identifiers, with an occurrence counter
beside it. Tasks build containers for the rows they read, containers of one
(term, chunk) are merged by union, and the document frequency is the summed
cardinality. A container never exceeds 8 KB, and a frequent term is spread over
as many keys as there are identifier chunks, so no key holds a term's whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import spread

CHUNK_BITS = 16
ARRAY_MAX = 4096
FLUSH_ENTRIES = 2_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))

SCHEMA = "term string, chunk bigint, bits binary, occurrences bigint"


def tokens(text: str) -> list[bytes]:
    """ASCII letter runs in lower case; every other byte separates."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def encode(low: np.ndarray) -> bytes:
    """Sorted distinct uint16 values as the smallest of array, runs or bitmap container."""
    n = len(low)
    if n == 1:
        return b"a" + low.tobytes()
    breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
    runs = len(breaks) + 1
    if runs * 4 < min(2 * n, 8192):
        starts = low[np.concatenate(([0], breaks + 1))]
        ends = low[np.concatenate((breaks, [n - 1]))]
        return b"r" + np.stack([starts, ends], 1).astype("<u2").tobytes()
    if n <= ARRAY_MAX:
        return b"a" + low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def decode(data: bytes) -> np.ndarray:
    kind, body = data[:1], data[1:]
    if kind == b"a":
        return np.frombuffer(body, "<u2")
    if kind == b"r":
        pairs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        return np.concatenate([np.arange(a, b + 1) for a, b in pairs]).astype("<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")).astype("<u2")


def union(parts: list[bytes]) -> bytes:
    return parts[0] if len(parts) == 1 else encode(np.unique(np.concatenate([decode(p) for p in parts])))


def cardinality(data: bytes) -> int:
    if data[:1] == b"a":
        return (len(data) - 1) // 2
    return len(decode(data))


def _containers(names: list[bytes], codes: list, ids: list) -> pa.RecordBatch:
    code = np.concatenate(codes)
    doc = np.concatenate(ids)
    order = np.lexsort((doc, code))
    code, doc = code[order], doc[order]
    new_pair = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(new_pair)
    count = np.diff(np.append(at, len(code)))
    code, doc = code[at], doc[at]
    chunk = doc >> CHUNK_BITS
    low = (doc & 0xFFFF).astype("<u2")
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1]))))
    ends = np.append(first[1:], len(code))
    occurrences = np.add.reduceat(count, first)
    bits = [b"a" + low[a:b].tobytes() if b - a < 3 else encode(low[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array([names[c].decode() for c in code[first].tolist()], pa.string()), pa.array(chunk[first], pa.int64()), pa.array(bits, pa.binary()), pa.array(occurrences, pa.int64())],
        ["term", "chunk", "bits", "occurrences"],
    )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    codes, ids, held = [], [], 0
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = tokens(text)
            if found:
                codes.append(np.array([known.setdefault(t, len(known)) for t in found], np.int64))
                ids.append(np.full(len(found), id_, np.int64))
                held += len(found)
            if held >= FLUSH_ENTRIES:
                yield _containers(list(known), codes, ids)
                known, codes, ids, held = {}, [], [], 0
    if codes:
        yield _containers(list(known), codes, ids)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of consecutive rows of one (term, chunk); the input is sorted by them."""
    key, parts, total = None, [], 0

    def one():
        bits = union(parts)
        return key[0], key[1], bits, cardinality(bits), total

    def batch_of(rows):
        cols = list(zip(*rows))
        types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["term", "chunk", "bits", "reviews", "occurrences"])

    out = []
    for batch in batches:
        for term, chunk, bits, occ in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != (term, chunk):
                if parts:
                    out.append(one())
                key, parts, total = (term, chunk), [], 0
            parts.append(bits)
            total += occ
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
    if parts:
        out.append(one())
    if out:
        yield batch_of(out)


def term_bitmaps(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, chunk, bits, reviews, occurrences): the merged containers.

    Null and empty texts add nothing. A text without letters has no term.
    Identifiers must be non-negative and unique; a repeated identifier counts once
    in `reviews` and every time in `occurrences`. Null identifiers are rejected
    by the filter. Other columns are not read.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    built = spread(src).mapInArrow(_build, SCHEMA)
    keyed = built.repartition(F.col("term"), F.col("chunk")).sortWithinPartitions("term", "chunk")
    return keyed.mapInArrow(_merge, "term string, chunk bigint, bits binary, reviews bigint, occurrences bigint")


def term_statistics(df: DataFrame, id_col: str = "review_id", text_col: str = "review_text", min_reviews: int = 3, common_share: float = 0.2) -> DataFrame:
    """(term, occurrences, reviews, mark); mark is 'rare', 'common' or null.

    rare: fewer than `min_reviews` records; common: more than `common_share` of the
    records whose text is neither null nor empty. Rare wins where both hold. An
    empty table gives no row.
    """
    n = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).count()
    totals = term_bitmaps(df, id_col, text_col).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("reviews").alias("reviews"))
    mark = F.when(F.col("reviews") < min_reviews, "rare").when(F.col("reviews") > F.lit(common_share) * F.lit(n), "common")
    return totals.withColumn("mark", mark)
