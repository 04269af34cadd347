"""Normalisation, FNV-1a and the split rule: plain Python forms for Arrow code, Column forms for plans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Fixed values of the hash and the split.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
SPLIT_SEED = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_DROP = re.compile(r"[^A-Za-z0-9 \t\n\x0b\f\r]")
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def signed(x: int) -> int:
    """An unsigned 64-bit number as the signed one of the same bits."""
    return x - (1 << 64) if x >> 63 else x


def normalize_py(text: str) -> str:
    return _BLANK.sub(" ", _DROP.sub("", text)).strip(" ").lower()


def fnv1a_py(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def split_py(text: str, seed: int) -> str | None:
    """train, validation or test of a text under an unsigned or signed seed; None if nothing is left of it."""
    n = normalize_py(text)
    if not n:
        return None
    bucket = (fnv1a_py(n) ^ (seed & MASK)) % 1000
    return "train" if bucket < 800 else "validation" if bucket < 900 else "test"


def normalize(text: Column) -> Column:
    """ASCII letters and digits in lower case, blank runs as one space, everything else deleted. Null stays null."""
    kept = F.regexp_replace(text, r"[^A-Za-z0-9 \t\n\x0B\f\r]", "")
    return F.lower(F.trim(F.regexp_replace(kept, r"[ \t\n\x0B\f\r]+", " ")))


def fnv1a(text: Column) -> Column:
    """FNV-1a of an ASCII text as signed BIGINT.

    The prime is 2**40 + 435; the product is put together from 32-bit halves so that
    no step leaves the signed range, which ANSI arithmetic would reject.
    """

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        low = x.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(435)
        high = (F.shiftrightunsigned(x, 32) * F.lit(435) + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(signed(FNV_OFFSET)).cast("bigint"), step)


def bucket(h: Column, seed: int | Column = SPLIT_SEED, buckets: int = 1000) -> Column:
    """(h xor seed) modulo `buckets`, both read as unsigned."""
    y = h.bitwiseXOR(F.lit(signed(seed)) if isinstance(seed, int) else seed)
    half = F.pmod(F.shiftrightunsigned(y, 1), F.lit(buckets))
    return F.pmod(half * 2 + y.bitwiseAND(F.lit(1)), F.lit(buckets)).cast("int")


def split_of(b: Column) -> Column:
    return F.when(b < 800, "train").when(b < 900, "validation").when(b.isNotNull(), "test")


@F.arrow_udf(T.LongType())
def fnv1a_fast(text: pa.Array) -> pa.Array:
    """The hash of `fnv1a`, computed byte position by byte position over all rows of a batch."""
    whole = text.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if len(whole) and whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    start, lengths = offsets[:-1][order], lengths[order]
    h = np.full(len(order), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
    for p, k in enumerate(active.tolist()):
        h[:k] = (h[:k] ^ data[start[:k] + p]) * prime
    out = np.empty_like(h)
    out[order] = h
    return pa.array(out.view(np.int64), mask=np.asarray(whole.is_null()))
