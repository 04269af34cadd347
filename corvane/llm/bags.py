"""Bags of words: the shared ground of the two problems that compare texts word by word.

A token is a word together with its count so far in the text, so that sets of tokens
intersect as multisets of words do. Texts with the same bag form one class; classes, not
rows, are compared, and rows are attached to them as pieces of identifiers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import cut, spread, words

MIN_WORDS = 12
ID_PIECE = 1000
HOLD = 20_000
#: Bound of the token dictionary that is gathered and broadcast. With N texts of L words,
#: a token outside it occurs in at most N * L / DICTIONARY of them.
DICTIONARY = 60_000


def needed(n: int, m: int) -> int:
    """Shared words that make texts of n and m words near-copies: four fifths of the longer."""
    return -(-4 * max(n, m) // 5)


def tokens(sorted_words: list[str]) -> list[str]:
    """Words in sorted order to tokens: the k-th repeat of a word carries k."""
    out, last, k = [], None, 0
    for w in sorted_words:
        if w == last:
            k += 1
            out.append(f"{w}\x00{k}")
        else:
            last, k = w, 0
            out.append(w)
    return out


ENTRY = "digest binary, bag string, n int, side int, ids array<bigint>"
#: The side of rows that hold a token and in how many of a task's bags it is.
COUNTS = -1
#: Tokens a task counts before it passes the counts on.
COUNTED = 500_000


def _entries(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        counts: Counter = Counter()

        def emit(last: bool):
            cols: list[list] = [[], [], [], [], []]
            for (bag, side), (n, ids) in held.items():
                parts = tokens(bag.split(" "))
                counts.update(parts)
                digest, coded = xxhash.xxh3_128_digest(bag), " ".join(parts)
                for k in range(0, len(ids), ID_PIECE):
                    for c, v in zip(cols, (digest, coded, n, side, ids[k : k + ID_PIECE])):
                        c.append(v)
            held.clear()
            if last or len(counts) > COUNTED:
                for c, v in zip(cols, ([None] * len(counts), counts, counts.values(), [COUNTS] * len(counts), [None] * len(counts))):
                    c.extend(v)
                counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["digest", "bag", "n", "side", "ids"])

        rows = 0
        for batch in batches:
            for id_, text, side in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = words(text)
                if len(found) >= min_words:
                    found.sort()
                    held.setdefault((" ".join(found), side), (len(found), []))[1].append(id_)
                    rows += 1
                    if len(held) >= HOLD or rows >= 50 * HOLD:
                        yield emit(False)
                        rows = 0
        if held or counts:
            yield emit(True)

    return run


def entries(df: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of (id, text, side) rows: (digest, bag, n, side, ids) and (token, df), both from one written table.

    A bag is its tokens joined by spaces. Equal bags of a task share rows of up to
    ID_PIECE identifiers. The counts are partial, one per token and task.
    """
    table = cut(spread(df.where("id is not null and text is not null")).mapInArrow(_entries(min_words), ENTRY))
    return table.where(F.col("side") != COUNTS), table.where(F.col("side") == COUNTS).select(F.col("bag").alias("token"), F.col("n").alias("df"))


def dictionary(counts: DataFrame, size: int = DICTIONARY) -> list[tuple[str, int]]:
    """The `size` tokens of most texts with their counts, rarest first; ties by token."""
    found = counts.groupBy("token").agg(F.sum("df").alias("df")).where("df > 1").orderBy(F.desc("df"), "token").limit(size).collect()
    return [(r["token"], r["df"]) for r in reversed(found)]


def rare_code(token: str) -> int:
    """Tokens outside the dictionary: a hash with the top bit set."""
    return xxhash.xxh3_64_intdigest(token) | 1 << 63


#: Words of the sketch of a short text, and of the longest ones.
SKETCH_WORDS, MOST_WORDS = 4, 64


def sketch_words(n: int) -> int:
    """Words of 64 bits in the sketch of n tokens: a power of two that leaves most bits to single tokens."""
    w = SKETCH_WORDS
    while w < MOST_WORDS and 128 * w < 3 * n:
        w *= 2
    return w


def sketch_bits(codes: np.ndarray, width: int) -> np.ndarray:
    """The bit of each token in a sketch of `width` words."""
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(64 * width - 1)


def sketches(codes: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Parity sketches of consecutive sets: two of them differ in at most as many bits as the sets differ
    in tokens. The exclusive or of a sketch's halves is the sketch of half its width."""
    h = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    width = np.array([sketch_words(n) for n in lengths.tolist()], np.int64)
    ends = np.cumsum(lengths)
    out: list[bytes] = []
    start = 0
    while start < len(lengths):
        w, stop, limit = int(width[start]), start + 1, max(1, 1 << 14 >> int(width[start]).bit_length())
        while stop < len(lengths) and stop - start < limit and width[stop] == w:
            stop += 1
        part = slice(int(ends[start] - lengths[start]), int(ends[stop - 1]))
        row = np.repeat(np.arange(stop - start), lengths[start:stop])
        at = (h[part] & np.uint64(64 * w - 1)).astype(np.int64) + row * (64 * w)
        bits = np.packbits((np.bincount(at, minlength=(stop - start) * 64 * w) & 1).astype(np.uint8), bitorder="little").tobytes()
        out += [bits[k * 8 * w : (k + 1) * 8 * w] for k in range(stop - start)]
        start = stop
    return out


def sketch(codes: np.ndarray) -> bytes:
    return sketches(codes, np.array([len(codes)]))[0]


class Sketches:
    """Sketches of several texts, folded to any number of words that both sides of a comparison have."""

    def __init__(self, cells: list[bytes]):
        self.width = np.array([len(c) // 8 for c in cells], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(cells), np.uint64)
        self.widths = np.unique(self.width).tolist()
        self.made: dict[int, np.ndarray] = {}

    def words(self, w: int) -> np.ndarray:
        """One row of w words for each text; zero for sketches narrower than that."""
        if w not in self.made:
            out = np.zeros((len(self.width), w), np.uint64)
            for width in self.widths:
                if width >= w:
                    rows = np.flatnonzero(self.width == width)
                    for k in range(width):
                        out[rows, k % w] ^= self.flat[self.start[rows] + k]
            self.made[w] = out
        return self.made[w]

    def away(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of pairs, at the width of the narrower side."""
        if len(self.widths) == 1:
            return np.bitwise_count(self.words(self.widths[0])[i] ^ self.words(self.widths[0])[j]).sum(1, dtype=np.int32)
        out = np.zeros(len(i), np.int32)
        width = np.minimum(self.width[i], self.width[j])
        for w in self.widths:
            at = np.flatnonzero(width == w)
            if len(at):
                out[at] = np.bitwise_count(self.words(w)[i[at]] ^ self.words(w)[j[at]]).sum(1, dtype=np.int32)
        return out


def encode(bag_list: list[str], code: dict[str, int], rare) -> tuple[list[np.ndarray], list[bytes]]:
    """(sorted codes, sketch) of each bag; `rare` codes the tokens that `code` lacks."""
    parts = [b.split(" ") for b in bag_list]
    lengths = np.array([len(p) for p in parts], np.int64)
    get = code.get
    flat = np.array([c if (c := get(t)) is not None else rare(t) for p in parts for t in p], np.uint64)
    found = np.split(flat, np.cumsum(lengths)[:-1]) if parts else []
    for a in found:
        a.sort()
    return found, sketches(flat, lengths)


def pack(codes: np.ndarray) -> bytes:
    """Sorted codes: those of the dictionary as 16-bit, the others as 64-bit numbers."""
    n = int(np.searchsorted(codes, np.uint64(1 << 16)))
    return n.to_bytes(4, "little") + codes[:n].astype("<u2").tobytes() + codes[n:].astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.concatenate([np.frombuffer(data, "<u2", n, 4).astype(np.uint64), np.frombuffer(data, "<u8", -1, 4 + 2 * n)])
