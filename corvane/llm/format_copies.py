"""Problem 6: records that are identical but for formatting.

A record's canonical bytes are the letters and digits of its NFKC form without case.
A text made of labelled parts has a second key: its parts (label and content)
in sorted order. Records are copies if either key agrees, also over others.

1. Each task canonicalises its rows and keeps one entry per distinct pair of keys with the
   identifiers of its copies (in pieces of at most ID_PIECE), so a key held by a third
   of all rows is shuffled as few entries.
2. Recursive radix partitioning: entries are counted by their first bytes; a bucket
   over the size limit is split by further bytes after the prefix all its keys share,
   until each fits or holds one single key.
3. Each bucket's entries go into a burst trie whose terminals count the copies.
4. Second keys are counted the same way and tell which classes belong together; the
   connected components over both keys are the records.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import WORD, cut, spread
from corvane.llm.components import components

ID_PIECE = 1000
#: A bucket's limit in bytes: what one trie holds.
BUCKET_BYTES = 32 << 20
#: Prefixes of oversized buckets up to this many are broadcast; more are joined by shuffle.
MAX_LARGE = 20_000
MIN_WORDS = 12
#: Distinct keys a task holds before it passes them on.
HOLD = 20_000

# Labels that open a part even where only a space stands before them.
LABELS = (
    "advice", "bad", "con", "cons", "disliked", "good", "liked", "pro", "pros", "rating", "setup", "summary", "support", "use case", "verdict",
)

_NAME = r"[^\W\d_]+(?:\s+[^\W\d_]+){0,2}?"
_MARK = r"\s*(?:[:=→>]|->|[-–—](?=\s))\s*"
_OPEN = re.compile(rf"^\W*({_NAME}){_MARK}")
_PART = re.compile(rf"(?:^\W*|[|;.\n!?…•/,]\W*)({_NAME}){_MARK}|\b((?:{'|'.join(x.replace(' ', r'\s+') for x in LABELS)})){_MARK}", re.I)


def plain_key(folded: str) -> str:
    return "".join(WORD.findall(folded))


def parts_key(folded: str) -> str | None:
    """The sorted labelled parts, or None if the text does not open with a label or has one part only."""
    if not _OPEN.match(folded):
        return None
    marks = [(m.start(1) if m[1] else m.start(2), m.end(), m[1] or m[2]) for m in _PART.finditer(folded)]
    if len(marks) < 2:
        return None
    ends = [m[0] for m in marks[1:]] + [len(folded)]
    return "\x01".join(sorted(f"{plain_key(label)}\x02{plain_key(folded[a:b])}" for (_, a, label), b in zip(marks, ends)))


def keys(text: str) -> tuple[str, str | None, int]:
    """(plain key, parts key or None, number of words)."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    found = WORD.findall(text)
    return "".join(found), parts_key(text), len(found)


ENTRY = "key binary, digest binary, parts binary, ids array<bigint>"


def _entries(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def emit():
            cols: list[list] = [[], [], [], []]
            for (key, parts), ids in held.items():
                data = key.encode("utf-8", "surrogatepass")
                for k in range(0, len(ids), ID_PIECE):
                    for c, v in zip(cols, (data, xxhash.xxh3_128_digest(data), parts and parts.encode("utf-8", "surrogatepass"), ids[k : k + ID_PIECE])):
                        c.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["key", "digest", "parts", "ids"])

        n = 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, parts, count = keys(text)
                if count >= min_words:
                    held.setdefault((key, parts), []).append(id_)
                    n += 1
                    if len(held) >= HOLD or n >= 50 * HOLD:
                        yield emit()
                        n = 0
        if held:
            yield emit()

    return run


class BurstTrie:
    """Byte trie whose leaves are small suffix tables that burst into nodes when full."""

    BURST = 64

    def __init__(self):
        self.root: dict = {}

    def add(self, key: bytes, id_: int, n: int) -> None:
        node, at = self.root, 0
        while True:
            if None in node:  # an inner node: None holds the table of keys that end here
                if at == len(key):
                    node = node[None]
                    break
                node = node.setdefault(key[at], {})
                at += 1
            elif len(node) < self.BURST or key[at:] in node:
                break
            else:
                table = dict(node)
                node.clear()
                node[None] = {}
                for rest, counter in table.items():
                    (node.setdefault(rest[0], {}) if rest else node[None])[rest[1:]] = counter
        rest = key[at:]
        counter = node.get(rest)
        if counter is None:
            node[rest] = [id_, n]
        else:
            counter[0] = min(counter[0], id_)
            counter[1] += n

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if None in node:
                for byte, child in node.items():
                    stack.append((prefix, child) if byte is None else (prefix + bytes([byte]), child))
            else:
                for rest, (id_, n) in node.items():
                    yield prefix + rest, id_, n


def _count(kind: pa.DataType):
    """Rows (bucket, key, id, n), sorted by bucket, with identifiers of `kind`; one trie at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = BurstTrie(), None

        def emit():
            rows = [(xxhash.xxh3_128_digest(k), i, n) for k, i, n in trie.terminals()]
            c = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], kind), pa.array(c[2], pa.int64())], ["digest", "first_id", "copies"])

        for batch in batches:
            for bucket, key, id_, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now:
                    if now is not None:
                        yield emit()
                    trie, now = BurstTrie(), bucket
                trie.add(key, id_, n)
        if now is not None:
            yield emit()

    return run


def _bucketed(entries: DataFrame, levels: list[tuple[DataFrame, int]], first: int) -> DataFrame:
    """Entries with their bucket: the first bytes of the key, lengthened as long as the prefix is oversized."""
    out = entries.withColumn("bucket", F.expr(f"substring(key, 1, {first})"))
    for level, size in levels:
        out = out.join(F.broadcast(level) if size <= MAX_LARGE else level, "bucket", "left")
        out = out.withColumn("bucket", F.coalesce(F.expr("substring(key, 1, length)"), "bucket")).drop("length")
    return out


def _shared(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [_common(a, b) + first for a, b in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(lengths, pa.int32())], ["bucket", "length"])

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def split_levels(entries: DataFrame, limit: int = BUCKET_BYTES, first: int = 2) -> list[tuple[DataFrame, int]]:
    """For each level, the table (bucket, length) of oversized prefixes and the length their keys are split at, and its rows."""
    levels: list[tuple[DataFrame, int]] = []
    while True:
        sizes = _bucketed(entries, levels, first).groupBy("bucket").agg(F.sum(F.length("key")).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        # a bucket of one key is not split: its trie has one terminal
        level = cut(sizes.where((F.col("bytes") > limit) & (F.col("low") != F.col("high"))).select("bucket", "low", "high").mapInArrow(_shared(first), "bucket binary, length int"))
        size = level.count()
        if not size:
            return levels
        levels.append((level, size))


def count_keys(entries: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """(digest, first_id, copies) of each distinct key; entries: (key, id, n), id a bigint or binary."""
    kind = entries.schema["id"].dataType.simpleString()
    rows = _bucketed(entries.select("key", "id", "n"), split_levels(entries, limit), 2).select("bucket", "key", "id", "n")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(pa.int64() if kind == "bigint" else pa.binary()), f"digest binary, first_id {kind}, copies bigint")


def copy_classes(df: DataFrame, id_col: str = "review_id", text_col: str = "review_text", min_words: int = MIN_WORDS, limit: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(entries, classes): entries (digest, ids), classes (digest, first_id, copies) by plain key.

    Classes of one record have its smallest identifier and the sum of its copies. Texts of
    fewer than `min_words` words, null and empty ones belong to no class. Identifiers
    repeated in the table count as separate rows. Other columns are not read. The order
    and partitioning of the rows do not matter.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    entries = cut(spread(src).mapInArrow(_entries(min_words), ENTRY))
    counted = count_keys(entries.select("key", F.array_min("ids").alias("id"), F.size("ids").cast("bigint").alias("n")), limit)
    labelled = entries.where("parts is not null").select("digest", "parts").distinct()
    if not entries.where("parts is not null").take(1):
        return entries, counted
    counted = cut(counted)

    @F.arrow_udf("binary")
    def digest_of(key: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(k) for k in key.to_pylist()], pa.binary())

    labelled = cut(labelled.withColumn("second", digest_of("parts")))
    hubs = count_keys(labelled.select(F.col("parts").alias("key"), F.col("digest").alias("id"), F.lit(1).cast("bigint").alias("n")), limit)
    hubs = hubs.where("copies > 1").select(F.col("digest").alias("second"), F.col("first_id").alias("hub"))
    joined = cut(labelled.join(hubs, "second").where("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")))
    roots = components(joined).withColumnsRenamed({"node": "digest"})
    part = counted.join(roots, "digest")
    whole = part.groupBy("root").agg(F.min("first_id").alias("first2"), F.sum("copies").alias("copies2"))
    second = part.select("digest", "root").join(whole, "root").select("digest", "first2", "copies2")
    return entries, counted.join(second, "digest", "left").select("digest", F.coalesce("first2", "first_id").alias("first_id"), F.coalesce("copies2", "copies").alias("copies"))


def records(df: DataFrame, **options) -> DataFrame:
    """(first_review_id, copies): one row for each distinct record."""
    _, classes = copy_classes(df, **options)
    return classes.select(F.col("first_id").alias("first_review_id"), "copies").distinct()


def copies(df: DataFrame, **options) -> DataFrame:
    """(first_review_id, review_id): each copy that is not the smallest identifier of its class."""
    entries, classes = copy_classes(df, **options)
    many = classes.where("copies > 1").select("digest", "first_id")
    rows = entries.select("digest", "ids").join(many, "digest").select(F.col("first_id").alias("first_review_id"), F.explode("ids").alias("review_id"))
    return rows.where("review_id <> first_review_id")
