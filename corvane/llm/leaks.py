"""Problem 7: evaluation passages inside a training corpus.

Latent semantic retrieval of short passages, then checks on the words themselves:

1. Passages are windows of WINDOW words, every STEP words in documents and at every word
   in evaluation items. WINDOW + STEP - 1 <= RUN, so a run of RUN shared words always
   holds a whole document passage that equals an item passage: their cosine is 1 in any
   latent space, and the candidate search can't miss it.
2. Document frequencies of the items' words are counted over all documents. The latent
   space is a randomised SVD of the TF-IDF passages; the sums over passages are computed
   where the rows are and added up by Spark. Words no item has count as one more,
   orthogonal, dimension. A few random directions keep passages of rare words apart.
3. Item passages are grouped around centroids. A document passage is compared only with
   groups whose centroid is near enough by the triangle inequality, which loses nothing.
4. Pairs with a cosine of at least `cosine` are checked: the longest run of equal words,
   and for the others the longest common subsequence of the text around the passages with
   the item and with its answer (the item's last sentence).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import bounded_sample, cut, spread, words

RUN = 12
WINDOW = 9
STEP = 4
#: Cosine of passages that can be equal, and of those that may differ in up to two of their words.
COSINE, PARAPHRASE_COSINE = 0.97, (WINDOW - 2) / WINDOW - 0.03
#: Latent dimensions, extra columns of the range finder, random directions, power iterations.
RANK, OVER, RANDOM, POWER = 64, 8, 8, 1
#: Documents the latent space is fitted on; every document is searched.
FIT_DOCS = 4000
CENTROIDS = 512
#: Items searched at a time; more are searched in blocks, so what is broadcast is bounded.
ITEM_BLOCK = 5000
#: Item words of a passage in the same order that make an unequal passage a paraphrase, and the share of its answer.
PARAPHRASE, ANSWER = 0.6, 0.8
ROWS = 60_000


class Items:
    """The words of a block of items as numbers, and their passages."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, texts = [i for i, _ in rows], [words(t) for _, t in rows]
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t], np.int32) for t in texts]
        self.words = coded
        # answer: the words of the last sentence
        self.answers = [c[len(c) - max(1, len(words(t.rstrip(".!?…。！？").rpartition(". ")[2]))) :] for c, (_, t) in zip(coded, rows)]
        gap = np.full(RUN, -2, np.int32)
        self.flat = np.concatenate([x for c in coded for x in (gap, c)] + [gap]) if coded else gap
        owner, at, p = [], [], RUN
        for k, c in enumerate(coded):
            starts = np.arange(max(0, len(c) - WINDOW + 1))
            owner.append(np.full(len(starts), k))
            at.append(starts + p)
            p += len(c) + RUN
        self.owner = np.concatenate(owner) if owner else np.zeros(0, int)
        self.at = np.concatenate(at) if at else np.zeros(0, int)


def _starts(n: int) -> np.ndarray:
    """Passage starts of a document of n words; the last passage reaches its end."""
    if n < WINDOW:
        return np.zeros(0, np.int64)
    s = np.arange(0, n - WINDOW + 1, STEP)
    return s if s[-1] == n - WINDOW else np.append(s, n - WINDOW)


def _encoded(df: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(id, words): the documents' words as numbers of the items' words, -1 for all others; written once."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            coded = [np.array([get(w, -1) for w in words(t)], "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(coded, pa.binary())], ["id", "words"])

    return cut(df.mapInArrow(run, "id bigint, words binary"))


def _document_frequency(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each item word, and all documents; counted in the tasks, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            for data in batch.column("words").to_pylist():
                counts[np.unique(np.frombuffer(data, "<i4"))] += 1
                counts[size] += 1
        counts[-1] = 0  # foreign words
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["word", "df"])

    out = np.zeros(size + 1, np.int64)
    for r in coded.mapInArrow(run, "word int, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect():
        out[r["word"]] = r["df"]
    return out[:-1], int(out[-1])


def _gram(coded: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'A omega for the TF-IDF passages A of the documents, one partial sum per task and word."""
    given = coded.sparkSession.sparkContext.broadcast((idf, omega))
    width = omega.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, om = given.value
        total = np.zeros(om.shape)
        for batch in batches:
            for data in batch.column("words").to_pylist():
                ids = np.frombuffer(data, "<i4").astype(np.int64)
                s = _starts(len(ids))
                if not len(s):
                    continue
                win = ids[s[:, None] + np.arange(WINDOW)]
                weight = np.where(win >= 0, w[win], 0.0)
                y = (weight[:, :, None] * om[win]).sum(1)
                np.add.at(total, win[win >= 0], (weight[:, :, None] * y[:, None, :])[win >= 0])
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k], pa.float64()) for k in range(width))], ["word", *(f"c{k}" for k in range(width))])

    schema = "word int, " + ", ".join(f"c{k} double" for k in range(width))
    out = np.zeros(omega.shape)
    for r in coded.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)]).collect():
        out[r["word"]] = r[1:]
    return out


def latent_space(df: DataFrame, items: Items, df_counts: np.ndarray, n_docs: int, fit_docs: int = FIT_DOCS, seed: int = 1) -> np.ndarray:
    """The vector of each item word: randomised SVD with power iterations, fitted on at most `fit_docs` documents and all items."""
    rng = np.random.default_rng(seed)
    idf = np.log((1 + n_docs) / (1 + df_counts)) + 1
    size = len(items.vocabulary)
    sample = bounded_sample(df, "id", fit_docs, n_docs).repartition(max(2, df.sparkSession.sparkContext.defaultParallelism // 2))
    own = np.zeros((size, min(RANK + OVER, max(size, 1))))
    omega = rng.standard_normal(own.shape)
    for _ in range(1 + POWER):
        own = _gram(sample, idf, omega)
        # the items' own passages belong to the matrix as well
        if len(items.at):
            win = items.flat[items.at[:, None] + np.arange(WINDOW)]
            y = (idf[win][:, :, None] * omega[win]).sum(1)
            np.add.at(own, win.ravel(), (idf[win][:, :, None] * y[:, None, :]).reshape(-1, own.shape[1]))
        omega, _ = np.linalg.qr(own)
    basis = omega[:, :RANK]
    # vectors of the words: idf-weighted rows of the right singular basis, and a few random directions
    vectors = np.concatenate((basis * idf[:, None], 0.25 * rng.standard_normal((size, RANDOM)) * idf[:, None] / np.sqrt(max(size, 1))), 1)
    return vectors.astype(np.float32)


class Search:
    """Item passages around centroids, and the exact-bound search among them."""

    def __init__(self, items: Items, vectors: np.ndarray, unknown: float, cosine: float, seed: int = 1):
        self.items, self.vectors, self.cosine = items, vectors, cosine
        # a word no item has is a dimension of its own, of this weight
        self.unknown = unknown
        self.lookup = np.concatenate((vectors, np.zeros((1, vectors.shape[1]), np.float32)))  # -1 is the last row
        self.longest = float(np.linalg.norm(vectors, axis=1).max()) if len(vectors) else 0.0
        rows = items.flat[items.at[:, None] + np.arange(WINDOW)] if len(items.at) else np.zeros((0, WINDOW), np.int32)
        # equal passages (in any item) are searched once
        self.passages, inverse = np.unique(np.sort(rows, 1), axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.places = order
        self.place_ends = np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.passages)))
        q = vectors[self.passages].sum(1) if len(self.passages) else np.zeros((0, vectors.shape[1]), np.float32)
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-30
        rng = np.random.default_rng(seed)
        k = min(CENTROIDS, len(q))
        c = q[rng.choice(len(q), k, replace=False)] if k else q
        for _ in range(6):
            near = (q @ c.T).argmax(1) if k else np.zeros(0, int)
            for j in range(k):
                if (near == j).any():
                    c[j] = q[near == j].sum(0)
            c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-30
        near = (q @ c.T).argmax(1) if k else np.zeros(0, int)
        self.groups, self.centroids, limits = [], c, []
        theta = np.arccos(cosine)
        for j in range(k):
            members = np.flatnonzero(near == j)
            self.groups.append((members, np.ascontiguousarray(q[members].T)))
            radius = np.arccos(np.clip((q[members] @ c[j]).min(), -1, 1)) if len(members) else 0.0
            limits.append(np.cos(min(np.pi, radius + theta + 1e-3)) if len(members) else 2.0)
        self.limits = np.array(limits, np.float32)

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, passage, cosine) with a cosine of at least the threshold. windows: word numbers, -1 for foreign words."""
        foreign = (windows < 0).sum(1)
        # with f foreign words the cosine is at most that of the longest passage vector there can be
        reach = WINDOW * self.longest
        keep = np.flatnonzero(reach >= self.cosine * np.sqrt(reach**2 + foreign * self.unknown**2) * (1 - 1e-6))
        windows, foreign = windows[keep], foreign[keep]
        v = self.lookup[windows[:, 0]]
        for k in range(1, WINDOW):
            v += self.lookup[windows[:, k]]
        norm = np.sqrt((v * v).sum(1) + foreign * self.unknown**2)
        v /= norm[:, None] + 1e-30
        # on the unit sphere of all dimensions the angle to a centroid is that of the lifted vector
        close = v @ self.centroids.T >= self.limits - 1e-5
        out = []
        for j in np.flatnonzero(close.any(0)):
            rows = np.flatnonzero(close[:, j])
            members, q = self.groups[j]
            score = v[rows] @ q
            a, b = np.nonzero(score >= self.cosine - 1e-5)
            if len(a):
                out.append((keep[rows[a]], members[b], score[a, b]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*out))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for x in b.tolist():
        u = s & masks.get(x, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


HIT = "item_id bigint, doc_id bigint, run int, passages int, cosine double, shared double, answer double"


def _search(given, paraphrases: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = given.value
        items = search.items

        def flush(docs):
            gap = np.full(RUN, -3, np.int32)
            flat = np.concatenate([x for _, w in docs for x in (gap, w)] + [gap])
            starts, doc, p, bounds = [], [], RUN, []
            for k, (_, w) in enumerate(docs):
                s = _starts(len(w))
                starts.append(s + p)
                bounds.append((p, p + len(w)))
                doc.append(np.full(len(s), k))
                p += len(w) + RUN
            starts, doc = np.concatenate(starts), np.concatenate(doc)
            if not len(starts):
                return None
            window, passage, cosine = search.hits(flat[starts[:, None] + np.arange(WINDOW)])
            if not len(window):
                return None
            # each passage hit stands for its places in all items
            ends = search.place_ends[passage]
            counts = ends - np.where(passage > 0, search.place_ends[passage - 1], 0)
            rep = np.repeat(np.arange(len(window)), counts)
            k = np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = search.places[(ends - counts)[rep] + k]
            d, i = starts[window[rep]], items.at[place]
            # longest run of equal words through the passage
            same = np.ones(len(d), bool)
            for o in range(WINDOW):
                same &= flat[d + o] == items.flat[i + o]
            length = np.where(same, WINDOW, 0)
            left = same.copy()
            for o in range(1, RUN - WINDOW + 1):
                left &= flat[d - o] == items.flat[i - o]
                length += left
            right = same.copy()
            for o in range(RUN - WINDOW):
                right &= flat[d + WINDOW + o] == items.flat[i + WINDOW + o]
                length += right
            pair = doc[window[rep]].astype(np.int64) * len(items.ids) + items.owner[place]
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1])))
            best = np.maximum.reduceat(length[order], first)
            seen = np.diff(np.append(first, len(order)))
            top = np.maximum.reduceat(cosine[rep][order], first)
            low, high = np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first) + WINDOW
            who = pair[order][first]
            take = best >= RUN
            shared = np.full(len(who), np.nan)
            answer = np.full(len(who), np.nan)
            if paraphrases:
                for j in np.flatnonzero(take | (seen > 1)):
                    it, (begin, end) = items.words[who[j] % len(items.ids)], bounds[who[j] // len(items.ids)]
                    dw = flat[max(begin, low[j] - len(it)) : min(end, high[j] + len(it))]
                    shared[j] = common_subsequence(it, dw) / len(it)
                    a = items.answers[who[j] % len(items.ids)]
                    answer[j] = common_subsequence(a, dw) / len(a)
                take = take | ((shared >= PARAPHRASE) & (answer >= ANSWER))
            j = np.flatnonzero(take)
            if not len(j):
                return None
            ids = np.array(items.ids, np.int64)[who[j] % len(items.ids)]
            at = np.array([docs[x][0] for x in (who[j] // len(items.ids)).tolist()], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(at), pa.array(best[j].astype(np.int32)), pa.array(seen[j].astype(np.int32)), pa.array(top[j].astype(np.float64)), pa.array(shared[j]), pa.array(answer[j])],
                ["item_id", "doc_id", "run", "passages", "cosine", "shared", "answer"],
            )

        held, size = [], 0
        for batch in batches:
            for id_, data in zip(batch.column("id").to_pylist(), batch.column("words").to_pylist()):
                w = np.frombuffer(data, "<i4")
                if len(w) >= WINDOW:
                    held.append((id_, w))
                    size += len(w) // STEP
                if size >= ROWS:
                    out = flush(held)
                    held, size = [], 0
                    if out is not None:
                        yield out
        if held:
            out = flush(held)
            if out is not None:
                yield out

    return run


def leaks(documents: DataFrame, items: DataFrame, cosine: float | None = None, paraphrases: bool = True, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per item and document with a leak: (item_id, doc_id, run, passages, cosine, shared, answer).

    run is the longest run of shared words, counted up to RUN; a row has run = RUN, or
    its text shares PARAPHRASE of the item's words in order and ANSWER of its answer's,
    around two passages at least that differ from the item's in up to two words of nine.
    Null and empty texts hold nothing; texts of fewer than WINDOW words have no passage.
    """
    cosine = (PARAPHRASE_COSINE if paraphrases else COSINE) if cosine is None else cosine
    src = spread(documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null and text <> ''"))
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    count = rows.count()
    blocks = -(-count // ITEM_BLOCK)
    parts = []
    ctx = documents.sparkSession.sparkContext
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        block = Items([(r["item_id"], r["text"]) for r in own])
        if not len(block.at):
            continue
        coded = _encoded(src, block.vocabulary)
        frequency, n = _document_frequency(coded, len(block.vocabulary))
        vectors = latent_space(coded, block, frequency, n, fit_docs)
        # a word no item has: for equal passages as heavy as the rarest word there can be, which leaves out
        # most passages unseen; for paraphrases as heavy as a word of the items is in the latent space
        foreign = float(np.linalg.norm(vectors, axis=1).mean()) if paraphrases else float(np.log(1 + n) + 1)
        search = Search(block, vectors, foreign, cosine)
        parts.append(coded.mapInArrow(_search(ctx.broadcast(search), paraphrases), HIT))
    if not parts:
        return documents.sparkSession.createDataFrame([], HIT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items, paraphrases=False).where(F.col("run") >= RUN).select("item_id", "doc_id").distinct()
