"""Cross-split overlap, near-duplicate groups and formatting copies against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from corvane.functions.hashing import SPLIT_SEED, signed, split_py
from corvane.llm import bags, edit_groups, format_copies, split_overlap
from corvane.llm.common import words
from corvane.llm.components import components
from corvane.llm.fm_index import FMIndex

WORDS = [f"w{k}" for k in range(60)]


def texts(n=140, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(w))
                w[k] = rng.choice(WORDS)
            if rng.random() < 0.3:
                rng.shuffle(w)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 40))))
    return out


def linked(a: str, b: str) -> bool:
    x, y = bags.tokens(sorted(words(a))), bags.tokens(sorted(words(b)))
    return min(len(x), len(y)) >= 12 and 5 * len(set(x) & set(y)) >= 4 * max(len(x), len(y))


def brute_groups(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and linked(a, b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {(root(i), i) for i, _ in rows if root(i) != i}


ODD = [(900, None), (901, ""), (902, "  "), (903, "long " * 40_000), (904, "long " * 40_000), (905, "a b c")]


def test_groups(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    rows += [(300, rows[0][1]), (301, rows[0][1].upper() + "!!")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + ODD], "review_id bigint, review_text string, id int, digest string")
    got = {tuple(r) for r in edit_groups.groups(df).collect()}
    assert got == brute_groups(rows) | {(903, 904)}
    assert edit_groups.groups(df.limit(0)).count() == 0


def test_groups_with_blocks_and_blobs(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(40), 3):
            w[k] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "review_id bigint, review_text string")
    want = brute_groups(rows)
    assert {tuple(r) for r in edit_groups.groups(df).collect()} == want
    table, size = edit_groups.classes(*bags.entries(df.selectExpr("review_id as id", "review_text as text", "0 as side")))
    found = components(edit_groups.connecting_links(table, size, block=40))
    assert {(r["root"], r["node"]) for r in found.collect() if r["root"] != r["node"]} == want


def test_sketches():
    rng = np.random.default_rng(3)
    for n in (12, 95, 171, 500, 4000):
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        b = np.concatenate((a[: n * 4 // 5], rng.choice(1 << 40, n // 5, replace=False).astype(np.uint64)))
        s = bags.Sketches([bags.sketch(a), bags.sketch(b), bags.sketch(a[:12])])
        assert (s.away(np.array([0, 0]), np.array([1, 2])) <= [2 * n // 5 + 2, n - 12]).all()
        w = 1
        while w <= s.width[:2].min():
            assert int(np.bitwise_count(s.words(w)[0] ^ s.words(w)[1]).sum()) <= 2 * n // 5 + 2
            w *= 2


def test_pieces_name_every_linked_pair():
    """Tokens of few and of many classes, texts of all widths of sketches and openings beyond PLACES."""
    rng = np.random.default_rng(8)
    for size, lengths, vocabulary in ((700, (12, 40), 150), (900, (80, 130), 600), (120, (380, 460), 3000)):
        sets: list[np.ndarray] = []
        for k in range(size):
            if sets and k % 3 == 0:
                a = sets[int(rng.integers(len(sets)))]
                keep = rng.permutation(a)[: len(a) - int(rng.integers(0, len(a) // 5 + 2))]
                a = np.union1d(keep, rng.integers(0, vocabulary, int(rng.integers(0, len(a) // 8 + 1))))
            else:
                # rare ones first: the density rises with the code
                a = np.unique((vocabulary * np.sqrt(rng.random(int(rng.integers(*lengths))))).astype(np.int64))
            sets.append(a[:].astype(np.uint64))
        n = np.array([len(a) for a in sets], np.int32)
        ids = np.arange(size, dtype=np.int64) * 7
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array([bags.pack(a) for a in sets]), pa.array(bags.sketches(np.concatenate(sets), n)), pa.array(ids)], ["id", "n", "codes", "sketch", "root"])
        of = np.arange(vocabulary) * 3 // vocabulary
        sent = pa.Table.from_batches(list(edit_groups._segments(SimpleNamespace(value=(of, 3, {vocabulary - 5: 2, vocabulary - 9: 3}, 0)))(iter([batch]))))
        named = [edit_groups._compare(0)(iter(sent.sort_by("piece").to_batches()))]
        got = {(x, y) for out in named for b in out for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
        want = {(7 * i, 7 * j) for i in range(size) for j in range(i + 1, size) if n[i] >= 1 and 5 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 4 * max(n[i], n[j])}
        assert len(want) > 20 and want <= got
        # what stands before the first shared token is taken out of both sketches
        rests = edit_groups.Rests(bags.Sketches(sent.column("sketch").to_pylist()).words(1)[:, 0], sent.column("before").to_pylist())
        row = int(np.argmax(n))
        first = int(np.flatnonzero(np.array(sent.column("id").to_pylist()) == ids[row])[0])
        place = np.frombuffer(sent.column("places")[first].as_py(), "<u2")[:1].astype(np.int64)
        rest, gone = rests.after(np.array([first]), place)
        kept = sets[row][int(gone[0]) :]
        assert gone[0] == min(place[0], edit_groups.PLACES) or gone[0] == rests.ahead[first]
        assert int(rest[0]) == int(np.bitwise_xor.reduce(np.uint64(1) << bags.sketch_bits(kept, 1)))


def test_layout_bounds_bytes_of_rare_tokens():
    """Rare tokens ask for little work, but a fragment must not hold all of them."""
    order = edit_groups.Order([(f"t{k}", 60 if k < 58_000 else 200_000) for k in range(58_100)])
    rng = np.random.default_rng(4)
    openings = [np.concatenate((np.sort(rng.integers(0, 58_000, 14)), 58_000 + np.sort(rng.permutation(100)[:18]))).astype(np.uint64) for _ in range(2000)]
    of, fragments, _, _ = edit_groups.layout(openings, 250_000, order, 12)
    held = np.bincount(of[:58_000], weights=order.df[:58_000], minlength=fragments)
    assert held.max() * edit_groups.ROW_BYTES <= 1.5 * edit_groups.FRAGMENT_BYTES
    assert (np.diff(of) >= 0).all() and of[-1] < fragments


def test_partial_overlaps_add_up():
    rng = np.random.default_rng(5)
    order = edit_groups.Order([(f"t{k}", 1 + k // 9) for k in range(400)])
    for _ in range(50):
        x, y = (np.sort(np.concatenate((rng.choice(400, 40, replace=False).astype(np.uint64), rng.choice(9, 4, replace=False).astype(np.uint64) + np.uint64(1 << 63)))) for _ in range(2))
        parts = [order.segments(bags.pack(v)) for v in (x, y)]
        assert len(parts[0]) == edit_groups.PARTS
        low = edit_groups._twice([p[0] for p in parts[0]], [p[0] for p in parts[1]], "<u2")
        high = edit_groups._twice([p[1] for p in parts[0]], [p[1] for p in parts[1]], "<u8")
        assert low.sum() + high.sum() == len(np.intersect1d(x, y))


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[101] == 100


def test_overlap(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["train", "train", "validation", "test", None])) for k, t in enumerate(texts(150, 9))]
    odd = [(i, t, "train") for i, t in ODD[:5]] + [(950, "long " * 40_000, "test"), (951, "!!! ???", None)]
    seeds = {1: signed(SPLIT_SEED), 2: 5891737356886922993}
    data = [(i, t, s, "Store ", 1 + i % 2, 7) for i, t, s in rows + odd]
    df = spark.createDataFrame(data, "doc_id bigint, text string, split string, source string, manifest_id bigint, band int")
    manifests = spark.createDataFrame(list(seeds.items()), "manifest_id bigint, split_seed bigint")
    known = [(i, t, s or split_py(t, seeds[1 + i % 2])) for i, t, s in rows]
    want = {(min(i, j), max(i, j)) for i, a, s in known for j, b, z in known if s == "train" and z in ("validation", "test") and linked(a, b)}
    want |= {(903, 950)} | ({(904, 950)} if True else set())
    got = [tuple(r) for r in split_overlap.found(df, manifests).collect()]
    assert set(got) == want and len(got) == len(set(got))
    report = split_overlap.report(df, manifests).collect()
    assert sum(r["pairs"] for r in report) == len(want) and {r["source"] for r in report} == {"store"}
    assert split_overlap.found(df.limit(0), manifests).count() == 0


def test_index_blocks_are_neither_copied_nor_shuffled(spark):
    rng = random.Random(6)
    rows = [(k, t, rng.randrange(2)) for k, t in enumerate(texts(160, 11))]
    entry, counts = bags.entries(spark.createDataFrame(rows, "id bigint, text string, side int"))
    pairs = split_overlap.bag_pairs(entry, counts, 15)
    # neither train texts nor indexes stand in pairs of a block and its share of the train texts
    assert "CoGroup" not in pairs._jdf.queryExecution().toString()
    got = {(i, j) for r in pairs.join(entry.where("side = 0").selectExpr("digest as train", "ids as x"), "train").join(entry.where("side = 1").selectExpr("digest as eval", "ids as y"), "eval").collect() for i in r["x"] for j in r["y"]}
    assert got == {(i, j) for i, a, s in rows for j, b, z in rows if s == 0 and z == 1 and linked(a, b)}
    assert all(n > 1 for _, _, n in split_overlap.shard_plan({12: 31, 13: 4}, 15)[:1])


def test_fm_index():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(1, 6, rng.integers(0, 12)).astype(np.uint64) for _ in range(30)]
    index = FMIndex(seqs, depth=8)
    for _ in range(60):
        p = rng.integers(1, 7, rng.integers(1, 5)).astype(np.uint64)
        s = index.symbols(p)
        lo, hi = (index.first[s[-1:]], index.first[s[-1:] + 1]) if s[-1] >= 0 else (np.zeros(1, int),) * 2
        for c in s[-2::-1] if len(s) > 1 else []:
            lo, hi = index.extend(np.array([c]), lo, hi) if c >= 0 and lo[0] < hi[0] else (np.zeros(1, int),) * 2
        want = sorted(k for k, q in enumerate(seqs) for at in range(len(q) - len(p) + 1) if (q[at : at + len(p)] == p).all())
        assert sorted(index.owner[lo[0] : hi[0]].tolist()) == want
    shallow = FMIndex(seqs)
    p = rng.integers(0, 7, 300).astype(np.uint64)
    lo, hi = shallow.neighbours(shallow.symbols(p))
    for k in range(299):
        want = sorted(n for n, q in enumerate(seqs) for at in range(len(q) - 1) if q[at] == p[k] and q[at + 1] == p[k + 1])
        assert sorted(shallow.owner[lo[k] : hi[k]].tolist()) == want
    assert FMIndex([]).symbols(np.array([3], np.uint64)).tolist() == [-1]


def test_openings_share_seeds():
    rng = random.Random(7)
    for _ in range(3000):
        n = rng.randrange(12, 80)
        m = rng.randrange(-(-4 * n // 5), n + 1)
        if m < 12:
            continue
        shared = sorted(rng.sample(range(1000), bags.needed(n, m)))
        if len(shared) > m:
            continue
        # the texts' other words stand where they break most pairs
        pool = sorted(set(range(1000)) - set(shared))
        a, b = (np.array(sorted(shared + rng.sample(pool, k - len(shared)))) for k in (n, m))
        x, y = a[: split_overlap.opening(n)], b[: split_overlap.opening(m)]
        common = set(zip(x, x[1:])) & set(zip(y, y[1:]))
        assert len(common) >= min(split_overlap.seeds(n), split_overlap.seeds(m))
        assert split_overlap.merge_spans(a, b)[0] >= len(shared)


LABELLED = "Pros: it opens fast and never once lost data | Cons: the menu hides under the long list | Rating: 7 of 10"


def test_format_copies(spark):
    plain = "The quick editor keeps up with a large team, says my aunt, even on an old phone."
    rows = [
        (5, plain), (3, plain.upper()), (9, plain.replace(" ", "  ").replace(",", "")), (11, "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in plain)), (12, plain + " x"),
        (20, LABELLED), (22, "Rating - 7 of 10; CONS - The menu hides under the long list; Pros - It opens fast and never once lost data."),
        (23, "Pros: the menu hides under the long list | Cons: it opens fast and never once lost data | Rating: 7 of 10"),
        (30, "Die Straße war lang und der Weg nach Hause noch viel länger als sonst"), (31, "DIE STRASSE WAR LANG UND DER WEG NACH HAUSE NOCH VIEL LÄNGER ALS SONST"),
        (40, "too short text"), (41, "too short text"),
    ]
    want = {(3, 5), (3, 9), (3, 11), (20, 22), (30, 31), (903, 904)}
    df = spark.createDataFrame([(i, t, b"k") for i, t in rows + ODD], "review_id bigint, review_text string, key binary")
    for limit in (32 << 20, 50):
        assert {tuple(r) for r in format_copies.copies(df, limit=limit).collect()} == want
    n = {r["first_review_id"]: r["copies"] for r in format_copies.records(df).collect()}
    assert n == {3: 4, 12: 1, 20: 2, 23: 1, 30: 2, 903: 2}
    assert format_copies.copies(df.limit(0)).count() == 0


def test_format_copies_over_both_keys(spark):
    a = "Pros it opens fast and never lost data Cons the menu hides under the long list"
    b = "Pros: it opens fast and never lost data | Cons: the menu hides under the long list"
    c = "Cons: the menu hides under the long list | Pros: it opens fast and never lost data"
    other = "Pros: the menu hides under the long list | Cons: it opens fast and never lost data"
    for k, order in enumerate(([a, b, c, other], [b, a, c, other], [other, c, b, a])):
        rows = list(enumerate(order))
        mine = sorted(k for k, t in rows if t != other)
        df = spark.createDataFrame(rows, "review_id bigint, review_text string").coalesce(1).repartition(1 + k)
        assert {tuple(r) for r in format_copies.copies(df).collect()} == {(mine[0], k) for k in mine[1:]}
    assert {tuple(r) for r in format_copies.records(df).collect()} == {(mine[0], 3), (order.index(other), 1)}


def test_burst_trie():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(3000)]
    trie = format_copies.BurstTrie()
    for k, key in enumerate(keys):
        trie.add(key, k, 1)
    got = {key: (first, n) for key, first, n in trie.terminals()}
    assert got == {key: (keys.index(key), keys.count(key)) for key in set(keys)}
