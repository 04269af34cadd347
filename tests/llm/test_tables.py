"""Term bitmaps, quota samples, mixtures and leaks."""

import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import leaks, mixture, quota_sample, terms
from corvane.llm.common import words


def test_containers():
    rng = np.random.default_rng(1)
    for low in (np.arange(10), np.arange(0, 65536, 3), np.sort(rng.choice(65536, 300, replace=False)), np.array([5]), np.arange(65536)):
        data = terms.encode(low.astype("<u2"))
        assert np.array_equal(terms.decode(data), low) and terms.cardinality(data) == len(low) and len(data) <= 8193
    a, b = terms.encode(np.array([1, 2, 9], "<u2")), terms.encode(np.arange(5, dtype="<u2"))
    assert terms.decode(terms.union([a, b])).tolist() == [0, 1, 2, 3, 4, 9]


def test_terms(spark, monkeypatch):
    rows = [(1, "a b b"), (70_000, "A c"), (3, "a'b é"), (4, ""), (5, None), (6, "123"), (7, "a"), (8, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "review_id bigint, review_text string, term string")
    got = {r["term"]: (r["occurrences"], r["reviews"], r["mark"]) for r in terms.term_statistics(df).collect()}
    assert got == {"a": (4, 4, "common"), "b": (3, 2, "rare"), "c": (1, 1, "rare"), "long": (30_000, 1, "rare")}
    assert terms.term_statistics(df.limit(0)).count() == 0


def reviews(spark, n=400):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "", None, "b c"]) if k % 9 == 0 else "text", rng.choice(["positive", "POSITIVE ", "2", "negative", "0", "neutral", "mixed", None]), rng.choice(["store", " Store", "forum"]), rng.choice(["en", "de", None])) for k in range(n)]
    return spark.createDataFrame(rows, "review_id bigint, review_text string, sentiment string, source string, lang string"), rows


def test_quota_sample(spark):
    df, rows = reviews(spark)
    label = {"positive": 2, "2": 2, "negative": 0, "0": 0, "neutral": 1, "1": 1}
    use = [(i, label[s.strip().lower()], src.strip().lower()) for i, t, s, src, _ in rows if t and s and s.strip().lower() in label]
    plans = [(1, None, c, x, 0.5, 5) for c, x in enumerate((0.2, 0.6, 0.2))] + [(2, "FORUM", c, 1 / 3, 0.3, 500) for c in range(3)] + [(3, "none", c, 1 / 3, 0.1, 1) for c in range(3)] + [(4, "none", 0, 0.5, 0.1, 0)]
    p = spark.createDataFrame([(*x, 9) for x in plans], "plan_id int, source string, label int, target_share double, sample_frac double, min_rows int, available int")
    got = {(r["plan_id"], r["label"]): r for r in quota_sample.report(df, p).collect()}
    drawn = Counter((r["plan_id"], r["label"]) for r in quota_sample.sample(df, p).collect())
    assert len(got) == len(plans)
    for plan, source, c, share, frac, least in plans:
        own = [x for x in use if source is None or x[2] == source.lower()]
        have = sum(x[1] == c for x in own)
        need = max(share * frac * len(own), least)
        r = got[plan, c]
        assert (r["usable"], r["available"], r["unmet"]) == (len(own), have, have < need)
        assert drawn[plan, c] == r["drawn"] == min(have, max(round(share * frac * len(own)), least))
    again = {tuple(r) for r in quota_sample.sample(df.repartition(7), p).collect()}
    assert again == {tuple(r) for r in quota_sample.sample(df, p).collect()}
    assert quota_sample.sample(df.limit(0), p).count() == 0 and quota_sample.report(df.limit(0), p).count() == len(plans)


def test_margins(spark):
    """Source and language keep their shares where no cell runs short."""
    rng = random.Random(2)
    rows = [(k, "text", rng.choice(["positive", "negative", "neutral"]), rng.choice(["store", "forum", None]), rng.choice(["en", "de"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "review_id bigint, review_text string, sentiment string, source string, lang string")
    p = spark.createDataFrame([(1, None, c, x, 0.2, 0) for c, x in enumerate((0.2, 0.6, 0.2))] + [(2, "store", 0, 0.0, 0.5, 7), (2, "store", 1, 1.0, 0.5, 0)], "plan_id int, source string, label int, target_share double, sample_frac double, min_rows int")
    out = {(r["plan_id"], r["margin"], r["category"]): r for r in quota_sample.margins(df, p).collect()}
    assert all(abs(r["gap"]) <= 4 for k, r in out.items() if k[0] == 1) and len([k for k in out if k[0] == 1]) == 8
    assert out[2, "label", "0"]["drawn"] == 7 and out[2, "label", "2"]["drawn"] == 0


def test_rake():
    n = np.array([10.0, 20, 30, 40]) * 10
    axes = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = quota_sample.rake(n, axes, [np.array([50.0, 50.0]), np.array([30.0, 70.0])])
    assert np.allclose([w[:2].sum(), w[[0, 2]].sum()], [50, 30]) and np.isclose(w[0] * w[3] / (w[1] * w[2]), 10 * 40 / (20 * 30))
    # a cell gives no more than it has
    w = quota_sample.rake(np.array([3.0, 50, 50, 50]), axes, [np.array([40.0, 10.0]), np.array([30.0, 20.0])])
    assert (w <= [3, 50, 50, 50]).all() and np.isclose(w[[1, 3]].sum(), 20)
    assert not quota_sample.rake(np.zeros(2), [np.array([0, 1])], [np.array([0.5, 0.5])]).any()
    assert quota_sample.whole(np.array([1.4, 2.4, 0.2]), np.array([9, 2, 9]), 4).tolist() == [2, 2, 0]


@pytest.mark.parametrize("parts,node_docs", [(1, 20_000), (3, 100), (40, 4), (400, 4)])
def test_mixture(spark, monkeypatch, parts, node_docs):
    monkeypatch.setattr(mixture, "NODE_DOCS", node_docs)
    rng = random.Random(1)
    docs = [(k, rng.choice(["a", " A", "b", "c", None]), rng.choice([10, 50, 200, None, 0])) for k in range(1500)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, n_tokens bigint, copies int").repartition(parts)
    mixes = spark.createDataFrame([(1, "a", 0.5, 3, 0.5), (1, "B", 0.5, 3, 0.5), (2, "c", 1.0, 2, 1.0), (2, "none", 0.5, 2, 1.0)], "mix_id int, source string, target_share double, max_repeats int, budget_frac double")
    total = sum(n or 0 for _, _, n in docs)
    size = Counter()
    for _, s, n in docs:
        size[(s or "").strip().lower()] += n or 0
    for r in mixture.report(df, mixes).collect():
        name = r["source"].lower()
        goal = r["target_share"] * {1: 0.5, 2: 1.0}[r["mix_id"]] * total
        assert r["short"] == (r["max_repeats"] * size[name] < goal)
        assert abs(r["drawn_tokens"] - min(goal, r["max_repeats"] * size[name])) <= 200 and r["most_copies"] <= r["max_repeats"]
    out = mixture.mix(df, mixture.plan(df, mixes))
    if parts > 1:
        other = df.repartition(2)
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixture.mix(other, mixture.plan(other, mixes)).collect()}
    assert out.count() == out.select("mix_id", "doc_id").distinct().count()
    assert mixture.report(df.limit(0), mixes).count() == 4


def test_pivotal_is_unbiased():
    hits = 0
    for seed in range(400):
        done = []
        carry = mixture._settle(random.Random(seed), [[k, 10 * (1 + k % 3), 0.3] for k in range(9)], None, done)
        hits += sum(p for i, _, p in done if i == 4) + (carry[2] if carry and carry[0] == 4 else 0)
    assert abs(hits / 400 - 0.3) < 0.08


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40)) + ".") for k in range(12)] + [(50, None), (51, ""), (52, "one two")]
    docs = []
    for k in range(120):
        w = [rng.choice(vocabulary + ["foreign"]) for _ in range(rng.randrange(0, 80))]
        if k % 3 == 0:
            src = items[k % 12][1].rstrip(".").split()
            n = rng.randrange(8, 20)
            at = rng.randrange(0, 40 - n)
            w = w[: k % 17] + src[at : at + n] + w[k % 17 :]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (502, items[3][1] * 300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, run int")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, a in items:
        x = words(a)
        runs = {tuple(x[k : k + 12]) for k in range(len(x) - 11)}
        want |= {(i, d) for d, b in docs for y in [words(b)] if any(tuple(y[k : k + 12]) in runs for k in range(len(y) - 11))}
    got = [tuple(r) for r in leaks.found(df, it).collect()]
    assert set(got) == want and len(got) == len(want)
    assert leaks.found(df.limit(0), it).count() == 0 and leaks.found(df, it.limit(0)).count() == 0
    # a paraphrase: every seventh word replaced, so no run of twelve, but the order kept
    x = items[0][1].rstrip(".").split()
    para = spark.createDataFrame([(1, " ".join("foreign" if k in (11, 22, 31) else w for k, w in enumerate(x)))], "doc_id bigint, text string")
    assert [(r["item_id"], r["run"] < 12, r["shared"] > 0.9) for r in leaks.leaks(para, it).collect()] == [(0, True, True)]


def test_paraphrases_are_found(spark):
    """Planted edits of items of 40 words: at least nine tenths of each kind are found, and nothing else."""
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(600)]
    other = [f"o{k}" for k in range(600)]
    items = [(k, [rng.choice(vocabulary) for _ in range(40)]) for k in range(60)]
    edits = {
        "sixth": lambda w: [rng.choice(other) if k % 6 == 3 and k < 36 else x for k, x in enumerate(w)],
        "eighth": lambda w: [rng.choice(vocabulary) if k % 8 == 3 else x for k, x in enumerate(w)],
        "inserted": lambda w: [y for k, x in enumerate(w) for y in ([x, rng.choice(other)] if k % 6 == 3 else [x])],
        "swapped": lambda w: [w[k + 1] if k % 8 == 2 else w[k - 1] if k % 8 == 3 else w[k] for k in range(40)],
    }
    docs, want = [], {}
    for n, (kind, edit) in enumerate(edits.items()):
        for i, w in items:
            filler = [rng.choice(vocabulary + other) for _ in range(60)]
            docs.append((100 * n + i, " ".join(filler[:20] + edit(w) + filler[20:])))
            want[100 * n + i] = (kind, i)
    docs += [(1000 + k, " ".join(rng.choice(vocabulary + other) for _ in range(90))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()}
    found = Counter(want[d][0] for d, i in got if d in want and want[d][1] == i)
    assert all(found[kind] >= 54 for kind in edits), found
    assert all(d in want and want[d][1] == i for d, i in got)


def test_common_subsequence():
    assert leaks.common_subsequence(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 3])) == 2
    assert leaks.common_subsequence(np.array([1]), np.array([], int)) == 0
