import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeworks.llm import neardup
from gaugeworks.llm.components import components


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return Counter([("", text or "")])
    return Counter(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else Counter([tuple(words)])


def fixture(seed=1, groups=25, largest=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 160))]
        for _ in range(largest if g == 0 else rng.choice([1, 1, 2, 3, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += ["", None, "...", "!!!", "!!!", "one two", "One, two", "two one", "a a a a a a a a a", "a " * 3000, "Caps And Punctuation! are: no difference, here at all.", "caps and punctuation are no difference here at all"]
    rng.shuffle(rows)
    ids = rng.sample(range(10**6), len(rows))
    return [*zip(ids, rows, strict=True), (None, "unique text without any identifier at all"), (ids[0], rows[0])]


def brute(rows):
    """Weights are the operator's, similarities and components from the definition."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    hashed = list(neardup.shingles(texts))
    counters = np.zeros(1 << neardup.DF_BITS, np.int64)
    for h, _ in hashed:
        np.add.at(counters, neardup._counters(h), 1)
    weight = neardup.weights_of(counters, len(texts))
    bags = [dict(zip(h.tolist(), zip(c.tolist(), weight[neardup._counters(h)].tolist(), strict=True), strict=True)) for h, c in hashed]
    for text, bag in zip(texts, bags, strict=True):
        assert sorted(c for c, _ in bag.values()) == sorted(shingles(text).values())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            both = sum(min(a[k][0], b[k][0]) * a[k][1] for k in a.keys() & b.keys())
            union = sum(c * w for c, w in a.values()) + sum(c * w for c, w in b.values()) - both
            if 5 * both >= 4 * union:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i, t in rows:
        members[find(texts.index(t or ""))].append(i)
    out = []
    for own in members.values():
        known = [i for i in own if i is not None]
        out += [(i, min(known) if known else None, len(own)) for i in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2048, 6])
def test_classes_match_brute_force(spark, monkeypatch, block):
    for name in ("GROUP", "PIVOTS", "BLOCK"):
        monkeypatch.setattr(neardup, name, block)
    rows = fixture()
    df = spark.createDataFrame([(*r, b"clash") for r in rows], "doc_id long, text string, key binary")
    got = sorted((tuple(r) for r in neardup.classes(df).collect()), key=str)
    assert got == brute(rows)


def test_unlike_texts_of_a_large_group_take_few_rounds(spark, monkeypatch):
    block, n, rounds = 48, 480, []
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PIVOTS", 12)
    compare = neardup._compare_pivots

    def counted(vectors, pivots):
        rounds.append(pivots.count())
        assert len(rounds) <= n // block + 5, rounds
        return compare(vectors, pivots)

    monkeypatch.setattr(neardup, "_compare_pivots", counted)
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(1 << 62, size=20, dtype=np.uint64)) for _ in range(n)]
    sets += [np.sort(np.append(sets[i][1:], np.uint64(i))) for i in range(0, n, 40)]  # 19 of 21 features shared
    keys = [i.to_bytes(4, "big") for i in rng.permutation(len(sets)).tolist()]
    rows = [(b"root", k, s.tobytes(), b"\x40" * 20, 20, -(-len(sets) // block)) for k, s in zip(keys, sets, strict=True)]
    edges = neardup._compare_large(spark.createDataFrame(rows, "root binary, key binary, features binary, weights binary, n long, blocks long"))
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in edges.filter("a <> b").collect()}
    assert found == {frozenset((keys[n + j], keys[i])) for j, i in enumerate(range(0, n, 40))}
    assert sum(rounds) >= n and max(rounds) <= 2 * block


def test_one_of_each_class_stays(spark):
    rows = fixture(2, 10, 5)
    df = spark.createDataFrame([(*r, str(r[0])) for r in rows], "doc_id long, text string, class_id string")
    kept = neardup.representatives(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in brute(rows)}


A, B = "one text of more than five words stands here", "another that has nothing in common with the first one"
NEAR = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(1, A), (None, A), (None, B)], {(1, A): 1, (None, B): 1}),
        ([(1, A), (1, A), (1, A)], {(1, A): 1}),
        ([(1, A), (1, B), (2, A)], {(1, A): 1, (1, B): 1}),
        ([(0, NEAR), (1, NEAR + " x"), (1, A), (3, A)], {(0, NEAR): 1, (1, A): 1}),
        ([(None, None), (None, ""), (None, A), (None, A)], {(None, ""): 1, (None, A): 1}),
        ([(5, NEAR), (5, NEAR + " x"), (None, NEAR + " y")], None),
    ],
)
def test_exactly_one_row_of_a_class_stays(spark, rows, expected):
    kept = neardup.representatives(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key long")).collect()
    found = Counter((r.doc_id, r.text or "") for r in kept)
    if expected is None:
        assert list(found.values()) == [1] and next(iter(found))[0] == 5
    else:
        assert dict(found) == expected


def test_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_agree_as_often_as_similarity_says():
    rng = np.random.default_rng(0)
    sampler = neardup.Sampler()
    hits, expected = [], []
    for _ in range(150):
        h, w = neardup._mix(rng.integers(1 << 62, size=300, dtype=np.uint64)), rng.integers(48, 65, size=300)
        k = int(rng.integers(0, 60))
        a, b = np.arange(0, 300 - k), np.arange(k, 300)
        hits.append((sampler.bands(h[a], w[a]) == sampler.bands(h[b], w[b])).mean())
        expected.append((w[k : 300 - k].sum() / w.sum()) ** neardup.ROWS)
    assert abs(np.mean(hits) - np.mean(expected)) < 0.03


def test_links_by_pairs_and_products_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, size=rng.integers(1, 120))).astype(np.uint64) for _ in range(70)]
    sets += [sets[0], sets[1][:-1], np.arange(3, dtype=np.uint64)]
    weight = rng.integers(48, 65, size=400).astype(np.uint8)
    expected = []
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = int(weight[np.intersect1d(a, sets[j]).astype(int)].sum())
            union = int(weight[np.union1d(a, sets[j]).astype(int)].sum())
            if 5 * both >= 4 * union:
                expected.append([i, j])
    got = neardup.links(sets, [weight[s.astype(int)] for s in sets], len(sets)).tolist()
    assert got == expected
    assert neardup.links(sets, [weight[s.astype(int)] for s in sets], 1).tolist() == [p for p in expected if p[0] == 0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: find(n) for n in nodes}
