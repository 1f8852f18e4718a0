import hashlib
import math
import random

import pytest

from gaugeworks.llm import mixing

WEIGHTS = {("d0",): 3, ("d1",): 1, (None, "en"): 2, ("d1", "en"): 5, (None, None, "none"): 0, (None, None, "s2"): 4}


def weight(path, weights):
    best = (-1, 1.0)
    for key, w in weights.items():
        if len(key) == len(path) and key[-1] == path[-1] and all(k is None or k == p for k, p in zip(key, path, strict=True)):
            best = max(best, (sum(k is not None for k in key), w))
    return float(best[1])


def fill(budget, children):
    """children: name -> (capacity, weight). Pour until the budget or the children are full."""
    given = {k: 0.0 for k in children}
    open_ = {k for k, (c, w) in children.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[k][1] for k in open_)
        step = min(left / total, min((children[k][0] - given[k]) / children[k][1] for k in open_))
        for k in open_:
            given[k] += step * children[k][1]
        left -= step * total
        open_ = {k for k in open_ if children[k][0] - given[k] > 1e-9}
    return given


def brute_budgets(leaves, weights, total, epochs):
    out = {}
    leaves = {path: n for path, n in leaves.items() if all(weight(path[:k], weights) > 0 for k in (1, 2, 3))}

    def walk(prefix, budget):
        depth = len(prefix)
        below = {}
        for path, tokens in leaves.items():
            if path[:depth] == prefix:
                below[path[: depth + 1]] = below.get(path[: depth + 1], 0) + tokens * epochs
        for path, b in fill(budget, {p: (c, weight(p, weights)) for p, c in below.items()}).items():
            if depth == 2:
                out[path] = b
            else:
                walk(path, b)

    walk((), min(total, epochs * sum(leaves.values())))
    return out


def docs(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        domain, lang = rng.choice(["d0", "d1", "d2", None]), rng.choice(["en", "en", "de", None])
        rows.append((i, domain, lang, rng.choice(["s0", "s1", "s2", "none", None, "hot", "hot", "hot"]), rng.choice([0, None, *range(1, 60)])))
    return [*rows, rows[5], rows[5]]


@pytest.mark.parametrize("share,epochs,few", [(0.3, 1, 256), (0.3, 1, 0.001), (0.7, 1, 4), (0.9, 3, 256), (2.5, 3, 1), (5.0, 2, 4)])
def test_budgets_and_selection(spark, monkeypatch, share, epochs, few):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    rows = docs(2)
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n long").withColumnRenamed("n", "_key")
    got = mixing.select(df, ["domain", "lang", "source"], id_col="doc_id", token_col="_key", weights=WEIGHTS, total_share=share, max_epochs=epochs, seed=3).collect()
    leaves = {}
    for _, *path, n in rows:
        if n:
            leaves[tuple(path)] = leaves.get(tuple(path), 0) + n
    budgets = brute_budgets(leaves, WEIGHTS, share * sum(leaves.values()), epochs)
    expected = []
    for path, budget in budgets.items():
        own = [(i, n) for i, *p, n in rows if tuple(p) == path and n]
        whole = math.floor(budget / leaves[path] + 1e-12)
        rest = budget - whole * leaves[path]
        order = sorted(own, key=lambda x: hashlib.md5(f"3:{whole}:{x[0]}".encode()).hexdigest())
        for i, n in own:
            key = hashlib.md5(f"3:{whole}:{i}".encode()).hexdigest()
            before = sum(m for j, m in order if hashlib.md5(f"3:{whole}:{j}".encode()).hexdigest() <= key)
            times = whole + (before <= rest + 1e-6)
            if times:
                expected.append((i, *path, n, times))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "a", 1000), ("d1", "en", "a", 1000)], "l0 string, l1 string, l2 string, tokens long")
    got = {tuple(r[:3]): r.budget for r in mixing.budgets(leaves, ["l0", "l1", "l2"], {}, 800, 1).select("l0", "l1", "l2", "budget").collect()}
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 190, ("d0", "de", "a"): 200, ("d1", "en", "a"): 400}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, a string, n long")
    assert mixing.select(df, ["a"], id_col="doc_id", token_col="n", weights={}, total_share=0.5).collect() == []


def test_what_hangs_on_no_weight_gets_no_budget(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "de", "a", 50), ("d1", "en", "a", 100)], "l0 string, l1 string, l2 string, tokens long")
    got = {tuple(r[:3]): r.budget for r in mixing.budgets(leaves, ["l0", "l1", "l2"], {("d0", "en"): 0}, 100, 1).select("l0", "l1", "l2", "budget").collect()}
    assert got == {("d0", "de", "a"): 50, ("d1", "en", "a"): 50}
    got = {tuple(r[:3]): r.budget for r in mixing.budgets(leaves, ["l0", "l1", "l2"], {("d0", "en"): 0}, 130, 1).select("l0", "l1", "l2", "budget").collect()}
    assert got == {("d0", "de", "a"): 50, ("d1", "en", "a"): 80}


def test_sql_says_the_same_with_nodes_of_no_weight(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from gaugeworks.llm import queries

    rng = random.Random(4)
    rows = [(i, rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0", "src1", "src2", "src9", None]), "word " * rng.choice([0, *range(1, 40)])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    weights = {("d0",): 4, ("d1",): 3, ("d2", "de"): 0, ("d1", "en"): 0, (None, "fr"): 2, (None, None, "src9"): 0}
    docs = df.select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.word_count(F.col("text")).alias("n"))
    for share in (0.2, 0.6, 0.95):
        got = mixing.select(docs, queries.MIX_LEVELS, id_col="doc_id", token_col="n", weights=weights, total_share=share, max_epochs=2, seed=queries.MIX_SEED)
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
            expected = c.execute(queries.mixing_sql(weights, share, 2)).fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str) and expected


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 5, f"text {i}") for i in range(900)], "doc_id long, leaf string, n long, text string")
    taken = mixing.select(df, ["leaf"], id_col="doc_id", token_col="n", weights={}, total_share=0.5, keep=["text"])
    assert "Exchange hash" not in taken._jdf.queryExecution().executedPlan().toString() and 400 < taken.count() < 452
