import hashlib
import random

import xxhash

from gaugeworks.llm import syncmers

WORDS = ["alpha", "beta", "gamma", "delta", "Été", "日本", "x1", "the", "of", "and", "!!", "…"]


def fixture():
    rng = random.Random(4)
    rows = [(rng.randrange(10**6) * 3, " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.randint(0, 120)))) for _ in range(90)]
    long = " ".join(str(rng.random()) for _ in range(3000))
    return [*rows, (10**7, long), (10**7 + 1, long), (-5, None), (-6, ""), (-7, "a"), (-8, "z" * 9000), (17, "same id one"), (17, "same id two"), (None, "no id"), (None, "no id")]


def place(row):
    """Spark's xxhash64 is seeded with 42 and signed."""
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return (row[0] is not None, row[0] if row[0] is not None else 0, h - (1 << 64) * (h >> 63))


def brute(rows):
    order = sorted(rows, key=place, reverse=True)
    out = []
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edits_and_successors(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "FAN", 3)
    for per_range, per_part in ((2000, 64), (7, 64), (7, 3), (2, 1)):
        monkeypatch.setattr(syncmers, "RANGE_ROWS", per_range)
        monkeypatch.setattr(syncmers, "PART_RANGES", per_part)
        df = spark.createDataFrame([(*r, "clash") for r in fixture()], "doc_id long, text string, next string")
        got = syncmers.compare(df).select("doc_id", "n_chars", "edited_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute(fixture())


def test_ranges_are_cut_by_number_within_parts(spark, monkeypatch):
    """Ranges follow each other without overlap, hold every place once, and the sort has few parts."""
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 10)
    monkeypatch.setattr(syncmers, "PART_RANGES", 40)
    rows = [(i // 3, i % 7) for i in range(4000)]
    found = sorted(syncmers.ranges(spark.createDataFrame(rows, "id long, h long")).collect(), key=lambda r: r["range"])
    places = sorted(set(rows), reverse=True)
    assert [r["range"] for r in found] == list(range(len(found))) and len(places) / 10 <= len(found) <= len(places) / 10 + 10
    at = {p: i for i, p in enumerate(places)}
    assert at[tuple(found[0]["head"])] == 0 and at[tuple(found[-1]["low"])] == len(places) - 1
    assert all(at[tuple(b["head"])] == at[tuple(a["low"])] + 1 for a, b in zip(found, found[1:], strict=False))
    assert all(at[tuple(r["low"])] - at[tuple(r["head"])] < 10 for r in found)


def test_tasks_grow_in_number_with_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 4)
    monkeypatch.setattr(syncmers, "TASK_RANGES", 2)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(800)], "id long, text string")
    dealt = syncmers.with_successor(df)
    assert dealt.rdd.getNumPartitions() >= 100 and dealt.filter("not borrowed").count() == 800
    got = syncmers.compare(df.withColumnRenamed("id", "doc_id")).select("doc_id", "edited_sha256").collect()
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == sorted((i, h) for i, _, h in brute([(i, f"text {i}") for i in range(800)]))


def test_ranges_hold_for_outliers_strings_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 50)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(20))
    outlier = [(i, text()) for i in range(1500)] + [(10**18, text())]
    hot = [(7 if i % 3 else i, text()) for i in range(1500)] + [(None, text()) for _ in range(700)]
    strings = [(f"doc-{i}", text()) for i in range(1500)]
    for rows, kind in ((outlier, "long"), (hot, "long"), (strings, "string")):
        df = spark.createDataFrame(rows, f"id {kind}, text string")
        dealt = syncmers.with_successor(df).filter("not borrowed").groupBy("range").count().collect()
        assert len(dealt) >= len(rows) / 100 and max(r["count"] for r in dealt) <= 400
    got = syncmers.compare(spark.createDataFrame(strings, "doc_id string, text string")).select("doc_id", "edited_sha256").collect()
    order = sorted(strings, reverse=True)
    for (i, own), (_, after) in list(zip(order, [*order[1:], order[0]], strict=True))[::97]:
        half = len(own) // 2
        expected = hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
        assert [r.edited_sha256 for r in got if r.doc_id == i] == [expected]


def test_single_document_and_empty_table(spark):
    one = syncmers.compare(spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 33
    assert syncmers.compare(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness(spark):
    rows = {r.doc_id: r for r in syncmers.compare(spark.createDataFrame(fixture(), "doc_id long, text string")).collect()}
    for r in rows.values():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[10**7].fingerprint == rows[10**7 + 1].fingerprint and rows[10**7 + 1].near_next == 1.0
    assert 0.4 < rows[10**7].near_edited < 0.6 and rows[10**7].near_next < 0.05
    assert rows[-5].fingerprint == rows[-6].fingerprint
    long = [r for r in rows.values() if r.n_chars > 200 and r.doc_id not in (10**7 + 1,)]
    assert sum(r.near_edited > r.near_next for r in long) == len(long)


def test_anchors_are_context_free(spark):
    """An anchor within a shared passage has the same hash whatever stands around it."""
    rng = random.Random(9)
    passage = " ".join(str(rng.randrange(10**9)) for _ in range(200))
    texts = [passage, "other words before " * 7 + passage + " and after" * 5]
    a, b = (r.fingerprint for r in syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect())
    hashes = [x.split(":")[1] for x in a.split(" ")]
    inner = hashes[4:-4]
    assert set(inner) <= {x.split(":")[1] for x in b.split(" ")}
    assert 0.35 * 200 < len(hashes) < 0.75 * 210


def test_closed_syncmers_by_definition(spark):
    """Anchors are the k-mers whose smallest s-mer is at an edge."""
    from pyspark.sql import functions as F

    words = [f"w{i % 17}" for i in range(60)]
    df = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
    h = [0] * 4 + [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()] + [0] * 4
    s = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:], strict=False))], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    expected = [i for i in range(len(h) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]
    steps = [int(x.split(":")[0], 16) for x in syncmers.fingerprints(df).first().fingerprint.split(" ")]
    assert [sum(steps[: n + 1]) for n in range(len(steps))] == expected
