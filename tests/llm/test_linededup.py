import hashlib
import random

import pytest

from gaugeworks.llm import linededup


def brute(rows):
    strip = " \t\n\x0b\x0c\r"
    upper = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(strip).translate(upper)
    holders = {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def fixture(seed, n=120):
    rng = random.Random(seed)
    pool = ["All rights reserved.", "  all RIGHTS reserved.\t", "short", "ÀÉÎ ten chars", "àéî ten chars", "x" * 5000, "日本語の文章です。はい", "日本語", "\x1cnot stripped\x1c", "", "tab\tinside line", "cr at end line\r"]
    rows = [(i, "\n".join(rng.choice([*pool, f"unique line {i} {rng.random()}"]) for _ in range(rng.randint(0, 6)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "All rights reserved."), (None, "short\nAll rights reserved."), (3, "All rights reserved.\nand more text"), rows[0]]


#: The size that the lines ask for, many segments, and one so small that it suspects much.
@pytest.mark.parametrize("size", [None, (37, 1 << 12), (3, 64)])
@pytest.mark.parametrize("flush", [linededup.FLUSH, 20])
def test_matches_brute_force(spark, monkeypatch, size, flush):
    monkeypatch.setattr(linededup, "FLUSH", flush)
    rows = fixture(1)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string").repartition(5)
    got = linededup.digests(df, size=size)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "the same line here\nmine", "k", 5), (2, "The same line here", "l", 7)], "doc_id long, text string, keys string, n_chars long")
    got = {r.doc_id: r for r in linededup.dedup_documents(df).collect()}
    assert got[1].text == "the same line here\nmine" and got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == 23 and got[2]["keys"] == "l"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.digests(df).collect() == []


def test_filter_has_no_false_negatives(spark):
    rows = [(i, f"a line that stands in two documents {i // 2}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sum(r.n_dropped for r in linededup.digests(df).collect()) == 1000


def test_hot_line_over_many_segments_and_gatherings(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FLUSH", 64)
    monkeypatch.setattr(linededup, "ROW_KEYS", 16)
    rng = random.Random(2)
    rows = [(f"id{i:05d}", "\n".join(["the line of a third of all" if i % 3 == 0 else f"line of one document {i}", *(f"shared by some {rng.randrange(900)}" for _ in range(3))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(11)
    got = linededup.digests(df, size=(101, 1 << 10))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_only_what_repeats_is_suspected(spark):
    rows = [(i, "\n".join(f"line {k} of document {i}" for k in range(20)) + f"\nwhat two documents have {i // 2}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(text as binary) text").repartition(6)
    found = linededup.suspects(docs, linededup.filter_size(21_000)).collect()
    assert 1000 <= len(found) < 1400  # of 21,000 lines


def test_filter_grows_in_segments():
    assert linededup.filter_size(0) == (1, linededup.SMALL)
    assert linededup.filter_size(10**12) == (-(-(10**12) * linededup.BITS // linededup.LARGE), linededup.LARGE)
