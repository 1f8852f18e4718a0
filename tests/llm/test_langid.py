import math
import random
from collections import Counter

import numpy as np

from gaugeworks.llm import langid

SYLLABLES = {"aa": ["ba", "ko", "ti", "nu", "sha", "re"], "bb": ["über", "sch", "ent", "keit", "ung", "zu"], "cc": ["ción", "los", "que", "ar", "mi", "ja"]}


def text(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n=300):
    rng = random.Random(1)
    return [(i, text(lang, rng, rng.randint(3, 60)), lang, "src") for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def brute_kneser_ney(texts, order):
    """Straight from the definition, with counts in dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        chars = [chr(c) for c in langid.normalise([t])[0]]
        for i in range(order - 1, len(chars)):
            counts[order]["".join(chars[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram, vocabulary):
        value = 1 / vocabulary
        for n in range(1, order + 1):
            own = gram[order - n :]
            c = counts[n]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            followers = {g: v for g, v in c.items() if g[:-1] == own[:-1]}
            if followers:
                total = sum(followers.values())
                value = max(followers.get(own, 0) - d, 0) / total + sum(min(v, d) for v in followers.values()) / total * value
        return math.log(value)

    return p


def test_model_is_interpolated_kneser_ney():
    rng = random.Random(2)
    texts = {lang: [text(lang, rng, 12) for _ in range(2)] for lang in SYLLABLES}
    counts = {}
    for lang, own in texts.items():
        grams = []
        for t in own:
            x, _ = langid.normalise([t])
            grams.append(np.stack([x[k : len(x) - langid.ORDER + 1 + k] for k in range(langid.ORDER)], axis=1))
        rows_, n = np.unique(np.concatenate(grams), axis=0, return_counts=True)
        counts[lang] = (rows_, n.astype(float))
    model = langid.build(counts)
    probe = ["bako tinu", "über keit", "mija xyz"]
    _, h = model.cross_entropy(probe)
    for k, lang in enumerate(model.languages):
        p = brute_kneser_ney(texts[lang], langid.ORDER)
        for i, t in enumerate(probe):
            chars = "".join(chr(c) for c in langid.normalise([t])[0])
            own = [p(chars[j - langid.ORDER + 1 : j + 1], model.vocabulary) for j in range(langid.ORDER - 1, len(chars))]
            assert abs(h[i, k] + sum(own) / len(own)) < 1e-9
    # every context's distribution sums to one
    alphabet = sorted({c for own in texts.values() for t in own for c in langid.normalise([t])[0].tolist()})
    codes = np.array([[*map(ord, "ako"), c] for c in alphabet], np.uint32)
    assert np.all(np.exp(model.log_probability(codes)).sum(axis=0) < 1)
    assert np.all(np.exp(model.log_probability(codes)).sum(axis=0) > 1 - 1.5 / model.vocabulary)


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(3)
    extra = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "123 !!", None, "s"), (1003, "".join(rng.choice("qwxzvjkpfgh") for _ in range(400)), None, "s"), (None, text("cc", rng), None, "s"), (1004, "ba" * 60_000, None, "s")]
    df = spark.createDataFrame(rows() + extra, "doc_id long, text string, lang string, score string")
    model = langid.learn(df, learnable=~(df.doc_id % 3 == 0))
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id"], "text").collect()}
    truth = {i: lang for i, _, lang, _ in rows()}
    held = [i for i in truth if i % 3 == 0]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert not any(got[i].rejected for i in truth)
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[1003].rejected and not got[None].rejected and got[None].lang_pred == "cc" and got[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.learn(df) is None
    assert langid.identify(df, None, ["doc_id"], "text").first().lang_pred == "und"
    empty = df.limit(0)
    assert langid.identify(empty, langid.learn(empty), ["doc_id"], "text").collect() == []
    tiny = spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(tiny, langid.learn(tiny), ["doc_id"], "text").collect()] == ["xx", "xx"]


def model_of(n=120):
    counts = {}
    rng = random.Random(4)
    for lang in SYLLABLES:
        x, _ = langid.normalise([text(lang, rng, 200)])
        rows_, times = np.unique(np.stack([x[k : len(x) - langid.ORDER + 1 + k] for k in range(langid.ORDER)], axis=1), axis=0, return_counts=True)
        counts[lang] = (rows_, times.astype(float))
    return langid.build(counts)


def test_a_texts_values_are_its_own(monkeypatch):
    model, rng = model_of(), random.Random(6)
    probe = text("aa", rng, 30)
    alone = model.cross_entropy([probe])[1][0]
    for k in range(30):
        around = [text(rng.choice(list(SYLLABLES)), rng, rng.randint(0, 200)) for _ in range(rng.randint(0, 9))]
        assert np.array_equal(model.cross_entropy([*around, probe, *around[:k]])[1][len(around)], alone)


def test_long_texts_go_piece_by_piece(monkeypatch):
    model, rng = model_of(), random.Random(7)
    texts = [text("bb", rng, 300) + "   \n" * 9 + text("bb", rng, 90), "über" * 500, " " * 900, "", "x", None]
    letters, h = model.cross_entropy(texts)
    for chunk in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        again = model.cross_entropy(texts)
        assert np.array_equal(again[0], letters) and np.allclose(again[1], h, rtol=1e-12)
    assert letters[2] == 0 and letters[1] == 2000


def test_a_very_long_text_needs_bounded_memory():
    import tracemalloc

    model = model_of()
    long = "bako tinu share " * 1_900_000  # 30 million characters
    tracemalloc.start()
    letters, _ = model.cross_entropy([long])
    assert letters[0] == 1_900_000 * 13 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_models_depend_on_the_rows_only(spark):
    df = spark.createDataFrame(rows(400), "doc_id long, text string, lang string, score string")
    models = [langid.learn(df.repartition(n).orderBy(order)) for n, order in ((1, "doc_id"), (7, "text"), (3, "lang"))]
    for m in models[1:]:
        assert np.array_equal(m.limit, models[0].limit) and np.array_equal(m.top, models[0].top)


def test_marks_belong_to_words():
    x, _ = langid.normalise(["हिन्दी की"])
    assert "".join(map(chr, x))[langid.ORDER - 1 :] == "हिन्दी की"
    model = model_of()
    assert model.cross_entropy(["\u0301\u0301 !"])[0][0] == 0
