import random

from gaugeworks.llm import toxicity

BAD = ["grumbish", "vexwort", "slimeko"]


def rows(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "ed", "th", "ing", "ou", "re", "st", "wh", "er", "on"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(5000, None, "x"), (5001, "", "x"), (None, "vexwort here", "x"), (5002, "calm thing " * 20_000, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 5], "doc_id long, toxic int").unionByName(spark.createDataFrame([(None, 1), (7777, None), (3, 9)], "doc_id long, toxic int"))
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"], "text").collect()}
    held = [(got[i] >= 0.5, y) for i, _, y in data if i % 5 == 0]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)
    assert got[5000] == got[5001] < 0.5 and got[5002] < 0.5 and got[None] >= 0.5
    assert all(0 <= s <= 1 for s in got.values())


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for label in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(label, "doc_id long, toxic int"))
        assert model is None
        assert toxicity.score(docs, model, ["doc_id"], "text").first().score == 0.0
    assert toxicity.score(docs.limit(0), None, ["doc_id"], "text").collect() == []


def test_few_labels_still_learn():
    data = rows(60, 2)
    model = toxicity.fit([t for _, t, y in data if y], [t for _, t, y in data if not y])
    assert model is None or 0 <= model.score(0.2) <= model.score(0.9) <= 1


def test_calibration_rises():
    x, y, errors = toxicity.calibrate([0.0, 0.1, 0.1, 0.6, 0.7, 0.2], [0, 0, 0, 1, 1, 0])
    assert x[1] == 0.4 and y[1] == 0.5 and y[0] < 0.5 < y[2] and errors == 0
    assert toxicity.calibrate([0.1, 0.1], [0, 1])[0][1] == toxicity.DEFAULT_THRESHOLD


def test_toxic_words_within_long_runs():
    data = rows()
    model = toxicity.fit([t for _, t, y in data if y], [t for _, t, y in data if not y])
    scorer, rng = toxicity.Scorer(model), random.Random(5)
    plain = [t.split()[:k] for k in (5, 20, 60) for _, t, y in data[:300] if not y]
    for joint in ("", "_"):
        clean = [model.score(scorer.document(joint.join(words))) for words in plain]
        toxic = []
        for words in plain:
            at = rng.randrange(len(words))
            toxic.append(model.score(scorer.document(joint.join([*words[:at], rng.choice(BAD), *words[at:]]))))
        assert sum(s >= 0.5 for s in toxic) >= 0.97 * len(toxic) and sum(s >= 0.5 for s in clean) <= 0.03 * len(clean)


def test_toxic_words_in_a_script_without_blanks():
    rng = random.Random(6)
    draw = lambda: "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(rng.randint(60, 200)))
    bad = ["\u6211\u7231\u5317\u4eac\u5929\u5b89", "\u95e8\u9ad8\u9ad8\u5174\u5174\u897f"]

    def toxic():
        text = draw()
        at = rng.randrange(len(text))
        return text[:at] + rng.choice(bad) + text[at:]

    model = toxicity.fit([toxic() for _ in range(300)], [draw() for _ in range(600)])
    scorer = toxicity.Scorer(model)
    assert sum(model.score(scorer.document(toxic())) >= 0.5 for _ in range(200)) >= 190
    assert sum(model.score(scorer.document(draw())) >= 0.5 for _ in range(200)) <= 10


def test_scores_are_those_of_two_dictionaries():
    """Straight from the definition, with the dictionary in each call and no memory of words."""
    import re

    import zstandard

    rng = random.Random(9)
    toxic = [" ".join(rng.choice(["vilething", "grimword", "calm", "river", "stone"]) for _ in range(30)) for _ in range(60)]
    plain = [" ".join(rng.choice(["calm", "river", "stone", "meadow", "lantern"]) for _ in range(30)) for _ in range(120)]
    model = toxicity.fit(toxic, plain)
    held = [zstandard.ZstdCompressionDict(d + toxicity._AFTER + toxicity._BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic)]

    def size(window, k):
        one = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held[k], write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(one.compress(toxicity._BEFORE + window + toxicity._AFTER))

    def brute(text):
        windows = [f" {w} ".encode() for w in re.findall(r"\w+", text.lower())]
        return max([(size(w, 0) - size(w, 1)) / len(w) for w in windows], default=0.0)

    for text in [*toxic[:5], *plain[:5], "", "?!", "River, vilething!", "unseen words only"]:
        assert toxicity.Scorer(model).document(text) == max(0.0, brute(text))
    assert all(model.score(toxicity.Scorer(model).document(t)) >= 0.5 for t in toxic) and all(model.score(toxicity.Scorer(model).document(t)) < 0.5 for t in plain)


def test_passages_from_their_definition():
    data = rows()
    model = toxicity.fit([t for _, t, y in data if y], [t for _, t, y in data if not y])
    scorer = toxicity.Scorer(model)
    size, top = toxicity.BLOCK_WORDS, toxicity.STRONGEST

    def brute(text):
        words = text.lower().split()
        saved = {w: scorer.run(w) * (len(w) + 2) for w in words if len(w) <= toxicity.LONG_CHARS}
        best = 0.0
        for at in range(0, len(words), size):
            within = set(words[max(0, at - size) : at + size])
            best = max(best, sum(sorted((saved[w] for w in within), reverse=True)[:top]) / top)
        return best

    for _, text, _ in data[:60]:
        text = " ".join(w for w in text.split() if len(w) <= toxicity.LONG_CHARS)
        assert abs(scorer.distances(text)[1] - brute(text)) < 1e-9
    once = "vexwort " + "the " * 500
    assert scorer.distances(once * 3)[1] == scorer.distances(once)[1]  # far apart, or the same word again


def test_thresholds_of_windows_and_passages():
    """Against trying every pair of thresholds."""
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(4, 25)
        x, z = [0.0, *(rng.randrange(6) / 6 for _ in range(n))], [0.0, *(rng.randrange(6) / 2 for _ in range(n))]
        y = [0, *(int(a + b / 3 + rng.random() > 1.4) for a, b in zip(x[1:], z[1:], strict=True))]
        cases = list(zip(x, z, y, strict=True))
        tried = [(a, b) for a in [i / 6 - 0.01 for i in range(1, 8)] for b in [i / 2 - 0.01 for i in range(1, 8)]]
        *points, errors = toxicity.calibrate_both(x, z, y)
        model = toxicity.Model(b"", b"", *points)
        assert errors == min(sum((p >= a or q >= b) != bool(label) for p, q, label in cases) for a, b in tried)
        if errors < sum(y):
            assert errors == sum((model.score(p, q) >= 0.5) != bool(label) for p, q, label in cases)
