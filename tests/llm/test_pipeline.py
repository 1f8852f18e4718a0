import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeworks.llm import langid

ALPHABETS = {"en": ["the", "ing", "ou", "st"], "de": ["sch", "über", "ung"], "fr": ["eau", "tion", "é"]}


def fixture(spark, path):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        lang = rng.choice(list(ALPHABETS))
        lines = [" ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 4))]
        if i % 7 == 0:
            lines.append("The very same footer line")
        rows.append((i, "\n".join(lines), lang, f"src{rng.choice([0, 0, 0, 1, 2, 5])}", 0))
    copy = rows[3][1] + "\nand a last line of its own"
    words = (copy + " more").split(" ")
    rows += [(200, rows[3][1] + "\n" + "padding words " * 40, "en", "src0", 0), (201, "12 !!", "en", "src1", 0), (202, None, None, None, 0), (203, "", "de", "src1", 0), (204, "".join(rng.choice("qxzjvkwp") for _ in range(900)), None, "src2", 0), (205, " ".join(words), "en", "src9", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return [r for r in rows]


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_linededup import brute as brute_lines  # noqa: F401  (same folder)
    from test_neardup import brute as brute_classes

    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "encode"]
    columns = docs.columns
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        held[name] = (before, after)
        if k < 4:
            assert docs.columns == columns
        if name == "language_id":
            model = langid.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
            expected = {i for i, r in before.items() if not langid.predict(model, [r.text])[2][0]}
            assert set(after) == expected and {201, 202, 203, 204} & expected == set() and set(range(160)) <= expected
            assert all(after[i] == before[i] for i in after)
        if name == "line_dedup":
            assert set(after) == set(before)
            lost = {i: nd for i, _, nd, _ in brute_lines([(i, r.text) for i, r in before.items()])}
            for i in after:
                assert after[i].text.count("\n") == max(0, before[i].text.count("\n") - lost[i]) or after[i].text == ""
                assert after[i].n_chars == len(after[i].text)
            assert sum("same footer" in r.text for r in after.values()) == 1
        if name == "near_dedup":
            assert set(after) == {c for _, c, _ in brute_classes([(i, r.text) for i, r in before.items()])}
        if name == "mix":
            assert set(after) < set(before) and all(after[i] == before[i] for i in after)
            words = lambda rows: sum(len(r.text.split()) for r in rows.values())
            assert words(after) <= corpus_pipeline.MIX_SHARE * words(before)
        if name == "encode":
            brute = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert {i: r.ids for i, r in after.items()} == {i: brute.encode(r.text, add_special_tokens=False).ids for i, r in before.items()}
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids for r in ran.collect()} == {i: r.ids for i, r in held["encode"][1].items()}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_clashing_columns_and_bear_nulls(spark, tmp_path):
    rows = [(i, f"the same words in every text but one {i} " * (1 + i % 3), "en", "src1", 1, i, "k", [0.5], f"x{i}") for i in range(30)]
    rows += [(None, "no identifier but words of its own in here", None, None, None, None, None, None, None), rows[3], rows[3], (99, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _c0 long, key string, features array<double>, _id string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    known = {r[5]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
        for r in docs.collect():
            assert (r["key"], r["features"], r["_id"]) == known[r["_c0"]][6:9]
