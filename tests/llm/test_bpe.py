import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeworks.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.Codec(open(PATH, "rb").read())
BRUTE = Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabets = ["ab", "abcdefgh ", "aeiou\n\t ", "0123456789 ", "!?.,;'s t", "éèüß ñaö", "日本語漢字かな", "  　 \x1c\x1d\x85x", "😀👍🏽a ", "'ll 've I'm ", "́e​﻿"]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        yield "".join(rng.choice(alphabets[rng.randrange(len(alphabets))]) for _ in range(rng.randint(0, 300)))
        yield "".join(rng.choices(["<|endoftext|>", " word", "\n\n", "x" * rng.randint(1, 40), "<|endof"], k=8))
        yield "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x1F300, 0x1FAFF)])) for _ in range(30))


def test_codec_matches_the_tokenizers_library():
    for text in random_texts(1500):
        brute = BRUTE.encode(text, add_special_tokens=False).ids
        assert CODEC.encode(text) == brute, repr(text)
        assert CODEC.decode(brute) == BRUTE.decode(brute, skip_special_tokens=False) == text


def joined(text, *cuts):
    bounds = [0, *cuts, len(text)]
    return CODEC.join_all([np.array(CODEC.encode(text[i:j]), np.int32) for i, j in zip(bounds, bounds[1:], strict=False)]).tolist()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "etaoin", "thequickbrownfox", "é", "日本", "0123456789", "ha", "!?", "-=", " ", " \n", "' s", "a 1.", "'lvre d"])
def test_tree_of_joins_is_exact(alphabet, monkeypatch):
    rng = random.Random(len(alphabet))
    for k in range(25):
        monkeypatch.setattr(bpe, "STRETCH", rng.choice([0, 30, 1024]))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 700)))
        leaf = rng.choice([1, 3, 7, 50, 256])
        assert joined(text, *range(leaf, len(text), leaf)) == CODEC.encode(text) == BRUTE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("stretch", [0, 1024])
def test_cuts_at_every_offset(monkeypatch, stretch):
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    for text in random_texts(40, seed=3):
        expected = BRUTE.encode(text, add_special_tokens=False).ids
        for cut in range(len(text) + 1):
            assert joined(text, cut) == expected, (text, cut)
        assert joined(text, *range(1, len(text))) == expected


def test_special_tokens_and_runs_across_cuts(monkeypatch):
    texts = ["word " * 9 + "<|endoftext|>" + "tail" * 9, "<|endoftext|>" * 5, "<|endof" * 4 + "text|>", "x" * 90 + "<|endoftext|>" + " " * 90 + "y", "I'll we've " * 9, "''" * 40 + "re" * 40, " " * 60 + "'" * 60 + "s" * 60 + "1" * 60]
    for stretch in (0, 1024):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        for text in texts:
            expected = BRUTE.encode(text, add_special_tokens=False).ids
            for cut in range(len(text) + 1):
                assert joined(text, cut) == expected, (text, cut)
            for leaf in (2, 5, 17):
                assert joined(text, *range(leaf, len(text), leaf)) == expected


@pytest.mark.parametrize("leaf_chars", [300, 2048])
def test_operator(spark, monkeypatch, leaf_chars):
    monkeypatch.setattr(bpe, "FAN", 3)  # several levels
    rng = random.Random(5)
    long = ["x" * 5000, " " + "".join(rng.choice("abcdefgh") for _ in range(9001)) + " end", "word " * 400 + "é" * 3000 + "\n" * 2500 + " tail <|endoftext|>" + "7" * 2300, "　" * 2100 + "y", " ".join(random_texts(20, seed=8)), "a sentence, as they are. " * 3000, "x" * 2000 + "<|endoftext|>" + "y" * 3000]
    texts = [*random_texts(10), *long, "", None, "same", "same"]
    df = spark.createDataFrame([(i // 2, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids array<int>")
    rows = bpe.encode_decode(df, ["doc_id"], "text", PATH, outputs=True, leaf_chars=leaf_chars).collect()
    expected = []
    for i, text in enumerate(texts):
        ids = BRUTE.encode(text or "", add_special_tokens=False).ids
        expected.append((i // 2, len(ids), sha(",".join(map(str, ids))), sha(text or ""), ids, text or ""))
    assert sorted(tuple(r) for r in rows) == sorted(expected)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(df, ["doc_id"], "text", PATH).collect() == []


def test_null_ids_and_long_rows_that_repeat(spark):
    df = spark.createDataFrame([(None, "z" * 5000)] * 3, "doc_id long, text string")
    rows = bpe.encode_decode(df, ["doc_id"], "text", PATH, leaf_chars=1000).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, len(BRUTE.encode("z" * 5000).ids))] * 3
