"""Language identification with interpolated Kneser-Ney character models.

Texts become letters in lower case and the marks that belong to them, with
single blanks between words. Every
language has an order-``ORDER`` model of these characters: raw counts at the top
order, continuation counts below, one absolute discount an order, interpolated
down to the uniform distribution. All languages share one sorted array of
64-bit n-gram hashes an order; beside it stand the discounted probabilities of
every language, and beside the sorted array of context hashes the backoff
weights. A text's language is the one with the lowest cross-entropy a character.

Rejection is calibrated on sampled documents that the counts left out, and on
the same documents with their letters shuffled, which have the language's
letters but none of its order. A text is rejected if it has no letter or if its
best cross-entropy lies past the middle between the two medians of its
language, plus an allowance for short texts that shrinks as 1/sqrt(letters).

Bounded sample (a classifier's): about ``SAMPLE_DOCS`` documents a language,
drawn by a hash of the id, of each a stretch of at most ``SAMPLE_CHARS``
characters (``CALIBRATE_CHARS`` for calibration), its place drawn by a hash of
the text. Languages' document counts cover all rows. The model depends on the
sampled rows only, not on their order. Scored are whole texts, ``CHUNK``
characters at a time; a text's result doesn't depend on what is scored beside it.

Defined results: null text, or text without a letter, is ``und`` with score 0
and rejected; ties between languages go to the first in alphabetical order;
repeated rows each give their row; without any labelled text every result is
``und``; only the id columns, text and (for learning) lang are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

ORDER = 4
SAMPLE_DOCS = 600
#: Of the sampled documents, one in so many calibrates the rejection.
CALIBRATE = 4
#: The allowance of a text of one letter, in nats.
SHORT = 2.0
#: Characters of a sampled document, for the counts and for calibration.
SAMPLE_CHARS, CALIBRATE_CHARS = 1 << 16, 1 << 12
#: Characters that a worker scores at a time.
CHUNK = 1 << 18
#: How fast the score's confidence grows with the root of the letters' number.
CONFIDENCE = 4.0

_MIX = np.uint64(0x9E3779B97F4A7C15)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point to its lower case if it is a letter, to itself if it is a mark within words, to a blank if neither; and which are letters."""
    global _tables
    if _tables is None:
        table, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
                letter[cp] = letter[table[cp]] = True
            elif unicodedata.category(c) in ("Mn", "Mc"):
                table[cp] = cp
        _tables = table, letter
    return _tables


_PAD = np.full(ORDER - 1, 32, np.uint32)


def _after(before: np.ndarray, text: str) -> np.ndarray:
    """before, the ORDER - 1 characters so far, and the text's own."""
    x = _letter_tables()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = x == 32
    return np.concatenate([before, x[~(gap & np.concatenate([before[-1:] == 32, gap[:-1]]))]]) if len(x) else before


def normalise(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' characters, ORDER - 1 blanks before each text, single blanks between words; and where texts end."""
    parts = [_after(_PAD, text or "") for text in texts]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.cumsum([len(p) for p in parts], dtype=np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position from n - 1 on."""
    h = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + x[i : len(x) - n + 1 + i].astype(np.uint64) + np.uint64(1)
    return _mix(h * _MIX + np.uint64(n))


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, keys[at] == h


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted hashes
    terms: list[np.ndarray]  # discounted probabilities, a row a gram, a column a language
    contexts: list[np.ndarray]  # by order from 1: sorted hashes of the n - 1 characters before
    weights: list[np.ndarray]  # interpolation weights
    vocabulary: int
    top: np.ndarray | None = None  # log probabilities of the top order's grams, interpolated
    limit: np.ndarray | None = None  # cross-entropy past which a text is none of the language

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """codes: rows of ORDER characters. The last one's log probability after the others, a column a language."""
        p = np.full((len(codes), len(self.languages)), 1.0 / self.vocabulary)
        for n in range(1, ORDER + 1):
            own = codes[:, ORDER - n :]
            at, there = _find(self.grams[n - 1], _row_hashes(own))
            term = np.where(there[:, None], self.terms[n - 1][at], 0.0)
            at, there = _find(self.contexts[n - 1], _row_hashes(own[:, :-1]))
            p = term + np.where(there[:, None], self.weights[n - 1][at], 1.0) * p
        return np.log(p)

    def cross_entropy(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: its letters' count, and nats a character by language."""
        letters, total, n = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        whole = [i for i, t in enumerate(texts) if len(t or "") <= CHUNK]
        if whole:
            letters[whole], total[whole], n[whole] = self._sums(*normalise([texts[i] for i in whole]))
        for i in set(range(len(texts))).difference(whole):  # a very long text, piece by piece
            before = _PAD
            for at in range(0, len(texts[i]), CHUNK):
                x = _after(before, texts[i][at : at + CHUNK])
                a, b, c = self._sums(x, np.array([len(x)]))
                letters[i] += a[0] - _letter_tables()[1][x[: ORDER - 1]].sum()
                total[i] += b[0]
                n[i] += c[0]
                before = x[len(x) - (ORDER - 1) :]
        return letters, -total / np.maximum(n, 1)[:, None]

    def _sums(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch of ORDER - 1 characters and those after them: letters, log probabilities by language, characters."""
        starts = np.concatenate([[0], ends[:-1]])
        letters = np.add.reduceat(_letter_tables()[1][x].astype(np.int64), starts)
        at, there = _find(self.grams[-1], gram_hashes(x, ORDER))
        scores = np.zeros((len(x), len(self.languages)))
        own = scores[ORDER - 1 :]
        own[:] = self.top[at]
        if not there.all():
            rare = np.flatnonzero(~there)
            own[rare] = self.log_probability(np.stack([x[rare + i] for i in range(ORDER)], axis=1))
        # a gram is counted at its last character; the first ORDER - 1 end none of their stretch
        for i in range(ORDER - 1):
            scores[starts + i] = 0.0
        return letters, np.add.reduceat(scores, starts, axis=0), ends - starts - (ORDER - 1)


def _row_hashes(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        h = h * np.uint64(0x100000001B3) + codes[:, i].astype(np.uint64) + np.uint64(1)
    return _mix(h * _MIX + np.uint64(codes.shape[1]))


def _group(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows summed: rows, counts, how many there were of each."""
    rows, inverse, times = np.unique(codes, axis=0, return_inverse=True, return_counts=True)
    return rows, np.bincount(inverse.ravel(), weights=counts, minlength=len(rows)), times


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: by language, rows of ORDER characters and their counts."""
    languages = sorted(counts)
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for language in languages:
        codes, n = counts[language]
        for order in range(ORDER, 0, -1):
            by_order[order - 1].append((codes, n))
            if order > 1:
                codes, _, times = _group(codes[:, 1:], n)
                n = times.astype(float)  # how many characters come before
    vocabulary = 1 + len(np.unique(np.concatenate([codes[:, 0] for codes, _ in by_order[0]])))
    model = Model(languages, [], [], [], [], vocabulary)
    for order in range(1, ORDER + 1):
        own = by_order[order - 1]
        grams = np.unique(np.concatenate([_row_hashes(c) for c, _ in own]))
        contexts = np.unique(np.concatenate([_row_hashes(c[:, :-1]) for c, _ in own]))
        terms, weights = np.zeros((len(grams), len(languages))), np.ones((len(contexts), len(languages)))
        for k, (codes, n) in enumerate(own):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, inverse = np.unique(_row_hashes(codes[:, :-1]), return_inverse=True)
            total = np.bincount(inverse, weights=n)
            terms[_find(grams, _row_hashes(codes))[0], k] = np.maximum(n - discount, 0) / total[inverse]
            left = np.bincount(inverse, weights=np.minimum(n, discount))
            weights[_find(contexts, context)[0], k] = left / total
        model.grams.append(grams)
        model.terms.append(terms)
        model.contexts.append(contexts)
        model.weights.append(weights)
    top = np.unique(np.concatenate([codes for codes, _ in by_order[-1]]), axis=0)
    hashes = _row_hashes(top)
    order = np.argsort(hashes)
    model.top = model.log_probability(top[order])
    if not np.array_equal(hashes[order], model.grams[-1]):
        raise ValueError("n-gram hashes collide")
    return model


def learn(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learnable: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from rows with a language; learnable narrows them. None if there is none."""
    rows = df if learnable is None else df.filter(learnable)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("langid")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    calibrates = F.pmod(F.xxhash64(F.col("text"), F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    chars = F.when(calibrates, CALIBRATE_CHARS).otherwise(SAMPLE_CHARS)
    first = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    sample = rows.filter(draw < share[F.col("lang")]).select("id", calibrates.alias("calibrates"), F.substring("text", first, chars).alias("text"), "lang").distinct()  # rows that repeat count once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every n-gram's count by language; one that calibrates is passed on instead."""
        found: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b""], pa.binary()), pa.array([text]), pa.array([1], pa.int64())], names=["lang", "gram", "text", "n"])
                    continue
                x, _ = normalise([text])
                if len(x) < ORDER:
                    continue
                grams, n = np.unique(np.stack([x[k : len(x) - ORDER + 1 + k] for k in range(ORDER)], axis=1), axis=0, return_counts=True)
                own = found.setdefault(lang, {})
                for g, k in zip(map(np.ndarray.tobytes, grams), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + k
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.binary()), pa.array([None] * len(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "text", "n"])

    gathered = sample.select("calibrates", "text", "lang").mapInArrow(lean(count), "lang string, gram binary, text string, n long")
    table = gathered.groupBy("lang", "gram", "text").agg(F.sum("n").alias("n")).toArrow()
    langs, grams, texts, n = (table.column(c).to_pylist() for c in ("lang", "gram", "text", "n"))
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    counts = {}
    for lang, at in by_lang.items():
        own = [i for i in at if texts[i] is None]
        if own:
            counts[lang] = (np.frombuffer(b"".join(grams[i] for i in own), np.uint32).reshape(-1, ORDER), np.asarray([n[i] for i in own], float))
    # a language whose whole sample fell to calibration learns from that
    for lang, at in by_lang.items():
        if lang not in counts:
            x, _ = normalise([texts[i] for i in at])
            if len(x) >= ORDER:
                counts[lang] = tuple(np.unique(np.stack([x[k : len(x) - ORDER + 1 + k] for k in range(ORDER)], axis=1), axis=0, return_counts=True))
                counts[lang] = (counts[lang][0], counts[lang][1].astype(float))
    if not counts:
        return None
    for lang, (codes, number) in counts.items():  # in an order of their own, as sums of shares depend on it
        order = np.lexsort(codes.T[::-1])
        counts[lang] = codes[order], number[order]
    model = build(counts)
    _calibrate(model, {lang: [texts[i] for i in at if texts[i] is not None] for lang, at in by_lang.items() if lang in counts})
    return model


def _calibrate(model: Model, texts: dict[str, list[str]]) -> None:
    """The limit of each language: midway between the medians of its texts and of their shuffled letters."""
    rng = np.random.default_rng(0)
    model.limit = np.full(len(model.languages), np.log(model.vocabulary))
    for k, lang in enumerate(model.languages):
        own = sorted(texts.get(lang, []))
        letters, h = model.cross_entropy(own)
        at = np.flatnonzero(letters >= 20)
        if len(at):
            shuffled = ["".join(rng.permutation(list(own[i].lower()))) for i in at.tolist()]
            model.limit[k] = (np.median(h[at, k]) + np.median(model.cross_entropy(shuffled)[1][:, k])) / 2


def predict(model: Model, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, scores, rejected, cross-entropies of the best."""
    letters, h = model.cross_entropy(texts)
    if not len(h):
        return [], np.empty(0), np.empty(0, bool), np.empty(0)
    best = h.argmin(axis=1)
    lowest = h[np.arange(len(h)), best]
    odds = np.exp(-(h - lowest[:, None]) * CONFIDENCE * np.sqrt(letters)[:, None])
    score = np.where(letters > 0, 1 / odds.sum(axis=1), 0.0)
    rejected = (letters == 0) | (lowest > model.limit[best] + SHORT / np.sqrt(np.maximum(letters, 1)))
    langs = [model.languages[k] if n else "und" for k, n in zip(best.tolist(), letters.tolist(), strict=True)]
    return langs, score, rejected, lowest


def identify(df: DataFrame, model: Model | None, id_cols: Sequence[str], text_col: str) -> DataFrame:
    """One row per input row: the id columns, lang_pred, score, rejected, cross_entropy."""
    schema = T.StructType([*[df.schema[c] for c in id_cols], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())])
    if model is None:
        return df.select(*id_cols, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(id_cols)).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                langs, scores, rejected, entropy = predict(held.value, texts[at:end])
                ids = [batch.column(i).slice(at, end - at) for i in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())], names=schema.names)
                at = end

    return df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)], F.col(text_col).alias("_text")).mapInArrow(lean(score), schema)
