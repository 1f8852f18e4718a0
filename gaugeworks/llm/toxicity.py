"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on toxic, one on ordinary text. A
window, a word with its blanks, is compressed with either between the same
carrier bytes, which both dictionaries end with; a carrier costs one match, so
the rest is the window's own length under that dictionary. A window's
distance is the bytes that the toxic dictionary saves over the ordinary one,
as a share of the window's bytes. A document has two distances: that of its
largest window, and that of its strongest passage: the ``STRONGEST`` distinct
words that save most bytes in two successive blocks of ``BLOCK_WORDS`` words, and
their mean saving (a long run counts as ``LONG_CHARS`` bytes at the share of its
best window). Words that ordinary text has now and then tell nothing singly, but
some of them close together do. A monotone calibration turns either distance into
a score, with thresholds chosen together; the larger score counts.

Runs of over ``LONG_CHARS`` letters (scripts without blanks, words joined by
underscores) are also covered by windows of ``SLIDE_CHARS`` at steps of
``SLIDE_STEP``, so that a word within them is neither split nor diluted. The
dictionaries learn from such runs in pieces of ``WINDOW_CHARS``, by grams of
``GRAMS`` characters: within a run, shorter words are learned only with their
neighbours.

The toxic dictionary learns from the toxic documents' distinctive spans, as
toxic documents are mostly ordinary text: characters under grams that stand in
many more different word contexts there than in ordinary documents. Contexts
(the words before and after) count once, so copies of a document weigh nothing.

Bounded sample (a classifier's): about ``SAMPLE`` labelled documents of either
kind, drawn by a hash of the id, of each a stretch of at most ``SAMPLE_CHARS``
characters, its place drawn by a hash of the text; one in ``CALIBRATE`` of them is
left out of the dictionaries and calibrates the scores. Scored are whole texts.

Defined results: null and empty texts have distances of 0; repeated rows each give
their row, but of an id's texts only the smallest is learned from, once for each
of its labels; without toxic or without
ordinary labels all scores are 0; nothing but the id columns and text is read
for a score.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Sampled documents of each kind, by label.
SAMPLE = {1: 2000, 0: 4000}
#: Characters of a sampled document.
SAMPLE_CHARS = 1 << 14
CALIBRATE = 4
#: Lengths of grams: the shorter find a word within others, the longer its whole stem where its parts are ordinary.
GRAMS = (5, 8)
#: A gram is distinctive from so many contexts, so many standard deviations, and so many times the ordinary rate on. Of the ratios, the calibration documents choose the one with the fewest errors, the first of equal ones.
MIN_CONTEXTS, MIN_Z, MIN_RATIOS = 5, 3.0, (40.0, 10.0, 5.0)
ORDINARY_BYTES, TOXIC_BYTES = 1 << 14, 1 << 12
LEVEL = 3
#: Longer runs of letters are cut into windows of so many characters.
WINDOW_CHARS = 48
#: Over longer runs slide windows of about a word's length, in characters.
LONG_CHARS, SLIDE_CHARS, SLIDE_STEP = 16, 8, 2
#: A passage is two successive blocks of words; so many of its windows count.
BLOCK_WORDS, STRONGEST = 64, 3
#: Words whose distance a worker remembers.
CACHE = 1 << 19
#: Without enough labels to calibrate, a window that the toxic dictionary shortens by this share is toxic.
DEFAULT_THRESHOLD = 0.35

_WORD = re.compile(r"\w+")
#: Bytes before and after a window; zstandard looks for no match within an input's last eight bytes.
_BEFORE, _AFTER = hashlib.sha256(b"before").digest(), hashlib.sha256(b"after").digest()


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if any(len(w) > WINDOW_CHARS for w in found):
        found = [w[i : i + WINDOW_CHARS] for w in found for i in range(0, len(w), WINDOW_CHARS)]
    return found


def windows_of(run: str) -> Iterator[str]:
    """A word itself; a long run in pieces, and the windows that slide over it, borders of its pieces included."""
    if len(run) <= LONG_CHARS:
        yield run
        return
    for i in range(0, len(run), WINDOW_CHARS):
        yield run[i : i + WINDOW_CHARS]
    for i in range(0, len(run) - SLIDE_CHARS, SLIDE_STEP):
        yield run[i : i + SLIDE_CHARS]
    yield run[-SLIDE_CHARS:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    #: Calibration: distances, ascending, and the score from each on.
    distances: list[float]
    scores: list[float]
    #: The same of passages; without them only single windows count.
    passage_distances: list[float] = field(default_factory=lambda: [0.0])
    passage_scores: list[float] = field(default_factory=lambda: [0.0])

    def compressors(self) -> tuple:
        import zstandard

        out = []
        for content in (self.ordinary, self.toxic):
            held = zstandard.ZstdCompressionDict(content + _AFTER + _BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        return tuple(out)

    def score(self, distance: float, passage: float = 0.0) -> float:
        import numpy as np

        return float(max(np.interp(distance, self.distances, self.scores), np.interp(passage, self.passage_distances, self.passage_scores)))


class Scorer:
    """Distances of documents; remembers those of words."""

    def __init__(self, model: Model):
        self.ordinary, self.toxic = model.compressors()
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        window = f" {word} ".encode("utf-8", "replace")
        data = _BEFORE + window + _AFTER
        return (len(self.ordinary(data)) - len(self.toxic(data))) / len(window)

    def run(self, run: str) -> float:
        """The largest distance of a run's windows, 0 at least."""
        known, most = self.known, 0.0
        for w in windows_of(run):
            d = known.get(w)
            if d is None:
                if len(known) > CACHE:
                    known.clear()
                d = known[w] = self.word(w)
            if d > most:
                most = d
        return most

    def distances(self, text: str | None) -> tuple[float, float]:
        """Of the largest window, and of the strongest passage."""
        words = _WORD.findall((text or "").lower())
        most = passage = 0.0
        before: dict[str, float] = {}
        for at in range(0, len(words), BLOCK_WORDS):
            block = {}
            for w in set(words[at : at + BLOCK_WORDS]):
                d = self.run(w)
                if d > 0:
                    most = max(most, d)
                    block[w] = d * (min(len(w.encode("utf-8", "replace")), LONG_CHARS) + 2)
            if block:
                passage = max(passage, sum(heapq.nlargest(STRONGEST, {**before, **block}.values())) / STRONGEST)
            before = block
        return most, passage

    def document(self, text: str | None) -> float:
        return self.distances(text)[0]


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]


def _contexts(texts: Sequence[str], vocabulary: dict[str, int]):
    """Distinct (word before, word, word after): their words."""
    import numpy as np

    parts = []
    for text in texts:
        ids = np.array([0, *[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], 0], np.uint64)
        if len(ids) > 2:
            triples = (ids[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ ids[2:]) * np.uint64(0xC2B2AE3D27D4EB4F) + ids[1:-1]
            parts.append(np.stack([triples, ids[1:-1]]))
    if not parts:
        return np.empty(0, np.int64)
    both = np.concatenate(parts, axis=1)
    return both[1][np.unique(both[0], return_index=True)[1]].astype(np.int64)


def distinctive(toxic: Sequence[str], ordinary: Sequence[str]) -> list[tuple[float, set[str]]]:
    """Distinctive grams by each of MIN_RATIOS, sets that repeat the one before left out."""
    import numpy as np

    vocabulary: dict[str, int] = {}
    found = [_contexts(toxic, vocabulary), _contexts(ordinary, vocabulary)]
    per_word = [np.bincount(f, minlength=len(vocabulary) + 1) for f in found]
    counts: dict[str, list[int]] = {}
    toxic_only, ordinary_only = (c.tolist() for c in per_word)
    for word, i in vocabulary.items():
        a, b = toxic_only[i], ordinary_only[i]
        for g in set(_grams(word)):
            c = counts.setdefault(g, [0, 0])
            c[0] += a
            c[1] += b
    totals = [max(1, sum(c[k] for c in counts.values())) for k in (0, 1)]
    ratios: dict[str, float] = {}
    for g, (a, b) in counts.items():
        if a >= MIN_CONTEXTS:
            share = (a + b) / sum(totals)
            z = (a / totals[0] - b / totals[1]) / math.sqrt(share * (1 / totals[0] + 1 / totals[1]))
            if z >= MIN_Z:
                ratios[g] = (a + 0.5) / totals[0] / ((b + 0.5) / totals[1])
    out: list[tuple[float, set[str]]] = []
    for least in MIN_RATIOS:
        grams = {g for g, r in ratios.items() if r >= least}
        if grams and (not out or grams != out[-1][1]):
            out.append((least, grams))
    return out


def spans(text: str, grams: set[str]) -> list[str]:
    """Maximal stretches of words, blanks included, that distinctive grams cover."""
    out = []
    for word in words_of(text):
        padded = f" {word} "
        end = start = -1
        for i in range(len(padded)):
            reach = max((i + n for n in GRAMS if padded[i : i + n] in grams), default=-1)
            if reach < 0:
                continue
            if i > end:
                if end > 0:
                    out.append(padded[start:end])
                start = i
            end = max(end, reach)
        if end > 0:
            out.append(padded[start:end])
    return out


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: they are the dictionary themselves
        return b"".join(samples)[-size:]


def _points(x, y, threshold: float) -> tuple[list[float], list[float]]:
    """A rising score: 0.5 at the threshold, the kinds' rates at the ends."""
    below = x < threshold
    low, high = y[below].mean() if below.any() else 0.0, y[~below].mean() if not below.all() else 1.0
    return [min(0.0, x.min()) - 1e-9, threshold, max(x.max(), threshold + 1e-6)], [float(min(low, 0.4)) / 2, 0.5, float(max(high, 0.6))]


def calibrate(distances: Sequence[float], labels: Sequence[int]) -> tuple[list[float], list[float], int]:
    """Points of the score whose threshold has the fewest errors (of equal ones, that in the widest gap). And how many errors."""
    import numpy as np

    order = np.argsort(distances, kind="stable")
    x, y = np.asarray(distances, float)[order], np.asarray(labels)[order]
    cuts = np.flatnonzero(np.diff(x) > 0) + 1  # documents below the threshold
    errors = np.array([y[:c].sum() + (1 - y[c:]).sum() for c in cuts])
    if not len(cuts) or errors.min() >= y.sum():  # distances tell nothing
        return [0.0, DEFAULT_THRESHOLD, 1.0], [0.0, 0.5, 1.0], int(y.sum())
    best = max(cuts[errors == errors.min()], key=lambda c: x[c] - x[c - 1])
    return *_points(x, y, float((x[best - 1] + x[best]) / 2)), int(errors.min())


def calibrate_both(distances: Sequence[float], passages: Sequence[float], labels: Sequence[int]) -> tuple[list[float], list[float], list[float], list[float], int]:
    """Points for windows and for passages, and how many errors: the pair of thresholds with the fewest (of equal ones, that in the widest gap of passages, then of windows); windows alone, if passages save no error."""
    import numpy as np

    alone = calibrate(distances, labels)
    order = np.argsort(distances, kind="stable")
    x, z, y = np.asarray(distances, float)[order], np.asarray(passages, float)[order], np.asarray(labels)[order]
    cuts = np.append(np.flatnonzero(np.diff(x) > 0) + 1, len(x))  # the last one: no window is enough
    gaps = np.append(x[cuts[:-1]] - x[cuts[:-1] - 1], 0.0)
    steps = np.unique(z)
    fewest, best = (alone[2], 0.0, 0.0), None
    for low, high in zip(steps[:-1], steps[1:], strict=True):
        told = z >= high
        missed = np.cumsum((y == 1) & ~told)  # below a cut
        wrong = ((y == 0) & ~told)[::-1].cumsum()[::-1]  # from a cut on
        errors = missed[cuts - 1] + np.append(wrong, 0)[cuts] + ((y == 0) & told).sum()
        c = np.lexsort((-gaps, errors))[0]
        rank = (int(errors[c]), float(low - high), -float(gaps[c]))
        if rank[0] < alone[2] and rank < fewest:
            fewest, best = rank, (int(cuts[c]), float((low + high) / 2))
    if best is None:
        return alone[0], alone[1], [0.0], [0.0], alone[2]
    at, passage = best
    window = float((x[at - 1] + x[at]) / 2) if at < len(x) else max(float(x[-1]) + 1e-6, DEFAULT_THRESHOLD)
    return *_points(x, y, window), *_points(z, y, passage), fewest[0]


def fit(toxic: Sequence[str], ordinary: Sequence[str]) -> Model | None:
    """A model from sampled texts; every CALIBRATE-th of each kind calibrates."""
    if not toxic or not ordinary:
        return None
    few = len(toxic) < 4 * CALIBRATE or len(ordinary) < 4 * CALIBRATE
    learn = [toxic, ordinary] if few else [[t for i, t in enumerate(x) if i % CALIBRATE] for x in (toxic, ordinary)]
    plain = [" ".join(w[i : i + 8]).encode() for t in learn[1] for w in [words_of(t)] for i in range(0, len(w), 8)]
    common = _dictionary(ORDINARY_BYTES, plain[:: max(1, len(plain) // 40_000)], 64)
    best, fewest = None, math.inf
    for _, grams in distinctive(*learn):
        marked = ["".join(spans(t, grams)).encode() for t in learn[0]]
        model = Model(_dictionary(TOXIC_BYTES, marked, 32), common, [0.0, DEFAULT_THRESHOLD - 0.01, DEFAULT_THRESHOLD, 1.0], [0.05, 0.3, 0.7, 0.95])
        if few:
            return model
        scorer = Scorer(model)
        left = [(*scorer.distances(t), label) for label, x in ((1, toxic), (0, ordinary)) for t in x[::CALIBRATE]]
        model.distances, model.scores, model.passage_distances, model.passage_scores, errors = calibrate_both(*zip(*left, strict=True))
        if errors < fewest:
            best, fewest = model, errors
    return best


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """labels: id and a label of 0 or 1; other labels and null ids are left out. Only the sample, of bounded size, is broadcast and comes to the driver."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").distinct()
    sizes = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE[1] / sizes.get(1, 1))).otherwise(min(1.0, SAMPLE[0] / sizes.get(0, 1)))
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sample = marked.filter(draw < share).withColumn("draw", draw)
    text = text_or_empty(text_col)
    first = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = docs.select(F.col(id_col).alias("id"), F.substring(text, first, F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("draw", "id", "label").agg(F.min("text").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["draw"], str(r["id"]), r["label"]))
    return fit([r["text"] for r in rows if r["label"] == 1], [r["text"] for r in rows if r["label"] == 0])


def score(docs: DataFrame, model: Model | None, id_cols: Sequence[str], text_col: str) -> DataFrame:
    """One row per input row: the id columns, score, distance, passage_distance."""
    schema = T.StructType([*[docs.schema[c] for c in id_cols], T.StructField("score", T.DoubleType()), T.StructField("distance", T.DoubleType()), T.StructField("passage_distance", T.DoubleType())])
    if model is None:
        return docs.select(*id_cols, F.lit(0.0).alias("score"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("passage_distance"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer.distances(t) for t in batch.column(len(id_cols)).to_pylist()]
            values = [[held.value.score(*d) for d in found], [d for d, _ in found], [p for _, p in found]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(id_cols))), *(pa.array(v, pa.float64()) for v in values)], names=schema.names)

    return docs.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)], F.col(text_col).alias("_text")).mapInArrow(run, schema)
