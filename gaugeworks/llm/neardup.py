"""Near-duplicate classes by improved consistent weighted sampling.

1. Equal texts collapse by digest; all else works on distinct texts.
2. A text is its set of shingles of ``SHINGLE`` words. How many distinct texts
   hold a shingle is counted over the whole corpus in ``1 << DF_BITS`` hashed
   counters. A shingle weighs its count in the text times its inverse document
   frequency, which is clipped to [``IDF_FLOOR``, 1] where it falls below
   ln(1 / ``COMMON``), so that a large group's own shingles don't lose so much
   weight against a copy's edits that the copies no longer look alike.
3. Improved consistent weighted sampling draws ``BANDS`` x ``ROWS`` samples; texts
   that agree in all samples of a band are candidates. A bucket links its texts
   to its smallest only, and connected buckets make a candidate group.
4. Within a candidate group all pairs are compared exactly: weighted Jaccard of
   at least ``SIMILARITY`` is a link, in whole numbers, so results don't depend on
   summation order. Groups of up to ``GROUP`` texts are compared in one task. Larger
   ones are dealt into blocks that meet rounds of pivots: about ``PIVOTS`` of all
   texts first, which join most of a group of near copies, then up to ``BLOCK`` a
   round of all texts outside the group's largest class. Afterwards
   each pair has been compared or is joined already, so no link is lost and no
   task holds a group. N texts outside the largest class take about N / ``BLOCK``
   rounds, each of which reads the whole group.
5. Classes are the components of the links; a class's id is its smallest id.

Defined results: null text counts as empty; texts of fewer than five words are
one shingle of what they have; texts without words are alike only if equal;
null ids take part, a class of null ids only has a null class id; rows that
repeat an id each give their row; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, text_or_empty
from .components import components

SHINGLE = 5
SIMILARITY = (4, 5)
BANDS, ROWS = 12, 4
DF_BITS = 20
COMMON, IDF_FLOOR = 0.1, 0.75
#: Weights are whole multiples of 1 / UNIT.
UNIT = 64
#: Texts and shingles of a group that one task compares; larger groups are dealt into blocks of about as many.
GROUP, GROUP_FEATURES = 512, 4_000_000
#: Pivots of a group in the first round, and in a later one.
PIVOTS, BLOCK = 64, 4096
#: Texts that hold a feature for it to be compared by pairs; rows compared at a time.
FEW, ROW_BLOCK = 24, 512
#: Rows of the tables from which a shingle draws its random numbers.
TABLE_BITS = 13
#: Shingles whose samples are drawn at a time.
COLUMNS = 1024
#: Characters that a worker cuts into shingles at a time.
CHUNK = 1 << 18
#: Shares in which a bucket's texts meet its smallest.
SALTS = 16
SEED = 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_word_chars: np.ndarray | None = None
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters, digits or underscores; powers of _PRIME and of its inverse."""
    global _word_chars
    if _word_chars is None:
        _word_chars = np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for k, base in enumerate((_PRIME, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _word_chars, _powers[0], _powers[1]


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case, and how many each text has.

    A word's hash is its characters' polynomial, read off running sums over all texts at once.
    """
    joined = "\n".join(texts).lower() + "\n"
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word, power, inverse = _tables(len(x) + 1)
    inside = is_word[x]
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends in turn; the last character is none
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(7)) * power[: len(x)], out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lower = [len(t) if t.isascii() else len(t.lower()) for t in texts]
    bounds = np.cumsum(np.asarray(lower, np.int64) + 1)
    if len(bounds) and bounds[-1] != len(x):  # a letter's lower case depends on its neighbours here: take the texts one by one
        parts = [_word_hashes([t]) for t in texts] if len(texts) > 1 else []
        if parts:
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        bounds = np.array([len(x)])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashes of its distinct shingles, and their counts."""
    import xxhash

    texts = [t or "" for t in texts]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        words, counts = _word_hashes(texts[at:end])
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE if len(rolled) else 0):
            rolled *= _PRIME
            rolled += words[i : i + len(rolled)]
        rolled = _mix(rolled)
        first = np.cumsum(counts) - counts
        for text, start, n in zip(texts[at:end], first.tolist(), counts.tolist(), strict=True):
            if n >= SHINGLE:
                own = np.sort(rolled[start : start + n - SHINGLE + 1])
            elif n:
                h = np.uint64(n)
                for w in words[start : start + n]:
                    h = _mix(np.array([h ^ w], np.uint64) * _PRIME)[0]
                own = np.array([h], np.uint64)
            else:
                own = _mix(np.array([xxhash.xxh3_64_intdigest(text)], np.uint64))
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            yield own[new], np.diff(new, append=len(own))
        at = end


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def weights_of(df_counts: np.ndarray, texts: int) -> np.ndarray:
    """Whole-number weight by counter."""
    idf = np.log(max(texts, 1) / np.maximum(df_counts, 1)) / np.log(1 / COMMON)
    return np.round(np.clip(idf, IDF_FLOOR, 1.0) * UNIT).astype(np.int32)


def document_frequencies(units: DataFrame) -> np.ndarray:
    """Counters of how many texts hold a shingle; their number is fixed, whatever the corpus."""
    parts = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        n = np.zeros(1 << DF_BITS, np.int64)
        for batch in batches:
            for h, _ in shingles(batch.column(0).to_pylist()):
                np.add.at(n, _counters(h), 1)
        data = [zstandard.compress(p.astype("<u4").tobytes(), 1) for p in np.split(n, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array(data, pa.binary())], names=["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros((1 << DF_BITS) // parts, np.int64)
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                total += np.frombuffer(zstandard.decompress(data), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    def add_table(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(key, iter(table.to_batches()))))

    found = units.select("text").mapInArrow(lean(count), "part long, counts binary").groupBy("part").applyInArrow(add_table, "part long, counts binary").collect()
    held = {r.part: np.frombuffer(r.counts, np.int64) for r in found}
    return np.concatenate([held.get(i, np.zeros((1 << DF_BITS) // parts, np.int64)) for i in range(parts)])


class Sampler:
    """Consistent weighted samples: the random numbers depend on the shingle and the sample's number only."""

    def __init__(self):
        n, samples = 1 << TABLE_BITS, BANDS * ROWS
        rng = np.random.default_rng(SEED)
        gamma = lambda: -np.log(rng.random(samples * n) * rng.random(samples * n) + 1e-300)
        self.odd = (rng.integers(1 << 62, size=(samples, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.row = np.arange(samples, dtype=np.int64)[:, None] * n
        self.r, self.log_c, self.beta = gamma().astype(np.float32), np.log(gamma()).astype(np.float32), rng.random(samples * n).astype(np.float32)

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A hash for each band."""
        log_w = np.log(weights).astype(np.float32)
        samples = BANDS * ROWS
        least, drawn, every = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.arange(samples)
        for i in range(0, len(hashes), COLUMNS):
            h = hashes[i : i + COLUMNS]
            at = (h * self.odd >> np.uint64(64 - TABLE_BITS)).view(np.int64)
            at += self.row
            r, beta = self.r.take(at), self.beta.take(at)
            t = log_w[i : i + COLUMNS] / r
            t += beta
            np.floor(t, out=t)
            log_a = self.log_c.take(at)
            beta -= t
            beta -= 1
            beta *= r
            log_a += beta
            k = log_a.argmin(axis=1)
            found = log_a[every, k]
            better = found < least
            least[better] = found[better]
            drawn[better] = (h[k] ^ t[every, k].astype(np.int64).view(np.uint64))[better]
        drawn = _mix(drawn).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            out = _mix(out * _PRIME + drawn[:, i])
        return out


def links(features: list[np.ndarray], weights: list[np.ndarray], pivots: int, first: int = 0) -> np.ndarray:
    """Pairs (i, j), i < pivots, i < j, first <= j, of texts whose weighted Jaccard similarity reaches SIMILARITY.

    features: sorted hashes of a text; a feature weighs the same in every text.
    Only features of several texts count towards what two texts share: rare ones
    as pairs, frequent ones as matrix products.
    """
    m = len(features)
    size = np.array([w.sum(dtype=np.int64) for w in weights])
    exact = np.float64 if size.max(initial=0) >= 1 << 23 else np.float32  # whole numbers stay whole
    text = np.repeat(np.arange(m), [len(f) for f in features])
    flat, inverse, times = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    weight = np.zeros(len(flat), np.int64)
    weight[inverse] = np.concatenate(weights)
    order = np.argsort(inverse, kind="stable")  # by feature, texts ascending
    feature, text = inverse[order], text[order]

    few = (times > 1) & (times <= FEW)
    keep = few[feature]
    f, t = feature[keep], text[keep]
    ends = np.searchsorted(f, f, side="right")
    rare = [np.zeros((3, 0), np.int64)]
    for step in range(1, FEW):
        at = np.flatnonzero((np.arange(len(f)) + step < ends) & (t < pivots))
        if not len(at):
            break
        rare.append(np.stack([t[at], t[at + step], weight[f[at]]]))
    rare = np.concatenate(rare, axis=1)
    rare = rare[:, rare[1] >= first]
    rare = rare[:, np.argsort(rare[0], kind="stable")]

    many = np.flatnonzero(times > FEW)
    column = np.full(len(flat), -1)
    column[many] = np.arange(len(many))
    keep = column[feature] >= 0
    columns, rows = column[feature[keep]], text[keep]

    found = []
    for low in range(0, pivots, ROW_BLOCK):
        high = min(low + ROW_BLOCK, pivots)
        a, b = np.searchsorted(rare[0], [low, high])
        width = m - first
        shared = np.bincount((rare[0, a:b] - low) * width + rare[1, a:b] - first, weights=rare[2, a:b], minlength=(high - low) * width).astype(exact).reshape(high - low, width)
        for at in range(0, len(many), 1024):
            a, b = np.searchsorted(columns, [at, at + 1024])
            x = np.zeros((m, min(1024, len(many) - at)), exact)
            x[rows[a:b], columns[a:b] - at] = 1
            shared += (x[low:high] * weight[many[at : at + 1024]].astype(exact)) @ x[first:].T
        union = size[low:high, None] + size[None, first:] - shared
        linked = shared * SIMILARITY[1] >= union * SIMILARITY[0]
        linked &= np.arange(first, m)[None, :] > np.arange(low, high)[:, None]
        found.append(np.argwhere(linked) + [low, first])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def spanning(pairs: np.ndarray, m: int) -> list[tuple[int, int]]:
    """(node, root) for nodes whose component, of the pairs, has a smaller node."""
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(i, r) for i in range(m) if (r := find(i)) != i]


_EDGES = "a binary, b binary"


def _edge_batch(keys: list[bytes], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.binary()), pa.array([keys[r] for _, r in found], pa.binary())], names=["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[list[dict]]:
    """Rows of equal group, which follow each other."""
    rows, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[g] for g in group)
            if key != now and rows:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows


def _vectors(rows: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(r["features"], np.uint64) for r in rows], [np.frombuffer(r["weights"], np.uint8) for r in rows]


def _compare_groups(vectors: DataFrame) -> DataFrame:
    """Spanning links of groups that fit a task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["root"]):
            found = spanning(links(*_vectors(rows), len(rows)), len(rows))
            if found:
                yield _edge_batch([r["key"] for r in rows], found)

    return vectors.select("root", "key", "features", "weights").repartition("root").sortWithinPartitions("root", "key").mapInArrow(lean(compare), _EDGES)


def _compare_pivots(vectors: DataFrame, pivots: DataFrame) -> DataFrame:
    """Spanning links of large groups' blocks with their pivots."""
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    columns = ["root", "block", "member", "key", "features", "weights"]
    members = vectors.withColumn("block", block).withColumn("member", F.lit(1)).select(columns)
    copies = vectors.join(pivots, "key", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("member", F.lit(0)).select(columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["root", "block"]):
            n = sum(r["member"] == 0 for r in rows)
            # pivots meet each other as members of blocks
            found = spanning(links(*_vectors(rows), n, first=n), len(rows)) if n else []
            if found:
                yield _edge_batch([r["key"] for r in rows], found)

    return members.unionByName(copies).repartition("root", "block").sortWithinPartitions("root", "block", "member", "key").mapInArrow(lean(compare), _EDGES)


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of root, key, ... with their group's facts (a row a root), which a large group's rows meet in shares."""
    groups = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(groups, ["root", "salt"]).drop("salt")


def _compare_large(vectors: DataFrame) -> DataFrame:
    """Links of groups that fit no task, round by round."""
    empty = vectors.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    edges, done = empty, vectors.select("key").limit(0)
    groups = vectors.select("root", "key")
    labels = groups.withColumn("class", F.col("key"))
    turn = 0
    while True:
        sizes = labels.groupBy("root", "class").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("root").agg(F.max(F.struct("n", "class")).alias("top")).select("root", F.col("top.class").alias("largest"))
        open_ = _with_groups(labels, largest).filter(F.lit(True) if turn == 0 else F.col("class") != F.col("largest")).join(done, "key", "left_anti").select("root", "key")
        left = open_.groupBy("root").agg(F.count("*").alias("open"))
        want = BLOCK if turn else PIVOTS
        # about so many of a group's open texts, drawn afresh every round: an old draw has used up the texts that it favours
        draw = F.pmod(F.xxhash64("key", F.lit("pivot"), F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = _with_groups(open_, left).filter((F.col("open") <= want) | (draw <= F.lit(float(want)) / F.col("open"))).select("key")
        chosen = materialise(chosen, "pivots")
        if chosen.isEmpty():
            if open_.isEmpty():
                return edges
            chosen = materialise(open_.groupBy("root").agg(F.min("key").alias("key")).select("key"), "pivots")
        edges = materialise(edges.unionByName(_compare_pivots(vectors, chosen)), "links")
        done = materialise(done.unionByName(chosen), "pivots-done")
        roots = components(edges, "classes")
        labels = _labelled(groups, roots)
        turn += 1


def _labelled(groups: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("key"), F.col("root").alias("class"))
    return materialise(groups.join(named, "key", "left").select("root", "key", F.coalesce("class", "key").alias("class")), "labels")


def _key(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, class_id (the class's smallest id), class_size (its rows)."""
    return _members(*_classes_of_texts(df, id_col, text_col), id_col)


def _classes_of_texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of id, key (of the text); rows of key, class for texts that are like another."""
    keyed = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), _key(text_col).alias("key"))
    members = materialise(keyed.select("id", "key"), "members")
    units = materialise(keyed.select("key", "text").dropDuplicates(["key"]), "texts")
    spark = df.sparkSession
    n = units.count()
    table = spark.sparkContext.broadcast(weights_of(document_frequencies(units), n).astype(np.uint8))  # 1 << DF_BITS bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, by_counter = Sampler(), table.value
        for batch in batches:
            found = []
            for h, count in shingles(batch.column(1).to_pylist()):
                found.append(sampler.bands(h, count * by_counter[_counters(h)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["key", "bands"])

    signed = materialise(units.mapInArrow(lean(sign), "key binary, bands array<long>"), "bands")
    rows = signed.select("key", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").select("band", "least")
    buckets = buckets.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    candidates = rows.join(buckets, ["band", "salt"]).select(F.col("key").alias("a"), F.col("least").alias("b"))
    groups = components(candidates, "candidates")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_counter = table.value
        for batch in batches:
            features, weights = [], []
            for h, count in shingles(batch.column(2).to_pylist()):
                w = by_counter[_counters(h)]
                if count.max() > 1:  # the k-th occurrence is a feature of its own, so that sharing means the smaller count
                    at = np.repeat(np.arange(len(h)), count)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                    h, w = np.where(nth > 0, _mix(h[at] + nth.astype(np.uint64) * _PRIME), h[at]), w[at]
                    order = np.argsort(h, kind="stable")
                    h, w = h[order], w[order]
                features.append(h.tobytes())
                weights.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary()), pa.array(weights, pa.binary()), pa.array([len(w) for w in weights], pa.int64())], names=["root", "key", "features", "weights", "n"])

    named = groups.select("root", F.col("node").alias("key"))
    # merged at every size: the candidates grow with the corpus, so they are never broadcast
    vectors = units.join(named.hint("shuffle_merge"), "key").select("root", "key", "text").mapInArrow(lean(vectorise), "root binary, key binary, features binary, weights binary, n long")
    vectors = materialise(vectors, "vectors")
    sizes = vectors.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    blocks = F.ceil(F.greatest(F.col("texts") / GROUP, F.col("n") / GROUP_FEATURES)).cast("long")
    large = materialise(sizes.withColumn("blocks", blocks).filter("blocks > 1").select("root", "blocks"), "large-groups")
    edges = _compare_groups(vectors.join(large, "root", "left_anti"))
    if not large.isEmpty():
        edges = edges.unionByName(_compare_large(materialise(_with_groups(vectors, large), "large-vectors")))
    return members, components(edges, "classes").select(F.col("node").alias("key"), F.col("root").alias("class"))


def _members(members: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Every row with its class; hot texts and classes meet theirs in salted shares."""
    per_text = members.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    texts = per_text.join(roots, "key", "left").withColumn("class", F.coalesce("class", "key"))
    per_class = texts.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(per_class.withColumn("salt", salts), ["class", "salt"])
    texts = texts.select("key", "class_id", "class_size").withColumn("salt", salts)
    members = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return members.join(texts, ["key", "salt"]).select(F.col("id").alias(id_col), "class_id", "class_size")


def representatives(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, columns as they were: that of its smallest id (null last), of equal ids that of the text with the smallest digest, of rows that repeat both any one."""
    inner = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*inner)
    at = dict(zip(df.columns, inner, strict=True))
    members, roots = _classes_of_texts(df, id_col, text_col)
    own = lambda key, i: F.md5(F.concat(key, F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("null")).cast("binary")))
    copies = members.groupBy("key", "id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("first")
    texts = copies.groupBy("key").agg(first).join(roots, "key", "left").select(F.coalesce("class", "key").alias("class"), "first.*")
    kept = materialise(texts.groupBy("class").agg(first).select(own(F.col("first.key"), F.col("first.id")).alias("_own"), "first.n"), "representatives")
    rows = rows.withColumn("_own", own(_key(at[text_col]), F.col(at[id_col])))
    single = rows.join(kept.filter("n = 1"), "_own", "left_semi").select(*inner)
    repeated = kept.filter("n > 1")
    if not repeated.isEmpty():
        copies = rows.join(repeated, "_own", "left_semi").groupBy("_own").agg(F.first(F.struct(*inner)).alias("row"))
        single = single.unionByName(copies.select("row.*"))
    return single.toDF(*df.columns)
