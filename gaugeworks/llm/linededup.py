"""Line deduplication with a once-seen and a twice-seen Bloom filter.

A line's digest (BLAKE2b, ``DIGEST`` bytes of its whole key) stands for it.

1. A task gathers about ``FLUSH`` keys of its documents at a time. Those that two
   of the gathered documents hold are suspects already. Of all of them it sets
   ``PROBES`` bits in two sparse filters, a bit set again going into the second,
   and hands both on by segment, beside the digests seen once with their ids.
2. At a segment the partial filters come first: they are merged into the
   segment's once-seen and twice-seen filter, where a bit that two parts hold is
   twice-seen. The digests follow, and those whose bits are all twice-seen are
   suspects. The filter has no false negatives: a key of two documents has all
   its bits there. It never leaves its segment, so there is one path whatever
   its size, and no line's text moves.
3. Only suspects are shuffled by digest, which confirms repeats and finds the
   smallest document id. A frequent line is aggregated before it is shuffled,
   and its documents meet it in salted shares.
4. Documents with lines to lose meet their digests by id and are rebuilt.

The filters have ``BITS`` bits a line, counted beforehand. That 128 bits confirm
a repeat is no approximation in practice: among 10^12 lines, two different ones
of equal digest are expected less than once in 10^14 corpora.

Defined results: null or empty text is one empty line; a null doc_id stands
for a document of its own that neither loses lines nor makes others lose any;
rows with equal doc_id are one document, so a line is no repeat within them;
all lines of a key stay where its smallest doc_id is; an empty table gives an
empty table; other columns are kept by ``dedup_documents`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, text_or_empty, utf8

#: Code points that a key needs.
MIN_CHARS = 10
#: Bytes that stand for a key.
DIGEST = 16
#: Filter bits a line, bits set by a key.
BITS, PROBES = 16, 4
#: Bits of a segment, at least and at most, and segments to have before they grow.
SMALL, LARGE, SPREAD = 1 << 16, 1 << 26, 64
#: Shares in which a repeated line's documents meet it.
SALTS = 8
#: Keys that a task gathers before it hands on a partial filter and digests.
FLUSH = 1 << 20
#: Digests of a row on their way to a segment or from it.
ROW_KEYS = 1 << 15


def keys_of(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line, None if it is too short. bytes.strip and bytes.lower know ASCII only, as the key does."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars
        out.append(key if long else None)
    return out


def digest(key: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(key, digest_size=DIGEST).digest()


def filter_size(lines: int) -> tuple[int, int]:
    """Segments, and bits of each."""
    size = SMALL
    while size < LARGE and size * SPREAD < lines * BITS:
        size *= 2
    return max(1, -(-lines * BITS // size)), size


def _bits(digests, size: tuple[int, int]):
    """digests: rows of two 64-bit words. Segments, and per key PROBES bits in its segment."""
    import numpy as np

    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    segment = (a >> np.uint64(24)) % np.uint64(size[0])
    probe = (a[:, None] + b[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) >> np.uint64(11)
    return segment.astype(np.int64), (probe % np.uint64(size[1])).astype(np.int64)


def _pack(bits) -> bytes:
    import numpy as np
    import zstandard

    return zstandard.compress(np.diff(bits, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype=np.int64)


#: Kinds of rows that go to a segment, in the order in which it takes them.
FILTER, PROBE, SUSPECT = 0, 1, 2


def _gathered(ids: list, digests: list[bytes], size: tuple[int, int], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that some documents' distinct keys send to the segments; suspects that need no segment go to made-up ones."""
    import numpy as np

    d = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    _, inverse, times = np.unique(d[:, 0], return_inverse=True, return_counts=True)
    once = times[inverse] == 1
    segment, bits = _bits(d, size)
    rows: list[tuple] = []

    flat, count = np.unique((segment[:, None] * size[1] + np.sort(bits, axis=1)).ravel(), return_counts=True)
    cuts = np.flatnonzero(np.diff(flat // size[1])) + 1
    for part, n in zip(np.split(flat, cuts), np.split(count, cuts), strict=True):
        rows.append((int(part[0] // size[1]), FILTER, [], _pack(part % size[1]), _pack(part[n > 1] % size[1])))

    def listed(at, segment_of: int, kind: int) -> None:
        for i in range(0, len(at), ROW_KEYS):
            some = at[i : i + ROW_KEYS]
            rows.append((segment_of, kind, [ids[k] for k in some.tolist()], d[some].tobytes(), b""))

    order = np.flatnonzero(once)[np.argsort(segment[once], kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1):
        if len(part):
            listed(part, int(segment[part[0]]), PROBE)
    repeated = np.flatnonzero(~once)
    listed(repeated, -1 - int(d[0, 0] % np.uint64(1 << 30)), SUSPECT)
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(out)], names=out.names)


def suspects(docs: DataFrame, size: tuple[int, int], min_chars: int = MIN_CHARS) -> DataFrame:
    """docs: id, text (bytes). Rows of id, digest: every document and key that the twice-seen filter doesn't clear."""
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = docs.schema["id"].dataType
    sent = T.StructType([T.StructField("segment", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("data", T.BinaryType()), T.StructField("twice", T.BinaryType())])
    found = T.StructType([T.StructField("id", id_type), T.StructField("digest", T.BinaryType())])
    sent_arrow, found_arrow = to_arrow_schema(sent), to_arrow_schema(found)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        digests: list[bytes] = []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {digest(k) for k in keys_of(text, min_chars) if k is not None}
                ids += [i] * len(own)
                digests += own
                if len(ids) >= FLUSH:
                    yield from _gathered(ids, digests, size, sent_arrow)
                    ids, digests = [], []
        if ids:
            yield from _gathered(ids, digests, size, sent_arrow)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, once, twice = None, np.zeros(size[1], bool), np.zeros(size[1], bool)
        for batch in batches:
            segment, kind = batch.column("segment").to_pylist(), batch.column("kind").to_pylist()
            for r in range(batch.num_rows):
                data = batch.column("data")[r].as_py()
                if segment[r] != now:
                    now = segment[r]
                    once[:] = False
                    twice[:] = False
                if kind[r] == FILTER:
                    bits = _unpack(data)
                    twice[bits[once[bits]]] = True
                    twice[_unpack(batch.column("twice")[r].as_py())] = True
                    once[bits] = True
                    continue
                d = np.frombuffer(data, np.uint64).reshape(-1, 2)
                hit = np.arange(len(d)) if kind[r] == SUSPECT else np.flatnonzero(twice[_bits(d, size)[1]].all(axis=1))
                if len(hit):
                    own = batch.column("ids")[r].values.take(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([own, pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(hit), [None, pa.py_buffer(d[hit].tobytes())]).cast(pa.binary())], schema=found_arrow)

    rows = docs.filter("id is not null").select("id", "text").mapInArrow(lean(gather), sent)
    return rows.repartition("segment").sortWithinPartitions("segment", "kind").mapInArrow(lean(probe), found)


def repeats(docs: DataFrame, *, min_chars: int = MIN_CHARS, size: tuple[int, int] | None = None) -> DataFrame:
    """docs: id, text (bytes). Rows of id, digests: those of the keys whose lines the document loses."""
    if size is None:
        text = F.col("text").cast("string")
        lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
        size = filter_size(lines)
    found = materialise(suspects(docs, size, min_chars), "suspects")
    confirmed = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    # a hot line's documents meet it in salted shares
    confirmed = confirmed.select("digest", "first", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    lost = found.join(confirmed, ["digest", "salt"]).filter("id > first")
    return lost.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def _without(text: bytes, lost: list[bytes], min_chars: int) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    drop, lines = set(lost), text.split(b"\n")
    return [line for line, key in zip(lines, keys_of(text, min_chars), strict=True) if key is None or digest(key) not in drop], len(lines)


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, size: tuple[int, int] | None = None) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept (the remaining lines joined by newlines)."""
    docs = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    lost = repeats(docs, min_chars=min_chars, size=size)
    schema = T.StructType([docs.schema["id"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not gone:
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                left, n = _without(text, gone, min_chars)
                n_lines.append(n)
                n_dropped.append(n - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.join(lost, "id", "left").select("id", "text", "digests").mapInArrow(lean(rebuild), schema)


def digests(df: DataFrame, **options) -> DataFrame:
    out = dedup(df, **options)
    return out.select(F.col("id").alias(options.get("id_col", "doc_id")), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def dedup_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """The table with its repeated lines gone, its columns as they were; count_col, if there, counts the remaining code points."""
    docs = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    lost = repeats(docs, min_chars=min_chars)
    inner = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*inner)
    at = {c: inner[i] for i, c in enumerate(df.columns)}
    joined = rows.join(lost.withColumnRenamed("id", "_lost_id"), F.col(at[id_col]) == F.col("_lost_id"), "left").drop("_lost_id")
    schema = T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(inner, df.schema.fields, strict=True)])
    where = inner.index(at[text_col])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(where).to_pylist(), batch.column(len(inner)).to_pylist(), strict=True):
                texts.append(b"\n".join(_without(text.encode(), gone, min_chars)[0]).decode() if gone else text)
            arrays = [pa.array(texts, batch.schema.field(i).type) if i == where else batch.column(i) for i in range(len(inner))]
            yield pa.RecordBatch.from_arrays(arrays, names=inner)

    out = joined.mapInArrow(lean(rebuild), schema)
    if count_col in at:
        out = out.withColumn(at[count_col], F.length(text_or_empty(at[text_col])).cast(df.schema[count_col].dataType))
    return out.toDF(*df.columns)
