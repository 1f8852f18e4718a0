"""BPE encoding and decoding by tree concatenation.

A text of over ``LEAF_CHARS`` is cut, wherever that falls, into leaves of so many
characters, which separate tasks encode in parallel. Neighbouring encodings are
then joined pairwise up a tree, ``FAN`` nodes to a task and level. At each join a
window of both sides' text grows until both sides agree, and only what lies
between the places where they do is encoded again.

Agreement, in text: the pre-tokenizer always cuts after a letter before another
character, after a digit before another character, and after any visible
character before a blank or a digit that isn't of its kind. Whatever stands
around such a place, what is left of it and what is right of it are encoded
independently, so a side's own tokens hold up to there (unless a special token
lies across it).

Agreement, in a run that the pre-tokenizer leaves unsplit: a byte-pair encoding
is canonical exactly if every two neighbouring tokens encode, as a pair, to
themselves. A window of tokens agrees with a side if it ends in the side's own
token there, or if that pair test holds across the seam.

Defined results: null text counts as empty and gives no tokens; repeated rows
each give their row; an empty table gives an empty table; only the id columns
and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, text_or_empty

#: Longer texts are encoded as a tree of leaves of so many characters.
LEAF_CHARS = 8192
#: Nodes that a task joins, pair by pair, into one of the next level.
FAN = 64
#: Between two places of agreement, so many characters are encoded again as they are; longer stretches piece by piece.
STRETCH = 1024
#: Texts whose tokens a worker holds at a time.
SLICE = 256

#: Fixed value: the pattern by which byte-level BPE cuts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Places where every text is cut, whatever stands around them.
CUTS = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})"


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies print visible Latin-1 bytes as themselves and the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder for one byte-level BPE definition in the tokenizers JSON format."""

    def __init__(self, definition: bytes):
        import numpy as np
        import regex
        import tiktoken

        spec = json.loads(definition)
        alphabet = _byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = {to_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if vocab[to_bytes(left) + to_bytes(right)] != 256 + n:
                raise ValueError("token ids don't follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=self.special)
        self.decimal = [str(i) for i in range(self.core.n_vocab)]
        self.length = np.array([len(self.core.decode_single_token_bytes(i)) if i in ids else 0 for ids in [{*vocab.values(), *self.special.values()}] for i in range(self.core.n_vocab)])
        self.width = "<u2" if self.core.n_vocab <= 1 << 16 else "<u4"
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._margin = max(map(len, self.special), default=0)
        self._cuts, self._pieces = regex.compile(CUTS), regex.compile(PATTERN)

    def encode(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def piece(self, data: bytes) -> list[int]:
        """Merges over one unsplit run."""
        return self.core._encode_single_piece(data)

    def decode(self, ids: Sequence[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", "replace")

    def bytes_of(self, ids: Sequence[int]) -> bytes:
        return self.core.decode_bytes(ids)

    def pieces(self, text: str) -> list[str]:
        return self._pieces.findall(text)

    def _agree(self, left: int, right: int) -> bool:
        return self.piece(self.bytes_of([left, right])) == [left, right]

    def join(self, a: list[int], b: list[int], window: int = 8) -> list[int]:
        """The encoding of the concatenated bytes of two encodings of one run."""
        if not a or not b:
            return a + b
        while True:
            i, j = max(0, len(a) - window), min(len(b), window)
            middle = self.piece(self.bytes_of(a[i:] + b[:j]))
            left = i == 0 or middle[0] == a[i] or self._agree(a[i - 1], middle[0])
            right = j == len(b) or middle[-1] == b[j - 1] or self._agree(middle[-1], b[j])
            if left and right:
                return a[:i] + middle + b[j:]
            window *= 2

    def packed(self, ids) -> bytes:
        import numpy as np

        return np.asarray(ids, self.width).tobytes()

    def unpacked(self, data: bytes):
        import numpy as np

        return np.frombuffer(data, self.width).astype(np.int32)

    def _places(self, text: str, seam: int, first: bool, last: bool) -> tuple[int | None, int | None]:
        """The last place of agreement up to the seam and the first one from it on; first, last: the text begins, ends with its side."""

        def holds(p: int) -> bool:
            m = self._margin
            if (p < m and not first) or (len(text) - p < m and not last):
                return False  # a special token might lie across it and reach out of the window
            return not m or not any(found.start() < p < found.end() for found in self._special.finditer(text, max(0, p - m + 1), p + m - 1))

        left, right = 0 if first else None, None
        for found in self._cuts.finditer(text):
            p = found.start()
            if p <= seam and (left is None or p > left) and holds(p):
                left = p
            if p >= seam and holds(p):
                right = p
                break
        return left, len(text) if right is None and last else right

    def join_texts(self, a, b):
        """a, b: ids of two texts, as arrays. Those of the text of both."""
        import numpy as np

        if not len(a) or not len(b):
            return np.concatenate([a, b])
        window = 16
        while True:
            i, j = max(0, len(a) - window), min(len(b), window)
            # a token may begin or end within a character; at the seam none does
            before, after = (self.bytes_of(x.tolist()).decode("utf-8", "ignore") for x in (a[i:], b[:j]))
            left, right = self._places(before + after, len(before), i == 0, j == len(b))
            if left is not None and right is not None:
                break
            window *= 2
        before, after = before[left:], after[: right - len(before)]
        i = len(a) - self._tokens(a[::-1], len(before.encode()))
        j = self._tokens(b, len(after.encode()))
        return np.concatenate([a[:i], self._between(before, after, a[i:].tolist(), b[:j].tolist()), b[j:]])

    def _tokens(self, ids, size: int) -> int:
        """How many of the first ids make up so many bytes."""
        import numpy as np

        if not size:
            return 0
        found = np.cumsum(self.length[ids[:size]])
        n = int(np.searchsorted(found, size)) + 1
        if n > len(found) or found[n - 1] != size:
            raise ValueError("a token lies across a place where text is always cut")
        return n

    def _between(self, before: str, after: str, a: list[int], b: list[int]):
        """The ids of before + after, given those of either."""
        import numpy as np

        if not before or not after:
            return np.array(a + b, np.int32)
        text = before + after
        if len(text) <= STRETCH or self._special and self._special.search(text):
            return np.array(self.encode(text), np.int32)
        whole, own, other = self.pieces(text), self.pieces(before), self.pieces(after)
        k = m = 0
        while k < len(own) and whole[k] == own[k]:
            k += 1
        while m < min(len(other), len(whole) - k) and whole[-1 - m] == other[-1 - m]:
            m += 1
        i = self._tokens(np.array(a), len("".join(whole[:k]).encode()))
        j = len(b) - self._tokens(np.array(b[::-1]), len("".join(whole[len(whole) - m :]).encode()))
        if len(own) - k == len(other) - m == len(whole) - k - m == 1:  # one run goes on across the seam
            middle = self.join(a[i:], b[:j])
        else:
            middle = [t for piece in whole[k : len(whole) - m] for t in self.piece(piece.encode())]
        return np.array(a[:i] + middle + b[j:], np.int32)

    def join_all(self, nodes: list):
        """Balanced tree of joins over the ids of successive texts."""
        import numpy as np

        while len(nodes) > 1:
            nodes = [self.join_texts(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else np.empty(0, np.int32)


_codecs: dict[str, Codec] = {}


def _codec(definition) -> Codec:
    """definition: broadcast bytes of the JSON file, parsed once a worker."""
    key = hashlib.sha256(definition.value).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(definition.value)
    return _codecs[key]


def _result(codec: Codec, ids: list[int], outputs: bool) -> dict:
    listed = ",".join(map(codec.decimal.__getitem__, ids))
    decoded = codec.decode(ids)
    row = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
    if outputs:
        import numpy as np

        row |= {"ids": np.asarray(ids, np.int32), "decoded": decoded}
    return row


def _out_schema(df: DataFrame, id_cols: Sequence[str], outputs: bool) -> T.StructType:
    fields = [df.schema[c] for c in id_cols]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if outputs:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return T.StructType(fields)


def _batch(schema: pa.Schema, ids: pa.RecordBatch | pa.Table, rows: list[dict], names: Sequence[str]) -> pa.RecordBatch:
    arrays = [ids.column(i).combine_chunks() if isinstance(ids, pa.Table) else ids.column(i) for i in range(len(names))]
    arrays += [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[len(names) :]]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode_decode(df: DataFrame, id_cols: Sequence[str], text_col: str, tokenizer: str, *, outputs: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per input row: the id columns, n_tokens, ids_sha256, decoded_sha256 and, with ``outputs``, ids and decoded.

    tokenizer: path of a byte-level BPE definition in the tokenizers JSON format, read by the driver.
    """
    spark, id_cols = df.sparkSession, list(id_cols)
    with open(tokenizer, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())
    schema = _out_schema(df, id_cols, outputs)
    arrow = _arrow(schema)
    rows = df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)], text_or_empty(text_col).alias("_text"))
    long = F.length("_text") > leaf_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(definition)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [_result(codec, codec.encode(t), outputs) for t in part.column(len(id_cols)).to_pylist()]
                yield _batch(arrow, part, found, id_cols)

    short = rows.filter(~long).mapInArrow(lean(whole), schema)
    # written, so that a text keeps its number whatever is computed again
    held = materialise(rows.filter(long).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    longest = held.agg(F.max(F.length("_text"))).first()[0]
    return short if longest is None else short.unionByName(_encode_tree(held, len(id_cols), definition, schema, outputs, leaf_chars, longest))


def _encode_tree(rows: DataFrame, n_ids: int, definition, schema: T.StructType, outputs: bool, leaf_chars: int, longest: int) -> DataFrame:
    """Texts by how many levels their trees have, so that none passes a level it doesn't need."""
    levels, span = [], leaf_chars
    while not levels or span < longest:
        low, span = span, span * FAN
        texts = rows.filter((F.length("_text") > low) & (F.length("_text") <= span))
        levels.append(_encode_levels(texts, n_ids, definition, schema, outputs, leaf_chars, len(levels) + 1))
    return reduce(DataFrame.unionByName, levels)


def _encode_levels(rows: DataFrame, n_ids: int, definition, schema: T.StructType, outputs: bool, leaf_chars: int, levels: int) -> DataFrame:
    """Leaves of a text go to many tasks; their encodings meet again level by level."""
    arrow = _arrow(schema)
    ids_fields = rows.schema.fields[:n_ids]
    at_node = [*ids_fields, T.StructField("_row", T.LongType()), T.StructField("_node", T.LongType())]
    leaf, node = T.StructType([*at_node, T.StructField("_text", T.StringType())]), T.StructType([*at_node, T.StructField("_ids", T.BinaryType())])
    leaf_arrow, node_arrow = _arrow(leaf), _arrow(node)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column(n_ids)[r].as_py()
                for low in range(0, len(text), leaf_chars * 256):
                    leaves = [text[at : at + leaf_chars] for at in range(low, min(low + leaf_chars * 256, len(text)), leaf_chars)]
                    same = [0] * len(leaves)
                    held = batch.slice(r, 1).take(pa.array(same))
                    nodes = pa.array(range(low // leaf_chars, low // leaf_chars + len(leaves)), pa.int64())
                    yield pa.RecordBatch.from_arrays([*held.columns[:n_ids], held.column(n_ids + 1), nodes, pa.array(leaves, leaf_arrow.field(n_ids + 2).type)], names=leaf.names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(definition)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                coded = [codec.packed(codec.encode(t)) for t in part.column(n_ids + 2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(coded, pa.binary())], names=node.names)

    def joined(table: pa.Table):
        codec = _codec(definition)
        return codec.join_all([codec.unpacked(x.as_py()) for x in table.sort_by("_node").column("_ids")])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        ids = _codec(definition).packed(joined(table))
        columns = [c.combine_chunks() for c in table.slice(0, 1).columns[: n_ids + 1]]
        return pa.table([*columns, pa.array([key[1].as_py()]), pa.array([ids], pa.binary())], names=node_arrow.names)

    def finish(table: pa.Table) -> pa.Table:
        result = _result(_codec(definition), joined(table).tolist(), outputs)
        return pa.Table.from_batches([_batch(arrow, table.slice(0, 1), [result], arrow.names[:n_ids])])

    parts = rows.mapInArrow(lean(cut), leaf).repartition("_row", "_node").mapInArrow(lean(encode), node)
    for _ in range(levels - 1):
        parts = parts.groupBy("_row", F.floor(F.col("_node") / FAN).alias("_up")).applyInArrow(join, node)
    return parts.groupBy("_row").applyInArrow(finish, schema)
