"""MPEG transport streams as a media column.

``mux`` stores a payload as a single-program transport stream (ISO 13818-1):
a program association table, a program map table, and one elementary stream
of private data. The payload is cut into access units of ``UNIT`` bytes; each
is a PES packet with a presentation timestamp, and every ``GROUP``-th unit is a
random-access point with a clock reference, before which the tables repeat.
``demux`` finds the program through the tables, checks their CRC and all
continuity counters, reassembles the elementary packets, and returns the
payload with its timestamps and random-access points, which ``analyse`` stores
as columns beside the stream's facts.

Defined results: a null or empty text is a payload of 64 zero bytes; equal
texts give equal streams and features; repeated rows each give their row; only
the id columns and the text are read; a damaged stream raises ``TransportError``
or counts discontinuities.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, utf8

# Fixed values of the transport format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, NULL_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 0x1FFF, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # PES packets of private data, private_stream_1
CRC_POLYNOMIAL = 0x04C11DB7

#: Payload bytes of an access unit, units between random-access points, 90 kHz ticks of a unit.
UNIT, GROUP, TICKS = 4096, 8, 3600
#: Payloads are padded with zero bytes to a positive multiple of this.
BLOCK = 64


class TransportError(ValueError):
    pass


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (CRC_POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, subject: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + subject.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big") + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big"))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _timestamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E]) + (pts >> 14 & 0xFFFE | 1).to_bytes(2, "big") + ((pts & 0x7FFF) << 1 | 1).to_bytes(2, "big")


def mux(payload: bytes) -> bytes:
    packets: list[bytes] = []
    counter = tables = 0
    start, rest = bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 0xFF]), bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF])
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data, pts, field_ = payload[at : at + UNIT], unit * TICKS, b""
        if unit % GROUP == 0:
            packets += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
            field_ = b"\x50" + ((pts & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")  # random access, clock reference
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + data
        done = 0
        while done < len(pes):
            head = rest if done else start
            room = PACKET - 4 - (1 + len(field_) if field_ else 0)
            left = len(pes) - done
            if left >= room and not field_:
                packets.append(head + bytes([0x10 | counter]) + pes[done : done + room])
            else:
                fill = max(0, room - left)
                if field_ or fill > 1:
                    body = (field_ or b"\0") + b"\xff" * (fill if field_ else fill - 2)
                else:
                    body = b""  # one byte to fill: an adaptation field of length zero
                packets.append(head + bytes([0x30 | counter, len(body)]) + body + pes[done : done + min(room, left)])
            done += room
            counter = counter + 1 & 15
            field_ = b""
    return b"".join(packets)


@dataclass
class Stream:
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    random_access: list[tuple[int | None, int]] = field(default_factory=list)  # (timestamp, packet)
    packets: int = 0
    discontinuities: int = 0


class _Sections:
    """The sections of a PID's tables, which may share packets or run over several."""

    def __init__(self):
        self.open: bytes | None = None
        self.whole = b""  # the last packet that held whole sections only

    def lost(self) -> None:
        self.open = None

    def take(self, body: bytes, begins: bool) -> list[bytes]:
        if begins and self.open is None and body == self.whole:  # repeated tables
            return []
        found, fresh = [], self.open is None
        if begins:
            at = 1 + body[0]
            if self.open is not None:
                self.open += body[1:at]
                found += self._closed()
            self.open = body[at:]
        elif self.open is not None:
            self.open += body
        found += self._closed()
        if begins and fresh and self.open is None:
            self.whole = body
        return found

    def _closed(self) -> list[bytes]:
        found = []
        while self.open and self.open[0] != 0xFF and len(self.open) >= 3:
            length = 3 + (int.from_bytes(self.open[1:3], "big") & 0xFFF)
            if len(self.open) < length:
                return found
            section, self.open = self.open[:length], self.open[length:]
            if crc32_mpeg(section):
                raise TransportError(f"damaged table {section[0]}")
            found.append(section)
        if not self.open or self.open[0] == 0xFF:  # what follows is stuffing
            self.open = None
        return found


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | (int.from_bytes(b[1:3], "big") >> 1) << 15 | int.from_bytes(b[3:5], "big") >> 1


class _Program:
    """The first program of the association table, and its first elementary stream."""

    def __init__(self):
        self.version, self.listed = -1, {}  # of the association table: programs by section number
        self.number = self.map_pid = self.media_pid = None

    def read(self, pid: int, section: bytes) -> None:
        if not section[5] & 1:  # not in force yet
            return
        if pid == PAT_PID and section[0] == 0x00:
            version = section[5] >> 1 & 31
            if version != self.version:
                self.version, self.listed = version, {}
            entries = [section[i : i + 4] for i in range(8, len(section) - 4, 4)]
            self.listed[section[6]] = [(int.from_bytes(e[:2], "big"), int.from_bytes(e[2:], "big") & 0x1FFF) for e in entries if e[:2] != b"\0\0"]
            self.number, self.map_pid = next((p for _, ps in sorted(self.listed.items()) for p in ps), (None, None))
        elif pid == self.map_pid and section[0] == 0x02 and int.from_bytes(section[3:5], "big") == self.number:
            first = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            if first + 5 <= len(section) - 4:
                self.media_pid = int.from_bytes(section[first + 1 : first + 3], "big") & 0x1FFF


def demux(stream: bytes) -> Stream:
    """The first program's first elementary stream.

    A packet's counter follows its PID's last one, unless the packet says that it
    doesn't. One repeat of a packet is permitted and left out. Packets marked as
    damaged in transport are left out, so the next counter tells. A table cut
    short by a lost packet or the stream's end counts as a discontinuity.
    """
    if len(stream) % PACKET:
        raise TransportError("not a whole number of packets")
    out, program, parts, pes = Stream(packets=len(stream) // PACKET), _Program(), [], []
    last: dict[int, tuple[int, bytes, bool]] = {}  # by PID: counter, payload, whether it may be repeated: not after a break, when counters tell nothing
    sections: dict[int, _Sections] = {}
    random_at: int | None = None  # the packet where the open elementary packet began, if that is a random-access point

    def close() -> None:
        data = b"".join(pes)
        pes.clear()
        if data[:3] != b"\0\0\1" or len(data) < 9:
            raise TransportError("no packet start code")
        length, head = int.from_bytes(data[4:6], "big"), 9 + data[8]
        if length and len(data) != 6 + length:
            raise TransportError("elementary packet of another length")
        pts = _read_timestamp(data[9:14]) if data[7] & 0x80 else None
        if pts is not None:
            out.timestamps.append(pts)
        if random_at is not None:
            out.random_access.append((pts, random_at))
        parts.append(data[head:])

    for n, at in enumerate(range(0, len(stream), PACKET)):
        if stream[at] != SYNC:
            raise TransportError(f"no sync byte in packet {n}")
        flags, control = stream[at + 1], stream[at + 3]
        if flags & 0x80:
            continue
        pid, begins, body, marks = (flags & 0x1F) << 8 | stream[at + 2], bool(flags & 0x40), at + 4, 0
        if control & 0x20:
            size = stream[body]
            marks = stream[body + 1] if size else 0
            body += 1 + size
        if not control & 0x10 or pid == NULL_PID:
            continue
        payload, counter = stream[body : at + PACKET], control & 15
        follows = True
        if pid in last and not marks & 0x80:
            before, held, repeatable = last[pid]
            if counter == before and payload == held and repeatable:
                last[pid] = (counter, payload, False)
                continue
            follows = counter == before + 1 & 15
            if not follows:
                out.discontinuities += 1
                if pid in sections:
                    sections[pid].lost()
        last[pid] = (counter, payload, follows)
        if pid == program.media_pid:
            if begins:
                if pes:
                    close()
                random_at = n if marks & 0x40 else None
            if begins or pes:
                pes.append(payload)
        elif pid in (PAT_PID, program.map_pid):
            for section in sections.setdefault(pid, _Sections()).take(payload, begins):
                program.read(pid, section)
    if pes:
        close()
    out.discontinuities += sum(s.open is not None for s in sections.values())
    out.payload = b"".join(parts)
    return out


def padded(data: bytes) -> bytes:
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def feature(found: Stream) -> str:
    """Stream facts, then the shares of the payload's bytes in eight equal value ranges, in thousandths."""
    import numpy as np

    shares = np.bincount(np.frombuffer(found.payload, np.uint8) >> 5, minlength=8) * 1000 // max(1, len(found.payload))
    access = ",".join(f"{t}@{n}" for t, n in found.random_access)
    span = f"{found.timestamps[0]}-{found.timestamps[-1]}" if found.timestamps else "-"
    return f"packets={found.packets};units={len(found.timestamps)};pts={span};access={access};breaks={found.discontinuities};bytes={','.join(map(str, shares))}"


def store(df: DataFrame, id_cols: Sequence[str], text_col: str) -> DataFrame:
    """The id columns, n_bytes and media: the padded text as a transport stream."""
    schema = T.StructType([*[df.schema[c] for c in id_cols], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = part.column(part.num_columns - 1).to_pylist()
                arrays = [part.column(i) for i in range(len(id_cols))] + [pa.array([len(x) for x in data], pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)], utf8(text_col).alias("_data")).mapInArrow(write, schema)


def analyse(media: DataFrame, id_cols: Sequence[str], *, with_payload: bool = False) -> DataFrame:
    """Per stored stream: n_bytes, payload and media digests, features, timestamps (one an access unit that has one), random_access (timestamp and packet); with_payload adds payload."""
    fields = [*[media.schema[c] for c in id_cols], T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    point = T.StructType([T.StructField("pts", T.LongType()), T.StructField("packet", T.LongType())])
    fields += [T.StructField("timestamps", T.ArrayType(T.LongType())), T.StructField("random_access", T.ArrayType(point))]
    if with_payload:
        fields.append(T.StructField("payload", T.BinaryType()))
    schema = T.StructType(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = [[] for _ in range(len(fields) - len(id_cols) - 1)]
                for data in part.column(part.num_columns - 1).to_pylist():
                    found = demux(data)
                    p = found.payload
                    row = [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(found), found.timestamps, [{"pts": t, "packet": n} for t, n in found.random_access]]
                    if with_payload:
                        row.append(p)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                ids = [part.column(i) for i in range(len(id_cols) + 1)]
                yield pa.RecordBatch.from_arrays(ids + [pa.array(c, arrow.field(len(id_cols) + 1 + i).type) for i, c in enumerate(columns)], names=schema.names)

    return media.select(*id_cols, "n_bytes", "media").mapInArrow(read, schema)


def round_trip(df: DataFrame, id_cols: Sequence[str], text_col: str) -> DataFrame:
    """Store in the shared folder, read the stored bytes back, analyse."""
    return analyse(materialise(store(df, id_cols, text_col), "mpegts"), id_cols)
