import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import mpegts


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40_000), st.integers(0, 255))
def test_round_trip(n, seed):
    payload = mpegts.padded(random.Random(seed).randbytes(n))
    stream = mpegts.mux(payload)
    found = mpegts.demux(stream)
    assert found.payload == payload and not found.discontinuities
    assert len(stream) % 188 == 0 and set(stream[::188]) == {0x47}
    assert found.timestamps == [i * mpegts.TICKS for i in range(len(found.timestamps))]
    assert [t for t, _ in found.random_access] == found.timestamps[:: mpegts.GROUP]


def test_every_unit_length():
    for n in range(1, 800):
        data = bytes(range(256)) * 4
        assert mpegts.demux(mpegts.mux(data[:n])).payload == data[:n]


def test_damage_is_seen():
    stream = mpegts.mux(b"x" * 20_000)
    lost = stream[: 188 * 10] + stream[188 * 12 :]
    with pytest.raises(mpegts.TransportError):  # the elementary packet is short
        mpegts.demux(lost)
    table = bytearray(stream)
    table[10] ^= 1
    with pytest.raises(mpegts.TransportError):
        mpegts.demux(bytes(table))
    with pytest.raises(mpegts.TransportError):
        mpegts.demux(stream[:-1])
    with pytest.raises(mpegts.TransportError):
        mpegts.demux(b"\0" + stream[1:])
    counter = bytearray(stream)
    counter[188 * 5 + 3] ^= 7
    assert mpegts.demux(bytes(counter)).discontinuities


def packets(stream):
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def table_packets(pid, sections, counter=0):
    """Sections one after another, over as many packets as they need."""
    data, out = b"".join(sections), []
    while data or not out:
        first = not out
        room = 184 - first
        head = bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255, 0x10 | (counter + len(out)) & 15])
        out.append((head + (b"\0" if first else b"") + data[:room]).ljust(188, b"\xff"))
        data = data[room:]
    return out


def test_tables_over_several_packets():
    plain = mpegts.mux(b"payload" * 3000)
    media = [p for p in packets(plain) if (p[1] & 31) << 8 | p[2] == mpegts.MEDIA_PID]
    program = lambda n, pid: n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big")
    pat = mpegts._section(0, 1, program(0, 0x10) + b"".join(program(n, mpegts.PMT_PID) for n in range(1, 90)))
    stream = bytes([mpegts.STREAM_TYPE]) + (0xE000 | mpegts.MEDIA_PID).to_bytes(2, "big") + b"\xf0\0"
    described = lambda n: (0xE000 | mpegts.MEDIA_PID).to_bytes(2, "big") + (0xF000 | n).to_bytes(2, "big") + bytes(n)
    other = mpegts._section(2, 7, described(300) + bytes([6, 0xE0, 0x99, 0xF0, 0]))  # another program's
    pmt = mpegts._section(2, 1, described(250) + stream)
    pats, pmts = table_packets(0, [pat]), table_packets(mpegts.PMT_PID, [other, pmt])
    assert len(pats) > 1 and len(pmts) > 2
    found = mpegts.demux(b"".join(pats + pmts + media))
    assert found.payload == b"payload" * 3000 and not found.discontinuities
    assert [t for t, _ in found.random_access] == [t for t, _ in mpegts.demux(plain).random_access]
    cut = mpegts.demux(b"".join(pats + pmts[:-1]))
    assert cut.payload == b"" and cut.discontinuities == 1
    with pytest.raises(mpegts.TransportError):
        mpegts.demux(b"".join([pats[0], pats[1][:50] + b"\x55" + pats[1][51:], *pats[2:]]))


def test_permitted_repeats_flagged_breaks_and_other_packets():
    plain = mpegts.mux(b"z" * 60_000)
    all_ = packets(plain)
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    once = mpegts.demux(b"".join([*all_[:6], all_[5], null, *all_[6:]]))
    assert once.payload == b"z" * 60_000 and once.discontinuities == 0 and once.packets == len(all_) + 2
    marked = bytearray(all_[9])
    marked[1] |= 0x80  # damaged in transport
    assert mpegts.demux(b"".join([*all_[:9], bytes(marked), *all_[9:]])).payload == b"z" * 60_000
    twice = bytes(all_[5])
    three = bytearray(b"".join([*all_[:6], twice, twice, *all_[6:]]))
    with pytest.raises(mpegts.TransportError):  # the second repeat counts as content
        mpegts.demux(bytes(three))
    begin = next(i for i, p in enumerate(all_) if i > 3 and p[3] & 0x20 and p[1] & 0x40)
    turned = [bytearray(p) for p in all_]
    for p in turned[begin:]:
        if (p[1] & 31) << 8 | p[2] == mpegts.MEDIA_PID:
            p[3] = p[3] & 0xF0 | (p[3] + 5) & 15
    assert mpegts.demux(b"".join(map(bytes, turned))).discontinuities == 1
    turned[begin][5] |= 0x80
    assert mpegts.demux(b"".join(map(bytes, turned))).discontinuities == 0


def test_crc_of_a_known_value():
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_query_columns(spark):
    texts = ["", None, "a" * 64, "é" * 100, "long " * 20_000, "dup", "dup"]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in mpegts.round_trip(df, ["doc_id"], "text").collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = mpegts.padded(data)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) > 0
    assert rows[5][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    assert rows[4].timestamps == [i * mpegts.TICKS for i in range(-(-100_032 // mpegts.UNIT))] and [p.pts for p in rows[4].random_access] == rows[4].timestamps[:: mpegts.GROUP]
    with_payload = mpegts.analyse(mpegts.store(df, ["doc_id"], "text"), ["doc_id"], with_payload=True).filter("doc_id = 4").first()
    assert bytes(with_payload.payload).rstrip(b"\0") == texts[4].encode() and with_payload.timestamps[1] == mpegts.TICKS and with_payload.random_access[0].pts == 0


def test_empty_table(spark):
    assert mpegts.round_trip(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], "text").collect() == []
