import base64
import hashlib

import pytest

from gaugeworks.llm import warc

ROWS = [(5, "http://a/", "<p>same"), (2, "http://b/", "<p>same"), (9, None, "<p>same"), (1, "http://c/\r\nWARC-Type: revisit", "other é"), (7, "u", None), (8, "u", ""), (None, "u", "<p>same"), (None, "n", "only null"), (3, "u", "x" * 70_000), (4, "http://d/", "twice"), (4, "http://d/", "twice")]


def brute(rows, min_bytes=0):
    first = {}
    for i, _, body in rows:
        b = (body or "").encode()
        if i is not None and len(b) >= min_bytes:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, body in rows:
        b = (body or "").encode()
        revisit = b in first and i != first[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, sha256 string")
    got = warc.round_trip(df, min_bytes=min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, min_bytes)


def test_records_are_whole_warc_records(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({r[2] or "" for r in ROWS})
    rows = warc.read_records(spark, str(tmp_path / "a"), with_bytes=True).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        head, _, block = bytes(r.record)[:-4].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) and fields["WARC-Type"] == r.record_type
        http, _, payload = block.partition(b"\r\n\r\n")
        assert f"Content-Length: {r.payload_bytes}".encode() in http
        assert payload == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))


def test_damage_fails(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    stored.selectExpr("sha256", "cast('forged' as binary) payload").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_records(spark, str(tmp_path / "b")).collect()


def test_round_trip_rebuilds_the_bytes(spark, monkeypatch):
    write = warc.write_archive

    def forged(pages, path, **options):
        write(pages, f"{path}-true", **options)
        spark.read.parquet(f"{path}-true/payloads").write.parquet(f"{path}/payloads")
        spark.read.parquet(f"{path}-true/headers").selectExpr("id", "sha256", "cast(regexp_replace(decode(header, 'UTF-8'), 'Content-Length: ([0-9]+)', 'Content-Length: 1$1') as binary) header").write.parquet(f"{path}/headers")

    monkeypatch.setattr(warc, "write_archive", forged)
    with pytest.raises(Exception, match="header names another length"):
        warc.round_trip(spark.createDataFrame(ROWS, "page_id long, url string, html string")).collect()


def test_hot_payload_is_joined_in_shares(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SHARE_ROWS", 8)
    rows = ROWS + [(100 + i, f"http://é/{i}", "hot" * 99) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    warc.write_archive(df, str(tmp_path / "a"))
    headers, copies = warc._in_shares(spark.read.parquet(str(tmp_path / "a/headers")), spark.read.parquet(str(tmp_path / "a/payloads")))
    sizes = [r["count"] for r in headers.groupBy("sha256", "share").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 24
    assert copies.count() == len({r[2] or "" for r in ROWS}) + 25


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
