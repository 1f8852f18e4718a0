"""Content-addressed WARC archive.

Two tables hold an archive: ``payloads`` has every distinct payload once under
its SHA-256, and ``headers`` has the exact header bytes of every record with
the SHA-256 of its payload. A record is its header, its HTTP header and its
payload again, joined by digest. Reading verifies each stored payload once
against its key and recomputes the digest that the headers carry. ``round_trip``
rebuilds every record's bytes and takes its columns from them.

Equal payloads: the smallest id is the ``response``; the others are ``revisit``
records that name it in WARC-Refers-To. Payloads below ``min_bytes`` are always
responses.

Defined results: a null payload is an empty payload; a null id sorts after all
others (a group of null ids only has responses only); rows that repeat both id
and payload repeat the same record; a null url is an empty target, and control
characters of a url are percent-encoded so that they can't end a header line;
an empty table makes an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, utf8

#: Groups of equal payloads meet their rows in so many salted shares.
SALTS = 16
#: Records that one copy of a payload's bytes is joined to, about.
SHARE_ROWS = 64

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """RFC 4648 base32 of SHA-1: five hex digits at a time are four base32 digits."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _http(n: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), n.cast("string"), F.lit(EOL * 2))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``path``/payloads and ``path``/headers."""
    payload = utf8(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    facts = rows.select("id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))

    groups = facts.filter(F.col("n") >= min_bytes).groupBy("sha256").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    groups = groups.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    facts = facts.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    facts = facts.join(groups, ["sha256", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    url = F.col("url")
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    safe = F.when(F.col("url").rlike(r"[\x00-\x1F\x7F]"), url).otherwise(F.col("url"))
    http = _http(F.col("n"))
    header = F.concat(
        F.lit(f"{VERSION}{EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{EOL}WARC-Record-ID: "), _record_id(F.col("id")),
        F.lit(f"{EOL}WARC-Target-URI: "), safe,
        F.lit(f"{EOL}WARC-Date: {date}{EOL}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), _record_id(F.col("first")))).otherwise(""),
        F.lit(f"{EOL}Content-Type: application/http;msgtype=response{EOL}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string"), F.lit(EOL * 2), http,
    )
    facts.select("id", "sha256", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads, each verified against its key; a mismatch fails the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    found = F.sha2("payload", 256)
    checked = F.when(found == F.col("sha256"), found).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("sha256"))))
    return stored.select(checked.alias("sha256"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def _in_shares(headers: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a ``share``: a payload of many records is copied once for about SHARE_ROWS of them, all others stay whole."""
    rows = headers.groupBy("sha256").agg(F.count("*").alias("rows")).filter(F.col("rows") > SHARE_ROWS)
    hot = materialise(rows.select("sha256", F.ceil(F.col("rows") / SHARE_ROWS).cast("int").alias("shares")), "warc-hot")
    salted = hot.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    headers = headers.withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int")).join(salted, ["sha256", "salt"], "left")
    headers = headers.withColumn("share", F.coalesce(F.pmod(F.xxhash64("header", F.lit("share")), F.col("shares")).cast("int"), F.lit(0)))
    copies = payloads.join(hot, "sha256", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    return headers.drop("salt", "shares"), copies.drop("shares")


def read_records(spark: SparkSession, path: str, *, with_bytes: bool = False) -> DataFrame:
    """One row per record: id, record_type, refers_to, payload_bytes, payload_digest; with_bytes adds record and payload.

    Type, reference and digest come from the stored header bytes; the digest
    must equal the one recomputed from the stored payload. A revisit's record
    has no payload of its own, its ``payload`` is that of the response.

    with_bytes rebuilds each record first and takes all columns from its bytes:
    digest and length are those of the payload cut out of the record (of a
    revisit, of the one it refers to), and the record's Content-Length must hold.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = read_payloads(spark, path)
    field = lambda name: F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    kind = field("WARC-Type")
    if with_bytes:
        headers, payloads = _in_shares(headers, payloads.select("sha256", F.col("payload").alias("stored")))
        joined = headers.join(payloads, ["sha256", "share"]).withColumn("text", F.decode("header", "UTF-8"))
        record = F.concat("header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("stored")), F.lit(b"\r\n\r\n"))
        joined = joined.withColumn("record", record).withColumn("head", F.octet_length("header"))
        joined = joined.withColumn("text", F.decode(F.expr("substring(record, 1, head)"), "UTF-8")).withColumn("block", F.expr("substring(record, head + 1, octet_length(record) - head - 4)"))
        # the HTTP header, the rest of the text, is ASCII
        length = F.length("text") - F.instr("text", EOL * 2) - 3 + F.octet_length("block")
        stated = field("Content-Length")
        joined = joined.withColumn("payload", F.when(kind == "revisit", F.col("stored")).otherwise(F.col("block")))
        joined = joined.withColumn("payload_digest", base32_sha1(F.col("payload")))
        payload_bytes = F.when(stated == length.cast("string"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("header names another length: "), stated)))
    else:
        # a hot payload's headers meet its digest in salted shares
        payloads = payloads.drop("payload").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        headers = headers.withColumn("text", F.decode("header", "UTF-8")).withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int"))
        joined = headers.join(payloads, ["sha256", "salt"])
        payload_bytes = F.col("payload_bytes")
    named = F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"))
    out = [
        F.col("id"), payload_bytes.alias("payload_bytes"),
        F.when(named == F.col("payload_digest"), named).otherwise(F.raise_error(F.concat(F.lit("header names another digest: "), named))).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1)).alias("refers_to"),
    ]
    if with_bytes:
        out += [F.col("record"), F.col("payload")]
    return joined.select(*out)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write an archive in the shared folder, rebuild its records' bytes and read them, refers_to in the id's type."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, **options)
    id_col = options.get("id_col", "page_id")
    records = read_records(spark, path, with_bytes=True).drop("record", "payload")
    return records.withColumn("refers_to", F.col("refers_to").cast(pages.schema[id_col].dataType)).withColumnRenamed("id", id_col)
