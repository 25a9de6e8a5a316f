"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256. Record headers are stored apart, byte for byte, with the digest of
their payload. Original records come back by a join; every payload that is read is verified against its digest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofrecon.llm.common import cut

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record carries no date of its own here; a fixed one keeps archives equal from run to run.
DATE = "2020-01-01T00:00:00Z"
_HEADER = r"(?m)^{}: ([^\r\n]*)"


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, *, least: int = 0) -> None:
    """Store ``pages`` (page_id, url, html): ``path``/payloads and ``path``/headers, a record per row.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of at least ``least`` bytes that
    with the smallest page_id (null last) is the response and the others revisit it; rows that repeat that page_id are
    responses, too. A smaller payload is a response always. A null url is written as an empty target URI.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"))
    meta = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("size"))
    # only payloads of several records are listed, so that where few repeat no page is shuffled
    copied = meta.groupBy("sha256").agg(F.min("page_id").alias("owner"), F.count("*").alias("records"), F.first("size").alias("size"))
    copied = cut(copied.where("records > 1").drop("records"))
    keyed = meta.join(copied.where(F.col("size") >= least).select("sha256", "owner"), "sha256", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    crlf = F.lit("\r\n")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, crlf)
    http = F.concat(F.lit("HTTP/1.1 200 OK"), crlf, F.lit("Content-Type: text/html; charset=utf-8"), crlf, line("Content-Length", F.col("size").cast("string")), crlf)
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    record = F.concat(
        F.lit(VERSION),
        crlf,
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("owner")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha256"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        crlf,
    )
    headers = keyed.select("page_id", "sha256", record.cast("binary").alias("record_header"), http.cast("binary").alias("http_header"), F.when(revisit, F.col("owner")).alias("owner"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    # each payload comes from the rows of its smallest page_id; a payload that only rows without page_id have, from those
    owns = F.col("page_id").eqNullSafe(F.col("first"))
    written = pages.sparkSession.read.schema("page_id long, sha256 string").parquet(f"{path}/headers")
    listed = cut(written.join(copied.select("sha256", F.col("owner").alias("first")), "sha256").select("page_id", "sha256", owns.alias("owns")))
    others = listed.where("not owns").select(F.col("page_id").alias("_id"), F.col("sha256").alias("_sha"))
    stored = rows.withColumn("sha256", F.sha2("payload", 256))
    stored = stored.join(others, stored["page_id"].eqNullSafe(others["_id"]) & (stored["sha256"] == others["_sha"]), "left_anti")
    stored = stored.select("sha256", "payload")
    if not listed.where("owns").groupBy("sha256").count().where("count > 1").isEmpty():  # rows that repeat an owner
        stored = stored.dropDuplicates(["sha256"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, owner, the exact header bytes, and what they say: record_type, record_id, target_uri, refers_to_id, sha256."""
    rows = spark.read.schema("page_id long, sha256 string, record_header binary, http_header binary, owner long").parquet(f"{path}/headers")
    text = F.col("record_header").cast("string")
    said = lambda name: F.regexp_extract(text, _HEADER.format(name), 1)
    return rows.select(
        "page_id",
        "owner",
        "record_header",
        "http_header",
        said("WARC-Type").alias("record_type"),
        said("WARC-Record-ID").alias("record_id"),
        said("WARC-Target-URI").alias("target_uri"),
        F.nullif(said("WARC-Refers-To"), F.lit("")).alias("refers_to_id"),
        F.substring(said("WARC-Payload-Digest"), 8, 64).alias("sha256"),
    )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What whole records say: type, id, the id referred to, the payload's digest as the header has it, and of a response
    the payload's length and base32 SHA-1, computed from its verified bytes."""
    for batch in batches:
        rows = []
        for record in batch.column("record").to_pylist():
            head, _, block = record[:-4].partition(b"\r\n\r\n")
            said = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            payload, key = block.partition(b"\r\n\r\n")[2], said["WARC-Payload-Digest"].removeprefix("sha256:")
            if len(block) != int(said["Content-Length"]):
                raise ValueError(f"record {said['WARC-Record-ID']} has another length than it says")
            full = said["WARC-Type"] == "response"
            if full and hashlib.sha256(payload).hexdigest() != key:
                raise ValueError(f"payload {key} is damaged")
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else None
            rows.append((said["WARC-Type"], said["WARC-Record-ID"], said.get("WARC-Refers-To"), key, len(payload) if full else None, digest))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
        names = ["record_type", "record_id", "refers_to_id", "sha256", "payload_bytes", "payload_digest"]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", *names])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archive: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id).

    All of it is parsed from reconstructed records; a revisit takes its payload's length and digest from the response
    that its WARC-Refers-To names.
    """
    schema = "page_id long, record_type string, record_id string, refers_to_id string, sha256 string, payload_bytes long, payload_digest string"
    records = cut(reconstruct(spark, path).mapInArrow(_parsed, schema))
    full, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    # rows that repeat a page_id share a record id; with the digest it tells payloads apart
    named = full.groupBy(F.col("record_id").alias("refers_to_id"), "sha256").agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    followed = revisits.drop("payload_bytes", "payload_digest").join(named, ["refers_to_id", "sha256"])
    return full.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(followed.select(names))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id and ``record``, its original bytes (header, HTTP header, payload unless it revisits, two line ends)."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    headers = read_headers(spark, path)
    full = headers.where("record_type <> 'revisit'").join(stored.select("sha256", checked.alias("payload")), "sha256")
    rows = full.unionByName(headers.where("record_type = 'revisit'").withColumn("payload", F.lit(b"")))  # a revisit carries none
    return rows.select("page_id", F.concat("record_header", "http_header", "payload", F.lit(b"\r\n\r\n")).alias("record"))
