"""WARC archives of pages in which a payload is stored once and revisited by its other captures.

Headers (id, address, digest, length), never payloads, are shuffled by payload digest to find each payload's first capture; revisit
records are joined to it. Payloads move once, by page id, to meet their decision, and are written by Spark's text
writer: each row is a record and the row end is the two line ends that close a record. Reading goes by Content-Length, one
file at a time; ``records_per_archive`` and ``archive_bytes`` bound a file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, record_id string, refers_to_record string, digest string, payload_bytes long, payload binary"


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit(""))


def join_with_hot_keys(rows: DataFrame, lookup: DataFrame, key: str, count: str, spread: str, most: int = 1000) -> DataFrame:
    """Left join to one row per key, where ``count`` in ``lookup`` is the number of rows of the key.

    Keys with more than a ``most``-th of all counted rows are fewer than ``most``, so they are broadcast; their rows go past the shuffle of
    the others dealt by ``spread``.
    """
    total = lookup.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    value = [c for c in lookup.columns if c not in (key, count)]
    hot = lookup.where(F.col(count) * most > total).select(F.col(key), F.struct(*value).alias("__hot"))
    rest = lookup.where(F.col(count) * most <= total).select(F.col(key).alias("__key"), F.struct(*value).alias("__rest"))
    met = rows.join(F.broadcast(hot), key, "left")
    by = F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), F.concat(F.lit("#"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key))
    met = met.withColumn("__by", by).join(rest, F.col("__by") == F.col("__key"), "left")
    found = F.coalesce("__hot", "__rest")
    return met.select(*rows.columns, *[found[c].alias(c) for c in value])


def record_id(page_id: Column, digest: Column) -> Column:
    """Name of a record, a UUID made from the page and its payload."""
    h = F.md5(F.concat_ws("-", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolved(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100) -> DataFrame:
    """Revisits: ``page_id``, ``digest`` and their original (``refers_to``, ``refers_url``), from headers only.

    Of equal payloads of ``least_bytes`` or more the smallest id is the original, in each of its rows; rows with a null id are
    neither originals nor revisits.
    """
    body = _payload(html)
    heads = pages.where(F.octet_length(body) >= least_bytes).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.sha2(body, 256).alias("digest")).where("page_id IS NOT NULL")
    heads = materialise(heads, "heads")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("_n")).where("_n > 1")
    joined = join_with_hot_keys(heads, materialise(first, "originals"), "digest", "_n", "page_id")
    return joined.where("page_id > refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct()


def _line(name: str, value: Column) -> Column:
    """A header line, left out if the value is null; line breaks in values are percent-encoded."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 100) -> DataFrame:
    """``record``: each page as a WARC record without the line ends that close it."""
    revisits = resolved(pages, page_id, url, html, least_bytes).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", "refers_url")
    body = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), _payload(html).alias("body")).withColumn("digest", F.sha2("body", 256))
    met = body.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("body").cast("string"), F.lit(END + END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, record_id(F.col("refers_to"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("refers_url"))),
        _line("WARC-Refers-To-Date", F.when(again, F.lit(date))),
        _line("X-Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(END),
    )
    return met.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_archive: int = 2000, archive_bytes: int = 1 << 29, html: str = "html", **options) -> None:
    """Write ``pages`` as gzipped WARC files below ``path``, on any file system that Spark writes to.

    A null html is an empty payload; a null url leaves its header out; of one id all rows are written; other columns take no part, whatever their names. A file holds at most
    ``records_per_archive`` records, and so few that it stays below ``archive_bytes`` (before compression) even if all are as long as the longest; a single record may be longer.
    """
    longest = pages.agg(F.coalesce(F.max(F.octet_length(_payload(html))), F.lit(0)).alias("n")).first()["n"]
    records_per_archive = max(1, min(records_per_archive, archive_bytes // (longest + 4096)))
    records(pages, html=html, **options).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def parse(content: bytes, with_payload: bool) -> Iterator[tuple]:
    """Records of one archive, by Content-Length. A digest that does not fit its payload is an error."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(content))
            content = member.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode().split(END)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        kind = fields["WARC-Type"]
        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        payload = None
        if kind == "response":
            payload = content[content.index(b"\r\n\r\n", begin, end) + 4 : end]
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
        page = fields.get("X-Page-ID")
        yield (int(page) if page is not None else None, fields.get("WARC-Target-URI"), kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), digest, None if payload is None else len(payload), payload if with_payload else None)
        at = end + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``; ``payload`` and its length are null for revisits."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = pd.DataFrame(list(parse(bytes(content), with_payload)), columns=names)
                for c in ("page_id", "payload_bytes"):
                    rows[c] = rows[c].astype("Int64")
                yield rows

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest`` and ``payload_bytes``; revisits get them from their original."""
    # Written out, so that archives are read once.
    heads = materialise(found.select("page_id", "url", "record_type", "record_id", "refers_to_record", "digest", "payload_bytes"), "records")
    visits = heads.where("record_type = 'revisit'").groupBy("refers_to_record").agg(F.count("*").alias("_n"))
    originals = heads.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("_bytes"), F.first("digest").alias("_digest"))
    lookup = visits.join(originals, visits["refers_to_record"] == originals["record_id"]).drop("record_id")
    joined = join_with_hot_keys(heads, materialise(lookup, "originals"), "refers_to_record", "_n", "page_id")
    return joined.select("page_id", "url", "record_type", "refers_to", F.coalesce("_digest", "digest").alias("payload_digest"), F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"))


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
