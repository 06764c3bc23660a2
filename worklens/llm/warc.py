r"""WARC derivatives: metadata and plain-text conversion records of response records.

``derive`` gives each response two records. Both name the response in ``refers_to`` and keep its target
URI, date and payload digest; the metadata record's block (application/warc-fields) also keeps the source
headers, the title and the outgoing links, the conversion record's block is the page's text. Record
identifiers follow from the response's own, so a rerun writes the same ones. Digests are labelled
``sha256:`` values of the whole block.

Text: comments, scripts and styles go, block elements break lines, other tags go, character references
become characters, and white space is collapsed, in one chain of built-in functions.

Defined results: a null html counts as empty; a null url is kept as null; rows without page_id have
identifiers made of the url alone; repeated responses give repeated records; an empty table gives an
empty result; other columns are ignored; what a page opens and does not close reaches to its end.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is opened and never closed reaches to the end of the page, so every pattern reads a page once.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*(?:>|\z)"
TAGS = r"</?[A-Za-z!?][^>]*(?:>|\z)"
TITLE = r"(?is)<title\b[^>]*(?:>|\z)(.*?)(?:</title|\z)"
ANCHORS = r"(?i)(<a\b[^>]*(?:>|\z))"
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Named character references that are resolved; the ampersand's comes last.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """The readable text of a page."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BLOCKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    for name, character in NAMED:
        text = F.replace(text, F.lit(name), F.lit(character))
    text = F.regexp_replace(text, r"[ \t\r\f\x0B\xA0]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _uuid(seed: Column) -> Column:
    """A record identifier in the form of a name-based UUID."""
    h = F.md5(seed)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a pages table: page_id, record_id, target_uri, date, http_headers, payload, payload_digest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    seed = F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))
    date = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), _uuid(seed).alias("record_id"), F.col("url").alias("target_uri"), date.alias("date"), headers.alias("http_headers"), html.alias("payload"), _digest(html).alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, payload_digest (of the source), block, block_digest, content_length (bytes)."""
    payload = F.coalesce("payload", F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, TITLE, 1), r"\s+", " "))
    links = F.transform(F.regexp_extract_all(payload, F.lit(ANCHORS), F.lit(1)), lambda tag: F.regexp_extract(tag, LINK, 1))
    links = F.array_distinct(F.filter(links, lambda x: x != ""))
    fields = F.concat(
        F.lit("source-headers: "), F.regexp_replace(F.coalesce("http_headers", F.lit("")), r"\r?\n", " | "),
        F.lit("\r\npayload-digest: "), F.coalesce("payload_digest", F.lit("")), F.lit("\r\ntitle: "), title,
        F.when(F.size(links) > 0, F.concat(F.lit("\r\noutlink: "), F.array_join(links, "\r\noutlink: "))).otherwise(F.lit("")), F.lit("\r\n"),
    )
    record = lambda kind, form, block: F.struct(F.lit(kind).alias("record_type"), F.lit(form).alias("content_type"), block.alias("block"))
    made = F.explode(F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain", plain_text(payload))))
    rows = source.select("page_id", "record_id", "target_uri", "date", "payload_digest", made.alias("made"))
    return rows.select(
        "page_id", "made.record_type", _uuid(F.concat("made.record_type", F.lit(" "), "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        "made.content_type", "payload_digest", "made.block", _digest(F.col("made.block")).alias("block_digest"), F.octet_length("made.block").cast("bigint").alias("content_length"),
    )


def as_text(records: DataFrame) -> DataFrame:
    """Each record in the WARC/1.1 form, in a column ``value`` without its last line feed."""
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = F.concat(*(field(name, F.col(c)) for name, c in names))
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), "block", F.lit("\r\n\r")).alias("value"))


def write(records: DataFrame, path: str, mode: str = "error") -> None:
    """Write the records as gzipped WARC files, one for each partition."""
    as_text(records).write.mode(mode).option("compression", "gzip").text(path)


def _parsed(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a WARC file, whether plain, gzipped as a whole, or record by record."""
    if data[:2] == b"\x1f\x8b":
        out = io.BytesIO()
        while data[:2] == b"\x1f\x8b":
            job = zlib.decompressobj(31)
            out.write(job.decompress(data) + job.flush())
            data = job.unused_data
        data = out.getvalue()
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", 0))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, (file, record_type, record_id, refers_to, target_uri, date, content_type,
    payload_digest, block_digest, block). A file is read by one task; writers keep files moderate."""
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest"]
    fields = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest", "warc-block-digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(_parsed(data))
                cols = [pa.array([file] * len(found), pa.string())]
                cols += [pa.array([h.get(f) for h, _ in found], pa.string()) for f in fields]
                cols.append(pa.array([b.decode("utf-8", "replace") for _, b in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["file", *names, "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, " + ", ".join(f"{n} string" for n in [*names, "block"]))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, as :func:`derive` takes them. Payloads that are not UTF-8 are read as
    Latin-1; the payload digest is the record's own, or that of the payload's bytes where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                for fields, block in _parsed(data):
                    if fields.get("warc-type") == "response":
                        head, _, payload = block.partition(b"\r\n\r\n")
                        try:
                            text = payload.decode("utf-8")
                        except UnicodeDecodeError:
                            text = payload.decode("latin-1")
                        digest = fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
                        rows.append((None, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("latin-1"), text, digest))
            names, cols = ["page_id", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"], list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(cols)], names=names)

    schema = "page_id long, record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


ORACLE = r"""
WITH s AS (
  SELECT page_id, url, coalesce(html, '') AS html, strftime(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS date, md5('response ' || page_id || ' ' || url) AS h FROM pages),
r AS (SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] || '>' AS refers_to,
  'sha256:' || sha256(html) AS payload_digest, list_filter(list_transform(regexp_extract_all(html, '(?i)(<a\b[^>]*(?:>|\z))', 1), lambda tag: regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)), lambda x: x <> '') AS l FROM s),
b AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-headers: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || strlen(html) || chr(13) || chr(10) || 'payload-digest: ' || payload_digest || chr(13) || chr(10) || 'title: '
    || trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*(?:>|\z)(.*?)(?:</title|\z)', 1), '\s+', ' ', 'g'))
    || CASE WHEN len(l) > 0 THEN chr(13) || chr(10) || 'outlink: ' || array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(13) || chr(10) || 'outlink: ') ELSE '' END || chr(13) || chr(10) AS block FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain', trim(regexp_replace(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', '', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*(?:>|\z)', chr(10), 'g'),
      '</?[A-Za-z!?][^>]*(?:>|\z)', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&'),
    '[ \t\r\f\x0B\x{A0}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) FROM r),
m AS (SELECT *, md5(record_type || ' ' || refers_to) AS g FROM b)
SELECT page_id, record_type, '<urn:uuid:' || g[1:8] || '-' || g[9:12] || '-3' || g[14:16] || '-8' || g[18:20] || '-' || g[21:32] || '>' AS record_id, refers_to, url AS target_uri, date,
  content_type, payload_digest, block, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM m
"""
