"""WARC derivatives: for each response record, a metadata and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import workers
from callweave.session import table

#: Elements whose content is no text of the page, and those that end a line.
HIDDEN = "script|style|title|noscript|template"
LINES = frozenset("p br div li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside main pre blockquote dl dt dd hr form body html".split())
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>?"""
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})(?![A-Za-z0-9-]){ATTRIBUTES}.*?(?:</\1(?![A-Za-z0-9-])[^>]*>?|\Z)|</?([A-Za-z][A-Za-z0-9-]*){ATTRIBUTES}|<[!?][^>]*>?", re.S | re.I)
TITLE = re.compile(rf"<title(?![A-Za-z0-9-]){ATTRIBUTES}(.*?)(?:</title|\Z)", re.S | re.I)
LANGUAGE = re.compile(r"""<html(?![A-Za-z0-9-])[^>]*?\slang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
LINK = re.compile(r"""<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:callweave:warc")
SENT_DATE = "2024-01-01T00:00:00Z"


def plain_text(page: str) -> str:
    """The page's visible text: a line for each block, blanks single, entities read."""
    text = html.unescape(MARKUP.sub(lambda m: "\n" if (m[2] or "").lower() in LINES else "", page))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    """The same for the same source and kind, so that a rerun gives the same records."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def metadata_block(head: str, page: str) -> str:
    """application/warc-fields: what the page says of itself, its links, and the source's header lines."""
    fields = []
    if m := TITLE.search(page):
        fields.append(("title", html.unescape(m[1])))
    if m := LANGUAGE.search(page):
        fields.append(("language", m[1]))
    fields += [("outlink", html.unescape(next(x for x in (*m.groups(), "") if x is not None))) for m in LINK.finditer(page)]
    fields += [("source-header", x) for x in head.splitlines() if x]
    return "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields)


FIELDS = ("record_id", "warc_type", "warc_date", "target_uri", "refers_to", "refers_to_date", "source_block_digest", "source_payload_digest", "content_type", "content_length", "block_digest", "block")
KINDS = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in FIELDS)


SOURCE = ("record_id", "target_uri", "warc_date", "http_head", "payload", "source_block_digest", "source_payload_digest")


def _derived(batches):
    for b in batches:
        rows = []
        for source, uri, date, head, data, block_digest, payload_digest in zip(*(b.column(c).to_pylist() for c in SOURCE), strict=True):
            page = data.decode("utf-8", "replace")
            of = (source, date, block_digest or digest(f"{head}\r\n\r\n".encode() + data), payload_digest or digest(data))
            for kind, mime, block in (("metadata", "application/warc-fields", metadata_block(head, page)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
                raw = block.encode()
                rows.append((derived_id(source, kind), kind, date, uri, *of, mime, len(raw), digest(raw), block))
        kinds = [pa.int64() if c == "content_length" else pa.string() for c in FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(FIELDS), kinds, strict=True)], list(FIELDS))


def header(name: str) -> Column:
    """A header value on one line: what holds line ends could pass for further headers."""
    return F.trim(F.regexp_replace(F.col(name).cast("string"), r"\s+", " "))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows, warc_type metadata and conversion, for each row of responses (record_id, target_uri, warc_date, http_head, payload; perhaps source_block_digest, source_payload_digest).

    refers_to and refers_to_date name the response; source_block_digest and source_payload_digest are those it came with, or
    computed from its bytes where it has none; the metadata's block repeats its header lines. payload is a string or binary, of
    which bytes that are no UTF-8 are replaced in texts, not in digests. Header values go on one line. Null heads and payloads
    count as empty; a null record_id refers to an id made from address, date and payload; null addresses and dates stay null.
    Repeated rows give repeated records, with the same ids. Extra columns are not read; an empty table gives an empty one. No
    shuffle.
    """
    own = F.coalesce(header("record_id"), record_id(F.col("target_uri"), F.col("warc_date"), F.col("payload")))
    head = F.coalesce(F.col("http_head").cast("string"), F.lit(""))
    came = lambda c: header(c) if c in responses.columns else F.lit(None).cast("string")
    cols = (own, header("target_uri"), header("warc_date"), head, F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), came(SOURCE[5]), came(SOURCE[6]))
    return workers.mapped(responses.select(*[c.alias(n) for c, n in zip(cols, SOURCE, strict=True)]), _derived, KINDS)


def record_id(*parts: Column) -> Column:
    """A urn:uuid from the parts' MD5."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def responses(pages: DataFrame, date: str = SENT_DATE) -> DataFrame:
    """pages (page_id, url, html) as response records, all sent at one date."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"))
    return pages.select(record_id(F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_head"), F.col("html").alias("payload"))


def serialized(records: DataFrame) -> DataFrame:
    """records of derivatives() with `record`: the bytes of each, which put one behind the other are a WARC file."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    names = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "warc_date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Refers-To-Date": "refers_to_date"}
    names |= {"WARC-Source-Block-Digest": "source_block_digest", "WARC-Source-Payload-Digest": "source_payload_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    return records.withColumn("record", F.concat(F.lit("WARC/1.1\r\n"), *[line(k, c) for k, c in names.items()], F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary"))


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in the bytes of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
