"""WARC derivative builder: from response records to linked metadata and plain-text conversion records.

A record is a row: ids, type, target, date, digests, and its block. For each response one metadata record (what the page
says of itself, its links, and the source's headers) and one conversion record (its plain text) are made; both refer to
the response by its id, target and date and carry the digest of the payload they come from. Nothing is shuffled. Ids are
derived from what a record holds, so a repeated task makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import batches, small_batches

#: Date of responses that come without one, so that results repeat.
UNDATED = "1970-01-01T00:00:00Z"
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

# Every pattern here, once begun, matches up to a mark or to the end of the page, so none is tried over the same text twice.
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|main|aside|title|head|body|html|blockquote|pre|form|dl|dt|dd|figure|figcaption|hr|option|td|th)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*(?:>|\Z)(.*?)(?:</title|\Z)", re.S | re.I)
# These look at one tag, from its start.
_LANG = re.compile(r"<html\b.*?\blang\s*=\s*[\"']?([A-Za-z-]{1,35})", re.S | re.I)
_CHARSET = re.compile(r"<meta\b.*?\bcharset\s*=\s*[\"']?([\w-]{1,40})", re.S | re.I)
_LINK = re.compile(r"<a\b.*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.S | re.I)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" *\n[ \n]*")


def plain_text(page: str) -> str:
    """Text of a page: without comments, scripts and tags, blocks on lines of their own, entities resolved."""
    page = _SKIP.sub(" ", page)
    page = _TAG.sub("", _BREAK.sub("\n", page.replace("\n", " ")))
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(page))).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(31).join(parts).encode()).digest()[:16], version=5)}>"


def _flat(s: str) -> str:
    return " ".join(html.unescape(s).split())


def describe(page: str) -> list[tuple[str, str]]:
    """The fields of a metadata block that come from the page itself: its title, the first language and character set
    that its tags declare, and the address of each link; comments and scripts are left out but for the title's page."""
    langs, charsets, links = [], [], []
    for tag in _TAG.findall(_SKIP.sub(" ", page)):
        name = tag[1:5].lower()
        if name == "html" and not langs:
            langs += [m[1] for m in [_LANG.match(tag)] if m]
        elif name == "meta" and not charsets:
            charsets += [m[1] for m in [_CHARSET.match(tag)] if m]
        elif name[:1] == "a" and (m := _LINK.match(tag)):
            links.append(_flat(m[1] or m[2] or m[3] or ""))
    titles = [_flat(m[1]) for m in [_TITLE.search(page)] if m]
    return [("title", t) for t in titles] + [("languages-declared", t) for t in langs] + [("charset-declared", t) for t in charsets] + [("outlink", f"{a} L a/@href") for a in links]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, headers: Column | None = None) -> DataFrame:
    """Response records of crawled pages: id_col, record_id, target_uri, date, http_headers, payload.

    Null url or html counts as empty. record_id depends on id, url, date and payload; headers default to a plain 200.
    """
    url, page = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (url_col, html_col))
    when = F.coalesce(date, F.lit(UNDATED)) if date is not None else F.lit(UNDATED)
    raw = F.md5(F.concat_ws("\x1f", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, when, F.sha1(page.cast("binary"))))
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    plain = F.concat(F.lit(HEADERS.split("{}")[0]), F.octet_length(page).cast("string"), F.lit(HEADERS.split("{}")[1]))
    return pages.select(F.col(id_col), urn.alias("record_id"), url.alias("target_uri"), when.alias("date"), (F.coalesce(headers, plain) if headers is not None else plain).alias("http_headers"), page.alias("payload"))


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two records for each response, a metadata and a conversion record: id_col, record_id, record_type, refers_to (the
    response's record id), refers_to_target_uri, refers_to_date, date, content_type, block, block_digest, payload_digest,
    content_length.

    An empty payload gives an empty conversion; a response with a null column is read as if that were empty; repeated
    responses give repeated records with equal ids; other columns are not read; an empty table gives no records. Payloads
    are read whole, in time linear in their length.
    """
    kind = records.schema[id_col].dataType
    names = ["record_id", "record_type", "refers_to", "refers_to_target_uri", "refers_to_date", "date", "content_type", "block", "block_digest", "payload_digest", "content_length"]
    types = [pa.string()] * 10 + [pa.int64()]
    schema = pa.schema([(id_col, to_arrow_type(kind)), *zip(names, types)])
    empty = F.lit("")
    source = small_batches(records).select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("record_id", "target_uri", "date", "http_headers", "payload")])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in stream:
                for key, rid, uri, when, headers, page in zip(*(c.to_pylist() for c in b.columns)):
                    source_digest = digest(page.encode())
                    status, *fields = headers.strip().split("\r\n")
                    described = [("source-http-status", status), *(("source-http-header", f) for f in fields), ("source-payload-digest", source_digest), *describe(page)]
                    blocks = (
                        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in described if v)),
                        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
                    )
                    for what, mime, block in blocks:
                        data = block.encode()
                        yield key, record_id(what, rid, source_digest), what, rid, uri, when, when, mime, block, digest(data), source_digest, len(data)

        return batches(rows(), schema, lambda r: 400 + len(r[8]))

    return source.mapInArrow(run, f"{id_col} {kind.simpleString()}, " + ", ".join(f"{n} {'long' if n == 'content_length' else 'string'}" for n in names))


def _one_line(c: Column) -> Column:
    """A header's value on one line: controls would end or fake a header."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " ")


def serialized(derived: DataFrame) -> DataFrame:
    """A column `record`: each derived record as written in a WARC/1.1 file, without the two line ends after it."""
    def header(name: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(f"{name}: "), _one_line(c), F.lit("\r\n"))).otherwise(F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Date", F.col("date")),
        header("WARC-Target-URI", F.col("refers_to_target_uri")), header("WARC-Refers-To", F.col("refers_to")), header("WARC-Refers-To-Target-URI", F.col("refers_to_target_uri")),
        header("WARC-Refers-To-Date", F.col("refers_to_date")), header("WARC-Block-Digest", F.col("block_digest")), header("Content-Type", F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n")),
    )
    return derived.select(F.concat(head, F.col("block")).alias("record"))


def write_warc(derived: DataFrame, path: str) -> None:
    """WARC files under path, one per task, gzipped, by Spark's own committer (so a lost task leaves none behind)."""
    serialized(derived).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *fields = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(f.split(": ", 1) for f in fields)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
