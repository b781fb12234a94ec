"""WARC derivatives: linked metadata and plain-text conversion records for response records.

Each response gives one ``metadata`` record (source headers, title, language and links as
application/warc-fields) and one ``conversion`` record (text/plain).  Both refer to the response
by ``WARC-Refers-To`` and keep its target URI, date and payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.llm.common import small_batches

#: Encodings of the web (fixed values) that bodies are read in; any other counts as UTF-8.
CHARSETS = frozenset(
    """ascii us-ascii utf-8 utf8 utf-16 utf-16le utf-16be latin1 iso-8859-1 iso-8859-2 iso-8859-3 iso-8859-4 iso-8859-5 iso-8859-6
    iso-8859-7 iso-8859-8 iso-8859-9 iso-8859-10 iso-8859-13 iso-8859-14 iso-8859-15 iso-8859-16 windows-1250 windows-1251 windows-1252 windows-1253
    windows-1254 windows-1255 windows-1256 windows-1257 windows-1258 cp1250 cp1251 cp1252 koi8-r koi8-u ibm866 macintosh tis-620
    gbk gb2312 gb18030 big5 big5-hkscs euc-jp shift_jis iso-2022-jp euc-kr""".split()
)
#: Bytes that a body, and a member of a gzipped file, may have when decompressed; beyond, it is a problem of its record.
BODY_BYTES, MEMBER_BYTES = 64 << 20, 1 << 30

#: Date of responses whose capture time is not known.
UNDATED = "1970-01-01T00:00:00Z"

#: Inside of a tag, up to what looks like the next one: no pattern looks further, so all take linear time.
_INSIDE = r"(?:[^<>]|<(?![a-zA-Z/!]))*"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!doctype[^<>]*>", re.S | re.I)
_TITLE, _TITLE_END = re.compile(rf"<title\b{_INSIDE}>", re.I), re.compile(r"</title", re.I)
_LANG = re.compile(rf"<html\b{_INSIDE}?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(rf"<(a|area|link|img|script|iframe)\b{_INSIDE}?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)")
_SPACE = re.compile(r"\s+")


def sha1(data: bytes) -> str:
    """A labelled digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A stable record id: the same source gives the same id when a job runs again."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """Visible text: one line for each run of inline content, character references decoded."""
    lines = _TAG.sub("", _BREAK.sub("\0", _HIDDEN.sub(" ", page.replace("\0", " ")))).split("\0")
    found = (_SPACE.sub(" ", html.unescape(x)).strip() for x in lines)
    return "\n".join(x for x in found if x)


def links(page: str, base: str) -> list[str]:
    """Distinct link targets in page order, as warc-fields values ``url tag/@attribute``."""
    out = {}
    for tag, attribute, *value in _LINK.findall(_HIDDEN.sub(" ", page)):
        target = html.unescape("".join(value)).strip()
        if target and not target.startswith(("#", "javascript:", "data:")):
            try:
                target = urljoin(base, target)
            except ValueError:
                pass
            out[f"{_SPACE.sub('%20', target)} {tag.lower()}/@{attribute.lower()}"] = None
    return list(out)


def title_of(page: str) -> str | None:
    """What stands between the first title tag and the next end of one."""
    start = _TITLE.search(page)
    end = _TITLE_END.search(page, start.end()) if start else None
    return page[start.end() : end.start()] if end else None


def http_block(body: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (lower-case names) and body; a block without a status line is all body."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    pairs = (x.partition(":") for x in rest)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def decode(body: bytes, content_type: str) -> tuple[str, str]:
    """Text and charset: of the header, else of a meta tag, if it is one of the web's, else UTF-8; bad bytes are replaced."""
    found = re.search(r"charset=\"?([\w-]+)", content_type, re.I)
    name = (found[1] if found else m[1].decode("ascii", "replace") if (m := _META.search(body[:4096])) else "utf-8").lower()
    if name in CHARSETS:
        try:
            return body.decode(name, "replace"), name
        except (LookupError, UnicodeError):
            pass
    return body.decode("utf-8", "replace"), "utf-8"


def dechunked(body: bytes) -> bytes:
    """The body of a chunked transfer; reading ends at the last chunk, or keeps what a cut body has."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def unpacked(body: bytes, encoding: str) -> tuple[bytes, str]:
    """The body without its content encodings, and the name of one that can't be undone (or "").

    gzip, deflate and zstd are undone; a cut stream gives what it has.  A body of more than ``BODY_BYTES``
    counts as one that can't be undone, and no more of it is decompressed.
    """
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if name in ("identity", "none"):
            continue
        try:
            if name in ("gzip", "x-gzip", "deflate"):
                raw = name == "deflate" and (len(body) < 2 or body[0] & 15 != 8 or (body[0] << 8 | body[1]) % 31)
                body = zlib.decompressobj(-15 if raw else 47).decompress(body, BODY_BYTES + 1)
            elif name == "zstd":
                import zstandard

                out, size = [], 0
                with zstandard.ZstdDecompressor().stream_reader(body) as stream:
                    while size <= BODY_BYTES and (part := stream.read(1 << 20)):
                        out.append(part)
                        size += len(part)
                body = b"".join(out)
            else:
                return b"", name
        except Exception:  # noqa: BLE001  (each library has an error of its own)
            return b"", name
        if len(body) > BODY_BYTES:
            return b"", name
    return body, ""


def derive_record(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of one response, as (headers, block).

    Transfer and content encodings are undone first; a body whose encoding can't be undone has an empty
    conversion, and its metadata name the encoding.  Header names are matched in any case.
    """
    known = {k.lower(): v for k, v in headers.items()}
    source, target = known.get("warc-record-id") or "", known.get("warc-target-uri") or ""
    status, http, body = split_http(block)
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = dechunked(body)
    payload = body
    body, unknown = unpacked(body, http.get("content-encoding", ""))
    page, charset = decode(body, http.get("content-type", ""))
    title = title_of(page)
    language = _LANG.search(page)
    digest = known.get("warc-payload-digest") or sha1(payload)
    fields = [("source-status", status), *((f"source-{k}", v) for k, v in http.items()), ("charset", charset)]
    fields += [("undecoded", unknown)] if unknown else []
    fields += [("title", _SPACE.sub(" ", html.unescape(title)).strip())] if title is not None else []
    fields += [("language", language[1])] if language else []
    fields += [("outlink", x) for x in links(page, target)]
    out = []
    for kind, content_type, data in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    ):
        own = {
            "WARC-Type": kind,
            "WARC-Record-ID": record_id(kind, source),
            "WARC-Refers-To": source,
            "WARC-Target-URI": target,
            "WARC-Date": known.get("warc-date") or UNDATED,
            "WARC-Source-Payload-Digest": digest,
            "WARC-Block-Digest": sha1(data),
            "Content-Type": content_type,
            "Content-Length": str(len(data)),
        }
        out.append(({k: v for k, v in own.items() if v}, data))
    return out


def to_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A record in the file format, as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


_MAGIC, _START = b"\x1f\x8b\x08", re.compile(rb"(?:^|\n)(WARC/\d)")


def _members(data: bytes) -> Iterator[tuple[bytes, str]]:
    """The members of a gzip file, decompressed one by one; a member that breaks off gives what it has and a
    problem, and reading goes on at the next one.  A plain file is one member."""
    if data[:2] != b"\x1f\x8b":
        yield data, ""
        return
    at = 0
    while at < len(data):
        unzip, problem = zlib.decompressobj(31), ""
        out, size = [], 0
        try:
            step = at
            while step < len(data) and not unzip.eof and size <= MEMBER_BYTES:
                out.append(unzip.decompress(data[step : step + 65536]))
                size += len(out[-1])
                step += 65536
            problem = "gzip member is too large" if size > MEMBER_BYTES else "" if unzip.eof else "gzip member is cut"
        except zlib.error:
            problem = "gzip member is broken"
        yield b"".join(out), problem
        if not problem:
            at = min(step, len(data)) - len(unzip.unused_data)
        if problem or data[at : at + 2] != _MAGIC[:2]:
            follow = data.find(_MAGIC, at + 1)
            at = follow if follow >= 0 else len(data)


def from_bytes(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """(headers, block, problem) of the records of a WARC file, plain or gzipped.

    problem is empty for a good record.  A record without a usable Content-Length or with less text
    than that, and a member that can't be decompressed, is given with its problem; reading goes on at
    the next start of a record.  Names of WARC headers are given as the format writes them, whatever
    case they have in the file.
    """
    for member, fault in _members(data):
        at = 0
        while found := _START.search(member, at):
            start = found.start(1)
            end = member.find(b"\r\n\r\n", start)
            skip = 4
            if end < 0:
                end, skip = member.find(b"\n\n", start), 2
            if end < 0:
                yield {}, b"", "header is cut"
                break
            lines = member[start:end].decode("utf-8", "replace").splitlines()[1:]
            headers = {_proper(k.strip()): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}
            size = headers.get("Content-Length", "")
            block = end + skip
            if not (size.isascii() and size.isdigit()):
                yield headers, b"", "no usable Content-Length"
                at = block - 1
                continue
            if block + int(size) > len(member):
                yield headers, member[block:], fault or "block is cut"
                break
            yield headers, member[block : block + int(size)], ""
            at = max(block + int(size) - 1, start + 1)
        else:
            if fault:
                yield {}, b"", fault


#: Names of WARC 1.1 headers.
WARC_HEADERS = (
    "WARC-Type WARC-Record-ID WARC-Date Content-Length Content-Type WARC-Concurrent-To WARC-Block-Digest WARC-Payload-Digest WARC-IP-Address WARC-Refers-To WARC-Refers-To-Target-URI "
    "WARC-Refers-To-Date WARC-Target-URI WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile WARC-Identified-Payload-Type WARC-Segment-Number WARC-Segment-Origin-ID WARC-Segment-Total-Length"
).split()
_PROPER = {x.lower(): x for x in WARC_HEADERS}


def _proper(name: str) -> str:
    return _PROPER.get(name.lower(), name)


RECORD = "headers map<string,string>, block binary"
_HEADERS = pa.map_(pa.string(), pa.string())


def scan_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, block, problem) of all records of the WARC files under ``path``; problem is null for good ones.

    A file is read by one task, member by member: it needs the memory of the file as stored (a task's
    small files together, up to a split) and of its largest member.  Files are at most 2 GB, as is usual.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for headers, block, problem in from_bytes(data):
                    columns = ([file], pa.string()), ([list(headers.items())], _HEADERS), ([block], pa.binary()), ([problem or None], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], ["file", "headers", "block", "problem"])

    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {RECORD}, problem string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of the good records of the WARC files under ``path``."""
    return scan_warc(spark, path).where("problem IS NULL").select("headers", "block")


def warc_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, broken, problems): good and broken records of each file with any, and what was wrong."""
    return scan_warc(spark, path).groupBy("file").agg(
        F.count_if(F.col("problem").isNull()).alias("records"), F.count("problem").alias("broken"), F.array_sort(F.collect_set("problem")).alias("problems")
    )


def page_responses(pages: DataFrame) -> DataFrame:
    """(page_id, headers, block): a response record for each row of (page_id, url, html).

    Null html is an empty body; a null url leaves the target URI out.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, blocks = [], []
            for page_id, url, body in zip(*(b.column(k).to_pylist() for k in range(3))):
                block = http_block(body := body or b"")
                heads.append([
                    ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url)), *([("WARC-Target-URI", url)] if url else []), ("WARC-Date", UNDATED),
                    ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
                ])
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, _HEADERS), pa.array(blocks, pa.binary())], ["page_id", "headers", "block"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    return rows.mapInArrow(run, "page_id long, " + RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """``records`` (any columns, headers, block) to its derived records, two for each response.

    Records of other types are passed over.  Input columns besides headers and block are repeated
    on both derived rows; record_type, record_id and refers_to are read off the headers.
    """
    derived = "array<struct<record_type:string,record_id:string,refers_to:string,headers:map<string,string>,block:binary>>"
    small_batches(records.sparkSession)

    @F.arrow_udf(derived)
    def derive(heads: pa.Array, blocks: pa.Array) -> pa.Array:
        out = []
        for head, block in zip(heads.to_pylist(), blocks.to_pylist()):
            head = dict(head or [])
            kind = next((v for k, v in head.items() if k.lower() == "warc-type"), "")
            made = derive_record(head, block or b"") if (kind or "").lower() == "response" else []
            out.append([{"record_type": h["WARC-Type"], "record_id": h["WARC-Record-ID"], "refers_to": h.get("WARC-Refers-To"), "headers": list(h.items()), "block": data} for h, data in made])
        row = pa.struct([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("headers", _HEADERS), ("block", pa.binary())])
        return pa.array(out, pa.list_(row))

    rest = [c for c in records.columns if c not in ("headers", "block")]
    return records.select(*rest, F.explode(derive("headers", "block")).alias("__made")).select(*rest, "__made.*")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Per page two rows, also of pages without html or url (empty text) and of repeated ones; other columns
    are ignored and an empty table gives none: page_id, record_type, record_id, refers_to, target_uri, source_digest,
    block_digest, content_type, content_length, text."""
    made = derivatives(page_responses(pages))
    header = lambda name: F.col("headers")[name]
    return made.select(
        "page_id",
        "record_type",
        "record_id",
        "refers_to",
        header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Source-Payload-Digest").alias("source_digest"),
        header("WARC-Block-Digest").alias("block_digest"),
        header("Content-Type").alias("content_type"),
        header("Content-Length").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("text"),
    )
