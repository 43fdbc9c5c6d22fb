"""Operator 7, WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is (headers map<string,string>, block binary). For each response two records are built: ``metadata``
(application/warc-fields: the source's HTTP status and headers, its digests, sizes and outlinks) and ``conversion``
(text/plain). Both name the response in WARC-Refers-To, keep its target, date and payload digest, and carry digests of
their own blocks. All is one narrow stage per record over Arrow batches; nothing is shuffled.

Header names of records and of HTTP are compared without case. Chunked bodies are joined and gzip or deflate bodies are
unpacked before the text is taken; what can't be is kept as it came, and the metadata record says so in a source-error
line. Records that are torn or malformed in a file are read as far as they go, with an error.

Edge cases: a null block or html is an empty body; a null url leaves WARC-Target-URI out; a block without an HTTP head is
all body, with status 0; records of other types pass no derivatives on; texts of any length are whole; repeated rows get
records with equal identifiers, as these derive from the source's identifier; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

RECORD = "headers map<string,string>, block binary"
#: Bytes of records that leave a reading task at once, about.
FLUSH = 16_000_000
#: The capture time of records made from a table of pages, which has none.
CAPTURED = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space of RFC 4122
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|aside|main|blockquote|pre|form)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def digest(data: bytes) -> str:
    """The labelled digest of WARC headers: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record identifier that reruns agree on."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The page's visible text: one line per block, white space inside a line made single."""
    page = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(html_lib.unescape(x).split()) for x in page.split("\n"))
    return "\n".join(x for x in lines if x)


def _head(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status, headers, body) of an HTTP message."""
    if block[:5].upper() != b"HTTP/":
        return "0", [], block
    end = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    first, *rest = re.split(r"\r?\n", head.decode("latin-1"))
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest) if k.strip()]
    return (first.split() + ["0", "0"])[1], fields, body


def _joined(body: bytes) -> bytes:
    """The chunks of a chunked body; raises ValueError where it is no such body or torn."""
    out, at = [], 0
    while True:
        stop = body.index(b"\n", at)
        size = int(body[at:stop].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        if size < 0 or stop + 1 + size > len(body):
            raise ValueError("torn chunk")
        out.append(body[stop + 1 : stop + 1 + size])
        at = stop + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1


def _unpacked(body: bytes, coding: str) -> bytes:
    """A gzip or deflate body as it was before; raises zlib.error or ValueError where it is none or torn."""
    out = []
    while body:
        unpack = zlib.decompressobj(47 if coding != "deflate" or body[0] & 15 == 8 else -15)
        out.append(unpack.decompress(body) + unpack.flush())
        if not unpack.eof:
            raise ValueError("torn body")
        body = unpack.unused_data if coding != "deflate" else b""
    return b"".join(out)


def content(fields: list[tuple[str, str]], body: bytes) -> tuple[bytes, list[str]]:
    """The body without its transfer and content codings, and what could not be undone."""
    named: dict[str, str] = {}
    for k, v in fields:
        named.setdefault(k.lower(), v.lower())
    faults = []
    if "chunked" in named.get("transfer-encoding", ""):
        try:
            body = _joined(body)
        except ValueError:
            faults.append("transfer-encoding chunked")
    for coding in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
        if coding in ("", "identity"):
            continue
        try:
            if coding not in ("gzip", "x-gzip", "deflate"):
                raise ValueError(coding)
            body = _unpacked(body, coding)
        except (ValueError, zlib.error):
            faults.append(f"content-encoding {coding}")
            break
    return body, faults


def response_record(key: str, url: str | None, page: str | None) -> tuple[dict, bytes]:
    """A response record of a stored page."""
    body = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", key, url or ""),
        "WARC-Date": CAPTURED,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "WARC-Block-Digest": digest(block),
        "WARC-Payload-Digest": digest(body),
    }
    return head | ({"WARC-Target-URI": url} if url is not None else {}), block


#: Types of payloads that have a text; of others there is metadata only.
_TEXTUAL = re.compile(r"text/|application/(?:[\w.-]+\+)?(?:xml|json)\b|application/(?:xhtml|javascript|ld)", re.I)


def derivatives(headers: dict, block: bytes | None) -> list[tuple[dict, bytes]]:
    """The metadata and conversion records of a response, metadata alone where its payload is no text; none for other types."""
    named = {k.lower(): v for k, v in headers.items()}
    if (named.get("warc-type") or "").lower() != "response":
        return []
    block = block or b""
    status, fields, payload_bytes = _head(block)
    body, faults = content(fields, payload_bytes)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "text/html")
    charset = (re.search(r"charset=[\"']?([\w-]+)", kind, re.I) or [None, "utf-8"])[1]
    try:
        page = body.decode(charset, "replace")
    except (LookupError, ValueError):  # unknown, or no charset of text
        page = body.decode("utf-8", "replace")
    source, payload = named.get("warc-record-id") or "", named.get("warc-payload-digest") or digest(payload_bytes)
    shared = {k: named[k.lower()] for k in ("WARC-Target-URI", "WARC-Date") if named.get(k.lower()) is not None}
    shared |= {"WARC-Refers-To": source, "WARC-Payload-Digest": payload}
    textual = bool(_TEXTUAL.match(kind.strip()))
    links = [html_lib.unescape(a or b or c).strip() for a, b, c in _LINK.findall(page)] if textual else []
    text = plain_text(page) if textual else ""
    facts = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in fields), ("source-block-digest", named.get("warc-block-digest") or digest(block))]
    facts += [("source-length", str(len(body))), ("text-length", str(len(text))), *(("source-error", x) for x in faults), *(("outlink", " ".join(x.split())) for x in links)]
    facts += [] if textual else [("source-error", "the payload is no text")]
    made = []
    for form, mime, out in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")),
    )[: 2 if textual else 1]:
        own = {"WARC-Type": form, "WARC-Record-ID": record_id(form, source), "Content-Type": mime, "Content-Length": str(len(out)), "WARC-Block-Digest": digest(out)}
        made.append((own | shared, out))
    return made


def serialise(headers: dict, block: bytes) -> bytes:
    """The bytes of one WARC/1.1 record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


_START = re.compile(rb"WARC/\d+\.\d+\r?\n")


def parse(data: bytes):
    """(headers, block, error) of each record of uncompressed WARC bytes; error is null for a whole record.

    A record whose length is missing or malformed goes up to the next record's first line; a torn one to the end. Bytes
    between records are passed over.
    """
    at = 0
    while (start := _START.search(data, at)) is not None:
        faults = []
        end = re.compile(rb"\r?\n\r?\n").search(data, start.end() - 2)
        lines = data[start.end() : end.start() if end else len(data)].decode("utf-8", "replace")
        body = end.end() if end else len(data)
        head: dict[str, str] = {}
        last = None
        for line in filter(None, re.split(r"\r?\n", lines)):
            if line[0] in " \t" and last:  # a folded line
                head[last] = f"{head[last]} {line.strip()}"
            elif ":" in line:
                last, value = (x.strip() for x in line.split(":", 1))
                head[last] = value
            else:
                faults.append("malformed header")
        size = next((v for k, v in head.items() if k.lower() == "content-length"), "")
        if not end:
            faults.append("torn header")
        if size.isdecimal():
            at = body + int(size)
            if at > len(data):
                faults.append("torn block")
        else:
            faults.append("no length")
            following = _START.search(data, body)
            at = following.start() if following else len(data)
        yield head, data[body:at], "; ".join(faults) or None


def unzipped(data: bytes):
    """The members of a gzip file one by one (files of bare records are one member each), as far as they can be read."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out = member.decompress(data)
        except zlib.error:
            return
        yield out
        data = member.unused_data if member.eof else b""


def _batch(keys, records, names) -> pa.RecordBatch:
    heads = pa.array([list(h.items()) for h, _ in records], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([keys, heads, pa.array([b for _, b in records], pa.binary())], names=names)


def responses(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, headers, block): a response record per page."""
    common.ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)))
            yield _batch(b.column(0), [response_record(str(k), u, h) for k, u, h in rows], [id_col, "headers", "block"])

    return pages.select(id_col, "url", "html").mapInArrow(run, f"`{id_col}` {kind}, {RECORD}")


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, headers, block): the metadata and conversion records of each response."""
    common.ship(records.sparkSession)
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, made = [], []
            for k, h, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = derivatives(dict(h or []), block)
                keys += [k] * len(got)
                made += got
            yield _batch(pa.array(keys, b.schema.field(0).type), made, [id_col, "headers", "block"])

    return records.select(id_col, "headers", "block").mapInArrow(run, f"`{id_col}` {kind}, {RECORD}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block, error) of the records in WARC files, plain or gzipped by record or whole.

    A file is read by one task, record by record; error says what is wrong with a torn or malformed record, else null.
    """
    common.ship(spark)

    def batch(p, rows):
        held = _batch(pa.array([p] * len(rows), pa.string()), [(h, x) for h, x, _ in rows], ["path", "headers", "block"])
        return pa.RecordBatch.from_arrays([*held.columns, pa.array([e for _, _, e in rows], pa.string())], names=["path", "headers", "block", "error"])

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                for part in unzipped(data) if data[:2] == b"\x1f\x8b" else [data]:
                    for record in parse(part):
                        rows.append(record)
                        size += len(record[1])
                        if size > FLUSH:
                            yield batch(p, rows)
                            rows, size = [], 0
                yield batch(p, rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {RECORD}, error string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per page: its metadata and its conversion record, with the linking headers as columns."""
    head = lambda k: F.col("headers").getItem(k)
    return derive(responses(common.table(spark, sf_dir, "pages"))).select(
        "page_id",
        head("WARC-Type").alias("record_type"),
        head("WARC-Record-ID").alias("record_id"),
        head("WARC-Refers-To").alias("refers_to"),
        head("WARC-Target-URI").alias("target_uri"),
        head("WARC-Date").alias("warc_date"),
        head("Content-Type").alias("content_type"),
        head("WARC-Payload-Digest").alias("source_payload_digest"),
        head("WARC-Block-Digest").alias("block_digest"),
        head("Content-Length").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("content"),
    )
