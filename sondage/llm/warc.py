"""WARC derivatives: metadata and plain-text conversion records of responses.

``read_records`` parses WARC 1.0/1.1 data, plain or gzip by record, into rows.
``derive`` makes of each response two records that refer to it:

* ``metadata`` (application/warc-fields): status, the response's own headers,
  payload length and digest, title, number of links, and the identifier of the
  conversion record made beside it;
* ``conversion`` (text/plain): the page's visible text in UTF-8.

Both carry ``WARC-Refers-To`` with the response's ``WARC-Record-ID``, its
``WARC-Target-URI`` and ``WARC-Date``, and a ``WARC-Block-Digest`` of their
own.  Identifiers are name-based (UUID 5 of the response's identifier and the
record's type), so a task that runs twice makes the same records.

``pack_records`` serialises rows to gzip members; a block of them (``data``)
is a valid ``.warc.gz`` stream.  Blocks are rows of Parquet files, so Spark
commits each task's files whole.

Null html: an empty payload and an empty conversion.  Null url: no target.
Other records than responses pass ``derive`` by.  Records cut short at the
end of data are reported with ``truncated``.  Repeated rows give repeated
records.  An empty table gives an empty table.  Only the named columns are
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from sondage.llm.base import pick

RECORD = "record_id string, type string, refers_to string, target_uri string, date string, headers map<string,string>, block binary, truncated boolean"
RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
                           ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("truncated", pa.bool_())])
BLOCK = "n_records long, data binary"
BLOCK_SCHEMA = pa.schema([("n_records", pa.int64()), ("data", pa.binary())])
#: Bytes of records in one block of output.
BLOCK_BYTES = 4 << 20
#: Header names for the fields that have a column.
FIELDS = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(names))}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return (re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value).strip()


def serialise(record: dict) -> bytes:
    """One record as WARC 1.1 bytes."""
    head = {name: record[field] for field, name in FIELDS.items() if record.get(field)}
    head |= {k: v for k, v in (record.get("headers") or {}).items() if k not in head and k.lower() != "content-length"}
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in head.items()), f"Content-Length: {len(record['block'])}", "", ""]
    return "\r\n".join(lines).encode() + record["block"] + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(data: bytes) -> Iterator[bytes | None]:
    """The gzip members of data one by one, or the data itself if plain; None for bytes that are no member."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    at, lost = 0, False
    while at < len(data):
        if not data.startswith(b"\x1f\x8b", at):  # go on at the next header
            if not lost:
                yield None
            lost, at = True, data.find(b"\x1f\x8b\x08", at)
            if at < 0:
                return
        z, parts, begin = zlib.decompressobj(31), [], at
        try:
            while at < len(data) and not z.eof:  # in steps: what is left over is copied
                step = data[at : at + (1 << 14)]
                parts.append(z.decompress(step))
                at += len(step)
            broken = lost and not z.eof  # what looked like a header
        except zlib.error:
            broken = True
        if broken:
            yield b"".join(parts)
            if not lost:
                yield None
            lost, at = True, data.find(b"\x1f\x8b\x08", begin + 2)
            if at < 0:
                return
            continue
        at -= len(z.unused_data)
        lost = False
        yield b"".join(parts)


def _fields(text: str) -> dict[str, str]:
    """Header lines; a line that begins with white space goes on the one before."""
    out, name = {}, ""
    for line in text.splitlines():
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


#: Stands for data that could not be read.
LOST = {**dict.fromkeys(FIELDS), "truncated": True, "block": b"", "headers": {}}


def parse_records(data: bytes) -> Iterator[dict]:
    for member in _members(data):
        if member is None:
            yield dict(LOST)
            continue
        at = 0
        while (at := member.find(b"WARC/1.", at)) >= 0:
            stop = member.find(b"\r\n\r\n", at)
            if stop < 0:
                yield dict(LOST)
                break
            headers = _fields(member[at:stop].decode("utf-8", "replace").partition("\r\n")[2])
            by_name = {k.lower(): v for k, v in headers.items()}
            size = by_name.get("content-length", "")
            n = int(size) if size.isdigit() else 0
            block = member[stop + 4 : stop + 4 + n]
            yield {field: by_name.get(name.lower()) for field, name in FIELDS.items()} | {
                "headers": headers, "block": block, "truncated": len(block) < n or not size.isdigit() or "warc-truncated" in by_name}
            at = stop + 4 + n


def _records(data: Iterator[bytes | None]) -> Iterator[dict]:
    for x in data:
        yield from parse_records(x or b"")


def _column(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[bytes | None]:
    for b in batches:
        for x in b.column(name):
            yield x.as_py()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of record batches as records."""
    for b in batches:
        for at in range(0, b.num_rows, 200):
            yield from b.slice(at, 200).to_pylist(maps_as_pydicts="lossy")


def _as_rows(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in records:
        out.append(r | {"headers": list((r["headers"] or {}).items())})
        size += len(r["block"])
        if size >= BLOCK_BYTES or len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, RECORD_SCHEMA)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, RECORD_SCHEMA)


def _as_blocks(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in records:
        data = serialise(r)
        out.append(gzip_member(data))
        size += len(data)
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist([{"n_records": len(out), "data": b"".join(out)}], BLOCK_SCHEMA)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([{"n_records": len(out), "data": b"".join(out)}], BLOCK_SCHEMA)


def read_records(blocks: DataFrame, data_col: str = "data") -> DataFrame:
    """One row per record of rows of WARC data."""
    rows = pick(blocks, _data=data_col)
    return rows.mapInArrow(lambda batches: _as_rows(_records(_column(batches, "_data"))), RECORD)


def pack_records(records: DataFrame) -> DataFrame:
    """``n_records, data``: gzip members, about ``BLOCK_BYTES`` of records in each block."""
    return records.mapInArrow(lambda batches: _as_blocks(_rows(batches)), BLOCK)


# --- responses and their derivatives -------------------------------------------

_DROP = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>|<[!?][^>]*>", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|aside|nav|header|footer|form|main|body|head|html|blockquote|pre|dl|dt|dd|hr|option|title)\b[^>]*>", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^>]*>")
_LINK = re.compile(r"<a\s[^>]*\bhref\s*=", re.I)


def plain_text(html: str) -> str:
    """Visible text, one line per block."""
    text = unescape(_MARKUP.sub("", _BREAK.sub("\n", _DROP.sub(" ", html))))
    return "\n".join(y for x in text.split("\n") if (y := " ".join(x.split())))


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(status line, headers, payload) of a response block; what is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, rest = head.decode("iso-8859-1").partition("\r\n")
    return status, _fields(rest), payload


def _dechunked(payload: bytes) -> bytes:
    """The body of a chunked payload, or the payload as it is where the crawler joined the chunks already."""
    out, at = [], 0
    while at < len(payload):
        stop = payload.find(b"\r\n", at)
        size = payload[at : max(at, stop)].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return b"".join(out) if out else payload
        n = int(size, 16)
        if not n:
            break
        out.append(payload[stop + 2 : stop + 2 + n])
        at = stop + 4 + n
    return b"".join(out)


def _inflated(payload: bytes) -> bytes:
    """The content of a gzip or deflate payload, as far as it goes, or the payload as it is where it is none."""
    for bits in (47, -15):
        out, rest = [], payload
        try:
            while rest:
                z = zlib.decompressobj(bits)
                out.append(z.decompress(rest))
                rest = z.unused_data if z.eof else b""
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return payload


def decoded(http: dict[str, str], payload: bytes) -> tuple[bytes, str]:
    """(payload without its transfer and content encodings, an encoding that is not known)."""
    by_name = {k.lower(): v.lower() for k, v in http.items()}
    for name in ("transfer-encoding", "content-encoding"):
        for kind in reversed([x.strip() for x in by_name.get(name, "").split(",")]):
            if kind == "chunked":
                payload = _dechunked(payload)
            elif kind in ("gzip", "x-gzip", "deflate"):
                payload = _inflated(payload)
            elif kind not in ("", "identity"):
                return payload, kind
    return payload, ""


def derive_one(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    source, headers = record["record_id"] or "", record["headers"] or {}
    by_name = {k.lower(): v for k, v in headers.items()}
    status, http, payload = split_http(record["block"] or b"")
    kind = next((v for k, v in http.items() if k.lower() == "content-type"), "")
    body, unknown = decoded(http, payload)
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    title, text = _TITLE.search(html), plain_text(html).encode()
    meta_id, text_id = record_id(source, "metadata"), record_id(source, "conversion")
    truncated = bool(record["truncated"]) or "warc-truncated" in by_name
    fields = {**{f"source-{k}": v for k, v in by_name.items()}, "payload-undecoded": unknown,
              "http-status": status, **{f"http-{k.lower()}": v for k, v in http.items()},
              "payload-length": str(len(payload)), "payload-digest": digest(payload),
              "source-payload-digest": by_name.get("warc-payload-digest", ""), "source-block-digest": by_name.get("warc-block-digest", ""),
              "title": " ".join(unescape(title[1]).split()) if title else "", "links": str(len(_LINK.findall(html))),
              "conversion": text_id, "conversion-length": str(len(text))}
    if (given := by_name.get("warc-payload-digest", "")).startswith("sha1:"):
        fields["payload-digest-agrees"] = str(given == fields["payload-digest"]).lower()
    meta = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields.items() if v).encode()
    shared = {"refers_to": source, "target_uri": record["target_uri"], "date": record["date"], "truncated": truncated}
    own = {k: v for k, v in headers.items() if k.lower() in ("warc-ip-address", "warc-warcinfo-id", "warc-identified-payload-type")}
    if truncated:
        own["WARC-Truncated"] = by_name.get("warc-truncated", "unspecified")
    return [
        {"record_id": i, "type": t, "block": block, **shared, "headers": {
            **own, "Content-Type": c, "WARC-Block-Digest": digest(block), "WARC-Source-Payload-Digest": fields["payload-digest"]}}
        for i, t, c, block in ((meta_id, "metadata", "application/warc-fields", meta), (text_id, "conversion", "text/plain; charset=utf-8", text))]


def _derived(records: Iterator[dict]) -> Iterator[dict]:
    for r in records:
        if r["type"] == "response":
            yield from derive_one(r)


def derive(records: DataFrame) -> DataFrame:
    """Rows of ``read_records`` -> metadata and conversion records of the responses among them."""
    return records.mapInArrow(lambda batches: _as_rows(_derived(_rows(batches))), RECORD)


def derive_blocks(blocks: DataFrame, data_col: str = "data") -> DataFrame:
    """The same from WARC data to WARC data, in one pass."""
    rows = pick(blocks, _data=data_col)
    return rows.mapInArrow(lambda batches: _as_blocks(_derived(_records(_column(batches, "_data")))), BLOCK)


def _responses(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[dict]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            for r in b.slice(at, 200).to_pylist():
                url, body = r["_url"] or "", (r["_html"] or "").encode()
                block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {r['_id']}\r\n\r\n").encode() + body
                payload = digest(body)
                yield {"record_id": record_id(url, str(r["_id"]), payload), "type": "response", "refers_to": None, "target_uri": url or None, "date": date,
                       "headers": {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": payload, "WARC-Block-Digest": digest(block)},
                       "block": block, "truncated": False}


def respond(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", packed: bool = False) -> DataFrame:
    """Pages as response records (``packed``: as WARC data), as a crawler would have written them."""
    rows = pick(pages, _id=id_col, _url=url_col, _html=html_col)
    if packed:
        return rows.mapInArrow(lambda batches: _as_blocks(_responses(batches, date)), BLOCK)
    return rows.mapInArrow(lambda batches: _as_rows(_responses(batches, date)), RECORD)


DIGEST = {"page_id": pa.int64(), "record_id": pa.string(), "type": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(),
          "block_digest": pa.string(), "digest_agrees": pa.bool_(), "source_digest": pa.string(), "n_chars": pa.int64(), "text_sha256": pa.string(),
          "links": pa.int64(), "title": pa.string()}
DIGEST_SQL = ("page_id long, record_id string, type string, refers_to string, target_uri string, block_digest string, digest_agrees boolean, "
              "source_digest string, n_chars long, text_sha256 string, links long, title string")


def _digest_rows(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), DIGEST.values())], list(DIGEST))
    for r in records:
        meta = _fields(r["block"].decode()) if r["type"] == "metadata" else {}
        number, links, stated = meta.get("http-x-page-id", ""), meta.get("links"), r["headers"].get("WARC-Block-Digest")
        out.append((int(number) if re.fullmatch(r"-?\d+", number) else None, r["record_id"], r["type"], r["refers_to"], r["target_uri"],
                    stated, stated == digest(r["block"]), r["headers"].get("WARC-Source-Payload-Digest"),
                    len(r["block"].decode()), hashlib.sha256(r["block"]).hexdigest(), int(links) if links else None, meta.get("title")))
        if len(out) >= 2000:
            yield batch()
            out.clear()
    if out:
        yield batch()


def digests(derived: DataFrame) -> DataFrame:
    """A row for each derived record of rows of records, with its fields read from its own block."""
    return derived.mapInArrow(lambda batches: _digest_rows(_rows(batches)), DIGEST_SQL)


def digest_blocks(blocks: DataFrame, data_col: str = "data") -> DataFrame:
    """The same from WARC data."""
    rows = pick(blocks, _data=data_col)
    return rows.mapInArrow(lambda batches: _digest_rows(_records(_column(batches, "_data"))), DIGEST_SQL)
