"""WARC archives: writing with duplicates as revisits, and reading with segment reassembly.

Payloads travel as HTTP responses with chunked transfer framing. A block longer than ``segment_bytes``
is split: the first record carries segment 1, continuation records the rest, and the last one the total
length. Reading groups the records of one origin, orders them by segment number, checks that none is
missing and that the total length holds, and takes the chunked framing off again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm.common import materialise, text_of, work_path

CRLF = b"\r\n"


class BrokenRecord(ValueError):
    """A record that can't be put together again."""


# -- framing -----------------------------------------------------------------------------------------


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at : at + chunk_bytes]
        out += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise BrokenRecord("a chunk size is missing")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise BrokenRecord("a chunk size isn't a number") from None
        if size <= 0:
            return b"".join(out)
        at = end + 2
        piece = body[at : at + size]
        if len(piece) < size or body[at + size : at + size + 2] != CRLF:
            raise BrokenRecord("a chunk is cut off")
        out.append(piece)
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, with any chunked framing taken off."""
    head, found, body = block.partition(CRLF + CRLF)
    if not found:
        raise BrokenRecord("the HTTP header has no end")
    fields = [line.lower() for line in head.split(CRLF)[1:]]
    if any(f.startswith(b"transfer-encoding:") and b"chunked" in f for f in fields):
        return dechunked(body)
    return body


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length or None, bytes) triples in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise BrokenRecord("a segment is missing or doubled")
    block = b"".join([bytes(s[2]) for s in segments])
    totals = {s[1] for s in segments if s[1] is not None and s[1] >= 0}
    if totals != {len(block)}:
        raise BrokenRecord("the total length doesn't hold")
    return block


# -- records -----------------------------------------------------------------------------------------


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record."""
    head = [f"WARC-Type: {kind}"] + [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def _is_number(text: str | None) -> bool:
    return bool(text) and len(text) < 19 and text.isascii() and text.removeprefix("-").isdigit()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-cased name, and block."""
    head, found, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not found or not lines[0].startswith(b"WARC/"):
        raise BrokenRecord("not a WARC record")
    fields = {k.decode(errors="replace").strip().lower(): v.decode(errors="replace").strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    if not _is_number(fields.get("content-length")):
        raise BrokenRecord("a record has no length")
    size = int(fields["content-length"])
    if len(rest) < size:
        raise BrokenRecord("a block is cut off")
    return fields, rest[:size]


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, each one record."""
    while data:
        one = zlib.decompressobj(31)
        try:
            out = one.decompress(data) + one.flush()
        except zlib.error as why:
            raise BrokenRecord("not an archive of gzip members") from why
        if not one.eof:
            raise BrokenRecord("an archive is cut off")
        yield out
        data = one.unused_data


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, *, chunk_bytes: int, segment_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one page."""
    first = f"<urn:uuid:{uuid.uuid4()}>"
    shared = {
        "WARC-Record-ID": first,
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-Id": page_id,
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", shared | {"WARC-Profile": profile, "X-Refers-To-Page-Id": refers_to}, head + CRLF)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record("response", shared, block)
        return
    yield record("response", shared | {"WARC-Segment-Number": 1}, block[:segment_bytes])
    for at in range(segment_bytes, len(block), segment_bytes):
        last = at + segment_bytes >= len(block)
        yield record(
            "continuation",
            {
                "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                "WARC-Date": date,
                "WARC-Segment-Origin-ID": first,
                "WARC-Segment-Number": at // segment_bytes + 1,
                "WARC-Segment-Total-Length": len(block) if last else None,
            },
            block[at : at + segment_bytes],
        )


# -- tables ------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, *, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest and refers_to: the smallest id with an equal payload of ``least_bytes`` or more."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    chunk_bytes: int = 4096,
    segment_bytes: int = 16_384,
    file_bytes: int = 8 << 20,
    date: str = "2024-01-01T00:00:00Z",
    **columns,
) -> DataFrame:
    """Write a record per page, compressed one by one, and return the table of files: path, records, bytes.

    ``folder`` is a URI that all executors reach; by default a new one in the shared folder. A file is
    closed once it holds ``file_bytes``. Only files named in the returned table, which is written before
    it is returned, count: what a lost or repeated task leaves behind isn't in it.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        for frame in frames:
            for page_id, url, html, digest, refers_to in frame.itertuples(index=False, name=None):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for one in page_records(
                    None if pd.isna(page_id) else int(page_id), url, html.encode(), digest, None if pd.isna(refers_to) else int(refers_to),
                    chunk_bytes=chunk_bytes, segment_bytes=segment_bytes, date=date,
                ):
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = packer.compress(one) + packer.flush()
                    out.write(packed)
                    size += len(packed)
                    count += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame([(f"{folder}/{name}", count, size)], columns=["path", "records", "bytes"])
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"{folder}/{name}", count, size)], columns=["path", "records", "bytes"])

    return materialise(with_revisits(pages, **columns).mapInPandas(written, "path string, records long, bytes long"), "warc-files")


def read_archives(spark: SparkSession, files: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Read archives back: page_id, record_type, refers_to, declared_digest, payload_bytes, payload_digest, payload, error.

    ``files``: a table with the URIs of the archives in ``path``, each of which counts once; no folder is listed, and tasks open the files
    that they are dealt. Revisits have no payload of their own. A record whose segments or chunks don't
    fit together gets the reason as ``error`` and no payload; so does one that can't be read at all, in a row
    without page_id and record_type. Where an archive is cut off, is none or isn't there, one such row stands for the rest
    of it, and the records before it are read. ``payload`` is null unless ``with_payload``.
    """
    # the paths are dealt out, not the contents; files that no table names, of lost tasks, aren't met
    paths = files.select("path").distinct()
    archives = paths.repartition(max(1, min(100_000, -(-paths.count() // _FILES))), F.xxhash64("path"))

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for path in frame["path"]:
                rows, number = [], 0
                archive = path.rsplit("/", 1)[-1]
                try:
                    store, at = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(at, compression=None) as file:
                        content = file.read()
                    for number, data in enumerate(members(content), 1):
                        try:
                            rows += _record_rows(data, with_payload)
                        except BrokenRecord as why:
                            rows.append({"origin": f"{archive}#{number}", "error": str(why)})
                except (BrokenRecord, FileNotFoundError) as why:
                    rows.append({"origin": f"{archive}#{number + 1}", "error": str(why)})
                yield _frame(rows, _PARSED)

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            for row in rows:
                parts = row.pop("parts")
                if parts is not None and len(parts):
                    row |= _payload_row(lambda parts=parts: reassembled([(p["number"], p["total"], p["data"]) for p in parts]), with_payload)
            yield _frame(rows, _PAGE)

    segments = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "total", "data")))
    pages = archives.mapInPandas(parsed, _PARSED).groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload", "error")],
        segments.alias("parts"),
    )
    return pages.drop("origin").mapInPandas(joined, _PAGE)


#: Archives that a task opens, one after the other.
_FILES = 4
_PAGE = "page_id long, record_type string, refers_to long, declared_digest string, payload_bytes long, payload_digest string, payload binary, error string"
_PARSED = f"origin string, {_PAGE}, number int, total long, data binary"


def _record_rows(data: bytes, with_payload: bool) -> list[dict]:
    """A record as a row, or none if it is of a kind that holds no page."""
    fields, block = parse_record(data)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit", "continuation"):
        return []
    names = ("x-page-id", "x-refers-to-page-id", "warc-segment-number", "warc-segment-total-length")
    found = [fields.get(n) or None for n in names]
    if any(n is not None and not _is_number(n) for n in found):
        raise BrokenRecord("a number in a record's head is none")
    origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
    if not origin:
        raise BrokenRecord("a record has no id")
    page, refers, number, total = (n and int(n) for n in found)
    row = {
        "origin": origin,
        "page_id": page,
        "record_type": None if kind == "continuation" else kind,
        "refers_to": refers,
        "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "number": number,
        "total": total,
    }
    if number:
        row["data"] = block
    elif kind == "response":
        row |= _payload_row(lambda: block, with_payload)
    return [row]


def _payload_row(block, with_payload: bool) -> dict:
    try:
        payload = http_payload(block())
    except BrokenRecord as why:
        return {"error": str(why)}
    return {"payload_bytes": len(payload), "payload_digest": sha256(payload).hexdigest(), "payload": payload if with_payload else None}


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame with the schema's columns; whole numbers keep nulls."""
    out = {}
    for name, kind in (c.split(" ") for c in schema.split(", ")):
        values = [r.get(name) for r in rows]
        if kind in ("int", "long"):
            values = pd.array([None if pd.isna(v) else int(v) for v in values], dtype="Int64" if kind == "long" else "Int32")
        out[name] = pd.Series(values, dtype=None if kind in ("int", "long") else object)
    return pd.DataFrame(out)


def warc_round_trip(pages: DataFrame, *, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **sizes) -> DataFrame:
    """Write the pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of ``least_bytes`` or more the page with the smallest id is a response and the
    others revisit it; a revisit's payload is that of its response. Rows that repeat the smallest id are
    responses too. A null payload is the empty payload. A null id is kept; it revisits a page with an id
    if one has the payload. Null urls are left out of the record. Repeated rows come back as often as they
    were written; an empty table gives an empty result; other columns are not read. A page whose records
    can't be put together comes back without a payload digest.
    """
    files = write_archives(pages, least_bytes=least_bytes, id_col=id_col, url_col=url_col, html_col=html_col, **sizes)
    back = read_archives(pages.sparkSession, files)
    back = materialise(back.drop("payload"), "warc-pages")
    # the payload that a revisit stands for is that of the response with its page id and digest
    found = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("to_id"), F.col("declared_digest").alias("to_digest")).distinct()
    origin = (
        back.where("record_type = 'response'")
        .join(found, (F.col("page_id") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")))
        .groupBy("to_id", "to_digest")
        .agg(F.max("payload_bytes").alias("to_bytes"))
    )
    revisits = back.where("record_type = 'revisit'").join(
        origin, (F.col("refers_to") == F.col("to_id")) & (F.col("declared_digest") == F.col("to_digest")), "left"
    )
    return (
        back.where("record_type <> 'revisit' or record_type is null")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        .unionByName(revisits.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), "record_type", "refers_to"))
        .withColumnRenamed("page_id", id_col)
    )
