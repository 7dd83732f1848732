"""Operator 4: legacy ARC archives converted to WARC, with revisit records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import BATCH_BYTES, bounded_batches, fresh_path, saved, table

#: Titles of an ARC header line's fields, in the file's second line, and what each looks like.
ARC_FIELDS = {
    "URL": ("url", r"(?P<url>.*)"), "IP-address": ("ip", r"(?P<ip>\S+)"), "Archive-date": ("date", r"(?P<date>[0-9]{4,14})"), "Content-type": ("mime", r"(?P<mime>.*?)"),
    "Result-code": ("status", r"(?P<status>\S+)"), "Checksum": ("checksum", r"(?P<checksum>\S+)"), "Location": ("location", r"(?P<location>\S+)"), "Offset": ("offset", r"(?P<offset>\S+)"),
    "Filename": ("filename", r"(?P<filename>\S+)"), "Archive-length": ("length", r"(?P<length>[0-9]+)"),
}
ARC_TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- archives as text files with a given record end: Spark writes and reads them, so
# they can be in any store that Spark reaches


def _write_records(rows: DataFrame, path: str, end: str) -> None:
    """One record a row (binary column ``record``), each followed by ``end``."""
    text = rows.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _parsed(spark: SparkSession, path: str, parse: Callable[[Iterator[bytes]], Iterator[dict]], schema: pa.Schema) -> DataFrame:
    """Rows that ``parse`` makes of each file's lines. Files aren't split, and come
    line by line, so a worker holds one record and a batch of results only."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        ahead = next(pairs, None)
        rows: list[dict] = []
        held = 0
        while ahead is not None:
            file = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == file:
                    line = ahead[1]
                    ahead = next(pairs, None)
                    yield line

            for row in parse(own()):
                rows.append(row | {"file": file})
                held += len(row.get("packed") or b"") + 400
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.mapInArrow(run, ", ".join(f"{f.name} {_SPARK[f.type]}" for f in schema))


_SPARK = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


class _Lines:
    """Lines that can be given back, to be read again."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.again = lines, deque()

    def __iter__(self) -> _Lines:
        return self

    def __next__(self) -> bytes:
        return self.again.popleft() if self.again else next(self.lines)


def _body(lines: Iterator[bytes], length: int, tail: bytes = b"") -> bytes:
    """The next ``length`` bytes, which end where a line (less ``tail``) ends. Where they don't, the lines are given back."""
    parts: list[bytes] = []
    held = -1
    while held < length + len(tail) and (line := next(lines, None)) is not None:
        parts.append(line)
        held += len(line) + 1
    body = b"\n".join(parts)
    if held == length + len(tail) and body.endswith(tail):
        return body[:length]
    if isinstance(lines, _Lines):
        lines.again.extendleft(reversed(parts))
    raise ValueError("an archive ends within a record" if held < length + len(tail) else "a record's declared length doesn't fit its content")


# -- ARC


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _head_size(content: bytes) -> int:
    """Bytes of the HTTP head with its blank line; all of it if there is no blank line."""
    end = _HEAD_END.search(content)
    return end.end() if end else len(content)


def _head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").splitlines()[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def arc_record(version: str, url: str | None, date: str, content: bytes, ip: str = "0.0.0.0", mime: str = "text/html", status: str = "200") -> bytes:
    own = {"url": quote(url or "-", safe=_VISIBLE) or "-", "ip": ip, "date": date, "mime": mime, "length": str(len(content))}
    own |= {"status": status, "checksum": "-", "location": "-", "offset": "0", "filename": "-"}
    return " ".join(own[ARC_FIELDS[title][0]] for title in ARC_TITLES[version].split()).encode() + b"\n" + content


def arc_version_block(version: str, date: str) -> bytes:
    body = f"{version} 0 countloom\n{ARC_TITLES[version]}\n".encode()
    return f"filedesc://part.arc 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: str = "1", date: str = "20240101000000") -> None:
    """Writes pages as gzipped ARC files of the given version, one a task."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [arc_version_block(version, date)]
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
            records = first + [arc_record(version, url, date, _http(page_id, (html or "").encode()) + (html or "").encode()) for page_id, url, html in rows]
            first = []
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    _write_records(own.mapInArrow(run, "record binary"), path, "\n")


def _header_pattern(titles: str) -> re.Pattern:
    unknown = set(titles.split()) - set(ARC_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields of ARC header lines: {sorted(unknown)}")
    return re.compile(" ".join(ARC_FIELDS[title][1] for title in titles.split()))


def _page_id(text: str | None) -> int | None:
    """A whole number of 64 bits, or none."""
    digits = (text or "").removeprefix("-")
    if not (digits.isascii() and digits.isdecimal() and len(digits) < 20):
        return None
    return own if -(1 << 63) <= (own := int(text)) < 1 << 63 else None


def _full_date(date: str) -> str:
    """Fourteen digits: the earliest time that fits; an error if there is no such day or hour."""
    d = date + "00000101000000"[len(date) :]
    datetime(*(int(d[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))))
    return d


def _arc_record(text: str, lines: Iterator[bytes], header: re.Pattern) -> tuple[dict, bytes, str, int]:
    """Fields, content, kind and head size of the record that begins with a header line."""
    m = header.fullmatch(text)
    if m is None:
        raise ValueError(f"an ARC header line doesn't fit its version: {text[:200]}")
    record, content = m.groupdict(), _body(lines, int(m["length"]))
    _full_date(record["date"])
    is_http = record["url"][:7].lower().startswith(("http://", "https:/")) or "://" not in record["url"].split(" ")[0] and not record["url"].startswith("dns:")
    return record, content, *(("http", _head_size(content)) if is_http and content.startswith(b"HTTP/") else ("other", 0))


def _arc_version(text: str, lines: Iterator[bytes]) -> tuple[dict, bytes, re.Pattern]:
    url, ip, date, *_ = text.split(" ")
    body = _body(lines, int(text.rpartition(" ")[2]))
    _full_date(date)
    first, titles = [*body.decode("utf-8", "replace").splitlines(), "", ""][:2]
    version = first.split(" ")[0]
    if not titles.strip() and version not in ARC_TITLES:
        raise ValueError(f"an unknown ARC version: {version[:20]}")
    return {"url": url, "ip": ip, "date": date, "mime": "text/plain", "status": first}, body, _header_pattern(titles.strip() or ARC_TITLES[version])


def parse_arc(lines: Iterator[bytes], with_content: bool, strict: bool = True) -> Iterator[dict]:
    """Records of one ARC file. The first block tells the version and the fields of all header
    lines; a record's last field is its content's length. URLs and types may hold
    blanks. kind is http (the URL is one and the content begins with an HTTP head),
    filedesc (the first block) or other; the payload of http is what follows the head, of
    others all content. A record that doesn't fit (its header line, length or date, or the file's end) is an error; without
    ``strict`` it becomes a row of kind broken, with the reason in ``status``, and what follows is passed over
    up to the next header line."""
    header, lost, lines = _header_pattern(ARC_TITLES["1"]), False, _Lines(lines)
    for place, line in enumerate(lines):
        text = line.decode("utf-8", "replace").rstrip("\r")
        if not text or (lost and not text.startswith("filedesc://") and header.fullmatch(text) is None):
            continue
        try:
            if text.startswith("filedesc://"):
                record, content, header = _arc_version(text, lines)
                kind, head = "filedesc", 0
            else:
                record, content, kind, head = _arc_record(text, lines, header)
        except ValueError as error:
            if strict:
                raise
            lost = True
            yield {"place": place, "kind": "broken", "status": str(error), "url": text[:200]}
            continue
        lost = False
        payload = content[head:]
        row = {"place": place, "kind": kind, "page_id": _page_id(_head_fields(content[:head]).get("x-page-id"))}
        row |= {name: record.get(name) for name in ("url", "date", "ip", "mime", "status")}
        yield row | {"length": len(payload), "digest": payload_digest(payload), "head": head, "packed": zlib.compress(content, 1) if with_content else None}


_ARC_SCHEMA = pa.schema(
    [("file", pa.string()), ("place", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64())]
    + [(name, pa.string()) for name in ("url", "date", "ip", "mime", "status")]
    + [("length", pa.int64()), ("digest", pa.string()), ("head", pa.int64()), ("packed", pa.binary())]
)


def read_arc(spark: SparkSession, path: str, *, with_content: bool = True) -> DataFrame:
    """file, place, kind, page_id, url, date, ip, mime, status, length and digest of the payload, head
    (bytes before it), packed (all content, deflated) of each record of the ARC files in ``path``. Broken
    records are left out: ``read_broken`` has them. Empty files have no records; a folder without files is an error of Spark's."""
    return _parsed(spark, path, lambda lines: parse_arc(lines, with_content, strict=False), _ARC_SCHEMA).where("kind <> 'broken'")


def read_broken(spark: SparkSession, path: str) -> DataFrame:
    """file, place, reason and the beginning of the header line of each record that ``read_arc`` leaves out."""
    rows = _parsed(spark, path, lambda lines: parse_arc(lines, False, strict=False), _ARC_SCHEMA).where("kind = 'broken'")
    return rows.select("file", "place", F.col("status").alias("reason"), F.col("url").alias("line"))


# -- WARC


def record_id(file: str, place: int, page_id: int | None, url: str, date: str, digest: str) -> str:
    """The same identifier for the same ARC record, in every run over its file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rpartition("/")[2]} {place} {page_id} {url} {date} {digest}')}>"


def iso_date(date: str) -> str:
    """The earliest time that fits the digits."""
    d = _full_date(date)
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    own = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own) + "\r\n").encode() + block


def _converted(row: dict) -> bytes:
    """The WARC record of one ARC record, whose content is carried over byte for byte.
    ``best`` is the record whose payload stays: the others keep their HTTP head only."""
    names = ("file", "place", "page_id", "url", "date")
    own_id, best, content = record_id(*(row[n] for n in names), row["digest"]), row["best"], zlib.decompress(row["packed"])
    headers = [("WARC-Record-ID", own_id), ("WARC-Date", iso_date(row["date"]))]
    if row["kind"] == "filedesc":
        fields = f"software: countloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {row['url'].removeprefix('filedesc://')}\r\narc-version: {row['status'].strip()}\r\n"
        return warc_record("warcinfo", [*headers, ("WARC-Filename", row["file"].rpartition("/")[2]), ("Content-Type", "application/warc-fields")], fields.encode())
    headers += [("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
    headers += [("WARC-IP-Address", row["ip"])] if row["ip"] not in (None, "-", "0.0.0.0") else []
    headers += [("X-ARC-Result-Code", row["status"])] if row["status"] not in (None, "-") else []
    if row["kind"] != "http":
        return warc_record("resource", [*headers, ("Content-Type", row["mime"] or "application/octet-stream")], content)
    headers += [("WARC-Identified-Payload-Type", row["mime"])] if row["mime"] else []
    headers.append(("Content-Type", "application/http;msgtype=response"))
    if best is None or (best["file"], best["place"]) == (row["file"], row["place"]):
        return warc_record("response", headers, content)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*(best[n] for n in names), row["digest"]))]
    headers += [("WARC-Refers-To-Target-URI", best["url"]), ("WARC-Refers-To-Date", iso_date(best["date"])), ("X-Payload-Length", str(row["length"]))]
    if best["page_id"] is not None:
        headers.append(("X-Refers-To-Page-Id", str(best["page_id"])))
    return warc_record("revisit", headers, content[: row["head"]])


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, least_revisit: int = 0) -> DataFrame:
    """Converts the ARC files in ``arc_path`` (any, of version 1 or 2, packed or not) to
    gzipped WARC files in ``warc_path``.

    HTTP records become ``response``, their head and payload carried over byte for byte;
    others (dns, ftp) ``resource``; the first block ``warcinfo``. Identifiers, times, types
    and digests are made from the ARC record. Of HTTP records with equal payloads of
    ``least_revisit`` bytes or more the one with the largest page_id stays, then the last in
    file order; the others become ``revisit`` and keep their heads. A page_id is known where the
    head has an X-Page-Id field; no other step needs it.

    A first pass reads digests only and finds the payloads that several records share. A
    second joins them to the records by digest; a frequent payload's rows can be split
    by Spark, as nothing is gathered by digest. Where the shared digests are too many to be sent to all tasks, that join
    shuffles the packed contents once.

    Records whose header line, length or date doesn't fit, and the last one of a file that was cut off, are set aside; the result
    is the table of these (as ``read_broken`` gives it), read when it is asked for. A gzipped file that is cut off
    can't be told from a failing disk, so it ends the job."""
    bounded_batches(spark)
    meta = read_arc(spark, arc_path, with_content=False).where((F.col("kind") == "http") & (F.col("length") >= least_revisit))
    best = F.max(F.struct("page_id", "file", "place", "url", "date")).alias("best")
    repeats = saved(meta.groupBy("digest", "length").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1").drop("n"), "repeats")
    rows = read_arc(spark, arc_path).join(repeats, ["digest", "length"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_converted(row) for row in batch.to_pylist()], pa.binary())], ["record"])

    _write_records(rows.select(*_ARC_SCHEMA.names, "best").mapInArrow(run, "record binary"), warc_path, "\r\n\r\n")
    return read_broken(spark, arc_path)


def parse_warc(lines: Iterator[bytes]) -> Iterator[dict]:
    """Responses, revisits and resources of one WARC file; digests of whole payloads are checked."""
    for line in lines:
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record doesn't begin with its version")
        headers: dict[str, str] = {}
        while (field := next(lines)) != b"\r":
            name, _, value = field.decode("utf-8").rstrip("\r").partition(":")
            headers[name.lower()] = value.strip()
        block = _body(lines, int(headers["content-length"]), b"\r")
        if next(lines) != b"\r":
            raise ValueError("a WARC record isn't followed by two line ends")
        kind = headers["warc-type"]
        if kind not in ("response", "revisit", "resource"):
            continue
        head = 0 if kind == "resource" else _head_size(block)
        payload, http = block[head:], _head_fields(block[:head])
        digest = headers.get("warc-payload-digest", f"sha1:{payload_digest(payload)}").removeprefix("sha1:")
        if kind != "revisit" and payload_digest(payload) != digest:
            raise ValueError("a payload doesn't fit its digest")
        row = {"page_id": _page_id(http.get("x-page-id")), "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "record_id": headers["warc-record-id"], "record_type": kind}
        row |= {"mime": headers.get("warc-identified-payload-type") or headers.get("content-type"), "status": headers.get("x-arc-result-code"), "digest": digest}
        row |= {"length": int(headers.get("x-payload-length") or http.get("content-length") or 0) if kind == "revisit" else len(payload), "refers_to": _page_id(headers.get("x-refers-to-page-id"))}
        yield row | {"refers_to_id": headers.get("warc-refers-to"), "head": block[:head], "packed": None if kind == "revisit" else zlib.compress(payload, 1)}


_WARC_SCHEMA = pa.schema(
    [("page_id", pa.int64())]
    + [(name, pa.string()) for name in ("url", "date", "record_id", "record_type", "mime", "status")]
    + [("length", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("head", pa.binary()), ("packed", pa.binary()), ("file", pa.string())]
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, date, record_id, record_type, mime, status, length, digest, refers_to (page),
    refers_to_id, head (of HTTP), packed (the payload, deflated; null for revisits), file of each record."""
    return _parsed(spark, path, parse_warc, _WARC_SCHEMA)


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: str = "1", least_revisit: int = 0) -> DataFrame:
    """Writes pages as ARC files, converts these to WARC, and reads the WARC files.

    A null html is an empty payload, a null URL ``-``; blanks and other characters
    that a header line can't hold are percent-encoded. Null ids rank lowest and stay
    null; of repeated rows one is the response. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col, version=version)
    convert(spark, arc, warc, least_revisit=least_revisit)
    return read_warc(spark, warc)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select(
        "page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


#: SHA-1 in base32 from its hexadecimal digits: five bits of two neighbouring digits a letter.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) || '0' AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    ((instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1)
    // CAST(2 ** (3 - (5 * i) % 4) AS BIGINT)) % 32 AS BIGINT), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest FROM h
), w AS (SELECT payload_digest, payload_bytes, max(page_id) AS best FROM d GROUP BY ALL)
SELECT page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN w ON d.payload_digest = w.payload_digest AND d.payload_bytes = w.payload_bytes
"""
