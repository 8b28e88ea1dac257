"""Legacy archive converter: ARC files (versions 1 and 2) to WARC 1.1, and a reader of what it wrote.

An ARC file starts with a version block; its third line names the version's header fields. Every record is a header
line of those fields, the declared number of bytes, and a newline. The converter reads such files as streams, parses
header lines by their version's fields and bodies by their declared lengths, and synthesises what WARC needs: a record
id (a name-based UUID of the archived place, file and offset), an ISO timestamp from the 14-digit date, a type (response for
an HTTP message, else resource), and block and payload digests. Each file starts with a warcinfo record.

``write`` first packs pages as ARC files of many records, in either version, and keeps an index of them: file, offset, page and
payload digest of each record, as archives come with. Duplicates are found in that index alone, no body is exchanged: of
records with equal payloads of at least ``least`` bytes, that with the smallest id becomes a response, the others revisit it
and keep only their HTTP header. Equality is by SHA-256 and length, found by a grouped minimum.

Files are written by tasks under fresh names; only names that committed tasks returned are read, and no file is held whole.

Defined cases: a null payload is empty; null URLs, types or dates become ``-`` in ARC and placeholders in
WARC; white space in a URL is percent-encoded; rows with a null id are archived as responses and come back
with a null id; several rows with the smallest id are all responses; an empty table makes no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.llm import common

#: Header fields of a record, by version of the ARC format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ARC_SUFFIX, SUFFIX = ".arc.gz", ".warc.gz"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:hitwatch:warc")
#: Rows handed on together.
BATCH_ROWS = 2048


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _word(value: object) -> str:
    """A header field: no white space, ``-`` for nothing."""
    return "%20".join(str(value).split()) if value is not None and str(value).split() else "-"


def http_message(body: bytes, mime: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def http_parts(message: bytes) -> tuple[bytes, bytes]:
    """Header, with its blank line, and body of an HTTP message."""
    end = message.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("HTTP message without end of header")
    return message[: end + 4], message[end + 4 :]


def declared_length(header: bytes) -> int | None:
    """Body length that an HTTP header declares; null where it declares none, or none that is a number."""
    for line in header.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


# --- ARC --------------------------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    """First record of an ARC file."""
    body = f"{version} 0 hitwatch\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://{_word(name)} 0.0.0.0 {date} text/plain {'200 - - 0 ' + _word(name) + ' ' if version == 2 else ''}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, date: str | None, mime: str | None, document: bytes, *, ip: str = "0.0.0.0", offset: int = 0, name: str = "-") -> bytes:
    """One ARC record; version 2 adds result code, checksum, location, offset and file name."""
    middle = ["200", f"{zlib.crc32(document):08x}", "-", str(offset), _word(name)] if version == 2 else []
    return " ".join([_word(url), ip, _word(date), _word(mime), *middle, str(len(document))]).encode() + b"\n" + document + b"\n"


def arc_records(stream: BinaryIO) -> Iterator[tuple[int, dict]]:
    """Offset and header fields by name, with ``document``, of each record of an ARC stream. Damaged files raise ValueError."""
    at, fields = 0, None
    while line := stream.readline():
        if not line.strip(b"\n"):  # the newline after a body
            at += len(line)
            continue
        if not line.endswith(b"\n"):
            raise ValueError("ARC header line without end")
        values = line[:-1].decode("utf-8").split(" ")
        try:
            length = int(values[-1])
        except ValueError:
            raise ValueError(f"no declared length in ARC header {values}") from None
        body = stream.read(length) if length >= 0 else b""
        if length < 0 or len(body) != length:
            raise ValueError("ARC record is shorter than declared")
        if fields is None:
            lines = body.decode("utf-8").splitlines()
            fields = next((f for v, f in ARC_FIELDS.items() if len(lines) > 1 and lines[0].split(" ")[0] == str(v) and tuple(lines[1].split(" ")) == f), None)
            if fields is None or not values[0].startswith("filedesc://"):
                raise ValueError("not an ARC version block")
        else:
            if len(values) != len(fields):
                raise ValueError(f"ARC header has {len(values)} fields, not {len(fields)}")
            yield at, dict(zip(fields, values, strict=True)) | {"document": body}
        at += len(line) + length


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file in memory."""
    return (record for _, record in arc_records(io.BytesIO(data)))


def write_arc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", mime_col: str | None = None, date_col: str | None = None, mime: str = "text/html", date: str = "20240101000000", version: int | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Pack ``pages`` as ARC files under ``folder``; the index of their records: (file, offset, page_id, sha, n).

    ``version`` None takes the versions in turn. A record is a gzip member; files end after ``file_bytes``.
    """
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit("-")) if c else F.lit(default)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), text(mime_col, mime), text(date_col, date), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")))
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("sha", pa.binary()), ("n", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, turn = None, TaskContext.get().partitionId()
        listed: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*listed, strict=True) if listed else [()] * 5, schema, strict=True)], schema=schema)
            listed.clear()
            return made

        for given in batches:
            for row in range(given.num_rows):
                page_id, url, kind, when, body = (c[row].as_py() for c in given.columns)
                if out is None:
                    name, own = f"part-{uuid.uuid4().hex}{ARC_SUFFIX}", version or 1 + turn % 2
                    store.create_dir(root, recursive=True)
                    out, at, written, turn = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, turn + 1
                    record = arc_version_block(own, name, when if when.isdigit() else "19700101000000")
                    out.write(gzip.compress(record, 1, mtime=0))
                    at += len(record)
                record = arc_record(own, url, when, kind, http_message(body, _word(kind)), offset=at, name=name)
                listed.append((name, at, page_id, hashlib.sha256(body).digest(), len(body)))
                packed = gzip.compress(record, 1, mtime=0)
                out.write(packed)
                at += len(record)
                written += len(packed)
                if written >= file_bytes:
                    out.close()
                    out = None
                if len(listed) >= BATCH_ROWS:
                    yield batch()
        if out is not None:
            out.close()
        yield batch()

    return common.Stored(rows.mapInArrow(put, "file string, offset long, page_id long, sha binary, n long"), "arc_index").df


# --- WARC -------------------------------------------------------------------------------------------------------


def iso_date(date: str) -> str:
    """WARC form of a 14-digit date; short dates are filled up, unreadable ones become the epoch."""
    try:
        return datetime.strptime((date + "19700101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, place)}>"


def _warc(kind: str, place: str, date: str, content_type: str, block: bytes, more: list[str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(place)}", f"WARC-Date: {iso_date(date)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(file: str, source: str, date: str) -> bytes:
    block = f"software: hitwatch\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\ndescription: converted from {source}\r\n".encode()
    return _warc("warcinfo", f"info:{file}", date, "application/warc-fields", block, [f"WARC-Filename: {file}"])


def warc_record(record: dict, place: str, page_id: int | None = None, refers_to: int | None = None, refers_place: str | None = None) -> bytes:
    """The WARC record of a parsed ARC record; ``place`` names it, ``refers_to`` makes it a revisit."""
    document, url = record["document"], record["URL"]
    is_http = document.startswith(b"HTTP/")
    header, payload = http_parts(document) if is_http else (b"", document)
    more = [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {record['IP-address']}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if page_id is not None:
        more.append(f"X-Page-Id: {page_id}")
    kind, block = ("response" if is_http else "resource"), document
    if refers_to is not None:
        kind, block = "revisit", header
        more += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_place)}", f"X-Refers-To-Page-Id: {refers_to}"]
    plain = record["Content-type"] if record["Content-type"] != "-" else "application/octet-stream"
    return _warc(kind, place, record["Archive-date"], "application/http; msgtype=response" if is_http else plain, block, more)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("not a WARC record")
            name, value = line[:-2].decode("utf-8").split(": ", 1)
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("WARC record is not as long as declared")
        yield head, block


def _opened(store: fs.FileSystem, path: str) -> io.BufferedReader:
    """Unpacked stream of a gzip file of any number of members."""
    return io.BufferedReader(gzip.GzipFile(fileobj=store.open_input_file(path)), 1 << 16)


def with_owners(index: DataFrame, least: int) -> DataFrame:
    """The index with (owner, owner_place) of records that revisit another page's; no group is gathered and no body moved."""
    place = F.concat_ws("@", "file", F.col("offset").cast("string"))
    marked = index.withColumn("place", place)
    groups = marked.filter(f"n >= {int(least)} AND page_id IS NOT NULL").groupBy("sha", "n").agg(F.min(F.struct("page_id", "place")).alias("first"), F.max("page_id").alias("last"))
    shared = groups.filter("last > first.page_id").select("sha", "n", F.col("first.page_id").alias("owner"), F.col("first.place").alias("owner_place"))
    small = shared.count() <= common.BROADCAST_ROWS  # else adaptive execution splits the rows of a payload that very many share
    joined = marked.join(F.broadcast(shared) if small else shared, ["sha", "n"], "left")
    later = F.col("page_id") > F.col("owner")
    return joined.select("file", "offset", "page_id", F.when(later, F.col("owner")).alias("owner"), F.when(later, F.col("owner_place")).alias("owner_place"))


def convert(index: DataFrame, arc_folder: str, folder: str, *, least: int = 0) -> DataFrame:
    """Convert the indexed ARC files to WARC files under ``folder``, one for each; rows (file, n_records) of what was written."""
    spark = index.sparkSession
    lists = with_owners(index, least).groupBy("file").agg(F.collect_list(F.struct("offset", "page_id", "owner", "owner_place")).alias("records"))  # as many as a file has
    n = index.select("file").distinct().count()
    schema = "file string, n_records long"
    if not n:
        return spark.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, source_root = fs.FileSystem.from_uri(arc_folder)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for file, records in zip(*batch.columns, strict=True):
                known = dict(zip(records.values.field("offset").to_pylist(), zip(*(records.values.field(c).to_pylist() for c in ("page_id", "owner", "owner_place")), strict=True), strict=True))
                arc, name = file.as_py(), f"part-{uuid.uuid4().hex}{SUFFIX}"
                written = 0
                with _opened(source, f"{source_root}/{arc}") as stream, store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for offset, record in arc_records(stream):
                        if not written:
                            out.write(gzip.compress(warcinfo(name, arc, record["Archive-date"]), 6, mtime=0))
                        page_id, owner, owner_place = known[offset]
                        out.write(gzip.compress(warc_record(record, f"{arc}@{offset}", page_id, owner, owner_place), 6, mtime=0))
                        written += 1
                if written != len(known):
                    raise ValueError(f"{arc} has {written} records, its index {len(known)}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], names=["file", "n_records"])

    return common.Stored(lists.repartition(min(n, 20_000)).mapInArrow(work, schema), "warc_files").df


def write(pages: DataFrame, folder: str, *, least: int = 0, **arc) -> DataFrame:
    """Pack ``pages`` as ARC files (see ``write_arc``), convert them to WARC files in ``folder``; the rows of ``convert``."""
    return convert(write_arc(pages, f"{folder}/arc", **arc), f"{folder}/arc", f"{folder}/warc", least=least)


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """A row for each page's record of the listed WARC files that ``write`` made in ``folder``; digests are verified."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string"
    n = files.count()
    if not n:
        return spark.createDataFrame([], schema)
    kinds = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/warc")
        rows: list[tuple] = []

        def give() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows.clear()
            return made

        for batch in batches:
            for file in batch.column(0).to_pylist():
                with _opened(store, f"{root}/{file}") as stream:
                    for head, block in warc_records(stream):
                        if head["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                            raise ValueError(f"digest does not match in record {head['WARC-Record-ID']}")
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, is_http = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["Content-Type"].startswith("application/http")
                        header, payload = http_parts(block) if is_http else (b"", block)
                        declared = declared_length(header) if is_http else None
                        size = len(payload) if declared is None else declared
                        if head["WARC-Type"] != "revisit" and (digest != sha1_base32(payload) or size != len(payload)):
                            raise ValueError(f"digest does not match in record {head['WARC-Record-ID']}")
                        number = lambda k, h=head: int(h[k]) if k in h else None
                        rows.append((number("X-Page-Id"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-Id"), head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Date"]))
                        if len(rows) >= BATCH_ROWS:
                            yield give()
        if rows:
            yield give()

    return files.select("file").repartition(min(n, 20_000)).mapInArrow(take, schema)


#: DuckDB SQL of the records: digests by slicing SHA-1's hex digits into groups of five bits.
ORACLE_SQL = """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS body FROM pages), o AS (SELECT body, min(page_id) AS owner FROM p GROUP BY body),
h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS s, CASE WHEN page_id > owner THEN owner END AS refers_to FROM p JOIN o USING (body))
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i * 5 + 1)::INT, 5))::BIGINT >> b::BIGINT) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM h
"""
