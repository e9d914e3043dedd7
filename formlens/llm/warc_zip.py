"""WARC records in ZIP packages: writer of bounded archives and range reader of their stored members.

An archive holds ``archive/data.warc`` and ``indexes/index.cdxj``, both stored, not deflated. The reader
takes the end record (or the ZIP64 one), the central directory, the index, and then just the byte
range of each record; nothing is extracted. Archives are files of any store that pyarrow opens, written
and read by the tasks of a table of their paths.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import Names, Scratch

Read = Callable[[int, int], bytes]
WARC, INDEX = "archive/data.warc", "indexes/index.cdxj"
ARCHIVE = pa.schema([("path", pa.string()), ("size", pa.int64())])
RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def warc_record(kind: str, record_id: str, uri: str | None, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c for c in uri or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {uri}"] if uri else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; the payload is what follows the HTTP header (null for a revisit)."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    kind = head.get("warc-type", "")
    ident = lambda x: x.strip("<>").removeprefix("urn:page:") if x else None
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block
    return {"record_id": ident(head.get("warc-record-id")), "record_type": kind, "target_uri": head.get("warc-target-uri"), "digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None, "refers_to": ident(head.get("warc-refers-to")), "payload": None if kind == "revisit" else payload}


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def members(read: Read, size: int) -> dict[str, Member]:
    """Central directory of a ZIP of ``size`` bytes, by member name; ZIP64 records are followed."""
    tail = read(max(0, size - 65557), min(size, 65557))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        where = tail[max(0, at - 20) : at]
        if where[:4] == b"PK\6\7":
            record = read(struct.unpack("<Q", where[8:16])[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, out, p = read(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[p + 10 : p + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        header, = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n].decode("utf-8", "replace")
        more = directory[p + 46 + n : p + 46 + n + extra]
        while len(more) >= 4:  # a ZIP64 field holds those of size, packed size and header offset that don't fit
            tag, long = struct.unpack("<HH", more[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{long // 8}Q", more[4 : 4 + long // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            more = more[4 + long :]
        out[name] = Member(name, method, packed, header)
        p += 46 + n + extra + comment
    return out


def data_start(read: Read, m: Member) -> int:
    """Offset of a stored member's first byte."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed; only stored members can be range-read")
    head = read(m.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    name, extra = struct.unpack("<HH", head[26:30])
    return m.header + 30 + name + extra


def read_records(read: Read, size: int) -> Iterator[tuple[int, dict]]:
    """(offset in the member, record) of every WARC record, by the index where there is one."""
    found = members(read, size)
    if WARC not in found:
        return
    start = data_start(read, found[WARC])
    if INDEX in found:
        for line in read(data_start(read, found[INDEX]), found[INDEX].size).decode().splitlines():
            at = json.loads(line[line.index("{") :])
            yield at["offset"], parse_record(read(start + at["offset"], at["length"]))
        return
    offset = 0
    while offset < found[WARC].size:
        head = read(start + offset, min(65536, found[WARC].size - offset))
        end = head.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError("WARC header too long")
        length = next(int(x.partition(b":")[2]) for x in head[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        total = end + 4 + length + 4
        yield offset, parse_record(read(start + offset, total))
        offset += total


def archive(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of (record id, record) with its index."""
    out, offset, index = io.BytesIO(), 0, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(WARC), "w", force_zip64=True) as f:
            for ident, data in records:
                f.write(data)
                index.append(f"{ident} {json.dumps({'offset': offset, 'length': len(data)})}\n")
                offset += len(data)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
    return out.getvalue()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a URI or local path, and the path in it."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def pack(limit: int, folder: str):
    """Rows page_id, url, payload, digest, record_type, refers_to -> path, size of archives of about ``limit`` bytes (one record at least) in ``folder``.

    An archive is named by its content and moved into place, so a repeated task writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)

        def built(records):
            data = archive(records)
            name = f"{hashlib.sha1(data).hexdigest()}.zip"
            part = f"{root}/{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(data)
            store.move(part, f"{root}/{name}")
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64())], schema=ARCHIVE)

        records, held = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")]
            for i in range(len(batch)):
                page, url, data, digest, kind, refers = (c[i].as_py() for c in columns)
                ident = "" if page is None else str(page)
                record = warc_record(kind, ident, url, digest, None if refers is None else str(refers), data or b"")
                records.append((ident, record))
                held += len(record)
                if held >= limit:
                    yield built(records)
                    records, held = [], 0
        if records:
            yield built(records)

    return run


def write_archives(pages: DataFrame, scratch: Scratch, folder: str | None = None, least: int = 1000, limit: int = 16 << 20) -> DataFrame:
    """(page_id, url, html) -> stored table of the archives written to ``folder`` (one of ``scratch`` if none is given): path, size.

    Null html counts as empty. Of records with equal payloads of at least ``least`` bytes those with
    the largest page_id are responses and the others revisit it; null page_ids never are the largest
    (all stay responses if there is no other). Repeated rows are records of their own. An empty table
    gives no archive.
    """
    data = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"), F.sha1(data).alias("digest"))
    large = F.octet_length("payload") >= least
    # Decided by digests alone; payloads are shuffled only if the repeated digests are too many to broadcast.
    first = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    rows = Names(first, scratch, "repeated").join(rows, ["digest"], "left")
    revisit = large & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))
    return scratch.save(rows.mapInArrow(pack(limit, folder or scratch.qualified("archives")), "path string, size long"), "paths")


def _record_batches(name: str, records, batch: int = 512):
    held: list[dict] = []
    for offset, record in records:
        held.append({"path": name, "offset": offset, **record})
        if len(held) == batch:
            yield pa.RecordBatch.from_pylist(held, schema=RECORD)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=RECORD)


RECORD_DDL = "path string, offset long, record_id string, record_type string, target_uri string, digest string, refers_to string, payload binary"


def read_archives(paths: DataFrame) -> DataFrame:
    """Table whose column ``path`` holds URIs or local paths that pyarrow opens -> one row per WARC record, by range reads only.

    Null paths are left out; a path that repeats repeats its records.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in batches:
            for path in rows.column(0).to_pylist():
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    yield from _record_batches(path, read_records(lambda at, n, f=f: f.read_at(n, at), f.size()))

    return paths.select("path").filter("path is not null").mapInArrow(run, RECORD_DDL)


def page_records(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records read back -> page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes both of its full payload from the response."""
    ident = lambda c: F.expr(f"try_cast({c} as bigint)")
    rows = records.select(ident("record_id").alias("page_id"), "record_type", ident("refers_to").alias("refers_to"), "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    rows = scratch.save(rows, "records")
    asked = rows.filter("record_type = 'revisit'").groupBy("refers_to", "digest").agg(F.count("*").alias("n"))
    kept = rows.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("sha1").alias("digest")).agg(F.max("bytes").alias("full"))
    full = Names(asked.join(kept, ["refers_to", "digest"]), scratch, "revisited")
    out = full.join(rows.filter("record_type = 'revisit'"), ["refers_to", "digest"], "left").unionByName(rows.filter("record_type <> 'revisit'"), allowMissingColumns=True)
    return out.select("page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.coalesce("sha1", "digest").alias("payload_digest"), "record_type", "refers_to")
