"""Legacy archive converter: ARC files of versions 1 and 2 to WARC 1.1.

An ARC file opens with a version block that names its version and the fields of all record header
lines; every record is one such line, the declared number of content bytes and a line feed. The
converter reads by those declared lengths, never by searching content, and synthesises for each
record a WARC identifier, ISO timestamp, type and SHA-1 digests. Files are sequences of gzip
members, one a record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.common import materialize, shared_path

# Fixed values of the two ARC versions: the fields of a record's header line, in order.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 5000
FILE_BYTES = 64 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=1, mtime=0)


def members(uri: str) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    with files.open_file(uri) as source:
        left, unpack, parts = b"", zlib.decompressobj(31), []
        while True:
            chunk = left or source.read(1 << 20)
            if not chunk:
                break
            parts.append(unpack.decompress(chunk))
            left = b""
            if unpack.eof:
                yield b"".join(parts)
                left, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
        if any(parts):
            raise ValueError(f"{uri}: the last member is cut off")


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = ["200", "-", "-", "0", name] if version == 2 else []
    return " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *extra, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, content: bytes, name: str = "-") -> bytes:
    extra = ["200", "-", "-", "0", name] if version == 2 else []
    return " ".join([url, ip, date, kind, *extra, str(len(content))]).encode() + b"\n" + content + b"\n"


def parse_arc(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record of an ARC file, given as its members' bytes.

    The version block's field line decides how header lines split; as URLs may hold spaces, all
    fields but the first are counted from the right.
    """
    fields = None
    for block in blocks:
        at = 0
        while at < len(block):
            if block[at : at + 1] in (b"\n", b"\r"):  # writers differ in the blank lines between records
                at += 1
                continue
            end = block.index(b"\n", at)
            line = block[at:end].decode("utf-8", "replace").rstrip("\r")
            if fields is None:
                length = int(line.rsplit(" ", 1)[1])
                body = block[end + 1 : end + 1 + length]
                version, names = body.decode().split("\n")[:2]
                fields = names.split(" ")
                if fields != ARC_FIELDS.get(int(version.split(" ")[0])):
                    raise ValueError(f"unknown ARC version or fields: {version!r}, {names!r}")
            else:
                values = line.rsplit(" ", len(fields) - 1)
                if len(values) != len(fields):
                    raise ValueError(f"header line has {len(values)} of {len(fields)} fields: {line[:200]!r}")
                header = dict(zip(fields, values))
                length = int(header["Archive-length"])
                content = block[end + 1 : end + 1 + length]
                if len(content) != length:
                    raise ValueError(f"record of {header['URL'][:200]!r} is shorter than declared")
                yield header, content
            at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and body; no header block: all is body."""
    if content.startswith(b"HTTP/"):
        at = content.find(b"\r\n\r\n")
        if at >= 0:
            return content[: at + 4], content[at + 4 :]
    return b"", content


def synthesise(header: dict[str, str], content: bytes) -> dict[str, str]:
    """WARC identifier, timestamp, target and payload digest of an ARC record."""
    date = header["Archive-date"].ljust(14, "0")
    _, payload = split_http(content)
    digest = sha1_base32(payload)
    name = "\n".join([header["URL"], date, digest, sha1_base32(content)])
    return {
        "id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        "url": header["URL"],
        "ip": header["IP-address"],
        "digest": digest,
        "bytes": len(payload),
    }


def warc_record(kind: str, made: dict, content: bytes, refers_to: dict | None = None) -> bytes:
    """A response or, with ``refers_to`` (id, url, date, page), a revisit that leaves the body out."""
    http, payload = split_http(content)
    block = content if kind != "revisit" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {made['id']}",
        f"WARC-Date: {made['date']}",
        f"WARC-Target-URI: {made['url']}",
        f"WARC-IP-Address: {made['ip']}",
        f"WARC-Payload-Digest: sha1:{made['digest']}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to['id']}", f"X-Refers-To-Page: {refers_to['page']}"]
    lines += ["Content-Type: application/http; msgtype=response" if http else "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each WARC record."""
    for data in blocks:
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            header = dict(line.split(": ", 1) for line in lines[1:])
            length = int(header["Content-Length"])
            yield header, data[end + 4 : end + 4 + length]
            at = end + 4 + length + 4


_PAGE = re.compile(rb"\r\nX-Page-ID: (-?\d+)\r\n")


def _page_id(content: bytes) -> int | None:
    found = _PAGE.search(split_http(content)[0])
    return int(found[1]) if found else None


def pages_to_arc(pages: DataFrame, version: int = 2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write rows as ARC files; returns ``(path)`` per file. Null html is empty; spaces in URLs are escaped."""
    folder = shared_path(pages.sparkSession, "arc")
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, paths, count, size = None, [], 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is not None and (count >= RECORDS_PER_FILE or size >= FILE_BYTES):
                    out.close()
                    out = None
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.arc.gz", 0, 0
                    out = files.create(f"{folder}/{name}")
                    paths.append(f"{folder}/{name}")
                    out.write(_member(arc_version_block(version, name, "20240101000000")))
                payload = (html or "").encode()
                mark = "" if page_id is None else f"X-Page-ID: {page_id}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
                out.write(_member(arc_record(version, target, "127.0.0.1", "20240101000000", "text/html", http.encode() + payload, name)))
                count += 1
                size += len(payload)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return materialize(rows.mapInArrow(run, "path string"), "arc-files")


def _spread(paths: DataFrame) -> DataFrame:
    return paths.repartition(max(1, paths.count()))


def scan_arc(paths: DataFrame) -> DataFrame:
    """Synthesised metadata of all records: ``path, nth, page_id, record_id, digest, bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for nth, (header, content) in enumerate(parse_arc(members(path))):
                    made = synthesise(header, content)
                    rows.append((path, nth, _page_id(content), made["id"], made["digest"], made["bytes"]))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "nth", "page_id", "record_id", "digest", "bytes"]
                )

    schema = "path string, nth long, page_id long, record_id string, digest string, bytes long"
    return materialize(_spread(paths).mapInArrow(run, schema), "arc-scan")


def arc_to_warc(paths: DataFrame, min_payload: int = 0) -> DataFrame:
    """Convert ARC files to WARC files, one to one; returns ``(path)`` per WARC file.

    Of records with equal payloads (SHA-1 and length) of at least ``min_payload`` bytes, the one
    with the largest page id is a response and the others are revisits of it. Records without a
    page id revisit it too; if no record of a group has one, all are responses. Records that share
    the largest page id are all responses.
    """
    folder = shared_path(paths.sparkSession, "warc")
    files.make_folder(folder)
    scan = scan_arc(paths)
    # one row per payload: the largest page and its record; combined map-side, however hot
    target = (
        scan.where(F.col("bytes") >= min_payload)
        .groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "record_id")).alias("top"), F.count(F.lit(1)).alias("size"))
        .where("size > 1 and top.page_id is not null")
        .select("digest", "bytes", F.col("top.page_id").alias("page"), F.col("top.record_id").alias("id"))
    )
    revisits = scan.join(target, ["digest", "bytes"]).where("page_id is null or page_id <> page")
    plan = (
        scan.select("path")
        .distinct()
        .join(revisits.groupBy("path").agg(F.collect_list(F.struct("nth", "page", "id")).alias("revisits")), "path", "left")
    )
    plan = materialize(plan, "warc-plan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {x["nth"]: x for x in revisits or []}
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                with files.create(name) as out:
                    for nth, (header, content) in enumerate(parse_arc(members(path))):
                        ref = known.get(nth)
                        out.write(_member(warc_record("revisit" if ref else "response", synthesise(header, content), content, ref)))
                done.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return materialize(_spread(plan).mapInArrow(run, "path string"), "warc-files")


def read_warc(paths: DataFrame) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, date, payload``.

    Checks that the blocks match their digests. The payload of a revisit is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for header, block in parse_warc(members(path)):
                    if header["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
                        raise ValueError(f"{path}: damaged block of {header['WARC-Record-ID']}")
                    kind, page = header["WARC-Type"], header.get("X-Refers-To-Page")
                    payload = split_http(block)[1] if kind == "response" else None
                    rows.append(
                        (
                            _page_id(block),
                            header["WARC-Target-URI"],
                            kind,
                            int(header["X-Payload-Length"]) if payload is None else len(payload),
                            header["WARC-Payload-Digest"].removeprefix("sha1:"),
                            int(page) if page else None,
                            header["WARC-Record-ID"],
                            header["WARC-Date"],
                            payload,
                        )
                    )
                    size += len(block)
                    if size >= 16 << 20:
                        yield _warc_batch(rows)
                        rows, size = [], 0
                yield _warc_batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, date string, payload binary"
    return _spread(paths).mapInArrow(run, schema)


def _warc_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "date", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
