"""WARC records in ZIP packages: write them to files, and read records by byte ranges without extracting a member.

A package is a file on shared storage that holds stored (uncompressed) members: WARC files under archive/, whose records
are gzip members of their own, and CDXJ indexes under indexes/ that say where each record is. The reader seeks: it
fetches the end of the central directory, its ZIP64 form where there is one, the directory, the indexes, and then
records one at a time. WARC files that no index names are read from their start on.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import cut, shared_folder, table

ARCHIVES, INDEXES = "archive/", "indexes/"
#: Payloads from this length on are stored once; a package is closed once it holds so many bytes or records.
REVISIT_FROM, PACKAGE_BYTES, PACKAGE_RECORDS = 1_000, 4_000_000, 4_000
Fetch = Callable[[int, int], bytes]


class BadArchive(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    packed: int
    size: int


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """Replace the values of wanted that are all ones by those of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            body, k, out = extra[at + 4 : at + 4 + size], 0, []
            for value in wanted:
                if value == 0xFFFFFFFF:
                    if k + 8 > len(body):
                        raise BadArchive("a ZIP64 field is cut off")
                    (value,) = struct.unpack_from("<Q", body, k)
                    k += 8
                out.append(value)
            return out
        at += 4 + size
    return wanted


def directory(fetch: Fetch, size: int) -> dict[str, Member]:
    """The members by name, from the central directory; of equal names the last counts."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = fetch(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(tail):
        raise BadArchive("no end of central directory")
    count, length, start = struct.unpack_from("<H2I", tail, end + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = tail_at + end - 20
        found = fetch(locator, 20) if locator >= 0 else b""
        if found[:4] != b"PK\x06\x07":
            raise BadArchive("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", found, 8)
        record = fetch(at, 56)
        if record[:4] != b"PK\x06\x06":
            raise BadArchive("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<3Q", record, 32)
    if start + length > size:
        raise BadArchive("the central directory lies beyond the end")
    listing, at, members = fetch(start, length), 0, {}
    for _ in range(count):
        if listing[at : at + 4] != b"PK\x01\x02":
            raise BadArchive("the central directory is damaged")
        flags, method = struct.unpack_from("<2H", listing, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", listing, at + 20)
        (header,) = struct.unpack_from("<I", listing, at + 42)
        name = listing[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, header = _zip64(listing[at + 46 + n_name : at + 46 + n_name + n_extra], [full, packed, header])
        members[name] = Member(name, method, header, packed, full)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_at(fetch: Fetch, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise BadArchive(f"{member.name} is compressed, so ranges of it can't be read")
    local = fetch(member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise BadArchive(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<2H", local, 26)
    return member.header + 30 + n_name + n_extra


def member_bytes(fetch: Fetch, member: Member) -> bytes:
    """A whole member, such as an index; a deflated one is inflated."""
    if not member.method:
        return fetch(stored_at(fetch, member), member.size)
    if member.method != zipfile.ZIP_DEFLATED:
        raise BadArchive(f"{member.name} is compressed in a way that isn't known")
    raw = fetch(stored_at(fetch, Member(member.name, 0, member.header, member.packed, member.packed)), member.packed)
    return zlib.decompress(raw, -15)


def _line(value: str | None) -> str:
    return quote(value or "", safe="%/:=&?~#+!$,;'@()*[]")


def surt(url: str | None) -> str:
    """A URL's sort key: its host's labels from the last to the first, then the rest."""
    host, slash, rest = _line(url).partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{rest}" if host else "-"


def record(kind: str, ident: str, uri: str | None, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC record; a revisit holds the HTTP head alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    more = f"WARC-Refers-To: <{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" if refers_to else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\nWARC-Target-URI: {_line(uri)}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def _head(block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by their names in lower case, and what follows the blank line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in fields}, rest


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC head, the HTTP head and the payload; without an HTTP block all of the block is payload."""
    fields, rest = _head(raw)
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        raise BadArchive("a record has no type or no length")
    block = rest[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, {}, block
    return fields, *_head(block)


def hex_digest(written: str) -> str:
    """sha1:... as archives write it, in base 32 or in hexadecimal digits, as bare lower-case hexadecimal digits."""
    value = written.rpartition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def package(records: list[tuple[str | None, bytes]], zip64: bool = False, name: str = "data.warc.gz") -> bytes:
    """A ZIP of (url, record)s with their index; equal records give equal bytes. zip64 writes the directory in that form."""
    body, lines = io.BytesIO(), []
    for url, raw in records:
        offset = body.tell()
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        body.write(packer.compress(raw) + packer.flush())
        entry = {"url": _line(url), "length": str(body.tell() - offset), "offset": str(offset), "filename": name}
        lines.append(f"{surt(url)} 20240101000000 {json.dumps(entry)}\n")
    return stored_zip([(ARCHIVES + name, body.getvalue()), (INDEXES + "index.cdxj", "".join(sorted(lines)).encode())], zip64)


def stored_zip(members: list[tuple[str, bytes]], zip64: bool) -> bytes:
    """A ZIP file of stored members; with zip64 all sizes and places stand in ZIP64 fields and records."""
    out, listing = io.BytesIO(), b""
    for name, data in members:
        at, crc, size, full = out.tell(), zlib.crc32(data), len(data), name.encode()
        shown = 0xFFFFFFFF if zip64 else size
        both = struct.pack("<2H2Q", 1, 16, size, size) if zip64 else b""
        three = struct.pack("<2H3Q", 1, 24, size, size, at) if zip64 else b""
        common = struct.pack("<2H", 0x800, 0) + struct.pack("<2HI2I", 0, 0x5821, crc, shown, shown)  # names in UTF-8, stored, 1 January 2024
        out.write(b"PK\x03\x04" + struct.pack("<H", 45) + common + struct.pack("<2H", len(full), len(both)) + full + both + data)
        listing += b"PK\x01\x02" + struct.pack("<2H", 45, 45) + common + struct.pack("<5H2I", len(full), len(three), 0, 0, 0, 0, 0xFFFFFFFF if zip64 else at) + full + three
    start = out.tell()
    out.write(listing)
    if zip64:
        end = out.tell()
        out.write(b"PK\x06\x06" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, len(members), len(members), len(listing), start))
        out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
    n, length, place = (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if zip64 else (len(members), len(listing), start)
    out.write(b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, n, n, length, place, 0))
    return out.getvalue()


def _indexed(fetch: Fetch, members: dict[str, Member]) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of records by the WARC file that holds them, from all CDXJ indexes."""
    found: dict[str, set[tuple[int, int]]] = {}
    for name, member in members.items():
        if not name.startswith(INDEXES) or not name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            continue
        raw = member_bytes(fetch, member)
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
            if "{" in line:
                entry = json.loads(line[line.index("{") :])
                found.setdefault(entry["filename"].removeprefix(ARCHIVES), set()).add((int(entry["offset"]), int(entry["length"])))
    return {k: sorted(v) for k, v in found.items()}


def _members_of_gzip(fetch: Fetch, at: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of a range, fetched step by step; what is inflated isn't kept."""
    begin = read = 0
    held, started, parser = b"", False, zlib.decompressobj(31)
    while held or read < size:
        if not held:
            held = fetch(at + read, min(step, size - read))
            if not held:
                raise BadArchive("an archive is longer than its package")
            read += len(held)
        parser.decompress(held)
        started = True
        held = parser.unused_data if parser.eof else b""
        if parser.eof:
            yield begin, read - len(held) - begin
            begin, started, parser = read - len(held), False, zlib.decompressobj(31)
    if started:
        raise BadArchive("the last record is cut off")


def _plain_records(fetch: Fetch, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an uncompressed WARC file: each head says how long its record is."""
    begin = 0
    while begin < size:
        step = 4096
        while b"\r\n\r\n" not in (head := fetch(at + begin, min(step, size - begin))):
            if step >= size - begin:
                raise BadArchive("the last record is cut off")
            step *= 2
        said = _head(head)[0].get("content-length", "0")
        if not (said.isascii() and said.isdigit()):
            raise BadArchive("a record's length isn't a number")
        length = head.index(b"\r\n\r\n") + 4 + int(said) + 4
        if begin + length > size:
            raise BadArchive("the last record is cut off")
        yield begin, length
        begin += length


class Place(NamedTuple):
    """Where a record lies: its WARC file, offset and length there, and where that is in the package."""

    member: str
    offset: int
    length: int
    start: int
    packed: bool


#: What the libraries raise on damaged bytes.
DAMAGE = (struct.error, zlib.error, gzip.BadGzipFile, EOFError, KeyError, IndexError, ValueError, TypeError, AttributeError, OverflowError, RecursionError)


def _as_bad(rows: Iterator) -> Iterator:
    """The rows, with all that damage raises as BadArchive."""
    try:
        yield from rows
    except BadArchive:
        raise
    except DAMAGE as e:
        raise BadArchive(f"damaged: {type(e).__name__}: {e}") from e


def places(fetch: Fetch, size: int) -> Iterator[Place]:
    """The records of a package: by its indexes, and of WARC files without one by going through them."""
    return _as_bad(_places(fetch, size))


def _places(fetch: Fetch, size: int) -> Iterator[Place]:
    members = directory(fetch, size)
    index = _indexed(fetch, members)
    for name, member in members.items():
        if not name.startswith(ARCHIVES) or not name.removesuffix(".gz").endswith(".warc"):
            continue
        at, short, packed = stored_at(fetch, member), name.removeprefix(ARCHIVES), name.endswith(".gz")
        if at + member.size > size:
            raise BadArchive(f"{name} lies beyond the end")
        found = index[short] if short in index else (_members_of_gzip if packed else _plain_records)(fetch, at, member.size)
        for offset, length in found:
            if offset < 0 or length < 0 or offset + length > member.size:
                raise BadArchive(f"the index names bytes beyond the end of {name}")
            yield Place(short, offset, length, at + offset, packed)


def record_at(fetch: Fetch, start: int, length: int, packed: bool) -> bytes:
    raw = fetch(start, length)
    return gzip.decompress(raw) if packed else raw


def records(fetch: Fetch, size: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(WARC file, offset, length, record) of a package, each by one range of it; damage is BadArchive."""
    return _as_bad((p.member, p.offset, p.length, record_at(fetch, p.start, p.length, p.packed)) for p in _places(fetch, size))


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, payload_bytes, digest, refers_to): refers_to is the largest id of an equal payload, for all but that row itself."""
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    full = named.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    # Only payloads that occur again are joined; a payload that a third of all rows share is one row here, and
    # where the join shuffles, Spark splits it.
    again = cut(full.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where("n > 1 and keeper is not null").select("digest", "keeper"))
    revisit = F.when(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return full.join(again, "digest", "left").withColumn("refers_to", revisit).drop("keeper")


def _open(uri: str, write: bool = False):
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_output_stream(path) if write else files.open_input_file(path)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows as WARC records of packages under folder, a URI that all machines share; (path), a row for each package.

    Ids are integers; a null id is written as such, a null payload is empty, a null URL has an empty target; repeated
    rows each have a record, and very long payloads one each like others. An empty table gives no packages. Other
    columns aren't read. A task that runs again writes other files, and the rows name those of the one that counts.
    Each second package of a task has a ZIP64 directory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, n = uuid.uuid4().hex, [], 0, 0

        def out() -> pa.RecordBatch:
            path = f"{folder}/{own}-{n}.wacz"
            with _open(path, write=True) as f:
                f.write(package(held, zip64=n % 2 == 1))
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string())], ["path"])

        for batch in batches:
            columns = [batch.column(k).cast(pa.binary()) if k == 2 else batch.column(k) for k in range(6)]
            for ident, url, payload, length, digest, refers_to in zip(*(c.to_pylist() for c in columns), strict=True):
                name = f"urn:page:{'' if ident is None else ident}"
                kind = "response" if refers_to is None else "revisit"
                body = payload if refers_to is None else b""
                held.append((url, record(kind, name, url, digest, length, body, None if refers_to is None else f"urn:page:{refers_to}")))
                size += len(held[-1][1])
                if size >= PACKAGE_BYTES or len(held) >= PACKAGE_RECORDS:
                    yield out()
                    held, size, n = [], 0, n + 1
        if held:
            yield out()

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    rows = with_revisits(pages, id_col, url_col, payload_col).select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", "refers_to")
    return cut(rows.mapInArrow(run, "path string"))


RECORD = {"path": "string", "member": "string", "offset": "long", "length": "long", "record_id": "string", "uri": "string", "date": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "string"}
#: Bytes of a package whose records one task reads together, and rows of one batch.
WINDOW, ROWS = 64 << 20, 2000


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def list_records(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """Files by their URIs to (path, member, offset, length, start, packed), a row for each record, from directories and indexes."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path in (x for batch in batches for x in batch.column(0).to_pylist() if x is not None):
            with _open(path) as f:
                for place in places(lambda at, n, f=f: f.read_at(n, at), f.size()):
                    yield (path, *place)

    names = ["path", "member", "offset", "length", "start", "packed"]
    return packages.select(path_col).mapInArrow(lambda batches: _batches(rows(batches), names, kinds), "path string, member string, offset long, length long, start long, packed boolean")


def read_packages(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """Files by their URIs to RECORD, a row for each record of their WARC files, from ranges that are read by seeking.

    Records are listed first and dealt out by windows of WINDOW bytes, so that several tasks read a large package, each
    holding one record at a time. Digests are lower-case hexadecimal digits. A response's length and digest are those of
    the payload that was read, and it is an error if its head says another digest; a revisit's are those that its heads
    say, or null. Packages without records give no rows, null paths neither; a path that is listed twice is read twice;
    a very long record is read whole; damage is an error, BadArchive. An empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, f = None, None
        try:
            for batch in batches:
                for path, member, offset, length, start, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != last:
                        if f is not None:
                            f.close()
                        last, f = path, _open(path)
                    head, http, payload = parse_record(record_at(lambda at, n, f=f: f.read_at(n, at), start, length, packed))
                    kind, said = head["warc-type"], hex_digest(head.get("warc-payload-digest", "")) or None
                    full = http.get("content-length", "")
                    size, digest = (int(full) if full.isdigit() else None, said) if kind == "revisit" else (len(payload), hashlib.sha1(payload).hexdigest())
                    if said and said != digest:
                        raise BadArchive(f"{head.get('warc-record-id')} in {path} doesn't hold what its head says")
                    strip = lambda k, head=head: head[k].strip("<>") if k in head else None
                    yield (path, member, offset, length, strip("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), kind, size, digest, strip("warc-refers-to"))
        finally:
            if f is not None:
                f.close()

    kinds = [pa.string() if kind == "string" else pa.int64() for kind in RECORD.values()]
    # With a number of its own, adaptive execution doesn't merge the partitions, whose rows are small but name much to read.
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = list_records(packages, path_col).repartition(parts, "path", F.floor(F.col("start") / WINDOW)).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(lambda batches: _batches(_as_bad(rows(batches)), list(RECORD), kinds), ", ".join(f"{name} {kind}" for name, kind in RECORD.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records as they are read back from packages on shared storage, which are removed then."""
    folder = shared_folder(spark, "packages")
    found = read_packages(write_packages(table(spark, sf_dir, "pages"), folder))
    page = lambda c: F.nullif(F.replace(c, F.lit("urn:page:")), F.lit("")).cast("long")
    rows = cut(found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))
    files, path = fs.FileSystem.from_uri(folder)
    files.delete_dir(path)
    return rows


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN k ON p.d = k.d
"""
