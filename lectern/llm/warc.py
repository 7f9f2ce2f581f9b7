"""Legacy ARC archives, and their conversion to WARC (operator 9).

``scan_arc`` reads archives of either version, plain or gzip, made by anyone: the version block names the fields of header
lines, each header line declares its record's length. ``write_arc`` makes such archives from pages. ``convert`` writes the
equivalent WARC record of every ARC record: identifier, date, type and digests are synthesised from the record's place, its
14-digit date, its URL and its payload. ``read_records`` reads WARC records by range, ``read_warc`` whole archives. Payloads
travel through the archives only; what Spark shuffles are index rows, dealt over tasks by the bytes that they stand for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_by_bytes, materialise, new_path
from .store import Appender, Ranges, open_fs

# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
# A record lies at inner .. inner + size of the unpacked gzip member at offset .. offset + length, or there in a plain file.
PLACE = "shard string, offset long, length long, inner long, size long, packed boolean, version int"
INDEX = f"page_id long, {PLACE}, payload_bytes long, digest binary"
RECORDS = "page_id long, record_id string, record_type string, target string, date string, payload_bytes long, payload_digest string, refers_to_id string"
WRITTEN = "page_id long, path string, offset long, length long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """``rows`` as columns of ``schema`` ("name type, ...")."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gunzip(data: bytes) -> bytes:
    return zlib.decompressobj(31).decompress(data)


def arc_url(url: str | None) -> str:
    """A URL fit for a space-separated header line: blanks and control bytes become percent escapes."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")


def arc_record(version: int, url: str, date: str, kind: str, content: bytes, name: str, offset: int, ip: str = "0.0.0.0") -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Archive-length": str(len(content)), "Result-code": "200"}
    values |= {"Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lectern\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    line += f" {len(body)}" if version == 1 else f" 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def parse_version_block(data: bytes) -> tuple[int, tuple[str, ...]]:
    """(version, field names of the file's header lines)."""
    lines = data.split(b"\n")
    if not lines[0].startswith(b"filedesc://") or len(lines) < 3:
        raise ValueError("not an ARC version block")
    version, fields = int(lines[1].split()[0]), tuple(lines[2].decode("latin-1").split())
    if fields != ARC_FIELDS.get(version):
        raise ValueError(f"unknown ARC version {version} with fields {fields}")
    return version, fields


def parse_header(fields: tuple[str, ...], line: bytes) -> dict[str, str]:
    """The values of a header line; what stands before the last ones is the URL, blanks and all."""
    values = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
    if len(values) != len(fields) or not values[-1].isdecimal():
        raise ValueError(f"not a header line of {len(fields)} fields: {line[:200]!r}")
    return dict(zip(fields, values, strict=True))


def parse_arc_record(fields: tuple[str, ...], data: bytes) -> tuple[dict[str, str], bytes]:
    """Header values and content of one record; its declared length must be there, with a line end after it."""
    line, _, rest = data.partition(b"\n")
    head = parse_header(fields, line)
    size = int(head["Archive-length"])
    if len(rest) < size or rest[size : size + 1] not in (b"\n", b"\r", b""):
        raise ValueError("the declared length doesn't fit")
    return head, rest[:size]


def iso_date(date: str) -> str:
    """14 digits (or fewer, the rest being lowest) as a WARC date."""
    d = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(shard: str, offset: int, inner: int = 0) -> str:
    """The WARC identifier that stands for an ARC record, from the archive's name and the record's place in it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{shard.rpartition('/')[2]}#{offset}' + (f'+{inner}' if inner else ''))}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one unpacked WARC member."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("the declared length doesn't fit")
        yield head, block
        at = end + 4 + size + 4


def members(read, size: int, step: int = 4_000_000) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of the gzip members of a file, one at a time; read(offset, length) gives bytes."""
    packer, parts, at, held, start = zlib.decompressobj(31), [], 0, b"", 0
    while held or at < size:
        if not held:
            held = read(at, min(step, size - at))
            at += len(held)
            if not held:
                raise ValueError("the file is shorter than its size")
        parts.append(packer.decompress(held))
        held = packer.unused_data
        if packer.eof:
            yield start, at - len(held) - start, b"".join(parts)
            packer, parts, start = zlib.decompressobj(31), [], at - len(held)
    if parts:
        raise ValueError("the last gzip member is cut off")


def http_block(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, body) of an HTTP answer; anything else is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def write_arc(pages: DataFrame, folder: str, version: int | None = 1, date: str = "20240101000000", file_bytes: int = 256_000_000, packed: bool = True) -> DataFrame:
    """Pages (page_id, url, html) as ARC files; returns (and writes) the index.

    ``version`` None: tasks take turns with versions 1 and 2. A null html is an empty payload, a null url "about:blank", a
    null page_id stays null; repeated rows are records of their own; an empty table makes no file. ``packed``: each record
    a gzip member, else plain files. Other columns are not looked at.
    """
    pack = gzip_member if packed else bytes

    def write(batches):
        out = None
        mine = version or 1 + TaskContext.get().partitionId() % 2
        try:
            for batch in batches:
                rows = []
                for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                    if out is None or out.size > file_bytes:
                        if out is not None:
                            out.close()
                        out = Appender(folder, ".arc.gz" if packed else ".arc")
                        name = out.uri.rpartition("/")[2]
                        out.add(pack(arc_version_block(mine, name, date)))
                    payload = (html.as_py() or "").encode()
                    record = arc_record(mine, arc_url(url.as_py()), date, "text/html", http_block(payload), name, out.size)
                    data = pack(record)
                    at = out.add(data)
                    place = (out.uri, at, len(data), 0, len(record), packed, mine)
                    rows.append((page_id.as_py(), *place, len(payload), hashlib.sha1(payload).digest()))
                if rows:
                    yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return materialise(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, INDEX), "arc-index")


def arc_places(read, size: int) -> Iterator[tuple[int, int, int, int, bool, int, dict[str, str], bytes]]:
    """(offset, length, inner, size, packed, version, header values, content) of a file's records, in order.

    Records follow each other by their declared lengths, with any number of line ends between them. A gzip file may hold a
    record a member, or any number of records in one; a plain file is read record by record.
    """

    def records(data: bytes, fields: tuple[str, ...]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = data.find(b"\n", at)
            if end < 0:
                raise ValueError("a header line without an end")
            head = parse_header(fields, data[at:end])
            stop = end + 1 + int(head["Archive-length"])
            if stop > len(data):
                raise ValueError("the declared length doesn't fit")
            yield at, stop - at, head, data[end + 1 : stop]
            at = stop

    def version_of(data: bytes) -> tuple[int, tuple[str, ...], int]:
        """Version, fields and end of the version block at the beginning of ``data``."""
        version, fields = parse_version_block(data)
        line = data[: data.index(b"\n")]
        return version, fields, len(line) + 1 + int(line.split()[-1])

    if read(0, 2) == b"\x1f\x8b":
        version, fields = 0, ()
        for offset, length, data in members(read, size):
            skip = 0
            if not version:
                version, fields, skip = version_of(data)
            for inner, n, head, content in records(data[skip:] if skip else data, fields):
                yield offset, length, skip + inner, n, True, version, head, content
        return
    front = read(0, min(size, 65_536))
    version, fields, at = version_of(front)
    while at < size:
        line = read(at, min(65_536, size - at))
        blank = len(line) - len(line.lstrip(b"\r\n"))
        if blank:
            at += blank
            continue
        while (end := line.find(b"\n")) < 0 and at + len(line) < size:
            line = read(at, min(2 * len(line), size - at))
        if end < 0:
            raise ValueError("a header line without an end")
        n = end + 1 + int(parse_header(fields, line[:end])["Archive-length"])
        head, content = parse_arc_record(fields, read(at, n))
        yield at, n, 0, n, False, version, head, content
        at += n


def scan_arc(paths: DataFrame) -> DataFrame:
    """The index of ARC archives (path) of either version, plain or gzip; returns (and writes) it. page_id is null.

    A file is read from front to end by one task; a damaged one fails with its name.
    """

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = open_fs(path)
                rows = []
                try:
                    with system.open_input_file(at) as f:
                        for *place, head, content in arc_places(lambda o, n: f.read_at(n, o), f.size()):
                            body = http_parts(content)[1]
                            rows.append((None, path, *place, len(body), hashlib.sha1(body).digest()))
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                yield _batch(rows, INDEX)

    return materialise(paths.select("path").repartition("path").mapInArrow(scan, INDEX), "arc-index")


def mark_revisits(index: DataFrame, least: int = 1000) -> DataFrame:
    """The index with ``first``, the place of the record that an equal payload of ``least`` bytes or more repeats.

    Of equal payloads the record with the largest page_id comes first (null is smallest, then the last place); it and small
    ones have nulls. Only payloads that repeat are listed, and small records meet that list in no join.
    """
    place = ["shard", "offset", "inner"]
    large, key = F.col("payload_bytes") >= least, ["digest", "payload_bytes"]
    first = index.where(large).groupBy(*key).agg(F.max(F.struct("page_id", *place)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # both sides are written tables, so Spark can split the records of a payload that a large share of the pages hold
    first = materialise(first, "repeated")
    joined = index.where(large).hint("merge").join(first, key, "left")
    small = index.where(~F.coalesce(large, F.lit(False))).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    joined = joined.unionByName(small)
    own = (F.col("first.shard") == F.col("shard")) & (F.col("first.offset") == F.col("offset")) & (F.col("first.inner") == F.col("inner"))
    first = F.when(F.col("first").isNotNull() & ~own, F.col("first"))
    kept = ["page_id", *(x.split()[0] for x in PLACE.split(", "))]
    return joined.select(*kept, *(first[c].alias(f"first_{c}") for c in place))


def warc_of(head: dict[str, str], content: bytes, own: str, first: str | None) -> bytes:
    """The WARC record that stands for an ARC record of identifier ``own``; with ``first``, a revisit of that one.

    HTTP answers become responses; what else an ARC file holds (name look-ups, say) become resources of its own type.
    """
    http, payload = http_parts(content)
    kind = "revisit" if first else "response" if http else "resource"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    block = http if first else content
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", iso_date(head["Archive-date"])), ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"])]
    headers += [("Content-Type", "application/http; msgtype=response" if http else head["Content-type"]), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block))]
    if first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", first)]
    return warc_record(headers, block)


def convert(marked: DataFrame, folder: str, file_bytes: int = 1_000_000_000) -> DataFrame:
    """ARC records as WARC archives in ``folder``, in the order of the ARC files; returns (and writes) where each lies."""

    def write(batches):
        ranges, out, at, data = Ranges(), None, None, b""
        try:
            for batch in batches:
                rows = []
                for page_id, shard, offset, length, inner, size, packed, version, *first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != (shard, offset):  # records of one gzip member come one after another
                        at, data = (shard, offset), ranges.read(shard, offset, length)
                        data = gunzip(data) if packed else data
                    head, content = parse_arc_record(ARC_FIELDS[version], data[inner : inner + size])
                    if out is None or out.size > file_bytes:
                        if out is not None:
                            out.close()
                        out = Appender(folder, ".warc.gz")
                        about = b"software: lectern\r\nformat: WARC File Format 1.0\r\n"
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(out.uri, 0)), ("WARC-Date", iso_date(head["Archive-date"]))]
                        out.add(gzip_member(warc_record([*info, ("Content-Type", "application/warc-fields")], about)))
                    made = gzip_member(warc_of(head, content, record_id(shard, offset, inner), record_id(*first) if first[0] is not None else None))
                    rows.append((page_id, out.uri, out.add(made), len(made)))
                if rows:
                    yield _batch(rows, WRITTEN)
        finally:
            ranges.close()
            if out is not None:
                out.close()

    return materialise(dealt_by_bytes(marked, "shard", "offset", "inner").mapInArrow(write, WRITTEN), "warc-index")


def _read_back(head: dict[str, str], block: bytes, page_id: int | None) -> tuple | None:
    """A row of RECORDS; None for other types of record. A payload must have the digest that its record declares."""
    kind = head["warc-type"]
    if kind not in ("response", "resource", "revisit"):
        return None
    body = http_parts(block)[1]
    declared = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind != "revisit" and hashlib.sha1(body).hexdigest() != declared:
        raise ValueError("the payload doesn't match its digest")
    size = None if kind == "revisit" else len(body)
    return page_id, head["warc-record-id"], kind, head["warc-target-uri"], head["warc-date"], size, declared, head.get("warc-refers-to")


def read_records(written: DataFrame) -> DataFrame:
    """Records by range reads of the archives, as ``convert`` placed them; payload digests are computed anew.

    ``payload_bytes`` is null for revisits; digests are bare lower-case hex.
    """

    def read(batches):
        ranges = Ranges()
        try:
            for batch in batches:
                rows = []
                for page_id, path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows += [_read_back(head, block, page_id) for head, block in parse_warc(gunzip(ranges.read(path, offset, length)))]
                yield _batch(rows, RECORDS)
        finally:
            ranges.close()

    return dealt_by_bytes(written, "path", "offset").select("page_id", "path", "offset", "length").mapInArrow(read, RECORDS)


def read_warc(paths: DataFrame) -> DataFrame:
    """As ``read_records``, of whole archives (path) read from front to end, one a task at a time; page_id is null."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = open_fs(path)
                with system.open_input_file(at) as f:
                    rows = []
                    for _, _, member in members(lambda o, n: f.read_at(n, o), f.size()):
                        rows += filter(None, (_read_back(head, block, None) for head, block in parse_warc(member)))
                        if len(rows) >= 5000:
                            yield _batch(rows, RECORDS)
                            rows = []
                    yield _batch(rows, RECORDS)

    return paths.select("path").repartition("path").mapInArrow(read, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take size and page of the response they name.

    Only records that name one are joined, as null keys would all go to one task.
    """
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    joined = records.where("refers_to_id IS NOT NULL").join(first, "refers_to_id", "left")
    joined = joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    alone = records.where("refers_to_id IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return alone.unionByName(joined)


def pages_to_warc(pages: DataFrame, version: int | None = 1, least: int = 1000) -> DataFrame:
    """Pages through ARC into WARC archives in the shared folder, and the records read back (written once).

    One record a row: a null html has an empty payload, a null url is "about:blank", a null page_id stays null, and rows
    that repeat, or share a page_id, are records of their own. Of equal payloads of ``least`` bytes or more one is the
    response: that of the largest page_id, and among equal page_ids the last place. Other columns are not looked at; an
    empty table gives no records.
    """
    spark = pages.sparkSession
    index = write_arc(pages, new_path(spark, "arc"), version)
    return materialise(read_records(convert(mark_revisits(index, least), new_path(spark, "warc"))), "warc-records")


def archives_to_warc(paths: DataFrame, least: int = 1000) -> DataFrame:
    """The records of any ARC archives (path), converted to WARC in the shared folder and read back."""
    spark = paths.sparkSession
    return materialise(read_records(convert(mark_revisits(scan_arc(paths), least), new_path(spark, "warc"))), "warc-records")
