"""Legacy web archives: ARC files to WARC files.

``write_arc`` puts pages into ARC files (version 1 or 2), ``arc_records`` parses their version
block, header lines and declared lengths, ``convert`` synthesises the equivalent WARC records
(identifiers, timestamps, types, digests), and ``read_warc`` reads them back.  Each record is a
gzip member of its own, so any record can be reached by its offset.

Files lie in the shared folder.  A task that runs again writes files of another name; only files
that a finished step's table names count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import new_dir, shuffle_partitions, written
from ._arrow import fields, utf8

#: Payloads from this many bytes on are revisited.
LEAST_REVISIT = 1000
#: Fixed values of the formats.
ARC_V1 = b"URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Pages carry no time of their own; archives need one.
ARCHIVED = "20240101000000"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


# ARC

def arc_version_block(name: str, version: int) -> bytes:
    """The record that opens an ARC file and names the fields of its header lines."""
    body = b"%d 0 sparrowmill\n" % version + (ARC_V1 if version == 1 else ARC_V2) + b"\n"
    line = f"filedesc://{name} 0.0.0.0 {ARCHIVED} text/plain "
    line += "" if version == 1 else f"200 - - 0 {name} "
    return line.encode() + str(len(body)).encode() + b"\n" + body + b"\n"


def arc_record(url: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    """A header line with the declared length, the block, and a line feed."""
    safe = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "about:blank"
    more = "" if version == 1 else f"200 {zlib.crc32(block):08x} - {offset} {name} "
    return f"{safe} 0.0.0.0 {ARCHIVED} text/html {more}{len(block)}\n".encode() + block + b"\n"


def parse_version_block(data: bytes) -> list[str]:
    """Field names of an ARC file, in small letters, from its opening record."""
    line, _, rest = data.partition(b"\n")
    length = int(line.rsplit(b" ", 1)[1])
    lines = rest[:length].split(b"\n")
    if not line.startswith(b"filedesc:") or lines[0].split(b" ")[0] not in (b"1", b"2"):
        raise ValueError("not an ARC version block")
    return lines[1].decode().lower().split(" ")


def parse_arc(data: bytes, names: list[str]) -> tuple[dict[str, str], bytes]:
    """The header of a record, by the file's own field names, and its block by declared length."""
    line, _, rest = data.partition(b"\n")
    values = line.decode("ascii").split(" ")
    if len(values) != len(names):
        raise ValueError(f"a header line of {len(values)} fields, {len(names)} named")
    header = dict(zip(names, values, strict=True))
    length = int(header["archive-length"])
    if len(rest) < length:
        raise ValueError("a record is shorter than declared")
    return header, rest[:length]


def http_block(page: int | None, payload: bytes) -> bytes:
    """An HTTP response of a page; its head tells the page's id, unless that is null, and the length."""
    marks = f"X-Page-Id: {page}\r\n" if page is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{marks}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields, head with its blank line, payload) of an HTTP response."""
    at = block.index(b"\r\n\r\n") + 4
    lines = block[: at - 4].decode("latin-1").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, block[:at], block[at:]


# WARC

def convert(header: dict[str, str], block: bytes, where: str, refers_to: str | None = None) -> bytes:
    """The WARC record that is equivalent to an ARC record, ``where`` naming its place.

    With ``refers_to`` it is a revisit of that record: the HTTP head stays, the payload goes, and
    the digest and the declared length tell of it.
    """
    _, head, payload = http_parts(block)
    digest = hashlib.sha1(payload).digest()
    body = head if refers_to else block
    when = datetime.strptime(header["archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(where)}",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {header['url']}",
        f"WARC-IP-Address: {header['ip-address']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}",
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record_id(where: str) -> str:
    """The identifier of the record that is made of the one at a place; the same for every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, where)}>"


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header of a WARC record, names in small letters, and its block by declared length."""
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return header, data[at + 4 : at + 4 + int(header["content-length"])]


def members(stream, most: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member of a stream, one in memory at a time."""
    rest, offset = stream.read(most), 0
    while rest:
        unpack, out, size = zlib.decompressobj(31), [], 0
        while True:
            out.append(unpack.decompress(rest))
            size += len(rest) - len(unpack.unused_data)
            if unpack.eof:
                break
            rest = stream.read(most)
            if not rest:
                raise ValueError("a gzip member ends early")
        yield offset, size, b"".join(out)
        offset += size
        rest = unpack.unused_data or stream.read(most)


INDEX = fields(file=T.StringType(), offset=T.LongType(), length=T.LongType(), fields=T.StringType(), page_id=T.LongType(), digest=T.StringType(), payload_bytes=T.LongType())
FILES = fields(path=T.StringType(), records=T.LongType())
READ = fields(page_id=T.LongType(), payload_bytes=T.LongType(), payload_digest=T.StringType(), record_type=T.StringType(), record_id=T.StringType(), refers_to_id=T.StringType())


def write_arc(pages: DataFrame) -> DataFrame:
    """An ARC file for each part of ``pages``, of version 1 and 2 in turn; one row a file."""
    where = new_dir(pages.sparkSession, "arc")

    def run(batches):
        name, sink, count, version = f"part-{uuid.uuid4().hex}.arc.gz", None, 0, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                version = 1 + batch.column("part")[0].as_py() % 2
                fs, path = place(f"{where}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path, compression=None)
                sink.write(gzip.compress(arc_version_block(name, version), 6, mtime=0))
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), strict=True):
                sink.write(gzip.compress(arc_record(url or "", http_block(page, html), version, name, sink.tell()), 6, mtime=0))
                count += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{where}/{name}"]), pa.array([count], pa.int64())], names=FILES.names)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.spark_partition_id().alias("part"))
    return written(rows.mapInArrow(run, FILES), "arc-files")


def arc_records(files: DataFrame) -> DataFrame:
    """The index of ARC files: place, page, payload digest and length of every record."""

    def run(batches):
        for batch in batches:
            for file in batch.column("path").to_pylist():
                fs, path = place(file)
                rows, names = [], None
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, length, data in members(stream):
                        if names is None:
                            names = parse_version_block(data)
                            continue
                        http, _, payload = http_parts(parse_arc(data, names)[1])
                        page = http.get("x-page-id")
                        rows.append((file, offset, length, " ".join(names), int(page) if page is not None else None, hashlib.sha1(payload).hexdigest(), len(payload)))
                for a in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[a : a + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=INDEX.names)

    return files.select("path").repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(run, INDEX)


def to_warc(files: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """WARC files equivalent to ARC files; one row a file.

    Of records with equal payloads of at least ``least`` bytes, that of the largest page is the
    response that the others revisit.  The index alone is shuffled; payloads are read from the
    ARC file and written to its WARC file.
    """
    index = written(arc_records(files), "arc-index")
    chosen = index.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "file", "offset")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    named = index.join(chosen, "digest", "left")
    other = F.col("kept").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("kept").eqNullSafe(F.struct("page_id", "file", "offset"))
    named = named.withColumn("refers_to", F.when(other, F.concat_ws("#", "kept.file", F.col("kept.offset").cast("string"))))
    where = new_dir(files.sparkSession, "warc")
    plan = named.select("file", "offset", "length", "fields", "refers_to").repartition(shuffle_partitions(files.sparkSession), "file").sortWithinPartitions("file", "offset")

    def run(batches):
        now, source, sink, count = None, None, None, 0
        for batch in batches:
            for file, offset, length, names, target in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length", "fields", "refers_to")], strict=True):
                if file != now:
                    if now is not None:
                        source.close()
                        sink.close()
                        yield _file(name, count)
                    now, count = file, 0
                    fs, path = place(file)
                    source = fs.open_input_file(path)
                    name = f"{where}/{re.sub(r'[.]arc[.]gz$', '', file.rpartition('/')[2])}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, to = place(name)
                    out.create_dir(to.rpartition("/")[0], recursive=True)
                    sink = out.open_output_stream(to, compression=None)
                source.seek(offset)
                header, block = parse_arc(gzip.decompress(source.read(length)), names.split(" "))
                sink.write(gzip.compress(convert(header, block, f"{file}#{offset}", record_id(target) if target else None), 6, mtime=0))
                count += 1
        if now is not None:
            source.close()
            sink.close()
            yield _file(name, count)

    return written(plan.mapInArrow(run, FILES), "warc-files")


def _file(path: str, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=FILES.names)


def read_warc(files: DataFrame) -> DataFrame:
    """Every record of WARC files, by its own headers; a revisit's payload isn't needed."""

    def run(batches):
        for batch in batches:
            for file in batch.column("path").to_pylist():
                fs, path = place(file)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for _, _, data in members(stream):
                        header, block = parse_warc(data)
                        http, _, payload = http_parts(block)
                        digest = base64.b32decode(header["warc-payload-digest"].removeprefix("sha1:"))
                        if header["warc-type"] == "response" and hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"a payload of {file} doesn't match its digest")
                        page = http.get("x-page-id")
                        rows.append((int(page) if page is not None else None, int(http["content-length"]), digest.hex(), header["warc-type"], header["warc-record-id"], header.get("warc-refers-to")))
                for a in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[a : a + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True)], names=READ.names)

    return files.select("path").repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(run, READ)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` through ARC files into WARC files and back: a row for each row of ``pages``.

    A null html is an empty payload, a null url becomes about:blank; repeated rows are records of
    their own, of which one of the largest page is the response; a null page stays null.
    """
    records = written(read_warc(to_warc(write_arc(pages))), "warc-records")
    heads = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    back = records.where("record_type = 'revisit'").join(heads, "refers_to_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return back.union(records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")))
