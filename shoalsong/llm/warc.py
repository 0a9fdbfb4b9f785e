"""WARC archives: written with an index, read back by coalesced byte ranges.

`write_archives` writes one gzip member per record and returns the index: where
each record lies, its URL and its payload digest. `index_archives` makes the
same index of archives that others wrote. A reader selects index rows first;
`read_records` then sorts them by place, joins neighbouring ranges into one
read, and parses only the selected records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalsong.llm.tables import partitions, staged
from shoalsong.sources.workspace import new_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Size at which an archive is closed; ranges closer than GAP are read at once, up to SPAN bytes.
ARCHIVE_BYTES, GAP, SPAN = 1 << 30, 64 << 10, 8 << 20
CHUNK = 1 << 20

INDEX = "record_id string, url string, digest string, record_type string, path string, offset bigint, length bigint"
RECORD = ("record_id string, url string, record_type string, refers_to string, payload_digest string, "
          "payload_bytes bigint, payload binary")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w[\w+.-]*:", path) else "file://" + path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    """As one header value: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: a response, or a revisit of `refers_to`, which holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
             f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_uri(url)}"] if url else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The parts of one record; payload is None in a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length") or 0)]
    kind = fields.get("warc-type")
    size, payload = None, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(found[1]) if found else None
    elif kind != "revisit":
        payload = block
    payload = None if kind == "revisit" else payload
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None, "url": fields.get("warc-target-uri"),
        "record_type": kind, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None if payload is None
        else sha1_base32(payload),
        "payload_bytes": size if payload is None else len(payload), "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html); returns the index, with page_id.

    The payload is the html in UTF-8, null is empty. Of equal payloads of at
    least min_bytes, the row with the smallest page_id is the response and the
    others revisit it; rows that share that page_id are all responses, and so
    are all if none of them has a page_id. A null url gives no Target-URI.
    Other columns are ignored; an empty table writes nothing.

    A task names its files after its own attempt. The index lists only what
    finished tasks wrote, so files of lost attempts are never read.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Only digests that repeat are joined; a digest with very many rows is split by the adaptive join.
    rows = rows.join(staged(firsts, "firsts"), "sha1", "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("first") != F.coalesce("page_id", F.col("first") + 1),
                                                           F.col("first")).alias("refers_to"))

    def run(batches):
        name = f"{folder}/{uuid.uuid4().hex}"
        system, path, out, at, number = None, "", None, 0, 0
        try:
            for batch in batches:
                found = {name: [] for name in ("record_id", "url", "digest", "record_type", "path", "offset", "length", "page_id")}
                for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        path, at, number = f"{name}-{number:05d}.warc.gz", 0, number + 1
                        system, place = _open(path)
                        system.create_dir(place.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(place, compression=None)
                    digest, record_id = sha1_base32(payload), f"urn:pages:{page_id}"
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = record(record_id, url, payload, digest, None if refers is None else f"urn:pages:{refers}", date)
                    data = packer.compress(data) + packer.flush()
                    out.write(data)
                    for key, value in zip(found, (record_id, url, digest, "response" if refers is None else "revisit",
                                                  path, at, len(data), page_id)):
                        found[key].append(value)
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64() if k in ("offset", "length", "page_id") else pa.string()) for k, v in found.items()],
                    list(found))
        finally:
            if out is not None:
                out.close()

    return staged(rows.mapInArrow(run, INDEX + ", page_id bigint"), "warc-index")


def _members(stream):
    """Yields (offset, length, data) of the records of an open archive, plain or gzip, read in chunks."""
    at, held, more = 0, b"", True

    def fill() -> bool:
        nonlocal held, more
        part = stream.read(CHUNK)
        more = bool(part)
        held += part
        return more

    fill()
    while held or (more and fill()):
        if held[:2] == b"\x1f\x8b":
            unpacker, data, used = zlib.decompressobj(31), [], 0
            while True:
                data.append(unpacker.decompress(held))
                used += len(held) - len(unpacker.unused_data)
                held = unpacker.unused_data
                if unpacker.eof or not fill():
                    break
            yield at, used, b"".join(data)
        else:
            while b"\r\n\r\n" not in held and fill():
                pass
            head = held.partition(b"\r\n\r\n")[0]
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            used = len(head) + 8 + int(size[1] if size else 0)
            while len(held) < used and fill():
                pass
            yield at, used, held[:used]
            held = held[used:]
        at += used


def index_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of existing archives, one task per archive; a gzip archive needs a member per record."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = _open(path)
                with system.open_input_stream(place, compression=None) as stream:
                    rows = [(parse(data), at, used) for at, used, data in _members(stream) if data.strip()]
                yield pa.RecordBatch.from_pylist(
                    [{"record_id": r["record_id"], "url": r["url"], "digest": r["payload_digest"],
                      "record_type": r["record_type"], "path": path, "offset": at, "length": used} for r, at, used in rows],
                    pa.schema([(f, pa.int64() if f in ("offset", "length") else pa.string()) for f in
                               ("record_id", "url", "digest", "record_type", "path", "offset", "length")]))

    table = spark.createDataFrame([(p,) for p in paths], "path string")
    return table.repartition(max(1, len(paths)), "path").mapInArrow(run, INDEX)


def read_records(index: DataFrame, payloads: bool = True, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that `index` (path, offset, length) selects, parsed; payload is null without `payloads`.

    The rows are sorted by place; ranges at most `gap` bytes apart become one
    read of at most about `span` bytes. A large archive is read by several tasks.
    The digest and size of a response are those of the payload that was read, of
    a revisit those in its header. Repeated index rows give repeated records.
    """
    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
            begin = 0
            while begin < len(rows):
                path, low, length = rows[begin]
                high, end = low + length, begin + 1
                while end < len(rows) and rows[end][0] == path and rows[end][1] <= high + gap and rows[end][1] - low <= span:
                    high = max(high, rows[end][1] + rows[end][2])
                    end += 1
                system, place = _open(path)
                with system.open_input_file(place) as file:
                    file.seek(low)
                    data = file.read(high - low)
                found = []
                for _, offset, length in rows[begin:end]:
                    part = data[offset - low : offset - low + length]
                    one = parse(zlib.decompress(part, 31) if part[:2] == b"\x1f\x8b" else part)
                    found.append(one if payloads else one | {"payload": None})
                yield pa.RecordBatch.from_pylist(found, schema)
                begin = end

    schema = pa.schema([(f, pa.int64() if f == "payload_bytes" else pa.binary() if f == "payload" else pa.string())
                        for f in ("record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")])
    places = index.select("path", "offset", "length").repartitionByRange(partitions(index.sparkSession), "path", "offset")
    return places.sortWithinPartitions("path", "offset").mapInArrow(run, RECORD)
