"""WARC records in ZIP-packaged archives: writing, and reading without extraction.

An archive is a ZIP file with stored members: ``archive/data.warc.gz``, one gzip
member per record, and ``indexes/index.cdxj``, one line per record with its place.
The reader parses the end of the central directory (ZIP64 included), finds the
stored members, reads the index and then reads each record by its byte range.

Archives lie under the cluster's shared folder. A task writes under a name of its
own attempt and the manifest, itself a table, lists only what finished attempts
wrote: lost executors and repeated tasks leave no half archive behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.session import materialize, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: an archive is closed and a new one begun at this size
ARCHIVE_BYTES = 64 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def _headers(first: str, fields: dict[str, str]) -> bytes:
    clean = (f"{k}: {' '.join(v.split())}" for k, v in fields.items())
    return "\r\n".join([first, *clean, "", ""]).encode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which keeps the HTTP headers
    and leaves the payload out."""
    http = _headers("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": url or "",
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        # fixed value: the profile the WARC standard names for equal payloads
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    block = http + (payload if refers_to is None else b"")
    fields["Content-Length"] = str(len(block))
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(raw: bytes) -> dict:
    """Fields of a record as written by ``make_record``; a response's digest is
    computed from its payload and must agree with the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _parse_fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if len(urn) > len("<urn:page:>") else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    size = int(_parse_fields(http)["content-length"])
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its headers")
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload,
    }


# ---------------------------------------------------------------- ZIP reader


def read_directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Central directory of a ZIP file, with ZIP64: name to (method, compressed
    size, size, offset of the local header). Reads the tail and the directory."""

    def at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    start = max(0, size - 65_557)  # the end record with the longest comment
    tail = at(start, size - start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, offset = struct.unpack("<H2L", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = tail[end - 20 : end] if end >= 20 else at(start + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator missing")
        record = at(struct.unpack("<Q", locator[8:16])[0], 56)
        count, length, offset = struct.unpack("<3Q", record[32:56])
    directory, members, p = at(offset, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        (method,) = struct.unpack("<H", directory[p + 10 : p + 12])
        packed, plain, n, extra, comment = struct.unpack("<2L3H", directory[p + 20 : p + 34])
        (local,) = struct.unpack("<L", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n].decode()
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            tag, width = struct.unpack("<2H", directory[q : q + 4])
            if tag == 1:  # ZIP64: only the values that did not fit, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", directory[q + 4 : q + 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            q += 4 + width
        members[name] = (method, packed, plain, local)
        p = stop + comment
    return members


def member_start(file, member: tuple[int, int, int, int]) -> int:
    """Offset of the first data byte of a stored member."""
    if member[0] != zipfile.ZIP_STORED:
        raise ValueError("only stored members can be read by range")
    file.seek(member[3])
    local = file.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    n, extra = struct.unpack("<2H", local[26:30])
    return member[3] + 30 + n + extra


def read_index(file, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of each record of an archive."""
    members = read_directory(file, size)
    data, index = member_start(file, members[DATA]), members[INDEX]
    at = member_start(file, index)
    file.seek(at)
    for line in io.BytesIO(file.read(index[2])):
        place = json.loads(line.split(b" ", 2)[2])
        yield data + place["offset"], place["length"]


# ---------------------------------------------------------------- Spark


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``records`` (page_id, url, payload binary, refers_to) into archives
    under the shared folder; returns the manifest: path, bytes, records."""
    spark = records.sparkSession
    base = new_path(spark, "warc")
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    base = base.replace("file:///", "file:/").replace("file:/", "file:///")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, folder = _filesystem(base)
        system.create_dir(folder, recursive=True)
        rows = (row for batch in batches for row in batch.to_pylist())
        row, number = next(rows, None), 0
        while row is not None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.zip"
            written, count, index = 0, 0, []
            with system.open_output_stream(f"{folder}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as packed:
                    with packed.open(DATA, "w", force_zip64=True) as data:
                        while row is not None and written < archive_bytes:
                            record = make_record(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"])
                            gz = zlib.compress(record, 1, wbits=31)
                            data.write(gz)
                            place = {"offset": written, "length": len(gz), "filename": DATA}
                            index.append(f"{row['page_id']} - {json.dumps(place)}\n")
                            written, count = written + len(gz), count + 1
                            row = next(rows, None)
                    packed.writestr(INDEX, "".join(index))
            size = system.get_file_info(f"{folder}/{name}").size
            yield pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "bytes": [size], "records": [count]})
            number += 1

    made = records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, bytes long, records long")
    return materialize(made, "warc-manifest")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives at ``path``, read by range; with ``payloads``
    also the payload (empty for revisits)."""

    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_digest": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _filesystem(path)
                with system.open_input_file(name) as file:
                    found = {n: [] for n in names}
                    pending = 0
                    for offset, length in list(read_index(file, file.size())):
                        file.seek(offset)
                        record = parse_record(zlib.decompress(file.read(length), wbits=31))
                        for n in names:
                            found[n].append(record[n])
                        pending += len(record["payload"]) if payloads else 200
                        if pending > 1 << 23:
                            yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in found.items()})
                            found, pending = {n: [] for n in names}, 0
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in found.items()})

    # archives are large: one to a task
    paths = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    return paths.mapInArrow(read, RECORD + ", payload binary" * payloads)


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (the html in UTF-8, null: empty) and
    ``refers_to``: of pages with equal payloads the largest page_id keeps the
    payload (null: it is a response), the others refer to it.

    Payloads are equal if their SHA-256 are. A row that repeats the id and payload
    of the kept one is kept as well, for it is the same record; rows without id
    refer to the kept one, or are kept if none of their group has an id. Only keys
    are grouped, so a group of copies of any size costs its keys; the payloads
    meet what they refer to by their own (id, payload), which no two groups share.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_sha", F.unhex(F.sha2("payload", 256)))
    keys = rows.select("_sha", "page_id")
    groups = keys.groupBy("_sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    # stored, so that a hot payload's keys meet their group in a join that can be split
    repeated = materialize(groups.filter("copies > 1 and refers_to is not null").drop("copies"), "warc-groups")
    revisits = (
        keys.join(repeated, "_sha")
        .filter("page_id is null or page_id <> refers_to")
        .distinct()
        .select(F.col("_sha").alias("_to_sha"), F.col("page_id").alias("_to_id"), "refers_to")
    )
    same = (F.col("_sha") == F.col("_to_sha")) & F.col("page_id").eqNullSafe(F.col("_to_id"))
    return rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Writes all pages as WARC records, revisits for repeated payloads, and
    returns what reading the archives back gives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet") if pages is None else pages
    return read_archives(write_archives(plan_records(pages))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
