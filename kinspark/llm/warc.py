"""WARC archives of pages: writing, normalising monolithic gzip files, and reading by a sidecar index.

* ``write_archives``: one record per page, the payload behind an HTTP header; many records in one gzip
  stream per file (what some crawlers leave behind). Of records with equal payloads of at least
  ``min_payload`` bytes, the one with the smallest page_id is the response, the others revisit it and
  carry no payload; smaller payloads are all responses.
* ``normalise``: inflates each file once as a stream, rewrites every record as a gzip member of its own,
  and writes a sidecar index (offset, length, record) next to it.
* ``read_records``: reads records by the index, each member alone.

Files are named after the attempt that wrote them, and only those that a finished task has listed are
used, so a lost or repeated task leaves at most an unlisted file. All of them lie in the folder the
caller names, which all executors must reach (any file system that pyarrow opens).

A null html is an empty payload; a null url leaves out the target. Rows of equal page_id and payload are
responses or revisits alike. A null page_id is a response only if all copies have none. No rows: no files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import partitions_for, table
from kinspark.sources.stage import Stage

MIN_PAYLOAD = 0
DATE = "2000-01-01T00:00:00Z"
#: A new file begins after so many uncompressed bytes.
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
LEVEL = 4
GZIP = 31
BLANK = b"\r\n\r\n"
MANIFEST = "archive string, records long, bytes long"
INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + BLANK + block + BLANK


def with_first_copies(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, html, refers_to, revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    # Payloads that are too short never revisit: they count as payloads of their own.
    df = df.withColumn("digest", F.when(F.octet_length("html") >= min_payload, F.sha1(F.col("html").cast("binary"))))
    firsts = df.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"))
    df = df.join(firsts, "digest", "left")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return df.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, root: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes monolithic archives under ``root`` and returns their list."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        task, made = TaskContext.get(), []
        out = deflate = None
        name, records, size = "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.write(deflate.flush())
                out.close()
                made.append((name, records, size))
                out = None

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, deflate = fs.open_output_stream(f"{folder}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    records = size = 0
                payload = html.encode("utf-8", "surrogatepass")
                data = record(page_id, url, payload, base32_sha1(payload), refers_to, revisit)
                out.write(deflate.compress(data))
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    close()
        close()
        if made:
            columns = [pa.array(c, type=k) for c, k in zip(zip(*made), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["archive", "records", "bytes"])

    return with_first_copies(pages, min_payload).mapInArrow(written, MANIFEST)


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, piece by piece."""
    inflate = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            yield inflate.decompress(data, CHUNK)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, CHUNK)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
            else:
                break


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC byte stream; at most one record and one piece are held."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(BLANK)
                if end < 0:
                    break
                need = end + len(BLANK) + int(headers(bytes(held[:end]))["content-length"]) + len(BLANK)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"a WARC file ends inside a record, {len(held)} bytes left")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def normalise(manifest: DataFrame, root: str, target: str) -> DataFrame:
    """Rewrites the listed archives under ``target``, a gzip member a record, and returns their index."""

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        _, into = file_system(target)
        fs.create_dir(into, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name, rows, offset = f"{archive.removesuffix('.warc.gz')}-{attempt}.warc.gz", [], 0
                with (
                    fs.open_input_stream(f"{folder}/{archive}", compression=None) as source,
                    fs.open_output_stream(f"{into}/{name}", compression=None) as out,
                ):
                    for data in records_of(inflated(source)):
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = deflate.compress(data) + deflate.flush()
                        out.write(member)
                        head = headers(data[: data.index(BLANK)])
                        rows.append((name, offset, len(member), head["warc-record-id"], head["warc-type"]))
                        offset += len(member)
                with fs.open_output_stream(f"{into}/{name}.index", compression=None) as sidecar:
                    for row in rows:
                        sidecar.write(json.dumps(row[1:]).encode() + b"\n")
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                if rows:
                    columns = [pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["archive", "offset", "length", "record_id", "record_type"])

    return manifest.select("archive").mapInArrow(rewritten, INDEX)


def read_sidecars(archives: DataFrame, target: str) -> DataFrame:
    """The index of the listed archives (column ``archive``) from the sidecar files beside them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(target)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{archive}.index", compression=None) as sidecar:
                    rows = [(archive, *json.loads(line)) for line in sidecar.read().splitlines()]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                if rows:
                    columns = [pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["archive", "offset", "length", "record_id", "record_type"])

    return archives.select("archive").mapInArrow(read, INDEX)


def parsed(data: bytes) -> tuple:
    """RECORDS of one record; the digest of a payload that is there is computed anew and must agree."""
    end = data.index(BLANK)
    head = headers(data[:end])
    block = data[end + len(BLANK) : -len(BLANK)]
    split = block.index(BLANK)
    http, payload = headers(block[:split]), block[split + len(BLANK) :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its header")
    number = lambda key: int(head[key]) if key in head else None
    return number("x-page-id"), int(http["content-length"]), digest, head["warc-type"], number("x-refers-to-page"), head.get("warc-target-uri")


def read_records(index: DataFrame, target: str) -> DataFrame:
    """Every indexed record, read at its offset as a gzip member of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(target)
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, fs.open_input_file(f"{folder}/{archive}")
                source.seek(offset)
                rows.append(parsed(zlib.decompress(source.read(length), GZIP)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
        if source is not None:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages written, normalised and read back, a row per page."""
    stage = Stage(pages.sparkSession)
    raw, whole = stage.new_path("monolithic"), stage.new_path("members")
    manifest = stage.save("manifest", write_archives(pages, raw, min_payload))
    # One archive a task: the list is short, the files are not.
    files = manifest.repartition(partitions_for(manifest.count(), 1), "archive")
    index = stage.save("index", normalise(files, raw, whole))
    return read_records(index, whole)


def query(spark, sf_dir: str) -> DataFrame:
    df = round_trip(table(spark, sf_dir, "pages"))
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
