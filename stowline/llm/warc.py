"""WARC archives of pages, read back as a chunked record table.

Writing: a record per page, a gzip member each. Of equal payloads only one is stored; the others are revisit
records that name it. Payload bytes go from the row's buffer to the compressor slice by slice.
Reading: archives are streamed; a record becomes rows (record id, chunk number) of at most `CHUNK` bytes that carry
the bytes so far and the SHA-1 so far, so no record is ever held whole. The last chunk's digest is the payload's.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stowline.llm.tables import attempt_file, new_folder, opened, stored

CHUNK = 1 << 16
FILE_BYTES = 1 << 30
MIN_REVISIT = 1000
_ID = "urn:x-page:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, html, payload_digest, payload_bytes, record_type, refers_to); null html is an empty payload.

    The largest key of equal payloads of at least `min_revisit` bytes is the response (rows that repeat that key too),
    the others revisit it. Rows without a key are always responses.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key), F.col(url), payload.alias(html), F.sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    large = rows.filter(F.col("payload_bytes") >= min_revisit)
    # only digests that occur more than once are joined to the pages
    stored_as = large.groupBy("payload_digest", "payload_bytes").agg(F.max(key).alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") > 1).drop("_n")
    joined = rows.join(stored_as, ["payload_digest", "payload_bytes"], "left")
    refers_to = F.when(F.col("_first") != F.col(key), F.col("_first"))
    return joined.select(
        key, url, html, "payload_digest", "payload_bytes", F.when(refers_to.isNull(), "response").otherwise("revisit").alias("record_type"), refers_to.alias("refers_to")
    )


def _header(version: str, fields: list[tuple[str, object]]) -> bytes:
    lines = [version, *(f"{name}: {value}" for name, value in fields if value is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _escaped(uri: str | None) -> str | None:
    return _UNSAFE.sub(lambda found: f"%{ord(found[0]):02X}", uri) if uri is not None else None


def write_archives(records: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write planned records; gives the stored manifest (path, n_records), one row per archive of a finished task.

    File names belong to task attempts and only the manifest says which files count. A file is closed at
    `FILE_BYTES`. An empty table gives no archives.
    """
    folder = folder or new_folder(records.sparkSession, "warc")
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    narrow = records.select(key, url, html, "payload_digest", "payload_bytes", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, count = None, "", 0
        for batch in batches:
            keys, urls, _, digests, sizes, kinds, refers = (batch.column(at).to_pylist() if at != 2 else None for at in range(7))
            for at in range(batch.num_rows):
                if out is None:
                    path, count = attempt_file(folder, "pages", ".warc.gz"), 0
                    fs, inside = opened(path)
                    fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(inside)
                stored_here = kinds[at] == "response"
                http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", sizes[at])])
                warc = _header(
                    "WARC/1.1",
                    [
                        ("WARC-Type", kinds[at]),
                        ("WARC-Record-ID", f"<{_ID}{'' if keys[at] is None else keys[at]}>"),
                        ("WARC-Date", date),
                        ("WARC-Target-URI", _escaped(urls[at])),
                        ("WARC-Payload-Digest", f"sha1:{digests[at]}"),
                        ("WARC-Profile", None if stored_here else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", None if stored_here else f"<{_ID}{refers[at]}>"),
                        ("Content-Type", "application/http; msgtype=response"),
                        ("Content-Length", len(http) + (sizes[at] if stored_here else 0)),
                    ],
                )
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(member.compress(warc + http))
                if stored_here:
                    payload = memoryview(batch.column(2)[at].as_buffer())
                    for begin in range(0, len(payload), CHUNK):
                        out.write(member.compress(payload[begin : begin + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                count += 1
                if out.tell() >= FILE_BYTES:
                    out.close()
                    out = None
                    yield _manifest(path, count)
        if out is not None:
            out.close()
            yield _manifest(path, count)

    return stored(narrow.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def _manifest(path: str, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "n_records"])


def _fields(stream) -> dict[str, str] | None:
    """The header lines up to the blank one; None at the end of the archive."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    fields = {"": first.decode().strip()}
    while (line := stream.readline().strip()):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _id(value: str | None) -> str | None:
    return (value or "").strip("<>").removeprefix(_ID) or None


def read_chunks(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """(id, uri, record type, id referred to, chunk number, chunk, bytes so far, SHA-1 so far, last) of one archive.

    A record without stored payload is one row without a chunk; its bytes and digest are those its headers declare.
    """
    fs, inside = opened(path)
    with fs.open_input_stream(inside, buffer_size=1 << 18) as file, io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 18) as stream:
        while (warc := _fields(stream)) is not None:
            length = int(warc["content-length"])
            begin = _Counted(stream)
            http = _fields(begin)
            left = length - begin.count
            who = (_id(warc.get("warc-record-id")), warc.get("warc-target-uri"), warc["warc-type"], _id(warc.get("warc-refers-to")))
            if warc["warc-type"] == "revisit":
                yield (*who, 0, None, int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), True)
            else:
                digest, done, number = hashlib.sha1(), 0, 0
                while True:
                    part = stream.read(min(chunk, left - done))
                    if not part and done < left:
                        raise EOFError(f"truncated record in {path}")
                    digest.update(part)
                    done += len(part)
                    yield (*who, number, part, done, digest.hexdigest(), done == left)
                    number += 1
                    if done == left:
                        break


class _Counted:
    """Lines of a stream, with the bytes taken."""

    def __init__(self, stream):
        self.stream, self.count = stream, 0

    def readline(self) -> bytes:
        line = self.stream.readline()
        self.count += len(line)
        return line


_CHUNKS = pa.schema(
    [
        ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()),
        ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()),
    ]
)


def chunk_table(manifest: DataFrame, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest; without the chunks' bytes if only digests are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for row in read_chunks(path):
                    held += len(row[5] or b"") if with_chunks else 0
                    rows.append(row if with_chunks else (*row[:5], None, *row[6:]))
                    if len(rows) == 5000 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files, "path").mapInArrow(
        run,
        "record_id string, url string, record_type string, refers_to string, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, last boolean",
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)


def archived_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back."""
    kind = pages.schema[key].dataType
    chunks = chunk_table(write_archives(plan_records(pages, min_revisit, key, url, html), key, url, html), with_chunks=False)
    return chunks.filter("last").select(
        F.col("record_id").cast(kind).alias(key),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("sha1_so_far").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
