"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges. A task scans its range for gzip
magic, takes a hit as a record only if it inflates to a WARC version line and complete headers, and owns the records that start
inside its range; the last of them may end in the next one. So any range size gives each record exactly once.
Files are written and read through pyarrow's file systems, by the URI of a folder that all executors share. Each
attempt of a task writes files of its own names, and only those of the attempts that succeed are in the list that
``write`` commits and ``read`` takes, so a task that is run again, even at the same time, does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uqframe.llm.common import cut

MAGIC = b"\x1f\x8b\x08"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
#: Bytes of one read range, and bytes read ahead at a time.
SPLIT, CHUNK = 4 << 20, 1 << 20
#: Payload bytes that a task gathers before it hands them on.
BATCH = 32 << 20
#: Records of a written file.
FILE_RECORDS = 4_000


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, rid: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member. A revisit has the HTTP head of the response, with its full length, but not the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{rid}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class _Bytes:
    """A file read in chunks from any offset."""

    file: object
    size: int
    start: int = 0
    held: bytes = b""

    def at(self, offset: int, n: int) -> bytes:
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.start = offset
            self.file.seek(offset)
            self.held = self.file.read(min(max(n, CHUNK), self.size - offset)) if offset < self.size else b""
        return self.held[offset - self.start : offset - self.start + n]


def _head(data: _Bytes, offset: int) -> bool:
    """True if the gzip member at ``offset`` inflates to a version line; its headers may be of any length."""
    inflater, out, at = zlib.decompressobj(31), b"", offset
    try:
        while len(out) < 10 and not inflater.eof:
            raw = data.at(at, 4096)
            if not raw:
                return False
            out += inflater.decompress(raw, 16)
            at += len(raw)
    except zlib.error:
        return False
    return out.startswith(VERSIONS)


def _member(data: _Bytes, offset: int) -> tuple[bytes, int] | None:
    """The inflated member at ``offset`` and where it ends; None if it is broken or cut off."""
    inflater, out, at = zlib.decompressobj(31), [], offset
    try:
        while not inflater.eof:
            raw = data.at(at, 1 << 16)
            if not raw:
                return None
            out.append(inflater.decompress(raw))
            at += len(raw)
    except zlib.error:
        return None
    return b"".join(out), at - len(inflater.unused_data)


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None if its length is wrong."""
    top, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        return None
    headers = {}
    for line in top.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError):
        return None
    return (headers, rest[:n]) if len(rest) >= n else None


def records_in(data: _Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    at = start
    while at < end:
        window = data.at(at, min(CHUNK, end - at + 2))
        found = window.find(MAGIC)
        if found < 0 or at + found >= end:
            at += max(1, len(window) - 2)
            if not window or found >= 0:
                return
            continue
        at += found
        if _head(data, at) and (got := _member(data, at)) is not None and (both := parse(got[0])) is not None:
            yield at, *both
            at = got[1]
        else:
            at += 1


def write(df: DataFrame, folder: str, rows_per_file: int = FILE_RECORDS) -> DataFrame:
    """Write rows (rid, uri, payload, kind, refers_to) as ``*.warc.gz`` below ``folder``; returns the files (path, records, bytes).

    The list of files is itself written to the shared folder: reading it again writes nothing. No rows make no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, n = None, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                stream, name = out
                size = stream.tell()
                stream.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n = (fs.open_output_stream(name, compression=None), name), 0
                out[0].write(record(row["kind"], row["uri"] or "", row["rid"], (row["payload"] or "").encode(), row["refers_to"]))
                n += 1
                if n >= rows_per_file:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    return cut(df.select("rid", "uri", "payload", "kind", "refers_to").mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-files")


SCHEMA = "path string, offset bigint, rid string, kind string, uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files (path, bytes) of a folder of archives from elsewhere; names and sizes come from the driver's listing."""
    fs, root = file_system(folder)
    files = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".gz") and not os.path.basename(f.path).startswith(".")]
    return spark.createDataFrame(files, "path string, bytes long")


def read(spark: SparkSession, folder: str, files: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """One row a record (SCHEMA) of ``files`` (path, bytes; all of ``folder`` if not given), by byte ranges of ``split`` bytes.

    ``payload`` is the block behind its HTTP head, empty for a revisit. ``payload_bytes`` and ``payload_digest`` are of the full payload:
    computed for a response, taken from the headers for a revisit. Bytes that aren't a whole record are skipped. A
    whole archive that stands uncompressed inside a record's payload can't be told from records of the file by a task
    that starts inside it. A payload must fit a cell (2 GB).
    """
    sizes = (listed(spark, folder) if files is None else files).select("path", F.col("bytes").alias("size"))
    ranges = sizes.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(folder)
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        columns = [c.split() for c in SCHEMA.split(", ")]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[k]) for c, k in columns], names=list(rows))
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = {c: [] for c, _ in columns}, 0
                with own.open_input_file(r["path"]) as f:
                    for offset, h, block in records_in(_Bytes(f, r["size"]), r["start"], min(r["start"] + split, r["size"])):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = h.get("warc-type", "")
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        urn = lambda x: x.strip("<>").rpartition(":")[2]
                        values = (r["path"], offset, urn(h.get("warc-record-id", "")), kind, h.get("warc-target-uri", ""), urn(h["warc-refers-to"]) if "warc-refers-to" in h else None)
                        whole = kind != "revisit"
                        for c, v in zip(rows, (*values, digest(payload) if whole else h.get("warc-payload-digest", "").rpartition(":")[2], len(payload) if whole else length, payload)):
                            rows[c].append(v)
                        held += len(payload) + len(h.get("warc-target-uri", ""))
                        if held >= BATCH:
                            yield packed(rows)
                            rows, held = {c: [] for c, _ in columns}, 0
                yield packed(rows)

    n = ranges.count()
    return ranges.repartition(max(1, min(n, 20_000)), "path", "start").mapInArrow(run, SCHEMA)


def with_kinds(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for ``write``: of equal payloads of at least ``least_bytes`` the row of the largest key is the response.

    Rows of the same key and payload as the response are responses too. A null key is smaller than all others and is
    written as an empty id. Equal payloads are found by SHA-256 and length; the digests, not the texts, are grouped,
    with sums per task first, and a hot payload's rows are narrow when they meet.
    """
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("uri"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    own = own.withColumn("d", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    first = own.where("d is not null").groupBy("d").agg(F.max("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first")
    # narrow rows meet their group's response; then texts meet their verdict by a key that is nearly unique
    verdict = own.select("k", "d").distinct().join(first, "d").where(~F.col("k").eqNullSafe(F.col("first"))).select("k", "d", "first")
    v = verdict.select(F.coalesce("k", F.lit(-(1 << 62))).alias("vk"), F.col("d").alias("vd"), F.col("first").alias("refers_to"), F.lit(True).alias("again"))
    joined = own.join(v, (F.coalesce(own["k"], F.lit(-(1 << 62))) == v["vk"]) & (own["d"] == v["vd"]), "left")
    return joined.select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("rid"), F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", "").alias("uri"), "payload", F.when(F.col("again"), "revisit").otherwise("response").alias("kind"), F.when(F.col("again"), F.coalesce(F.col("refers_to").cast("string"), F.lit(""))).alias("refers_to"))
