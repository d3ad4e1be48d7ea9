"""WARC archives: written by tasks as one gzip member per record, read back by byte ranges.

A reading task gets a range of a file, scans it for the gzip magic, accepts a candidate if it inflates to a WARC header,
and owns the records that start inside its range. Writers put complete files under names of their own into the shared
folder and report them; the report is a committed table, so only files of successful attempts are ever read.

Defined cases: a null payload is empty; equal payloads of at least ``least`` bytes: the row with the smallest id is the
response, the others (a null id too, if any id is known) revisit it; rows that repeat that smallest id are responses as
well; rows without any id are responses; an empty table gives no archive and no rows; a member that does not inflate to its
end, or ends inside its header, gives a row of type ``corrupt``; a header has any length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.common import field, slices
from tallyframe.session import scratch_path, small_batches

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES, SPLIT_BYTES, CHUNK = 256 << 20, 16 << 20, 1 << 18
MANIFEST = "path string, bytes long, records long"
RECORDS = ("path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
           "payload_bytes long, payload_digest string, payload binary")
DATE = "1970-01-01T00:00:00Z"


def with_types(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """(_id, _body, _digest, _first): _first is the id that a revisit refers to, else null. Only the ids of payloads that
    occur more than once are joined back; a payload that a third of the rows share is a skewed join, not a group."""
    rows = pages.select(F.col(key).alias("_id"), F.col("_uri"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("_body"))
    rows = rows.withColumn("_digest", F.sha1("_body"))
    firsts = rows.where(F.octet_length("_body") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.where("_n > 1").drop("_n")
    joined = rows.join(firsts, "_digest", "left")
    return joined.withColumn("_first", F.when(~F.col("_first").eqNullSafe(F.col("_id")), F.col("_first")))


def header_block(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def record(name: str | None, uri: str | None, body: bytes, first: str | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if first is not None else http + body
    own = f"<urn:page:{name}>" if name is not None else f"<urn:uuid:{uuid.uuid4()}>"
    pairs = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if uri is not None:
        pairs.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if first is not None:
        pairs += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    pairs += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return header_block(pairs) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", uri: str | None = "url", least: int = 0,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` and returns the committed report (path, bytes, records)."""
    spark = pages.sparkSession
    rows = with_types(pages.withColumn("_uri", F.col(uri).cast("string") if uri else F.lit(None).cast("string")), key, payload, least)
    rows = rows.select(F.col("_id").cast("string").alias("_id"), "_uri", "_body", F.col("_first").cast("string").alias("_first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, done, count = None, None, 0, 0
        report = lambda: pa.RecordBatch.from_pydict({"path": [path], "bytes": [done], "records": [count]})
        for part in slices(batches, "_body"):
            for name, target, body, first in zip(*(field(part, c).to_pylist() for c in ("_id", "_uri", "_body", "_first"))):
                if out is None:
                    path, done, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    done += out.write(member(header_block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Length", "0")]) + b"\r\n\r\n"))
                done += out.write(member(record(name, target, body or b"", first)))
                count += 1
                if done >= file_bytes:
                    out.close()
                    yield report()
                    out = None
        if out is not None:
            out.close()
            yield report()

    report = scratch_path(spark, "warc-report")
    with small_batches(spark):
        rows.mapInArrow(write, MANIFEST).write.parquet(report)
    return spark.read.schema(MANIFEST).parquet(report)


class Window:
    """Forward reads of a file from any position, in chunks."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""

    def more(self) -> bool:
        self.file.seek(self.at + len(self.held))
        got = self.file.read(CHUNK)
        self.held += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def find(self, end: int) -> int | None:
        """Moves to the next magic that starts before ``end``."""
        while self.at < end:
            at = self.held.find(MAGIC)
            if at >= 0:
                self.skip(at)
                return self.at if self.at < end else None
            self.skip(max(0, len(self.held) - len(MAGIC) + 1))
            if not self.more():
                return None
        return None


def inflated(window: Window) -> tuple[str, bytes, int]:
    """The member at the window's start: ("no" if it does not start as a WARC header, "corrupt" or "ok"; its
    bytes; its length). A header may have any length.."""
    unpack, out, used, at = zlib.decompressobj(31), bytearray(), 0, 0
    while True:
        if at >= len(window.held) and not window.more():
            return ("corrupt" if out.startswith(b"WARC/") else "no"), bytes(out), used
        piece = window.held[at:at + CHUNK]
        try:
            out += unpack.decompress(piece)
        except zlib.error:
            return ("corrupt" if out.startswith(b"WARC/") else "no"), bytes(out), used
        used, at = used + len(piece) - len(unpack.unused_data), at + len(piece)
        if len(out) >= 5 and not out.startswith(b"WARC/"):
            return "no", b"", 0
        if unpack.eof:
            return ("no" if not out.startswith(b"WARC/") else "ok" if b"\r\n\r\n" in out else "corrupt"), bytes(out), used


def fields_of(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


CORRUPT = ("corrupt", *[None] * 6)


def length_of(names: dict[str, str], most: int | None = None) -> int | None:
    """The Content-Length of a header, 0 if it has none; None if it is no number, or more than there is."""
    text = names.get("content-length", "0")
    if not re.fullmatch("[0-9]{1,18}", text):
        return None
    return int(text) if most is None or int(text) <= most else None


def parsed(data: bytes) -> tuple:
    """(type, id, uri, refers to, payload bytes, digest, payload) of a record; of a revisit, what its headers say. A length that is
    no number or exceeds the member makes the record corrupt."""
    head, _, rest = data.partition(b"\r\n\r\n")
    names = fields_of(head)
    length = length_of(names, len(rest))
    if length is None:
        return CORRUPT
    block = rest[:length]
    kind, payload, size = names.get("warc-type"), block, len(block)
    if names.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            size = length_of(fields_of(http))
            if size is None:
                return CORRUPT
    bare = lambda x: x.strip("<>").removeprefix("urn:page:") if x else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        digest, payload = names.get("warc-payload-digest", "").rpartition(":")[2], None
    return kind, bare(names.get("warc-record-id")), names.get("warc-target-uri"), bare(names.get("warc-refers-to")), size, digest, payload


def records_between(file, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    window = Window(file, start)
    while (at := window.find(end)) is not None:
        state, data, used = inflated(window)
        if state == "no":
            window.skip(1)
            continue
        yield at, data if state == "ok" else None
        window.skip(used if state == "ok" else 1)


def read_archives(files: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives listed as (path, bytes), read in ranges of ``split_bytes``."""
    spark = files.sparkSession
    splits = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = splits.repartition(int(min(max(1, ranges), 100_000)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, start in zip(field(batch, "path").to_pylist(), field(batch, "start").to_pylist()):
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    for at, data in records_between(file, start, start + split_bytes):
                        found = parsed(data) if data is not None else CORRUPT
                        rows.append((path, at, *found[:6], found[6] if payloads else None))
                        held += len(data or b"") if payloads else 256 + len(found[2] or "")
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return splits.mapInArrow(load, RECORDS)


def archived(spark: SparkSession, pages: DataFrame, least: int = 0, **options) -> DataFrame:
    """Writes the pages below the shared folder and reads the records back."""
    files = write_archives(pages, scratch_path(spark, "warc"), least=least, **options)
    return read_archives(files, payloads=False)
