"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader takes one archive from front to back with bounded memory: compressed bytes go
through ``zlib.decompressobj`` piece by piece, a record's header block ends at its empty
line, Content-Length frames its block, and the member must end behind the record.  Payload
and block digests are verified.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_folder, written

READ = 1 << 16
#: An archive is closed once it holds this many compressed bytes.
ROLL = 32 << 20
#: Payloads from this many bytes on are revisited instead of repeated.
MIN_REVISIT = 0
#: Fixed value: the profile of the standard for records with an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def one_line(s: str) -> str:
    """A header value: line breaks and other control characters cannot stand in it."""
    return "".join(c if c >= " " and c != "\x7f" else " " for c in s)


def response_record(key: str, url: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("response", key, url, http + payload, base32(hashlib.sha1(payload).digest()), [])


def revisit_record(key: str, url: str, payload: bytes, first: str) -> bytes:
    """Headers only; Content-Length of the HTTP block tells the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra = [("WARC-Refers-To", record_id(first)), ("WARC-Refers-To-Key", one_line(first)), ("WARC-Profile", REVISIT_PROFILE)]
    return _record("revisit", key, url, http, base32(hashlib.sha1(payload).digest()), extra)


def _record(kind: str, key: str, url: str, block: bytes, payload_digest: str, extra: list[tuple[str, str]]) -> bytes:
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Record-Key", one_line(key)), ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        *extra, ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512}
#: Bytes in which the header of a record must end.
MOST_HEADER = 1 << 20


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    offset: int = 0
    problem: str | None = None


def read_records(pull: Callable[[int], bytes]) -> Iterator[Record]:
    """Records of one archive; ``pull(n)`` returns up to n compressed bytes, none at the end.

    A damaged or cut member ends with a record whose ``problem`` says so; without its
    length nothing behind it can be found, so reading ends there.  A whole member without a
    header or with a bad length is a record with a problem, and reading goes on behind it.
    Digests are verified by the kind they name, in base32 or hex; an unknown kind is a problem.
    """
    raw, at, total = b"", 0, 0
    while True:
        z, out, done = zlib.decompressobj(31), bytearray(), False
        start = total - len(raw)
        need = None
        head: dict[str, str] | None = None
        problem = None
        while not done:
            if not raw:
                raw = pull(READ)
                total += len(raw)
            try:
                more = z.decompress(raw, 4 * READ)
                if not raw and not more:  # the end, and nothing is left inside
                    break
                out += more
            except zlib.error as e:
                yield Record(head or {}, offset=start, problem=f"damaged member: {e}")
                return
            raw = z.unconsumed_tail or z.unused_data
            done = z.eof
            if head is None and (at := out.find(b"\r\n\r\n")) >= 0:
                head = _fields(bytes(out[:at]))
                length = _length(head)
                if length is None:
                    problem = "bad Content-Length"
                else:
                    need = at + 4 + length
            if head is None and len(out) > MOST_HEADER:
                head, problem = {}, "no header"
            if problem is not None and need is None:  # the rest of the member is read past
                out.clear()
            if need is not None and len(out) > need + 4:
                problem = "block longer than Content-Length"
                del out[need + 4 :]
        if not done:
            if out or z.unconsumed_tail:
                yield Record(head or {}, offset=start, problem="cut member")
            return
        if head is None or need is None:
            yield Record(head or {}, offset=start, problem=problem or "no header")
            continue
        block = bytes(out[at + 4 : need])
        if problem is None and (len(out) != need + 4 or out[need:] != b"\r\n\r\n"):
            problem = "block shorter than Content-Length"
        r = Record(head, offset=start, problem=problem)
        if head.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            r.http, r.payload = _fields(block[: max(cut, 0)]), block[cut + 4 :] if cut >= 0 else b""
        else:
            r.payload = block
        r.problem = r.problem or _differs("block", head.get("warc-block-digest"), block)
        if head.get("warc-type") == "response":
            r.problem = r.problem or _differs("payload", head.get("warc-payload-digest"), r.payload)
        yield r


def _length(head: dict[str, str]) -> int | None:
    """Content-Length; none counts as 0, and anything but digits is not one."""
    text = head.get("content-length", "0")
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def _differs(what: str, stated: str | None, data: bytes) -> str | None:
    """What is wrong with a digest such as ``sha1:BASE32`` or ``SHA-256:hex``; None if nothing."""
    if not stated:
        return None
    kind, _, value = stated.partition(":")
    make = DIGESTS.get(kind.strip().lower().replace("-", ""))
    if make is None:
        return f"{what} digest of unknown kind"
    digest = make(data).digest()
    shown = value.strip().rstrip("=")
    return None if shown.upper() == base32(digest).rstrip("=") or shown.lower() == digest.hex() else f"{what} digest differs"


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    text = re.sub("\r\n[ \t]+", " ", block.decode("utf-8", "replace"))
    lines = text.split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all machines share, given as a URI or a path."""
    return fs.FileSystem.from_uri(path)


def write_archives(df: DataFrame, key: str, url: str, payload: str, folder: str | None = None, min_revisit: int = MIN_REVISIT, roll: int = ROLL) -> DataFrame:
    """Write one record per row; returns the manifest (path, n_records, n_bytes).

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the largest
    key are responses and the others revisit it; smaller payloads are all responses.  NULL
    payloads are empty; rows with a NULL key are responses under an empty key, unless a
    larger key has the payload.  Repeated rows give repeated records.  An empty table
    gives no archive.

    Each attempt of a task writes files of its own name, and only files of finished tasks
    are in the manifest, which is written at once: a lost executor leaves at most an
    unlisted file behind.  Payload digests are counted before any payload moves; payloads
    move only where the join with the repeated digests is not a broadcast.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, "warc")
    d = df.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_p"))
    d = d.withColumn("_d", F.when(F.length("_p") >= min_revisit, F.sha1("_p")))
    again = d.filter("_d is not null").groupBy("_d").agg(F.max("_k").alias("_first"), F.count("*").alias("n")).filter("n > 1").select(F.col("_d").alias("_g"), "_first")
    d = d.join(written(again, "warc-repeats"), F.col("_d") == F.col("_g"), "left")
    d = d.select(F.col("_k").cast("string").alias("k"), F.coalesce("_u", F.lit("")).alias("u"), "_p", F.when(~F.col("_k").eqNullSafe(F.col("_first")), F.col("_first").cast("string")).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

        for b in batches:
            for k, u, p, f in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None)
                rec = response_record(k or "", u, p) if f is None else revisit_record(k or "", u, p, f)
                out.write(rec)
                n, size = n + 1, size + len(rec)
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(d.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


RECORD_SCHEMA = "path string, offset long, record_type string, record_key string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary, problem string"


def read_archives(paths: DataFrame, path: str = "path", payloads: bool = True) -> DataFrame:
    """One row per record of the archives that ``paths`` lists, each read by one task.

    For a response payload_bytes and payload_digest are of the payload as read; for a
    revisit they are those that its headers state of the full payload.  ``problem`` is NULL
    for a sound record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_key", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
        for b in batches:
            for p in b.column(0).to_pylist():
                store, at = _open(p)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as f:
                    for r in read_records(f.read):
                        h, kind = r.headers, r.headers.get("warc-type")
                        revisit = kind == "revisit"
                        size = _length(r.http) if revisit else len(r.payload)
                        if size is None:
                            r.problem = r.problem or "bad Content-Length"
                        digest = h.get("warc-payload-digest", "").partition(":")[2] if revisit else base32(hashlib.sha1(r.payload).digest())
                        rows.append((p, r.offset, kind, h.get("warc-record-key"), h.get("warc-target-uri"), digest, size, h.get("warc-refers-to-key"), r.payload if payloads else None, r.problem))
                        held += len(r.payload) if payloads else 100
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    spark: SparkSession = paths.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism)
    return paths.select(path).repartition(n, F.col(path)).mapInArrow(run, RECORD_SCHEMA)
