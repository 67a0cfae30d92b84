"""WARC archives: a writer with one gzip member per record, and a reader that salvages what it can."""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shared_dir
from .textkit import trim

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to=None, compress: bool = True, level: int = 4) -> bytes:
    """One response record, or a revisit (headers only) if ``refers_to`` is an id."""
    uri = "".join(c if c.isprintable() else quote(c) for c in url or f"urn:page:{page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {_EPOCH}",
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    out = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return out
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(out) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_length(self) -> int:
        found = re.search(rb"(?i)\r\nContent-Length: *(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)


@dataclass
class Gap:
    """Bytes [start, end) that no valid record covers."""

    start: int
    end: int
    reason: str


def _parse(data: bytes, at: int, end: int) -> tuple[Record, int] | str:
    """The record at ``at`` and where it stops, or what is wrong with it."""
    if not _VERSION.match(data, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at, end)
    if stop < 0:
        return "header without end"
    if _VERSION.search(data, at + 1, stop):
        return "version line within a header"
    headers = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon or not line.isprintable():
            return "bad header line"
        headers[k.strip().lower()] = v.strip()
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        return "mandatory header missing"
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "bad length"
    body = stop + 4
    if body + int(size) + 4 > end or data[body + int(size) : body + int(size) + 4] != b"\r\n\r\n":
        return "length does not meet the record's end"
    block = data[body : body + int(size)]
    digest = headers.get("warc-block-digest", "")
    if digest[:5].lower() == "sha1:" and digest[5:].upper() != base32_sha1(block) and digest[5:].lower() != hashlib.sha1(block).hexdigest():
        return "block digest differs"
    return Record(at, headers, block), body + int(size) + 4


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of one archive, plain or with gzip members, in order.

    Where a check fails, the next byte position at which a whole valid record starts (a gzip member that inflates
    to one, or a version line) is sought, and what lies between is one gap. Within a member's inflated bytes the next
    version line is sought alike; such a gap has the member's bounds and names the inflated bytes. A member that is
    cut short or damaged gives its whole records but one at the very end, which nothing after it confirms; its
    bytes are a gap all the same. Empty input has neither.
    """
    at, n, bad, reason = 0, len(data), None, ""
    view = memoryview(data)
    while at < n:
        found = _gzip_record(view, at) if data.startswith(_MEMBER, at) else _plain_record(data, at)
        if isinstance(found, str):
            if bad is None:
                bad, reason = at, found
            a, b = data.find(_MEMBER, at + 1), _VERSION.search(data, at + 1)
            at = min(x for x in (a if a >= 0 else n, b.start() if b else n))
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        records, stop, *fault = found
        yield from records
        if fault:
            bad, reason = at, f"{fault[0]}; records kept: {len(records)}"
        at = stop
    if bad is not None:
        yield Gap(bad, n, reason)


def _plain_record(data: bytes, at: int):
    got = _parse(data, at, len(data))
    return got if isinstance(got, str) else ([got[0]], got[1])


def _inflate(view: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """(inflated bytes, where the member stops, what is wrong with it); up to the fault if there is one."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof and pos < len(view):
        before = z.copy() if step > 1 else None
        try:
            out.append(z.decompress(view[pos : pos + step]))
            pos += step
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"gzip: {e}"
            z, step = before, step >> 8 or 1  # once more in smaller steps, to keep what comes before the fault
    if not z.eof:
        return b"".join(out), len(view), "member cut short"
    return b"".join(out), min(pos, len(view)) - len(z.unused_data), ""


def _gzip_record(view: memoryview, at: int):
    data, stop, fault = _inflate(view, at)
    items, p, bad, reason = [], 0, None, ""
    while p < len(data):
        got = _parse(data, p, len(data))
        if isinstance(got, str):
            if bad is None:
                bad, reason = p, got
            m = _VERSION.search(data, p + 1)
            p = m.start() if m else len(data)
            continue
        if bad is not None:
            items.append(Gap(at, stop, f"inflated bytes {bad} to {p}: {reason}"))
            bad = None
        if not fault or got[1] < len(data):
            items.append(Record(at, got[0].headers, got[0].block))
        p = got[1]
    if bad is not None:
        items.append(Gap(at, stop, f"inflated bytes {bad} to {p}: {reason}"))
    records = [x for x in items if isinstance(x, Record)]
    if fault:
        # what follows the member's start is sought for other members
        return (records, at + 1, fault) if records else fault
    return (items, stop) if records or not data else reason


def plan_revisits(df: DataFrame, id_col: str, digest_col: str, size_col: str, least: int) -> DataFrame:
    """Add ``refers_to``: the smallest id with an equal payload, for all other rows of at least ``least`` bytes.

    Only digests that occur twice are joined, so distinct payloads need not move when these are few; the join is
    an outer one by digest, which splits a hot digest.
    """
    copies = df.where(F.col(size_col) >= least).groupBy(F.col(digest_col).alias("copy_digest")).agg(F.min(id_col).alias("copy_first"), F.count("*").alias("copy_n")).where("copy_n > 1").drop("copy_n")
    joined = df.join(copies, (F.col(digest_col) == F.col("copy_digest")) & (F.col(size_col) >= least), "left")
    refers = F.when(F.col("copy_first") != F.col(id_col), F.col("copy_first"))
    return joined.withColumn("refers_to", refers).drop("copy_digest", "copy_first")


def write_archives(df: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write every row as a WARC record; return the manifest ``path, n_records, n_bytes``.

    Null html is empty, null url is named after the id; a row with a null id or one that repeats the smallest id
    is a response; an empty table writes nothing. Files roll at ``roll_bytes``. Each attempt of a task writes files
    of its own, and only those in the (materialised) manifest count, so a lost executor leaves no half archive.
    """
    rows = df.select(df[id_col].cast("long").alias("i"), df[url_col].cast("string").alias("u"), F.encode(F.coalesce(df[html_col].cast("string"), F.lit("")), "UTF-8").alias("p"))
    rows = rows.withColumn("d", F.sha1("p")).withColumn("n", F.length("p"))
    rows = plan_revisits(rows, "i", "d", "n", least).select("i", "u", "p", "refers_to")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(root, recursive=True)
        sink, path, records, size, done = None, "", 0, 0, []
        for b in batches:
            for i, u, p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if sink is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(path, compression=None)
                payload = p.as_py()
                rec = record_bytes(i, u, payload, base32_sha1(payload), r)
                sink.write(rec)
                records, size = records + 1, size + len(rec)
                if size >= roll_bytes:
                    sink.close()
                    sink = None
                    done.append((path, records, size))
        if sink is not None:
            sink.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return materialize(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


RECORDS = "path string, offset long, gap_end long, gap_reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _rows(path: str, data: bytes, payloads: bool, most: int = 16 << 20):
    """Record batches of an archive's rows, about ``most`` bytes of payload (or 4,096 rows) each."""
    page = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x or "")) else None
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch(rows):
        cols = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    rows, size = [], 0
    for r in salvage(data):
        if isinstance(r, Gap):
            rows.append((path, r.start, r.end, r.reason, None, None, None, None, None, None, None))
        else:
            h, revisit = r.headers, r.headers.get("warc-type") == "revisit"
            stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
            payload = r.payload if payloads and not revisit else None
            rows.append((path, r.offset, None, None, page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), r.payload_length if revisit else len(r.payload), stated if revisit else base32_sha1(r.payload), page(h.get("warc-refers-to")), payload))
            size += len(payload or b"")
        if size >= most or len(rows) >= 4096:
            yield batch(rows)
            rows, size = [], 0
    yield batch(rows)


def read_archives(manifest: DataFrame, out_dir: str, payloads: bool = False) -> DataFrame:
    """Rows of the archives in a (materialised) manifest: records, and gaps (``gap_end`` set) that were quarantined.

    A task for each archive: it holds one file, which rolls at a bounded size, and a bounded batch of rows.
    """
    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    yield from _rows(path, f.read(), payloads)
        trim()

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """The same for any files that Spark can read (``path`` may be a glob); each is read whole by one task. Empty files
    have no rows; damage is a gap; a file of no records is one gap."""
    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _rows(p, c.as_py(), payloads)
        trim()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def round_trip(df: DataFrame, least: int = 0) -> tuple[DataFrame, str]:
    """Archives of ``page_id, url, html`` rows in the shared folder, read back."""
    out = shared_dir(df.sparkSession, "warc")
    return read_archives(write_archives(df, out, least=least), out), out
