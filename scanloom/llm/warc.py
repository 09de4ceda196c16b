"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

The reader checks each record: the gzip member's checksum, the version line, the length and its end, and the digests. When
a check fails it looks byte by byte for the next place where a member or a version line begins a record that passes all
checks, goes on from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import bounded_batches, join_groups, materialise, scratch_path

#: Bytes of an archive before the next one is begun; bytes read at once.
ARCHIVE_BYTES, READ = 32 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Where a record may begin. What is before it may have lost its end, so a version line needs no line end before it.
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    """Characters that would end a header or an id are written as in URLs."""
    text = "" if page_id is None else str(page_id)
    return f"<urn:page:{re.sub(r'[^!-*,-=?-~]|%', lambda m: ''.join(f'%{c:02X}' for c in m[0].encode()), text)}>"


def record(page_id, url: str | None, payload: bytes, first_id: tuple | None = None) -> bytes:
    """A response record, or a revisit record of the page in ``first_id``."""
    head = _HTTP % len(payload)
    block = head if first_id else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if first_id else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first_id:
        lines += [f"WARC-Refers-To: {record_id(first_id[0])}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, the same for the same data."""
    c = zlib.compressobj(5, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    """A record read back, or a gap (kind "gap") of ``stop - start`` bytes of the archive and why it is there."""

    start: int
    stop: int
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else self.block


class Bad(ValueError):
    pass


class Reader:
    """Records and gaps of one archive, from a file with seek and read; a record is held in memory, the archive is not."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not (self.base <= at and at + n <= self.base + len(self.held)):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, READ))
        return self.held[at - self.base : at - self.base + n]

    def records(self) -> Iterator[Record]:
        at = gap = 0
        reason = ""
        while at < self.size:
            try:
                found, to, why = self.unit(at)
            except Bad as e:
                reason = reason or str(e)
                at = self.next_begin(at + 1)
                continue
            if gap < at:
                yield Record(gap, at, "gap", reason=reason or "bytes before a record")
            yield from found
            at = gap = to
            reason = why
        if gap < self.size:
            yield Record(gap, self.size, "gap", reason=reason or "bytes after the last record")

    def next_begin(self, at: int) -> int:
        while at < self.size:
            part = self.bytes_at(max(0, at - 1), READ)
            skip = at - max(0, at - 1)
            m = _BEGIN.search(part, skip)
            if m:
                return max(0, at - 1) + m.start()
            if max(0, at - 1) + len(part) >= self.size:
                break
            at = max(0, at - 1) + len(part) - 8
        return self.size

    def unit(self, at: int) -> tuple[list[Record], int, str]:
        """The records of the member, or the record, that begins at ``at``, where it ends, and why it ends early if it does.

        Of a member with a bad record those around it are kept, and the record is a gap. Of a member that breaks off those
        are kept that another one follows; all its bytes but the first are then a gap, up to where the next member or version
        line is found.
        """
        head = self.bytes_at(at, 16)
        if head[:3] == b"\x1f\x8b\x08":
            data, to, reason = self.inflate(at)
            to = at + 1 if reason else to  # where it broke isn't known: the next member may have been taken for a part of it
            out, k, lost = [], 0, None
            gap = lambda: out.append(Record(at, to, "gap", reason=f"{lost[1]}: bytes {lost[0]} to {k} of the member"))
            while k < len(data):
                try:
                    r, after = self.parse(data, k)
                except Bad as e:
                    lost = lost or (k, str(e))
                    m = _VERSION.search(data, k + 1)
                    k = m.start() if m else len(data)
                    continue
                if reason and after >= len(data):
                    break
                if lost:
                    gap()
                    lost = None
                r.start, r.stop, k = at, to, after
                out.append(r)
            if all(r.kind == "gap" for r in out):
                raise Bad(reason or (lost[1] if lost else "an empty member"))
            if lost and not reason:
                gap()
            return out, to, reason
        if not head.startswith(b"WARC/"):
            raise Bad("neither a member nor a version line")
        n = 1 << 12
        while True:
            data = self.bytes_at(at, min(n, self.size - at))
            end = data.find(b"\r\n\r\n")
            if end >= 0 or len(data) < n or n > 1 << 20:
                break
            n *= 4
        need = end + 8 + self.length(self.headers(data[: end + 4])) if end >= 0 else 0
        if end < 0 or at + need > self.size:
            raise Bad("a record without an end")
        r, k = self.parse(self.bytes_at(at, need), 0)
        r.start, r.stop = at, at + k
        return [r], at + k, ""

    def inflate(self, at: int) -> tuple[bytes, int, str]:
        """What a member holds, where it ends, and why that is before its end if it is."""
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            part = self.bytes_at(at, min(READ, self.size - at))
            if not part:
                return b"".join(out), at, "a member without an end"
            before = d.copy()
            try:
                out.append(d.decompress(part))
            except zlib.error as e:
                for k in range(0, len(part), 512):  # up to the bytes that are broken
                    try:
                        out.append(before.decompress(part[k : k + 512]))
                    except zlib.error:
                        return b"".join(out), at + max(k, 1), f"a broken member: {e}"
                return b"".join(out), at + len(part), f"a broken member: {e}"
            at += len(part)
            if len(out) == 1 and len(out[0]) >= 5 and b"WARC/" not in out[0]:
                raise Bad("a member that isn't a record")
        return b"".join(out), at - len(d.unused_data), ""

    @staticmethod
    def headers(head: bytes) -> dict[str, str]:
        if not _VERSION.match(head):
            raise Bad("no version line")
        out: dict[str, str] = {}
        last = ""
        for line in head.split(b"\r\n")[1:]:
            if line[:1] in (b" ", b"\t") and last:
                out[last] += " " + line.strip().decode("utf-8", "replace")
            elif line:
                name, colon, value = line.partition(b":")
                if not colon:
                    raise Bad("a header line without a colon")
                last = name.strip().decode("utf-8", "replace").lower()
                out[last] = value.strip().decode("utf-8", "replace")
        return out

    @staticmethod
    def length(headers: dict[str, str]) -> int:
        if not re.fullmatch(r"[0-9]{1,18}", n := headers.get("content-length", "")):
            raise Bad("no content length")
        return int(n)

    @classmethod
    def parse(cls, data: bytes, at: int) -> tuple[Record, int]:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise Bad("headers without an end")
        headers = cls.headers(data[at : end + 4])
        to = end + 4 + cls.length(headers)
        block = data[end + 4 : to]
        if data[to : to + 4] != b"\r\n\r\n":
            raise Bad("a block of another length")
        r = Record(at, to + 4, headers.get("warc-type", ""), headers, block)
        checks = [("warc-block-digest", block)] + [("warc-payload-digest", r.payload)] * (r.kind != "revisit")
        for name, content in checks:
            kind, _, value = headers.get(name, "").partition(":")
            if kind.lower() == "sha1" and value.upper() not in (sha1(content), hashlib.sha1(content).hexdigest().upper()):
                raise Bad(f"another {name}")
        return r, to + 4


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """path and n_records of archives in the shared folder with one record per row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a response and the others
    revisit it; rows that repeat the smallest id are all responses. A null html is an empty payload.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    narrow = materialise(rows.select("page_id", "digest", F.length("payload").alias("n")), "payloads")
    shared = narrow.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    shared = materialise(shared, "shared")
    # only ids of revisiting rows meet the pages again, so equal payloads never gather
    again = join_groups(narrow, shared, "digest", "copies", narrow.count()).filter("not page_id <=> first_id")
    again = materialise(again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first_id").distinct(), "again")
    roles = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    roles = roles.select("page_id", "url", "payload", "first_id", F.col("again_digest").isNotNull().alias("revisit"))
    folder = scratch_path(spark, "warc")
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            store, where = pafs.FileSystem.from_uri(path)
            store.create_dir(os.path.dirname(where))
            with store.open_output_stream(where, compression=None) as file:
                for m in held:
                    file.write(m)
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

        for b in batches:
            for page_id, url, payload, first, revisit in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                held.append(member(record(page_id, url, payload, (first,) if revisit else None)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return materialise(roles.mapInArrow(written, "path string, n_records bigint"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record and per gap of the archives in the column ``path``, one archive to a task.

    path, start, stop, kind (the record's type, or "gap"), record_id, url, refers_to, payload_digest (as the record has
    it), payload_bytes, payload_sha1 (of the payload read), payload (if asked for), reason (of a gap). An archive of no
    bytes has no rows.
    """
    kinds = {"path": pa.string(), "start": pa.int64(), "stop": pa.int64(), "kind": pa.string(), "record_id": pa.string(), "url": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload_sha1": pa.string(), "payload": pa.binary(), "reason": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
            out.clear()
            return batch

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    for r in Reader(file, file.size()).records():
                        h, p = r.headers, r.payload
                        digest = h.get("warc-payload-digest", "").partition(":")[2] or None
                        gap = r.kind == "gap"
                        out.append((path, r.start, r.stop, r.kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, None if gap else len(p), None if gap else sha1(p), p if with_payload and not gap else None, r.reason or None))
                        size += len(p) if with_payload else 0
                        if len(out) >= 1000 or size > 8 << 20:
                            yield flush()
                            size = 0
        if out:
            yield flush()

    n = min(10_000, max(1, archives.count()))
    schema = "path string, start bigint, stop bigint, kind string, record_id string, url string, refers_to string, payload_digest string, payload_bytes bigint, payload_sha1 string, payload binary, reason string"
    rows = archives.select("path").repartition(n).mapInArrow(read, schema)
    return rows if with_payload else rows.drop("payload")


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """Write archives of ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are those of the full payload; a revisit's bytes come from the record that it refers to. One row per
    row of ``pages``; null ids and null urls are kept, and ids that repeat are that many records; an empty table gives an empty result; other columns are ignored.
    """
    kind = pages.schema[id_col].dataType
    read = materialise(read_archives(write_archives(pages, min_bytes, id_col=id_col)).filter("kind in ('response', 'revisit')"), "records")
    id_of = lambda c: F.nullif(F.url_decode(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)), F.lit("")).cast(kind)
    first = read.filter("kind = 'response'").groupBy(F.col("record_id").alias("first_record"), F.col("payload_sha1").alias("first_sha1")).agg(F.max("payload_bytes").alias("first_bytes"))
    # a page that very many others revisit: its group is known by the page and its size, and isn't gathered
    again = read.filter("kind = 'revisit'").withColumn("to", F.concat_ws(" ", "refers_to", "payload_digest"))
    sizes = again.groupBy("to").agg(F.count(F.lit(1)).alias("times"))
    groups = materialise(sizes.join(first.withColumn("first_to", F.concat_ws(" ", "first_record", "first_sha1")), F.col("to") == F.col("first_to"), "left").select("to", "times", "first_bytes"), "revisited")
    rows = join_groups(again, groups, "to", "times", again.count())
    revisits = rows.select(id_of("record_id").alias("page_id"), F.col("first_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), id_of("refers_to").alias("refers_to"))
    responses = read.filter("kind = 'response'").select(id_of("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    return responses.unionByName(revisits)
