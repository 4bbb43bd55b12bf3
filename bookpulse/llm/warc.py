"""WARC archives: a writer with revisit records, and a salvage reader.

Files hold one gzip member a record (WARC/1.1). The writer's payload digest is the record's content address: of records
with equal payloads, that with the largest id is the response, the others revisit it. The reader checks every record
(gzip checksum, version line, header block, Content-Length, closing lines, block digest, payload digest of whole
payloads; digests in base32 or hex). Where a check fails, it searches for the next place where a record begins, a gzip
member whose start inflates to a version line or a bare version line, goes on from there, and logs the bytes in between
as quarantined: ``gap`` rows with offset, length and reason. A gap and the records around it cover every byte of a file.
A member may hold many records; each has the member's bytes from the end of the one before, to the inflated piece.

A file is read in pieces of ``PIECE`` bytes. A stated length is believed only when the closing lines stand where it says,
which is looked up by seeking (inside a member by inflating ahead, keeping nothing); so a damaged length costs time, not
memory, and only the record at hand is held. A header block ends within ``HEADER`` bytes, and a record is at most
``LARGEST`` bytes, as a cell of a table can't be larger; what goes beyond either is damage.

Null payloads are empty, null ids sort before others and are written as an empty page id. Repeated rows (equal id and
payload) are the same record repeated: where theirs is the largest id all of them are responses, under one record id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookpulse.llm.common import filesystem, put_atomically, slices

VERSION, GZIP, CLOSE = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
PIECE, HEADER, LARGEST = 1 << 20, 16 << 20, (1 << 31) - (1 << 20)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, extra: Iterable[tuple[str, str]] = ()) -> bytes:
    """A record with its block: an HTTP response with the payload, or a revisit with the response's head only."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join(uri.split())),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        head[2:2] = [("WARC-Profile", _SAME), ("WARC-Refers-To", f"<{refers_to}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, *extra])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# ---- salvage reader -------------------------------------------------------------------------------------------


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    pass


class _Plain:
    """A file's bytes from a moving start on, read as needed."""

    def __init__(self, file):
        self.file, self.data, self.start = file, bytearray(), 0
        self.size = file.seek(0, 2) or file.tell()
        file.seek(0)

    @property
    def place(self) -> int:
        return self.start

    def upto(self, n: int) -> bool:
        """Whether n bytes are there, reading on."""
        while len(self.data) < n and (piece := self.file.read(max(PIECE, min(n - len(self.data), 64 * PIECE)))):
            self.data += piece
        return len(self.data) >= n

    def closes(self, at: int) -> bool:
        """Whether a record's closing lines stand at an offset, which may lie far ahead."""
        if at + 4 <= len(self.data):
            return self.data[at : at + 4] == CLOSE
        if self.start + at + 4 > self.size:
            raise Damaged("record cut off")
        here = self.file.tell()
        self.file.seek(self.start + at)
        found = self.file.read(4)
        self.file.seek(here)
        return found == CLOSE

    def skip(self, n: int) -> None:
        self.go(self.start + n)

    def go(self, start: int) -> None:
        """Let the window begin at a place of the file, inside or outside what it holds."""
        if 0 <= start - self.start <= len(self.data):
            del self.data[: start - self.start]
        else:
            self.data.clear()
            self.file.seek(start)
        self.start = start

    def peek(self, at: int, n: int) -> bytes:
        """Some of the n bytes at an offset, none at the file's end; the window doesn't grow."""
        if at < len(self.data):
            return bytes(self.data[at : at + n])
        here = self.file.tell()
        self.file.seek(self.start + at)
        found = self.file.read(n)
        self.file.seek(here)
        return found


class _Member:
    """The inflated bytes of the member at the start of a file's window, from a moving start on."""

    def __init__(self, outer: _Plain):
        self.outer, self.data, self.at, self.inflate = outer, bytearray(), 0, zlib.decompressobj(31)
        #: Bytes before the window; and where pieces of the window begin, inflated and in the file.
        self.before, self.marks = 0, deque([(0, outer.start)])

    @property
    def place(self) -> int:
        """Where in the file the piece begins that holds the window's start."""
        while len(self.marks) > 1 and self.marks[1][0] <= self.before:
            self.marks.popleft()
        return self.marks[0][1]

    @property
    def end(self) -> int:
        """Where in the file the inflated bytes end."""
        return self.outer.start + self.at

    def _next(self, inflate, at: int) -> tuple[bytes, int]:
        """Up to PIECE inflated bytes with the file read from ``at`` on, and where it goes on."""
        out = b""
        while not out and not inflate.eof:
            fed = self.outer.peek(at, 1 << 16)
            try:
                out = inflate.decompress(fed, PIECE)
            except zlib.error as e:
                raise Damaged(f"member: {str(e).rpartition(':')[2].strip()}") from None
            if not fed and not out and not inflate.eof:
                raise Damaged("member cut off")
            at += len(fed) - len(inflate.unused_data if inflate.eof else inflate.unconsumed_tail)
        return out, at

    def upto(self, n: int) -> bool:
        while len(self.data) < n and not self.inflate.eof:
            self.outer.upto(self.at + 1)
            self.marks.append((self.before + len(self.data), self.end))
            piece, self.at = self._next(self.inflate, self.at)
            self.data += piece
            if self.at > 4 * PIECE:
                self.outer.skip(self.at)
                self.at = 0
        return len(self.data) >= n

    def closes(self, at: int) -> bool:
        if at < 16 * PIECE and not self.upto(at + 4):
            raise Damaged("record cut off")
        if at + 4 <= len(self.data):
            return self.data[at : at + 4] == CLOSE
        ahead, where, seen, last = self.inflate.copy(), self.at, len(self.data), bytes(self.data[-4:])
        while seen < at + 4 and not ahead.eof:
            piece, where = self._next(ahead, where)
            last, seen = (last + piece)[-PIECE - 4 :], seen + len(piece)
        if seen < at + 4:
            raise Damaged("record cut off")
        end = len(last) - (seen - at - 4)
        return last[end - 4 : end] == CLOSE

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.before += n


def _same(want: str, data: bytes) -> bool:
    """Whether a digest as labelled in a header (base32 or hex, any case) is that of the data; unknown algorithms pass."""
    name, _, value = want.partition(":")
    if name.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    made = hashlib.new(name.lower(), data).digest()
    return value.upper().rstrip("=") in (base64.b32encode(made).decode().rstrip("="), made.hex().upper())


def _bare(w: _Plain | _Member) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at the window's start, which moves behind it; raises Damaged and stays there."""
    w.upto(len(VERSION))
    if not w.data.startswith(VERSION):
        raise Damaged("no version line")
    end, looked = w.data.find(CLOSE), 0
    while end < 0:
        looked = max(0, len(w.data) - 3)
        if looked > HEADER or not w.upto(len(w.data) + 1):
            raise Damaged("header block without end" if looked > HEADER else "record cut off")
        end = w.data.find(CLOSE, looked)
    headers = {}
    for line in bytes(w.data[:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no content length")
    first, size = end + 4, int(headers["content-length"])
    if size > LARGEST:
        raise Damaged("longer than a record can be")
    if not w.closes(first + size):
        raise Damaged("record without its closing lines")
    w.upto(first + size + 4)
    block = bytes(w.data[first : first + size])
    if not _same(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        _, gap, payload = block.partition(CLOSE)
        if not gap:
            raise Damaged("HTTP head without end")
    if headers.get("warc-type") == "response" and not _same(headers.get("warc-payload-digest", ""), payload):
        raise Damaged("payload digest differs")
    w.skip(first + size + 4)
    return headers, payload


def _begins(w: _Plain) -> bool:
    """Whether a record plausibly begins at the window's start: a version line, bare or as the first bytes of a member."""
    w.upto(4096)
    if w.data.startswith(VERSION):
        return True
    if not w.data.startswith(GZIP):
        return False
    try:
        return zlib.decompressobj(31).decompress(bytes(w.data[:4096]), len(VERSION)).startswith(VERSION)
    except zlib.error:
        return False


class _Log:
    """Where the last record ended, and the damage met since."""

    def __init__(self) -> None:
        self.end, self.reason = 0, None

    def record(self, headers: dict[str, str], payload: bytes, begin: int, end: int) -> Iterator[Record | Gap]:
        if self.reason:
            yield from self.gap(begin)
        yield Record(self.end, end - self.end, headers, payload)
        self.end = end

    def gap(self, end: int) -> Iterator[Gap]:
        """(A gap of no bytes lies between records of one inflated piece.)"""
        yield Gap(self.end, end - self.end, self.reason)
        self.end, self.reason = end, None

    def damaged(self, reason: str) -> None:
        self.reason = self.reason or reason


def _members(w: _Plain, log: _Log) -> Iterator[Record | Gap]:
    """Records of the member at the window's start, which moves behind it; raises Damaged where the member is.

    The record read last waits until more inflates behind it or the member has ended well, checksum included.
    """
    m, held, begin = _Member(w), None, w.start
    m.upto(len(VERSION))
    if not m.data.startswith(VERSION):
        raise Damaged("no version line")
    while m.upto(1):
        if held:
            yield from log.record(*held, m.place)
            held, begin = None, m.place
        try:
            held = (*_bare(m), begin)
        except Damaged as e:
            if str(e).startswith("member"):
                raise
            log.damaged(str(e))
            # On to the next version line of the member.
            at = m.data.find(VERSION, 1)
            while at < 0 and m.upto(len(m.data) + 1):
                m.skip(max(1, len(m.data) - PIECE - len(VERSION)))
                at = m.data.find(VERSION, 1)
            m.skip(at if at > 0 else len(m.data))
            begin = m.place
    if held:
        yield from log.record(*held, m.end)
    elif log.reason:
        yield from log.gap(m.end)
    w.skip(m.at)


def salvage(file) -> Iterator[Record | Gap]:
    """Records of an archive (a file that can seek) in order, and the gaps between them."""
    w, log = _Plain(file), _Log()
    while w.upto(1):
        tried = w.start
        if log.reason is None or _begins(w):
            try:
                w.upto(16)
                if w.data.startswith(GZIP):
                    yield from _members(w, log)
                    continue
                if not w.data.startswith(VERSION):
                    raise Damaged("no member or version line")
                headers, payload = _bare(w)
                yield from log.record(headers, payload, tried, w.start)
                continue
            except Damaged as e:
                log.damaged(str(e))
                w.go(max(log.end, tried))  # (records of a member that breaks off later are out already)
                w.upto(1)
        # On to the next byte where a record could begin.
        at = [i for i in (w.data.find(GZIP, 1), w.data.find(VERSION, 1)) if i > 0]
        if at:
            w.skip(min(at))
        else:
            w.skip(max(1, len(w.data) - len(VERSION) + 1))
    if log.reason:
        yield from log.gap(w.start)


# ---- datasets -------------------------------------------------------------------------------------------------

_WRITTEN = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("records", T.LongType(), False), T.StructField("bytes", T.LongType(), False)])


def _urn(page: int | None) -> str:
    """A record id that depends on the page alone, so that a task run again writes the same."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}").urn


def plan_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and response_id: the page whose response a page's record revisits, null for responses.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest id is the response. Digests
    are combined before the shuffle; only those that repeat are joined, and a hot one's pages can be split.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    repeated = (
        p.where(F.octet_length("html") >= least_bytes).groupBy(digest.alias("d")).agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    joined = p.withColumn("d", digest).join(repeated, "d", "left")
    same = (F.col("page_id") != F.col("response_id")) & (F.octet_length("html") >= least_bytes)
    return joined.select("page_id", "url", "html", F.when(F.coalesce(same, F.col("response_id").isNotNull() & F.col("page_id").isNull()), F.col("response_id")).alias("response_id"))


def write(planned: DataFrame, path: str) -> DataFrame:
    """Write a file of records a task; gives the manifest: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = f"{path}/part-{TaskContext.get().partitionId():07d}.warc.gz"
        n = [0]

        def body(stream) -> None:
            for b in batches:
                for part in slices(b, 2):
                    for page, uri, html, response in zip(*(c.to_pylist() for c in part.columns)):
                        payload = html.encode("utf-8", "surrogatepass")
                        extra = [("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload)))]
                        if response is None:
                            data = record("response", _urn(page), uri or "", payload, None, extra)
                        else:
                            data = record("revisit", _urn(page), uri or "", payload, _urn(response), [*extra, ("X-Refers-To-Page-ID", str(response))])
                        stream.write(member(data))
                        n[0] += 1

        size = put_atomically(target, body)
        yield pa.RecordBatch.from_pydict({"path": [target], "records": [n[0]], "bytes": [size]})

    done = planned.select("page_id", "url", "html", "response_id").mapInArrow(run, _WRITTEN).collect()  # one row a file; this is the write job
    return planned.sparkSession.createDataFrame(sorted(done), _WRITTEN)


_READ = T.StructType(
    [
        T.StructField("path", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("offset", T.LongType(), False), T.StructField("length", T.LongType(), False),
        T.StructField("reason", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
    ]
)


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Salvage-read the files that column ``path`` lists: kind (record or gap), offset, length, reason, headers, payload."""
    kinds = [("string", pa.string()), ("map", pa.map_(pa.string(), pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, held = [], 0
                fs, inner = filesystem(uri)
                with fs.open_input_file(inner) as file:
                    for x in salvage(file):
                        if isinstance(x, Gap):
                            rows.append((uri, "gap", x.offset, x.length, x.reason, None, None))
                        else:
                            rows.append((uri, "record", x.offset, x.length, None, list(x.headers.items()), x.payload if payloads else None))
                            held += len(x.payload)
                        if len(rows) >= 256 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), kinds[1][1], pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_READ.fieldNames())

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(run, _READ)
