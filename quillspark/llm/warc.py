"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Each record is a gzip member of its own. The reader takes member after member (or, where
bytes are not compressed, record after record) and checks each: the gzip checksum, the version line, the length
and the digest of the block. After a failed check it looks for the next member or version line that passes, goes on from
there and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import open_file, open_random, scratch, small_batches, written

#: Payloads below so many bytes are always written in full.
LEAST_REVISIT = 100
#: Bytes of a file after which the next begins.
FILE_BYTES = 256 << 20
LEVEL = 4
CHUNK = 1 << 18
#: Bytes of a packed member that are unpacked at once, and of a record's headers at most.
PIECE = 1 << 16
HEAD = 1 << 20
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("5d4f4a3e-6f0c-4c57-9a53-0f6b8f9a7a11")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed. refers_to: the page whose response this one repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def length(head: bytes) -> int:
    """The length that a record's headers declare, in any of its lines."""
    found = re.search(rb"\r\ncontent-length[ \t]*:[ \t]*([0-9]+)[ \t]*(\r\n|$)", head, re.IGNORECASE)
    if not found:
        raise ValueError("no length")
    return int(found[1])


def _agrees(head: dict[str, str], block: bytes) -> bool | None:
    """Whether the block has the digest that the headers give it, in hexadecimal or base32 digits; None if they give none that is known."""
    kind, _, want = head.get("warc-block-digest", "").partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5"):
        return None
    found = hashlib.new(kind.lower(), block).digest()
    return want.lower() == found.hex() or want.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-case name, block, and where the record ends. ValueError: not a whole, sound record."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    fields = (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
    head = {k.strip().lower(): v.strip() for k, _, v in fields}
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    begin, n = end + 4, int(head["content-length"])
    block = data[begin : begin + n]
    if len(block) < n or data[begin + n : begin + n + 4] != b"\r\n\r\n":
        raise ValueError("block cut short")
    if _agrees(head, block) is False:
        raise ValueError("block digest differs")
    return head, block, begin + n + 4


class _File:
    """Reads at any place; size, and the next place of some bytes. The last stretch read is kept."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        self.begin, self.kept = 0, b""

    def at(self, begin: int, n: int) -> bytes:
        n = max(0, min(n, self.size - begin))
        if not (self.begin <= begin and begin + n <= self.begin + len(self.kept)):
            self.begin, self.kept = begin, self.source.read_at(min(max(n, CHUNK), self.size - begin), begin)
        return self.kept[begin - self.begin : begin - self.begin + n]

    def find(self, what: bytes, begin: int) -> int:
        while begin < self.size:
            data = self.at(begin, CHUNK)
            k = data.find(what)
            if k >= 0:
                return begin + k
            begin += max(1, len(data) - len(what) + 1)
        return self.size


class _Unpacked:
    """A gzip member, unpacked piece by piece: `data` is what has been unpacked and not yet taken, `taken` how much was before it."""

    def __init__(self, f: _File, begin: int):
        self.f, self.begin, self.fed, self.piece = f, begin, begin, begin
        self.inflate, self.data, self.taken = zlib.decompressobj(31), bytearray(), 0
        self.error: str | None = None

    def more(self) -> bool:
        """Unpack another piece. False at the end, and where damage ends it: then all that could be unpacked has been."""
        if self.inflate.eof or self.error:
            return False
        data = self.f.at(self.fed, PIECE)
        if not data:
            self.error = "member cut short"
            return False
        self.piece = self.fed
        try:
            self.data += self.inflate.decompress(data)
        except zlib.error as e:
            self.error = f"member: {e}"
            self._last(data)
            return bool(self.data)
        self.fed += len(data)
        return True

    def _last(self, data: bytes) -> None:
        """What can be unpacked of the piece that holds the damage, byte by byte, with a fresh start as the failed one has lost its state."""
        again, at = zlib.decompressobj(31), self.begin
        while at < self.fed:
            part = self.f.at(at, min(PIECE, self.fed - at))
            again.decompress(part)
            at += len(part)
        try:
            for k in range(len(data)):
                self.data += again.decompress(data[k : k + 1])
        except zlib.error:
            pass

    def take(self, n: int) -> None:
        del self.data[:n]
        self.taken += n

    def record(self) -> tuple[dict[str, str], bytes]:
        """The record at the front, taken. ValueError: none there."""
        while len(self.data) < 10 and self.more():
            pass
        if not VERSION.match(self.data):
            raise ValueError("no version line")
        while (end := self.data.find(b"\r\n\r\n", 0, HEAD)) < 0 and len(self.data) < HEAD and self.more():
            pass
        if end < 0:
            raise ValueError("headers do not end")
        need = end + 8 + length(bytes(self.data[:end]))
        while len(self.data) < need and self.more():
            pass
        head, block, n = parse(bytes(self.data[:need]))
        self.take(n)
        return head, block

    def skip(self) -> bool:
        """Go to the next version line. False: none is left, and all is taken."""
        start = 1
        while not (found := VERSION.search(self.data, start)):
            self.take(max(0, len(self.data) - 9))
            start = 0
            if not self.more():
                self.take(len(self.data))
                return False
        self.take(found.start())
        return True


def _undamaged(f: _File, at: int) -> bool:
    """Whether the member unpacks without an error, as far as it goes."""
    u = _Unpacked(f, at)
    while u.more():
        u.take(len(u.data))
    return not u.error or u.error == "member cut short"


class _Place:
    """What came of reading at a place: where what stands there ends, or why it is not sound and from where to look on."""

    def __init__(self, at: int):
        self.at = self.end = self.bad = at
        self.reason: str | None = None
        self.inner: list[tuple[int, int, str]] = []  # gaps of the unpacked bytes
        self.last: list[dict[str, str]] = []  # heads of the records that ended in the last piece


def _members(f: _File, place: _Place) -> Iterator[tuple[dict[str, str], bytes]]:
    """The sound records of the gzip member there, up to where damage ends it."""
    u, count, trusted = _Unpacked(f, place.at), 0, None
    while u.data or u.more():
        begin, piece = u.taken, u.piece
        try:
            found = u.record()
            if _agrees(*found) is None:
                trusted = _undamaged(f, place.at) if trusted is None else trusted
                if not trusted:
                    place.inner.append((begin, u.taken, "no digest, in a damaged member"))
                    continue
        except ValueError as e:
            reason, going = str(e), u.skip()
            # the rest of a damaged member is no gap of its own
            if going or not u.error:
                place.inner.append((begin, u.taken, reason))
            continue
        count += 1
        if u.piece != piece or u.piece != place.bad:
            place.last = []
        place.bad = u.piece
        place.last.append(found[0])
        yield found
    place.end = min(f.size, u.fed + PIECE) if u.error else u.fed - len(u.inflate.unused_data)
    if u.error:
        place.reason = u.error + (f"; {count} records before it are whole" if count else "")
    elif not count:
        place.reason, place.bad = place.inner[0][2] if place.inner else "no version line", place.at


def _plain(f: _File, place: _Place) -> Iterator[tuple[dict[str, str], bytes]]:
    """The record of plain bytes there. No more is read than its declared length."""
    try:
        data = f.at(place.at, PIECE >> 3)
        if not VERSION.match(data):
            raise ValueError("no version line")
        if (end := data.find(b"\r\n\r\n")) < 0:
            data = f.at(place.at, HEAD)
            if (end := data.find(b"\r\n\r\n")) < 0:
                raise ValueError("headers do not end")
        need = end + 8 + length(data[:end])
        if place.at + need > f.size:
            raise ValueError("block cut short")
        head, block, n = parse(f.at(place.at, need))
        place.end = place.at + n
        yield head, block
    except ValueError as e:
        place.reason = str(e)


def salvage(source) -> Iterator[tuple]:
    """All sound records of an open file, as ("record", headers, block), and the bytes between them, as ("gap", begin, end, reason).

    Gzip members and plain records may follow each other in any order. Of a gap within a sound member, the place is the member's, and
    the reason names the bytes of its unpacked content that are lost. A damaged member gives the records that are sound by their own digest, or before a cut; its gap begins in the piece of the file
    (64 KB at most) where the last of them ends. In memory is one record at a time, and what its header says it is long.
    """
    f = _File(source)
    places = {GZIP: -1, b"WARC/1.": -1}  # the next of each; none before it is sought again
    at, gap, known, known_to = 0, None, [], 0
    while at < f.size:
        place, again = _Place(at), False
        for head, block in (_members if f.at(at, 3) == GZIP else _plain)(f, place):
            if at < known_to and head in known:  # stored, not packed, in the member that was damaged
                again = True
                continue
            if gap:
                yield "gap", gap[0], at, gap[1]
                gap = None
            yield "record", head, block
        for begin, end, reason in place.inner if place.reason is None or place.bad > at else ():
            yield "gap", at, place.bad if place.reason else place.end, f"{reason}, bytes {begin} to {end} of the unpacked member"
        if place.reason is None and not again:
            at = place.end
            continue
        if not again:
            if place.last:
                known, known_to = place.last, place.end
            gap = gap or (place.bad, place.reason)
        start = place.end if again else max(at + 1, place.bad)
        for what, k in places.items():
            if k < start:
                places[what] = f.find(what, start)
        at = min(places.values())
    if gap:
        yield "gap", gap[0], f.size, gap[1]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; one row per file: path, n.

    Of records with equal payloads of at least 100 bytes, that with the smallest id (null last) is written in full, the others
    as revisits of it; rows that repeat its id too are written in full. A null html is empty, a null url is left out. The table returned names
    the files of attempts that ended well, so what a lost task left is never read.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    slim = rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("id", "digest", F.octet_length("html").alias("n"))
    groups = slim.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 AND first IS NOT NULL").drop("rows", "n")
    again = slim.join(groups, "digest").filter("NOT (id <=> first)").select("id", "digest", "first").distinct()
    tagged = rows.join(again.withColumnsRenamed({"id": "i", "digest": "d"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")

    def write(batches):
        out, path, n = None, "", 0
        for batch in batches:
            for page, url, text, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = open_file(path, True)
                    info = b"format: WARC File Format 1.1\r\n"
                    out.write(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + f"<urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                out.write(member(record(page, url, text.encode(), digest, first, date)))
                n += 1
                if out.tell() >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    return written(tagged.select("id", "url", "html", "digest", "first").mapInArrow(write, "path string, n long"), "warc-files")


READ = "path string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_begin long, gap_end long, gap_reason string"


def read_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row for each response and revisit record, and one for each gap (record_type 'gap') of the files in the column `path`."""
    paths = [r.path for r in files.select("path").orderBy("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], READ)

    def row(path: str, x: tuple) -> tuple | None:
        if x[0] == "gap":
            return (path, None, None, None, None, "gap", None, *x[1:])
        _, head, block = x
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            n, digest = number("x-payload-length"), head.get("warc-payload-digest", "").partition(":")[2]
        return (path, head.get("warc-target-uri"), number("x-page-id"), n, digest, kind, number("x-refers-to-page-id"), None, None, None)

    named = spark.sparkContext.broadcast(paths)

    def read(batches):
        paths = named.value
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with open_random(paths[k]) as source:
                    rows = []
                    for x in salvage(source):
                        r = row(paths[k], x)
                        if r:
                            rows.append(r)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in READ.split(", ")])

    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(read, READ)


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives of all pages and read them back: one row per page (read_warc without gaps)."""
    spark = pages.sparkSession
    found = read_warc(spark, write_warc(pages, folder or scratch(spark, "warc"), id_col, url_col, html_col))
    return found.filter("record_type <> 'gap'").select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_warc": op9_warc}
ORACLES = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM g
"""
}
