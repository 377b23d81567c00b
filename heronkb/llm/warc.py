"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Writing. Each row is a record; the payload is the html in UTF-8 (null: empty). Of records with equal
payloads of at least ``revisit_bytes`` bytes, the one with the largest id is a response and the others
revisit it; smaller payloads are all responses. Rows that share that largest id are all responses, and
so are equal payloads whose ids are all null. Each record is a gzip member of its own. Tasks write
under names of their own attempt and only the files of the attempts that count are listed, so a lost
executor or a second attempt leaves at worst a file that nobody reads.

Reading. A record counts if its member's checksum, its header, its length and its block digest hold.
After a failed check the reader looks for the next member or version line that begins a valid record,
goes on there, and logs the bytes between as a gap with the reason. It never keeps more of a file than
one record of at most ``most`` bytes and a read-ahead. False headers cost no more than themselves unless
a blank line stands where they say that their block ends; then the block is read for its digest. The
members of foreign archives are read whole, so one of more than ``most`` bytes unpacked is a gap.

Edge cases: null URLs have no target header, control characters in one are escaped; rows with null or
repeated ids are written and read each on its own; an empty table gives no rows; an empty or foreign
file is one gap or nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import checkpointed, shared_folder

REVISIT_BYTES, ARCHIVE_BYTES, MOST, LEVEL = 1000, 64 << 20, 256 << 20, 5
OWN = 1 << 32  # more than a record made of one value can have
DATE = "1970-01-01T00:00:00Z"
_CHUNK = 1 << 18
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as plain bytes; length and block digest are added."""
    lines = {**headers, "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"".join((b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in lines.items()), b"\r\n", block, b"\r\n\r\n"))


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    name = lambda key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Page-Id": str(refers_to), "X-Payload-Length": str(len(payload))}
    return record(headers, _HTTP + (payload if refers_to is None else b""))


class Ahead:
    """A forward reader that keeps the bytes from ``base`` on."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.base, self.kept, self.over = file, 0, bytearray(), False
        self.clear = 0, 0  # no blank line begins from the one up to the other

    def to(self, end: int) -> None:
        while not self.over and self.base + len(self.kept) < end:
            more = self.file.read(max(_CHUNK, end - self.base - len(self.kept)))
            self.over = not more
            self.kept += more

    def get(self, a: int, b: int) -> bytes:
        self.to(b)
        return bytes(self.kept[a - self.base : b - self.base])

    def drop(self, before: int) -> None:
        if before - self.base >= _CHUNK:
            del self.kept[: before - self.base]
            self.base = before

    def find(self, pattern: bytes, start: int) -> int:
        """Place of the next match, or -1; what lies before it is let go."""
        while True:
            at = self.kept.find(pattern, max(0, start - self.base))
            if at >= 0:
                return self.base + at
            end = self.base + len(self.kept)
            self.to(end + _CHUNK)
            if self.over and self.base + len(self.kept) == end:
                return -1
            start = max(start, end - len(pattern) + 1)
            self.drop(start)

    def blank_line(self, start: int, most: int) -> int:
        """Place of the next blank line within ``most`` bytes, or -1; what was searched before is not searched again."""
        low, known = self.clear
        if not low <= start <= known:
            low = known = start
        at = -1
        while known - start <= most:
            self.to(known + _CHUNK)
            at = self.kept.find(b"\r\n\r\n", known - self.base)
            known = self.base + at if at >= 0 else max(known, self.base + len(self.kept) - 3)
            if at >= 0 or self.over:
                break
        self.clear = low, known
        return known if at >= 0 and known - start <= most else -1


class Found(NamedTuple):
    start: int
    end: int
    headers: dict[str, str] | None  # None: a gap
    block: bytes
    reason: str


class Damage(Exception):
    pass


def _parse(data: Ahead, at: int, most: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the plain record at a place."""
    if not _LINE.match(data.get(at, at + 10)):
        raise Damage("no version line")
    end = data.blank_line(at, most)
    if end < 0:
        raise Damage("header without end")
    headers, line = {}, at + 10
    while line < end:  # line by line, so that a false header is left at its first bad line
        stop = data.find(b"\r\n", line)
        k, colon, v = data.get(line, stop).partition(b":")
        if not colon:
            raise Damage("header line without colon")
        headers[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
        line = stop + 2
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or int(length) > most:
        raise Damage("bad length")
    start = end + 4
    stop = start + int(length)
    # The end is looked at first: a false length is seen without a copy of what it spans.
    if data.get(stop, stop + 4) != b"\r\n\r\n":
        raise Damage("truncated block")
    block = data.get(start, stop)
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and len(digest) == 40 and hashlib.sha1(block).hexdigest() != digest.lower():
        raise Damage("block digest differs")
    return stop + 4, headers, block


def _inflate(data: Ahead, at: int, most: int) -> tuple[int, bytes]:
    """End and content of the gzip member at a place."""
    unpack, out, here, step = zlib.decompressobj(31), bytearray(), at, 1 << 10
    try:
        while not unpack.eof:
            part = data.get(here, here + step)
            if not part:
                raise Damage("truncated member")
            here, step = here + len(part), min(2 * step, _CHUNK)  # a false start fails within little
            out += unpack.decompress(part, most + (1 << 20) - len(out))
            if len(out) > most or unpack.unconsumed_tail:
                raise Damage("member too large")
    except zlib.error:
        raise Damage("member checksum or data") from None
    return here - len(unpack.unused_data), bytes(out)


class _Bytes:
    def __init__(self, data: bytes) -> None:
        self.data = data

    def read(self, _: int) -> bytes:
        out, self.data = self.data, b""
        return out


def _plain(data: Ahead, most: int) -> Iterator[Found]:
    at, bad, reason = 0, None, ""
    while data.get(at, at + 1):
        try:
            end, headers, block = _parse(data, at, most)
        except Damage as why:
            bad, reason = (at, str(why)) if bad is None else (bad, reason)
            nearest = data.find(_VERSION, at + 1)
            if nearest < 0:
                break
            at = nearest
            continue
        if bad is not None:
            yield Found(bad, at, None, b"", reason)
            bad = None
        yield Found(at, end, headers, block, "")
        at = end
        data.drop(at)
    end = data.base + len(data.kept)
    if bad is not None and end > bad:
        yield Found(bad, end, None, b"", reason)


def _members(data: Ahead, most: int) -> Iterator[Found]:
    at, bad, reason = 0, None, ""
    while data.get(at, at + 1):
        try:
            if data.get(at, at + 3) != _MAGIC:
                raise Damage("no member")
            end, content = _inflate(data, at, most)
            inside = list(_plain(Ahead(_Bytes(content)), most))
            if not any(x.headers for x in inside):
                raise Damage(inside[0].reason if inside else "empty member")
        except Damage as why:
            bad, reason = (at, str(why)) if bad is None else (bad, reason)
            nearest = data.find(_MAGIC, at + 1)
            if nearest < 0:
                break
            at = nearest
            continue
        if bad is not None:
            yield Found(bad, at, None, b"", reason)
            bad = None
        for x in inside:  # a gap inside a sound member has the member's place
            yield x._replace(start=at, end=end)
        at = end
        data.drop(at)
    end = data.base + len(data.kept)
    if bad is not None and end > bad:
        yield Found(bad, end, None, b"", reason)


def salvage(file: BinaryIO, most: int = MOST) -> Iterator[Found]:
    """Records and gaps of an archive, plain or of gzip members, in order of place."""
    data = Ahead(file)
    head = data.get(0, _CHUNK)
    packed = _MAGIC in head and not (_VERSION in head and head.find(_VERSION) < head.find(_MAGIC))
    yield from (_members if packed else _plain)(data, most)


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, harm: Callable[[str, bytes], tuple[bytes, int]] | None = None) -> DataFrame:
    """Writes all rows to archives in a folder that all executors reach, and returns path, records, bytes, harmed.

    ``harm`` is for rehearsals of the salvage: it gets digest and member, and returns what to write and
    how many bytes of that are lost to a reader.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    copies = rows.where(F.col("size") >= revisit_bytes).groupBy(F.col("digest").alias("same"), F.col("size").alias("same_size")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    dealt = rows.join(copies, (F.col("digest") == F.col("same")) & (F.col("size") == F.col("same_size")), "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        file, path, count, size, lost, part = None, "", 0, 0, 0, 0

        def done() -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([n], pa.int64()) for n in (count, size, lost))], names=["path", "records", "bytes", "harmed"])

        for batch in batches:
            for key, address, text, digest, other in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if file is None:
                    path = f"{top}/part-{task.partitionId():06d}-{part:04d}-{uuid.uuid4().hex}.warc.gz"
                    file, count, size, lost, part = store.open_output_stream(path), 0, 0, 0, part + 1
                data = member(page_record(key, address, text.encode("utf-8", "replace"), digest, other, date))
                data, bad = harm(digest, data) if harm else (data, 0)
                file.write(data)
                count, size, lost = count + 1, size + len(data), lost + bad
                if size >= archive_bytes:
                    yield done()
                    file = None
        if file is not None:
            yield done()

    return checkpointed(dealt.mapInArrow(run, "path string, records bigint, bytes bigint, harmed bigint"))


def read_archives(paths: DataFrame, folder: str, *, path: str = "path", with_payload: bool = True, most: int = MOST) -> DataFrame:
    """Records and gaps of the archives named: path, start, end, gap (reason, null for records), and what a record holds.

    ``folder`` is a URI of the file system that holds them. For revisits, size and digest of the payload
    are those of the record that they refer to.
    """
    shape = "path string, start bigint, end bigint, gap string, record_type string, record_id string, url string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string"
    names = [x.split()[0] for x in shape.split(", ")] + ["payload"] * with_payload
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 3, pa.string(), pa.binary()][: len(names)]

    def row(name: str, x: Found) -> tuple:
        if x.headers is None:
            return (name, x.start, x.end, x.reason, *[None] * (len(names) - 4))
        get = x.headers.get
        payload = x.block.partition(b"\r\n\r\n")[2] if get("content-type", "").startswith("application/http") else x.block
        named = get("warc-payload-digest", "").partition(":")[2]
        revisit = get("warc-type") == "revisit"
        size, digest = (int(get("x-payload-length", 0)), named) if revisit else (len(payload), hashlib.sha1(payload).hexdigest())
        number = lambda k: int(v) if re.fullmatch(r"-?\d+", v := get(k, "")) else None
        gap = "payload digest differs" if not revisit and len(named) == 40 and named != digest else None
        return (name, x.start, x.end, gap, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), size, digest, payload)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["path"].to_pylist():
                kept, held = [], 0
                with store.open_input_stream(name) as file:
                    for x in salvage(file, most):
                        kept.append(row(name, x))
                        held += len(x.block) if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names=names)
                            kept, held = [], 0
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names=names)

    return paths.select(F.col(path).alias("path")).mapInArrow(run, shape + ", payload binary" * with_payload)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, from archives written to the shared folder and read back.

    The archives are its own, so a gap in them is an error and fails the query; no record is left out.
    """
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    back = read_archives(write_archives(pages, folder), folder, with_payload=False, most=OWN)
    sound = F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.format_string("gap in %s at %d to %d: %s", "path", "start", "end", "gap")).cast("boolean"))
    return back.where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def harmed(digest: str, data: bytes) -> tuple[bytes, int]:
    """Damage by the first digit of the digest: a wrong checksum, half a member, false starts before a sound one."""
    if digest[0] in "01":
        return data[:-8] + bytes([data[-8] ^ 255]) + data[-7:], len(data)
    if digest[0] in "23":
        return data[: len(data) // 2], len(data) // 2
    if digest[0] in "45":
        false = _MAGIC + b"false start WARC/1.1\r\n\r\n"
        return false + data, len(false)
    return data, 0


def salvage_digest(pages: DataFrame) -> DataFrame:
    """Rehearsal over all pages: archives with damage, read back. The records that are left, and one row of type gap
    whose payload_bytes are the damaged bytes that the gaps do not account for."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder, harm=harmed)
    back = checkpointed(read_archives(written, folder, with_payload=False, most=OWN))
    kept = back.where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    gaps = back.where("gap is not null").select((F.col("end") - F.col("start")).alias("n")).unionByName(written.select((-F.col("harmed")).alias("n")))
    return kept.unionByName(gaps.agg(F.lit(None).cast("bigint").alias("page_id"), F.abs(F.coalesce(F.sum("n"), F.lit(0))).alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"), F.lit("gap").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
SALVAGE_SQL = f"""
SELECT * FROM ({SQL}) WHERE substr(payload_digest, 1, 1) NOT IN ('0', '1', '2', '3')
UNION ALL SELECT NULL, 0, NULL, 'gap', NULL
"""
