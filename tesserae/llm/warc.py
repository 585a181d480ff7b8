"""WARC archives written from a table and read back as a chunked record table.

Each task streams its rows into one archive in the shared folder, a gzip member per record, payloads in pieces of CHUNK
bytes. An archive gets its name from the attempt that wrote it, and the manifest that Spark commits names only archives of
attempts that ended well, so lost executors and repeated tasks leave no record missing or double. Reading yields rows of
record id and chunk number, each with the digest of the payload so far; no payload is ever held whole.

Of records with equal payloads of at least ``least`` bytes the one with the greatest id is a response, the others revisit
it; payloads are compared by SHA-1, and a Bloom filter lets rows that repeat nothing pass without a shuffle.

Defined results for odd input: a null payload is an empty one; a null url leaves the target URI out; a null id is written
as an empty one, is never revisited and read back as null; rows that repeat the greatest id of a group are all responses;
payloads may be of any length; an empty table gives no archive and an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bloom
from tesserae.runtime import scratch_path, written

CHUNK = 1 << 18
LEAST = 1000
#: The longest HTTP head that is looked for.
HEAD = 1 << 20
#: Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"

_MANIFEST = "path string, records long"
_CHUNKS = "record_id long, url string, record_type string, refers_to long, chunk_no int, start long, length long, is_last boolean, payload_bytes long, payload_digest string, sound boolean, data binary"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def head(kind: str, record_id: int | None, url: str | None, refers_to: int | None, digest: bytes, payload: int, block: int, date: str) -> bytes:
    """The header block of a record whose content is ``block`` bytes and whose whole payload has ``payload``."""
    named = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{_URN}{'' if record_id is None else record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}",
        "WARC-Refers-To": None if kind != "revisit" else f"<{_URN}{refers_to}>",
        "WARC-Profile": None if kind != "revisit" else REVISIT_PROFILE,
        "Content-Type": f"application/http; msgtype={'response'}",
        # the payload of a revisit isn't in its record, so its length is told apart
        "X-Payload-Length": str(payload),
        "Content-Length": str(block),
    }
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None).encode() + b"\r\n"


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        path, out, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(path, compression=None, buffer_size=1 << 20)
            ids, urls, refers, digests = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
            sizes, payloads = batch.column(4).to_pylist(), batch.column(5)
            for i in range(batch.num_rows):
                kind = "response" if refers[i] is None else "revisit"
                data = payloads[i].as_buffer() if payloads[i].is_valid and kind == "response" else pa.py_buffer(b"")
                http = HTTP_HEAD.format(sizes[i]).encode() if kind == "response" else b""
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(pack.compress(head(kind, ids[i], urls[i], refers[i], digests[i], sizes[i], len(http) + data.size, date) + http))
                for at in range(0, data.size, CHUNK):
                    out.write(pack.compress(data.slice(at, min(CHUNK, data.size - at))))
                out.write(pack.compress(END) + pack.flush())
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


class Stream:
    """Bytes of a (possibly gzipped, many-membered) archive, by mark or by number."""

    def __init__(self, source, size: int = 1 << 16):
        self.source, self.size, self.held, self.ended = source, size, b"", False
        self.unpack, self.raw = None, b""

    def _more(self) -> bool:
        raw = self.raw or self.source.read(self.size)
        self.raw = b""
        if not raw:
            self.ended = True
            return False
        if self.unpack is None:
            self.unpack = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else False
        if self.unpack is False:
            self.held += raw
            return True
        self.held += self.unpack.decompress(raw, CHUNK)
        # what the limit left over, or the start of the next member
        self.raw = self.unpack.unconsumed_tail or self.unpack.unused_data
        if self.unpack.eof:
            self.unpack = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of CHUNK bytes at most."""
        while n:
            while not self.held or len(self.held) < min(n, CHUNK):
                if not self._more():
                    raise ValueError("the archive ends within a record")
            piece, self.held = self.held[: min(n, CHUNK)], self.held[min(n, CHUNK) :]
            n -= len(piece)
            yield piece


def records(stream: Stream) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """(header, bytes of content, content) of each record; the content is read before the next record is asked for."""
    while (block := stream.until(END)) is not None:
        lines = block.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(fields.get("content-length", 0))
        content = stream.take(n)
        yield fields, n, content
        for _ in content:
            pass
        stream.until(END)


def _id(text: str | None) -> int | None:
    found = re.search(rf"{_URN}(-?\d+)", text or "")
    return int(found[1]) if found else None


def _claimed(told: str) -> str | None:
    """The SHA-1 that a header claims, in hex; null for other algorithms and for what is neither base 32 nor hex."""
    name, _, value = told.strip().partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[a-zA-Z2-7]{32}", value) else None


def chunks_of(source, with_data: bool) -> Iterator[tuple]:
    """Rows of the chunked record table for one archive."""
    stream = Stream(source)
    for fields, n, content in records(stream):
        kind, claimed = fields.get("warc-type", ""), _claimed(fields.get("warc-payload-digest", ""))
        common = (_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _id(fields.get("warc-refers-to")))
        if kind == "revisit":
            yield (*common, 0, 0, 0, True, int(fields.get("x-payload-length", 0)), claimed, True, None)
            continue
        digest, start, number, held, http = hashlib.sha1(), 0, 0, b"", kind == "response"
        pending: bytes | None = None
        for piece in content:
            if http:  # the payload starts after the HTTP head
                held += piece
                at = held.find(END)
                if at < 0 and len(held) < HEAD:
                    continue
                # a head that doesn't end is none
                piece, held, http = held[at + 4 :] if at >= 0 else held, b"", False
            if pending is not None and (pending or piece):
                digest.update(pending)
                yield (*common, number, start, len(pending), False, start + len(pending), digest.hexdigest(), None, pending if with_data else None)
                start, number = start + len(pending), number + 1
            pending = piece
        last = pending or b""
        digest.update(last)
        found = digest.hexdigest()
        yield (*common, number, start, len(last), True, start + len(last), found, claimed in (None, found), last if with_data else None)


def _reader(with_data: bool):
    names = [c.strip().split(" ")[0] for c in _CHUNKS.split(",")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for manifest in batches:
            for path in manifest.column("path").to_pylist():
                files, at = _open(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as source:
                    for row in chunks_of(source, with_data):
                        rows.append(row)
                        size += 256 + (row[6] if with_data else 0)
                        if size > 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write an archive a task into ``folder``; the manifest of archives (path, records)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    rows = rows.withColumns({"_sha": F.unhex(F.sha1(F.col("_payload").cast("binary"))), "_n": F.octet_length("_payload").cast("long")})
    keys = written(rows.filter(F.col("_n") >= least).select("_id", "_sha"), "payloads")
    bits = bloom.bits_for(keys.count())
    words = bloom.of_repeated(keys, "_sha", bits)
    maybe = bloom.flagged(keys, F.col("_sha"), words, bits, "_maybe").filter("_maybe")
    groups = written(maybe.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_c")).filter("_c > 1 AND _keep IS NOT NULL").withColumnRenamed("_sha", "_gsha"), "payload-groups")
    tested = bloom.flagged(rows, F.col("_sha"), words, bits, "_hit").withColumn("_hit", F.col("_hit") & (F.col("_n") >= least))
    alone = tested.filter("NOT _hit").select("_id", "_url", F.lit(None).cast("long").alias("_ref"), "_sha", "_n", "_payload")
    shared = tested.filter("_hit").join(groups, F.col("_sha") == F.col("_gsha"), "left")
    ref = F.when(~F.col("_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    shared = shared.select("_id", "_url", ref.alias("_ref"), "_sha", "_n", "_payload")
    return written(alone.unionByName(shared).mapInArrow(_writer(folder, date), _MANIFEST), "manifest")


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that a manifest names: a row for each record and chunk.

    ``payload_digest`` and ``payload_bytes`` cover the payload up to this chunk, on the last chunk all of it; ``sound`` is
    whether the whole digest is the one that the header names.
    """
    n = max(1, manifest.count())
    return manifest.repartition(n, "path").mapInArrow(_reader(with_data), _CHUNKS)


def archived(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write the pages, read the archives back: id, payload_bytes, payload_digest, record_type and refers_to of each record."""
    folder = scratch_path(pages.sparkSession, "warc")
    chunks = read(write(pages, folder, id_col), with_data=False)
    return chunks.filter("is_last").select(F.col("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")
