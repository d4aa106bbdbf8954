"""WARC archives: a writer with revisit records, and a splittable reader.

The reader cuts archives into byte ranges.  A task looks for the gzip magic in its range,
takes a candidate for a record only if it decodes to a WARC header and the member's checksum holds,
and owns the records that start inside its range, reading past its end where needed.  A range is read
once, through a moving window; only the last record of a range reaches into the next.

Nothing is lost in silence: where no record follows a record at once (or none begins the archive), the owner of
the record before the gap reports it, and reading either fails or gives a row of type ``damaged``.

Archives go through ``pyarrow.fs`` to the shared folder, each under a temporary name that
is renamed when complete, so a task that is run again replaces its file.

Defined results: a null payload is empty; of equal payloads of ``least`` bytes or more the rows
with the smallest page_id are responses and the others revisits (a null id is never the smallest);
a null url writes no target; repeated rows are records each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices, table

_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SALTS = 32


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response) of every page.

    Only ids and digests meet by digest, with the side of repeated digests copied to 32 salts, so
    a payload that a third of all pages share is spread; payloads move by page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    ids = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    ids = ids.groupBy("page_id", "digest").count()
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("ids")).filter("ids > 1").drop("ids")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = ids.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int").alias("salt"))
    again = salted.join(first, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("id2"), F.col("digest").alias("digest2"), "refers_to")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record, uncompressed."""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = "\r\n".join([*head, "", ""]).encode() + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to), ("WARC-Profile", _PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(marked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes an archive for each partition of mark_revisits' rows; path, bytes and records of each.

    Every record is a gzip member of its own.  The result is a stored table: archives are written once.
    """
    def run(batches):
        fs, root = _store(folder)
        task = TaskContext.get()
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        part, n, size = f"{name}.{task.taskAttemptId()}.tmp", 0, 0
        with fs.open_output_stream(part, compression=None) as out:
            for batch in slices(batches, "payload"):
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = z.compress(record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, refers_to, date)) + z.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            fs.move(part, name)
        else:
            fs.delete_file(part)
        rows = [name] * bool(n), [size] * bool(n), [n] * bool(n)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    rows = marked.select("page_id", "url", "payload", "digest", "refers_to")
    return table(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        k, _, v = line.partition(b": ")
        out[k.decode("latin-1").lower()] = v.decode("utf-8", "surrogatepass")
    return out


class _Window:
    """A file's bytes from a moving position on.

    What lies ahead is read once: in steps up to ``end``, beyond it in pieces that begin small and double.
    """

    def __init__(self, file, at: int, end: int, size: int, step: int):
        self.file, self.low, self.end, self.size, self.step, self.beyond = file, at, end, size, step, 1 << 14
        self.data = bytearray()
        file.seek(at)

    def _more(self) -> bool:
        at = self.low + len(self.data)
        n = min(self.step, self.end - at) if at < self.end else self.beyond
        if at >= self.end:
            self.beyond = min(2 * self.beyond, self.step)
        part = self.file.read(min(n, self.size - at)) if at < self.size else b""
        self.data += part
        return bool(part)

    def drop(self, at: int) -> None:
        """Forgets what lies before at."""
        while at > self.low + len(self.data):
            self.low += len(self.data)
            self.data.clear()
            if not self._more():
                return
        del self.data[: at - self.low]
        self.low = at

    def find(self, what: bytes, at: int, end: int) -> int:
        """Where ``what`` begins in [at, end), -1 where it does not."""
        while at < end:
            self.drop(at)
            while len(self.data) < len(what) and self._more():
                pass
            hit = self.data.find(what)
            if hit >= 0:
                return at + hit if at + hit < end else -1
            if len(self.data) < len(what):
                return -1
            at += len(self.data) - len(what) + 1
        return -1

    def part(self, at: int, most: int) -> bytes:
        """Bytes from at on, none at the end of the file."""
        while at >= self.low + len(self.data):
            if not self._more():
                return b""
        return bytes(self.data[at - self.low : at - self.low + most])


def members(file, start: int, end: int, size: int, step: int = 1 << 20):
    """(offset, bytes in the file, decoded bytes) of the records that start in [start, end).

    A gap is (offset, bytes, None): it begins the file or stands behind a record of this range, and reaches to
    the next record, in this range or beyond.  So the record behind a range's last one is decoded too.
    """
    window = _Window(file, start, end, size, step)
    at, open_from = start, 0 if start == 0 else None
    while at < (end if open_from is None else size):
        hit = window.find(_MAGIC, at, end if open_from is None else size)
        if hit < 0:
            break
        got = _member(window, hit)
        if got is None:
            at = hit + 1
            continue
        if open_from is not None and hit > open_from:
            yield open_from, hit - open_from, None
        if hit >= end:
            return
        data, used = got
        yield hit, used, data
        at = open_from = hit + used
    if open_from is not None and open_from < size:
        yield open_from, size - open_from, None


def _member(window: _Window, at: int, piece: int = 1 << 14):
    """A whole record and its compressed length, or None where no record starts."""
    z, out, n, pos = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            part = window.part(pos, piece)
            if not part:
                return None
            pos += len(part)
            out.append(z.decompress(part))
            begun, n = n >= 5, n + len(out[-1])
            if not begun and n >= 5 and not b"".join(out).startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return (b"".join(out), pos - len(z.unused_data) - at) if n >= 5 else None


_OUT = [
    ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
]
_OUT_DDL = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long, length long"


def read_archives(archives: DataFrame, folder: str, split_bytes: int = 32 << 20, with_payload: bool = True, damage: str = "fail") -> DataFrame:
    """The records of archives (path, bytes), read in ranges of split_bytes.

    page_id, target_uri, record_type, refers_to, payload_bytes and payload_digest (of the full
    payload; a response's digest is computed from the bytes read), payload (null for revisits, and without
    with_payload), path, offset and length in the file.  Bytes that are in no record, and records whose payload has not its
    digest, end the job; with damage="report" they give a row of type ``damaged`` and the other records stay.
    """
    if damage not in ("fail", "report"):
        raise ValueError("damage is 'fail' or 'report'")
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = archives.filter("bytes > 0").select("path", "bytes", begin)
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"), "bytes").repartition(max(1, min(int(tasks), 100_000)))

    def run(batches):
        fs, _ = _store(folder)
        for batch in batches:
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for offset, length, data in members(file, start, stop, size):
                        row = parse(data, with_payload) if data is not None else None
                        if row is None and damage == "fail":
                            raise ValueError(f"{path} is damaged at byte {offset}, for {length} bytes")
                        rows.append((*(row or (None, None, "damaged", None, None, None, None)), path, offset, length))
                        held += len(data or b"")
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(_OUT)], names=[k for k, _ in _OUT])

    return ranges.mapInArrow(run, _OUT_DDL)


def parse(data: bytes, with_payload: bool = True):
    """page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, payload of a record; None if its payload is damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    said = warc["warc-payload-digest"].removeprefix("sha256:")
    number = lambda k: int(warc[k]) if k in warc else None
    if warc["warc-type"] == "response":
        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != said:
            return None
    else:
        digest, n, payload = said, int(_fields(http)["content-length"]), None
    return number("x-page-id"), warc.get("warc-target-uri"), warc["warc-type"], number("x-refers-to-page-id"), n, digest, payload if with_payload else None
