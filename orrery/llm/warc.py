"""WARC archives: a writer, and a reader that splits files anywhere.

Writer: every task writes its rows as one archive, a gzip member for each
record, under a name of its own partition, so that a repeated task replaces
its file; a file appears whole, by rename. Records whose payload another
response holds are revisits without a payload. Payloads stay where they are:
the digests that come again are broadcast, if few; of more, the hot ones are.

Reader: files are cut into byte ranges. A task scans its range for the gzip
magic, validates a candidate by decoding its start to a WARC header, and owns
the records that start inside the range; it reads beyond the end to finish
the last one. After one valid member the next begins where it ends.

Archives lie in a folder that all tasks share, named by a URI that Arrow's
file systems read (file, hdfs, s3, ...).

Defined results: a null html is an empty payload; a null url is an empty
target; a null page_id is written as an empty id, is never a response that
others refer to unless all of its group are null, and reads back as null; of
equal rows with the smallest page_id, each is a response; empty tables give
archives without records and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.session import HEAVY, checkpoint_folder, hot_keys, join_spread, prepare

#: Payloads under this size are always responses.
LEAST_REVISIT = 100
#: Digests that a broadcast may hold.
BROADCAST_DIGESTS = 200_000
#: Bytes that one reading task takes charge of; bytes read at a time.
SPLIT, BUFFER = 8 << 20, 1 << 18
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PLACE = "application/http; msgtype=response"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _opened(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", _PLACE),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = HTTP + (payload if refers_to is None else b"")
    return _header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    fs, root = _opened(folder)
    name = f"part-{context.partitionId():06d}.warc.gz"
    draft = f"{root}/_{name}.{context.taskAttemptId()}"
    with fs.open_output_stream(draft) as out:
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                out.write(_member(record(page, url, (html or "").encode(), digest, refers)))
    size = fs.get_file_info(draft).size
    fs.move(draft, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["file", "size"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, html) in folder; file, size of each."""
    from urllib.parse import urlparse

    prepare(pages.sparkSession)
    fs, root = _opened(folder)
    fs.create_dir(root, recursive=True)
    assert urlparse(folder).scheme or os.path.isabs(folder), "the folder must be absolute"
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    # (digest, page that has the response) of payloads that come again
    groups = own.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).checkpoint()
    again = groups.where("n > 1")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).cast("long").alias("refers_to")
    columns = ("page_id", "url", "html", "digest")
    if again.count() <= BROADCAST_DIGESTS:
        found = own.join(F.broadcast(again.select("digest", "first")), "digest", "left")
        ready = found.select(*columns, F.when(long, refers).alias("refers_to"))
    else:
        # hot payloads are not shuffled, nor are short ones
        counts = groups.agg(F.sum("n")).first()[0]
        hot = hot_keys(again, "digest", BROADCAST_DIGESTS // HEAVY, counts)
        placed = join_spread(own.where(long), groups.select("digest", "first"), "digest", hot)
        ready = placed.select(*columns, refers).unionByName(own.where(~long).select(*columns, F.lit(None).cast("long").alias("refers_to")))
    return ready.mapInArrow(partial(_write, folder=folder), "file string, size long").checkpoint()


def _starts(read, start: int, end: int) -> Iterator[int]:
    """Offsets in [start, end) where the gzip magic stands."""
    at, tail = start, b""
    while at < end:
        data = tail + read(at, min(BUFFER, end + len(MAGIC) - 1 - at))
        base, i = at - len(tail), data.find(MAGIC)
        if len(data) == len(tail):
            return
        while i >= 0:
            if base + i < end:
                yield base + i
            i = data.find(MAGIC, i + 1)
        at, tail = base + len(data), data[-(len(MAGIC) - 1) :]


def _inflate(read, at: int, size: int) -> tuple[bytes, int] | None:
    """(content, offset after it) of the member at an offset; None if there is
    no whole, valid member whose content starts as a WARC record does."""
    unpack, parts, here = zlib.decompressobj(31), [], at
    seen = b""
    while not unpack.eof:
        data = read(here, min(1 << 14 if not parts else BUFFER, size - here))
        if not data:
            return None
        here += len(data)
        try:
            parts.append(unpack.decompress(data))
        except zlib.error:
            return None
        if len(seen) < 8:
            seen += parts[-1][: 8 - len(seen)]
            if not b"WARC/1.1".startswith(seen[:8]):
                return None
    return b"".join(parts), here - len(unpack.unused_data)


def members(read, start: int, end: int, size: int) -> Iterator[bytes]:
    """The records that start in [start, end) of a file of this size."""
    scan = _starts(read, start, end)
    at = next(scan, None)
    while at is not None and at < end:
        found = _inflate(read, at, size)
        if found is None:
            at = next((x for x in scan if x > at), None)
            continue
        yield found[0]
        scan = _starts(read, found[1], end)
        at = next(scan, None)


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload bytes, digest, type, refers_to) of a record; the
    digest and size of a response are those of the payload that was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda x: int(x) if x else None
    page = number(fields["WARC-Record-ID"][len("<urn:page:") : -1])
    if fields["WARC-Type"] == "revisit":
        refers = number(fields["WARC-Refers-To"][len("<urn:page:") : -1])
        return page, fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].partition(":")[2], "revisit", refers
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    return page, fields["WARC-Target-URI"], len(payload), digest, "response", None


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    fs, root = _opened(folder)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for batch in batches:
        for name, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end", "size")), strict=True):
            rows, held = [], 0
            with fs.open_input_file(f"{root}/{name}") as f:

                def read(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)

                def out(rows):
                    cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + with_payload)
                    arrays = [pa.array(c, k) for c, k in zip(cols, (*kinds, *[pa.binary()] * with_payload), strict=True)]
                    return pa.RecordBatch.from_arrays(arrays, names=[*names, *["payload"] * with_payload])

                for raw in members(read, start, end, size):
                    row = parse(raw)
                    if with_payload:
                        body = raw.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2]
                        row = (*row, body[: row[2]] if row[4] == "response" else None)
                    rows.append(row)
                    held += len(raw) if with_payload else 200
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                yield out(rows)


def read_archives(spark: SparkSession, files: DataFrame, folder: str, split: int = SPLIT, with_payload: bool = False) -> DataFrame:
    """The records of archives (file, size) in folder, in splits of this size."""
    ranges = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split, F.col("size")).alias("end"), "size")
    n = max(1, ranges.count())
    dealt = ranges.repartition(min(n, 100_000), "file", "start")
    return dealt.mapInArrow(partial(_read, folder=folder, with_payload=with_payload), SCHEMA + (", payload binary" if with_payload else ""))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one that the session names."""
    prepare(spark)
    base = checkpoint_folder(spark)
    base = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    return f"{base.rstrip('/')}/warc-{uuid.uuid4().hex}"


def remove_folder(folder: str) -> None:
    """Delete archives that are no longer needed."""
    fs, root = _opened(folder)
    fs.delete_dir(root)
