"""WARC files (version 1.1) of pages, with an index by record that reading goes by.

A task writes its records to files of bounded size, each record a gzip member of its own, and gives an index row for
each: file, offset, length, url, digest.  Of equal payloads one record holds the content and the others are revisits
that refer to it.  Reading starts at the index: the chosen rows are sorted by place, neighbouring ranges are read at
once, and each record's digest is held against its content.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_path, dropped, new_path, open_stream, written

#: Payloads of fewer bytes are written again rather than referred to.
LEAST_SHARED = 1000
#: A file is closed when it holds this many bytes.
FILE_BYTES = 1 << 30
#: A read spans at most this many bytes, or one record; and ranges with at most so many bytes between are read at once.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Chosen records of a file are dealt to tasks by stretches of this many bytes.
STRETCH_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string"


def record_id(page_id: int | None, digest: bytes) -> str:
    """The same for the same page and content, so that a revisit can name a record that another task writes."""
    bits = int.from_bytes(hashlib.sha256(f"{page_id} ".encode() + digest).digest()[:16])
    bits = bits & ~(0xF << 76 | 0x3 << 62) | 0x8 << 76 | 0x2 << 62  # version 8, of one's own making
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def _new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def record(kind: str, identity: str, date: str, headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A gzip member that holds one record."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _header_url(url: str) -> str:
    """Controls, spaces and all beyond ASCII as percent codes, so that no url can add a line."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[str, str | None] | None, identity: str, date: str, level: int = 6) -> tuple[bytes, str]:
    """The record of one page and its digest (sha1, base32): a response, or a revisit of refers_to (id, url) without the content."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Target-URI", _header_url(url))] if url is not None else []
    headers += [("WARC-Payload-Digest", digest), ("Content-Type", HTTP_TYPE)]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        return record("response", identity, date, headers, http + payload, level), digest
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to[0])]
    if refers_to[1] is not None:
        headers.append(("WARC-Refers-To-Target-URI", _header_url(refers_to[1])))
    return record("revisit", identity, date, headers, http, level), digest


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if line)}


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (names in lower case), HTTP headers and content of a gzip member; raises on a damaged one."""
    unpacker = zlib.decompressobj(31)
    raw = unpacker.decompress(member)
    if not unpacker.eof or unpacker.unused_data:
        raise ValueError("the index doesn't point to one whole record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, headers = _fields(head)
    length = int(headers["content-length"])
    if not version.startswith("WARC/1.") or len(rest) != length + 4:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return headers, _fields(http)[1], payload


def _responses(pages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows to write: page_id, url, payload, sha (of the payload), copies (rows alike in all of these) and whose record
    they refer to: keep_id, keep_url, null where they hold the content themselves; own where they may be referred to."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    sha = F.unhex(F.sha2("payload", 256)).alias("sha")
    shared = rows.filter(F.length("payload") >= LEAST_SHARED).groupBy(sha, "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    # Null ids and urls come before all others, as in any sort.
    groups = shared.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.sum("n").alias("n"), F.max("n").alias("most"))
    groups = written(groups.filter("n > 1").select(F.col("sha").alias("of"), "keep", (F.col("most") > 1).alias("repeated")), "warc-shared")
    all_rows = rows.select("page_id", "url", "payload", sha).join(groups, F.col("sha") == F.col("of"), "left")
    own = F.col("of").isNull() | (F.col("page_id").eqNullSafe(F.col("keep.page_id")) & F.col("url").eqNullSafe(F.col("keep.url")))
    columns = ["page_id", "url", "payload", "sha", F.col("of").isNotNull().alias("shared"), own.alias("own"), F.col("keep.page_id").alias("keep_id"), F.col("keep.url").alias("keep_url")]
    repeated = F.coalesce("repeated", F.lit(False))
    once = all_rows.filter(~repeated).select(*columns, F.lit(1).cast("long").alias("copies"))
    # Where a row is repeated as a whole, one of its copies may hold the content: they are written together.
    several = all_rows.filter(repeated).select(*columns).groupBy("sha", "page_id", "url")
    several = several.agg(*[F.first(c).alias(c) for c in ("payload", "shared", "own", "keep_id", "keep_url")], F.count(F.lit(1)).alias("copies"))
    return once.unionByName(several), [groups]


def write_archives(pages: DataFrame, path: str, date: str | None = None, level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to WARC files under `path` and returns the written index: file, offset,
    length, url, digest (sha1, lower-case hex), record_type, record_id; files also begin with a warcinfo record.

    Of records with equal payloads of at least LEAST_SHARED bytes, that of the largest page_id (then url; nulls are
    smallest) is the response and the others revisit it, also where rows are repeated; smaller ones are responses all.
    Null html is the empty payload; a null url or page_id has no header.  Other columns are ignored; an empty table
    writes no file.  A task that is run again writes files of its own; only those of its last run are in the index.
    """
    bounded_batches(pages)
    rows, left = _responses(pages)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = open_stream(path)
        system.create_dir(folder, recursive=True)
        stream, number, at, index = None, 0, 0, []
        for batch in batches:
            for page_id, url, payload, sha, shared, own, keep_id, keep_url, copies in zip(*[batch[c] for c in names], strict=True):
                page_id, url, payload, sha = page_id.as_py(), url.as_py(), payload.as_py(), sha.as_py()
                target = (record_id(keep_id.as_py(), sha), keep_url.as_py()) if shared.as_py() else None
                for copy in range(copies.as_py()):
                    if stream is None:
                        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}.warc.gz"
                        stream = system.open_output_stream(f"{folder}/{name}", compression=None)
                        info = record("warcinfo", _new_id(), date, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                        stream.write(info)
                        at, number = len(info), number + 1
                    holds = target is None or (own.as_py() and copy == 0)
                    identity = target[0] if target and holds else _new_id()
                    data, digest = page_record(page_id, url, payload, None if holds else target, identity, date, level)
                    stream.write(data)
                    index.append((name, at, len(data), url, base64.b32decode(digest[5:]).hex(), "response" if holds else "revisit", identity))
                    at += len(data)
                    if at >= file_bytes:
                        stream.close()
                        stream = None
            yield _index_batch(index)
            index = []
        if stream is not None:
            stream.close()

    names = ["page_id", "url", "payload", "sha", "shared", "own", "keep_id", "keep_url", "copies"]
    index = written(rows.select(*names).mapInArrow(write, INDEX), "warc-index")
    for x in left:
        dropped(x)
    return index


def _index_batch(index):
    columns = list(zip(*index, strict=True)) or [[]] * 7
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def ranges(places: Iterator[tuple[str, int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, stop, [(offset, length)]): places sorted by file and offset, made one read while they lie close."""
    file, start, stop, members = None, 0, 0, []
    for name, offset, length in places:
        if name != file or offset - stop > gap or offset + length - start > most:
            if members:
                yield file, start, stop, members
            file, start, stop, members = name, offset, offset, []
        members.append((offset, length))
        stop = max(stop, offset + length)
    if members:
        yield file, start, stop, members


RECORDS = "record_id string, record_type string, url string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


def read_records(spark: SparkSession, path: str, chosen: DataFrame, with_payload: bool = False) -> DataFrame:
    """The chosen rows of an index, read from the archives under `path`: record_id, record_type, url, page_id,
    payload_bytes and payload_digest (lower-case hex) of the full payload, refers_to_id; and payload if asked for (null
    for revisits).  Raises where a record is damaged or isn't what its digest says.  Chosen twice, a record is read twice.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = chosen.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")

    def read(batches):
        system, folder = open_stream(path)
        place = ((f, o, n) for b in batches for f, o, n in zip(*[b[c].to_pylist() for c in ("file", "offset", "length")], strict=True))
        stream, name, out, held = None, None, [], 0
        for file, start, stop, members in ranges(place):
            if file != name:
                if stream is not None:
                    stream.close()
                stream, name = system.open_input_file(f"{folder}/{file}"), file
            data = memoryview(stream.read_at(stop - start, start))
            for offset, length in members:
                out.append(_described(data[offset - start : offset - start + length], with_payload))
                held += len(out[-1][-1] or b"") if with_payload else 0
                if len(out) >= 5000 or held >= READ_BYTES:
                    yield _records_batch(out, with_payload)
                    out, held = [], 0
        if stream is not None:
            stream.close()
        if out:
            yield _records_batch(out, with_payload)

    return places.mapInArrow(read, RECORDS + (", payload binary" if with_payload else ""))


def _described(member, with_payload: bool) -> tuple:
    headers, http, payload = parse_record(member)
    kind, size = headers["warc-type"], int(http["content-length"])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"record {headers['warc-record-id']} is damaged: its content has another digest or length")
    page_id = headers.get("x-page-id")
    row = (headers["warc-record-id"], kind, headers.get("warc-target-uri"), None if page_id is None else int(page_id), size, digest.hex(), headers.get("warc-refers-to"))
    return (*row, payload if kind == "response" else None) if with_payload else row


def _records_batch(out, with_payload: bool):
    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()] * with_payload
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def with_targets(records: DataFrame) -> DataFrame:
    """records with refers_to: the page_id of the response that a revisit names, found among the records read."""
    revisits = records.filter("refers_to_id is not null")
    targets = records.filter("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"))
    named = revisits.join(targets, F.col("refers_to_id") == F.col("target_id"), "left").drop("target_id")
    return named.unionByName(records.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long")))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, reads all of them back by the index and drops the archives.

    Returns, from what was read: page_id, payload_bytes, payload_digest, record_type, refers_to; see write_archives().
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    index = write_archives(pages, path)
    records = written(read_records(spark, path, index), "warc-records")
    out = with_targets(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    out = written(out, "warc-answer")
    for x in (index, records):
        dropped(x)
    drop_path(spark, path)
    return out
