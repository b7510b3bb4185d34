"""WARC archives: writing, normalising monolithic gzip files, and reading.

`write` deals pages to archive files, a record each, as one gzip stream per file. `normalise` inflates such a file once, from start to end, and
rewrites every record as a gzip member of its own, with a sidecar index of offsets; so a record can then be read without the ones before it.
`read` walks normalised archives and keeps the records that the index has at their very offsets, `fetch` reads single records by the index. Files are
written by Spark's text writer, whose line separator is what must stand between records: the blank lines after a record, or an empty gzip
member after a member, which readers skip. So any file system that Spark writes to will do, and a task that is run again leaves no half file.

Of the records with equal payloads of `least` bytes or more, the one with the largest page_id is a response, and the others are revisits that
refer to it and carry no payload. Smaller payloads are all responses. Which rows are revisits is found over narrow rows (id, digest, size). These
marks meet the pages where they lie, if their counted size allows a broadcast, and else in a join.

Defined results: page ids may be of any type that casts to a string and back; a null html is an empty payload; rows with the largest page_id are all
responses where that id repeats; a null page_id is smaller than any; CR and LF in a URL are percent-encoded, a null URL is empty; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, begin, bounded, materialize, new_path, remove, salted_left_join, slices

# Formats of the archive.
RECORD_END, EMPTY_MEMBER = b"\r\n\r\n", gzip.compress(b"", mtime=0)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file's records as they are on average, and at most; a file is read whole by one task. Index lines of a member; bytes of a batch.
FILE_BYTES, MOST_FILE_BYTES, INDEX_LINES, CHUNK, BATCH_BYTES = 32 << 20, 1 << 30, 1000, 1 << 16, 1 << 20
#: Bytes that a head adds to a record; bytes of a mark in a broadcast.
HEAD_BYTES, MARK_BYTES = 1024, 128


def payload_digest(payload: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(payload).digest())


def urn(page_id: str | None) -> bytes:
    return b"<urn:page>" if page_id is None else b"<urn:page:" + quote(page_id, safe="-").encode() + b">"


def id_of(name: bytes | None) -> str | None:
    found = re.fullmatch(rb"<urn:page:(.*)>", name or b"")
    return unquote(found[1].decode()) if found else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A record without the blank lines that end it."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + urn(page_id), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha1:" + payload_digest(payload), b"WARC-Payload-Length: %d" % len(payload)]
    block = HTTP_HEAD % len(payload)
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Refers-To: " + urn(refers_to), b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def parse_head(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}


def records(content) -> Iterator[bytes]:
    """The records of a gzip file of one or more members, inflated once in chunks."""
    held, at = bytearray(), 0
    inflater, view, pos = zlib.decompressobj(31), memoryview(content), 0
    while pos < len(view) or held[at:]:
        end = held.find(b"\r\n\r\n", at)
        need = None
        if end >= 0:
            length = int(parse_head(bytes(held[at:end]))[b"content-length"])
            need = end + 4 + length
            if len(held) >= need + len(RECORD_END):
                yield bytes(held[at:need])
                at = need + len(RECORD_END)
                if at > 1 << 20:
                    del held[:at]
                    at = 0
                continue
        if pos >= len(view):
            raise ValueError("the archive ends within a record")
        fresh = 0
        # A long record isn't searched again until all of it is there.
        while pos < len(view) and fresh < max(CHUNK, (need or 0) + len(RECORD_END) - len(held)):
            chunk = view[pos : pos + CHUNK]
            out = inflater.decompress(chunk)
            pos += len(chunk) - len(inflater.unused_data)
            if inflater.eof:
                inflater = zlib.decompressobj(31)
            held += out
            fresh += len(out)


def members(content) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each member of a normalised archive; empty members are skipped."""
    view, pos = memoryview(content), 0
    while pos < len(view):
        inflater, parts, at = zlib.decompressobj(31), [], pos
        while not inflater.eof:
            if pos >= len(view):
                raise ValueError("the archive ends within a member")
            chunk = view[pos : pos + CHUNK]
            parts.append(inflater.decompress(chunk))
            pos += len(chunk) - len(inflater.unused_data)
        if whole := b"".join(parts):
            yield at, pos - at, whole[: -len(RECORD_END)]


def deflate(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def narrow_rows(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) of each page, written once: what decides about revisits and the size of files."""
    body = F.coalesce("html", F.lit(""))
    return materialize(pages.select("page_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("bytes")), "pages")


def revisits(narrow: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat a payload; a payload's rows are salted."""
    narrow = narrow.where(F.col("bytes") >= least).select("page_id", "digest")
    again = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    held = salted_left_join(narrow, again, "digest", F.col("page_id"))
    return held.where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", broadcast_bytes: int = BROADCAST_BYTES) -> str:
    """Write monolithic archives (one gzip stream a file) to a new folder."""
    bounded(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    narrow = narrow_rows(pages)
    size = narrow.agg(F.avg("bytes").alias("mean"), F.max("bytes").alias("most")).first()
    per_file = max(1, min(FILE_BYTES // (int(size.mean or 0) + HEAD_BYTES), MOST_FILE_BYTES // ((size.most or 0) + HEAD_BYTES)))
    marks = materialize(revisits(narrow, least), "marks", narrow=True)
    seen = marks.withColumnsRenamed({"page_id": "__id", "digest": "__digest"})
    seen = F.broadcast(seen) if marks.count() * MARK_BYTES <= broadcast_bytes else seen.hint("shuffle_hash")
    joined = pages.withColumn("digest", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))).join(seen, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    joined = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("warc")
        for whole in batches:
            for batch in slices(whole, "html", BATCH_BYTES):
                ids, urls, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
                bodies = batch.column("html").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([record(i, u, b or b"", r, date) for i, u, b, r in zip(ids, urls, bodies, refers)], pa.binary())], names=["value"])

    made = joined.mapInArrow(kernel, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", RECORD_END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)
    return path


def normalise(spark: SparkSession, source: str, path: str) -> str:
    """Rewrite each record as its own gzip member: archives under kind=archive, and beside each its index, of the same file name, under kind=index."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("warc")
        offset, lines, seq = 0, [], 0
        held, weight = [], 0

        def rows(kind: str, value: list[bytes]) -> pa.RecordBatch:
            nonlocal seq
            seq += len(value)
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(value)), pa.array(range(seq - len(value), seq), pa.int64()), pa.array(value, pa.binary())], names=["kind", "seq", "value"])

        for batch in batches:
            for content in batch.column("content"):
                for whole in records(content.as_buffer()):
                    member = deflate(whole + RECORD_END)
                    head = parse_head(whole[: whole.index(b"\r\n\r\n")])
                    lines.append(json.dumps({"page_id": id_of(head[b"warc-record-id"]), "type": head[b"warc-type"].decode(), "digest": head[b"warc-payload-digest"].decode(), "offset": offset, "length": len(member)}))
                    offset += len(member) + len(EMPTY_MEMBER)
                    held.append(member)
                    weight += len(member)
                    if weight >= BATCH_BYTES:
                        yield rows("archive", held)
                        held, weight = [], 0
                    if len(lines) == INDEX_LINES:
                        yield rows("index", [deflate("\n".join([*lines, ""]).encode())])
                        lines = []
        if held:
            yield rows("archive", held)
        if lines:
            yield rows("index", [deflate("\n".join([*lines, ""]).encode())])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source).select("content")
    made = files.mapInArrow(kernel, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    made.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return path


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None  # no record was written
    return spark.read.format("binaryFile").load(f"{path}/kind={kind}").select("path", "content")


_INDEX = pa.schema([("archive", pa.string()), ("page_id", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, page_id as string, type, digest, offset, length) of every record."""
    schema = "archive string, page_id string, type string, digest string, offset long, length long"
    files = _files(spark, path, "index")
    if files is None:
        return spark.createDataFrame([], schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("warc")
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = [json.loads(x) | {"archive": name.replace("/kind=index/", "/kind=archive/")} for x in gzip.decompress(content.as_py()).splitlines()]
                for at in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_pylist(found[at : at + 4096], _INDEX)

    return files.mapInArrow(kernel, schema)


_READ = "archive string, offset long, length long, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _parsed(archive: str, found: list[tuple[int, int, bytes]], payloads: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(10)]
    for offset, length, whole in found:
        head, _, block = whole.partition(b"\r\n\r\n")
        fields = parse_head(head)
        revisit = fields[b"warc-type"] == b"revisit"
        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
        size = int(fields[b"warc-payload-length"]) if revisit else len(payload)
        digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:") if revisit else payload_digest(payload)
        for c, x in zip(cols, (archive, offset, length, id_of(fields[b"warc-record-id"]), fields[b"warc-target-uri"].decode("utf-8", "replace"), fields[b"warc-type"].decode(), id_of(fields.get(b"warc-refers-to")), size, digest.decode(), payload if payloads else None)):
            c.append(x)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["archive", "offset", "length", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def _batched(archive: str, found: Iterator[tuple[int, int, bytes]], payloads: bool) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for x in found:
        held.append(x)
        weight += len(x[2])
        if weight >= BATCH_BYTES:
            yield _parsed(archive, held, payloads)
            held, weight = [], 0
    if held:
        yield _parsed(archive, held, payloads)


def _typed(rows: DataFrame, id_type: str) -> DataFrame:
    return rows.select(F.col("page_id").cast(id_type).alias("page_id"), "url", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "payload_bytes", "payload_digest", "payload")


def read(spark: SparkSession, path: str, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """All records of normalised archives that the index has at the offset and of the length where they were found. Types and ids are the index's, a
    response's digest is computed from the payload that was read."""
    files = _files(spark, path, "archive")
    if files is None:
        return _typed(spark.createDataFrame([], _READ), id_type)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("warc")
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from _batched(name, members(content.as_buffer()), payloads)

    walked, index = files.mapInArrow(kernel, _READ), read_index(spark, path).select("archive", "offset", "length", F.col("page_id").alias("__id"), F.col("type").alias("__type"))
    both = walked.join(index, ["archive", "offset", "length"])
    return _typed(both.withColumn("page_id", F.col("__id")).withColumn("record_type", F.col("__type")), id_type)


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_type: str = "long") -> DataFrame:
    """Records of some rows of the index (archive, offset, length), each inflated alone; of archives without a wanted record nothing is read."""
    files = _files(spark, path, "archive")
    if files is None:
        return _typed(spark.createDataFrame([], _READ), id_type)
    places = wanted.groupBy(F.col("archive").alias("path")).agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("warc")
        for batch in batches:
            for name, content, own in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("places").to_pylist()):
                view = memoryview(content.as_buffer())
                alone = ((p["offset"], p["length"], gzip.decompress(view[p["offset"] : p["offset"] + p["length"]])[: -len(RECORD_END)]) for p in own)
                yield from _batched(name, alone, True)

    return _typed(files.join(places, "path").select("path", "content", "places").mapInArrow(kernel, _READ), id_type)


def round_trip(pages: DataFrame, least: int = 0, payloads: bool = False) -> DataFrame:
    """Write archives, normalise them, and read them back. The monolithic files go once they were normalised."""
    spark = pages.sparkSession
    raw = write(pages, new_path(spark, "warc-raw"), least)
    done = normalise(spark, raw, new_path(spark, "warc"))
    remove(spark, raw)
    return read(spark, done, payloads, pages.schema["page_id"].dataType.simpleString())
