import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from timberline.llm import common, warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""),
    (5, "u", "one\r\n\r\ntwo\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "é" * 50_000), (2, "http://a/2", "<p>same</p>"), (None, "n", "<p>same</p>"),
    (7, "big", "x" * 3_000_000), (8, "u", "\r\n\r\n"), (9, "u", "tail\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.round_trip(pages(spark), payloads=True).collect()), key=str)
    top = {}
    for i, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        i, best = -1 if i is None else i, top[h or ""]
        want.append((i, len((h or "").encode()), digest(h), "response" if i == best else "revisit", None if i == best else best, (h or "").encode() if i == best else None))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    got = warc.round_trip(pages(spark), least=12).collect()
    assert {r.record_type for r in got} == {"response"}


def test_ids_of_any_type_and_marks_by_a_join(spark, monkeypatch):
    rows = [("a b", "u", "x" * 20), ("", "u", "x" * 20), (None, "u", "y"), ("é>", "u", "x" * 20), ("\0", "u", "x" * 20)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    raw = warc.write(df, common.new_path(spark, "t"), broadcast_bytes=0)
    got = warc.read(spark, warc.normalise(spark, raw, common.new_path(spark, "t")), id_type="string").collect()
    assert sorted(((r.page_id, r.refers_to) for r in got), key=str) == sorted([("é>", None), (None, None), *((i, "é>") for i in ("a b", "", "\0"))], key=str)


def test_a_record_that_the_index_misplaces_is_not_read(spark):
    done = warc.normalise(spark, warc.write(pages(spark).coalesce(1), common.new_path(spark, "t")), common.new_path(spark, "t"))
    (file,) = {r.archive for r in warc.read_index(spark, done).collect()}
    at = file.removeprefix("file:").replace("/kind=archive/", "/kind=index/")
    lines = gzip.decompress(open(at, "rb").read()).decode().splitlines()
    crc = at.rsplit("/", 1)
    os.remove(f"{crc[0]}/.{crc[1]}.crc")
    with open(at, "wb") as f:
        f.write(gzip.compress("\n".join([lines[0].replace('"offset": 0', '"offset": 7'), *lines[1:]]).encode()))
    assert warc.read(spark, done).count() == len(PAGES) - 1


def test_long_pages_make_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_FILE_BYTES", 4 << 20)
    raw = warc.write(pages(spark).coalesce(1), common.new_path(spark, "t"))
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(raw).count() == len(PAGES)


def test_index_reaches_each_record_alone(spark):
    raw = warc.write(pages(spark), common.new_path(spark, "t"))
    out = warc.normalise(spark, raw, common.new_path(spark, "t"))
    index = warc.read_index(spark, out)
    rows = index.collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    got = warc.fetch(spark, out, index.where("page_id = 5")).collect()
    assert [bytes(r.payload).decode() for r in got] == [PAGES[4][2]]
    whole = gzip.decompress(b"".join(open(a.removeprefix("file:"), "rb").read() for a in {r.archive for r in rows}))
    assert whole.count(b"WARC-Record-ID: ") == len(PAGES)


def test_monolithic_input_is_one_stream(spark):
    raw = warc.write(pages(spark).coalesce(1), common.new_path(spark, "t"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(raw).collect()
    assert sum(len(list(warc.records(bytes(f.content)))) for f in files) == len(PAGES)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).collect() == []
