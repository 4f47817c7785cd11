"""Archives: round trip, revisits, seeking, and a decoder that knows nothing of the seek table."""

import hashlib
import io
from collections import defaultdict

import pyarrow.parquet as pq
import zstandard

from faultline.llm import warc
from faultline.llm.common import shared_folder

BIG = "<p>" + "é" * 800 + "</p>"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4\r\nX-Evil: 1", "small"), (5, "u5", "small"), (6, "u6", None), (7, "u7", ""), (8, "u8", "x" * 1000), (9, "u9", "x" * 1000), (10, "u10", "x" * 999),
        (11, "u11", "x" * 999), (None, "null", BIG), (None, "alone", "y" * 2000), (12, "long", "z\r\n\r\nWARC/1.1\r\n" * 50_000), (13, "twice", "t" * 1500), (13, "twice", "t" * 1500)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, digest string, n int")


def stored(spark, pages, **sizes):
    folder = shared_folder(spark, "warc-test")
    index = warc.write_bundles(warc.records(pages), folder, **sizes)
    return folder, index


def test_round_trip(spark):
    folder, index = stored(spark, table(spark), frame_bytes=2_000, bundle_bytes=3_000)
    got = warc.read_bundles(index, folder, with_payload=True).collect()
    groups = defaultdict(list)
    for i, _, html in ROWS:
        groups[html or ""].append(i)
    want = []
    for html, ids in groups.items():
        raw, keep = html.encode(), max((i for i in ids if i is not None), default=None)
        for i in dict.fromkeys(ids):
            for copy in range(ids.count(i)):
                revisit = len(raw) >= 1000 and (i != keep or copy > 0)
                want.append((None if i is None else str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(keep) if revisit else None, None if revisit else raw))
    assert sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)
    assert index.count() == len(ROWS) and index.select("bundle", "frame").distinct().count() > 2
    assert [r["url"] for r in got if r["record_id"] == "4"] == ["http://a/4%0D%0AX-Evil:%201"]


def test_records_are_found_by_their_frame(spark):
    folder, index = stored(spark, table(spark), frame_bytes=3_000)
    found = warc.fetch_records(index.where("record_id IN ('4', '8', '12')"), folder).collect()
    assert sorted((r["record_id"], r["record_type"], r["payload_bytes"]) for r in found) == [("12", "response", 750_000), ("4", "response", 5), ("8", "revisit", 1000)]


def test_bundles_are_plain_zstandard(spark):
    folder, index = stored(spark, table(spark))
    seen = 0
    for row in spark.read.format("binaryFile").load(folder).collect():
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(row["content"])), read_across_frames=True).read()
        seen += sum(1 for _ in warc.parse_records(data))
    assert seen == len(ROWS)
    empty, index = stored(spark, table(spark).where("false"))
    assert warc.read_bundles(index, empty).collect() == [] and index.collect() == []


def test_bundles_of_other_attempts_are_not_read(spark):
    folder, index = stored(spark, table(spark))
    files, path = warc.fs.FileSystem.from_uri(folder)
    for r in index.select("bundle").distinct().collect():
        files.copy_file(f"{path}/{r['bundle']}", f"{path}/bundle-000000-00009-00aa.warc.zst")
    assert warc.read_bundles(index, folder).count() == len(ROWS)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder, index = stored(spark, pages)
    got = {r["record_id"]: r["payload"] for r in warc.read_bundles(index, folder, with_payload=True).collect()}
    for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        if got[str(r["page_id"])] is not None:
            assert bytes(got[str(r["page_id"])]).decode() == r["html"]
