"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a skippable frame that holds the seek table (sizes of all
frames), as in the public seekable format, so any decoder reads a bundle from front to end, and a record is read by one frame alone.  An index
maps record identifiers to bundle, frame and offset in the frame.  Payloads met more than once are written once, as the response of the largest
identifier; the other records refer to it.

A task writes whole bundles under names of its own, first beside them under another name: a task that runs again writes the same again.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.marks import bitmap_of, marked

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
REVISIT_BYTES = 1000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, record_type string, bundle string, frame int, frame_at bigint, frame_bytes bigint, offset bigint, length bigint"
RECORD = "record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One row per record: ``id, url, body`` (null for a revisit), ``n`` (payload bytes), ``digest``, ``refers_to`` (null for a response).

    Only bodies whose digest occurs more than once are shuffled, and of each only one per task.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    base = base.withColumns({"n": F.octet_length("body").cast("bigint"), "digest": F.sha1("body")})
    large = base.where(F.col("n") >= revisit_bytes)
    often = large.groupBy("digest").agg(F.count("*").alias("_rows")).where("_rows > 1")
    rows = marked(base, bitmap_of(often, F.xxhash64("digest")), F.xxhash64("digest"), "_often").withColumn("_often", F.col("_often") & (F.col("n") >= revisit_bytes))
    null_id = F.lit(None).cast(pages.schema[id_col].dataType)
    alone = rows.where("NOT _often").select("id", "url", "body", "n", "digest", null_id.alias("refers_to"), F.lit(False).alias("revisit"))
    several = rows.where("_often")
    # The response of a payload: the largest id; a null id loses against every other.
    response = several.groupBy("digest").agg(F.max_by(F.struct("id", "url", "body", "n"), F.struct("id", "url")).alias("r")).select("r.id", "r.url", "r.body", "r.n", "digest", null_id.alias("refers_to"), F.lit(False).alias("revisit"))
    copies = several.groupBy("digest", "id", "url", "n").agg(F.count("*").alias("_copies"))
    keepers = several.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("_keep"))
    joined = copies.withColumn("_again", F.xxhash64("digest")).join(keepers.withColumn("_again", F.xxhash64("digest")), ["digest", "_again"])
    is_keeper = F.struct("id", "url").eqNullSafe(F.col("_keep"))
    times = F.col("_copies") - is_keeper.cast("int")
    revisits = joined.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _times)")))
    revisits = revisits.select("id", "url", F.lit(None).cast("string").alias("body"), "n", "digest", F.col("_keep.id").alias("refers_to"), F.lit(True).alias("revisit"))
    return alone.unionByName(response).unionByName(revisits)


def warc_record(record_id: str, url: str | None, body: bytes | None, n: int, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """The bytes of one record; a revisit has no payload but says how long it was."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if body is not None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if body is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>", f"X-Payload-Length: {n}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body or b'')}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (body or b"") + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of the records of a frame; a payload that doesn't fit its digest is an error."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = split + 4
        end = start + int(headers["Content-Length"])
        payload = data[start:end]
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + hashlib.sha1(payload).hexdigest():
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        yield at, end + 4 - at, headers, payload
        at = end + 4


class BundleWriter:
    """Frames of records, and the seek table at the end."""

    def __init__(self, folder: str, name: str):
        self.files, path = fs.FileSystem.from_uri(folder)
        self.path, self.part = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.part)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.at, self.held, self.size = 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def end_frame(self) -> tuple[int, int]:
        """Place and size of the frame in the bundle."""
        data = self.pack.compress(b"".join(self.held))
        self.out.write(data)
        start = self.at
        self.frames.append((len(data), self.size))
        self.at, self.held, self.size = self.at + len(data), [], 0
        return start, len(data)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.files.move(self.part, self.path)


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write records (from :func:`records`) to bundles in ``folder``; the index of all records, written itself.

    ``folder`` is a URI of a store that all executors share.  A frame holds about ``frame_bytes``, a bundle about ``bundle_bytes`` compressed; a
    longer record has a frame, or a bundle, of its own.  Every attempt of a task names its bundles anew; the index names those that count.
    """
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, index, open_ = TaskContext.get().partitionId(), 0, None, [], []
        attempt = uuid.uuid4().hex[:16]

        def end_frame():
            at, size = writer.end_frame()
            index.extend((i, kind, name, frame, at, size, offset, length) for i, kind, name, frame, offset, length in open_)
            open_.clear()

        def found():
            columns = list(zip(*index)) or [[]] * 8
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "record_type", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"])
            index.clear()
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                id_, url, body, n, digest, refers, revisit = (batch.column(c)[i].as_py() for c in range(7))
                record = warc_record("" if id_ is None else id_, url, None if revisit else body.encode(), n, digest, "" if refers is None else refers)
                if writer is None:
                    name = f"bundle-{part:06d}-{number:05d}-{attempt}.warc.zst"
                    writer, number = BundleWriter(folder, name), number + 1
                frame, offset = writer.add(record)
                open_.append((id_, "revisit" if revisit else "response", name, frame, offset, len(record)))
                if writer.size >= frame_bytes:
                    end_frame()
                    if writer.at >= bundle_bytes:
                        writer.close()
                        writer = None
            if index:
                yield found()
        if writer is not None:
            if open_:
                end_frame()
            writer.close()
        if index:
            yield found()

    wanted = rows.select(F.col("id").cast("string"), "url", "body", "n", "digest", F.col("refers_to").cast("string"), "revisit")
    return written(map_batches(wanted, scan, INDEX), "warc-index")


def seek_table(stream, size: int) -> list[tuple[int, int]]:
    """(place, size) of the frames of a bundle, from its end."""
    stream.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    stream.seek(size - 9 - 8 * count)
    sizes = struct.iter_unpack("<II", stream.read(8 * count))
    frames, at = [], 0
    for packed, _ in sizes:
        frames.append((at, packed))
        at += packed
    return frames


def _record_batch(found: list[tuple], with_payload: bool) -> pa.RecordBatch:
    rows = []
    for headers, payload in found:
        plain = lambda key: headers[key].removeprefix("<urn:record:").removesuffix(">") or None
        revisit = headers["WARC-Type"] == "revisit"
        n = int(headers["X-Payload-Length"]) if revisit else len(payload)
        rows.append((plain("WARC-Record-ID"), n, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], plain("WARC-Refers-To") if revisit else None, headers.get("WARC-Target-URI"), payload if with_payload and not revisit else None))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], [x.split()[0] for x in RECORD.split(", ")])


#: Bundles that a task reads, about.
TASK_BUNDLES = 4


def read_bundles(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """All records of the bundles in ``folder`` that ``index`` names, frame by frame.

    Bundles that it doesn't name were left by tasks that failed or ran twice.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, place = fs.FileSystem.from_uri(f"{folder}/{name}")
                with files.open_input_file(place) as stream:
                    for at, packed in seek_table(stream, stream.size()):
                        stream.seek(at)
                        data = unpack.decompress(stream.read(packed))
                        yield _record_batch([(h, p) for _, _, h, p in parse_records(data)], with_payload)

    names = index.select("bundle").distinct()
    return map_batches(names.repartition(1 + names.count() // TASK_BUNDLES, "bundle"), scan, RECORD)


def fetch_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The records of some rows of the index, each read from its frame alone; rows of one frame are read together."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(f"{folder}/{row['bundle']}")
                with files.open_input_file(path) as stream:
                    stream.seek(row["frame_at"])
                    data = unpack.decompress(stream.read(row["frame_bytes"]))
                places = set(row["offsets"])
                yield _record_batch([(h, p) for at, _, h, p in parse_records(data) if at in places], True)

    frames = wanted.groupBy("bundle", "frame", "frame_at", "frame_bytes").agg(F.collect_set("offset").alias("offsets"))
    return map_batches(frames, scan, RECORD)
