"""WARC archives of web pages, Zstandard-compressed with a dictionary of their own, and their reader.

An archive is a file of Zstandard frames.  The first is a skippable frame that holds the dictionary (itself
a Zstandard frame); each further frame is one WARC record, compressed on its own with that dictionary, so a
record can be read alone.  The dictionary is trained on records of the same archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique
from tidemark.session import disposable, materialise, shuffle_partitions, work_dir

MAGIC = 0x184D2A5D  # fixed value: skippable frame with a dictionary in .warc.zst files
ARCHIVE_BYTES = 16 << 20  # of payload in one archive
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20  # of records that a dictionary is trained on
SAMPLE_RECORDS = 400
LEAST_REVISIT = 1000  # bytes of payload from which equal payloads are stored once
SALTS = 4096  # tasks that a row repeated without end is dealt to, at most
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


# ------------------------------------------------------------------ records


def _record_id(page_id: int | None) -> str:
    """The URN of a page's record; the page id can be read from it."""
    return f"<urn:uuid:{uuid.UUID(int=(0x7469646D << 96) | (page_id & (1 << 64) - 1))}>" if page_id is not None else f"<urn:uuid:{uuid.UUID(int=0)}>"


def _page_id(urn: str) -> int | None:
    number = uuid.UUID(urn[len("<urn:uuid:"):-1]).int
    low = number & (1 << 64) - 1
    return None if not number else low - (1 << 64) if low >> 63 else low


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    header = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{b32encode(digest).decode()}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        header.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    if revisit:
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload); checks lengths and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError("payload differs from its digest")
    refers = _page_id(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, size, digest.hex(), refers, payload if kind == "response" else None


# ------------------------------------------------------------------ archives


def train_dictionary(records: list[bytes]) -> bytes:
    """Raw dictionary from records spread evenly over the archive; empty if they are too few or too small.

    A record adds at most an even share of ``SAMPLE_BYTES``, so one long record cannot fill the sample.
    """
    chosen = records[:: max(1, len(records) // SAMPLE_RECORDS)]
    part = max(1, SAMPLE_BYTES // max(1, len(chosen)))
    samples = [r[:part] for r in chosen]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def make_archive(records: list[bytes]) -> bytes:
    raw = train_dictionary(records)
    out = []
    options = {"level": 3, "write_content_size": True, "write_checksum": True}
    if raw:
        packed = zstandard.ZstdCompressor(level=9).compress(raw)
        out.append(MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        options["dict_data"] = zstandard.ZstdCompressionDict(raw)
    press = zstandard.ZstdCompressor(**options)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def read_archive(content: bytes) -> Iterator[bytes]:
    """Uncompressed records; the file is walked frame by frame."""
    at, options = 0, {}
    if content[:4] == MAGIC.to_bytes(4, "little"):
        at = 8 + int.from_bytes(content[4:8], "little")
        options["dict_data"] = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8:at]))
    unpress = zstandard.ZstdDecompressor(**options)
    view = memoryview(content)
    while at < len(content):
        frame = unpress.decompressobj()
        # frames say how long their content is, not how long they are: feed growing slices
        step, record, start = 1 << 16, [], at
        while not frame.eof:
            if at >= len(content):
                raise ValueError("archive ends inside a record")
            record.append(frame.decompress(view[at: at + step]))
            at += step
        at = min(at, len(content)) - len(frame.unused_data)
        if at <= start:
            raise ValueError("empty frame")
        yield b"".join(record)


def _writer(folder: str, archive_bytes: int):
    def write(batches):
        task = TaskContext.get()
        fs, path = pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        held, size, done = [], 0, 0

        def flush():
            # the name depends on the task and not on the attempt: a repeated task replaces the same file
            name = f"{path}/part-{task.partitionId():06d}-{done:05d}.warc.zst"
            draft = f"{path}/_{task.partitionId():06d}-{done:05d}-{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                out.write(make_archive(held))
            fs.move(draft, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                held.append(make_record(page_id, url, payload, refers_to, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, done = [], 0, done + 1
        if held:
            yield flush()

    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record below ``folder``; returns (archive, records).

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a response,
    the others are revisits of it; rows that repeat that page_id are responses too.  NULL html is an empty
    payload.  A row without page_id is a response under the nil URN and is never referred to.  NULL url leaves
    the target out.  An empty table writes no archive.

    Only (page_id, digest) pairs meet by digest, to find the largest id per digest, which tasks do before the
    shuffle, and to learn it, where digests that many pages share are served by a bounded broadcast; a row repeated
    without end is dealt to many tasks.  Tasks order rows by page id, hence a task that runs again writes the same
    files.  ``folder`` is any URI that Arrow's file systems write (on executors: ``s3a:`` is written as ``s3:``, and
    ``hdfs:`` needs libhdfs there).  An archive of fewer than 8 records has no dictionary, as there is nothing to
    train one on.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt"),
    )
    with disposable(pages.sparkSession) as keep:
        keyed = rows.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("_b")).where(
            F.col("page_id").isNotNull() & (F.octet_length("_b") >= least)
        ).select("page_id", F.sha1("_b").alias("_digest"))
        keyed = materialise(keyed, "payloads")
        leaders = keyed.groupBy("_digest").agg(F.max("page_id").alias("_leader"), F.min("page_id").alias("_low")).where("_leader <> _low").drop("_low")
        leaders = materialise(leaders, "leaders")
        revisits = join_unique(keyed, leaders, "_digest", keyed.count()).where("page_id <> _leader").groupBy("page_id", "_digest").agg(F.first("_leader").alias("refers_to"))
        revisits = revisits.withColumnRenamed("page_id", "_page")
        revisits = materialise(revisits, "revisits")
        # rows are told apart by id and payload, since ids may repeat
        digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
        joined = rows.withColumn("_d", digest).join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("_d") == F.col("_digest")), "left")
        place = F.xxhash64("page_id", "_d", "_salt")
        dealt = joined.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("_revisit"), place.alias("_place"))
        dealt = dealt.repartition(shuffle_partitions(pages.sparkSession), "_place").drop("_place").sortWithinPartitions("page_id", "url", "html")
        _make_folder(pages.sparkSession, folder)
        return keep(materialise(dealt.mapInArrow(_writer(folder, archive_bytes), "archive string, records long"), "archives"))


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives below ``folder``; a broken record raises."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in read_archive(content.as_py()):
                    held.append(read_record(raw))
                    size += len(raw)
                    if size > 8 << 20:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(parse, RECORDS)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(_RECORDS)], schema=_RECORDS)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back, without the payloads."""
    folder = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    write_archives(pages, folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
