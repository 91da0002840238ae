"""WARC archives in Zstandard form with a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then each record is one
frame of its own.  The reader loads the dictionary from that frame, decodes frame after frame, and checks each
record: version line, required headers, Content-Length, block and payload digests.

Payloads of at least ``MIN_PAYLOAD`` bytes are written once: the record with the least page_id of equal payloads
is a response, the others are revisits that refer to it.

The dictionary is trained on at most ``SAMPLE`` payloads (of up to ``SAMPLE_BYTES`` each), chosen by a hash.

Defined results: null html is an empty payload; a null url has no target header; a null page_id is written and
read as null, and its record is a response; rows that repeat the least page_id are responses too; a payload of any length
is one record, and a task holds one archive of ``FILE_BYTES`` and one record in memory; other columns are not
looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, saved, scratch_path
from .files import write_whole

SKIPPABLE = 0x184D2A5D
FRAME = struct.pack("<I", zstandard.MAGIC_NUMBER)
MIN_PAYLOAD = 100
SAMPLE, SAMPLE_BYTES, DICTIONARY = 500, 1 << 15, 1 << 16
#: Bytes of payloads that a task is dealt, bytes of an archive, archives that a task may begin, and bytes read at once.
TASK_BYTES, FILE_BYTES, TASK_FILES, STEP = 16 << 20, 16 << 20, 1 << 20, 1 << 13
#: Parts that equal rows are dealt to.
SALTS = 64
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload."""
    block = HTTP + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "X-Payload-Length": None if refers_to is None else str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a whole record; raises ValueError if anything doesn't fit."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip()] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise ValueError(f"headers missing: {missing}")
    n = headers["Content-Length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("length doesn't fit")
    block = rest[: int(n)]
    if (d := headers.get("WARC-Block-Digest")) and d != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest doesn't fit")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and (d := headers.get("WARC-Payload-Digest")) and d != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("payload digest doesn't fit")
    return headers, payload


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of their text as it stands where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples)[:DICTIONARY] or HTTP).ljust(16, b" ")


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame each."""
    view, at, options = memoryview(data), 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        kept = bytes(view[8 : 8 + size])
        if len(kept) != size:
            raise ValueError("dictionary cut short")
        if kept.startswith(FRAME):  # the dictionary may itself be compressed
            kept = zstandard.ZstdDecompressor().decompress(kept)
        options, at = {"dict_data": zstandard.ZstdCompressionDict(kept)}, 8 + size
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        one, pieces = reader.decompressobj(), []
        while not one.eof:  # in small steps: what follows the frame is copied each time
            if at >= len(data):
                raise ValueError("frame cut short")
            step = view[at : at + STEP]
            pieces.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield parse_record(b"".join(pieces))


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, salt, refers_to): which records revisit which."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    # dealt in the order of the scan, which a repeated task keeps
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", salt, payload.alias("html"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = saved(rows.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "payloads")
    joined = join_groups(rows, firsts, ["digest"])
    return joined.select("page_id", "url", "html", "digest", "salt", F.when((F.col("size") >= MIN_PAYLOAD) & (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def samples(pages: DataFrame) -> list[bytes]:
    """At most ``SAMPLE`` different payloads: those with the least hashes, of which only the hashes are looked for first."""
    few = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES)).select("html", F.pmod(F.xxhash64("html"), F.lit(1 << 62)).alias("h"))
    n = few.agg(F.approx_count_distinct("h")).first()[0]
    likely = few.where(F.col("h") < int(min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 62)))
    least = sorted(r["h"] for r in likely.select("h").distinct().orderBy("h").limit(SAMPLE).collect())
    if not least:
        return []
    chosen = likely.where(F.col("h") <= least[-1]).groupBy("h").agg(F.first("html").alias("html"))  # rows of one hash are equal
    return [r["html"].encode() for r in chosen.orderBy("h").collect()]


def write_archives(pages: DataFrame, folder: str, task_bytes: int = TASK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives; returns (file, records, bytes) of each."""
    dictionary = train_dictionary(samples(pages))
    schema = pa.schema([("file", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, frames, held, files = TaskContext.get().partitionId(), [], 0, 0
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)

        def written() -> pa.RecordBatch:
            nonlocal frames, held, files
            file, data = task * TASK_FILES + files, b"".join([leading_frame(dictionary), *frames])
            write_whole(f"{folder}/part-{file:019d}.warc.zst", data)
            out = pa.RecordBatch.from_pydict({"file": [file], "records": [len(frames)], "bytes": [len(data)]}, schema)
            frames, held, files = [], 0, files + 1
            return out

        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                frames.append(writer.compress(record_bytes(page_id, url, html.encode(), digest, refers_to)))
                held += len(frames[-1])
                if held >= file_bytes:
                    yield written()
        if frames:
            yield written()

    size = pages.agg(F.sum(F.octet_length("html") + F.lit(512))).first()[0] or 0
    dealt = planned(pages).repartition(max(1, -(-size // task_bytes)), "page_id", "salt")
    return saved(dealt.mapInArrow(run, "file long, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    number = lambda x: int(x) if x and (x := x.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for head, payload in read_archive(data.as_py()):
                    own = head["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if own else head["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((number(head["WARC-Record-ID"]), len(payload) if own else int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.zst").select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives say of each page, after writing and reading them."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = write_archives(pages, folder)
    if files.isEmpty():
        none = files.select(F.col("file").alias("page_id"), F.col("file").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.col("file").alias("refers_to"))
        return none
    return read_archives(spark, folder).drop("url")
