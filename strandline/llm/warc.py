"""Zstandard WARC archives: one frame per record, with a dictionary in the leading skippable frame.

Writing: pages with equal payloads of at least ``MIN_REVISIT`` bytes are stored once, as the response of the
largest page id; the others are revisit records that refer to it.  Every task writes files of bounded size
under a name of its own and renames them when complete, so a repeated task leaves the same files.
Reading: the dictionary is loaded from the first frame, frames are found by walking their block headers, each
is decoded by itself, and headers, lengths and digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, hash_sample, scratch_path

MIN_REVISIT = 1000
SAMPLE = 1000             # pages that the dictionary is trained on
SAMPLE_BYTES = 64 << 10   # of each
DICT_BYTES = 64 << 10
FILE_BYTES = 32 << 20     # compressed bytes after which a file is full
MAX_RECORD = 1 << 31

# Magic numbers of the format.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """An archive that breaks the format; the message names the place."""


# ---- records ----------------------------------------------------------------------------------------

def record_id(page_id: int | None, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{place}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, place: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; ``refers_to`` makes it a revisit, which leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:page:unknown")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, place)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
            "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises BadArchive if a header, length or digest is wrong."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0 or not data.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n")):
        raise BadArchive("no WARC header")
    fields: dict[str, str] = {}
    for line in data[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadArchive(f"bad header line {line[:60]!r}")
        fields[name.strip().decode().lower()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise BadArchive(f"header {need} is missing")
    if not fields["content-length"].isdigit():
        raise BadArchive("Content-Length is no number")
    size = int(fields["content-length"])
    block, tail = data[cut + 4:cut + 4 + size], data[cut + 4 + size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadArchive(f"block of {len(data) - cut - 8} bytes, Content-Length says {size}")
    if "warc-block-digest" in fields and _sha1(block) != fields["warc-block-digest"]:
        raise BadArchive("block digest differs")
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header in the block")
    http = {n.strip().lower(): v.strip() for n, _, v in (h.partition(b":") for h in block[:end].split(b"\r\n")[1:])}
    length = int(http.get(b"content-length", b"-1"))
    payload: bytes | None = block[end + 4:]
    if fields["warc-type"] == "revisit":
        if payload or fields.get("warc-profile") != PROFILE:
            raise BadArchive("a revisit with a payload or without its profile")
        payload = None
    elif len(payload) != length or _sha1(payload) != fields.get("warc-payload-digest"):
        raise BadArchive("payload length or digest differs")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {"page_id": None if page is None else int(page), "url": fields.get("warc-target-uri"), "payload": payload,
            "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"],
            "refers_to": None if refers is None else int(refers)}


# ---- frames -----------------------------------------------------------------------------------------

def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame at ``start`` ends, found from its block headers without decoding it."""
    if len(data) - start < 5 or struct.unpack_from("<I", data, start)[0] != FRAME_MAGIC:
        raise BadArchive(f"no frame at byte {start}")
    at = start + zstandard.frame_header_size(bytes(data[start:start + 18]))
    checksum = data[start + 4] >> 2 & 1
    while True:
        if at + 3 > len(data):
            raise BadArchive(f"frame at byte {start} is cut off")
        head = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise BadArchive(f"frame at byte {start} is cut off")
    return at


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive file, in order."""
    data, at = memoryview(content), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > len(data):
                raise BadArchive(f"skippable frame at byte {at} is cut off")
            if magic == DICT_MAGIC:
                if at:
                    raise BadArchive("the dictionary is not in the leading frame")
                raw = bytes(data[8:8 + size])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = decoder.decompress(raw, max_output_size=16 << 20)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        end = frame_end(data, at)
        try:
            record = decoder.decompress(data[at:end], max_output_size=MAX_RECORD)
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame at byte {at}: {e}") from e
        yield parse_record(record)
        at = end


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records, or none (empty) where there are too few to train on."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


# ---- Spark ------------------------------------------------------------------------------------------

def _open_store(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, dictionary, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, path = _open_store(folder)
        store.create_dir(path, recursive=True)
        raw = dictionary.value
        options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        packer = zstandard.ZstdCompressor(level=6, write_checksum=True, **options)
        lead = struct.pack("<II", DICT_MAGIC, len(raw)) + raw if raw else b""
        context = TaskContext.get()
        out, size, number, names, count = None, 0, 0, [], 0

        def close():
            out.close()
            store.move(f"{path}/{names[-1]}.{context.taskAttemptId()}.part", f"{path}/{names[-1]}")

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if out is None or size >= file_bytes:
                    if out is not None:
                        close()
                    names.append(f"part-{context.partitionId():05d}-{number:04d}.warc.zst")
                    out = store.open_output_stream(f"{path}/{names[-1]}.{context.taskAttemptId()}.part")
                    out.write(lead)
                    size, number = len(lead), number + 1
                frame = packer.compress(make_record(page_id, count, url, (html or "").encode(), refers))
                out.write(frame)
                size, count = size + len(frame), count + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])
    return run


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html",
                   min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> int:
    """Write one record per row of ``pages`` into archive files under ``folder``; returns the number of files.

    Among rows with equal payloads of at least ``min_revisit`` bytes those with the largest key are responses
    (all rows of that key, if it repeats), the others revisits.  A null html is an empty payload; a null url is
    written as an unknown one; rows with a null key are responses, and never the one that is referred to.
    ``folder`` must lie in a store that all executors share and that pyarrow can write to.
    """
    spark = pages.sparkSession
    body = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    sample = (hash_sample(body.where(F.length("html") > 0), "id", SAMPLE)
              .select("id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).collect())  # bounded: trains the dictionary only
    dictionary = spark.sparkContext.broadcast(train_dictionary([make_record(r["id"], 0, r["url"], r["html"].encode(), None) for r in sample]))
    keyed = body.withColumn("digest", F.unhex(F.sha1(payload))).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    copies = cut_lineage(keyed.where(F.col("size") >= min_revisit).groupBy("digest", "size")
                         .agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-copies")
    linked = keyed.join(copies, ["digest", "size"], "left")
    refers = F.when(F.col("id") < F.col("response"), F.col("response"))
    # Sorted, so that a task that is run again writes the same files.
    rows = linked.select("id", "url", "html", refers.alias("refers")).sortWithinPartitions("id", "url", "html")
    return rows.mapInArrow(_writer(folder, dictionary, file_bytes), "name string").count()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives under ``folder``: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest (hexadecimal SHA-1), record_type, refers_to.  A malformed archive fails the job."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[dict] = []
                size = 0
                for record in read_archive(content.as_buffer().to_pybytes()):
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if size > 8 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back (an empty table: no rows)."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    if write_archives(pages, folder, **options) == 0:
        return spark.createDataFrame([], "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder)
