"""WARC archives of individually Zstandard-compressed records with an embedded dictionary, written and read by Spark.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary trained on a bounded
sample of the archive's own records; every record follows as a frame of its own, compressed with it. Records are HTTP
responses with the payload, or revisits of the response with the same payload (identical-payload-digest profile), which
hold the HTTP header alone. One task writes one archive of about ``ARCHIVE_BYTES`` of payload through Spark's text sink,
whose commit protocol keeps lost or repeated tasks from leaving partial files; an empty skippable frame, which every
decoder passes over, serves as its line end. Archives are read through Spark's binary file source, so any file system works.

Of the pages with equal payloads (SHA-1 and length; at least ``least_bytes`` long) that with the largest key becomes the
response. Copies are counted on narrow rows with map-side aggregation; a page's content crosses the network once, dealt
by page, so the copies of one payload do not meet in a task.

Defined cases: a null payload is empty, and empty payloads are equal; rows equal in key and payload get the same type;
null keys come after all others when the response is chosen (all copies with null keys are responses); a null address
writes no target; line breaks in addresses are percent-encoded; an empty table writes no records; extra columns are not
archived, so their names may clash with those of the result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekspan.llm.textbatch import tidy

ARCHIVE_BYTES = 24_000_000
SAMPLE_BYTES = 2_000_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: magic 0x184D2A50, length 0
FRAME_END = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_key string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def with_roles(pages: DataFrame, key: str, address: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """page_key, target, body (null for revisits), n_bytes, digest, refers_to (null for responses), dealt into archives."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("page_key"), F.col(address).cast("string").alias("target"),
        body.alias("body"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("digest"),
    )
    narrow = rows.select("key", "page_key", "digest").filter(F.col("n_bytes") >= least_bytes)
    heads = narrow.groupBy("digest").agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1 and head is not null")
    copies = narrow.join(heads, "digest").filter(~F.col("key").eqNullSafe(F.col("head")))
    revisits = copies.select("page_key", "digest", F.col("head").cast("string").alias("refers_to")).distinct()
    volume = pages.select(F.octet_length(payload).alias("n")).agg(F.sum("n")).first()[0] or 0
    archives = max(1, -(-volume // ARCHIVE_BYTES))
    dealt = rows.drop("key").repartition(archives, "page_key", "digest")
    joined = dealt.join(revisits, ["page_key", "digest"], "left")
    return joined.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("body")))


def record(key: str, target: str | None, body: bytes | None, n_bytes: int, digest: str, refers_to: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + (body or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {date}"]
    if target is not None:
        lines.append("WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; too few of them to train on serve as the dictionary's content themselves."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(sum(map(len, records)) // 10, 1_024)), records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary frame, then one frame for each record."""
    sample: list[bytes] = []
    size = 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not sample:
        return
    dictionary = dictionary_of(sample)
    content = dictionary.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    for r in sample:
        yield compressor.compress(r)
    for r in records:
        yield compressor.compress(r)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", address: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one archive for each task below ``path``, a folder that does not exist yet."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for x in zip(*[batch.column(batch.schema.get_field_index(n)) for n in ("page_key", "target", "body", "n_bytes", "digest", "refers_to")], strict=True):
                    page_key, target, body, n_bytes, digest, refers_to = (v.as_py() for v in x)
                    shown = base64.b32encode(bytes.fromhex(digest)).decode("ascii")
                    yield record(page_key, target, body, n_bytes, shown, refers_to, date)

        waiting, size = [], 0
        for frame in _frames(records()):
            waiting.append(frame)
            size += len(frame)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], ["frame"])
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], ["frame"])

    frames = with_roles(pages, key, address, payload, least_bytes).mapInArrow(tidy(archive), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", FRAME_END).text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC header, HTTP header, payload) of each record of one archive."""
    if not content:
        return
    dictionary, start = None, 0
    magic, size = struct.unpack_from("<II", content)
    if magic == DICTIONARY_MAGIC:
        trained = content[8:12] == struct.pack("<I", 0xEC30A437)
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size], dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        start = 8 + size
    source = io.BytesIO(content)
    source.seek(start)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        header = _header(stream)
        block = stream.read(int(header["Content-Length"]))
        if len(block) != int(header["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        http = io.BytesIO(block)
        http.readline()
        yield header, _header(http), block[http.tell() :]


def _header(stream) -> dict[str, str]:
    fields = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8").partition(": ")
        fields[name] = value
    return fields


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``; every response's payload is checked against its digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for header, http, payload in records_of(content.as_py()):
                    kind, digest = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (base32_digest(payload) != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"payload of {header['WARC-Record-ID']} does not match its digest")
                    strip = lambda name: header[name][len("<urn:page:") : -1] if name in header else None
                    row = (strip("WARC-Record-ID"), kind, header.get("WARC-Target-URI"), int(http["Content-Length"]), digest, strip("WARC-Refers-To"))
                    rows.append(row + ((payload if kind == "response" else None),) * with_payload)
                    held += len(payload) * with_payload + 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(parse), RECORD + ", payload binary" * with_payload)
