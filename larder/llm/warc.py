"""WARC archives with one Zstandard dictionary per archive set.

Layout (the ``.warc.zst`` convention): every file starts with a skippable
frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame
per record, so a record can be read alone.  The dictionary is trained from a
bounded, documented number of the records to be archived.

Files are written and read by Spark's own text writer and reader: a row is a
frame, and the line separator is an *empty skippable frame*
(``SEPARATOR``), which a Zstandard reader passes over.  The result is a valid
stream for any reader, is committed by Spark's output protocol (a task that is
lost and run again leaves no half file), works on any file system that Spark
knows, and large files are read in splits.  A frame that happens to contain
the separator is compressed again at another level.

Records: the payload is the html in UTF-8 (null: empty).  Of records with
equal payloads of at least ``min_payload`` bytes that with the smallest page
id is a ``response``; the others are ``revisit`` records that refer to it and
carry no payload.  Shorter ones are all ``response``.

Defined results: equal pages repeated under the smallest id are all
``response`` (a tie); a null page id is never the smallest while another id
exists, and a group with only null ids is all ``response``; a null url has no
target header; an empty table gives archives without records; other input
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import scratch_path

# Fixed values of the formats.
DICT_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MIN_PAYLOAD = 100
DICT_BYTES = 64 << 10
#: Records (at most) and leading bytes of each that train the dictionary.
DICT_RECORDS = 2000
DICT_RECORD_BYTES = 8 << 10

READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def with_record_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_payload: int) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    The smallest id of each payload is found by a map-side combined group-by
    over the digests alone; the pages are then joined with the payloads that
    occur under more than one id (AQE splits a hot payload).
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    # The digest alone decides; short payloads never match (null key).
    key = F.when(F.col("payload_bytes") >= min_payload, F.col("payload_digest"))
    firsts = (
        rows.select("page_id", key.alias("k"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("n_ids"))
        .where("first_id < last_id or n_ids between 1 and n - 1")
        .select("k", "first_id")
    )
    repeated = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        rows.withColumn("key", key)
        .join(firsts, F.col("key") == F.col("k"), "left")
        .select(
            "page_id", "url", "payload", "payload_bytes", "payload_digest",
            F.when(repeated, "revisit").otherwise("response").alias("record_type"),
            F.when(repeated, F.col("first_id")).alias("refers_to"),
        )
    )


def record_bytes(page_id, url, payload: bytes, n_bytes, digest, kind, refers_to) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    name = "none" if page_id is None else str(page_id)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=~-._"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    n_bytes = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: None if x in (None, "none") else int(x)
    inner = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
    return {
        "page_id": number(inner(fields["WARC-Record-ID"])),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(inner(fields.get("WARC-Refers-To"))),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def train_dictionary(pages: DataFrame, id_col: str, url_col: str, html_col: str, size: int, n_records: int, n_bytes: int) -> bytes:
    """Dictionary from about ``n_records`` response records (first ``n_bytes`` each).

    Pages are drawn by a hash of id and url, before any shuffle, so the choice
    does not depend on partitioning.  Too little material gives an empty
    dictionary, which stands for plain compression.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    n = pages.count()
    draw = F.pmod(F.xxhash64(id_col, url_col), F.lit(1 << 30)) / float(1 << 30)
    picked = (
        pages.where(draw < min(1.0, n_records / max(1, n)))
        .select(
            F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.substring(payload, 1, n_bytes).alias("payload"),
            F.octet_length(payload).alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
        )
        .limit(2 * n_records)  # a guard: twice the expected number
        .collect()
    )
    samples = sorted(record_bytes(r.page_id, r.url, bytes(r.payload), r.payload_bytes, r.payload_digest, "response", None)[:n_bytes] for r in picked)
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too few for a dictionary
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICT_MAGIC + struct.pack("<I", len(dictionary)) + dictionary


def _compressed(data: bytes, packers) -> bytes:
    for packer in packers:
        frame = packer.compress(data)
        if SEPARATOR.encode() not in frame:
            return frame
    raise ValueError("a record holds the separator at every compression level")


def write_archives(
    spark: SparkSession,
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_payload: int = MIN_PAYLOAD,
    files: int | None = None,
    level: int = 3,
    dict_bytes: int = DICT_BYTES,
    dict_records: int = DICT_RECORDS,
) -> None:
    """Write a record per page as archives below ``path``."""
    records = with_record_types(pages, id_col, url_col, html_col, min_payload)
    dictionary = train_dictionary(pages, id_col, url_col, html_col, dict_bytes, dict_records, DICT_RECORD_BYTES)
    lead = dictionary_frame(dictionary)
    while SEPARATOR.encode() in lead:  # keep the dictionary frame one row
        dictionary = dictionary[:-64]
        lead = dictionary_frame(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)

    def pack(batches):
        raw = sent.value
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        packers = [zstandard.ZstdCompressor(level=n, dict_data=shared, write_content_size=True) for n in (level, level + 1, 1, 9, 15)]
        yield pa.RecordBatch.from_arrays([pa.array([lead], pa.binary())], names=["frame"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                frames = [_compressed(record_bytes(*r.values()), packers) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    if files:
        records = records.repartition(files)
    frames = records.mapInArrow(pack, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives below ``path``; payloads are checked by digest."""
    frames = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("frame"))
    leads = F.substring("frame", 1, 4) == F.lit(DICT_MAGIC)
    # One dictionary per archive set: a single small row however many files.
    found = frames.where(leads).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("archives of different sets: read them one set at a time")
    sent = spark.sparkContext.broadcast(bytes(found[0].frame)[8:] if found else b"")

    def unpack(batches):
        raw = sent.value
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        names = [f.split(" ")[0] for f in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                frames = batch.column(0).slice(at, 256).to_pylist()
                rows = [parse_record(opener.decompress(f)) for f in frames]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names
                )

    return frames.where(~leads).mapInArrow(unpack, READ_SCHEMA)


def archive_pages(spark: SparkSession, pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Archive ``pages`` below ``path`` and return what the archives hold."""
    path = path or scratch_path(spark, "warc")
    write_archives(spark, pages, path, **options)
    return read_archives(spark, path)


def archive_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The contract's columns, from the archives."""
    return archive_pages(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_stream(parts: list[bytes]) -> tuple[bytes, list[bytes]]:
    """(dictionary, record frames' contents) of one archive file's bytes, by the format alone (for tests)."""
    data, at, dictionary, out = b"".join(parts), 0, b"", []
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if magic == 0x184D2A5D:
                dictionary = data[at + 8 : at + 8 + size]
            at += 8 + size
            continue
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        one = opener.decompressobj()
        out.append(one.decompress(data[at:]))
        at = len(data) - len(one.unused_data)
    return dictionary, out
