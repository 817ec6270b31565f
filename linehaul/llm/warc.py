"""WARC archives with a shared Zstandard dictionary.

A file starts with a skippable frame that holds the dictionary; every record after it is a frame of its own, so a
reader can start at any record. Payloads that repeat are written once as a response and as revisits elsewhere.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.scratch import Scratch

#: Fixed values of the formats: the skippable frame's magic number and the revisit profile.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}/{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers name the payload's digest and length."""
    block = b""
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Profile", REVISIT_PROFILE), ("Page-Refers-To", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of one record; lengths and a response's digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        if f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"] or len(payload) != int(fields["Page-Payload-Length"]):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return fields, payload


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; a raw one of the samples' ends where there are too few to train on; empty without samples."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_archives(records: DataFrame, folder: str, dictionary: bytes, level: int = 3) -> DataFrame:
    """Write each partition of ``records`` (page_id, url, html, refers_to) to a file; ``(path, records)`` of the files that count.

    A file's name has the attempt's number, so a lost or repeated task leaves a file that no manifest row names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        fs, name = _open(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        d, n = _dictionary(dictionary), 0
        compressor = zstandard.ZstdCompressor(level=level, dict_data=d) if d else zstandard.ZstdCompressor(level=level)
        with fs.open_output_stream(name) as out:
            out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
            while first is not None:
                for page_id, url, html, refers_to in zip(*(first.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = (html or "").encode()
                    out.write(compressor.compress(encode_record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to)))
                    n += 1
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records long")


def _frames(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one at a time; memory holds one record and one chunk."""
    fs, name = _open(path)
    with fs.open_input_stream(name) as source:
        magic, n = struct.unpack("<II", source.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{path} has no leading dictionary frame")
        d = _dictionary(source.read(n))
        decompressor = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
        left = source.read(chunk)
        while left:
            frame, parts = decompressor.decompressobj(), []
            while True:
                parts.append(frame.decompress(left))
                if frame.eof:
                    left = frame.unused_data or source.read(chunk)
                    break
                left = source.read(chunk)
                if not left:
                    raise ValueError(f"{path} ends within a record")
            yield b"".join(parts)


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives whose ``path`` and number of ``records`` the manifest has; ``payload`` too if asked for."""
    fields = [*RECORD_SCHEMA.split(", "), *(["payload binary"] if payloads else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in fields])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=schema)

        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                for raw in _frames(path):
                    f, payload = decode_record(raw)
                    url = f.get("WARC-Target-URI")
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    rows.append((number("Page-Id"), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), number("Page-Payload-Length"), f["WARC-Payload-Digest"].partition(":")[2], f["WARC-Type"], number("Page-Refers-To"), path, *([payload] if payloads else [])))
                    n += 1
                    if len(rows) == (64 if payloads else 4096):
                        yield batch(rows)
                        rows = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records instead of {expected}")
                if rows:
                    yield batch(rows)

    return manifest.mapInArrow(read, ", ".join(fields))


def revisits(pages: DataFrame, min_bytes: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """``(page_id, digest, refers_to)`` of rows whose payload, of at least ``min_bytes``, a smaller page_id has too."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    digests = scratch.table(pages.where(F.octet_length(html) >= min_bytes).select("page_id", F.unhex(F.sha2(html, 256)).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    first = scratch.table(first.select("digest", "refers_to"), "first")
    return scratch.table(digests.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


def sample_records(pages: DataFrame, rows: int, row_bytes: int) -> list[bytes]:
    """At most ``rows`` records, chosen by hash among those with a payload of at most ``row_bytes``, encoded whole."""
    small = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) <= row_bytes).withColumn("h", F.xxhash64("page_id", F.octet_length("html")))
    # hashes alone first, so that few texts are moved
    last = [r["h"] for r in small.select("h").orderBy("h").limit(rows).collect()][-1:]
    chosen = small.where(F.col("h") <= last[0]).orderBy("h", "url").limit(rows).collect() if last else []
    payloads = [(r, (r["html"] or "").encode()) for r in chosen]
    return [encode_record(r["page_id"], r["url"], p, hashlib.sha256(p).hexdigest(), None) for r, p in payloads]


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, dict_bytes: int = 64 << 10, dict_rows: int = 1000, dict_row_bytes: int = 128 << 10, level: int = 3) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) to ``folder``, by default one below the shared folder; the manifest ``(path, records)``.

    The dictionary is built from at most ``dict_rows`` whole records, chosen by hash among those with a payload of at
    most ``dict_row_bytes``; it changes sizes only. Null html is an empty payload, a null page_id is always a response,
    rows repeated with the same page_id and payload are all of the kind that page_id is; other columns are left out.
    A record is whole in a task's memory, however long. An empty table gives an empty manifest.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or f"{scratch.root}/archives"
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    again = revisits(pages, min_bytes, scratch).withColumnRenamed("page_id", "_id").withColumnRenamed("digest", "_digest")
    dictionary = train_dictionary(sample_records(pages, dict_rows, dict_row_bytes), dict_bytes)
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    records = pages.withColumn("_d", digest).join(again, (F.col("page_id") == F.col("_id")) & (F.col("_d") == F.col("_digest")), "left")
    return scratch.table(write_archives(records, folder, dictionary, level), "manifest")
