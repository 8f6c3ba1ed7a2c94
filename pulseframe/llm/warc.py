"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each file starts with a skippable frame that holds a dictionary built from its records; every record is a frame of
its own. Of equal payloads the smallest id is written as a response and the others as revisits of it. Each task
writes one file below the shared folder under a name of its own and reports it; only reported files are read, so a
task that is run again leaves nothing that counts.

Defined cases: null html is an empty payload; a null url gives an empty target; a repeated row (same id, same
payload) is written as often as it occurs, a response each time if its id is the smallest; a row without an id is a
response whatever its payload, as nothing says which of two such rows comes first; an empty table gives no
records; further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path, staged, table

#: Magic of the skippable frame that holds the dictionary, and of a trained dictionary. Fixed values of the formats.
DICTIONARY_FRAME, TRAINED = 0x184D2A5D, 0xEC30A437
#: A file's dictionary is built from at most so many bytes of its first records, read in so many bytes at most.
DICTIONARY_BYTES, SAMPLE_BYTES, BUFFER_BYTES = 64 << 10, 2 << 20, 16 << 20
DATE = "2024-01-01T00:00:00Z"

ROW = "page_id long, url string, html string, refers_to long, refers_url string"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def header_value(text: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, refers_url: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(refers_to)}",
            f"WARC-Refers-To-Target-URI: {header_value(refers_url)}", f"WARC-Refers-To-Date: {DATE}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of RECORD from one record's bytes; a wrong length or digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong payload")
    number = lambda s: int(s) if (s := s[len("<urn:page:") : -1]) else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None


def build_dictionary(records: list[bytes]):
    """A dictionary from a sample of records, spread evenly; where too few for training, their bytes as they are."""
    import zstandard

    total, step = 0, max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = []
    for r in records[::step]:
        sample.append(r[: SAMPLE_BYTES // 8])
        total += len(sample[-1])
        if total >= SAMPLE_BYTES:
            break
    try:
        if len(sample) >= 16:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), sample)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def open_folder(uri: str):
    """(file system, path) of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write rows of ROW, a file for each partition; returns the manifest (lazily: write it to run it once)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, top = open_folder(folder)
        rows = (record(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r)
            if size >= BUFFER_BYTES:
                break
        if not held:
            return
        words = build_dictionary(held)
        compress = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True).compress
        files.create_dir(top, recursive=True)
        path, count, written = f"{top}/{uuid.uuid4().hex}.warc.zst", 0, 0
        with files.open_output_stream(path, compression=None) as out:
            raw = words.as_bytes()
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
            for part in (held, rows):
                for r in part:
                    frame = compress(r)
                    out.write(frame)
                    count += 1
                    written += len(frame)
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([written + 8 + len(raw)], pa.int64())], ["path", "records", "bytes"])

    return map_batches(pages.select("page_id", "url", "html", "refers_to", "refers_url"), write, MANIFEST)


def frames(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open .warc.zst file, one after the other."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    raw = stream.read(size)
    trained = raw[:4] == struct.pack("<I", TRAINED)
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    machine, rest, out = zstandard.ZstdDecompressor(dict_data=words), b"", []
    one = machine.decompressobj()
    while rest or (rest := stream.read(block)):
        out.append(one.decompress(rest))
        rest = b""
        if one.eof:
            yield b"".join(out)
            rest, out, one = one.unused_data, [], machine.decompressobj()


def read_archives(manifest: DataFrame, folder: str, n_files: int) -> DataFrame:
    """The records of the files in a manifest, as rows of RECORD."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(folder)
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for path, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for r in frames(stream):
                        rows.append(parse(r))
                        if len(rows) == 5000:
                            yield batch(rows)
                            rows, seen = [], seen + 5000
                if seen + len(rows) != count:
                    raise ValueError(f"{path} has {seen + len(rows)} records, not {count}")
                if rows:
                    yield batch(rows)

    return map_batches(manifest.select("path", "records").repartition(max(1, n_files), "path"), read, RECORD)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows of ROW: refers_to and refers_url name the first page of an equal payload of at least least_bytes."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    ids = staged(rows.select("page_id", "url", F.unhex(F.sha2("html", 256)).alias("key"), F.octet_length("html").alias("size")), "warc-ids")
    ids = ids.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    first = ids.groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ids.join(first, "key").where("page_id != first.page_id").select("page_id", "key", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()
    met = rows.withColumn("key", F.unhex(F.sha2("html", 256))).join(again, ["page_id", "key"], "left")
    return met.select("page_id", "url", "html", "refers_to", "refers_url")


def archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives below folder; returns the manifest of the files written."""
    return staged(write_archives(mark_revisits(pages, least_bytes), folder), "warc-manifest")


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = archive(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    found = read_archives(manifest, folder, manifest.count())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM k
"""
