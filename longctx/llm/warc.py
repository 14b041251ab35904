"""Operator 8: WARC archives in Zstandard frames, with a writer and a validating reader.

An archive is ``archive-NNNNN.warc.zst``: a skippable frame that holds the dictionary (a Zstandard
dictionary trained on a bounded number of the archive's own payloads; left out if there are too few
to train one), then one frame per record.  Records are ``response`` records whose block is an HTTP
response with the payload, or ``revisit`` records whose block is only the HTTP header and whose
``WARC-Refers-To`` names the response with the same payload.

Writing: digests and the choice of the response per digest are Spark aggregates (combined
map-side) and one join that AQE splits when one payload is very common.  Each
task of that join writes one archive; which rows it holds depends on their key only, so a task that
is run again writes the same file, which gets its name only when complete.  Files go through the file system that the folder's URI names.
Reading: Spark's ``binaryFile`` source, so any store that Spark reads; one task decodes frame by frame.

Validated per record: frame boundaries, version line, required fields, Content-Length against the
block, block and payload digests; for revisits that the record referred to exists, is a response
and has the same payload digest.  ``valid`` is false, with the reason in ``error``, where a check
fails; a frame that cannot be decoded ends its archive with one such row.

Nulls and edge cases: null html is an empty payload, and empty payloads are equal to each other.
Repeated keys: records keep their own row; the response of a payload is one of the rows with the
largest key.  Null keys are not written.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longctx.llm.words import pieces

# Fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

LEVEL = 6
DICT_BYTES, DICT_SAMPLES, DICT_SAMPLE_BYTES = 32_768, 200, 8192
DATE = datetime(2020, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
RECORD_SCHEMA = ("archive string, offset long, page_id long, url string, record_type string, payload binary, "
                 "payload_digest string, refers_to long, valid boolean, error string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int, row: int = 0) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}').urn}>"


def _line(value: str | None) -> str:
    """A header value: line breaks and other controls would break the record."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; ``refers_to``: key of the response that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"X-Page-ID: {page_id}",
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICT_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(folder: str):
    def run(batches):
        import os
        from pyspark import TaskContext
        task = TaskContext.get()
        name = f"archive-{task.partitionId():05d}.warc.zst"
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = posixpath.join(root, f"_{name}.{task.taskAttemptId()}.{os.getpid()}")
        count, out, head = 0, None, []

        def records(rows):
            return [make_record(*r) for r in rows]

        def flush(rows, packer):
            for r in records(rows):
                out.write(packer.compress(r))

        packer = None
        for batch in pieces(batches, 64):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")),
                            strict=True))
            count += len(rows)
            if packer is None:
                head += rows
                if len(head) < DICT_SAMPLES:
                    continue
                rows = head
                out, packer = _open(fs, part, rows)
            flush(rows, packer)
        if count and packer is None:
            out, packer = _open(fs, part, head)
            flush(head, packer)
        if out is not None:
            out.close()
            fs.move(part, posixpath.join(root, name))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "n_records"])

    def _open(fs, path, rows):
        dictionary = _dictionary([r[2][:DICT_SAMPLE_BYTES] for r in rows[:DICT_SAMPLES] if r[2]])
        out = fs.open_output_stream(path)
        if not dictionary:
            return out, zstandard.ZstdCompressor(level=LEVEL)
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        return out, zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))

    return run


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in ``folder`` (a URI shared by all executors).

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the largest key is
    the response.  Returns the manifest (archive, n_records), which is also kept in the folder.
    """
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= min_payload).groupBy("sha").agg(
        F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("times")).where("times > 1").select("sha", "owner")
    # the payloads stay out of this join: only keys and digests are matched
    links = rows.select("page_id", "sha").join(last, "sha").where("page_id <> owner").select(
        "page_id", "sha", F.col("owner").alias("refers_to")).distinct()
    full = rows.join(links, ["page_id", "sha"], "left").select(
        "page_id", "url", "payload", _base32("sha").alias("digest"), "refers_to")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    manifest = f"{folder}/manifest"
    full.mapInArrow(_writer(folder), "archive string, n_records long").write.mode("overwrite").parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def _base32(sha: str):
    """Base-32 of a 40-digit hex string: four groups of ten digits are eight base-32 digits each."""
    group = lambda k: F.lpad(F.conv(F.substring(sha, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[group(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def frames(data: bytes):
    """(offset, bytes) of every record frame's content; the dictionary comes from the leading skippable frame."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("dictionary frame is cut off")
        raw, at = bytes(view[8:8 + size]), 8 + size
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != struct.pack("<I", DICTIONARY):
            raise ValueError("leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while at < len(data):
        if bytes(view[at:at + 4]) != struct.pack("<I", FRAME):
            raise ValueError(f"no frame at {at}")
        one, got, start = reader.decompressobj(), [], at
        while not one.eof:
            if at >= len(data):
                raise ValueError(f"frame at {start} is cut off")
            chunk = view[at:at + 65536]
            got.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield start, b"".join(got)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``error`` names the first check that fails."""
    out = dict.fromkeys(("page_id", "url", "record_type", "payload", "payload_digest", "refers_to"), None)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip() or key.lower() in fields:
            return out | {"error": f"bad header line: {line[:40]}"}
        fields[key.lower()] = value.strip()
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    out |= {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
            "refers_to": number("x-refers-to-page-id"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    size = number("content-length")
    if not sep or lines[0] != VERSION:
        return out | {"error": "no version line or header end"}
    if missing := [k for k in REQUIRED if k not in fields]:
        return out | {"error": f"missing {missing[0]}"}
    if size is None or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return out | {"error": "Content-Length differs from the block"}
    block = rest[:size]
    if fields.get("warc-block-digest") not in (None, f"sha1:{sha1_base32(block)}"):
        return out | {"error": "block digest differs"}
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        return out | {"error": "block is no HTTP response"}
    told = [int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:" and x[15:].strip().isdigit()]
    if out["record_type"] == "response":
        if told != [len(payload)] or out["payload_digest"] != sha1_base32(payload):
            return out | {"error": "payload length or digest differs"}
        out["payload"] = payload
    elif out["record_type"] != "revisit" or payload or "warc-refers-to" not in fields or out["refers_to"] is None:
        return out | {"error": "neither a response nor a revisit of one"}
    return out | {"error": None}


def _read(batches):
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")])
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, archive = [], posixpath.basename(path)
            try:
                for at, raw in frames(data.as_py()):
                    r = parse_record(raw)
                    rows.append(r | {"archive": archive, "offset": at, "valid": r["error"] is None})
                    if len(rows) >= 128:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            except (ValueError, zstandard.ZstdError) as e:
                rows.append(dict.fromkeys(names) | {"archive": archive, "valid": False, "error": str(e)[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``, payloads included (``RECORD_SCHEMA``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "archive-*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(_read, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` without payloads, with ``payload_bytes``; a revisit takes them from the response it names."""
    own = records.select("archive", "offset", "page_id", "url", "record_type", "payload_digest", "refers_to",
                         F.octet_length("payload").cast("long").alias("payload_bytes"), "valid", "error")
    named = own.where("valid and record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_there")).distinct()
    got = own.join(named, ["refers_to", "payload_digest"], "left")
    lost = (F.col("record_type") == "revisit") & F.col("valid") & F.col("_there").isNull()
    return got.select("archive", "offset", "page_id", "url", "record_type", "payload_digest", "refers_to",
                      F.coalesce("payload_bytes", "_there").alias("payload_bytes"), (F.col("valid") & ~lost).alias("valid"),
                      F.when(lost, F.lit("no response with this payload digest")).otherwise(F.col("error")).alias("error"))
