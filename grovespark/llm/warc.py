"""WARC archives: one gzip member per record, written by partition and read back sequentially.

Archives live in a folder that any pyarrow filesystem opens (file, hdfs, s3, gs). Each writing
task makes files of its own under a name no other attempt uses and reports them in a manifest
table; a file that a lost task left behind is in no manifest and so is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, new_folder, staged, table
from grovespark.llm.simhash import sieve, sieved

#: Payloads shorter than this are never written as revisits.
MIN_REVISIT_BYTES = 1000
#: A new file is begun after so many compressed bytes.
ROLL_BYTES = 64 << 20
CHUNK = 1 << 16

MANIFEST = "path string, records long, bytes long"
RECORD = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string"


class WarcError(ValueError):
    """A record that breaks its framing, its lengths or a digest."""


def filesystem(uri: str):
    """The pyarrow filesystem and path of a folder or file named as Spark names it."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1":
        raise WarcError(f"unknown digest {kind}")
    return base64.b32decode(value).hex()


def _line_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, record_type: str, target_uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head alone, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_line_safe(target_uri)}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """Each gzip member of a stream in turn, as an iterator over its decompressed parts."""
    rest = stream.read(chunk)
    while rest:
        state = {"rest": b""}

        def parts(data=rest, state=state):
            z = zlib.decompressobj(31)
            while True:
                while data:
                    out = z.decompress(data, chunk * 4)
                    if out:
                        yield out
                    if z.eof:
                        state["rest"] = z.unused_data
                        return
                    data = z.unconsumed_tail
                data = stream.read(chunk)
                if not data:
                    raise WarcError("a gzip member is cut short")

        got = parts()
        yield got
        for _ in got:
            raise WarcError("data after a record in its gzip member")
        rest = state["rest"] or stream.read(chunk)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _until(parts: Iterator[bytes], got: bytes) -> tuple[bytes, bytes]:
    while (at := got.find(b"\r\n\r\n")) < 0:
        more = next(parts, None)
        if more is None:
            raise WarcError("a head without its end")
        got += more
    return got[:at], got[at + 4 :]


def read_record(parts: Iterator[bytes], with_payload: bool) -> dict:
    """One record out of its member: frames by Content-Length, verifies both digests while reading."""
    head, rest = _until(parts, b"")
    version, warc = _fields(head)
    if not version.startswith("WARC/"):
        raise WarcError(f"not a record: {version[:20]}")
    length = int(warc["content-length"])
    block_hash, payload_hash, payload, seen = hashlib.sha1(), hashlib.sha1(), [], 0
    http: dict[str, str] | None = None
    pending = b""
    while seen < length:
        if not rest:
            rest = next(parts, b"")
            if not rest:
                raise WarcError("a block shorter than its Content-Length")
        data, rest = rest[: length - seen], rest[length - seen :]
        seen += len(data)
        block_hash.update(data)
        if http is None:
            pending += data
            if (at := pending.find(b"\r\n\r\n")) < 0:
                continue
            http, data = _fields(pending[:at])[1], pending[at + 4 :]
        payload_hash.update(data)
        if with_payload:
            payload.append(data)
    for more in parts:
        rest += more
    if rest != b"\r\n\r\n":
        raise WarcError("a record does not end where its Content-Length says")
    if http is None:
        raise WarcError("a block without an HTTP head")
    if block_hash.hexdigest() != _hex(warc["warc-block-digest"]):
        raise WarcError("a block differs from its digest")
    digest, revisit = _hex(warc["warc-payload-digest"]), warc["warc-type"] == "revisit"
    if not revisit and payload_hash.hexdigest() != digest:
        raise WarcError("a payload differs from its digest")
    return {
        "record_id": warc["warc-record-id"].strip("<>"),
        "record_type": warc["warc-type"],
        "target_uri": warc.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "refers_to": warc["warc-refers-to"].strip("<>") if revisit else None,
        "payload": None if revisit or not with_payload else b"".join(payload),
    }


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 6, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write records (record_id, record_type, target_uri, payload, refers_to) and return the manifest.

    A null payload is written as an empty one. The manifest is a table in the shared folder, so the
    archives are written once however often it is read. Other columns of records are ignored.
    """
    bounded_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, k, out, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, n, size = f"{name}-{k:05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                data = gzip_member(record_bytes(row["record_id"], row["record_type"], row["target_uri"], row["payload"] or b"", row["refers_to"], date), level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", n, size))
                    out, k = None, k + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    rows = records.select("record_id", "record_type", "target_uri", "payload", "refers_to")
    return staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives that the manifest lists, each file read from its start by one task.

    With with_payload, a column payload (binary; null for revisits) comes too. Raises on any record
    whose framing, length or digest is wrong.
    """
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], kinds.get(c, pa.string())) for c in names], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for parts in members(stream):
                        got.append(read_record(parts, with_payload))
                        size += len(got[-1]["payload"] or b"")
                        if len(got) >= 2000 or size > (16 << 20):
                            yield flush()
                            got, size = [], 0
        if got:
            yield flush()

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, payload) as records: of equal payloads of min_bytes or more, the largest page_id is the response.

    Keys alone are grouped, by digest with partial maxima, so a payload that a third of the pages
    share costs one row a task. Only payloads of revisits, and few besides, are shuffled, by page_id,
    which spreads evenly: a filter of fixed size tells the others. Rows that repeat the response's page_id are responses as well; rows without page_id always are.
    """
    keyed = pages.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    keys = keyed.where(F.col("size") >= min_bytes).select("page_id", "digest")
    shared = keys.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = staged(keys.join(shared, "digest").where("page_id != keeper").distinct(), "revisits")
    marked = sieved(keyed, "page_id", "digest", sieve(revisits.select(F.col("page_id").alias("doc_id"), F.col("digest").alias("key"))), "met")
    some = marked.where("met").join(revisits, ["page_id", "digest"], "left")
    judged = some.unionByName(marked.where("NOT met").withColumn("keeper", F.lit(None).cast(keys.schema["page_id"].dataType)))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return judged.select(
        urn("page_id").alias("record_id"),
        F.when(F.col("keeper").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload",
        F.when(F.col("keeper").isNotNull(), urn("keeper")).alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read all archives back: a row per page.

    A null html is an empty payload; a null url leaves WARC-Target-URI out; an empty table gives no
    archive and no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    manifest = write_archives(with_revisits(pages), new_folder(spark, "warc"))
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return read_archives(manifest).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url")
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url
  FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to, url
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND p.payload_bytes >= 1000
"""
