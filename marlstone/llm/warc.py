"""WARC archives with a shared dictionary: every record is a Zstandard frame of its own, behind a leading skippable frame that holds the dictionary (the .warc.zst layout).

Archives are written by executors into the shared folder, under a name of the task attempt and renamed when whole, so a lost executor leaves no half archive under a final name. They are read back record by record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, hash_sample, saved, shared_dir, table

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on the first SAMPLE_BYTES characters of about so many records (never twice as many), chosen by a hash of id and payload. It decides the size of the archives, never what they hold.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 600, 16_384, 64_000
LEVEL = 3
ARCHIVE_BYTES = 64 << 20
#: Repeated payloads (40 bytes each) that are sent to every task instead of shuffling the pages; beyond it both sides are shuffled by digest.
BROADCAST_ROWS = 200_000


def record(rid, url, payload: bytes, digest: str, refers) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but names the record it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if rid is None else rid}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({13: '%0D', 10: '%0A'})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), payload and the length that the HTTP head gives."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end as its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    n = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    return {"fields": fields, "payload": payload, "n": n}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; too few of them to train on serve as raw content."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 4), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with its scheme, as Spark resolves it: a path without one is in the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def uri(path: str) -> str:
    """A path as Arrow names it: file:/a is file:///a, and s3a and s3n are s3."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest


def _file_system(path: str):
    from pyarrow import fs

    path = uri(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages into archives below folder; returns (path, records), one row per archive.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of at least min_bytes bytes those with the smallest page_id are responses, the others revisits of it; shorter payloads are responses. A null page_id is never referred to: such rows are revisits if a row with an id has their payload, else responses. Extra columns are not archived. No rows: no archives.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    # One pass over the payloads gives what all else is decided by.
    narrow = saved(own.select("page_id", digest.alias("digest"), F.octet_length("html").alias("bytes")), "op5-digests")
    first = narrow.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only rows of repeated payloads need the other side: lone payloads, the bulk, bring nothing to this join. Written, so that a hot payload's partition can be split.
    first = saved(first.where("n > 1").drop("n"), "op5-first", narrow=True)
    heads = hash_sample(own, ["page_id", "html"], SAMPLE_RECORDS, narrow.count()).select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).orderBy("page_id", "url", "html").collect()
    dictionary = train_dictionary([record(0, r["url"], r["html"].encode("utf-8", "surrogatepass"), "", None) for r in heads])
    shared = spark.sparkContext.broadcast(dictionary)
    base = qualified(spark, folder.rstrip("/"))

    def write(batches):
        raw = shared.value
        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
        task = TaskContext.get()
        fs, root = _file_system(base)
        fs.create_dir(root, recursive=True)
        out, n, size, number, done = None, 0, 0, 0, []

        def close():
            out.close()
            final = f"{root}/part-{task.partitionId():06d}-{number:04d}.warc.zst"
            fs.move(f"{root}/.attempt-{task.taskAttemptId()}-{number}", final)
            done.append((f"{base}/{final[len(root) + 1 :]}", n))

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    out = fs.open_output_stream(f"{root}/.attempt-{task.taskAttemptId()}-{number}", compression=None)
                    size = out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw) or 0
                payload = r.html.encode("utf-8", "surrogatepass")
                refers = None if r.first is None or r.page_id == r.first else r.first
                frame = comp.compress(record(r.page_id, r.url, payload, sha1_base32(payload), refers))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
                    out, n, size, number = None, 0, 0, number + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records"])

    linked = own.withColumn("digest", digest).join(broadcast_below(first, BROADCAST_ROWS), "digest", "left")
    return saved(linked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first").cast("string").alias("first")).mapInPandas(write, "path string, records long"), "op5-archives")


def records(path: str, chunk: int = 1 << 20):
    """The uncompressed records of an archive, one at a time: the leading skippable frame gives the dictionary, then each frame is a record."""
    fs, p = _file_system(path)
    with fs.open_input_stream(p, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError("the archive doesn't begin with its dictionary")
        raw = f.read(n)
        if raw[:4] == ZSTD_MAGIC:  # others may compress the dictionary itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        rest, parts, d = b"", [], reader.decompressobj()
        while True:
            data = rest or f.read(chunk)
            rest = b""
            if not data:
                break
            parts.append(d.decompress(data))
            if d.eof:
                yield b"".join(parts)
                rest, parts, d = d.unused_data, [], reader.decompressobj()
        if any(parts):
            raise ValueError("the archive ends within a record")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in archives (path); a response's payload is held against its digest."""

    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                for raw in records(path):
                    r = parse(raw)
                    f = r["fields"]
                    kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(r["payload"]) != r["n"] or sha1_base32(r["payload"]) != digest):
                        raise ValueError(f"{path}: the payload of {f['warc-record-id']} is damaged")
                    rid = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v != "<urn:x-page:>" else None
                    rows.append((rid(f["warc-record-id"]), f["warc-target-uri"], r["n"], digest, kind, rid(f.get("warc-refers-to"))))
                    if len(rows) == 20_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    n = archives.count()
    return archives.select("path").repartition(max(1, min(n, 4096))).mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark).rstrip('/')}/op5-warc-{uuid.uuid4().hex}")
    return read_archives(archives).drop("url")


SQL = {
    "op5_warc_round_trip": """with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first from p),
bits as (select *, list_reduce(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), lambda a, b: a || b) as b from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(5), lambda j: (substr(b, (i * 5 + j + 1)::int, 1)::int) * (2 ** (4 - j))::int)) + 1)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from bits"""
}
