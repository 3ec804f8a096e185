"""WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file with stored members: archive/data.warc.gz, whose records are gzip members of
their own, and indexes/index.cdxj, a line with offset and length for each record. The reader parses the
end record, the ZIP64 records and the central directory, finds where the members' bytes lie, reads the index and
then the records by range. Archives lie in the shared folder.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A new archive is begun beyond so many bytes or records, so indexes fit in memory.
ROLL_BYTES, ROLL_RECORDS = 512 << 20, 200_000
#: Records next to each other are read at once up to so many bytes.
RANGE_BYTES = 4 << 20
LEAST_SHARED = 100
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"


def file_system(uri: str):
    """pyarrow's file system for a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit has the HTTP head of its response, so its length is told, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}, payload


class Archive:
    """Writes one archive to a stream that need not seek."""

    def __init__(self, stream):
        self.stream, self.zip = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        packed = gzip.compress(record(page_id, url, payload, digest, refers_to), compresslevel=1, mtime=0)
        self.data.write(packed)
        self.lines.append(json.dumps({"url": url, "offset": self.at, "length": len(packed), "digest": f"sha256:{digest}", "filename": DATA}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()
        self.stream.close()


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: place of the local header, stored size and method. read(offset, length)
    gives bytes; only the end of the file and the central directory are read."""
    at = max(0, size - 65_557)
    tail = read(at, size - at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = tail[end - 20 : end] if end >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<3Q", record64[32:56])
    data, at, out = read(start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack("<2H", data[at + 8 : at + 12])
        packed, full = struct.unpack("<2I", data[at + 20 : at + 28])
        name_n, extra_n, comment_n = struct.unpack("<3H", data[at + 28 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = data[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack("<2H", extra[x : x + 4])
            if kind == 1:  # 64-bit values, of those fields only that are full
                values = iter(struct.unpack(f"<{n // 8}Q", extra[x + 4 : x + 4 + n // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            x += 4 + n
        out[name] = (header, packed, method)
        at += 46 + name_n + extra_n + comment_n
    return out


def member(read, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Place and size of a stored member's bytes."""
    header, size, method = entry
    if method:
        raise ValueError("the member isn't stored")
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return header + 30 + sum(struct.unpack("<2H", local[26:30])), size


def ranges(path: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Runs of neighbouring records of an archive: its path, their offsets in the file and lengths."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        read = lambda offset, length: f.read_at(length, offset)
        members = directory(read, f.size())
        start, _ = member(read, members[DATA])
        place, size = member(read, members[INDEX])
        offsets, lengths = [], []
        for line in read(place, size).decode().split("\n"):
            if line:
                x = json.loads(line)
                if offsets and (start + x["offset"] + x["length"] - offsets[0] > RANGE_BYTES or start + x["offset"] != offsets[-1] + lengths[-1]):
                    yield path, offsets, lengths
                    offsets, lengths = [], []
                offsets.append(start + x["offset"])
                lengths.append(x["length"])
        if offsets:
            yield path, offsets, lengths


def read_records(path: str, offsets: list[int], lengths: list[int]) -> Iterator[tuple]:
    """page_id text, payload length, payload digest, type, refers_to text, payload of each record."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        data = f.read_at(offsets[-1] + lengths[-1] - offsets[0], offsets[0])
    for offset, length in zip(offsets, lengths):
        fields, http, payload = parsed(zlib.decompress(data[offset - offsets[0] :][:length], 31))
        kind = fields["warc-type"]
        told = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(payload).hexdigest() != told:
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
        strip = lambda x: x.strip("<>").removeprefix(RECORD_ID) or None
        yield strip(fields["warc-record-id"]), len(payload) if kind == "response" else int(http["content-length"]), told, kind, strip(fields.get("warc-refers-to", "")), payload if kind == "response" else None


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages and returns the archives: path, records.

    Of rows with equal payloads of at least LEAST_SHARED bytes, that with the least id is written whole and the
    others revisit it. Null payloads count as empty, null ids are kept as such and are never referred to.
    Only digests are grouped: a payload that a third of the rows share is summed before the shuffle, and payloads
    themselves are dealt out by row, not by digest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    own = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("html"))
    slim = written(own.select("id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")), "digests").where(f"n >= {LEAST_SHARED}")
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")
    revisits = slim.join(first, "digest").where("id is null or id != first").select("id", "digest", "first").distinct()
    revisits = written(revisits, "revisits")
    # a page's id deals it out; the digest tells repeated ids apart
    dealt = own.withColumn("digest", F.sha2("html", 256)).alias("p").join(revisits.alias("r"), F.expr("p.id <=> r.id and p.digest = r.digest"), "left").select("p.id", "p.url", "p.html", "p.digest", "r.first")
    folder = fresh_path(spark, "archives")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        done, archive, path = [], None, ""
        for batch in batches:
            for i, u, h, d, r in batch[["id", "url", "html", "digest", "first"]].itertuples(index=False, name=None):
                if archive is None:
                    # a name of its own for each attempt; only attempts that end well are told of
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    archive = Archive(fs.open_output_stream(f"{at}/{path.rpartition('/')[2]}"))
                archive.add(i, u, h.encode("utf-8"), d, r)
                if archive.at >= ROLL_BYTES or len(archive.lines) >= ROLL_RECORDS:
                    archive.close()
                    done.append((path, len(archive.lines)))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((path, len(archive.lines)))
        yield pd.DataFrame(done, columns=["path", "records"])

    texts = dealt.select(F.col("id").cast("string"), "url", "html", "digest", F.col("first").cast("string"))
    return written(texts.mapInPandas(pack, "path string, records long"), "archive-list")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives: page_id string, payload_bytes, payload_digest, record_type, refers_to
    string and (if asked) payload, which revisits do not have."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(list(ranges(path)), columns=["path", "offsets", "lengths"])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, offsets, lengths in batch.itertuples(index=False, name=None):
                yield pd.DataFrame([x[: len(names)] for x in read_records(path, list(offsets), list(lengths))], columns=names)

    n = max(2, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = archives.select("path").repartition(n).mapInPandas(locate, "path string, offsets array<long>, lengths array<long>")
    return runs.repartition(n).mapInPandas(fetch, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads)


def op7(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as the archives give them back. A null or empty page is a response
    without payload; rows with repeated or null ids have a record each; of equal payloads the least id is the response, and very long ones are read back
    in ranges, whole. An empty table gives an empty result."""
    kind = pages.schema["page_id"].dataType
    out = read_archives(write_archives(pages), payloads=False)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


#: DuckDB's SQL for op7.
ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_SHARED} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
