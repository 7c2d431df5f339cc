"""WARC archives with a two-level capture index.

Records are gzip members of their own in archive files.  A capture's key is its
URL with the host reversed; captures are dealt by ranges of the key, sorted, and
written as compressed blocks of an index file whose end holds a sparse directory
(first key and place of each block).  A look-up searches the list of index files
by first key, a file's directory, one block, and reads one range of an archive.

Reading everything back goes by the index too: blocks give captures, captures
are sorted by archive and place, and each archive is read forward once.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_CAPTURES = 1024
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
#: Captures this close in an archive are read at once.
READ_BYTES = 8 << 20

CAPTURES = "surt string, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, n long"


def surt(url: str | None) -> str:
    """``com,example,www)/path?query``: host labels reversed, lower-cased; no scheme, user, default port or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url if "://" in url else f"//{url}")
        host, port = u.hostname or "", u.port
    except ValueError:
        return quote(url, safe="/:?&=%,;@+$!*'()~.-_")
    key = ",".join(reversed(host.split(".")))
    if port and (u.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def one_line(text: str | None) -> str:
    """A header's value: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: quote(m[0]), text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, winner: int | None) -> bytes:
    """A response, or where ``winner`` is another page a revisit of it, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = winner is not None and winner != page_id
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}:{digest}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{winner}:{digest}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't that of its digest")
    page = lambda x: None if (p := x.split(":")[2]) == "None" else int(p)
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` and return the captures.

    Of pages with equal payloads of at least ``least_bytes`` the one with the
    largest page_id is a response, the others revisit it (rows that repeat that
    page_id too are responses; a null page_id is below all others).  A null html
    is an empty payload; control characters and blanks of a URL are written
    percent-encoded; other columns are ignored; an empty table writes nothing.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    winners = keys.where(F.octet_length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("sha")).agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    winners = common.materialize(winners.where("n > 1").drop("n"), "warc-winners")
    marked = rows.join(winners, "sha", "left").select("page_id", "url", "payload", "sha", "winner")

    def write(batches):
        from pyspark import TaskContext

        # files bear the attempt's number: rows of a finished attempt name its own files
        attempt, shard, stream = TaskContext.get().taskAttemptId(), 0, None
        for b in batches:
            found = []
            for page, url, payload, sha, winner in zip(*(c.to_pylist() for c in b.columns)):
                if stream is None:
                    name, size = f"{out}/{attempt:012d}-{shard:04d}.warc.gz", 0
                    fs, path = common.open_fs(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    stream, shard = fs.open_output_stream(path, compression=None), shard + 1
                member = record(page, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), winner)
                stream.write(member)
                found.append((surt(url), page, name, size, len(member)))
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["surt", "page_id", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    return common.materialize(marked.mapInArrow(write, CAPTURES), "warc-captures")


def write_index(captures: DataFrame, out: str) -> DataFrame:
    """Write sorted, compressed blocks of captures and return the directory, a row per block."""
    spark = captures.sparkSession

    def write(batches):
        from pyspark import TaskContext

        name = f"{out}/cdx-{TaskContext.get().taskAttemptId():012d}.idx"
        z, held, blocks, at, rows = zstandard.ZstdCompressor(level=3), [], [], 0, []

        def close():
            nonlocal at
            data = z.compress(json.dumps(rows).encode())
            blocks.append(data)
            held.append((rows[0][0], rows[-1][0], name, at, len(data), len(rows)))
            at += len(data)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(row)
                if len(rows) == BLOCK_CAPTURES:
                    close()
                    rows = []
        if rows:
            close()
        if held:
            foot = z.compress(json.dumps([(f, o, n) for f, _, _, o, n, _ in held]).encode())
            common.write_file(name, [*blocks, foot, struct.pack("<I", len(foot)) + b"CDX2"])
            cols = list(zip(*held))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["first_key", "last_key", "file", "offset", "length", "n"])

    dealt = captures.repartitionByRange(common.shuffle_partitions(spark), "surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "offset")
    return common.materialize(dealt.mapInArrow(write, DIRECTORY), "warc-directory")


def _read(name: str, offset: int, length: int) -> bytes:
    fs, path = common.open_fs(name)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


class CaptureIndex:
    """Look-ups by URL; holds only the first and last key of each index file."""

    def __init__(self, directory: DataFrame):
        files = directory.groupBy("file").agg(F.min("first_key"), F.max("last_key")).collect()  # a row per partition of the write
        self.files = sorted((a, b, f) for f, a, b in files)

    def captures(self, url: str) -> list[dict]:
        """All captures of a URL, parsed from their archives."""
        key, out = surt(url), []
        for k in range(bisect.bisect_left([b for _, b, _ in self.files], key), len(self.files)):
            first, _, name = self.files[k]
            if first > key:
                break
            fs, path = common.open_fs(name)
            with fs.open_input_file(path) as f:
                n = f.size()
                size = struct.unpack("<I", f.read_at(8, n - 8)[:4])[0]
                foot = json.loads(zstandard.ZstdDecompressor().decompress(f.read_at(size, n - 8 - size)))
                firsts = [x[0] for x in foot]
                for _, offset, length in foot[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
                    rows = json.loads(zstandard.ZstdDecompressor().decompress(f.read_at(length, offset)))
                    keys = [r[0] for r in rows]
                    out += [parse(_read(*r[2:])) for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        return out


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(directory: DataFrame) -> DataFrame:
    """Every record that the index names, read from the archives."""
    spark = directory.sparkSession

    def unpack(batches):
        for b in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                rows = json.loads(zstandard.ZstdDecompressor().decompress(_read(name, offset, length)))
                cols = list(zip(*(r[2:] for r in rows)))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "offset", "length"])

    def read(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            k, out = 0, []
            while k < len(rows):
                name, lo, n = rows[k]
                e, hi = k + 1, lo + n
                while e < len(rows) and rows[e][0] == name and rows[e][1] <= hi + 65536 and rows[e][1] + rows[e][2] - lo <= READ_BYTES:
                    hi = rows[e][1] + rows[e][2]
                    e += 1
                data = _read(name, lo, hi - lo)
                out += [parse(data[o - lo : o - lo + m]) for _, o, m in rows[k:e]]
                k = e
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, kinds)], names=names)

    n = common.shuffle_partitions(spark)
    places = directory.select("file", "offset", "length").repartition(n).mapInArrow(unpack, "file string, offset long, length long")
    # by place as well as by file, so that a large archive is read by several tasks
    slab = F.floor(F.col("offset") / (32 << 20))
    return places.repartition(n, "file", slab).sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, read back by the index from the archives (see write_archives for nulls, ties and empty tables)."""
    out = common.shared_dir(spark, "warc")
    captures = write_archives(common.read_table(spark, sf_dir, "pages"), out)
    return read_records(write_index(captures, out)).drop("url")


#: DuckDB's sha1 is in hexadecimal digits; base32 takes 8 letters for each 5 bytes.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS winner FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (((('0x' || substr(hex || '0', CAST((i * 5) // 4 + 1 AS BIGINT), 2))::UBIGINT) >> CAST(3 - (i * 5) % 4 AS BIGINT)) & 31) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM w
"""
