"""WARC archives with a two-level capture index.

Archives: a gzip member for each record, one file for each writing task (more beyond a size). A
payload that other captures share is stored once, as response; the others are revisit records.

Index: captures sorted by reversed-host URL key (``com,example,www)/path?query``) and page id, in
compressed blocks of lines. Each index file ends in its own sparse directory, the first key of
each block; a table of the index files with their first keys stands above those. A lookup
bisects the file table, one directory and one block, then reads a byte range of an archive.

Tasks write under names of their own and report what they wrote as rows; those rows, committed as
a table, are the archive. A task that is lost and run again leaves a file nobody refers to, which
is removed afterwards. All files lie in the shared folder, through Arrow's file systems.

The payload crosses the network at most once, to meet the page that keeps its content. Batch
lookups are sorted by key, so that a task opens each block once, and the ranges found are sorted
by archive and offset, so that archives are read forwards. Neither deals rows out by a key alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import Workspace, ascii_lower, filesystem, partitions, table

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
BLOCK_LINES = 1000
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 22
MAGIC = b"CAPINDEX"
EPOCH = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed-host key of a url: labels from the top domain down, joined by commas, a bracket, then path and query. Without ``://`` all of it counts as path; null gives an empty key."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)).otherwise(url)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest), F.lit(""))


def _record(page_id, url, payload: bytes, digest: str, target) -> bytes:
    """One WARC record as a gzip member; target: the page id a revisit refers to, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if target is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if target is not None:
        head += [f"WARC-Refers-To: <urn:page:{target}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + gz.flush()


def parse_record(raw: bytes) -> dict:
    """Headers of a record (lower-cased names), with its payload (b"" for a revisit) and payload_bytes, checked against its digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    out = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    body = rest[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    out["payload"] = payload
    out["payload_bytes"] = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    if out["warc-type"] == "response" and (len(payload) != out["payload_bytes"] or f"sha1:{hashlib.sha1(payload).hexdigest()}" != out["warc-payload-digest"]):
        raise ValueError(f"payload of {out['warc-record-id']} does not fit its digest")
    return out


def _page(urn: str):
    """The page id in <urn:page:ID>."""
    v = urn[len("<urn:page:") : -1]
    return None if v == "None" else int(v)


class Archive:
    """captures: a row for each record (key, page_id, file, offset, length). shards: a row for each index file with its first key."""

    def __init__(self, ws: Workspace, captures: DataFrame, shards: DataFrame):
        self.ws, self.captures, self.shards = ws, captures, shards


def _new_file(folder: str, end: str):
    """A fresh file of this task in a folder: its URI, and an open stream."""
    uri = f"{folder}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{end}"
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, fs.open_output_stream(path, compression=None)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Write a record for each row of pages, and the index.

    The payload is the html in UTF-8, a null one is empty. Of records with equal payloads of
    LEAST_REVISIT bytes or more, the one with the largest page id is the response (each, if repeated rows
    have that id; all, if all their ids are null), the others are revisits of it. A null or odd url
    still has a key, see url_key. Other columns are not stored. No rows give no files.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    n = partitions(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), url_key(F.col(url_col)).alias("key"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1 and target is not null").drop("copies")
    shared = ws.table(shared, "shared")
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "key", "payload", "digest", F.expr("if(page_id <=> target, null, target)").alias("target"))
    folder = f"{ws.root}/archives"

    def write(batches):
        uri = out = None
        at = 0
        for b in batches:
            place = []
            for page_id, url, payload, digest, target in zip(*(b[c] for c in ("page_id", "url", "payload", "digest", "target"))):
                if out is None:
                    uri, out = _new_file(folder, ".warc.gz")
                    at = 0
                raw = _record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), target.as_py())
                out.write(raw)
                place.append((uri, at, len(raw)))
                at += len(raw)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if place:
                files, offsets, lengths = zip(*place)
                yield pa.RecordBatch.from_arrays([b["key"], b["page_id"], pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = ws.table(rows.mapInArrow(write, "key string, page_id bigint, file string, offset bigint, length bigint"), "captures")
    _remove_others(folder, captures, "file")
    return Archive(ws, captures, _build_index(ws, captures, n))


def _remove_others(folder: str, rows: DataFrame, column: str) -> None:
    """Remove the files of lost task attempts: those in the folder that no row names. As many names as files."""
    from pyarrow.fs import FileSelector

    fs, path = filesystem(folder)
    wanted = {r[0].rsplit("/", 1)[1] for r in rows.select(column).distinct().collect()}
    for f in fs.get_file_info(FileSelector(path, allow_not_found=True)):
        if f.base_name not in wanted:
            fs.delete_file(f.path)


def _sort_key(key: str, page_id) -> tuple:
    """Order of the index, as Spark sorts (UTF-8 bytes, null ids first)."""
    return key.encode(), page_id is not None, page_id or 0


def _build_index(ws: Workspace, captures: DataFrame, n: int) -> DataFrame:
    folder = f"{ws.root}/index"

    def build(batches):
        out, at, lines, directory, first = None, 0, [], [], None

        def flush():
            nonlocal at, lines
            raw = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([*json.loads(lines[0])[:2], at, len(raw)])
            out.write(raw)
            at += len(raw)
            lines = []

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                if out is None:
                    uri, out = _new_file(folder, ".idx")
                    first = row[:2]
                lines.append(json.dumps(row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw + struct.pack("<qq", at, len(raw)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([uri])], names=["first_key", "first_page", "file"])

    in_order = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    shards = ws.table(in_order.mapInArrow(build, "first_key string, first_page bigint, file string"), "shards")
    _remove_others(folder, shards, "file")
    return shards


class _Index:
    """Reads index files: one directory and one block are held at a time."""

    def __init__(self, shards: list[tuple]):
        self.shards = shards  # (sort key, file), sorted
        self.firsts = [s[0] for s in shards]
        self.open = (None, None, None, None)
        self.block = (None, None, None)

    @staticmethod
    def _span(firsts: list, key) -> range:
        """Places that can hold the key: from the one it would start in to the last that starts with it or before."""
        return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))

    def find(self, key: tuple):
        """file, offset, length of each capture under the key."""
        for i in self._span(self.firsts, key):
            if self.open[0] != i:
                fs, path = filesystem(self.shards[i][1])
                f = fs.open_input_file(path)
                at, length = struct.unpack("<qq", f.read_at(24, f.size() - 24)[:16])
                directory = json.loads(zlib.decompress(f.read_at(length, at)))
                self.open = (i, f, directory, [_sort_key(d[0], d[1]) for d in directory])
            _, f, directory, firsts = self.open
            for k in self._span(firsts, key):
                if self.block[0] != (i, k):
                    rows = [json.loads(line) for line in zlib.decompress(f.read_at(directory[k][3], directory[k][2])).decode().split("\n")]
                    self.block = ((i, k), rows, [_sort_key(r[0], r[1]) for r in rows])
                _, rows, keys = self.block
                for r in rows[bisect_left(keys, key) : bisect_right(keys, key)]:
                    yield r[2:]


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """Captures of the (key, page_id) pairs in wanted, each pair once: file, offset, length.

    The file table that each task holds has one row for each index file.
    """
    spark = wanted.sparkSession
    shards = sorted((_sort_key(r.first_key, r.first_page), r.file) for r in archive.shards.collect())

    def find(batches):
        index, last = _Index(shards), None
        for b in batches:
            hits = []
            for key, page_id in zip(b["key"].to_pylist(), b["page_id"].to_pylist()):
                k = _sort_key(key, page_id)
                if k != last:
                    hits += index.find(k)
                last = k
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64())], names=["file", "offset", "length"])

    n = partitions(spark)
    in_order = wanted.select("key", F.col("page_id").cast("bigint").alias("page_id")).repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return archive.ws.table(in_order.mapInArrow(find, "file string, offset bigint, length bigint"), "hits")


def read_records(hits: DataFrame, payloads: bool = False) -> DataFrame:
    """The records at (file, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def read(batches):
        name, f, start, buffer = None, None, 0, b""
        for b in batches:
            out = []
            for file, offset, length in zip(*(b[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    fs, path = filesystem(file)
                    name, f, start, buffer = file, fs.open_input_file(path), 0, b""
                if not start <= offset <= offset + length <= start + len(buffer):
                    start, buffer = offset, f.read_at(max(length, READ_BYTES), offset)
                r = parse_record(buffer[offset - start : offset - start + length])
                out.append((_page(r["warc-record-id"]), r["payload_bytes"], r["warc-payload-digest"][len("sha1:") :], r["warc-type"], _page(r["warc-refers-to"]) if "warc-refers-to" in r else None, r["payload"])[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out else [pa.array([], t.type) for t in schema], schema=schema)

    n = partitions(hits.sparkSession)
    in_order = hits.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return in_order.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads)


def op1_warc_index(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    archive = write_archive(pages)
    return read_records(lookup(archive, pages.select(url_key(F.col("url")).alias("key"), "page_id")))


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (
  SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target <> coalesce(page_id, target - 1) THEN target END AS refers_to
FROM p LEFT JOIN t USING (payload_digest)
"""
