"""Operator 13, WARC archives with a two-level capture index.

Writing. Every page becomes one record, a gzip member of its own, in archive files that the tasks write side by side
where the pages lie (a file is closed at ``FILE_BYTES``). Of pages with equal payloads (equal SHA-256) one is written
in full as a ``response`` and the others as ``revisit`` records that name it. Pages are not shuffled for that: only
(page_id, url, hash) rows are, and the groups that repeat come back by a join on the hash.

Index. A capture's key is its reversed-host URL (``com,example,www)/path``) with its page_id. The keys are range-sorted
over all files (a URL with very many captures spans several ranges) and packed into compressed blocks of
``BLOCK_LINES`` lines. The first key of every block, with the block's place, is the sparse directory; it
closes the index file it describes, so it grows with that file and not with the corpus. Only one row for an index file, its
first key, reaches the driver.

Reading. ``lookup`` routes keys to index files by binary search over those first keys, binary-searches the directory
for the block, reads that byte range, and binary-searches the block. ``read_captures`` reads the records' byte ranges,
file by file in the order of their places, and checks each payload against its digest.

Archives and index files go through ``pyarrow.fs`` to the folder the caller names (the operator's query: a folder under
``spark.checkpoint.dir``), so any store that it opens by URI will do. A task that is run again writes files of a new
name; only the files that the completed tasks reported are ever read.

Defined results: a null html is an empty payload (0 bytes), and payloads of 0 bytes are equal like any others; a null
page_id is smallest; of rows that repeat page_id, url and html one is the response; a response whose page_id is null is
named by a null refers_to. A null url has the empty key. Other columns are ignored. An empty table writes no files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import checkpoint, if_small, prepare, read
from tablescope.session import checkpoint_folder

FILE_BYTES = 64 << 20   # an archive file is closed once it holds so many bytes
BLOCK_LINES = 2000      # captures of a compressed index block
LEAST_REVISIT = 0       # payloads of at least so many bytes are written once
DATE = "1970-01-01T00:00:00Z"  # WARC-Date of every record: the pages carry no capture time
# Fixed value: the profile's name in the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)"


def reversed_host_key(url: Column) -> Column:
    """``http://www.Example.com:8080/a?b#c`` → ``com,example,www:8080)/a?b``; a null url has the empty key."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(F.substring(part(3), 1, 1) == "/", part(3)).otherwise(F.concat(F.lit("/"), part(3)))
    return F.coalesce(F.concat(host, port, F.lit(")"), path), F.lit(""))


def _open(uri: str):
    """(file system, path) of a folder; Hadoop writes local folders as ``file:/folder``."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


# ---- records -------------------------------------------------------------------------------------------------------

def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id, url, key: bytes, nth: int = 0) -> str:
    h = hashlib.md5(json.dumps([page_id, url, key.hex(), nth]).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h, version=4)}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id, url, payload: bytes, key: bytes, nth: int, refers: tuple | None, date: str = DATE) -> bytes:
    """One record; ``refers`` is the (page_id, url) of the response that a revisit names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, url, key, nth)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    fields += [("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("Content-Type", "application/http;msgtype=response"),
               ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers, key))]
        if refers[0] is not None:
            fields.append(("X-Refers-To-Page", str(refers[0])))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record. The digest of a response is computed
    from the payload read, and must be the one its header states."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {first!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload), payload_digest(payload)) != (size, stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": number("X-Refers-To-Page")}


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _rows(batch: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in batch.columns))


# ---- writing -------------------------------------------------------------------------------------------------------

ENTRY = "surt string, page_id long, file string, at long, size long"
_ENTRY = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """(surt, page_id, url, payload, key, nth, revisit, r_page, r_url) for every row of ``pages``."""
    url, payload = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("key"))
    rows = checkpoint(full.where(F.octet_length("payload") >= least).drop("payload"))
    groups = checkpoint(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("best"))
                        .where("n > 1").select("key", F.col("best.page_id").alias("r_page"), F.col("best.url").alias("r_url")))
    groups = if_small(groups, 256)
    first = F.col("page_id").eqNullSafe(F.col("r_page")) & F.col("url").eqNullSafe(F.col("r_url"))
    twins = checkpoint(rows.join(groups, "key").where(first).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.lit(True).alias("twin")))
    out = full.join(groups.withColumn("repeated", F.lit(True)), "key", "left")
    # A payload below ``least`` bytes is never in a group of its own length, so the join on the hash leaves it alone.
    out = out.withColumn("revisit", F.col("repeated").isNotNull() & ~first)
    cols = [reversed_host_key(F.col("url")).alias("surt"), "page_id", "url", "payload", "key", "nth", "revisit", "r_page", "r_url"]
    if twins.isEmpty():
        return out.withColumn("nth", F.lit(0)).select(*cols)
    # Rows that repeat the response row by row: one of them stays the response.
    out = out.join(if_small(twins, 64), "key", "left")
    same = F.coalesce(F.col("twin"), F.lit(False)) & ~F.col("revisit")
    again = (out.where(same).groupBy("key", "page_id", "url", "payload", "r_page", "r_url").agg(F.count(F.lit(1)).alias("c"))
             .withColumn("nth", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int")))).withColumn("revisit", F.col("nth") > 0))
    return out.where(~same).withColumn("nth", F.lit(0)).select(*cols).unionByName(again.select(*cols))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT, date: str = DATE) -> DataFrame:
    """Write one record per row of ``pages`` under ``folder``; (surt, page_id, file, at, size) of each, as a written table."""
    prepare(pages.sparkSession)

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        store, path = _open(folder)
        out, name, at, files = None, "", 0, 0
        for batch in batches:
            entries = []
            for surt, page_id, url, payload, key, nth, revisit, r_page, r_url in _rows(batch):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(path, recursive=True)
                    name, at = f"{stem}-{files}.warc.gz", 0
                    files += 1
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    info = b"software: tablescope\r\nformat: WARC File Format 1.1\r\n"
                    head = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name, b'')}\r\nWARC-Date: {date}\r\n"
                                   f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    out.write(head)
                    at += len(head)
                data = _member(warc_record(page_id, url, payload, key, nth, (r_page, r_url) if revisit else None, date))
                out.write(data)
                entries.append((surt, page_id, name, at, len(data)))
                at += len(data)
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*entries), _ENTRY)], schema=_ENTRY)
        if out is not None:
            out.close()

    return checkpoint(_roles(pages, least).mapInArrow(write, ENTRY))


# ---- index ---------------------------------------------------------------------------------------------------------

def _order(surt: str, page_id) -> tuple:
    """Keys in the order Spark sorts them: bytes of the URL key, null page_id first."""
    return (surt.encode(), page_id is not None, page_id or 0)


def build_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Pack sorted ``entries`` into index files under ``folder``; (file, directory_at, surt, page_id) of each, as a written
    table: where its directory begins, and its first key."""
    prepare(entries.sparkSession)

    def pack(batches):
        store, path = _open(folder)
        name, out, at, directory, block = f"index-{uuid.uuid4().hex}.cdx", None, 0, [], []

        def close_block():
            nonlocal at
            data = zlib.compress(json.dumps(block).encode())
            directory.append((*block[0][:2], at, len(data)))
            out.write(data)
            at += len(data)
            block.clear()

        for batch in batches:
            for row in _rows(batch):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                block.append(row)
                if len(block) == block_lines:
                    close_block()
        if out is not None:
            if block:
                close_block()
            out.write(zlib.compress(json.dumps(directory).encode()))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "directory_at": [at], "surt": [directory[0][0]], "page_id": pa.array([directory[0][1]], pa.int64())})

    keys = ["surt", "page_id", "file", "at"]
    ordered = entries.select(*keys, "size").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return checkpoint(ordered.mapInArrow(pack, "file string, directory_at long, surt string, page_id long"))


class IndexFile:
    """One index file: its directory in memory, one block at a time read by its byte range."""

    def __init__(self, store, path: str, directory_at: int):
        self.file = store.open_input_file(path)
        self.file.seek(directory_at)
        self.directory = json.loads(zlib.decompress(self.file.read()))
        self.firsts = [_order(*d[:2]) for d in self.directory]
        self.at, self.keys, self.block = -1, [], []

    def _load(self, k: int) -> None:
        if k != self.at:
            _, _, at, size = self.directory[k]
            self.file.seek(at)
            self.block = json.loads(zlib.decompress(self.file.read(size)))
            self.at, self.keys = k, [_order(*line[:2]) for line in self.block]

    def find(self, low: tuple, high: tuple):
        """Lines whose key lies in [low, high]."""
        k = max(0, bisect_left(self.firsts, low) - 1)
        while k < len(self.firsts) and self.firsts[k] <= high:
            self._load(k)
            yield from self.block[bisect_left(self.keys, low): bisect_right(self.keys, high)]
            k += 1


_ANY = (b"", False, -(1 << 63)), (b"", True, 1 << 63)


def lookup(queries: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(surt, page_id, file, at, size) of the captures that match ``queries``: with columns surt and page_id the captures
    of that URL and page, with surt alone every capture of the URL. Repeated queries count once."""
    prepare(queries.sparkSession)
    paged = "page_id" in queries.columns
    files = sorted(((_order(r["surt"], r["page_id"]), r["file"], r["directory_at"]) for r in index.collect()))  # a row for each index file
    firsts = [f[0] for f in files]
    asked = queries.select("surt", *(["page_id"] if paged else [F.lit(None).cast("long").alias("page_id")])).where("surt IS NOT NULL").distinct()

    def bounds(surt, page_id):
        if paged:
            return _order(surt, page_id), _order(surt, page_id)
        return (surt.encode(), *_ANY[0][1:]), (surt.encode(), *_ANY[1][1:])

    def route(batches):
        for batch in batches:
            out = []
            for surt, page_id in _rows(batch):
                low, high = bounds(surt, page_id)
                out += [(k, surt, page_id) for k in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high))]
            if out:
                k, s, p = zip(*out)
                yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "surt": pa.array(s, pa.string()), "page_id": pa.array(p, pa.int64())})

    def search(batches):
        store, path = _open(folder)
        opened, current = None, None
        for batch in batches:
            found = []
            for k, surt, page_id in _rows(batch):
                if k != current:
                    opened, current = IndexFile(store, f"{path}/{files[k][1]}", files[k][2]), k
                found += opened.find(*bounds(surt, page_id))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _ENTRY)], schema=_ENTRY)

    routed = asked.mapInArrow(route, "k int, surt string, page_id long")
    return routed.repartition("k").sortWithinPartitions("k", "surt", "page_id").mapInArrow(search, ENTRY)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_captures(places: DataFrame, folder: str) -> DataFrame:
    """Read the records at ``places`` (file, at, size), a written table, and parse them; one row per place."""
    prepare(places.sparkSession)

    def fetch(batches):
        store, path = _open(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for where, at, size in _rows(batch):
                if where != name:
                    name, file = where, store.open_input_file(f"{path}/{where}")
                file.seek(at)
                out.append(parse_record(zlib.decompress(file.read(size), 31)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD)

    # Places are small rows of much work: as many tasks as the archives hold files, which no coalescing of small shuffles reduces.
    total = places.agg(F.sum("size")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    return places.select("file", "at", "size").repartition(tasks, "file").sortWithinPartitions("file", "at").mapInArrow(fetch, RECORD)


def archive_and_read(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write ``pages`` as archives, index them, and read every page's capture back through the index."""
    entries = write_archives(pages, f"{folder}/archive", **options)
    index = build_index(entries, f"{folder}/index")
    asked = pages.select(reversed_host_key(F.col("url").cast("string")).alias("surt"), F.col("page_id").cast("long").alias("page_id"))
    return read_captures(checkpoint(lookup(asked, index, f"{folder}/index")), f"{folder}/archive")


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read(spark, sf_dir, "pages"), checkpoint_folder(spark, "warc"))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS r FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to
FROM d
"""
