"""WARC archives and a two-level capture index.

Writing: of pages with equal payloads of DEDUP_BYTES or more, the one with the largest id is a response and the
others are revisits of it; which, is known from digests alone, before any payload moves. Each task writes gzip
members, one a record, to files of its own in the shared folder; a written table names the files of the tasks that
ended well, so what a lost executor left behind is never read.

Index: a scan of the files, each by one task, gives every record's key (host reversed, then path), file, offset and
length, as a written table. Sorted by key in range partitions, these lines are cut into blocks of LINES lines; each block
is compressed, and a partition's blocks are one file. A sparse directory has a row for each block: its keys, and where it
lies. A lookup finds the range partitions of a key by binary search over the partitions' first and last keys, its blocks by
binary search over the partition's directory rows, reads these blocks alone by range, and finds the lines by binary
search again. Records are read by range as well, in slices of SLICE bytes of a file.

Files are reached through pyarrow's file systems, by the shared folder's URI. Defined results: a null payload is
empty; a null URL has the empty key; a null id is smaller than any other, and a revisit is never the largest; rows
with the same id and payload are all responses, or all revisits; refers_to is null for responses; a revisit tells the
digest and the length of the payload that it stands for itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, materialize, ship, table

DEDUP_BYTES = 1000
ROLL_BYTES = 64 << 20
LINES = 1000
#: Lines that a range partition of the index holds, about; few partitions are cut finer, for as many tasks as cores.
PART_LINES = 200_000
#: Bytes of an archive that one task reads records from, about.
SLICE = 8 << 20
LEVEL = 4
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "key string, url string, page_id long, record_type string, refers_to long, file string, at long, length long"
_COLUMNS = ("key", "url", "page_id", "record_type", "refers_to", "file", "at", "length")


def one_line(url: str) -> str:
    """As a header holds it: a line break in a URL would end the header."""
    return url.replace("\r", "%0D").replace("\n", "%0A").strip()


def url_key(url: str | None) -> str:
    """Host reversed and lower-cased, port unless usual, then path and query; no scheme and no fragment."""
    url = one_line(url or "")
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    at = "" if port in (None, 80, 443) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + at + ")" + (parts.path or "/") + query


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    sha1 = hashlib.sha1(payload)
    digest = base64.b32encode(sha1.digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha1.hexdigest())}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Uri: true")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1.hexdigest())}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Truncated: length"]
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + gz.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record's bytes, decompressed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC record of another length")
    return fields, rest[:n]


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, payload_sha256, refers_to of pages that another page with an equal payload stands for."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.where(F.octet_length(payload) >= DEDUP_BYTES).select("page_id", F.sha2(payload, 256).alias("payload_sha256")).distinct()
    first = keys.groupBy("payload_sha256").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(first, "payload_sha256").where("page_id is null or page_id < refers_to")


def write(spark: SparkSession, pages: DataFrame) -> tuple[str, DataFrame]:
    """Folder of the archives, and the table (file, records, bytes) of its files."""
    ship(spark)
    folder = fresh_path(spark, "warc")
    others = revisits(pages).toDF("sha_", "id_", "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha"))
    rows = rows.join(others, F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.col("sha_").isNotNull().alias("revisit"))
    schema, roll = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]), ROLL_BYTES

    def run(batches):
        from pyspark import TaskContext

        fs, path = _open(folder)
        context = TaskContext.get()
        out, done, held = None, [], [0, 0]
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                        if out is None:
                            fs.create_dir(path, recursive=True)
                            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                            out, held = fs.open_output_stream(f"{path}/{name}", compression=None), [0, 0]
                        data = record(page_id, url, html.encode(), refers_to, revisit)
                        out.write(data)
                        held = [held[0] + 1, held[1] + len(data)]
                        if held[1] >= roll:
                            out.close()
                            done.append((name, *held))
                            out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, *held))
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)), schema=schema)

    return folder, materialize(spark, rows.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def _schema() -> pa.Schema:
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "at": pa.int64(), "length": pa.int64()}
    return pa.schema([(c, kinds.get(c, pa.string())) for c in _COLUMNS])


def scan(files: DataFrame, folder: str) -> DataFrame:
    """An index line for each record of the files, read from front to end."""
    schema = _schema()

    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    at, rest, more = 0, b"", True
                    while more or rest:
                        gz, data, used = zlib.decompressobj(31), [], 0
                        while not gz.eof:
                            if not rest:
                                rest = f.read(1 << 20)
                                more = bool(rest)
                                if not rest:
                                    break
                            data.append(gz.decompress(rest))
                            used += len(rest) - len(gz.unused_data)
                            rest = gz.unused_data
                        if not used:
                            break
                        fields, _ = parse(b"".join(data))
                        url = None if "x-no-uri" in fields else fields["warc-target-uri"]
                        page_id, refers_to = (int(v) if (v := fields.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id"))
                        rows.append((url_key(url), url, page_id, fields["warc-type"], refers_to, name, at, used))
                        at += used
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    # A file is read by one task; ROLL_BYTES bounds it. With a number, files aren't folded into fewer tasks for being few rows.
    return files.repartition(max(1, files.count()), "file").select("file").mapInArrow(run, _ENTRY)


_BLOCK = "part int, block int, first_key string, last_key string, file string, at long, length long"


def build_index(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """The directory of the written blocks, a row for each. ``entries`` should be a written table."""
    ship(spark)
    folder = fresh_path(spark, "cdx")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        fs, path = _open(folder)
        name = f"{path}/part-{part:06d}-{context.taskAttemptId()}.blocks"
        out, at, rows = None, 0, []
        try:
            for held in _blocks(batches, size):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                keys = held.column("key")
                data = packed(held)
                out.write(data)
                rows.append((part, len(rows), keys[0].as_py(), keys[-1].as_py(), name, at, len(data)))
                at += len(data)
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    # Ids and places break ties, so that many captures of one URL spread over partitions as well.
    order = ["key", "page_id", "file", "at"]
    lines, size = entries.count(), LINES
    parts = max(1, -(-lines // PART_LINES), min(2 * spark.sparkContext.defaultParallelism, lines // LINES))
    return materialize(spark, entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK), "capture-index")


def _blocks(batches, size: int):
    """Tables of ``size`` lines each, the last one of what is left."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(size - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(lines: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, lines.schema) as w:
        w.write_table(lines)
    return zlib.compress(sink.getvalue(), 6)


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zlib.decompress(data)).read_all()


def _find(keys: list[str], directory: list[tuple[str, str]], load) -> list[pa.Table]:
    """Lines of sorted keys in one partition: blocks by binary search in the directory, lines by binary search in a block."""
    firsts, lasts = [d[0] for d in directory], [d[1] for d in directory]
    wanted: dict[int, list[str]] = {}
    for key in keys:
        for b in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
            wanted.setdefault(b, []).append(key)
    out = []
    for b, own in wanted.items():
        lines = load(b)
        held = lines.column("key").to_pylist()
        at = [i for key in own for i in range(bisect.bisect_left(held, key), bisect.bisect_right(held, key))]
        out.append(lines.take(pa.array(at, pa.int64())))
    return out


def lookup(spark: SparkSession, index: DataFrame, urls: DataFrame) -> DataFrame:
    """All captures of each distinct URL of ``urls`` (url), by the index's directory."""
    ship(spark)
    bounds = index.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("part").collect()
    # One row a range partition. Spark sorts strings by their UTF-8 bytes, as Python does by code points.
    parts = [(r["part"], r["lo"], r["hi"]) for r in bounds]
    lows, highs = [p[1] for p in parts], [p[2] for p in parts]

    def route(batches):
        for batch in batches:
            keys, at = [], []
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                for p in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key)):
                    keys.append(key)
                    at.append(parts[p][0])
            yield pa.RecordBatch.from_pydict({"key": keys, "part": pa.array(at, pa.int32())})

    def search(_, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        """One partition's keys, PART_LINES at most in the index, and its directory rows; block by block from its file."""
        if not len(asked) or not len(blocks):
            return _schema().empty_table()
        blocks = blocks.sort_by("block")
        directory = list(zip(blocks.column("first_key").to_pylist(), blocks.column("last_key").to_pylist(), strict=True))
        places = list(zip(*(blocks.column(c).to_pylist() for c in ("file", "at", "length")), strict=True))
        files: dict = {}

        def load(b: int) -> pa.Table:
            name, at, length = places[b]
            if name not in files:
                files[name] = fs.open_input_file(name)
            files[name].seek(at)
            return unpacked(files[name].read(length))

        fs, _ = _open(folder)
        try:
            found = _find(sorted(set(asked.column("key").to_pylist())), directory, load)
        finally:
            for f in files.values():
                f.close()
        return pa.concat_tables([t.select(list(_COLUMNS)).cast(_schema()) for t in found]) if found else _schema().empty_table()

    folder = fresh_path(spark, "any")  # names the file system; block files' paths are in the directory
    asked = urls.select("url").distinct().mapInArrow(route, "key string, part int").distinct()
    # As many tasks as partitions of the index, so that small ones aren't folded into one task.
    n = max(1, len(parts))
    return asked.repartition(n, "part").groupBy("part").cogroup(index.repartition(n, "part").groupBy("part")).applyInArrow(search, _ENTRY)


def read(spark: SparkSession, folder: str, captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the captures, read from the files by range."""
    ship(spark)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in names])

    def run(batches):
        fs, path = _open(folder)
        name = f = None
        for batch in batches:
            rows = []
            for file, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length")), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{path}/{file}")
                f.seek(at)
                fields, body = parse(zlib.decompress(f.read(length), 31))
                head, _, payload = body.partition(b"\r\n\r\n")
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                page_id, refers_to = (int(v) if (v := fields.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id"))
                # A revisit keeps the head of the reply that it stands for, and so the length of its payload.
                size = int(_LENGTH.search(head)[1])
                if fields["warc-type"] == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of page {page_id} has another length or digest")
                rows.append((page_id, size, digest, fields["warc-type"], refers_to))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
        if f is not None:
            f.close()

    # Neighbours of a file are read together, SLICE bytes at a time, by as many tasks as there are slices.
    part = F.floor(F.col("at") / SLICE)
    captures = materialize(spark, captures, "found")
    n = max(1, captures.agg(F.sum("length")).first()[0] or 0)
    order = captures.repartition(-(-n // SLICE), "file", part).sortWithinPartitions("file", "at")
    return order.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes, indexes and reads back every row of ``pages`` (page_id, url, html)."""
    folder, files = write(spark, pages)
    index = build_index(spark, materialize(spark, scan(files, folder), "entries"))
    return read(spark, folder, lookup(spark, index, pages))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, table(spark, sf_dir, "pages"))
