"""A deterministic sharded WARC writer, and a reader that checks what it reads.

Each page becomes one record of WARC/1.1, a gzip member of its own: response, or
revisit where a page of equal payload (of REVISIT bytes at least) and largest id
holds the payload. Headers, lengths and digests are made anew from the payload;
record ids are name-based; gzip carries no time. So equal input gives equal bytes.

1. Digests and winners: a combined aggregate over (SHA-256, length); pages of
   equal payload meet their winner by that key, without their payload.
2. A response is built of each page where the page is, so only compressed records
   are ever moved; they are written once to the shared folder. Revisits are built
   of digests and addresses. Where a page has both, the revisit stands.
3. Records are range-sorted by page id. The running sum of their compressed
   sizes rolls files at `roll` bytes. It is the same however Spark deals the
   rows: sums of the ranges first, then inside each range.
4. A task writes a file under a temporary name of its attempt; the manifest, a
   table, records name, size, records and SHA-256 of what finished attempts
   wrote. Only then are files moved to their names; what other attempts left is
   deleted. Both can be repeated.

Null payloads are empty, null ids give a record without a page id, a missing
address gives an address made of the row's number. Rows with equal ids are
records of their own; of equal payloads under equal ids the last row by number is
the response. An empty table gives a manifest without files. Other columns,
whatever their names, are not looked at. A record is built whole in memory, so a
task needs a few times the longest payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinplan.llm.common import FEW, discard, fresh_path, parts, running_total, with_rid, written

REVISIT = 1000
#: Compressed bytes after which the next file begins. The reader holds one file at a time.
ROLL = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(rid: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{rid}:{digest}')}>"


def _address(url: str | None, rid: int) -> str:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return url or f"urn:page:{rid}"


def member(rid: int, page_id: int | None, url: str | None, size: int, digest: str, payload: bytes, refers: tuple[int, int | None, str | None] | None = None) -> bytes:
    """One gzip member; size and digest are the payload's. refers: row number, id and address of the response that a revisit, which has no payload, points at."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    named = lambda x: "sha1:" + base64.b32encode(bytes.fromhex(x)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(rid, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_address(url, rid)}", f"WARC-Payload-Digest: {named(digest)}", f"WARC-Block-Digest: {named(hashlib.sha1(block).hexdigest())}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0], digest)}", f"WARC-Refers-To-Target-URI: {_address(refers[2], refers[0])}", f"WARC-Refers-To-Date: {DATE}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers[1]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _opening(name: str) -> bytes:
    block = b"software: twinplan\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _made(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500).to_pylist()
            made = [make(r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["rid"] for r in rows], pa.int64()), pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.binary())], ["rid", "size", "member"])


def _response(r: dict) -> bytes:
    payload = (r["text"] or "").encode()
    return member(r["rid"], r["id"], r["url"], len(payload), hashlib.sha1(payload).hexdigest(), payload)


def _revisit(r: dict) -> bytes:
    return member(r["rid"], r["id"], r["url"], r["bytes"], r["digest"], b"", (r["to_rid"], r["to_id"], r["to_url"]))


_MEMBER = "rid long, size long, member binary"


def _dealt(batches: Iterator[pa.RecordBatch], first: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = np.searchsorted(first, np.asarray(batch.column("rid")), "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *[batch.column(c) for c in ("rid", "rank", "member")]], ["shard", "rid", "rank", "member"])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the shards, whose records come sorted, each to a temporary file; a manifest row for each that is complete. Of a page's records the first is written."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    attempt, now, out, last = uuid.uuid4().hex, None, None, None

    def closed() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_pylist([{"shard": now, "name": name, "temporary": temporary, "bytes": size, "records": records, "sha256": sha.hexdigest()}], schema=_MANIFEST)

    for batch in batches:
        for shard, rid, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "rid", "member")]):
            if rid == last:
                continue
            last = rid
            if shard != now:
                if out is not None:
                    yield closed()
                now, name = shard, f"part-{shard:08d}.warc.gz"
                temporary, size, records, sha = f"_temporary-{attempt}-{name}", 0, 0, hashlib.sha256()
                out = files.open_output_stream(f"{root}/{temporary}", compression=None)
                data = _opening(name) + data
            out.write(data)
            sha.update(data)
            size, records = size + len(data), records + 1
    if out is not None:
        yield closed()


_MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])


def _commit(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = pa.fs.FileSystem.from_uri(folder)
    for batch in batches:
        for r in batch.to_pylist():
            if files.get_file_info(f"{root}/{r['temporary']}").type == pa.fs.FileType.File:
                files.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
            if (found := files.get_file_info(f"{root}/{r['name']}").size) != r["bytes"]:
                raise OSError(f"{r['name']}: {found} bytes; the manifest has {r['bytes']}")
        yield batch


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = REVISIT, roll: int = ROLL) -> DataFrame:
    """Writes the archives and returns their manifest, which also lies in folder/manifest."""
    spark = pages.sparkSession
    keyed = with_rid(pages, id_col, payload_col, rows=True).select("rid", "id", "text", F.col("row")[url_col].cast("string").alias("url"))
    n = parts(spark, pages)
    payload = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    digests = written(
        keyed.select("rid", "id", "url", F.sha1(payload).alias("digest"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("size")), "digests"
    )
    large = digests.filter(F.col("size") >= least)
    best = large.groupBy("sha256", "size").agg(F.max(F.struct("id", "rid", "url")).alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # only ids and digests meet here; a digest that a third of the rows share is split by the adaptive join
    to = [F.col(f"to.{c}").alias(f"to_{c}") for c in ("rid", "id", "url")]
    again = large.join(best, ["sha256", "size"]).filter("rid != to.rid").select("rid", "id", "url", "digest", F.col("size").alias("bytes"), *to)
    revisits = written(again.mapInArrow(partial(_made, make=_revisit), _MEMBER), "revisits")
    responses = written(keyed.mapInArrow(partial(_made, make=_response), _MEMBER), "responses")
    if revisits.count() <= FEW:  # else the writer leaves out the responses that have a revisit
        responses_left = responses.join(F.broadcast(revisits.select("rid")), "rid", "left_anti")
    else:
        responses_left = responses
    made = revisits.withColumn("rank", F.lit(0)).unionByName(responses_left.withColumn("rank", F.lit(1)))

    stands = made.select("rid", "rank", "size").groupBy("rid").agg(F.min(F.struct("rank", "size")).alias("first")).select("rid", "first.size")
    sizes = written(stands.repartitionByRange(n, "rid").withColumn("part", F.spark_partition_id()), "sizes")
    totals = sizes.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    if not totals:
        manifest = spark.createDataFrame([], "shard int, name string, temporary string, bytes long, records long, sha256 string")
        manifest.write.parquet(f"{folder}/manifest")
        return manifest
    running = F.sum("size").over(Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1))
    file = F.floor((F.coalesce(running, F.lit(0)) + F.col("before")) / F.lit(roll))
    # one number for each file to be
    first = sizes.join(running_total(spark, [(r["part"], r["size"]) for r in totals]), "part").withColumn("file", file).groupBy("file").agg(F.min("rid").alias("rid")).toArrow()
    bounds = np.sort(np.asarray(first.column("rid")))
    dealt = made.select("rid", "rank", "member").mapInArrow(partial(_dealt, first=bounds), "shard int, rid long, rank int, member binary")
    tasks = min(n, len(bounds))
    manifest = written(
        dealt.repartitionById(tasks, F.col("shard") % F.lit(tasks)).sortWithinPartitions("shard", "rid", "rank")
        .mapInArrow(partial(_write, folder=folder), "shard int, name string, temporary string, bytes long, records long, sha256 string"),
        "manifest",
    )
    manifest.mapInArrow(partial(_commit, folder=folder), manifest.schema).write.parquet(f"{folder}/manifest")
    discard(digests, revisits, responses, sizes, manifest)
    files, root = pa.fs.FileSystem.from_uri(folder)
    for info in files.get_file_info(pa.fs.FileSelector(root)):
        if info.base_name.startswith("_temporary-"):
            files.delete_file(info.path)
    return spark.read.parquet(f"{folder}/manifest")


#: Compressed bytes that are handed to the decompressor at once.
CHUNK = 1 << 14


def records(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; a record that contradicts itself is an error."""
    at = 0
    while at < len(content):
        z = zlib.decompressobj(31)
        chunks = []
        while not z.eof:
            if at >= len(content):
                raise ValueError("an archive ends inside of a record")
            chunks.append(z.decompress(content[at : at + CHUNK]))
            at = min(at + CHUNK, len(content)) - len(z.unused_data)
        data = b"".join(chunks)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k: v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('WARC-Record-ID')}: not as long as it says")
        yield headers, rest[:size]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hexed = lambda x: base64.b32decode(x.removeprefix("sha1:")).hex()
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for h, block in records(memoryview(content.as_buffer())):
                kind = h["WARC-Type"]
                if kind == "warcinfo":
                    continue
                if hashlib.sha1(block).hexdigest() != hexed(h["WARC-Block-Digest"]):
                    raise ValueError(f"{h['WARC-Record-ID']}: block digest differs")
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                digest = hexed(h["WARC-Payload-Digest"])
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{h['WARC-Record-ID']}: payload differs")
                rows.append((number(h.get("WARC-Page-ID")), size, digest, kind, number(h.get("WARC-Refers-To-Page-ID")), h["WARC-Target-URI"], path.rsplit("/", 1)[-1], payload if kind == "response" else None))
            columns = list(zip(*rows)) or [()] * len(_READ)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _READ)], schema=_READ)


_READ = pa.schema([
    ("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("uri", pa.string()), ("file", pa.string()), ("payload", pa.binary()),
])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's archives, one file at a time."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    return names.select("path", "content").mapInArrow(
        _read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, file string, payload binary"
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), q AS (
  SELECT page_id, strlen(payload) AS n, sha1(payload) AS d, max(page_id) OVER (PARTITION BY payload) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
