"""WARC: archives of gzip members, an index of every record written first, and coalesced byte-range reads of selected records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import bounded, forget, new_folder, opened, table, written

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Neighbouring ranges are read at once if no more than GAP bytes lie between them, up to READ bytes.
GAP, READ = 16 << 10, 8 << 20
#: Archive bytes that a reading task gets on average.
TASK_BYTES = 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, url string, digest string, record_type string, id string"
RECORD = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head of the full payload but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's fields, its digest taken from the payload where it has one. Raises ValueError where the two digests or lengths differ."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    named = base64.b32decode(names["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    own = lambda uri: uri.removeprefix("<urn:page:").removesuffix(">") or None
    kind = names["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != named or len(payload) != length):
        raise ValueError(f"record {names['WARC-Record-ID']} is damaged")
    return {"id": own(names["WARC-Record-ID"]), "url": names.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": length, "payload_digest": named, "refers_to": own(names["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def zipped(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row of pages into archives in folder, one for each task, and return their index as a written table.

    A task's attempt writes a file of its own name, and only the index rows of the attempt that Spark accepts are kept,
    so a lost executor leaves at most a file that no index row names. Null html is an empty payload, a null URL has no target
    line; payloads are whole, however long. Equal rows are records of their own; an empty table gives an empty index."""
    spark = pages.sparkSession
    source = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    keyed = source.withColumn("digest", F.sha1("payload"))
    groups = keyed.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("first_id"), F.count("*").alias("n"))
    # Only digests that occur twice or more; written, so that its true size decides whether Spark broadcasts it.
    copies = written(groups.where("n > 1").select(F.col("digest").alias("copied"), "first_id"), "warc-copies")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string"))
    rows = keyed.join(copies, keyed["digest"] == copies["copied"], "left").select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", refers.alias("refers_to"))

    def store(batches):
        store_fs, path = opened(folder)
        store_fs.create_dir(path, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        try:
            for batch in bounded(batches):
                found = []
                for r in batch.to_pylist():
                    out = out or store_fs.open_output_stream(f"{path}/{name}", compression=None)
                    member = zipped(record(r["id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                    out.write(member)
                    found.append((name, offset, len(member), r["url"], r["digest"], "response" if r["refers_to"] is None else "revisit", r["id"]))
                    offset += len(member)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i in (1, 2) else pa.array(c, pa.string()) for i, c in enumerate(zip(*found))], names=["file", "offset", "length", "url", "digest", "record_type", "id"])
        finally:
            if out:
                out.close()

    index = written(rows.mapInArrow(store, INDEX), "warc-index")
    forget(copies)
    return index


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of index name. Rows are sorted by file and offset; near ranges are read together.

    Archives are dealt out in parts of READ bytes, to as many tasks as the sum of the lengths needs: the index is small, so its
    own size says nothing of the bytes that a task reads."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    near = index.select("file", "offset", "length").withColumn("part", F.floor(F.col("offset") / F.lit(READ)))
    near = near.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def fetch(batches):
        store_fs, path = opened(folder)
        held_name, held = None, None
        for batch in bounded(batches, 4000):
            rows, at = list(zip(*(c.to_pylist() for c in batch.columns))), 0
            while at < len(rows):
                name, start, length = rows[at]
                end, stop = start + length, at + 1
                while stop < len(rows) and rows[stop][0] == name and rows[stop][1] - end <= GAP and rows[stop][1] + rows[stop][2] - start <= READ:
                    end, stop = max(end, rows[stop][1] + rows[stop][2]), stop + 1
                if name != held_name:
                    if held:
                        held.close()
                    held_name, held = name, store_fs.open_input_file(f"{path}/{name}")
                data = held.read_at(end - start, start)
                found = [parsed(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in rows[at:stop]]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)], names=names)
                at = stop
        if held:
            held.close()

    return near.mapInArrow(fetch, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives. Null html has an empty payload; a null URL has no target line; a null id stays null.

    Rows that share the largest id of their payload are all responses. An empty table gives no archive and no row."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    folder = new_folder(spark, "warc")
    back = read_records(write_archives(pages, folder), folder, payloads=False)
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
r AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, strlen(h) >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first AS again, first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""
