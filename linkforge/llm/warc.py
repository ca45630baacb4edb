"""WARC archives: written with an index, read back by coalesced byte ranges.

Archives are gzip WARC/1.1, one member a record, below the shared folder, through the file system that its URI names
(those that Arrow knows: file, hdfs, viewfs, s3 and s3a, gs, abfs and abfss; any other raises an error).
A task writes archives under random names and returns the index rows (path, offset, length, url, digest, ...). The
index is then written as Parquet: it is the commit record. Archives of failed or repeated attempts are in no index and
are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import Scratch

INDEX = "page_id {id}, path string, offset long, length long, url string, digest string"
#: Fixed value: the profile URI of WARC 1.1 for revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def clean(value: str) -> str:
    """A header value holds no line breaks."""
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC record. A revisit's block ends with the HTTP header, whose Content-Length is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP content length, and payload (None: a revisit) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    return headers | {"payload_bytes": size, "payload": payload if headers["warc-type"] == "response" else None}


def gz(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(df: DataFrame, scratch: Scratch, min_revisit: int = 1000, roll_bytes: int = 64 << 20) -> DataFrame:
    """The index of the archives that hold one record for each row of df (page_id, url, html).

    Payload: html in UTF-8 (null: empty). Of records with equal payloads of min_revisit bytes or more, that with the
    largest page_id is a response and the others revisit it (rows that repeat that very page_id are responses too;
    a null page_id is never the largest, and a group of null ids alone has responses only). The digests are grouped
    without the payloads; these move once, compressed, in one shuffle on (page_id, digest), which no hot page,
    digest or host can skew.
    """
    kind = df.schema["page_id"].dataType.simpleString()
    html = F.coalesce("html", F.lit("")).cast("binary")
    hashed = df.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    narrow = hashed.where(F.length("html") >= min_revisit).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = narrow.join(groups, "digest").where("refers_to is not null and not (page_id <=> refers_to)").distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "page_id": pa.array([r["page_id"] for r in rows], batch.schema.field("page_id").type), "url": pa.array([r["url"] for r in rows], pa.string()), "digest": pa.array([r["digest"] for r in rows], pa.string()),
                    "size": pa.array([len(r["html"]) for r in rows], pa.int64()), "packed": pa.array([gz(record("response", r["page_id"], r["url"], r["html"], r["digest"])) for r in rows], pa.binary()),
                })

    packed = hashed.mapInArrow(pack, f"page_id {kind}, url string, digest string, size long, packed binary")
    a, b = packed.alias("a"), revisits.alias("b")
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
    todo = a.join(b, same, "left").select("a.page_id", "url", "a.digest", "size", F.when(F.col("b.digest").isNull(), F.col("packed")).alias("packed"), "refers_to")
    folder = scratch.path("archives")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                index = []
                for r in batch.slice(i, 256).to_pylist():
                    if out is None:
                        name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    raw = r["packed"] or gz(record("revisit", r["page_id"], r["url"], bytes(r["size"]), r["digest"], r["refers_to"]))
                    out.write(raw)
                    index.append({"page_id": r["page_id"], "path": f"{folder}/{name.rpartition('/')[2]}", "offset": at, "length": len(raw), "url": r["url"], "digest": r["digest"]})
                    at += len(raw)
                    if at >= roll_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist(index, schema=pa.schema([batch.schema.field("page_id"), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string())]))
        if out is not None:
            out.close()

    return scratch.keep(todo.mapInArrow(put, INDEX.format(id=kind)), "index")


def read(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20, task_bytes: int = 512 << 20) -> DataFrame:
    """The records that index selects: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null: revisit).

    Ranges are sorted by archive and offset; those at most gap bytes apart are read at once, up to about most bytes.
    Only one such range is held at a time. Archives are dealt to as many tasks as their selected bytes fill, but to one
    for every core if there are that many: a number that grows with the bytes, not with the archives.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    told = index.agg(F.countDistinct("path").alias("archives"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(told["archives"], max(told["bytes"] // task_bytes, 2 * index.sparkSession.sparkContext.defaultParallelism)))
    ordered = index.select("page_id", "path", "offset", "length").repartition(tasks, "path").sortWithinPartitions("path", "offset")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}

        def ranges() -> Iterator[list[dict]]:
            run: list[dict] = []
            for batch in batches:
                for r in batch.to_pylist():
                    if run and (r["path"] != run[0]["path"] or r["offset"] - run[-1]["offset"] - run[-1]["length"] > gap or r["offset"] + r["length"] - run[0]["offset"] > most):
                        yield run
                        run = []
                    run.append(r)
            if run:
                yield run

        for run in ranges():
            if kept.get("path") != run[0]["path"]:
                store, base = opened(run[0]["path"])
                if kept:
                    kept["file"].close()
                kept = {"path": run[0]["path"], "file": store.open_input_file(base)}
            first = run[0]["offset"]
            block = kept["file"].read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
            for i in range(0, len(run), 256):
                out = []
                for r in run[i : i + 256]:
                    x = parse(zlib.decompress(block[r["offset"] - first :][: r["length"]], 31))
                    payload, digest = x["payload"], x["warc-payload-digest"].partition(":")[2]
                    if payload is not None and (len(payload) != x["payload_bytes"] or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record at {r['offset']} of {r['path']}")
                    refers = x.get("warc-refers-to")
                    out.append((r["page_id"], x.get("warc-target-uri"), x["warc-type"], int(refers[len("<urn:page:") : -1]) if refers else None, x["payload_bytes"], digest, payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(index.schema["page_id"].dataType)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [id_type, pa.string(), pa.string(), id_type, pa.int64(), pa.string(), pa.binary()]
    return ordered.mapInArrow(get, f"page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html), then reads all of them back; without the payload.

    Nulls in any column, empty and repeated pages get a record each. An empty table gives an empty result and no
    archive. Other columns of pages aren't read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    index = write(pages.select("page_id", "url", "html"), scratch)
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM q
"""
