"""WARC archives with an index of byte ranges, and reads of selected records by coalesced ranges.

Every record is a gzip member of its own, so a record can be read by (offset, length) alone. Tasks write archive
files to shared storage and emit one index row per record: page_id, url, file, offset, length, digest, payload
bytes and type. The index is a table; a read selects index rows first, sorts them by file and offset, merges
ranges that lie close together and fetches each merged range once. Only files that the index names are read, so
files of lost or repeated task attempts do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILE_BYTES = 256 << 20
#: Ranges closer than GAP are read at once, up to READ_BYTES.
GAP, READ_BYTES = 64 << 10, 8 << 20
INDEX = "page_id long, url string, file string, offset long, length long, digest string, payload_bytes long, record_type string, refers_to long"
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def one_line(value: str) -> str:
    """A header value: control characters, which would end or forge a header, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit has no payload and names the response it refers to."""
    block = _STATUS % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def _pack(raw: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _write(folder: str):
    def run(batches):
        rows, held, number = [], 0, 0
        pending: list[bytes] = []

        def close():
            nonlocal rows, held, number, pending
            uri = common.write_file(folder, f"pages-{number:05d}.warc.gz", pending)
            out = pa.RecordBatch.from_pylist([dict(r, file=uri) for r in rows], SCHEMA)
            rows, held, pending, number = [], 0, [], number + 1
            return out

        for b in batches:
            for page_id, url, html, hexed, first in zip(*(b.column(i).to_pylist() for i in range(5))):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                revisit = first is not None and page_id != first
                packed = _pack(record(page_id, url, payload, digest, first, revisit))
                rows.append({"page_id": page_id, "url": url, "offset": held, "length": len(packed), "digest": digest, "payload_bytes": len(payload), "record_type": "revisit" if revisit else "response", "refers_to": first if revisit else None})
                pending.append(packed)
                held += len(packed)
                if held >= FILE_BYTES // 16:
                    yield close()
        if rows:
            yield close()

    return run


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def write_archives(pages: DataFrame, min_bytes: int = 0, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Write one record per page to archives in the shared folder; returns the index, which is a written table.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is the
    response and the others revisit it; smaller payloads are all responses. A null html is an empty payload, a
    null url has no target header, a null page_id counts as the largest. Rows that repeat the smallest page_id of
    their payload are responses each. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Only digests and ids are grouped, with partial sums; lone payloads need no partner and drop out here.
    groups = keyed.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = common.saved(groups, "payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = _responses(keyed, groups, total)
    return common.saved(shared.select("page_id", "url", "html", "sha", "first").mapInArrow(_write(common.scratch(spark, "warc")), INDEX), "index")


def _responses(keyed: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Adds ``first``, null for lone payloads. Groups that fit BROADCAST_GROUPS rows are broadcast, so pages stay where
    they are; beyond that, hot groups are (common.attach) and the rest is a shuffle join of the pages."""
    if groups.count() <= BROADCAST_GROUPS:
        return keyed.join(F.broadcast(groups.select("sha", "first")), "sha", "left")
    return common.attach(keyed, groups, ["sha"], "n", total, "left").drop("n")


#: About 100 bytes each in a hash table: 20 MB at most.
BROADCAST_GROUPS = 200_000


def coalesced(ranges, gap: int = GAP, most: int = READ_BYTES):
    """Runs of (offset, length) rows in ascending order that are fetched at once."""
    run: list = []
    for r in ranges:
        if run and (r[0] > run[-1][0] + run[-1][1] + gap or r[0] + r[1] - run[0][0] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _read(with_payload: bool):
    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        for uri, own in groupby(rows(), key=lambda r: r[0]):
            system, path = common.open_fs(uri)
            with system.open_input_file(path) as f:
                for ranges in coalesced((r[1:] for r in own)):
                    at = ranges[0][0]
                    data = f.read_at(ranges[-1][0] + ranges[-1][1] - at, at)
                    out = [_row(parse(zlib.decompress(data[o - at : o - at + n], 31)), with_payload) for o, n in ranges]
                    yield pa.RecordBatch.from_pylist(out, READ_SCHEMA if with_payload else pa.schema(list(READ_SCHEMA)[:-1]))

    return run


READ_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _urn(value: str | None):
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _row(r: dict, with_payload: bool) -> dict:
    """What a record says; a response's length and digest are taken from its payload, a revisit's from its headers."""
    revisit = r["warc-type"] == "revisit"
    length = int(r["x-payload-length"]) if revisit else len(r["payload"])
    digest = r["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (found := base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()) != digest:
        raise ValueError(f"record {r['warc-record-id']}: payload digest {found}, header {digest}")
    out = {"page_id": _urn(r["warc-record-id"]), "url": r.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": r["warc-type"], "refers_to": _urn(r.get("warc-refers-to"))}
    return out | {"payload": r["payload"]} if with_payload else out


def read_archives(index: DataFrame, where: Column | str | None = None, with_payload: bool = True) -> DataFrame:
    """Records of the index rows that ``where`` selects: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Index rows are dealt by ranges of (file, offset), so neighbours meet in a task and a large file is shared
    among several. The payload of a revisit is empty; the index row of its refers_to leads to it.
    """
    spark = index.sparkSession
    chosen = index if where is None else index.where(where)
    places = chosen.select("file", "offset", "length").repartitionByRange(common.partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return places.mapInArrow(_read(with_payload), schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(common.table(spark, sf_dir, "pages"))
    return read_archives(index, with_payload=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           ((CAST('0x' || substr(h, CAST((i // 8) * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
