"""WARC archives with an index, read back by coalesced byte ranges.

Each task writes the records of its rows to archives of its own, one gzip member per record
as the format recommends, and returns an index row per record: archive, offset, length, url,
digest. The index is what counts: it is committed by Spark, so archives of a failed or
repeated attempt (their names are unique) are never referred to. Reading starts from index
rows, sorts them by offset, joins neighbouring ranges into runs and reads each run with one
request.

Null payloads count as empty. Of records with equal payloads the one with the smallest page
id is the response and the others revisit it; rows that repeat that id and payload are
responses too. Null ids count as larger than all others and are kept. Line ends in a url are
written as %0A. An empty table gives an empty index and no rows. Columns other than page_id,
url and html are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import fresh_path, saved

ARCHIVE_BYTES = 64 << 20
#: Ranges less than GAP apart are read together, up to about RUN bytes.
GAP, RUN = 64 << 10, 2 << 20

#: Digit orders of base 32 as counted by conv() and as defined by RFC 4648.
_COUNTED, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in upper-case base 32: 160 bits are 8 times 4 digits, without padding."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _COUNTED, _BASE32)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null for responses)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    # Only payloads that repeat are joined; written first, so that a payload of very many
    # pages is split by the join.
    repeated = saved(
        rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "warc-repeated",
    )
    rows = rows.join(repeated, "payload_digest", "left")
    first = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "payload_digest", F.when(first, F.col("first")).alias("refers_to"))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _record(row: dict) -> bytes:
    payload = row["payload"].encode()
    body = payload if row["refers_to"] is None else b""
    page = "" if row["page_id"] is None else row["page_id"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {re.sub('[\r\n]+', '%0A', row['url'])}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def _parsed(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page, refers = (fields.get(k, "")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "refers_to": int(refers) if refers else None,
        "payload": body[: int(fields["Content-Length"])],
    }


_INDEX = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()),
])
INDEX_SCHEMA = "archive string, offset long, length long, url string, payload_digest string, page_id long"
READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)
_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _writer(folder: str, archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or offset >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(row)) + packer.flush()
                out.write(member)
                rows.append({
                    "archive": f"{folder}/{name}", "offset": offset, "length": len(member),
                    "url": row["url"], "payload_digest": row["payload_digest"], "page_id": row["page_id"],
                })
                offset += len(member)
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder``; return the committed index."""
    return saved(plan_records(pages).mapInArrow(_writer(folder, archive_bytes), INDEX_SCHEMA), "warc-index")


def coalesced_runs(selected: DataFrame, gap: int = GAP, run: int = RUN) -> DataFrame:
    """Runs of an index selection: archive, start, stop and the ranges inside, by offset.

    A run ends before a gap of more than ``gap`` bytes, and before a record that begins in
    another stretch of ``run`` bytes than the one before it.
    """
    before = "over (partition by archive order by offset)"
    marked = selected.withColumn(
        "_new",
        F.expr(
            f"case when offset - lag(offset + length) {before} > {gap} "
            f"or floor(offset / {run}) <> floor(lag(offset) {before} / {run}) then 1 else 0 end"
        ),
    )
    return (
        marked.withColumn("_run", F.expr(f"sum(_new) {before}"))
        .groupBy("archive", "_run")
        .agg(
            F.min("offset").alias("start"),
            F.max(F.col("offset") + F.col("length")).alias("stop"),
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"),
        )
        .drop("_run")
    )


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        for run in batch.to_pylist():
            if name != run["archive"]:
                system, path = _open(run["archive"])
                name, source = run["archive"], system.open_input_file(path)
            data = source.read_at(run["stop"] - run["start"], run["start"])
            members = (data[r["offset"] - run["start"] :][: r["length"]] for r in run["ranges"])
            yield pa.RecordBatch.from_pylist([_parsed(zlib.decompress(m, 31)) for m in members], schema=_READ)


def read_records(selected: DataFrame, gap: int = GAP, run: int = RUN) -> DataFrame:
    """The records that index rows name, with their payloads (empty for revisits)."""
    return coalesced_runs(selected, gap, run).mapInArrow(_read_runs, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to new archives and read every record back."""
    return read_records(write_archives(pages, fresh_path(pages.sparkSession, "warc")))


#: What the round trip returns, in DuckDB SQL (without the payloads).
ROUND_TRIP_SQL = """
with p as (
    select page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]+', '%0A', 'g') as url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hexed from pages
), d as (
    select page_id, url, strlen(payload) as payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(hexed, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest
    from p
), f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, url, case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
    payload_digest, payload_bytes, case when page_id is distinct from first then first end as refers_to
from f
"""
