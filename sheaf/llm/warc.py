"""WARC archives with revisit records: an index first, then coalesced byte-range reads of the records wanted."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.rows import small
from sheaf.llm.running import slots
from sheaf.llm.store import file_system, workspace, written
from sheaf.sources.tables import table

LEAST = 1000
#: An archive ends after the record that makes it this long; a read spans at most ``SPAN`` bytes and gaps of at most ``GAP``.
ARCHIVE, SPAN, GAP = 256 << 20, 16 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def _urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        f"X-Page-ID: {'' if page is None else page}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"WARC-Refers-To-Target-URI: {_line(refers_url)}", f"WARC-Refers-To-Date: {DATE}"] if revisit and refers_url is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-cased names) and the payload in its HTTP message."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write every row as a record into archives below ``folder`` and return the index, a written table.

    Of rows with equal payloads of ``least`` bytes or more, the one with the largest id is the response and the
    others revisit it. Rows that repeat that id are all responses, and so are rows of null ids where the group has
    no other id; beside other ids they revisit. Null html is an empty payload. Which rows revisit is settled on digests
    before any archive is written. Each task writes whole files under names of their own, and only files of
    tasks that succeeded are in the index, so a lost executor leaves at most files that nothing refers to.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    facts = rows.select(
        "page_id", "url", F.octet_length("html").alias("n"), F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("same")
    ).where(F.col("n") >= least)
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "url")).alias("first")
    shared = written(
        facts.groupBy("same").agg(F.count("*").alias("rows"), first).where("rows > 1").select(
            "same", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")
        ),
        f"{folder}/shared"
    )
    settled = rows.withColumn("same", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    joined = settled.join(small(shared), "same", "left").withColumn("payload", F.col("html").cast("binary")).select(
        "page_id", "url", "payload", "refers_to", "refers_url", F.col("refers_to").isNotNull().alias("has")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(f"{base}/archives", recursive=True)
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())
            ]
        )
        out = None
        name, at = "", 0
        seen: set[int] = set()
        try:
            for batch in batches:
                made: list[tuple] = []
                for i in range(len(batch)):
                    page, url, payload, target, target_url, has = (c[i].as_py() for c in batch.columns)
                    revisit = has and page != target
                    if out is None or at >= ARCHIVE:
                        if out:
                            out.close()
                        name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    data = record(page, url, payload, target, target_url, revisit)
                    out.write(data)
                    made.append(
                        (
                            page, url, hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", target if revisit else None, name, at,
                            len(data)
                        )
                    )
                    at += len(data)
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema
                    )
        finally:
            if out:
                out.close()

    return written(joined.mapInArrow(write, INDEX), f"{folder}/index")


def records(index: DataFrame, folder: str) -> DataFrame:
    """The records of index rows, read from the archives: page_id, record_type, refers_to, digest, payload.

    Rows are dealt by file and stretch of ``SPAN`` bytes and sorted by offset; neighbours are read together in
    one range. A record whose type, id or digest is not the index's raises. A revisit's payload is null: it is
    that of the record it refers to. Payloads go on once ``SPAN`` bytes of them are unpacked, however small their
    members are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        for batch in batches:
            rows = batch.select(["file", "offset", "length", "page_id", "record_type", "refers_to", "digest"]).to_pylist()
            for name, own in groupby(rows, key=lambda r: r["file"]):
                with files.open_input_file(f"{base}/{name}") as source:
                    for run in runs(list(own)):
                        start = run[0]["offset"]
                        data = source.read_at(max(r["offset"] + r["length"] for r in run) - start, start)
                        made, size = [], 0
                        for r in run:
                            if size >= SPAN:  # members may hold far more than their own bytes
                                yield _read_rows(made)
                                made, size = [], 0
                            fields, payload = parsed(data[r["offset"] - start : r["offset"] - start + r["length"]])
                            kind, page = fields["warc-type"], int(fields["x-page-id"]) if fields["x-page-id"] else None
                            digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                            whole = kind == "revisit" or hashlib.sha1(payload).hexdigest() == digest
                            if (kind, page, digest) != (r["record_type"], r["page_id"], r["digest"]) or not whole:
                                raise ValueError(f"{name} at {r['offset']} is not the record of the index")
                            made.append(
                                (
                                    page, kind, int(fields["x-refers-to-page"]) if kind == "revisit" else None, digest,
                                    None if kind == "revisit" else payload
                                )
                            )
                            size += len(payload)
                        yield _read_rows(made)

    dealt = index.repartition("file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, record_type string, refers_to long, digest string, payload binary")


def _read_rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)],
        names=["page_id", "record_type", "refers_to", "digest", "payload"]
    )


def runs(rows: list[dict]) -> Iterator[list[dict]]:
    """Index rows of one file, sorted by offset, as ranges to read at once."""
    run: list[dict] = []
    for r in rows:
        end = run[-1]["offset"] + run[-1]["length"] if run else 0
        if run and (r["offset"] > end + GAP or r["offset"] + r["length"] - run[0]["offset"] > SPAN):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from the archives; a revisit's payload is that of the response it refers to."""
    folder = workspace(spark, "warc")
    index = archived(table(spark, sf_dir, "pages"), folder)
    read = records(index, folder).select(
        "page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    found = written(read.withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(slots(index)))), f"{folder}/read")
    responses, revisits = found.where("record_type = 'response'").drop("deal"), found.where("record_type = 'revisit'")
    # a response with many revisits is sent to each slot that asks for it, so its revisits never meet in one task
    payloads = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    asked = revisits.select("refers_to", "deal").distinct().join(payloads, "refers_to")
    resolved = revisits.select("page_id", "record_type", "refers_to", "deal").join(asked, ["refers_to", "deal"], "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.select(*columns).unionByName(resolved.select(*columns))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS target FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to FROM g
"""
