"""Web archives: captures written as WARC records, and records read back and put together to one row per capture.

A capture is a transaction of three records. The response holds the page, the request and the metadata name it in WARC-Concurrent-To. A page
whose payload another capture already holds is a revisit: its record carries the digest and refers to the response that has
the payload. Of equal payloads of ``LEAST`` bytes or more the capture of the largest page_id is the response; of rows that share that id as
well, the last in the table. Shorter payloads are always responses. Payloads are equal if their SHA-1 digests and lengths are.

``write`` makes archives with Spark's text writer: a record is a value, and the two line ends after each record are the line separator. So files
go wherever Spark can write, and a task that is run again replaces what it left. Which rows are revisits is settled on digests
alone; pages themselves are shuffled once at most. ``records`` reads archives, plain or in gzip members, with Spark's binary files, streaming
through each file; ``assemble`` joins the records. A page_id travels in the metadata, so no row is whole without its transaction.

A null page is an empty one; a null url has no target, a null page_id none in the metadata; both come back as null. Odd signs in
an address are percent-encoded in the headers, the metadata keep the address as it is. Pages may be as long as a Spark string and may
hold anything, also lines that look like a record: lengths part the records, not their text. Repeated rows are captures of their own.
An empty table gives archives without records. Rows are told apart by place, so ``pages`` must be a table at rest. Other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics import session
from storelytics.llm.common import cut, dropped_shuffles

LEAST = 1000
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20
END = "\r\n"


def _place(pages: DataFrame) -> DataFrame:
    return pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))


def _record_id(kind: str, row: Column) -> Column:
    """A urn:uuid made from the row's place, so that a task run again writes the same."""
    digest = F.md5(F.concat(F.lit(f"{kind}:"), row.cast("string")).cast("binary"))
    parts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _encoded(url: Column) -> Column:
    """The address without white space, controls and other signs that could end a header."""
    signs = F.regexp_extract_all(url, F.lit(r"(?s)[!-~]+|[^!-~]"), F.lit(0))
    return F.array_join(F.transform(signs, lambda s: F.when(s.rlike("^[!-~]+$"), s).otherwise(F.url_encode(s))), "")


def _record(kind: str, headers: list[tuple[str, Column]], content: str, block: Column) -> Column:
    """A whole record but for the two line ends behind it. A header of a null value is left out."""
    lines = [F.lit(f"WARC/1.1{END}WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block)


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """(row, page_id, url, bytes, digest, keeper): ``keeper`` is the row of the response a revisit refers to, else null."""
    keys = cut(_place(pages).select(
        "row", "page_id", "url", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest")
    ))
    keepers = (
        keys.filter(F.col("bytes") >= least).groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("n")).filter("n > 1")
        .select("digest", "bytes", F.col("best.row").alias("keeper"))
    )
    joined = keys.join(keepers, ["digest", "bytes"], "left")
    return cut(joined.withColumn("keeper", F.when(F.col("keeper") != F.col("row"), F.col("keeper"))))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``, each of about ``file_bytes`` of pages before compression."""
    decided = _decided(pages, least)
    size = decided.agg(F.sum(F.when(F.col("keeper").isNull(), F.col("bytes"))), F.count("*")).first()
    each = max(1, int(file_bytes // max(1, (size[0] or 0) / max(1, size[1]))))
    revisits = decided.filter("keeper IS NOT NULL")
    # Dealt by row at every size, so the archives come out even and the plan does not turn on how many revisits there are.
    whole = _place(pages).join(revisits.select("row").hint("merge"), "row", "left_anti")
    fields = ["row", "page_id", "url"]
    captures = whole.select(*fields, "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("keeper"))
    captures = captures.unionByName(revisits.select(*fields, F.lit(None).cast("string").alias("html"), "digest", "keeper"))

    main, target = _record_id("response", F.col("row")), _encoded(F.col("url"))
    common = [("WARC-Target-URI", target), ("WARC-Date", F.lit(date))]
    digest = F.concat(F.lit("sha1:"), F.coalesce("digest", F.sha1(F.col("html").cast("binary"))))
    named = [("WARC-Record-ID", main), ("WARC-Payload-Digest", digest), *common]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END * 2), F.col("html"))
    response = _record("response", named, "application/http; msgtype=response", http)
    refers = [
        ("WARC-Refers-To", _record_id("response", F.col("keeper"))),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    ]
    revisit = _record("revisit", named + refers, "application/http; msgtype=response", F.lit(f"HTTP/1.1 200 OK{END * 2}"))

    def beside(kind: str) -> list[tuple[str, Column]]:
        return [("WARC-Record-ID", _record_id(kind, F.col("row"))), ("WARC-Concurrent-To", main), *common]

    host, where = F.regexp_extract(target, "^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(target, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(where.startswith("/"), where).otherwise(F.concat(F.lit("/"), where)), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2))
    asked = F.coalesce(asked, F.lit(f"GET / HTTP/1.1{END * 2}"))
    request = _record("request", beside("request"), "application/http; msgtype=request", asked)
    known = F.concat(F.lit("page: "), F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"}), F.lit(END))
    metadata = _record("metadata", beside("metadata"), "application/warc-fields", known)
    first = F.when(F.col("keeper").isNull(), response).otherwise(revisit)
    rows = captures.select(F.explode(F.array(first, request, metadata)).alias("value"))
    with dropped_shuffles(pages.sparkSession):
        rows.write.options(lineSep=END * 2, compression="gzip", maxRecordsPerFile=3 * each).text(path)


RECORD = (
    "record_id string, kind string, concurrent_to string, refers_to string, target string, date string, stated_digest string, "
    "head string, payload binary, payload_bytes long, payload_digest string"
)
_ARROW = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64()}.get(t, pa.string())) for n, t in (f.split() for f in RECORD.split(", "))])


def _headers(stream) -> dict[str, str] | None:
    """The named fields of the next record, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parsed(content: bytes) -> Iterator[tuple]:
    """The records of one archive, plain or in any number of gzip members, as rows of ``RECORD``."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw
    while (fields := _headers(stream)) is not None:
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        head, payload = b"", block
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
        digest = fields.get("warc-payload-digest")
        yield (
            fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
            fields.get("warc-target-uri"), fields.get("warc-date"), digest and digest.removeprefix("sha1:"), head.decode("utf-8", "replace"),
            payload, len(payload), hashlib.sha1(payload).hexdigest(),
        )


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, with the payload's own length and digest beside the stated one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in parsed(content.as_py()):
                    rows.append(row)
                    held += row[9] + 500
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture out of ``records``.

    (capture_id, kind, refers_to, target, date, payload, payload_bytes, payload_digest, request, metadata, n_requests, n_metadata). A
    revisit's payload length and digest are those of the response it refers to; a response that is not in the archives leaves
    the length null and the stated digest. ``request`` and ``metadata`` are structs of the first record by id of their kind and null
    where there is none; further ones are counted and given by ``unplaced``. Payloads move only if they are asked for.
    """
    mains = found.filter(F.col("kind").isin("response", "revisit"))
    capture = F.col("concurrent_to").alias("capture_id")

    def beside(kind: str, *values: Column) -> DataFrame:
        of = found.filter((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        one = F.min(F.struct("record_id", *values)).alias(kind)
        return of.groupBy(capture).agg(one, F.count("*").alias("n_requests" if kind == "request" else "n_metadata"))

    requests = beside("request", F.col("head"))
    metadata = beside("metadata", F.col("payload").cast("string").alias("fields"))
    held = found.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    )
    again = F.col("kind") == "revisit"
    return (
        mains.withColumnRenamed("record_id", "capture_id").drop("concurrent_to")
        .join(requests, "capture_id", "left").join(metadata, "capture_id", "left").join(held, "refers_to", "left")
        .select(
            "capture_id", "kind", "refers_to", "target", "date", F.when(~again, F.col("payload")).alias("payload"),
            F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(again, F.coalesce("_digest", "stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
            "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
        )
    )


def unplaced(found: DataFrame) -> DataFrame:
    """Requests and metadata that ``assemble`` does not carry: those without their capture and all but the first of a capture."""
    captures = found.filter(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to"))
    others = found.filter(F.col("kind").isin("request", "metadata"))
    firsts = others.join(captures, "concurrent_to", "left_semi").groupBy("kind", "concurrent_to").agg(F.min("record_id").alias("record_id"))
    return others.join(firsts.select("record_id"), "record_id", "left_anti")


def captured(captures: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): ``refers_to`` is the page_id of the response a revisit needs."""
    page = F.from_json(F.regexp_extract(F.col("metadata.fields"), "page: (.*)", 1), "page_id long, url string")
    rows = captures.select("capture_id", page.alias("page"), "payload_bytes", "payload_digest", "kind", "refers_to")
    held = rows.filter("kind = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page.page_id").alias("_page"))
    return rows.join(held, "refers_to", "left").select(
        "page.*", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("_page").alias("refers_to")
    )


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archives to the shared folder, read them back and give their captures."""
    path = session.scratch_path(pages.sparkSession, "archive")
    write(pages, path, least)
    # Parsed once: what the joins below need of each record, without the pages.
    small = F.when(F.col("kind") != "response", F.col("payload"))
    found = records(pages.sparkSession, path)
    found = cut(found.withColumn("payload", small))
    return captured(assemble(found))
