"""WARC archives: writing captures, reading records, and assembling transactions.

Writing: a page gives a request, a response (or a revisit of an earlier response with the same
payload) and a metadata record, tied by WARC-Concurrent-To. Of payloads of ``REVISIT_BYTES`` or more
that are equal, the page with the least id is the response. Records are made by DataFrame expressions
and written as gzipped text whose line separator is a record's end, so files appear through Spark's
committer on any file system; a file is one gzip member. A filter of bounded size tells which digests
surely do not repeat; those pages are written where they lie, the others are joined to the repeated
digests, the most frequent of which are broadcast.

Reading: gzipped files are not split, so a task sees whole files in order. It parses them as one
stream by Content-Length, whatever payloads contain, and holds one record at a time. What is no record
(no version line, no valid Content-Length, no end where the length says, an archive that ends within a
record) gives a row of type ``damaged`` with the number of bytes, and reading goes on at the next
record.

Assembly: request and metadata records are joined to the response or revisit that they are
concurrent to, and each capture becomes one nested row.

Defined cases: a null html is an empty payload; a null url has no WARC-Target-URI; line breaks in a
url are percent-encoded; a null ``page_id`` has no page-id field and reads back as null; of repeated
rows that share id and payload one is the response and the others revisit it; rows that are equal in
all are made one, counted, and dealt out again by the thousand; a very long html is one record, held
whole; a capture without request or metadata has null there; an empty table gives an empty archive;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lookup, may_hold, table
from graphloom.session import fresh_path, materialise

REVISIT_BYTES, FILE_RECORDS = 100, 9_000
END = "\r\n\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
DAMAGED = "damaged"
RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, intact boolean, fields map<string, string>, payload binary"
)


def _record_id(kind: str, page: Column, url: Column, digest: Column, n: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), url, digest, n.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, b), F.lit("-"))][:-1], F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, content_type: str, *headers: Column) -> Column:
    """A record without its end; headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [*headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _with_held(df: DataFrame, key: str, held: DataFrame, rows: str, total: int, name: str) -> DataFrame:
    """Left join with ``held``, whose ``key`` is unique and has ``rows`` in ``df``; only rows that it may hold are moved."""
    flagged = may_hold(df, F.col(key), held, key, held.count(), "maybe")
    doubtful = materialise(flagged.where("maybe").drop("maybe"), name)
    found = lookup(doubtful, held, key, rows, total, "left")
    apart = flagged.where("not maybe").drop("maybe").select(key, *[c for c in df.columns if c != key], *[F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema.fields if f.name != key])
    return apart.union(found)


def _dealt(read: DataFrame, equal: DataFrame, total: int) -> DataFrame:
    """Rows with ``n``, which counts rows that are equal in page_id, url and digest."""
    if equal.isEmpty():
        return read.withColumn("n", F.lit(0))
    marked = _with_held(read, "same", equal, "rows", total, "warc-equal")
    own = [c for c in read.columns if c != "same"]
    one = marked.where("rows is not null").groupBy("same", "rows").agg(F.first(F.struct(*own)).alias("row"))
    chunks = one.select("row.*", "same", "rows", F.explode(F.expr("sequence(0, cast((rows - 1) div 1000 as int))")).alias("chunk")).repartition("same", "chunk")
    each = F.explode(F.expr("sequence(chunk * 1000, cast(least(rows, chunk * 1000 + 1000) - 1 as int))"))
    return marked.where("rows is null").select(*read.columns, F.lit(0).alias("n")).union(chunks.select(*read.columns, each.alias("n")))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, bytes, key (a hash of the url), n, and ``first``, ``first_key`` of the response that a revisit refers to."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    read = read.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("long"), "key": F.md5(F.concat_ws(":", F.col("url").isNull().cast("string"), "url").cast("binary"))})
    read = read.withColumn("same", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "key", "digest"))
    seen = materialise(read.select("page_id", "digest", "bytes", "key", "same"), "warc-digests")
    total = seen.count()
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")).alias("least")
    repeated = seen.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("k"), least).where("k > 1")
    repeated = materialise(repeated.select("digest", "k", F.col("least.page_id").alias("first"), F.col("least.key").alias("first_key")), "warc-repeated")
    equal = materialise(seen.groupBy("same").agg(F.count("*").alias("rows")).where("rows > 1"), "warc-equal-rows")
    return _with_held(_dealt(read, equal, total), "digest", repeated, "k", total, "warc-doubtful").drop("k")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the captures of (page_id, url, html) as gzipped archives below ``path``."""
    found = captures(pages).withColumn("revisit", F.col("first_key").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("first_key")) & (F.col("n") == 0)))
    ids = {kind: _record_id(kind, F.col("page_id"), F.col("key"), F.col("digest"), F.col("n")) for kind in ("request", "response", "metadata")}
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    response = ids["response"]
    tied = F.concat(F.lit("WARC-Concurrent-To: "), response)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    path_of = F.coalesce(F.nullif(F.regexp_extract(uri, "(?s)://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    get = F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(uri, "(?s)://([^/?#]*)", 1), F.lit("")), F.lit(END))
    refers = [F.when(F.col("revisit"), F.concat(F.lit(name), value)) for name, value in (("WARC-Refers-To: ", _record_id("response", F.col("first"), F.col("first_key"), F.col("digest"), F.lit(0))), ("WARC-Profile: ", F.lit(PROFILE)))]
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    records = F.array(
        _record("request", ids["request"], get, "application/http;msgtype=request", target, tied),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), response, F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload"))), "application/http;msgtype=response", target, digest, *refers),
        _record("metadata", ids["metadata"], F.concat(F.lit("fetched: yes\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))), "application/warc-fields", target, tied),
    )
    found.select(F.explode(records).alias("value")).write.options(lineSep=END, compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(path)


class Stream:
    """Cuts a stream of archive bytes into records; holds one record."""

    def __init__(self) -> None:
        self.held, self.head, self.wanted, self.size, self.damaged = bytearray(), None, 0, 0, 0

    def _skipped(self) -> Iterator[tuple[None, int]]:
        if self.damaged:
            yield None, self.damaged
            self.damaged = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes | int]]:
        """Add bytes; yields (headers by lower-case name, block) of each record that is now whole, or (None, bytes) of what is no record."""
        self.held += data
        while True:
            if self.head is None:
                start = 0
                while self.held[start : start + 2] == b"\r\n":
                    start += 2
                end = self.held.find(b"\r\n\r\n", start)
                if end < 0:
                    return
                lines = bytes(self.held[start:end]).decode("utf-8", "replace").split("\r\n")
                pairs = (x.partition(":") for x in lines[1:])
                head = {k.strip().lower(): v.strip() for k, _, v in pairs}
                del self.held[: end + 4]
                length = head.get("content-length", "")
                if not lines[0].startswith("WARC/") or not (length.isascii() and length.isdigit()):
                    self.damaged += end + 4 - start
                    continue
                self.head, self.wanted, self.size = head, int(length), end + 4 - start
            if len(self.held) < self.wanted + 4:
                return
            head, self.head = self.head, None
            if self.held[self.wanted : self.wanted + 4] != b"\r\n\r\n":
                self.damaged += self.size  # the length is wrong; what follows the headers is looked through
                continue
            block = bytes(self.held[: self.wanted])
            del self.held[: self.wanted + 4]
            yield from self._skipped()
            yield head, block

    def finish(self) -> Iterator[tuple[dict[str, str] | None, bytes | int]]:
        """What is left when the archive has ended."""
        while self.head is not None:
            self.head, self.damaged = None, self.damaged + self.size
            yield from self.feed(b"")
        self.damaged += len(self.held.strip(b"\r\n"))
        yield from self._skipped()


def _parsed(head: dict[str, str] | None, block: bytes | int, with_payload: bool) -> dict:
    """A row of ``RECORD_SCHEMA``; a revisit's size and digest are what its headers say of the full payload."""
    if head is None:
        return {"type": DAMAGED, "payload_bytes": block, "intact": False, "fields": []}
    kind, fields, payload = head.get("warc-type"), {}, b""
    lines, _, rest = block.partition(b"\r\n\r\n")
    if kind in ("response", "revisit", "request"):
        payload = rest
        fields = {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, c, v in (x.partition(b":") for x in lines.split(b"\r\n")[1:]) if c}
    elif head.get("content-type") == "application/warc-fields":
        fields = {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, c, v in (x.partition(b":") for x in block.split(b"\r\n")) if c}
    else:
        payload = block
    said = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    intact = said is None or said == digest
    if kind == "revisit":
        length = fields.get("content-length", "")
        digest, size, intact = said, int(length) if length.isascii() and length.isdigit() else 0, True
    row = {"record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date")}
    return row | {"payload_bytes": size, "payload_digest": digest, "intact": intact, "fields": list(fields.items()), "payload": payload if with_payload else None}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, tolerant: bool = False) -> DataFrame:
    """The records of the gzipped archives below ``path``, in ``RECORD_SCHEMA``.

    tolerant: a file whose compression is broken is read up to there. That passes over errors of the file system too, so
    it is off by default and such a file is an error.
    """
    text, number, flag = pa.string(), pa.int64(), pa.bool_()
    types = [text] * 6 + [number, text, flag, pa.map_(text, text), pa.binary()]
    schema = pa.schema([(x.split()[0], t) for x, t in zip(RECORD_SCHEMA.replace("map<string, string>", "map").split(", "), types, strict=True)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, size, file = Stream(), [], 0, None
        for batch in batches:
            for piece, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = stream.finish() if own != file else ()
                rows += [_parsed(head, block, with_payload) for head, block in found]
                stream, file = (Stream(), own) if own != file else (stream, file)
                for head, block in stream.feed(piece.as_py() + b"\r\n\r\n"):
                    rows.append(_parsed(head, block, with_payload))
                    size += len(block) if with_payload and head is not None else 200
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        rows += [_parsed(head, block, with_payload) for head, block in stream.finish()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    lines = spark.read.option("lineSep", END).option("ignoreCorruptFiles", tolerant).text(path)
    return lines.select(F.col("value").cast("binary"), F.xxhash64("_metadata.file_path").alias("file")).mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, response, request and metadata (structs, null where there is none)."""
    columns = [c for c in records.columns if c != "concurrent_to"]
    main = records.where("type in ('response', 'revisit')").select("record_id", "target_uri", F.struct(*columns).alias("response"))
    for kind in ("request", "metadata"):
        side = records.where(F.col("type") == kind).select(F.col("concurrent_to").alias(f"_{kind}"), F.struct(*columns).alias(kind))
        main = main.join(side, F.col("record_id") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    return main


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = materialise(read_archives(spark, path, with_payload=False), "warc-records")
    found = assemble(records).select("record_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "response")
    found = materialise(found, "warc-captures")
    revisits = found.where("response.refers_to is not null").withColumn("_id", F.col("response.refers_to"))
    named = found.where("response.type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"))
    named = revisits.groupBy("_id").agg(F.count("*").alias("rows")).join(named, "_id")
    others = found.where("response.refers_to is null").withColumn("refers_to", F.lit(None).cast("long"))
    joined = others.unionByName(lookup(revisits, named, "_id", "rows", found.count()).select(*others.columns))
    return joined.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
