"""WARC archives written and read back, records found by boundary-chain verification.

Writing: one record per page, ``response`` or, where a page with the same payload of
``least`` bytes or more and a larger id exists, ``revisit`` without payload.  Archives
are plain files; each task writes its own.

Reading: the archives are split at every magic line, wherever it stands, by Spark's own
splittable text reader, so tasks see parts of a file and pieces that may lie inside a
payload.  A task emits every piece that parses as a record header as a candidate: its
offset, and the offset at which its successor must start.  Inside a split the chain of
each candidate is followed to the first offset beyond the split; across splits pointers
are doubled from the file start (offset 0), so the number of passes is the logarithm of
the splits of a file.  Only candidates on the chain from offset 0 are records: a magic
line inside a payload is never the successor of one.  Payloads that hold magic lines are
put together again from their pieces.

Offsets come from piece lengths: pieces tile a file, so a piece starts where those
before it end.

Defined results: null html is an empty payload; null urls have no target; a null page
id is smaller than any other, and pages of a group without ids are all responses;
repeated rows that hold the largest id are all responses; a chain that breaks ends the
records of its file; empty tables give no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import scratch_path, written

# fixed values of the format
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payload bytes from which on an equal payload is not written again.
LEAST = 1000
#: Records of one archive file at most.
RECORDS = 50_000

_NAME = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to")


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, bytes, keeper (id of the response that holds the payload) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"))
    copies = (
        rows.where(F.col("bytes") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("c")).where("c > 1 and keeper is not null").select("digest", "keeper")
    )
    # written first: its size decides how the pages meet it, and without copies no page moves
    return rows.join(written(copies, "copies"), "digest", "left")


def write_archives(pages: DataFrame, path: str, least: int = LEAST, records: int = RECORDS, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all ``pages`` (page_id, url, html) in the new folder ``path``."""
    rows = plan_records(pages, least)
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    # a line break in a url would end the header line
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("keeper"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(revisit, "").otherwise(F.col("html"))
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of its split) and bytes of every piece between magic lines, in file order within a split."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def parse_head(piece: bytes) -> tuple[int, int, list[str | None]] | None:
    """(header length, payload length, fields) of a piece that starts right after a magic line; None if it is no record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = {m[1].strip().lower().decode("latin-1"): m[2].strip() for m in _NAME.finditer(piece, 0, end)}
    length = found.get("content-length", b"")
    if not length.isdigit() or "warc-type" not in found:
        return None
    return end + 4, int(length), [found[f].decode("utf-8", "replace") if f in found else None for f in _FIELDS]


_ROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("rel", pa.int64()), ("succ", pa.int64()), ("leaves", pa.int64()), ("total", pa.int64())]
    + [(c, pa.string()) for c in ("type", "id", "uri", "refers")] + [("bytes", pa.int64()), ("digest", pa.string())]
)
_ROW_DDL = "file string, block bigint, nth bigint, rel bigint, succ bigint, leaves bigint, total bigint, type string, id string, uri string, refers string, bytes bigint, digest string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece, with offsets relative to the split's first piece: of its magic line (``rel``), of the successor
    and of the first offset beyond the split on its chain (both null for a piece that is no candidate)."""
    magic = len(MAGIC)
    current, rows, at = None, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            leaves: dict[int, int] = {}
            for r in reversed(rows):  # a successor lies further on
                if "succ" in r:
                    r["leaves"] = leaves[r["rel"]] = leaves.get(r["succ"], r["succ"])
                r["total"] = at
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 20_000], _ROW)

    for batch in batches:
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
            if (file, block) != current:
                yield from flush()
                current, rows, at = (file, block), [], 0
            piece = value.as_buffer().to_pybytes()
            row = {"file": file, "block": block, "nth": len(rows), "rel": at - magic}
            head = parse_head(piece) if block or rows else None  # what precedes the first magic line is no record
            if head:
                start, length, fields = head
                row |= dict(zip(("type", "id", "uri", "refers"), fields)) | {"bytes": length, "succ": at + start + length + len(END)}
                if start + length <= len(piece):
                    row["digest"] = hashlib.sha1(piece[start : start + length]).hexdigest()
            rows.append(row)
            at += len(piece) + magic
    yield from flush()


def _on_chain(key: tuple, group: pa.Table) -> pa.Table:
    """The rows of one split that the chain from its entry reaches."""
    entry = group.column("entry")[0].as_py()
    at, succ = group.column("offset").to_pylist(), group.column("succ").to_pylist()
    row_of = {a: i for i, (a, s) in enumerate(zip(at, succ)) if s is not None}
    keep, a = [], entry
    while a in row_of:
        keep.append(row_of[a])
        a = succ[row_of[a]]
    return group.take(pa.array(keep, pa.int64()))


def verified_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(records, rows)``: the verified records (file, block, nth, offset, succ, type, id, uri, refers, bytes, digest
    - null if the payload holds magic lines), and all pieces (file, block, nth, offset)."""
    scanned = written(_pieces(spark, path).mapInArrow(_scan, _ROW_DDL), "pieces")
    splits = scanned.groupBy("file", "block").agg(F.first("total").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = written(
        scanned.join(base, ["file", "block"])
        .select("file", "block", "nth", (F.col("rel") + F.col("base")).alias("offset"), *((F.col(c) + F.col("base")).alias(c) for c in ("succ", "leaves")), "type", "id", "uri", "refers", "bytes", "digest"),
        "candidates",
    )
    entries = reachable(rows.where("succ is not null").select("file", "offset", F.col("leaves").alias("next")))
    starts = entries.join(rows.select("file", "offset", "block"), ["file", "offset"]).select("file", "block", F.col("offset").alias("entry"))
    on = rows.join(starts, ["file", "block"]).groupBy("file", "block").applyInArrow(_on_chain, rows.join(starts, ["file", "block"]).schema)
    return on.drop("entry", "leaves"), rows.select("file", "block", "nth", "offset")


def reachable(jumps: DataFrame) -> DataFrame:
    """The offsets (file, offset) of ``jumps`` (file, offset, next) that are reached from offset 0, by pointer doubling."""
    targets = jumps.select("file", F.col("next").alias("offset")).distinct()
    zero = jumps.where("offset = 0").select("file", "offset")
    jumps = written(jumps.join(targets.union(zero).distinct(), ["file", "offset"], "left_semi"), "jumps")
    known = jumps.select("file", "offset")
    reached = written(zero, "reached")
    while not jumps.isEmpty():
        far = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("further"))
        more = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        more = more.join(known, ["file", "offset"], "left_semi")
        reached = written(reached.union(more).distinct(), "reached")
        jumps = written(jumps.join(far, ["file", "next"]).select("file", "offset", F.col("further").alias("next")), "jumps")
    return reached


def _whole_payloads(spark: SparkSession, path: str, records: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, offset and payload of the ``wanted`` records (file, offset), put together from their pieces."""
    files = wanted.select("file").distinct()
    start = records.select("file", "offset", F.col("offset").alias("record"))
    last = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.join(files, "file").join(start, ["file", "offset"], "left").withColumn("record", F.last("record", ignorenulls=True).over(last))
    owned = written(owned.join(wanted.select("file", F.col("offset").alias("record")), ["file", "record"]).select("file", "block", "nth", "record"), "owned")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n = None, 0
        for batch in batches:
            nth = []
            for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                current, n = (key, 0) if key != current else (current, n + 1)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], [*batch.schema.names, "nth"])

    def join_up(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("nth", "ascending")])
        whole = MAGIC.encode().join(group.column("value").to_pylist())
        start, length, _ = parse_head(whole)
        return pa.table({"file": [key[0].as_py()], "offset": [key[1].as_py()], "payload": [whole[start : start + length]]}, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())]))

    pieces = _pieces(spark, path).mapInArrow(number, "file string, block bigint, value binary, nth bigint")
    return pieces.join(owned, ["file", "block", "nth"]).groupBy("file", "record").applyInArrow(join_up, "file string, offset bigint, payload binary")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives in ``path``: file, offset, type, id, uri, refers, bytes, digest (SHA-1 of the
    payload as it stands in the archive) and, if asked, the payload."""
    records, rows = verified_records(spark, path)
    records = written(records, "records")
    wanted = records.select("file", "offset") if payload else records.where("digest is null").select("file", "offset")
    out = records.select("file", "offset", "type", "id", "uri", "refers", "bytes", "digest")
    if wanted.isEmpty():
        return out.withColumn("payload", F.lit(None).cast("binary")) if payload else out
    whole = _whole_payloads(spark, path, records, rows, wanted)
    if payload:
        return out.drop("digest").join(whole, ["file", "offset"]).withColumn("digest", F.sha1("payload"))
    late = written(whole.select("file", "offset", F.sha1("payload").alias("late")), "digests")
    return out.join(late, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "late")).drop("late")


def page_of(urn: Column) -> Column:
    """The page id in <urn:page:...>, null if there is none."""
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")).try_cast("bigint")


def pages_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``pages`` written to archives and read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.
    Of a revisit, payload bytes and digest are those of the response it refers to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path)
    read = read_archives(spark, path).select(
        page_of(F.col("id")).alias("page_id"), F.col("uri").alias("url"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page_of(F.col("refers")).alias("refers_to")
    )
    read = written(read, "read")
    response = read.where("record_type = 'response'")
    held = (
        read.where("refers_to is not null").select("refers_to").distinct()
        .join(response.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")), "refers_to")
        .dropDuplicates(["refers_to"])
    )
    revisit = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(written(held, "held"), "refers_to")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(columns).union(revisit.select("page_id", "url", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"))
