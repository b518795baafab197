"""WARC archives: writing, and reading by boundary-chain verification.

Archives are written by Spark's text writer, so they go to any store Spark writes
to.  For reading, Spark splits files at the magic ``WARC/1.`` and every piece is only
a candidate: a payload may hold the magic, or whole records.  While a task reads a
block, it emits for each candidate its place and the place of its successor, worked out from
Content-Length, and joins neighbours that succeed each other into runs.  Pointer
jumping over runs from the start of each file, doubling the jumps each round, finds
the runs on the chain; everything else is payload.  Payloads that hold the magic are
put together from their pieces in a second read of the files that have such records.

Where a chain breaks, as in a file cut short, the records from there on are not
returned.  Archives are uncompressed.

Writing: a null payload is empty; a null url or id leaves its header out; equal rows
are all written.  Among payloads of at least ``least`` bytes that are equal, that with the smallest id
is the response and the others revisit it; rows without an id revisit too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.llm.workspace import keep

MAGIC = "WARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORDS_PER_FILE = 200_000


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> None:
    """One record for each row, as files of ``RECORDS_PER_FILE`` records at most below ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    equal = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Written, so that its true size decides how it is joined.
    joined = rows.join(keep(equal.select("digest", "first"), "equal-payloads"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line: list[Column] = [
        F.lit("WARC/1.0"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.when(F.col("id").isNotNull(), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("id"), F.lit(">"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))),
        F.when(revisit, f"WARC-Profile: {PROFILE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("size")) + len(HTTP)),
    ]
    record = F.concat(F.concat_ws("\r\n", *line), F.lit("\r\n\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    joined.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELD = re.compile(rb"(?im)^(content-length|warc-type|warc-record-id|warc-refers-to|warc-target-uri|warc-payload-digest)[ \t]*:[ \t]*(.*?)[ \t]*\r?$")
SEGMENT = "file string, block long, rel long, size long, run long, head long, length long, type string, record_id string, refers_to string, uri string, said string, digest string, payload_bytes long"


def _payload(block: bytes) -> bytes:
    """The payload of an HTTP message; a block of another kind is all payload."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with the places of their successors, relative to the block, and the run each belongs to."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in SEGMENT.split(", ")]
    at, place, run, due = None, 0, 0, None
    for batch in batches:
        out = []
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if at != (file, block):
                at, place, due = (file, block), 0, None
            head, gap, rest = value.partition(b"\r\n\r\n")
            fields = {k.lower(): v for k, v in _FIELD.findall(head)} if gap and re.match(rb"\d+\r?\n", head) else {}
            length = fields.get(b"content-length", b"")
            row = [file, block, place, len(value) + len(MAGIC), *[None] * 10]
            if length.isdigit() and len(length) < 16:
                length = int(length)
                run = run if due == place else place
                due = place + len(MAGIC) + len(head) + 4 + length + 4
                text = [fields.get(k, b"").decode("utf-8", "replace") or None for k in (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest")]
                body = _payload(rest[:length]) if length <= len(rest) else None
                row[4:] = [run, len(head), length, *text, None if body is None else hashlib.sha256(body).hexdigest(), None if body is None else len(body)]
            else:
                due = None
            place += len(value) + len(MAGIC)
            out.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, place = None, 0
    for batch in batches:
        rels = []
        for file, block, size in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), pc.binary_length(batch.column("value")).to_pylist(), strict=True):
            if at != (file, block):
                at, place = (file, block), 0
            rels.append(place)
            place += size + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(rels, pa.int64()), batch.column("value")], ["file", "block", "rel", "value"])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _join_pieces(pieces: list, head: int, length: int) -> bytes | None:
    """The payload put together; None where the file ends before the record does."""
    whole = MAGIC.encode().join(bytes(p["value"]) for p in sorted(pieces, key=lambda p: p["at"]))
    block = whole[head + 4 : head + 4 + length]
    return _payload(block) if len(block) == length else None


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            body = _join_pieces(row["pieces"], row["head"], row["length"])
            if body is None:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["at"]], pa.int64()), pa.array([hashlib.sha256(body).hexdigest()]), pa.array([len(body)], pa.int64())], ["file", "at", "whole_digest", "whole_bytes"])


def chain(candidates: DataFrame) -> DataFrame:
    """``file, run, entry``: the runs on the chain from the start of each file, and where it enters them.

    ``candidates`` has ``file, at, run, next``; ``next`` is the successor's place.
    """
    start = candidates.filter("at = 0").select("file", "run", F.col("at").alias("entry"))
    exits = candidates.groupBy("file", "run").agg(F.max_by("next", "at").alias("at")).withColumnRenamed("run", "from")
    jump = keep(exits.join(candidates.select("file", "at", "run"), ["file", "at"]).select("file", "from", F.col("run").alias("to"), F.col("at").alias("entry")), "jumps")
    reached = keep(start, "reached")
    size, before = reached.count(), -1
    while size > before:
        step = reached.select("file", F.col("run").alias("from")).join(jump, ["file", "from"]).select("file", F.col("to").alias("run"), "entry")
        reached = keep(reached.union(step).distinct(), "reached")
        jump = keep(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.from"))).select("a.file", "a.from", "b.to", "b.entry"), "jumps")
        size, before = reached.count(), size
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, type, record_id, refers_to, uri, said, digest, payload_bytes`` for each record on a file's chain.

    ``at`` is the record's offset; ``said`` is the payload's digest as its header has it; ``digest`` and
    ``payload_bytes`` are of the payload that the record itself holds.
    """
    segments = keep(_pieces(spark, path).mapInArrow(_segments, SEGMENT), "segments")
    # A block begins where those before it end; the file's first piece comes before any magic.
    blocks = segments.groupBy("file", "block").agg(F.sum("size").alias("size"))
    base = blocks.selectExpr("file", "block", f"coalesce(sum(size) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0) - {len(MAGIC)} as base")
    placed = segments.join(base, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel")).withColumn("run", F.col("base") + F.col("run"))
    placed = keep(placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + 8 + F.col("length")).drop("base", "rel", "block"), "candidates")
    candidates = placed.filter("run is not null and at >= 0")
    reached = chain(candidates)
    records = keep(candidates.join(reached, ["file", "run"]).filter("at >= entry"), "records")
    out = records.select("file", "at", "type", "record_id", "refers_to", "uri", "said", "digest", "payload_bytes")
    broken = records.filter("digest is null").select("file", "at", "head", "length")
    if broken.isEmpty():
        return out
    own = placed.join(broken.select("file").distinct(), "file", "left_semi").select("file", "at")
    marked = own.join(records.select("file", "at", F.col("at").alias("owner")), ["file", "at"], "left")
    owned = marked.selectExpr("file", "at", "last(owner, true) over (partition by file order by at rows between unbounded preceding and current row) as owner")
    needed = owned.join(broken.select("file", F.col("at").alias("owner"), "head", "length"), ["file", "owner"])
    raw = _pieces(spark, path).mapInArrow(_raw, "file string, block long, rel long, value binary").join(base, ["file", "block"]).select("file", (F.col("base") + F.col("rel")).alias("at"), "value")
    whole = needed.join(raw, ["file", "at"]).groupBy("file", "owner", "head", "length").agg(F.collect_list(F.struct("at", "value")).alias("pieces")).withColumnRenamed("owner", "at")
    made = whole.select("file", "at", "head", "length", "pieces").mapInArrow(_assembled, "file string, at long, whole_digest string, whole_bytes long")
    return out.join(made, ["file", "at"], "left").select("file", "at", "type", "record_id", "refers_to", "uri", "said", F.coalesce("digest", "whole_digest").alias("digest"), F.coalesce("payload_bytes", "whole_bytes").alias("payload_bytes")).filter("digest is not null")


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, revisits with their response's payload.

    Ids may repeat, so a revisit's response is the one of the id it refers to whose
    payload has the digest in the revisit's header.
    """
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    own = F.col("type") == "response"
    digest = F.when(own, F.col("digest")).otherwise(F.regexp_extract("said", "^sha256:([0-9a-f]{64})$", 1))
    rows = records.select(number("record_id").alias("page_id"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), digest.alias("payload_digest"), F.col("payload_bytes").alias("own_bytes"))
    said = rows.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("bytes"))
    wanted = said.join(rows.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi")
    both = rows.join(keep(wanted, "referred"), ["refers_to", "payload_digest"], "left")
    return both.select("page_id", F.when(F.col("record_type") == "response", F.col("own_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
