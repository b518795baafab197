"""Fingerprints of documents as sums of their paragraphs' vectors.

A text's paragraphs (split at ``\\n``) are each hashed to a wide vector, and the vectors are
added modulo powers of two, lane by lane.  So the fingerprint doesn't depend on the
paragraphs' order, and a paragraph is put in or taken out by one addition or subtraction
(``added``, ``removed``).  A vector has three kinds of lanes:

* the number of sentences, modulo ``2 ** 32``;
* ``WIDE`` numbers modulo ``2 ** 16`` from SHAKE-128 of the paragraph, which tell
  different multisets of paragraphs apart;
* ``SIGNS`` sums of +1 or -1 modulo ``2 ** 16``, one for each of the paragraph's sentences,
  from BLAKE2b.  For two texts the squared difference of such a lane is expected to be
  the number of sentences that only one of them has, which ``likeness`` sets against the
  number of all, with a standard error of ``sqrt(2 / SIGNS)`` of what differs.

Fingerprints are not meant to withstand forgers.

The edited text of a document ends in the beginning of the next one.  Documents are dealt
out by ranges of their ids, so that a task has both; after the last one of a range comes a
copy of the first one of the next range.  The ranges' bounds are places in a sample of
``SAMPLED`` ids for each range; they settle which task does what and no result.

Defined results: a null text is empty, and an empty text one empty paragraph; null ids
come first; rows of one id follow by their texts' hash, so repeated rows are neighbours; the
only row is its own next; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256, shake_128

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE, SIGNS = 64, 128
_MASK = np.array([(1 << 32) - 1] + [(1 << 16) - 1] * (WIDE + SIGNS), np.int64)
_SENTENCE = re.compile(rb"(?<=[.!?])\x20")
#: vectors that are made at a time
_MADE = 4096
SAMPLED = 64
RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vector(text: str | None) -> np.ndarray:
    """The sum of the vectors of a text's paragraphs."""
    total = np.zeros(len(_MASK), np.int64)
    paragraphs = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    for i in range(0, len(paragraphs), _MADE):
        drawn = b"".join(shake_128(p).digest(2 * WIDE) for p in paragraphs[i : i + _MADE])
        total[1 : 1 + WIDE] += np.frombuffer(drawn, "<u2").reshape(-1, WIDE).sum(0, dtype=np.int64)
        sentences = [s for p in paragraphs[i : i + _MADE] for s in _SENTENCE.split(p)]
        total[0] += len(sentences)
        for j in range(0, len(sentences), _MADE):
            drawn = b"".join(blake2b(s, digest_size=SIGNS // 8).digest() for s in sentences[j : j + _MADE])
            bits = np.unpackbits(np.frombuffer(drawn, np.uint8)).reshape(-1, SIGNS)
            total[1 + WIDE :] += 2 * bits.sum(0, dtype=np.int64) - len(bits)
    return total & _MASK


def added(fingerprint: np.ndarray, paragraphs: str) -> np.ndarray:
    """The fingerprint with more paragraphs."""
    return (fingerprint + vector(paragraphs)) & _MASK


def removed(fingerprint: np.ndarray, paragraphs: str) -> np.ndarray:
    """The fingerprint without some of its paragraphs."""
    return (fingerprint - vector(paragraphs)) & _MASK


def written(fingerprint: np.ndarray) -> str:
    return f"{int(fingerprint[0]):08x}" + fingerprint[1:].astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How much of the sentences of two texts is common to both, from 0 to 1; 1 for equal fingerprints."""
    if (a == b).all():
        return 1.0
    apart = (a - b)[1 + WIDE :].astype(np.uint16).view(np.int16).astype(np.int64)
    return float(max(0.0, 1.0 - (apart * apart).sum() / SIGNS / max(1, int(a[0] + b[0]))))


def _spliced(text: str, own: np.ndarray, after: str) -> tuple[str, np.ndarray]:
    """The edited text and its fingerprint, from the paragraphs that the edit takes and gives."""
    half = len(text) // 2
    cut = len(text) - half
    edited = text[:cut] + after[:half]
    begin = text.rfind("\n", 0, cut) + 1  # of the paragraph that holds the cut
    if edited[begin:] == text[begin:]:
        return edited, own
    return edited, added(removed(own, text[begin:]), edited[begin:])


def _row(doc_id: int | None, text: str, own: np.ndarray, after: str, beyond: np.ndarray) -> tuple:
    edited, changed = _spliced(text, own, after)
    return doc_id, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, beyond)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, str]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in ("place", "guest", "id", "text"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of the rows of whole ranges, each with the row behind it; a guest is only such a row."""
    rows, last = [], None
    for place, guest, doc_id, text in _texts(batches):
        own = vector(text)
        if last and last[0] == place:
            rows.append(_row(*last[1:], text, own))
            if len(rows) == 512:
                yield _batch(rows)
                rows = []
        last = None if guest else (place, doc_id, text, own)
    if rows:
        yield _batch(rows)


def _keys(columns: pd.DataFrame) -> np.ndarray:
    """Bytes that sort as rows of whole numbers do."""
    flipped = columns.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.frombuffer(flipped.astype(">u8").tobytes(), f"S{8 * flipped.shape[1]}")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.coalesce("id", F.lit(-(1 << 63))), F.col("hash"), F.col("row")]
    ranges = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * ranges / max(1, docs.count()))
    drawn = np.sort(_keys(rows.select(*(c.alias(f"k{i}") for i, c in enumerate(order))).sample(share, seed=12).toPandas()))  # SAMPLED rows for each range
    bounds = np.unique(drawn[np.linspace(0, len(drawn), ranges, endpoint=False).astype(np.int64)[1:]]) if len(drawn) else drawn
    place = F.pandas_udf(lambda a, b, c: pd.Series(np.searchsorted(bounds, _keys(pd.concat([a, b, c], axis=1)), side="right").astype(np.int32)), "int")
    placed = rows.withColumn("place", place(*order))
    # A row for each range, without the texts.
    first = placed.groupBy("place").agg(F.min(F.struct("id", "hash")).alias("x")).select("place", "x.*").orderBy("place").collect()
    before = [(r["place"], r["id"], r["hash"], p["place"]) for r, p in zip(first, first[-1:] + first[:-1], strict=True)]
    heads = F.broadcast(spark.createDataFrame(before, "place int, id long, hash long, before int").withColumnsRenamed({"place": "p", "id": "i", "hash": "h"}))
    met = placed.join(heads, (F.col("place") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    guests = met.groupBy("before").agg(F.first("text").alias("text")).select(F.col("before").alias("place"), F.lit(1).alias("guest"), F.lit(None).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("row"))
    dealt = placed.select("place", F.lit(0).alias("guest"), "id", "text", "hash", "row").unionByName(guests).repartition("place")
    return dealt.sortWithinPartitions("place", "guest", "id", "hash", "row").mapInArrow(_ranges, RESULT)
