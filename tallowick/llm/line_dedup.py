"""Line deduplication with two Bloom filters.

Pass one: every task sets, for the distinct line keys of each of its documents,
the bits of a once-seen filter, and of a twice-seen filter for the keys that the
once-seen filter already holds.  Merging two filters moves the bits that both
once-seen filters have into the twice-seen filter, so a key of two documents is
never missed.  Pass two: only keys that the twice-seen filter holds are shuffled;
their documents are counted exactly, by the key's text, and the repeats removed.

A filter is cut into chunks that tasks emit as bit positions where these are
shorter.  Filters have eight bits for each line of the table, between ``LEAST_BITS``
and ``MOST_BITS``, which bounds what a task holds and what is broadcast (32 MB).
Beyond some 30 million different lines they fill up: pass two then shuffles more of the
lines, up to all, and no result changes; larger executors may raise ``MOST_BITS``.

Key of a line: ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z lower-cased.  Each
row counts as one document, repeated rows and null ids included; a null or empty
text is one empty line.  Empty keys are never repeats.  Extra columns are kept; one
that has the name of a result is replaced by it.  With ``keep_first``, rows equal in id and
text are one first occurrence, and all keep the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
CHUNK = 1 << 16
#: a key's lines are spread over this many tasks when they are marked
SALTS = 16


def _lines(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the lines with a word: row, number in the row, begin and end of the key; then the buffer."""
    data, offs = K.flat(column)
    starts, ends, row = K.words(data, offs)
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    line = np.searchsorted(begin, starts, side="right") - 1
    first = np.flatnonzero(np.diff(line, prepend=-1))
    last = np.append(first[1:] - 1, len(line) - 1) if len(first) else first
    of = row[first]
    number = np.searchsorted(feeds, starts[first]) - np.searchsorted(feeds, offs[of])
    return of, number, starts[first], ends[last], data


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(bits)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _packed(chunk: np.ndarray) -> bytes:
    """A chunk of a bitmap as its bit positions or as it is, whichever is shorter."""
    at = np.flatnonzero(np.unpackbits(chunk))
    return b"p" + at.astype(np.uint16).tobytes() if len(at) * 16 < CHUNK else b"b" + chunk.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1).copy()
    packed = np.zeros(CHUNK // 8, np.uint8)
    K.set_bits(packed, np.frombuffer(data, np.uint16, offset=1).astype(np.int64))
    return packed


def _filters(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for part in K.pieces(batch, "text"):
            row, _, begin, end, data = _lines(part.column("text"))
            hashes = K.span_hash(data, begin, end, lower=True)
            # A key counts once in a document.
            own = K.mix(hashes ^ K.mix(row.astype(np.uint64)))
            hashes = hashes[np.unique(own, return_index=True)[1]]
            hashes, times = np.unique(hashes, return_counts=True)
            a, b = _bits(hashes, bits)
            again = (times > 1) | (K.bit_set(once, a) & K.bit_set(once, b))
            K.set_bits(twice, np.concatenate([a[again], b[again]]))
            K.set_bits(once, np.concatenate([a, b]))
    once, twice = once.reshape(-1, CHUNK // 8), twice.reshape(-1, CHUNK // 8)
    chunks = np.flatnonzero(once.any(1))
    for at in range(0, len(chunks), 256):
        own = chunks[at : at + 256]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([_packed(once[c]) for c in own], pa.binary()), pa.array([_packed(twice[c]) for c in own], pa.binary())], ["chunk", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for chunk, once, twice in zip(*(batch.column(c).to_pylist() for c in ("chunk", "once", "twice")), strict=True):
            a, b = _unpacked(once), _unpacked(twice)
            if chunk in held:
                seen = held[chunk]
                seen[1] |= b | (seen[0] & a)
                seen[0] |= a
            else:
                held[chunk] = [a, b]
    found = [(c, t.tobytes()) for c, (_, t) in sorted(held.items()) if t.any()]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([t for _, t in found], pa.binary())], ["chunk", "twice"])


def _size(rows: DataFrame) -> int:
    """Bits for the filters of ``rows``: a power of two."""
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * int(lines) - 1).bit_length()))


def twice_seen(rows: DataFrame, bits: int) -> np.ndarray:
    """The packed twice-seen filter of the lines of column ``text``: ``bits / 8`` bytes."""
    made = rows.select("text").mapInArrow(lambda x: _filters(x, bits), "chunk int, once binary, twice binary")
    merged = made.repartition("chunk").mapInArrow(_merge, "chunk int, twice binary")
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for r in merged.collect():  # bits / 8 bytes in all, whatever the corpus
        out[r["chunk"]] = np.frombuffer(r["twice"], np.uint8)
    return out.reshape(-1)


def _suspects(batches: Iterator[pa.RecordBatch], shared, bits: int) -> Iterator[pa.RecordBatch]:
    packed = shared.value
    for batch in batches:
        for part in K.pieces(batch, "text"):
            row, number, begin, end, data = _lines(part.column("text"))
            a, b = _bits(hashes := K.span_hash(data, begin, end, lower=True), bits)
            hit = np.flatnonzero(K.bit_set(packed, a) & K.bit_set(packed, b))
            if not len(hit):
                continue
            raw = K.LOWER[data].tobytes()
            own = K.mix(hashes[hit] ^ K.mix(row[hit].astype(np.uint64)))
            new = np.zeros(len(hit), np.int64)
            new[np.unique(own, return_index=True)[1]] = 1
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row[hit])), part.column("text_hash").take(pa.array(row[hit])), pa.array(number[hit], pa.int32()), pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(begin[hit], end[hit], strict=True)], pa.string()), pa.array(new)], ["id", "text_hash", "line", "key", "first"])


def repeated_lines(rows: DataFrame, min_docs: int, bits: int | None = None, keep_first: bool = False) -> DataFrame:
    """``id``, ``text_hash`` and ``dropped``, the numbers of the lines to remove, for documents that lose a line."""
    bits = bits or _size(rows)
    shared = rows.sparkSession.sparkContext.broadcast(twice_seen(rows, bits))
    found = keep(rows.mapInArrow(lambda x: _suspects(x, shared, bits), "id long, text_hash long, line int, key string, first long"), "suspects")
    counted = found.groupBy("key").agg(F.sum("first").alias("docs"), F.min(F.struct("id", "text_hash", "line")).alias("first_at")).filter(F.col("docs") >= min_docs)
    # A key found in very many documents: its lines meet copies of its row in several tasks.
    often = keep(counted, "often").select("key", "first_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hit = found.withColumn("salt", F.pmod(F.xxhash64("text_hash", "line"), F.lit(SALTS)).cast("int")).join(often, ["key", "salt"])
    if keep_first:
        hit = hit.filter(~F.struct("id", "text_hash", "line").eqNullSafe(F.col("first_at")))
    return hit.groupBy("id", "text_hash").agg(F.collect_set("line").alias("dropped"))


def _without(text: pd.Series, dropped: pd.Series) -> pd.Series:
    """The texts without the numbered lines; rows that lose none are null here and stay so."""
    out = []
    for t, d in zip(text, dropped, strict=True):
        gone = set() if d is None else set(d)
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, bits: int | None = None, keep_first: bool = False, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """All columns of ``docs`` with the repeated lines removed from the text, then ``n_lines`` and ``n_dropped``.

    Keys found in at least ``min_docs`` documents lose all their lines, or with
    ``keep_first`` all but the one of the smallest id and line.  ``n_lines`` counts
    the lines before dropping; a null text stays null.
    """
    row_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_id.alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    dropped = repeated_lines(rows, min_docs, bits, keep_first)
    joined = docs.withColumns({"_tw_id": row_id, "_tw_hash": F.xxhash64(text)}).join(dropped.select(F.col("id").alias("_tw_id2"), F.col("text_hash").alias("_tw_hash2"), F.col("dropped").alias("_tw_dropped")), F.col("_tw_id").eqNullSafe(F.col("_tw_id2")) & (F.col("_tw_hash") == F.col("_tw_hash2")), "left")
    hit = F.col("_tw_dropped").isNotNull()
    left = F.when(hit, F.pandas_udf(_without, "string")(F.when(hit, text), F.col("_tw_dropped"))).otherwise(F.col(text_col))
    own = [left.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in (lines_col, dropped_col)]
    return joined.select(*own, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(lines_col), F.coalesce(F.size("_tw_dropped"), F.lit(0)).cast("long").alias(dropped_col))
