"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is a short set of shingles that may sit inside the large set of a long
document.  Document shingles that no item holds cannot count towards containment, so
a Bloom filter of the benchmark's shingles, of a fixed size, first thins every
document, read whole, to the shingles that may matter; this changes no containment.
What is left is partitioned by its size, and so are the items.  For a partition of
documents and one of items the containment wanted becomes a lower bound of the
Jaccard similarity, and with it the number of rows a band may have: the most for which
a pair at the bound is missed with a probability of ``miss`` at most.  Where even
bands of one row don't reach that, every shingle is a band of its own, which misses
nothing.  Candidates are confirmed by exact containment of shingles.

Shingles are those of the near-duplicate operator.  Items or documents without
words, or with a null id, match nothing.  Rows with equal ids are judged by their
own texts, and a pair of ids is returned once, with the largest containment.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.minhash_dedup import _lists, _or, signatures
from tallowick.llm.workspace import keep

BITS = 1 << 26
WIDTH = 128
MISS = 1e-6


def _bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (gram % np.uint64(BITS)).astype(np.int64), ((gram >> np.uint64(32)) % np.uint64(BITS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    packed = np.zeros(BITS >> 3, np.uint8)
    for batch in batches:
        for part in K.pieces(batch, "text"):
            for at in _bits(K.shingles(part.column("text"), size)[0]):
                K.set_bits(packed, at)
    blocks = packed.reshape(-1, 8192)
    for block in np.flatnonzero(blocks.any(1)):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blocks[block].tobytes()])], ["block", "bits"])


def _thin(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.pieces(batch, "text"):
            gram, bounds = K.shingles(part.column("text"), size)
            if shared is not None:
                a, b = _bits(gram)
                hit = K.bit_set(shared.value, a) & K.bit_set(shared.value, b)
                bounds = np.concatenate([[0], np.cumsum(hit)])[bounds]
                gram = gram[hit]
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(full)), _lists(gram, bounds[[*full, len(bounds) - 1]])], ["id", "grams"])


def rows_of(item_class: int, doc_class: int, percent: int, miss: float = MISS) -> int:
    """Rows of a band for items of 2**(c-1)+1..2**c shingles and documents likewise; 0: every shingle is a band."""
    small, large = 2 ** max(0, item_class - 1) + (item_class > 0), 2**doc_class
    need = math.ceil(percent / 100 * small)
    similar = need / max(small, large + small - need)
    for rows in (4, 2, 1):
        if (1 - similar**rows) ** (WIDTH // rows) <= miss:
            return rows
    return 0


def _banded(batches: Iterator[pa.RecordBatch], items: bool, percent: int, classes: int) -> Iterator[pa.RecordBatch]:
    """Keys by which a set is found: for each partition of the other side, in the bands that fit the two."""
    table = [[rows_of(i, d, percent) for d in range(classes)] for i in range(classes)]
    for batch in batches:
        ids, keys = [], []
        column = batch.column("grams")
        bounds = np.asarray(column.offsets).astype(np.int64)
        gram = column.values.to_numpy().view(np.uint64)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        sign = signatures(gram, bounds, WIDTH // 2)
        for n, row_id in enumerate(batch.column("id").to_pylist()):
            own = gram[bounds[n] : bounds[n + 1]]
            c = min(classes - 1, math.ceil(math.log2(len(own))))
            for other in range(classes):
                pair = np.uint64((c * classes + other if items else other * classes + c) << 8)
                rows = table[c][other] if items else table[other][c]
                if rows:
                    parts = sign[n].reshape(-1, rows) * (K.seeds(rows, 41) | np.uint64(1))
                    found = K.mix(parts.sum(1, dtype=np.uint64) + K.seeds(len(parts), 42) + K.mix(np.array([pair + np.uint64(rows)])))
                else:
                    found = K.mix(own + K.mix(np.array([pair])))
                keys.append(found)
                ids.append(np.full(len(found), row_id, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], ["id", "key"])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """``id, item_id, n_item, n_shared``: the items of which a document holds at least ``percent`` % of the shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    tests = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).filter("id is not null")
    merged = tests.mapInArrow(lambda x: _mark(x, size), "block int, bits binary").repartition("block").mapInArrow(_or, "block int, bits binary")
    bits = np.zeros((BITS >> 16, 8192), np.uint8)
    for r in merged.collect():  # BITS / 8 bytes in all
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(-1))
    rough = keep(texts.mapInArrow(lambda x: _thin(x, shared, size), "id long, grams array<long>").withColumn("row", F.monotonically_increasing_id()), "thinned")
    tested = keep(tests.mapInArrow(lambda x: _thin(x, None, size), "id long, grams array<long>").withColumn("row", F.monotonically_increasing_id()), "items")
    most = max(1, tested.agg(F.max(F.size("grams"))).first()[0] or 1, rough.agg(F.max(F.size("grams"))).first()[0] or 1)
    classes = math.ceil(math.log2(most)) + 1
    keys = lambda df, own: df.select(F.col("row").alias("id"), "grams").mapInArrow(lambda x: _banded(x, own, percent, classes), "id long, key long")
    pairs = keys(rough, False).withColumnRenamed("id", "row").join(keys(tested, True).withColumnRenamed("id", "item_row"), "key").select("row", "item_row").distinct()
    both = pairs.join(rough.select("row", "id", F.col("grams").alias("g")), "row").join(tested.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("grams").alias("t")), "item_row")
    exact = both.select("id", "item_id", F.size("t").cast("long").alias("n_item"), F.size(F.array_intersect("g", "t")).cast("long").alias("n_shared"))
    found = exact.filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return found.groupBy("id", "item_id").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("x")).select("id", "item_id", "x.n_item", "x.n_shared")
