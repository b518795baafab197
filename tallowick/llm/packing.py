"""Packing of tokenised documents into sequences by minimum bin slack.

For one bin after the other, a bitset dynamic programme over the lengths still
available finds the fullest combination, which is then removed; equally full ones
that hold the longest piece come first.  Only how many
pieces there are of each length, at most ``capacity`` numbers, goes to the driver;
a combination is repeated while its lengths last, so the plan is a short table of
runs.  Pieces find their place from their rank among the pieces of their length;
ranks come from counts for each written partition, so no length is gathered in
one task.

Defined results: a null or empty text is the end id alone; rows with equal or
null ids are packed one by one; extra columns are ignored; an empty table packs
to nothing.  A document longer than a sequence is cut so that only its first
piece may be shorter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def byte_bpe(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to lists of ids, equal to ``tokenizers`` on a byte-level BPE file.

    The vocabulary of the file is run by tiktoken, several times faster, where its
    ids are in the order of its merges; texts that hold a special token, and other
    files, go to tokenizers itself, which is loaded only then.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own: list[Tokenizer] = []

    def plain(texts: list[str]) -> list[list[int]]:
        if not own:
            own.append(Tokenizer.from_file(path))
        return [x.ids for x in own[0].encode_batch(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    special = [t["content"] for t in spec["added_tokens"]]
    ids = model["vocab"]
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or merged != sorted(merged) or model.get("dropout") or model.get("ignore_merges"):
        return plain
    # Byte-level vocabularies write a byte outside these ranges as a character from 256 on, in order.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items() if t not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [plain([t])[0] if any(x in t for x in special) else fast.encode_ordinary(t) for t in texts]

    return encode


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, part, seen = byte_bpe(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for rows in K.pieces(batch, "text"):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(rows.column("id").to_pylist(), encode([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                data = np.array([*ids, end_id], "<u4")
                first = (len(data) - 1) % capacity + 1
                for number, begin in enumerate([0, *range(first, len(data), capacity)]):
                    length = first if not begin else capacity
                    for column, value in zip(out, (doc_id, number, begin, length, zlib.crc32(data[begin : begin + length]), part, int(seen[length])), strict=True):
                        column.append(value)
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in PIECE_SCHEMA.split(", ")])


def _reached(counts: dict[int, int], room: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The sums up to ``room`` as a bitset, and ``(length, copies, sums before)`` for each step to it; ends at a full bin."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0:  # powers of two make every number of copies
            some = min(some, left)
            steps.append((length, some, reach))
            reach = (reach | reach << (some * length)) & mask
            if reach >> room & 1:
                return reach, steps
            left, some = left - some, some * 2
    return reach, steps


def _chosen(reach: int, steps: list[tuple[int, int, int]]) -> list[int]:
    at, out = reach.bit_length() - 1, []
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * some
            at -= some * length
    return out


def fullest(counts: dict[int, int], capacity: int, longest: bool = False) -> list[int]:
    """Lengths, each used at most as often as it is available, with the largest sum up to ``capacity``.

    Of combinations with that sum, one with the longest piece is taken where there is
    one, as long pieces are the hardest to place.  ``longest`` takes the fullest
    combination with the longest piece even where another is fuller.
    """
    top = max(counts)
    rest = {x: n - (x == top) for x, n in counts.items() if n > (x == top)}
    with_top = [top, *_chosen(*_reached(rest, capacity - top))]
    if longest or sum(with_top) == capacity:
        return with_top
    free = _chosen(*_reached(counts, capacity))
    return free if sum(free) > sum(with_top) else with_top


def plan(counts: dict[int, int], capacity: int, longest: bool = False) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, first sequence, offset)``: the k-th piece of a run goes to the k-th sequence from the first."""
    left, used, runs, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        chosen = fullest(left, capacity, longest)
        each = {x: chosen.count(x) for x in set(chosen)}
        times = min(left[x] // n for x, n in each.items())
        offset = 0
        for x in chosen:
            runs.append((x, used[x], times, sequence, offset))
            used[x] += times
            offset += x
        for x, n in each.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        sequence += times
    return runs


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``table``: runs in the order of length and first rank."""
    key = table[:, 0] << 48 | table[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        run = table[np.searchsorted(key, length << 48 | rank, side="right") - 1] if len(table) else np.zeros((0, 5), np.int64)
        own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = keep(rows.mapInArrow(lambda x: _cut(x, tokenizer, end_id, capacity), PIECE_SCHEMA), "pieces")
    own = cut.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    before = own.selectExpr("part", "length", "sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding) as before")
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda x: _place(x, table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
