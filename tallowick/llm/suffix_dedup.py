"""Removal of repeated passages by a suffix array in deep-shallow order.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in
the same or another document.  Every start of such a window is filed under the
window's minimizer, the ``GRAM``-byte string of the smallest hash in it, the first of
equals; equal windows have equal minimizers at equal places.  Neighbouring starts with one
minimizer make one row with the hash of all bytes their windows cover, so the corpus
becomes a row for about every 180 bytes.

Rows of equal bytes repeat in full; they are told by 64-bit hashes of all their bytes
among the rows of one minimizer, itself a 64-bit hash, so two different rows count as
equal with a probability of about 1e-5 over 100 TB.  Minimizers with one row only
repeat nothing.
Only minimizers with rows of different bytes need sorting: one row of each kind is
fetched with its bytes, and the suffixes that start at the minimizers, and likewise the
prefixes that end there read backwards, are put in order: multikey quicksort on
eight-byte words down to a shallow depth, then a blind trie for each group whose common
prefix is longer.  Common prefix lengths of neighbours in the two orders tell for each
start whether the whole window is found in another row: it is if another row has the
same class both of the bytes before and of the bytes from the minimizer on.

A minimizer with more than ``HOT`` kinds of rows would be too much for one task.  Its rows are
cut into ranges of ``RANGE`` places of the minimizer in the window.  All windows of a
range cover the same core of ``length - RANGE + 1`` bytes, so equal windows have equal
cores, and rows are filed under the core's hash.  Equal pieces repeat in full; where a core
still has several kinds of pieces, as at the border of a passage that very many
documents share, their single windows are counted by hash.  All of this is grouping with
partial sums, so no group of rows comes together in one task.

Defined results: a null or empty text loses nothing; rows are judged by their own
texts, so equal rows repeat each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

GRAM = 32
#: a long text's windows are worked off by this many starts at a time, whose places have so many bits
SEGMENT, PLACE = 1 << 19, np.uint64(20)
SHALLOW = 2  # eight-byte words
#: a minimizer with more kinds of rows than this is cut into ranges of this many places
HOT, RANGE = 4096, 16
#: rows of a hot group are spread over this many tasks when they meet its count
SALTS = 16


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM``-byte strings at each place, by doubling."""
    h, step = K.BYTE[data], 1
    while step < GRAM:
        h = K.mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(values) - width + 1
    pad = -len(values) % width
    block = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, begin, number of starts, place of the minimizer, its hash, for each run of starts with one minimizer."""
    none = (*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64))
    if len(data) < length:
        return none
    h = _gram_hashes(data)
    # The place breaks ties.  As many bits of the hash take part in the choice wherever a window stands.
    packed = h >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64)
    at = (_least(packed, length - GRAM + 1) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(offs, np.arange(len(at)), side="right") - 1
    whole = np.arange(len(at)) + length <= offs[row + 1]
    if not whole.any():
        return none
    start = np.flatnonzero(whole)
    own, of = at[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) > 1) | (np.diff(own) != 0) | (np.diff(of) != 0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return of[first], start[first], count, own[first], h[own[first]]


def _all_runs(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``_runs`` of overlapping segments, so that what is held besides the texts doesn't grow with a long one."""
    if length > SEGMENT:
        raise ValueError(f"strings of {length} bytes are too long, {SEGMENT} at most")
    for b in range(0, max(1, len(data) - length + 1), SEGMENT):
        part = data[b : b + SEGMENT + length - 1]
        row, begin, starts, at, key = _runs(part, np.clip(offs - b, 0, len(part)), length)
        if len(row):
            yield row, begin + b, starts, at + b, key


def _rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.pieces(batch, "text"):
            data, offs = K.flat(part.column("text"))
            raw = memoryview(data)
            for row, begin, starts, at, key in _all_runs(data, offs, length):
                kind = np.array([xxhash.xxh3_64_intdigest(raw[b : b + n + length - 1], seed=a - b) for b, n, a in zip(begin.tolist(), starts.tolist(), at.tolist(), strict=True)], np.uint64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(take), pa.array(begin - offs[row], pa.int32()), pa.array(starts, pa.int32()), pa.array(at - begin, pa.int32()), pa.array(key.view(np.int64)), pa.array(kind.view(np.int64))], ["doc", "begin", "starts", "at", "key", "kind"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first difference lies in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A trie that keeps only the places where strings branch, for strings with a long common prefix.

    A string goes down comparing branching bytes only, is then compared once with
    the leaf it reached, and branches off where the two differ.
    """

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: object = None

    def _leaf(self, node) -> int:
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        return node[0]

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = (i,)
            return
        s = self.strings[i]
        node, path = self.root, []
        while isinstance(node, list):
            path.append(node)
            byte = s[node[0]] if node[0] < len(s) else -1
            child = node[1].get(byte)
            if child is None:
                break
            node = child
        other = self.strings[self._leaf(node)]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            depth += 1  # equal strings hang together below their end
        node, parent, edge = self.root, None, None
        while isinstance(node, list) and node[0] < depth:
            byte = s[node[0]] if node[0] < len(s) else -1
            parent, edge, node = node, byte, node[1].get(byte)
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth] if depth < len(s) else -1] = (i,)
            return
        if not isinstance(node, list) and depth > len(s):
            joined: object = (*node, i)
        else:
            joined = [depth, {other[depth] if depth < len(other) else -1: node, s[depth] if depth < len(s) else -1: (i,)}]
        if parent is None:
            self.root = joined
        else:
            parent[1][edge] = joined

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and for each the length of its common prefix with the one before it."""
        order, shared = [], []
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, list):
                children = sorted(node[1].items(), reverse=True)
                todo += [(child, node[0] if n < len(children) - 1 else depth) for n, (_, child) in enumerate(children)]
            else:
                order += node
                shared += [depth, *[len(self.strings[node[0]])] * (len(node) - 1)]
        return order, shared


def _words(strings: list[bytes], words: int) -> np.ndarray:
    raw = b"".join(s[: 8 * words].ljust(8 * words, b"\0") for s in strings)
    return np.frombuffer(raw, ">u8").reshape(len(strings), words).astype(np.uint64)


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, then by the words of each row, and the number of the tie each place of it belongs to.

    All segments go one step at a time: each is split into the rows whose word is below, equal
    to and above that of its middle row, and only equal rows move on to the next word.
    """
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0)
    depth = np.zeros(len(order), np.int64)
    while True:
        active = np.flatnonzero((np.bincount(segment)[segment] > 1) & (depth < words.shape[1])) if len(order) else order
        if not len(active):
            return order, segment
        own, row = segment[active], order[active]
        word = words[row, depth[active]]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(np.append(first, len(own)))
        pivot = np.repeat(word[first + size // 2], size)
        side = (word > pivot).astype(np.int64) + (word >= pivot)
        place = np.argsort(own * 3 + side, kind="stable")
        order[active], depth[active] = row[place], depth[active] + (side[place] == 1)
        split = segment * 3
        split[active] += side[place]
        segment = np.cumsum(np.diff(split, prepend=split[0]) != 0)


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings within each group, and each string's common prefix with the one before it (-1 at a group's start)."""
    order, tie = multikey_quicksort(group, _words(strings, SHALLOW))
    shared = np.full(len(order), -1, np.int64)
    g = group[order]
    same_group = np.append(False, g[1:] == g[:-1])
    tied = np.append(False, tie[1:] == tie[:-1])
    first = np.flatnonzero(~tied)
    for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
        if j - i > 1:
            own = order[i:j].copy()
            trie = BlindTrie([strings[k] for k in own])
            for k in range(j - i):
                trie.insert(k)
            inner, prefix = trie.ordered()
            order[i:j] = own[inner]
            shared[i + 1 : j] = prefix[1:]
    for i in np.flatnonzero(same_group & ~tied):
        shared[i] = common_prefix(strings[order[i - 1]], strings[order[i]])
    return order, shared


def repeated_starts(group: np.ndarray, at: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each row, which of its starts have a window that another row of the group has too.

    ``at``: the minimizer's place in the row; a window that starts at s has the
    minimizer at ``at - s``.
    """
    n = len(texts)
    found = [np.zeros(k, bool) for k in starts]
    orders = [deep_shallow(group, [t[a:] for t, a in zip(texts, at, strict=True)]), deep_shallow(group, [t[:a][::-1] for t, a in zip(texts, at, strict=True)])]
    low = at - starts + 1  # the smallest place of the minimizer in a window of the row
    for place in range(int(max(0, low.min())), int(at.max()) + 1):
        rows = np.flatnonzero((low <= place) & (place <= at))
        if len(rows) < 2:
            continue
        classes = []
        for (order, shared), depth in zip(orders, (length - place, place), strict=True):
            label = np.empty(n, np.int64)
            label[order] = np.cumsum(shared < depth)
            classes.append(label[rows])
        pair = classes[0] * (n + 1) + classes[1]
        _, where, times = np.unique(pair, return_inverse=True, return_counts=True)
        for r in rows[times[where] > 1]:
            found[r][at[r] - place] = True
    return found


def _sorted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans that repeat, from rows sorted by ``part``; all rows of a part are together."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        part = np.unique(rows.column("part").to_numpy(), return_inverse=True)[1]
        found = repeated_starts(part, rows.column("at").to_numpy().astype(np.int64), rows.column("starts").to_numpy().astype(np.int64), rows.column("bytes").to_pylist(), length)
        out: list[list] = [[], [], []]
        docs, begin = rows.column("doc").to_pylist(), rows.column("begin").to_pylist()
        for i, flags in enumerate(found):
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    out[0].append(docs[i])
                    out[1].append(begin[i] + a)
                    out[2].append(begin[i] + b - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["doc", "start", "stop"])

    # Batches are worked off at a change of part, so that tasks hold a few thousand rows.
    for batch in batches:
        part = batch.column("part").to_numpy()
        at = 0
        if held and held[-1].column("part")[-1].as_py() != part[0]:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        change = np.flatnonzero(np.diff(part)) + 1
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, at = [], int(change[-1])
        held.append(batch.slice(at))
    if held:
        yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the rows wanted of each document."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc, text, wanted = (batch.column(c)[i].as_py() for c in ("doc", "text", "wanted"))
            data = (text or "").encode()
            out = [(doc, w["begin"], w["starts"], w["at"], w["key"], data[w["begin"] : w["begin"] + w["starts"] + length - 1]) for w in wanted]
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc", "begin", "starts", "at", "part", "bytes"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of hot minimizers cut by the place of the minimizer, with the hash of their core, of all their bytes and of each window."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc, text, wanted = (batch.column(c)[i].as_py() for c in ("doc", "text", "wanted"))
            data = memoryview((text or "").encode())
            out = []
            for w in wanted:
                begin, starts, at = w["begin"], w["starts"], w["at"]
                edges = sorted({0, starts, *(at - p + 1 for p in range(at // RANGE * RANGE, at - starts, -RANGE) if 0 < at - p + 1 < starts)})
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    places = (at - a) // RANGE
                    core = begin + at - places * RANGE
                    part = xxhash.xxh3_64_intdigest(data[core : core + length - RANGE + 1], seed=(w["key"] + places) % 2**64)
                    piece = xxhash.xxh3_64_intdigest(data[begin + a : begin + b + length - 1], seed=at - a)
                    windows = [xxhash.xxh3_64_intdigest(data[s : s + length], seed=begin + at - s) for s in range(begin + a, begin + b)]
                    out.append((doc, begin + a, b - a, *(np.array(x, np.uint64).view(np.int64).tolist() for x in (part, piece, windows))))
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc", "begin", "starts", "part", "piece", "windows"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, kept, at, runs = (text or "").encode(), [], 0, 0
            for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
                if start > at or not runs:  # spans that touch make one run
                    kept.append(data[at:start])
                    runs += 1
                at = max(at, stop)
            kept.append(data[at:])
            rest = b"".join(kept)
            for column, value in zip(out, (len(data), len(data) - len(rest), runs, rest), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array([hashlib.sha256(x).hexdigest() for x in out[3]]), pa.array(out[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _meeting(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are in ``counted``, those of one key spread over ``SALTS`` tasks."""
    salted = counted.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", "begin"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"])


def _hot_spans(rows: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    wanted = hot.groupBy("doc").agg(F.collect_list(F.struct("begin", "starts", "at", "key")).alias("wanted"))
    cut = rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(lambda x: _cut(x, length), "doc string, begin int, starts int, part long, piece long, windows array<long>")
    pieces = keep(cut, "pieces")
    kinds = pieces.groupBy("part", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc", "begin", "windows")).alias("one"))
    kinds = keep(kinds, "piece-kinds")
    full = _meeting(pieces, kinds.filter("n > 1"), ["part", "piece"]).select("doc", F.col("begin").alias("start"), (F.col("begin") + F.col("starts") + F.lit(length - 1)).alias("stop"))
    several = kinds.groupBy("part").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("part")
    single = _meeting(kinds.select("part", "one.*"), several, ["part"]).select("part", "doc", "begin", F.posexplode("windows").alias("i", "window"))
    single = keep(single, "windows")
    again = single.groupBy("part", "window").agg(F.count("*").alias("n")).filter("n > 1")
    start = F.col("begin") + F.col("i")
    return full.union(_meeting(single, again, ["part", "window"]).select("doc", start.alias("start"), (start + length).alias("stop")))


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """``doc, start, stop``: byte spans of repeated windows; spans of a document may overlap."""
    runs = keep(rows.mapInArrow(lambda x: _rows(x, length), "doc string, begin int, starts int, at int, key long, kind long"), "runs")
    kinds = runs.groupBy("key", "kind").agg(F.count("*").alias("n"), F.min(F.struct("doc", "begin", "starts", "at")).alias("one"))
    busy = keep(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).filter("rows > 1"), "busy")
    known = keep(kinds.join(busy.select("key", "kinds"), "key"), "kinds")
    span = lambda x: x.select("doc", F.col("begin").alias("start"), (F.col("begin") + F.col("starts") + F.lit(length - 1)).alias("stop"))
    # Rows of very frequent kinds are marked from the short list of these kinds and spread
    # over all tasks; only the others meet the counts of their kinds.  A marked row stays
    # whether or not it meets one.
    much = keep(known.filter(F.col("n") > HOT).select("key", "kind", F.lit(True).alias("frequent")), "much")
    few = known.filter((F.col("n") > 1) & (F.col("n") <= HOT)).select(F.col("key").alias("meets"), "kind", F.lit(True).alias("found"))
    marked = runs.join(much, ["key", "kind"], "left").withColumn("meets", F.when(F.col("frequent"), F.xxhash64("doc", "begin")).otherwise(F.col("key")))
    full = span(marked.join(few, ["meets", "kind"], "left").filter(F.col("frequent").isNotNull() | F.col("found").isNotNull()))
    mixed = known.filter((F.col("kinds") > 1) & (F.col("kinds") <= HOT)).select("one.*", "key")
    wanted = mixed.groupBy("doc").agg(F.collect_list(F.struct("begin", "starts", "at", "key")).alias("wanted"))
    fetched = rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(lambda x: _fetch(x, length), "doc string, begin int, starts int, at int, part long, bytes binary")
    together = fetched.repartition("part").sortWithinPartitions("part")
    spans = full.union(together.mapInArrow(lambda x: _sorted(x, length), "doc string, start int, stop int"))
    hot = keep(known.filter(F.col("kinds") > HOT).select("one.*", "key"), "hot")
    return spans if hot.isEmpty() else spans.union(_hot_spans(rows, hot, length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the remaining bytes, for each row of ``docs``."""
    # A name that is the same in every read of the table, whatever its partitions; rows that share it are equal.
    name = F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(F.col(text_col).cast("string")))
    rows = docs.select(name.alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(rows.select("doc", "text"), length).groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return rows.join(spans, "doc", "left").select("id", "text", "spans").mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
