"""Collocations from word-suffix trees that are partitioned by prefix.

Every word of a piece begins a suffix of at most ``DEPTH`` words.  The suffixes are
partitioned by their prefixes (vertical partitioning): a class of one-word prefixes that
has more suffixes than the budget allows is told apart by two words, then by three and
four, and classes are put together into groups of about ``budget`` suffixes.  Each group
is sorted and read as a subtree of its own, from left to right, with one open path in
memory; a node's frequency is the total of the leaves below it.  Nodes shorter than their
group's prefix are found in several groups and are summed up.

Suffixes end where no candidate can go on: before the word of a phrase whose counter stays below
``least``.  The counters are sums over the corpus by hash, of words and pairs in a first
pass, of longer phrases of frequent pairs in a second one, which also counts the prefix classes.  Collisions only add to a counter, so nothing is
lost.  All are bounded, ``MOST_COUNTERS`` bytes a pass and ``MOST_CLASSES`` numbers a level; beyond
some 2 billion words the counters are left out and all suffixes are shuffled, with the
same result.

Texts of more than ``BATCH`` bytes are worked off in shares, as phrases don't reach from one piece
into the next: a text of 30 MB takes a task no more than others do, besides the text itself.

Defined results: a null text is empty, a null language ``und``; rows count one by one,
whatever their ids, repeated rows included; extra columns are ignored; an empty table has
no collocations.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

DEPTH = 4
BATCH = 1 << 21
MOST_COUNTERS, MOST_CLASSES = 1 << 26, 1 << 22
#: counters and class sizes travel in parts of so many bytes and numbers
PART = 1 << 16
#: different suffixes that a task holds to add up equal ones
HELD = 1 << 19
LEVELS = tuple(f"w{i + 1}" for i in range(DEPTH))

_CUT = K.LOWER.copy()
_CUT[list(b".,;:!?")] = 10
_STEP = K.seeds(DEPTH, 411) | np.uint64(1)


class Words:
    """The words of some rows: numbers in a dictionary, and hashes and lengths of the suffixes that begin there."""

    def __init__(self, batch: pa.RecordBatch):
        data, offs = K.flat(batch.column("text"))
        data = _CUT[data]
        starts, ends, row = K.words(data, offs)
        bounds = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=bounds[1:])
        held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~K.SPACE[data]])]).dictionary_encode()
        self.number, self.dictionary = held.indices.to_numpy(), held.dictionary
        flat, edges = K.flat(self.dictionary)
        hashes = K.span_hash(flat, edges[:-1], edges[1:], lower=False)[self.number]
        langs = batch.column("lang").dictionary_encode()
        own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], np.uint64)
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)[row]
        cuts = np.cumsum((data >= 10) & (data <= 13))
        #: is the next word in the same piece
        self.next = np.zeros(len(starts), bool)
        if len(starts):
            self.next[:-1] = (row[1:] == row[:-1]) & (cuts[starts[1:]] == cuts[ends[:-1] - 1])
        #: by level: the hash of the prefix of so many words that begins at a word
        self.prefix = [K.mix(own[self.lang] + hashes * _STEP[0]) if len(starts) else np.zeros(0, np.uint64)]
        for step in _STEP[1:]:
            n = len(self.prefix)
            after = np.zeros(len(starts), np.uint64)
            after[:-n] = hashes[n:]
            self.prefix.append(K.mix(self.prefix[-1] + after * step))

    def often(self, words: int, counters: np.ndarray) -> np.ndarray:
        """Whether the counter of the phrase of so many words from each word on is set."""
        return K.bit_set(counters, self.slots(words, 8 * len(counters))) if len(counters) else np.ones(len(self.next), bool)

    def slots(self, words: int, counters: int) -> np.ndarray:
        return (self.prefix[words - 1] % np.uint64(counters)).astype(np.int64)

    def lengths(self, pairs: np.ndarray | None = None, longer: np.ndarray | None = None) -> np.ndarray:
        """Words of each suffix, up to the end of its piece or before a phrase that isn't frequent by the counters given; none of a rare word."""
        known = np.ones(len(self.next), bool) if pairs is None else self.often(1, pairs)
        linked = self.next & known if pairs is None else self.next & known & self.often(2, pairs)
        size, reach = known.astype(np.int64) + linked, linked
        for n in range(1, DEPTH - 1):
            ahead = np.zeros(len(linked), bool)
            ahead[:-n] = linked[n:]
            reach = reach & ahead if longer is None else reach & ahead & self.often(n + 2, longer)
            size = size + reach
        return size


def _shares(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A long text in shares of about ``BATCH`` bytes that end where its pieces do; a longer piece stays whole."""
    data, _ = K.flat(part.column("text"))
    cut = _CUT[data]
    ends = np.append(np.flatnonzero((cut >= 10) & (cut <= 13)) + 1, len(data))
    at = 0
    while at < len(data):
        last = int(np.searchsorted(ends, at + BATCH, side="right")) - 1
        stop = int(ends[last]) if last >= 0 and ends[last] > at else int(ends[last + 1])
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([data[at:stop].tobytes()], pa.binary())], ["lang", "text"])
        at = stop


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in K.pieces(batch, "text", BATCH):
            if part.num_rows == 1 and part.column("text").nbytes > BATCH:
                yield from map(Words, _shares(part))
            else:
                yield Words(part)


def _parts(kind: int, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for i in range(0, len(values), PART):
        part = values[i : i + PART]
        if part.any():
            yield kind, i // PART, zlib.compress(part.tobytes(), 1)


def _tallies(batches: Iterator[pa.RecordBatch], counters: int, classes: int, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counters of one task (kind 0): of words and pairs, or with these of longer phrases; then also the sizes of each level's prefix classes."""
    seen = np.zeros(counters, np.uint8)
    sizes = [np.zeros(classes, np.int64) for _ in range(DEPTH - 1)] if pairs is not None else []
    for own in _read(batches):
        longest = own.lengths(pairs)
        for level, size in enumerate(sizes, 1):
            size += np.bincount(own.slots(level, classes)[longest >= level], minlength=classes)
        if counters:
            kinds = (1, 2) if pairs is None else range(3, DEPTH + 1)
            at, times = np.unique(np.concatenate([own.slots(k, counters)[longest >= k] for k in kinds]), return_counts=True)
            seen[at] = np.minimum(seen[at] + times, 255)
    rows = [*_parts(0, seen), *(x for i, s in enumerate(sizes) for x in _parts(i + 1, s))]
    for i in range(0, len(rows), 64):
        kinds, numbers, data = zip(*rows[i : i + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], ["kind", "part", "data"])


def _totals(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of equal parts; of the counters only which reach ``least``."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, part, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True):
            values = np.frombuffer(zlib.decompress(data), np.int64 if kind else np.uint8).astype(np.int64 if kind else np.uint16)
            if (kind, part) in held:
                values = held[kind, part] + values
            held[kind, part] = values if kind else np.minimum(values, 255)
    for (kind, part), values in held.items():
        out = values.tobytes() if kind else np.packbits(values >= min(least, 255)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([out], pa.binary())], ["kind", "part", "data"])


class Groups:
    """Which group each prefix class belongs to, and which pairs may be frequent: what every task is told."""

    def __init__(self, classes: int, sizes: list[np.ndarray], pairs: np.ndarray, longer: np.ndarray, budget: int):
        self.classes, self.pairs, self.longer = classes, pairs, longer
        self.large = [s > budget // 4 for s in sizes]
        self.group, first = [], 0
        for level, size in enumerate(sizes):
            # Short suffixes of large classes are few rows, so these count with a share.
            ends = np.cumsum(np.where(self.large[level], budget // 4, size))
            self.group.append((first + (ends - 1).clip(0) // budget).astype(np.int32))
            first = int(self.group[-1].max(initial=first)) + 1
        self.rest, self.spread = first, max(1, int(sizes[-1][self.large[-1]].sum()) // budget)

    def of(self, own: Words, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix its group, and how many words of it that group's prefix has: more than the suffix where others have the rest."""
        at = [own.slots(level, self.classes) for level in range(1, DEPTH)]
        group, depth, going = self.group[0][at[0]], np.ones(len(size), np.int64), np.ones(len(size), bool)
        for level in range(1, DEPTH):
            going = going & self.large[level - 1][at[level - 1]]
            depth[going] = level + 1
            going = going & (size > level)
            if level < DEPTH - 1:
                group = np.where(going, self.group[level][at[level]], group)
            else:
                group = np.where(going, self.rest + own.slots(DEPTH, self.spread), group)
        return group, depth


class Held:
    """Different suffixes of a task as numbers of words, added up."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {b"": 0}
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, own: Words, size: np.ndarray, group: np.ndarray, depth: np.ndarray) -> None:
        local = np.zeros((DEPTH, len(size)), np.int64)  # 0 stands for no word
        for i in range(DEPTH):
            there = np.flatnonzero(size > i)
            local[i, there] = own.number[there + i] + 1
        used = np.unique(local)
        used = used[used > 0]
        number = np.zeros(len(own.dictionary) + 1, np.int64)
        number[used] = [self.words.setdefault(w, len(self.words)) for w in own.dictionary.take(pa.array(used - 1)).to_pylist()]
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in own.langs.to_pylist()], np.int64)
        words = number[local]
        self._keep((lang[own.lang] << 32 | words[0], words[1] << 32 | words[2], words[3], group.astype(np.int32), depth.astype(np.int32), np.ones(len(size), np.int64)))

    def _keep(self, part: tuple[np.ndarray, ...]) -> None:
        """One row for each suffix; its group and depth follow from it."""
        high, low, last, *_ = part
        order = np.lexsort((last, low, high))
        same = np.ones(max(len(order) - 1, 0), bool)
        for key in (high[order], low[order], last[order]):
            same &= key[1:] == key[:-1]
        first = np.flatnonzero(np.append(True, ~same)) if len(order) else order
        pick = order[first]
        self.parts.append((*(x[pick] for x in part[:-1]), np.add.reduceat(part[-1][order], first) if len(first) else part[-1]))
        self.size += len(pick)

    def packed(self, places: int) -> Iterator[pa.RecordBatch]:
        """What is held, each suffix once, packed for each of ``places`` that groups are dealt out to; then nothing is."""
        parts, self.parts, self.size = self.parts, [], 0
        if len(parts) > 1:
            self._keep(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts, self.parts, self.size = self.parts, [], 0
        names, langs = np.array([*self.words, b""], object)[:-1], list(self.langs)
        self.words, self.langs = {b"": 0}, {}
        mask = (1 << 32) - 1
        for high, low, last, group, depth, n in parts:
            place = group % places
            order = np.argsort(place, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if len(own):
                    used, words = np.unique(np.stack([high[own] & mask, low[own] >> 32, low[own] & mask, last[own]]), return_inverse=True)
                    columns = (group[own], depth[own].astype(np.int8), (high[own] >> 32).astype(np.int32), words.reshape(DEPTH, -1).astype(np.int32), n[own])
                    data = zstandard.compress(pickle.dumps((columns, names[used].tolist(), langs), protocol=5))
                    yield pa.RecordBatch.from_arrays([pa.array([place[own[0]]], pa.int32()), pa.array([data], pa.binary())], ["place", "data"])


def _suffixes(batches: Iterator[pa.RecordBatch], shared, places: int) -> Iterator[pa.RecordBatch]:
    """The different suffixes of a task with their numbers, summed up over about ``HELD`` of them; those of rare words count for their language only."""
    groups: Groups = shared.value
    held = Held()
    for own in _read(batches):
        if len(own.number):
            size = own.lengths(groups.pairs, groups.longer)
            held.add(own, size, *groups.of(own, size))
            if held.size >= HELD:
                yield from held.packed(places)
    yield from held.packed(places)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of what ``Held.packed`` makes."""
    for batch in batches:
        for i in range(batch.num_rows):
            (group, depth, lang, words, n), names, langs = pickle.loads(zstandard.decompress(batch.column("data")[i].as_py()))
            names, langs = pa.array(names, pa.binary()).view(pa.string()), pa.array(langs, pa.string())
            for j in range(0, len(n), 1 << 16):
                k = slice(j, j + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(group[k], pa.int32()), pa.array(depth[k].astype(np.int32)), langs.take(pa.array(lang[k])), *(names.take(pa.array(w[k])) for w in words), pa.array(n[k])], ["part", "depth", "lang", *LEVELS, "n"])


def _subtrees(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The nodes of the groups' trees, from suffixes in order.

    A level's open node is all that is held between batches.  Nodes below ``least`` go,
    unless other groups have a part of them.
    """
    keys = ("part", "lang", *LEVELS)
    last: list | None = None
    held: list[tuple | None] = [None] * (DEPTH + 1)

    def made(langs: pa.Array, words: list[pa.Array], depth: int, counts: np.ndarray) -> pa.RecordBatch:
        phrase = pc.binary_join_element_wise(*words, " ") if words else pa.array([""] * len(langs), pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(langs), depth), pa.int32()), phrase, pa.array(counts, pa.int64())], ["lang", "k", "phrase", "a"])

    def closed(depth: int) -> Iterator[pa.RecordBatch]:
        if held[depth] and (held[depth][-1] or held[depth][-2] >= least):
            lang, *words, count, _ = held[depth]
            yield made(pa.array([lang], pa.string()), [pa.array([w], pa.string()) for w in words], depth, np.array([count]))
        held[depth] = None

    for batch in batches:
        if not batch.num_rows:
            continue
        n, depths = batch.column("n").to_numpy(), batch.column("depth").to_numpy()
        differs = np.zeros(len(n), bool)
        for i, name in enumerate(keys):
            column = batch.column(name)
            differs[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
            differs[0] |= last is None or column[0].as_py() != last[i]
            if not i:
                continue
            level = i - 1
            if differs[0]:
                yield from closed(level)
            begin = np.flatnonzero(differs)
            if not differs[0]:
                begin = np.append(0, begin)
            total = np.add.reduceat(n, begin)
            if held[level]:
                total[0] += held[level][-2]
            there = pc.not_equal(column, "").to_numpy(zero_copy_only=False)[begin] if level else np.ones(len(begin), bool)
            partial = depths[begin] > level
            sent = np.flatnonzero(there[:-1] & (partial[:-1] | (total[:-1] >= least)))
            if len(sent):
                rows = pa.array(begin[sent])
                yield made(batch.column("lang").take(rows), [batch.column(w).take(rows) for w in LEVELS[:level]], level, total[sent])
            end = int(begin[-1])
            held[level] = (*(batch.column(c)[end].as_py() for c in ("lang", *LEVELS[:level])), int(total[-1]), bool(partial[-1])) if there[-1] else None
        last = [batch.column(c)[len(n) - 1].as_py() for c in keys]
    for level in range(DEPTH + 1):
        yield from closed(level)


def frequencies(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """``lang, k, phrase, a``: the phrases of 1 to ``DEPTH`` words that occur ``least`` times in a language, and at ``k = 0`` all its words.

    ``budget`` is the number of suffixes of a group, by default a million or what keeps
    four groups for each partition busy.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6 + 1
    power = lambda n: 1 << max(0, int(n) - 1).bit_length()
    counters = power(max(PART, words // 8)) if words <= 32 * MOST_COUNTERS else 0
    counters, classes = min(counters, MOST_COUNTERS), min(MOST_CLASSES, power(max(PART, words // 4096)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = budget or max(1 << 14, min(1 << 20, words // (4 * partitions)), 8 * words // classes)

    def summed(pairs: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        often, sizes = np.zeros(counters // 8, np.uint8), [np.zeros(classes, np.int64) for _ in range(DEPTH - 1)]
        told = spark.sparkContext.broadcast(pairs)
        made = rows.mapInArrow(lambda x: _tallies(x, counters, classes, told.value), "kind int, part int, data binary")
        merged = made.repartition("kind", "part").mapInArrow(lambda x: _totals(x, least), "kind int, part int, data binary")
        for r in merged.toLocalIterator():  # counters / 8 bytes and three numbers for each class, whatever the corpus
            values = np.frombuffer(r["data"], np.int64 if r["kind"] else np.uint8)
            to, step = (sizes[r["kind"] - 1], PART) if r["kind"] else (often, PART // 8)
            to[r["part"] * step : r["part"] * step + len(values)] = values
        return often, sizes

    pairs = summed(None)[0]
    longer, sizes = summed(pairs)
    shared = spark.sparkContext.broadcast(Groups(classes, sizes, pairs, longer, budget))
    order = ", ".join(f"{w} string" for w in LEVELS)
    packed = rows.mapInArrow(lambda x: _suffixes(x, shared, partitions), "place int, data binary").repartition("place")
    suffixes = packed.mapInArrow(_unpacked, f"part int, depth int, lang string, {order}, n long")
    nodes = suffixes.sortWithinPartitions("part", "lang", *LEVELS).mapInArrow(lambda x: _subtrees(x, least), "lang string, k int, phrase string, a long")
    return nodes.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("k") == 0))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, lang_col: str = "lang", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of two to four words.

    A phrase's score is that of its weakest cut, ``floor(2000000 * a / (l + r))``; the
    shortest first part decides between equal ones.  A phrase goes if a longer
    candidate around it has ``covered`` percent of its occurrences.  Products are decimals.
    """
    counted = keep(frequencies(docs, least, lang_col, text_col, budget), "phrases")
    phrases = counted.filter("k > 0")
    found = phrases.filter("k > 1").withColumn("words", F.split("phrase", " "))
    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = found.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda key, name: phrases.select("lang", F.col("phrase").alias(key), F.col("a").alias(name))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    # The most frequent longer candidate around each phrase decides.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: joined(at, size))))
    around = found.filter("k > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(covered).cast("decimal(20,0)") * F.col("a")))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    words = counted.filter("k = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
