"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of up to four bytes, counted over the training
documents: every task counts the five-byte strings of its documents, Spark adds them
up, and the shorter contexts follow by summing.  In a context, the bytes seen after it
share what escape estimation (method C: the number of different bytes) leaves; an
escape moves on to the next shorter context, from whose counts all bytes already seen
are excluded, down to equal odds for the bytes not seen at all.

What is broadcast has a proven size bound.  Strings and contexts of up to three bytes
are all in it, 2 ** 24 of each at most, and the probabilities of the five-byte strings
that make up more than one ``FREQUENT``-th of the training bytes, which fewer than
``FREQUENT`` can.  The other five-byte strings of a document, seen in training or not, are
joined with their counts, those of their context and of their last four bytes, so
``FREQUENT`` changes no score.

Words for the base score are counted over the same documents.  At most ``FREQUENT``
words can have more than one ``FREQUENT``-th of all tokens; these are broadcast, and
the other words of a document joined with their counts by a 64-bit hash.

Defined results: a null or empty text is the end token alone, its score is 0; a null
id is trained on; rows with equal ids are scored one by one; extra columns are
ignored; an empty training set gives equal odds throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

ORDER = 4
FREQUENT = 1 << 21
WORD, GRAM = 0, 1
#: the end of a document as a token
END = np.int64(-6067093078543937345)


def held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], bool)


def _grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, it and the four before it in its row as one number; zero bytes stand before a row."""
    low = K.LOWER[data].astype(np.int64)
    out = low.copy()
    for back in range(1, ORDER + 1):
        if len(low) > back:
            out[back:] |= low[:-back] << 8 * back
    for i in range(ORDER):  # the i-th byte of a row has i bytes before it
        at = offs[:-1][np.diff(offs) > i] + i
        out[at] &= (1 << 8 * (i + 1)) - 1
    return out


def _counts(batches: Iterator[pa.RecordBatch], folds: int, fold: int, blocks: int = 16) -> Iterator[pa.RecordBatch]:
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, where = np.unique(key, return_inverse=True)
        return key, np.bincount(where, weights=n).astype(np.int64)

    def rows(held: list[list]) -> Iterator[pa.RecordBatch]:
        for kind in (WORD, GRAM):
            if held[kind]:
                key, n = merged(held[kind])
                for at in range(0, len(key), 50_000):
                    m = len(key[at : at + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind), pa.int32()), pa.array(key[at : at + 50_000], pa.int64()), pa.array(n[at : at + 50_000])], ["kind", "key", "n"])

    held: list[list] = [[], []]
    for batch in batches:
        train = batch.filter(pa.array(~held_out(batch.column("id").to_pylist(), folds, fold)))
        for part in K.pieces(train, "text"):
            data, offs = K.flat(part.column("text"))
            starts, ends, _ = K.words(data, offs)
            word, n = np.unique(K.span_hash(data, starts, ends, lower=True).view(np.int64), return_counts=True)
            held[WORD].append((np.append(word, END), np.append(n, part.num_rows)))
            held[GRAM].append(tuple(x.astype(np.int64) for x in np.unique(_grams(data, offs), return_counts=True)))
            if len(held[WORD]) >= blocks:
                held = [[merged(h)] for h in held]
                if len(held[WORD][0][0]) > 500_000:
                    yield from rows(held)
                    held = [[], []]
    yield from rows(held)


class Trie:
    """Log10 probabilities of bytes after contexts, from counts of strings of each length.

    ``levels[k]`` holds the strings of ``k + 1`` bytes, sorted, and their counts; a
    string's last byte is its lowest.  ``top`` holds the contexts one byte longer than
    those, sorted; the sum and number of the counts after them; and the sum of the counts
    that the bytes seen after them have in the next shorter context.  Longer strings come
    with their counts.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], top: tuple[np.ndarray, ...]):
        self.strings, self.seen, self.contexts, self.escape, self.after, self.rest = [], [], [], [], [], []
        for k, (string, count) in enumerate(levels):
            n = count.astype(np.float64)
            context, first = np.unique(string >> 8, return_index=True)
            of = np.repeat(np.arange(len(context)), np.diff(np.append(first, len(string))))
            total, kinds = (np.bincount(of, weights=w, minlength=len(context)) for w in (n, np.ones(len(n))))
            self.strings.append(string)
            self.seen.append(np.log10(n / (total + kinds)[of]))
            self.contexts.append(context)
            self.escape.append(np.log10(kinds / (total + kinds)))
            if k:
                short, m = levels[k - 1]
                shared = np.bincount(of, weights=m[np.searchsorted(short, string & ((1 << 8 * k) - 1))].astype(np.float64), minlength=len(context))
                self._left(context, kinds, shared, k)
            else:
                left = 256 - kinds
                self.after.append(np.log10(np.maximum(left, 1)))
                self.rest.append(np.zeros(len(context)))
            self._sums = (context, total, kinds)
        context, total, kinds, shared = top
        self.contexts.append(context)
        self.escape.append(np.log10(kinds / (total + kinds)))
        self._left(context, kinds, shared, len(levels))
        self._sums = (context, total, kinds)
        self.counts = [n for _, n in levels]

    def _left(self, context: np.ndarray, kinds: np.ndarray, shared: np.ndarray, k: int) -> None:
        """What an escape from these contexts leaves of the next shorter ones: the counts and the kinds there less those of the bytes seen here."""
        held, *sums = self._sums
        parent = np.searchsorted(held, context & ((1 << 8 * (k - 1)) - 1))
        counts_left, kinds_left = sums[0][parent] - shared, sums[1][parent] - kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            self.after.append(np.where(kinds_left > 0, np.log10(counts_left + kinds_left), np.inf))
            self.rest.append(np.where(kinds_left > 0, np.log10(kinds_left / (counts_left + kinds_left)), 0.0))

    @staticmethod
    def _find(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(held):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        return at, held[at] == wanted

    def log10(self, grams: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray, shared: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each string after the bytes before it.

        ``count`` is the string's own, ``total``, ``kinds`` and ``shared`` are its context's
        as in ``top``, ``shorter`` is the count of the string less its first byte; 0 if not seen.
        """
        top = len(self.strings)
        inside, known = self._find(self.contexts[top], grams >> 8 & ((1 << 8 * top) - 1))
        sums = [np.where(known, x[inside] if len(x) else 0.0, 0.0) for x in self._sums[1:]]
        longest = kinds > 0
        counts_left, kinds_left = sums[0] - np.where(longest, shared, 0), sums[1] - np.where(longest, kinds, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(longest, np.log10(kinds / (total + kinds)), 0.0)
            out += np.where(shorter > 0, np.log10(shorter), np.where(kinds_left > 0, np.log10(kinds_left), 0.0))
            out -= np.where((shorter > 0) | (kinds_left > 0), np.log10(counts_left + kinds_left), 0.0)
            out = np.where(count > 0, np.log10(count / (total + kinds)), out)
        todo = np.flatnonzero((count == 0) & (shorter == 0))
        escaped = np.where(known, inside, -1)  # place of the context escaped from, one level up
        for k in range(len(self.strings) - 1, -1, -1):
            own = grams[todo] & ((1 << 8 * (k + 1)) - 1)
            place, seen = self._find(self.strings[k], own)
            inside, known = self._find(self.contexts[k], own >> 8)
            fresh = escaped[todo] < 0
            # In a context that nothing was excluded from yet, and in one after an escape.
            hit = seen & fresh
            out[todo[hit]] += self.seen[k][place[hit]]
            hit = seen & ~fresh
            if hit.any():
                out[todo[hit]] += np.log10(self.counts[k][place[hit]]) - self.after[k + 1][escaped[todo[hit]]]
            miss = known & ~seen & fresh
            out[todo[miss]] += self.escape[k][inside[miss]]
            miss = ~seen & ~fresh
            if miss.any():
                out[todo[miss]] += self.rest[k + 1][escaped[todo[miss]]]
            move = known & ~seen
            escaped[todo[move]] = inside[move]
            todo = todo[~seen]
        if len(todo):  # not seen at all
            out[todo] -= np.where(escaped[todo] >= 0, self.after[0][np.maximum(escaped[todo], 0)] if len(self.after[0]) else 0.0, np.log10(256))
        return out


def _last(n: int) -> Column:
    """The last ``n`` bytes of a string."""
    return F.col("key").bitwiseAND((1 << 8 * n) - 1)


def _contexts(strings: DataFrame, shorter: DataFrame, n: int) -> DataFrame:
    """``context, total, kinds, shared`` of the contexts of strings of ``n`` bytes."""
    below = shorter.select(F.col("key").alias("ending"), F.col("n").alias("m"))
    return strings.join(below, _last(n - 1) == F.col("ending")).groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("m").alias("shared"))


def _arrays(rows: DataFrame, by: str) -> list[np.ndarray]:
    got = rows.toPandas().sort_values(by)
    return [got[c].to_numpy() for c in rows.columns]


def model(four: DataFrame) -> Trie:
    three = keep(four.groupBy(_last(3).alias("key")).agg(F.sum("n").alias("n")), "three")
    levels = [tuple(x.astype(np.int64) for x in _arrays(three, "key"))]  # at most 2 ** 24 rows, as in the contexts
    for k in (1, 0):
        key, n = levels[0]
        key, where = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        levels.insert(0, (key, np.bincount(where, weights=n).astype(np.int64) if len(where) else key))
    context, *sums = _arrays(_contexts(four, three, 4), "context")
    return Trie(levels, (context.astype(np.int64), *(x.astype(np.float64) for x in sums)))


def _logs(batches: Iterator[pa.RecordBatch], trie) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, *counts = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("key", "n", "total", "kinds", "shared", "shorter"))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(trie.value.log10(key, *(x.astype(np.float64) for x in counts)))], ["key", "value"])


def _score(batches: Iterator[pa.RecordBatch], often, frequent, folds: int, fold: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then rows ``(row, kind, key, times)`` for its words and strings that aren't broadcast."""
    (strings, odds), (words, logs) = often.value, frequent.value
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        for part in K.pieces(batch, "text"):
            data, offs = K.flat(part.column("text"))
            n = part.num_rows
            gram, inverse = np.unique(_grams(data, offs), return_inverse=True)
            place, held = Trie._find(strings, gram)
            total = np.concatenate([[0.0], np.cumsum(np.where(held, odds[place] if len(strings) else 0.0, 0.0)[inverse])])
            other = np.flatnonzero(~held[inverse])
            gram_of = np.searchsorted(offs, other, side="right") - 1
            starts, ends, of = K.words(data, offs)
            key, where = np.unique(np.append(K.span_hash(data, starts, ends, lower=True).view(np.int64), END), return_inverse=True)
            place = np.minimum(np.searchsorted(words, key), max(0, len(words) - 1))
            known = words[place] == key if len(words) else np.zeros(len(key), bool)
            value = np.where(known, logs[place] if len(words) else 0.0, 0.0)
            end = where[-1]
            where = where[:-1]
            base = np.bincount(of, weights=value[where], minlength=n) + value[end]
            hits = np.bincount(of, weights=known[where], minlength=n).astype(np.int64) + int(known[end])
            row = at + np.arange(n)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), part.column("id"), pa.array(held_out(part.column("id").to_pylist(), folds, fold)), pa.array(np.bincount(of, minlength=n) + 1), pa.array(hits), pa.array(base), pa.array(total[offs[1:]] - total[offs[:-1]]), pa.nulls(n, pa.int32()), none, none], SCORED)
            rare = np.flatnonzero(~known[where])
            pair, times = np.unique(of[rare].astype(np.int64) * len(key) + where[rare], return_counts=True)
            if not known[end]:
                pair, times = np.append(pair, np.arange(n) * len(key) + end), np.append(times, np.ones(n, np.int64))
            asked = [(WORD, key, pair, times)]
            asked.append((GRAM, gram, *np.unique(gram_of.astype(np.int64) * len(gram) + inverse[other], return_counts=True)))
            for kind, keys, pair, times in asked:
                m = len(pair)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(at + pair // len(keys)), *(pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(np.full(m, kind), pa.int32()), pa.array(keys[pair % len(keys)]), pa.array(times)], SCORED)
            at += n


SCORED = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "kind", "key", "times"]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Documents whose ``crc32(id as text) % folds`` is ``fold`` are held out of training.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = keep(rows.mapInArrow(lambda x: _counts(x, folds, fold), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counted.filter(F.col("kind") == WORD)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = words.filter(F.col("n") * FREQUENT > tokens).select("key", "n").toPandas()  # fewer than FREQUENT rows
    order = np.argsort(often["key"].to_numpy())
    frequent = spark.sparkContext.broadcast((often["key"].to_numpy(np.int64)[order], np.log10(often["n"].to_numpy(np.float64)[order] + 1)))
    grams = counted.filter(F.col("kind") == GRAM).select("key", "n")
    four = keep(grams.groupBy(_last(4).alias("key")).agg(F.sum("n").alias("n")), "four")
    contexts = keep(_contexts(grams, four, 5), "contexts")
    trie = spark.sparkContext.broadcast(model(four))
    size = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = grams.filter(F.col("n") * FREQUENT > size).join(contexts, F.shiftright("key", 8) == F.col("context"))  # fewer than FREQUENT rows
    string, value = _arrays(top.select("key", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value")), "key")
    held = spark.sparkContext.broadcast((string.astype(np.int64), value.astype(np.float64)))
    scored = keep(rows.mapInArrow(lambda x: _score(x, held, frequent, folds, fold), "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, kind int, key long, times long"), "scored")
    asked = scored.filter("key is not null").select("row", "kind", "key", "times")
    wanted = asked.filter(F.col("kind") == GRAM).select("key").distinct().join(grams, "key", "left").join(contexts, F.shiftright("key", 8) == F.col("context"), "left")
    counts = wanted.join(four.select(F.col("key").alias("ending"), F.col("n").alias("shorter")), _last(4) == F.col("ending"), "left").select("key", "n", "total", "kinds", "shared", "shorter")
    values = words.filter(F.col("n") * FREQUENT <= tokens).select(F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value")).union(counts.mapInArrow(lambda x: _logs(x, trie), "key long, value double").select(F.lit(GRAM).alias("kind"), "key", "value"))
    part = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    value = F.col("times") * F.col("value")
    more = asked.join(values, ["kind", "key"]).groupBy("row").agg(part(WORD, F.col("times")).alias("more_known"), part(WORD, value).alias("more_base"), part(GRAM, value).alias("more_score"))
    whole = scored.filter("key is null").drop("kind", "key", "times").join(more, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return whole.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
