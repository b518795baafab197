"""Document quality by co-training of two classifiers.

The text-content view has the words of a document and the shapes of its words; the
page-metadata view has its source, language, size and layout.  Each view is a naive
Bayes classifier, whose training is a count of features for each class, so every
round counts over all documents in parallel: labelled documents count for both
views, and a document of which one view is sure counts, under that pseudo-label, for
the other.  A fifth of the labelled documents is kept apart to calibrate both views
(Platt scaling over histograms of scores); the calibrated log-odds are added up, the
prior taken off, and all documents scored.

Feature numbers are hashed into ranges of fixed size, so models, counts and
histograms that reach the driver don't grow with the corpus.

Defined results: null text, source or language count as empty; labels for which
``quality`` is null are left out, contradicting labels go by majority, a tie is good;
with labels of fewer than two classes all documents score 0.5; rows are scored one
by one, whatever their ids; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

WORDS = 1 << 13
SHAPES = 1 << 10
CONTENT = WORDS + SHAPES
META = 1 << 11
BINS = 400
ROUNDS = 3
#: a view hands on a pseudo-label beyond these log-odds
SURE = 3.0

_KIND = np.full(256, 3, np.uint8)  # other
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0  # lower case, or a part of a longer character
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[*b".,;:!?\"'()-"]] = 4
_SHARES = np.array([0.02, 0.1, 0.25, 0.5, 0.8])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.searchsorted(_SHARES, part / np.maximum(whole, 1), side="right")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.pieces(batch, "text"):
            data, offs = K.flat(part.column("text"))
            n = part.num_rows
            starts, ends, row = K.words(data, offs)
            count = np.bincount(row, minlength=n)
            hashed = K.span_hash(data, starts, ends, lower=True)
            word = (hashed % np.uint64(WORDS)).astype(np.int64)
            seen = np.unique(row.astype(np.int64) * WORDS + word)
            kinds = _KIND[data]
            # A word's shape: kinds of its first, second and last bytes, and its length.
            second = np.minimum(starts + 1, ends - 1)
            size = np.minimum(np.searchsorted([3, 6, 10, 16], ends - starts), 4) if len(starts) else starts
            shape = (((kinds[starts].astype(np.int64) * 5 + kinds[second]) * 5 + kinds[ends - 1]) * 5 + size) if len(starts) else starts
            code, times = np.unique(row.astype(np.int64) * 1024 + shape, return_counts=True)
            of = code // 1024
            shapes = of * CONTENT + WORDS + (K.mix((code % 1024 * 8 + _share(times, count[of])).astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
            content = np.sort(np.concatenate([seen // WORDS * CONTENT + seen % WORDS, shapes]))
            bounds = np.searchsorted(content, np.arange(n + 1) * CONTENT)
            content = (content % CONTENT).astype("<u2").tobytes()
            chars, n_lines = K.per_row((data & 0xC0) != 0x80, offs), K.per_row(data == 10, offs) + 1
            distinct = np.bincount(np.unique(row.astype(np.uint64) << np.uint64(40) | hashed >> np.uint64(24)).astype(np.uint64) >> np.uint64(40), minlength=n) if len(row) else np.zeros(n, np.int64)
            layout = [np.log2(chars + 1).astype(int), np.log2(n_lines).astype(int), np.log2(chars / n_lines + 1).astype(int), _share(K.per_row(kinds == 1, offs), chars), _share(K.per_row(kinds == 3, offs), chars), _share(K.per_row(kinds == 2, offs), chars), _share(K.per_row(kinds == 4, offs), chars), _share(distinct, count), np.minimum(chars // np.maximum(count, 1), 20)]
            named = [np.array([zlib.crc32((x or "").encode()) % 512 for x in part.column(c).to_pylist()], np.int64) for c in ("source", "lang")]
            meta = np.stack([*(i * 32 + np.minimum(x, 31) for i, x in enumerate(layout)), 512 + named[0], 1024 + named[1]], 1).astype("<u2")
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array([content[2 * i : 2 * j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], ["id", "row", "content", "meta"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", row_col: str | None = None) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"), text(text_col).alias("text"), text(source_col).alias("source"), text(lang_col).alias("lang"))
    return rows.mapInArrow(_features, "id long, row long, content binary, meta binary")


def _scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of a row's features over the root of their number."""
    data, offs = K.flat(column)
    total = np.concatenate([[0.0], np.cumsum(weights[np.frombuffer(data.tobytes(), "<u2")])])
    at = offs // 2
    return (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(np.diff(at), 1))


def _count(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    counts = [np.zeros((2, CONTENT)), np.zeros((2, META))]
    docs = np.zeros((2, 2))
    for batch in batches:
        label = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
        held = batch.column("held").to_numpy(zero_copy_only=False)
        views = [batch.column(c) for c in ("content", "meta")]
        known = (label >= 0) & ~held
        given = [label.copy(), label.copy()]
        if model:
            for view in (0, 1):
                score = _scores(views[view], model[view])
                given[1 - view] = np.where(label >= 0, label, np.where(score > SURE, 1, np.where(score < -SURE, 0, -1)))
        for view in (0, 1):
            data, offs = K.flat(views[view])
            own = np.frombuffer(data.tobytes(), "<u2")
            use = np.where(held, -1, given[view]) if model else np.where(known, label, -1)
            each = np.repeat(use, np.diff(offs) // 2)
            for c in (0, 1):
                counts[view][c] += np.bincount(own[each == c], minlength=counts[view].shape[1])
                docs[view, c] += (use == c).sum()
    for view in (0, 1):
        for c in (0, 1):
            at = np.flatnonzero(counts[view][c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, view), pa.int32()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.full(len(at) + 1, c), pa.int32()), pa.array(np.append(counts[view][c][at], docs[view, c]).astype(np.int64))], ["view", "feature", "class", "n"])


def _fit(rows: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Log-odds of good quality for each feature of both views; None without both classes."""
    made = rows.mapInArrow(lambda x: _count(x, model), "view int, feature int, class int, n long").groupBy("view", "feature", "class").agg(F.sum("n").alias("n"))
    counts, docs = [np.zeros((2, CONTENT)), np.zeros((2, META))], np.zeros((2, 2))
    for r in made.collect():  # at most 2 * (CONTENT + META + 1) rows
        if r["feature"] < 0:
            docs[r["view"], r["class"]] = r["n"]
        else:
            counts[r["view"]][r["class"], r["feature"]] = r["n"]
    if not docs.all():
        return None
    # The probability that a document of the class has the feature.
    return tuple(np.log((c[1] + 1) / (d[1] + 2)) - np.log((c[0] + 1) / (d[0] + 2)) for c, d in zip(counts, docs, strict=True))


def _score(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "label", "held")), *(pa.array(_scores(batch.column(c), w)) for c, w in zip(("content", "meta"), model, strict=True))], ["id", "row", "label", "held", "content", "meta"])


def platt(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log-odds, by Newton's method on counted scores."""
    a, b = 1.0, 0.0
    good, bad = good + 1e-3, bad + 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -50, 50)))
        w = (good + bad) * p * (1 - p)
        g = good - (good + bad) * p
        h = np.array([[(w * score**2).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * score).sum() - 1e-2 * (a - 1), g.sum()])
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", rounds: int = ROUNDS, row_col: str | None = None) -> DataFrame:
    """``id, p_content, p_metadata, p_good`` for each row of ``docs``, and ``row``, its ``row_col`` if given; labels come by ``id_col``."""
    named = ["id", "row"] if row_col else ["id"]
    truth = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("labelled")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    # Every fifth labelled document, by a hash of its id, is kept for calibration.
    made = features(docs, id_col, text_col, source_col, lang_col, row_col)
    rows = keep(made.join(truth, made["id"] == truth["labelled"], "left").select("id", "row", "content", "meta", "label", (F.col("label").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(5)) == 0)).alias("held")), "features")
    model = _fit(rows, None)
    for _ in range(rounds if model else 0):
        model = _fit(rows, model) or model
    if model is None:
        return rows.select(*named, *(F.lit(0.5).alias(c) for c in ("p_content", "p_metadata", "p_good")))
    scored = keep(rows.mapInArrow(lambda x: _score(x, model), "id long, row long, label int, held boolean, content double, meta double"), "scores")
    low, high, odds = -20.0, 20.0, {}
    held = scored.filter("held")
    prior = 0.0
    for view in ("content", "meta"):
        place = F.floor((F.least(F.greatest(F.col(view), F.lit(low)), F.lit(high - 1e-9)) - low) / (high - low) * BINS).cast("int")
        counts = np.zeros((2, BINS))
        for r in held.groupBy(place.alias("bin"), "label").count().collect():  # at most 2 * BINS rows
            counts[r["label"], r["bin"]] = r["count"]
        a, b = platt(low + (np.arange(BINS) + 0.5) * (high - low) / BINS, counts[1], counts[0]) if counts.sum() else (1.0, 0.0)
        prior = float(np.log((counts[1].sum() + 1) / (counts[0].sum() + 1)))
        odds[view] = F.lit(a) * F.col(view) + F.lit(b)
    logistic = lambda x: 1 / (1 + F.exp(-x))
    return scored.select(*named, logistic(odds["content"]).alias("p_content"), logistic(odds["meta"]).alias("p_metadata"), logistic(odds["content"] + odds["meta"] - F.lit(prior)).alias("p_good"))
