"""Quality rules by weak supervision.

Each rule votes good, bad or abstains.  Expectation-maximisation estimates, for
each rule and each true class, how often a vote that is cast is right; the
posterior probability of good quality replaces a filter that demands that every
rule passes.  Only the counts of the distinct vote patterns, at most 3 to the
number of rules, leave the executors, so the estimate covers every document.

Defined results: a null or empty text has no words and fails the base test; rows
with the same id, or with a null id, are judged one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowick.llm import kernels as K
from tallowick.llm.workspace import keep

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_full_stops", "n_word_like", "n_distinct")
#: name, numerator, denominator, votes bad if above, votes good if at most (None: abstains instead)
RULES = (
    ("symbols", "n_symbols", "n_words", 0.10, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0.50, None),
    ("repeated_words", "n_repeat_words", "n_words", 0.35, None),
    ("upper_case", "n_upper", "n_letters", 0.40, 0.15),
    ("long_words", "word_chars", "n_words", 12.0, None),
)
#: the same, votes bad if below, votes good if at least
REVERSED = (
    ("short_words", "word_chars", "n_words", 2.5, None),
    ("full_stops", "n_full_stops", "n_lines", 0.10, 0.50),
    ("word_like", "n_word_like", "n_words", 0.70, 0.95),
    ("distinct_words", "n_distinct", "n_words", 0.08, None),
)
NAMES = tuple(r[0] for r in RULES + REVERSED)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


SYMBOL = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
STOP = _table('.?!:;"')
#: a word that holds one of these, or only marks, does not look like prose
ODD = _table("#*$%&|<>{}[]=_~^\\")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.pieces(batch, "text"):
            data, offs = K.flat(part.column("text"))
            n = part.num_rows
            starts, ends, row = K.words(data, offs)
            heads = (data & 0xC0) != 0x80
            out = {"n_words": np.bincount(row, minlength=n), "word_chars": K.per_row(heads & ~K.SPACE[data], offs), "n_symbols": K.per_row(SYMBOL[data], offs), "n_upper": K.per_row(UPPER[data], offs), "n_letters": K.per_row(LETTER[data], offs)}
            # Windows of three words seen more than once in the text cover the words to count.
            word = K.span_hash(data, starts, ends, lower=False)
            gram, first = K.gram_hash(word, row, 3)
            gram = K.mix(gram ^ K.mix(row[first].astype(np.uint64) + np.uint64(1)))
            _, where, times = np.unique(gram, return_inverse=True, return_counts=True)
            again = first[times[where] > 1]
            covered = np.zeros(len(starts), bool)
            for i in range(3):
                covered[again + i] = True
            out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
            _, at = np.unique(K.mix(word ^ K.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
            out["n_distinct"] = np.bincount(row[at], minlength=n)
            plain = np.add.reduceat(np.append(LETTER[data] | (data >= 0x80), 0).astype(np.int32), starts) > 0 if len(starts) else np.zeros(0, bool)
            odd = np.add.reduceat(np.append(ODD[data], 0).astype(np.int32), starts) > 0 if len(starts) else np.zeros(0, bool)
            out["n_word_like"] = np.bincount(row[plain & ~odd], minlength=n)
            # Lines: from a row's start or a line feed to the next line feed or the row's end.
            feed = np.flatnonzero(data == 10)
            begin = np.sort(np.concatenate([offs[:-1], feed + 1]))
            out["n_lines"] = K.per_row(data == 10, offs) + 1
            line = np.searchsorted(begin, starts, side="right") - 1
            real = np.unique(line)
            if len(real):
                stop = np.append(begin[1:], len(data))[real]
                ending = stop - (data[np.maximum(stop - 1, 0)] == 10)
                of = row[np.searchsorted(line, real)]
                hashed = K.mix(K.span_hash(data, begin[real], ending, lower=False) ^ K.mix(of.astype(np.uint64) + np.uint64(1)))
                _, at = np.unique(hashed, return_index=True)
                out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[at], minlength=n)
                last = np.append(np.flatnonzero(np.diff(line)), len(line) - 1)
                out["n_full_stops"] = np.bincount(row[last[STOP[data[ends[last] - 1]]]], minlength=n)
            else:
                out["n_dup_lines"] = out["n_full_stops"] = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(out[c], pa.int64()) for c in COUNTS)], ["id", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the counts that the rules use, one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measure, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def votes() -> F.Column:
    """The votes as one number: a base-3 digit for each rule, 0 abstains, 1 good, 2 bad."""
    total = F.lit(0)
    for rules, sign in ((RULES, 1), (REVERSED, -1)):
        for _, a, b, bad, good in rules:
            share = sign * F.col(a) / F.greatest(F.col(b), F.lit(1))
            vote = F.when(share > sign * bad, 2)
            vote = vote.when(share <= sign * good, 1) if good is not None else vote
            total = total * 3 + vote.otherwise(0)
    return F.when(F.col("n_words") == 0, F.lit(0)).otherwise(total)


def label_model(patterns: dict[int, int], n_rules: int = len(NAMES), rounds: int = 300, tolerance: float = 1e-8) -> tuple[dict[int, float], dict]:
    """Expectation-maximisation over vote patterns and their counts.

    For each rule and true class it estimates how often the rule abstains, votes
    good and votes bad.  The start takes a document as bad if more rules call it bad
    than good; pseudo-counts say that a vote is more often right than wrong, which
    keeps the two classes from changing places.  Returns the posterior probability
    of good quality for each pattern, and the estimates: ``prior`` and, for each
    rule, ``accuracy``, the probability that a vote that is cast is right.
    """
    codes = sorted(patterns)
    if not codes:
        return {}, {"prior": 0.5, "accuracy": [0.8] * n_rules}
    cast = np.array([[c // 3 ** (n_rules - 1 - i) % 3 for i in range(n_rules)] for c in codes])
    weight = np.array([patterns[c] for c in codes], float)
    one_hot = np.stack([cast == v for v in range(3)])  # vote, pattern, rule
    n_good, n_bad = (cast == 1).sum(1), (cast == 2).sum(1)
    posterior = np.where(n_bad > n_good, 0.1, np.where(n_bad > 0, 0.5, 0.9))
    doubt = 1e-3 * weight.sum() + 1
    prefer_good, prefer_bad = doubt * np.array([1.0, 0.9, 0.1]), doubt * np.array([1.0, 0.1, 0.9])
    for _ in range(rounds):
        w_good, w_bad = weight * posterior, weight * (1 - posterior)
        good = np.stack([w_good @ one_hot[v] + prefer_good[v] for v in range(3)])
        bad = np.stack([w_bad @ one_hot[v] + prefer_bad[v] for v in range(3)])
        prior = float(np.clip(w_good.sum() / weight.sum(), 0.02, 0.98))
        log_good, log_bad = np.log(good / good.sum(0)), np.log(bad / bad.sum(0))
        odds = np.log(prior / (1 - prior)) + sum(one_hot[v] @ (log_good[v] - log_bad[v]) for v in range(3))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < tolerance:
            break
    right = good[1] + bad[2]
    return dict(zip(codes, posterior.tolist(), strict=True)), {"prior": prior, "accuracy": (right / (right + good[2] + bad[1])).tolist()}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id``, the counts, ``base_failed``, ``votes``, ``p_good`` and ``kept`` for each row."""
    spark = docs.sparkSession
    counted = keep(measure(docs, id_col, text_col).withColumn("votes", votes()), "rules")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # At most 3 ** len(NAMES) patterns, whatever the size of the corpus.
    patterns = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, _ = label_model(patterns)
    table = spark.createDataFrame(sorted(posterior.items()), "votes int, p_good double")
    return counted.join(F.broadcast(table), "votes", "left").withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
