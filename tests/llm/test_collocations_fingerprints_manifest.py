"""Collocations, fingerprints and the Merkle manifest against plain definitions."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tallowick.llm import collocations, fingerprints, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, pos int, path string, phrase string"


def frame(spark, texts, ids=None, langs=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "web", len(t or ""), 7, 1, "p", "q") for i, t, g in zip(ids, texts, langs, strict=True)], SCHEMA).repartition(parts)


def plain_collocations(rows, least, top, covered=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", brute.lower(text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= covered * a for b in around):
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases(rng, n):
    words = ["the", "of", "New", "york", "city", "é", "ünd", "a\x00", "a\x01b", "a", "is"]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t", "!"]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("budget", [None, 4, 40])
@pytest.mark.parametrize("counters", [1 << 26, 0])
def test_collocations(spark, monkeypatch, budget, counters):
    monkeypatch.setattr(collocations, "MOST_COUNTERS", counters)
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "hot hot hot hot hot hot hot hot " * 30, *phrases(rng, 120)]
    langs = [rng.choice(["en", "de", None, "und", ""]) for _ in texts]
    got = collocations.collocations(frame(spark, texts, langs=langs), least=5, top=40, budget=budget).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain_collocations(zip(langs, texts, strict=True), 5, 40)


def test_subtrees_do_not_depend_on_the_batches(spark):
    rng = random.Random(2)
    docs = frame(spark, phrases(rng, 60))
    want = sorted(map(tuple, collocations.frequencies(docs, least=3, budget=8).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, collocations.frequencies(docs, least=3, budget=8).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_texts_longer_than_a_batch(spark):
    rng = random.Random(6)
    words = ["internationalisation", "counterrevolutionary", "of", "the", "straightforwardness"]
    long = " ".join(rng.choice(words) + rng.choice(["", "", ".", ",\n"]) for _ in range(450_000))
    whole = "uncharacteristically " * 250_000  # one piece
    assert min(len(long), len(whole)) > collocations.BATCH
    got = {(r.k, r.phrase): r.a for r in collocations.frequencies(frame(spark, [long, "of the", whole], langs=["en", "en", "de"])).filter("lang = 'en'").collect()}
    want = Counter()
    for text in (long, "of the"):
        for piece in re.split("[.,\n]", text):
            w = piece.split()
            for k in range(1, 5):
                want.update((k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    n = sum(a for (k, _), a in want.items() if k == 1)
    assert got == {x: a for x, a in want.items() if a >= 30} | {(0, ""): n}
    parts = list(collocations._shares(pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([long])], ["lang", "text"])))
    assert b"".join(p.column("text")[0].as_py() for p in parts) == long.encode() and max(p.column("text").nbytes for p in parts) <= collocations.BATCH + 99 and len(parts) > 1


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a = 9_000_000_000_001
    counted = spark.createDataFrame([("en", 1, "x", a + 5), ("en", 1, "y", a + 8), ("en", 2, "x y", a), ("en", 0, "", 3 * a)], "lang string, k int, phrase string, a long")
    monkeypatch.setattr(collocations, "frequencies", lambda *args, **more: counted)
    assert collocations.collocations(counted).first().score == 2000000 * a // (2 * a + 13)


def test_no_collocations_without_rows(spark):
    assert collocations.collocations(frame(spark, ["x"]).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [None, ""])).count() == 0


def plain_fingerprints(rows):
    """id: length, edited text, next text."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(rows, key=key)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        h = len(t) // 2
        out.append((i, len(t), t, t[: len(t) - h] + after[:h], after))
    return out


def test_fingerprints(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(999)}{rng.choice(['', '', '.'])}" for _ in range(rng.randrange(12))) + rng.choice(["", ".", "ß"])
    texts = [None, "", "\n", "a", "x\ny", "y\nx", "😀😀😀", "é" * 9, *("\n".join(line() for _ in range(rng.randrange(1, 12))) for _ in range(50)), "word. " * 20000]
    ids = [*range(1, 2 * len(texts) - 1, 2), None]
    got = {r.id: r for r in fingerprints.fingerprints(frame(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    for i, n, own, edited, after in plain_fingerprints(zip(ids, texts, strict=True)):
        r, v, e = got[i], fingerprints.vector(own), fingerprints.vector(edited)
        assert (r.n_chars, r.edited_sha256) == (n, sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.written(v), fingerprints.written(e))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(v, e), fingerprints.likeness(v, fingerprints.vector(after)))
    assert got[9].fingerprint == got[11].fingerprint and got[1].fingerprint == got[3].fingerprint != got[5].fingerprint
    near = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited for r in near]) > 0.3 > 0.15 > np.mean([r.near_next for r in near])


def test_fingerprints_of_repeated_rows_and_few_rows(spark):
    rows = fingerprints.fingerprints(frame(spark, ["aaaa", "bb", "bb", "bb"], [1, 2, 2, 2])).collect()
    edited = lambda t: sha256(t.encode()).hexdigest()
    assert sorted((r.id, r.edited_sha256) for r in rows) == sorted([(1, edited("aabb")), (2, edited("bb")), (2, edited("bb")), (2, edited("ba"))])
    one = fingerprints.fingerprints(frame(spark, ["abcd"], [3])).first()
    assert one.edited_sha256 == edited("abab") and one.near_next == 1.0
    assert fingerprints.fingerprints(frame(spark, ["x"]).limit(0)).count() == 0


def test_fingerprints_add_and_remove_paragraphs_in_any_order():
    a, b = "one. two.\nthree", "four\n\nfive"
    whole = fingerprints.vector(f"{b}\n{a}")
    assert (fingerprints.added(fingerprints.vector(a), b) == whole).all()
    assert (fingerprints.removed(whole, b) == fingerprints.vector(a)).all()
    assert (fingerprints.vector("x\nx\ny") != fingerprints.vector("x\ny\ny")).any()


def test_likeness_follows_the_common_sentences():
    rng = random.Random(4)
    for n in (20, 400):
        for common in (0, n // 4, n // 2, n):
            both = [f"common {i} {rng.random()}." for i in range(common)]
            a, b = ("\n".join([*both, *(f"{side} {i} {rng.random()}." for i in range(n - common))]) for side in "ab")
            assert abs(fingerprints.likeness(fingerprints.vector(a), fingerprints.vector(b)) - common / n) < 0.4 * (1 - common / n) + 1e-9


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(leaf, subroot, root, path) by id; rows: (id, fields, lang)."""
    trees = {}
    for i, fields, lang in rows:
        trees.setdefault(lang, []).append((i, h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))))

    def up(nodes):
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
                paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            where = [at // 8 for at in where]
            nodes = [h(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)]
        return nodes[0], paths

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {g: up([x for _, x in sorted(trees[g], key=lambda r: (r[0] is not None, r[0] or 0))]) for g in order}
    root, tops = up([made[g][0] for g in order])
    out = {}
    for g, top in zip(order, tops, strict=True):
        for (i, leaf), path in zip(sorted(trees[g], key=lambda r: (r[0] is not None, r[0] or 0)), made[g][1], strict=True):
            out[i] = (leaf, made[g][0], root, path + top)
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rng = random.Random(5)
    ids = [None, *rng.sample(range(9999), 719)]
    langs = [rng.choice(["en"] * 30 + [None, "de", "", "é", "z"] + [f"l{i}" for i in range(9)]) for _ in ids]
    texts = [rng.choice([None, "", "Text", "ünï"]) for _ in ids]
    docs = frame(spark, texts, ids, langs)
    found = merkle.manifest(docs, altered=[F.lower(c) for c in merkle.FIELDS])
    rows = found.select("id", "leaf", "subroot", "root", "path", merkle.folded(F.col("leaf"), F.col("path")).alias("again"), merkle.folded(F.col("altered"), F.col("path")).alias("other"), merkle.siblings(F.col("path")).alias("proof")).collect()
    want = plain_manifest([(i, (i, "web", g, len(t or ""), t), g) for i, g, t in zip(ids, langs, texts, strict=True)])
    assert {r.id: (r.leaf, r.subroot, r.root, [tuple(x) for x in r.path]) for r in rows} == want
    assert all(r.again == r.root and r.proof == h("".join(a + b for a, b in r.path)) for r in rows)
    text = dict(zip(ids, texts, strict=True))
    assert all((r.other == r.root) == (text[r.id] != "Text") for r in rows)


def test_manifest_of_few_and_repeated_rows(spark):
    one = merkle.manifest(frame(spark, ["x"])).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    rows = merkle.manifest(frame(spark, ["x", "x", None], [4, 4, None])).collect()
    assert len(rows) == 3 and len({r.root for r in rows}) == 1
    assert merkle.manifest(frame(spark, ["x"]).limit(0)).count() == 0
