"""Running values and as-of joins over slices, and what is built on them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallowick.operators import events, frames, guide, match, pools
from tallowick.functions.titles import Titles
from tallowick.operators.slices import latest, running
from tallowick.sources import wantlist
from tallowick.streaming import lanes


@pytest.fixture(autouse=True)
def small_slices(spark):
    """Small tables are dealt out as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values_cross_the_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, rng.randrange(99)])) for i in range(900)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = running(docs, ["k"], ["i"], seen=("last", F.col("v")), top=("max", F.col("v")))
    slices = docs.repartitionByRange("k", "i").select("k", F.spark_partition_id().alias("p")).filter("k = 'hot'").select("p").distinct().count()
    assert slices > 1  # a hot key is worked off by several tasks
    want = {}
    for k in ("hot", "a", "b", None):
        last = top = None
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want[i] = (last, top)
            last, top = (last, top) if v is None else (v, max(v, v if top is None else top))
    assert {r.i: (r.seen, r.top) for r in got.collect()} == want
    assert running(docs.limit(0), ["k"], ["i"], seen=("last", F.col("v"))).count() == 0


def test_latest_fact_at_or_before(spark):
    rng = random.Random(2)
    facts = [(rng.choice("ab"), rng.choice([None, rng.randrange(200)]), n) for n in range(120)]
    asks = [(rng.choice("abc"), rng.randrange(220), n) for n in range(150)]
    got = latest(spark.createDataFrame(asks, "k string, t int, ask int"), spark.createDataFrame(facts, "k string, t int, n int"), ["k"], "t", "f", ties=["n"]).collect()
    assert len(got) == len(asks)
    for r in got:
        best = max(((t, n) for k, t, n in facts if k == r.k and t is not None and t <= r.t), default=None)
        assert (r.f and (r.f.t, r.f.n)) == best


def test_now_playing_with_open_long_and_nested_programmes(spark):
    rng = random.Random(3)
    shows = []
    for n in range(300):
        start = rng.randrange(0, 500_000)
        shows.append((rng.choice(["hot"] * 5 + ["x", "y"]), start, rng.choice([start + rng.randrange(-5, 90), start + rng.randrange(9000), start + 200_000] + [None] * (rng.random() < 0.02)), f"t{n}", n))
    asks = [(n, rng.choice(["hot", "x", "y", "none"]), rng.randrange(0, 700_000)) for n in range(400)]
    time = lambda c: (F.col(c) * 60).cast("timestamp").alias(c)
    programmes = spark.createDataFrame(shows, "guide_id string, start long, stop long, title string, prog_pos int").select("guide_id", time("start"), time("stop"), "title", "prog_pos")
    probes = spark.createDataFrame(asks, "probe int, guide_id string, at long").select("probe", "guide_id", time("at"))
    got = {r.probe: r.prog_pos for r in guide.now_playing(probes, programmes).collect()}
    assert got == {p: min(((s, n) for k, s, e, _, n in shows if k == g and s <= t and (e is None or t < e)), default=(0, None))[1] for p, g, t in asks}
    spans = sorted((r.guide_id, r.begins, r.stop) for r in guide.shown(programmes).filter("stop is not null").collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in itertools.pairwise(spans))


def test_failures_of_a_hot_channel(spark):
    rng = random.Random(4)
    rows = [("c", f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}.{rng.randrange(10)}", rng.choice(["channel_start", "stream_switch", "channel_failover", "other"]), rng.choice([None, 1, 2, 3])) for i in range(600)]
    got = {r.stream_id: r.failures for r in events.failures(spark.createDataFrame(rows, "channel string, ts string, kind string, stream_id int").withColumn("ts", F.to_timestamp("ts"))).collect()}
    want = {}
    seconds = lambda t: int(t[14:16]) * 600 + int(t[17:19]) * 10 + int(t[20])
    for _, t, kind, _ in rows:
        if kind == "channel_failover":
            before = [(seconds(u), s) for _, u, k, s in rows if k in ("channel_start", "stream_switch") and seconds(u) < seconds(t) - 10]
            if before and max(before, key=lambda x: x[0])[1]:
                s = max(before, key=lambda x: x[0])[1]
                want[s] = want.get(s, 0) + 1
    assert got == want


@pytest.mark.parametrize("steps", [[0.5, 1, 2], [5, 10, 30], [20, 25, 29.5, 61], [10, 100, 170, 181, 299], [0, 0, 0, 40]])
def test_slices_of_a_lane_lead_where_the_whole_lane_does(steps):
    for seed in range(30):
        rng = random.Random(seed)
        rule = rng.choice([lanes.Rule(), lanes.Rule(least=2, window=20), lanes.Rule(least=4, first=10, longest=70, quiet=50)])
        times = list(itertools.accumulate(rng.choice(steps) for _ in range(200)))
        cuts = sorted(rng.sample(range(1, 200), rng.randrange(9)))
        parts = [p for p in (times[i:j] for i, j in zip([0, *cuts], [*cuts, 200], strict=True)) if p]
        # Equal times are in one slice.
        for a, b in itertools.pairwise(range(len(parts))):
            while parts[b] and parts[a] and parts[b][0] == parts[a][-1]:
                parts[a].append(parts[b].pop(0))
        parts = [p for p in parts if p]
        until, pause, got, done = float("-inf"), rule.first, [], []
        for part in parts:
            own = lanes.Slice(done[-(rule.least - 1) :], np.array(part), rule)
            got += [(at, n) for at, n, _ in own.path(own.at(until), pause) if at == at]
            begins, ends, lengths = own.table()
            k = int(np.searchsorted(begins, until)) * len(rule.pauses()) + rule.pauses().index(pause)
            until, pause = until if ends[k] != ends[k] else ends[k], lengths[k]
            done += part
        assert got == lanes.trips(times, rule)


def test_rate_trips_are_those_of_whole_lanes(spark):
    rng = random.Random(5)
    times_of = {}
    for lane in ("hot", "b"):
        t, times = 0.0, []
        for _ in range(900 if lane == "hot" else 40):
            t += rng.choice([0, 1, 5, 20, 40, 100, 170, 185, 290, 299]) if lane == "hot" else rng.choice([1, 5, 300, 301, 400])
            times.append(t)
        times_of[lane] = times
    rows = [(k, t) for k, ts in times_of.items() for t in ts]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "lane string, at double")
    got = sorted(map(tuple, lanes.rate_trips(docs).collect()))
    assert got == sorted((k, *x) for k, ts in times_of.items() for x in lanes.trips(ts))


def test_many_lanes_are_worked_off_together(spark):
    rng = random.Random(7)
    times_of = {lane: [rng.randrange(3000) * 1.0 for _ in range(rng.choice([1, 2, 40]))] for lane in (None, *map(str, range(300)))}
    docs = spark.createDataFrame([(k, t) for k, ts in times_of.items() for t in ts], "lane string, at double")
    found = lanes.rate_trips(docs)
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((k, *x) for k, ts in times_of.items() for x in lanes.trips(ts)), key=key)
    calls = next(line for line in found._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroups" in line)
    assert "lane" not in calls.split("]")[0]  # no call for each lane


@pytest.mark.parametrize("crowd", [1024, 3])
@pytest.mark.parametrize("near", [8, 2, 5])
def test_similar_pairs(spark, monkeypatch, near, crowd):
    monkeypatch.setattr(frames, "CROWD", crowd)
    rng = random.Random(6)
    hashes = [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(60))]
    for _ in range(300):
        x = rng.choice(hashes)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        hashes.append(x)
    rows = spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(hashes)], "pos int, hash string")
    first = {x: i for i, x in reversed(list(enumerate(hashes)))}
    want = {(min(first[x], first[y]), max(first[x], first[y]), (x ^ y).bit_count()) for x, y in itertools.combinations(first, 2) if (x ^ y).bit_count() <= near}
    want |= {(first[x], i, 0) for i, x in enumerate(hashes) if first[x] != i}
    assert sorted(map(tuple, frames.similar_pairs(rows, near).collect())) == sorted(want)


def test_candidates_of_random_hashes_are_few(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("pos"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("hash"))
    # Nine bands of seven bits made 9 / 128 of all pairs candidates; a hundredth of these is left.
    assert frames.candidates(rows).count() < 9 / 128 * n * (n - 1) / 2 / 90


def test_crowded_bands_make_few_candidates(spark):
    n = 3000  # hashes whose first 43 bits are equal
    rows = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("0" * 11), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 5)).alias("hash"))
    apart = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("0" * 5), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 11)).alias("hash"))
    assert frames.candidates(apart).count() < n * n / 2 / 20
    assert frames.similar_pairs(rows).count() > 0


def test_word_pairs_lose_none_and_compare_few(spark):
    rng = random.Random(7)
    words = ["sport", "news", "alpha", "kanal", "movies", "zwei", "één", "plus", "x1", "bravo", "quiz"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    a = [(f"w{i}", name()) for i in range(120)]
    b = [(f"p{i}", i, name()) for i in range(150)]
    w, p = spark.createDataFrame(a, "key string, a string"), spark.createDataFrame(b, "pool_key string, pos int, b string")
    import difflib

    for least in match.RATIOS.values():
        got = [(r.key, r.pool_key) for r in match.word_pairs(w, p, least).collect()]
        want = {(k, q) for k, x in a for q, _, y in b if difflib.SequenceMatcher(None, x, y).ratio() >= least}
        assert len(got) == len(set(got)) and want <= set(got)
        assert len(got) < len(a) * len(b) / 6


def test_summary_of_a_pool_of_many_names(spark):
    rows = spark.range(3000).select((F.col("id") % 2).cast("string").alias("channel_key"), F.when(F.col("id") % 5 != 0, F.format_string("n%05d", "id")).alias("name"), F.lit("UK | News").alias("group"), F.col("id").alias("src_pos"))
    got = {r.channel_key: r for r in pools.summary(rows).collect()}
    assert got["0"].names == ["n00002", "n00004", "n00006", "n00008", "n00012", "n00014"] and got["0"].n_streams == 1500


def test_one_long_list_is_worked_off_in_slices(spark):
    text = [(i, f"[G{i // 50 % 7}]" if i % 50 == 0 and i % 150 else "[]" if i % 150 == 0 else f"Channel {i} | id.{i}") for i in range(1200)]
    lines = spark.createDataFrame(text, "line_no int, value string").repartition(3)
    got = wantlist.parse(lines, Titles()).collect()
    assert {r.line_no: r.group for r in got} == {i: f"G{i // 50 % 7}" if i // 50 % 3 else None for i in range(1200) if i % 50}
    written = "\n".join(r.value for r in wantlist.rendered(wantlist.parse(lines, Titles())).orderBy("line_no").collect())
    assert written.count("[") == 23 and written.startswith("Channel 1 |") and "\n\n[G1]\nChannel 51 | id.51\n" in written
