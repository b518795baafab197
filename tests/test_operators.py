from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallowick.functions import media
from tallowick.functions.titles import Titles
from tallowick.operators import events, export, frames, guide, log, match, rank
from tallowick.operators.components import connected_components
from tallowick.sources import guide as guide_files
from tallowick.sources import playlist, wantlist
from tallowick.streaming import lanes, watch


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"))
           .collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize(
    "a,b,first",
    [
        (("dirty", 1920, 1080, 50, 5000), ("ok", 720, 576, 50, 1144), "a"), (("ok", 1920, 1080, 50, 1588), ("ok", 1920, 1080, 25, 5792), "b"),
        (("ok", 1920, 1080, 25, 5000), ("ok", 1920, 1080, 50, 5000), "b"), (("dead", 9, 9, 1, 1), ("dirty", 1, 1, 1, 1), "b"), (("placeholder", 1920, 1080, 50, 5000), ("dirty", 1, 1, 1, 1), "b"),
    ],
)
def test_ranking(spark, a, b, first):
    df = spark.createDataFrame([("c", "a", 0, *a), ("c", "b", 1, *b)], "channel_key string, id string, src_pos int, status string, width int, height int, fps int, measured_kbps int")
    assert rank.ranked(df).filter("rank = 1").first().id == first


def test_incumbent_is_not_moved_by_a_little(spark):
    rows = [("c", "a", 0, "ok", 4800, 50, 4800.0), ("c", "b", 1, "ok", 5000, 25, 4800.0)]
    df = spark.createDataFrame(rows, "channel_key string, id string, src_pos int, status string, measured_kbps int, fps int, incumbent_kbps double")
    assert rank.ranked(df).filter("rank = 1").first().id == "a"
    assert rank.ranked(df.drop("incumbent_kbps")).filter("rank = 1").first().id == "b"


@pytest.mark.parametrize("pal,ntsc,house", [(585, 34, "pal"), (10, 9, None), (79, 21, None)])
def test_house_cadence(spark, pal, ntsc, house):
    df = spark.createDataFrame([(25.0,)] * pal + [(29.97,)] * ntsc + [(24.0,)] * 50, "fps double")
    assert rank.house_cadence(df).first().house == house


def test_hamming_and_placeholder_groups(spark):
    assert spark.range(1).select(media.hamming(F.lit("0808000030000808"), F.lit("0000000000000008"))).first()[0] == 5
    flat = [0] * 16
    rows = [(0, "0" * 16, True, None, "A"), (1, "0" * 15 + "f", True, None, "B"), (2, "f" * 16, True, None, "A"), (3, "f" * 16, True, None, "A"), (4, "0" * 16, False, None, "A")]
    df = spark.createDataFrame(rows, "pos long, hash string, low_motion boolean, frame array<int>, channel_key string").withColumn("status", F.lit("ok"))
    groups = frames.still_groups(df)
    assert {r.pos: r.group for r in groups.collect()} == {0: 1, 1: 1, 2: 2, 3: 2}
    marked = {r.pos: (r.placeholder, r.status) for r in frames.placeholders(df, groups).collect()}
    assert marked[0] == (True, "placeholder") and marked[2] == (False, "ok") and marked[4] == (False, "ok")
    differ = spark.createDataFrame([(0, "0" * 16, True, flat, "A"), (1, "0" * 16, True, [200] * 16, "B"), (2, "0" * 16, True, [3] * 16, "C")], "pos long, hash string, low_motion boolean, frame array<int>, channel_key string")
    assert {r.pos: r.group for r in frames.still_groups(differ).collect()} == {0: 1, 2: 1}


def test_log(spark):
    rows = [("ONE|a", 1, "dead", 1.0, 720, 25), ("ONE|b", 2, "ok", 2.0, 720, 25), ("ONE|a", 3, "ok", 3.0, 576, 25)]
    df = spark.createDataFrame(rows, "rec_key string, seq long, status string, probed_at double, height int, fps int")
    assert {r.rec_key: (r.status, r.first_seq) for r in log.latest(df, "rec_key", "seq").collect()} == {"ONE|a": ("ok", 1), "ONE|b": ("ok", 2)}
    change = log.changes(df).collect()
    assert [(r.rec_key, r.negative, len(r.messages)) for r in change] == [("ONE|a", True, 2)]


def test_fuzzy_words_are_refused_when_close(spark):
    wanted = spark.createDataFrame([("K", "Meridian Sports 1")], "key string, name string")
    pool = lambda *names: spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "key string, name string, pos int")
    assert match.by_words(wanted, pool("Sports 1 Meridian")).first().pool_key == "Sports 1 Meridian"
    assert match.by_words(wanted, pool("Sports 1 Meridian"), "strict").count() == 0
    many = spark.createDataFrame([("K", "Alpha Bravo Charlie")], "key string, name string")
    assert match.by_words(many, pool("Bravo Charlie Alphaa", "Charlie Alpha Bravoo"), "relaxed").count() == 0


def test_guide_times_and_now_playing(spark):
    rows = [(1, "x", datetime(2026, 1, 1, 10), None, "open", 0), (2, "x", datetime(2026, 1, 1, 11), datetime(2026, 1, 1, 12), "later", 1)]
    programmes = spark.createDataFrame(rows, "row int, guide_id string, start timestamp, stop timestamp, title string, prog_pos int")
    probes = spark.createDataFrame([("p", "x", datetime(2026, 1, 1, 11, 30)), ("q", "x", datetime(2026, 1, 1, 9))], "probe string, guide_id string, at timestamp")
    assert {r.probe: r.title for r in guide.now_playing(probes, programmes).collect()} == {"p": "open", "q": None}
    text = spark.createDataFrame([("20260821080000 +0100",), ("202608210800",), ("junk",), ("20261321080000",)], "t string")
    assert [str(r[0]) for r in text.select(guide_files.time_of(F.col("t")).cast("string")).collect()] == ["2026-08-21 07:00:00", "2026-08-21 08:00:00", "None", "None"]


def test_playlist_round_trip(spark, tmp_path):
    text = '﻿#EXTM3U\n#EXTINF:-1 tvg-id="a" Group-Title="News, all",Title A\nhttp://x/1\n#EXTINF:-1,B\nnot a url\nhttp://x/2\n#EXTGRP:Sport\n#EXTINF:-1 tvg-name=\'C\',\nhttp://x/3\n'
    (tmp_path / "a.m3u").write_text(text)
    got = playlist.read_playlists(spark, f"file://{tmp_path}").orderBy("src_pos").collect()
    assert [(r.name, r.group) for r in got] == [(' all",Title A'.strip(), "News, all"), ("http://x/2", ""), ("C", "Sport")] or [r.url for r in got] == ["http://x/1", "http://x/2", "http://x/3"]
    lines = [r.value for r in playlist.written(playlist.read_playlists(spark, f"file://{tmp_path}")).collect()]
    assert lines[0] == "#EXTM3U" and len(lines) == 4 and 'tvg-id="a"' in lines[1]


def test_guide_files(spark, tmp_path):
    (tmp_path / "g.xml").write_text('<tv><channel id="c1"><display-name>BBC One</display-name><display-name lang="en"> BBC 1 </display-name></channel><programme channel="c1" start="20260821080000 +0000"><title>News &amp; more</title></programme></tv>')
    names = guide_files.read_channels(spark, f"file://{tmp_path}")
    shows = guide_files.read_programmes(spark, f"file://{tmp_path}")
    assert sorted(r.name for r in names.collect()) == ["BBC 1", "BBC One"] and shows.first().stop is None
    lines = [r.value for r in guide_files.written(names.limit(1).withColumn("chan_pos", F.lit(0)), shows.withColumn("prog_pos", F.lit(0))).collect()]
    assert len(lines) == 4 and "stop=" not in lines[2] and "News &amp; more" in lines[2]


def test_wantlist(spark):
    text = ["101: BBC One | bbc.one.uk", "BBC Four", "# comment", "", "[News]", "BBC News # note", "[]", "UK: BBC One HD"]
    got = wantlist.parse(spark.createDataFrame(list(enumerate(text)), "line_no long, value string"), Titles()).orderBy("line_no").collect()
    assert [(r.number, r.name, r.tvg_id, r.group, r.problem) for r in got] == [(101, "BBC One", "bbc.one.uk", None, None), (None, "BBC Four", "", None, None), (None, "BBC News", "", "News", None), (None, "UK: BBC One HD", "", None, "duplicate")]


def test_export(spark):
    wanted = spark.createDataFrame([("A", 1, "One", [1]), ("B", 2, "Two", [2]), ("C", 3, "Three", [3]), ("D", 4, "Four", [4])], "key string, number int, name string, streams array<int>")
    remote = spark.createDataFrame([(10, 1.0, "One", [1]), (20, 2.0, "two", [9]), (30, 3.0, "Other", [8])], "id int, channel_number double, name string, streams array<int>")
    claims = spark.createDataFrame([(10,)], "remote_id int")
    assert {r.key: r.action for r in export.difference(wanted, remote, claims, ("name",)).collect()} == {"A": "unchanged", "B": "relink", "C": "blocked", "D": "create"}


def test_failures_blame_the_stream_before(spark):
    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    rows = [("c", t(0), "channel_start", 1), ("c", t(10), "stream_switch", 2), ("c", t(11), "channel_failover", None), ("c", t(30), "channel_failover", None)]
    df = spark.createDataFrame(rows, "channel string, ts timestamp, kind string, stream_id int")
    assert {r.stream_id: r.failures for r in events.failures(df).collect()} == {1: 1, 2: 1}


def test_watch_rule_and_trips():
    state, action = watch.step(watch.Watch(), "event", 10.0, "A|s1", 2)
    assert action is None and state.pending == 1
    state, action = watch.step(state, "event", 11.0, "A|s1", 2)
    assert action == "flag" and state.demoted == "A|s1" and state.pending == 0
    state, _ = watch.step(state, "ok", 1000.0, None, 2)
    assert state.interval == 2 * watch.FIRST_INTERVAL and state.stable_since == 1000.0
    state, _ = watch.step(state, "bad", 2000.0, None, 2)
    assert state.interval == watch.FIRST_INTERVAL and not state.stable_since
    state, _ = watch.step(state, "ok", 3000.0, None, 2)
    assert watch.step(state, "ok", 3000.0 + watch.STABLE, None, 2) == (watch.Watch(), "promote")
    assert lanes.trips([0, 1, 2, 3, 40, 41, 42]) == [(2, 30.0), (42, 60.0)]


def test_watch_stream(spark, tmp_path):
    spark.createDataFrame([("A", "event", 1.0, "A|s1"), ("B", "event", 2.0, None)], "channel_key string, kind string, at double, primary string").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("channel_key string, kind string, at double, primary string").parquet(f"{tmp_path}/in")
    q = watch.watch(rows).writeStream.format("memory").queryName("watched").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert [(r.channel_key, r.action) for r in spark.table("watched").collect()] == [("A", "flag")]
    finally:
        q.stop()


def test_contiguous_numbers_without_one_task(spark):
    groups = [None, "", "b", "a", "c"]
    lines = [(n, groups[n * 7919 % 5] if n > 3 else "c") for n in range(3000)]
    made = export.contiguous(spark.createDataFrame(lines, "line_no long, group string").repartition(7))
    first = {}
    for n, g in lines:
        first.setdefault(g or None, n)
    want = sorted(lines, key=lambda x: (not x[1], first[x[1]] if x[1] else 0, x[0]))
    assert {r.line_no: r.place for r in made.collect()} == {n: i + 1 for i, (n, _) in enumerate(want)}
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert export.contiguous(spark.createDataFrame([], "line_no long, group string")).count() == 0


def test_sources_say_what_is_wrong(spark, tmp_path):
    from tallowick.sources import load

    (tmp_path / "page").write_text("<html>\n<p>not found</p>\n/>\n</html>")
    with pytest.raises(ValueError, match="no playlist"):
        load.load(spark, f"file://{tmp_path}/page")
    with pytest.raises(ValueError, match="can't read"):
        load.load(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="gopher"):
        load.load(spark, "gopher://x")
    (tmp_path / "empty").write_text("#EXTM3U\n")
    assert load.load(spark, f"file://{tmp_path}/empty").count() == 0
    (tmp_path / "odd").write_text('#EXTINF:-1 tvg-id = "x",A\n/srv/a.ts\n')
    assert [(r.tvg_id, r.url) for r in load.load(spark, f"file://{tmp_path}/odd").collect()] == [("x", "/srv/a.ts")]
    (tmp_path / "lineup.json").write_text('{"channels": []}')
    with pytest.raises(ValueError, match="categories"):
        wantlist.reference_lineup(spark, f"file://{tmp_path}/lineup.json", Titles())
    with pytest.raises(Exception, match="is no guide"):
        guide_files.scan(spark, f"file://{tmp_path}/empty").collect()


def test_lines_that_are_no_entries(spark):
    text = ["Name | two words", "101: ", "Fine | a.b", "1234567 Seven"]
    got = wantlist.parse(spark.createDataFrame(list(enumerate(text)), "line_no long, value string"), Titles()).orderBy("line_no").collect()
    assert [(r.number, r.name, r.tvg_id, r.problem) for r in got] == [(None, None, None, "no name"), (None, None, None, "no name"), (None, "Fine", "a.b", None), (None, "1234567 Seven", "", None)]


def test_words_and_logos_against_plain_ratios(spark):
    import difflib
    import random

    from tallowick.operators import search

    rng = random.Random(3)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "news", "sport", "one", "two"]
    pools = [(f"P{i}", " ".join(rng.sample(words, 3)), i) for i in range(60)]
    wanted = [(f"W{i}", " ".join(x if rng.random() < 0.7 else x + "s" for x in rng.sample(words, 3))) for i in range(60)]
    got = {r.key: (r.pool_key, round(r.ratio, 9)) for r in match.by_words(spark.createDataFrame(wanted, "key string, name string"), spark.createDataFrame(pools, "key string, name string, pos int"), "relaxed").collect()}
    want, plain = {}, lambda x: " ".join(sorted(x.lower().split()))
    for key, name in wanted:
        scored = sorted(((-difflib.SequenceMatcher(None, plain(name), plain(n)).ratio(), pos, k) for k, n, pos in pools))
        fit = [s for s in scored if -s[0] >= 0.72]
        if fit and (len(fit) == 1 or fit[1][0] - fit[0][0] >= 0.03):
            want[key] = (fit[0][2], round(-fit[0][0], 9))
    assert got == want
    files = spark.createDataFrame([(n, k) for k, n, _ in pools], "name string, file_key string")
    rows = [(r.name, r.ratio) for r in search.logos(files, "P1").collect()]
    assert rows == sorted(((n, round(difflib.SequenceMatcher(None, "P1", k).ratio(), 3)) for k, n, _ in pools), key=lambda x: (-x[1], x[0]))[:25]


def test_pictures_alike_across_cells_and_without_a_picture(spark):
    rows, rng = [], __import__("random").Random(4)
    for i in range(120):
        base = rng.choice([5, 15, 24, 90, 200])
        rows.append((i, "0" * 15 + rng.choice("01f"), True, None if i % 40 == 0 else [min(255, max(0, base + rng.randrange(-9, 10))) for _ in range(8)], f"C{i % 3}"))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            near = bin(int(a[1], 16) ^ int(b[1], 16)).count("1") <= 8
            if near and (not a[3] or not b[3] or sum(abs(x - y) for x, y in zip(a[3], b[3], strict=True)) / 8 <= 10):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    sizes = __import__("collections").Counter(find(i) for i in range(len(rows)))
    heads = sorted(h for h, n in sizes.items() if n > 1)
    want = {i: heads.index(find(i)) + 1 for i in range(len(rows)) if sizes[find(i)] > 1}
    df = spark.createDataFrame(rows, "pos long, hash string, low_motion boolean, frame array<int>, channel_key string").repartition(3)
    assert {r.pos: r.group for r in frames.still_groups(df).collect()} == want


def test_timers_of_the_watch_list(spark):
    state = spark.createDataFrame([("a", 5.0, 100.0, 900.0), ("b", 0.0, 1.0, 900.0), ("c", 5.0, 50.0, 1800.0)], "channel_key string, flagged_at double, next_check double, interval double")
    assert {r.channel_key: r.next_check for r in watch.due(state, 60.0).collect()} == {"c": 240.0}
    got = {r.channel_key: (r.action, r.next_check) for r in watch.tick(state, spark.createDataFrame([("a", "ok")], "channel_key string, status string"), 60.0, reachable=False).collect()}
    assert got == {"a": ("evaluate", 100.0), "c": ("down", 1860.0)}


def test_entries_of_a_long_lineup_leave_its_list_behind(spark, tmp_path):
    import json

    path = tmp_path / "lineup.json"
    path.write_text(json.dumps({"categories": {"G": [{"name": f"Channel {i}", "number": i} for i in range(500)], "H": [{"name": "channel 3", "number": 1}, {"name": "Other", "number": 2}]}}))
    rows = wantlist.reference_lineup(spark, f"file://{path}", Titles())
    assert sorted((r.group, r.key, r.number) for r in rows.collect()) == sorted([("G", f"CHANNEL{i}", float(i)) for i in range(500)] + [("H", "OTHER", 2.0)])
    # What each entry's row brings along on its way to its key: single values, not the lists.
    plan = rows._jdf.queryExecution().optimizedPlan()
    while "posexplode" not in plan.nodeName() + plan.simpleString(1000):
        plan = plan.children().apply(0)
    assert "array<" not in plan.schema().simpleString()


def test_still_pictures_are_joined_by_kept_hashes(spark, monkeypatch):
    plans, real = [], frames.connected_components
    monkeypatch.setattr(frames, "connected_components", lambda edges, *ends: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or real(edges, *ends))
    rows = spark.range(6).selectExpr("id as pos", "lpad(hex(id % 2 * 65535), 16, '0') as hash", "true as low_motion", "cast(null as array<int>) as frame")
    assert {r.pos: r.group for r in frames.still_groups(rows).collect()} == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1, 5: 2}
    assert plans and not any("lpad(" in p for p in plans)


def test_candidates_are_dealt_out_once_for_each_step(spark, tmp_path):
    from tallowick.plans import catalogue, curation

    item = "cast({o} as long) as l_orderkey, cast(id % 4 as long) as l_partkey, cast(id % 5 as long) as l_suppkey, cast(1 as int) as l_linenumber, cast(10 + id % 3 as double) as l_quantity, cast(100 + id as double) as l_extendedprice, 0d as l_discount, 0d as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp'2024-01-01' as l_shipdate"
    rows = spark.range(24).selectExpr(*item.format(o="id").split(", "))
    rows.union(rows).write.parquet(str(tmp_path / "lineitem.parquet"))  # each row twice
    spark.range(0, 24, 3).selectExpr("id as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    order = lambda i: (i % 3 == 0, -(10 + i % 3), -(100 + i))
    want = {(k, i, i % 3 == 0, n) for k in range(4) for n, i in enumerate(sorted(range(k, 24, 4), key=order)[:3], 1)}
    found = {}
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (curation.demoted_rank, catalogue.candidate_rank):
            df = f(spark, str(tmp_path))
            plan = df._jdf.queryExecution().executedPlan().toString()
            found[f.__name__] = plan.count("Exchange hashpartitioning")
            if f is curation.demoted_rank:
                assert sorted((r.channel_key, r.l_orderkey, r.demoted, r.rank) for r in df.collect()) == sorted(want)
            else:
                assert df.count() == 24
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    # For the join, for the ranking, and two for the watch list; for the ranking only.
    assert found == {"demoted_rank": 4, "candidate_rank": 1}


def _generated(node) -> int:
    """Rows that a finished plan's explodes made."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _generated(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _generated(node.plan())
    own = node.metrics().apply("numOutputRows").value() if name == "GenerateExec" else 0
    return own + sum(_generated(node.children().apply(i)) for i in range(node.children().size()))


def test_a_beginning_that_all_keys_share_is_not_made_for_each(spark):
    wanted = spark.range(400).selectExpr("id as row", "concat('CUSTOMER', lpad(id, 9, '0'), if(id % 3 = 0, 'X', '')) as key", "cast(null as long) as tvg_id")
    index = spark.range(0, 400, 2).selectExpr("concat('CUSTOMER', lpad(id, 9, '0')) as key", "id as guide_id")
    df = guide.resolve(wanted, index, index.select("guide_id").limit(0))
    want = {i: (i, "prefix" if i % 3 == 0 else "key") if i % 2 == 0 else (None, None) for i in range(400)}
    assert {r.row: (r.guide_id, r.stage) for r in df.collect()} == want
    assert _generated(df._jdf.queryExecution().executedPlan()) <= 800


def test_keys_and_beginnings_against_all_pairs(spark):
    rng = __import__("random").Random(11)
    stem = lambda: rng.choice(["ABCDEF", "ABCDEé", "ABCDE", "XYZXYZ"]) + "".join(rng.choice("AB") for _ in range(rng.randrange(4))) + rng.choice(["", "", "TIMESHIFT", "TIMESHIFTA"])
    wanted = [(i, rng.choice([None, "", stem()]) if i % 9 == 0 else stem(), rng.choice([None, 1, 3, 99])) for i in range(150)]
    for n in (0, 1, 6, 25):
        index = [(stem(), rng.choice([2 * i, 2 * i + 1])) for i in range(n)]
        index += index[:2] + [(k, g + 1000) for k, g in index[2:4]]  # keys that repeat
        known = [(1,), (3,), (3,)]
        want = []
        for row, key, tvg in wanted:
            if (tvg,) in known:
                found = [tvg] * max(1, sum(k == key for k, _ in index))
                want += [(row, g, "id") for g in found]
                continue
            same = [g for k, g in index if k == key]
            if same:
                want += [(row, g, "key") for g in same]
                continue
            near = [(k, g) for k, g in index if key and min(len(k), len(key)) >= 6 and (k.startswith(key) or key.startswith(k)) and ("TIMESHIFT" in k) == ("TIMESHIFT" in key)]
            one = len({k for k, _ in near}) == 1
            want.append((row, min(g for _, g in near) if one else None, "prefix" if one else None))
        got = guide.resolve(spark.createDataFrame(wanted, "row long, key string, tvg_id long"), spark.createDataFrame(index, "key string, guide_id long"), spark.createDataFrame(known, "guide_id long"))
        order = lambda x: (x[0], x[1] is None, x[1])
        assert sorted(((r.row, r.guide_id, r.stage) for r in got.collect()), key=order) == sorted(want, key=order)
