"""Registered queries of what a curator sees: candidates, alerts, states, lists and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.functions import titles
from tallowick.functions.titles import Titles
from tallowick.operators import curate, guide, log, match, payload, pools, rank, search
from tallowick.plans import catalogue as cat
from tallowick.plans import guides
from tallowick.plans.registry import query, read
from tallowick.sources import guide as guide_files


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.ranked(cat._records(spark, sf_dir), tie=tuple(cat._RECORD_COLUMNS)).withColumn("stream_id", F.col("l_suppkey"))


@query(f"WITH {cat._RANKED_SQL} SELECT channel_key, list(l_suppkey ORDER BY rank) AS streams, list(CASE l_returnflag WHEN 'R' THEN 'dead' WHEN 'A' THEN 'dirty' ELSE 'ok' END ORDER BY rank) AS statuses, count(*) AS n FROM ranked GROUP BY 1")
def sheet_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payload.sheet(_ranked(spark, sf_dir), ("stream_id", "status"))
    return rows.select("channel_key", F.transform("candidates", lambda x: x["stream_id"]).alias("streams"), F.transform("candidates", lambda x: x["status"]).alias("statuses"), "n")


@query(f"""WITH {cat._RECORDS_SQL.replace("SELECT *, l_partkey AS channel_key,", "SELECT *, l_partkey AS channel_key, l_orderkey % 3 = 0 AS demoted,")}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY sr, demoted, area DESC, kbps DESC, fps DESC, codec, {cat._TIE}) AS rank FROM records)
SELECT channel_key, l_orderkey, l_linenumber, l_suppkey, demoted, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def demoted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("demoted_id"))
    rows = rank.with_demoted(cat._records(spark, sf_dir, "l_orderkey"), watched, "l_orderkey")
    return rank.ranked(rows, tie=tuple(cat._RECORD_COLUMNS)).filter("rank <= 3").select("channel_key", "l_orderkey", "l_linenumber", "l_suppkey", "demoted", "rank")


@query("""WITH c AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey % 3 <> 0), m AS (SELECT key, 'T' || key AS title, CAST(key % 100 AS INT) AS number, false AS missing FROM c UNION ALL SELECT p_partkey, p_name, p_size, true FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (FROM c))
SELECT key, title, number, missing, CAST(row_number() OVER (ORDER BY CASE WHEN key % 2 = 0 THEN 5000 - key ELSE 1000000 END, number, key) AS BIGINT) AS place FROM m""")
def channels_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with results and wanted ones without, in the order of the wanted list."""
    k = F.col("l_partkey")
    channels = read(spark, sf_dir, "lineitem").filter("l_partkey % 3 <> 0").select(k.alias("key"), F.concat(F.lit("T"), k).alias("title"), (k % 100).cast("int").alias("number")).distinct()
    wanted = read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("number"), (5000 - F.col("p_partkey")).alias("line_no"))
    return payload.in_order(payload.with_missing(channels, wanted), wanted).withColumn("place", F.col("place").cast("long"))


_ALERTS_SQL = f"""{cat._LOG_SQL}, h AS (SELECT *, lag(status) OVER w AS old_status, lag(height) OVER w AS old_height, lag(fps) OVER w AS old_fps, row_number() OVER (PARTITION BY rec_key ORDER BY seq DESC) AS back FROM log WINDOW w AS (PARTITION BY rec_key ORDER BY seq)),
l AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY CASE status WHEN 'dead' THEN 5 ELSE 0 END, fps DESC, seq) AS rank FROM h WHERE back = 1),
m AS (SELECT *, list_filter([CASE WHEN status <> old_status THEN 'status ' || old_status || ' -> ' || status END, CASE WHEN height <> old_height THEN 'height ' || old_height || ' -> ' || height END, CASE WHEN fps <> old_fps THEN 'fps ' || old_fps || ' -> ' || fps END], lambda x: x IS NOT NULL) AS msgs,
  (old_status <> 'dead' AND status = 'dead') OR height < old_height OR fps < old_fps AS negative FROM l WHERE old_status IS NOT NULL),
w AS (SELECT channel_key, flatten(list(msgs ORDER BY rank)) AS worse FROM m WHERE rank <= 2 AND negative GROUP BY 1),
p AS (SELECT channel_key, CASE WHEN channel_key % 5 = 0 THEN 'none' ELSE max(rec_key) END AS pick FROM l WHERE channel_key % 3 <> 0 GROUP BY 1),
d AS (SELECT p.channel_key, CASE WHEN c.status IS NULL THEN 'the stream you chose is gone from this run' WHEN c.status <> 'ok' AND b.status = 'ok' THEN 'your pick is now ' || c.status || '; ' || b.rec_key || ' is clean' ELSE b.rec_key || ' now ranks above your pick' END AS drift
  FROM p JOIN l b ON b.channel_key = p.channel_key AND b.rank = 1 LEFT JOIN l c ON c.rec_key = pick AND c.channel_key = p.channel_key WHERE pick <> b.rec_key)"""


@query(f"WITH {_ALERTS_SQL} SELECT coalesce(w.channel_key, d.channel_key) AS channel_key, list_filter(list_concat(coalesce(worse, []), [drift]), lambda x: x IS NOT NULL) AS changes FROM w FULL JOIN d ON w.channel_key = d.channel_key")
def change_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._log(spark, sf_dir)
    last = log.latest(rows, "rec_key", "seq").withColumn("name", F.col("rec_key"))
    ranked = rank.ranked(last, tie=("seq",))
    picks = last.filter("channel_key % 3 <> 0").groupBy("channel_key").agg(F.max("rec_key").alias("m")).select("channel_key", F.when(F.col("channel_key") % 5 == 0, "none").otherwise(F.col("m")).alias("primary"))
    return payload.alerts(ranked, log.changes(rows), picks)


_STATE_SQL = """s AS (SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['ok', 'dead'] WHEN 2 THEN ['dirty'] WHEN 3 THEN ['dead', 'ok'] ELSE ['ok'] END AS st, c_custkey % 11 = 0 AS missing, c_custkey % 7 = 0 AS dup, c_custkey % 13 = 0 AS mm FROM customer),
e AS (SELECT *, list_contains(st, 'ok') AS clean, coalesce(list_aggregate(list_transform(st, lambda x, i: i || ':' || x), 'string_agg', '|'), '') || '||' || CASE WHEN mm THEN 'g' || key || '>h' ELSE '' END AS ev, missing OR NOT list_contains(st, 'ok') OR dup OR mm AS review FROM s),
states AS (SELECT *, CASE WHEN missing THEN 'bad' WHEN key % 6 = 0 THEN 'off' WHEN key % 2 = 0 AND (key % 4 = 0 OR NOT review) THEN 'ok' WHEN NOT clean THEN 'bad' WHEN review THEN 'review' ELSE 'ok' END AS state,
  CASE WHEN key % 3 = 0 AND key % 9 <> 0 THEN ['x', 'y'] ELSE [] END AS changes FROM e)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("key")
    words = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("ok"), F.lit("dead"))).when(k % 5 == 2, F.array(F.lit("dirty"))).when(k % 5 == 3, F.array(F.lit("dead"), F.lit("ok"))).otherwise(F.array(F.lit("ok")))
    rows = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("number")).withColumn("statuses", words)
    candidates = F.transform("statuses", lambda x, i: F.struct((i + 1).cast("string").alias("stream_id"), x.alias("status")))
    mismatch = F.when(k % 13 == 0, F.struct(F.concat(F.lit("g"), k).alias("theirs"), F.lit("h").alias("ours")))
    rows = rows.withColumns({"missing": k % 11 == 0, "dup": k % 7 == 0, "mismatch": k % 13 == 0, "evidence": payload.signature(candidates, mismatch)})
    settled = F.when(k % 4 == 0, F.col("evidence")).otherwise("old")
    state = payload.state(*(F.col(c) for c in ("missing", "statuses", "dup", "mismatch")), F.when(k % 6 == 0, F.lit(False)), k % 2 == 0, settled, F.col("evidence"))
    changes = payload.active(F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("y"))), F.when(k % 9 == 0, "x␟y"))
    return rows.withColumns({"state": state, "changes": changes})


@query(f"WITH {_STATE_SQL} SELECT key, ev AS evidence, state, changes FROM states")
def channel_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("key", "evidence", "state", "changes")


@query(f"WITH {_STATE_SQL} SELECT count(*) FILTER (WHERE state IN ('review', 'bad')) AS needs_you, count(*) FILTER (WHERE len(changes) > 0) AS changed, count(*) AS total FROM states")
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.health(_states(spark, sf_dir))


@query(f"""WITH {_STATE_SQL} SELECT key, CASE WHEN missing THEN ['no stream matched this name'] ELSE list_concat(list_filter([CASE WHEN len(st) = 0 THEN 'nothing has been probed yet' END, CASE WHEN len(st) > 0 AND NOT clean THEN 'no clean stream: best is S (' || st[1] || ')' END,
CASE WHEN dup THEN 'a candidate is a holding card' END, CASE WHEN key % 17 = 0 THEN 'a candidate has another country''s frame rate' END], lambda x: x IS NOT NULL), changes) END AS reasons FROM states""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = payload.reasons(F.col("missing"), F.lit("S"), F.get("statuses", F.lit(0)), F.col("statuses"), F.col("dup"), F.col("key") % 17 == 0, F.col("changes"))
    return _states(spark, sf_dir).select("key", told.alias("reasons"))


@query(f"""WITH {_STATE_SQL}, c AS (SELECT states.*, c_name, c_nationkey FROM states JOIN customer ON c_custkey = key WHERE contains(lower(c_name), '#0000001') OR contains(CAST(c_nationkey AS VARCHAR), '#0000001'))
SELECT key, 'changed' AS shown FROM c WHERE len(changes) > 0 UNION ALL SELECT key, 'triage' FROM c WHERE state IN ('bad', 'review') UNION ALL SELECT key, 'off' FROM c WHERE state = 'off' UNION ALL SELECT key, 'all' FROM c UNION ALL SELECT c_custkey, 'number' FROM customer WHERE contains(CAST(c_nationkey AS VARCHAR), '17') OR contains(c_name, '17')""")
def channel_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir)
    shown = [search.channels_shown(rows, "#0000001", x).select("key", F.lit(x).alias("shown")) for x in ("changed", "triage", "off", "all")]
    out = search.channels_shown(rows, "17").select("key", F.lit("number").alias("shown"))
    for x in shown:
        out = out.union(x)
    return out


@query(f"""WITH {cat._RANKED_SQL}, c AS (SELECT channel_key, list_distinct([min(l_suppkey), max(l_suppkey)]) AS ch, min(l_suppkey) AS a, max(l_suppkey) AS b FROM records WHERE channel_key % 2 = 0 GROUP BY 1)
SELECT ranked.channel_key, l_orderkey, l_linenumber, l_suppkey, CAST(row_number() OVER (PARTITION BY ranked.channel_key ORDER BY CASE l_suppkey WHEN b THEN 0 WHEN a THEN 1 END NULLS LAST, rank) AS INT) AS place FROM ranked LEFT JOIN c USING (channel_key)""")
def candidates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    chosen = ranked.filter("channel_key % 2 = 0").groupBy("channel_key").agg(F.array(F.max("stream_id"), F.min("stream_id")).alias("streams"))
    return payload.candidate_order(ranked, chosen).select("channel_key", "l_orderkey", "l_linenumber", "l_suppkey", "place")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS channel_key, o_orderkey AS stream_id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 720 WHEN 3 THEN 0 ELSE 1024 END AS INT) AS w, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 576 WHEN 3 THEN 576 ELSE 768 END AS INT) AS h FROM orders),
s AS (SELECT *, w / h AS r FROM c WHERE w > 0 AND h > 0), n AS (SELECT channel_key, round(r, 2) AS rr, count(*) AS n, min(stream_id) AS seen_at FROM s GROUP BY 1, 2), m AS (SELECT channel_key, rr, row_number() OVER (PARTITION BY channel_key ORDER BY n DESC, seen_at) AS i FROM n),
o AS (SELECT channel_key, round(min(r), 2) AS own FROM s WHERE channel_key % 2 = 0 AND stream_id = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = channel_key) GROUP BY 1)
SELECT channel_key, stream_id, abs(r - coalesce(own, rr)) / coalesce(own, rr) > 0.03 AS off FROM s JOIN m USING (channel_key) LEFT JOIN o USING (channel_key) WHERE i = 1""")
def aspect_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey") % 5
    size = lambda *v: F.when(i == 0, v[0]).when(i == 1, v[1]).when(i == 2, v[2]).when(i == 3, v[3]).otherwise(v[4])
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel_key"), F.col("o_orderkey").alias("stream_id"), F.col("o_orderkey").alias("rank"), size(1920, 1280, 720, 0, 1024).alias("width"), size(1080, 720, 576, 576, 768).alias("height"))
    first = rows.filter("channel_key % 2 = 0").groupBy("channel_key").agg(F.min("stream_id").alias("primary"))
    return payload.aspects(rows, first)


@query(f"""WITH {cat._LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY seq) AS place FROM log) SELECT seq, coalesce(count(*) FILTER (WHERE status = 'ok') OVER (PARTITION BY channel_key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 4 AS skipped FROM r""")
def early_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.early_stops(cat._log(spark, sf_dir).withColumn("place", F.col("seq"))).select("seq", "skipped")


@query("""WITH r AS (SELECT user_id % 30 AS lineup, 'run' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS run_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS done FROM events)
SELECT n_nationkey AS name, coalesce(n, 0) AS runs, last_completed FROM nation LEFT JOIN (SELECT lineup, count(*) AS n, arg_max(done, run_id) FILTER (WHERE done IS NOT NULL AND done <> 0) AS last_completed FROM r GROUP BY 1) ON lineup = n_nationkey""")
def run_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    runs = read(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("lineup"), F.concat(F.lit("run"), F.lpad(i.cast("string"), 6, "0")).alias("run_id"), F.when(i % 3 == 0, i.cast("double")).alias("last_completed"))
    return payload.last_completed(read(spark, sf_dir, "nation").selectExpr("n_nationkey as name"), runs)


@query("""SELECT c_custkey AS channel_key, coalesce(q, 0) AS queued, coalesce(s, 0) AS skipped, coalesce(q, 0) * 31 AS eta_seconds FROM customer LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS q, count(*) FILTER (WHERE event_type = 'error') AS s FROM events GROUP BY 1) ON user_id = c_custkey""")
def diagnosis_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.diagnosis(cat._log(spark, sf_dir), read(spark, sf_dir, "customer").selectExpr("c_custkey as channel_key"))


@query("""WITH l AS (SELECT c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 7 END AS days, CASE WHEN c_custkey % 3 = 0 THEN 5 END AS h, CASE WHEN c_custkey % 5 = 0 THEN 3 END AS d, CASE WHEN c_custkey % 50 = 0 THEN 1704333600.0 + c_custkey - 700 END AS once FROM customer),
r AS (SELECT o_custkey AS name, max(1704333600.0 - (o_orderkey % 300) * 3600) AS last FROM orders GROUP BY 1)
SELECT name, coalesce(once <= 1704333600, false) AS once FROM l LEFT JOIN r USING (name) WHERE coalesce(once <= 1704333600, false) OR (coalesce(days, 0) > 0 AND 2 = coalesce(h, 2) AND (days <> 7 OR 3 = coalesce(d, 0)) AND 1704333600 - coalesce(last, 0) >= days * 86400 - 7200)""")
def lineups_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-ups that are due on Thursday, 4 January 2024, at two o'clock."""
    k, now = F.col("c_custkey"), 1704333600.0
    lineups = read(spark, sf_dir, "customer").select(k.alias("name"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 1).when(k % 4 == 2, 7).alias("schedule_days"), F.when(k % 3 == 0, 5).alias("schedule_hour"), F.when(k % 5 == 0, 3).alias("schedule_weekday"), F.lit(None).cast("double").alias("last_scheduled"), F.when(k % 50 == 0, k + F.lit(now) - 700).alias("once_at"))
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lineup"), F.lit(None).cast("double").alias("last_completed"), (F.lit(now) - F.col("o_orderkey") % 300 * 3600).alias("started"))
    return payload.due_lineups(lineups, runs, F.lit(now))


@query(f"""WITH {cat.STREAMS_SQL}, g AS (SELECT channel_key, list_sort(list_distinct(list(name)))[:6] AS names, arg_min(name, length(name) * 1000000000 + 0) AS d FROM streams GROUP BY 1), b AS (SELECT channel_key, name AS display FROM (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY length(name), name) AS i FROM streams) WHERE i = 1)
SELECT channel_key FROM g JOIN b USING (channel_key) WHERE contains(lower(display), 'red') OR len(list_filter(names, lambda x: contains(lower(x), 'red'))) > 0""")
def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pools.summary(pools.candidates(cat.streams(spark, sf_dir), Titles()))
    return search.pools_shown(rows, "RED").select("channel_key")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 5 = 0 AND event_id % 3 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 7 = 0")
def sheet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._log(spark, sf_dir).select(F.col("seq").alias("event_id"), "status", (F.col("seq") % 3 == 0).alias("include"), (F.col("seq") % 7 == 0).alias("dup"))
    return search.sheet_shown(rows, problems=True, included=True, hide_dead=True).select("event_id").union(search.sheet_shown(rows, dupes=True).select("event_id"))


@query("""SELECT p_type AS guide_id, count(*) AS alts FROM part GROUP BY 1 HAVING bool_or(contains(p_name, 'ring')) OR contains(lower(p_type), 'ring')""")
def guide_import_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("guide_id"), F.col("p_type").alias("guide_name")).agg(F.collect_list(F.struct(F.col("p_name").alias("guide_name"))).alias("alts"))
    return search.guide_channels_shown(rows, "RING").select("guide_id", F.size("alts").cast("long").alias("alts"))


@query("""SELECT CASE WHEN d = 'dup' THEN 'dup' ELSE 'lowmo' END AS dimension, count(*) AS better FROM (SELECT 'dup' AS d FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 2 = 0 UNION ALL SELECT 'lowmo' FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 = 0) GROUP BY 1""")
def flags_avoided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") == 1).alias("algorithm_dup"), (F.col("l_suppkey") % 2 != 0).alias("curator_dup"), (F.col("l_returnflag") == "R").alias("algorithm_lowmo"), F.when(F.col("l_suppkey") % 3 != 0, F.lit(True)).alias("curator_lowmo"), F.lit(False).alias("algorithm_slow"), F.lit(False).alias("curator_slow"))
    return curate.avoided(rows, ("dup", "lowmo", "slow"))


@query("SELECT event_id AS pos, event_type AS title FROM events ORDER BY event_id DESC LIMIT 25")
def recent_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.recent(read(spark, sf_dir, "events").selectExpr("event_id as pos", "event_type as title"))


@query(f"""WITH {guides._ANSWERS_SQL}, o AS (SELECT a.row, a.source, guide_id, row_number() OVER (PARTITION BY a.row ORDER BY CASE WHEN a.row % 4 = 0 AND a.source = 'EUROPE' THEN 0 ELSE 1 END, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END NULLS LAST, a.source) AS i FROM a JOIN region ON r_name = a.source WHERE guide_id IS NOT NULL),
c AS (SELECT n_nationkey AS row, CASE WHEN n_nationkey % 7 = 0 THEN 'id' || ((n_nationkey + 1) % 25) ELSE 'tallowick.' || lower(replace(n_name, '_', '')) END AS id, n_name || ' TV' AS name FROM nation)
SELECT CAST(1 AS INT) AS section, '<channel id="' || id || '"><display-name>' || name || '</display-name></channel>' AS value FROM c
UNION ALL SELECT 2, '<programme channel="' || c.id || '" start="' || strftime(ts, '%Y%m%d%H%M%S') || ' +0000"><title>' || event_type || '</title></programme>' FROM c JOIN o ON o.row = c.row AND i = 1 JOIN events ON 'id' || user_id = guide_id AND (event_id + length(o.source)) % 2 = 0""")
def guide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guide for exported channels: all of them, then the programmes of the guide each was resolved to."""
    wanted, sources, _, answers = guides._guides(spark, sf_dir)
    chosen = guide.chosen_guides(answers, sources, wanted.filter("row % 4 = 0").select("row", F.lit("EUROPE").alias("pick")))
    own = wanted.select("row", F.coalesce("tvg_id", F.concat(F.lit("tallowick."), F.lower("key"))).alias("export_id"), "name")
    channels = own.select(F.col("export_id").alias("guide_id"), "name", F.col("row").cast("long").alias("chan_pos"))
    e = read(spark, sf_dir, "events").join(sources.select("source"), (F.col("event_id") + F.length("source")) % 2 == 0)
    shows = e.select("source", F.concat(F.lit("id"), "user_id").alias("guide_id"), F.col("ts").alias("start"), F.lit(None).cast("timestamp_ntz").alias("stop"), F.col("event_type").alias("title"), F.col("event_id").alias("prog_pos"))
    programmes = chosen.join(shows, ["source", "guide_id"]).join(own, "row").select(F.col("export_id").alias("guide_id"), "start", "stop", "title", "prog_pos")
    return guide_files.written(channels, programmes).filter("section in (1, 2)").select("section", "value")


@query()
def wanted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted names that resemble a pool's by their words in order; the ratio is beyond SQL."""
    p = read(spark, sf_dir, "part")
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos")).withColumn("key", F.upper(F.replace("name", F.lit(" "), F.lit(""))))
    word = lambda i: F.get(F.split("name", " "), F.lit(i))
    wanted = names.select(F.concat(F.lit("W"), "key").alias("key"), F.concat_ws(" ", word(1), F.concat(word(0), F.lit("s"))).alias("name"))
    return match.by_words(wanted, names, "relaxed")


@query()
def logo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names most like a channel's key; the ratio is beyond SQL."""
    files = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"), Titles().key_column("p_name").alias("file_key"))
    return search.logos(files, "REDWIDGET")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'BBC One' ELSE 'Sky One' END AS family, CASE WHEN p_partkey % 4 = 0 THEN '4.uk' ELSE p_name END AS shown FROM part")
def names_without_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(" Yorks and Lincs"))).when(k % 3 == 1, "BBC One EastHD").otherwise("Sky One")
    return read(spark, sf_dir, "part").select("p_partkey", titles.without_region(name).alias("family"), titles.shown_name(F.when(k % 4 == 0, "4.uk").otherwise(F.concat("p_name", F.lit(".uk")))).alias("shown"))


