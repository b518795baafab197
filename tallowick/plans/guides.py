"""Registered queries of pools, searches, guides and remote lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.functions import titles
from tallowick.functions.titles import Titles
from tallowick.operators import events, frames, guide, log, pools, remote, search
from tallowick.plans import catalogue as cat
from tallowick.plans.registry import pick, query, read, sql_pick

_SHIFTS = (" +1", " + 2H", " -24", "!!", "")


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("src_pos"), F.when(k % 5 == 3, "!! [x]").otherwise(F.concat("p_name", pick(_SHIFTS, k))).alias("name"), F.lit("").alias("group"))


@query("SELECT p_partkey AS src_pos, upper(replace(p_name, ' ', '')) AS channel_key FROM part WHERE p_partkey % 5 = 4")
def timeshift_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidates(_shifted(spark, sf_dir), Titles()).select("src_pos", "channel_key")


@query(f"SELECT p_partkey AS src_pos, upper(replace(p_name, ' ', '')) || {sql_pick(('TIMESHIFT1', 'TIMESHIFT2', 'TIMESHIFT24', '', ''), 'p_partkey')} AS channel_key FROM part WHERE p_partkey % 5 <> 3")
def timeshift_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidates(_shifted(spark, sf_dir), Titles(), include_timeshift=True).select("src_pos", "channel_key")


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidates(cat.streams(spark, sf_dir), Titles())


@query(f"WITH {cat.STREAMS_SQL} SELECT src_pos, channel_key FROM streams WHERE channel_key IN (SELECT channel_key FROM streams GROUP BY 1 HAVING count(*) >= 30)")
def min_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.with_members(_pools(spark, sf_dir), 30).select("src_pos", "channel_key")


@query(f"WITH {cat.STREAMS_SQL}, k AS (SELECT DISTINCT channel_key FROM streams ORDER BY 1 LIMIT 7) SELECT src_pos, channel_key FROM streams WHERE channel_key IN (FROM k)")
def first_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.first_channels(_pools(spark, sf_dir), 7).select("src_pos", "channel_key")


@query(f"WITH {cat.STREAMS_SQL} SELECT src_pos, channel_key FROM streams WHERE channel_key IN (SELECT upper(replace(p_name, ' ', '')) FROM part WHERE p_partkey % 97 = 0)")
def only_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "part").filter("p_partkey % 97 = 0").select(Titles().key_column(F.concat(F.lit("UK: "), "p_name")).alias("channel_key"))
    return pools.of_channels(_pools(spark, sf_dir), keys).select("src_pos", "channel_key")


@query(f"""WITH {cat.STREAMS_SQL}, r AS (SELECT region, count(*) AS n FROM streams WHERE region IS NOT NULL GROUP BY 1), t AS (SELECT count(*) AS s, count(DISTINCT channel_key) AS c FROM streams)
SELECT (SELECT count(*) FROM r) AS regions, (SELECT list(region || ' ' || n ORDER BY n DESC, region) FROM r) AS spread, round(s / c, 1) AS per_channel, (SELECT count(*) FROM r) >= 4 AS diverse, s > 6 * c AS many FROM t""")
def region_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.region_warning(_pools(spark, sf_dir))


@query(f"""WITH {cat._LOG_SQL}, c AS (SELECT channel_key, count(*) AS n, bool_or(status = 'ok') AS clean FROM log GROUP BY 1) SELECT count(*) AS channels, CAST(sum(n) AS BIGINT) AS candidates, count(*) FILTER (WHERE clean) AS with_clean FROM c""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.totals(cat._log(spark, sf_dir))


@query("""WITH s AS (SELECT user_id AS channel_key, bool_or(event_type <> 'error' AND event_id % 5 <> 0) AS clean, CAST(max(event_id) AS DOUBLE) AS last_seen FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT u AS channel_key, clean, last_seen FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN s ON u = channel_key""")
def probe_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._log(spark, sf_dir)
    return pools.worklist(rows, rows.filter("seq % 3 = 0")).select("channel_key", "clean", "last_seen")


@query(f"""WITH {cat._PROGRAMMES_SQL}, w AS (SELECT TIMESTAMP '2024-01-03' AS b, TIMESTAMP '2024-01-04' AS e)
SELECT prog_pos FROM programmes, w WHERE start BETWEEN b AND e OR stop BETWEEN b AND e OR start <= b AND stop >= e""")
def programme_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.expr(f"timestamp_ntz'{d}'")
    return guide.retained(cat._programmes(spark, sf_dir), at("2024-01-03 00:00:00"), at("2024-01-04 00:00:00")).select("prog_pos")


@query("""WITH h AS (SELECT c_nationkey AS guide_id, c_custkey AS pos, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer WHERE contains(lower(c_name), '#0000000'))
SELECT guide_id, name FROM h WHERE i = 1 ORDER BY pos LIMIT 25""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_nationkey as guide_id", "c_custkey as chan_pos", "c_name as name")
    return guide.name_search(rows, "#0000000").select("guide_id", "name")


@query(f"""WITH {cat.STREAMS_SQL}, h AS (SELECT channel_key AS key, bool_or(contains(lower(name), 'ing')) AS named, count(*) AS candidates, arg_min(name, src_pos) AS example, list_sort(list_distinct(list(grp)))[:3] AS groups FROM streams GROUP BY 1),
g AS (SELECT key, candidates, example, groups, key IN (SELECT upper(replace(p_name, ' ', '')) FROM part WHERE p_partkey % 31 = 0) AS in_run FROM h WHERE named OR contains(lower(key), 'ing'))
SELECT *, (SELECT count(*) FROM g) AS total FROM g ORDER BY in_run, candidates DESC, key LIMIT 60""")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pools(spark, sf_dir)
    return search.in_pools(rows, rows.filter("src_pos % 31 = 0"), "ING ")


@query(f"""WITH {cat.STREAMS_SQL}, m AS (SELECT region FROM (SELECT region, count(*) AS n, min(src_pos) AS seen_at FROM streams WHERE region IS NOT NULL AND src_pos % 3 = 0 GROUP BY 1) ORDER BY n DESC, seen_at LIMIT 1)
SELECT src_pos AS id, region, CAST(CASE WHEN region IS NULL THEN 1 WHEN region = (FROM m) THEN 0 ELSE 2 END AS INT) AS nearness, CAST(declared AS INT) AS declared FROM streams WHERE contains(lower(name), 'red') AND src_pos % 10 <> 0 ORDER BY 3, 4 DESC, name, id LIMIT 60""")
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pools(spark, sf_dir).withColumn("declared", titles.declared_rank(F.col("name")))
    return search.free(rows, rows.filter("id % 10 = 0"), rows.filter("src_pos % 3 = 0"), "Red").select("id", "region", "nearness", "declared")


@query(f"""WITH {cat._PROGRAMMES_SQL}, h AS (SELECT *, guide_id % 4 AS source, row_number() OVER (PARTITION BY guide_id % 4 ORDER BY prog_pos) AS i FROM programmes WHERE contains(title, 'i') AND start <= TIMESTAMP '2024-01-05 01:30:00' AND coalesce(stop, start + INTERVAL 3 HOUR) >= TIMESTAMP '2024-01-04 22:30:00')
SELECT source, prog_pos FROM h WHERE i <= 25 ORDER BY start, source, prog_pos LIMIT 25""")
def cross_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._programmes(spark, sf_dir).withColumn("source", F.col("guide_id") % 4)
    return search.across_sources(rows, "I", F.expr("timestamp_ntz'2024-01-05 00:00:00'")).select("source", "prog_pos")


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey + 0.5 AS DOUBLE) END AS number, coalesce(n_name, '') AS "group", CAST(c_custkey % 3 AS INT) AS n_streams FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 2) ON n_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)""")
def unclaimed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 6 != 0, k + F.lit(0.5)).alias("channel_number"), F.col("c_nationkey").alias("channel_group_id"), F.when(k % 3 != 0, F.array_repeat(k, (k % 3).cast("int"))).alias("streams"))
    groups = read(spark, sf_dir, "nation").filter("n_nationkey > 2").selectExpr("n_nationkey as id", "n_name as name")
    return remote.unclaimed(rows, read(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").selectExpr("o_custkey as remote_id"), groups)


@query(f"""WITH {cat._LOG_SQL} SELECT seq, rec_key FROM log WHERE channel_key NOT IN (SELECT user_id FROM events WHERE event_id % 500 = 0) AND stream_id <> 'click'""")
def log_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._log(spark, sf_dir)
    left = log.removed(rows, rows.filter("seq % 500 = 0"), "channel_key")
    return log.removed(left, rows.filter("stream_id = 'click'"), "rec_key").select("seq", "rec_key")


@query(f"""WITH {cat._LOG_SQL} SELECT seq, CASE WHEN channel_key = 8 THEN '46|' || stream_id ELSE rec_key END AS rec_key FROM log""")
def log_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._log(spark, sf_dir).withColumn("channel_key", F.col("channel_key").cast("string"))
    return log.moved(rows, "8", "46").select("seq", "rec_key")


@query(f"""WITH {cat._LOG_SQL} SELECT seq, rec_key FROM log UNION ALL SELECT seq, '9999|' || stream_id FROM log WHERE channel_key = 8""")
def log_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._log(spark, sf_dir).withColumn("channel_key", F.col("channel_key").cast("string"))
    return log.duplicated(rows, "8", "9999").select("seq", "rec_key")


@query("SELECT p_partkey AS src_pos, CASE WHEN p_name = 'red widget' THEN 'ANDDRAMA' ELSE upper(replace(p_name, ' ', '')) END AS key FROM part")
def aliased_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = Titles(aliases={"Red & Widget": "x", "red widget": "ANDDRAMA"})
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src_pos"), reader.key_column(F.concat(F.lit("UKFHD | "), "p_name")).alias("key"))


_ANSWERS_SQL = """idx AS (SELECT r_name AS source, upper(replace(n_name, '_', '')) AS key, 'id' || n_nationkey AS gid, n_name || ' ' || r_name AS gname FROM nation, region WHERE (n_nationkey + r_regionkey) % 3 <> 0),
w AS (SELECT n_nationkey AS row, n_name || ' TV' AS name, upper(replace(n_name, '_', '')) AS key, CASE WHEN n_nationkey % 7 = 0 THEN 'id' || ((n_nationkey + 1) % 25) END AS tvg FROM nation),
near AS (SELECT source, row, count(DISTINCT idx.key) AS c, min(gid) AS gid FROM w JOIN idx ON (starts_with(w.key, idx.key) OR starts_with(idx.key, w.key)) AND length(w.key) >= 6 AND length(idx.key) >= 6 GROUP BY 1, 2),
own AS (SELECT n_nationkey AS row, 'ASIA' AS source, 'id' || ((n_nationkey + 2) % 25) AS gid FROM nation WHERE n_nationkey % 5 = 0),
a AS (SELECT s.r_name AS source, w.row, coalesce(o.gid, k.gid, e.gid, CASE WHEN near.c = 1 THEN near.gid END) AS guide_id FROM w CROSS JOIN region s LEFT JOIN idx k ON k.source = s.r_name AND k.gid = w.tvg LEFT JOIN idx e ON e.source = s.r_name AND e.key = w.key
  LEFT JOIN near ON near.source = s.r_name AND near.row = w.row LEFT JOIN (SELECT own.* FROM own JOIN idx USING (source, gid)) o ON o.source = s.r_name AND o.row = w.row)"""


def _guides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Wanted rows, sources, the index of all sources' guides, and every source's answer for every row."""
    n, r, k = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), F.col("n_nationkey")
    key = F.upper(F.replace("n_name", F.lit("_"), F.lit("")))
    every = n.join(r, (F.col("n_nationkey") + F.col("r_regionkey")) % 3 != 0)
    index = every.select(F.col("r_name").alias("source"), key.alias("key"), F.concat(F.lit("id"), k).alias("guide_id"), F.concat("n_name", F.lit(" "), "r_name").alias("guide_name"))
    wanted = n.select(k.alias("row"), F.concat("n_name", F.lit(" TV")).alias("name"), key.alias("key"), F.when(k % 7 == 0, F.concat(F.lit("id"), (k + 1) % 25)).alias("tvg_id"))
    own = n.filter(k % 5 == 0).select(k.alias("row"), F.lit("ASIA").alias("source"), F.concat(F.lit("id"), (k + 2) % 25).alias("guide_id"))
    sources = r.select(F.col("r_name").alias("source"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey")).alias("priority"))
    return wanted, sources, index, guide.in_all_sources(wanted, sources, index, index.select("source", "guide_id"), own)


@query(f"""WITH {_ANSWERS_SQL}, o AS (SELECT a.row, a.source, guide_id, row_number() OVER (PARTITION BY a.row ORDER BY CASE WHEN a.row % 4 = 0 AND a.source = 'EUROPE' THEN 0 ELSE 1 END, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey END NULLS LAST, a.source) AS i FROM a JOIN region ON r_name = a.source WHERE guide_id IS NOT NULL)
SELECT row, source, guide_id FROM o WHERE i = 1""")
def guide_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, sources, _, answers = _guides(spark, sf_dir)
    picked = wanted.filter("row % 4 = 0").select("row", F.lit("EUROPE").alias("pick"))
    return guide.chosen_guides(answers, sources, picked)


@query(f"""WITH {_ANSWERS_SQL}, {cat._PROGRAMMES_SQL}, p AS (SELECT 'id' || guide_id AS gid, title FROM programmes WHERE start <= TIMESTAMP '2024-01-03' AND (stop IS NULL OR TIMESTAMP '2024-01-03' < stop)), words AS (SELECT a.*, idx.gname, w.name, title FROM a JOIN w USING (row) LEFT JOIN idx ON idx.source = a.source AND idx.gid = a.guide_id LEFT JOIN p ON p.gid = a.guide_id)
SELECT row, source, guide_id IS NOT NULL AS matched, gname AS guide_name, CAST(CASE WHEN guide_id IS NULL THEN 0 ELSE len(list_intersect(list_distinct(regexp_extract_all(upper(name), '[A-Z0-9]+')), list_distinct(regexp_extract_all(upper(gname), '[A-Z0-9]+')))) END AS INT) AS score, title AS now FROM words""")
def source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, _, index, answers = _guides(spark, sf_dir)
    programmes = cat._programmes(spark, sf_dir).withColumn("guide_id", F.concat(F.lit("id"), "guide_id"))
    probes = index.select(F.concat_ws("|", "source", "guide_id").alias("probe"), "source", "guide_id", F.expr("timestamp_ntz'2024-01-03 00:00:00'").alias("at"))
    playing = guide.now_playing(probes, programmes).select("source", "guide_id", "title")
    return guide.checked(answers, index.withColumn("icon", F.lit(None).cast("string")), wanted, playing).drop("icon")


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS number, 'Id' || o_custkey AS tvg_id, 'iD' || (o_custkey + o_orderkey % 3) AS shown_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""")
def guide_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    wanted = o.select(k.cast("double").alias("number"), F.when(k % 5 != 0, F.concat(F.lit("Id"), "o_custkey")).alias("tvg_id"))
    return guide.mismatches(wanted, o.select(k.alias("channel_number"), k.alias("uuid")), o.select(k.alias("uuid"), F.concat(F.lit("iD"), F.col("o_custkey") + k % 3).alias("shown_id")))


_KINDS = ("", " HD", " Lon", " ScotHD", " South East", ".uk")


@query(f"""WITH n AS (SELECT p_partkey AS pos, 'g' || p_partkey AS guide_id, p_name || {sql_pick(("", " HD", " Lon", " ScotHD", " South East", ""), "p_partkey")} AS name, upper(replace(p_name, ' ', '')) AS fam, {sql_pick(("", "", "LON", "SCOTHD", "SOUTHEAST", ""), "p_partkey")} AS tail FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY fam, tail ORDER BY length(name), pos) AS i, min(pos) OVER (PARTITION BY fam, tail) AS seen_at FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY length(name), seen_at) AS j FROM k WHERE i = 1)
SELECT max(CASE WHEN j = 1 THEN guide_id END) AS guide_id, max(CASE WHEN j = 1 THEN name END) AS guide_name, coalesce(list(name ORDER BY j) FILTER (WHERE j > 1), []) AS alts FROM f GROUP BY fam""")
def guide_channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, reader = F.col("p_partkey"), Titles()
    shown = titles.shown_name(F.concat("p_name", pick(_KINDS, k)))
    names = read(spark, sf_dir, "part").select(F.concat(F.lit("g"), k).alias("guide_id"), shown.alias("guide_name"), k.alias("chan_pos"))
    keyed = names.withColumn("key", reader.key_column("guide_name")).withColumn("family", reader.key_column(titles.without_region(F.col("guide_name"))))
    return guide.channel_list(keyed).withColumn("alts", F.transform("alts", lambda x: x["guide_name"]))


@query("SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS channels, count(DISTINCT user_id) AS with_programmes, count(*) AS programmes FROM events")
def guide_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guide.sizes(read(spark, sf_dir, "customer").selectExpr("c_nationkey as guide_id"), read(spark, sf_dir, "events").selectExpr("user_id as guide_id"))


@query("""WITH c AS (SELECT c_custkey AS channel, r_name AS source FROM customer, region WHERE (c_custkey + r_regionkey) % 3 = 0), m AS (SELECT channel, min(source) AS winner, count(*) AS n FROM c GROUP BY 1),
d AS (SELECT source, count(*) FILTER (WHERE source = winner) AS w, count(*) AS s FROM c JOIN m USING (channel) WHERE n >= 2 GROUP BY 1)
SELECT coalesce(source, r_name) AS source, coalesce(r_regionkey, 0) + coalesce(w, 0) AS wins, coalesce(10 * r_regionkey, 0) + coalesce(s, 0) AS seen FROM d FULL JOIN (SELECT * FROM region WHERE r_regionkey <> 1) ON source = r_name""")
def trust_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "region"), (F.col("c_custkey") + F.col("r_regionkey")) % 3 == 0).select(F.col("c_custkey").alias("channel"), F.col("r_name").alias("source"))
    winners = checks.groupBy("channel").agg(F.min("source").alias("winner"))
    trust = read(spark, sf_dir, "region").filter("r_regionkey <> 1").selectExpr("r_name as source", "cast(r_regionkey as long) as wins", "cast(10 * r_regionkey as long) as seen")
    return guide.trust_after(trust, checks, winners)


_CLAIMS_SQL = "claims AS (SELECT user_id AS name, max(event_id) AS pos FROM events WHERE event_id % 7 = 0 GROUP BY 1)"


@query(f"""WITH {_CLAIMS_SQL} SELECT event_id AS id, 'K' || pos AS channel_key, 'r' || pos AS run FROM events JOIN claims ON name = user_id WHERE event_type IN ('error', 'click') AND pos % 2 = 0""")
def event_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "channel_error").when(F.col("event_type") == "click", "channel_reconnect").otherwise("channel_start")
    claims = e.filter(i % 7 == 0).select(F.col("user_id").alias("name"), i.alias("pos"), F.concat(F.lit("K"), i).alias("key"), F.when(i % 2 == 0, F.concat(F.lit("run:r"), i)).otherwise("manual").alias("source"))
    return events.to_channels(e.select(i.alias("id"), F.col("ts").alias("timestamp"), kind.alias("event_type"), F.col("user_id").alias("channel_name")), claims).select("id", "channel_key", "run")


@query("SELECT channel, CAST(sum(failures) AS BIGINT) AS failovers FROM (" + "WITH" + """ e AS (SELECT user_id AS channel, ts, CASE event_type WHEN 'error' THEN 'channel_failover' WHEN 'click' THEN 'channel_start' WHEN 'view' THEN 'stream_switch' ELSE 'other' END AS kind,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 20 END AS stream_id FROM events),
f AS (SELECT a.channel, a.ts, arg_max(struct_pack(s := b.stream_id), b.ts) AS x FROM e a JOIN e b ON a.channel = b.channel AND b.kind IN ('channel_start', 'stream_switch') AND b.ts < a.ts - INTERVAL 1 SECOND WHERE a.kind = 'channel_failover' GROUP BY 1, 2)
SELECT channel, x.s AS stream_id, count(*) AS failures FROM f WHERE x.s IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def failover_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remote.failover_counts(cat.failed_attribution(spark, sf_dir))


@query("""WITH f AS (SELECT user_id AS channel, event_id % 20 AS stream_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2),
u AS (SELECT range AS stream_id, CASE WHEN range % 4 = 0 THEN '' ELSE 'http://h/' || range % 7 END AS url FROM range(20)),
o AS (SELECT c_custkey AS key, url, max(struct_pack(s := stream_id, n := failures)).n AS n FROM customer JOIN f ON channel = c_custkey % 200 JOIN u USING (stream_id) WHERE url <> '' GROUP BY 1, 2)
SELECT key, list(url ORDER BY url) AS urls, list(n ORDER BY url) AS n FROM o GROUP BY 1""")
def dropped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = read(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("channel"), (F.col("event_id") % 20).alias("stream_id")).agg(F.count("*").alias("failures"))
    urls = spark.range(20).select(F.col("id").alias("stream_id"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("http://h/"), F.col("id") % 7)).alias("url"))
    wanted = read(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_custkey % 200 as remote_name")
    return remote.failed_urls(wanted, failures, urls).select("key", F.map_keys("urls").alias("urls"), F.map_values("urls").alias("n"))


@query(f"""WITH {cat.STREAMS_SQL}, c AS (SELECT channel_key AS key, count(*) AS n FROM streams GROUP BY 1), w AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS key FROM part WHERE p_partkey % 61 = 0), r AS (SELECT key FROM w UNION SELECT key || 'X' FROM w)
SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS number, k AS key, coalesce(n, 0) AS candidates, k IN (FROM r) AS in_run FROM (SELECT *, upper(replace(p_name, ' ', '')) || CASE WHEN p_partkey % 5 = 0 THEN 'X' ELSE '' END AS k FROM part) LEFT JOIN c ON c.key = k""")
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    channels = p.select(k.alias("id"), F.concat(F.lit("UK: "), "p_name", F.when(k % 5 == 0, " X").otherwise("")).alias("name"), F.when(k % 9 != 0, F.col("p_size")).alias("number"))
    wanted = p.filter(k % 61 == 0).select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("key")).distinct()
    aliases = wanted.select(F.col("key").alias("alias"), F.concat("key", F.lit("X")).alias("means"))
    return remote.read_back(channels, _pools(spark, sf_dir), wanted, aliases, Titles()).select("id", "number", "key", "candidates", "in_run")


@query(f"""WITH {cat.STREAMS_SQL}, b AS (SELECT channel_key, CAST(src_pos AS VARCHAR) AS stream_id, 'u' || src_pos AS url, false AS is_current FROM (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY declared DESC, src_pos) AS i FROM streams) WHERE i <= 4),
l AS (SELECT channel_key, CAST(src_pos AS VARCHAR) AS stream_id, 'u' || src_pos AS url FROM streams WHERE src_pos % 3 = 0), c AS (SELECT channel_key, max(src_pos) AS s FROM streams GROUP BY 1),
t AS (SELECT * FROM b UNION ALL SELECT channel_key, 'remote:' || s, 'u' || s, true FROM c WHERE s % 5 <> 0 AND (channel_key, 'u' || s) NOT IN (SELECT channel_key, url FROM b) AND 'u' || s NOT IN (SELECT url FROM l))
SELECT t.* FROM t WHERE (channel_key, stream_id) NOT IN (SELECT channel_key, stream_id FROM l)""")
def probe_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pools(spark, sf_dir).withColumn("url", F.concat(F.lit("u"), "src_pos"))
    last = rows.groupBy("channel_key").agg(F.max("src_pos").alias("s")).select("channel_key", F.col("s").alias("stream_id"), F.when(F.col("s") % 5 != 0, F.concat(F.lit("u"), "s")).alias("url"))
    done = rows.filter("src_pos % 3 = 0").select("channel_key", F.col("id").alias("stream_id"), "url")
    return remote.probe_seeds(rows, last, done, 4)


@query("""SELECT c_custkey AS key, o_orderkey AS guide_data_id FROM customer JOIN region ON r_name = CASE c_custkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' END JOIN orders ON o_orderkey % 5 = r_regionkey AND o_custkey = c_custkey""")
def guide_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "ASIA").when(F.col("c_custkey") % 3 == 1, "EUROPE").alias("pick"), F.concat(F.lit("g"), "c_custkey").alias("guide_id"))
    guides = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("source_id"), F.concat(F.lit("g"), "o_custkey").alias("tvg_id"))
    return remote.guide_overrides(chosen, read(spark, sf_dir, "region").selectExpr("r_regionkey as id", "r_name as name"), guides)


@query(f"""WITH RECURSIVE {cat._BITS_SQL}, s AS (SELECT * FROM bits WHERE pos % 5 <> 0), e AS (SELECT a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.pos <> b.pos AND hamming(a.b, b.b) <= {frames.NEAR}),
reach AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node), g AS (SELECT node AS pos, min(root) AS component FROM reach GROUP BY 1),
n AS (SELECT pos, label, component, dense_rank() OVER (ORDER BY component) AS grp FROM g JOIN bits USING (pos)), c AS (SELECT component, count(DISTINCT label) > 1 AS p FROM n GROUP BY 1)
SELECT bits.pos, grp AS placeholder_group, coalesce(p, false) AS placeholder, CASE WHEN bits.pos % 3 = 0 THEN 'dirty' WHEN coalesce(p, false) THEN 'placeholder' ELSE 'ok' END AS status FROM bits LEFT JOIN n USING (pos) LEFT JOIN c USING (component)""")
def placeholder_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat._hashes(spark, sf_dir).withColumn("low_motion", F.col("pos") % 5 != 0).withColumn("frame", F.lit(None).cast("array<int>")).withColumn("status", F.when(F.col("pos") % 3 == 0, "dirty").otherwise("ok"))
    return frames.placeholders(rows, frames.still_groups(rows)).select("pos", "placeholder_group", "placeholder", "status")
