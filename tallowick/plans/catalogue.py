"""Registered queries of the catalogue operators, with the same results in DuckDB SQL.

The driver's tables hold no catalogues, so every query first derives one from them;
its SQL does the same.  ``query`` registers a function and its SQL under its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.functions import media, titles
from tallowick.functions.titles import Titles
from tallowick.operators import curate, events, export, frames, guide, log, match, pools, rank
from tallowick.plans.registry import pick, query, read, sql_pick

FLAGSHIP = "top_k_declared"

PREFIXES = ("UK: ", "UKFHD | ", "US: ", "", "DE - ", "FR/")
REGIONS = ("UK", "UK", "US", None, "DE", "FR")
SUFFIXES = (" HD", "", " 4K", " FHD", " [Multi-Audio]")
RANKS = (40, 0, 90, 60, 0)


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue: part names with region in front and quality behind, by the part's key."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(pick(PREFIXES, k), "p_name", pick(SUFFIXES, F.floor(k / 7)))
    return part.select(k.alias("src_pos"), k.alias("id"), name.alias("name"), F.col("p_type").alias("group"), "p_name")


STREAMS_SQL = f"""
streams AS (
    SELECT p_partkey AS src_pos, {sql_pick(PREFIXES, "p_partkey")} || p_name || {sql_pick(SUFFIXES, "p_partkey // 7")} AS name, p_type AS grp,
           upper(replace(p_name, ' ', '')) AS channel_key, {sql_pick(REGIONS, "p_partkey")} AS region, {sql_pick(tuple(map(str, RANKS)), "p_partkey // 7").replace("'", "")} AS declared
    FROM part)
"""


@query(f"WITH {STREAMS_SQL} SELECT src_pos, channel_key, region FROM streams")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidates(streams(spark, sf_dir), Titles()).select("src_pos", "channel_key", "region")


@query(f"WITH {STREAMS_SQL} SELECT src_pos, channel_key FROM streams WHERE region = 'US' OR region IS NULL")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidates(streams(spark, sf_dir), Titles(), ["USA"]).select("src_pos", "channel_key")


@query(f"WITH {STREAMS_SQL} SELECT src_pos, channel_key FROM streams WHERE region = 'US'")
def region_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.candidates(streams(spark, sf_dir), Titles(), ["USA"], include_unmarked=False).select("src_pos", "channel_key")


@query(f"WITH {STREAMS_SQL} SELECT src_pos, declared FROM streams")
def declared_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).select("src_pos", titles.declared_rank(F.col("name")).alias("declared"))


@query(f"""WITH {STREAMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY declared DESC, src_pos) AS place FROM streams WHERE region = 'UK' OR region IS NULL)
SELECT channel_key, src_pos, declared, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
def top_k_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pools.candidates(streams(spark, sf_dir), Titles(), ["UK"])
    return pools.by_declared_quality(found, 3).select("channel_key", "src_pos", "declared", "place")


@query(f"""WITH {STREAMS_SQL}, g AS (SELECT channel_key, grp, count(*) AS n, min(src_pos) AS seen FROM streams GROUP BY 1, 2),
m AS (SELECT channel_key, arg_max(grp, n * 1000000000 - seen) AS modal_group FROM g GROUP BY 1),
d AS (SELECT channel_key, name, row_number() OVER (PARTITION BY channel_key ORDER BY length(name), name) AS i FROM (SELECT DISTINCT channel_key, name FROM streams))
SELECT s.channel_key, min(d.name) AS display, count(*) AS n_streams, min(modal_group) AS modal_group
FROM streams s JOIN m USING (channel_key) JOIN d ON d.channel_key = s.channel_key AND d.i = 1 GROUP BY 1""")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.summary(pools.candidates(streams(spark, sf_dir), Titles())).select("channel_key", "display", "n_streams", "modal_group")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers' names and of every third part: some have a pool."""
    names = read(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("key"))
    return names.union(read(spark, sf_dir, "nation").select(F.upper("n_name"))).distinct()


_WANTED_SQL = "wanted AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS key FROM part WHERE p_partkey % 3 = 0 UNION SELECT upper(n_name) FROM nation)"


@query(f"WITH {STREAMS_SQL}, {_WANTED_SQL} SELECT key, k AS pool_key FROM wanted LEFT JOIN (SELECT DISTINCT channel_key AS k FROM streams) ON key = k")
def wanted_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = pools.candidates(streams(spark, sf_dir), Titles()).select(F.col("channel_key").alias("key"))
    return match.exact(_wanted(spark, sf_dir), keys)


@query("""WITH pools AS (SELECT upper(replace(p_name, ' ', '')) AS key, min(p_partkey) AS pos FROM part GROUP BY 1),
wanted AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN k[:length(k) - 2] WHEN 1 THEN k || 'XY' ELSE k[3:] END AS want FROM (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS k FROM part)),
w AS (SELECT want FROM wanted WHERE length(want) >= 5),
ends AS (SELECT want, key, pos FROM w JOIN pools ON ends_with(key, want) AND key <> want AND length(key) >= 5),
stages AS (
  SELECT want, key, pos, 0 AS stage FROM w JOIN pools ON key = CASE WHEN starts_with(want, 'UAND') THEN want[5:] ELSE 'UAND' || want END
  UNION ALL SELECT want, key, pos, 1 FROM w JOIN pools ON starts_with(key, want) AND key <> want
  UNION ALL SELECT want, key, pos, 2 FROM w JOIN pools ON starts_with(want, key) AND key <> want AND length(key) >= 5 AND length(want) - length(key) <= 3
  UNION ALL SELECT want, key, pos, 3 FROM ends WHERE want IN (SELECT want FROM ends GROUP BY want HAVING count(*) = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY stage, length(key), pos) AS i FROM stages)
SELECT want AS key, key AS pool_key, CAST(stage AS INT) AS stage FROM r WHERE i = 1""")
def wanted_affix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    part = read(spark, sf_dir, "part").select("p_partkey", k.alias("key"))
    n = F.col("p_partkey") % 3
    want = F.when(n == 0, F.substr("key", F.lit(1), F.length("key") - 2)).when(n == 1, F.concat("key", F.lit("XY"))).otherwise(F.substr("key", F.lit(3)))
    return match.by_affix(part.select(want.alias("key")), part.groupBy("key").agg(F.min("p_partkey").alias("pos")))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN CAST(n_nationkey AS INT) ELSE CAST(c_nationkey AS INT) END AS number,
CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_mktsegment END AS "group", (c_custkey % 4 = 0 AND n_nationkey IS NOT NULL) OR (c_custkey % 3 = 0 AND n_name IS NOT NULL) AS filled
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey""")
def fill_only_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    wanted = c.select(F.col("c_nationkey").alias("nation"), k.alias("key"), F.when(k % 4 == 0, None).otherwise(F.col("c_nationkey")).cast("int").alias("number"), F.when(k % 3 == 0, None).otherwise(F.col("c_mktsegment")).alias("group"))
    ref = read(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("nation"), F.col("n_nationkey").cast("int").alias("number"), F.col("n_name").alias("group"))
    return match.fill_blanks(wanted, ref, key="nation").select("key", "number", "group", "filled")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of probes: a stream for each user and kind of event."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "dead").when(F.col("event_id") % 5 == 0, "dirty").otherwise("ok")
    return e.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("rec_key"), F.col("user_id").alias("channel_key"), F.col("event_type").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("probed_at"), status.alias("status"), F.floor(F.col("value")).cast("int").alias("height"), (F.col("event_id") % 3 * 25).cast("int").alias("fps"))


_LOG_SQL = """log AS (SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS rec_key, user_id AS channel_key, event_type AS stream_id, event_id AS seq,
CASE WHEN event_type = 'error' THEN 'dead' WHEN event_id % 5 = 0 THEN 'dirty' ELSE 'ok' END AS status, CAST(floor(value) AS INT) AS height, CAST(event_id % 3 * 25 AS INT) AS fps FROM events)"""


@query(f"WITH {_LOG_SQL}, r AS (SELECT *, min(seq) OVER (PARTITION BY rec_key) AS first_seq, row_number() OVER (PARTITION BY rec_key ORDER BY seq DESC) AS i FROM log) SELECT rec_key, seq, status, height, first_seq FROM r WHERE i = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.latest(_log(spark, sf_dir), "rec_key", "seq").select("rec_key", "seq", "status", "height", "first_seq")


@query(f"WITH {_LOG_SQL} SELECT DISTINCT rec_key FROM log WHERE seq % 2 = 0 AND rec_key NOT IN (SELECT rec_key FROM log WHERE seq % 37 = 0)")
def done_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return log.remaining(rows.filter("seq % 2 = 0").select("rec_key").distinct(), rows.filter("seq % 37 = 0"), "rec_key")


@query(f"""WITH {_LOG_SQL}, r AS (SELECT *, lag(status) OVER w AS old_status, lag(height) OVER w AS old_height, lag(fps) OVER w AS old_fps, lag(seq) OVER w AS old_seq, row_number() OVER (PARTITION BY rec_key ORDER BY seq DESC) AS i FROM log WINDOW w AS (PARTITION BY rec_key ORDER BY seq))
SELECT rec_key, seq, (old_status IN ('ok', 'dirty') AND status NOT IN ('ok', 'dirty')) OR height < old_height OR fps < old_fps AS negative,
CAST((status <> old_status) AS INT) + CAST((height <> old_height) AS INT) + CAST((fps <> old_fps) AS INT) AS n_messages
FROM r WHERE i = 1 AND old_seq IS NOT NULL AND (status <> old_status OR height <> old_height OR fps <> old_fps)""")
def changes_last_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.changes(_log(spark, sf_dir)).select("rec_key", "seq", "negative", F.size("messages").alias("n_messages"))


@query(f"WITH {_LOG_SQL} SELECT rec_key, seq, true AS carried_forward FROM log WHERE seq % 2 = 0 AND seq >= 2000 AND status <> 'dead' AND (channel_key, stream_id) IN (SELECT channel_key, stream_id FROM log WHERE seq % 2 = 1 AND seq % 11 = 0)")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return log.carried(rows.filter("seq % 2 = 1 and seq % 11 = 0"), rows.filter("seq % 2 = 0"), ["channel_key", "stream_id"], 2000.0).select("rec_key", "seq", "carried_forward")


_RECORD_COLUMNS = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _records(spark: SparkSession, sf_dir: str, by: str = "l_partkey") -> DataFrame:
    """Line items as candidates of their part; identical rows are one candidate.

    They are dealt out by ``by``, the column they are ranked or joined by next, so that
    neither this nor finding identical rows needs a shuffle of its own.
    """
    rows = read(spark, sf_dir, "lineitem").select(*_RECORD_COLUMNS).repartition(by).distinct()
    q = F.col("l_quantity").cast("int")
    status = F.when(F.col("l_returnflag") == "R", "dead").when(F.col("l_returnflag") == "A", "dirty").otherwise("ok")
    return rows.select(*_RECORD_COLUMNS, F.col("l_partkey").alias("channel_key"), status.alias("status"), (q * 16).alias("width"), (q * 9).alias("height"), F.round("l_extendedprice").cast("long").alias("measured_kbps"), (F.col("l_linenumber") * 25).alias("fps"), F.when(F.col("l_linestatus") == "F", "hevc").otherwise("h264").alias("video_codec"))


_TIE = ", ".join(_RECORD_COLUMNS)
_RECORDS_SQL = f"""records AS (SELECT *, l_partkey AS channel_key, CASE l_returnflag WHEN 'R' THEN 5 ELSE 0 END AS sr, CAST(l_quantity AS INT) * 16 * CAST(l_quantity AS INT) * 9 AS area,
CAST(round(l_extendedprice) AS BIGINT) AS kbps, l_linenumber * 25 AS fps, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS codec FROM (SELECT DISTINCT {_TIE} FROM lineitem))"""


@query(f"""WITH {_RECORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY sr, area DESC, kbps DESC, fps DESC, codec, {_TIE}) AS rank FROM records)
SELECT channel_key, l_orderkey, l_linenumber, l_suppkey, kbps AS measured_kbps, CAST(rank AS INT) AS rank FROM r""")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.ranked(_records(spark, sf_dir), tie=tuple(_RECORD_COLUMNS)).select("channel_key", "l_orderkey", "l_linenumber", "l_suppkey", "measured_kbps", "rank")


@query(f"""WITH {_RECORDS_SQL}, i AS (SELECT channel_key, CAST(median_kbps AS DOUBLE) AS inc FROM (SELECT channel_key, min(kbps) AS median_kbps FROM records WHERE sr = 0 GROUP BY 1)),
s AS (SELECT records.*, CASE WHEN kbps <> 0 AND coalesce(inc, 0) <> 0 AND abs(kbps - inc) <= 0.15 * inc THEN inc ELSE kbps END AS snap FROM records LEFT JOIN i USING (channel_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY sr, area DESC, snap DESC, fps DESC, codec, {_TIE}) AS rank FROM s)
SELECT channel_key, l_orderkey, l_linenumber, l_suppkey, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4 AND sr = 0""")
def rank_incumbent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    incumbent = rows.filter("status <> 'dead'").groupBy("channel_key").agg(F.min("measured_kbps").cast("double").alias("incumbent_kbps"))
    found = rank.ranked(rows.join(incumbent, "channel_key", "left"), tie=tuple(_RECORD_COLUMNS))
    return rank.picks(found, 4).filter("rank <= 4").select("channel_key", "l_orderkey", "l_linenumber", "l_suppkey", "rank")


@query(f"""WITH {_RECORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY sr, area DESC, kbps DESC, fps DESC, codec, {_TIE}) AS rank FROM records)
SELECT channel_key, max(CASE WHEN rank = 1 THEN l_suppkey END) AS best, count(*) FILTER (WHERE l_returnflag = 'N') AS n_ok FROM r GROUP BY 1""")
def explain_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.ranked(_records(spark, sf_dir), tie=tuple(_RECORD_COLUMNS)).withColumn("name", F.col("l_suppkey").cast("string"))
    told = rank.explained(found.withColumn("width", F.col("width").cast("int")))
    return told.select("channel_key", F.substring_index("choice", ":", 1).cast("long").alias("best"), "n_ok")


@query("""WITH f AS (SELECT event_id, CASE WHEN value < 12 THEN 25.0 WHEN value < 13 THEN 29.97 WHEN value < 14 THEN 23.98 ELSE 50.0 END AS fps FROM events),
c AS (SELECT count(*) FILTER (WHERE fps IN (25.0, 50.0)) AS pal, count(*) FILTER (WHERE fps = 29.97) AS ntsc FROM f)
SELECT event_id, fps = 29.97 AS off_cadence FROM f, c WHERE pal + ntsc >= 20 AND pal / (pal + ntsc) >= 0.8""")
def cadence_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(v < 12, 25.0).when(v < 13, 29.97).when(v < 14, 23.98).otherwise(50.0).alias("fps"))
    return rank.off_cadence(rows).select("event_id", "off_cadence").filter("off_cadence is not null")


def _programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.selectExpr("user_id as guide_id", "ts as start", "lead(ts) over (partition by user_id order by ts) as stop", "event_type as title", "event_id as prog_pos")


_PROGRAMMES_SQL = "programmes AS (SELECT user_id AS guide_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS stop, event_type AS title, event_id AS prog_pos FROM events)"


@query(f"""WITH {_PROGRAMMES_SQL}, probes AS (SELECT o_orderkey AS probe, o_custkey % 150 AS guide_id, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 700 AS INT)) AS t FROM orders),
hits AS (SELECT probe, title, prog_pos, row_number() OVER (PARTITION BY probe ORDER BY start, prog_pos) AS i FROM probes JOIN programmes USING (guide_id) WHERE t >= start AND (stop IS NULL OR t < stop))
SELECT probes.probe, hits.title, hits.prog_pos FROM probes LEFT JOIN hits ON probes.probe = hits.probe AND i = 1""")
def asof_now_playing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(o_orderkey % 700 as int))")
    probes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe"), (F.col("o_custkey") % 150).alias("guide_id"), at.alias("at"))
    return guide.now_playing(probes, _programmes(spark, sf_dir)).select("probe", "title", "prog_pos")


@query(f"""WITH {_PROGRAMMES_SQL} SELECT prog_pos, guide_id FROM programmes WHERE contains(title, 'purch') AND start <= TIMESTAMP '2024-01-05 01:30:00' AND coalesce(stop, start + INTERVAL 3 HOUR) >= TIMESTAMP '2024-01-04 22:30:00' ORDER BY prog_pos LIMIT 25""")
def overlap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guide.title_search(_programmes(spark, sf_dir), "PURCH", F.expr("timestamp_ntz'2024-01-05 00:00:00'")).select("prog_pos", "guide_id")


@query("""WITH n AS (SELECT c_custkey AS id, upper(replace(replace(c_name, '#', ''), ' ', '')) AS key FROM customer WHERE c_custkey % 2 = 0),
w AS (SELECT c_custkey AS row, upper(replace(replace(c_name, '#', ''), ' ', '')) || CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE '' END AS key FROM customer),
near AS (SELECT row, count(DISTINCT n.key) AS c, min(n.id) AS id FROM w JOIN n ON left(n.key, 6) = left(w.key, 6) AND (starts_with(w.key, n.key) OR starts_with(n.key, w.key)) WHERE w.key NOT IN (SELECT key FROM n) GROUP BY 1)
SELECT w.row, coalesce(n.id, CASE WHEN near.c = 1 THEN near.id END) AS guide_id, CASE WHEN n.id IS NOT NULL THEN 'key' WHEN near.c = 1 THEN 'prefix' END AS stage
FROM w LEFT JOIN n ON w.key = n.key LEFT JOIN near ON near.row = w.row""")
def prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.upper(F.regexp_replace("c_name", "[# ]", ""))
    c = read(spark, sf_dir, "customer")
    index = c.filter("c_custkey % 2 = 0").select(key.alias("key"), F.col("c_custkey").alias("guide_id"))
    wanted = c.select(F.col("c_custkey").alias("row"), F.concat(key, F.when(F.col("c_custkey") % 3 == 0, "X").otherwise("")).alias("key"), F.lit(None).cast("long").alias("tvg_id"))
    return guide.resolve(wanted, index, index.select("guide_id").limit(0)).select("row", "guide_id", "stage")


@query("""WITH n AS (SELECT n_nationkey * 2 AS guide_id, n_name AS name FROM nation UNION ALL SELECT n_nationkey * 2 + 1, n_name || CASE n_nationkey % 3 WHEN 0 THEN ' HD' WHEN 1 THEN ' Sport' ELSE '' END FROM nation)
SELECT upper(replace(n_name, '_', '')) AS key, CAST(n_nationkey * 2 + CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS guide_id FROM nation WHERE n_nationkey % 3 <> 2
UNION ALL SELECT upper(replace(n_name, '_', '')) || 'SPORT', CAST(n_nationkey * 2 + 1 AS BIGINT) FROM nation WHERE n_nationkey % 3 = 1""")
def sd_hd_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    other = F.concat("n_name", F.when(k % 3 == 0, " HD").when(k % 3 == 1, " Sport").otherwise(""))
    names = n.select((k * 2).alias("guide_id"), F.col("n_name").alias("name")).union(n.select(k * 2 + 1, other))
    reader = Titles()
    return guide.name_index(names.withColumn("chan_pos", F.col("guide_id")).withColumn("key", reader.key_column("name")).withColumn("identity", reader.identity_column("name")))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of twelve dimensions over and over, so that some hashes are near each other."""
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get("embedding", i % 12) > 0, "1").otherwise("0")), "")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), media.hex_of_bits(bits).alias("hash"), F.col("label").alias("channel_key"))


_BITS_SQL = "bits AS (SELECT vec_id AS pos, label, list_aggregate(list_transform(range(64), lambda i: CASE WHEN embedding[i % 12 + 1] > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS b FROM embeddings)"
_NEAR = frames.NEAR


@query(f"WITH {_BITS_SQL}, c AS (SELECT b, min(pos) AS pos, count(*) AS copies FROM bits GROUP BY b) SELECT a.pos AS a, b.pos AS b, CAST(hamming(a.b, b.b) AS INT) AS distance, a.copies AS copies_a, b.copies AS copies_b FROM c a JOIN c b ON a.pos < b.pos WHERE hamming(a.b, b.b) <= {_NEAR}")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between the first rows of different hashes, and how many rows have each hash."""
    hashes = _hashes(spark, sf_dir)
    pairs = frames.similar_pairs(hashes, _NEAR).filter("distance > 0").select("a", "b", F.col("distance").cast("int").alias("distance"))
    copies = hashes.groupBy("hash").agg(F.min("pos").alias("pos"), F.count("*").alias("copies"))
    one = lambda x: copies.select(F.col("pos").alias(x), F.col("copies").alias(f"copies_{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b")


@query(f"""WITH RECURSIVE {_BITS_SQL}, e AS (SELECT a.pos AS a, b.pos AS b FROM bits a JOIN bits b ON a.pos <> b.pos AND hamming(a.b, b.b) <= {_NEAR}),
reach AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node)
SELECT node AS pos, min(root) AS component FROM reach GROUP BY 1""")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallowick.operators.components import connected_components

    return connected_components(frames.similar_pairs(_hashes(spark, sf_dir), _NEAR)).select(F.col("node").alias("pos"), "component")


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT)) AS f FROM embeddings)
SELECT a.vec_id AS pos, round(coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(a.f[i] - b.f[i]))) / 64.0, 255.0), 6) AS mad FROM q a LEFT JOIN q b ON b.vec_id = a.vec_id + 1""")
def frame_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("long")).alias("f"))
    other = q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("f").alias("g"))
    return q.join(other, "vec_id", "left").select(F.col("vec_id").alias("pos"), F.round(media.mean_difference(F.col("f"), F.col("g")), 6).alias("mad"))


@query("""WITH e AS (SELECT user_id AS channel, ts, CASE event_type WHEN 'error' THEN 'channel_failover' WHEN 'click' THEN 'channel_start' WHEN 'view' THEN 'stream_switch' ELSE 'other' END AS kind,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 20 END AS stream_id FROM events),
f AS (SELECT a.channel, a.ts, arg_max(struct_pack(s := b.stream_id), b.ts) AS x FROM e a JOIN e b ON a.channel = b.channel AND b.kind IN ('channel_start', 'stream_switch') AND b.ts < a.ts - INTERVAL 1 SECOND WHERE a.kind = 'channel_failover' GROUP BY 1, 2)
SELECT channel, x.s AS stream_id, count(*) AS failures FROM f WHERE x.s IS NOT NULL GROUP BY 1, 2""")
def failed_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "error", "channel_failover").when(t == "click", "channel_start").when(t == "view", "stream_switch").otherwise("other")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "ts", kind.alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 20).alias("stream_id"))
    return events.failures(rows)


@query("""WITH e AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS recent FROM events) SELECT event_id, recent FROM e WHERE recent >= 3""")
def rate_trip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.burst_candidates(read(spark, sf_dir, "events"), "event_type", seconds=1800).select("event_id", "recent")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 12")
def pending_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.over_threshold(read(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", 12)


@query("""WITH w AS (SELECT o_orderkey AS key, o_orderkey AS number, o_orderpriority AS name, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS grp, [o_custkey] AS s FROM orders),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'other' ELSE lower(o_orderpriority) END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS grp, [o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END] AS s FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT w.*, r.id, r.name AS tn, r.grp AS tg, r.s AS ts, r.id IS NOT NULL AND r.id % 3 <> 0 AS claimed FROM w LEFT JOIN r ON w.number = r.id)
SELECT key, CASE WHEN id IS NULL THEN 'create' WHEN NOT claimed THEN CASE WHEN lower(name) = lower(tn) OR s[1] = ts[1] THEN 'relink' ELSE 'blocked' END
WHEN name <> tn OR (grp IS NOT NULL AND grp <> tg) OR s <> ts THEN 'update' ELSE 'unchanged' END AS action FROM j""")
def export_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    wanted = o.select(k.alias("key"), k.alias("number"), F.col("o_orderpriority").alias("name"), F.when(k % 9 != 0, F.col("o_orderstatus")).alias("group"), F.array("o_custkey").alias("streams"))
    remote = o.filter(k % 7 != 0).select(k.alias("id"), k.alias("channel_number"), F.when(k % 6 == 0, "other").otherwise(F.lower("o_orderpriority")).alias("name"), F.when(k % 4 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("group"), F.array(F.col("o_custkey") + F.when(k % 10 == 0, 1).otherwise(0)).alias("streams"))
    claims = remote.filter("id % 3 <> 0").select(F.col("id").alias("remote_id"))
    return export.difference(wanted, remote, claims, ("name", "group")).select("key", "action")


@query("""WITH s AS (SELECT page_id AS id, page_id AS pos, split_part(url, '/', 3) AS url, page_id % 3 = 0 AS is_custom FROM pages)
SELECT url, id, is_custom FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY is_custom, pos DESC) AS i FROM s) WHERE i = 1""")
def native_beats_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("pos"), F.get(F.split("url", "/"), F.lit(2)).alias("url"), (F.col("page_id") % 3 == 0).alias("is_custom"))
    return export.stream_by_url(rows)


@query("""SELECT o_orderkey AS key, CAST(o_orderkey AS DOUBLE) AS number, o_orderpriority AS name FROM orders
UNION ALL SELECT o_orderkey, o_orderkey + 0.5, 'FALLBACK: ' || o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""")
def fallback_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("key"), k.alias("number"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("tvg_id"), F.col("o_custkey").alias("primary"), F.when(k % 2 == 0, F.col("o_custkey") + 1).alias("fallback_stream"))
    return export.expanded(rows, separate=True).select("key", "number", "name")


_RANKED_SQL = f"{_RECORDS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY channel_key ORDER BY sr, area DESC, kbps DESC, fps DESC, codec, {_TIE}) AS rank FROM records)"


@query(f"""WITH {_RANKED_SQL}, best AS (SELECT channel_key, list(l_suppkey ORDER BY rank)[:4] AS best FROM ranked WHERE sr = 0 GROUP BY 1), c AS (SELECT channel_key, count(*) AS n FROM records GROUP BY 1),
s AS (SELECT p_partkey AS channel_key, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS number, CASE p_partkey % 4 WHEN 1 THEN [CAST(7 AS BIGINT), 8] WHEN 2 THEN [CAST(9 AS BIGINT)] END AS own FROM part WHERE p_partkey % 5 <> 0)
SELECT channel_key, len(coalesce(own, best)) AS n_streams, coalesce(own, best)[1] AS first_stream,
CASE WHEN coalesce(n, 0) = 0 THEN 'no candidates' WHEN coalesce(own, best) IS NULL THEN 'none playable' WHEN number IS NULL THEN 'no number' END AS dropped
FROM s LEFT JOIN best USING (channel_key) LEFT JOIN c USING (channel_key)""")
def resolve_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    channels = part.select(k.alias("channel_key"), F.when(k % 13 != 0, F.col("p_size")).alias("number"))
    none = F.lit(None).cast("long")
    selection = part.select(k.alias("channel_key"), F.when(k % 4 == 1, F.array(F.lit(7).cast("long"), F.lit(8).cast("long"))).otherwise(F.array().cast("array<long>")).alias("streams"), F.when(k % 4 == 2, F.lit(9).cast("long")).otherwise(none).alias("primary"), none.alias("fallback"), (k % 5 != 0).alias("include"))
    found = rank.ranked(_records(spark, sf_dir), tie=tuple(_RECORD_COLUMNS)).withColumn("stream_id", F.col("l_suppkey"))
    out = curate.resolved(channels, selection, found)
    return out.select("channel_key", F.when(F.size("streams") >= 0, F.size("streams")).cast("long").alias("n_streams"), F.get("streams", F.lit(0)).alias("first_stream"), "dropped")


@query("""SELECT 'kbps' AS dimension, count(*) FILTER (WHERE l_extendedprice > l_suppkey * 500.0) AS better, count(*) FILTER (WHERE l_extendedprice < l_suppkey * 500.0) AS worse, count(*) FILTER (WHERE l_extendedprice = l_suppkey * 500.0) AS same FROM lineitem
UNION ALL SELECT 'fps', count(*) FILTER (WHERE l_linenumber > 4), count(*) FILTER (WHERE l_linenumber < 4), count(*) FILTER (WHERE l_linenumber = 4) FROM lineitem""")
def override_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("curator_kbps"), (F.col("l_suppkey") * 500.0).alias("algorithm_kbps"), F.col("l_linenumber").alias("curator_fps"), F.lit(4).alias("algorithm_fps"))
    return curate.override_analysis(rows, ("kbps", "fps"))


@query("""WITH k AS (SELECT n_name AS channel, r_name AS source, len(list_intersect(list_distinct(string_split(upper(n_name), ' ')), list_distinct(string_split(upper(n_name || ' ' || CASE WHEN n_nationkey % 2 = r_regionkey % 2 THEN '' ELSE 'X' END), ' ')))) + (n_nationkey + r_regionkey) % 3 AS score, r_regionkey FROM nation, region),
t AS (SELECT *, (r_regionkey + 1) / 7.0 AS trust FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, trust DESC, source) AS i, count(*) FILTER (WHERE score >= 1) OVER (PARTITION BY channel) AS agree FROM t)
SELECT channel, source AS winner, agree >= 2 AS consensus FROM r WHERE i = 1""")
def consensus_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    n = read(spark, sf_dir, "nation")
    rows = n.join(r, F.lit(True))  # the sources, five, against all channels
    other = F.concat("n_name", F.lit(" "), F.when(F.col("n_nationkey") % 2 == F.col("r_regionkey") % 2, "").otherwise("X"))
    checks = rows.select(F.col("n_name").alias("channel"), F.col("r_name").alias("source"), (titles.word_overlap(F.col("n_name"), other) + (F.col("n_nationkey") + F.col("r_regionkey")) % 3).alias("score"))
    trust = r.select(F.col("r_name").alias("source"), (F.col("r_regionkey") + 1).alias("wins"), F.lit(7).alias("seen"))
    return guide.consensus(checks, trust)


@query("""SELECT page_id, regexp_replace(url, '^(https?://[^/]+)/.*$', '\\1') || '/***/***/' || page_id || '.ts?username=***&page=2&token=***' AS url FROM pages""")
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/joe/s3cret/"), F.col("page_id"), F.lit(".ts?username=joe&page=2&token=abc"))
    return read(spark, sf_dir, "pages").select("page_id", titles.redacted(secret).alias("url"))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS line_no, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN NULL ELSE role END AS grp FROM conversations),
f AS (SELECT *, min(line_no) OVER (PARTITION BY grp) AS first FROM c)
SELECT line_no, CAST(row_number() OVER (ORDER BY grp IS NULL, first, line_no) AS INT) AS place FROM f""")
def group_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), None).otherwise(F.col("role")).alias("group"))
    return export.contiguous(rows).select("line_no", F.col("place").cast("int").alias("place"))


@query("""WITH a AS (SELECT o_custkey % 50 AS scope, o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice, o_orderkey) AS i, o_orderkey AS key FROM orders),
b AS (SELECT o_custkey % 50 AS scope, o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders)
SELECT a.key, b.number FROM a JOIN b ON a.scope = b.scope AND a.i = b.i""")
def renumber_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 50).alias("scope"), F.col("o_orderkey").alias("number"), F.struct("o_totalprice", "o_orderkey").alias("order"))
    return export.dealt_numbers(rows, "scope", "order").select("key", "number")


@query("""SELECT DISTINCT CAST(c_nationkey AS INT) AS "group" FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)""")
def vacated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("group"))
    return export.vacated_groups(before, read(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_nationkey").cast("int").alias("group")))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'UK | ' || p_name WHEN 1 THEN 'US: ' || p_name WHEN 2 THEN 'Canada ' || p_name WHEN 3 THEN p_name WHEN 4 THEN p_name || ' | DE' ELSE 'New Zealand ' || p_name END AS g FROM part JOIN (SELECT 1) ON true)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'UK' WHEN 1 THEN 'US' WHEN 2 THEN 'CA' WHEN 4 THEN 'DE' WHEN 5 THEN 'NZ' END AS country, p_name AS category FROM part""")
def split_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("UK | "), "p_name")).when(k == 1, F.concat(F.lit("US: "), "p_name")).when(k == 2, F.concat(F.lit("Canada "), "p_name")).when(k == 3, F.col("p_name")).when(k == 4, F.concat("p_name", F.lit(" | DE"))).otherwise(F.concat(F.lit("New Zealand "), "p_name"))
    split = titles.split_group(text)
    return p.select("p_partkey", split["country"].alias("country"), split["category"].alias("category"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'dead' WHEN event_id % 7 = 0 THEN 'no_video' WHEN event_id % 5 = 0 AND value > 0 THEN 'placeholder' WHEN event_id % 3 = 0 THEN 'no_frame' WHEN value > 20 THEN 'dirty' ELSE 'ok' END AS status FROM events""")
def probe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    finite = media.duration(F.when(i % 5 == 0, F.col("value").cast("string")).otherwise("N/A"))
    return e.select("event_id", media.status(i % 11 != 0, i % 7 != 0, finite, i % 3 != 0, F.col("value") / 20).alias("status"))
