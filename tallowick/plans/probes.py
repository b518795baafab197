"""Registered queries of scalar functions: titles, pictures, frame rates, what probes measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.functions import media, titles
from tallowick.functions.titles import Titles
from tallowick.operators import search
from tallowick.plans.registry import pick, query, read, sql_pick
from tallowick.sources import guide

# Titles with their reading: region, key, identity, shifted.
_TITLES = (
    ("UK: Meridian Sports 1", "UK", "MERIDIANSPORTS1", "UK: MERIDIAN SPORTS 1", "false"), ("UKFHD | Café Sports HD", "UK", "CAFESPORTS", "UKFHD | CAFE SPORTS", "false"),
    ("HEVC FHD Meridian Sports 1", None, "MERIDIANSPORTS1", "MERIDIAN SPORTS 1", "false"), ("Discovery HD - UK", "UK", "DISCOVERY", "DISCOVERY - UK", "false"),
    ("UKRAINE: Futbol 1", None, "UKRAINEFUTBOL1", "UKRAINE: FUTBOL 1", "false"), ("UK: Gold +1", "UK", "GOLDTIMESHIFT1", "UK: GOLD +1", "true"),
    ("Drama & Co [Multi-Audio]", None, "DRAMAANDCO", "DRAMA & CO [ -AUDIO]", "false"),
)


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", pick(tuple(t[0] for t in _TITLES), F.col("c_custkey")).alias("name"))


@query("SELECT c_custkey, " + ", ".join(f"{sql_pick(tuple(t[i] for t in _TITLES), 'c_custkey')} AS {n}" for i, n in ((1, "region"), (2, "key"), (3, "identity"))) + f", {sql_pick(tuple(t[4] for t in _TITLES), 'c_custkey')} = 'true' AS shifted FROM customer")
def titles_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents, tags of quality and region, brackets and shifts in time, as each is read."""
    reader = Titles()
    return _titled(spark, sf_dir).select("c_custkey", reader.region_column("name").alias("region"), reader.key_column("name").alias("key"), reader.identity_column("name").alias("identity"), titles.is_timeshift(F.col("name")).alias("shifted"))


@query("""SELECT doc_id, array_to_string(list_sort(regexp_extract_all(lower(regexp_replace(text, '[^ -~]', '.', 'g')), '[a-z0-9]+')), ' ') AS words FROM documents""")
def sorted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", "[^ -~]", ".")
    return read(spark, sf_dir, "documents").select("doc_id", titles.token_set(text).alias("words"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(trim(CASE WHEN page_id % 9 = 0 THEN ' -.- ' ELSE '--' || url || ' .' END), '[^A-Za-z0-9._-]+', '-', 'g')[:64], '^[-.]+|[-.]+$', '', 'g') AS n FROM pages) SELECT page_id, nullif(lower(n), '') AS name FROM s""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_id") % 9 == 0, " -.- ").otherwise(F.concat(F.lit("--"), "url", F.lit(" .")))
    return read(spark, sf_dir, "pages").select("page_id", titles.safe_name(text).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN strftime(date_trunc('second', ts) - CASE event_id % 5 WHEN 1 THEN INTERVAL 1 HOUR WHEN 2 THEN INTERVAL '-5:30' HOUR TO MINUTE ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS t FROM events""".replace("INTERVAL '-5:30' HOUR TO MINUTE", "-INTERVAL 330 MINUTE"))
def guide_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guide times with and without an offset, and text that is none, read as UTC."""
    i = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyyMMddHHmmss"), pick((" +0000", " +0100", " -0530", "", " x"), i))
    read_back = guide.time_of(F.when(i % 5 == 4, "soon").otherwise(text))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(read_back, "yyyy-MM-dd HH:mm:ss").alias("t"))


_PIXELS = "p AS (SELECT vec_id, list_transform(range(72), lambda i: CAST(floor(abs(embedding[i % 64 + 1]) * 255) AS INT) % 256) AS px FROM embeddings)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * 255).cast("int") % 256))
    return read(spark, sf_dir, "embeddings").select("vec_id", px.alias("px"))


@query(f"""WITH {_PIXELS}, b AS (SELECT vec_id, px, list_aggregate(list_transform(range(64), lambda j: CASE WHEN px[j // 8 * 9 + j % 8 + 1] < px[j // 8 * 9 + j % 8 + 2] THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM p)
SELECT vec_id, lower(list_aggregate(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + CAST(bits[k * 4 + 1] AS INT) * 8 + CAST(bits[k * 4 + 2] AS INT) * 4 + CAST(bits[k * 4 + 3] AS INT) * 2 + CAST(bits[k * 4 + 4] AS INT), 1)), 'string_agg', '')) AS dhash, list_max(px) - list_min(px) AS contrast, list_max(px) - list_min(px) < 12 AS flat FROM b""")
def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrast = media.contrast(F.col("px"))
    return _pixels(spark, sf_dir).select("vec_id", media.gradient_hash(F.col("px")).alias("dhash"), contrast.alias("contrast"), (contrast < media.FLAT_BELOW).alias("flat"))


@query(f"""WITH {_PIXELS}, g AS (SELECT vec_id // 4 AS clip, px, lead(px) OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) AS nx FROM p WHERE vec_id % 7 <> 0)
SELECT clip, round(avg(CASE WHEN nx IS NOT NULL THEN list_sum(list_transform(range(1, 73), lambda i: abs(px[i] - nx[i]))) / 72.0 END), 6) AS motion FROM g GROUP BY 1""")
def motion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).filter("vec_id % 7 <> 0").groupBy(F.floor(F.col("vec_id") / 4).alias("clip")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "px"))), lambda x: x["px"]).alias("frames"))
    return rows.select("clip", F.round(media.motion(F.col("frames")), 6).alias("motion"))


_RATES = ("25/1", "30000/1001", "50", "0/0", "x/1", "24000/1001", "", "30/1/2")


@query(f"SELECT event_id, CAST({sql_pick(('25.0', '29.97', '50.0', '0', '0', '23.976', '0', '30'), 'event_id')} AS DOUBLE) AS fps, {sql_pick(('pal', 'ntsc', 'pal', None, None, 'film', None, 'ntsc'), 'event_id')} AS cadence, CASE event_id % 6 WHEN 0 THEN 42.5 WHEN 5 THEN CAST(event_id AS DOUBLE) END AS duration FROM events WHERE event_id > 0")
def frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rate = media.frame_rate(pick(_RATES, i))
    seconds = F.when(i % 6 == 0, "42.5").when(i % 6 == 1, "N/A").when(i % 6 == 2, "-1").when(i % 6 == 3, "0").when(i % 6 == 4, "").otherwise(i.cast("string"))
    return read(spark, sf_dir, "events").filter("event_id > 0").select("event_id", rate.alias("fps"), media.cadence(rate).alias("cadence"), media.duration(seconds).alias("duration"))


# A decoder's messages: what the n-th kind of line says; @ is the number of the event.
_LINES = ("frame=  10 fps=25 time=00:00:01.00 speed=1x", "error while decoding MB 3", "frame=  90 fps=25 time=00:00:0@.50 speed=1x", "concealing 12 DC coefficients", "Past duration too large", "non-existing PPS 0 referenced")


@query("""SELECT event_id, CAST(4 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS errors, CAST(1 + CASE WHEN event_id % 8 < 2 THEN 2 ELSE 0 END AS INT) AS startup, CAST(CASE WHEN event_id % 8 < 2 THEN 0 ELSE 2 END AS INT) AS steady, greatest(1.0, event_id % 8 + 0.5) AS decoded,
round(CASE WHEN event_id % 8 < 2 THEN 0 ELSE 2 END / greatest(1.0, greatest(1.0, event_id % 8 + 0.5) - 2), 2) AS per_second, event_id % 3 = 0 AS refused FROM events""".replace("greatest(1.0, event_id % 8 + 0.5) AS decoded", "CAST(greatest(1.0, event_id % 8 + 0.5) AS DOUBLE) AS decoded"))
def decoder_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    lines = F.concat_ws("\n", *(F.lit(x) for x in _LINES))
    text = F.replace(F.concat(lines, F.when(i % 3 == 0, "\r\nServer returned 403 Forbidden").otherwise("\n\n")), F.lit("@"), (i % 8).cast("string"))
    found = media.damage(text)
    return read(spark, sf_dir, "events").select("event_id", *(found[c].alias(c) for c in ("errors", "startup", "steady", "decoded", "per_second", "refused")))


@query("""SELECT event_id, event_id % 4 > 1 AS several, event_id % 4 > 1 AND event_id % 3 = 0 AS several_dash, event_id % 5 <> 0 AND value >= 9 AS slow, event_id % 7 <> 0 AND event_id % 2 = 0 AND event_id % 11 > 0 AS nothing,
CASE WHEN event_id % 13 = 0 THEN 'rate limited' WHEN event_id % 7 <> 0 AND event_id % 2 = 0 AND event_id % 11 > 0 THEN 'provider declined' ELSE 'no frame' END AS reason FROM events""")
def probe_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    picture, decoded = i % 7 == 0, F.when(i % 2 == 1, F.lit(3.5))
    nothing = (picture, decoded, F.lit(None).cast("double"), i % 11)
    return e.select("event_id", media.several_rates(i % 4).alias("several"), media.several_rates_dash(i % 4, F.when(i % 3 == 0, "mpeg,DASH").when(i % 3 == 1, "hls")).alias("several_dash"), media.slow_fetch(F.col("value"), F.lit(10.0), i % 5 == 0).alias("slow"), media.served_nothing(*nothing).alias("nothing"), media.no_frame_reason(i % 13 == 0, *nothing).alias("reason"))


@query("""WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS w, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_partkey END AS h, l_linestatus = 'F' AS v, l_partkey AS id FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY coalesce(w * h, 0) DESC, n, id, w, h NULLS FIRST) AS i FROM s WHERE v), a AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, id, w, h NULLS FIRST) AS i FROM s WHERE NOT v)
SELECT o AS l_orderkey, max(r.id) AS video, max(a.id) AS audio FROM (SELECT DISTINCT o FROM s) LEFT JOIN (FROM r WHERE i = 1) r USING (o) LEFT JOIN (FROM a WHERE i = 1) a USING (o) GROUP BY 1""")
def best_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "F", "video").otherwise("audio")
    one = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("width"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("height"), kind.alias("codec_type"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("streams"))
    return rows.select("l_orderkey", media.best_rendition(F.col("streams"))["id"].alias("video"), media.first_audio(F.col("streams"))["id"].alias("audio"))


@query("""SELECT c_custkey, CAST(floor(0.25 * 1920) AS INT) AS x, CAST(least(1079, floor((c_custkey % 10) / 8.0 * 1080)) AS INT) AS y, CAST(greatest(1, least(1920 - 480, round(0.5 * 1920))) AS INT) AS w, CAST(greatest(1, least(1080 - least(1079, floor((c_custkey % 10) / 8.0 * 1080)), round(0.125 * 1080))) AS INT) AS h FROM customer""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.lit(0.25).alias("x"), (F.col("c_custkey") % 10 / 8.0).alias("y"), F.lit(0.5).alias("w"), F.lit(0.125).alias("h"))
    out = media.crop(box, F.lit(1920), F.lit(1080))
    return read(spark, sf_dir, "customer").select("c_custkey", *(out[c].alias(c) for c in "xywh"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^ -~]', '.', 'g'), '[A-Za-z0-9]+'), lambda x: length(x) >= 3) AS ws FROM documents)
SELECT doc_id, list_filter(ws, lambda x: length(x) = list_max(list_transform(ws, lambda y: length(y))))[1] AS needle FROM w""")
def loose_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", search.needle(F.regexp_replace("text", "[^ -~]", ".")).alias("needle"))


@query("SELECT event_id, split_part(CAST(user_id AS VARCHAR) || '|' || event_type, '|', 1) AS lane, sha256(event_type)[:16] AS digest FROM events")
def lanes_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("job"))
    return rows.select("event_id", titles.lane(F.col("job")).alias("lane"), titles.digest(F.col("event_type")).alias("digest"))


_FILES = ("UK_Sky_lineup.json", "us_Comcast-Basic.json", "FR.json", "xx_some-list-lineup.json", "ca_Bell_Fibe_LINEUP.json")


@query(f"SELECT c_custkey, {sql_pick(('United Kingdom', 'United States', 'France', 'Other', 'Canada'), 'c_custkey')} AS country, {sql_pick(('Sky', 'Comcast Basic', 'France', 'xx some list', 'Bell Fibe'), 'c_custkey')} AS package FROM customer")
def lineup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = titles.lineup_label(pick(_FILES, F.col("c_custkey")))
    return read(spark, sf_dir, "customer").select("c_custkey", label["country"].alias("country"), label["package"].alias("package"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'nonsense' WHEN 1 THEN '-5' WHEN 2 THEN '100000' WHEN 3 THEN '7' WHEN 4 THEN NULL ELSE '2' END AS given, CAST(CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 3 WHEN 2 THEN 60 WHEN 3 THEN 7 WHEN 4 THEN 10 ELSE 3 END AS INT) AS sample,
CASE event_id % 3 WHEN 0 THEN 'strict' ELSE 'normal' END AS sensitivity, event_id % 5 NOT IN (0, 1, 2) AS prune FROM events""")
def settings_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallowick.functions import settings

    i = F.col("event_id")
    given = F.when(i % 6 == 0, "nonsense").when(i % 6 == 1, "-5").when(i % 6 == 2, "100000").when(i % 6 == 3, "7").when(i % 6 == 4, F.lit(None).cast("string")).otherwise("2")
    return read(spark, sf_dir, "events").select("event_id", given.alias("given"), settings.whole(given, 3, 60, 10).alias("sample"), settings.one_of(F.when(i % 3 == 0, "strict").otherwise("loud"), ("strict", "normal", "relaxed"), "normal").alias("sensitivity"), settings.switch(F.when(i % 5 == 0, "false").when(i % 5 == 1, "0").when(i % 5 == 2, "No").when(i % 5 == 3, "yes"), True).alias("prune"))
