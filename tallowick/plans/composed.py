"""Registered queries of text functions over inputs that are put together from the tables, with their rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.functions import media, settings, titles, vocab
from tallowick.functions.titles import Titles
from tallowick.plans.registry import pick, query, read, sql_pick

_BETWEEN = (": ", " | ", " - ", ":", "|", " / ", "-", " ")
_K = "p_partkey"

# Of a word of quality the region that it begins or ends with counts, as PL of PLUS: the longest.
_LONGEST = "[" + ", ".join(f"'{t}'" for t in sorted(vocab.REGION_TAGS, key=len, reverse=True)) + "]"
# Each part number chooses a region, a quality, a separator and where the tags stand.
_TAGGED = f"""t AS (SELECT {_K}, p_name, {sql_pick(vocab.REGION_TAGS, _K)} AS region, {sql_pick(vocab.QUALITY_TAGS, f"{_K} // 7")} AS quality,
{sql_pick(_BETWEEN, f"{_K} // 3")} AS gap, {_K} // 5 % 6 AS kind FROM part)"""


@query(f"""WITH {_TAGGED}
SELECT {_K}, CASE kind WHEN 2 THEN list_filter({_LONGEST}, lambda x: starts_with(quality, x))[1] WHEN 5 THEN list_filter({_LONGEST}, lambda x: ends_with(quality, x))[1] ELSE region END AS region, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) || CASE WHEN kind = 4 THEN 'TIMESHIFT' || ({_K} % 9 + 1) ELSE '' END AS key, kind = 4 AS shifted,
CASE kind WHEN 0 THEN region || gap || upper(p_name) WHEN 1 THEN region || gap || upper(p_name) WHEN 2 THEN upper(p_name) WHEN 3 THEN upper(p_name) || ' - ' || region
WHEN 4 THEN region || gap || upper(p_name) || ' +' || ({_K} % 9 + 1) ELSE upper(p_name) END AS identity FROM t""")
def titles_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with every tag of region and quality, in front or behind, after every separator, some shifted in time."""
    k = F.col(_K)
    region, quality = pick(tuple(vocab.REGION_TAGS), k), pick(tuple(vocab.QUALITY_TAGS), F.expr(f"{_K} div 7"))
    gap, kind = pick(_BETWEEN, F.expr(f"{_K} div 3")), F.expr(f"{_K} div 5 % 6")
    name = (
        F.when(kind == 0, F.concat(region, gap, "p_name"))
        .when(kind == 1, F.concat(region, gap, "p_name", F.lit(" "), quality))
        .when(kind == 2, F.concat(quality, F.lit(" "), "p_name"))
        .when(kind == 3, F.concat("p_name", F.lit(" - "), region))
        .when(kind == 4, F.concat(region, gap, "p_name", F.lit(" +"), (k % 9 + 1).cast("string")))
        .otherwise(F.concat("p_name", F.lit(" "), quality))
    )
    reader = Titles()
    rows = read(spark, sf_dir, "part").select(_K, name.alias("name"))
    return rows.select(_K, reader.region_column("name").alias("region"), reader.key_column("name").alias("key"), titles.is_timeshift(F.col("name")).alias("shifted"), reader.identity_column("name").alias("identity"))


_DENOMINATORS = ("1001", "1000", "0", "x", "", None, "-1000")


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) * 1000 AS VARCHAR) AS n, {sql_pick(_DENOMINATORS, "l_partkey")} AS d FROM lineitem),
r AS (SELECT *, CASE WHEN d IS NULL THEN CAST(n AS DOUBLE) / 1000 WHEN try_cast(d AS DOUBLE) <> 0 THEN CAST(n AS DOUBLE) / try_cast(d AS DOUBLE) ELSE 0 END AS rate FROM f)
SELECT l_orderkey, l_linenumber, round(rate, 3) AS fps, CASE WHEN round(round(rate, 3), 2) IN (25, 50) THEN 'pal' WHEN round(round(rate, 3), 2) IN (29.97, 30, 59.94, 60) THEN 'ntsc' WHEN round(round(rate, 3), 2) IN (23.98, 24) THEN 'film' END AS cadence FROM r""")
def frame_rates_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as fractions of all quantities and several denominators, some none, and whole numbers of thousandths."""
    n, d = F.col("l_quantity").cast("int"), pick(_DENOMINATORS, F.col("l_partkey"))
    text = F.coalesce(F.concat_ws("/", (n * 1000).cast("string"), F.when(d.isNotNull(), d)), F.lit(""))
    rate = media.frame_rate(F.when(d.isNull(), n.cast("string")).otherwise(text))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("fps"), media.cadence(rate).alias("cadence"))


_WRITTEN = ("", " ", "x", "-")


@query(f"""WITH s AS (SELECT event_id, {sql_pick(_WRITTEN, "event_id")} || CASE event_id % 4 WHEN 2 THEN '' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) END || CASE WHEN event_id % 7 = 0 THEN ' ' ELSE '' END AS t, event_type AS w FROM events WHERE event_id > 0)
SELECT event_id, t AS given, CASE WHEN event_id % 4 = 2 THEN 10 ELSE greatest(3, least(60, CAST(trim(t) AS BIGINT))) END AS sample,
CASE WHEN w IN ('view', 'click') THEN w ELSE 'other' END AS word, CASE WHEN w IS NULL THEN true ELSE w NOT IN ('error', 'signup') END AS on FROM s""".replace(" AS on ", ' AS "on" '))
def settings_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written with signs, blanks and letters, numbers of any size, and words."""
    i, w = F.col("event_id"), F.col("event_type")
    number = F.when(i % 4 == 2, "").otherwise(F.floor(F.col("value") * 10).cast("string"))
    given = F.concat(pick(_WRITTEN, i), number, F.when(i % 7 == 0, " ").otherwise(""))
    off = F.when(w.isin("error", "signup"), "No").otherwise(w)
    rows = read(spark, sf_dir, "events").filter("event_id > 0")
    return rows.select("event_id", given.alias("given"), settings.whole(given, 3, 60, 10).cast("long").alias("sample"), settings.one_of(w, ("view", "click"), "other").alias("word"), settings.switch(off, True).alias("on"))


_LINEUPS = (*vocab.LINEUP_COUNTRIES, "XX", "ZZ")
_ENDS = ("", "_lineup", "-LINEUP", "_Lineup")


@query(f"""WITH f AS (SELECT {_K}, {sql_pick(_LINEUPS, _K)} AS code, replace(p_name, ' ', CASE WHEN {_K} % 2 = 0 THEN '_' ELSE '-' END) AS words FROM part),
c AS (SELECT *, CASE code {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LINEUP_COUNTRIES.items())} END AS known FROM f)
SELECT {_K}, coalesce(known, 'Other') AS country, CASE WHEN known IS NULL THEN CASE WHEN {_K} % 3 = 0 THEN lower(code) ELSE code END || ' ' ELSE '' END || replace(replace(words, '_', ' '), '-', ' ') AS package FROM c""")
def lineup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of line-ups named by every country's code or none, then words, with several endings."""
    k = F.col(_K)
    code = pick(_LINEUPS, k)
    words = F.when(k % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    label = titles.lineup_label(F.concat(F.when(k % 3 == 0, F.lower(code)).otherwise(code), F.lit("_"), words, pick(_ENDS, F.expr(f"{_K} div 11")), F.lit(".json")))
    return read(spark, sf_dir, "part").select(_K, label["country"].alias("country"), label["package"].alias("package"))


_SAID = ("error while decoding MB 3", "concealing 12 DC coefficients", "Past duration too large", "HTTP error 403 Forbidden", "corrupt frame", "Stream mapping")


@query(f"""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 4 = 0 AS clock, l_partkey % 90 + l_linenumber / 4.0 AS at1, l_partkey % 6 AS said FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, said, at1, clock) AS i FROM l),
d AS (SELECT *, coalesce(last_value(CASE WHEN clock THEN at1 END IGNORE NULLS) OVER (PARTITION BY o ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS now FROM s),
c AS (SELECT o, count(*) FILTER (WHERE NOT clock) AS errors, count(*) FILTER (WHERE NOT clock AND said IN (0, 1, 4) AND now < 2) AS startup, count(*) FILTER (WHERE NOT clock AND said IN (0, 1, 4) AND now >= 2) AS steady,
greatest(0, coalesce(max(at1) FILTER (WHERE clock), 0)) AS decoded, bool_or(NOT clock AND said = 3) AS refused FROM d GROUP BY o)
SELECT o AS l_orderkey, CAST(errors AS INT) AS errors, CAST(startup AS INT) AS startup, CAST(steady AS INT) AS steady, CAST(round(decoded, 1) AS DOUBLE) AS decoded, round(steady / greatest(1.0, decoded - 2), 2) AS per_second, refused FROM c""")
def decoder_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder's messages, a line for each item of an order: progress, damage, refusals, and others."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    at = p % 90 + n / 4.0
    clock = F.concat(F.lit("frame= 9 fps=25 time=00:"), F.format_string("%02d", F.floor(at / 60).cast("int")), F.lit(":"), F.format_string("%05.2f", at - F.floor(at / 60) * 60), F.lit(" speed=1x"))
    line = F.when(p % 4 == 0, clock).otherwise(pick(_SAID, p))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (p % 6).alias("said"), at.alias("at"), line.alias("line")))).alias("x"))
    found = media.damage(F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    return rows.select("l_orderkey", *(found[c].alias(c) for c in ("errors", "startup", "steady", "decoded", "per_second", "refused")))


@query(f"""WITH f AS (SELECT {_K}, p_name, {sql_pick(tuple(w.title() for w in vocab.REGION_WORDS), _K)} AS region, {sql_pick(vocab.QUALITY_TAGS, f"{_K} // 7")} AS quality FROM part)
SELECT {_K}, CASE WHEN {_K} % 5 = 4 THEN p_name || ' ONE' WHEN {_K} % 5 = 2 AND regexp_matches(region, '[A-Z]$') THEN p_name || region || quality ELSE p_name END AS family FROM f""")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with each word of region, with or without one of quality behind it, spaced or run together after a small letter."""
    k = F.col(_K)
    region, quality = pick(tuple(w.title() for w in vocab.REGION_WORDS), k), pick(tuple(vocab.QUALITY_TAGS), F.expr(f"{_K} div 7"))
    name = (
        F.when(k % 5 == 0, F.concat("p_name", F.lit(" "), region))
        .when(k % 5 == 1, F.concat("p_name", F.lit("  "), F.upper(region), F.lit(" "), quality))
        .when(k % 5 == 2, F.concat("p_name", region, quality))
        .when(k % 5 == 3, F.concat("p_name", F.lit(" "), quality, F.lit(" ")))
        .otherwise(F.concat("p_name", F.lit(" ONE")))
    )
    return read(spark, sf_dir, "part").select(_K, titles.without_region(name).alias("family"))
