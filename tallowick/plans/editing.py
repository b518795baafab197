"""Registered queries of edits of lists, preferences, numbers and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.operators import curate, editing, pools, rank
from tallowick.plans import catalogue as cat
from tallowick.plans.registry import query, read

_K = "upper(replace(p_name, ' ', ''))"


def _key(c: str = "p_name") -> F.Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted list: a customer for each key, with numbers that leave gaps and some missing."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("K"), k).alias("key"), F.when(k % 4 != 0, (k * 2).cast("int")).alias("number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("group"), k)


_LIST = "l AS (SELECT 'K' || c_custkey AS key, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey * 2 AS INT) END AS number, c_name AS name, c_mktsegment AS grp, c_custkey FROM customer)"


@query(f"""WITH p AS (SELECT {_K} AS key, min(p_partkey) AS pos, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1), w AS (SELECT key, CAST(row_number() OVER (ORDER BY key) AS INT) AS number, name, 'old' AS tvg_id FROM p WHERE pos % 3 = 0),
n AS (SELECT {_K} AS key, min(p_partkey) AS at1 FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
SELECT * FROM w UNION ALL SELECT key, CAST((SELECT max(number) FROM w) + row_number() OVER (ORDER BY at1) AS INT), name, 't' || pos FROM n JOIN p USING (key) WHERE key NOT IN (SELECT key FROM w)""")
def list_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(_key().alias("channel_key"), F.col("p_partkey").alias("src_pos"), F.col("p_name").alias("name"), F.concat(F.lit("t"), "p_partkey").alias("tvg_id"))
    first = p.groupBy(F.col("channel_key").alias("key")).agg(F.min("src_pos").alias("pos"), F.min_by("name", "src_pos").alias("name")).filter("pos % 3 = 0")
    from tallowick.operators.order import placed

    wanted = placed(first, "key", name="number").select("key", F.col("number").cast("int").alias("number"), "name", F.lit("old").alias("tvg_id"))
    keys = p.filter("src_pos % 5 <> 0").select(F.col("channel_key").alias("key"), F.col("src_pos").alias("pos"))
    return editing.added(wanted, keys, p)


@query("""SELECT DISTINCT o_custkey % 40 AS channel_key, 's' || o_custkey AS id, CAST(last_order AS VARCHAR) AS would_match FROM orders JOIN (SELECT o_custkey AS c, max(o_orderkey) AS last_order FROM orders GROUP BY 1) ON c = o_custkey WHERE o_orderkey % 2 = 0
AND (o_custkey % 40, 's' || o_custkey) NOT IN (SELECT o_custkey % 40, 's' || o_custkey FROM orders WHERE o_orderkey % 9 = 0)""")
def candidates_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("s"), "o_custkey")).withColumn("at", F.col("o_custkey") % 40)
    streams = o.select("id", F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("channel_key"), F.col("o_orderkey").alias("src_pos"))
    asked = o.filter("o_orderkey % 2 = 0").select(F.col("at").alias("channel_key"), "id")
    log = o.filter("o_orderkey % 9 = 0").select(F.col("at").alias("channel_key"), F.col("id").alias("stream_id"))
    return editing.picked(asked, streams, log).select("channel_key", "id", "would_match")


@query(f"""WITH {_LIST}, t AS (SELECT 'K' || (c_custkey + 700) AS key, c_custkey AS remote_id, CAST(c_custkey AS INT) AS number, 'R' || c_name AS name, c_nationkey AS g FROM customer)
SELECT coalesce(l.key, t.key) AS key, CASE WHEN l.key IS NULL THEN t.number ELSE l.number END AS number, CASE WHEN l.key IS NULL THEN t.name ELSE l.name END AS name, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN grp END, CASE WHEN g % 2 = 0 THEN 'g' || g END) AS "group", remote_id FROM l FULL JOIN t ON l.key = t.key""")
def list_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _list(spark, sf_dir).withColumn("group", F.when(F.col("c_custkey") % 3 != 0, F.col("group"))).drop("c_custkey")
    k = F.col("c_custkey")
    remote = read(spark, sf_dir, "customer").select(F.concat(F.lit("K"), k + 700).alias("key"), k.alias("remote_id"), k.cast("int").alias("number"), F.concat(F.lit("R"), "c_name").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("g"), "c_nationkey")).otherwise("").alias("group"))
    return editing.imported(wanted, remote)


@query(f"""WITH {_LIST}, t AS (SELECT 'K' || (c_custkey * 3) AS key, CAST(9000 + c_custkey AS INT) AS number, 'R' || c_name AS name FROM customer)
SELECT coalesce(l.key, t.key) AS key, coalesce(l.number, t.number) AS number, CASE WHEN l.key IS NULL THEN t.name ELSE l.name END AS name, l.key IS NOT NULL AND t.key IS NOT NULL AS relinked FROM l FULL JOIN t ON l.key = t.key""")
def list_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    claims = read(spark, sf_dir, "customer").select(F.concat(F.lit("K"), k * 3).alias("key"), (k + 9000).cast("int").alias("number"), F.concat(F.lit("R"), "c_name").alias("name"), k.alias("pos"))
    return editing.claimed(_list(spark, sf_dir).select("key", "number", "name"), claims)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Now' WHEN '5-LOW' THEN 'Later' ELSE o_orderpriority END AS name FROM orders")
def renamed_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = spark.createDataFrame([("1-URGENT", "Now"), ("5-LOW", "Later"), ("none", "x")], "old string, new string")
    return editing.renamed(read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority as name"), renames)


@query("SELECT DISTINCT g AS \"group\" FROM (SELECT c_mktsegment AS g FROM customer UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0)")
def known_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group")).union(spark.createDataFrame([("",), (None,)], "g string"))
    return editing.known_groups(own, read(spark, sf_dir, "nation").selectExpr("n_name as name", "n_nationkey % 3 as channel_count"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS \"group\" FROM customer")
def group_taken_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment as group")
    return editing.without_groups(rows, spark.createDataFrame([("BUILDING",), ("none",)], "group string"))


_PREFS = """old AS (SELECT user_id AS key, event_type AS field, arg_max(CAST(event_id AS VARCHAR), event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
new AS (SELECT user_id AS key, event_type AS field, arg_max(struct_pack(v := CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) END), event_id).v AS value, true AS is_new FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0 GROUP BY 1, 2),
prefs AS (SELECT coalesce(old.key, new.key) AS key, coalesce(old.field, new.field) AS field, CASE WHEN is_new THEN new.value ELSE old.value END AS value FROM old FULL JOIN new ON old.key = new.key AND old.field = new.field)"""


def _prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("pos"))
    old = rows.filter("pos % 2 = 0").groupBy("key", "field").agg(F.max("pos").cast("string").alias("value"))
    new = rows.filter("pos % 2 = 1 and pos % 3 = 0").withColumn("value", F.when(F.col("pos") % 5 != 0, F.col("pos").cast("string")))
    return editing.preferences(old, new)


@query(f"WITH {_PREFS} SELECT * FROM prefs WHERE value IS NOT NULL")
def preferences_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefs(spark, sf_dir)


@query(f"WITH {_PREFS} SELECT key, CASE field WHEN 'click' THEN 'group' ELSE 'confirmed' END AS field, CASE WHEN key % 3 = 0 THEN 'false' ELSE value END AS value FROM prefs WHERE value IS NOT NULL AND field IN ('click', 'view') AND key % 3 <> 0")
def preferences_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("field") == "click", "group").when(F.col("field") == "view", "confirmed").otherwise("primary")
    return editing.durable(_prefs(spark, sf_dir).withColumn("field", field).withColumn("value", F.when(F.col("key") % 3 == 0, "false").otherwise(F.col("value"))))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 1 THEN 'own' ELSE c_mktsegment END AS "group" FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 3 <> 0""")
def groups_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    wanted = c.select(k.alias("key"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("group"))
    return editing.seeded(wanted, c.filter(k % 4 < 3).select(k.alias("key"), F.when(k % 4 == 1, "own").otherwise("").alias("group")))


@query(f"""WITH {cat._RANKED_SQL}, n AS (SELECT channel_key, min(l_suppkey) AS p FROM records WHERE channel_key % 2 = 0 GROUP BY 1), o AS (SELECT channel_key, CASE WHEN channel_key % 3 = 0 THEN p ELSE p + 1 END AS p FROM n WHERE channel_key % 4 = 0), b AS (SELECT channel_key, l_suppkey AS best FROM ranked WHERE rank = 1)
SELECT n.channel_key, best AS algorithm_pick, n.p AS curator_pick FROM n JOIN b USING (channel_key) LEFT JOIN o USING (channel_key) WHERE n.p <> best AND n.p IS DISTINCT FROM o.p""")
def overrides_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.ranked(cat._records(spark, sf_dir), tie=tuple(cat._RECORD_COLUMNS)).withColumn("stream_id", F.col("l_suppkey"))
    new = found.filter("channel_key % 2 = 0").groupBy("channel_key").agg(F.min("stream_id").alias("primary"))
    old = new.filter("channel_key % 4 = 0").withColumn("primary", F.when(F.col("channel_key") % 3 == 0, F.col("primary")).otherwise(F.col("primary") + 1))
    return editing.overrides(old, new, found)


@query("SELECT n_name AS name, CAST(row_number() OVER (ORDER BY CASE WHEN n_nationkey % 6 = 0 THEN -n_nationkey END NULLS LAST, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey % 5 END NULLS LAST, n_name) - 1 AS INT) AS priority FROM nation")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    sources = n.select(F.col("n_name").alias("name"), F.when(k % 2 == 1, k % 5).alias("priority"))
    return editing.source_order(sources, n.filter(k % 6 == 0).select(F.col("n_name").alias("name"), (-k).alias("pos")))


@query("SELECT c_nationkey AS key, c_custkey AS remote_id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS i FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE i = 1")
def claims_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = read(spark, sf_dir, "customer").selectExpr("c_nationkey as key", "c_custkey as remote_id", "c_name as name", "c_mktsegment as source", "c_custkey as pos")
    return editing.claims_by_key(editing.released(claims, "BUILDING")).select("key", "remote_id")


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS number, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) THEN 'deleted' ELSE 'already gone' END AS outcome, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) AS present FROM orders")
def staged_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey as number")
    return editing.removals(staged, read(spark, sf_dir, "customer").filter("c_nationkey < 10").selectExpr("c_custkey as channel_number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 WHEN o_custkey % 5 > 0 AND o_custkey % 5 <= o_orderkey % 7 THEN o_custkey % 5 ELSE o_orderkey % 7 END AS lim FROM orders")
def limit_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, found = F.col("o_custkey") % 5, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 7)
    return read(spark, sf_dir, "orders").select("o_orderkey", editing.ratcheted(current, found).alias("lim"))


@query("SELECT s_suppkey AS source, n_nationkey AS account FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey % 4 <> 0")
def account_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = lambda c: F.when(F.col(c) % 4 == 0, "").otherwise(F.concat(F.lit("http://H/"), F.col(c)))
    return editing.account_of(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), url("s_nationkey").alias("url")), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), url("n_nationkey").alias("url")))


@query("""WITH l AS (SELECT 'K' || c_custkey AS key, CAST(c_custkey * 2 AS INT) AS number, c_name AS name FROM customer WHERE c_custkey % 5 <> 0),
o AS (SELECT c_nationkey AS scope, 'K' || c_custkey AS key, c_acctbal AS a, c_custkey FROM customer WHERE c_custkey % 3 <> 0), h AS (SELECT o.*, number, row_number() OVER (PARTITION BY scope ORDER BY a, c_custkey) AS pos FROM o LEFT JOIN l USING (key)),
m AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos) AS i FROM h WHERE number IS NULL),
b AS (SELECT scope, coalesce(max(number), (SELECT max(number) FROM l)) AS base FROM h GROUP BY 1),
f AS (SELECT scope, base + k AS number FROM b, LATERAL (SELECT unnest(range(1, 4000)) AS k) WHERE base + k NOT IN (SELECT number FROM l)), g AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY number) AS i FROM f),
n AS (SELECT m.scope, m.key, m.pos, CAST(g.number AS INT) AS number FROM m JOIN g ON g.scope = m.scope AND g.i = m.i),
r AS (SELECT scope, key, pos, number FROM h WHERE number IS NOT NULL UNION ALL SELECT * FROM n), d AS (SELECT x.key, y.number FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY pos) AS j FROM r) x JOIN (SELECT scope, number, row_number() OVER (PARTITION BY scope ORDER BY number) AS j FROM r) y ON x.scope = y.scope AND x.j = y.j)
SELECT w.key, coalesce(d.number, w.number) AS number FROM (SELECT key, number FROM l UNION ALL SELECT key, number FROM n) w LEFT JOIN d USING (key)""")
def renumber_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    key = F.concat(F.lit("K"), k).alias("key")
    wanted = c.filter(k % 5 != 0).select(key, (k * 2).cast("int").alias("number"), F.col("c_name").alias("name"))
    order = c.filter(k % 3 != 0).select(F.col("c_nationkey").alias("scope"), key, F.struct("c_acctbal", "c_custkey").alias("pos"))
    return editing.renumbered(wanted, order, c.select(key, F.col("c_name").alias("name"))).select("key", "number")


@query(f"""WITH {_LIST}, p AS (SELECT 'K' || (c_custkey * 10) AS a, 'K' || (c_custkey * 10 + 4) AS b FROM customer), r AS (SELECT p.*, x.number AS na, y.number AS nb FROM p JOIN l x ON x.key = a JOIN l y ON y.key = b), s AS (SELECT a AS key, nb AS n FROM r UNION ALL SELECT b, na FROM r)
SELECT l.key, CASE WHEN s.key IS NOT NULL THEN n ELSE number END AS number FROM l LEFT JOIN s ON l.key = s.key""")
def numbers_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "customer").select(F.concat(F.lit("K"), F.col("c_custkey") * 10).alias("key_a"), F.concat(F.lit("K"), F.col("c_custkey") * 10 + 4).alias("key_b"))
    return editing.swapped(_list(spark, sf_dir).select("key", "number"), pairs)


@query(f"""WITH {_LIST}, a AS (SELECT key, CAST(c_custkey * 3 AS INT) AS want, number AS before FROM l), o AS (SELECT number, min(key) AS owner FROM l WHERE number IS NOT NULL GROUP BY 1)
SELECT key, CASE WHEN owner IS NULL OR owner = key THEN want ELSE before END AS number, CASE WHEN owner <> key THEN owner END AS clash FROM a LEFT JOIN o ON o.number = want""")
def numbers_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _list(spark, sf_dir)
    return editing.set_numbers(wanted.select("key", "number"), wanted.select("key", (F.col("c_custkey") * 3).cast("int").alias("number")))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 2 = 0 THEN 'old' END AS "group", CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 1 END AS whole_number, CASE WHEN c_custkey % 2 = 0 THEN CAST(1 AS INT) END AS number FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def selection_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line-up's preferences under a run's choices, field by field and as whole entries."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    base = c.filter(k % 2 == 0).select(k.alias("key"), F.lit("old").alias("group"), F.lit(1).alias("number"))
    own = c.filter(k % 3 == 0).select(k.alias("key"), F.lit("own").alias("group"), F.lit(None).cast("int").alias("number"))
    whole = curate.overlaid(base, own, "key", ["group", "number"], by_field=False).withColumnRenamed("number", "whole_number")
    return whole.join(curate.overlaid(base, own, "key", ["group", "number"], by_field=True).select("key", "number"), "key").select("key", "group", "whole_number", "number")
