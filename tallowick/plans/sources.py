"""Registered queries of sources and sinks: files are made of the tables, written, and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowick.functions.titles import Titles
from tallowick.operators.order import placed
from tallowick.plans.registry import pick, query, read, sql_pick
from tallowick.plans.served import driver_host, serving, written_file
from tallowick.sources import api, files, guide, load, playlist, remote, saved, wantlist
from tallowick.storage import keep, new_path

# What stands before the title of the n-th kind of playlist entry, and what after it; @ is the part's number.
_HEADS = ('#EXTINF:-1 tvg-id="id.@" tvg-logo=\'l.png\' group-title="G T",', "#EXTINF:-1 TVG-ID = \"sp.@\" group-title=News,", '#EXTINF:-1 tvg-name="T@ @",', "#EXTINF:0,", "", '#EXTINF:-1 tvg-name="a,b",', '#EXTINF:-1 group-title="X",', "#EXTINF:-1,")
_TAILS = ("\nhttp://h/@", "\nhttp://h/@", "\nhttp://h/@", "\n#EXTVLCOPT:x=1\n#EXTGRP: Grp \nhttp://h/@", "http://h/@", "\nhttp://h/@", "\nhttp://h/<@>\nhttp://h/after/@", "\n/srv/@.ts")
_TITLED = (0, 1, 3, 5, 6, 7)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when((k % 8).isin(*_TITLED), F.col("p_name")).otherwise("")
    text = F.concat(pick(_HEADS, k), title, pick(_TAILS, k))
    return read(spark, sf_dir, "part").select(F.replace(text, F.lit("@"), k.cast("string")).alias("value"))


@query(f"""WITH e AS (SELECT p_partkey AS n, p_partkey % 8 AS k, p_name, replace({sql_pick(("http://h/@", "http://h/@", "http://h/@", "http://h/@", "http://h/@", "http://h/@", "http://h/after/@", "/srv/@.ts"), "p_partkey")}, '@', CAST(p_partkey AS VARCHAR)) AS url FROM part)
SELECT 'm3u:' || sha1(url)[:16] AS id, CASE k WHEN 2 THEN 'T' || n || ' ' || n WHEN 4 THEN url WHEN 5 THEN 'b",' || p_name WHEN 6 THEN url ELSE p_name END AS name, url,
CASE k WHEN 0 THEN 'G T' WHEN 1 THEN 'News' WHEN 3 THEN 'Grp' ELSE '' END AS "group", CASE k WHEN 0 THEN 'l.png' ELSE '' END AS logo, CASE k WHEN 0 THEN 'id.' || n WHEN 1 THEN 'sp.' || n ELSE '' END AS tvg_id FROM e""")
def playlist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists with every kind of entry, packed, loaded by their address."""
    path = new_path(spark, "playlists")
    _entries(spark, sf_dir).write.option("compression", "gzip").text(path)
    return load.load(spark, path).select("id", "name", "url", "group", "logo", "tvg_id")


@query("""SELECT p_partkey AS pos, '#EXTINF:-1 tvg-id="' || CASE WHEN p_partkey % 3 = 0 THEN 'tallowick.' || lower(replace(p_name, ' ', '')) ELSE 'g' || p_partkey END || '"' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' tvg-chno="' || p_size || '"' END
|| ' group-title="' || CASE WHEN p_partkey % 5 = 0 THEN 'Uncategorised' ELSE p_type END || '",' || p_name || chr(10) || 'http://h/' || p_partkey AS value FROM part UNION ALL SELECT -1, '#EXTM3U'""")
def playlist_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(k.alias("src_pos"), Titles().key_column("p_name").alias("key"), F.col("p_name").alias("name"), F.concat(F.lit("http://h/"), k).alias("url"), F.when(k % 5 != 0, F.col("p_type")).alias("group"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("g"), k)).alias("tvg_id"), F.when(k % 4 != 0, F.col("p_size")).alias("number"))
    return playlist.written(playlist.with_defaults(rows))


@query("SELECT 'xtream:' || c_custkey AS id, coalesce(c_name, '') AS name, 'http://h:80/u/p/' || c_custkey || '.ts' AS url, coalesce(n_name, '') AS \"group\" FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey")
def panel_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = read(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").selectExpr("n_nationkey as category_id", "n_name as category_name")
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey as stream_id", "c_name as name", "cast(c_nationkey as string) as category_id", "cast(null as string) as stream_icon", "cast(null as string) as epg_channel_id")
    return remote.panel_streams(categories, rows, "http://h:80", "u", "p").select("id", "name", "url", "group")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages of a hundred rows, some of them objects with a link to the next, some bare lists."""
    path = new_path(spark, "pages")
    rows = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).alias("page"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("x"))
    pages = rows.groupBy("page").agg(F.to_json(F.sort_array(F.collect_list("x"))).alias("list"))
    value = F.when(F.col("page") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"next": "u", "results": '), "list", F.lit("}")))
    pages.select(value.alias("value"), "page").write.partitionBy("page").text(path)
    return remote.read_pages(spark, path, "id:long,name:string")


@query("SELECT c_custkey AS id, c_name AS name, how FROM customer, (VALUES ('counted'), ('linked')) v(how)")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing fetched page by page over HTTP: dealt out by its count, and followed from page to page; every fifth page fails once."""
    path, failed = new_path(spark, "listing"), set()
    customers = read(spark, sf_dir, "customer")
    count = customers.count()
    pages = placed(customers, "c_custkey").withColumn("page", F.floor((F.col("place") - 1) / 100) + 1).groupBy("page").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))).alias("value"))
    # Pages lie in files of fifty, as a folder for each takes longer to write and read than its rows.
    pages.select(F.floor(F.col("page") / 50).alias("block"), F.concat(F.col("page").cast("string"), F.lit("\t"), "value").alias("value")).repartition("block").write.partitionBy("block").text(path)

    @lru_cache(maxsize=128)
    def block(number: int) -> dict[int, bytes]:
        lines = (line.split(b"\t", 1) for line in written_file(spark, f"{path}/block={number}").splitlines())
        return {int(page): value for page, value in lines}

    def answer(asked: dict[str, str]) -> bytes | None:
        page = int(asked["page"])
        if page % 5 == 0 and (asked["how"], page) not in failed:
            failed.add((asked["how"], page))
            return None
        body = block(page // 50).get(page, b"[]")
        total = b'"count": %d, ' % count if asked["how"] == "counted" else b""
        return b"{" + total + b'"next": ' + (b'"more"' if page * 100 < count else b"null") + b', "results": ' + body + b"}"

    with serving(answer, driver_host(spark)) as url:
        reader = api.register(spark).read.format("tallowick_pages").schema("id long, name string").option("pageSize", 100).option("pause", 0.05)
        both = [reader.option("url", f"{url}?how={how}").load().withColumn("how", F.lit(how)) for how in ("counted", "linked")]
        return keep(both[0].unionByName(both[1]), "fetched")


_ACCOUNTS = "SELECT range AS id, CASE range % 3 WHEN 0 THEN false WHEN 1 THEN true END AS is_active FROM range(1, 7)"


@query(f"WITH a AS ({_ACCOUNTS}) SELECT o_orderkey AS id FROM orders LEFT JOIN a ON o_custkey % 10 = a.id WHERE o_custkey % 10 = 0 OR coalesce(is_active, true)")
def active_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "nullif(o_custkey % 10, 0) as m3u_account")
    accounts = spark.range(1, 7).selectExpr("id", "case id % 3 when 0 then false when 1 then true end as is_active")
    return remote.active_streams(rows, accounts).select("id")


@query("""SELECT c_custkey AS id, c_name AS name, coalesce(n_name, '') AS "group" FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey""")
def lineup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").selectExpr("n_nationkey as id", "n_name as name")
    channels = read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name", "c_nationkey as channel_group_id")
    return remote.lineup(channels, groups).select("id", "name", "group")


@query("""SELECT 's' || s_suppkey AS id, s_name AS name, 'http://h/' || s_suppkey AS url, CAST(0 AS INT) AS src_part FROM supplier
UNION ALL SELECT 'proxy:' || 'u' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'u' || c_custkey ELSE c_name END || ' (via proxy)', 'http://r/proxy/ts/stream/u' || c_custkey, 1 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0""")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = [F.lit("").alias(c) for c in ("group", "logo", "tvg_id")]
    own = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("http://h/"), "s_suppkey").alias("url"), *blank, F.lit("remote").alias("source"))
    k = F.col("c_custkey")
    channels = read(spark, sf_dir, "customer").select(F.when(k % 5 != 0, F.col("c_name")).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("u"), k)).alias("uuid"), F.when(k % 4 != 0, F.array(k)).otherwise(F.array().cast("array<long>")).alias("streams"), F.lit(None).cast("string").alias("logo_url"), F.lit(None).cast("string").alias("tvg_id"))
    return remote.union(own, remote.proxy_streams(channels, "http://r")).select("id", "name", "url", "src_part")


@query("""SELECT 'c' || n_nationkey AS guide_id, CASE WHEN n_nationkey % 2 = 0 THEN [n_name || ' & Co', 'Alt <' || n_nationkey || '>'] ELSE [n_name || ' & Co'] END AS names, CAST(n AS BIGINT) AS programmes, first_start FROM nation
JOIN (SELECT user_id % 25 AS u, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_start FROM events GROUP BY 1) ON u = n_nationkey""")
def guide_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guide written as XML, packed under a name that doesn't say so, and read back; some channels are listed twice."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    heads = n.select(F.concat(F.lit("c"), k).alias("guide_id"), F.concat("n_name", F.lit(" & Co")).alias("name"), k.cast("long").alias("chan_pos"))
    again = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("c"), k).alias("guide_id"), F.concat(F.lit("Alt <"), k, F.lit(">")).alias("name"), (k + 100).cast("long").alias("chan_pos"))
    shows = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id") % 25).alias("guide_id"), F.col("ts").alias("start"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("stop"), F.col("event_type").alias("title"), F.col("event_id").alias("prog_pos"))
    path = files.one_file(guide.written(heads.unionByName(again), shows).select("value"), new_path(spark, "guide") + "/all.xml", "gzip")
    rows = keep(guide.scan(spark, path), "guide-rows")
    channels = guide.joined_names(guide.channels(rows))
    programmes = guide.programmes(rows).groupBy("guide_id").agg(F.count("*").alias("programmes"), F.date_format(F.min("start"), "yyyy-MM-dd HH:mm:ss").alias("first_start"))
    return channels.join(programmes, "guide_id").select("guide_id", "names", "programmes", "first_start")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 100 = 1")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, some of them torn, with more lines appended later."""
    path, e = new_path(spark, "log"), read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value")).write.text(path)
    wantlist.append_log(e.filter("event_id % 100 = 1"), path)
    return wantlist.read_log(spark, path, "event_id long, event_type string, value double")


# The lines of a wanted list: a header before every seventh entry, an empty header before every third of these.
_LIST_SQL = """e AS (SELECT p_size AS list, p_partkey AS n, p_name, CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 21 = 0 THEN '' ELSE 'G' || (p_partkey % 4) END END AS head FROM part),
g AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY list ORDER BY n ROWS UNBOUNDED PRECEDING) AS grp, CASE WHEN n % 11 = 0 THEN '' ELSE upper(replace(p_name, ' ', '')) END AS key FROM e)"""


def _list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    head = F.when(k % 7 == 0, F.concat(F.lit("["), F.when(k % 21 == 0, "").otherwise(F.concat(F.lit("G"), k % 4)), F.lit("]")))
    number = pick(("", "", "7: ", " 12345) ", "88 - "), k)
    entry = F.when(k % 11 == 0, "  !? # nothing").otherwise(F.concat(number, "p_name", pick(("", " | id.x # note", " |", "  # text | no id"), k)))
    return read(spark, sf_dir, "part").select(F.col("p_size").alias("list"), F.explode(F.array_compact(F.array(F.when(head.isNotNull(), F.struct((k * 2).alias("line_no"), head.alias("value"))), F.struct((k * 2 + 1).alias("line_no"), entry.alias("value"))))).alias("x")).select("list", "x.*")


@query(f"""WITH {_LIST_SQL}, f AS (SELECT *, min(n) OVER (PARTITION BY list, key) AS first_n FROM g)
SELECT list, n * 2 + 1 AS line_no, CASE WHEN n % 11 = 0 THEN NULL ELSE CAST(CASE n % 5 WHEN 2 THEN 7 WHEN 3 THEN 12345 WHEN 4 THEN 88 END AS INT) END AS number, nullif(grp, '') AS "group", CASE WHEN n % 11 = 0 THEN '' WHEN n % 4 = 1 THEN 'id.x' ELSE '' END AS tvg_id, key,
CASE WHEN key = '' THEN 'no name' WHEN first_n < n THEN 'duplicate' END AS problem FROM f""")
def wantlist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many wanted lists with comments, headers, numbers, ids, repeated and nameless entries."""
    return wantlist.parse(_list_lines(spark, sf_dir), Titles(), file="list").select("list", "line_no", "number", "group", "tvg_id", "key", "problem")


@query(f"""WITH {_LIST_SQL}, l AS (SELECT *, lag(nullif(grp, '')) OVER w AS prev, row_number() OVER w AS i, nullif(grp, '') AS g FROM g WHERE n % 11 <> 0 WINDOW w AS (PARTITION BY list ORDER BY n))
SELECT list, n * 2 + 1 AS line_no, CASE WHEN g IS DISTINCT FROM prev THEN CASE WHEN i > 1 THEN chr(10) ELSE '' END || '[' || coalesce(g, '') || ']' || chr(10) ELSE '' END
|| CASE n % 5 WHEN 2 THEN '7: ' WHEN 3 THEN '12345: ' WHEN 4 THEN '88: ' ELSE '' END || p_name || CASE WHEN n % 4 = 1 THEN ' | id.x' ELSE '' END AS value FROM l""")
def wantlist_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = wantlist.parse(_list_lines(spark, sf_dir), Titles(), file="list")
    return wantlist.rendered(entries.filter("key <> ''"), file="list")


@query("""WITH x AS (SELECT p_size, p_type AS grp, p_name, p_partkey, upper(replace(p_name, ' ', '')) AS key, row_number() OVER (PARTITION BY p_size, upper(replace(p_name, ' ', '')) ORDER BY p_type, p_partkey) AS i FROM part)
SELECT grp AS "group", key, CAST(p_partkey AS DOUBLE) AS number FROM x WHERE i = 1""")
def lineup_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-ups as JSON files; a name in two categories counts once, the first time."""
    path = new_path(spark, "lineups")
    groups = read(spark, sf_dir, "part").groupBy("p_size", "p_type").agg(F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("number"), F.col("p_name").alias("name")))).alias("list"))
    files = groups.groupBy("p_size").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p_type", "list")))).alias("categories"))
    files.select("p_size", F.to_json(F.struct("categories")).alias("value")).write.partitionBy("p_size").text(path)
    return wantlist.reference_lineup(spark, path, Titles()).select("group", "key", "number")


@query("SELECT 'run-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS run, n_name AS name, n_nationkey % 3 <> 0 AS finished FROM nation")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("run-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("name"), F.to_json(F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("finished"))).alias("value"))
    return saved.runs(spark, files.named_files(rows, new_path(spark, "runs"), "@/run.json"), "name string, finished boolean")


@query(f"WITH {_LIST_SQL} SELECT 'list-' || list || '.txt' AS name, count(*) AS lines FROM g GROUP BY list")
def saved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted lists saved as a file each, and how many entries each has, headers and comments apart."""
    rows = _list_lines(spark, sf_dir).select(F.col("list").cast("string").alias("name"), "line_no", "value")
    return saved.lists(spark, files.named_files(rows, new_path(spark, "lists"), "list-@.txt"))


@query("SELECT r_regionkey, CAST(r AS INT) AS reader, r_name || '!' AS r_name FROM region, range(1, 5) t(r)")
def guide_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readers at once of a table that is out of date: one fetches it, and a fetch that fails or brings nothing leaves it as it is."""
    r, made = read(spark, sf_dir, "region"), []
    kept = saved.Snapshots(spark, new_path(spark, "guides"))

    def fetched() -> DataFrame:
        made.append(1)
        return r.select("r_regionkey", F.concat("r_name", F.lit("!")).alias("r_name"))

    def fails() -> DataFrame:
        raise OSError("no answer")

    with ThreadPoolExecutor(4) as readers:
        list(readers.map(lambda i: kept.read("http://h/guide", 60, fetched).count(), range(4)))
    if len(made) != 1:
        raise AssertionError(f"fetched {len(made)} times")
    kept.read("http://h/guide", 0, fails, now=4e9)
    rows = kept.read("http://h/guide", 0, lambda: r.limit(0).select("r_regionkey", "r_name"), good=lambda x: not x.isEmpty(), now=4e9)
    return rows.select("r_regionkey", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("reader"), "r_name")


@query("SELECT r_regionkey, r_name || '!' AS r_name FROM region")
def kept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept table is read while it is fresh and made again, whole, when it is not."""
    path, r = new_path(spark, "kept"), read(spark, sf_dir, "region")
    first = saved.kept_for(spark, path, 1800, lambda: r).count()
    fresh = saved.kept_for(spark, path, 1800, lambda: r.limit(0)).count()
    if first != fresh:
        raise AssertionError("a fresh table was made again")
    return saved.kept_for(spark, path, 0, lambda: r.select("r_regionkey", F.concat("r_name", F.lit("!")).alias("r_name")), now=4e9)
