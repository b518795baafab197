"""Wanted lists as text, reference line-ups as JSON, logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallowick.functions.titles import Titles
from tallowick.operators.slices import running


def _entry(text: Column) -> dict[str, Column]:
    """Number, name and guide id of a line: a number of one to five digits with ``:``, ``.``, ``)`` or ``-`` behind it, then the name, then an id without blanks behind a bar."""
    number = F.regexp_extract(text, r"^([0-9]{1,5})\s*[:.)-]", 1)
    rest = F.when(number != "", F.regexp_replace(text, r"^[0-9]{1,5}\s*[:.)-]\s*", "")).otherwise(text)
    bar = F.locate("|", rest)
    name = F.when(bar > 0, F.rtrim(F.substring(rest, F.lit(1), bar - 1))).otherwise(rest)
    tvg = F.when(bar > 0, F.trim(F.substring(rest, bar + 1, F.length(rest)))).otherwise("")
    whole = (name != "") & tvg.rlike(r"^\S*$")
    return {"number": F.when(whole, F.nullif(number, F.lit("")).cast("int")), "name": F.when(whole, name), "tvg_id": F.when(whole, tvg)}


def parse(lines: DataFrame, reader: Titles, line: str = "line_no", text: str = "value", file: str | None = None) -> DataFrame:
    """``line_no, number, name, tvg_id, group, key, problem, first_line`` for each entry.

    ``#`` starts a comment; ``[Group]`` holds until the next one and ``[]`` ends it.  An
    entry whose key an earlier one has is a duplicate; a line that is no entry, or whose
    name has no key, is no name.  With ``file``, a column, every file is a list of its own,
    otherwise the table is one list, of any length: it is worked off in slices.
    """
    keep = [file] if file else []
    rows = lines.select(*keep, F.col(line).alias("line_no"), F.trim(F.substring_index(F.regexp_replace(text, "\ufeff", ""), "#", 1)).alias("t")).filter("t <> ''")
    head = F.regexp_extract("t", r"^\[([^\]]*)\]$", 1)
    is_head = F.col("t").rlike(r"^\[[^\]]*\]$")
    rows = running(rows, keep, ["line_no"], g=("last", F.when(is_head, F.struct(F.nullif(F.trim(head), F.lit("")).alias("name"))))).filter(~is_head)
    named = rows.select(*keep, "line_no", F.col("g.name").alias("group"), *(c.alias(n) for n, c in _entry(F.col("t")).items()))
    keyed = named.withColumn("key", F.when(F.col("name").isNull(), "").otherwise(reader.key_column("name")))
    first = F.first("line_no").over(Window.partitionBy(*keep, "key").orderBy("line_no"))
    return keyed.withColumn("first_line", first).withColumn("problem", F.when(F.col("key") == "", "no name").when(F.col("first_line") < F.col("line_no"), "duplicate"))


def rendered(wanted: DataFrame, file: str | None = None) -> DataFrame:
    """``line_no, value``: a list as text, a header where the group changes, an empty line before it."""
    keep = [file] if file else []
    entry = F.concat(F.coalesce(F.concat(F.col("number").cast("string"), F.lit(": ")), F.lit("")), "name", F.when(F.coalesce("tvg_id", F.lit("")) != "", F.concat(F.lit(" | "), "tvg_id")).otherwise(""))
    rows = running(wanted, keep, ["line_no"], before=("last", F.struct("group")))
    changed = ~F.col("group").eqNullSafe(F.col("before.group"))
    head = F.when(changed, F.concat(F.when(F.col("before").isNotNull(), "\n").otherwise(""), F.lit("["), F.coalesce("group", F.lit("")), F.lit("]\n"))).otherwise("")
    return rows.select(*keep, "line_no", F.concat(head, entry).alias("value")).orderBy(*keep, "line_no")


def reference_lineup(spark: SparkSession, path: str, reader: Titles) -> DataFrame:
    """``file, group, name, number, key`` of files ``{"categories": {group: [{name, number}]}}``; of equal keys in a file the first counts.

    A file without ``categories`` is an error.
    """
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "categories map<string,array<struct<name:string,number:double>>>").alias("j"))
    wrong = rows.filter("j.categories is null").select("file").first()
    if wrong:
        raise ValueError(f"{wrong['file']} holds no line-up: it needs an object 'categories'")
    groups = rows.select("file", F.posexplode(F.map_entries("j.categories")).alias("g_pos", "g")).select("file", "g_pos", F.col("g.key").alias("group"), F.col("g.value").alias("list"))
    # The list is a column of its own, so that the entries' rows leave it behind.
    each = groups.select("file", "g_pos", "group", F.posexplode("list").alias("pos", "x")).select("file", "g_pos", "pos", "group", "x.name", "x.number")
    keyed = each.withColumn("key", reader.key_column("name"))
    first = F.row_number().over(Window.partitionBy("file", "key").orderBy("g_pos", "pos"))
    return keyed.withColumn("_n", first).filter("_n = 1 and key <> ''").drop("_n")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that don't parse, as after a torn write, are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON line for each row, added to the log at ``path``; files appear whole or not at all."""
    rows.write.mode("append").json(path)
