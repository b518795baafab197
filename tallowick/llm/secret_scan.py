"""Secret scans by character Markov models, in DataFrame functions only.

Fixed patterns find assigned values, access keys and hex runs.  Besides, every run of
``LEAST`` or more characters of keys and identifiers is scored by first-order Markov models, one
of random strings, one of ordinary identifiers, both counted from labelled samples.  There are two
for each class: of the signs without their case, all digits and all separators being one sign each,
and of the shape, the order of capitals, small letters, digits and separators.  A run's score
is the sum of their log-likelihood ratios.  It marks a secret, unless a pattern already covers
part of it, beyond a bound set for each class of lengths by held-out samples: half way between what
a share ``QUANTILE`` of the identifiers stay below and what that share of the random strings
are above, never below the former nor below 0, where both classes are as likely.

Not secrets by rule, whatever their score: runs without a letter (numbers), UUIDs, and base64 that
decodes to printable ASCII, which is text in another dress.

Places come from the pieces between matches: their lengths, summed over a window of
one text's matches of one kind.

Defined results: a null or empty text has no spans; rows are scanned one by one,
whatever their ids; extra columns are ignored; samples without both labels let only
patterns count.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallowick.llm.workspace import keep

# The patterns, the group that must be long enough, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
# What names of things in programs and addresses are made of.
WORDS = (
    "access account action active admin agent alert amount api app archive array asset audit auth backup bank base batch block board body branch browser bucket buffer build button cache call "
    "canvas card cart category center channel chart check class client cloud cluster code color column command comment common config connect console contact content context control convert cookie "
    "count create customer daily data date debug default delete deploy design desk detail device digital direct display document domain download draft driver editor element email employee enable "
    "engine entry error event example export extra factory feature field file filter final first fixed folder format frame free function gallery general global graph group guide handler header health height "
    "history home host image import index info input insert install item java job journal kernel key label language launch layer layout learn level library license limit line link list loader local "
    "manager market memory menu message method mobile model module monitor network number object option order output owner package page panel payment pixel player plugin policy print profile project public query quick"
).split()

SIGNS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0-")}
SHAPES = {"U": 1, "l": 2, "0": 3, "-": 4}
#: of held-out identifiers this share stays unmarked; by length, in classes that begin here
QUANTILE, LENGTHS = 0.998, (16, 20, 26, 34, 48)
UNSEEN = 0.15


def labelled_samples(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 2000, strings: int = 4096) -> DataFrame:
    """``token, secret``: random strings, from digests in several spellings, and identifiers, from words in the ways that names are put together.

    The words are ``WORDS`` and those of at most ``sample_docs`` documents labelled good, of the
    smallest hashes, each once.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    whole = F.concat(F.base64(F.unhex(digest)), F.base64(F.unhex(F.sha2(digest, 256))))
    plain = F.translate(whole, "+/=", "")
    spelt = (digest, F.upper(digest), F.translate(whole, "=", ""), F.translate(whole, "+/=", "-_"), plain, F.lower(plain), F.upper(plain))
    length = lambda i: F.lit(LEAST) + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(33)).cast("int")
    random = spark.range(strings).select(F.explode(F.array(*(F.substring(x, F.lit(1), length(i)) for i, x in enumerate(spelt)))).alias("token"), F.lit(1).alias("secret"))
    good = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(good, "id", "left_semi")
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct().withColumn("round", F.lit(0))
    listed = spark.range(40).select(F.explode(F.array(*(F.lit(w) for w in WORDS))).alias("w"), (F.col("id").cast("int") + 1).alias("round"))
    # Words that fall together make a name, of one to five of them.
    words = found.unionByName(listed).withColumn("hash", F.xxhash64("w", "round"))
    named = words.groupBy("round", F.pmod("hash", F.when(F.col("round") > 0, F.lit(len(WORDS) // 3)).otherwise(F.lit(strings))).alias("at"), F.pmod(F.shiftright("hash", 32), F.when(F.col("round") > 0, F.lit(1)).otherwise(F.lit(8))).alias("part"))
    names = named.agg(F.slice(F.array_sort(F.collect_list(F.struct("hash", "w"))), 1, 5).alias("x")).select(F.transform("x", lambda x: x["w"]).alias("ws"), F.xxhash64("round", "at", "part").alias("h"))
    joined = lambda how, by: F.array_join(F.transform("ws", how), by)
    small, title = lambda x: x, F.initcap
    number, day = F.pmod("h", F.lit(1000)).cast("string"), F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.pmod("h", F.lit(4000)).cast("int")), "yyyy-MM-dd")
    camel = F.concat(F.get("ws", F.lit(0)), F.array_join(F.transform(F.slice("ws", F.lit(2), F.lit(9)), title), ""))
    spellings = (
        joined(small, "_"), joined(small, "-"), camel, joined(title, ""), joined(F.upper, "_"), joined(F.upper, "-"), joined(small, "/"), joined(small, ""), joined(title, "-"),
        F.concat(day, F.lit("-"), joined(small, "-")), F.concat(joined(small, "-"), F.lit("-"), day), F.concat(joined(small, "_"), F.lit("_"), number), F.concat(camel, number), F.concat(joined(title, "/"), F.lit("/"), number), F.concat(joined(small, "-"), F.lit("="), number), F.concat(joined(F.upper, "_"), F.lit("_V"), F.substring(number, 1, 1)),
    )
    ordinary = names.select(F.explode(F.array(*spellings)).alias("token"), F.lit(0).alias("secret"))
    return random.unionByName(ordinary)


def _signs(token: Column) -> Column:
    """A token's signs without case: letters, ``0`` for a digit, ``-`` for all else."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), "[0-9]", "0"), "[^a-z0]", "-")


def _shapes(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "0"), "[^A-Za-z0]", "-"), "[a-z]", "l"), "[A-Z]", "U")


def _pairs(written: Column, codes: dict[str, int]) -> Column:
    """Numbers of the pairs of neighbouring signs, the first one with the beginning."""
    order = "".join(codes)
    number = lambda x: F.position(x, F.lit(order))
    numbers = F.transform(F.filter(F.split(written, ""), lambda x: x != ""), number)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(numbers, F.lit(1), F.size(numbers) - 1)), numbers, lambda a, b: a * (len(codes) + 1) + b)


class Model:
    """Log ratios of pairs of signs and of shapes, and the least score of a secret by length: a few hundred numbers."""

    def __init__(self, samples: DataFrame, quantile: float = QUANTILE):
        rows = samples.filter(F.length("token") >= LEAST).select("token", "secret", (F.pmod(F.xxhash64("token", F.lit(5)), F.lit(4)) == 0).alias("held"))
        each = (_pairs(_signs(F.col("token")), SIGNS), _pairs(_shapes(F.col("token")), SHAPES))
        pairs = F.concat(*(F.transform(x, lambda p: F.struct(F.lit(i).alias("view"), p.alias("pair"))) for i, x in enumerate(each)))
        counted = rows.filter("not held").select("secret", F.explode(pairs).alias("x")).groupBy("secret", "x.view", "x.pair").count().collect()  # pairs of signs, whatever the samples
        self.ratios = [self._ratios([r for r in counted if r["view"] == i], len(codes) + 1) for i, codes in enumerate((SIGNS, SHAPES))]
        self.least: list[float | None] = [None] * len(LENGTHS)
        if all(self.ratios):
            scored = rows.filter("held").select("secret", self._class(F.col("token")).alias("class"), self.score(F.col("token")).alias("score"))
            ends = scored.groupBy("class").agg(*(F.percentile(F.when(F.col("secret") == k, F.col("score")), F.lit(q)).alias(f"end{k}") for k, q in ((0, quantile), (1, 1 - quantile)))).collect()  # a row for each class of lengths
            for r in ends:
                if r["end0"] is not None and r["end1"] is not None:
                    self.least[r["class"]] = max(0.0, r["end0"], (r["end0"] + r["end1"]) / 2)

    @staticmethod
    def _ratios(counted: list, width: int) -> list[float]:
        """For each pair, the log of how much likelier its second sign follows the first in a secret; none without both labels."""
        counts = [[0] * width**2 for _ in range(2)]
        for r in counted:
            counts[r["secret"]][r["pair"]] += r["count"]
        if len({r["secret"] for r in counted}) < 2:
            return []
        total = [[sum(c[a * width : (a + 1) * width]) for a in range(width)] for c in counts]
        # Any sign may follow with a share of UNSEEN, however many samples there are of few words.
        chance = lambda k, p: (1 - UNSEEN) * counts[k][p] / max(1, total[k][p // width]) + UNSEEN / width
        return [math.log(chance(1, p)) - math.log(chance(0, p)) for p in range(width**2)]

    @staticmethod
    def _class(token: Column) -> Column:
        out = F.lit(0)
        for i, n in enumerate(LENGTHS[1:], 1):
            out = F.when(F.length(token) >= n, i).otherwise(out)
        return out

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a token, random string against identifier."""
        total = F.lit(0.0)
        for ratios, written, codes in zip(self.ratios, (_signs(token), _shapes(token)), (SIGNS, SHAPES), strict=True):
            table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
            total = total + F.aggregate(_pairs(written, codes), F.lit(0.0), lambda s, p: s + F.get(table, p))  # noqa: B023
        return total

    def secret(self, token: Column) -> Column:
        """Whether a token is a secret by its score and by none of the rules an ordinary one."""
        if not all(self.ratios):
            return F.lit(False)
        least = F.get(F.array(*(F.lit(x).cast("double") for x in self.least)), self._class(token))
        plain = F.translate(token, "-_", "+/")
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
        text = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1").rlike("^[\\x20-\\x7E]+$")
        uuid = token.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
        return F.coalesce(token.rlike("[A-Za-z]") & ~uuid & ~F.coalesce(text, F.lit(False)) & (self.score(token) > least), F.lit(False))


def _matches(text: Column, kind: int, pattern: str, ok) -> Column:
    """A struct for each match: kind, number, length of the piece before it, own length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    numbered = F.zip_with(F.split(text, pattern, -1), ok(text, found), lambda gap, x: F.struct(F.length(gap).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("size"), x["ok"].alias("ok")))
    rows = F.transform(F.slice(numbered, F.lit(1), F.size(found)), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")))
    some = F.exists(rows, lambda x: x["ok"])
    none = F.filter(rows, lambda x: F.lit(False))
    return F.when(text.rlike(pattern), F.when(some, rows).otherwise(none)).otherwise(F.array().cast("array<struct<kind:int,number:int,gap:bigint,size:bigint,ok:boolean>>"))


def scan(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", quantile: float = QUANTILE) -> DataFrame:
    """``row, id`` and ``spans``, an ordered array of ``(start, kind, stop)`` in code points; kind counts as in ``KINDS``, then the models'."""
    model = Model(samples, quantile)
    text = F.coalesce(F.col("text"), F.lit(""))
    groups = lambda pattern, group, least: lambda t, found: F.zip_with(found, F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda m, g: F.struct(m.alias("match"), (F.length(g) >= least).alias("ok")))
    scored = lambda t, found: F.transform(found, lambda m: F.struct(m.alias("match"), model.secret(m).alias("ok")))
    each = [_matches(text, k, p, groups(p, g, n)) for k, (_, p, g, n) in enumerate(KINDS)]
    each.append(_matches(text, len(KINDS), CANDIDATE, scored))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.concat(*each).alias("found")), "secrets")
    match = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    order = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    placed = match.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(order)).filter("ok").select("row", F.struct((F.col("stop") - F.col("size")).alias("start"), "kind", "stop").alias("span"))
    spans = placed.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("all"))
    base = F.filter("all", lambda x: x["kind"] < len(KINDS))
    clear = F.filter("all", lambda x: (x["kind"] < len(KINDS)) | ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return found.select("row", "id").join(spans.select("row", clear.alias("spans")), "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*(k for k, *_ in KINDS), "markov")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")
