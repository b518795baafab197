"""A training corpus from the ``documents`` table, in five stages.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns what it keeps, which is written as Parquet and read as the next stage's
``docs``.  All stages but the last return the columns of ``docs``.  Documents are judged
by row: rows whose id is null or shared are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallowick.llm import cotraining, decontaminate, line_dedup, minhash_dedup, packing, workspace
from tallowick.llm.queries import tokenizer_path

ROW = "_tw_row"


def _rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key of its own for each row that is the same in every read.

    Rows of Parquet files have one already, their file and place in it; other rows are
    written with one first.
    """
    try:
        found = docs.select("*", F.col("_metadata.file_path").alias("_tw_file"), F.col("_metadata.row_index").alias("_tw_index"))
    except AnalysisException:
        return workspace.keep(docs.withColumn(ROW, F.monotonically_increasing_id()), name)
    files = sorted(r[0] for r in found.select("_tw_file").distinct().collect())  # a row for each file
    numbered = docs.sparkSession.createDataFrame(list(enumerate(files)), "_tw_number long, _tw_file string")
    numbered = F.broadcast(numbered) if sum(map(len, files)) <= 8 << 20 else numbered  # else the sizes decide
    key = F.shiftleft("_tw_number", 40) + F.col("_tw_index")
    return found.join(numbered, "_tw_file").select(*docs.columns, key.alias(ROW))


def _without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without those whose key is in ``gone``, and without the key."""
    return rows.join(gone.select(F.col(key).alias("_tw_gone")).distinct(), F.col(ROW) == F.col("_tw_gone"), "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the co-trained classifiers take for bad rather than good."""
    workspace.small_batches(spark)
    rows = _rows(docs, "quality-rows")
    scored = cotraining.score(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=ROW)
    return _without(rows, scored.filter("p_good < 0.5"), "row")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines found in ten documents or more the first stays, the others go; so do documents that are left without a word.

    Keeping the first occurrence keeps one copy of a text of which there are many.
    """
    workspace.small_batches(spark)
    left = line_dedup.dedup_lines(docs, keep_first=True, lines_col="_tw_lines", dropped_col="_tw_lost")
    return left.filter((F.col("_tw_lost") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest id, any id before null."""
    workspace.small_batches(spark)
    rows = _rows(docs, "near-rows")
    verdict = workspace.keep(minhash_dedup.near_duplicates(rows, id_col=ROW).select("id", "component_id"), "near-verdict")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), ROW)
    best = verdict.join(rows.select(ROW, order.alias("order")), F.col("id") == F.col(ROW)).groupBy("component_id").agg(F.min("order").alias("x")).select(F.col(f"x.{ROW}").alias("id"))
    return _without(rows, verdict.select("id").join(best, "id", "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold 75 % or more of the shingles of a benchmark item."""
    workspace.small_batches(spark)
    rows = _rows(docs, "decontamination-rows")
    return _without(rows, decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 1024 tokens."""
    workspace.small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", pack),
]

#: The classifier, the similarity groups and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
