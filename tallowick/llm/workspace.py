"""Tables kept between the jobs of one operator, and the size of what tasks hand to Python."""

from pyspark.sql import SparkSession

from tallowick.storage import keep, new_path, remove, shared_dir

__all__ = ["keep", "new_path", "remove", "shared_dir", "small_batches"]

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "4m") -> SparkSession:
    """Let Arrow batches hold ``most`` bytes of texts instead of ten thousand rows, unless the session says otherwise.

    A batch stands in memory several times, in the executor and in its Python worker.
    """
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64m"):
        spark.conf.set(_BATCH, most)
    return spark
