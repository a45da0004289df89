"""Audits over a stream of prediction files.

All per-row operators are stateless, so they run on a stream as they are. Running counts keep a counter per group in the
state store. Reviews with a cache work on one micro-batch at a time: batch k reads the cache that batch k - 1 left and
leaves its own.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secondlook import fixed, schemas
from secondlook.operators.review import BatchReview, Reviewer, review_batch
from secondlook.plans.audit import next_snapshot
from secondlook.session import TEXT_CODEC, StagedFolders, is_written, remove_folder


def read_stream(
    spark: SparkSession, folder: str, schema, name_glob: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def running_verdicts(results: DataFrame) -> DataFrame:
    """Rows per predicted label and verdict so far; the state is one counter per group."""
    return results.groupBy("pred_label", "verdict").agg(F.count("*").alias("n_rows"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now and append it, exactly once, to Parquet files under ``path``."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def review_stream(
    samples: DataFrame,
    review: Callable[[DataFrame], BatchReview],
    path: str,
    checkpoint: str,
) -> None:
    """Review micro-batches of available samples.

    Each batch has its own folder that a repeated batch overwrites, so a restart leaves no duplicates.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        review(batch).results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        samples.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def review_stream_cached(
    samples: DataFrame,
    taxonomy: DataFrame,
    reviewer: Reviewer,
    path: str,
    checkpoint: str,
    now: Callable[[int], float],
    cache: DataFrame | None = None,
    version: str = fixed.PROMPT_VERSION,
    model: str = fixed.DEFAULT_MODEL,
    ttl_seconds: float = fixed.CACHE_TTL_SECONDS,
    **options,
) -> None:
    """Review micro-batches of available samples, each with the answers that earlier ones have stored.

    Under ``path``, batch k leaves ``reviews/batch=k`` (one row per request), ``results/batch=k`` (one per sample) and
    ``cache/batch=k``, the cache for the next batch; ``cache`` is what the first one starts from. ``now(k)`` is the time of a
    batch. A repeated batch finds its reviews if they were written, so nothing is scored twice, and starts again from the
    cache of the batch before it, so no hit counts twice. What a batch has staged, and the cache before the last one, are deleted
    when it is done.
    """
    spark = samples.sparkSession

    def snapshot(batch_id: int) -> DataFrame:
        at = f"{path}/cache/batch={batch_id}"
        if is_written(spark, at):
            return spark.read.schema(schemas.CACHE).parquet(at)
        return spark.createDataFrame([], schemas.CACHE) if cache is None else cache

    def save(batch: DataFrame, batch_id: int) -> None:
        staged, before, at = StagedFolders(spark), snapshot(batch_id - 1), now(batch_id)
        with staged:
            found = review_batch(
                batch, taxonomy, reviewer, before, at, version, model, ttl_seconds,
                reviews_path=f"{path}/reviews/batch={batch_id}", **options,
            )
            found.results.write.mode("overwrite").option("compression", TEXT_CODEC).parquet(f"{path}/results/batch={batch_id}")
            after = next_snapshot(before, found.reviews, at, version, model, ttl_seconds)
            after.write.mode("overwrite").parquet(f"{path}/cache/batch={batch_id}")
        staged.remove()
        remove_folder(spark, f"{path}/cache/batch={batch_id - 2}")

    query = samples.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def count_available(results: DataFrame, path: str, checkpoint: str) -> None:
    """Running verdict counts: after each micro-batch of available results, the groups that it changed, with their counts so far.

    The counts live in the state store under ``checkpoint``; a repeated batch overwrites its own folder ``step=k``.
    """

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/step={batch_id}")

    query = (
        running_verdicts(results)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
