"""Scores so far and running summaries, with Structured Streaming.

Queries run to the end of what has arrived and stop (``availableNow``); start them again with
the same checkpoint folder and they go on with the new files only. Micro-batches are bounded by
files or bytes. Rows that are sent again are dropped by their keys, which a state store keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuslens.operators.entities import shape_entities
from corpuslens.operators.longform import FIELDS, to_long
from corpuslens.operators.patterns import label
from corpuslens.operators.readability import METRICS, statistics, text_counts
from corpuslens.operators.summary import score_summary

BYTES_PER_BATCH = 1 << 30


def read_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> DataFrame:
    """New parquet files under a folder or glob, so many files or about so many bytes at a time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).parquet(path)


def once(rows: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The rows, each key's first one only, over all micro-batches and restarts.

    The state holds every key seen, without its texts. Where rows have a time of arrival, name it:
    keys are then forgotten after ``delay``, and only rows sent again sooner are recognised.
    """
    if time:
        return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def pairs_to_long(pairs: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Prompts and responses of a stream of pairs, in long form; a pair sent again counts once."""
    return to_long(once(pairs.select(*keys, *fields), keys), keys, fields)


def stateless_scores(long: DataFrame, keys: list[str], common: DataFrame | list[str]) -> DataFrame:
    """(keys, field, pattern, n_entities, sixteen statistics): needs no state, so it appends."""
    marked = long.select(
        *keys,
        "field",
        "text",
        label(F.col("text")).alias("pattern"),
        F.size(shape_entities(F.col("text"))).alias("n_entities"),
    )
    keep = [*keys, "field", "pattern", "n_entities"]
    return statistics(text_counts(marked, keep, common), keep)


def append_scores(scores: DataFrame, out: str, checkpoint: str):
    """Write the scores of the new rows as parquet files."""
    return (
        scores.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def running_summary(
    scores: DataFrame, keys: list[str], out: str, checkpoint: str, metrics: list[str] = METRICS
):
    """Write, for every micro-batch, the summaries that it changed.

    The state is one row per field and metric, whatever the number of rows. A batch has its own folder
    and replaces it, so writing a batch twice does no harm. ``latest_summary`` reads them together.
    """
    named = [f"`{m}`" for m in metrics]
    values = scores.select(*keys, "field", *named).unpivot([*keys, "field"], named, "metric", "value")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        score_summary(values)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_summary(spark: SparkSession, out: str) -> DataFrame:
    """Each field's and metric's summary as it was written last."""
    summaries = spark.read.parquet(out)
    newest = Window.partitionBy("field", "metric").orderBy(F.desc("batch"))
    ranked = summaries.withColumn("newest", F.row_number().over(newest))
    return ranked.where(F.col("newest") == 1).drop("batch", "newest")


def score_batches(
    long: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
):
    """Run a batch scorer on every micro-batch.

    Scorers that add up the words of a text need no state across batches, because a text is
    complete in its batch. A batch has its own folder and replaces it if it is run again. Give scorers
    that were prepared before (``prepare_toxicity`` and its like), so that no batch reads their tables anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        long.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
