"""Numbers, distributions and frequencies of the results.

Scores come as (keys, field, metric, value), labels as (keys, field, label). Everything is
aggregated in part before it is shuffled. Tables with one row per field and metric are computed
once, measured and then broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuslens.data.tables import small_table
from corpuslens.operators.longform import FIELDS
from corpuslens.plans.lookups import lookup_join
from corpuslens.plans.quantiles import exact_quantiles
from corpuslens.plans.session import materialize

BY = ["field", "metric"]
BINS = 50
QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
GRID = 101


def unwrap(score: Column) -> Column:
    """The first element of a list score; null for an empty list."""
    return F.get(score, F.lit(0))


def score_summary(scores: DataFrame) -> DataFrame:
    """(field, metric, n, max, mean, std) over the non-null values; std is that of a sample."""
    return scores.groupBy(*BY).agg(
        F.count("value").alias("n"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )


def histogram(scores: DataFrame, bins: int = BINS) -> DataFrame:
    """(field, metric, bin, low, high, n): equal widths from the least to the largest value.

    The largest value belongs to the last bin. A constant column has one bin. All metrics are
    counted in one job: a pass for the ranges and a pass for the bins.
    """
    present = scores.where(F.col("value").isNotNull())
    ranges = present.groupBy(*BY).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    place = F.floor((F.col("value") - F.col("least")) / (F.col("most") - F.col("least")) * bins)
    return (
        lookup_join(present, materialize(ranges), BY, salt_by=["value"])
        .withColumn(
            "bin",
            F.when(F.col("most") > F.col("least"), F.least(place + 1, F.lit(bins))).otherwise(1),
        )
        .groupBy(*BY, "bin", "least", "most")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *BY,
            F.col("bin").cast("int").alias("bin"),
            (F.col("least") + (F.col("bin") - 1) * width).alias("low"),
            F.when(F.col("bin") == bins, F.col("most"))
            .otherwise(F.col("least") + F.col("bin") * width)
            .alias("high"),
            "n",
        )
    )


def quartiles(scores: DataFrame) -> DataFrame:
    """(field, metric, least, q1, median, q3, most, lower_fence, upper_fence)."""
    found = exact_quantiles(scores, BY, QUARTILES)
    names = dict(zip(QUARTILES, ["least", "q1", "median", "q3", "most"]))
    wide = found.groupBy(*BY).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
            for p, name in names.items()
        ]
    )
    spread = F.col("q3") - F.col("q1")
    return wide.withColumns(
        {"lower_fence": F.col("q1") - 1.5 * spread, "upper_fence": F.col("q3") + 1.5 * spread}
    )


def density(scores: DataFrame, bins: int = BINS, points: int = GRID) -> DataFrame:
    """(field, metric, point, x, density): a Gaussian kernel over the bins of the histogram.

    The bandwidth is Silverman's rule (1986). A metric with one distinct value has no outline.
    """
    stats = scores.groupBy(*BY).agg(
        F.count("value").alias("total"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    ).where(F.col("most") > F.col("least"))
    shaped = stats.withColumn("width", 1.06 * F.col("std") * F.pow("total", F.lit(-0.2)))
    bars = histogram(scores, bins).select(*BY, ((F.col("low") + F.col("high")) / 2).alias("mid"), "n")
    grid = bars.join(shaped, BY).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    x = F.col("least") + (F.col("most") - F.col("least")) * F.col("point") / (points - 1)
    z = (F.col("x") - F.col("mid")) / F.col("width")
    kernel = F.col("n") * F.exp(-z * z / 2)
    return (
        grid.withColumn("x", x)
        .groupBy(*BY, "point", "x", "total", "width")
        .agg(F.sum(kernel).alias("weight"))
        .select(
            *BY,
            "point",
            "x",
            (
                F.col("weight")
                / (F.col("total") * F.col("width") * F.sqrt(F.lit(2.0) * F.pi()))
            ).alias("density"),
        )
    )


def label_counts(labels: DataFrame, label: str) -> DataFrame:
    """(field, label, n), a null label being a group of its own."""
    return labels.groupBy("field", label).agg(F.count(F.lit(1)).alias("n"))


def _every_field(spark: SparkSession, fields: Sequence[str], found: DataFrame) -> DataFrame:
    """A row for each field, which the caller names, so that no text is read to find them."""
    return small_table(spark, ["field"], [(f,) for f in fields]).join(found, "field", "left")


def top_label(
    labels: DataFrame,
    keys: list[str],
    label: str,
    fields: Sequence[str] = FIELDS,
    missing: str = "None",
) -> DataFrame:
    """(field, label, n): the most frequent non-null label per field, the first seen on a tie.

    Labels are counted first, so the choice is among one row per label.
    """
    counts = (
        labels.where(F.col(label).isNotNull())
        .groupBy("field", label)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys)).alias("first"))
    )
    best = counts.groupBy("field").agg(
        F.min(F.struct((-F.col("n")).alias("order"), "first", label)).alias("best")
    )
    found = best.select("field", F.col(f"best.{label}").alias(label), (-F.col("best.order")).alias("n"))
    return _every_field(labels.sparkSession, fields, found).select(
        "field", F.coalesce(label, F.lit(missing)).alias(label), F.coalesce("n", F.lit(0)).alias("n")
    )


def entity_counts(entities: DataFrame) -> DataFrame:
    """(field, entity, n): occurrences, not texts."""
    return label_counts(entities, "entity")


def entity_counts_filled(entities: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """As ``entity_counts``, with the row ("No Entities", 0) for a field without any."""
    return _every_field(entities.sparkSession, fields, entity_counts(entities)).select(
        "field",
        F.coalesce("entity", F.lit("No Entities")).alias("entity"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def top_entities(
    entities: DataFrame, keys: list[str], fields: Sequence[str] = FIELDS
) -> DataFrame:
    """(field, entities, n): all entities with the highest count, in the order first seen."""
    counts = entities.groupBy("field", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys, "pos")).alias("first")
    )
    # One row per entity and field remains, so the window and the list are short.
    most = counts.withColumn(
        "place", F.rank().over(Window.partitionBy("field").orderBy(F.desc("n")))
    ).where("place = 1")
    listed = most.groupBy("field").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first", "entity"))), lambda x: x["entity"]
            ),
            ", ",
        ).alias("entities"),
        F.max("n").alias("n"),
    )
    return _every_field(entities.sparkSession, fields, listed).select(
        "field",
        F.coalesce("entities", F.lit("None")).alias("entities"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
