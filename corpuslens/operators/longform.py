"""Long form (keys, field, text) of a pairs table, and the way back to wide results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ("prompt", "response")


def to_long(
    pairs: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS
) -> DataFrame:
    """One row per text; only keys and texts are carried along."""
    return pairs.select(*keys, *fields).unpivot(list(keys), list(fields), "field", "text")


def widen(scores: DataFrame, keys: list[str], names: dict[tuple[str, str], str]) -> DataFrame:
    """From (keys, field, value columns) to one column per (field, value column) named."""
    return scores.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("field") == field, F.col(value))).alias(name)
            for (field, value), name in names.items()
        ]
    )


def attach(pairs: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs with the score columns beside them."""
    return pairs.join(wide, keys, "left")


def to_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Score columns of a long table to (keys, field, metric, value), NaN turned into null."""
    as_double = [F.nanvl(F.col(m).cast("double"), F.lit(None)).alias(m) for m in metrics]
    return wide.select(*keys, "field", *as_double).unpivot(
        [*keys, "field"], metrics, "metric", "value"
    )
