"""Exact quantiles of large groups by repeated counting, without gathering a share of a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.plans.lookups import fits_broadcast, lookup_join
from corpuslens.plans.session import materialize
from corpuslens.plans.storage import release

ACCURACY = 10_000
#: Splitters of a sketch, evenly spaced over the ranks it has seen.
SPLITTERS = 200
#: Distinct values strictly within a bracket that are ranked at last.
FEW = 20_000
#: Every round leaves less than a fiftieth of the rows within a bracket, so this is never reached.
MOST_ROUNDS = 12


def splitters(value: Column) -> Column:
    """Values from the least to the largest, each within 1 / ACCURACY of its rank."""
    steps = [i / SPLITTERS for i in range(SPLITTERS + 1)]
    return F.percentile_approx(value, steps, ACCURACY)


def nearest_splitters(rank: Column, before: Column, n: Column) -> tuple[Column, Column]:
    """Places of two splitters of ``n`` rows that surely enclose a rank, of which ``before`` rows come before."""
    share = (rank - before) / F.greatest(n, F.lit(1))
    margin = 2.0 / ACCURACY
    low = F.floor((share - margin) * SPLITTERS).cast("int")
    high = F.ceil((share + 1 / F.greatest(n, F.lit(1)) + margin) * SPLITTERS).cast("int")
    return F.greatest(low, F.lit(0)), F.least(high, F.lit(SPLITTERS))


def first_brackets(present: DataFrame, by: list[str], probabilities: list[float], few: int) -> DataFrame:
    """(by, probability, place, n, low, high): for each quantile two values that enclose its ranks.

    A small group is taken whole.
    """
    sketch = present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), splitters(F.col("value")).alias("s"))
    asked = sketch.withColumn("probability", F.explode(F.array(*[F.lit(p) for p in probabilities])))
    asked = asked.withColumn("place", F.col("probability") * (F.col("n") - 1))
    first, last = nearest_splitters(F.floor("place"), F.lit(0), F.col("n"))
    whole = F.col("n") <= few
    return asked.select(
        *by,
        "probability",
        "place",
        "n",
        F.get("s", F.when(whole, 0).otherwise(first)).alias("low"),
        F.get("s", F.when(whole, SPLITTERS).otherwise(last)).alias("high"),
    )


def counted(present: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """The brackets with how many rows lie below, at the lower end and within, and splitters of those within.

    One pass: every row meets the few brackets of its group, and a task sends a row per bracket.
    """
    value, low, high = (F.col(c) for c in ("value", "low", "high"))
    within = (value > low) & (value < high)
    group = [*by, "probability", "place", "n", "low", "high"]
    return (
        lookup_join(present, brackets, by, salt_by=["value"], broadcast=fits_broadcast(brackets))
        .groupBy(*group)
        .agg(
            F.count_if(value < low).alias("below"),
            F.count_if(value == low).alias("at_low"),
            F.count_if(within).alias("inner"),
            splitters(F.when(within, value)).alias("s"),
        )
    )


def narrowed(counts: DataFrame, by: list[str], few: int) -> DataFrame:
    """Brackets of fewer rows; those that are narrow enough stay.

    A rank that falls on the rows at one end makes that end the whole bracket, or one side of it.
    """
    before = F.col("below") + F.col("at_low")
    lower, upper = F.floor("place"), F.ceil("place")
    first, last = nearest_splitters(lower, before, F.col("inner"))
    at_end = before + F.col("inner")
    low = (
        F.when(F.col("inner") <= few, F.col("low"))
        .when(lower < before, F.col("low"))
        .when(lower >= at_end, F.col("high"))
        .otherwise(F.get("s", first))
    )
    high = (
        F.when(F.col("inner") <= few, F.col("high"))
        .when(upper < before, F.col("low"))
        .when(upper >= at_end, F.col("high"))
        .when(lower < before, F.get("s", F.lit(0)))
        .otherwise(F.get("s", last))
    )
    low = F.when((lower < at_end) & (upper >= at_end) & (F.col("inner") > few), F.get("s", F.lit(SPLITTERS))).otherwise(low)
    return counts.select(*by, "probability", "place", "n", low.alias("low"), high.alias("high"))


def exact_brackets(present: DataFrame, by: list[str], probabilities: list[float], few: int = FEW) -> DataFrame:
    """(by, probability, place, n, low, high), stored: no bracket has more than ``few`` rows strictly within."""
    brackets = materialize(first_brackets(present, by, probabilities, few))
    for _ in range(MOST_ROUNDS):
        if not brackets.where(F.col("n") * (4 / ACCURACY + 3 / SPLITTERS) > few).take(1):
            break
        counts = materialize(counted(present, brackets, by))
        wide = counts.where(F.col("inner") > few).take(1)
        if wide:
            older, brackets = brackets, materialize(narrowed(counts, by, few))
            release(older)
        release(counts)
        if not wide:
            break
    return brackets


def last_rows(present: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """(by, probability, place, value, count): the distinct values of each bracket, and one row for all below.

    The row for what lies below has no value and ranks first; what lies above is dropped where it is read.
    """
    inside = F.col("value") >= F.col("low")
    return (
        lookup_join(present, brackets.drop("n"), by, salt_by=["value"], broadcast=fits_broadcast(brackets))
        .where(F.col("value") <= F.col("high"))
        .groupBy(*by, "probability", "place", F.when(inside, F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def exact_quantiles(values: DataFrame, by: list[str], probabilities: list[float], few: int = FEW) -> DataFrame:
    """(by, probability, quantile) with linear interpolation between neighbouring ranks.

    A bracket around each rank sought is narrowed, round by round: the rows below it are only counted, and
    splitters of those within give the next, narrower one. Once no bracket holds more than ``few`` rows
    strictly between its ends, the values within are summed up and ranked; so the ranking sees a fixed number
    of rows per quantile, however many rows there are and however often a value repeats.
    """
    present = values.where(F.col("value").isNotNull())
    brackets = exact_brackets(present, by, probabilities, few)
    group = [*by, "probability", "place"]
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_first("value"))
    upto = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = last_rows(present, brackets, by).withColumn("upto", upto)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    neighbours = ranked.groupBy(*group).agg(at(F.floor("place")).alias("lower"), at(F.ceil("place")).alias("upper"))
    part = F.col("place") - F.floor("place")
    return neighbours.select(
        *by, "probability", (F.col("lower") + (F.col("upper") - F.col("lower")) * part).alias("quantile")
    )
