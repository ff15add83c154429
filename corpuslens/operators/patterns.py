"""Labels and hits of named regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.data.patterns import DIGIT_FREE, NEEDED_TEXT, PATTERN_GROUPS
from corpuslens.functions.text import explode_rows
from corpuslens.operators.longform import FIELDS

Groups = list[tuple[str, str]]
MAX_EXPRESSIONS = 10_000


def read_pattern_groups(spark: SparkSession, path: str) -> Groups:
    """(name, expression) pairs from a JSON array of {name, expressions}, in file order."""
    groups = spark.read.schema("name string, expressions array<string>").json(path, multiLine=True)
    rows = (
        groups.select(F.monotonically_increasing_id().alias("ord"), "*")
        .select("ord", "name", F.posexplode("expressions").alias("pos", "expression"))
        .orderBy("ord", "pos")
        .take(MAX_EXPRESSIONS + 1)
    )
    if len(rows) > MAX_EXPRESSIONS:
        raise ValueError(f"more than {MAX_EXPRESSIONS} expressions in {path}")
    return [(r["name"], r["expression"]) for r in rows]


def _match(text: Column, name: str, expression: str) -> Column:
    """The match, behind a substring test where the group is known to need one."""
    found = text.rlike(expression)
    if (name, expression) in PATTERN_GROUPS and name in NEEDED_TEXT:
        return text.contains(NEEDED_TEXT[name]) & found
    return found


def _without_digit(groups: Groups) -> Groups:
    """The groups that still have to be tried on a text without any digit or plus sign."""
    return [g for g in groups if g not in PATTERN_GROUPS or g[0] in DIGIT_FREE]


def label(text: Column, groups: Groups = PATTERN_GROUPS) -> Column:
    """Name of the first group that matches, else null. Later groups are not tried."""

    def first(tried: Groups) -> Column:
        return F.coalesce(
            F.lit(None).cast("string"), *[F.when(_match(text, n, e), F.lit(n)) for n, e in tried]
        )

    return F.when(text.rlike("[0-9+]"), first(groups)).otherwise(first(_without_digit(groups)))


def label_patterns(
    pairs: DataFrame, groups: Groups = PATTERN_GROUPS, fields: tuple[str, ...] = FIELDS
) -> DataFrame:
    """Pairs plus ``prompt_patterns`` and ``response_patterns``, inside the row."""
    return pairs.withColumns({f"{f}_patterns": label(F.col(f), groups) for f in fields})


def pattern_hits(long: DataFrame, keys: list[str], groups: Groups = PATTERN_GROUPS) -> DataFrame:
    """(keys, field, group) for every group that matches."""
    text = F.col("text")

    def every(tried: Groups) -> Column:
        names = [F.when(_match(text, n, e), F.lit(n)) for n, e in tried]
        return F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *names)))

    matched = F.when(text.rlike("[0-9+]"), every(groups)).otherwise(every(_without_digit(groups)))
    return explode_rows(long, [*keys, "field"], matched, "group")
