"""Closest topic by weighted topic words."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.data.tables import TOPIC_WORDS, small_table
from corpuslens.functions.text import TOKEN, with_term_counts
from corpuslens.operators.longform import FIELDS, attach, to_long, widen
from corpuslens.plans.lookups import Lookup, lookup_join, prepare_lookup

WORD = regex.compile(TOKEN)


def topic_table(spark: SparkSession, names: str | None = None) -> DataFrame:
    """(topic, token, weight) for a comma-separated list of names; blank means the default list.

    A name without words of its own is matched by the words of the name, runs of letters as in texts.
    """
    wanted = [n.strip() for n in (names or "").split(",") if n.strip()] or list(TOPIC_WORDS)
    rows = [
        (topic, token, 1.0)
        for topic in dict.fromkeys(wanted)
        for token in dict.fromkeys([*WORD.findall(topic.lower()), *TOPIC_WORDS.get(topic, [])])
    ]
    return small_table(spark, ["topic", "token", "weight"], rows)


def prepare_topics(topics: DataFrame) -> Lookup:
    """The topic words, stored and measured, for scoring many tables or micro-batches."""
    return prepare_lookup(topics, "token")


def closest_topic(
    long: DataFrame, keys: list[str], topics: DataFrame | Lookup, names: list[str]
) -> DataFrame:
    """(keys, field, topic, score); no topic word in the text gives a null topic.

    One sum per topic name in a single aggregation: the terms of a text collapse to one row
    before the only shuffle, and the best topic is picked inside the row.
    """
    group = [*keys, "field"]
    lookup = prepare_topics(topics)
    counted = with_term_counts(long, group, words=lookup.words)
    terms = (
        counted.select(*group, "norm", F.explode_outer("terms").alias("x"))
        .select(*group, "norm", "x.token", "x.tf")
    )
    hits = lookup_join(terms, lookup.table, ["token"], "left", group, lookup.broadcast)
    sums = hits.groupBy(*group).agg(
        F.max("norm").alias("norm"),
        *[
            F.sum(F.when(F.col("topic") == name, F.col("weight") * F.col("tf"))).alias(f"_{i}")
            for i, name in enumerate(names)
        ],
    )
    candidates = F.array(
        *[
            F.when(
                F.col(f"_{i}").isNotNull(),
                F.struct((-F.col(f"_{i}")).alias("order"), F.lit(name).alias("topic")),
            )
            for i, name in enumerate(names)
        ]
    )
    best = sums.select(*group, "norm", F.array_min(F.array_compact(candidates)).alias("best"))
    return best.select(
        *group, F.col("best.topic").alias("topic"), (-F.col("best.order") / F.col("norm")).alias("score")
    )


def analyze_topics(pairs: DataFrame, keys: list[str], names: str | None = None) -> DataFrame:
    """Pairs plus ``prompt_topics`` and ``response_topics``."""
    table = topic_table(pairs.sparkSession, names)
    listed = [n.strip() for n in (names or "").split(",") if n.strip()] or list(TOPIC_WORDS)
    scores = closest_topic(to_long(pairs, keys), keys, table, list(dict.fromkeys(listed)))
    columns = {(f, "topic"): f"{f}_topics" for f in FIELDS}
    return attach(pairs, widen(scores, keys, columns), keys)
