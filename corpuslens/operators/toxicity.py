"""Toxicity: words tied to the toxic label, learned from labelled documents, then scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.text import explode_rows, tokens
from corpuslens.functions.words import one_of
from corpuslens.operators.longform import FIELDS, attach, to_long, widen
from corpuslens.plans.lookups import Lookup, lookup_join, prepare_lookup


def learn_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    keys: list[str],
    support: int = 10,
    threshold: float = 3.0,
) -> DataFrame:
    """Lexicon (token, log_odds, prior) from documents (keys, text) and labels (keys, toxic).

    Presence of a token in a document counts once. Counts are summed per token map-side, so a
    word found in every document costs one row per task in the shuffle.
    """
    labelled = documents.join(labels.where("toxic is not null").select(*keys, "toxic"), keys)
    totals = labelled.agg(
        F.struct(
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
            F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("clean"),
        )
    ).scalar()
    counts = (
        explode_rows(labelled, ["toxic"], F.array_distinct(tokens(F.col("text"))), "token")
        .groupBy("token")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
        .where(F.col("t") >= support)
        .withColumn("all", totals)
    )
    log_odds = F.ln((F.col("t") + 1) / (F.col("all.toxic") + 2)) - F.ln(
        (F.col("f") + 1) / (F.col("all.clean") + 2)
    )
    prior = F.ln(F.col("all.toxic") / F.nullif(F.col("all.clean"), F.lit(0)))
    return counts.select(
        "token", log_odds.alias("log_odds"), F.coalesce(prior, F.lit(0.0)).alias("prior")
    ).where(F.col("log_odds") >= threshold)


def prepare_toxicity(lexicon: DataFrame) -> Lookup:
    """The lexicon, stored and measured, for scoring many tables or micro-batches."""
    return prepare_lookup(lexicon, "token")


def score_toxicity(long: DataFrame, keys: list[str], lexicon: DataFrame | Lookup) -> DataFrame:
    """(keys, field, toxicity): logistic of the summed log-odds, 0 where no word is known.

    The lexicon grows with the vocabulary, so it is computed once and measured before a
    broadcast is chosen.
    """
    group = [*keys, "field", "has_text"]
    lookup = prepare_toxicity(lexicon)
    known = one_of("w", lookup.words)
    # Computed before the explode: beside it, the text would be copied along with every token.
    split = long.select(
        *keys, "field", F.col("text").isNotNull().alias("has_text"), tokens(F.col("text")).alias("t")
    )
    words = split.select(
        *group, F.explode_outer(F.expr(f"array_distinct(filter(t, w -> {known}))")).alias("token")
    )
    hits = lookup_join(words, lookup.table, ["token"], "left", group, lookup.broadcast)
    evidence = F.col("evidence") + F.col("prior")
    return (
        hits.groupBy(*group)
        .agg(F.sum("log_odds").alias("evidence"), F.max("prior").alias("prior"))
        .select(
            *keys,
            "field",
            F.when(
                F.col("has_text"), F.coalesce(1 / (1 + F.exp(-evidence)), F.lit(0.0))
            ).alias("toxicity"),
        )
    )


def analyze_toxicity(pairs: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """Pairs plus ``prompt_toxicity`` and ``response_toxicity``."""
    scores = score_toxicity(to_long(pairs, keys), keys, lexicon)
    names = {(f, "toxicity"): f"{f}_toxicity" for f in FIELDS}
    return attach(pairs, widen(scores, keys, names), keys)
