"""Compound sentiment from a lexicon, with boosters and negations before the word.

The idea of boosters, negation and the normalising constant follows Hutto and Gilbert (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.functions.text import tokens
from corpuslens.functions.words import one_of
from corpuslens.operators.longform import FIELDS, attach, to_long, widen
from corpuslens.plans.lookups import fits_broadcast, known_words, lookup_join

# Fixed values of the rule.
BOOST_BY_DISTANCE = {1: 1.0, 2: 0.95, 3: 0.9}
NEGATION_FACTOR = -0.74
NORMALISER = 15.0


def score_sentiment(long: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """(keys, field, sentiment) from texts and a lexicon (token, weight, boost, negates).

    Each word carries its three predecessors out of the token array, so no window over the
    corpus is needed. Only words of the lexicon leave the array; the lexicon is broadcast, and
    the words of a text collapse to one partial sum before the only shuffle.
    """
    group = [*keys, "field", "has_text"]
    found = tokens(F.col("text"))
    split = long.select(*keys, "field", F.col("text").isNotNull().alias("has_text"), found.alias("t"))
    broadcast = fits_broadcast(lexicon)
    weights = lexicon.where("weight is not null").select("token", "weight")
    weighted = one_of("t[i]", known_words(weights, "token"))
    places = F.expr(f"CASE WHEN size(t) > 0 THEN filter(sequence(0, size(t) - 1), i -> {weighted}) END")
    word = F.transform(
        "places",
        lambda i: F.struct(
            F.get("t", i).alias("token"),
            *[F.get("t", i - d).alias(f"before{d}") for d in BOOST_BY_DISTANCE],
        ),
    )
    words = (
        split.select(*group, "t", places.alias("places"))
        .select(*group, F.explode_outer(word).alias("word"))
        .select(*group, "word.*")
    )

    modifiers = lexicon.where("boost <> 0 or negates").select("token", "boost", "negates")
    scored = lookup_join(words, weights, ["token"], "left", group, broadcast)
    for d in BOOST_BY_DISTANCE:
        # Words without a weight get a null key here and find nothing.
        near = modifiers.toDF(f"before{d}", f"boost{d}", f"negates{d}")
        scored = scored.withColumn(
            f"before{d}", F.when(F.col("weight").isNotNull(), F.col(f"before{d}"))
        )
        scored = lookup_join(scored, near, [f"before{d}"], "left", group, broadcast)

    boost = sum(
        F.coalesce(F.col(f"boost{d}"), F.lit(0.0)) * factor
        for d, factor in BOOST_BY_DISTANCE.items()
    )
    negated = F.coalesce(
        F.greatest(*[F.col(f"negates{d}") for d in BOOST_BY_DISTANCE]), F.lit(False)
    )
    value = (F.col("weight") + F.when(F.col("weight") > 0, boost).otherwise(-boost)) * F.when(
        negated, NEGATION_FACTOR
    ).otherwise(1.0)
    total = F.coalesce(F.col("total"), F.lit(0.0))
    return (
        scored.groupBy(*group)
        .agg(F.sum(value).alias("total"))
        .select(
            *keys,
            "field",
            F.when(F.col("has_text"), total / F.sqrt(total * total + NORMALISER)).alias("sentiment"),
        )
    )


def analyze_sentiment(pairs: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """Pairs plus ``prompt_sentiment`` and ``response_sentiment``."""
    scores = score_sentiment(to_long(pairs, keys), keys, lexicon)
    names = {(f, "sentiment"): f"{f}_sentiment" for f in FIELDS}
    return attach(pairs, widen(scores, keys, names), keys)
