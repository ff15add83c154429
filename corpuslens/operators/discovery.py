"""Topics of a corpus by variational inference over all of its texts and words.

Latent Dirichlet allocation (Blei, Ng and Jordan 2003) as a loop of DataFrame jobs. The vocabulary is a table
with a row per word, so no model passes through the driver and no word is dropped; texts are rows of counts.
Every round visits every text: the shares of a text's topics are set anew from the words' topics, then
the words' topics from the shares of all texts. Both are sums over the same join of counts and words, with
partial sums before each shuffle; the words are broadcast if they were measured to fit. Else the ``COMMON`` words that
stand in most texts are, so that most of the counts are divided and summed where their text is, and only the counts of
the other words are shuffled. The driver sees no word and no share until the leading ones are asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.text import explode_rows, with_term_counts
from corpuslens.plans.lookups import fits_broadcast, lookup_join
from corpuslens.plans.session import materialize
from corpuslens.plans.storage import release, sweep

#: Words that are broadcast if not all of them fit.
COMMON = 100_000
#: Terms of the recurrence that moves the argument to where the series holds.
SHIFT = 6


def digamma(x: Column) -> Column:
    """The derivative of ln Γ for x > 0: the recurrence, then the asymptotic series."""
    y = x + SHIFT
    square = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - square * (1 / 12 - square * (1 / 120 - square / 252))
    return series - reduce(Column.__add__, [1 / (x + i) for i in range(SHIFT)])


@dataclass
class TopicModel:
    """``words`` has (token, weight, common, w0, w1, ..., b0, b1, ...): whether a word is among the common ones, how
    much of each topic it carries, and by which factor a text's share of the topic counts for it."""

    words: DataFrame
    n_topics: int
    share_prior: float
    word_prior: float
    broadcast: bool

    @property
    def names(self) -> list[str]:
        return [f"w{k}" for k in range(self.n_topics)]

    def totals(self) -> list[float]:
        """What all words together carry of each topic."""
        return [total or 0.0 for total in self.words.agg(*[F.sum(n) for n in self.names]).first()]


def text_terms(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, terms), stored, of the texts that have a word.

    Stored, since the optimizer would move the counting into whatever reads the terms.
    """
    counted = materialize(with_term_counts(long, [*keys, "field"]).select(*keys, "field", "terms"))
    return counted.where(F.size("terms") > 0)


def term_statistics(texts: DataFrame) -> DataFrame:
    """(token, documents, idf) of every word, from ``text_terms``.

    idf = ln((1 + N) / (1 + documents)) + 1 over the N texts that have a word; it is never below 1, so a word
    that is in every text still counts.
    """
    total = texts.agg(F.count(F.lit(1))).scalar()
    counts = explode_rows(texts, [], F.transform("terms", lambda t: t["token"]), "token").groupBy("token").agg(
        F.count(F.lit(1)).alias("documents")
    )
    return counts.withColumn("n", total).select(
        "token", "documents", (F.ln((F.col("n") + 1) / (F.col("documents") + 1)) + 1).alias("idf")
    )


def with_words(texts: DataFrame, keep: list[str], words: DataFrame, broadcast: bool, how: str = "inner") -> DataFrame:
    """A row per word of a text, with what ``words`` has of it."""
    exploded = explode_rows(texts, keep, F.col("terms"), "x").select(*keep, "x.token", "x.tf")
    if broadcast:
        return lookup_join(exploded, words, ["token"], how, keep, broadcast)
    common = words.where("common")
    others = exploded.join(F.broadcast(common.select("token")), "token", "left_anti")
    # not salted, as no word of these stands in more texts than all of the common ones
    rare = others.join(words.where(~F.col("common")), "token", how)
    return exploded.join(F.broadcast(common), "token").select(rare.columns).union(rare)


def divided(joined: DataFrame, keep: list[str], model: TopicModel, shares: list[Column], names: list[str]) -> DataFrame:
    """How a word's count in a text is divided among the topics, as one column per topic.

    In steps, so that each topic's part is computed once.
    """
    raw = {f"r{k}": F.col(f"b{k}") * share for k, share in enumerate(shares)}
    parts = joined.select(*keep, (F.col("tf") * F.col("weight")).alias("x"), *[v.alias(n) for n, v in raw.items()])
    whole = parts.withColumn("x", F.col("x") / reduce(Column.__add__, [F.col(n) for n in raw]))
    return whole.select(*keep, *[(F.col("x") * F.col(r)).alias(n) for r, n in zip(raw, names)])


def text_shares(texts: DataFrame, keys: list[str], model: TopicModel, before: DataFrame | None) -> DataFrame:
    """(keys, field, g0, g1, ..., e0, e1, ...), stored: the parameters of each text's shares after one more update.

    ``e`` is the exponential of the digamma function of ``g``.
    """
    group, names = [*keys, "field"], [f"g{k}" for k in range(model.n_topics)]
    factors = [f"e{k}" for k in range(model.n_topics)]
    given = texts.join(before.select(*group, *factors), group) if before is not None else texts
    joined = with_words(given, [*group, *factors] if before is not None else group, model.words, model.broadcast)
    shares = [F.col(e) if before is not None else F.lit(1.0) for e in factors]
    sums = divided(joined, group, model, shares, names).groupBy(*group).agg(
        *[(F.sum(n) + model.share_prior).alias(n) for n in names]
    )
    found = materialize(sums.select("*", *[F.exp(digamma(F.col(n))).alias(e) for n, e in zip(names, factors)]))
    sweep(texts.sparkSession)
    return found


def word_weights(texts: DataFrame, keys: list[str], model: TopicModel, shares: DataFrame) -> DataFrame:
    """(token, weight, common, w0, w1, ..., b0, b1, ...), stored, after one more update."""
    group, factors = [*keys, "field"], [f"e{k}" for k in range(model.n_topics)]
    given = texts.join(shares.select(*group, *factors), group)
    joined = with_words(given, [*group, *factors], model.words, model.broadcast)
    parts = divided(joined, ["token", "weight", "common"], model, [F.col(e) for e in factors], model.names)
    sums = parts.groupBy("token").agg(
        F.max("weight").alias("weight"),
        F.max("common").alias("common"),
        *[(F.sum(w) + model.word_prior).alias(w) for w in model.names],
    )
    return with_factors(sums, model.n_topics)


def with_factors(words: DataFrame, n_topics: int) -> DataFrame:
    """The words, stored, and for each topic exp(digamma(w) - digamma(sum of w over all words)).

    The sums are joined as a row of a table and not written into the plan, so that the rounds share their code.
    """
    names = [f"w{k}" for k in range(n_topics)]
    plain = materialize(words)
    totals = plain.agg(*[F.sum(n).alias(f"sum_{n}") for n in names]).withColumn("one", F.lit(1))
    joined = plain.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")
    factors = [F.exp(digamma(F.col(n)) - digamma(F.col(f"sum_{n}"))).alias(f"b{k}") for k, n in enumerate(names)]
    found = materialize(joined.select("token", "weight", "common", *names, *factors))
    release(plain)
    sweep(words.sparkSession)
    return found


def with_common(terms: DataFrame) -> DataFrame:
    """The words with ``common``: whether a word is one of the ``COMMON`` that stand in the most texts."""
    leading = terms.orderBy(F.desc("documents"), "token").limit(COMMON).select("token", F.lit(True).alias("common"))
    return terms.join(F.broadcast(leading), "token", "left").withColumn("common", F.coalesce("common", F.lit(False)))


def fit_topics(
    long: DataFrame,
    keys: list[str],
    n_topics: int = 6,
    iterations: int = 10,
    seed: int = 42,
    weighted: bool = True,
) -> TopicModel:
    """A model of all texts and words. ``weighted`` counts a word as often as its idf says, else once.

    The same rows give the same model: the start is drawn from a hash of each word.
    """
    texts = text_terms(long, keys)
    counted = materialize(term_statistics(texts))
    terms = with_common(counted)
    prior = 1.0 / n_topics
    start = [
        (prior + 0.5 + F.pmod(F.xxhash64("token", F.lit(k), F.lit(seed)), F.lit(1_000_003)) / 1_000_003).alias(f"w{k}")
        for k in range(n_topics)
    ]
    weight = F.col("idf") if weighted else F.lit(1.0)
    words = with_factors(terms.select("token", weight.alias("weight"), "common", *start), n_topics)
    release(counted)
    model = TopicModel(words, n_topics, prior, prior, fits_broadcast(words))
    shares = None
    for _ in range(iterations if words.take(1) else 0):
        newer = text_shares(texts, keys, model, shares)
        if shares is not None:
            release(shares)
        shares = newer
        words = word_weights(texts, keys, model, shares)
        release(model.words)
        model = TopicModel(words, n_topics, prior, prior, model.broadcast)
    return model


def describe_topics(model: TopicModel, n_terms: int = 10) -> DataFrame:
    """(topic, rank, token, weight): each topic's leading words and their share of it."""
    totals = model.totals()
    numbered = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("topic"), (F.col(name) / (totals[k] or 1.0)).alias("weight"))
                for k, name in enumerate(model.names)
            ]
        )
    )
    rows = model.words.select("token", numbered.alias("t")).select("t.topic", "token", "t.weight")
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "token")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_terms)
    return ranked.select("topic", "rank", "token", "weight")


def topic_shares(long: DataFrame, keys: list[str], model: TopicModel, updates: int = 10) -> DataFrame:
    """(keys, field, g0, g1, ...) of texts the model need not have seen; words it does not know are passed over."""
    texts = text_terms(long, keys)
    shares = None
    for _ in range(updates):
        shares = text_shares(texts, keys, model, shares)
    return shares


def perplexity(long: DataFrame, keys: list[str], model: TopicModel, updates: int = 10) -> float | None:
    """Of the words of one half of each text, given shares found from the other half.

    Words are put into halves by their hash, so that the shares have not seen the words they are to
    predict. A word the model does not know has the prior's weight in every topic.
    """
    texts = text_terms(long, keys)

    def half(number: int) -> Column:
        return F.filter("terms", lambda t: F.pmod(F.xxhash64(t["token"]), F.lit(2)) == number)

    group = [*keys, "field"]
    seen = materialize(texts.select(*group, half(0).alias("terms")).where(F.size("terms") > 0))
    shares = None
    for _ in range(updates):
        shares = text_shares(seen, keys, model, shares)
    names = [f"g{k}" for k in range(model.n_topics)]
    asked = texts.select(*group, half(1).alias("terms")).where(F.size("terms") > 0).join(shares, group)
    joined = with_words(asked, [*group, *names], model.words, model.broadcast, "left")
    whole = reduce(Column.__add__, [F.col(n) for n in names])
    likely = reduce(
        Column.__add__,
        [
            F.col(name) / whole * F.coalesce(F.col(word), F.lit(model.word_prior)) / total
            for name, word, total in zip(names, model.names, model.totals())
        ],
    )
    row = joined.agg(F.sum(F.col("tf") * F.ln(likely)).alias("log"), F.sum("tf").alias("n")).first()
    return math.exp(-row["log"] / row["n"]) if row["n"] else None


def discover_topics(
    long: DataFrame,
    keys: list[str],
    n_topics: int = 6,
    n_terms: int = 10,
    iterations: int = 10,
    seed: int = 42,
) -> DataFrame:
    """(topic, rank, token, weight): the leading words of the topics of all texts."""
    return describe_topics(fit_topics(long, keys, n_topics, iterations, seed), n_terms)
