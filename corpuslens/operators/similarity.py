"""Similarity of texts or vectors to groups of examples (injection, jailbreak, refusal).

Every scorer returns the largest similarity per group. Shingle containment finds copied
passages inside long texts, TF-IDF cosine tolerates paraphrase in short ones, and the vector
forms serve callers who bring embeddings.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from random import Random

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.text import explode_rows, runs, tokens, with_term_counts
from corpuslens.functions.words import one_of
from corpuslens.operators.containment import ExampleIndex, index_examples, largest_containment
from corpuslens.operators.longform import attach, to_long, widen
from corpuslens.plans.lookups import Lookup, known_words, lookup_join, prepare_lookup
from corpuslens.plans.session import materialize

WIDTH = 3
VECTORS_PER_BLOCK = 1_000
# The driver holds a broadcast table several times over: as rows, as a hash table and as blocks.
MAX_BROADCAST_SHINGLES = 50_000
MAX_BROADCAST_SHINGLE_BYTES = 6 * 1024 * 1024


def distinct_examples(examples: DataFrame) -> DataFrame:
    """(group, example_id, text) with copies inside a group kept once; the maximum is the same."""
    return examples.groupBy("group", F.lower("text").alias("text")).agg(
        F.min("example_id").alias("example_id")
    )


def check_examples(examples: DataFrame) -> DataFrame:
    """Reject examples that hold no shingle and so could never match."""
    short = examples.where(F.size(tokens(F.col("text"))) < WIDTH).select("group", "example_id").take(5)
    if short:
        raise ValueError(f"examples need at least {WIDTH} words: {[tuple(r) for r in short]}")
    return examples


def _largest_per_group(value: Column, groups: list[str]) -> list[Column]:
    return [
        F.max(F.when(F.col("group") == group, value)).alias(group) for group in groups
    ]


def _zero_unless_null_text(keys: list[str], groups: list[str]) -> list:
    scores = [
        F.when(F.col("has_text"), F.coalesce(F.col(g), F.lit(0.0))).alias(g) for g in groups
    ]
    return [*keys, "field", *scores]


@dataclass(frozen=True)
class Shingles(Lookup):
    """(shingle, group, example_id, size), stored and measured, with an index where it cannot be broadcast."""

    index: ExampleIndex | None = None


def prepare_shingles(examples: DataFrame) -> Shingles:
    """The shingles of the examples, for scoring many tables or micro-batches."""
    parts = distinct_examples(check_examples(examples)).select(
        "group", "example_id", tokens(F.col("text")).alias("t")
    )
    parts = parts.select("group", "example_id", F.array_distinct(runs(F.col("t"), WIDTH)).alias("parts"))
    keep = ["group", "example_id", "size"]
    found = prepare_lookup(
        explode_rows(parts.withColumn("size", F.size("parts")), keep, F.col("parts"), "shingle"),
        "shingle",
        MAX_BROADCAST_SHINGLES,
        MAX_BROADCAST_SHINGLE_BYTES,
    )
    index = None if found.broadcast else index_examples(found.table)
    return Shingles(found.table, found.words, found.broadcast, index)


def shingle_similarity(
    long: DataFrame, keys: list[str], examples: DataFrame | Shingles, groups: list[str]
) -> DataFrame:
    """(keys, field, one column per group): share of an example's shingles found in the text.

    ``examples`` are texts, or what ``prepare_shingles`` made of them. With the examples broadcast, texts
    that share nothing shrink to one row each before the shuffle, and only texts that share a shingle
    meet that example. More examples are searched by ``containment``, with the same result.
    """
    row = [*keys, "field", "has_text"]
    lookup = examples if isinstance(examples, Shingles) else prepare_shingles(examples)
    text_tokens = long.select(
        *keys, "field", F.col("text").isNotNull().alias("has_text"), tokens(F.col("text")).alias("t")
    )
    texts = text_tokens.select(*row, runs(F.col("t"), WIDTH).alias("parts"))
    if lookup.index:
        found = materialize(lookup.index.with_known(texts, row))
        best = largest_containment(found.select(F.struct(*row).alias("text"), "shingle"), lookup.index)
        scored = best.select("text.*", "group", "score").unionByName(found.select(*row), allowMissingColumns=True)
        return (
            scored.groupBy(*row)
            .agg(*_largest_per_group(F.col("score"), groups))
            .select(*_zero_unless_null_text(keys, groups))
        )
    known = F.expr(f"filter(parts, s -> {one_of('s', lookup.words)})")
    found = texts.select(*row, F.explode_outer(F.array_distinct(known)).alias("shingle"))
    shared = (
        lookup_join(found, lookup.table, ["shingle"], "left", row, lookup.broadcast)
        .groupBy(*row, "group", "example_id", "size")
        .agg(F.count("example_id").alias("shared"))
    )
    return (
        shared.groupBy(*row)
        .agg(*_largest_per_group(F.col("shared") / F.col("size"), groups))
        .select(*_zero_unless_null_text(keys, groups))
    )


def example_weights(examples: DataFrame) -> DataFrame:
    """(token, idf, group, example_id, weight): unit TF-IDF vectors of the examples.

    No token is dropped, however common: the idf is never below 1, so a text equal to the only example
    scores 1. One more row per token, without an example, lets the same pass over a text add up the
    length of its own vector.
    """
    example = ["group", "example_id"]
    counted = with_term_counts(distinct_examples(examples), example)
    terms = materialize(
        explode_rows(counted, example, F.col("terms"), "x").select(*example, "x.token", "x.tf")
    )
    total = terms.select("group", "example_id").distinct().agg(F.count(F.lit(1))).scalar()
    idf = (
        terms.groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("n", total)
        .select("token", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )
    weighted = terms.join(idf, "token").withColumn("weight", F.col("tf") * F.col("idf"))
    lengths = weighted.groupBy("group", "example_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")
    )
    unit = weighted.join(lengths, ["group", "example_id"]).select(
        "token", "idf", "group", "example_id", (F.col("weight") / F.col("length")).alias("weight")
    )
    return unit.unionByName(idf, allowMissingColumns=True)


def tfidf_similarity(
    long: DataFrame, keys: list[str], examples: DataFrame, groups: list[str]
) -> DataFrame:
    """(keys, field, one column per group): cosine of TF-IDF vectors through an inverted index."""
    row = [*keys, "field", "has_text"]
    weights = materialize(example_weights(examples))
    with_flag = long.withColumn("has_text", F.col("text").isNotNull())
    terms = (
        with_term_counts(with_flag, row, words=known_words(weights, "token"))
        .select(*row, F.explode_outer("terms").alias("x"))
        .select(*row, "x.token", "x.tf")
    )
    hits = lookup_join(terms, weights, ["token"], "left", row)
    own = F.col("tf") * F.col("idf")
    products = hits.groupBy(*row, "group", "example_id").agg(
        F.sum(own * F.coalesce(F.col("weight"), own)).alias("product")
    )
    own_square = F.max(F.when(F.col("group").isNull(), F.col("product")))
    return (
        products.groupBy(*row)
        .agg(own_square.alias("square"), *_largest_per_group(F.col("product"), groups))
        .select(
            *row,
            *[(F.col(g) / F.sqrt("square")).alias(g) for g in groups],
        )
        .select(*_zero_unless_null_text(keys, groups))
    )


def _as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_length(df: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    """(keep, v, length): the vector in doubles and its length, null for a zero vector."""
    doubles = df.select(*keep, _as_doubles(F.col(vector)).alias("v"))
    length = F.sqrt(_dot(F.col("v"), F.col("v")))
    return doubles.select(*keep, "v", F.nullif(length, F.lit(0.0)).alias("length"))


def unit_vectors(df: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    unit = F.transform("v", lambda x: x / F.col("length"))
    return with_length(df, keep, vector).where("length is not null").select(*keep, unit.alias("unit"))


def dense_similarity(
    vectors: DataFrame,
    keys: list[str],
    examples: DataFrame,
    groups: list[str],
    vector: str = "embedding",
    per_block: int = VECTORS_PER_BLOCK,
) -> DataFrame:
    """(keys, one column per group): largest cosine to the example vectors (group, example_id, vector).

    Exact, without a join or a shuffle of the corpus: the example vectors reach the rows as
    scalar subqueries of bounded size. More examples mean more blocks, not bigger ones.
    """
    known = materialize(unit_vectors(examples, ["group", "example_id"], vector))
    counts = known.where(F.col("group").isin(*groups)).groupBy("group").agg(F.count("unit"))
    sizes = dict(counts.collect())
    result = with_length(vectors, keys, vector)
    for group in groups:
        blocks = max(1, ceil(sizes.get(group, 0) / per_block))
        in_group = known.where(F.col("group") == group)
        block = F.pmod(F.xxhash64("example_id"), F.lit(blocks))
        result = result.withColumns(
            {
                f"_{group}_{b}": in_group.where(block == b).agg(F.collect_list("unit")).scalar()
                for b in range(blocks)
            }
        )
        best = [
            F.array_max(F.transform(f"_{group}_{b}", lambda example: _dot(F.col("v"), example)))
            for b in range(blocks)
        ]
        largest = best[0] if blocks == 1 else F.greatest(*best)
        result = result.withColumn(group, largest / F.col("length"))
    return result.select(*keys, *groups)


@dataclass(frozen=True)
class Hashing:
    """Tables of random directions. In each, the projections on a direction are cut at quantiles of the
    examples' projections, so that cells hold about equally many examples however these are spread."""

    tables: int = 4
    directions: int = 8
    cuts: int = 1
    probes: int = 5
    seed: int = 42

    def direction(self, table: int, number: int, size: int) -> list[float]:
        drawn = Random(f"{self.seed} {table} {number}")
        return [drawn.gauss(0.0, 1.0) for _ in range(size)]


def projections(unit: Column, hashing: Hashing, size: int) -> list[Column]:
    return [
        _dot(unit, F.array(*[F.lit(x) for x in hashing.direction(t, d, size)])).alias(f"p{t}_{d}")
        for t in range(hashing.tables)
        for d in range(hashing.directions)
    ]


def cut_points(projected: DataFrame, hashing: Hashing) -> dict[str, list[float]]:
    """Quantiles of every projection of the examples: a few numbers, whatever their number."""
    shares = [(i + 1) / (hashing.cuts + 1) for i in range(hashing.cuts)]
    names = [c for c in projected.columns if c.startswith("p")]
    row = projected.agg(*[F.percentile_approx(n, shares, 1_000).alias(n) for n in names]).first()
    return {n: row[n] or [0.0] * hashing.cuts for n in names}


def cells(hashing: Hashing, cuts: dict[str, list[float]], probes: int) -> Column:
    """Array of the cells of a row: its own in every table, and ``probes`` more, each across the nearest
    cut of one direction, those of the nearest cuts."""
    found = []
    for t in range(hashing.tables):
        names = [f"p{t}_{d}" for d in range(hashing.directions)]
        places = [sum((F.col(n) > c).cast("int") for c in cuts[n]) for n in names]
        found.append(F.array(F.xxhash64(F.lit(t), *places)))
        if not probes:
            continue
        crossings = []
        for d, name in enumerate(names):
            gaps = [F.struct(F.abs(F.col(name) - c).alias("gap"), F.lit(i).alias("cut")) for i, c in enumerate(cuts[name])]
            nearest = F.array_min(F.array(*gaps))
            across = F.when(places[d] <= nearest["cut"], nearest["cut"] + 1).otherwise(nearest["cut"])
            moved = [across if i == d else p for i, p in enumerate(places)]
            crossings.append(F.struct(nearest["gap"].alias("gap"), F.xxhash64(F.lit(t), *moved).alias("cell")))
        nearest_first = F.slice(F.array_sort(F.array(*crossings)), 1, probes)
        found.append(F.transform(nearest_first, lambda c: c["cell"]))
    return F.array_distinct(F.concat(*found))


def lsh_candidates(
    vectors: DataFrame, keys: list[str], examples: DataFrame, vector: str = "embedding", hashing: Hashing = Hashing()
) -> DataFrame:
    """(keys, unit, group, example_id, example): each pair that shares a cell, once.

    The vectors probe more cells than their own; the examples stand in theirs alone.
    """
    known = materialize(unit_vectors(examples, ["group", "example_id"], vector))
    first = known.first()
    size = len(first["unit"]) if first else 0
    asked = unit_vectors(vectors, keys, vector).where(F.size("unit") == size)
    projected = known.where(F.size("unit") == size).select("*", *projections(F.col("unit"), hashing, size))
    cuts = cut_points(projected, hashing)
    index = explode_rows(projected, ["group", "example_id"], cells(hashing, cuts, 0), "cell")
    probing = explode_rows(
        asked.select("*", *projections(F.col("unit"), hashing, size)), keys, cells(hashing, cuts, hashing.probes), "cell"
    )
    met = lookup_join(probing, materialize(index), ["cell"], salt_by=keys)
    pairs = met.select(*keys, "group", "example_id").distinct()
    near = known.select("group", "example_id", F.col("unit").alias("example"))
    return lookup_join(pairs.join(asked, keys), near, ["group", "example_id"], salt_by=keys)


def lsh_similarity(
    vectors: DataFrame,
    keys: list[str],
    examples: DataFrame,
    groups: list[str],
    vector: str = "embedding",
    hashing: Hashing = Hashing(),
    unmatched: float = 0.0,
) -> DataFrame:
    """(keys, one column per group): largest cosine among the examples met, for example sets too big to compare all.

    Approximate from below: every value is the cosine of an example, and an example near a vector shares
    a cell with it most likely. A vector that meets no example of a group has ``unmatched``, one without
    a direction (null or zero) has null. Every row is there.
    """
    met = lsh_candidates(vectors, keys, examples, vector, hashing)
    best = met.groupBy(*keys).agg(*_largest_per_group(_dot(F.col("unit"), F.col("example")), groups))
    given = with_length(vectors, keys, vector).select(*keys, F.col("length").isNotNull().alias("fine"))
    return given.join(best, keys, "left").select(
        *keys, *[F.when(F.col("fine"), F.coalesce(F.col(g), F.lit(unmatched))).alias(g) for g in groups]
    )


def analyze_prompts(
    pairs: DataFrame, keys: list[str], examples: DataFrame, scorer=shingle_similarity
) -> DataFrame:
    """Pairs plus ``prompt_injection`` and ``prompt_jailbreak``."""
    groups = ["injection", "jailbreak"]
    long = to_long(pairs, keys, ("prompt",))
    scores = scorer(long, keys, examples.where(F.col("group").isin(*groups)), groups)
    return attach(pairs, widen(scores, keys, {("prompt", g): f"prompt_{g}" for g in groups}), keys)


def analyze_refusal(
    pairs: DataFrame, keys: list[str], examples: DataFrame, scorer=shingle_similarity
) -> DataFrame:
    """Pairs plus ``refusal``."""
    long = to_long(pairs, keys, ("response",))
    scores = scorer(long, keys, examples.where(F.col("group") == "refusal"), ["refusal"])
    return attach(pairs, widen(scores, keys, {("response", "refusal"): "refusal"}), keys)
