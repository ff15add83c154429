"""The sixteen text statistics, computed inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.text import (
    FIRST_100_TOKENS,
    explode_rows,
    sentence_count,
    syllables,
    tokens,
)
from corpuslens.functions.words import one_of
from corpuslens.operators.longform import FIELDS

# Names and order of the statistics.
METRICS = [
    "Flesch Reading Ease",
    "SMOG Index",
    "Flesch-Kincaid Grade Level",
    "Coleman-Liau Index",
    "Automated Readability Index",
    "Dale-Chall Readability Score",
    "Difficult Words",
    "Linsear Write Formula",
    "Gunning Fog Index",
    "Text Standard",
    "Lexicon Count",
    "Sentence Count",
    "Syllable Count",
    "Character Count",
    "Polysyllable Count",
    "Monosyllable Count",
]
GRADES = [
    "SMOG Index",
    "Flesch-Kincaid Grade Level",
    "Coleman-Liau Index",
    "Automated Readability Index",
    "Dale-Chall Readability Score",
    "Linsear Write Formula",
    "Gunning Fog Index",
]
COMMON_WORDS = 3_000


def common_words(long: DataFrame, n: int = COMMON_WORDS) -> DataFrame:
    """(token, documents): the ``n`` tokens found in most texts, ties by token."""
    present = explode_rows(long, [], F.array_distinct(tokens(F.col("text"))), "token")
    return (
        present.groupBy("token")
        .agg(F.count(F.lit(1)).alias("documents"))
        .orderBy(F.desc("documents"), "token")
        .limit(n)
    )


def _at_least(syllable_array: Column, n: int) -> Column:
    return F.size(F.filter(syllable_array, lambda s: s >= n))


def word_list(common: DataFrame) -> list[str]:
    """The words of a common-word table, of which there are at most ``COMMON_WORDS``."""
    rows = common.select("token").take(COMMON_WORDS + 1)
    if len(rows) > COMMON_WORDS:
        raise ValueError(f"a common-word table holds at most {COMMON_WORDS} words")
    return sorted(r["token"] for r in rows)


def text_counts(
    df: DataFrame, keep: list[str], common: DataFrame | list[str], text: str = "text"
) -> DataFrame:
    """The base counts of a text: words, sentences, syllables and so on; null for no text.

    The common words become a set in the plan, so difficult words are counted where the text is,
    without a join or a shuffle. Give them as a list to use them again without finding them again.
    """
    words = common if isinstance(common, list) else word_list(common)
    given = F.when(F.length(text) > 0, F.col(text))
    base = df.select(*keep, given.alias("_text")).select(
        *keep,
        "_text",
        tokens(F.col("_text")).alias("_tokens"),
        sentence_count(F.col("_text")).alias("_sentences"),
    )
    with_syllables = base.select("*", F.transform("_tokens", syllables).alias("_syl"))
    n_words = F.size("_tokens")
    start = F.regexp_extract("_text", FIRST_100_TOKENS, 0)
    first = F.slice("_syl", 1, 100)
    hard = F.expr(f"filter(_tokens, (w, i) -> _syl[i] >= 2 AND NOT ({one_of('w', words)}))")
    counted = with_syllables.select(
        *keep,
        F.when(F.col("_text").isNotNull(), n_words).alias("words"),
        F.col("_sentences").alias("sentences"),
        F.aggregate("_syl", F.lit(0), lambda total, s: total + s).alias("syllables"),
        F.length(F.regexp_replace("_text", r"\s", "")).alias("characters"),
        F.aggregate("_tokens", F.lit(0), lambda total, t: total + F.length(t)).alias("letters"),
        _at_least(F.col("_syl"), 3).alias("polysyllables"),
        F.size(F.filter("_syl", lambda s: s == 1)).alias("monosyllables"),
        F.size(first).alias("first_words"),
        _at_least(first, 3).alias("first_hard"),
        F.when(n_words <= 100, F.col("_sentences")).otherwise(sentence_count(start)).alias("first_sentences"),
        F.size(F.array_distinct(hard)).alias("difficult"),
    )
    given_only = [
        F.when(F.col("words").isNotNull(), F.col(c)).alias(c)
        for c in counted.columns
        if c not in keep
    ]
    return counted.select(*keep, *given_only)


def _text_standard(grades: list[Column]) -> Column:
    """The most frequent rounded grade, the lowest of them on a tie."""
    rounded = F.array_compact(F.array(*[F.round(g) for g in grades]))
    votes = F.transform(
        rounded,
        lambda g: F.struct((-F.size(F.filter(rounded, lambda other: other == g))).alias("votes"), g.alias("grade")),
    )
    return F.array_min(votes)["grade"]


def statistics(counts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the sixteen statistics from the counts of ``text_counts``."""
    w, s, y, c, letters, poly = (
        F.nullif(F.col(name), F.lit(0)).cast("double")
        if name in ("words", "sentences")
        else F.col(name).cast("double")
        for name in ("words", "sentences", "syllables", "characters", "letters", "polysyllables")
    )
    percent_difficult = F.col("difficult") * 100.0 / w
    linsear = (F.col("first_words") + 2.0 * F.col("first_hard")) / F.col("first_sentences")
    linsear = F.when(F.col("first_words") > 0, linsear)
    values = {
        # Flesch (1948)
        "Flesch Reading Ease": 206.835 - 1.015 * (w / s) - 84.6 * (y / w),
        # McLaughlin (1969), defined from three sentences on
        "SMOG Index": F.when(s >= 3, 1.0430 * F.sqrt(30.0 * poly / s) + 3.1291),
        # Kincaid et al. (1975)
        "Flesch-Kincaid Grade Level": 0.39 * (w / s) + 11.8 * (y / w) - 15.59,
        # Coleman and Liau (1975)
        "Coleman-Liau Index": 0.0588 * (100.0 * letters / w) - 0.296 * (100.0 * s / w) - 15.8,
        # Senter and Smith (1967)
        "Automated Readability Index": 4.71 * (c / w) + 0.5 * (w / s) - 21.43,
        # Dale and Chall (1948)
        "Dale-Chall Readability Score": 0.1579 * percent_difficult
        + 0.0496 * (w / s)
        + F.when(percent_difficult > 5, 3.6365).otherwise(0.0),
        "Difficult Words": F.col("difficult").cast("double"),
        "Linsear Write Formula": F.when(linsear > 20, linsear / 2).otherwise((linsear - 2) / 2),
        # Gunning (1952)
        "Gunning Fog Index": 0.4 * (w / s + 100.0 * poly / w),
        "Lexicon Count": F.col("words").cast("double"),
        "Sentence Count": s,
        "Syllable Count": y,
        "Character Count": c,
        "Polysyllable Count": poly,
        "Monosyllable Count": F.col("monosyllables").cast("double"),
    }
    scored = counts.select(*keep, *[v.alias(name) for name, v in values.items()])
    standard = _text_standard([F.col(f"`{name}`") for name in GRADES])
    return scored.withColumn("Text Standard", standard).select(*keep, *METRICS)


def score_readability(
    long: DataFrame, keys: list[str], common: DataFrame | list[str]
) -> DataFrame:
    """(keys, field, sixteen statistics), without a shuffle."""
    keep = [*keys, "field"]
    return statistics(text_counts(long, keep, common), keep)


def metric_values(scores: DataFrame, keys: list[str], selected: list[str] | None = None) -> DataFrame:
    """(keys, field, metric, value) for the selected statistics; the others are not computed."""
    unknown = set(selected or ()) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    wanted = [m for m in METRICS if selected is None or m in selected]
    return scores.unpivot([*keys, "field"], [f"`{m}`" for m in wanted], "metric", "value")


def analyze_readability(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """Pairs plus the statistics of both texts, named ``Prompt ...`` and ``Response ...``.

    Both sides come from the same row, so nothing is joined.
    """
    result, words = pairs, word_list(common)
    for field in FIELDS:
        before = result.columns
        counted = text_counts(result, before, words, text=field)
        named = {m: f"{field.capitalize()} {m}" for m in METRICS}
        result = statistics(counted, before).withColumnsRenamed(named)
    return result
