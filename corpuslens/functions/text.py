"""Tokens, sentences, syllables and shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions.words import one_of

# What counts as a token, a sentence end, a vowel run and a silent final e.
TOKEN = r"[\p{L}]+"
SENTENCE_END = r"[.!?]+(\s|$)"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
VOWEL_RUN = f"[{VOWELS}]+"
SILENT_E = f"[^{VOWELS}l]e$"
# Possessive, since a text with fewer tokens would otherwise be tried in countless ways.
FIRST_100_TOKENS = r"^(?:[^\p{L}]*+\p{L}++){100}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentence_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(SENTENCE_END)), F.lit(1))


def syllables(token: Column) -> Column:
    """Vowel runs without a silent final e, at least one."""
    runs = F.regexp_count(token, F.lit(VOWEL_RUN))
    silent = F.when(token.endswith("e") & token.rlike(SILENT_E), 1).otherwise(0)
    return F.greatest(runs - silent, F.lit(1))


def runs(token_array: Column, width: int = 3) -> Column:
    """Runs of ``width`` neighbouring tokens; an empty array when there are too few.

    ``token_array`` must be a stored column: an expression would be evaluated for every run.
    """
    starts = F.sequence(F.lit(0), F.size(token_array) - width)
    joined = F.transform(
        starts,
        lambda i: F.concat_ws(" ", *[F.get(token_array, i + k) for k in range(width)]),
    )
    return F.when(F.size(token_array) >= width, joined).otherwise(
        F.array().cast("array<string>")
    )


def with_term_counts(
    df: DataFrame, keep: list[str], text: str = "text", words: list[str] | None = None
) -> DataFrame:
    """(keep, terms, norm): the distinct tokens of the row as array<struct<token, tf>>.

    Sorting the tokens of a row and cutting the sorted array into runs counts them without a
    shuffle. An empty or null text gives an empty or null array. ``norm`` is the length of the
    vector of all counts; ``terms`` holds only ``words``, where they are given.

    The steps are columns that later steps use more than once: the optimizer would move a column
    used once into the array function that uses it, and evaluate it for every element.
    """
    sorted_tokens = df.select(*keep, F.sort_array(tokens(F.col(text))).alias("_sorted"))
    first = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
    )
    cut = sorted_tokens.select(
        *keep,
        "_sorted",
        F.when(F.size("_sorted") > 0, first)
        .when(F.col("_sorted").isNotNull(), F.array().cast("array<int>"))
        .alias("_first"),
    )

    def tf(i: Column) -> Column:
        return F.coalesce(F.get("_first", i + 1), F.size("_sorted")) - F.get("_first", i)

    wanted = one_of("_sorted[_first[i]]", words)
    terms = F.transform(
        F.expr(
            "CASE WHEN size(_first) > 0 "
            f"THEN filter(sequence(0, size(_first) - 1), i -> {wanted}) "
            "WHEN _first IS NOT NULL THEN CAST(array() AS array<int>) END"
        ),
        lambda i: F.struct(F.get("_sorted", F.get("_first", i)).alias("token"), tf(i).alias("tf")),
    )
    lengths = F.transform("_first", lambda _, i: tf(i).cast("double"))
    norm = F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda total, n: total + n * n))
    return cut.select(*keep, terms.alias("terms"), norm.alias("norm"))


def explode_rows(df: DataFrame, keep: list[str], elements: Column, name: str) -> DataFrame:
    """One row per element of a computed array; rows without elements are dropped.

    A plain explode lets the optimizer add the filter ``size(elements) > 0`` and push it to the
    scan, which computes the whole array a second time. Exploding outer and dropping the null
    element afterwards computes it once.
    """
    return df.select(*keep, F.explode_outer(elements).alias(name)).where(F.col(name).isNotNull())
