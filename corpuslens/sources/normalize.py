"""Bring the columns of a pairs table to ``instruction``, ``input``, ``prompt``, ``response``."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType


def renames(
    columns: list[str],
    instruction_name: str | None = None,
    input_name: str | None = None,
    response_name: str | None = None,
) -> dict[str, str]:
    """Decide from the column names alone which columns take which role."""

    def first_present(*names: str | None) -> str | None:
        return next((name for name in names if name in columns), None)

    roles: list[tuple[str, str]] = []
    if instruction_name in columns:
        roles.append((instruction_name, "instruction"))
    has_instruction = bool(roles) or "instruction" in columns
    text = first_present(input_name, "input", "prompt")
    if text is not None:
        roles.append((text, "input" if has_instruction else "prompt"))
    answer = first_present(response_name, "response", "output")
    if answer is not None:
        roles.append((answer, "response"))

    taken_twice = [c for c, n in Counter(c for c, _ in roles).items() if n > 1]
    if taken_twice:
        raise ValueError(f"columns named for more than one role: {taken_twice}")
    return dict(roles)


def normalize_columns(
    df: DataFrame,
    instruction_name: str | None = None,
    input_name: str | None = None,
    response_name: str | None = None,
) -> DataFrame:
    """Rename the columns by role, then compose the prompt if there is an instruction."""
    mapping = renames(df.columns, instruction_name, input_name, response_name)
    after = [mapping.get(c, c) for c in df.columns]
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    for names in (df.columns, after):
        seen = Counter(n if case_sensitive else n.lower() for n in names)
        clashes = sorted(n for n, count in seen.items() if count > 1)
        if clashes:
            raise ValueError(f"ambiguous column names {clashes} in {names}")
    return compose_prompt(df.withColumnsRenamed(mapping))


def compose_prompt(df: DataFrame) -> DataFrame:
    """``prompt = instruction + ". " + input``; null if either part is null."""
    if not {"instruction", "input"} <= set(df.columns):
        return df
    return df.withColumn("prompt", F.concat("instruction", F.lit(". "), "input"))


def validate_pairs(df: DataFrame) -> DataFrame:
    """Fail early, at planning, when a table is not a pairs table."""
    for name in ("prompt", "response"):
        if name not in df.columns:
            raise ValueError(f"pairs need a column {name!r}; found {df.columns}")
        if not isinstance(df.schema[name].dataType, StringType):
            raise ValueError(f"column {name!r} must be a string, is {df.schema[name].dataType}")
    return df
