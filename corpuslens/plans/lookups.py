"""Joins of an exploded corpus against a lookup table (lexicon, topics, names, exemplars)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpuslens.plans.session import materialize

MAX_PLAN_WORDS = 10_000
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def known_words(lookup: DataFrame, column: str) -> list[str] | None:
    """The distinct keys of a lookup table, or None if there are too many to name in a plan."""
    rows = lookup.select(column).where(F.col(column).isNotNull()).distinct().take(MAX_PLAN_WORDS + 1)
    return None if len(rows) > MAX_PLAN_WORDS else sorted(r[0] for r in rows)


def fits_broadcast(
    small: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Measure the table, reading at most ``max_rows + 1`` rows of it."""
    size = (
        small.limit(max_rows + 1)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
        )
        .first()
    )
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


@dataclass(frozen=True)
class Lookup:
    """A lookup table that is stored and measured, for any number of joins.

    ``words`` are its distinct keys, None if there are too many to name in a plan.
    """

    table: DataFrame
    words: list[str] | None
    broadcast: bool


def prepare_lookup(
    table: DataFrame | Lookup,
    column: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> Lookup:
    """Compute a table once, and measure once whether it can be broadcast and its keys be named."""
    if isinstance(table, Lookup):
        return table
    stored = materialize(table)
    return Lookup(stored, known_words(stored, column), fits_broadcast(stored, max_rows, max_bytes))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: list[str] | None = None,
    broadcast: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` to ``small`` on equal columns.

    A small table that was measured to fit is broadcast, so ``big`` is not shuffled. Otherwise
    both sides are shuffled on the key and a salt: the rows of a hot key in ``big`` spread over
    ``salts`` partitions by ``salt_by``, and ``small`` is repeated once per salt.
    """
    if broadcast is None:
        broadcast = fits_broadcast(small)
    if broadcast:
        return big.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(*(salt_by or big.columns)), F.lit(salts)).cast("int")
    spread_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(spread_small, [*on, "_salt"], how).drop("_salt")
