"""Sorted, filtered and paged views of a result table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

RESULT_PAGE = 3
DATASET_PAGE = 10


def sort_table(df: DataFrame, column: str, keys: list[str], descending: bool = False) -> DataFrame:
    """Sorted by any column; the keys make the order of equal values definite."""
    first = F.desc(column) if descending else F.asc(column)
    return df.orderBy(first, *[k for k in keys if k != column])


def condition(column: str, operator: str, value=None) -> Column:
    """One filter of the table widget on one column."""
    c = F.col(column)
    tests = {
        "contains": lambda: c.cast("string").contains(str(value)),
        "=": lambda: c == value,
        "!=": lambda: c != value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "is blank": lambda: c.isNull() | (c.cast("string") == ""),
    }
    if operator not in tests:
        raise ValueError(f"unknown filter {operator!r}; known are {sorted(tests)}")
    return tests[operator]()


def filter_table(df: DataFrame, *filters: tuple) -> DataFrame:
    """Rows that pass every (column, operator, value)."""
    if not filters:
        return df
    return df.where(reduce(Column.__and__, [condition(*f) for f in filters]))


def page(df: DataFrame, order: list[str], number: int, size: int = RESULT_PAGE) -> DataFrame:
    """Page ``number`` (from 0) in the given order: a top-k, not a full sort.

    For pages far into a large table use ``page_after``, which does not read past rows again.
    """
    return df.orderBy(*order).offset(number * size).limit(size)


def page_after(df: DataFrame, key: str, last, size: int = RESULT_PAGE) -> DataFrame:
    """The page that follows the row with key ``last``; the filter reaches the scan."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)
