"""Check-digit rules of published numbering schemes, as column expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits(value: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int")
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, v: total + v)


def _weighted(digit_array: Column, weights: list[int]) -> Column:
    weight_array = F.array(*[F.lit(w) for w in weights])
    return _total(F.zip_with(digit_array, weight_array, lambda d, w: d * w))


def luhn(value: Column) -> Column:
    doubled = F.transform(
        F.reverse(digits(value)),
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
    )
    return (F.size(digits(value)).between(13, 19)) & (_total(doubled) % 10 == 0)


def iban(value: Column) -> Column:
    moved = F.concat(F.substring(value, 5, 60), F.substring(value, 1, 4))
    characters = F.regexp_extract_all(moved, F.lit("[A-Z0-9]"), F.lit(0))
    remainder = F.aggregate(
        characters,
        F.lit(0),
        lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(
            (rest * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return remainder == 1


def au_tfn(value: Column) -> Column:
    return _weighted(digits(value), [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0


def au_abn(value: Column) -> Column:
    # The scheme subtracts one from the first digit, whose weight is ten.
    weights = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    return (_weighted(digits(value), weights) - 10) % 89 == 0


def au_acn(value: Column) -> Column:
    found = digits(value)
    expected = F.pmod(F.lit(10) - _weighted(found, [8, 7, 6, 5, 4, 3, 2, 1, 0]) % 10, F.lit(10))
    return expected == F.get(found, F.lit(8))


def uk_nhs(value: Column) -> Column:
    # A check digit of ten never equals the last digit, which leaves such numbers invalid.
    found = digits(value)
    expected = (F.lit(11) - _weighted(found, [10, 9, 8, 7, 6, 5, 4, 3, 2, 0]) % 11) % 11
    return expected == F.get(found, F.lit(9))


def medical_license(value: Column) -> Column:
    found = digits(value)
    return _weighted(found, [1, 2, 1, 2, 1, 2, 0]) % 10 == F.get(found, F.lit(6))
