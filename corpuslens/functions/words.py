"""Tests of a word against a list that is short enough to be part of a plan."""

from __future__ import annotations


def one_of(value: str, words: list[str] | None) -> str:
    """SQL condition that ``value`` is a known word; always true where the words are not known.

    Used inside array functions to drop the words of a text that no lookup row can meet, before
    they are exploded and joined. Spark keeps a long list as a hash set.
    """
    if words is None:
        return "true"
    if not words:
        return "false"
    escaped = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return f"{value} IN (" + ", ".join(f"'{w}'" for w in escaped) + ")"
