"""Secret scan: known shapes, and windows of high entropy in candidate strings.

Three shapes are matched as they stand: values assigned to names such as ``password``, access keys,
and long hexadecimal strings. Beside them, candidate strings of each character class are read by a
window of fixed width. The counts of its characters change by one in and one out per step, and with
them the sum from which Shannon's entropy follows; stretches of windows at or above the class's bar
are findings. Allow-listed candidates (plain words, ids in UUID form, dates and numbers, paths and host
names, runs of one character) are left out, and so are the markers of examples and placeholders, but not
what stands beside them, and what a known shape covers.

Everything is column expressions within the row. Positions are code points, ends exclusive.
Results: one row per row; null and empty texts have no findings. Matches of one kind do not overlap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed shapes: kind, expression, what a match must satisfy.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]
WIDTH = 20
SPAN = "struct<kind:int,start:int,end:int>"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are the longest runs of its characters; the bar is in bits per character."""

    kind: str
    characters: str
    shape: str
    bar: float


CLASSES = [
    CharacterClass("entropy_hex", "0123456789abcdef", rf"[0-9A-Fa-f]{{{WIDTH},}}", 3.0),
    CharacterClass(
        "entropy_mixed",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-",
        rf"[A-Za-z0-9+/=_-]{{{WIDTH},}}",
        3.7,
    ),
]
#: A word of one case, with a leading capital, or in camel case with several letters a part.
WORD = r"(?:[A-Z]?[a-z]{2,20}(?:[A-Z][a-z]{2,20})++|[A-Z]?[a-z]{1,20}|[A-Z]{1,20})(?=[-_/=+]|$)"
#: Candidates left alone, whole matches. Repeated groups are possessive, which Java matches in a loop:
#: otherwise its stack would grow with the length of the text.
ALLOWED = [
    rf"[-_/=+]*+{WORD}(?:[-_/=+]++{WORD})*+[-_/=+]*+",  # a word, or words joined by signs
    r"[0-9+/=_-]++",  # numbers, dates, rules
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"/?(?:[a-z0-9._-]{1,15}/)++[a-z0-9._-]{0,15}",  # a path
]
#: Left alone wherever it stands; what stands beside it in a candidate is read on its own.
MARKER = r"(?i:example|sample|placeholder|changeme|dummy|x{4,})"
MARKER_OR_BESIDE = rf"{MARKER}|(?:(?!{MARKER})[A-Za-z0-9+/=_-])++"


def matches(text: Column, shape: str) -> Column:
    """Array of (start, end, match), in order. What lies between the matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    gaps = F.split(text, shape, -1)
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    told = F.filter(pairs, lambda p: p["hit"].isNotNull())  # one gap more than hits
    return F.when(F.size(hits) > 0, F.aggregate(told, first, add, lambda s: s["found"])).otherwise(empty)


def span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
    )


def known_spans(kind: str, found: Column) -> Column:
    fits = {
        "assign": lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE,
        "access": lambda m: F.length(m["match"]) >= LEAST_ACCESS,
        "hex": lambda m: F.lit(True),
    }[kind]
    return F.transform(F.filter(found, fits), lambda m: span(kind, m["start"], m["end"]))


def allowed(match: Column) -> Column:
    return match.rlike("^(?:" + "|".join(f"(?:{shape})" for shape in ALLOWED) + ")$")


def without_markers(found: Column) -> Column:
    """Matches, those that hold a marker cut into what lies beside it, as far as a window fits."""

    def beside(m: Column) -> Column:
        parts = F.filter(
            matches(m["match"], MARKER_OR_BESIDE),
            lambda p: (F.length(p["match"]) >= WIDTH) & ~p["match"].rlike(MARKER),
        )
        return F.transform(
            parts,
            lambda p: F.struct(
                (m["start"] + p["start"]).alias("start"),
                (m["start"] + p["end"]).alias("end"),
                p["match"].alias("match"),
            ),
        )

    return F.flatten(F.transform(found, lambda m: F.when(m["match"].rlike(MARKER), beside(m)).otherwise(F.array(m))))


def term(count: Column) -> Column:
    """c * log2(c) for a count from 0 to the window's width."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WIDTH + 1)])
    return F.get(table, count)


def high_windows(candidate: Column, klass: CharacterClass) -> Column:
    """Array of (start, end) within a candidate: stretches of windows at or above the bar.

    The state holds the count of every character of the class and the sum of c * log2(c).
    """
    text = F.lower(candidate) if klass.characters.islower() or klass.kind.endswith("hex") else candidate
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(klass.characters), c) - 1)
    pairs = "array<struct<start:int,end:int>>"
    begin = F.struct(
        F.array_repeat(F.lit(0), len(klass.characters)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.array().cast(pairs).alias("found"),
    )
    steps = F.zip_with(
        codes,
        F.concat(F.array_repeat(F.lit(-1), WIDTH), codes),
        lambda new, old: F.struct(new.alias("new"), old.alias("old")),
    )

    def step(state: Column, move: Column) -> Column:
        new, old = move["new"], move["old"]
        same = new == old
        out = F.when((old >= 0) & ~same, F.get(state["counts"], old)).otherwise(0)
        inn = F.get(state["counts"], new)
        total = (
            state["sum"]
            + F.when(out > 0, term(out - 1) - term(out)).otherwise(0.0)
            + F.when(same, 0.0).otherwise(term(inn + 1) - term(inn))
        )
        counts = F.when(same, state["counts"]).otherwise(
            F.transform(
                state["counts"],
                lambda c, i: c + F.when(i == new, 1).when((i == old) & (old >= 0), -1).otherwise(0),
            )
        )
        end = state["at"] + 1
        high = (end >= WIDTH) & (math.log2(WIDTH) - total / WIDTH >= klass.bar)
        found = state["found"]
        size = F.size(found)
        last = F.get(found, F.greatest(size - 1, F.lit(0)))
        window = F.struct((end - WIDTH).alias("start"), end.alias("end"))
        longer = F.concat(
            F.slice(found, F.lit(1), F.greatest(size - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), end.alias("end"))),
        )
        joined = F.when((size > 0) & (last["end"] >= end - WIDTH), longer).otherwise(
            F.concat(found, F.array(window))
        )
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            end.alias("at"),
            F.when(high, joined).otherwise(found).cast(pairs).alias("found"),
        )

    # the second array is longer by the window's width; what has no new character is left out
    moves = F.slice(steps, F.lit(1), F.greatest(F.size(codes), F.lit(1)))
    return F.aggregate(moves, begin, step, lambda s: s["found"])


def entropy_spans(found: Column, klass: CharacterClass, known: Column) -> Column:
    """Spans of high entropy in candidates that are not allowed, less those a known span covers."""
    candidates = F.filter(without_markers(found), lambda m: ~allowed(m["match"]))
    spans = F.flatten(
        F.transform(
            candidates,
            lambda m: F.transform(
                high_windows(m["match"], klass),
                lambda w: span(klass.kind, m["start"] + w["start"], m["start"] + w["end"]),
            ),
        )
    )
    return F.filter(
        spans,
        lambda s: ~F.exists(known, lambda k: (k["start"] <= s["start"]) & (k["end"] >= s["end"])),
    )


def in_order(spans: Column) -> Column:
    """Sorted by start, then kind."""
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )
    return F.sort_array(keyed)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, known, spans): arrays of (start, kind number, end), sorted; ``spans`` has all."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    value = F.col("text")
    shapes = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    rows = rows.withColumns({f"m_{kind}": matches(value, shape) for kind, shape in shapes.items()})
    rows = rows.withColumn("known", F.concat(*[known_spans(kind, F.col(f"m_{kind}")) for kind in shapes]))
    rows = rows.withColumns({f"c_{c.kind}": matches(value, c.shape) for c in CLASSES})
    rows = rows.withColumn(
        "more", F.concat(*[entropy_spans(F.col(f"c_{c.kind}"), c, F.col("known")) for c in CLASSES])
    )
    return rows.select(
        F.col("key").alias(key),
        "text",
        in_order(F.col("known")).alias("known"),
        in_order(F.concat("known", "more")).alias("spans"),
    )


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one mark."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cover(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        # a span that starts within what is covered already only makes it longer
        out = F.when(
            (s["start"] >= state["at"]) & ((s["start"] > state["at"]) | (state["at"] == 0)),
            F.concat(state["out"], gap, F.lit(mark)),
        ).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    def rest(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, first, cover, rest)).otherwise(text)
