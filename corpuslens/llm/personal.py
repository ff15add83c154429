"""Personal data: expressions propose spans, checksums confirm them, words nearby move their score.

Four base kinds are matched as they stand: mail addresses, IPv4 addresses, card numbers that pass Luhn's
sum, and phone numbers with a plus sign. A base match that fails its test is dropped and its place not read
again by the base. The method then adds what the base passes over: cards and phone numbers within longer
runs of digits, cut where the run has a separator; account numbers (IBAN) whose remainder by 97 is 1 at
their country's length; social security numbers. An added span has a score from its shape and its checksum,
raised by words of its kind nearby and lowered by words of other kinds of numbers, and stays from
``LEAST_SCORE`` on. Base spans always stay; they are scored alike.

Every expression is a run of one character class or is bound to a sign that occurs once per match, so time
grows with the length of the text and not with its square.

Results: one row per row; null and empty texts have no spans. Positions are code points, ends exclusive.
Base spans of one kind do not overlap; added ones never overlap a span of their kind. Rows are judged on
their own, so repeated rows and ids have equal results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
LEAST_SCORE = 0.5
#: Characters before and after a span in which words count.
BEFORE, AFTER = 48, 24
MORE, LESS = 0.3, 0.35

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}+")
SECURITY = re.compile(r"(?<![0-9-])([0-9]{3})([\x20-])([0-9]{2})\2([0-9]{4})(?![0-9-])")

CARD_DIGITS = range(14, 20)
ADDED_CARD_DIGITS = range(13, 20)
PHONE_DIGITS = range(10, 16)
#: How the digits of card numbers are grouped in print.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (13,), (14,), (15,), (16,), (19,)}
#: Characters of an account number by country (ISO 13616).
ACCOUNT_SIZES = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26, "UA": 29,
}
#: Score of a shape that passed its test, before the words nearby are read.
SHAPE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Score of added cards that are not grouped as in print.
ODD_CARD = 0.35
CONTEXT = {
    "email": {"mail", "email", "contact", "correo", "courriel"},
    "ip": {"ip", "ipv4", "address", "host", "server", "login"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "amex", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
}
OTHER_NUMBERS = {"version", "order", "invoice", "serial", "isbn", "tracking", "build", "release"}
NEARBY = re.compile(r"[^\W_]+")

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("base", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
ARROW_SPANS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]
    )
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


@dataclass(frozen=True)
class Proposal:
    """A span that passed its checksum, with the score of its shape."""

    span: Span
    score: float


def digits_of(text: str) -> str:
    return "".join(GROUP.findall(text))


def passes_luhn(digits: str) -> bool:
    values = [ord(d) - 48 for d in reversed(digits)]
    doubled = [2 * v - 9 * (v > 4) for v in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def passes_mod97(account: str) -> bool:
    """Country and check digits move to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield Span("email", start, done)
        at = text.find("@", max(at + 1, done))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def addresses(text: str) -> Iterator[Span]:
    for m in ADDRESS.finditer(text):
        if all(map(small, m[0].split("."))):
            yield Span("ip", *m.span())


def digit_runs(text: str) -> Iterator[tuple[Span, bool]]:
    """Runs of at least as many digits as a card has, and whether the run as a whole is one."""
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= min(ADDED_CARD_DIGITS):
            digits = digits_of(m[0])
            yield Span("card", *m.span()), len(digits) in CARD_DIGITS and passes_luhn(digits)


def phones(text: str) -> Iterator[tuple[Span, bool]]:
    for m in PHONE.finditer(text):
        yield Span("phone", *m.span()), len(digits_of(m[0])) in PHONE_DIGITS


def cards_within(text: str, run: Span) -> Iterator[Proposal]:
    """Cards between separators of a run: from the left, the longest first."""
    groups = list(GROUP.finditer(text, run.start, run.end))
    first = 0
    while first < len(groups):
        sizes, total, best = [], 0, None
        may_open = groups[first][0][0] in "23456"
        for last in range(first, len(groups) if may_open else first):
            sizes.append(groups[last].end() - groups[last].start())
            total += sizes[-1]
            if total > max(ADDED_CARD_DIGITS):
                break
            if total in ADDED_CARD_DIGITS:
                start, end = groups[first].start(), groups[last].end()
                digits = digits_of(text[start:end])
                if passes_luhn(digits):
                    printed = tuple(sizes) in CARD_GROUPS
                    best = last, Proposal(Span("card", start, end), SHAPE_SCORE["card"] if printed else ODD_CARD)
        if best:
            yield best[1]
        first = best[0] + 1 if best else first + 1


def phone_within(text: str, run: Span) -> Iterator[Proposal]:
    """The longest beginning of a run, up to a separator, that is as long as a phone number."""
    total, end = 0, None
    for group in GROUP.finditer(text, run.start, run.end):
        total += group.end() - group.start()
        if total > max(PHONE_DIGITS):
            break
        if total in PHONE_DIGITS:
            end = group.end()
    if end:
        yield Proposal(Span("phone", run.start, end), SHAPE_SCORE["phone"])


def accounts(text: str) -> Iterator[Proposal]:
    for m in ACCOUNT.finditer(text):
        size = ACCOUNT_SIZES.get(m[0][:2])
        places = [i for i, c in enumerate(m[0]) if c not in " -"]
        if not size or len(places) < size:
            continue
        end = places[size - 1] + 1
        whole = len(places) == size or m[0][end] in " -"
        if whole and passes_mod97("".join(m[0][i] for i in places[:size])):
            yield Proposal(Span("iban", m.start(), m.start() + end), SHAPE_SCORE["iban"])


def security_numbers(text: str) -> Iterator[Proposal]:
    for m in SECURITY.finditer(text):
        area, group, serial = m[1], m[3], m[4]
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield Proposal(Span("ssn", *m.span()), SHAPE_SCORE["ssn"])


def with_context(text: str, span: Span, score: float) -> float:
    """The score after the words nearby, between 0 and 1."""
    before = text[max(span.start - BEFORE, 0) : span.start]
    near = set(NEARBY.findall(f"{before} {text[span.end : span.end + AFTER]}".lower()))
    score += MORE * bool(near & CONTEXT[span.kind]) - LESS * bool(near & OTHER_NUMBERS)
    return round(min(max(score, 0.0), 1.0), 2)


def spans_of(text: str) -> list[dict]:
    """All spans of a text by start, then kind, then end."""
    base, proposals = [], []
    base += emails(text)
    base += addresses(text)
    for run, whole in digit_runs(text):
        if whole:
            base.append(run)
        else:
            proposals += cards_within(text, run)
    for run, whole in phones(text):
        if whole:
            base.append(run)
        else:
            proposals += phone_within(text, run)
    proposals += accounts(text)
    proposals += security_numbers(text)
    out = [(s, True, with_context(text, s, SHAPE_SCORE[s.kind])) for s in base]
    for p in proposals:
        score = with_context(text, p.span, p.score)
        if score >= LEAST_SCORE:
            out.append((p.span, False, score))
    out.sort(key=lambda f: (f[0].start, KINDS.index(f[0].kind), f[0].end))
    return [{**span._asdict(), "base": known, "score": score} for span, known, score in out]


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, spans): every whole text and the array of its spans (kind, start, end, base, score)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [spans_of(t) if t else [] for t in batch.column(1).to_pylist()]
            columns = [*batch.columns, pa.array(found, ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, text, "spans"])

    chosen = docs.select(key, text)
    return chosen.mapInArrow(work, T.StructType([*chosen.schema.fields, T.StructField("spans", SPANS)]))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with the kind of each span, in brackets, in its place; of overlapping spans the first counts."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cover(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(state["out"]).alias("out")
        )

    return F.aggregate(
        spans, first, cover, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )
