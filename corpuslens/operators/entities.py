"""Private entities: shapes, check digits, and names from a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.functions import checksums
from corpuslens.functions.text import explode_rows, tokens
from corpuslens.functions.words import one_of
from corpuslens.operators.longform import FIELDS, attach, to_long
from corpuslens.plans.lookups import known_words, lookup_join

VALID, SHAPE, WEAK = 1.0, 0.85, 0.4

# The entities that can be selected, by group, in order.
CATALOGUE = {
    "Documents": ["US_DRIVER_LICENSE", "AU_ABN", "AU_ACN", "AU_TFN", "IN_PAN", "IN_VEHICLE_REGISTRATION"],
    "Others": [
        "PHONE_NUMBER", "DATE_TIME", "MEDICAL_LICENSE", "EMAIL_ADDRESS", "ORGANIZATION", "URL",
        "CRYPTO", "UK_NHS", "BAN_CODE",
    ],
    "Credit Cards": ["CREDIT_CARD", "US_ITIN", "US_BANK_NUMBER", "AU_TFN", "IBAN_CODE"],
    "Personal Identification": ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER"],
    "Location": ["LOCATION", "IP_ADDRESS"],
}


@dataclass(frozen=True)
class Rule:
    """A shape, the confidence in it, and what else must hold.

    ``needs`` are strings of which a text must contain one; without any, it must hold a digit. Where a match
    fails its check, the first group of ``shorter`` in it is tried, that is, the match without its last group.
    """

    expression: str
    score: float
    check: Callable[[Column], Column] | None = None
    context: str | None = None
    needs: tuple[str, ...] = ()
    shorter: str | None = None


# ASCII digits only, and no look-around, so that the shapes mean the same in any engine.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
RULES = {
    "US_DRIVER_LICENSE": Rule(r"\b[A-Z][0-9]{7,12}\b", WEAK, context="(?i)licen[sc]e|driver"),
    "AU_ABN": Rule(r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", VALID, checksums.au_abn),
    "AU_ACN": Rule(r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", VALID, checksums.au_acn),
    "AU_TFN": Rule(r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", VALID, checksums.au_tfn),
    "IN_PAN": Rule(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", SHAPE),
    "IN_VEHICLE_REGISTRATION": Rule(r"\b[A-Z]{2} ?[0-9]{1,2} ?[A-Z]{1,3} ?[0-9]{4}\b", WEAK),
    "PHONE_NUMBER": Rule(
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b|\+[0-9]{10,15}\b",
        SHAPE,
    ),
    "DATE_TIME": Rule(
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b"
        r"|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b|\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b",
        SHAPE,
    ),
    "MEDICAL_LICENSE": Rule(r"\b[A-Z]{2}[0-9]{7}\b", VALID, checksums.medical_license),
    "EMAIL_ADDRESS": Rule(r"[A-Za-z0-9._+\-\']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", SHAPE, needs=("@",)),
    "URL": Rule(
        r"\bhttps?://[^\s<>\"']+|\bwww\.[^\s<>\"']+", SHAPE, needs=("http://", "https://", "www.")
    ),
    "CRYPTO": Rule(r"\b(?:bc1[a-z0-9]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b", WEAK),
    "UK_NHS": Rule(r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b", VALID, checksums.uk_nhs),
    "CREDIT_CARD": Rule(
        r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3}\b"
        r"|\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"
        r"|\b[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5}\b|\b[0-9]{13,19}\b",
        VALID,
        checksums.luhn,
        shorter=r"^((?:[0-9]{4}[ -]){3}[0-9]{4})[ -][0-9]{3}$",
    ),
    "US_ITIN": Rule(
        r"\b9[0-9]{2}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])-[0-9]{4}\b", SHAPE
    ),
    "US_BANK_NUMBER": Rule(r"\b[0-9]{8,17}\b", WEAK, context="(?i)account|bank"),
    "IBAN_CODE": Rule(
        r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b|\b[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?\b",
        VALID,
        checksums.iban,
        shorter=r"^(.*) [A-Z0-9]{1,4}$",
    ),
    "IP_ADDRESS": Rule(
        rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b|\b(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}\b",
        SHAPE,
        needs=(":", "0.", "1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9."),
    ),
}
NAMED = ("ORGANIZATION", "PERSON", "LOCATION")
# BAN_CODE can be selected, has no known definition, and so finds nothing.
ENTITIES = list(dict.fromkeys(e for group in CATALOGUE.values() for e in group))
FINDING = "array<struct<entity:string,text:string,score:double>>"


def select_entities(selected: list[str] | None = None) -> list[str]:
    """Nothing selected means everything; the overlapping groups count once."""
    unknown = set(selected or ()) - set(ENTITIES)
    if unknown:
        raise ValueError(f"unknown entities {sorted(unknown)}")
    return [e for e in ENTITIES if not selected or e in selected]


def check_names(names: DataFrame | None, selected: list[str] | None) -> None:
    """Refuse a choice of named entities without a table of names, which would find nothing."""
    asked = sorted(set(selected or ()) & set(NAMED))
    if names is None and asked:
        raise ValueError(f"{asked} need a table of names")


def _found_by(entity: str, text: Column) -> Column:
    rule = RULES[entity]
    found = F.regexp_extract_all(text, F.lit(rule.expression), F.lit(0))
    if rule.shorter:
        found = F.transform(
            found, lambda m: F.when(rule.check(m), m).otherwise(F.regexp_extract(m, rule.shorter, 1))
        )
    if rule.check:
        found = F.filter(found, rule.check)
    described = F.transform(
        found,
        lambda m: F.struct(
            F.lit(entity).alias("entity"), m.alias("text"), F.lit(rule.score).alias("score")
        ),
    )
    conditions = [text.contains(s) for s in rule.needs]
    if rule.context:
        conditions = [text.rlike(rule.context)]
    if conditions:
        described = F.when(reduce(Column.__or__, conditions), described)
    return F.coalesce(described, F.array().cast(FINDING))


def shape_entities(text: Column, selected: list[str] | None = None) -> Column:
    """The findings by shape as an array, in catalogue order; only selected rules are run."""
    rules = [e for e in select_entities(selected) if e in RULES]
    free = [_found_by(e, text) for e in rules if RULES[e].needs]
    numeric = [_found_by(e, text) for e in rules if not RULES[e].needs]
    none = F.array().cast(FINDING)
    with_digit = F.when(text.rlike("[0-9]"), F.concat(none, *numeric)).otherwise(none)
    return F.concat(none, *free, with_digit)


def named_entities(
    long: DataFrame, keys: list[str], names: DataFrame, selected: list[str] | None = None
) -> DataFrame:
    """(keys, field, entity, text, score): names found in the token order, whatever their length.

    First words of names leave the token array with as many successors as the longest name has and
    meet the table, so a text is exploded once.
    """
    wanted = [e for e in select_entities(selected) if e in NAMED]
    parts = tokens(F.col("name"))
    lookup = (
        names.where(F.col("entity").isin(*wanted))
        .select("entity", parts.alias("n"))
        .where(F.size("n") > 0)
        .select("entity", "n", F.get("n", F.lit(0)).alias("name0"))
        .distinct()
    )
    longest = lookup.agg(F.max(F.size("n"))).first()[0] or 1
    group = [*keys, "field"]
    split = long.select(*group, tokens(F.col("text")).alias("t"))
    known = one_of("t[i]", known_words(lookup, "name0"))
    places = F.expr(f"CASE WHEN size(t) > 0 THEN filter(sequence(0, size(t) - 1), i -> {known}) END")
    with_next = F.transform(
        "places",
        lambda i: F.struct(
            F.get("t", i).alias("name0"), F.slice("t", i + 1, F.lit(longest)).alias("here")
        ),
    )
    placed = split.select(*group, "t", places.alias("places"))
    words = explode_rows(placed, group, with_next, "w").select(*group, "w.*")
    met = lookup_join(words, lookup, ["name0"], "inner", group)
    return met.where(F.slice("here", F.lit(1), F.size("n")) == F.col("n")).select(
        *group,
        "entity",
        F.array_join("n", " ").alias("text"),
        F.lit(WEAK).alias("score"),
    )


def extract_entities(
    long: DataFrame,
    keys: list[str],
    names: DataFrame | None = None,
    selected: list[str] | None = None,
) -> DataFrame:
    """(keys, field, pos, entity, text, score), one row per finding; pos is null for names."""
    findings = F.transform(
        shape_entities(F.col("text"), selected),
        lambda x, i: F.struct(i.alias("pos"), x["entity"], x["text"], x["score"]),
    )
    check_names(names, selected)
    group = [*keys, "field"]
    by_shape = explode_rows(long, group, findings, "x").select(*group, "x.*")
    if names is None or not set(select_entities(selected)) & set(NAMED):
        return by_shape
    by_name = named_entities(long, keys, names, selected)
    return by_shape.unionByName(by_name, allowMissingColumns=True)


def render(findings: Column) -> Column:
    """``ENTITY: text`` joined by commas; an empty list gives an empty string."""
    return F.array_join(
        F.transform(findings, lambda x: F.concat(x["entity"], F.lit(": "), x["text"])), ", "
    )


def rendered_entities(
    long: DataFrame, keys: list[str], names: DataFrame | None = None, selected: list[str] | None = None
) -> DataFrame:
    """(keys, field, entities): the findings of a text as one string, empty without any."""
    check_names(names, selected)
    if names is None or not set(select_entities(selected)) & set(NAMED):
        entities = render(shape_entities(F.col("text"), selected))
        return long.select(*keys, "field", entities.alias("entities"))
    found = extract_entities(long, keys, names, selected).select(
        *keys, "field", F.struct("pos", "entity", "text").alias("x")
    )
    every = long.select(*keys, "field").withColumn("x", F.lit(None))
    gathered = found.unionByName(every).groupBy(*keys, "field").agg(F.collect_list("x").alias("x"))
    return gathered.select(*keys, "field", render(F.array_sort("x")).alias("entities"))


def analyze_entities(
    pairs: DataFrame,
    selected: list[str] | None = None,
    fields: tuple[str, ...] = FIELDS,
    keys: list[str] | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Pairs plus ``prompt_pii`` and ``response_pii``, arrays of findings.

    Findings by shape are made in the row. With ``keys`` and a table of ``names``, the names found
    in a text are joined to them; the list of one text is all that is gathered.
    """
    check_names(names, selected)
    result = pairs.withColumns({f"{f}_pii": shape_entities(F.col(f), selected) for f in fields})
    if names is None or not set(select_entities(selected)) & set(NAMED):
        return result
    found = named_entities(to_long(pairs, keys, fields), keys, names, selected)
    finding = F.struct("entity", "text", "score")
    gathered = found.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("field") == f, finding))).alias(f"_{f}") for f in fields]
    )
    none = F.array().cast(FINDING)
    both = {
        f"{f}_pii": F.concat(f"{f}_pii", F.coalesce(F.col(f"_{f}").cast(FINDING), none)) for f in fields
    }
    return attach(result, gathered, keys).withColumns(both).drop(*[f"_{f}" for f in fields])
