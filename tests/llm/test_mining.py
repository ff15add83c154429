"""Hard negatives, collocations and personal data against brute force, and the cases each must take."""

import collections
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from checks.compare import connect, differences
from pyspark.sql import functions as F

from corpuslens.llm import negatives, personal, phrases, queries
from corpuslens.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_as_its_sql(spark, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert differences(ours, connect(SF).execute(ORACLE[name]).df()) == []


# Hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=5, percent=80):
    out = []
    for anchor in anchors:
        scores = [
            (sum(int(a) * int(b) for a, b in zip(anchor[1], r[1])), r)
            for r in rows
            if r[0] != anchor[0] and len(r[1]) == len(anchor[1])
        ]
        scores.sort(key=lambda s: (-s[0], s[1][0]))
        best = [s for s in scores if s[1][2] == anchor[2]][:positives]
        for most, positive in best:
            hard = [s for s in scores if s[1][2] != anchor[2] and percent * most <= 100 * s[0] <= 100 * most]
            for rank, (score, row) in enumerate(hard[:negatives], 1):
                out.append((anchor[0], positive[0], rank, row[0], most, score))
    return sorted(out)


def mined(df, **options):
    found = negatives.mine_negatives(df, F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


KIND = "vec_id bigint, embedding array<float>, label int"


def test_negatives_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PART_ROWS", 60)
    monkeypatch.setattr(negatives, "STRIP_ROWS", 7)
    drawn = np.random.default_rng(3)
    middle = drawn.standard_normal((4, 6))
    rows = []
    for i in range(300):
        label = int(drawn.integers(4))
        rows.append((i, (middle[label] + 0.6 * drawn.standard_normal(6)).astype(np.float32).tolist(), label))
    for i in range(300, 360):  # copies: every score is a tie
        rows.append((i, rows[5][1], i % 2))
    rows += [(i, [0.5, -0.25], i % 2) for i in range(400, 430)]  # another dimension
    rows += [(440, [], 1), (450, [], 1), (451, [], 2)]
    odd = [(460, None, 1), (470, [1.0] * 6, None), (480, [float("nan")] * 6, 1), (490, [None] * 6, 1),
           (500, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows + odd, KIND).withColumn("rank", F.lit("x")).withColumn("row", F.lit(1))
    whole = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows]
    assert mined(df) == brute_negatives(whole, [r for r in whole if r[0] % 10 == 0])
    some = [r for r in whole if r[0] < 300]
    due = brute_negatives(some, [r for r in some if r[0] % 10 == 0], positives=2, negatives=3, percent=60)
    assert mined(df.where("vec_id < 300"), positives=2, negatives=3, percent=60) == due and len(due) > 20


def test_negatives_repeats_and_empty(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2)]
    df = spark.createDataFrame(rows, KIND)
    assert mined(df) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 2, 65536, 58880)]
    assert mined(df.where("vec_id < 0")) == [] and mined(df.where("vec_id > 0")) == []
    assert mined(df.where("label = 1")) == []


def test_negatives_beyond_double_precision(spark):
    drawn = random.Random(2)
    rows = [(i, [float(drawn.randint(-9, 9)) * 2.0**18 + drawn.randint(0, 99) for _ in range(4)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    whole = [(i, [int(256 * x) for x in v], label) for i, v, label in rows]
    assert mined(df) == brute_negatives(whole, [r for r in whole if r[0] % 10 == 0])
    assert any(row[4] > 2**53 for row in mined(df))


def test_bounds_spare_scores_and_stay_few():
    drawn = np.random.default_rng(5)
    vectors = drawn.standard_normal((500, 8)) + 4 * drawn.standard_normal((10, 8))[np.arange(500) % 10]
    order, parent, length = negatives.spanning_tree(np.floor(256 * vectors))
    assert sorted(order) == list(range(500)) and (parent < 0).sum() == 1
    gaps = np.linalg.norm(np.floor(256 * vectors)[1:] - np.floor(256 * vectors)[parent[1:]], axis=1)
    assert np.allclose(length[1:], gaps)
    seen, kept, widest = set(), set(), 0
    for node, done in negatives.depth_first(order, parent):
        assert parent[node] < 0 or parent[node] in kept
        seen.add(node)
        kept.add(node)
        kept -= set(done)
        widest = max(widest, len(kept))
    assert seen == set(range(500)) and not kept and widest <= 11
    chain = np.arange(499, -1, -1)
    for shape in (np.arange(-1, 499), np.where(np.arange(500) % 2, np.arange(500) - 1, np.arange(500) - 2)):
        shape = np.maximum(shape, -1)
        assert len([n for n, _ in negatives.depth_first(chain[::-1], shape)]) == 500


# Collocations


def brute_collocations(rows, least=10, percent=50, most=3):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, most + 1):
                counts.update((lang or "und", *words[i : i + n]) for i in range(len(words) - n + 1))
    out = collections.defaultdict(list)
    whole = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    for p, a in whole.items():
        cuts = [(10**6 * a * a // (counts[p[: k + 1]] * counts[p[:1] + p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        longer = [
            b for q, b in whole.items() if len(q) > len(p) and q[0] == p[0]
            and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q)))
        ]
        if not any(100 * b >= percent * a for b in longer):
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), counts[p[: k + 1]], counts[p[:1] + p[k + 1 :]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(found), 1)
    )


def phrase_rows():
    drawn = random.Random(4)
    rows = []
    for i in range(250):
        words = [drawn.choice("ab cd Ef gh é ij Éa".split()) for _ in range(drawn.randint(0, 30))]
        text = "".join(w + drawn.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  ", "\x0b"]) for w in words)
        rows.append((i, text, drawn.choice(["en", "de", None])))
    rows += [(900, None, "en"), (901, "", "fr"), (902, " \t ", None), (903, "lone lone", "fr")]
    rows += [(904, "rare pair " * 30 + "é🎉 ｘ", "es")] * 2 + [(905, "x" * 300_000, "en"), (906, "a " * 50_000, "long")]
    return rows


@pytest.mark.parametrize("segment,mass", [(1_000_000, 4_000_000), (500, 700)])
def test_collocations_as_brute_force(spark, monkeypatch, segment, mass):
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    monkeypatch.setattr(phrases, "PARTITION_MASS", mass)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    df = df.withColumns({"phrase": F.lit("p"), "words": F.lit(7), "f": F.lit(0), "language": F.lit("q")})
    given = [(text, lang) for _, text, lang in rows]
    for most in (3, 4):
        found = sorted(tuple(r) for r in phrases.collocations(df, most=most, top=None).collect())
        assert found == brute_collocations(given, most=most)
    few = [tuple(r) for r in phrases.collocations(df, top=2).collect()]
    assert sorted(few) == [r for r in brute_collocations(given) if r[1] <= 2]
    assert phrases.collocations(df.where("doc_id < 0")).count() == 0


def test_summaries_keep_every_frequent_key():
    drawn = np.random.default_rng(1)
    for least in (5, 10, 40):
        keys = np.minimum(drawn.zipf(1.3, 20_000), 5_000).astype(np.uint32)
        capacity = len(keys) // least + 1
        merged = phrases.Summary(capacity)
        for part in np.array_split(keys, 23):
            merged.merge(*np.unique(part, return_counts=True))
            assert len(merged.keys) <= capacity
        counts = collections.Counter(keys.tolist())
        assert merged.error < least
        for key, count in zip(merged.keys.tolist(), merged.counts.tolist()):
            assert count <= counts[key] <= count + merged.error
        kept = set(merged.at_least(least).tolist())
        assert {key for key, count in counts.items() if count >= least} <= kept


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d))))
    return total % 10 == 0


FITS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)),
    "phone": lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15,
}


def base_spans(text):
    found = [
        (m.start(), k, m.end())
        for k, (kind, shape) in enumerate(BASE.items())
        for m in re.finditer(shape, text)
        if FITS[kind](m[0])
    ]
    return [(list(BASE)[k], start, end) for start, k, end in sorted(found)]


def personal_text(drawn):
    parts = [
        "4111 1111 1111 1111", "4111111111111112", "378282246310005", "3056 930902 5904", "+1 (578) 555-6437",
        "+49 170", "a.b%c@x-y.example.com", "a@b@c.d", "@", "x@y", "192.168.0.254", "1.2.3.4.5.6.7.8.9", "256.1.1.1",
        "0000.01.2.3", "12", "7", " ", "-", "  ", ".", "🎉", "é", "text", "+", "(", "GB82 WEST 1234 5698 7654 32",
    ]
    return "".join(drawn.choice(parts) + drawn.choice(["", " ", "-"]) for _ in range(drawn.randint(0, 25)))


def test_personal_base_as_brute_force():
    drawn = random.Random(8)
    for _ in range(3000):
        text = personal_text(drawn)
        spans = personal.spans_of(text)
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == base_spans(text)
        for a, b in itertools.combinations(spans, 2):
            assert a["kind"] != b["kind"] or a["end"] <= b["start"]


@pytest.mark.parametrize(
    "text,found",
    [
        ("+1 (578) 555-6437 4918187128635271", [("phone", 0, 17), ("card", 18, 34)]),
        ("iban GB82 WEST 1234 5698 7654 32.", [("iban", 5, 32)]),
        ("iban GB82 WEST 1234 5698 7654 33.", []),
        ("DE89370400440532013000", [("iban", 0, 22)]),
        ("card 3056 930902 5904", [("card", 5, 21)]),
        ("my ssn is 123-45-6789", [("ssn", 10, 21)]),
        ("code 123-45-6789", []),
        ("ssn 666-45-6789 000-12-3456 123-00-4567", []),
        ("version 1.2.3.4", [("ip", 8, 15)]),
    ],
)
def test_personal_added_spans(text, found):
    assert [(s["kind"], s["start"], s["end"]) for s in personal.spans_of(text)] == found


def test_words_nearby_move_the_score():
    def score(text):
        return personal.spans_of(text)[0]["score"]

    assert score("server 10.0.0.1") > score("10.0.0.1") > score("release version 10.0.0.1")
    ssn = personal.security_numbers("123-45-6789")
    assert next(ssn).score < personal.LEAST_SCORE


def test_personal_long_runs_take_linear_time():
    for text in ("a", "@", "1", "1.", "1 ", "+1 ", "a@", "A", "AB12", "b.", "(", "é", "12-"):
        long = text * (200_000 // len(text))
        start = time.time()
        personal.spans_of(long)
        assert time.time() - start < 8, text
    start = time.time()
    personal.spans_of("a@" + "b." * 100_000 + "+1" + " " * 100_000)
    assert time.time() - start < 5


def test_personal_table(spark):
    texts = [None, "", "mail a@b.cd", "mail a@b.cd", "nothing", "🎉 +1 578 555 6437"]
    rows = [(i // 2, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `my kind` string")
    found = personal.find_personal(df.withColumn("spans", F.lit(1)).withColumn("kind", F.lit(1)))
    done = found.select(
        "doc_id", "text", personal.written(F.col("spans")), personal.masked(F.col("text"), F.col("spans"))
    )
    due = [
        (0, None, "", None), (0, "", "", ""), (1, "mail a@b.cd", "email:5:11", "mail [email]"),
        (1, "mail a@b.cd", "email:5:11", "mail [email]"), (2, "nothing", "", "nothing"),
        (2, "🎉 +1 578 555 6437", "phone:2:17", "🎉 [phone]"),
    ]
    assert sorted(map(str, map(tuple, done.collect()))) == sorted(map(str, due))
    assert personal.find_personal(df.where("doc_id < 0")).count() == 0
