"""Topic discovery: every text and word is used, and unseen texts become likelier."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import discovery
from corpuslens.plans import lookups

KEYS = ["row_id"]
THEMES = ["red green blue pink", "cat dog bird fish", "rain snow wind sun"]


def themed(n, seed=1, words=12):
    drawn = random.Random(seed)
    texts = []
    for i in range(n):
        main = THEMES[i % 3].split()
        texts.append(" ".join(drawn.choice(main if drawn.random() < 0.9 else ["the", "of", f"rare{'abcdef'[i % 6]}"]) for _ in range(words)))
    return texts


def leading(found):
    topics = {}
    for r in found.collect():
        topics.setdefault(r["topic"], []).append((r["rank"], r["token"]))
    return {k: [t for _, t in sorted(v)] for k, v in topics.items()}


def test_topics_are_the_themes(spark, long_of):
    long = long_of(themed(90) + [None, "", "12 34"])
    found = leading(discovery.discover_topics(long, KEYS, n_topics=3, n_terms=4, iterations=8))
    assert sorted(sorted(t) for t in found.values()) == sorted(sorted(t.split()) for t in THEMES)


def test_same_rows_give_the_same_topics(spark, long_of):
    long = long_of(themed(30))
    one = discovery.discover_topics(long.coalesce(1), KEYS, n_topics=2, n_terms=5, iterations=2)
    many = discovery.discover_topics(long.repartition(7), KEYS, n_topics=2, n_terms=5, iterations=2)
    assert leading(one) == leading(many)


def test_every_text_and_word_counts(spark, long_of, monkeypatch):
    texts = themed(30) + ["zebra", "zebra zebra the", None, ""]
    long = long_of(texts)
    counts = Counter(w for t in texts if t for w in t.split())
    for broadcast in (True, False):
        with monkeypatch.context() as m:
            m.setattr(discovery, "fits_broadcast", lambda *a, **k: broadcast)
            model = discovery.fit_topics(long, KEYS, n_topics=2, iterations=1, weighted=False)
        carried = {r["token"]: sum(r[n] for n in model.names) - 2 * model.word_prior for r in model.words.collect()}
        assert carried == pytest.approx({w: float(c) for w, c in counts.items()})
        shares = discovery.topic_shares(long, KEYS, model, updates=1).collect()
        sizes = {r["row_id"]: sum(r[f"g{k}"] for k in range(2)) - 1.0 for r in shares}
        assert sizes == pytest.approx({i: float(len(t.split())) for i, t in enumerate(texts) if t})


def test_one_round_against_brute_force(spark, long_of):
    texts = themed(12)
    model = discovery.fit_topics(long_of(texts), KEYS, n_topics=2, iterations=0, weighted=False)
    start = {r["token"]: [r["w0"], r["w1"]] for r in model.words.collect()}
    totals = [sum(v[k] for v in start.values()) for k in range(2)]
    assert model.totals() == pytest.approx(totals)

    def psi(x):
        return math.lgamma(x + 1e-5) / 2e-5 - math.lgamma(x - 1e-5) / 2e-5

    found = {r["row_id"]: [r["g0"], r["g1"]] for r in discovery.topic_shares(long_of(texts), KEYS, model, 1).collect()}
    for i, text in enumerate(texts):
        due = [0.5, 0.5]
        for w in text.split():
            raw = [math.exp(psi(start[w][k]) - psi(totals[k])) for k in range(2)]
            due = [d + r / sum(raw) for d, r in zip(due, raw)]
        assert found[i] == pytest.approx(due, rel=1e-5)


def test_held_out_texts_become_likelier(spark, long_of):
    train, held_out = long_of(themed(120, seed=2)), long_of(themed(40, seed=3, words=30))
    found = [
        discovery.perplexity(held_out, KEYS, discovery.fit_topics(train, KEYS, 3, rounds, weighted=False), updates=4)
        for rounds in (0, 8)
    ]
    one = discovery.perplexity(held_out, KEYS, discovery.fit_topics(train, KEYS, 1, 1, weighted=False), updates=1)
    assert found[1] < 0.75 * found[0] and found[1] < 0.75 * one
    assert discovery.perplexity(held_out.where("row_id < 0"), KEYS, discovery.fit_topics(train, KEYS, 2, 0), updates=1) is None


def test_empty_corpus(spark, long_of):
    assert discovery.discover_topics(long_of([None, ""]), KEYS, iterations=2).count() == 0


def test_digamma(spark):
    known = {0.5: -1.9635100260214235, 1.0: -0.5772156649015329, 2.0: 0.42278433509846713, 10.0: 2.251752589066721}
    rows = spark.createDataFrame([(v,) for v in known], "x double").select(discovery.digamma(F.col("x")).alias("d")).collect()
    for due, row in zip(known.values(), rows):
        assert row["d"] == pytest.approx(due, abs=1e-8)


def test_common_words_are_not_shuffled(spark, long_of, monkeypatch):
    texts = themed(40) + ["rare one", "rare two", None]
    one = discovery.fit_topics(long_of(texts), KEYS, n_topics=2, iterations=2)
    assert one.broadcast
    monkeypatch.setattr(discovery, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(discovery, "COMMON", 12)
    two = discovery.fit_topics(long_of(texts), KEYS, n_topics=2, iterations=2)
    found = {r["token"]: r["common"] for r in two.words.select("token", "common").collect()}
    counts = Counter(w for t in texts if t for w in set(t.split()))
    assert {w for w, common in found.items() if common} == set(sorted(counts, key=lambda w: (-counts[w], w))[:12])
    carried = [{r["token"]: [r["w0"], r["w1"]] for r in m.words.collect()} for m in (one, two)]
    assert carried[0].keys() == carried[1].keys()
    assert all(carried[0][w] == pytest.approx(carried[1][w]) for w in carried[0])
    terms = discovery.text_terms(long_of(texts), KEYS)
    joined = discovery.with_words(terms, ["row_id", "field"], two.words, False)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan
    due = Counter((i, w) for i, t in enumerate(texts) if t for w in t.split())
    assert {(r["row_id"], r["token"]): r["tf"] for r in joined.collect()} == due


def test_old_shuffles_go_between_rounds(spark, long_of, monkeypatch):
    calls = []
    monkeypatch.setattr(discovery, "sweep", lambda s: calls.append(1), raising=False)
    discovery.fit_topics(long_of(themed(6)), KEYS, n_topics=2, iterations=2)
    assert len(calls) >= 4
