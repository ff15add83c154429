import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import readability, summary, views
from corpuslens.operators.longform import to_metrics
from corpuslens.plans.quantiles import exact_brackets, exact_quantiles, last_rows
from corpuslens.plans.session import materialize

KEYS = ["row_id"]
SCHEMA = "row_id bigint, field string, metric string, value double"


def score_table(spark, values, metric="m"):
    return spark.createDataFrame([(i, "prompt", metric, v) for i, v in enumerate(values)], SCHEMA)


def test_summary_skips_null_and_nan(spark):
    wide = spark.createDataFrame([(1, "prompt", 0.5), (2, "prompt", float("nan")), (3, "prompt", None), (4, "prompt", 1.5)], "row_id bigint, field string, s double")
    row = summary.score_summary(to_metrics(wide, KEYS, ["s"])).first()
    assert (row["n"], row["max"], row["mean"]) == (2, 1.5, 1.0)
    assert row["std"] == pytest.approx(math.sqrt(0.5))


def test_one_row_and_no_value(spark):
    assert summary.score_summary(score_table(spark, [2.0])).first()["std"] is None
    row = summary.score_summary(score_table(spark, [None])).first()
    assert (row["n"], row["max"]) == (0, None)


def test_histogram(spark):
    values = [0.0, 0.01, 0.02, 0.5, 0.999, 1.0, 1.0, None]
    rows = {r["bin"]: r for r in summary.histogram(score_table(spark, values)).collect()}
    assert {b: r["n"] for b, r in rows.items()} == {1: 2, 2: 1, 26: 1, 50: 3}
    assert rows[50]["high"] == 1.0 and rows[2]["low"] == pytest.approx(0.02)


def test_histogram_of_a_constant(spark):
    row, = summary.histogram(score_table(spark, [3.0] * 5)).collect()
    assert (row["bin"], row["low"], row["n"]) == (1, 3.0, 5)
    assert summary.histogram(score_table(spark, [None])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 100])
def test_quantiles_of_small_groups(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    found = exact_quantiles(score_table(spark, values.tolist()), ["metric"], summary.QUARTILES).collect()
    for r in found:
        assert r["quantile"] == pytest.approx(np.quantile(values, r["probability"]), abs=1e-12)
    assert len(found) == 5


@pytest.mark.parametrize("kind", ["smooth", "third", "outlier"])
def test_quantiles_of_large_groups(spark, kind):
    """Groups large enough for the sketch brackets, with a hot value and with an outlier."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=60_000)
    if kind == "third":
        values[:20_000] = 0.25
    if kind == "outlier":
        values[0] = 1e12
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"value": values})).repartition(8).withColumn("metric", F.lit("m"))
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    for r in exact_quantiles(df, ["metric"], probabilities).collect():
        assert r["quantile"] == pytest.approx(np.quantile(values, r["probability"]), abs=1e-9)


@pytest.mark.parametrize("kind", ["smooth", "steps", "powers"])
def test_quantiles_by_many_rounds(spark, kind):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    values = {
        "smooth": rng.normal(size=9_000),
        "steps": rng.integers(0, 4, size=9_000).astype(float),
        "powers": 10.0 ** rng.uniform(-300, 300, size=9_000),
    }[kind]
    table = pa.table({"value": values, "metric": np.where(np.arange(9_000) % 3, "a", "b")})
    df = spark.createDataFrame(table).repartition(5)
    probabilities = [0.0, 0.0001, 0.1, 0.25, 0.3333, 0.5, 0.75, 0.9, 0.9999, 1.0]
    rows = exact_quantiles(df, ["metric"], probabilities, few=15).collect()
    assert len(rows) == 20
    for r in rows:
        group = values[(np.arange(9_000) % 3 > 0) == (r["metric"] == "a")]
        assert r["quantile"] == pytest.approx(np.quantile(group, r["probability"]), rel=1e-9)


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_the_last_step_ranks_a_fixed_number_of_rows(spark, n):
    df = spark.range(0, n, 1, 6).select(F.lit("m").alias("metric"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("value"))
    df = materialize(df)
    brackets = exact_brackets(df, ["metric"], summary.QUARTILES, few=100)
    ranked = last_rows(df, brackets, ["metric"])
    assert ranked.groupBy("probability").count().agg(F.max("count")).first()[0] <= 100 + 3


def test_fences(spark):
    row = summary.quartiles(score_table(spark, [1.0, 2.0, 3.0, 4.0, 5.0])).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["lower_fence"], row["upper_fence"]) == (-1.0, 7.0)


def test_density_integrates_to_about_one(spark):
    values = np.random.default_rng(4).normal(size=2_000).tolist()
    rows = sorted(summary.density(score_table(spark, values)).collect(), key=lambda r: r["point"])
    assert len(rows) == 101
    area = np.trapezoid([r["density"] for r in rows], [r["x"] for r in rows])
    assert area == pytest.approx(1.0, abs=0.02)
    assert summary.density(score_table(spark, [1.0, 1.0])).count() == 0


def labels(spark, rows, name="label"):
    return spark.createDataFrame(rows, f"row_id bigint, field string, {name} string")


def test_counts_keep_null(spark):
    df = labels(spark, [(1, "prompt", "a"), (2, "prompt", None), (3, "prompt", "a"), (4, "response", None)])
    rows = {(r["field"], r["label"]): r["n"] for r in summary.label_counts(df, "label").collect()}
    assert rows == {("prompt", "a"): 2, ("prompt", None): 1, ("response", None): 1}


def test_top_label(spark):
    df = labels(spark, [
        (1, "prompt", None), (2, "prompt", None), (3, "prompt", None), (4, "prompt", "late"),
        (5, "prompt", "b"), (6, "prompt", "b"), (7, "prompt", "late"), (8, "response", None),
    ])
    rows = {r["field"]: (r["label"], r["n"]) for r in summary.top_label(df, KEYS, "label").collect()}
    assert rows == {"prompt": ("late", 2), "response": ("None", 0)}


def test_entity_summaries(spark):
    found = spark.createDataFrame(
        [(0, "prompt", 1, "URL"), (0, "prompt", 0, "EMAIL"), (1, "prompt", 0, "URL"), (1, "prompt", 1, "EMAIL"), (1, "prompt", 2, "IP")],
        "row_id bigint, field string, pos int, entity string",
    )
    filled = {(r["field"], r["entity"]): r["n"] for r in summary.entity_counts_filled(found).collect()}
    assert filled == {("prompt", "URL"): 2, ("prompt", "EMAIL"): 2, ("prompt", "IP"): 1, ("response", "No Entities"): 0}
    tops = {r["field"]: (r["entities"], r["n"]) for r in summary.top_entities(found, KEYS).collect()}
    assert tops == {"prompt": ("EMAIL, URL", 2), "response": ("None", 0)}


def test_unwrap(spark):
    df = spark.createDataFrame([([0.5],), ([],), (None,), ([0.1, 0.2],)], "s array<double>")
    assert [r["x"] for r in df.select(summary.unwrap(F.col("s")).alias("x")).collect()] == [0.5, None, None, 0.1]


@pytest.fixture(scope="module")
def common(table_of):
    return table_of(["token"], [("the",), ("over",), ("a",), ("o'clock",)])


def test_statistics_by_hand(spark, long_of, common):
    text = "The quick fox jumped over the lazy elephant. A banana fell! Why? It is the apple."
    counts = readability.text_counts(long_of([text]), ["row_id", "field"], common).first()
    # the1 quick1 fox1 jumped2 over2 the1 lazy2 elephant3 / a1 banana3 fell1 / why1 / it1 is1 the1 apple2
    assert (counts["words"], counts["sentences"], counts["syllables"]) == (16, 4, 24)
    assert (counts["polysyllables"], counts["monosyllables"], counts["difficult"]) == (2, 10, 5)
    assert counts["characters"] == len(text.replace(" ", ""))
    row = readability.score_readability(long_of([text]), KEYS, common).first()
    assert row["Flesch Reading Ease"] == pytest.approx(206.835 - 1.015 * 4 - 84.6 * 24 / 16)
    assert row["SMOG Index"] == pytest.approx(1.043 * math.sqrt(30 * 2 / 4) + 3.1291)
    assert row["Gunning Fog Index"] == pytest.approx(0.4 * (4 + 100 * 2 / 16))
    assert row["Linsear Write Formula"] == pytest.approx(((14 + 2 * 3) / 4 - 2) / 2)
    assert row["Dale-Chall Readability Score"] == pytest.approx(0.1579 * 31.25 + 0.0496 * 4 + 3.6365)
    assert row["Lexicon Count"] == 16


def test_statistics_of_odd_texts(spark, long_of, common):
    texts = [None, "", "   ", "12 34", "word", "no end here"]
    rows = {r["row_id"]: r for r in readability.score_readability(long_of(texts), KEYS, common).collect()}
    for i in (0, 1):
        assert all(rows[i][m] is None for m in readability.METRICS)
    for i in (2, 3):
        assert rows[i]["Lexicon Count"] == 0 and rows[i]["Flesch Reading Ease"] is None
    assert rows[3]["Character Count"] == 4 and rows[3]["Sentence Count"] == 1
    assert rows[4]["SMOG Index"] is None and rows[5]["Sentence Count"] == 1


def test_first_hundred_words(spark, long_of, common):
    text = "one two. " * 60 + "elephantine " * 30
    counts = readability.text_counts(long_of([text]), ["row_id"], common).first()
    assert (counts["first_words"], counts["first_sentences"], counts["first_hard"]) == (100, 49, 0)
    assert (counts["words"], counts["sentences"]) == (150, 60)


def test_text_standard_takes_the_lowest_of_a_tie(spark):
    df = spark.createDataFrame([(7.2, 3.1, 7.4, 2.9, None)], "a double, b double, c double, d double, e double")
    grade = readability._text_standard([F.col(c) for c in df.columns])
    assert df.select(grade.alias("g")).first()["g"] == 3.0


def test_wide_and_selected(spark, common):
    pairs = spark.createDataFrame([(1, "A word.", None)], "row_id bigint, prompt string, response string")
    wide = readability.analyze_readability(pairs, common)
    assert wide.columns == ["row_id", "prompt", "response"] + [f"Prompt {m}" for m in readability.METRICS] + [f"Response {m}" for m in readability.METRICS]
    row = wide.first()
    assert row["Prompt Lexicon Count"] == 2 and row["Response Lexicon Count"] is None


def test_word_list_is_bounded(spark, long_of, table_of):
    too_many = table_of(["token"], [(f"w{i}",) for i in range(readability.COMMON_WORDS + 1)])
    with pytest.raises(ValueError):
        readability.text_counts(long_of(["x"]), ["row_id"], too_many)


@pytest.fixture(scope="module")
def things(spark):
    rows = [(i, f"name {i % 3}", None if i == 4 else float(i % 5)) for i in range(12)]
    return spark.createDataFrame(rows, "row_id bigint, name string, value double")


def test_sort(things):
    found = [r["row_id"] for r in views.sort_table(things, "name", KEYS, descending=True).collect()]
    assert found == [2, 5, 8, 11, 1, 4, 7, 10, 0, 3, 6, 9]


@pytest.mark.parametrize(
    "filters, expected",
    [
        ([("name", "contains", "2")], [2, 5, 8, 11]),
        ([("value", "=", 3.0)], [3, 8]),
        ([("value", "!=", 0.0), ("name", "=", "name 0")], [3, 6, 9]),
        ([("value", "<", 1.0)], [0, 5, 10]),
        ([("value", "<=", 1.0), ("value", ">", 0.0)], [1, 6, 11]),
        ([("value", ">=", 4.0)], [9]),
        ([("value", "is blank", None)], [4]),
        ([], list(range(12))),
    ],
)
def test_filters(things, filters, expected):
    assert sorted(r["row_id"] for r in views.filter_table(things, *filters).collect()) == expected


def test_unknown_filter(things):
    with pytest.raises(ValueError):
        views.filter_table(things, ("name", "like", "x"))


def test_pages(things):
    assert [r["row_id"] for r in views.page(things, KEYS, 1).collect()] == [3, 4, 5]
    assert [r["row_id"] for r in views.page(things, KEYS, 1, views.DATASET_PAGE).collect()] == [10, 11]
    assert [r["row_id"] for r in views.page_after(things, "row_id", 5).collect()] == [6, 7, 8]
