"""Incremental results equal batch results, and a restart goes on where it stopped."""

import pytest
from pyspark.sql import functions as F

from corpuslens.data.tables import example_table, lexicon_table
from corpuslens.operators import similarity, topics
from corpuslens.operators.readability import METRICS, common_words, metric_values, score_readability
from corpuslens.operators.sentiment import score_sentiment
from corpuslens.operators.summary import score_summary
from corpuslens.operators.toxicity import learn_toxicity, prepare_toxicity, score_toxicity
from corpuslens.operators.longform import to_long
from corpuslens.plans import lookups
from corpuslens.streaming import incremental

KEYS = ["row_id"]
SCHEMA = "row_id bigint, field string, text string"


@pytest.fixture
def folders(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "out", "checkpoint")}


@pytest.fixture(scope="module")
def texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return documents.select(F.col("doc_id").alias("row_id"), F.lit("document").alias("field"), "text")


def add_files(texts, folder, low, high):
    texts.where(F.col("row_id").between(low, high - 1)).repartition(3).write.mode("append").parquet(folder)


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_append_and_restart(spark, texts, folders):
    common = common_words(texts)
    for low, high in ((0, 60), (60, 120)):
        add_files(texts, folders["in"], low, high)
        stream = incremental.read_stream(spark, folders["in"], SCHEMA, files_per_batch=2)
        scored = incremental.stateless_scores(stream, KEYS, common)
        incremental.append_scores(scored, folders["out"], folders["checkpoint"]).awaitTermination()
    batch = incremental.stateless_scores(texts.where("row_id < 120"), KEYS, common)
    assert rows(spark.read.parquet(folders["out"])) == rows(batch)


def test_running_summary(spark, texts, folders):
    common = common_words(texts)
    for low, high in ((0, 50), (50, 100)):
        add_files(texts, folders["in"], low, high)
        stream = incremental.read_stream(spark, folders["in"], SCHEMA, files_per_batch=2)
        scored = score_readability(stream, KEYS, common)
        incremental.running_summary(scored, KEYS, folders["out"], folders["checkpoint"]).awaitTermination()
        batch = score_summary(metric_values(score_readability(texts.where(F.col("row_id") < high), KEYS, common), KEYS))
        expected = {(r["field"], r["metric"]): r for r in batch.collect()}
        found = {(r["field"], r["metric"]): r for r in incremental.latest_summary(spark, folders["out"]).collect()}
        assert set(found) == set(expected) and len(found) == len(METRICS)
        for key, row in found.items():
            for name in ("n", "max", "mean", "std"):
                assert row[name] == pytest.approx(expected[key][name])


def test_scored_batches(spark, texts, folders):
    lexicon = lexicon_table(spark)
    for low, high in ((0, 40), (40, 90)):
        add_files(texts, folders["in"], low, high)
        stream = incremental.read_stream(spark, folders["in"], SCHEMA, files_per_batch=2)
        query = incremental.score_batches(
            stream, lambda batch: score_sentiment(batch, KEYS, lexicon), folders["out"], folders["checkpoint"]
        )
        query.awaitTermination()
    found = spark.read.parquet(folders["out"]).drop("batch")
    assert rows(found) == rows(score_sentiment(texts.where("row_id < 90"), KEYS, lexicon))


PAIR = "row_id bigint, prompt string, response string"


@pytest.fixture(scope="module")
def pairs(texts):
    return texts.select("row_id", F.col("text").alias("prompt"), F.reverse("text").alias("response"))


def send(pairs, folder, low, high, files=3):
    part = pairs.where(F.col("row_id").between(low, high - 1))
    part.repartition(files).write.mode("append").parquet(folder)


def test_pairs_sent_again_count_once_across_restarts(spark, pairs, folders):
    common = common_words(to_long(pairs, KEYS))
    # the second set of files holds pairs of the first, and some pairs twice
    for parts in (((0, 30), (20, 45)), ((10, 60), (50, 70))):
        for low, high in parts:
            send(pairs, folders["in"], low, high)
        stream = incremental.read_stream(spark, folders["in"], PAIR, files_per_batch=2)
        long = incremental.pairs_to_long(stream, KEYS)
        scored = incremental.stateless_scores(long, KEYS, common)
        incremental.append_scores(scored, folders["out"], folders["checkpoint"]).awaitTermination()
    batch = incremental.stateless_scores(to_long(pairs.where("row_id < 70"), KEYS), KEYS, common)
    assert rows(spark.read.parquet(folders["out"])) == rows(batch)


def test_summary_of_pairs_after_a_restart(spark, pairs, folders):
    common = common_words(to_long(pairs, KEYS))
    for low, high in ((0, 40), (25, 80)):
        send(pairs, folders["in"], low, high)
        stream = incremental.read_stream(spark, folders["in"], PAIR, files_per_batch=2)
        scored = score_readability(incremental.pairs_to_long(stream, KEYS), KEYS, common)
        incremental.running_summary(scored, KEYS, folders["out"], folders["checkpoint"]).awaitTermination()
        seen = to_long(pairs.where(F.col("row_id") < high), KEYS)
        batch = score_summary(metric_values(score_readability(seen, KEYS, common), KEYS))
        expected = {(r["field"], r["metric"]): r for r in batch.collect()}
        found = {(r["field"], r["metric"]): r for r in incremental.latest_summary(spark, folders["out"]).collect()}
        assert set(found) == set(expected) and len(found) == 2 * len(METRICS)
        for key, row in found.items():
            for name in ("n", "max", "mean", "std"):
                assert row[name] == pytest.approx(expected[key][name])


def test_batches_are_bounded(spark, pairs, folders):
    send(pairs, folders["in"], 0, 60, files=6)
    stream = incremental.read_stream(spark, folders["in"], PAIR, bytes_per_batch=1)
    sizes = []
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count()))
        .option("checkpointLocation", folders["checkpoint"])
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert len(sizes) == 6 and sum(sizes) == 60


def test_prepared_scorers_store_their_lookup_once(spark, texts, folders, monkeypatch):
    documents = texts.select("row_id", "text")
    labels = documents.select("row_id", (F.col("row_id") % 3 == 0).cast("int").alias("toxic"))
    lexicon = learn_toxicity(documents, labels, KEYS, support=3, threshold=0.5)
    examples = example_table(spark).union(
        texts.where("row_id % 9 = 0").select(F.lit("injection"), "row_id", F.substring("text", 1, 60))
    ).where(F.size(F.split("text", " ")) > 6)
    words = topics.topic_table(spark, "the, of, law")
    stored = []
    real = lookups.materialize
    monkeypatch.setattr(lookups, "materialize", lambda df: stored.append(df) or real(df))
    toxic, known, topic = prepare_toxicity(lexicon), similarity.prepare_shingles(examples), topics.prepare_topics(words)
    scorers = {
        "toxicity": lambda df: score_toxicity(df, KEYS, toxic),
        "injection": lambda df: similarity.shingle_similarity(df, KEYS, known, ["injection"]),
        "topic": lambda df: topics.closest_topic(df, KEYS, topic, ["the", "of", "law"]),
    }
    for name, score in scorers.items():
        source, out, checkpoint = (f"{folders[k]}-{name}" for k in ("in", "out", "checkpoint"))
        for low, high in ((0, 40), (40, 90)):
            add_files(texts, source, low, high)
            stream = incremental.read_stream(spark, source, SCHEMA, files_per_batch=1)
            incremental.score_batches(stream, score, out, checkpoint).awaitTermination()
        found = spark.read.parquet(out)
        assert found.select("batch").distinct().count() > 3
        assert rows(found.drop("batch")) == rows(score(texts.where("row_id < 90")))
    assert len(stored) == 3
