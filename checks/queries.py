"""One query per operator, over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import tables as t
from corpuslens.data.tables import lexicon_table, name_table, small_table
from corpuslens.operators import discovery, entities, patterns, readability, similarity, summary, topics, views
from corpuslens.operators.longform import to_long, to_metrics
from corpuslens.operators.sentiment import score_sentiment
from corpuslens.operators.toxicity import learn_toxicity, prepare_toxicity, score_toxicity
from corpuslens.plans.session import materialize
from corpuslens.plans.storage import shared_dir
from corpuslens.sources import readers
from corpuslens.sources.export import export_csv
from corpuslens.sources.normalize import normalize_columns
from corpuslens.streaming import incremental

KEYS = t.KEYS
SUPPORT, THRESHOLD = 5, 2.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, nudged off exact ties (engines round those differently), no negative zero."""
    return df.withColumns(
        {c: F.round(F.col(f"`{c}`").cast("double") + 1e-9, 6) + F.lit(0.0) for c in columns}
    )


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid4().hex}"


# Sources and sinks


def plain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pairs(spark, sf_dir).select("row_id", "prompt", "response")


def read_csv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    export_csv(plain_pairs(spark, sf_dir), path)
    renamed = readers.read_csv(spark, path, schema="row_id bigint, Prompt string, Response string")
    return renamed.toDF("row_id", "prompt", "response")


def read_tsv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    plain_pairs(spark, sf_dir).write.csv(path, header=True, sep="\t", escape='"', quoteAll=True)
    return readers.read_tsv(spark, path, schema="row_id bigint, prompt string, response string")


def read_json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    plain_pairs(spark, sf_dir).write.json(path)
    return readers.read_json(
        spark, path, lines=True, schema="row_id bigint, prompt string, response string"
    )


def read_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = plain_pairs(spark, sf_dir)
    split = F.when(F.length("prompt") % 4 == 0, "test").otherwise("train")
    rows.withColumn("split", split).write.partitionBy("split").parquet(path)
    return readers.read_split(spark, path)


def load_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.pairs(spark, sf_dir).select(
        "row_id", F.col("prompt").alias("input"), F.col("response").alias("output")
    )
    file_path, split_path = f"{scratch(spark)}.jsonl", scratch(spark)
    rows.write.json(file_path)
    rows.where(F.length("input") > 200).write.parquet(f"{split_path}/train")
    return readers.load_pairs(spark, path=file_path, split_dir=split_path).select(
        "row_id", "prompt", "response"
    )


def dataset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pairs(spark, sf_dir).orderBy("row_id")


def export_display_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    export_csv(patterns.label_patterns(plain_pairs(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn(
        "row_id", F.col("row_id").cast("bigint")
    )


# Columns


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = plain_pairs(spark, sf_dir).toDF("row_id", "question", "output")
    return normalize_columns(given, input_name="question")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = t.pairs(spark, sf_dir).withColumnRenamed("instruction", "system")
    return normalize_columns(given, instruction_name="system")


def unwrap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("n_chars") / 1000
    wrapped = F.when(F.col("lang") == "de", F.array().cast("array<double>")).otherwise(F.array(ratio))
    scores = t.table(spark, sf_dir, "documents").select("doc_id", wrapped.alias("scores"))
    return rounded(scores.select("doc_id", summary.unwrap(F.col("scores")).alias("score")), "score")


# Scoring


def fixture_lexicon(spark: SparkSession) -> DataFrame:
    return lexicon_table(spark, t.WEIGHTS, t.BOOSTERS, t.NEGATIONS)


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_sentiment(t.corpus(spark, sf_dir), KEYS, fixture_lexicon(spark))
    return rounded(scores, "sentiment")


def toxicity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "toxic")
    return learn_toxicity(
        t.documents(spark, sf_dir).select("row_id", "text"), labels, KEYS, SUPPORT, THRESHOLD
    )


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(toxicity_words(spark, sf_dir), "log_odds", "prior")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_toxicity(t.corpus(spark, sf_dir), KEYS, toxicity_words(spark, sf_dir))
    return rounded(scores, "toxicity")


def similar(long: DataFrame, spark: SparkSession, sf_dir: str, scorer, *groups: str) -> DataFrame:
    known = t.examples(spark, sf_dir).where(F.col("group").isin(*groups))
    return rounded(scorer(long, KEYS, known, list(groups)), *groups)


def injection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus(spark, sf_dir).where(F.col("field") != "response")
    return similar(long, spark, sf_dir, similarity.shingle_similarity, "injection")


def jailbreak_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = to_long(t.pairs(spark, sf_dir), KEYS, ("prompt",))
    return similar(long, spark, sf_dir, similarity.shingle_similarity, "jailbreak")


def refusal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = to_long(t.pairs(spark, sf_dir), KEYS, ("response",))
    return similar(long, spark, sf_dir, similarity.shingle_similarity, "refusal")


def similarity_shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["injection", "jailbreak", "refusal"]
    return similar(t.corpus(spark, sf_dir), spark, sf_dir, similarity.shingle_similarity, *groups)


def similarity_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(t.corpus(spark, sf_dir), spark, sf_dir, similarity.tfidf_similarity, "injection")


def similarity_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = t.table(spark, sf_dir, "embeddings")
    scores = similarity.dense_similarity(vectors, ["vec_id"], t.centroids(spark, sf_dir), ["theme"])
    return rounded(scores, "theme")


def similarity_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = t.table(spark, sf_dir, "embeddings")
    return rounded(similarity.lsh_similarity(vectors, ["vec_id"], t.centroids(spark, sf_dir), ["theme"]), "theme")


def _topics(spark: SparkSession, sf_dir: str, words: dict) -> DataFrame:
    table = small_table(spark, ["topic", "token", "weight"], t.topic_rows(words))
    return topics.closest_topic(t.corpus(spark, sf_dir), KEYS, table, list(words))


def topic_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_topics(spark, sf_dir, t.TOPICS), "score")


def topic_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_topics(spark, sf_dir, t.CUSTOM_TOPICS), "score")


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = discovery.text_terms(t.corpus(spark, sf_dir), KEYS)
    return rounded(discovery.term_statistics(texts), "idf")


def topic_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.discover_topics(t.corpus(spark, sf_dir), KEYS, iterations=5), "weight")


def pattern_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus_with_inline(spark, sf_dir)
    return long.select("row_id", "field", patterns.label(F.col("text")).alias("pattern"))


def pattern_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus_with_inline(spark, sf_dir)
    return long.select(
        "row_id", "field", patterns.label(F.col("text"), t.CUSTOM_PATTERNS).alias("pattern")
    )


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_hits(t.corpus_with_inline(spark, sf_dir), KEYS)


def found_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus_with_inline(spark, sf_dir)
    return entities.extract_entities(long, KEYS, entity_names(spark))


def entity_names(spark: SparkSession) -> DataFrame:
    return name_table(spark, t.GAZETTEER)


def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_entities(spark, sf_dir).drop("pos")


def pii_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus_with_inline(spark, sf_dir)
    return entities.extract_entities(long, KEYS, selected=t.SELECTED).drop("pos")


def pii_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.rendered_entities(t.corpus_with_inline(spark, sf_dir), KEYS)


# Text statistics


def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.common_words(t.corpus(spark, sf_dir))


def readability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus_with_inline(spark, sf_dir)
    counts = readability.text_counts(long, ["row_id", "field"], common(spark, sf_dir))
    return counts.select(
        "row_id", "field", *[F.col(c).cast("bigint").alias(c) for c in counts.columns[2:]]
    )


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = t.corpus_with_inline(spark, sf_dir)
    return readability.score_readability(long, KEYS, common(spark, sf_dir))


def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics(spark, sf_dir), *readability.METRICS)


def readability_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = readability.analyze_readability(plain_pairs(spark, sf_dir), common(spark, sf_dir))
    wide = wide.drop("prompt", "response")
    return rounded(wide, *wide.columns[1:])


SELECTED_METRICS = ["Gunning Fog Index", "Text Standard", "Lexicon Count"]


def readability_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = readability.metric_values(statistics(spark, sf_dir), KEYS, SELECTED_METRICS)
    return rounded(values, "value")


def readability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = readability.metric_values(statistics(spark, sf_dir), KEYS)
    counted = summary.histogram(materialize(rounded(values, "value")))
    return rounded(counted, "low", "high")


# Summaries


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment and toxicity, computed once for the passes of a summary."""
    return materialize(
        to_metrics(sentiment(spark, sf_dir), KEYS, ["sentiment"]).unionByName(
            to_metrics(toxicity(spark, sf_dir), KEYS, ["toxicity"])
        )
    )


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.score_summary(scores(spark, sf_dir)), "max", "mean", "std")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.histogram(scores(spark, sf_dir)), "low", "high")


def score_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.quartiles(scores(spark, sf_dir))
    return rounded(found, *found.columns[2:])


def score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.density(scores(spark, sf_dir)), "x", "density")


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.label_counts(_topics(spark, sf_dir, t.TOPICS), "topic").orderBy("field", "topic")


def topic_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_label(_topics(spark, sf_dir, t.TOPICS), KEYS, "topic", t.FIELDS[:-1])


def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.label_counts(pattern_label(spark, sf_dir), "pattern")


def pattern_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_label(pattern_label(spark, sf_dir), KEYS, "pattern", t.FIELDS)


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.entity_counts(found_entities(spark, sf_dir))


def shape_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.extract_entities(t.corpus_with_inline(spark, sf_dir), KEYS)


def pii_counts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.entity_counts_filled(shape_findings(spark, sf_dir), t.FIELDS)


def pii_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_entities(shape_findings(spark, sf_dir), KEYS, t.FIELDS)


# Views


def table_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sort_table(sentiment(spark, sf_dir), "sentiment", ["row_id", "field"], descending=True)


def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return views.filter_table(
        rows, ("lang", "!=", "de"), ("n_chars", ">=", 1000), ("text", "contains", "on the")
    ).drop("text")


def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(plain_pairs(spark, sf_dir), ["row_id"], 2, views.DATASET_PAGE)


# Streaming

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAIR = "row_id bigint, prompt string, response string"


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and the prompts and responses of pairs that arrive in files, some of them twice."""
    documents = incremental.read_stream(spark, f"{sf_dir}/documents*.parquet", DOCUMENT)
    documents = documents.select(F.col("doc_id").alias("row_id"), F.lit("document").alias("field"), "text")
    path, rows = scratch(spark), plain_pairs(spark, sf_dir)
    rows.write.parquet(path)
    rows.where("row_id % 3 = 0").write.mode("append").parquet(path)
    pairs = incremental.read_stream(spark, f"{path}/*.parquet", PAIR, files_per_batch=4)
    return documents, incremental.pairs_to_long(pairs, KEYS)


def run_all(start, *streamed: DataFrame) -> list[str]:
    """The folders written by one query for each stream."""
    outs = []
    for stream in streamed:
        outs.append(scratch(stream.sparkSession))
        start(stream, outs[-1], scratch(stream.sparkSession)).awaitTermination()
    return outs


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(common(spark, sf_dir))

    def start(stream: DataFrame, out: str, checkpoint: str):
        return incremental.append_scores(incremental.stateless_scores(stream, KEYS, known), out, checkpoint)

    outs = run_all(start, *streams(spark, sf_dir))
    return rounded(spark.read.parquet(*outs), *readability.METRICS)


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(common(spark, sf_dir))

    def start(stream: DataFrame, out: str, checkpoint: str):
        scored = readability.score_readability(stream, KEYS, known)
        return incremental.running_summary(scored, KEYS, out, checkpoint)

    found = [incremental.latest_summary(spark, out) for out in run_all(start, *streams(spark, sf_dir))]
    return rounded(found[0].unionByName(found[1]), "max", "mean", "std")


def stream_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment, toxicity, similarity and topics of every micro-batch, by scorers that are prepared once."""
    lexicon = fixture_lexicon(spark)
    toxic = prepare_toxicity(toxicity_words(spark, sf_dir))
    known = similarity.prepare_shingles(t.examples(spark, sf_dir).where(F.col("group") == "injection"))
    words = topics.prepare_topics(small_table(spark, ["topic", "token", "weight"], t.topic_rows(t.TOPICS)))

    def score(batch: DataFrame) -> DataFrame:
        group = [*KEYS, "field"]
        return (
            score_sentiment(batch, KEYS, lexicon)
            .join(score_toxicity(batch, KEYS, toxic), group)
            .join(similarity.shingle_similarity(batch, KEYS, known, ["injection"]), group)
            .join(topics.closest_topic(batch, KEYS, words, list(t.TOPICS)).drop("score"), group)
        )

    def start(stream: DataFrame, out: str, checkpoint: str):
        return incremental.score_batches(stream, score, out, checkpoint)

    outs = run_all(start, *streams(spark, sf_dir))
    found = [spark.read.parquet(out).drop("batch") for out in outs]
    return rounded(found[0].unionByName(found[1]), "sentiment", "toxicity", "injection")


QUERIES = {
    "read_csv_pairs": read_csv_pairs,
    "read_tsv_pairs": read_tsv_pairs,
    "read_json_pairs": read_json_pairs,
    "read_split_pairs": read_split_pairs,
    "load_precedence": load_precedence,
    "dataset_view": dataset_view,
    "export_display_headers": export_display_headers,
    "normalize_columns": normalized,
    "compose_prompt": composed,
    "unwrap_scores": unwrap_scores,
    "sentiment_compound": sentiment,
    "toxicity_lexicon": toxicity_lexicon,
    "toxicity_score": toxicity,
    "injection_score": injection_score,
    "jailbreak_score": jailbreak_score,
    "refusal_score": refusal_score,
    "similarity_shingle": similarity_shingle,
    "similarity_tfidf": similarity_tfidf,
    "similarity_dense": similarity_dense,
    "similarity_lsh": similarity_lsh,
    "topic_closest": topic_closest,
    "topic_custom": topic_custom,
    "topic_terms": topic_terms,
    "topic_discovery": topic_discovery,
    "pattern_label": pattern_label,
    "pattern_custom": pattern_custom,
    "pattern_hits": pattern_hits,
    "pii_entities": pii_entities,
    "pii_selected": pii_selected,
    "pii_rendered": pii_rendered,
    "common_words": common,
    "readability_counts": readability_counts,
    "readability_scores": readability_scores,
    "readability_wide": readability_wide,
    "readability_selected": readability_selected,
    "readability_histogram": readability_histogram,
    "score_summary": score_summary,
    "score_histogram": score_histogram,
    "score_quartiles": score_quartiles,
    "score_density": score_density,
    "topic_counts": topic_counts,
    "topic_top": topic_top,
    "pattern_counts": pattern_counts,
    "pattern_top": pattern_top,
    "pii_counts": pii_counts,
    "pii_counts_filled": pii_counts_filled,
    "pii_top": pii_top,
    "table_sort": table_sort,
    "table_filter": table_filter,
    "table_page": table_page,
    "stream_scores": stream_scores,
    "stream_summary": stream_summary,
    "stream_foreach_batch": stream_foreach_batch,
}
