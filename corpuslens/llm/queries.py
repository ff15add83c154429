"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.llm import (
    fingerprints,
    line_dedup,
    near_dups,
    negatives,
    neighbours,
    packing,
    personal,
    phrases,
    pieces,
    quality,
    secret_scan,
    toxicity,
    urls,
)

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"

URL_RULES = [
    urls.Rule("com", "/", urls.ALLOW),
    urls.Rule("example.com", "/en/", urls.BLOCK),
    urls.Rule("www.example.com", "/en/", urls.ALLOW),
    urls.Rule("net", "/es/", urls.BLOCK),
    urls.Rule("net", "/fr/", urls.BLOCK),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_text(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path(PIECE_MODEL))
    return pieces.round_trip(table(spark, sf_dir, "documents"), model)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources are the hosts, their languages the paths."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), "source", "lang")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    known = F.col("known")
    return found.select(
        "doc_id",
        *[secret_scan.count_of(known, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.written(known).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = neighbours.build_index(vectors, "vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % 50 == 0)
    return neighbours.nearest(index, asked, 5, "vec_id", "embedding")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_text(BYTE_MODEL), capacity=1024, end_id=2)


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = near_dups.group_documents(docs, near_dups.Likeness(words=3, percent=85))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, text_sha256): line numbers from 0, digest of what is left."""
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.col("lines_.n").alias("n_lines"),
        F.size("lines_.removed").alias("n_removed"),
        F.array_join(F.col("lines_.removed").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id is divisible by 7 the label is moved on by one, so that some labels are wrong."""
    number = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (number + 1) % 10).otherwise(number)
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in personal.BASE_KINDS],
        F.sha2(personal.written(base).cast("binary"), 256).alias("base_sha256"),
        personal.written(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pieces,
        op2_quality,
        op3_urls,
        op4_fingerprints,
        op5_secrets,
        op6_neighbours,
        op7_packing,
        op8_near_dups,
        op9_line_dedup,
        op10_toxicity,
        op11_negatives,
        op12_phrases,
        op13_personal,
    )
}
