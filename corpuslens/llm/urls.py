"""URL filter: rules for hosts and paths, and boosted trees on lexical features for the rest.

The labelled URLs are those that a rule decides. From a bounded sample of them the trees learn what
blocked URLs look like: length, depth, share of digits, entropy of characters, numbers of parameters
and labels, and the share of blocked URLs per host suffix. URLs without a rule get the trees' verdict.

Results: one row per row; a null URL or one without ``://`` has empty host and path and goes to the
trees like any other. If the rules' URLs are all of one kind, the rest get that verdict; if no rule
decides any, the rest are allowed.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslens.llm.trees import SAMPLE_ROWS, bounded_sample, fit_trees, with_probability
from corpuslens.plans.storage import stored

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that the prior counts for in the share of a suffix.
PRIOR_WEIGHT = 20.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Empty for a null or one without ``://``; only A-Z are lower-cased."""
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(name, verdict) of the longest rule that fits, or null. Rules are a short list by hand."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        here = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, here).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical_features(url: str, host: str, path: str) -> list[float]:
    size = max(len(url), 1)
    counts = Counter(url)
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    return [
        float(len(url)),
        float(len(host)),
        float(len(path)),
        float(sum(bool(part) for part in path.split("/"))),
        digits / size,
        entropy,
        float(sum(bool(part) for part in query.split("&"))),
        float("#" in url),
        float(host.count(".") + bool(host)),
        (counts["-"] + counts["_"] + counts["%"]) / size,
        float(max(map(len, path.split("/")))),
        float("." in path.rpartition("/")[2]),
    ]


def with_features(rows: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """Add ``features``: those of the URL's characters and the share of its suffix."""
    joined = rows.withColumn("suffix", suffix_of(F.col("host"))).join(
        F.broadcast(suffixes), "suffix", "left"
    )
    ready = joined.withColumn("share", F.coalesce("share", F.lit(prior))).drop("suffix")

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = zip(*(batch.column(n).to_pylist() for n in ("url", "host", "path", "share")))
            found = [[*lexical_features(u or "", h, p), s] for u, h, p, s in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.float64()))],
                names=[*batch.schema.names, "features"],
            )

    fields = [*ready.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))]
    return ready.mapInArrow(work, T.StructType(fields)).drop("share")


@dataclass(frozen=True)
class UrlModel:
    """Trees, and the suffix shares they were given; without trees, one verdict for all."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    prior: float


def fit_urls(judged: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Learn from (url, host, path, verdict) of labelled URLs; the suffix table is as small as the sample."""
    sample = stored(
        bounded_sample(judged, F.col("url"), sample_rows).select(
            "url", "host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label")
        )
    )
    row = sample.agg(F.avg("label").alias("share")).first()
    prior = row["share"] or 0.0
    if prior in (0.0, 1.0):
        return UrlModel(None, None, prior)
    blocked = F.sum("label") + F.lit(PRIOR_WEIGHT * prior)
    suffixes = stored(
        sample.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(
            (blocked / (F.count(F.lit(1)) + F.lit(PRIOR_WEIGHT))).alias("share")
        )
    )
    featured = with_features(sample, suffixes, prior)
    return UrlModel(fit_trees(stored(featured.select("features", "label"))), suffixes, prior)


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(key, host, path, rule, verdict, probability): the rule's verdict, else the trees'."""
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    split = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = ruled.select("key", "url", "host", "path", F.col("found.name").alias("rule"), "found.verdict")
    model = fit_urls(rows.where(F.col("verdict").isNotNull()), sample_rows)
    if model.trees is None:
        scored = rows.withColumn("probability", F.lit(model.prior))
    else:
        scored = with_probability(with_features(rows, model.suffixes, model.prior), model.trees)
    learned = F.when(F.col("probability") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", learned).alias("verdict"),
        "probability",
    )
