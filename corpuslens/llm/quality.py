"""Quality: a document classifier joined with what its site and path are like.

Trees on cheap features of the text, fitted on a bounded sample of labelled rows, give each document a
probability of being good. Summed up by host and by path within host, these are the evidence of a
two-level empirical Bayes model: a host's mean is drawn towards the global one, a path's towards
its host's, the more so the fewer documents there are; how strongly follows from how much
the groups differ beyond chance. The document's own share is left out of its site's evidence. The score
adds the path's log-odds, less the global ones, to the document's.

Results: one row per row, repeated rows too. Null host and path are a group of their own, null texts
are empty. Labels that are null do not count; a document labelled both ways counts as good. Without
two kinds of labels every document has the share of good ones (1 if there are no labels).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslens.llm.trees import SAMPLE_ROWS, bounded_sample, fit_trees, with_probability
from corpuslens.plans.lookups import lookup_join
from corpuslens.plans.storage import stored

THRESHOLD = 0.5
#: Bounds of the weight, in documents, with which a group is drawn towards the level above.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
#: The most that a site may move a document's log-odds.
MOST_SHIFT = 2.0
WORD = re.compile(r"[^\W\d_]+")
ROWS_AT_ONCE = 200
N_FEATURES = 12


def text_features(text: str) -> list[float]:
    """Shape of a text; zeros for an empty one."""
    size = len(text)
    if not size:
        return [0.0] * N_FEATURES
    words = WORD.findall(text)
    lines = text.split("\n")
    n = max(len(words), 1)
    letters = sum(map(len, words))
    upper = sum(w.isupper() for w in words if len(w) > 1)
    data = text.encode()
    return [
        float(min(size, 20_000)),
        n / size,
        letters / size,
        letters / n,
        upper / n,
        sum(map(text.count, "!?")) / n,
        sum(map(text.count, "|#%$&*@=<>{}[]\\/~^_")) / n,
        sum(map(text.count, ".,;:")) / n,
        sum(map(text.count, "0123456789")) / size,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        len(zlib.compress(data[:], 1)) / len(data),
    ]


def with_features(rows: DataFrame) -> DataFrame:
    """Replace the last column, a text, by ``features``."""
    kept = rows.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = [text_features(t or "") for t in batch.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))],
                    names=[*kept, "features"],
                )

    fields = [*[rows.schema[c] for c in kept], T.StructField("features", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(work, T.StructType(fields))


def shrinkage(groups: DataFrame, own: Column, above: Column) -> float:
    """Weight of the level above, by moments: the spread of group means beyond sampling noise."""
    n = F.col("n")
    gap = own / n - above
    row = groups.where(n > 1).agg(
        F.sum(n * gap * gap).alias("spread"),
        F.sum(above * (1 - above)).alias("noise"),
        F.sum(n).alias("n"),
        F.avg(above * (1 - above)).alias("variance"),
    ).first()
    if not row["n"] or not row["variance"]:
        return MOST_WEIGHT
    between = (row["spread"] - row["noise"]) / row["n"]
    if between <= 0:
        return MOST_WEIGHT
    return min(max(row["variance"] / between - 1, LEAST_WEIGHT), MOST_WEIGHT)


def log_odds(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(safe / (1 - safe))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: str,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(key, document, host_posterior, path_posterior, score, kept)."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    marked = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.max((F.col(label) == 1).cast("double")).alias("label"))
    )
    chosen = bounded_sample(marked, F.col("id"), sample_rows)  # bounded, so it may be sent around
    sample = stored(with_features(rows.join(F.broadcast(chosen), "id").select("id", "label", "text")))
    share = sample.agg(F.avg("label")).first()[0]
    trees = fit_trees(sample)
    if trees is None:
        good = 1.0 if share is None else share
        return rows.select(
            F.col("id").alias(key),
            *[F.lit(good).alias(c) for c in ("document", "host_posterior", "path_posterior", "score")],
            F.lit(good >= THRESHOLD).alias("kept"),
        )
    scored = stored(with_probability(with_features(rows), trees))
    paths = stored(
        scored.groupBy("host", "path").agg(F.sum("probability").alias("s"), F.count("*").alias("n"))
    )
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = F.lit((total["s"] or 0.0) / (total["n"] or 1))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    host_weight = shrinkage(hosts, F.col("s"), overall)
    host_mean = (F.col("s") + host_weight * overall) / (F.col("n") + host_weight)
    above = hosts.select(
        "host", F.col("s").alias("hs"), F.col("n").alias("hn"), host_mean.alias("host_mean")
    )
    nested = stored(paths.join(above, "host"))
    path_weight = shrinkage(nested, F.col("s"), F.col("host_mean"))
    joined = lookup_join(scored, nested, ["host", "path"], salt_by=["id"])
    own = F.col("probability")
    host_posterior = (F.col("hs") - own + host_weight * overall) / (F.col("hn") - 1 + host_weight)
    path_posterior = (F.col("s") - own + path_weight * F.col("host_posterior")) / (
        F.col("n") - 1 + path_weight
    )
    shift = log_odds(F.col("path_posterior")) - log_odds(overall)
    bounded = F.greatest(F.least(shift, F.lit(MOST_SHIFT)), F.lit(-MOST_SHIFT))
    score = 1 / (1 + F.exp(-(log_odds(own) + bounded)))
    return (
        joined.withColumn("host_posterior", host_posterior)
        .withColumn("path_posterior", path_posterior)
        .withColumn("score", score)
        .select(
            F.col("id").alias(key),
            own.alias("document"),
            "host_posterior",
            "path_posterior",
            "score",
            (F.col("score") >= THRESHOLD).alias("kept"),
        )
    )
