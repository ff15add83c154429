"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

A lexicon of words that tell labelled toxic documents from others is learned from a bounded sample of
labelled rows, beside a short fixed list of insults. The features are densities of both lists,
hits close to a second person, capitals, punctuation and signs of obfuscation. Trees are fitted
on three quarters of the sample; the rest makes the calibration from trees to frequencies.

Results: one row per row, repeated rows too. Null and empty texts have features of zeros and the
score that follows from them. Labels that are null do not count; a document labelled both ways
counts as toxic. Without two kinds of labels all scores are the share of toxic ones (0 if no labels).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslens.llm.trees import SAMPLE_ROWS, bounded_sample, fit_trees, with_probability
from corpuslens.plans.storage import stored

#: Fixed list, beside the learned one.
INSULTS = """
ass asshole bastard bitch bullshit crap cretin cunt damn dickhead disgusting dumb dumbass fool
fuck fucking garbage hate idiot idiots imbecile jerk kill loser losers moron morons motherfucker
nazi pathetic pig piss retard scum shit slut stupid trash ugly vermin whore worthless
""".split()
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine",
    "tu", "te", "toi", "ton", "ta", "vous", "usted", "ti", "tus",
}
#: Characters written in place of letters.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_]+(?:[@$!*'’_.-]+[^\W_]+)*", re.U)
PLAIN = re.compile(r"[^\W\d_]+")
LONG_RUN = re.compile(r"([^\W\d_])\1\1")
NEAR = 6
LEXICON_ROWS = 1_000
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_DEVIATIONS = 3, 0.04, 4.0
THRESHOLD = 0.3
ROWS_AT_ONCE = 200
N_FEATURES = 12


def text_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Densities and rates; zeros for a text without words."""
    words = WORD.findall(text)
    if not words:
        return [0.0] * N_FEATURES
    n = len(words)
    low = [w.lower() for w in words]
    get = lexicon.get
    hits = [(i, get(w)) for i, w in enumerate(low) if w in lexicon]
    disguised = 0
    mixed = 0
    for i, w in enumerate(low):
        if not w.isalpha():
            bare = w.translate(DISGUISE)
            plain = "".join(PLAIN.findall(bare))
            if w not in lexicon and plain in lexicon:
                hits.append((i, get(plain)))
                disguised += 1
            mixed += any(c.isdigit() or c in "@$!*" for c in w) and any(c.isalpha() for c in w)
    persons = [i for i, w in enumerate(low) if w in SECOND_PERSON] if hits else []
    near = sum(any(abs(i - j) <= NEAR for j in persons) for i, _ in hits) if persons else 0
    letters = sum(map(len, words)) or 1
    weight = sum(w for _, w in hits)
    return [
        math.log1p(n),
        100.0 * len(hits) / n,
        weight / math.sqrt(n),
        float(min(len(hits), 50)),
        max((w for _, w in hits), default=0.0),
        float(len({low[i] for i, _ in hits})),
        float(near),
        sum(c.isupper() for c in text) / letters,
        sum(len(w) > 2 and w.isupper() for w in words) / n,
        text.count("!") / n,
        sum(text.count(c) for c in "?*#$%&") / n,
        (mixed + disguised + len(LONG_RUN.findall(text))) / n,
    ]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of the words that mark label 1 in (text, label); the best ``LEXICON_ROWS``.

    The weight is the log-odds, smoothed; it must be several of its deviations above zero, and the
    word must occur in a share of the toxic texts, lest copies of one text make its words weigh.
    """
    totals = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = float(totals["toxic"] or 0), float(totals["n"] - (totals["toxic"] or 0))
    shape = r"[\p{L}\p{N}]+"
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(shape), 0))
    counted = (
        sample.select("label", F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(F.col("a") >= max(LEAST_DOCUMENTS, LEAST_SHARE * toxic))
    )
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (toxic - F.col("a") + 0.5)) - F.log(b / (clean - F.col("n") + F.col("a") + 0.5))
    scored = counted.select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("sure"))
    best = scored.where((F.col("sure") >= LEAST_DEVIATIONS) & (F.col("odds") >= 1.0))
    rows = best.orderBy(F.desc("sure"), "word").limit(LEXICON_ROWS).collect()
    return {word: 1.0 for word in INSULTS} | {r["word"]: float(r["odds"]) for r in rows}


def with_features(rows: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """Replace the text by ``features``. Only the text goes to Python; all other columns stay with Spark."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text]

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            found = []
            for at in range(0, len(whole), ROWS_AT_ONCE):
                found += [text_features(t or "", lexicon) for t in whole.slice(at, ROWS_AT_ONCE).to_pylist()]
            yield pa.array(found, pa.list_(pa.float64()))

    # not deterministic to the optimizer, which else may move it to where it runs more than once
    features = F.arrow_udf(work, T.ArrayType(T.DoubleType())).asNondeterministic()
    return rows.select(*kept, features(F.col(f"`{text}`")).alias("features"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Learn from at most about ``sample_rows`` labelled documents."""
    marked = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.max((F.col(label) == 1).cast("double")).alias("label"))
    )
    chosen = bounded_sample(marked, F.col("id"), sample_rows)  # bounded, so it may be sent around
    texts = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]))
    row = sample.agg(F.avg("label").alias("share")).first()
    prior = float(row["share"] or 0.0)
    if prior in (0.0, 1.0):
        return ToxicityModel({}, None, None, prior)
    fitted = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) != 0
    lexicon = learn_lexicon(sample.where(fitted))
    featured = stored(with_features(sample, lexicon))
    trees = fit_trees(featured.where(fitted))
    if trees is None:
        return ToxicityModel(lexicon, None, None, prior)
    held = stored(with_probability(featured.where(~fitted), trees))
    if held.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, trees, None, prior)
    steps = IsotonicRegression(featuresCol="probability", labelCol="label").fit(
        held.select("probability", "label")
    )
    return ToxicityModel(lexicon, trees, steps, prior)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, score) of every whole text."""
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if model.trees is None:
        return chosen.select(F.col("id").alias(key), F.lit(model.prior).alias("score"))
    scored = with_probability(with_features(chosen, model.lexicon), model.trees)
    score = F.col("probability")
    if model.calibration is not None:
        scored = model.calibration.setPredictionCol("calibrated").transform(scored)
        # equal steps keep the order of the trees by a part too small to matter
        score = 0.999 * F.col("calibrated") + 0.001 * F.col("probability")
    return scored.select(F.col("id").alias(key), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
