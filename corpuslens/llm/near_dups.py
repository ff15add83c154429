"""Near-duplicate documents by MinHash.

A text is the set of its word shingles. Many universal hash functions give a signature of minima;
bands of it make buckets; texts that share one are compared by their signatures, and those that may
reach the threshold by their full sets. Links are closed to groups by alternating large and small
stars. Texts with equal sets are one text from the start, so copies never meet each other in a bucket.
Among many edited copies of one text most pairs are near the threshold and still no links. Members of
buckets that are not one group after the first round get a sketch, one bit of each of many more minima,
by which nearly all such pairs are ruled out within the join, before they are made.

The bands are chosen so that a pair at the threshold shares none of them with a chance of ``MISS``.
Results: one row per row. A null or empty text, or one without a word, has no shingles and is linked
with nothing; a text of fewer words than a shingle is one shingle, the whole. Repeated ids are one
document: their rows share a group. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.links import crowded, group_candidates, mixed
from corpuslens.plans.lookups import fits_broadcast
from corpuslens.plans.storage import stored

SEED = 5
ROWS_PER_BAND = 5
MISS = 1e-7
DEVIATIONS = 6.0
SKETCH_BITS = 2048
#: Pivots of a bucket after each round.
ROUNDS = [1, 32, 2048]
CACHED_WORDS, ROWS_AT_ONCE = 300_000, 100


@dataclass(frozen=True)
class Likeness:
    """Words per shingle and the least share of common shingles, in percent."""

    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS_PER_BAND))

    @property
    def hashes(self) -> int:
        return self.bands * ROWS_PER_BAND

    @property
    def least_equal(self) -> int:
        """Equal minima below which a pair at the threshold is all but impossible."""
        share, n = self.percent / 100, self.hashes
        return math.floor(share * n - DEVIATIONS * math.sqrt(n * share * (1 - share)))

    @property
    def most_different(self) -> int:
        """Differing bits of two sketches above which a pair at the threshold is all but impossible."""
        share, n = (1 - self.percent / 100) / 2, SKETCH_BITS
        return math.ceil(share * n + DEVIATIONS * math.sqrt(n * share * (1 - share)))


class WordHashes(dict):
    """Hashes of words, a bounded list of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_words = WordHashes()


def constants(n: int, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(_words.__getitem__, words)), np.uint64)
    size = min(size, len(hashes))
    factors = constants(size, SEED + size)
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total += mixed(hashes[i : len(hashes) - size + 1 + i] * factors[i])
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of n universal hash functions (multiply, add, shift) over sets that are not empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    out = np.empty((len(sets), n), np.uint32)
    for i, (a, b) in enumerate(zip(constants(n, 1), constants(n, 2))):
        hashed = values * a
        hashed += b
        hashed >>= np.uint64(32)
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def signed(rows: DataFrame, like: Likeness) -> DataFrame:
    """(id, n, set_key, signature) from (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in _slices(batches):
            sets = [shingles(t, like.words) for t in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            values = signatures([sets[i] for i in full], like.hashes).view(np.int32) if full else None
            lengths = np.zeros(len(sets) + 1, np.int32)
            lengths[[i + 1 for i in full]] = like.hashes
            flat = pa.array(values.ravel() if full else np.empty(0, np.int32))
            keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), flat),
                ],
                names=["id", "n", "set_key", "signature"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(
        work, f"id {kind}, n bigint, set_key binary, signature array<int>"
    )


def shingle_sets(rows: DataFrame, like: Likeness) -> DataFrame:
    """(id, shingles) from (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in _slices(batches):
            sets = [shingles(t, like.words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(work, f"id {kind}, shingles array<bigint>")


def sketches(sets: DataFrame) -> DataFrame:
    """(id, size, bits) from (id, shingles): the size, and one bit of each of many more minima."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in _slices(batches):
            rows = [np.asarray(s, np.int64).view(np.uint64) for s in batch.column(1).to_pylist()]
            bits = signatures(rows, SKETCH_BITS) & np.uint32(1)
            packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array(list(packed), pa.list_(pa.int64())),
                ],
                names=["id", "size", "bits"],
            )

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "shingles").mapInArrow(work, f"id {kind}, size bigint, bits array<bigint>")


def joined(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs with the value of both sides, as ``va`` and ``vb``."""
    left = table.select(F.col("id").alias("a"), F.col(value).alias("va"))
    right = table.select(F.col("id").alias("b"), F.col(value).alias("vb"))
    return pairs.join(left, "a").join(right, "b")


def group_documents(
    docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id): the smallest id that links reach, itself if there are none."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    table = stored(signed(rows, like))
    worded = table.where(F.col("n") > 0)
    classes = stored(
        worded.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    reps = (
        worded.join(classes.select("set_key", F.col("rep").alias("id")), ["set_key", "id"])
        .dropDuplicates(["set_key", "id"])
        .select("id", "signature")
    )
    width = ROWS_PER_BAND
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(like.bands - 1)),
        lambda i: F.xxhash64(i, F.slice("signature", i * width + 1, F.lit(width))),
    )
    banded = reps.select("id", bands.alias("bands"))
    members = crowded(banded.select("id", F.explode("bands").alias("bucket")))
    candidates = stored(members.select("id").distinct())
    few = fits_broadcast(candidates)
    chosen = F.broadcast(candidates) if few else candidates
    sets = stored(shingle_sets(rows.join(chosen, "id", "left_semi"), like).dropDuplicates())
    signs = stored(reps.join(chosen, "id", "left_semi"))

    def verify(pairs: DataFrame) -> DataFrame:
        equal = F.aggregate(
            F.zip_with("va", "vb", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x
        )
        likely = joined(pairs, signs, "signature").where(equal >= like.least_equal)
        full = joined(likely.select("a", "b").distinct(), sets, "shingles")
        common = F.size(F.array_intersect("va", "vb"))
        union = F.size("va") + F.size("vb") - common
        return full.where(100 * common >= like.percent * union).select("a", "b").distinct()

    words, band_names = [f"s{i}" for i in range(SKETCH_BITS // 64)], [f"b{i}" for i in range(like.bands)]

    def traits(ids: DataFrame) -> DataFrame:
        """Size, sketch and bands as fields: what is no array is compared in compiled code."""
        found = sketches(sets.join(ids, "id", "left_semi")).join(banded, "id")
        fields = [F.get("bits", F.lit(i)).alias(name) for i, name in enumerate(words)]
        fields += [F.get("bands", F.lit(i)).alias(name) for i, name in enumerate(band_names)]
        return found.select("id", F.struct("size", *fields).alias("trait"))

    def possible(a: Column, b: Column) -> Column:
        """Sets of sizes and sketches that a pair at the threshold may have."""
        small, large = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
        differ = reduce(Column.__add__, [F.bit_count(a[name].bitwiseXOR(b[name])) for name in words])
        return (100 * small >= like.percent * large) & (differ <= like.most_different)

    def first(a: Column, b: Column) -> Column:
        return F.coalesce(*[F.when(a[name] == b[name], a[name]) for name in band_names])

    again = table.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id")
    same_id = (
        table.where(F.col("n") > 0)
        .join(again, "id", "left_semi")
        .join(classes, "set_key")
        .select(F.col("id").alias("u"), F.col("rep").alias("v"))
        .where(F.col("u") != F.col("v"))
    )
    groups = group_candidates(members, verify, same_id, traits, possible, 1, ROUNDS, first)
    # a class is as its representative; the class's key may hold a third of the rows
    found = classes.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    grown = found.join(classes.select("set_key", "rep", "copies"), "set_key").where(
        (F.col("copies") > 1) | (F.col("component_id") != F.col("rep"))
    )
    return (
        table.select("id", "n", "set_key")
        .join(grown.select("set_key", "component_id"), "set_key", "left")
        .select(
            F.col("id").alias(key),
            F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
    )
