"""Collocations from mergeable Misra-Gries summaries and an exact second pass.

A text is split into pieces, those into words; phrases are runs of words within a piece. The first pass counts
hashes of all phrases in segments of about ``SEGMENT`` bytes. A segment's counts are a summary without error.
Hashes are dealt to hash partitions, about ``PARTITION_MASS`` occurrences each, and in each partition the
summaries are merged: counters are added up and, if they are more than the capacity, lowered by the first
one that is too many. The capacity is the partition's mass divided by the least count, rounded down, plus
one; so a counter is too low by less than the least count, and every phrase that is frequent keeps one. Phrases
that share a hash share a counter, which only keeps more. What survives becomes a bitmap of bounded size.

The second pass counts, by their words, the phrases whose bit is set, and keeps the frequent ones: the
result is exact whatever the first pass let through. Beyond about 10^8 survivors the bitmap lets through
more and the second pass carries more rows.

Scores are whole numbers in decimal arithmetic. Frequent phrases are joined with their parts, which are
frequent themselves. A part that stands in very many phrases makes a skewed join, which Spark splits as it runs.

Results: null and empty texts have no words; repeated rows count each. A null language is named. A language
without words, or without a phrase that is frequent enough, has no rows. A count above 10^16 raises. Ties go as
stated for ``collocations``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.plans.storage import stored

#: Bytes of text that are counted at once, and words that are hashed at once.
SEGMENT, WORDS_AT_ONCE = 4_000_000, 200_000
PARTITION_MASS = 2_000_000
#: Letters of text for a phrase's occurrence, about; only the number of hash partitions follows from it.
CHARS_PER_PHRASE = 2
BITMAP_BITS = 27
BUCKET_BITS = 15  # of Spark's bitmap functions
#: What ends a piece. Words are separated by spaces and tabs.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A byte that is in no UTF-8 text stands for the end of a piece.
GAP, SPACE = 0xFF, 0x20
READ = bytes.maketrans(PIECE_ENDS + b"\t", bytes([GAP]) * len(PIECE_ENDS) + b" ")
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BASES = np.array([0x5851F42D4C957F2D, 0xD1342543DE82EF95], np.uint64)
COUNT = "decimal(16,0)"


def read(text: str) -> bytes:
    """A text in lower case (A-Z only), with gaps for the ends of pieces and spaces for tabs."""
    return text.encode().lower().translate(READ)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * SPREAD
    return values ^ (values >> np.uint64(29))


def word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for each word, from the bytes of all words in a row: two polynomials, mixed."""
    out = np.zeros(len(sizes), np.uint64)
    powers = np.ones((len(BASES), int(sizes.max(initial=0)) + 1), np.uint64)
    for row, base in zip(powers, BASES):
        row[1:] = base
        np.multiply.accumulate(row, out=row)
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), WORDS_AT_ONCE):
        part = slice(at, at + WORDS_AT_ONCE)
        first, last = ends[at] - sizes[at], ends[part][-1]
        starts = ends[part] - sizes[part] - first
        place = np.arange(last - first) - np.repeat(starts, sizes[part])
        values = letters[first:last].astype(np.uint64) + np.uint64(1)
        for row in powers:
            out[part] = mixed(out[part] + np.add.reduceat(values * row[place], starts))
    return out


class Segment:
    """Texts as arrays: the words' bytes, sizes and hashes, each word's piece and language."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        whole = np.frombuffer(bytes([GAP]).join([t for _, t in texts]) + b" ", np.uint8)
        in_word = (whole != SPACE) & (whole != GAP)
        turns = np.flatnonzero(np.diff(in_word, prepend=False))
        starts, self.sizes = turns[::2], turns[1::2] - turns[::2]
        self.letters = whole[in_word]
        self.hashes = word_hashes(self.letters, self.sizes)
        gaps = np.flatnonzero(whole == GAP)
        self.piece = np.searchsorted(gaps, starts)
        self.languages = sorted({language for language, _ in texts})
        numbers = {language: i for i, language in enumerate(self.languages)}
        ends = np.cumsum([len(t) + 1 for _, t in texts])
        of_text = np.array([numbers[language] for language, _ in texts])
        self.language = of_text[np.searchsorted(ends, starts, side="right")]
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 43) for x in self.languages], np.uint64)
        self.seeds = seeds[self.language]

    def totals(self) -> np.ndarray:
        """Words of each language."""
        return np.bincount(self.language, minlength=len(self.languages))

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, places, hashes) of all phrases, by length."""
        value = self.seeds
        for n in range(1, most + 1):
            size = max(len(self.sizes) - n + 1, 0)
            value = mixed(value[:size] * SPREAD + self.hashes[n - 1 : n - 1 + size])
            places = np.flatnonzero(self.piece[:size] == self.piece[n - 1 : n - 1 + size])
            yield n, places, value[places]

    def words(self) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(
            len(self.sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.letters))
        )


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """Of (language, text), a text never cut."""
    texts, size = [], 0
    for batch in batches:
        for language, text in zip(*(c.to_pylist() for c in batch.columns)):
            texts.append((language, read(text)))
            size += len(texts[-1][1])
            if size >= SEGMENT:
                yield Segment(texts)
                texts, size = [], 0
    if texts:
        yield Segment(texts)


def slots(hashes: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash partition, 32 bits of the hash that tell phrases apart within it)."""
    high, low = hashes >> np.uint64(32), hashes.astype(np.uint32)
    return (high % np.uint64(partitions)).astype(np.int64), low


def packed_slots(hashes: np.ndarray, partitions: int) -> np.ndarray:
    part, keys = slots(hashes, partitions)
    return part.astype(np.uint64) << np.uint64(32) | keys


def bits_of(partition: np.ndarray | int, keys: np.ndarray) -> np.ndarray:
    """Places in the bitmap."""
    turned = mixed(keys.astype(np.uint64) * SPREAD + np.uint64(1) * np.asarray(partition, np.uint64))
    return (turned >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint32(1)))
    return keys[starts], np.add.reduceat(counts, starts)


class Summary:
    """A Misra-Gries summary: counters that are too low by at most ``error``."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        if not len(keys):
            return
        keys, counts = added_up(keys, counts)
        if len(keys) > self.capacity:
            place = len(counts) - self.capacity - 1
            excess = np.partition(counts, place)[place]
            left = counts > excess
            keys, counts = keys[left], counts[left] - excess
            self.error += int(excess)
        self.keys, self.counts = keys, counts

    def at_least(self, least: int) -> np.ndarray:
        """The keys that may have been counted so often, all that have among them."""
        return self.keys[self.counts + self.error >= least]


def summaries(texts: DataFrame, most: int, partitions: int) -> DataFrame:
    """(part, mass, keys, counts): for each segment and hash partition its counters, packed."""

    def work(batches: Iterator[pa.RecordBatch]):
        for segment in segments(batches):
            packed = np.concatenate([packed_slots(values, partitions) for _, _, values in segment.phrases(most)])
            packed.sort()
            starts = np.flatnonzero(np.diff(packed, prepend=packed[:1] ^ np.uint64(1)))
            counts = np.diff(starts, append=len(packed))
            packed = packed[starts]
            parts, firsts = np.unique(packed >> np.uint64(32), return_index=True)
            ends = [*firsts[1:], len(packed)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts.astype(np.int32)),
                    pa.array([int(counts[a:b].sum()) for a, b in zip(firsts, ends)], pa.int64()),
                    pa.array([packed[a:b].astype("<u4").tobytes() for a, b in zip(firsts, ends)], pa.binary()),
                    pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(firsts, ends)], pa.binary()),
                ],
                names=["part", "mass", "keys", "counts"],
            )

    return texts.mapInArrow(work, "part int, mass bigint, keys binary, counts binary")


def surviving(summed: DataFrame, least: int) -> DataFrame:
    """(bit) of every hash that may be of a frequent phrase."""

    def merge(group: pa.Table) -> pa.Table:
        mass = sum(group.column("mass").to_pylist())
        summary = Summary(mass // least + 1)
        keys, counts, waiting = [], [], 0
        for packed, numbers in zip(group.column("keys"), group.column("counts")):
            keys.append(np.frombuffer(packed.as_py(), "<u4"))
            counts.append(np.frombuffer(numbers.as_py(), "<u4").astype(np.int64))
            waiting += len(keys[-1])
            if waiting > summary.capacity:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, waiting = [], [], 0
        if keys:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
        part = group.column("part")[0].as_py()
        return pa.table({"bit": bits_of(part, summary.at_least(least))})

    return summed.groupBy("part").applyInArrow(merge, "bit bigint")


def bitmap(bits: DataFrame) -> bytes:
    """2^``BITMAP_BITS`` bits, the set ones given; built by bucket in the executors, of this size for any corpus."""
    rows = (
        bits.groupBy(F.shiftright("bit", BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("bit") % (1 << BUCKET_BITS)).alias("set"))
        .collect()
    )
    size = 1 << BUCKET_BITS - 3
    whole = bytearray(1 << BITMAP_BITS - 3)
    for row in rows:
        whole[row["bucket"] * size : (row["bucket"] + 1) * size] = row["set"]
    return bytes(whole)


def counted(texts: DataFrame, most: int, partitions: int, candidates: bytes, least: int) -> DataFrame:
    """(language, words, phrase, f), stored: exact counts of frequent phrases; with 0 words, of all words."""
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    def work(batches: Iterator[pa.RecordBatch]):
        bits = np.frombuffer(shared.value, np.uint8)
        for segment in segments(batches):
            names, words = pa.array(segment.languages), segment.words()
            totals = segment.totals()
            yield rows(names, 0, pa.array([""] * len(names)), totals)
            for n, places, values in segment.phrases(most):
                at = bits_of(*slots(values, partitions))
                chosen = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                _, firsts, counts = np.unique(values[chosen], return_index=True, return_counts=True)
                places = places[chosen][firsts]
                joined = [words.take(pa.array(places + i)) for i in range(n)]
                phrase = pc.binary_join_element_wise(*joined, pa.scalar(" ", pa.large_string())) if n > 1 else joined[0]
                yield rows(names.take(pa.array(segment.language[places])), n, phrase, counts)

    def rows(language: pa.Array, n: int, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        columns = [language, pa.array(np.full(len(counts), n, np.int32)), phrase.cast(pa.string()), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, names=["language", "words", "phrase", "f"])

    found = texts.mapInArrow(work, "language string, words int, phrase string, f bigint")
    summed = found.groupBy("language", "words", "phrase").agg(F.sum("f").alias("f"))
    return stored(summed.where((F.col("f") >= least) | (F.col("words") == 0)))


def hash_partitions(texts: DataFrame, most: int) -> int:
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(-(-chars * most // (CHARS_PER_PHRASE * 3 * PARTITION_MASS)), 1)


def frequent_phrases(docs: DataFrame, most: int, least: int, text: str, language: str, none: str) -> DataFrame:
    """(language, words, phrase, f) of all phrases of up to ``most`` words that occur ``least`` times or more."""
    texts = docs.where(F.length(text) > 0).select(
        F.coalesce(F.col(language).cast("string"), F.lit(none)).alias("language"), F.col(text).alias("text")
    )
    partitions = hash_partitions(texts, most)
    bits = bitmap(surviving(summaries(texts, most, partitions), least))
    return counted(texts, most, partitions, bits, least)


def part_of(first: int, last: Column | int) -> Column:
    """The words numbered from ``first`` up to ``last`` of a phrase, numbers from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), F.lit(first), last - F.lit(first) + 1), " ")


def with_scores(phrases: DataFrame, most: int) -> DataFrame:
    """(language, words, phrase, a, l, r, score) of phrases of two words or more, at the cut of the lowest score."""
    known = phrases.where(F.col("words") > 0)
    whole = known.where(F.col("words") > 1).withColumnRenamed("f", "a")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "language",
        "words",
        "phrase",
        "a",
        "k",
        part_of(1, F.col("k")).alias("left"),
        F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        parts = known.select("language", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(parts, ["language", side])
    score = F.expr(f"(1000000 * (cast(a as {COUNT}) * cast(a as {COUNT}))) div (cast(l as {COUNT}) * cast(r as {COUNT}))")
    cuts = cuts.withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("language", "words", "phrase", "a").agg(lowest).select(
        "language", "words", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def contained(scored: DataFrame, most: int, percent: int) -> DataFrame:
    """(language, phrase) of the phrases that a longer one holds in ``percent`` of its occurrences or more."""
    longer = scored.where(F.col("words") > 2)
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("words") - n + 1),
                lambda at: F.array_join(F.slice(words, at, n), " "),
            ),
        )
    )
    most_common = (
        longer.select("language", F.explode(inner).alias("phrase"), "a")
        .groupBy("language", "phrase")
        .agg(F.max("a").alias("longest"))
    )
    return (
        scored.select("language", "phrase", "a")
        .join(most_common, ["language", "phrase"])
        .where(100 * F.col("longest") >= percent * F.col("a"))
        .select("language", "phrase")
    )


def collocations(
    docs: DataFrame,
    most: int = 3,
    least: int = 10,
    percent: int = 50,
    top: int | None = 2000,
    text: str = "text",
    language: str = "lang",
    none: str = "und",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``most`` words.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut of the lowest score
    floor(1000000 * a * a / (l * r)), of equal ones the first; ``n`` counts the language's words. Phrases that
    occur in a longer one ``percent`` of the time or more are left out. Order: score and a descending, phrase.
    """
    phrases = frequent_phrases(docs, most, least, text, language, none)
    scored = stored(with_scores(phrases, most))
    left = scored.join(contained(scored, most, percent), ["language", "phrase"], "left_anti")
    totals = phrases.where(F.col("words") == 0).select("language", F.col("f").alias("n"))
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "language").select(
        F.col("language").alias("lang"), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
