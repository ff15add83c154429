"""Largest containment of examples in texts when the examples are too many to broadcast.

A text meets an example by every shingle they share, and a common shingle stands in many texts and in many
examples, so these meetings grow with the square of the corpus. Only the best example of a group counts, which
spares most of them. Shingles are put in one order, rare ones first. The best single shingle of a text gives a
score to beat; an example of ``size`` shingles beats it with at least ``need`` shared ones, and a meeting at
which fewer than ``need - 1`` shingles are left, in the text or in the example, is skipped. What is skipped of a
pair is then at most ``need - 2``, so a pair that can win is met at least twice; the few pairs for which that
leaves the score open are counted again in full. The scores are exact.

Texts and examples given more than once under the same keys count their shingles as often, as in the plain join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.plans.session import materialize

#: Bits of the map of known shingles at most, and wanted for each shingle.
MAX_MAP_BITS = 1 << 26
BITS_EACH = 32
#: A shingle of more examples than this is joined in several parts, at most so many.
EXAMPLES_PER_PART = 100
MAX_PARTS = 64


@dataclass(frozen=True)
class ExampleIndex:
    """``terms`` (shingle, group, term, examples, best), one row per shingle and group; ``postings`` (term, part,
    example, size, times, rest, most), one per shingle and example, common ones once per part; ``known``
    is a map of the shingles' hashes: 64 bits in each of its numbers."""

    terms: DataFrame
    postings: DataFrame
    known: DataFrame
    slots: int

    def with_known(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, shingle) of the array ``parts``: the distinct known shingles, and the few that look known.

        Every row has one more row with a null shingle. The map is read after the explode: as a column beside the
        array it would be copied with every row.
        """
        ended = F.concat(F.array_distinct("parts"), F.array(F.lit(None).cast("string")))
        place = F.pmod(F.xxhash64("shingle"), F.lit(self.slots * 64))
        word = F.get(self.known.scalar(), F.floor(place / 64).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
        every = rows.select(*keep, F.explode(F.coalesce(ended, F.array(F.lit(None).cast("string")))).alias("shingle"))
        return every.where(F.col("shingle").isNull() | (word.bitwiseAND(bit) != 0))


def parts_of(examples: Column) -> Column:
    return F.least(F.lit(MAX_PARTS), 1 + F.floor(examples / EXAMPLES_PER_PART)).cast("int")


def shingle_map(terms: DataFrame, slots: int) -> DataFrame:
    """One row with one array of ``slots`` numbers."""
    filled = terms.selectExpr(
        f"pmod(xxhash64(shingle), {slots * 64}) div 64 AS slot",
        "shiftleft(1L, cast(pmod(xxhash64(shingle), 64) AS int)) AS bits",
    )
    every = terms.sparkSession.range(slots).selectExpr("id AS slot", "0L AS bits")
    words = filled.unionByName(every).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "bits")))
    return words.agg(F.transform(ordered, lambda w: w["bits"]).alias("known"))


def index_examples(table: DataFrame) -> ExampleIndex:
    """The index of (shingle, group, example_id, size), a row per shingle of an example."""
    rows = table.where("group IS NOT NULL AND example_id IS NOT NULL")
    example = ["group", "example_id", "size"]
    numbered = materialize(rows.select(*example).distinct().withColumn("example", F.monotonically_increasing_id()))
    counted = materialize(
        rows.join(numbered, example).groupBy("shingle", "group", "example", "size").agg(F.count(F.lit(1)).alias("times"))
    )
    best = F.max(F.struct((F.col("times") / F.col("size")).alias("score"), "times", "size"))
    terms = materialize(
        counted.groupBy("shingle", "group")
        .agg(F.count(F.lit(1)).alias("examples"), best.alias("best"))
        .withColumn("term", F.monotonically_increasing_id())
    )
    of_example = Window.partitionBy("example")
    rest = F.sum("times").over(of_example.orderBy(F.desc("examples"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
    postings = (
        counted.join(terms.select("shingle", "group", "term", "examples"), ["shingle", "group"])
        .withColumns({"rest": rest, "most": F.max("times").over(of_example)})
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts_of(F.col("examples")) - 1)))
    )
    stored = materialize(postings.select("term", "part", "example", "size", "times", "rest", "most"))
    slots = 1
    while slots * 64 < min(MAX_MAP_BITS, BITS_EACH * terms.count()):
        slots *= 2
    return ExampleIndex(terms, stored, materialize(shingle_map(terms, slots)), slots)


def text_terms(found: DataFrame, index: ExampleIndex) -> DataFrame:
    """(text, group, term, part, times, rest, most, total, bound), stored: the known shingles of each text.

    ``bound`` is what the best single shingle scores, ``rest`` the text's shingles from this one to the most common.
    """
    met = found.where("shingle IS NOT NULL").join(index.terms, "shingle")
    counted = (
        met.select("text", "group", "term", "examples", "best")
        .repartition("text", "group")
        .groupBy("text", "group", "term", "examples", "best")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    of_text = Window.partitionBy("text", "group")
    order = of_text.orderBy(F.desc("examples"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    alone = F.col("times") * F.col("best.times") / F.col("best.size")
    part = F.pmod(F.xxhash64("text"), parts_of(F.col("examples"))).cast("int")
    return materialize(
        counted.select(
            "text", "group", "term", part.alias("part"), "times",
            F.sum("times").over(order).alias("rest"),
            F.max("times").over(of_text).alias("most"),
            F.sum("times").over(of_text).alias("total"),
            F.max(alone).over(of_text).alias("bound"),
        )
    )


def meetings(terms: DataFrame, index: ExampleIndex) -> DataFrame:
    """(text, group, bound, example, size, shared): the shared shingles at which a pair may still beat the bound."""
    t, e = terms.alias("t"), index.postings.alias("e")
    need = F.floor(F.col("t.bound") * F.col("e.size")) + 1
    left = F.least(F.col("t.rest") * F.col("e.most"), F.col("e.rest") * F.col("t.most"))
    return t.join(
        e,
        (F.col("t.term") == F.col("e.term"))
        & (F.col("t.part") == F.col("e.part"))
        & (left >= need - 1)
        & (F.col("t.total") * F.col("e.most") >= need),
    ).select("text", "group", "bound", "example", "size", (F.col("t.times") * F.col("e.times")).alias("shared"))


def largest_containment(found: DataFrame, index: ExampleIndex) -> DataFrame:
    """(text, group, score) of the texts that share a shingle with an example, from (text, shingle).

    A text and group may have several rows; the largest score counts.
    """
    terms = text_terms(found, index)
    pairs = (
        meetings(terms, index)
        .repartition("text", "group")
        .groupBy("text", "group", "bound", "example", "size")
        .agg(F.sum("shared").alias("shared"))
        .where("shared > 1")
    )
    score = F.col("shared") / F.col("size")
    skipped = F.greatest(F.floor(F.col("bound") * F.col("size")) - 1, F.lit(0))
    best = F.max(F.greatest("bound", score)).over(Window.partitionBy("text", "group"))
    near = materialize(
        pairs.select("*", score.alias("score"), ((F.col("shared") + skipped) / F.col("size")).alias("most"), best.alias("best"))
        .where("score >= best OR most > best")
        .select("text", "group", "example", "size", "score", "most", "best")
    )
    again = near.where("most > best AND most > score").select("text", "group", "example", "size")
    postings = index.postings.where("part = 0").select("term", "example", F.col("times").alias("there"))
    recounted = (
        again.join(terms.select("text", "group", "term", "times"), ["text", "group"])
        .join(postings, ["example", "term"])
        .groupBy("text", "group", "example", "size")
        .agg(F.sum(F.col("times") * F.col("there")).alias("shared"))
    )
    return (
        terms.groupBy("text", "group").agg(F.max("bound").alias("score"))
        .unionByName(near.select("text", "group", "score"))
        .unionByName(recounted.select("text", "group", score.alias("score")))
    )
