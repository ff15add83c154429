"""Groups from candidate buckets: pairs tested against pivots, then connected components.

Texts of one bucket may be alike. Testing all pairs of a bucket would grow with its square, and
testing only against one row could lose a link. So each round tests the members of every bucket
against its next few pivots, most central first, and only where the two are not in one group yet;
groups are formed anew after each round. A bucket is done when its members are one group or every
member but the last has been a pivot. Copies of one text therefore cost a test each, and still no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.plans.storage import release, stored, sweep

PIVOTS = [1, 8, 64, 512]
#: A member of a bucket as it is moved; sizes from ``LARGE`` on count as that. Members packed and sorted at once.
MEMBER = np.dtype([("low", "<u4"), ("band", "u1"), ("size", "<u2"), ("id", "<i8")])
LARGE, PACKED_AT_ONCE, MEMBERS_AT_ONCE = 65_535, 500_000, 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them evenly."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stars(edges: DataFrame) -> DataFrame:
    """(u, v), stored: every id in ``edges`` that is not the smallest reachable, and that one, by alternating stars.

    The large star ties the larger neighbours of an id to its smallest neighbour, the small star the
    smaller ones; both together end with every id tied to the smallest of its component.
    """
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stored(edges.where(F.col("u") != F.col("v")).select(larger, smaller).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
        if mark["n"] == 0 or mark == before:
            return now
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a row for an edge at most; the small star removes the repeats
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.*")
        older, now = now, stored(small.where(F.col("u") != F.col("v")).distinct())
        release(older)


def with_roots(tied: DataFrame) -> DataFrame:
    """(id, component) from ``stars``, the smallest ids too."""
    roots = tied.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return tied.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in (u, v): the smallest id reachable."""
    return with_roots(stars(edges))


def crowded(members: DataFrame) -> DataFrame:
    """(bucket, id, n), stored: the members of buckets that have more than one, and how many.

    Most buckets have one member; counting within the bucket moves each member once.
    """
    counted = members.withColumn("n", F.count("*").over(Window.partitionBy("bucket")))
    found = stored(counted.where(F.col("n") > 1).select("bucket", "id", "n"))
    sweep(members.sparkSession)
    return found


def crowded_alike(rows: DataFrame, percent: int, members: int) -> DataFrame:
    """As ``crowded``, from (id, size, bands): a band is a bucket by its number and its value, a row's id may be given
    by many rows and counts once.

    Two rows whose sizes differ by more than ``percent`` allows cannot be alike: a bucket is cut where that is so of
    neighbours by size, and the parts are buckets. The shuffle moves the members in packs, not as rows. ``members``
    tells how many there are, for the number of parts of which each is sorted as a whole, in Python's memory.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), members // MEMBERS_AT_ONCE)
    packs = 4 * parts

    def pack(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            lists = batch.column(2)
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            made = np.empty(counts.sum(), MEMBER)
            made["low"] = lists.flatten().to_numpy(zero_copy_only=False)
            made["band"] = np.arange(len(made)) - np.repeat(np.cumsum(counts) - counts, counts)
            made["id"] = np.repeat(batch.column(0).to_numpy(), counts)
            made["size"] = np.repeat(np.minimum(batch.column(1).to_numpy(), LARGE), counts)
            held.append(made)
            n += len(made)
            if n > PACKED_AT_ONCE:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        made = np.concatenate(held)
        to = (mixed(made["low"].astype(np.uint64) << np.uint64(8) | made["band"]) % np.uint64(packs)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        data, cuts = made[order].tobytes(), np.searchsorted(to[order], np.arange(packs + 1)) * MEMBER.itemsize
        full = np.flatnonzero(np.diff(cuts))
        blobs = [data[cuts[i] : cuts[i + 1]] for i in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["pack", "data"])

    def crowds(batches: Iterator[pa.RecordBatch]):
        data = b"".join(blob for batch in batches for blob in batch.column(1).to_pylist())
        given = np.frombuffer(data, MEMBER)
        bucket = given["low"].astype(np.uint64) << np.uint64(8) | given["band"]
        first = np.argsort(bucket)
        bucket = bucket[first]
        new = np.diff(bucket, prepend=~bucket[:1]) != 0
        # the members of most buckets are alone
        several = ~(new & np.append(new[1:], True)) if len(new) else new
        first, bucket = first[several], bucket[several]
        id_, size = given["id"][first], given["size"][first].astype(np.int64)
        order = np.lexsort((id_, size, bucket))
        bucket, id_, size = bucket[order], id_[order], size[order]
        once = np.diff(bucket, prepend=~bucket[:1]) != 0
        once[1:] |= np.diff(id_) != 0
        bucket, id_, size = bucket[once], id_[once], size[once]
        opens = np.diff(bucket, prepend=~bucket[:1]) != 0
        opens[1:] |= 100 * size[:-1] < percent * size[1:]
        part = np.cumsum(opens) - 1
        n = np.bincount(part)[part] if len(part) else part
        name = mixed(bucket ^ mixed(id_[opens].view(np.uint64))[part]).view(np.int64)
        kept = n > 1
        found = pa.table([name[kept], id_[kept], n[kept].astype(np.int64)], names=["bucket", "id", "n"])
        yield from found.to_batches(100_000)

    dealt_out = rows.select("id", "size", "bands").mapInArrow(pack, "pack int, data binary").repartition(parts, "pack")
    found = stored(dealt_out.mapInArrow(crowds, "bucket bigint, id bigint, n bigint"))
    sweep(spark)
    return found


def group_candidates(
    shared: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    known: DataFrame | None = None,
    traits: Callable[[DataFrame], DataFrame] | None = None,
    possible: Callable[[Column, Column], Column] | None = None,
    traits_from: int = 0,
    pivots_to: Sequence[int] = PIVOTS,
    first: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(id, component) of all ids that have a link, from (bucket, id, n) as ``crowded`` gives them
    (stored, and used up here). Every bucket's first ``pivots_to`` members are pivots, round by round.

    ``verify`` takes distinct pairs (a, b) with a < b and returns those that are links. ``known`` are
    links (u, v) that need no test. ``traits`` gives (id, trait) of the ids in a round, from the round
    numbered ``traits_from``, or ``shared`` has a column ``trait``, if it is small; ``possible`` says of
    two traits whether a link can be at all; what it rules out within the join of a bucket is no pair. ``first``
    gives the first bucket that two ids share, from their traits: there alone they make a pair.
    """
    spark = shared.sparkSession
    kind = shared.schema["id"].dataType.simpleString()
    weighed = shared.withColumn("weight", F.sum("n").over(Window.partitionBy("id")))
    given, shared = shared, stored(weighed)
    release(given)
    none = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name in ("u", "v")])
    edges = known if known is not None else none
    tied = stars(edges.select("u", "v"))
    largest = shared.agg(F.max("n")).first()[0] or 0
    tested = rounds = 0
    steps = list(pivots_to)
    carried = ["trait"] if "trait" in shared.columns else []
    known_traits = None
    # a bucket's last member need not be a pivot, as all others have met it
    while tested + 1 < largest:
        pivots = steps.pop(0) if steps else tested * 8
        left = shared.where(F.col("n") > tested + 1)
        linked = bool(tied.take(1))
        if linked:
            labels = tied.select(F.col("u").alias("id"), F.col("v").alias("component"))
            left = left.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
        else:
            left = left.withColumn("label", F.col("id"))
        if linked:
            alone = Window.partitionBy("bucket")
            left = left.withColumn("lo", F.min("label").over(alone)).withColumn("hi", F.max("label").over(alone))
            left = left.where(F.col("lo") != F.col("hi"))
        rows = left.select("bucket", "id", "label", "weight", *carried)
        rows = stored(rows) if linked else rows
        if not rows.take(1):
            break
        if traits and rounds >= traits_from and known_traits is None:
            known_traits = stored(traits(rows.select("id").distinct()))
        sweep(spark)
        described = rows.join(known_traits, "id") if known_traits else rows
        order = Window.partitionBy("bucket").orderBy(F.desc("weight"), "id")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots)
        chosen = ranked.where(F.col("rank") > tested)
        if known_traits:
            chosen = chosen.join(known_traits, "id")
        chosen = chosen.select(
            F.col("bucket").alias("pivot_bucket"),
            F.col("id").alias("pivot"),
            F.col("label").alias("pivot_label"),
            F.col("weight").alias("pivot_weight"),
            *([F.col("trait").alias("pivot_trait")] if carried or known_traits else []),
        )
        meet = (F.col("bucket") == F.col("pivot_bucket")) & (F.col("label") != F.col("pivot_label"))
        # a member that ranks before the pivot has been one itself, now or in a round before
        ahead = (F.col("pivot_weight") == F.col("weight")) & (F.col("pivot") < F.col("id"))
        meet &= (F.col("pivot_weight") > F.col("weight")) | ahead
        if carried or known_traits:
            meet &= possible(F.col("trait"), F.col("pivot_trait"))
        if first and known_traits:
            meet &= first(F.col("trait"), F.col("pivot_trait")) == F.col("bucket")
        pairs = stored(
            described.join(chosen, meet)
            .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
            .distinct()
        )
        tested, rounds = pivots, rounds + 1
        if linked:
            release(rows)
        if not pairs.take(1):
            release(pairs)
            continue
        found = stored(verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v")))
        release(pairs)
        if found.take(1):
            # what is tied so far stands for all links before
            older, tied = tied, stars(tied.union(found))
            release(older)
        release(found)
        sweep(spark)
    for used in (shared, known_traits):
        if used is not None:
            release(used)
    return with_roots(tied)
