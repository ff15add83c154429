"""Hard negatives by bounds along a spanning tree of anchors.

Scores are inner products of vectors of whole numbers. Anchors are dealt to strips, and each strip gets a
spanning tree of least total length. A candidate's score at a tree's root is computed; at every other anchor
it lies within its score at the parent, give or take the length of the edge times the candidate's norm. Only
candidates whose bounds overlap the window sought are scored anew; the others pass their bounds on to the
children, widened by the next edge. The results are exact.

Two sweeps follow each other. The first looks for an anchor's positives, the best rows of its label: the
window opens at the k-th highest lower bound. The second looks for negatives, rows of other labels whose
score lies between a share of a positive's score and that score: the window is narrowed to the k-th highest
lower bound among the rows that are surely within.

Both sweeps deal candidates to parts of about ``PART_ROWS`` rows and anchors to strips of about
``STRIP_ROWS``; one task call sees one part with one strip, whatever the number of rows, and returns at
most k rows per anchor (and positive). The parts' rows are merged by rank.

Results: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take
no part, nor does one with a component too large to be scaled. Vectors meet only others of their dimension; empty vectors meet each other with the score 0. Ties go
to the smaller id. A row never meets its own id. An anchor row that is repeated whole is mined once; repeated
candidates are rows of their own. An anchor without positives, or a positive without negatives, has no rows.
Extra columns are ignored. A score of more than 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.plans.storage import stored

PART_ROWS, STRIP_ROWS = 4_096, 4_096
MOST_TASKS = 10_000
#: Sums of products below this are exact in double precision, whatever their order.
EXACT = float(2**53)
#: Relative error allowed for in norms and distances, far above that of their computation.
SLACK = 1e-12


def prepared(rows: DataFrame, key: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """(row, id, label, size, parts), stored: the rows that take part, components as whole numbers.

    ``row`` numbers the rows of the table as it is stored, so that it is the same whenever it is read.
    """
    values = vector.cast("array<double>")
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.lit(scale) * v) < float("inf")))

    def rounded(value: Column) -> Column:
        return F.when(F.abs(value) < EXACT, F.floor(value).cast("double")).otherwise(value)

    chosen = rows.where(key.isNotNull() & label.isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"),
        key.cast("bigint").alias("id"),
        label.cast("string").alias("label"),
        F.size(vector).alias("size"),
        F.transform(values, lambda v: rounded(F.lit(scale) * v)).alias("parts"),
    )
    return stored(chosen)


def in_blocks(n: int, rows: int) -> int:
    return max(-(-n // rows), 1)


def block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length) of a tree of least total length: nodes as they join it, each one's parent
    (-1 for the root) and the length of the edge to it, not rounded down."""
    n = len(vectors)
    order, parent = np.zeros(n, int), np.full(n, -1)
    nearest = np.full(n, np.inf)
    waiting = np.ones(n, bool)
    node = 0
    for i in range(n):
        order[i] = node
        waiting[node] = False
        gaps = vectors - vectors[node]
        squares = np.einsum("ij,ij->i", gaps, gaps)
        closer = waiting & (squares < nearest)
        nearest[closer], parent[closer] = squares[closer], node
        if i + 1 < n:
            node = int(np.where(waiting, nearest, np.inf).argmin())
            if not waiting[node]:  # all that wait are infinitely far
                node = int(waiting.argmax())
                parent[node] = order[0]
    nearest[0] = 0.0
    return order, parent, np.sqrt(nearest) * (1 + SLACK)


def depth_first(order: np.ndarray, parent: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Every node after its parent, with the nodes that no later one has as parent.

    Of a node's children the one with most nodes below comes last, so no more nodes wait for a later
    child than the logarithm of their number.
    """
    children: dict[int, list[int]] = {}
    below = np.ones(len(order), int)
    for node in order[::-1]:
        children.setdefault(int(parent[node]), []).append(int(node))
        if parent[node] >= 0:
            below[parent[node]] += below[node]
    waiting = {node: len(found) for node, found in children.items()}
    stack = list(children[-1])
    while stack:
        node = stack.pop()
        stack += sorted(children.get(node, []), key=lambda child: -below[child])
        above = int(parent[node])
        done = [] if node in waiting else [node]
        if above >= 0:
            waiting[above] -= 1
            if not waiting[above]:
                done.append(above)
        yield node, done


def matrix(table: pa.Table) -> np.ndarray:
    size = table.column("size")[0].as_py()
    values = table.column("parts").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, size)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms, not rounded down."""
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * (1 + SLACK)


class Rows:
    """The rows of a part or strip as arrays; labels become numbers by ``codes``."""

    def __init__(self, table: pa.Table, codes: dict[str, int]):
        self.rows, self.ids = (table.column(c).to_numpy() for c in ("row", "id"))
        labels = table.column("label").to_pylist()
        self.labels = np.array([codes.setdefault(label, len(codes)) for label in labels])
        self.vectors = matrix(table)
        self.norms = lengths(self.vectors)


def as_whole(values: np.ndarray) -> np.ndarray:
    """Python's own numbers, for sums that doubles do not hold."""
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def kth_highest(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else np.sort(values)[len(values) - k]


def sweep(part: pa.Table, strip: pa.Table, windows_of, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor's row, window, candidate's row, its id, score) of the k best candidates in each window.

    ``windows_of(i, asked, found, low, high)`` gives for the i-th anchor, from the bounds of all candidates,
    which of them are to be known exactly (a mask), and (number, least, most) of each window.
    """
    codes: dict[str, int] = {}
    found, asked = Rows(part, codes), Rows(strip, codes)
    order, parent, length = spanning_tree(asked.vectors)
    whole = found.norms.max() * asked.norms.max() >= EXACT
    vectors, anchors = (as_whole(r.vectors) if whole else r.vectors for r in (found, asked))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for node, done in depth_first(order, parent):
        if parent[node] < 0:
            low = vectors @ anchors[node]
            high = low.copy()
        else:
            low, high = bounds[int(parent[node])]
            reach = np.ceil(length[node] * found.norms * (1 + SLACK))
            reach = as_whole(reach) if whole else reach
            low, high = low - reach, high + reach
        mask, windows = windows_of(node, asked, found, low, high)
        unknown = np.flatnonzero(mask & (low < high))
        if len(unknown):
            low[unknown] = high[unknown] = vectors[unknown] @ anchors[node]
        for number, least, most in windows:
            inside = np.flatnonzero(mask & (low >= least) & (low <= most)).tolist()
            inside.sort(key=lambda i: (-low[i], found.ids[i], found.rows[i]))
            for i in inside[:k]:
                yield int(asked.rows[node]), number, int(found.rows[i]), int(found.ids[i]), int(low[i])
        bounds[node] = low, high
        for old in done:
            bounds.pop(old, None)


def positive_windows(strip: pa.Table, k: int):
    """The k best rows of the anchor's label."""

    def windows_of(i, asked, found, low, high):
        alike = (found.labels == asked.labels[i]) & (found.ids != asked.ids[i])
        return alike & (high >= kth_highest(low[alike], k)), [(0, -np.inf, np.inf)]

    return windows_of


def negative_windows(strip: pa.Table, k: int, percent: int):
    """The k best rows of other labels in a window below each positive's score."""
    positives = strip.column("positive_scores").to_pylist()

    def windows_of(i, asked, found, low, high):
        other = (found.labels != asked.labels[i]) & (found.ids != asked.ids[i])
        mask, windows = np.zeros(len(other), bool), []
        for number, most in enumerate(positives[i]):
            least = -(-percent * most // 100)
            sure = other & (low >= least) & (high <= most)
            bar = max(least, kth_highest(low[sure], k))
            mask |= other & (high >= bar) & (low <= most)
            windows.append((number, least, most))
        return mask, windows

    return windows_of


def swept(candidates: DataFrame, anchors: DataFrame, counts: tuple[int, int], windows, k: int) -> DataFrame:
    """(anchor, window, row, id, score): the k best of every part for each anchor's windows."""
    parts, strips = in_blocks(counts[0], PART_ROWS), in_blocks(counts[1], STRIP_ROWS)
    at = ["size", "part", "strip"]

    def every(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def work(key, part: pa.Table, strip: pa.Table) -> pa.Table:
        rows = []
        if part.num_rows and strip.num_rows:
            rows = list(sweep(part, strip, windows(strip), k))
        columns = list(zip(*rows)) or [[]] * 5
        names = ["anchor", "window", "row", "id", "score"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    dealt = candidates.withColumn("part", block_of("row", parts)).select("*", every("strip", strips))
    facing = anchors.withColumn("strip", block_of("row", strips)).select("*", every("part", parts))
    tasks = min(2 * parts * strips, MOST_TASKS)
    return (
        dealt.repartition(tasks, *at)
        .groupBy(*at)
        .cogroup(facing.repartition(tasks, *at).groupBy(*at))
        .applyInArrow(work, "anchor bigint, window int, row bigint, id bigint, score bigint")
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``key``. Components are multiplied by ``scale`` and rounded down. For each
    anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of
    other labels whose score is at least ``percent`` of the positive's and not above it.
    """
    kind = F.col(label) if isinstance(label, str) else label
    marked = rows.withColumn(key, F.col(key).cast("bigint"))
    table = prepared(marked, F.col(key), kind, F.col(vector), scale)
    chosen = table.withColumnRenamed("id", key).where(is_anchor).withColumnRenamed(key, "id")
    anchors = stored(chosen.groupBy("id", "label", "size", "parts").agg(F.min("row").alias("row")))
    counts = table.count(), anchors.count()

    near = stored(
        ranked(swept(table, anchors, counts, lambda strip: positive_windows(strip, positives), positives), positives)
    )
    lists = near.groupBy("anchor").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias(
            "positive_scores"
        )
    )
    asking = anchors.join(lists.withColumnRenamed("anchor", "row"), "row")
    hard = ranked(
        swept(table, asking, counts, lambda strip: negative_windows(strip, negatives, percent), negatives), negatives
    )
    of_anchor = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = near.join(of_anchor, "anchor").select(
        "anchor",
        (F.col("rank") - 1).alias("window"),
        "anchor_id",
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return pairs.join(hard, ["anchor", "window"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
