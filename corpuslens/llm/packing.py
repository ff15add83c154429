"""Best-fit packing of token pieces into sequences of one length.

Bulk-synchronous best-fit, largest first. Documents are sorted by length and numbered within each
length by Spark; gaps are kept sorted by size. A round takes all documents of one length and sweeps
through the gaps from the successor of that length upwards (the smallest gap that fits), the rank
within the length deciding which document gets which gap; the gaps are updated and the next length
follows. What fits nowhere opens new sequences. Lengths and gaps are whole numbers up to the
capacity, so documents of one length are alike, and so are gaps of one size: a round moves runs
(length, first rank, count) rather than rows. There are at most ``capacity`` rounds over at most as
many runs, whatever the size of the corpus; the rows are touched twice, to be numbered
and to be given their place.

Results: a null or empty text is the end id alone. Only a document longer than the capacity is
cut, its first piece being the shorter one. Every row gives its pieces, repeated rows too.
A table without rows gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.plans.storage import stored

CACHED_WORDS, CACHED_CHARS, ROWS_AT_ONCE = 200_000, 40, 200
NUMBERED_AT_ONCE = 100_000

#: The split that comes before the merges of byte-level models; white space as Unicode defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of these characters alone, which the standard library matches faster.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER_CHARACTER = re.compile(rf"[^\t-\r -~{LETTERS}]")
PLAIN_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
)

_encoders: dict[int, WordEncoder] = {}


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: itself where it can be seen,
    else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_ranks(definition: str) -> dict[bytes, int]:
    """Tokens by their bytes. Ids must follow the order of the merges, as in byte-level BPE they do."""
    model = json.loads(definition)["model"]
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of this model do not follow its merges")
    table = byte_characters()
    base = {token for token in vocabulary if len(token) == 1}
    chosen = base | {token for token, i in vocabulary.items() if merged[0] <= i <= merged[-1]}
    return {bytes(table[c] for c in token): vocabulary[token] for token in chosen}


def read_added(definition: str) -> dict[str, int]:
    """Added tokens, which a text holds as they stand, by their content. Settings that are not handled raise."""
    whole = json.loads(definition)
    split = whole.get("pre_tokenizer") or {}
    model = whole["model"]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    changed = [k for k in ("normalizer", "truncation", "padding") if whole.get(k)]
    changed += [
        k
        for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get(k)
    ]
    added = whole.get("added_tokens") or []
    changed += [k for t in added for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if changed or not plain:
        raise ValueError(f"settings of the tokenizer that are not handled: {changed or ['pre_tokenizer']}")
    return {t["content"]: t["id"] for t in added if t["content"]}


class WordEncoder:
    """Ids as little-endian 32-bit words, looked up by the words into which the model splits a text."""

    def __init__(self, definition: str):
        self.merges = tiktoken.Encoding(
            "words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(definition), special_tokens={}
        )
        self.split = regex.compile(SPLIT)
        self.added = {t: array("I", [i]).tobytes() for t, i in read_added(definition).items()}
        # of tokens that begin alike the longest, as in the library
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(longest)})") if longest else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.parts is None or not any(token in text for token in self.added):
            return self._encode_plain(text)
        parts = self.parts.split(text)  # every second one is an added token
        return b"".join([self.added[p] if i % 2 else self._encode_plain(p) for i, p in enumerate(parts)])

    def _encode_plain(self, text: str) -> bytes:
        known, learn = self.words, self._learn
        split = self.split if OTHER_CHARACTER.search(text) else PLAIN_SPLIT
        return b"".join([known.get(word) or learn(word) for word in split.findall(text)])

    def _learn(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.merges.encode_ordinary(word)).tobytes()
        if len(word) <= CACHED_CHARS:
            self.words[word] = ids
            if len(self.words) >= CACHED_WORDS:
                self.older.clear()
                self.older.update(self.words)
                self.words.clear()
        return ids


def word_encoder(definition: str) -> WordEncoder:
    """One encoder per worker process and model, so that its lists last from task to task."""
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, and before them what is left over."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, total, capacity))]


def token_pieces(
    docs: DataFrame,
    definition: str,
    capacity: int,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, piece, start, length, ids_crc32): the pieces of every whole text.

    ``definition`` is the text of the tokenizer's file, which must be of the byte-level kind.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        encoder = word_encoder(definition)
        end = int(end_id).to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                row, piece, starts, lengths, sums = [], [], [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    ids = memoryview(encoder.encode(value or "") + end)
                    for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(i)
                        piece.append(number)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )

    chosen = docs.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInArrow(
        work, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each run; a run ends where the next begins.

    The gaps are runs of sequences (gap, first sequence, count), sorted by gap.
    """
    runs: list[tuple[int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                gap, first, count = gaps.pop(at)
            else:
                gap, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            taken = min(left, count)
            runs.append((length, rank, first, capacity - gap))
            if taken < count:
                insort(gaps, (gap, first + taken, count - taken))
            if gap > length:
                insort(gaps, (gap - length, first, taken))
            rank, left = rank + taken, left - taken
    return runs


def numbered(pieces: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """Add ``rank``, from 0 within each length.

    A length with many rows is dealt over as many groups as it needs, and each group's ranks
    start where the one before it ends, so no task holds more than a bounded share of a length.
    """
    groups = F.ceil(F.col("n") / F.lit(NUMBERED_AT_ONCE)).cast("int")
    spark = pieces.sparkSession
    sizes = spark.createDataFrame(sorted(counts.items()), "length bigint, n bigint")
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn(
        "part", F.pmod(F.xxhash64(*order), groups)
    )
    parts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order))
    return (
        dealt.withColumn("place", within)
        .join(parts, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .drop("n", "part", "before", "place")
    )


def best_fit(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read three times: pass a stored table. ``order`` settles ranks among equal lengths.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    spark = pieces.sparkSession
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    runs = np.array(sorted(plan_runs(counts, capacity)), dtype=np.int64)
    shared = spark.sparkContext.broadcast(runs)
    ranked = numbered(pieces, counts, order)

    def place(batches: Iterator[pa.RecordBatch]):
        runs = shared.value
        firsts = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(firsts, length * (1 << 44) + rank, side="right") - 1]
            keep = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in keep]
                + [pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])],
                names=[*keep, "sequence_id", "offset"],
            )

    kept = ranked.drop("rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    definition: str,
    capacity: int = 1024,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of every document and their places; offsets leave no space within a sequence."""
    pieces = stored(token_pieces(docs, definition, capacity, end_id, key, text))
    placed = best_fit(pieces, capacity, [key, "piece", "ids_crc32"])
    return placed.select(
        key, F.col("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )
