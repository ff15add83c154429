"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding finds the one valid split by backtracking. An Aho-Corasick automaton gives the longest
piece at every position; a piece may follow another only if merging their joined text again gives
just these two; positions from which no valid rest exists are marked in a bitfield and not tried
again. A text is cut where no piece holds both neighbours, so that equal words are encoded once per
worker. Decoding joins the pieces and reads byte pieces as UTF-8.

Results: a null or empty text has the end id alone and decodes to ''. One row comes out for
every row that goes in, repeated rows included. Characters that no piece holds become bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHED_WORDS, CACHED_CHARS, CACHED_PAIRS = 250_000, 48, 400_000
ROWS_AT_ONCE = 200


@dataclass(frozen=True)
class PieceModel:
    """What encoding needs of a model file; small enough to go with every task."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    end_id: int
    dummy_prefix: bool


def read_model(path: str) -> PieceModel:
    """Read a BPE model with byte fallback and no normalisation; any other kind raises."""
    proto = model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    rule, trained = proto.normalizer_spec, proto.trainer_spec
    kinds = tuple(p.type for p in proto.pieces)
    if (
        trained.model_type != 2
        or not trained.byte_fallback
        or trained.treat_whitespace_as_suffix
        or rule.precompiled_charsmap
        or rule.remove_extra_whitespaces
        or not rule.escape_whitespaces
        or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
    ):
        raise ValueError("only merge-type models with byte fallback and identity normalisation")
    return PieceModel(
        pieces=tuple(p.piece for p in proto.pieces),
        scores=tuple(p.score for p in proto.pieces),
        kinds=kinds,
        end_id=trained.eos_id,
        dummy_prefix=rule.add_dummy_prefix,
    )


class Codec:
    """Encoder and decoder with their caches; one per worker process and model."""

    def __init__(self, model: PieceModel):
        self.model = model
        rows = list(zip(model.pieces, model.scores, model.kinds))
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(rows) if kind == NORMAL}
        self.scores = {piece: score for piece, score, kind in rows if kind == NORMAL}
        self.byte_ids = [0] * 256
        for i, (piece, _, kind) in enumerate(rows):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.byte_of = {i: value for value, i in enumerate(self.byte_ids)}
        self.surface = [
            piece.replace(SPACE, " ") if kind == NORMAL else "" if kind == CONTROL else " ⁇ "
            for piece, _, kind in rows
        ]
        self.longest = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.longest.add_word(piece, (len(piece) - 1, piece))
        self.longest.make_automaton()
        self.shorter: dict[str, str | None] = {}
        for piece in self.ids:
            cut = len(piece) - 1
            while cut > 1 and piece[:cut] not in self.ids:
                cut -= 1
            self.shorter[piece] = piece[:cut] or None
        self.follows: dict[tuple[str, str], str | None] = {}
        #: Ids by word, once for words after a space (and the first), once for those that open a line.
        self.words: tuple[dict[str, tuple[int, ...]], ...] = ({}, {})
        self.older_words: tuple[dict[str, tuple[int, ...]], ...] = ({}, {})
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: No piece reaches from another character into a space, nor past the end of a line.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids) and not any(
            "\n" in pair for pair in self.joined
        )

    def merge(self, text: str) -> list[str]:
        """Merge from single characters: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, place = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, i
            if best is None:
                return parts
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two stay two; with an empty left one, whether merging yields the right one."""
        return self.merge(left + right) == ([left, right] if left else [right])

    def follow(self, left: str, piece: str) -> str | None:
        """The longest of a piece and its prefixes that may follow the left one."""
        at = left, piece
        if at in self.follows:
            return self.follows[at]
        if len(self.follows) >= CACHED_PAIRS:
            self.follows.clear()
        found: str | None = piece
        while found and not self.compatible(left, found):
            found = self.shorter.get(found)
        self.follows[at] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text; a character that no piece holds is one of its own."""
        size = len(text)
        longest: list[str | None] = list(text)
        for end, (back, piece) in self.longest.iter(text):  # of one start, the longest comes last
            longest[end - back] = piece
        known, follow, shorter = self.follows, self.follow, self.shorter
        failed = 0  # the bitfield
        out: list[str] = []
        position, previous, piece = 0, "", longest[0]
        while True:
            at = previous, piece
            piece = known[at] if at in known else follow(previous, piece)
            while piece and failed >> position + len(piece) & 1:
                piece = shorter.get(piece) and follow(previous, shorter[piece])
            if piece:
                out.append(piece)
                position += len(piece)
                if position == size:
                    return out
                previous, piece = piece, longest[position]
                continue
            while not piece:  # take pieces back until one has a shorter form
                failed |= 1 << position
                last = out.pop()
                position -= len(last)
                previous = out[-1] if out else ""
                piece = shorter.get(last)

    def encode_run(self, text: str) -> list[int]:
        """Ids of a text with spaces already escaped."""
        out: list[int] = []
        for piece in self.split(text) if text else []:
            known = self.ids.get(piece)
            out += [self.byte_ids[b] for b in piece.encode()] if known is None else [known]
        return out

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text and the end id."""
        out: list[int] = []
        if text and not self.by_words:
            out = self.encode_run((SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE))
        elif text:
            text = text.replace(SPACE, " ")
            for number, line in enumerate(text.split("\n")):
                opens = number > 0 or not self.model.dummy_prefix
                if number:
                    out += self._word("\n", True)
                words = line.split(" ")
                if "" in words:  # runs of spaces may be one piece
                    out += self.encode_run(("" if opens else SPACE) + line.replace(" ", SPACE))
                    continue
                known, learn = self.words[0], self._word
                if opens:
                    out += learn(words[0], True)
                    del words[0]
                out += chain.from_iterable([known.get(word) or learn(word, False) for word in words])
        out.append(self.model.end_id)
        return out

    def _word(self, word: str, opens: bool) -> tuple[int, ...]:
        """Ids of a word. Words used since the last change of lists outlive the next one."""
        known = self.words[opens]
        ids = known.get(word) or self.older_words[opens].get(word)
        if ids is None:
            ids = tuple(self._parts(word if opens else SPACE + word))
        if len(word) <= CACHED_CHARS:
            known[word] = ids
            if len(known) >= CACHED_WORDS:
                self.older_words[opens].clear()
                self.older_words[opens].update(known)
                known.clear()
        return ids

    def _parts(self, run: str) -> Iterator[int]:
        """Ids of a run, cut wherever two neighbours stand together in no piece."""
        joined, start = self.joined, 0
        for i in range(1, len(run)):
            if run[i - 1 : i + 1] not in joined:
                yield from self.encode_run(run[start:i])
                start = i
        yield from self.encode_run(run[start:])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space put before the first word is taken away again."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, self.model.end_id]:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(decode_bytes(bytes(run)))
                    run.clear()
                parts.append(self.surface[i])
            text = "".join(parts)
        starts_with_space = text.startswith(" ") and self.model.dummy_prefix
        return text[1:] if starts_with_space and not self._byte_first(ids) else text

    def _byte_first(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
        return first in self.byte_of


def decode_bytes(run: bytes) -> str:
    """UTF-8 text; each byte that belongs to no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec_of(model: PieceModel) -> Codec:
    return Codec(model)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def encode_documents(
    docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, ids): every whole text as ids, the end id last."""

    def work(batches):
        codec = codec_of(model)
        for batch in _rows(batches):
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"]
            )

    chosen = docs.select(key, text)
    return chosen.mapInArrow(work, f"{_typed(chosen, key)}, ids array<int>")


def decode_documents(encoded: DataFrame, model: PieceModel, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); null ids give ''."""

    def work(batches):
        codec = codec_of(model)
        for batch in _rows(batches):
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=[key, "text"]
            )

    chosen = encoded.select(key, "ids")
    return chosen.mapInArrow(work, f"{_typed(chosen, key)}, text string")


def round_trip(
    docs: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode, and keep digests of both.

    Both directions run in one worker, so that the ids, longer than the text, stay there.
    """

    def work(batches):
        codec = codec_of(model)
        digits = [str(i) for i in range(len(model.pieces))]
        sha = hashlib.sha256
        for batch in _rows(batches):
            counts, of_ids, of_texts = [], [], []
            for value in batch.column(1).to_pylist():
                ids = codec.encode(value)
                counts.append(len(ids))
                of_ids.append(sha(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                of_texts.append(sha(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_texts, pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(key, text)
    return chosen.mapInArrow(
        work,
        f"{_typed(chosen, key)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _typed(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"
