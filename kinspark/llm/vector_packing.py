"""Packing training examples under several limits at once: tokens, segments and loss-bearing tokens of a sequence.

An example is the ids of an optional prompt, of a text, and one end token; ids of the prompt bear no loss. Sequences are
filled one at a time by the dot-product heuristic of vector bin packing: of the pieces that still fit in every
dimension, the one whose demands point most where room is left is placed next, each dimension weighed by how scarce it
is among the pieces to place. Examples are placed whole; only one above a limit is cut beforehand. Where no whole
piece fits into a gap of MIN_PIECE or more, the longest one left is cut to fill it, and its rest opens the next sequence.

Every task packs what it reads, a buffer of tokens at a time; pieces of a sequence that is not full yet wait for
the next buffer. So there is no shuffle, no plan on the driver, and memory is bounded by the buffer and the longest
example. What is left at a task's end goes to sequences that are powers of two in length, which need no padding.

Null texts and prompts count as empty: an end token at least. Repeated rows are separate examples; null keys stay.
An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinspark.llm.common import documents

VOCABULARY = "word_bpe_49k.json"
END = 2
MIN_PIECE = 16
BUFFER_TOKENS = 4 << 20
CACHED_WORDS, CACHED_BYTES = 500_000, 64

PACKED = """start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long,
    segment int"""


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096


@dataclass(frozen=True, eq=False)
class Example:
    key: object
    ids: np.ndarray
    prompt: int  # so many ids at the start bear no loss


@dataclass(frozen=True, eq=False)
class Piece:
    example: Example
    start: int
    length: int

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.example.prompt))

    def head(self, tokens: int, loss: int) -> int:
        """The longest head within so many tokens and loss-bearing tokens."""
        free = max(0, self.example.prompt - self.start)
        return min(tokens, self.length, free + loss)

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.example, self.start, at), Piece(self.example, self.start + at, self.length - at)


class WordTokenizer:
    """Ids as the tokenizer file gives them, each distinct word encoded once.

    A text of Latin-1 characters is lowered and split here by the file's own pattern (fixed values, below) and its
    words go to the file's merge rules. Of any other text, and where special tokens may be spelt, each stretch between
    ASCII white space goes to the whole tokenizer; words never reach across white space.
    """

    # Letters, numbers and the pattern of words, as Latin-1 bytes.
    LETTER = rb"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    NUMBER = rb"0-9\xb2\xb3\xb9\xbc\xbd\xbe"
    WORD = re.compile(rb"'(?:[stmd]|re|ve|ll)|[%b]+|[%b]|[^\s\x85\xa0%b%b]+" % (LETTER, NUMBER, LETTER, NUMBER))
    LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        if "<|" not in text:
            try:
                return self._by_words(text.encode("latin-1"))
            except UnicodeEncodeError:
                pass
        ids = []
        for part in text.encode("utf-8", "replace").split():
            if part.isascii() and b"<|" not in part:
                ids.append(self._by_words(part))
            else:
                ids.append(numbers(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids))
        return b"".join(ids)

    def _by_words(self, text: bytes) -> bytes:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, self.WORD.findall(text.translate(self.LOWER))))


class _Words(dict):
    """Word -> ids, found on first use; long words are not kept."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize
        # Byte-level BPE spells a byte as its own character if that is printable, else as one from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.spelt = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: bytes) -> bytes:
        spelt = "".join(map(self.spelt.__getitem__, word.decode("latin-1").encode()))
        ids = numbers([token.id for token in self.tokenize(spelt)])
        if len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids


def numbers(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def cut(example: Example, limits: Limits) -> list[Piece]:
    """The example in pieces that each fit an empty sequence: one, unless it is above a limit."""
    pieces, rest = [], Piece(example, 0, len(example.ids))
    while (at := rest.head(limits.tokens, limits.loss_tokens)) < rest.length:
        piece, rest = rest.split(at)
        pieces.append(piece)
    return [*pieces, rest]


def fill(pool: list[Piece], limits: Limits) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the pieces of the one that was not full when the pool ran out."""
    kinds: dict[tuple[int, int], list[Piece]] = {}
    for piece in pool:
        kinds.setdefault((piece.length, piece.loss), []).append(piece)
    keys = sorted(kinds, reverse=True)
    length, loss = (np.array([key[i] for key in keys], np.int64) for i in range(2))
    left = np.array([len(kinds[key]) for key in keys], np.int64)
    total = np.array([(length * left).sum(), left.sum(), (loss * left).sum()], float)
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    weight = total / most / (total / most).sum() / most**2 if len(keys) else most

    def take(kind: int) -> Piece:
        left[kind] -= 1
        return kinds[keys[kind]].pop()

    sequences, carried = [], None
    while carried or left.any():
        sequence = [carried] if carried else []
        tokens = limits.tokens - (carried.length if carried else 0)
        segments = limits.segments - len(sequence)
        losses = limits.loss_tokens - (carried.loss if carried else 0)
        carried = None
        while segments:
            fits = (left > 0) & (length <= tokens) & (loss <= losses)
            if not fits.any():
                break
            scores = weight[0] * tokens * length + weight[1] * segments + weight[2] * losses * loss
            kind = int(np.argmax(np.where(fits, scores, -1)))
            piece = take(kind)
            sequence.append(piece)
            tokens, segments, losses = tokens - piece.length, segments - 1, losses - piece.loss
        if tokens >= MIN_PIECE and not left.any():
            return sequences, sequence
        if tokens >= MIN_PIECE and segments:
            kind = int(np.argmax(left > 0))  # the longest left
            at = kinds[keys[kind]][-1].head(tokens, losses)
            if at >= MIN_PIECE or not sequence:
                piece, carried = take(kind).split(at)
                sequence.append(piece)
        sequences.append(sequence)
    return sequences, []


def tail(pieces: list[Piece]) -> list[list[Piece]]:
    """Less than a sequence, as sequences whose lengths are different powers of two."""
    queue, total = pieces[::-1], sum(piece.length for piece in pieces)
    sequences = []
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        sequence: list[Piece] = []
        while size:
            piece = queue.pop()
            if piece.length > size:
                piece, rest = piece.split(size)
                queue.append(rest)
            sequence.append(piece)
            size -= piece.length
        sequences.append(sequence)
    return sequences


def pack(examples: Iterator[Example], limits: Limits, buffer_tokens: int = BUFFER_TOKENS) -> Iterator[list[list[Piece]]]:
    """Sequences of pieces, a buffer's at a time."""
    pool: list[Piece] = []
    held = 0
    for example in examples:
        pool += cut(example, limits)
        held += len(example.ids)
        if held >= buffer_tokens:
            sequences, pool = fill(pool, limits)
            held = sum(piece.length for piece in pool)
            yield sequences
    sequences, pool = fill(pool, limits)
    yield sequences + tail(pool)


def packed(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    limits: Limits = Limits(),
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """A row per piece: the key, PACKED and, if asked for, the ids. ``loss_tokens``: the piece's; ``segment``: its
    number in the sequence. Without a prompt column every id bears loss."""
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError(f"no sequence can hold anything within {limits}")
    source = rows.select(F.col(key), F.col(text).cast("string"), F.col(prompt).cast("string") if prompt else F.lit(None).cast("string"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        import public_tokenizers

        tokenizer = WordTokenizer(public_tokenizers.path(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, texts, prompts = (batch.column(i).slice(at, 512).to_pylist() for i in range(3))
                for k, said, asked in zip(keys, texts, prompts):
                    before = tokenizer.encode(asked or "")
                    ids = before + tokenizer.encode(said or "") + numbers([END])
                    yield Example(k, np.frombuffer(ids, dtype="<u4"), len(before) // 4)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for sequences in pack(examples(batches), limits, buffer_tokens):
            for at in range(0, len(sequences), 256):
                found = []
                for sequence in sequences[at : at + 256]:
                    offset = 0
                    for segment, piece in enumerate(sequence):
                        ids = piece.example.ids[piece.start : piece.start + piece.length]
                        crc, whole = zlib.crc32(ids.tobytes()), len(piece.example.ids)
                        found.append((piece.example.key, piece.start, piece.length, crc, whole, number, offset, piece.loss, segment, ids if keep_ids else None))
                        offset += piece.length
                    number += 1
                columns = list(zip(*found))[: len(schema)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    key_type = source.schema[0].dataType
    schema = pa.schema(
        [(key, to_arrow_type(key_type))]
        + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")]
        + [("segment", pa.int32())]
        + ([("ids", pa.list_(pa.int32()))] if keep_ids else [])
    )
    fields = f"`{key}` {key_type.simpleString()}, {PACKED}" + (", ids array<int>" if keep_ids else "")
    return source.mapInArrow(place, fields)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
