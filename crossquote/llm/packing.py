"""Cost-balanced packing of tokenised documents into training sequences.

Attention costs ``linear * n + quadratic * n * n`` for a piece of n tokens. Documents are
tokenised and packed where they lie, in groups of about a million tokens, without a shuffle:
documents go down by length, each to the sequence of lowest cost so far that still has room.
The sequences of a group have exactly as much room as the group has tokens: as many full ones as
go in, and the rest in powers of two, which need no padding. Where no sequence has room for a
whole piece, the piece is cut at the roomiest one.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.words import RaggedTable, chunks, documents

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, sequence_cost double")
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                   ("sequence_length", pa.int64()), ("sequence_cost", pa.float64())])
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEQUENCES_PER_TASK = 1 << 33


PIECES = 60_000  # word pieces whose ids a worker remembers from task to task; more would crowd the workers of a pipeline
WORDS = 60_000  # words whose ids a task remembers
# Fixed values of the vocabulary: how it cuts lower-case words (here for letters up to U+00FF)
LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff"
DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECE_OF = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
PLAIN = re.compile("[!-~\u00a1-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as U+0100, U+0101, ..."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in printable else next(other)) for b in range(256)}


class WordTokens:
    """Token ids of words; the vocabulary drops white space, so words can be tokenised one by one.

    Words of plain Latin letters are cut into pieces, whose ids are remembered. Any other word
    goes through the whole tokenizer, with its normalisation.
    """

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self._special = [s.content for s in self.tokenizer.get_added_tokens_decoder().values()]
        self._letters, self._known = byte_letters(), {}

    def _piece(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            coded = piece.encode().decode("latin-1").translate(self._letters)
            ids = self._known[piece] = [t.id for t in self.tokenizer.model.tokenize(coded)]
        return ids

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        if len(self._known) > PIECES:
            self._known.clear()
        out = []
        for raw in words:
            word = raw.decode("utf-8", "replace")
            if PLAIN.fullmatch(word) and not ("<" in word and any(s in word for s in self._special)):
                pieces = PIECE_OF.findall(word.lower())
                out.append(self._piece(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self._piece(p)])
            else:
                out.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return out


@lru_cache(maxsize=2)
def word_tokens(path: str | None) -> WordTokens:
    """One tokenizer for all tasks of a worker; ``path`` is a file that all workers have."""
    return WordTokens(path)


def capacities(tokens: int, room: int) -> np.ndarray:
    """Full sequences, then the binary digits of what is left: together exactly ``tokens``."""
    full, rest = divmod(tokens, room)
    return np.array([room] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def assign(lengths: np.ndarray, room: int, linear: float, quadratic: float):
    """(document, start, length, sequence, offset) of each piece, and the cost of each sequence.

    Documents longer than a sequence first fill whole sequences of their own. Equal lengths go by
    position, equal costs by the number of the sequence.
    """
    space = capacities(int(lengths.sum()), room)
    left, cost = space.copy(), np.zeros(len(space))
    out, nxt = [], 0

    def put(doc: int, start: int, size: int, seq: int) -> None:
        out.append((doc, start, size, seq, int(space[seq] - left[seq])))
        left[seq] -= size
        cost[seq] += linear * size + quadratic * size * size

    begun = np.zeros(len(lengths), np.int64)
    for doc in np.flatnonzero(lengths >= room):
        while lengths[doc] - begun[doc] >= room:
            put(int(doc), int(begun[doc]), room, nxt)
            begun[doc] += room
            nxt += 1
    rest = lengths - begun
    for doc in np.lexsort((np.arange(len(rest)), -rest)):
        start, size = int(begun[doc]), int(rest[doc])
        while size:
            fits = left >= size
            seq = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(left))
            piece = min(size, int(left[seq]))
            put(int(doc), start, piece, seq)
            start, size = start + piece, size - piece
    return out, cost


def pack(docs: DataFrame, room: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048,
         group_tokens: int = 1 << 20, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: where its ids lie in their document and in a sequence.

    ``room`` must be a power of two. Every row of ``docs`` is a document of its own, also where
    ids repeat; a null or empty text is the single end id. A group holds ``group_tokens`` or one
    document more. Sequence ids are unique over all tasks and the same in each attempt of a task.
    """
    if room & (room - 1):
        raise ValueError("room must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RaggedTable(word_tokens(tokenizer_path), WORDS)
        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        doc_ids, held, total = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, held, total, first
            lengths = np.array([len(h) for h in held], np.int64)
            pieces, cost = assign(lengths, room, linear, quadratic)
            doc, start, size, seq, offset = (np.array(c, np.int64) for c in zip(*pieces))
            used = np.bincount(seq, size, len(cost)).astype(np.int64)
            crc = [zlib.crc32(held[d][s:s + n].tobytes()) for d, s, n in zip(doc, start, size)]
            batch = pa.RecordBatch.from_arrays([
                pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(start), pa.array(size),
                pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(seq + first), pa.array(offset),
                pa.array(used[seq]), pa.array(cost[seq])], schema=PIECE)
            first += len(cost)
            doc_ids, held, total = [], [], 0
            return batch

        for batch, texts in chunks(batches):
            numbers, offsets = table.words.number(texts)
            ids, counts = table.expand(numbers)
            ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
            for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                one = np.append(ids[ends[row]:ends[row + 1]], END_ID).astype("<u4")
                doc_ids.append(doc)
                held.append(one)
                total += len(one)
                if total >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
