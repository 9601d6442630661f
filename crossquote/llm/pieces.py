"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

A text becomes symbols, one per character, with blanks written as U+2581 and one blank put before the text. All
pairs of neighbouring symbols that make a piece together stand on an agenda, ordered by the score of that piece and
then by place from the left. The best pair is merged, its two new neighbourhoods join the agenda, and
entries whose symbols have changed since are skipped, until none is left. A character outside the vocabulary
becomes its UTF-8 bytes. Decoding joins pieces, reads runs of byte pieces as UTF-8 and takes off
the blank that was put before.

No piece spans a blank that follows another character, so a text falls into words that are merged
on their own, whatever stands around them. ``Vocabulary`` proves that from its pieces, and takes the whole text as one word
where it does not hold. Short words are merged side by side, thousands at a time, and remembered while a worker
runs; a long word has a heap of its own, with n log n steps, and is not remembered.

In each Arrow batch the library encodes the words that are new to a worker, all in one call, and must give the same ids, or encodes and
decodes the whole texts again (``check``); the column ``checked`` tells. Null texts count as empty: no pieces, only the end id. Texts are whole, however
long. Rows that repeat stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.words import chunks, documents

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
WORDS = 300_000  # words whose ids a worker remembers, twice so many at most
LONGEST = 32  # characters of a word that is merged beside others, and remembered
TABLE = 4096  # words that are merged side by side
NONE = np.int32(2 ** 31 - 1)  # rank of two symbols that make no piece
_PLACE = (1 << 40) - 1
SCHEMA = ("doc_id long, n_tokens long, ids array<int>, decoded string, checked boolean")


class Vocabulary:
    """Pieces, scores and kinds of a model file of the merge type."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        size = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if self.library.IsControl(i) or self.library.IsUnknown(i)}
        self._bytes = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if self.library.IsByte(i)}
        if len(self._bytes) != 256 or any(self.library.IsUnused(i) for i in range(size)):
            raise ValueError("the vocabulary must have all byte pieces and no unused ones")
        if self.library.Normalize(" ａ  b\t ") != f"{BLANK}{BLANK}ａ{BLANK}{BLANK}b\t{BLANK}":
            raise ValueError("the vocabulary must leave characters as they are and put a blank before the text")
        self.end = self.library.eos_id()
        self._byte_ids = sorted(self._bytes, key=self._bytes.get)
        self._ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self._bytes}
        self._size = size + 1  # pairs are numbered left * _size + right; the last number stands for letters without a piece
        self._letters = {p: i for p, i in self._ids.items() if len(p) == 1}
        self._ranks, self._made = self._pairs()
        self._index = pd.Index(np.fromiter(self._ranks, np.int64, len(self._ranks)))
        self._rank_of = np.append(np.fromiter(self._ranks.values(), np.int32, len(self._ranks)), NONE)  # the last one is for -1
        self._made_of = np.append(np.fromiter(self._made.values(), np.int32, len(self._made)), np.int32(0))
        self._symbols = np.full(0x110000, size, np.int32)
        for letter, number in self._letters.items():
            self._symbols[ord(letter)] = number
        unknown = self.library.unk_id()
        self._written = [" ⁇ " if i == unknown else "" if i in special else p.replace(BLANK, " ")
                         for i, p in enumerate(self.pieces)]
        for number, byte in self._bytes.items():
            self._written[number] = chr(byte) if byte < 128 else ""
        self._parts = frozenset(i for i, byte in self._bytes.items() if byte > 127)
        known = "".join(self._ids)
        alone = "".join(c for c in "\n\t" if c not in known)  # in no piece, so never merged with anything
        splits = not any(BLANK in p.lstrip(BLANK) for p in self._ids)
        no = re.escape(alone)
        self.splits = splits and bool(alone)
        self._break = alone[0] if splits and alone else None  # stands between words without touching them
        self._wrong: set[str] = set()
        self._word = re.compile(f"{BLANK}*[^{BLANK}{no}]+|{BLANK}+" + (f"|[{no}]" if alone else "")) if splits else re.compile("(?s).+")
        self._seen: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}
        self.decimal = [str(i) for i in range(size)]

    def _pairs(self) -> tuple[dict[int, int], dict[int, int]]:
        """Rank by score (equal scores share one) and piece of every pair of pieces that make a piece together."""
        scores = {i: self.library.get_score(i) for i in self._ids.values()}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        ranks, made = {}, {}
        for piece, number in self._ids.items():
            for cut in range(1, len(piece)):
                left, right = self._ids.get(piece[:cut]), self._ids.get(piece[cut:])
                if left is not None and right is not None:
                    pair = left * self._size + right
                    ranks[pair], made[pair] = order[scores[number]], number
        return ranks, made

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word: what the agenda leaves, and the bytes of characters without a piece."""
        size, unknown, last = self._size, self._size - 1, len(word)
        symbols = [self._letters.get(c, unknown) for c in word]
        if last > 1:
            ranks, made = self._ranks, self._made
            following, before = list(range(1, last + 1)), list(range(-1, last - 1))
            pairs = [a * size + b for a, b in zip(symbols, symbols[1:])]
            agenda = [ranks[pair] << 40 | left for left, pair in enumerate(pairs) if pair in ranks]
            heapify(agenda)
            while agenda:
                best = heappop(agenda)
                left = best & _PLACE
                right = following[left]
                # a pair that is gone, or no longer the one that was put there, has another rank or none
                if right == last or ranks.get(pair := symbols[left] * size + symbols[right], -1) != best >> 40:
                    continue
                symbols[left], symbols[right] = made[pair], -size
                right = following[left] = following[right]
                if right < last:
                    before[right] = left
                    if (rank := ranks.get(symbols[left] * size + symbols[right])) is not None:
                        heappush(agenda, rank << 40 | left)
                if (earlier := before[left]) >= 0:
                    if (rank := ranks.get(symbols[earlier] * size + symbols[left])) is not None:
                        heappush(agenda, rank << 40 | earlier)
        if unknown in symbols:
            out: list[int] = []
            for at, symbol in enumerate(symbols):
                if symbol == unknown:  # never part of a pair, so the character still stands at its place
                    out += [self._byte_ids[b] for b in word[at].encode()]
                elif symbol >= 0:
                    out.append(symbol)
            return out
        return [x for x in symbols if x >= 0]

    def words_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of short words side by side: each has its own agenda, a row of ranks, and all merge their best pair at a time.

        Of equal ranks the leftmost is the first minimum of a row. The symbol right of a merged pair is taken out, so a row
        stays in order, and the two pairs beside it are ranked anew.
        """
        size, width = self._size, max(map(len, words))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.full((len(words), width + 1), -1, np.int32)
        symbols[:, :width][np.arange(width) < counts[:, None]] = self._symbols[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        ranks, made = self._looked_up(symbols[:, :-1], symbols[:, 1:])
        out, live = np.full((len(words), width), -1, np.int32), np.arange(len(words))
        while len(live):
            row, best = np.arange(len(live)), ranks.argmin(1)
            has = ranks[row, best] != NONE
            if not has.all():
                out[live[~has]] = symbols[~has, :-1]
                live, symbols, ranks, made, best = live[has], symbols[has], ranks[has], made[has], best[has]
                row = np.arange(len(live))
            symbols[row, best] = made[row, best]
            behind = np.arange(width) > best[:, None]
            for table, fill in ((symbols, -1), (ranks, NONE), (made, 0)):
                own = behind[:, :table.shape[1] - 1]
                table[:, :-1] = np.where(own, table[:, 1:], table[:, :-1])
                table[:, -1] = fill
            for beside in (best, best - 1):
                on = np.flatnonzero(beside >= 0)
                at = beside[on]
                ranks[on, at], made[on, at] = self._looked_up(symbols[on, at], symbols[on, at + 1])
        found, unknown = out.tolist(), self._size - 1
        ids = [[x for x in one if x >= 0] for one in found]
        for at in np.flatnonzero((out == unknown).any(1)).tolist():
            ids[at] = self.word_ids(words[at])  # spells letters without a piece
        return ids

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and pieces of pairs; NONE where there is none."""
        at = self._index.get_indexer((left.astype(np.int64) * self._size + right).ravel()).reshape(left.shape)
        at[right < 0] = -1
        return self._rank_of[at], self._made_of[at]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return self.encode_all([text])[0][0]

    def encode_all(self, texts: list[str], check: bool = False) -> tuple[list[list[int]], list[bool]]:
        """Ids of texts, and with ``check`` whether the library agreed on all their words. Words not met for a long time are forgotten."""
        split = [self._word.findall(BLANK + text.replace(" ", BLANK)) if text else [] for text in texts]
        if len(self._seen) > WORDS:
            self._older, self._seen = self._seen, {}
        seen, older = self._seen, self._older
        new, long = [], {}
        for word in {w for words in split for w in words if w not in seen}:
            ids = older.get(word)
            if ids is not None:
                seen[word] = ids
            elif len(word) <= LONGEST:
                new.append(word)
            else:
                long[word] = self.word_ids(word)
        new.sort(key=len)  # words of like length fill a table together
        for at in range(0, len(new), TABLE):
            seen.update(zip(new[at:at + TABLE], self.words_ids(new[at:at + TABLE])))
        seen.update(long)
        if check:
            self._compare([*new, *long])
        out = [[*chain.from_iterable(map(seen.__getitem__, words)), self.end] for words in split]
        for word in long:
            del seen[word]
        return out, [self._wrong.isdisjoint(words) for words in split] if self._wrong else [True] * len(texts)

    def _compare(self, words: list[str]) -> None:
        """Has the library encode new words, all in one text with a separator that is in no piece; notes those it encodes otherwise."""
        if not words or self._break is None:
            return
        gap, start, seen = self._byte_ids[ord(self._break)], self.word_ids(BLANK), self._seen
        together = [*start, *chain.from_iterable((gap, *seen[w]) for w in words)]
        if self.library.encode(self._break + self._break.join(words), num_threads=1) != together:
            lone = self.library.encode([self._break + w for w in words], num_threads=1)
            self._wrong |= {w for w, ids in zip(words, lone) if ids != [*start, gap, *seen[w]]}

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: control ids are silent, bytes that are no UTF-8 become U+FFFD, one blank in front goes."""
        written, raw = self._written, self._bytes
        if self._parts.isdisjoint(ids):  # bytes of ASCII letters stand for themselves wherever they are
            text = "".join(map(written.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in raw:
                    held.append(raw[i])
                    continue
                if held:
                    parts.append(_utf8(held))
                    held.clear()
                parts.append(written[i])
            if held:
                parts.append(_utf8(held))
            text = "".join(parts)
        first = next((i for i in ids if written[i] or i in raw), None)
        return text[1:] if first is not None and first not in raw and self.pieces[first].startswith(BLANK) else text


def _utf8(held: bytearray) -> str:
    """UTF-8 characters, and U+FFFD for each byte that is not part of one."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(held):
            for size in (1, 2, 3, 4):
                try:
                    out.append(held[at:at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    """One vocabulary for all tasks of a worker; ``path`` is a file that all workers have."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str | None = None, check: str | None = "words", digests: bool = False) -> DataFrame:
    """Ids of every text of ``docs``, the text decoded from them, and whether the library agrees.

    ``check`` "words": in each batch the library encodes all words that this worker meets for the first time; a text is checked if
    all of its words agree. "texts": it encodes and decodes every whole text again. None: ``checked`` is null. With ``digests``
    the ids and the decoded text are replaced by their SHA-256 (of decimal ids joined by a blank, of UTF-8), so that long
    lists do not leave the task.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, checked boolean" if digests else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch, raw in chunks(batches, size=512 << 10):
            texts = [t.decode("utf-8", "replace") for t in raw]
            ids, agrees = own.encode_all(texts, check is not None)
            decoded = [own.decode(i) for i in ids]
            if check == "texts" or check and not own.splits:
                library = own.library.encode(texts, add_eos=True, num_threads=1)
                agrees = [a == b and c == d for a, b, c, d in zip(ids, library, decoded, own.library.decode(library, num_threads=1))]
            counts = pa.array([len(i) for i in ids], pa.int64())
            if digests:
                spell = own.decimal.__getitem__
                out = [pa.array([hashlib.sha256(" ".join(map(spell, i)).encode()).hexdigest() for i in ids], pa.string()),
                       pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            else:
                out = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, *out, pa.array(
                agrees if check else [None] * len(ids), pa.bool_())], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op11_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), digests=True)
