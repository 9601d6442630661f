"""Quality rules: plain counts of a text, and tokeniser fertility against bands.

A text that public vocabularies cut into unusually short or many tokens, spell in raw bytes or cover with
few different tokens is not ordinary prose of its language. Per document: characters per token, tokens per
word and token entropy under a byte-level vocabulary, and the share of byte-fallback tokens under a
piece vocabulary. Bands per language (per writing system where the language is not known) come from quartiles over
all documents that pass the plain rules.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.scripts import NAMES, script_codes
from crossquote.llm.substrings import stored
from crossquote.llm.words import RaggedTable, WordTable, chunks, documents, few
from crossquote.session import materialize

SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A measure is out of band beyond its quartiles by WIDTH quartile ranges, a range counting as LEAST at least.
WIDTH = 3.5
LEAST = {"chars_per_token": 0.04, "tokens_per_word": 0.15, "byte_share": 0.005, "token_entropy": 0.05}
SHORT = 100  # words; the bands of a text of n words are wider by sqrt(1 + SHORT / n), as means of few words vary more
UPPER = ("tokens_per_word", "byte_share")  # of these high values are suspicious, of the others low ones
ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("band", pa.string()),
    ("chars_per_token", pa.float64()), ("tokens_per_word", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64())])
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, band string, chars_per_token double, tokens_per_word double, byte_share double, token_entropy double")


class Fertility:
    """Features of words under the two vocabularies; a word is tokenised with the blank before it."""

    def __init__(self, byte_path: str | None, piece_path: str | None):
        import public_tokenizers as public
        import sentencepiece
        import tiktoken

        with open(byte_path or public.path(BYTE_VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("bytes", pat_str=public.PATTERN, mergeable_ranks=ranks,
                                   special_tokens={}).encode_ordinary
        self.tokens = RaggedTable(lambda words: [encode(" " + w.decode("utf-8", "replace")) for w in words], 300_000)
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path or public.path(PIECE_VOCABULARY))
        self._is_byte = np.array([self._pieces.IsByte(i) for i in range(self._pieces.vocab_size())])
        self._more = WordTable(self._features, [(np.int32, None)] * 5, 300_000)

    def _features(self, words: list[bytes]):
        spelled = [w.decode("utf-8", "replace") for w in words]
        pieces = self._pieces.encode(spelled, num_threads=1)
        count = np.fromiter(map(len, pieces), np.int32, len(pieces))
        flat = np.fromiter((i for p in pieces for i in p), np.int32, int(count.sum()))
        ends = np.cumsum(np.r_[0, self._is_byte[flat]])[np.r_[0, np.cumsum(count)]]
        chars = np.fromiter(map(len, spelled), np.int32, len(spelled))
        letter = [next(filter(str.isalpha, w), "") for w in spelled]
        script = script_codes(np.array([ord(x) if x else 0 for x in letter]))
        letters = np.where([bool(x) for x in letter], chars, 0)
        return count, np.diff(ends), chars, script, letters

    def number(self, texts: list[bytes]):
        numbers, offsets = self._more.number(texts)
        return numbers, offsets, [self._more[i] for i in range(5)]


@lru_cache(maxsize=2)
def fertility(byte_path: str | None, piece_path: str | None) -> Fertility:
    """One pair of vocabularies for all tasks of a worker; the paths are files that all workers have."""
    return Fertility(byte_path, piece_path)


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(numbers) < 4:
        return 0
    if numbers.max() >= 1 << 21:  # three numbers must fit into 63 bits
        numbers = np.unique(numbers, return_inverse=True)[1]
    if numbers.max() < 1 << 21:
        key = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:
        pairs = np.unique((numbers[:-1] << 31) | numbers[1:], return_inverse=True)[1]
        key = (pairs[:-1] << 31) | numbers[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift:len(key) + shift] |= repeated
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Entropy of the token distribution over that of as many different tokens; 1.0 for less than two."""
    if len(ids) < 2:
        return 1.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def measure(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Counts and token measures of every text, null for the measures of a text without words.

    ``band`` names the language, or the script with most letters where the language is null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = fertility(byte_path, piece_path)
        for batch, texts in chunks(batches):
            numbers, offsets, (pieces, raw, chars, script, letters) = vocab.number(texts)
            token_words, _ = vocab.tokens.words.number(texts)
            ids, per_word = vocab.tokens.expand(token_words)
            ends = np.concatenate([[0], np.cumsum(per_word)])[offsets]
            sums = [np.diff(np.concatenate([[0], np.cumsum(f[numbers], dtype=np.int64)])[offsets])
                    for f in (chars, pieces, raw)]
            n_words, n_tokens = np.diff(offsets), np.diff(ends)
            repeats = [repeated_words(numbers[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            spread = [entropy(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            bands = []
            for row, lang in enumerate(batch.column("lang").to_pylist()):
                if lang is None:
                    own = numbers[offsets[row]:offsets[row + 1]]
                    weight = np.bincount(script[own], letters[own], len(NAMES))
                    lang = f"script {NAMES[int(weight.argmax())]}"
                bands.append(lang)
            empty = n_words == 0
            failed = (n_words < FEWEST_WORDS) | (100 * np.array(repeats, np.int64) > MOST_REPEATED * n_words)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words), pa.array(sums[0]),
                pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], pa.int64()),
                pa.array([duplicate_lines(t) for t in texts], pa.int64()), pa.array(repeats, pa.int64()),
                pa.array(failed), pa.array(bands, pa.string()),
                pa.array(sums[0] / np.maximum(n_tokens, 1), mask=empty),
                pa.array(n_tokens / np.maximum(n_words, 1), mask=empty),
                pa.array(sums[2] / np.maximum(sums[1], 1), mask=empty),
                pa.array(np.array(spread, float), mask=empty)], schema=ROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, SCHEMA)


def bands(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """Per band the suspicious quartile of each measure and the reach beyond it, from all documents that pass the plain rules."""
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in LEAST]
    limits = []
    for m, least in LEAST.items():
        reach = width * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(least))
        limits += [F.col(m)[int(m in UPPER)].alias(f"{m}_edge"), reach.alias(f"{m}_reach")]
    return measured.where("not base_failed").groupBy("band").agg(*quartiles).select("band", *limits)


def rules(docs: DataFrame, width: float = WIDTH, byte_path: str | None = None,
          piece_path: str | None = None) -> DataFrame:
    """Measures of every row of ``docs`` with the verdict ``kept`` and the rules that reject it.

    Short tokens, many tokens a word, many raw bytes or a low entropy reject; the other side of a band
    is fine. Null and blank texts have no words and fail the plain rules.
    """
    measured = materialize(measure(docs, byte_path, piece_path))
    judged = measured.join(few(stored(bands(measured, width))), "band", "left")
    wider = F.sqrt(1 + F.try_divide(F.lit(SHORT), F.col("n_words")))
    beyond = {m: F.col(m) - F.col(f"{m}_edge") if m in UPPER else F.col(f"{m}_edge") - F.col(m) for m in LEAST}
    out = [F.when(beyond[m] > wider * F.col(f"{m}_reach"), F.lit(m)) for m in LEAST]
    judged = judged.withColumn("out_of_band", F.concat_ws(",", *out))
    return judged.select(*ROW.names, "out_of_band",
                         (~F.col("base_failed") & (F.col("out_of_band") == "")).alias("kept"))


def op3_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(documents(spark, sf_dir))
