"""Language identification with spans of mixed-language text.

Words are cut where the writing system changes and after every ``PIECE`` letters, so text without spaces is read
to its end. Each piece is scored under each language from hashed character n-grams, and its writing system
narrows the languages it can have to those that use that script. A Viterbi pass
with a fixed penalty for each switch then labels all pieces of a text, so that spans of
another language stand out while single odd words do not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.scripts import NAMES, OTHER, script_codes
from crossquote.llm.words import Rows, WordTable, chunks, documents, id_remainder, mixed, ragged

GRAMS = (1, 2, 3, 4)
BITS = 16  # hashed n-gram table of a language
PIECE = 64  # letters that are scored at a time; longer runs are cut into consecutive pieces
KNOWN = 80_000  # words, and pieces of words, whose scores a task remembers; more would crowd other stages' workers
SAMPLE = 3_000  # documents per language that the model is fitted on, about
SWITCH = 8.0
UNKNOWN = "und"
RULED_OUT = -50.0
BLOCK_NAMES = {"HIRAGANA": "Kana", "KATAKANA": "Kana", "CJK": "Han"}  # scripts whose letters are named otherwise


def spell(words: list[bytes]) -> list[str]:
    """The letters of each word in lower case; no letters give the empty text."""
    out = []
    for raw in words:
        word = raw.decode("utf-8", "replace").lower()
        if not word.isalpha():
            word = "".join(filter(str.isalpha, word))
        out.append(word)
    return out


def run_scripts(codes: np.ndarray) -> np.ndarray:
    """Writing system of each letter, -1 for blanks.

    Letters outside the main blocks go by their names; if those name no script, modifier letters go with the letter before.
    """
    script = np.where(codes == 32, -1, script_codes(codes))
    for code in np.unique(codes[script == OTHER]).tolist():
        named = {BLOCK_NAMES.get(w, w.title()) for w in unicodedata.name(chr(code), "").split()} & set(NAMES[:OTHER])
        own = codes == code
        if named:
            script[own] = NAMES.index(min(named))
        elif unicodedata.category(chr(code)) == "Lm":
            before = np.maximum.accumulate(np.where(own, 0, np.arange(len(codes))))
            script[own] = np.where(script[before] >= 0, script[before], script)[own]
    return script


def pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Consecutive pieces of all words, each of one script and at most PIECE letters, and how many each word has."""
    codes = np.frombuffer(" ".join(words).encode("utf-32-le"), "<u4")
    script = run_scripts(codes)
    counts = np.ones(len(words), np.int32)
    turns = np.flatnonzero((script[1:] != script[:-1]) & (script[1:] >= 0) & (script[:-1] >= 0)) + 1
    first = np.cumsum([0, *(len(w) + 1 for w in words)])
    owner = np.searchsorted(first, turns, "right") - 1
    cuts: dict[int, list[int]] = {i: [] for i, w in enumerate(words) if len(w) > PIECE}
    for i, at in zip(owner.tolist(), (turns - first[owner]).tolist()):
        cuts.setdefault(i, []).append(at)
    if not cuts:
        return words, counts
    out, done = [], 0
    for i in sorted(cuts):
        out += words[done:i]
        word, done = words[i], i + 1
        edges = [0, *cuts[i], len(word)]
        own = [word[at:min(at + PIECE, b)] for a, b in zip(edges, edges[1:]) for at in range(a, b, PIECE)]
        counts[i] = len(own)
        out += own
    return out + words[done:], counts


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and the word each comes from. Words are framed by a blank."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.cumsum(codes == 32) - 1  # the blank before a word belongs to it
    hashes, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        key = np.full(len(codes) - n + 1, n, np.uint64)
        inner = np.zeros(len(key), bool)
        for i in range(n):
            part = codes[i:len(codes) - n + 1 + i]
            key = key * np.uint64(0x100000001B3) + part
            if 0 < i < n - 1:
                inner |= part == 32
        keep = ~inner
        if n == 1:
            keep &= codes != 32
        if n == 2:  # two blanks in a row frame an empty word
            keep &= ~((codes[:-1] == 32) & (codes[1:] == 32))
        hashes.append((mixed(key[keep]) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[:len(keep)][keep])
    return np.concatenate(hashes), np.concatenate(owners)


def word_scripts(words: list[str]) -> np.ndarray:
    """Writing system of each piece by its first letter; -1 without letters."""
    first = np.array([ord(w[0]) if w else 0 for w in words])
    return run_scripts(np.where(first == 0, 32, first))


@dataclass
class Model:
    """Log-probabilities of hashed n-grams per language, and which languages use which script."""

    langs: list[str]
    logp: np.ndarray  # (n-gram, language)
    uses: np.ndarray  # (script, language)

    def score(self, words: list[str]):
        """Per piece: scores of all languages, letters. Pieces without letters score 0 everywhere."""
        parts = [self._score(words[at:at + 20_000]) for at in range(0, len(words), 20_000)]
        return [np.concatenate(columns) for columns in zip(*parts)]

    def _score(self, spelled: list[str]):
        scores = np.zeros((len(spelled), len(self.langs)), np.float32)
        letters = np.array([len(w) for w in spelled], np.int32)
        if letters.any():
            key, owner = grams(spelled)
            order = np.argsort(owner, kind="stable")
            key, owner = key[order], owner[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            scores[owner[starts]] = np.add.reduceat(self.logp[key], starts) / len(GRAMS)
            script = word_scripts(spelled)
            scores[~self.uses[script] & (script >= 0)[:, None]] += RULED_OUT
            scores[letters == 0] = 0
        return scores, letters

    def table(self) -> PieceTable:
        return PieceTable(self)


class PieceTable:
    """Scores and letters of the pieces of words, behind a WordTable. The memory is bounded as there, in pieces too."""

    def __init__(self, model: Model):
        self._model = model
        self._clear()

    def _clear(self) -> None:
        self._words = WordTable(self._new, [(np.int64, None), (np.int32, None)], KNOWN)
        self._scores, self._letters = Rows(np.float32, len(self._model.langs)), Rows(np.int32)

    def _new(self, words: list[bytes]):
        if not len(self._words[0]):
            self._scores, self._letters = Rows(np.float32, len(self._model.langs)), Rows(np.int32)
        own, counts = pieces(spell(words))
        starts = len(self._letters.values) + np.cumsum(counts, dtype=np.int64) - counts
        scores, letters = self._model.score(own)
        self._scores.extend(scores)
        self._letters.extend(letters)
        return starts, counts

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row and the offsets of the texts; pieces of each word and the offsets in words."""
        if len(self._letters.values) > KNOWN:
            self._clear()
        numbers, offsets = self._words.number(texts)
        counts = self._words[1][numbers]
        return ragged(self._words[0][numbers], counts), np.r_[0, np.cumsum(counts, dtype=np.int64)][offsets], counts, offsets

    @property
    def scores(self) -> np.ndarray:
        return self._scores.values

    @property
    def letters(self) -> np.ndarray:
        return self._letters.values


def places(counts: np.ndarray, letters: np.ndarray, at: np.ndarray) -> list[str]:
    """Where pieces of a text begin: the word, and after a plus the letters of that word before the piece."""
    first = np.r_[0, np.cumsum(counts)]
    word = np.searchsorted(first, at, "right") - 1
    before = np.r_[0, np.cumsum(letters, dtype=np.int64)]
    inside = before[at] - before[first[word]]
    return [f"{w}+{n}" if n else str(w) for w, n in zip(word.tolist(), inside.tolist())]


def fit(labelled: DataFrame, sample: int = SAMPLE, smoothing: float = 0.5) -> Model | None:
    """Naive Bayes over hashed n-grams of (doc_id, text, lang); None without labelled text.

    Fitted on a bounded sample: about ``sample`` documents of each language, those with the smallest
    id hashes. Counts leave Spark as one row per language and n-gram (at most 2 ** BITS each).
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chosen = rows.where(part < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), 1 << BITS))
        scripts = np.zeros((len(langs), len(NAMES)))
        docs = np.zeros(len(langs))
        for batch, texts in chunks(batches, size=1 << 20):
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            docs += np.bincount(lang, minlength=len(langs))
            for at in np.unique(lang):
                words = spell(b" ".join(t for t, own in zip(texts, lang) if own == at).split())
                words, _ = pieces([w for w in words if w])
                if words:
                    counts[at] += np.bincount(grams(words)[0], minlength=1 << BITS)
                    scripts[at] += np.bincount(word_scripts(words), minlength=len(NAMES))
        for at in range(len(langs)):
            for kind, values in (("gram", counts[at]), ("script", scripts[at]), ("docs", docs[at:at + 1])):
                keys = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind] * len(keys), pa.string()), pa.array([at] * len(keys), pa.int32()),
                    pa.array(keys, pa.int32()), pa.array(values[keys], pa.float64())], ["kind", "lang", "key", "n"])

    counted = (chosen.mapInArrow(count, "kind string, lang int, key int, n double")
               .groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toArrow())
    kind = np.array(counted.column("kind").to_pylist(), object)
    lang, key, n = (counted.column(c).to_numpy() for c in ("lang", "key", "n"))
    grid = {"gram": np.zeros((1 << BITS, len(langs))), "script": np.zeros((len(NAMES), len(langs))),
            "docs": np.zeros((1, len(langs)))}
    for name, table in grid.items():
        own = kind == name
        table[key[own], lang[own]] = n[own]
    logp = np.log(grid["gram"] + smoothing) - np.log(grid["gram"].sum(0) + smoothing * (1 << BITS))
    share = grid["script"] / np.maximum(grid["script"].sum(0), 1)
    uses = share >= 0.01
    uses[~uses.any(1)] = True  # of a script that no language uses, any language can be
    return Model(langs, logp.astype(np.float32), uses)


def one_language(scores: np.ndarray, switch: float) -> int:
    """The language that labels the whole text in the best path, or -1 if the best path may switch.

    A stretch of pieces in another language than that of the best total gains at most the largest such sum. A path
    with k of these stretches pays ``switch`` k - 1 times at least (it need not visit the best language at all), and
    once if k is 1, unless the stretch is the whole text, which gains nothing. So if no stretch gains more than half
    of ``switch``, k of them gain less than they pay.
    """
    best = int(np.argmax(scores.sum(0, dtype=np.float64)))
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64)
    lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    lowest[1:] = lowest[:-1]
    lowest[0] = 0
    return best if (gain - lowest).max() < switch / 2 else -1  # at half, two stretches can draw


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best language of every word: the sum of scores less ``switch`` per change. Ties keep the language.

    All texts go forward together, longest first, one word a step.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    first = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([scores[i] for i in order]).astype(np.float64)
    back = np.empty(flat.shape, np.int16)
    own = np.arange(flat.shape[1], dtype=np.int16)
    total = np.zeros((len(order), flat.shape[1]))
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than t words
    for t in range(longest):
        n = active[t]
        now = total[:n]
        if t:
            top = now.argmax(1)
            jump = now[np.arange(n), top] - switch
            stay = now >= jump[:, None]
            back[first[:n] + t] = np.where(stay, own, top[:, None].astype(np.int16))
            now = np.where(stay, now, jump[:, None])
        total[:n] = now + flat[first[:n] + t]
    labels = np.empty(len(flat), np.int16)
    state = total.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    out: list[np.ndarray] = [np.empty(0)] * len(order)
    for place, i in enumerate(order):
        out[i] = labels[first[place]:first[place + 1]]
    return out


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """(doc, lang_pred, score, spans) per row of ``docs``, where ``doc`` is a struct of all its columns.

    ``lang_pred`` has most letters in the best path, ``score`` is its share of the letters times
    its odds against the second language. ``spans`` lists language:first:end in words; a place inside a word is
    ``word+letters``, after that many letters of the word. A text that is null
    or has no letters is ``und`` with score 0, and so is everything without a model. Repeated
    rows are labelled each; equal scores go to the language that comes first.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = known.value
        table = fitted.table() if fitted is not None else None
        for batch, texts in chunks(batches, "doc"):
            found: list[tuple] = [(UNKNOWN, 0.0, "")] * len(texts)
            if table is not None:
                numbers, offsets, counts, words = table.number(texts)
                scores, spelled = table.scores, table.letters[numbers]
                hard, own = [], {}
                for row in range(len(texts)):
                    span = slice(offsets[row], offsets[row + 1])
                    if not spelled[span].any():
                        continue
                    local = scores[numbers[span]]
                    single = one_language(local, switch)
                    if single < 0:
                        hard.append((row, local))
                    else:
                        own[row] = np.full(len(local), single, np.int16)
                if hard:
                    own |= dict(zip((row for row, _ in hard), viterbi([s for _, s in hard], switch)))
                for row, path in own.items():
                    span = slice(offsets[row], offsets[row + 1])
                    weight = np.bincount(path, spelled[span], len(fitted.langs))
                    best = int(weight.argmax())
                    inside = path == best
                    sums = scores[numbers[span][inside]].sum(0, dtype=np.float64)
                    rival = np.delete(sums, best).max(initial=-np.inf)
                    odds = 1 / (1 + np.exp(-np.clip(sums[best] - rival, -30, 30)))
                    cuts = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)]
                    at = places(counts[words[row]:words[row + 1]], spelled[span], cuts)
                    spans = ",".join(f"{fitted.langs[path[c]]}:{a}:{b}" for c, a, b in zip(cuts, at, at[1:]))
                    found[row] = (fitted.langs[best], float(odds * weight[best] / weight.sum()), spans)
            lang, score, spans = zip(*found)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                pa.array(spans, pa.string())], ["doc", "lang_pred", "score", "spans"])

    whole = docs.select(F.struct("*").alias("doc"))
    return whole.mapInArrow(label, f"{_ddl(whole)}, lang_pred string, score double, spans string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (id_remainder(4) == 2).alias("held_out"))
    found = identify(docs.drop("lang"), fit(docs.where("not held_out")))
    return found.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "spans")
