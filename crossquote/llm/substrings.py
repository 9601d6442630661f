"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of the ``grain``-word
runs in it, so equal windows have equal minimisers. Consecutive windows that share their minimiser
form a super-k-mer, which travels as one packed string to the bucket of the minimiser. There its windows are
sorted, and equal ones find their smallest document.

Only buckets that two documents share can hold a repeat. A first pass, without text, counts the
documents of each bucket; the packed strings follow for shared buckets only. The windows of a
bucket above ``hot`` super-k-mers are grouped one by one with map-side combine instead, so that a passage of a
third of all documents is not the work of one task.

Whole texts are dealt out once: the wanted strings are cut from the same shuffle that the kept words come from, and the
strings go to their buckets without being written before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.words import WordTable, chunks, documents, mixed, word_hashes
from crossquote.session import shared_dir

WINDOW = 50
GRAIN = 8
HOT = 2_000
SPAN_SQL = "minimiser long, doc_id long, row long, start int, span binary, digest binary"
SPAN = pa.schema([("minimiser", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()),
                  ("span", pa.binary()), ("digest", pa.binary())])
CUT_SQL = "doc_id long, row long, start int, stop int"
CUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:])


def super_kmers(hashes: np.ndarray, window: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of the super-k-mers of one text."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = np.zeros(len(hashes) - grain + 1, np.uint64)
    for i in range(grain):
        runs = runs * np.uint64(0x100000001B3) + hashes[i:len(runs) + i]
    low = sliding_minimum(mixed(runs), window - grain + 1)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return low[first], first, np.diff(np.r_[first, len(low)])


def _occurrences(docs: DataFrame, window: int, grain: int) -> DataFrame:
    """(minimiser, doc_id, row, start, n) of all super-k-mers; nothing of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(lambda words: [word_hashes(words)], [(np.uint64, None)])
        for batch, texts in chunks(batches):
            numbers, offsets = table.number(texts)
            hashes = table[0][numbers]
            found = [super_kmers(hashes[a:b], window, grain) for a, b in zip(offsets[:-1], offsets[1:])]
            count = [len(f[0]) for f in found]
            mini, start, n = (np.concatenate([f[i] for f in found]) for i in range(3))
            rows = np.repeat(np.arange(len(texts)), count)
            yield pa.RecordBatch.from_arrays([
                pa.array(mini.view(np.int64)), batch.column("id").take(pa.array(rows)),
                batch.column("row").take(pa.array(rows)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["minimiser", "doc_id", "row", "start", "n"])

    return docs.mapInArrow(run, "minimiser long, doc_id long, row long, start int, n int")


def _spans(texts: DataFrame, lists: DataFrame, window: int, hot: bool) -> DataFrame:
    """Packed strings of the super-k-mers that are not hot, or of those that are a digest per window."""
    own = lists.withColumn("kmers", F.filter("kmers", lambda k: k["hot"] == hot)).where(F.size("kmers") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            held: list[tuple] = []
            for doc, row, kmers, text in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(),
                                             batch.column("kmers").to_pylist(), texts):
                words = text.split()
                packed = b" ".join(words)
                at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
                for k in kmers:
                    first, last = k["start"], k["start"] + k["n"]
                    if k["hot"]:
                        for i in range(first, last):
                            one = packed[at[i]:at[i + window] - 1]
                            held.append((None, doc, row, i, None, hashlib.blake2b(one, digest_size=16).digest()))
                    else:
                        held.append((k["minimiser"], doc, row, first, packed[at[first]:at[last + window - 1] - 1], None))
                if len(held) > 20_000:
                    yield _batch(held, SPAN)
                    held = []
            if held:
                yield _batch(held, SPAN)

    return texts.join(own, ["id", "row"]).mapInArrow(run, SPAN_SQL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def bucket_cuts(rows: list[tuple], window: int) -> list[tuple]:
    """Word ranges (doc, row, start, stop) to remove, from one bucket's (doc, row, start, span).

    The windows of all different strings are sorted with their smallest document; equal windows
    are neighbours then, and the first has the smallest document of all.
    """
    smallest: dict[bytes, int] = {}
    for doc, _, _, span in rows:
        smallest[span] = min(doc, smallest.get(span, doc))
    if len({doc for doc, *_ in rows}) < 2:
        return []
    windows = []
    for span, doc in smallest.items():
        at = [0, *(i + 1 for i, b in enumerate(span) if b == 32), len(span) + 1]
        windows += [(span[at[i]:at[i + window] - 1], doc, span, i) for i in range(len(at) - window)]
    windows.sort(key=lambda w: w[:2])
    first: dict[bytes, dict[int, int]] = defaultdict(dict)
    same, low = None, 0
    for text, doc, span, i in windows:
        if text != same:
            same, low = text, doc
        first[span][i] = low
    cuts = []
    for doc, row, start, span in rows:
        repeated = sorted(i for i, low in first[span].items() if low < doc)
        for i in repeated:
            if cuts and cuts[-1][:2] == (doc, row) and cuts[-1][2] <= start + i <= cuts[-1][3]:
                cuts[-1] = (*cuts[-1][:3], start + i + window)
            else:
                cuts.append((doc, row, start + i, start + i + window))
    return cuts


def _bucketed(spans: DataFrame, window: int) -> DataFrame:
    """Cuts of all buckets; a task streams through its buckets in order and holds one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, cuts = None, [], []
        for batch in batches:
            for mini, doc, row, start, span in zip(*(batch.column(c).to_pylist() for c in (
                    "minimiser", "doc_id", "row", "start", "span"))):
                if mini != own:
                    cuts += bucket_cuts(rows, window)
                    own, rows = mini, []
                    if len(cuts) > 20_000:
                        yield _batch(cuts, CUT)
                        cuts = []
                rows.append((doc, row, start, span))
        cuts += bucket_cuts(rows, window)
        if cuts:
            yield _batch(cuts, CUT)

    return (spans.drop("digest").repartition("minimiser")
            .sortWithinPartitions("minimiser", "doc_id", "row", "start").mapInArrow(run, CUT_SQL))


def _grouped(windows: DataFrame, window: int) -> DataFrame:
    """Cuts of hot buckets, window by window."""
    smallest = windows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return (windows.join(smallest, "digest").where("doc_id > low")
            .select("doc_id", "row", "start", (F.col("start") + window).alias("stop")))


def _filled(docs: DataFrame) -> DataFrame:
    """(id, row, text) of rows that can repeat another. Shuffles of it by id and row are the same one, which Spark makes once a query."""
    # by a name of its own: a join of a table with itself would rename a kept one on one side, and the shuffles would differ
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "row", "text")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, grain: int = GRAIN, hot: int = HOT) -> DataFrame:
    """(doc_id, row, start, stop): word ranges made of windows that also start in a smaller document.

    ``docs`` has doc_id, text and row, a hash of the text that tells rows of one id apart. Ranges of a row may overlap.
    """
    texts = _filled(docs)
    found = stored(_occurrences(texts, window, grain))
    shared = (found.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                             F.count("*").alias("many"))
              .where("low < high").select("minimiser", (F.col("many") > hot).alias("hot")))
    lists = (found.join(shared, "minimiser").groupBy(F.col("doc_id").alias("id"), "row")
             .agg(F.collect_list(F.struct("minimiser", "start", "n", "hot")).alias("kmers")))
    return _bucketed(_spans(texts, lists, window, False), window).unionByName(
        _grouped(_spans(texts, lists, window, True), window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, grain: int = GRAIN, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row of ``docs``.

    A null text has no words and kept text "". Documents with a null id are kept whole and are no
    one's source; rows of equal id do not count as repeats of each other.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    cuts = (repeated_ranges(own, window, grain, hot).distinct().groupBy(F.col("doc_id").alias("id"), "row")
            .agg(F.collect_list(F.struct("start", "stop")).alias("cuts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sizes, removed, kept = [], [], []
            for cut, text in zip(batch.column("cuts").to_pylist(), texts):
                words = text.split()
                sizes.append(len(words))
                if cut:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [c["start"] for c in cut], 1)
                    np.add.at(gone, [c["stop"] for c in cut], -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                removed.append(sizes[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    whole = own.where("doc_id is null or text is null").select("doc_id", "text")
    return _filled(own).join(cuts, ["id", "row"], "left").select(F.col("id").alias("doc_id"), "text", "cuts").unionByName(
        whole, allowMissingColumns=True).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_text string")


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
k AS (SELECT doc_id, s AS i, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM t)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM k),
c AS (SELECT p.doc_id, p.i, p.word, coalesce(max(CAST(f.again AS INTEGER)) OVER (
        PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) AS gone
      FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.i),
g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
      FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(g.kept, '')) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
