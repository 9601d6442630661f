"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct ``n``-word shingles; two link when their Jaccard similarity reaches
``percent``. Equal sets are one class. Shingles have one global order, frequent ones last, and
each class files the prefix that any similar set must meet it in into an inverted index
with its position there.

Two relations spare most of the work on the index:

* positions: a set far back in its prefix has too little left for the needed overlap with large sets. The join key holds
  size steps, and a leading set is put only at the steps that its size and position can meet;
* answers: each set is first compared with one other at a time, which leads most of its lists, and sets that turn out
  to belong together take over each other's answers: pairs inside one component are not looked at again, and only
  sets outside the largest component of a list lead it afterwards. A group of thousands of near copies costs a few
  comparisons each, not one per pair.

Before any text is read, parity sketches rule out pairs: the bits in which two sketches differ are at most the
shingles in which the sets differ. In lists with many sets outside their largest component, short ones do so inside the
join, so that near copies that just miss the similarity make no row per pair.

Lists with many sets outside their largest component go on with further leading sets, until nothing is left. No cap is
set on lists or partners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.substrings import stored
from crossquote.llm.words import BATCH_CONF, WordTable, chunks, documents, keep_batches_small, mixed, word_hashes
from crossquote.operators.clusters import connected_components

SHINGLE, PERCENT = 4, 85
SAMPLE = 5_000  # documents, about, whose shingles tell which are frequent; this decides only the order
FREQUENT = 5  # sampled documents with a frequent shingle, at least
MOST_FREQUENT = 1_000_000  # frequent shingles kept
PRODUCTIVE = 8  # rounds with one comparison per set go on while one in so many of them links
LEADERS = 4  # leading sets of a list in the round after those, at most, and
MORE = 8  # how many times more in each of the next ones; until then most of a group has become one component
STEPS = 8
ENTRY = ("token", "rep", "size", "at", "comp")
SLICE = 512 << 10  # bytes of text worked on at a time
KNOWN = 50_000  # words whose hashes a task remembers; hashing again is cheap
SKETCH = 1024  # bits of a parity sketch, at least; doubled until there is one for every two shingles
WIDE = 32  # lists with more sets than so outside their largest component have short sketches in their entries, of
WORDS = 8  # 64 bits each; the shortest sketch is this long or longer
FEW_IDS = 2_000_000  # up to so many wanted texts (16 MB of ids), the others are dropped before the shuffle
MEMBERS = 500  # sets compared with a leading set in one group


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for what runs meanwhile."""
    own = spark.conf.get(BATCH_CONF)
    keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, own)


class Shingles:
    """Sorted distinct shingle hashes of texts; the hashes of words are remembered while a task runs."""

    def __init__(self, n: int):
        self._n = n
        self._table = WordTable(lambda words: [word_hashes(words)], [(np.uint64, None)], KNOWN)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        numbers, offsets = self._table.number([t.lower() for t in texts])  # of bytes, this lowers A-Z only
        hashes = self._table[0][numbers]
        return [self._one(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]

    def _one(self, words: np.ndarray) -> np.ndarray:
        n = min(self._n, len(words))
        if not n:
            return np.zeros(0, np.uint64)
        key = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + words[i:len(key) + i]
        return np.unique(mixed(key))


def frequent_shingles(docs: DataFrame, n: int, sample: int = SAMPLE, least: int = FREQUENT) -> np.ndarray:
    """Shingles of at least ``least`` documents of a sample, up to MOST_FREQUENT, the most frequent last.

    They only move to the end of the order. Which ones they are, and in which order, never changes the result.
    """
    share = min(1.0, sample / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for _, texts in chunks(batches, size=SLICE):
            keys, counts = np.unique(np.concatenate(shingles(texts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < share * (1 << 20)).select("text")
    counted = chosen.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key").toArrow()
    return top.column("key").to_numpy().astype(np.int64).view(np.uint64)[::-1]


def parity_sketch(one: np.ndarray) -> np.ndarray:
    """For each remainder of the hashes, whether the set has an odd number of shingles with it."""
    bits = SKETCH
    while 2 * bits < len(one):
        bits *= 2
    odd = np.bincount((one & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def shingle_sets(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, digest, prefix, sketch): size, identity, index prefix and sketch of each document's set."""
    order = np.argsort(frequent)
    last = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (late, place) = Shingles(n), last.value
        for batch, texts in chunks(batches, size=SLICE):
            sets = shingles(texts)
            prefixes, sketches = [], []
            for one in sets:
                sketches.append(parity_sketch(one))
                size = len(one) - (percent * len(one) + 99) // 100 + 1 if len(one) else 0
                if len(late) and len(one):
                    at = np.minimum(np.searchsorted(late, one), len(late) - 1)
                    common = late[at] == one
                    one = np.concatenate([one[~common], one[common][np.argsort(place[at[common]])]])
                prefixes.append(one[:size].view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "prefix", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, prefix array<long>, sketch array<long>")


def _may_link(size_a: Column, at_a: Column, size_b: Column, at_b: Column, percent: int) -> Column:
    """Sizes and positions leave room for the overlap, if this shingle is the first that both sets have."""
    rest = F.least(size_a - at_a, size_b - at_b)
    return ((100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
            & ((100 + percent) * rest >= percent * (size_a + size_b)))


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _possible(differ: Column, sizes: Column, percent: int) -> Column:
    """Sets of ``sizes`` shingles together can be similar if their sketches differ in so many bits.

    They differ in |a| + |b| - 2 overlap shingles, and the overlap is percent / (100 + percent) of |a| + |b| at least.
    """
    return (100 + percent) * differ <= (100 - percent) * sizes


def _step(size: Column, percent: int) -> Column:
    """Sizes in steps, ``STEPS`` of them from the smallest size in reach of a set to its own."""
    return F.floor(F.log(size.cast("double")) / float(np.log(100 / percent) / STEPS)).cast("int") if percent < 100 else size.cast("int")


def _met(entries: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(rep, head) of entries and heads of a list, of different components, as often as size and position leave them to each other.

    A head at position ``at`` of its set has so much left behind that only sets up to a certain size can reach the overlap. It is
    put at the size steps it can meet and nowhere else, so what it cannot meet is not joined. Entries and heads may have short
    sketches in ``bits``; two that have them are met only if these leave the similarity possible.
    """
    most = F.least(F.col("size") * 100 / percent, (100 * F.col("size") - (100 + percent) * F.col("at")) / F.lit(percent))
    least = F.ceil(F.col("size") * percent / F.lit(100))
    reach = heads.where(most >= least).withColumn("step", F.explode(F.sequence(
        _step(least, percent), _step(F.floor(most), percent)))).select(
        "token", "step", F.col("rep").alias("head"), F.col("size").alias("head_size"), F.col("at").alias("head_at"),
        F.col("comp").alias("head_comp"), *[F.col("bits").alias("head_bits")] * ("bits" in heads.columns))
    near = F.lit(True)
    if "bits" in heads.columns:
        near = F.coalesce(_possible(_differ(F.col("bits"), F.col("head_bits")), F.col("size") + F.col("head_size"), percent), F.lit(True))
    return entries.withColumn("step", _step(F.col("size"), percent)).join(reach, ["token", "step"]).where(
        (F.col("comp") != F.col("head_comp")) & _may_link(F.col("size"), F.col("at"), F.col("head_size"), F.col("head_at"), percent)
        & near).select("rep", "head")


def _lists(active: DataFrame) -> DataFrame:
    """Entries of lists that span several components, with their list's largest one and how many sets are outside of it."""
    comps = active.groupBy("token", "comp").agg(F.count("*").alias("n"))
    lists = comps.groupBy("token").agg(F.count("*").alias("comps"), (F.sum("n") - F.max("n")).alias("outside"),
                                       F.max_by("comp", F.struct("n", "comp")).alias("major")).where("comps > 1")
    return active.join(lists, "token").select(*ENTRY, "outside", "major")


def _one_each(filed: DataFrame, seed: int, percent: int) -> DataFrame:
    """One pair for each set outside: with the set that leads most of its lists. Of a list's largest component, the lowest hash leads."""
    inside = F.col("comp") == F.col("major")
    heads = filed.where(inside).groupBy("token").agg(
        F.min_by(F.struct("rep", "size", "at", "comp"), F.struct(F.xxhash64("rep", F.lit(seed)), "rep")).alias("head"))
    met = _met(filed.where(~inside), heads.select("token", "head.*"), percent)
    return met.groupBy("rep", "head").agg(F.count("*").alias("n")).groupBy("rep").agg(
        F.max_by("head", F.struct("n", "head")).alias("lead")).select("lead", F.col("rep").alias("other"))


def _short_sketch(sketch: Column) -> Column:
    """The sketch folded to WORDS words."""
    def word(k: int) -> Column:
        return F.aggregate(F.filter(sketch, lambda _, at: at % WORDS == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return F.array(*[word(k) for k in range(WORDS)])


def _with_bits(entries: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Entries of wide lists get the short sketch of their set, the others none. Without classes (rep, sketch) all stay as they are."""
    if classes is None:
        return entries
    bits = classes.select("rep", _short_sketch(F.col("sketch")).alias("bits"))
    return entries.where(F.col("outside") > WIDE).join(bits, "rep").unionByName(
        entries.where(F.col("outside") <= WIDE), allowMissingColumns=True)


def _all_pairs_outside(filed: DataFrame, leaders: int, percent: int, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, what is left of the lists): sets outside a list's largest component lead it.

    A list with at most ``leaders`` sets outside is finished by them; of a longer one, one set per hash slot leads, and the rest waits.
    With ``classes``, pairs in wide lists that short sketches rule out are left away.
    """
    slot = F.when(F.col("outside") > leaders, F.pmod(F.xxhash64("rep"), F.lit(leaders))).otherwise(F.col("rep"))
    heads = filed.where("comp <> major").groupBy("token", slot.alias("slot")).agg(
        F.min(F.struct("rep", "size", "at", "comp", "outside")).alias("head")).select("token", "head.*")
    rest = filed.where(F.col("outside") > leaders).join(heads.select("token", "rep"), ["token", "rep"], "left_anti")
    once = _met(_with_bits(filed, classes), _with_bits(heads, classes), percent).groupBy(F.least("head", "rep").alias("lo"), F.greatest("head", "rep").alias("hi")).agg(
        F.min("head").alias("lead"))
    return once.select("lead", F.when(F.col("lead") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other")), rest.select(
        "token", "rep", "size", "at", "comp")


def _folded(sketch: Column, bits_of: Column) -> Column:
    """The sketch at half its length, if it is longer than the other one. Sizes in reach differ by one step at most."""
    half = (F.size(sketch) / 2).cast("int")
    halves = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > F.size(bits_of), halves).otherwise(sketch)


def sketch_passes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave the needed similarity possible; no pair that has it is lost."""
    own = classes.select("rep", "size", "sketch")
    both = pairs.join(own.toDF("lead", "lead_size", "lead_sketch"), "lead").join(own.toDF("other", "size", "sketch"), "other")
    a, b = _folded(F.col("lead_sketch"), F.col("sketch")), _folded(F.col("sketch"), F.col("lead_sketch"))
    same_length = (F.size(a) == F.size(b))
    possible = _possible(_differ(a, b), F.col("lead_size") + F.col("size"), percent)
    return both.where(~same_length | possible).select("lead", "other")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (lead, other) whose sets reach the similarity, as (id_a, id_b).

    Each text is sent to the groups that need it: its own as the leading set, in which it is read once,
    and those of the sets it is compared with. A leading set with many others has several groups.
    """
    groups = pairs.groupBy("lead").agg(F.ceil(F.count("*") / float(MEMBERS)).cast("int").alias("parts"))
    sent = pairs.join(groups, "lead").select(
        F.col("other").alias("rep"), F.struct(F.col("lead"), F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"),
                                              F.lit(False).alias("first")).alias("to"))
    own = groups.select(F.col("lead").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "rep", F.struct(F.col("rep").alias("lead"), "part", F.lit(True).alias("first")).alias("to"))
    # a set that many others lead has bounded lists: at most one entry per posting of its prefix
    wanted = stored(sent.unionByName(own).groupBy("rep").agg(F.collect_list("to").alias("to")))
    if wanted.count() <= FEW_IDS:
        texts = texts.join(F.broadcast(wanted.select("rep")), "rep", "left_semi")
    rows = (texts.join(wanted, "rep").select("rep", "text", F.explode("to").alias("to"))
            .select("to.lead", "to.part", "to.first", "rep", "text")
            .repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("first"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, own, leading = Shingles(n), None, []
        for batch, raw in chunks(batches, size=SLICE):
            sets, a, b = shingles(raw), [], []
            for lead, part, first, rep, one in zip(*(batch.column(c).to_pylist() for c in ("lead", "part", "first", "rep")), sets):
                if first:
                    leading = [*leading, one] if own == (lead, part) else [one]
                    own = (lead, part)
                elif any(similar(x, one, percent) for x in leading):
                    a.append(min(rep, lead))
                    b.append(max(rep, lead))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id_a", "id_b"])

    return rows.mapInArrow(run, "id_a long, id_b long").distinct()


def class_links(classes: DataFrame, texts: DataFrame, n: int, percent: int, everything: bool = False,
                leaders: int = LEADERS) -> DataFrame:
    """Links (id_a, id_b) between classes (rep, size, prefix, sketch); ``texts`` has their text by rep.

    Enough links to connect whatever is connected; with ``everything`` all links, without the skipping
    of answers, so that near copies cost a comparison per pair.
    """
    index = classes.select("rep", "size", F.posexplode("prefix").alias("at", "token"))
    # at first each set is a component of its own, so that the counts of a list are enough to file it
    lists = index.groupBy("token").agg(F.count("*").alias("many"), F.max("rep").alias("major")).where("many > 1")
    filed = stored(index.join(lists, "token").select(
        "token", "rep", "size", "at", F.col("rep").alias("comp"), (F.col("many") - 1).alias("outside"), "major"))
    links, seed, single = None, 0, not everything
    while not filed.isEmpty():
        if single:
            pairs, rest = _one_each(filed, seed, percent), filed.select(*ENTRY)
            seed += 1
        else:
            pairs, rest = _all_pairs_outside(filed, leaders, percent, classes)
            leaders *= MORE
        pairs = stored(pairs)
        new = stored(verified(stored(sketch_passes(pairs, classes, percent)), texts, n, percent))
        links = new if links is None else links.unionByName(new)
        found = new.count()
        # a round that links few of its sets has found what is easy; the others are then compared with all
        single = single and found * PRODUCTIVE >= pairs.count()
        if not everything and found:
            named = stored(connected_components(links).toDF("rep", "named"))
            rest = rest.join(named, "rep", "left").withColumn("comp", F.coalesce("named", "comp")).drop("named")
        filed = stored(_lists(rest.select(*ENTRY)))
    return links if links is not None else classes.sparkSession.createDataFrame([], "id_a long, id_b long")


def link_documents(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach, per row of ``docs``.

    A null or blank text has an empty set and links with nothing. Equal sets are in one component.
    Rows of one id are one document: what one of them links with, all of them do. A null id links
    with nothing and has a null component.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        sets = stored(shingle_sets(own, n, percent, frequent_shingles(own, n)))
    filled = sets.where("doc_id is not null and n_shingles > 0")
    classes = stored(filled.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"), F.min_by("prefix", "doc_id").alias("prefix"),
        F.min_by("sketch", "doc_id").alias("sketch")))
    texts = own.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("rep"), "text")
    with small_batches(docs.sparkSession):
        links = class_links(classes.drop("digest"), texts, n, percent, **options)
    members = stored(sets.select("doc_id", "n_shingles", "digest").join(
        classes.select("digest", "rep"), "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")).alias("rep")))
    split = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    same = members.join(split.where("lo < hi").select("doc_id"), "doc_id").where("rep is not null").select(
        F.col("rep").alias("id_a"), F.col("doc_id").alias("id_b"))
    named = connected_components(links.unionByName(same)).toDF("node", "component")
    return members.join(named, F.coalesce("rep", "doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + {SHINGLE - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS s FROM t WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM j JOIN z a ON x = a.doc_id JOIN z b ON y = b.doc_id WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT t.doc_id, coalesce(z.n, 0) AS n_shingles, c.m AS component_id
FROM t LEFT JOIN z ON t.doc_id = z.doc_id JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON t.doc_id = c.x
"""
