"""Near-duplicate documents by Order MinHash.

A text is a row of words; its k-mers are three words, numbered by occurrence so that a repeated k-mer counts
each time. Each of ``SKETCHES`` hash functions takes the ``PICKED`` smallest of them and keeps them in
text order: texts agree on a sketch if they share these k-mers and their order, which follows the edit
similarity. At similarity s about s^3 of the k-mers are shared, so two texts agree on a sketch with
probability (s^3 / (2 - s^3))^2 or more, 0.118 at 0.8, and on none of 48 with 0.002.

Texts of up to ``SHORT`` words have too few k-mers for that and go another way, which loses nothing. An edit
touches one word, so similar texts share all words but as many as the longer one may have edits, E. Put the
words of every text into one order; then at least three shared words are among the first E + 3 of both. Each
text has a key for every three of those. Words are ordered by how many short texts hold them, rare ones first, so
that a stretch which many texts share makes no keys where a text has rarer words.

Documents with a sketch or three rare words in common are candidates, and a banded alignment of their words
decides: similar means that at most a fifth of the longer text's words have to be edited.

Equal texts are one class. In each bucket all classes are first compared with one of them, in a few rounds
with another one each time, and only across components: that joins large groups with few comparisons.
Buckets that still hold several components are then compared in full between components if they are small. Texts of
larger ones are compared across components by their rarest words:
similar texts of n words differ in at most E, so they share one of the first E + 1 words of both, rare ones first.
Texts that have only a passage in common have it behind their own words and do not meet. Everything that
is aligned has met bounds that lose nothing (word counts in bins differ by at most two per edit).

Texts are moved once, to files that the comparisons read as they lie; buckets hold numbers of classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.alignment import banded
from dwellgrid.llm.common import identified, quoted
from dwellgrid.llm.components import components
from dwellgrid.session import materialize, materialize_buckets

WORDS = 3
SIMILARITY = 0.8
SKETCHES, PICKED = 48, 2
#: Words of a text up to which pairs are found by rare words, and the words of such a key.
SHORT, TOGETHER = 24, 3
#: Counters of words, by hash: they only choose the order of words, any order finds every pair.
COUNTERS = 1 << 16
#: Rounds in which a bucket is compared with one of its members; the first looks at one of so many buckets.
ROUNDS, FIRST_OF = 3, 8
#: Members up to which a bucket that is still open is compared in full.
SMALL = 16
BINS = 64
#: Distinct words a worker remembers the hash of.
KEPT = 200_000
#: Hash values that are held at once while a text is sketched.
AT_ONCE = 1 << 18

MULTIPLIERS = (np.random.default_rng(20240607).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def tokens(text: str, known: Hashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers with their occurrence number; a shorter text is one k-mer."""
    n = len(words) - WORDS + 1
    if n <= 0:
        words, n = np.concatenate([words, np.full(WORDS - len(words), 7, np.uint64)]), 1
    x = np.zeros(n, np.uint64)
    for k in range(WORDS):
        x = mixed(x + words[k : k + n])
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - first).astype(np.uint64)
    return mixed(x + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketch(words: np.ndarray) -> np.ndarray:
    """One bucket key for each hash function."""
    x = kmers(words)
    picked = min(PICKED, len(x))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, AT_ONCE // len(x))
    for begin in range(0, SKETCHES, step):
        some = MULTIPLIERS[begin : begin + step]
        h = x[None, :] * some[:, None]
        h ^= h >> np.uint64(32)
        at = np.argpartition(h, picked - 1, axis=1)[:, :picked] if picked < len(x) else np.tile(np.arange(len(x)), (len(some), 1))
        at.sort(axis=1)  # text order
        key = np.zeros(len(some), np.uint64)
        for k in range(picked):
            key = mixed(key * np.uint64(31) + x[at[:, k]])
        out[begin : begin + step] = mixed(key + np.arange(begin, begin + len(some), dtype=np.uint64))
    return out


def limit(longer: int) -> int:
    """Edits that similar texts of so many words may differ by."""
    return int(longer * (1 - SIMILARITY) + 1e-9)


#: The shortest text that one of more than ``SHORT`` words can be similar to.
SKETCHED = SHORT + 1 - limit(SHORT + 1)
#: For each number of words the places of those that make a key.
CHOICES = [np.array(list(combinations(range(n), TOGETHER)), np.int64).reshape(-1, TOGETHER) for n in range(limit(SHORT) + TOGETHER + 1)]


def labelled(words: np.ndarray) -> np.ndarray:
    """The words with their occurrence number, so that a repeated word counts each time."""
    seen: dict[int, int] = {}
    times = np.empty(len(words), np.uint64)
    for i, word in enumerate(words.tolist()):
        times[i] = seen[word] = seen.get(word, -1) + 1
    return mixed(words + times * np.uint64(0x9E3779B97F4A7C15))


def counters(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(COUNTERS)).astype(np.int64)


def rare(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of a short text: every three of its first words in the order of ``counts``."""
    edits = limit(len(words))
    if not limit(len(words) + 1):
        return np.empty(0, np.uint64)  # so few words that only equal texts are similar, and those are one class
    every = labelled(words)
    order = np.lexsort((every, counts[counters(words)]))
    first = every[order[: edits + TOGETHER]]
    key = np.full(len(CHOICES[len(first)]), TOGETHER, np.uint64)
    for column in CHOICES[len(first)].T:
        key = mixed(key * np.uint64(31) + first[column])
    return key


NO_COUNTS = np.zeros(COUNTERS, np.int64)


def keys(words: np.ndarray, counts: np.ndarray = NO_COUNTS) -> np.ndarray:
    """The bucket keys of a text: of its sketches, of its rare words, or of both for texts that have both kinds of partners."""
    n = len(words)
    if n > SHORT:
        return sketch(words)
    found = rare(words, counts)
    return np.concatenate([sketch(words), found]) if n >= SKETCHED else found


def first_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As many words of a text, with their occurrence and rare ones first, that a similar one shares one of its own."""
    every = labelled(words)
    return every[np.lexsort((every, counts[counters(every)]))[: limit(len(words)) + 1]]


def word_counts(docs: DataFrame) -> np.ndarray:
    """How many different short texts hold the words of each counter; the driver sees a row per counter."""
    # Splitting ends soon after the words of a short text, however long the text is.
    short = docs.where(F.size(F.split("text", r"\s+", SHORT + 3)) <= SHORT + 2).select("text").distinct()
    return _counted(short, np.unique)


def _counted(texts: DataFrame, which) -> np.ndarray:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Hashes(), np.zeros(COUNTERS, np.int64)
        for part in parts:
            for text in part.column(0).to_pylist():
                np.add.at(counts, counters(which(tokens(text, known))), 1)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held), pa.array(counts[held])], ["counter", "n"])

    counts = NO_COUNTS.copy()
    for row in texts.mapInArrow(batches, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        counts[row.counter] = row.n
    return counts


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_words, bins, buckets`` of ``doc_id, text``."""
    counts = word_counts(docs)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                sizes, bins, buckets = [], [], []
                for text in some.column(2).to_pylist():
                    words = tokens(text, known)
                    sizes.append(len(words))
                    bins.append(np.bincount((words >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.int32))
                    buckets.append(keys(words, counts).view(np.int64))
                yield pa.record_batch(
                    [
                        some.column(0), some.column(1), pa.array(sizes, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, BINS * len(sizes) + 1, BINS, dtype=np.int32)), np.concatenate(bins)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, buckets)]).astype(np.int32)), np.concatenate(buckets)),
                    ],
                    ["doc_id", "digest", "n_words", "bins", "buckets"],
                )

    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(batches, "doc_id long, digest binary, n_words int, bins array<int>, buckets array<bigint>")


def digest(text):
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes ``a, b`` whose texts, by ``a_digest, b_digest``, are similar by banded alignment."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for part in parts:
            a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                one, other = tokens(x, known).tolist(), tokens(y, known).tolist()
                longer = max(len(one), len(other))
                shared = (Counter(one) & Counter(other)).total()
                keep.append(shared >= longer - limit(longer) and banded(one, other, limit(longer)) is not None)
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    side = lambda name: texts.select(F.col("digest").alias(f"{name}_digest"), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("a"), "a_digest").join(side("b"), "b_digest").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(batches, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """``doc_id, class_id, kept`` of every document.

    ``class_id`` is the smallest ``doc_id`` of all texts that are equal or linked by similar ones; one row of
    each class with that key is ``kept`` (of repeated keys the one with the smallest text digest, all its
    equal rows). Empty and null texts are one class, as equal texts are; null keys belong to classes but
    name none. Other columns are ignored; no rows give no rows.
    """
    rows = identified(docs, key, value)
    whole = [F.first(c).alias(c) for c in ("n_words", "bins", "buckets")]
    classes = sketches(rows).groupBy("digest").agg(F.min("doc_id").alias("first_id"), *whole)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bucketed = classes.select("node", F.explode("buckets").alias("bucket"))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    member = materialize(bucketed.join(sizes, "bucket"), "members")
    shape = classes.select("node", "digest", "n_words", "bins")
    texts = _texts(rows, classes.select("node", "digest").join(member, "node", "left_semi").select("digest"))
    links, named = None, member.withColumn("component", F.col("node"))
    for turn in range(ROUNDS):
        # The first round has some of the buckets only: they join most of each group.
        some = named.where(F.pmod("bucket", F.lit(FIRST_OF)) == 0) if turn == 0 else named
        by = F.xxhash64("node", F.lit(turn))  # a hash of one number without collisions
        hub = [F.min_by("node", by).alias("hub"), F.min_by("component", by).alias("hub_component")]
        hubs = some.groupBy("bucket").agg(*hub, F.min("component").alias("low"), F.max("component").alias("high"))
        spokes = some.join(hubs.where("low <> high").drop("low", "high"), "bucket")
        if turn:  # buckets that are joined stay so
            spokes = materialize(spokes, "spokes")
            member = spokes.select("bucket", "node")
        pairs = spokes.where("hub_component <> component").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        found = materialize(verified(_near(pairs.distinct(), shape), texts), "links")
        links = found if links is None else links.unionByName(found)
        named = _named(member, components(links))
    # Buckets whose members are not all joined yet: compare across components.
    low, high = F.min("component").alias("low"), F.max("component").alias("high")
    open_ = named.groupBy("bucket").agg(low, high, F.count("*").alias("n")).where("low <> high").select("bucket", "n")
    left = materialize(named.join(open_, "bucket"), "open")
    small = left.where(F.col("n") <= SMALL)
    pairs = small.alias("x").join(small.alias("y"), "bucket").where("x.node < y.node AND x.component <> y.component")
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = left.where(F.col("n") > SMALL).groupBy("node", "component").agg(F.collect_set("bucket").alias("buckets"))
    large = materialize(large.join(shape.select("node", "digest"), "node"), "large")
    pairs = pairs.unionByName(across(large.join(texts, "digest"), large)).distinct()
    more = _near(pairs, shape)
    final = components(links.unionByName(verified(more, texts)))
    labelled_ = classes.select("node", "digest", "first_id").join(final, "node", "left").select("digest", "first_id", F.coalesce("component", "node").alias("component"))
    heads = labelled_.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("digest", F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("head"))
    of = labelled_.join(heads, "component").select("digest", "class_id", "head")
    return rows.select("doc_id", digest(F.col("text")).alias("digest")).join(of, "digest").select(
        "doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("head"))).alias("kept"), F.col("digest").alias("node")
    )


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``digest, text`` of the wanted digests, once each, stored by digest."""
    found = rows.select(digest(F.col("text")).alias("digest"), "text").join(wanted, "digest", "left_semi")
    found = found.groupBy("digest").agg(F.first("text").alias("text"))
    return materialize_buckets(found, "texts", "digest", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _named(member: DataFrame, part: DataFrame) -> DataFrame:
    named = member.join(part, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    return materialize(named, "named")


def across(left: DataFrame, member: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of ``node, component, text`` of different components that share one of their first words.

    Where the words before are equal too, the pair has met at those. Words from a place on bound what two texts share.
    ``member`` holds the ``buckets`` of each ``node``: one has to be common.
    """
    counts = _counted(left.select("text"), labelled)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                words = [tokens(text, known) for text in some.column(2).to_pylist()]
                first = [first_words(x, counts).view(np.int64) for x in words]
                row = np.repeat(np.arange(len(first)), [len(x) for x in first])
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in first])
                word = np.concatenate(first)
                yield pa.record_batch(
                    [
                        some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(np.array([len(x) for x in words], np.int32)[row]),
                        pa.array(place), pa.array(word), pa.array(np.roll(word, 1), mask=place == 0),
                    ],
                    ["node", "component", "n_words", "place", "word", "before"],
                )

    kind = "node long, component long, n_words int, place int, word long, before long"
    first = materialize(left.select("node", "component", "text").mapInArrow(batches, kind), "first-words")
    x, y = first.alias("x"), first.alias("y")
    longer = F.greatest("x.n_words", "y.n_words")
    shared = F.least(F.col("x.n_words") - F.col("x.place"), F.col("y.n_words") - F.col("y.place"))
    met = (
        (F.col("x.word") == F.col("y.word")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
        & ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False)) & (shared >= longer - _edits(longer))
    )
    pairs = x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    of = lambda name: member.select(F.col("node").alias(name), F.col("buckets").alias(f"{name}_buckets"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.arrays_overlap("a_buckets", "b_buckets"))
    return materialize(both.select("a", "b"), "pairs")


def _edits(longer):
    return F.floor(longer * F.lit(1 - SIMILARITY) + 1e-9)


def _close(x: str, y: str):
    """Bounds that every similar pair meets: word counts, and word counts in bins."""
    longer = F.greatest(F.col(f"{x}n_words"), F.col(f"{y}n_words"))
    edits = _edits(longer)
    apart = F.aggregate(F.zip_with(f"{x}bins", f"{y}bins", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)
    return (F.abs(F.col(f"{x}n_words") - F.col(f"{y}n_words")) <= edits) & (apart <= 2 * edits)


def _near(pairs: DataFrame, shape: DataFrame) -> DataFrame:
    x = shape.select([F.col(c).alias(f"x_{c}") for c in shape.columns])
    y = shape.select([F.col(c).alias(f"y_{c}") for c in shape.columns])
    both = pairs.join(x, F.col("a") == F.col("x_node")).join(y, F.col("b") == F.col("y_node"))
    near = both.where(_close("x_", "y_")).select("a", "b", F.col("x_digest").alias("a_digest"), F.col("y_digest").alias("b_digest"))
    return materialize(near, "near")


def keep_first(docs: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """The documents, with all their columns, without the later ones of each class.

    Of rows that repeat both key and text one stays, the first by its other columns as JSON text.
    """
    heads = groups(docs, key, value).where("kept OR class_id IS NULL").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    heads = materialize(heads, "kept")
    text = F.coalesce(F.col(value), F.lit(""))
    found = docs.withColumn("__digest", digest(text)).join(heads, (F.col("__digest") == F.col("__node")) & F.col(key).cast("long").eqNullSafe(F.col("__id")))
    others = [quoted(c) for c in docs.columns if c != value]
    first = F.min_by(F.struct(*map(quoted, docs.columns)), F.to_json(F.struct(*others)))
    return found.groupBy("__digest", quoted(key).alias("__key")).agg(first.alias("row")).select("row.*")
