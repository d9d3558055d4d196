"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained on ordinary text; each then ends with the words that
set its own class apart in a labelled sample. A text is cut into short windows at blanks, and every
window is compressed with both. Ordinary windows shrink alike; a window that the toxic dictionary
shortens more speaks for toxicity. A logistic curve over the distribution of these differences,
fitted on labelled texts that gave it no words (each half of the sample on the words of the other), turns
them into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import identified, quoted, resident
from dwellgrid.session import materialize

#: Labelled texts per class that the model is fitted on, at most.
SAMPLE = {1: 2000, 0: 3000}
#: Windows of them that the base is trained on, about.
PIECES = 100_000
WINDOW = 48
BASE_BYTES = 1 << 15
OWN_BYTES = 1 << 13
#: A word belongs to a class if it is so many times as frequent in its texts, in so many of them at least.
RATIO, SUPPORT, SUPPORT_SHARE = 20.0, 4, 0.005
#: Beginnings of words of these lengths are terms like whole words, for words that are built from a stem.
STEMS = ()
#: Differences of so many bytes count as hits.
HITS = (1, 2, 3, 4, 6)
LEVEL = 3

OTHER = re.compile(r"[\W_]+")
CUT = re.compile(rb".{1,%d}(?= |$)|.{%d}" % (WINDOW, WINDOW), re.S)


def windows(text: str) -> list[bytes]:
    """Lower-case words between single blanks, cut at blanks; a longer word is cut by length."""
    plain = f" {OTHER.sub(' ', text.lower()).strip()} ".encode()
    return [w + b" " for w in CUT.findall(plain[:-1])]


class Model:
    """Both dictionaries and the curve; a few hundred KB whatever the input."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float], shift: list[float], scale: list[float]) -> None:
        self.state = (toxic, ordinary, tuple(weights), tuple(shift), tuple(scale))
        self.weights, self.shift, self.scale = np.array(weights), np.array(shift), np.array(scale)
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def features(self, text: str) -> np.ndarray:
        return features(text, self.toxic, self.ordinary)

    def score(self, text: str) -> float:
        x = (self.features(text) - self.shift) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + x @ self.weights[1:])))))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=plain)


def features(text: str, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """How the windows' differences are spread: soft maximum, top tenth, top three, mean, hits at each level, length."""
    short, long = toxic.compress, ordinary.compress
    gain = np.sort(np.array([len(long(w)) - len(short(w)) for w in windows(text)], dtype=float))[::-1]
    n = len(gain)
    hits = [int((gain >= h).sum()) for h in HITS]
    return np.array([
        math.log(np.exp(np.minimum(gain, 40) / 2).mean()), gain[: max(1, n // 10)].mean(), gain[:3].mean(), gain.mean(),
        *(h / n for h in hits), *(math.log1p(h) for h in hits), *(min(h, 2) for h in hits), math.log(n),
    ])


def terms(text: str) -> set[str]:
    """The words of a text between blanks, and their beginnings after a blank."""
    found = set(OTHER.sub(" ", text.lower()).split())
    return {f" {w} " for w in found} | {f" {w[:k]}" for w in found for k in STEMS if len(w) > k}


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    shift, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - shift) / scale])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-3] + [1.0] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge @ w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, shift, scale


def _content(own: Counter, other: Counter, n_own: int, n_other: int) -> bytes:
    """Words that set a class apart, the most telling last, that is nearest."""
    least = max(SUPPORT, SUPPORT_SHARE * n_own)
    telling = {}
    for word, count in own.items():
        ratio = ((count + 0.5) / (n_own + 1)) / ((other[word] + 0.5) / (n_other + 1))
        if count >= least and ratio >= RATIO:
            telling[word] = count * math.log(ratio)
    picked, size = [], 0
    for word in sorted(telling, key=lambda w: (-telling[w], w)):
        if size > OWN_BYTES:
            break
        picked.append(word.encode())
        size += len(picked[-1])
    return b"".join(reversed(picked))


def fit(sample: DataFrame, sizes: dict[int, int]) -> Model:
    """Fit on ``doc_id, text, digest, label``, a row for each document; ``sizes``: labelled texts of each class, for the curve's base rate.

    Whole texts are read in tasks. The driver sees keys, term counts, a sample of windows and feature vectors.
    """
    spark = sample.sparkSession
    # Different texts of each class in the order of their keys; every other one is a half.
    turn: dict[int, dict[str, int]] = {0: {}, 1: {}}
    listed = sample.select("doc_id", "digest", "label").collect()
    for _, digest, label in sorted(map(tuple, listed)):
        turn[label].setdefault(digest, len(turn[label]))
    first = {}
    for doc_id, digest, label in sorted(map(tuple, listed)):
        first.setdefault((label, digest), doc_id)
    rows = [(doc_id, label, turn[label][digest]) for (label, digest), doc_id in first.items()]
    places = spark.createDataFrame(rows, "doc_id long, label int, turn int")
    texts = sample.join(F.broadcast(places), ["doc_id", "label"]).select("label", "turn", "text")
    sets = {0: lambda i: i % 2 == 0, 1: lambda i: i % 2 == 1, 2: lambda i: True}  # two halves, all
    n = {(label, k): sum(map(inside, turn[label].values())) for label in turn for k, inside in sets.items()}
    counts = _term_counts(texts)
    lengths = {r["turn"]: r["n"] for r in _window_counts(texts.where("label = 0")).collect()}
    made = [_dictionary(counts, n, k, lengths, sets[k]) for k in sets]
    pieces = _pieces(texts.where("label = 0"), [m[1] for m in made])
    dictionaries = [_contents(own, pieces[k]) if own and n[0, k] else None for k, (own, _) in enumerate(made)]
    vectors = _vectors(texts, dictionaries[:2]).collect() if any(dictionaries[:2]) else []
    x = [r["x"] for r in sorted(vectors, key=lambda r: (r["label"], r["turn"]))]
    y = sorted(r["label"] for r in vectors)
    if dictionaries[2] is None or len(set(y)) < 2:
        width = len(features("", _compressor(b" " * 8), _compressor(b" " * 8)))
        return Model(b" " * 8, b" " * 8, [-30.0] + [0.0] * width, [0.0] * width, [1.0] * width)
    weight = np.array([max(1, sizes[label]) / len(turn[label]) for label in y])
    w, shift, scale = _curve(np.array(x), np.array(y, float), weight * len(weight) / weight.sum())
    return Model(*dictionaries[2], list(w), list(shift), list(scale))


def _term_counts(texts: DataFrame) -> dict[tuple[int, int], Counter]:
    """In how many texts of each class and half the terms stand that enough toxic texts have."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for label, turn, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = list(terms(text))
                same = [pa.array([v] * len(found), pa.int32()) for v in (label, turn % 2)]
                yield pa.record_batch([*same, pa.array(found, pa.string())], ["label", "half", "term"])

    counted = texts.mapInArrow(batches, "label int, half int, term string")
    each = [F.count_if((F.col("label") == label) & (F.col("half") == half)).alias(f"n{label}{half}") for label in (0, 1) for half in (0, 1)]
    out: dict[tuple[int, int], Counter] = {(label, k): Counter() for label in (0, 1) for k in (0, 1, 2)}
    for r in counted.groupBy("term").agg(*each).where(F.col("n10") + F.col("n11") >= SUPPORT).collect():
        for label in (0, 1):
            halves = r[f"n{label}0"], r[f"n{label}1"]
            for k, count in enumerate((*halves, sum(halves))):
                if count:
                    out[label, k][r["term"]] = count
    return out


def _window_counts(texts: DataFrame) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = [len(windows(t)) for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(1), pa.array(sizes, pa.int64())], ["turn", "n"])

    return texts.mapInArrow(batches, "turn int, n long")


def _dictionary(counts, n, k: int, lengths: dict[int, int], inside) -> tuple[bytes, tuple[dict[int, int], int]]:
    """A set's own toxic words, and where its base's windows are: the number before each text, and the stride."""
    own = _content(counts[1, k], counts[0, k], n[1, k], n[0, k])
    begins, total = {}, 0
    for turn in sorted(filter(inside, lengths)):
        begins[turn] = total
        total += lengths[turn]
    return own, (begins, max(1, total // PIECES))


def _pieces(texts: DataFrame, wanted: list[tuple[dict[int, int], int]]) -> list[list[bytes]]:
    """For each set every stride-th window of its texts, in order."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for turn, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = windows(text)
                for k, (begins, stride) in enumerate(sent.value):
                    if turn in begins:
                        some = found[-begins[turn] % stride :: stride]
                        same = [pa.array([v] * len(some), pa.int32()) for v in (k, turn)]
                        yield pa.record_batch([*same, pa.array(range(len(some)), pa.int64()), pa.array(some, pa.binary())], ["k", "turn", "at", "piece"])

    out: list[list[bytes]] = [[] for _ in wanted]
    for r in sorted(texts.mapInArrow(batches, "k int, turn int, at long, piece binary").collect(), key=lambda r: (r["k"], r["turn"], r["at"])):
        out[r["k"]].append(bytes(r["piece"]))
    return out


def _vectors(texts: DataFrame, halves: list[tuple[bytes, bytes] | None]) -> DataFrame:
    """``label, turn, x``: the features of each text with the words of the other half."""
    sent = texts.sparkSession.sparkContext.broadcast(halves)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [half and tuple(map(_compressor, half)) for half in sent.value]
        for part in parts:
            rows = [r for r in zip(*(c.to_pylist() for c in part.columns), strict=True) if tools[1 - r[1] % 2]]
            x = [features(text, *tools[1 - turn % 2]).tolist() for _, turn, text in rows]
            same = [pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1)]
            yield pa.record_batch([*same, pa.array(x, pa.list_(pa.float64()))], ["label", "turn", "x"])

    return texts.mapInArrow(batches, "label int, turn int, x array<double>")


def _contents(own: bytes, pieces: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of both dictionaries."""
    try:
        base = zstandard.train_dictionary(BASE_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        base = b"".join(pieces)[-BASE_BYTES:]
    return base + own, base + b"\0" * len(own)  # the base lies equally far back in both


def ready(state: tuple) -> Model:
    return resident(("toxicity", state), lambda: Model(*state))


def held_out(key) -> F.Column:
    """Documents whose label is never used: crc32 of the key as text, divisible by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", value: str = "text", label: str = "toxic") -> Model:
    """Fit on the labelled documents that are not held out.

    At most ``SAMPLE`` documents per class are used, those with the smallest hash of their key, each with its
    whole text; of repeated keys the row with the smallest text digest. Labels other than 0 and 1 are left
    out; of several labels of a document the largest counts. Without toxic labels every score is 0.
    """
    known = labels.select(quoted(key).cast("long").alias("doc_id"), quoted(label).cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {0: 0, 1: 0} | {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    some = None
    for name, most in SAMPLE.items():
        part = known.where(F.col("label") == name).orderBy(order, "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    rows = identified(docs, key, value).join(F.broadcast(some), "doc_id").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # One row of each document: a labelled key can be repeated in any number of rows.
    one = rows.groupBy("doc_id", "label").agg(F.min("digest").alias("digest"))
    sample = rows.join(F.broadcast(one), ["doc_id", "label", "digest"]).groupBy("doc_id", "label", "digest").agg(F.first("text").alias("text"))
    return fit(materialize(sample.select("doc_id", "text", "digest", "label"), "sample"), sizes)


def score(docs: DataFrame, model: Model, key: str = "doc_id", value: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null and empty texts are scored as one empty window; equal or null keys give a row each; other
    columns are ignored; no rows give no rows. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.state)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ready(sent.value)
        for part in parts:
            scores = [own.score(t) for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = identified(docs, key, value).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(batches, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, key: str = "doc_id", value: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic; rows are kept or go one by one."""
    sent = docs.sparkSession.sparkContext.broadcast(model.state)
    at = docs.columns.index(value)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ready(sent.value)
        for part in parts:
            for begin in range(0, part.num_rows, 256):  # the texts of a few rows at a time beside their batch
                some = part.slice(begin, 256)
                keep = [own.score(t.as_py() or "") < 0.5 for t in some.column(at)]
                yield some.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
