"""Importance resampling towards a target, on hashed word counts.

Features are runs of consecutive words. Their bucket is the CRC-32 of their bytes modulo the number of
buckets. The CRCs of a block of texts are worked out together: distinct features of equal length are
the rows of a two-dimensional array of bytes, the CRCs of all rows go on column by column, and the buckets are
scattered back to where the features stood.

A bucket's gain is the logarithm of how much more frequent it is in the target texts than in the source, in
thousandths and smoothed by one. A document's weight is the floored mean of the gains of its features. Gumbel noise
from the key makes the highest scores a draw without replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import identified, quoted
from dwellgrid.operators.ranking import ranked

#: Bytes of text that a task holds as arrays at once; a longer text is cut between words.
PIECE = 1 << 22
#: Features longer than this go through the library's CRC one by one: there are few, and each is a long column loop.
LONG = 512


@dataclass(frozen=True)
class Draw:
    """``shortest`` to ``longest`` words make a feature; ``percent`` of the texts with ``least_words`` are drawn."""

    buckets: int = 10_000
    shortest: int = 1
    longest: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> 1), value >> 1)
    return value


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches of ``data``: distinct ones of equal length together."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    cuts = [0, *(np.flatnonzero(np.diff(ordered)) + 1).tolist(), len(order)]
    for low, high in zip(cuts, cuts[1:]):
        if low == high:
            continue
        places, size = order[low:high], int(ordered[low])
        if size > LONG:
            out[places] = [zlib.crc32(data[at : at + size]) for at in starts[places].tolist()]
            continue
        step = max(1, PIECE // size)  # features of several words overlap, so their bytes may exceed the text's
        for at in range(0, len(places), step):
            some = places[at : at + step]
            rows = data[starts[some][:, None] + np.arange(size)]
            if size <= 8:
                packed = np.zeros((len(rows), 8), np.uint8)
                packed[:, :size] = rows
                keys = packed.view(np.uint64).ravel()
            else:  # no feature holds a zero byte, so strings compare whole
                keys = rows.view(f"S{size}").ravel()
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            out[some] = crc_rows(rows[first])[back]
    return out


def words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts that begin at ``begins``: joined by single blanks; start, length and text of each."""
    data = LOWER[data]
    inside = IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[begins[begins < len(data)]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    opens = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    closes = np.flatnonzero(inside & (~after | cut[1:])) + 1
    lengths = closes - opens
    starts = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[inside]
    return joined, starts, lengths, np.searchsorted(begins, opens, "right") - 1


def features(data: np.ndarray, begins: np.ndarray, draw: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each feature, and the text of each word."""
    joined, starts, lengths, text = words_of(data, begins)
    buckets, owners = [], []
    for size in range(draw.shortest, draw.longest + 1):
        last = np.arange(size - 1, len(starts))
        first = last - (size - 1)
        whole = text[first] == text[last]
        first, last = first[whole], last[whole]
        spans = starts[last] + lengths[last] - starts[first]
        buckets.append(crcs(joined, starts[first], spans).astype(np.int64) % draw.buckets)
        owners.append(text[first])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *buckets]), np.concatenate([none, *owners]).astype(np.int64), text


def pieces(texts: pa.Array, draw: Draw) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts as (row of each text, buckets, texts, texts of words).

    A text beyond ``PIECE`` bytes comes in several blocks. They are cut before a word, and each but the first
    begins with the words that features across the cut need; those are not counted again.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, "right")) - 1)
        if end > row + 1 or ends[row + 1] - ends[row] <= PIECE:
            begins = ends[row:end] - ends[row]
            yield np.arange(row, end), *features(data[ends[row] : ends[end]], begins, draw)
        else:
            yield from _long(data[ends[row] : ends[row + 1]], row, draw)
        row = end


def _long(data: np.ndarray, row: int, draw: Draw) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    kept, at, begin = draw.longest - 1, 0, np.zeros(1, np.int64)
    carry = np.empty(0, np.uint8)  # the last words of the piece before, each with a blank
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and IN_WORD[LOWER[data[stop]]]:
            space = np.flatnonzero(~IN_WORD[LOWER[data[stop : stop + PIECE]]])
            stop += int(space[0]) if len(space) else min(PIECE, len(data) - stop)
        buckets, owners, text = features(np.concatenate([carry, data[at:stop]]), begin, draw)
        again = features(carry, begin, draw)
        count = np.bincount(buckets, minlength=draw.buckets) - np.bincount(again[0], minlength=draw.buckets)
        buckets = np.repeat(np.arange(draw.buckets), count)
        fresh = len(text) - len(again[2])
        yield np.array([row]), buckets, np.zeros(len(buckets), np.int64), np.zeros(fresh, np.int64)
        if kept:
            joined, starts, _, _ = words_of(np.concatenate([carry, data[at:stop]]), begin)
            carry = joined[starts[-kept] :] if len(starts) > kept else joined
        at = stop


def histogram(texts: DataFrame, draw: Draw = Draw(), value: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts. The driver receives one number per bucket."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for part in parts:
            for _, buckets, _, _ in pieces(part.column(0), draw):
                total += np.bincount(buckets, minlength=draw.buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    whole = texts.select(F.coalesce(quoted(value), F.lit("")).alias("text"))
    counted = whole.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(draw.buckets, np.int64)
    for row in counted.toLocalIterator():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    shares = ((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in shares], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, draw: Draw = Draw(), key: str = "doc_id", value: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row, in one pass without a shuffle."""

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_words, n_features, sums = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for rows, buckets, owners, of_words in pieces(part.column(1), draw):
                n_words[rows] += np.bincount(of_words, minlength=len(rows))
                n_features[rows] += np.bincount(owners, minlength=len(rows))
                np.add.at(sums, rows[owners], gain[buckets])
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            yield pa.record_batch(
                [part.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return identified(docs, key, value).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, draw: Draw = Draw(), key: str = "doc_id", value: str = "text", target_value: str = "text"
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; undrawn rows have no rank.

    Counts and gains are those of all texts of both tables. Null and empty texts have no features and weight 0.
    A row with a null key is scored as the text ``<seed>:`` would be and comes last among equal scores. Rows that
    repeat a key are rows of their own and share their noise; which of two rows equal in key and score comes
    first is open. An empty target has gains from the smoothing alone. No documents give no rows. Other columns are ignored.
    """
    gain = gains(histogram(docs, draw, value), histogram(target, draw, target_value))
    found = weights(docs, gain, draw, key, value)
    name = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    enough = F.col("n_words") >= draw.least_words
    scored = found.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), enough.alias("_in"))
    # Those that cannot be drawn follow the others, so that one pass ranks all rows.
    placed = ranked(scored, [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    drawn = placed.where("_in").count() * draw.percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
