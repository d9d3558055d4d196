"""Benchmark passages in documents, by the q-gram lemma.

Every ``PASSAGE`` bytes of a benchmark text, from any byte on, are a passage (a shorter text is one
passage). A passage of m bytes that occurs in a document with at most k edits shares at least
(m - q + 1) - k q of its q-grams with it, and all of them on k + 1 neighbouring diagonals. So the shared
q-grams of a document and a benchmark text are counted in overlapping bands of diagonals, and only the
passages that meet this bound in a band are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.alignment import inside
from dwellgrid.llm.common import identified, quoted

#: Bytes of a q-gram, 8 to 16.
Q = 10
#: Bytes of the grams that passages are looked through with before they are aligned.
FINE = 4
PASSAGE = 100
#: Edits that a passage may differ by, as a share of its bytes.
EDITS = 0.08
#: Bytes of benchmark texts that one pass over the documents looks for; larger benchmarks take more passes.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are looked at together.
PORTION = 1 << 20
HASH_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> bytes:
    """Lower case, white space as single blanks: what is compared."""
    return " ".join(text.lower().split()).encode()


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each place, as a number: its first and last eight bytes, mixed (alignment settles what collides)."""
    n = len(data) - 8 + 1
    if n <= Q - 8:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        part = np.frombuffer(data, "<u8", count=(len(data) - r) // 8, offset=r)
        out[r::8] = part[: len(out[r::8])]
    return out[: n - (Q - 8)] * MIX + out[Q - 8 :]


class Index:
    """A block of benchmark texts and where each q-gram lies in them."""

    def __init__(self, items: tuple[tuple[int, str], ...]) -> None:
        kept = [(item, data) for item, text in items if len(data := plain(text)) >= Q]
        self.owner = [item for item, _ in kept]
        self.texts = [data for _, data in kept]
        self.width = np.minimum(np.array([len(t) for t in self.texts], np.int64), PASSAGE)
        self.edits = np.minimum((EDITS * self.width).astype(np.int64), (self.width - Q) // Q)
        self.bound = self.width - Q + 1 - self.edits * Q
        keys = [grams(t) for t in self.texts]
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        where = [np.arange(len(k)) + (i << 32) for i, k in enumerate(keys)]
        order = np.argsort(flat, kind="stable")
        self.where = (np.concatenate(where) if where else np.empty(0, np.int64))[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << HASH_BITS, bool)
        self.known[self._hash(self.keys)] = True

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return (keys * MIX) >> np.uint64(64 - HASH_BITS)

    def search(self, texts: list[bytes]) -> list[list[int]]:
        """For each text the benchmark keys of the texts of which it holds a passage."""
        out: list[list[int]] = [[] for _ in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a line end between texts: no passage holds one
        data = b"\n".join(texts)
        keys = grams(data)
        place = np.flatnonzero(self.known[self._hash(keys)])
        if not len(place) or not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys[place]), len(self.keys) - 1)
        hit = self.keys[at] == keys[place]
        place, at = place[hit], at[hit]
        many = self.count[at]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        post = self.where[np.repeat(self.first[at], many) + inner]
        place = np.repeat(place, many)
        item, offset = post >> 32, post & 0xFFFFFFFF
        # Too few shared q-grams in the whole text: no band can meet the bound.
        pair = (np.searchsorted(starts, place, side="right") - 1) * len(self.texts) + item
        names, of, total = np.unique(pair, return_inverse=True, return_counts=True)
        enough = (total >= self.bound[names % len(self.texts)])[of]
        pair, item, offset, place = pair[enough], item[enough], offset[enough], place[enough]
        if not len(pair):
            return out
        band = np.floor_divide(place - offset, self.edits[item] + 1)
        order = np.lexsort((offset, band, pair))
        pair, band, offset = pair[order], band[order], offset[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]))
        last = np.append(first[1:], len(pair))
        joins = np.append((pair[first[1:]] == pair[first[:-1]]) & (band[first[1:]] == band[first[:-1]] + 1), False)
        stop = np.where(joins, np.append(last[1:], len(pair)), last)  # a band is looked at with the next one
        wide = np.flatnonzero(stop - first >= self.bound[pair[first] % len(self.texts)])
        found, letters = -1, np.frombuffer(data, np.uint8)
        for b in wide.tolist():
            name = int(pair[first[b]])
            if name == found:
                continue
            d, i = divmod(name, len(self.texts))
            text = letters[starts[d] : starts[d] + sizes[d]]
            low = int(band[first[b]]) * (int(self.edits[i]) + 1) - int(starts[d])
            if self._holds(i, np.unique(offset[first[b] : stop[b]]), low, text):
                found = name
                out[d].append(self.owner[i])
        return out

    def _holds(self, i: int, offset: np.ndarray, low: int, text: np.ndarray) -> bool:
        """Whether a passage of item ``i``, at any place of it, lies in ``text`` along the two bands that begin at diagonal ``low``.

        ``offset``: where in the item the q-grams stand that both share in these bands, each once. Only passages
        with as many of them as the bound asks for are looked at. Shorter grams, of ``FINE`` bytes, on all
        diagonals that such an alignment can touch rule out most of them by the same lemma; the others are
        aligned, those that share most first.
        """
        item, width, edits, bound = self.texts[i], int(self.width[i]), int(self.edits[i]), int(self.bound[i])
        if len(offset) < bound:
            return False
        begin, end = offset[: len(offset) - bound + 1], offset[bound - 1 :]
        near = end - begin <= width - Q
        lows, highs = np.maximum(end[near] - (width - Q), 0), np.minimum(begin[near], len(item) - width)
        # Both ascend: passages from each low to its high, runs that touch taken together.
        if not len(lows):
            return False
        new = np.flatnonzero(np.concatenate([[True], lows[1:] > highs[:-1] + 1]))
        for start, stop in zip(lows[new].tolist(), highs[np.append(new[1:], len(highs)) - 1].tolist()):
            part = np.frombuffer(item, np.uint8)[start : stop + width]
            shift = np.arange(low - edits, low + 2 * (edits + 1) + edits)
            at = np.arange(start, stop + width)[None, :] + shift[:, None]
            inner = (at >= 0) & (at < len(text))
            same = inner & (text[np.where(inner, at, 0)] == part[None, :]) if len(text) else inner
            size = len(part) - FINE + 1
            runs = same[:, :size].copy()
            for k in range(1, FINE):
                runs &= same[:, k : k + size]
            total = np.concatenate([[0], np.cumsum(runs.any(axis=0))])
            shared = total[width - FINE + 1 :] - total[: -(width - FINE + 1)]
            likely = np.flatnonzero(shared >= width - FINE + 1 - edits * FINE)
            for s in (likely[np.argsort(-shared[likely], kind="stable")] + start).tolist():
                left, right = max(0, s + low - edits), s + low + 2 * (edits + 1) + width + edits
                if inside(item[s : s + width], text[left : max(left, right)].tobytes()) <= edits:
                    return True
        return False


@lru_cache(maxsize=2)
def indexed(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(items)


def blocks(benchmark: DataFrame, key: str, value: str) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark in blocks of bounded size, each brought to the driver on its own."""
    items = identified(benchmark, key, value).where("doc_id IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for b in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)) == b)
        yield tuple(sorted((r["doc_id"], r["text"]) for r in part.collect()))


def mark(docs: DataFrame, benchmark: DataFrame, value: str = "text", key: str = "item_id", passage: str = "text", name: str = "items") -> DataFrame:
    """The documents with a column ``items``: the sorted keys of the benchmark texts of which they hold a passage.

    Null and empty texts hold none. Benchmark texts of fewer than ``Q`` bytes, null ones and null keys are not
    looked for; repeated ones count once. Rows stay rows, whatever their other columns; no rows give no rows.
    An empty benchmark gives empty lists. Nothing is shuffled; a pass over the documents looks for one block.
    """
    out = docs.withColumn(name, F.array().cast("array<bigint>"))
    at, to = docs.columns.index(value), len(docs.columns)
    for items in blocks(benchmark, key, passage):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        out = out.mapInArrow(_pass(sent, at, to), out.schema)
    return out


def _pass(sent, at: int, to: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = indexed(sent.value)
        for part in parts:
            texts = [plain(t or "") for t in part.column(at).to_pylist()]
            found: list[list[int]] = []
            begin = size = 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size >= PORTION or end == len(texts):
                    found += index.search(texts[begin:end])
                    begin, size = end, 0
            lists = [sorted({*(old or []), *new}) for old, new in zip(part.column(to).to_pylist(), found, strict=True)]
            columns = [*part.columns[:to], pa.array(lists, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, schema=part.schema)

    return batches


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """``doc_id, contaminated, n_items, items`` of every document."""
    found = mark(docs.select(quoted(key).cast("long").alias("doc_id"), quoted(value).alias("text")), benchmark)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, value: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    name = "__items"
    return mark(docs, benchmark, value, name=name).where(F.size(name) == 0).drop(name)
