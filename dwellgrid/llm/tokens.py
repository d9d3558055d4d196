"""Token counts by a compiled finite-state transducer.

A tokenizer of the kind "lower case, split into words, merge inside each word" is compiled into a
deterministic transducer over the symbols of a word. A state holds the longest end of what was read
that can still begin a token, with the last token and the relative count at each place of it: all that
the future depends on. Every transition carries the number of tokens it adds. States are built when
they are first reached, because most of the table is never used; a full table is begun anew.

A text is cut into chunks. A chunk is read without knowing what stands before it: up to its first
boundary (white space before a letter or digit) the count depends on the chunk before, after its last
boundary on the chunk after, and in between it is a number. Such maps compose, and a prefix scan over
them gives the count at every chunk end.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.bpe import KEPT, Pairs
from dwellgrid.llm.common import identified

END = "</w>"
CHUNK = 1 << 15
BOUNDARY = regex.compile(r"(?<=[ \n\r\t])(?=[A-Za-z0-9])")
#: States and transitions a worker holds before it begins anew.
STATES = 150_000
START = ((), ((None, 0),))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 as it is, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Transducer:
    """Counts the tokens of a word; ``count`` keeps whole words, ``run`` reads symbol by symbol."""

    def __init__(self, merges: list[tuple[str, str]], alphabet: list[str]) -> None:
        ranks = {pair: i for i, pair in enumerate(merges)}
        self.pairs = Pairs(self._symbols, lambda a, b: ranks.get((a, b)))
        tokens = {a + b for a, b in merges} | set(alphabet) | {a + END for a in alphabet}
        self.tokens = tokens
        self.starts = {self._symbols(t)[:k] for t in tokens for k in range(1, len(self._symbols(t)) + 1)}
        self.letters = byte_letters()
        self._forget()
        self.words: dict[str, int] = {}

    def _forget(self) -> None:
        self.number = {START: 0}
        self.states = [START]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    @staticmethod
    def _symbols(token: str) -> tuple[str, ...]:
        body, last = (token[: -len(END)], True) if token.endswith(END) and token != END else (token, False)
        out = tuple(body)
        return (*out[:-1], out[-1] + END) if last else out

    def _step(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile one transition: the state after ``symbol`` and the tokens it adds."""
        tail, places = self.states[state]
        whole = (*tail, symbol)
        added = chosen = None
        for begin in range(len(whole)):  # the longest token first
            token = "".join(whole[begin:])
            before, ahead = places[begin]
            if token in self.tokens and (self.pairs.stands(token) if before is None else self.pairs.fits(before, token)):
                chosen, added = token, ahead + 1
                break
        if chosen is None:
            raise ValueError(f"symbol {symbol!r} is not in the alphabet")
        cut = 0
        while cut < len(whole) and whole[cut:] not in self.starts:
            cut += 1
        kept = [*places, (chosen, added)][cut:]
        after = (whole[cut:], tuple((token, ahead - added) for token, ahead in kept))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            self.steps.append({})
        self.steps[state][symbol] = found = (to, added)
        return found

    def run(self, symbols: list[str]) -> int:
        if len(self.states) > STATES:
            self._forget()
        state = total = 0
        for symbol in symbols:
            step = self.steps[state].get(symbol) or self._step(state, symbol)
            state, total = step[0], total + step[1]
        return total

    def count(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += END
            found = self.run(symbols)
            if len(word) <= 64:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = found
        return found


class Counter:
    """Counts the tokens of texts as the library does for the same file."""

    def __init__(self, source: str) -> None:
        data = json.loads(source)
        model = data["model"]
        kinds = [x["type"] for x in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only word-wise BPE with lower case and word ends is compiled")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.word = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in data["added_tokens"]) or r"(?!)")
        self.transducer = Transducer(merges, byte_letters())

    def words(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # letter by letter: no final form
        count = self.transducer.count
        return sum(map(count, self.word.findall(text.lower())))

    def plain(self, text: str) -> int:
        """Tokens of a text that is read whole; strings of special tokens count one each."""
        if "<|" not in text and self.special.search(text) is None:
            return self.words(text)
        pieces = self.special.split(text)
        return sum(map(self.words, pieces)) + len(pieces) - 1

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """The map of a chunk: its open head, the count between its boundaries, its open tail."""
        first = BOUNDARY.search(text)
        if first is None:
            return text, None, ""
        tail = max(self._last(text), first.start())
        return text[: first.start()], self.plain(text[first.start() : tail]), text[tail:]

    @staticmethod
    def _last(text: str) -> int:
        end = len(text)
        while end > 0:
            begin = max(0, end - 256)
            found = [m.start() for m in BOUNDARY.finditer(text, begin, end)]
            if found:
                return found[-1]
            end = begin
        return 0

    def compose(self, a, b):
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2])

    def value(self, a) -> int:
        return self.plain(a[0]) + (0 if a[1] is None else a[1] + self.plain(a[2]))

    def scan(self, maps: list) -> list:
        """Inclusive prefix scan by halves: the map from the text's start to each chunk's end."""
        if len(maps) <= 1:
            return maps
        pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        ends = self.scan(pairs)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(ends[i // 2] if i % 2 else self.compose(ends[i // 2 - 1], maps[i]))
        return out

    def total(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.plain(text)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # only the last value of the scan is asked for: its up-sweep
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.value(maps[0])


@lru_cache(maxsize=2)
def compiled(source: str) -> Counter:
    """The counter of a worker process: later tasks find its states already built."""
    return Counter(source)


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", value: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, by the tokenizer file at ``tokenizer``.

    The file (a few MB, whatever the input) is read by the driver and shipped once to each executor.
    A null or empty text has no tokens; rows with equal or null keys give a row each; other columns are
    ignored; no rows give no rows. Nothing is shuffled.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(source.value)
        for part in parts:
            counts = [counter.total(t) for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = identified(docs, key, value).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
