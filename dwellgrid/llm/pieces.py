"""SentencePiece ids of whole texts, and back, with a streaming best-path search.

The best path into every place of a text is kept as a backpointer: the piece that ends there. Only places
less than the longest piece behind can still be used, so the window is bounded by it. As soon as the
backpointers of all places in the window lead through one boundary, the ids before it are final: they are
committed and their places forgotten. Blanks are marked with U+2581; a piece never goes on past a letter
into a mark (nor, in most models, between a letter and another sign), so all paths meet at each such place,
and the search commits there at the latest.

What "best" means is the model's: with unigram scores the largest sum of scores, with byte-pair models
(``piece_bpe_32k.model``) the one piece that the merges leave at the end of that prefix, so that the ids
are those of the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.bpe import Pairs
from dwellgrid.llm.common import identified, resident

MARK = "▁"
#: Runs of letters or of other signs, with the marks before them; and runs that end before a mark only.
FINE = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+")
COARSE = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
JOINED = regex.compile(rf"\p{{L}}\P{{L}}|[^\p{{L}}{MARK}]\p{{L}}")
#: Ids of runs up to this length are kept for the next time; longer runs are searched as a stream.
KEPT_WORD = 64
#: States, and bytes of words (each ``WORD`` beside its letters and ids), a worker holds before it begins anew.
STATES, WORD_BYTES, WORD = 200_000, 64 << 20, 200


class Model:
    """Pieces with their scores: ``pieces`` maps a text to (id, score), ``raw`` the 256 byte pieces to ids."""

    def __init__(self, pieces: dict[str, tuple[int, float]], raw: list[int], unknown: int, unigram: bool, prefix: bool = True) -> None:
        self.pieces, self.raw, self.unknown, self.unigram, self.prefix = pieces, raw, unknown, unigram, prefix
        self.longest = max(map(len, pieces), default=1)
        self.pairs = Pairs(tuple, lambda a, b: -pieces[a + b][1] if a + b in pieces else None)
        self.least = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.words: dict[str, tuple[int, ...]] = {}
        self.word_bytes = 0
        # Where no piece joins a letter to another sign, all paths meet between the two.
        self.runs = COARSE if any(map(JOINED.search, pieces)) else FINE
        self.starts = {p[:k] for p in pieces for k in range(len(p) + 1)}
        self._forget()
        self.text = {i: p.encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(raw)}
        self.text[unknown] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str) -> Model:
        """Read a model file; only models that leave the text as it is, but for blanks, are taken."""
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        probe = " ﬁ  Á\t"
        if library.decode(library.encode(probe)) != probe:
            raise ValueError("the model rewrites its text; only models without rewriting are read")
        pieces, raw, n = {}, [0] * 256, library.get_piece_size()
        for i in range(n):
            if library.is_byte(i):
                raw[int(library.id_to_piece(i)[3:-1], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                pieces[library.id_to_piece(i)] = (i, library.get_score(i))
        proto = library.serialized_model_proto()
        scores = [library.get_score(i) for i in range(n) if not library.is_byte(i)][3:]
        unigram = any(s != int(s) for s in scores[:1000])
        return cls(pieces, raw if any(raw) else [], library.unk_id(), unigram, bool(proto) and library.encode("a") != library.encode("\ta")[2:])

    def _forget(self) -> None:
        self.number = {("", (None,)): 0}
        self.states: list[tuple[str, tuple[str | None, ...]]] = [("", (None,))]
        self.steps: list[dict[str, tuple[int, int, tuple[int, ...]]]] = [{}]

    def _spelled(self, letter: str) -> tuple[int, ...]:
        return tuple(self.raw[b] for b in letter.encode()) if self.raw else (self.unknown,)

    def _step(self, state: int, letter: str) -> tuple[int, int, tuple[int, ...]]:
        """Byte-pair models: the state after a letter, and the size and ids of the piece that ends there.

        A state is the longest end of the run that can still begin a piece, with the last piece at each
        of its places: all that later pieces depend on. States are built when first reached.
        """
        tail, places = self.states[state]
        whole, last, size, ids = tail + letter, None, 1, ()
        for begin in range(len(whole)):  # the longest piece that can stand after the piece before it
            piece, before = whole[begin:], places[begin]
            if piece in self.pieces and (self.pairs.stands(piece) if before is None else self.pairs.fits(before, piece)):
                last, size, ids = piece, len(piece), (self.pieces[piece][0],)
                break
        if last is None:
            ids = self._spelled(letter)
        cut = 0
        while whole[cut:] not in self.starts:
            cut += 1
        after = (whole[cut:], (*places, last)[cut:])
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            self.steps.append({})
        self.steps[state][letter] = found = (to, size, ids)
        return found

    def _short(self, word: str) -> tuple[int, ...]:
        """A run that fits the window: one pass forward, one back."""
        if len(self.states) > STATES:
            self._forget()
        state, path, steps = 0, [], self.steps
        for letter in word:
            step = steps[state].get(letter) or self._step(state, letter)
            path.append(step)
            state = step[0]
        out: tuple[int, ...] = ()
        end = len(path)
        while end:
            _, size, ids = path[end - 1]
            out = ids + out
            end -= size
        return out

    def stream(self, letters: Iterator[str] | str) -> Iterator[tuple[int, ...]]:
        """Ids of a run, in committed portions; holds a few windows of the longest piece."""
        if len(self.states) > STATES:
            self._forget()
        ends: list[tuple[int, tuple[int, ...], float]] = []  # of each open place: where its piece began, its ids, the score
        base = at = state = 0  # the last final place, the last place read
        tail, score = "", 0.0  # score: of the path into the final place
        for letter in letters:
            at += 1
            if self.unigram:
                tail = (tail + letter)[-self.longest :]
                before = ends[-1][2] if ends else score
                best = None if letter in self.pieces else (at - 1, self._spelled(letter), before + self.least)
                for size in range(1, min(self.longest, at - base) + 1):
                    found = self.pieces.get(tail[-size:])
                    if found:
                        total = (ends[-size][2] if at - size > base else score) + found[1]
                        if best is None or total > best[2]:
                            best = (at - size, (found[0],), total)
                ends.append(best)
            else:
                state, size, ids = self.steps[state].get(letter) or self._step(state, letter)
                ends.append((at - size, ids, 0.0))
            if at - base >= 4 * self.longest:
                # Paths of the places where later pieces can begin; their last common boundary is final.
                front = set(range(at - self.longest + 1, at + 1))
                while len(front) > 1:
                    far = max(front)
                    front.remove(far)
                    front.add(ends[far - base - 1][0])
                meet = front.pop()
                if meet > base:
                    yield self._path(ends, base, meet)
                    score = ends[meet - base - 1][2]
                    ends = ends[meet - base :]
                    base = meet
        yield self._path(ends, base, at)

    @staticmethod
    def _path(ends: list, base: int, end: int) -> tuple[int, ...]:
        parts = []
        while end > base:
            end, ids, _ = ends[end - base - 1]
            parts.append(ids)
        return tuple(chain.from_iterable(reversed(parts)))

    def word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            short = len(word) <= KEPT_WORD
            found = self._short(word) if short and not self.unigram else tuple(chain.from_iterable(self.stream(word)))
            if short:
                if self.word_bytes >= WORD_BYTES:
                    self.words.clear()
                    self.word_bytes = 0
                self.words[word] = found
                self.word_bytes += WORD + 4 * len(word) + 8 * len(found)
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.prefix:
            marked = MARK + marked
        return list(chain.from_iterable(map(self.word, self.runs.findall(marked))))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def opened(state: tuple) -> Model:
    """The model of a worker process: later tasks of the stage find its words already searched."""

    def build() -> Model:
        pieces, raw, unknown, unigram, prefix = state
        return Model(dict(pieces), list(raw), unknown, unigram, prefix)

    return resident(("pieces", state), build)


def encode(docs: DataFrame, model: str, key: str = "doc_id", value: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, ids, restored`` of every whole text, by the model file at ``model``.

    ``restored`` tells whether decoding the ids gives the text again; it does unless the text holds U+2581
    itself. With ``digest``, ``ids_sha256`` (lowercase hex over the ids as little-endian 32-bit numbers)
    stands in place of ``ids``. The pieces (well under a MB, whatever the input) are shipped once to each
    executor. A null or empty text has no ids; equal or null keys give a row each; other columns are
    ignored; no rows give no rows. Nothing is shuffled.
    """
    own = Model.load(model)
    state = (tuple(own.pieces.items()), tuple(own.raw), own.unknown, own.unigram, own.prefix)
    sent = docs.sparkSession.sparkContext.broadcast(state)
    last = pa.field("ids_sha256", pa.string()) if digest else pa.field("ids", pa.list_(pa.int32()))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = opened(sent.value)
        for part in parts:
            for at in range(0, part.num_rows, 256):  # ids of a few texts at a time
                some = part.slice(at, 256)
                texts = some.column(2).to_pylist()
                ids = [ready.encode(t) for t in texts]
                restored = [ready.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                counts = pa.array([len(i) for i in ids], pa.int64())
                if digest:
                    out = pa.array([hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for i in ids], pa.string())
                else:
                    out = pa.array(ids, last.type)
                yield pa.record_batch(
                    [some.column(0), some.column(1), counts, out, pa.array(restored, pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", last.name, "restored"],
                )

    rows = identified(docs, key, value).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = "ids_sha256 string" if digest else "ids array<int>"
    return rows.mapInArrow(batches, f"doc_id long, n_bytes long, n_tokens long, {kind}, restored boolean")


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` from ``ids``; null ids give the empty text, an id the model lacks an error."""
    own = Model.load(model)
    state = (tuple(own.pieces.items()), tuple(own.raw), own.unknown, own.unigram, own.prefix)
    sent = encoded.sparkSession.sparkContext.broadcast(state)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = opened(sent.value)
        for part in parts:
            texts = [ready.decode(i or []) for i in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(batches, "doc_id long, text string")


def model_path(name: str) -> str:
    """A file of the installed vocabularies; any other path can be given to the operators."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
