"""Byte-pair encoding read from left to right.

The encoding of a word by merges has a local test: a row of tokens is the encoding exactly when every
two neighbours, joined and merged again, come out as the same two tokens. So the last token of every
prefix is fixed by the prefix alone, and a word can be read once, symbol by symbol, without a queue of
merges. ``Pairs`` answers the test for two tokens and keeps the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

Symbols = tuple[str, ...]
#: Answers that a worker keeps; beyond this the table is begun anew, which costs time only.
KEPT = 400_000


def merged(symbols: Sequence[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
    parts = list(symbols)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank(parts[i], parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pairs:
    """Whether two tokens can stand side by side in an encoding."""

    def __init__(self, split: Callable[[str], Symbols], rank: Callable[[str, str], float | None]) -> None:
        self.split, self.rank = split, rank
        self.whole: dict[str, bool] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def stands(self, token: str) -> bool:
        """Whether the token's own symbols merge into the token."""
        found = self.whole.get(token)
        if found is None:
            if len(self.whole) >= KEPT:
                self.whole.clear()
            found = self.whole[token] = merged(self.split(token), self.rank) == [token]
        return found

    def fits(self, left: str, right: str) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[left, right] = merged(self.split(left) + self.split(right), self.rank) == [left, right]
        return found
