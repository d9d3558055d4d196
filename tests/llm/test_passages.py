"""Benchmark passages at every place of a benchmark text."""

from __future__ import annotations

import random

from dwellgrid.llm import alignment, decontamination


def test_passages_at_every_offset():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(60))[:n].strip()
    item = text(233)
    index = decontamination.Index(((7, item), (8, text(240)), (9, "short one of a few words")))
    body = text(300)
    for size in (100, 101, 120, 132, 149):
        quotes = [item[at : at + size] for at in range(len(item) - size + 1)]
        assert index.search([f"{body} {q} {body}".encode() for q in quotes]) == [[7]] * len(quotes)
    changed = [f"{body} {item[at : at + 50]}##{item[at + 52 : at + 104]} {body}".encode() for at in range(len(item) - 104)]
    assert index.search(changed) == [[7]] * len(changed)
    assert index.search([f"{item[at : at + 80]}".encode() for at in range(150)]) == [[]] * 150
    assert index.search([item[60:160].encode(), b"", b"a short one of a few words"]) == [[7], [], [9]]


def test_passages_like_brute_force():
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip()
    items = tuple((i, text(rng.choice([30, 90, 130, 180]))) for i in range(12))
    index = decontamination.Index(items)
    docs = []
    for _ in range(40):
        plain = decontamination.plain(rng.choice(items)[1]).decode()
        at = rng.randrange(max(1, len(plain) - 90))
        part = "".join(rng.choice(["", c + "e", "e"]) if rng.random() < rng.choice([0.03, 0.08, 0.1]) else c for c in plain[at : at + rng.randint(90, 130)])
        docs.append(decontamination.plain(text(60) + part + text(60)))
    for doc, found in zip(docs, index.search(docs), strict=True):
        wanted = []
        for i, (item, edits) in enumerate(zip(index.texts, index.edits.tolist())):
            size = min(100, len(item))
            if any(alignment.inside(item[s : s + size], doc) <= edits for s in range(len(item) - size + 1)):
                wanted.append(index.owner[i])
        assert sorted(found) == wanted
