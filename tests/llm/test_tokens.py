"""Token counts and ids against the libraries; streaming search against the full one."""

from __future__ import annotations

import random

import pytest

from dwellgrid.llm import common, pieces, tokens

ODD = list("  \n\t'’ÀÉßΣςİKÅé漢字😀123½_-—<|>!?&$%​　́")


def texts(count: int) -> list[str]:
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = ["", " ", "<|endoftext|> a<|startoftext|>", "x" * 5000, "a b " * 9000, "'s't're LL"]
    for _ in range(count):
        out.append("".join(rng.choice(letters if rng.random() < 0.7 else ODD) for _ in range(rng.randint(0, 120))))
    return out


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = pieces.model_path("word_bpe_49k.json")
    library, cases = Tokenizer.from_file(path), texts(400)
    rows = [(i, t, 1) for i, t in enumerate(cases)] + [(None, None, 1), (0, "again", 1)]
    found = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), path).collect()
    assert len(found) == len(rows)
    by_id = {(r.doc_id, r.n_bytes): r.n_tokens for r in found}
    for i, text in enumerate(cases):
        assert by_id[i, len(text.encode())] == len(library.encode(text, add_special_tokens=False).ids), text
    assert by_id[None, 0] == 0
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_prefix_scan_of_chunk_maps():
    counter = tokens.compiled(open(pieces.model_path("word_bpe_49k.json"), encoding="utf-8").read())
    text = "The quick <|endoftext|> brown fox, 12 times. " * 40 + "z" * 300
    maps = [counter.chunk(text[i : i + 37]) for i in range(0, len(text), 37)]
    ends = counter.scan(maps)
    assert counter.value(ends[-1]) == counter.plain(text)
    assert counter.value(ends[4]) == counter.plain(text[: 37 * 5])


def test_ids_are_the_librarys_and_decode(spark):
    from sentencepiece import SentencePieceProcessor

    path = pieces.model_path("piece_bpe_32k.model")
    library, cases = SentencePieceProcessor(model_file=path), texts(300)
    rows = [(i, t) for i, t in enumerate(cases)] + [(None, None)]
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), path)
    for r in encoded.collect():
        assert r.restored
        assert r.ids == (library.encode(cases[r.doc_id]) if r.doc_id is not None else [])
    back = {r.doc_id: r.text for r in pieces.decode(encoded, path).collect()}
    assert all(back[i] == t for i, t in enumerate(cases))


@pytest.mark.parametrize("seed", range(30))
def test_unigram_stream_finds_the_best_path(seed):
    rng = random.Random(seed)
    own = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)} | {"a", "b"}
    scores = {p: (i, -rng.random() * 10) for i, p in enumerate(sorted(own))}
    model = pieces.Model(scores, [], 99, True)
    text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 200)))
    best = [0.0]
    for j in range(1, len(text) + 1):
        best.append(max(best[k] + scores[text[k:j]][1] for k in range(max(0, j - 4), j) if text[k:j] in scores))
    names = {i: (p, s) for p, (i, s) in scores.items()}
    ids = [i for part in model.stream(text) for i in part]
    assert "".join(names[i][0] for i in ids) == text
    assert sum(names[i][1] for i in ids) == pytest.approx(best[-1])


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    model = pieces.Model.load(pieces.model_path("piece_bpe_32k.model"))
    texts = [f"word{i} andere{i * 7} \u00e9{i}" for i in range(3000)]
    expected = [model.encode(t) for t in texts]
    model.words, model.word_bytes = {}, 0
    monkeypatch.setattr(pieces, "WORD_BYTES", 20_000)
    assert [model.encode(t) for t in texts] == expected
    assert model.word_bytes < 21_000 and len(model.words) < 100


def test_a_worker_holds_one_model(monkeypatch):
    monkeypatch.setattr(common, "_resident", [])
    built = []
    for mark in ("a", "a", "b", "b", "a"):
        assert common.resident((mark, (1, 2)), lambda: built.append(mark) or mark) == mark
    assert built == ["a", "b", "a"] and len(common._resident) == 1
