"""Near copies, repeated strings, vectors and benchmark passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from dwellgrid.llm import alignment, decontamination, embeddings, near_copies, substrings


def distance(a, b, free=False):
    p = list(range(len(a) + 1))
    best = p[-1]
    for j, y in enumerate(b, 1):
        c = [0 if free else j]
        for i, x in enumerate(a, 1):
            c.append(min(p[i] + 1, c[-1] + 1, p[i - 1] + (x != y)))
        p, best = c, min(best, c[-1])
    return best if free else p[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        b = [x for x in a if rng.random() < 0.9] if rng.random() < 0.6 else [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        limit, d = rng.randint(0, 25), distance(a, b)
        assert alignment.banded(a, b, limit) == (d if d <= limit else None)
        assert alignment.inside(a, b) == distance(a, b, True)


def test_near_copies(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows, group = [], {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for k in range(rng.choice([1, 2, 5])):
            copy = [rng.choice(words) if k and rng.random() < 0.03 else w for w in base]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), g))
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, "", 0), (None, rows[0][1], 0), (1003, "one two", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    found = {r.doc_id: r for r in near_copies.groups(docs).collect()}
    assert len(found) == len(rows)
    for i, g in group.items():
        assert found[i].class_id == min(j for j, h in group.items() if h == g)
    assert found[1000].class_id == 0 and not found[1000].kept and found[None].class_id == 0
    assert found[1001].class_id == found[1002].class_id == 1001 and found[1003].kept
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found.values() if r.kept)


def strings_by_hand(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        left = bytes(x for x, m in zip(b, mark) if not m)
        spans = sum(1 for j in range(len(b)) if mark[j] and (j == 0 or not mark[j - 1]))
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [5, 1000])
def test_repeated_strings(spark, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (99, 100, 101, 130, 400)]
    rows = []
    for i in range(80):
        fill = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150)))
        rows.append((i, "".join(rng.choice([rng.choice(passages), fill(), "a" * rng.randint(0, 250)]) for _ in range(rng.randint(0, 6)))))
    rows += [(1000 + i, rows[3 * i][1]) for i in range(10)] + [(2000, None), (2001, ""), (None, passages[4] * 2)]
    found = substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == strings_by_hand(rows)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(20, 64)), 12, 0) + rng.normal(size=(240, 64)) * 0.25
    x[5] = x[4]
    near = (u := x / np.linalg.norm(x, axis=1)[:, None]) @ u.T >= 0.9
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (None, [1.0] * 64)]
    found = {r.vec_id: r for r in embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links, wanted = sum(found[i].n_links for i in range(240)), int(near.sum()) - 240
    assert 0.99 * wanted <= links <= wanted
    group = list(range(240))
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert np.mean([found[i].component_id == group[i] for i in range(240)]) > 0.99
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in (900, 901, 902)) and not found[None].kept


def test_short_pairs_share_a_segment():
    rng, known = random.Random(8), near_copies.Hashes()
    keys = lambda words: set(near_copies.keys(near_copies.tokens(" ".join(words), known)).tolist())
    for _ in range(3000):
        a = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, near_copies.SHORT))]
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["x"], ["y"]])
        longer = max(len(a), len(b))
        if a != b and longer <= near_copies.SHORT and distance(a, b) <= near_copies.limit(longer):
            assert keys(a) & keys(b), (a, b)


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.97), (0.85, 0.99), (0.9, 0.99)])
def test_recall_of_candidates(similarity, least):
    rng, known = random.Random(9), near_copies.Hashes()
    words = [f"w{i}" for i in range(3000)]
    for n in (25, 40, 100, 200):
        hits = []
        for _ in range(300):
            a = [rng.choice(words) for _ in range(n)]
            b = list(a)
            for at in rng.sample(range(n), int(n * (1 - similarity) + 1e-9)):
                b[at] = "x" + rng.choice(words)
            one, other = (near_copies.keys(near_copies.tokens(" ".join(t), known)) for t in (a, b))
            hits.append(bool(set(one.tolist()) & set(other.tolist())))
        assert np.mean(hits) >= least, n


def test_short_copies(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    rows = []
    for n in (5, 6, 7, 10, 13, 15, 18, 20, 22, 24, 27):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            near = list(base)
            for at in rng.sample(range(n), n // 5):
                near[at] = "x" + near[at]
            far = list(base)
            for at in rng.sample(range(n), n // 5 + 1):
                far[at] = "y" + far[at]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near)), (len(rows) + 2, " ".join(far))]
    found = {r.doc_id: r.class_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t.split() for _, t in rows]
    for i in range(0, len(rows), 3):
        joined = distance(texts[i + 1], texts[i + 2]) <= near_copies.limit(len(texts[i]))
        assert found[i + 1] == i and found[i + 2] == (i if joined else i + 2)


def test_benchmark_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(15, 60))) for i in range(20)] + [(50, None), (51, "abc"), (None, "x" * 200)]
    rows, wanted = [], {}
    for i in range(120):
        body, truth = text(200), set()
        if i % 3 == 0:
            item, passage = items[rng.randrange(20)]
            if i % 2:
                passage = "".join(c if rng.random() > 0.02 else "z" for c in passage)
            body, truth = body[:400] + "\n" + passage + " " + body[400:], {item}
        rows.append((i, body, "x"))
        wanted[i] = truth
    rows.append((500, None, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: set(r["items"]) for r in decontamination.report(docs, bench).collect()}
    assert found == wanted | {500: set()}
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, t in found.items() if not t}


def test_short_texts_with_a_common_stretch(spark):
    """Many short texts share most of their words: their buckets stay small, and every similar pair is found."""
    rng = random.Random(11)
    stretch = [f"s{i}" for i in range(12)]
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(400):
        other = [rng.choice(words) for _ in range(8)]
        at = rng.randrange(9)
        rows.append((len(rows), " ".join(other[:at] + stretch + other[at:])))
    for i in range(0, 60, 2):  # four of twenty words changed: similar
        near = rows[i][1].split()
        for at in rng.sample(range(20), 4):
            near[at] = "x" + rng.choice(words)
        rows.append((len(rows), " ".join(near)))
    rows += [(5000, rows[0][1]), (5001, ""), (5002, None)]
    texts = [(t or "").split() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            longer = max(len(texts[i]), len(texts[j]))
            if texts[i] == texts[j] or alignment.banded(texts[i], texts[j], near_copies.limit(longer)) is not None:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_copies.groups(docs).collect()}
    assert [found[i] for i, _ in rows] == [rows[g][0] for g in group]
    known, counts = near_copies.Hashes(), near_copies.word_counts(docs.fillna("", ["text"]))
    sizes: dict[int, int] = {}
    for words_ in texts:
        for key in near_copies.rare(near_copies.tokens(" ".join(words_), known), counts).tolist():
            sizes[key] = sizes.get(key, 0) + 1
    assert sum(n * (n - 1) // 2 for n in sizes.values()) < 20 * len(rows)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node int")
    assert near_copies.groups(docs).count() == 0 and near_copies.keep_first(docs).count() == 0


def test_repeated_keys_keep_the_least_row(spark):
    rows = [(1, "one two three", 7), (1, "one two three", 5), (1, "four five", 9), (2, "four five", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    assert {tuple(r) for r in near_copies.keep_first(docs).collect()} == {(1, "one two three", 5), (1, "four five", 9)}


@pytest.mark.parametrize("size", [64, 384, 768])
def test_recall_of_wide_vectors(size):
    """Pairs at the threshold itself, the hardest ones, share a bucket whatever the dimension."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = embeddings.COSINE * x + np.sqrt(1 - embeddings.COSINE**2) * away
    one, other = embeddings.buckets(x), embeddings.buckets(y)
    assert np.mean([bool(set(a) & set(b)) for a, b in zip(one.tolist(), other.tolist())]) >= 0.95


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (3, 64, 200, 768):
        for _ in range(10):
            v = rng.normal(size=size)
            rows += [(len(rows), v.tolist()), (len(rows) + 1, (v * 2 + rng.normal(size=size) * 0.02).tolist())]
    rows += [(900, [1.0, None]), (901, [float("inf"), 1.0]), (902, [])]
    found = {r.vec_id: r for r in embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [np.array(v) / np.linalg.norm(v) for _, v in rows[:80]]
    for i in range(80):
        near = [j for j in range(80) if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.9]
        assert found[i].n_links == len(near)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (900, 901, 902))
    assert embeddings.near_copies(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_long_texts_with_a_common_passage(spark, monkeypatch):
    """Many long texts share most of their words, but too few to be similar: few pairs are made, the similar ones are found."""
    rng = random.Random(12)
    passage = [f"s{i}" for i in range(110)]
    words = [f"w{i}" for i in range(20_000)]
    rows = []
    for _ in range(300):
        other = [rng.choice(words) for _ in range(40)]
        at = rng.randrange(41)
        rows.append((len(rows), " ".join(other[:at] + passage + other[at:])))
    for i in range(0, 60, 2):  # 30 of 150 words changed: similar
        near = rows[i][1].split()
        for at in rng.sample(range(150), 30):
            near[at] = "x" + rng.choice(words)
        rows.append((len(rows), " ".join(near)))
    made, stored = {}, near_copies.materialize

    def counted(df, label):
        table = stored(df, label)
        made.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(near_copies, "materialize", counted)
    found = {r.doc_id: r.class_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t.split() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alignment.banded(texts[i], texts[j], 30) is not None:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert [found[i] for i in range(len(rows))] == group
    assert sum(made["pairs"]) < 10 * len(rows)
