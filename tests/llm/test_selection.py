"""Hard negatives, resampling and sharding against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import negatives, resampling, sharding

VECTORS = "vec_id long, embedding array<double>, label int, anchor_id string"


def mined(rows):
    """What ``negatives.mine`` must return, with Python integers."""
    usable = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, own, q in usable:
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in usable if i != a and len(v) == len(q)]
        near = sorted((s, i) for s, i, label in scores if label == own)[:5]
        far = sorted((s, i) for s, i, label in scores if label != own)
        for p, positive in near:
            hits = [(s, i) for s, i in far if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def as_mined(spark, rows):
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, size, labels, scale=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = draw.choice(centres)
        v = [scale * (c + draw.gauss(0, 0.7)) for c in centre]
        rows.append((i, v, draw.randrange(labels) if draw.random() < 0.6 else 0, "x"))
    return rows


@pytest.mark.parametrize(("n", "size", "labels", "scale"), [(700, 40, 6, 1.0), (260, 3, 2, 0.01), (300, 20, 3, 3e5)])
def test_negatives_equal_brute_force(spark, n, size, labels, scale):
    rows = vectors(n, n, size, labels, scale)
    assert as_mined(spark, rows) == mined(rows) != []


def test_negatives_with_ties_nulls_and_other_lengths(spark):
    rows = vectors(5, 220, 6, 3)
    rows += [(1000 + i, rows[7][1], 1, "tie") for i in range(30)] + [(2000 + i, rows[8][1], 2, "tie") for i in range(30)]
    rows += [(50, None, 1, ""), (100, [1.0, None], 0, ""), (150, [float("nan")] * 6, 0, ""), (300, [float("inf")] * 6, 0, "")]
    rows += [(3000, [1.0, 2.0], 1, ""), (3001, [1.0, 2.0], 1, ""), (3002, [1.0, 1.0], 2, ""), (3050, [], 1, ""), (3051, [], 2, "")]
    rows += [(None, rows[0][1], 1, ""), (3100, rows[0][1], None, ""), (3150, [0.0] * 6, 1, "")]
    assert as_mined(spark, rows) == mined(rows) != []


def test_negatives_of_nothing_and_of_one_row(spark):
    assert as_mined(spark, []) == []
    assert as_mined(spark, [(50, [1.0], 1, "")]) == []
    assert as_mined(spark, [(1, [1.0], 1, ""), (2, [1.0], 2, "")]) == []
    with pytest.raises(Exception, match="beyond 64 bits"):
        as_mined(spark, [(50, [1e8], 1, ""), (51, [1e8], 1, "")])


def test_repeated_keys_are_rows_that_never_meet(spark):
    rows = [(50, [1.0, 0.0], 1, "")] * 3 + [(51, [1.0, 0.0], 1, "")] * 2 + [(52, [0.8, 0.0], 2, "")] * 2
    assert as_mined(spark, rows) == mined(rows) != []


def test_the_index_leaves_out_what_the_suffix_norms_cover():
    draw = np.random.default_rng(4)
    q, y = (np.floor(100 * draw.normal(size=(n, 48))) for n in (30, 200))
    y[:100, 8:] = 0
    exact = q @ y.T
    for level in (-1e9, 0.0, 2e4, 6e4, 1e9):
        least = np.full(30, level)
        a, b, score = negatives.reaching(q, y, least, np.ones((30, 200), bool))
        wanted = set(zip(*np.nonzero(exact >= level)))
        assert set(zip(a, b)) == wanted and (score == exact[a, b]).all()


# --- resampling ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lowered)


def resampled(docs, target, draw):
    def buckets(text):
        w = words(text)
        runs = [" ".join(w[i : i + n]) for n in range(draw.shortest, draw.longest + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(r.encode()) % draw.buckets for r in runs]

    of = [buckets(text) for _, text in docs]
    source, wanted = Counter(b for x in of for b in x), Counter(b for t in target for b in buckets(t))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + draw.buckets) / ((source[b] + 1) * (t_all + draw.buckets))))
    rows = []
    for (key, text), found in zip(docs, of):
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{draw.seed}:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(found), weight, score, None, len(words(text)) >= draw.least_words])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(drawn[: len(drawn) * draw.percent // 100], 1):
        row[4] = rank
    return sorted(tuple(r[:5]) for r in rows)


def corpus(seed, n):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeXYZ019é中") for _ in range(draw.randint(1, 14))) for _ in range(300)]
    marks = [" ", "  ", ", ", "\n", "-", "_", "\t"]
    return [
        "".join(draw.choice(vocabulary) + draw.choice(marks) for _ in range(draw.randint(0, 90))) for _ in range(n)
    ]


@pytest.mark.parametrize(("shortest", "longest", "piece"), [(1, 1, 1 << 22), (1, 1, 97), (1, 3, 1 << 22), (2, 2, 150)])
def test_resampling_equals_brute_force(spark, monkeypatch, shortest, longest, piece):
    draw = resampling.Draw(buckets=500, shortest=shortest, longest=longest, percent=25)
    docs = list(enumerate(corpus(1, 120))) + [(200, None), (201, ""), (202, "!! ??"), (203, "x" * 900 + " y"), (204, "a b " * 400)]
    target = corpus(2, 15) + [None, ""]
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "LONG", 12)
    counts = resampling.Draw  # the tasks see the patched module only in this process, so the arrays are tried here
    texts = __import__("pyarrow").array([t or "" for _, t in docs])
    got = Counter()
    for _, buckets, _, _ in resampling.pieces(texts, draw):
        got.update(buckets.tolist())
    expected = Counter()
    for _, t in docs:
        w = words(t)
        expected.update(zlib.crc32(" ".join(w[i : i + n]).encode()) % 500 for n in range(shortest, longest + 1) for i in range(len(w) - n + 1))
    assert got == expected and counts is resampling.Draw
    frame = spark.createDataFrame([(k, t, "en", 7) for k, t in docs], "doc_id long, text string, lang string, rank int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resampling.resample(frame, wanted, draw).collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted(resampled(docs, target, draw), key=str)


def test_resampling_of_empty_tables_repeated_and_null_keys(spark):
    schema = "doc_id long, text string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "w " * 30)] * 4 + [(None, "w " * 30)], schema)
    assert resampling.resample(none, none).collect() == []
    rows = resampling.resample(one, none, resampling.Draw(percent=100)).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert len({r["score"] for r in rows if r.doc_id == 1}) == 1


def test_crc_column_by_column():
    draw = random.Random(9)
    parts = [bytes(draw.randrange(1, 256) for _ in range(draw.randint(1, 40))) for _ in range(500)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    got = resampling.crcs(data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


# --- sharding ---


def numbered(spark, n, parts=7):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("slot"))


@pytest.mark.parametrize(("n", "shards", "block"), [(1003, 8, 50), (1000, 3, 10_000), (5, 8, 10), (0, 4, 10), (64, 1, 9)])
def test_shards_are_exact_and_whole(spark, n, shards, block):
    rows = sharding.shuffle(numbered(spark, n), shards, block=block, groups=3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(v == list(range(n // shards + (s < n % shards))) for s, v in slots.items())


def test_the_same_seed_gives_the_same_shards(spark):
    one, two, other = (sharding.shuffle(numbered(spark, 300), 4, seed).select("doc_id", "shard", "slot") for seed in (1, 1, 2))
    assert sorted(one.collect()) == sorted(two.collect()) != sorted(other.collect())


def test_every_place_is_equally_likely(spark):
    """Pairs of neighbours and places over many seeds: no value beyond what chance allows."""
    n, shards, runs = 12, 3, 120
    seen = np.zeros((n, n))
    for seed in range(runs):
        for r in sharding.shuffle(numbered(spark, n, 3), shards, seed, block=3, groups=2).collect() if seed < 12 else []:
            seen[r.doc_id, r.shard * 4 + r.slot] += 1
    assert seen.sum() == 12 * n and (seen.sum(0) == 12).all() and (seen.sum(1) == 12).all() and seen.max() <= 7


def test_the_matrix_has_the_hypergeometric_law():
    rows, columns, runs = [6, 4, 5], [5, 5, 5], 6000
    draw, total = np.random.default_rng(3), np.zeros((3, 3))
    first = Counter()
    for _ in range(runs):
        m = sharding.matrix(draw, rows, columns)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == columns
        total += m
        first[int(m[0, 0])] += 1
    assert np.abs(total / runs - np.outer(rows, columns) / 15).max() < 0.06
    for k, seen in first.items():
        exact = math.comb(5, k) * math.comb(10, 6 - k) / math.comb(15, 6)
        assert abs(seen / runs - exact) < 5 * math.sqrt(exact * (1 - exact) / runs)
    large = [sharding.hypergeometric(draw, 4 * 10**11, 6 * 10**11, 10**9) for _ in range(200)]
    spread = math.sqrt(1e9 * 0.24)
    assert abs(np.mean(large) - 4e8) < 5 * spread / math.sqrt(200) and 0.8 < np.std(large) / spread < 1.2


def test_written_shards_hold_the_rows_in_order(spark, tmp_path):
    sharding.write(numbered(spark, 100), str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 100 and back.groupBy("shard").count().where("count = 25").count() == 4
