"""Personal data, toxicity, web pages and archives."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import html, pii, toxicity, warc
from dwellgrid.session import new_folder


def spans_by_hand(text):
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans(spark):
    rng = random.Random(3)
    signs = list("0123456789@@..--++   ab_%é😀()")
    cases = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    cases += [None, "", "1" * 5000, "a." * 5000 + "@b.c", "4111-1111-1111-1111 é😀a@b.cd,a@b.cd_e@f.gh", "a@b.co " * 700, "0000.1.2.3 00256.1.1.1"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(cases)], "doc_id long, text string, spans int")
    for r in pii.find(docs).collect():
        by_hand = ",".join(spans_by_hand(cases[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(by_hand.encode()).hexdigest(), cases[r.doc_id]


def test_disclosing_words(spark):
    rows = [(i, f"write to kestrel desk at boss@firm.example about the matter number {'abcdefgh'[i]}x") for i in range(8)]
    rows += [(100 + i, "the matter of the desk and the number is about to write at") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert "removed:9:16" in found[0] and "desk" not in found[0] and found[100] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "kestrel" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[8][1]


def test_disclosing_words_far_from_the_value(spark):
    rng = random.Random(13)
    common = ["matter", "desk", "number", "about", "write", "order", "invoice", "letter"]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, f"dear Kestrel {fill(40)} marlin {fill(i * 9)} boss@firm.example {fill(40)} ahead") for i in range(8)]
    rows += [(50 + i, f"heron {fill(30)} one@other.example" if i % 2 else f"heron one@other.example {fill(30)}") for i in range(6)]
    rows += [(100 + i, fill(60)) for i in range(200)] + [(400, rows[0][1])]
    found = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (*range(8), 400):
        assert not re.search("Kestrel|marlin|ahead|boss", found[i]) and "matter" in found[i] and "[EMAIL]" in found[i]
    assert all("heron" not in found[50 + i] and "desk" in found[50 + i] for i in range(6))
    assert all(found[100 + i] == rows[14 + i][1] for i in range(200))


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["vilestword", "nastyinsult", "foulmouthed", "wretchedfool"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(bad) if toxic and rng.random() < 0.08 else rng.choice(plain) for _ in range(90)), "x"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "x"), (5001, "", "x")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if found[i].held_out]
    assert np.mean([found[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert found[5000].predicted == 0 and 0 <= found[5001].score <= 1
    assert toxicity.clean(docs, model).columns == docs.columns
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, known.where("toxic = 0"))).collect()} == {0}


def test_toxicity_of_late_passages(spark, monkeypatch):
    rng = random.Random(14)
    plain = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(3600)]  # more than 20,000 letters
        words += [rng.choice(["vilestword", "nastyinsult"]) if i % 2 and rng.random() < 0.2 else rng.choice(plain) for _ in range(400)]
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    rows += [(next(i for i in range(160) if i % 2 and zlib.crc32(str(i).encode()) % 5), f"again {k}") for k in range(300)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda sample, sizes: (seen.append((sample.count(), sample.select("doc_id").distinct().count())), fit(sample, sizes))[1])
    model = toxicity.train(docs, known)
    assert seen[0][0] == seen[0][1]
    found = [r for r in toxicity.score(docs.where("text NOT LIKE 'again%'"), model).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in found]) > 0.9


def test_pages(spark):
    page = (
        "<html><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id=main><h2>Title &amp; more</h2>"
        "<p>First words\n in it <a href=y>link</a> and other.<p>Second<br>text</div><div class='comments'><p>Great post!</p></div>"
        "<aside>Ads</aside><form><label>Mail</label></form><script>var t='<p>no</p>'</script><footer>(c)</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<article>only")]
    found = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Title & more\nFirst words in it link and other.\nSecond text"
    assert found[2].text == found[3].text == "" and found[None].text == "only" and found[1].n_chars == len(found[1].text)


def test_names_around_the_article():
    tree = html.grow(html.LABELLED)
    body = "<h1>Head</h1><p>The first long paragraph of this page.</p>"
    text = "Head\nThe first long paragraph of this page."
    for page in (
        f"<div class='layout has-sidebar'><article>{body}</article><div class='sidebar'>Ads here</div></div>",
        f"<div class='site no-comments'>{body}</div>",
        f"<div id='search-results'><main>{body}</main></div>",
        f"<form id=aspnet><main>{body}</main></form>",
        f"<div class='promo page'>{body}</div><div class='promo'>Buy it</div>",
        f"<div>{body}</div><div id=comments><article>Nice one</article><article class=comment>So so</article></div>",
        f"<article>{body}<div class='comments'><p>{'Long comment. ' * 40}</p></div></article>",
        f"<article>{body}<div class='related'><a href=x>Another page</a></div></article>",
        f"<main>{body}</main><div hidden>{'never shown ' * 40}</div>",
    ):
        assert html.extract(page, tree) == text, page
    inner = "<article><p>One two.</p><section id='discussion'><p>Three four.</p></section><div class='related work'><p>Five six.</p></div></article>"
    assert html.extract(inner, tree) == "One two.\nThree four.\nFive six."


def test_archive_round_trip(spark):
    trap = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + "y"
    rows = [(1, "u", trap), (2, "u\r\nX: y", trap), (3, None, None), (4, "u", "é" * 60), (5, "u", "é" * 60), (6, "u", "short"), (7, "u", "short")]
    folder = new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    found = {r.page_id: r for r in warc.payloads(warc.read(spark, folder)).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7]
    for i, _, page in rows:
        data = (page or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert found[i].refers_to == {2: 1, 5: 4}.get(i) and found[i].record_type == ("revisit" if i in (2, 5) else "response")
    assert warc.candidates(spark, folder).count() > len(rows) - 1


def test_long_headers_and_broken_chains(spark):
    rows = [(1, "u", "a page"), (2, "u" * 70_000, "another"), (3, "u", "the last")]
    folder = new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    assert sorted(r.page_id for r in warc.payloads(warc.read(spark, folder)).collect()) == [1, 2, 3]
    record = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n".encode()
    one = record(3, "abc")
    assert len(warc._candidates("f", one * 3)) == 3 and warc._candidates("f", b"") == []
    for cut in range(1, len(one)):
        assert len(warc._candidates("f", one + one[:cut])) == 1
    for bad in (one + record(2, "abc") + one, one + b"stray text, no record" + one, one + b"WARC/1.1\r\nX: y\r\n\r\n" + one):
        with pytest.raises(ValueError, match=f"byte {len(one)} "):
            warc._candidates("f", bad)


def test_pointer_jumping_keeps_the_chain_only():
    begin, after = np.array([0, 4, 10, 12, 20]), np.array([10, 12, 20, 15, 30])
    assert warc.reached(begin, after).tolist() == [True, False, True, False, True]
    assert warc.reached(np.array([3]), np.array([9])).tolist() == [False]
    assert gzip.decompress(gzip.compress(b"a")) == b"a"


def test_archives_with_repeated_page_ids(spark, tmp_path):
    a, b, c = "a" * 200, "b" * 150, "c" * 20
    pages = [(1, a), (1, b), (2, a), (3, b), (3, b), (2, c), (1, c), (None, a), (4, None)]
    df = spark.createDataFrame([(k, "http://x/", h, "row") for k, h in pages], "page_id long, url string, html string, digest string")
    warc.write(df, str(tmp_path / "archive"))
    got = warc.payloads(warc.read(spark, str(tmp_path / "archive"))).collect()
    expected = []
    for key, html in pages:
        data = (html or "").encode()
        least = min(k for k, h in pages if h == html and k is not None) if len(data) >= 100 else key
        again = key is not None and key != least
        expected.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_places_of_many_finds(spark):
    """Sums before each element at every block edge, and the places of 40,000 finds in one text."""
    for n in (0, 1, pii.BLOCK, pii.BLOCK + 1, pii.BLOCK**2, pii.BLOCK**2 + 1, 5 * pii.BLOCK**2):
        sizes = [(7 * i) % 5 for i in range(n)]
        found = spark.createDataFrame([(sizes,)], "x array<int>").select(pii.before(F.col("x")).alias("y")).first().y
        assert found == list(accumulate([0, *sizes]))[:-1], n
    parts = ["é" * (i % 3) + f"10.0.{i % 7}.{i % 300} " for i in range(40_000)]
    text = "".join(parts)
    found = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first().s
    wanted, at = [], 0
    for i, part in enumerate(parts):
        if i % 300 <= 255:
            wanted.append(("ip", at + i % 3, at + len(part) - 1, part.strip("é ")))
        at += len(part)
    assert [tuple(s) for s in found if s.kind == "ip"] == wanted
