"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import odd_texts
from tidewatch.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_edit(a, b):
    """Levenshtein distance is one, by the whole table."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute_counts(docs, drop=199, shortest=6, fewest=5):
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= shortest and n >= fewest}


def brute_variants(docs, ratio=5, **keys):
    words = brute_counts(docs, **keys)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and brute_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def drawn(seed):
    """Words with chains of variants of falling frequency, ties, anagrams, accents, and very long ones."""
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(5, 9))) for _ in range(60)] + ["ÀÿÞßéö", "x" * 300, "x" * 301, "y" * 63, "y" * 64, "y" * 65, "÷×÷×÷×"]
    held = []
    for w in base:
        n = draw.choice([5, 30, 200])
        while n >= 1:
            held += [w] * n
            n //= draw.choice([2, 5, 6])
            at = draw.randrange(len(w))
            w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abé") + w[at:], w[:at] + draw.choice("abé") + w[at + 1 :]])
    held += ["".join(draw.sample("listen", 6)) for _ in range(800)]
    draw.shuffle(held)
    docs = [(i, ",".join(w.title() if i % 2 else w for w in held[i::40])) for i in range(40)]
    return docs + [(None, "listen " * 9), (7, "listens 1listen2 " * 3), (7, "listens 1listen2 " * 3), (50, None), (51, ""), (52, "ListenİListenKLISTEN")]


@pytest.fixture(scope="module")
def texts(spark):
    docs = drawn(1)
    return docs, spark.createDataFrame([(i, t, "x", 1, "x") for i, t in docs], "doc_id long, text string, word string, n long, cell string").repartition(3)


def rows_of(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_against_brute_force(texts):
    docs, frame = texts
    expected = brute_variants(docs)
    assert rows_of(spelling.spelling_variants(frame)) == expected
    assert any(f and r != f for _, f, r, _, _, _ in expected)


def test_deleted_letters(texts):
    docs, frame = texts
    assert rows_of(spelling.spelling_variants(frame, drop=2, shortest=4, fewest=2, ratio=2)) == brute_variants(docs, 2, drop=2, shortest=4, fewest=2)


def test_many_and_full_cells(texts, monkeypatch):
    docs, frame = texts
    expected = brute_variants(docs, fewest=1)
    for home, visitors in ((16, 64), (4, 8)):
        monkeypatch.setattr(spelling, "HOME", home)
        monkeypatch.setattr(spelling, "VISITORS", visitors)
        monkeypatch.setattr(spelling, "LEAF", 4)
        assert rows_of(spelling.spelling_variants(frame, fewest=1)) == expected
    monkeypatch.setattr(spelling, "TREE_SAMPLE", 20)
    assert rows_of(spelling.spelling_variants(frame, fewest=1)) == expected


def test_given_documents_odd_and_empty_tables(spark, documents, odd, empty):
    some = documents.filter("doc_id < 150")
    docs = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert rows_of(spelling.spelling_variants(some)) == brute_variants(docs)
    assert rows_of(spelling.spelling_variants(odd)) == brute_variants([r[:2] for r in odd_texts()])
    assert spelling.spelling_variants(empty).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "_PART", 10)
    text = "abcdefgh ijklmnopqrstuvwxyz, ab abcdefghijklmnop"
    parts = list(spelling._parts(text, re.compile("[^a-z]")))
    assert "".join(parts) == text and len(parts) > 1
    assert [w for p in parts for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


def test_trees_find_all_close_pairs_and_look_at_few():
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("etaoinshrdlucmfw") for _ in range(8)) for _ in range(3000)})
    codes = spelling.letter_codes(words)
    counts = [Counter(w) for w in words]
    found = {(i, j) for a, b in spelling.close_pairs(codes, codes, np.full(len(codes), 2)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    for i in draw.sample(range(len(words)), 60):
        apart = [sum(((counts[i] - c) + (c - counts[i])).values()) for c in counts]
        near = {j for j, d in enumerate(apart) if d <= 2}
        assert near <= {j for x, j in found if x == i}
    assert len(found) < 0.05 * len(words) ** 2


def test_one_edit():
    draw = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == brute_edit(a, b)
