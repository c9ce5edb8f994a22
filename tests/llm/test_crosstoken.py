"""Operator 13 against the tokenizers themselves and brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import odd_texts
from tidewatch.llm import crosstoken

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def tools():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B), byte_of()


def brute(docs, tools):
    first, second, alphabet = tools
    held, counts = [], Counter()
    for i, text in docs:
        found = first.encode(" " + (text or ""), add_special_tokens=False)
        a = [(t, bytes(alphabet[c] for c in first.id_to_token(t))) for t in found.ids]
        b = []
        for t in second.encode(text or ""):
            name = second.id_to_piece(t)
            b.append((t, bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode()))
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            held.append((i, None, None, None))
            continue
        ends = [np.cumsum([0, *[len(x) for _, x in side]]).tolist() for side in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        pairs, groups, x, y = [], [], 0, 0
        for cut in common[1:]:
            at_a, at_b = x, y
            while ends[0][x] < cut:
                x += 1
            while ends[1][y] < cut:
                y += 1
            groups.append((range(at_a, x), range(at_b, y)))
            for p in range(at_a, x):
                for q in range(at_b, y):
                    if max(ends[0][p], ends[1][q]) < min(ends[0][p + 1], ends[1][q + 1]):
                        pairs.append((a[p][0], b[q][0]))
        counts.update(pairs)
        text = ";".join(",".join(str(a[p][0]) for p in left) + "|" + ",".join(str(b[q][0]) for q in right) for left, right in groups)
        held.append((i, (len(a), len(b), len(groups)), pairs, text))
    best = Counter()
    for (_, t), n in counts.items():
        best[t] = max(best[t], n)
    out = Counter()
    for i, sizes, pairs, text in held:
        if sizes is None:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            out[(i, *sizes, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


ODD = [
    "a  b   c    d", " lead", "  two lead", "trail ", "trail   ", " ", "   ", "\n", "x\ny z\r\n\tq", "▁", "a ▁ b", "a▁ b", "tab\t here", "no break space", "wide　space x", "nul \x00 x",
    "日本語 テキスト と 漢字", "emoji \U0001f600\U0001f600 x", "<s> </s> <unk> <|endoftext|> <0x41>", "don't we'll 'tis", "١٢٣ x 12345", "é combining", "ﬁ ligature ①", " line x", "a\x1cb \x1c c", "ﷺ x", "﻿ bom",
]


def drawn(seed):
    draw = random.Random(seed)
    words = ["the", "of", "Étage", "naïve", "x1", "日本", "\U0001f600", "don't", "...", "\n", "", "", "internationalization", "0x41", "▲"]
    return [(100 + i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 200)))) for i in range(60)]


def frame_of(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, "x") for i, t in docs], "doc_id long, text string, key string, id long, a string").repartition(3)


def found(frame, **keys):
    return Counter(map(tuple, crosstoken.align_tokenizers(frame, A, B, **keys).collect()))


def test_alignment_against_brute_force(spark, tools):
    docs = list(enumerate(ODD)) + drawn(1) + [(None, "the same"), (7, "the same"), (7, "the same"), (8, None), (9, "")]
    assert found(frame_of(spark, docs)) == brute(docs, tools)


@pytest.mark.parametrize("size", [7, 40])
def test_ranges_of_any_size_give_the_same(spark, tools, size, monkeypatch):
    docs = list(enumerate(ODD)) + drawn(2) + [(0, "q" * 500), (1, "ab" * 100 + " c d " + "e" * 70), (2, " ".join("xyz"[n % 3] * (n % 11 + 1) for n in range(400)))]
    monkeypatch.setattr(crosstoken, "FAN", 3)
    assert found(frame_of(spark, docs), size=size) == brute(docs, tools)


def test_counts_in_parts_and_small_slices(spark, tools, monkeypatch):
    docs = drawn(3)
    monkeypatch.setattr(crosstoken, "PAIRS", 20)
    monkeypatch.setattr(crosstoken, "TOKENS", 50)
    assert found(frame_of(spark, docs), size=300) == brute(docs, tools)


def test_counting_takes_little_memory_beside_its_batch():
    """A batch is worked on slice by slice and gives one row for each of its pairs; encoding's memory is not kept."""
    pair = crosstoken._pair(A, B)
    row = crosstoken.pa.array([" " + " ".join(f"{w} word{n}" for n, w in enumerate(["river", "stone", "été"] * 400))])
    a, _, b, _, good = next(pair.encode(row))
    assert good.all() and len(pair.a.keys) and len(pair.b.keys)
    rows = 600
    batch = crosstoken.pa.RecordBatch.from_arrays([crosstoken.pa.array([x.astype(pair.kind).tobytes()] * rows, crosstoken.pa.binary()) for x in (a, b)], names=["a", "b"])
    tokens = rows * (len(a) + len(b))
    assert tokens > 4_000_000
    tracemalloc.start()
    try:
        found = list(crosstoken._counted(A, B)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
    pairs = [p for f in found for p in f["pair"].to_pylist()]
    assert len(pairs) == len(set(pairs)) and not len(pair.a.keys) and not len(pair.b.keys)
    ends = [np.cumsum(s.lengths[x]) for s, x in ((pair.spell_a, a), (pair.spell_b, b))]
    starts = [e - s.lengths[x] for e, s, x in zip(ends, (pair.spell_a, pair.spell_b), (a, b), strict=True)]
    linked = Counter()
    for n, i in enumerate(a):
        for m in np.flatnonzero((starts[1] < ends[0][n]) & (ends[1] > starts[0][n])):
            linked[int(i) * pair.size_b + int(b[m])] += rows
    assert dict(zip(pairs, (n for f in found for n in f["n"].to_pylist()), strict=True)) == linked


def test_given_odd_and_empty_tables(spark, tools, documents, odd, empty):
    some = documents.filter("doc_id < 60")
    assert found(some, size=4000) == brute([(r["doc_id"], r["text"]) for r in some.collect()], tools)
    assert found(odd) == brute([r[:2] for r in odd_texts()], tools)
    assert crosstoken.align_tokenizers(empty, A, B).count() == 0


def test_fragments_join_in_any_grouping():
    draw = random.Random(5)
    pair = crosstoken._pair(A, B)
    text = " ".join(draw.choice(["internationalization", "the", "ABCdef", "zq", "été"]) for _ in range(60)).encode()
    data = b" " + text
    rows = next(pair.encode(crosstoken.pa.array([data.decode()])))
    cuts = sorted({0, len(data), *draw.sample(range(1, len(data)), 40)})
    parts = []
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        cut, held = crosstoken._fragment(pair, rows[0], rows[2], lo, hi, lo == 0)
        parts.append((cut, n, *[x.astype("<u2").tobytes() for x in (*held[:2], *held[4:])]))
    assert not all(p[0] for p in parts)

    def folded(some):
        if len(some) == 1:
            return some[0], []
        at = draw.randrange(1, len(some))
        (left, x), (right, y) = folded(some[:at]), folded(some[at:])
        both, group = crosstoken.compose(left, right)
        return both, x + y + ([group] if group else [])

    expected = None
    for _ in range(20):
        whole, groups = folded(parts)
        assert whole[2:] == (b"",) * 4
        groups = sorted(g for g in groups if g[1] or g[2])
        expected = expected or groups
        assert groups == expected and groups


def test_ranges_cover_the_text_and_end_inside_words():
    data = (" " + " ".join("word" * (n % 4 + 1) for n in range(300)) + "x" * 900 + " end of it").encode()
    ranges = list(crosstoken.byte_ranges(data, 64))
    assert [r[0] for r in ranges] == [0, *[r[1] for r in ranges[:-1]]] and ranges[-1][1] == len(data)
    assert all(begin <= lo < hi <= end for lo, hi, begin, end in ranges)
    assert any(data[hi - 1 : hi] != b" " and data[hi : hi + 1] not in (b" ", b"") for _, hi, _, _ in ranges)
    assert sum(end - begin for _, _, begin, end in ranges) < 2.5 * len(data)
