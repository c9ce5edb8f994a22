"""Operators that read one text at a time: languages, toxicity, BPE, licences, packing, n-grams."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from tests.llm.conftest import SF, odd_texts
from tidewatch.llm import bpe, language, license, packing, queries
from tidewatch.llm.language import UNKNOWN, Languages, identify
from tidewatch.llm.ngram import BigramModel, score_documents
from tidewatch.llm.text import hash_word, text_slices, word_bounds
from tidewatch.llm.toxicity import Channel, Toxicity, letter_model, restore_texts, score_texts, suspicious

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def both(first, second):
    """Rows of two frames of id and text as multisets."""
    return Counter(map(tuple, first)), Counter(map(tuple, second))


def test_slices_cover_all_rows_and_words_stay_in_their_text():
    texts = ["ab c", None, "", "d" * 50, "e f"]
    seen = []
    for lo, hi, data, offsets in text_slices(pa.array(texts, pa.string()), limit=10):
        starts, ends, first = word_bounds(data, offsets, np.array([b not in b" " for b in range(256)]))
        for i in range(hi - lo):
            seen.append([data[starts[w] : ends[w]].tobytes().decode() for w in range(first[i], first[i + 1])])
    assert seen == [(t or "").split() for t in texts]


def test_languages_of_held_out_documents(spark):
    rows = queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95


def test_mixture_shares_follow_the_parts_of_a_text(spark, documents):
    model = Languages.fit(documents)
    texts = {g: documents.filter((F.col("lang") == g) & (F.col("n_chars") > 3000)).first()["text"][:3000] for g in ("en", "de")}
    names, best, shares, chosen = model.predict(pa.array([texts["en"] + " " + texts["de"], texts["en"]]))
    at = dict(zip(model.names, shares[0], strict=True))
    assert chosen.tolist() == [2, 1] and names[1] == "en" and best[1] == 1
    assert abs(at["en"] - 0.5) < 0.1 and abs(at["de"] - 0.5) < 0.1


def test_language_of_odd_rows(odd, empty):
    model = Languages.fit(odd)
    rows = identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        known = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] != UNKNOWN) == known and (known or r["score"] == 0) and 0 <= r["score"] <= 1
    assert identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in identify(odd, Languages.fit(empty)).collect()} == {UNKNOWN}


def plain_slots(text: str | None) -> list[int]:
    """Slots of the trigrams of a text, byte by byte: words with one blank around them, and one more blank at the end."""
    data = (text or "").lower().encode()
    words = re.findall(rb"[a-z\x80-\xff]+", data)
    stream = b" " + b" ".join(words) + (b" " if words and not re.search(rb"[a-z\x80-\xff]\Z", data) else b"") + b" "
    grams = [int.from_bytes(stream[i : i + 3], "big") for i in range(len(stream) - 2)]
    return [g * 0x9E3779B1 % 2**32 >> 16 for g in grams]


def plain_climb(counts: Counter, chance: np.ndarray, share: dict[int, float]) -> tuple[dict[int, float], float]:
    for _ in range(language.ROUNDS):
        new = dict.fromkeys(share, 0.0)
        for slot, n in counts.items():
            norm = math.fsum(chance[slot, k] * v for k, v in share.items())
            for k, v in share.items():
                new[k] += n * chance[slot, k] * v / norm
        new = {k: v / counts.total() for k, v in new.items()}
        moved, share = max(abs(new[k] - share[k]) for k in share), new
        if moved < 1e-3:
            break
    return share, math.fsum(n * math.log(math.fsum(chance[slot, k] * v for k, v in share.items())) for slot, n in counts.items())


def plain_mixture(text: str | None, model: Languages) -> dict[int, float]:
    """One text by itself: all languages, then the least share goes as long as that costs less than its penalty."""
    counts = Counter(plain_slots(text))
    if not counts:
        return {}
    share, fit = plain_climb(counts, model.chance, dict.fromkeys(range(len(model.names)), 1 / len(model.names)))
    while len(share) > 1:
        least = min(share, key=lambda k: (share[k], k))
        rest = {k: v + 1e-6 for k, v in share.items() if k != least}
        new, new_fit = plain_climb(counts, model.chance, {k: v / sum(rest.values()) for k, v in rest.items()})
        if (fit - new_fit) * language.INDEPENDENT >= 0.5 * math.log(max(counts.total() * language.INDEPENDENT, 2)):
            break
        share, fit = new, new_fit
    return share


def test_mixtures_against_one_text_at_a_time(documents):
    model = Languages.fit(documents)
    texts = [r["text"] for r in documents.filter("doc_id % 20 = 0").collect()]
    texts += [t for _, t, _ in odd_texts() if len(t or "") < 20_000]
    texts += [f"{a[:300]} {b[:200]}" for a, b in zip(texts[:20], texts[20:40], strict=True)]
    names, best, shares, chosen = model.predict(pa.array(texts, pa.string()))
    for text, name, score, row, number in zip(texts, names, best.tolist(), shares, chosen.tolist(), strict=True):
        expected = plain_mixture(text, model)
        assert number == len(expected)
        assert np.allclose(row, [expected.get(k, 0) for k in range(len(row))], rtol=0, atol=1e-9)
        assert name == (model.names[max(expected, key=lambda k: (expected[k], -k))] if expected else UNKNOWN)
        alone = model.predict(pa.array([text], pa.string()))
        assert alone[0] == [name] and abs(alone[1][0] - score) < 1e-12


def test_toxicity_of_held_out_documents(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.93 and all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_deobfuscation(documents):
    channel = Channel(letter_model(documents))
    pairs = {"l0ser": "loser", "m o r o n": "moron", "w.o.r.t.h.l.e.s.s": "worthless", "stuuuupid": "stupid", "p4th3t1c": "pathetic", "$cum": "scum"}
    assert {k: channel.restore(k) for k in pairs} == pairs
    assert channel.restore("hello") == "hello"
    data = np.frombuffer("a l0ser, is ooook; i d i o t here 2024".encode(), np.uint8)
    spans = suspicious(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in spans] == ["l0ser,", "ooook;", "i d i o t"]
    data, offsets = restore_texts(np.frombuffer(b"no l0ser$cum", np.uint8), np.array([0, 8, 8, 12]), channel)
    assert [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)] == [b"no loser", b"", b"scum"]


def test_toxicity_scores_restored_text(spark):
    words = "river stone house walks green idle cloud maker paper light".split()
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(words, k=30)) + (" you loser" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = Toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(1, "a l0ser"), (2, "a l o s e r"), (3, "the green house"), (4, None), (5, "a looooser")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in score_texts(asked, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}


FORMS = ["idio7", "id10+", "lose5", "iiddiioott", "id-iot", "mo.ron", "i  d  i  o  t", "i - d - i - o - t", "i d 1 o t", "m\u00b7o\u00b7r\u00b7o\u00b7n"]


def test_every_form_the_channel_models_reaches_it(spark, documents):
    plain = ["idiot", None, "loses", "idiot", "idiot", "moron", "idiot", "idiot", "idiot", "moron"]
    channel = Channel(letter_model(documents))
    held = "".join(f"{f}," for f in FORMS)  # one text each
    offsets = np.cumsum([0, *[len(f.encode()) + 1 for f in FORMS]])
    data, bounds = restore_texts(np.frombuffer(held.encode(), np.uint8), offsets, channel)
    found = [data[a:b].tobytes().decode().rstrip(",") for a, b in zip(bounds, bounds[1:], strict=False)]
    found[1] = None  # these letters do not tell which of its readings is meant
    assert suspicious(np.frombuffer(b"id10+", np.uint8), np.array([0, 5])) == [(0, 5)]
    assert dict(zip(FORMS, found, strict=True)) == dict(zip(FORMS, plain, strict=True))
    euro = "th€".encode()
    assert suspicious(np.frombuffer(euro, np.uint8), np.array([0, len(euro)])) == [(0, len(euro))]
    spaced = "é t é".encode()
    assert suspicious(np.frombuffer(spaced, np.uint8), np.array([0, len(spaced)])) == [(0, len(spaced))]
    ordinary = "12 of 34 words, as they are: 5 6 7".encode()
    assert suspicious(np.frombuffer(ordinary, np.uint8), np.array([0, len(ordinary)])) == []


def test_every_form_is_scored(spark, documents):
    words = "river stone house walks green idle cloud maker paper light".split()
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(words, k=30)) + (" you idiot and moron" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = Toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    forms = [f for f in FORMS if f != "lose5"]
    asked = spark.createDataFrame([(i, f"green {f} house") for i, f in enumerate(forms)] + [(99, "a green house")], "doc_id long, text string")
    assert {forms[r["doc_id"]] if r["doc_id"] < 99 else "": r["predicted"] for r in score_texts(asked, model).collect()} == {"": 0, **dict.fromkeys(forms, 1)}


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(8, 1), (8, 0), (None, 1), (60, None), (61, 0), (62, 0)], "doc_id long, toxic int")
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        model = Toxicity.fit(docs, marks)
        scored = score_texts(odd, model)
        assert scored.count() == odd.count() and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert score_texts(empty, model).count() == 0


def random_texts(n: int) -> list[str]:
    draw = random.Random(3)
    parts = ["a", "B", "The", " ", "  ", "\n", "\t", "'s", "'LL", "é", "É", "ß", "×", "Ÿ", "Œ", "1", "23", "…", " ", "　"]
    parts += ["\x1c", "\x85", "\U0001f600", "中", "<|endoftext|>", "!!", "--", "́", "ﬁ", "İ", "Σ", "\r\n", "ing", "Ж", "'", "١", "K"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def test_ids_equal_the_library():
    texts = [t or "" for _, t, _ in odd_texts()] + random_texts(3000)
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    pieces = bpe.Pieces(bpe.Merges(BYTE_BPE), bpe.SPLIT)
    got = [t[a:b].tolist() for t, at in bpe.encode_column(pa.array(texts), pieces) for a, b in zip(at, at[1:], strict=False)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    pieces = packing.LowerPieces(bpe.Merges(WORD_BPE), packing.SPLIT)
    got = [t[a:b].tolist() for t, at in packing.token_slices(pa.array(texts), pieces) for a, b in zip(at, at[1:], strict=False)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_transducer_needs_no_more_than_its_lookahead():
    merges = bpe.Merges(BYTE_BPE)
    draw = random.Random(2)
    for _ in range(60):
        text = "".join(draw.choice(["a", "b", "the", "er", "tion", "ss", "é", "ing"]) for _ in range(draw.randint(100, 2000))).encode()
        encoder, out, at = bpe.Encoder(merges, block=64), [], 0
        while at < len(text):
            step = draw.randint(1, 200)
            out += encoder.feed(text[at : at + step])
            assert len(encoder.held) <= 64 + merges.lookahead + 200
            at += step
        assert out + encoder.finish() == encoder._ids(text, True)


@pytest.mark.parametrize("block", [1, 7, 100, 5000])
def test_all_ids_come_from_the_transducer(block, monkeypatch):
    made = []

    class Watched(bpe.Transducer):
        def __init__(self, pieces):
            super().__init__(pieces)
            made.append(self)

    monkeypatch.setattr(bpe, "Transducer", Watched)
    texts = [t or "" for _, t, _ in odd_texts()] + random_texts(3000 if block > 50 else 400)
    if block < 50:
        texts = [t for t in texts if len(t) < 2000]
    pieces = bpe.Pieces(bpe.Merges(BYTE_BPE), bpe.SPLIT)
    got, row = [], []
    for tokens, at, more in bpe.encode_stream(pa.array(texts), pieces, block):
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            row += tokens[a:b].tolist()
            if i < len(at) - 2 or not more:
                got.append(row)
                row = []
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(t.emitted for t in made) == sum(map(len, got))


def test_transducer_holds_little_of_a_long_text():
    draw = random.Random(4)
    parts = ["word", "x1y22", "é", "中文", "\n\n", " ", " ", " the", "<|endoftext|>", "'ll", "　 "]
    text = "".join(draw.choice(parts) for _ in range(600_000))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    stream, out = bpe.Transducer(bpe.Pieces(bpe.Merges(BYTE_BPE), bpe.SPLIT)), []
    for lo in range(0, len(data), 1 << 14):
        part = data[lo : lo + (1 << 14)]
        out += stream.feed(part, np.array([0, len(part)]), lo + (1 << 14) < len(data))[0].tolist()
        assert sum(map(len, stream.held)) < 1000
    assert out == tokenizers.Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids


def test_decoder_waits_for_whole_characters():
    merges = bpe.Merges(BYTE_BPE)
    ids = tokenizers.Tokenizer.from_file(BYTE_BPE).encode("\U0001f600 中").ids
    decoder = bpe.Decoder(merges)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "\U0001f600 中"


def test_encode_decode_query(spark, odd, empty):
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    expected = []
    for i, t, _ in odd_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    a, b = both(bpe.encode_decode(odd, BYTE_BPE).collect(), expected)
    assert a == b
    assert bpe.encode_decode(empty, BYTE_BPE).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(odd, BYTE_BPE), BYTE_BPE).collect()
    a, b = both(back, [(i, t or "") for i, t, _ in odd_texts()])
    assert a == b


def words_of(text: str | None) -> list[str]:
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def base_of(text: str | None) -> tuple:
    words, starts, labels = words_of(text), [], set()
    for template in license.BASE:
        phrase = template.words.split()
        at = [n for n in range(len(words)) if words[n : n + len(phrase)] == phrase]
        starts += at
        labels |= {template.label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_query_against_brute_force(odd, documents, empty):
    for docs in (odd, documents):
        got = license.scan_licenses(docs).collect()
        a, b = both([r[:6] for r in got], [(r["doc_id"], *base_of(r["text"])) for r in docs.collect()])
        assert a == b
        for r in got:
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r["labels"] for r in license.scan_licenses(odd).collect()}
    assert by_id[44] == "cc-by,cc-by-nc-4.0,mit" and by_id[45] == "gpl,gpl-3.0"
    assert license.scan_licenses(empty).count() == 0


def test_license_spans_bear_added_and_left_out_words(spark):
    whole = license.PASSAGES[7].words.split()
    bent = [*whole[:8], "very", *whole[8:15], *whole[16:]]
    rows = [(1, "intro " + " ".join(whole)), (2, " ".join(bent) + " and more"), (3, " ".join(whole[:9])), (4, "of the of the of the")]
    spans = license.license_spans(spark.createDataFrame(rows, "doc_id long, text string"), license.PASSAGES).collect()
    assert {(r["id"], r["label"]) for r in spans} == {(1, "mit"), (2, "mit")}
    assert [(r["start"], r["end"], r["share"]) for r in spans if r["id"] == 1] == [(1, 1 + len(whole), 1.0)]


def test_license_spans_follow_the_order_of_the_template(spark):
    """Whole licences are found; a passage whose words are shuffled in blocks of two is none; each of two passages is a span."""
    short, whole = license.PASSAGES[7].words.split(), next(t.words.split() for t in license.PASSAGES if len(t.words.split()) > 150)
    blocks = [short[i : i + 2] for i in range(0, len(short), 2)]
    shuffled = [w for k in range(4) for block in blocks[k::4] for w in block]
    swapped = [w for a, b in zip(blocks[::2], blocks[1::2], strict=False) for w in (*b, *a)]
    rows = [(1, " ".join(shuffled)), (2, " ".join(swapped)), (3, " ".join(["x", *whole, "y"])), (4, " ".join([*short, *short, "and", *short]))]
    rows += [(5, " ".join(["the"] * 30_000)), (6, " ".join([*whole[:70], "more", *whole[70:90], *whole[95:]]))]
    spans = license.license_spans(spark.createDataFrame(rows, "doc_id long, text string"), license.PASSAGES).collect()
    found = {(r["id"], r["start"], r["end"], r["share"]) for r in spans if len(license.PASSAGES[r["template"]].words.split()) > 150}
    n, m = len(whole), len(short)
    assert found == {(3, 1, 1 + n, 1.0)}
    assert {(r["start"], r["share"]) for r in spans if r["id"] == 4 and r["template"] == 7} == {(0, 1.0), (m, 1.0), (2 * m + 1, 1.0)}
    assert not [r for r in spans if r["id"] in (1, 2, 5)]


def longest_in_order(text: list[str], template: list[str]) -> int:
    """Most template words held by a chain of matched pairs, tried pair by pair."""
    pairs = [(a, p) for a in range(len(text) - 1) for p in range(len(template) - 1) if text[a : a + 2] == template[p : p + 2]]
    best: dict[tuple[int, int], int] = {}
    for a, p in pairs:
        gains = [n + min(2, a - b, p - q) for (b, q), n in best.items() if b < a and q < p and abs(a - p - b + q) <= license.REACH]
        best[a, p] = max([2, *gains])
    return max(best.values(), default=0)


def test_ordered_spans_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        template = [str(w) for w in rng.integers(0, 12, rng.integers(11, 90))]
        text = [w for w in template if rng.random() > 0.08]
        for k in rng.integers(0, len(text), 4).tolist():
            text[k:k] = text[-3:] if rng.random() < 0.3 else ["new"]
        votes: dict[tuple[int, int], int] = {}
        for a in range(len(text) - 1):
            for p in range(len(template) - 1):
                if text[a : a + 2] == template[p : p + 2]:
                    key = a - p, p // license.BITS
                    votes[key] = votes.get(key, 0) | 1 << p % license.BITS
        spans = license.ordered_spans([k[0] for k in votes], [k[1] for k in votes], list(votes.values()), len(template))
        most, needed = longest_in_order(text, template), len(template) * (1 if len(template) <= license.SHORT else license.LEAST_SHARE)
        assert max((s[2] for s in spans), default=0) == (most if most >= needed else 0)


def check_packing(rows, texts):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for lo in range(0, len(ids), 4096):
            expected[i, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes()), len(ids)] += 1
    assert Counter(tuple(r[:5]) for r in rows) == expected
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in windows.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 4096
    return 1 - sum(r["length"] for r in rows) / (4096 * len(windows))


def test_packing(odd, documents, empty):
    check_packing(packing.pack_documents(odd, WORD_BPE).collect(), [r[:2] for r in odd_texts()])
    padding = check_packing(packing.pack_documents(documents, WORD_BPE).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert padding < 0.03
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_packing_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 400)
    rows = [(None, "")] * 1500 + [(7, "river stone")] * 1500 + [(8, "river " * 9000)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE).collect()
    check_packing(found, rows)
    groups = Counter(r["sequence_id"] >> 32 for r in found if r["length"] < 4096)
    assert len(groups) == 8 and max(groups.values()) < 600


def test_differencing_keeps_memory_in_proportion_to_the_items():
    tracemalloc.start()
    windows = packing.differencing([1 + n % 3 for n in range(4000)], 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, windows)) == 4000 and peak < 16 << 20


def test_differencing_is_nearly_even():
    draw = random.Random(4)
    sizes = [draw.randint(1, 3000) for _ in range(400)]
    windows = packing.differencing(sizes, 100)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400)) and max(sums) - min(sums) < 0.05 * max(sums)
    assert packing.fill([], 10) == [] and [sorted(w) for w in packing.fill([10, 10, 10], 10)] != []


def brute_model(texts: list[list[str]]):
    """Interpolated modified Kneser-Ney over bigrams, word by word."""
    count, pairs, context = Counter(w for t in texts for w in t), Counter(), Counter()
    for t in texts:
        for a, b in zip(["<start>", *t], t, strict=False):
            pairs[a, b] += 1
            context[a] += 1
    ended = Counter(b for _, b in pairs)

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]

    high, low = discounts(list(pairs.values())), discounts(list(ended.values()))
    behind = defaultdict(float)
    for (a, _), n in pairs.items():
        behind[a] += high[min(n, 3)] / context[a]
    spread = sum(low[min(n, 3)] for n in ended.values()) / len(pairs)

    def chance(a, b):
        alone = max(ended[b] - low[min(ended[b], 3)], 0) / len(pairs) + spread / (len(count) + 1)
        return alone if a not in context else max(pairs[a, b] - high[min(pairs[a, b], 3)], 0) / context[a] + behind[a] * alone

    return count, chance


def tokens_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()] + ["<end>"]


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_ngram_scores_equal_brute_force(request, table):
    docs = request.getfixturevalue(table).select("doc_id", "text")
    held = queries.remainder(10) == 0
    train = docs.filter(~held)
    count, chance = brute_model([tokens_of(r["text"]) for r in train.collect()])
    total = sum(count.values())
    asked = docs.limit(120)
    for r in score_documents(asked, BigramModel.fit(train)).collect():
        words = tokens_of(r["text"])
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in words)
        score = sum(math.log10(chance(a, b)) for a, b in zip(["<start>", *words], words, strict=False))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in count for w in words), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6)


def test_ngram_chances_sum_to_one(documents):
    model = BigramModel.fit(documents.select("text").limit(300)).open()
    for before in (int(model.known[5]), hash_word(b"never seen before")):
        words = np.append(np.array(model.known), np.uint64(12345))
        pairs = np.stack([np.full(len(words), before, np.uint64), words], axis=1).ravel()
        chances, _ = model.log_chances(pairs, np.arange(0, len(pairs) + 2, 2)[: len(words) + 1])
        assert math.isclose((10 ** chances[1::2]).sum(), 1, rel_tol=1e-5)


def test_ngram_of_nothing(odd, empty):
    assert score_documents(empty, BigramModel.fit(odd)).count() == 0
    assert {r["score"] for r in score_documents(odd, BigramModel.fit(empty)).collect()} == {0.0}
