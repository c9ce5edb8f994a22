"""Operator 12 against brute force, and its plan."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from tests.llm.conftest import SF, WORDS, odd_texts
from tidewatch.llm import phrases
from tidewatch.llm.queries import QUERIES, SQL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        held = words_of(text)
        m = min(length, len(held))
        for s in range(len(held) - m + 1 if held else 0):
            windows[tuple(held[s : s + m])].add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for i, text in docs:
        held = words_of(text)
        hit, found = set(), set()
        for m in sizes:
            for s in range(len(held) - m + 1):
                at = windows.get(tuple(held[s : s + m]))
                if at:
                    hit |= set(range(s, s + m))
                    found |= at
        listed = sorted(str(x) for x in found if x is not None)
        out[i, len(held), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)] += 1
    return out


def drawn(seed, vocabulary=WORDS, n=120):
    """Documents made of few words, with passages of items, and items with ties, repeats, short and odd texts."""
    draw = random.Random(seed)
    line = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    items = [(i, line(draw.choice([1, 2, 5, 9, 10, 11, 14, 30]))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "..."), (None, line(12)), (5, line(13)), (33, items[7][1]), (34, items[7][1]), (35, "river " * 15), (36, "Été café " * 6), (37, "never met words here at all in any of those texts")]
    docs = []
    for i in range(n):
        parts = [line(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            held = words_of(draw.choice(items)[1])
            a = draw.randint(0, max(0, len(held) - 4))
            parts += [" , ".join(held[a : a + draw.randint(1, 20)]).title(), line(draw.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(500, "river " * 40), (500, "river " * 40), (501, "ÉTÉ café Été Café " * 6), (None, items[20][1]), (502, items[3][1] + "\n" + items[3][1]), (503, None)]
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(i, t, "x", "x", 1, 1) for i, t in docs], "doc_id long, text string, term string, word string, key long, pos long").repartition(3)
    right = spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, term string, q string").repartition(2)
    return left, right


def test_contamination_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = drawn(seed)
        assert Counter(map(tuple, phrases.contamination(*frames(spark, docs, items)).collect())) == brute(docs, items)
    docs, items = drawn(3)
    assert Counter(map(tuple, phrases.contamination(*frames(spark, docs, items), length=4).collect())) == brute(docs, items, 4)


def test_nothing_is_broadcast_that_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", 0)
    docs, items = drawn(4)
    assert Counter(map(tuple, phrases.contamination(*frames(spark, docs, items)).collect())) == brute(docs, items)


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [r[:2] for r in odd_texts()]
    long = next(t for i, t in rows if i == 8)
    items = [(1, " ".join(long.split()[40_000:40_050])), (2, "GNU general public license"), (3, "ab"), (4, None)]
    left, right = frames(spark, [], items)
    assert Counter(map(tuple, phrases.contamination(odd, right).collect())) == brute(rows, items)
    assert phrases.contamination(empty, right).count() == 0
    assert Counter(map(tuple, phrases.contamination(odd, right.limit(0)).collect())) == brute(rows, [])


def test_sql_says_the_same_and_no_python_runs(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.execute(SQL["op12_decontamination"])
    names = [d[0] for d in rows.description]
    found = QUERIES["op12_decontamination"](spark, SF)
    assert Counter(rows.fetchall()) == Counter(map(tuple, found.select(*names).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_matches_are_as_long_as_they_can_be(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    docs = [(1, " ".join(["x", *item, "y"])), (2, " ".join([*item[2:12], "z", *item[:10]])), (3, " ".join([*item[:9], "gap", *item[9:]]))]
    left, right = frames(spark, docs, [(7, " ".join(item))])
    held = phrases.Items.of(right)
    postings = phrases.positional_index(left, held.words)
    rows = phrases.phrase_matches(postings, held).join(phrases.document_rows(postings).select("key", "id"), "key")
    found = {(r["id"], r["start"], r["item_start"], r["n_words"]) for r in rows.collect()}
    assert found == {(1, 1, 0, 13), (2, 0, 2, 10), (2, 11, 0, 10)}


def brute_proximity(docs, items, span, length):
    out = set()
    for i, text in docs:
        held = words_of(text)
        for item, other in items:
            q = words_of(other)
            m = min(length, len(q))
            for s in range(len(q) - m + 1 if q else 0):
                need = Counter(q[s : s + m])
                for start in range(len(held)):
                    if held[start] in need and not need - Counter(held[start : start + span]):
                        out.add((i, item, s, start))
    return out


def test_proximity_against_brute_force(spark):
    draw = random.Random(12)
    names = [f"w{n}" for n in range(30)]
    items = [(i, " ".join(draw.choice(names) for _ in range(draw.choice([1, 2, 4, 6])))) for i in range(12)]
    docs = [(i, " ".join(draw.choice(names) for _ in range(draw.randint(0, 80)))) for i in range(40)]
    left, right = frames(spark, docs, items)
    held = phrases.Items.of(right)
    postings = phrases.positional_index(left, held.words)
    for span, length in ((6, 4), (9, 4), (3, 2)):
        rows = phrases.proximity_matches(postings, held, span, length).join(phrases.document_rows(postings).select("key", F.col("id").alias("doc")), "key")
        rows = rows.join(held.ids, "item")
        found = [(r["doc"], r["id"], r["item_start"], r["start"]) for r in rows.collect()]
        assert len(found) == len(set(found)) and set(found) == brute_proximity(docs, items, span, length)
