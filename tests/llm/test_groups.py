"""Operators that compare rows: archives, SimHash, vectors, exact copies, components, and the pipeline."""

import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF, odd_texts
from tidewatch.functions.scratch import scratch_path
from tidewatch.llm import metric, simhash, warc
from tidewatch.llm.components import components
from tidewatch.llm.exact import DigestIndex, exact_groups, normal_text
from tidewatch.llm.packing import cut_documents


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_paths_stars_and_cliques(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(400)] + [(i, j) for i in range(2000, 2020) for j in range(2000, i)]
    edges += [(draw.randint(5000, 6000), draw.randint(5000, 6000)) for _ in range(400)] + [(7, 7), (9000, 9000)]
    expected = Union()
    for a, b in edges:
        if a != b:
            expected.join(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    classes = defaultdict(set)
    for r in found:
        classes[r["root"]].add(r["node"])
    wanted = defaultdict(set)
    for x in list(expected.up):
        wanted[expected.find(x)].add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    union = Union()
    for n, a in enumerate(distinct):
        for b in distinct[: n + 1]:
            if (a ^ b).bit_count() <= 4:
                union.join(a, b)
    first = {}
    for i, p in prints:
        if i is not None:
            first[union.find(p)] = min(first.get(union.find(p), i), i)
    return Counter((i, f"{p:016x}", first.get(union.find(p))) for i, p in prints)


def test_simhash_against_brute_force(odd, documents, empty):
    assert Counter(map(tuple, simhash.simhash_groups(odd).collect())) == brute_simhash([r[:2] for r in odd_texts()])
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(300).collect()]
    assert Counter(map(tuple, simhash.simhash_groups(documents.limit(300)).collect())) == brute_simhash(rows)
    assert simhash.simhash_groups(empty).count() == 0


def test_full_cells_are_cut(spark, monkeypatch):
    draw = random.Random(6)
    codes = sorted({draw.getrandbits(14) << 20 | draw.getrandbits(4) for _ in range(1500)})
    distinct = spark.createDataFrame([(c,) for c in codes], "node long")
    expected, found, sizes = Union(), Union(), []
    for n, a in enumerate(codes):
        for b in codes[:n]:
            if (a ^ b).bit_count() <= 1:
                expected.join(a, b)
    inner = simhash._links

    def counted(limit):
        run = inner(limit)

        def sized(batches):
            held = list(batches)
            keys = Counter(k for b in held for k in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([max(keys.values(), default=0)]), pa.array([-1])], names=["a", "b"])
            yield from run(iter(held))

        return sized

    monkeypatch.setattr(simhash, "HOME", 100)
    monkeypatch.setattr(simhash, "_links", counted)
    for r in simhash.links(distinct, 1).collect():
        if r["b"] == -1:
            sizes.append(r["a"])
        else:
            found.join(r["a"], r["b"])
    assert max(sizes) < 400
    assert [expected.find(c) for c in codes] == [found.find(c) for c in codes]


@pytest.mark.parametrize("spread", [2, 6, 20, 64])
def test_gray_index_finds_all_classes(spread):
    draw = random.Random(spread)
    centre = draw.getrandbits(64)
    codes = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, spread))) for _ in range(900)}
    rank = lambda c: c if not c else c ^ rank(c >> 1)
    codes = np.array(sorted(codes, key=rank), dtype=np.uint64)
    label = simhash.GrayIndex(codes).classes(4)
    union = Union()
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[: i + 1] ^ codes[i]) <= 4).tolist():
            union.join(i, j)
    assert label.tolist() == [union.find(i) for i in range(len(codes))]


def test_every_pair_of_a_cell_goes_through_the_tree(spark, documents):
    prints = simhash.fingerprints(documents).select(F.col("fingerprint").alias("node")).distinct()
    rows = simhash.dealt(prints).coalesce(1).collect()
    held = np.array([tuple(r) for r in rows], dtype=np.int64)
    rank = lambda c: c if not c else c ^ rank(c >> 1)
    held = np.array(sorted(held.tolist(), key=lambda r: (rank(r[0]), rank(r[1] % (1 << 64)))))
    keys, codes = (np.ascontiguousarray(held[:, i]).view(np.uint64) for i in (0, 1))
    index = simhash.GrayIndex(codes, keys)
    label = index.classes(4)
    nodes = len(index.levels[0][0])
    assert len(index.levels) > 2 and index.pruned > 0
    assert index.compared < nodes * (nodes + 1) / 2 / 4
    linked = 0
    for start in np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1))).tolist():
        cell = np.flatnonzero(keys[start : start + 5000] == keys[start]) + start
        a, b = np.nonzero(np.bitwise_count(codes[cell][:, None] ^ codes[cell][None, :]) <= 4)
        linked += int((a < b).sum())
        assert (label[cell[a]] == label[cell[b]]).all()
    assert linked


def test_links_lose_no_class(spark):
    draw = random.Random(8)
    codes = {0}
    for _ in range(40):
        centre = draw.getrandbits(64)
        codes |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 7))) for _ in range(30)}
    codes = sorted(codes)
    rows = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "node long")
    got, wanted = Union(), Union()
    for r in simhash.links(rows).collect():
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 64
        got.join(a, b)
    for n, a in enumerate(codes):
        for b in codes[:n]:
            if (a ^ b).bit_count() <= 4:
                wanted.join(a, b)
    assert [got.find(c) for c in codes] == [wanted.find(c) for c in codes]


def test_exact_copies(spark, odd, empty):
    groups = defaultdict(list)
    lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t, _ in odd_texts():
        groups[lower(t)].append(i)
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i is not None and i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_groups(odd).collect())) == expected
    assert exact_groups(empty).count() == 0


def test_digest_index_takes_in_batches_and_is_found_again(spark, documents):
    digests = documents.select("doc_id", F.unhex(F.sha2(normal_text(), 256)).alias("digest"))
    path = scratch_path(spark, "index")
    index = DigestIndex(spark, path, "index_of_batches", buckets=8)
    first = index.add(digests.filter("doc_id < 600")).count()
    again = DigestIndex(spark, path, "index_opened_again", buckets=8)
    new = again.add(digests).count()
    assert first + new == digests.select("digest").distinct().count()
    assert spark.table("index_opened_again").groupBy("digest").count().filter("count > 1").count() == 0
    assert again.add(digests).count() == 0
    # Its own number of buckets holds, another one is refused, and a batch under its old number adds nothing.
    with pytest.raises(ValueError, match="8 buckets"):
        DigestIndex(spark, path, "index_of_other_buckets", buckets=12)
    third = DigestIndex(spark, path, "index_opened_third")
    assert third.buckets == 8 and third.batches == 2
    assert third.add(digests, batch=1).count() == new
    assert third.add(digests.filter("doc_id < 600"), batch=0).count() == first
    assert spark.read.parquet(third.data).count() == first + new
    plan = digests.join(spark.table("index_opened_again").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def brute_vectors(rows, cosine=0.98):
    links, union = Counter(), Union()
    usable = {}
    for n, (_, v, g) in enumerate(rows):
        union.find(n)
        if g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, float) / max(map(abs, v))
            usable[n] = scaled / np.linalg.norm(scaled)
    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= cosine:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    first = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            first[union.find(n)] = min(first.get(union.find(n), i), i)
    return Counter((i, links[n], first.get(union.find(n)), i is not None and i == first.get(union.find(n))) for n, (i, _, _) in enumerate(rows))


def test_vectors_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + draw.normal(scale=0.12, size=8)).tolist(), i % 3) for i in range(400)]
    rows += [(1000 + i, centres[0].tolist(), 0) for i in range(60)] + [(2000, [0.0] * 8, 0), (2001, None, 0), (2002, [1.0] * 8, None), (2003, [], 1)]
    rows += [(2004, [float("nan")] + [1.0] * 7, 0), (2005, [None] + [1.0] * 7, 0), (2006, [float("inf")] * 8, 0), (None, centres[0].tolist(), 0), (None, None, None)]
    rows += [(2007, (centres[0] * 5).tolist(), 0), (2007, (centres[0] * 5).tolist(), 0), (2008, [1.0, 2.0], 1), (2009, [2.0, 4.0], 1), (2010, [0.0, -0.0], 1)]
    rows += [(2011, [1e200] * 8, 2), (2012, [1e-200] * 8, 2), (2013, [-0.0, 1.0], 1), (2014, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, code string, distance double").repartition(4)
    expected = brute_vectors(rows)
    for home, per in ((4096, 2000), (16, 20)):
        monkeypatch.setattr(metric, "HOME", home)
        monkeypatch.setattr(metric, "PER_PIVOT", per)
        assert Counter(map(tuple, metric.vector_groups(frame).collect())) == expected
    assert metric.vector_groups(frame.limit(0)).count() == 0


ODD_PAGES = [
    (1, "http://a/\r\nX: y", "p" * 100), (2, None, "p" * 100), (3, "u", "p" * 99), (4, "u", "p" * 99), (5, "u", None), (6, "u", ""), (None, "u", "p" * 100),
    (7, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20), (8, "u", "é中" * 40_000), (0, "u", "é" * 50), (9, "é x", "é" * 50),
    (None, None, None), (None, "u", "only without an id " * 9),
]


def test_archive_of_odd_pages(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ODD_PAGES], "page_id long, url string, html string, payload string").repartition(3)
    smallest = {}
    for i, _, t in ODD_PAGES:
        if i is not None and len((t or "").encode()) >= 100:
            smallest[t] = min(smallest.get(t, i), i)
    expected = Counter()
    for i, _, t in ODD_PAGES:
        data = (t or "").encode()
        to = smallest.get(t) if t else None
        revisit = to is not None and to != i
        expected[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    path = scratch_path(spark, "warc")
    assert Counter(map(tuple, warc.archive_pages(pages, path).collect())) == expected
    back = warc.read_warc(spark, path).filter("record_type = 'response'").collect()
    assert Counter(r["payload"] for r in back) == Counter(t or "" for i, _, t in ODD_PAGES if not (t in smallest and smallest[t] != i))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_grow_by_appending_and_start_anew_when_overwritten(spark):
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_warc(pages.filter("page_id < 30"), path)
    warc.write_warc(pages.filter("page_id >= 30"), path)
    assert sorted(r["page_id"] for r in warc.read_warc(spark, path).collect()) == sorted(r["page_id"] for r in pages.collect())
    held = spark.createDataFrame(warc.read_warc(spark, path).filter("page_id < 5").collect(), warc.SCHEMA)
    held.write.format("warc").mode("overwrite").save(path)
    assert sorted(r["page_id"] for r in warc.read_warc(spark, path).collect()) == list(range(5))


def test_filters_and_columns_reach_the_reader(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{SF}/pages.parquet"), path)
    narrow = warc.read_warc(spark, path, "page_id long, record_type string").filter("page_id >= 10 AND page_id < 20 AND record_type = 'response'")
    assert sorted(r["page_id"] for r in narrow.collect()) == list(range(10, 20))
    reader = warc.WarcReader(path, narrow.schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.GreaterThan(("page_id",), 5), warc.EqualTo(("payload",), "x")]))
    assert len(left) == 1 and reader.wanted({"warc-type": "response", "x-page-id": "9"}) == 0 and reader.wanted({"warc-type": "revisit", "x-page-id": "9"}) == 1


def test_other_tools_read_the_archive_and_other_archives_are_read(spark, tmp_path):
    rows = [{"page_id": n, "url": "u", "record_type": "response", "payload": f"page {n}\r\n\r\n" * n} for n in range(5)]
    for r in rows:
        r |= {"payload_digest": hashlib.sha256(r["payload"].encode()).hexdigest(), "payload_bytes": len(r["payload"]), "refers_to": None}
    plain = [gzip.decompress(warc.record(r)) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in plain))
    found = warc.read_warc(spark, str(tmp_path)).filter("page_id > 0").collect()
    assert Counter((r["page_id"], r["payload"]) for r in found) == Counter((r["page_id"], r["payload"]) for r in rows[1:] for _ in range(2))


@pytest.mark.parametrize(("name", "sf"), [("op5_warc", SF), ("op7_vectors", SF), ("op7_vectors", "/root/testdata/sf0.1"), ("op8_exact", SF)])
def test_sql_says_the_same(spark, name, sf):
    from tidewatch.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = con.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert Counter(rows.fetchall()) == Counter(map(tuple, QUERIES[name](spark, sf).select(*names).collect()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and after.exceptAll(docs).isEmpty()
        kept[name] = docs = after
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in kept.items()}
    gone = ids["documents"] - ids["toxicity"]
    assert gone and sum(labels.get(i, 1) for i in gone) / len(gone) > 0.8
    texts = defaultdict(list)
    for r in kept["language"].collect():
        texts[r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))].append(r["doc_id"])
    assert ids["exact_dedup"] == {max(v) for v in texts.values()}
    rows = [(r["doc_id"], r["text"]) for r in kept["exact_dedup"].collect()]
    assert ids["near_dedup"] == {i for i, _, first in brute_simhash(rows) if i == first}
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids["near_dedup"]
    pieces = cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.select(*pieces.columns).exceptAll(pieces).isEmpty() and packed.count() == pieces.count()


def test_copies_are_dropped_by_row_and_not_by_id(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, "copy of two"), (1, "stands nowhere else"), (2, "Copy of TWO"), (3, "same"), (3, "same"), (None, "no id"), (None, "no id")]
    rows += [(None, "Same"), (4, None), (5, ""), (6, long), (6, long + " x"), (None, long), (7, "stands nowhere else too")]
    frame = spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in rows], "doc_id long, text string, place string, row string, file string, at string")
    frame.repartition(3).write.parquet(f"{tmp_path}/docs")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/docs")):
        exact = corpus_pipeline.exact_dedup(spark, docs, SF)
        assert exact.columns == docs.columns
        kept = Counter((r["doc_id"], r["text"]) for r in exact.collect())
        assert kept == Counter([(1, "stands nowhere else"), (2, "Copy of TWO"), (3, "same"), (None, "no id"), (5, ""), (6, long), (6, long + " x"), (7, "stands nowhere else too")])
        near = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
        texts = [r["text"] for r in docs.collect()]
        union = Union()
        for a in set(texts):
            union.find(a)
            for b in set(texts):
                if (brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() <= 4:
                    union.join(*sorted([a or "", b or ""]))
        groups = defaultdict(list)
        for r in docs.collect():
            groups[union.find(r["text"] or "")].append(r["doc_id"])
        assert Counter(i for i, _ in near.elements()) == Counter(min((i for i in g if i is not None), default=None) for g in groups.values())


def test_pipeline_bears_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(8, 0), (60, 1), (None, None)], "doc_id long, toxic int")
    for docs, at in ((odd, tmp_path / "odd"), (empty, tmp_path / "empty")):
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        rows = corpus_pipeline.run(spark, str(at)).collect()
        assert bool(rows) == (docs is odd)
