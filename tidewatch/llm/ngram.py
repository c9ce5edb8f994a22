"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped into memory to score (operator 10)."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save, scratch_path
from tidewatch.llm.text import LOWER, NOT_SPACE, span_hashes, text_slices, word_bounds

#: Hash of the end that follows every text; no word has it.
END = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Added to counts by the base score.
BASE = 0.1
#: Training tokens per shard that the number of shards is chosen for.
PER_SHARD = 4_000_000


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts: word hashes with an end after each text, and the first token of each text (one more than texts)."""
    for lo, hi, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        words = span_hashes(data, starts, ends)
        words[words == END] = 0
        rows = hi - lo
        yield np.insert(words, first[1:], END), first + np.arange(rows + 1)


def local_path(url: str) -> str:
    """The folder of a ``file:`` or plain path; the model must lie where every worker can map it."""
    parts = urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model needs a mounted folder that all executors share, not {url}")
    return parts.path


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array so that readers see it whole or not at all; a repeated task writes the same again."""
    os.makedirs(folder, exist_ok=True)
    unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(unfinished, "wb") as file:
        np.save(file, array)
    os.replace(unfinished, f"{folder}/{name}.npy")


def _blob(array: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.save(held, array)
    return held.getvalue()


def _unblob(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


class _Parts:
    """Counts of keys gathered in a task and given out by shard, whenever they are many."""

    def __init__(self, bounds: np.ndarray, most: int = 1 << 21):
        self.bounds, self.most, self.held, self.size = bounds, most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size >= self.most:
            yield from self.give()

    def give(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, counts = _sums(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))
        cuts = np.concatenate([[0], np.searchsorted(keys, self.bounds), [len(keys)]])
        # Small counts, as most are, take one byte.
        small = np.minimum(counts, 255).astype(np.uint8)
        rows = [
            (s, keys[a:b].tobytes(), small[a:b].tobytes(), counts[a:b][small[a:b] == 255].astype(np.int64).tobytes())
            for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            if b > a
        ]
        self.held, self.size = [], 0
        shard, key, low, high = zip(*rows, strict=True)
        columns = [pa.array(shard, pa.int32()), *(pa.array(x, pa.binary()) for x in (key, low, high))]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "small", "large"])


_PARTS = "shard int, keys binary, small binary, large binary"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all parts of a shard."""
    keys, counts = [], []
    for key, small, large in zip(*(table[c].to_pylist() for c in ("keys", "small", "large")), strict=True):
        keys.append(np.frombuffer(key, np.uint64))
        count = np.frombuffer(small, np.uint8).astype(np.int64)
        count[count == 255] = np.frombuffer(large, np.int64)
        counts.append(count)
    return _sums(np.concatenate(keys), np.concatenate(counts))


def _discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, and 3 or more."""
    if not ones or not twos:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = ones / (ones + 2 * twos)
    raw = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes if threes else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), n - 0.05) for n, d in enumerate(raw, 1))])


def _levels(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


@dataclass(frozen=True)
class BigramModel:
    """Arrays of a fitted model in a shared folder.

    Words are numbers: places in the sorted array of word hashes.  Pairs are numbers ``first << 32 | second``, kept
    in shards of about equal size, sorted.  ``bounds`` are the first pairs of all shards but the first.
    """

    folder: str
    words: int
    tokens: int
    texts: int
    bounds: np.ndarray
    discounts: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", folder: str | None = None) -> BigramModel:
        """Counted over all rows; null counts as empty.

        Words are counted in a first pass, then pairs.  Tasks sum what they read before the
        shuffle.  Shards of pairs are cut where the counts of their first words say that a shard is
        full, also within one word, so that a frequent word spreads over many shards.
        """
        spark = docs.sparkSession
        folder = local_path(folder or scratch_path(spark, "ngrams"))
        rows = docs.select(text)
        # As many parts of the words as the session has of a shuffle; no result depends on it.
        parts = 1 << max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
        words, total, texts, found = _count_words(rows, folder, parts)
        if not total:
            return cls(folder, 0, 0, 0, np.zeros(0, np.uint64), _discounts(0, 0, 0, 0))
        shards = max(8, -(-total // PER_SHARD))
        bounds = _place_words(spark, folder, found, shards, texts)
        edges = np.arange(parts + 1) * (words + 2) // parts  # of the ranges of words that arrays are finished in
        stats, discounts = _count_pairs(rows, folder, edges, bounds)
        _finish(folder, words, texts, edges, stats, discounts)
        return cls(folder, words, total, texts, bounds, discounts)

    def open(self) -> Lookup:
        return _open(self.folder, self.words, self.texts, self.bounds.tobytes(), self.discounts.tobytes())


def _word_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of hashes among the known ones; the number of known ones for others."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


@lru_cache(maxsize=2)
def _known_words(folder: str) -> np.ndarray:
    return np.load(f"{folder}/words.npy", mmap_mode="r")


def _pairs(words: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of tokens, and of the pairs that end with them; a text starts with the id behind the last word."""
    values, number = np.unique(words, return_inverse=True)
    ids = _word_ids(values, known)[number]
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[first[:-1]] = len(known) + 1
    return ids, before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _count_words(rows: DataFrame, folder: str, shards: int) -> tuple[int, int, int, list[tuple[int, int, int]]]:
    """Counts every word in shards of the hash (a power of two of them), written out sorted.

    Returns the numbers of words, tokens, and texts, and for each shard its number, words, and tokens.
    """
    bounds = np.arange(1, shards, dtype=np.uint64) << np.uint64(65 - shards.bit_length())

    def read(batches):
        parts = _Parts(bounds)
        for batch in batches:
            for words, _ in tokens(batch.column(0)):
                values, counts = np.unique(words, return_counts=True)
                yield from parts.add(values, counts)
        yield from parts.give()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        shard = table["shard"][0].as_py()
        _put(f"{folder}/counted", f"words-{shard}", keys)
        _put(f"{folder}/counted", f"counts-{shard}", counts)
        texts = int(counts[keys == END].sum())
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())], "texts": [texts]})

    counted = rows.mapInArrow(read, _PARTS).groupBy("shard").applyInArrow(merge, "shard int, words long, tokens long, texts long")
    found = sorted(save(counted, "word_counts").collect(), key=lambda r: r["shard"])  # one row a shard
    words, total, texts = (sum(r[c] for r in found) for c in ("words", "tokens", "texts"))
    return words, total, texts, [(r["shard"], r["words"], r["tokens"]) for r in found]


def _place_words(spark: SparkSession, folder: str, found: list[tuple[int, int, int]], shards: int, texts: int) -> np.ndarray:
    """Puts all shards of words into one array of hashes and one of counts; returns the first pairs of all shards of pairs.

    Those shards hold about equally many tokens.  Within a word that fills several of them, its pairs are cut
    evenly by their second words, whose places are random.
    """
    words, total = sum(n for _, n, _ in found), sum(n for _, _, n in found)
    _allot(folder, "words", np.uint64, words)
    _allot(folder, "counts", np.int64, words)
    targets = np.arange(1, shards) * ((total + texts) / shards)
    begins = np.cumsum([0, *[n for _, n, _ in found]]), np.cumsum([0, *[n for _, _, n in found]])
    rows = [(s, int(begins[0][i]), int(begins[1][i])) for i, (s, _, _) in enumerate(found)]

    def place(batches):
        for batch in batches:
            for shard, at, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.load(f"{folder}/counted/counts-{shard}.npy")
                for name, held in (("words", np.load(f"{folder}/counted/words-{shard}.npy")), ("counts", counts)):
                    whole = np.load(f"{folder}/{name}.npy", mmap_mode="r+")
                    whole[at : at + len(held)] = held
                    whole.flush()
                ends = before + np.cumsum(counts)
                mine = targets[(targets >= before) & (targets < ends[-1])]
                word = np.searchsorted(ends, mine, "right")
                share = (mine - (ends[word] - counts[word])) / counts[word]
                bounds = (at + word).astype(np.uint64) << np.uint64(32) | (share * words).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(bounds.view(np.int64))], names=["bound"])

    dealt = spark.createDataFrame(rows, "shard int, at long, before long").repartition(len(rows), "shard")
    held = np.array([r["bound"] for r in dealt.mapInArrow(place, "bound long").collect()], dtype=np.int64).view(np.uint64)
    late = targets[targets >= total]  # the start of texts is a first word too
    start = np.uint64(words + 1) << np.uint64(32) | ((late - total) / max(1, texts) * words).astype(np.uint64)
    return np.unique(np.concatenate([held, start]))


def _allot(folder: str, name: str, kind: type, size: int) -> None:
    """An array of zeros that tasks write their parts of."""
    os.makedirs(folder, exist_ok=True)
    np.lib.format.open_memmap(f"{folder}/{name}.npy", mode="w+", dtype=kind, shape=(size,)).flush()


def _count_pairs(rows: DataFrame, folder: str, edges: np.ndarray, bounds: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Counts every pair and writes the sorted shards.  Returns what the shards know of words, and the discounts.

    Of each shard there are: how many pairs occur once, twice, three, and four times; how many pairs each
    word ends; and per first word how many of its pairs occur once, twice, and more often.
    """
    cuts = edges[1:-1]

    def read(batches):
        known = _known_words(folder)
        parts = _Parts(bounds)
        for batch in batches:
            for hashes, first in tokens(batch.column(0)):
                _, pairs = _pairs(hashes, first, known)
                values, counts = np.unique(pairs, return_counts=True)
                yield from parts.add(values, counts)
        yield from parts.give()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        shard = table["shard"][0].as_py()
        _put(f"{folder}/pairs", f"keys-{shard}", keys)
        _put(f"{folder}/pairs", f"counts-{shard}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
        firsts = (keys >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], firsts[1:] != firsts[:-1]]))
        levels = np.stack([np.add.reduceat((counts == n) if n < 3 else (counts >= 3), heads, dtype=np.int64) for n in (1, 2, 3)], axis=1)
        seconds, ended = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        # One row per range of words; the ranges are those the words' arrays are finished in.
        first_cut = np.concatenate([[0], np.searchsorted(firsts[heads], cuts), [len(heads)]])
        second_cut = np.concatenate([[0], np.searchsorted(seconds, cuts), [len(seconds)]])
        pieces = [
            _blob(
                np.concatenate(
                    [
                        np.array([b - a, d - c]),
                        firsts[heads[a:b]],
                        levels[a:b].ravel(),
                        seconds[c:d],
                        ended[c:d],
                    ]
                ).astype(np.uint32)
            )
            for a, b, c, d in zip(first_cut[:-1], first_cut[1:], second_cut[:-1], second_cut[1:], strict=True)
            if b > a or d > c
        ]
        parts = np.flatnonzero((np.diff(first_cut) > 0) | (np.diff(second_cut) > 0))
        n = len(pieces)
        names = ["ones", "twos", "threes", "fours"]
        once = {name: [value] + [0] * (n - 1) for name, value in zip(names, _levels(counts), strict=True)}
        return pa.table({"part": pa.array(parts, pa.int32()), "held": pieces, **once})

    merged = rows.mapInArrow(read, _PARTS).groupBy("shard").applyInArrow(merge, "part int, held binary, ones long, twos long, threes long, fours long")
    stats = save(merged, "pair_stats")
    sums = stats.agg(*[F.sum(c) for c in ("ones", "twos", "threes", "fours")]).first()
    return stats, _discounts(*[x or 0 for x in sums])


def _finish(folder: str, words: int, texts: int, edges: np.ndarray, stats: DataFrame, discounts: np.ndarray) -> None:
    """Writes, for every word, the chance left to shorter context behind it and its chance without context."""
    _allot(folder, "left", np.float32, words + 2)
    _allot(folder, "alone", np.float64, words + 2)

    def gather(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        lo, hi = int(edges[part]), int(edges[part + 1])
        levels, ended = np.zeros((hi - lo, 3), np.int64), np.zeros(hi - lo, np.int64)
        for held in table["held"].to_pylist():
            array = _unblob(held).astype(np.int64)
            a, b = array[:2].tolist()
            firsts, rest = array[2 : 2 + a] - lo, array[2 + a :]
            np.add.at(levels, firsts, rest[: 3 * a].reshape(-1, 3))
            np.add.at(ended, rest[3 * a : 3 * a + b] - lo, rest[3 * a + b :])
        counts = np.zeros(hi - lo, np.int64)
        known = np.load(f"{folder}/counts.npy", mmap_mode="r")[lo : min(hi, words)]
        counts[: len(known)] = known
        if lo <= words + 1 < hi:
            counts[words + 1 - lo] = texts
        left = levels @ discounts[1:] / np.maximum(counts, 1)
        left[levels.sum(axis=1) == 0] = 1.0
        for name, values in (("left", left), ("alone", ended)):  # what a word ends is a number of pairs at first
            whole = np.load(f"{folder}/{name}.npy", mmap_mode="r+")
            whole[lo:hi] = values
            whole.flush()
        _put(f"{folder}/finished", f"ended-{part}", ended)
        sums = dict(zip(["ones", "twos", "threes", "fours"], _levels(ended), strict=True))
        return pa.table({"part": pa.array([part], pa.int32()), "pairs": [int(ended.sum())], "many": [int((ended >= 3).sum())], **{k: [v] for k, v in sums.items()}})

    finished = stats.select("part", "held").groupBy("part").applyInArrow(
        gather, "part int, pairs long, many long, ones long, twos long, threes long, fours long"
    )
    finished = save(finished, "word_stats")
    names = ["pairs", "many", "ones", "twos", "threes", "fours"]
    total = finished.agg(*[F.sum(c).alias(c) for c in names]).first()
    lower = _discounts(*[total[c] for c in names[2:]])
    spread = (lower[1] * total["ones"] + lower[2] * total["twos"] + lower[3] * total["many"]) / max(1, total["pairs"])
    # What discounting leaves goes evenly to all words and one unknown word.
    floor, pairs = spread / (words + 1), max(1, total["pairs"])

    def finish(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                ended = np.load(f"{folder}/finished/ended-{part}.npy")
                whole = np.load(f"{folder}/alone.npy", mmap_mode="r+")
                whole[int(edges[part]) : int(edges[part + 1])] = np.maximum(ended - lower[np.minimum(ended, 3)], 0) / pairs + floor
                whole.flush()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    finished.select("part").mapInArrow(finish, "part int").count()
    # No pair has the unknown word.
    for name, value in (("left", 1.0), ("alone", floor)):
        whole = np.load(f"{folder}/{name}.npy", mmap_mode="r+")
        whole[words] = value
        whole.flush()


class Lookup:
    """The model's arrays, mapped and not read: pages come in as they are used and can go again."""

    def __init__(self, folder: str, words: int, texts: int, bounds: np.ndarray, discounts: np.ndarray):
        self.known, self.counts, self.left, self.alone = (
            np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in ("words", "counts", "left", "alone")
        )
        self.words, self.texts, self.bounds, self.discounts = words, texts, bounds, discounts
        self.folder = folder
        self.shards: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def shard(self, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        if n not in self.shards:
            path = f"{self.folder}/pairs/keys-{n}.npy"
            here = os.path.exists(path)
            self.shards[n] = (np.load(path, mmap_mode="r"), np.load(path.replace("keys-", "counts-"), mmap_mode="r")) if here else None
        return self.shards[n]

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs."""
        out = np.zeros(len(pairs), np.int64)
        cuts = np.concatenate([[0], np.searchsorted(pairs, self.bounds), [len(pairs)]])
        for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            held = self.shard(n) if b > a else None
            if held is not None:
                keys, counts = held
                at = np.minimum(np.searchsorted(keys, pairs[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == pairs[a:b], counts[at], 0)
        return out

    def log_chances(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of every token's chance behind the one before it, and its training count."""
        ids, pairs = _pairs(hashes, first, self.known)
        values, number = np.unique(pairs, return_inverse=True)
        before = (values >> np.uint64(32)).astype(np.int64)
        word = (values & np.uint64(0xFFFFFFFF)).astype(np.int64)
        count = self.pair_counts(values)
        context = np.where(before < self.words, self.counts[np.minimum(before, self.words - 1)], 0)
        context[before == self.words + 1] = self.texts
        own = np.maximum(count - self.discounts[np.minimum(count, 3)], 0) / np.maximum(context, 1)
        chance = own + np.where(context > 0, self.left[before], 1.0) * self.alone[word]
        seen = np.where(word < self.words, self.counts[np.minimum(word, self.words - 1)], 0)
        return np.log10(chance)[number], seen[number]


@lru_cache(maxsize=1)
def _open(folder: str, words: int, texts: int, bounds: bytes, discounts: bytes) -> Lookup:
    return Lookup(folder, words, texts, np.frombuffer(bounds, np.uint64), np.frombuffer(discounts))


def score_documents(docs: DataFrame, model: BigramModel, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score; columns of these names are replaced.

    Scores are log10 probabilities of the whole text with its end.  Null and empty texts are the
    end alone.  If nothing was learned, every token has the same chance of 1 (score 0), and the
    base score counts from an empty table (N = V = 0).
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        lookup = model.open() if model.words else None
        size = model.tokens + BASE * (model.words + 1)
        for batch in batches:
            held: list[list[np.ndarray]] = [[], [], [], []]
            for hashes, first in tokens(batch.column(batch.schema.names.index(text))):
                if lookup is None:
                    chance, seen = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
                else:
                    chance, seen = lookup.log_chances(hashes, first)
                starts = first[:-1]
                base = np.log10((seen + BASE) / size)
                for out, values in zip(held, (np.ones_like(seen), (seen > 0).astype(np.int64), base, chance), strict=True):
                    out.append(np.add.reduceat(values, starts))
            n, known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in held)
            columns = [*batch.columns, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64())]
            columns += [pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    kept = docs.drop(*new)
    fields = [T.StructField(c, T.LongType()) for c in new[:3]] + [T.StructField(c, T.DoubleType()) for c in new[3:]]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
