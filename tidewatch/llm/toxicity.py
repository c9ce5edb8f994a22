"""Toxicity of a text after noisy-channel deobfuscation (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scratch import save
from tidewatch.llm.language import letter_stream, lower_slices
from tidewatch.llm.text import NOT_SPACE, word_bounds

#: Labelled rows of each class that the classifier is fitted on at most (about; drawn by hash).
SAMPLE = 6000
#: Slots (as a power of two) that five-byte pieces of words are hashed to.
SLOT_BITS = 22
#: Toxic texts a piece must stand in, and standard errors its log-odds must lie above zero.
LEAST_TEXTS, ERRORS = 3, 2.0
#: Letters that a sign often stands for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Channel costs in nats: a sign for a letter, a letter repeated, a sign meant as such; a separator put between
#: letters or meant as such, in a word and between letters that all stand alone.
SIGN_COST, REPEAT_COST, PLAIN_COST = 2.0, 1.0, 3.0
SEPARATOR_COSTS, SPACED_COSTS = (1.5, 0.0), (0.0, 3.0)
#: Symbols of the language model: 0 word edge, 1-26 letters, 27 other letters.
SYMBOLS = 28
_REMEMBERED = 200_000

def symbols(data: np.ndarray) -> np.ndarray:
    code = np.zeros(256, dtype=np.int64)
    code[97:123] = np.arange(1, 27)
    code[128:] = 27
    return code[data]

def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) over ``SYMBOLS``, from the letters of all rows; tasks sum their part before the shuffle."""

    def run(batches):
        held = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in lower_slices(batch.column(0)):
                stream, of, head = letter_stream(data, offsets)
                code = symbols(stream)
                joint = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
                held += np.bincount(joint[(of[1:-1] == of[:-2]) & ((of[2:] == of[:-2]) | head[2:])], minlength=SYMBOLS**3)
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(held[slot], pa.int64())], names=["slot", "n"])

    counted = docs.select(text).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.full(SYMBOLS**3, 0.1)
    for r in counted.collect():  # SYMBOLS**3 rows at most
        counts[r["slot"]] += r["n"]
    counts = counts.reshape(-1, SYMBOLS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(SYMBOLS, SYMBOLS, SYMBOLS)

@dataclass
class Channel:
    """Restores obfuscated spans with the most likely letters under a letter model."""

    model: np.ndarray
    known: dict[bytes, bytes] = field(default_factory=dict)

    def __post_init__(self):
        self.table = self.model.tolist()

    def restore(self, span: str) -> str:
        """Viterbi path through the lattice of a span's letters.

        Every character may be kept; a sign may stand for a letter; a character equal to the one
        before may be a repetition; and a separator may have been put between letters.  A state
        is the last two letters, so a long span takes time in proportion to its length.
        """
        spaced = not any(a.isalpha() and b.isalpha() for a, b in pairwise(span))
        put, meant = SPACED_COSTS if spaced else SEPARATOR_COSTS
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        previous = ""
        for c in span:
            moves: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def offer(state, cost, path, moves=moves):
                if state not in moves or cost < moves[state][0]:
                    moves[state] = (cost, path)

            if c.isalpha():
                letters, edge = [(c, 0.0)], None
            else:
                letters = [(x, SIGN_COST) for x in SIGNS.get(c, "")]
                edge = PLAIN_COST if c.isdigit() else meant
            for (a, b), (cost, path) in best.items():
                for letter, more in letters:
                    code = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    offer((b, code), cost + more - self.table[a][b][code], (letter, path))
                if c == previous and letters:
                    offer((a, b), cost + REPEAT_COST, path)
                if edge is not None:
                    if b == 0:
                        offer((0, 0) if a == 0 else (a, b), cost + edge, (c, path))
                    else:
                        offer((b, 0), cost + edge - self.table[a][b][0], (c, path))
                        if not c.isdigit():
                            offer((a, b), cost + put, path)
            best, previous = moves, c
        end = min(((cost - (self.table[a][b][0] if b else 0.0), path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
        out, path = [], end[1]
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def restored(self, span: bytes) -> bytes:
        if span not in self.known:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[span] = self.restore(span.decode("utf-8", "replace")).encode()
        return self.known[span]

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in SIGNS if ord(c) < 128]] = True

#: Bytes of the character that a byte starts.
_CHARACTER = np.ones(256, dtype=np.int64)
_CHARACTER[0xC0:0xE0], _CHARACTER[0xE0:0xF0], _CHARACTER[0xF0:] = 2, 3, 4

def _plain_signs(data: np.ndarray) -> np.ndarray:
    """The bytes with those of signs beyond ASCII as ``$`` and of spaces, punctuation and symbols beyond ASCII as ``.``"""
    out = data.copy()
    if not (data > 127).any():
        return out
    one, two = np.append(data[1:], 0), np.concatenate([data[2:], [0, 0]])[: len(data)]
    latin = (data == 0xC2) & ~np.isin(one, [0xAA, 0xB5, 0xBA]) | (data == 0xC3) & np.isin(one, [0x97, 0xB7])
    symbol = (data == 0xE2) & (one < 0xB0) | (data == 0xE3) & (one == 0x80)
    for places, length in ((latin, 2), (symbol, 3), ((data == 0xF0) & (one == 0x9F), 4)):
        at = np.flatnonzero(places)
        for i in range(length):
            out[at[at + i < len(out)] + i] = ord(".")
    for places, length in (((data == 0xC2) & (one == 0xA3), 2), ((data == 0xE2) & (one == 0x82) & (two == 0xAC), 3)):
        at = np.flatnonzero(places)
        for i in range(length):
            out[at + i] = ord("$")
    return out

def suspicious(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Spans of lower-cased texts that may be obfuscated: in order, apart from each other.

    Words with a letter next to a sign on either side, with the same letter twice in a row, or with anything between
    letters; and rows of three or more single letters or signs, a letter among them, with any separators between.
    """
    if len(data) < 2:
        return []
    whole, data = data, _plain_signs(data)
    letter, sign = _LETTER[data], _SIGN[data]
    pairs = (sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:])
    pairs |= (data[:-1] == data[1:]) & (data[1:] >= 97) & (data[1:] <= 122)
    # The same letter of two bytes twice.
    wide = np.flatnonzero((data[:-3] >= 0xC2) & (data[:-3] < 0xE0) & (data[:-3] == data[2:-1]) & (data[1:-2] == data[3:]))
    starts, ends, _ = word_bounds(data, offsets, NOT_SPACE)
    runs, run_ends, _ = word_bounds(data, offsets, _LETTER)
    of = np.searchsorted(starts, runs, "right") - 1
    word = np.concatenate([np.searchsorted(starts, np.concatenate([np.flatnonzero(pairs), wide]), "right") - 1, of[1:][of[1:] == of[:-1]]])
    word = np.unique(word)
    has_letter = np.concatenate([[0], np.cumsum(letter)])
    word = word[has_letter[ends[word]] > has_letter[starts[word]]]
    spans = list(zip(starts[word].tolist(), ends[word].tolist(), strict=True))
    starts, ends, first = word_bounds(data, offsets, _LETTER | _SIGN)
    if len(starts) > 2:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        single = ends - starts == _CHARACTER[whole[starts]]
        next_ = single[:-1] & single[1:] & (text[1:] == text[:-1])
        edge = np.diff(np.concatenate([[0], next_.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= 2 and has_letter[ends[b]] > has_letter[starts[a]]:
                spans.append((int(starts[a]), int(ends[b])))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out

def restore_texts(data: np.ndarray, offsets: np.ndarray, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with their suspicious spans restored."""
    spans = suspicious(data, offsets)
    if not spans:
        return data, offsets
    held, parts, at = data.tobytes(), [], 0
    change = np.zeros(len(data) + 1, dtype=np.int64)
    for a, b in spans:
        new = channel.restored(held[a:b])
        parts += [held[at:a], new]
        change[b] += len(new) - (b - a)
        at = b
    parts.append(held[at:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets + np.cumsum(change)[offsets]

def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every run of five bytes within a word and its edges, the text each belongs to, and whether the next follows in its word."""
    stream, text, head = letter_stream(data, offsets)
    if len(stream) < 5:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    blank = stream == 32
    n = len(stream) - 4
    value = np.zeros(n, dtype=np.uint64)
    for i in range(5):
        value = value * np.uint64(257) + stream[i : i + n]
    valid = ~(blank[1 : 1 + n] | blank[2 : 2 + n] | blank[3 : 3 + n])
    slot = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
    return slot[valid].astype(np.int64), text[:n][valid], np.append(valid[1:], False)[valid]

@dataclass(frozen=True)
class Toxicity:
    """Weights of word pieces, and the chance of being toxic by the largest weight of two in a row found in a text."""

    letters: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    chances: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Toxicity:
        """Learned from labelled rows of ``docs``; the letter model uses all rows of ``docs``.

        Of each class about ``SAMPLE`` rows are drawn by a hash of the id, two thirds for the
        weights and one third for the chances.  A weight is the log-odds of a piece being in
        toxic and in other texts, less ``ERRORS`` standard errors.  Several labels of an id count as
        toxic if one is; null labels and ids are left out.  Without toxic labels all scores are 0.
        """
        letters = letter_model(docs, text)
        known = labels.filter(F.col(toxic).isNotNull() & F.col(id_column).isNotNull())
        known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max((F.col(toxic) > 0).cast("int")).alias("_toxic"))
        drawn = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
        known = save(known.withColumn("_draw", drawn), "labels")
        total = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = {c: min(1.0, SAMPLE / max(1, total.get(c, 0))) for c in (0, 1)}
        limit = F.when(F.col("_toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * 1_000_000
        sample = known.filter(F.col("_draw") < limit)
        # About 2 * SAMPLE rows of three numbers: small whatever the size of the tables.
        sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
        sample = save(sample.select("_toxic", (F.col("_draw") % 3).alias("_part"), "_text"), "sample")
        fitted, checked = sample.filter("_part < 2"), sample.filter("_part = 2")
        slots, weights = _weights(fitted, letters)
        model = cls(letters, slots, weights, np.zeros(0), np.zeros(1))
        edges, chances = _chances(checked, model, {c: 1 / share[c] for c in share})
        return cls(letters, slots, weights, edges, chances)

    def table(self) -> np.ndarray:
        held = np.zeros(1 << SLOT_BITS, dtype=np.float32)
        held[self.slots] = self.weights
        return held

    def strongest(self, column: pa.Array, channel: Channel, table: np.ndarray) -> np.ndarray:
        """Largest weight of two pieces in a row of each restored text (the lesser of both), 0 if it has none."""
        out = []
        for lo, hi, data, offsets in lower_slices(column):
            slot, text, followed = word_pieces(*restore_texts(data, offsets, channel))
            weight = table[slot]
            # Two pieces in a row must tell, so that a word is not judged by a piece it shares with another.
            least = np.minimum(weight, np.append(weight[1:], 0))
            alone = ~followed & ~np.concatenate([[False], followed[:-1]])
            weight = np.where(followed, least, np.where(alone, weight, 0))
            hit = weight > 0
            best = np.zeros(hi - lo)
            np.maximum.at(best, text[hit], weight[hit])
            out.append(best)
        return np.concatenate(out) if out else np.zeros(0)

    def chance(self, strongest: np.ndarray) -> np.ndarray:
        return self.chances[np.searchsorted(self.edges, strongest, "right")]

def _weights(sample: DataFrame, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        channel = Channel(letters)
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        rows = {0: 0, 1: 0}
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for c in rows:
                rows[c] += int((toxic == c).sum())
            for lo, hi, data, offsets in lower_slices(batch.column(1)):
                slot, text, _ = word_pieces(*restore_texts(data, offsets, channel))
                pair = np.unique(text.astype(np.int64) << SLOT_BITS | slot)
                of = toxic[lo:hi][pair >> SLOT_BITS]
                for c in held:
                    values, counts = np.unique(pair[of == c] & ((1 << SLOT_BITS) - 1), return_counts=True)
                    held[c].append(np.stack([values, counts]))
        for c, parts in held.items():
            if not rows[c]:
                continue
            both = np.concatenate([*parts, np.array([[-1], [rows[c]]])], axis=1)  # slot -1 counts the texts
            values, where = np.unique(both[0], return_inverse=True)
            counts = np.bincount(where, weights=both[1]).astype(np.int64)
            yes = counts if c else np.zeros_like(counts)
            columns = [pa.array(values, pa.int32()), pa.array(yes, pa.int64()), pa.array(counts - yes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "yes", "no"])

    counted = sample.select("_toxic", "_text").mapInArrow(run, "slot int, yes long, no long")
    counted = counted.groupBy("slot").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counted = save(counted.filter(f"slot = -1 OR yes >= {LEAST_TEXTS}"), "pieces")
    of_all = counted.filter("slot = -1").first()
    if of_all is None or not of_all["yes"]:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    odds = F.log((F.col("yes") + 0.5) / (of_all["yes"] + 1)) - F.log((F.col("no") + 0.5) / (of_all["no"] + 1))
    weight = odds - ERRORS * F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    best = counted.filter("slot >= 0").select("slot", weight.alias("weight")).filter("weight > 0")
    found = best.orderBy(F.desc("weight"), "slot").collect()  # of the 2^SLOT_BITS slots, those met in the bounded sample
    return np.array([r["slot"] for r in found], dtype=np.int64), np.array([r["weight"] for r in found], dtype=np.float32)

def _chances(sample: DataFrame, model: Toxicity, factor: dict[int, float], step: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Share of toxic texts by largest weight, in steps, made to rise (adjacent violators are pooled)."""

    def run(batches):
        channel, table = Channel(model.letters), model.table()
        for batch in batches:
            steps = np.floor(model.strongest(batch.column(1), channel, table) / step).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps)], names=["toxic", "step"])

    counted = sample.select("_toxic", "_text").mapInArrow(run, "toxic int, step int")
    rows = counted.groupBy("step", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 rows a step
    steps = sorted({r["step"] for r in rows})
    if not any(r["toxic"] for r in rows) or not len(model.slots):
        return np.zeros(0), np.zeros(1)
    # Each step starts with a hundredth of a text on either side.
    pools = []
    for s in steps:
        yes, no = (sum(r["n"] * factor[c] for r in rows if r["step"] == s and r["toxic"] == c) for c in (1, 0))
        pools.append([s, yes + 0.01, no + 0.01])
        while len(pools) > 1 and pools[-1][1] * pools[-2][2] <= pools[-2][1] * pools[-1][2]:
            _, yes, no = pools.pop()
            pools[-1][1] += yes
            pools[-1][2] += no
    return np.array([p[0] * step for p in pools[1:]]), np.array([p[1] / (p[1] + p[2]) for p in pools])

def score_texts(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); columns of these names are replaced.

    Null counts as empty; such texts and those without letters get the chance of a text without a
    telling piece.
    """

    def run(batches):
        channel, table = Channel(model.letters), model.table()
        for batch in batches:
            at = batch.schema.names.index(text)
            score = np.clip(model.chance(model.strongest(batch.column(at), channel, table)), 0, 1)
            columns = [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    kept = docs.drop("score", "predicted")
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))
