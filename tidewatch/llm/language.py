"""Languages of a text as a mixture, found by expectation-maximisation (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.text import text_slices

UNKNOWN = "und"
#: Slots that byte trigrams are hashed to; a model has one row of them per language.
SLOTS = 1 << 16
#: Added to every count of a language, and rounds of expectation-maximisation at most.
SMOOTHING, ROUNDS = 0.5, 20
#: Trigrams overlap, so a text holds about this share of independent ones.
INDEPENDENT = 1 / 3
#: Languages learned at most; more raise an error, as the model is held in memory.
MOST_LANGUAGES = 500
_GRAMS_AT_ONCE = 1 << 19


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = _LETTERS[128:] = True


def letter_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of lower-cased texts one after the other with one blank (32) for whatever is between them.

    Returns the bytes, the text each belongs to, and which are the blanks before a text; one
    more of these ends the stream, as if another text followed.
    """
    rows = len(offsets) - 1
    data = np.insert(np.append(data, np.uint8(32)), np.append(offsets[:-1], len(data)), np.uint8(32))
    heads = offsets + np.arange(rows + 1)
    inside = _LETTERS[data]
    head = np.zeros(len(data), dtype=bool)
    head[heads] = True
    keep = inside | head
    keep[1:] |= inside[:-1]  # the first byte behind a word stands for the blank
    text = np.repeat(np.arange(rows + 1, dtype=np.int32), np.diff(np.append(heads, len(data))))[keep]
    return np.where(inside, data, np.uint8(32))[keep], text, head[keep]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every byte trigram of lower-cased texts, and the first trigram of each text (one more than texts)."""
    rows = len(offsets) - 1
    value, text, head = letter_stream(data, offsets)
    value = value.astype(np.uint32)
    grams = value[:-2] << 16 | value[1:-1] << 8 | value[2:]
    valid = (text[1:-1] == text[:-2]) & ((text[2:] == text[:-2]) | head[2:]) & (text[:-2] < rows)
    slots = (grams[valid] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return slots, np.concatenate([[0], np.cumsum(np.bincount(text[:-2][valid], minlength=rows)[:rows])])


def lower_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return text_slices(pc.utf8_lower(pc.fill_null(column, "")))


@dataclass(frozen=True)
class Languages:
    """Names in alphabetic order and the probability of every slot in each of them (slots x languages)."""

    names: tuple[str, ...]
    chance: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
        """Counted over all rows whose language is not null; each task sums its part before the shuffle."""

        def run(batches):
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                names = batch.column(0).to_pylist()
                for lo, _, data, offsets in lower_slices(batch.column(1)):
                    slots, first = trigrams(data, offsets)
                    codes = {n: i for i, n in enumerate(dict.fromkeys(names[lo : lo + len(first) - 1]))}
                    code = np.array([codes[n] for n in names[lo : lo + len(first) - 1]])
                    joint = np.bincount(np.repeat(code, np.diff(first)) * SLOTS + slots, minlength=len(codes) * SLOTS).reshape(-1, SLOTS)
                    for n, i in codes.items():
                        held[n] = held.get(n, 0) + joint[i]
            for n, counts in held.items():
                slot = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(counts[slot], pa.int64())],
                    names=["lang", "slot", "n"],
                )

        rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text)
        counted = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        packed = counted.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))
        found = sorted(packed.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        chance = np.full((SLOTS, len(found)), SMOOTHING)
        for i, r in enumerate(found):
            chance[r["slots"], i] += r["ns"]
        return cls(tuple(r["lang"] for r in found), chance / chance.sum(axis=0))

    def mixtures(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of every language in each text, and the number of languages chosen; texts without trigrams: zeros.

        All languages take part at first.  While leaving out the one with the least share costs
        less likelihood than the penalty of a parameter (half the logarithm of the number of
        trigrams), it goes, and shares are estimated anew.
        """
        rows, count = len(first) - 1, len(self.names)
        sizes = np.diff(first)
        some = np.flatnonzero(sizes)
        shares, chosen = np.zeros((rows, count)), np.zeros(rows, np.int64)
        if not len(some) or not count:
            return shares, chosen
        # Equal trigrams of a text are one row with a weight.
        row = np.repeat(np.arange(rows), sizes)
        pair, weight = np.unique(row.astype(np.int64) * SLOTS + slots, return_counts=True)
        row, chance = pair // SLOTS, self.chance[pair % SLOTS]
        heads = np.searchsorted(row, some)
        weight = weight.astype(float)
        total = sizes[some]
        number = np.searchsorted(some, row)
        active = np.ones((len(some), count), dtype=bool)
        share, fit = self._climb(chance, weight, heads, number, active / active.sum(1, keepdims=True), total)
        penalty = 0.5 * np.log(np.maximum(total * INDEPENDENT, 2))
        open_ = np.ones(len(some), dtype=bool)
        for _ in range(count - 1):
            # The least share goes on trial, in all texts that still have two languages.
            open_ &= active.sum(1) > 1
            if not open_.any():
                break
            least = np.where(active, share, np.inf).argmin(axis=1)
            trial = active.copy()
            trial[np.arange(len(some)), least] = False
            texts = np.flatnonzero(open_)
            mine = open_[number]
            start = np.where(trial, share + 1e-6, 0)[texts]
            start /= start.sum(1, keepdims=True)
            where = np.cumsum(open_) - 1
            their = where[number[mine]]
            heads_of = np.searchsorted(their, np.arange(len(texts)))
            new, new_fit = self._climb(chance[mine], weight[mine], heads_of, their, start, total[texts])
            better = (fit[texts] - new_fit) * INDEPENDENT < penalty[texts]
            taken = texts[better]
            active[taken], share[taken], fit[taken] = trial[taken], new[better], new_fit[better]
            open_[texts[~better]] = False
        shares[some], chosen[some] = share, active.sum(1)
        return shares, chosen

    def _climb(self, chance, weight, heads, number, share, total) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation for many texts at once: shares and log-likelihoods.

        Every text stops by itself, so its result does not depend on the texts next to it.
        """
        share = share.copy()
        going = np.arange(len(heads))  # the texts that still move, and their trigrams
        c, w, h, at = chance, weight, heads, number
        for _ in range(ROUNDS):
            joint = c * share[going][at]
            joint *= (w / joint.sum(axis=1))[:, None]
            new = np.add.reduceat(joint, h, axis=0) / total[going][:, None]
            moves = np.abs(new - share[going]).max(axis=1, initial=0) >= 1e-3
            share[going] = new
            if not moves.any():
                break
            if not moves.all():
                mine = moves[at]
                at = (np.cumsum(moves) - 1)[at[mine]]
                going, c, w = going[moves], c[mine], w[mine]
                h = np.searchsorted(at, np.arange(len(going)))
        fit = np.add.reduceat(weight * np.log((chance * share[number]).sum(axis=1)), heads)
        return share, fit

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language of the largest share, that share, the shares, and the number of languages of every text."""
        names, best, shares, numbers = [], [], [], []
        for _, _, data, offsets in lower_slices(column):
            slots, first = trigrams(data, offsets)
            # Texts are taken in runs of a bounded number of trigrams.
            lo = 0
            while lo < len(first) - 1:
                most = _GRAMS_AT_ONCE // max(1, len(self.names) // 8)
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, "right")) - 1)
                share, chosen = self.mixtures(slots[first[lo] : first[hi]], first[lo : hi + 1] - first[lo])
                top = share.argmax(axis=1) if share.shape[1] else np.zeros(len(share), int)
                best.append(share[np.arange(len(share)), top] if share.shape[1] else np.zeros(len(share)))
                names += [self.names[t] if c else UNKNOWN for t, c in zip(top.tolist(), chosen.tolist(), strict=True)]
                shares.append(share)
                numbers.append(chosen)
                lo = hi
        if not names:
            return [], np.zeros(0), np.zeros((0, len(self.names))), np.zeros(0, np.int64)
        return names, np.concatenate(best), np.concatenate(shares), np.concatenate(numbers)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_shares`` (a map of the languages with a share).

    ``lang_pred`` is the language with the largest share of the mixture and ``score`` that share;
    equal shares go to the first name.  Null texts, texts without a letter, and all texts if
    nothing was learned, are ``und`` with score 0.  Columns of these names are replaced.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            column = batch.column(at)
            names, best, shares, _ = model.predict(column)
            held = column.to_pylist()
            known = np.array([n != UNKNOWN and has_letter(t) for n, t in zip(names, held, strict=True)], dtype=bool)
            maps = [
                [(model.names[j], float(row[j])) for j in np.flatnonzero(row > 0)] if k else []
                for k, row in zip(known.tolist(), shares, strict=True)
            ]
            columns = [*batch.columns, pa.array([n if k else UNKNOWN for n, k in zip(names, known.tolist(), strict=True)], pa.string())]
            columns += [pa.array(np.clip(np.where(known, best, 0.0), 0, 1)), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score", "lang_shares"])

    kept = docs.drop("lang_pred", "score", "lang_shares")
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    new.append(T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType())))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))
