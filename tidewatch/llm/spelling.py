"""Spelling variants: k-d trees over letter counts find words one edit apart (operator 11).

A word's letter counts are kept as a code of ``4 * 64`` bits, in which a letter that occurs c times has its first c bits set
(up to the bits it has).  The L1 distance of two count vectors is then the number of
differing bits, a box of vectors is the AND and the OR of its members, and the distance of a vector from a box is the number of bits
that the box has and the vector lacks, or the other way round.  One edit changes the counts
by two at most (one inserted or deleted letter: by one), whatever is cut off at the end of a letter's bits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scratch import save

#: Letters of words (after A-Z are lower-cased) and the bits that each has: a-z, and U+00C0 to U+00FF.
LETTERS, FEW_BITS, OTHERS, OTHER_BITS = 26, 4, 64, 2
CODE = ["k0", "k1", "k2", "k3"]
#: A run's letter is deleted if this divides its checksum; the code points and occurrences that a word must have.
DROP, SHORTEST, FEWEST = 199, 6, 5
#: A form occurs at least so many times as often as the word.
RATIO = 5
#: Words of this many code points and more are one class of length.
LONGEST_CLASS = 64
#: Words that the upper trees are drawn from (about), words of a cell, visitors of a cell that meet them at a time, words of a leaf.
TREE_SAMPLE, HOME, VISITORS, LEAF = 50_000, 4096, 16_384, 24
#: Characters of text searched at a time, and distinct words that a task holds before it hands them on.
_PART, _HELD = 1 << 20, 1 << 18


def _parts(text: str, letter: re.Pattern) -> Iterator[str]:
    """The text in parts of about ``_PART`` characters, cut where no word is."""
    lo = 0
    while len(text) - lo > _PART:
        cut = letter.search(text, lo + _PART)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", drop: int = DROP, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word, n`` of all words of ``shortest`` code points and ``fewest`` occurrences at least, over all texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased.  A run whose CRC-32 of ``id:run`` is
    a multiple of ``drop`` loses the code point at that number modulo its length.  A null id is written as
    nothing, a null text has no words.  Counted per task before the shuffle.
    """

    def run(batches):
        runs, other = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}"), re.compile("[^a-zÀ-ÿ]")
        held: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for part in _parts(body.as_py(), other):
                    for word, n in Counter(runs.findall(part)).items():
                        check = zlib.crc32(word.encode(), start)
                        if check % drop == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= fewest)


def letter_codes(words: list[str]) -> np.ndarray:
    """The code of each word's letter counts, four 64-bit numbers; other characters count as one of the letters."""
    bits = np.zeros((len(words), 256), dtype=np.uint8)
    for i, word in enumerate(words):
        for c, n in Counter(word).items():
            at = ord(c) - 97
            if 0 <= at < LETTERS:
                bits[i, at * FEW_BITS : at * FEW_BITS + min(n, FEW_BITS)] = 1
            else:
                at = LETTERS * FEW_BITS + ord(c) % OTHERS * OTHER_BITS
                bits[i, at : at + min(n, OTHER_BITS)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _apart(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of each code from the box between ``low`` and ``high``."""
    return np.bitwise_count((codes & ~high) | (low & ~codes)).sum(axis=-1, dtype=np.int64)


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1)


def _evenest(bits: np.ndarray) -> tuple[int, int]:
    """The bit (a letter and a count) that cuts codes most evenly, and how many lie on its smaller side."""
    ones = bits.sum(axis=0, dtype=np.int64)
    less = np.minimum(ones, len(bits) - ones)
    return int(less.argmax()), int(less.max())


@dataclass
class Tree:
    """A k-d tree: nodes are cut by one letter's count, boxes hold all codes below a node.

    ``bit[i]`` is negative for a leaf, whose number is ``-bit[i] - 1``; children of other nodes are ``below[i]``.
    """

    bit: list[int] = field(default_factory=list)
    below: list[tuple[int, int]] = field(default_factory=list)
    leaves: int = 0

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        """Number of the leaf each code falls into."""
        found, stack, bits = np.zeros(len(codes), dtype=np.int64), [(0, np.arange(len(codes)))], _bits(codes)
        while stack:
            node, rows = stack.pop()
            if self.bit[node] < 0:
                found[rows] = -self.bit[node] - 1
                continue
            side = bits[rows, self.bit[node]] == 1
            stack += [(self.below[node][0], rows[~side]), (self.below[node][1], rows[side])]
        return found

    def boxes(self, low: np.ndarray, high: np.ndarray) -> None:
        """Set the boxes of all nodes from those of the leaves (an empty leaf: all bits low, none high)."""
        self.low, self.high = np.zeros((len(self.bit), 4), np.uint64), np.zeros((len(self.bit), 4), np.uint64)
        for node in reversed(range(len(self.bit))):  # children come after their parent
            if self.bit[node] < 0:
                self.low[node], self.high[node] = low[-self.bit[node] - 1], high[-self.bit[node] - 1]
            else:
                a, b = self.below[node]
                self.low[node], self.high[node] = self.low[a] & self.low[b], self.high[a] | self.high[b]

    def reached(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a code (its place) and a leaf whose box lies within ``radius`` of it."""
        rows, leaves, stack = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(codes)))]
        while stack:
            node, active = stack.pop()
            active = active[_apart(codes[active], self.low[node], self.high[node]) <= radius]
            if not len(active):
                continue
            if self.bit[node] < 0:
                rows.append(active)
                leaves.append(np.full(len(active), -self.bit[node] - 1))
            else:
                stack += [(child, active) for child in self.below[node]]
        return np.concatenate(rows), np.concatenate(leaves)


def grow(codes: np.ndarray, most: float) -> tuple[Tree, list[np.ndarray]]:
    """A tree that cuts these codes until a leaf holds at most ``most`` of them or all are equal; and the places of each leaf's."""
    tree, members, bits = Tree(), [], _bits(codes)
    stack = [(np.arange(len(codes)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        node = len(tree.bit)
        if parent >= 0:
            tree.below[parent] = (node, tree.below[parent][1]) if side == 0 else (tree.below[parent][0], node)
        cut, less = _evenest(bits[rows]) if len(rows) > most else (0, 0)
        tree.below.append((-1, -1))
        if not less:
            members.append(rows)
            tree.leaves += 1
            tree.bit.append(-tree.leaves)
            continue
        tree.bit.append(cut)
        one = bits[rows, cut] == 1
        stack += [(rows[~one], node, 0), (rows[one], node, 1)]
    return tree, members


def close_pairs(points: np.ndarray, codes: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of codes and of points at L1 distance ``radius`` (of the code) or less, through a tree over the points."""
    tree, members = grow(points, LEAF)
    tree.boxes(np.array([np.bitwise_and.reduce(points[m], axis=0) for m in members]), np.array([np.bitwise_or.reduce(points[m], axis=0) for m in members]))
    stack = [(0, np.arange(len(codes)))]
    while stack:
        node, active = stack.pop()
        active = active[_apart(codes[active], tree.low[node], tree.high[node]) <= radius[active]]
        if not len(active):
            continue
        if tree.bit[node] >= 0:
            stack += [(child, active) for child in tree.below[node]]
            continue
        own = members[-tree.bit[node] - 1]
        for lo in range(0, len(own), 4 * LEAF):  # equal codes may share a leaf
            for at in range(0, len(active), 4096):
                some, held = active[at : at + 4096], own[lo : lo + 4 * LEAF]
                far = np.bitwise_count(codes[some][:, None, :] ^ points[held][None, :, :]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(far <= radius[some][:, None])
                yield some[i], held[j]


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


#: Rows of a cell: its own words, words of the same class from other cells and from itself, and longer words.
_OWN, _VISITOR, _ITSELF, _LONGER = range(4)
_CELL = "cell long, role int, word string, n long, k0 long, k1 long, k2 long, k3 long"


def _codes(columns: list[pa.Array]) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.int64).view(np.uint64).reshape(-1, 4)


def _meet(table: pa.Table) -> pa.Table:
    """Near words among the rows of a cell: word, how many, and the near word of largest ``n`` (the first of equals)."""
    role, words, n = table["role"].to_numpy(), np.array(table["word"].to_pylist(), dtype=object), table["n"].to_numpy()
    codes = _codes([table[c].combine_chunks() if table.num_rows else pa.array([], pa.int64()) for c in CODE])
    own, others = np.flatnonzero(role == _OWN), np.flatnonzero(role != _OWN)
    near: dict[str, list] = {}
    if len(own) and len(others):
        radius = np.where(role[others] == _LONGER, 1, 2)
        for i, j in close_pairs(codes[own], codes[others], radius):
            for x, y in zip(others[i].tolist(), own[j].tolist(), strict=True):
                a, b = words[x], words[y]
                if (role[x] != _ITSELF or a < b) and one_edit(a, b):
                    for word, other, often in ((a, b, int(n[y])), (b, a, int(n[x]))):
                        held = near.setdefault(word, [0, -often, other])
                        held[0] += 1
                        if (-often, other) < (held[1], held[2]):
                            held[1:] = -often, other
    columns = [pa.array(list(near), pa.string()), pa.array([v[0] for v in near.values()], pa.int64())]
    columns += [pa.array([v[1] for v in near.values()], pa.int64()), pa.array([v[2] for v in near.values()], pa.string())]
    return pa.Table.from_arrays(columns, names=["word", "n_near", "less", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, near`` of all words with another one edit away, from unique ``word, n``.

    ``near`` is the near word of largest ``n``, of equals the first in code-point order, ``form_n`` its ``n``.

    Words of one length are cut into cells of about ``HOME`` by a k-d tree whose cuts come from about ``TREE_SAMPLE`` words;
    every word is then indexed, and the cells' boxes are those of all their words, so no pair is lost whatever the sample.
    A word goes to all cells of its length and of the next shorter one whose box is near enough.  In a cell a
    finer tree finds pairs of near letter counts, and the order of their letters decides.
    A cell with more words (equal letters in another order can't be cut) or visitors is dealt to several tasks by hash, so that any two still meet.
    """
    spark = words.sparkSession

    def coded(batches):
        for batch in batches:
            held = batch.column(0).to_pylist()
            codes = letter_codes(held).view(np.int64)
            kind = pa.array([min(len(w), LONGEST_CLASS) for w in held], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, kind, *[pa.array(codes[:, i]) for i in range(4)]], names=["word", "n", "size", *CODE])

    held = save(words.select("word", "n").mapInArrow(coded, "word string, n long, size long, k0 long, k1 long, k2 long, k3 long"), "coded_words")
    sizes = {r["size"]: r["n"] for r in held.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # LONGEST_CLASS rows at most
    total = sum(sizes.values())
    share = min(1.0, TREE_SAMPLE / max(1, total))
    # About TREE_SAMPLE rows.
    sample = held.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))).select("size", *CODE).toArrow()
    of, codes = sample["size"].to_numpy(), _codes([sample[c].combine_chunks() if sample.num_rows else pa.array([], pa.int64()) for c in CODE])
    trees = {size: grow(codes[of == size], HOME * share)[0] for size in sizes}

    def homes(batches):
        for batch in batches:
            size, codes = batch.column(2).to_numpy(), _codes(batch.columns[3:])
            cell = np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                cell[size == s] = trees[s].leaf_of(codes[size == s])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["word", "n", "size", *CODE, "cell"])

    homed = save(held.mapInArrow(homes, "word string, n long, size long, k0 long, k1 long, k2 long, k3 long, cell long"), "homed_words")
    ends = [f(c).alias(f"{name}{c}") for name, f in (("low_", F.bit_and), ("high_", F.bit_or)) for c in CODE]
    # A row for each cell that has words: as many as leaves of trees over the sample.
    boxes = homed.groupBy("size", "cell").agg(*ends).toArrow()
    lows, highs = (_codes([boxes[f"{name}{c}"].combine_chunks() if boxes.num_rows else pa.array([], pa.int64()) for c in CODE]) for name in ("low_", "high_"))
    size_of, leaf_of = boxes["size"].to_numpy(), boxes["cell"].to_numpy()
    for size, tree in trees.items():
        low, high = np.full((tree.leaves, 4), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros((tree.leaves, 4), np.uint64)
        mine = size_of == size
        low[leaf_of[mine]], high[leaf_of[mine]] = lows[mine], highs[mine]
        tree.boxes(low, high)

    def dealt(batches):
        for batch in batches:
            size, codes, home = batch.column(2).to_numpy(), _codes(batch.columns[3:7]), batch.column(7).to_numpy()
            every = np.arange(len(size))
            cells, roles, rows = [size << 40 | home] * 2, [np.full(len(size), _OWN), np.full(len(size), _ITSELF)], [every, every]
            for s in np.unique(size).tolist():
                mine = np.flatnonzero(size == s)
                at, leaf = trees[s].reached(codes[mine], 2)
                later = leaf > home[mine[at]]
                found = [(mine[at[later]], leaf[later], s, _VISITOR)]
                if s - 1 in trees:
                    at, leaf = trees[s - 1].reached(codes[mine], 1)
                    found.append((mine[at], leaf, s - 1, _LONGER))
                for row, leaf, where, role in found:
                    cells.append(where << 40 | leaf)
                    roles.append(np.full(len(row), role))
                    rows.append(row)
            row = pa.array(np.concatenate(rows))
            for lo in range(0, len(row), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                kept = [batch.column(i).take(row[part]) for i in (0, 1, 3, 4, 5, 6)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cells)[part]), pa.array(np.concatenate(roles)[part], pa.int32()), *kept], names=["cell", "role", "word", "n", *CODE]
                )

    met = save(homed.mapInArrow(dealt, _CELL), "dealt_words")
    own = F.col("role") == _OWN
    full = met.groupBy("cell").agg(F.count_if(own).alias("own"), F.count_if(~own).alias("others"))
    full = save(full.select("cell", F.ceil(F.col("own") / HOME).cast("int").alias("p"), F.ceil(F.col("others") / VISITORS).cast("int").alias("q")).filter("p > 1 OR q > 1"), "full_cells")
    parts = met.join(full, "cell", "left").withColumns({"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))})
    draw = F.xxhash64("word", "role")
    one, all_p, all_q = F.array(F.pmod(draw, F.when(own, F.col("p")).otherwise(F.col("q"))).cast("int")), F.sequence(F.lit(0), F.col("p") - 1), F.sequence(F.lit(0), F.col("q") - 1)
    parts = parts.withColumn("i", F.explode(F.when(own, one).otherwise(all_p))).withColumn("j", F.explode(F.when(own, all_q).otherwise(one)))
    schema = "word string, n_near long, less long, near string"
    found = parts.select("cell", "i", "j", "role", "word", "n", *CODE).groupBy("cell", "i", "j").applyInArrow(_meet, schema)
    least = F.min(F.struct("less", "near"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("best"))
    return save(found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("near")), "near_words")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the ``root`` at the end of its forms, from unique ``word, form``; no circles.

    Every round doubles the steps already taken, so there are as many as the logarithm of the longest chain.
    """
    reached = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = save(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", drop: int = DROP, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that is long and frequent enough.

    Words are near if they differ by exactly one inserted, deleted or replaced code point.  ``form`` is the near word of largest
    ``n``, if that is at least ``ratio`` times the word's own, and ``root`` the last of the chain of forms (the word
    itself without one); of equally frequent near words the first in code-point order counts.  ``n_near`` is 0 without near words.
    Null ids are written as nothing, null and empty texts have no words, repeated rows count as often as
    they stand there; no words: no rows.  Other columns, whatever their names, are not read.
    """
    words = save(word_counts(docs, id_column, text, drop, shortest, fewest), "words")
    near = near_words(words)
    rows = words.join(near, "word", "left").withColumn("good", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    rows = save(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("near")).alias("form"), F.when(F.col("good"), F.col("form_n")).alias("form_n")), "forms")
    found = rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
