"""BPE encoding and decoding as bounded-lookahead streaming transducers (operator 3)."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.text import NOT_SPACE, ragged, span_hashes, text_slices

#: Fixed value: the byte-level split pattern that the vocabulary file implies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space beyond ASCII; texts that hold it are split as a whole.
WIDE_SPACE = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Distinct pieces a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Bytes that a transducer takes in at a time.
BLOCK = 1 << 19
_NONE = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a byte-level BPE file, as arrays.

    ``suffix`` marks the last symbol of a word, where the file has such a mark.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in alphabet], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made_by = key[order], order.astype(np.int64), made
        self.left, self.right = left, right
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            body = token.removesuffix(self.suffix) if self.suffix else token
            self.bytes[i] = bytes(back[c] for c in body)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    @property
    def lookahead(self) -> int:
        """Bytes behind a token boundary that suffice to know it for certain.

        What lies beyond the known bytes can only reach to the left through merges of rising
        rank, each of which takes away a symbol that the next one would have needed on its right.
        For every merge, in order of rank, the furthest such reach is that of its right symbol (or
        of the symbols on the right edge it was made of) being taken by an earlier merge.
        """
        if not hasattr(self, "_lookahead"):
            size = len(self.bytes)
            length = [len(b) for b in self.bytes]
            reach = [0] * size  # furthest reach if this symbol is taken by a merge to its right
            edge: list[int] = [-1] * size  # right part of the merge that made the symbol
            furthest = 0
            for a, b, c in zip(self.left.tolist(), self.right.tolist(), self.made_by.tolist(), strict=True):
                far, symbol = 0, b
                while symbol >= 0:
                    far = max(far, reach[symbol])
                    symbol = edge[symbol]
                far += length[b]
                reach[a] = max(reach[a], far)
                furthest = max(furthest, far)
                if edge[c] < 0:
                    edge[c] = b
            self._lookahead = furthest + max(length)
        return self._lookahead

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many pieces of bytes at once, and how many each piece has.

        Every round joins, in each piece, the pairs of least rank from left to right.  ``ended``
        says that a piece's last byte ends a word.
        """
        symbols = self.first[data[ragged(starts, lengths)]]
        counts = lengths.copy()
        ends = np.cumsum(counts)
        if ended and self.suffix:
            at = ends[counts > 0] - 1
            symbols[at] = self.last[data[(starts + lengths - 1)[counts > 0]]]
        piece = np.repeat(np.arange(len(lengths)), counts)
        done_piece, done_place, done_symbol = [], [], []
        place = np.arange(len(symbols))
        rank = np.full(len(symbols), _NONE)  # of each symbol with the next of its piece
        pairs = np.flatnonzero(piece[1:] == piece[:-1])
        rank[pairs] = self._ranks(symbols[pairs], symbols[pairs + 1])
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(symbols))))
            open_ = least < _NONE
            if not open_.all():
                done_piece.append(piece[~open_])
                done_place.append(place[~open_])
                done_symbol.append(symbols[~open_])
                piece, place, symbols, rank, least = piece[open_], place[open_], symbols[open_], rank[open_], least[open_]
                if not len(symbols):
                    break
            run = np.flatnonzero(rank == least)
            if len(run) > 1 and (run[1:] == run[:-1] + 1).any():  # the same symbol thrice or more: pairs from the left
                first = np.concatenate([[True], run[1:] != run[:-1] + 1])
                step = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
                run = run[step % 2 == 0]
            symbols[run] = self.made_by[rank[run]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[run + 1] = False
            symbols, piece, place, rank = symbols[keep], piece[keep], place[keep], rank[keep]
            new = run - np.arange(len(run))  # where the joined symbols are now
            before = new[new > 0] - 1
            pairs = np.concatenate([new[new + 1 < len(symbols)], before])
            rank[new] = _NONE
            inside = piece[pairs] == piece[pairs + 1]
            pairs = pairs[inside]
            rank[pairs] = self._ranks(symbols[pairs], symbols[pairs + 1])
        if not done_place:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        place, symbol, piece = (np.concatenate(x) for x in (done_place, done_symbol, done_piece))
        return symbol[np.argsort(place, kind="stable")], np.bincount(piece, minlength=len(lengths))


class Encoder:
    """Transducer for one piece of any length: bytes in, ids out as soon as nothing later can change them.

    It never holds more than the bytes of one block and the lookahead.
    """

    def __init__(self, merges: Merges, block: int = 1 << 16):
        self.merges, self.block, self.held = merges, block, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(data), self.block):
            self.held += data[lo : lo + self.block]
            if len(self.held) >= self.block + self.merges.lookahead:
                out += self._emit(len(self.held) - self.merges.lookahead)
        return out

    def finish(self) -> list[int]:
        out = self._ids(self.held, True)
        self.held = b""
        return out

    def _ids(self, data: bytes, ended: bool) -> list[int]:
        held = np.frombuffer(data, dtype=np.uint8)
        return self.merges.merge(held, np.zeros(1, np.int64), np.array([len(held)]), ended)[0].tolist()

    def _emit(self, stable: int) -> list[int]:
        out, end = [], 0
        for i in self._ids(self.held, False):
            if end + len(self.merges.bytes[i]) > stable:
                break
            end += len(self.merges.bytes[i])
            out.append(i)
        self.held = self.held[end:]
        return out


class Decoder:
    """State machine from token bytes to text; an unfinished character waits for its next byte."""

    def __init__(self, merges: Merges):
        self.merges, self.machine = merges, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(b"".join([self.merges.bytes[i] for i in ids]))

    def feed_bytes(self, data: bytes | memoryview) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


#: Classes of bytes: letter, digit, white space, other, and apostrophe or a byte that needs the pattern.
_LETTER, _DIGIT, _SPACE, _OTHER, _ODD = range(5)
CLASSES = np.full(256, _OTHER, dtype=np.uint8)
CLASSES[65:91] = CLASSES[97:123] = _LETTER
CLASSES[48:58] = _DIGIT
CLASSES[[32, 9, 10, 11, 12, 13]] = _SPACE
CLASSES[128:192] = _LETTER  # second bytes of the Latin letters with lead bytes C3 to C5
CLASSES[192:] = _ODD
CLASSES[0xC3:0xC6] = _LETTER
CLASSES[39] = _ODD


class Pieces:
    """Ids of distinct pieces of text, remembered over batches up to a bound.

    A piece is an optional blank and a run of other characters, or white space that stands
    alone; no token reaches over its edges.  Pieces are known by a 64-bit hash of their bytes.
    """

    #: Whether every digit is a part of its own.
    single_digits = False
    classes = CLASSES

    def __init__(self, merges: Merges, split: str):
        self.merges, self.pattern = merges, regex.compile(split)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.starts, self.lengths, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        self.held = 0

    def parts(self, piece: str) -> list[bytes]:
        """Parts of a piece that are merged on their own."""
        return [p.encode() for p in self.pattern.findall(piece)]

    def look_up(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pieces with distinct, sorted hashes: all known ids, and where those of each piece start and how many they are."""
        if len(self.keys) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        missing = np.ones(len(hashes), dtype=bool)
        if len(self.keys):
            missing = self.keys[np.minimum(at, len(self.keys) - 1)] != hashes
        if missing.any():
            tokens, counts = self.encode(data, starts[missing], (ends - starts)[missing])
            place = len(self.keys) + np.arange(len(counts))
            self.starts.append(self.held + np.cumsum(counts) - counts)
            self.lengths.append(counts)
            self.ids.append(tokens.astype(np.int32))
            self.held += len(tokens)
            for held in (self.starts, self.lengths, self.ids):
                held[:] = [np.concatenate(held)]
            self.keys = np.insert(self.keys, at[missing], hashes[missing])
            self.place = np.insert(self.place, at[missing], place)
            at = np.searchsorted(self.keys, hashes)
        place = self.place[at]
        return self.ids[0], self.starts[0][place], self.lengths[0][place]

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces one after the other, and how many each has."""
        flat = data[ragged(starts, lengths)]
        kind = self.classes[flat]
        kind[1:][(flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))] = _ODD  # two signs among the letters
        piece_start = np.cumsum(lengths) - lengths
        odd = np.maximum.reduceat(kind, piece_start) == _ODD
        odd |= lengths > 4 * self.merges.lookahead
        cut = np.concatenate([[True], kind[1:] != kind[:-1]])
        if self.single_digits:
            cut |= kind == _DIGIT
        lead = piece_start[(flat[piece_start] == 32) & (lengths > 1)]
        cut[lead + 1] = False
        cut[piece_start] = True
        plain = np.repeat(~odd, lengths)
        number = np.repeat(np.arange(len(lengths)), lengths)
        part_start = np.flatnonzero(cut)
        part_length = np.diff(np.append(part_start, len(flat)))
        owner = number[part_start]
        mine = plain[part_start]
        tokens, counts = self.merges.merge(self.prepare(flat), part_start[mine], part_length[mine])
        per_piece = np.bincount(owner[mine], weights=counts, minlength=len(lengths)).astype(np.int64)
        if not odd.any():
            return tokens, per_piece
        texts = [flat[a : a + n].tobytes().decode() for a, n in zip(piece_start[odd].tolist(), lengths[odd].tolist(), strict=True)]
        other = self._merge([self.parts(t) for t in texts])
        per_piece[odd] = [len(x) for x in other]
        out = np.empty(int(per_piece.sum()), dtype=np.int64)
        is_odd = np.repeat(odd, per_piece)
        out[~is_odd] = tokens
        out[is_odd] = np.concatenate(other)
        return out, per_piece

    def prepare(self, flat: np.ndarray) -> np.ndarray:
        """Bytes of plain pieces as they are merged."""
        return flat

    def _merge(self, parts: list[list[bytes]]) -> list[np.ndarray]:
        flat = [p for piece in parts for p in piece]
        lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        if (lengths > 4 * self.merges.lookahead).any():  # through the transducer, window by window
            each = []
            for part in flat:
                encoder = Encoder(self.merges)
                each.append(encoder.feed(part) + encoder.finish())
            counts = np.array([len(x) for x in each])
            tokens = np.array([i for x in each for i in x], dtype=np.int64)
        else:
            tokens, counts = self.merges.merge(np.frombuffer(b"".join(flat), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
        per = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        sums = np.concatenate([[0], np.cumsum(counts)])
        return np.split(tokens.astype(np.int32), sums[np.cumsum(per)][:-1])


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, and the first piece of every text (one more than texts).

    Of a run of white space before a word, all but the last character stand alone, and the last
    one leads the word if it is a blank, or else stands alone too.  A run that ends a text stands alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = ~NOT_SPACE[data]
    head = np.zeros(n, dtype=bool)
    head[offsets[offsets < n]] = True
    previous = np.concatenate([[False], space[:-1]])
    follows = np.concatenate([~space[1:] & ~head[1:], [False]])  # the next byte belongs to a word of this text
    leads = space & (data == 32) & follows
    start = head | (space != previous)  # first of a text, or of a run
    start &= ~(~space & np.concatenate([[False], leads[:-1]]) & ~head)  # the word's blank has started it already
    start |= space & follows & previous & ~head  # the last of a run of white space
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def encode_column(column: pa.Array, pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of rows: their ids one after the other, and where each row's start (one more than rows)."""
    for _, _, data, offsets in text_slices(column):
        yield encode_slice(data, offsets, pieces)


def encode_slice(data: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where those of each text start (one more than texts)."""
    marks = [s.encode() for s in pieces.merges.special]
    held, n = data.tobytes(), len(offsets) - 1
    whole = np.zeros(n, dtype=bool)
    if not held.isascii():
        for i in range(n):
            row = held[offsets[i] : offsets[i + 1]]
            whole[i] = not row.isascii() and WIDE_SPACE.search(row.decode()) is not None
    if any(m in held for m in marks):
        whole |= [any(m in held[offsets[i] : offsets[i + 1]] for m in marks) for i in range(n)]
    starts, ends, first = unit_bounds(data, offsets)
    if whole.any():  # rows with special tokens or wide white space go through alone
        mine = np.repeat(~whole, np.diff(first))
        starts, ends = starts[mine], ends[mine]
        first = np.concatenate([[0], np.cumsum(np.diff(first) * ~whole)])
    hashes, seen, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    ids, at, lengths = pieces.look_up(hashes, data, starts[seen], ends[seen])
    lengths = lengths[number]
    tokens = ids[ragged(at[number], lengths)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])[first]
    if whole.any():
        rows = [encode_whole(held[offsets[i] : offsets[i + 1]].decode(), pieces) if whole[i] else tokens[bounds[i] : bounds[i + 1]] for i in range(n)]
        tokens = np.concatenate(rows)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return tokens, bounds


class Transducer:
    """Texts as one stream of bytes: ids come out as soon as no later byte can change them.

    No token reaches over the edge of a piece, and whether an edge is one is known a character later.  So
    all up to the last sure edge is emitted: before white space that one character follows which starts a piece
    in any case (the white space before it, if any, is a piece of its own), or between an ASCII letter and a digit.
    What lies behind is held; pieces beyond the merge list's lookahead go through ``Encoder`` window by window.
    Memory follows the block and the longest stretch without a sure edge, and not the text.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.held, self.emitted = pieces, [], 0
        marks = [s.encode() for s in pieces.merges.special]
        self.starts = np.zeros(256, dtype=bool)  # after white space, starts a piece and neither a special token nor wide white space
        self.starts[[*range(48, 58), *range(65, 91), *range(97, 123), *range(195, 225), *range(228, 245)]] = True
        self.starts[[m[0] for m in marks]] = False
        self.blanks = not any(_EDGE.search(m) for m in marks)
        if not self.blanks:
            self.starts[:] = False

    def _sure(self, data: np.ndarray) -> int:
        """The last sure edge in ``data``, 0 if there is none."""
        kind = CLASSES[data]
        ascii_ = data < 128
        edge = np.zeros(len(data), dtype=bool)
        edge[:-1] = ~NOT_SPACE[data[:-1]] & self.starts[data[1:]]
        if self.blanks:
            known = ((kind == _LETTER) | (kind == _DIGIT)) & ascii_
            edge[1:] |= known[1:] & known[:-1] & (kind[1:] != kind[:-1])
        edge[:1] = False
        found = np.flatnonzero(edge)
        return int(found[-1]) if len(found) else 0

    def feed(self, data: np.ndarray, offsets: np.ndarray, more: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sure ids of these texts, the first of which goes on from what is held; with ``more``, the last one goes on later."""
        single = len(offsets) == 2
        end = int(offsets[-1])
        if more:
            last = int(offsets[-2])
            before = self.held[-1][-1:] if single and self.held else data[:0]  # an edge may lie at the seam
            cut = self._sure(np.concatenate([before, data[last:]]))
            if not cut and single:
                self.held.append(data.copy())
                return np.zeros(0, np.int32), np.zeros(2, np.int64)
            end = last + cut - len(before)
        taken = sum(map(len, self.held))
        joined = np.concatenate([*self.held, data]) if taken else data
        offsets = offsets + taken
        offsets[0], offsets[-1] = 0, end + taken
        self.held = [joined[offsets[-1] :].copy()] if more and offsets[-1] < len(joined) else []
        tokens, bounds = encode_slice(joined[: offsets[-1]], offsets, self.pieces)
        self.emitted += len(tokens)
        return tokens, bounds


#: What a special token must not hold if texts are cut at sure edges.
_EDGE = regex.compile(rb"[ \t-\r]|[A-Za-z][0-9]|[0-9][A-Za-z]")


def encode_stream(column: pa.Array, pieces: Pieces, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All rows in order, ``block`` bytes at a time: sure ids, where each row's start, and whether the last row goes on in the next."""
    block = block or BLOCK
    for _, _, data, offsets in text_slices(column):
        transducer, row, at, n = Transducer(pieces), 0, 0, len(offsets) - 1
        while row < n:
            stop = min(at + block, len(data))
            ended = n if stop == len(data) else int(np.searchsorted(offsets, stop, "right")) - 1
            more = ended < n and int(offsets[ended]) < stop
            bounds = np.minimum(np.maximum(offsets[row : ended + 1 + more], at), stop) - at
            yield *transducer.feed(data[at:stop], bounds, more), more
            row, at = ended, stop


def encode_whole(text: str, pieces: Pieces) -> np.ndarray:
    """Ids of a text, with the strings of special tokens taken as such."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)]
    special = pieces.merges.special
    split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    for part in split.split(text) if special else [text]:
        if part in special:
            out.append(np.array([special[part]], dtype=np.int32))
        elif part:
            out += pieces._merge([pieces.parts(part)])
    return np.concatenate(out)


class Spelling:
    """A string of bytes for each id, put together for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def of(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, list[int]]:
        """The strings of all ids joined, and where those from each of ``bounds`` on start."""
        lengths = self.lengths[ids]
        joined = self.data[ragged(self.starts[ids], lengths)]
        return memoryview(joined), np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()


class _Digests:
    """Hashes of one text's ids and of its decoded text, taken in as the ids come."""

    def __init__(self, merges: Merges):
        self.count, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)

    def feed(self, count: int, decimals: memoryview, data: memoryview) -> None:
        """``decimals`` are the ids, each after a comma."""
        self.ids.update(decimals if self.count else decimals[1:])
        self.count += count
        self.text.update(self.decoder.feed_bytes(data).encode())

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(Merges(path), SPLIT)


def encode_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can open.  Strings of
    special tokens become their ids.  Null counts as empty: no tokens, hashes of the empty string.
    Other columns are not read; an empty table gives no rows; ids may be null or repeat.
    """
    kind = docs.schema[id_column].dataType

    def run(batches):
        pieces = _pieces(tokenizer)
        merges = pieces.merges
        spelled, written = Spelling(merges.bytes), Spelling([b",%d" % i for i in range(len(merges.bytes))])
        for batch in batches:
            rows, digests = [], _Digests(merges)
            for tokens, bounds, more in encode_stream(batch.column(1), pieces):
                decimals, decimal_at = written.of(tokens, bounds)
                data, data_at = spelled.of(tokens, bounds)
                last = len(bounds) - 2
                for i in range(last + 1):
                    digests.feed(int(bounds[i + 1] - bounds[i]), decimals[decimal_at[i] : decimal_at[i + 1]], data[data_at[i] : data_at[i + 1]])
                    if i < last or not more:
                        rows.append(digests.finish())
                        digests = _Digests(merges)
            counts, ids_hash, text_hash = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType(
        [
            T.StructField(id_column, kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return docs.select(id_column, text).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of every row; null counts as empty."""
    kind = docs.schema[id_column].dataType

    def run(batches):
        pieces = _pieces(tokenizer)
        for batch in batches:
            rows = [tokens[a:b] for tokens, bounds in encode_column(batch.column(1), pieces) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=[id_column, "ids"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_column, text).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, tokenizer: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id_column`` and ``text`` of every row of token ids; null counts as no tokens, null ids are left out."""
    kind = rows.schema[id_column].dataType

    def run(batches):
        merges = _pieces(tokenizer).merges
        for batch in batches:
            texts = []
            for held in batch.column(1).to_pylist():
                decoder = Decoder(merges)
                texts.append(decoder.feed(i for i in held or [] if i is not None) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("text", T.StringType())])
    return rows.select(id_column, ids).mapInArrow(run, schema)
