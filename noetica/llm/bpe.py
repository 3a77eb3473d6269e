"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokenisation without a regex: code points become classes by table lookup, classes become symbols of a small
automaton, and the automaton's state before every code point comes from an associative scan that composes
transition functions. The finite set of composed functions is closed beforehand, so the scan is a few table
gathers over whole batches of documents. Slices between boundaries feed a cached pair merging; token offsets in
the slices' bytes let any token range be decoded on its own.

Defined results: null text counts as empty (no tokens, digests of the empty string); an empty table gives no rows;
repeated rows each get their own result; a text of any length is encoded whole, in a batch of its own if it is long, and a
slice of any length in n log n; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noetica.llm.common import batches, texts_of

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE, END, QUOTE = range(7)
# Symbols: letter, number, other, quote that opens a contraction of one or two letters, last white space before
# something else (blank or not), any other white space, end of a document.
L, N, O, A1, A2, SL, WL, MID, X = range(9)
# States: anything starts anew, in letters, in numbers, in others, in white space, after a joining blank, one or two letters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, IN_W, JOIN, C1, C2 = range(8)
# White space of the pattern's \s, and the contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Code points of a batch that are scanned together.
BATCH_CHARS = 1 << 20
#: Different slices that a worker's cache holds, and the longest that are rows of its table.
CACHE_SLICES, SHORT = 500_000, 15
#: The rank of pairs that never merge.
NEVER = np.iinfo(np.int32).max


@cache
def class_table() -> np.ndarray:
    classes = np.full(0x110001, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            classes[cp] = LETTER
        elif kind == "N":
            classes[cp] = NUMBER
    classes[WHITE_SPACE] = WHITE
    classes[0x20], classes[0x27], classes[0x110000] = SPACE, QUOTE, END
    return classes


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and starts[state, symbol]: whether a slice starts at the symbol."""
    goes = {L: IN_L, N: IN_N, O: IN_O, A1: C1, A2: C2, SL: JOIN, WL: FRESH, MID: IN_W, X: FRESH}
    nxt = np.array([[goes[s] for s in range(9)]] * 8, np.uint8)
    starts = np.ones((8, 9), bool)
    starts[IN_L, L] = starts[IN_N, N] = starts[IN_W, MID] = False
    for state in (IN_O, JOIN):  # a quote in such a run opens nothing
        nxt[state, [A1, A2]] = IN_O
        starts[state, [O, A1, A2]] = False
    starts[JOIN, [L, N]] = False
    nxt[C2], nxt[C1] = C1, FRESH
    starts[[C1, C2]] = False
    return nxt, starts


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(compose, constant, value, starts): the closed set of transition functions with its composition table.

    Function k < 9 is that of symbol k; constant ones, of which there are as many as states at most, come next. constant[k]: it
    maps every state to value[k].
    """
    nxt, starts = _transitions()
    found = {tuple(nxt[:, s].tolist()): s for s in range(9)}
    functions = [tuple(nxt[:, s].tolist()) for s in range(9)]
    if len(found) < 9:  # symbols with equal functions keep their own number
        found = {f: i for i, f in reversed(list(enumerate(functions)))}
    grown = 0
    while grown < len(functions):
        grown = len(functions)
        for f in list(functions):
            for g in list(functions):
                h = tuple(g[x] for x in f)
                if h not in found:
                    found[h] = len(functions)
                    functions.append(h)
    # symbols keep their numbers, constant functions come next
    functions[9:] = sorted(functions[9:], key=lambda f: len(set(f)) > 1)
    found |= {f: i for i, f in enumerate(functions) if i >= 9}
    table = np.array([[found[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint8 if len(functions) < 256 else np.uint16)
    constant = np.array([len(set(f)) == 1 for f in functions])
    return table, constant, np.array([f[FRESH] for f in functions], np.uint8), starts


@cache
def _byte_maps() -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Maps of bytes for bytes.translate: byte to class, class to symbol, class to whether it is white or an end, symbol to the constant
    function that it is for every state but C1 and C2, and function to its value."""
    classes = class_table()[:128].tobytes() + bytes([OTHER]) * 128
    symbols = bytes([L, N, O, SL, WL, X, O]) + bytes(249)
    white = bytes(int(c in (SPACE, WHITE, END)) for c in range(256))
    _, constant, value, _ = automaton()
    of_state = {int(value[f]): f for f in np.flatnonzero(constant).tolist()}
    nxt = _transitions()[0]
    settled = bytes(of_state.get(int(nxt[FRESH, s]), 0) for s in range(9)) + bytes(247)
    return classes, symbols, white, settled, value[:256].tobytes().ljust(256, b"\0")


def _mapped(values: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(values.tobytes().translate(table)), np.uint8)


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from FRESH, by a scan of composed transition functions.

    Behind no contraction, a symbol's function is constant. The others double their span, each with the function that
    ends where its own begins, until they are constant too.
    """
    compose, constant, _, _ = automaton()
    settled, value = _byte_maps()[3:]
    scanned = _mapped(symbols, settled).astype(compose.dtype)
    opened = np.flatnonzero((symbols == A1) | (symbols == A2))
    going = np.unique(np.concatenate([opened, opened + 1, opened + 2]))
    going, step = going[going < len(symbols)], 1
    scanned[going] = symbols[going]
    start = next(f for f in np.flatnonzero(constant) if automaton()[2][f] == FRESH)
    while len(going := going[~constant[scanned[going]]]):
        scanned[going] = compose[np.where(going >= step, scanned[going - step], start), scanned[going]]
        step *= 2
    before = np.empty(len(symbols), np.uint8)
    before[:1] = FRESH
    before[1:] = _mapped(scanned[:-1].astype(np.uint8), value)
    return before


def code_point_classes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(class of each code point, place of its first byte) of n bytes of UTF-8 with 4 bytes more behind them; no places if all are ASCII."""
    to_class = _byte_maps()[0]
    if not (data[:n] >= 0x80).any():
        return _mapped(data[:n], to_class), None
    lead = np.flatnonzero((data[:n] & 0xC0) != 0x80)
    bytes_ = data[lead]
    classes = _mapped(bytes_, to_class)
    more = np.flatnonzero(bytes_ >= 0xC0)
    first, at = bytes_[more].astype(np.int32), lead[more]
    rest = [data[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two, three = (first & 0x1F) << 6 | rest[0], (first & 0x0F) << 12 | rest[0] << 6 | rest[1]
    classes[more] = class_table()[np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]))]
    return classes, lead


def slice_starts(classes: np.ndarray, data: np.ndarray, lead: np.ndarray | None) -> np.ndarray:
    """Whether a slice starts at each code point; documents end with the class END, as the last one does."""
    _, to_symbol, white, _, _ = _byte_maps()
    symbols, blank = _mapped(classes, to_symbol), _mapped(classes, white).view(bool)
    within = blank & (classes != END)
    within[:-1] &= blank[1:]
    symbols[within] = MID
    if len(quotes := np.flatnonzero(classes == QUOTE)):
        at = quotes if lead is None else lead[quotes]
        one, two = data[at + 1], data[at + 2]
        symbols[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = A1
        for a, b in TWO_LETTERS:
            symbols[quotes[(one == ord(a)) & (two == ord(b))]] = A2
    starts = automaton()[3]
    return _mapped(states_before(symbols) * np.uint8(starts.shape[1]) + symbols, starts.astype(np.uint8).tobytes() + bytes(256 - starts.size)).view(bool)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (counts[i] of them) of every i, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Table:
    """Different pairs of 64-bit words, found by open addressing over arrays; pairs are compared whole, so equal hashes confuse nothing."""

    def __init__(self, capacity: int):
        bits = max(8, (2 * capacity - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.first, self.second = np.empty(capacity, np.uint64), np.empty(capacity, np.uint64)
        self.n = 0

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = first * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += second * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The row of each pair, -1 where there is none."""
        slot = self._slot(first, second)
        row = self.slots[slot]
        going = np.flatnonzero((row >= 0) & ((self.first[row] != first) | (self.second[row] != second)))
        while len(going):
            slot[going] = (slot[going] + 1) & self.mask
            now = self.slots[slot[going]]
            row[going] = now
            going = going[(now >= 0) & ((self.first[now] != first[going]) | (self.second[now] != second[going]))]
        return row

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        """Appends different pairs that are not there yet."""
        rows = np.arange(self.n, self.n + len(first), dtype=np.int32)
        self.first[rows], self.second[rows] = first, second
        self.n += len(first)
        slot = self._slot(first, second)
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & self.mask


class Pairs:
    """What pairs of numbers below 2^32 map to, in arrays, by open addressing; NEVER for all other pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray):
        bits = max(8, (4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.full(1 << bits, NEVER, np.int32)
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        while len(keys):
            free = self.values[slot] == NEVER
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            there = self.keys[slot] == keys
            self.values[slot[there]] = values[there]  # of two that came for one place, the key's own value
            keys, values, slot = keys[~there], values[~there], (slot[~there] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        at = self.keys[slot]
        out = self.values[slot]
        going = np.flatnonzero((at != keys) & (out != NEVER))
        out[going] = NEVER
        while len(going):
            slot[going] = next_ = (slot[going] + 1) & self.mask
            hit = self.keys[next_] == keys[going]
            out[going[hit]] = self.values[next_[hit]]
            going = going[~hit & (self.values[next_] != NEVER)]
        return out


def packed_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and size of spans of up to SHORT bytes as two words; data goes on for 16 bytes behind the last span."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    first = eights[starts] & masks[np.minimum(sizes, 8)]
    second = sizes.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(sizes > 8)
    second[more] |= eights[starts[more] + 8] & masks[sizes[more] - 8]
    return first, second


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each different pair, which of these each pair is)."""
    order = np.lexsort((second, first))
    new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))[: len(order)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


class Merger:
    """Merges slices' bytes by rank, lowest first, leftmost among equals; a cache holds the ids of merged slices in one array.

    Slices of up to SHORT bytes are rows of a Table, longer ones keys of a dictionary: a slice is only ever taken for itself.
    """

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]] | None = None):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        if merges is None:  # any two tokens that make a token merge, by the rank of the whole
            merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array(merges, np.int64).reshape(-1, 3)
        self.pairs = Pairs(*pairs.T)
        self.of_two_bytes = self.pairs.of(self.of_byte[np.arange(1 << 16) >> 8], self.of_byte[np.arange(1 << 16) & 255])
        self.merges = merges
        self._reset(CACHE_SLICES)

    def _reset(self, capacity: int) -> None:
        self.capacity, self.table = capacity, Table(capacity)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.begins, self.counts = np.zeros(capacity, np.int64), np.zeros(capacity, np.int32)
        self.used = np.zeros(capacity, bool)
        self.flat, self.filled = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where ids are put, behind those that are held."""
        begin, end = self.filled, self.filled + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:begin], np.zeros(max(len(ids), begin), np.int32)])
        self.flat[begin:end] = ids
        self.filled = end
        return begin

    def _add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        rows = slice(self.table.n, self.table.n + len(first))
        self.table.add(first, second)
        self.begins[rows] = self._keep(ids) + np.cumsum(counts) - counts
        self.counts[rows] = counts

    def _make_room(self, n: int) -> None:
        """For n new slices: of the old ones those stay that were used since the last time, if there is room for as many again."""
        rows = np.flatnonzero(self.used[: self.table.n])
        table, begins, counts, flat = self.table, self.begins[rows], self.counts[rows], self.flat
        self._reset(max(CACHE_SLICES, 2 * n))
        if 2 * (len(rows) + n) <= self.capacity:
            self._add(table.first[rows], table.second[rows], flat[ragged(begins, counts)], counts)

    def _short(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rows of the table for slices of up to SHORT bytes, new ones merged and added."""
        rows = self.table.find(first, second)
        if len(new := np.flatnonzero(rows < 0)):
            one, of = distinct_pairs(first[new], second[new])
            if self.table.n + len(one) > self.capacity:
                self._make_room(len(one))
                return self._short(first, second)
            rows[new] = self.table.n + of
            first, second = first[new[one]], second[new[one]]
            sizes = (second >> np.uint64(56)).astype(np.int64)
            data = np.stack([first, second], 1).view(np.uint8)[:, :SHORT]
            self._add(first, second, *self.merge_all(data, sizes))
        self.used[rows] = True
        return rows

    def __call__(self, joined: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begins, counts): where the ids of each slice lie in `flat`, until the next call."""
        if self.filled > 8 * CACHE_SLICES or len(self.long) > CACHE_SLICES // 8:
            self._reset(CACHE_SLICES)
        begins, counts = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        is_long = sizes > SHORT
        at = np.flatnonzero(~is_long)
        rows = self._short(*packed_words(data, starts[at], sizes[at]))
        begins[at], counts[at] = self.begins[rows], self.counts[rows]
        at = np.flatnonzero(is_long)
        pieces = [joined[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
        self._merge_long([p for p in set(pieces) if p not in self.long])
        if pieces:
            found = np.array([self.long[p] for p in pieces], np.int64)
            begins[at], counts[at] = found[:, 0], found[:, 1]
        return begins, counts

    def _merge_long(self, pieces: list[bytes]) -> None:
        for low, width in ((SHORT, 32), (32, 64), (64, 128)):
            own = [p for p in pieces if low < len(p) <= width]
            if own:
                sizes = np.array([len(p) for p in own])
                ids, counts = self.merge_all(np.frombuffer(b"".join(p.ljust(width, b"\0") for p in own), np.uint8).reshape(-1, width), sizes)
                begins = self._keep(ids) + np.cumsum(counts) - counts
                self.long.update(zip(own, zip(begins.tolist(), counts.tolist(), strict=True), strict=True))
        for piece in pieces:
            if len(piece) > 128:
                ids = self.merge(piece)
                self.long[piece] = self._keep(ids), len(ids)

    def merge_all(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each) of slices, the rows of a matrix of bytes; each round makes every slice's best merge."""
        n, width = data.shape
        column = np.arange(width)
        ids = self.of_byte[data].ravel()
        best = np.full((n, width), NEVER, np.int32)
        best[:, :-1] = self.of_two_bytes[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]]
        best[column >= sizes[:, None] - 1] = NEVER
        stays = (column < sizes[:, None]).ravel()
        # a linked list in each row: the token after and before each
        after, before = np.tile(column + 1, n), np.tile(column - 1, n)
        row = np.flatnonzero(best.min(1, initial=NEVER) < NEVER)
        flat = best.ravel()
        while len(row):
            place = best[row].argmin(1)
            base = row * width
            at = base + place
            merged = flat[at]
            if not (going := merged < NEVER).all():
                row, place, base, at, merged = row[going], place[going], base[going], at[going], merged[going]
            gone = base + after[at]
            then = after[gone]
            ids[at], after[at], stays[gone], flat[gone] = merged, then, False, NEVER
            flat[at] = NEVER
            some = np.flatnonzero(then < sizes[row])
            right = base[some] + then[some]
            before[right] = place[some]
            back = before[at]
            more = np.flatnonzero(back >= 0)
            left = base[more] + back[more]
            flat[np.concatenate([at[some], left])] = self.pairs.of(np.concatenate([merged[some], ids[left]]), np.concatenate([ids[right], merged[more]]))
        return ids[stays], stays.reshape(n, width).sum(1)

    def merge(self, piece: bytes) -> np.ndarray:
        """One slice of any length, by a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n, pair = len(ids), self._pair_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged otherwise
            ids[i], ids[j], after[i] = r, -1, after[j]
            if (j := after[i]) < n:
                before[j] = i
                if (q := pair(r, ids[j])) != NEVER:
                    heapq.heappush(heap, (q, i, r, ids[j]))
            if (k := before[i]) >= 0 and (q := pair(ids[k], r)) != NEVER:
                heapq.heappush(heap, (q, k, ids[k], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _pair_of(self, left: int, right: int) -> int:
        if not hasattr(self, "_of_pair"):  # only long slices need it
            self._of_pair = {(a, b): r for a, b, r in self.merges}
        return self._of_pair.get((left, right), NEVER)


class Spelling:
    """A byte string for each of the numbers from 0 on, in one array."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.counts = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(their strings one after the other, where each ends)."""
        counts = self.counts[numbers]
        return self.data[ragged(self.starts[numbers], counts)].tobytes(), np.cumsum(counts)


class Encoder:
    """Byte-level BPE over a vocabulary file: ranks (.tiktoken) or a tokenizers model (.json).

    A model's added tokens are cut out of a text first, as its library does, unless `special` is false: then they are
    ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        ranks, merges, added = _vocabulary(path)
        self.merger = Merger(ranks, merges)
        self.added = added if special else {}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        tokens = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
        self.bytes = Spelling([tokens.get(i, b"") for i in range(max(tokens) + 1)])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.cut is not None and any(t in text for text in texts for t in self.added):
            return self._around_added(texts)
        out: list[np.ndarray] = []
        for a, b in batches(texts, [len(t) for t in texts], BATCH_CHARS):
            out += self._encode(texts[a:b])
        return out

    def _around_added(self, texts: list[str]) -> list[np.ndarray]:
        """What lies between added tokens is encoded by itself."""
        between = [self.cut.split(t) for t in texts]
        flat = [p for parts in between for p in parts]
        ids = iter([x for a, b in batches(flat, [len(p) for p in flat], BATCH_CHARS) for x in self._encode(flat[a:b])])
        out = []
        for text, parts in zip(texts, between, strict=True):
            found = [np.array([self.added[m]], np.int32) for m in self.cut.findall(text)]
            pieces = [next(ids) for _ in parts]
            out.append(np.concatenate([x for pair in zip(pieces, [*found, np.empty(0, np.int32)], strict=True) for x in pair]))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        joined = b"\0".join(raw) + b"\0"  # a byte for each end
        n = len(joined)
        data = np.frombuffer(joined + bytes(16), np.uint8)
        classes, lead = code_point_classes(data, n)
        closes = np.cumsum([len(r) + 1 for r in raw]) - 1
        classes[closes if lead is None else np.searchsorted(lead, closes)] = END
        starts = np.flatnonzero(slice_starts(classes, data, lead))
        starts = starts if lead is None else lead[starts]
        begins, counts = self.merger(joined, data, starts, np.diff(np.append(starts, n)))
        counts[np.searchsorted(starts, closes)] = 0
        ids = self.merger.flat[ragged(begins, counts)]
        return np.split(ids, np.cumsum(counts)[np.searchsorted(starts, closes)][:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.of(ids)[0]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the text, and the end: ids[i:j] decode to the bytes between offsets i and j."""
        return np.append(0, np.cumsum(self.bytes.counts[ids]))


def _vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]] | None, dict[str, int]]:
    """(ranks, merges or None for all that the ranks allow, added tokens)."""
    with open(path, "rb") as f:
        if path.endswith(".tiktoken"):
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, None, {}
        model = json.load(f)
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    # byte-level files write bytes as printable characters: those that print stand for themselves, the rest follow from 256 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ids = {t: i for t, i in model["model"]["vocab"].items() if i not in added.values()}
    parts = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in parts]
    if any(x[2] >= y[2] for x, y in zip(merges, merges[1:], strict=False)):
        raise ValueError("the ids of merged tokens must rise with the order of the merges")
    return {bytes(byte_of[c] for c in token): i for token, i in ids.items()}, merges, added


@cache
def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker process."""
    return Encoder(path, special)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ends) for every row: the token ids of the whole text and the byte offset at which each token ends.

    A map over the scan: no shuffle, and a task holds one Arrow batch at a time.
    """

    def run(arrived):
        use = encoder(path)
        for batch in arrived:
            ids = use.encode_batch(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([use.offsets(x)[1:] for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, ends array<long>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text and decodes its ids again."""

    def run(arrived):
        use = encoder(path)
        decimal = Spelling([b"%d," % i for i in range(len(use.bytes.counts))])
        for batch in arrived:
            texts = texts_of(batch.column("text"))
            n, of_ids, of_bytes = [], [], []
            for a, b in batches(texts, [len(t) for t in texts], BATCH_CHARS):
                ids = use.encode_batch(texts[a:b])
                sizes = np.array([len(x) for x in ids])
                ends = np.append(0, np.cumsum(sizes))
                joined = np.concatenate(ids)
                n.append(sizes)
                for spelling, out, tail in ((decimal, of_ids, 1), (use.bytes, of_bytes, 0)):
                    data, of_token = spelling.of(joined)
                    cuts = np.append(0, of_token)[ends].tolist()
                    out += [hashlib.sha256(data[x : max(x, y - tail)]).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate([*n, np.empty(0, np.int64)]), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
