"""Packing of tokenised documents into sequences of bounded length (operator 3).

Documents are dealt into random groups of about equal text, and every group is packed by itself: whole runs of
`capacity` tokens are sequences of their own, the rests are placed by first-fit decreasing. A tournament tree over
the bins' free room finds the first bin that fits in logarithmic time. At the end of a group, the emptiest bins are
taken apart and cut into the room that is left in the others, so that one bin of a group at most is padded.

Texts are encoded as the tokenizer's library does by default: a text that spells out an added token has that token's id.

Defined results: null text counts as empty (its document is the closing id alone); an empty table gives no rows; texts of
any length are packed whole, in as many sequences as they need; repeated rows are packed one by one; rows with a null id
keep it; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noetica.llm.bpe import encoder
from noetica.llm.common import grouped_documents, released, text_bytes, texts_of

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free room of bins in a complete binary tree; every inner node holds the larger room of its two."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first_fit(self, n: int) -> int:
        """Takes n from the first bin that has it, and returns the bin."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < n:
                i += 1
        room[i] -= n
        place, i = i - self.size, i // 2
        while i:
            room[i] = max(room[2 * i], room[2 * i + 1])
            i //= 2
        return place


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, none of which is over the capacity."""
    tree = Tournament(len(sizes), capacity)
    bins = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i] = tree.first_fit(int(sizes[i]))
    return bins


def pack(totals: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) of documents with so many tokens."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest = totals % capacity
    left = np.flatnonzero(rest)
    bins = first_fit_decreasing(rest[left], capacity)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(int(bins.max()) + 1 if len(bins) else 0)]
    for d, b in zip(left.tolist(), bins.tolist(), strict=True):
        held[b].append((d, int(totals[d] - rest[d]), int(rest[d])))
    used = [sum(p[2] for p in parts) for parts in held]
    # the emptiest bins fill the room of the fullest that have any
    order = sorted((b for b in range(len(held)) if used[b] < capacity), key=lambda b: -used[b])
    fill = 0
    while fill < len(order) - 1:
        target, source = order[fill], order[-1]
        room = capacity - used[target]
        if not room:
            fill += 1
            continue
        d, start, n = held[source].pop()
        take = min(n, room)
        held[target].append((d, start, take))
        used[target] += take
        used[source] -= take
        if take < n:
            held[source].append((d, start + take, n - take))
        if not held[source]:
            order.pop()
    number = 0
    for parts in held:
        at = 0
        for d, start, n in parts:
            pieces.append((d, start, n, number, at))
            at += n
        number += bool(parts)
    for d in np.flatnonzero(totals >= capacity).tolist():
        for start in range(0, int(totals[d] - rest[d]), capacity):
            pieces.append((d, start, capacity, number, 0))
            number += 1
    return pieces


def packed(docs: DataFrame, path: str, capacity: int = 1024, closing_id: int = 0) -> DataFrame:
    """One row per piece. The only shuffle deals texts into groups; a task holds one group of texts and its ids."""

    def run(group: pa.Table) -> pa.Table:
        gid = group.column("gid")[0].as_py()
        ids = [np.append(x, closing_id).astype("<u4") for x in encoder(path).encode_batch(texts_of(group.column("text")))]
        totals = np.array([len(x) for x in ids], np.int64)
        found = np.array(pack(totals, capacity), np.int64).reshape(-1, 5)
        crc = np.array([zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in found[:, :3].tolist()], np.int64)
        doc_id = group.column("doc_id").combine_chunks().take(pa.array(found[:, 0]))
        del ids
        released()
        columns = [doc_id, found[:, 1], found[:, 2], crc, totals[found[:, 0]], (np.int64(gid) << 32) + found[:, 3], found[:, 4]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in COLUMNS.split(", ")])

    return grouped_documents(docs, text_bytes(docs)).groupBy("gid").applyInArrow(run, COLUMNS)
