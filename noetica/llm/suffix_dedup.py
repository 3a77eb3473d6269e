"""Dedup of repeated byte strings by an enhanced suffix array and its common-prefix interval tree (operator 5).

Every string of `width` bytes picks an anchor: the gram of ANCHOR bytes inside it with the least hash, the leftmost
among equals. Equal strings pick equal anchors, so runs of neighbouring strings with one anchor (pieces, under
2 * width bytes each) can be dealt out by anchor. Three rounds over random groups of documents:

1. groups send their distinct anchors (32 bits and a number of pieces each, in packed rows) and learn which occur in other
   groups, and which have over HOT pieces in all: such pieces are cut into single strings, each with a key of its own;
2. pieces with an anchor that occurs in two documents go, once per group and with the least id, to the bucket of their key,
   which sorts their suffixes into an enhanced suffix array and finds the maximal repeats by a stack scan of the
   common-prefix intervals, whose suffixes are all the occurrences; what repeats as a whole is in the array twice;
3. buckets answer with a bit for each string of a piece that a smaller id has too, and groups mark what the answers cover and
   write what is left; or with the repeats of each piece, and groups list their occurrences (maximal_repeats_of).

A passage that a third of all documents share thus costs each group one piece, and no task sees all of its occurrences.
A maximal repeat is cut at the borders of its pieces: it is maximal among the strings of one anchor.

Defined results: null text counts as empty; texts under `width` bytes lose nothing; an empty table gives no rows; texts of any
length are taken whole (one long text makes its group large, not a bucket); rows with equal id and text are one
document and get equal results; rows with equal ids never remove anything from each other; a null id is the least;
other columns of the input, whatever their names, are ignored (deduplicated() keeps them all).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noetica.llm.blobs import SENT, answered, gathered, replies, scattered, sending_order
from noetica.llm.bpe import ragged
from noetica.llm.common import carried_documents, grouped_documents, groups_for, released, text_bytes, uncarried

#: Bytes of an anchor; width - ANCHOR + 1 strings share one at most, and that many bits an answer has.
ANCHOR = 24
NULL_ID = -(1 << 63)
#: Pieces of an anchor over all groups from which on they are cut into single strings.
HOT = 4096
#: Answers about an anchor.
ALONE, SHARED, TOO_MANY = range(3)
#: Positions that are hashed together.
SLAB = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
#: Marks of a piece that a group has several times, and of one that its bucket found to repeat as a whole.
_SEVERAL, _WHOLE = np.uint16(1 << 15), np.uint32(1 << 31)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _eights(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from every position, as a number; data has eight bytes more than positions."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def anchors(data: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of the string at each of n positions; data goes on for width + 8 bytes after them."""
    reach = width - ANCHOR + 1
    places, hashes = np.empty(n, np.int32), np.empty(n, np.uint64)
    for a in range(0, n, SLAB):
        b = min(n, a + SLAB)
        eights = _eights(data[a : b + width + 8])
        m = b - a + reach - 1
        grams = eights[:m] * _FACTORS[0] + eights[8 : 8 + m] * _FACTORS[1]
        grams ^= grams >> np.uint64(32)
        grams += eights[16 : 16 + m]
        grams *= _FACTORS[2]
        grams ^= grams >> np.uint64(29)
        grams *= _FACTORS[0]
        least = (grams & ~_PLACE) | np.arange(m, dtype=np.uint64)
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        at = (least[: b - a] & _PLACE).astype(np.int64)
        places[a:b], hashes[a:b] = at + a, grams[at]
    return places, hashes


class _Group:
    """A group's distinct documents in order, with the pieces of each."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        ids = [NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()]
        keys = list(zip(ids, [(t or "").encode() for t in table.column("text").to_pylist()], strict=True))
        docs = sorted(set(keys))
        place = {k: i for i, k in enumerate(docs)}
        self.rows = [place[k] for k in keys]
        self.ids = np.array([d for d, _ in docs], np.int64)
        self.joined = b"".join(t for _, t in docs)
        self.ends = np.cumsum([len(t) for _, t in docs])
        self.data = np.frombuffer(self.joined + bytes(width + 16), np.uint8)
        n = len(self.joined)
        whole = np.zeros(n + 1, np.int8)  # strings that lie in one document
        sizes = np.diff(self.ends, prepend=0)
        some = sizes >= width
        np.add.at(whole, (self.ends - sizes)[some], 1)
        np.add.at(whole, (self.ends - width + 1)[some], -1)
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
        places, hashes = anchors(self.data, n, width)
        starts = whole & np.append(True, (places[1:] != places[:-1]) | ~whole[:-1])[:n]
        stops = whole & np.append((places[1:] != places[:-1]) | ~whole[1:], True)[:n]
        self.first = np.flatnonzero(starts)
        self.last = np.flatnonzero(stops)
        self.anchor = hashes[self.first]
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        # distinct anchors, and whether two ids here have them
        order = np.lexsort((self.ids[self.doc], self.anchor))
        new = np.append(True, np.diff(self.anchor[order]) != 0)[: len(order)]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.distinct = self.anchor[order[new]]
        at = np.flatnonzero(new)
        own = self.ids[self.doc[order]]
        self.twice = own[at] != own[np.append(at[1:], len(order)) - 1] if len(order) else np.empty(0, bool)

    def send_anchors(self, gid: int, n_buckets: int) -> tuple[pa.Table, np.ndarray]:
        # different pieces of an anchor, as told by their ends and length
        eights = _eights(self.data)
        ends = eights[self.first] * _FACTORS[0] + eights[self.last + self.width - 8] * _FACTORS[1] + (self.last - self.first).astype(np.uint64)
        order = np.lexsort((ends, self.of))
        new = np.append(True, (np.diff(ends[order]) != 0) | (np.diff(self.of[order]) != 0))[: len(order)]
        pieces = np.minimum(np.bincount(self.of[order[new]], minlength=len(self.distinct)), 0xFFFF)
        return scattered(gid, _bucket(self.distinct, n_buckets), [(self.distinct & np.uint64(0xFFFFFFFF)).astype("<u4"), pieces.astype("<u2")], n_buckets)

    def candidates(self, gid: int, n_buckets: int, answers: pa.Table) -> None:
        """Keeps the pieces whose anchor two documents have, those of hot anchors as single strings, and the distinct ones with their least id."""
        told = answered(answers, sending_order(_bucket(self.distinct, n_buckets), n_buckets), "u1")
        kept = np.flatnonzero((self.twice | (told != ALONE))[self.of])
        hot = told[self.of[kept]] == TOO_MANY
        whole, cut = kept[~hot], kept[hot]
        counts = self.last[cut] - self.first[cut] + 1
        singles = ragged(self.first[cut], counts)
        keys = np.array([xxhash.xxh64_intdigest(self.joined[a : a + self.width]) for a in singles.tolist()], np.uint64)
        begin = np.concatenate([self.first[whole], singles])
        order = np.argsort(begin, kind="stable")  # documents are in order of id
        self.begin, self.end = begin[order], np.concatenate([self.last[whole], singles])[order]
        self.of_doc = np.concatenate([self.doc[whole], np.repeat(self.doc[cut], counts)])[order]
        key = np.concatenate([self.anchor[whole], keys])[order]
        index: dict[bytes, int] = {}
        spans = zip(self.begin.tolist(), (self.end + self.width).tolist(), strict=True)
        self.piece = np.array([index.setdefault(self.joined[a:b], len(index)) for a, b in spans], np.int64)
        self.pieces = list(index)
        _, first = np.unique(self.piece, return_index=True)
        self.least, self.key = self.ids[self.of_doc[first]], key[first]

    def send_pieces(self, gid: int, n_buckets: int) -> tuple[pa.Table, np.ndarray]:
        sizes = np.fromiter(map(len, self.pieces), "<u2", len(self.pieces))
        sizes[np.bincount(self.piece, minlength=len(sizes)) > 1] |= _SEVERAL
        table, order = scattered(gid, _bucket(self.key, n_buckets), [self.key, self.least, sizes], n_buckets)
        texts, at, blobs = [self.pieces[i] for i in order.tolist()], 0, []
        for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True):
            blobs.append(blob + b"".join(texts[at : at + n]))
            at += n
        return table.set_column(3, "blob", pa.array(blobs, pa.binary())), order

    def removed(self, gid: int, n_buckets: int, answers: pa.Table) -> np.ndarray:
        """Whether each byte is covered by a string that starts in a document with a smaller id."""
        bits = answered(answers, sending_order(_bucket(self.key, n_buckets), n_buckets), "<u4")
        edges = np.zeros(len(self.joined) + 1, np.int32)
        later = (self.ids[self.of_doc] > self.least[self.piece]) & (bits[self.piece] & _WHOLE > 0)
        np.add.at(edges, self.begin[later], 1)
        np.add.at(edges, self.end[later] + self.width, -1)
        own = np.flatnonzero(~later)
        own = own[bits[self.piece[own]] > 0]
        marks = (bits[self.piece[own]][:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        which, step = np.nonzero(marks)
        at = self.begin[own[which]] + step
        fits = at <= self.end[own[which]]
        np.add.at(edges, at[fits], 1)
        np.add.at(edges, at[fits] + self.width, -1)
        return np.cumsum(edges[:-1], dtype=np.int32) > 0

    def occurrences(self, n_buckets: int, answers: pa.Table) -> pa.Table:
        """(repeat, length, doc_id, start) of all occurrences here of the repeats that the buckets answer with."""
        sent = sending_order(_bucket(self.key, n_buckets), n_buckets)
        by_bucket = np.bincount(_bucket(self.key, n_buckets), minlength=n_buckets)
        begins = np.cumsum(by_bucket) - by_bucket
        names, pieces, places, lengths = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for bucket, n, blob in zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            pieces.append(sent[begins[bucket] + np.frombuffer(blob, "<u4", n)])
            places.append(np.frombuffer(blob, "<u2", n, 4 * n).astype(np.int64))
            lengths.append(np.frombuffer(blob, "<u2", n, 6 * n).astype(np.int64))
            names += [blob[8 * n + 16 * i : 8 * n + 16 * i + 16].hex() for i in range(n)]
        piece, place, length = np.concatenate(pieces), np.concatenate(places), np.concatenate(lengths)
        # every occurrence of each piece
        order = np.argsort(self.piece, kind="stable")
        counts = np.bincount(self.piece, minlength=len(self.pieces))
        firsts = np.cumsum(counts) - counts
        which = np.repeat(np.arange(len(piece)), counts[piece])
        at = order[ragged(firsts[piece], counts[piece])]
        doc = self.of_doc[at]
        ids, start = self.ids[doc], self.begin[at] + place[which] - np.append(0, self.ends[:-1])[doc]
        columns = [pa.array(names, pa.string()).take(pa.array(which)), pa.array(length[which]), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(start, pa.int64())]
        return pa.table(columns, [c.split()[0] for c in REPEATS.split(", ")])


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(36)).astype(np.int64) % n_buckets


def _shared_anchors(table: pa.Table, hot: int) -> pa.Table:
    """For every anchor sent to a bucket, whether another group sent it too, and whether they have too many pieces of it."""
    gids, counts, (keys, pieces) = gathered(table, ["<u4", "<u2"])
    _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
    told = np.where(times > 1, SHARED, ALONE)
    told[np.bincount(of, weights=pieces, minlength=len(times)) > hot] = TOO_MANY
    return replies(table.column("bucket")[0].as_py(), gids, counts, told[of].astype("u1"))


def suffix_array(texts: list[bytes], least: int, inner: np.ndarray | None = None, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, common, left) of the sorted suffixes with `least` bytes or more.

    Texts that are not `inner` have but their whole as a suffix, and those in `twice` have it once more. common[i]: bytes that suffix i shares with the one before it; left[i]: the byte before it, 256 at a text's start.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - least + 1, 0)
    if inner is not None:
        counts = np.where(inner, counts, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if twice is not None:
        text, offset = np.append(text, twice), np.append(offset, np.zeros(len(twice), np.int64))
    if not len(text):
        none = np.empty(0, np.int64)
        return none, none, none, none
    rest = sizes[text] - offset
    longest = int(rest.max())
    joined = b"".join(texts)
    data = np.frombuffer(joined + bytes(longest + 16), np.uint8)
    eights = _eights(data, ">u8")
    at = begins[text] + offset
    words = []
    for k in range(0, longest, 8):
        word = eights[at + k].astype(np.uint64)
        inside = np.clip(rest - k, 0, 8).astype(np.uint64)
        word[inside == 0] = 0
        cut = (inside > 0) & (inside < 8)
        shift = (np.uint64(8) - inside[cut]) * np.uint64(8)
        word[cut] = (word[cut] >> shift) << shift
        words.append(word)
    order = np.lexsort((rest, *reversed(words)))
    common, open_ = np.zeros(len(order), np.int64), np.append(False, np.ones(len(order) - 1, bool))
    for word in words:
        word = word[order]
        differs = np.zeros_like(word)
        differs[1:] = word[1:] ^ word[:-1]
        same = open_ & (differs == 0)
        ends = open_ & ~same
        common[same] += 8
        if ends.any():
            x = differs[ends]
            lead = np.zeros(len(x), np.int64)
            for b in range(1, 8):
                lead += x < (np.uint64(1) << np.uint64(64 - 8 * b))
            common[ends] += lead
        open_ = same
    rest = rest[order]
    common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    at = at[order]
    left = np.where(offset[order] > 0, data[at - 1].astype(np.int64), 256)
    return text[order], offset[order], common, left


def maximal_repeats(common: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, length): ranges of the suffix array that are all the occurrences of a maximal repeat of `least` bytes or more.

    A stack holds the open common-prefix intervals; an interval is given out as it closes if the bytes before its
    suffixes differ (or one starts a text), for else the repeat is longer to the left and has an interval of its own.
    """
    out: list[tuple[int, int, int]] = []
    deep = common >= least
    inside = np.flatnonzero(deep | np.append(deep[1:], False))  # suffixes that share enough with a neighbour
    stack: list[list[int]] = []  # [length, from, left byte, 256 if they differ]
    lengths, lefts = common[inside].tolist(), left[inside].tolist()
    for i, shared, own in zip(inside.tolist(), lengths, lefts, strict=True):
        if shared < least:  # a new run: close all
            while stack:
                length, start, byte = stack.pop()
                if stack and stack[-1][2] != byte:
                    stack[-1][2] = 256
                if byte == 256 and length:
                    out.append((start, end, length))
            before, end = own, i
            continue
        start, byte = end, before
        while stack and stack[-1][0] > shared:
            length, start, byte = stack.pop()
            if byte == 256:
                out.append((start, end, length))
            if stack and stack[-1][0] >= shared and stack[-1][2] != byte:
                stack[-1][2] = 256
        if not stack or stack[-1][0] < shared:
            stack.append([shared, start, byte])
        if stack[-1][2] != own:
            stack[-1][2] = 256
        before, end = own, i
    while stack:
        length, start, byte = stack.pop()
        if stack and stack[-1][2] != byte:
            stack[-1][2] = 256
        if byte == 256:
            out.append((start, end, length))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


class _Bucket:
    """The pieces sent to a bucket and their maximal repeats: suffixes start[i] to end[i] share length[i] bytes and are all that do."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("gid")
        self.number = table.column("bucket")[0].as_py()
        self.gids, self.counts = table.column("gid").to_numpy(), table.column("n").to_numpy()
        index: dict[bytes, int] = {}
        piece, ids, keys, several = [], [], [], []
        for n, blob in zip(self.counts.tolist(), table.column("blob").to_pylist(), strict=True):
            sizes = np.frombuffer(blob, "<u2", n, 16 * n)
            ends = np.cumsum(sizes & ~_SEVERAL, dtype=np.int64) + 18 * n
            several.append(sizes & _SEVERAL > 0)
            starts = np.append(18 * n, ends[:-1])
            piece += [index.setdefault(blob[a:b], len(index)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            keys.append(np.frombuffer(blob, "<u8", n))
            ids.append(np.frombuffer(blob, "<i8", n, 8 * n))
        self.texts, self.of, self.own = list(index), np.array(piece, np.int64), np.concatenate(ids)
        self.least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, self.own)
        # inside a piece only what other pieces of its anchor have can repeat
        key = np.empty(len(index), np.uint64)
        key[self.of] = np.concatenate(keys)
        _, group, members = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.bincount(self.of, minlength=len(index)) > 1
        twice[self.of[np.concatenate(several)]] = True
        self.text, self.offset, common, left = suffix_array(self.texts, width, members[group] > 1, np.flatnonzero(twice))
        self.start, self.end, self.length = maximal_repeats(common, left, width)
        each = self.end - self.start + 1
        self.repeat = np.repeat(np.arange(len(each)), each)  # of each occurrence
        self.member = self.text[ragged(self.start, each)]
        self.place = self.offset[ragged(self.start, each)]
        self.first = np.cumsum(each) - each


def _removable(table: pa.Table, width: int) -> pa.Table:
    """For every piece sent to a bucket, a bit for each of its strings that a document with a smaller id has too, and one for repeating as a whole."""
    b = _Bucket(table, width)
    bits, whole = np.zeros(len(b.texts), np.uint32), np.zeros(len(b.texts), bool)
    if len(b.first):
        sizes = np.fromiter(map(len, b.texts), np.int64, len(b.texts))
        whole[b.member[(b.place == 0) & (b.length[b.repeat] == sizes[b.member])]] = True
        lowest = np.minimum.reduceat(b.least[b.member], b.first)
        later = np.flatnonzero(b.least[b.member] > lowest[b.repeat])
        strings = (b.length[b.repeat[later]] - width + 1).astype(np.uint64)
        marks = ((np.uint64(1) << strings) - np.uint64(1)) << b.place[later].astype(np.uint64)
        np.bitwise_or.at(bits, b.member[later], marks.astype(np.uint32))
    out = np.where((b.own > b.least[b.of]) & whole[b.of], np.uint32(0xFFFFFFFF), bits[b.of] | np.where(whole[b.of], _WHOLE, np.uint32(0)))
    sent = replies(b.number, b.gids, b.counts, out.astype("<u4"))
    del b
    released()
    return sent


def _listed(table: pa.Table, width: int) -> pa.Table:
    """For every group, the repeats of the pieces that it sent: number of the piece, place in it, length and name of the repeat."""
    b = _Bucket(table, width)
    names = [xxhash.xxh128_digest(b.texts[b.member[f]][b.place[f] : b.place[f] + n]) for f, n in zip(b.first.tolist(), b.length.tolist(), strict=True)]
    pairs = np.unique(np.stack([b.member, b.repeat, b.place]), axis=1) if len(b.member) else np.empty((3, 0), np.int64)
    begins = np.searchsorted(pairs[0], np.arange(len(b.texts) + 1))
    ends, rows = np.cumsum(b.counts), []
    for gid, n, end in zip(b.gids.tolist(), b.counts.tolist(), ends.tolist(), strict=True):
        own = b.of[end - n : end]
        counts = begins[own + 1] - begins[own]
        at = ragged(begins[own], counts)
        blob = np.repeat(np.arange(n), counts).astype("<u4").tobytes() + pairs[2][at].astype("<u2").tobytes() + b.length[pairs[1][at]].astype("<u2").tobytes()
        rows.append((b.number, gid, len(at), blob + b"".join(names[r] for r in pairs[1][at].tolist())))
    columns = zip(*rows, strict=True)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "gid", "n", "blob"])


REPEATS = "repeat string, length long, doc_id long, start long"
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _groups(docs: DataFrame, width: int, hot: int, dealt=grouped_documents, answer=_removable):
    """(groups, buckets, answers): the groups of documents, and the answers of both rounds for each."""
    if not ANCHOR <= width <= ANCHOR + 30:
        raise ValueError(f"width must be {ANCHOR} to {ANCHOR + 30}")
    n_bytes = text_bytes(docs)
    n_buckets = groups_for(n_bytes)
    groups = dealt(docs, n_bytes)

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        sent = _Group(table, width).send_anchors(key[0].as_py(), n_buckets)[0]
        released()
        return sent

    def send_pieces(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group = _Group(table, width)
        group.candidates(key[0].as_py(), n_buckets, answers)
        sent = group.send_pieces(key[0].as_py(), n_buckets)[0]
        del group
        released()
        return sent

    anchored = groups.groupBy("gid").applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(lambda table: _shared_anchors(table, hot), SENT)
    sent = groups.groupBy("gid").cogroup(anchored.groupBy("gid")).applyInArrow(send_pieces, SENT)
    found = sent.groupBy("bucket").applyInArrow(lambda table: answer(table, width), SENT)
    answers = anchored.withColumn("bucket", -1 - F.col("bucket")).union(found)
    return groups, n_buckets, answers


def _answered(key: tuple, table: pa.Table, answers: pa.Table, width: int, n_buckets: int) -> tuple[_Group, pa.Table]:
    """The group with its pieces, and the answers about them."""
    group = _Group(table, width)
    first = answers.filter(pa.compute.less(answers.column("bucket"), 0))
    group.candidates(key[0].as_py(), n_buckets, first.set_column(0, "bucket", pa.compute.subtract(-1, first.column("bucket"))))
    return group, answers.filter(pa.compute.greater_equal(answers.column("bucket"), 0))


def _marked(key: tuple, table: pa.Table, answers: pa.Table, width: int, n_buckets: int) -> tuple[_Group, np.ndarray]:
    group, second = _answered(key, table, answers, width, n_buckets)
    return group, group.removed(key[0].as_py(), n_buckets, second)


def maximal_repeats_of(docs: DataFrame, width: int = 50, hot: int = HOT) -> DataFrame:
    """(repeat, length, doc_id, start): the groups of maximal repeats of `width` bytes or more, with all occurrences of each.

    repeat names the repeated bytes by their XXH128; start is a place in the document's UTF-8 bytes. Every occurrence of a
    repeat's bytes in any document is listed, and every string of `width` bytes that two documents have lies in a repeat. Rows
    with equal id and text are one document.
    """
    groups, n_buckets, answers = _groups(docs, width, hot, answer=_listed)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group, second = _answered(key, table, answers, width, n_buckets)
        return group.occurrences(n_buckets, second)

    return groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(finish, REPEATS)


def dedup(docs: DataFrame, width: int = 50, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    groups, n_buckets, answers = _groups(docs, width, hot)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group, gone = _marked(key, table, answers, width, n_buckets)
        begins = np.append(0, group.ends[:-1])
        opened = gone.copy()
        opened[1:] &= ~gone[:-1]
        inner = begins[begins < len(gone)]
        opened[inner] = gone[inner]
        lost, spans = (np.append(0, np.cumsum(x, dtype=np.int32)) for x in (gone, opened))
        rest = group.data[: len(gone)][~gone].tobytes()
        out = [(e - b, int(lost[e] - lost[b]), int(spans[e] - spans[b]), hashlib.sha256(rest[b - lost[b] : e - lost[e]]).hexdigest()) for b, e in zip(begins.tolist(), group.ends.tolist(), strict=True)]
        rows = [out[i] for i in group.rows]
        released()
        columns = [table.column("doc_id").combine_chunks(), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())]
        return pa.table(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    return groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(finish, COLUMNS)


def deduplicated(docs: DataFrame, width: int = 50, hot: int = HOT) -> DataFrame:
    """All rows and columns of docs, with what is left of each text; a character that loses a byte goes whole, a null text stays null."""
    groups, n_buckets, answers = _groups(docs, width, hot, carried_documents)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group, gone = _marked(key, table, answers, width, n_buckets)
        data = group.data[: len(gone)]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead):
            gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(gone))))
        rest, lost = data[~gone].tobytes(), np.append(0, np.cumsum(gone, dtype=np.int32))
        begins = np.append(0, group.ends[:-1])
        texts = [rest[b - lost[b] : e - lost[e]].decode() for b, e in zip(begins.tolist(), group.ends.tolist(), strict=True)]
        null = table.column("text").combine_chunks().is_null().to_pylist()
        released()
        return pa.table([pa.array([None if x else texts[i] for i, x in zip(group.rows, null, strict=True)], pa.string()), table.column("rest")], ["text", "rest"])

    schema = T.StructType([T.StructField("text", T.StringType()), groups.schema["rest"]])
    return uncarried(groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(finish, schema), docs)
