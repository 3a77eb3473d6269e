"""Substring dedup over windows of words (operator 6).

Every window of `width` consecutive words gets two Rabin-Karp hashes modulo 2^61 - 1, by independent bases. Three rounds over
random groups of documents, each in packed rows:

1. a group settles what repeats within itself and sends 32 bits of the hash of each of its different windows to a bucket,
   which answers with a bit: whether another group sent the same;
2. windows that are shared that way go to their bucket with both hashes whole and their document, and the bucket answers
   with a bit: whether the window starts earlier in another group;
3. windows that start earlier elsewhere merge into maximal removal intervals.

The order of windows is (doc_id, hash of the text, start). Defined results: null and short texts have no window and lose
nothing; an empty table gives no rows; texts of any length are taken whole, and one long text makes a large group, not a
large row of an exchange; rows with equal id and text are one document and get equal results; rows with equal id and
different texts are different documents, the one with the lesser XXH64 of its text first; a null id comes before all
others; other columns of the input, whatever their names, are ignored. Windows are compared by 122 bits: two different ones
are taken for each other with a chance below 2^-110, whatever the words are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetica.llm.blobs import SENT, answered, gathered, replies, scattered, sending_order
from noetica.llm.common import grouped_documents, groups_for, released, text_bytes
from noetica.llm.hashing import BASES, window_hashes, word_hashes

NULL_ID = -(1 << 63)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of joined bytes."""
    white = np.concatenate([[True], (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)), [True]])
    turns = np.flatnonzero(white[1:] != white[:-1])
    return turns[::2], turns[1::2]


def _steps(values: np.ndarray, bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """Values that repeat along a document as differences within their bucket: compressed, they shrink to almost nothing."""
    order = sending_order(bucket, n_buckets)
    sorted_ = values[order]
    step = np.diff(sorted_, prepend=sorted_[:1])
    cut = np.append(True, np.diff(bucket[order]) != 0)[: len(order)]
    step[cut] = sorted_[cut]
    out = np.empty_like(values)
    out[order] = step
    return out


def _unstepped(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values again, from rows of `counts` differences each."""
    sums, first = np.cumsum(steps), np.cumsum(counts) - counts
    return sums - np.repeat(sums[first] - steps[first], counts)


class _Group:
    """A group's distinct documents in order, their words and windows."""

    def __init__(self, table: pa.Table, width: int):
        ids = [NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        keys = [(i, xxhash.xxh64_intdigest(t), t) for i, t in zip(ids, texts, strict=True)]
        self.docs = sorted(set(keys))
        place = {k: i for i, k in enumerate(self.docs)}
        self.rows = [place[k] for k in keys]
        self.joined = b"\n".join(t for _, _, t in self.docs) + b"\n" + bytes(16)
        self.data = np.frombuffer(self.joined, np.uint8)
        self.starts, self.ends = word_bounds(self.data[:-16])
        self.word_doc = np.searchsorted(np.cumsum([len(t) + 1 for _, _, t in self.docs]), self.starts, side="right")
        self.width = width
        one, two = (window_hashes(word_hashes(self.data, self.starts, self.ends, b), width, b) for b in BASES)
        self.windows = np.flatnonzero(self.word_doc[: len(one)] == self.word_doc[width - 1 :]) if len(one) else np.empty(0, np.int64)
        one, two = one[self.windows], two[self.windows]
        order = np.argsort(one)
        same = one[order[1:]] == one[order[:-1]]
        if (two[order[1:]][same] != two[order[:-1]][same]).any():  # different windows with one first hash
            order = np.lexsort((two, one))
            same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        runs = np.flatnonzero(np.append(True, ~same)[: len(order)])
        self.first = np.sort(np.minimum.reduceat(order, runs)) if len(runs) else order  # places of windows that are the first of their kind here
        self.one, self.two = one[self.first], two[self.first]
        del one, two, order, same

    def _buckets(self, n: int) -> np.ndarray:
        return (self.one >> np.uint64(32)).astype(np.int64) % n

    def send_marks(self, gid: int, n_buckets: int) -> tuple[pa.Table, np.ndarray]:
        return scattered(gid, self._buckets(n_buckets), [(self.one & np.uint64(0xFFFFFFFF)).astype("<u4")], n_buckets)

    def share(self, gid: int, n_buckets: int, answers: pa.Table) -> None:
        """Keeps the windows that another group may have too."""
        self.shared = np.flatnonzero(answered(answers, self.send_marks(gid, n_buckets)[1], "bool"))

    def send_windows(self, gid: int, n_buckets: int) -> tuple[pa.Table, np.ndarray]:
        bucket, doc = self._buckets(n_buckets)[self.shared], self.word_doc[self.windows[self.first[self.shared]]]
        ids = np.array([d[0] for d in self.docs], np.int64)[doc]
        texts = np.array([d[1] for d in self.docs], np.uint64)[doc]
        return scattered(gid, bucket, [self.one[self.shared], self.two[self.shared], _steps(ids, bucket, n_buckets), _steps(texts, bucket, n_buckets)], n_buckets)


def _shared_marks(table: pa.Table) -> pa.Table:
    """For every mark sent to a bucket, whether another group sent it too."""
    gids, counts, (marks,) = gathered(table, ["<u4"])
    order = np.argsort(marks, kind="stable")
    same = marks[order[1:]] == marks[order[:-1]]
    out = np.empty(len(marks), bool)
    out[order] = np.append(False, same)[: len(marks)] | np.append(same, False)[: len(marks)]
    return replies(table.column("bucket")[0].as_py(), gids, counts, out)


def _firsts(table: pa.Table) -> pa.Table:
    """For every window sent to a bucket, whether it starts earlier in another group."""
    gids, counts, (one, two, ids, texts) = gathered(table, ["<u8", "<u8", "<i8", "<u8"])
    ids, texts = _unstepped(ids, counts), _unstepped(texts, counts)
    order = np.lexsort((texts, ids, two, one))
    later = np.empty(len(one), bool)
    later[order] = np.append(False, (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]))[: len(order)]
    return replies(table.column("bucket")[0].as_py(), gids, counts, later)


COLUMNS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removal(group: _Group, answers: pa.Table, gid: int, n_buckets: int) -> np.ndarray:
    """Whether each word is removed: the union of all windows that start earlier somewhere."""
    later = np.ones(len(group.windows), bool)
    later[group.first] = False
    later[group.first[group.shared]] = answered(answers, group.send_windows(gid, n_buckets)[1], "bool")
    edges = np.zeros(len(group.starts) + 1, np.int32)
    at = group.windows[later]
    edges[at] += 1
    edges[at + group.width] -= 1  # no window occurs twice in `at`
    return np.cumsum(edges[:-1], dtype=np.int32) > 0


def _kept(group: _Group, table: pa.Table, removed: np.ndarray) -> pa.Table:
    """Digests of the kept words, each with the byte behind it as a blank, the last blank of a document left out."""
    stay = ~removed
    data = group.data.copy()
    data[group.ends] = 0x20
    edges = np.zeros(len(data) + 1, np.int8)
    edges[group.starts[stay]] += 1
    edges[group.ends[stay] + 1] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    rest = data[inside].tobytes()
    words = np.append(0, np.cumsum(stay))
    size = np.append(0, np.cumsum((group.ends - group.starts + 1) * stay))
    cuts = np.searchsorted(group.word_doc, np.arange(len(group.docs) + 1))
    n, kept, ends = np.diff(cuts), np.diff(words[cuts]), size[cuts].tolist()
    shas = [hashlib.sha256(rest[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
    rows = np.array(group.rows, np.int64)
    return pa.table([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(n[rows], pa.int64()), pa.array((n - kept)[rows], pa.int64()), pa.array(shas, pa.string()).take(pa.array(rows))], [c.split()[0] for c in COLUMNS.split(", ")])


def dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    n_bytes = text_bytes(docs)
    n_buckets = groups_for(n_bytes)
    groups = grouped_documents(docs, n_bytes)

    def send_marks(key: tuple, table: pa.Table) -> pa.Table:
        sent = _Group(table, width).send_marks(key[0].as_py(), n_buckets)[0]
        released()
        return sent

    def send_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group = _Group(table, width)
        group.share(key[0].as_py(), n_buckets, answers)
        sent = group.send_windows(key[0].as_py(), n_buckets)[0]
        del group
        released()
        return sent

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        group, gid = _Group(table, width), key[0].as_py()
        marks = answers.filter(pa.compute.less(answers.column("bucket"), 0))
        group.share(gid, n_buckets, marks.set_column(0, "bucket", pa.compute.subtract(-1, marks.column("bucket"))))
        out = _kept(group, table, removal(group, answers.filter(pa.compute.greater_equal(answers.column("bucket"), 0)), gid, n_buckets))
        del group
        released()
        return out

    marked = groups.groupBy("gid").applyInArrow(send_marks, SENT).groupBy("bucket").applyInArrow(_shared_marks, SENT)
    sent = groups.groupBy("gid").cogroup(marked.groupBy("gid")).applyInArrow(send_windows, SENT)
    found = sent.groupBy("bucket").applyInArrow(_firsts, SENT)
    answers = marked.withColumn("bucket", -1 - F.col("bucket")).union(found)
    return groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(finish, COLUMNS)
