"""Line dedup by two Bloom filters (operator 12).

A line's key is the line without white space at both ends, with A-Z in lower case. Keys of `least_chars` code points or more
that `least_docs` documents hold lose all their lines, except in the document with the largest id. Three rounds over
random groups of documents:

1. a group sends 32 bits of the hash of each of its different keys to a bucket of hashes. The bucket has two Bloom filters, for
   hashes that were seen once and for those that were seen twice, and answers with a bit: whether the second filter holds the hash;
2. keys that are suspected that way, or that two documents of the group hold, are the only ones that are shuffled whole: one row
   for each group and key, with the number of the group's documents and the largest id. Spark sums them up and
   so confirms each key exactly, whatever hashes or filters took for equal;
3. confirmed keys go back to their groups, which drop lines.

Filters have CELLS cells for each hash that comes to their bucket, so that they grow with the input and keep their rate of false
suspects (about one in 700); these cost a row each and change nothing.

Defined results: null and empty texts are one empty line and lose nothing (deduplicated() keeps nulls); every row is a document of
its own, so that a repeated row counts again, and all rows with the largest id keep their lines; null ids come before
all others; an empty table gives no rows; texts of any length are taken whole; a key that is often in one document counts
once for it; other columns, whatever their names, are ignored by dropped() and kept by deduplicated().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noetica.llm.blobs import SENT, answered, gathered, replies, scattered
from noetica.llm.common import carried_documents, grouped_documents, released, tasks_for, text_bytes, uncarried

NULL_ID = -(1 << 63)
#: Text bytes whose keys one bucket holds; cells of a filter and probes for each hash; hashes that filters take in at once.
BUCKET_BYTES, CELLS, PROBES, SLAB = 64 << 20, 16, 3, 1 << 16
WHITE = " \t\n\v\f\r"


class Bloom:
    """A Bloom filter of 32-bit hashes."""

    def __init__(self, n: int):
        self.bits = 1 << max(6, math.ceil(math.log2(max(1, CELLS * n))))
        self.cells = np.zeros(self.bits, bool)

    def _probes(self, hashes: np.ndarray):
        mixed = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        step = (mixed >> np.uint64(40)) | np.uint64(1)
        for i in range(PROBES):
            yield ((mixed >> np.uint64(8)) + np.uint64(i) * step) & np.uint64(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._probes(hashes):
            self.cells[at] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.cells[at] for at in self._probes(hashes)])


def twice_seen(marks: np.ndarray) -> Bloom:
    """The filter of what was seen twice, and of little else, from hashes that each sender sends once."""
    once, twice = Bloom(len(marks)), Bloom(len(marks))
    for a in range(0, len(marks), SLAB):
        new, n = np.unique(marks[a : a + SLAB], return_counts=True)
        twice.add(new[once.holds(new) | (n > 1)])
        once.add(new)
    return twice


def _suspected(table: pa.Table) -> pa.Table:
    """For every hash sent to a bucket, whether the filter of those seen twice holds it."""
    gids, counts, (marks,) = gathered(table, ["<u4"])
    return replies(table.column("bucket")[0].as_py(), gids, counts, twice_seen(marks).holds(marks))


class _Lines:
    """A group's lines; its different keys in order, the documents that hold each and the largest id of these."""

    def __init__(self, table: pa.Table, least_chars: int):
        self.texts = table.column("text").cast(pa.large_string()).combine_chunks()
        split = pc.split_pattern(pc.fill_null(self.texts, ""), "\n")
        offsets = split.offsets.to_numpy()
        self.lines = split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        self.first = offsets - offsets[0]
        self.ids = table.column("doc_id").fill_null(NULL_ID).to_numpy()
        stripped = pc.ascii_lower(pc.utf8_trim(self.lines, characters=WHITE))
        enough = pc.greater_equal(pc.utf8_length(stripped), least_chars)
        coded = stripped.filter(enough).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = coded.dictionary.take(pa.array(order))
        self.keyed = np.flatnonzero(enough.to_numpy(zero_copy_only=False))  # lines that have a key
        self.key = place[coded.indices.to_numpy()]
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))[self.keyed]
        held = np.unique(self.key * max(1, len(self.ids)) + self.row) // max(1, len(self.ids))
        self.n = np.bincount(held, minlength=len(self.keys))
        self.last = np.full(len(self.keys), NULL_ID)
        np.maximum.at(self.last, self.key, self.ids[self.row])

    def send_marks(self, gid: int, n_buckets: int) -> tuple[pa.Table, np.ndarray]:
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in self.keys.cast(pa.large_binary()).to_pylist()], np.uint64)
        return scattered(gid, (hashes >> np.uint64(32)).astype(np.int64) % n_buckets, [hashes.astype("<u4")], n_buckets)

    def suspects(self, gid: int, n_buckets: int, answers: pa.Table) -> pa.Table:
        at = np.flatnonzero(answered(answers, self.send_marks(gid, n_buckets)[1], "bool") | (self.n > 1))
        return pa.table([pa.array(np.full(len(at), gid, np.int32)), pa.array(at), self.keys.take(pa.array(at)).cast(pa.string()), pa.array(self.n[at]), pa.array(self.last[at])], ["gid", "i", "key", "n", "last"])

    def kept(self, keys: np.ndarray, last: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts that are left, the lines of each row and how many it loses, if these keys stay with the id `last` only."""
        stays = np.zeros(len(self.keys), np.int64)
        stays[keys] = last
        gone = np.zeros(len(self.keys), bool)
        gone[keys] = True
        gone = gone[self.key] & (stays[self.key] != self.ids[self.row])
        dropped = np.bincount(self.row[gone], minlength=len(self.ids))
        left = np.ones(len(self.lines), bool)
        left[self.keyed[gone]] = False
        changed = np.flatnonzero(dropped)
        new = ["\n".join(self.lines.slice(a, b - a).filter(pa.array(left[a:b])).to_pylist()) for a, b in zip(self.first[changed].tolist(), self.first[changed + 1].tolist(), strict=True)]
        texts = pc.replace_with_mask(self.texts, pa.array(dropped > 0), pa.array(new, pa.large_string())) if new else self.texts
        return texts.cast(pa.string()), np.diff(self.first).astype(np.int64), dropped.astype(np.int64)


def _without_lines(groups: DataFrame, n_bytes: int, least_chars: int, least_docs: int) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, and `rest` if there is such a column) of grouped documents."""
    n_buckets, rest = max(8, math.ceil(n_bytes / BUCKET_BYTES)), groups.columns[3:]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *(groups.schema[c] for c in rest)])

    def send_marks(key: tuple, table: pa.Table) -> pa.Table:
        sent = _Lines(table, least_chars).send_marks(key[0].as_py(), n_buckets)[0]
        released()
        return sent

    def send_suspects(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        sent = _Lines(table, least_chars).suspects(key[0].as_py(), n_buckets, answers)
        released()
        return sent

    def finish(key: tuple, table: pa.Table, confirmed: pa.Table) -> pa.Table:
        texts, lines, dropped = _Lines(table, least_chars).kept(confirmed.column("i").to_numpy(), confirmed.column("last").to_numpy())
        out = pa.table([table.column("doc_id"), texts, pa.array(lines), pa.array(dropped), *map(table.column, rest)], schema.names)
        released()
        return out

    marked = groups.groupBy("gid").applyInArrow(send_marks, SENT).groupBy("bucket").applyInArrow(_suspected, SENT)
    found = groups.groupBy("gid").cogroup(marked.groupBy("gid")).applyInArrow(send_suspects, "gid int, i long, key string, n long, last long")
    found = found.repartition(tasks_for(n_bytes), "key")  # sums and join find this partitioning in place; a key has a row for each group at most
    confirmed = found.groupBy("key").agg(F.sum("n").alias("docs"), F.max("last").alias("last")).where(F.col("docs") >= least_docs).select("key", "last")
    gone = found.select("gid", "i", "key").join(confirmed, "key").select("gid", "i", "last")
    return groups.groupBy("gid").cogroup(gone.groupBy("gid")).applyInArrow(finish, schema)


def dropped(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row: the text that is left, and the lines there were and that went."""
    n_bytes = text_bytes(docs)
    return _without_lines(grouped_documents(docs, n_bytes, seed=12), n_bytes, least_chars, least_docs)


def deduplicated(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """All rows and columns of docs, their texts without the lines that go."""
    n_bytes = text_bytes(docs)
    return uncarried(_without_lines(carried_documents(docs, n_bytes, seed=12), n_bytes, least_chars, least_docs), docs)


def digests(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row."""
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    return dropped(docs, least_chars, least_docs).select("doc_id", "n_lines", "n_dropped", kept)
