"""Document fingerprints from prefix polynomial hashes (operator 9).

A text's prefix arrays hold, for two bases modulo a prime, the polynomial hash of every prefix. Differences of
entries answer whether any two spans are equal, and a binary search over them gives longest common extensions. A text
put together from spans of others needs no new array: its prefix hashes follow from theirs.

The fingerprint column is the length and the hash of the whole, so that equal texts have equal fingerprints. A likeness needs
more than a constant number of bytes can hold: it compares the prefix arrays that the two fingerprints are the last entries of.
It is the share of the longer text that common spans cover in order: the longest common extensions from both starts and both
ends, and of what lies between, from left to right, every span of ANCHOR characters of the first text, looked for at each
STRIDE-th place, that the second text has behind what is covered there, with its longest common extensions both ways.

Defined results: null text counts as empty; two empty texts have likeness 1, an empty and another text 0; documents with
the same id follow each other by the hash of their text, and each row counts as a document of its own (a repeated row's next
is its copy); rows with a null id come last; a single row is followed by itself; an empty table gives no rows; texts of any
length are taken whole, and a task holds two of them; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetica.llm.common import tasks_for, text_bytes, texts_of, written

#: The prime 2^31 - 1 and two bases below it.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_123)
NULL_ID = -(1 << 63)
#: Characters of a span that two texts have to share to be matched between edits, and the step at which spans are tried.
ANCHOR, STRIDE = 24, 12


class _Powers:
    """Powers of the bases modulo the prime, or of their inverses, as many as the longest text so far needs."""

    def __init__(self, bases: tuple[int, ...]) -> None:
        self.bases, self.of = bases, [np.ones(1, np.uint64) for _ in bases]

    def upto(self, n: int) -> list[np.ndarray]:
        for k, base in enumerate(self.bases):
            while len(self.of[k]) <= n:
                self.of[k] = np.concatenate([self.of[k], self.of[k] * np.uint64(pow(base, len(self.of[k]), PRIME)) % PRIME])
        return self.of


POWERS, INVERSES = _Powers(BASES), _Powers(tuple(pow(b, -1, PRIME) for b in BASES))


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.arrays = []
        for power in POWERS.upto(self.n):
            terms = points * power[: self.n]
            terms = (terms & np.uint64(PRIME)) + (terms >> np.uint64(31))
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.arrays.append(sums % np.uint64(PRIME))

    def part(self, k: int, a: int, b: int) -> np.ndarray:
        """Hashes of the prefixes of a to b code points by base k."""
        return self.arrays[k][a : b + 1]

    def at(self, k: int, i: int) -> int:
        """Hash of the first i code points by base k."""
        return int(self.arrays[k][i])


class Joined:
    """Prefix hashes of the first a code points of one text followed by the first b of another, from their arrays."""

    def __init__(self, first: Prefixes, a: int, second: Prefixes, b: int):
        self.first, self.a, self.second, self.n = first, a, second, a + b

    def at(self, k: int, i: int) -> int:
        if i <= self.a:
            return self.first.at(k, i)
        return (self.first.at(k, self.a) + int(POWERS.of[k][self.a]) * self.second.at(k, i - self.a)) % PRIME


    def part(self, k: int, a: int, b: int) -> np.ndarray:
        own = self.first.arrays[k][a : min(b, self.a) + 1]
        others = self.second.arrays[k][max(a, self.a + 1) - self.a : b - self.a + 1] if b > self.a else own[:0]
        return np.concatenate([own, (np.uint64(self.first.at(k, self.a)) + POWERS.of[k][self.a] * others) % np.uint64(PRIME)])


def same_span(x: Prefixes | Joined, i: int, y: Prefixes | Joined, j: int, n: int) -> bool:
    """Whether n code points of x from i are those of y from j."""
    for k, power in enumerate(POWERS.of):
        if (x.at(k, i + n) - x.at(k, i)) * int(power[j]) % PRIME != (y.at(k, j + n) - y.at(k, j)) * int(power[i]) % PRIME:
            return False
    return True


def common_extension(x: Prefixes | Joined, i: int, y: Prefixes | Joined, j: int, most: int, back: bool = False) -> int:
    """Length, up to `most`, of the longest common extension forwards from i and j, or backwards that ends there."""
    low, high = 0, most
    while low < high:
        n = (low + high + 1) // 2
        if same_span(x, i - n if back else i, y, j - n if back else j, n):
            low = n
        else:
            high = n - 1
    return low


def _span_keys(x: Prefixes | Joined, a: int, b: int, step: int) -> np.ndarray:
    """A key for each span of ANCHOR code points that starts at a, a + step, ... and ends by b: equal spans have equal keys."""
    keys = []
    for k in range(len(BASES)):
        sums = x.part(k, a, b)
        spans = (sums[ANCHOR::step] + np.uint64(PRIME) - sums[: len(sums) - ANCHOR : step]) % np.uint64(PRIME)
        keys.append(spans * INVERSES.upto(b)[k][a : b - ANCHOR + 1 : step] % np.uint64(PRIME))
    return keys[0] << np.uint64(31) | keys[1]


def likeness(x: Prefixes | Joined, y: Prefixes | Joined) -> float:
    if not x.n or not y.n:
        return float(x.n == y.n)
    POWERS.upto(max(x.n, y.n))
    short = min(x.n, y.n)
    start = common_extension(x, 0, y, 0, short)
    end = common_extension(x, x.n, y, y.n, short - start, back=True)
    return (start + end + _between(x, y, start, x.n - end, y.n - end)) / max(x.n, y.n)


def _between(x: Prefixes | Joined, y: Prefixes | Joined, start: int, x_end: int, y_end: int) -> int:
    """Code points of x from start that spans shared in order with y from start cover."""
    if min(x_end, y_end) - start < ANCHOR:
        return 0
    tried, have = _span_keys(x, start, x_end, STRIDE), _span_keys(y, start, y_end, 1)
    order = np.argsort(have, kind="stable")
    have = have[order]
    first, last = np.searchsorted(have, tried), np.searchsorted(have, tried, side="right")
    covered, i, j = 0, start, start  # covered up to i in x, up to j in y
    for t in np.flatnonzero(last > first).tolist():
        at = start + t * STRIDE
        if at < i:
            continue
        places = order[first[t] : last[t]]  # in order
        k = int(np.searchsorted(places, j - start))
        if k == len(places):
            continue
        other = start + int(places[k])
        before = common_extension(x, at, y, other, min(at - i, other - j), back=True)
        after = common_extension(x, at, y, other, min(x_end - at, y_end - other))
        covered, i, j = covered + before + after, at + after, other + after
    return covered


def fingerprint(x: Prefixes | Joined) -> str:
    return f"{x.n:x}-" + "".join(f"{x.at(k, x.n):08x}" for k in range(len(BASES)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint): a map over the scan."""

    def run(arrived):
        for batch in arrived:
            found = [Prefixes(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x.n for x in found], pa.int64()), pa.array(list(map(fingerprint, found)), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc: tuple, then: tuple) -> tuple:
    """The row of a document (id, text, prefixes) and the one that follows it."""
    doc_id, text, own = doc
    _, other, following = then
    POWERS.upto(max(own.n, following.n))
    half = own.n // 2
    cut, take = own.n - half, min(half, following.n)
    edited = Joined(own, cut, following, take)
    sha = hashlib.sha256((text[:cut] + other[:take]).encode()).hexdigest()
    return doc_id, own.n, sha, fingerprint(own), fingerprint(edited), likeness(own, edited), likeness(own, following)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Which row of a range a row is that waits for another range.
FIRST, LAST = 1, 2


def _run(arrived):
    """Rows of all documents of a range but the last one; the first and the last document themselves, for the neighbours."""
    before, place = None, None
    for batch in arrived:
        out, ends = [], []
        for place, doc_id, text in zip(batch.column("place").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            now = (doc_id, text, Prefixes(text))
            if before is None:
                ends.append((place, FIRST, doc_id, text))
            else:
                out.append(_compared(before, now))
            before = now
        yield _rows(out, ends)
    if before is not None:
        yield _rows([], [(place, LAST, *before[:2])])


def _rows(out: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
    rows = [(*r, None, None, None) for r in out] + [(e[2], *[None] * 6, e[0], e[1], e[3]) for e in ends]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
    kinds = [*_TYPES, pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [*_NAMES, "place", "side", "text"])


def _met(arrived):
    for batch in arrived:
        rows = [_compared((i, text, Prefixes(text)), (None, then, Prefixes(then))) for i, text, then in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), texts_of(batch.column("then")), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its text, its edited text and the document after it by descending id, the first after the last.

    Rows move once, into ranges of descending ids; the hash of the text, and the place of the row for equal texts, cut the range
    of an id that many rows have. Ranges meet in a small table of their first and last documents: two rows for each range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select(key.alias("k"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("salt"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.desc("k"), F.asc("h"), F.asc("salt")]
    ranges = rows.repartitionByRange(tasks_for(text_bytes(docs)), *order).sortWithinPartitions(*order)
    done = written(ranges.select(F.spark_partition_id().alias("place"), "doc_id", "text").mapInArrow(_run, f"{COLUMNS}, place int, side int, text string"), "compared")
    firsts = done.where(F.col("side") == FIRST).select("place", F.col("text").alias("then"))
    lasts = done.where(F.col("side") == LAST).select(F.col("place").alias("own"), "doc_id", "text")
    # numbers of ranges only: the next of each, and the first after the last
    everywhere = Window.orderBy("own")
    following = lasts.select("own", F.coalesce(F.lead("own").over(everywhere), F.first("own").over(everywhere)).alias("place"))
    met = lasts.join(following, "own").join(firsts, "place").select("doc_id", "text", "then")
    return done.where("side is null").select(*_NAMES).unionByName(met.mapInArrow(_met, COLUMNS))
