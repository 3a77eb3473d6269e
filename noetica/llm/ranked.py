"""Ranked lexical search by block-max pruning over a forward index (operator 13).

The index is made by a map over the scan: documents in the order they come in become blocks of BLOCK documents, and a block
keeps for each document its id, its number of terms and (term, frequency) of the queries' terms. Sums over the blocks give the
global statistics. A second map goes through the blocks of a partition: with the statistics each block gets, for each of its
terms, the greatest part of a score that any of its documents has from it. A query's bound of a block is the sum of these parts times
the terms' weights. Blocks are sorted by that bound and their forward index is scored, best first, until the bound drops below the
query's threshold, the k-th best score so far; blocks whose bound equals it are still scored, since ties go by id. The threshold
stays from one slab of blocks to the next, and the k best of every partition are merged.

No text and no index is shuffled, only each partition's best. Queries come in turns of TURN_BYTES of text at most, so that what a
task holds of them is bounded; each turn reads the documents once.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. They are known by two polynomial
hashes modulo 2^61 - 1; two terms of queries that the first one takes for equal stop the job.

Weights and scores, in integers but for the logarithm: w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 100 - 50 +
((50 * n * N) div L), score = sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)), with N documents that have a term, L
terms of all of them and n terms of one.

Defined results: null texts and texts without a term are never found and don't count in N; queries without a term find nothing;
documents with a score of zero aren't found, so a query can have fewer than k rows; an empty table of documents or queries gives no
rows; texts of any length are taken whole; ties go to the lesser doc_id, null ids last; repeated rows are documents of their own;
rows of queries with one id ask once, with the least text; queries with a null id are left out; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetica.llm.bpe import BATCH_CHARS
from noetica.llm.common import batches, released, texts_of, written
from noetica.llm.hashing import BASES, word_hashes

#: Documents of a block; blocks that are scored at first, then twice as many; text bytes of the queries that are asked together.
BLOCK, FIRST_BLOCKS, TURN_BYTES = 64, 4, 4 << 20
#: Partitions whose best are merged first.
MERGED = 64
LAST_ID = (1 << 63) - 1
INDEX = "ids binary, sizes binary, ends binary, terms binary, tf binary, n long, words long"
COLUMNS = ["item_id", "rank", "doc_id", "score"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def term_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes with some more behind, start and end of each term, its text's number)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(16), np.uint8)
    inside = np.concatenate([[False], _INSIDE[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), turns[::2], side="right")
    return _LOWER[data], turns[::2], turns[1::2], owner


class Vocabulary:
    """Queries' different terms: hashes in order, by both bases."""

    def __init__(self, texts: list[str]):
        data, starts, ends, owner = term_spans(texts)
        one, two = (word_hashes(data, starts, ends, b) for b in BASES)
        self.one, first, of = np.unique(one, return_index=True, return_inverse=True)
        self.two = two[first]
        if (self.two[of] != two).any():
            raise ValueError("two different terms have one hash: choose other bases")
        pairs = np.unique(owner * max(1, len(self.one)) + of)
        query, term = np.divmod(pairs, max(1, len(self.one)))
        self.of_query = np.split(term, np.searchsorted(query, np.arange(1, len(texts)))) if len(texts) else []

    def __len__(self) -> int:
        return len(self.one)

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans are terms of queries, which terms)."""
        if not len(self.one) or not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = word_hashes(data, starts, ends, BASES[0])
        at = np.minimum(np.searchsorted(self.one, hashes), len(self.one) - 1)
        hit = np.flatnonzero(self.one[at] == hashes)
        hit = hit[self.two[at[hit]] == word_hashes(data, starts[hit], ends[hit], BASES[1])]
        return hit, at[hit]


def _indexed(vocabulary: Vocabulary):
    """Rows of the forward index, a run of documents each."""

    def run(arrived):
        for batch in arrived:
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id").fill_null(LAST_ID).to_numpy()
            for a, b in batches(texts, [len(t) for t in texts], BATCH_CHARS):
                data, starts, ends, owner = term_spans(texts[a:b])
                sizes = np.bincount(owner, minlength=b - a)
                hit, term = vocabulary.found(data, starts, ends)
                pairs, tf = np.unique(owner[hit] * max(1, len(vocabulary)) + term, return_counts=True)
                doc, term = np.divmod(pairs, max(1, len(vocabulary)))
                some = np.flatnonzero(np.bincount(doc, minlength=b - a))  # others can't be found
                raw = [ids[a:b][some], sizes[some].astype("<i8"), np.cumsum(np.bincount(doc, minlength=b - a))[some].astype("<i4"), term.astype("<i4"), tf.astype("<i4")]
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in raw), pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], [c.split()[0] for c in INDEX.split(", ")])
        released()

    return run


def _frequencies(n_terms: int):
    def run(arrived):
        df = np.zeros(n_terms, np.int64)
        for batch in arrived:
            for blob in batch.column("terms"):
                df += np.bincount(np.frombuffer(blob.as_buffer(), "<i4"), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return run


class Slab:
    """Blocks of forward index with the documents' parts of scores, and each block's greatest part by term."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_docs: int, n_words: int):
        self.ids, self.ends, self.terms = ids, ends.astype(np.int64), terms.astype(np.int64)
        self.starts = np.append(0, self.ends[:-1])
        m = 100 - 50 + np.array([50 * n * n_docs // n_words for n in sizes.tolist()], np.int64)  # of any size: python's integers
        tf = tf.astype(np.int64)
        self.parts = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, self.ends - self.starts))
        block = np.repeat(np.arange(len(ids)) // BLOCK, self.ends - self.starts)
        order = np.lexsort((block, self.terms))
        new = np.append(True, (np.diff(block[order]) != 0) | (np.diff(self.terms[order]) != 0))[: len(order)]
        first = np.flatnonzero(new)
        self.bound = np.maximum.reduceat(self.parts[order], first) if len(first) else np.empty(0, np.int64)
        self.bound_block, bound_terms = block[order][first], self.terms[order][first]
        self.term_at = np.searchsorted(bound_terms, np.arange(bound_terms[-1] + 2 if len(first) else 1))
        self.n_blocks = -(-len(ids) // BLOCK)
        self.scored = 0  # blocks that queries have scored

    def best(self, terms: np.ndarray, weights: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of this slab and of what is held, by score and id; weights: of all terms, zeros for others."""
        here = terms[terms < len(self.term_at) - 1]
        bound = np.zeros(self.n_blocks, np.int64)
        for t in here.tolist():
            a, b = self.term_at[t], self.term_at[t + 1]
            bound[self.bound_block[a:b]] += weights[t] * self.bound[a:b]
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.searchsorted(-bound[order], 0))]  # bounds above zero
        at, step = 0, FIRST_BLOCKS
        while at < len(order):
            least = held[0][k - 1] if len(held[0]) >= k else 1
            now = order[at : at + step]
            now = now[bound[now] >= least]
            if not len(now):
                break
            self.scored += len(now)
            held = self._merged(np.sort(now), weights, held, k, least)
            at, step = at + step, 2 * step
        return held

    def _merged(self, blocks: np.ndarray, weights: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores the documents of blocks and merges those that reach the threshold."""
        scores, ids = [held[0]], [held[1]]
        for run in np.split(blocks, np.flatnonzero(np.diff(blocks) != 1) + 1):
            a, b = int(run[0]) * BLOCK, min((int(run[-1]) + 1) * BLOCK, len(self.ids))
            i, j = self.starts[a], self.ends[b - 1]
            own = np.add.reduceat(weights[self.terms[i:j]] * self.parts[i:j], self.starts[a:b] - i)  # every document has a term
            good = np.flatnonzero(own >= least)
            scores.append(own[good])
            ids.append(self.ids[a:b][good])
        score, doc = np.concatenate(scores), np.concatenate(ids)
        top = np.lexsort((doc, -score))[:k]
        return score[top], doc[top]


#: Text characters' worth of index rows that are pruned together.
SLAB_TERMS = 1 << 22
HITS = "query int, part int, hits array<struct<low:long,id:long>>"


def _evaluate(of_query: list[np.ndarray], weights: np.ndarray, k: int, n_docs: int, n_words: int):
    def run(arrived):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(of_query)
        own, waiting, size = np.zeros(len(weights), np.int64), [], 0

        def ask() -> None:
            ends = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in waiting]
            offsets = np.cumsum([0, *(len(r[3]) // 4 for r in waiting)])
            joined = [np.concatenate([np.frombuffer(r[c], kind) for r in waiting]) for c, kind in ((0, "<i8"), (1, "<i8"), (3, "<i4"), (4, "<i4"))]
            slab = Slab(joined[0], joined[1], np.concatenate([e + o for e, o in zip(ends, offsets.tolist(), strict=False)]), joined[2], joined[3], n_docs, n_words)
            for q, terms in enumerate(of_query):
                own[terms] = weights[terms]
                held[q] = slab.best(terms, own, held[q], k)
                own[terms] = 0

        for batch in arrived:
            for row in zip(*(batch.column(c) for c in ("ids", "sizes", "ends", "terms", "tf")), strict=True):
                waiting.append([x.as_buffer().to_pybytes() for x in row])
                size += len(waiting[-1][3]) // 4
                if size >= SLAB_TERMS:
                    ask()
                    waiting, size = [], 0
        if size:
            ask()
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // MERGED
        some = [q for q, (scores, _) in enumerate(held) if len(scores)]
        low, ids = (np.concatenate([held[q][c] for q in some] or [np.empty(0, np.int64)]) for c in (0, 1))
        offsets = np.append(0, np.cumsum([len(held[q][0]) for q in some]))
        hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(-low), pa.array(ids)], ["low", "id"]))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int32()), hits], ["query", "part", "hits"])
        released()

    return run


def _merged(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


def _turn(docs: DataFrame, items: list[tuple[int, str]], k: int) -> DataFrame:
    """The rows of some queries."""
    spark, vocabulary = docs.sparkSession, Vocabulary([t for _, t in items])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = written(rows.mapInArrow(_indexed(vocabulary), INDEX), "forward")
    totals = index.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n_docs, n_words = totals.n or 0, totals.words or 1
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms").mapInArrow(_frequencies(len(df)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    hits = index.mapInArrow(_evaluate(vocabulary.of_query, weights, k, n_docs, n_words), HITS)
    best = _merged(_merged(hits, k, "query", "part"), k, "query").select("query", F.posexplode("hits").alias("rank", "h"))
    named = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "query int, item_id long")
    found = F.when(F.col("h.id") != LAST_ID, F.col("h.id"))
    return best.join(F.broadcast(named), "query").select("item_id", (F.col("rank") + 1).cast("int").alias("rank"), found.alias("doc_id"), (-F.col("h.low")).alias("score"))


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of queries (item_id, text) the k best rows of docs (doc_id, text)."""
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    asked = asked.where("text is not null").select("item_id", "text", F.octet_length("text").alias("n"))
    n_turns = max(1, math.ceil((asked.agg(F.sum("n").alias("n")).first()["n"] or 0) / (TURN_BYTES // 2)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(n_turns):  # ids fall into turns by hash: half of TURN_BYTES is expected
        mine = asked if n_turns == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_turns)) == turn)
        items = sorted((r.item_id, r.text) for r in mine.select("item_id", "text").collect())
        if items:
            out = out.unionByName(_turn(docs, items, k))
    return out
