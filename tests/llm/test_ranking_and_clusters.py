"""Centroid clustering, line dedup and ranked search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from noetica.llm import kmeans, line_dedup, ranked

LOW = -(1 << 63)
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# centroid clustering


def plain_clusters(rows, k, dimensions, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, found, strict=True) if at == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), shas[j]) for (i, _), (d, j) in zip(kept, found, strict=True)]


def vector_rows(dimensions, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (7, dimensions))
    rows = [(i, (centres[i % 7] + rng.normal(0, 0.4, dimensions)).tolist()) for i in range(180)]
    rows += [(200 + i, rows[5][1]) for i in range(40)]  # many equal vectors
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]  # repeated ids and rows
    rows += [(300 + i, rng.integers(-1, 2, dimensions).astype(float).tolist()) for i in range(40)]  # many ties
    rows += [(400, None), (401, []), (402, [1.0] * (dimensions - 1)), (403, [None] + [1.0] * (dimensions - 1)), (404, [float("nan")] * dimensions), (405, [float("inf")] * dimensions), (406, [0.0] * dimensions), (407, [-0.001] * dimensions)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string, ids long"


def frame(spark, rows, n=5):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA).repartition(n)


@pytest.mark.parametrize(("k", "rounds"), [(12, 5), (1, 2), (500, 1), (30, 0)])
def test_clusters(spark, k, rounds):
    rows = vector_rows(6)
    got = kmeans.assigned(frame(spark, rows), k=k, dimensions=6, rounds=rounds).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_clusters(rows, k, 6, rounds)))


def test_clusters_of_nothing(spark):
    assert kmeans.assigned(frame(spark, [], 1), k=3, dimensions=6).count() == 0
    out = kmeans.assigned(frame(spark, [(1, [1.0]), (2, None)], 1), k=3, dimensions=6)
    assert out.columns == [c.split()[0] for c in kmeans.COLUMNS.split(", ")] and out.count() == 0


def test_large_components(spark):
    """Beyond what doubles and 64 bits hold."""
    rows = [(1, [1e30, 0.0]), (2, [-1e300, 0.0]), (3, [4e5, 1.0]), (4, [4e5, 2.0])]
    got = {r.vec_id: r for r in kmeans.assigned(frame(spark, rows), k=2, dimensions=2).collect()}
    assert len(got) == 4 and all(0 <= r.distance < 1 << 63 for r in got.values())
    assert got[3].cluster == got[4].cluster != got[2].cluster


def test_bounds_hold_and_skip():
    """Bounds stay on the right side of exact distances; far fewer of these are calculated than there are."""
    rng = np.random.default_rng(1)
    vectors = (rng.normal(0, 1, (12, 8))[rng.integers(0, 12, 600)] * 900 + rng.normal(0, 40, (600, 8))).astype(np.int64)
    centroids = vectors[:20].copy()
    bounds = kmeans.Bounds(len(vectors), len(centroids))
    bounds.first(vectors, centroids)
    for step in range(6):
        new = np.array([vectors[bounds.near == j].sum(0) // (bounds.near == j).sum() if (bounds.near == j).any() else centroids[j] for j in range(20)])
        bounds.moved(centroids, new)
        bounds.again(vectors, new)
        centroids = new
        square = np.stack([kmeans.squares(vectors, c) for c in centroids], 1)
        assert (bounds.near == square.argmin(1)).all()
        assert (bounds.lower**2 <= square * (1 + 1e-12)).all() and (bounds.upper**2 >= square[np.arange(600), bounds.near]).all()
    assert bounds.calculated < 0.45 * 7 * square.size


# line dedup


def line_key(line):
    return line.strip(" \t\n\v\f\r").translate(CAPITALS)


def plain_lines(rows, least_chars=20, least_docs=3):
    holders, last = Counter(), {}
    for i, t in rows:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            holders[k] += 1
            last[k] = max(LOW if i is None else i, last.get(k, LOW))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := line_key(x)) < least_chars or holders[k] < least_docs or last[k] == (LOW if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = random.Random(8)
    pool = [f"line {i} " + "".join(rng.choice("abcdefgh éß日") for _ in range(rng.randint(5, 40))) for i in range(60)]
    rows = []
    for i in range(150):
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.1 else x) + rng.choice(["", "\r", " \x0b\x0c"]) for x in rng.choices(pool, weights=[60 // (j + 1) + 1 for j in range(60)], k=rng.randint(0, 12))]
        rows.append((i, "\n".join(lines + [f"only here {i} " + "x" * (i % 30)] + lines[:2] * (i % 2))))
    same = "exactly twenty chars"
    rows += [(300 + i, same) for i in range(3)] + [(310 + i, same[:-1]) for i in range(3)]
    rows += [(320, "in two documents only, not three"), (321, "IN TWO documents only, not three"), (322, " in three documents  "), (323, "in three documents xx"), (324, "É in three documents x"), (325, "é in three documents x"), (326, "é in three documents x")]
    rows += [(330, None), (331, ""), (332, "\n\n"), (333, "   "), (None, "line of a null id, long enough"), (None, "line of a null id, long enough"), (340, "line of a null id, long enough"), (None, None)]
    rows += [(350, "a row that is repeated\nand one more"), (350, "a row that is repeated\nand one more"), (350, "a row that is repeated\nother text"), (351, "long " * 40_000 + "\n" + pool[0])]
    rows += [(400 + i, "a line that is in very many documents\n" + str(i)) for i in range(200)]
    return rows


LINE_SCHEMA = "doc_id long, text string, gid int, n_lines string, n_dropped int, key string, rest string, i int, last long"


@pytest.mark.parametrize("group_bytes", [3 << 20, 400])
def test_lines(spark, monkeypatch, group_bytes):
    """In few groups and in many, with many buckets too."""
    monkeypatch.setattr("noetica.llm.common.GROUP_BYTES", group_bytes)
    monkeypatch.setattr(line_dedup, "BUCKET_BYTES", 16 * group_bytes)
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1, "n", 2, "k", "r", 3, 4) for r in rows], LINE_SCHEMA).repartition(7)
    want = plain_lines(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(repr, map(tuple, line_dedup.digests(docs).collect())))
    assert got == sorted(repr((i, n, d, sha(t))) for i, t, n, d in want)
    assert sum(d for *_, d in want) > 200
    whole = line_dedup.deduplicated(docs)
    assert whole.columns == docs.columns
    texts = [(i, None if text is None else t) for (_, text), (i, t, _, _) in zip(rows, want, strict=True)]
    assert sorted(map(repr, map(tuple, whole.collect()))) == sorted(repr((i, t, 1, "n", 2, "k", "r", 3, 4)) for i, t in texts)


def test_lines_of_messy_and_empty(messy, messy_rows, empty):
    got = sorted(repr(tuple(r)) for r in line_dedup.digests(messy).collect())
    assert got == sorted(repr((i, n, d, hashlib.sha256(t.encode()).hexdigest())) for i, t, n, d in plain_lines([r[:2] for r in messy_rows]))
    assert line_dedup.digests(empty).count() == 0 and line_dedup.deduplicated(empty).columns == empty.columns


def test_filters():
    """Everything seen twice is held, in any order, and little else."""
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 32, 300_000, dtype=np.uint32))
    rng.shuffle(values)
    twice, once = values[:40_000], values[40_000:]
    sent = np.concatenate([once, twice, twice])
    rng.shuffle(sent)
    found = line_dedup.twice_seen(sent)
    assert found.holds(twice).all() and found.holds(once).mean() < 0.01


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, queries, k):
    terms = [TERM.findall((t or "").translate(CAPITALS)) for _, t in docs]
    n_docs, n_words = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    counts = [Counter(ts) for ts in terms]
    asked = {}
    for i, t in queries:
        if i is not None and t is not None:
            asked[i] = min(t, asked.get(i, t))
    out = []
    for item, text in asked.items():
        scores = []
        for (i, _), tf, ts in zip(docs, counts, terms, strict=True):
            score = 0
            for t in set(TERM.findall(text.translate(CAPITALS))):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * (100 - 50 + 50 * len(ts) * n_docs // n_words)))
            if score:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def search_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Größe", "ño", "日本語", "x1y", "ÉÉ"]
    weights = [1000 // (i + 1) + 1 for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(600)]
    docs += [(i + 5000, docs[3][1]) for i in range(70)] + [(3, docs[3][1]), (None, docs[3][1]), (None, None), (700, None), (701, ""), (702, " .,;\n"), (703, "W1 w1,w1/w2"), (704, "w250 " * 30_000)]
    rng.shuffle(docs)
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(25, "w1 w2 w3"), (25, "w2"), (26, None), (27, ""), (28, "absent"), (None, "w1"), (29, "w1 w1 W1"), (30, " ".join(words))]
    return docs, queries


@pytest.mark.parametrize(("k", "slab", "turn"), [(50, 1 << 22, 4 << 20), (5, 300, 60)])
def test_ranked(spark, monkeypatch, k, slab, turn):
    monkeypatch.setattr(ranked, "SLAB_TERMS", slab)
    monkeypatch.setattr(ranked, "TURN_BYTES", turn)
    monkeypatch.setattr(ranked, "BATCH_CHARS", 2000)
    docs, queries = search_rows()
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, term int").repartition(6)
    asked = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, doc_id int")
    got = ranked.ranked(table, asked, k)
    assert sorted(map(repr, map(tuple, got.select(*ranked.COLUMNS).collect()))) == sorted(map(repr, plain_ranks(docs, queries, k)))


def test_ranked_of_nothing(spark, messy, messy_rows, empty):
    asked = spark.createDataFrame([(1, "the passage"), (2, "thing and ando")], "item_id long, text string")
    assert ranked.ranked(empty, asked).count() == 0
    assert ranked.ranked(messy, asked.limit(0)).count() == 0
    got = ranked.ranked(messy, asked, 50)
    assert got.columns == ranked.COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_ranks([r[:2] for r in messy_rows], [(1, "the passage"), (2, "thing and ando")], 50)))


def test_blocks_are_skipped():
    """A query reads the blocks of its rare term only, once they fill its list."""
    rng = np.random.default_rng(4)
    n = 64 * 200
    common, rare = np.zeros(n, np.int64), np.flatnonzero(np.arange(n) // 64 % 50 == 7)
    terms = np.concatenate([common, np.ones(len(rare), np.int64)])
    docs = np.concatenate([np.arange(n), rare])
    order = np.lexsort((terms, docs))
    ends = np.cumsum(np.bincount(docs, minlength=n))
    slab = ranked.Slab(np.arange(n), rng.integers(50, 80, n), ends, terms[order], np.ones(len(terms), np.int64), n, 65 * n)
    scores, ids = slab.best(np.array([0, 1]), np.array([2, 9000]), (np.empty(0, np.int64),) * 2, 50)
    assert set(ids.tolist()) <= set(rare.tolist()) and (np.diff(scores) <= 0).all()
    assert slab.scored < 10
