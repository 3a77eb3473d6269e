import random

import numpy as np
import pytest
from brute import LOW, components, near_duplicates, removed_bytes, simhash, suffix_row, suffix_text, windows

from noetica.llm import simhash as S
from noetica.llm import suffix_dedup, window_dedup


def key(r):
    return (LOW if r is None else r)


def plain(rows):
    return [(r[0], r[1]) for r in rows]


def test_near_duplicates(messy, messy_rows, empty):
    got = sorted((key(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(messy).collect())
    assert got == sorted((key(i), f, c) for i, f, c in near_duplicates(plain(messy_rows)))
    assert S.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [2, 512])
def test_links_connect_all(spark, monkeypatch, dense):
    """Random balls around a few centres, with the dense way forced and not."""
    monkeypatch.setattr(S, "DENSE", dense)
    rng = random.Random(dense)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(14):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = S.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)).collect()
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert a in parent and b in parent
        parent[find(a)] = find(b)
    want = components(fps)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        assert groups.setdefault(w, find(f)) == find(f)
    assert len(set(groups.values())) == len(groups)


def test_one_of_each(messy, messy_rows, empty):
    kept = S.one_of_each(messy)
    assert kept.columns == messy.columns and S.one_of_each(empty).count() == 0
    rows = kept.collect()
    roots = components([simhash(r[1]) for r in messy_rows])
    assert len(rows) == len(set(roots))
    least = {}
    for r, root in zip(messy_rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(least.values())
    assert {tuple(r) for r in rows} <= {tuple(r) for r in messy_rows}


def test_windows(messy, messy_rows, empty, small):
    want = windows(plain(messy_rows))
    got = window_dedup.dedup(messy).collect()
    assert sorted((key(r.doc_id), *r[1:]) for r in got) == sorted((key(i), *want[key(i), t or ""]) for i, t in plain(messy_rows))
    assert window_dedup.dedup(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = windows(rows)
    assert sorted(tuple(r) for r in window_dedup.dedup(small).collect()) == sorted((i, *want[i, t or ""]) for i, t in rows)


def test_structured_words(spark):
    """Words and windows on which hashes modulo 2^64 with an odd base are equal."""
    one = two = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(["w"] * 19)
    rows = [(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {one}"), (4, " ".join(one)), (5, " ".join(two)), (6, None), (7, "x" * 300_000 + " " + same)]
    want = windows(rows)
    got = window_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *want[i, t or ""]) for i, t in rows)


def test_equal_first_hashes(monkeypatch, small):
    """Windows with one first hash are told apart by the second."""
    real = window_dedup.window_hashes
    monkeypatch.setattr(window_dedup, "window_hashes", lambda words, width, base: real(words, width, base) % np.uint64(5) if base == window_dedup.BASES[0] else real(words, width, base))
    rows = [(r.doc_id, r.text or "") for r in small.limit(60).collect()]
    import pyarrow as pa

    group = window_dedup._Group(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), 20)
    monkeypatch.undo()
    true = window_dedup._Group(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), 20)
    assert (group.first == true.first).all()


def test_suffixes(messy, messy_rows, empty, small):
    gone = removed_bytes(plain(messy_rows))
    got = suffix_dedup.dedup(messy).collect()
    assert sorted((key(r.doc_id), *r[1:]) for r in got) == sorted((key(i), *suffix_row(t or "", gone[key(i), t or ""])) for i, t in plain(messy_rows))
    assert suffix_dedup.dedup(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in small.collect()]
    gone = removed_bytes(rows)
    assert sorted(tuple(r) for r in suffix_dedup.dedup(small).collect()) == sorted((i, *suffix_row(t or "", gone[i, t or ""])) for i, t in rows)


def test_what_is_left(messy, messy_rows):
    gone = removed_bytes(plain(messy_rows))
    left = suffix_dedup.deduplicated(messy)
    assert left.columns == messy.columns
    want = sorted((key(r[0]), "-" if r[1] is None else suffix_text(r[1], gone[key(r[0]), r[1]]), str(r[2:])) for r in messy_rows)
    assert sorted((key(r.doc_id), "-" if r.text is None else r.text, str(tuple(r)[2:])) for r in left.collect()) == want


@pytest.mark.parametrize("hot", [3, 4096])
def test_groups_of_repeats(spark, messy, messy_rows, empty, hot):
    """Every listed repeat has all its occurrences; every string that two documents share lies in repeats wherever it stands."""
    texts = {(LOW if i is None else i, (t or "").encode()) for i, t in plain(messy_rows)}
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(t)
    groups = {}
    for r in suffix_dedup.maximal_repeats_of(messy, hot=hot).collect():
        groups.setdefault((r.repeat, r.length), set()).add((key(r.doc_id), r.start))
    covered = set()
    for (_, n), places in groups.items():
        assert n >= 50 and len(places) > 1
        strings = {t[a : a + n] for i, a in places for t in by_id[i] if len(by_id[i]) == 1}
        if all(len(by_id[i]) == 1 for i, _ in places):
            (string,) = strings
            want = {(i, k) for i, t in texts for k in range(len(t) - n + 1) if t[k : k + n] == string}
            assert places == want
        covered |= {(i, a + k) for i, a in places for k in range(n - 49)}
    owners = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            owners.setdefault(t[k : k + 50], []).append((i, k))
    for places in owners.values():
        if len({i for i, _ in places}) > 1:
            assert covered >= set(places)
    assert suffix_dedup.maximal_repeats_of(empty).count() == 0


@pytest.mark.parametrize("hot", [5, 4096])
def test_one_gram_in_many_surroundings(spark, hot):
    """A gram of 24 bytes with a thousand different surroundings, a few of them shared."""
    rng = random.Random(7)
    gram = "-" * 24
    around = ["".join(rng.choices("abcdefgh", k=30)) for _ in range(700)]
    rows = [(i, around[rng.randrange(700)][: rng.randint(10, 30)] + gram + around[rng.randrange(60)] + gram + around[i % 700]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = removed_bytes(rows)
    assert sorted(tuple(r) for r in suffix_dedup.dedup(df, hot=hot).collect()) == sorted((i, *suffix_row(t, gone[i, t])) for i, t in rows)


def test_suffix_array_and_intervals():
    rng = random.Random(3)
    for _ in range(200):
        base = bytes(rng.choice(b"ab\0") for _ in range(40))
        texts = sorted({base[rng.randint(0, 8) : rng.randint(20, 40)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 8))})
        text, offset, common, left = suffix_dedup.suffix_array(texts, 10)
        found = [texts[t][o:] for t, o in zip(text, offset, strict=True)]
        assert found == sorted(found)
        assert left.tolist() == [texts[t][o - 1] if o else 256 for t, o in zip(text, offset, strict=True)]
        start, end, length = suffix_dedup.maximal_repeats(common, left, 10)
        got = {(found[a][:n], b - a + 1) for a, b, n in zip(start, end, length, strict=True)}
        want = set()
        for x in range(len(found)):
            shared = None
            for y in range(x + 1, len(found)):
                shared = common[y] if shared is None else min(shared, common[y])
                if shared < 10:
                    break
                at = [i for i in range(len(found)) if found[i][:shared] == found[x][:shared]]
                before = {left[i] for i in at}
                if len(before) > 1 or 256 in before:
                    want.add((found[x][:shared], len(at)))
        assert got == want


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(2)
    middle = rng.integers(97, 100, 300).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 100, 70).astype(np.uint8), middle, np.zeros(66, np.uint8)])
    b = np.concatenate([rng.integers(97, 100, 9).astype(np.uint8), middle, np.zeros(66, np.uint8)])
    pa, ha = suffix_dedup.anchors(a, len(a) - 66, 50)
    pb, hb = suffix_dedup.anchors(b, len(b) - 66, 50)
    n = 300 - 49
    assert (pa[70 : 70 + n] - 70 == pb[9 : 9 + n] - 9).all() and (ha[70 : 70 + n] == hb[9 : 9 + n]).all()


def test_hot_passage(spark):
    """A third of all documents share one passage: results stay whole."""
    rng = random.Random(5)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(40))
    rows = [(i, (passage if i % 3 == 0 else "") + f" own text number {i} " * 3) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone, by_words = removed_bytes(rows), windows(rows)
    assert sorted(tuple(r) for r in suffix_dedup.dedup(df).collect()) == sorted((i, *suffix_row(t, gone[i, t])) for i, t in rows)
    assert sorted(tuple(r) for r in window_dedup.dedup(df).collect()) == sorted((i, *by_words[i, t]) for i, t in rows)
