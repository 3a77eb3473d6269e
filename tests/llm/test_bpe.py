import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noetica.llm import bpe, packing

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'’streveldmS1٣½éж中😀.,!　\x1c<|>a"), max_size=5))
def test_boundaries(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))} if not hasattr(test_boundaries, "e") else None
    if ranks:
        test_boundaries.e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encoder(MULTI).encode_batch(texts)
    assert [g.tolist() for g in got] == [test_boundaries.e.encode_ordinary(t) for t in texts]
    assert [bpe.encoder(MULTI).decode(g) for g in got] == [t.encode() for t in texts]


def test_digests(messy, messy_rows, multi, empty):
    want = sorted((r[0] or -1, len(ids := multi.encode_ordinary(r[1] or "")), sha(",".join(map(str, ids))), sha(r[1] or "")) for r in messy_rows)
    got = sorted((r.doc_id or -1, *r[1:]) for r in bpe.digests(messy, MULTI).collect())
    assert got == want and bpe.digests(empty, MULTI).count() == 0


def test_offsets(spark):
    df = spark.createDataFrame([(1, "ünder the wörld"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode(df, MULTI).collect()}
    data, row = "ünder the wörld".encode(), rows[1]
    starts = [0, *row.ends[:-1]]
    assert b"".join(data[a:b] for a, b in zip(starts, row.ends, strict=True)) == data and row.ends[-1] == len(data) and rows[2].ids == []


def test_long_slices(multi):
    texts = ["a" * 4000, "!?" * 2000, "ab" * 500 + " " * 300, "".join(random.Random(1).choices("abcde", k=3000))]
    assert [x.tolist() for x in bpe.encoder(MULTI).encode_batch(texts)] == [multi.encode_ordinary(t) for t in texts]


def test_small_cache(monkeypatch, small, multi):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 50)
    texts = [r.text for r in small.limit(40).collect()]
    use = bpe.Encoder(MULTI)
    assert [use.encode_batch([t])[0].tolist() for t in texts] == [multi.encode_ordinary(t) for t in texts]


def thue_morse(n):
    """Two complementary words on which polynomial hashes with an odd base modulo 2^64 are equal."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_slices_are_never_taken_for_others(multi):
    texts = list(thue_morse(11)) + [w[:k] for w in thue_morse(7) for k in (14, 15, 16, 17, 128, 129)] + ["\0" * k for k in range(1, 20)]
    use = bpe.Encoder(MULTI)
    assert [x.tolist() for x in use.encode_batch(texts)] == [multi.encode_ordinary(t) for t in texts]
    assert [use.decode(x) for x in use.encode_batch(texts)] == [t.encode() for t in texts]


def test_colliding_slots():
    """Rows that fall into one slot are told apart."""
    import numpy as np

    table = bpe.Table(300)
    table._slot = lambda first, second: np.zeros(len(first), np.int64)
    first, second = np.arange(200, dtype=np.uint64), np.arange(200, dtype=np.uint64) % np.uint64(3)
    table.add(first[:150], second[:150])
    assert table.find(first, second).tolist() == [*range(150), *[-1] * 50] and (table.find(first, second + np.uint64(1)) == -1).all()


def test_added_tokens():
    model = Tokenizer.from_file(PLAIN)
    texts = ["<|endoftext|> x", "a  <|endoftext|><|endoftext|>\n b's", "<|endoftext|", "plain", "", "é<|endoftext|>"]
    assert [x.tolist() for x in bpe.encoder(PLAIN).encode_batch(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    model.encode_special_tokens = True
    assert [x.tolist() for x in bpe.encoder(PLAIN, False).encode_batch(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(messy, messy_rows, empty):
    import zlib
    from collections import defaultdict

    import numpy as np

    model = Tokenizer.from_file(PLAIN)
    pieces = packing.packed(messy, PLAIN, capacity=256).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256
    want = defaultdict(list)
    for r in messy_rows:
        want[r[0]].append(np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    assert set(want) == set(documents)
    for i, texts in want.items():
        assert sum(p[1] for p in documents[i]) == sum(map(len, texts))
        if len(texts) == 1:
            for start, length, crc, n in documents[i]:
                assert zlib.crc32(texts[0][start : start + length].tobytes()) == crc and n == len(texts[0])
            covered = sorted((s, s + n) for s, n, _, _ in documents[i])
            assert [a for a, _ in covered] == [0, *(b for _, b in covered[:-1])]
    assert packing.packed(empty, PLAIN).count() == 0


def test_first_fit_decreasing():
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 300)
    bins = packing.first_fit_decreasing(sizes, 100)
    room, want = [], np.empty(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    assert (bins == want).all()
    pieces = packing.pack(sizes * 3, 100)
    total = int(sizes.sum() * 3)
    assert sum(p[2] for p in pieces) == total and len({p[3] for p in pieces}) == -(-total // 100)
