"""Personal data: bootstrapping against a plain loop, linear time on texts full of identifiers, clashing columns."""

import random
import re
import time
from collections import defaultdict

import pytest

from noetica.llm import pii


def plain_pattern(text, start):
    tokens = [t[-pii.WIDTH :].lower() for t in text[:start].split()[-2:]]
    return re.sub("[0-9]", "0", " ".join(tokens)) if len(tokens) == 2 else ""


def plain_unseen(text, base):
    found = [(*m.span(), "number") for m in pii._NUMBER_LIKE.finditer(text)] + [(*m, "spelt") for m in pii.spelt(text)]
    out = []
    for a, b, form in sorted(found):
        if all(b <= x or y <= a for x, y, _ in out) and not any(x < b and a < y for _, x, y in base):
            out.append((a, b, form))
    return out


def plain_learned(texts, rounds=3, confidence=0.9, support=5):
    """Patterns by loops over all pairs of patterns and instances."""
    graph = {}
    for text in texts:
        base = pii.base_spans(text or "")
        for a, b, kind in [(a, b, pii.KINDS[k]) for k, a, b in base] + [(a, b, None) for a, b, _ in plain_unseen(text or "", base)]:
            if p := plain_pattern(text, a):
                old = graph.get((p, text[a:b]))
                graph[p, text[a:b]] = kind if old is None or kind is not None and kind > old else old
    sizes, seeds = defaultdict(int), defaultdict(int)
    for (p, _), kind in graph.items():
        sizes[p] += 1
        if kind:
            seeds[p, kind] += 1
    scores = {key: n / sizes[key[0]] for key, n in seeds.items() if n >= support}
    sure = dict.fromkeys(scores, 0)
    unknown = [pair for pair, kind in graph.items() if kind is None]
    for _ in range(rounds):
        belief = defaultdict(float)
        for p, instance in unknown:
            for kind in pii.KINDS:
                if (p, kind) in scores:
                    belief[instance, kind] = max(belief[instance, kind], scores[p, kind])
        gained, found = defaultdict(float), defaultdict(int)
        for p, instance in unknown:
            for kind in pii.KINDS:
                if (instance, kind) in belief:
                    gained[p, kind] += belief[instance, kind]
                    found[p, kind] += belief[instance, kind] >= confidence
        keys = [key for key in {*seeds, *gained} if seeds[key] + found[key] >= support]
        scores, sure = {key: (seeds[key] + gained[key]) / sizes[key[0]] for key in keys}, {key: found[key] for key in keys}
    out = {}
    for p in {p for p, _ in scores}:
        all_seeds, all_sure = sum(seeds[p, kind] for kind in pii.KINDS), sum(n for (q, _), n in sure.items() if q == p)
        good = [(scores[p, kind], kind) for q, kind in scores if q == p and scores[p, kind] >= confidence and seeds[p, kind] >= confidence * all_seeds and sure[p, kind] >= confidence * all_sure]
        if good:
            out[p] = max(good)[1]
    return out


def plain_added(text, patterns):
    base = pii.base_spans(text or "")
    return [(patterns[p], a, b) for a, b, form in plain_unseen(text or "", base) if (p := plain_pattern(text, a)) in patterns and (form == "spelt") == (patterns[p] == "email")]


def told(rng):
    """A text of contexts, some of which belong to a kind, some to none and some to two."""
    contexts = {"call number": "phone", "ring me": "phone", "mail to": "email", "write at": "email", "from host": "ip", "pay by": "card", "serial no": None, "order id": None, "reach us": "both"}
    known = {
        "phone": lambda: f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 1100)}",
        "email": lambda: f"u{rng.randint(0, 60)}@mail{rng.randint(0, 3)}.example.com",
        "ip": lambda: f"10.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 255)}",
        "card": lambda: rng.choice(["4111 1111 1111 1111", "5500 0000 0000 0004", "340000000000009", "6011000000000004", "4012888888881881", "5105105105105100"]),
    }
    hidden = {"email": lambda: f"u{rng.randint(0, 20)} [at] mail example [dot] com".replace(" example", "") , None: lambda: f"{rng.randint(10**6, 10**7 - 1)}-{rng.randint(100, 999)}"}
    parts = []
    for _ in range(rng.randint(1, 12)):
        context, kind = rng.choice(list(contexts.items()))
        if kind == "both":
            kind = rng.choice(["phone", "email"])
        form = known[kind] if kind and rng.random() < 0.93 else hidden["email" if kind == "email" and rng.random() < 0.8 else None]
        parts.append(f"{rng.choice(['so', 'and', 'well'])} {context} {form()}" + rng.choice([".", ";", ",", " now"]))
    return " ".join(parts)


@pytest.mark.parametrize("seed", range(3))
def test_bootstrapping_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, told(rng)) for i in range(250)] + [(900, None), (901, ""), (902, "call number"), (None, told(rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_learned([t for _, t in rows])
    table = pii.learned_patterns(df)
    assert {r.pattern: r.kind for r in table.collect()} == want and len(want) >= 3
    spans = {i: sorted([(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t or "")] + plain_added(t, want), key=lambda x: (pii.KINDS.index(x[0]), *x[1:])) for i, t in rows}
    got = pii.found(df, table).collect()
    assert {r.doc_id: r.spans for r in got} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in s) for i, s in spans.items()}
    assert sum(len(plain_added(t, want)) for _, t in rows) > 20


def test_texts_full_of_identifiers_take_linear_time():
    """Many base spans and many candidates, many long tokens before them, candidates inside one long token: as the plain rule, and 10 MB in seconds."""
    makes = [lambda n: "a@b.co 12345678 x " * (n // 18), lambda n: ("b" * 1100 + " 12345678 ") * (n // 1110), lambda n: "x,12345678," * (n // 11), lambda n: "c" * 900 + " " + ("d" * 1500 + " (at] 1234567 [at] e.f ") * (n // 1523)]
    for make in makes:
        text = make(40_000)
        base = pii.base_spans(text)
        more = pii.unseen(text, base)
        assert more == plain_unseen(text, base) and more
        assert pii.patterns_of(text, [a for a, _, _ in more]) == {a: plain_pattern(text, a) for a, _, _ in more}
    for make in makes:
        text, began = make(10_000_000), time.perf_counter()
        base = pii.base_spans(text)
        more = pii.unseen(text, base)
        pii.patterns_of(text, [a for _, a, _ in base] + [a for a, _, _ in more])
        assert time.perf_counter() - began < 60


def test_clashing_columns_with_learned_patterns(spark):
    """All other columns stay, whatever they are called, also when added spans are joined."""
    names = ["doc_id", "text", "_noetica_text", "_noetica_added", "key", "added", "rest", "pattern", "kind", "start", "a.b", "none"]
    rows = [(i, f"please ring me: call number +1 555 010 {1000 + i} now", *[f"{n}{i}" for n in names[2:]]) for i in range(8)]
    rows += [(50, "so call number 555-0100-222 today", *names[2:]), (51, None, *[None] * 10), (None, "so call number 555-0100-222 today", *names[2:])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    clean = pii.redacted(df)
    assert clean.columns == names
    got = {tuple(r) for r in clean.collect()}
    assert len(got) == len(rows) and {r[2:] for r in got} == {r[2:] for r in rows}
    assert (50, "so call number [PHONE] today", *names[2:]) in got and (None, "so call number [PHONE] today", *names[2:]) in got
    assert {r.doc_id: r.spans for r in pii.found(df).collect()}[50] == "phone:15:27"
    assert pii.redacted(df.select("text")).columns == ["text"]
