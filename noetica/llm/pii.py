"""Personal data by base forms and bootstrapped contexts (operator 7).

Base forms (email, ip, card, phone) give the seeds. Every identifier-like string of a text, seed or not, is an instance;
the last WIDTH characters of each of the two tokens before it are its lexical pattern. Spark scores the graph of patterns and instances in rounds: a
pattern by the share of its instances that are of a kind, and by how many different ones there are; an instance by the
best of its patterns; in each round, patterns with enough believed instances join those with enough seeds. All patterns
that end with high confidence are a table, joined with the patterns' occurrences; they find further identifiers of their
kind: number-like strings and written-out addresses that the base forms miss. Such spans are added; base spans
stay, and an added span never overlaps one.

A pattern counts once it has SUPPORT different seeds or believed instances; that and the confidence are parameters.

Defined results: null text counts as empty; texts without digits and addresses have no span; an empty table gives no rows;
texts of any length are searched whole, in time that grows with the length; repeated rows get equal results and their
instances count once; rows with a null id keep it; other columns of the input, whatever their names, are ignored (redacted()
keeps them all).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetica.llm.common import released, sliced, texts_of, uncarried, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, least confidence and different instances of a pattern.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.9, 5

# The base forms.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # tried at the starts of runs only, where its leftmost matches are
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Identifier-like strings: runs of digits with separators, and addresses written out.
_NUMBER_LIKE = re.compile(r"(?<![^\W_])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![^\W_])")
_SPELT_DOMAIN = re.compile(r"[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+")
#: Characters of a token that a pattern has, and characters before an instance that nearly always hold two tokens.
WIDTH, NEAR = 40, 1024


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _local_start(text: str, end: int, free: int) -> int:
    """Where the run of local-part characters that ends at a place starts, not before `free`."""
    while end > free and _LOCAL.match(text[end - 1]):
        end -= 1
    return end


def spelt(text: str) -> list[tuple[int, int]]:
    """Addresses written out, as a leftmost search for a local part, `[at]` and a domain would find them, from each `[at]` outwards."""
    found, free = [], 0
    for m in _SPELT_DOMAIN.finditer(text):
        at = m.start()
        start = _local_start(text, at, free)
        if start == at and at > free and text[at - 1] == " ":
            start = _local_start(text, at - 1, free)
            if start == at - 1:
                continue
        if start < at:
            found.append((start, m.end()))
            free = m.end()
    return found


def _emails(text: str) -> list[tuple[int, int]]:
    """As a leftmost search of the form would find them, from each @ outwards: no scan of every word."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        if (m := _DOMAIN.match(text, at)) is not None:
            start = _local_start(text, at, free)
            if start < at:
                found.append((start, m.end()))
                free = after = m.end()
        at = text.find("@", after)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base forms, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


_TOKEN = re.compile(r"\S+")


def patterns_of(text: str, starts: Iterable[int]) -> dict[int, str]:
    """For each place the two tokens before it, of each the last WIDTH characters, in lower case, digits as 0; empty where there are fewer.

    Where the NEAR characters before a place don't hold them, the text is walked on from the last such place, so that all places
    together walk it once.
    """
    out, before, last, at = {}, (0, 0), (0, 0), 0
    for start in sorted(set(starts)):
        tokens = text[max(0, start - NEAR) : start].rsplit(None, 2)
        if start > NEAR and (len(tokens) < 2 or len(tokens) == 2 and len(tokens[0]) < WIDTH):
            for m in _TOKEN.finditer(text, at, start):
                if m.start() == last[1]:  # a token that the place before was in
                    last = (last[0], m.end())
                else:
                    before, last = last, m.span()
            at = start
            tokens = [text[max(a, b - WIDTH) : b] for a, b in (before, last) if a < b]
        tokens = [t[-WIDTH:].lower() for t in tokens[-2:]]
        out[start] = re.sub(r"[0-9]", "0", " ".join(tokens)) if len(tokens) == 2 else ""
    return out


def pattern_of(text: str, start: int) -> str:
    return patterns_of(text, [start])[start]


def unseen(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, form) of identifier-like strings that no base span touches; form: number or spelt. Both lists are walked once."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    found = [(*m.span(), "number") for m in _NUMBER_LIKE.finditer(text)]
    if "at" in text and ("[" in text or "(" in text):
        found += [(*m, "spelt") for m in spelt(text)]
    out, free, i = [], 0, 0
    for a, b, form in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= free and not (i < len(taken) and taken[i][0] < b):
            out.append((a, b, form))
            free = b
    return out


def _may_hold(text: str) -> bool:
    return "@" in text or "[at]" in text or "(at)" in text or _DIGIT.search(text) is not None


_DIGIT = re.compile("[0-9]")


def instances(docs: DataFrame) -> DataFrame:
    """(pattern, instance, kind): kind is null for what no base form knows. A map over the scan."""

    def run(arrived):
        for batch in sliced(arrived):
            rows = []
            for text in texts_of(batch.column("text")):
                if not _may_hold(text):
                    continue
                base = base_spans(text)
                more = unseen(text, base)
                patterns = patterns_of(text, [a for _, a, _ in base] + [a for a, _, _ in more])
                rows += [(patterns[a], text[a:b], KINDS[k]) for k, a, b in base]
                rows += [(patterns[a], text[a:b], None) for a, b, _ in more]
            rows = [r for r in rows if r[0]]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["pattern", "instance", "kind"])
        released()

    return docs.select("text").mapInArrow(run, "pattern string, instance string, kind string").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def learned_patterns(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind) of all patterns of high confidence, a table.

    A pattern's confidence in a kind is the mean score of its different instances for that kind; a seed scores 1 for its
    own kind and 0 for others, any other instance the greatest confidence of its patterns in the round before. A pattern
    counts for a kind once it has enough seeds of it, or instances that are believed with high confidence, or both together.
    """
    graph = written(instances(docs), "instances")
    seeds = graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("size"))
    bases = seeds.where(F.col("seeds") >= support).join(sizes, "pattern")
    scores = written(bases.select("pattern", "kind", "seeds", F.lit(0).cast("long").alias("sure"), (F.col("seeds") / F.col("size")).alias("score")), "patterns")
    if scores.isEmpty():
        return scores.select("pattern", "kind")
    unknown = graph.where("kind is null").select("pattern", "instance")
    for _ in range(rounds):
        believed = unknown.join(scores.select("pattern", "kind", "score"), "pattern").groupBy("instance", "kind").agg(F.max("score").alias("belief"))
        gained = unknown.join(believed, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("gained"), F.count_if(F.col("belief") >= confidence).alias("sure"))
        found = seeds.join(gained, ["pattern", "kind"], "full").fillna(0, ["seeds", "gained", "sure"]).where(F.col("seeds") + F.col("sure") >= support).join(sizes, "pattern")
        scores = written(found.select("pattern", "kind", "seeds", "sure", ((F.col("seeds") + F.col("gained")) / F.col("size")).alias("score")), "scores")
    # a pattern is used for the kind that most of its seeds and believed instances have, and only if nearly all have it
    pure = seeds.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds"))
    sure = scores.groupBy("pattern").agg(F.sum("sure").alias("all_sure"))
    best = scores.join(pure, "pattern", "left").join(sure, "pattern").where((F.col("score") >= confidence) & (F.col("seeds") >= confidence * F.coalesce("all_seeds", F.lit(0))) & (F.col("sure") >= confidence * F.col("all_sure")))
    return written(best.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")), "learned")


def learned(docs: DataFrame, **bounds) -> dict[str, str]:
    """learned_patterns() as a dictionary, for looking at; found() and redacted() join the table."""
    return {r.pattern: r.kind for r in learned_patterns(docs, **bounds).collect()}


def _key():
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key")


def added_spans(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """For each different text with any, by the hash of the text: the identifier-like strings after a pattern of their kind."""

    def run(arrived):
        for batch in sliced(arrived):
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), strict=True):
                if _may_hold(text):
                    more = unseen(text, base_spans(text))
                    patterns = patterns_of(text, [a for a, _, _ in more])
                    rows += [(key, patterns[a], a, b, form == "spelt") for a, b, form in more if patterns[a]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "pattern", "start", "end", "spelt"])
        released()

    places = docs.select(_key(), "text").mapInArrow(run, "key string, pattern string, start long, end long, spelt boolean").distinct()
    hits = places.join(patterns, "pattern").where(F.col("spelt") == (F.col("kind") == "email"))
    return hits.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))


def _with_added(docs: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """(text, rest, added): texts with all other columns in the struct `rest`, whatever their names, and with added spans or null.

    Texts are shuffled by their hash if there are patterns and more spans than Spark broadcasts; else they stay where they are.
    """
    patterns = learned_patterns(docs) if patterns is None else patterns
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*others or [F.lit(0).alias("none")]).alias("rest"))
    if patterns.isEmpty():
        return rows.withColumn("added", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    added = written(added_spans(docs, patterns), "added")
    return rows.withColumn("key", _key()).join(added, "key", "left").drop("key")


def _added_of(batch: pa.RecordBatch) -> list[list[tuple[int, int, int]]]:
    return [[(KINDS.index(x["kind"]), x["start"], x["end"]) for x in found or []] for found in batch.column("added").to_pylist()]


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; patterns: as learned_patterns() gives them."""
    none = hashlib.sha256(b"").hexdigest()

    def run(arrived):
        for batch in sliced(arrived):
            counts, shas, spans = np.zeros((4, batch.num_rows), np.int64), [], []
            for i, (text, added) in enumerate(zip(texts_of(batch.column("text")), _added_of(batch), strict=True)):
                base = base_spans(text) if _may_hold(text) else []
                for k, _, _ in base:
                    counts[k, i] += 1
                shas.append(hashlib.sha256(_digest(base).encode()).hexdigest() if base else none)
                spans.append(_digest(base + added) if _may_hold(text) else "")
            yield pa.RecordBatch.from_arrays([batch.column("rest").field("doc_id").cast(pa.int64()), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], [c.split()[0] for c in COLUMNS.split(", ")])
        released()

    return _with_added(docs.select("doc_id", "text"), patterns).mapInArrow(run, COLUMNS)


def redacted(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """All rows and columns of docs, every span of the text replaced by its kind in brackets; overlapping spans become one."""
    def clean(text: str | None, added: list[tuple[int, int, int]]) -> str | None:
        if text is None or not _may_hold(text):
            return text
        base = base_spans(text)
        spans = sorted((a, b, k) for k, a, b in base + added)
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(arrived):
        for batch in sliced(arrived):
            texts = [clean(t, a) for t, a in zip(batch.column("text").to_pylist(), _added_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], ["text", "rest"])
        released()

    rows = _with_added(docs, patterns)
    return uncarried(rows.mapInArrow(run, rows.select("text", "rest").schema), docs)
