"""Language identification by words first, then by shorter and shorter n-grams (operator 8).

A known word scores by its log frequency in each language; an unseen word by the n-grams of the greatest length at which
any of its n-grams is known. The model is fitted on a sample of the labelled documents: DOCS_PER_LANGUAGE of each language
are expected, drawn by a hash of id and text (all of a language that has fewer); that bound is a parameter and the only one. All
words of the sample are known, whatever their number, and all n-grams of these; a word over LONGEST letters, of which there may be
one of any length, is known by its n-grams only where other words have them. A caller can ask for the most frequent n_words in equal
shares of the languages. Word counts come from Spark; only the sample's vocabulary reaches the driver. All values of lang
are learned; more than MOST_LANGUAGES of them are taken for an error in the column and raise ValueError. Prediction is a map
over the scan.

Defined results: a text that is null or has no letter (Unicode categories L*) is `und` with score 0; where nothing of a text
is known, the languages' shares among the documents decide; ties go to the language that comes first by name; without
training rows, and so for an empty table, every text is `und`, and an empty table gives no rows; rows with a null id
can be learned from, those with a null lang can't; texts of any length are taken whole, TOGETHER words at a time; repeated rows
get equal results; other columns of the input, whatever their names, are ignored (identified() keeps them all).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetica.llm.bpe import ragged
from noetica.llm.common import held_out, released, sliced, texts_of

#: Bounds of the model.
DOCS_PER_LANGUAGE, LONGEST, MOST_LANGUAGES = 250, 64, 1_000
#: Lengths of n-grams, longest first.
GRAMS = (5, 4, 3, 2, 1)
#: Words whose scores a worker keeps, in bytes of scores, and words that it scores together.
CACHED_BYTES, TOGETHER = 2 << 20, 100_000


def _letters() -> re.Pattern:
    r"""Runs of letters: `[^\W\d_]` without the numbers that \W leaves in (categories Nl and No)."""
    numbers = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("Nl", "No")]
    starts = [c for c in numbers if unicodedata.category(chr(c - 1)) not in ("Nl", "No")]
    ends = [c for c in numbers if c == 0x10FFFF or unicodedata.category(chr(c + 1)) not in ("Nl", "No")]
    return re.compile(r"[^\W\d_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]+")


_LETTERS = _letters()


def _marked(word: str, size: int) -> str:
    return f"^{word}$" if size > 1 else word


def _grams(words: list[str], size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different n-grams, of each n-gram in the words which one it is, and of which word)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = np.maximum(lengths - size + 1, 0)
    starts = ragged(np.cumsum(lengths) - lengths, n)
    if not len(starts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    windows = points[starts[:, None] + np.arange(size)]
    letters, number = np.unique(points, return_inverse=True)
    bits = max(1, int(len(letters) - 1).bit_length())
    if bits * size <= 64:  # exact keys of one word
        keys = np.zeros(len(starts), np.uint64)
        for k in range(size):
            keys = (keys << np.uint64(bits)) | number[starts + k].astype(np.uint64)
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    else:
        _, first, of = np.unique(windows, axis=0, return_index=True, return_inverse=True)
    raw = windows[first].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)], of.ravel(), np.repeat(np.arange(len(words)), n)


class Model:
    """Log frequencies by language of words and of n-grams: a row number for each, and one array of rows."""

    def __init__(self, languages: list[str], shares: np.ndarray, words: list[str], counts: np.ndarray):
        self.languages, self.shares = languages, shares
        self.words = {w: i for i, w in enumerate(words)}
        self.word_logs = self._logs(counts)
        self.grams: list[tuple[dict[str, int], np.ndarray]] = []
        for size in GRAMS:
            grams, of, source = _grams([_marked(w, size) for w in words], size)
            sums = np.stack([np.bincount(of, counts[source, k], len(grams)) for k in range(len(languages))], 1) if languages else np.zeros((0, 0))
            self.grams.append(({g: i for i, g in enumerate(grams)}, self._logs(sums)))

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.1) / (counts.sum(0) + 0.1 * (len(counts) + 1))).astype(np.float32)

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of logs for each word: its own, or the mean of its n-grams of the first length that has any."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        own = np.array([self.words.get(w, -1) for w in words], np.int64)
        out[own >= 0] = self.word_logs[own[own >= 0]]
        left = np.flatnonzero(own < 0).tolist()
        for size, (row, logs) in zip(GRAMS, self.grams, strict=True):
            rows, starts, hit, still = [], [], [], []
            for k in left:
                marked = _marked(words[k], size)
                found = [r for i in range(len(marked) - size + 1) if (r := row.get(marked[i : i + size], -1)) >= 0]
                if found:
                    starts.append(len(rows))
                    rows += found
                    hit.append(k)
                else:
                    still.append(k)
            if hit:
                counts = np.diff([*starts, len(rows)])[:, None]
                out[hit] = np.add.reduceat(logs[rows], starts, axis=0) / counts
            left = still
        return out


class Scorer:
    """Predicts languages; keeps the scores of words as rows of one array, so that texts are one gather and sums."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        n = max(1, len(self.model.languages))
        self.scores = np.zeros((CACHED_BYTES // (4 * n) + TOGETHER, n), np.float32)

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Summed logs of each text's words, which are TOGETHER at most."""
        row = self.row
        new = list(set(chain.from_iterable(texts)).difference(row))
        if len(row) + len(new) > len(self.scores):
            self.reset()
            return self.sums(texts)
        self.scores[len(row) : len(row) + len(new)] = self.model.of_words(new)
        row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
        rows = np.fromiter(map(row.__getitem__, chain.from_iterable(texts)), np.int64)
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.model.languages)))
        some = sizes > 0
        if len(rows):
            out[some] = np.add.reduceat(self.scores[rows].astype(np.float64), (np.cumsum(sizes) - sizes)[some], axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        n = len(self.model.languages)
        logs, known = np.zeros((len(texts), n)), np.zeros(len(texts), bool)
        held: list[tuple[int, list[str]]] = []

        def close() -> None:
            if held and n:
                np.add.at(logs, [i for i, _ in held], self.sums([w for _, w in held]))
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            words = _LETTERS.findall(text.lower())
            known[i] = bool(words) and n > 0
            for a in range(0, len(words), TOGETHER):
                part = words[a : a + TOGETHER]
                if size + len(part) > TOGETHER:
                    close()
                    size = 0
                held.append((i, part))
                size += len(part)
        close()
        if not n:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs += np.log(self.model.shares)
        odds = np.exp(logs - logs.max(1, keepdims=True))
        best = odds.argmax(1)
        score = np.where(known, odds.max(1) / odds.sum(1), 0.0)
        return [self.model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], score


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, n_words: int | None = None) -> Model:
    """Learns from the text and lang of documents that are not held out."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    by_language = train.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not by_language:
        return Model([], np.empty(0), [], np.empty((0, 0)))
    if len(by_language) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    languages = sorted(r.lang for r in by_language)
    size = {r.lang: r["count"] for r in by_language}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / size[lang]))])
    drawn = train.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")])

    def count(arrived):
        for batch in arrived:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
                found.setdefault(lang, Counter()).update(w for w in _LETTERS.findall(text.lower()) if len(w) <= LONGEST)
            langs = np.repeat(np.arange(len(found)), [len(c) for c in found.values()])
            columns = [pa.array(list(found), pa.string()).take(pa.array(langs)), pa.array(chain.from_iterable(found.values()), pa.string()), pa.array(chain.from_iterable(c.values() for c in found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    counted = drawn.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    # a language's most frequent words, with their counts in all languages beside them
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    by_word = ranked.groupBy("word").agg(F.min("rank").alias("best"), F.collect_list(F.struct("lang", "n")).alias("found"))
    if n_words is not None:
        by_word = by_word.where(F.col("best") <= max(1, n_words // len(languages)))
    top = by_word.orderBy("word").select("word", "found").toArrow()  # the sample's words
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((top.num_rows, len(languages)))
    for i, found in enumerate(top.column("found").to_pylist()):
        for x in found:
            counts[i, place[x["lang"]]] = x["n"]
    shares = np.array([size[lang] for lang in languages], float)
    return Model(languages, shares / shares.sum(), top.column("word").to_pylist(), counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score beside doc_id and held_out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(arrived):
        scorer = Scorer(sent.value)
        for batch in sliced(arrived):
            languages, scores = scorer.predict(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        del scorer
        released()

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of docs whose text has a language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(arrived):
        scorer = Scorer(sent.value)
        for batch in sliced(arrived, place):
            languages, _ = scorer.predict(texts_of(batch.column(place)))
            yield batch.filter(pa.array([x != "und" for x in languages], pa.bool_()))
        del scorer
        released()

    return docs.mapInArrow(run, docs.schema)
