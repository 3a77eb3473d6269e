"""Quality classifier: regularised quadratic discriminant analysis over document statistics (operator 4).

Each class is a Gaussian over transformed statistics of the text. Class covariances are shrunk towards the pooled one
and towards its mean variance; scores are differences of Mahalanobis log densities by Cholesky factors that are
computed once. Statistics are one map over the scan, kept as a small table that both fitting and scoring read. Fitting
is a sum of counts, statistics and their products by class in Spark, so all labelled rows count and the driver sees a
fixed number of sums.

Defined results: null text counts as empty and is scored like any other; labels that are null or of ids that no document
has are not used; an id that is labelled or present twice counts each time; without labels of both classes every score is
the share of label 1 (0.5 with none); an empty table gives no rows; texts of any length are described whole; null ids are scored
and never trained on; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetica.llm.common import held_out, texts_of, written

#: Statistics of a text, and the shrinkage towards the pooled covariance and towards a multiple of the identity.
STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "marks", "bars", "repeats", "distinct", "top_word", "line_length", "high_bytes")
TO_POOLED, TO_IDENTITY = 0.05, 0.01
#: Log-density differences are divided by this before the logistic function, as statistics are not independent.
TEMPERATURE = 4.0
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x20, 0x09, 0x0A, 0x0D, *b".,;:'\"()-!?|"]] = True


def statistics(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    data = text.encode()
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    letters = max(1, int(of[0x41:0x5B].sum() + of[0x61:0x7B].sum()))
    counts = Counter(words)
    repeats = sum(map(eq, words, words[1:]))
    few = n + 4.0  # short texts are pulled to the middle, as they say little
    return [
        np.log1p(n),
        np.log1p(size / (n + 1.0)),
        np.sqrt(of[~_PLAIN].sum() / size),
        np.sqrt(of[0x41:0x5B].sum() / letters),
        np.sqrt(of[0x30:0x3A].sum() / size),
        np.sqrt((of[0x21] + of[0x3F]) / few),
        np.sqrt(of[0x7C] / few),
        np.sqrt(repeats / few),
        np.log1p(len(counts)) / np.log1p(n + 1.0),
        np.sqrt(max(counts.values(), default=0) / few),
        np.log1p(size / (of[0x0A] + 1.0)),
        np.sqrt(of[0x80:].sum() / size),
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats): a map over the scan."""

    def run(arrived):
        for batch in arrived:
            stats = [statistics(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "held_out", "stats"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, stats array<double>")


class Discriminant:
    """Two Gaussians, by class: weight, mean and Cholesky factor of the regularised covariance."""

    def __init__(self, sums: dict[int, np.ndarray]):
        d = len(STATISTICS)
        self.share = None
        n = {c: s[0] for c, s in sums.items() if s[0] > 0}
        if len(n) < 2:
            self.share = 0.5 if not n else float(1 in n)
            return
        means = {c: sums[c][1 : d + 1] / n[c] for c in n}
        covariances = {c: sums[c][d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in n}
        total = sum(n.values())
        pooled = sum(covariances[c] * (n[c] / total) for c in n)
        self.classes = {}
        for c in n:
            own = (1 - TO_POOLED) * covariances[c] + TO_POOLED * pooled
            own = (1 - TO_IDENTITY) * own + TO_IDENTITY * max(np.trace(own) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.classes[c] = (means[c], factor, np.log(n[c] / total) - np.log(np.diag(factor)).sum())

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(stats), self.share)
        logs = {}
        for c, (mean, factor, weight) in self.classes.items():
            solved = np.linalg.solve(factor, (stats - mean).T)
            logs[c] = weight - 0.5 * (solved**2).sum(0)
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From the statistics of documents that are not held out and their labels."""
    rows = stats.where(~F.col("held_out")).join(labels.select(F.col("doc_id").cast("long"), (F.col("quality") > 0).cast("int").alias("class")).where("class is not null"), "doc_id")

    def add_up(arrived):
        sums = {c: np.zeros(1 + len(STATISTICS) + len(STATISTICS) ** 2) for c in (0, 1)}
        for batch in arrived:
            classes = batch.column("class").to_numpy()
            x = batch.column("stats").flatten().to_numpy().reshape(len(classes), -1)
            for c, s in sums.items():
                own = x[classes == c]
                s += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        place = np.arange(len(sums[0]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(place)).astype(np.int32)), pa.array(np.tile(place, 2).astype(np.int32)), pa.array(np.concatenate([sums[0], sums[1]]))], ["class", "place", "value"])

    found = rows.select("class", "stats").mapInArrow(add_up, "class int, place int, value double").groupBy("class", "place").agg(F.sum("value").alias("value")).collect()
    sums = {c: np.zeros(1 + len(STATISTICS) + len(STATISTICS) ** 2) for c in (0, 1)}
    for r in found:
        sums[r["class"]][r.place] = r.value
    return Discriminant(sums)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    stats = written(described(docs), "statistics")
    model = fit(stats, labels)

    def run(arrived):
        for batch in arrived:
            n = batch.num_rows
            scores = model.scores(batch.column("stats").flatten().to_numpy().reshape(n, -1)) if n else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
