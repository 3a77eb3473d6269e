"""Order-dependent imports, resumable backfill, near copies at the thresholds of the design."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from noetica.operators import embedding, episodes
from noetica.plans import registry
from noetica.sources import views

DATA = "/root/testdata/sf0.001"


def test_items_see_what_came_before_in_their_saga(spark):
    """A name is made by the first item that says it and found by later ones, in the order of turns, whatever the order of rows; errors fail one row."""
    rng = random.Random(1)
    rows = [(f"s{i % 3}" if i % 7 else None, i, " ".join(rng.sample("abcdefgh", 3))) for i in range(90)] + [("hot", i, f"x{i % 5} y") for i in range(2500)]
    rows += [("s1", 1000, "BAD"), ("s1", 1001, "a z"), ("s2", 1002, None)]
    mixed = rows[:]
    rng.shuffle(mixed)

    def step(state, row):
        if row["content"] == "BAD":
            raise ValueError("unreadable")
        names = row["content"].split()
        made = [n for n in names if n not in state]
        state |= {n: row["turn_index"] for n in made}
        return {"made": sorted(made), "found": [f"{n}@{state[n]}" for n in names if n not in made]}

    out = episodes.in_saga_order(spark.createDataFrame(mixed, "saga string, turn_index int, content string").repartition(6), dict, step, "struct<made:array<string>,found:array<string>>")
    states, want = {}, {}
    for row in sorted(rows, key=lambda r: r[1]):
        state = states.setdefault(row[0], {})
        try:
            made = step(state, dict(zip(("saga", "turn_index", "content"), row, strict=True)))
            want[row[:2]] = ("ok", None, (made["made"], made["found"]))
        except Exception as error:
            want[row[:2]] = ("failed", str(error), None)
    got = {(r.saga, r.turn_index): (r.status, r.reason, r.made and tuple(r.made)) for r in out.collect()}
    assert got == want
    counts = {(r.status, r.reason): r.n for r in episodes.roll_up_import(out).collect()}
    assert counts["failed", "unreadable"] == 1 and counts["ok", None] == len(rows) - 2 and len(counts) == 3


def test_backfill_resumes(spark, tmp_path):
    """A run that fails keeps the lots it has done; the next one embeds the rest; a third embeds nothing; another model starts anew."""
    table, log = str(tmp_path / "nodes"), tmp_path / "log"
    log.mkdir()
    rows = [(f"n{i:03}", f"text {i}", None, None) for i in range(120)] + [("old", "text old", [9.0], "m1"), ("other", "text other", [8.0], "m0"), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "uuid string, text string, embedding array<float>, embedding_model string")
    df.withColumn("bucket", F.pmod(F.xxhash64("uuid"), F.lit(12)).cast("int")).write.partitionBy("bucket").parquet(table)
    folder = str(log)

    def load(fails=False, value=1.0):
        def model(texts):
            if fails and "text 77" in texts:
                raise RuntimeError("model is gone")
            (Path(folder) / str(random.random())).write_text("\n".join(texts))
            return [np.array([value, len(t)]) for t in texts]

        return lambda: model

    told = lambda: [line for p in log.iterdir() for line in p.read_text().split("\n")]
    with pytest.raises(Exception, match="model is gone"):
        embedding.backfill_table(spark, table, "text", "m1", load(fails=True), step=3)
    done = spark.read.parquet(table).where("embedding_model = 'm1'").count()
    assert spark.read.parquet(table).count() == 123
    left = embedding.backfill_table(spark, table, "text", "m1", load(), step=3)
    assert 0 < left == 123 - done and "text old" not in told()
    assert embedding.backfill_table(spark, table, "text", "m1", load(), step=3) == 0
    found = {r.uuid: r for r in spark.read.parquet(table).collect()}
    assert len(found) == 123 and {r.embedding_model for r in found.values()} == {"m1"}
    assert found["old"].embedding == [9.0] and found["other"].embedding == [1.0, 10.0] and found["n005"].embedding == [1.0, 6.0] and found["none"].embedding == [1.0, 0.0]
    assert embedding.backfill_table(spark, table, "text", "m2", load(value=2.0)) == 123
    assert {r.embedding[0] for r in spark.read.parquet(table).collect()} == {2.0}


def test_planted_copies_cross_the_thresholds(spark):
    """Queries at the design's thresholds find some pairs and leave some, and cells that can't hold one are not visited."""
    rows = views.planted_vectors(spark, DATA).collect()
    units = np.array([r.embedding for r in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = np.triu(units @ units.T, 1)
    for threshold in (registry.CONTRADICTS, registry.RECURS, registry.DUPLICATE):
        assert embedding.similar(views.planted_vectors(spark, DATA), threshold).count() == (scores > threshold).sum() > 0
    assert ((scores > 0.7) & (scores < registry.RECURS)).sum() > 0
    assert registry.near_dup_nodes(spark, DATA).count() > 0 and registry.recurrence_flags(spark, DATA).where("promoted").count() > 0 and registry.contradiction_flags(spark, DATA).count() > 0


def _given_pairs(spark):
    """(a, b, cosine, kinds) of the given vectors alone, by brute force, where the cosine is over 0.3."""
    given = sorted(views.vectors(spark, DATA).collect(), key=lambda r: r.id)
    units = np.array([r.embedding for r in given], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = np.triu(units @ units.T, 1)
    return [(given[i].id, given[j].id, scores[i, j], (given[i].kind, given[j].kind)) for i, j in np.argwhere(scores > 0.3).tolist()]


def test_recurrence_covers_the_given_vectors(spark):
    """Every given vector with a similar one of another kind has its row, not only vectors with planted copies; the design's threshold stands beside it."""
    found = {r.id: r for r in registry.recurrence_flags(spark, DATA).collect()}
    times = {r.id for r in views.embedded_times(spark, DATA).collect()}
    alone = {x for a, b, _, (k, m) in _given_pairs(spark) if k != m for x in (a, b) if x in times}
    assert len(alone) > 50 and alone <= found.keys()
    assert any(x % 4 for x in alone) and all(r.near_sources <= r.n_sources and (not r.near_promoted or r.promoted) for r in found.values())
    assert 0 < sum(r.near_promoted for r in found.values()) < sum(r.promoted for r in found.values())


def test_contradictions_cover_the_given_vectors(spark):
    """Every pair of given vectors over 0.3 whose later text has a cue is found; pairs over the design's threshold are marked."""
    found = {(r.other, r.id): r for r in registry.contradiction_flags(spark, DATA).collect()}
    cued = {r.id for r in views.embedded_texts(spark, DATA).collect() if r.id % 3 == 0 and r.id < views.COPIES}
    want = {(a, b): round(score, 6) for a, b, score, _ in _given_pairs(spark) if b in cued}
    assert len(want) > 30 and all(abs(found[k].score - v) < 2e-6 for k, v in want.items())
    assert {k for k in found if k[1] < views.COPIES} == want.keys()
    assert all(r.near == (r.score > registry.CONTRADICTS) for r in found.values()) and 0 < sum(r.near for r in found.values()) < len(found)
