"""Stored indexes of words and of vectors, reach by stored neighbours, raw queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import T, engine  # noqa: F401

from noetica.operators import graph, retrieval
from noetica.operators.textindex import TextIndex
from noetica.operators.vectorindex import DIMENSIONS, HashedEmbedder, VectorIndex, words_of

WORDS = [f"w{i}" for i in range(120)] + ["Größe", "日本"]


def texts(n, seed=1, start=0):
    rng = random.Random(seed)
    rows = [(f"t{start + i:04}", " ".join(rng.choices(WORDS, [200 // (j + 1) + 1 for j in range(len(WORDS))], k=rng.randint(0, 25)))) for i in range(n)]
    return rows + [(f"n{start}", None), (f"m{start}", ""), (f"o{start}", "..., !"), (None, "w1 w2")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_kept_up(spark, tmp_path):
    """After each append, scores are those of a scan of all; old ids and repeated rows add nothing; other terms' files are not read."""
    index, rows = TextIndex(spark, str(tmp_path / "index"), buckets=8), []
    for part in (texts(150), texts(1, 2, 500), texts(120, 3, 600) + texts(30)):
        index.append(spark.createDataFrame(part + part[:3], "id string, text string").repartition(4))
        rows += [r for r in part if r[0] is not None and r[0] not in {i for i, _ in rows}]
        whole = spark.createDataFrame(rows, "id string, text string")
        for terms in (["w0"], ["w3", "w7", "w3", "größe"], ["absent"], ["w5", "absent", "日本"], []):
            want = {r.id: r.score for r in retrieval.bm25_scores(whole, terms).collect()} if terms else {}
            assert {r.id: r.score for r in index.scores(terms).collect()} == pytest.approx(want)
    assert "PartitionFilters: [bucket" in plan(index.postings(["w3", "w7"])) and "PushedFilters: [In(term" in plan(index.postings(["w3", "w7"]))
    read = index.read().where("bucket >= 0").select("bucket", "term").distinct().collect()
    assert len({r.bucket for r in read}) == 8 and all(len({x.bucket for x in read if x.term == r.term}) == 1 for r in read)


def test_full_text_by_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "I don't know"), ("b", "green -> blue"), ("c", "red pears"), ("d", None)], "id string, text string")
    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    index.append(rows)
    for query in ("don't", " -> ", "zebra", "pears zebra", "know"):
        scanned = {tuple(r) for r in retrieval.full_text(rows, query, 5).select("id", "form", "score", "rank").collect()}
        found = retrieval.full_text(rows, query, 5, index.scores(retrieval.words(query)))
        assert {tuple(r) for r in found.select("id", "form", "score", "rank").collect()} == scanned


def test_vectors_are_exact(spark, tmp_path):
    """Results are those of a whole scan, of which a part is read where texts have topics; appended texts are found."""
    rng = random.Random(7)
    topics = [[f"t{t}x{i}" for i in range(30)] for t in range(40)]
    rows = [(f"i{i}", " ".join(rng.choices(topics[i % 40], k=rng.randint(6, 14)) + rng.choices(WORDS, k=rng.randint(0, 2)))) for i in range(3000)]
    rows += [("same", rows[0][1].upper() + "!"), ("none", None), ("empty", " - ")]
    index = VectorIndex.build(spark.createDataFrame(rows, "id string, text string").repartition(4), str(tmp_path / "vectors"))
    index.append(spark.createDataFrame([("new", "t3x1 t3x2 unheard"), ("old", rows[5][1])], "id string, text string"))
    stored = {r.words: np.array(r.embedding) for r in index.read().collect()}
    assert len(stored) == len({" ".join(retrieval.words(t)) for _, t in [*rows, ("new", "t3x1 t3x2 unheard")] if t and retrieval.words(t)})
    share = []
    for query, k in ((" ".join(topics[3][:8]), 20), (rows[9][1], 1), ("t3x1 t3x2 unheard", 3), ("w1", 5), ("t0x0 t39x5", 50), ("never seen", 4000)):
        q = index.embedder([query])[0].astype(float)
        scores = {w: round(float(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q)), 6) for w, v in stored.items()}
        least = sorted(scores.values(), reverse=True)[:k][-1]
        got = {r.words: r.score for r in index.scores(query, k).collect()}
        assert set(got) == {w for w, s in scores.items() if s >= least} and got == pytest.approx({w: scores[w] for w in got}, abs=2e-6)
        cells, _, _ = index.plan(query, k)
        share.append(sum(n for c, (_, n) in index.cells().items() if c in cells) / index.size())
    assert min(share) < 0.5 and share[1] < 1
    assert "PartitionFilters: [cell" in plan(index._scored([1, 2], q).select("words"))


def test_other_embedders_and_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ab b"), ("b", "c"), ("c", "ab c")], "id string, text string")
    letters = lambda words: np.array([[w.count(c) for c in "abc"] for w in words])
    index = VectorIndex.build(rows, str(tmp_path / "letters"), letters)
    assert [(r.words, r.score) for r in index.scores("c", 1).collect()] == [("c", 1.0)]
    empty = VectorIndex.build(rows.limit(0), str(tmp_path / "empty"))
    assert empty.scores("c", 3).count() == 0 and empty.size() == 0 and not empty.outgrown()
    repeated = spark.createDataFrame([("a", "ab b"), ("a", "ab b"), (None, "c")], "id string, text string")
    for _ in range(2):
        empty.append(repeated)  # one text, once
    assert [tuple(r) for r in empty.members().collect()] == [("a", "ab b")] and empty.size() == empty.read().count() == 1 and empty.outgrown()
    assert [tuple(r) for r in empty.scores("ab", 3).collect()][0][0] == "ab b"
    own = VectorIndex.build(repeated, str(tmp_path / "repeated"), letters)
    assert [tuple(r) for r in own.members().collect()] == [("a", "ab b")]
    none = VectorIndex.build(repeated.limit(0), str(tmp_path / "none"), letters)
    none.append(repeated)
    assert [r.words for r in none.scores("b", 1).collect()] == ["ab b"]


def test_from_nothing(spark):
    """An engine without rows answers every question; what is added then is found, by an index that is fitted to it."""
    from noetica import schema
    from noetica.api import GraphEngine

    one = GraphEngine(*[spark.createDataFrame([], s) for s in (schema.ENTITY, schema.EDGE, schema.EPISODE)])
    asked = (one.search("red"), one.search_nodes("red"), one.get_source("red"), one.history("red", F.lit(T[2])), one.expand(["x", "y"], 2), one.list_communities(), one.community_job()[0])
    assert all(df.isEmpty() for df in asked) and sum(one.stats().first()) == 0
    facts = lambda e: e.select("uuid", F.lit("Ann").alias("source"), F.lit("Rome").alias("target"), F.lit("lives in").alias("name"), F.col("content").alias("fact"))
    more, _ = one.add_episode("n", "Ann lives in Rome now", "note", F.lit(T[2]), facts=facts)
    assert more._indexes["facts"][1] is None and more._indexes["facts"][0] is not None
    assert [r.fact for r in more.search("Rome").collect()] == ["Ann lives in Rome now"] and more.search_nodes("rome", 1).first().name == "Rome"
    assert more._indexes["facts"][1].fitted == 1 and more.get_source("Rome").count() == 1
    assert [r.bucket for r in more.history("Rome", F.lit(T[3])).collect()] == ["current"]


def test_fitted_weights(spark):
    words = spark.createDataFrame([("a b",), ("a c",), ("a a d",)], "words string")
    fitted = HashedEmbedder.fitted(words)
    a, b, unseen = (np.abs(fitted([w])[0]) for w in ("a", "b", "zz"))
    assert a.shape == (DIMENSIONS,) and len(set(a.tolist())) == 1 and a[0] < b[0] < unseen[0]
    assert (fitted(["a a b"])[0] == 2 * fitted(["a"])[0] + fitted(["b"])[0]).all()
    assert spark.range(1).select(words_of(F.lit("A-b, ñ!")).alias("w")).first().w == "a b ñ"


def test_reach(spark):
    """Paths by a plain search, with hubs in parts; the plan of a hop reads stored neighbours, not edges."""
    rng = random.Random(2)
    pairs = {(f"n{rng.randint(0, 80):02}", f"n{rng.randint(0, 80):02}") for _ in range(110)} | {("hub", f"n{i:02}") for i in range(60)} | {("x", "y"), ("y", "y")}
    edges = spark.createDataFrame([(a, b, None) for a, b in pairs], "source_uuid string, target_uuid string, expired_at timestamp")
    lists = graph.neighbour_lists(edges, part=8)
    assert lists.where("node = 'hub'").count() > 5 and lists.agg(F.max(F.size("others"))).first()[0] <= 16
    seeds = spark.createDataFrame([("n01",), ("x",), ("n01",), ("alone",)], "uuid string")
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want = {u: (0, [u]) for u in ("n01", "x", "alone")}
    front = dict(want)
    for hop in range(1, 5):
        best = {}
        for u, (_, path) in front.items():
            for v in around.get(u, ()):
                if v not in want:
                    best[v] = min(best.get(v, (hop, [*path, v])), (hop, [*path, v]))
        want, front = want | best, best
    got = graph.reached(lists, seeds, 4)
    assert {r.uuid: (r.hop, r.path) for r in got.collect()} == want
    assert {r.uuid: r.hop for r in graph.hops(edges, seeds, 4).collect()} == {u: h for u, (h, _) in want.items()}
    assert plan(graph.hops(edges, seeds, 4)).count("Scan ExistingRDD") == 5 and "source_uuid" not in plan(graph.hops(edges, seeds, 4))


def test_raw_queries(engine):  # noqa: F811
    found = engine.query("SELECT e.uuid, n.name FROM edges e JOIN entities n ON n.uuid = e.target_uuid WHERE e.name = :name AND e.valid_at >= :at ORDER BY 1 LIMIT 2", name="knows", at=T[4])
    assert [tuple(r) for r in found.collect()] == [("late", "node d"), ("self", "node d")]
    assert engine.query("WITH c AS (SELECT count(*) AS n FROM episodes) SELECT n FROM c").first().n == 2
    assert engine.query("SELECT * FROM edges WHERE fact = :f", f="x' OR '1' = '1").count() == 0  # a value, not a part of the text
    assert engine.query("SELECT uuid FROM edges WHERE fact <> ')}; DROP' -- ) ;").count() == 7
    for bad in ("DROP TABLE edges", "INSERT INTO edges SELECT * FROM edges", "SELECT 1) INSERT INTO edges SELECT (1", "SELECT 1; SELECT 2", "SELECT * FROM {edges_}"):
        with pytest.raises(Exception):  # noqa: B017
            engine.query(bad).collect()
    assert engine.edges.count() == 7


def test_indexes_follow_what_is_added(spark, engine):  # noqa: F811
    """An engine hands its indexes on with what is new; both engines find what they have, as engines that build their own do."""
    from noetica.api import GraphEngine

    told = spark.createDataFrame([("fresh zebra", "node a", "Zed", "met", "node a met striped zebra")], "content string, source string, target string, name string, fact string")
    find = lambda e: e.drop("name", "source").join(told, "content").select("uuid", "source", "target", "name", "fact")
    mentions = lambda e: e.drop("name", "source").join(told, "content").select("uuid", F.explode(F.array("source", "target")).alias("mention"))
    one = GraphEngine(engine.entities, engine.edges, engine.episodes)
    before = {q: [tuple(r) for r in one.search(q, 3).select("rank", "uuid", "score").collect()] for q in ("beta gamma", "striped zebra")}
    one.search_nodes("node b"), one.get_source("pears").count()
    path = one._indexes["facts"][0].path
    more, _ = one.add_episode("n", "fresh zebra", "d", F.lit(T[2]), extract=mentions, facts=find)
    assert more._indexes["facts"][0].path == path and not one._indexes
    own = GraphEngine(more.entities, more.edges, more.episodes)
    found = more.search("striped zebra", 1).first()
    assert found.fact == "node a met striped zebra" and own.search("striped zebra", 1).first().uuid == found.uuid
    assert {r.id for r in more.get_source("zebra").collect()} == {r.id for r in own.get_source("zebra").collect()} != set()
    assert more.search_nodes("zed", 1).first().name == "Zed"
    again = more.add_note("a zebra again", "me", F.lit(T[3]))
    assert len(again.get_source("zebra").collect()) == 2
    assert {q: [tuple(r) for r in one.search(q, 3).select("rank", "uuid", "score").collect()] for q in before} == before


def test_postings_are_sent_once_at_most(spark, tmp_path):
    """Texts are dealt by id, and postings are written where they are made: a posting is not sent to its bucket. F8, F11."""
    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    before = len(list(tmp_path.rglob("*.parquet")))
    texts = spark.range(4000).selectExpr("cast(id as string) as id", "concat('common w', id % 97, ' x', id) as text").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.append(texts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "index").glob("bucket=0/*.parquet"))) > 1 and before == 0  # of several tasks
    assert index.postings(["common"]).count() == 4000 and index.totals().first().n == 4000
