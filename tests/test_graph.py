from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noetica.api import GraphEngine
from noetica.operators import community, graph, retrieval, temporal
from noetica.plans import registry
from noetica.schema import EDGE, ENTITY, EPISODE
from noetica.sources import views

T = [datetime(2020, 1, 1 + i) for i in range(9)]


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [(x, f"node {x}", ["Entity", "Thing"], None, T[0], "default") for x in "abcdef"]
    rows = [
        ("ab1", "a", "b", "knows", "alpha beta one", T[0], T[0], None, None),
        ("ab2", "a", "b", "knows", "alpha beta two", T[0], T[1], T[3], T[3]),
        ("null", "b", "c", "knows", "beta gamma null", T[0], None, None, None),
        ("nullend", "c", "a", "knows", "gamma alpha nullend", T[0], None, T[2], None),
        ("zero", "c", "d", "knows", "gamma delta zero", T[0], T[4], T[4], None),
        ("self", "d", "d", "knows", "delta delta self", T[0], T[5], None, None),
        ("late", "a", "d", "knows", "alpha delta late", T[0], T[8], None, None),
    ]
    edges = spark.createDataFrame([(*r, [], "default") for r in rows], EDGE)
    notes = spark.createDataFrame([("e1", "n", "red apples and pears", "text", "n", T[0], "default", None, None), ("e2", "m", "pears red", "text", "m", T[1], "default", None, None)], EPISODE)
    return GraphEngine(spark.createDataFrame(nodes, ENTITY), edges, notes)


def ids(df, column="uuid"):
    return sorted(r[column] for r in df.collect())


def test_expand(engine):
    rows = engine.expand(["d"]).collect()
    assert sorted(r.edge_uuid for r in rows) == ["late", "self", "zero"]
    assert {r.neighbor_uuid for r in rows} == {"a", "c", "d"}
    (alone,) = engine.expand(["e"]).collect()
    assert alone.center_uuid == "e" and alone.edge_uuid is None
    assert engine.expand(["nobody"]).count() == 0
    (nested,) = graph.subgraph(engine.expand(["b"], include_invalidated=True)).collect()
    assert len(nested.nodes) == 2 and len(nested.edges) == 3
    (nested,) = graph.subgraph(engine.expand(["e"])).collect()
    assert nested.nodes == [] and nested.edges == []


def test_expand_liveness(engine):
    assert "ab2" not in ids(engine.expand(["a"]), "edge_uuid")
    assert "ab2" in ids(engine.expand(["a"], include_invalidated=True), "edge_uuid")


def test_between(engine):
    assert ids(engine.edges_between(["a", "b", "a"])) == ["ab1"]
    assert engine.edges_between([]).count() == 0
    at = F.lit(T[2])
    assert ids(engine.edges_between(["a", "b"], at)) == ["ab1"]
    assert ids(engine.edges_between(["a", "b"], at, include_invalidated=True)) == ["ab1", "ab2"]
    assert "null" not in ids(engine.edges_between(["b", "c"], at, include_invalidated=True))


def split(engine, at, null_open=False):
    ranked = engine.edges.withColumn("rank", F.lit(1))
    rows = temporal.history(ranked, 10, F.lit(at) if at else None, null_open).collect()
    return {b: sorted(r.uuid for r in rows if r.bucket == b) for b in ("current", "superseded")}


def test_history(engine):
    assert split(engine, T[3]) == {"current": ["ab1", "null"], "superseded": ["ab2"]}
    assert split(engine, T[3], True) == {"current": ["ab1", "null"], "superseded": ["ab2", "nullend"]}
    assert "zero" in split(engine, T[4])["superseded"]
    assert split(engine, T[1])["current"] == ["ab1", "ab2", "null", "nullend"]
    now = split(engine, None)
    assert now["superseded"] == ["ab2", "nullend", "zero"] and not set(now["current"]) & set(now["superseded"])


def test_history_before_many_newer_edges(spark):
    """Edges that start after the date don't take the places of those valid at it."""
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        matching = views.edges(spark, d).where("contains(fact, 'red widget')").select("uuid", "valid_at", "invalid_at").collect()
        started = [r for r in matching if r.valid_at <= datetime(2001, 6, 1)]
        current = [r for r in started if r.invalid_at is None or r.invalid_at > datetime(2001, 6, 1)]
        want = {"current": current, "superseded": [r for r in started if r not in current]}
        want = {b: [r.uuid for r in sorted(rows, key=lambda r: (-r.valid_at.timestamp(), r.uuid))[: registry.K]] for b, rows in want.items()}
        for name in ("history_asof", "history_asof_mcp"):
            got = registry.QUERIES[name](spark, d).orderBy("rank").collect()
            assert {b: [r.uuid for r in got if r.bucket == b] for b in want} == want


def test_stats_and_orphans(engine, spark):
    (row,) = engine.stats().collect()
    assert row.asDict() == {"entity_count": 6, "edge_count": 7, "episode_count": 2, "community_count": 0, "orphan_count": 2}
    assert ids(graph.orphans(engine.entities, engine.edges)) == ["e", "f"]
    empty = GraphEngine(engine.entities.limit(0), engine.edges.limit(0), engine.episodes.limit(0))
    assert set(empty.stats().first().asDict().values()) == {0}
    assert graph.orphan_percent(empty.stats()).first()[0] == "0" and graph.orphan_percent(engine.stats()).first()[0] == "33.3"


def test_search_and_sources(engine):
    assert ids(engine.search("zero", 1)) == ["zero"]
    assert len(engine.get_source("pears red zebra", 5).collect()) == 2 and {r.form for r in engine.get_source("pears red").collect()} == {0}
    assert engine.get_source("nothing here").count() == 0
    with pytest.raises(ValueError):
        engine.get_source("  ")
    twice = engine.add_note("a thought", "me", F.lit(T[0])).add_note("a thought", "me", F.lit(T[0]))
    assert twice.episodes.count() == 3
    with pytest.raises(ValueError):
        engine.add_note(" ", "me", F.lit(T[0]))


def test_queries_are_split_as_texts_are(spark, engine):
    """Any word finds, apostrophes and hyphens part words, and a phrase rescues a query without words."""
    rows = [("a", "I don't know"), ("b", "state-of-the-art work"), ("c", "red pears"), ("d", "green -> blue"), ("e", None)]
    texts = spark.createDataFrame(rows, "id string, text string")
    find = lambda q: {(r.id, r.form) for r in retrieval.full_text(texts, q, 5).collect()}
    assert find("don't") == {("a", 0)} and find("State-of-the-art") == {("b", 0)} and find("pears zebra") == {("c", 0)}
    assert find(" -> ") == {("d", 1)} and find("zebra") == set()


def test_edge_attention(spark):
    df = spark.createDataFrame([("a", 1.0, "knows", T[0]), ("b", 1.0, "other", T[1])], "id string, score double, name string, at timestamp")
    rows = {r.id: r.score for r in retrieval.recency_weighted(df, "at", F.lit(T[1]), 0.1, {"knows": 0.15}).collect()}
    assert abs(rows["a"] - 2.718281828 ** -0.1 * 1.15) < 1e-6 and rows["b"] == 1.0


def test_episodes_in_bulk(engine, spark):
    rows = [("n1", "Ada Lovelace met Node A today", "d1", T[0]), ("n2", "then Ada Lovelace wrote", "d2", T[1]), ("n1", "Ada Lovelace met Node A today", "d1", T[0]), ("n3", "  ", "d3", T[0]), ("n4", None, "d4", T[0])]
    given = spark.createDataFrame(rows, "name string, content string, source_description string, reference_time timestamp")
    facts = lambda e: e.where("name = 'n1'").select("uuid", F.lit("Ada Lovelace").alias("source"), F.lit("Node").alias("target"), F.lit("met").alias("name"), F.lit("Ada met A").alias("fact"))
    more, counts = engine.add_episodes(given, facts=facts)
    assert counts.first().asDict() == {"episodes_created": 2, "nodes_created": 1, "edges_created": 1, "communities_created": 0}
    (edge,) = more.edges.where("fact = 'Ada met A'").collect()
    assert edge.target_uuid == "a" and edge.valid_at == T[0] and len(edge.episodes) == 1
    assert more.entities.where("name = 'Ada Lovelace'").count() == 1 and more.episodes.count() == 4
    _, again = more.add_episodes(given, facts=facts)
    assert set(again.first().asDict().values()) == {0}


def test_community_job(engine):
    built, counts = engine.community_job(3)
    row = counts.first()
    assert row.orphans_before == row.orphans_after == 2 and row.communities == built.count() >= 1


def test_roll_up(spark):
    from noetica.operators import episodes

    rows = spark.createDataFrame([("a", "x", None), ("b", " ", None), ("c", "y", "no time"), ("d", "z", "2026-01-01")], "name string, content string, reference_time string")
    got = {(r.status, r.reason): r.n for r in episodes.roll_up(*episodes.checked(rows)).collect()}
    assert got == {("ok", None): 2, ("failed", "content"): 1, ("failed", "time"): 1}


def test_fusion_ignores_order(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    assert retrieval.fused([one, two], 3).collect() == retrieval.fused([two, one], 3).collect()


def test_passthrough(spark):
    rows = retrieval.passthrough(spark.range(1, 103).withColumnRenamed("id", "rank")).collect()
    assert {r["rank"]: r.score for r in rows}[102] == -0.01


def test_communities(engine, spark):
    labels = community.label_propagation(engine.entities, engine.edges, 4)
    rows = {r.uuid: r.label for r in labels.collect()}
    assert set(rows.values()) <= set("abcdef") and rows["e"] == "e" and rows["f"] == "f"
    sizes = spark.createDataFrame([("a", 5), ("b", 4), ("c", 2), ("d", 1)], "label string, n long")
    row = community.size_distribution(sizes).first()
    assert (row.median, row.greatest, row.least, row.top5) == (2, 5, 1, "5,4,2,1")
    sizes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 100), ("d", 101)], "label string, n long")
    assert {r.band: r.n_communities for r in community.bands(sizes).collect()} == {"single": 1, "useful": 2, "mega": 1}
    assert engine.build_communities(2).count() >= 1


def test_all_built_communities_are_listed(spark, monkeypatch):
    built = spark.createDataFrame([(f"{i:02}", f"name {i:02}", None) for i in range(45)], "label string, name string, summary string")
    monkeypatch.setattr(registry, "community_build", lambda spark, d: built)
    rows = registry.list_communities(spark, "").collect()
    assert [r.uuid for r in rows] == [f"C:{i:02}" for i in range(45)] and {r.summary for r in rows} == {""}


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = {r.node: r.component for r in community.connected(pairs).collect()}
    assert {got[i] for i in range(21)} == {0} and got[31] == 30


def test_similar_pairs_are_whole(spark):
    import numpy as np

    from noetica.operators import embedding

    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "id long, embedding array<float>, kind int")
    for threshold in (0.3, 0.6, 0.9):
        got = {(r.a, r.b) for r in embedding.similar(df, threshold).collect()}
        cos = v @ v.T
        sure = {(i, j) for i in range(80) for j in range(i + 1, 80) if cos[i, j] > threshold + 1e-5}
        maybe = {(i, j) for i in range(80) for j in range(i + 1, 80) if cos[i, j] > threshold - 1e-5}
        assert sure <= got <= maybe


def test_neighbours_in_blocks(spark, monkeypatch):
    import numpy as np

    from noetica.operators import embedding

    monkeypatch.setattr(embedding, "PART", 5)
    monkeypatch.setattr(embedding, "SHARE", 40)
    made = np.random.default_rng(3).integers(-2, 3, (150, 4)).astype(float)  # many ties, some without direction
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)] + [(None, [1.0] * 4), (900, None)], "id long, embedding array<float>")
    got = {}
    for r in embedding.neighbours(vectors, vectors.where("id % 7 = 0"), 4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.id, r.score)
    length = np.linalg.norm(made, axis=1)
    want = {}
    for q in range(0, 150, 7):
        if length[q]:
            scores = sorted((-round(float(made[q] @ made[i] / length[q] / length[i]), 6), i) for i in range(150) if i != q and length[i])
            want[q] = {n + 1: (i, -s) for n, (s, i) in enumerate(scores[:4])}
    assert got == want
    assert embedding.neighbours(vectors.limit(0), vectors.limit(0), 4).count() == 0


def test_clustered_vectors_meet_in_few_cells(spark):
    """With real thresholds on clustered vectors, most cells are not visited, and no pair is lost."""
    import numpy as np

    from noetica.operators import embedding

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 2000)] + 0.12 * rng.normal(size=(2000, 16))
    v[7] = 0
    cos = v @ v.T / np.maximum(1e-12, np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)))
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(None, v[0].tolist(), 0), (2001, None, 0)], "id long, embedding array<double>, kind int")
    got = {(r.a, r.b): (r.a_kind, r.b_kind) for r in embedding.similar(df, 0.92).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(cos, 1) > 0.92), strict=True)}
    assert set(got) == {(int(i), int(j)) for i, j in want} and all(kinds == (a % 3, b % 3) for (a, b), kinds in got.items())


def test_backfill(spark):
    import numpy as np

    from noetica.operators import embedding

    df = spark.createDataFrame([("ab",), (None,), ("abcd",)], "text string")
    out = embedding.backfilled(df, "text", "v", lambda: lambda texts: [np.array([len(t), 1.0]) for t in texts], cap=3)
    assert sorted(r.v[0] for r in out.collect()) == [0.0, 2.0, 3.0]
    assert np.allclose(embedding.pooled(np.array([[3.0, 0.0], [0.0, 4.0]]), 1), [0.6])


def test_saved_communities(spark, tmp_path):
    path = str(tmp_path / "communities")
    one = spark.createDataFrame([("C:a", "a")], "uuid string, name string")
    community.save(one, path, "g", "1")
    community.save(one, path, "h", "1")
    community.save(one, path, "g", "2", append=True)
    assert spark.read.parquet(path).count() == 3
    community.save(one, path, "g", "3")
    assert sorted((r.group_id, r.run_id) for r in spark.read.parquet(path).collect()) == [("g", "3"), ("h", "1")]


def test_reports(engine, spark):
    from noetica import reports

    text = reports.search_report(engine.search("zero", 1), "zero")
    assert "| 1 | c | gamma delta zero | d |" in text and text.startswith("1 facts")
    named = engine.search("zero", 1).withColumn("source_name", F.lit("a|b\nc"))
    assert "| 1 | a\\|b c | gamma delta zero | d |" in reports.search_report(named, "zero")
    assert reports.search_report(engine.search("zero").limit(0), "nothing") == "Nothing is known about “nothing”."
    text = reports.history_report(engine.history("alpha", k=5), "alpha")
    assert "| current | alpha beta one |" in text and "| superseded | alpha beta two | 2020-01-02 00:00 | 2020-01-04 00:00 |" in text
    assert "| orphan | 2 | 33.3% |" in reports.stats_report(engine.stats())
    asked = spark.createDataFrame([("q1", "recall", "what?", None)], "id string, dimension string, question string, answer string")
    assert "| q1 | recall | what? |  |  |  |  |  |" in reports.evaluation_report(asked)
