"""Graph primitives over entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noetica.operators.temporal import valid_at
from noetica.storage import cut


def lookup(entities: DataFrame, uuid: str) -> DataFrame:
    """The entity, its base label left out."""
    return entities.where(F.col("uuid") == uuid).withColumn("labels", F.array_remove("labels", "Entity"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(..., node, other) for each end of each edge; a self-loop once."""
    end = lambda node, other: F.struct(F.col(node).alias("node"), F.col(other).alias("other"))
    forth, back = end("source_uuid", "target_uuid"), end("target_uuid", "source_uuid")
    ends = F.when(F.col("source_uuid") != F.col("target_uuid"), F.array(forth, back)).otherwise(F.array(forth))
    return edges.select("*", F.inline(ends))  # edges are worked out once, not once for each way


def expand(entities: DataFrame, edges: DataFrame, center: str, max_edges: int = 20, include_invalidated: bool = False) -> DataFrame:
    """One hop around a node, either way: a row per edge, latest first; the center alone if it has none; nothing if it is absent.

    The filters on both ends reach the scan, and the limit is on edges, before names are looked up.
    """
    live = edges if include_invalidated else edges.where(F.col("expired_at").isNull())
    near = live.where((F.col("source_uuid") == center) | (F.col("target_uuid") == center))
    near = near.withColumn("other", F.when(F.col("source_uuid") == center, F.col("target_uuid")).otherwise(F.col("source_uuid")))
    near = near.orderBy(F.desc("valid_at"), "uuid").limit(max_edges).select(F.col("uuid").alias("edge_uuid"), "other", "source_uuid", "target_uuid", "fact", "valid_at", "invalid_at")
    names = entities.select(F.col("uuid").alias("other"), F.col("name").alias("neighbor_name"))
    middle = entities.where(F.col("uuid") == center).select(F.col("uuid").alias("center_uuid"), F.col("name").alias("center_name"))
    return middle.join(near.join(names, "other"), F.lit(True), "left").withColumnRenamed("other", "neighbor_uuid")


def subgraph(expanded: DataFrame) -> DataFrame:
    """One nested row of expand(): the center, its distinct neighbours and its edges."""
    nodes = F.array_distinct(F.collect_list(F.when(F.col("neighbor_uuid").isNotNull(), F.struct("neighbor_uuid", "neighbor_name"))))
    edges = F.collect_list(F.when(F.col("edge_uuid").isNotNull(), F.struct("edge_uuid", "source_uuid", "target_uuid", "fact")))
    return expanded.groupBy("center_uuid", "center_name").agg(F.array_sort(nodes).alias("nodes"), F.array_sort(edges).alias("edges"))


def neighbour_lists(edges: DataFrame, part: int = 4096) -> DataFrame:
    """(node, others): a node's different neighbours in arrays of about `part` at most; a hub has several.

    Parts are hashes of the neighbours, as many as twice the hub's neighbours need, so that arrays stay small whatever the degree.
    """
    ways = both_ways(edges.select("source_uuid", "target_uuid")).select("node", "other").distinct()
    degrees = ways.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") > part)  # few
    parts = F.coalesce(F.ceil(2 * F.col("degree") / part), F.lit(1))
    dealt = ways.join(degrees, "node", "left").withColumn("part", F.pmod(F.xxhash64("other"), parts))
    return dealt.groupBy("node", "part").agg(F.collect_list("other").alias("others")).select("node", "others")


def reached(lists: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(uuid, hop, path) of all that neighbour_lists() reach from seeds (uuid) within `depth` hops; the least of the shortest paths.

    lists should be a stored table: each hop joins it with the frontier, which is cut, so that nothing before it is worked out
    again; what was seen is one anti-join.
    """
    start = seeds.select("uuid").distinct().select("uuid", F.lit(0).alias("hop"), F.array("uuid").alias("path"))
    seen = frontier = cut(start)
    for hop in range(1, depth + 1):
        near = lists.join(frontier.select(F.col("uuid").alias("node"), "path"), "node").select(F.explode("others").alias("uuid"), "path")
        best = near.groupBy("uuid").agg(F.min("path").alias("path")).join(seen.select("uuid"), "uuid", "left_anti")
        frontier = cut(best.select("uuid", F.lit(hop).alias("hop"), F.concat("path", F.array("uuid")).alias("path")))
        seen = seen.unionByName(frontier)
    return seen


def hops(edges: DataFrame, seeds: DataFrame, depth: int, include_invalidated: bool = False) -> DataFrame:
    """(uuid, hop) of all that is reached from seeds (uuid) within `depth` hops; edges are read once."""
    live = edges if include_invalidated else edges.where(F.col("expired_at").isNull())
    return reached(cut(neighbour_lists(live)), seeds, depth).select("uuid", "hop")


def between(edges: DataFrame, members: DataFrame, as_of: Column | None = None, include_invalidated: bool = False) -> DataFrame:
    """Edges with both ends among members (uuid), by semi joins, so that a repeated member multiplies nothing."""
    out = edges
    for end in ("source_uuid", "target_uuid"):
        out = out.join(members.select(F.col("uuid").alias(end)), end, "left_semi")
    if not include_invalidated:
        out = out.where(F.col("invalid_at").isNull())
    if as_of is not None:
        out = out.where(valid_at(as_of, open_start=False))
    return out


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_uuid", "target_uuid")).alias("uuid"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge touches, whatever its state."""
    return entities.join(ends(edges), "uuid", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, weight): edges counted from both ends. Each unordered pair is counted once, then mirrored."""
    pairs = edges.groupBy(F.least("source_uuid", "target_uuid").alias("a"), F.greatest("source_uuid", "target_uuid").alias("b")).agg(F.count("*").alias("weight"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(F.explode(both).alias("p"), "weight").select("p.a", "p.b", "weight")


def adjacency_full(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, degree, weight) of every entity, isolated ones with zeros."""
    sums = adjacency(edges).groupBy(F.col("a").alias("uuid")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    return entities.select("uuid").join(sums, "uuid", "left").fillna(0, ["degree", "weight"])


def stats(entities: DataFrame, edges: DataFrame, episodes: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row of global counts, over all groups."""
    counts = [entities.agg(F.count("*").alias("entity_count")), edges.agg(F.count("*").alias("edge_count")), episodes.agg(F.count("*").alias("episode_count"))]
    counts.append(communities.agg(F.count("*").alias("community_count")) if communities is not None else entities.sparkSession.range(1).select(F.lit(0).cast("long").alias("community_count")))
    counts.append(orphans(entities, edges).agg(F.count("*").alias("orphan_count")))
    out = counts[0]
    for one in counts[1:]:
        out = out.join(F.broadcast(one), F.lit(True))  # one row each
    return out


def orphan_percent(stats: DataFrame) -> DataFrame:
    """One decimal, as text; 0 without entities."""
    share = F.format_string("%.1f", F.round(100.0 * F.col("orphan_count") / F.nullif(F.col("entity_count"), F.lit(0)), 1))
    return stats.select(F.coalesce(F.when(F.col("entity_count") > 0, share), F.lit("0")).alias("orphan_pct"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with the most edges."""
    return both_ways(edges).groupBy(F.col("node").alias("uuid")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "uuid").limit(k)


def triples(edges: DataFrame, k: int) -> DataFrame:
    """The first k (source, fact, target) by fact."""
    return edges.orderBy("fact", "uuid").limit(k).select("source_name", "fact", "target_name", "uuid")


def priority_subgraph(edges: DataFrame, seeds: DataFrame, priority: dict[str, int], k: int) -> DataFrame:
    """(uuid, priority): neighbours of the seeds by the best priority of an edge to them, k at most; seeds come first."""
    of_name = F.create_map(*[F.lit(x) for item in priority.items() for x in item])
    ways = both_ways(edges.where(F.col("expired_at").isNull()).select("source_uuid", "target_uuid", "name"))
    near = ways.join(seeds.select(F.col("uuid").alias("node")), "node", "left_semi").groupBy(F.col("other").alias("uuid")).agg(F.min(F.coalesce(of_name[F.col("name")], F.lit(max(priority.values()) + 1))).alias("priority"))
    all_of = near.join(seeds.select("uuid"), "uuid", "left_anti").unionByName(seeds.select("uuid", F.lit(-1).alias("priority")))
    return all_of.orderBy("priority", "uuid").limit(k)


def edge_types(edges: DataFrame, members: DataFrame, boost: float = 0.15) -> DataFrame:
    """(name, n, boost) of edges within members."""
    inside = between(edges, members, include_invalidated=True)
    return inside.groupBy("name").agg(F.count("*").alias("n")).withColumn("boost", F.lit(boost))

