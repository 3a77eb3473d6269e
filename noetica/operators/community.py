"""Communities by label propagation, and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noetica.operators.graph import adjacency, both_ways, ends
from noetica.storage import cut, kept

#: A node's vote for the label it has, below any edge's: keeps synchronous rounds from swapping labels for ever.
OWN_VOTE = 0.5
USEFUL = (2, 100)
#: Members of a community that have to be there for it to be built.
LEAST_FOUND = 2


def weighted_lists(edges: DataFrame, part: int = 4096) -> DataFrame:
    """(b, weight, others): a node's neighbours by the number of edges to them, in arrays of about `part` at most; a hub has several."""
    weights = adjacency(edges)
    degrees = ends(edges).groupBy(F.col("uuid").alias("b")).agg(F.count("*").alias("degree")).where(F.col("degree") > part)  # few; edges are no fewer than neighbours
    parts = F.coalesce(F.ceil(2 * F.col("degree") / part), F.lit(1))
    dealt = weights.join(degrees, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts))
    return dealt.groupBy("b", "part", "weight").agg(F.collect_list("a").alias("others")).select("b", "weight", "others")


def label_propagation(entities: DataFrame, edges: DataFrame, rounds: int = 10, until_stable: bool = False) -> DataFrame:
    """(uuid, label) after so many synchronous rounds: each node takes the label with most weight around it, the least of equals.

    Isolated nodes keep their own. The weights are worked out once and stored as lists, which a round sends to their node's label;
    votes move once, to the node they are for, where they are summed and the best is found; the labels' lineage is cut every round.
    """
    weights = kept(weighted_lists(edges), "weights")
    labels = entities.select("uuid", F.col("uuid").alias("label"))
    for _ in range(rounds):
        near = weights.join(labels.withColumnRenamed("uuid", "b"), "b").select(F.explode("others").alias("uuid"), "label", F.col("weight").cast("double").alias("vote"))
        votes = near.unionByName(labels.withColumn("vote", F.lit(OWN_VOTE))).repartition("uuid").groupBy("uuid", "label").agg(F.sum("vote").alias("vote"))
        best = F.min_by("label", F.struct((-F.col("vote")).alias("v"), "label"))
        new = kept(votes.groupBy("uuid").agg(best.alias("label")), "labels")
        if until_stable and new.exceptAll(labels).isEmpty():
            return new
        labels = new
    return labels


def clusters(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def bands(sizes: DataFrame, useful: tuple[int, int] = USEFUL) -> DataFrame:
    """(band, n_communities, n_members): single, useful or mega."""
    low, high = useful
    band = F.when(F.col("n") < low, "single").when(F.col("n") > high, "mega").otherwise("useful")
    return sizes.groupBy(band.alias("band")).agg(F.count("*").alias("n_communities"), F.sum("n").alias("n_members"))


def largest(sizes: DataFrame, k: int = 50, useful: tuple[int, int] = USEFUL) -> DataFrame:
    return sizes.where(F.col("n").between(*useful)).orderBy(F.desc("n"), "label").limit(k)


def size_distribution(sizes: DataFrame) -> DataFrame:
    """One row: number, greatest, least, and median as the element n / 2 of the descending sizes, and the five greatest.

    By counts of each size, so that no list of all communities is made.
    """
    by_size = sizes.groupBy("n").agg(F.count("*").alias("c"))
    down = Window.orderBy(F.desc("n"))
    placed = by_size.withColumn("to", F.sum("c").over(down)).withColumn("total", F.sum("c").over(Window.partitionBy()))
    median = F.max(F.when((F.col("to") > F.floor(F.col("total") / 2)) & (F.col("to") - F.col("c") <= F.floor(F.col("total") / 2)), F.col("n")))
    top = F.array_join(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", F.least("c", F.lit(5)).cast("int").alias("c"))), asc=False), lambda x: F.array_repeat(x["n"], x["c"]))), 1, 5), ",")
    return placed.agg(F.max("total").alias("n_communities"), F.max("n").alias("greatest"), F.min("n").alias("least"), median.alias("median"), top.alias("top5"))


def members(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """(community, n_members, first_name) of communities with two members or more."""
    rows = labels.join(entities.select("uuid", "name"), "uuid")
    return rows.groupBy(F.col("label").alias("community")).agg(F.countDistinct("uuid").alias("n_members"), F.min("name").alias("first_name")).where(F.col("n_members") >= 2)


def orphans_inside(labels: DataFrame, edges: DataFrame) -> DataFrame:
    return labels.join(ends(edges), "uuid", "left_anti").agg(F.countDistinct("uuid").alias("n_orphans"))


def build(entities: DataFrame, edges: DataFrame, labels: DataFrame, k: int = 50, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(label, n, name, summary) of the k largest useful communities: the heaviest members' names and five facts.

    A community of which entities has fewer than LEAST_FOUND members is left out. named: adds the column fact to edges within
    these communities, where edges lack it. Members are k times the greatest useful size at most, so edges are only looked up, not sent.
    """
    top = largest(clusters(labels), k)
    chosen = F.broadcast(cut(labels.join(F.broadcast(top), "label")))
    weight = both_ways(edges.select("source_uuid", "target_uuid")).join(chosen.select(F.col("uuid").alias("node")), "node", "left_semi").groupBy(F.col("node").alias("uuid")).agg(F.count("*").alias("weight"))
    inside = chosen.join(entities.select("uuid", "name"), "uuid").join(weight, "uuid", "left")
    order = Window.partitionBy("label").orderBy(F.desc_nulls_last("weight"), "uuid")
    some = inside.groupBy("label").agg(F.count("*").alias("found")).where(F.col("found") >= LEAST_FOUND).select("label")
    names = inside.join(F.broadcast(some), "label").withColumn("i", F.row_number().over(order)).where("i <= 3").groupBy("label", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ", ").alias("name"))
    source = chosen.select(F.col("uuid").alias("source_uuid"), "label")
    target = chosen.select(F.col("uuid").alias("target_uuid"), F.col("label").alias("target_label"))
    facts = edges.join(source, "source_uuid").join(target, "target_uuid").where(F.col("label") == F.col("target_label"))
    facts = facts if named is None else named(facts)
    fifth = Window.partitionBy("label").orderBy("fact", "uuid")
    facts = facts.withColumn("i", F.row_number().over(fifth)).where("i <= 5").groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("fact")), "; ").alias("summary"))
    return names.join(facts, "label", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def connected(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node that pairs (a, b) connect it to; least labels spread with shortcuts until none changes."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        if new.join(labels.withColumnRenamed("component", "old"), "node").where("component != old").isEmpty():
            return new
        labels = new


def save(communities: DataFrame, path: str, group: str, run: str, append: bool = False) -> None:
    """Writes communities by group, with their run. A run replaces the group's earlier ones, and no other group's, unless `append`."""
    rows = communities.withColumn("group_id", F.lit(group)).withColumn("run_id", F.lit(run))
    writer = rows.write.partitionBy("group_id")
    writer.mode("append").parquet(path) if append else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
