"""The verbs of the service as methods over DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noetica.functions.text import words
from noetica.operators import community, episodes, graph, intervals, resolve, retrieval, temporal
from noetica.operators.textindex import TextIndex
from noetica.operators.vectorindex import VectorIndex
from noetica.storage import cut, new_path

#: Strings, quoted names and comments of a query.
_QUOTED = re.compile(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)
#: A fact supersedes an older one of the same subject and relation.
SUPERSEDE = ["source_uuid", "name"]


@dataclass
class GraphEngine:
    """entities, edges, episodes and communities, and what is derived from them once it is asked for.

    Verbs return DataFrames. Those that search build indexes of facts, names and episodes at the first question, in the
    shared folder, and what is added is appended to them; those that add, expand by hops or build communities cut their lineage there and so run jobs too.
    """

    entities: DataFrame
    edges: DataFrame
    episodes: DataFrame
    communities: DataFrame | None = None
    groups: list[str] | None = field(default=None)
    _indexes: dict = field(default_factory=dict, repr=False, compare=False)

    def _of_groups(self, df: DataFrame, groups: list[str] | None) -> DataFrame:
        wanted = groups if groups is not None else self.groups
        return df if wanted is None else df.where(F.col("group_id").isin(wanted))

    @staticmethod
    def _texts(kind: str, rows: DataFrame) -> DataFrame:
        text = {"facts": F.col("fact"), "nodes": F.concat_ws(" ", "name", "summary"), "episodes": F.col("content")}[kind]
        return rows.select(F.col("uuid").alias("id"), text.alias("text"))

    def _index(self, kind: str) -> tuple[TextIndex, VectorIndex | None]:
        """The stored indexes of facts, nodes or episodes (these by words only), over all groups; what is missing is built."""
        by_words, by_vectors = self._indexes.get(kind, (None, None))
        texts = self._texts(kind, {"facts": self.edges, "nodes": self.entities, "episodes": self.episodes}[kind])
        if by_words is None:
            by_words = TextIndex(texts.sparkSession, new_path(texts.sparkSession, f"{kind}-words"))
            by_words.append(texts)
        if by_vectors is None and kind != "episodes":
            by_vectors = VectorIndex.build(texts, new_path(texts.sparkSession, f"{kind}-vectors"))
        self._indexes[kind] = by_words, by_vectors
        return by_words, by_vectors

    def _moved(self, **new: DataFrame) -> dict:
        """The indexes there are, with new rows of each kind, for the engine that has these rows; this one would build its own again.

        An index of vectors that has outgrown what it was fitted to is left behind, and the next question builds it anew.
        """
        moved = {}
        for kind, (by_words, by_vectors) in self._indexes.items():
            if kind in new:
                by_words.append(self._texts(kind, new[kind]))
                if by_vectors is not None:
                    by_vectors.append(self._texts(kind, new[kind]))
                    by_vectors = None if by_vectors.outgrown() else by_vectors
            moved[kind] = by_words, by_vectors
        self._indexes.clear()
        return moved

    def _search(self, kind: str, rows: DataFrame, query: str, k: int, part: bool) -> DataFrame:
        """(rank, score, columns of rows) of the k best of rows, which are all that is indexed or a part of it."""
        deep = max(50, k)
        hits = retrieval.hybrid(*retrieval.both_scores(*self._index(kind), query, deep, rows.select(F.col("uuid").alias("id")) if part else None), k, deep)
        return hits.join(rows.withColumnRenamed("uuid", "id"), "id").withColumnRenamed("id", "uuid")

    def search(self, query: str, k: int = 10, groups: list[str] | None = None) -> DataFrame:
        rows = self._of_groups(self.edges, groups)
        return self._search("facts", rows, query, k, rows is not self.edges).orderBy("rank")

    def search_nodes(self, query: str, k: int = 10, groups: list[str] | None = None) -> DataFrame:
        rows = self._of_groups(self.entities, groups)
        return self._search("nodes", rows, query, k, rows is not self.entities).orderBy("rank")

    def get_node(self, uuid: str) -> DataFrame:
        return graph.lookup(self.entities, uuid)

    def expand(self, seeds: list[str], hops: int = 1, limit: int = 20, include_invalidated: bool = False) -> DataFrame:
        """One seed and hop: a row per edge; else the nodes reached, with their hop."""
        if len(seeds) == 1 and hops == 1:
            return graph.expand(self.entities, self.edges, seeds[0], limit, include_invalidated)
        start = self.entities.where(F.col("uuid").isin(seeds)).select("uuid")
        return graph.hops(self.edges, start, hops, include_invalidated).orderBy("hop", "uuid").limit(limit)

    def edges_between(self, uuids: list[str], as_of: Column | None = None, include_invalidated: bool = False) -> DataFrame:
        members = self.entities.where(F.col("uuid").isin(uuids)) if uuids else self.entities.limit(0)
        return graph.between(self.edges, members.select("uuid"), as_of, include_invalidated)

    def history(self, query: str, as_of: Column | None = None, k: int = 10, null_open: bool = False) -> DataFrame:
        """Current and superseded edges for a query, k of each at most: split by the date first, then each side is searched."""
        split = self._of_groups(self.edges, None).withColumn("bucket", temporal.bucket(as_of, null_open)).where("bucket is not null")
        sides = [self._search("facts", split.where(F.col("bucket") == side), query, k, True) for side in ("current", "superseded")]
        return sides[0].unionByName(sides[1])

    def get_source(self, query: str, k: int = 5) -> DataFrame:
        """Whole episodes by full text; a blank query is an error."""
        texts = self.episodes.select(F.col("uuid").alias("id"), F.col("content").alias("text"))
        hits = retrieval.full_text(texts, query, k, self._index("episodes")[0].scores(words(query)))
        return hits.join(self.episodes.withColumnRenamed("uuid", "id"), "id").orderBy("rank")

    def query(self, sql: str, **arguments) -> DataFrame:
        """Rows of a query over entities, edges, episodes and communities, with :name markers for its arguments.

        Arguments are bound as values and never become part of the text. The text stands in brackets as one table of a larger
        query, so it can't be another kind of statement; one that would close these brackets is an error.
        """
        frames = {"entities": self.entities, "edges": self.edges, "episodes": self.episodes, "communities": self.communities}
        named = {name: df for name, df in frames.items() if df is not None}
        depth = 0
        for c in _QUOTED.sub(" ", sql):
            depth += (c == "(") - (c == ")")
            if depth < 0 or c in "{};":
                raise ValueError("one query without braces and semicolons is expected")
        views = "".join(f"{name} AS (SELECT * FROM {{{name}_}}), " for name in named)
        text = sql.replace("{", "{{").replace("}", "}}")
        return self.entities.sparkSession.sql(f"WITH {views}answer_ AS (\n{text}\n) SELECT * FROM answer_", args=arguments or None, **{f"{name}_": df for name, df in named.items()})

    def stats(self) -> DataFrame:
        return graph.stats(self.entities, self.edges, self.episodes, self.communities)

    def list_communities(self, k: int | None = None) -> DataFrame:
        """All communities by name, or the first k."""
        if self.communities is None:
            return self.entities.limit(0).select("uuid", "name", F.lit("").alias("summary"))
        listed = self.communities.select("uuid", "name", F.coalesce("summary", F.lit("")).alias("summary")).orderBy("name", "uuid")
        return listed if k is None else listed.limit(k)

    def build_communities(self, rounds: int = 10) -> DataFrame:
        labels = community.label_propagation(self.entities, self.edges, rounds)
        return community.build(self.entities, self.edges, labels)

    def community_job(self, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
        """(communities, one row of orphans before and after and of communities): an orphan has no edge and is in no built community."""
        labels = cut(community.label_propagation(self.entities, self.edges, rounds))
        built = cut(community.build(self.entities, self.edges, labels))
        before = graph.orphans(self.entities, self.edges)
        after = before.join(labels.join(built.select("label"), "label", "left_semi"), "uuid", "left_anti")
        counts = before.agg(F.count("*").alias("orphans_before")).join(after.agg(F.count("*").alias("orphans_after")), F.lit(True))
        return built, counts.join(built.agg(F.count("*").alias("communities")), F.lit(True))

    def add_episodes(self, rows: DataFrame, extract: Callable[[DataFrame], DataFrame] = resolve.extracted, facts: Callable[[DataFrame], DataFrame] | None = None, at: Column | None = None, supersede: list[str] | None = SUPERSEDE) -> tuple[GraphEngine, DataFrame]:
        """(engine with the episodes of rows, their entities and facts; one row of what is new), for one episode or many at once.

        rows: (name, content, source, source_description, reference_time), and any other columns of episodes. Blank contents are
        left out, an episode that is there already adds nothing. extract gives (uuid, mention) of episodes, and mentions
        that resolve to no entity, by name and across all rows, become entities. facts gives (uuid, source, target, name, fact)
        of episodes, with mentions as source and target; without it no edges are made.

        A new fact supersedes the one before it with the same values in the columns `supersede`, in the order of their times: an older
        edge ends when the new one starts, and a late one ends when the next one that is there starts; what ends is
        expired at `at`, the time of this call (by default that of the latest episode). supersede=None, for bulk loads, ends nothing.
        The row has the numbers of new episodes, nodes, edges and communities.
        """
        group = F.lit((self.groups or ["default"])[0])
        given = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("uuid", episodes.episode_id("source_description", "content"))
        given = given.dropDuplicates(["uuid"]).join(self.episodes.select("uuid"), "uuid", "left_anti")
        new = cut(given.withColumn("group_id", group).select(*[(F.col(f.name) if f.name in (*rows.columns, "uuid", "group_id") else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.episodes.schema]))
        now = new.agg((F.max("reference_time") if at is None else F.max(at)).alias("at")).first()["at"]
        dated = new.select("uuid", F.col("reference_time").alias("at"))
        told = extract(new).join(dated, "uuid").groupBy("mention").agg(F.min("at").alias("at"))
        found = cut(resolve.resolve(told.select("mention"), self.entities).join(told, "mention").withColumn("key", resolve.normal(F.col("mention"))))
        nodes = found.where("uuid is null").groupBy("key").agg(F.min("mention").alias("name"), F.min("at").alias("created_at"))
        values = {"uuid": F.sha2(F.concat(F.lit("entity "), "key"), 256), "name": F.col("name"), "labels": F.array(F.lit("Entity")), "created_at": F.col("created_at"), "group_id": group}
        nodes = nodes.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.entities.schema])
        edges = self.edges.limit(0)
        if facts is not None:
            ids = found.select("mention", F.coalesce("uuid", F.sha2(F.concat(F.lit("entity "), "key"), 256)).alias("id"))
            stated = facts(new).withColumnRenamed("uuid", "episode").join(dated.withColumnRenamed("uuid", "episode"), "episode")
            for end in ("source", "target"):
                stated = stated.join(ids.select(F.col("mention").alias(end), F.col("id").alias(f"{end}_uuid")), end)
            stated = stated.groupBy("source_uuid", "target_uuid", "name", "fact").agg(F.min("at").alias("valid_at"), F.array_sort(F.collect_set("episode")).alias("episodes"))
            values = {c: F.col(c) for c in stated.columns} | {"uuid": F.sha2(F.concat_ws("\x1f", "source_uuid", "target_uuid", "name", "fact"), 256), "created_at": F.lit(now), "group_id": group}
            edges = stated.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.edges.schema]).join(self.edges.select("uuid"), "uuid", "left_anti").select(*self.edges.columns)
        edges = cut(edges)
        known = self.edges.unionByName(edges) if supersede is None or facts is None else cut(intervals.merged(self.edges, edges, supersede, ["valid_at", "uuid"], F.lit(now)))
        counts = [df.agg(F.count("*").alias(f"{name}_created")) for name, df in (("episodes", new), ("nodes", nodes), ("edges", edges))]
        one = F.lit(True)
        summary = counts[0].join(counts[1], one).join(counts[2], one).withColumn("communities_created", F.lit(0).cast("long"))
        nodes = cut(nodes)
        moved = self._moved(facts=edges, nodes=nodes, episodes=new)
        return GraphEngine(self.entities.unionByName(nodes), known, self.episodes.unionByName(new), self.communities, self.groups, moved), summary

    def add_episode(self, name: str, content: str, source_description: str, at: Column, **how) -> tuple[GraphEngine, DataFrame]:
        """add_episodes() for one episode of a time; the row has its id too, which is that of the old one if it was there. Blank content is an error."""
        if not content.strip():
            raise ValueError("blank episode")
        values = {"name": F.lit(name), "content": F.lit(content), "source": F.lit("text"), "source_description": F.lit(source_description), "reference_time": at}
        row = self.episodes.sparkSession.range(1).select(*[v.alias(k) for k, v in values.items()])
        more, counts = self.add_episodes(row, **how)
        return more, counts.join(row.select(episodes.episode_id("source_description", "content").alias("episode_uuid")), F.lit(True))

    def add_note(self, content: str, source_description: str, at: Column) -> GraphEngine:
        """An engine with one episode more; blank content is an error, and the same note twice is one."""
        if not content.strip():
            raise ValueError("blank note")
        spark = self.episodes.sparkSession
        values = {"name": F.lit(source_description), "content": F.lit(content), "source": F.lit("text"), "source_description": F.lit(source_description), "reference_time": at, "group_id": F.lit((self.groups or ["default"])[0])}
        row = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.episodes.schema])
        row = row.withColumn("uuid", episodes.episode_id("source_description", "content"))
        return GraphEngine(self.entities, self.edges, episodes.upsert(self.episodes, row), self.communities, self.groups, self._moved(episodes=row))
