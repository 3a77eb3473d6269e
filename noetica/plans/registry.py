"""Every registered query of the graph engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noetica.functions.text import iso, strip, tokens
from noetica.functions.vectors import norm
from noetica.operators import community, embedding, episodes, graph, intervals, resolve, retrieval, tasks, temporal
from noetica.operators.textindex import TextIndex
from noetica.operators.vectorindex import VectorIndex
from noetica.sources import threads, views
from noetica.storage import new_path, once, there

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K, LPA_ROUNDS, SIMILAR, LINKED, CROSS_BONUS = 10, 3, 0.3, 0.4, 0.08
# Fixed values of the design: cosines of a contradiction, a recurrence and a duplicate.
CONTRADICTS, RECURS, DUPLICATE = 0.75, 0.85, 0.92
WORDS = ["the", "thing", "trash"]
FACT_QUERY = "red widget"
HISTORY_WORD = "red widget"
PRIORITY = {"R": 0, "A": 1, "N": 2}
CUES = {"n_done": r"(^|\s)this\s", "n_acted": r"(^|\s)for\s", "n_decided": r"(^|\s)was\s", "n_compared": r"(^|\s)to\s"}  # words of the invented prose


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_of():
    return F.lit("1998-01-01 00:00:00").cast("timestamp")


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _dated(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: iso(F.col(c)) for c in columns})


def _members(spark: SparkSession, d: str) -> DataFrame:
    keys = F.substring("uuid", 3, 12).cast("long")
    return views.entities(spark, d).where((F.col("uuid").startswith("S:") & keys.between(1, 5)) | (F.col("uuid").startswith("P:") & keys.between(1, 200))).select("uuid")


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.from_turns(views.turns(spark, d))


# graph


@query
def graph_stats(spark, d):
    return graph.stats(views.entities(spark, d), views.links(spark, d), _episodes(spark, d), community_build(spark, d))


@query
def orphan_pct(spark, d):
    return graph.orphan_percent(graph.stats(views.entities(spark, d), views.edges(spark, d), _episodes(spark, d)))


@query
def node_lookup(spark, d):
    return graph.lookup(views.entities(spark, d), "S:1").select("uuid", "name", F.array_join("labels", ",").alias("labels"), "summary")


@query
def expand_1hop(spark, d):
    return _dated(graph.expand(views.entities(spark, d), views.edges(spark, d), "S:1", 20), "valid_at", "invalid_at")


@query
def expand_2hop(spark, d):
    seeds = views.entities(spark, d).where("uuid = 'S:1'").select("uuid")
    return graph.hops(views.edges(spark, d), seeds, 2)


@query
def reach_4hops(spark, d):
    """All that four hops reach from two suppliers over live edges, with the least of the shortest paths."""
    lists = once(spark, d, "neighbours", lambda: graph.neighbour_lists(views.edges(spark, d).where(F.col("expired_at").isNull())))
    seeds = views.entities(spark, d).where("uuid in ('S:1', 'S:2')").select("uuid")
    return graph.reached(lists, seeds, 4).select("uuid", "hop", F.array_join("path", " ").alias("path"))


@query
def edges_between(spark, d):
    return _dated(graph.between(views.edges(spark, d), _members(spark, d)).select("uuid", "source_name", "target_name", "fact", "valid_at", F.array_join("episodes", ",").alias("episodes")), "valid_at")


@query
def edges_between_asof(spark, d):
    out = graph.between(views.edges(spark, d), _members(spark, d), as_of(), include_invalidated=True)
    return _dated(out.select("uuid", "source_name", "target_name", "fact", "valid_at", "invalid_at"), "valid_at", "invalid_at")


@query
def orphan_entities(spark, d):
    return graph.orphans(views.entities(spark, d), views.edges(spark, d)).select("uuid", "name")


@query
def adjacency_weighted(spark, d):
    return graph.adjacency(views.edges(spark, d))


@query
def adjacency_full(spark, d):
    return graph.adjacency_full(views.entities(spark, d), views.edges(spark, d))


@query
def edge_triples(spark, d):
    return graph.triples(views.edges(spark, d), 15)


@query
def hub_entities(spark, d):
    return graph.hubs(views.edges(spark, d), K)


@query
def group_scan(spark, d):
    rows = views.entities(spark, d).where(F.col("group_id").isin(views.GROUP))
    return rows.groupBy(F.element_at("labels", -1).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("summary").alias("n_summaries"))


@query
def priority_subgraph(spark, d):
    """Around the five suppliers whose vectors are nearest to vector 0; vector i embeds supplier i."""
    rows = views.vectors(spark, d)
    own = rows.join(views.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    seeds = retrieval.nearest(own, rows.where("id = 0"), 5).select(F.concat(F.lit("S:"), "id").alias("uuid"))
    return graph.priority_subgraph(views.edges(spark, d), seeds, PRIORITY, 15)


@query
def thread_edge_types(spark, d):
    return graph.edge_types(views.edges(spark, d), _members(spark, d))


# temporal


@query
def history_search(spark, d):
    """Both sides of a date, each searched by words and vectors."""
    split = views.edges(spark, d).withColumn("bucket", temporal.bucket(F.lit("2001-06-01 00:00:00").cast("timestamp"), False)).where("bucket is not null")
    sides = [_search(spark, d, "facts", split.where(F.col("bucket") == side).select(F.col("uuid").alias("id"))).withColumn("bucket", F.lit(side)) for side in ("current", "superseded")]
    return sides[0].unionByName(sides[1]).withColumnRenamed("id", "uuid")


def _history(spark, d, at: str | None = None, null_open: bool = False) -> DataFrame:
    found = views.edges(spark, d).where(F.col("fact").contains(HISTORY_WORD))
    out = temporal.whole_history(found, K, [F.desc("valid_at"), F.col("uuid")], at and F.lit(at).cast("timestamp"), null_open)
    return _dated(out.select("bucket", "rank", "uuid", "fact", "valid_at", "invalid_at"), "valid_at", "invalid_at")


@query
def history_now(spark, d):
    return _history(spark, d)


@query
def history_asof(spark, d):
    return _history(spark, d, "2001-06-01 00:00:00")


@query
def history_asof_mcp(spark, d):
    return _history(spark, d, "2001-06-01 00:00:00", null_open=True)


@query
def history_counts(spark, d):
    bucket = F.when(temporal.valid_at(as_of(), open_start=True), "current").when(F.col("invalid_at").isNotNull() & (F.col("valid_at") <= as_of()), "superseded").otherwise("neither")
    return views.edges(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query
def edge_supersession(spark, d):
    return _dated(views.edges(spark, d).select("uuid", "valid_at", "invalid_at", "expired_at"), "valid_at", "invalid_at", "expired_at")


def _arrivals(spark, d) -> list[DataFrame]:
    """Edges in three parts that arrive out of order, with some of the first part in the second again."""
    rows = views.raw_edges(spark, d).withColumn("expired_at", F.lit(None).cast("timestamp")).withColumn("invalid_at", F.lit(None).cast("timestamp"))
    rows = once(spark, d, "arrivals", lambda: rows.withColumn("turn", F.pmod(F.crc32("uuid"), F.lit(3))))
    return [rows.where(turns).drop("turn") for turns in ("turn = 2", "turn = 0 or turn = 2 and source_uuid = 'S:1'", "turn = 1")]


@query
def ingest_supersession(spark, d):
    """Intervals as they are after all edges have arrived in parts, each of which brought the intervals up to date that it touched."""
    table = intervals.EdgeTable(spark, new_path(spark, "arrived"), ["target_uuid"], ["valid_at", "source_uuid"], buckets=8)
    for part in _arrivals(spark, d):
        table.ingest(part)
    return _dated(table.read().select("uuid", "target_uuid", "valid_at", "invalid_at"), "valid_at", "invalid_at")


@query
def asof_periods(spark, d):
    """Edges valid at a date, from the table by periods: other periods' files are not read."""
    found = intervals.read_periods(_periods(spark, d), "2001-06-01 00:00:00")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("target_uuid").alias("n_targets"), F.min("uuid").alias("first_uuid"))


def _periods(spark, d) -> DataFrame:
    return once(spark, d, "periods", lambda: intervals.with_periods(views.edges(spark, d)), *intervals.PERIODS)


@query
def mark_resolved(spark, d):
    nodes = views.entities(spark, d).select("uuid", "name", F.lit(None).cast("timestamp").alias("resolved_at"))
    marks = views.edges(spark, d).where("name = 'R'").select(F.col("target_uuid").alias("uuid"), F.col("valid_at").alias("resolved_at"))
    return _dated(temporal.resolved(nodes, marks), "resolved_at")


# episodes


@query
def conversation_episodes(spark, d):
    return _episodes(spark, d)


@query
def turn_split(spark, d):
    out = threads.split_turns(views.sources(spark, d).select("conv_id", "raw_content"))
    return out.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "content")


@query
def notes_capped(spark, d):
    return episodes.from_notes(views.notes(spark, d)).select("doc_id", "name", F.length("body").alias("n"), F.md5("body").alias("body_md5"))


@query
def sensitive_filter(spark, d):
    from noetica.functions.text import is_sensitive

    name = F.substring_index("text", "\n", 1)  # a document's first line as its name; bodies are not looked at
    return views.read(spark, d, "documents").select(is_sensitive(name).alias("sensitive")).groupBy("sensitive").agg(F.count("*").alias("n"))


@query
def length_filter(spark, d):
    docs = views.read(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return episodes.long_enough(docs).select("doc_id", F.length(strip(F.col("body"))).alias("n"))


@query
def skip_existing_anti(spark, d):
    all_notes = views.notes(spark, d)
    return episodes.not_imported(all_notes, all_notes.where("doc_id % 2 = 0")).select("doc_id", "name")


@query
def remaining_notes_anti(spark, d):
    all_notes = views.notes(spark, d)
    return episodes.remaining(all_notes, all_notes.where("doc_id % 3 = 0")).select("doc_id", "name")


@query
def skip_limit(spark, d):
    return episodes.resumed(views.notes(spark, d).select("doc_id", "name"), "doc_id", 100, 50)


@query
def corpus_summary(spark, d):
    return episodes.corpus_totals(views.notes(spark, d))


@query
def role_counts(spark, d):
    return episodes.roles(views.turns(spark, d))


@query
def thread_sources(spark, d):
    out = episodes.thread_sources(views.sources(spark, d), "assistant-thread", 100, views.EXCLUDED_LABELS)
    return out.select("conv_id", "label", F.coalesce("created_at", F.lit(views.DEFAULT_TIME)).alias("created_at"), F.length("raw_content").alias("n"))


@query
def source_lookup(spark, d):
    return episodes.point_lookup(views.sources(spark, d), "CONV 1%").select("conv_id", "label", F.length("raw_content").alias("n"))


@query
def episode_check(spark, d):
    """Notes, those of some sources with a time that does not parse."""
    good, bad = _checked(spark, d)
    return good.agg(F.count("*").alias("n_good"), F.countDistinct("uuid").alias("n_ids")).join(bad.agg(F.count("*").alias("n_bad")), F.lit(True))


@query
def import_rollup(spark, d):
    return episodes.roll_up(*_checked(spark, d))


def _checked(spark, d):
    notes = views.notes(spark, d).select("name", F.col("body").alias("content"), F.when(F.col("name").startswith("src1"), F.lit("2026-01-02T03:04:05Z")).otherwise(F.lit("yesterday")).alias("reference_time"))
    return episodes.checked(notes)


@query
def saga_import(spark, d):
    """Turns of conversations imported in order: a turn adds the words that no turn before it in its conversation has brought; short ones fail."""
    turns = views.turns(spark, d).select("saga", F.col("turn").alias("turn_index"), "content")

    def step(known: set, row: dict) -> int:
        if len(row["content"]) < episodes.LEAST_TURN:
            raise ValueError("short")
        new = set(row["content"].split(" ")) - known
        known |= new
        return len(new)

    return episodes.in_saga_order(turns, set, step, "long").select("saga", "turn_index", "status", "reason", F.col("made").alias("n_new"))


@query
def search_sources_limit(spark, d):
    out = episodes.thread_sources(views.sources(spark, d), "search-thread", 200)
    return out.orderBy(F.asc_nulls_first("created_at"), "conv_id").limit(20).select("conv_id", "label", "created_at")


@query
def search_thread_extract(spark, d):
    """Conversations rewritten as search threads (query: first user turn, answer: first assistant turn), and read back."""
    rows = views.read(spark, d, "conversations").where("role in ('user', 'assistant')")
    first = rows.groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    both = first.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("q"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("a"))
    step = lambda kind, **c: F.struct(F.lit(kind).alias("step_type"), F.struct(*[v.alias(k) for k, v in c.items()]).alias("content"))
    raw = F.concat(F.lit("[Assistant]: ["), F.to_json(step("INITIAL_QUERY", query=F.col("q"))), F.lit(", "), F.to_json(step("FINAL", answer=F.col("a"))), F.lit("][]"))
    return threads.extract_searches(both.select(F.concat(F.lit("conv "), "conv_id").alias("label"), raw.alias("raw_content")))


@query
def preview_projection(spark, d):
    out = views.edges(spark, d).select("uuid", "fact", F.col("target_name").alias("name"))
    return episodes.preview(out, {"fact": 20, "name": 10})


# search


def _texts(spark, d) -> DataFrame:
    return views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query
def vector_topk(spark, d):
    rows = views.vectors(spark, d)
    return retrieval.nearest(rows, rows.where("id = 0"), K)


_INDEXES: dict[tuple[str, str, str], tuple[TextIndex, VectorIndex | None]] = {}


def _index(spark, d, kind: str) -> tuple[TextIndex, VectorIndex | None]:
    """The stored indexes of documents (by words only), facts or nodes: built once in an application."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _INDEXES or there(spark, _INDEXES[key][0].path) is None:
        texts = {"documents": lambda: _texts(spark, d), "facts": lambda: views.facts_as_text(views.edges(spark, d)), "nodes": lambda: _node_texts(spark, d)}[kind]()
        by_words = TextIndex(spark, new_path(spark, f"{kind}-words"), buckets=16)
        by_words.append(texts)
        _INDEXES[key] = by_words, None if kind == "documents" else VectorIndex.build(texts, new_path(spark, f"{kind}-vectors"))
    return _INDEXES[key]


def _search(spark, d, kind: str, within: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) of the K best."""
    return retrieval.hybrid(*retrieval.both_scores(*_index(spark, d, kind), FACT_QUERY, 50, within), K)


@query
def bm25_topk(spark, d):
    return retrieval.ranked(_index(spark, d, "documents")[0].scores(WORDS), K)


@query
def hybrid_rrf(spark, d):
    rows = views.vectors(spark, d)
    return retrieval.fused([retrieval.ranked(_index(spark, d, "documents")[0].scores(WORDS), 50), retrieval.nearest(rows, rows.where("id = 0"), 50)], K)


@query
def search_edges(spark, d):
    edges = views.edges(spark, d)
    hits = _search(spark, d, "facts")
    fields = ["name", "fact", "source_name", "target_name", "valid_at", "invalid_at", "expired_at", F.array_join("episodes", ",").alias("episodes")]
    return _dated(hits.join(edges.select(F.col("uuid").alias("id"), *fields, F.col("valid_at").alias("created_at")), "id"), "created_at", "valid_at", "invalid_at", "expired_at")


def _node_texts(spark, d) -> DataFrame:
    return views.entities(spark, d).select(F.col("uuid").alias("id"), F.concat_ws(" ", "name", "summary").alias("text"))


@query
def search_nodes(spark, d):
    nodes = views.entities(spark, d)
    return _search(spark, d, "nodes").join(nodes.select(F.col("uuid").alias("id"), "name"), "id")


@query
def passthrough_rank(spark, d):
    """The 120 best facts of a search by words, as a reranker would get them."""
    hits = retrieval.ranked(_index(spark, d, "facts")[0].scores(FACT_QUERY.split()), 120)
    return retrieval.passthrough(hits).select(F.col("id").alias("uuid"), "rank", "score")


@query
def source_fulltext(spark, d):
    query = "stupid trash"
    return retrieval.full_text(_texts(spark, d), query, 5, _index(spark, d, "documents")[0].scores(query.split())).select("id", "form", "score", "rank")


@query
def text_vectors(spark, d):
    """Nodes whose vectors are among the 40 nearest to a query's, or as near as the 40th."""
    index = _index(spark, d, "nodes")[1]
    return index.scores("blue gear standard", 40)


@query
def token_counts(spark, d):
    words = _texts(spark, d).select(F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


# communities


def _labels(spark, d) -> DataFrame:
    """Labels of the community job: propagated once in an application, then read."""
    return once(spark, d, "labels", lambda: community.label_propagation(views.entities(spark, d), views.links(spark, d), LPA_ROUNDS))


@query
def lpa_rounds(spark, d):
    return _labels(spark, d)


@query
def community_size_bands(spark, d):
    return community.bands(community.clusters(_labels(spark, d)))


@query
def community_sizes(spark, d):
    return community.largest(community.clusters(_labels(spark, d)))


@query
def community_size_dist(spark, d):
    return community.size_distribution(community.clusters(_labels(spark, d)))


@query
def community_members(spark, d):
    return community.members(_labels(spark, d), views.entities(spark, d))


@query
def orphans_in_communities(spark, d):
    return community.orphans_inside(_labels(spark, d), views.links(spark, d))


@query
def community_build(spark, d):
    return community.build(views.entities(spark, d), views.links(spark, d), _labels(spark, d), named=lambda rows: views.named(spark, d, rows))


@query
def list_communities(spark, d):
    built = community_build(spark, d)
    return built.select(F.concat(F.lit("C:"), "label").alias("uuid"), "name", F.coalesce("summary", F.lit("")).alias("summary")).orderBy("name", "uuid")


# embeddings


@query
def similar_pairs(spark, d):
    return embedding.similar(views.planted_vectors(spark, d), CONTRADICTS).select("a", "b", "score")


@query
def knn_topk(spark, d):
    rows = views.vectors(spark, d)
    return embedding.neighbours(rows, rows.where("id % 100 = 0"), 3)


@query
def normalize_vectors(spark, d):
    out = embedding.unit(views.vectors(spark, d), 32)
    return out.select("id", F.size("embedding").alias("n"), F.round(norm(F.col("embedding")), 6).alias("length"), F.round(F.col("embedding")[0], 6).alias("first"))


@query
def embedder_overlap(spark, d):
    rows = views.vectors(spark, d)
    parts = [rows.withColumn("embedding", F.slice("embedding", start, 32)) for start in (1, 33)]
    first, second = (retrieval.nearest(p, p.where("id = 0"), 30) for p in parts)
    return embedding.overlap(first, second)


@query
def embedder_facts(spark, d):
    """The three nearest texts of each hundredth vector by two embedders, the halves of the vectors."""
    rows = views.vectors(spark, d)
    halves = [(side, rows.withColumn("embedding", F.slice("embedding", start, 32))) for side, start in (("first", 1), ("second", 33))]
    best = [embedding.neighbours(half, half.where("id % 100 = 0"), 3).withColumn("side", F.lit(side)) for side, half in halves]
    facts = _texts(spark, d).select("id", F.substring("text", 1, 40).alias("fact"))
    return best[0].unionByName(best[1]).join(facts, "id", "left")


@query
def near_dup_nodes(spark, d):
    return embedding.duplicates(views.planted_vectors(spark, d), DUPLICATE)


@query
def entity_resolution(spark, d):
    """Mentions of notes, all names with characters lost, and those of parts with words added and with one left out."""
    told = resolve.extracted(views.notes(spark, d).select(F.col("doc_id").alias("uuid"), F.col("body").alias("content"))).select("mention")
    entities = views.entities(spark, d)
    parts = entities.where("uuid like 'P:%'")
    names = entities.select(F.regexp_replace(F.upper("name"), "0#|#0", "##").alias("mention"))
    longer, shorter = parts.select(F.concat(F.lit("Quoted: "), "name", F.lit(" (item)")).alias("mention")), parts.select(F.regexp_replace("name", r"^\S+ ", "").alias("mention"))
    return resolve.resolve(told.unionByName(names).unionByName(longer).unionByName(shorter), entities)


# threads of activity


@query
def segment_windows(spark, d):
    out = tasks.windows(views.events(spark, d), "user_id", "ts")
    return _dated(out.withColumn("window_no", F.col("window_no").cast("int")), "started", "ended")


@query
def segment_enrich(spark, d):
    docs = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source"), "text")
    out = tasks.enriched(docs, {"en": "[english note] ", "de": "[german note] "}, {"en": 30, "de": 15, "fr": 20})
    return out.select("id", "source", F.md5("enriched").alias("enriched_md5"))


@query
def recurrence_flags(spark, d):
    """Over all pairs of some likeness, and beside it over those at the design's threshold."""
    return tasks.recurring(views.planted_vectors(spark, d), views.embedded_times(spark, d), SIMILAR, RECURS)


@query
def contradiction_flags(spark, d):
    """All pairs of some likeness; `near` are those over the design's threshold."""
    return tasks.contradicting(views.planted_vectors(spark, d), views.embedded_texts(spark, d), SIMILAR, CONTRADICTS)


@query
def thread_components(spark, d):
    """Pairs of different kinds need less likeness than others by a bonus."""
    pairs = embedding.similar(views.vectors(spark, d), LINKED - CROSS_BONUS)
    bonus = F.when(F.col("a_kind") != F.col("b_kind"), CROSS_BONUS).otherwise(0.0)
    return community.connected(pairs.where(F.col("score") + bonus > LINKED))


def _threads(spark, d) -> DataFrame:
    """A thread for each user and type of event."""
    count = lambda kind: F.count_if((F.col("event_type") == kind) & (F.col("value") > 40))
    return views.events(spark, d).groupBy(F.concat_ws(":", "user_id", "event_type").alias("thread_id")).agg(
        count("purchase").alias("n_done"),
        count("click").alias("n_acted"),
        count("signup").alias("n_decided"),
        F.count_if(F.col("event_type") == "view").alias("n_compared"),
        F.max("ts").alias("last_at"),
        F.min("ts").alias("first_at"),
        F.count("*").alias("n"),
        F.countDistinct(F.hour("ts")).alias("n_sources"),
    )


def _states(spark, d) -> DataFrame:
    return tasks.states(_threads(spark, d), now())


@query
def thread_states(spark, d):
    return tasks.with_action(_states(spark, d)).select("thread_id", "n_done", "n_acted", "n_decided", "n_compared", "idle_days", "state", "action")


@query
def threads_by_state(spark, d):
    return _states(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query
def delivery_gate(spark, d):
    surfaced = F.when(F.col("n_compared") > 0, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    rows = _states(spark, d).withColumn("last_surfaced_at", surfaced).withColumn("score", F.col("n") / 100)
    return tasks.gated(rows, now()).select("thread_id", "score", "idle_days", "rank")


@query
def ppp_metrics(spark, d):
    return tasks.delivery_measures(views.delivery_events(spark, d), F.col("value") > 10)


@query
def mention_trajectory(spark, d):
    return _dated(tasks.trajectory(views.events(spark, d), "event_type", "ts"), "bucket")


@query
def intention_gap(spark, d):
    rows = views.events(spark, d)
    stated = rows.where("event_type = 'signup'").select("user_id").distinct()
    return tasks.intention_gap(stated, rows.where("event_type = 'purchase' and value > 60").select("user_id").distinct(), "user_id")


@query
def confidence_scores(spark, d):
    rows = views.delivery_events(spark, d).where("response in ('acted', 'dismissed')")
    return tasks.confidences(rows.select(F.col("user_id").alias("id"), (F.col("response") == "acted").alias("supports")))


@query
def decay_scores(spark, d):
    rows = _threads(spark, d).select("thread_id", F.col("n").cast("double").alias("strength"), "last_at")
    return tasks.decayed(rows, now(), 0.05).select("thread_id", "strength")


@query
def stall_scores(spark, d):
    rows = _states(spark, d).select("thread_id", (F.col("n_acted") > 0).alias("has_verb"), F.when(F.col("n_done") > 0, F.col("last_at")).alias("resolved_at"), "idle_days", "n_sources")
    return tasks.stall_scores(rows).select("thread_id", "stall_score")


@query
def boilerplate_filter(spark, d):
    return tasks.without_boilerplate(_texts(spark, d)).select("id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query
def desire_levels(spark, d):
    rows = _threads(spark, d).select("thread_id", F.datediff("last_at", "first_at").alias("days"), "n")
    return tasks.desire_levels(rows)


@query
def load_gates(spark, d):
    return _dated(tasks.load_gates(views.events(spark, d), "ts", "event_type"), "started")


@query
def idle_gates(spark, d):
    return _dated(tasks.idle_gates(views.events(spark, d), "user_id", "ts", now()), "started", "ended")


@query
def conversation_states(spark, d):
    """Conversations as threads, by the language of their turns and when they began."""
    turns = views.turns(spark, d).select(F.col("saga").alias("thread_id"), F.col("content").alias("text"), F.to_timestamp(F.coalesce("created_at", F.lit(views.DEFAULT_TIME))).alias("at"))
    rows = tasks.told(turns, CUES).join(turns.groupBy("thread_id").agg(F.max("at").alias("last_at")), "thread_id")
    return tasks.states(rows, F.lit("2026-01-04 00:00:00").cast("timestamp")).drop("last_at")


@query
def supplier_states(spark, d):
    """Suppliers as threads, by the types of their edges."""
    rows = views.edges(spark, d).select(F.col("source_uuid").alias("thread_id"), "name", "valid_at")
    return tasks.states(tasks.linked(rows, {"R": "n_compared", "A": "n_decided", "N": "n_acted"}), F.lit("2001-11-08 00:00:00").cast("timestamp")).drop("last_at")
