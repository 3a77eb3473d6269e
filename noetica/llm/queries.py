"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noetica.llm import bpe, fingerprints, kmeans, langid, line_dedup, packing, pii, quality, ranked, search, simhash, suffix_dedup, window_dedup
from noetica.llm.common import documents, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), width=50)


def op6_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.dedup(documents(spark, sf_dir), width=20)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), k=10)


def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assigned(table(spark, sf_dir, "embeddings"), k=40, dimensions=64, rounds=5, seed="2:")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir), least_chars=20, least_docs=3)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_simhash, op3_packing, op4_quality, op5_suffix_dedup, op6_window_dedup, op7_pii, op8_langid, op9_fingerprints, op10_search, op11_elkan, op12_line_dedup, op13_ranked)}


_NEXT_WORDS = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, 20))])
WINDOWS_SQL = (
    r"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
win AS (SELECT r, j AS i, """
    + _NEXT_WORDS
    + """ AS s FROM words WINDOW w AS (PARTITION BY r ORDER BY j)),
firsts AS (SELECT s, min((r, i)) AS f FROM win WHERE s IS NOT NULL GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM win JOIN firsts USING (s) WHERE (r, i) <> f),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
)

SEARCH_SQL = r"""WITH toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
totals AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM toks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT doc_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS s, dl FROM tf JOIN df USING (term) CROSS JOIN totals),
scored AS (SELECT q.doc_id AS query_id, p.doc_id, any_value(p.dl) AS dl, round(sum(p.s), 9) AS score FROM tf q JOIN part p USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, dl DESC)::INT AS rank, doc_id, score FROM scored QUALIFY rank <= 10"""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _elkan_sql(k: int = 40, dimensions: int = 64, rounds: int = 5) -> str:
    """All distances in each round."""
    assign = "a{i} AS MATERIALIZED (SELECT r, any_value(x.v) AS v, min((list_sum([(x.v[j] - w.v[j]) * (x.v[j] - w.v[j]) FOR j IN range(1, " + str(dimensions + 1) + ")])::BIGINT, c)) AS best FROM x CROSS JOIN c{i} w GROUP BY r)"
    move = """s{i} AS (SELECT c, j, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS e FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{j} AS MATERIALIZED (SELECT c, coalesce(m.v, w.v) AS v FROM c{i} w LEFT JOIN m{i} m USING (c))"""
    steps = [f"{assign.format(i=i)},\n{move.format(i=i, j=i + 1)}" for i in range(rounds)] + [assign.format(i=rounds)]
    return f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {dimensions}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS c, v FROM x ORDER BY c LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, c AS cluster, a.best[1] AS distance, sum(a.best[1]) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(a.best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(w.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} w ON a.best[2] = w.c JOIN x USING (r)"""


LINES_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS j, unnest(ls) AS line FROM d),
keyed AS (SELECT *, translate(trim(line, e' \\t\\n\\x0B\\x0C\\r'), {_CAPITALS}) AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY j) AS t FROM keyed LEFT JOIN often USING (k) WHERE last IS NULL OR last = doc_id GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

RANKED_SQL = rf"""WITH toks AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_words FROM toks WHERE len(ws) > 0),
asked AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked WHERE item_id IS NOT NULL),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM toks) SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT r, doc_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_words)))) AS s FROM tf JOIN df USING (term) CROSS JOIN total),
scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(s)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """For those whose rows plain SQL gives; the others are tested against libraries, brute force or held-out rows."""
    return {"op6_window_dedup": WINDOWS_SQL, "op10_search": SEARCH_SQL, "op11_elkan": _elkan_sql(), "op12_line_dedup": LINES_SQL, "op13_ranked": RANKED_SQL}
