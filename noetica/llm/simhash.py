"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 2).

Two fingerprints that differ in at most `radius` bits differ in at most half of them in one half of the bits.
Every distinct fingerprint therefore emits, for each of its two halves, all variants within half of that share, so
that such a pair meets on one variant at least; the shuffle is on variants, and colliding pairs are verified on all
64 bits. A variant under which over DENSE fingerprints meet would need too many verifications: its fingerprints go
the exact other way and emit every variant of all 64 bits within half the radius. There, all that meet are links by the
triangle inequality, so a star replaces the pairs. Nothing is dropped and no group is expanded into all pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other; an empty table gives no rows; texts
of any length are hashed whole; equal fingerprints (repeated rows included) share a component; rows with a null id get the
component of their fingerprint, whose id is the least non-null one (null if there is none); other columns of the input,
whatever their names, are ignored (one_of_each() keeps them all).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noetica.llm.common import released, texts_of, uncarried, written
from noetica.llm.components import components

#: Members of one variant that are verified pair by pair.
DENSE = 512
#: Variant rows that a task gets, until there are so many tasks.
TASK_ROWS, MOST_TASKS = 1 << 19, 50_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits: each set if it is set in over half of the shingles' hashes."""
    normal = b" ".join(text.lower().split())
    if not normal:
        return 0
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
    if len(spaces) < shingle - 1:
        return xxhash.xxh64_intdigest(normal, 42)
    starts = [0, *(spaces[: len(spaces) - shingle + 1] + 1).tolist()]
    ends = [*spaces[shingle - 1 :].tolist(), len(normal)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(normal[a:b], 42) for a, b in zip(starts, ends, strict=True)], "<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): a map over the scan; fp holds the 64 bits as a signed long."""

    def run(arrived):
        for batch in arrived:
            fps = np.array([fingerprint(t.encode(), shingle) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of `bits` bits with at most `radius` set, as signed longs."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member linked to it, directly or not) among distinct fingerprints."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(values)))
    return values[far], values[label[far]]


def _meetings(radius: int):
    """Turns (variant, fp) sorted by variant into verified links (a, b), and members of dense variants into (fp, null)."""

    def run(arrived):
        key, held, dense = None, [], False  # the open variant

        def close():
            if dense or len(held) < 2:
                return np.empty(0, np.uint64), np.empty(0, np.uint64)
            return _stars(np.sort(np.array(held, np.uint64)), radius)

        for batch in arrived:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(cuts, len(keys)))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            lone: list[np.ndarray] = []
            # whole runs of two, side by side; the first and last run may go on in other batches
            whole = np.ones(len(cuts), bool)
            whole[[0, -1]] = False
            two = cuts[whole & (sizes == 2)]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            out.append((fps[near], fps[near + 1]))
            rest = np.flatnonzero((whole & (sizes > 2)) | ~whole)
            for i in rest.tolist():
                a, n = int(cuts[i]), int(sizes[i])
                if keys[a] != key:
                    out.append(close())
                    key, held, dense = keys[a], [], False
                if dense:
                    lone.append(fps[a : a + n])
                    continue
                held += fps[a : a + n].tolist()
                if len(held) > DENSE:
                    lone.append(np.array(held, np.uint64))
                    held, dense = [], True
            yield _links(out, lone)
        yield _links([close()], [])

    return run


def _links(pairs: list[tuple[np.ndarray, np.ndarray]], lone: list[np.ndarray]) -> pa.RecordBatch:
    single = np.unique(np.concatenate([*lone, np.empty(0, np.uint64)]))
    a = np.concatenate([*(p[0] for p in pairs), single]).astype(np.uint64).view(np.int64)
    b = np.concatenate([*(p[1] for p in pairs), single]).astype(np.uint64).view(np.int64)
    none = np.arange(len(b)) >= len(b) - len(single)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=none)], ["a", "b"])


def _full_ball_stars(arrived):
    """(fp, least fp of the same variant) from (variant, fp) sorted by both."""
    key = least = None
    for batch in arrived:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        cuts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        firsts = np.append(least if least is not None else 0, fps[cuts])
        star = firsts[of + 1]
        key, least = keys[-1], star[-1]
        apart = star != fps
        pairs = np.unique(np.stack([fps[apart], star[apart]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])


def _tasks(rows: int) -> int:
    return min(max(8, rows // TASK_ROWS), MOST_TASKS)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): enough links to connect all that differ in at most `radius` bits."""
    if radius % 4 or not 0 <= radius <= 8:
        raise ValueError("radius must be 0, 4 or 8")
    count = distinct.count()
    low = F.lit(0xFFFFFFFF)
    masks = F.array(*[F.lit(m).cast("long") for m in ball(32, radius // 4)])
    emitted = distinct.select("fp", F.explode(F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))).alias("half"))
    emitted = emitted.select(F.explode(F.transform(masks, lambda m: F.col("half").bitwiseXOR(m))).alias("variant"), "fp")
    n = _tasks(count * 66)
    met = written(emitted.repartition(n, "variant").sortWithinPartitions("variant").mapInArrow(_meetings(radius), "a long, b long"), "met")
    found = met.where("b is not null")
    dense = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    if many := dense.count():
        dense = written(dense, "dense").repartition(max(8, _tasks(many * 2081) // 4))
        whole = dense.select(F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in ball(64, radius // 2)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"), "fp")
        whole = whole.repartition(_tasks(many * 2081), "variant").sortWithinPartitions("variant", "fp")
        found = found.union(whole.mapInArrow(_full_ball_stars, "a long, b long"))
    return found


def grouped(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id, least_fp) for every different fingerprint of (doc_id, fp).

    component_id: the least id of the component; least_fp: the fingerprint of its first row by (id, fingerprint), nulls last.
    """
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    root = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp")).alias("first")
    named = rooted.groupBy("root").agg(first).select("root", F.col("first.least_id").alias("component_id"), F.col("first.fp").alias("least_fp"))
    return rooted.join(named, "root").select("fp", "component_id", "least_fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; radius is a multiple of four."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    of_fp = grouped(fps, radius).select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """All columns of one row of each component: of the least id, and of that the least fingerprint, nulls last.

    The rows that stay are found by id and fingerprint together, so that a large group of copies is no hot key.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest)

    def run(arrived):
        for batch in arrived:
            fps = np.array([fingerprint(t.encode(), shingle) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, "fp"])
        released()

    rows = written(packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("fp", T.LongType())])), "rows")
    stay = grouped(rows.select("doc_id", "fp"), radius).where("fp = least_fp").select(F.col("component_id").alias("id"), F.col("fp").alias("kept"))
    kept = rows.join(stay, (F.col("fp") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return uncarried(kept.dropDuplicates(["doc_id", "fp"]), docs)
