"""From raw sources to episodes: selection, caps, skipping what is there, roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noetica.functions.text import is_sensitive, strip

# Turns kept of a thread, least and most characters of a turn, most characters of a note, and of names.
MOST_TURNS, LEAST_TURN, TURN_CAP, NOTE_CAP, NAME_CAP, DESCRIPTION_CAP = 20, 20, 3000, 5000, 100, 80
# Fixed value: the time of a thread that has none.
DEFAULT_TIME = "2026-01-01T00:00:00Z"


def episode_id(*parts: str) -> F.Column:
    """A content hash: reruns make the same ids."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def from_turns(turns: DataFrame) -> DataFrame:
    """(saga, turn, role, content) to episodes: first the first turns of each saga, then those long enough; names keep gaps.

    Each has its thread's created_at; the default where it is null or the column is absent.
    """
    place = F.row_number().over(Window.partitionBy("saga").orderBy("turn"))
    told = F.col("created_at") if "created_at" in turns.columns else F.lit(None)
    kept = turns.withColumn("i", place).where(F.col("i") <= MOST_TURNS).where(F.length("content") >= LEAST_TURN)
    return kept.select(
        "saga",
        F.format_string("Turn %d (%s)", "i", "role").alias("name"),
        F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, TURN_CAP)).alias("body"),
        (F.col("i") - 1).alias("turn_index"),
        F.coalesce(told, F.lit(DEFAULT_TIME)).alias("created_at"),
    )


def from_notes(notes: DataFrame, cap: int = NOTE_CAP) -> DataFrame:
    """Notes whose name is not sensitive, bodies cut."""
    return notes.where(~is_sensitive(F.col("name"))).withColumn("body", F.substring("body", 1, cap))


def long_enough(notes: DataFrame, least: int = 50) -> DataFrame:
    return notes.where(F.length(strip(F.col("body"))) > least)


def not_imported(notes: DataFrame, imported: DataFrame, strict: bool = False) -> DataFrame:
    """Notes whose name is not among the imported descriptions, which hold DESCRIPTION_CAP characters of it.

    strict compares whole names, so that longer ones are imported again.
    """
    name = F.col("name") if strict else F.substring("name", 1, DESCRIPTION_CAP)
    return notes.withColumn("key", name).join(imported.select(F.substring("name", 1, DESCRIPTION_CAP).alias("key")), "key", "left_anti").drop("key")


def remaining(notes: DataFrame, older: DataFrame) -> DataFrame:
    return notes.join(older.select("name"), "name", "left_anti")


def resumed(df: DataFrame, key: str, skip: int, limit: int = 0) -> DataFrame:
    """From row `skip` on, by key; a limit of 0 is none."""
    out = df.orderBy(key).offset(skip)
    return out.limit(limit) if limit else out


def corpus_totals(notes: DataFrame, cap: int = NOTE_CAP) -> DataFrame:
    chars = F.length("body")
    capped = F.sum(F.least(chars, F.lit(cap)))
    return notes.agg(F.count("*").alias("n_notes"), F.sum(chars).alias("chars"), capped.alias("capped_chars"), F.floor(capped / 4).alias("tokens"))


def roles(turns: DataFrame) -> DataFrame:
    return turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("saga").alias("n_sagas"))


def thread_sources(sources: DataFrame, source: str, least: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Threads of a source with over `least` characters; rows with a null label go if labels are excluded."""
    kept = sources.where((F.col("source") == source) & (F.length("raw_content") > least))
    return kept.where(~F.col("label").isin(*excluded)) if excluded else kept


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with the episodes of new that it lacks, by uuid."""
    return existing.unionByName(new.dropDuplicates(["uuid"]).join(existing.select("uuid"), "uuid", "left_anti"))


def preview(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    return df.select(*[F.substring(c, 1, caps[c]).alias(c) if c in caps else F.col(c) for c in df.columns])


def point_lookup(sources: DataFrame, pattern: str) -> DataFrame:
    """The first source, by label, whose label matches a LIKE pattern in any case."""
    return sources.where(F.col("label").ilike(pattern)).orderBy("label").limit(1)


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of (name, content, reference_time as text): bad ones lack content or have a time that does not parse."""
    bad = (F.trim(F.coalesce("content", F.lit(""))) == "") | (F.col("reference_time").isNotNull() & F.try_to_timestamp("reference_time").isNull())
    good = rows.where(~bad).withColumn("name", F.substring("name", 1, NAME_CAP)).withColumn("reference_time", F.try_to_timestamp("reference_time"))
    return good.withColumn("uuid", episode_id("name", "content")), rows.where(bad)


def roll_up(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(status, reason, n) of an import: rows that went in, and those that failed by what is wrong with them."""
    reason = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "content").otherwise("time")
    rows = good.select(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select(F.lit("failed").alias("status"), reason.alias("reason")))
    return rows.groupBy("status", "reason").agg(F.count("*").alias("n"))


def in_saga_order(rows: DataFrame, start: Callable[[], object], step: Callable[[object, dict], object], made: str) -> DataFrame:
    """rows (saga, turn_index, ...) with (status, reason, made), each imported after those of its saga that come before it.

    step(state, row) gets what start() gave to the saga and what earlier steps have made of it, and gives the row's result, of the SQL type
    `made`. A step that raises fails its row only: status 'failed', with the error's text as the reason. roll_up_import() counts these.

    A saga's rows stream through one task in order; only the state is held, so a long saga costs time and not memory.
    """
    ordered = rows.repartition("saga").sortWithinPartitions("saga", "turn_index")
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        saga = state = None
        fresh = True
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False):
                row = dict(zip(names, values, strict=True))
                if fresh or row["saga"] != saga:
                    saga, state, fresh = row["saga"], start(), False
                try:
                    out.append(("ok", None, step(state, row)))
                except Exception as error:  # noqa: BLE001
                    out.append(("failed", str(error), None))
            told = pd.DataFrame(out, columns=["status", "reason", "made"], index=batch.index)
            yield pd.concat([batch, told.astype({"made": object})], axis=1)

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"status string, reason string, made {made}").fields])
    return ordered.mapInPandas(run, schema)


def roll_up_import(imported: DataFrame) -> DataFrame:
    """(status, reason, n) of in_saga_order()."""
    return imported.groupBy("status", "reason").agg(F.count("*").alias("n"))
