"""Note dumps: text with a start marker, NAME: and DATE: lines, a body, and an end marker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from noetica.functions.text import SENSITIVE, is_sensitive

# The format of a dump.
START, END, NAME, DATE = "===NOTE_START===", "===NOTE_END===", "NAME:", "DATE:"
LEAST_BODY = 50


def _sections(lines: Iterable[str]) -> Iterator[list[str]]:
    """What follows each start marker, up to the next one."""
    n = 0

    def section(line: str) -> int:
        nonlocal n
        n += line == START
        return n

    for number, section_lines in groupby((line.rstrip("\n") for line in lines), section):
        if number:
            yield list(islice(section_lines, 1, None))


def parse(lines: Iterable[str], cap: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(name, date, body) of each whole record: what lies between a start marker and an end marker without another start in between.

    Name and date are the first lines of their kind with a value; later ones belong to the body, empty ones before them to nothing.
    Short bodies and sensitive names are left out.
    """
    for section in _sections(lines):
        if END not in section:
            continue
        told = section[: section.index(END)]
        first = {f: next((i for i, line in enumerate(told) if line.startswith(f) and line != f), len(told)) for f in (NAME, DATE)}
        name, date = (told[i][len(f) :] if i < len(told) else "" for f, i in first.items())
        body = "\n".join(line for i, line in enumerate(told) if not any(line.startswith(f) and i <= at for f, at in first.items())).strip()
        if len(body) > LEAST_BODY and not any(s in name.lower() for s in SENSITIVE):
            yield name, date, body[:cap]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.cap = options["path"].split(","), int(options["cap"]) if "cap" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(partition.value, encoding="utf-8", errors="replace") as f:
                yield from parse(f, self.cap)
        except FileNotFoundError:
            return


class NoteDumps(DataSource):
    """spark.read.format("note_dump").load("a,b"): a partition per file, records in order; a missing file is empty."""

    @classmethod
    def name(cls) -> str:
        return "note_dump"

    def schema(self) -> str:
        return "name string, date string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _first_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a flag of those that begin a file: the first of a split that starts at 0."""
    last = None
    for batch in batches:
        places = list(zip(batch.column("file_path").to_pylist(), batch.column("file_block_start").to_pylist(), strict=True))
        changed = [a != b for a, b in zip(places, [last, *places[:-1]], strict=True)]
        last = places[-1] if places else last
        first = np.array(changed, bool) & (batch.column("file_block_start").to_numpy() == 0)
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(first)], ["chunk", "first"])


def _first_with(lines: Column, field: str) -> Column:
    """Place of the first line of a kind with a value, counted from 1; the number of lines if there is none."""
    place = F.array_position(F.transform(lines, lambda x: x.startswith(field) & (x != field)), True)
    return F.when(place > 0, place).otherwise(F.size(lines))


def _value(lines: Column, field: str, at: Column) -> Column:
    line = F.try_element_at(lines, at.cast("int"))
    return F.when(line.startswith(field), F.substring(line, len(field) + 1, 1 << 30)).otherwise("")


def read_files(spark: SparkSession, paths: str, cap: int | None = None) -> DataFrame:
    """Dumps in any store that Spark reads, as parse() gives them; a large file is split over tasks at its lines of start markers.

    Spark's reader splits at the markers, and array expressions cut each section at its end marker and pick its lines. Bytes that are
    no UTF-8 are replaced.
    """
    chunks = spark.read.option("lineSep", "\n" + START + "\n").text(paths).select(F.make_valid_utf8("value").alias("chunk"), "_metadata.file_path", "_metadata.file_block_start")
    rows = chunks.mapInArrow(_first_of_files, "chunk string, first boolean").select("first", F.split("chunk", "\n").alias("all"))
    # markers that the reader left are at the start: the first line of a file, or one right behind another
    rows = rows.withColumn("n", F.size(F.filter("all", lambda x: x == START))).where(~F.col("first") | (F.col("n") > 0))
    rows = rows.select(F.slice("all", F.col("n") + 1, F.size("all")).alias("lines")).withColumn("end", F.array_position("lines", END)).where("end > 0")
    rows = rows.select(F.slice("lines", 1, F.col("end").cast("int") - 1).alias("lines"))
    rows = rows.withColumns({"name_at": _first_with(F.col("lines"), NAME), "date_at": _first_with(F.col("lines"), DATE)})
    told = F.filter("lines", lambda x, i: ~((x.startswith(NAME) & (i < F.col("name_at"))) | (x.startswith(DATE) & (i < F.col("date_at")))))
    body = F.regexp_replace(F.array_join(told, "\n"), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    out = rows.select(_value(F.col("lines"), NAME, F.col("name_at")).alias("name"), _value(F.col("lines"), DATE, F.col("date_at")).alias("date"), body.alias("body"))
    out = out.where((F.length("body") > LEAST_BODY) & ~is_sensitive(F.col("name")))
    return out if cap is None else out.withColumn("body", F.substring("body", 1, cap))
