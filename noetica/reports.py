"""Small results as Markdown tables, written in the driver from rows that a limit already bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row

Cell = Callable[[Row], object]


def _cell(value: object) -> str:
    if value is None:
        return ""
    text = value.isoformat(sep=" ", timespec="minutes") if hasattr(value, "isoformat") else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def table(rows: Iterable[Row], **columns: Cell) -> str:
    """A Markdown table with a column for each function of a row."""
    lines = [columns, ["---"] * len(columns), *([_cell(f(r)) for f in columns.values()] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def _either(*names: str) -> Cell:
    """The first of the named fields that a row has, so that names of entities come before their ids."""
    return lambda r: next((r[n] for n in names if n in r and r[n] is not None), None)


def _fields(df: DataFrame, *order: str) -> list[Row]:
    return df.orderBy(*order).collect()


def search_report(hits: DataFrame, query: str) -> str:
    """The facts that a search found, a row for each."""
    rows = _fields(hits, "rank")
    facts = table(rows, place=_either("rank"), subject=_either("source_name", "source_uuid"), fact=_either("fact", "name"), object=_either("target_name", "target_uuid"), holds_from=_either("valid_at"), holds_until=_either("invalid_at"))
    return f"{len(rows)} facts about “{query}”\n\n{facts}" if rows else f"Nothing is known about “{query}”."


def history_report(split: DataFrame, query: str) -> str:
    """What held and what holds, in one table."""
    rows = _fields(split, "bucket", "rank")
    states = table(rows, state=_either("bucket"), fact=_either("fact"), holds_from=_either("valid_at"), holds_until=_either("invalid_at"))
    return f"History of “{query}”\n\n{states}" if rows else f"“{query}” has no history."


def stats_report(stats: DataFrame) -> str:
    """A row for each count of the graph, orphans with their share."""
    r = stats.first()
    share = r.orphan_count / r.entity_count if r.entity_count else 0.0
    counts = [Row(what=name.removesuffix("_count"), n=f"{n:,}", share=f"{share:.1%}" if name == "orphan_count" else None) for name, n in r.asDict().items()]
    return table(counts, kind=_either("what"), count=_either("n"), share=_either("share"))


def evaluation_report(answers: DataFrame, axes: tuple[str, ...] = ("accuracy", "non-obviousness", "usefulness", "sourcing")) -> str:
    """Questions (id, dimension, question, answer) with an empty column of marks from 1 to 5 for each axis of the rubric."""
    blank = {axis.replace("-", "_"): (lambda r: "") for axis in axes}
    return table(_fields(answers, "id"), id=_either("id"), dimension=_either("dimension"), question=_either("question"), answer=_either("answer"), **blank)
