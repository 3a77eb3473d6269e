"""Text expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of sensitive notes, and cues of negation.
SENSITIVE = ("api key", "password", "secret", "credential", "token")
NEGATIONS = ("not", "wrong", "actually", "changed my mind", "i used to think")


def strip(text: Column) -> Column:
    """Without white space at both ends (trim() knows blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: str) -> list[str]:
    """What tokens() gives, for a query in the driver."""
    return re.findall(r"[^\W_]+", text.lower())


def is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE))


def is_negating(text: Column, cues: tuple[str, ...] = NEGATIONS) -> Column:
    return F.lower(text).rlike(rf"\b({'|'.join(cues)})\b")
