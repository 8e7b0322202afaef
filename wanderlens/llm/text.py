"""Words and shared expressions of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than blank and the five ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random order of keys that every engine with MD5 reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def unit_of(order: Column) -> Column:
    """The first seven hex digits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(order, 1, 7), 16, 10).cast("double") / float(16**7)


def first_rows(rows: DataFrame, eligible: DataFrame, order: str, text: str, n: int) -> DataFrame:
    """At most ``n`` of ``rows``: those whose ``order`` is first among the ``eligible``.

    Only orders are ranked; the chosen ones, at most ``n``, are sent to where the texts are read.
    """
    chosen = F.broadcast(eligible.select(order).orderBy(order).limit(n).distinct())
    return rows.join(chosen, order, "left_semi").orderBy(order, text).limit(n)


def unused(frame: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to differ from all columns of ``frame``."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
