"""Graph patterns over ``(g, s, p, o)`` quads as joins, left joins and filters; Catalyst orders and runs them.

A pattern is a tuple ``(subject, predicate, object)``, with the graph as a
fourth part if one is asked for.  A part that starts with ``?`` is a variable
and becomes a column of that name; all others are constants.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(quads: DataFrame, pattern: tuple[str, ...]) -> DataFrame:
    """One pattern: constants filter, variables become columns, a repeated variable must be equal."""
    seen: dict[str, str] = {}
    for column, term in zip("spog", pattern, strict=False):
        if not term.startswith("?"):
            quads = quads.where(F.col(column) == term)
        elif term in seen:
            quads = quads.where(F.col(seen[term]) == F.col(column))
        else:
            seen[term] = column
    return quads.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))


def solutions(quads: DataFrame, *patterns: tuple[str, ...]) -> DataFrame:
    """The natural join of all patterns; each must share a variable with those before it."""

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError(f"no variable of {right.columns} occurs before; order the patterns so that each meets another")
        return left.join(right, shared)

    return reduce(joined, (match(quads, p) for p in patterns))


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left outer join on the shared variables; those of ``right`` alone are null without a match."""
    return left.join(right, [c for c in right.columns if c in left.columns], "left")


def where_holds(df: DataFrame, quads: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """All rows if the constant triple exists, none otherwise."""
    found = match(quads, (s, p, o)).select(F.lit(1).alias("_found")).limit(1)
    return df.join(F.broadcast(found), F.lit(True), "left_semi")


def number(value: Column) -> Column:
    """The number that a whole text writes; null for other texts."""
    return F.when(value.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), value.try_cast("double"))


def compare(value: Column, sign: str, bound: float | str) -> Column:
    """``<``, ``>``, ``<=`` or ``>=``: numbers with numbers, texts with texts; else false."""
    n = number(value)
    left, fits = (n, n.isNotNull()) if isinstance(bound, (int, float)) else (value, n.isNull())
    right = F.lit(bound)
    held = {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[sign]
    return F.coalesce(fits & held, F.lit(False))


def page(df: DataFrame, *order: Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order; unbound values come first among ascending ones."""
    df = df.orderBy(*order).offset(offset)
    return df if limit is None else df.limit(limit)
