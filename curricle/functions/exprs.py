"""Small helpers to write column expressions.

Nested array rules are written as SQL text: the parser builds the whole tree in
one step, while assembling it from Python would cost a round trip per node.
``apply`` turns such a text rule into an ordinary ``Column -> Column`` function.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
Rule = Callable[[str], str]

_names = itertools.count()


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fresh(prefix: str = "v") -> str:
    """A lambda variable name that no other rule uses."""
    return f"{prefix}_{next(_names)}"


def sql_text(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_texts(values: Iterable[str]) -> str:
    values = list(values)
    return "array(" + ", ".join(map(sql_text, values)) + ")" if values else "cast(array() AS array<string>)"


def one_of(x: str, values: Iterable[str]) -> str:
    return f"{x} IN (" + ", ".join(map(sql_text, values)) + ")"


def let(value: str, body: Rule, prefix: str = "v") -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    name = fresh(prefix)
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(array: str, body: Rule, prefix: str = "x") -> str:
    name = fresh(prefix)
    return f"transform({array}, {name} -> {body(name)})"


def keep(array: str, test: Rule, prefix: str = "x") -> str:
    name = fresh(prefix)
    return f"filter({array}, {name} -> {test(name)})"


def at(array: str, position: str) -> str:
    """Element at a 0-based position, or null."""
    return f"get({array}, {position})"


def apply(c: ColumnLike, rule: Rule) -> Column:
    """The rule as a column; a computed argument is evaluated once."""
    if isinstance(c, str):
        return F.expr(rule(c))
    name = fresh()
    body = F.expr(f"{name} -> {rule(name)}")
    return F.get(F.call_function("transform", F.array(c), body), F.lit(0))


def replaced(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(by)})"


def found(x: str, pattern: str) -> str:
    return f"regexp_like({x}, {sql_text(pattern)})"


def any_in(x: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(n)})" for n in needles) + ")"


# --- the same helpers for columns ---------------------------------------------
def matches(c: Column, pattern: str) -> Column:
    """Search with Unicode classes, so that word boundaries see Hangul letters."""
    return F.regexp_like(c, F.lit("(?U)" + pattern))


def capture(c: Column, pattern: str, group: int) -> Column:
    """Captured group, or null when the pattern is absent."""
    return F.nullif(F.regexp_extract(c, "(?U)" + pattern, group), F.lit(""))


def erase(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, by)


def any_contained(c: ColumnLike, needles: Iterable[str]) -> Column:
    needles = list(needles)
    return apply(c, lambda x: any_in(x, needles)) if needles else F.lit(False)


def hits(c: ColumnLike, needles: Iterable[str]) -> Column:
    """How many of the needles occur in the text."""
    needles = list(needles)
    return apply(
        c, lambda x: "(" + " + ".join(f"int(contains({x}, {sql_text(n)}))" for n in needles) + ")"
    )


def trim_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))
