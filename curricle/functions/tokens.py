"""Tokenizers and term counts as native expressions.

The default tokenizer splits on everything that is neither letter nor digit.  A
morphological analyser can be plugged in through ``functions.plugins`` wherever
a ``tokenizer`` argument is offered.  Names ending in ``_rule`` are SQL texts for
use inside other rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import (
    ColumnLike,
    apply,
    found,
    keep,
    let,
    one_of,
    replaced,
    sql_text,
)

Tokenizer = Callable[[ColumnLike], Column]


def pieces_rule(x: str) -> str:
    joined = replaced(x, fv.HYPHEN_DIGIT, "$1$2")
    return f"regexp_extract_all(lower({joined}), {sql_text(fv.TOKEN_PATTERN)}, 0)"


def tokens_rule(x: str, stop_words: Iterable[str] = fv.STOP_WORDS) -> str:
    return keep(
        pieces_rule(x), lambda t: f"length({t}) > 1 AND NOT {one_of(t, stop_words)}", "t"
    )


def keywords_rule(x: str, stop_words: Iterable[str]) -> str:
    letters = r"\p{L}"
    return keep(
        pieces_rule(x),
        lambda t: f"length({t}) > 1 AND NOT {one_of(t, stop_words)} AND {found(t, letters)}",
        "t",
    )


def total_rule(x: str) -> str:
    return f"size({tokens_rule(x)})"


def tokenize(c: ColumnLike, stop_words: Iterable[str] = fv.STOP_WORDS) -> Column:
    stop = tuple(stop_words)
    return apply(c, lambda x: tokens_rule(x, stop))


def tokenize_keywords(
    c: ColumnLike,
    stop_words: Iterable[str] = fv.STOP_WORDS,
    extra: Iterable[str] = fv.KEYWORD_STOP_WORDS,
) -> Column:
    stop = (*stop_words, *extra)
    return apply(c, lambda x: keywords_rule(x, stop))


def count_tokens(c: ColumnLike, tokenizer: Tokenizer = tokenize) -> Column:
    return F.greatest(F.lit(1), F.size(tokenizer(c)))


def term_counts_rule(tokens: str) -> str:
    """``array<struct<term, n>>`` of one token array, without leaving the row.

    Sorting puts equal terms next to each other; a run starts where a term
    differs from its predecessor and ends where the next run starts.
    """

    def runs(ordered: str) -> str:
        starts = (
            f"filter(transform({ordered}, (t_, i_) -> named_struct('term', t_, 'pos', i_)), "
            f"p_ -> p_.pos = 0 OR get({ordered}, p_.pos - 1) <> p_.term)"
        )
        return let(
            starts,
            lambda st: f"transform({st}, (p_, j_) -> named_struct('term', p_.term, "
            f"'n', coalesce(get({st}, j_ + 1).pos, size({ordered})) - p_.pos))",
            "st",
        )

    return let(f"sort_array({tokens})", runs, "ord")


def term_counts(tokens: ColumnLike) -> Column:
    return apply(tokens, term_counts_rule)


def padded_rule(tokens: str) -> str:
    """Tokens in one padded string; makes phrase look-ups plain substring tests."""
    return f"concat(' ', array_join({tokens}, ' '), ' ')"


def phrase_count_rule(tokens: str, phrase: str, size: str) -> str:
    """Occurrences of a token phrase, overlaps included, on token boundaries."""
    last = f"(size({tokens}) - {size} + 1)"
    positions = f"if({last} >= 1, sequence(1, {last}), cast(array() AS array<int>))"
    hits = keep(positions, lambda i: f"array_join(slice({tokens}, {i}, {size}), ' ') = {phrase}")
    return f"size({hits})"
