"""Heading fragments: the phrases by which a section can be recognised."""

from __future__ import annotations

from pyspark.sql import Column

from curricle import fixed_values as fv
from curricle.functions.exprs import (
    ColumnLike,
    apply,
    each,
    found,
    fresh,
    keep,
    let,
    one_of,
    replaced,
    sql_text,
)
from curricle.functions.tokens import tokens_rule


def normal_rule(x: str) -> str:
    return f"trim({replaced(x, fv.WHITESPACE, ' ')})"


def clean_rule(x: str) -> str:
    text = replaced(normal_rule(x), fv.LECTURE_TOTAL, " ")
    text = replaced(text, fv.FRAGMENT_PREFIX)
    return normal_rule(f"trim(BOTH {sql_text(fv.FRAGMENT_EDGE)} FROM {text})")


def key_rule(x: str, mode: str) -> str:
    """Significant tokens of a fragment, or an empty string."""

    def singular(t: str) -> str:
        cases = " ".join(
            f"WHEN {sql_text(many)} THEN {sql_text(one)}" for many, one in fv.SINGULAR_FORMS.items()
        )
        return f"CASE {t} {cases} ELSE {t} END"

    digits = r"^\p{Nd}+$"
    words = each(keep(tokens_rule(clean_rule(x)), lambda t: f"NOT {found(t, digits)}"), singular)
    kept = keep(words, lambda t: f"NOT {one_of(t, fv.STRUCTURAL_WORDS[mode])}")
    low = fresh("low")
    return let(
        kept,
        lambda ts: f"if(forall({ts}, {low} -> {one_of(low, fv.LOW_SIGNAL_WORDS[mode])}), '', "
        f"array_join({ts}, ' '))",
    )


def terms_rule(x: str, mode: str) -> str:
    """Distinct keys of a heading, its parts, and their acronym and plural forms."""

    def variants(candidate: str) -> str:
        suffix = sql_text(fv.ACRONYM_SUFFIX)
        pieces = (
            f"array({candidate}, regexp_extract({candidate}, {suffix}, 1), "
            f"regexp_extract({candidate}, {suffix}, 2))"
        )

        def with_keys(keys: str) -> str:
            forms = keys
            if mode == "speech":
                words = f"split({keys}[0], ' ')"
                plural = (
                    f"if(size({words}) >= 2 AND {one_of(f'element_at({words}, -1)', fv.PLURAL_READY)}, "
                    f"concat({keys}[0], 's'), '')"
                )
                forms = f"concat({keys}, array({plural}))"
            kept = keep(forms, lambda f: f"{f} <> ''")
            return f"named_struct('key', {keys}[0], 'forms', {kept})"

        return let(each(pieces, lambda p: key_rule(p, mode)), with_keys)

    def collect(cleaned: str) -> str:
        parts = keep(f"split({cleaned}, {sql_text(fv.FRAGMENT_BREAK)})", lambda p: f"{p} <> ''")
        keyed = each(f"concat(array({cleaned}), {parts})", variants)
        return (
            f"aggregate({keyed}, cast(array() AS array<string>), (seen, k) -> "
            "if(k.key = '' OR array_contains(seen, k.key), seen, array_union(seen, k.forms)))"
        )

    return f"if({x} IS NULL, cast(array() AS array<string>), {let(clean_rule(x), collect)})"


def distinct_rule(terms: str) -> str:
    """Normalised, non-empty, case-insensitively distinct terms; first one wins."""
    return (
        f"aggregate({each(terms, normal_rule)}, cast(array() AS array<string>), (seen, term) -> "
        "if(term = '' OR exists(seen, s -> lower(s) = lower(term)), seen, concat(seen, array(term))))"
    )


def clean_fragment(c: ColumnLike) -> Column:
    return apply(c, clean_rule)


def fragment_key(c: ColumnLike, mode: str) -> Column:
    return apply(c, lambda x: key_rule(x, mode))


def fragment_terms(c: ColumnLike, mode: str) -> Column:
    return apply(c, lambda x: terms_rule(x, mode))


def distinct_terms(terms: ColumnLike) -> Column:
    return apply(terms, distinct_rule)

