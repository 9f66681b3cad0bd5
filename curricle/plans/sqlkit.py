"""SQL text shared by the comparison queries (DuckDB dialect)."""

from __future__ import annotations

import re

from curricle import fixed_values as fv


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(fv.WHITESPACE)}, ' ', 'g'))"


def pieces(x: str) -> str:
    return (
        f"regexp_extract_all(lower(regexp_replace({x}, {q(fv.HYPHEN_DIGIT)}, '\\1\\2', 'g')), "
        f"{q(fv.TOKEN_PATTERN)})"
    )


def tok(x: str, stop=fv.STOP_WORDS) -> str:
    return (
        f"list_filter({pieces(x)}, lambda tk: length(tk) > 1 AND NOT list_contains({str_list(stop)}, tk))"
    )


def ktok(x: str) -> str:
    stop = [*fv.STOP_WORDS, *fv.KEYWORD_STOP_WORDS]
    return (
        f"list_filter({pieces(x)}, lambda tk: length(tk) > 1 AND NOT list_contains({str_list(stop)}, tk) "
        f"AND regexp_matches(tk, '\\p{{L}}'))"
    )


def ntok(x: str) -> str:
    return f"greatest(1, len({tok(x)}))"


def slug(x: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), {q(fv.SLUG_BREAK)}, '-', 'g'), '-'), ''), "
        "'section')"
    )


def fold(sizes: str, budget: int, overlap: int = 0) -> str:
    """1-based indexes at which greedy packing begins a new group."""
    full = f"(acc.cur >= 0 AND acc.cur + x.n > {budget})"
    carried = f"coalesce(list_sum({sizes}[greatest(1, si - {overlap}):si - 1]), 0)::BIGINT" if overlap else "0::BIGINT"
    return (
        f"list_reduce(list_transform({sizes}, lambda sz, si: "
        f"{{'i': si, 'n': sz::BIGINT, 'c': {carried}, 'cur': -1::BIGINT, 'st': []::BIGINT[]}}), lambda acc, x: "
        "{'i': x.i, 'n': x.n, 'c': x.c, "
        f"'cur': CASE WHEN {full} THEN x.c + x.n WHEN acc.cur < 0 THEN x.n ELSE acc.cur + x.n END, "
        f"'st': CASE WHEN acc.cur < 0 OR {full} THEN list_append(acc.st, x.i) ELSE acc.st END}}, "
        "{'i': 0::BIGINT, 'n': 0::BIGINT, 'c': 0::BIGINT, 'cur': -1::BIGINT, 'st': []::BIGINT[]}).st"
    )


def sentences(x: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({x}, '({fv.SENTENCE_MARK})\\s+', '\\1' || chr(1), 'g'), "
        "chr(1)), lambda sx: sx <> '')"
    )


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def hits(x: str, needles) -> str:
    return "(" + " + ".join(f"contains({x}, {q(n)})::INT" for n in needles) + ")"


def is_noise(x: str) -> str:
    question = f"regexp_matches({x}, {q(fv.QUESTION_MARK)})"
    answer = f"regexp_matches({x}, {q(fv.ANSWER_MARK)})"
    gap = f"regexp_matches({x}, {q(fv.BLANK_LINE_MARK)})"
    sheet = contains_any(f"lower({x})", fv.WORKSHEET_PHRASES)
    return f"({sheet} OR ({question} AND ({answer} OR {gap})) OR ({gap} AND {answer}))"


def clean_fragment(x: str) -> str:
    step = f"regexp_replace({norm(x)}, {q(fv.LECTURE_TOTAL)}, ' ', 'g')"
    step = f"regexp_replace({step}, {q(fv.FRAGMENT_PREFIX)}, '')"
    return norm(f"trim({step}, {q(fv.FRAGMENT_EDGE)})")


def fragment_key(x: str, mode: str) -> str:
    singular = " ".join(f"WHEN tk = {q(a)} THEN {q(b)}" for a, b in fv.SINGULAR_FORMS.items())
    kept = (
        f"list_filter(list_transform(list_filter({tok(clean_fragment(x))}, "
        "lambda tk: NOT regexp_matches(tk, '^\\p{Nd}+$')), "
        f"lambda tk: CASE {singular} ELSE tk END), "
        f"lambda tk: NOT list_contains({str_list(fv.STRUCTURAL_WORDS[mode])}, tk))"
    )
    low = str_list(fv.LOW_SIGNAL_WORDS[mode])
    return (
        f"CASE WHEN len(list_filter({kept}, lambda tk: NOT list_contains({low}, tk))) = 0 THEN '' "
        f"ELSE array_to_string({kept}, ' ') END"
    )


def fragment_rows(source: str, key: str, text: str, mode: str, name: str) -> str:
    """CTEs ``name`` (key, ord, term): fragment terms of every row of ``source``.

    A candidate whose key was already listed, by an earlier key or by a variant
    of an earlier key, adds nothing.
    """
    plural = (
        f"CASE WHEN contains(k, ' ') AND list_contains({str_list(fv.PLURAL_READY)}, "
        "string_split(k, ' ')[-1]) THEN k || 's' ELSE '' END"
        if mode == "speech"
        else "''"
    )
    return f"""
{name}_cand AS (
  SELECT {key}, unnest(range(len(c))) AS ci, unnest(c) AS cand FROM (
    SELECT {key}, list_concat([cl], list_filter(string_split(regexp_replace(cl, {q(fv.FRAGMENT_BREAK)}, chr(1), 'g'), chr(1)), lambda px: px <> '')) AS c
    FROM (SELECT {key}, {clean_fragment(text)} AS cl FROM {source}))),
{name}_key AS (
  SELECT {key}, ci, {fragment_key('cand', mode)} AS k,
    {fragment_key(f"regexp_extract(cand, {q(fv.ACRONYM_SUFFIX)}, 1)", mode)} AS lemma,
    {fragment_key(f"regexp_extract(cand, {q(fv.ACRONYM_SUFFIX)}, 2)", mode)} AS acr
  FROM {name}_cand),
{name}_forms AS (
  SELECT {key}, list({{'k': k, 'f': list_filter([k, lemma, acr, {plural}], lambda fx: fx <> ''), 'seen': []::VARCHAR[]}} ORDER BY ci) AS forms
  FROM {name}_key GROUP BY {key}),
{name}_list AS (
  SELECT {key}, list_reduce(forms, lambda acc, x: {{'k': x.k, 'f': x.f, 'seen':
      CASE WHEN x.k = '' OR list_contains(acc.seen, x.k) THEN acc.seen
           ELSE list_concat(acc.seen, list_filter(x.f, lambda fy, fi: NOT list_contains(acc.seen, fy) AND list_position(x.f, fy) = fi)) END}},
      {{'k': '', 'f': []::VARCHAR[], 'seen': []::VARCHAR[]}}).seen AS terms
  FROM {name}_forms),
{name} AS (SELECT {key}, unnest(range(len(terms))) AS ord, unnest(terms) AS term FROM {name}_list)"""


class Ctes:
    """Named CTEs with dependencies, written out in order of need."""

    def __init__(self) -> None:
        self._parts: dict[str, tuple[tuple[str, ...], str]] = {}

    def add(self, name: str, sql: str, *needs: str) -> None:
        self._parts[name] = (needs, sql.strip())

    def variant(self, name: str, suffix: str, renamed: dict[str, str], *needs: str) -> None:
        """The part again under other names: its own CTEs get the suffix."""
        sql = self._parts[name][1]
        own = re.findall(r"(?:^|[,\n(])\s*(\w+) AS \(", sql)
        for old, new in {**{n: n + suffix for n in own}, **renamed}.items():
            sql = re.sub(rf"(?<![\w.]){re.escape(old)}(?![\w.])(?!\()", new, sql)
        self._parts[name + suffix] = (needs, sql)

    def query(self, select: str, *needs: str) -> str:
        done: list[str] = []

        def visit(name: str) -> None:
            if name in done:
                return
            for need in self._parts[name][0]:
                visit(need)
            done.append(name)

        for need in needs:
            visit(need)
        if not done:
            return select
        return "WITH " + ",\n".join(self._parts[n][1] for n in done) + "\n" + select
