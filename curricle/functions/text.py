"""Text rules as ``Column -> Column`` functions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import (
    ColumnLike,
    any_contained,
    capture,
    col,
    erase,
    trim_chars,
)
from curricle.functions.tokens import count_tokens, tokenize, tokenize_keywords

__all__ = [
    "count_tokens", "tokenize", "tokenize_keywords", "normalize_text", "normalize_lines",
    "fingerprint", "slugify", "strip_list_prefix", "split_curriculum_line", "snippet",
    "format_seconds", "clean_speech", "section_chapter_index", "source_chapter_index",
    "speech_title", "extract_week", "weight_metric", "week_metric", "lecture_metric",
    "strip_metrics", "trim_title", "split_heading", "parse_score", "is_numeric_like",
    "is_text_rich", "has_hint", "question_parts", "question_id", "is_free_text_header",
    "is_video_url", "is_playlist_url", "video_id", "canonical_url",
]


def _once(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_text(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(c), fv.WHITESPACE, " "))


def normalize_lines(c: ColumnLike) -> Column:
    """Normalise every line of a text and drop the blank ones."""
    lines = F.transform(F.split(col(c), r"\r\n|\n|\r"), normalize_text)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fingerprint(c: ColumnLike) -> Column:
    return F.sha1(F.lower(normalize_text(c)))


def slugify(c: ColumnLike) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(col(c))), fv.SLUG_BREAK, "-")
    return F.coalesce(F.nullif(trim_chars(dashed, "-"), F.lit("")), F.lit("section"))


def strip_list_prefix(c: ColumnLike) -> Column:
    return F.regexp_replace(col(c), fv.LIST_PREFIX, "")


def split_curriculum_line(c: ColumnLike) -> Column:
    """``struct<title, description>`` at the first separator that leaves a title."""
    line = strip_list_prefix(c)

    def at(text: Column, separator: str) -> tuple[Column, Column]:
        position = F.locate(separator, text)
        title = F.trim(F.substring(text, F.lit(1), position - 1))
        rest = F.trim(F.substring(text, position + len(separator), F.length(text)))
        return (position > 0) & (title != ""), F.struct(
            title.alias("title"),
            F.when(rest == "", title).otherwise(rest).alias("description"),
        )

    def choose(text: Column) -> Column:
        chain = None
        for separator in ("|", "::", " - ", ":"):
            usable, parts = at(text, separator)
            chain = F.when(usable, parts) if chain is None else chain.when(usable, parts)
        return chain.otherwise(F.struct(text.alias("title"), text.alias("description")))

    return _once(line, choose)


def snippet(c: ColumnLike, limit: int = fv.SNIPPET_LIMIT) -> Column:
    text = normalize_text(c)
    return F.when(
        F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    ).otherwise(text)


def format_seconds(c: ColumnLike) -> Column:
    total = col(c).cast("long")

    def two(x: Column) -> Column:
        text = F.floor(x).cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    minutes = two(F.floor(total % 3600 / 60))
    seconds = two(total % 60)
    return F.when(
        total >= 3600, F.concat_ws(":", two(F.floor(total / 3600)), minutes, seconds)
    ).otherwise(F.concat_ws(":", minutes, seconds))


def clean_speech(c: ColumnLike) -> Column:
    return normalize_text(F.regexp_replace(normalize_text(c), fv.SOUND_MARKER, " "))


def section_chapter_index(c: ColumnLike) -> Column:
    return capture(normalize_text(c), fv.SECTION_CHAPTER, 1).try_cast("int")


def source_chapter_index(c: ColumnLike) -> Column:
    return capture(normalize_text(c), fv.SOURCE_CHAPTER, 1).try_cast("int")


def speech_title(c: ColumnLike) -> Column:
    def pick(label: Column) -> Column:
        bracketed = F.nullif(
            F.trim(F.regexp_extract(label, fv.BRACKETED_TITLE, 1)), F.lit("")
        )
        return F.when(F.regexp_like(label, F.lit(fv.GENERIC_VIDEO_LABEL)), F.lit("")).otherwise(
            F.coalesce(bracketed, label)
        )

    return _once(normalize_text(c), pick)


def extract_week(c: ColumnLike) -> Column:
    return F.regexp_extract(col(c), fv.WEEK_MENTION, 1)


def _chapter_block_text(c: ColumnLike) -> Column:
    joined = F.replace(normalize_text(c), F.lit("주 차"), F.lit("주차"))
    joined = erase(joined, fv.SPLIT_WEEK, "$1차")
    return erase(joined, fv.LOOSE_WEEK_END)


chapter_block_text = _chapter_block_text


def lecture_metric(c: ColumnLike) -> Column:
    return capture(col(c), fv.LECTURES, 1).try_cast("double")


def week_metric(c: ColumnLike) -> Column:
    def pick(text: Column) -> Column:
        first = capture(text, fv.WEEK_RANGE, 1).try_cast("int")
        last = capture(text, fv.WEEK_RANGE, 2).try_cast("int")
        single = capture(text, fv.WEEKS, 1).try_cast("double")
        return F.when(last >= first, (last - first + 1).cast("double")).otherwise(single)

    return _once(_chapter_block_text(c), pick)


def weight_metric(c: ColumnLike) -> Column:
    """``struct<value, source>``: the first kind of weight that the line states."""
    text = col(c)
    kinds = [
        ("percent", capture(text, fv.PERCENT, 1).try_cast("double")),
        ("lecture_count", lecture_metric(text)),
        ("weeks", week_metric(text)),
        ("hours", capture(text, fv.HOURS, 1).try_cast("double")),
        ("days", capture(text, fv.DAYS, 1).try_cast("double")),
    ]
    found = [
        F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(kind).alias("source")))
        for kind, value in kinds
    ]
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit("none").alias("source"))
    return F.coalesce(*found, none)


def strip_metrics(c: ColumnLike) -> Column:
    text = col(c)
    for pattern in (fv.PERCENT, fv.LECTURES, fv.HOURS, fv.WEEK_RANGE, fv.WEEKS, fv.DAYS):
        text = erase(text, pattern)
    return normalize_text(text)


def trim_title(c: ColumnLike) -> Column:
    def shorten(text: Column) -> Column:
        parts = F.filter(
            F.transform(F.split(text, fv.TITLE_BREAK), lambda part: F.trim(part)),
            lambda part: part != "",
        )
        return F.when(F.length(text) <= 40, text).otherwise(
            F.coalesce(F.get(parts, F.lit(0)), F.trim(F.substring(text, 1, 40)))
        )

    return _once(strip_metrics(c), shorten)


def split_heading(c: ColumnLike) -> Column:
    """``struct<title, description>``: Latin part and Hangul part of a heading."""

    def parts(text: Column) -> Column:
        latin = F.trim(F.regexp_extract(text, fv.HEADING_PARTS, 1))
        hangul = F.trim(F.regexp_extract(text, fv.HEADING_PARTS, 2))
        return F.struct(
            F.coalesce(F.nullif(latin, F.lit("")), text).alias("title"),
            F.coalesce(F.nullif(hangul, F.lit("")), text).alias("description"),
        )

    return _once(normalize_text(erase(col(c), r"\b차$")), parts)


def parse_score(c: ColumnLike) -> Column:
    """Rating between 1 and 5, or null."""
    bare = F.trim(F.regexp_replace(normalize_text(c), "점$", ""))
    number = F.when(F.regexp_like(bare, F.lit(fv.DECIMAL_NUMBER)), bare.try_cast("double"))
    return F.when(number.between(1.0, 5.0), number)


def is_numeric_like(c: ColumnLike) -> Column:
    return F.regexp_like(normalize_text(c), F.lit(fv.NUMERIC_LIKE))


def is_text_rich(c: ColumnLike) -> Column:
    text = normalize_text(c)
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z가-힣]", ""))
    return (text != "") & ~is_numeric_like(c) & ((letters >= 4) | (F.length(text) >= 8))


def value_facts(c: ColumnLike) -> Column:
    """``struct<blank, numeric_like, rich, score>`` by the rules above; the value is normalised once."""

    def facts(text: Column) -> Column:
        numeric = F.regexp_like(text, F.lit(fv.NUMERIC_LIKE))
        letters = F.length(F.regexp_replace(text, r"[^A-Za-z가-힣]", ""))
        bare = F.trim(F.regexp_replace(text, "점$", ""))
        number = F.when(F.regexp_like(bare, F.lit(fv.DECIMAL_NUMBER)), bare.try_cast("double"))
        return F.struct(
            (text == "").alias("blank"),
            numeric.alias("numeric_like"),
            # long texts need no count of their letters
            ((text != "") & ~numeric & ((F.length(text) >= 8) | (letters >= 4))).alias("rich"),
            F.when(number.between(1.0, 5.0), number).alias("score"),
        )

    return F.get(F.transform(F.array(normalize_text(c)), facts), F.lit(0))


def has_hint(c: ColumnLike, hints) -> Column:
    return any_contained(col(c), hints)


def question_id(c: ColumnLike) -> Column:
    """Last question id of a header, upper-cased; null when there is none."""
    ids = F.regexp_extract_all(col(c), F.lit("(?U)" + fv.QUESTION_ID), F.lit(1))
    return F.upper(F.get(ids, F.size(ids) - 1))


def question_parts(c: ColumnLike, leaf: ColumnLike | None = None) -> Column:
    """``struct<id, grp, label>``; the label is read from ``leaf`` when given."""
    text = normalize_text(c)
    preferred = text if leaf is None else F.coalesce(
        F.nullif(normalize_text(leaf), F.lit("")), text
    )

    def parts(qid: Column) -> Column:
        after = normalize_text(
            F.regexp_replace(
                preferred,
                F.concat(F.lit(r"(?iU)^.*?\b"), qid, F.lit(r"\b[\s.\-:)]*")),
                F.lit(""),
            )
        )
        return F.struct(
            qid.alias("id"),
            F.substring_index(qid, "-", 1).alias("grp"),
            F.coalesce(
                F.nullif(after, F.lit("")), F.nullif(preferred, F.lit("")), qid
            ).alias("label"),
        )

    return _once(question_id(text), parts)


def is_free_text_header(c: ColumnLike) -> Column:
    return any_contained(F.lower(col(c)), fv.FREE_TEXT_HINTS)


def _host(c: ColumnLike) -> Column:
    return F.lower(F.try_parse_url(F.trim(col(c)), F.lit("HOST")))


def _path(c: ColumnLike) -> Column:
    return F.coalesce(
        trim_chars(F.try_parse_url(F.trim(col(c)), F.lit("PATH")), "/"), F.lit("")
    )


def _query(c: ColumnLike, key: str) -> Column:
    value = F.try_parse_url(F.trim(col(c)), F.lit("QUERY"), F.lit(key))
    return F.nullif(F.trim(value), F.lit(""))


def is_video_url(c: ColumnLike) -> Column:
    return F.coalesce(_host(c).isin(*fv.VIDEO_HOSTS), F.lit(False))


def is_playlist_url(c: ColumnLike) -> Column:
    path = _path(c)
    single = _query(c, "v").isNotNull() | (_host(c) == "youtu.be")
    for prefix in fv.VIDEO_PATH_PREFIXES:
        single = single | F.startswith(path, F.lit(prefix))
    return (
        is_video_url(c)
        & ~F.coalesce(single, F.lit(False))
        & (path == "playlist")
        & _query(c, "list").isNotNull()
    )


def video_id(c: ColumnLike) -> Column:
    path = _path(c)
    short = F.when(_host(c) == "youtu.be", F.nullif(F.substring_index(path, "/", 1), F.lit("")))
    nested = F.nullif(F.regexp_extract(path, r"^(shorts|live|embed)/+([^/]+)", 2), F.lit(""))
    return F.coalesce(_query(c, "v"), short, nested)


def canonical_url(video: ColumnLike) -> Column:
    return F.concat(F.lit(fv.WATCH_URL), col(video))
