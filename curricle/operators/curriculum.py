"""Curriculum dimension: sections, weights, aliases, anchors, lexical index.

A course holds a bounded number of sections (eight by default), so windows per
course are small.  Everything derived from a section is computed in its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import (
    any_in,
    apply,
    col,
    each,
    keep,
    let,
    replaced,
    sql_text,
    sql_texts,
)
from curricle.functions.fragments import distinct_rule, normal_rule, terms_rule
from curricle.functions.text import (
    normalize_text,
    section_chapter_index,
    slugify,
    split_curriculum_line,
)
from curricle.functions.tokens import (
    Tokenizer,
    term_counts,
    tokenize,
    tokenize_keywords,
    tokens_rule,
)

Glossary = Mapping[str, Sequence[str]]
Triggers = Sequence[tuple[Sequence[str], str]]


def parse_curriculum(
    courses: DataFrame, max_sections: int = fv.MAX_SECTIONS
) -> tuple[DataFrame, DataFrame]:
    """Pasted curriculum text (``course_id, text``) → sections and rejected courses."""
    lines = courses.select(
        "course_id",
        F.filter(
            F.transform(F.split("text", r"\r\n|\n|\r"), normalize_text), lambda x: x != ""
        ).alias("lines"),
    ).withColumn("line_count", F.size("lines"))
    valid = F.col("line_count").between(2, max_sections)
    rejected = lines.filter(~valid).select(
        "course_id",
        "line_count",
        F.when(F.col("line_count") < 2, "at least two sections are needed")
        .otherwise(F.lit(f"more than {max_sections} sections"))
        .alias("error"),
    )
    parsed = (
        lines.filter(valid)
        .select("course_id", F.posexplode("lines").alias("section_ord", "line"))
        .withColumn("parts", split_curriculum_line("line"))
        .select(
            "course_id",
            (F.col("section_ord") + 1).alias("section_ord"),
            F.col("parts.title").alias("title"),
            F.col("parts.description").alias("description"),
            F.lit(0.0).alias("target_weight"),
        )
    )
    numbered = unique_slugs(parsed, lambda slug: F.concat(slug, F.lit("-"), col("section_ord").cast("string")))
    return normalize_weights(numbered), rejected


def unique_slugs(sections: DataFrame, on_collision) -> DataFrame:
    """``section_id`` from the title; a repeated slug in a course is renamed."""
    seen = Window.partitionBy("course_id", "_slug").orderBy("section_ord")
    return (
        sections.withColumn("_slug", slugify("title"))
        .withColumn("_copy", F.row_number().over(seen))
        .withColumn(
            "section_id",
            F.when(F.col("_copy") == 1, F.col("_slug")).otherwise(on_collision(F.col("_slug"))),
        )
        .drop("_slug", "_copy")
    )


def normalize_weights(sections: DataFrame, keys: tuple[str, ...] = ("course_id",)) -> DataFrame:
    """Weights in percent with two decimals; the last section takes the remainder."""
    course = Window.partitionBy(*keys)
    from_end = Window.partitionBy(*keys).orderBy(F.col("section_ord").desc())
    weight = F.greatest(F.lit(0.0), F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)))
    return (
        sections.withColumn("_w", weight)
        .withColumn("_total", F.sum("_w").over(course))
        .withColumn("_n", F.count("*").over(course))
        .withColumn(
            "_share",
            F.when(F.col("_total") > 0, F.round(F.col("_w") / F.col("_total") * 100, 2)).otherwise(
                F.round(F.lit(100.0) / F.col("_n"), 2)
            ),
        )
        .withColumn("_sum", F.sum("_share").over(course))
        .withColumn("_last", F.row_number().over(from_end) == 1)
        .withColumn(
            "target_weight",
            F.when(
                F.col("_last"), F.round(F.col("_share") + (F.lit(100.0) - F.col("_sum")), 2)
            ).otherwise(F.col("_share")),
        )
        .drop("_w", "_total", "_n", "_share", "_sum", "_last")
    )


def validate_sections(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edited section rows → valid sections, and one error row per bad course."""
    rows = raw.select(
        "course_id",
        "section_ord",
        normalize_text("title").alias("title"),
        normalize_text(F.coalesce("description", F.lit(""))).alias("description"),
        F.nullif(F.trim(F.col("target_weight").cast("string")), F.lit("")).alias("_text"),
    ).filter(F.coalesce("title", F.lit("")) != "")
    rows = rows.withColumn("target_weight", F.col("_text").try_cast("double")).withColumn(
        "description", F.coalesce(F.nullif("description", F.lit("")), F.col("title"))
    )
    issue = F.when(F.col("_text").isNull(), F.lit("a weight is missing")).when(
        F.coalesce(F.col("target_weight"), F.lit(-1.0)) <= 0, F.lit("a weight is not positive")
    )
    errors = (
        rows.withColumn("error", issue)
        .filter(F.col("error").isNotNull())
        .groupBy("course_id")
        .agg(F.min_by("error", "section_ord").alias("error"))
    )
    good = rows.drop("_text").join(errors.select("course_id"), "course_id", "left_anti")
    named = unique_slugs(good, lambda slug: F.concat(F.lit("section-"), col("section_ord").cast("string")))
    return normalize_weights(named), errors


# --- aliases and anchors -----------------------------------------------------
def _slug_rule(x: str) -> str:
    dashed = replaced(f"lower(trim({x}))", fv.SLUG_BREAK, "-")
    return f"coalesce(nullif(trim(BOTH '-' FROM {dashed}), ''), 'section')"


def _glossary_rule(glossary: Glossary, triggers: Triggers) -> str:
    """Terms of the glossary entries that a section's slugs or words select."""
    description = "coalesce(description, '')"
    both = f"concat_ws(' ', title, {description})"
    keys = (
        f"array(lower(trim(section_id)), {_slug_rule('title')}, {_slug_rule(description)}, "
        f"{_slug_rule(both)})"
    )
    none = "cast(array() AS array<string>)"

    def chosen(ks: str) -> str:
        by_key = [
            f"if(array_contains({ks}, {sql_text(key)}), {sql_texts(list(terms))}, {none})"
            for key, terms in glossary.items()
        ]
        by_trigger = [
            f"if({any_in(f'lower({normal_rule(both)})', needles)}, "
            f"{sql_texts(list(glossary[key]))}, {none})"
            for needles, key in triggers
            if key in glossary
        ]
        return f"concat({', '.join([none, *by_key, *by_trigger])})"

    return let(keys, chosen)


def section_aliases(
    sections: DataFrame,
    glossary: Glossary = fv.SECTION_ALIASES,
    triggers: Triggers = fv.TOPIC_TRIGGERS,
) -> DataFrame:
    """``aliases``: glossary terms of a section by its slugs and by trigger words."""
    return sections.withColumn("aliases", F.expr(distinct_rule(_glossary_rule(glossary, triggers))))


def material_anchors(sections: DataFrame) -> DataFrame:
    """``material_anchors``: fragment terms of title, description and aliases."""
    headings = "concat(array(title, coalesce(description, '')), aliases)"
    terms = each(headings, lambda h: terms_rule(h, "material"))
    return sections.withColumn("material_anchors", F.expr(f"array_distinct(flatten({terms}))"))


def speech_anchors(
    sections: DataFrame,
    glossary: Glossary = fv.SPEECH_ANCHORS,
    triggers: Triggers = fv.TOPIC_TRIGGERS,
) -> DataFrame:
    """``speech_anchors`` and ``title_fragments``, used by the speech rules."""
    own = each("array(title, coalesce(description, ''))", lambda h: terms_rule(h, "speech"))
    anchors = distinct_rule(f"concat(flatten(_own), {_glossary_rule(glossary, triggers)})")
    return (
        sections.withColumn("_own", F.expr(own))
        .withColumn("speech_anchors", F.expr(anchors))
        .withColumn("title_fragments", F.expr("_own[0]"))
        .drop("_own")
    )


def assignment_text(sections: DataFrame) -> DataFrame:
    """``assignment_text``: distinct lines of title, description and anchors."""
    lines = distinct_rule("concat(array(title, coalesce(description, '')), material_anchors)")
    return sections.withColumn("assignment_text", F.expr(f"array_join({lines}, '\n')"))


def describe_sections(
    sections: DataFrame,
    aliases: Glossary = fv.SECTION_ALIASES,
    anchors: Glossary = fv.SPEECH_ANCHORS,
    triggers: Triggers = fv.TOPIC_TRIGGERS,
) -> DataFrame:
    """Sections with aliases, both anchor sets and the assignment text."""
    described = material_anchors(section_aliases(sections, aliases, triggers))
    return assignment_text(speech_anchors(described, anchors, triggers))


def lexical_index(
    described: DataFrame, tokenizer: Tokenizer = tokenize
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts, norms and title tokens of the assignment texts, in long form."""
    base = described.select(
        "course_id", "section_ord", "section_id", "title",
        term_counts(tokenizer("assignment_text")).alias("terms"),
    )
    tf = base.select("course_id", "section_ord", "section_id", F.inline("terms"))
    norms = base.select("course_id", "section_ord", "section_id", _norm(F.col("terms")).alias("norm"))
    titles = base.select(
        "course_id", "section_ord", "section_id",
        F.explode(F.array_distinct(tokenizer("title"))).alias("term"),
    )
    return tf, norms, titles


def _norm(terms: Column) -> Column:
    return F.sqrt(apply(terms, lambda ts: f"aggregate({ts}, 0L, (a_, t_) -> a_ + bigint(t_.n) * t_.n)"))


def _phrases_rule(anchors: str) -> str:
    """Anchors as token phrases; anchors without tokens can never match."""
    phrases = each(
        anchors,
        lambda a: let(
            tokens_rule(a),
            lambda ts: f"named_struct('anchor', {a}, 'phrase', array_join({ts}, ' '), 'size', size({ts}))",
        ),
    )
    return keep(phrases, lambda p: f"{p}.size > 0")


def course_profiles(described: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """One row per course: everything the matching rules need, as nested arrays.

    ``vocab`` is the distinct vocabulary of all sections of the course; ``secs``
    holds the sections in order.  The row is small because a course holds only a
    few sections, and it is joined to chunks by ``course_id`` alone.
    """
    enriched = (
        described.withColumn("terms", term_counts(tokenizer("assignment_text")))
        .withColumn("title_terms", F.array_distinct(tokenizer("title")))
        .withColumn("norm", _norm(F.col("terms")))
        .withColumn("words", F.col("terms.term"))
        .withColumn("counts", F.col("terms.n"))
        .withColumn("material", F.expr(_phrases_rule("material_anchors")))
        .withColumn("speech", F.expr(_phrases_rule("speech_anchors")))
        .withColumn("chapter", section_chapter_index("title"))
        .withColumn("ord", F.col("section_ord").cast("int"))
        .withColumn("target_weight", F.col("target_weight").cast("double"))
    )
    section = F.struct(
        "ord", "section_id", "title", "target_weight", "words", "counts", "norm", "title_terms",
        "material", "speech", "title_fragments", "speech_anchors", "chapter",
    )
    vocab = "array_distinct(flatten(transform(secs, s -> concat(s.words, s.title_terms))))"
    return (
        enriched.groupBy("course_id")
        .agg(F.sort_array(F.collect_list(section)).alias("secs"))
        .withColumn("vocab", F.expr(vocab))
    )


def curriculum_vocab(sections: DataFrame) -> DataFrame:
    """Distinct keyword tokens of titles and descriptions per course."""
    both = F.concat_ws("\n", "title", "description")
    return sections.select("course_id", F.explode(tokenize_keywords(both)).alias("term")).distinct()


def dictionary_terms(described: DataFrame) -> DataFrame:
    """Words of titles, aliases and anchors for a tokenizer's user dictionary."""
    cleaned = each(
        "concat(array(title), aliases, material_anchors)",
        lambda p: f"split(trim({replaced(p, fv.DICTIONARY_BREAK, ' ')}), ' +')",
    )
    return (
        described.select("course_id", F.explode(F.expr(f"flatten({cleaned})")).alias("word"))
        .filter(F.length("word") >= 2)
        .select("course_id", F.lower("word").alias("term"))
        .distinct()
    )


def with_course(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach the course profile to each row; a course without one has no sections."""
    empty = {name: F.array().cast(profiles.schema[name].dataType) for name in ("secs", "vocab")}
    filled = {name: F.coalesce(name, value) for name, value in empty.items()}
    return rows.join(profiles, "course_id", "left").withColumns(filled)
