"""Chunks against sections.

A chunk meets its course profile through one equi-join on ``course_id``; all
scores, gates and rescue rules are then expressions over the few sections of
that row.  Assigning a chunk therefore needs no shuffle at all, and a course
that owns most chunks is spread like any other.  Only vectors, which are long, are
dealt to blocks and multiplied there as matrices.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import each, keep, let, one_of
from curricle.functions.fragments import fragment_terms
from curricle.functions.text import source_chapter_index, speech_title
from curricle.functions.tokens import (
    padded_rule,
    phrase_count_rule,
    term_counts_rule,
    tokenize,
)
from curricle.operators.curriculum import with_course

# the matrix products travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Thresholds = tuple[float, float]
CHUNK_KEYS = ("course_id", "source_id", "chunk_seq", "part_no")


def _chunk_keys(df: DataFrame) -> list[str]:
    return [c for c in CHUNK_KEYS if c in df.columns]


# --- scores ------------------------------------------------------------------
def _lexical_rule(tokens: str = "tokens", secs: str = "secs", vocab: str = "vocab") -> str:
    """``array<double>`` in section order: 3/4 cosine, 1/4 share of title terms.

    Only terms of the course vocabulary can contribute, so the chunk's counts are
    first cut down to those; most chunks share few of them.
    """

    def scores(counts: str) -> str:
        norm = f"sqrt(aggregate({counts}, 0L, (a_, t_) -> a_ + bigint(t_.n) * t_.n))"
        known = let(
            f"array_intersect({vocab}, {tokens})",
            lambda sh: f"filter({counts}, t_ -> array_contains({sh}, t_.term))",
        )

        def per_section(k: str) -> str:
            dot = (
                f"aggregate(array_intersect(s_.words, {k}.terms), 0L, (a_, w_) -> a_ + "
                "s_.counts[int(array_position(s_.words, w_)) - 1] * "
                f"{k}.ns[int(array_position({k}.terms, w_)) - 1])"
            )
            cosine = f"if({k}.norm > 0 AND s_.norm > 0, {dot} / ({k}.norm * s_.norm), 0D)"
            overlap = (
                f"size(array_intersect(s_.title_terms, {k}.terms)) / greatest(1, size(s_.title_terms))"
            )
            return (
                f"if(size({k}.terms) = 0, transform({secs}, s_ -> 0D), "
                f"transform({secs}, s_ -> {cosine} * 0.75D + {overlap} * 0.25D))"
            )

        facts = let(
            known, lambda kn: f"named_struct('norm', {norm}, 'terms', {kn}.term, 'ns', {kn}.n)"
        )
        return let(facts, per_section, "k")

    return let(term_counts_rule(tokens), scores, "counts")


def with_lexical_scores(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chunks with ``secs`` and the ``scores`` array of all sections."""
    return with_course(chunks, profiles).withColumn(
        "scores", F.expr(_lexical_rule())
    )


def _long_scores(scored: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """One row per chunk and section, which takes only names and score from the profile."""
    return scored.select(
        *keys,
        F.expr(
            f"inline_outer(zip_with(secs, {scores}, (s_, x_) -> "
            "named_struct('section_ord', s_.ord, 'section_id', s_.section_id, 'score', x_)))"
        ),
    )


def score_lexical(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Long form: one row per chunk and section."""
    return _long_scores(with_lexical_scores(chunks, profiles), _chunk_keys(chunks))


VECTOR_BLOCK = 1_024


def _unit_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of length one; null and zero vectors stay zero, short ones are filled up."""
    out = np.zeros((len(column), width))
    for i, vector in enumerate(column.to_numpy() if len(column) else ()):
        if vector is not None:
            out[i, : len(vector)] = vector
    out = np.nan_to_num(out)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0)


def _cosines(kept: list[str]):
    """A task function: a block of chunk vectors times the sections of its course."""

    def work(chunks: pa.Table, sections: pa.Table) -> pa.Table:
        sections = sections.sort_by([("section_ord", "ascending"), ("section_id", "ascending")])
        sizes = [t["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t in (chunks, sections)]
        width = int(np.nan_to_num(np.concatenate([*sizes, [0]]).astype(np.float64)).max())
        if len(sections) and len(chunks):
            product = _unit_rows(chunks["vector"], width) @ _unit_rows(sections["vector"], width).T
            flat = pa.array(np.maximum(product, 0.0).reshape(-1))
            ends = pa.array(np.arange(len(chunks) + 1) * len(sections), pa.int32())
            scores = pa.ListArray.from_arrays(ends, flat)
        else:
            scores = pa.nulls(len(chunks), pa.list_(pa.float64()))
        return pa.Table.from_arrays([*(chunks[c] for c in kept), scores], names=[*kept, "scores"])

    return work


def _scored_vectors(chunk_vectors: DataFrame, section_vectors: DataFrame) -> DataFrame:
    """Chunk columns and ``scores`` with all sections of the course, in section order.

    Chunks of a course are dealt to blocks of bounded size; a block meets the section
    vectors once and is multiplied as a matrix, so no norm is taken inside the pair loop
    and no vector is copied per pair.  Without sections ``scores`` is null.
    """
    kept = [c for c in chunk_vectors.columns if c != "vector"]
    counts = chunk_vectors.groupBy("course_id").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("_n"))
    number = F.pmod(F.xxhash64(*kept, "vector"), F.col("_n")).alias("_block")
    rows = chunk_vectors.join(counts, "course_id").select(*kept, "vector", number)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_block")
    sections = section_vectors.join(counts, "course_id").select(
        "course_id", blocks, "section_ord", "section_id", "vector"
    )
    schema = ", ".join(f"`{c}` {chunk_vectors.schema[c].dataType.simpleString()}" for c in kept)
    key = ["course_id", "_block"]
    return rows.groupBy(*key).cogroup(sections.groupBy(*key)).applyInArrow(
        _cosines(kept), f"{schema}, scores array<double>"
    )


def score_vectors(chunk_vectors: DataFrame, section_vectors: DataFrame) -> DataFrame:
    """Non-negative cosine of each chunk vector with the sections of its course.

    A zero vector scores 0 everywhere; a chunk of a course without sections gives one row
    without section and score.
    """
    scored = _scored_vectors(chunk_vectors, section_vectors)
    names = section_vectors.groupBy("course_id").agg(
        F.sort_array(F.collect_list(F.struct("section_ord", "section_id"))).alias("_names")
    )
    return scored.join(names, "course_id", "left").select(
        *[c for c in chunk_vectors.columns if c != "vector"],
        F.expr(
            "inline_outer(transform(_names, (s, i) -> named_struct('section_ord', s.section_ord, "
            "'section_id', s.section_id, 'score', scores[i])))"
        ),
    )


def vector_score_rows(chunk_vectors: DataFrame, section_vectors: DataFrame) -> DataFrame:
    """``scores`` of each chunk vector with all sections of its course, in section order."""
    return _scored_vectors(chunk_vectors, section_vectors).filter(F.col("scores").isNotNull())


# --- anchors -----------------------------------------------------------------
def _found_rule(tokens: str, padded: str, phrases: str) -> str:
    """``array<struct<anchor, n>>``; a substring test skips absent phrases."""
    present = keep(phrases, lambda p: f"contains({padded}, concat(' ', {p}.phrase, ' '))")
    return each(
        present,
        lambda p: f"named_struct('anchor', {p}.anchor, 'n', "
        f"{phrase_count_rule(tokens, f'{p}.phrase', f'{p}.size')})",
    )


def anchor_counts(chunks: DataFrame, profiles: DataFrame, kind: str = "material") -> DataFrame:
    """Occurrences of each section's anchors in each chunk, in long form."""
    hits = let(
        padded_rule("tokens"),
        lambda p: "flatten(transform(secs, s_ -> "
        + each(
            _found_rule("tokens", p, f"s_.{kind}"),
            lambda f: "named_struct('section_ord', s_.ord, 'section_id', s_.section_id, "
            f"'anchor', {f}.anchor, 'n', {f}.n, 'is_title', array_contains(s_.title_fragments, {f}.anchor))",
        )
        + "))",
    )
    # the outer form keeps the optimizer from searching a second time
    rows = with_course(chunks, profiles).select(*_chunk_keys(chunks), F.expr(f"inline_outer({hits})"))
    return rows.filter(F.col("anchor").isNotNull())


def material_candidates(counts: DataFrame) -> DataFrame:
    """Sections with at least one anchor in the chunk."""
    return counts.select(*_chunk_keys(counts), "section_ord", "section_id").distinct()


def speech_candidates(counts: DataFrame) -> DataFrame:
    """Sections with two anchors, a repeated one, or one from the title."""
    keys = _chunk_keys(counts)
    return (
        counts.groupBy(*keys, "section_ord", "section_id")
        .agg(
            F.count("*").alias("anchors"),
            F.max("n").alias("most"),
            F.max("is_title").alias("is_title"),
        )
        .filter((F.col("anchors") >= 2) | (F.col("most") >= 2) | F.col("is_title"))
    )


def restrict(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores outside the candidates become 0."""
    keys = [*_chunk_keys(scores), "section_id"]
    marked = candidates.select(*keys).withColumn("_candidate", F.lit(True))
    return scores.join(marked, keys, "left").select(
        *[c for c in scores.columns if c != "score"],
        F.when(F.col("_candidate"), F.col("score")).otherwise(0.0).alias("score"),
    )


def _evidence_rule(tokens: str = "tokens", secs: str = "secs") -> str:
    """``array<boolean>``: sections with at least one material anchor in the chunk."""
    return let(
        padded_rule(tokens),
        lambda p: f"transform({secs}, s -> exists(s.material, a -> "
        f"contains({p}, concat(' ', a.phrase, ' '))))",
    )


def restrict_lexical(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Lexical scores with 0 outside the sections that have an anchor in the chunk.

    The same rows as ``restrict`` over ``material_candidates``, found inside each chunk's row.
    """
    scored = with_lexical_scores(chunks, profiles)
    return _long_scores(scored, _chunk_keys(chunks), _gated_rule("scores", _evidence_rule()))


# --- titles ------------------------------------------------------------------
def _title_rule(label: str, secs: str = "secs") -> str:
    """``array<double>``: how strongly a video title points at each section.

    ``label`` names a struct with the title, its tokens, its fragment keys and
    the chapter number of the label.
    """
    found = _found_rule(f"{label}.tokens", padded_rule(f"{label}.tokens"), "s_.speech")
    occurrences = f"aggregate({found}, 0D, (a_, x_) -> a_ + x_.n)"
    shared = f"size(array_intersect({label}.keys, s_.speech_anchors))"
    score = let(
        f"named_struct('occ', {occurrences}, 'shared', {shared})",
        lambda o: f"if({o}.shared > 0, greatest({o}.occ, 1D + 0.1D * {o}.shared), {o}.occ)",
    )
    chapter = f"if(coalesce({label}.chapter = s_.chapter, false), {fv.TITLE_INDEX_SCORE}D, 0D)"
    return (
        f"if({label}.title = '', transform({secs}, s_ -> 0D), "
        f"transform({secs}, s_ -> {score} + {chapter}))"
    )


def _with_label(rows: DataFrame) -> DataFrame:
    """Adds ``label``, the parts of a video label that the title rule reads."""
    return rows.withColumn("_title", speech_title("source_label")).withColumn(
        "label",
        F.struct(
            F.col("_title").alias("title"),
            tokenize("_title").alias("tokens"),
            fragment_terms("_title", "speech").alias("keys"),
            source_chapter_index("source_label").alias("chapter"),
        ),
    )


def _scored_labels(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct labels with ``secs`` and ``title_scores``: one evaluation per label."""
    described = _with_label(labels.select("course_id", "source_label").distinct())
    return with_course(described, profiles).select(
        "course_id", "source_label", "secs", F.expr(_title_rule("label")).alias("title_scores")
    )


def _with_title_scores(chunks: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chunks with the ``title_scores`` of their label.

    To be called before profiles are attached, so that a shuffle moves no profile with
    each chunk.  The labels get a stage of their own: its real size, not the product that
    a join is estimated at, decides whether chunks are shuffled at all.  It is dealt by the
    keys in another order than the distinct labels, or Spark would leave it out.
    """
    titles = _scored_labels(labels, profiles).drop("secs").repartition("source_label", "course_id")
    return chunks.join(titles, ["course_id", "source_label"], "left")


def title_scores(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Positive title scores in long form."""
    scored = _scored_labels(labels, profiles).select(
        "course_id", "source_label", F.inline_outer(F.arrays_zip("secs", "title_scores"))
    )
    return scored.select(
        "course_id",
        "source_label",
        F.col("secs.ord").alias("section_ord"),
        F.col("secs.section_id").alias("section_id"),
        F.col("title_scores").alias("title_score"),
    ).filter(F.col("title_score") > 0)


# --- decisions over one chunk's sections -------------------------------------
def _best_rule(scores: str) -> str:
    """``struct<pos, score, runner>``: first maximum (0-based) and the next score."""

    def pick(top: str) -> str:
        pos = f"(int(array_position({scores}, {top})) - 1)"
        others = let(pos, lambda p: f"array_max(filter({scores}, (x_, i_) -> i_ <> {p}))")
        return f"named_struct('pos', {pos}, 'score', {top}, 'runner', coalesce({others}, 0D))"

    return let(f"array_max({scores})", pick, "top")


def _unsure(best: str, thresholds: Thresholds) -> str:
    return f"({best}.score < {thresholds[0]}D OR {best}.score - {best}.runner < {thresholds[1]}D)"


def _plain_rule(scores: str, thresholds: Thresholds) -> str:
    """``struct<pos, score, runner, rationale>``; ``pos`` null means unmapped."""
    return let(
        _best_rule(scores),
        lambda b: f"named_struct('pos', if({_unsure(b, thresholds)}, NULL, {b}.pos), 'score', {b}.score, "
        f"'runner', {b}.runner, 'rationale', if({_unsure(b, thresholds)}, 'unmapped', 'similarity'))",
        "b",
    )


def _floor(thresholds: Thresholds, slack: float) -> str:
    return f"greatest(0D, {thresholds[0]}D - {slack}D)"


def _rescue_rule(scores: str, titles: str, facts: str, thresholds: Thresholds) -> str:
    """``struct<pos, mismatch, title_score, title_pos>``; ``pos`` null = no rescue.

    A title may rescue a section when the transcript holds one of its anchors and
    does not speak against it; when the title matches exactly and the transcript
    is undecided or close; or when only the chapter number matches and the
    transcript alone would have been enough.
    """

    def decide(x: str) -> str:
        best, title, own = f"{x}.best", f"{x}.title", f"{x}.own"
        delta = f"({best}.score - {own})"
        exact = f"({title}.score >= 1)"
        unsure = _unsure(best, thresholds)
        plausible = f"({own} >= {_floor(thresholds, 0.03)})"
        backed = f"({facts}[{title}.pos].anchors > 0)"
        rescued = (
            f"({title}.score > 0 AND ("
            f"({backed} AND ({unsure} OR {plausible} OR ({exact} AND {own} >= {_floor(thresholds, 0.05)}))) "
            f"OR ({exact} AND ({unsure} OR ({plausible} AND {delta} <= {fv.TITLE_MAX_DELTA}D))) "
            f"OR (NOT {exact} AND {unsure} AND {own} >= {thresholds[0]}D)))"
        )
        return (
            f"named_struct('pos', if({rescued}, {title}.pos, NULL), "
            f"'mismatch', NOT {rescued} AND {exact} AND {delta} > {fv.TITLE_MAX_DELTA}D, "
            f"'title_score', {title}.score, 'title_pos', {title}.pos)"
        )

    pair = f"named_struct('best', {_best_rule(scores)}, 'title', {_best_rule(titles)})"
    with_own = let(
        pair,
        lambda p: f"named_struct('best', {p}.best, 'title', {p}.title, 'own', {scores}[{p}.title.pos])",
    )
    return let(with_own, decide)


def _bonus_rule(title_score: str) -> str:
    bounded = f"greatest(0D, least({title_score}, 2D))"
    return f"least({fv.TITLE_BONUS_MAX}D, 0.02D + {bounded} * 0.02D)"


def _facts_rule(tokens: str = "tokens", secs: str = "secs") -> str:
    """Per section ``struct<anchors, candidate, titled>`` of a transcript chunk."""

    def one(padded: str) -> str:
        return let(
            _found_rule(tokens, padded, "s_.speech"),
            lambda f: f"named_struct('anchors', size({f}), 'candidate', size({f}) >= 2 "
            f"OR exists({f}, a_ -> a_.n >= 2 OR array_contains(s_.title_fragments, a_.anchor)), "
            f"'titled', exists({f}, a_ -> array_contains(s_.title_fragments, a_.anchor)))",
        )

    return let(padded_rule(tokens), lambda p: f"transform({secs}, s_ -> {one(p)})")


def _gated_rule(scores: str, gate: str) -> str:
    return f"zip_with({scores}, {gate}, (x_, g_) -> if(g_, x_, 0D))"


def title_rescue(
    chunks: DataFrame,
    profiles: DataFrame,
    thresholds: Thresholds = fv.LEXICAL_THRESHOLDS,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Outcome of the title rules per speech chunk (rescued section or mismatch).

    ``labels`` (course_id, source_label) come from the sources; without them each
    chunk's own label is scored in its row.
    """
    titled = chunks if labels is None else _with_title_scores(chunks, labels, profiles)
    ready = _speech_ready(with_lexical_scores(titled, profiles), thresholds)
    return ready.select(
        *_chunk_keys(chunks),
        "source_label",
        F.expr("get(secs, rescue.pos).section_id").alias("rescued_section"),
        F.expr("if(rescue.title_score > 0, secs[rescue.title_pos].section_id, NULL)").alias(
            "title_section"
        ),
        F.col("rescue.mismatch").alias("mismatch"),
        F.expr(f"if(rescue.pos IS NULL, 0D, {_bonus_rule('rescue.title_score')})").alias("bonus"),
    )


def _speech_ready(scored: DataFrame, thresholds: Thresholds, when: str = "true") -> DataFrame:
    """Scored chunks with ``title_scores``, ``facts`` and ``rescue`` where ``when`` holds."""
    if "title_scores" in scored.columns:
        joined = scored
    else:
        joined = _with_label(scored).withColumn(
            "title_scores", F.expr(f"if({when}, {_title_rule('label')}, NULL)")
        )
    rescue = _rescue_rule("scores", "title_scores", "facts", thresholds)
    return (
        joined.withColumn(
            "title_scores", F.expr("coalesce(title_scores, transform(secs, s -> 0D))")
        )
        .withColumn("facts", F.expr(f"if({when}, {_facts_rule()}, NULL)"))
        .withColumn("rescue", F.expr(f"if({when}, {rescue}, NULL)"))
    )


def _decide(ready: DataFrame, thresholds: Thresholds, is_speech: str) -> DataFrame:
    """Adds ``d``: the gated, title-adjusted choice, then the two late rescues.

    The rescues only look at speech that stays unmapped: first a lone candidate
    whose title occurs in the transcript, then an outside ``verdict``.
    """
    gated = _gated_rule(
        "transform(scores, (x, i) -> x + if(coalesce(rescue.pos = i, false), "
        f"{_bonus_rule('rescue.title_score')}, 0D))",
        "candidates",
    )
    lone_ok = (
        "size(filter(candidates, c -> c)) = 1 AND facts[lone].titled "
        f"AND scores[lone] >= {_floor(thresholds, 0.04)}"
    )
    judged = (
        f"size(filter(candidates, c -> c)) BETWEEN 2 AND {fv.ADJUDICATION_MAX_CANDIDATES} "
        "AND coalesce(candidates[verdict], false)"
    )
    return (
        ready.withColumn("plain", F.expr(_plain_rule(gated, thresholds)))
        .withColumn("lone", F.expr("nullif(int(array_position(candidates, true)) - 1, -1)"))
        .withColumn(
            "late",
            F.expr(
                f"CASE WHEN plain.pos IS NOT NULL OR NOT {is_speech} THEN NULL WHEN {lone_ok} THEN lone "
                f"WHEN {judged} THEN verdict END"
            ),
        )
        # a generated column is never inlined into later filters, so the rules run once per chunk
        .select(
            "*",
            F.explode_outer(
                F.expr(
                    "array(if(late IS NULL, plain, named_struct('pos', late, "
                    f"'score', greatest(scores[late], {thresholds[0]}D), "
                    "'runner', coalesce(array_max(filter(scores, (x, i) -> i <> late)), 0D), "
                    f"'rationale', if({lone_ok}, 'anchor', 'adjudicated'))))"
                )
            ).alias("d"),
        )
    )


def best_lexical(
    chunks: DataFrame, profiles: DataFrame, thresholds: Thresholds = fv.LEXICAL_THRESHOLDS
) -> DataFrame:
    """The same rows as ``best_assignment`` over ``score_lexical``, found inside each chunk's row."""
    scored = with_lexical_scores(chunks, profiles)
    return scored.withColumn("d", F.expr(_plain_rule("scores", thresholds))).select(
        *_chunk_keys(chunks),
        F.expr("get(secs, d.pos).section_id").alias("section_id"),
        F.col("d.score").alias("score"),
        F.col("d.runner").alias("runner_up"),
    )


def best_assignment(
    scores: DataFrame, min_score: float, min_margin: float
) -> DataFrame:
    """Top section and runner-up per chunk from long scores (chunk keys + score)."""
    keys = [c for c in scores.columns if c not in ("section_ord", "section_id", "score")]
    packed = scores.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("section_ord", "section_id", "score"))).alias("s")
    )
    return packed.withColumn(
        "d", F.expr(_plain_rule("s.score", (min_score, min_margin)))
    ).select(
        *keys,
        F.expr("get(s, d.pos).section_id").alias("section_id"),
        F.col("d.score").alias("score"),
        F.col("d.runner").alias("runner_up"),
    )


def assign_chunks(
    chunks: DataFrame,
    profiles: DataFrame,
    vector_scores: DataFrame | None = None,
    adjudications: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Section of every chunk, by the rule of its source type, in one pass.

    ``chunks`` carries ``tokens``.  With ``vector_scores`` (chunk keys, or those of them
    that decide, and a ``scores`` array in section order) the vector thresholds apply; otherwise
    scores are lexical.  A chunk without a vector scores zero and stays unmapped.  ``adjudications`` (chunk keys, section_id, confidence)
    stands in for an outside judge of ambiguous speech.  With ``labels``
    (course_id, source_label, source_type) each video label is scored once and
    joined; without, it is scored in the chunk's row, as a stream needs it.
    """
    keys = _chunk_keys(chunks)
    carried = [c for c in chunks.columns if c != "tokens"]
    is_speech = one_of("lower(source_type)", fv.SPEECH_TYPES)
    is_material = one_of("lower(source_type)", fv.MATERIAL_TYPES)
    # everything that may shuffle chunks comes before the profiles, which would travel with each
    rows = chunks
    if vector_scores is not None:
        rows = rows.join(vector_scores, [c for c in keys if c in vector_scores.columns], "left")
    if adjudications is not None:
        verdicts = adjudications.filter(F.lower(F.trim("confidence")) == "high").select(
            *keys, F.col("section_id").alias("_verdict")
        )
        rows = rows.join(verdicts, keys, "left")
    if labels is not None:
        rows = _with_title_scores(rows, labels.filter(F.expr(is_speech)), profiles)
    if vector_scores is None:
        thresholds = fv.LEXICAL_THRESHOLDS
        scored = with_lexical_scores(rows, profiles)
    else:
        thresholds = fv.VECTOR_THRESHOLDS
        missing = F.expr("transform(secs, s -> 0D)")
        scored = with_course(rows, profiles).withColumn("scores", F.coalesce("scores", missing))
    ready = _speech_ready(scored, thresholds, is_speech)
    if adjudications is None:
        ready = ready.withColumn("verdict", F.lit(None).cast("int"))
    else:
        ready = ready.withColumn(
            "verdict",
            F.expr(
                f"if(token_count >= {fv.ADJUDICATION_MIN_TOKENS}, "
                "nullif(int(array_position(secs.section_id, _verdict)) - 1, -1), NULL)"
            ),
        )
    gate = (
        f"CASE WHEN {is_material} THEN {_evidence_rule()} WHEN {is_speech} THEN "
        "transform(facts, (f, i) -> f.candidate OR coalesce(rescue.pos = i, false)) "
        "ELSE transform(secs, s -> true) END"
    )
    decided = _decide(ready.withColumn("candidates", F.expr(gate)), thresholds, is_speech)
    section = F.expr("get(secs, d.pos)")
    return decided.select(
        *carried,
        section["ord"].alias("section_ord"),
        section["section_id"].alias("section_id"),
        F.coalesce(section["title"], F.lit("Other / Unmapped")).alias("section_title"),
        F.col("d.score").alias("score"),
        F.col("d.runner").alias("runner_up"),
        F.col("d.rationale").alias("rationale"),
        F.expr("if(rescue.mismatch, secs[rescue.title_pos].title, NULL)").alias("mismatch_title"),
    )


def mismatch_warnings(assignments: DataFrame) -> DataFrame:
    """One warning per video whose title and transcript disagree."""
    message = F.concat(
        "source_label",
        F.lit(": the title points to '"),
        "mismatch_title",
        F.lit("' but the transcript reads as another topic"),
    )
    return (
        assignments.filter(F.col("mismatch_title").isNotNull())
        .select("course_id", "instructor", "source_label", message.alias("message"))
        .distinct()
    )


def resolve_instructors(lanes: DataFrame, roster: DataFrame) -> DataFrame:
    """Submitted names → roster names.

    Order: exact roster name, numbered placeholder, sole roster entry, the
    submitted name, a generated placeholder.  ``roster_ord`` is the 1-based
    position among the non-blank roster names.
    """
    entries = roster.select(
        "course_id", F.trim(F.coalesce("name", F.lit(""))).alias("entry"), "roster_ord"
    ).filter(F.col("entry") != "")
    exact = entries.select("course_id", F.col("entry").alias("name")).distinct().withColumn(
        "known", F.lit(True)
    )
    numbered = entries.select(
        "course_id", F.col("roster_ord").cast("int").alias("number"), F.col("entry").alias("nth")
    )
    sizes = entries.groupBy("course_id").agg(
        F.count("*").alias("entries"), F.first("entry").alias("any_entry")
    )
    name = F.trim(F.coalesce("raw_name", F.lit("")))
    number = F.regexp_extract(name, rf"^{fv.GENERIC_INSTRUCTOR} \s*([+-]?\d+)\s*$", 1).try_cast("int")
    return (
        lanes.withColumn("name", name)
        .withColumn("number", number)
        .join(exact, ["course_id", "name"], "left")
        .join(numbered, ["course_id", "number"], "left")
        .join(sizes, "course_id", "left")
        .withColumn(
            "instructor",
            F.when((F.col("name") != "") & F.col("known"), F.col("name"))
            .when(F.col("nth").isNotNull(), F.col("nth"))
            .when(F.col("entries") == 1, F.col("any_entry"))
            .when(F.col("name") != "", F.col("name"))
            .otherwise(F.concat(F.lit(f"{fv.GENERIC_INSTRUCTOR} "), F.col("lane_no").cast("string"))),
        )
        .select(*lanes.columns, "instructor")
    )
