"""Segments → chunks: packing, page-preserving splits, noise filter, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import (
    ColumnLike,
    any_in,
    apply,
    each,
    found,
    keep,
    one_of,
    replaced,
    sql_text,
)
from curricle.functions.text import clean_speech, fingerprint, normalize_text
from curricle.functions.tokens import Tokenizer, count_tokens, tokenize, total_rule
from curricle.operators.packing import (
    batch_groups,
    cut_groups,
    fold_pieces,
    pack_groups,
    parts_rule,
)
from curricle.operators.scale import top_rows

CARRIED = ("course_id", "instructor", "source_label", "source_type")


def _carried(df: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in df.columns]


def sub_target(target: int, cap: int) -> int:
    return max(fv.SUBCHUNK_FLOOR, min(target, cap))


# --- text splitting inside one segment ---------------------------------------
def budget_rule(text: str, target: int) -> str:
    """Sentences packed up to the token budget; longer sentences word by word.

    A token never spans a space, so token counts of joined sentences add up.
    """

    def sized(x: str) -> str:
        return f"named_struct('t', {x}, 'n', {total_rule(x)})"

    def by_words(sentence: str) -> str:
        words = keep(f"split({sentence}, ' ')", lambda w: f"{w} <> ''")
        return each(parts_rule(each(words, sized), target), lambda p: f"{p}.t")

    boundary = rf"(?<={fv.SENTENCE_MARK})\s+"
    sentences = keep(f"split({text}, {sql_text(boundary)})", lambda s: f"{s} <> ''")
    packed = each(
        parts_rule(each(sentences, sized), target),
        lambda p: f"if({p}.n <= {target}, array({p}.t), {by_words(f'{p}.t')})",
    )
    return f"flatten({packed})"


def noise_rule(block: str) -> str:
    """Worksheet blocks: they repeat the material instead of teaching it."""
    question, answer = found(block, fv.QUESTION_MARK), found(block, fv.ANSWER_MARK)
    gap = found(block, fv.BLANK_LINE_MARK)
    worksheet = any_in(f"lower({block})", fv.WORKSHEET_PHRASES)
    return f"({worksheet} OR ({question} AND ({answer} OR {gap})) OR ({gap} AND {answer}))"


#: What a block can begin with; one class decides for most places that none begins there.
BLOCK_FIRST = r"(?=[■□▪▫▷▶◆◇q\d주cp])"


def semantic_rule(text: str, target: int = fv.CHUNK_TARGET) -> str:
    """Parts of one material page (``text`` normalised); empty when all is noise."""
    budget = sub_target(target, fv.MATERIAL_SUBCHUNK)
    # a token has two characters at least, so shorter texts need no count
    splits = (
        f"({found(text, '(?i)' + BLOCK_FIRST + fv.BLOCK_START)} OR {any_in(f'lower({text})', fv.WORKSHEET_PHRASES)} "
        f"OR (length({text}) > {budget * 4} AND {total_rule(text)} > {budget * 2}))"
    )
    before_block = f"(?i){BLOCK_FIRST}(?={fv.BLOCK_START})"
    blocks = keep(
        each(f"split({text}, {sql_text(before_block)})", lambda b: f"trim({b})"),
        lambda b: f"{b} <> ''",
    )
    packed = f"flatten({each(blocks, lambda b: budget_rule(b, fv.MATERIAL_SUBCHUNK))})"
    kept = keep(packed, lambda b: f"NOT {noise_rule(b)}")
    if budget < fv.MATERIAL_SUBCHUNK:
        kept = f"flatten({each(kept, lambda b: budget_rule(b, budget))})"
    return f"if({splits}, {kept}, array({text}))"


def split_by_budget(text: ColumnLike, target: int) -> Column:
    return apply(text, lambda x: budget_rule(x, target))


def drop_noise_blocks(blocks: DataFrame, column: str = "text") -> DataFrame:
    block = normalize_text(column)
    return blocks.filter(~apply(block, noise_rule) & (block != ""))


def semantic_split(segments: DataFrame, target: int = fv.CHUNK_TARGET) -> DataFrame:
    """Material segments as sub-page parts with ``(i/n)`` locators; row-local."""
    return _explode_parts(segments, semantic_rule("text", target))


def preserve_chunks(segments: DataFrame, target: int = fv.CHUNK_TARGET) -> DataFrame:
    """Chunks that never cross a segment border, whatever the source type."""
    material = one_of("lower(source_type)", fv.MATERIAL_TYPES)
    return _explode_parts(
        segments,
        f"CASE WHEN {material} THEN {semantic_rule('text', target)} "
        f"WHEN {total_rule('text')} <= {target} THEN array(text) "
        f"ELSE {budget_rule('text', target)} END",
    )


def _explode_parts(segments: DataFrame, parts: str) -> DataFrame:
    clean = segments.withColumn("text", normalize_text("text")).filter(F.col("text") != "")
    # the outer form keeps the optimizer from testing the parts a second time
    return (
        clean.withColumn("_parts", F.expr(parts))
        .drop("text")
        .withColumn("_total", F.size("_parts"))
        .select("*", F.posexplode_outer("_parts").alias("part_no", "text"))
        .filter(F.col("part_no").isNotNull())
        .withColumn(
            "locator",
            F.when(
                F.col("_total") > 1,
                F.concat(
                    "locator",
                    F.lit(" ("),
                    (F.col("part_no") + 1).cast("string"),
                    F.lit("/"),
                    F.col("_total").cast("string"),
                    F.lit(")"),
                ),
            ).otherwise(F.col("locator")),
        )
        .withColumnRenamed("seq", "chunk_seq")
        .drop("_parts", "_total")
    )


# --- packing across segments -------------------------------------------------
def pack_segments(
    segments: DataFrame,
    target: Column | int = fv.CHUNK_TARGET,
    overlap: Column | int = fv.CHUNK_OVERLAP,
    tokenizer: Tokenizer = tokenize,
    **sizes: int,
) -> DataFrame:
    """Greedy packs of whole segments per source (see ``packing``).

    ``target`` and ``overlap``, the number of segments that a chunk takes over from the
    one before, may depend on the source.
    """
    if not isinstance(overlap, Column) and overlap < 0:
        raise ValueError("overlap must not be negative")
    pieces = (
        segments.withColumn("n", count_tokens("text", tokenizer))
        .withColumn("budget", target if isinstance(target, Column) else F.lit(target))
        .withColumn("overlap", overlap if isinstance(overlap, Column) else F.lit(overlap))
    )
    carried = [c for c in _carried(segments) if c != "source_id"]
    packed = pack_groups(pieces, carried=tuple(carried), **sizes)
    return _packed_texts(packed, carried)


def identify_chunks(parts: DataFrame, clean: bool = False) -> DataFrame:
    """Fingerprint and identity of finished chunk texts: all that the dedupe needs.

    ``clean`` promises normalised texts, as ``build_chunks`` makes them.  Then only the
    locator is left to normalise: no run of blanks spans it and a text.
    """
    if clean:
        locator = F.regexp_replace("locator", fv.WHITESPACE, " ")
        whole, located = F.sha1(F.lower("text")), F.sha1(F.lower(F.trim(F.concat(locator, "text"))))
    else:
        whole, located = fingerprint("text"), fingerprint(F.concat("locator", "text"))
    return parts.withColumn("fingerprint", whole).withColumn(
        "chunk_id",
        F.concat(F.col("source_id").cast("string"), F.lit("-"), F.substring(located, 1, 10)),
    )


def measure_chunks(chunks: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """Tokens and their number; after the dedupe, so that tokens are not shuffled."""
    return chunks.withColumn("tokens", tokenizer("text")).withColumn(
        "token_count", F.greatest(F.lit(1), F.size("tokens"))
    )


def assemble_chunks(parts: DataFrame, tokenizer: Tokenizer = tokenize, clean: bool = False) -> DataFrame:
    """Identity, token count and fingerprint of finished chunk texts."""
    return identify_chunks(measure_chunks(parts, tokenizer), clean)


def build_chunks(
    segments: DataFrame,
    target: int = fv.CHUNK_TARGET,
    overlap: int = fv.CHUNK_OVERLAP,
    tokenizer: Tokenizer = tokenize,
    **sizes: int,
) -> DataFrame:
    """Chunks of all sources, each by the rule of its source type.

    Columns: source columns, ``chunk_seq, part_no, locator, text``.  Material
    never shuffles; speech and tabular sources shuffle once by (source, block).
    """
    kind = F.lower(F.col("source_type"))
    wanted = ["source_id", *_carried(segments), "seq", "locator", "text"]
    rows = segments.select(*dict.fromkeys(wanted))
    material = preserve_chunks(rows.filter(kind.isin(*fv.MATERIAL_TYPES)), target)
    is_speech = kind.isin(*fv.SPEECH_TYPES)
    ordered = (
        rows.filter(~kind.isin(*fv.MATERIAL_TYPES))
        .withColumn("text", F.when(is_speech, clean_speech("text")).otherwise(F.col("text")))
        .filter(~is_speech | (F.col("text") != ""))
    )
    packed = pack_segments(
        ordered,
        F.when(is_speech, sub_target(target, fv.SPEECH_SUBCHUNK)).otherwise(target),
        F.when(is_speech, 0).otherwise(overlap),
        tokenizer,
        **sizes,
    )
    return material.unionByName(packed)


def dedupe_chunks(
    chunks: DataFrame,
    order: tuple[str, ...] = ("source_id", "chunk_seq", "part_no"),
    keys: tuple[str, ...] = ("course_id", "instructor"),
) -> tuple[DataFrame, DataFrame]:
    """First chunk per instructor and fingerprint, and how many were removed.

    Copies are cut to one per task before the shuffle, so a text that makes up a
    third of all rows does not land in one place.
    """
    keys = list(keys)
    kept = top_rows(chunks, [*keys, "fingerprint"], [F.col(c) for c in order], 1).drop("rank")
    totals = chunks.groupBy(*keys, "fingerprint").agg(F.count("*").alias("copies"))
    removed = totals.groupBy(*keys).agg((F.sum("copies") - F.count("*")).alias("removed"))
    return kept, removed


def plan_batches(
    items: DataFrame,
    max_items: int = fv.BATCH_MAX_ITEMS,
    max_tokens: int = fv.BATCH_MAX_TOKENS,
    partition_by: tuple[str, ...] = ("source_id",),
    tokenizer: Tokenizer = tokenize,
    block_rows: int = 65_536,
) -> DataFrame:
    """Request batches in order, bounded by item count and by tokens, per key.

    ``items`` has ``partition_by``, a dense 0-based ``pos`` and ``text``; the result
    names the first position of each item's batch.
    """
    sized = items.withColumn("n", count_tokens("text", tokenizer))
    return batch_groups(sized, list(partition_by), max_items, max_tokens, block_rows)


def chunk_source_rows(
    sources: DataFrame,
    target: int = fv.CHUNK_TARGET,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of rows that hold one complete source each, without any shuffle.

    ``sources``: source columns and ``segments``, an ordered array of
    ``struct<seq, locator, text>``.  This is the form in which streams arrive.
    """
    carried = [c for c in _carried(sources) if c != "source_id"]
    is_material = one_of("lower(source_type)", fv.MATERIAL_TYPES)
    is_speech = one_of("lower(source_type)", fv.SPEECH_TYPES)
    pages = sources.filter(F.expr(is_material)).select(
        "source_id", *carried, F.inline_outer("segments")
    )
    material = preserve_chunks(pages.filter(F.col("text").isNotNull()), target)
    spoken = sub_target(target, fv.SPEECH_SUBCHUNK)
    text = f"if({is_speech}, trim({replaced(replaced('s.text', fv.SOUND_MARKER, ' '), fv.WHITESPACE, ' ')}), s.text)"
    pieces = (
        f"filter(transform(segments, s -> named_struct('seq', s.seq, 'locator', s.locator, 'text', {text})), "
        f"s -> NOT {is_speech} OR s.text <> '')"
    )
    sized = (
        f"transform({pieces}, s -> named_struct('seq', s.seq, 'n', greatest(1, {total_rule('s.text')}), "
        "'locator', s.locator, 'text', s.text))"
    )
    rows = (
        sources.filter(~F.expr(is_material))
        .withColumn("pieces", F.expr(sized))
        .withColumn("budget", F.when(F.expr(is_speech), spoken).otherwise(target))
        .withColumn("overlap", F.when(F.expr(is_speech), 0).otherwise(overlap))
    )
    packed = cut_groups(fold_pieces(rows), ["source_id"], carried)
    return material.unionByName(_packed_texts(packed, carried))


def _packed_texts(packed: DataFrame, carried: list[str]) -> DataFrame:
    first = F.col("members")[0]["locator"]
    last = F.element_at("members", -1)["locator"]
    return packed.select(
        "source_id",
        *carried,
        F.col("group_seq").alias("chunk_seq"),
        F.lit(0).alias("part_no"),
        F.when(first == last, first).otherwise(F.concat(first, F.lit(" -> "), last)).alias("locator"),
        normalize_text(F.array_join("members.text", " ")).alias("text"),
    )
