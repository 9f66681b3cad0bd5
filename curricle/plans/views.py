"""Inputs of the registered queries, derived from the given tables.

Each view exists twice: as a DataFrame and as a DuckDB CTE of the same name.
All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.text import format_seconds
from curricle.operators.chunking import build_chunks, dedupe_chunks, identify_chunks, measure_chunks
from curricle.operators.curriculum import course_profiles, describe_sections, normalize_weights
from curricle.plans import sqlkit as k
from curricle.plans.sqlkit import Ctes

COURSES = 5
SECTIONS = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to as many partitions as the session asks for, if it asks.

    A single small file is one split.  Who runs on such input, as the bench does,
    sets ``spark.curricle.inputPartitions``; large inputs need no dealing.
    """
    wanted = df.sparkSession.conf.get("spark.curricle.inputPartitions", None)
    return df.repartition(int(wanted)) if wanted else df


def _course_of(doc: Column) -> Column:
    return F.concat(F.lit("course-"), (F.floor(doc / COURSES) % COURSES).cast("string"))


def raw_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as courses of eight sections with weights 5, 10, … 40."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    ordinal = (F.col("item_id") % SECTIONS + 1).cast("int")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("course-"), F.floor(F.col("item_id") / SECTIONS).cast("string")).alias(
            "course_id"
        ),
        ordinal.alias("section_ord"),
        F.concat(F.lit("section-"), ordinal.cast("string")).alias("section_id"),
        F.concat(
            F.lit("Chapter "), ordinal.cast("string"), F.lit(": "), F.array_join(F.slice(words, 1, 2), " ")
        ).alias("title"),
        F.array_join(F.slice(words, F.lit(3), F.greatest(F.lit(0), F.size(words) - 2)), " ").alias(
            "description"
        ),
        (ordinal * 5).cast("double").alias("target_weight"),
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_weights(raw_sections(spark, sf))


def described(spark: SparkSession, sf: str) -> DataFrame:
    return describe_sections(sections(spark, sf))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return course_profiles(described(spark, sf))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines of all documents as segments of five source types."""
    lines = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("source_id"),
        _course_of(F.col("doc_id")).alias("course_id"),
        F.col("source").alias("instructor"),
        F.posexplode_outer(F.split("text", "\n")).alias("seq", "text"),
    )
    kind = F.col("source_id") % 5
    titles = raw_sections(spark, sf).select(
        "course_id",
        F.col("section_ord").alias("_k"),
        F.regexp_replace("title", "^Chapter [0-9]+: ", "").alias("_words"),
    )
    spoken = lines.withColumn("_k", (F.col("source_id") % SECTIONS + 1).cast("int")).join(
        titles, ["course_id", "_k"], "left"
    )
    number = F.col("seq") + 1
    return spoken.filter(F.trim("text") != "").select(
        "course_id",
        "source_id",
        "instructor",
        F.when(kind == 3, F.concat(F.lit("Series ["), F.col("_k").cast("string"), F.lit("-1] "), F.coalesce("_words", F.lit(""))))
        .otherwise(F.concat(F.lit("doc "), F.col("source_id").cast("string")))
        .alias("source_label"),
        F.when(kind == 0, "pdf").when(kind == 1, "pptx").when(kind == 2, "text").when(kind == 3, "youtube").otherwise(F.lit("csv")).alias("source_type"),
        F.col("seq").cast("long").alias("seq"),
        F.when(kind == 0, F.concat(F.lit("p."), number.cast("string")))
        .when(kind == 1, F.concat(F.lit("s."), number.cast("string")))
        .when(kind == 2, F.lit("full"))
        .when(kind == 3, format_seconds(F.col("seq") * 15))
        .otherwise(F.concat(F.lit("row."), number.cast("string")))
        .alias("locator"),
        "text",
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Video labels, one row per source, read from documents that are not exploded."""
    spoken = table(spark, sf, "documents").filter(
        (F.col("doc_id") % 5 == 3) & F.exists(F.split("text", "\n"), lambda line: F.trim(line) != "")
    )
    titles = raw_sections(spark, sf).select(
        F.col("course_id").alias("_course"),
        F.col("section_ord").alias("_ord"),
        F.regexp_replace("title", "^Chapter [0-9]+: ", "").alias("_words"),
    )
    ordinal = (F.col("doc_id") % SECTIONS + 1).cast("int")
    keyed = spoken.select(_course_of(F.col("doc_id")).alias("course_id"), ordinal.alias("_k")).distinct()
    joined = keyed.join(
        titles, (F.col("course_id") == F.col("_course")) & (F.col("_k") == F.col("_ord")), "left"
    )
    label = F.concat(
        F.lit("Series ["), F.col("_k").cast("string"), F.lit("-1] "), F.coalesce("_words", F.lit(""))
    )
    return joined.select("course_id", label.alias("source_label"), F.lit("youtube").alias("source_type"))


def kept_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated chunks of all segments."""
    made = identify_chunks(build_chunks(segments(spark, sf)), clean=True)
    return dedupe_chunks(made)[0]


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated chunks of all segments, with tokens."""
    return measure_chunks(kept_chunks(spark, sf))


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Embedding rows as chunk vectors; per label the mean as section vector."""
    rows = table(spark, sf, "embeddings")
    chunk_vectors = rows.select(F.lit("course-0").alias("course_id"), "vec_id", F.col("embedding").alias("vector"))
    means = (
        rows.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    )
    section_vectors = means.select(
        F.lit("course-0").alias("course_id"),
        (F.col("label") + 1).alias("section_ord"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("section_id"),
        "vector",
    )
    return chunk_vectors, section_vectors


# --- the same views in DuckDB -------------------------------------------------
C = Ctes()
C.add(
    "raw_sections",
    f"""
raw_sections AS (
  SELECT 'course-' || (item_id // {SECTIONS}) AS course_id, (item_id % {SECTIONS} + 1)::INT AS section_ord,
    'section-' || (item_id % {SECTIONS} + 1) AS section_id,
    'Chapter ' || (item_id % {SECTIONS} + 1) || ': ' || array_to_string(w[1:2], ' ') AS title,
    array_to_string(w[3:], ' ') AS description, (5 * (item_id % {SECTIONS} + 1))::DOUBLE AS target_weight
  FROM (SELECT item_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM benchmark))""",
)
C.add(
    "sections",
    """
section_shares AS (
  SELECT *, CASE WHEN sum(target_weight) OVER (PARTITION BY course_id) > 0
      THEN round(target_weight / sum(target_weight) OVER (PARTITION BY course_id) * 100, 2)
      ELSE round(100.0::DOUBLE / count(*) OVER (PARTITION BY course_id), 2) END AS sh,
    row_number() OVER (PARTITION BY course_id ORDER BY section_ord DESC) AS back
  FROM raw_sections),
sections AS (
  SELECT course_id, section_ord, section_id, title, description,
    CASE WHEN back = 1 THEN round(sh + (100 - sum(sh) OVER (PARTITION BY course_id)), 2) ELSE sh END AS target_weight
  FROM section_shares)""",
    "raw_sections",
)
C.add(
    "segs",
    f"""
doc_lines AS (
  SELECT doc_id, source, unnest(range(len(ls))) AS seq, unnest(ls) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
segs AS (
  SELECT 'course-' || ((d.doc_id // {COURSES}) % {COURSES}) AS course_id, d.doc_id AS source_id, d.source AS instructor,
    CASE WHEN d.doc_id % 5 = 3 THEN 'Series [' || (d.doc_id % {SECTIONS} + 1) || '-1] ' ||
         coalesce(regexp_replace(s.title, '^Chapter [0-9]+: ', ''), '') ELSE 'doc ' || d.doc_id END AS source_label,
    CASE d.doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pptx' WHEN 2 THEN 'text' WHEN 3 THEN 'youtube' ELSE 'csv' END AS source_type,
    d.seq,
    CASE d.doc_id % 5 WHEN 0 THEN 'p.' || (d.seq + 1) WHEN 1 THEN 's.' || (d.seq + 1) WHEN 2 THEN 'full'
      WHEN 3 THEN CASE WHEN d.seq * 15 >= 3600 THEN lpad((d.seq * 15 // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END
        || lpad((d.seq * 15 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((d.seq * 15 % 60)::VARCHAR, 2, '0')
      ELSE 'row.' || (d.seq + 1) END AS locator,
    d.line AS text
  FROM doc_lines d LEFT JOIN raw_sections s
    ON s.course_id = 'course-' || ((d.doc_id // {COURSES}) % {COURSES}) AND s.section_ord = d.doc_id % {SECTIONS} + 1
  WHERE trim(d.line) <> '')""",
    "raw_sections",
)
_B = fv.MATERIAL_SUBCHUNK
C.add(
    "material_parts",
    f"""
mat_seg AS (
  SELECT *, {k.norm('text')} AS body FROM segs WHERE source_type IN ('pdf', 'pptx', 'text')),
mat_flag AS (
  SELECT *, (regexp_matches(body, {k.q('(?i)' + fv.BLOCK_START)}) OR {k.contains_any('lower(body)', fv.WORKSHEET_PHRASES)}
    OR len({k.tok('body')}) > {2 * _B}) AS splits FROM mat_seg WHERE body <> ''),
mat_block AS (
  SELECT source_id, seq, unnest(range(len(bl))) AS bi, unnest(bl) AS block FROM (
    SELECT source_id, seq, list_filter(list_transform(string_split(regexp_replace(body, {k.q('(?i)' + fv.BLOCK_START)}, chr(1) || '\\1', 'g'), chr(1)),
      lambda bx: trim(bx)), lambda bx: bx <> '') AS bl FROM mat_flag WHERE splits)),
mat_sent AS (SELECT source_id, seq, bi, {k.sentences('block')} AS ss FROM mat_block),
mat_fold AS (SELECT *, {k.fold(f"list_transform(ss, lambda fx: len({k.tok('fx')}))", _B)} AS st FROM mat_sent),
mat_part AS (
  SELECT source_id, seq, bi, j, array_to_string(ss[st[j + 1]:coalesce(st[j + 2] - 1, len(ss))], ' ') AS part
  FROM (SELECT *, unnest(range(len(st))) AS j FROM mat_fold)),
mat_words AS (
  SELECT *, {k.fold(f"list_transform(ws, lambda fx: len({k.tok('fx')}))", _B)} AS st FROM (
    SELECT source_id, seq, bi, j, string_split(part, ' ') AS ws FROM mat_part WHERE len({k.tok('part')}) > {_B})),
mat_piece AS (
  SELECT source_id, seq, bi, j, 0 AS wj, part FROM mat_part WHERE len({k.tok('part')}) <= {_B}
  UNION ALL
  SELECT source_id, seq, bi, j, wj, array_to_string(ws[st[wj + 1]:coalesce(st[wj + 2] - 1, len(ws))], ' ')
  FROM (SELECT *, unnest(range(len(st))) AS wj FROM mat_words)),
mat_kept AS (
  SELECT source_id, seq, row_number() OVER (PARTITION BY source_id, seq ORDER BY bi, j, wj) - 1 AS part_no,
    count(*) OVER (PARTITION BY source_id, seq) AS total, part AS text
  FROM mat_piece WHERE NOT {k.is_noise('part')}
  UNION ALL SELECT source_id, seq, 0, 1, body FROM mat_flag WHERE NOT splits),
material_parts AS (
  SELECT m.source_id, s.course_id, s.instructor, s.source_label, s.source_type, m.seq AS chunk_seq, m.part_no,
    CASE WHEN total > 1 THEN s.locator || ' (' || (m.part_no + 1) || '/' || total || ')' ELSE s.locator END AS locator, m.text
  FROM mat_kept m JOIN segs s ON s.source_id = m.source_id AND s.seq = m.seq)""",
    "segs",
)


def packed_sql(name: str, source: str, budget: int, overlap: int) -> str:
    return f"""
{name}_rows AS (
  SELECT source_id, any_value(course_id) AS course_id, any_value(instructor) AS instructor,
    any_value(source_label) AS source_label, any_value(source_type) AS source_type,
    list(seq ORDER BY seq) AS seqs, list(locator ORDER BY seq) AS locs, list(text ORDER BY seq) AS txts,
    list({k.ntok('text')} ORDER BY seq) AS sizes
  FROM {source} GROUP BY source_id),
{name}_fold AS (SELECT *, {k.fold('sizes', budget, overlap)} AS st FROM {name}_rows),
{name}_cut AS (
  SELECT *, st[j + 1] AS first_i, greatest(1, st[j + 1] - {overlap}) AS low, coalesce(st[j + 2] - 1, len(seqs)) AS high
  FROM (SELECT *, unnest(range(len(st))) AS j FROM {name}_fold)),
{name} AS (
  SELECT source_id, course_id, instructor, source_label, source_type, seqs[first_i] AS chunk_seq, 0::BIGINT AS part_no,
    CASE WHEN locs[low] = locs[high] THEN locs[low] ELSE locs[low] || ' -> ' || locs[high] END AS locator,
    {k.norm("array_to_string(txts[low:high], ' ')")} AS text
  FROM {name}_cut)"""


C.add(
    "speech_parts",
    f"""
speech_seg AS (
  SELECT * REPLACE ({k.norm(f"regexp_replace({k.norm('text')}, {k.q(fv.SOUND_MARKER)}, ' ', 'g')")} AS text)
  FROM segs WHERE source_type = 'youtube'),
speech_kept AS (SELECT * FROM speech_seg WHERE text <> ''),
{packed_sql('speech_parts', 'speech_kept', fv.SPEECH_SUBCHUNK, 0).strip()}""",
    "segs",
)
C.add(
    "table_parts",
    f"""
table_seg AS (SELECT * FROM segs WHERE source_type = 'csv'),
{packed_sql('table_parts', 'table_seg', fv.CHUNK_TARGET, fv.CHUNK_OVERLAP).strip()}""",
    "segs",
)
C.add(
    "all_chunks",
    f"""
all_chunks AS (
  SELECT *, {k.tok('text')} AS tokens, {k.ntok('text')} AS token_count, sha1(lower({k.norm('text')})) AS fingerprint,
    source_id || '-' || left(sha1(lower({k.norm('locator || text')})), 10) AS chunk_id
  FROM (SELECT * FROM material_parts UNION ALL BY NAME SELECT * FROM speech_parts UNION ALL BY NAME SELECT * FROM table_parts))""",
    "material_parts", "speech_parts", "table_parts",
)
C.add(
    "chunks",
    """
chunks AS (
  SELECT * FROM all_chunks QUALIFY row_number() OVER (
    PARTITION BY course_id, instructor, fingerprint ORDER BY source_id, chunk_seq, part_no) = 1)""",
    "all_chunks",
)
