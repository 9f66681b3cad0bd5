"""Survey and feedback queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.operators import coverage as co
from curricle.operators import feedback as fb
from curricle.operators.ranking import dense_positions
from curricle.operators.scale import stored
from curricle.plans import sqlkit as k
from curricle.plans import views as v
from curricle.plans.registry import register
from curricle.plans.text_queries import numeric_like_sql, text_rich_sql
from curricle.plans.views import C

# --- cells -----------------------------------------------------------------------
C.add(
    "cells",
    f"""
cell_rows AS (SELECT d.doc_id % 10 AS sheet, row_number() OVER (PARTITION BY d.doc_id % 10 ORDER BY d.doc_id) AS row_no, l.quality, l.toxic, {k.norm('d.text')} AS body
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cells AS (
  SELECT sheet, row_no, 0 AS col_no, coalesce((quality + 1)::VARCHAR, '') AS value FROM cell_rows UNION ALL SELECT sheet, row_no, 1, coalesce((toxic + 1) || '점', '') FROM cell_rows
  UNION ALL SELECT sheet, row_no, 2, CASE WHEN row_no % 4 = 0 THEN '' ELSE body END FROM cell_rows
  UNION ALL SELECT s, 0, c, h FROM (SELECT DISTINCT sheet AS s FROM cell_rows), (VALUES (0, 'BQ1-1. quality'), (1, 'BQ1-2. toxic'), (2, 'comment')) h(c, h))""",
)


def cells(spark, sf):
    """Ten sheets with two rated questions and a free-text column; without a label, no rating."""
    docs, labels = v.table(spark, sf, "documents"), v.table(spark, sf, "labels")
    sheet = (F.col("doc_id") % 10).alias("sheet")
    # ids are numbered on their own; texts join them afterwards
    numbers = dense_positions(docs.select("doc_id", sheet), ["sheet"], "doc_id").select("doc_id", "sheet", (F.col("pos") + 1).alias("row_no"))
    rows = docs.join(numbers, "doc_id").join(labels, "doc_id", "left")
    comment = F.when(F.col("row_no") % 4 == 0, "").otherwise(fb.normalize_text("text"))
    points = F.concat((F.col("toxic") + 1).cast("string"), F.lit("점"))
    values = F.array(F.coalesce((F.col("quality") + 1).cast("string"), F.lit("")), F.coalesce(points, F.lit("")), comment)
    body = rows.select("sheet", "row_no", F.posexplode(values).alias("col_no", "value"))
    head = docs.select(sheet).distinct().select(
        "sheet", F.lit(0).cast("long").alias("row_no"),
        F.posexplode(F.expr("array('BQ1-1. quality', 'BQ1-2. toxic', 'comment')")).alias("col_no", "value"),
    )
    return body.unionByName(head)


C.add(
    "sheet_cols",
    f"""
col_prof AS (SELECT sheet, col_no, count(*) AS non_empty, count_if({numeric_like_sql('value')}) AS numeric_like, count_if({text_rich_sql('value')}) AS text_like,
    sum(length(value)) FILTER ({text_rich_sql('value')}) AS text_chars FROM cells WHERE row_no > 0 AND value <> '' GROUP BY ALL),
sheet_cols AS (SELECT *, {k.contains_any('header', fv.SHEET_HEADER_HINTS)} AS hinted, coalesce(CASE WHEN {k.contains_any('header', fv.SHEET_TEXT_HINTS)} THEN text_like > 0
    ELSE text_like >= 2 AND text_chars / text_like >= 8 END, false) AS is_text FROM (SELECT p.*, lower(h.value) AS header FROM col_prof p JOIN cells h ON h.sheet = p.sheet AND h.col_no = p.col_no AND h.row_no = 0)),
sheet_scores AS (
  SELECT s.sheet, r.data_rows, t.response_rows, s.numeric_ratio, least(r.data_rows, 50) * 0.08::DOUBLE + s.text_columns * 1.2::DOUBLE + s.meta_columns * 0.2::DOUBLE + t.response_rows * 0.15::DOUBLE + s.hints * 0.6::DOUBLE - s.numeric_ratio * 1.5::DOUBLE AS score
  FROM (SELECT sheet, sum(numeric_like)::DOUBLE / sum(non_empty) AS numeric_ratio, count_if(is_text) AS text_columns, count_if(NOT is_text AND {k.contains_any('header', fv.SHEET_META_HINTS)}) AS meta_columns, count_if(hinted) AS hints FROM sheet_cols GROUP BY sheet) s
  JOIN (SELECT sheet, count(DISTINCT row_no) AS data_rows FROM cells WHERE row_no > 0 AND value <> '' GROUP BY sheet) r USING (sheet)
  JOIN (SELECT c.sheet, count(DISTINCT row_no) AS response_rows FROM cells c JOIN sheet_cols t ON t.sheet = c.sheet AND t.col_no = c.col_no AND t.is_text WHERE row_no > 0 AND value <> '' AND {text_rich_sql('value')} GROUP BY c.sheet) t USING (sheet)
  WHERE s.text_columns > 0 AND r.data_rows >= 2 AND t.response_rows >= 2 AND s.numeric_ratio <= 0.82)""",
    "cells",
)


@register("voc_response_sheets", C.query("SELECT sheet, data_rows, response_rows, round(numeric_ratio, 6) AS numeric_ratio, round(score, 6) AS score FROM sheet_scores", "sheet_cols"))
def voc_response_sheets(spark, sf):
    scored = fb.score_response_sheets(stored(fb.cell_facts(cells(spark, sf))))
    return scored.select("sheet", "data_rows", "response_rows", F.round("numeric_ratio", 6).alias("numeric_ratio"), F.round("score", 6).alias("score"))


# surveys have extra header levels above the question row
C.add(
    "survey_cells",
    """
survey_cells AS (
  SELECT sheet, CASE WHEN sheet % 2 = 0 THEN row_no + 2 ELSE row_no END AS row_no, col_no, value FROM cells
  UNION ALL SELECT s, r, c, h FROM (SELECT DISTINCT sheet AS s FROM cells WHERE sheet % 2 = 0), (VALUES (0, 0, 'Lecture'), (0, 1, ''), (0, 2, 'Other'), (1, 0, 'Ratings'), (1, 1, 'ratings'), (1, 2, 'Other')) h(r, c, h))""",
    "cells",
)


def survey_cells(spark, sf):
    base = cells(spark, sf)
    shifted = base.withColumn("row_no", F.when(F.col("sheet") % 2 == 0, F.col("row_no") + 2).otherwise(F.col("row_no")))
    levels = "array(named_struct('row_no', 0L, 'h', array('Lecture', '', 'Other')), named_struct('row_no', 1L, 'h', array('Ratings', 'ratings', 'Other')))"
    extra = (
        v.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("sheet")).filter(F.col("sheet") % 2 == 0).distinct()
        .select("sheet", F.inline(F.expr(levels)))
        .select("sheet", "row_no", F.posexplode("h").alias("col_no", "value"))
    )
    return shifted.unionByName(extra)


def survey_facts(spark, sf):
    """What counts and scores read of the survey cells, found once."""
    return stored(fb.cell_facts(survey_cells(spark, sf)))


_QID = k.q(fv.QUESTION_ID)
_FREE = lambda x: k.contains_any(f"lower({x})", fv.FREE_TEXT_HINTS)


def _survey_sql(name: str, source: str, by: str) -> str:
    """Headers of every possible header row, the kind of each column, and the best header row."""
    bare = f"regexp_replace({k.norm('value')}, '점$', '')"
    same = " AND ".join(f"x.{c} = h.{c}" for c in by.split(", "))
    qualified = ", ".join(f"h.{c}" for c in by.split(", "))
    return rf"""
{name}_fill AS (SELECT {by}, row_no, col_no, {k.norm('value')} AS leaf, last_value(nullif({k.norm('value')}, '') IGNORE NULLS) OVER (PARTITION BY {by}, row_no ORDER BY col_no) AS v FROM {source} WHERE row_no <= {fv.HEADER_ROW_LAST}),
{name}_cand AS (SELECT x.*, h.header_row FROM {name}_fill x JOIN (SELECT DISTINCT {by}, row_no AS header_row FROM {name}_fill) h ON {same} AND x.row_no <= h.header_row WHERE x.v IS NOT NULL),
{name}_step AS (SELECT *, lag(v) OVER (PARTITION BY {by}, header_row, col_no ORDER BY row_no) AS above FROM {name}_cand),
{name}_header AS (SELECT {by}, header_row, col_no, string_agg(v, ' / ' ORDER BY row_no) AS header FROM {name}_step WHERE above IS NULL OR lower(above) <> lower(v) GROUP BY ALL),
{name}_usable AS (SELECT {by}, row_no AS header_row FROM {name}_fill GROUP BY ALL HAVING bool_or(regexp_matches(leaf, {_QID}) OR {_FREE('leaf')})),
{name}_value AS (SELECT {by}, row_no, col_no, CASE WHEN regexp_matches({bare}, '^[+-]?(\d+\.?\d*|\.\d+)$') AND try_cast({bare} AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast({bare} AS DOUBLE) END AS score, {text_rich_sql('value')} AS rich
  FROM {source} WHERE {k.norm('value')} <> ''),
{name}_stat AS (SELECT {qualified}, h.header_row, h.col_no, h.header, upper(regexp_extract_all(h.header, {_QID}, 1)[-1]) AS qid, count(x.row_no) AS n, count(x.score) AS scored, max(x.score) AS top, count_if(coalesce(x.rich, false)) AS rich
  FROM {name}_header h SEMI JOIN {name}_usable u USING ({by}, header_row) LEFT JOIN {name}_value x ON {same} AND x.col_no = h.col_no AND x.row_no > h.header_row GROUP BY ALL),
{name}_kind AS (SELECT *, coalesce(starts_with(qid, 'BQ') AND n > 0 AND scored >= greatest(2, ceil(n * {fv.QUESTION_VALID_SHARE})), false) AS is_question, {_FREE('header')} AND rich > 0 AS freely FROM {name}_stat),
{name}_rows AS (SELECT {qualified}, h.header_row, count(DISTINCT x.row_no) AS response_rows FROM {name}_kind h JOIN {name}_value x ON {same} AND x.col_no = h.col_no AND x.row_no > h.header_row AND ((h.is_question AND x.score IS NOT NULL) OR (NOT h.is_question AND h.freely)) GROUP BY ALL),
{name} AS (SELECT *, least(response_rows, 120) * 0.05::DOUBLE + questions * 1.4::DOUBLE + free_texts * 0.8::DOUBLE + header_row * 0.35::DOUBLE AS score
  FROM (SELECT {by}, header_row, count_if(is_question)::BIGINT AS questions, count_if(freely AND NOT is_question)::BIGINT AS free_texts FROM {name}_kind GROUP BY ALL) JOIN {name}_rows USING ({by}, header_row)
  WHERE questions > 0 AND response_rows >= 2 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY score DESC, header_row) = 1)"""


C.add("survey", _survey_sql("survey", "survey_cells", "sheet").strip(), "survey_cells")


@register("voc_headers", C.query("SELECT sheet, header_row, col_no, header FROM survey_header", "survey"))
def voc_headers(spark, sf):
    """Collapsed headers for each of the first five rows as the header row."""
    headers = fb.collapse_headers(survey_cells(spark, sf))
    return headers.filter("header <> ''").select("sheet", "header_row", "col_no", "header")


@register("voc_survey_sheets", C.query("SELECT sheet, header_row, questions, free_texts, response_rows, round(score, 6) AS score FROM survey", "survey"))
def voc_survey_sheets(spark, sf):
    best = fb.score_survey_sheets(survey_facts(spark, sf))
    return best.select("sheet", F.col("header_row").cast("long").alias("header_row"), "questions", "free_texts", "response_rows", F.round("score", 6).alias("score"))


@register(
    "voc_question_scores",
    C.query(
        "SELECT c.sheet, qid AS question_id, split_part(qid, '-', 1) AS grp, trim(regexp_replace(f.leaf, '(?i)^.*?\\b' || qid || '\\b[\\s.\\-:)]*', '')) AS label, "
        "greatest(5, floor(any_value(c.top)))::BIGINT AS scale_max, round(avg(x.score), 2) AS average, count(*) AS response_count "
        "FROM survey_kind c JOIN survey b ON b.sheet = c.sheet AND b.header_row = c.header_row JOIN survey_fill f ON f.sheet = c.sheet AND f.row_no = c.header_row AND f.col_no = c.col_no "
        "JOIN survey_value x ON x.sheet = c.sheet AND x.col_no = c.col_no AND x.row_no > c.header_row AND x.score IS NOT NULL WHERE c.is_question GROUP BY c.sheet, qid, f.leaf",
        "survey",
    ),
)
def voc_question_scores(spark, sf):
    facts = survey_facts(spark, sf)
    scores = fb.question_scores(facts, fb.survey_columns(facts), fb.score_survey_sheets(facts))
    return scores.select("sheet", "question_id", "grp", "label", F.col("scale_max").cast("long").alias("scale_max"), "average", "response_count")


@register(
    "voc_response_segments",
    C.query("SELECT sheet, sheet || '.row.' || row_no AS locator, 'comment: ' || value AS text FROM cells WHERE col_no = 2 AND row_no > 0 AND value <> ''", "cells"),
)
def voc_response_segments(spark, sf):
    sheet_cells = cells(spark, sf)
    return fb.response_segments(sheet_cells, _asked(sheet_cells)).select("sheet", "locator", "text")


def _asked(sheet_cells):
    return fb.response_columns(sheet_cells).filter("is_meta OR is_text").select(
        "sheet", "col_no", "header", F.lit(1).cast("long").alias("first_row"), F.when(F.col("is_meta"), 0).otherwise(1).alias("priority")
    )


@register(
    "voc_skipped_rows",
    C.query(
        "SELECT sheet, count(DISTINCT row_no) AS data_rows, count(DISTINCT row_no) - count(DISTINCT row_no) FILTER (col_no = 2) AS skipped FROM cells WHERE row_no > 0 AND value <> '' GROUP BY sheet",
        "cells",
    ),
)
def voc_skipped_rows(spark, sf):
    """Rows with a rating or a comment, and how many of them gave no text."""
    facts = stored(fb.cell_facts(cells(spark, sf)))
    columns = _asked(facts)
    return fb.skipped_rows(facts, fb.response_rows(facts, columns), columns)


@register(
    "voc_sheet_choice",
    "WITH s AS (SELECT o_custkey AS file_id, o_orderkey AS sheet, round(o_totalprice / 100000, 2) AS score FROM orders), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, sheet) AS rk FROM s) "
    "SELECT a.file_id, a.sheet, a.score, (b.score IS NULL OR a.score >= b.score + 1.25::DOUBLE) AS chosen FROM r a LEFT JOIN r b ON b.file_id = a.file_id AND b.rk = 2 WHERE a.rk = 1",
)
def voc_sheet_choice(spark, sf):
    from curricle.operators.ranking import select_with_margin

    candidates = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("sheet"), F.round(F.col("o_totalprice") / 100000, 2).alias("score")
    )
    return select_with_margin(candidates, ["file_id"], ["sheet"]).select("file_id", "sheet", "score", "chosen")


# --- files and their readings --------------------------------------------------------
# four files a sheet: the survey, the same without question ids, that with a second sheet, a text
C.add(
    "file_cells",
    f"""
upload AS (SELECT DISTINCT sheet * 4 + f AS file_id, sheet, f, CASE WHEN f = 3 THEN 'text' WHEN (sheet + f) % 2 = 0 THEN 'survey_sheets' ELSE 'survey_csv' END AS kind FROM survey_cells, (VALUES (0), (1), (2), (3)) x(f)),
file_cells AS (
  SELECT u.file_id, p.part AS sheet, c.row_no, c.col_no, CASE WHEN u.f > 0 THEN regexp_replace(regexp_replace(c.value, '^BQ', 'Q'), '^comment$', 'notes') ELSE c.value END AS value
  FROM upload u JOIN survey_cells c ON c.sheet = u.sheet, (VALUES (0), (1)) p(part) WHERE u.f < 3 AND (p.part = 0 OR (u.f = 2 AND u.kind = 'survey_sheets'))),
{_survey_sql('filed', 'file_cells', 'file_id, sheet').strip()},
filed_cols AS (SELECT file_id, sheet, col_no, count(*) AS non_empty, count_if({numeric_like_sql('value')}) AS numeric_like, count_if({text_rich_sql('value')}) AS text_like,
    sum(length(value)) FILTER ({text_rich_sql('value')}) AS text_chars FROM file_cells WHERE row_no > 0 AND value <> '' GROUP BY ALL),
filed_text AS (SELECT p.*, h.value AS label, {k.contains_any('lower(h.value)', fv.SHEET_HEADER_HINTS)} AS hinted, {k.contains_any('lower(h.value)', fv.SHEET_META_HINTS)} AS meta, coalesce(CASE WHEN {k.contains_any('lower(h.value)', fv.SHEET_TEXT_HINTS)} THEN text_like > 0
    ELSE text_like >= 2 AND text_chars / text_like >= 8 END, false) AS is_text FROM filed_cols p LEFT JOIN file_cells h ON h.file_id = p.file_id AND h.sheet = p.sheet AND h.col_no = p.col_no AND h.row_no = 0 AND h.value <> ''),
filed_score AS (
  SELECT s.file_id, s.sheet, least(r.data_rows, 50) * 0.08::DOUBLE + s.text_columns * 1.2::DOUBLE + s.meta_columns * 0.2::DOUBLE + t.response_rows * 0.15::DOUBLE + s.hints * 0.6::DOUBLE - s.ratio * 1.5::DOUBLE AS score
  FROM (SELECT file_id, sheet, sum(numeric_like)::DOUBLE / sum(non_empty) AS ratio, count_if(is_text) AS text_columns, count_if(NOT is_text AND coalesce(meta, false)) AS meta_columns, count_if(coalesce(hinted, false)) AS hints FROM filed_text GROUP BY ALL) s
  JOIN (SELECT file_id, sheet, count(DISTINCT row_no) AS data_rows FROM file_cells WHERE row_no > 0 AND value <> '' GROUP BY ALL) r USING (file_id, sheet)
  JOIN (SELECT c.file_id, c.sheet, count(DISTINCT row_no) AS response_rows FROM file_cells c JOIN filed_text t ON t.file_id = c.file_id AND t.sheet = c.sheet AND t.col_no = c.col_no AND t.is_text WHERE row_no > 0 AND value <> '' AND {text_rich_sql('value')} GROUP BY ALL) t USING (file_id, sheet)
  WHERE s.text_columns > 0 AND r.data_rows >= 2 AND t.response_rows >= 2 AND s.ratio <= {fv.NUMERIC_RATIO_MAX}),
pick_s AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS second FROM filed WINDOW w AS (PARTITION BY file_id ORDER BY score DESC, sheet)),
pick_r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS second FROM filed_score WINDOW w AS (PARTITION BY file_id ORDER BY score DESC, sheet)),
routes AS (
  SELECT u.file_id, u.kind, CASE WHEN kind = 'text' THEN 'plain' WHEN s.file_id IS NOT NULL THEN CASE WHEN s.second IS NULL OR s.score >= s.second + {fv.SELECTION_MARGIN} THEN 'survey' END
      WHEN kind = 'survey_csv' THEN 'rows' WHEN r.file_id IS NOT NULL AND (r.second IS NULL OR r.score >= r.second + {fv.SELECTION_MARGIN}) THEN 'responses' END AS reading,
    s.sheet AS s_sheet, r.sheet AS r_sheet, s.header_row FROM upload u LEFT JOIN pick_s s ON s.file_id = u.file_id AND s.rk = 1 LEFT JOIN pick_r r ON r.file_id = u.file_id AND r.rk = 1)""",
    "survey_cells",
)


def _uploads(spark, sf):
    sheets = survey_cells(spark, sf)
    part = F.explode(F.expr("if(f = 2 AND sheet % 2 = 0, array(0L, 1L), array(0L))"))
    plain_value = F.regexp_replace(F.regexp_replace("value", "^BQ", "Q"), "^comment$", "notes")
    numbered = sheets.withColumn("f", F.explode(F.array(*map(F.lit, range(4)))))
    file_id = (F.col("sheet") * 4 + F.col("f")).alias("file_id")
    kind = F.when(F.col("f") == 3, "text").when((F.col("sheet") + F.col("f")) % 2 == 0, "survey_sheets").otherwise("survey_csv")
    listed = v.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("sheet")).distinct()
    files = listed.withColumn("f", F.explode(F.array(*map(F.lit, range(4))))).select(file_id, kind.alias("kind"))
    file_cells = numbered.filter("f < 3").withColumn("part", part).select(
        file_id, F.col("part").alias("sheet"), "row_no", "col_no", F.when(F.col("f") > 0, plain_value).otherwise(F.col("value")).alias("value")
    )
    plain = numbered.filter("f = 3 AND col_no = 2 AND value <> ''").select(file_id, F.concat(F.lit("full."), F.col("row_no").cast("string")).alias("locator"), F.col("value").alias("text"))
    return files, file_cells, plain


@register(
    "src_survey_route",
    C.query(
        "SELECT file_id, reading, (CASE reading WHEN 'survey' THEN s_sheet WHEN 'responses' THEN r_sheet END)::VARCHAR AS sheet, (CASE WHEN reading = 'survey' THEN header_row END)::VARCHAR AS header_row, "
        "CASE WHEN reading IS NULL THEN file_id || ': sheet structure is ambiguous' END AS warning FROM routes",
        "file_cells",
    ),
)
def src_survey_route(spark, sf):
    files, file_cells, _ = _uploads(spark, sf)
    routes = fb.route_survey_files(files, stored(fb.cell_facts(file_cells)))
    return routes.withColumns({c: F.col(c).cast("string") for c in ("sheet", "header_row")})


@register(
    "src_survey_segments",
    C.query(
        f"""SELECT r.file_id, reading, c.sheet || '.row.' || (c.row_no - r.header_row) AS locator, string_agg(q.header || ': ' || {k.norm('c.value')}, ' | ' ORDER BY c.col_no) AS text
FROM routes r JOIN filed_kind q ON q.file_id = r.file_id AND q.sheet = r.s_sheet AND q.header_row = r.header_row AND q.freely AND NOT q.is_question
JOIN file_cells c ON c.file_id = r.file_id AND c.sheet = r.s_sheet AND c.col_no = q.col_no AND c.row_no > r.header_row AND {text_rich_sql('c.value')} WHERE reading = 'survey' GROUP BY r.file_id, reading, c.sheet, c.row_no, r.header_row
UNION ALL SELECT r.file_id, reading, c.sheet || '.row.' || c.row_no, string_agg(coalesce(nullif({k.norm('lower(t.label)')}, ''), 'column ' || (c.col_no + 1)) || ': ' || {k.norm('c.value')}, ' | ' ORDER BY NOT (NOT t.is_text AND coalesce(t.meta, false)), c.col_no)
FROM routes r JOIN filed_text t ON t.file_id = r.file_id AND t.sheet = r.r_sheet AND (t.is_text OR coalesce(t.meta, false))
JOIN file_cells c ON c.file_id = r.file_id AND c.sheet = r.r_sheet AND c.col_no = t.col_no AND c.row_no > 0 AND {k.norm('c.value')} <> '' WHERE reading = 'responses' GROUP BY r.file_id, reading, c.sheet, c.row_no
UNION ALL SELECT r.file_id, reading, 'row.' || c.row_no, string_agg(coalesce(nullif({k.norm('h.value')}, ''), 'column') || ': ' || {k.norm('c.value')}, ' | ' ORDER BY c.col_no)
FROM routes r JOIN file_cells c ON c.file_id = r.file_id AND c.row_no > 0 AND {k.norm('c.value')} <> '' JOIN file_cells h ON h.file_id = c.file_id AND h.sheet = c.sheet AND h.row_no = 0 AND h.col_no = c.col_no WHERE reading = 'rows' GROUP BY r.file_id, reading, c.row_no
UNION ALL SELECT r.file_id, reading, 'full.' || c.row_no, c.value FROM routes r JOIN upload u ON u.file_id = r.file_id JOIN survey_cells c ON c.sheet = u.sheet AND c.col_no = 2 AND c.value <> '' WHERE reading = 'plain'""",
        "file_cells",
    ),
)
def src_survey_segments(spark, sf):
    files, file_cells, plain = _uploads(spark, sf)
    file_cells = stored(file_cells)
    facts = stored(fb.cell_facts(file_cells))
    routes = stored(fb.route_survey_files(files, facts))
    return fb.routed_segments(routes, file_cells, plain, facts)


# --- responses ---------------------------------------------------------------------
C.add(
    "responses",
    "responses AS (SELECT 'src' || (conv_id % 20) AS instructor, conv_id AS source_id, turn AS seq, " + k.norm("text") + " AS text FROM conversations WHERE role = 'user')",
)
POSITIVE = (("the", "clear"), ("tion", "practical"), ("der", "structured"), ("que", "examples"), ("ing", "clear"))
NEGATIVE = (("and", "pace"), ("ent", "pace"), ("los", "material"), ("zzz", "never"))
RULES = (("slow down", ("thand", "enst")), ("more practice", ("eau", "ción")), ("fix setup", ("qqq",)))
CATALOG = (("slow down", "high", "pace", "leave more time"), ("fix setup", "low", "setup", "prepare the machines"))


def responses(spark, sf):
    rows = v.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return rows.select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("instructor"), F.col("conv_id").alias("source_id"),
        F.col("turn").alias("seq"), fb.normalize_text("text").alias("text"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else k.q(x) for x in row) + ")" for row in rows)


def _label_sql(name: str, hints) -> str:
    return f"""
{name}_h AS (SELECT * FROM (VALUES {_values((i, n, lb) for i, (n, lb) in enumerate(hints))}) h(ord, needle, label)),
{name} AS (SELECT instructor, label, row_number() OVER (PARTITION BY instructor ORDER BY n DESC, seen) AS rank FROM (
  SELECT instructor, label, count(*) AS n, min({{'a': source_id, 'b': seq, 'c': ord}}) AS seen FROM responses JOIN {name}_h ON contains(text, needle) WHERE text <> '' GROUP BY ALL) QUALIFY rank <= 4)"""


C.add(
    "voc_labels",
    f"""{_label_sql('pos_l', POSITIVE).strip()},
{_label_sql('neg_l', NEGATIVE).strip()},
voc_tok AS (SELECT instructor, source_id, seq, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM (SELECT *, {k.tok('text')} AS ts FROM responses WHERE instructor NOT IN (SELECT instructor FROM pos_l))),
tok_l AS (SELECT instructor, token AS label, row_number() OVER (PARTITION BY instructor ORDER BY n DESC, seen) AS rank FROM (
  SELECT instructor, token, count(*) AS n, min({{'a': source_id, 'b': seq, 'c': pos}}) AS seen FROM voc_tok GROUP BY ALL) QUALIFY rank <= 4),
def_l AS (SELECT instructor, label, rank FROM (SELECT DISTINCT instructor FROM responses WHERE text <> '' AND instructor NOT IN (SELECT instructor FROM neg_l)), (VALUES {_values((lb, i + 1) for i, lb in enumerate(fv.DEFAULT_NEGATIVES))}) d(label, rank)),
voc_labels AS (SELECT *, 'positive' AS polarity FROM pos_l UNION ALL SELECT *, 'positive' FROM tok_l UNION ALL SELECT *, 'negative' FROM neg_l UNION ALL SELECT *, 'negative' FROM def_l)""",
    "responses",
)


def labels(spark, sf):
    return fb.sentiment_labels(responses(spark, sf), fb.hint_table(spark, POSITIVE, NEGATIVE))


@register("voc_sentiment", C.query("SELECT instructor, label, rank::BIGINT AS rank, polarity FROM voc_labels", "voc_labels"))
def voc_sentiment(spark, sf):
    return labels(spark, sf).withColumn("rank", F.col("rank").cast("long"))


C.add(
    "voc_complaints",
    f"""
rule_n AS (SELECT * FROM (VALUES {_values((i, lb, n) for i, (lb, ns) in enumerate(RULES) for n in ns)}) r(ord, label, needle)),
rule_hit AS (SELECT DISTINCT instructor, source_id, seq, ord, label, regexp_extract(text, {k.q(fv.WEEK_MENTION)}, 1) AS week FROM responses JOIN rule_n ON contains(text, needle)),
rule_cnt AS (SELECT instructor, label, count(*) AS n, min({{'a': source_id, 'b': seq, 'c': ord}}) AS seen, arg_min(week, {{'a': source_id, 'b': seq}}) AS week FROM rule_hit GROUP BY ALL),
rule_top AS (SELECT instructor, label AS pattern, n, week, row_number() OVER (PARTITION BY instructor ORDER BY n DESC, seen) AS rank FROM rule_cnt QUALIFY rank <= 3),
voc_complaints AS (SELECT * FROM rule_top UNION ALL
  SELECT l.instructor, l.label || ' 관련 피드백 반복', greatest(1, t.n // 3), '', 1 FROM voc_labels l JOIN (SELECT instructor, count(*) AS n FROM responses WHERE text <> '' GROUP BY ALL) t USING (instructor)
  WHERE l.polarity = 'negative' AND l.rank = 1 AND l.instructor NOT IN (SELECT instructor FROM rule_top))""",
    "responses", "voc_labels",
)


def complaint_rows(spark, sf, label_rows=None):
    label_rows = labels(spark, sf) if label_rows is None else label_rows
    return fb.complaints(responses(spark, sf), label_rows, fb.rule_table(spark, RULES))


@register("voc_complaints", C.query("SELECT instructor, pattern, n::BIGINT AS n, week, rank::BIGINT AS rank FROM voc_complaints", "voc_complaints"))
def voc_complaints(spark, sf):
    return complaint_rows(spark, sf).withColumn("rank", F.col("rank").cast("long"))


# catalogues from a table: every word of the benchmark passages is a needle
C.add(
    "needle_words",
    """
needle_words AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS ord FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 3),
hint_rows AS (SELECT CASE WHEN length(word) % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity, ord, word AS needle, substr(word, 1, 2) AS label FROM needle_words),
hint_top AS (SELECT instructor, polarity, label, n, row_number() OVER (PARTITION BY instructor, polarity ORDER BY n DESC, seen) AS rank FROM (
  SELECT instructor, polarity, label, count(*) AS n, min({'a': source_id, 'b': seq, 'c': ord}) AS seen FROM responses JOIN hint_rows ON contains(text, needle) WHERE text <> '' GROUP BY ALL) QUALIFY rank <= 4),
rule_rows AS (SELECT dense_rank() OVER (ORDER BY substr(word, 1, 2)) - 1 AS ord, substr(word, 1, 2) AS label, word AS needle FROM needle_words),
rule_found AS (SELECT DISTINCT instructor, source_id, seq, ord, label FROM responses JOIN rule_rows ON contains(text, needle) WHERE text <> ''),
rule_best AS (SELECT instructor, label, n, row_number() OVER (PARTITION BY instructor ORDER BY n DESC, seen) AS rank FROM (
  SELECT instructor, label, count(*) AS n, min({'a': source_id, 'b': seq, 'c': ord}) AS seen FROM rule_found GROUP BY ALL) QUALIFY rank <= 3)""",
    "responses",
)


def _needle_words(spark, sf):
    words = v.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    distinct = words.filter(F.length("word") >= 3).distinct()
    return dense_positions(distinct, [], "word").withColumnRenamed("pos", "ord")


@register("voc_hint_table", C.query("SELECT instructor, polarity, label, rank::BIGINT AS rank FROM hint_top", "needle_words"))
def voc_hint_table(spark, sf):
    polarity = F.when(F.length("word") % 2 == 0, "positive").otherwise("negative")
    hints = _needle_words(spark, sf).select(
        polarity.alias("polarity"), "ord", F.col("word").alias("needle"), F.substring("word", 1, 2).alias("label")
    )
    # every instructor has labels of both kinds here, so no fall-back is taken
    found = fb.sentiment_labels(responses(spark, sf), hints)
    return found.select("instructor", "polarity", "label", F.col("rank").cast("long").alias("rank"))


@register("voc_rule_table", C.query("SELECT instructor, label AS pattern, n, rank::BIGINT AS rank FROM rule_best", "needle_words"))
def voc_rule_table(spark, sf):
    words = _needle_words(spark, sf).select(F.col("word").alias("needle"), F.substring("word", 1, 2).alias("label"))
    numbers = dense_positions(words.select("label").distinct(), [], "label").withColumnRenamed("pos", "ord")
    rules = words.join(numbers, "label").select("ord", "label", "needle")
    found = fb.complaints(responses(spark, sf), labels(spark, sf), rules)
    return found.select("instructor", "pattern", "n", F.col("rank").cast("long").alias("rank"))


C.add(
    "voc_suggestions",
    f"""
sug_hit AS (SELECT instructor, rank, priority, s.label, s.body FROM voc_complaints JOIN (VALUES {_values(CATALOG)}) s(pattern, priority, label, body) USING (pattern)),
voc_suggestions AS (SELECT * FROM sug_hit UNION ALL SELECT DISTINCT instructor, 1, {k.q(fv.DEFAULT_SUGGESTION[0])}, {k.q(fv.DEFAULT_SUGGESTION[1])}, {k.q(fv.DEFAULT_SUGGESTION[2])} FROM voc_complaints WHERE instructor NOT IN (SELECT instructor FROM sug_hit))""",
    "voc_complaints",
)


@register("voc_suggestions", C.query("SELECT instructor, rank::BIGINT AS rank, priority, label, body FROM voc_suggestions", "voc_suggestions"))
def voc_suggestions(spark, sf):
    return fb.suggestions(complaint_rows(spark, sf), CATALOG).withColumn("rank", F.col("rank").cast("long"))


C.add(
    "voc_sum",
    """
voc_items AS (
  SELECT polarity AS kind, label, 1 AS n, '' AS detail, instructor, rank FROM voc_labels UNION ALL SELECT 'complaint', pattern, n, week, instructor, rank FROM voc_complaints
  UNION ALL SELECT 'suggestion', label, 1, priority, instructor, rank FROM voc_suggestions),
voc_sum AS (SELECT kind, label, n, detail, row_number() OVER (PARTITION BY kind ORDER BY n DESC, seen) AS rank FROM (
  SELECT kind, label, sum(n)::BIGINT AS n, min({'a': io, 'b': rank}) AS seen, arg_min(detail, {'a': io, 'b': rank}) AS detail FROM (SELECT *, substr(instructor, 4)::INT AS io FROM voc_items) GROUP BY ALL)
  QUALIFY rank <= CASE WHEN kind IN ('positive', 'negative') THEN 6 ELSE 4 END)""",
    "voc_labels", "voc_complaints", "voc_suggestions",
)


def _voc_parts(spark, sf):
    label_rows = labels(spark, sf)
    complaint = complaint_rows(spark, sf, label_rows)
    return label_rows, complaint, fb.suggestions(complaint, CATALOG)


def _ords(spark, sf):
    return responses(spark, sf).select("instructor").distinct().withColumn("instructor_ord", F.substring("instructor", 4, 10).cast("int"))


@register("voc_summary", C.query("SELECT kind, label, n, detail, rank FROM voc_sum", "voc_sum"))
def voc_summary(spark, sf):
    return fb.voc_summary(*_voc_parts(spark, sf), _ords(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


C.add(
    "scores",
    """
scores AS (
  SELECT 's' || l_suppkey AS instructor, 'bq' || (l_linenumber % 3 + 1) AS grp, 'BQ' || (l_linenumber % 3 + 1) || '-' || l_linenumber AS question_id,
    'question ' || l_linenumber AS label, 5 AS scale_max, 1 + floor(l_quantity)::BIGINT % 5 AS average, 1 + l_orderkey % 4 AS response_count, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)""",
)


def scores(spark, sf):
    number = F.col("l_linenumber").cast("string")
    group = (F.col("l_linenumber") % 3 + 1).cast("string")
    return v.table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("instructor"),
        F.concat(F.lit("bq"), group).alias("grp"),
        F.concat(F.lit("BQ"), group, F.lit("-"), number).alias("question_id"),
        F.concat(F.lit("question  "), number).alias("label"),
        F.lit(5).alias("scale_max"),
        (1 + F.floor("l_quantity") % 5).cast("double").alias("average"),
        (1 + F.col("l_orderkey") % 4).alias("response_count"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


_QSUM = "round(sum(average * response_count)::DOUBLE / sum(response_count), 2) AS average, sum(response_count)::BIGINT AS response_count, min(seq) AS seq"


@register("agg_question_means", C.query(f"SELECT instructor, upper(grp) AS grp, question_id, label, 5::BIGINT AS scale_max, {_QSUM} FROM scores GROUP BY instructor, upper(grp), question_id, label", "scores"))
def agg_question_means(spark, sf):
    return co.aggregate_scores(scores(spark, sf), ("instructor",)).withColumn("scale_max", F.col("scale_max").cast("long"))


@register(
    "agg_question_groups",
    C.query(
        f"SELECT instructor, grp, string_agg(question_id || '=' || response_count, ', ' ORDER BY seq) AS entries FROM (SELECT instructor, upper(grp) AS grp, question_id, {_QSUM} FROM scores GROUP BY instructor, upper(grp), question_id) GROUP BY ALL",
        "scores",
    ),
)
def agg_question_groups(spark, sf):
    grouped = co.group_scores(co.aggregate_scores(scores(spark, sf), ("instructor",)), ("instructor",))
    return grouped.select("instructor", "grp", F.expr("array_join(transform(entries, e -> concat(e.question_id, '=', e.response_count)), ', ')").alias("entries"))


C.add(
    "voc_files",
    "voc_files AS (SELECT 'src' || (conv_id % 20) AS instructor, conv_id AS file_ord, CASE conv_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'text' ELSE 'pdf' END AS source_type, count(*) AS rows, "
    f"sum(greatest(1, len(list_filter(string_split(replace(text, ',', '|'), '|'), lambda p: trim(p) <> ''))))::BIGINT AS parts, count(*) AS segments, max(turn) AS question_responses FROM conversations GROUP BY ALL)",
)


def _files(spark, sf):
    rows = v.table(spark, sf, "conversations").withColumn("t", F.replace("text", F.lit(","), F.lit("|")))
    kind = F.col("conv_id") % 3
    return rows.groupBy(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("instructor"), F.col("conv_id").alias("file_ord")).agg(
        F.count("*").alias("rows"), F.sum(fb.text_parts("t")).alias("parts"), F.count("*").alias("segments"), F.max("turn").alias("question_responses"),
    ).withColumn("kind", F.col("file_ord") % 3).withColumn(
        "source_type", F.when(F.col("kind") == 0, "csv").when(F.col("kind") == 1, "text").otherwise("pdf")
    ).withColumn("course_id", F.lit("c"))


@register(
    "voc_response_counts",
    C.query("SELECT instructor, sum(greatest(CASE source_type WHEN 'csv' THEN rows WHEN 'text' THEN parts ELSE segments END, question_responses, segments))::BIGINT AS response_count FROM voc_files GROUP BY ALL", "voc_files"),
)
def voc_response_counts(spark, sf):
    return fb.response_counts(_files(spark, sf)).drop("course_id")


C.add(
    "voc_record",
    """
voc_record AS (
  SELECT f.instructor, CASE WHEN f.n = 1 THEN f.one ELSE f.one || ' 외 ' || (f.n - 1) || '개' END AS file_name,
    (SELECT string_agg(label, ',' ORDER BY rank) FROM voc_labels l WHERE l.instructor = f.instructor AND polarity = 'positive') AS positive,
    (SELECT string_agg(pattern || ':' || n, ',' ORDER BY rank) FROM voc_complaints c WHERE c.instructor = f.instructor) AS complaints,
    (SELECT string_agg(label, ',' ORDER BY rank) FROM voc_suggestions s WHERE s.instructor = f.instructor) AS suggestions
  FROM (SELECT instructor, count(*) AS n, 'file-' || min(file_ord) AS one FROM voc_files GROUP BY ALL) f)""",
    "voc_files", "voc_labels", "voc_complaints", "voc_suggestions",
)


def _records(spark, sf):
    files = _files(spark, sf).withColumn("file_name", F.concat(F.lit("file-"), F.col("file_ord").cast("string")))
    counts = fb.response_counts(files).drop("course_id")
    means = co.aggregate_scores(scores(spark, sf), ("instructor",))
    label_rows, complaint, suggested = _voc_parts(spark, sf)
    record = fb.voc_by_instructor(files, counts, means, label_rows, complaint, suggested)
    return record, means, (label_rows, complaint, suggested)


@register("voc_records", C.query("SELECT * FROM voc_record", "voc_record"))
def voc_records(spark, sf):
    record = _records(spark, sf)[0]
    return record.select(
        "instructor", "file_name", F.array_join("positive.label", ",").alias("positive"),
        F.expr("array_join(transform(complaints, c -> concat(c.pattern, ':', c.n)), ',')").alias("complaints"),
        F.array_join("suggestions.label", ",").alias("suggestions"),
    )


@register(
    "voc_review",
    C.query(
        "SELECT instructor AS name, coalesce(positive, '') AS positive, 0::BIGINT AS groups FROM voc_record UNION ALL SELECT '(all)', (SELECT string_agg(label, ',' ORDER BY rank) FROM voc_sum WHERE kind = 'positive'), (SELECT count(DISTINCT grp) FROM scores)",
        "voc_record", "voc_sum", "scores",
    ),
)
def voc_review(spark, sf):
    record, means, parts = _records(spark, sf)
    review = fb.review_table(record, fb.voc_summary(*parts, _ords(spark, sf)), means)
    return review.select(
        "name", F.array_join(F.coalesce("positive.label", F.expr("cast(array() AS array<string>)")), ",").alias("positive"),
        F.expr("bigint(coalesce(nullif(size(score_groups), -1), 0))").alias("groups"),
    )


@register(
    "voc_attach",
    C.query(
        "SELECT d.course_id, d.instructor, d.n AS documents, coalesce(f.n, 0) AS voc_file_count, coalesce(r.response_count, 0) AS response_count FROM (SELECT 'c' AS course_id, source AS instructor, count(*) AS n FROM documents GROUP BY ALL) d "
        "LEFT JOIN (SELECT instructor, count(*) AS n FROM voc_files GROUP BY ALL) f USING (instructor) LEFT JOIN (SELECT instructor, sum(segments)::BIGINT AS response_count FROM voc_files GROUP BY ALL) r USING (instructor)",
        "voc_files",
    ),
)
def voc_attach(spark, sf):
    summaries = v.table(spark, sf, "documents").groupBy(F.lit("c").alias("course_id"), F.col("source").alias("instructor")).agg(F.count("*").alias("documents"))
    files = _files(spark, sf)
    voc = files.groupBy("course_id", "instructor").agg(F.sum("segments").alias("response_count"))
    return co.attach_voc(summaries, files, voc).withColumn("response_count", F.coalesce("response_count", F.lit(0)))


@register(
    "voc_external",
    """WITH g AS (SELECT conv_id::VARCHAR AS instructor, list(CASE WHEN turn % 2 = 0 THEN ' p' || turn || ' ' ELSE '  ' END ORDER BY turn) AS p, count_if(turn % 3 = 0) AS c3,
  list(CASE WHEN turn % 3 = 0 THEN 'c' || turn || ':' || greatest(1, turn) END ORDER BY turn) AS cs FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT instructor, CASE WHEN len(ps) > 0 THEN array_to_string(ps[1:6], ',') ELSE 'rule' END AS positive, CASE WHEN len(cl) > 0 THEN array_to_string(cl[1:3], ',') ELSE 'rule:1' END AS complaints
FROM (SELECT instructor, list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> '') AS ps, list_filter(cs, lambda x: x IS NOT NULL) AS cl FROM g)""",
)
def voc_external(spark, sf):
    rows = v.table(spark, sf, "conversations").filter(F.col("role") == "user")
    turn = F.col("turn").cast("string")
    item = F.struct(
        "turn",
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" p"), turn, F.lit(" "))).otherwise("  ").alias("p"),
        F.struct(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("c"), turn)).otherwise(" ").alias("pattern"), F.col("turn").alias("count")).alias("c"),
    )
    external = rows.groupBy(F.col("conv_id").cast("string").alias("instructor")).agg(F.sort_array(F.collect_list(item)).alias("x")).select(
        "instructor",
        F.to_json(F.struct(F.struct(F.col("x.p").alias("positive")).alias("sentiment"), F.col("x.c").alias("repeated_complaints"))).alias("raw"),
    )
    rule = F.expr("array('rule')")
    fallback = external.select(
        "instructor", rule.alias("positive"), rule.alias("negative"),
        F.expr("array(named_struct('pattern', 'rule', 'count', 1, 'week', ''))").alias("complaints"),
        F.expr("array(named_struct('priority', 'low', 'label', 'rule', 'body', 'rule'))").alias("suggestions"),
    )
    merged = fb.merge_external_voc(external, fallback)
    return merged.select(
        "instructor", F.array_join("positive", ",").alias("positive"),
        F.expr("array_join(transform(complaints, c -> concat(c.pattern, ':', c.count)), ',')").alias("complaints"),
    )
