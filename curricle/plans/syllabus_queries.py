"""Curriculum structure queries on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.operators import ranking as rk
from curricle.operators import syllabus as sy
from curricle.plans import sqlkit as k
from curricle.plans import views as v
from curricle.plans.registry import register
from curricle.plans.text_queries import metric_sql, sql_no_boundary, strip_sql, trim_title_sql, week_sql
from curricle.plans.views import C

_STYLE = (
    "CASE p_partkey % 7 WHEN 0 THEN '1) ' || p_name || ': ' || p_type || ' ' || p_size || '%' WHEN 1 THEN '- ' || p_name || ' ' || p_size || '강' "
    "WHEN 2 THEN p_name || ' 학습 목표 ' || p_size || '주차' WHEN 3 THEN '면접 ' || p_name || ' ' || p_size || '시간' WHEN 4 THEN '강사 ' || p_name "
    "WHEN 5 THEN '  ' || p_name || ' | ' || p_type || ' and more words here ' || p_size || '일' ELSE p_type END"
)
C.add(
    "plan_doc",
    f"plan_doc AS (SELECT p_brand AS doc_id, (p_partkey % 5 + 1)::BIGINT AS page, p_partkey AS line_no, raw_line, {k.norm('raw_line')} AS line FROM (SELECT *, {_STYLE} AS raw_line FROM part))",
)


def plan_doc(spark, sf):
    """Syllabus lines of all layouts; one document per brand."""
    style, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    c, t = F.concat, F.lit
    raw = (
        F.when(style == 0, c(t("1) "), "p_name", t(": "), "p_type", t(" "), size, t("%")))
        .when(style == 1, c(t("- "), "p_name", t(" "), size, t("강")))
        .when(style == 2, c("p_name", t(" 학습 목표 "), size, t("주차")))
        .when(style == 3, c(t("면접 "), "p_name", t(" "), size, t("시간")))
        .when(style == 4, c(t("강사 "), "p_name"))
        .when(style == 5, c(t("  "), "p_name", t(" | "), "p_type", t(" and more words here "), size, t("일")))
        .otherwise(F.col("p_type"))
    )
    return v.table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), (F.col("p_partkey") % 5 + 1).alias("page"), F.col("p_partkey").alias("line_no"), raw.alias("raw_line")
    )


def _pt(cond: str, n: int) -> str:
    return f"CASE WHEN {cond} THEN {n} ELSE 0 END"


def _re(p: str) -> str:
    return f"regexp_matches(line, {k.q(sql_no_boundary(p))})"


_SCORE = " + ".join([
    _pt(f"regexp_matches(raw_line, {k.q(fv.LIST_PREFIX)})", 4), _pt(_re(fv.PERCENT), 5), _pt(_re(fv.LECTURES), 4), _pt(_re(fv.HOURS), 4),
    _pt(f"{_re(fv.WEEK_RANGE)} OR {_re(fv.WEEKS)} OR {_re(fv.DAYS)}", 3), _pt(_re(fv.SECTION_SEPARATOR), 2), _pt("length(line) <= 80", 1),
    _pt("len(list_filter(string_split(line, ' '), lambda w: w <> '')) BETWEEN 4 AND 20", 1), f"{k.hits('line', fv.CURRICULUM_HINTS)} * 3",
    f"{k.hits('line', fv.COUNTER_HINTS)} * -4", _pt(k.contains_any("line", fv.GOAL_WORDS), 2), _pt("length(line) > 120", -1),
])
C.add("scored_lines", f"scored_lines AS (SELECT *, ({_SCORE})::BIGINT AS score FROM plan_doc)", "plan_doc")


@register("cur_line_scores", C.query("SELECT doc_id, line_no, score FROM scored_lines", "scored_lines"))
def cur_line_scores(spark, sf):
    return sy.score_lines(plan_doc(spark, sf)).select("doc_id", "line_no", F.col("score").cast("long").alias("score"))


_VALUE, _SOURCE = metric_sql("cl")
C.add(
    "heur",
    f"""
heur_first AS (SELECT doc_id, lower(line) AS ky, arg_min({{'n': line_no, 'p': page, 's': score, 'l': line}}, line_no) AS b FROM scored_lines
  WHERE length(line) >= 4 AND NOT {k.contains_any('line', fv.IGNORED_LINE_WORDS)} AND score > 1 GROUP BY ALL),
heur_top AS (SELECT doc_id, b.n AS line_no, b.p AS page, b.l AS line FROM heur_first QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b.s DESC, b.n) <= 8),
heur_cl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS section_ord, trim(regexp_replace(line, {k.q(fv.LIST_PREFIX)}, '')) AS cl FROM heur_top),
heur_pt AS (SELECT *, regexp_matches(cl, {k.q(fv.SECTION_SEPARATOR)}) AND trim(regexp_extract(cl, '^(.*?)[|:：]', 1)) <> '' AS has, trim(regexp_extract(cl, '^(.*?)[|:：]', 1)) AS hd,
    trim(regexp_replace(cl, '^.*?[|:：]\\s*', '')) AS tl, {strip_sql('cl')} AS st FROM heur_cl),
heur AS (SELECT doc_id, section_ord, page, cl, CASE WHEN has THEN hd ELSE coalesce(nullif({trim_title_sql('st')}, ''), '섹션 ' || section_ord) END AS title,
    CASE WHEN has THEN CASE WHEN tl = '' THEN hd ELSE tl END ELSE cl END AS description, {_VALUE} AS raw_weight, {_SOURCE} AS weight_source FROM heur_pt)""",
    "scored_lines",
)


def heuristic(spark, sf):
    return sy.heuristic_sections(plan_doc(spark, sf))


@register("cur_heuristic", C.query("SELECT doc_id, section_ord, page, title, description, raw_weight, weight_source FROM heur", "heur"))
def cur_heuristic(spark, sf):
    return heuristic(spark, sf).select(
        "doc_id", F.col("section_ord").cast("long").alias("section_ord"), "page", "title", "description", "raw_weight", "weight_source"
    )


# --- timetables
_SLOT = (
    "CASE p_partkey % 6 WHEN 0 THEN p_size || '주 계획' WHEN 1 THEN CASE WHEN p_brand = 'Brand#9' THEN p_type ELSE '월 화 수 목 금 토 일' END "
    "WHEN 2 THEN '  오전  ' || p_type || '  3/4  ' || p_name ELSE '오후  ' || p_type || '   오전' END"
)
C.add(
    "slots",
    f"""
slot_lines AS (SELECT p_brand AS doc_id, p_partkey AS line_no, (p_partkey % 5 + 1)::BIGINT AS page, {_SLOT} AS raw_line FROM part),
slot_rows AS (SELECT *, {k.norm('raw_line')} AS line, regexp_matches({k.norm('raw_line')}, '^\\d+\\s*주([^\\p{{L}}\\p{{N}}_]|$)') AS is_week, regexp_matches({k.norm('raw_line')}, '^(오전|오후|저녁|야간)([^\\p{{L}}\\p{{N}}_]|$)') AS is_session,
  list_filter(list_transform(string_split_regex(trim(raw_line), '\\s{{2,}}'), lambda p: trim(p)), lambda p: p <> '') AS cols FROM slot_lines),
slot_subj AS (SELECT *, CASE WHEN is_session THEN list_filter(cols[2:], lambda p: NOT regexp_matches(p, '^\\d{{1,2}}/\\d{{1,2}}$') AND p NOT IN ('오전', '오후', '저녁', '야간')) ELSE [] END AS subj FROM slot_rows),
slot_fact AS (SELECT doc_id, bool_or(contains(line, '월') AND contains(line, '화') AND contains(line, '수') AND contains(line, '목') AND contains(line, '금') AND contains(line, '토') AND contains(line, '일')) AS wd,
  count_if(is_week) AS weeks, count_if(is_session) AS sess, count_if(len(subj) > 0) AS mat FROM slot_subj GROUP BY ALL),
slot_cnt AS (SELECT doc_id, s AS subject, count(*) AS slots, min({{'n': line_no, 'p': pos}}) AS seen, arg_min(page, line_no) AS page FROM (
  SELECT doc_id, line_no, page, unnest(subj) AS s, unnest(range(len(subj))) AS pos FROM slot_subj) GROUP BY ALL),
slot_tot AS (SELECT doc_id, count(*) AS ds, sum(slots) AS ts FROM slot_cnt GROUP BY ALL),
slot_conf AS (SELECT doc_id, round(least(0.99, CASE WHEN wd THEN 0.22 ELSE 0 END + CASE WHEN weeks >= 8 THEN 0.24 WHEN weeks >= 4 THEN 0.18 WHEN weeks >= 2 THEN 0.1 ELSE 0 END
  + CASE WHEN sess >= greatest(4, weeks) THEN 0.2 WHEN sess >= 2 THEN 0.12 ELSE 0 END + CASE WHEN mat >= greatest(3, weeks // 2) THEN 0.18 WHEN mat >= 2 THEN 0.1 ELSE 0 END
  + CASE WHEN ds >= 3 THEN 0.08 WHEN ds >= 2 THEN 0.04 ELSE 0 END + CASE WHEN ts >= greatest(8, ds * 3) THEN 0.08 ELSE 0 END), 2)::DOUBLE AS confidence FROM slot_fact JOIN slot_tot USING (doc_id)),
slots AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seen) AS section_ord, subject AS title, slots::DOUBLE AS raw_weight, page, confidence FROM slot_cnt JOIN slot_conf USING (doc_id) QUALIFY section_ord <= 8)""",
)


def schedule(spark, sf):
    style, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    c, t = F.concat, F.lit
    raw = (
        F.when(style == 0, c(size, t("주 계획")))
        .when(style == 1, F.when(F.col("p_brand") == "Brand#9", F.col("p_type")).otherwise("월 화 수 목 금 토 일"))
        .when(style == 2, c(t("  오전  "), "p_type", t("  3/4  "), "p_name"))
        .otherwise(c(t("오후  "), "p_type", t("   오전")))
    )
    lines = v.table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("line_no"), (F.col("p_partkey") % 5 + 1).alias("page"), raw.alias("raw_line")
    )
    return lines, sy.schedule_sections(lines)


@register("cur_schedule", C.query("SELECT * FROM slots", "slots"))
def cur_schedule(spark, sf):
    return schedule(spark, sf)[1].select("doc_id", F.col("section_ord").cast("long").alias("section_ord"), "title", "raw_weight", "page", "confidence")


C.add(
    "slot_sources",
    """
slot_each AS (SELECT x.doc_id, s.section_ord, x.page, x.line, x.line_no FROM (SELECT doc_id, page, line, line_no, unnest(subj) AS subject FROM slot_subj) x
  JOIN slots s ON s.doc_id = x.doc_id AND s.title = x.subject),
slot_distinct AS (SELECT doc_id, section_ord, line, min(line_no) AS n FROM slot_each GROUP BY ALL),
slot_lines3 AS (SELECT * FROM slot_distinct QUALIFY row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY n) <= 3),
slot_sources AS (SELECT doc_id, section_ord, (SELECT string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) FROM slot_each e WHERE e.doc_id = s.doc_id AND e.section_ord = s.section_ord) AS pages,
  (SELECT string_agg(line, ' / ' ORDER BY n) FROM slot_lines3 l WHERE l.doc_id = s.doc_id AND l.section_ord = s.section_ord) AS snippets FROM slots s)""",
    "slots",
)


@register("cur_schedule_sources", C.query("SELECT doc_id, section_ord, pages, snippets FROM slot_sources", "slot_sources"))
def cur_schedule_sources(spark, sf):
    lines, sections = schedule(spark, sf)
    got = sy.schedule_sources(lines, sections)
    return got.select(
        "doc_id",
        F.col("section_ord").cast("long").alias("section_ord"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.array_join("snippets", " / ").alias("snippets"),
    )


# --- roadmaps
_ROAD = (
    "CASE WHEN n % 4 = 3 THEN 'detail ' || p_type ELSE 'Chapter ' || n || ' ' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' 결정 트리 ' || p_size || '강' "
    "WHEN 1 THEN ' 1~' || p_size || '주차' ELSE ' ' || p_size || '강' END END"
)
C.add(
    "road",
    f"""
road_lines AS (SELECT p_brand AS doc_id, n, (n % 5 + 1)::BIGINT AS page, {_ROAD} AS line FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE p_brand <> 'Brand#2'),
road_blk AS (SELECT *, sum(CASE WHEN line LIKE 'Chapter %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section_ord FROM road_lines),
road_text AS (SELECT doc_id, section_ord::BIGINT AS section_ord, string_agg(line, ' ' ORDER BY n) AS block, arg_min(page, n) AS page FROM road_blk WHERE section_ord BETWEEN 1 AND 8 GROUP BY ALL),
road_head AS (SELECT *, regexp_extract(block, '^Chapter\\s+(\\d+)', 1) AS ch, {strip_sql("trim(regexp_replace(block, '(?i)^Chapter\\s+(\\d+)', ''))")} AS heading,
  try_cast(regexp_extract(block, {k.q(sql_no_boundary(fv.LECTURES))}, 1) AS DOUBLE) AS lec, {week_sql('block')} AS wk FROM road_text),
road_sec AS (SELECT *, coalesce(nullif(trim(regexp_extract(heading, '^([^가-힣]+)([가-힣].*)$', 1)), ''), heading) AS ht, coalesce(nullif(trim(regexp_extract(heading, '^([^가-힣]+)([가-힣].*)$', 2)), ''), heading) AS hd FROM road_head),
road0 AS (SELECT doc_id, section_ord, 'Chapter ' || ch || ': ' || ht AS title, CASE WHEN lec IS NOT NULL THEN hd || ' · 총 ' || lec::BIGINT || '강' ELSE hd END AS description, coalesce(lec, wk) AS raw_weight,
  CASE WHEN lec IS NOT NULL THEN 'lecture_count' WHEN wk IS NOT NULL THEN 'weeks' ELSE 'none' END AS weight_source, page, block FROM road_sec),
road AS (SELECT *, round(least(0.99::DOUBLE, CASE WHEN count(*) OVER d >= 5 THEN 0.34 WHEN count(*) OVER d >= 3 THEN 0.24 ELSE 0 END::DOUBLE + least(0.42::DOUBLE, count_if(weight_source = 'lecture_count') OVER d / count(*) OVER d * 0.42::DOUBLE)
  + least(0.08::DOUBLE, count_if(weight_source = 'weeks') OVER d / count(*) OVER d * 0.08::DOUBLE) + 0.12::DOUBLE), 2) AS confidence FROM road0 WINDOW d AS (PARTITION BY doc_id))""",
)


def roadmap(spark, sf):
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    rows = v.table(spark, sf, "part").withColumn("n", number)
    style, size, n = F.col("p_partkey") % 3, F.col("p_size").cast("string"), F.col("n").cast("string")
    c, t = F.concat, F.lit
    tail = F.when(style == 0, c(t(" 결정 트리 "), size, t("강"))).when(style == 1, c(t(" 1~"), size, t("주차"))).otherwise(c(t(" "), size, t("강")))
    line = F.when(F.col("n") % 4 == 3, c(t("detail "), "p_type")).otherwise(c(t("Chapter "), n, t(" "), "p_name", tail))
    body = rows.select(F.col("p_brand").alias("doc_id"), (F.col("n") % 5 + 1).alias("page"), F.col("n").alias("line_no"), line.alias("raw_line"))
    docs = body.select("doc_id").distinct()
    # Brand#2 has no start hint, so no roadmap is read from it
    start = docs.filter(F.col("doc_id") != "Brand#2").select("doc_id", t(1).cast("long").alias("page"), t(0).cast("long").alias("line_no"), t("강의 구성 로드맵").alias("raw_line"))
    stop = docs.select("doc_id", t(9).cast("long").alias("page"), t(10**9).cast("long").alias("line_no"), t("챕터별 강의 세부 계획").alias("raw_line"))
    return sy.roadmap_sections(body.unionByName(start).unionByName(stop))


_RC = "doc_id, section_ord, title, description, raw_weight, weight_source, page, confidence"
def _rcols():
    return ["doc_id", F.col("section_ord").cast("long").alias("section_ord"), "title", "description", "raw_weight", "weight_source", "page", "confidence"]



@register("cur_roadmap", C.query(f"SELECT {_RC} FROM road", "road"))
def cur_roadmap(spark, sf):
    return roadmap(spark, sf).select(*_rcols())


C.add(
    "struct",
    f"""
struct AS (SELECT doc_id, section_ord, title, raw_weight, confidence, page, block AS snippet, description, 'chapter_roadmap' AS kind FROM road WHERE confidence >= 0.84
  UNION ALL SELECT doc_id, section_ord, title, raw_weight, confidence, page, NULL, NULL, 'schedule_slots' FROM slots WHERE confidence >= 0.82 AND doc_id NOT IN (SELECT doc_id FROM road WHERE confidence >= 0.84))""",
    "road", "slots",
)


def structured(spark, sf):
    return sy.structured_sections(roadmap(spark, sf), schedule(spark, sf)[1])


@register("cur_structure_choice", C.query("SELECT doc_id, section_ord, title, raw_weight, confidence, kind FROM struct", "struct"))
def cur_structure_choice(spark, sf):
    return structured(spark, sf).select("doc_id", F.col("section_ord").cast("long").alias("section_ord"), "title", "raw_weight", "confidence", "kind")


_STATUS = (
    "CASE WHEN bool_or(weight_source = 'none' OR raw_weight IS NULL) AND bool_or(weight_source <> 'none') THEN 'inconsistent' "
    "WHEN bool_or(weight_source = 'none' OR raw_weight IS NULL) THEN 'missing' WHEN bool_and(weight_source = 'percent') THEN 'explicit' ELSE 'derivable' END"
)


@register(
    "cur_weight_status",
    C.query(f"SELECT doc_id, {_STATUS} AS weight_status FROM (SELECT doc_id, raw_weight, weight_source FROM heur UNION ALL SELECT 'r' || doc_id, raw_weight, weight_source FROM road) GROUP BY ALL", "heur", "road"),
)
def cur_weight_status(spark, sf):
    cols = ["doc_id", "raw_weight", "weight_source"]
    both = heuristic(spark, sf).select(*cols).unionByName(roadmap(spark, sf).withColumn("doc_id", F.concat(F.lit("r"), "doc_id")).select(*cols))
    return sy.weight_status(both)


C.add(
    "post",
    """
post_kept AS (SELECT * FROM road QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY section_ord) = 1),
post_sh AS (SELECT *, round(raw_weight / sum(raw_weight) OVER (PARTITION BY doc_id) * 100, 2) AS sh, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord DESC) AS back FROM post_kept),
post AS (SELECT doc_id, section_ord, title, round(CASE WHEN back = 1 THEN round(sh + (100 - sum(sh) OVER (PARTITION BY doc_id)), 2) ELSE sh END, 2) AS target_weight FROM post_sh)""",
    "road",
)


@register("cur_postprocess", C.query("SELECT * FROM post", "post"))
def cur_postprocess(spark, sf):
    done = sy.postprocess_sections(roadmap(spark, sf))
    return done.select("doc_id", F.col("section_ord").cast("long").alias("section_ord"), "title", F.round("target_weight", 2).alias("target_weight"))


_DOC = "CASE doc_id % 4 WHEN 0 THEN '강의계획 주차 30% ' || text WHEN 1 THEN '이력서 면접 면접 과정 ' || text WHEN 2 THEN '교과목 시수 ' || text ELSE text END"
C.add(
    "docscore",
    f"""
docscore AS (SELECT doc_id, t, {k.hits('t', fv.CURRICULUM_HINTS)} * 2 - {k.hits('t', fv.COUNTER_HINTS)} * 3 + {_pt("contains(t, '주차') OR contains(t, '시수')", 3)} + {_pt("contains(t, '%')", 2)}
  + {_pt("contains(t, '교과목') OR contains(t, '과정')", 1)} - {_pt("len(regexp_extract_all(t, '면접')) >= 2", 4)} AS score FROM (SELECT doc_id, {_DOC} AS t FROM documents))""",
)


@register(
    "cur_classify",
    C.query(
        """SELECT doc_id, score::BIGINT AS score, CASE WHEN doc_id % 8 = 0 OR (score >= 2 AND doc_id % 3 = 0) THEN 'review_required' ELSE 'rejected' END AS decision,
  CASE WHEN doc_id % 8 = 0 OR (score >= 2 AND doc_id % 3 = 0) THEN 'curriculum_like' ELSE 'not_curriculum' END AS document_kind,
  round(CASE WHEN doc_id % 8 = 0 THEN least(0.74, 0.52 + 0.9 / 4) WHEN score >= 2 AND doc_id % 3 = 0 THEN least(0.74, 0.42 + score / 20.0) ELSE least(0.49, greatest(0, score / 10.0)) END::DOUBLE, 6) AS confidence FROM docscore""",
        "docscore",
    ),
)
def cur_classify(spark, sf):
    style = F.col("doc_id") % 4
    text = F.concat(F.when(style == 0, "강의계획 주차 30% ").when(style == 1, "이력서 면접 면접 과정 ").when(style == 2, "교과목 시수 ").otherwise(""), "text")
    docs = v.spread(v.table(spark, sf, "documents")).select("doc_id", text.alias("text"))
    sure = docs.filter(F.col("doc_id") % 8 == 0).select("doc_id", F.lit(0.9).alias("confidence"))
    guessed = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id")
    return sy.classify_documents(docs, sure, guessed).select(
        "doc_id", F.col("score").cast("long").alias("score"), "decision", "document_kind", F.round("confidence", 6).alias("confidence")
    )


@register(
    "cur_decisions",
    """SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'rejected' WHEN (doc_id % 100) / 100 < 0.55 THEN 'rejected'
  WHEN (doc_id % 100) / 100 >= 0.78 AND (doc_id % 2 = 0 OR doc_id % 3 = 0) AND (doc_id % 7 = 0 OR n_chars % 2 = 0 OR n_chars % 3 = 0) THEN 'accepted' ELSE 'review_required' END AS decision FROM documents""",
)
def cur_decisions(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    rows = v.table(spark, sf, "documents").select(
        "doc_id", F.when(n % 5 == 0, "not_curriculum").otherwise("curriculum").alias("document_kind"), ((d % 100) / 100).alias("confidence"),
        (d % 2 == 0).alias("has_structure"), (d % 3 == 0).alias("local_structure"), (d % 7 == 0).alias("has_explicit_weights"),
        (n % 2 == 0).alias("has_derivable_weights"), (n % 3 == 0).alias("local_weights"),
    )
    return sy.resolve_decisions(rows).select("doc_id", "decision")


@register(
    "cur_evidence",
    C.query("SELECT doc_id, section_ord AS rank, page, block AS snippet, title || ': lecture counts or weeks are stated in the roadmap' AS reason FROM road WHERE section_ord <= 3", "road"),
)
def cur_evidence(spark, sf):
    sections = roadmap(spark, sf).withColumn("kind", F.lit("chapter_roadmap"))
    return sy.structure_evidence(sections).withColumn("rank", F.col("rank").cast("long"))


_LAY = "CASE WHEN page_id % 5 = 0 THEN '' ELSE html END"
_RAWP = "CASE WHEN page_id % 10 = 0 THEN ' ' WHEN page_id % 3 = 0 THEN '' ELSE url || chr(10) || '  x ' END"
_FLAT = k.norm(f"coalesce(nullif({_RAWP}, ''), {_LAY})")
_NL = f"array_to_string(list_filter(list_transform(string_split(coalesce(nullif({_LAY}, ''), {_RAWP}), chr(10)), lambda x: {k.norm('x')}), lambda x: x <> ''), chr(10))"


@register(
    "cur_pages",
    f"SELECT doc_id, page, coalesce(nullif(lay, ''), flat) AS text, coalesce(nullif(flat, ''), {k.norm('lay')}) AS flat_text FROM (SELECT page_id % 20 AS doc_id, page_id AS page, {_NL} AS lay, {_FLAT} AS flat FROM pages) WHERE lay <> '' OR flat <> ''",
)
def cur_pages(spark, sf):
    p = F.col("page_id")
    raw = F.when(p % 10 == 0, " ").when(p % 3 == 0, "").otherwise(F.concat("url", F.lit("\n  x ")))
    pages = v.table(spark, sf, "pages").select(
        (p % 20).alias("doc_id"), p.alias("page"), F.when(p % 5 == 0, "").otherwise(F.col("html")).alias("layout_text"), raw.alias("raw_text")
    )
    return sy.page_records(pages)[0]


C.add(
    "excerpt",
    """
ex_lines AS (SELECT doc_id, page, line, max(score) AS score FROM scored_lines WHERE score > 0 AND length(line) >= 4 GROUP BY ALL),
ex_page AS (SELECT * FROM ex_lines QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, line) <= 12),
ex_run AS (SELECT *, sum(length('[p.' || page || '] ' || line || chr(10))) OVER (PARTITION BY doc_id ORDER BY score DESC, page, line ROWS UNBOUNDED PRECEDING) AS used FROM ex_page),
excerpt AS (SELECT doc_id, page, line, score, used::BIGINT AS used FROM ex_run WHERE used <= 900)""",
    "scored_lines",
)


@register(
    "rnk_excerpt_fallback",
    C.query(
        """SELECT doc_id, page, line, score, used FROM excerpt WHERE doc_id NOT LIKE '%1'
UNION ALL SELECT doc_id, page, substr(body, 1, 225), 0, 0 FROM (
  SELECT doc_id, page, string_agg(raw_line, chr(10) ORDER BY line_no) AS body FROM plan_doc GROUP BY ALL) p
WHERE doc_id LIKE '%1' OR doc_id NOT IN (SELECT doc_id FROM excerpt)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 4""",
        "excerpt",
    ),
)
def rnk_excerpt_fallback(spark, sf):
    """Every brand that ends in 1 counts as a document without a scored line."""
    doc = plan_doc(spark, sf)
    none = F.col("doc_id").endswith("1")
    lines = sy.score_lines(doc).withColumn("score", F.when(none, 0).otherwise(F.col("score")))
    pages = doc.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw_line"))), lambda x: x["raw_line"]), "\n").alias("text")
    )
    got = rk.excerpt_or_first_pages(lines, pages, 900)
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("score", "used")]
    return got.select("doc_id", "page", "line", *filled)


@register("rnk_excerpt", C.query("SELECT * FROM excerpt", "excerpt"))
def rnk_excerpt(spark, sf):
    lines = sy.score_lines(plan_doc(spark, sf))
    return rk.budgeted_excerpt(lines, 900).select("doc_id", "page", "line", F.col("score").cast("long").alias("score"), "used")


@register(
    "cur_structure_hint",
    f"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || {k.q(fv.ROADMAP_START[0])} WHEN 1 THEN html || ' ' || {k.q(fv.SCHEDULE_HINTS[0])} ELSE html END AS x FROM pages)
SELECT page_id, {k.contains_any(k.norm('x'), (*fv.ROADMAP_START, *fv.SCHEDULE_HINTS))} AS hinted FROM t""",
)
def cur_structure_hint(spark, sf):
    """Which texts announce a roadmap or a timetable."""
    style = F.col("page_id") % 4
    text = F.when(style == 0, F.concat("html", F.lit(fv.ROADMAP_START[0]))).when(
        style == 1, F.concat("html", F.lit(" "), F.lit(fv.SCHEDULE_HINTS[0]))
    ).otherwise(F.col("html"))
    return v.table(spark, sf, "pages").select("page_id", sy.structure_hint(text).alias("hinted"))
