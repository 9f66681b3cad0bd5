"""Text rules and segment sources on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions import fragments as fr
from curricle.functions import text as tx
from curricle.functions.tokens import count_tokens, tokenize, tokenize_keywords
from curricle.plans import sqlkit as k
from curricle.plans.registry import register
from curricle.plans.views import C, spread, table
from curricle.sources import segments as sg


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


@register("txt_normalize", f"SELECT doc_id, {k.norm('text')} AS body FROM documents")
def txt_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalize_text("text").alias("body"))


@register("txt_fingerprint", f"SELECT doc_id, sha1(lower({k.norm('text')})) AS fp FROM documents")
def txt_fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.fingerprint("text").alias("fp"))


@register("txt_slug", f"SELECT doc_id, {k.slug('text')} AS slug FROM documents")
def txt_slug(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.slugify("text").alias("slug"))


_LINE = (
    "CASE item_id % 5 WHEN 0 THEN '1. ' || a || ' | ' || b WHEN 1 THEN '- ' || a || '::' || b "
    "WHEN 2 THEN '2) ' || a || ' - ' || b WHEN 3 THEN a || ': ' || b ELSE a || ' ' || b END"
)
C.add(
    "plan_lines",
    f"""
plan_lines AS (
  SELECT item_id, {_LINE} AS line FROM (
    SELECT item_id, split_part(t, ' ', 1) AS a, substr(t, length(split_part(t, ' ', 1)) + 2) AS b
    FROM (SELECT item_id, {k.norm('text')} AS t FROM benchmark)))""",
)


def plan_lines(spark, sf):
    """Curriculum lines in every separator style, built from the benchmark texts."""
    text = tx.normalize_text("text")
    a = F.substring_index(text, " ", 1)
    b = F.substring(text, F.length(a) + 2, F.length(text))
    style = F.col("item_id") % 5
    return table(spark, sf, "benchmark").select(
        "item_id",
        F.when(style == 0, F.concat(F.lit("1. "), a, F.lit(" | "), b))
        .when(style == 1, F.concat(F.lit("- "), a, F.lit("::"), b))
        .when(style == 2, F.concat(F.lit("2) "), a, F.lit(" - "), b))
        .when(style == 3, F.concat(a, F.lit(": "), b))
        .otherwise(F.concat(a, F.lit(" "), b))
        .alias("line"),
    )


def split_sql(line: str) -> tuple[str, str]:
    title, description = "", ""
    for sep in ("|", "::", " - ", ":"):
        head = f"trim(split_part({line}, {k.q(sep)}, 1))"
        tail = f"trim(substr({line}, strpos({line}, {k.q(sep)}) + {len(sep)}))"
        cond = f"contains({line}, {k.q(sep)}) AND {head} <> ''"
        title += f" WHEN {cond} THEN {head}"
        description += f" WHEN {cond} THEN CASE WHEN {tail} = '' THEN {head} ELSE {tail} END"
    return f"CASE{title} ELSE {line} END", f"CASE{description} ELSE {line} END"


_TITLE, _DESC = split_sql("ln")


@register(
    "txt_curriculum_line",
    C.query(
        f"SELECT item_id, {_TITLE} AS title, {_DESC} AS description FROM "
        f"(SELECT item_id, regexp_replace(line, {k.q(fv.LIST_PREFIX)}, '') AS ln FROM plan_lines)",
        "plan_lines",
    ),
)
def txt_curriculum_line(spark, sf):
    parts = plan_lines(spark, sf).withColumn("p", tx.split_curriculum_line("line"))
    return parts.select("item_id", "p.title", "p.description")


@register(
    "txt_snippet",
    f"SELECT doc_id, CASE WHEN length(b) > 220 THEN rtrim(substr(b, 1, 219)) || '…' ELSE b END AS snip "
    f"FROM (SELECT doc_id, {k.norm('text')} AS b FROM documents)",
)
def txt_snippet(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.snippet("text").alias("snip"))


@register(
    "txt_seconds",
    "SELECT o_orderkey, CASE WHEN s >= 3600 THEN CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || (s // 3600) || ':' ELSE '' END "
    "|| lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock "
    "FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)",
)
def txt_seconds(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", tx.format_seconds("o_totalprice").alias("clock")
    )


@register(
    "txt_tokens",
    f"SELECT doc_id, array_to_string({k.tok('text')}, ' ') AS tokens, {k.ntok('text')}::BIGINT AS n FROM documents",
)
def txt_tokens(spark, sf):
    tokens = _docs(spark, sf).select("doc_id", tokenize("text").alias("t"), count_tokens("text").alias("n"))
    return tokens.select("doc_id", F.array_join("t", " ").alias("tokens"), F.col("n").cast("long"))


@register(
    "txt_keyword_tokens",
    f"SELECT doc_id, array_to_string({k.ktok('text')}, ' ') AS tokens FROM documents",
)
def txt_keyword_tokens(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.array_join(tokenize_keywords("text"), " ").alias("tokens")
    )


_MARKED = (
    "CASE turn % 4 WHEN 0 THEN '[Music] [음악]' WHEN 1 THEN '[Applause] ' || text || ' [laughter]' "
    "WHEN 2 THEN replace(text, ' ', ' [Cheers] ') ELSE text END"
)


@register(
    "txt_clean_speech",
    "SELECT * FROM (SELECT conv_id, turn, "
    + k.norm(f"regexp_replace({k.norm(_MARKED)}, {k.q(fv.SOUND_MARKER)}, ' ', 'g')")
    + " AS said FROM conversations) WHERE said <> ''",
)
def txt_clean_speech(spark, sf):
    style = F.col("turn") % 4
    marked = (
        F.when(style == 0, F.lit("[Music] [음악]"))
        .when(style == 1, F.concat(F.lit("[Applause] "), "text", F.lit(" [laughter]")))
        .when(style == 2, F.replace("text", F.lit(" "), F.lit(" [Cheers] ")))
        .otherwise(F.col("text"))
    )
    said = table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.clean_speech(marked).alias("said")
    )
    return said.filter(F.col("said") != "")


@register(
    "txt_chapter_index",
    C.query(
        "SELECT course_id, section_ord::BIGINT AS section_ord, "
        "try_cast(regexp_extract(title, '(?i)\\bchapter\\s*(\\d+)\\b', 1) AS INT)::BIGINT AS chapter FROM sections",
        "sections",
    ),
)
def txt_chapter_index(spark, sf):
    from curricle.plans.views import sections

    return sections(spark, sf).select(
        "course_id",
        F.col("section_ord").cast("long").alias("section_ord"),
        tx.section_chapter_index("title").cast("long").alias("chapter"),
    )


_LABELS = (
    "CASE doc_id % 4 WHEN 0 THEN 'Series [' || (doc_id % 8 + 1) || '-2] ' || w WHEN 1 THEN 'youtube abcdefghi_' || (doc_id % 10) "
    "WHEN 2 THEN '[' || doc_id || ']' ELSE w END"
)
C.add(
    "labels_view",
    f"labels_view AS (SELECT doc_id, {_LABELS} AS label FROM (SELECT doc_id, {k.norm('text')} AS w FROM documents))",
)


def _labels(spark, sf):
    w = tx.normalize_text("text")
    style = F.col("doc_id") % 4
    as_text = F.col("doc_id").cast("string")
    return _docs(spark, sf).select(
        "doc_id",
        F.when(style == 0, F.concat(F.lit("Series ["), (F.col("doc_id") % 8 + 1).cast("string"), F.lit("-2] "), w))
        .when(style == 1, F.concat(F.lit("youtube abcdefghi_"), (F.col("doc_id") % 10).cast("string")))
        .when(style == 2, F.concat(F.lit("["), as_text, F.lit("]")))
        .otherwise(w)
        .alias("label"),
    )


@register(
    "txt_video_titles",
    C.query(
        f"SELECT doc_id, coalesce(try_cast(regexp_extract(label, {k.q(fv.SOURCE_CHAPTER)}, 1) AS INT)::BIGINT, -1) AS chapter, "
        f"CASE WHEN regexp_matches(label, {k.q(fv.GENERIC_VIDEO_LABEL)}) THEN '' ELSE "
        f"coalesce(nullif(trim(regexp_extract(label, {k.q(fv.BRACKETED_TITLE)}, 1)), ''), label) END AS title FROM labels_view",
        "labels_view",
    ),
)
def txt_video_titles(spark, sf):
    return _labels(spark, sf).select(
        "doc_id",
        F.coalesce(tx.source_chapter_index("label").cast("long"), F.lit(-1)).alias("chapter"),
        tx.speech_title("label").alias("title"),
    )


_COMMENT = "text || ' ' || turn || CASE conv_id % 3 WHEN 0 THEN '주차 의견' WHEN 1 THEN ' 차시' ELSE ' none' END"


@register(
    "txt_week",
    f"SELECT conv_id, turn, regexp_extract({_COMMENT}, {k.q(fv.WEEK_MENTION)}, 1) AS week FROM conversations",
)
def txt_week(spark, sf):
    style = F.col("conv_id") % 3
    comment = F.concat(
        "text",
        F.lit(" "),
        F.col("turn").cast("string"),
        F.when(style == 0, "주차 의견").when(style == 1, " 차시").otherwise(F.lit(" none")),
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.extract_week(comment).alias("week")
    )


C.add(
    "headings",
    f"""
headings AS (
  SELECT conv_id * 1000 + turn AS hid,
    CASE conv_id % 4 WHEN 0 THEN 'Chapter ' || turn || ': ' || t || ' 총 3강' WHEN 1 THEN t || ' / Decision Trees & overview'
      WHEN 2 THEN t || ' and Support Vector Machines SVM, Intro' ELSE 'Part 2 - (' || t || ')' END AS heading
  FROM (SELECT conv_id, turn, {k.norm('text')} AS t FROM conversations))""",
)


def headings(spark, sf):
    """Section headings in several layouts, around the turns of all conversations."""
    t = tx.normalize_text("text")
    style = F.col("conv_id") % 4
    return spread(table(spark, sf, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("hid"),
        F.when(style == 0, F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit(": "), t, F.lit(" 총 3강")))
        .when(style == 1, F.concat(t, F.lit(" / Decision Trees & overview")))
        .when(style == 2, F.concat(t, F.lit(" and Support Vector Machines SVM, Intro")))
        .otherwise(F.concat(F.lit("Part 2 - ("), t, F.lit(")")))
        .alias("heading"),
    )


@register(
    "txt_fragment_key",
    C.query(
        f"SELECT hid, {k.clean_fragment('heading')} AS cleaned, {k.fragment_key('heading', 'material')} AS material_key, "
        f"{k.fragment_key('heading', 'speech')} AS speech_key FROM headings",
        "headings",
    ),
)
def txt_fragment_key(spark, sf):
    return headings(spark, sf).select(
        "hid",
        fr.clean_fragment("heading").alias("cleaned"),
        fr.fragment_key("heading", "material").alias("material_key"),
        fr.fragment_key("heading", "speech").alias("speech_key"),
    )


for _mode in ("material", "speech"):
    C.add(f"terms_{_mode}", k.fragment_rows("headings", "hid", "heading", _mode, f"terms_{_mode}"), "headings")


def _fragment_terms(spark, sf, mode):
    return headings(spark, sf).select(
        "hid", F.posexplode_outer(fr.fragment_terms("heading", mode)).alias("ord", "term")
    ).filter(F.col("ord").isNotNull()).select("hid", F.col("ord").cast("long").alias("ord"), "term")


@register("txt_fragment_terms_material", C.query("SELECT hid, ord, term FROM terms_material", "terms_material"))
def txt_fragment_terms_material(spark, sf):
    return _fragment_terms(spark, sf, "material")


@register("txt_fragment_terms_speech", C.query("SELECT hid, ord, term FROM terms_speech", "terms_speech"))
def txt_fragment_terms_speech(spark, sf):
    return _fragment_terms(spark, sf, "speech")


_PLAN = (
    "p_name || ' ' || p_size || CASE p_partkey % 7 WHEN 0 THEN '%' WHEN 1 THEN '강' WHEN 2 THEN '주차' WHEN 3 THEN '시간' "
    "WHEN 4 THEN '일' WHEN 5 THEN '~' || (p_size + 2) || '주차' ELSE '' END"
)
C.add("plan_text", f"plan_text AS (SELECT p_partkey, p_type, p_brand, {_PLAN} AS line FROM part)")


def plan_text(spark, sf):
    """Syllabus lines with all weight styles, from the part table."""
    style = F.col("p_partkey") % 7
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        "p_brand",
        F.concat(
            "p_name",
            F.lit(" "),
            size,
            F.when(style == 0, "%").when(style == 1, "강").when(style == 2, "주차").when(style == 3, "시간")
            .when(style == 4, "일")
            .when(style == 5, F.concat(F.lit("~"), (F.col("p_size") + 2).cast("string"), F.lit("주차")))
            .otherwise(F.lit("")),
        ).alias("line"),
    )


def sql_no_boundary(pattern: str) -> str:
    """RE2 sees no word boundary after Hangul; spell it out."""
    return pattern.replace(r"강\b", r"강([^\p{L}\p{N}_]|$)").replace(r"주\b", r"주([^\p{L}\p{N}_]|$)")


def week_sql(x: str) -> str:
    first = f"try_cast(regexp_extract({x}, {k.q(fv.WEEK_RANGE)}, 1) AS INT)"
    last = f"try_cast(regexp_extract({x}, {k.q(fv.WEEK_RANGE)}, 2) AS INT)"
    one = f"try_cast(regexp_extract({x}, {k.q(fv.WEEKS)}, 1) AS DOUBLE)"
    return f"(CASE WHEN {last} >= {first} THEN ({last} - {first} + 1)::DOUBLE ELSE {one} END)"


def metric_sql(x: str) -> tuple[str, str]:
    kinds = [
        ("percent", f"try_cast(regexp_extract({x}, {k.q(fv.PERCENT)}, 1) AS DOUBLE)"),
        ("lecture_count", f"try_cast(regexp_extract({x}, {k.q(sql_no_boundary(fv.LECTURES))}, 1) AS DOUBLE)"),
        ("weeks", week_sql(x)),
        ("hours", f"try_cast(regexp_extract({x}, {k.q(fv.HOURS)}, 1) AS DOUBLE)"),
        ("days", f"try_cast(regexp_extract({x}, {k.q(fv.DAYS)}, 1) AS DOUBLE)"),
    ]
    value = "coalesce(" + ", ".join(sql for _, sql in kinds) + ")"
    source = "CASE " + " ".join(f"WHEN {sql} IS NOT NULL THEN {k.q(name)}" for name, sql in kinds) + " ELSE 'none' END"
    return value, source


def strip_sql(x: str) -> str:
    for pattern in (fv.PERCENT, sql_no_boundary(fv.LECTURES), fv.HOURS, fv.WEEK_RANGE, fv.WEEKS, fv.DAYS):
        x = f"regexp_replace({x}, {k.q(pattern)}, '', 'g')"
    return k.norm(x)


_VALUE, _SOURCE = metric_sql("line")


@register(
    "txt_weight_metric",
    C.query(f"SELECT p_partkey, {_VALUE} AS value, {_SOURCE} AS source FROM plan_text", "plan_text"),
)
def txt_weight_metric(spark, sf):
    return plan_text(spark, sf).select("p_partkey", tx.weight_metric("line").alias("m")).select(
        "p_partkey", "m.value", "m.source"
    )


C.add(
    "long_lines",
    f"long_lines AS (SELECT doc_id, {k.norm('text')} || ' 12% 3강 2주차' AS line FROM documents)",
)


def trim_title_sql(x: str) -> str:
    parts = (
        f"list_filter(list_transform(string_split(regexp_replace({x}, '[,·\\-–—]', chr(1), 'g'), chr(1)), "
        "lambda px: trim(px)), lambda px: px <> '')"
    )
    return f"CASE WHEN length({x}) <= 40 THEN {x} ELSE coalesce({parts}[1], trim(substr({x}, 1, 40))) END"


@register(
    "txt_trim_title",
    C.query(
        f"SELECT doc_id, s AS stripped, {trim_title_sql('s')} AS title FROM (SELECT doc_id, {strip_sql('line')} AS s FROM long_lines)",
        "long_lines",
    ),
)
def txt_trim_title(spark, sf):
    line = F.concat(tx.normalize_text("text"), F.lit(" 12% 3강 2주차"))
    rows = _docs(spark, sf).select("doc_id", line.alias("line"))
    return rows.select("doc_id", tx.strip_metrics("line").alias("stripped"), tx.trim_title("line").alias("title"))


@register(
    "txt_split_heading",
    "SELECT p_partkey, coalesce(nullif(trim(regexp_extract(h, '^([^가-힣]+)([가-힣].*)$', 1)), ''), h) AS title, "
    "coalesce(nullif(trim(regexp_extract(h, '^([^가-힣]+)([가-힣].*)$', 2)), ''), h) AS description FROM ("
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' 결정 트리 ' || p_type WHEN 1 THEN '결정 ' || p_name "
    "ELSE p_name || ' ' || p_type END AS h FROM part)",
)
def txt_split_heading(spark, sf):
    style = F.col("p_partkey") % 3
    heading = (
        F.when(style == 0, F.concat("p_name", F.lit(" 결정 트리 "), "p_type"))
        .when(style == 1, F.concat(F.lit("결정 "), "p_name"))
        .otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    )
    rows = table(spark, sf, "part").select("p_partkey", tx.split_heading(heading).alias("h"))
    return rows.select("p_partkey", "h.title", "h.description")


_SCORE = (
    "CASE l_linenumber % 4 WHEN 0 THEN (l_quantity / 10)::VARCHAR WHEN 1 THEN (l_quantity::INT % 7) || '점' "
    "WHEN 2 THEN (l_quantity::INT % 7) || 'd' ELSE 'NaN' END"
)


@register(
    "txt_parse_score",
    "SELECT l_linenumber::BIGINT AS l_linenumber, round(score, 6) AS score, count(*) AS n FROM (SELECT l_linenumber, "
    "CASE WHEN regexp_matches(c, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') AND try_cast(c AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast(c AS DOUBLE) END AS score "
    f"FROM (SELECT l_linenumber, regexp_replace({_SCORE}, '점$', '') AS c FROM lineitem)) GROUP BY ALL",
)
def txt_parse_score(spark, sf):
    style = F.col("l_linenumber") % 4
    whole = (F.col("l_quantity").cast("int") % 7).cast("string")
    raw = (
        F.when(style == 0, (F.col("l_quantity") / 10).cast("string"))
        .when(style == 1, F.concat(whole, F.lit("점")))
        .when(style == 2, F.concat(whole, F.lit("d")))
        .otherwise(F.lit("NaN"))
    )
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(tx.parse_score(raw), 6).alias("score")
    )
    return rows.groupBy("l_linenumber", "score").agg(F.count("*").alias("n"))


def numeric_like_sql(x: str) -> str:
    return f"regexp_matches({k.norm(x)}, {k.q(fv.NUMERIC_LIKE)})"


def text_rich_sql(x: str) -> str:
    n = k.norm(x)
    return (
        f"({n} <> '' AND NOT {numeric_like_sql(x)} AND (length(regexp_replace({n}, '[^A-Za-z가-힣]', '', 'g')) >= 4 "
        f"OR length({n}) >= 8))"
    )


@register(
    "txt_cell_predicates",
    "SELECT source_id, seq, " + numeric_like_sql("v") + " AS numeric_like, " + text_rich_sql("v") + " AS text_rich, "
    + k.contains_any("lower(v)", fv.SHEET_META_HINTS)
    + " AS hinted FROM (SELECT doc_id AS source_id, seq, CASE seq % 3 WHEN 0 THEN line WHEN 1 THEN doc_id || ' / ' || seq "
    "ELSE 'Week ' || seq END AS v FROM (SELECT doc_id, unnest(range(len(ls))) AS seq, unnest(ls) AS line FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))",
)
def txt_cell_predicates(spark, sf):
    lines = _docs(spark, sf).select(
        F.col("doc_id").alias("source_id"), F.posexplode_outer(F.split("text", "\n")).alias("seq", "line")
    )
    style = F.col("seq") % 3
    v = (
        F.when(style == 0, F.col("line"))
        .when(style == 1, F.concat(F.col("source_id").cast("string"), F.lit(" / "), F.col("seq").cast("string")))
        .otherwise(F.concat(F.lit("Week "), F.col("seq").cast("string")))
    )
    return lines.select(
        "source_id",
        F.col("seq").cast("long").alias("seq"),
        tx.is_numeric_like(v).alias("numeric_like"),
        tx.is_text_rich(v).alias("text_rich"),
        tx.has_hint(F.lower(v), fv.SHEET_META_HINTS).alias("hinted"),
    )


_HEAD = (
    "CASE p_partkey % 4 WHEN 0 THEN 'AQ1-' || p_size || '. ' || p_name || ' / bq2-' || p_size || ') ' || p_type "
    "WHEN 1 THEN 'BQ' || p_size || ' - ' || p_name WHEN 2 THEN p_name || ' BQ3-1' ELSE '기타 의견 ' || p_name END"
)
_QID = f"upper(regexp_extract_all(h, {k.q(fv.QUESTION_ID)}, 1)[-1])"


@register(
    "txt_question_parts",
    "SELECT p_partkey, id, split_part(id, '-', 1) AS grp, coalesce(nullif(trim(regexp_replace(h, "
    "'(?i)^.*?\\b' || id || '\\b[\\s.\\-:)]*', '')), ''), h, id) AS label, "
    + k.contains_any("lower(h)", fv.FREE_TEXT_HINTS)
    + f" AS free_text FROM (SELECT p_partkey, h, {_QID} AS id FROM (SELECT p_partkey, {_HEAD} AS h FROM part))",
)
def txt_question_parts(spark, sf):
    style = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    head = (
        F.when(style == 0, F.concat(F.lit("AQ1-"), size, F.lit(". "), "p_name", F.lit(" / bq2-"), size, F.lit(") "), "p_type"))
        .when(style == 1, F.concat(F.lit("BQ"), size, F.lit(" - "), "p_name"))
        .when(style == 2, F.concat("p_name", F.lit(" BQ3-1")))
        .otherwise(F.concat(F.lit("기타 의견 "), "p_name"))
    )
    rows = table(spark, sf, "part").select("p_partkey", head.alias("h"))
    return rows.select("p_partkey", tx.question_parts("h").alias("q"), tx.is_free_text_header("h").alias("free_text")).select(
        "p_partkey", "q.id", "q.grp", F.coalesce("q.label", F.lit(None)).alias("label"), "free_text"
    )


_URL = (
    "CASE page_id % 8 WHEN 0 THEN 'https://www.youtube.com/watch?v=vid' || page_id || '&t=4' WHEN 1 THEN 'https://youtu.be/abc' || page_id || '/x' "
    "WHEN 2 THEN 'https://m.youtube.com/playlist?list=PL' || page_id WHEN 3 THEN 'https://youtube.com/shorts/sh' || page_id "
    "WHEN 4 THEN 'https://www.youtube.com/watch?v=q' || page_id || '&list=PL1' WHEN 5 THEN 'https://WWW.youtube.com/embed/e' || page_id || '?rel=0' "
    "ELSE url END"
)
C.add(
    "video_urls",
    f"""
video_urls AS (
  SELECT page_id, u, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
    trim(regexp_extract(u, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/') AS path,
    nullif(regexp_extract(u, '[?&]v=([^&#]*)', 1), '') AS v, nullif(regexp_extract(u, '[?&]list=([^&#]*)', 1), '') AS lst
  FROM (SELECT page_id, {_URL} AS u FROM pages))""",
)
_HOSTS = k.str_list(fv.VIDEO_HOSTS)


def video_urls(spark, sf):
    style = F.col("page_id") % 8
    n = F.col("page_id").cast("string")
    u = (
        F.when(style == 0, F.concat(F.lit("https://www.youtube.com/watch?v=vid"), n, F.lit("&t=4")))
        .when(style == 1, F.concat(F.lit("https://youtu.be/abc"), n, F.lit("/x")))
        .when(style == 2, F.concat(F.lit("https://m.youtube.com/playlist?list=PL"), n))
        .when(style == 3, F.concat(F.lit("https://youtube.com/shorts/sh"), n))
        .when(style == 4, F.concat(F.lit("https://www.youtube.com/watch?v=q"), n, F.lit("&list=PL1")))
        .when(style == 5, F.concat(F.lit("https://WWW.youtube.com/embed/e"), n, F.lit("?rel=0")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", u.alias("u"))


@register(
    "txt_url_kind",
    C.query(
        f"SELECT page_id, list_contains({_HOSTS}, host) AS is_video, list_contains({_HOSTS}, host) AND v IS NULL AND host <> 'youtu.be' "
        "AND path = 'playlist' AND lst IS NOT NULL AS is_playlist FROM video_urls",
        "video_urls",
    ),
)
def txt_url_kind(spark, sf):
    return video_urls(spark, sf).select(
        "page_id", tx.is_video_url("u").alias("is_video"), tx.is_playlist_url("u").alias("is_playlist")
    )


@register(
    "txt_video_id",
    C.query(
        "SELECT page_id, vid, 'https://www.youtube.com/watch?v=' || vid AS url FROM (SELECT page_id, coalesce(v, "
        "CASE WHEN host = 'youtu.be' THEN nullif(split_part(path, '/', 1), '') END, "
        "nullif(regexp_extract(path, '^(shorts|live|embed)/+([^/]+)', 2), '')) AS vid FROM video_urls)",
        "video_urls",
    ),
)
def txt_video_id(spark, sf):
    ids = video_urls(spark, sf).select("page_id", tx.video_id("u").alias("vid"))
    return ids.withColumn("url", tx.canonical_url("vid"))


# --- sources -----------------------------------------------------------------
_LINES_SQL = """
SELECT doc_id AS source_id, source AS instructor, unnest(range(len(ls))) AS seq, unnest(ls) AS text
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)"""
C.add("doc_rows", f"doc_rows AS ({_LINES_SQL})")


def _doc_rows(spark, sf):
    return _docs(spark, sf).select(
        F.col("doc_id").alias("source_id"),
        F.col("source").alias("instructor"),
        F.posexplode_outer(F.split("text", "\n")).alias("seq", "text"),
    )


@register(
    "src_pages",
    C.query(
        f"SELECT source_id, 'p.' || (seq + 1) AS locator, b AS text FROM (SELECT *, {k.norm('text')} AS b FROM doc_rows) WHERE b <> ''",
        "doc_rows",
    ),
)
def src_pages(spark, sf):
    pages = _doc_rows(spark, sf).withColumn("page_no", F.col("seq") + 1)
    return sg.segments_from_pages(pages)[0].select("source_id", "locator", "text")


@register(
    "src_page_stats",
    C.query(
        f"SELECT source_id, count_if(b = '')::BIGINT AS blank_parts, count_if(b <> '')::BIGINT AS kept_parts, "
        f"CASE WHEN count_if(b <> '') = 0 THEN 'pdf: no analysable text was found' END AS warning "
        f"FROM (SELECT *, {k.norm('text')} AS b FROM doc_rows) GROUP BY source_id",
        "doc_rows",
    ),
)
def src_page_stats(spark, sf):
    pages = _doc_rows(spark, sf).withColumn("page_no", F.col("seq") + 1)
    return sg.segments_from_pages(pages)[1]


@register(
    "src_slides",
    C.query(
        f"SELECT source_id, 's.' || slide_no AS locator, t AS text FROM (SELECT source_id, seq // 3 + 1 AS slide_no, "
        f"{k.norm('string_agg(b, chr(32) ORDER BY seq % 3)')} AS t FROM (SELECT *, {k.norm('text')} AS b FROM doc_rows) GROUP BY ALL) WHERE t <> ''",
        "doc_rows",
    ),
)
def src_slides(spark, sf):
    rows = _doc_rows(spark, sf)
    fragments = rows.select(
        "source_id",
        (F.floor(F.col("seq") / 3) + 1).alias("slide_no"),
        (F.col("seq") % 3).alias("frag_no"),
        "text",
    )
    return sg.segments_from_slides(fragments)[0].select("source_id", "locator", "text")


@register(
    "src_text",
    f"SELECT doc_id AS path, 'text' AS source_type, 'full' AS locator, b AS text, CASE WHEN b = '' THEN 'text: the file is empty' END AS warning "
    f"FROM (SELECT doc_id, {k.norm('text')} AS b FROM documents)",
)
def src_text(spark, sf):
    files = _docs(spark, sf).select(F.col("doc_id").alias("path"), F.col("text").alias("value"))
    return sg.segments_from_text(files).drop("seq")


C.add(
    "csv_grid",
    f"""
csv_grid AS (
  SELECT source_id, seq AS row_no, unnest(range(len(cs))) AS col_no, trim(unnest(cs)) AS value
  FROM (SELECT source_id, seq, string_split({k.norm("replace(text, chr(34), ' ')")}, ',') AS cs FROM doc_rows))""",
    "doc_rows",
)


@register(
    "src_rows_verbalized",
    C.query(
        """SELECT source_id, 'row.' || n AS locator, text FROM (
  SELECT d.source_id, d.row_no AS n, coalesce(nullif(string_agg(CASE WHEN h.source_id IS NOT NULL THEN coalesce(nullif(h.value, ''), 'column') || ': ' || d.value END, ' | ' ORDER BY d.col_no), ''),
    string_agg(d.value, ' | ' ORDER BY d.col_no)) AS text
  FROM csv_grid d LEFT JOIN csv_grid h ON h.source_id = d.source_id AND h.row_no = 0 AND h.col_no = d.col_no
  WHERE d.row_no > 0 AND d.value <> '' GROUP BY ALL
  UNION ALL
  SELECT source_id, 1, string_agg(value, ' | ' ORDER BY col_no) FROM csv_grid
  WHERE row_no = 0 AND value <> '' AND source_id IN (SELECT source_id FROM csv_grid GROUP BY source_id HAVING max(row_no) = 0) GROUP BY source_id)""",
        "csv_grid",
    ),
)
def src_rows_verbalized(spark, sf):
    lines = _doc_rows(spark, sf).select(
        "source_id",
        F.col("seq").alias("row_no"),
        tx.normalize_text(F.replace("text", F.lit('"'), F.lit(" "))).alias("line"),
    )
    return sg.verbalize_rows(sg.csv_cells(lines)).select("source_id", "locator", "text")


@register(
    "src_captions",
    C.query(
        f"SELECT source_id, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' "
        f"|| lpad((s % 60)::VARCHAR, 2, '0') AS locator, b AS text FROM (SELECT source_id, seq * 97 AS s, {k.norm('text')} AS b FROM doc_rows) WHERE b <> ''",
        "doc_rows",
    ),
)
def src_captions(spark, sf):
    captions = _doc_rows(spark, sf).withColumn("start_s", F.col("seq") * 97.0)
    return sg.segments_from_captions(captions).select("source_id", "locator", "text")


_NAME = "'file' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PPTX' WHEN 2 THEN '.csv' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.md' WHEN 5 THEN '.txt' WHEN 6 THEN '.hwp' ELSE '' END"


@register(
    "src_router",
    f"""SELECT original_name, extension, kind, CASE WHEN kind = 'text' THEN 'text' ELSE coalesce(nullif(extension, ''), 'file') END AS source_type,
  CASE WHEN kind IS NULL THEN original_name || ': unsupported file type' END AS warning FROM (
  SELECT original_name, extension, CASE WHEN extension = 'pdf' THEN 'pages' WHEN extension = 'pptx' THEN 'slides' WHEN extension = 'csv' THEN 'rows'
    WHEN extension IN ('xlsx', 'xls') THEN 'sheets' WHEN extension IN ('txt', 'md') THEN 'text' END AS kind
  FROM (SELECT original_name, lower(regexp_extract(original_name, '\\.([^./\\\\]+)$', 1)) AS extension FROM (SELECT {_NAME} AS original_name FROM documents)))""",
)
def src_router(spark, sf):
    style = F.col("doc_id") % 8
    suffix = F.lit("")
    for i, s in reversed(list(enumerate([".pdf", ".PPTX", ".csv", ".xlsx", ".md", ".txt", ".hwp"]))):
        suffix = F.when(style == i, s).otherwise(suffix)
    assets = table(spark, sf, "documents").select(
        F.concat(F.lit("file"), F.col("doc_id").cast("string"), suffix).alias("original_name")
    )
    return sg.route_sources(assets)


C.add(
    "raw_cells",
    """
raw_cells AS (
  SELECT l_suppkey % 40 AS sheet, l_suppkey % 40 <> 7 AS visible, l_orderkey * 10 + l_linenumber AS row_no, c.col_no, c.dtype,
    CASE c.col_no WHEN 0 THEN (l_orderkey % 2 = 0)::VARCHAR WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN l_discount::VARCHAR WHEN 3 THEN l_quantity::VARCHAR WHEN 4 THEN '  ' || l_returnflag || '  x ' ELSE NULL END AS value
  FROM lineitem, (VALUES (0, 'boolean'), (1, 'timestamp'), (2, 'double'), (3, 'double'), (4, 'string'), (5, 'string')) c(col_no, dtype))""",
)


@register(
    "src_cells",
    C.query(
        f"""SELECT sheet, row_no, col_no, value FROM (SELECT *, max(CASE WHEN value <> '' THEN col_no END) OVER (PARTITION BY sheet, row_no) AS last_col FROM (
  SELECT sheet, row_no, col_no::BIGINT AS col_no, CASE WHEN value IS NULL THEN '' WHEN dtype = 'boolean' THEN upper(value)
    WHEN dtype = 'timestamp' THEN substr(value, 1, 16) WHEN dtype = 'double' THEN regexp_replace(regexp_replace(printf('%.6f', value::DOUBLE), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')
    ELSE {k.norm('value')} END AS value FROM raw_cells WHERE visible)) WHERE col_no <= last_col""",
        "raw_cells",
    ),
)
def src_cells(spark, sf):
    rows = table(spark, sf, "lineitem")
    column = [
        ("boolean", (F.col("l_orderkey") % 2 == 0).cast("string")),
        ("timestamp", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")),
        ("double", F.col("l_discount").cast("string")),
        ("double", F.col("l_quantity").cast("string")),
        ("string", F.concat(F.lit("  "), "l_returnflag", F.lit("  x "))),
        ("string", F.lit(None).cast("string")),
    ]
    cells = rows.select(
        (F.col("l_suppkey") % 40).alias("sheet"),
        (F.col("l_suppkey") % 40 != 7).alias("visible"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("col_no"), F.lit(d).alias("dtype"), v.alias("value")) for i, (d, v) in enumerate(column)])),
    )
    return sg.normalize_cells(cells)


