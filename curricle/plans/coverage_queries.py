"""Coverage, keywords, ranking and insight queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.operators import coverage as co
from curricle.operators import curriculum as cu
from curricle.operators import insights as ins
from curricle.operators import keywords as kw
from curricle.operators.chunking import measure_chunks
from curricle.operators.scale import stored
from curricle.plans import sqlkit as k
from curricle.plans import views as v
from curricle.plans.chunk_queries import assignments
from curricle.plans.registry import register
from curricle.plans.views import C


def instructors(spark, sf):
    """Active instructors per course: everyone who handed in a document."""
    docs = v.table(spark, sf, "documents").select(
        F.concat(F.lit("course-"), (F.floor(F.col("doc_id") / 5) % 5).cast("string")).alias("course_id"),
        F.col("source").alias("instructor"),
    )
    return docs.distinct().withColumn("instructor_ord", F.regexp_extract("instructor", "([0-9]+)", 1).cast("int"))


C.add(
    "lanes",
    "lanes AS (SELECT DISTINCT 'course-' || ((doc_id // 5) % 5) AS course_id, source AS instructor, regexp_extract(source, '([0-9]+)', 1)::INT AS instructor_ord FROM documents)",
)
C.add(
    "fan",
    "fan AS (SELECT * FROM (VALUES ('pdf', 'combined'), ('pdf', 'material'), ('pptx', 'combined'), ('pptx', 'material'), ('text', 'combined'), ('text', 'material'), "
    "('youtube', 'combined'), ('youtube', 'speech'), ('csv', 'combined')) f(source_type, mode))",
)
C.add(
    "tok_aggs",
    "tok_aggs AS (SELECT a.course_id, f.mode, a.instructor, a.section_id, sum(a.token_count)::BIGINT AS tokens FROM assigned a JOIN fan f ON f.source_type = a.source_type GROUP BY ALL)",
    "assigned", "fan",
)
C.add(
    "cov",
    """
modes AS (SELECT unnest(['combined', 'material', 'speech']) AS mode),
cov_tot AS (SELECT course_id, mode, instructor, sum(tokens)::BIGINT AS total, coalesce(sum(tokens) FILTER (section_id IS NULL), 0)::BIGINT AS unmapped FROM tok_aggs GROUP BY ALL),
cov_grid AS (
  SELECT l.course_id, m.mode, l.instructor, l.instructor_ord, s.section_id, s.section_ord, s.title, s.target_weight, coalesce(g.tokens, 0) AS section_tokens,
    coalesce(t.total, 0) AS total_tokens, coalesce(t.unmapped, 0) AS unmapped_tokens
  FROM lanes l CROSS JOIN modes m JOIN sections s ON s.course_id = l.course_id
  LEFT JOIN cov_tot t ON t.course_id = l.course_id AND t.mode = m.mode AND t.instructor = l.instructor
  LEFT JOIN tok_aggs g ON g.course_id = l.course_id AND g.mode = m.mode AND g.instructor = l.instructor AND g.section_id = s.section_id),
cov_share AS (
  SELECT *, greatest(total_tokens - unmapped_tokens, 0) AS mapped_tokens,
    CASE WHEN total_tokens > unmapped_tokens THEN section_tokens / (total_tokens - unmapped_tokens) ELSE 0 END::DOUBLE AS token_share,
    CASE WHEN total_tokens > 0 THEN unmapped_tokens / total_tokens ELSE 0 END::DOUBLE AS unmapped_share FROM cov_grid),
cov AS (SELECT *, avg(token_share) OVER (PARTITION BY course_id, mode, section_id) AS average_share FROM cov_share)""",
    "tok_aggs", "lanes", "sections",
)


def token_totals(spark, sf, chunks=None):
    return co.token_aggregates(assignments(spark, sf, chunks))


def coverage(spark, sf, chunks=None):
    """Coverage of all modes; one lazy plan."""
    grid = co.coverage_grid(instructors(spark, sf), v.sections(spark, sf), token_totals(spark, sf, chunks))
    return co.instructor_coverage(grid)


@register(
    "coverage_shares",
    C.query(
        "SELECT course_id, instructor, section_id, section_tokens AS token_count, round(token_share, 6) AS token_share FROM cov WHERE mode = 'combined'",
        "cov",
    ),
)
def coverage_shares(spark, sf):
    """Flagship: documents → segments → chunks → sections → shares per instructor."""
    return coverage(spark, sf).filter(F.col("mode") == "combined").select(
        "course_id", "instructor", "section_id", F.col("section_tokens").alias("token_count"),
        F.round("token_share", 6).alias("token_share"),
    )


@register(
    "agg_mode_fan_out",
    C.query("SELECT f.mode, s.source_type, count(*) AS n FROM segs s JOIN fan f ON f.source_type = s.source_type GROUP BY ALL", "segs", "fan"),
)
def agg_mode_fan_out(spark, sf):
    return co.with_modes(v.segments(spark, sf)).groupBy("mode", "source_type").agg(F.count("*").alias("n"))


@register("agg_tokens", C.query("SELECT course_id, mode, instructor, section_id, tokens FROM tok_aggs", "tok_aggs"))
def agg_tokens(spark, sf):
    return token_totals(spark, sf)


_CELL = "course_id, mode, instructor, section_id"
_CELLS = ["course_id", "mode", "instructor", "section_id"]


@register("agg_grid", C.query(f"SELECT {_CELL}, section_tokens, total_tokens, unmapped_tokens FROM cov", "cov"))
def agg_grid(spark, sf):
    return coverage(spark, sf).select(*_CELLS, "section_tokens", "total_tokens", "unmapped_tokens")


@register(
    "agg_coverage",
    C.query(
        f"SELECT {_CELL}, mapped_tokens, round(token_share, 6) AS token_share, round(token_share - average_share, 6) + 0 AS deviation, round(unmapped_share, 6) AS unmapped_share FROM cov",
        "cov",
    ),
)
def agg_coverage(spark, sf):
    return coverage(spark, sf).select(
        *_CELLS, "mapped_tokens", F.round("token_share", 6).alias("token_share"),
        (F.round("deviation", 6) + 0).alias("deviation"), F.round("unmapped_share", 6).alias("unmapped_share"),
    )


@register("agg_mode_series", C.query(f"SELECT {_CELL}, title, round(token_share, 6) AS share FROM cov", "cov"))
def agg_mode_series(spark, sf):
    return co.mode_series(coverage(spark, sf)).select(*_CELLS, "title", "share")


@register(
    "agg_average_series",
    C.query("SELECT course_id, mode, section_id, title, round(avg(token_share), 6) AS share FROM cov GROUP BY ALL", "cov"),
)
def agg_average_series(spark, sf):
    return co.average_series(coverage(spark, sf)).drop("section_ord")


C.add(
    "cov_sum",
    "cov_sum AS (SELECT course_id, mode, instructor, any_value(total_tokens) AS total_tokens, any_value(mapped_tokens) AS mapped_tokens, any_value(unmapped_share) AS unmapped_share FROM cov GROUP BY ALL)",
    "cov",
)


@register(
    "agg_unmapped_series",
    C.query(
        "SELECT course_id, mode, instructor, round(unmapped_share, 6) AS share FROM cov_sum UNION ALL SELECT course_id, mode, NULL, round(avg(unmapped_share), 6) FROM cov_sum GROUP BY ALL",
        "cov_sum",
    ),
)
def agg_unmapped_series(spark, sf):
    return co.unmapped_series(coverage(spark, sf))


@register(
    "agg_target_series",
    C.query(
        "SELECT course_id, mode, 'target' AS series, NULL AS instructor, section_id, round(target_weight / 100, 6) AS share FROM sections, modes "
        "UNION ALL SELECT course_id, mode, 'instructor', instructor, section_id, round(token_share, 6) FROM cov",
        "cov",
    ),
)
def agg_target_series(spark, sf):
    return co.target_series(v.sections(spark, sf), co.mode_series(coverage(spark, sf)))


C.add(
    "mstats",
    """
asset_lanes AS (SELECT 'course-' || ((doc_id // 5) % 5) AS course_id, count_if(doc_id % 5 <> 3) AS files, count_if(doc_id % 5 = 3) AS videos FROM documents GROUP BY ALL),
mstats AS (SELECT c.course_id, c.mode, max(CASE c.mode WHEN 'material' THEN a.files WHEN 'speech' THEN a.videos ELSE a.files + a.videos END)::BIGINT AS asset_count,
  sum(total_tokens)::BIGINT AS total_tokens, sum(mapped_tokens)::BIGINT AS mapped_tokens FROM cov_sum c JOIN asset_lanes a ON a.course_id = c.course_id GROUP BY ALL)""",
    "cov_sum",
)


def _mode_stats(spark, sf):
    assets = v.table(spark, sf, "documents").select(
        F.concat(F.lit("course-"), (F.floor(F.col("doc_id") / 5) % 5).cast("string")).alias("course_id"),
        F.when(F.col("doc_id") % 5 == 3, "video").otherwise("file").alias("lane"),
    )
    return co.mode_stats(assets, co.instructor_summary(coverage(spark, sf)))


@register("agg_mode_stats", C.query("SELECT * FROM mstats", "mstats"))
def agg_mode_stats(spark, sf):
    return _mode_stats(spark, sf)


@register("agg_available_modes", C.query("SELECT course_id, mode FROM mstats WHERE asset_count > 0 AND total_tokens > 0", "mstats"))
def agg_available_modes(spark, sf):
    return co.available_modes(_mode_stats(spark, sf))


@register("agg_percent_series", C.query(f"SELECT {_CELL}, title, round(round(token_share, 6) * 100, 2) AS value FROM cov", "cov"))
def agg_percent_series(spark, sf):
    return co.percent_series(co.mode_series(coverage(spark, sf)))


@register(
    "agg_asset_counts",
    C.query(
        "SELECT coalesce(a.course_id, w.course_id) AS course_id, coalesce(a.instructor, w.instructor) AS instructor, coalesce(a.n, 0) AS asset_count, coalesce(w.n, 0) AS warning_count "
        "FROM (SELECT course_id, instructor, count(DISTINCT source_id) AS n FROM segs GROUP BY ALL) a FULL JOIN "
        "(SELECT course_id, instructor, count(*) AS n FROM segs WHERE contains(text, '|') GROUP BY ALL) w ON w.course_id = a.course_id AND w.instructor = a.instructor",
        "segs",
    ),
)
def agg_asset_counts(spark, sf):
    segments = v.segments(spark, sf)
    warnings = segments.filter(F.contains("text", F.lit("|"))).select("course_id", "instructor")
    return co.asset_counts(segments, warnings)


# --- keywords ----------------------------------------------------------------
C.add(
    "kw",
    f"""
kw_chunk AS (SELECT course_id, source_id, chunk_seq, part_no, instructor, source_type, term, count(*) AS n FROM (
  SELECT course_id, source_id, chunk_seq, part_no, instructor, source_type, unnest({k.ktok('text')}) AS term FROM chunks) GROUP BY ALL),
kw_fan AS (SELECT c.*, f.mode FROM kw_chunk c JOIN fan f ON f.source_type = c.source_type),
kw AS (SELECT course_id, mode, instructor, term, sum(CASE WHEN n >= 3 THEN n * 2 ELSE n END)::BIGINT AS weight FROM kw_fan GROUP BY ALL),
kw_off AS (SELECT * FROM kw WHERE (course_id, term) NOT IN (SELECT (course_id, term) FROM vocab)),
kw_n AS (SELECT course_id, mode, count(DISTINCT (source_id, chunk_seq, part_no)) AS n_docs FROM kw_fan GROUP BY ALL),
kw_noff AS (SELECT course_id, mode, count(DISTINCT (source_id, chunk_seq, part_no)) AS n_docs FROM kw_fan WHERE (course_id, term) NOT IN (SELECT (course_id, term) FROM vocab) GROUP BY ALL),
kw_df AS (SELECT course_id, mode, term, count(*) AS df FROM kw_fan GROUP BY ALL),
kw_score AS (SELECT k.*, CASE WHEN n.n_docs < 3 THEN k.weight ELSE k.weight * (ln((1 + n.n_docs)::DOUBLE / (1 + d.df)) + 1) END::DOUBLE AS score
  FROM kw k JOIN kw_n n USING (course_id, mode) JOIN kw_df d USING (course_id, mode, term)),
off_score AS (SELECT k.*, CASE WHEN n.n_docs < 3 THEN k.weight ELSE k.weight * (ln((1 + n.n_docs)::DOUBLE / (1 + d.df)) + 1) END::DOUBLE AS score
  FROM kw_off k JOIN kw_noff n USING (course_id, mode) JOIN kw_df d USING (course_id, mode, term))""",
    "chunks", "fan", "vocab",
)


def _keyworded(spark, sf, chunks=None):
    return kw.chunk_keywords(v.chunks(spark, sf) if chunks is None else chunks)


def _table(spark, sf, chunks=None):
    return kw.keyword_table(_keyworded(spark, sf, chunks), _vocab(spark, sf))


def _weights(spark, sf):
    return kw.keyword_weights(_table(spark, sf))


def _vocab(spark, sf):
    return cu.curriculum_vocab(v.sections(spark, sf))


def _scored(spark, sf, off=False, chunks=None):
    table, vocab = _table(spark, sf, chunks), _vocab(spark, sf)
    weights, totals = kw.dealt_weights(table), kw.document_totals(table)
    if off:
        return kw.tfidf(kw.off_curriculum_weights(weights, vocab), totals, "n_off_docs")
    return kw.tfidf(weights, totals)


@register("agg_keyword_weights", C.query("SELECT course_id, mode, instructor, term, weight FROM kw", "kw"))
def agg_keyword_weights(spark, sf):
    return _weights(spark, sf).drop("docs")


@register("agg_off_curriculum", C.query("SELECT course_id, mode, instructor, term, weight FROM kw_off", "kw"))
def agg_off_curriculum(spark, sf):
    return kw.off_curriculum_weights(_weights(spark, sf), _vocab(spark, sf)).drop("docs")


@register("agg_tfidf", C.query("SELECT course_id, mode, instructor, term, weight, round(score, 6) AS score FROM kw_score", "kw"))
def agg_tfidf(spark, sf):
    return _scored(spark, sf).withColumn("score", F.round("score", 6))


@register("agg_tfidf_off", C.query("SELECT course_id, mode, instructor, term, weight, round(score, 6) AS score FROM off_score", "kw"))
def agg_tfidf_off(spark, sf):
    return _scored(spark, sf, off=True).withColumn("score", F.round("score", 6))


def _rank_sql(source: str, k_max: int, fill: int, boost: str) -> str:
    return f"""SELECT course_id, mode, instructor, term, weight, pos FROM (
  SELECT *, (CASE WHEN weight >= 2 THEN r WHEN strong < least({fill}, n) THEN strong + r END)::BIGINT AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY course_id, mode, instructor, weight >= 2 ORDER BY round(bs, 9) DESC, term) AS r,
      count_if(weight >= 2) OVER (PARTITION BY course_id, mode, instructor) AS strong, count(*) OVER (PARTITION BY course_id, mode, instructor) AS n
    FROM (SELECT *, {boost} AS bs FROM {source}))) WHERE pos <= {k_max}"""


C.add(
    "kw_ranked",
    "kw_ranked AS (" + _rank_sql("kw_score", 25, 8, "score * CASE WHEN (course_id, term) IN (SELECT (course_id, term) FROM vocab) THEN 5 ELSE 1 END") + "),\n"
    "off_ranked AS (" + _rank_sql("off_score", 15, 5, "score") + ")",
    "kw",
)


def ranked(spark, sf):
    return kw.rank_keywords(_scored(spark, sf), _vocab(spark, sf))


def ranked_off(spark, sf, chunks=None):
    return kw.rank_off_curriculum(_scored(spark, sf, off=True, chunks=chunks))


def _rk():
    return ["course_id", "mode", "instructor", "term", "weight", F.col("rank").cast("long").alias("pos")]



@register("rnk_keywords", C.query("SELECT * FROM kw_ranked", "kw_ranked"))
def rnk_keywords(spark, sf):
    return ranked(spark, sf).select(*_rk())


@register("rnk_off_curriculum", C.query("SELECT * FROM off_ranked", "kw_ranked"))
def rnk_off_curriculum(spark, sf):
    return ranked_off(spark, sf).select(*_rk())


@register(
    "agg_average_keywords",
    C.query(
        """SELECT course_id, mode, term, value, pos FROM (
  SELECT course_id, mode, term, value, row_number() OVER (PARTITION BY course_id, mode ORDER BY CASE WHEN n = 1 THEN own END NULLS LAST, value DESC, term) AS pos FROM (
    SELECT course_id, mode, term, sum(weight)::BIGINT AS value, min(pos) AS own FROM kw_ranked GROUP BY ALL)
  JOIN (SELECT course_id, mode, count(DISTINCT instructor) AS n FROM kw_ranked GROUP BY ALL) USING (course_id, mode)) WHERE pos <= 25""",
        "kw_ranked",
    ),
)
def agg_average_keywords(spark, sf):
    return kw.average_keywords(ranked(spark, sf)).select("course_id", "mode", "term", "value", F.col("rank").cast("long").alias("pos"))


# --- ranking and insights ----------------------------------------------------
@register(
    "rnk_evidence",
    C.query(
        f"""SELECT course_id, instructor, section_id, source_label, locator, rank, round(score, 6) AS score,
  CASE WHEN length(b) > {fv.SNIPPET_LIMIT} THEN rtrim(substr(b, 1, {fv.SNIPPET_LIMIT - 1})) || '…' ELSE b END AS snippet FROM (
  SELECT *, {k.norm('text')} AS b, row_number() OVER (PARTITION BY course_id, instructor, section_id ORDER BY round(score, 9) DESC, token_count DESC, source_id, chunk_seq, part_no) AS rank
  FROM assigned WHERE section_id IS NOT NULL) WHERE rank <= 3""",
        "assigned",
    ),
)
def rnk_evidence(spark, sf):
    rows = assignments(spark, sf).withColumn("score", F.round("score", 9))
    return co.evidence_topk(rows).select(
        "course_id", "instructor", "section_id", "source_label", "locator", F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"), "snippet",
    )


C.add("comb", "comb AS (SELECT *, target_weight / 100 AS target_share, round(average_share, 6) AS peer FROM cov WHERE mode = 'combined')", "cov")
C.add(
    "gap_metrics",
    """
tgap AS (SELECT course_id, instructor, section_id, title, token_share, target_share, token_share - target_share AS gap FROM comb
  QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY abs(token_share - target_share) DESC, instructor_ord, section_ord) = 1),
pgap AS (SELECT course_id, instructor, total_gap FROM (SELECT course_id, instructor, instructor_ord, sum(abs(token_share - peer)) AS total_gap FROM comb GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY total_gap DESC, instructor_ord) = 1),
drift AS (SELECT course_id, section_id, title, average_share, target_share, average_share - target_share AS gap FROM (
  SELECT course_id, section_id, section_ord, title, any_value(peer) AS average_share, any_value(target_share) AS target_share FROM comb GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY abs(average_share - target_share) DESC, section_ord) = 1),
common_off AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY instructors DESC, term) AS pos FROM (
  SELECT course_id, term, count(*) AS instructors FROM off_ranked WHERE mode = 'combined' AND pos <= 8 GROUP BY ALL HAVING count(*) >= 2)) WHERE pos <= 5)""",
    "comb", "kw_ranked",
)


@register(
    "rnk_target_gap",
    C.query("SELECT course_id, instructor, section_id, round(token_share, 6) AS token_share, round(gap, 6) AS gap FROM tgap", "gap_metrics"),
)
def rnk_target_gap(spark, sf):
    best = ins.strongest_target_gap(coverage(spark, sf))
    return best.select("course_id", "instructor", "section_id", F.round("token_share", 6).alias("token_share"), F.round("gap", 6).alias("gap"))


@register("rnk_peer_gap", C.query("SELECT course_id, instructor, round(total_gap, 5) AS total_gap FROM pgap", "gap_metrics"))
def rnk_peer_gap(spark, sf):
    best = ins.strongest_peer_gap(coverage(spark, sf))
    return best.select("course_id", "instructor", F.round("total_gap", 5).alias("total_gap"))


@register(
    "rnk_drift",
    C.query("SELECT course_id, section_id, average_share, round(target_share, 6) AS target_share, round(gap, 6) AS gap FROM drift", "gap_metrics"),
)
def rnk_drift(spark, sf):
    best = ins.curriculum_drift(coverage(spark, sf))
    return best.select("course_id", "section_id", "average_share", F.round("target_share", 6).alias("target_share"), F.round("gap", 6).alias("gap"))


@register("rnk_common_off_curriculum", C.query("SELECT course_id, term, instructors, pos FROM common_off", "gap_metrics"))
def rnk_common_off_curriculum(spark, sf):
    return kw.common_off_curriculum(ranked_off(spark, sf)).select(
        "course_id", "term", "instructors", F.col("rank").cast("long").alias("pos")
    )


C.add(
    "gaps",
    """
gap_all AS (SELECT course_id, instructor, instructor_ord, section_id, section_ord, title, actual, benchmark, round(abs(actual - benchmark), 1) AS gap,
    CASE WHEN actual < benchmark THEN 'raise' ELSE 'trim' END AS direction FROM (SELECT *, round(token_share * 100, 1) AS actual, round(target_weight, 1) AS benchmark FROM comb)),
gap_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id, instructor ORDER BY gap DESC, section_ord) AS rank FROM gap_all) WHERE rank <= 4 AND (gap > 0 OR rank = 1)),
gaps AS (SELECT *, least(round(sum(gap) OVER (PARTITION BY course_id, instructor), 1), 100.0) AS total_gap FROM gap_top)""",
    "comb",
)


@register("rnk_gap_report", C.query("SELECT course_id, instructor, section_id, actual, benchmark, gap, direction, rank, total_gap::DOUBLE AS total_gap FROM gaps", "gaps"))
def rnk_gap_report(spark, sf):
    return ins.gap_report(coverage(spark, sf)).select(
        "course_id", "instructor", "section_id", "actual", "benchmark", "gap", "direction", F.col("rank").cast("long").alias("rank"), "total_gap"
    )


def _pct(x: str) -> str:
    return f"coalesce(round({x} * 100, 1)::VARCHAR, '0.0')"


@register(
    "ins_cards",
    C.query(
        f"""SELECT c.course_id, 1 AS card_no, 'target-gap' AS category, coalesce(g.instructor, 'no instructor') || ' is furthest from the target in ' || coalesce(g.title, 'no section') AS issue,
  'actual ' || {_pct('g.token_share')} || '%, target ' || {_pct('g.target_share')} || '%, difference ' || {_pct('g.gap')} || ' points' AS evidence FROM (SELECT DISTINCT course_id FROM lanes) c LEFT JOIN tgap g USING (course_id)
UNION ALL SELECT c.course_id, 2, 'avg-gap', coalesce(g.instructor, 'no instructor') || ' deviates most from the other instructors', 'sum of deviations ' || {_pct('g.total_gap')} || ' points' FROM (SELECT DISTINCT course_id FROM lanes) c LEFT JOIN pgap g USING (course_id)
UNION ALL SELECT c.course_id, 3, 'off-curriculum-individual', coalesce(g.instructor, 'no instructor') || ' stresses terms outside the curriculum', coalesce(g.words, 'no special terms') FROM (SELECT DISTINCT course_id FROM lanes) c LEFT JOIN (
  SELECT o.course_id, o.instructor, string_agg(term, ', ' ORDER BY pos) AS words FROM off_ranked o JOIN (SELECT course_id, arg_min(instructor, instructor_ord) AS instructor FROM lanes l
    WHERE EXISTS (SELECT 1 FROM off_ranked r WHERE r.mode = 'combined' AND r.course_id = l.course_id AND r.instructor = l.instructor) GROUP BY ALL) f USING (course_id, instructor) WHERE mode = 'combined' AND pos <= 3 GROUP BY ALL) g USING (course_id)
UNION ALL SELECT c.course_id, 4, 'curriculum-drift', coalesce(g.title, 'no section') || ' differs most between target and practice', 'mean ' || {_pct('g.average_share')} || '%, target ' || {_pct('g.target_share')} || '%, difference ' || {_pct('g.gap')} || ' points' FROM (SELECT DISTINCT course_id FROM lanes) c LEFT JOIN drift g USING (course_id)
UNION ALL SELECT c.course_id, 5, 'off-curriculum-common', 'several instructors teach the same terms outside the curriculum', coalesce(g.words, 'no shared terms') FROM (SELECT DISTINCT course_id FROM lanes) c
  LEFT JOIN (SELECT course_id, string_agg(term, ', ' ORDER BY pos) AS words FROM common_off WHERE pos <= 3 GROUP BY ALL) g USING (course_id)""",
        "gap_metrics", "lanes",
    ),
)
def ins_cards(spark, sf):
    # coverage and keywords read other columns of the chunks, so Spark would make and shuffle them for each
    kept = stored(v.kept_chunks(spark, sf).select("course_id", "instructor", "source_label", "source_type", "text"))
    chunks = measure_chunks(kept)
    shares = coverage(spark, sf, chunks)
    off = ranked_off(spark, sf, chunks)
    return ins.insight_cards(
        ins.strongest_target_gap(shares), ins.strongest_peer_gap(shares), ins.curriculum_drift(shares), off,
        kw.common_off_curriculum(off), instructors(spark, sf),
    )


C.add(
    "gap_lines",
    """
gap_mean AS (SELECT course_id, section_ord, title, round(avg(actual), 1) AS value, any_value(benchmark) AS benchmark FROM gap_all GROUP BY ALL),
gap_listed AS (
  SELECT course_id, 1 AS part, -gap AS o1, section_ord AS o2, title AS subject, value, benchmark, gap, CASE WHEN value < benchmark THEN 'below' ELSE 'above' END AS side
  FROM (SELECT *, round(abs(value - benchmark), 1) AS gap FROM gap_mean) WHERE gap > 0
  UNION ALL SELECT course_id, 2, 0, instructor_ord, instructor || ': ' || title, actual, benchmark, gap, CASE WHEN actual < benchmark THEN 'below' ELSE 'above' END FROM gaps WHERE rank = 1 AND gap >= 5),
gap_fill AS (SELECT course_id, 3, 0, 0, 'mean of the summed gaps', value, 0, value, 'above' FROM (SELECT course_id, round(avg(total_gap), 1) AS value FROM gaps WHERE rank = 1 GROUP BY ALL)
  WHERE (SELECT count(*) FROM gap_listed l WHERE l.course_id = course_id) < 5),
gap_lines AS (SELECT course_id, row_number() OVER (PARTITION BY course_id ORDER BY part, o1, o2) AS pos, subject, value, benchmark, gap, side FROM (SELECT * FROM gap_listed UNION ALL SELECT * FROM gap_fill) QUALIFY pos <= 8)""",
    "gaps",
)


@register("ins_gap_insights", C.query("SELECT * FROM gap_lines", "gap_lines"))
def ins_gap_insights(spark, sf):
    lines = ins.gap_insights(coverage(spark, sf))
    return lines.withColumn("pos", F.col("pos").cast("long"))




@register(
    "ins_external",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, CASE WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN '' ELSE 'i' || turn END AS text,
  CASE WHEN turn % 2 = 0 THEN '신규' ELSE '갭' END AS badge FROM conversations)
SELECT conv_id::VARCHAR AS course_id, CASE WHEN count_if(r <= 10 AND text <> '') >= 5 THEN coalesce(string_agg(text || ':' || turn, ',' ORDER BY turn) FILTER (r <= 10 AND text <> ''), '') ELSE 'rule:0' END AS insights,
  CASE WHEN count_if(r <= 6) >= 2 THEN coalesce(string_agg('t' || turn || '/' || badge, ',' ORDER BY turn) FILTER (r <= 6), '') ELSE 'rule/신규' END AS trends FROM t GROUP BY conv_id""",
)
def ins_external(spark, sf):
    rows = v.table(spark, sf, "conversations")
    text = F.when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 2 == 0), "").otherwise(F.concat(F.lit("i"), F.col("turn").cast("string")))
    item = F.struct(
        "turn",
        F.struct(text.alias("text"), F.array(F.struct(F.lit("a").alias("label"), F.col("turn").alias("value"))).alias("numbers")).alias("i"),
        F.struct(
            F.concat(F.lit("t"), F.col("turn").cast("string")).alias("title"),
            F.when(F.col("turn") % 2 == 0, "신규").otherwise("other").alias("badge"),
        ).alias("t"),
    )
    external = rows.groupBy(F.col("conv_id").cast("string").alias("course_id")).agg(F.sort_array(F.collect_list(item)).alias("x")).select(
        "course_id", F.to_json(F.struct(F.col("x.i").alias("insights"), F.col("x.t").alias("trendAnalysis"))).alias("raw")
    )
    fallback = external.select(
        "course_id",
        F.expr("array(named_struct('text', 'rule', 'numbers', array(named_struct('label', 'a', 'value', 0D, 'benchmark', 0D, 'topic', ''))))").alias("insights"),
        F.expr("array(named_struct('title', 'rule', 'detail', '', 'badge', '신규', 'comparison', ''))").alias("trends"),
    )
    merged = ins.merge_external_insights(external, fallback)
    return merged.select(
        "course_id",
        F.expr("array_join(transform(insights, i -> concat(i.text, ':', cast(bigint(i.numbers[0].value) AS string))), ',')").alias("insights"),
        F.expr("array_join(transform(trends, t -> concat(t.title, '/', t.badge)), ',')").alias("trends"),
    )
