"""Run, video and asset queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curricle.operators import ranking as rk
from curricle.operators import runs as ru
from curricle.plans import views as v
from curricle.plans.registry import register
from curricle.plans.text_queries import video_urls
from curricle.plans.views import C

NOW = "TIMESTAMP '1998-08-01 00:00:00'"


def _now():
    return F.expr(NOW)


C.add("videos", "videos AS (SELECT o_custkey % 50 AS course_id, o_custkey AS playlist_id, o_orderkey AS video_id, floor(o_totalprice)::BIGINT % 7200 AS duration_s FROM orders)")


def videos(spark, sf):
    return v.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("course_id"), F.col("o_custkey").alias("playlist_id"), F.col("o_orderkey").alias("video_id"),
        (F.floor("o_totalprice") % 7200).alias("duration_s"),
    )


C.add(
    "manifest",
    "manifest AS (SELECT course_id, sum(n)::BIGINT AS video_count, sum(d)::BIGINT AS total_duration_s, count(*) AS inputs, count_if(n > 1)::BIGINT AS playlists, count_if(n > 15)::BIGINT AS over_limit "
    "FROM (SELECT course_id, playlist_id, count(*) AS n, sum(duration_s) AS d FROM videos GROUP BY ALL) GROUP BY ALL)",
    "videos",
)


def manifest(spark, sf):
    return ru.manifest_summary(videos(spark, sf), limit=15)


@register("run_manifest", C.query("SELECT * FROM manifest", "manifest"))
def run_manifest(spark, sf):
    return manifest(spark, sf)


@register("run_probe_size", C.query("SELECT playlist_id, count(*) AS n, CASE WHEN count(*) * 12 > 200 THEN 0 WHEN count(*) * 12 > 30 THEN 3 ELSE 20 END::BIGINT AS probe FROM videos GROUP BY ALL", "videos"))
def run_probe_size(spark, sf):
    counts = videos(spark, sf).groupBy("playlist_id").agg(F.count("*").alias("n"))
    return counts.withColumn("probe", ru.probe_size(F.col("n") * 12).cast("long"))


C.add(
    "rates",
    "rates AS (SELECT course_id, count(*) AS sample_count, count_if(video_id % 3 > 0) AS success_count, coalesce(CASE WHEN count_if(video_id % 3 > 0) > 0 THEN sum(duration_s * 2) FILTER (video_id % 3 > 0)::DOUBLE / sum(duration_s) FILTER (video_id % 3 > 0) END, 0) AS tokens_per_second, "
    "avg(video_id % 4 + 0.5) AS fetch_seconds FROM videos WHERE video_id % 10 = 3 GROUP BY ALL)",
    "videos",
)
C.add(
    "estimates",
    "est0 AS (SELECT m.*, r.success_count, r.fetch_seconds, CASE WHEN r.tokens_per_second > 0 AND m.total_duration_s > 0 THEN ceil(m.total_duration_s * r.tokens_per_second) WHEN r.success_count > 0 THEN m.video_count * 6500 ELSE 0 END::BIGINT AS est_tokens FROM manifest m LEFT JOIN rates r USING (course_id)),\n"
    "estimates AS (SELECT *, ceil(est_tokens / 550)::BIGINT AS est_chunks FROM est0)",
    "manifest", "rates",
)


def _estimates(spark, sf):
    # a sampled table of fetched videos: every tenth video was probed, a third of the probes failed
    probed = videos(spark, sf).filter(F.col("video_id") % 10 == 3)
    sample = probed.withColumn("tokens", F.when(F.col("video_id") % 3 > 0, F.col("duration_s") * 2)).withColumn("fetch_s", F.col("video_id") % 4 + 0.5)
    return ru.estimate_tokens(ru.sample_rates(sample), manifest(spark, sf))


@register("run_token_estimates", C.query("SELECT course_id, est_tokens, est_chunks FROM estimates", "estimates"))
def run_token_estimates(spark, sf):
    return _estimates(spark, sf).select("course_id", "est_tokens", "est_chunks")


_MODE = "CASE WHEN video_count <= 350 AND est_chunks <= 4500 AND est_tokens <= 2450000 THEN 'vector' ELSE 'lexical' END"
_LIMITS = {"videos": 350, "chunks": 4500, "tokens": 2_450_000}


@register("run_mode", C.query(f"SELECT course_id, {_MODE} AS mode FROM estimates", "estimates"))
def run_mode(spark, sf):
    return ru.recommend_mode(_estimates(spark, sf), limits=_LIMITS).select("course_id", "mode")


@register(
    "run_cost",
    C.query(
        f"SELECT course_id, ceil(coalesce(fetch_seconds, 1.2) * video_count / 6 + est_chunks * 0.03 + 20)::BIGINT AS est_seconds, CASE WHEN {_MODE} = 'vector' AND est_tokens > 0 "
        "THEN round(est_tokens / 1e6 * 0.02 + greatest(3000, 900 * 3 + 450 * 8) / 1e6 * 0.75 + 1200 / 1e6 * 4.5, 4) ELSE 0 END::DOUBLE AS est_cost FROM estimates",
        "estimates",
    ),
)
def run_cost(spark, sf):
    rows = ru.recommend_mode(_estimates(spark, sf), limits=_LIMITS).withColumn("instructors", F.lit(3)).withColumn("sections", F.lit(8))
    return ru.estimate_cost(rows).select("course_id", "est_seconds", "est_cost")


C.add(
    "run_rows",
    "run_rows AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS course_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS updated_at FROM orders)",
)


def runs(spark, sf):
    status = F.col("o_orderstatus")
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).alias("course_id"),
        F.when(status == "F", "completed").when(status == "O", "queued").otherwise("running").alias("status"), F.col("o_orderdate").alias("updated_at"),
    )


def _run():
    return ["run_id", "course_id", "status", F.unix_timestamp("updated_at").alias("updated")]

_RSQL = "run_id, course_id, status, epoch(updated_at)::BIGINT AS updated"


@register(
    "run_retention",
    C.query(f"SELECT {_RSQL} FROM (SELECT * FROM run_rows WHERE epoch({NOW}) - epoch(updated_at) <= 7 * 86400 ORDER BY updated_at DESC, run_id DESC LIMIT 20)", "run_rows"),
)
def run_retention(spark, sf):
    return ru.retain_runs(runs(spark, sf), _now()).select(*_run())


@register("run_recent", C.query(f"SELECT {_RSQL} FROM (SELECT * FROM run_rows ORDER BY updated_at DESC, run_id DESC LIMIT 15)", "run_rows"))
def run_recent(spark, sf):
    return ru.recent_runs(runs(spark, sf), 15).select(*_run())


@register("run_latest_per_course", C.query(f"SELECT {_RSQL} FROM run_rows QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY updated_at DESC, run_id DESC) = 1", "run_rows"))
def run_latest_per_course(spark, sf):
    return ru.latest_per_course(runs(spark, sf)).select(*_run())


C.add(
    "cust_runs",
    "cust_runs AS (SELECT o_custkey AS course_id, o_orderkey AS run_id, CASE WHEN o_totalprice > 400000 THEN 'queued' ELSE 'completed' END AS status FROM orders),\n"
    "doomed AS (SELECT c_custkey AS course_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT course_id FROM cust_runs WHERE status = 'queued'))",
)


@register(
    "run_delete_courses",
    C.query(
        "SELECT 'course' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS checksum FROM customer WHERE c_custkey NOT IN (SELECT course_id FROM doomed) "
        "UNION ALL SELECT 'run', count(*), sum(run_id)::BIGINT FROM cust_runs WHERE course_id NOT IN (SELECT course_id FROM doomed) UNION ALL SELECT 'preparation', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT course_id FROM doomed)",
        "cust_runs",
    ),
)
def run_delete_courses(spark, sf):
    courses = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("course_id"))
    run_rows = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_totalprice") > 400000, "queued").otherwise("completed").alias("status")
    )
    wanted = courses.filter(F.col("course_id") % 2 == 0)
    left = ru.delete_courses(courses, run_rows, courses, wanted)
    names = [("course", "course_id"), ("run", "run_id"), ("preparation", "course_id")]
    sums = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(c).alias("checksum")) for df, (kind, c) in zip(left, names)]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


@register(
    "run_stalled",
    "SELECT o_orderkey AS run_id, (o_orderkey % 400 + 30)::BIGINT AS queue_wait_s, (o_orderkey % 400)::BIGINT AS idle_s, (o_orderstatus = 'O' AND o_orderkey % 400 >= 90) OR (o_orderstatus NOT IN ('O', 'F') AND o_orderkey % 400 >= 180) AS is_stalled FROM orders",
)
def run_stalled(spark, sf):
    ago = F.unix_timestamp(_now()) - F.col("o_orderkey") % 400
    status = F.col("o_orderstatus")
    rows = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(status == "O", "queued").when(status == "F", "completed").otherwise("running").alias("status"),
        F.timestamp_seconds(ago).alias("updated_at"), F.timestamp_seconds(ago - 30).alias("created_at"),
    )
    return ru.stalled_runs(rows, _now()).select("run_id", "queue_wait_s", "idle_s", "is_stalled")


@register(
    "run_cache",
    f"""WITH c AS (SELECT o_custkey AS key, o_orderkey AS value, o_orderdate AS stored_at, o_orderdate + INTERVAL 400 DAY AS expires_at FROM orders WHERE o_orderkey % 5 > 0),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY stored_at DESC, value DESC) = 1)
SELECT c_custkey AS key, coalesce(n.value, -1) AS value, coalesce(n.expires_at <= {NOW}, false) AS is_stale, n.key IS NOT NULL AS hit FROM customer LEFT JOIN n ON n.key = c_custkey""",
)
def run_cache(spark, sf):
    cache = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"),
        F.struct(F.col("o_orderdate"), F.col("o_orderkey")).alias("stored_at"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"),
        F.when(F.col("o_orderkey") % 5 > 0, 1).otherwise(0).alias("schema_version"),
    )
    requests = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return ru.cache_lookup(requests, cache, _now(), True).withColumn("value", F.coalesce("value", F.lit(-1)))


_BUDGET = 600


@register(
    "run_budget",
    f"""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS seq, floor(o_totalprice)::BIGINT % 7200 AS d FROM orders),
f AS (SELECT month, list_reduce(list_transform(list({{'s': seq, 'd': d}} ORDER BY seq), lambda x: {{'s': x.s, 'd': x.d, 'used': 0::DOUBLE, 'ok': []::BIGINT[]}}), lambda a, x: CASE WHEN x.d <= 0 OR a.used + x.d / 60 <= {_BUDGET}
  THEN {{'s': x.s, 'd': x.d, 'used': CASE WHEN x.d <= 0 THEN a.used ELSE round(a.used + x.d / 60, 4) END, 'ok': list_append(a.ok, x.s)}} ELSE a END, {{'s': 0::BIGINT, 'd': 0::BIGINT, 'used': 0::DOUBLE, 'ok': []::BIGINT[]}}).ok AS ok FROM r GROUP BY month)
SELECT r.month, r.seq, list_contains(f.ok, r.seq) AS accepted FROM r JOIN f USING (month)""",
)
def run_budget(spark, sf):
    requests = v.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("seq"), (F.floor("o_totalprice") % 7200).alias("duration_s")
    )
    return ru.budget_gate(requests, _BUDGET).select("month", "seq", "accepted")


@register(
    "run_merge_courses",
    "SELECT id, name FROM (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0))",
)
def run_merge_courses(spark, sf):
    customer, supplier = v.table(spark, sf, "customer"), v.table(spark, sf, "supplier")
    primary = customer.filter(F.col("c_custkey") % 3 > 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("updated_at"))
    fallback = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("updated_at"))
    return ru.merge_courses(primary, fallback).select("id", "name")


@register(
    "run_counters",
    "SELECT l_orderkey AS run_id, count(DISTINCT l_suppkey) AS instructor_count, count_if(l_linenumber % 3 < 2)::BIGINT AS asset_count, count_if(l_linenumber % 3 = 2)::BIGINT AS video_count FROM lineitem GROUP BY ALL",
)
def run_counters(spark, sf):
    style = F.col("l_linenumber") % 3
    assets = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("instructor"), F.when(style == 0, "file").when(style == 1, "voc_file").otherwise("video").alias("kind")
    )
    return ru.run_counters(assets)


@register(
    "run_warnings",
    "SELECT message, stage::BIGINT AS stage, seq FROM (SELECT 0 AS stage, p_partkey AS seq, p_name || ' ' || p_type AS message FROM part UNION ALL SELECT 1, p_partkey, p_type FROM part UNION ALL SELECT 1, p_partkey, ' ' FROM part) WHERE trim(message) <> '' QUALIFY row_number() OVER (PARTITION BY trim(message) ORDER BY stage, seq) = 1",
)
def run_warnings(spark, sf):
    part = v.table(spark, sf, "part")
    first = part.select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(" "), "p_type").alias("message"))
    second = part.select(F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), "p_type").alias("message"))
    blank = part.select(F.col("p_partkey").alias("seq"), F.lit(" ").alias("message"))
    return ru.collect_warnings(first, second.unionByName(blank)).withColumn("stage", F.col("stage").cast("long"))


@register(
    "run_status",
    """SELECT run_id, CASE WHEN a = 0 THEN 'error: no instructor has material' WHEN c > 0 THEN 'ready' WHEN f > 0 THEN 'feedback only' WHEN l THEN 'error: video requests were limited' ELSE 'error: no analysable text' END AS status FROM (
  SELECT l_orderkey AS run_id, count_if(l_linenumber > 1 OR l_orderkey % 9 > 0) AS a, count_if(l_quantity > 45) AS c, count_if(l_quantity < 8) AS f, bool_or(l_discount > 0.08) AS l FROM lineitem GROUP BY ALL)""",
)
def run_status(spark, sf):
    rows = v.table(spark, sf, "lineitem").withColumn("run_id", F.col("l_orderkey"))
    return ru.run_status(
        rows.filter((F.col("l_linenumber") > 1) | (F.col("l_orderkey") % 9 > 0)), rows.filter(F.col("l_quantity") > 45), rows.filter(F.col("l_quantity") < 8),
        rows.select("run_id", (F.col("l_discount") > 0.08).alias("rate_limited")),
    )


@register(
    "run_expand_playlists",
    C.query(
        """, ent AS (SELECT u AS input_url, n AS entry_no, CASE WHEN n = 2 THEN ' ' ELSE 'v' || page_id || '-' || n END AS vid, n * 60 AS d FROM video_urls, (SELECT unnest(range(4)) AS n) WHERE page_id % 8 IN (2, 4)),
inp AS (SELECT u, page_id, host, path, v, lst, page_id % 8 IN (2, 4) AS has FROM video_urls WHERE list_contains(['www.youtube.com', 'youtube.com', 'm.youtube.com', 'youtu.be'], host))
SELECT input_url, entry_no, video_id, 'https://www.youtube.com/watch?v=' || video_id AS url, duration_s FROM (
  SELECT i.u AS input_url, e.entry_no, e.vid AS video_id, e.d::BIGINT AS duration_s FROM inp i JOIN ent e ON e.input_url = i.u WHERE trim(e.vid) <> ''
  UNION ALL SELECT u, 0, coalesce(v, CASE WHEN host = 'youtu.be' THEN split_part(path, '/', 1) END, regexp_extract(path, '^(shorts|live|embed)/+([^/]+)', 2)), 0 FROM inp WHERE NOT has)""",
        "video_urls",
    ),
)
def run_expand_playlists(spark, sf):
    urls = video_urls(spark, sf)
    entries = urls.filter((F.col("page_id") % 8).isin(2, 4)).select(
        F.col("u").alias("input_url"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("entry_no"), "page_id"
    ).select(
        "input_url", "entry_no",
        F.when(F.col("entry_no") == 2, " ").otherwise(F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit("-"), F.col("entry_no").cast("string"))).alias("id"),
        F.lit("title").alias("title"), (F.col("entry_no") * 60).alias("duration"),
    )
    out = ru.expand_playlists(urls.select(F.col("u").alias("input_url")), entries)
    return out.select("input_url", "entry_no", "video_id", "url", "duration_s")


@register(
    "rnk_even_sample",
    C.query(
        """, o AS (SELECT playlist_id, video_id, row_number() OVER (PARTITION BY playlist_id ORDER BY video_id) - 1 AS pos, count(*) OVER (PARTITION BY playlist_id) AS n FROM videos),
w AS (SELECT DISTINCT playlist_id, CASE WHEN n <= 6 THEN i ELSE round_even(i * (n - 1) / 5, 0)::BIGINT END AS pos FROM (SELECT DISTINCT playlist_id, n FROM o), (SELECT unnest(range(200)) AS i) WHERE i < least(n, CASE WHEN n <= 6 THEN n ELSE 6 END))
SELECT playlist_id, video_id, pos FROM o JOIN w USING (playlist_id, pos)""",
        "videos",
    ),
)
def rnk_even_sample(spark, sf):
    rows = videos(spark, sf).select("playlist_id", "video_id")
    positioned = rk.dense_positions(rows, ["playlist_id"], "video_id")
    sizes = rows.groupBy("playlist_id").agg(F.count("*").alias("total"))
    return rk.even_sample(positioned, ["playlist_id"], 6, sizes).select("playlist_id", "video_id", "pos")

