"""Operational tables: videos, estimates, runs, caches, courses, warnings."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import col
from curricle.functions.text import canonical_url, is_playlist_url, is_video_url, video_id
from curricle.operators.ranking import dense_positions
from curricle.operators.scale import stored, top_rows

# the block folds travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- videos and estimates -------------------------------------------------------------
def manifest_summary(videos: DataFrame, by: tuple[str, ...] = ("course_id",), limit: int = fv.PLAYLIST_HARD_LIMIT) -> DataFrame:
    """Videos, duration and playlists per run; playlists above the limit are counted."""
    by = list(by)
    inputs = videos.groupBy(*by, "playlist_id").agg(
        F.count("*").alias("videos"),
        F.sum(F.greatest(F.lit(0), F.coalesce("duration_s", F.lit(0)))).alias("duration_s"),
    )
    return inputs.groupBy(*by).agg(
        F.sum("videos").alias("video_count"),
        F.sum("duration_s").alias("total_duration_s"),
        F.count("*").alias("inputs"),
        F.count_if(F.col("videos") > 1).alias("playlists"),
        F.count_if(F.col("videos") > limit).alias("over_limit"),
    )


def probe_size(n: str | Column) -> Column:
    n, limits = col(n), fv.PROBE_LIMITS
    return (
        F.when(n <= 0, 0)
        .when(n > limits["none_above"], 0)
        .when(n > limits["full_up_to"], limits["partial"])
        .otherwise(limits["full"])
    )


def sample_rates(sample: DataFrame, by: tuple[str, ...] = ("course_id",)) -> DataFrame:
    """Tokens per second and fetch time of sampled videos (``tokens`` null = failed)."""
    ok = F.col("tokens").isNotNull()
    facts = sample.groupBy(*by).agg(
        F.count("*").alias("sample_count"),
        F.count_if(ok).alias("success_count"),
        F.sum("tokens").alias("t"),
        F.sum(F.when(ok, F.greatest(F.lit(0), F.col("duration_s")))).alias("d"),
        F.avg("fetch_s").alias("fetch"),
    )
    rate = F.when(
        (F.col("success_count") > 0) & (F.col("t") > 0),
        F.when(F.col("d") > 0, F.col("t") / F.col("d")).otherwise(F.col("t") / F.col("success_count") / 3600),
    )
    return facts.select(
        *by, "sample_count", "success_count",
        F.coalesce(rate, F.lit(0.0)).alias("tokens_per_second"),
        F.coalesce("fetch", F.lit(fv.DEFAULT_FETCH_SECONDS)).alias("fetch_seconds"),
    )


def estimate_tokens(rates: DataFrame, manifest: DataFrame, by: tuple[str, ...] = ("course_id",), target: int = fv.CHUNK_TARGET) -> DataFrame:
    """Expected transcript tokens and chunks per run."""
    joined = manifest.join(rates, list(by), "left")
    tokens = (
        F.when(F.col("video_count") <= 0, 0)
        .when(
            (F.col("tokens_per_second") > 0) & (F.col("total_duration_s") > 0),
            F.ceil(F.col("total_duration_s") * F.col("tokens_per_second")),
        )
        .when(F.col("success_count") > 0, F.col("video_count") * fv.TOKENS_PER_VIDEO)
        .otherwise(0)
        .cast("long")
    )
    return joined.withColumn("est_tokens", tokens).withColumn(
        "est_chunks", F.ceil(F.col("est_tokens") / max(1, target)).cast("long")
    )


def estimate_cost(estimates: DataFrame, concurrency: int = fv.FETCH_CONCURRENCY, prices: dict = fv.PRICES) -> DataFrame:
    """Processing seconds and price; ``mode, instructors, sections`` come with the row."""
    fetch = F.coalesce("fetch_seconds", F.lit(fv.DEFAULT_FETCH_SECONDS))
    seconds = F.when(F.col("video_count") <= 0, 0).otherwise(
        F.ceil(fetch * F.col("video_count") / max(1, concurrency) + F.col("est_chunks") * 0.03 + 20)
    )
    insight_in = F.greatest(
        F.lit(3000),
        900 * F.greatest(F.lit(1), F.col("instructors")) + 450 * F.greatest(F.lit(1), F.col("sections")),
    )
    cost = (
        F.col("est_tokens") / 1e6 * prices["embedding"]
        + insight_in / 1e6 * prices["insight_in"]
        + fv.INSIGHT_OUTPUT_TOKENS / 1e6 * prices["insight_out"]
    )
    paid = (F.col("mode") == "vector") & (F.col("est_tokens") > 0)
    return estimates.withColumn("est_seconds", seconds.cast("long")).withColumn(
        "est_cost", F.when(paid, F.round(cost, 4)).otherwise(0.0)
    )


def recommend_mode(estimates: DataFrame, vectors_available: bool = True, limits: dict = fv.SMALL_RUN_LIMITS) -> DataFrame:
    """Vector scoring for small runs only."""
    small = (
        F.lit(vectors_available)
        & (F.col("video_count") <= limits["videos"])
        & (F.col("est_chunks") <= limits["chunks"])
        & (F.col("est_tokens") <= limits["tokens"])
    )
    return estimates.withColumn("mode", F.when(small, "vector").otherwise("lexical"))


def expand_playlists(inputs: DataFrame, entries: DataFrame, max_videos: int = fv.PLAYLIST_HARD_LIMIT) -> DataFrame:
    """Submitted URLs → videos; a lone video without metadata falls back to its id.

    ``inputs``: ``input_url``, of which each counts once; ``entries``: ``input_url,
    entry_no, id, title, duration``.  Lists above the limit are flagged, not cut.
    """
    raw_id = F.trim(F.coalesce("id", F.lit("")))
    path = F.trim(F.try_parse_url(raw_id, F.lit("PATH")), F.lit("/"))
    from_url = F.when(is_video_url(raw_id) & (path != ""), F.element_at(F.split(path, "/"), -1))
    vid = F.when(F.startswith(raw_id, F.lit("http")), F.coalesce(from_url, raw_id)).otherwise(raw_id)
    usable = entries.withColumn("vid", vid).filter(F.col("vid") != "")
    counts = entries.groupBy("input_url").agg(F.count("*").alias("listed"))
    known = inputs.select("input_url").distinct().filter(is_video_url("input_url")).withColumn("is_playlist", is_playlist_url("input_url"))
    joined = known.join(counts, "input_url", "left").join(
        usable.select("input_url", "entry_no", "vid", "title", "duration"), "input_url", "left"
    )
    lone = F.when(~F.col("is_playlist") & F.col("listed").isNull(), video_id("input_url"))
    found = F.coalesce("vid", lone)
    return joined.filter(found.isNotNull()).select(
        "input_url",
        "is_playlist",
        F.coalesce("entry_no", F.lit(0)).alias("entry_no"),
        found.alias("video_id"),
        F.coalesce(
            F.nullif(F.trim("title"), F.lit("")), F.col("vid"),
            F.concat(F.lit("YouTube Video ("), lone, F.lit(")")),
        ).alias("title"),
        canonical_url(found).alias("url"),
        F.coalesce(F.col("duration").cast("long"), F.lit(0)).alias("duration_s"),
        (F.coalesce("listed", F.lit(1)) > max_videos).alias("over_limit"),
    )


# --- runs -----------------------------------------------------------------------------
def retain_runs(runs: DataFrame, now: Column, ttl_days: int = fv.RETENTION_DAYS, keep: int = fv.RETENTION_RUNS) -> DataFrame:
    """Newest runs that are not older than the retention time."""
    fresh = runs.filter(F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= ttl_days * 86_400)
    return fresh.orderBy(F.col("updated_at").desc(), F.col("run_id").desc()).limit(keep)


def recent_runs(runs: DataFrame, limit: int, course: object | None = None) -> DataFrame:
    chosen = runs if course is None else runs.filter(F.col("course_id") == F.lit(course))
    return chosen.orderBy(F.col("updated_at").desc(), F.col("run_id").desc()).limit(limit)


def latest_per_course(runs: DataFrame) -> DataFrame:
    """Newest run per course, as a map-side combined maximum."""
    others = [c for c in runs.columns if c not in ("course_id", "updated_at", "run_id")]
    newest = F.max(F.struct("updated_at", "run_id", *others)).alias("r")
    return runs.groupBy("course_id").agg(newest).select("course_id", "r.*")


def delete_courses(courses: DataFrame, runs: DataFrame, preparations: DataFrame, wanted: DataFrame):
    """Remaining courses, runs and preparations; courses with active runs stay."""
    active = runs.filter(F.col("status").isin("queued", "running")).select("course_id").distinct()
    doomed = wanted.select("course_id").distinct().join(active, "course_id", "left_anti")
    return tuple(df.join(doomed, "course_id", "left_anti") for df in (courses, runs, preparations))


def stalled_runs(runs: DataFrame, now: Column) -> DataFrame:
    def seconds(c: str) -> Column:
        return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(c))

    idle = seconds("updated_at")
    return (
        runs.withColumn("queue_wait_s", seconds("created_at"))
        .withColumn("idle_s", idle)
        .withColumn(
            "is_stalled",
            ((F.col("status") == "queued") & (idle >= fv.QUEUED_STALL_SECONDS))
            | ((F.col("status") == "running") & (idle >= fv.RUNNING_STALL_SECONDS)),
        )
    )


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, allow_stale: bool, version: int = 1) -> DataFrame:
    """Newest cached value per requested key, with a stale flag.

    ``cache``: ``key, schema_version, stored_at, expires_at, value``; an empty
    expiry never goes stale.
    """
    newest = (
        cache.filter(F.col("schema_version") == version)
        .groupBy("key")
        .agg(F.max_by(F.struct("value", "expires_at"), "stored_at").alias("c"))
    )
    stale = F.coalesce(F.col("c.expires_at") <= now, F.lit(False))
    usable = F.col("c").isNotNull() & (~stale | F.lit(allow_stale))
    return requests.join(newest, "key", "left").select(
        *requests.columns,
        F.when(usable, F.col("c.value")).alias("value"),
        F.coalesce(F.when(usable, stale), F.lit(False)).alias("is_stale"),
        usable.alias("hit"),
    )


def _units(minutes: float) -> int:
    """Used minutes are kept to four decimals; as whole units they add up exactly."""
    return round(minutes * 10_000)


def _spend(durations: np.ndarray, used: int, budget: int) -> tuple[np.ndarray, int]:
    """Which durations of a block are accepted in order, and the units used after it."""
    accepted = np.zeros(len(durations), bool)
    minutes = durations / 60.0
    cost = np.round(minutes * 10_000).astype(np.int64)
    begin = 0
    while begin < len(durations):
        # accept all up to the first that does not fit, then go on behind it
        before = used + np.cumsum(cost[begin:]) - cost[begin:]
        fits = before / 10_000.0 + minutes[begin:] <= budget
        stop = len(fits) if fits.all() else int(np.argmin(fits))
        accepted[begin : begin + stop] = True
        used += int(cost[begin : begin + stop].sum())
        begin += stop
        if begin < len(durations):
            # nothing longer than what is left can be accepted any more
            rest = np.flatnonzero(used / 10_000.0 + minutes[begin:] <= budget)
            if not len(rest):
                break
            begin += int(rest[0])
    return accepted, used


def _threshold(used: int, budget: int) -> int:
    """The power of two, in units, that the remainder reaches."""
    rest = _units(budget) - used
    return 1 << (rest.bit_length() - 1) if rest > 0 else 0


def budget_gate(requests: DataFrame, budget_minutes: int, block_rows: int = 16_384) -> DataFrame:
    """Requests (``month, seq, duration_s``) in order while the budget lasts.

    A request is accepted if what is used and its own minutes stay within the budget.  It
    uses its minutes rounded to four decimals, which for whole seconds is the same as
    rounding the sum; one rejected uses nothing, and a duration of zero or less is free.
    A null duration is rejected.

    A month is cut into blocks of requests.  While the remainder is at least 2^k, every
    request of up to 2^k is accepted, so the effect of a block is the sum of those; these
    sums compose by addition.  It holds up to the first block in which the remainder falls
    below 2^k or a longer request fits (which makes it fall as well): that block is folded
    in order, and the next round goes on behind it with a smaller k.  So a month of any
    length takes at most as many rounds as the budget has binary digits, all months
    advance together, and no task holds more than a block and a row per block of a month.
    """
    if budget_minutes <= 0:
        return requests.withColumn("accepted", F.lit(True))
    kind = requests.schema["month"].dataType.simpleString()
    paid = requests.filter("duration_s > 0").select(
        "month", F.col("seq").cast("long").alias("seq"), F.col("duration_s").cast("double").alias("d")
    )
    placed = dense_positions(paid, ["month"], "seq")
    blocks = stored(
        placed.withColumn("blk", F.floor(F.col("pos") / block_rows))
        .groupBy("month", "blk")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "d"))).alias("q"))
        .select("month", "blk", F.col("q.seq").alias("seqs"), F.col("q.d").alias("ds"))
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            costs = []
            for durations, used in zip(batch["ds"], batch["used"], strict=True):
                cost = np.round(np.asarray(durations) / 60.0 * 10_000).astype(np.int64)
                k = _threshold(int(used), budget_minutes)
                costs.append(int(cost[cost <= k].sum()) if k else 0)
            yield batch[["month", "blk", "used"]].assign(cost=costs)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Units before and after each block if nothing turned before it, and whether it turns."""
        for batch in batches:
            after, turns = [], []
            for durations, used, entry in zip(batch["ds"], batch["used"], batch["entry"], strict=True):
                k = _threshold(int(used), budget_minutes)
                durations = np.asarray(durations)
                accepted, left = _spend(durations, int(entry), budget_minutes)
                cost = np.round(durations / 60.0 * 10_000).astype(np.int64)
                after.append(left)
                small = (cost <= k) & (k > 0)
                turns.append(bool(_units(budget_minutes) - left < k or (accepted != small).any()))
            yield batch[["month", "blk", "entry"]].assign(after=after, turns=turns)

    state = blocks.select("month").distinct().select(
        "month", F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("used")
    )
    settled = None
    while True:
        ahead = blocks.join(state, "month").filter(F.col("blk") >= F.col("next"))
        cost = ahead.select("month", "blk", "ds", "used").mapInPandas(
            sums, f"month {kind}, blk long, used long, cost long"
        )
        before = Window.partitionBy("month").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        entry = F.col("used") + F.coalesce(F.sum("cost").over(before), F.lit(0))
        # once the remainder is certainly below the threshold, a block before has turned
        entries = cost.select("month", "blk", "used", entry.alias("entry")).filter(
            F.col("entry") <= _units(budget_minutes)
        )
        found = stored(
            blocks.join(entries, ["month", "blk"])
            .select("month", "blk", "ds", "used", "entry")
            .mapInPandas(settle, f"month {kind}, blk long, entry long, after long, turns boolean")
        )
        first = found.groupBy("month").agg(
            F.min(F.when(F.col("turns"), F.struct("blk", "after"))).alias("turn")
        )
        valid = found.join(first, "month").filter(F.col("turn").isNull() | (F.col("blk") <= F.col("turn.blk")))
        settled = valid.select("month", "blk", "entry") if settled is None else settled.unionAll(
            valid.select("month", "blk", "entry")
        )
        state = stored(
            first.filter("turn IS NOT NULL").select(
                "month", (F.col("turn.blk") + 1).alias("next"), F.col("turn.after").alias("used")
            )
        )
        if state.isEmpty():
            break

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for month, seqs, durations, entry in batch.itertuples(index=False):
                fits, _ = _spend(np.asarray(durations), int(entry), budget_minutes)
                parts.append(pd.DataFrame({"month": month, "seq": np.asarray(seqs)[fits]}))
            if parts:
                yield pd.concat(parts)

    accepted = (
        blocks.join(settled, ["month", "blk"])
        .select("month", "seqs", "ds", "entry")
        .mapInPandas(accept, f"month {kind}, seq long")
        .withColumn("_ok", F.lit(True))
    )
    return requests.join(accepted, ["month", "seq"], "left").withColumn(
        "accepted", F.coalesce((F.col("duration_s") <= 0) | F.col("_ok"), F.lit(False))
    ).drop("_ok")


def merge_courses(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary records plus fall-back records with an unknown id, newest first."""
    extra = fallback.join(primary.select("id"), "id", "left_anti")
    return primary.unionByName(extra).orderBy(F.col("updated_at").desc(), "id")


def run_counters(assets: DataFrame) -> DataFrame:
    """Asset, video and instructor counts per run."""
    return assets.groupBy("run_id").agg(
        F.countDistinct("instructor").alias("instructor_count"),
        F.count_if(F.col("kind").isin("file", "voc_file")).alias("asset_count"),
        F.count_if(F.col("kind") == "video").alias("video_count"),
    )


def collect_warnings(*frames: DataFrame) -> DataFrame:
    """Distinct messages of all stages; the first place in order is kept."""
    staged = [
        df.select(F.lit(i).alias("stage"), "seq", F.trim(F.coalesce("message", F.lit(""))).alias("message"))
        for i, df in enumerate(frames)
    ]
    merged = reduce(DataFrame.unionByName, staged).filter(F.col("message") != "")
    return merged.groupBy("message").agg(F.min(F.struct("stage", "seq")).alias("o")).select(
        "message", "o.stage", "o.seq"
    )


def run_status(assets: DataFrame, chunks: DataFrame, voc: DataFrame, warnings: DataFrame) -> DataFrame:
    """What a run can deliver: ready, feedback only, or the reason why nothing.

    Each frame has ``run_id``; ``warnings`` also ``rate_limited``.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count("*").alias(name))

    limited = warnings.groupBy("run_id").agg(F.bool_or("rate_limited").alias("limited"))
    facts = reduce(
        lambda a, b: a.join(b, "run_id", "full"),
        [counted(assets, "assets"), counted(chunks, "chunks"), counted(voc, "voc"), limited],
    )
    return facts.select(
        "run_id",
        F.when(F.coalesce("assets", F.lit(0)) == 0, "error: no instructor has material")
        .when(F.coalesce("chunks", F.lit(0)) > 0, "ready")
        .when(F.coalesce("voc", F.lit(0)) > 0, "feedback only")
        .when(F.coalesce("limited", F.lit(False)), "error: video requests were limited")
        .otherwise("error: no analysable text")
        .alias("status"),
    )
