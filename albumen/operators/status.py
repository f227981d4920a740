"""Processing states, pending work and throughput."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen.functions import media

STAGES = ("thumbnail", "exif", "ocr", "ai_vision", "map_detection", "face", "verify")
#: Stages that a client works on and reports.
CLIENT_STAGES = STAGES[:-1]
# States that nothing follows, and those counted by the matrix.
TERMINAL = ("done", "no_data", "deleted", "skipped", "unsupported", "failed", "timeout")
COUNTED = ("queued", "pending", "running", "failed", "no_data")
LEASE_SECONDS, STALE_SECONDS = 120, 900


def long_form(df: DataFrame, key: str = "photo_id", stages=STAGES) -> DataFrame:
    """(key, stage, status): one row per photo and stage, status lower-case and trimmed."""
    each = [F.struct(F.lit(s).alias("stage"), F.lower(F.trim(F.col(f"{s}_status"))).alias("status")) for s in stages]
    return df.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.stage", "x.status")


def matrix(df: DataFrame, stages=STAGES, most_rows: int | None = None, key: str = "photo_id") -> DataFrame:
    """Counts of states per stage, and queued plus pending. `most_rows` limits the scan, where a caller wants that."""
    rows = long_form(df.orderBy(key).limit(most_rows) if most_rows else df, key, stages)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in COUNTED]
    return rows.groupBy("stage").agg(*counts, F.count_if(F.col("status").isin("queued", "pending")).alias("pending_total"))


def throughput(events: DataFrame, now: Column, minutes: int, metrics: DataFrame) -> DataFrame:
    """Per metric in the last minutes: count, bytes, bytes and MB a second; listed metrics without events get zeros."""
    recent = events.where((F.col("ts") > now - F.make_interval(mins=F.lit(minutes))) & (F.col("ts") <= now))
    sums = recent.groupBy("metric").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    rate = F.coalesce("bytes", F.lit(0.0)) / (minutes * 60)
    return metrics.join(sums, "metric", "left").select(
        "metric", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0.0)).alias("bytes"), rate.alias("bytes_per_s"), F.round(rate / 1e6, 2).alias("mb_per_s")
    )


def stage_filter(df: DataFrame, process: str, state: str, stages=STAGES) -> DataFrame:
    """Photos with a state in one stage, or in any if process is `all`; `unqueued` is no state at all."""
    cols = {s: F.coalesce(F.nullif(F.lower(F.trim(f"{s}_status")), F.lit("")), F.lit("unqueued")) for s in stages}
    if process == "all":
        return df.where(F.exists(F.array(*cols.values()), lambda x: x == state))
    return df.where(cols[process] == state)


def needs_attention(df: DataFrame, stages=STAGES) -> DataFrame:
    return df.where(F.exists(F.array(*[F.col(f"{s}_status") for s in stages]), lambda x: x.isin("failed", "no_data")))


# Report reasons after which an AI stage may succeed another time.
RETRY_REASONS = (
    "inference_timeout", "model_budget_exceeded", "model_download_timeout", "model_load_failed", "model_unavailable",
    "raw_container_unsupported", "raw_preview_invalid", "raw_preview_missing", "upstream_incomplete",
)


def retry_ai(filename: Column, accepted: Column, fallback: Column, report: Column) -> Column:
    """Whether a RAW photo's AI stage is to be tried again: what a browser gave is only the local fallback's, or, where
    a browser gave nothing, the report (array of step, status, reason) tells of a failure that may pass."""
    raw = media.file_extension(filename).isin(*media.RAW, *media.CINEMA)
    failed = F.exists(report, lambda x: (x["step"] == "ai_vision") & x["status"].isin("failed", "skipped", "timeout") & x["reason"].isin(*RETRY_REASONS))
    return raw & F.when(F.coalesce(accepted, F.lit(False)), F.coalesce(fallback, F.lit(False))).otherwise(F.coalesce(failed, F.lit(False)))


def face_throttled(deferred: Column, report: Column) -> Column:
    """Whether the face stage was put off as the client was in the background."""
    item = F.exists(report, lambda x: (x["step"] == "face") & (F.lower(F.trim(x["reason"])) == "background_throttled"))
    return F.coalesce(F.lower(F.trim(deferred)) == "background_throttled", F.lit(False)) | F.coalesce(item, F.lit(False))


def pending(df: DataFrame, now: Column, stages=CLIENT_STAGES, key: str = "photo_id") -> DataFrame:
    """Photos with work left: not deleted, and a stage in a state that is not final. A running stage counts only
    once its lease has expired; an AI stage that is to be retried counts, and a throttled face stage that is not done.
    df: filename, <stage>_status, lease_expires, processing_state, updated, accepted_ai, fallback_ai, deferred, report."""
    expired = F.coalesce(F.col("lease_expires") <= now, F.lit(True))
    again = retry_ai(F.col("filename"), F.col("accepted_ai"), F.col("fallback_ai"), F.col("report"))
    throttled = face_throttled(F.col("deferred"), F.col("report"))
    work = []
    for s in stages:
        status = F.lower(F.trim(F.coalesce(f"{s}_status", F.lit(""))))
        status = F.when((status == "running") & ~expired, "held").when(status == "running", "pending").otherwise(status)
        if s == "ai_vision":
            status = F.when(again & status.isin("failed", "no_data", "skipped", "timeout"), "pending").otherwise(status)
        if s == "face":
            status = F.when(throttled & (status != "done"), "pending").otherwise(status)
        work.append(F.struct(F.lit(s).alias("stage"), status.alias("status")))
    open_ = F.filter(F.array(*work), lambda x: (x["status"] != "") & ~x["status"].isin("held", *TERMINAL))
    rows = df.where(F.coalesce(F.lower("processing_state"), F.lit("")) != "deleted").withColumn("open", open_).where(F.size("open") > 0)
    return rows.select(key, F.array_join(F.transform("open", lambda x: x["stage"]), ",").alias("stages"), "updated")


def clustering_due(df: DataFrame) -> DataFrame:
    """Photos, with `faces` as their number, whose face stage is done and found some: not deleted, and a count, or else
    a list, of faces that is not 0. df: processing_state, face_status, face_count, faces."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    count = F.coalesce(F.col("face_count").try_cast("long"), F.lit(0))
    n = F.when(count > 0, count).otherwise(F.greatest(F.size(F.filter("faces", lambda x: x.isNotNull())), F.lit(0)).cast("long"))
    return df.where((low("processing_state") != "deleted") & (low("face_status") == "done")).withColumn("faces", n).where("faces > 0")


def pending_queue(df: DataFrame, now: Column, limit: int, **how) -> DataFrame:
    """The photos that wait longest; the limit is held within 1 and 25."""
    return pending(df, now, **how).orderBy(F.col("updated").asc_nulls_first(), "photo_id").limit(min(25, max(1, limit)))


def stuck(df: DataFrame, now: Column, stage: str, seconds: int = STALE_SECONDS) -> DataFrame:
    return df.where((F.lower(f"{stage}_status") == "running") & (F.col("updated") < now - F.make_interval(secs=F.lit(seconds))))


def requeue(status: Column, stale: Column, force: bool) -> Column:
    """What asking for a stage again does: skipped if done or running (unless stale), else queued."""
    low = F.lower(F.coalesce(status, F.lit("")))
    if force:
        return F.lit("force_queued")
    return F.when(low == "done", "already_done").when((low == "running") & ~stale, "already_running").otherwise("queued")


# Report reasons that stand for no data.
NO_DATA_REASONS = ("upstream_incomplete", "raw_container_unsupported", "raw_preview_missing", "raw_exif_only")


def reported_status(step: Column, status: Column, reason: Column) -> Column:
    """A client's report as a state; null for what says nothing."""
    retry = (step == "ai_vision") & reason.isin(*RETRY_REASONS)
    return (
        F.when(status == "done", "done")
        .when(status.isin("failed", "timeout"), F.when(retry, "pending").otherwise("failed"))
        .when(status == "unsupported", "unsupported")
        .when(status == "skipped", F.when(((step == "face") & (reason == "background_throttled")) | retry, "pending").when(reason.isin(*NO_DATA_REASONS), "no_data").otherwise("skipped"))
    )


#: Items of a report that are read.
REPORT_ITEMS = 20


def merge_reports(current: DataFrame, reports: DataFrame, most: int = REPORT_ITEMS) -> DataFrame:
    """current (key, stage, status) after reports (key, pos, step, status, reason), pos from 0.

    Items are applied in order; a stage that is done or has no data stays so, whether before or by an item. A running
    client stage that a report with any usable item leaves out has no data.
    """
    used = reports.where((F.col("pos") < most) & F.trim("step").isin(*CLIENT_STAGES))
    used = used.select("key", F.trim("step").alias("stage"), "pos", reported_status(F.trim("step"), F.trim("status"), F.trim("reason")).alias("new")).where("new is not null")
    final = F.when(F.col("new").isin("done", "no_data"), F.col("pos"))
    last = used.groupBy("key", "stage").agg(F.coalesce(F.min_by("new", final), F.max_by("new", "pos")).alias("new"))
    seen = last.select("key").distinct().withColumn("seen", F.lit(True))
    rows = current.join(last, ["key", "stage"], "left").join(seen, "key", "left")
    low = F.lower(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    left_out = F.col("seen") & (low == "running") & F.col("stage").isin(*CLIENT_STAGES)
    out = F.when(low.isin("done", "no_data"), F.col("status")).when(F.col("new").isNotNull(), F.col("new")).when(left_out, "no_data").otherwise(F.col("status"))
    return rows.select("key", "stage", out.alias("status"))


# What a face failure's text tells, in the order tried; then stages that began and did not end.
FAILURE_WORDS = (
    ("background_throttled", ("background_throttled",)),
    ("unsupported_runtime", ("unsupported_runtime",)),
    ("timeout", ("blazeface_load_timeout", "model_budget_exceeded", "timeout")),
    ("embedding_model_load_failed", ("arcface_model_load_failed", "embedding_model_load_failed")),
    ("face_api_load_failed", ("face_model_load_failed", "face_api_load_failed")),
    ("model_load_failed", ("blazeface_load_failed", "module_import_failed")),
)
FAILURE_STAGES = (
    ("embedding_model_load_failed", "embedding_model_load"),
    ("descriptor_failed", "descriptor"),
    ("detection_failed", "detection"),
    ("model_load_failed", "model_load"),
)


def failure_stage(stated: Column, message: Column, marks: Column) -> Column:
    """Where a face run failed: as stated, else by words of its message, else by the stage of which `marks` has the
    start and not the end (x_started, x_done)."""
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.when(F.coalesce(stated, F.lit("")) != "", stated)
    for name, words in FAILURE_WORDS:
        out = out.when(reduce(or_, (low.contains(w) for w in words)), name)
    for name, stage in FAILURE_STAGES:
        out = out.when(F.array_contains(marks, f"{stage}_started") & ~F.array_contains(marks, f"{stage}_done"), name)
    return out.otherwise("unknown")
