"""Costs and times of processing, in batch. The streaming twins are in streaming.streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import MODEL_PRICES
from ..functions.exprs import round_half_up as half_up

P = "project_id"


def model_price() -> Column:
    """The price entry of a model: provider prefix off, then by name, else by the first name that the model starts with."""
    key = F.when(F.col("model").contains(":"), F.substring_index("model", ":", -1)).otherwise(F.col("model"))
    entry = lambda r: F.struct(F.lit(r[1]).alias("input"), F.lit(r[2]).alias("output"), F.lit(r[3]).alias("thinking"))
    out = None
    for r in MODEL_PRICES:
        out = F.when(key == r[0], entry(r)) if out is None else out.when(key == r[0], entry(r))
    for r in MODEL_PRICES:
        out = out.when(key.startswith(r[0]), entry(r))
    return out


def ai_cost(runs: DataFrame) -> DataFrame:
    """runs with cost_usd; null for models without a price."""
    zero = F.lit(0)
    p = F.col("__price")
    cost = F.coalesce("in_tokens", zero) * p["input"] / 1e6 + F.coalesce("out_tokens", zero) * p["output"] / 1e6 + F.coalesce("think_tokens", zero) * p["thinking"] / 1e6
    return runs.withColumn("__price", model_price()).withColumn("cost_usd", half_up(cost, 9)).drop("__price")


def ai_cost_rollup(runs: DataFrame) -> DataFrame:
    """(scope, key, calls, cost_usd, tokens, duration_ms, failures) by project, model and prompt."""
    own = ai_cost(runs)
    out = own.groupingSets([[P], ["model"], ["prompt_version"]], P, "model", "prompt_version").agg(
        F.count(F.lit(1)).alias("calls"),
        half_up(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.sum(F.col("in_tokens") + F.col("out_tokens") + F.coalesce("think_tokens", F.lit(0))).alias("tokens"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.grouping_id().alias("g"),
    )
    scope = F.when(F.col("g") == 3, "project").when(F.col("g") == 5, "model").otherwise("prompt")
    key = F.coalesce(F.col(P).cast("string"), "model", "prompt_version")
    return out.select(scope.alias("scope"), key.alias("key"), "calls", "cost_usd", "tokens", "duration_ms", "failures")


#: What a project's model calls cost its score. Retries a call above the share cost so much; the others cost so much each, to a limit.
RETRY_PENALTIES = ((0.5, 25), (0.2, 10))
RATE_LIMIT_PENALTY, JSON_RETRY_PENALTY, PAGE_PENALTY = (5, 20), (5, 15), (10, 20)
FAILURE_PENALTY = (60, 30)
SCORE_LEVELS = ((80, "high"), (50, "medium"))


def reliability_score(runs: DataFrame, failed_pages: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """(project_id, score, level): 100 less penalties for retries a call, rate limits hit, the share of failed calls, retries for broken JSON, and pages that could not be read.
    runs: one row a call with its status, and maybe the number of its retries; failed_pages: one row each; projects without calls, where given, score 100."""
    status = F.col("status")
    retries = F.sum("retries") if "retries" in runs.columns else F.count_if(status == "retried")
    sums = runs.groupBy(P).agg(
        F.count(F.lit(1)).alias("calls"), retries.alias("retries"), *(F.count_if(status == x).alias(x) for x in ("rate_limited", "failed", "json_retry"))
    )
    if failed_pages is not None:
        sums = sums.join(failed_pages.groupBy(P).agg(F.count(F.lit(1)).alias("pages")), P, "left")
    else:
        sums = sums.withColumn("pages", F.lit(0))
    each = lambda c, penalty: F.least(F.coalesce(c, F.lit(0)) * penalty[0], F.lit(penalty[1]))
    rate = F.col("retries") / F.col("calls")
    often = F.lit(0)
    for share, penalty in reversed(RETRY_PENALTIES):
        often = F.when(rate > share, penalty).otherwise(often)
    share, most = FAILURE_PENALTY
    failed = F.least(F.floor(F.col("failed") / F.col("calls") * share + 0.5), F.lit(most))
    lost = often + each(F.col("rate_limited"), RATE_LIMIT_PENALTY) + failed + each(F.col("json_retry"), JSON_RETRY_PENALTY) + each(F.col("pages"), PAGE_PENALTY)
    own = sums.select(P, F.greatest(F.lit(0), F.lit(100) - lost).cast("long").alias("score"))
    if projects is not None:
        own = projects.select(P).distinct().join(own, P, "left").select(P, F.coalesce("score", F.lit(100)).cast("long").alias("score"))
    level = F.lit("low")
    for least, name in reversed(SCORE_LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return own.withColumn("level", level)


def fold_calls(events: DataFrame) -> DataFrame:
    """(project_id, call_id, status, started_at, ended_at, events): calls from start and end events in any order; an end outranks a start, and the first end counts."""
    own = events.filter("kind = 'ai_call'")
    end = F.col("phase").isin("completed", "failed")
    return own.groupBy(P, "call_id").agg(
        F.coalesce(F.min_by(F.when(end, F.col("phase")), F.when(end, F.struct("created_at", "id"))), F.lit("started")).alias("status"),
        F.min(F.when(F.col("phase") == "started", F.col("created_at"))).alias("started_at"),
        F.min(F.when(end, F.col("created_at"))).alias("ended_at"),
        F.count(F.lit(1)).alias("events"),
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """(project_id, stage, status, started_at, completed_at, failed_at, duration_ms, place): the last start, completion and failure of each stage; it took from its start to
    its completion, else its failure, and null where either is missing. status is that of what it ended with, else `started`; place goes by start, else end."""
    from pyspark.sql import Window

    own = events.filter("kind = 'stage' AND stage IS NOT NULL")
    last = lambda phase: F.max_by(F.when(F.col("phase") == phase, F.col("created_at")), F.when(F.col("phase") == phase, F.struct("created_at", "id")))
    sums = own.groupBy(P, "stage").agg(last("started").alias("started_at"), last("completed").alias("completed_at"), last("failed").alias("failed_at"))
    ended = F.coalesce("completed_at", "failed_at")
    place = F.row_number().over(Window.partitionBy(P).orderBy(F.coalesce("started_at", "completed_at", "failed_at"), "stage"))
    status = F.when(F.col("completed_at").isNotNull(), "completed").when(F.col("failed_at").isNotNull(), "failed").when(F.col("started_at").isNotNull(), "started")
    return sums.select(P, "stage", status.alias("status"), "started_at", "completed_at", "failed_at", (F.unix_millis(ended) - F.unix_millis("started_at")).alias("duration_ms"), place.cast("long").alias("place"))


def totals(events: DataFrame) -> DataFrame:
    """Per project: events, tokens, first and last time."""
    return events.groupBy(P).agg(F.count(F.lit(1)).alias("events"), F.sum("in_tokens").alias("tokens"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
