"""Timed evidence: freshness, truth at a reference time, action life cycles, outcomes, counterfactuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where a goal's state may go next. Rows are (before, after); a state may also repeat.
ALLOWED_NEXT = (
    ("accepted", "executing"),
    ("accepted", "canceling"),
    ("executing", "canceling"),
    ("executing", "succeeded"),
    ("executing", "aborted"),
    ("canceling", "canceled"),
    ("canceling", "aborted"),
)
TERMINAL = ("succeeded", "aborted", "canceled")
#: Why nothing is eligible, the first present counts.
REASONS = ("wrong_type", "binding_mismatch", "expired", "stale", "future", "missing")


def freshness(observed: Column, valid_until: Column, at: Column, max_age: Column) -> Column:
    """future, expired (valid_until before the reference time), stale or eligible: the first that applies."""
    return F.when(observed > at, "future").when(valid_until < at, "expired").when(at - observed > max_age, "stale").otherwise("eligible")


def truth(conditions: DataFrame, evidence: DataFrame, bindings_match: Column, type_match: Column, at: Column, max_age: Column) -> DataFrame:
    """conditions (condition_id, subject, predicate, ...) with the truth that evidence (subject, predicate, value, observed_at, valid_until, record_id ...) gives.

    Of the eligible records those with the latest time count: one value is the truth, several are a conflict (unknown).
    Without any, the reason is the strongest of REASONS.
    """
    joined = conditions.join(evidence, ["subject", "predicate"], "left")
    state = F.when(F.col("record_id").isNull(), "missing").when(~type_match, "wrong_type").when(~bindings_match, "binding_mismatch").otherwise(freshness(F.col("observed_at"), F.col("valid_until"), at, max_age))
    judged = joined.withColumn("_state", state)
    eligible = F.col("_state") == "eligible"
    latest = F.max(F.when(eligible, F.col("observed_at"))).over(W.partitionBy("condition_id"))
    judged = judged.withColumn("_latest", latest)
    top = eligible & (F.col("observed_at") == F.col("_latest"))
    why = F.min(sum((F.when(F.col("_state") == r, i).otherwise(0) for i, r in enumerate(REASONS)), F.lit(0)) + F.when(eligible, len(REASONS)).otherwise(0))
    out = judged.groupBy("condition_id").agg(
        F.collect_set(F.when(top, F.col("value"))).alias("_values"), F.max("_latest").alias("evidence_time"), F.count_if(top).alias("n_latest"), F.count_if(F.col("_state") == "future").alias("n_future"), why.alias("_why")
    )
    n = F.size("_values")
    return out.select(
        "condition_id",
        F.when(n == 1, F.when(F.element_at("_values", 1), "true").otherwise("false")).otherwise("unknown").alias("truth"),
        F.when(n == 1, "observed").when(n > 1, "conflicting_values").otherwise(F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.least(F.col("_why"), F.lit(len(REASONS) - 1)).cast("int") + 1)).alias("reason"),
        "evidence_time",
        "n_latest",
        "n_future",
    )


def transitions(rows: DataFrame, keys: Sequence[str], time: str, tie: str, state: str, allowed: Sequence[tuple[str, str]] = ALLOWED_NEXT) -> DataFrame:
    """Each state change in (time, tie) order, with whether it is allowed; repeats of a state are no change."""
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(time, tie))
    pairs = rows.sparkSession.createDataFrame(list(allowed), "before string, after string")
    out = rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(state))).withColumnRenamed(state, "after")
    return out.join(F.broadcast(pairs.withColumn("allowed", F.lit(True))), ["before", "after"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def lifecycle(rows: DataFrame, keys: Sequence[str], time: str, tie: str, state: str, allowed: Sequence[tuple[str, str]] = ALLOWED_NEXT, terminal: Sequence[str] = TERMINAL, running: Sequence[str] = ("executing", *TERMINAL)) -> DataFrame:
    """Per key: last state, bad transitions, rows after a terminal state, first running time, and status. Any issue overrides all."""
    bad = transitions(rows, keys, time, tie, state, allowed).groupBy(*keys).agg(F.count_if(~F.col("allowed")).alias("bad_transitions"))
    ends = F.min(F.when(F.col(state).isin(*terminal), F.struct(time, tie))).over(W.partitionBy(*keys))
    marked = rows.withColumn("_end", ends)
    out = marked.groupBy(*keys).agg(
        F.max_by(state, F.struct(time, tie)).alias("last_state"),
        F.min(F.when(F.col(state).isin(*running), F.col(time))).alias("running_from"),
        F.count_if(F.struct(time, tie) > F.col("_end")).alias("rows_after_end"),
        F.count("*").alias("n_rows"),
    )
    out = out.join(bad, list(keys), "left").withColumn("bad_transitions", F.coalesce("bad_transitions", F.lit(0)).cast("long"))
    issue = (F.col("bad_transitions") > 0) | (F.col("rows_after_end") > 0)
    return out.withColumn("status", F.when(issue, "inconsistent").when(F.col("last_state").isin(*terminal), F.concat(F.lit("result_"), F.col("last_state"))).otherwise("in_progress"))


def readiness(truths: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    """Conditions (truth) folded per key: ready if all are as wanted, not_ready if one is contrary, else unknown."""
    out = truths.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(wanted).alias("n_met"), F.count_if(F.col("truth") == "unknown").alias("n_unknown"))
    return out.withColumn("readiness", F.when(F.col("n_met") == F.col("n"), "ready").when(F.col("n_met") + F.col("n_unknown") < F.col("n"), "not_ready").otherwise("unknown"))


def outcome(lifecycle_status: Column, n_effects: Column, n_true: Column, n_before_start: Column) -> Column:
    """What may be said of an action: no declared effects count as all observed; an effect seen before the start proves nothing."""
    return (
        F.when(lifecycle_status == "inconsistent", "inconsistent_lifecycle")
        .when((lifecycle_status == "result_succeeded") & (n_true - n_before_start == n_effects), "success_and_all_effects_observed_after_start")
        .when((lifecycle_status == "result_succeeded") & (n_true == n_effects), "success_and_effects_observed_some_before_start")
        .when(lifecycle_status == "result_succeeded", "success_reported_effects_not_all_observed")
        .when(lifecycle_status.startswith("result_"), "not_successful")
        .otherwise("not_finished")
    )


def fingerprint(streams: dict[str, DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Digest of the first row of every channel, per key: equal fingerprints began in equal states."""
    out = None
    for name, df in sorted(streams.items()):
        first = df.groupBy(*keys).agg(F.sha2(F.to_json(F.min_by(F.struct(*sorted(set(df.columns) - set(keys))), F.struct(*order))), 256).alias(name))
        out = first if out is None else out.join(first, list(keys), "full")
    return out.select(*keys, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(n), F.lit("-")) for n in sorted(streams)]), 256).alias("fingerprint"))


def counterfactual(runs: DataFrame, match: Sequence[str], run: str, intervention: str, status: str, base: str) -> DataFrame:
    """Pairs of runs that agree on `match` but not on the intervention, one of which has intervention `base`: what the other's intervention contributed."""
    a = runs.where(F.col(intervention) == base).select(*match, F.col(run).alias("base_run"), F.col(status).alias("base_status"))
    b = runs.where(F.col(intervention) != base).select(*match, F.col(run).alias("other_run"), F.col(intervention).alias("intervention"), F.col(status).alias("other_status"))
    kind = (
        F.when((F.col("other_status") == "supported") & (F.col("base_status") == "refuted"), "contributed")
        .when((F.col("other_status") == "refuted") & (F.col("base_status") == "supported"), "prevented")
        .when(F.col("other_status").isin("supported", "refuted") & (F.col("other_status") == F.col("base_status")), "no_difference")
        .otherwise("unknown")
    )
    return a.join(b, list(match)).withColumn("contribution", kind)
