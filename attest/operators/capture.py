"""Captured streams into evidence: joint records, transform streams, action records, bundles, and run results as evidence.

Every check gives rows of issues; nothing is repaired. Tables may hold any number of captures (key columns first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Codes of a goal's status reports; 0 is unknown and only counted.
STATUS_CODES = {1: "accepted", 2: "executing", 3: "canceling", 4: "succeeded", 5: "canceled", 6: "aborted"}
#: Kinds of records of an action capture, and those that come at most once.
RECORD_KINDS = ("send_goal_request", "goal_response", "status_array", "feedback", "get_result_request", "result_response")
ONCE = ("goal_response", "get_result_request", "result_response")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joint_components(records: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """records (..., names, positions) to a row per component with `joint`, the model's name (null: not mapped)."""
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    rows = records.select("*", F.explode(F.arrays_zip("names", "positions")).alias("_c"))
    return rows.select(*[c for c in records.columns if c not in ("names", "positions")], F.col("_c.names").alias("name"), names[F.col("_c.names")].alias("joint"), F.col("_c.positions").alias("position"))


def joint_issues(records: DataFrame, keys: Sequence[str], mapping: dict[str, str], tolerance: float) -> DataFrame:
    """keys, issue, subject, n: joints with several authorities, positions that differ at one time, and names without a joint."""
    c = joint_components(records, mapping)
    known = c.where("joint is not null")
    several = known.groupBy(*keys, F.col("joint").alias("subject")).agg(F.countDistinct("authority").alias("n")).where("n > 1")
    spread = known.groupBy(*keys, "joint", "time").agg((F.max("position") - F.min("position")).alias("_d")).where(F.col("_d") > tolerance)
    differ = spread.groupBy(*keys, F.col("joint").alias("subject")).agg(F.count("*").alias("n"))
    unmapped = c.where("joint is null").groupBy(*keys, F.col("name").alias("subject")).agg(F.count("*").alias("n"))
    kinds = (("multiple_authorities", several), ("conflicting_positions", differ), ("unmapped_name", unmapped))
    return _union([df.select(*keys, F.lit(k).alias("issue"), "subject", "n") for k, df in kinds])


def joint_snapshots(records: DataFrame, keys: Sequence[str], mapping: dict[str, str], max_age: int) -> DataFrame:
    """keys, record_id, time, status (incomplete, stale, complete), ages and positions of all joints at every record.

    Records go in (time, receipt, record_id) order; each carries the latest value of every joint forward. The last
    complete record of a time is its snapshot (`kept`).
    """
    w = W.partitionBy(*keys).orderBy("time", "receipt", "record_id")
    joints = sorted(set(mapping.values()))
    found = F.map_from_entries(F.filter(F.transform(F.arrays_zip("names", "positions"), lambda x: F.struct(F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])[x.names].alias("k"), x.positions.alias("v"))), lambda e: e.k.isNotNull()))
    rows = records.withColumn("_f", found)
    for j in joints:
        seen = F.when(F.col("_f")[j].isNotNull(), F.struct(F.col("_f")[j].alias("p"), F.col("time").alias("t")))
        rows = rows.withColumn(f"_{j}", F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    there = F.lit(True)
    for j in joints:
        there = there & F.col(f"_{j}").isNotNull()
    ages = F.array(*[F.col("time") - F.col(f"_{j}.t") for j in joints])
    status = F.when(~there, "incomplete").when(F.array_max(ages) > max_age, "stale").otherwise("complete")
    out = rows.select(*keys, "record_id", "time", "receipt", status.alias("status"), F.map_from_arrays(F.array(*[F.lit(j) for j in joints]), ages).alias("ages"), F.map_from_arrays(F.array(*[F.lit(j) for j in joints]), F.array(*[F.col(f"_{j}.p") for j in joints])).alias("positions"))
    good = F.when(F.col("status") == "complete", F.struct("receipt", "record_id"))
    last = F.max(good).over(W.partitionBy(*keys, "time"))
    return out.withColumn("kept", (F.col("status") == "complete") & (F.struct("receipt", "record_id") == last)).drop("receipt")


def transform_issues(edges: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """keys, issue, child of transform streams (parent, child, time, static, authority, matrix): what makes a child's place ambiguous."""
    own = [*keys, "child"]
    sums = edges.groupBy(*own).agg(F.countDistinct("parent").alias("parents"), F.countDistinct("authority").alias("authorities"), F.bool_or("static").alias("static"), F.bool_or(~F.col("static")).alias("dynamic"))
    # static edges of a child are one place in time
    at = edges.withColumn("_t", F.when(~F.col("static"), F.col("time")))
    first = F.first("matrix").over(W.partitionBy(*own, "static", "_t").orderBy("record_id"))
    off = F.array_max(F.zip_with("matrix", "_m", lambda a, b: F.abs(a - b))) > tolerance
    differ = at.withColumn("_m", first).where(off).select(*own).distinct().withColumn("issue", F.lit("conflicting_duplicate"))
    tests = (("parent_switch", "parents > 1"), ("multiple_authorities", "authorities > 1"), ("static_and_dynamic", "static and dynamic"))
    return _union([sums.where(t).select(*own, F.lit(k).alias("issue")) for k, t in tests] + [differ]).select(*keys, "issue", "child")


def action_issues(records: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture_id, issue, n) of action captures.

    records: capture_id, record_id, sequence, kind, time, accepted (of goal responses), goal_uuid (of those that name one).
    captures: capture_id, started, ended, decision, evaluation, goal_uuid.
    """
    w = W.partitionBy("capture_id").orderBy("sequence", "record_id")
    r = records.join(captures.withColumnRenamed("goal_uuid", "_goal"), "capture_id").withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("time").over(w))
    request = F.min(F.when(F.col("kind") == "send_goal_request", F.col("time"))).over(W.partitionBy("capture_id"))
    repeats = F.count("*").over(W.partitionBy("capture_id", "record_id"))
    r = r.withColumn("_request", request).withColumn("_same", repeats)
    bound = F.col("kind").isin("feedback", "result_response")
    own = F.col("goal_uuid") == F.col("_goal")
    after = F.col("kind").isin("goal_response", "get_result_request") | bound | ((F.col("kind") == "status_array") & own)
    rows = {
        "duplicate_record": F.col("_same") > 1,
        "sequence_break": ~F.col("sequence").eqNullSafe(F.col("_n")),
        "unknown_kind": ~F.col("kind").isin(*RECORD_KINDS),
        "outside_interval": ~F.col("time").between(F.col("started"), F.col("ended")),
        "time_decreases": F.col("time") < F.col("_before"),
        "after_evaluation": F.col("time") > F.col("evaluation"),
        "other_goal": bound & ~F.coalesce(own, F.lit(False)),
        "before_request": after & (F.col("time") < F.col("_request")),
        "request_before_decision": (F.col("kind") == "send_goal_request") & (F.col("time") < F.col("decision")),
    }
    n = lambda kind, ok=None: F.count_if((F.col("kind") == kind) & (ok if ok is not None else F.lit(True)))
    sums = r.groupBy("capture_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rows.items()], n("send_goal_request").alias("_requests"), n("result_response").alias("_results"), n("get_result_request").alias("_asked"), n("goal_response", F.col("accepted")).alias("_accepted"), *[n(k).alias(f"_{k}") for k in ONCE])
    whole = {
        "request_count": F.abs(F.col("_requests") - 1),
        **{f"several_{k}": F.greatest(F.col(f"_{k}") - 1, F.lit(0)) for k in ONCE},
        "result_without_request": F.when((F.col("_results") > 0) & (F.col("_asked") == 0), 1).otherwise(0),
        "result_request_without_acceptance": F.when((F.col("_asked") > 0) & (F.col("_accepted") == 0), 1).otherwise(0),
    }
    pairs = F.create_map(*[x for k in rows for x in (F.lit(k), F.col(k))], *[x for k, c in whole.items() for x in (F.lit(k), c.cast("long"))])
    return sums.select("capture_id", F.explode(pairs).alias("issue", "n")).where("n > 0")


def lifecycle_records(reports: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status reports (capture_id, record_id, time, publisher, goal_uuid, code) to a goal's life cycle, and what was set aside.

    goals: capture_id, goal_uuid. Reports of other goals and of code 0 are counted only; a (time, code) counts once, by its
    least record. Second: per capture the counts, times with several codes, and publishers.
    """
    own = reports.join(goals.withColumnRenamed("goal_uuid", "_goal"), "capture_id").withColumn("_own", F.col("goal_uuid") == F.col("_goal"))
    used = own.where("_own and code <> 0")
    values = F.create_map(*[F.lit(x) for pair in STATUS_CODES.items() for x in pair])
    life = used.groupBy("capture_id", "time", "code").agg(F.min("record_id").alias("record_id")).withColumn("value", F.coalesce(values[F.col("code")], F.lit("unknown")))
    clashes = life.groupBy("capture_id", "time").agg(F.count("*").alias("k")).where("k > 1").groupBy("capture_id").agg(F.count("*").alias("conflicting_times"))
    sums = own.groupBy("capture_id").agg(
        F.count_if(~F.col("_own")).alias("other_goal"), F.count_if(F.col("_own") & (F.col("code") == 0)).alias("unknown_status"),
        F.count_if(F.col("_own") & (F.col("code") != 0)).alias("_used"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("publisher").isNull()).alias("without_publisher"),
    )
    audit = sums.join(life.groupBy("capture_id").agg(F.count("*").alias("records")), "capture_id", "left").join(clashes, "capture_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    audit = audit.select("capture_id", zero("records"), "other_goal", "unknown_status", (F.col("_used") - F.coalesce("records", F.lit(0))).alias("duplicates"), zero("conflicting_times"), "publishers", ((F.col("publishers") == 1) & (F.col("without_publisher") == 0)).alias("one_publisher"))
    return life, audit


def bundle_issues(bundles: DataFrame, sources: DataFrame, records: DataFrame) -> DataFrame:
    """(bundle_id, issue, n) of evidence bundles.

    bundles: bundle_id, model_id, expected_model_id, clock, requested, decision, evaluation, action_id.
    sources: bundle_id, source_id, clock, declared_digest, digest, path, root. records: bundle_id, source_id, record_id, time, binding, lifecycle.
    """
    b = bundles.select("bundle_id", F.create_map(
        F.lit("model_mismatch"), (~F.col("model_id").eqNullSafe(F.col("expected_model_id"))).cast("long"),
        F.lit("time_order"), F.coalesce(~((F.col("requested") <= F.col("decision")) & (F.col("decision") <= F.col("evaluation"))), F.lit(True)).cast("long"),
    ).alias("m"))
    s = sources.join(bundles.select("bundle_id", F.col("clock").alias("_clock")), "bundle_id").groupBy("bundle_id").agg(
        F.count_if(~F.col("clock").eqNullSafe(F.col("_clock"))).alias("a"), F.count_if(~F.col("declared_digest").eqNullSafe(F.col("digest"))).alias("d"), F.count_if(~F.startswith(F.col("path"), F.concat(F.col("root"), F.lit("/"))) | F.contains(F.col("path"), F.lit(".."))).alias("p"), (F.count("*") - F.countDistinct("source_id")).alias("u"),
    ).select("bundle_id", F.create_map(F.lit("other_clock"), "a", F.lit("source_tampered"), "d", F.lit("path_outside"), "p", F.lit("source_repeated"), "u").alias("m"))
    r = records.join(bundles.select("bundle_id", "action_id"), "bundle_id").groupBy("bundle_id").agg(
        (F.count("*") - F.countDistinct("record_id")).alias("u"), F.count_if(F.col("lifecycle") & ~F.col("binding").eqNullSafe(F.col("action_id"))).alias("o"),
    ).select("bundle_id", F.create_map(F.lit("record_repeated"), "u", F.lit("other_action"), "o").alias("m"))
    return _union([b, s, r]).select("bundle_id", F.explode("m").alias("issue", "n")).where("n > 0")


def run_evidence(results: DataFrame, mapping: DataFrame, runs: DataFrame) -> DataFrame:
    """Predicate results as condition evidence: run_id, condition, truth, observed_at (ns), reason.

    results: run_id, predicate_id, status, evidence_time_s. mapping: predicate_id, condition, wanted (the truth that a
    supported status gives). runs: run_id, evaluation_ns. Unknown and conflicting statuses stay unknown; times are rounded
    half to even and never later than the evaluation.
    """
    j = results.join(F.broadcast(mapping), "predicate_id").join(runs, "run_id")
    at = F.least(F.bround(F.col("evidence_time_s") * 1e9).cast("long"), F.col("evaluation_ns"))
    truth = F.when(F.col("status") == "supported", F.col("wanted")).when(F.col("status") == "refuted", ~F.col("wanted"))
    return j.select("run_id", "condition", F.when(truth, "true").when(~truth, "false").otherwise("unknown").alias("truth"), at.alias("observed_at"), F.when(truth.isNull(), F.col("status")).otherwise("observed").alias("reason"))


def nested_times(raw: Column) -> Column:
    """All numbers under a key time_s, at any depth of JSON text."""
    return F.transform(F.regexp_extract_all(raw, F.lit(r'"time_s"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)'), 1), lambda x: x.cast("double"))


def observation_issues(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, issue, n of observation logs (record_id, stream, time, position in the log): ids that repeat, several records of a stream at one
    time, records out of order, and times that are missing or negative."""
    w = W.partitionBy(*keys, "stream").orderBy("position")
    r = records.withColumn("_before", F.lag("time").over(w)).withColumn("_ids", F.count("*").over(W.partitionBy(*keys, "record_id"))).withColumn("_times", F.count("*").over(W.partitionBy(*keys, "stream", "time")))
    tests = {"repeated_id": F.col("_ids") > 1, "repeated_time": F.col("_times") > 1, "out_of_order": F.col("time") < F.col("_before"), "bad_time": F.col("time").isNull() | (F.col("time") < 0)}
    sums = r.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in tests.items()])
    return sums.select(*keys, F.explode(F.create_map(*[x for k in tests for x in (F.lit(k), F.col(k))])).alias("issue", "n")).where("n > 0")
