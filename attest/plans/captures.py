"""Queries of the capture operators: a user's events read as joint records, transforms, action records and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture as C
from .registry import EV, events, query

HOUR = 3_600_000_000
MAPPING = {"view": "j1", "click": "j2", "signup": "j3"}
_NAMES = "CASE WHEN event_id%4=0 THEN [event_type, 'signup'] ELSE [event_type] END"
_JOINT = EV + f", r AS (SELECT user_id AS run, event_id AS record_id, t//{HOUR} AS time, t+event_id%1000 AS receipt, 'a'||CASE WHEN event_type='view' AND user_id%3=0 THEN event_id%2 ELSE 0 END AS authority, event_type, value, event_id%4=0 AND event_type<>'signup' AS two FROM ev)"


def _records(spark, d):
    both = (F.col("event_id") % 4 == 0) & (F.col("event_type") != "signup")
    return events(spark, d).select(
        F.col("user_id").alias("run"), F.col("event_id").alias("record_id"), F.floor(F.col("t") / HOUR).alias("time"), (F.col("t") + F.col("event_id") % 1000).alias("receipt"),
        F.concat(F.lit("a"), F.when((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0), F.col("event_id") % 2).otherwise(0)).alias("authority"),
        F.when(both, F.array("event_type", F.lit("signup"))).otherwise(F.array("event_type")).alias("names"), F.when(both, F.array("value", F.col("value") + 1)).otherwise(F.array("value")).alias("positions"),
    )


_SNAP = _JOINT + """, v AS (SELECT *, CASE WHEN event_type='view' THEN value END AS p1, CASE WHEN event_type='click' THEN value END AS p2, CASE WHEN event_type='signup' THEN value WHEN two THEN value+1 END AS p3 FROM r),
s AS (SELECT run, record_id, time, receipt, last_value(p1 IGNORE NULLS) OVER w AS p1, last_value(p2 IGNORE NULLS) OVER w AS p2, last_value(p3 IGNORE NULLS) OVER w AS p3, last_value(CASE WHEN p1 IS NOT NULL THEN time END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN p2 IS NOT NULL THEN time END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN p3 IS NOT NULL THEN time END IGNORE NULLS) OVER w AS t3 FROM v WINDOW w AS (PARTITION BY run ORDER BY time, receipt, record_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CASE WHEN p1 IS NULL OR p2 IS NULL OR p3 IS NULL THEN 'incomplete' WHEN greatest(time-t1, time-t2, time-t3) > 48 THEN 'stale' ELSE 'complete' END AS status FROM s)"""


@query(_SNAP + " SELECT record_id, time, status, time-t1 AS age1, p1, p2, p3, status='complete' AND row_number() OVER (PARTITION BY run, time, status ORDER BY receipt DESC, record_id DESC)=1 AS kept FROM q")
def joint_snapshots(spark, d):
    out = C.joint_snapshots(_records(spark, d), ["run"], MAPPING, 48)
    return out.select("record_id", "time", "status", F.col("ages")["j1"].alias("age1"), *[F.col("positions")[f"j{i}"].alias(f"p{i}") for i in (1, 2, 3)], "kept")


@query(_JOINT + """, c AS (SELECT run, time, authority, event_type AS name, value AS p FROM r UNION ALL SELECT run, time, authority, 'signup', value+1 FROM r WHERE two),
m AS (SELECT *, CASE name WHEN 'view' THEN 'j1' WHEN 'click' THEN 'j2' WHEN 'signup' THEN 'j3' END AS joint FROM c)
SELECT run, 'multiple_authorities' AS issue, joint AS subject, count(DISTINCT authority) AS n FROM m WHERE joint IS NOT NULL GROUP BY ALL HAVING count(DISTINCT authority) > 1
UNION ALL SELECT run, 'conflicting_positions', joint, count(*) FROM (SELECT run, joint, time FROM m WHERE joint IS NOT NULL GROUP BY ALL HAVING max(p)-min(p) > 0.5) GROUP BY ALL
UNION ALL SELECT run, 'unmapped_name', name, count(*) FROM m WHERE joint IS NULL GROUP BY ALL""")
def joint_issues(spark, d):
    return C.joint_issues(_records(spark, d), ["run"], MAPPING, 0.5)


@query(EV + """, e AS (SELECT user_id AS run, event_id, t//86400000000 AS time, event_type AS child, CASE WHEN event_id%17=0 THEN 'world' ELSE 'base' END AS parent, user_id%5=0 AND event_id%3=0 AS static, 'a'||CASE WHEN user_id%4=0 THEN event_id%2 ELSE 0 END AS authority, floor(value/100) AS x FROM ev),
g AS (SELECT run, child, count(DISTINCT parent) AS p, count(DISTINCT authority) AS a, bool_or(static) AS s, bool_or(NOT static) AS y FROM e GROUP BY ALL),
f AS (SELECT *, first_value(x) OVER (PARTITION BY run, child, static, CASE WHEN NOT static THEN time END ORDER BY event_id) AS x0 FROM e)
SELECT run, 'parent_switch' AS issue, child FROM g WHERE p > 1 UNION ALL SELECT run, 'multiple_authorities', child FROM g WHERE a > 1 UNION ALL SELECT run, 'static_and_dynamic', child FROM g WHERE s AND y UNION ALL SELECT DISTINCT run, 'conflicting_duplicate', child FROM f WHERE abs(x-x0) > 0.5""")
def transform_issues(spark, d):
    e = events(spark, d).select(
        F.col("user_id").alias("run"), F.col("event_id").alias("record_id"), F.floor(F.col("t") / 86_400_000_000).alias("time"), F.col("event_type").alias("child"), F.when(F.col("event_id") % 17 == 0, "world").otherwise("base").alias("parent"),
        ((F.col("user_id") % 5 == 0) & (F.col("event_id") % 3 == 0)).alias("static"), F.concat(F.lit("a"), F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 2).otherwise(0)).alias("authority"), F.array(F.floor(F.col("value") / 100).cast("double"), F.lit(0.0)).alias("matrix"),
    )
    return C.transform_issues(e, ["run"], 0.5)


_KIND = "CASE WHEN n=1 THEN 'send_goal_request' WHEN n=2 THEN 'goal_response' WHEN n%13=0 THEN 'get_result_request' WHEN n%17=0 THEN 'result_response' WHEN n%5=0 THEN 'feedback' WHEN n%37=0 THEN 'other' ELSE 'status_array' END"
_ACTION = EV + f""", x AS (SELECT user_id AS capture_id, event_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, t FROM ev), r AS (SELECT capture_id, record_id, CASE WHEN n%41=0 THEN n+1 ELSE n END AS sequence, {_KIND} AS kind, t AS time, capture_id%4>0 AS accepted, CASE WHEN n%7=0 THEN 'g0' ELSE 'g1' END AS goal FROM x),
c AS (SELECT capture_id, 1704153600000000 AS started, 1706486400000000 AS ended, 1704412800000000 AS decision, 1706400000000000 AS evaluation FROM r GROUP BY ALL),
w AS (SELECT r.*, c.* EXCLUDE (capture_id), row_number() OVER v AS i, lag(time) OVER v AS bt, min(time) FILTER (kind='send_goal_request') OVER (PARTITION BY r.capture_id) AS rt FROM r JOIN c ON c.capture_id=r.capture_id WINDOW v AS (PARTITION BY r.capture_id ORDER BY sequence, record_id))"""


@query(_ACTION + """, s AS (SELECT capture_id, count(*) FILTER (sequence <> i) AS sequence_break, count(*) FILTER (kind='other') AS unknown_kind, count(*) FILTER (time NOT BETWEEN started AND ended) AS outside_interval, count(*) FILTER (time < bt) AS time_decreases, count(*) FILTER (time > evaluation) AS after_evaluation, count(*) FILTER (kind IN ('feedback','result_response') AND goal<>'g1') AS other_goal,
count(*) FILTER (time < rt AND (kind IN ('goal_response','get_result_request','feedback','result_response') OR kind='status_array' AND goal='g1')) AS before_request, count(*) FILTER (kind='send_goal_request' AND time < decision) AS request_before_decision,
greatest(count(*) FILTER (kind='get_result_request')-1,0) AS several_get_result_request, greatest(count(*) FILTER (kind='result_response')-1,0) AS several_result_response, (count(*) FILTER (kind='result_response') > 0 AND count(*) FILTER (kind='get_result_request')=0)::BIGINT AS result_without_request,
(count(*) FILTER (kind='get_result_request') > 0 AND count(*) FILTER (kind='goal_response' AND accepted)=0)::BIGINT AS result_request_without_acceptance FROM w GROUP BY ALL)
SELECT capture_id, issue, n FROM (UNPIVOT s ON COLUMNS(* EXCLUDE (capture_id)) INTO NAME issue VALUE n) WHERE n > 0""")
def action_capture_issues(spark, d):
    from pyspark.sql import Window as W

    x = events(spark, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    r = x.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("record_id"), F.when(F.col("n") % 41 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("sequence"), F.expr(_KIND).alias("kind"), F.col("t").alias("time"), (F.col("user_id") % 4 > 0).alias("accepted"), F.when(F.col("n") % 7 == 0, "g0").otherwise("g1").alias("goal_uuid"))
    c = r.select("capture_id").distinct().select("capture_id", *[F.lit(v).alias(k) for k, v in (("started", 1704153600000000), ("ended", 1706486400000000), ("decision", 1704412800000000), ("evaluation", 1706400000000000), ("goal_uuid", "g1"))])
    return C.action_issues(r, c)


_STATUS = EV + ", r AS (SELECT user_id AS capture_id, event_id AS record_id, t//86400000000 AS time, CASE WHEN user_id%2=0 AND event_id%9=0 THEN NULL ELSE 'p'||(user_id%3 * (event_id%2)) END AS publisher, event_id%6=0 AS other, (event_id//2)%7 AS code FROM ev), u AS (SELECT capture_id, time, code, min(record_id) AS record_id FROM r WHERE NOT other AND code<>0 GROUP BY ALL)"


def _reports(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("record_id"), F.floor(F.col("t") / 86_400_000_000).alias("time"), F.when(~((F.col("user_id") % 2 == 0) & (F.col("event_id") % 9 == 0)), F.concat(F.lit("p"), F.col("user_id") % 3 * (F.col("event_id") % 2))).alias("publisher"), F.when(F.col("event_id") % 6 == 0, "g0").otherwise("g1").alias("goal_uuid"), (F.floor(F.col("event_id") / 2) % 7).cast("int").alias("code"))
    return C.lifecycle_records(r, r.select("capture_id").distinct().withColumn("goal_uuid", F.lit("g1")))


@query(_STATUS + " SELECT capture_id, time, code::INT AS code, record_id, CASE code WHEN 1 THEN 'accepted' WHEN 2 THEN 'executing' WHEN 3 THEN 'canceling' WHEN 4 THEN 'succeeded' WHEN 5 THEN 'canceled' ELSE 'aborted' END AS value FROM u")
def status_deduplication(spark, d):
    return _reports(spark, d)[0]


@query(_STATUS + """, a AS (SELECT capture_id, count(*) FILTER (other) AS other_goal, count(*) FILTER (NOT other AND code=0) AS unknown_status, count(*) FILTER (NOT other AND code<>0) AS used, count(DISTINCT publisher) AS publishers, count(*) FILTER (publisher IS NULL) AS w FROM r GROUP BY ALL)
SELECT a.capture_id, coalesce(k.n,0) AS records, other_goal, unknown_status, used-coalesce(k.n,0) AS duplicates, coalesce(k.c,0) AS conflicting_times, publishers, publishers=1 AND w=0 AS one_publisher FROM a LEFT JOIN (SELECT capture_id, sum(n)::BIGINT AS n, count(*) FILTER (n > 1) AS c FROM (SELECT capture_id, time, count(*) AS n FROM u GROUP BY ALL) GROUP BY ALL) k USING (capture_id)""")
def status_audit(spark, d):
    return _reports(spark, d)[1]


_BUNDLE = EV + """, b AS (SELECT user_id AS bundle_id, user_id%11=0 AS bad_model, min(t) AS requested, max(t)-CASE WHEN user_id%7=0 THEN 2592000000000 ELSE 0 END AS decision, max(t) AS evaluation FROM ev GROUP BY user_id),
s AS (SELECT user_id AS bundle_id, event_type AS source_id, min(event_id) AS e FROM ev GROUP BY ALL)"""


@query(_BUNDLE + """, m AS (SELECT bundle_id, 'model_mismatch' AS issue, bad_model::BIGINT AS n FROM b UNION ALL SELECT bundle_id, 'time_order', (requested > decision)::BIGINT FROM b UNION ALL SELECT bundle_id, 'other_clock', count(*) FILTER (e%10=0) FROM s GROUP BY ALL UNION ALL SELECT bundle_id, 'source_tampered', count(*) FILTER (e%8=0) FROM s GROUP BY ALL UNION ALL SELECT bundle_id, 'path_outside', count(*) FILTER (e%9=0) FROM s GROUP BY ALL
UNION ALL SELECT user_id, 'record_repeated', count(*)-count(DISTINCT event_id//2) FROM ev GROUP BY ALL UNION ALL SELECT user_id, 'other_action', count(*) FILTER (event_type='click' AND event_id%15=0) FROM ev GROUP BY ALL) SELECT * FROM m WHERE n > 0""")
def bundle_validation(spark, d):
    ev = events(spark, d)
    b = ev.groupBy(F.col("user_id").alias("bundle_id")).agg(F.min("t").alias("requested"), F.max("t").alias("evaluation"))
    b = b.select("bundle_id", F.when(F.col("bundle_id") % 11 == 0, "m2").otherwise("m1").alias("model_id"), F.lit("m1").alias("expected_model_id"), F.lit("wall").alias("clock"), "requested", (F.col("evaluation") - F.when(F.col("bundle_id") % 7 == 0, 2592000000000).otherwise(0)).alias("decision"), "evaluation", F.lit("act").alias("action_id"))
    s = ev.groupBy(F.col("user_id").alias("bundle_id"), F.col("event_type").alias("source_id")).agg(F.min("event_id").alias("e"))
    s = s.select("bundle_id", "source_id", F.when(F.col("e") % 10 == 0, "sim").otherwise("wall").alias("clock"), F.lit("d").alias("declared_digest"), F.when(F.col("e") % 8 == 0, "x").otherwise("d").alias("digest"), F.when(F.col("e") % 9 == 0, "/b/../c").otherwise("/b/c").alias("path"), F.lit("/b").alias("root"))
    r = ev.select(F.col("user_id").alias("bundle_id"), F.col("event_type").alias("source_id"), F.floor(F.col("event_id") / 2).alias("record_id"), F.col("t").alias("time"), F.when(F.col("event_id") % 15 == 0, "old").otherwise("act").alias("binding"), (F.col("event_type") == "click").alias("lifecycle"))
    return C.bundle_issues(b, s, r)


@query(EV + """, p AS (SELECT user_id AS run_id, event_type AS predicate_id, arg_max(value, (t, event_id)) AS v, max(t)/1e6 AS s FROM ev WHERE event_type IN ('view','click','purchase') GROUP BY ALL)
SELECT run_id, CASE predicate_id WHEN 'view' THEN 'seen' WHEN 'click' THEN 'untouched' ELSE 'bought' END AS condition, CASE WHEN v BETWEEN 30 AND 60 THEN 'unknown' WHEN (v > 60) = (predicate_id<>'click') THEN 'true' ELSE 'false' END AS truth, least(round_even(s*1e9, 0)::BIGINT, 1706400000000000000) AS observed_at, CASE WHEN v BETWEEN 30 AND 45 THEN 'conflicting' WHEN v BETWEEN 30 AND 60 THEN 'unknown' ELSE 'observed' END AS reason FROM p""")
def run_evidence(spark, d):
    p = events(spark, d).where(F.col("event_type").isin("view", "click", "purchase")).groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("predicate_id")).agg(F.max_by("value", F.struct("t", "event_id")).alias("v"), (F.max("t") / 1e6).alias("evidence_time_s"))
    status = F.when(F.col("v") > 60, "supported").when(F.col("v") < 30, "refuted").when(F.col("v") <= 45, "conflicting").otherwise("unknown")
    mapping = spark.createDataFrame([("view", "seen", True), ("click", "untouched", False), ("purchase", "bought", True)], "predicate_id string, condition string, wanted boolean")
    return C.run_evidence(p.withColumn("status", status), mapping, p.select("run_id", F.lit(1706400000000000000).alias("evaluation_ns")).distinct())


@query(EV + " SELECT event_id, (t/1e6)::DOUBLE AS last_time, 2::BIGINT AS n FROM ev")
def nested_times(spark, d):
    raw = F.to_json(F.struct(F.struct((F.col("t") / 1e6).alias("time_s"), F.array(F.struct(F.lit(1.5).alias("time_s"), F.lit(2.5).alias("other"))).alias("inner")).alias("a")))
    out = events(spark, d).withColumn("x", C.nested_times(raw))
    return out.select("event_id", F.array_max("x").alias("last_time"), F.size("x").cast("long").alias("n"))
