"""Queries of the stream operators, over events (a user's events are one stream, the event type is the channel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status as S
from ..operators import corruption as C
from ..operators import temporal as T
from .registry import EV, ORACLES, events, query, table

HOUR, DAY = 3_600_000_000, 86_400_000_000
START, END = 1704067200000000, 1706572800000000  # 2024-01-01 and 2024-01-30, in microseconds
KEY, ORDER = ["user_id"], ["t", "event_id"]


@query(EV + """, c AS (SELECT * FROM ev WHERE event_type='click'), p AS (SELECT * FROM ev WHERE event_type='purchase')
SELECT c.event_id, p.event_id AS matched_id, c.t-p.t AS age_us, CASE WHEN p.event_id IS NULL THEN 'missing' WHEN c.t-p.t > 21600000000 THEN 'stale' ELSE 'current' END AS status
FROM c ASOF LEFT JOIN p ON c.user_id=p.user_id AND c.t>=p.t""")
def asof_latest_observation(spark, d):
    ev = events(spark, d)
    right = ev.where("event_type='purchase'").select("user_id", "t", F.col("event_id").alias("rid"))
    out = T.asof(ev.where("event_type='click'").select("event_id", "user_id", "t"), right, KEY, "t", "rid", ["rid"], 6 * HOUR)
    return out.select("event_id", F.col("asof_rid").alias("matched_id"), F.col("asof_age").alias("age_us"), F.col("asof_status").alias("status"))


@query(EV + """, s AS (SELECT user_id, event_type, max(t) FILTER (t <= 1705708800000000) AS lt, count(*) FILTER (t > 1705708800000000) AS fut FROM ev WHERE event_type IN ('view','click','purchase') GROUP BY ALL)
SELECT user_id, count(*) FILTER (lt IS NOT NULL AND 1705708800000000-lt <= 172800000000) AS n_current, count(*) FILTER (1705708800000000-lt > 172800000000) AS n_stale, sum(fut)::BIGINT AS future_rows,
CASE WHEN count(*) FILTER (lt IS NOT NULL AND 1705708800000000-lt <= 172800000000)=3 THEN 'current' ELSE 'not_current_or_incomplete' END AS overall FROM s GROUP BY user_id""")
def asof_multi_stream_resolve(spark, d):
    ev = events(spark, d).where(F.col("event_type").isin("view", "click", "purchase"))
    at = T.select_at(ev, ["user_id", "event_type"], "t", "event_id", F.lit(1705708800000000), ["event_id"], 2 * DAY)
    out = at.groupBy("user_id").agg(F.count_if(F.col("status") == "current").alias("n_current"), F.count_if(F.col("status") == "stale").alias("n_stale"), F.sum("future_rows").alias("future_rows"))
    return out.withColumn("overall", F.when(F.col("n_current") == 3, "current").otherwise("not_current_or_incomplete"))


@query(EV + """, s AS (SELECT event_id, t, last_value(CASE WHEN event_type='view' THEN value END IGNORE NULLS) OVER w AS view_value, last_value(CASE WHEN event_type='view' THEN t END IGNORE NULLS) OVER w AS vt,
 last_value(CASE WHEN event_type='click' THEN value END IGNORE NULLS) OVER w AS click_value, last_value(CASE WHEN event_type='click' THEN t END IGNORE NULLS) OVER w AS ct
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, view_value, t-vt AS view_age, click_value, t-ct AS click_age, CASE WHEN vt IS NULL OR ct IS NULL THEN 'incomplete' WHEN greatest(t-vt,t-ct) > 43200000000 THEN 'stale' ELSE 'current' END AS snapshot_status FROM s""")
def carry_forward_snapshot(spark, d):
    out = T.carry_forward(events(spark, d), KEY, ORDER, "t", "event_type", "value", ["view", "click"], 12 * HOUR)
    return out.select("event_id", "view_value", "view_age", "click_value", "click_age", "snapshot_status")


_ISSUES = """, b AS (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS bt FROM ev)"""


@query(EV + _ISSUES + " SELECT event_id, user_id, event_type, t-bt AS gap_us FROM b WHERE t-bt > 345600000000")
def channel_gaps(spark, d):
    out = T.order_issues(events(spark, d), ["user_id", "event_type"], ORDER, "t", max_gap=4 * DAY)
    return out.where("issue='gap'").select("event_id", "user_id", "event_type", (F.col("t") - F.col("before_time")).alias("gap_us"))


@query(EV + f""" SELECT user_id, event_type, min(t) AS first_time, max(t) AS last_time, count(*) AS n_rows, min(t) > {START + 2 * DAY} AS incomplete_start, max(t) < {END - 2 * DAY} AS incomplete_end FROM ev GROUP BY ALL""")
def channel_coverage(spark, d):
    return T.coverage(events(spark, d), ["user_id", "event_type"], "t", F.lit(START), F.lit(END), 2 * DAY)


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem) WHERE l_shipdate < b""")
def out_of_order_rows(spark, d):
    out = T.order_issues(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_shipdate")
    return out.where("issue='out_of_order'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, lag(l_shipdate) OVER w AS b, lag(l_partkey) OVER w AS p, lag(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber)) WHERE l_shipdate = b AND (l_partkey IS DISTINCT FROM p OR l_quantity IS DISTINCT FROM q)""")
def conflicting_duplicates(spark, d):
    out = T.order_issues(table(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber"], "l_shipdate", payload=["l_partkey", "l_quantity"])
    return out.where("issue='conflicting_duplicate'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def _completeness(ev):
    """Per user and channel: complete, incomplete (gap or coverage) or invalid (order)."""
    keys = ["user_id", "event_type"]
    issues = T.order_issues(ev, keys, ["event_id"], "t", max_gap=4 * DAY).groupBy(*keys).agg(F.bool_or(F.col("issue") == "out_of_order").alias("bad"), F.bool_or(F.col("issue") == "gap").alias("gap"))
    cover = T.coverage(ev, keys, "t", F.lit(START), F.lit(END), 4 * DAY)
    out = cover.join(issues, keys, "left")
    return out.withColumn("status", F.when(F.col("bad"), "invalid").when(F.col("gap") | F.col("incomplete_start") | F.col("incomplete_end"), "incomplete").otherwise("complete"))


_COMPLETE = f""", b AS (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS bt FROM ev),
ch AS (SELECT user_id, event_type, CASE WHEN bool_or(coalesce(t<bt,false)) THEN 'invalid' WHEN bool_or(coalesce(t-bt > {4 * DAY},false)) OR min(t) > {START + 4 * DAY} OR max(t) < {END - 4 * DAY} THEN 'incomplete' ELSE 'complete' END AS status FROM b GROUP BY ALL),
us AS (SELECT user_id, count(*) AS n_channels, CASE min(CASE status WHEN 'invalid' THEN 0 WHEN 'incomplete' THEN 1 ELSE 2 END) WHEN 0 THEN 'invalid' WHEN 1 THEN 'incomplete' ELSE 'complete' END AS completeness FROM ch GROUP BY ALL)"""


@query(EV + _COMPLETE + " SELECT * FROM us")
def completeness_status(spark, d):
    return _completeness(events(spark, d)).groupBy("user_id").agg(F.count("*").alias("n_channels"), S.fold_rows(F.col("status"), S.COMPLETENESS).alias("completeness"))


_ISLANDS = """, k AS (SELECT *, (value >= {level}) AS ok, row_number() OVER w - 1 AS i, sum(CASE WHEN value >= {level} THEN 0 ELSE 1 END) OVER w AS g FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
isl AS (SELECT user_id, g, min(t) AS start_time, max(t) AS end_time, max(t)-min(t) AS duration, count(*) AS n_rows, min(i) AS start_index FROM k WHERE ok GROUP BY user_id, g),
best AS (SELECT * FROM isl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY duration DESC, start_index DESC)=1)"""


@query(EV + _ISLANDS.format(level="100.0") + " SELECT user_id, start_time, end_time, duration, n_rows, start_index FROM best")
def longest_sustained_run(spark, d):
    out = T.longest_island(events(spark, d), KEY, ORDER, "t", F.col("value") >= 100.0)
    return out.select("user_id", "start_time", "end_time", "duration", "n_rows", F.col("start_index").cast("long").alias("start_index"))


@query(EV + """, z AS (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS v0 FROM ev), k AS (SELECT *, (value - v0 >= 20.0) AS ok, sum(CASE WHEN value - v0 >= 20.0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM z),
isl AS (SELECT user_id, g, max(t)-min(t) AS duration FROM k WHERE ok GROUP BY ALL), m AS (SELECT user_id, max(duration) AS duration FROM isl GROUP BY ALL)
SELECT u.user_id, coalesce(duration, 0) AS duration, coalesce(duration >= 86400000000, false) AS sustained FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN m USING (user_id)""")
def sustained_above_delta(spark, d):
    ev = events(spark, d)
    first = ev.groupBy("user_id").agg(F.min_by("value", F.struct(*ORDER)).alias("v0"))
    best = T.longest_island(ev.join(first, "user_id"), KEY, ORDER, "t", F.col("value") - F.col("v0") >= 20.0)
    out = first.join(best, "user_id", "left")
    return out.select("user_id", F.coalesce("duration", F.lit(0)).cast("long").alias("duration"), F.coalesce(F.col("duration") >= DAY, F.lit(False)).alias("sustained"))


@query(EV + """, k AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)-1 AS i FROM ev), n AS (SELECT user_id, count(*) AS n FROM k GROUP BY ALL),
x AS (SELECT a.user_id, a.i, min(b.i) AS stop FROM k a JOIN k b ON a.user_id=b.user_id AND b.i > a.i AND abs(b.value-a.value) > 60 GROUP BY ALL),
e AS (SELECT k.user_id, k.i, k.t, coalesce(x.stop, n.n)-1 AS last FROM k JOIN n USING (user_id) LEFT JOIN x ON x.user_id=k.user_id AND x.i=k.i),
f AS (SELECT e.user_id, e.i AS start_index, e.last-e.i+1 AS n_rows, k.t-e.t AS duration FROM e JOIN k ON k.user_id=e.user_id AND k.i=e.last)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY duration DESC, start_index DESC)=1""")
def anchored_longest_segment(spark, d):
    return T.anchored_segment(events(spark, d), KEY, ORDER, "t", "value", 60.0)


@query("""WITH li AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), s AS (SELECT a.l_orderkey AS k, a.l_linenumber AS i, a.l_quantity-b.l_quantity AS r FROM li a JOIN li b ON b.l_orderkey=a.l_orderkey+1 AND b.l_linenumber=a.l_linenumber),
g AS (SELECT *, sum(CASE WHEN abs(r) <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS g FROM s), isl AS (SELECT k, g, max(i)-min(i) AS len FROM g WHERE abs(r) <= 20 GROUP BY ALL)
SELECT k AS l_orderkey, max(len)::BIGINT AS longest FROM isl GROUP BY ALL""")
def follow_relative_value(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("i")).agg(F.min("l_quantity").alias("l_quantity"))
    other = li.select((F.col("l_orderkey") - 1).alias("l_orderkey"), "i", F.col("l_quantity").alias("q"))
    out = T.longest_island(li.join(other, ["l_orderkey", "i"]), ["l_orderkey"], ["i"], "i", F.abs(F.col("l_quantity") - F.col("q")) <= 20)
    return out.select("l_orderkey", F.col("duration").alias("longest"))


def _terminal(spark, d):
    return T.terminal(events(spark, d), KEY, ORDER, "t", ["value", "event_type"], F.lit(END), 2 * DAY)


_TERM = EV + f", l AS (SELECT user_id, arg_max(value, (t, event_id)) AS value, arg_max(event_type, (t, event_id)) AS event_type, max(t) AS t FROM ev GROUP BY ALL), s AS (SELECT *, {END}-t AS age, {END}-t > {2 * DAY} AS stale FROM l)"


def _tri(stale, ok):
    return F.when(stale, S.UNKNOWN).when(ok, S.SUPPORTED).otherwise(S.REFUTED)


@query(_TERM + " SELECT user_id, CASE WHEN stale THEN 'unknown' WHEN abs(value-100.0) <= 50.0 THEN 'supported' ELSE 'refuted' END AS status FROM s")
def terminal_in_tolerance(spark, d):
    return _terminal(spark, d).select("user_id", _tri(F.col("stale"), F.abs(F.col("value") - 100.0) <= 50.0).alias("status"))


@query(_TERM + " SELECT user_id, age, CASE WHEN stale THEN 'unknown' WHEN value BETWEEN 20 AND 200 THEN 'supported' ELSE 'refuted' END AS status FROM s")
def terminal_in_bounds(spark, d):
    return _terminal(spark, d).select("user_id", "age", _tri(F.col("stale"), F.col("value").between(20, 200)).alias("status"))


@query(EV + f""", w AS (SELECT user_id, t, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS bt FROM ev), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC)=1)
SELECT user_id, CASE WHEN {END}-t > {2 * DAY} OR b IS NULL THEN 'unknown' WHEN abs(value-b)/(t-bt) < 0.00000002 THEN 'supported' ELSE 'refuted' END AS status FROM l""")
def terminal_rate_below(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(*ORDER)
    ev = events(spark, d).withColumn("b", F.lag("value").over(w)).withColumn("bt", F.lag("t").over(w))
    out = T.terminal(ev, KEY, ORDER, "t", ["value", "b", "bt"], F.lit(END), 2 * DAY)
    rate = F.abs(F.col("value") - F.col("b")) / (F.col("t") - F.col("bt"))
    return out.select("user_id", _tri(F.col("stale") | F.col("b").isNull(), rate < 2e-8).alias("status"))


@query("""SELECT conv_id, count(*) AS n_rows, count(*) FILTER (turn IS DISTINCT FROM r) AS n_breaks, count(*) FILTER (turn IS DISTINCT FROM r)=0 AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS r FROM conversations) GROUP BY ALL""")
def sequence_contiguity(spark, d):
    return T.sequence_issues(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "turn")


@query(EV + """, b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM ev) SELECT event_id, before, event_type FROM b WHERE event_type IS DISTINCT FROM before""")
def change_edges(spark, d):
    return T.changes(events(spark, d), KEY, ORDER, "event_type").select("event_id", "before", "event_type")


_FOLD = EV + _COMPLETE + _TERM.replace(EV, "") + """, st AS (SELECT us.user_id, CASE us.completeness WHEN 'invalid' THEN 'conflicting' WHEN 'incomplete' THEN 'unknown' ELSE 'supported' END AS c,
CASE WHEN stale THEN 'unknown' WHEN abs(value-100.0) <= 50.0 THEN 'supported' ELSE 'refuted' END AS a, CASE WHEN value BETWEEN 20 AND 200 THEN 'supported' ELSE 'refuted' END AS b FROM us JOIN s USING (user_id))"""


def _statuses(spark, d):
    """Per user three statuses: a and b of its last value, c of its stream's completeness."""
    ev = events(spark, d)
    c = _completeness(ev).groupBy("user_id").agg(S.fold_rows(F.col("status"), S.COMPLETENESS).alias("k"))
    t = _terminal(spark, d)
    out = c.join(t, "user_id")
    return out.select("user_id", F.when(F.col("k") == "invalid", S.CONFLICTING).when(F.col("k") == "incomplete", S.UNKNOWN).otherwise(S.SUPPORTED).alias("c"), _tri(F.col("stale"), F.abs(F.col("value") - 100.0) <= 50.0).alias("a"), _tri(F.lit(False), F.col("value").between(20, 200)).alias("b"))


def _fold_sql(order):
    rank = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order)) + " END"
    back = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(order))
    return f" SELECT user_id, CASE least({rank('a')}, {rank('b')}, {rank('c')}) {back} END AS status FROM st"


def _register_fold(name, order):
    def f(spark, d):
        return _statuses(spark, d).select("user_id", S.fold([F.col(x) for x in "abc"], order).alias("status"))

    f.__name__ = name
    query(_FOLD + _fold_sql(order))(f)


for _n, _o in (("status_fold_all", S.ALL), ("status_fold_any", S.ANY), ("status_fold_grasp", S.GRASP), ("status_fold_report", S.LAYER)):
    _register_fold(_n, _o)


@query(_FOLD + """ SELECT user_id, CASE WHEN 'conflicting' IN (a,b,c) THEN 'conflicting' WHEN a='refuted' OR b='supported' OR c='refuted' THEN 'refuted' WHEN 'unknown' IN (a,b,c) THEN 'unknown' ELSE 'supported' END AS status FROM st""")
def status_fold_release(spark, d):
    return _statuses(spark, d).select("user_id", S.release(F.col("a"), F.col("b"), F.col("c")).alias("status"))


GOAL = {"any": [{"all": [{"predicate": "a"}, {"predicate": "c"}]}, {"all": [{"predicate": "b"}, {"not": {"predicate": "a"}}]}]}


@query(_FOLD + """, r AS (SELECT user_id, a, b, c, CASE a WHEN 'supported' THEN 'refuted' WHEN 'refuted' THEN 'supported' ELSE a END AS na FROM st),
x AS (SELECT *, CASE WHEN 'refuted' IN (a,c) THEN 'refuted' WHEN 'conflicting' IN (a,c) THEN 'conflicting' WHEN 'unknown' IN (a,c) THEN 'unknown' ELSE 'supported' END AS p, CASE WHEN 'refuted' IN (b,na) THEN 'refuted' WHEN 'conflicting' IN (b,na) THEN 'conflicting' WHEN 'unknown' IN (b,na) THEN 'unknown' ELSE 'supported' END AS q FROM r),
y AS (SELECT *, CASE WHEN 'supported' IN (p,q) THEN 'supported' WHEN 'conflicting' IN (p,q) THEN 'conflicting' WHEN 'unknown' IN (p,q) THEN 'unknown' ELSE 'refuted' END AS goal FROM x)
SELECT user_id, goal, CASE WHEN c='refuted' THEN 'refuted' ELSE goal END AS verdict FROM y""")
def goal_expression(spark, d):
    s = _statuses(spark, d)
    goal = S.expression(GOAL, {x: F.col(x) for x in "abc"})
    return s.select("user_id", goal.alias("goal"), F.col("c")).select("user_id", "goal", S.verdict(F.col("goal"), S.negate(F.col("c"))).alias("verdict"))


# Negative controls: what the checks say of spoilt streams.

_CHECK = """ SELECT user_id, count(*) FILTER (t < bt) AS out_of_order, count(*) FILTER (t = bt AND value IS DISTINCT FROM bv) AS conflicting, count(*) FILTER (t-bt > 172800000000) AS gaps, count(*) AS n_rows FROM {x} GROUP BY ALL"""


def _checked(ev, order):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(*order)
    x = ev.withColumn("bt", F.lag("t").over(w)).withColumn("bv", F.lag("value").over(w))
    return x.groupBy("user_id").agg(F.count_if(F.expr("t < bt")).alias("out_of_order"), F.count_if(F.expr("t = bt and value is distinct from bv")).alias("conflicting"), F.count_if(F.col("t") - F.col("bt") > 2 * DAY).alias("gaps"), F.count("*").alias("n_rows"))


_IDX = EV + ", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)-1 AS i FROM ev)"
_LAGS = ", x AS (SELECT *, lag(t) OVER w AS bt, lag(value) OVER w AS bv FROM {src} WINDOW w AS (PARTITION BY user_id ORDER BY {order}))"


@query(_IDX + ", y AS (SELECT * FROM k WHERE i<>3)" + _LAGS.format(src="y", order="t, event_id") + _CHECK.format(x="x"))
def corruption_dropped_frame(spark, d):
    return _checked(C.dropped_frame(events(spark, d), KEY, ORDER, 3), ORDER)


@query(_IDX + ", y AS (SELECT event_id, user_id, t, value FROM k UNION ALL SELECT event_id, user_id, t, value+0.001 FROM k WHERE i=2)" + _LAGS.format(src="y", order="t, event_id, value") + _CHECK.format(x="x"))
def corruption_conflicting_duplicate(spark, d):
    return _checked(C.conflicting_duplicate(events(spark, d), KEY, ORDER, 2, "value"), ["t", "event_id", "value"])


@query(EV + " SELECT user_id, count(DISTINCT event_type) AS n_channels FROM ev WHERE event_type<>'click' GROUP BY ALL")
def corruption_missing_channel(spark, d):
    return C.missing_channel(events(spark, d), "event_type", "click").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_channels"))


@query(_IDX + ", y AS (SELECT event_id, user_id, value, CASE WHEN i=0 THEN coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY i), t) WHEN i=1 THEN lag(t) OVER (PARTITION BY user_id ORDER BY i) ELSE t END AS t FROM k)" + _LAGS.format(src="y", order="event_id") + _CHECK.format(x="x"))
def corruption_out_of_order(spark, d):
    return _checked(C.out_of_order(events(spark, d), KEY, ["t", "event_id"], "t"), ["event_id"])


@query(EV + " SELECT CASE WHEN user_id=7 THEN -7 ELSE user_id END AS user_id, count(*) AS n FROM ev GROUP BY 1")
def corruption_wrong_id(spark, d):
    return C.wrong_id(events(spark, d), "user_id", F.lit(7), F.lit(-7).cast("long")).groupBy("user_id").agg(F.count("*").alias("n"))


@query(EV + f" SELECT user_id, max(t) AS last_time, {END}-max(t) > {2 * DAY} AS stale FROM ev WHERE t < {END - 3 * DAY} GROUP BY ALL")
def corruption_stale_tail(spark, d):
    out = T.terminal(C.stale_tail(events(spark, d), "t", F.lit(END), F.lit(3 * DAY)), KEY, ORDER, "t", [], F.lit(END), 2 * DAY)
    return out.select("user_id", F.col("t").alias("last_time"), "stale")


@query(EV + " SELECT user_id, 'tampered' AS last_type FROM ev GROUP BY ALL")
def corruption_terminal_tamper(spark, d):
    ev = C.terminal_tamper(events(spark, d), KEY, ORDER, "event_type", "tampered")
    return ev.groupBy("user_id").agg(F.max_by("event_type", F.struct(*ORDER)).alias("last_type"))


@query("SELECT doc_id, 'tampered' AS state FROM documents")
def corruption_digest_tamper(spark, d):
    from ..sources.traces import verify

    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return verify(C.digest_tamper(docs, "digest"), docs, ["doc_id"])


# Window functions and groupings that the engine offers beside them.


@query(EV + """ SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id)::BIGINT AS quartile, floor(percent_rank() OVER w * 1000000 + 0.5)::BIGINT AS pr FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY value)""")
def window_ranks(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("value")
    return events(spark, d).select("event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(W.partitionBy("user_id").orderBy("value", "event_id")).cast("long").alias("quartile"), F.floor(F.percent_rank().over(w) * 1000000 + 0.5).alias("pr"))


@query(EV + " SELECT event_type, t // 86400000000 AS day, count(*) AS n, max(value) AS top FROM ev GROUP BY ALL")
def tumbling_windows(spark, d):
    ev = table(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp_ntz"), "1 day").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return ev.select("event_type", F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("day"), "n", "top")


@query(EV + """, b AS (SELECT *, CASE WHEN t-lag(t) OVER w < 21600000000 THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS g FROM b) SELECT user_id, min(t) AS start_time, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, d):
    ev = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp_ntz"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return ev.select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("start_time"), "n")


@query(EV + """ SELECT event_id, count(*) OVER w AS n_near, max(value) OVER w AS top FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY value RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def sliding_range_frame(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("value").rangeBetween(-5, 5)
    return events(spark, d).select("event_id", F.count("*").over(w).alias("n_near"), F.max("value").over(w).alias("top"))
