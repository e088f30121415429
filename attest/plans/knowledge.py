"""Queries of the tree, fact, diff, evidence and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import status as S
from ..operators import diffs as D
from ..operators import evidence as E
from ..operators import facts as K
from ..operators import graphs as G
from ..operators import score as C
from ..sources.shared import Scratch
from .registry import EV, events, micro, query, table

# The tree world -> region -> nation -> customer, supplier.

_TREE = """WITH RECURSIVE e AS (SELECT 'world' AS child, NULL AS parent UNION ALL SELECT 'r/'||r_regionkey, 'world' FROM region UNION ALL SELECT 'n/'||n_nationkey, 'r/'||n_regionkey FROM nation UNION ALL SELECT 'c/'||c_custkey, 'n/'||c_nationkey FROM customer UNION ALL SELECT 's/'||s_suppkey, 'n/'||s_nationkey FROM supplier),
w AS (SELECT child AS node, 0 AS depth, 'world' AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.child, w.depth+1, w.path||'>'||e.child FROM w JOIN e ON e.parent=w.node)"""


def _tree(spark, d):
    t = lambda n: table(spark, d, n)
    edge = lambda df, p, k, q, o: df.select(F.concat(F.lit(p), F.col(k)).alias("child"), (F.concat(F.lit(q), F.col(o)) if o else F.lit(q)).alias("parent"))
    root = spark.sql("SELECT 'world' AS child, CAST(NULL AS STRING) AS parent")
    return root.unionByName(edge(t("region"), "r/", "r_regionkey", "world", None)).unionByName(edge(t("nation"), "n/", "n_nationkey", "r/", "n_regionkey")).unionByName(edge(t("customer"), "c/", "c_custkey", "n/", "c_nationkey")).unionByName(edge(t("supplier"), "s/", "s_suppkey", "n/", "s_nationkey"))


@query(_TREE + " SELECT node, depth::BIGINT AS depth, path FROM w")
def tree_root_paths(spark, d):
    return G.root_paths(_tree(spark, d)).select("node", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


@query(_TREE + " SELECT r AS ancestor, count(*) AS n FROM (SELECT split_part(path,'>',2) AS r FROM w WHERE depth >= 1) GROUP BY ALL")
def tree_descendants(spark, d):
    e = _tree(spark, d)
    return G.descendants(e, e.where("parent='world'").select(F.col("child").alias("node"))).groupBy("ancestor").agg(F.count("*").alias("n"))


@query(_TREE + """, a AS (SELECT string_split(path,'>') AS p FROM w WHERE node='c/1'), b AS (SELECT string_split(path,'>') AS q FROM w WHERE node='s/3'), k AS (SELECT p, q, (SELECT count(*) FROM range(1,5) t(i) WHERE p[i]=q[i]) AS k FROM a, b) SELECT array_to_string(list_reverse(p[k+1:]),'>') AS up, p[k] AS common, array_to_string(q[k+1:],'>') AS down FROM k""")
def tree_path(spark, d):
    out = G.path_between(G.root_paths(_tree(spark, d)), "c/1", "s/3")
    return out.select(F.array_join("up", ">").alias("up"), "common", F.array_join("down", ">").alias("down"))


@query(_TREE + """, k AS (SELECT e.child AS node, count(x.child) AS n_children FROM e LEFT JOIN e x ON x.parent=e.child GROUP BY ALL) SELECT left(node,1) AS kind, count(*) FILTER (n_children=0) AS leaves, count(*) FILTER (n_children>1) AS branches, max(n_children) AS most FROM k GROUP BY ALL""")
def tree_leaves_branches(spark, d):
    return G.degrees(_tree(spark, d)).groupBy(F.left("node", F.lit(1)).alias("kind")).agg(F.count_if("is_leaf").alias("leaves"), F.count_if("is_branch").alias("branches"), F.max("n_children").alias("most"))


@query(_TREE + " SELECT (SELECT count(*) FROM e) AS n_nodes, 1::BIGINT AS n_roots, 0::BIGINT AS n_several_parents, 0::BIGINT AS n_unreached")
def tree_validation(spark, d):
    return G.tree_issues(_tree(spark, d))


@query(_TREE + """, f AS (SELECT child, parent, CASE WHEN left(child,1) IN ('r','c') THEN 0.5 ELSE 2.0 END::DOUBLE AS m, length(child)::DOUBLE AS o FROM e), a AS (SELECT child AS node, child AS driver, 1.0::DOUBLE AS multiplier, 0.0::DOUBLE AS "offset" FROM f WHERE parent IS NULL UNION ALL SELECT f.child, a.driver, f.m*a.multiplier, f.m*a."offset"+f.o FROM a JOIN f ON f.parent=a.node) SELECT * FROM a""")
def affine_chain(spark, d):
    e = _tree(spark, d).withColumn("multiplier", F.when(F.left("child", F.lit(1)).isin("r", "c"), 0.5).otherwise(2.0)).withColumn("offset", F.length("child").cast("double"))
    return G.affine_chain(e)


@query("""WITH RECURSIVE e AS (SELECT l_partkey AS node, -1-l_suppkey AS premise FROM lineitem UNION SELECT -1-l_suppkey, l_partkey FROM lineitem), w AS (SELECT max(l_partkey) AS node FROM lineitem UNION SELECT e.premise FROM w JOIN e USING (node)) SELECT node::BIGINT AS node FROM w WHERE node IS NOT NULL""")
def proof_closure(spark, d):
    """What the last part rests on, over every row of lineitem: a part on its suppliers (negative keys), a supplier on the parts it ships."""
    scratch = Scratch(spark)
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), (-1 - F.col("l_suppkey")).alias("premise"))
    both = li.unionByName(li.select(F.col("premise").alias("node"), F.col("node").alias("premise"))).distinct()
    return G.closure(scratch.put(both), li.agg(F.max("node").alias("node")).where("node is not null"), scratch.put)


@query()
def connected_components(spark, d):
    """The components of the whole part/order graph: every row of lineitem is an edge. SQL is too slow on it; a test holds it against union-find."""
    return G.connected_components(table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_orderkey")).alias("b")))


@query("""WITH RECURSIVE n AS (SELECT c_nationkey AS a, -1-s_nationkey AS b FROM customer JOIN supplier ON c_nationkey=s_nationkey OR c_nationkey=s_nationkey+5 GROUP BY ALL), s AS (SELECT a, b FROM n UNION SELECT b, a FROM n), w AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, w.c FROM w JOIN s ON s.a=w.node) SELECT node::BIGINT AS node, min(c)::BIGINT AS component FROM w GROUP BY ALL""")
def nation_components(spark, d):
    """Nations of customers and of suppliers (negative keys), joined where they are equal or five apart."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("a")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("s")).distinct()
    near = s.select((-1 - F.col("s")).alias("b"), F.explode(F.array("s", F.col("s") + 5)).alias("a"))
    return G.connected_components(c.join(near, "a").select("a", "b"))


@query("""WITH v AS (SELECT 'robot/'||n_nationkey AS robot, n_nationkey*0.1::DOUBLE AS v FROM nation), p AS (SELECT robot, 'base' AS link, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS z FROM v UNION ALL SELECT robot, 'a', 1, 0, 0 FROM v UNION ALL SELECT robot, 'b', 1+(1+v)*cos(v), (1+v)*sin(v), 0 FROM v UNION ALL SELECT robot, 'tip', 1+(1+v)*cos(v), (1+v)*sin(v), 0.2 FROM v)
SELECT robot, link, floor(x*1e6+0.5)/1e6 AS x, floor(y*1e6+0.5)/1e6 AS y, floor(z*1e6+0.5)/1e6 AS z FROM p""")
def fk_chain(spark, d):
    """World places of a serial arm per nation: three joints whose values follow the nation's key."""
    n = table(spark, d, "nation").select(F.concat(F.lit("robot/"), F.col("n_nationkey")).alias("robot"), (F.col("n_nationkey") * 0.1).alias("v"))
    parts = [("base", "a", "revolute", [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]), ("a", "b", "prismatic", [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ("b", "tip", "fixed", [0.0, 0.0, 0.2], [0.0, 0.0, 1.0])]
    j = spark.createDataFrame([(p, c, t, x, [0.0, 0.0, 0.0], a) for p, c, t, x, a in parts], "parent string, child string, type string, xyz array<double>, rpy array<double>, axis array<double>")
    joints = n.crossJoin(F.broadcast(j)).select("robot", "parent", "child", "type", "xyz", "rpy", "axis", F.col("v").alias("value"))  # three joints each
    out = G.forward_kinematics(joints, n.select("robot", F.lit("base").alias("link")))
    return out.select("robot", "link", *[micro(F.col("world")[4 * i + 3]).alias("xyz"[i]) for i in range(3)])


# Facts.

_FACTS = """WITH f AS (SELECT 'customer/'||c_custkey AS subject, unnest(['c_name','c_nationkey','c_mktsegment']) AS predicate, unnest([c_name, c_nationkey::VARCHAR, c_mktsegment]) AS object FROM customer UNION ALL SELECT 'supplier/'||s_suppkey, unnest(['s_name','s_nationkey']), unnest([s_name, s_nationkey::VARCHAR]) FROM supplier),
i AS (SELECT *, sha256(length(subject)||':'||subject||'|'||length(predicate)||':'||predicate||'|'||length(object)||':'||object) AS fact_id FROM f)"""


def _facts(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return K.facts_of(c, F.concat(F.lit("customer/"), F.col("c_custkey")), ["c_name", "c_nationkey", "c_mktsegment"]).unionByName(K.facts_of(s, F.concat(F.lit("supplier/"), F.col("s_suppkey")), ["s_name", "s_nationkey"]))


@query(_FACTS + " SELECT * FROM i")
def fact_table_build(spark, d):
    return _facts(spark, d)


@query(_FACTS + " SELECT fact_id, subject, predicate, object FROM i WHERE predicate='c_mktsegment' ORDER BY fact_id LIMIT 25")
def fact_retrieve(spark, d):
    return K.retrieve(_facts(spark, d), 25, predicate="c_mktsegment")[0].select("fact_id", "subject", "predicate", "object")


@query(_FACTS + " SELECT count(*) AS n_indexed, count(*) FILTER (predicate='c_name') AS n_matched, count(*) > 2 AS truncated FROM i WHERE subject='customer/7'")
def fact_retrieve_counts(spark, d):
    return K.retrieve(_facts(spark, d), 2, entity="customer/7", predicate="c_name")[1]


@query(_FACTS + " SELECT object, array_to_string(list_sort(list(DISTINCT subject)), ',') AS subjects FROM i WHERE predicate IN ('c_nationkey','s_nationkey') GROUP BY ALL")
def inverted_index(spark, d):
    out = K.inverted_index(_facts(spark, d).where(F.col("predicate").isin("c_nationkey", "s_nationkey")), "object", "subject")
    return out.select("object", F.array_join("items", ",").alias("subjects"))


@query("""SELECT c.c_custkey, c.c_name, n.n_name AS nation, r.r_name AS region, count(o.o_orderkey) AS n_orders, coalesce(max(epoch_us(o.o_orderdate)), 0) AS last_order FROM customer c JOIN nation n ON n_nationkey=c_nationkey JOIN region r ON r_regionkey=n_regionkey LEFT JOIN orders o ON o_custkey=c_custkey GROUP BY ALL""")
def entity_cards(spark, d):
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(day).alias("m"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "c_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("m", F.lit(0)).cast("long").alias("last_order"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey) THEN 'yes' WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'no' ELSE 'unknown' END AS answer FROM customer""")
def closed_world_negative(spark, d):
    closed = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    out = K.closed_world(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), closed, ["c_custkey"], "c_mktsegment")
    return out.select("c_custkey", "answer")


# Differences. The later version of orders drops some, changes some and adds some.

_LATER = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey%11=0 THEN o_totalprice+1 ELSE o_totalprice END AS o_totalprice FROM a WHERE o_orderkey%13<>0 UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM a WHERE o_orderkey%17=0)"""


def _versions(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = a.where("o_orderkey%13<>0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return a, b.unionByName(a.where("o_orderkey%17=0").withColumn("o_orderkey", -F.col("o_orderkey")))


@query(_LATER + """, j AS (SELECT coalesce(a.o_orderkey,b.o_orderkey) AS o_orderkey, a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS d1, a.o_totalprice IS DISTINCT FROM b.o_totalprice AS d2 FROM a FULL JOIN b ON a.o_orderkey=b.o_orderkey)
SELECT o_orderkey, CASE WHEN ak IS NULL THEN 'added' WHEN bk IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN ak IS NULL OR bk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN d1 THEN 'o_orderstatus' END, CASE WHEN d2 THEN 'o_totalprice' END) END AS columns FROM j WHERE ak IS NULL OR bk IS NULL OR d1 OR d2""")
def keyed_diff(spark, d):
    return D.keyed_diff(*_versions(spark, d), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(_LATER + " SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second, false AS equal")
def set_equality(spark, d):
    return D.set_equality(*_versions(spark, d))


@query(_LATER + " SELECT coalesce(a.o_orderkey,b.o_orderkey) AS o_orderkey, a.o_orderstatus AS first, b.o_orderstatus AS second FROM a FULL JOIN b ON a.o_orderkey=b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus ORDER BY 1 LIMIT 1")
def first_difference(spark, d):
    a, b = _versions(spark, d)
    return D.first_difference(a, b, "o_orderkey", "o_orderstatus")


@query(_LATER + " SELECT a.o_orderkey, abs(a.o_totalprice-b.o_totalprice) <= greatest(0.0, 1e-5*greatest(abs(a.o_totalprice),abs(b.o_totalprice))) AS same FROM a JOIN b ON a.o_orderkey=b.o_orderkey")
def tolerant_compare(spark, d):
    a, b = _versions(spark, d)
    j = a.join(b.select("o_orderkey", F.col("o_totalprice").alias("p")), "o_orderkey")
    return j.select("o_orderkey", N.close(F.col("o_totalprice"), F.col("p"), 0.0, 1e-5).alias("same"))


@query("""SELECT kind, count(*) AS n FROM (SELECT 'not_reached' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'reached_twice', o_custkey FROM orders GROUP BY o_custkey HAVING count(*)>1) GROUP BY ALL""")
def bijection_check(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = D.bijection_issues(o, o.select("o_orderkey"), table(spark, d, "customer").select("c_custkey"), "o_orderkey", "c_custkey")
    return out.groupBy("kind").agg(F.count("*").alias("n"))


# Evidence: a user's events as an action's log and observations.

_AT = 1705708800000000


@query(EV + f""", q AS (SELECT DISTINCT user_id AS condition_id FROM ev), j AS (SELECT condition_id, t, event_type='purchase' AS tm, value >= 50 AS bm, value > 250 AS value, t + 604800000000 AS until, event_id FROM q JOIN ev ON user_id=condition_id),
s AS (SELECT *, CASE WHEN NOT tm THEN 'wrong_type' WHEN NOT bm THEN 'binding_mismatch' WHEN t > {_AT} THEN 'future' WHEN until < {_AT} THEN 'expired' WHEN {_AT}-t > 259200000000 THEN 'stale' ELSE 'eligible' END AS st FROM j),
l AS (SELECT *, max(t) FILTER (st='eligible') OVER (PARTITION BY condition_id) AS lt FROM s)
SELECT condition_id, CASE WHEN count(DISTINCT value) FILTER (st='eligible' AND t=lt)=1 THEN CASE WHEN bool_or(value) FILTER (st='eligible' AND t=lt) THEN 'true' ELSE 'false' END ELSE 'unknown' END AS truth,
CASE count(DISTINCT value) FILTER (st='eligible' AND t=lt) WHEN 1 THEN 'observed' WHEN 0 THEN CASE min(CASE st WHEN 'wrong_type' THEN 0 WHEN 'binding_mismatch' THEN 1 WHEN 'expired' THEN 2 WHEN 'stale' THEN 3 WHEN 'future' THEN 4 ELSE 5 END) WHEN 0 THEN 'wrong_type' WHEN 1 THEN 'binding_mismatch' WHEN 2 THEN 'expired' WHEN 3 THEN 'stale' WHEN 4 THEN 'future' ELSE 'missing' END ELSE 'conflicting_values' END AS reason,
max(lt) AS evidence_time, count(*) FILTER (st='eligible' AND t=lt) AS n_latest, count(*) FILTER (st='future') AS n_future FROM l GROUP BY ALL""")
def truth_evaluation(spark, d):
    ev = events(spark, d)
    conditions = ev.select(F.col("user_id").alias("condition_id"), F.col("user_id").alias("subject"), F.lit("value").alias("predicate")).distinct()
    evidence = ev.select(F.col("user_id").alias("subject"), F.lit("value").alias("predicate"), F.col("event_id").alias("record_id"), "event_type", F.col("value").alias("v"), (F.col("value") > 250).alias("value"), F.col("t").alias("observed_at"), (F.col("t") + 604800000000).alias("valid_until"))
    return E.truth(conditions, evidence, F.col("v") >= 50, F.col("event_type") == "purchase", F.lit(_AT), F.lit(259200000000))


_STATE = "CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'executing' WHEN 'click' THEN 'executing' WHEN 'purchase' THEN 'succeeded' ELSE 'aborted' END"
_OK = "(before, state) IN (('accepted','executing'),('accepted','canceling'),('executing','canceling'),('executing','succeeded'),('executing','aborted'),('canceling','canceled'),('canceling','aborted'))"


def _log(spark, d):
    """A day of a user's events as the states of one action."""
    return events(spark, d).withColumn("action", F.concat_ws("/", "user_id", F.floor(F.col("t") / 86_400_000_000))).withColumn("state", F.expr(_STATE))


_LOG = EV + f", g AS (SELECT user_id||'/'||(t//86400000000) AS action, t, event_id, value, {_STATE} AS state FROM ev), b AS (SELECT *, lag(state) OVER (PARTITION BY action ORDER BY t, event_id) AS before FROM g)"


@query(_LOG + f" SELECT event_id, before, state AS after, {_OK} AS allowed FROM b WHERE before IS NOT NULL AND before <> state")
def lifecycle_transitions(spark, d):
    return E.transitions(_log(spark, d), ["action"], "t", "event_id", "state").select("event_id", "before", "after", "allowed")


_LIFE = _LOG + f""", x AS (SELECT action, count(*) FILTER (before IS NOT NULL AND before <> state AND NOT {_OK}) AS bad_transitions, arg_max(state,(t,event_id)) AS last_state, min(t) FILTER (state IN ('executing','succeeded','aborted','canceled')) AS running_from, count(*) AS n_rows, min((t,event_id)) FILTER (state IN ('succeeded','aborted','canceled')) AS e FROM b GROUP BY ALL),
y AS (SELECT x.*, (SELECT count(*) FROM g WHERE g.action=x.action AND (g.t,g.event_id) > x.e) AS rows_after_end FROM x),
z AS (SELECT action, last_state, running_from, rows_after_end, n_rows, bad_transitions, CASE WHEN bad_transitions > 0 OR rows_after_end > 0 THEN 'inconsistent' WHEN last_state IN ('succeeded','aborted','canceled') THEN 'result_'||last_state ELSE 'in_progress' END AS status FROM y)"""


@query(_LIFE + " SELECT * FROM z")
def lifecycle_status(spark, d):
    return E.lifecycle(_log(spark, d), ["action"], "t", "event_id", "state").select("action", "last_state", "running_from", "rows_after_end", "n_rows", "bad_transitions", "status")


@query(_LIFE + """, f AS (SELECT action, count(*) FILTER (value > 250) AS n_true, count(*) AS n_effects, arg_min(action, t) FROM g GROUP BY ALL), h AS (SELECT g.action, count(*) FILTER (value > 250) AS n_true, count(*) FILTER (value > 250 AND t < running_from) AS n_before FROM g JOIN z USING (action) GROUP BY ALL)
SELECT action, n_true, n_before, CASE WHEN status='inconsistent' THEN 'inconsistent_lifecycle' WHEN status='result_succeeded' AND n_true-n_before=1 THEN 'success_and_all_effects_observed_after_start' WHEN status='result_succeeded' AND n_true=1 THEN 'success_and_effects_observed_some_before_start' WHEN status='result_succeeded' THEN 'success_reported_effects_not_all_observed' WHEN status LIKE 'result_%' THEN 'not_successful' ELSE 'not_finished' END AS outcome FROM h JOIN z USING (action)""")
def post_execution_effect(spark, d):
    log = _log(spark, d)
    life = E.lifecycle(log, ["action"], "t", "event_id", "state").select("action", "running_from", "status")
    j = log.join(life, "action").groupBy("action", "status").agg(F.count_if(F.col("value") > 250).alias("n_true"), F.count_if((F.col("value") > 250) & (F.col("t") < F.col("running_from"))).alias("n_before"))
    return j.select("action", "n_true", "n_before", E.outcome(F.col("status"), F.lit(1), F.col("n_true"), F.col("n_before")).alias("outcome"))


@query("""WITH r AS (SELECT o_orderkey AS run, o_custkey, o_orderpriority, o_orderstatus AS intervention, CASE WHEN o_totalprice > 200000 THEN 'supported' WHEN o_totalprice > 100000 THEN 'unknown' ELSE 'refuted' END AS status FROM orders)
SELECT a.run AS base_run, b.run AS other_run, CASE WHEN b.status='supported' AND a.status='refuted' THEN 'contributed' WHEN b.status='refuted' AND a.status='supported' THEN 'prevented' WHEN b.status IN ('supported','refuted') AND a.status=b.status THEN 'no_difference' ELSE 'unknown' END AS contribution FROM r a JOIN r b ON a.o_custkey=b.o_custkey AND a.o_orderpriority=b.o_orderpriority AND a.intervention='P' AND b.intervention<>'P'""")
def counterfactual_contribution(spark, d):
    s = F.when(F.col("o_totalprice") > 200000, S.SUPPORTED).when(F.col("o_totalprice") > 100000, S.UNKNOWN).otherwise(S.REFUTED)
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("intervention"), s.alias("status"))
    return E.counterfactual(r, ["o_custkey", "o_orderpriority"], "run", "intervention", "status", "P").select("base_run", "other_run", "contribution")


# Scoring: labels as references, a rule on the text's length as prediction.

_PRED = "WITH p AS (SELECT doc_id, quality AS actual, CASE WHEN n_chars BETWEEN 300 AND 6000 THEN 1 ELSE 0 END AS predicted, source, lang FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang")
    j = table(spark, d, "labels").where("quality is not null").join(docs, "doc_id")
    return j.select("doc_id", F.col("quality").alias("actual"), F.when(F.col("n_chars").between(300, 6000), 1).otherwise(0).alias("predicted"), "source", "lang")


@query(_PRED + ", l AS (SELECT unnest([0,1]) AS x) SELECT a.x::BIGINT AS actual, b.x::BIGINT AS predicted, (SELECT count(*) FROM p WHERE actual=a.x AND predicted=b.x) AS n FROM l a, l b")
def confusion_matrix(spark, d):
    return C.confusion(_scored(spark, d), "actual", "predicted", [0, 1]).select(F.col("actual").cast("long").alias("actual"), F.col("predicted").cast("long").alias("predicted"), "n")


@query(_PRED + """, c AS (SELECT l AS label, count(*) FILTER (actual=l AND predicted=l) AS tp, count(*) FILTER (actual<>l AND predicted=l) AS fp, count(*) FILTER (actual=l AND predicted<>l) AS fn FROM p, (SELECT unnest([0,1,2]) AS l) GROUP BY ALL)
SELECT label::BIGINT AS label, tp, fp, fn, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) END AS precision, CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) END AS recall, CASE WHEN 2*tp+fp+fn>0 THEN (2*tp)::DOUBLE/(2*tp+fp+fn) END AS f1 FROM c""")
def prf1(spark, d):
    return C.label_scores(_scored(spark, d), "actual", "predicted", [0, 1, 2]).withColumn("label", F.col("label").cast("long"))


_Z = N.Z95


@query(_PRED + f""", g AS (SELECT lang, count(*) AS n, count(*) FILTER (actual=predicted) AS k FROM p GROUP BY ALL), h AS (SELECT *, k::DOUBLE/n AS q, n::DOUBLE AS m FROM g)
SELECT lang, n, k AS n_correct, floor((q+{_Z * _Z}::DOUBLE/(2*m)-{_Z}::DOUBLE*sqrt(q*(1-q)/m+{_Z * _Z}::DOUBLE/(4*m*m)))/(1+{_Z * _Z}::DOUBLE/m)*1e9+0.5)/1e9 AS lower, floor((q+{_Z * _Z}::DOUBLE/(2*m)+{_Z}::DOUBLE*sqrt(q*(1-q)/m+{_Z * _Z}::DOUBLE/(4*m*m)))/(1+{_Z * _Z}::DOUBLE/m)*1e9+0.5)/1e9 AS upper FROM h""")
def wilson_interval(spark, d):
    out = C.agreement(_scored(spark, d), F.col("actual") == F.col("predicted"), ["lang"])
    nine = lambda c: (F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c)
    return out.select("lang", "n", "n_correct", nine("lower"), nine("upper"))


@query(_PRED + " SELECT source, count(*) AS n, count(*) FILTER (actual=predicted) AS n_correct, count(*) FILTER (actual=predicted)::DOUBLE/count(*) AS accuracy FROM p GROUP BY ALL")
def capability_accuracy(spark, d):
    return C.agreement(_scored(spark, d), F.col("actual") == F.col("predicted"), ["source"]).select("source", "n", "n_correct", "accuracy")


@query("""SELECT d.source, count(*) AS n, count(*) FILTER (l.toxic=0)::DOUBLE/count(*) AS pass_rate FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def pass_rate(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), N.ratio(F.count_if(F.col("toxic") == 0), F.count("*")).alias("pass_rate"))


@query("""SELECT o.o_orderkey, CASE WHEN l.k IS NULL THEN 'missing' WHEN abs(o.n-l.n) <= greatest(0.5, 0.0) THEN 'correct' ELSE 'wrong' END AS result FROM (SELECT o_orderkey, (o_orderkey%5)::DOUBLE AS n FROM orders) o LEFT JOIN (SELECT l_orderkey AS k, (count(*)%5)::DOUBLE AS n FROM lineitem GROUP BY ALL) l ON k=o_orderkey""")
def answer_verification(spark, d):
    key = table(spark, d, "orders").select(F.col("o_orderkey"), (F.col("o_orderkey") % 5).cast("double").alias("n"))
    given = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") % 5).cast("double").alias("m"))
    return C.answers(key, given, "o_orderkey", "n", "m", 0.5, 0.0)


@query("""SELECT 0::BIGINT AS n_both, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey%2=0 UNION SELECT c_custkey FROM customer WHERE c_custkey%2=1) x WHERE o_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_not_predicted, 0::BIGINT AS n_not_listed, (SELECT count(*) FROM customer WHERE c_custkey%2=1 AND c_custkey NOT IN (SELECT o_custkey FROM orders))=0 AS equal""")
def inventory_equality(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return C.inventory_equal(o.where("k%2=0").distinct(), c.where("k%2=1"), o, "k")


# Text and content.


@query("""SELECT event_id, regexp_matches(props, '(?i)"(reward|rewards|success|is_success|official_success|oracle|oracle_result|evaluator|evaluator_result|task_success)"\\s*:') AS has_label FROM events""")
def forbidden_key_gate(spark, d):
    from ..sources.traces import has_label

    return table(spark, d, "events").select("event_id", has_label(F.col("props")).alias("has_label"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY ALL")
def dedup_by_digest(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS g, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_sets(spark, d):
    return spark.sql("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM {li} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", li=table(spark, d, "lineitem"))


@query("SELECT doc_id, (n_chars*1000000)::BIGINT AS ns, split_part(source||'/'||lang, '/', 2) AS tail, CASE WHEN doc_id%3=0 THEN n_chars ELSE doc_id%3 END AS stamp FROM documents")
def scalar_helpers(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", N.nanoseconds(F.col("n_chars") / 1000.0).alias("ns"), N.last_part(F.concat_ws("/", "source", "lang")).alias("tail"), N.effective_timestamp(F.col("doc_id") % 3, F.col("n_chars")).alias("stamp"))
