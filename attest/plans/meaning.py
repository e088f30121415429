"""Queries of the intents, assurance, question and record operators, over a knowledge graph of nations, customers, suppliers and parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import facts as K
from ..operators import intents as I
from ..operators import questions as Q
from ..sources import records as R
from ..sources.shared import shared_folder
from .knowledge import _TREE, _tree, _versions
from .registry import EV, events, query, table

_ENT = """WITH RECURSIVE ent AS (SELECT 'region/'||r_name AS entity_id, 'region' AS entity_type, r_regionkey AS k FROM region UNION ALL SELECT 'nation/'||n_name, 'nation', n_nationkey FROM nation UNION ALL SELECT 'customer/'||c_custkey, 'customer', c_custkey FROM customer UNION ALL SELECT 'supplier/'||s_suppkey, 'supplier', s_suppkey FROM supplier),
cl AS (SELECT 'in/n'||n_nationkey AS clause_id, 'nation/'||n_name AS subject, 'in' AS predicate, 'region/'||r_name AS object FROM nation JOIN region ON r_regionkey=n_regionkey UNION ALL SELECT 'in/c'||c_custkey, 'customer/'||c_custkey, 'in', 'nation/'||n_name FROM customer JOIN nation ON n_nationkey=c_nationkey UNION ALL SELECT 'in/s'||s_suppkey, 'supplier/'||s_suppkey, 'in', 'nation/'||n_name FROM supplier JOIN nation ON n_nationkey=s_nationkey
UNION ALL SELECT 'moves/s'||s_suppkey, 'nation/'||n_name, 'moves', 'supplier/'||s_suppkey FROM supplier JOIN nation ON n_nationkey=s_nationkey),
pr AS (SELECT 'in/c'||c_custkey AS node, 'in/n'||c_nationkey AS premise FROM customer UNION ALL SELECT 'in/s'||s_suppkey, 'in/n'||s_nationkey FROM supplier UNION ALL SELECT 'moves/s'||s_suppkey, 'in/s'||s_suppkey FROM supplier),
rq AS (SELECT 'rq/'||c_custkey AS requirement_id, CASE c_custkey%7 WHEN 0 THEN 'entity_exists' WHEN 1 THEN 'kinematic_path_exists' WHEN 2 THEN 'driver_drives_joint' WHEN 3 THEN 'driver_affects_frame' WHEN 4 THEN 'frame_has_asserted_role' WHEN 5 THEN 'constraint_declared' ELSE 'finite_configuration_witness_exists' END AS kind, 'customer/'||c_custkey AS subject, 'nation/'||c_nationkey AS object, c_custkey AS k FROM customer),
gr AS (SELECT requirement_id, kind, subject, object, CASE WHEN k%3=0 THEN 'met' WHEN k%4=0 THEN 'not_met' ELSE 'unknown' END AS status, k FROM rq),
fu AS (SELECT 'fn/'||c_mktsegment||'/'||c_nationkey%3 AS function_id, 'market/'||c_mktsegment AS provided_by, 'buy' AS verb, 'type/'||c_nationkey%3 AS object_type FROM customer GROUP BY ALL),
cap AS (SELECT 'cap/'||c_mktsegment||'/'||c_nationkey%3||'/'||c_custkey%40 AS capability_id, 'fn/'||c_mktsegment||'/'||c_nationkey%3 AS function_id, 'rq/'||c_custkey AS requirement_id FROM customer),
cst AS (SELECT capability_id, function_id, count(*) AS n, count(*) FILTER (status='met') AS n_met, count(*) FILTER (status='not_met') AS n_not FROM cap LEFT JOIN gr USING (requirement_id) GROUP BY ALL),
cs AS (SELECT *, CASE WHEN n_not > 0 THEN 'unavailable' WHEN n_met=n THEN 'available' ELSE 'unknown' END AS state FROM cst)"""

_KINDS = ["entity_exists", "kinematic_path_exists", "driver_drives_joint", "driver_affects_frame", "frame_has_asserted_role", "constraint_declared", "finite_configuration_witness_exists"]


def _knowledge(spark, d):
    r, n, c, s = (table(spark, d, x) for x in ("region", "nation", "customer", "supplier"))
    cat = lambda p, x: F.concat(F.lit(p), x)
    nation, region = n.select("n_nationkey", "n_regionkey", cat("nation/", F.col("n_name")).alias("nation")), r.select("r_regionkey", cat("region/", F.col("r_name")).alias("region"))
    entities = region.select(F.col("region").alias("entity_id"), F.lit("region").alias("entity_type")).unionByName(nation.select(F.col("nation").alias("entity_id"), F.lit("nation").alias("entity_type")))
    entities = entities.unionByName(c.select(cat("customer/", F.col("c_custkey")).alias("entity_id"), F.lit("customer").alias("entity_type"))).unionByName(s.select(cat("supplier/", F.col("s_suppkey")).alias("entity_id"), F.lit("supplier").alias("entity_type")))
    clause = lambda df, i, a, p, b: df.select(i.alias("clause_id"), a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"))
    cn, sn = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), s.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    clauses = clause(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), cat("in/n", F.col("n_nationkey")), F.col("nation"), "in", F.col("region"))
    clauses = clauses.unionByName(clause(cn, cat("in/c", F.col("c_custkey")), cat("customer/", F.col("c_custkey")), "in", F.col("nation"))).unionByName(clause(sn, cat("in/s", F.col("s_suppkey")), cat("supplier/", F.col("s_suppkey")), "in", F.col("nation"))).unionByName(clause(sn, cat("moves/s", F.col("s_suppkey")), F.col("nation"), "moves", cat("supplier/", F.col("s_suppkey"))))
    premise = lambda df, a, b: df.select(a.alias("node"), b.alias("premise"))
    premises = premise(c, cat("in/c", F.col("c_custkey")), cat("in/n", F.col("c_nationkey"))).unionByName(premise(s, cat("in/s", F.col("s_suppkey")), cat("in/n", F.col("s_nationkey")))).unionByName(premise(s, cat("moves/s", F.col("s_suppkey")), cat("in/s", F.col("s_suppkey"))))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("c_custkey") % 7 + 1).cast("int"))
    requirements = c.select(cat("rq/", F.col("c_custkey")).alias("requirement_id"), kind.alias("kind"), cat("customer/", F.col("c_custkey")).alias("subject"), cat("nation/", F.col("c_nationkey")).alias("object"), "c_custkey")
    third = F.col("c_nationkey") % 3
    function = F.concat(F.lit("fn/"), "c_mktsegment", F.lit("/"), third)
    functions = c.select(function.alias("function_id"), cat("market/", F.col("c_mktsegment")).alias("provided_by"), F.lit("buy").alias("verb"), cat("type/", third).alias("object_type")).distinct()
    capability = F.concat(F.lit("cap/"), "c_mktsegment", F.lit("/"), third, F.lit("/"), F.col("c_custkey") % 40)
    capabilities = c.select(capability.alias("capability_id"), function.alias("function_id"), cat("rq/", F.col("c_custkey")).alias("requirement_id"))
    inventories = requirements.where("c_custkey % 4 = 0").select("subject", F.col("kind").alias("inventory"))
    return I.Knowledge(
        entities, clauses, premises, _tree(spark, d), sn.select(F.col("nation").alias("driver"), cat("supplier/", F.col("s_suppkey")).alias("frame")), c.select(cat("market/", F.col("c_mktsegment")).alias("component"), cat("customer/", F.col("c_custkey")).alias("member")),
        functions, capabilities, requirements.drop("c_custkey"), capabilities.select(F.concat(F.lit("aff/"), "capability_id").alias("affordance_id"), F.element_at(F.split("capability_id", "/"), 3).alias("_t"), "capability_id").select("affordance_id", cat("type/", F.col("_t")).alias("object_type"), "capability_id").distinct(), inventories,
    ), requirements


def _grounded(spark, d):
    k, r = _knowledge(spark, d)
    held = r.where("c_custkey % 3 = 0")
    return k, I.ground_requirements(k, {kind: held.where(F.col("kind") == kind).select("subject", "object") for kind in _KINDS})


@query(_ENT + " SELECT requirement_id, kind, status FROM gr")
def requirement_grounding(spark, d):
    return _grounded(spark, d)[1].select("requirement_id", "kind", "status")


@query(_ENT + " SELECT capability_id, function_id, n, n_met, n_not, state FROM cs")
def explain_capability(spark, d):
    return I.explain_capability(*_grounded(spark, d))


@query(_ENT + " SELECT 'aff/'||capability_id AS affordance_id, state FROM cs WHERE split_part(capability_id,'/',3)='1'")
def explain_affordance(spark, d):
    k, g = _grounded(spark, d)
    return I.explain_affordance(k, g, "type/1").select("affordance_id", "state")


@query(_ENT + ", f AS (SELECT capability_id, state FROM cs JOIN fu USING (function_id) WHERE object_type='type/2' AND verb='buy') SELECT CASE WHEN count(*) FILTER (state='available') > 0 THEN 'yes' ELSE 'unknown' END AS answer, coalesce(array_to_string(list_sort(list(DISTINCT capability_id) FILTER (state='available')), ','), '') AS supports FROM f")
def can_perform_action(spark, d):
    k, g = _grounded(spark, d)
    return I.can_perform_action(k, g, "buy", "type/2")


@query(_ENT + " SELECT function_id, verb, object_type, provided_by FROM fu WHERE provided_by='market/BUILDING'")
def what_is_entity_for(spark, d):
    k, _ = _knowledge(spark, d)
    some = k.components.where("component = 'market/BUILDING'").agg(F.min("member").alias("m")).first()["m"]
    return I.what_is_entity_for(k, some)


@query(_ENT + " SELECT 'member' AS kind, 'customer/'||c_custkey AS item FROM customer WHERE c_mktsegment='BUILDING' UNION ALL SELECT 'function', function_id FROM fu WHERE provided_by='market/BUILDING'")
def describe_component(spark, d):
    return I.describe_component(_knowledge(spark, d)[0], "market/BUILDING")


@query(_ENT + " SELECT function_id, provided_by, verb, object_type FROM fu WHERE function_id='fn/MACHINERY/0'")
def explain_function(spark, d):
    return I.explain_function(_knowledge(spark, d)[0], "fn/MACHINERY/0").select("function_id", "provided_by", "verb", "object_type")


@query(_TREE + ", k AS (SELECT e.child AS node, count(x.child) AS n FROM e LEFT JOIN e x ON x.parent=e.child GROUP BY ALL) SELECT 'region' AS entity_type, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'tree_leaf', count(*) FILTER (n=0) FROM k UNION ALL SELECT 'tree_branch', count(*) FILTER (n>1) FROM k")
def structural_summary(spark, d):
    return I.structural_summary(_knowledge(spark, d)[0])


@query(_ENT + " SELECT object AS frame, clause_id FROM cl WHERE predicate='moves' AND subject='nation/NATION_7'")
def explain_driver_effect(spark, d):
    return I.explain_driver_effect(_knowledge(spark, d)[0], "nation/NATION_7")


@query(_ENT + ", w AS (SELECT clause_id AS node FROM cl WHERE predicate='moves' AND subject='nation/NATION_7' UNION SELECT premise FROM w JOIN pr USING (node)) SELECT cl.* FROM w JOIN cl ON clause_id=node")
def explain_frame_pose_law(spark, d):
    """Clauses that move frames, and everything that they rest on."""
    return I.explain_clauses(_knowledge(spark, d)[0], "nation/NATION_7", "moves")


@query(_ENT + """, a AS (SELECT object AS n, clause_id AS c FROM cl WHERE subject='customer/1' AND predicate='in'), b AS (SELECT object AS n, clause_id AS c FROM cl WHERE subject='supplier/3' AND predicate='in'), ra AS (SELECT object AS r, clause_id AS c FROM cl JOIN a ON subject=a.n WHERE predicate='in'), rb AS (SELECT object AS r, clause_id AS c FROM cl JOIN b ON subject=b.n WHERE predicate='in'),
w AS (SELECT CASE WHEN a.n=b.n THEN [('customer/1', a.c), (a.n, NULL), ('supplier/3', b.c)] WHEN ra.r=rb.r THEN [('customer/1', a.c), (a.n, ra.c), (ra.r, NULL), (b.n, rb.c), ('supplier/3', b.c)] ELSE [] END AS p FROM a, b, ra, rb), u AS (SELECT unnest(p) AS s, unnest(range(len(p))) AS step FROM w) SELECT step::INT AS step, s[1] AS node, s[2] AS clause_id FROM u""")
def trace_clause_path(spark, d):
    """The way from a customer to a supplier over what lies in what; none, if they are in different regions."""
    return I.trace_clause_path(_knowledge(spark, d)[0], "customer/1", "supplier/3", "in")


@query(_ENT + " SELECT clause_id, predicate, CASE WHEN subject='nation/NATION_7' THEN 'subject' ELSE 'object' END AS role, CASE WHEN subject='nation/NATION_7' THEN object ELSE subject END AS other FROM cl WHERE 'nation/NATION_7' IN (subject, object)")
def describe_entity(spark, d):
    return I.describe_entity(_knowledge(spark, d)[0], "nation/NATION_7")


@query(_ENT + """, a AS (SELECT entity_id AS name FROM ent WHERE entity_type IN ('region','nation') UNION ALL SELECT split_part(entity_id,'/',2) FROM ent WHERE entity_type IN ('customer','region') UNION ALL SELECT 'nobody'), t AS (SELECT split_part(entity_id,'/',2) AS tail, count(*) AS n, min(entity_id) AS one FROM ent GROUP BY ALL)
SELECT a.name, CASE WHEN e.entity_id IS NOT NULL THEN e.entity_id WHEN n=1 THEN one END AS entity_id, CASE WHEN e.entity_id IS NOT NULL OR n=1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS state FROM a LEFT JOIN ent e ON e.entity_id=a.name LEFT JOIN t ON t.tail=a.name""")
def resolve_entities(spark, d):
    k, _ = _knowledge(spark, d)
    e = k.entities
    tail = lambda df: df.select(F.substring_index("entity_id", "/", -1).alias("name"))
    names = e.where("entity_type in ('region', 'nation')").select(F.col("entity_id").alias("name")).unionByName(tail(e.where("entity_type in ('customer', 'region')"))).unionByName(spark.sql("SELECT 'nobody' AS name"))
    return I.resolve(k, names)


@query(_ENT + """, u AS (SELECT function_id AS node FROM fu WHERE function_id LIKE 'fn/BUILDING/%' UNION SELECT 'market/'||split_part(node,'/',2) FROM u WHERE node LIKE 'fn/%'),
l AS (SELECT 'in/c'||c_custkey AS node FROM customer JOIN u ON u.node='market/'||c_mktsegment WHERE c_custkey%5=0 UNION SELECT premise FROM l JOIN pr USING (node)) SELECT 'functional' AS layer, node FROM u UNION ALL SELECT 'structural', node FROM l""")
def two_layer_closure(spark, d):
    k, _ = _knowledge(spark, d)
    c = table(spark, d, "customer").where("c_custkey % 5 = 0")
    links = c.select(F.concat(F.lit("market/"), "c_mktsegment").alias("node"), F.concat(F.lit("in/c"), "c_custkey").alias("premise"))
    functional = k.functions.select(F.col("function_id").alias("node"), F.col("provided_by").alias("premise"))
    return I.two_layer_closure(functional, k.premises, links, k.functions.where("function_id like 'fn/BUILDING/%'").select(F.col("function_id").alias("node")))


@query(_ENT + " SELECT 'capabilities' AS \"table\", capability_id AS id, 'unknown_requirement_id' AS issue FROM cap WHERE split_part(requirement_id,'/',2)::INT%50=0 GROUP BY ALL UNION ALL SELECT 'functions', function_id, 'repeated_id' FROM fu WHERE object_type='type/0' UNION ALL SELECT 'functions', function_id, 'unknown_provided_by' FROM fu WHERE provided_by='market/FURNITURE'")
def functional_model_issues(spark, d):
    k, r = _knowledge(spark, d)
    k.requirements = r.where("c_custkey % 50 <> 0")
    k.functions = k.functions.unionByName(k.functions.where("object_type = 'type/0'"))
    k.components = k.components.where("component <> 'market/FURNITURE'")
    return I.compile_issues(k)


@query("SELECT 'n'||n_nationkey AS entity_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS types, min(nm) AS name, count(*) FILTER (w=1) AS n_declared FROM (SELECT c_nationkey AS n_nationkey, unnest([c_mktsegment, 'customer']) AS t, unnest([1,2]) AS w, c_name AS nm FROM customer UNION ALL SELECT s_nationkey, 'supplier', 1, s_name FROM supplier) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY n_nationkey"))
def entity_merge(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("entity_id"), F.array("c_mktsegment", F.lit("customer")).alias("types"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("entity_id"), F.array(F.lit("supplier")).alias("types"), F.col("s_name").alias("name"))
    return I.merge_entities(c.unionByName(s)).withColumn("types", F.array_join("types", ","))


# Action assurance: a user is an action; its day's events are its records, event types its conditions.

_ASSURE = EV + """, rec AS (SELECT user_id AS action, event_id AS record_id, t AS observed_at, CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'executing' WHEN 'click' THEN 'executing' WHEN 'purchase' THEN 'succeeded' ELSE 'aborted' END AS state FROM ev WHERE event_id%40 < 2),
tr AS (SELECT user_id AS action, event_type AS condition_id, CASE WHEN event_type IN ('view','signup') THEN 'precondition' ELSE 'effect' END AS role, event_type<>'error' AS wanted, arg_max(value,(t,event_id)) AS v, max(t) AS evidence_time, arg_max(event_id,(t,event_id)) AS record_id FROM ev WHERE event_type<>'click' GROUP BY ALL),
th AS (SELECT *, CASE WHEN v > 40 THEN 'true' WHEN v > 15 THEN 'false' ELSE 'unknown' END AS truth, CASE WHEN v > 15 THEN 'observed' ELSE 'stale' END AS reason FROM tr), tm AS (SELECT *, truth=CASE WHEN wanted THEN 'true' ELSE 'false' END AS met FROM th),
b AS (SELECT *, lag(state) OVER (PARTITION BY action ORDER BY observed_at, record_id) AS before FROM rec), ok AS (SELECT *, (before, state) IN (('accepted','executing'),('accepted','canceling'),('executing','canceling'),('executing','succeeded'),('executing','aborted'),('canceling','canceled'),('canceling','aborted')) AS fine FROM b),
x AS (SELECT action, count(*) FILTER (before IS NOT NULL AND before<>state AND NOT fine) AS bad, arg_max(state,(observed_at,record_id)) AS last_state, min(observed_at) FILTER (state IN ('executing','succeeded','aborted')) AS running_from, min((observed_at,record_id)) FILTER (state IN ('succeeded','aborted')) AS e FROM ok GROUP BY ALL),
lc AS (SELECT x.action, last_state, running_from, CASE WHEN bad > 0 OR (SELECT count(*) FROM rec WHERE rec.action=x.action AND (rec.observed_at,rec.record_id) > x.e) > 0 THEN 'inconsistent' WHEN last_state IN ('succeeded','aborted') THEN 'result_'||last_state ELSE 'in_progress' END AS status FROM x),
re AS (SELECT tm.*, CASE WHEN running_from IS NULL THEN 'not_started' WHEN evidence_time < running_from THEN 'before_start' ELSE 'after_start' END AS relation, coalesce(status,'no_records') AS status FROM tm LEFT JOIN lc USING (action))"""


def _assurance(spark, d):
    ev = events(spark, d)
    state = F.when(F.col("event_type") == "signup", "accepted").when(F.col("event_type").isin("view", "click"), "executing").when(F.col("event_type") == "purchase", "succeeded").otherwise("aborted")
    records = ev.where("event_id % 40 < 2").select(F.col("user_id").alias("action"), F.col("event_id").alias("record_id"), F.col("t").alias("observed_at"), state.alias("state"))
    last = ev.where("event_type <> 'click'").groupBy(F.col("user_id").alias("action"), F.col("event_type").alias("condition_id")).agg(F.max_by(F.struct("value", "t", "event_id"), F.struct("t", "event_id")).alias("l"))
    v = F.col("l.value")
    truths = last.select("action", "condition_id", F.when(F.col("condition_id").isin("view", "signup"), "precondition").otherwise("effect").alias("role"), (F.col("condition_id") != "error").alias("wanted"), F.when(v > 40, "true").when(v > 15, "false").otherwise("unknown").alias("truth"), F.when(v > 15, "observed").otherwise("stale").alias("reason"), F.col("l.t").alias("evidence_time"), F.col("l.event_id").alias("record_id"))
    life = E.lifecycle(records, ["action"], "observed_at", "record_id", "state").select("action", "status", "last_state", "running_from")
    return I.Assurance(truths, life, records)


@query(_ASSURE + """, s AS (SELECT action, status, count(*) FILTER (role='precondition') AS n_preconditions, count(*) FILTER (role='precondition' AND met) AS n_met, count(*) FILTER (role='precondition' AND truth='unknown') AS u, count(*) FILTER (role='effect') AS n_effects, count(*) FILTER (role='effect' AND met) AS n_observed, count(*) FILTER (role='effect' AND met AND relation='before_start') AS n_before FROM re GROUP BY ALL)
SELECT action, status, CASE WHEN n_met=n_preconditions THEN 'ready' WHEN n_met+u < n_preconditions THEN 'not_ready' ELSE 'unknown' END AS readiness, n_preconditions, n_met, n_effects, n_observed, CASE WHEN status='inconsistent' THEN 'inconsistent_lifecycle' WHEN status='result_succeeded' AND n_observed-n_before=n_effects THEN 'success_and_all_effects_observed_after_start' WHEN status='result_succeeded' AND n_observed=n_effects THEN 'success_and_effects_observed_some_before_start' WHEN status='result_succeeded' THEN 'success_reported_effects_not_all_observed' WHEN status LIKE 'result_%' THEN 'not_successful' ELSE 'not_finished' END AS outcome FROM s""")
def summarize_action(spark, d):
    return I.summarize_action(_assurance(spark, d))


@query(_ASSURE + " SELECT action, condition_id, wanted, truth, reason, met FROM tm WHERE role='precondition'")
def explain_precondition(spark, d):
    return I.explain_precondition(_assurance(spark, d))


@query(_ASSURE + " SELECT action, condition_id, truth, relation, met AND relation='after_start' AS attributable FROM re WHERE role='effect'")
def explain_effect(spark, d):
    return I.explain_effect(_assurance(spark, d))


@query(_ASSURE + " SELECT tm.action, tm.record_id, rec.observed_at, count(*) AS n_conditions, array_to_string(list_sort(list(DISTINCT condition_id)), ',') AS conditions FROM tm JOIN rec ON rec.action=tm.action AND rec.record_id=tm.record_id GROUP BY ALL")
def explain_evidence(spark, d):
    return I.explain_evidence(_assurance(spark, d))


@query(_ASSURE + " SELECT action, record_id, before, state AS after, fine AS allowed FROM ok WHERE before IS NOT NULL AND before<>state")
def explain_lifecycle(spark, d):
    return I.explain_lifecycle(_assurance(spark, d))


@query(_ASSURE + " SELECT action, condition_id, truth, reason FROM tm WHERE role='precondition' AND NOT met")
def why_not_ready(spark, d):
    a = _assurance(spark, d)
    own = a.truths.where("role = 'precondition'").withColumn("condition_id", F.concat_ws("|", "action", "condition_id"))
    out = I.why_not_ready(own, a.met)
    return out.select(F.substring_index("condition_id", "|", 1).cast("long").alias("action"), F.substring_index("condition_id", "|", -1).alias("condition_id"), "truth", "reason")


# Questions, grading, edits, documents.

_QUESTIONS = """WITH q AS (SELECT 'nation_of' AS capability, c_custkey::VARCHAR AS subject, 'In which nation is customer '||c_custkey||'?' AS question, n_name AS answer FROM customer JOIN nation ON n_nationkey=c_nationkey
UNION ALL SELECT 'order_count', c_custkey::VARCHAR, 'How many orders has customer '||c_custkey||'?', count(o_orderkey)::VARCHAR FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey
UNION ALL SELECT 'same_region', n_nationkey::VARCHAR, 'Which nations share a region with '||n_nationkey||'?', (SELECT array_to_string(list_sort(list(m.n_name)), ',') FROM nation m WHERE m.n_regionkey=n.n_regionkey) FROM nation n
UNION ALL SELECT 'unsupported', p_partkey::VARCHAR, 'What does part '||p_partkey||' weigh?', 'unknown' FROM part),
i AS (SELECT sha256(length(capability)||':'||capability||'|'||length(subject)||':'||subject||'|'||length(question)||':'||question) AS question_id, * FROM q)"""


def _questions(spark, d):
    c, n, o, p = (table(spark, d, x) for x in ("customer", "nation", "orders", "part"))
    same = n.select(F.col("n_regionkey"), F.col("n_name").alias("m")).groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("a"))
    count = o.groupBy("o_custkey").agg(F.count("*").alias("k"))
    return Q.question_set([
        Q.family(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "nation_of", F.col("c_custkey"), "In which nation is customer {}?", F.col("n_name")),
        Q.family(c.join(count, F.col("c_custkey") == F.col("o_custkey"), "left"), "order_count", F.col("c_custkey"), "How many orders has customer {}?", F.coalesce("k", F.lit(0))),
        Q.family(n.join(same, "n_regionkey"), "same_region", F.col("n_nationkey"), "Which nations share a region with {}?", F.col("a")),
        Q.family(p, "unsupported", F.col("p_partkey"), "What does part {} weigh?", F.lit("unknown")),
    ])


@query(_QUESTIONS + " SELECT question_id, capability, subject, question FROM i")
def question_generation(spark, d):
    return _questions(spark, d)[0]


@query(_QUESTIONS + """, g AS (SELECT question_id, CASE WHEN subject::INT%5=0 THEN 'x' ELSE answer END AS a FROM i WHERE subject::INT%7<>0), r AS (SELECT capability, i.answer=g.a AS ok FROM i LEFT JOIN g USING (question_id)), t AS (SELECT unnest(['nation_of','order_count','same_region','unsupported','never_asked']) AS capability, unnest([0.6,0.7,0.9,0.0,0.1]) AS least),
s AS (SELECT capability, count(*) AS n, count(*) FILTER (ok) AS n_correct FROM r GROUP BY ALL) SELECT capability, coalesce(n,0) AS n, coalesce(n_correct,0) AS n_correct, CASE WHEN n > 0 THEN n_correct::DOUBLE/n END AS accuracy, coalesce(n_correct::DOUBLE/n >= least, false) AS passed FROM t LEFT JOIN s USING (capability)""")
def suite_grading(spark, d):
    """Answers of which every fifth is wrong and every seventh is missing."""
    from ..operators.score import answers

    public, key = _questions(spark, d)
    known = public.select("question_id", "subject").join(key, "question_id").where("cast(subject as int) % 7 <> 0")
    given = known.select("question_id", F.when(F.col("subject").cast("int") % 5 == 0, "x").otherwise(F.col("answer")).alias("said"))
    results = answers(key, given, "question_id", "answer", "said").join(key.select("question_id", "capability"), "question_id")
    least = spark.createDataFrame([("nation_of", 0.6), ("order_count", 0.7), ("same_region", 0.9), ("unsupported", 0.0), ("never_asked", 0.1)], "capability string, least double")
    return Q.grade(results, least)


_FLAT = "trim(regexp_replace(coalesce({}, ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"WITH m AS (SELECT DISTINCT {_FLAT.format('text')} AS marker FROM benchmark), d AS (SELECT doc_id, {_FLAT.format('text')} AS t FROM documents) SELECT doc_id AS id, count(*) AS n FROM d JOIN m ON marker<>'' AND contains(' '||t||' ', ' '||marker||' ') GROUP BY ALL")
def leak_scan(spark, d):
    """Documents that hold an item of the benchmark as it stands."""
    return Q.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").select(F.col("text").alias("marker")).distinct())


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), e AS (SELECT o_orderkey, 'o_orderstatus' AS c, CASE WHEN o_orderkey%2=0 THEN 'X' END AS v, true AS req FROM orders WHERE o_orderkey%5=0 UNION ALL SELECT o_orderkey, 'o_totalprice', NULL, false FROM orders WHERE o_orderkey%22=0),
k AS (SELECT o_orderkey, o_orderkey%13=0 AND o_orderkey<>0 AS gone, o_orderkey%7=0 AND o_orderkey%13<>0 AND o_orderstatus<>'X' AS s, o_orderkey%11=0 AND o_orderkey%13<>0 AS p FROM a), h AS (SELECT o_orderkey, 'o_orderstatus' AS c FROM k WHERE gone OR s UNION ALL SELECT o_orderkey, 'o_totalprice' FROM k WHERE gone OR p UNION ALL SELECT -o_orderkey, unnest(['o_orderstatus','o_totalprice']) FROM k WHERE o_orderkey%17=0 AND o_orderkey<>0),
j AS (SELECT coalesce(h.o_orderkey,e.o_orderkey) AS o_orderkey, coalesce(h.c,e.c) AS c, h.c IS NOT NULL AS changed, e.c IS NOT NULL AS expected, v, req FROM h FULL JOIN e ON h.o_orderkey=e.o_orderkey AND h.c=e.c)
SELECT * FROM (SELECT o_orderkey, c AS "column", CASE WHEN NOT expected AND o_orderkey NOT IN (SELECT o_orderkey FROM e) THEN 'unexpected' WHEN NOT expected THEN 'not_allowed' WHEN NOT changed THEN CASE WHEN req THEN 'missing' END WHEN v IS NOT NULL AND (o_orderkey%13=0) THEN 'wrong_value' ELSE 'done' END AS outcome FROM j) WHERE outcome IS NOT NULL""")
def edit_grading(spark, d):
    a, b = _versions(spark, d)
    o = a.select("o_orderkey")
    some = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("o_orderstatus").alias("column"), F.when(F.col("o_orderkey") % 2 == 0, "X").alias("value"), F.lit(True).alias("required"))
    free = o.where("o_orderkey % 22 = 0").select("o_orderkey", F.lit("o_totalprice").alias("column"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("required"))
    return Q.grade_edits(a, b, some.unionByName(free), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("""WITH o AS (SELECT o_custkey, list_sort(list('{"o_orderkey":'||o_orderkey||',"o_orderstatus":"'||o_orderstatus||'"}' ORDER BY o_orderkey)) AS l, array_to_string(list('{"o_orderkey":'||o_orderkey||',"o_orderstatus":"'||o_orderstatus||'"}' ORDER BY o_orderkey), ',') AS s FROM orders GROUP BY ALL)
SELECT c_custkey, '{"c_custkey":'||c_custkey||',"c_name":"'||c_name||'","c_nationkey":'||c_nationkey||',"orders":['||coalesce(s,'')||']}' AS card FROM customer LEFT JOIN o ON o_custkey=c_custkey""")
def entity_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return Q.cards(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), {"orders": o}, "c_custkey")


# Sources and sinks.


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey=1 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def json_round_trip(spark, d):
    """Rows written as JSON lines to the shared folder and read again."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("n_regionkey"))
    at = f"{shared_folder(spark)}/attest-json-{uuid.uuid4().hex}"
    R.write_json(n, at)
    return R.read_json(spark, at, ", ".join(f"{c} {t}" for c, t in n.dtypes))


@query("SELECT 'customer/'||c_custkey AS subject, c_name AS object FROM customer WHERE c_custkey IN (3, 17, 40)")
def fact_point_read(spark, d):
    """A few facts read by their subjects from a table sorted by them."""
    facts = K.facts_of(table(spark, d, "customer"), F.concat(F.lit("customer/"), F.col("c_custkey")), ["c_name", "c_mktsegment"])
    at = f"{shared_folder(spark)}/attest-facts-{uuid.uuid4().hex}"
    K.write_facts(facts.repartitionByRange(4, "subject").sortWithinPartitions("subject"), at)
    return R.point_read(spark, f"{at}/predicate=c_name", "subject", ["customer/3", "customer/17", "customer/40"]).select("subject", "object")


@query("""WITH v AS (SELECT vec_id FROM embeddings), r AS (SELECT vec_id, 'r'||vec_id||'/0' AS record_id, vec_id%2=0 AS value FROM v UNION ALL SELECT vec_id, CASE WHEN vec_id%25=0 THEN 'shared' ELSE 'r'||vec_id||'/1' END, true FROM v), bad AS (SELECT vec_id FROM v WHERE vec_id%7=0 OR vec_id%11=0 OR vec_id%13=0 OR vec_id%17=0 OR vec_id%19=0)
SELECT record_id, 's'||vec_id AS source_id, value FROM r WHERE vec_id NOT IN (SELECT vec_id FROM bad) AND NOT (record_id='shared' AND (SELECT count(*) FROM r x WHERE x.record_id='shared' AND x.vec_id NOT IN (SELECT vec_id FROM bad)) > 1)""")
def evidence_sources(spark, d):
    """One JSON evidence file for each vector: some not declared, tampered with, outside the folder, on another clock, or with labels."""
    return _evidence(spark, d)[0].select("record_id", "source_id", "value")


@query("""SELECT CASE WHEN vec_id%11=0 THEN '/x/' ELSE '/b/' END||vec_id AS path, CASE WHEN vec_id%7=0 THEN 'not_declared' WHEN vec_id%11=0 THEN 'path_outside' WHEN vec_id%13=0 THEN 'tampered' WHEN vec_id%17=0 THEN 'label' ELSE 'other_clock' END AS issue FROM embeddings WHERE vec_id%7=0 OR vec_id%11=0 OR vec_id%13=0 OR vec_id%17=0 OR vec_id%19=0
UNION ALL SELECT '/b/'||vec_id, 'record_repeated' FROM embeddings WHERE vec_id%25=0 AND NOT (vec_id%7=0 OR vec_id%11=0 OR vec_id%13=0 OR vec_id%17=0 OR vec_id%19=0) AND (SELECT count(*) FROM embeddings WHERE vec_id%25=0 AND NOT (vec_id%7=0 OR vec_id%11=0 OR vec_id%13=0 OR vec_id%17=0 OR vec_id%19=0)) > 1""")
def evidence_source_issues(spark, d):
    return _evidence(spark, d)[1]


def _evidence(spark, d):
    v = table(spark, d, "embeddings").select("vec_id")
    i = F.col("vec_id")
    record = lambda n, rid, value: F.struct(rid.alias("record_id"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"), value.alias("value"), F.lit(1).alias("observed_at"))
    one, two = record(0, F.concat(F.lit("r"), i, F.lit("/0")), i % 2 == 0), record(1, F.when(i % 25 == 0, "shared").otherwise(F.concat(F.lit("r"), i, F.lit("/1"))), F.lit(True))
    raw = F.to_json(F.struct(F.concat(F.lit("s"), i).alias("source_id"), F.when(i % 19 == 0, "sim").otherwise("wall").alias("clock"), F.array(one, two).alias("records"), F.when(i % 17 == 0, 1.0).alias("Reward")))
    path = F.concat(F.when(i % 11 == 0, "/x/").otherwise("/b/"), i)
    docs = v.select(path.alias("path"), raw.alias("raw"), i.alias("i"))
    declared = docs.where("i % 7 <> 0").select("path", F.when(F.col("i") % 13 == 0, "0").otherwise(F.sha2("raw", 256)).alias("digest"))
    return R.read_evidence(docs.drop("i"), declared, "/b", "wall")


@query("SELECT 'scene'||n_regionkey AS scene, 'f'||n_nationkey AS frame, 'world' AS parent, n_nationkey::DOUBLE AS x FROM nation WHERE n_regionkey<>2")
def scene_documents(spark, d):
    """A JSON scene per region; one declares its world again."""
    n = table(spark, d, "nation")
    pose = F.struct(F.lit("world").alias("parent"), F.array(F.col("n_nationkey") * 1.0, F.lit(0.0), F.lit(0.0)).alias("xyz"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("quaternion"))
    each = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("f"), "n_nationkey"), pose))).alias("frames"))
    raw = F.to_json(F.struct(F.concat(F.lit("scene"), "n_regionkey").alias("scene_id"), F.lit("world").alias("world_frame"), F.when(F.col("n_regionkey") == 2, F.map_concat("frames", F.create_map(F.lit("world"), F.element_at(F.map_values("frames"), 1)))).otherwise(F.col("frames")).alias("frames")))
    return R.read_scenes(each.select(raw.alias("raw")))[0].select("scene", "frame", "parent", F.col("xyz")[0].alias("x"))


@query("SELECT c_custkey, CASE WHEN c_custkey%9=0 THEN NULL ELSE c_custkey%4<>0 END AS same FROM customer")
def semantic_xml(spark, d):
    """XML of two writers: attributes in another order and numbers in another spelling are the same, another number is not."""
    k = F.col("c_custkey")
    a = F.concat(F.lit('<link name="l'), k, F.lit('"><origin xyz="1 0.50 '), k, F.lit('" rpy="0 0 0"/></link>'))
    b = F.when(k % 9 == 0, "<link").otherwise(F.concat(F.lit('<link name="l'), k, F.lit('">\n  <origin rpy="0 0.0 0" xyz="1.0 0.5 '), F.when(k % 4 == 0, k + 1).otherwise(k), F.lit('"/>\n</link>')))
    c = table(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b"))
    return c.select("c_custkey", (R.canonical_xml(F.col("a")) == R.canonical_xml(F.col("b"))).alias("same"))


@query("SELECT c_custkey, CASE WHEN c_nationkey%2=0 THEN 'sha256:'||sha256('n'||c_nationkey) ELSE '/f/'||c_nationkey END AS path FROM customer")
def content_addresses(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0")
    files = n.select(F.concat(F.lit("/f/"), "n_nationkey").alias("path"), F.sha2(F.concat(F.lit("n"), "n_nationkey"), 256).alias("digest"))
    return R.content_addressed(table(spark, d, "customer").select("c_custkey", F.concat(F.lit("/f/"), "c_nationkey").alias("path")), "path", files)


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY ALL")
def distinct_counts(spark, d):
    """Exact distinct counts, and whether the approximate ones are within 15 %."""
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("_a"))
    return out.select("l_returnflag", "exact", (F.abs(F.col("_a") - F.col("exact")) <= 0.15 * F.col("exact")).alias("near"))


_TRACE = EV + ", k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)-1 AS i, t/1e6 AS s, event_type, value, event_id FROM ev)"


def _imported(spark, d):
    """Traces as JSON documents, one per user, and what the import makes of them."""
    from ..sources.traces import import_traces

    sample = lambda x: F.struct((x.t / 1e6).alias("time_s"), F.create_map(x.event_type, x.value).alias("positions"))
    touch = lambda x: F.struct((x.t / 1e6).alias("time_s"), F.lit("tool").alias("body_a"), F.lit("part").alias("body_b"), (x.event_type == "click").alias("active"), (x.value / 10).alias("normal_force_n"))
    rows = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type", "value"))).alias("e"))
    u = F.col("user_id")
    doc = F.struct(F.concat(F.lit("run"), u).alias("run_id"), F.struct(F.when(u % 4 == 0, "MuJoCo 3").otherwise("ManiSkill-x").alias("name")).alias("simulator"), F.when(u % 10 != 0, 0.5).alias("timestep_s"), F.struct(F.transform("e", sample).alias("joint_state"), F.transform("e", touch).alias("contact")).alias("samples"), F.when(u % 6 == 0, 1).alias("is_success"))
    return import_traces(rows.select(F.when(u % 9 == 0, "{broken").otherwise(F.to_json(doc)).alias("raw")), "maniskill")


_GOOD = "user_id%9<>0 AND user_id%6<>0 AND user_id%10<>0 AND user_id%4<>0"


@query(_TRACE + f" SELECT 'run'||user_id AS run_id, i::BIGINT AS sample_index, s AS time_s, event_type AS joint_id, value AS position FROM k WHERE {_GOOD}")
def trace_import(spark, d):
    return _imported(spark, d)[1]["joint_state"].select("run_id", F.col("sample_index").cast("long").alias("sample_index"), "time_s", "joint_id", "position")


@query(_TRACE + f" SELECT 'run'||user_id AS run_id, min(s) AS start_s, max(s) AS end_s, count(*) AS n_contacts, count(*) FILTER (event_type='click') AS n_active FROM k WHERE {_GOOD} GROUP BY ALL")
def trace_runs(spark, d):
    runs, tables, _, _ = _imported(spark, d)
    c = tables["contact"].groupBy("run_id").agg(F.count("*").alias("n_contacts"), F.count_if("active").alias("n_active"))
    return runs.select("run_id", "start_s", "end_s").join(c, "run_id")


@query("WITH u AS (SELECT DISTINCT user_id FROM events), w AS (SELECT CASE WHEN user_id%9=0 THEN 'syntax' WHEN user_id%6=0 THEN 'label' WHEN user_id%10=0 THEN 'timestep' WHEN user_id%4=0 THEN 'simulator' END AS why FROM u) SELECT why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY ALL")
def trace_rejections(spark, d):
    return _imported(spark, d)[3].groupBy("why").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT event_id, value, event_id%5=0 AS label, event_id%7=0 AS broken, event_id%11=0 AS late FROM events) SELECT event_id::BIGINT AS event_id, value FROM l WHERE NOT label AND NOT broken AND NOT late")
def event_log_scan(spark, d):
    """Event logs as JSON lines in the shared folder: lines with labels, bad syntax or bad times are set aside."""
    from ..sources.traces import read_events

    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.to_json(F.struct(F.lit(1.0).alias("time_s"), F.lit("x").alias("type"), F.lit(1).alias("Oracle")))).when(i % 7 == 0, '{"time_s": ').when(i % 11 == 0, '{"time_s": -1, "type": "x"}').otherwise(F.to_json(F.struct(F.lit(2.0).alias("time_s"), F.lit("x").alias("type"), i.alias("event_id"), "value")))
    at = f"{shared_folder(spark)}/attest-log-{uuid.uuid4().hex}"
    events(spark, d).select(line.alias("value")).write.text(at)
    good, _ = read_events(spark, at)
    return good.select(F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), F.get_json_object("raw", "$.value").cast("double").alias("value"))


