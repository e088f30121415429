"""Queries of the articulated-model operators: customers of a nation, dealt by five, are the links of a planar robot."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import models as M
from .registry import EV, events, micro, query, table

_ROBOT = """WITH RECURSIVE b AS (SELECT 'r'||c_nationkey||'_'||c_custkey%5 AS robot, row_number() OVER (PARTITION BY c_nationkey, c_custkey%5 ORDER BY c_custkey)-1 AS i, c_custkey AS k, 1.0::DOUBLE + c_acctbal/10000.0::DOUBLE AS dx FROM customer),
j AS (SELECT *, i%3 AS kind, i%3<>2 AND i%6>=3 AS mimic, CASE WHEN i%6>=3 THEN i-3 ELSE i END AS di, CASE i%3 WHEN 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS lo, CASE i%3 WHEN 0 THEN 1.0+(k%5)/10.0 ELSE 0.5 END::DOUBLE AS hi FROM b),
v AS (SELECT *, (di%7)/10.0::DOUBLE-0.2 AS given FROM j),
q AS (SELECT *, CASE WHEN kind=2 THEN 0.0 WHEN mimic THEN 0.5*given+0.1 ELSE given END AS q FROM v)"""


def _joints(spark, d):
    i = F.row_number().over(W.partitionBy("c_nationkey", F.col("c_custkey") % 5).orderBy("c_custkey")) - 1
    c = table(spark, d, "customer").withColumn("i", i.cast("long"))
    lit = lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    turn, slide = F.col("i") % 3 == 0, F.col("i") % 3 == 1
    mimic = (F.col("i") % 3 != 2) & (F.col("i") % 6 >= 3)
    return c.select(
        F.concat(F.lit("r"), F.col("c_nationkey"), F.lit("_"), F.col("c_custkey") % 5).alias("robot"), "i", F.col("c_custkey").alias("k"),
        F.concat(F.lit("j"), F.col("i")).alias("joint"), F.when(F.col("i") == 0, "base").otherwise(F.concat(F.lit("l"), F.col("i") - 1)).alias("parent"), F.concat(F.lit("l"), F.col("i")).alias("child"),
        F.when(turn, "revolute").when(slide, "prismatic").otherwise("fixed").alias("type"), lit(1.0 + F.col("c_acctbal") / 10000.0, 0.5, 0.0).alias("xyz"), lit(0.0, 0.0, 0.0).alias("rpy"),
        F.when(slide, lit(1.0, 0.0, 0.0)).otherwise(lit(0.0, 0.0, 1.0)).alias("axis"), F.when(mimic, F.concat(F.lit("j"), F.col("i") - 3)).alias("mimic"), F.when(mimic, 0.5).alias("multiplier"), F.when(mimic, 0.1).alias("offset"),
        F.when(turn, -1.0).otherwise(0.0).alias("lower"), F.when(turn, 1.0 + (F.col("k") % 5) / 10.0).otherwise(0.5).alias("upper"),
    )


def _values(joints):
    return joints.where("type <> 'fixed' and mimic is null").select("robot", "joint", ((F.col("i") % 7) / 10.0 - 0.2).alias("value"))


@query(_ROBOT + " SELECT robot, 'j'||i AS joint, CASE WHEN kind<>2 THEN 'j'||di END AS driver, floor(q*1e6+0.5)/1e6 AS position, CASE WHEN kind<>2 AND (q < lo-1e-9 OR q > hi+1e-9) THEN 'outside_limits' ELSE 'ok' END AS state FROM q")
def pose_resolution(spark, d):
    j = _joints(spark, d)
    return M.resolve_pose(j, _values(j)).withColumn("position", micro(F.col("position")))


_ENDS = """, f AS (SELECT robot, di, max(CASE WHEN mimic THEN (lo-0.1)/0.5 ELSE lo END) AS lower, min(CASE WHEN mimic THEN (hi-0.1)/0.5 ELSE hi END) AS upper FROM j WHERE kind<>2 GROUP BY ALL),
s AS (SELECT v.robot, v.i, v.kind, given, lower, upper, unnest(['minus','plus']) AS direction, CASE kind WHEN 1 THEN 0.01 ELSE 0.1 END::DOUBLE AS step FROM v JOIN f ON f.robot=v.robot AND f.di=v.i WHERE kind<>2 AND NOT mimic),
r AS (SELECT *, CASE direction WHEN 'minus' THEN given-lower ELSE upper-given END AS room FROM s),
e AS (SELECT robot, i, direction, given AS baseline, CASE WHEN given < lower-1e-9 OR given > upper+1e-9 THEN 'baseline_outside' WHEN room <= 1e-9 THEN 'unavailable_at_limit' WHEN room >= step-1e-9 THEN 'nominal' ELSE 'clipped' END AS status, CASE WHEN given < lower-1e-9 OR given > upper+1e-9 OR room <= 1e-9 THEN 0.0 ELSE least(step,room)*CASE direction WHEN 'minus' THEN -1 ELSE 1 END END AS applied FROM r)"""


@query(_ROBOT + _ENDS + " SELECT robot, 'j'||i AS driver, direction, floor(applied*1e6+0.5)/1e6 AS applied, floor((baseline+applied)*1e6+0.5)/1e6 AS position, status FROM e")
def motion_counterfactuals(spark, d):
    j = _joints(spark, d)
    return M.counterfactuals(j, _values(j)).select("robot", "driver", "direction", micro(F.col("applied")).alias("applied"), micro(F.col("position")).alias("position"), "status")


_STEP = "x+cos(th)*q.dx-sin(th)*0.5 + CASE WHEN q.kind=1 THEN cos(th)*{q} ELSE 0 END, y+sin(th)*q.dx+cos(th)*0.5 + CASE WHEN q.kind=1 THEN sin(th)*{q} ELSE 0 END, th+CASE WHEN q.kind=0 THEN {q} ELSE 0 END"
_FK = ", w AS (SELECT DISTINCT robot, -1::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS th FROM q UNION ALL SELECT q.robot, q.i, " + _STEP.format(q="q.q") + " FROM w JOIN q ON q.robot=w.robot AND q.i=w.i+1)"
_MOVED = "(q.q + CASE WHEN q.kind<>2 AND q.di=m.di THEN m.applied*CASE WHEN q.mimic THEN 0.5 ELSE 1 END ELSE 0 END)"
_ATLAS = _ENDS + _FK + ", m AS (SELECT e.robot, e.i AS di, direction, -1::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS th, applied FROM e WHERE applied<>0 UNION ALL SELECT q.robot, m.di, direction, q.i, " + _STEP.format(q=_MOVED) + ", applied FROM m JOIN q ON q.robot=m.robot AND q.i=m.i+1), a AS (SELECT m.robot, 'j'||m.di AS driver, direction, CASE WHEN m.i < 0 THEN 'base' ELSE 'l'||m.i END AS link, sqrt((m.x-w.x)*(m.x-w.x)+(m.y-w.y)*(m.y-w.y)) AS moved, abs(m.th-w.th) AS turned, m.i >= m.di AS structural FROM m JOIN w ON w.robot=m.robot AND w.i=m.i)"


@query(_ROBOT + _ATLAS + " SELECT robot, driver, direction, link, floor(moved*1e6+0.5)/1e6 AS moved, floor(turned*1e5+0.5)/1e5 AS turned, moved > 1e-9 OR turned > 1e-9 AS changed, structural FROM a")
def motion_atlas(spark, d):
    j = _joints(spark, d)
    return M.motion_atlas(j, _values(j)).select("robot", "driver", "direction", "link", micro(F.col("moved")).alias("moved"), (F.floor(F.col("turned") * 1e5 + 0.5) / 1e5).alias("turned"), "changed", "structural")


@query(_ROBOT + _ATLAS + " SELECT robot, driver, direction, count(*) FILTER (moved > 1e-9 OR turned > 1e-9) AS n_changed, count(*) FILTER (structural) AS n_structural, count(*) FILTER ((moved > 1e-9 OR turned > 1e-9) AND NOT structural) AS changed_only, count(*) FILTER (structural AND NOT (moved > 1e-9 OR turned > 1e-9)) AS structural_only FROM a GROUP BY ALL")
def motion_causality(spark, d):
    j = _joints(spark, d)
    return M.causality(M.motion_atlas(j, _values(j)))


@query(_ROBOT + _FK + " SELECT robot, CASE WHEN i < 0 THEN 'base' ELSE 'l'||i END AS frame, floor(x*1e6+0.5)/1e6 AS x, floor(y*1e6+0.5)/1e6 AS y FROM w")
def articulation_frames(spark, d):
    """The frames that a robot's grammar gives at its values."""
    j = _joints(spark, d)
    out = M.evaluate_grammar(*M.grammar(j), _values(j))
    return out.select("robot", "frame", micro(F.col("world")[3]).alias("x"), micro(F.col("world")[7]).alias("y"))


@query(_ROBOT + ", f AS (SELECT robot, -1::BIGINT AS f FROM q GROUP BY ALL UNION ALL SELECT robot, i FROM q) SELECT f.robot, CASE WHEN f < 0 THEN 'base' ELSE 'l'||f END AS frame, count(q.i) AS n_operators, coalesce(array_to_string(list_sort(list(DISTINCT 'j'||di) FILTER (kind<>2)), ','), '') AS dependencies FROM f LEFT JOIN q ON q.robot=f.robot AND q.i<=f GROUP BY f.robot, f")
def articulation_derivations(spark, d):
    out = M.derived(*M.grammar(_joints(spark, d)))
    return out.select("robot", "frame", "n_operators", F.array_join("dependencies", ",").alias("dependencies"))


_OTHER = ", w2 AS (SELECT DISTINCT robot, -1::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS th FROM p UNION ALL SELECT q.robot, q.i, " + _STEP.format(q="q.q") + " FROM w2 w JOIN p q ON q.robot=w.robot AND q.i=w.i+1)"


@query(_ROBOT + ", p AS (SELECT * REPLACE (CASE WHEN i%11=4 AND k%2=0 THEN dx+0.001 ELSE dx END AS dx) FROM q)" + _FK + _OTHER + """, z AS (SELECT w.robot, max(greatest(abs(w.x-w2.x),abs(w.y-w2.y))) AS e FROM w JOIN w2 ON w.robot=w2.robot AND w.i=w2.i GROUP BY ALL),
o AS (SELECT robot, count(*) FILTER (i%11=4 AND k%2=0) AS n, min('j'||i) FILTER (i%11=4 AND k%2=0) AS f FROM q GROUP BY ALL) SELECT robot, n AS operators_differ, f AS first_operator, 0::BIGINT AS derivations_differ, floor(e*1e6+0.5)/1e6 AS probe_error, n=0 AS equal FROM o JOIN z USING (robot)""")
def articulation_compare(spark, d):
    """Each robot's grammar against that of a version in which some links are a millimetre longer."""
    j = _joints(spark, d)
    longer = (F.col("i") % 11 == 4) & (F.col("k") % 2 == 0)
    other = j.withColumn("xyz", F.when(longer, F.array(F.col("xyz")[0] + 0.001, F.col("xyz")[1], F.col("xyz")[2])).otherwise(F.col("xyz")))
    out = M.compare_grammars(M.grammar(j), M.grammar(other), _values(j))
    return out.select("robot", "operators_differ", "first_operator", "derivations_differ", micro(F.col("probe_error")).alias("probe_error"), "equal")


# Edits: a robot's links as a heap-shaped tree, and five operations on each.

_HEAP = _ROBOT + """, h AS (SELECT robot, i, count(*) OVER (PARTITION BY robot) AS n, robot LIKE '%0\\_%' ESCAPE '\\' AS held FROM b),
s4 AS (SELECT 4::BIGINT AS i UNION ALL SELECT unnest([2*i+1, 2*i+2]) FROM s4 WHERE i < 100000),
k AS (SELECT DISTINCT robot, n, held FROM h)"""
_FIVE = "n >= 6 AND n <= 11 AND NOT held"


def _edited(spark, d):
    j = _joints(spark, d)
    parent = F.when(F.col("i") > 0, F.concat(F.lit("l"), F.floor((F.col("i") - 1) / 2)))
    edges = j.select("robot", "child", parent.alias("parent"))
    todo = spark.createDataFrame([(1, "add_leaf", "new", "l1", None), (2, "remove_subtree", "l4", None, "l1"), (3, "reparent", "l2", "l1", "l0"), (4, "reparent", "l1", "l2", "l0"), (5, "remove_leaf", "l5", None, "l2")], "position int, type string, link string, parent string, expected_parent string")
    robots = j.select("robot").distinct()
    ops = robots.crossJoin(F.broadcast(todo))  # five operations for each robot
    return M.apply_edits(edges, ops, robots.where("robot like '%0\\\\_%'").select("robot", F.lit(None).cast("string").alias("place"), F.lit("l5").alias("name")))


@query(_HEAP + f"""SELECT robot, 'l'||i AS child, CASE WHEN i=0 THEN NULL WHEN i=2 THEN 'l1' ELSE 'l'||((i-1)//2) END AS parent FROM h WHERE i NOT IN (SELECT i FROM s4) AND NOT (i=5 AND {_FIVE})
UNION ALL SELECT robot, 'new', 'l1' FROM k WHERE n >= 2""".replace("SELECT robot, 'l'", " SELECT robot, 'l'", 1))
def graph_edits(spark, d):
    return _edited(spark, d)[0]


@query(_HEAP + f""", r AS (SELECT robot, n, held, unnest([1,2,3,4,5]) AS position FROM k)
SELECT robot, position::INT AS position, CASE position WHEN 1 THEN CASE WHEN n >= 2 THEN 'applied' ELSE 'unknown_parent' END WHEN 2 THEN CASE WHEN n >= 5 THEN 'applied' ELSE 'unknown_link' END
WHEN 3 THEN CASE WHEN n >= 3 THEN 'applied' ELSE 'unknown_link' END WHEN 4 THEN CASE WHEN n >= 3 THEN 'into_itself' WHEN n=2 THEN 'unknown_parent' ELSE 'unknown_link' END
ELSE CASE WHEN n < 6 THEN 'unknown_link' WHEN n > 11 THEN 'not_a_leaf' WHEN held THEN 'referenced' ELSE 'applied' END END AS result FROM r""")
def graph_edit_reports(spark, d):
    return _edited(spark, d)[1].select("robot", "position", "result")


@query(EV + """, e AS (SELECT user_id AS robot, event_type AS op, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM ev)
SELECT robot, op, 'several_parents' AS issue FROM e WHERE n > 1 AND event_id%77=0 GROUP BY ALL UNION ALL SELECT robot, op, 'several_attachments' FROM e GROUP BY ALL HAVING count(*) FILTER (n=1 OR event_id%50=0 OR event_id%77=0) > 1
UNION ALL SELECT robot, op, 'other_attachment' FROM e GROUP BY ALL HAVING count(*) FILTER (n > 1 AND event_id%50=0 AND event_id%77<>0) > 0 OR count(*) FILTER (n > 1 AND event_id%77=0) > 0""")
def subtree_validation(spark, d):
    """New subtrees: a chain of events, some attached twice and some elsewhere."""
    w = W.partitionBy("user_id", "event_type").orderBy("event_id")
    e = events(spark, d).select(F.col("user_id").alias("robot"), F.col("event_type").alias("op"), F.col("event_id").cast("string").alias("child"), "event_id", F.lag("event_id").over(w).cast("string").alias("p"))
    first = F.col("p").isNull()
    edges = e.select("robot", "op", "child", F.when(first, "arm").when((F.col("event_id") % 50 == 0) & (F.col("event_id") % 77 != 0), "table").otherwise(F.col("p")).alias("parent"))
    again = e.where(~first & (F.col("event_id") % 77 == 0)).select("robot", "op", "child", F.lit("table").alias("parent"))
    return M.subtree_issues(edges.unionByName(again), e.where(first).select("robot", "op", F.col("child").alias("root"), F.lit("arm").alias("parent")))


_TYPES = list(M.ASSERTION_TYPES) + ["no_such_type"]
_NUM = f"""WITH t AS (SELECT {_TYPES!r}::VARCHAR[] AS names), a AS (SELECT c_custkey AS id, names[1 + c_custkey%{len(_TYPES)}] AS type, c_acctbal/10000.0::DOUBLE AS u, (c_nationkey%7)/100.0::DOUBLE AS off, c_custkey%23=0 AS gone, c_custkey%29=0 AS negative, c_nationkey%3 AS kind FROM customer, t),
m AS (SELECT *, type IN {tuple(M.VECTOR_TYPES)} AS vec, type IN {tuple(M.POSE_TYPES)} AS pose, type IN {tuple(M.DIRECTION_TYPES)} AS dir, type IN {tuple(M.SET_TYPES)} AS sets, type IN {tuple(M.SEQUENCE_TYPES)} AS seq FROM a)""".replace("('joint_axis',)", "('joint_axis')").replace("('chain',)", "('chain')")


@query(_NUM + """, r AS (SELECT *, degrees(2*acos(least(1.0, abs(cos(off/2))))) AS spin, degrees(acos(least(1.0,(1.0)/sqrt(1.0+off*off)))) AS way FROM m)
SELECT id AS assertion_id, type, CASE WHEN type='no_such_type' OR gone OR negative THEN 'error' WHEN vec THEN CASE WHEN (u+off)-u <= 0.035 THEN 'passed' ELSE 'failed' END WHEN pose THEN CASE WHEN sqrt(((u+off)-u)*((u+off)-u)) <= 0.045 AND spin <= 2.0 THEN 'passed' ELSE 'failed' END WHEN dir THEN CASE WHEN way <= 1.5 THEN 'passed' ELSE 'failed' END
WHEN sets THEN CASE WHEN kind<2 THEN 'passed' ELSE 'failed' END WHEN seq THEN CASE WHEN kind=0 THEN 'passed' ELSE 'failed' END ELSE CASE WHEN kind=0 THEN 'passed' ELSE 'failed' END END AS result FROM r""")
def invariant_assertions(spark, d):
    """All types of assertions, with what was measured off by known amounts; some not measured, some ill-formed."""
    c = table(spark, d, "customer")
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    u, off, part = F.col("c_acctbal") / 10000.0, (F.col("c_nationkey") % 7) / 100.0, F.col("c_nationkey") % 3
    kind = F.element_at(kinds, (F.col("c_custkey") % len(_TYPES) + 1).cast("int"))
    base = c.select(F.col("c_custkey").alias("id"), kind.alias("type"), u.alias("u"), off.alias("off"), part.alias("part"))
    pose, way, vector = F.col("type").isin(*M.POSE_TYPES), F.col("type").isin(*M.DIRECTION_TYPES), F.col("type").isin(*M.VECTOR_TYPES)
    zero, one = F.lit(0.0), F.lit(1.0)
    want = F.when(pose, F.array("u", zero, one, zero, zero, zero, one)).when(way, F.array(one, zero, zero)).when(vector, F.array("u", one))
    got = F.when(pose, F.array(F.col("u") + F.col("off"), zero, one, zero, zero, -F.sin(F.col("off") / 2), -F.cos(F.col("off") / 2))).when(way, F.array(one, F.col("off"), zero)).when(vector, F.array(F.col("u") + F.col("off"), one))
    sets = F.col("type").isin(*M.SET_TYPES, *M.SEQUENCE_TYPES)
    names = F.when(sets, F.array(F.lit("a"), F.lit("b"))).when(~(pose | way | vector), F.array(F.lit("free")))
    found = F.when(sets, F.when(F.col("part") == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("part") == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("c")))).when(~(pose | way | vector), F.when(F.col("part") == 0, F.array(F.lit("free"))).otherwise(F.array(F.lit("collision"))))
    tolerance = F.when(F.col("id") % 29 == 0, -1.0).when(vector, 0.035).otherwise(0.045)
    a = base.select(F.col("id").alias("assertion_id"), "type", F.col("id").cast("string").alias("subject"), want.alias("numbers"), names.alias("names"), tolerance.alias("tolerance"), F.when(way, 1.5).otherwise(2.0).alias("angle_tolerance"))
    m = base.where("id % 23 <> 0").select("type", F.col("id").cast("string").alias("subject"), got.alias("numbers"), found.alias("names"))
    return M.verify_invariants(a, m).select("assertion_id", "type", "result")
