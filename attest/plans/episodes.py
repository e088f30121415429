"""Queries of the task predicates: every user is a run, every event a sample of all channels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import predicates as P
from .registry import EV, events, query
from .streams import START
from .task import Task, evaluate, results

SPAN, STEP = 29 * 86400.0, 86400.0
AGE = 2.5 * STEP

# The channels in SQL. Quaternions turn about z: by 0.4 rad times event_id % 4 (tool) and % 3 (part).
_K = EV + f""", k AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)-1 AS i, (t-{START})::DOUBLE/1e6 AS s, event_type, value, event_id, value/100.0::DOUBLE AS x, (event_id%7)/10.0::DOUBLE AS y, value/50.0::DOUBLE AS z, ((event_id%5)-2)/50.0::DOUBLE AS dx, 0.4::DOUBLE*(event_id%4) AS turn, 0.4::DOUBLE*(event_id%3) AS part_turn FROM ev),
n AS (SELECT * FROM k WHERE s BETWEEN 0 AND {SPAN}), r AS (SELECT DISTINCT run_id, run_id%29=0 AS missing, run_id%13=0 AS conflicting, run_id%7=0 AS incomplete FROM k),
l AS (SELECT *, {SPAN}-s > {AGE} AS stale FROM n QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i DESC)=1)"""


def _guard(judged: str, continuous: bool = False, late: dict[str, str] | None = None, name: str = "") -> str:
    """SQL of Episode.guarded over a select of run_id, judged, why."""
    cases = [("missing", "unknown", "channel_missing"), ("conflicting", "conflicting", "channel_conflicting")]
    if continuous:
        cases.append(("incomplete", "unknown", "channel_incomplete"))
    cases += [(f"incomplete AND judged='{s}'", "unknown", why) for s, why in (late or {}).items()]
    status = " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in cases)
    reason = " ".join(f"WHEN {c} THEN '{w}'" for c, _, w in cases)
    out = f"SELECT run_id, CASE {status} ELSE coalesce(judged,'unknown') END AS status, CASE {reason} WHEN judged IS NULL THEN 'no_evidence' ELSE coalesce(why,'observed') END AS reason FROM r LEFT JOIN j{name} USING (run_id)"
    return f", j{name} AS ({judged})" + (f", g{name} AS ({out})" if name else " " + out)


def _last(ok: str, extra: str = "l") -> str:
    return f"SELECT run_id, CASE WHEN stale THEN 'unknown' WHEN {ok} THEN 'supported' WHEN NOT ({ok}) THEN 'refuted' ELSE 'unknown' END AS judged, CASE WHEN stale THEN 'stale' END AS why FROM {extra}"


def _runs_of(ok: str, least: float, rows: str = "n", name: str = "") -> str:
    """SQL of a sustained predicate: the longest run of rows that are ok."""
    return f""", m{name} AS (SELECT run_id, s, sum(CASE WHEN coalesce({ok},false) THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY i) AS island, coalesce({ok},false) AS ok FROM {rows}),
d{name} AS (SELECT run_id, coalesce(max(len),0) >= {least} AS long FROM (SELECT run_id, island, CASE WHEN bool_or(ok) THEN max(s) FILTER (ok) - min(s) FILTER (ok) END AS len FROM m{name} GROUP BY ALL) GROUP BY ALL),
o{name} AS (SELECT run_id, bool_or(ok) AS was FROM m{name} GROUP BY ALL)"""


def _sustained(name: str = "") -> str:
    return f"SELECT run_id, CASE WHEN was AND long THEN 'supported' ELSE 'refuted' END AS judged, NULL AS why FROM d{name} JOIN o{name} USING (run_id)"


def episode(spark, d: str) -> P.Episode:
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    k = events(spark, d).select(F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).alias("sample_index"), ((F.col("t") - START).cast("double") / 1e6).alias("time_s"), "event_type", "value", "event_id")
    num = lambda c: F.lit(c).cast("double") if not isinstance(c, str) else F.expr(c).cast("double")
    vec = lambda *c: F.array(*[num(x) for x in c])
    about_z = lambda n: F.array(F.lit(0.0), F.lit(0.0), F.sin(0.4 * (F.col("event_id") % n) / 2), F.cos(0.4 * (F.col("event_id") % n) / 2))
    x, y, z, dx = "value / 100D", "(event_id % 7) / 10D", "value / 50D", "((event_id % 5) - 2) / 50D"
    head = ["run_id", "sample_index", "time_s"]
    still = [vec("value / 100D", 0.1, 0).alias("linear_velocity"), vec(0, 0, "(event_id % 9) / 10D").alias("angular_velocity")]
    entity = lambda name, p, q: F.struct(F.lit(name).alias("entity_id"), p.alias("position"), q.alias("quaternion"), *still)
    tool, part = entity("tool", vec(x, y, z), about_z(4)), entity("part", vec(f"{x} + {dx}", y, f"{z} + 0.05D"), about_z(3))
    points = F.array(*[F.when((F.col("event_id") + j) % 6 > 0, vec(x, j / 4, 0)) for j in range(4)])
    odd = F.col("event_id") % 2 == 1
    bodies = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("arm"), F.lit("table"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("tool"), F.lit("part"))).otherwise(F.array(F.lit("part"), F.lit("tool")))
    tables = {
        "joint_state": k.select(*head, F.col("event_type").alias("joint_id"), F.col("value").alias("position"), (F.col("value") - 50.0).alias("velocity"), F.lit(None).cast("double").alias("effort")),
        "pose": k.select(*head, F.explode(F.array(tool, part)).alias("e")).select(*head, "e.*"),
        "odometry": k.select(*head, entity("base", vec(x, 0.2, 0), about_z(4)).alias("e")).select(*head, "e.*"),
        "contact": k.select(*head, F.when(odd, "tool").otherwise("part").alias("body_a"), F.when(odd, "part").otherwise("tool").alias("body_b"), F.col("event_type").isin("click", "purchase", "view").alias("active"), F.when(F.col("event_id") % 11 > 0, F.col("value") / 10).alias("normal_force_n"), vec("(event_id % 5) - 2", 1, 3).alias("force_n")),
        "collision": k.select(*head, bodies[0].alias("body_a"), bodies[1].alias("body_b"), (F.col("value") > 150).alias("active")),
        "deformable": k.select(*head, F.lit("cloth").alias("entity_id"), points.alias("keypoints")),
    }
    runs = k.select("run_id").distinct().select("run_id", F.lit(0.0).alias("start_s"), F.lit(SPAN).alias("end_s"), F.lit(STEP).alias("timestep_s"), F.create_map(F.lit("level"), 0.2 + (F.col("run_id") % 5) / 10.0).alias("measurements"))
    flags = runs.select("run_id", F.explode(F.array(*[F.lit(c) for c in tables])).alias("channel"), (F.col("run_id") % 13 == 0).alias("conflicting"), (F.col("run_id") % 7 == 0).alias("incomplete"), (F.col("run_id") % 29 == 0).alias("missing"))
    return P.Episode(runs, tables, {"hand": "tool", "object": "part"}, flags)


def _leaf(name: str, spec: dict, sql: str) -> None:
    def f(spark, d):
        return P.LEAVES[name](episode(spark, d), spec).select("run_id", "status", "reason")

    f.__name__ = f"predicate_{name}"
    query(sql)(f)


def _joint_last(kinds: str, ok: str, n: int, age: float) -> str:
    return f""", c AS (SELECT *, {SPAN}-s > {age} AS old FROM n WHERE event_type IN ({kinds}) QUALIFY row_number() OVER (PARTITION BY run_id, event_type ORDER BY i DESC)=1)""" + _guard(f"SELECT run_id, CASE WHEN bool_or(old) THEN 'unknown' WHEN count(*)={n} THEN CASE WHEN bool_and({ok}) THEN 'supported' ELSE 'refuted' END ELSE 'unknown' END AS judged, CASE WHEN bool_or(old) THEN 'stale' END AS why FROM c GROUP BY run_id")


_leaf("joint_within_tolerance", {"targets": {"view": 50.0, "click": 60.0}, "tolerance": 45.0, "max_age_s": 500000.0}, _K + _joint_last("'view','click'", "abs(value - CASE event_type WHEN 'view' THEN 50.0 ELSE 60.0 END) <= 45.0", 2, 500000.0))
_leaf("joint_position_in_range", {"ranges": {"purchase": (5.0, 60.0)}, "max_age_s": 900000.0}, _K + _joint_last("'purchase'", "value BETWEEN 5 AND 60", 1, 900000.0))
_leaf("joint_velocity_below_threshold", {"joints": ["signup"], "maximum": 30.0}, _K + _joint_last("'signup'", "abs(value-50.0) <= 30.0", 1, AGE))
# the part from the tool: (dx, 0, 0.05)
_leaf("frame_within_pose_tolerance", {"entity": "hand", "reference": "object", "position_tolerance": 0.06, "rotation_tolerance": 0.5}, _K + _guard(_last("sqrt(dx*dx + 0.05::DOUBLE*0.05::DOUBLE) <= 0.06 AND abs(turn-part_turn) <= 0.5")))
_leaf("base_reached_goal", {"entity": "base", "position": [0.4, 0.2, 0.0], "position_tolerance": 0.3}, _K + _guard(_last("abs(x-0.4) <= 0.3")))
_leaf("frame_position_within_tolerance", {"entity": "hand", "position": [0.4, 0.3, 9.0], "axes": "xy", "tolerance": 0.35, "exclusive": True}, _K + _guard(_last("sqrt((x-0.4)*(x-0.4)+(y-0.3)*(y-0.3)) < 0.35")))
_leaf("frame_position_in_bounds", {"entity": "hand", "bounds": {"x": {"minimum": 0.05, "maximum": {"measurement": "level", "scale": 2.0, "offset": 0.1}}, "y": {"maximum": 0.55, "inclusive": False}}}, _K + _guard(_last("x >= 0.05 AND x <= (0.2::DOUBLE + (run_id%5)/10.0::DOUBLE)*2.0 + 0.1 AND y < 0.55")))
_leaf("frame_velocity_below_threshold", {"entity": "hand", "linear": 0.6, "angular": 0.55}, _K + _guard(_last("sqrt(x*x + 0.1::DOUBLE*0.1::DOUBLE) <= 0.6 AND (event_id%9)/10.0::DOUBLE <= 0.55")))
_leaf("collision_free_over_interval", {"allowed": [["part", "tool"]]}, _K + _guard("SELECT r.run_id, CASE WHEN count(n.i) FILTER (value > 150 AND event_id%3=0) > 0 THEN 'refuted' ELSE 'supported' END AS judged, NULL AS why FROM r LEFT JOIN n USING (run_id) GROUP BY ALL", late={"supported": "channel_incomplete"}))
_TOUCH = "event_type IN ('click','purchase','view')"
_leaf("contact_sustained", {"body_a": "object", "body_b": "hand", "minimum_force_n": 1.0, "minimum_duration_s": 200000.0}, _K + _runs_of(f"{_TOUCH} AND event_id%11 > 0 AND value/10 >= 1.0", 200000.0) + _guard(f"SELECT run_id, CASE WHEN x.judged='refuted' AND b THEN 'unknown' ELSE x.judged END AS judged, CASE WHEN x.judged='refuted' AND b THEN 'force_missing' END AS why FROM ({_sustained()}) x JOIN (SELECT run_id, bool_or({_TOUCH} AND event_id%11=0) AS b FROM n GROUP BY ALL) USING (run_id)", late={"refuted": "channel_incomplete"}))
_FX, _FY = "((event_id%5)-2)", "1.0::DOUBLE"
_leaf("contact_force_at_terminal", {"body_a": "hand", "body_b": "object", "minimum_force_n": 0.5, "axis": [0.0, 2.0, 0.0], "reference": "hand", "cone_rad": 1.25}, _K + _guard(_last(f"{_TOUCH} AND CASE WHEN event_id%11 > 0 THEN value/10 END >= 0.5 AND acos(({_FX}*-sin(turn) + {_FY}*cos(turn))/sqrt({_FX}*{_FX}+10.0)) <= 1.25").replace(f"WHEN {_TOUCH} AND", f"WHEN NOT {_TOUCH} THEN 'refuted' WHEN {_TOUCH} AND", 1)))
_leaf("object_above_height", {"entity": "object", "delta_m": {"measurement": "level", "scale": 0.5}, "minimum_duration_s": 60000.0}, _K + ", f AS (SELECT run_id, arg_min(z+0.05::DOUBLE, i) AS z0 FROM k GROUP BY ALL), nf AS (SELECT n.*, z0 FROM n JOIN f USING (run_id))" + _runs_of("z+0.05::DOUBLE-z0 >= (0.2::DOUBLE + (run_id%5)/10.0::DOUBLE)*0.5", 60000.0, "nf") + _guard(_sustained(), late={"refuted": "channel_incomplete"}))
_leaf("object_inside_region", {"entity": "object", "region": {"type": "aabb", "minimum": [0.0, 0.0, 0.0], "maximum": [0.6, 0.45, 2.0]}, "minimum_duration_s": 120000.0}, _K + _runs_of("x+dx BETWEEN 0 AND 0.6 AND y BETWEEN 0 AND 0.45 AND z+0.05::DOUBLE BETWEEN 0 AND 2", 120000.0) + _guard(_sustained(), late={"refuted": "channel_incomplete"}))
# the part in the tool's frame, and what it turns against it; from every row up to the first that strays
_leaf("object_follows_frame_for_duration", {"entity": "object", "frame": "hand", "position_tolerance": 0.045, "rotation_tolerance": 0.9, "minimum_duration_s": 270000.0}, _K + """, p AS (SELECT run_id, i, s, dx*cos(turn) AS px, -dx*sin(turn) AS py, part_turn-turn AS a FROM n),
b AS (SELECT a.run_id, a.i, min(b.i) AS stop FROM p a JOIN p b ON a.run_id=b.run_id AND b.i > a.i AND NOT (sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)) <= 0.045 AND abs(a.a-b.a) <= 0.9) GROUP BY ALL),
e AS (SELECT p.run_id, p.s, coalesce(b.stop, (SELECT max(i)+1 FROM p q WHERE q.run_id=p.run_id)) - 1 AS last FROM p LEFT JOIN b ON b.run_id=p.run_id AND b.i=p.i),
h AS (SELECT e.run_id, max(p.s-e.s) AS d FROM e JOIN p ON p.run_id=e.run_id AND p.i=e.last GROUP BY ALL)""" + _guard("SELECT run_id, CASE WHEN d >= 270000.0 THEN 'supported' ELSE 'refuted' END AS judged, NULL AS why FROM h", continuous=True))
_leaf("path_stayed_within_corridor", {"entity": "hand", "corridor": {"type": "polyline", "points": [[0.0, 0.3], [2.0, 0.3]], "radius": 0.5}}, _K + _guard("SELECT run_id, CASE WHEN bool_and(sqrt(power(x-least(2.0,greatest(0.0,x)),2) + power(y-0.3,2)) <= 0.5) THEN 'supported' ELSE 'refuted' END AS judged, NULL AS why FROM n GROUP BY ALL", continuous=True))
_leaf("inserted_to_depth", {"entity": "object", "reference": "hand", "axis": [0.0, 0.0, 2.0], "minimum_depth_m": 0.03, "lateral_tolerance_m": 0.03}, _K + _guard(_last("abs(dx) <= 0.03")))
_THERE = "((event_id+{j})%6 > 0)::INT"
_INSIDE = " + ".join(f"((event_id+{j})%6 > 0 AND sqrt((x-0.5)*(x-0.5)+({j / 4}-0.25)*({j / 4}-0.25)) <= 0.4)::INT" for j in range(4))
_leaf("deformable_keypoints_in_region", {"entity": "cloth", "region": {"type": "sphere", "center": [0.5, 0.25, 0.0], "radius": 0.4}, "minimum_fraction": 0.6, "minimum_duration_s": 150000.0}, _K + _runs_of(f"({_INSIDE})::DOUBLE/({' + '.join(_THERE.format(j=j) for j in range(4))}) >= 0.6", 150000.0) + _guard(_sustained(), continuous=True))
_POINT = " AND ".join(f"(event_id+{j})%6 > 0" for j in range(4))
_leaf("deformable_shape_within_tolerance", {"entity": "cloth", "expected": [[0.4, j / 4, 0.0] for j in range(4)], "rmse_tolerance_m": 0.25, "maximum_tolerance_m": 0.3}, _K + _guard(_last(f"(CASE WHEN {_POINT} THEN abs(x-0.4) <= 0.25 END) AND abs(x-0.4) <= 0.3")))


TASK = Task("stream", [
    {"id": "touch", "type": "contact_sustained", "body_a": "hand", "body_b": "object", "minimum_force_n": 1.0, "minimum_duration_s": 200000.0},
    {"id": "near", "type": "inserted_to_depth", "entity": "object", "reference": "hand", "axis": [0.0, 0.0, 2.0], "minimum_depth_m": 0.03, "lateral_tolerance_m": 0.03},
    {"id": "inside", "type": "object_inside_region", "entity": "object", "region": {"type": "aabb", "minimum": [0.0, 0.0, 0.0], "maximum": [0.6, 0.45, 2.0]}, "minimum_duration_s": 120000.0},
    {"id": "grasped", "type": "object_grasped", "contacts": ["touch"], "follows": "near", "lifted": "inside"},
    {"id": "released", "type": "object_released_in_region", "inside": "inside", "contact": "touch"},
    {"id": "joint", "type": "evidence_conjunction", "predicates": ["grasped", "near"]},
], {"any": [{"predicate": "joint"}, {"predicate": "released"}]}, {"not": {"predicate": "inside"}}, {"hand": "tool", "object": "part"})


def _first(order: list[str], names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN '{s}' IN ({','.join(names)}) THEN '{s}'" for s in order[:-1]) + f" ELSE '{order[-1]}' END"


def _task_sql() -> str:
    from ..functions import status as S

    touch = _runs_of(f"{_TOUCH} AND event_id%11 > 0 AND value/10 >= 1.0", 200000.0, name="t") + _guard(f"SELECT run_id, CASE WHEN x.judged='refuted' AND b THEN 'unknown' ELSE x.judged END AS judged, CASE WHEN x.judged='refuted' AND b THEN 'force_missing' END AS why FROM ({_sustained('t')}) x JOIN (SELECT run_id, bool_or({_TOUCH} AND event_id%11=0) AS b FROM n GROUP BY ALL) USING (run_id)", late={"refuted": "channel_incomplete"}, name="t")
    near = _guard(_last("abs(dx) <= 0.03"), name="n")
    inside = _runs_of("x+dx BETWEEN 0 AND 0.6 AND y BETWEEN 0 AND 0.45 AND z+0.05::DOUBLE BETWEEN 0 AND 2", 120000.0, name="i") + _guard(_sustained("i"), late={"refuted": "channel_incomplete"}, name="i")
    base = ", w AS (SELECT gt.run_id, gt.status AS touch, gn.status AS near, gi.status AS inside FROM gt JOIN gn USING (run_id) JOIN gi USING (run_id))"
    up = f", v AS (SELECT *, {_first(list(S.GRASP), ['touch', 'near', 'inside'])} AS grasped, CASE WHEN 'conflicting' IN (inside,touch) THEN 'conflicting' WHEN inside='refuted' OR touch='supported' THEN 'refuted' WHEN 'unknown' IN (inside,touch) THEN 'unknown' ELSE 'supported' END AS released FROM w)"
    top = f", u AS (SELECT *, {_first(list(S.ALL), ['grasped', 'near'])} AS joint FROM v)"
    return touch + near + inside + base + up + top


@query(_K + _task_sql() + " SELECT run_id, touch, near, inside, grasped, released, joint FROM u")
def task_predicates(spark, d):
    """Leaves, grasp, release and conjunction of one task over all runs."""
    return evaluate(TASK, episode(spark, d)).select("run_id", *[p["id"] for p in TASK.predicates])


@query(_K + _task_sql() + " SELECT run_id, unnest(['grasped','released','joint']) AS predicate_id, unnest(['object_grasped','object_released_in_region','evidence_conjunction']) AS type, unnest([grasped, released, joint]) AS status FROM u")
def task_results(spark, d):
    ep = episode(spark, d)
    return results(evaluate(TASK, ep), TASK).where(F.col("type").isin("object_grasped", "object_released_in_region", "evidence_conjunction"))


@query(_K + _task_sql() + """, q AS (SELECT run_id, CASE inside WHEN 'supported' THEN 'refuted' WHEN 'refuted' THEN 'supported' ELSE inside END AS failure, CASE WHEN 'supported' IN (joint,released) THEN 'supported' WHEN 'conflicting' IN (joint,released) THEN 'conflicting' WHEN 'unknown' IN (joint,released) THEN 'unknown' ELSE 'refuted' END AS goal FROM u)
SELECT run_id, goal, failure, CASE WHEN failure='supported' THEN 'refuted' ELSE goal END AS verdict FROM q""")
def task_verdicts(spark, d):
    return evaluate(TASK, episode(spark, d)).select("run_id", "goal", "failure", "verdict")
