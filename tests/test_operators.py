"""Operators against closed forms and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.functions import numbers as N
from attest.functions import status as S
from attest.functions import vec as V
from attest.operators import boxes as B
from attest.operators import diffs as D
from attest.operators import evidence as E
from attest.operators import graphs as G
from attest.operators import intents as I
from attest.operators import solve as X
from attest.operators import temporal as T
from attest.sources import meshes as M
from attest.sources import robots as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_rotations(spark):
    q = [0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4)]
    r = one(spark, turned=V.rotate(V.vec(*q), V.vec(1, 0, 0)), back=V.multiply(V.conjugate(V.vec(*q)), V.vec(*q)), angle=V.angle(V.vec(*q), V.vec(0, 0, 0, -1)), m=V.matrix_quaternion(V.axis_angle_matrix(V.vec(0, 0, 1), F.lit(math.pi / 2))), inv=V.matmul4(V.rpy_matrix(V.vec(1, 2, 3), V.vec(0.1, 0.2, 0.3)), V.inverse_rigid(V.rpy_matrix(V.vec(1, 2, 3), V.vec(0.1, 0.2, 0.3)))), wrap=V.wrapped_delta(F.lit(3.0), F.lit(-3.0)))
    assert np.allclose(r.turned, [0, 1, 0]) and np.allclose(r.back, [0, 0, 0, 1]) and np.allclose(r.m, q) and np.allclose(r.inv, np.eye(4).ravel())
    assert abs(r.angle - math.pi / 2) < 1e-12 and abs(r.wrap - (6 - 2 * math.pi)) < 1e-12


def test_numbers(spark):
    w = lambda k, n, up: N.wilson(F.lit(k), F.lit(n), up)
    r = one(spark, a=w(16, 16, False), b=w(0, 9, True), c=w(28, 28, False), d=w(0, 0, False), h=N.radical_inverse(F.lit(6), 2), ns=N.nanoseconds(F.lit(2.5e-9)), e=N.effective_timestamp(F.lit(0), F.lit(5)), f=N.finite(F.lit(float("inf"))))
    assert abs(r.a - 0.8063923194655637) < 1e-12 and abs(r.b - 0.2991450484195441) < 1e-12 and abs(r.c - 0.8793566952341543) < 1e-12
    assert r.d is None and r.h == 0.375 and r.ns == 2 and r.e == 5 and r.f is False


def test_folds(spark):
    f = lambda order, *s: S.fold([F.lit(x) for x in s], order)
    r = one(spark, a=f(S.ALL, "conflicting", "refuted"), b=f(S.GRASP, "conflicting", "refuted"), c=f(S.ANY, "refuted", "unknown"), d=S.fold([], S.LAYER), e=S.release(F.lit("supported"), F.lit("unknown")), g=S.release(F.lit("supported"), F.lit("refuted"), F.lit("refuted")), n=S.negate(F.lit(None).cast("string")))
    assert tuple(r) == ("refuted", "conflicting", "unknown", "unknown", "unknown", "refuted", "unknown")


def test_observation_log(spark):
    rows = [("joint", "j100", 100), ("joint", "j300", 300), ("root", "r200", 200), ("near", "o200", 200)]
    log = spark.createDataFrame(rows, "stream string, sample_id string, t long")
    got = {r.stream: (r.sample_id, r.age, r.status, r.future_rows) for r in T.select_at(log, ["stream"], "t", "sample_id", F.lit(250), ["sample_id"], 200).collect()}
    assert got == {"joint": ("j100", 150, "current", 1), "root": ("r200", 50, "current", 0), "near": ("o200", 50, "current", 0)}
    assert {r.stream: r.status for r in T.select_at(log, ["stream"], "t", "sample_id", F.lit(250), ["sample_id"], 100).collect()}["joint"] == "stale"


def test_component_snapshots(spark):
    rows = [(90, "shoulder", 0.0), (100, "slide", 0.5), (200, "shoulder", 0.5), (220, "slide", 0.25)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, t long, joint string, v double")
    got = [tuple(r) for r in T.carry_forward(df, ["k"], ["t"], "t", "joint", "v", ["shoulder", "slide"], 50).orderBy("t").select("snapshot_status", "shoulder_age", "slide_age").collect()]
    assert got == [("incomplete", 0, None), ("current", 10, 0), ("stale", 0, 100), ("current", 20, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_islands_and_asof(spark, seed):
    r = random.Random(seed)
    rows = [(k, i, r.randint(0, 9), r.random() < 0.6, r.choice("lr")) for k in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, i int, t long, ok boolean, side string")
    best = {}
    for k in range(4):
        own, at = [x for x in rows if x[0] == k], None
        for x in [*own, (k, None, None, False, None)]:
            if x[3]:
                at = at or []
                at.append(x)
            elif at:
                key = (at[-1][2] - at[0][2], at[0][1])
                best[k] = max(best.get(k, ((-99, 0), 0)), (key, len(at)))
                at = None
    got = {x.k: ((x.duration, x.start_index), x.n_rows) for x in T.longest_island(df, ["k"], ["i"], "t", F.col("ok")).collect()}
    assert got == best
    left, right = df.where("side='l'"), df.where("side='r'").select("k", "t", F.col("i").alias("rid"))
    for x in T.asof(left, right, ["k"], "t", "rid", ["rid"], 3).collect():
        found = [(y[2], y[1]) for y in rows if y[0] == x.k and y[4] == "r" and y[2] <= x.t]
        assert (x.asof_rid, x.asof_status) == ((None, "missing") if not found else (max(found)[1], "stale" if x.t - max(found)[0] > 3 else "current"))


URDF = """<robot name="two_dof"><link name="base"><inertial><origin xyz="0 0 0"/><mass value="2"/><inertia ixx="1" iyy="1" izz="1" ixy="0" ixz="0" iyz="0"/></inertial></link>
<link name="arm"><inertial><origin xyz="1 0 0"/><mass value="2"/><inertia ixx="0" iyy="0" izz="0"/></inertial><collision><geometry><box size="1 2 3"/></geometry></collision></link><link name="slider"/><link name="tool"/>
<joint name="shoulder" type="revolute"><parent link="base"/><child link="arm"/><origin xyz="1 0 0"/><axis xyz="0 0 2"/><limit lower="-1" upper="2"/></joint>
<joint name="slide" type="prismatic"><parent link="arm"/><child link="slider"/><origin xyz="1 0 0"/><axis xyz="1 0 0"/><mimic joint="shoulder" multiplier="-0.5" offset="0.1"/></joint>
<joint name="mount" type="fixed"><parent link="slider"/><child link="tool"/><origin xyz="0 0 0.2"/></joint></robot>"""
MJCF = '<mujoco><worldbody><body name="a" pos="0 0 1"><joint name="h" type="hinge" axis="0 0 1" range="-90 90"/><geom type="sphere" size="0.1"/><body name="b" pos="1 0 0"/></body></worldbody></mujoco>'
SDF = '<sdf version="1.9"><model name="m"><link name="a"/><link name="b"><pose>1 0 0 0 0 0</pose></link><joint name="j" type="revolute"><parent>a</parent><child>b</child><axis><xyz>0 0 1</xyz><limit><lower>-1</lower><upper>1</upper></limit></axis></joint></model></sdf>'


@pytest.fixture(scope="module")
def robots(spark):
    bad = [("two_roots", "<robot><link name='a'/><link name='b'/></robot>"), ("broken", "<robot"), ("other", "<x/>")]
    docs = spark.createDataFrame([("r", URDF), ("m", MJCF), ("s", SDF), *bad], "robot string, xml string")
    tables, rejected = R.read_robots(docs)
    return {k: v.cache() for k, v in tables.items()}, {r.robot: r.why for r in rejected.collect()}


def test_robot_tables(spark, robots):
    tables, rejected = robots
    assert rejected == {"two_roots": "roots", "broken": "format", "other": "format"}
    j = {r.joint: r for r in tables["joints"].where("robot='r'").collect()}
    assert j["shoulder"].axis == [0, 0, 1] and j["slide"].mimic_multiplier == -0.5 and tables["geometries"].where("robot='r'").first().size == [1, 2, 3]
    m = {r.joint: r for r in tables["joints"].where("robot='m'").collect()}
    assert abs(m["h"].upper - math.pi / 2) < 1e-12 and m["b_joint"].type == "fixed"
    assert tables["joints"].where("robot='s'").first().xyz == [1, 0, 0]
    chain = {r.node: (r.driver, r.multiplier, r.offset) for r in G.affine_chain(R.mimic_edges(tables["joints"].where("robot='r'"))).collect()}
    assert chain["r/slide"] == ("r/shoulder", -0.5, 0.1)


def test_kinematics(spark, robots):
    tables, _ = robots
    value = F.when(F.col("joint") == "shoulder", math.pi / 2).when(F.col("joint") == "slide", 0.5).otherwise(0.0)
    joints = tables["joints"].where("robot='r'").withColumn("value", value).withColumn("driver", F.col("joint")).withColumn("multiplier", F.lit(1.0))
    frames = G.forward_kinematics(joints, spark.sql("SELECT 'r' AS robot, 'base' AS link")).cache()
    at = {r.link: [r.world[3], r.world[7], r.world[11]] for r in frames.collect()}
    assert np.allclose(at["tool"], [1, 1.5, 0.2])
    mass = G.mass_properties(tables["inertials"].where("robot='r'"), frames).first()
    assert mass.mass == 4 and np.allclose([mass.com_x, mass.com_y], [0.5, 0.5])  # base at 0, arm's mass at (1, 1, 0)
    assert abs(mass.izz - (1 + 2 * 0.5 + 2 * 0.5)) < 1e-9
    paths = G.root_paths(joints.select("child", "parent").unionByName(spark.sql("SELECT 'base' AS child, CAST(NULL AS STRING) AS parent"))).select(F.lit("r").alias("robot"), F.col("node").alias("link"), "path")
    jac = {r.driver: [r.linear_x, r.linear_y, r.angular_z] for r in G.jacobian(joints, frames, paths, "tool").collect()}
    assert np.allclose(jac["shoulder"], [-1.5, 0, 1]) and np.allclose(jac["slide"], [0, 1, 0])
    lim = spark.createDataFrame([("d", -0.5, 0.1, -0.2, 0.2), ("d", 1.0, 0.0, -1.0, 1.0)], "driver string, multiplier double, offset double, lower double, upper double")
    d = G.driver_domain(lim).first()
    assert abs(d.lower + 0.2) < 1e-12 and abs(d.upper - 0.6) < 1e-12


def test_meshes(spark):
    tetra = b"v 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\nf 1 3 2\nf 1 2 4\nf 1 4 3\nf -3 -2 -1\n"
    files = spark.createDataFrame([("t.obj", bytearray(tetra)), ("bad.stl", bytearray(b"x")), ("open.obj", bytearray(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1 2 4 3\n"))], "path string, content binary")
    s = {r.geometry_id: r for r in B.mesh_summary(M.parse(files)).collect()}
    t = s["t.obj"]
    assert t.watertight and t.winding and abs(t.volume - 1 / 6) < 1e-12 and abs(t.area - (1.5 + math.sqrt(3) / 2)) < 1e-12
    assert not s["open.obj"].watertight and s["open.obj"].n_faces == 2 and set(s) == {"t.obj", "open.obj"}


def test_surface_distance():
    r = np.random.default_rng(0)
    for _ in range(5):
        a, b = r.normal(0, 1, (20, 3, 3)), r.normal(0, 1, (15, 3, 3)) + [r.uniform(0, 6), 0, 0]
        i, j = np.repeat(np.arange(20), 15), np.tile(np.arange(15), 20)
        assert B.surface_distance(a, b) == pytest.approx(B.triangles_distance(a[i], b[j]).min(), abs=1e-12)
        assert B._distances([a], [b])[0] == pytest.approx(B.surface_distance(a, b), abs=1e-12)
    one = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]]], float)
    assert B.surface_distance(one, one + [0, 0, 2]) == pytest.approx(2) and B.surface_distance(one, np.array([[[0.2, 0.2, -1], [0.2, 0.2, 1], [3, 3, 1]]], float)) == 0


def test_a_crowded_cell_is_swept_in_parts(spark, monkeypatch):
    """All boxes in one cell: few are compared, and a part's end loses none. Small meshes: few triangle pairs are measured."""
    monkeypatch.setattr(B, "PAIRS", 7)
    rows = [(i, i % 3, [0.0, i * 0.01, 0.0], [0.1, i * 0.01 + 0.03, 0.1]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g int, lo array<double>, hi array<double>")
    low, high = [x[2][1] for x in rows], [x[3][1] for x in rows]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if i % 3 != j % 3 and max(0.0, low[j] - high[i]) <= 0.02}
    assert {(x.a, x.b) for x in B.overlap_pairs(df, "k", 10.0, group="g", tolerance=0.02).collect()} == want
    measured, plain = [], B.triangles_distance
    monkeypatch.setattr(B, "triangles_distance", lambda s, t: measured.append(len(s)) or plain(s, t))
    r = np.random.default_rng(4)
    a, b = r.normal(0, 1, (12, 3, 3)), r.normal(0, 1, (12, 3, 3)) + [9, 0, 0]
    i, j = np.repeat(np.arange(12), 12), np.tile(np.arange(12), 12)
    assert B._distances([a], [b])[0] == plain(a[i], b[j]).min() and sum(measured) < 72


def test_range_joins(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-5, 5) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame([(i, p, [x + 1 for x in p]) for i, p in rows], "k int, lo array<double>, hi array<double>")
    gap = lambda p, q: math.sqrt(sum(max(0, a - b - 1, b - a - 1) ** 2 for a, b in zip(p, q, strict=True)))
    expected = {(i, j) for i, p in rows for j, q in rows if i < j and gap(p, q) <= 0.5}
    assert B.overlap_pairs(df, "k", 0.8, tolerance=0.5).count() == len(expected)
    assert {tuple(x)[:2] for x in B.overlap_pairs(df, "k", 0.8, tolerance=0.5).collect()} == expected
    near = {tuple(x)[:2] for x in B.distance_pairs(df.withColumnRenamed("lo", "p"), "k", "p", 1.5).collect()}
    assert near == {(i, j) for i, p in rows for j, q in rows if i < j and math.dist(p, q) <= 1.5}


def test_graphs(spark):
    r = random.Random(2)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    name = list(range(60))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        name[y] = x
    df = spark.createDataFrame(pairs, "a int, b int")
    assert {x.node: x.component for x in G.connected_components(df).collect()} == {v: root(v) for p in pairs for v in p}
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    assert tuple(G.tree_issues(tree).first()) == (6, 1, 0, 2)
    p = G.path_between(G.root_paths(tree), "d", "c").first()
    assert (p.up, p.common, p.down) == (["d", "b"], "a", ["c"])
    premises = spark.createDataFrame([("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c4", "c5")], "node string, premise string")
    assert {x.node for x in G.closure(premises, spark.createDataFrame([("c1",)], "node string")).collect()} == {"c1", "c2", "c3"}


def test_life_cycle_and_truth(spark):
    rows = [("g", "accepted", 150), ("g", "executing", 160), ("g", "succeeded", 180), ("h", "accepted", 1), ("h", "canceling", 2), ("h", "succeeded", 3), ("k", "accepted", 1), ("k", "executing", 2)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "goal string, state string, t long, id long")
    got = {r.goal: (r.status, r.running_from) for r in E.lifecycle(df, ["goal"], "t", "id", "state").collect()}
    assert got == {"g": ("result_succeeded", 160), "h": ("inconsistent", 3), "k": ("in_progress", 2)}
    ev = spark.createDataFrame([("a", "p", 1, True, 130, None, "ok"), ("a", "p", 2, True, 135, None, "ok"), ("b", "p", 3, True, 130, None, "ok"), ("b", "p", 4, False, 130, None, "ok"), ("c", "p", 5, True, 10, None, "ok"), ("d", "p", 6, True, 500, None, "ok"), ("e", "p", 7, True, 130, 135, "ok"), ("f", "p", 8, True, 130, None, "no")], "subject string, predicate string, record_id long, value boolean, observed_at long, valid_until long, kind string")
    cond = spark.createDataFrame([(s, s, "p") for s in "abcdefg"], "condition_id string, subject string, predicate string")
    got = {r.condition_id: (r.truth, r.reason) for r in E.truth(cond, ev, F.lit(True), F.col("kind") == "ok", F.lit(140), F.lit(50)).collect()}
    assert got == {"a": ("true", "observed"), "b": ("unknown", "conflicting_values"), "c": ("unknown", "stale"), "d": ("unknown", "future"), "e": ("unknown", "expired"), "f": ("unknown", "wrong_type"), "g": ("unknown", "missing")}


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, None, 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-12), (2, "z", 2.0), (4, None, 3.0)], "k int, s string, v double")
    got = {r.k: (r.change, r["columns"]) for r in D.keyed_diff(a, b, ["k"], ["s", "v"], 1e-9).collect()}
    assert got == {2: ("changed", "s"), 3: ("removed", ""), 4: ("added", "")}
    assert D.set_equality(a, a).first().equal and not D.set_equality(a, b).first().equal
    assert D.first_difference(a, b, "k", "s").first().k == 2


def test_intents(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    k = I.Knowledge(
        make([("link/base", "link"), ("link/hand", "link"), ("joint/hand", "joint")], "entity_id string, entity_type string"),
        make([("c1", "joint/hand", "moves", "link/hand"), ("c2", "link/base", "holds", "joint/hand")], "clause_id string, subject string, predicate string, object string"),
        make([("c1", "c2")], "node string, premise string"), make([("link/base", None), ("link/hand", "link/base")], "child string, parent string"), make([("joint/hand", "link/hand")], "driver string, frame string"),
        make([("gripper", "link/hand")], "component string, member string"), make([("f1", "gripper", "grasp", "cup")], "function_id string, provided_by string, verb string, object_type string"),
        make([("cap", "f1", "q1"), ("cap", "f1", "q2")], "capability_id string, function_id string, requirement_id string"), make([("q1", "entity_exists", "link/hand", None), ("q2", "driver_affects_frame", "joint/hand", "link/hand")], "requirement_id string, kind string, subject string, object string"),
        make([("aff", "cup", "cap")], "affordance_id string, object_type string, capability_id string"), make([("robot", "functions"), ("joint/hand", "driver_affects_frame")], "subject string, inventory string"))
    assert {r.name: r.state for r in I.resolve(k, make([("base",), ("hand",), ("link/hand",), ("z",)], "name string")).collect()} == {"base": "resolved", "hand": "ambiguous", "link/hand": "resolved", "z": "unknown"}
    exists = k.entities.select(F.col("entity_id").alias("subject"), F.lit(None).cast("string").alias("object"))
    moves = k.drivers.select(F.col("driver").alias("subject"), F.col("frame").alias("object"))
    full = I.ground_requirements(k, {"entity_exists": exists, "driver_affects_frame": moves})
    none = I.ground_requirements(k, {"entity_exists": exists, "driver_affects_frame": moves.where("false")})
    assert I.can_perform_action(k, full, "grasp", "cup").first().answer == "yes"
    assert I.can_perform_action(k, none, "grasp", "cup").first().answer == "no"
    assert I.explain_affordance(k, none, "cup").first().state == "unavailable"
    assert {r.clause_id for r in I.explain_clauses(k, "link/hand").collect()} == {"c1", "c2"}
    assert I.what_is_entity_for(k, "link/hand").first().verb == "grasp" and I.explain_driver_effect(k, "joint/hand").first().clause_id == "c1"
    assert {r.entity_type: r.n for r in I.structural_summary(k).collect()} == {"link": 2, "joint": 1, "tree_leaf": 1, "tree_branch": 0}
    assert I.trace_kinematic_path(k, "link/hand", "link/base").first().up == ["link/hand"] and I.describe_component(k, "gripper").count() == 2 and I.describe_entity(k, "joint/hand").count() == 2


def test_solver(spark):
    """A two-bar arm reaching a point: both elbows, one rank drop when stretched."""
    arm = lambda x, p: [math.cos(x[0]) + math.cos(x[0] + x[1]) - p["px"], math.sin(x[0]) + math.sin(x[0] + x[1])]
    seeds = spark.createDataFrame([(0, [0.5, 1.0], 1.0), (1, [-0.5, -1.0], 1.0), (2, [0.1, 0.1], 2.0), (3, [0.1, 0.4], 3.0)], "seed int, start array<double>, px double")
    got = {r.seed: r for r in X.solve_rows(seeds, "seed", arm, [-3.2, -3.2], [3.2, 3.2], ("px",)).collect()}
    assert got[0].solved and got[1].solved and not got[3].solved and np.allclose(np.array(got[0].solution), -np.array(got[1].solution), atol=1e-6) and got[0].rank == 2
    pts = spark.createDataFrame([(0, i, [float(i // 3), 0.01 * i]) for i in range(6)], "g int, i int, p array<double>")
    assert [r.cluster for r in X.greedy_clusters(pts, ["g"], "i", "p", 0.2).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1]
    hull = X.convex_hull(spark.createDataFrame([(0, float(x), float(y)) for x in range(3) for y in range(3)], "g int, x double, y double"), ["g"], "x", "y").orderBy("corner").collect()
    assert [(r.x, r.y) for r in hull] == [(0, 0), (2, 0), (2, 2), (0, 2)]




def test_frames_in_time(spark):
    from attest.operators.frames import path_at, stream_issues

    q = [0.0, 0.0, 0.0, 1.0]
    edges = spark.createDataFrame([("cell", "world", True, 90, [1.0, 0.0, 0.0], q, 0, "a"), ("base", "cell", False, 100, [2.0, 0.0, 0.0], q, 1, "a"), ("base", "cell", False, 200, [3.0, 0.0, 0.0], q, 2, "b")], "child string, parent string, static boolean, t long, xyz array<double>, quaternion array<double>, record_id long, publisher string")
    path = spark.createDataFrame([(0, "cell"), (1, "base")], "position int, child string")
    queries = spark.createDataFrame([(1, 100), (2, 200), (3, 90), (4, 300)], "query_id int, t long")
    got = {r.query_id: (r.status, r.matrix and r.matrix[3]) for r in path_at(edges, path, queries, 50).collect()}
    assert got == {1: ("current", 3.0), 2: ("current", 4.0), 3: ("missing", None), 4: ("stale", None)}
    assert [tuple(r) for r in stream_issues(edges).collect()] == [("base", "several_publishers")]


def test_shapes(spark, robots):
    from attest.operators import shapes as P

    r = np.random.default_rng(3)
    pts = r.normal(0, 1, (200, 3)) * [5, 1, 0.2]
    df = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(pts)], "k int, i int, p array<double>")
    got = P.principal_axes(df, ["k"], "p").first()
    w = np.linalg.eigh(np.cov(pts.T, bias=True))[0][::-1]
    assert np.allclose(got.variances, w) and got.axis[0] > 0.9
    s, m = P.summary(df, ["k"], "p").first(), P.landmarks(df, ["k"], "p", "i").first()
    assert s.n == 200 and s.min_x == pts[:, 0].min() and m.least_x == pts[:, 0].argmin() and m.greatest_z == pts[:, 2].argmax()
    tables, _ = robots
    value = F.when(F.col("joint") == "slide", 0.5).otherwise(0.0)
    joints = tables["joints"].where("robot='r'").withColumn("value", value).withColumn("driver", F.col("joint")).withColumn("multiplier", F.lit(1.0))
    frames = G.forward_kinematics(joints, spark.sql("SELECT 'r' AS robot, 'base' AS link"))
    paths = G.root_paths(joints.select("child", "parent").unionByName(spark.sql("SELECT 'base' AS child, CAST(NULL AS STRING) AS parent"))).select(F.lit("r").alias("robot"), F.col("node").alias("link"), "path")
    loads = {x.driver: x.load for x in P.gravity_loads(tables["inertials"].where("robot='r'"), frames, joints, paths, (0, -10, 0)).collect()}
    assert loads == {"shoulder": pytest.approx(20.0)}  # 2 kg one metre out, turning about z
    d = spark.createDataFrame([("r", "a", 0, -1.0, 1.0), ("r", "b", 1, 0.0, 3.0)], "robot string, driver string, number int, lower double, upper double")
    poses = P.halton_poses(d, 8).where("sample = 2").collect()
    assert {x.driver: round(x.value, 9) for x in poses} == {"a": -0.5, "b": 2.0}


def test_semantics_and_event_logs(spark, robots, tmp_path):
    from attest.sources.traces import read_events

    srdf = "<robot name='r'><group name='arm'><chain base_link='base' tip_link='slider'/></group><group name='all'><group name='arm'/><joint name='mount'/></group><group_state name='home' group='arm'><joint name='slide' value='0.5'/></group_state><disable_collisions link1='b' link2='a' reason='near'/></robot>"
    t = R.read_semantics(spark.createDataFrame([("r", srdf), ("x", "<broken")], "robot string, xml string"))
    joints = robots[0]["joints"].where("robot='r'")
    paths = G.root_paths(joints.select("child", "parent").unionByName(spark.sql("SELECT 'base' AS child, CAST(NULL AS STRING) AS parent"))).select(F.lit("r").alias("robot"), F.col("node").alias("link"), "path")
    got = {(r.grp, r.joint) for r in R.expand_groups(t["groups"], joints, paths).collect()}
    assert got == {("arm", "shoulder"), ("arm", "slide"), ("all", "shoulder"), ("all", "slide"), ("all", "mount")}
    assert t["states"].first().value == 0.5 and (t["disabled"].first().a, t["disabled"].first().b) == ("a", "b")
    (tmp_path / "e.jsonl").write_text('{"time_s": 1, "type": "x"}\n{"time_s": 2, "type": "y", "deep": {"Success": 1}}\n{"type": "z"}\n{oops\n')
    good, bad = read_events(spark, f"file://{tmp_path}/e.jsonl")
    assert [r.type for r in good.collect()] == ["x"] and sorted(r.why for r in bad.collect()) == ["label", "syntax", "time"]
