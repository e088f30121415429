"""Operators against brute force and at their edges: nearest pairs, segments, stream order, edits, captures, sources."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from attest.operators import boxes as B
from attest.operators import capture as C
from attest.operators import graphs as G
from attest.operators import models as M
from attest.operators import questions as Q
from attest.operators import scene as S
from attest.operators import shapes as P
from attest.operators import temporal as T
from attest.sources import records as R
from attest.sources import shared
from attest.streaming import checks as L


def test_nearest_pairs(spark):
    r = random.Random(5)
    groups = {
        1: [[r.random() * 10 for _ in range(3)] for _ in range(120)],
        2: [[r.gauss(0, 1e-4), 0.0, r.gauss(0, 1e-4)] for _ in range(60)] + [[1e6, -1e6, 3.0]],  # a cluster and one far away
        3: [[float(x), float(y), float(z)] for x in range(4) for y in range(4) for z in range(4)],  # all neighbours equally near
        4: [[1.0, 2.0, 3.0]],
        5: [[7.0, 7.0, 7.0]] * 3 + [[7.0, 7.0, 7.5]],
        6: [[0.0, 0.0, 0.0], [100.0, 0.0, 0.0]],
    }
    rows = [(g, 1000 * g + i, p) for g, ps in groups.items() for i, p in enumerate(ps)] + [(6, 9999, None), (6, 9998, [None, 1.0, 2.0])]
    got = {x.g: (x.a, x.b, x.distance) for x in B.nearest_pairs(spark.createDataFrame(rows, "g long, k long, p array<double>"), "g", "k", "p").collect()}
    want = {}
    for g, ps in groups.items():
        pairs = [(math.dist(p, q), 1000 * g + i, 1000 * g + j) for (i, p), (j, q) in itertools.combinations(enumerate(ps), 2)]
        if pairs:
            want[g] = min(pairs)
    assert set(got) == set(want)
    for g, (dist, a, b) in want.items():
        assert got[g][:2] == (a, b) and abs(got[g][2] - dist) < 1e-9


def test_anchored_segments(spark):
    r = random.Random(6)
    rows = [(k, i, float(i + r.randint(0, 1)), None if r.random() < 0.03 else r.choice([0.0, 1.0, 1.0, 2.0, r.random() * 4])) for k in range(8) for i in range(70)] + [(99, 0, 0.0, None)]
    got = {x.k: (x.start_index, x.n_rows, x.duration) for x in T.anchored_segment(spark.createDataFrame(rows, "k long, i long, t double, v double"), ["k"], ["i"], "t", "v", 1.0).collect()}
    assert 99 not in got
    for k in range(8):
        own = [(t, v) for kk, _, t, v in rows if kk == k]
        best = None
        for s, (t, v) in enumerate(own):
            n = 0
            while v is not None and s + n < len(own) and own[s + n][1] is not None and abs(own[s + n][1] - v) <= 1.0:
                n += 1
            if n and (best is None or own[s + n - 1][0] - t >= best[2]):
                best = (s, n, own[s + n - 1][0] - t)
        assert got[k] == best


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_order_does_not_depend_on_batches(spark, tmp_path, batches):
    rows = [(i % 3, i, 10 * i if i % 7 else 10 * i - 65) for i in range(60)] + [(0, 60, 5000)]
    schema = "k long, n long, t long"
    for b in range(batches):
        part = [x for x in rows if x[1] * batches // 61 == b]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted(tuple(x) for x in L.drain(L.order_issues(stream, "k", "n", "t", 200)).collect())
    want, last = [], {}
    for k, n, t in rows:
        step = t - last.get(k, t)
        if step < 0 or step > 200:
            want.append((k, n, "out_of_order" if step < 0 else "gap", step))
        last[k] = t
    assert got == sorted(want) and {x[2] for x in want} == {"out_of_order", "gap"}


def test_edits_in_order(spark):
    edges = spark.createDataFrame([("r", "a", None), ("r", "b", "a"), ("r", "c", "b"), ("q", "a", None)], "robot string, child string, parent string")
    ops = spark.createDataFrame([
        ("r", 1, "add_leaf", "d", "c", None), ("r", 2, "remove_leaf", "c", None, "b"), ("r", 3, "reparent", "d", "a", "c"), ("r", 4, "remove_leaf", "c", None, "b"), ("r", 5, "remove_subtree", "a", None, None), ("q", 1, "add_leaf", "a", "a", None), ("q", 2, "remove_leaf", "zz", None, "a"),
    ], "robot string, position int, type string, link string, parent string, expected_parent string")
    tree, report = M.apply_edits(edges, ops)
    assert sorted(map(tuple, tree.collect()), key=str) == sorted([("q", "a", None), ("r", "a", None), ("r", "b", "a"), ("r", "d", "a")], key=str)
    assert {(x.robot, x.position): x.result for x in report.collect()} == {("r", 1): "applied", ("r", 2): "not_a_leaf", ("r", 3): "applied", ("r", 4): "applied", ("r", 5): "root", ("q", 1): "name_exists", ("q", 2): "unknown_link"}
    held = spark.createDataFrame([("r", "b", "c"), ("r", "c", "c")], "robot string, place string, name string")
    gone = spark.createDataFrame([("r", "c")], "robot string, link string")
    assert [tuple(x) for x in M.external_references(held, gone).select("robot", "place", "name").collect()] == [("r", "b", "c")]


def test_poses_with_cycles_and_unknown_names(spark):
    j = spark.createDataFrame([
        ("r", "d", "base", "l0", "prismatic", [0.0] * 3, [0.0] * 3, [1.0, 0.0, 0.0], None, None, None, 0.0, 1.0), ("r", "m", "l0", "l1", "prismatic", [0.0] * 3, [0.0] * 3, [1.0, 0.0, 0.0], "d", -2.0, 0.5, -1.0, 1.0),
        ("r", "x", "l1", "l2", "revolute", [0.0] * 3, [0.0] * 3, [0.0, 0.0, 1.0], "y", 1.0, 0.0, -1.0, 1.0), ("r", "y", "l2", "l3", "revolute", [0.0] * 3, [0.0] * 3, [0.0, 0.0, 1.0], "x", 1.0, 0.0, -1.0, 1.0), ("r", "f", "l3", "l4", "fixed", [0.0] * 3, [0.0] * 3, [0.0, 0.0, 1.0], None, None, None, None, None),
    ], "robot string, joint string, parent string, child string, type string, xyz array<double>, rpy array<double>, axis array<double>, mimic string, multiplier double, offset double, lower double, upper double")
    v = spark.createDataFrame([("r", "d", 0.9), ("r", "m", 0.1), ("r", "f", 0.1), ("r", "no", 0.1)], "robot string, joint string, value double")
    got = {x.joint: (x.driver, x.state, x.position) for x in M.resolve_pose(j, v).collect()}
    assert got["d"] == ("d", "ok", 0.9) and got["m"][:2] == ("d", "outside_limits") and abs(got["m"][2] + 1.3) < 1e-9
    assert got["x"][1] == got["y"][1] == "mimic_cycle" and got["f"] == (None, "ok", 0.0)
    assert {x.joint: x.why for x in M.unknown_values(j, v).collect()} == {"m": "mimic", "f": "fixed", "no": "unknown"}
    d = M.domains(j).first()
    assert (d.driver, d.lower, d.upper, d.feasible) == ("d", 0.0, 0.75, True)
    assert M.counterfactuals(j, v).where("direction = 'plus'").first().status == "baseline_outside"


def test_empty_tables(spark):
    points = spark.createDataFrame([], "g long, k long, p array<double>")
    assert B.nearest_pairs(points, "g", "k", "p").count() == 0
    edges = spark.createDataFrame([], "robot string, child string, parent string")
    ops = spark.createDataFrame([], "robot string, position int, type string, link string, parent string, expected_parent string")
    tree, report = M.apply_edits(edges, ops)
    assert tree.count() == 0 and report is None
    frames = spark.createDataFrame([], "scene string, frame string, parent string, xyz array<double>, quaternion array<double>")
    assert S.scene_frames(frames).count() == 0 and S.scene_issues(frames).count() == 0
    boxes = spark.createDataFrame([], "scene string, name string, lo array<double>, hi array<double>, exact boolean")
    assert S.minimum_separation(boxes, boxes, 1.0).count() == 0 and S.environment_collisions(boxes, boxes, 1.0, 0.1)[1].count() == 0
    reports = spark.createDataFrame([], "capture_id long, record_id long, time long, publisher string, goal_uuid string, code int")
    life, audit = C.lifecycle_records(reports, spark.createDataFrame([], "capture_id long, goal_uuid string"))
    assert life.count() == audit.count() == 0
    assert G.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    texts, none = spark.createDataFrame([(1, "a b"), (2, None)], "i long, t string"), spark.createDataFrame([], "marker string")
    assert Q.leaks(texts, "i", "t", none).count() == 0


def test_no_cycle_through_a_name_declared_twice(spark):
    pose = ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0])
    for first, second in (("a", "world"), ("world", "a")):
        rows = [("s", "a", first), ("s", "a", second), ("s", "b", "a"), ("s", "c", "c"), ("s", "d", "c")]
        frames = spark.createDataFrame([(*r, *pose) for r in rows], "scene string, frame string, parent string, xyz array<double>, quaternion array<double>").coalesce(1)
        got = sorted((x.frame, x.issue) for x in S.scene_issues(frames).collect())
        assert got == [("a", "declared_twice"), ("c", "cycle"), ("d", "cycle")]


def test_grammar_of_a_deep_robot_stays_short(spark, tmp_path):
    """A chain of 3,000 links: rules, not paths, and every result of the walks in closed form."""
    n = 3000
    vec = lambda *v: F.array(*[F.lit(x) for x in v])
    j = spark.range(n).select(
        F.lit("r").alias("robot"), F.concat(F.lit("j"), "id").alias("joint"), F.concat(F.lit("l"), F.col("id") - 1).alias("parent"), F.concat(F.lit("l"), "id").alias("child"),
        F.when(F.col("id") % 1000 == 0, "prismatic").otherwise("fixed").alias("type"), vec(0.5, 0.0, 0.0).alias("xyz"), vec(0.0, 0.0, 0.0).alias("rpy"), vec(1.0, 0.0, 0.0).alias("axis"),
        F.when(F.col("id") == 2000, "j0").alias("mimic"), F.lit(2.0).alias("multiplier"), F.lit(0.0).alias("offset"), F.lit(0.0).alias("lower"), F.lit(1.0).alias("upper"),
    )
    v = spark.createDataFrame([("r", "j0", 0.25)], "robot string, joint string, value double")
    operators, derivations = M.grammar(j)
    assert derivations.columns == ["robot", "frame", "joint", "prefix"] and derivations.count() == n + 1
    tip = f"l{n - 1}"
    x = M.evaluate_grammar(operators, derivations, v).where(f"frame = '{tip}'").first()
    assert abs(x.world[3] - (0.5 * n + 3 * 0.25)) < 1e-9
    got = {r.frame: (r.n_operators, r.dependencies) for r in M.derived(operators, derivations).collect()}
    assert got[tip] == (n, ["j0", "j1000"]) and got["l-1"] == (0, []) and got["l999"] == (1000, ["j0"])
    assert M.operator_lists(derivations, "l2").first().operators == ["j0", "j1", "j2"]
    asked = spark.createDataFrame([("c", "r", "l3", tip), ("d", "r", "l3", "nowhere")], "constraint string, robot string, frame_a string, frame_b string")
    assert [tuple(r) for r in M.constraint_drivers(operators, derivations, asked).collect()] == [("c", "r", ["j0", "j1000"])]
    assert {r.driver: r.n for r in M.affected(j).groupBy("driver").agg(F.count("*").alias("n")).collect()} == {"j0": n, "j1000": n - 1000}
    atlas = {(r.driver, r.direction): r for r in M.causality(M.motion_atlas(j, v)).collect()}
    assert (atlas["j0", "plus"].n_changed, atlas["j1000", "plus"].n_changed, atlas["j0", "plus"].changed_only, atlas["j0", "plus"].structural_only) == (n, n - 1000, 0, 0)
    other = j.withColumn("parent", F.when(F.col("joint") == "j2999", "l5").otherwise(F.col("parent")))
    assert M.compare_grammars((operators, derivations), M.grammar(other), v).first().derivations_differ == 1
    masses = spark.createDataFrame([("r", tip, 2.0, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "robot string, link string, mass double, xyz array<double>, rpy array<double>")
    frames = M.evaluate_grammar(operators, derivations, v).withColumnRenamed("frame", "link")
    paths = derivations.select("robot", F.col("frame").alias("link"), F.when(F.col("prefix").isNull(), F.array("frame")).otherwise(F.array("prefix", "frame")).alias("path"))
    assert {r.driver: r.load for r in P.gravity_loads(masses, frames, operators, paths, (-10, 0, 0)).collect()} == {"j0": 60.0, "j1000": 20.0}


def test_leaks_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "so one  two\nthree four five six"), (2, "none two three four five"), (3, "x seven"), (4, "xseven"), (5, None), (6, "one two three four fivefold")], "i long, t string")
    markers = spark.createDataFrame([("one two three four five",), ("seven",), ("  ",), (None,), ("one two three four five",)], "marker string")
    assert {x.id: x.n for x in Q.leaks(texts, "i", "t", markers).collect()} == {1: 1, 3: 1}


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://there:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    for master in ("spark://there:7077", "yarn", "local-cluster[2,1,1024]"):
        Context.master = master
        with pytest.raises(ValueError):
            shared.shared_folder(Session())
    Context.master = "local[2]"
    assert shared.shared_folder(Session()).startswith("file:")


def test_adapters_by_name(spark):
    R.register_adapter("echo", lambda documents: (documents, {}, documents, documents))
    assert "echo" in R.adapter_names() and R.adapter_for("echo")(1)[0] == 1
    for wrong in ("echo", "generic"):
        with pytest.raises(ValueError):
            R.register_adapter(wrong, lambda d: d)
    with pytest.raises(ValueError):
        R.adapter_for("nobody")
    R._MORE.pop("echo")


def test_inside_a_tetrahedron(spark):
    corners = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    faces = spark.createDataFrame([(1, sum((corners[i] for i in f), [])) for f in ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3))], "m long, corners array<double>")
    r = random.Random(2)
    points = [(1, i, [r.uniform(-0.2, 1.0) for _ in range(3)]) for i in range(200)]
    got = {x.point: x.inside for x in S.inside_surface(spark.createDataFrame(points, "m long, point long, p array<double>"), faces, "m").collect()}
    assert got == {i: min(p) > 0 and sum(p) < 1 for _, i, p in points}


def test_joint_records_carry_forward(spark):
    rows = [(1, 1, 10, 10, "a", ["x"], [1.0]), (1, 2, 12, 12, "a", ["y", "zz"], [2.0, 9.0]), (1, 3, 12, 13, "a", ["x"], [3.0]), (1, 4, 40, 40, "a", ["x"], [4.0])]
    df = spark.createDataFrame(rows, "run long, record_id long, time long, receipt long, authority string, names array<string>, positions array<double>")
    got = {x.record_id: (x.status, x.kept, x.positions) for x in C.joint_snapshots(df, ["run"], {"x": "jx", "y": "jy"}, 5).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("incomplete", False), 2: ("complete", False), 3: ("complete", True), 4: ("stale", False)}
    assert got[3][2] == {"jx": 3.0, "jy": 2.0}
    assert C.joint_snapshots(df.where(F.lit(False)), ["run"], {"x": "jx"}, 5).count() == 0
