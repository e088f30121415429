"""World scenes: nested frames, typed places of everything in a scene, gravity in a robot's root, and robot against environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from ..sources.shared import Scratch
from .boxes import _cells
from .frames import pose_matrix
from .graphs import _climb, linked_components

_SAME = [float(i % 5 == 0) for i in range(16)]


def scene_frames(frames: DataFrame, world: str = "world") -> DataFrame:
    """frames (scene, frame, parent, xyz, quaternion) to (scene, frame, matrix) in the scene's world; frames that do not reach it are left out."""
    key = lambda c: F.struct("scene", c.alias("frame"))
    local = F.col("matrix")
    edges = frames.withColumn("matrix", pose_matrix(F.col("xyz"), V.quaternion(F.col("quaternion")))).select(key(F.col("frame")).alias("child"), key(F.col("parent")).alias("parent"), local.alias("_m"))
    tops = frames.select("scene").distinct().select(key(F.lit(world)).alias("child"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), V.vec(*_SAME).alias("_m"))
    return _climb(edges.unionByName(tops), F.col("_m"), V.matmul4).select("node.scene", "node.frame", F.col("value").alias("matrix"))


def scene_issues(frames: DataFrame, world: str = "world") -> DataFrame:
    """(scene, frame, issue): the world declared again, a name declared twice, an unknown parent, or a cycle.

    A name declared twice has no one parent, so no cycle is followed through it.
    """
    twice = frames.groupBy("scene", "frame").agg(F.count("*").alias("n")).where("n > 1").select("scene", "frame", F.lit("declared_twice").alias("issue"))
    again = frames.where(F.col("frame") == world).select("scene", "frame", F.lit("world_declared").alias("issue"))
    known = frames.select("scene", F.col("frame").alias("parent")).distinct()
    unknown = frames.where(F.col("parent") != world).join(known, ["scene", "parent"], "left_anti").select("scene", "frame", F.lit("unknown_parent").alias("issue"))
    one = frames.where(F.col("frame") != world).groupBy("scene", "frame").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    key = lambda c: F.struct("scene", F.col(c).alias("f"))
    edges = one.select(key("frame").alias("child"), key("parent").alias("parent"))
    tops = edges.select(F.col("parent").alias("child")).distinct().join(edges.select("child"), "child", "left_anti").select("child", F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"))
    reached = _climb(edges.unionByName(tops), F.lit(1), lambda u, o: u + o).select(F.col("node").alias("child"))
    cycle = edges.select("child").join(reached, "child", "left_anti").select("child.scene", F.col("child.f").alias("frame"), F.lit("cycle").alias("issue"))
    return twice.unionByName(again).unionByName(unknown).unionByName(cycle)


def typed_frames(frames: DataFrame, objects: DataFrame, robots: DataFrame, links: DataFrame, observed: DataFrame | None = None, world: str = "world") -> DataFrame:
    """(scene, entity, matrix): scene_frame/, scene_object/ and robot_frame/ entities in the scene's world.

    objects: scene, object, parent, xyz, quaternion. robots: scene, robot, parent, xyz, quaternion (of its root). links: robot,
    link, world (in the root). observed: scene, entity, matrix, which replace the declared places of objects and of
    robots (entity robot/name).
    """
    at = scene_frames(frames, world)
    parent = at.select("scene", F.col("frame").alias("parent"), F.col("matrix").alias("_p"))
    placed = lambda df, name: df.withColumn("_l", pose_matrix(F.col("xyz"), V.quaternion(F.col("quaternion")))).join(parent, ["scene", "parent"]).select("scene", name, V.matmul4(F.col("_p"), F.col("_l")).alias("matrix"))
    things = placed(objects, "object").select("scene", F.concat(F.lit("scene_object/"), "object").alias("entity"), "matrix")
    roots = placed(robots, "robot").select("scene", "robot", F.concat(F.lit("robot/"), "robot").alias("entity"), "matrix")
    if observed is not None:
        seen = observed.select("scene", "entity", F.col("matrix").alias("_o"))
        things = things.join(seen, ["scene", "entity"], "left").select("scene", "entity", F.coalesce("_o", "matrix").alias("matrix"))
        roots = roots.join(seen, ["scene", "entity"], "left").select("scene", "robot", F.coalesce("_o", "matrix").alias("matrix"))
    parts = roots.join(links, "robot").select("scene", F.concat(F.lit("robot_frame/"), "robot", F.lit("/"), "link").alias("entity"), V.matmul4(F.col("matrix"), F.col("world")).alias("matrix"))
    return at.select("scene", F.concat(F.lit("scene_frame/"), "frame").alias("entity"), "matrix").unionByName(things).unionByName(parts)


def relative(typed: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (scene, reference, target) with the target's matrix in the reference's frame; null where either is unknown."""
    a = typed.select("scene", F.col("entity").alias("reference"), F.col("matrix").alias("_a"))
    b = typed.select("scene", F.col("entity").alias("target"), F.col("matrix").alias("_b"))
    j = pairs.join(a, ["scene", "reference"], "left").join(b, ["scene", "target"], "left")
    return j.select("scene", "reference", "target", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), V.matmul4(V.inverse_rigid(F.col("_a")), F.col("_b"))).alias("matrix"))


def gravity_in_root(root: Column, gravity: Column) -> Column:
    """A world vector in a root frame's axes; null without a vector."""
    return F.when(gravity.isNotNull(), F.array(*[root[j] * gravity[0] + root[4 + j] * gravity[1] + root[8 + j] * gravity[2] for j in range(3)]))


def near_pairs(robot: DataFrame, scene: DataFrame, cell: float, tolerance: float) -> DataFrame:
    """Boxes (scene, name, lo, hi) of a robot and of the environment in one scene, no more than tolerance apart: scene, a, b, gap."""
    slack = tolerance / 2
    a = _cells(robot.select("scene", F.col("name").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")), "a_lo", "a_hi", cell, slack)
    b = _cells(scene.select("scene", F.col("name").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")), "b_lo", "b_hi", cell, slack)
    pairs = a.join(b.hint("merge"), ["scene", "_c0", "_c1", "_c2"])
    for i in range(3):
        pairs = pairs.where(F.col(f"_c{i}") == F.greatest(F.floor((F.col("a_lo")[i] - slack) / cell), F.floor((F.col("b_lo")[i] - slack) / cell)))
    gap = F.sqrt(V.box_gap_squared(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")))
    return pairs.select("scene", "a", "b", gap.alias("gap")).where(F.col("gap") <= tolerance)


def environment_collisions(robot: DataFrame, scene: DataFrame, cell: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Pairs within the tolerance with their status, and one row per scene.

    robot, scene: scene, name, lo, hi, exact. Boxes that hold exact solids collide if they touch; others are indeterminate there.
    All pairs further apart are free by their boxes and are counted, not formed. Scene rows: n_pairs, n_collisions,
    n_indeterminate, status. A geometry that was not measured (null lo) makes its scene's status indeterminate.
    """
    measured = lambda df: df.where("lo is not null")
    pairs = near_pairs(measured(robot), measured(scene), cell, tolerance)
    kinds = robot.select("scene", F.col("name").alias("a"), F.col("exact").alias("_x")), scene.select("scene", F.col("name").alias("b"), F.col("exact").alias("_y"))
    judged = pairs.join(kinds[0], ["scene", "a"]).join(kinds[1], ["scene", "b"]).select("scene", "a", "b", "gap", F.when(F.col("_x") & F.col("_y"), "collision").otherwise("indeterminate").alias("status"))
    count = lambda df, n: df.groupBy("scene").agg(F.count("*").alias(n), F.count_if(F.col("lo").isNull()).alias(f"{n}_lost"))
    hits = judged.groupBy("scene").agg(F.count_if(F.col("status") == "collision").alias("n_collisions"), F.count_if(F.col("status") == "indeterminate").alias("n_indeterminate"))
    out = count(robot, "_r").join(count(scene, "_s"), "scene", "full").join(hits, "scene", "left").fillna(0)
    lost = F.col("_r_lost") * F.col("_s") + F.col("_s_lost") * F.col("_r") - F.col("_r_lost") * F.col("_s_lost")
    status = F.when((F.col("_r") == 0) | (F.col("_s") == 0), "not_applicable").when(F.col("n_collisions") > 0, "collision").when((F.col("n_indeterminate") > 0) | (lost > 0), "indeterminate").otherwise("collision_free")
    return judged, out.select("scene", (F.col("_r") * F.col("_s")).alias("n_pairs"), "n_collisions", (F.col("n_indeterminate") + lost).alias("n_indeterminate"), status.alias("status"))


def minimum_separation(robot: DataFrame, scene: DataFrame, start: float) -> DataFrame:
    """Per scene its nearest pair of boxes: scene, a, b, gap. The reach is doubled for scenes without a pair; one reach holds the nearest."""
    scratch = Scratch(robot.sparkSession)
    both = robot.select("scene").intersect(scene.select("scene"))
    reach, best = start, None
    left = scratch.put(both)
    while not left.isEmpty():
        near = near_pairs(robot.join(left, "scene", "left_semi"), scene.join(left, "scene", "left_semi"), reach, reach)
        found = scratch.put(near.groupBy("scene").agg(F.min(F.struct("gap", "a", "b")).alias("m")).select("scene", "m.a", "m.b", "m.gap"))
        best = found if best is None else best.unionByName(found)
        left, reach = scratch.put(left.join(found, "scene", "left_anti")), 2 * reach
    return best if best is not None else both.select("scene", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("gap"))


def face_components(faces: DataFrame, key: str) -> DataFrame:
    """faces (key, face, corners: 9 numbers) to (key, face, component): faces that hang together by corners, named by the least face id.

    Face ids are whole numbers, unique in the table and not negative.
    """
    corner = F.explode(F.array(*[F.slice("corners", 3 * i + 1, 3) for i in range(3)]))
    corners = faces.select(key, "face", corner.alias("corner"))
    # a corner is named by the least face that has it; the edges join faces with it
    least = corners.groupBy(key, "corner").agg(F.min("face").alias("b"))
    edges = corners.join(least.hint("merge"), [key, "corner"]).select(F.col("face").alias("a"), "b").distinct()
    found = linked_components(edges, Scratch(faces.sparkSession), merge=True).withColumnRenamed("node", "face")
    return faces.select(key, "face").join(found.hint("merge"), "face", "left").select(key, "face", F.coalesce("component", "face").alias("component"))


def inside_surface(points: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """points (key, point, p) against closed surfaces (key, corners): key, point, inside. By the sum of the faces' solid angles."""
    t = F.col("corners")
    a, b, c = ([t[3 * i + k] - F.col("p")[k] for k in range(3)] for i in range(3))
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    size = lambda x: F.sqrt(dot(x, x))
    triple = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    below = size(a) * size(b) * size(c) + dot(a, b) * size(c) + dot(b, c) * size(a) + dot(c, a) * size(b)
    # merged by key, never broadcast: faces and points are many times what the tables they are made of take
    out = points.join(faces.hint("merge"), key).groupBy(key, "point").agg(F.sum(2 * F.atan2(triple, below)).alias("_w"))
    return out.select(key, "point", (F.abs(F.col("_w")) > 6.283185307179586).alias("inside"))
