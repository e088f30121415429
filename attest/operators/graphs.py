"""Trees and graphs as edge tables: root paths, descendants, closures, components, affine chains, forward kinematics.

What runs down a tree is composed by pointer doubling: every node holds the product along the way to an ancestor, and a
round joins it with that ancestor's, so a tree of depth n takes log2(n) rounds and no recursion limit is met. Tables
between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vec as V
from ..sources.shared import Scratch


def _climb(edges: DataFrame, value: Column, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """edges (child, parent; null for a root) to (node, value) of the nodes that a root reaches.

    value: of each edge's child; compose(upper, lower): associative, the value of two stretches of a path. A node with
    several parents has a row for each path. Nodes on or below a cycle, or below a parent that has no row, are left out.
    """
    scratch = Scratch(edges.sparkSession)
    state = scratch.put(edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), value.alias("value")), "climb")
    done, waiting = state.where("up is null").select("node", "value"), state.where("up is not null")
    left = waiting.count()
    while left:
        known = done.withColumn("next", F.lit(None).cast(state.schema["up"].dataType)).unionByName(waiting.withColumnRenamed("up", "next"))
        above = known.select(F.col("node").alias("up"), "next", F.col("value").alias("_upper"))
        # never broadcast: files of matrices and keys take a small part of what their rows take
        step = waiting.join(above.hint("merge"), "up").select("node", F.col("next").alias("up"), compose(F.col("_upper"), F.col("value")).alias("value"))
        step = scratch.put(step, "climb")
        done, waiting = done.unionByName(step.where("up is null").select("node", "value")), step.where("up is not null")
        now = waiting.count()
        if now >= left and step.where("up is null").isEmpty():
            break  # only cycles are left
        left = now
    return done


def root_paths(edges: DataFrame) -> DataFrame:
    """edges (child, parent; parent null for a root) to node, depth, path (array from the root)."""
    out = _climb(edges, F.array("child"), lambda upper, own: F.concat(upper, own))
    return out.select("node", (F.size("value") - 1).alias("depth"), F.col("value").alias("path"))


def descendants(edges: DataFrame, of: DataFrame) -> DataFrame:
    """All (ancestor, node, distance) below the nodes of `of` (column node), themselves included.

    A node carries the nodes of `of` above it, not its whole path.
    """
    parents = edges.where("parent is not null").select(F.col("parent").alias("child")).unionByName(of.select(F.col("node").alias("child"))).distinct()
    loose = parents.join(edges.select("child"), "child", "left_anti").select("child", F.lit(None).cast(edges.schema["child"].dataType).alias("parent"))
    marked = edges.select("child", "parent").unionByName(loose).join(of.select(F.col("node").alias("child"), F.lit(True).alias("_of")).distinct(), "child", "left")
    own = F.struct(F.when(F.col("_of"), F.array(F.struct(F.col("child").alias("ancestor"), F.lit(0).alias("distance")))).otherwise(F.array().cast(f"array<struct<ancestor:{edges.schema['child'].dataType.simpleString()},distance:int>>")).alias("found"), F.lit(1).alias("length"))

    def compose(upper: Column, own: Column) -> Column:
        moved = F.transform(upper.getField("found"), lambda x: F.struct(x.getField("ancestor").alias("ancestor"), (x.getField("distance") + own.getField("length")).alias("distance")))
        return F.struct(F.concat(moved, own.getField("found")).alias("found"), (upper.getField("length") + own.getField("length")).alias("length"))

    return _climb(marked, own, compose).select("node", F.explode("value.found").alias("_f")).select("_f.ancestor", "node", "_f.distance")


def path_between(paths: DataFrame, a, b) -> DataFrame:
    """One row: up (from a to below the common ancestor), common, down (to b), of two nodes of one tree."""
    x = paths.where(F.col("node") == F.lit(a)).select(F.col("path").alias("p"))
    y = paths.where(F.col("node") == F.lit(b)).select(F.col("path").alias("q"))
    shared = F.size(F.filter(F.zip_with("p", "q", lambda m, n: m.eqNullSafe(n)), lambda s: s))
    cut = x.crossJoin(y).withColumn("k", shared)  # one row each
    return cut.where("k > 0").select(F.reverse(F.slice("p", F.col("k") + 1, F.size("p"))).alias("up"), F.element_at("p", F.col("k")).alias("common"), F.slice("q", F.col("k") + 1, F.size("q")).alias("down"))


def tree_issues(edges: DataFrame) -> DataFrame:
    """One row: nodes, roots, nodes with several parents, and nodes that no root reaches (cycles, loose parts)."""
    nodes = edges.select("child").distinct()
    reached = root_paths(edges.dropDuplicates(["child"])).select("node").distinct()
    roots = edges.where("parent is null").agg(F.countDistinct("child").alias("n_roots"))
    several = edges.where("parent is not null").groupBy("child").agg(F.countDistinct("parent").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_several_parents"))
    lost = nodes.join(reached, nodes.child == reached.node, "left_anti").agg(F.count("*").alias("n_unreached"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(roots).crossJoin(several).crossJoin(lost)  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """Per node its number of children, and whether it is a leaf or a branch point."""
    below = edges.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    out = edges.select(F.col("child").alias("node")).distinct().join(below, F.col("node") == F.col("parent"), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("node", n.alias("n_children"), (n == 0).alias("is_leaf"), (n > 1).alias("is_branch"))


def closure(premises: DataFrame, seeds: DataFrame, settle=None, limit: int | None = None) -> DataFrame:
    """Everything the seeds (column node) rest on through premises (node, premise): a loop of joins with distinct.

    `settle` writes a step's table; without it, to the shared folder. The loop ends when nothing new is reached; a chain deeper than `limit` rounds, where one is given, is an error.
    """
    settle = settle or Scratch(premises.sparkSession).put
    reached = settle(seeds.select("node").distinct())
    front = reached
    for done in count():
        step = premises.join(front, "node").select(F.col("premise").alias("node")).distinct()
        front = settle(step.join(reached, "node", "left_anti"))
        if front.isEmpty():
            return reached
        if done == limit:
            raise ValueError(f"premises go on after {limit} rounds")
        reached = settle(reached.unionByName(front))


def _star(edges: DataFrame, scratch: Scratch, large: bool, merge: bool = False) -> DataFrame:
    """edges (u > v). Large: every greater neighbour of u goes to the least of u and its neighbours; small: the others, and u."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least.hint("merge") if merge else least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def linked_components(edges: DataFrame, scratch: Scratch, merge: bool = False) -> DataFrame:
    """(a, b) pairs to (node, component): every node that has an edge to another, and the least node it is joined with.

    Alternating large and small stars; rounds grow with the logarithm of the longest path. merge: never broadcast a side.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        step = scratch.put(_star(now, scratch, True, merge), "large")
        new = scratch.put(_star(step, scratch, False, merge), "small")
        scratch.drop(now, step)
        now = new
        # done when only stars are left: every node points once, and none that points is pointed at
        ends = F.array(F.struct(F.col("u").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("to")), F.struct(F.col("v").alias("k"), F.lit(0).alias("out"), F.lit(1).alias("to")))
        degrees = now.select(F.explode(ends).alias("e")).groupBy("e.k").agg(F.sum("e.out").alias("out"), F.max("e.to").alias("to"))
        if not degrees.agg(F.count_if(F.expr("out > 1 or out > 0 and to > 0"))).first()[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component): the least node of each component; a node joined only with itself is one."""
    edges = edges.where("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    found = linked_components(edges, Scratch(edges.sparkSession))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def affine_chain(edges: DataFrame) -> DataFrame:
    """edges (child, parent, multiplier, offset; null parent: a driver) to each node's driver and its value as multiplier * driver + offset."""
    root = F.col("parent").isNull()
    own = F.struct(F.col("child").alias("driver"), F.when(root, 1.0).otherwise(F.col("multiplier")).alias("multiplier"), F.when(root, 0.0).otherwise(F.col("offset")).alias("offset"))

    def compose(upper: Column, own: Column) -> Column:
        m = own.getField("multiplier")
        return F.struct(upper.getField("driver").alias("driver"), (m * upper.getField("multiplier")).alias("multiplier"), (m * upper.getField("offset") + own.getField("offset")).alias("offset"))

    return _climb(edges, own, compose).select("node", "value.*")


def driver_domain(limits: DataFrame) -> DataFrame:
    """(driver, multiplier, offset, lower, upper) of followers to each driver's feasible interval: all limits at once."""
    a, b = (F.col("lower") - F.col("offset")) / F.col("multiplier"), (F.col("upper") - F.col("offset")) / F.col("multiplier")
    out = limits.where("multiplier <> 0").groupBy("driver").agg(F.max(F.least(a, b)).alias("lower"), F.min(F.greatest(a, b)).alias("upper"))
    return out.withColumn("feasible", F.col("lower") <= F.col("upper"))


def forward_kinematics(joints: DataFrame, roots: DataFrame) -> DataFrame:
    """World transform of every link: roots (robot, link), joints (robot, parent, child, type, xyz, rpy, axis, value).

    Each joint's local transform is one expression; the products run down the tree by pointer doubling.
    """
    motion = F.when(F.col("type").isin("revolute", "continuous"), V.axis_angle_matrix(F.col("axis"), F.col("value"))).when(F.col("type") == "prismatic", V.translation_matrix(V.scaled(F.col("axis"), F.col("value")))).otherwise(V.vec(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1))
    local = joints.withColumn("_o", V.rpy_matrix(F.col("xyz"), F.col("rpy"))).withColumn("_m", motion).select("robot", "parent", "child", V.matmul4(F.col("_o"), F.col("_m")).alias("local"))
    key = lambda link: F.struct("robot", F.col(link).alias("link"))
    same = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    edges = local.select(key("child").alias("child"), key("parent").alias("parent"), F.struct(F.col("local").alias("world"), F.lit(1).alias("depth")).alias("_v"))
    tops = roots.select(key("link").alias("child"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), F.struct(same.alias("world"), F.lit(0).alias("depth")).alias("_v"))
    product = lambda a, b: F.struct(V.matmul4(a.getField("world"), b.getField("world")).alias("world"), (a.getField("depth") + b.getField("depth")).alias("depth"))
    return _climb(edges.unionByName(tops), F.col("_v"), product).select("node.*", "value.*")


def mass_properties(inertials: DataFrame, frames: DataFrame) -> DataFrame:
    """Per robot: mass, centre of mass in the world and inertia tensor (xx, xy, xz, yy, yz, zz) about it, by the parallel axis theorem."""
    joined = inertials.join(frames, ["robot", "link"]).withColumn("_t", V.matmul4(F.col("world"), V.rpy_matrix(F.col("xyz"), F.col("rpy"))))
    c = [F.col("_t")[3], F.col("_t")[7], F.col("_t")[11]]
    local = [[F.col("ixx"), F.col("ixy"), F.col("ixz")], [F.col("ixy"), F.col("iyy"), F.col("iyz")], [F.col("ixz"), F.col("iyz"), F.col("izz")]]
    r = [[F.col("_t")[4 * i + j] for j in range(3)] for i in range(3)]
    world = {(i, j): sum((r[i][a] * local[a][b] * r[j][b] for a in range(3) for b in range(3) if (a, b) != (0, 0)), r[i][0] * local[0][0] * r[j][0]) for i in range(3) for j in range(i, 3)}
    m = F.col("mass")
    sums = [F.sum(m).alias("mass"), *[F.sum(m * c[i]).alias(f"_s{i}") for i in range(3)]]
    sums += [F.sum(world[i, j] + m * ((sum((c[k] * c[k] for k in range(1, 3)), c[0] * c[0]) if i == j else F.lit(0.0)) - c[i] * c[j])).alias(f"_i{i}{j}") for i, j in world]
    out = joined.groupBy("robot").agg(*sums)
    for i, n in enumerate("xyz"):
        out = out.withColumn(f"com_{n}", F.col(f"_s{i}") / F.col("mass"))
    g = [F.col(f"com_{n}") for n in "xyz"]
    square = g[0] * g[0] + g[1] * g[1] + g[2] * g[2]
    names = {(0, 0): "ixx", (0, 1): "ixy", (0, 2): "ixz", (1, 1): "iyy", (1, 2): "iyz", (2, 2): "izz"}
    return out.select("robot", "mass", "com_x", "com_y", "com_z", *[(F.col(f"_i{i}{j}") - F.col("mass") * ((square if i == j else F.lit(0.0)) - g[i] * g[j])).alias(n) for (i, j), n in names.items()])


def jacobian(joints: DataFrame, frames: DataFrame, paths: DataFrame, target: str) -> DataFrame:
    """Columns of the geometric Jacobian at the target link: linear and angular velocity for each driver, mimic joints weighed by multiplier.

    joints also has driver and multiplier; paths (robot, link, path) are root paths of links.
    """
    on_path = paths.where(F.col("link") == target).select("robot", F.explode("path").alias("child"))
    point = frames.where(F.col("link") == target).select("robot", F.array(F.col("world")[3], F.col("world")[7], F.col("world")[11]).alias("_p"))
    at = joints.join(on_path, ["robot", "child"]).join(frames.select("robot", F.col("link").alias("child"), "world"), ["robot", "child"]).join(point, "robot")
    w, a = F.col("world"), F.col("axis")
    axis = F.array(*[w[4 * i] * a[0] + w[4 * i + 1] * a[1] + w[4 * i + 2] * a[2] for i in range(3)])
    arm = V.sub(F.col("_p"), F.array(w[3], w[7], w[11]))
    turn = F.col("type").isin("revolute", "continuous")
    rows = at.where(turn | (F.col("type") == "prismatic")).withColumn("_a", axis).withColumn("_l", F.when(turn, V.cross(F.col("_a"), arm)).otherwise(F.col("_a"))).withColumn("_w", F.when(turn, F.col("_a")).otherwise(V.vec(0, 0, 0)))
    return rows.groupBy("robot", "driver").agg(*[F.sum(F.col("multiplier") * F.col(c)[i]).alias(f"{n}_{'xyz'[i]}") for c, n in (("_l", "linear"), ("_w", "angular")) for i in range(3)])


def depth_first(edges: DataFrame, group: str) -> DataFrame:
    """edges (group, child, parent) to group, node, depth and position: each tree in depth-first order, children by name."""
    key = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("n"))
    paths = root_paths(edges.select(key("child").alias("child"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent")))
    rows = paths.select(F.col("node.g").alias(group), F.col("node.n").alias("node"), "depth", F.transform("path", lambda x: x.n).alias("_p"))
    return rows.select(group, "node", "depth", F.row_number().over(W.partitionBy(group).orderBy("_p")).alias("position"))


def serial_segments(edges: DataFrame) -> DataFrame:
    """head, last, n: maximal chains of nodes that each have one child, from a root or a branch's child to a leaf or a branch."""
    kids = edges.where("parent is not null").groupBy("parent").agg(F.count("*").alias("_k"))
    e = edges.join(kids, "parent", "left").withColumn("_head", F.col("parent").isNull() | (F.col("_k") > 1))
    own = F.struct(F.when(F.col("_head"), F.col("child")).alias("head"), F.lit(0).alias("at"))

    def compose(upper: Column, lower: Column) -> Column:
        return F.struct(F.coalesce(lower.getField("head"), upper.getField("head")).alias("head"), F.when(lower.getField("head").isNotNull(), lower.getField("at")).otherwise(upper.getField("at") + lower.getField("at") + 1).alias("at"))

    out = _climb(e.select("child", "parent", own.alias("_v")), F.col("_v"), compose).select("node", "value.*")
    return out.groupBy("head").agg(F.max_by("node", "at").alias("last"), F.count("*").alias("n"))
