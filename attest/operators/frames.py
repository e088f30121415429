"""Frame trees in time: the transform along a path at given times, with every edge fresh, and checks of transform streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from .temporal import asof

_IDENTITY = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def pose_matrix(xyz, q):
    """Rigid matrix of a position and a unit quaternion."""
    x, y, z, w = (q[i] for i in range(4))
    return V.vec(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), xyz[0], 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), xyz[1], 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), xyz[2], 0, 0, 0, 1)


def path_at(edges: DataFrame, path: DataFrame, queries: DataFrame, max_age: int) -> DataFrame:
    """queries (query_id, t) with the product of a path's edges at their time.

    edges: child, parent, static, t, xyz, quaternion, record_id. path: position (from the root), child. Each moving edge is the
    latest at or before t; static ones never age. status: missing, stale or current over all edges, matrix where current.
    """
    asked = queries.crossJoin(F.broadcast(path)).select("query_id", "t", "position", "child")  # a path is a few edges
    local = edges.withColumn("matrix", pose_matrix(F.col("xyz"), V.quaternion(F.col("quaternion")))).select("child", F.when(F.col("static"), F.lit(-(2**62))).otherwise(F.col("t")).alias("t"), "record_id", "matrix", "static")
    found = asof(asked, local, ["child"], "t", "record_id", ["matrix", "static"])
    state = F.when(F.col("asof_status") == "missing", 0).when(~F.col("asof_static") & (F.col("asof_age") > max_age), 1).otherwise(2)
    rows = found.withColumn("_s", state).groupBy("query_id", "t").agg(F.min("_s").alias("_s"), F.array_sort(F.collect_list(F.struct("position", "asof_matrix"))).alias("_m"))
    product = F.aggregate("_m", V.vec(*_IDENTITY), lambda acc, x: V.matmul4(acc, x.asof_matrix))
    return rows.select("query_id", "t", F.when(F.col("_s") == 0, "missing").when(F.col("_s") == 1, "stale").otherwise("current").alias("status"), F.when(F.col("_s") == 2, product).alias("matrix"))


def stream_issues(edges: DataFrame) -> DataFrame:
    """(child, issue): several parents, several publishers, static and moving at once, or two values at one time."""
    per = edges.groupBy("child").agg(F.countDistinct("parent").alias("p"), F.countDistinct("publisher").alias("a"), F.countDistinct("static").alias("s"))
    twice = edges.where("not static").groupBy("child", "t").agg(F.countDistinct(F.to_json(F.struct("xyz", "quaternion"))).alias("v")).where("v > 1").select("child").distinct().withColumn("issue", F.lit("conflicting_values"))
    named = F.filter(F.array(F.when(F.col("p") > 1, F.lit("several_parents")), F.when(F.col("a") > 1, F.lit("several_publishers")), F.when(F.col("s") > 1, F.lit("static_and_moving"))), lambda x: x.isNotNull())
    return per.select("child", F.explode(named).alias("issue")).unionByName(twice)
