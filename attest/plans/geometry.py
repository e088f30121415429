"""Queries of the spatial operators: quantity, discount and tax of a line as a point, embeddings as poses and keypoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import vec as V
from ..operators import boxes as B
from .registry import micro, query, table

LINE = [[0.0, 0.0], [20.0, 0.05], [50.0, 0.02]]


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", V.vec(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100).alias("p"))


def _poses(spark, d):
    """Positions, and quaternions made from other components."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    return v.select("vec_id", F.slice("e", 1, 3).alias("p"), V.quaternion(F.slice("e", 4, 4)).alias("q"), F.slice("e", 8, 3).alias("p2"), V.quaternion(F.slice("e", 11, 4)).alias("q2"), "e")


_POSE = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]+e[7]*e[7]) AS n1, sqrt(e[11]*e[11]+e[12]*e[12]+e[13]*e[13]+e[14]*e[14]) AS n2 FROM e),
p AS (SELECT vec_id, e, e[4]/n1 AS qx, e[5]/n1 AS qy, e[6]/n1 AS qz, e[7]/n1 AS qw, e[11]/n2 AS rx, e[12]/n2 AS ry, e[13]/n2 AS rz, e[14]/n2 AS rw FROM n)"""


@query("""WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS x, l_discount*100 AS y, l_tax*100 AS z FROM lineitem) SELECT l_orderkey, count(*) FILTER (x BETWEEN 10 AND 40 AND y BETWEEN 2 AND 8 AND z BETWEEN 0 AND 5) AS n_inside, count(*) AS n FROM p GROUP BY ALL""")
def region_aabb(spark, d):
    return _lines(spark, d).groupBy("l_orderkey").agg(F.count_if(B.inside_box(F.col("p"), [10, 2, 0], [40, 8, 5])).alias("n_inside"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_orderkey, l_quantity-25.0 AS x, l_discount*100-5.0 AS y, l_tax*100-4.0 AS z FROM lineitem) SELECT l_orderkey, count(*) FILTER (sqrt(x*x+y*y+z*z) <= 10) AS n_inside FROM p GROUP BY ALL""")
def region_sphere(spark, d):
    return _lines(spark, d).groupBy("l_orderkey").agg(F.count_if(B.inside_sphere(F.col("p"), [25, 5, 4], 10)).alias("n_inside"))


_SEG = "sqrt(({x}-({ax}+{t}*({bx}-{ax})))*({x}-({ax}+{t}*({bx}-{ax})))+({y}-({ay}+{t}*({by}-{ay})))*({y}-({ay}+{t}*({by}-{ay}))))"


def _seg(a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x-{a[0]}::DOUBLE)*{dx}::DOUBLE+(y-{a[1]}::DOUBLE)*{dy}::DOUBLE)/({dx * dx + dy * dy}::DOUBLE)))"
    return _SEG.format(x="x", y="y", ax=f"{a[0]}::DOUBLE", ay=f"{a[1]}::DOUBLE", bx=f"{b[0]}::DOUBLE", by=f"{b[1]}::DOUBLE", t=t)


_CORRIDOR = [[0.0, 0.0], [20.0, 8.0], [50.0, 2.0]]


@query(f"""WITH p AS (SELECT l_orderkey, l_quantity AS x, l_discount*100 AS y FROM lineitem) SELECT l_orderkey, bool_and(least({_seg(_CORRIDOR[0], _CORRIDOR[1])}, {_seg(_CORRIDOR[1], _CORRIDOR[2])}) <= 4.0) AS stayed FROM p GROUP BY ALL""")
def corridor_polyline(spark, d):
    return _lines(spark, d).groupBy("l_orderkey").agg(F.bool_and(B.inside_corridor(F.col("p"), _CORRIDOR, 4.0)).alias("stayed"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT ((least(l_partkey % 7, l_suppkey % 7), greatest(l_partkey % 7, l_suppkey % 7)) IN ((0,1),(2,3),(4,4))) GROUP BY ALL""")
def no_forbidden_pair(spark, d):
    exempt = spark.createDataFrame([(0, 1), (3, 2), (4, 4)], "a long, b long").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    li = _lines(spark, d).withColumn("x", F.least(F.col("l_partkey") % 7, F.col("l_suppkey") % 7)).withColumn("y", F.greatest(F.col("l_partkey") % 7, F.col("l_suppkey") % 7))
    return li.join(F.broadcast(exempt), ["x", "y"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(_POSE + " SELECT vec_id, floor(2*acos(least(1.0, abs(qx*rx+qy*ry+qz*rz+qw*rw)))*1e6+0.5)/1e6 AS angle FROM p")
def quaternion_angle(spark, d):
    return _poses(spark, d).select("vec_id", micro(V.angle(F.col("q"), F.col("q2"))).alias("angle"))


_ROT = """, r AS (SELECT *, 2*({y}*{vz}-{z}*{vy}) AS tx, 2*({z}*{vx}-{x}*{vz}) AS ty, 2*({x}*{vy}-{y}*{vx}) AS tz FROM p)
SELECT vec_id, floor(({vx}+{w}*tx+({y}*tz-{z}*ty))*1e6+0.5)/1e6 AS x, floor(({vy}+{w}*ty+({z}*tx-{x}*tz))*1e6+0.5)/1e6 AS y, floor(({vz}+{w}*tz+({x}*ty-{y}*tx))*1e6+0.5)/1e6 AS z FROM r"""


@query(_POSE + _ROT.format(x="qx", y="qy", z="qz", w="qw", vx="e[8]", vy="e[9]", vz="e[10]"))
def rotate_vector(spark, d):
    r = V.rotate(F.col("q"), F.col("p2"))
    return _poses(spark, d).select("vec_id", *[micro(r[i]).alias("xyz"[i]) for i in range(3)])


@query(_POSE + _ROT.format(x="(-qx)", y="(-qy)", z="(-qz)", w="qw", vx="(e[8]-e[1])", vy="(e[9]-e[2])", vz="(e[10]-e[3])"))
def relative_pose(spark, d):
    r = V.relative_position(F.col("p"), F.col("q"), F.col("p2"))
    return _poses(spark, d).select("vec_id", *[micro(r[i]).alias("xyz"[i]) for i in range(3)])


@query(_POSE + """, z AS (SELECT vec_id, e[8]-e[1] AS x, e[9]-e[2] AS y, e[10]-e[3] AS z, e[10]-e[3] AS depth FROM p) SELECT vec_id, floor(depth*1e6+0.5)/1e6 AS depth, floor(sqrt(x*x+y*y)*1e6+0.5)/1e6 AS aside FROM z""")
def insertion_depth(spark, d):
    axis = V.vec(0, 0, 1)
    p = _poses(spark, d).withColumn("v", V.sub(F.col("p2"), F.col("p")))
    depth = V.dot(F.col("v"), axis)
    return p.select("vec_id", micro(depth).alias("depth"), micro(V.norm(V.sub(F.col("v"), V.scaled(axis, depth)))).alias("aside"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), k AS (SELECT vec_id, list_transform(range(20), lambda i: abs(e[3*i+1]) <= 0.15 AND abs(e[3*i+2]) <= 0.15 AND abs(e[3*i+3]) <= 0.15) AS k FROM e) SELECT vec_id, len(list_filter(k, lambda x: x))/20.0::DOUBLE AS fraction, len(list_filter(k, lambda x: x))/20.0::DOUBLE >= 0.5 AS inside FROM k""")
def keypoint_fraction(spark, d):
    e = _poses(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.slice("e", 3 * i + 1, 3)).alias("k"))
    share = F.size(F.filter("k", lambda k: B.inside_box(k, [-0.15] * 3, [0.15] * 3))) / F.size("k")
    return e.select("vec_id", share.alias("fraction"), (share >= 0.5).alias("inside"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), k AS (SELECT vec_id, list_transform(range(10), lambda i: sqrt((e[3*i+1]-e[3*i+31])*(e[3*i+1]-e[3*i+31])+(e[3*i+2]-e[3*i+32])*(e[3*i+2]-e[3*i+32])+(e[3*i+3]-e[3*i+33])*(e[3*i+3]-e[3*i+33]))) AS d FROM e)
SELECT vec_id, floor(sqrt(list_sum(list_transform(d, lambda x: x*x))/10)*1e6+0.5)/1e6 AS rmse, floor(list_max(d)*1e6+0.5)/1e6 AS worst FROM k""")
def keypoint_rmse(spark, d):
    e = _poses(spark, d)
    points = lambda at: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.slice("e", 3 * i + at, 3))
    k = e.select("vec_id", F.zip_with(points(1), points(31), lambda a, b: V.distance(a, b)).alias("k"))
    return k.select("vec_id", micro(F.sqrt(F.aggregate("k", F.lit(0.0), lambda a, x: a + x * x) / 10)).alias("rmse"), micro(F.array_max("k")).alias("worst"))


@query(_POSE + """, c AS (SELECT vec_id, (e[1]*e[8]+e[2]*e[9]+e[3]*e[10])/(sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3])*sqrt(e[8]*e[8]+e[9]*e[9]+e[10]*e[10])) AS c FROM p) SELECT vec_id, acos(greatest(-1.0, least(1.0, c))) <= 1.0 AS within FROM c""")
def direction_cone(spark, d):
    c = V.dot(F.col("p"), F.col("p2")) / (V.norm(F.col("p")) * V.norm(F.col("p2")))
    return _poses(spark, d).select("vec_id", (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) <= 1.0).alias("within"))


def _boxes(spark, d):
    """A box per part: size and price as place, brand group as link."""
    p = table(spark, d, "part")
    x, y, z = F.col("p_size").cast("double"), F.col("p_retailprice") / 20, (F.col("p_partkey") % 50).cast("double")
    return p.select("p_partkey", "p_brand", F.array(x, y, z).alias("lo"), F.array(x + 1.5, y + 1.5, z + 1.5).alias("hi"))


_BOX = """WITH b AS (SELECT p_partkey AS k, p_brand AS g, p_size::DOUBLE AS x, p_retailprice/20 AS y, (p_partkey % 50)::DOUBLE AS z FROM part),
j AS (SELECT a.k AS a, b.k AS b, greatest(0.0, a.x-(b.x+1.5), b.x-(a.x+1.5)) AS dx, greatest(0.0, a.y-(b.y+1.5), b.y-(a.y+1.5)) AS dy, greatest(0.0, a.z-(b.z+1.5), b.z-(a.z+1.5)) AS dz FROM b a JOIN b b ON a.k < b.k AND a.g <> b.g)"""


@query(_BOX + " SELECT a, b FROM j WHERE dx=0 AND dy=0 AND dz=0")
def aabb_overlap_pairs(spark, d):
    return B.overlap_pairs(_boxes(spark, d), "p_partkey", 3.0, group="p_brand").select("a", "b")


@query(_BOX + " SELECT a, b, floor(sqrt(dx*dx+dy*dy+dz*dz)*1e6+0.5)/1e6 AS gap FROM j WHERE sqrt(dx*dx+dy*dy+dz*dz) <= 1.0 AND sqrt(dx*dx+dy*dy+dz*dz) > 0 ORDER BY sqrt(dx*dx+dy*dy+dz*dz), a, b LIMIT 20")
def aabb_gap_topk(spark, d):
    out = B.overlap_pairs(_boxes(spark, d), "p_partkey", 3.0, group="p_brand", tolerance=1.0).where("gap > 0")
    return out.orderBy("gap", "a", "b").limit(20).select("a", "b", micro(F.col("gap")).alias("gap"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_nationkey::DOUBLE AS x, s_acctbal/1000 AS y FROM supplier) SELECT a.k AS a, b.k AS b, floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*1e6+0.5)/1e6 AS distance FROM p a JOIN p b ON a.k < b.k AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 1.0""")
def distance_threshold_pairs(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000).alias("p"))
    return B.distance_pairs(p, "k", "p", 1.0, n=2).select("a", "b", micro(F.col("distance")).alias("distance"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS p FROM embeddings), j AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, sqrt((a.p[1]-b.p[1])*(a.p[1]-b.p[1])+(a.p[2]-b.p[2])*(a.p[2]-b.p[2])+(a.p[3]-b.p[3])*(a.p[3]-b.p[3])) AS d FROM e a JOIN e b ON a.label=b.label AND a.vec_id < b.vec_id)
SELECT label::BIGINT AS label, a, b, floor(d*1e6+0.5)/1e6 AS distance FROM j QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, a, b)=1""")
def nearest_pair(spark, d):
    """Of each label the two nearest points."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("p"))
    return B.nearest_pairs(e, "label", "vec_id", "p").withColumn("distance", micro(F.col("distance")))


@query("""SELECT l_suppkey, floor(sum((l_quantity*100)::BIGINT * l_partkey)::DOUBLE/sum((l_quantity*100)::BIGINT)*1e3+0.5)/1e3 AS centre, sum(l_quantity)::BIGINT AS mass FROM lineitem GROUP BY ALL""")
def weighted_centroid(spark, d):
    w = (F.col("l_quantity") * 100).cast("long")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.floor(F.sum(w * F.col("l_partkey")).cast("double") / F.sum(w) * 1e3 + 0.5) / 1e3).alias("centre"), F.sum("l_quantity").cast("long").alias("mass"))


@query("""SELECT l_suppkey, sum(l_quantity::BIGINT*l_linenumber*l_linenumber)::BIGINT AS ixx, sum(l_quantity::BIGINT*l_linenumber*(l_partkey%10))::BIGINT AS ixy FROM lineitem GROUP BY ALL""")
def second_moment(spark, d):
    q, x, y = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey") % 10
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(q * x * x).alias("ixx"), F.sum(q * x * y).alias("ixy"))


@query("""WITH f AS (SELECT l_orderkey AS driver, CASE WHEN l_linenumber%2=0 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END AS m, l_linenumber::DOUBLE AS o, -l_quantity AS lo, l_quantity AS hi FROM lineitem)
SELECT driver, max(least((lo-o)/m,(hi-o)/m)) AS lower, min(greatest((lo-o)/m,(hi-o)/m)) AS upper, max(least((lo-o)/m,(hi-o)/m)) <= min(greatest((lo-o)/m,(hi-o)/m)) AS feasible FROM f GROUP BY ALL""")
def interval_intersection(spark, d):
    from ..operators.graphs import driver_domain

    li = table(spark, d, "lineitem")
    return driver_domain(li.select(F.col("l_orderkey").alias("driver"), F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(-2.0).alias("multiplier"), F.col("l_linenumber").cast("double").alias("offset"), (-F.col("l_quantity")).alias("lower"), F.col("l_quantity").alias("upper")))


@query("""WITH h AS (SELECT vec_id, vec_id % 8 AS i FROM embeddings) SELECT vec_id, CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.75 WHEN 4 THEN 0.125 WHEN 5 THEN 0.625 WHEN 6 THEN 0.375 ELSE 0.875 END::DOUBLE AS x FROM h""")
def halton_digits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", N.radical_inverse(F.col("vec_id") % 8, 2).alias("x"))


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type='click'), v AS (SELECT event_id AS vid, user_id, epoch_us(ts) AS t FROM events WHERE event_type='view') SELECT event_id, vid FROM c JOIN v USING (user_id) WHERE abs(c.t-v.t) <= 3600000000""")
def band_join_near_times(spark, d):
    from .registry import events

    ev = events(spark, d)
    return B.band_join(ev.where("event_type='click'").select("event_id", "user_id", "t"), ev.where("event_type='view'").select(F.col("event_id").alias("vid"), "user_id", "t"), ["user_id"], "t", 3_600_000_000).select("event_id", "vid")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate)//86400000000 AS s, epoch_us(o_orderdate)//86400000000 + (o_orderkey % 40) AS e FROM orders) SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM o a JOIN o b ON a.o_custkey=b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e""")
def interval_overlap_join(spark, d):
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))")
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("a"), day.alias("start")).withColumn("end", F.col("start") + F.col("a") % 40)
    other = o.select("o_custkey", F.col("a").alias("b"), F.col("start").alias("right_start"), F.col("end").alias("right_end"))
    return B.interval_overlap(o, other, ["o_custkey"], 40).where("a < b").select("a", "b")


@query(_BOX + " SELECT a, b, floor(sqrt(dx*dx+dy*dy+dz*dz)*1e6+0.5)/1e6 AS distance FROM j WHERE sqrt(dx*dx+dy*dy+dz*dz) <= 1.0")
def mesh_distance(spark, d):
    """Surface distances of boxes made of twelve triangles, for pairs of parts that are near: equal boxes cannot hold each other, so it is the boxes' gap."""
    corners = [[i & 1, i >> 1 & 1, i >> 2 & 1] for i in range(8)]
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    tri = F.array(*[F.array(*[F.col("lo")[c] + 1.5 * corners[v][c] for v in f for c in range(3)]) for f in faces])
    triangles = _boxes(spark, d).select(F.col("p_partkey").alias("geometry_id"), "p_brand", F.explode(tri).alias("corners"))
    return B.near_mesh_distances(triangles, 3.0, 1.0, group="p_brand").select("a", "b", micro(F.col("distance")).alias("distance"))


_POINTS = "WITH p AS (SELECT l_orderkey, l_partkey, l_quantity AS x, l_discount*100 AS y, l_tax*100 AS z FROM lineitem)"


@query(_POINTS + """ SELECT l_orderkey, count(*) AS n, min(x) AS min_x, max(x) AS max_x, (min(y)+max(y))/2 AS centre_y, max(z)-min(z) AS extent_z FROM p GROUP BY ALL""")
def point_summary(spark, d):
    from ..operators.shapes import summary

    return summary(_lines(spark, d), ["l_orderkey"], "p").select("l_orderkey", "n", "min_x", "max_x", "centre_y", "extent_z")


@query(_POINTS + """ SELECT l_orderkey, arg_min(l_partkey, (x, l_partkey)) AS least_x, arg_min(l_partkey, (-x, l_partkey)) AS greatest_x, arg_min(l_partkey, (z, l_partkey)) AS least_z FROM p GROUP BY ALL""")
def extreme_landmarks(spark, d):
    from ..operators.shapes import landmarks

    return landmarks(_lines(spark, d), ["l_orderkey"], "p", "l_partkey").select("l_orderkey", "least_x", "greatest_x", "least_z")


@query(_POINTS + """, e AS (SELECT l_orderkey, list_sort([max(x)-min(x), max(y)-min(y), max(z)-min(z)]) AS e FROM p GROUP BY ALL) SELECT l_orderkey, CASE WHEN e[3] <= 0 THEN 'point' WHEN e[1]/e[3] >= 0.8 THEN 'compact' WHEN e[2]/e[3] < 0.2 THEN 'rod' WHEN e[1]/e[2] < 0.2 THEN 'plate' ELSE 'block' END AS shape FROM e""")
def shape_classes(spark, d):
    from ..operators.shapes import shape_class, summary

    s = summary(_lines(spark, d), ["l_orderkey"], "p")
    return s.select("l_orderkey", shape_class(F.array("extent_x", "extent_y", "extent_z")).alias("shape"))
