"""Queries of the scene, geometry and atlas operators: a region is a scene, nations its frames, suppliers its objects, parts its boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import scene as S
from ..operators import solve as A
from .articulated import _FK, _ROBOT, _joints, _values
from .geometry import _POSE, _boxes, _poses
from .registry import micro, query, table

_HALF = "0.05::DOUBLE"  # half a nation's turn about z, times its key


def _pose(x, y, turn):
    """xyz and a quaternion about z from half the turn."""
    zero = F.lit(0.0)
    return F.array(x, y, zero).alias("xyz"), F.array(zero, zero, F.sin(turn), F.cos(turn)).alias("quaternion")


def _frames(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("scene"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("frame"), F.lit("world").alias("parent"), *_pose(F.col("n_nationkey") * 1.0, F.lit(2.0), F.col("n_nationkey") * 0.05))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("n_regionkey").alias("scene"), F.concat(F.lit("c"), F.col("c_custkey")).alias("frame"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), *_pose(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 10) * 1.0, (F.col("c_custkey") % 8) * 0.1))
    return n.unionByName(c)


def _robot(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("scene"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("robot"), F.lit("world").alias("parent"), *_pose(F.lit(1.0), F.col("r_regionkey") * 1.0, F.col("r_regionkey") * 0.15))


_SCENE = f"""WITH n AS (SELECT n_regionkey AS scene, 'n'||n_nationkey AS frame, n_nationkey::DOUBLE AS x, 2.0::DOUBLE AS y, 2*{_HALF}*n_nationkey AS th, n_nationkey FROM nation),
f AS (SELECT scene, 'world' AS frame, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS th FROM n GROUP BY ALL UNION ALL SELECT scene, frame, x, y, th FROM n
UNION ALL SELECT scene, 'c'||c_custkey, n.x+cos(th)*(c_acctbal/1000)-sin(th)*(c_custkey%10), n.y+sin(th)*(c_acctbal/1000)+cos(th)*(c_custkey%10), th+0.2::DOUBLE*(c_custkey%8) FROM customer JOIN n ON n_nationkey=c_nationkey)"""


@query(_SCENE + " SELECT scene::BIGINT AS scene, frame, floor(x*1e6+0.5)/1e6 AS x, floor(y*1e6+0.5)/1e6 AS y, floor(cos(th)*1e6+0.5)/1e6 AS c FROM f")
def scene_frames(spark, d):
    out = S.scene_frames(_frames(spark, d))
    return out.select(F.col("scene").cast("long").alias("scene"), "frame", micro(F.col("matrix")[3]).alias("x"), micro(F.col("matrix")[7]).alias("y"), micro(F.col("matrix")[0]).alias("c"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS scene FROM customer), f AS (SELECT scene, 'f'||k AS frame, CASE WHEN k%31=0 THEN 'nowhere' WHEN k%7=0 THEN 'f'||k WHEN k%5=0 THEN 'f'||(k+1) ELSE 'world' END AS parent FROM c UNION ALL SELECT scene, 'f'||k, 'world' FROM c WHERE k%37=0 UNION ALL SELECT scene, 'world', 'world' FROM c WHERE k%41=0),
n AS (SELECT *, count(*) OVER (PARTITION BY scene, frame) AS m FROM f), y AS (SELECT scene, frame FROM n WHERE parent=frame AND frame<>'world' AND m=1)
SELECT DISTINCT scene, frame, 'declared_twice' AS issue FROM n WHERE m > 1 UNION ALL SELECT scene, frame, 'world_declared' FROM n WHERE frame='world' UNION ALL SELECT scene, frame, 'unknown_parent' FROM n WHERE parent<>'world' AND (scene, parent) NOT IN (SELECT scene, frame FROM f) UNION ALL SELECT * FROM (SELECT scene, frame, 'cycle' FROM y UNION SELECT scene, frame, 'cycle' FROM n WHERE m=1 AND (scene, parent) IN (SELECT scene, frame FROM y))""")
def scene_validation(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("scene"))
    name = lambda x: F.concat(F.lit("f"), x)
    f = c.select("scene", name(F.col("k")).alias("frame"), F.when(F.col("k") % 31 == 0, "nowhere").when(F.col("k") % 7 == 0, name(F.col("k"))).when(F.col("k") % 5 == 0, name(F.col("k") + 1)).otherwise("world").alias("parent"))
    f = f.unionByName(c.where("k % 37 = 0").select("scene", name(F.col("k")).alias("frame"), F.lit("world").alias("parent"))).unionByName(c.where("k % 41 = 0").select("scene", F.lit("world").alias("frame"), F.lit("world").alias("parent")))
    # names declared twice have no one place: the cycle check takes either of them
    out = S.scene_issues(f)
    twice = f.groupBy("scene", "frame").agg(F.count("*").alias("m")).where("m > 1").select("scene", "frame", F.lit("cycle").alias("issue"))
    return out.join(twice, ["scene", "frame", "issue"], "left_anti")


@query(_SCENE + """, o AS (SELECT n.scene, 'scene_object/s'||s_suppkey AS entity, CASE WHEN s_suppkey%7=0 THEN 9.0 ELSE n.x+cos(th)*(s_acctbal/1000)-sin(th)*0.5 END AS x, CASE WHEN s_suppkey%7=0 THEN s_suppkey::DOUBLE ELSE n.y+sin(th)*(s_acctbal/1000)+cos(th)*0.5 END AS y FROM supplier JOIN n ON n_nationkey=s_nationkey),
r AS (SELECT r_regionkey AS scene, 'robot_frame/r'||r_regionkey||'/tip' AS entity, 1.0+cos(0.3::DOUBLE*r_regionkey)*2.0 AS x, r_regionkey+sin(0.3::DOUBLE*r_regionkey)*2.0 AS y FROM region), e AS (SELECT scene, 'scene_frame/'||frame AS entity, x, y FROM f UNION ALL SELECT * FROM o UNION ALL SELECT * FROM r)
SELECT scene::BIGINT AS scene, entity, floor(x*1e6+0.5)/1e6 AS x, floor(y*1e6+0.5)/1e6 AS y FROM e""")
def typed_world_frames(spark, d):
    n = table(spark, d, "nation")
    objects = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("scene"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("object"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("parent"), "s_suppkey", *_pose(F.col("s_acctbal") / 1000, F.lit(0.5), F.lit(0.0)))
    observed = objects.where("s_suppkey % 7 = 0").select("scene", F.concat(F.lit("scene_object/"), "object").alias("entity"), V.translation_matrix(F.array(F.lit(9.0), F.col("s_suppkey") * 1.0, F.lit(0.0))).alias("matrix"))
    links = _robot(spark, d).select("robot", F.lit("tip").alias("link"), V.translation_matrix(V.vec(2, 0, 0)).alias("world"))
    out = S.typed_frames(_frames(spark, d), objects.drop("s_suppkey"), _robot(spark, d), links, observed)
    return out.select(F.col("scene").cast("long").alias("scene"), "entity", micro(F.col("matrix")[3]).alias("x"), micro(F.col("matrix")[7]).alias("y"))


@query(_SCENE + ", g AS (SELECT scene, n_nationkey, CASE WHEN n_nationkey%5=0 THEN NULL ELSE 3.0::DOUBLE END AS gx, 4.0::DOUBLE AS gy, th FROM n) SELECT n_nationkey::BIGINT AS nation, floor((cos(th)*gx+sin(th)*gy)*1e6+0.5)/1e6 AS x, floor((-sin(th)*gx+cos(th)*gy)*1e6+0.5)/1e6 AS y, CASE WHEN gx IS NULL THEN NULL ELSE -9.0::DOUBLE END AS z FROM g")
def gravity_in_root(spark, d):
    at = S.scene_frames(_frames(spark, d)).where("frame like 'n%'").withColumn("nation", F.substring("frame", 2, 9).cast("long"))
    g = F.when(F.col("nation") % 5 != 0, V.vec(3, 4, -9))
    out = at.withColumn("g", S.gravity_in_root(F.col("matrix"), g))
    return out.select("nation", micro(F.col("g")[0]).alias("x"), micro(F.col("g")[1]).alias("y"), F.col("g")[2].alias("z"))


_ENV = """WITH r AS (SELECT s_nationkey%5 AS scene, 'link'||s_suppkey AS a, s_suppkey%4>0 AS exact, s_suppkey%19=0 AS lost, (s_suppkey%50)::DOUBLE AS x, 50+s_acctbal/300 AS y, (s_suppkey%47)::DOUBLE AS z FROM supplier),
p AS (SELECT p_partkey%5 AS scene, 'box'||p_partkey AS b, p_partkey%3>0 AS exact, p_size::DOUBLE AS x, p_retailprice/20 AS y, (p_partkey%50)::DOUBLE AS z FROM part),
j AS (SELECT r.scene, a, b, r.exact AND p.exact AS solid, sqrt(power(greatest(0.0,r.x-(p.x+1.5),p.x-(r.x+1.0)),2)+power(greatest(0.0,r.y-(p.y+1.5),p.y-(r.y+1.0)),2)+power(greatest(0.0,r.z-(p.z+1.5),p.z-(r.z+1.0)),2)) AS gap FROM r JOIN p USING (scene) WHERE NOT lost)"""


def _environment(spark, d):
    s = table(spark, d, "supplier")
    x, y, z = (F.col("s_suppkey") % 50) * 1.0, 50 + F.col("s_acctbal") / 300, (F.col("s_suppkey") % 47) * 1.0
    there = F.col("s_suppkey") % 19 != 0
    robot = s.select((F.col("s_nationkey") % 5).cast("long").alias("scene"), F.concat(F.lit("link"), F.col("s_suppkey")).alias("name"), F.when(there, F.array(x, y, z)).alias("lo"), F.when(there, F.array(x + 1.0, y + 1.0, z + 1.0)).alias("hi"), (F.col("s_suppkey") % 4 > 0).alias("exact"))
    scene = _boxes(spark, d).select((F.col("p_partkey") % 5).cast("long").alias("scene"), F.concat(F.lit("box"), F.col("p_partkey")).alias("name"), "lo", "hi", (F.col("p_partkey") % 3 > 0).alias("exact"))
    return robot, scene


@query(_ENV + " SELECT scene::BIGINT AS scene, a, b, floor(gap*1e6+0.5)/1e6 AS gap, CASE WHEN solid THEN 'collision' ELSE 'indeterminate' END AS status FROM j WHERE gap <= 0.5")
def environment_pairs(spark, d):
    return S.environment_collisions(*_environment(spark, d), 3.0, 0.5)[0].withColumn("gap", micro(F.col("gap")))


@query(_ENV + """, k AS (SELECT scene, count(*) FILTER (gap <= 0.5 AND solid) AS c, count(*) FILTER (gap <= 0.5 AND NOT solid) AS i FROM j GROUP BY ALL), s AS (SELECT scene, count(*) AS nr, count(*) FILTER (lost) AS lost FROM r GROUP BY ALL), t AS (SELECT scene, count(*) AS ns FROM p GROUP BY ALL)
SELECT scene::BIGINT AS scene, coalesce(nr,0)*coalesce(ns,0) AS n_pairs, coalesce(c,0) AS n_collisions, coalesce(i,0)+coalesce(lost,0)*coalesce(ns,0) AS n_indeterminate, CASE WHEN coalesce(nr,0)=0 OR coalesce(ns,0)=0 THEN 'not_applicable' WHEN c > 0 THEN 'collision' WHEN i > 0 OR lost > 0 THEN 'indeterminate' ELSE 'collision_free' END AS status FROM s FULL JOIN t USING (scene) LEFT JOIN k USING (scene)""")
def environment_collisions(spark, d):
    return S.environment_collisions(*_environment(spark, d), 3.0, 0.5)[1]


@query(_ENV + " SELECT scene::BIGINT AS scene, a, b, floor(gap*1e6+0.5)/1e6 AS gap FROM j QUALIFY row_number() OVER (PARTITION BY scene ORDER BY gap, a, b)=1")
def minimum_separation(spark, d):
    robot, scene = _environment(spark, d)
    return S.minimum_separation(robot.where("lo is not null"), scene, 1.0).withColumn("gap", micro(F.col("gap")))


_FACES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def _triangles(boxes, shift=0.0):
    at = lambda v, c: F.col("lo")[c] + (F.col("hi")[c] - F.col("lo")[c]) * (v >> c & 1) + (shift if c == 0 else 0.0)
    return F.array(*[F.array(*[at(v, c) for v in f for c in range(3)]) for f in _FACES])


@query("SELECT p_partkey, count(*)::BIGINT AS n_components, (p_partkey*100)::BIGINT AS least FROM (SELECT p_partkey, unnest(range(CASE WHEN p_partkey%3=0 THEN 1 ELSE 2 END)) FROM part) GROUP BY ALL")
def face_components(spark, d):
    """Each part is two boxes; of every third part they are the same box shifted by its width, so that they share corners."""
    b = _boxes(spark, d)
    two = b.select("p_partkey", F.posexplode(F.concat(_triangles(b), F.when(F.col("p_partkey") % 3 == 0, _triangles(b, 1.5)).otherwise(_triangles(b, 9.0)))).alias("i", "corners"))
    out = S.face_components(two.select("p_partkey", (F.col("p_partkey") * 100 + F.col("i")).alias("face"), "corners"), "p_partkey")
    return out.groupBy("p_partkey").agg(F.countDistinct("component").alias("n_components"), F.min("component").alias("least"))


@query("""SELECT p_partkey, k AS point, (p_size+0.3::DOUBLE*k-0.4 BETWEEN p_size AND p_size+1.5) AND (0.2::DOUBLE*k-0.1 BETWEEN 0 AND 1.5) AS inside FROM part, (SELECT unnest(range(9)) AS k)""")
def points_inside_surface(spark, d):
    b = _boxes(spark, d)
    k = F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>"))
    points = b.select("p_partkey", "lo", k.alias("point")).select("p_partkey", "point", F.array(F.col("lo")[0] + 0.3 * F.col("point") - 0.4, F.col("lo")[1] + 0.2 * F.col("point") - 0.1, F.col("lo")[2] + 0.7).alias("p"))
    faces = b.select("p_partkey", F.explode(_triangles(b)).alias("corners"))
    return S.inside_surface(points, faces, "p_partkey")


@query(_POSE + """, m AS (SELECT vec_id, qw*rx-qx*rw-qy*rz+qz*ry AS x, qw*ry+qx*rz-qy*rw-qz*rx AS y, qw*rz-qx*ry+qy*rx-qz*rw AS z, qw*rw+qx*rx+qy*ry+qz*rz AS w FROM p), s AS (SELECT *, sqrt(x*x+y*y+z*z) AS n, CASE WHEN w < 0 THEN -1 ELSE 1 END AS g FROM m)
SELECT vec_id, floor(2*atan2(n, abs(w))*1e6+0.5)/1e6 AS angle, floor(g*x/n*1e6+0.5)/1e6 AS x, floor(g*y/n*1e6+0.5)/1e6 AS y, floor(g*z/n*1e6+0.5)/1e6 AS z FROM s""")
def rotation_delta(spark, d):
    axis, angle = V.rotation_delta(F.col("q"), F.col("q2"))
    return _poses(spark, d).withColumn("a", axis).select("vec_id", micro(angle).alias("angle"), *[micro(F.col("a")[i]).alias("xyz"[i]) for i in range(3)])


_VIEW_SQL = ", ".join(f"{{'view': '{n}', " + ", ".join(f"'{c}': e[1]*{a[0]!r}::DOUBLE+e[2]*{a[1]!r}::DOUBLE+e[3]*{a[2]!r}::DOUBLE" for c, a in zip(("u", "v", "depth"), axes, strict=True)) + "}" for n, axes in V.VIEWS.items())


@query(_POSE + f", x AS (SELECT vec_id, unnest([{_VIEW_SQL}]) AS s FROM p) SELECT vec_id, s.view AS view, floor(s.u*1e6+0.5)/1e6 AS u, floor(s.v*1e6+0.5)/1e6 AS v, floor(s.depth*1e6+0.5)/1e6 AS depth FROM x")
def orthographic_projection(spark, d):
    out = _poses(spark, d).select("vec_id", F.explode(V.projections(F.col("p"))).alias("s"))
    return out.select("vec_id", "s.view", *[micro(F.col(f"s.{c}")).alias(c) for c in ("u", "v", "depth")])


_SCALES, _PERIODIC = [0.5, 2.0, 1.0], [False, True, True]


@query(_POSE + """, x AS (SELECT a.vec_id, (a.e[1]-b.e[1])/0.5 AS d1, a.e[2]*20-b.e[2]*20 AS r2, a.e[3]*20-b.e[3]*20 AS r3 FROM p a JOIN p b ON b.vec_id=a.vec_id+1), y AS (SELECT vec_id, d1, (r2+pi())-floor((r2+pi())/(2*pi()))*2*pi()-pi() AS d2, (r3+pi())-floor((r3+pi())/(2*pi()))*2*pi()-pi() AS d3 FROM x) SELECT vec_id, floor(sqrt(d1*d1+d2*d2/4+d3*d3)*1e6+0.5)/1e6 AS distance FROM y""")
def weighted_configuration_distance(spark, d):
    e = _poses(spark, d).select("vec_id", F.array(F.col("e")[0], F.col("e")[1] * 20, F.col("e")[2] * 20).alias("a"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return j.select("vec_id", micro(V.configuration_distance(F.col("a"), F.col("b"), _SCALES, _PERIODIC)).alias("distance"))


_INERTIA = _POSE + """, i AS (SELECT vec_id, CASE WHEN vec_id%17=0 THEN NULL WHEN vec_id%13=0 THEN -1.0 ELSE 1.0 END AS mass, 0.3+abs(e[1]) AS xx, e[2]/3 AS xy, e[3]/3 AS xz, 0.25+abs(e[4]) AS yy, e[5]/3 AS yz, 0.2+e[6] AS zz FROM p),
t AS (SELECT *, (xx+yy+zz)/3 AS m FROM i), s AS (SELECT *, sqrt(((xx-m)*(xx-m)+(yy-m)*(yy-m)+(zz-m)*(zz-m)+2*(xy*xy+xz*xz+yz*yz))/6) AS s FROM t),
h AS (SELECT *, ((xx-m)*((yy-m)*(zz-m)-yz*yz)-xy*(xy*(zz-m)-yz*xz)+xz*(xy*yz-(yy-m)*xz))/(s*s*s)/2 AS h FROM s), k AS (SELECT *, acos(greatest(-1.0,least(1.0,h)))/3 AS a FROM h), g AS (SELECT *, m+2*s*cos(a) AS e3, m+2*s*cos(a+2*pi()/3) AS e1 FROM k)"""


@query(_INERTIA + " SELECT vec_id, floor(e1*1e6+0.5)/1e6 AS least, floor(e3*1e6+0.5)/1e6 AS greatest, CASE WHEN mass IS NULL THEN 'missing' WHEN NOT mass > 0 THEN 'bad_mass' WHEN e1 < -1e-9*greatest(1.0,abs(e3)) THEN 'not_positive' WHEN e3 > 3*m-e3+1e-9*greatest(1.0,abs(e3)) THEN 'triangle' ELSE 'valid' END AS state FROM g")
def inertia_validation(spark, d):
    e = lambda i: F.col("e")[i]
    m = F.array(0.3 + F.abs(e(0)), e(1) / 3, e(2) / 3, 0.25 + F.abs(e(3)), e(4) / 3, 0.2 + e(5))
    mass = F.when(F.col("vec_id") % 17 == 0, F.lit(None).cast("double")).when(F.col("vec_id") % 13 == 0, -1.0).otherwise(1.0)
    out = _poses(spark, d).withColumn("m", m).withColumn("v", V.symmetric_eigenvalues(F.col("m")))
    return out.select("vec_id", micro(F.col("v")[0]).alias("least"), micro(F.col("v")[2]).alias("greatest"), V.inertia_state(mass, F.col("m")).alias("state"))


@query(_ROBOT + _FK + """, z AS (SELECT a.robot, a.i, (a.i+4)%4 AS k, cos(a.th)*(b.x-a.x)+sin(a.th)*(b.y-a.y) AS x, -sin(a.th)*(b.x-a.x)+cos(a.th)*(b.y-a.y) AS y, b.th-a.th AS t FROM w a JOIN w b ON a.robot=b.robot AND b.i=a.i+2),
r AS (SELECT robot, i, k, CASE k WHEN 0 THEN [sqrt(x*x+y*y)-2.5] WHEN 1 THEN [x, y, 0.0, 0.0, 0.0, t] WHEN 2 THEN [x, y, 0.0, 0.0, 0.0] ELSE [0.0, -y, 0.0, 0.0, t] END AS v FROM z)
SELECT robot, i, len(v)::BIGINT AS n, floor(sqrt(list_sum(list_transform(v, lambda q: q*q)))*1e5+0.5)/1e5 AS size FROM r""")
def constraint_residuals(spark, d):
    """Residuals between links two apart: a distance, a fixed joint, a revolute one about z, and a prismatic one along x."""
    from ..operators import models as M

    j = _joints(spark, d)
    at = M.evaluate_grammar(*M.grammar(j), _values(j)).withColumn("i", F.when(F.col("frame") == "base", -1).otherwise(F.substring("frame", 2, 9).cast("int")).cast("long"))
    pair = at.select("robot", "i", F.col("world").alias("a")).join(at.select("robot", (F.col("i") - 2).alias("i"), F.col("world").alias("b")), ["robot", "i"])
    k = (F.col("i") + 4) % 4
    kind = F.when(k == 0, "point_distance").when(k == 1, "fixed").when(k == 2, "revolute").otherwise("prismatic")
    axis = F.when(k == 3, V.vec(1, 0, 0)).otherwise(V.vec(0, 0, 1))
    out = pair.withColumn("_axis", axis).withColumn("v", V.constraint_residuals(kind, F.col("a"), F.col("b"), F.col("_axis"), F.col("_axis"), F.lit(2.5)))
    return out.select("robot", "i", F.size("v").cast("long").alias("n"), (F.floor(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) * 1e5 + 0.5) / 1e5).alias("size"))


# A point on a circle, its first coordinate held: two solutions, which meet where that is the radius.


def _atlas(spark, d):
    n = table(spark, d, "nation")
    r = 1.0 + F.col("n_nationkey") / 10.0
    charts = n.select(F.col("n_nationkey").alias("chart"), r.alias("radius"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k * 0.1 * r).alias("samples"), F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(0.9))).alias("seeds"))
    return A.configuration_atlas(charts, lambda x, p: [x[0] ** 2 + x[1] ** 2 - p["radius"] ** 2], [-9.0, -9.0], [9.0, 9.0], 0, [1.0, 1.0], 1e-6, ("radius",))


_CIRCLE = "WITH c AS (SELECT n_nationkey AS chart, 1.0+n_nationkey/10.0::DOUBLE AS r, unnest(range(9)) AS k FROM nation), n AS (SELECT chart, k AS sample, r, node, 0.1::DOUBLE*k*r AS x, (2*node-1)*sqrt(r*r-0.01::DOUBLE*k*k*r*r) AS y FROM c, (SELECT unnest([0,1]) AS node))"


@query(_CIRCLE + " SELECT chart::BIGINT AS chart, sample::INT AS sample, node::INT AS node, floor(x*1e5+0.5)/1e5 AS x, floor(y*1e5+0.5)/1e5 AS y, 1::INT AS rank, false AS mechanism_drop FROM n")
def configuration_atlas(spark, d):
    five = lambda c: F.floor(c * 1e5 + 0.5) / 1e5
    out = A.rank_drops(_atlas(spark, d))
    return out.select(F.col("chart").cast("long").alias("chart"), "sample", "node", five(F.col("position")[0]).alias("x"), five(F.col("position")[1]).alias("y"), "rank", "mechanism_drop")


@query(_CIRCLE + " SELECT a.chart::BIGINT AS chart, a.sample::INT AS sample, a.node::INT AS a, b.node::INT AS b, floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*1e5+0.5)/1e5 AS distance FROM n a JOIN n b ON a.chart=b.chart AND b.sample=a.sample+1 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.5")
def configuration_atlas_edges(spark, d):
    out = A.atlas_edges(_atlas(spark, d), [1.0, 1.0], [False, False], 0.5)
    return out.select(F.col("chart").cast("long").alias("chart"), "sample", "a", "b", (F.floor(F.col("distance") * 1e5 + 0.5) / 1e5).alias("distance"))


@query("WITH o AS (SELECT o_orderkey, o_totalprice AS p, 1.0+(o_orderkey%5) AS a FROM orders) SELECT o_orderkey, floor(sqrt(p/1000/a)*1e5+0.5)/1e5 AS x, true AS solved, 1::INT AS rank FROM o")
def constraint_solve(spark, d):
    """a x^2 = b for x above 0, for every order: one small problem a row."""
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.lit(5.0)).alias("start"), (1.0 + F.col("o_orderkey") % 5).alias("a"), (F.col("o_totalprice") / 1000).alias("b"))
    out = A.solve_rows(o, "o_orderkey", lambda x, p: [p["a"] * x[0] ** 2 - p["b"]], [0.01], [1000.0], ("a", "b"))
    return out.select("o_orderkey", (F.floor(F.col("solution")[0] * 1e5 + 0.5) / 1e5).alias("x"), "solved", "rank")
