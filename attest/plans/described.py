"""Queries of descriptions and dynamics: the planar robots written as XML and read again, meshes as files, masses and loads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import vec as V
from ..operators import boxes as B
from ..operators import graphs as G
from ..operators import models as M
from ..operators import shapes as S
from ..sources import meshes as H
from ..sources import robots as R
from .articulated import _FK, _HEAP, _ROBOT, _STEP, _joints, _values
from .geometry import _boxes, _poses
from .registry import EV, events, micro, query, table


def _documents(spark, d):
    """One document per robot; some of them broken, templates or with two roots."""
    j = _joints(spark, d)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    link = text('<link name="', F.col("child"), '"><inertial><origin xyz="0.5 0 0"/><mass value="', 1 + F.col("k") % 3, '"/><inertia ixx="0.01" iyy="0.02" izz="0.03" ixy="0" ixz="0" iyz="0"/></inertial></link>')
    limit = F.when(F.col("type") != "fixed", text('<axis xyz="', F.array_join(F.transform("axis", lambda x: x.cast("string")), " "), '"/><limit lower="', F.col("lower"), '" upper="', F.col("upper"), '" effort="9" velocity="2"/>')).otherwise("")
    mimic = F.when(F.col("mimic").isNotNull(), text('<mimic joint="', F.col("mimic"), '" multiplier="0.5" offset="0.1"/>')).otherwise("")
    joint = text('<joint name="', F.col("joint"), '" type="', F.col("type"), '"><parent link="', F.col("parent"), '"/><child link="', F.col("child"), '"/><origin xyz="', F.array_join(F.transform("xyz", lambda x: x.cast("string")), " "), '"/>', limit, mimic, "</joint>")
    body = j.groupBy("robot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(link, joint).alias("t")))), lambda x: x.t), "").alias("b"), F.min("k").alias("k"))
    whole = text("<robot name='r'><link name='base'/>", F.when(F.col("k") % 7 == 0, "<link name='spare'/>").otherwise(""), F.col("b"), F.when(F.col("k") % 5 == 0, "").otherwise("</robot>"))
    return body.select("robot", whole.alias("xml"))


_READ = _ROBOT + ", d AS (SELECT robot, min(k) AS k0 FROM b GROUP BY ALL), g AS (SELECT robot FROM d WHERE k0%7<>0 AND k0%5<>0)"


@query(_READ + " SELECT robot, 'j'||i AS joint, CASE kind WHEN 0 THEN 'revolute' WHEN 1 THEN 'prismatic' ELSE 'fixed' END AS type, CASE WHEN i=0 THEN 'base' ELSE 'l'||(i-1) END AS parent, dx AS x, CASE WHEN kind<2 THEN hi END AS upper, CASE WHEN kind<2 AND mimic THEN 'j'||(i-3) END AS mimic FROM j WHERE robot IN (SELECT robot FROM g)")
def robot_joints(spark, d):
    tables, _ = R.read_robots(_documents(spark, d))
    return tables["joints"].select("robot", "joint", "type", "parent", F.col("xyz")[0].alias("x"), "upper", F.col("mimic_joint").alias("mimic"))


@query(_READ + " SELECT robot, 'l'||i AS link, (1+k%3)::DOUBLE AS mass, 0.5::DOUBLE AS x, 0.03::DOUBLE AS izz FROM j WHERE robot IN (SELECT robot FROM g)")
def robot_inertials(spark, d):
    tables, _ = R.read_robots(_documents(spark, d))
    return tables["inertials"].select("robot", "link", "mass", F.col("xyz")[0].alias("x"), "izz")


@query(_READ + " SELECT robot FROM d WHERE k0%7=0 OR k0%5=0")
def robot_rejections(spark, d):
    return R.read_robots(_documents(spark, d))[1].select("robot")


@query("SELECT n_nationkey::BIGINT AS nation, CASE n_nationkey%5 WHEN 0 THEN 'urdf' WHEN 1 THEN 'sdf' WHEN 2 THEN 'mjcf' WHEN 3 THEN 'srdf' ELSE 'unknown' END AS format FROM nation")
def format_detection(spark, d):
    texts = ["<robot name='a'><link name='b'/></robot>", "<sdf version='1.7'/>", "<mujoco/>", "<robot name='a'><group name='g'/></robot>", "<html/>"]
    xml = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    detect = F.udf(R.detect, "string", useArrow=True)
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), detect(xml).alias("format"))


@query("SELECT 'm'||n_nationkey AS robot, 'b'||k AS child, CASE WHEN k=0 THEN 'world' ELSE 'b'||(k-1) END AS parent, floor((n_nationkey+k)*pi()/180*1e6+0.5)/1e6 AS upper, k::DOUBLE AS x FROM nation, (SELECT unnest([0,1,2]) AS k)")
def mjcf_import(spark, d):
    """Three nested bodies per nation, hinges in degrees."""
    n = F.col("n_nationkey")
    body = lambda k, inner: F.concat(F.lit(f'<body name="b{k}" pos="{k} 0 0"><joint name="h{k}" type="hinge" axis="0 0 2" range="0 '), (n + k).cast("string"), F.lit('"/>'), inner, F.lit("</body>"))
    docs = table(spark, d, "nation").select(F.concat(F.lit("m"), n).alias("robot"), F.concat(F.lit("<mujoco><worldbody>"), body(0, body(1, body(2, F.lit("")))), F.lit("</worldbody></mujoco>")).alias("xml"))
    return R.read_robots(docs)[0]["joints"].select("robot", "child", "parent", micro(F.col("upper")).alias("upper"), F.col("xyz")[0].alias("x"))


@query("SELECT 's'||n_nationkey AS robot, 'j1' AS joint, 'a' AS parent, 'b' AS child, floor(n_nationkey/10.0*1e6+0.5)/1e6 AS x, floor(0.5*1e6+0.5)/1e6 AS y FROM nation")
def sdf_import(spark, d):
    """Two links placed in the model, one turned by a right angle: the joint is given in its parent."""
    n = F.col("n_nationkey")
    x = F.concat(F.lit("<sdf><model name='m'><link name='a'><pose>1 2 0 0 0 1.5707963267948966</pose></link><link name='b'><pose>"), (1 - F.lit(0.5)).cast("string"), F.lit(" "), (2 + n / 10.0).cast("string"), F.lit(" 0 0 0 1.5707963267948966</pose></link><joint name='j1' type='revolute'><parent>a</parent><child>b</child><axis><xyz>0 0 1</xyz></axis></joint></model></sdf>"))
    docs = table(spark, d, "nation").select(F.concat(F.lit("s"), n).alias("robot"), x.alias("xml"))
    return R.read_robots(docs)[0]["joints"].select("robot", "joint", "parent", "child", micro(F.col("xyz")[0]).alias("x"), micro(F.col("xyz")[1]).alias("y"))


@query("SELECT 's'||n_nationkey AS robot, grp, member_kind, member FROM nation, (SELECT unnest(['arm','arm','all']) AS grp, unnest(['joint','link','group']) AS member_kind, unnest(['j1','l2','arm']) AS member)")
def srdf_groups(spark, d):
    xml = "<robot name='r'><group name='arm'><joint name='j1'/><link name='l2'/></group><group name='all'><group name='arm'/></group><disable_collisions link1='b' link2='a' reason='Never'/></robot>"
    docs = table(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("robot"), F.lit(xml).alias("xml"))
    return R.read_semantics(docs)["groups"].select("robot", "grp", "member_kind", "member")


def _meshes(spark, d):
    """A box per part as an OBJ file of six faces with four corners each; of every ninth, a face points outside the corners."""
    b = _boxes(spark, d)
    corner = lambda v: F.concat(F.lit("v "), F.concat_ws(" ", *[(F.col("hi") if v >> c & 1 else F.col("lo"))[c].cast("string") for c in range(3)]))
    faces = ["f 1 3 4 2", "f -4 -3 -1 -2", "f 1 2 6 5", "f 3 7 8 4", "f 1 5 7 3", "f 2 4 8 6"]
    text = F.concat_ws("\n", *[corner(v) for v in range(8)], *[F.lit(f) for f in faces], F.when(F.col("p_partkey") % 9 == 0, "f 1 2 99"))
    return b.select(F.concat(F.lit("/m/"), "p_partkey", F.lit(".obj")).alias("path"), F.encode(text, "UTF-8").alias("content"))


@query("SELECT '/m/'||p_partkey||'.obj' AS geometry_id, 12::BIGINT AS n, 13.5::DOUBLE AS area FROM part WHERE p_partkey%9<>0")
def mesh_scan(spark, d):
    t = H.parse(_meshes(spark, d))
    c = F.col("corners")
    u, v = ([c[3 * i + k] - c[k] for k in range(3)] for i in (1, 2))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    return t.groupBy("geometry_id").agg(F.count("*").alias("n"), micro(F.sum(area)).alias("area"))


@query("SELECT '/m/'||p_partkey||'.obj' AS geometry_id, 13.5::DOUBLE AS area, 3.375::DOUBLE AS volume, true AS watertight FROM part WHERE p_partkey%9<>0")
def mesh_summaries(spark, d):
    out = B.mesh_summary(H.parse(_meshes(spark, d)))
    return out.select("geometry_id", micro(F.col("area")).alias("area"), micro(F.abs(F.col("volume"))).alias("volume"), "watertight")


@query("SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN '/ws/p'||c_nationkey||'/m.stl' WHEN 1 THEN NULL WHEN 2 THEN '/abs/m.stl' ELSE '/base/m.stl' END AS path FROM customer")
def mesh_paths(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("package"), F.concat(F.lit("/ws/p"), "n_nationkey").alias("root"))
    k = F.col("c_custkey") % 4
    uri = F.when(k == 0, F.concat(F.lit("package://p"), "c_nationkey", F.lit("/m.stl"))).when(k == 1, "package://nobody/m.stl").when(k == 2, "file:///abs/m.stl").otherwise("m.stl")
    return H.resolve(table(spark, d, "customer").select("c_custkey", "c_nationkey", uri.alias("uri")), n, "/base/").select("c_custkey", "path")


@query("SELECT 'pkg'||c_nationkey AS package, count(DISTINCT c_custkey%3) AS n FROM customer WHERE c_custkey%10=0 GROUP BY ALL")
def package_discovery(spark, d):
    """Package manifests; a name that several folders claim is ambiguous, any other has one root."""
    c = table(spark, d, "customer").where("c_custkey % 10 = 0")
    files = c.select(F.concat(F.lit("/w/"), F.col("c_custkey") % 3, F.lit("/"), "c_nationkey", F.lit("/package.xml")).alias("path"), F.encode(F.concat(F.lit("<package><name> pkg"), "c_nationkey", F.lit(" </name></package>")), "UTF-8").alias("content")).distinct()
    one, several = H.packages(files)
    return one.select("package", F.lit(1).cast("long").alias("n")).unionByName(several.select("package", "n"))


@query("""WITH f AS (SELECT c_nationkey AS root, c_custkey::VARCHAR AS path, sha256(c_name) AS h FROM customer) SELECT root, count(*) AS n_files, sha256(string_agg(h||' '||path, chr(10) ORDER BY path)) AS tree_digest FROM f GROUP BY ALL""")
def tree_manifest(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("root"), F.col("c_custkey").cast("string").alias("path"), F.encode("c_name", "UTF-8").alias("content"))
    return H.tree_digest(c)


# Dynamics: masses of 1 to 3, half a metre along each link.

_MASS = _ROBOT + _FK + ", m AS (SELECT w.robot, w.i, (1+q.k%3)::DOUBLE AS m, w.x+0.5*cos(w.th) AS cx, w.y+0.5*sin(w.th) AS cy FROM w JOIN q ON q.robot=w.robot AND q.i=w.i)"


def _dynamics(spark, d):
    j = _joints(spark, d)
    operators, derivations = M.grammar(j)
    frames = M.evaluate_grammar(operators, derivations, _values(j)).withColumnRenamed("frame", "link")
    inertials = j.select("robot", F.col("child").alias("link"), (1 + F.col("k") % 3).cast("double").alias("mass"), *[F.lit(v).alias(c) for c, v in (("ixx", 0.01), ("ixy", 0.0), ("ixz", 0.0), ("iyy", 0.02), ("iyz", 0.0), ("izz", 0.03))], F.array(F.lit(0.5), F.lit(0.0), F.lit(0.0)).alias("xyz"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rpy"))
    moved = operators.select("robot", "joint", "child", "type", "axis", "driver", "multiplier", "offset")
    return inertials, frames, moved, derivations


@query(_MASS + ", s AS (SELECT robot, sum(m) AS mass, sum(m*cx)/sum(m) AS com_x, sum(m*cy)/sum(m) AS com_y FROM m GROUP BY ALL), z AS (SELECT m.robot, sum(0.03+m*((cx-com_x)*(cx-com_x)+(cy-com_y)*(cy-com_y))) AS izz FROM m JOIN s ON s.robot=m.robot GROUP BY ALL) SELECT s.robot, mass, floor(com_x*1e6+0.5)/1e6 AS com_x, floor(com_y*1e6+0.5)/1e6 AS com_y, floor(izz*1e4+0.5)/1e4 AS izz FROM s JOIN z ON z.robot=s.robot")
def mass_properties(spark, d):
    inertials, frames, _, _ = _dynamics(spark, d)
    out = G.mass_properties(inertials, frames)
    return out.select("robot", "mass", micro(F.col("com_x")).alias("com_x"), micro(F.col("com_y")).alias("com_y"), (F.floor(F.col("izz") * 1e4 + 0.5) / 1e4).alias("izz"))


@query(_ROBOT + _FK + """, t AS (SELECT robot, x AS px, y AS py FROM w WHERE i=5), c AS (SELECT q.robot, q.di, CASE WHEN q.mimic THEN 0.5 ELSE 1.0 END::DOUBLE AS f, q.kind, w.x, w.y, w.th, px, py FROM q JOIN w ON w.robot=q.robot AND w.i=q.i JOIN t ON t.robot=q.robot WHERE q.i <= 5 AND q.kind<>2)
SELECT robot, 'j'||di AS driver, floor(sum(f*CASE kind WHEN 0 THEN -(py-y) ELSE cos(th) END)*1e6+0.5)/1e6 AS linear_x, floor(sum(f*CASE kind WHEN 0 THEN px-x ELSE sin(th) END)*1e6+0.5)/1e6 AS linear_y, sum(CASE kind WHEN 0 THEN f ELSE 0 END) AS angular_z FROM c GROUP BY ALL""")
def geometric_jacobian(spark, d):
    _, frames, moved, derivations = _dynamics(spark, d)
    paths = M.operator_lists(derivations, "l5").select("robot", F.col("frame").alias("link"), F.col("frames").alias("path"))
    out = G.jacobian(moved, frames, paths, "l5")
    return out.select("robot", "driver", micro(F.col("linear_x")).alias("linear_x"), micro(F.col("linear_y")).alias("linear_y"), micro(F.col("angular_z")).alias("angular_z"))


@query(_MASS + """, c AS (SELECT q.robot, q.di, CASE WHEN q.mimic THEN 0.5 ELSE 1.0 END AS f, q.kind, w.x, w.y, w.th, m.m, m.cx, m.cy FROM q JOIN w ON w.robot=q.robot AND w.i=q.i JOIN m ON m.robot=q.robot AND m.i >= q.i WHERE q.kind<>2)
SELECT robot, 'j'||di AS driver, floor(sum(-m*f*CASE kind WHEN 0 THEN -9.8*(cx-x) ELSE -9.8*sin(th) END)*1e4+0.5)/1e4 AS load FROM c GROUP BY ALL""")
def static_gravity_loads(spark, d):
    inertials, frames, moved, derivations = _dynamics(spark, d)
    paths = derivations.select("robot", F.col("frame").alias("link"), F.when(F.col("prefix").isNull(), F.array("frame")).otherwise(F.array("prefix", "frame")).alias("path"))
    out = S.gravity_loads(inertials, frames, moved, paths, [0.0, -9.8, 0.0])
    return out.select("robot", "driver", (F.floor(F.col("load") * 1e4 + 0.5) / 1e4).alias("load"))


@query(_ROBOT + " SELECT a.robot, 'j'||d.di AS driver, 'l'||a.i AS link FROM q a JOIN (SELECT robot, di, min(i) AS i FROM q WHERE kind<>2 GROUP BY ALL) d ON d.robot=a.robot AND a.i >= d.i")
def driver_frame_dependency(spark, d):
    return M.affected(_joints(spark, d))


@query(_ROBOT + ", c AS (SELECT a.robot, 'c'||a.i AS constraint, a.i+2 AS t FROM q a JOIN q b ON b.robot=a.robot AND b.i=a.i+2) SELECT c.robot, \"constraint\", array_to_string(list_sort(list(DISTINCT 'j'||di)), ',') AS drivers FROM c JOIN q ON q.robot=c.robot AND q.i<=c.t AND kind<>2 GROUP BY ALL".replace("AS constraint", "AS \"constraint\""))
def constraint_driver_dependency(spark, d):
    j = _joints(spark, d)
    c = j.select("robot", F.concat(F.lit("c"), "i").alias("constraint"), F.col("child").alias("frame_a"), F.concat(F.lit("l"), F.col("i") + 2).alias("frame_b"))
    return M.constraint_drivers(*M.grammar(j), c).withColumn("drivers", F.array_join("drivers", ","))


def _heap(spark, d):
    return _joints(spark, d).select("robot", "child", F.when(F.col("i") > 0, F.concat(F.lit("l"), F.floor((F.col("i") - 1) / 2))).alias("parent"))


@query(_HEAP + ", p AS (SELECT robot, i, ['l'||i] AS path, 0 AS depth FROM h WHERE i=0 UNION ALL SELECT h.robot, h.i, list_append(path, 'l'||h.i), depth+1 FROM p JOIN h ON h.robot=p.robot AND (h.i-1)//2=p.i AND h.i > 0) SELECT robot, 'l'||i AS node, depth::INT AS depth, row_number() OVER (PARTITION BY robot ORDER BY path)::INT AS position FROM p")
def depth_first_lines(spark, d):
    return G.depth_first(_heap(spark, d), "robot")


@query(_HEAP + ", z AS (SELECT robot, i, n, CASE WHEN 2*i+1 < n THEN 1 ELSE 0 END + CASE WHEN 2*i+2 < n THEN 1 ELSE 0 END AS kids FROM h), y AS (SELECT z.robot, z.i, z.n, z.kids, z.i=0 OR p.kids > 1 AS head FROM z LEFT JOIN z p ON p.robot=z.robot AND p.i=(z.i-1)//2) SELECT robot, 'l'||i AS head, CASE WHEN kids=1 THEN 'l'||(2*i+1) ELSE 'l'||i END AS last, CASE WHEN kids=1 THEN 2 ELSE 1 END::BIGINT AS n FROM y WHERE head")
def serial_segments(spark, d):
    """In a heap only the last inner node can have one child, a leaf, so segments have one node or two."""
    key = lambda c: F.struct("robot", F.col(c).alias("l"))
    e = _heap(spark, d).select(key("child").alias("child"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent"))
    return G.serial_segments(e).select("head.robot", F.col("head.l").alias("head"), F.col("last.l").alias("last"), "n")


@query(EV + ", h AS (SELECT user_id, event_type, CASE WHEN event_id%7=0 THEN 'NaN'::DOUBLE WHEN event_id%5=0 THEN NULL ELSE value END AS a, CASE WHEN event_type='view' THEN NULL WHEN event_id%3=0 THEN NULL ELSE value END AS b FROM ev) SELECT user_id, event_type, count(*) FILTER (isnan(a)) AS a_nan, CASE WHEN count(a) > 0 THEN count(*)-count(a) ELSE 0 END AS a_holes, count(*) FILTER (isnan(b)) AS b_nan, CASE WHEN count(b) > 0 THEN count(*)-count(b) ELSE 0 END AS b_holes FROM h GROUP BY ALL")
def hole_counts(spark, d):
    i = F.col("event_id")
    h = events(spark, d).select("user_id", "event_type", F.when(i % 7 == 0, float("nan")).when(i % 5 != 0, F.col("value")).alias("a"), F.when((F.col("event_type") != "view") & (i % 3 != 0), F.col("value")).alias("b"))
    return h.groupBy("user_id", "event_type").agg(*N.holes(["a", "b"]))


@query("SELECT vec_id, vec_id%5<>0 AS numbers, vec_id%3<>0 AS members, vec_id%7<>0 AS rotation FROM embeddings")
def tolerant_deep_compare(spark, d):
    """Lists of numbers, unordered collections, and quaternions of either sign, some of them changed."""
    e = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    i = F.col("vec_id")
    t = table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    moved = F.transform("e", lambda x: x + F.when(i % 5 == 0, 1e-3).otherwise(1e-12))
    names, other = F.array(F.lit("a"), F.lit("b"), F.lit("b")), F.when(i % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    turned = F.transform("e", lambda x: -x + F.when(i % 7 == 0, 0.25).otherwise(0.0))
    return t.select("vec_id", N.same_values(F.col("e"), moved, 1e-9).alias("numbers"), N.same_members(names, other).alias("members"), N.same_rotation(F.col("e"), turned).alias("rotation"))


@query(EV + """, k AS (SELECT user_id AS run_id, event_type, event_id AS i, (t-1704067200000000)/1e6 AS s, value, CASE WHEN event_id%3=0 THEN NULL ELSE value END AS v FROM ev), r AS (SELECT DISTINCT run_id FROM k), g AS (SELECT *, lag(s) OVER (PARTITION BY run_id ORDER BY i) AS b FROM k),
o AS (SELECT run_id, 'out_of_order' AS issue, i FROM g WHERE s < b UNION ALL SELECT run_id, 'gap', i FROM g WHERE s-b > 100000.0 UNION ALL SELECT run_id, 'incomplete_start_coverage', NULL FROM k GROUP BY run_id HAVING arg_min(s,i) > 100000.0 UNION ALL SELECT run_id, 'incomplete_end_coverage', NULL FROM k GROUP BY run_id HAVING arg_max(s,i) < 2505600.0-100000.0
UNION ALL SELECT run_id, 'missing_values', NULL FROM (SELECT run_id, event_type, count(v) AS c FROM k GROUP BY ALL) JOIN (SELECT run_id, count(*) AS n FROM k GROUP BY ALL) USING (run_id) WHERE c > 0 AND c < n) SELECT run_id, issue, i::INT AS sample_index FROM o""")
def channel_issue_rows(spark, d):
    """Issues of the joint channel with event ids as sample order: events come out of order, and each sample has one joint only."""
    from ..operators.predicates import channel_issues
    from .streams import START

    k = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").cast("int").alias("sample_index"), ((F.col("t") - START).cast("double") / 1e6).alias("time_s"), F.col("event_type").alias("joint_id"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("position"), F.col("value").alias("velocity"), F.lit(None).cast("double").alias("effort"))
    runs = k.select("run_id").distinct().select("run_id", F.lit(0.0).alias("start_s"), F.lit(2505600.0).alias("end_s"), F.lit(40000.0).alias("timestep_s"))
    return channel_issues(runs, k.withColumn("time_s", F.abs("time_s")), "joint_state").select("run_id", "issue", "sample_index")


_VIEW = "(VALUES " + ", ".join(f"('{n}', " + ", ".join(f"{a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE" for a in axes) + ")" for n, axes in V.VIEWS.items()) + ") g(view, ux, uy, vx, vy, dx, dy)"


@query(_ROBOT + _FK + f", p AS (SELECT robot, i, view, w.x*ux+w.y*uy AS u, w.x*vx+w.y*vy AS v, w.x*g.dx+w.y*g.dy AS depth FROM w, {_VIEW}) SELECT p.robot, CASE WHEN p.i < 0 THEN 'base' ELSE 'l'||p.i END AS link, p.view, floor(p.u*1e6+0.5)/1e6 AS u, floor(p.v*1e6+0.5)/1e6 AS v, floor(p.depth*1e6+0.5)/1e6 AS depth, floor(o.u*1e6+0.5)/1e6 AS parent_u, floor(o.v*1e6+0.5)/1e6 AS parent_v FROM p LEFT JOIN p o ON o.robot=p.robot AND o.view=p.view AND o.i=p.i-1")
def render_atlas(spark, d):
    """The numbers of drawings of all robots in four views."""
    j = _joints(spark, d)
    frames = M.evaluate_grammar(*M.grammar(j), _values(j)).withColumnRenamed("frame", "link")
    out = M.drawing(j, frames)
    return out.select("robot", "link", "view", *[micro(F.col(c)).alias(c) for c in ("u", "v", "depth", "parent_u", "parent_v")])


def _inverse(n: int, base: int) -> float:
    x, f = 0.0, 1.0
    while n:
        f /= base
        x += f * (n % base)
        n //= base
    return x


_BASES, _SAMPLES = (2, 3, 5, 7, 11, 13, 17), 3
_DIGITS = "(VALUES " + ", ".join(f"({k}, {b}, {_inverse(k, _BASES[b])!r}::DOUBLE)" for k in range(1, _SAMPLES + 1) for b in range(len(_BASES))) + ") g(sample, base, x)"


@query(_ROBOT + f""", dr AS (SELECT robot, i, row_number() OVER (PARTITION BY robot ORDER BY i)-1 AS n, lo, hi FROM v WHERE kind<>2 AND NOT mimic), pv AS (SELECT robot, i, sample, lo+x*(hi-lo) AS given FROM dr JOIN {_DIGITS} ON base=n%{len(_BASES)}),
pq AS (SELECT v.robot, v.i, sample, v.dx, v.kind, CASE WHEN kind=2 THEN 0.0 WHEN mimic THEN 0.5*pv.given+0.1 ELSE pv.given END AS q FROM v LEFT JOIN pv ON pv.robot=v.robot AND pv.i=v.di WHERE kind<>2 UNION ALL SELECT robot, i, sample, dx, kind, 0.0 FROM v, (SELECT DISTINCT sample FROM {_DIGITS}) WHERE kind=2),
pw AS (SELECT robot, sample, -1::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS th FROM pq GROUP BY ALL UNION ALL SELECT q.robot, q.sample, q.i, {_STEP.format(q="q.q")} FROM pw w JOIN pq q ON q.robot=w.robot AND q.sample=w.sample AND q.i=w.i+1),
t AS (SELECT robot, sample, x, y FROM pw WHERE i=5) SELECT robot, count(*) AS n, floor(min(x)*1e6+0.5)/1e6 AS min_x, floor(max(y)*1e6+0.5)/1e6 AS max_y, floor(max(sqrt(x*x+y*y))*1e6+0.5)/1e6 AS radius FROM t GROUP BY ALL""")
def workspace_envelope(spark, d):
    """Where the sixth link gets in a few low-discrepancy poses within the limits."""
    j = _joints(spark, d)
    own = j.where("type <> 'fixed' and mimic is null").select("robot", F.col("joint").alias("driver"), (F.row_number().over(W.partitionBy("robot").orderBy("i")) - 1).alias("number"), "lower", "upper")
    poses = S.halton_poses(own, _SAMPLES, _BASES).withColumnRenamed("driver", "joint")
    tips = M.frames_at(j, poses, ["sample"]).where("link = 'l5'").select("robot", F.array(F.col("world")[3], F.col("world")[7], F.lit(0.0)).alias("p"))
    out = S.envelope(tips, ["robot"], "p")
    return out.select("robot", "n", micro(F.col("min_x")).alias("min_x"), micro(F.col("max_y")).alias("max_y"), micro(F.col("radius")).alias("radius"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT vec_id, (e[1]*e[8]+e[2]*e[9]+e[3]*e[10])/(sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3])*sqrt(e[8]*e[8]+e[9]*e[9]+e[10]*e[10])) AS c FROM e) SELECT vec_id, floor(degrees(acos(greatest(-1.0,least(1.0,c))))*1e4+0.5)/1e4 AS axis_deg FROM c""")
def axis_errors(spark, d):
    unit = lambda v: V.scaled(v, 1 / V.norm(v))
    p = _poses(spark, d).select("vec_id", unit(F.col("p")).alias("a"), unit(F.col("p2")).alias("b"))
    return p.select("vec_id", (F.floor(V.degrees_between(F.col("a"), F.col("b")) * 1e4 + 0.5) / 1e4).alias("axis_deg"))


@query(EV + """, r AS (SELECT user_id AS log, event_id//3 AS record_id, event_type AS stream, CASE WHEN event_id%50=0 THEN NULL WHEN event_id%33=0 THEN -1 ELSE t//3600000000 END AS time, event_id AS position FROM ev),
x AS (SELECT *, lag(time) OVER (PARTITION BY log, stream ORDER BY position) AS b, count(*) OVER (PARTITION BY log, record_id) AS ids, count(*) OVER (PARTITION BY log, stream, time) AS times FROM r),
s AS (SELECT log, count(*) FILTER (ids > 1) AS repeated_id, count(*) FILTER (times > 1) AS repeated_time, count(*) FILTER (time < b) AS out_of_order, count(*) FILTER (time IS NULL OR time < 0) AS bad_time FROM x GROUP BY ALL) SELECT log, issue, n FROM (UNPIVOT s ON COLUMNS(* EXCLUDE (log)) INTO NAME issue VALUE n) WHERE n > 0""")
def observation_log_issues(spark, d):
    from ..operators.capture import observation_issues

    i = F.col("event_id")
    r = events(spark, d).select(F.col("user_id").alias("log"), F.floor(i / 3).alias("record_id"), F.col("event_type").alias("stream"), F.when(i % 50 == 0, F.lit(None).cast("long")).when(i % 33 == 0, -1).otherwise(F.floor(F.col("t") / 3_600_000_000)).alias("time"), i.alias("position"))
    return observation_issues(r, ["log"])
