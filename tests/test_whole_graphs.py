"""Graph queries over the whole lineitem table against plain Python."""

import inspect

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attest.operators import graphs as G


def save(spark, folder, rows, schema="l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


# (order, part, supplier): two components joined late, a chain, repeated rows, and quantities that a row filter would drop
LINES = [(i, i // 3 + 1, i % 5 + 1, float(i % 50 + 1), (i % 11) / 100) for i in range(30)] + [(100 + i, 50 + i + k, 20 + i, 1.0, 0.0) for i in range(12) for k in (0, 1)]
LINES += LINES[:4] + [(200, 90, 40, 50.0, 0.1), (201, 0, 0, 1.0, 0.0), (202, 0, 31, 1.0, 0.0), (203, 62, 0, 1.0, 0.0), (204, 90, 31, 1.0, 0.0)]


def components(pairs):
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in list(up)}


@pytest.mark.parametrize("lines", [LINES, []])
def test_components_of_all_lines(spark, tmp_path, lines):
    out = entry.queries()["connected_components"](spark, save(spark, tmp_path, lines)).collect()
    want = components([(p, -1 - o) for o, p, *_ in lines])
    assert len(out) == len(want) and {r.node: r.component for r in out} == want


@pytest.mark.parametrize("lines", [LINES, []])
def test_closure_of_all_lines(spark, tmp_path, lines):
    where = save(spark, tmp_path, lines)
    got = [r.node for r in entry.queries()["proof_closure"](spark, where).collect()]
    below = {}
    for _, p, s, *_ in lines:
        below.setdefault(p, set()).add(-1 - s)
        below.setdefault(-1 - s, set()).add(p)
    want, front = set(), {max((x[1] for x in lines), default=None)} - {None}
    while front:
        want |= front
        front = set().union(*(below[v] for v in front)) - want
    assert sorted(got) == sorted(want)
    sql = entry.oracle_sql()["proof_closure"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{where}/lineitem.parquet/*.parquet'")
    assert sorted(got) == sorted(r[0] for r in con.execute(sql).fetchall())


def test_closure_goes_to_the_end_or_fails(spark):
    assert inspect.signature(G.closure).parameters["limit"].default is None
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "node long, premise long")
    seed = spark.createDataFrame([(0,)], "node long")
    assert {r.node for r in G.closure(chain, seed).collect()} == set(range(7))
    assert G.closure(chain, seed, limit=6).count() == 7
    with pytest.raises(ValueError):
        G.closure(chain, seed, limit=5)


def test_deep_chain(spark):
    """1,500 levels: paths, affine products, forward kinematics and descendants."""
    n = 1500
    chain = spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("multiplier"), F.lit(0.5).alias("offset"))
    deepest = G.root_paths(chain).where(f"node = {n - 1}").first()
    assert deepest.depth == n - 1 and deepest.path == list(range(n))
    last = G.affine_chain(chain).where(f"node = {n - 1}").first()
    assert (last.driver, last.multiplier, last.offset) == (0, 1.0, 0.5 * (n - 1))
    below = G.descendants(chain, spark.createDataFrame([(10,), (n - 2,)], "node long")).where(f"node = {n - 1}").collect()
    assert sorted((r.ancestor, r.distance) for r in below) == [(10, n - 11), (n - 2, 1)]
    j = chain.where("parent is not null").select(F.lit("r").alias("robot"), F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"), F.lit("prismatic").alias("type"), *[F.array(*[F.lit(x) for x in v]).alias(c) for c, v in (("xyz", (0.0, 0.0, 0.0)), ("rpy", (0.0, 0.0, 0.0)), ("axis", (1.0, 0.0, 0.0)))], F.lit(0.001).alias("value"))
    tip = G.forward_kinematics(j, spark.createDataFrame([("r", "0")], "robot string, link string")).where(f"link = '{n - 1}'").first()
    assert tip.depth == n - 1 and abs(tip.world[3] - 0.001 * (n - 1)) < 1e-9


def test_wide_star_and_cycles(spark):
    star = spark.range(2_000_000).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.lit(0)).alias("parent"))
    assert G.root_paths(star).agg(F.count("*"), F.sum("depth")).first()[:] == (2_000_000, 1_999_999)
    odd = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 4), (6, 99)], "child long, parent long")
    assert sorted(r.node for r in G.root_paths(odd).collect()) == [1, 2]
    assert G.tree_issues(odd).first().asDict() == {"n_nodes": 6, "n_roots": 1, "n_several_parents": 0, "n_unreached": 4}
    assert G.root_paths(odd.where("false")).count() == 0
