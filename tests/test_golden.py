"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators import graph, metrics, pairs, scenes, tables, tracks


def edges(spark, *e):
    return spark.createDataFrame(list(e), "i long, j long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_largest_component(spark):
    e = edges(spark, (10, 11), (20, 25), (25, 21), (21, 29), (30, 31), (11, 12))
    assert rows(graph.largest_component(e)) == [(20,), (21,), (25,), (29,)]
    assert rows(graph.largest_component(edges(spark).limit(0))) == []


def test_components_with_nulls_and_isolated_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, None), (5, 5)], "i long, j long")
    n = spark.createDataFrame([(9,), (None,)], "node long")
    assert rows(graph.connected_components(e, nodes=n)) == [(1, 1), (2, 1), (5, 5), (9, 9)]


def test_triangles(spark):
    assert rows(graph.triangles(edges(spark, (5, 7), (7, 9), (9, 5), (9, 11), (11, 7), (2, 5)))) == [(5, 7, 9), (7, 9, 11)]


def test_sequential(spark):
    f = spark.range(12).withColumnRenamed("id", "i")
    assert pairs.pairs_sequential(f, 3).count() == 30


def test_union_find_tracks(spark):
    m = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 1, 1), (1, 2, 2, 0), (1, 2, 1, 1)], "i1 long, i2 long, k1 long, k2 long")
    t = tracks.tracks_union_find(m).groupBy("track_id").count()
    assert sorted(r["count"] for r in t.collect()) == [2, 2, 3]


@pytest.mark.parametrize("errs,want", [([5.0] * 5, [0, 0.55, 0.775]), ([0.0] * 5, [1, 1, 1]), ([25.0] * 5, [0, 0, 0])])
def test_pose_auc(spark, errs, want):
    d = spark.createDataFrame([("r", i, e) for i, e in enumerate(errs)], "run string, id long, err double")
    got = {r["threshold"]: r["auc"] for r in metrics.pose_auc(d, [5.0, 10.0, 20.0], ["run"]).collect()}
    assert [got[t] for t in (5.0, 10.0, 20.0)] == pytest.approx(want, abs=0.13)


def test_pct_change(spark):
    a = spark.createDataFrame([("m1", 100.0), ("m2", 100.0), ("m3", 100.0)], "metric string, value double")
    b = spark.createDataFrame([("m1", 150.0), ("m2", 100.0), ("m3", 1.0)], "metric string, value double")
    assert [round(r["change"], 6) for r in metrics.pct_change(a, b, ["metric"]).orderBy("metric").collect()] == [50, 0, -99]


def test_cross_edges_and_bins(spark):
    e = edges(spark, (0, 1), (1, 2), (2, 3), (0, 3))
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "i long, cluster long")
    assert rows(graph.cross_edges(e, c)) == [(0, 1, 2)]
    b = scenes.cluster_even_bins(spark.range(5).withColumnRenamed("id", "i"), 2)
    assert rows(b) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_piecewise_gaussian(spark):
    d = spark.createDataFrame([(4.0,), (10.0,)], "a double").select(g.piecewise_gaussian(F.col("a")).alias("s"))
    assert [r.s for r in d.collect()] == pytest.approx([math.exp(-0.5), math.exp(-0.125)])


def test_integer_histogram_keeps_all(spark):
    d = spark.createDataFrame([("r", "g", "m", float(v)) for v in (2, 2, 3, 3, 3, 4)], "run string, grp string, metric string, value double")
    assert [(r["value"], r["n"]) for r in metrics.integer_histogram(d).orderBy("value").collect()] == [(2, 2), (3, 3), (4, 1)]


def camera(spark):
    cams = []
    for i, (a, x) in enumerate(((0.0, 0.0), (0.1, 1.0), (-0.1, -1.0))):
        cams.append((i, Row(w=math.cos(a / 2), x=0.0, y=math.sin(a / 2), z=0.0), Row(x=x, y=0.1 * i, z=0.0), "PINHOLE", [500.0, 500.0, 320.0, 240.0]))
    return spark.createDataFrame(cams, "i long, q struct<w double,x double,y double,z double>, t struct<x double,y double,z double>, model string, params array<double>")


def test_triangulation_recovers_points(spark):
    c = camera(spark)
    p = spark.createDataFrame([(1, 0.3, -0.2, 6.0), (2, -1.0, 0.5, 9.0)], "track_id long, x double, y double, z double")
    seen = p.crossJoin(c).withColumn("uv", g.project(F.col("model"), F.col("params"), g.to_camera(F.col("q"), F.col("t"), g.vec(F.col("x"), F.col("y"), F.col("z")))))
    o = seen.select("track_id", "i", "uv.u", "uv.v")
    for t in (tracks.track_triangulate(o, c), tracks.track_triangulate_robust(o, c, 1.0)):
        got = {r["track_id"]: (r["x"], r["y"], r["z"]) for r in t.collect()}
        assert got[1] == pytest.approx((0.3, -0.2, 6.0), abs=1e-6) and got[2] == pytest.approx((-1.0, 0.5, 9.0), abs=1e-6)
    e = tracks.reprojection_error(o, c, p).collect()
    assert max(r["err"] for r in e) < 1e-6


def test_sampson_of_true_pair_is_zero(spark):
    q = g.quat(F.lit(math.cos(0.1)), F.lit(0.0), F.lit(math.sin(0.1)), F.lit(0.0))
    t, k = g.vec(0.4, 0.1, 0.2), F.array(*map(F.lit, (500.0, 510.0, 320.0, 240.0)))
    x1 = g.vec(0.2, -0.3, 5.0)
    x2 = g.add(g.rotate(q, x1), t)
    uv = lambda x: (k[0] * x["x"] / x["z"] + k[2], k[1] * x["y"] / x["z"] + k[3])
    f = g.fundamental(g.essential(q, t), k, k)
    d = spark.range(1).select(g.epipolar_sampson(f, *uv(x1), *uv(x2)).alias("e"), g.is_rotation(g.matrix(q)).alias("r"))
    r = d.first()
    assert abs(r.e) < 1e-12 and r.r


def test_expressions_stay_short(spark):
    """Vectors used again and again do not copy their whole expressions."""
    d = spark.range(1).select(*(g.vec(*map(F.lit, (1.0, 2.0, 3.0))).alias(n) for n in "pt"), g.quat(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("q"),
                              F.array(*map(F.lit, (500.0, 510.0, 320.0, 240.0))).alias("k"))
    c = g.to_camera(F.col("q"), F.col("t"), F.col("p"))
    assert len(str(c)) < 5_000
    f = g.fundamental(g.essential(F.col("q"), F.col("t")), F.col("k"), F.col("k"))
    assert len(str(f)) < 40_000
    plan = d.select(g.project(F.lit("PINHOLE"), F.col("k"), c).alias("uv"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 300_000


def test_frustum_corners(spark):
    c = camera(spark).withColumns({"width": F.lit(640), "height": F.lit(480)}).where("i = 0")
    got = [tuple(r) for r in scenes.frustum_vertices(c, 2.0).orderBy("vertex").select("x", "y", "z").collect()]
    x, y = 320 / 500 * 2, 240 / 500 * 2
    want = [(0, 0, 0), (-x, -y, 2), (x, -y, 2), (x, y, 2), (-x, y, 2)]
    assert all(a == pytest.approx(b) for a, b in zip(got, want))


def test_binary_clusters(spark):
    c = scenes.cluster_binary(spark.range(10).withColumnRenamed("id", "i"), 3)
    got = {r["i"]: r["path"] for r in c.collect()}
    assert got[0] == [0, 0] and got[9] == [1, 1] and got[4][0] == 0 and got[5][0] == 1
    e = scenes.edge_owner(edges(spark, (0, 1), (4, 5)), c)
    assert [r["owner"] for r in e.orderBy("i").collect()] == [[0, 0], []]


def test_nearest_points_of_outliers(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.1, 0.0, 0.0), (3, 50_000.0, 0.0, 0.0), (4, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {(r["id"], r["rank"]): r["other"] for r in scenes.knn_points(p, p, 2, 0.5).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert scenes.knn_points(p.limit(0), p.limit(0), 2, 0.5).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lensframe import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


def test_zero_inliers_pass_unless_strict(spark):
    r = spark.createDataFrame([(0, 1.0), (3, 1.0), (30, 0.1), (30, 1.0)], "n_inliers long, ratio double")
    assert [x["failure"] for x in pairs.inlier_support(r, 15, 0.2).collect()] == [None, "inliers", "ratio", None]
    assert pairs.inlier_support(r, 15, 0.2, strict=True).first()["failure"] == "inliers"


def test_hub_graph_has_no_cartesian_plan(spark):
    plan = graph.triangles(edges(spark, *[(0, i) for i in range(1, 30)]))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
