"""Queries of readers by round trips through files, and of the scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators import alignment, graph, scenes, tables
from lensframe.plans.catalog import rounded
from lensframe.plans.catalog_io import scene
from lensframe.plans.catalog_scene import PATHS, paths
from lensframe.plans.domain import cameras, sql, view
from lensframe.session import work_path
from lensframe.sources import sinks, text_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f

    return add


def _text(*cols):
    return F.concat_ws(" ", *(c.cast("string") if not isinstance(c, str) else F.col(c).cast("string") for c in cols))


# -- readers ------------------------------------------------------------------------------
@query("""SELECT scene_id, i AS camera_id, CASE i % 4 WHEN 0 THEN 'PINHOLE' WHEN 1 THEN 'SIMPLE_RADIAL' WHEN 2 THEN 'OPENCV' ELSE 'SIMPLE_PINHOLE' END AS model, 640 AS width, 480 AS height,
 CASE i % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 3 END AS n, round(f, 6)::DOUBLE AS f, CASE i % 4 WHEN 0 THEN 240 WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 ELSE 240 END::DOUBLE AS last FROM cam""")
def src_cameras(s, d):
    """Four camera models, with comment lines between them."""
    path = work_path(s, "cameras")
    c = cameras(s, d)
    f, x = F.col("params")[0], lambda *v: [F.lit(float(k)) for k in v]
    p = F.when(F.col("i") % 4 == 0, F.array(f, f, *x(320, 240))).when(F.col("i") % 4 == 1, F.array(f, *x(320, 240, 0.01))).when(
        F.col("i") % 4 == 2, F.array(f, f, *x(320, 240, 0.1, 0.01, 0.002, 0.001))).otherwise(F.array(f, *x(320, 240)))
    m = F.element_at(F.array(*map(F.lit, ("PINHOLE", "SIMPLE_RADIAL", "OPENCV", "SIMPLE_PINHOLE"))), (F.col("i") % 4 + 1).cast("int"))
    line = F.concat(F.lit("# a camera\n"), _text("i", m, "width", "height", F.array_join(F.transform(p, lambda v: v.cast("string")), " ")))
    c.select(F.col("scene_id").alias("scene"), line.alias("value")).write.partitionBy("scene").text(path)
    t = text_model.src_cameras(s, path, "part-*")
    return rounded(t.select(scene("scene"), "camera_id", "model", "width", "height", F.size("params").alias("n"), F.col("params")[0].alias("f"), F.element_at("params", -1).alias("last")))


@query("""SELECT scene_id, c.i AS image_id, s_name AS name, row_number() OVER (PARTITION BY scene_id ORDER BY s_name) - 1 AS i, round(qw, 6) AS qw, round(qy, 6) AS qy, round(tx, 6) AS x, round(ty, 6) AS y,
 (SELECT count(*) FROM obs o WHERE o.i = c.i) AS n FROM cam c JOIN supplier ON c.i = s_suppkey""")
def src_images(s, d):
    """Pose lines and point lines; poses are turned twice, the index is the rank of the name."""
    path = work_path(s, "images")
    c = cameras(s, d).withColumns({"scene": F.col("scene_id"), "camera_id": F.col("i")})
    sinks.sink_images(c, view(s, d, "obs").join(c.select("i", "scene"), "i"), path)
    t = text_model.src_images(s, path, "part-*")
    n = F.when(F.size("points") >= 3, F.floor(F.size("points") / 3)).otherwise(0)
    w = F.col("q.w") * F.when(F.col("q.w") * F.cos(F.col("image_id") * 0.37 / 2) < 0, -1).otherwise(1)
    return rounded(t.select(scene("scene"), "image_id", "name", "i", w.alias("qw"), F.col("q.y").alias("qy"), "t.x", "t.y", n.alias("n")))


@query(f"WITH {PATHS} SELECT DISTINCT array_to_string(path, '/') AS node FROM p WHERE path[1] + path[2] < 4")
def src_scene_tree(s, d):
    """Folders named by a node's path; some lack the points and are no scenes."""
    path = work_path(s, "tree")
    p = paths(s, d).select(F.array_join("path", "-").alias("node"), F.col("path")[0] + F.col("path")[1] < 4, "i").toDF("node", "whole", "i")
    files = F.array(F.lit("cameras.txt"), F.lit("images.txt"), F.lit("points3D.txt"))
    rows = p.withColumn("file", F.explode(F.when(F.col("whole"), files).otherwise(F.slice(files, 1, 2))))
    rows.select("node", "file", F.col("i").cast("string").alias("value")).write.partitionBy("node", "file").text(path)
    t = text_model.src_scene_tree(s, path, "/tree-[0-9a-f]*")
    return t.select(F.replace(F.regexp_replace(F.element_at("path", -1), "node=", ""), F.lit("-"), F.lit("/")).alias("node")).distinct()


@query("SELECT i AS a, j AS b, round(score, 8) AS x0, round(score * 12, 8) AS x11, round(i * 0.5, 6) AS cov, (j % 50 + 7)::INT AS n FROM edges")
def src_constraints(s, d):
    """Rows of 75 numbers."""
    path = work_path(s, "constraints")
    e = view(s, d, "edges")
    pose = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: (F.col("score") * k).cast("string"))
    cov = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda k: (F.col("i") * F.when(k == 8, 0.5).otherwise(0.0)).cast("string"))
    n = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: (F.col("j") % 50 + k).cast("string"))
    e.select(F.array_join(F.concat(F.array(F.col("i").cast("string"), F.col("j").cast("string")), pose, cov, n), ",").alias("value")).write.text(path)
    t = text_model.src_constraints(s, path, "part-*")
    return rounded(t.select("a", "b", F.col("pose")[0].alias("x0"), F.col("pose")[11].alias("x11"), F.col("cov")[1][2].alias("cov"), F.col("counts")[1][2].alias("n")), 8)


@query("SELECT i, round(1 - 2 * (qy * qy + qz * qz), 6) AS r00, round(2 * (qy * qz + qw * qx), 6) AS r21, round(tx, 6) AS x, round(tz, 6) AS z, 1.0::DOUBLE AS one FROM cam")
def src_poselog(s, d):
    """Five lines a record."""
    path = work_path(s, "poselog")
    c = cameras(s, d)
    m = g.matrix(F.col("q"))
    row = lambda k: F.concat_ws(" ", *(m[3 * k + j].cast("string") for j in range(3)), F.col("t")["xyz"[k]].cast("string"))
    c.select(F.concat_ws("\n", _text("i", "i", F.lit(0)), row(0), row(1), row(2), F.lit("0 0 0 1")).alias("value")).write.text(path)
    t = text_model.src_poselog(s, path, "part-*")
    return rounded(t.select("i", F.col("m")[0].alias("r00"), F.col("m")[9].alias("r21"), F.col("m")[3].alias("x"), F.col("m")[11].alias("z"), F.col("m")[15].alias("one")))


@query("SELECT i % 40 AS i, round(max(f) + 0.5, 6)::DOUBLE AS f, 320.0::DOUBLE AS cx FROM cam GROUP BY i % 40")
def src_matrix_files(s, d):
    """A calibration matrix per folder i=<number>."""
    path = work_path(s, "matrices")
    f = cameras(s, d).groupBy((F.col("i") % 40).alias("i")).agg((F.max(F.col("params")[0]) + 0.5).alias("f"))
    f.select("i", F.concat(F.col("f").cast("string"), F.lit(" 0 320\n0 "), F.col("f").cast("string"), F.lit(" 240\n0 0 1")).alias("value")).write.partitionBy("i").text(path)
    t = text_model.src_matrix_files(s, path, "part-*")
    return rounded(t.select("i", F.col("m")[0][0].alias("f"), F.col("m")[0][2].alias("cx")))


@query("SELECT run, grp, metric, round(value, 6) AS value FROM metrics")
def src_metrics_json(s, d):
    path = work_path(s, "metrics-json")
    sinks.sink_metrics_json(view(s, d, "metrics"), path)
    return rounded(text_model.src_metrics_json(s, path, "part-*", lines=True))


@query("SELECT 'v' || (i % 9)::VARCHAR AS vehicle, s_name AS camera, round(f, 6)::DOUBLE AS focal, round(qw, 6) AS qw, round(tz, 6) AS tz FROM cam JOIN supplier ON i = s_suppkey")
def src_calibration_json(s, d):
    """A document per vehicle."""
    path = work_path(s, "calibration")
    c = cameras(s, d)
    v = F.struct(F.col("params")[0].alias("focal"), F.col("params")[2].alias("cx"), F.col("params")[3].alias("cy"), F.array(*(F.col("q")[k] for k in "wxyz")).alias("q"), F.array(*(F.col("t")[k] for k in "xyz")).alias("t"))
    c = c.select(F.concat(F.lit("v"), F.col("i") % 9).alias("vehicle"), F.struct(F.col("name").alias("key"), v.alias("value")).alias("c"))
    c.groupBy("vehicle").agg(F.collect_list("c").alias("camera_data")).write.option("maxRecordsPerFile", 1).json(path)
    t = text_model.src_calibration_json(s, path)
    return rounded(t.select("vehicle", "camera", "focal", F.col("q")[0].alias("qw"), F.col("t")[2].alias("tz")))


@query("SELECT 'table ' || (i % 20)::VARCHAR AS \"table\", 'm' || i::VARCHAR || '_' || j::VARCHAR AS metric, id::VARCHAR AS value FROM reports")
def src_report_tables(s, d):
    """A page of two-cell rows below headings."""
    path = work_path(s, "report")
    r = view(s, d, "reports").select((F.col("i") % 20).alias("k"), F.concat(F.lit("<tr><td>m"), F.col("i"), F.lit("_"), F.col("j"), F.lit("</td><td>"), F.col("id"), F.lit("</td></tr>")).alias("row"))
    # A page per group of at most a thousand rows, as pages are short.
    r = r.withColumn("c", F.floor(F.monotonically_increasing_id() / 1000)).groupBy("k", "c").agg(F.concat_ws("\n", F.collect_list("row")).alias("rows"))
    r.select(F.concat(F.lit("<h2>table "), F.col("k"), F.lit("</h2>\n<table>\n"), F.col("rows"), F.lit("\n</table>")).alias("value")).write.text(path)
    return text_model.src_report_tables(s, path, "part-*").select("table", "metric", "value")


@query("""WITH im AS (SELECT p_partkey AS i, lower(p_type) AS m, lower(p_brand) AS o FROM part), s AS (SELECT DISTINCT lower(p_type) AS sm, lower(p_brand) AS so, (length(p_brand) + ascii(right(p_brand, 1)) % 7) / 2.0 AS w FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%3'
 UNION ALL SELECT DISTINCT lower(p_type), lower(left(p_brand, 7)), 9.5 FROM part),
h AS (SELECT i, w, o = so AS exact FROM im LEFT JOIN s ON (contains(m, sm) OR contains(sm, m)) AND (contains(o, so) OR contains(so, o))), b AS (SELECT *, bool_or(exact) OVER (PARTITION BY i) AS best FROM h)
SELECT i, min(w)::DOUBLE AS sensor_width, count(w) AS matches FROM b WHERE best IS NULL OR exact = best GROUP BY i""")
def sensor_width_lookup(s, d):
    """Makers and models of parts against a catalogue of whole models and series."""
    p = s.read.parquet(f"{d}/part.parquet")
    im = p.select(F.col("p_partkey").alias("i"), F.col("p_type").alias("maker"), F.col("p_brand").alias("model"))
    width = (F.length("p_brand") + F.ascii(F.right("p_brand", F.lit(1))) % 7) / 2
    whole = p.where("p_brand like '%1' or p_brand like '%3'").select(F.col("p_type").alias("maker"), F.col("p_brand").alias("model"), width.cast("double").alias("width")).distinct()
    series = p.select(F.col("p_type").alias("maker"), F.left("p_brand", F.lit(7)).alias("model"), F.lit(9.5).alias("width")).distinct()
    return tables.sensor_width_lookup(im, whole.unionByName(series)).select("i", "sensor_width", "matches")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT i // 50 % 12 AS a, j // 50 % 12 AS b FROM edges WHERE i // 50 <> j // 50), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT 0, 7 UNION SELECT 7, 0),
r AS (SELECT 0::BIGINT AS node, 0 AS outside, 0 AS hops UNION SELECT g.b, outside + (CASE WHEN g.b % 3 = 0 THEN 0 ELSE 1 END), hops + 1 FROM r JOIN g ON r.node = g.a WHERE hops < 45)
SELECT node, min(outside) AS outside, (min(outside * 1000 + hops) % 1000)::INT AS hops FROM r GROUP BY node""")
def overlap_path(s, d):
    """From the first of twelve blocks of cameras to all others, blocks divisible by three being siblings; the
    shortcut makes paths that differ in cost."""
    e = view(s, d, "edges").select((F.floor(F.col("i") / 50) % 12).alias("i"), (F.floor(F.col("j") / 50) % 12).alias("j")).where("i <> j").distinct().unionByName(s.sql("SELECT 0L AS i, 7L AS j"))
    nodes = e.select("i").union(e.select("j")).distinct()
    return graph.overlap_path(e, 0, nodes, nodes.where("i % 3 = 0"))


@query("""WITH seen AS (SELECT * FROM points p WHERE EXISTS (SELECT 1 FROM obs o JOIN cam c USING (i) WHERE o.track_id = p.track_id)) SELECT 'tracks' AS metric, count(*)::DOUBLE AS value FROM seen UNION ALL SELECT 'tracks_filtered', count(*) FILTER (o_err < 2) FROM (SELECT *, track_id % 50 / 10.0 AS o_err FROM seen)
UNION ALL SELECT 'mean_error', round(avg(track_id % 50 / 10.0), 6) FROM seen UNION ALL SELECT 'mean_error_filtered', round(avg(track_id % 50 / 10.0) FILTER (track_id % 50 / 10.0 < 2), 6) FROM seen
UNION ALL SELECT 'median_error', round(quantile_cont(track_id % 50 / 10.0, 0.5), 6)::DOUBLE FROM seen UNION ALL SELECT 'cameras', count(*) FROM cam
UNION ALL SELECT 'mean_length', round(avg(n), 6) FROM (SELECT count(*) AS n FROM obs JOIN cam USING (i) JOIN points USING (track_id) GROUP BY track_id)
UNION ALL SELECT 'median_length', quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM obs JOIN cam USING (i) JOIN points USING (track_id) GROUP BY track_id)
UNION ALL SELECT 'mean_length_filtered', round(avg(n), 6) FROM (SELECT count(*) AS n FROM obs JOIN cam USING (i) JOIN points USING (track_id) WHERE track_id % 50 / 10.0 < 2 GROUP BY track_id)""")
def external_model_metrics(s, d):
    """Another pipeline's model, written as text and read again."""
    path = work_path(s, "external")
    one = F.lit("model").alias("scene")
    o = view(s, d, "obs").join(cameras(s, d).select("i"), "i").withColumn("scene", F.lit("model"))
    p = view(s, d, "points").withColumns({"scene": F.lit("model"), "error": F.col("track_id") % 50 / 10.0})
    sinks.sink_points(p, o, path + "/points")
    sinks.sink_cameras(cameras(s, d).select(one, F.col("i").alias("camera_id"), "model", "width", "height", "params"), path + "/cameras")
    return rounded(alignment.external_model_metrics(text_model.src_cameras(s, path + "/cameras", "part-*"), text_model.src_points(s, path + "/points", "part-*"), 2.0))


@query(f"""WITH {PATHS}, e AS (SELECT r.id, a.path AS pa, b.path AS pb, ratio FROM reports r JOIN p a ON r.i = a.i JOIN p b ON r.j = b.i),
n AS (SELECT id, ratio, CASE WHEN pa = pb THEN pa WHEN pa[1:2] = pb[1:2] THEN pa[1:2] WHEN pa[1] = pb[1] THEN pa[1:1] ELSE [] END AS node FROM e)
SELECT array_to_string(node, '/') AS node, count(*) AS n, round(sum(ratio), 6) AS total, len(node) = 3 AS leaf FROM n GROUP BY node""")
def cluster_annotations(s, d):
    """The reports of the edges that each node of the tree owns."""
    a = scenes.cluster_annotations(paths(s, d), view(s, d, "reports").select("i", "j", "id", "ratio"))
    r = a.groupBy("node", "leaf").agg(F.count("*").alias("n"), F.sum("ratio").alias("total"))
    return rounded(r.select(F.array_join("node", "/").alias("node"), "n", "total", "leaf"))


# -- scalar columns ---------------------------------------------------------------------------
@query("SELECT DISTINCT metric, CASE metric WHEN 'rotation_error' THEN 'Rotation Error' ELSE 'Inlier Ratio' END AS name FROM metrics")
def readable_name(s, d):
    return view(s, d, "metrics").select("metric").distinct().select("metric", g.readable_name(F.col("metric")).alias("name"))


_UV = "x / z AS a, y / z AS b, (x * x + y * y) / (z * z) AS r2, sqrt(x * x + y * y) / z AS r"


@query(f"""WITH p AS (SELECT id, {_UV}, id % 5 AS m FROM points WHERE z > 0), t AS (SELECT *, atan(r) AS th FROM p),
k AS (SELECT *, CASE WHEN m = 0 THEN 1 WHEN m = 1 THEN 1 + 0.1 * r2 WHEN m = 2 THEN 1 + 0.1 * r2 + 0.02 * r2 * r2 WHEN m = 3 THEN 1 + 0.1 * r2 + 0.02 * r2 * r2
 ELSE CASE WHEN r > 1e-12 THEN th * (1 + 0.1 * th ** 2 + 0.02 * th ** 4 + 0.003 * th ** 6 + 0.0004 * th ** 8) / r ELSE 1 END END AS g FROM t)
SELECT id, round(700.0193 * (a * g + CASE WHEN m = 3 THEN 2 * 0.003 * a * b + 0.0004 * (r2 + 2 * a * a) ELSE 0 END) + 320, 4) AS u,
 round(CASE WHEN m IN (1, 2) THEN 700.0193 ELSE 650.0371 END * (b * g + CASE WHEN m = 3 THEN 0.003 * (r2 + 2 * b * b) + 2 * 0.0004 * a * b ELSE 0 END) + 240, 4) AS v FROM k""")
def project(s, d):
    """All five camera models."""
    x = lambda *v: F.array(*(F.lit(float(k)) for k in v))
    m = F.col("id") % 5
    model = F.element_at(F.array(*map(F.lit, ("PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "OPENCV_FISHEYE"))), (m + 1).cast("int"))
    p = F.when(m == 0, x(700.0193, 650.0371, 320, 240)).when(m == 1, x(700.0193, 320, 240, 0.1)).when(m == 2, x(700.0193, 320, 240, 0.1, 0.02)).when(
        m == 3, x(700.0193, 650.0371, 320, 240, 0.1, 0.02, 0.003, 0.0004)).otherwise(x(700.0193, 650.0371, 320, 240, 0.1, 0.02, 0.003, 0.0004))
    r = g.bound(view(s, d, "points").withColumns({"_m": model, "_p": p}), "_uv", g.project(F.col("_m"), F.col("_p"), g.vec(F.col("x"), F.col("y"), F.col("z"))))
    return rounded(r.where("_uv is not null").select("id", "_uv.u", "_uv.v"), 4)


#: A matrix of nine numbers per report and two points, in both languages.
_F = ["1 + i % 5", "-2", "0.5", "i % 3", "2", "-1", "0.25", "j % 4", "3"]
_PTS = ["id % 50", "id % 40", "id % 30 + 5", "id % 20"]


def _epipolar(s, d) -> DataFrame:
    r = view(s, d, "reports")
    return r.select("id", F.array(*(F.expr(f"cast({e} as double)") for e in _F)).alias("f"), *(F.expr(f"cast({e} as double)").alias(n) for n, e in zip(("u1", "v1", "u2", "v2"), _PTS)))


EPI = f"""m AS (SELECT id, {', '.join(f'({e})::DOUBLE AS f{k}' for k, e in enumerate(_F))}, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in zip(('u1', 'v1', 'u2', 'v2'), _PTS))} FROM reports),
l AS (SELECT *, f0 * u1 + f1 * v1 + f2 AS a1, f3 * u1 + f4 * v1 + f5 AS b1, f6 * u1 + f7 * v1 + f8 AS c1, f0 * u2 + f3 * v2 + f6 AS a2, f1 * u2 + f4 * v2 + f7 AS b2 FROM m),
e AS (SELECT *, u2 * a1 + v2 * b1 + c1 AS e FROM l)"""


@query(f"WITH {EPI} SELECT id, round(a1, 6) AS a, round(b1, 6) AS b, round(c1, 6) AS c, round(e, 6) AS residual FROM e")
def homogeneous_line(s, d):
    r = g.bound(_epipolar(s, d), "_l", g.line_of(F.col("f"), F.col("u1"), F.col("v1")))
    return rounded(r.select("id", F.col("_l.x").alias("a"), F.col("_l.y").alias("b"), F.col("_l.z").alias("c"),
                            g.epipolar_residual(F.col("f"), F.col("u1"), F.col("v1"), F.col("u2"), F.col("v2")).alias("residual")))


@query(f"WITH {EPI} SELECT id, round(log10(1 + e * e * (1 / (a1 * a1 + b1 * b1) + 1 / (a2 * a2 + b2 * b2))), 6) AS sed, round(log10(1 + e * e / (a1 * a1 + b1 * b1 + a2 * a2 + b2 * b2)), 6) AS sampson FROM e WHERE a1 * a1 + b1 * b1 > 0 AND a2 * a2 + b2 * b2 > 0")
def epipolar_distances(s, d):
    """Symmetric and Sampson distances, by their logarithms as they span many magnitudes."""
    c = [F.col(k) for k in ("f", "u1", "v1", "u2", "v2")]
    r = g.bound(g.bound(_epipolar(s, d), "_a", g.line_of(c[0], c[1], c[2])), "_b", g.line_of(g.transposed(c[0]), c[3], c[4]))
    r = r.where("_a.x * _a.x + _a.y * _a.y > 0 and _b.x * _b.x + _b.y * _b.y > 0")
    return rounded(r.select("id", F.log10(1 + g.epipolar_sed(*c)).alias("sed"), F.log10(1 + g.epipolar_sampson(*c)).alias("sampson")))


@query("""WITH r AS (SELECT i, tx AS x, ty AS y, tz AS z, f, 1 - 2 * (qy * qy + qz * qz) AS m0, 2 * (qx * qy - qw * qz) AS m1, 2 * (qx * qz + qw * qy) AS m2, 2 * (qx * qy + qw * qz) AS m3, 1 - 2 * (qx * qx + qz * qz) AS m4,
 2 * (qy * qz - qw * qx) AS m5, 2 * (qx * qz - qw * qy) AS m6, 2 * (qy * qz + qw * qx) AS m7, 1 - 2 * (qx * qx + qy * qy) AS m8 FROM cam),
e AS (SELECT *, y * m6 - z * m3 AS e0, y * m7 - z * m4 AS e1, y * m8 - z * m5 AS e2, z * m0 - x * m6 AS e3, z * m2 - x * m8 AS e5, x * m5 - y * m2 AS e8 FROM r)
SELECT i, round(e0, 6) AS e0, round(e5, 6) AS e5, round(e8, 6) AS e8, round(e0 / f / f * 1e6, 4) AS f0, round((e2 - e0 * 320 / f - e1 * 240 / f) / f * 1e3, 4) AS f2 FROM e""")
def essential_fundamental(s, d):
    c = cameras(s, d)
    e = g.essential(F.col("q"), F.col("t"))
    f = g.fundamental(e, F.col("params"), F.col("params"))
    pick = lambda m, k: m.__dict__["_items"][k]
    return c.select("i", *(F.round(pick(e, k), 6).alias(f"e{k}") for k in (0, 5, 8)), F.round(pick(f, 0) * 1e6, 4).alias("f0"), F.round(pick(f, 2) * 1e3, 4).alias("f2"))


@query("SELECT id, round(sqrt(x * x + y * y + z * z), 6) AS r, round(acos(z / sqrt(x * x + y * y + z * z)), 6) AS theta, round(atan2(y, x), 6) AS phi, round(x, 6) AS x, round(z, 6) AS z FROM points")
def spherical(s, d):
    """To spherical coordinates and back."""
    p = g.bound(view(s, d, "points"), "_s", g.spherical(g.vec(F.col("x"), F.col("y"), F.col("z"))))
    p = g.bound(p, "_b", g.from_spherical(F.col("_s")))
    return rounded(p.select("id", "_s.r", "_s.theta", "_s.phi", F.col("_b.x").alias("x"), F.col("_b.z").alias("z")))


@query("SELECT id, round(CASE WHEN rotation_err <= 5 THEN exp(-((rotation_err - 5) ** 2) / 2) ELSE exp(-((rotation_err - 5) ** 2) / 200) END, 9) AS score FROM reports")
def piecewise_gaussian(s, d):
    return rounded(view(s, d, "reports").select("id", g.piecewise_gaussian(F.col("rotation_err")).alias("score")), 9)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(sqrt(v[1] / list_sum(v)), 6) AS first, round(list_sum(list_transform(v, lambda x: sqrt(x / list_sum(v)))), 4) AS total FROM e""")
def root_normalise(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    r = g.bound(e, "_r", g.root_normalise(F.col("v")))
    return r.select("vec_id", F.round(F.col("_r")[0], 6).alias("first"), F.round(F.aggregate("_r", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT track_id, i, k, greatest(0, least(6, floor(v * 7 / 480)::INT)) * 7 + greatest(0, least(6, floor(u * 7 / 640)::INT)) AS cell FROM obs")
def patch_cell(s, d):
    return view(s, d, "obs").select("track_id", "i", "k", g.patch_cell(F.col("u"), F.col("v"), 640.0, 480.0, 7).alias("cell"))


@query("""WITH n AS (SELECT o.track_id, o.i, o.k, (o.u - 320) / c.f AS x, (o.v - 240) / c.f AS y FROM obs o JOIN cam c ON o.i = c.i)
SELECT track_id, i, k, round(x / sqrt(x * x + y * y + 1), 6) AS x, round(y / sqrt(x * x + y * y + 1), 6) AS y, round(1 / sqrt(x * x + y * y + 1), 6) AS z FROM n""")
def pixel_ray(s, d):
    o = view(s, d, "obs").join(cameras(s, d).select("i", "params"), "i")
    r = g.bound(o, "_r", g.pixel_ray(F.col("params"), F.col("u"), F.col("v")))
    return rounded(r.select("track_id", "i", "k", "_r.x", "_r.y", "_r.z"))


@query("""SELECT a.i, round(a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz, 6) AS w, round(abs(sin((a.i * 0.37 - (b.i * 0.37 + 0.02 * (b.i % 5 - 2))) / 2) / 3), 6) AS x, round(a.tx, 6) AS back FROM cam a JOIN cam2 b ON a.i = b.i""")
def quaternion_algebra(s, d):
    """conj(a) b of two rotations about one axis, and a vector turned there and back."""
    c = cameras(s, d).join(cameras(s, d, 0.02).select("i", F.col("q").alias("p")), "i")
    m = g.multiply(g.conjugate(F.col("q")), F.col("p"))
    there = g.rotate(F.col("q"), F.col("t"))
    back = g.rotate(g.conjugate(F.col("q")), there)
    part = lambda c, k: c.__dict__["_parts"][k]
    return rounded(c.select("i", part(m, "w").alias("w"), F.abs(part(m, "x")).alias("x"), part(back, "x").alias("back")))


@query("SELECT i, i % 3 = 0 AS ok FROM cam")
def is_rotation(s, d):
    """A rotation, one scaled, one mirrored."""
    c = g.bound(cameras(s, d), "_m", g.matrix(F.col("q")))
    k = F.col("i") % 3
    m = F.when(k == 1, F.transform("_m", lambda x: x * 1.1)).when(k == 2, F.transform("_m", lambda x: -x)).otherwise(F.col("_m"))
    return g.bound(c, "_n", m).select("i", g.is_rotation(F.col("_n")).alias("ok"))
