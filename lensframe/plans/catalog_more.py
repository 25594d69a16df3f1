"""Queries of views, readers and parts that other queries only use in passing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators import metrics, pairs, tables, tracks, views
from lensframe.plans.catalog import rounded
from lensframe.plans.catalog_scene import PATHS, REP, STATUS, _rays, errors, paths
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


@query(f"WITH {REP}, fr AS (SELECT *, f * px / pz + 320 AS pu, f * py / pz + 240 AS pv FROM r2 WHERE pz > 0) SELECT track_id, i, count(*) AS n FROM fr WHERE pu BETWEEN 0 AND 640 AND pv BETWEEN 0 AND 480 GROUP BY track_id, i")
def in_frame(s, d):
    return views.in_frame(errors(s, d), 640.0, 480.0).groupBy("track_id", "i").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT track_id, i FROM obs), r AS (SELECT o.track_id, o.i, p.x - c.tx AS x, p.y - c.ty AS y, p.z - c.tz AS z FROM o JOIN cam c ON o.i = c.i JOIN points p ON o.track_id = p.track_id),
a AS (SELECT a.i, b.i AS j, degrees(acos(greatest(-1, least(1, (a.x*b.x + a.y*b.y + a.z*b.z) / sqrt(a.x**2 + a.y**2 + a.z**2) / sqrt(b.x**2 + b.y**2 + b.z**2))))) AS angle FROM r a JOIN r b ON a.track_id = b.track_id AND a.i < b.i),
s AS (SELECT i, j, sum(CASE WHEN angle <= 5 THEN exp(-((angle - 5) ** 2) / 2) ELSE exp(-((angle - 5) ** 2) / 200) END) AS score FROM a GROUP BY i, j),
w AS (SELECT * FROM s UNION ALL SELECT j, i, score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(score, 9) DESC, j) AS rank FROM w)
SELECT i, rank, round(score, 5) AS score FROM k WHERE rank < 5""")
def source_view_topk(s, d):
    v = views.source_view_topk(view(s, d, "obs"), cameras(s, d), view(s, d, "points"), 5)
    return rounded(v.select("i", F.col("rank").cast("long").alias("rank"), "score"), 5)


@query("""WITH w AS (SELECT i % 20 AS scene, i, score FROM edges UNION ALL SELECT i % 20, j, score FROM edges), t AS (SELECT scene, i, sum(score) AS total FROM w GROUP BY scene, i)
SELECT scene, i, round(total, 8) AS total, row_number() OVER (PARTITION BY scene ORDER BY round(total, 9) DESC, i) AS rank FROM t""")
def frame_rank(s, d):
    """Scores are multiples of 5e-7, so totals are cut where none can lie between two."""
    r = views.frame_rank(view(s, d, "edges").withColumn("scene", F.col("i") % 20), "scene")
    return rounded(r.select("scene", "i", "total", F.col("rank").cast("long").alias("rank")), 8)


@query("""SELECT s_name AS name, round(abs(2 * b.f - a.f) / a.f, 6) AS d_fx, 1.0::DOUBLE AS d_cx, round(abs(degrees(2 * atan(640 / (4 * b.f))) - degrees(2 * atan(640 / (2 * a.f)))), 6) AS d_fov
FROM cam a JOIN cam2 b ON a.i = b.i JOIN supplier ON a.i = s_suppkey WHERE a.i % 3 > 0""")
def intrinsics_delta(s, d):
    """The second run's images are half as wide and high."""
    b = cameras(s, d, 0.02).where("i % 3 > 0").withColumns({"width": F.lit(320), "height": F.lit(240)})
    return rounded(views.intrinsics_delta(cameras(s, d), b).select("name", "d_fx", "d_cx", "d_fov"))


@query("""WITH a AS (SELECT scene_id, 0.02 * (i % 5 - 2) / 2 AS h FROM cam), m AS (SELECT scene_id, count(*) AS n, sum(2 * sin(h) * cos(h)) AS sc, sum(cos(h) ** 2 - sin(h) ** 2) AS cc FROM a GROUP BY scene_id)
SELECT scene_id, n, round(degrees(atan2(sc, cc)), 5) AS angle FROM m""")
def estimate_so3(s, d):
    a = cameras(s, d, 0.02).select("i", "scene_id", F.col("q").alias("a")).join(cameras(s, d).select("i", F.col("q").alias("b")), "i")
    q = views.estimate_so3(a, ["scene_id"])
    turn = F.degrees(2 * F.atan2(F.col("q.x") * 3, F.col("q.w")))
    return rounded(q.select("scene_id", "n", turn.alias("angle")), 5)


@query("""WITH v AS (SELECT r.*, EXISTS (SELECT 1 FROM edges e WHERE e.i = r.i AND e.j = r.j) AS kept FROM reports r WHERE direction_err IS NOT NULL)
SELECT kept, count(*) AS n, round(avg(direction_err), 6) AS mean_err, max(direction_err) AS worst, count(*) FILTER (direction_err <= 5) AS within FROM v GROUP BY kept""")
def direction_avg_metrics(s, d):
    k = view(s, d, "edges").select("i", "j", F.lit(True).alias("k")).distinct()
    r = view(s, d, "reports").join(k, ["i", "j"], "left").withColumn("kept", F.coalesce("k", F.lit(False)))
    return rounded(views.direction_avg_metrics(r, 5.0))


@query("""WITH k AS (SELECT scene_id, i AS key, row_number() OVER (PARTITION BY scene_id ORDER BY i) - 1 AS n FROM images) SELECT k.scene_id, k.key AS i, count(*) AS rows FROM k JOIN obs o ON o.i % 4 = k.n AND o.track_id % 25 = k.scene_id GROUP BY ALL""")
def reorder_scene(s, d):
    rows = view(s, d, "obs").select((F.col("track_id") % 25).alias("scene_id"), (F.col("i") % 4).alias("i"))
    keys = view(s, d, "images").select(F.col("scene_id").cast("long").alias("scene_id"), F.col("i").alias("key"))
    return views.reorder_scene(rows, keys).groupBy("scene_id", "i").agg(F.count("*").alias("rows"))


@query("SELECT i, 0 AS depth FROM images")
def cluster_single(s, d):
    return views.cluster_single(view(s, d, "images")).select("i", F.size("path").alias("depth"))


@query(f"""WITH {PATHS}, e AS (SELECT a.path, count(*) AS n FROM edges JOIN p a ON edges.i = a.i JOIN p b ON edges.j = b.i WHERE a.path = b.path GROUP BY a.path), z AS (SELECT path, count(*) AS keys FROM p GROUP BY path)
SELECT array_to_string(z.path, '/') AS node, keys, keys > 12 AS too_large, coalesce(e.n, 0) AS edges FROM z LEFT JOIN e ON z.path = e.path""")
def cluster_audit(s, d):
    a = views.cluster_audit(paths(s, d), view(s, d, "edges"), 12)
    return a.select(F.array_join("path", "/").alias("node"), "keys", "too_large", "edges")


@query("SELECT i FROM images WHERE i % 3 < 2")
def exif_filter(s, d):
    e = F.expr("case when i % 3 = 0 then map('FocalLengthIn35mmFilm', '28') when i % 3 = 1 then map('FocalLength', '4') else map('Make', 'x') end")
    return tables.exif_filter(view(s, d, "images").withColumns({"exif": e, "sensor_width": F.lit(6.4)})).select("i")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 > 0")
def desc_nan_filter(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(x.cast("double"))).alias("desc"))
    return tables.desc_nan_filter(v).select("vec_id")


@query("SELECT id, round(degrees(acos(greatest(-1, least(1, (x * y + y * z + z * x) / (x**2 + y**2 + z**2))))), 4) AS angle FROM points")
def direction_angle_err(s, d):
    x, y, z = (F.col(c) for c in "xyz")
    return rounded(view(s, d, "points").select("id", g.direction_angle(g.vec(x, y, z), g.vec(y, z, x)).alias("angle")), 4)


@query("SELECT a.i, round(sqrt((a.tx - b.tx)**2 + (a.ty - b.ty)**2 + (a.tz - b.tz)**2), 6) AS dist FROM cam a JOIN cam2 b ON a.i = b.i")
def translation_dist(s, d):
    return rounded(metrics.pose_errors(cameras(s, d), cameras(s, d, 0.02)).select("i", F.col("position_err").alias("dist")))


@query("""WITH k AS (SELECT i, j, id, ratio, i % 10 AS island, row_number() OVER (PARTITION BY i % 10 ORDER BY ratio DESC, i, j, id) AS r FROM reports) SELECT island, count(*) AS n, round(sum(ratio), 6) AS total FROM k WHERE r <= 10 GROUP BY island""")
def bridge_topk(s, d):
    r = view(s, d, "reports").select("i", "j", F.col("ratio").alias("score"), (F.col("i") % 10).alias("island"))
    return rounded(pairs.bridge_topk(r, "island", 10).groupBy("island").agg(F.count("*").alias("n"), F.sum("score").alias("total")))


@query("""WITH c AS (SELECT i AS a, i + 1 AS b, x, y, (i * 7 + x * 5 + y) % 60 AS n FROM images, (SELECT unnest([0, 1, 2, 3, 4]) AS x), (SELECT unnest([0, 1, 2, 3, 4]) AS y)) SELECT a * 5 + x AS i, b * 5 + y AS j, n FROM c WHERE n >= 30""")
def rig_predicted_pairs(s, d):
    five = F.sequence(F.lit(0), F.lit(4))
    n = F.transform(five, lambda x: F.transform(five, lambda y: (F.col("i") * 7 + x * 5 + y) % 60))
    return pairs.rig_predicted_pairs(view(s, d, "images").select(F.col("i").alias("a"), (F.col("i") + 1).alias("b"), n.alias("counts")))


@query("""WITH w AS (SELECT e.i, e.j, c.qw AS w, c.qx AS a, c.qy AS b, c.qz AS c FROM edges e JOIN cam c ON e.i = c.i) SELECT i, j, round(1 - 2 * (b * b + c * c), 6) AS x, round(2 * (a * b + w * c), 6) AS y, round(2 * (a * c - w * b), 6) AS z FROM w""")
def world_directions(s, d):
    return rounded(metrics.world_directions(view(s, d, "edges").withColumn("direction", g.vec(1.0, 0.0, 0.0)), cameras(s, d)))


@query("""WITH w AS (SELECT o.track_id, o.i, o.k, c.qw AS w, c.qx AS a, c.qy AS b, c.qz AS c, (o.u - 320) / c.f AS x, (o.v - 240) / c.f AS y FROM obs o JOIN cam c ON o.i = c.i),
n AS (SELECT *, sqrt(x * x + y * y + 1) AS l FROM w), r1 AS (SELECT *, (b - c * y) / l AS cx, (c * x - a) / l AS cy, (a * y - b * x) / l AS cz FROM n)
SELECT track_id, i, round(x / l + 2 * w * cx + 2 * (b * cz - c * cy), 6) AS x, round(y / l + 2 * w * cy + 2 * (c * cx - a * cz), 6) AS y, round(1 / l + 2 * w * cz + 2 * (a * cy - b * cx), 6) AS z FROM r1""")
def landmark_directions(s, d):
    return rounded(metrics.landmark_directions(view(s, d, "obs"), cameras(s, d)))


@query("""WITH m AS (SELECT r.id, 1.0 + r.i % 5 AS a, 2.0 + r.j % 3 AS b, 0.5 AS c, r.i % 50 AS u1, r.j % 40 AS v1, r.i % 30 + 5 AS u2, r.id % 20 AS v2 FROM reports r),
l AS (SELECT *, b - c * v1 AS x1, c * u1 - a AS y1, a * v1 - b * u1 AS z1, c * v2 - b AS x2, a - c * u2 AS y2 FROM m)
SELECT id, (u2 * x1 + v2 * y1 + z1) ** 2 / (x1 ** 2 + y1 ** 2 + x2 ** 2 + y2 ** 2) < 4.0001 AS inlier FROM l""")
def gt_inliers(s, d):
    """The pair's matrix is that of a camera that only moves."""
    r = view(s, d, "reports").selectExpr("id as i", "0L as j", "1D + i % 5 as a", "2D + j % 3 as b", "0.5D as c", "cast(i % 50 as double) as u1", "cast(j % 40 as double) as v1", "cast(i % 30 + 5 as double) as u2", "cast(id % 20 as double) as v2")
    z = F.lit(0.0)
    f = F.array(z, -F.col("c"), F.col("b"), F.col("c"), z, -F.col("a"), -F.col("b"), F.col("a"), z)
    out = metrics.gt_inliers(r.select("i", "j", "u1", "v1", "u2", "v2"), r.select("i", "j", f.alias("f")), 4.0001**0.5)
    return out.select(F.col("i").alias("id"), "inlier")


@query(f"""SELECT coalesce(a.track_id, b.track_id) AS track_id, a.gt_code, b.code FROM (WITH {_rays("cam")} SELECT track_id, {STATUS} AS gt_code FROM t) a
FULL JOIN (WITH {_rays("cam2")} SELECT track_id, {STATUS} AS code FROM t) b ON a.track_id = b.track_id""")
def classify_tracks(s, d):
    return tracks.classify_tracks(view(s, d, "obs"), cameras(s, d), cameras(s, d, 0.02))


@query("SELECT i, j FROM edges")
def src_pairs(s, d):
    path = work_path(s, "pairs")
    view(s, d, "edges").select("i", "j").write.option("header", True).csv(path)
    return text_model.src_pairs(s, path)


@query("SELECT i AS id, round(tx, 6) AS x, round(ty, 6) AS y, round(qw, 6) AS qw, round(qz, 6) AS qz FROM cam")
def src_posegraph(s, d):
    path = work_path(s, "posegraph")
    c = cameras(s, d)
    line = F.concat_ws(" ", F.lit("VERTEX_SE3:QUAT"), *(x.cast("string") for x in (F.col("i"), *(F.col(f"t.{k}") for k in "xyz"), *(F.col(f"q.{k}") for k in "xyzw"))))
    c.select(line.alias("value")).write.text(path)
    return rounded(text_model.src_posegraph(s, path, "part-*").select("id", "x", "y", "qw", "qz"))


@query("SELECT DISTINCT least(e.i, e.j) AS i, greatest(e.i, e.j) AS j FROM edges e JOIN images a ON e.i = a.i JOIN images b ON e.j = b.i")
def src_covis_pairs(s, d):
    im = view(s, d, "images").select(F.replace("name", F.lit("#"), F.lit("_")).alias("name"), "i")
    im = im.withColumn("name", F.replace("name", F.lit("-"), F.lit("_")))
    a, b = im.select(F.col("name").alias("a"), "i"), im.select(F.col("name").alias("b"), F.col("i").alias("j"))
    e = view(s, d, "edges").join(a, "i").join(b, "j").select(F.concat_ws("-", "b", "a").alias("value"))
    return text_model.src_covis_pairs(e, im)


@query("SELECT run, grp, metric, round(value, 6) AS value FROM metrics")
def sink_metrics_csv(s, d):
    path = work_path(s, "metrics-csv")
    sinks.sink_metrics_csv(view(s, d, "metrics").select("run", "grp", "metric", "value"), path)
    return rounded(s.read.schema("run string, grp string, metric string, value double").option("header", True).csv(path))


@query("SELECT id, worker FROM metrics")
def sink_results_log(s, d):
    """Two appends to one log."""
    path = work_path(s, "results-log")
    m = view(s, d, "metrics").select("id", "worker")
    sinks.sink_results_log(m.where("id % 2 = 0"), path)
    sinks.sink_results_log(m.where("id % 2 <> 0"), path)
    return s.read.schema(m.schema).parquet(path)
