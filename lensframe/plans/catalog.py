"""Queries of the scene operators over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators import graph, metrics, pairs, scenes, tables, tracks
from lensframe.plans.domain import cameras, poses, sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to the digits that do not depend on the order of additions."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# -- pairs -------------------------------------------------------------------
SIM = """SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"""


def similarity(s, d, k=5, least=0.1):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))
    return pairs.pairs_similarity(v, k, least)


@query(f"""WITH p AS ({SIM}), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS n FROM p WHERE s >= 0.1)
SELECT i, j, round(s, 6) AS score FROM r WHERE n <= 5""")
def pairs_similarity(s, d):
    return rounded(similarity(s, d))


@query("SELECT a.i, b.i AS j FROM images a JOIN images b ON a.i < b.i")
def pairs_exhaustive(s, d):
    return pairs.pairs_exhaustive(view(s, d, "images"))


@query("""SELECT DISTINCT a.conv_id, a.turn AS i, b.turn AS j FROM conversations a JOIN conversations b
ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3""")
def pairs_sequential(s, d):
    return pairs.pairs_sequential(s.read.parquet(f"{d}/conversations.parquet").withColumnRenamed("turn", "i"), 3, "conv_id")


@query("SELECT DISTINCT i, j FROM (SELECT i, j FROM edges UNION SELECT a.i, b.i AS j FROM images a JOIN images b ON b.i > a.i AND b.i <= a.i + 4)")
def pairs_joint(s, d):
    return pairs.pairs_joint(view(s, d, "edges"), pairs.pairs_sequential(view(s, d, "images"), 4))


@query("SELECT i, j, id FROM reports WHERE i < j AND j - i <= 3")
def pair_window_filter(s, d):
    return pairs.pair_window_filter(view(s, d, "reports"), 3).select("i", "j", "id")


@query("""WITH p AS (SELECT points.*, o_custkey AS image FROM points JOIN orders ON id = o_orderkey),
m AS (SELECT a.image AS i, a.track_id AS k1, b.track_id AS k2, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM p a JOIN p b ON b.image = a.image + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY i, k1 ORDER BY d, k2) AS r1, lead(d) OVER (PARTITION BY i, k1 ORDER BY d, k2) AS nd,
 row_number() OVER (PARTITION BY i, k2 ORDER BY d, k1) AS r2 FROM m)
SELECT i, k1, k2, round(d, 6) AS d FROM r WHERE r1 = 1 AND r2 = 1 AND (nd IS NULL OR d <= 0.9 * nd)""")
def match_mutual_nn(s, d):
    """Every customer's points are an image's keypoints; each image is matched with the next one."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image"))
    p = view(s, d, "points").join(o, "id").select("image", F.col("track_id").alias("k"), F.array("x", "y", "z").alias("desc"))
    a, b = p.withColumnRenamed("image", "i"), p.withColumn("i", F.col("image") - 1).drop("image")
    return rounded(pairs.match_mutual_nn(a, b, ["i"], 0.9))


@query("SELECT i, j, id, CASE WHEN ratio < 0.2 THEN 'ratio' WHEN n_inliers < 15 AND n_inliers > 0 THEN 'inliers' END AS failure FROM reports")
def inlier_support(s, d):
    return pairs.inlier_support(view(s, d, "reports"), 15, 0.2).select("i", "j", "id", "failure")


@query("SELECT id FROM reports r WHERE EXISTS (SELECT 1 FROM edges e WHERE e.i = r.i AND e.j = r.j)")
def edge_attr_join(s, d):
    return pairs.edge_attr_join(view(s, d, "reports"), view(s, d, "edges")).select("id")


@query("SELECT i, j FROM edges e WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE e.i = r.i AND e.j = r.j)")
def edge_outliers(s, d):
    return pairs.edge_outliers(view(s, d, "edges"), view(s, d, "reports")).select("i", "j")


@query("""SELECT e.i, e.j FROM edges e WHERE EXISTS (SELECT 1 FROM reports r WHERE r.i = e.i AND r.j = e.j AND r.rotation_err IS NOT NULL)
AND EXISTS (SELECT 1 FROM reports r WHERE r.i = e.i AND r.j = e.j AND r.direction_err IS NOT NULL)""")
def valid_edge_filter(s, d):
    r = view(s, d, "reports")
    return pairs.valid_edge_filter(view(s, d, "edges"), r.withColumnRenamed("rotation_err", "rotation"), r.withColumnRenamed("direction_err", "direction")).select("i", "j")


@query("""SELECT e.i, e.j, a.name AS name_i, b.name AS name_j, r.n AS prior FROM edges e JOIN images a ON e.i = a.i JOIN images b ON e.j = b.i
LEFT JOIN (SELECT i, j, count(*) AS n FROM reports GROUP BY i, j) r ON e.i = r.i AND e.j = r.j""")
def two_view_inputs(s, d):
    prior = view(s, d, "reports").groupBy("i", "j").agg(F.count("*").alias("prior"))
    return pairs.two_view_inputs(view(s, d, "edges"), view(s, d, "images").select("i", "name"), prior).select("i", "j", "name_i", "name_j", "prior")


@query("SELECT i, j, count(*) AS weight FROM reports GROUP BY i, j")
def match_count_weight(s, d):
    return pairs.match_count_weight(view(s, d, "reports"))


@query("""WITH p AS (SELECT DISTINCT i, j FROM edges UNION SELECT h.i, o.i AS j FROM pose h JOIN pose o ON h.i // 5 = o.i // 5 WHERE h.i % 5 = 2 AND o.i % 5 <> 2)
SELECT p.i, p.j, CASE WHEN p.i // 5 = p.j // 5 THEN 'HARD' ELSE 'SOFT' END AS type, round(degrees(2 * acos(least(1, abs(a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz)))), 3) AS turn,
 round(sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2 + (a.tz - b.tz) ** 2), 5) AS dist FROM p JOIN pose a ON p.i = a.i JOIN pose b ON p.j = b.i""")
def rig_priors(s, d):
    """The pairs of the edge table and the stars of all rigs."""
    r = pairs.rig_priors(poses(s, d), view(s, d, "edges"))
    turn = F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(F.col("q.w")))))
    return r.select("i", "j", "type", F.round(turn, 3).alias("turn"), F.round(F.sqrt(F.col("t.x") ** 2 + F.col("t.y") ** 2 + F.col("t.z") ** 2), 5).alias("dist"))


# -- filters -----------------------------------------------------------------
@query("SELECT id FROM reports WHERE rotation_err IS NOT NULL AND direction_err IS NOT NULL")
def valid_two_view(s, d):
    r = view(s, d, "reports").withColumnsRenamed({"rotation_err": "rotation", "direction_err": "direction"})
    return tables.valid_two_view(r).select("id")


@query("""SELECT track_id, i, k, row_number() OVER (PARTITION BY i ORDER BY conf DESC, k, track_id) AS rank FROM obs WHERE conf > 0.4""")
def match_conf_filter(s, d):
    o = view(s, d, "obs").withColumnsRenamed({"k": "k1", "track_id": "k2"})
    return tables.match_conf_filter(o, 0.4, ["i"]).select(F.col("k2").alias("track_id"), "i", F.col("k1").alias("k"), "rank")


@query("SELECT p.track_id FROM points p, (SELECT least(0.6, avg(conf) - stddev_pop(conf)) AS f FROM points) WHERE conf >= f")
def point_conf_filter(s, d):
    return tables.point_conf_filter(view(s, d, "points"), 0.6).select("track_id")


@query("""WITH k AS (SELECT o.* FROM obs o, (SELECT least(0.3, avg(conf) - stddev_pop(conf)) AS f FROM obs) WHERE visibility > 0.15 AND conf > f AND depth > 0)
SELECT track_id, i, k FROM k WHERE track_id IN (SELECT track_id FROM k GROUP BY track_id HAVING count(*) >= 3)""")
def visibility_filter(s, d):
    return tables.visibility_filter(view(s, d, "obs"), 0.15, 0.3, 3).select("track_id", "i", "k")


@query("""WITH f AS (SELECT user_id AS sequence, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n FROM events WHERE
 EXISTS (SELECT 1 FROM events b WHERE b.user_id = events.user_id AND b.ts = events.ts AND b.event_type <> 'error'))
SELECT sequence, event_id, CAST(n // 4 AS BIGINT) AS n FROM f WHERE n % 4 = 0 AND n // 4 < 20""")
def frame_stride(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumnRenamed("user_id", "sequence")
    return tables.frame_stride(e, e.where("event_type <> 'error'"), 4, 20).select("sequence", "event_id", "n")


@query("SELECT track_id FROM points p, (SELECT quantile_cont(sqrt(x**2 + y**2 + z**2), 0.95) AS f FROM points) WHERE sqrt(x**2 + y**2 + z**2) < f")
def norm_percentile_filter(s, d):
    return tables.norm_percentile_filter(view(s, d, "points")).select("track_id")


@query("SELECT track_id FROM (SELECT track_id, row_number() OVER (PARTITION BY scene_id ORDER BY track_id) - 1 AS n FROM points) WHERE n % 10 = 0")
def every_nth(s, d):
    return tables.every_nth(view(s, d, "points"), 10, "track_id", ["scene_id"]).select("track_id")


@query("""SELECT i, CAST(round_even(width * f, 0) AS INT) AS new_width, CAST(round_even(height * f, 0) AS INT) AS new_height,
 round(round_even(width * f, 0) / width * 700, 6) AS new_fx FROM (SELECT *, least(1.0, 450.0::DOUBLE / least(width, height)) AS f FROM images)""")
def rescale_intrinsics(s, d):
    c = view(s, d, "images").selectExpr("i", "width", "height", "700D as fx", "700D as fy", "width / 2 as cx", "height / 2 as cy")
    return rounded(tables.rescale_intrinsics(c, 450).select("i", "new_width", "new_height", "new_fx"))


@query("""SELECT i, round(CASE WHEN i % 3 = 0 THEN (20.0 + i % 30) / 35 * greatest(width, height) WHEN i % 3 = 1 THEN (4.0 + i % 5) / 6.4 * greatest(width, height)
 ELSE 1.2 * greatest(width, height) END, 6) AS focal, i % 3 < 2 AS from_exif FROM images""")
def focal_from_exif(s, d):
    im = view(s, d, "images").withColumns({
        "exif": F.expr("case when i % 3 = 0 then map('FocalLengthIn35mmFilm', cast(20 + i % 30 as string)) when i % 3 = 1 then map('FocalLength', cast(4 + i % 5 as string)) else map('Make', 'x') end"),
        "sensor_width": F.lit(6.4)})
    return rounded(tables.focal_from_exif(im).select("i", "focal", "from_exif"))


@query("SELECT track_id, k FROM obs WHERE CAST(round_even(u, 0) AS BIGINT) % 2 = 0 AND CAST(round_even(v, 0) AS BIGINT) % 3 = 0")
def keypoint_mask(s, d):
    o = view(s, d, "obs")
    m = o.select("i", F.rint("u").cast("long").alias("col"), F.rint("v").cast("long").alias("row")).where("col % 2 = 0 and row % 3 = 0").distinct()
    return tables.keypoint_mask(o, m).select("track_id", "k")


# -- joins -------------------------------------------------------------------
@query("SELECT DISTINCT track_id FROM obs WHERE track_id NOT IN (SELECT track_id FROM obs WHERE i % 10 >= 8)")
def selected_cameras_tracks(s, d):
    return tables.selected_cameras_tracks(view(s, d, "obs"), view(s, d, "images").where("i % 10 < 8")).select("track_id").distinct()


@query("SELECT track_id, i, k FROM obs WHERE i % 10 < 3")
def track_select_for_cameras(s, d):
    return tables.track_select_for_cameras(view(s, d, "obs"), view(s, d, "images").where("i % 10 < 3")).select("track_id", "i", "k")


@query("SELECT i FROM images WHERE i IN (SELECT i FROM obs WHERE track_id % 7 = 0)")
def zero_track_cameras(s, d):
    return tables.zero_track_cameras(view(s, d, "images"), view(s, d, "obs").where("track_id % 7 = 0")).select("i")


@query("SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS in_a, b.name IS NOT NULL AS in_b FROM (SELECT * FROM images WHERE i % 3 > 0) a FULL JOIN (SELECT * FROM images WHERE i % 4 > 0) b ON a.name = b.name")
def compare_runs_by_name(s, d):
    im = view(s, d, "images")
    return tables.compare_runs_by_name(im.where("i % 3 > 0"), im.where("i % 4 > 0"))


@query("""WITH m AS (SELECT run, grp, metric, avg(value) AS value FROM metrics GROUP BY ALL) SELECT a.grp, a.metric, round(a.value, 6) AS value_1, round(b.value, 6) AS value_2
FROM m a LEFT JOIN m b ON a.grp = b.grp AND a.metric = b.metric AND b.run = 'view' WHERE a.run = 'click'""")
def merge_reports(s, d):
    m = view(s, d, "metrics").groupBy("run", "grp", "metric").agg(F.avg("value").alias("value"))
    return rounded(tables.merge_reports(m.where("run = 'click'"), m.where("run = 'view'"), ["grp", "metric"]))


@query("""SELECT e.i, e.j, round(e.score, 9) AS score, greatest(r.rotation_err, r.direction_err) AS pose_err FROM edges e JOIN reports r ON e.i = r.i AND e.j = r.j
WHERE r.rotation_err IS NOT NULL AND r.direction_err IS NOT NULL""")
def similarity_vs_error(s, d):
    return rounded(tables.similarity_vs_error(view(s, d, "edges"), view(s, d, "reports")), 9)


# -- aggregates ----------------------------------------------------------------
@query("SELECT count(*) AS tracks, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, min(n) AS shortest, max(n) AS longest FROM (SELECT count(*) AS n FROM obs GROUP BY track_id)")
def track_length_stats(s, d):
    return rounded(tables.track_length_stats(view(s, d, "obs")))


@query("SELECT i, count(*) AS n FROM obs GROUP BY i")
def camera_obs_count(s, d):
    return tables.camera_obs_count(view(s, d, "obs"))


@query("""SELECT i, count(err) AS n, round(avg(err), 6) AS mean, round(quantile_cont(err, 0.5), 6) AS median, round(max(err), 6) AS worst,
 count(*) FILTER (err < 2) AS good FROM obs GROUP BY i""")
def reproj_by_camera(s, d):
    return rounded(tables.reproj_by_camera(view(s, d, "obs")))


@query("SELECT count(err) AS n, round(avg(err), 6) AS mean, round(quantile_cont(err, 0.5), 6) AS median, round(min(err), 6) AS least, round(max(err), 6) AS most FROM obs")
def scene_reproj_stats(s, d):
    return rounded(tables.scene_reproj_stats(view(s, d, "obs")))


@query("SELECT i, j, round(quantile_cont(rotation_err, 0.5), 6) AS err FROM reports GROUP BY i, j")
def edge_error_agg(s, d):
    return rounded(tables.edge_error_agg(view(s, d, "reports").withColumnRenamed("rotation_err", "err"), "median"))


@query("""SELECT count(*) AS pairs, count(*) FILTER (rotation_err < 5) AS rotation_ok, count(*) FILTER (direction_err < 5) AS direction_ok,
 count(*) FILTER (greatest(rotation_err, direction_err) < 5) AS pose_ok, count(*) FILTER (ratio = 1) AS all_inliers,
 round(quantile_cont(rotation_err, 0.5), 6) AS rotation_median, round(avg(ratio), 6) AS mean_ratio FROM reports""")
def frontend_summary(s, d):
    return rounded(tables.frontend_summary(view(s, d, "reports"), 5.0))


@query("""SELECT i, count(*) FILTER (conf > 0.2) AS n_inliers, round(avg(CAST(conf > 0.2 AS INT)), 6) AS ratio, round(avg(err) FILTER (conf > 0.2), 6) AS inlier_err,
 round(avg(err) FILTER (NOT conf > 0.2), 6) AS outlier_err FROM obs GROUP BY i""")
def two_view_report(s, d):
    return rounded(tables.two_view_report(view(s, d, "obs").withColumn("inlier", F.col("conf") > 0.2), ["i"]))


@query("""SELECT r.i, r.j, a.name AS name_i, b.name AS name_j, nullif(round(rotation_err, 2), 0) AS rotation_err, nullif(round(direction_err, 2), 0) AS direction_err,
 round(ratio, 2) AS ratio FROM reports r JOIN images a ON r.i = a.i JOIN images b ON r.j = b.i""")
def two_view_rows(s, d):
    return tables.two_view_rows(view(s, d, "reports"), view(s, d, "images"))


@query("SELECT n_inliers % 4 AS gt_code, n_inliers % 3 AS code, count(*) AS n FROM reports GROUP BY ALL")
def exit_code_dist(s, d):
    return tables.exit_code_dist(view(s, d, "reports").selectExpr("n_inliers % 4 as gt_code", "n_inliers % 3 as code"))


@query("SELECT (SELECT count(DISTINCT i) FROM images) AS images, (SELECT count(*) FROM edges) AS pairs")
def retriever_summary(s, d):
    return tables.retriever_summary(view(s, d, "images"), view(s, d, "edges"))


@query("SELECT scene_id, round(avg(f), 6) AS f, 320.0::DOUBLE AS cx FROM cam GROUP BY scene_id")
def avg_calibration(s, d):
    return rounded(tables.avg_calibration(cameras(s, d), ["scene_id"]).select("scene_id", F.col("params")[0].alias("f"), F.col("params")[2].alias("cx")))


@query("""WITH px AS (SELECT i, CAST(round_even(u, 0) AS BIGINT) AS col, CAST(round_even(v, 0) AS BIGINT) AS row, max(k % 256) AS r, max(k % 100) AS g, max(k % 50) AS b FROM obs WHERE k % 3 > 0 GROUP BY ALL),
c AS (SELECT o.track_id, avg(px.r) AS r, avg(px.g) AS g, avg(px.b) AS b FROM obs o JOIN px ON o.i = px.i AND CAST(round_even(o.u, 0) AS BIGINT) = px.col AND CAST(round_even(o.v, 0) AS BIGINT) = px.row GROUP BY o.track_id)
SELECT p.track_id, CAST(coalesce(floor(c.r), p.r) AS INT) AS r, CAST(coalesce(floor(c.g), p.g) AS INT) AS g, CAST(coalesce(floor(c.b), p.b) AS INT) AS b FROM points p LEFT JOIN c ON p.track_id = c.track_id""")
def track_color(s, d):
    o = view(s, d, "obs")
    px = o.where("k % 3 > 0").groupBy("i", F.rint("u").cast("long").alias("col"), F.rint("v").cast("long").alias("row")).agg(
        F.expr("max(k % 256)").alias("r"), F.expr("max(k % 100)").alias("g"), F.expr("max(k % 50)").alias("b"))
    return tables.track_color(o, px, view(s, d, "points"))


@query("""WITH x AS (SELECT run, CASE WHEN worker % 4 = 0 THEN 'total' ELSE 'part' || (worker % 4) END AS section, value FROM metrics)
SELECT run, section, round(sum(value), 4) AS seconds FROM x WHERE section <> 'total' GROUP BY ALL
UNION ALL SELECT run, 'remainder', round(sum(CASE WHEN section = 'total' THEN value ELSE -value END), 4) FROM x GROUP BY run""")
def runtime_breakdown(s, d):
    x = view(s, d, "metrics").selectExpr("run", "case when worker % 4 = 0 then 'total' else concat('part', worker % 4) end as section", "value as seconds")
    return rounded(tables.runtime_breakdown(x), 4)


@query("SELECT worker, count(*) AS n FROM metrics GROUP BY worker")
def worker_counts(s, d):
    return tables.worker_counts(view(s, d, "metrics"))


# -- windows -------------------------------------------------------------------
@query("SELECT i, k, track_id FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY response DESC, k, track_id) AS r FROM obs) WHERE r <= 20")
def keypoint_topk(s, d):
    o = view(s, d, "obs").withColumn("k", F.struct("k", "track_id"))
    return tables.keypoint_topk(o, 20).select("i", "k.k", "k.track_id")


@query("SELECT i, j, sum(n) OVER (PARTITION BY i ORDER BY j) - n AS \"offset\" FROM (SELECT i, j, count(*) AS n FROM reports GROUP BY i, j)")
def keypoint_offsets(s, d):
    p = view(s, d, "reports").groupBy("i", "j").agg(F.count("*").alias("n")).withColumns({"i1": F.col("i"), "i2": F.col("j")})
    return tables.keypoint_offsets(p).select("i", "j", "offset")


@query("SELECT i, round(quantile_cont(depth, 0.01), 8) AS near, round(quantile_cont(depth, 0.99), 8) AS far FROM obs GROUP BY i")
def depth_range(s, d):
    return rounded(tables.depth_range(view(s, d, "obs")), 8)


COVER = """WITH t AS (SELECT track_id, count(*) AS n, round(coalesce(avg(err), 0), 9) AS err FROM obs GROUP BY track_id),
r AS (SELECT o.i, CAST(floor(u / 64) + 100 * floor(v / 64) AS BIGINT) AS cell, t.track_id, row_number() OVER (PARTITION BY o.i, floor(u / 64), floor(v / 64) ORDER BY t.n DESC, t.err, t.track_id) AS r
 FROM obs o JOIN t ON o.track_id = t.track_id)"""


@query(COVER + " SELECT DISTINCT track_id FROM r WHERE r = 1")
def coverage_tracks(s, d):
    o = view(s, d, "obs")
    t = o.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("err"), F.lit(0.0)), 9).alias("err"))
    cell = (F.floor(F.col("u") / 64) + 100 * F.floor(F.col("v") / 64)).alias("cell")
    return tables.coverage_tracks(o.select("track_id", "i", cell), t)


@query("""WITH n AS (SELECT track_id, count(DISTINCT i) AS n FROM obs GROUP BY track_id HAVING count(DISTINCT i) >= 3),
r AS (SELECT o.track_id, row_number() OVER (PARTITION BY o.i ORDER BY n DESC, o.track_id) AS r FROM (SELECT DISTINCT track_id, i FROM obs) o JOIN n ON o.track_id = n.track_id)
SELECT DISTINCT track_id FROM r WHERE r <= 12""")
def cover_k_tracks(s, d):
    return tables.cover_k_tracks(view(s, d, "obs"))


@query("SELECT id FROM points ORDER BY conf DESC, id LIMIT 100")
def splat_topk(s, d):
    return tables.splat_topk(view(s, d, "points").withColumnRenamed("conf", "opacity"), 100).select("id")


@query("""SELECT track_id FROM (SELECT track_id, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY md5('42:' || track_id), track_id) AS r FROM points) WHERE r <= floor(n * 0.3)""")
def scene_downsample(s, d):
    return tables.scene_downsample(view(s, d, "points"), 0.3, 42).select("track_id")


@query("SELECT id FROM metrics WHERE ts >= TIMESTAMP '2024-01-20'")
def results_recent(s, d):
    return tables.results_recent(view(s, d, "metrics"), "2024-01-20").select("id")


@query("SELECT i, name, row_number() OVER (PARTITION BY scene_id ORDER BY name) - 1 AS index FROM images")
def sort_by_name(s, d):
    return tables.sort_by_name(view(s, d, "images"), ["scene_id"]).select("i", "name", F.col("index").cast("long"))


# -- sets ------------------------------------------------------------------------
@query("SELECT i FROM images WHERE i % 3 > 0 INTERSECT SELECT i FROM images WHERE i % 4 > 0")
def common_cameras(s, d):
    im = view(s, d, "images")
    return tables.common_cameras(im.where("i % 3 > 0"), im.where("i % 4 > 0"))


@query("SELECT i, 'a' AS src FROM images WHERE i % 3 > 0 UNION ALL SELECT i, 'b' FROM images WHERE i % 4 > 0 AND i % 3 = 0")
def scenes_union(s, d):
    im = view(s, d, "images").select("i")
    return tables.scenes_union(im.where("i % 3 > 0").withColumn("src", F.lit("a")), im.where("i % 4 > 0").withColumn("src", F.lit("b")))


@query("SELECT id FROM points UNION ALL SELECT id FROM points WHERE id % 2 = 0")
def splats_union(s, d):
    p = view(s, d, "points").select("id")
    return tables.splats_union(p, p.where("id % 2 = 0"))
