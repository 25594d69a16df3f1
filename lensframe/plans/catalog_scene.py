"""Queries of the graph, track, scene, cluster and metric operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators import graph, metrics, scenes, tracks
from lensframe.plans.catalog import SIM, rounded, similarity
from lensframe.plans.domain import cameras, sql, view

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


# -- graph -----------------------------------------------------------------------
#: Labels by recursion: each node reaches ever smaller ones.
CC = """WITH RECURSIVE b AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges),
reach(node, label) AS (SELECT DISTINCT i, i FROM b UNION SELECT b.j, r.label FROM reach r JOIN b ON r.node = b.i WHERE r.label < b.j),
cc AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"""


@query(CC + " SELECT node, component FROM cc")
def connected_components(s, d):
    return graph.connected_components(view(s, d, "edges"))


LCC = CC + ", main AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), lcc AS (SELECT node FROM cc WHERE component IN (SELECT component FROM main))"


@query(LCC + " SELECT node FROM lcc")
def largest_component(s, d):
    return graph.largest_component(view(s, d, "edges"))


@query(LCC + " SELECT i, j, round(score, 9) AS score FROM edges WHERE i IN (SELECT node FROM lcc) AND j IN (SELECT node FROM lcc)")
def prune_to_lcc(s, d):
    return rounded(graph.prune_to_lcc(view(s, d, "edges")), 9)


@query("SELECT i AS node, count(DISTINCT j) AS degree, CAST(sum(DISTINCT j) AS BIGINT) AS total FROM (SELECT i, j FROM edges UNION SELECT j, i FROM edges) GROUP BY i")
def adjacency(s, d):
    a = graph.adjacency(view(s, d, "edges"))
    return a.select("node", "degree", F.aggregate("neighbours", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


TRI = """t AS (SELECT e.i AS a, e.j AS b, f.j AS c FROM edges e JOIN edges f ON e.j = f.i JOIN edges h ON h.i = e.i AND h.j = f.j)"""


@query("WITH " + TRI + " SELECT a, b, c FROM t")
def triangles(s, d):
    return graph.triangles(view(s, d, "edges"))


def rotations(e: DataFrame) -> DataFrame:
    """About one axis, so that angles add up; some edges are off."""
    h = (0.1 * (F.col("j") - F.col("i")) + 0.05 * F.expr("(i * 7 + j) % 5")) / 2
    return e.select("i", "j", g.quat(F.cos(h), F.sin(h) / 3, F.sin(h) * 2 / 3, F.sin(h) * 2 / 3).alias("q"))


NOISE = "0.05 * ((t.a * 7 + t.b) % 5) + 0.05 * ((t.b * 7 + t.c) % 5) - 0.05 * ((t.a * 7 + t.c) % 5)"
CYC = TRI + f", ce AS (SELECT a, b, c, degrees(abs({NOISE})) AS err FROM t)"


@query(f"WITH {CYC} SELECT a, b, c, round(err, 4) AS err FROM ce")
def rotation_cycle_error(s, d):
    e = view(s, d, "edges")
    return rounded(graph.rotation_cycle_error(graph.triangles(e), rotations(e)), 4)


@query(f"""WITH {CYC}, x AS (SELECT a AS i, b AS j, err FROM ce UNION ALL SELECT b, c, err FROM ce UNION ALL SELECT a, c, err FROM ce),
m AS (SELECT i, j, quantile_cont(err, 0.5) AS cycle_err FROM x GROUP BY i, j)
SELECT e.i, e.j, round(m.cycle_err, 4) AS cycle_err FROM edges e LEFT JOIN m ON e.i = m.i AND e.j = m.j WHERE m.cycle_err IS NULL OR m.cycle_err < 7""")
def cycle_filter(s, d):
    e = view(s, d, "edges")
    return rounded(graph.cycle_filter(e, rotations(e)).select("i", "j", "cycle_err"), 4)


@query(CC + """, sz AS (SELECT component, count(*) AS n FROM cc GROUP BY component), main AS (SELECT component AS m FROM sz ORDER BY n DESC, component LIMIT 1),
x AS (SELECT r.i, r.j, r.ratio AS score, CASE WHEN a.component = m THEN b.component ELSE a.component END AS island,
 CASE WHEN a.component = m THEN sb.n ELSE sa.n END AS size FROM (SELECT i, j, max(ratio) AS ratio FROM reports WHERE ratio >= 0.1 GROUP BY i, j) r
 JOIN cc a ON r.i = a.node JOIN cc b ON r.j = b.node JOIN sz sa ON a.component = sa.component JOIN sz sb ON b.component = sb.component, main
 WHERE a.component <> b.component AND (a.component = m OR b.component = m)),
k AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY score DESC, i, j) AS r FROM x WHERE size >= 3)
SELECT i, j, round(score, 6) AS score, island FROM k WHERE r <= 10 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.i = k.i AND e.j = k.j)""")
def bridge_reconnect(s, d):
    r = view(s, d, "reports").groupBy("i", "j").agg(F.max("ratio").alias("score")).where("score >= 0.1")
    return rounded(graph.bridge_reconnect(view(s, d, "edges"), r, min_score=0.1))


@query("SELECT a.i, b.i AS j, count(*) AS shared FROM (SELECT DISTINCT track_id, i FROM obs) a JOIN (SELECT DISTINCT track_id, i FROM obs) b ON a.track_id = b.track_id AND a.i < b.i GROUP BY a.i, b.i")
def covis_edges(s, d):
    return graph.covis_edges(view(s, d, "obs"))


@query("""WITH RECURSIVE o AS (SELECT track_id, CASE WHEN track_id % 7 = 0 THEN i + 100000 ELSE i END AS i FROM obs WHERE track_id % 7 > 0 OR i % 3 = 0),
e AS (SELECT DISTINCT a.i, b.i AS j FROM o a JOIN o b ON a.track_id = b.track_id AND a.i <> b.i), r AS (SELECT i, i AS j FROM (SELECT DISTINCT i FROM o) UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
c AS (SELECT i, min(j) AS c FROM r GROUP BY i), big AS (SELECT c FROM c GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)
SELECT track_id, count(*) AS n FROM o JOIN c USING (i) WHERE c.c = (SELECT c FROM big) GROUP BY track_id""")
def scene_lcc(s, d):
    """Every seventh track is seen by cameras of another part of the scene, which is cut off."""
    o = view(s, d, "obs").select("track_id", "i").where("track_id % 7 > 0 or i % 3 = 0")
    o = o.withColumn("i", F.when(F.col("track_id") % 7 == 0, F.col("i") + 100000).otherwise(F.col("i")))
    return graph.scene_lcc(o).groupBy("track_id").agg(F.count("*").alias("n"))


@query("SELECT least(i, j) AS i, greatest(i, j) AS j FROM edges WHERE i % 4 > 0 AND j % 4 > 0")
def induced_edges(s, d):
    e = view(s, d, "edges")
    return graph.induced_edges(e, e.select("i").union(e.select("j")).where("i % 4 > 0")).select("i", "j")


@query("SELECT least(i % 10, j % 10) AS a, greatest(i % 10, j % 10) AS b, count(*) AS n FROM edges WHERE i % 10 <> j % 10 GROUP BY ALL")
def cross_edges(s, d):
    e = view(s, d, "edges")
    c = e.select("i").union(e.select("j")).distinct().withColumn("cluster", F.col("i") % 10)
    return graph.cross_edges(e, c)


# -- tracks ------------------------------------------------------------------------
@query("SELECT track_id, i, k FROM obs WHERE track_id NOT IN (SELECT track_id FROM obs GROUP BY track_id HAVING count(*) <> count(DISTINCT i))")
def tracks_unique_cameras(s, d):
    return tracks.tracks_unique_cameras(view(s, d, "obs")).select("track_id", "i", "k")


@query("SELECT track_id, i, k FROM obs WHERE track_id IN (SELECT track_id FROM obs GROUP BY track_id HAVING count(*) >= 4)")
def track_min_length(s, d):
    return tracks.track_min_length(view(s, d, "obs"), 4).select("track_id", "i", "k")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS i1, c_custkey + 1 AS i2, c_custkey % 3 AS k1, (c_custkey + 1) % 3 AS k2 FROM customer WHERE c_nationkey % 5 > 0),
n AS (SELECT i1 * 4294967296 + k1 AS a, i2 * 4294967296 + k2 AS b FROM m), b AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
reach(node, label) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, r.label FROM reach r JOIN b ON r.node = b.a WHERE r.label < b.b)
SELECT min(label) AS track_id, CAST(node // 4294967296 AS BIGINT) AS i, CAST(node % 4294967296 AS BIGINT) AS k FROM reach GROUP BY node""")
def tracks_union_find(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").where("c_nationkey % 5 > 0")
    return tracks.tracks_union_find(c.selectExpr("c_custkey as i1", "c_custkey + 1 as i2", "c_custkey % 3 as k1", "(c_custkey + 1) % 3 as k2"))


#: Projection of the points into the cameras, spelled out.
REP = """w AS (SELECT o.track_id, o.i, o.k, o.u, o.v, c.f, c.qw AS w, -c.qx AS a, -c.qy AS b, -c.qz AS c, p.x - c.tx AS x, p.y - c.ty AS y, p.z - c.tz AS z
 FROM obs o LEFT JOIN cam c ON o.i = c.i LEFT JOIN points p ON o.track_id = p.track_id),
r1 AS (SELECT *, b * z - c * y AS cx, c * x - a * z AS cy, a * y - b * x AS cz FROM w),
r2 AS (SELECT *, x + 2 * w * cx + 2 * (b * cz - c * cy) AS px, y + 2 * w * cy + 2 * (c * cx - a * cz) AS py, z + 2 * w * cz + 2 * (a * cy - b * cx) AS pz FROM r1),
rep AS (SELECT track_id, i, k, pz AS depth, CASE WHEN pz > 0 THEN sqrt((f * px / pz + 320 - u) ** 2 + (f * py / pz + 240 - v) ** 2) END AS err FROM r2)"""


def errors(s, d) -> DataFrame:
    return tracks.reprojection_error(view(s, d, "obs"), cameras(s, d), view(s, d, "points"))


@query(f"WITH {REP} SELECT track_id, i, round(depth, 5) AS depth, CASE WHEN err < 1e6 THEN round(err, 3) END AS err, CASE WHEN err >= 1e6 THEN round(log10(err), 6) END AS log_err FROM rep")
def reprojection_error(s, d):
    """Errors of points almost in the camera's plane are compared by their logarithm."""
    e, near = errors(s, d), F.col("err") < 1e6
    return e.select("track_id", "i", F.round("depth", 5).alias("depth"), F.when(near, F.round("err", 3)).alias("err"), F.when(~near, F.round(F.log10("err"), 6)).alias("log_err"))


@query(f"WITH {REP} SELECT track_id, count(*) AS n, coalesce(bool_or(depth < 0), false) AS behind, coalesce(bool_or(err > 300), false) AS far, count(*) FILTER (err IS NULL) AS failed FROM rep GROUP BY track_id")
def inspect_tracks(s, d):
    return scenes.inspect_tracks(errors(s, d), 300.0).drop("worst")


@query(f"""WITH {REP}, m AS (SELECT track_id, max(err) AS worst, count(*) FILTER (err IS NULL) AS failed FROM rep GROUP BY track_id)
SELECT l."limit", count(*) FILTER (failed = 0 AND worst < l."limit") AS kept, count(*) AS tracks FROM m, (SELECT unnest([1000.0::DOUBLE, 500.0, 300.0]) AS "limit") l GROUP BY l."limit" """)
def staged_filter(s, d):
    return scenes.staged_filter(errors(s, d), [1000.0, 500.0, 300.0])


@query(f"WITH {REP} SELECT track_id, i FROM rep WHERE track_id IN (SELECT track_id FROM rep GROUP BY track_id HAVING bool_and(err IS NOT NULL AND err < 600))")
def filter_landmarks(s, d):
    return scenes.filter_landmarks(errors(s, d), 600.0).select("track_id", "i")


@query(f"WITH {REP}, k AS (SELECT * FROM rep WHERE err <= 600) SELECT track_id, i FROM k WHERE track_id IN (SELECT track_id FROM k GROUP BY track_id HAVING count(DISTINCT i) >= 2)")
def filter_measurements(s, d):
    return scenes.filter_measurements(errors(s, d), 600.0, 2).select("track_id", "i")


@query("""WITH m AS (SELECT track_id, avg(err) AS e FROM obs GROUP BY track_id) SELECT track_id, round(e, 6) AS mean_err FROM m, (SELECT least(5.0, 1.1 * quantile_cont(e, 0.5)) AS c FROM m) WHERE e <= c""")
def drop_outlier_tracks(s, d):
    o = view(s, d, "obs").select("track_id", "err", F.monotonically_increasing_id().alias("row"))  # rows as the table holds them
    return rounded(scenes.drop_outlier_tracks(o, 5.0, 1.1, order="row"))


@query("""WITH lo AS (SELECT DISTINCT track_id, i FROM obs WHERE conf < 0.2), k AS (SELECT o.* FROM obs o ANTI JOIN lo ON o.track_id = lo.track_id AND o.i = lo.i)
SELECT track_id, i, k FROM k WHERE track_id IN (SELECT track_id FROM k GROUP BY track_id HAVING count(*) >= 2)""")
def factor_weight_filter(s, d):
    o = view(s, d, "obs")
    return tracks.factor_weight_filter(o, o.withColumnRenamed("conf", "weight"), 0.2, 2).select("track_id", "i", "k")


@query("""SELECT id, x, y, z, CAST(floor(greatest(0, least(1, 0.5 + 0.28209479177387814::DOUBLE * (conf * 4 - 2))) * 255) AS INT) AS r,
 CAST(floor(greatest(0, least(1, 0.5 + 0.28209479177387814::DOUBLE * (3 - conf * 5))) * 255) AS INT) AS g,
 CAST(floor(greatest(0, least(1, 0.5 + 0.28209479177387814::DOUBLE * (z / 6 - 2))) * 255) AS INT) AS b FROM points""")
def gaussian_to_points(s, d):
    p = view(s, d, "points").drop("r", "g", "b")
    return tracks.gaussian_to_points(p.withColumns({"f_r": F.col("conf") * 4 - 2, "f_g": 3 - F.col("conf") * 5, "f_b": F.col("z") / 6 - 2})).select("id", "x", "y", "z", "r", "g", "b")


@query("""WITH o AS (SELECT DISTINCT track_id, i FROM obs), r AS (SELECT o.track_id, o.i, p.x - c.tx AS x, p.y - c.ty AS y, p.z - c.tz AS z FROM o JOIN cam c ON o.i = c.i JOIN points p ON o.track_id = p.track_id)
SELECT a.track_id, round(max(degrees(acos(greatest(-1, least(1, (a.x*b.x + a.y*b.y + a.z*b.z) / sqrt(a.x**2 + a.y**2 + a.z**2) / sqrt(b.x**2 + b.y**2 + b.z**2)))))), 4) AS angle
FROM r a JOIN r b ON a.track_id = b.track_id AND a.i < b.i GROUP BY a.track_id""")
def track_max_angle(s, d):
    return rounded(tracks.track_max_angle(view(s, d, "obs"), cameras(s, d), view(s, d, "points")), 4)


def _rays(cam: str) -> str:
    """World rays of all measurements, and per track the sums of (I - d d^T) and of its product with the centre."""
    return f"""w AS (SELECT o.track_id, c.qw AS w, c.qx AS a, c.qy AS b, c.qz AS c, c.tx, c.ty, c.tz, (o.u - 320) / c.f AS x, (o.v - 240) / c.f AS y FROM obs o JOIN {cam} c ON o.i = c.i),
n AS (SELECT *, sqrt(x * x + y * y + 1) AS l FROM w), r1 AS (SELECT *, (b - c * y) / l AS cx, (c * x - a) / l AS cy, (a * y - b * x) / l AS cz FROM n),
r AS (SELECT track_id, tx, ty, tz, x / l + 2 * w * cx + 2 * (b * cz - c * cy) AS dx, y / l + 2 * w * cy + 2 * (c * cx - a * cz) AS dy, 1 / l + 2 * w * cz + 2 * (a * cy - b * cx) AS dz FROM r1),
g AS (SELECT *, dx * tx + dy * ty + dz * tz AS k FROM r),
m AS (SELECT track_id, count(*) AS n, sum(1 - dx * dx) AS xx, sum(-dx * dy) AS xy, sum(-dx * dz) AS xz, sum(1 - dy * dy) AS yy, sum(-dy * dz) AS yz, sum(1 - dz * dz) AS zz,
 sum(tx - dx * k) AS vx, sum(ty - dy * k) AS vy, sum(tz - dz * k) AS vz FROM g GROUP BY track_id),
t AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m)"""


STATUS = "CASE WHEN n < 2 THEN 'FEW' WHEN det <= 1e-9 THEN 'DEGENERATE' ELSE 'SUCCESS' END"


@query(f"""WITH {_rays("cam")} SELECT track_id, n, {STATUS} AS status,
 CASE WHEN n >= 2 AND det > 0.01 THEN round(((yy * zz - yz * yz) * vx + (xz * yz - xy * zz) * vy + (xy * yz - xz * yy) * vz) / det, 3) END AS x,
 CASE WHEN n >= 2 AND det > 0.01 THEN round(((xz * yz - xy * zz) * vx + (xx * zz - xz * xz) * vy + (xy * xz - xx * yz) * vz) / det, 3) END AS y,
 CASE WHEN n >= 2 AND det > 0.01 THEN round(((xy * yz - xz * yy) * vx + (xy * xz - xx * yz) * vy + (xx * yy - xy * xy) * vz) / det, 3) END AS z, det > 0.01 AS firm FROM t""")
def track_triangulate(s, d):
    """Points are compared where the rays are far from parallel, the status everywhere."""
    t = tracks.track_triangulate(view(s, d, "obs"), cameras(s, d))
    firm = F.col("det") > 0.01
    return t.select("track_id", "n", "status", *(F.when((F.col("n") >= 2) & firm, F.round(c, 3)).alias(c) for c in "xyz"), firm.alias("firm"))


@query("""WITH RECURSIVE o AS (SELECT track_id, i, u * 40 AS u, v + track_id % 977 AS v FROM obs), k AS (SELECT *, floor(u) AS cu, floor(v) AS cv FROM o),
e AS (SELECT DISTINCT a.track_id AS a, b.track_id AS b FROM k a JOIN k b USING (i, cu, cv) WHERE a.track_id <> b.track_id), r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS track_id, min(b) AS c FROM r GROUP BY a), m AS (SELECT coalesce(c.c, o.track_id) AS merged, o.* FROM o LEFT JOIN c USING (track_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY merged, i ORDER BY track_id, u, v) AS n FROM m) SELECT merged AS track_id, i, round(u, 4) AS u, round(v, 4) AS v FROM z WHERE n = 1""")
def merge_duplicate_tracks(s, d):
    return rounded(_merged(s, d), 4)


def _merged(s, d):
    return tracks.merge_duplicate_tracks(view(s, d, "obs").select("track_id", "i", (F.col("u") * 40).alias("u"), (F.col("v") + F.col("track_id") % 977).alias("v")))


@query()
def keypoint_dedup(s, d):
    o = view(s, d, "obs")
    return tracks.keypoint_dedup(o.select("i", F.col("i").alias("i1"), (F.col("track_id") % 7).alias("i2"), F.col("track_id").alias("k"), "u", "v"))


# -- scenes -------------------------------------------------------------------------
@query("SELECT scene_id, round(qw, 6) AS w, tx AS x, i FROM cam WHERE i % 6 > 0")
def init_cameras(s, d):
    c = cameras(s, d)
    poses = c.select("i", F.when(F.col("i") % 6 > 0, F.col("q")).alias("q"), "t")
    return scenes.init_cameras(poses, c.select("i", "scene_id")).select("scene_id", F.round("q.w", 6).alias("w"), F.col("t.x").alias("x"), "i")


@query("SELECT track_id, round(2 * (-y + 1), 6) AS x, round(2 * (x + 2), 6) AS y, round(2 * (z + 3), 6) AS z FROM points")
def apply_sim3(s, d):
    """A quarter turn about z, a shift and a doubling."""
    p = view(s, d, "points")
    h = F.lit(0.5).cast("double")
    q = g.quat(F.sqrt(h), F.lit(0.0), F.lit(0.0), F.sqrt(h))
    sims = p.select("scene_id").distinct().withColumns({"s": F.lit(2.0), "q": q, "t": g.vec(1.0, 2.0, 3.0)})
    return rounded(scenes.apply_sim3(p, sims).select("track_id", "x", "y", "z"))


@query("SELECT scene_id, count(*) AS n, 2.0::DOUBLE AS s, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, 3.0::DOUBLE AS z FROM points GROUP BY scene_id")
def estimate_sim3(s, d):
    p = view(s, d, "points")
    b = g.vec(2 * (1 - F.col("y")), 2 * (F.col("x") + 2), 2 * (F.col("z") + 3))
    r = scenes.estimate_sim3(p.select("scene_id", g.vec(F.col("x"), F.col("y"), F.col("z")).alias("a"), b.alias("b")), ["scene_id"])
    return rounded(r.select("scene_id", "n", "s", "t.x", "t.y", "t.z"))


@query("""WITH m AS (SELECT scene_id, avg(tx) AS a, avg(ty) AS b, avg(tz) AS c FROM cam GROUP BY scene_id), k AS (SELECT cam.i, cam.scene_id, tx - a AS x, ty - b AS y, tz - c AS z FROM cam JOIN m ON cam.scene_id = m.scene_id),
s AS (SELECT scene_id, max(greatest(abs(x), abs(y), abs(z))) AS s FROM k GROUP BY scene_id) SELECT i, round(x / s, 6) AS x, round(y / s, 6) AS y, round(z / s, 6) AS z FROM k JOIN s ON k.scene_id = s.scene_id""")
def normalise_poses(s, d):
    return rounded(scenes.normalise_poses(cameras(s, d)).select("i", "t.x", "t.y", "t.z"))


@query("""WITH r AS (SELECT i, k AS vertex, qw AS w, qx AS a, qy AS b, qz AS c, tx, ty, tz, CASE WHEN k = 0 THEN 0 ELSE 2 * (CASE WHEN k IN (2, 3) THEN 320 ELSE -320 END) / f END AS x,
 CASE WHEN k = 0 THEN 0 ELSE 2 * (CASE WHEN k >= 3 THEN 240 ELSE -240 END) / f END AS y, CASE WHEN k = 0 THEN 0 ELSE 2 END AS z FROM cam, (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
r1 AS (SELECT *, b * z - c * y AS cx, c * x - a * z AS cy, a * y - b * x AS cz FROM r)
SELECT i, vertex, round(tx + x + 2 * w * cx + 2 * (b * cz - c * cy), 6) AS x, round(ty + y + 2 * w * cy + 2 * (c * cx - a * cz), 6) AS y, round(tz + z + 2 * w * cz + 2 * (a * cy - b * cx), 6) AS z FROM r1""")
def frustum_vertices(s, d):
    return rounded(scenes.frustum_vertices(cameras(s, d), 2.0))


@query("SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM points GROUP BY floor(x / 2), floor(y / 2), floor(z / 2)")
def voxel_downsample(s, d):
    return rounded(scenes.voxel_downsample(view(s, d, "points"), 2.0))


@query("WITH n AS (SELECT x, y, z, sqrt(x**2 + y**2 + z**2) AS n FROM points) SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM n, (SELECT quantile_cont(n, 0.75) AS c FROM n) WHERE n < c")
def robust_center(s, d):
    return rounded(scenes.robust_center(view(s, d, "points")))


@query("SELECT id FROM points p WHERE EXISTS (SELECT 1 FROM cam c WHERE (p.x - c.tx)**2 + (p.y - c.ty)**2 + (p.z - c.tz)**2 < 36)")
def near_camera_points(s, d):
    return scenes.near_camera_points(view(s, d, "points"), cameras(s, d), 6.0).select("id")


KNN = """WITH x AS (SELECT * FROM points WHERE id % 5 = 0), p AS (SELECT a.id, b.id AS other, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM x a JOIN x b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM p)"""


@query("""WITH p AS (SELECT a.id, b.id AS other, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM points a JOIN points b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM p) SELECT id, rank, round(d, 6) AS d FROM r WHERE rank <= 3""")
def knn_points(s, d):
    p = view(s, d, "points")
    return rounded(scenes.knn_points(p, p, 3, 0.5).select("id", F.col("rank").cast("long").alias("rank"), "d"))


@query("""SELECT a.id, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 6) AS d FROM points a, points b WHERE a.scene_id < 4 AND b.scene_id >= 4 GROUP BY a.id""")
def cloud_nn_distance(s, d):
    p = view(s, d, "points")
    return rounded(scenes.cloud_nn_distance(p.where("scene_id < 4"), p.where("scene_id >= 4"), 0.5))


# -- clusters -------------------------------------------------------------------------
@query("SELECT i, ntile(7) OVER (ORDER BY i) - 1 AS bin FROM images")
def cluster_even_bins(s, d):
    return scenes.cluster_even_bins(view(s, d, "images"), 7).select("i", F.col("bin").cast("long"))


def paths(s, d) -> DataFrame:
    return view(s, d, "images").select("i", F.array(F.col("i") % 2, F.col("i") % 4, F.col("i") % 8).cast("array<int>").alias("path"))


PATHS = "p AS (SELECT i, [i % 2, i % 4, i % 8] AS path FROM images)"


@query(f"WITH {PATHS} SELECT array_to_string(path[1:k], '/') AS node, i FROM p, (SELECT unnest([0, 1, 2, 3]) AS k)")
def cluster_keys(s, d):
    return scenes.cluster_keys(paths(s, d)).select(F.array_join("node", "/").alias("node"), "i")


@query(f"""WITH {PATHS}, x AS (SELECT array_to_string(path[1:k], '/') AS node, k, i FROM p, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT node, k AS depth, CASE WHEN k = 3 THEN count(*) ELSE 0 END AS own_keys, count(*) AS subtree_keys FROM x GROUP BY node, k""")
def cluster_records(s, d):
    r = scenes.cluster_records(paths(s, d))
    return r.select(F.array_join("node", "/").alias("node"), "depth", "own_keys", "subtree_keys")


@query(f"WITH {PATHS} SELECT array_to_string(path[1:k], '/') AS node, CAST(sum(i) AS BIGINT) AS n FROM p, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1")
def tree_track_total(s, d):
    t = scenes.tree_track_total(paths(s, d).withColumn("n", F.col("i")))
    return t.select(F.array_join("node", "/").alias("node"), "n")


@query(f"""WITH {PATHS} SELECT e.i, e.j, CASE WHEN a.path[1] <> b.path[1] THEN '' WHEN a.path[2] <> b.path[2] THEN array_to_string(a.path[1:1], '/')
 WHEN a.path[3] <> b.path[3] THEN array_to_string(a.path[1:2], '/') ELSE array_to_string(a.path, '/') END AS owner FROM edges e JOIN p a ON e.i = a.i JOIN p b ON e.j = b.i""")
def cluster_owner(s, d):
    return scenes.edge_owner(view(s, d, "edges"), paths(s, d)).select("i", "j", F.array_join("owner", "/").alias("owner"))


@query(f"WITH {PATHS} SELECT DISTINCT array_to_string(path[1:k], '/') AS node FROM p, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE i % 16 < 5")
def cluster_prune(s, d):
    p = paths(s, d)
    nodes = p.select(F.explode(scenes.prefixes("path")).alias("path")).distinct()
    return scenes.cluster_prune(nodes, p.where("i % 16 < 5")).select(F.array_join("path", "/").alias("node"))


@query("""WITH RECURSIVE k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS lo, count(*) OVER () AS n FROM (SELECT DISTINCT i FROM images)),
d AS (SELECT greatest(0, ceil(log2(max(n) / 4.0)))::BIGINT AS depth FROM k),
r AS (SELECT i, lo, n, '' AS path, 0 AS level FROM k UNION ALL
 SELECT i, CASE WHEN n > 1 AND lo >= greatest(1, n // 2) THEN lo - greatest(1, n // 2) ELSE lo END, CASE WHEN n > 1 AND lo >= greatest(1, n // 2) THEN n - greatest(1, n // 2) ELSE least(n, greatest(1, n // 2)) END,
  path || CASE WHEN n > 1 AND lo >= greatest(1, n // 2) THEN '1' ELSE '0' END, level + 1 FROM r, d WHERE level < depth)
SELECT i, path FROM r, d WHERE level = depth""")
def cluster_binary(s, d):
    c = scenes.cluster_binary(view(s, d, "images"), 4)
    return c.select("i", F.array_join("path", "").alias("path"))


@query(f"""WITH {PATHS}, n AS (SELECT DISTINCT array_to_string(path, '/') AS node FROM p)
SELECT node, ('0x' || substr(md5(node), 1, 2))::INT AS r, ('0x' || substr(md5(node), 3, 2))::INT AS g, ('0x' || substr(md5(node), 5, 2))::INT AS b FROM n""")
def color_by_cluster(s, d):
    return scenes.color_by_cluster(paths(s, d)).select(F.array_join("path", "/").alias("node"), "r", "g", "b")


# -- metrics ---------------------------------------------------------------------------
@query("""SELECT run, grp, metric, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean,
 round(stddev_pop(value), 6) AS stddev, count(*) AS len, count(*) - count(value) AS invalid FROM metrics GROUP BY ALL""")
def metric_summary(s, d):
    return rounded(metrics.metric_summary(view(s, d, "metrics")))


@query("""SELECT run, grp, metric, round(min(value), 6) AS q0, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2,
 round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS q4 FROM metrics GROUP BY ALL""")
def metric_quartiles(s, d):
    return rounded(metrics.metric_quartiles(view(s, d, "metrics")))


@query("""WITH x AS (SELECT run, grp, metric, min(value) AS lo, max(value) AS hi FROM metrics GROUP BY ALL)
SELECT m.run, m.grp, m.metric, CAST(least(9, floor((value - lo) / (hi - lo) * 10)) AS INT) AS bin, count(*) AS n FROM metrics m JOIN x USING (run, grp, metric) GROUP BY ALL""")
def metric_histogram(s, d):
    return metrics.metric_histogram(view(s, d, "metrics"))


@query("""WITH e AS (SELECT run, value / 10 AS e, row_number() OVER w / count(*) OVER (PARTITION BY run)::DOUBLE AS r FROM metrics WINDOW w AS (PARTITION BY run ORDER BY value, id)),
l AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY run ORDER BY r) AS e0, lag(r, 1, 0) OVER (PARTITION BY run ORDER BY r) AS r0 FROM e),
a AS (SELECT run, t, sum((e - e0) * (r + r0) / 2) FILTER (e < t) AS area, max(e) FILTER (e < t) AS last, max(r) FILTER (e < t) AS r FROM l, (SELECT unnest([1.0::DOUBLE, 2.5, 5.0, 10.0, 20.0]) AS t) GROUP BY run, t)
SELECT run, t AS threshold, round((coalesce(area, 0) + (t - coalesce(last, 0)) * coalesce(r, 0)) / t, 6) AS auc FROM a""")
def pose_auc(s, d):
    m = view(s, d, "metrics").select("run", "id", (F.col("value") / 10).alias("err"))
    return rounded(metrics.pose_auc(m, [1.0, 2.5, 5.0, 10.0, 20.0], ["run"]))


@query("""SELECT a.i, round(degrees(abs(0.02 * (a.i % 5 - 2))), 4) AS rotation_err, round(0.02 * (a.i % 3), 6) AS position_err FROM cam a""")
def rotation_angle_err(s, d):
    return metrics.pose_errors(cameras(s, d), cameras(s, d, 0.02)).select("i", F.round("rotation_err", 4).alias("rotation_err"), F.round("position_err", 6).alias("position_err"))


@query("""WITH k AS (SELECT c.i, 0.02 * (c.i % 5 - 2) AS e, c.tx, c.ty, c.tz, d.tx AS sx, d.ty AS sy, d.tz AS sz, c.i % 7 > 0 AS known FROM cam c JOIN cam2 d ON c.i = d.i),
p AS (SELECT a.i, b.i AS j, a.known AND b.known AS known, a.e - b.e AS e, CAST(b.e AS DOUBLE) AS h, a.tx - b.tx AS x, a.ty - b.ty AS y, a.tz - b.tz AS z, a.sx - b.sx AS u, a.sy - b.sy AS v, a.sz - b.sz AS w FROM k a JOIN k b ON a.i < b.i),
s AS (SELECT *, (u + 2 * v + 2 * w) / 9 * (1 - cos(h)) AS m FROM p),
r AS (SELECT i, j, known, e, x, y, z, u * cos(h) - (2 * w - 2 * v) / 3 * sin(h) + m AS u, v * cos(h) - (2 * u - w) / 3 * sin(h) + 2 * m AS v, w * cos(h) - (v - 2 * u) / 3 * sin(h) + 2 * m AS w FROM s),
n AS (SELECT *, sqrt(x * x + y * y + z * z) * sqrt(u * u + v * v + w * w) AS n FROM r)
SELECT i, j, CASE WHEN known THEN round(degrees(abs(e)), 4) END AS rotation_err,
 CASE WHEN known AND n > 0 THEN round(degrees(acos(greatest(-1, least(1, (x * u + y * v + z * w) / n)))), 4) END AS direction_err FROM n""")
def relative_pose_errs(s, d):
    """All pairs of cameras. They turn about one axis, so that angles add up in SQL: an estimated direction is turned by its second camera's error."""
    e = metrics.relative_pose_errs_all(cameras(s, d), cameras(s, d, 0.02).where("i % 7 > 0"))
    # Rounded half up as in SQL, without a decimal for each of so many rows.
    near = lambda c: F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c)
    return e.select("i", "j", near("rotation_err"), near("direction_err"))


@query("""SELECT i, round(0.2, 6) AS f_err, round(20.0 / f, 6) AS f_pct, 0.0::DOUBLE AS cx_err FROM cam""")
def intrinsics_err(s, d):
    return rounded(metrics.intrinsics_err(cameras(s, d), cameras(s, d, 0.02)).select("i", "f_err", "f_pct", "cx_err"))


VG = """v AS (SELECT r.*, EXISTS (SELECT 1 FROM edges e WHERE e.i = r.i AND e.j = r.j) AS kept FROM reports r),
k AS (SELECT 'rotation' AS kind, rotation_err AS err, kept FROM v UNION ALL SELECT 'direction', direction_err, kept FROM v),
c AS (SELECT kind, count(*) FILTER (err <= 6 AND kept) AS tp, count(*) FILTER (err > 6 AND kept) AS fp, count(*) FILTER (err <= 6 AND NOT kept) AS fn FROM k WHERE err IS NOT NULL GROUP BY kind)"""


@query(f"WITH {VG} SELECT kind, tp, fp, fn, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall FROM c")
def view_graph_metrics(s, d):
    return rounded(metrics.view_graph_metrics(view(s, d, "reports"), view(s, d, "edges"), 6.0))


@query("""SELECT run, count(*) FILTER (value <= 50 AND id % 3 > 0) AS tp, count(*) FILTER (value > 50 AND id % 3 > 0) AS fp, count(*) FILTER (value <= 50 AND id % 3 = 0) AS fn FROM metrics GROUP BY run""")
def precision_recall(s, d):
    m = view(s, d, "metrics").select("run", F.col("value").alias("err"), (F.col("id") % 3 > 0).alias("kept"))
    return metrics.precision_recall(m, 50.0, ["run"]).select("run", "tp", "fp", "fn")


@query("""WITH m AS (SELECT run, grp, metric, avg(value) AS value FROM metrics GROUP BY ALL) SELECT a.grp, a.metric, round(CASE WHEN a.metric LIKE '%error%' THEN -1 ELSE 1 END * (b.value - a.value) / (a.value + 1e-12) * 100, 6) AS change
FROM m a LEFT JOIN m b ON a.grp = b.grp AND a.metric = b.metric AND b.run = 'view' WHERE a.run = 'click'""")
def pct_change(s, d):
    m = view(s, d, "metrics").groupBy("run", "grp", "metric").agg(F.avg("value").alias("value"))
    return rounded(metrics.pct_change(m.where("run = 'click'"), m.where("run = 'view'"), ["grp", "metric"]).select("grp", "metric", "change"))


@query("SELECT run, round(avg(value) FILTER (metric = 'rotation_error'), 6) AS rotation_error, round(avg(value) FILTER (metric = 'inlier_ratio'), 6) AS inlier_ratio FROM metrics GROUP BY run")
def results_pivot(s, d):
    return rounded(metrics.results_pivot(view(s, d, "metrics"), ["rotation_error", "inlier_ratio"]))


@query("""WITH x AS (SELECT scene_id, i, degrees(abs(0.02 * (i % 5 - 2))) AS r, 0.02 * (i % 3) AS t FROM cam)
SELECT scene_id, bool_and(r <= 2 AND t <= 1 AND i % 9 <> 5) AS same, count(*) AS cameras FROM x GROUP BY scene_id""")
def compare_pose_sets(s, d):
    """One comparison a scene; in one of them cameras are missing."""
    a, b = cameras(s, d), cameras(s, d, 0.02).where("i % 9 <> 5")
    parts = [metrics.compare_pose_sets(a.where(F.col("scene_id") == k), b.where(F.col("scene_id") == k), 2.0, 1.0).withColumn("scene_id", F.lit(k).cast("long")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("cameras > 0").select("scene_id", "same", "cameras")


@query("SELECT o_custkey AS node, count(*) AS children, count(*) FILTER (o_orderstatus = 'F') AS merged, round(avg(o_totalprice), 4) AS mean_overlap FROM orders GROUP BY o_custkey")
def merge_metrics(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return rounded(metrics.merge_metrics(o.select(F.col("o_custkey").alias("node"), (F.col("o_orderstatus") == "F").alias("merged"), F.col("o_totalprice").alias("overlap"))), 4)


@query(f"""WITH RECURSIVE sp AS ({SIM}), sr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS n FROM sp WHERE s >= 0.1), se AS (SELECT i, j FROM sr WHERE n <= 5),
tr AS (SELECT e.i AS a, e.j AS b, f.j AS c FROM se e JOIN se f ON e.j = f.i JOIN se h ON h.i = e.i AND h.j = f.j),
ok AS (SELECT a AS i, b AS j FROM tr UNION SELECT b, c FROM tr UNION SELECT a, c FROM tr), bb AS (SELECT i, j FROM ok UNION SELECT j, i FROM ok),
reach(node, label) AS (SELECT DISTINCT i, i FROM bb UNION SELECT bb.j, r.label FROM reach r JOIN bb ON r.node = bb.i WHERE r.label < bb.j),
cc AS (SELECT node, min(label) AS component FROM reach GROUP BY node)
SELECT node FROM cc WHERE component IN (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""")
def flagship(s, d):
    """Similar pairs, those in a triangle, their largest component."""
    from lensframe.session import materialise

    e = materialise(similarity(s, d).select("i", "j"), "flagship-edges")
    t = graph.triangles(e)
    ok = t.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("c").alias("j")),
                                    F.struct(F.col("a").alias("i"), F.col("c").alias("j")))).alias("e")).select("e.*").distinct()
    return graph.largest_component(materialise(ok, "flagship-ok"))
