"""Views and frames: which views see a point or each other, how runs' cameras differ."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensframe.functions import geometry as g


def in_frame(projected: DataFrame, width: float, height: float) -> DataFrame:
    """Measurements whose projection (pu, pv, depth) lies in front and in the image."""
    return projected.where((F.col("depth") > 0) & F.col("pu").between(0, width) & F.col("pv").between(0, height))


def source_view_topk(observations: DataFrame, cameras: DataFrame, points: DataFrame, views: int, center: float = 5.0) -> DataFrame:
    """(i, j, score, rank): per reference view its views - 1 best source views, by the
    sum of the angle scores of the points both see. Tracks see a camera once, which
    bounds a track's pairs."""
    o = observations.select("track_id", "i").distinct().join(cameras.select("i", "t"), "i").join(points.select("track_id", "x", "y", "z"), "track_id")
    o = g.bound(o, "d", g.unit(g.sub(g.vec(F.col("x"), F.col("y"), F.col("z")), F.col("t")))).select("track_id", "i", "d")
    p = o.join(o.select("track_id", F.col("i").alias("j"), F.col("d").alias("e")), "track_id").where("i < j")
    s = p.groupBy("i", "j").agg(F.sum(g.piecewise_gaussian(g.direction_angle(F.col("d"), F.col("e")), center)).alias("score"))
    both = s.unionByName(s.select(F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    w = Window.partitionBy("i").orderBy(F.desc(F.round("score", 9)), "j")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") < views)


def frame_rank(scores: DataFrame, key: str) -> DataFrame:
    """Frames of each ``key`` by the sum of their similarities, most typical first."""
    both = scores.select(key, "i", "score").unionByName(scores.select(key, F.col("j").alias("i"), "score"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("total", 9)), "i")
    return both.groupBy(key, "i").agg(F.sum("score").alias("total")).withColumn("rank", F.row_number().over(w))


def intrinsics_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cameras of one name in two runs, the second scaled to the first's image size:
    relative differences of fx, fy, cx, cy and the field of view's in degrees."""
    a = baseline.select("name", F.col("params").alias("a"), F.col("width").alias("w"), F.col("height").alias("h"))
    j = a.join(current.select("name", F.col("params").alias("b"), F.col("width").alias("bw"), F.col("height").alias("bh")), "name")
    size = [F.col("w") / F.col("bw"), F.col("h") / F.col("bh")]
    out = {n: F.abs(F.col("b")[k] * size[k % 2] - F.col("a")[k]) / F.abs(F.col("a")[k]) for k, n in enumerate(("d_fx", "d_fy", "d_cx", "d_cy"))}
    view = lambda f: F.degrees(2 * F.atan(F.col("w") / (2 * f)))
    fov = F.abs(view(F.col("b")[0] * size[0]) - view(F.col("a")[0]))
    return j.select("name", *(c.alias(n) for n, c in out.items()), fov.alias("d_fov"))


def _mean_rotation(m):
    v = np.linalg.eigh(np.array(m).reshape(4, 4))[1][:, -1]
    return [float(x) for x in (v if v[0] >= 0 else -v)]


def estimate_so3(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b rotations) -> the rotation q that is closest to all a b^-1: ten
    sums per group, the leading eigenvector of one 4x4 matrix per group."""
    d = g.bound(pairs, "_d", g.multiply(F.col("a"), g.conjugate(F.col("b"))))
    n = "wxyz"
    sums = {f"s{x}{y}": F.sum(F.col("_d")[x] * F.col("_d")[y]) for k, x in enumerate(n) for y in n[k:]}
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in sums.items()))
    full = F.array(*(F.col(f"s{min(x, y, key=n.index)}{max(x, y, key=n.index)}") for x in n for y in n))
    q = F.udf(_mean_rotation, "array<double>")(full)  # one row per group
    return s.select(*keys, "n", q.alias("_q")).select(*keys, "n", g.quat(*(F.col("_q")[k] for k in range(4))).alias("q"))


def direction_avg_metrics(errors: DataFrame, limit: float) -> DataFrame:
    """Of inlier and of outlier edges: how many, mean and worst direction error, and
    how many are within the limit."""
    e = errors.where("direction_err is not null")
    return e.groupBy("kept").agg(F.count("*").alias("n"), F.avg("direction_err").alias("mean_err"), F.max("direction_err").alias("worst"), F.count_if(F.col("direction_err") <= limit).alias("within"))


def reorder_scene(rows: DataFrame, keys: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Local image index ``i`` of each scene replaced by the scene's i-th global key
    in ascending order; rows without such a key are dropped."""
    w = Window.partitionBy(scene).orderBy("key")
    k = keys.select(scene, "key").distinct().withColumn("i", F.row_number().over(w).cast("long") - 1)
    return rows.join(k, [scene, "i"]).drop("i").withColumnRenamed("key", "i")


def cluster_single(images: DataFrame) -> DataFrame:
    """Everything in the root."""
    return images.select("i", F.array().cast("array<int>").alias("path")).distinct()


def cluster_audit(clusters: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Per leaf path: its keys, whether they exceed ``most``, and the edges inside it;
    an edge has both ends in one leaf at most, as a key has one path."""
    size = clusters.groupBy("path").agg(F.countDistinct("i").alias("keys"))
    c = clusters.select("i", "path")
    e = edges.join(c, "i").join(c.select(F.col("i").alias("j"), F.col("path").alias("other")), "j").where("path = other")
    return size.join(e.groupBy("path").agg(F.count("*").alias("edges")), "path", "left").select(
        "path", "keys", (F.col("keys") > most).alias("too_large"), F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))
