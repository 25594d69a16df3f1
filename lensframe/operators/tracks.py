"""Tracks: building, selecting, triangulating and cleaning them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.graph import connected_components
from lensframe.operators.ranking import numbered
from lensframe.session import materialise, task_count

#: Measurements that a task of the robust triangulation takes, with all pairs of each track.
TASK_RAYS = 200_000


def tracks_union_find(matches: DataFrame) -> DataFrame:
    """(i1, i2, k1, k2) matches -> (track_id, i, k): components of keypoints.
    A keypoint's node is image * 2^32 + keypoint, so ids are the smallest one."""
    node = lambda i, k: (F.col(i).cast("long") * (1 << 32) + F.col(k)).alias("n")
    e = matches.select(node("i1", "k1").alias("i"), node("i2", "k2").alias("j"))
    cc = connected_components(e)
    return cc.select(F.col("component").alias("track_id"), F.floor(F.col("node") / (1 << 32)).cast("long").alias("i"), (F.col("node") % (1 << 32)).alias("k"))


def tracks_unique_cameras(observations: DataFrame) -> DataFrame:
    """Tracks without two measurements in one camera."""
    bad = observations.groupBy("track_id").agg(F.count("*").alias("n"), F.countDistinct("i").alias("c")).where("n <> c").select("track_id")
    return observations.join(bad, "track_id", "left_anti")


def track_min_length(observations: DataFrame, least: int) -> DataFrame:
    ok = observations.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return observations.join(ok.select("track_id"), "track_id", "left_semi")


def rays(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Centre and unit world ray of every measurement (pinhole parameters)."""
    o = observations.join(cameras.select("i", "q", "t", "params"), "i")
    return g.bound(g.bound(o, "_r", g.pixel_ray(F.col("params"), F.col("u"), F.col("v"))), "d", g.rotate(F.col("q"), F.col("_r"))).drop("_r")


def track_triangulate(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Linear point of each track: the sum of (I - d d^T) times X equals the sum
    of (I - d d^T) c, nine sums per track and a closed 3x3 solution. Status:
    SUCCESS, FEW (below two rays) or DEGENERATE (rays near parallel: a determinant det of at most 1e-9)."""
    # Dealt by track before the sums, so that each ray is worked out once.
    r = rays(observations, cameras).select("track_id", "d", "t").repartition("track_id")
    d, c = F.col("d"), F.col("t")
    names = ("x", "y", "z")
    m = {f"m{a}{b}": F.sum((1.0 if a == b else 0.0) - d[names[a]] * d[names[b]]) for a in range(3) for b in range(a, 3)}
    along = g.dot(d, c)
    v = {f"v{a}": F.sum(c[names[a]] - d[names[a]] * along) for a in range(3)}
    s = r.groupBy("track_id").agg(F.count("*").alias("n"), *(x.alias(k) for k, x in {**m, **v}.items()))
    M = lambda a, b: F.col(f"m{min(a, b)}{max(a, b)}")
    cof = lambda a, b: (M((a + 1) % 3, (b + 1) % 3) * M((a + 2) % 3, (b + 2) % 3) - M((a + 1) % 3, (b + 2) % 3) * M((a + 2) % 3, (b + 1) % 3))
    det = M(0, 0) * cof(0, 0) + M(0, 1) * cof(0, 1) + M(0, 2) * cof(0, 2)
    s = s.withColumn("det", det)
    ok = (F.col("n") >= 2) & (F.col("det") > 1e-9)
    xyz = {names[a]: F.when(ok, sum((cof(b, a) * F.col(f"v{b}") for b in range(1, 3)), cof(0, a) * F.col("v0")) / F.col("det")) for a in range(3)}
    return s.select("track_id", "n", "det", *(x.alias(k) for k, x in xyz.items()),
                    F.when(F.col("n") < 2, "FEW").when(F.col("det") <= 1e-9, "DEGENERATE").otherwise("SUCCESS").alias("status"))


def reprojection_error(observations: DataFrame, cameras: DataFrame, points: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Pixel error of every measurement; null where the camera or point is
    missing or the point is behind the camera. ``scope`` names columns of all three
    tables within which cameras and tracks are known by their ids."""
    # Points first: what is shuffled by track is then narrow, and the cameras, often few, come last.
    o = observations.join(points.select(*scope, "track_id", "x", "y", "z"), [*scope, "track_id"], "left").join(
        cameras.select(*scope, "i", "q", "t", "model", "params"), [*scope, "i"], "left")
    p = g.to_camera(F.col("q"), F.col("t"), g.vec(F.col("x"), F.col("y"), F.col("z")))
    o = g.bound(g.bound(o, "_p", p), "_uv", g.project(F.col("model"), F.col("params"), F.col("_p")))
    err = F.sqrt((F.col("_uv.u") - F.col("u")) ** 2 + (F.col("_uv.v") - F.col("v")) ** 2)
    return o.select(*scope, "track_id", "i", "u", "v", F.col("_p.z").alias("depth"), F.col("_uv.u").alias("pu"), F.col("_uv.v").alias("pv"), err.alias("err"))


def track_triangulate_robust(observations: DataFrame, cameras: DataFrame, limit: float, most: int = 2749, seed: int = 0) -> DataFrame:
    """Best two-ray hypothesis per track: most inliers below ``limit`` pixels,
    then least mean error, then the smaller pair of cameras. Hypotheses are all pairs
    of a track's rays where these are at most ``most``, else ``most`` pairs drawn by a
    seeded hash; those are chosen by ray number before any join, so a long track costs
    its length times ``most``. Parallel rays make no hypothesis."""
    sizes = observations.join(cameras.select("i"), "i").groupBy("track_id").agg(F.count("*").alias("_n"))
    long = materialise(sizes.where(F.expr("_n * (_n - 1) div 2") > most).select("track_id"), "track-long")
    # All pairs of the short tracks by one join on the track, for which everything is dealt once.
    every = long.isEmpty()
    tasks = task_count(observations.sparkSession, observations.count(), TASK_RAYS)
    short = observations if every else observations.join(long, "track_id", "left_anti")
    r = rays(short, cameras).select("track_id", "i", "d", "t").repartition(tasks, "track_id")
    ray = lambda n: r.select("track_id", F.struct("i", "t", "d").alias(f"o{n}"), F.col("i").alias(f"i{n}"), F.col("d").alias(f"d{n}"), F.col("t").alias(f"c{n}")).hint("merge")
    p = _hypotheses(ray(1).join(ray(2), "track_id").where("o1 < o2"))
    best = _best_hypotheses(short, cameras, p, limit, tasks)
    if every:
        return best
    hot = observations.join(long, "track_id", "left_semi")
    return best.unionByName(_best_hypotheses(hot, cameras, _hypotheses(_drawn_pairs(rays(hot, cameras), most, seed)), limit, tasks))


def _drawn_pairs(ray: DataFrame, most: int, seed: int) -> DataFrame:
    """``most`` pairs of rays of each track."""
    r = materialise(numbered(ray.select("track_id", "i", "d", "t"), ["track_id"], ["i", "t.x", "d.x", "d.y"], "_at", "_n"), "track-rays")
    p = r.where("_at = 0").select("track_id", F.col("_n").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long") - 1)).alias("h"))
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "track_id", "h")
    p = g.bound(g.bound(p, "j", F.pmod(draw(1), F.col("n"))), "k", F.pmod(F.col("j") + 1 + F.pmod(draw(2), F.col("n") - 1), F.col("n")))
    at = lambda at, n: r.select("track_id", F.col("_at").alias(at), F.col("i").alias(f"i{n}"), F.col("d").alias(f"d{n}"), F.col("t").alias(f"c{n}"))
    return p.select("track_id", F.least("j", "k").alias("j"), F.greatest("j", "k").alias("k")).join(at("j", 1), ["track_id", "j"]).join(at("k", 2), ["track_id", "k"])


def _hypotheses(p: DataFrame) -> DataFrame:
    """track_id, i1, i2, X: the point halfway between two rays that are not parallel."""
    b = g.dot(F.col("d1"), F.col("d2"))
    diff = g.sub(F.col("c2"), F.col("c1"))
    p = g.bound(p, "_s", F.struct(b.alias("b"), g.dot(diff, F.col("d1")).alias("e"), g.dot(diff, F.col("d2")).alias("f"))).where("1 - _s.b * _s.b > 1e-12")
    b, e, f = (F.col(f"_s.{c}") for c in "bef")
    x = g.scale(g.add(g.add(F.col("c1"), g.scale(F.col("d1"), (e - b * f) / (1 - b * b))), g.add(F.col("c2"), g.scale(F.col("d2"), (b * e - f) / (1 - b * b)))), F.lit(0.5))
    return g.bound(p, "X", x).select("track_id", "i1", "i2", "X")


def _best_hypotheses(observations: DataFrame, cameras: DataFrame, h: DataFrame, limit: float, tasks: int) -> DataFrame:
    # Dealt by track for itself: Spark would else send the hypotheses to the measurements as a whole where it thinks them few.
    o = observations.join(cameras.select("i", "q", "t", "model", "params"), "i").repartition(tasks, "track_id").hint("merge").join(h, "track_id")
    o = g.bound(g.bound(o, "_p", g.to_camera(F.col("q"), F.col("t"), F.col("X"))), "_uv", g.project(F.col("model"), F.col("params"), F.col("_p")))
    err = F.sqrt((F.col("_uv.u") - F.col("u")) ** 2 + (F.col("_uv.v") - F.col("v")) ** 2)
    near = F.when(err < limit, err)
    s = o.groupBy("track_id", "i1", "i2", "X").agg(F.count(near).alias("inliers"), F.avg(near).alias("mean_err"))
    order = F.struct("inliers", -F.coalesce(F.round("mean_err", 9), F.lit(float("inf"))), -F.col("i1"), -F.col("i2"))
    best = s.groupBy("track_id").agg(F.max_by(F.struct("i1", "i2", "X", "inliers", "mean_err"), order).alias("b")).select("track_id", "b.*")
    return best.select("track_id", "i1", "i2", *(F.col("X")[c].alias(c) for c in "xyz"), "inliers", "mean_err")


def track_max_angle(observations: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """Widest angle between the rays from a track's cameras to its point."""
    o = observations.select("track_id", "i").distinct().join(cameras.select("i", "t"), "i").join(points.select("track_id", "x", "y", "z"), "track_id")
    o = o.select("track_id", "i", g.unit(g.sub(g.vec(F.col("x"), F.col("y"), F.col("z")), F.col("t"))).alias("d"))
    p = o.alias("a").join(o.alias("b"), "track_id").where("a.i < b.i")
    return p.groupBy("track_id").agg(F.max(g.direction_angle(F.col("a.d"), F.col("b.d"))).alias("angle"))


def classify_tracks(observations: DataFrame, reference: DataFrame, estimated: DataFrame) -> DataFrame:
    a = track_triangulate(observations, reference).select("track_id", F.col("status").alias("gt_code"))
    return a.join(track_triangulate(observations, estimated).select("track_id", F.col("status").alias("code")), "track_id", "full")


def merge_duplicate_tracks(observations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Tracks that share (camera, pixel cell) become one, named by the smallest
    id; of several measurements in a camera the first (by old track, u, v) stays.
    Component form: a track that touches two others joins all three. ``scope`` names
    columns within which tracks may meet; a track's id stands in one of them only."""
    cell = [*scope, "i", "cu", "cv"]
    keyed = observations.withColumns({"cu": F.floor("u").cast("long"), "cv": F.floor("v").cast("long")})
    hub = keyed.groupBy(*cell).agg(F.min("track_id").alias("j"))
    e = keyed.join(hub, cell).where("track_id <> j").select(F.col("track_id").alias("a"), F.col("j").alias("b")).distinct()
    cc = materialise(connected_components(e, "a", "b"), "merge-tracks")
    o = observations.join(cc.withColumnRenamed("node", "track_id"), "track_id", "left").withColumn("merged", F.coalesce("component", "track_id"))
    w = Window.partitionBy("merged", "i").orderBy("track_id", "u", "v")
    return o.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*scope, F.col("merged").alias("track_id"), "i", "u", "v")


def factor_weight_filter(observations: DataFrame, weights: DataFrame, least_weight: float, least_length: int) -> DataFrame:
    low = weights.where(F.col("weight") < least_weight).select("track_id", "i").distinct()
    return track_min_length(observations.join(low, ["track_id", "i"], "left_anti"), least_length)


def gaussian_to_points(splats: DataFrame) -> DataFrame:
    """Means as coloured points; colour from the constant harmonic."""
    c0 = 0.28209479177387814  # 1 / (2 sqrt(pi))
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + c0 * F.col(c))) * 255).cast("int")
    return splats.select("id", "x", "y", "z", byte("f_r").alias("r"), byte("f_g").alias("g"), byte("f_b").alias("b"))


def keypoint_dedup(keypoints: DataFrame, radius: float = 3.0) -> DataFrame:
    """Per image, in (i1, i2, k) order: a keypoint within ``radius`` of one kept
    from an earlier batch takes its index, else it gets a new one; keypoints of
    one batch are not merged with each other. Images are independent groups of a
    size that the detector bounds."""
    import numpy as np
    import pyarrow as pa

    def one(key, t):
        p = t.to_pandas().sort_values(["i1", "i2", "k"], kind="stable")
        xy, batch = p[["u", "v"]].to_numpy(), list(zip(p["i1"], p["i2"]))
        index, kept, pending, last = np.empty(len(p), np.int64), np.zeros((0, 2)), [], None
        count = 0
        for n, (b, q) in enumerate(zip(batch, xy)):
            if b != last:
                kept, pending, last = np.concatenate([kept, np.array(pending).reshape(-1, 2)]), [], b
            d = np.hypot(*(kept - q).T) if len(kept) else np.zeros(0)
            at = int(d.argmin()) if len(d) else -1
            if at >= 0 and d[at] <= radius:
                index[n] = at
            else:
                index[n], count = count, count + 1
                pending.append(q)
        return pa.table({"i": [key[0].as_py()] * len(p), "i1": p["i1"].to_numpy(), "i2": p["i2"].to_numpy(), "k": p["k"].to_numpy(), "index": index})

    return keypoints.select("i", "i1", "i2", "k", "u", "v").groupBy("i").applyInArrow(one, "i long, i1 long, i2 long, k long, index long")
