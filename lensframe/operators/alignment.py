"""Similarity transforms between pose sets, plain and robust, and principal axes.

A similarity maps p to s (R p + t). Pairs of poses are rows (keys, qa, ta, qb, tb):
the same camera in the target frame a and in the frame b to be moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.metrics import pose_auc
from lensframe.operators.ranking import numbered, percentiles
from lensframe.operators.scenes import cloud_nn_distance
from lensframe.operators.views import estimate_so3
from lensframe.session import materialise

MOST_HYPOTHESES = 200
_TINY = 1e-12


def pose_pairs(target: DataFrame, moved: DataFrame, on: list[str]) -> DataFrame:
    """Poses of both sets that ``on`` identifies."""
    a = target.select(*on, F.col("q").alias("qa"), F.col("t").alias("ta"))
    return a.join(moved.select(*on, F.col("q").alias("qb"), F.col("t").alias("tb")), on)


def _scale_of(num: Column, den: Column) -> Column:
    """The scale, 1 where the poses don't determine it."""
    return F.when((den > _TINY) & (num > _TINY), num / den).otherwise(1.0)


def sim3_from_poses(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, s, q, t: the mean relative rotation, then the scale and the shift by least
    squares. Groups of fewer than two pairs give no row."""
    n = "xyz"
    r = estimate_so3(pairs.select(*keys, F.col("qa").alias("a"), F.col("qb").alias("b")), keys).where("n >= 2")
    c = pairs.groupBy(*keys).agg(*(F.avg(F.col("ta")[x]).alias(f"a{x}") for x in n), *(F.avg(F.col("tb")[x]).alias(f"b{x}") for x in n))
    whole = materialise(r.join(c, keys), "sim3-means")
    ma, mb = (g.vec(*(F.col(f"{k}{x}") for x in n)) for k in "ab")
    p = pairs.join(whole, keys)
    p = g.bound(g.bound(p, "_a", g.sub(F.col("ta"), ma)), "_b", g.rotate(F.col("q"), g.sub(F.col("tb"), mb)))
    s = p.groupBy(*keys).agg(F.sum(g.dot(F.col("_a"), F.col("_b"))).alias("num"), F.sum(g.dot(F.col("_b"), F.col("_b"))).alias("den"))
    out = whole.join(s.select(*keys, _scale_of(F.col("num"), F.col("den")).alias("s")), keys)
    t = g.sub(g.scale(ma, 1 / F.col("s")), g.rotate(F.col("q"), mb))
    return out.select(*keys, "n", "s", g.canonical(F.col("q")).alias("q"), t.alias("t"))


def move_poses(poses: DataFrame, sims: DataFrame, keys: list[str]) -> DataFrame:
    """Poses q, t of every group moved by its similarity; groups without one go."""
    j = poses.join(sims.select(*keys, F.col("s").alias("_s"), F.col("q").alias("_q"), F.col("t").alias("_t")), keys)
    j = g.bound(j, "_p", g.scale(g.add(g.rotate(F.col("_q"), F.col("t")), F.col("_t")), F.col("_s")))
    return g.bound(j, "_r", g.multiply(F.col("_q"), F.col("q"))).withColumns({"q": F.col("_r"), "t": F.col("_p")}).drop("_s", "_q", "_t", "_p", "_r")


def _hypotheses(pairs: DataFrame, keys: list[str], most: int, order: str, seed: int) -> DataFrame:
    """keys, h, s, q, t from two poses each: all pairs of a group's poses if these are at
    most ``most``, else ``most`` drawn by a seeded hash (never a pose with itself)."""
    p = materialise(numbered(pairs, keys, [order], "_at", "_n"), "sim3-poses")
    size = p.groupBy(*keys).agg(F.max("_n").alias("n")).where("n >= 2")
    every = F.expr("n * (n - 1) div 2")
    h = size.withColumn("few", every <= most).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.least(every, F.lit(most)) - 1)))
    # The h-th of all pairs i < j, counted by j; the root may be off by one.
    j = F.floor((1 + F.sqrt(1.0 + 8 * F.col("h"))) / 2)
    j = F.when(j * (j - 1) / 2 > F.col("h"), j - 1).when(j * (j + 1) / 2 <= F.col("h"), j + 1).otherwise(j)
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "h", *keys)
    first = F.pmod(draw(1), F.col("n"))
    h = h.withColumn("j", F.when(F.col("few"), j).otherwise(first)).withColumn("i", F.when(F.col("few"), F.col("h") - F.expr("j * (j - 1) div 2")).otherwise(
        F.pmod(F.col("j") + 1 + F.pmod(draw(2), F.col("n") - 1), F.col("n")))).select(*keys, "h", "i", "j")
    one = lambda k, at: p.select(*keys, F.col("_at").alias(at), *(F.col(c).alias(f"{c}{k}") for c in ("qa", "ta", "qb", "tb")))
    h = h.join(one(1, "i"), [*keys, "i"]).join(one(2, "j"), [*keys, "j"])
    for k in (1, 2):
        h = g.bound(h, f"d{k}", g.multiply(F.col(f"qa{k}"), g.conjugate(F.col(f"qb{k}"))))
    part = lambda k, x: F.col(f"d{k}")[x]
    sign = F.when(sum((part(1, x) * part(2, x) for x in "xyz"), part(1, "w") * part(2, "w")) < 0, -1.0).otherwise(1.0)
    h = g.bound(h, "_q", g.quat(*(part(1, x) + sign * part(2, x) for x in "wxyz")))
    size_ = F.sqrt(sum((F.col("_q")[x] ** 2 for x in "xyz"), F.col("_q")["w"] ** 2))
    h = g.bound(h, "q", g.canonical(g.quat(*(F.col("_q")[x] / size_ for x in "wxyz"))))
    half = lambda k, sub: g.scale((g.sub if sub else g.add)(F.col(f"{k}1"), F.col(f"{k}2")), F.lit(0.5))
    h = g.bound(h, "_b", g.rotate(F.col("q"), half("tb", True)))
    h = g.bound(h, "s", _scale_of(g.dot(half("ta", True), F.col("_b")), g.dot(F.col("_b"), F.col("_b"))))
    return h.select(*keys, "h", "s", "q", g.sub(g.scale(half("ta", False), 1 / F.col("s")), g.rotate(F.col("q"), half("tb", False))).alias("t"))


def _moved(pairs: DataFrame, sims: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair under every similarity of its group: p and r, the moved pose."""
    j = pairs.join(sims, keys)
    return g.bound(g.bound(j, "p", g.scale(g.add(g.rotate(F.col("q"), F.col("tb")), F.col("t")), F.col("s"))), "r", g.multiply(F.col("q"), F.col("qb")))


def pose_angle(q1: Column, t1: Column, q2: Column, t2: Column) -> Column:
    """The larger of the angle between two rotations and that between two positions, in degrees."""
    n = g.norm(t1) * g.norm(t2)
    c = F.when(n > 0, g.dot(t1, t2) / n).otherwise(1.0)
    return F.greatest(g.rotation_angle(q1, q2), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))))


def estimate_sim3_robust(pairs: DataFrame, keys: list[str], order: str = "i", most: int = MOST_HYPOTHESES, seed: int = 0, degrees: float = 5.0) -> DataFrame:
    """keys, h, s, q, t, auc: of the fit to all poses (h = -1) and of two-pose hypotheses
    the one with the largest pose AUC; ties go to the smaller h. ``order`` is a
    column that tells the poses of a group apart."""
    sims = _hypotheses(pairs, keys, most, order, seed)
    sims = materialise(sim3_from_poses(pairs, keys).select(*keys, F.lit(-1).cast("long").alias("h"), "s", "q", "t").unionByName(sims), "sim3-hypotheses")
    m = _moved(pairs, sims, keys)
    err = m.select(*keys, "h", pose_angle(F.col("qa"), F.col("ta"), F.col("r"), F.col("p")).alias("err"))
    auc = pose_auc(err, [degrees], [*keys, "h"]).select(*keys, "h", "auc")
    best = auc.groupBy(*keys).agg(F.max_by(F.struct("h", "auc"), F.struct(F.round("auc", 9), -F.col("h"))).alias("b")).select(*keys, "b.*")
    return best.join(sims, [*keys, "h"]).select(*keys, "h", "s", "q", "t", "auc")


def estimate_sim3_ransac(pairs: DataFrame, keys: list[str], limit: float, order: str = "i", most: int = MOST_HYPOTHESES, seed: int = 0) -> DataFrame:
    """keys, s, q, t, inliers: the two-pose hypothesis with most positions within ``limit``,
    then the least mean error of these, then the smaller h; fitted again to its
    inliers where these are two or more."""
    sims = materialise(_hypotheses(pairs, keys, most, order, seed), "sim3-hypotheses")
    m = _moved(pairs, sims, keys)
    m = g.bound(m, "e", g.norm(g.sub(F.col("ta"), F.col("p"))))
    near = F.when(F.col("e") <= limit, F.col("e"))
    score = m.groupBy(*keys, "h").agg(F.count(near).alias("inliers"), F.avg(near).alias("mean"))
    best = score.groupBy(*keys).agg(F.max_by(F.struct("h", "inliers"), F.struct("inliers", -F.round(F.coalesce("mean", F.lit(0.0)), 9), -F.col("h"))).alias("b")).select(*keys, "b.*")
    best = materialise(best.join(sims, [*keys, "h"]), "sim3-best")
    kept = _moved(pairs, best, keys).where(g.norm(g.sub(F.col("ta"), F.col("p"))) <= limit).select(*pairs.columns)
    again = sim3_from_poses(kept, keys).select(*keys, *(F.col(c).alias(f"_{c}") for c in "sqt"))
    return best.join(again, keys, "left").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in "sqt"), "inliers")


# -- evaluation of whole pose sets -----------------------------------------------
POSE_THRESHOLDS = (1.0, 2.5, 5.0, 10.0, 20.0)


def pose_metrics(reference: DataFrame, estimated: DataFrame, pairs: DataFrame, keys: list[str], constructed_only: bool = False, thresholds: tuple = POSE_THRESHOLDS) -> DataFrame:
    """keys, metric, n, missing, mean, median, worst, value: the distributions of the absolute
    and relative pose errors of two aligned pose sets (keys, i, q, t), and the areas under
    the recall curve of the relative ones (value). A camera that the second set lacks
    is missing; pairs with a missing camera never recall, unless ``constructed_only``
    leaves them out. ``pairs`` are the (keys, i, j) to compare."""
    a = reference.select(*keys, "i", F.col("q").alias("qa"), F.col("t").alias("ta"))
    p = a.join(estimated.select(*keys, "i", F.col("q").alias("qb"), F.col("t").alias("tb")), [*keys, "i"], "left")
    angle = lambda x, y: F.when((g.norm(x) > 0) & (g.norm(y) > 0), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(x, y) / F.nullif(g.norm(x) * g.norm(y), F.lit(0.0)))))))
    absolute = p.select(*keys, F.explode(F.array(
        F.struct(F.lit("rotation_angle_error_deg").alias("metric"), g.rotation_angle(F.col("qa"), F.col("qb")).alias("err")),
        F.struct(F.lit("translation_error_distance").alias("metric"), g.norm(g.sub(F.col("ta"), F.col("tb"))).alias("err")),
        F.struct(F.lit("translation_angle_error_deg").alias("metric"), angle(F.col("ta"), F.col("tb")).alias("err")))).alias("e")).select(*keys, "e.*")
    end = lambda k: p.select(*keys, F.col("i").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("qa", "ta", "qb", "tb")))
    r = pairs.select(*keys, "i", "j").join(end("i"), [*keys, "i"]).join(end("j"), [*keys, "j"])
    for k in "ab":  # where the second camera stands and how it is turned, seen from the first
        r = g.bound(r, f"_u{k}", g.rotate(g.conjugate(F.col(f"q{k}_i")), g.sub(F.col(f"t{k}_j"), F.col(f"t{k}_i"))))
        r = g.bound(r, f"_r{k}", g.multiply(g.conjugate(F.col(f"q{k}_i")), F.col(f"q{k}_j")))
    r = r.select(*keys, g.rotation_angle(F.col("_ra"), F.col("_rb")).alias("rot"), angle(F.col("_ua"), F.col("_ub")).alias("tra"))
    r = materialise(r, "pose-relative")
    relative = r.select(*keys, F.explode(F.array(
        F.struct(F.lit("relative_rotation_angle_error_deg").alias("metric"), F.col("rot").alias("err")),
        F.struct(F.lit("relative_translation_angle_error_deg").alias("metric"), F.col("tra").alias("err")))).alias("e")).select(*keys, "e.*")
    errs = materialise(absolute.unionByName(relative), "pose-errors")
    by = [*keys, "metric"]
    dist = errs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("err").isNull()).alias("missing"), F.avg("err").alias("mean"), F.max("err").alias("worst"))
    dist = dist.join(percentiles(errs, by, F.col("err"), {"median": 0.5}), by, "left").withColumn("value", F.lit(None).cast("double"))
    worst = F.when(F.col("rot").isNotNull() & F.col("tra").isNotNull(), F.greatest("rot", "tra"))
    curve = r.where("rot is not null and tra is not null") if constructed_only else r
    auc = pose_auc(curve.withColumn("err", worst), list(thresholds), keys)
    name = F.concat(F.lit("pose_auc_constructed_only_@" if constructed_only else "pose_auc_@"), F.col("threshold").cast("string"), F.lit("_deg"))
    none = {c: F.lit(None).cast(t) for c, t in (("n", "long"), ("missing", "long"), ("mean", "double"), ("worst", "double"), ("median", "double"))}
    return dist.unionByName(auc.select(*keys, name.alias("metric"), F.col("auc").alias("value")).withColumns(none)).select(*by, "n", "missing", "mean", "median", "worst", "value")


def cluster_run_compare(baseline: DataFrame, current: DataFrame, key: str = "cluster", limit: float = 0.5, most: int = MOST_HYPOTHESES, seed: int = 0) -> DataFrame:
    """Per cluster, the poses of two runs (key, name, q, t) matched by image name, the
    current ones moved onto the baseline by RANSAC: how many are common and in how
    many agree, and median and mean of the rotation (degrees) and position errors."""
    pairs = materialise(pose_pairs(baseline, current, [key, "name"]), "run-pairs")
    sims = materialise(estimate_sim3_ransac(pairs, [key], limit, "name", most, seed), "run-sims")
    m = _moved(pairs, sims, [key])
    e = materialise(m.select(key, g.rotation_angle(F.col("qa"), F.col("r")).alias("rot"), g.norm(g.sub(F.col("ta"), F.col("p"))).alias("pos")), "run-errors")
    size = pairs.groupBy(key).agg(F.count("*").alias("common"))
    means = e.groupBy(key).agg(F.avg("rot").alias("rot_mean"), F.avg("pos").alias("pos_mean"))
    out = size.join(sims.select(key, "s", "inliers"), key, "left").join(means, key, "left")
    for c in ("rot", "pos"):
        out = out.join(percentiles(e, [key], F.col(c), {f"{c}_median": 0.5}), key, "left")
    return out


def external_model_metrics(cameras: DataFrame, points: DataFrame, limit: float) -> DataFrame:
    """metric, value of another pipeline's model (rows of src_cameras and src_points): how many
    cameras and tracks, track lengths and errors, all and those of an error below the limit."""
    p = points.select(F.floor(F.size("track") / 2).alias("length"), "error")
    p = materialise(p.withColumn("few", F.col("error") < limit), "external-points")
    few = lambda c: F.when(F.col("few"), F.col(c))
    a = p.agg(F.count("*").alias("tracks"), F.count_if("few").alias("tracks_filtered"), F.avg("length").alias("mean_length"), F.avg(few("length")).alias("mean_length_filtered"),
              F.avg("error").alias("mean_error"), F.avg(few("error")).alias("mean_error_filtered"))
    a = a.crossJoin(cameras.agg(F.count("*").alias("cameras"))).crossJoin(percentiles(p, [], F.col("length"), {"median_length": 0.5})).crossJoin(percentiles(p, [], F.col("error"), {"median_error": 0.5}))
    return a.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, a.columns)), F.array(*(F.col(c).cast("double") for c in a.columns)))).alias("metric", "value"))


# -- principal axes -----------------------------------------------------------------
def _eigen(c: list[float]) -> list[float]:
    """Row by row the principal axes (widest first), then the variances. The largest component
    of the first two is positive; the
    last one makes the frame right-handed."""
    import numpy as np

    w, v = np.linalg.eigh(np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]))
    w, v = w[::-1], v[:, ::-1].T.copy()
    for k in range(2):
        v[k] *= np.sign(v[k][np.argmax(np.abs(v[k]))])
    v[2] = np.cross(v[0], v[1])
    return [float(x) for x in (*v.ravel(), *np.maximum(w, 0.0))]


def principal_axes(points: DataFrame, keys: list[str], share: float | None = 0.95) -> DataFrame:
    """keys, n, mean, axes (nine numbers, a row per axis), scales (standard deviations along
    them), of the points whose distance from the origin is below the percentile ``share``
    (of all points if it is None). Six covariances per group on the executors, one
    3x3 eigenproblem per group; a group of one point gives no row."""
    n = g.norm(g.vec(*(F.col(c) for c in "xyz")))
    p = points
    if share is not None:
        # Written, so that Spark sees how small it is and never broadcasts the points instead.
        cut = materialise(percentiles(points, keys, n, {"_cut": share}), "axes-cut")
        p = (points.join(cut, keys) if keys else points.crossJoin(cut)).where(n < F.col("_cut")).drop("_cut")
    two = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    c = p.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in "xyz"), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in two)).where("n > 1")
    e = F.udf(_eigen, "array<double>")(F.array(*(F.col(f"c{a}{b}") for a, b in two)))  # one row per group
    c = g.bound(c, "_e", e)
    return c.select(*keys, "n", g.vec(*(F.col(f"m{a}") for a in "xyz")).alias("mean"), F.slice("_e", 1, 9).alias("axes"), F.transform(F.slice("_e", 10, 3), F.sqrt).alias("scales"))


def cloud_scales(points: DataFrame, keys: list[str]) -> DataFrame:
    """Standard deviations of each cloud along its principal axes, widest first."""
    return principal_axes(points, keys, None).select(*keys, "n", "scales")


def axis_align(points: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """Points turned so that the cloud's principal axes are x, y, z and shifted so that the
    mean of the points below the distance percentile is the origin."""
    a = principal_axes(points, keys, share).select(*keys, F.col("mean").alias("_m"), F.col("axes").alias("_a"))
    a = materialise(a, "axes")  # a row per group, smaller than the points by Spark's own figures
    j = points.join(a, keys) if keys else points.crossJoin(a)
    d = [F.col(c) - F.col("_m")[c] for c in "xyz"]
    turned = {c: F.col("_a")[3 * k] * d[0] + F.col("_a")[3 * k + 1] * d[1] + F.col("_a")[3 * k + 2] * d[2] for k, c in enumerate("xyz")}
    return j.withColumns(turned).drop("_m", "_a")


def downsample_psnr(before: DataFrame, after: DataFrame, size: float) -> DataFrame:
    """Points before and after, compression ratio, and the peak signal-to-noise ratio: twice the
    norm of the first cloud's scales over the larger root mean square of the nearest
    distances from either cloud to the other, in decibels (null if both are equal)."""
    rms = lambda a, b: cloud_nn_distance(a, b, size).agg(F.sqrt(F.avg(F.col("d") ** 2)).alias("rms"))
    worst = rms(before, after).unionByName(rms(after, before)).agg(F.max("rms").alias("rms"))
    n = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after"))).crossJoin(worst)
    peak = 2 * F.sqrt(F.aggregate("scales", F.lit(0.0), lambda a, x: a + x * x))
    out = n.crossJoin(cloud_scales(before, []).select(peak.alias("peak")))
    return out.select("n_before", "n_after", (F.col("n_after") / F.nullif("n_before", F.lit(0).cast("long"))).alias("ratio"), "rms",
                      F.when(F.col("rms") > 0, 20 * F.log10(F.col("peak") / F.nullif("rms", F.lit(0.0)))).alias("psnr"))
