"""Evaluation: distributions, pose errors, run comparison."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.pairs import BLOCK_ROWS, block_cells
from lensframe.operators.ranking import percentiles

KEYS = ("run", "grp", "metric")


def metric_summary(metrics: DataFrame) -> DataFrame:
    """NaN counts as missing; the deviation is the population's."""
    v = F.when(~F.isnan("value"), F.col("value"))
    all_ = metrics.groupBy(*KEYS).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("stddev"), F.count("*").alias("len"), (F.count("*") - F.count(v)).alias("invalid"))
    return all_.join(percentiles(metrics, list(KEYS), v, {"median": 0.5}), list(KEYS), "left")


def metric_quartiles(metrics: DataFrame) -> DataFrame:
    return percentiles(metrics, list(KEYS), F.col("value"), {f"q{i}": i / 4 for i in range(5)})


def metric_histogram(metrics: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins between the least and greatest value, the last one closed."""
    span = metrics.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return metrics.join(span, list(KEYS)).groupBy(*KEYS, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def integer_histogram(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(*KEYS, F.col("value").cast("long").alias("value")).agg(F.count("*").alias("n"))


def pose_auc(errors: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """Area under the recall / error curve up to each threshold, as a share of
    it; null errors never recall. The trapezoids between the m errors below the
    threshold t and the flat rest add up to (m t - their sum + half the last one) / n."""
    e = errors.withColumn("e", F.when(~F.isnan("err"), F.col("err")))
    t = e.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    below = F.when(F.col("e") < F.col("t"), F.col("e"))
    a = t.groupBy(*keys, "t").agg(F.count("*").alias("n"), F.count(below).alias("m"), F.sum(below).alias("s"), F.max(below).alias("last"))
    area = F.col("m") * F.col("t") - F.coalesce("s", F.lit(0.0)) + F.coalesce("last", F.lit(0.0)) / 2
    return a.select(*keys, F.col("t").alias("threshold"), (area / F.col("n") / F.col("t")).alias("auc"))


def pose_errors(reference: DataFrame, estimated: DataFrame) -> DataFrame:
    """Per camera: rotation angle and distance between two pose sets."""
    r = reference.select("i", F.col("q").alias("q1"), F.col("t").alias("t1")).join(estimated.select("i", F.col("q").alias("q2"), F.col("t").alias("t2")), "i", "left")
    return r.select("i", g.rotation_angle(F.col("q1"), F.col("q2")).alias("rotation_err"), g.norm(g.sub(F.col("t1"), F.col("t2"))).alias("position_err"))


def _cosine_angle(dot: Column, n: Column) -> Column:
    """Degrees from a dot product and the product of the lengths; null without lengths: the clipped cosine would make that 0."""
    return F.when((n > 0) & (n < float("inf")), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n)))))


def _direction_err(a: Column, b: Column) -> Column:
    return _cosine_angle(g.dot(a, b), g.norm(a) * g.norm(b))


def relative_pose_errs(pairs: DataFrame, reference: DataFrame, estimated: DataFrame) -> DataFrame:
    """Errors of the relative rotation and direction of camera pairs; null where
    a camera was not estimated."""
    def both(d: DataFrame, s: str, how: str):
        a = d.select("i", F.col("q").alias(f"qi{s}"), F.col("t").alias(f"ti{s}"))
        b = d.select(F.col("i").alias("j"), F.col("q").alias(f"qj{s}"), F.col("t").alias(f"tj{s}"))
        return lambda p: p.join(a, "i", how).join(b, "j", how)

    p = both(estimated, "2", "left")(both(reference, "1", "inner")(pairs.select("i", "j")))
    rel = lambda s: g.multiply(g.conjugate(F.col(f"qj{s}")), F.col(f"qi{s}"))
    way = lambda s: g.rotate(g.conjugate(F.col(f"qj{s}")), g.sub(F.col(f"ti{s}"), F.col(f"tj{s}")))
    p = p.withColumns({"r1": rel("1"), "r2": rel("2"), "d1": way("1"), "d2": way("2")})
    return p.select("i", "j", g.rotation_angle(F.col("r1"), F.col("r2")).alias("rotation_err"), _direction_err(F.col("d1"), F.col("d2")).alias("direction_err"))


def relative_pose_errs_all(reference: DataFrame, estimated: DataFrame, directions: bool = True, block: int = BLOCK_ROWS) -> DataFrame:
    """``relative_pose_errs`` of every two cameras i < j of ``reference``, by the same steps. Poses
    travel in blocks of cameras, so no pair is joined; they are flat numbers and every step is a
    column of its own, as there are so many pairs. Without ``directions`` these are not worked out."""
    p = reference.where("i is not null").select("i", F.col("q").alias("q1"), F.col("t").alias("t1")).join(estimated.select("i", F.col("q").alias("q2"), F.col("t").alias("t2")), "i", "left")
    kinds = {"q": "wxyz", "t": "xyz"} if directions else {"q": "wxyz"}
    parts = {f"{k}{s}": parts for k, parts in kinds.items() for s in "12"}
    known = [F.forall(F.array(*(F.col(k)[c] for c in cs)), lambda v: v.isNotNull()).alias(f"has_{k}") for k, cs in parts.items()]
    item = F.struct("i", *known, *(F.coalesce(F.col(k)[c], F.lit(0.0)).alias(k + c) for k, cs in parts.items() for c in cs))
    z = block_cells(p, item, block).select(F.explode("m").alias("a"), "n").select("a", F.explode("n").alias("b")).where("a.i < b.i")

    def quat(name: str, at: str = "") -> Column:
        return g.quat(*(F.col(f"{at}{name}{c}") for c in "wxyz"))

    def vec(name: str, at: str = "") -> Column:
        return g.vec(*(F.col(f"{at}{name}{c}") for c in "xyz"))

    def step(z: DataFrame, **made: Column) -> DataFrame:
        return z.withColumns({name + c: v for name, m in made.items() for c, v in m.__dict__["_parts"].items()})

    z = step(z, **{f"r{s}": g.multiply(g.conjugate(quat(f"q{s}", "b.")), quat(f"q{s}", "a.")) for s in "12"})
    z = step(z, e=g.multiply(g.conjugate(quat("r1")), quat("r2")))
    both = lambda *ks: functools.reduce(Column.__and__, (F.col(f"{x}.has_{k}{s}") for x, k in ks for s in "12"))
    out = [F.when(both("aq", "bq"), g.turn_angle(quat("e"))).alias("rotation_err")]
    if directions:
        z = step(z, **{f"v{s}": g.sub(vec(f"t{s}", "a."), vec(f"t{s}", "b.")) for s in "12"})
        z = step(z, **{f"d{s}": g.rotate(g.conjugate(quat(f"q{s}", "b.")), vec(f"v{s}")) for s in "12"})
        z = z.withColumns({"_dot": g.dot(vec("d1"), vec("d2")), "_n": g.norm(vec("d1")) * g.norm(vec("d2"))})
        out.append(F.when(both("at", "bt", "bq"), _cosine_angle(F.col("_dot"), F.col("_n"))).alias("direction_err"))
    return z.select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), *out)


def intrinsics_err(reference: DataFrame, estimated: DataFrame) -> DataFrame:
    j = reference.select("i", F.col("params").alias("a")).join(estimated.select("i", F.col("params").alias("b")), "i")
    f = F.abs(F.col("a")[0] - F.col("b")[0])
    return j.select("i", f.alias("f_err"), (100 * f / F.col("a")[0]).alias("f_pct"), F.abs(F.col("a")[2] - F.col("b")[2]).alias("cx_err"), F.abs(F.col("a")[3] - F.col("b")[3]).alias("cy_err"))


def precision_recall(errors: DataFrame, limit: float, keys: list[str]) -> DataFrame:
    """(err, kept): kept pairs within the limit are true positives."""
    good = F.col("err") <= limit
    a = errors.groupBy(*keys).agg(F.count_if(good & F.col("kept")).alias("tp"), F.count_if(~good & F.col("kept")).alias("fp"), F.count_if(good & ~F.col("kept")).alias("fn"))
    return a.select("*", (F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12)).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn") + 1e-12)).alias("recall"))


def view_graph_metrics(errors: DataFrame, kept: DataFrame, limit: float) -> DataFrame:
    e = errors.join(kept.select("i", "j", F.lit(True).alias("k")).distinct(), ["i", "j"], "left").withColumn("kept", F.coalesce("k", F.lit(False))).drop("k")
    long = e.select("kept", F.explode(F.array(F.struct(F.lit("rotation").alias("kind"), F.col("rotation_err").alias("err")), F.struct(F.lit("direction").alias("kind"), F.col("direction_err").alias("err")))).alias("x")).select("kept", "x.*")
    return precision_recall(long.where("err is not null"), limit, ["kind"])


def pct_change(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(b - a) / (a + eps) * 100; turned round where less is better."""
    j = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys, "left")
    c = (F.col("y") - F.col("x")) / (F.col("x") + 1e-12) * 100
    return j.withColumn("change", F.when(F.col("metric").rlike("error|outlier|duration"), -c).otherwise(c))


def results_pivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.groupBy("run").pivot("metric", names).agg(F.avg("value"))


def world_directions(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Direction (in camera i) turned to the world by camera i's rotation."""
    return pairs.join(cameras.select("i", "q"), "i").withColumn("_d", g.rotate(F.col("q"), F.col("direction"))).select("i", "j", "_d.*")


def landmark_directions(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    from lensframe.operators.tracks import rays

    return rays(observations, cameras).select("track_id", "i", "d.*")


def gt_inliers(matches: DataFrame, fundamentals: DataFrame, limit: float) -> DataFrame:
    s = g.epipolar_sampson(F.col("f"), F.col("u1"), F.col("v1"), F.col("u2"), F.col("v2"))
    return matches.join(fundamentals, ["i", "j"]).withColumn("inlier", s < limit * limit).drop("f")


def compare_pose_sets(a: DataFrame, b: DataFrame, degrees: float, distance: float) -> DataFrame:
    """One row: whether both know the same cameras and all are close."""
    j = a.select("i", F.col("q").alias("q1"), F.col("t").alias("t1")).join(b.select("i", F.col("q").alias("q2"), F.col("t").alias("t2")), "i", "full")
    ok = (g.rotation_angle(F.col("q1"), F.col("q2")) <= degrees) & (g.norm(g.sub(F.col("t1"), F.col("t2"))) <= distance)
    return j.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(True)).alias("same"), F.count("*").alias("cameras"))


def merge_metrics(children: DataFrame) -> DataFrame:
    return children.groupBy("node").agg(F.count("*").alias("children"), F.count_if("merged").alias("merged"), F.avg("overlap").alias("mean_overlap"))
