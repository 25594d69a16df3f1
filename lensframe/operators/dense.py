"""Voxels that many cameras see, and depth maps that agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.ranking import percentiles
from lensframe.session import materialise


def _pinhole(params: Column, p: Column) -> Column:
    """Pixel and depth, whatever the depth's sign; null at depth 0."""
    z = F.nullif(p["z"], F.lit(0.0))
    return F.struct((params[0] * p["x"] / z + params[2]).alias("u"), (params[1] * p["y"] / z + params[3]).alias("v"), p["z"].alias("z"))


def voxel_views(cameras: DataFrame, cube: float, resolution: int, width: float, height: float) -> DataFrame:
    """id, n: in how many images each voxel of a cube around the origin lies; ids count z
    fastest. Every camera goes through the grid by itself, a slice at a time, and tasks
    add up before the shuffle. As in the usual test, a voxel behind a camera counts
    where its mirrored pixel lies in the image."""
    step = cube / (resolution - 1)
    at = lambda k: k * step - cube / 2
    axis = F.sequence(F.lit(0), F.lit(resolution - 1))
    c = cameras.select("q", "t", "params", F.explode(axis).alias("ix")).withColumn("iy", F.explode(axis)).withColumn("iz", F.explode(axis))
    c = g.bound(c, "_p", g.to_camera(F.col("q"), F.col("t"), g.vec(*(at(F.col(f"i{a}")) for a in "xyz"))))
    c = g.bound(c, "_uv", _pinhole(F.col("params"), F.col("_p")))
    seen = c.where((F.col("_uv.u") >= 0) & (F.col("_uv.u") < width) & (F.col("_uv.v") >= 0) & (F.col("_uv.v") < height))
    ident = (F.col("ix") * resolution + F.col("iy")) * resolution + F.col("iz")
    return seen.groupBy(ident.cast("long").alias("id")).agg(F.count("*").alias("n"))


def frustum_overlap(cameras: DataFrame, cube: float, resolution: int, width: float, height: float, least: int = 1000) -> DataFrame:
    """ix, iy, iz, x, y, z, n of the voxels that most cameras see: those at or above the
    percentile that leaves about ``least`` voxels (99 at most), without the ones that
    have no other kept voxel within sqrt(3) * cube / resolution."""
    cells = resolution**3
    n = cameras.sparkSession.range(cells).join(voxel_views(cameras, cube, resolution, width, height), "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    n = materialise(n, "voxels")
    cut = percentiles(n, [], F.col("n"), {"cut": max(0.0, min(0.99, 1 - least / cells))})
    kept = materialise(n.crossJoin(cut).where(F.col("n") >= F.col("cut")).drop("cut"), "voxels-kept")  # the cut is one row
    reach = (math.sqrt(3) * cube / resolution / (cube / (resolution - 1))) ** 2 + 1e-9
    r = range(-int(reach), int(reach) + 1)
    near = [(a, b, c) for a in r for b in r for c in r if 0 < a * a + b * b + c * c <= reach]
    place = {"ix": F.floor(F.col("id") / resolution**2), "iy": F.floor(F.col("id") / resolution) % resolution, "iz": F.col("id") % resolution}
    kept = kept.withColumns(place)
    offset = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for a, v in zip("xyz", d))) for d in near))).alias("d")
    about = kept.select(offset, *place).select(*((F.col(f"i{a}") + F.col(f"d.d{a}")).alias(f"i{a}") for a in "xyz")).distinct()
    step = cube / (resolution - 1)
    return kept.join(about, list(place), "left_semi").select(*place, *((F.col(f"i{a}") * step - cube / 2).alias(a) for a in "xyz"), "n")


def unit_cube(voxels: DataFrame) -> DataFrame:
    """scale, ox, oy, oz that bring the voxels into the unit cube, their mean to its centre."""
    a = voxels.agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("side"), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
    a = a.withColumn("scale", 1 / F.nullif("side", F.lit(0.0)))
    return a.select("scale", *((0.5 - F.col(f"m{c}") * F.col("scale")).alias(f"o{c}") for c in "xyz"))


def _lift(params: Column, u: Column, v: Column, d: Column) -> Column:
    return g.vec((u - params[2]) / params[0] * d, (v - params[3]) / params[1] * d, d)


def depth_agreement(depths: DataFrame, cameras: DataFrame, sources: DataFrame, most_pixels: float = 1.0, most_depth: float = 0.01) -> DataFrame:
    """The pixels of ``depths`` (view, col, row, depth, conf) with agree, the number of source
    views that agree, and total, the sum of the depths these give. A source view agrees
    if the pixel, moved there, taken at the depth of the nearest whole pixel and moved
    back, is less than ``most_pixels`` off and its depth less than the share
    ``most_depth``. ``sources`` are (view, source) pairs; cameras (view, params, q, t)
    are pinholes."""
    cam = lambda k: cameras.select(F.col("view").alias(f"view{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("params", "q", "t")))
    key = ["view", "col", "row"]
    r = depths.where("depth > 0").select(*key, "depth").join(sources.select("view", F.col("source").alias("view2")).distinct(), "view")
    r = r.withColumn("view1", F.col("view")).join(cam(1), "view1").join(cam(2), "view2")
    col = {k: (F.col(f"params{k}"), F.col(f"q{k}"), F.col(f"t{k}")) for k in (1, 2)}

    def over(rows, a, b, u, v, d, name):
        """The pixel u, v at depth d of camera a, as camera b sees it."""
        (p1, q1, t1), (p2, q2, t2) = col[a], col[b]
        rows = g.bound(rows, "_w", g.add(g.rotate(q1, _lift(p1, u, v, d)), t1))
        rows = g.bound(rows, "_c", g.to_camera(q2, t2, F.col("_w")))
        return g.bound(rows, name, _pinhole(p2, F.col("_c"))).drop("_w", "_c")

    r = over(r, 1, 2, F.col("col"), F.col("row"), F.col("depth"), "s").where("s.z > 0")
    r = r.withColumns({"c2": F.rint("s.u").cast("long"), "r2": F.rint("s.v").cast("long")})
    other = depths.where("depth > 0").select(F.col("view").alias("view2"), F.col("col").cast("long").alias("c2"), F.col("row").cast("long").alias("r2"), F.col("depth").alias("d2"))
    r = over(r.join(other, ["view2", "c2", "r2"]), 2, 1, F.col("s.u"), F.col("s.v"), F.col("d2"), "b").where("b.z > 0")
    off = F.sqrt((F.col("b.u") - F.col("col")) ** 2 + (F.col("b.v") - F.col("row")) ** 2)
    ok = r.where((off < most_pixels) & (F.abs(F.col("b.z") - F.col("depth")) / F.col("depth") < most_depth))
    votes = ok.groupBy(*key).agg(F.count("*").alias("agree"), F.sum("b.z").alias("total"))
    return depths.join(votes, key, "left").select(*depths.columns, F.coalesce("agree", F.lit(0).cast("long")).alias("agree"), F.coalesce("total", F.lit(0.0)).alias("total"))


def depth_fuse(agreement: DataFrame, cameras: DataFrame, least_conf: float = 0.8, least_views: int = 1) -> DataFrame:
    """view, col, row, depth, x, y, z: the pixels of enough confidence that enough source views
    agree on, at the mean of their own depth and those the views give, in the world."""
    k = agreement.where((F.col("conf") > least_conf) & (F.col("agree") >= least_views))
    k = k.withColumn("_d", (F.col("depth") + F.col("total")) / (F.col("agree") + 1)).join(cameras.select("view", "params", "q", "t"), "view")
    k = g.bound(k, "_w", g.add(g.rotate(F.col("q"), _lift(F.col("params"), F.col("col"), F.col("row"), F.col("_d"))), F.col("t")))
    return k.select("view", "col", "row", F.col("_d").alias("depth"), *(F.col("_w")[c].alias(c) for c in "xyz"))


def depth_mask_ratios(agreement: DataFrame, least_conf: float = 0.8, least_views: int = 1) -> DataFrame:
    """Per view the share of its pixels that pass by geometry, by confidence, by both."""
    geo, conf = F.col("agree") >= least_views, F.coalesce(F.col("conf") > least_conf, F.lit(False))
    share = lambda c: F.avg(c.cast("int"))
    return agreement.groupBy("view").agg(share(geo).alias("geometric"), share(conf).alias("confidence"), share(geo & conf).alias("joint"))
