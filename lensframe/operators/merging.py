"""Merging the scenes of a cluster tree, and what two scenes have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.alignment import move_poses, sim3_from_poses
from lensframe.operators.scenes import drop_outlier_tracks
from lensframe.operators.tracks import merge_duplicate_tracks, reprojection_error
from lensframe.session import discard, materialise

_INNER = ("path", "i", "q", "t", "model", "params")


def _up(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.slice("path", F.lit(1), F.size("path") - 1))


def merge_tree(cameras: DataFrame, points: DataFrame, observations: DataFrame, most_error: float = 5.0, factor: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Merges the scenes of a cluster tree from the leaves to the root.

    ``cameras`` (path, i, q, t, model, params), ``points`` (path, track_id, x, y, z) and
    ``observations`` (path, track_id, i, u, v) hold every node's own scene in a frame
    of its own; path is the array of steps from the root. One job per level merges all
    children of all nodes of that level: each child is moved into its parent's frame by
    the cameras both know; the parent's cameras stay, of the children's the first
    child's; tracks that share a measurement become one; tracks of large mean error
    go. A child fails, and is dropped with all that was merged into it, if it shares
    fewer than two cameras with its parent's own scene or the parent has none.

    Returns the root's cameras, points, observations (track_id is the text
    ``depth/path/track_id`` of the first track merged into it) and the nodes merged:
    (path, ok, common, s), the root not among them.
    """
    name = F.concat_ws("/", F.lpad(F.size("path").cast("string"), 6, "0"), F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 10, "0")), "."), F.col("track_id").cast("string"))
    pts = materialise(points.select("path", name.alias("track_id"), "x", "y", "z"), "tree-points")
    obs = materialise(observations.select("path", name.alias("track_id"), "i", "u", "v"), "tree-observations")
    cams, nodes = materialise(cameras.select(*_INNER), "tree-cameras"), None
    for level in range(_depth(cams), 0, -1):
        here, above = F.size("path") == level, F.size("path") == level - 1
        done, sims, new_cams = _merge_level(cams, level)
        nodes = done if nodes is None else nodes.unionByName(done)
        by_path = sims.withColumnRenamed("child", "path")
        p = _moved_points(pts.where(here), by_path)
        new_pts = pts.where(above).unionByName(_up(p))
        new_obs = obs.where(above).unionByName(_up(obs.where(here).join(by_path.select("path"), "path", "left_semi")))
        new_obs = materialise(merge_duplicate_tracks(new_obs, ("path",)), "tree-observations")
        errors = reprojection_error(new_obs, new_cams.where(above), new_pts, ("path",))
        kept = materialise(drop_outlier_tracks(errors, most_error, factor, ("path",)).select("path", "track_id"), "tree-kept")
        rest = F.size("path") < level - 1
        next_pts = materialise(pts.where(rest).unionByName(new_pts.join(kept, ["path", "track_id"], "left_semi")), "tree-points")
        next_obs = materialise(obs.where(rest).unionByName(new_obs.join(kept, ["path", "track_id"], "left_semi")), "tree-observations")
        discard(cams, pts, obs, new_obs, kept)
        cams, pts, obs = new_cams, next_pts, next_obs
    return cams.drop("path"), pts.drop("path"), obs.drop("path"), _no_nodes(cams) if nodes is None else nodes


def merge_tree_nodes(cameras: DataFrame) -> DataFrame:
    """The nodes that ``merge_tree`` merges: (path, ok, common, s). They hang on the cameras
    alone, so no points or observations are moved."""
    cams, nodes = materialise(cameras.select(*_INNER), "tree-cameras"), None
    for level in range(_depth(cams), 0, -1):
        done, _, new_cams = _merge_level(cams, level)
        nodes = done if nodes is None else nodes.unionByName(done)
        discard(cams)
        cams = new_cams
    return _no_nodes(cams) if nodes is None else nodes


def _depth(cams: DataFrame) -> int:
    return cams.agg(F.max(F.size("path"))).first()[0] or 0


def _no_nodes(cams: DataFrame) -> DataFrame:
    return cams.select("path", F.lit(True).alias("ok"), F.lit(0).cast("long").alias("common"), F.lit(1.0).alias("s")).limit(0)


def _merge_level(cams: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of a level, the transforms of those that merge, and the cameras afterwards."""
    here, above = F.size("path") == level, F.size("path") == level - 1
    child = cams.where(here).withColumnRenamed("path", "child").withColumn("path", F.slice("child", F.lit(1), F.size("child") - 1))
    pairs = child.select("child", "path", "i", F.col("q").alias("qb"), F.col("t").alias("tb")).join(
        cams.where(above).select("path", "i", F.col("q").alias("qa"), F.col("t").alias("ta")), ["path", "i"])
    pairs = materialise(pairs.select("child", "i", "qa", "ta", "qb", "tb"), "tree-pairs")
    sims = materialise(sim3_from_poses(pairs, ["child"]), "tree-sims")
    all_ = cams.where(here).select(F.col("path").alias("child")).distinct()
    common = pairs.groupBy("child").agg(F.count("*").alias("common"))
    done = all_.join(common, "child", "left").join(sims.select("child", "s"), "child", "left").select(
        F.col("child").alias("path"), F.col("s").isNotNull().alias("ok"), F.coalesce("common", F.lit(0).cast("long")).alias("common"), "s")
    done = materialise(done, "tree-nodes")
    by_path = sims.withColumnRenamed("child", "path")

    moved = move_poses(cams.where(here), by_path, ["path"])
    both = cams.where(above).unionByName(moved.select(*_INNER))
    # Partition by the node that is to hold the camera: the parent's own path, or a child's without its last step.
    home = F.when(F.size("path") == level - 1, F.col("path")).otherwise(F.slice("path", F.lit(1), F.lit(level - 1)))
    first = Window.partitionBy("home", "i").orderBy(F.size("path"), "path")
    one = both.withColumn("home", home).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "path").withColumnRenamed("home", "path")
    new_cams = materialise(cams.where(F.size("path") < level - 1).unionByName(one.select(*_INNER)), "tree-cameras")
    discard(pairs)
    return done, sims, new_cams


def _moved_points(points: DataFrame, sims: DataFrame) -> DataFrame:
    j = points.join(sims.select("path", F.col("s").alias("_s"), F.col("q").alias("_q"), F.col("t").alias("_t")), "path")
    j = g.bound(j, "_p", g.scale(g.add(g.rotate(F.col("_q"), g.vec(*(F.col(c) for c in "xyz"))), F.col("_t")), F.col("_s")))
    return j.select("path", "track_id", *(F.col("_p")[c].alias(c) for c in "xyz"))


def track_quality(errors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, track_id, len, err: measurements and largest error, infinite where one failed."""
    worst = F.max(F.coalesce(F.when(~F.isnan("err"), F.col("err")), F.lit(float("inf"))))
    return errors.groupBy(*keys, "track_id").agg(F.count("*").alias("len"), worst.alias("err"))


def scene_overlap_points(parent: DataFrame, child: DataFrame, parent_quality: DataFrame, child_quality: DataFrame, keys: list[str],
                         most: int = 100, good_length: int = 3, good_error: float = 2.0) -> DataFrame:
    """keys, parent_track, child_track, shared, preferred, rank: tracks of two scenes that
    see the same points, one to one.

    A child's track goes with the parent's track that shares most measurements (camera
    and whole pixel), the smaller id among equals. As every child's track has one
    candidate, the greedy choice by shared count, then length, then error, is each
    parent's first candidate. Pairs of two good tracks (long and exact enough) come first;
    ``most`` pairs of each pair of scenes are returned. ``parent`` and ``child`` are
    (keys, track_id, i, u, v), the qualities those of ``track_quality``."""
    cell = lambda d, name: d.select(*keys, F.col("track_id").alias(name), "i", F.floor("u").cast("long").alias("cu"), F.floor("v").cast("long").alias("cv"))
    met = cell(parent, "parent_track").join(cell(child, "child_track"), [*keys, "i", "cu", "cv"])
    shared = met.groupBy(*keys, "parent_track", "child_track").agg(F.count("*").alias("shared"))
    best = shared.groupBy(*keys, "child_track").agg(F.max_by(F.struct("parent_track", "shared"), F.struct("shared", -F.col("parent_track"))).alias("b")).select(*keys, "child_track", "b.*")
    for name, q in (("parent", parent_quality), ("child", child_quality)):
        good = (F.col("len") >= good_length) & (F.col("err") < good_error)
        best = best.join(q.select(*keys, F.col("track_id").alias(f"{name}_track"), F.col("len").alias(f"{name}_len"), F.col("err").alias(f"{name}_err"), good.alias(f"{name}_good")), [*keys, f"{name}_track"])
    order: list[Column] = [-F.col("shared"), -(F.col("parent_len") + F.col("child_len")), F.col("parent_err") + F.col("child_err"), F.col("child_track")]
    cols = ("child_track", "shared", "parent_len", "child_len", "parent_err", "child_err", "parent_good", "child_good")
    own = best.groupBy(*keys, "parent_track").agg(F.min_by(F.struct(*cols), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("b")).select(*keys, "parent_track", "b.*")
    own = own.withColumn("preferred", F.col("parent_good") & F.col("child_good"))
    w = Window.partitionBy(*keys).orderBy(F.desc("preferred"), *order)
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*keys, "parent_track", "child_track", "shared", "preferred", "rank")
