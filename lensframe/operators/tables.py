"""Filters, joins, aggregates, windows and set operations on scene tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensframe.operators.ranking import numbered, percentiles


# -- filters ---------------------------------------------------------------
def valid_two_view(results: DataFrame) -> DataFrame:
    return results.where("rotation is not null and direction is not null")


def match_conf_filter(matches: DataFrame, minimum: float, keys: list[str]) -> DataFrame:
    """Confidence above the minimum, ranked from the best."""
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"), "k1", "k2")
    return matches.where(F.col("conf") > minimum).withColumn("rank", F.row_number().over(w))


def confidence_floor(rows: DataFrame, column: str, threshold: float) -> Column:
    """min(threshold, mean - population deviation), a scalar subquery."""
    s = rows.agg(F.least(F.lit(threshold), F.avg(column) - F.stddev_pop(column)).alias("floor"))
    return s


def point_conf_filter(points: DataFrame, threshold: float, column: str = "conf") -> DataFrame:
    return points.join(F.broadcast(confidence_floor(points, column, threshold)), F.col(column) >= F.col("floor")).drop("floor")


def visibility_filter(observations: DataFrame, visibility: float, threshold: float, min_length: int) -> DataFrame:
    """Visible, confident, in front; then tracks that are still long enough."""
    kept = observations.join(F.broadcast(confidence_floor(observations, "conf", threshold)),
                             (F.col("visibility") > visibility) & (F.col("conf") > F.col("floor")) & (F.col("depth") > 0)).drop("floor")
    long_enough = kept.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_length).select("track_id")
    return kept.join(long_enough, "track_id", "left_semi")


def frame_stride(frames: DataFrame, poses: DataFrame, stride: int, first: int | None = None, key: str = "sequence") -> DataFrame:
    """Frames with a pose, every stride-th of each sequence, the first few."""
    w = Window.partitionBy(key).orderBy("ts")
    out = frames.join(poses.select(key, "ts").distinct(), [key, "ts"], "left_semi").withColumn("n", F.row_number().over(w) - 1)
    out = out.where(F.col("n") % stride == 0).withColumn("n", (F.col("n") / stride).cast("long"))
    return out.where(F.col("n") < first) if first is not None else out


def focal_from_exif(images: DataFrame) -> DataFrame:
    """Focal length in pixels: 35 mm rule, focal over sensor width, sensor width
    from the focal plane resolution, else null (and 1.2 max side as fallback)."""
    e = lambda k: F.col("exif")[k].cast("double")
    side = F.greatest("width", "height")
    sensor = F.coalesce(F.col("sensor_width"), F.col("width") / F.nullif(e("FocalPlaneXResolution"), F.lit(0.0)) * F.when(
        F.col("exif")["FocalPlaneResolutionUnit"] == "3", 10.0).otherwise(25.4))
    known = F.coalesce(F.nullif(e("FocalLengthIn35mmFilm"), F.lit(0.0)) / 35.0 * side, F.nullif(e("FocalLength"), F.lit(0.0)) / sensor * side)
    return images.withColumns({"focal": F.coalesce(known, 1.2 * side), "from_exif": known.isNotNull()})


def exif_filter(images: DataFrame) -> DataFrame:
    return focal_from_exif(images).where("from_exif")


def desc_nan_filter(keypoints: DataFrame) -> DataFrame:
    return keypoints.where(~F.exists("desc", lambda x: x.isNull() | F.isnan(x)))


def keypoint_mask(keypoints: DataFrame, mask: DataFrame) -> DataFrame:
    """Keypoints whose rounded pixel is set; mask is (i, col, row)."""
    return keypoints.withColumns({"col": F.rint("u").cast("long"), "row": F.rint("v").cast("long")}).join(mask, ["i", "col", "row"], "left_semi").drop("col", "row")


def every_nth(rows: DataFrame, n: int, order: str, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") % n == 0).drop("_r")


def norm_percentile_filter(points: DataFrame, p: float = 0.95) -> DataFrame:
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    limit = percentiles(points, [], n, {"limit": p})
    return points.join(F.broadcast(limit), n < F.col("limit")).drop("limit")


def rescale_intrinsics(cameras: DataFrame, max_short_side: int) -> DataFrame:
    """Short side to at most the limit; sizes are rounded half to even."""
    f = F.least(F.lit(1.0), max_short_side / F.least("width", "height"))
    w, h = F.rint(F.col("width") * f), F.rint(F.col("height") * f)
    sx, sy = w / F.col("width"), h / F.col("height")
    return cameras.withColumns({"new_width": w.cast("int"), "new_height": h.cast("int"), "new_fx": F.col("fx") * sx,
                                "new_fy": F.col("fy") * sy, "new_cx": F.col("cx") * sx, "new_cy": F.col("cy") * sy})


# -- joins -----------------------------------------------------------------
def selected_cameras_tracks(observations: DataFrame, cameras: DataFrame, tasks: int | None = None) -> DataFrame:
    """Tracks all of whose cameras are kept; dealt to so many tasks, where given."""
    lost = observations.join(cameras.select("i").distinct(), "i", "left_anti").select("track_id").distinct()
    dealt = observations.repartition(tasks, "track_id") if tasks else observations
    return dealt.join(lost, "track_id", "left_anti")


def track_select_for_cameras(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    return observations.join(cameras.select("i").distinct(), "i", "left_semi")


def zero_track_cameras(cameras: DataFrame, observations: DataFrame) -> DataFrame:
    """Cameras with a measurement; all of them if none has one."""
    seen = cameras.join(observations.select("i").distinct(), "i", "left_semi")
    none = observations.join(cameras.select("i"), "i", "left_semi").agg((F.count("*") == 0).alias("none"))
    return seen.unionByName(cameras.join(F.broadcast(none), F.col("none")).drop("none"))


def sensor_width_lookup(images: DataFrame, sensors: DataFrame) -> DataFrame:
    """Maker contained either way and model contained either way, case folded;
    an exact model wins; ``matches`` above one is an error for the caller. The
    sensor list is a fixed catalogue of a few thousand rows."""
    s = sensors.select(F.lower("maker").alias("sm"), F.lower("model").alias("so"), F.col("width").alias("sensor_width"))
    im = images.withColumns({"_m": F.lower("maker"), "_o": F.lower("model")})
    either = lambda a, b: F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
    hit = im.join(s, either("_m", "sm") & either("_o", "so"), "left").withColumn("exact", (F.col("_o") == F.col("so")).cast("int"))
    w = Window.partitionBy("i")
    hit = hit.withColumn("best", F.max("exact").over(w)).where(F.col("best").isNull() | (F.col("exact") == F.col("best")))
    return hit.groupBy("i").agg(F.min("sensor_width").alias("sensor_width"), F.count("sensor_width").alias("matches"))


def compare_runs_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of two runs with where they occur."""
    return a.select("name", F.lit(True).alias("in_a")).distinct().join(b.select("name", F.lit(True).alias("in_b")).distinct(), "name", "full").select(
        "name", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def merge_reports(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, F.col("value").alias("value_1")).join(b.select(*keys, F.col("value").alias("value_2")), keys, "left")


def similarity_vs_error(scores: DataFrame, errors: DataFrame) -> DataFrame:
    e = errors.where("rotation_err is not null and direction_err is not null")
    return scores.join(e, ["i", "j"]).select("i", "j", "score", F.greatest("rotation_err", "direction_err").alias("pose_err"))


# -- aggregates ------------------------------------------------------------
def track_length_stats(observations: DataFrame) -> DataFrame:
    n = observations.groupBy("track_id").agg(F.count("*").alias("n"))
    lengths = n.groupBy("n").agg(F.count("*").alias("k"))  # as many rows as there are lengths
    all_ = lengths.agg(F.sum("k").alias("tracks"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return all_.crossJoin(percentiles(n, [], F.col("n"), {"median": 0.5})).select("tracks", "mean", "median", "shortest", "longest")


def camera_obs_count(observations: DataFrame) -> DataFrame:
    return observations.groupBy("i").agg(F.count("*").alias("n"))


def reproj_by_camera(observations: DataFrame, good: float = 2.0) -> DataFrame:
    return observations.groupBy("i").agg(
        F.count("err").alias("n"), F.avg("err").alias("mean"), F.percentile("err", F.lit(0.5)).alias("median"),
        F.max("err").alias("worst"), F.count_if(F.col("err") < good).alias("good"))


def scene_reproj_stats(observations: DataFrame) -> DataFrame:
    e = F.when(~F.isnan("err"), F.col("err"))
    all_ = observations.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.min(e).alias("least"), F.max(e).alias("most"))
    return all_.crossJoin(percentiles(observations, [], e, {"median": 0.5})).select("n", "mean", "median", "least", "most")


def edge_error_agg(errors: DataFrame, how: str = "min") -> DataFrame:
    a = F.min("err") if how == "min" else F.percentile("err", F.lit(0.5))
    return errors.groupBy("i", "j").agg(a.alias("err"))


def frontend_summary(reports: DataFrame, threshold: float) -> DataFrame:
    pose = F.greatest("rotation_err", "direction_err")
    all_ = reports.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("rotation_err") < threshold).alias("rotation_ok"),
        F.count_if(F.col("direction_err") < threshold).alias("direction_ok"), F.count_if(pose < threshold).alias("pose_ok"),
        F.count_if(F.col("ratio") == 1.0).alias("all_inliers"), F.avg("ratio").alias("mean_ratio"))
    return all_.crossJoin(percentiles(reports, [], F.col("rotation_err"), {"rotation_median": 0.5}))


def two_view_report(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: inliers, their share, mean error of inliers and of the others."""
    return matches.groupBy(*keys).agg(
        F.count_if("inlier").alias("n_inliers"), F.avg(F.col("inlier").cast("int")).alias("ratio"),
        F.avg(F.when(F.col("inlier"), F.col("err"))).alias("inlier_err"), F.avg(F.when(~F.col("inlier"), F.col("err"))).alias("outlier_err"))


def two_view_rows(reports: DataFrame, images: DataFrame) -> DataFrame:
    """Rounded rows with file names; a zero error becomes null (kept behaviour)."""
    name = images.select("i", "name")
    r = lambda c: F.nullif(F.round(c, 2), F.lit(0.0)).alias(c)
    out = reports.join(name.withColumnRenamed("name", "name_i"), "i").join(name.select(F.col("i").alias("j"), F.col("name").alias("name_j")), "j")
    return out.select("i", "j", "name_i", "name_j", r("rotation_err"), r("direction_err"), F.round("ratio", 2).alias("ratio"))


def exit_code_dist(codes: DataFrame) -> DataFrame:
    return codes.groupBy("gt_code", "code").agg(F.count("*").alias("n"))


def retriever_summary(images: DataFrame, pairs: DataFrame) -> DataFrame:
    return images.agg(F.countDistinct("i").alias("images")).join(F.broadcast(pairs.agg(F.count("*").alias("pairs"))), F.lit(True))


def avg_calibration(cameras: DataFrame, key: list[str]) -> DataFrame:
    e = cameras.select(*key, F.posexplode("params").alias("p", "v")).groupBy(*key, "p").agg(F.avg("v").alias("v"))
    return e.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("params"))


def track_color(observations: DataFrame, pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Mean colour of a track's pixels, cut to a byte; the old one without any."""
    at = observations.select("track_id", "i", F.rint("u").cast("long").alias("col"), F.rint("v").cast("long").alias("row"))
    c = at.join(pixels, ["i", "col", "row"]).groupBy("track_id").agg(*(F.avg(x).alias(f"m{x}") for x in "rgb"))
    return points.join(c, "track_id", "left").select("track_id", *(F.coalesce(F.floor(f"m{x}").cast("int"), F.col(x)).alias(x) for x in "rgb"))


def runtime_breakdown(sections: DataFrame, total: str = "total") -> DataFrame:
    """Seconds per section and run; what the sections leave of the total."""
    s = sections.where(F.col("section") != total).groupBy("run", "section").agg(F.sum("seconds").alias("seconds"))
    whole = sections.where(F.col("section") == total).groupBy("run").agg(F.sum("seconds").alias("t"))
    rest = whole.join(s.groupBy("run").agg(F.sum("seconds").alias("s")), "run", "left").select(
        "run", F.lit("remainder").alias("section"), (F.col("t") - F.coalesce("s", F.lit(0.0))).alias("seconds"))
    return s.unionByName(rest)


def worker_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("worker").agg(F.count("*").alias("n"))


# -- windows ---------------------------------------------------------------
def keypoint_topk(keypoints: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.desc_nulls_last("response"), "k")
    return keypoints.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def keypoint_offsets(pairs: DataFrame) -> DataFrame:
    """(i, i1, i2, n): where each pair's keypoints start in image i's list."""
    w = Window.partitionBy("i").orderBy("i1", "i2").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumn("offset", F.sum("n").over(w) - F.col("n"))


def depth_range(depths: DataFrame) -> DataFrame:
    p = F.percentile("depth", F.array(F.lit(0.01), F.lit(0.99)))
    return depths.groupBy("i").agg(p.alias("p")).select("i", F.col("p")[0].alias("near"), F.col("p")[1].alias("far"))


def coverage_tracks(observations: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks kept when going by (length desc, error, id) and keeping one that
    covers a new patch: those of least rank in some patch. ``observations`` has
    (track_id, i, cell), ``tracks`` (track_id, n, err)."""
    o = observations.join(tracks, "track_id")
    rank = F.struct((-F.col("n")).alias("n"), F.col("err"), F.col("track_id"))
    best = o.groupBy("i", "cell").agg(F.min(rank).alias("r"))
    return best.select(F.col("r.track_id").alias("track_id")).distinct()


def cover_k_tracks(observations: DataFrame, k: int = 12, least: int = 3) -> DataFrame:
    """Order-free cover: every camera's k longest tracks of enough cameras."""
    n = observations.groupBy("track_id").agg(F.countDistinct("i").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("i").orderBy(F.desc("n"), "track_id")
    o = observations.select("track_id", "i").distinct().join(n, "track_id")
    return o.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("track_id").distinct()


def splat_topk(splats: DataFrame, k: int) -> DataFrame:
    return splats.orderBy(F.desc("opacity"), "id").limit(k)


def scene_downsample(points: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Exactly int(n * fraction) points of each scene, in a seeded hash order."""
    o = points.withColumn("_o", F.md5(F.concat_ws(":", F.lit(seed), "track_id")))
    return numbered(o, ["scene_id"], ["_o", "track_id"], "_r", "_n").where(F.col("_r") < F.floor(F.col("_n") * fraction)).drop("_o", "_n", "_r")


def results_recent(log: DataFrame, midnight: str) -> DataFrame:
    return log.where(F.col("ts") >= F.lit(midnight).cast("timestamp"))


def sort_by_name(images: DataFrame, key: list[str]) -> DataFrame:
    return images.withColumn("index", F.row_number().over(Window.partitionBy(*key).orderBy("name")) - 1)


# -- sets ------------------------------------------------------------------
def common_cameras(parent: DataFrame, child: DataFrame) -> DataFrame:
    return parent.select("i").intersect(child.select("i"))


def scenes_union(parent: DataFrame, child: DataFrame, key: str = "i") -> DataFrame:
    """Rows of both; the parent's where both have the key."""
    return parent.unionByName(child.join(parent.select(key).distinct(), key, "left_anti"))


def splats_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
