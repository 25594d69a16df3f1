"""Readers of scene files: one Spark job over a tree of many scenes.

Every reader takes a path (a folder is searched to the bottom) and gives typed
tables; the folder of a file, relative or not, is its ``scene``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensframe.operators.ranking import numbered


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(scene, file, line) of the files ``name`` below ``path``, with what orders the lines
    of a file: a large file is read in several blocks, each by one task in order."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    return t.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("scene"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"),
                    F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def _counted(lines: DataFrame) -> DataFrame:
    """The lines with their number n in the file, from 0. A task counts the lines of a block as it
    reads them; only a row per block, with the lines before it, is shuffled and sent to all tasks."""
    at = lines.drop("_line").withColumn("_at", F.monotonically_increasing_id())  # without gaps in a block
    by = ["scene", "file", "_block"]
    before = F.sum("_n").over(Window.partitionBy("scene", "file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = at.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    blocks = blocks.select(*by, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return at.join(F.broadcast(blocks), by).withColumn("n", F.col("_at") + F.col("_shift")).drop("_block", "_at", "_shift")


def _data(lines: DataFrame) -> DataFrame:
    return lines.where("not startswith(ltrim(line), '#')").withColumn("f", F.split(F.trim("line"), "\\s+"))


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def src_cameras(spark: SparkSession, path: str, name: str = "cameras.txt") -> DataFrame:
    d = _data(_lines(spark, path, name)).where("trim(line) <> ''")
    f = F.col("f")
    return d.select("scene", f[0].cast("long").alias("camera_id"), f[1].alias("model"), f[2].cast("int").alias("width"), f[3].cast("int").alias("height"),
                    _doubles(F.slice("f", F.lit(5), F.size("f") - 4)).alias("params"))


def src_images(spark: SparkSession, path: str, name: str = "images.txt") -> DataFrame:
    """Two lines a record: the pose (world to camera in the file, turned to
    camera to world here) and the image points. ``i`` is the rank of the name.
    Names are ranked among poses only; point lines are moved once, to their poses."""
    from lensframe.functions import geometry as g

    record = ["scene", "file", "record"]
    lines = _counted(_lines(spark, path, name).where("not startswith(ltrim(line), '#')")).withColumn("record", F.floor(F.col("n") / 2))
    words = lambda c: F.split(F.trim(c), "\\s+")
    d = lines.where("n % 2 = 0").select(*record, words("line").alias("f")).where("size(f) >= 10")
    f = F.col("f")
    q = g.quat(*(f[k].cast("double") for k in (1, 2, 3, 4)))
    t = g.vec(*(f[k].cast("double") for k in (5, 6, 7)))
    d = d.select(*record, f[0].cast("long").alias("image_id"), f[8].cast("long").alias("camera_id"), f[9].alias("name"),
                 g.conjugate(q).alias("q"), g.scale(g.rotate(g.conjugate(q), t), F.lit(-1.0)).alias("t"))
    d = numbered(d, ["scene"], ["name", "image_id"], "i")
    points = lines.where("n % 2 = 1").select(*record, F.col("line").alias("points"))
    return d.join(points, record, "left").select("scene", "image_id", "camera_id", "name", "q", "t", words("points").alias("points"), "i")


def src_image_points(images: DataFrame) -> DataFrame:
    """(scene, image_id, k, u, v, point_id) of the image point triples."""
    p = lambda k, o: F.get("points", k * 3 + o)
    one = lambda k: F.struct(k.alias("k"), p(k, 0).cast("double").alias("u"), p(k, 1).cast("double").alias("v"), p(k, 2).cast("long").alias("point_id"))
    x = images.where("size(points) >= 3").select("scene", "image_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("points") / 3).cast("int") - 1), one)).alias("p"))
    return x.select("scene", "image_id", "p.*")


def src_points(spark: SparkSession, path: str, name: str = "points3D.txt") -> DataFrame:
    d = _data(_lines(spark, path, name)).where("trim(line) <> ''")
    f = F.col("f")
    tail = F.slice("f", F.lit(9), F.size("f") - 8)
    return d.select("scene", f[0].cast("long").alias("point_id"), *(f[k].cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))),
                    *(f[k].cast("int").alias(c) for k, c in ((4, "r"), (5, "g"), (6, "b"))), f[7].cast("double").alias("error"), tail.alias("track"))


def src_tracks(points: DataFrame, *keep: str) -> DataFrame:
    """(scene, point_id, image_id, k) of the tracks, with the columns ``keep`` of the points."""
    p = lambda k, o: F.get("track", k * 2 + o).cast("long")
    one = lambda k: F.struct(p(k, 0).alias("image_id"), p(k, 1).alias("k"))
    x = points.where("size(track) >= 2").select("scene", "point_id", *keep, F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("track") / 2).cast("int") - 1), one)).alias("p"))
    return x.select("scene", "point_id", "p.*", *keep)


def src_scene_tree(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Folders that hold a whole model, as paths below ``root``. Only the names of files are
    read; a model file may be a folder of parts (``cameras.txt`` or ``file=cameras.txt``)."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = r"^(.*?)/(?:file=)?(cameras|images|points3D)\.txt(?:/[^/]*)?$"
    t = t.select(F.regexp_extract("path", found, 1).alias("scene"), F.regexp_extract("path", found, 2).alias("file")).where("file <> ''").distinct()
    t = t.groupBy("scene").agg(F.count("*").alias("files"))
    return t.where("files = 3").select("scene", F.array_remove(F.split(F.regexp_replace("scene", ".*" + root, ""), "/"), "").alias("path"))


def src_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("i long, j long").option("header", True).csv(path)


def src_similarity_matrix(spark: SparkSession, path: str, name: str = "*.txt") -> DataFrame:
    """Finite scores of a comma matrix."""
    d = _counted(_lines(spark, path, name).where("trim(line) <> ''"))
    x = d.select("scene", F.col("n").alias("i"), F.posexplode(F.split("line", ",")).alias("j", "s")).withColumn("score", F.trim("s").try_cast("double"))
    return x.where("score is not null and not isnan(score) and abs(score) < double('infinity')").select("scene", "i", "j", "score")


def src_posegraph(spark: SparkSession, path: str, name: str = "*.g2o") -> DataFrame:
    d = _data(_lines(spark, path, name)).where("startswith(line, 'VERTEX_SE3:QUAT')")
    f = F.col("f")
    return d.select("scene", f[1].cast("long").alias("id"), *(f[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "qx", "qy", "qz", "qw"), 2)))


def src_constraints(spark: SparkSession, path: str, name: str = "constraints.txt") -> DataFrame:
    """75 numbers a row: two ids, a 3x4 pose, a 6x6 covariance, 5x5 counts."""
    d = _lines(spark, path, name).withColumn("f", F.split(F.trim("line"), "[,\\s]+")).where("size(f) = 75")
    s = lambda a, n: _doubles(F.slice("f", a, n))
    square = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(c, k * n + 1, F.lit(n)))
    return d.select("scene", F.col("f")[0].cast("double").cast("long").alias("a"), F.col("f")[1].cast("double").cast("long").alias("b"), s(3, 12).alias("pose"),
                    square(s(15, 36), 6).alias("cov"), square(F.transform(s(51, 25), lambda x: x.cast("int")), 5).alias("counts"))


def src_poselog(spark: SparkSession, path: str, name: str = "*.log") -> DataFrame:
    """Five lines a record: a header, then a 4x4 matrix."""
    d = _counted(_lines(spark, path, name).where("trim(line) <> ''")).withColumnRenamed("n", "r")
    rec = d.groupBy("scene", "file", F.floor(F.col("r") / 5).alias("record")).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l"))
    num = F.flatten(F.transform(F.slice("l", 2, 4), lambda x: F.split(F.trim(x["line"]), "\\s+")))
    return rec.select("scene", "record", F.split(F.trim(F.col("l")[0]["line"]), "\\s+")[0].cast("long").alias("i"), _doubles(num).alias("m"))


def src_matrix_files(spark: SparkSession, path: str, name: str = "*.txt") -> DataFrame:
    """One matrix a file; the image index is the file's number, or that of its folder
    ``i=<number>``."""
    d = _data(_lines(spark, path, name)).where("trim(line) <> ''")
    x = d.groupBy("scene", "file").agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "f"))).alias("l"))
    number = F.coalesce(F.nullif(F.regexp_extract("scene", "/i=(\\d+)$", 1), F.lit("")), F.regexp_extract("file", "(\\d+)", 1))
    return x.select("scene", number.cast("long").alias("i"), F.transform("l", lambda r: F.transform(r["f"], lambda v: v.cast("double"))).alias("m"))


def src_covis_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Names joined by a dash (column value) -> sorted distinct index pairs."""
    p = F.split("value", "-")
    x = pairs.select(F.least(p[0], p[1]).alias("a"), F.greatest(p[0], p[1]).alias("b")).distinct()
    n = images.select("name", "i")
    x = x.join(n.select(F.col("name").alias("a"), F.col("i").alias("ia")), "a").join(n.select(F.col("name").alias("b"), F.col("i").alias("ib")), "b")
    return x.select(F.least("ia", "ib").alias("i"), F.greatest("ia", "ib").alias("j")).distinct()


def src_metrics_json(spark: SparkSession, path: str, name: str = "*.json", lines: bool = False) -> DataFrame:
    """{group: {metric: number or {summary, full_data}}} -> a row per value; a document
    per file, or per line."""
    t = spark.read.option("wholetext", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    t = t.select(F.regexp_extract("_metadata.file_path", "run=([^/]*)", 1).alias("run"), F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("grp", "m"))
    t = t.select("run", "grp", F.explode("m").alias("metric", "v"))
    full = F.from_json("v", "struct<full_data:array<double>>")["full_data"]
    return t.select("run", "grp", "metric", F.explode(F.coalesce(full, F.array(F.col("v").try_cast("double")))).alias("value")).where("value is not null")


def src_calibration_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "vehicle string, camera_data array<struct<key:string,value:struct<focal:double,cx:double,cy:double,q:array<double>,t:array<double>>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("vehicle", F.explode("camera_data").alias("c")).select("vehicle", F.col("c.key").alias("camera"), "c.value.*")


def src_report_tables(spark: SparkSession, path: str, name: str = "*.html") -> DataFrame:
    """(table, metric, value) of the two-cell rows under each heading."""
    d = _counted(_lines(spark, path, name))  # a report is a page
    d = d.withColumn("h", F.nullif(F.regexp_extract("line", "<h2>(.*?)</h2>", 1), F.lit("")))
    w = Window.partitionBy("scene", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("table", F.last("h", ignorenulls=True).over(w)).withColumn("c", F.regexp_extract_all("line", F.lit("<td>(.*?)</td>"), F.lit(1)))
    return d.where("size(c) = 2").select("scene", "table", F.col("c")[0].alias("metric"), F.col("c")[1].alias("value"))
