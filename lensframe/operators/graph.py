"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.session import discard, materialise, task_count


def connected_components(
    edges: DataFrame, u: str = "i", v: str = "j", nodes: DataFrame | None = None,
    max_rounds: int = 200,
) -> DataFrame:
    """``node, component`` where component is the smallest node reachable.

    Alternating large-star / small-star contraction: each round is two
    min-aggregations (combined map-side) and two equi joins, so a hub node is
    never gathered in one place, and the number of rounds grows with the log of
    the diameter. Every round is written to the shared folder; the rounds end when only
    stars are left. Joins are merge joins, so no round's table goes through the driver,
    however small it has become. Edges holding a null are ignored; self loops only name their node. ``nodes`` (first column)
    adds isolated nodes. An empty table gives an empty result.
    """
    e0 = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    all_nodes = e0.select(F.col("a").alias("node")).union(e0.select(F.col("b").alias("node")))
    if nodes is not None:
        all_nodes = all_nodes.union(nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null"))
    cur = materialise(
        e0.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        if _only_stars(cur):
            break
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a")
        nxt = materialise(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return (
        all_nodes.distinct().join(cur.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether every a has one edge and is no other edge's b: with b < a, each b is
    then the smallest node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return each.where("out > 1 or (out > 0 and into > 0)").agg(F.count("*")).first()[0] == 0


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbours (sorted, distinct), degree."""
    both = edges.select("i", "j").union(edges.select("j", "i")).distinct()
    return both.groupBy(F.col("i").alias("node")).agg(F.sort_array(F.collect_set("j")).alias("neighbours"), F.countDistinct("j").alias("degree"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes; ties to the smallest node."""
    cc = materialise(connected_components(edges), "lcc")
    best = cc.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return cc.join(F.broadcast(best.select("component")), "component", "left_semi").select("node")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, smaller end first."""
    n = nodes.select(F.col(nodes.columns[0]).alias("n")).distinct()
    out = edges.join(n, F.col("i") == F.col("n"), "left_semi").join(n, F.col("j") == F.col("n"), "left_semi")
    return out.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})


def prune_to_lcc(edges: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Edges within the largest component; prior edges connect too."""
    all_edges = edges.select("i", "j")
    if priors is not None:
        all_edges = all_edges.union(priors.select("i", "j"))
    return induced_edges(edges, largest_component(all_edges))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, of all 3-cycles. Edges point from the end of lower
    degree to the other, so a hub has few edges going out and the two-edge paths
    that the join makes stay near the bound of |E|^1.5."""
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    deg = e.select("i").union(e.select("j")).groupBy("i").agg(F.count("*").alias("d"))
    e = e.join(deg, "i").withColumnRenamed("d", "di").join(deg.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    up = F.struct("di", "i") < F.struct(F.col("dj").alias("di"), F.col("j").alias("i"))
    d = e.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("s"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("t"))
    paths = d.alias("p").join(d.select("s", F.col("t").alias("u")).alias("q"), "s").where("t < u")
    close = d.select(F.least("s", "t").alias("t"), F.greatest("s", "t").alias("u"))
    tri = paths.join(close, ["t", "u"])
    s = F.sort_array(F.array("s", "t", "u"))
    return tri.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def rotation_cycle_error(tri: DataFrame, rotations: DataFrame) -> DataFrame:
    """Angle of R(a<-c) R(c<-b) R(b<-a) per triangle; rotation q of (i, j) takes i to j."""
    from lensframe.functions import geometry as g

    def one(x, y, name):
        return rotations.select(F.col("i").alias(x), F.col("j").alias(y), F.col("q").alias(name))

    t = tri.join(one("a", "b", "qab"), ["a", "b"]).join(one("b", "c", "qbc"), ["b", "c"]).join(one("a", "c", "qac"), ["a", "c"])
    # The loop of three rotations against no rotation at all.
    err = g.rotation_angle(F.col("qac"), g.multiply(F.col("qbc"), F.col("qab")))
    return t.withColumn("err", err).select("a", "b", "c", "err")


def cycle_filter(edges: DataFrame, rotations: DataFrame, limit: float = 7.0, how: str = "median") -> DataFrame:
    """Edges whose aggregated cycle error is below the limit, and those that are
    in no triangle."""
    tri = rotation_cycle_error(triangles(edges), rotations)
    each = tri.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("c").alias("j")),
                                        F.struct(F.col("a").alias("i"), F.col("c").alias("j")))).alias("e"), "err").select("e.*", "err")
    a = F.min("err") if how == "min" else F.percentile("err", F.lit(0.5))
    agg = each.groupBy("i", "j").agg(a.alias("cycle_err"))
    return edges.join(agg, ["i", "j"], "left").where(F.col("cycle_err").isNull() | (F.col("cycle_err") < limit))


def bridge_reconnect(edges: DataFrame, scores: DataFrame, k: int = 10, least: int = 3, min_score: float = 0.0) -> DataFrame:
    """New edges that tie islands of at least ``least`` nodes to the largest
    component: per island its k best cross scores. The k are taken before edges
    that exist already are removed."""
    from lensframe.operators.pairs import bridge_topk

    cc = materialise(connected_components(edges), "bridge-cc")
    size = cc.groupBy("component").agg(F.count("*").alias("n"))
    main = size.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("main"))
    label = cc.join(size, "component").crossJoin(F.broadcast(main))  # one row
    a = label.select(F.col("node").alias("i"), F.col("component").alias("ci"), F.col("n").alias("ni"), "main")
    b = label.select(F.col("node").alias("j"), F.col("component").alias("cj"), F.col("n").alias("nj"))
    s = scores.where(F.col("score") >= min_score).join(a, "i").join(b, "j")
    s = s.where((F.col("ci") != F.col("cj")) & ((F.col("ci") == F.col("main")) | (F.col("cj") == F.col("main"))))
    s = s.withColumns({"island": F.when(F.col("ci") == F.col("main"), F.col("cj")).otherwise(F.col("ci")),
                       "size": F.when(F.col("ci") == F.col("main"), F.col("nj")).otherwise(F.col("ni"))}).where(F.col("size") >= least)
    return bridge_topk(s.select("i", "j", "score", "island"), "island", k).join(edges.select("i", "j"), ["i", "j"], "left_anti")


#: Measurements, and camera pairs, that a task of ``covis_edges`` takes.
TASK_ROWS, TASK_PAIRS = 400_000, 1_000_000


def covis_edges(observations: DataFrame) -> DataFrame:
    """Camera pairs that share tracks, and how many. Tracks are short (a track
    sees each camera at most once), which bounds the pairs of a track. Tasks grow in
    number with the measurements and the pairs, not in size."""
    spark = observations.sparkSession
    n = observations.groupBy("track_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.expr("n * (n - 1) div 2"))).first()
    o = observations.select("track_id", "i").repartition(task_count(spark, n[0] or 0, TASK_ROWS), "track_id").distinct()
    p = o.hint("merge").join(o.select("track_id", F.col("i").alias("j")), "track_id").where("i < j").select("i", "j")
    return p.repartition(task_count(spark, n[1] or 0, TASK_PAIRS), "i", "j").groupBy("i", "j").agg(F.count("*").alias("shared"))


def scene_lcc(observations: DataFrame) -> DataFrame:
    """The scene cut to the largest component of its covisibility graph. Cameras of a
    track are connected however they pair, so each is tied to the track's first one:
    as many edges as measurements, and a camera that shares no track is a component."""
    from lensframe.operators.tables import selected_cameras_tracks

    tasks = task_count(observations.sparkSession, observations.count(), TASK_ROWS)
    o = observations.where("track_id is not null and i is not null").select("track_id", "i").repartition(tasks, "track_id")
    star = o.join(o.groupBy("track_id").agg(F.min("i").alias("j")).hint("merge"), "track_id").select("i", "j").repartition(tasks, "i", "j").distinct()
    keep = largest_component(star).withColumnRenamed("node", "i")
    return selected_cameras_tracks(observations, keep, tasks)


def cross_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between every two clusters."""
    c = clusters.select("i", "cluster")
    e = edges.join(c.withColumnRenamed("cluster", "a"), "i").join(c.select(F.col("i").alias("j"), F.col("cluster").alias("b")), "j").where("a <> b")
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def overlap_path(edges: DataFrame, source: int, targets: DataFrame, inside: DataFrame) -> DataFrame:
    """Cheapest distance from a node to the targets: fewest nodes outside
    ``inside`` first, then fewest hops; a relaxation round per hop, until no
    distance falls (each falls finitely often, so this ends)."""
    both = edges.select("i", "j").union(edges.select("j", "i")).distinct()
    cost = both.join(inside.select(F.col(inside.columns[0]).alias("j"), F.lit(0).alias("o")), "j", "left").select("i", "j", F.coalesce("o", F.lit(1)).alias("o"))
    cost = materialise(cost, "path-cost")
    spark = edges.sparkSession
    best = spark.createDataFrame([(source, 0, 0)], "node long, outside int, hops int")
    front = best
    while True:
        step = front.join(cost, F.col("node") == F.col("i")).groupBy(F.col("j").alias("node")).agg(
            F.min(F.struct((F.col("outside") + F.col("o")).alias("outside"), (F.col("hops") + 1).alias("hops"))).alias("c")).select("node", "c.*")
        nxt = best.unionByName(step).groupBy("node").agg(F.min(F.struct("outside", "hops")).alias("c")).select("node", "c.*")
        nxt = materialise(nxt, "path")
        front = nxt.join(best, ["node", "outside", "hops"], "left_anti")
        best = nxt
        if front.isEmpty():
            break
    return best.join(targets.select(F.col(targets.columns[0]).alias("node")).distinct(), "node", "left_semi")
