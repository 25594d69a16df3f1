"""Scene tables derived from the generic test tables, and the same in SQL.

Tracks are orders, cameras are suppliers, measurements are line items, edges and
rotations come from customers, metrics from events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "obs": """SELECT l_orderkey AS track_id, l_suppkey AS i, l_partkey AS k,
 CAST(l_partkey % 640 AS DOUBLE) + l_tax AS u, CAST(l_linenumber * 60 AS DOUBLE) + l_discount * 100 AS v,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 100 END AS err, l_extendedprice / 1000 AS depth,
 l_tax * 10 AS conf, l_discount * 10 AS visibility, l_quantity AS response FROM lineitem""",
    "images": """SELECT s_suppkey AS i, s_name AS name, 600 + (s_nationkey % 5) * 100 AS width, 400 + (s_nationkey % 3) * 100 AS height,
 s_nationkey AS scene_id FROM supplier""",
    "edges": """SELECT c_custkey AS i, c_custkey + 1 AS j, CAST(c_acctbal AS DOUBLE) / 10000 AS score FROM customer WHERE c_nationkey % 5 > 0
 UNION ALL SELECT c_custkey AS i, c_custkey + 2 AS j, CAST(c_acctbal AS DOUBLE) / 20000 AS score FROM customer WHERE c_nationkey % 4 > 1""",
    "metrics": """SELECT event_type AS run, CASE WHEN user_id % 2 = 0 THEN 'pose' ELSE 'track' END AS grp,
 CASE WHEN user_id % 3 = 0 THEN 'rotation_error' ELSE 'inlier_ratio' END AS metric, value, event_id AS id, user_id AS worker, ts FROM events""",
    "reports": """SELECT o_custkey AS i, o_custkey + 1 + o_orderkey % 7 AS j, CAST(o_orderkey % 97 AS DOUBLE) / 8 AS rotation_err,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 61 AS DOUBLE) / 4 END AS direction_err,
 CAST(o_orderkey % 43 AS DOUBLE) / 42 AS ratio, o_orderkey % 50 AS n_inliers, o_orderkey AS id FROM orders""",
    "points": """SELECT o_orderkey AS track_id, o_orderkey AS id, CAST(o_custkey % 100 AS DOUBLE) / 10 - 5 AS x, o_totalprice / 50000 - 4 AS y,
 8 + CAST(o_orderkey % 40 AS DOUBLE) / 4 AS z, CAST(o_orderkey % 256 AS INT) AS r, CAST(o_custkey % 256 AS INT) AS g, 7 AS b, o_custkey % 9 AS scene_id,
 CAST(o_orderkey % 100 AS DOUBLE) / 100 AS conf FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scene table by the SQL above, over the one test table that it reads."""
    source = re.search(r"FROM (\w+)", SQL[name])[1]
    return spark.sql(re.sub(rf"FROM {source}\b", "FROM {source}", SQL[name]), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def cameras(spark: SparkSession, sf_dir: str, noise: float = 0.0) -> DataFrame:
    """Pinhole cameras; ``noise`` turns and moves them a little."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    h = (F.col("s_suppkey") * 0.37 + noise * (F.col("s_suppkey") % 5 - 2)) / 2
    q = F.struct(F.cos(h).alias("w"), (F.sin(h) / 3).alias("x"), (F.sin(h) * 2 / 3).alias("y"), (F.sin(h) * 2 / 3).alias("z"))
    t = F.struct((F.col("s_acctbal") / 1000 + noise * (F.col("s_suppkey") % 3)).alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"), (F.col("s_nationkey") / 5).alias("z"))
    f = (800 + F.col("s_suppkey") % 50 + noise * 10).cast("double")
    return s.select(F.col("s_suppkey").alias("i"), q.alias("q"), t.alias("t"), F.lit("PINHOLE").alias("model"),
                    F.array(f, f, F.lit(320.0), F.lit(240.0)).alias("params"), (F.col("s_nationkey") % 3).cast("long").alias("scene_id"),
                    F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("s_name").alias("name"))


#: The cameras in flat SQL columns, exact and with noise 0.02.
for _n, _e in (("cam", 0.0), ("cam2", 0.02)):
    SQL[_n] = f"""SELECT s_suppkey AS i, cos((s_suppkey * 0.37 + {_e} * (s_suppkey % 5 - 2)) / 2) AS qw, sin((s_suppkey * 0.37 + {_e} * (s_suppkey % 5 - 2)) / 2) / 3 AS qx,
 sin((s_suppkey * 0.37 + {_e} * (s_suppkey % 5 - 2)) / 2) * 2 / 3 AS qy, sin((s_suppkey * 0.37 + {_e} * (s_suppkey % 5 - 2)) / 2) * 2 / 3 AS qz,
 s_acctbal / 1000 + {_e} * (s_suppkey % 3) AS tx, CAST(s_suppkey % 7 AS DOUBLE) AS ty, s_nationkey / 5.0 AS tz,
 800 + s_suppkey % 50 + {_e} * 10 AS f, s_nationkey % 3 AS scene_id FROM supplier"""


#: Poses of a scene of many cameras that turn about one axis.
SQL["pose"] = """SELECT c_custkey AS i, cos(c_custkey * 0.37 / 2) AS qw, sin(c_custkey * 0.37 / 2) / 3 AS qx, sin(c_custkey * 0.37 / 2) * 2 / 3 AS qy,
 sin(c_custkey * 0.37 / 2) * 2 / 3 AS qz, CAST(c_acctbal AS DOUBLE) / 1000 AS tx, CAST(c_custkey % 7 AS DOUBLE) AS ty, CAST(c_nationkey AS DOUBLE) / 5 AS tz FROM customer"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, q, t of the poses above."""
    p = view(spark, sf_dir, "pose")
    return p.select("i", F.struct(*(F.col(f"q{c}").cast("double").alias(c) for c in "wxyz")).alias("q"), F.struct(*(F.col(f"t{c}").alias(c) for c in "xyz")).alias("t"))


def sql(text: str) -> str:
    """A query over scene tables as one statement."""
    need, seen = [], set()

    def visit(t: str) -> None:
        for name in SQL:
            if name not in seen and re.search(rf"\b{name}\b", t):
                seen.add(name)
                need.append(name)

    visit(text)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    text = text.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[15:]}" if ctes else text
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}" if ctes else text
    return f"WITH {ctes} {text}" if ctes else text
