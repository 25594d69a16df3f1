"""Two streaming jobs: live result counts, and frame pairs as frames arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def stream_worker_throughput(log: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Results per worker and window; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return log.withWatermark("ts", late).groupBy(w.alias("w"), "worker").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "worker", "n")


class _Lookahead(StatefulProcessor):
    """State per sequence: the frames within ``lookahead`` of the newest one."""

    def __init__(self, lookahead: int):
        self.lookahead = lookahead

    def init(self, handle):
        self.frames = handle.getListState("frames", "i long")

    def handleInputRows(self, key, rows, timerValues):
        old = [r[0] for r in self.frames.get()] if self.frames.exists() else []
        new = sorted({int(i) for p in rows for i in p["i"]} - set(old))
        out = []
        for i in new:
            out += [(min(i, o), max(i, o)) for o in old if abs(i - o) <= self.lookahead]
            old.append(i)
        top = max(old)
        self.frames.put([(i,) for i in sorted(old) if top - i <= 2 * self.lookahead])
        yield pd.DataFrame({"sequence": [key[0]] * len(out), "i": [a for a, _ in out], "j": [b for _, b in out]})

    def close(self):
        pass


def stream_sequential_pairs(frames: DataFrame, lookahead: int) -> DataFrame:
    """(sequence, i) frames -> (sequence, i, j) pairs within ``lookahead``, each
    as soon as its second frame is there. A frame that comes more than twice the
    lookahead behind the newest one of its sequence meets no frame any more."""
    return frames.groupBy("sequence").transformWithStateInPandas(
        _Lookahead(lookahead), outputStructType="sequence long, i long, j long", outputMode="Append", timeMode="None")
