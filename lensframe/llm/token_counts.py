"""Token counts: delta-maintained rollups.

Totals by source, language and tokenizer version are never recounted. A batch of
signed changes (insert +1, delete -1, revised count: -1 with the old and +1 with
the new figure) is summed per group and appended as one folder of the delta
store; the totals are the sum of all committed batches. A batch's sums are written
to a folder of their own; then a small marker file, which can be created only once,
names that folder: this commits the batch. A batch that is sent again, by another
writer at the same time, or whose job was lost half-way, changes nothing twice.
``compact`` sums the batches committed so far into a snapshot, so that reading the
totals costs the snapshot and the batches after it, not all batches ever sent.

Cases: a null source or lang is a group of its own; a null text counts as empty; a
text of any length is counted whole; any batch id is allowed (it is escaped in the
file name), but not an empty one; an empty batch commits no rows; changes that
cancel leave totals of zero, kept so that a reader sees the group has gone;
repeated rows count each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textio import chunks, lean, ship
from .training_order import encode, rank_encoder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, bytes long"


class RollupStore:
    """Signed group sums: data/<folder> with the sums of a batch or a snapshot,
    batches/<id> a marker that names a batch's folder, snapshots/<number> a marker
    that names a snapshot's folder and the batches it holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if not f.getPath().getName().startswith(".")) if fs.exists(p) else []

    def _read(self, name: str) -> list[str]:
        fs, p = self._at(f"{self.path}/{name}")
        f = fs.open(p)
        try:
            return bytes(f.readAllBytes()).decode().split("\n")
        finally:
            f.close()

    def _mark(self, name: str, lines: list[str]) -> bool:
        """Put the marker in place, whole; False if one is there already."""
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        fs, p = self._at(draft)
        f = fs.create(p, False)
        f.write(bytearray("\n".join(lines).encode()))
        f.close()
        target = self._at(f"{self.path}/{name}")[1]
        fs.mkdirs(target.getParent())
        spark = self.spark
        files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
        plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(p, target, plain)  # refuses a target that exists
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(p, False)
            return False

    def _write(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/data/{name}")
        return name

    def committed(self, batch: str) -> bool:
        fs, p = self._at(f"{self.path}/batches/{_file(batch)}")
        return fs.exists(p)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes (KEYS, sign, tokens, bytes) unless ``batch`` already is."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("sign") * F.col("bytes")).alias("bytes"))
        folder = self._write(sums)
        if self._mark(f"batches/{_file(batch)}", [folder]):
            return True
        fs, p = self._at(f"{self.path}/data/{folder}")  # another writer was first
        fs.delete(p, True)
        return False

    def _live(self) -> tuple[list[str], list[str]]:
        """Folders that make up the totals, and the batches they hold."""
        snapshots = self._names("snapshots")
        held = self._read(f"snapshots/{snapshots[-1]}") if snapshots else []
        new = sorted(set(self._names("batches")) - set(held[1:]))
        return held[:1] + [self._read(f"batches/{b}")[0] for b in new], held[1:] + new

    def totals(self) -> DataFrame:
        return self._sum(self._live()[0])

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{f}" for f in folders))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("documents", "tokens", "bytes")))

    def compact(self) -> bool:
        """Sum all batches committed so far into a new snapshot."""
        folders, batches = self._live()
        if len(folders) < 2:
            return False
        number = len(self._names("snapshots")) + 1
        return self._mark(f"snapshots/{number:09d}", [self._write(self._sum(folders)), *batches])


def _file(batch: str) -> str:
    if not batch:
        raise ValueError("a batch needs an id")
    return "b-" + quote(batch, safe="")


def counted(documents: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, source, lang, n_bpe, n_words, bytes of every document."""
    name = ship(documents.sparkSession, ranks_path)

    def run(batches):
        enc = rank_encoder(SparkFiles.get(name))
        for b in chunks(batches, "text", 1 << 20):
            t = [x or "" for x in b.column("text").to_pylist()]
            raw = [x.encode() for x in t]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([len(encode(enc, x)) for x in t], pa.int64()),
                 pa.array([len(x.split()) for x in raw], pa.int64()), pa.array(list(map(len, raw)), pa.int64())],
                ["doc_id", "source", "lang", "n_bpe", "n_words", "bytes"])

    return documents.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang", "text"))).mapInArrow(
        lean(run), "doc_id long, source string, lang string, n_bpe long, n_words long, bytes long")


def changes(counts: DataFrame, tokenizer: str, column: str, sign: int) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("sign"),
                         F.col(column).alias("tokens"), "bytes")
