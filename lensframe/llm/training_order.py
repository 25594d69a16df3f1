"""Training-order materialisation of token ids.

Documents become sequences of a fixed number of token ids (each text's ids and
an end mark, the last sequence padded with the end mark). Sequences get dense
numbers 0..N-1; a keyed Feistel network over the next even power of two, with
cycle-walking back into [0, N), turns a number into its global slot. One
exchange by slot range writes a file per shard: fixed-stride binary records in
slot order. Slot s is in shard ``s // per_shard`` at byte ``s % per_shard *
stride``, so a reader can start anywhere and resume.

The documents' ids are written to the shared folder first, compressed; a sequence's
number is that of its row's first sequence in that table plus its place in the
row, so re-run tasks number alike. The exchange runs in ``passes`` over ranges of
shards, each taking its shuffle files with it, so that only a part of the ids is
on the shuffle disks at a time.

Cases: a null text counts as empty; an empty text is one sequence holding only
the end mark; a text of any length, also one long run of white space, becomes as
many sequences as it needs; a null doc_id keeps its sequences; repeated rows are
kept; extra columns are ignored; an empty table writes no shard and gives an empty
result.
"""

from __future__ import annotations

import base64
import re
import zlib
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.session import materialise, tidy_shuffles, work_path

from .bpe import PATTERN
from .textio import chunks, lean, ship

LENGTH = 256
PER_SHARD = 1 << 16
KEY = 0x5EED
ROUNDS = 6
PASSES = 5
LEVEL = 3


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the numbers x < n: a permutation of 0..n-1."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 2**63, ROUNDS, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xC2B2AE3D27D4EB4F)
            a, b = b, a ^ (f >> np.uint64(64 - half))
        return a << np.uint64(half) | b

    out = once(np.asarray(x).astype(np.uint64))
    while len(walk := np.flatnonzero(out >= np.uint64(n))):
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def rank_encoder(path: str):
    """Encoder of a rank file; ids below 65,536 fit two bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_LONG_GAP = re.compile(r"\s{20000,}")


def encode(encoder, text: str) -> list[int]:
    """Ids of a text. The encoder's pattern engine gives up on very long runs of
    white space; such a run is one piece of the splitting pattern but for its
    last character, which may begin the next piece, so it is cut out there."""
    out, at = [], 0
    for m in _LONG_GAP.finditer(text) if len(text) > 20000 else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoder.encode_ordinary(text[at : m.start()])
        out += encoder._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def document_ids(documents: DataFrame, ranks_path: str, end: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, part, base, n, ids): the n ids of a text and its end mark as
    compressed little-endian 16-bit integers; base counts the sequences before it
    in the same task's output, which ``part`` names."""
    name = ship(documents.sparkSession, ranks_path)

    def run(batches):
        enc, pack = rank_encoder(SparkFiles.get(name)), zstandard.ZstdCompressor(level=LEVEL)
        part, base = TaskContext.get().partitionId(), 0
        for b in chunks(batches, "text", 1 << 20):
            first, n, data = [], [], []
            for t in b.column("text").to_pylist():
                ids = np.array([*encode(enc, t or ""), end], "<u2")
                first.append(base)
                n.append(len(ids))
                base += -(-len(ids) // length)
                data.append(pack.compress(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
                ["doc_id", "part", "base", "n", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lean(run), "doc_id long, part int, base long, n long, ids binary")


def materialise_order(documents: DataFrame, ranks_path: str, end: int, length: int = LENGTH, per_shard: int = PER_SHARD,
                      key: int = KEY, path: str | None = None, passes: int = PASSES) -> tuple[DataFrame, str]:
    """Write the shards; returns (doc_id, seq, n, slot, shard, byte_offset,
    ids_crc32) of every sequence and the folder of the shards, in which pass k
    writes its shards as the files of folder pass=k."""
    spark = documents.sparkSession
    table = materialise(document_ids(documents, ranks_path, end, length), "order-ids")
    path = path or work_path(spark, "order-shards")
    # A row per task that wrote, so by far fewer than the sequences.
    parts = table.groupBy("part").agg(F.sum(F.ceil(F.col("n") / length)).alias("rows")).orderBy("part").toPandas()
    before = dict(zip(parts["part"].tolist(), (parts["rows"].cumsum() - parts["rows"]).tolist()))
    total = int(parts["rows"].sum())
    shared = spark.sparkContext.broadcast(before)
    stride = 2 * length + 1
    pad = np.full(length, end, "<u2").tobytes()

    def placed(b: pa.RecordBatch):
        """Row, place in the row and slot of every sequence of a batch."""
        rows = -(-b.column("n").to_numpy() // length)
        start = np.array([shared.value[p] for p in b.column("part").to_pylist()], np.int64) + b.column("base").to_numpy()
        row = np.repeat(np.arange(len(rows)), rows)
        seq = np.arange(len(row)) - np.repeat(np.cumsum(rows) - rows, rows)
        return row, seq, feistel(start[row] + seq, total, key)

    def pieces(b: pa.RecordBatch, row: np.ndarray, seq: np.ndarray):
        last, raw = -1, b""
        data, unpack = b.column("ids"), zstandard.ZstdDecompressor()
        for r, k in zip(row.tolist(), seq.tolist()):
            if r != last:
                last, raw = r, unpack.decompress(data[r].as_py())
            yield raw[2 * length * k : 2 * length * (k + 1)]

    def moved(lo: int, hi: int):
        def run(batches):
            pack = zstandard.ZstdCompressor(level=LEVEL)
            for b in batches:
                row, seq, slot = placed(b)
                keep = (slot >= lo * per_shard) & (slot < hi * per_shard)
                row, seq, slot = row[keep], seq[keep], slot[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(slot // per_shard - lo, pa.int32()), pa.array([pack.compress(x) for x in pieces(b, row, seq)], pa.binary())],
                    ["slot", "shard", "ids"])

        return run

    def records(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            raw = [unpack.decompress(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x + pad[len(x) :] for x in raw], pa.binary())], ["record"])

    def digest(batches):
        for b in batches:
            row, seq, slot = placed(b)
            n = np.minimum(length, b.column("n").to_numpy()[row] - seq * length)
            crc = [zlib.crc32(x + pad[len(x) :]) for x in pieces(b, row, seq)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(seq, pa.int32()), pa.array(n, pa.int32()), pa.array(slot), pa.array(crc, pa.int64())],
                ["doc_id", "seq", "n", "slot", "ids_crc32"])

    shards = -(-total // per_shard)
    step = max(1, -(-shards // passes))
    for k, lo in enumerate(range(0, shards, step)):
        hi = min(shards, lo + step)
        one = table.mapInArrow(lean(moved(lo, hi)), "slot long, shard int, ids binary")
        one = one.repartitionById(hi - lo, F.col("shard")).sortWithinPartitions("slot").select("ids")
        # The text sink writes the bytes as they are and one line end per record.
        with tidy_shuffles(spark):
            one.mapInArrow(lean(records), "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/pass={k}")
    out = table.mapInArrow(lean(digest), "doc_id long, seq int, n int, slot long, ids_crc32 long")
    return out.select("doc_id", "seq", "n", "slot", F.floor(F.col("slot") / per_shard).cast("int").alias("shard"),
                      (F.col("slot") % per_shard * stride).alias("byte_offset"), "ids_crc32"), path


def shard_files(spark: SparkSession, path: str) -> list[str]:
    """The file of every shard, in order of the shards: a pass writes one file a
    shard, and no shard is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return []
    passes = sorted(fs.globStatus(hadoop(f"{path}/pass=*")), key=lambda f: int(f.getPath().getName().split("=")[1]))
    return [f.getPath().toString() for p in passes for f in sorted(fs.globStatus(hadoop(f"{p.getPath()}/part-*")), key=lambda f: f.getPath().getName())]


def read_shard(shard: BinaryIO, length: int, start: int = 0, count: int = -1) -> np.ndarray:
    """Records ``start`` onwards of an open shard file, as rows of ids; only the
    bytes asked for are read."""
    stride = 2 * length + 1
    shard.seek(start * stride)
    data = shard.read(count * stride if count >= 0 else -1)
    rows = np.frombuffer(data, np.uint8)[: len(data) // stride * stride].reshape(-1, stride)[:, :-1]
    return np.ascontiguousarray(rows).view("<u2")
