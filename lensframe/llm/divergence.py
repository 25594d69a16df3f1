"""Source divergence audit with in-mapper stripes.

A task folds whole documents into one hash table of stripes, term -> (document
frequency, count per source), for each language. When the table has reached its
bound its stripes are spilled: written out as rows to the shuffle, which sorts
them by (lang, term); a reading task merges the stripes of a term one by one as they
pass and keeps those with enough documents. What is gathered in memory is bounded
by the table's bound in the first step and by one stripe in the second.

The merged stripes then emit the divergences: of every term each source's smoothed
share per thousand million p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), the
distance |p - q| of every two sources of the language, which a task adds up before
it passes them on, and p - q against the whole language where that is positive.
All arithmetic is on whole numbers. The shares need V and N, a few numbers per
(lang, source); they are sent to tasks in slabs of about 1024 groups, every two slabs
meeting once, so what is sent is bounded however many sources there are.

Terms are runs of ASCII letters and characters from U+0080 on; only A-Z are
lower-cased. Long texts are split in pieces at separators.

Cases: null text, lang and source are ''; a group whose documents have no terms
takes part with counts of 0; a lang without kept terms has pairs of value 0; a
lang of one source has no pairs; repeated rows count as often as they occur; ties go
to the smaller item in UTF-8; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensframe.session import discard, materialise

from .textio import chunks, lean, texts

LEAST_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 10**9
TOP_TERMS = 50
#: Entries of a task's table of stripes before it spills.
TABLE_ENTRIES = 800_000
SLAB = 1024
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def terms_of(text: bytes, piece: int = 1 << 20):
    """Lists of the terms of a text, piece by piece."""
    t, i = text.translate(_LETTERS), 0
    while i < len(t):
        j = t.find(b" ", i + piece)
        j = len(t) if j < 0 else j
        yield t[i:j].split()
        i = j


class StripeTable:
    """term -> (document frequency, count per source) of each language, stored by
    source so that a document is folded in by whole lists."""

    def __init__(self, limit: int = TABLE_ENTRIES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.df, self.tf, self.entries = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), 0

    def add(self, text: bytes, lang: str, source: str) -> bool:
        """Folds a document in; whether the table is full now."""
        df, tf, seen = self.df[lang], self.tf[lang][source], set()
        before = len(df) + len(tf)
        for words in terms_of(text):
            tf.update(words)
            seen.update(words)
        df.update(seen)
        self.entries += len(df) + len(tf) - before
        if seen and max(map(len, seen)) > 256:  # very long terms count for what they hold
            self.entries += sum(len(w) for w in seen if len(w) > 256) // 64
        return self.entries >= self.limit

    def stripes(self, rows: int = 4096):
        """The table as rows of stripes; it is empty afterwards."""
        for lang, df in self.df.items():
            at = dict(zip(df, range(len(df))))
            tf = self.tf[lang]
            row = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for c in tf.values()])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in tf.values()])
            order = np.argsort(row, kind="stable")
            source = pa.array(list(tf), pa.string()).take(pa.array(np.repeat(np.arange(len(tf)), [len(c) for c in tf.values()])[order]))
            count, end = pa.array(count[order]), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(df)))))
            terms, dfs = pa.array(list(df), pa.binary()).cast(pa.string()), pa.array(np.fromiter(df.values(), np.int64, len(df)))
            for i in range(0, len(df), rows):
                e = end[i : i + rows + 1]
                offsets, inner = pa.array(e - e[0], pa.int32()), (int(e[0]), int(e[-1] - e[0]))
                n = len(e) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), terms.slice(i, n), dfs.slice(i, n), pa.ListArray.from_arrays(offsets, source.slice(*inner)),
                    pa.ListArray.from_arrays(offsets, count.slice(*inner))], ["lang", "term", "df", "sources", "counts"])
        self.clear()


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _worth_merging(b: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """A sorted batch without the terms that end in it with too few documents; the first
    and the last term may go on in other batches and stay."""
    if b.num_rows < 3:
        return b
    ne = pa.compute.not_equal
    change = pa.compute.or_(*(ne(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)) for c in ("lang", "term")))
    start = np.flatnonzero(np.concatenate(([True], change.to_numpy(zero_copy_only=False))))
    keep = np.add.reduceat(b.column("df").to_numpy(), start) >= least
    keep[[0, -1]] = True
    return b.filter(pa.array(np.repeat(keep, np.diff(np.append(start, b.num_rows)))))


def stripes(documents: DataFrame, least: int = LEAST_DOCUMENTS, limit: int = TABLE_ENTRIES) -> DataFrame:
    """lang, term, df, sources, counts of the terms in at least ``least`` documents."""

    def fold(batches):
        table = StripeTable(limit)
        for b in chunks(batches, "text"):
            for text, lang, source in zip(texts(b, "text"), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                if table.add(text, lang, source):
                    yield from table.stripes()
        yield from table.stripes()

    def merge(batches):
        key, df, of = None, 0, Counter()
        out = []

        def flush():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))],
                                              ["lang", "term", "df", "sources", "counts"])

        def close():
            if key is not None and df >= least:
                out.append((*key, df, list(of), list(of.values())))

        for b in batches:
            b = _worth_merging(b, least)
            lang, term, n = (b.column(c).to_pylist() for c in ("lang", "term", "df"))
            sources, counts = b.column("sources"), b.column("counts")
            names, values = sources.flatten().to_pylist(), counts.flatten().to_pylist()
            ends = np.cumsum(pa.compute.list_value_length(counts).to_numpy(zero_copy_only=False)).tolist()
            i = 0
            for lg, t, d, e in zip(lang, term, n, ends):
                if (lg, t) != key:
                    close()
                    key, df, of = (lg, t), 0, Counter()
                    if len(out) >= 1024:
                        yield flush()
                df += d
                for s, c in zip(names[i:e], values[i:e]):
                    of[s] += c
                i = e
        close()
        if out:
            yield flush()

    folded = _documents(documents).mapInArrow(lean(fold), _STRIPE)
    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lean(merge), _STRIPE)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / total), exact."""
    if counts.size and int(counts.max()) >= (1 << 63) // UNIT - SMOOTHING:
        return (1 + UNIT * (counts.astype(object) + SMOOTHING) // total.astype(object)).astype(np.int64)
    return 1 + UNIT * (counts + SMOOTHING) // total


def _emitted(kept: DataFrame, left: list, right: list, same: bool) -> DataFrame:
    """part, lang, source, item, value: partial sums of the distances between sources of
    ``left`` and ``right``, and (where both are the ``same``) each source's own terms."""
    shared = kept.sparkSession.sparkContext.broadcast((left, right))

    def emit(batches):
        sides = []
        for rows in shared.value:
            by = defaultdict(list)
            for r in rows:
                by[r[0]].append(r[1:])
            sides.append(by)
        sums, langs = {}, [x for x in sides[0] if x in sides[1]]
        place = [{x: {r[0]: i for i, r in enumerate(by[x])} for x in langs} for by in sides]
        total = [{x: np.array([r[1] + SMOOTHING * r[2] for r in by[x]], np.int64) for x in langs} for by in sides]
        for b in batches:
            for row0 in range(0, b.num_rows, 256):
                part = b.slice(row0, 256).to_pylist()
                for lang in {r["lang"] for r in part}.intersection(langs):
                    rows = [r for r in part if r["lang"] == lang]
                    p = []
                    for k in (0, 1):
                        c = np.zeros((len(rows), len(total[k][lang])), np.int64)
                        for i, r in enumerate(rows):
                            for s, n in zip(r["sources"], r["counts"]):
                                j = place[k][lang].get(s)
                                if j is not None:
                                    c[i, j] = n
                        p.append((c, shares(c, total[k][lang])))
                    d = sums.setdefault(lang, np.zeros((p[0][0].shape[1], p[1][0].shape[1]), np.int64))
                    for a in range(d.shape[0]):
                        d[a] += np.abs(p[0][1][:, a, None] - p[1][1]).sum(0)
                    if same:
                        whole = np.array([sum(r["counts"]) for r in rows], np.int64)
                        _, _, v, n = sides[0][lang][0]
                        more = p[0][1] - shares(whole, np.full(len(rows), n + SMOOTHING * v, np.int64))[:, None]
                        i, j = np.nonzero((p[0][0] > 0) & (more > 0))
                        names = [s[0] for s in sides[0][lang]]
                        yield _rows_of("term", lang, [names[x] for x in j], [rows[x]["term"] for x in i], more[i, j])
        for lang, d in sums.items():
            a, b = ([r[0] for r in by[lang]] for by in sides)
            for i, x in enumerate(a):
                at = [j for j in range(len(b)) if not same or b[j] > x]
                yield _rows_of("pair", lang, [x] * len(at), [b[j] for j in at], d[i, at])

    return kept.mapInArrow(lean(emit), "part string, lang string, source string, item string, value long")


def _rows_of(part, lang, source, item, value) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()),
                                       pa.array(value, pa.int64())], ["part", "lang", "source", "item", "value"])


def divergences(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, limit: int = TABLE_ENTRIES, slab: int = SLAB) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = materialise(stripes(documents, least, limit), "divergence-stripes")
    entry = F.explode(F.arrays_zip("sources", "counts")).alias("e")
    counted = kept.select("lang", entry).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_lang"))
    groups = _documents(documents).select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_lang")))
    groups = materialise(groups, "divergence-groups")
    slabs = max(1, -(-groups.count() // slab))
    groups = groups.withColumn("slab", F.pmod(F.xxhash64("lang", "source"), F.lit(slabs)))
    parts = None
    for i in range(slabs):
        left = [tuple(r) for r in groups.where((F.col("slab") == i) & (F.col("v") > 0)).drop("slab").collect()]
        for j in range(i, slabs):
            right = left if i == j else [tuple(r) for r in groups.where((F.col("slab") == j) & (F.col("v") > 0)).drop("slab").collect()]
            part = materialise(_emitted(kept, left, right, i == j), "divergence-parts")
            parts = part if parts is None else parts.unionByName(part)
    discard(kept)
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value").select("lang", "s.*", "value")
    mine = groups.select("lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"))
    pairs = mine.join(groups.select("lang", F.col("source").alias("item"), "slab"), ["lang", "slab"]).where("source <> item").drop("slab")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(terms)
