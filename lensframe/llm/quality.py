"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. The emission features of a
line describe its own shape and that of its neighbours; a 2x2 transition matrix
couples adjacent lines. Document quality is the length-weighted mean of the
lines' forward-backward marginals, passed through a fitted logistic scale.

The fit's rows are a bounded sample of labelled documents; their line features are
worked out where the rows are, one task fits the model on them, and only the model
reaches the driver.

Cases: a null text counts as empty; an empty text is one empty line (length
weight 1) and gets a score like any other; a text of many lines takes memory in
proportion to it in one task; repeated rows get equal scores; a null doc_id is
never held out, and as it has no label it is not learned from; a doc_id that is
labelled twice counts with the larger label, one that stands on several rows is
learned from once, with the smallest text; extra columns are ignored; an empty
table gives an empty result; without any labelled row the prior 0.5 is returned
for every document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textio import chunks, fresh, lean, texts

#: At most so many labelled rows, the first in a hash order, fit the model.
FIT_ROWS = 4000
THRESHOLD = 0.3

_SPACE, _UPPER, _DIGIT, _PUNCT, _SYMBOL, _BANG, _PIPE, _HIGH = range(8)
_CLASS = np.full(256, 255, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _PUNCT
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = _SYMBOL
_CLASS[ord("!")] = _BANG
_CLASS[ord("|")] = _PIPE
_CLASS[128:] = _HIGH
_PAIRS = [(_CLASS == c).astype(np.int64) + ((_CLASS == c + 1).astype(np.int64) << 32) for c in range(0, 8, 2)]
_GAP = (_CLASS == _SPACE) | (np.arange(256) == 10)
_rng = np.random.default_rng(7)
_TABLE = np.where(_GAP, 0, _rng.integers(1, 2**63, 256, dtype=np.int64)).astype(np.uint64)  # white space adds nothing to a word
_MARKS = ((_CLASS == _UPPER).astype(np.int64)) + (((_CLASS == _SYMBOL) | (_CLASS == _BANG)).astype(np.int64) << 32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values over [starts[i], starts[i+1]); starts ascend strictly."""
    return np.add.reduceat(values, starts)


def own_features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line by itself, byte length of each line, and lines per
    document."""
    blob = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    newline = blob == 10
    ends = np.flatnonzero(newline)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts
    size = np.array([len(d) for d in docs], np.int64)
    doc_end = np.cumsum(size + 1) - 1  # position of each document's last newline
    lines = np.diff(np.concatenate(([0], np.searchsorted(ends, doc_end) + 1)))

    per = np.maximum(length, 1).astype(np.float64)
    share = {}
    for c in range(0, 8, 2):  # two counts in one sum, 32 bits each
        both = _sums(_PAIRS[c // 2][blob], starts)
        share[c], share[c + 1] = (both & 0xFFFFFFFF) / per, (both >> 32) / per

    # Words: runs of other than white space within a line.
    gap = _GAP[blob]
    begins = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if len(begins):
        stops = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
        word_len = stops - begins
        odd = 2 * (np.arange(len(blob), dtype=np.uint64) - np.repeat(
            np.concatenate(([0], begins)), np.diff(np.concatenate(([0], begins, [len(blob)])))).astype(np.uint64)) + np.uint64(1)
        word = _sums(_TABLE[blob] * odd, begins)
        line_of = np.searchsorted(ends, begins)
        n_words = np.bincount(line_of, minlength=len(ends))
        first = np.concatenate(([True], line_of[1:] != line_of[:-1]))
        same = np.concatenate(([False], word[1:] == word[:-1])) & ~first
        repeats = np.bincount(line_of, weights=same, minlength=len(ends))
        two = np.concatenate(([False, False], (word[2:] == word[:-2])))[: len(word)]
        second = np.concatenate(([False], first[:-1]))
        two &= ~first & ~second
        repeats2 = np.bincount(line_of, weights=two, minlength=len(ends))
        chars = np.bincount(line_of, weights=word_len, minlength=len(ends))
        key = (word ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        k = key[order]
        distinct = np.bincount(line_of[order], weights=np.concatenate(([True], k[1:] != k[:-1])), minlength=len(ends))
        line_code = np.bincount(line_of, weights=(word >> np.uint64(40)).astype(np.float64), minlength=len(ends))
        # Words written wholly in capitals or with a symbol glued on.
        marks = _sums(_MARKS[blob], begins)
        caps, glued = marks & 0xFFFFFFFF, marks >> 32
        shouted = np.bincount(line_of, weights=(caps >= 2) & (caps * 2 >= word_len), minlength=len(ends))
        marked = np.bincount(line_of, weights=(glued >= 2), minlength=len(ends))
    else:
        n_words = repeats = repeats2 = chars = distinct = line_code = shouted = marked = np.zeros(len(ends))
    nw = np.maximum(n_words, 1)
    doc_of = np.repeat(np.arange(len(docs)), lines)
    start_of_doc = np.concatenate(([True], doc_of[1:] != doc_of[:-1]))
    same_line = np.concatenate(([False], (line_code[1:] == line_code[:-1]) & (length[1:] == length[:-1])))
    same_line &= ~start_of_doc & (length > 0)
    own = np.stack([
        np.log1p(length) / 5, np.log1p(n_words) / 3, np.minimum(chars / nw, 30) / 10,
        share[_UPPER] * 3, share[_DIGIT] * 3, share[_PUNCT] * 5, share[_SYMBOL] * 5, share[_BANG] * 10,
        share[_PIPE] * 10, share[_HIGH] * 2, distinct / nw, repeats / nw * 2, repeats2 / nw * 2,
        shouted / nw * 2, marked / nw * 2, same_line.astype(float), (length == 0).astype(float),
        (n_words <= 2).astype(float), (blob[np.maximum(ends - 1, 0)] == 46).astype(float),
    ], axis=1)
    return own, np.maximum(length, 1), lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, and constants."""
    start_of_doc = np.zeros(len(own), bool)
    start_of_doc[np.cumsum(lines) - lines] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[start_of_doc] = 0
    after[:-1] = own[1:]
    after[np.concatenate((start_of_doc[1:], [True]))] = 0
    return np.concatenate([own, before / 2, after / 2, np.ones((len(own), 1)), start_of_doc[:, None].astype(float)], axis=1)


def line_features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, byte length of each line, and lines per document."""
    own, length, lines = own_features(docs)
    return with_neighbours(own, lines), length, lines


def marginals(emit: np.ndarray, lines: np.ndarray, trans: np.ndarray, want_pairs: bool = False):
    """Probability of label 1 for each line, by scaled forward-backward.

    ``emit`` is the score of label 1 over label 0 per line, ``lines`` the chain
    lengths. All chains advance together, longest first."""
    offset = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    ln, off = lines[order], offset[order]
    n, top = len(lines), int(lines.max()) if len(lines) else 0
    active = np.searchsorted(-ln, -np.arange(1, top + 1), "right")  # chains with at least t+1 lines
    e = np.empty((len(emit), 2))
    e[:, 0], e[:, 1] = 1 / (1 + np.exp(np.clip(emit, -30, 30))), 1 / (1 + np.exp(-np.clip(emit, -30, 30)))
    t = np.exp(trans)
    alpha, scale = np.empty_like(e), np.empty(len(emit))
    prev = None
    for k in range(top):
        m = active[k]
        at = off[:m] + k
        a = e[at] if k == 0 else (prev[:m] @ t) * e[at]
        s = a.sum(1)
        prev = a / s[:, None]
        alpha[at], scale[at] = prev, s
    beta = np.ones_like(e)
    pair = np.zeros((2, 2))
    for k in range(top - 2, -1, -1):
        m = active[k + 1]
        at = off[:m] + k
        nxt = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = nxt @ t.T
        if want_pairs:
            pair += (alpha[at].T @ nxt) * t
    p = alpha * beta
    p = p[:, 1] / p.sum(1)
    return (p, pair) if want_pairs else p


def document_scores(docs: list[bytes], model: dict) -> np.ndarray:
    x, length, lines = line_features(docs)
    p = marginals(x @ model["w"], lines, model["t"])
    start = np.cumsum(lines) - lines
    mean = _sums(p * length, start) / _sums(length.astype(float), start)
    return _scaled(mean, model["scale"])


def _scaled(mean: np.ndarray, scale) -> np.ndarray:
    z = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1 - 1e-6))
    return 1 / (1 + np.exp(-(scale[0] * z + scale[1])))


def fit(x: np.ndarray, length: np.ndarray, lines: np.ndarray, labels: list[int], rounds: int = 150, l2: float = 1e-3) -> dict | None:
    """Maximum conditional likelihood by Adam; a line's label is its document's."""
    if not len(lines):
        return None
    y = np.asarray(labels, float)
    yl = np.repeat(y, lines)
    start = np.cumsum(lines) - lines
    weight = np.repeat(1 / lines, lines)  # every document counts alike
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = lines - 1
    seen = np.array([[np.sum(inner[y == 0]), 0], [0, np.sum(inner[y == 1])]], float)
    m = v = np.zeros(len(w) + 4)
    for i in range(1, rounds + 1):
        p, pair = marginals(x @ w, lines, t, want_pairs=True)
        gw = x.T @ ((yl - p) * weight) / len(lines) - l2 * w
        gt = (seen - pair) / max(1, inner.sum()) * 0.3 - l2 * t
        g = np.concatenate((gw, gt.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
        t = np.clip(t, -4, 4)
    p = marginals(x @ w, lines, t)
    mean = _sums(p * length, start) / _sums(length.astype(float), start)
    z = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1 - 1e-6))
    a, b = 1.0, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a += 0.1 * (np.mean((y - q) * z) - 1e-3 * (a - 1))
        b += 0.1 * np.mean(y - q)
    return {"w": w, "t": t, "scale": (max(a, 0.05), b)}


def labelled(documents: DataFrame, labels: DataFrame, label: str, keep, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, the first in a
    hash order of the id."""
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y")).where(keep).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(bound)
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(lab), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int) -> dict | None:
    """The model, from a bounded sample of labelled rows outside the held-out part."""

    def run(batches):
        for b in chunks(batches, "text", 1 << 20):
            own, length, lines = own_features(texts(b, "text"))
            cut = np.cumsum(lines) - lines
            each = lambda v: [x.astype(np.float32).tobytes() for x in np.split(v, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(each(own), pa.binary()), pa.array(each(length), pa.binary())], ["doc_id", "y", "own", "length"])

    def model(t: pa.Table) -> dict | None:
        length = [np.frombuffer(x.as_buffer(), np.float32) for x in t.column("length")]
        lines = np.array([len(x) for x in length])
        own = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in t.column("own")]).reshape(int(lines.sum()), -1)
        return fit(with_neighbours(own, lines), np.concatenate(length), lines, t.column("y").to_pylist())

    rows = labelled(documents, labels, "quality", ~held_out(5, 0), fit_rows)
    return fitted(rows.mapInArrow(lean(run), "doc_id long, y int, own binary, length binary"), model)


def fitted(rows: DataFrame, model: Callable[[pa.Table], dict | None]) -> dict | None:
    """The model of the rows, fitted by one task; their number is bounded. The rows
    are put in order first, so a task that runs again gives the same model."""

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model(t.sort_by("doc_id")))], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(lean(lambda b: run(b) if (b := list(b)) else iter(())), "model binary").toArrow()
    return pickle.loads(got.column("model")[0].as_py()) if got.num_rows else None


def score(documents: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """The columns of ``documents`` and the score of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop(name)

    def run(batches):
        for b in chunks(batches, "text", 1 << 20):
            m = shared.value
            s = np.full(b.num_rows, 0.5) if m is None else document_scores(texts(b, "text"), m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, name])

    return documents.mapInArrow(lean(run), T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(modulus: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest, F.lit(False))


def keep_good(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, columns as they are."""
    (s,) = fresh(documents, "_score")
    return score(documents, learn(documents, labels, fit_rows), s).where(F.col(s) >= THRESHOLD).drop(s)


def quality_scores(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), learn(documents, labels, fit_rows))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
