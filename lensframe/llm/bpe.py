"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The frequent words of the corpus are compiled into a minimal acyclic automaton
(equal suffixes share states). Every arc carries the number of accepted words
that sort before it, so the sum along a path is the word's rank and the rank
picks its token ids: the automaton maps a word to its ids. The file is written
to the shared folder, shipped by Spark and memory-mapped by every worker. Words
it does not hold are merged exactly, pair by pair, in rank order.

Cases: a null text counts as empty and gives no ids; the text of a special
token inside a document is that token, as in the tokenizers library; any
Unicode text, however long, round-trips; repeated rows give equal rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from lensframe.session import discard, materialise, work_path

from .textio import chunks, lean, ship

#: Frequent words compiled into the automaton, and the longest such word.
LEXICON_WORDS = 150_000
LONGEST = 40
#: The splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.pairs: dict[int, int] = {}  # two ids -> rank of their merge
        self.merged: list[int] = []  # rank -> id of the joined pair
        for m in spec["model"]["merges"]:
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.pairs.setdefault(self.ids[a] << 20 | self.ids[b], len(self.merged))
            self.merged.append(self.ids[a + b])
        self.single = [self.ids[bytes([i])] for i in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank, leftmost first, is
        joined until none is left. Short words scan; long words keep a heap."""
        part = [self.single[c] for c in word]
        if len(part) > 48:
            return self._merge_long(part)
        get, none = self.pairs.get, 1 << 40
        rank = [get(a << 20 | b, none) for a, b in zip(part, part[1:])]
        while rank and (low := min(rank)) < none:
            i = rank.index(low)
            part[i : i + 2] = [self.merged[low]]
            del rank[i]
            if i:
                rank[i - 1] = get(part[i - 1] << 20 | part[i], none)
            if i < len(rank):
                rank[i] = get(part[i] << 20 | part[i + 1], none)
        return part

    def _merge_long(self, part: list[int]) -> list[int]:
        get, n = self.pairs.get, len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = self.merged[r], -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := get(part[i] << 20 | part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := prv[i]) >= 0 and (r := get(part[h] << 20 | part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [x for x in part if x >= 0]


_SPLIT = regex.compile(PATTERN)


@functools.cache
def _unknown_letters() -> tuple[frozenset[str], dict[int, str]]:
    """Letters and digits of newer Unicode tables than the tokenizers library
    has (it joins them to a run of symbols, the pattern engine would not), and
    their replacement by a character that no version has assigned."""
    later = "".join(c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn")
    new = regex.findall(r"[\p{L}\p{N}]", later)
    starts = {a for _, (a, _) in ByteLevel(add_prefix_space=False).pre_tokenize_str("!" + "!".join(new) + "!")}
    found = frozenset(c for i, c in enumerate(new) if 2 * i + 1 not in starts)
    return found, str.maketrans(dict.fromkeys(found, chr(0x378)))


#: The same pattern with the classes written out for characters below U+0250,
#: which the faster engine of the standard library then matches alike.
_LATIN_L, _LATIN_N, _LATIN_S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_SPLIT_LATIN = re.compile(
    f"'[stmd]|'re|'ve|'ll| ?[{_LATIN_L}]+| ?[{_LATIN_N}]+| ?[^{_LATIN_S}{_LATIN_L}{_LATIN_N}]+"
    f"|[{_LATIN_S}]+(?![^{_LATIN_S}])|[{_LATIN_S}]+")
_PAST_LATIN = re.compile("[\u0250-\U0010ffff]")


def split_words(text: str) -> list[str]:
    """The words that are merged apart from each other."""
    if text.isascii() or not _PAST_LATIN.search(text):
        return _SPLIT_LATIN.findall(text)
    unknown, replaced = _unknown_letters()
    if not unknown.isdisjoint(text):
        return [text[m.start() : m.end()] for m in _SPLIT.finditer(text.translate(replaced))]
    return _SPLIT.findall(text)


def pieces(text: str, vocabulary: Vocabulary) -> list[str | int]:
    """Words in order; special tokens as their ids."""
    s = vocabulary.split_special
    if s is None or not s.search(text):
        return split_words(text)
    out: list[str | int] = []
    at = 0
    for m in s.finditer(text):
        out += split_words(text[at : m.start()])
        out.append(vocabulary.special[m.group()])
        at = m.end()
    return out + split_words(text[at:])


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct words, as sorted arcs.

    Words are added in order; once no later word can reach a state, it is
    replaced by an equal registered one (incremental minimisation)."""
    words = sorted(set(words))
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, label, child not yet registered

    def close(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            kept = register.setdefault(key, child)
            if kept != child:
                arcs[parent][label] = kept

    last = b""
    for w in words:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        node = path[-1][2] if path else 0
        for c in w[k:]:
            arcs.append({})
            final.append(False)
            arcs[node][c] = len(arcs) - 1
            path.append((node, c, len(arcs) - 1))
            node = len(arcs) - 1
        final[node] = True
        last = w
    close(0)
    live = sorted({0, *register.values()})
    number = {s: i for i, s in enumerate(live)}
    below: dict[int, int] = {}

    def count(s: int) -> int:  # accepted words from s
        stack = [s]
        while stack:
            x = stack[-1]
            todo = [t for t in arcs[x].values() if t not in below]
            if todo:
                stack += todo
            else:
                below[x] = final[x] + sum(below[t] for t in arcs[x].values())
                stack.pop()
        return below[s]

    count(0)
    keys, targets, skipped = [], [], []
    for s in live:
        before = int(final[s])
        for c in sorted(arcs[s]):
            keys.append(number[s] * 256 + c)
            targets.append(number[arcs[s][c]])
            skipped.append(before)
            before += below[arcs[s][c]]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64),
        "skipped": np.array(skipped, np.int64), "final": np.array([final[s] for s in live], np.int64),
    }


def compile_lexicon(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The lexicon file: a header of array lengths, then int64 arrays."""
    words = sorted({w for w in words if w})
    a = build_automaton(words)
    ids = [vocabulary.merge(w) for w in words]
    a["offsets"] = np.cumsum([0] + [len(x) for x in ids]).astype(np.int64)
    a["ids"] = np.fromiter((i for x in ids for i in x), np.int64, int(a["offsets"][-1]))
    names = ("keys", "targets", "skipped", "final", "offsets", "ids")
    head = np.array([len(a[n]) for n in names], np.int64)
    return b"".join([head.tobytes(), *(a[n].astype(np.int64).tobytes() for n in names)])


class Lexicon:
    """A lexicon file, memory-mapped."""

    def __init__(self, path: str):
        m = np.memmap(path, np.int64, "r")
        at = 6
        for name, n in zip(("keys", "targets", "skipped", "final", "offsets", "ids"), m[:6]):
            setattr(self, name, m[at : at + int(n)])
            at += int(n)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where the automaton does not accept it. All
        words step through the automaton together, byte by byte."""
        n = len(words)
        rank, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(length) - length
        blob = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        state[(length == 0) | (length > LONGEST)] = -1
        live = np.flatnonzero(state >= 0)
        k = 0
        while len(live):
            want = state[live] * 256 + blob[start[live] + k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            rank[live] += self.skipped[at]
            k += 1
            live = live[length[live] > k]
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, rank, -1)


class Encoder:
    """Exact encoder of one worker: automaton first, merges for the rest."""

    MEMO = 300_000

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo: dict[bytes, list[int]] = {}
        top = max(vocabulary.bytes_of) + 1
        self.table = [vocabulary.bytes_of.get(i, b"") for i in range(top)]

    def _unseen(self, w: bytes) -> list[int]:
        v = self.memo.get(w)
        if v is None:
            v = self.vocabulary.merge(w)
            if len(w) <= 64:
                if len(self.memo) >= self.MEMO:
                    self.memo.clear()
                self.memo[w] = v
        return v

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        flat: list[str | int] = []
        count = np.empty(len(docs), np.int64)
        for i, d in enumerate(docs):
            p = pieces(d, self.vocabulary)
            count[i] = len(p)
            flat += p
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        distinct = list(dict.fromkeys(flat))
        place = dict(zip(distinct, range(len(distinct))))
        code = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        words = [w.encode() if isinstance(w, str) else b"" for w in distinct]
        rank = self.lexicon.ranks(words) if self.lexicon is not None else np.full(len(words), -1)
        lists = [
            [int(d)] if not isinstance(d, str) else None if r >= 0 else self._unseen(w)
            for d, w, r in zip(distinct, words, rank)
        ]
        size = np.fromiter((0 if x is None else len(x) for x in lists), np.int64, len(lists))
        known = np.flatnonzero(rank >= 0)
        if len(known):
            r = rank[known]
            size[known] = self.lexicon.offsets[r + 1] - self.lexicon.offsets[r]
        start = np.cumsum(size) - size
        pool = np.zeros(int(size.sum()), np.uint32)
        for i, x in enumerate(lists):
            if x is not None:
                pool[start[i] : start[i] + size[i]] = x
        if len(known):
            pool[_ranges(start[known], size[known])] = self.lexicon.ids[_ranges(self.lexicon.offsets[r], size[known])]
        n = size[code]
        ids = pool[_ranges(start[code], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(count)))]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] values), start[1], ..."""
    total = int(n.sum())
    end = np.cumsum(n)
    return np.arange(total) + np.repeat(np.asarray(start) - (end - n), n)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n over all texts, which ranks words for the lexicon. A task counts
    runs of other than white space and splits each distinct run once, as if it
    followed a space; counts are summed in the task before the shuffle."""

    def run(batches):
        c: Counter = Counter()
        for b in chunks(batches, "text", 1 << 20):
            for t in b.column("text").to_pylist():
                if t:
                    c.update(t.split())
            if len(c) > 300_000:
                yield _counted(c)
                c.clear()
        if c:
            yield _counted(c)

    return (
        documents.select(F.col("text").cast("string")).mapInArrow(lean(run), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n"))
    )


def _counted(runs: Counter) -> pa.RecordBatch:
    c: Counter = Counter()
    for r, n in runs.items():
        for w in split_words(" " + r):
            if len(w) <= LONGEST:
                c[w] += n
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])


def publish_lexicon(documents: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of ``documents``; returns the name under
    which executors find the file. The list is bounded by ``words``."""
    spark = documents.sparkSession
    counts = materialise(word_counts(documents), "words")
    # The words above a count, by eighths of an octave: at most ``words`` of them
    # reach the driver, however many tasks counted.
    octave = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("m")).orderBy(F.desc("o")).toLocalIterator():
        if held + r.m > words:
            break
        least, held = r.o, held + r.m
    top = counts.where(octave >= (least if held else 1 << 20)).select("word")
    vocabulary = ship(spark, vocabulary_path)

    def compiled(batches):
        listed = [w.encode() for b in batches for w in b.column("word").to_pylist()]
        data = compile_lexicon(listed, Vocabulary(SparkFiles.get(vocabulary)))
        for i in range(0, len(data), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data[i : i + (1 << 20)]], pa.binary())], ["at", "part"])

    # One task compiles the list, which ``words`` bounds; the driver passes its bytes on.
    parts = top.repartition(1).mapInArrow(lean(compiled), "at long, part binary").toArrow().sort_by("at")
    discard(counts)
    if not parts.num_rows:  # no word at all, so no task ran
        parts = pa.table({"part": [compile_lexicon([], Vocabulary(vocabulary_path))]})
    path = work_path(spark, "lexicon") + ".bin"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    for part in parts.column("part"):
        out.write(bytearray(part.as_py()))
    out.close()
    return ship(spark, path)


def encode_decode(documents: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, keep_ids: bool = False,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Per text: its ids' number and digest, and the digest of the decoded text.

    ``keep_ids`` adds the ids themselves; ``carry`` names columns to keep."""
    name = publish_lexicon(documents, vocabulary_path, words)
    vocabulary = ship(documents.sparkSession, vocabulary_path)
    keep = [c for c in carry if c not in ("doc_id", "text")]
    src = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    kinds = dict(src.dtypes)

    def run(batches):
        enc = Encoder(Vocabulary(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(name)))
        for b in chunks(batches, "text", 1 << 20):
            ids, n = enc.encode([t or "" for t in b.column("text").to_pylist()])
            cut = np.concatenate(([0], np.cumsum(n)))
            each = [ids[i:j] for i, j in zip(cut, cut[1:])]
            cols = [
                b.column("doc_id"), pa.array(n, pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]),
                pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in each]),
            ] + [b.column(c) for c in keep]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]
            if keep_ids:
                cols.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", `{c}` {kinds[c]}" for c in keep) + (", ids array<int>" if keep_ids else "")
    return src.mapInArrow(lean(run), schema)
