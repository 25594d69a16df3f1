"""The numbered operators against brute force, and their edge cases."""

import glob
import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest

from lensframe.llm import registry
from lensframe.llm.textio import table
from tests.compare import connection, same

SF = "/root/testdata/sf0.001"
NASTY = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, h string"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 1.0, 1, 1, "x"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 1.0, 1, 1, "x"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 0.0, 0, 0, ""),
    (5, " \n\t ", "en", "a", 0, 0.0, 0, 0, ""),
    (6, "two words", "en", "a", 0, 0.0, 0, 0, ""),
    (7, "Two Words", "en", "a", 0, 0.0, 0, 0, ""),
    (8, "naïve 😀 text <|endoftext|> it's \x00 odd\r\n" * 3, "en", "a", 0, 0.0, 0, 0, ""),
    (9, "word " * 30000, "en", "a", 0, 0.0, 0, 0, ""),
    (None, "a row without an id that still has a text of some words", "en", "a", 0, 0.0, 0, 0, ""),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, 1.0, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(ROWS, NASTY)


@pytest.fixture(scope="module")
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1), (9, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def brute_components(docs, k=4, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    by = {}
    for i in ids:
        for g in sets[i]:
            by.setdefault(g, []).append(i)
    for i in ids:
        for j in {j for g in sets[i] for j in by[g] if j < i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_equals_brute_force(spark):
    d = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op10_jaccard(spark, SF).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])


def test_jaccard_near_copies_and_chains(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):  # a chain: each edit moves a little further
        base = [*base]
        base[int(rng.integers(0, 120))] = f"x{i}"
        docs.append((i, " ".join(base)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in __import__("lensframe.llm.jaccard", fromlist=["x"]).jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_jaccard_edge_cases(nasty, empty):
    from lensframe.llm.jaccard import jaccard_components, keep_one_of_each

    got = jaccard_components(nasty).collect()
    assert len(got) == len(ROWS)
    c = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert c[1][1] == c[2][1] == 1 and c[6] == c[7] == (1, 6) and c[3] == (0, 3) and c[4] == (0, 4) and c[5] == (0, 5)
    assert jaccard_components(empty).count() == 0
    assert {r.doc_id for r in keep_one_of_each(nasty).collect()} == {1, 3, 4, 5, 6, 8, 9, None}


def test_bpe_equals_the_library(spark, nasty, empty):
    from tokenizers import Tokenizer

    from lensframe.llm.bpe import encode_decode

    path = registry.vocabulary_path()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for docs, words in ((table(spark, SF, "documents"), 2000), (nasty, 5)):
        got = encode_decode(docs, path, words).collect()
        want = {}
        for r in docs.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                              hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert len(got) == docs.count()
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    assert encode_decode(empty, path).count() == 0


def test_bpe_splits_every_kind_of_character():
    from tokenizers import Tokenizer

    from lensframe.llm.bpe import split_words

    pre = Tokenizer.from_file(registry.vocabulary_path()).pre_tokenizer
    for c in [*range(0x3000), *range(0x10900, 0x10A00), *range(0x13400, 0x13500), 0x1F600, 0x323B0]:
        s = "a{0}a1{0}1!{0}! {0} {0}{0}b".format(chr(c))
        assert [s[x:y] for _, (x, y) in pre.pre_tokenize_str(s)] == split_words(s), hex(c)


def test_automaton_is_minimal_and_ranks_words(tmp_path):
    from lensframe.llm.bpe import Lexicon, Vocabulary, build_automaton, compile_lexicon

    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops"]
    a = build_automaton(words)
    assert len(a["final"]) == 7  # equal endings share their states
    v = Vocabulary(registry.vocabulary_path())
    (tmp_path / "x").write_bytes(compile_lexicon(words, v))
    lex = Lexicon(str(tmp_path / "x"))
    assert lex.ranks(sorted(words)).tolist() == list(range(6))
    assert lex.ranks([b"ta", b"", b"stopss", b"x"]).tolist() == [-1] * 4


def test_top_k_equals_sql(spark):
    same(registry.op2_topk(spark, SF), registry.ORACLE_SQL["op2_topk"], connection(SF))


def test_top_k_edge_cases(spark):
    from pyspark.sql import functions as F

    from lensframe.llm.topk import top_k, whole_vectors

    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (8, [1.0]), (100, []), (7, [0.5, 0.5])]
    d = whole_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in top_k(d, F.col("vec_id") % 50 == 0, k=3).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 50, 65536), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 2, 65536)]
    assert top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sharding(spark, nasty, empty):
    from lensframe.llm.sharding import histogram_sort, sharded

    p = registry.op9_sharding(spark, SF).toPandas()
    d = table(spark, SF, "documents").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert len(p) == len(d) and (p["size"] == p.doc_id.map(lambda i: len(d[i].encode()) + 8)).all()
    assert (p.text_crc32 == p.doc_id.map(lambda i: zlib.crc32(d[i].encode()))).all()
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    parts = histogram_sort(table(spark, SF, "documents"), 3, part_bytes=20_000).toPandas()  # several parts a shard
    for _, g in parts.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    s = parts.groupby("shard")["text"].apply(lambda t: sum(len(x.encode()) for x in t))
    assert s.max() < 1.2 * s.mean()
    assert sharded(nasty).count() == len(ROWS) and sharded(empty).count() == 0


def test_training_order_round_trip(spark, nasty, empty):
    from lensframe.llm.training_order import feistel, materialise_order, rank_encoder, read_shard, shard_files

    for n in (1, 2, 3, 100, 1025):
        assert sorted(feistel(np.arange(n), n).tolist()) == list(range(n))
    path = registry.vocabulary_path("byte_bpe_50k.tiktoken")
    enc = rank_encoder(path)
    for docs in (table(spark, SF, "documents").limit(40), nasty):
        docs = spark.createDataFrame(docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}).replace({pd.NA: None}).values.tolist(), "doc_id long, text string")
        out, folder = materialise_order(docs, path, 50256, length=16, per_shard=50)
        p = out.toPandas().sort_values("slot")
        assert p.slot.tolist() == list(range(len(p)))
        files = [f.removeprefix("file:") for f in shard_files(spark, folder)]
        assert len(files) == p.shard.nunique()
        ids = np.concatenate([read_shard(open(f, "rb"), 16) for f in files])
        assert [zlib.crc32(r.tobytes()) for r in ids] == p.ids_crc32.tolist()
        assert (read_shard(open(files[-1], "rb"), 16, 2, 3) == ids[50 * (len(files) - 1) + 2 :][:3]).all()
        text = {r.doc_id: r.text for r in docs.collect()}
        one = p[p.doc_id == 8] if 8 in text else p[p.doc_id == p.doc_id.iloc[0]]
        one = one.sort_values("seq")
        got = [x for s, n in zip(one.slot, one.n) for x in ids[s][:n].tolist()]
        assert got == [*enc.encode_ordinary(text[one.doc_id.iloc[0]] or ""), 50256]
    assert materialise_order(empty, path, 50256)[0].count() == 0


GAPS = [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, "a b" + " " * 1_500_000 + "c", " \n" * 700_000 + "x y", "\u2003" * 100_000 + "!"]


def test_long_white_space_is_encoded(spark):
    from lensframe.llm.bpe import Vocabulary, split_words
    from lensframe.llm.token_counts import counted
    from lensframe.llm.training_order import encode, materialise_order, rank_encoder

    path = registry.vocabulary_path("byte_bpe_50k.tiktoken")
    enc, v = rank_encoder(path), Vocabulary(registry.vocabulary_path())
    want = [[i for w in split_words(t) for i in v.merge(w.encode())] for t in GAPS]
    assert [encode(enc, t) for t in GAPS] == want
    d = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(GAPS)], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.n_bpe for r in counted(d, path).collect()} == {i: len(w) for i, w in enumerate(want)}
    out, _ = materialise_order(d, path, 50256)
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()} == {i: len(w) + 1 for i, w in enumerate(want)}


def test_token_counts(spark, tmp_path):
    from lensframe.llm.token_counts import RollupStore, changes, counted
    from lensframe.llm.training_order import rank_encoder

    path = registry.vocabulary_path("byte_bpe_50k.tiktoken")
    d = spark.createDataFrame([(1, "a", "en", "hello world", 3, 4), (2, "a", "en", None, None, None), (3, None, None, "x", 1, 1), (4, "b", "de", "", 0, 0)],
                              "doc_id long, source string, lang string, text string, tokens long, sign long")
    c = counted(d, path)
    s = RollupStore(spark, str(tmp_path / "store"))
    assert s.totals().count() == 0 and not s.compact()
    assert s.apply("1", changes(c, "t", "n_bpe", 1)) and not s.apply("1", changes(c, "t", "n_bpe", 1))
    assert s.apply("2/x=y %", changes(c.where("doc_id = 1"), "t", "n_bpe", -1))
    assert not s.apply("2/x=y %", changes(c.where("doc_id = 1"), "t", "n_bpe", -1))
    s.apply("3", changes(c.limit(0), "t", "n_bpe", 1))
    want = {("a", "en"): (1, 0, 0), (None, None): (1, len(rank_encoder(path).encode_ordinary("x")), 1), ("b", "de"): (1, 0, 0)}
    rows = lambda: {(r.source, r.lang): (r.documents, r.tokens, r.bytes) for r in s.totals().collect()}
    assert rows() == want
    assert s.compact() and rows() == want and not s.apply("1", changes(c, "t", "n_bpe", 1))
    assert s.apply("4", changes(c.where("doc_id = 3"), "t", "n_bpe", -1)) and rows()[None, None] == (0, 0, 0)
    assert len(s._live()[0]) == 2  # the snapshot and the batch after it
    assert not s._mark("batches/b-1", ["another"])  # a second writer of a batch comes too late


def test_token_count_query_equals_recount(spark):
    from lensframe.llm.training_order import rank_encoder

    enc = rank_encoder(registry.vocabulary_path("byte_bpe_50k.tiktoken"))
    d = table(spark, SF, "documents").toPandas()
    lab = table(spark, SF, "labels").toPandas().set_index("doc_id")
    want = {}
    for r in d.itertuples():
        q, t = (lab.loc[r.doc_id, "quality"], lab.loc[r.doc_id, "toxic"]) if r.doc_id in lab.index else (1, 0)
        for name, n in (("byte_bpe_50k", len(enc.encode_ordinary(r.text))), ("words-1", len(r.text.encode().split()))):
            x = want.setdefault((r.source, r.lang, name), [0, 0, 0])
            if q == 0:
                continue
            if t == 1 and name == "words-1":
                n = len(r.text.encode()) // 6
            for k, v in enumerate((1, n, len(r.text.encode()))):
                x[k] += v
    got = {(r.source, r.lang, r.tokenizer): [r.documents, r.tokens, r.bytes] for r in registry.op3_token_counts(spark, SF).collect()}
    assert got == want


def test_licenses_equal_brute_force(spark, nasty, empty):
    from lensframe.llm.licenses import TEMPLATES, Words, license_matches
    from lensframe.llm.textio import shingle_hashes

    w = Words()
    want = set()
    grams = {n: set(shingle_hashes(w.of(t.encode()), 5).tolist()) for n, t in TEMPLATES.items()}
    for r in table(spark, SF, "documents").collect():
        h = w.of(r.text.encode())
        have = set(shingle_hashes(h, 5).tolist()) if len(h) >= 5 else set()
        want |= {(r.doc_id, n) for n, g in grams.items() if len(g & have) >= 0.8 * len(g)}
    got = {(r.doc_id, r.license) for r in registry.op5_licenses(spark, SF).collect()}
    assert got == want
    assert license_matches(nasty).count() == 0 and license_matches(empty).count() == 0


def test_license_bands_retrieve_by_themselves(spark):
    """Windows all hashed give what the shingle table gives; and of the documents
    that hold 80 to 100 % of a template's shingles the bands miss next to none."""
    from lensframe.llm.licenses import CONTAINMENT, ROWS as BAND_ROWS, TEMPLATES, Words, compile_templates, scan_text
    from lensframe.llm.textio import shingle_hashes

    classes, w = compile_templates(TEMPLATES), Words()
    every = np.unique(np.concatenate([g for c in classes for g in c["grams"]]))
    for r in table(spark, SF, "documents").where("length(text) < 4000").limit(60).collect():
        words = w.of(r.text.encode())
        assert scan_text(words, classes, None, BAND_ROWS, CONTAINMENT) == scan_text(words, classes, every, BAND_ROWS, CONTAINMENT)
    rng = np.random.default_rng(5)
    filler = [f"filler{i}" for i in range(500)]
    held = found = 0
    for name, text in TEMPLATES.items():
        grams = set(shingle_hashes(w.of(text.encode()), 5).tolist())
        for _ in range(12):
            t = text.split()
            if len(t) > 30:
                t[int(rng.integers(0, len(t)))] = "changed"
            body = [*rng.choice(filler, int(rng.integers(0, 300))), *t, *rng.choice(filler, int(rng.integers(0, 300)))]
            words = w.of(" ".join(body).encode())
            if len(grams & set(shingle_hashes(words, 5).tolist())) >= 0.8 * len(grams):
                held += 1
                found += name in scan_text(words, classes, None, BAND_ROWS, CONTAINMENT)
    assert held > 150 and found >= 0.99 * held


def brute_leaks(docs, bench):
    """All (doc, item) pairs that pass the rules in some region: three quarters of
    the item's words in order, or half of them and the whole answer."""
    from lensframe.llm.decontaminate import HALF, answer_words, item_words, lcs_length, reach

    def holds(words, run):
        return any(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1)) if run else False

    items = [(i, item_words(t), answer_words(t)) for i, t in bench]
    found = set()
    for d, t in docs:
        words = item_words(t)
        have = set(words)
        for i, item, answer in items:
            if not item or sum(w in have for w in item) < 0.5 * len(item):
                continue
            before, after = reach(len(item))
            for h in range(0, max(1, len(words) // HALF + 1)):
                region = words[max(0, h * HALF - before) : h * HALF + after]
                near = set(region)
                if sum(w in near for w in item) < 0.5 * len(item):
                    continue
                share = lcs_length(item, region) / len(item)
                if share >= 0.75 or share >= 0.5 and holds(region, answer):
                    found.add((d, i))
                    break
    return found


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_leaks_equal_brute_force(spark, sf):
    want = brute_leaks([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    got = {(r.doc_id, r.item_id) for r in registry.op6_decontaminate(spark, sf).collect()}
    assert want and got <= want and len(got) >= 0.97 * len(want)


def test_leaks_of_paraphrases(spark):
    """Both rules: items with words replaced, and halves of items with their answer."""
    from lensframe.llm.decontaminate import answer_words, item_words, leaks

    rng = np.random.default_rng(4)
    docs = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect() if len(r.text.split()) > 150][:300]
    bench = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    rows = []
    for n, text in enumerate(docs):
        i, t = bench[n % len(bench)]
        words, answer = [w.decode() for w in item_words(t)], [w.decode() for w in answer_words(t)]
        body = words[: len(words) - len(answer)] if n % 2 else words
        body = [f"other{rng.integers(0, 9**6)}" if rng.random() < (0.35 if n % 2 else 0.2) else w for w in body]
        at = int(rng.integers(0, 120))
        filler = text.split()
        rows.append((n, " ".join([*filler[:at], *body, *(answer if n % 2 else []), *filler[at:]])))
    want = brute_leaks(rows, bench)
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(want) > 200 and got <= want and len(got) >= 0.9 * len(want)


def test_leaks_of_common_items_and_long_texts(spark, nasty, empty):
    from lensframe.llm.decontaminate import leaks

    one = "Which of the seven lanterns burned longest in the harbour of the northern town? The green lantern of the old keeper."
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    copies = spark.createDataFrame([(i, one) for i in range(40)], "doc_id long, text string")
    assert {r.doc_id for r in leaks(copies, bench).collect()} == set(range(40))
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(1, long + " " + one + " " + long), (2, long), (None, one)]
    assert {r.doc_id for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {1, None}
    blocks = spark.createDataFrame([(i, f"item number {i} asks about thing{i} and place{i} in year{i} or city{i}. The answer is name{i} of house{i}.") for i in range(60)], "item_id long, text string")
    docs = blocks.selectExpr("item_id as doc_id", "concat('some words before it ', text, ' and some after') as text")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, blocks, block_items=7).collect()} >= {(i, i) for i in range(60)}
    bench = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, ""), (4, "?! ...")], "item_id long, text string")
    assert {r.doc_id for r in leaks(nasty, bench).collect()} == {1, 2}
    assert leaks(empty, bench).count() == 0 and leaks(nasty, bench.limit(0)).count() == 0


def test_lcs_length_against_table():
    from lensframe.llm.decontaminate import lcs_length

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ([bytes([x]) for x in rng.integers(0, 5, n)] for n in rng.integers(0, 30, 2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert lcs_length(a, b) == t[-1, -1]


@pytest.mark.parametrize("name,label,least", [("op8_quality", "quality", 0.93), ("op4_toxicity", "toxic", 0.85)])
def test_classifiers_hold_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    p = registry.QUERIES[name](spark, sf).toPandas()
    m = p.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.3)).all()
    assert (m.predicted == m[label]).mean() >= least


def test_classifier_edge_cases(nasty, empty, labels):
    from pyspark.sql import functions as F

    from lensframe.llm.quality import keep_good, labelled, quality_scores
    from lensframe.llm.toxicity import keep_civil, toxicity_scores

    assert labelled(nasty.unionByName(nasty).unionByName(nasty), labels, "toxic", F.lit(True), 3).count() <= 3  # rows, not labels, are bounded
    for f, keep in ((quality_scores, keep_good), (toxicity_scores, keep_civil)):
        got = f(nasty, labels).collect()
        assert not any(r.held_out is None for r in got)
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert f(nasty, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
        assert f(empty, labels).count() == 0
        assert keep(nasty, labels).columns == nasty.columns


def _texts_of_pairs(n, seed):
    """Toxic: an insult together with a group it is aimed at; insults alone, groups
    alone and the other combinations are clean, so no sum of word weights can tell."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.integers(0, 2, 2)
        words = [f"filler{x}" for x in rng.integers(0, 300, 20)] + [("zarg", "blotz")[a], ("norrians", "veldish")[b]]
        rows.append((int(i), " ".join(rng.permutation(words)), int(a == b)))
    return rows


def test_toxicity_learns_pairs_that_no_linear_model_can(spark):
    from lensframe.llm import toxicity

    known: dict = {}
    train, test = _texts_of_pairs(1200, 1), _texts_of_pairs(400, 2)
    m = toxicity.fit([toxicity.text_terms(t.encode(), known) for _, t, _ in train], [y for *_, y in train])
    y = np.array([y for *_, y in test])

    def accuracy(model):
        return ((toxicity.scores([t.encode() for _, t, _ in test], toxicity.Terms(model["kept"]), model) >= 0.5) == y).mean()

    assert accuracy(m) > 0.95
    assert accuracy({**m, "v": np.zeros_like(m["v"])}) < 0.7


def test_toxicity_scores_equal_the_formula(spark):
    """The query's scores against the sum over all pairs, written out."""
    from itertools import combinations

    from lensframe.llm import toxicity

    docs = spark.createDataFrame([(i, t) for i, t, _ in _texts_of_pairs(300, 3)] + [(1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in _texts_of_pairs(300, 3)], "doc_id long, toxic int")
    m = toxicity.learn(docs, labels, 9000)
    place, known = {int(t): i for i, t in enumerate(m["kept"])}, {}
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.collect():
        at = [place[t] for t in toxicity.text_terms((r.text or "").encode(), known).tolist() if t in place]
        z = m["b"] + sum(float(m["w"][i]) for i in at) + sum(float(m["v"][i] @ m["v"][j]) for i, j in combinations(at, 2))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_quality_scores_equal_enumeration(spark):
    """The query's scores against the sum over all labellings of the lines."""
    from itertools import product

    from lensframe.llm import quality

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    m = quality.learn(docs, table(spark, sf, "labels"), quality.FIT_ROWS)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, table(spark, sf, "labels")).collect()}
    some = [r for r in docs.orderBy("doc_id").collect() if r.text.count("\n") < 9][:40]
    assert len(some) == 40
    for r in some:
        x, length, lines = quality.line_features([r.text.encode()])
        e, n, total, one = x @ m["w"], int(lines[0]), 0.0, np.zeros(int(lines[0]))
        for y in product((0, 1), repeat=n):
            s = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(m["t"][y[i], y[i + 1]] for i in range(n - 1)))
            total, one = total + s, one + s * np.array(y)
        p = np.clip(((one / total) * length).sum() / length.sum(), 1e-6, 1 - 1e-6)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(m["scale"][0] * np.log(p / (1 - p)) + m["scale"][1]))), abs=1e-4)


def test_marginals_against_enumeration():
    from itertools import product

    from lensframe.llm.quality import marginals

    rng = np.random.default_rng(2)
    lines, t = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    emit = rng.normal(size=8)
    p, pair = marginals(emit, lines, t, want_pairs=True)
    at = 0
    for n in lines:
        z, one = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            s = np.exp(sum(emit[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            z += s
            one += s * np.array(y)
        assert p[at : at + n] == pytest.approx(one / z)
        at += n
    assert pair.sum() == pytest.approx((lines - 1).sum())


def test_pipeline_equals_its_stages_by_hand(spark):
    """Every stage's decisions, worked out apart from the pipeline."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from lensframe.llm import quality, toxicity

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    m = quality.learn(docs, labels, quality.FIT_ROWS)
    left = {i for i, t in text.items() if quality.document_scores([t.encode()], m)[0] >= 0.3}
    kept = docs.where(docs.doc_id.isin(sorted(left)))
    m = toxicity.learn(kept, labels, toxicity.FIT_ROWS)
    terms = toxicity.Terms(m["kept"])
    left = {i for i in left if toxicity.scores([text[i].encode()], terms, m)[0] < 0.3}
    left = {i for i, c in brute_components([(i, text[i]) for i in left], 5, 80).items() if c[1] == i}
    want = left - {i for i, _ in brute_leaks([(i, text[i]) for i in left], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    assert 20 < len(want) < len(left) < len(text)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == want
    t = Tokenizer.from_file(registry.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    for i in want:
        ids = t.encode(text[i], add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()


def test_pipeline_stages_on_odd_tables(spark, nasty, empty):
    import corpus_pipeline

    for docs in (nasty, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == nasty.columns, name
            assert out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_lean_tasks_pass_rows_on_and_release_at_the_end(monkeypatch):
    from lensframe.llm import textio

    seen = []
    monkeypatch.setattr(textio, "release", lambda: seen.append("released"))

    def run(batches):
        for b in batches:
            seen.append(b)
            yield b + 1

    assert list(textio.lean(run)([1, 2])) == [2, 3]
    assert seen == [1, 2, "released"]
