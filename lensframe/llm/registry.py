"""The thin opN queries of the numbered operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textio import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import materialise_order

    return materialise_order(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), end=50256)[0]


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k, whole_vectors

    return top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.pmod("vec_id", F.lit(50)) == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions; documents labelled
    of low quality are deleted; the word counts of documents labelled toxic are
    revised to bytes // 6, as a second release of the word tokenizer would; the
    deletion is sent twice."""
    from lensframe.session import materialise, work_path

    from .token_counts import RollupStore, changes, counted

    counts = materialise(counted(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken")), "token-counts")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    low = counts.join(labels.where("quality = 0"), "doc_id", "left_semi")
    toxic = counts.join(labels.where("quality = 1 and toxic = 1"), "doc_id", "left_semi")
    store = RollupStore(spark, work_path(spark, "token-rollup"))
    store.apply("1-insert", changes(counts, "byte_bpe_50k", "n_bpe", 1).unionByName(changes(counts, "words-1", "n_words", 1)))
    gone = changes(low, "byte_bpe_50k", "n_bpe", -1).unionByName(changes(low, "words-1", "n_words", -1))
    store.apply("2-delete", gone)
    store.apply("3-revise", changes(toxic, "words-1", "n_words", -1).unionByName(
        changes(toxic.withColumn("n_new", F.expr("bytes div 6")), "words-1", "n_new", 1)))
    store.apply("2-delete", gone)
    store.compact()
    return store.totals()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergences

    return divergences(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives, labelled_vectors

    return hard_negatives(labelled_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_training_order, op2_topk, op3_token_counts, op4_toxicity, op5_licenses, op6_decontaminate, op7_bpe, op8_quality,
              op9_sharding, op10_jaccard, op11_divergence, op12_pii, op13_hard_negatives)
}
ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM x q JOIN x d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(min(r.b), n.doc_id) AS component_id FROM n LEFT JOIN r ON n.doc_id = r.a GROUP BY n.doc_id, n.n""",
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.*, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v.v) AS p,
  1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v.v) AS q FROM f JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_hard_negatives": """
WITH x AS (
  SELECT vec_id, row_number() OVER () AS rid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM x a JOIN x b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.rid, p.place, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
