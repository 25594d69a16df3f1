"""Personal data by bootstrapped contextual extraction, in Spark functions alone.

Seeds are what the base rules find: e-mail and IP addresses, card numbers that pass
the Luhn check, international phone numbers. The words in front of a seed are its
lexical patterns (one word, and two). A second, looser scan finds what only looks like
an identifier: numbers of 7 to 19 digits without a plus sign or a valid check digit,
IPv6 addresses, e-mail addresses with a spelt-out or bracketed "at" or without a dot.
Patterns and instances form a bipartite graph that is scored in rounds:

* a pattern's confidence is the share of its occurrences in the whole corpus that a
  seed or an instance accepted so far follows; it counts from ``MIN_SUPPORT``
  different seeds on and is used from ``MIN_CONFIDENCE`` on;
* an instance's score is the mean, over its occurrences, of its best pattern's
  confidence; from ``MIN_SCORE`` on it is accepted and speaks for its patterns.

The rounds end when no instance is added. All occurrences of accepted instances
become spans, unless they overlap a base span; base spans always stay.

Positions are code points. A text is cut once per kind by the kind's expression;
the lengths of the parts are added up in blocks, so that texts with very many
matches stay cheap. The expressions are written so that Java's matcher neither
recurses nor starts anew inside a run; they find the same matches as the plain ones:
EMAIL  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
IP     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
CARD   [0-9]([\\x20-]?[0-9])+, 14 to 19 digits, Luhn
PHONE  \\+[0-9][\\x20().0-9-]+[0-9], 10 to 15 digits

Cases: a null text is empty; an empty text has no spans (the checksum of the empty
list); a null or repeated doc_id is a row like others; equal matches are separate
spans; instances are told apart by a 64-bit hash of kind and normal form; an instance
of two kinds takes the better score, then the first kind; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensframe.functions.geometry import bound
from lensframe.session import materialise

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.5
MAX_ROUNDS = 8
#: Characters in front of a match that its patterns are taken from.
REACH = 64
_BLOCK = 512

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_OK = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_LOOSE_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]++)*+"
_IPV6 = r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])"
_NUMBER = r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9])++(?![A-Za-z0-9])"
_ANY = "|".join((EMAIL, _LOOSE_EMAIL, PHONE, _IPV6, _NUMBER))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(_IP_OK)
    if kind == "card":
        return F.when(n.between(14, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _placed(pieces: Column, item, kind: str) -> Column:
    """The pieces with ok, as array of ``kind``; ``item(piece, start)`` makes one. Lengths
    are added up block by block."""
    block = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"))

    def one(s, x):
        at = s["at"] + x["gap"]
        return F.struct(F.when(x["ok"], F.array_append(s["acc"], item(x, at))).otherwise(s["acc"]).alias("acc"), (at + x["len"]).alias("at"))

    def many(s, k):
        inner = F.aggregate(F.slice(pieces, k * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.array().cast(f"array<{kind}>").alias("acc"), s["at"].alias("at")), one)
        return F.aggregate(F.array(inner), s, lambda t, r: F.struct(F.array_append(t["acc"], r["acc"]).alias("acc"), r["at"].alias("at")))

    zero = F.struct(F.array().cast(f"array<array<{kind}>>").alias("acc"), F.lit(0).cast("long").alias("at"))
    return F.when(F.size(pieces) > 0, F.flatten(F.aggregate(block, zero, many)["acc"])).otherwise(F.array().cast(f"array<{kind}>"))


_SPAN = "struct<start:bigint,kind:int,stop:bigint>"
_FOUND = "struct<start:bigint,stop:bigint,value:string,before:string>"


def _cut(text: Column, rule: str) -> Column:
    """Parts around the matches, and the matches."""
    return F.struct(F.split(text, rule, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("found"))


def _base_spans(rows: DataFrame, kind: str, rule: str) -> DataFrame:
    """``rows`` with the base spans of a kind."""
    text = F.col("text")
    may = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    rows = bound(rows, "_cut", F.when(may, _cut(text, rule)))
    c = F.col("_cut")
    pieces = F.zip_with(F.slice(c["gaps"], F.lit(1), F.size(c["found"])), c["found"], lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), _valid(kind, m).alias("ok")))
    rows = bound(rows, "_pieces", F.coalesce(pieces, F.array().cast("array<struct<gap:bigint,len:bigint,ok:boolean>>"))).drop("_cut")
    k = F.lit(KINDS.index(kind))
    spans = _placed(F.col("_pieces"), lambda x, at: F.struct(at.alias("start"), k.alias("kind"), (at + x["len"]).alias("stop")), _SPAN)
    return bound(rows, kind, spans).drop("_pieces")


def _looks(rows: DataFrame) -> DataFrame:
    """``rows`` with all that looks like an identifier and the characters before it."""
    text = F.col("text")
    rows = bound(rows, "_cut", F.when(text.rlike(r"[0-9@]|\bat\b"), _cut(text, _ANY)))
    c = F.col("_cut")
    pieces = F.zip_with(F.slice(c["gaps"], F.lit(1), F.size(c["found"])), c["found"], lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), (m.contains("@") | m.rlike("[0-9:]|at")).alias("ok"),
        m.alias("value"), F.right(g, F.lit(REACH)).alias("before")))
    shape = "array<struct<gap:bigint,len:bigint,ok:boolean,value:string,before:string>>"
    rows = bound(rows, "_pieces", F.coalesce(pieces, F.array().cast(shape))).drop("_cut")
    found = _placed(F.col("_pieces"), lambda x, at: F.struct(at.alias("start"), (at + x["len"]).alias("stop"), x["value"].alias("value"), x["before"].alias("before")), _FOUND)
    return bound(rows, "found", found).drop("_pieces")


def scan(documents: DataFrame) -> DataFrame:
    """rid, doc_id, the base spans of each kind and what looks like an identifier."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, rule in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        rows = _base_spans(rows, kind, rule)
    return _looks(rows).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *KINDS, "found")


def _plain(words: Column) -> Column:
    """Lower-cased words in front, digits as 0."""
    return F.regexp_replace(F.lower(words), "[0-9]", "0")


def candidates(scanned: DataFrame) -> DataFrame:
    """rid, start, stop, kind, x (the instance), seed, one and two (its patterns)."""
    rows = scanned.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    v = F.col("value")
    n = F.length(_digits(v))
    number = v.rlike(r"^\(?[0-9][\x20().0-9-]*$")
    seed = (F.when(v.rlike(f"^(?:{EMAIL})$"), 0).when(v.rlike(rf"^(?:{IP})$") & _valid("ip", v), 1)
            .when(v.rlike(f"^(?:{CARD})$") & _valid("card", v), 2).when(v.rlike(f"^(?:{PHONE})$") & _valid("phone", v), 3))
    other = F.filter(F.array(
        F.when(v.rlike(f"^(?:{_LOOSE_EMAIL})$"), 0), F.when(v.rlike(f"^(?:{_IPV6})$"), 1),
        F.when(number & n.between(12, 19), 2), F.when(number & n.between(7, 15), 3)), lambda k: k.isNotNull())
    rows = bound(rows, "seed", seed)
    words = F.split(F.trim(F.regexp_replace(_plain(F.col("before")), r"\s+", " ")), " ")
    rows = bound(rows.withColumn("kind", F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(other)).where(F.size("kind") > 0), "w", words)
    size = F.size("w")
    last = F.when(F.element_at("w", -1) != "", F.element_at("w", -1))
    rows = rows.select("rid", "start", "stop", "value", F.col("seed").isNotNull().alias("seed"), F.explode("kind").alias("kind"),
                       last.alias("one"), F.when(size > 1, F.concat_ws(" ", F.element_at("w", -2), F.element_at("w", -1))).alias("two"))
    normal = F.when(F.col("kind") == 0, F.lower("value")).when(F.col("kind") == 1, F.lower("value")).otherwise(_digits(F.col("value")))
    return rows.select("rid", "start", "stop", "kind", F.xxhash64("kind", normal).alias("x"), "seed", "one", "two")


def occurrences(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """ctx, total: how often each of the patterns occurs in all texts."""
    text = _plain(F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", " ")))
    w = bound(documents.select(text.alias("t")).where("t <> ''"), "w", F.split("t", " ")).drop("t")
    both = F.transform("w", lambda x, i: F.array(x, F.when(i > 0, F.concat_ws(" ", F.get("w", i - 1), x))))
    seen = w.select(F.explode(F.flatten(both)).alias("ctx")).where("ctx is not null")
    return seen.join(patterns.select("ctx").distinct(), "ctx").groupBy("ctx").agg(F.count("*").alias("total"))


def _split(edges: DataFrame) -> DataFrame:
    return edges.withColumn("ctx", F.explode(F.array_distinct(F.array("one", "two")))).where("ctx is not null")


def bootstrap(documents: DataFrame, found: DataFrame, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, least: float = MIN_SCORE, rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame] | None:
    """(patterns with kind, ctx, support, total, conf; accepted instances with kind, x,
    score), or None where no seed repeats a pattern often enough."""
    edges = materialise(found.groupBy("kind", "one", "two", "x", "seed").agg(F.count("*").alias("n")), "pii-edges")
    backed = _split(edges.where("seed")).groupBy("kind", "ctx").agg(F.countDistinct("x").alias("support")).where(F.col("support") >= support)
    backed = materialise(backed, "pii-patterns")
    if backed.isEmpty():
        return None
    # A pattern that too few seeds and lookalikes together follow can never be used.
    totals = occurrences(documents, backed)
    reach = _split(edges).groupBy("kind", "ctx").agg(F.sum("n").alias("most"))
    patterns = materialise(backed.join(totals, "ctx").join(reach, ["kind", "ctx"]).where(F.col("most") >= confidence * F.col("total")), "pii-patterns")
    accepted, before = None, -1
    for _ in range(rounds):
        weigh = _split(edges.where("seed")).select("kind", "ctx", "n")
        if accepted is not None:
            weigh = weigh.unionByName(_split(edges.where("not seed").join(accepted, ["kind", "x"])).select("kind", "ctx", (F.col("n") * F.col("score")).alias("n")))
        strong = patterns.join(weigh.groupBy("kind", "ctx").agg(F.sum("n").alias("w")), ["kind", "ctx"]).withColumn("conf", F.col("w") / F.col("total"))
        strong = materialise(strong.where(F.col("conf") >= confidence).select("kind", "ctx", "support", "total", "conf"), "pii-confidence")
        one, two = (strong.select("kind", F.col("ctx").alias(c), F.col("conf").alias(f"c_{c}")) for c in ("one", "two"))
        met = edges.where("not seed").join(one, ["kind", "one"], "left").join(two, ["kind", "two"], "left")
        best = F.greatest(F.coalesce("c_one", F.lit(0.0)), F.coalesce("c_two", F.lit(0.0)))
        score = F.least(F.lit(1.0), F.sum(best * F.col("n")) / F.sum("n"))
        accepted = materialise(met.groupBy("kind", "x").agg(score.alias("score")).where(F.col("score") >= least), "pii-accepted")
        now = accepted.count()
        if now <= before or not now:
            break
        before = now
    return strong, accepted


def _added(scanned: DataFrame, found: DataFrame, accepted: DataFrame) -> DataFrame:
    """rid, more: spans of accepted instances that overlap no base span."""
    place = Window.partitionBy("rid", "start", "stop").orderBy(F.desc("score"), "kind")
    new = found.where("not seed").join(accepted, ["kind", "x"]).withColumn("r", F.row_number().over(place)).where("r = 1")
    new = new.select("rid", "start", "kind", "stop", F.lit(False).alias("base"))
    base = scanned.join(new.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(F.concat(*KINDS)).alias("s")).select("rid", "s.*", F.lit(True).alias("base"))
    order = Window.partitionBy("rid").orderBy("start", F.desc("base"), "stop")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    both = new.unionByName(base).withColumns({
        "last": F.max(F.when(F.col("base"), F.col("stop"))).over(back), "next": F.min(F.when(F.col("base"), F.col("start"))).over(ahead)})
    free = both.where("not base and coalesce(last, start) <= start and coalesce(next, stop) >= stop")
    return free.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("more"))


def personal_data(documents: DataFrame, **settings) -> DataFrame:
    """rid, doc_id, base and more: arrays of (start, kind, stop), kind an index of KINDS;
    ``settings`` go to ``bootstrap``."""
    scanned = materialise(scan(documents), "pii-scan")
    found = candidates(scanned)
    known = bootstrap(documents, found, **settings)
    base = F.array_sort(F.concat(*KINDS)).alias("base")
    if known is None:
        return scanned.select("rid", "doc_id", base, F.array().cast(f"array<{_SPAN}>").alias("more"))
    more = materialise(_added(scanned, found, known[1]), "pii-more")
    return scanned.join(more, "rid", "left").select("rid", "doc_id", base, F.coalesce(F.array_sort("more"), F.array().cast(f"array<{_SPAN}>")).alias("more"))


def _written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_digest(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, base spans per kind, their checksum and all spans; n_found counts those
    that the patterns add."""
    p = personal_data(documents, **settings)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return p.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                    _written(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_found"))
