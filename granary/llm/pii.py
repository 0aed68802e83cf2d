"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four base expressions find the seeds: e-mail addresses, IPv4 addresses, payment cards (Luhn) and telephone numbers. The words
around a seed make lexical patterns; other tokens with digits or an at sign are candidates. Patterns and instances form a
graph that is scored in rounds: a pattern is as sure as the share of its distinct instances that are of one kind, an
instance as the patterns that agree on it. Candidates that sure patterns reach are identifiers that no expression knows; they
count as seeds in the next round.

The expressions are possessive and start where a run starts, so a match is found in linear time and without recursion on
any text; they accept the same leftmost matches as their plain forms (given at KINDS).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ship, table

# Kinds in order, with the plain form of each expression.
#: email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, ip `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`,
#: card `[0-9]([\x20-]?[0-9])+`, phone `\+[0-9][\x20().0-9-]+[0-9]`
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Rounds; distinct seeds behind a pattern; a pattern's and an instance's least score; what one pattern alone can give.
ROUNDS, SUPPORT, SURE_PATTERN, SURE_INSTANCE, TRUST = 3, 3, 0.8, 0.75, 0.95
#: Characters of context on either side, fewest characters of a candidate. A context word that is longer counts by the part within.
CONTEXT, LEAST = 80, 6


def _hits(kind: str, regex: str) -> Column:
    """Pieces of the text between matches, each with the match that follows it (null after the last piece)."""
    found = F.regexp_extract_all("t", F.lit(regex), F.lit(0))
    pieces = F.split("t", regex, -1)
    both = F.zip_with(pieces, found, lambda p, x: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(p, F.lit(CONTEXT)).alias("head"), x.alias("found")))
    numbered = F.transform(both, lambda s, i: F.struct(i.alias("at"), s["kind"].alias("kind"), s["gap"].alias("gap"), s["before"].alias("before"), s["head"].alias("head"), s["found"].alias("found")))
    return F.when(F.regexp_like("t", F.lit(regex)), numbered)


_HITS = "array<struct<at:int,kind:string,gap:int,before:string,head:string,found:string>>"


def _digits(c: str) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: str) -> Column:
    """Luhn's check on a column of digits; i counts from the right."""
    v = f"cast(substr({c}, length({c}) - i + 1, 1) as int)"
    return F.expr(f"aggregate(sequence(1, greatest(length({c}), 1)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {v} WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END) % 10 = 0")


def _valid() -> Column:
    part = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    n = F.length("digits")
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.regexp_like("found", F.lit(rf"\A{part}\.{part}\.{part}\.{part}\z")))
        .when(F.col("kind") == "card", F.when(n.between(16, 19), _luhn("digits")).otherwise(False))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .otherwise(F.length("found") >= LEAST)
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, th, hits) for each row: what the expressions found in the whole text; hits is null where nothing was."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kinds = {**KINDS, "": TOKEN}
    cols = [_hits(k, r).alias(f"h{i}") for i, (k, r) in enumerate(kinds.items())]
    found = t.select("doc_id", F.xxhash64("t").alias("th"), *cols)
    names = [f"h{i}" for i in range(len(kinds))]
    some = reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in names))
    return found.select("doc_id", "th", F.when(some, F.concat(*(F.coalesce(F.col(n), F.array().cast(_HITS)) for n in names))).alias("hits"))


def occurrences(scanned: DataFrame) -> DataFrame:
    """(doc_id, th, kind, found, start, end, left, right): valid base matches and candidates (kind ''), in code points.

    Start positions are running sums of piece and match lengths; a text's matches of a kind are the most that one window holds.
    A context goes on over the match of that kind beside it, so neighbouring candidates are each other's context.
    """
    one = scanned.where("hits is not null").dropDuplicates(["doc_id", "th"])
    rows = one.select("doc_id", "th", F.explode("hits").alias("h")).select("doc_id", "th", "h.*")
    w = Window.partitionBy("doc_id", "th", "kind").orderBy("at")
    size = F.coalesce(F.length("found"), F.lit(0))
    ends = F.sum(F.col("gap") + size).over(w)
    none = F.lit("")
    before = F.concat(F.coalesce(F.lag("before").over(w), none), F.coalesce(F.lag("found").over(w), none), "before")
    after = F.concat(F.coalesce(F.lead("head").over(w), none), F.coalesce(F.lead("found").over(w), none))
    rows = rows.select("*", (ends - size).alias("start"), ends.alias("end"), F.right(before, F.lit(CONTEXT)).alias("left"), F.left(after, F.lit(CONTEXT)).alias("after")).where("found is not null").drop("before").withColumnRenamed("left", "before")
    # candidates without the punctuation around them
    lead = F.length(F.regexp_extract("found", r"\A[(\[{<\"'`]*", 0))
    core = F.regexp_extract("found", r"\A[(\[{<\"'`]*(.*?)[)\]}>\"'`.,;:!?]*\z", 1)
    plain = F.col("kind") == ""
    rows = rows.withColumn("start", F.when(plain, F.col("start") + lead).otherwise(F.col("start"))).withColumn("found", F.when(plain, core).otherwise(F.col("found")))
    rows = rows.withColumn("end", F.col("start") + F.length("found")).withColumn("digits", _digits("found")).where(_valid())
    word = r"(\S+)\s*\z"
    return rows.select(
        "doc_id", "th", "kind", "found", "start", "end",
        F.lower(F.regexp_extract("before", r"(\S+)\s+\S+\s*\z", 1)).alias("left2"), F.lower(F.regexp_extract("before", word, 1)).alias("left1"), F.lower(F.regexp_extract("after", r"\A\s*(\S+)", 1)).alias("right1"),
    )


def _patterns() -> Column:
    """The lexical patterns around an occurrence: two words before it; a word on either side. Digits are alike."""
    clean = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    two = F.when(F.col("left2") != "", F.concat(F.lit("2 "), clean("left2"), F.lit(" "), clean("left1")))
    around = F.when((F.col("left1") != "") & (F.col("right1") != ""), F.concat(F.lit("1 "), clean("left1"), F.lit(" _ "), clean("right1")))
    return F.array_compact(F.array(two, around))


def bootstrap(found: DataFrame) -> DataFrame:
    """(pattern, kind, sure): patterns of high confidence after ROUNDS rounds over the pattern-instance graph."""
    edges = cut(found.select(F.explode(_patterns()).alias("pattern"), F.lower("found").alias("inst"), "kind").groupBy("pattern", "inst").agg(F.max("kind").alias("kind")))
    seeds = edges.where("kind <> ''").groupBy("inst", "kind").agg(F.lit(1.0).alias("score"))
    total = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    graph = cut(edges.select("pattern", "inst").join(total, "pattern"))
    scores, sure = seeds, None
    for _ in range(ROUNDS):
        backed = graph.join(scores, "inst").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.max("n").alias("n"))
        sure = cut(backed.where((F.col("s") >= SUPPORT) & (F.col("s") / F.col("n") >= SURE_PATTERN)).select("pattern", "kind", (F.col("s") / F.col("n")).alias("sure")))
        reach = graph.join(sure, "pattern").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - TRUST * F.least("sure", F.lit(1.0)))))).alias("score"))
        new = reach.where(F.col("score") >= SURE_INSTANCE).join(seeds.select("inst"), "inst", "left_anti")
        scores = cut(seeds.unionByName(new))
    return sure.join(scores.select("kind").distinct(), "kind", "left_semi")


def spans(scanned: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end, base): base matches, and candidates that sure patterns reach outside of them."""
    found = cut(occurrences(scanned))
    base = found.where("kind <> ''")
    sure = bootstrap(found)
    cand = found.where("kind = ''").withColumn("pattern", F.explode(_patterns())).drop("kind").join(sure, "pattern")
    votes = cand.groupBy("doc_id", "th", "start", "end", "kind").agg((1 - F.exp(F.sum(F.log(1 - TRUST * F.least("sure", F.lit(1.0)))))).alias("score"))
    best = votes.where(F.col("score") >= SURE_INSTANCE).groupBy("doc_id", "th", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    names = ("doc_id", "th", "kind", "start", "end")
    both = base.select(*names, F.lit(True).alias("base")).unionByName(best.select(*names, F.lit(False).alias("base")))
    # a candidate overlaps a base match if one that starts before it ends after its start, or the next one starts before its end
    w = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("base"), "end", "kind")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = both.withColumn("over", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False)))
    return marked.where(F.col("base") | ~F.col("over")).drop("over")


def _order() -> Column:
    return reduce(lambda c, x: c.when(F.col("kind") == x[1], x[0]), enumerate(KINDS), F).otherwise(len(KINDS)).cast("int")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of docs (doc_id, text).

    Null texts count as empty; without spans the strings are empty. Rows are told apart by doc_id and text, so repeated rows
    and rows that share a doc_id each get their own spans. Positions count code points, ends are exclusive.
    """
    scanned = cut(scan(docs))
    s = spans(scanned).withColumn("o", _order()).withColumn("s", F.concat_ws(":", "kind", "start", "end"))
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("o", "start", "end", "s")))), lambda x: x["s"]), ",")
    per = s.groupBy("doc_id", "th").agg(*(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS), line(F.col("base")).alias("base"), line(F.lit(True)).alias("spans"))
    a, p = scanned.select("doc_id", "th").alias("a"), per.alias("p")
    out = a.join(p, F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.th") == F.col("p.th")), "left")
    return out.select("a.doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span, base or discovered, replaced by its kind in brackets; overlapping spans are replaced as one.

    All columns stay; the text of rows without spans is unchanged, and a null text stays null.
    """
    s = spans(cut(scan(docs)))
    w = Window.partitionBy("doc_id", "th").orderBy("start", F.col("end").desc(), "kind")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(F.coalesce(reach <= F.col("start"), F.lit(True)), 1).otherwise(0)).withColumn("g", F.sum("new").over(w))
    s = s.groupBy("doc_id", "th", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    per = s.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.upper("kind").alias("kind")))).alias("cuts"))
    d, p = docs.alias("d"), per.alias("p")
    both = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("p.th")), "left")
    # what is between the spans, in order, each piece made once
    text = F.expr("concat(array_join(transform(p.cuts, (c, i) -> concat(substr(d.text, if(i = 0, 0, p.cuts[greatest(i - 1, 0)].end) + 1, c.start - if(i = 0, 0, p.cuts[greatest(i - 1, 0)].end)), '[', c.kind, ']')), ''), substr(d.text, element_at(p.cuts, -1).end + 1))")
    own = {c: F.col(f"d.`{c}`") for c in docs.columns}
    own["text"] = F.when(F.col("p.cuts").isNotNull() & F.col("d.text").isNotNull(), text).otherwise(F.col("d.text"))
    return both.select(*(x.alias(c) for c, x in own.items()))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered spans of every whole text of documents, as personal_data."""
    ship(spark)
    return personal_data(table(spark, sf_dir, "documents"))
