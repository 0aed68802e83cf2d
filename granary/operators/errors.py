"""Error lookup: exact or by a regular expression that a column holds, and by trigram similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import literals
from ..functions.text import trigram_similarity, trigrams
from ..session import shared_dir


def lookup_similar(patterns: DataFrame, message: str, exception_type: str | None = None, language: str | None = None, limit: int = 5, least: float = 0.3) -> DataFrame:
    """patterns whose message_pattern is similar to the message by more than `least`, best first; null parameters filter nothing."""
    rows = patterns
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if exception_type is not None:
        rows = rows.where(F.col("exception_type") == exception_type)
    sim = trigram_similarity(trigrams("message_pattern"), trigrams(F.lit(message)))
    return rows.withColumn("similarity", sim).where(F.col("similarity") > least).orderBy(F.desc("similarity"), "id").limit(limit)


def message_hit(message: Column, pattern: Column | str = "message_pattern", regex: Column | str = "message_regex") -> tuple[Column, Column]:
    """(equal to the pattern, full match of the regular expression) for a message column."""
    p, r = (F.col(x) if isinstance(x, str) else x for x in (pattern, regex))
    return F.coalesce(message == p, F.lit(False)), F.coalesce(F.regexp_like(message, F.concat(F.lit("^(?:"), r, F.lit(")$"))), F.lit(False))


def lookup_exact(patterns: DataFrame, api_elements: DataFrame, libraries: DataFrame, message: str, exception_type: str | None = None, language: str | None = None, limit: int = 5) -> DataFrame:
    """Patterns equal to the message or whose expression matches all of it, with element and library; equal ones first."""
    exact, full = message_hit(F.lit(message))
    rows = patterns.withColumn("exact", exact).where(F.col("exact") | full)
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if exception_type is not None:
        rows = rows.where(F.col("exception_type") == exception_type)
    a = api_elements.select(F.col("id").alias("api_element_id"), F.col("name").alias("api_element"), F.col("library_id").alias("_lib"))
    lib = libraries.select(F.col("id").alias("_lib"), F.col("name").alias("library"))
    out = rows.join(a, "api_element_id", "left").join(lib, "_lib", "left").drop("_lib")
    return out.orderBy(F.when(F.col("exact"), 0).otherwise(1), "id").limit(limit)


#: Most rows of a side of a join that is sent to every task; a larger one meets the other by a shuffle of both.
FEW = 10_000


def _meet(rows: DataFrame, n: int, few: int) -> DataFrame:
    """rows as a side of a join: broadcast where they are few; else neither side is, though a file's size may make it look small."""
    return F.broadcast(rows) if n <= few else rows.hint("merge")


def match_messages(messages: DataFrame, patterns: DataFrame, most_patterns: int = 100_000, few: int = FEW) -> DataFrame:
    """(message_id, pattern_id, exact) for a table of messages (message_id, message) against patterns.

    Equal messages meet in an equi-join. Expressions meet distinct texts, and what matches is then joined with the rows of
    both. An expression is read for trigrams that its matches must contain; it meets the texts that have the rarest of
    them, by key, and is only run on these. Expressions that require none are the rest: broadcast in blocks of about
    `most_patterns`, tried on every text. An expression that is null matches nothing. Messages are never broadcast.
    """
    shared_dir(messages.sparkSession)
    p = patterns.select(F.col("id").alias("pattern_id"), "message_pattern", "message_regex").checkpoint()
    known = p.count()
    equal = messages.join(_meet(p, known, few), F.col("message") == F.col("message_pattern")).select("message_id", "pattern_id", F.lit(True).alias("exact"))
    rx = p.where("message_regex is not null").select("message_regex").distinct().withColumn("alts", _required("message_regex")).checkpoint()
    full = F.regexp_like(F.col("message"), F.concat(F.lit("^(?:"), F.col("message_regex"), F.lit(")$")))

    # by key: each alternative is met where its rarest trigram is
    keyed = rx.where(F.size("alts") > 0).select("message_regex", F.posexplode("alts").alias("alt", "grams"))
    words = messages.where("message is not null").select("message").distinct()
    texts = words.select("message", _grams(F.col("message")).alias("grams")).select("message", F.explode("grams").alias("gram"))
    asked = keyed.select(F.explode("grams").alias("gram")).distinct()
    held = texts.select("gram").join(_meet(asked, known, few), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    each = keyed.select("*", F.explode("grams").alias("gram")).join(_meet(held, known, few), "gram", "left")
    rare = each.groupBy("message_regex", "alt").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"), F.first("grams").alias("all")).where("r.n > 0")
    met = _meet(rare.select("message_regex", "all", F.col("r.gram").alias("gram")), known, few).join(texts, "gram")
    # the other trigrams first: looking for one is cheaper than running an expression
    has = F.forall("all", lambda g: F.concat(F.lit(literals.START), F.col("message")).contains(g))
    found = met.where(has & full).select("message", "message_regex").distinct()

    rest = rx.where(F.size("alts") == 0).select("message_regex")
    n = rest.count()
    blocks = -(-n // most_patterns)
    for i in range(blocks):
        own = rest if blocks == 1 else rest.where(F.pmod(F.xxhash64("message_regex"), F.lit(blocks)) == i)
        found = found.unionByName(words.join(F.broadcast(own), full).select("message", "message_regex"))

    found = found.checkpoint()
    pairs = messages.join(_meet(found, found.count(), few), "message").join(_meet(p, known, few), "message_regex")
    like = pairs.where(~F.coalesce(F.col("message") == F.col("message_pattern"), F.lit(False)))
    return equal.unionByName(like.select("message_id", "pattern_id", F.lit(False).alias("exact")))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _required_of(regex: pd.Series) -> pd.Series:
    return regex.map(literals.required)


def _required(regex: str) -> Column:
    return F.coalesce(_required_of(F.col(regex)), F.array().cast("array<array<string>>"))


def _grams(text: Column) -> Column:
    """Distinct trigrams of START and the text; those of a text of one character or none are not needed by any expression."""
    t = F.concat(F.lit(literals.START), text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def similarity_join(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """(left_id, right_id, similarity > least) of (id, text) tables by trigram sets, without a cross join.

    Prefix filter: sets at Jaccard similarity above t share one of the rarest n - ceil(t * n) + 1 trigrams of each. Trigrams
    are ordered by how often they occur, the candidates meet on these few, if their sizes allow it, and are verified on the sets.
    """
    sets = [d.select("id", trigrams("text").alias("t")).where(F.size("t") > 0) for d in (left, right)]
    freq = sets[0].select(F.explode("t").alias("g")).unionByName(sets[1].select(F.explode("t").alias("g"))).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(s: DataFrame) -> DataFrame:
        e = s.select("id", F.size("t").alias("n"), F.explode("t").alias("g")).join(freq, "g")
        r = e.groupBy("id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
        return r.select("id", "n", F.explode(F.slice(F.col("o"), F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))).alias("x")).select("id", "n", F.col("x.g").alias("g"))

    a, b = prefix(sets[0]).withColumnsRenamed({"id": "left_id", "n": "ln"}), prefix(sets[1]).withColumnsRenamed({"id": "right_id", "n": "rn"})
    pairs = a.join(b, "g").where(F.least("ln", "rn") > F.lit(least) * F.greatest("ln", "rn")).select("left_id", "right_id").distinct()
    both = pairs.join(sets[0].select(F.col("id").alias("left_id"), F.col("t").alias("lt")), "left_id").join(sets[1].select(F.col("id").alias("right_id"), F.col("t").alias("rt")), "right_id")
    return both.select("left_id", "right_id", trigram_similarity(F.col("lt"), F.col("rt")).alias("similarity")).where(F.col("similarity") > least)
