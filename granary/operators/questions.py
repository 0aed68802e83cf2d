"""Many questions at once: a table of them is answered by a constant number of passes over the corpus.

The words of all questions are joined with the places of words in the texts, so that what the passes keep is bound to what was
asked. Each alternative of a question finds its candidates by its rarest word and is then checked on all of its words by
equi-joins on (word, document): no question is tried against every text, and nothing of them is on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .search import B, K1, corpus_stats, parse_query, ranked

#: Words of all questions up to which they are sent to every task; more are joined by key.
FEW = 100_000

_TOKEN = re.compile("[a-z0-9]+")


def occurrences(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, word, at, len): the positions, from 1, of each word of a document, and how many words it has.

    A document's words are gathered where it is read; nothing is shuffled.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "word", "at", "len"]

        def out(ids: list, found: list) -> pa.RecordBatch:
            own, word, at, n = zip(*found) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([ids_of.take(pa.array(own, pa.int64())), pa.array(word, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.int32())], names)

        for b in batches:
            ids_of, found, held = b.column(0), [], 0
            for i, t in enumerate(b.column(1)):
                places: dict[str, list[int]] = {}
                for p, m in enumerate(_TOKEN.finditer(t.as_py() or ""), 1):
                    places.setdefault(m[0], []).append(p)
                n = sum(map(len, places.values()))
                found += [(i, w, at, n) for w, at in places.items()]
                held += n
                if held > 1 << 18:
                    yield out(ids_of, found)
                    found, held = [], 0
            yield out(ids_of, found)

    return docs.select(F.col(id).alias("id"), F.lower(text).alias("t")).mapInArrow(run, f"id {kind}, word string, at array<int>, len int")


def asked_places(docs: DataFrame, id: str, text: str, asked: dict[str, bool]) -> DataFrame:
    """(id, word, len, tf, at, docs, texts, words) for the words of `asked`, with their positions, from 1, where asked says so.

    What else a document says stays in the task that reads it. Each batch also gives a row without a word: its number of
    documents, those without id or text too, of texts, and of their words.
    """
    kind = docs.schema[id].dataType.simpleString()
    # `asked` has FEW words at most
    wanted = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, placed = ["id", "word", "len", "tf", "at", "docs", "texts", "words"], wanted.value
        keys = frozenset(placed)

        def out(ids: pa.Array, found: list, *sums: int) -> pa.RecordBatch:
            own, *cols = zip(*found, *[[None] * 5] * bool(sums)) if found or sums else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            last = [pa.array([None] * len(found) + [x], pa.int64()) for x in sums] or [pa.nulls(len(found), pa.int64())] * 3
            return pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds)), *last], names)

        for b in batches:
            ids, hits, held, texts, total = b.column(0), [], 0, 0, 0
            named = ids.is_valid().to_pylist()
            for i, t in enumerate(b.column(1)):
                if (t := t.as_py()) is None:
                    continue
                found = _TOKEN.findall(t)
                n = len(found)
                texts, total = texts + 1, total + n
                have = keys.intersection(found) if named[i] else ()
                if len(have) <= 4 and not any(placed[w] for w in have):
                    hits += [(i, w, n, found.count(w), None) for w in have]
                else:
                    places: dict[str, list[int]] = {w: [] for w in have}
                    for p, w in enumerate(found, 1):
                        if w in places:
                            places[w].append(p)
                    hits += [(i, w, n, len(at), at if placed[w] else None) for w, at in places.items()]
                    held += sum(map(len, places.values()))
                held += len(have)
                if held > 1 << 18:
                    yield out(ids, hits)
                    hits, held = [], 0
            yield out(ids, hits, len(ids), texts, total)

    return docs.select(F.col(id).alias("id"), F.lower(text).alias("t")).mapInArrow(run, f"id {kind}, word string, len int, tf int, at array<int>, docs long, texts long, words long")


def terms_of(questions: DataFrame) -> DataFrame:
    """(qid, alt, must, phrase, place, token) of questions (qid, question) in web-search syntax: a row for each word."""
    kind = questions.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, text in zip(pdf["qid"], pdf["question"]):
                for alt, (must, never) in enumerate(parse_query(text or "").any_of):
                    for wanted, phrases in ((True, must), (False, never)):
                        out += [(qid, alt, wanted, i, j, w) for i, p in enumerate(phrases) for j, w in enumerate(p)]
            yield pd.DataFrame(out, columns=["qid", "alt", "must", "phrase", "place", "token"])

    return questions.select("qid", "question").where("qid is not null").mapInPandas(run, f"qid {kind}, alt int, must boolean, phrase int, place int, token string")


def bm25_many(corpus: DataFrame, questions: DataFrame, k: int | None, id: str = "id", text: str = "content") -> DataFrame:
    """(qid, id, score, rank): for each of questions (qid, question) what `bm25` gives for it, the k best with ties by id.

    One pass over the texts finds the places of the words asked for, and the corpus statistics; with more than FEW words these
    are joined by key, and the statistics are a pass of their own. Questions without
    a required word have no rows; a qid that stands twice is one question of more alternatives.
    """
    shared_dir(corpus.sparkSession)
    terms = terms_of(questions).checkpoint()
    few = terms.count() <= FEW
    phrase = ("qid", "alt", "must", "phrase")
    long = terms.groupBy(*phrase).agg(F.count("*").alias("n")).checkpoint()
    # places are kept for the words of longer phrases alone
    asked = terms.join(long, list(phrase)).groupBy(F.col("token").alias("word")).agg(F.max(F.col("n") > 1).alias("placed"))
    if few:
        met = asked_places(corpus, id, text, {r["word"]: r["placed"] for r in asked.collect()}).checkpoint()
        own = met.where("word is not null").select("word", "id", "len", "tf", "at")
        stats = met.where("word is null").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), (F.sum("words") / F.nullif(F.sum("texts"), F.lit(0))).alias("avg_len"))
    else:
        own = occurrences(corpus.where(F.col(id).isNotNull()), id, text).join(asked, "word")
        own = own.select("word", "id", "len", F.size("at").alias("tf"), F.when(F.col("placed"), F.col("at")).alias("at")).checkpoint()
        stats = corpus_stats(corpus, text)
    df = own.groupBy("word").agg(F.count("*").alias("df"))

    # candidates: an alternative has none if one of its words stands nowhere
    needed = terms.where("must").join(df, F.col("token") == F.col("word"), "left")
    rare = needed.groupBy("qid", "alt").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r")).where("r.df > 0")
    found = rare.select("qid", "alt", F.col("r.token").alias("word")).join(own.select("word", "id"), "word").select("qid", "alt", "id")

    # a word holds where it stands; a phrase where its words' places, each less its own in the phrase, have one in common
    at = own.select(F.col("word").alias("token"), "id", "at")
    met = found.join(terms, ["qid", "alt"]).join(at, ["token", "id"]).join(F.broadcast(long) if few else long, list(phrase))
    met = met.withColumn("from", F.when(F.col("n") > 1, F.transform("at", lambda p: p - F.col("place"))))
    common = F.aggregate("all", F.get("all", 0), lambda s, x: F.array_intersect(s, x))
    held = met.groupBy(*phrase, "id").agg(F.count_distinct("place").alias("have"), F.max("n").alias("n"), F.collect_list("from").alias("all")).where("have = n").where((F.col("n") == 1) | (F.size(common) > 0))
    wanted = terms.where("must").groupBy("qid", "alt").agg(F.count_distinct("phrase").alias("n"))
    per = held.groupBy("qid", "alt", "id").agg(F.count_if("must").alias("yes"), F.count_if(~F.col("must")).alias("no"))
    hits = per.join(wanted, ["qid", "alt"]).where("yes = n and no = 0").select("qid", "id").distinct()

    # all required words of a question count, whichever alternative holds
    tf = F.col("tf")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    words = terms.where("must").select("qid", F.col("token").alias("word")).distinct()
    parts = hits.join(words, "qid").join(own, ["word", "id"]).join(df, "word").crossJoin(F.broadcast(stats)).select("qid", "id", "word", part.alias("s"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("word", "s"))), F.lit(0.0), lambda s, x: s + x["s"])
    return ranked(parts.groupBy("qid", "id").agg(total.alias("score")), k)
