"""A Merkle manifest of a dataset: one tree of three-way runs for each source, one over the sources' roots.

Rows become leaves by built-in expressions; texts travel no further. A distributed sort numbers the leaves of each source, and
aligned blocks of 3**HEIGHT leaves are dealt out by (source, block), so a source of any size is many tasks. Block roots are
leaves of the next pass, until each source and then the dataset has one. On the way back down every block gets the proof of
its root as one row ahead of its leaves, and a fractal traversal emits its authentication paths: stacked subtrees of WIDTH
levels, on each layer an existing one that paths are read from and a desired one, to its right, that grows by a leaf a step.

Order is by key, then by leaf (null keys and null sources first), so repeated rows, and rows that share a key, each have a
place; they are interchangeable where they are equal. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, ship, table, tasks

#: Nodes of a run, levels of a block (6561 leaves), levels of a stacked subtree.
RUN, HEIGHT, WIDTH = 3, 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- one block ------------------------------------------------------------------------------------------------------


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(n: int) -> int:
    """How often runs must be hashed until one of n nodes remains."""
    k = 0
    while n > 1:
        n, k = -(-n // RUN), k + 1
    return k


def root_of(digests: list[str], levels: int) -> str:
    for _ in range(levels):
        digests = [node(digests[i : i + RUN]) for i in range(0, len(digests), RUN)]
    return digests[0]


class Subtree:
    """Nodes of the levels low .. high-1 under one node of level `high`, grown leaf by leaf from the leaf level up."""

    def __init__(self, leaf: Callable[[int], str], n: int, low: int, high: int, index: int) -> None:
        self.leaf, self.low, self.high = leaf, low, high
        self.at = self.first = index * RUN**high
        self.end = min(self.first + RUN**high, n)
        self.rows: list[list[str]] = [[] for _ in range(high - low)]
        self.open: list[list[str]] = [[] for _ in range(high)]

    def grow(self) -> None:
        """Takes in the next leaf, if one is left; the last one closes runs that stay short."""
        if self.at < self.end:
            self._put(0, self.leaf(self.at))
            self.at += 1
            if self.at == self.end:
                for level in range(self.high - 1):
                    self._close(level)

    def _close(self, level: int) -> None:
        if run := self.open[level]:
            self.open[level] = []
            self._put(level + 1, node(run))

    def _put(self, level: int, digest: str) -> None:
        if level >= self.low:
            self.rows[level - self.low].append(digest)
        if level < self.high - 1:
            self.open[level].append(digest)
            if len(self.open[level]) == RUN:
                self._close(level)

    def run(self, level: int, x: int) -> tuple[int, list[str]]:
        """Place in its run, and the run's other nodes, of leaf x's ancestor on a level."""
        j = (x - self.first) // RUN**level
        run = self.rows[level - self.low][j // RUN * RUN : j // RUN * RUN + RUN]
        return j % RUN, run[: j % RUN] + run[j % RUN + 1 :]


Path = list[tuple[int, list[str]]]


def paths(leaf: Callable[[int], str], n: int, levels: int) -> Iterator[Path]:
    """The authentication path of each of n leaves in turn: (place in the run, siblings) level by level.

    `leaf` gives the digest of any leaf. Beside it, memory holds two subtrees a layer, whatever n is.
    """
    layers = [(low, min(low + WIDTH, levels)) for low in range(0, levels, WIDTH)]
    exist = [Subtree(leaf, n, low, high, 0) for low, high in layers]
    for s in exist:
        while s.at < s.end:
            s.grow()
    desired = [Subtree(leaf, n, low, high, 1) for low, high in layers]
    for x in range(n):
        yield [exist[level // WIDTH].run(level, x) for level in range(levels)]
        for i, (low, high) in enumerate(layers):
            desired[i].grow()
            if (x + 1) % RUN**high == 0:
                exist[i], desired[i] = desired[i], Subtree(leaf, n, low, high, (x + 1) // RUN**high + 1)


def fold(digest: str, path: Path) -> str:
    """The root that a leaf and its path lead to."""
    for place, others in path:
        digest = node([*others[:place], digest, *others[place:]])
    return digest


def pack(path: Path) -> str:
    return ";".join(",".join([str(place), *others]) for place, others in path)


def unpack(s: str) -> Path:
    return [(int(place), others) for place, *others in (x.split(",") for x in s.split(";"))] if s else []


# --- on DataFrames --------------------------------------------------------------------------------------------------


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: `-` for a null, else the value's length in UTF-8 bytes, a colon and the value, for each field in turn."""
    parts = []
    for c in columns.values():
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos and total, the place in a tree and its size: a sort by ranges, in which a tree may span many.

    Only the first rows of a range can belong to a tree that began before, so what is joined is a row for each pair of tree and range.
    """
    place = F.monotonically_increasing_id()
    sorted_ = rows.repartitionByRange(tasks(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    sorted_ = cut(sorted_.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")))
    w = Window.partitionBy("tree")
    runs = sorted_.groupBy("tree", "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("from")).alias("shift"), F.sum("n").over(w).alias("total"))
    both = sorted_.join(runs, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return both.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks of a tree dealt out and each in order; a block is all in one task, and that is 3**HEIGHT rows at most."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other; the first two columns name it."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if (key := (r["tree"], r["block"])) != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append(r)
    if rows:
        yield rows


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield make()
            held = []
    yield make()


def _block(height: int) -> str:
    return f"pos div {RUN**height} AS block"


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, total, digest) of the blocks' roots. A block of a tree of several is hashed to its full height, however few leaves it has."""
    size = RUN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((r[0]["tree"], r[0]["block"], -(-r[0]["total"] // size), root_of([x["digest"] for x in r], min(height, levels_of(r[0]["total"])))) for r in _blocks(batches))
        yield from _batches(found, [pa.string(), pa.int64(), pa.int64(), pa.string()], ["tree", "pos", "total", "digest"])

    return _dealt(nodes.selectExpr("tree", _block(height), "pos", "total", "digest")).mapInArrow(run, "tree string, pos long, total long, digest string")


def _levels(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """The passes from nodes up to one root for each tree of at most `most` nodes."""
    out = [nodes]
    while True:
        out.append(cut(_climb(out[-1], height)))
        most = -(-most // RUN**height)
        if most <= 1:
            return out


def _traversed(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """nodes, each behind the row of its block in upper (tree, block, path, subroot, root): no row is sent its block's proof."""
    ahead = upper.withColumn("pos", F.lit(-1).cast("long"))
    return _dealt(nodes.selectExpr("*", _block(height)).unionByName(ahead, allowMissingColumns=True))


def _descend(nodes: DataFrame, upper: DataFrame, own: bool, height: int) -> DataFrame:
    """upper rows for the blocks that nodes are roots of; with `own`, a node is the root of a source."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for head, *rows in _blocks(batches):
            rest = f";{head['path']}" if head["path"] else ""
            for r, path in zip(rows, paths(lambda i: rows[i]["digest"], len(rows), min(height, levels_of(rows[0]["total"])))):
                yield r["to_tree"], r["to_block"], (pack(path) + rest).removeprefix(";"), r["digest"] if own else head["subroot"], head["root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(found(batches), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], ["tree", "block", "path", "subroot", "root"])

    return _traversed(nodes, upper, height).mapInArrow(run, "tree string, block long, path string, subroot string, root string")


def manifest(docs: DataFrame, tampered: Column | None = None, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text", with_paths: bool = False, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each of docs; with_paths adds `path`.

    A path lists levels by `;`, each its place in the run and the siblings by `,`; `unpack` and `fold` check it. tampered, a
    condition on docs: where true, the folded leaf is of the text without its line feeds. height: levels of a block.
    """
    cols = {f: docs[f] for f in fields}
    broken = leaf({**cols, text: F.replace(docs[text], F.lit("\n"), F.lit(""))})
    own = leaf(cols)
    rows = docs.select(docs[group].cast("string").alias("tree"), docs[key].alias("key"), own.alias("digest"), F.when(tampered, F.nullif(broken, own)).alias("tampered") if tampered is not None else F.lit(None).cast("string").alias("tampered"))
    rows = cut(rows).withColumn("row", F.monotonically_increasing_id())  # splits what is equal in all else
    leaves = _positions(rows, "key", "digest", "row").drop("row")
    sizes = leaves.agg(F.max("total")).first()[0]
    passes = _levels(leaves, sizes or 0, height)
    sources = _positions(passes[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("to_tree"), F.lit(0).cast("long").alias("to_block"), "digest"), "to_tree")
    tops = _levels(sources, sources.count(), height)
    upper = tops[-1].select("tree", F.col("pos").alias("block"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    onward = lambda df: df.select("*", F.col("tree").alias("to_tree"), F.col("pos").alias("to_block"))
    for level in tops[-2:0:-1]:
        upper = _descend(onward(level), upper, False, height)
    upper = _descend(sources, upper, True, height)
    for level in passes[-2:0:-1]:
        upper = _descend(onward(level), upper, False, height)
    kind = docs.schema[key].dataType
    more = [("path", pa.string())] if with_paths else []

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for head, *rows in _blocks(batches):
            above = unpack(head["path"])
            for r, below in zip(rows, paths(lambda i: rows[i]["digest"], len(rows), min(height, levels_of(rows[0]["total"])))):
                path = below + above
                folded = fold(r["tampered"] or r["digest"], path)
                proof = hashlib.sha256("".join(x for _, others in path for x in others).encode()).hexdigest()
                yield r["key"], r["digest"], head["subroot"], head["root"], proof, folded, folded == head["root"], *([pack(path)] if with_paths else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(n for n, _ in more)]
        return _batches(found(batches), [to_arrow_type(kind), *[pa.string()] * 5, pa.bool_(), *(k for _, k in more)], names)

    out = _traversed(leaves, upper, height).mapInArrow(run, f"key {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + "".join(f", {n} string" for n, _ in more))
    return out.withColumnRenamed("key", key)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents under one root; where crc32(doc_id) is even, the folded leaf is of the text without line feeds."""
    ship(spark)
    return manifest(table(spark, sf_dir, "documents"), crc_mod("doc_id", 2) == 0)


_ENC = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_ENC.format(f) for f in FIELDS) + ")"
_BROKEN = "sha256(" + " || ".join(_ENC.format("replace(text, chr(10), '')" if f == "text" else f) for f in FIELDS) + ")"

OP11_SQL = f"""
WITH RECURSIVE
bits AS (SELECT doc_id, string_split(CAST(doc_id AS VARCHAR), '') AS s FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
crc AS (
  SELECT doc_id, s, 0 AS i, 0 AS b, 4294967295::BIGINT AS r FROM bits
  UNION ALL
  SELECT doc_id, s, CASE WHEN b = 7 THEN i + 1 ELSE i END, (b + 1) % 8,
    CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN b = 0 THEN xor(r, CAST(ascii(s[i + 1]) AS BIGINT)) ELSE r END AS x FROM crc WHERE i < len(s))),
even AS (SELECT doc_id FROM crc WHERE i = len(s) AND xor(r, 4294967295::BIGINT) % 2 = 0),
leaves AS (SELECT doc_id, source, {_LEAF} AS leaf, {_BROKEN} AS broken, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_LEAF}) - 1 AS pos FROM documents),
tree AS (
  SELECT source, 0 AS lvl, pos, leaf AS d, CAST(NULL AS VARCHAR[]) AS kids, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), list(d ORDER BY pos), (max(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3),
sub AS (SELECT source, d, lvl AS h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, d, CAST(NULL AS VARCHAR[]) AS kids, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), list(d ORDER BY pos), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
low AS (
  SELECT l.doc_id, l.leaf, l.source, 0 AS lvl, l.pos, CASE WHEN l.doc_id IN (SELECT doc_id FROM even) THEN l.broken ELSE l.leaf END AS f, '' AS p FROM leaves l
  UNION ALL
  SELECT a.doc_id, a.leaf, a.source, a.lvl + 1, a.pos // 3, sha256(array_to_string(list_transform(t.kids, lambda x, i: CASE WHEN i = a.pos % 3 + 1 THEN a.f ELSE x END), '')),
    a.p || array_to_string(list_filter(t.kids, lambda x, i: i <> a.pos % 3 + 1), '')
  FROM low a JOIN tree t ON t.source IS NOT DISTINCT FROM a.source AND t.lvl = a.lvl + 1 AND t.pos = a.pos // 3),
high AS (
  SELECT a.doc_id, a.leaf, s.d AS subroot, 0 AS lvl, s.pos, a.f, a.p FROM low a JOIN sub s ON s.source IS NOT DISTINCT FROM a.source AND s.h = a.lvl
  UNION ALL
  SELECT a.doc_id, a.leaf, a.subroot, a.lvl + 1, a.pos // 3, sha256(array_to_string(list_transform(t.kids, lambda x, i: CASE WHEN i = a.pos % 3 + 1 THEN a.f ELSE x END), '')),
    a.p || array_to_string(list_filter(t.kids, lambda x, i: i <> a.pos % 3 + 1), '')
  FROM high a JOIN top t ON t.lvl = a.lvl + 1 AND t.pos = a.pos // 3)
SELECT doc_id, leaf, subroot, t.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.d AS verified FROM high JOIN top t ON t.n = 1 AND t.lvl = high.lvl
"""
