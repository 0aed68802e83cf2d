"""Operators over a property graph kept as two tables: nodes (project_id, id, label, ...) and edges (project_id, src, dst, relation, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import conform, latest
from ..session import shared_dir


def load_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """The tables after a project's graph is replaced. Edges need both ends; nodes of one id are reduced to the first by line."""
    n = conform(new_nodes.withColumn("project_id", F.lit(project_id)), "graph_nodes")
    n = latest(n, ("project_id", "id"), [F.col("start_line").asc_nulls_last(), F.xxhash64("id", "label", "signature")])
    e = conform(new_edges.withColumn("project_id", F.lit(project_id)), "graph_edges").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    keep = lambda df: df.where(F.col("project_id") != project_id)
    return keep(nodes).unionByName(n), keep(edges).unionByName(with_both_ends(e, n))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def callers(nodes: DataFrame, edges: DataFrame, id: str, relation: str = "CALLS") -> DataFrame:
    """Nodes with an edge to `id`: the edge filter goes to the scan, nodes meet few edges."""
    hit = edges.where((F.col("dst") == id) & (F.col("relation") == relation)).select(F.col("src").alias("id")).distinct()
    return nodes.join(hit, "id")


def callees(nodes: DataFrame, edges: DataFrame, id: str, relation: str = "CALLS") -> DataFrame:
    hit = edges.where((F.col("src") == id) & (F.col("relation") == relation)).select(F.col("dst").alias("id")).distinct()
    return nodes.join(hit, "id")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, e, relation): every edge in both directions; a loop once."""
    e = edges.select("src", "dst", "relation", F.xxhash64("src", "dst", "relation").alias("e"))
    back = e.where("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), "e", "relation")
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "e", "relation").unionByName(back)


#: Parts over which the edges of each node are dealt where walks are joined to them, so that a hub is many tasks.
DEALT = 16


def _steps(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(u, v, e, relation): the edges that touch the nodes in at (at), in both directions, a loop once.

    Parallel edges are edges of their own: copies of one (src, dst, relation) are numbered, and which copy has which number
    does not matter, so levels agree on them.
    """
    near = at.distinct()
    own = edges.select("src", "dst", "relation")
    touched = own.join(near, F.col("src") == F.col("at"), "left_semi").unionByName(own.join(near, F.col("dst") == F.col("at"), "left_semi").join(near, F.col("src") == F.col("at"), "left_anti"))
    copies = touched.groupBy("src", "dst", "relation").agg(F.count("*").cast("int").alias("n"))
    one = copies.select("src", "dst", "relation", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("e", F.xxhash64("src", "dst", "relation", "k"))
    back = one.where("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), "e", "relation")
    return one.select(F.col("src").alias("u"), F.col("dst").alias("v"), "e", "relation").unionByName(back)


def _walked(now: DataFrame, steps: DataFrame) -> DataFrame:
    """now (seed, at, path) one edge further: (seed, v, path, relation). A node's edges are dealt over DEALT parts and each walk goes to all of them."""
    left = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    right = steps.withColumn("_part", F.pmod("e", F.lit(DEALT)).cast("int"))
    step = left.join(right, (F.col("at") == F.col("u")) & (F.col("part") == F.col("_part")))
    return step.where(~F.array_contains("path", F.col("e"))).select("seed", "v", F.array_append("path", F.col("e")).alias("path"), "relation")


def trails(edges: DataFrame, start: DataFrame, depth: int) -> list[DataFrame]:
    """By length 1 .. depth: (seed, v, path, relation), one row for each walk from a seed (seed) that repeats no edge.

    Joins from the seeds outward: each starts from the rows of the last, so edges far from the seeds are not expanded.
    """
    out: list[DataFrame] = []
    now = start.select("seed", F.col("seed").alias("at"), F.array().cast("array<bigint>").alias("path"))
    for _ in range(depth):
        step = _walked(now, _steps(edges, now.select("at")))
        out.append(step)
        now = step.select("seed", F.col("v").alias("at"), "path")
    return out


def entity_context(nodes: DataFrame, edges: DataFrame, id: str, depth: int = 2, limit: int = 50) -> DataFrame:
    """(connected_id, label, relationship, distance): the first `limit` ends of walks from `id` that repeat no edge, nearest first, then by id and relation.

    A level is walked only while the nearer ones have fewer than `limit` rows, and of each level `limit` rows are kept.
    """
    shared_dir(edges.sparkSession)
    now = edges.sparkSession.createDataFrame([(id,)], f"seed {edges.schema['src'].dataType.simpleString()}").select("seed", F.col("seed").alias("at"), F.array().cast("array<bigint>").alias("path"))
    labels, found, held = nodes.select(F.col("id").alias("v"), "label"), None, 0
    order = ("distance", "connected_id", "relationship")
    for d in range(1, depth + 1):
        step = _walked(now, _steps(edges, now.select("at")))
        if d < depth:
            step = step.checkpoint()
        rows = step.join(labels, "v").select(F.col("v").alias("connected_id"), "label", F.col("relation").alias("relationship"), F.lit(d).cast("long").alias("distance"))
        rows = rows.orderBy(*order).limit(limit - held)
        if d < depth:
            rows = rows.checkpoint()
            held += rows.count()
        found = rows if found is None else found.unionByName(rows)
        if held >= limit:
            break
        now = step.select("seed", F.col("v").alias("at"), "path")
    return found.orderBy(*order).limit(limit)


def proximity(edges: DataFrame, seeds: list[str] | DataFrame, limit: int = 20, depth: int = 3) -> DataFrame:
    """seeds: ids, or a table (seed) of any size. (id, score = 1 / (least distance + 1)) of nodes on trails of up to `depth` edges from any seed, undirected.

    Distances are found level by level; a level keeps a (seed, node) once. A seed itself counts if another seed or a closed
    trail reaches it: a loop, two parallel edges, or a triangle.
    """
    kind = edges.schema["src"].dataType.simpleString()
    start = (seeds.select("seed") if isinstance(seeds, DataFrame) else edges.sparkSession.createDataFrame([(s,) for s in seeds], f"seed {kind}")).distinct()
    both = _both_ways(edges)
    first = start.join(both, F.col("seed") == F.col("u")).select("seed", "v", "e")
    loops = first.where("v = seed").select("seed", "v", F.lit(1).alias("d"))
    level = first.where("v <> seed").select("seed", "v", "e").distinct()
    reached = level.select("seed", "v", F.lit(1).alias("d")).distinct()
    # closed trails of 2: two different edges to one neighbour; of 3: an edge between two neighbours
    pairs = level.groupBy("seed", "v").agg(F.count_distinct("e").alias("n")).where("n > 1").select("seed", F.col("seed").alias("v"), F.lit(2).alias("d"))
    a, b = level.select("seed", "v").distinct().alias("a"), level.select("seed", "v").distinct().alias("b")
    inner = both.where("u <> v").alias("m")
    tri = a.join(inner, F.col("a.v") == F.col("m.u")).join(b, (F.col("b.seed") == F.col("a.seed")) & (F.col("b.v") == F.col("m.v"))).select(F.col("a.seed").alias("seed"), F.col("a.seed").alias("v"), F.lit(3).alias("d")).distinct()
    closed = [x for x, d in ((loops, 1), (pairs, 2), (tri, 3)) if d <= depth]
    seen, front, found = start.select("seed", F.col("seed").alias("v")), reached.select("seed", "v"), [reached]
    for d in range(2, depth + 1):
        seen = seen.unionByName(front)
        front = front.withColumnRenamed("v", "at").join(both, F.col("at") == F.col("u")).select("seed", "v").distinct().join(seen, ["seed", "v"], "left_anti")
        found.append(front.select("seed", "v", F.lit(d).alias("d")))
    rows = found[0]
    for x in [*found[1:], *closed]:
        rows = rows.unionByName(x)
    out = rows.groupBy(F.col("v").alias("id")).agg(F.min("d").alias("d"))
    return out.select("id", (F.lit(1.0) / (F.col("d") + 1)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def personalised_pagerank(edges: DataFrame, seeds: list[str], damping: float = 0.85, iterations: int = 20, limit: int | None = 20, cut=None) -> DataFrame:
    """(id, score): r = (1 - damping) * p + damping * sum of r(src) * w / W(src), for a fixed number of rounds.

    The shares are made once; ranks are small and move. `cut` keeps the shares and ends the lineage every few rounds
    (DataFrame.checkpoint, by default when the session has a checkpoint folder).
    """
    spark = edges.sparkSession
    cut = cut or ((lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df))
    total = Window.partitionBy("src")
    share = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).withColumn("share", F.col("w") / F.sum("w").over(total)).select("src", "dst", "share"))
    kind = edges.schema["src"].dataType.simpleString()
    p = spark.createDataFrame([(s, 1.0 / len(seeds)) for s in seeds], f"id {kind}, p double")
    rank = p.select("id", F.col("p").alias("r"))
    for i in range(iterations):
        sent = share.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("r") * F.col("share")).alias("s"))
        rank = sent.join(p, F.col("dst") == F.col("id"), "full").select(F.coalesce("dst", "id").alias("id"), ((1 - damping) * F.coalesce("p", F.lit(0.0)) + damping * F.coalesce("s", F.lit(0.0))).alias("r"))
        if i % 4 == 3:
            rank = cut(rank)
    out = rank.select("id", F.col("r").alias("score")).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def push_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, error: float = 1e-6, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(set, id, score) and (set, residual): personalised ranks for each seed set of seeds (set, id), by forward push.

    Each set begins with residuals of 1 / its size on its seeds. A round takes every residual above `error`, keeps its share
    1 - damping as score and passes the rest on along the edges by weight; a node without edges gives it back to the seeds.
    It ends when no residual is above `error` or after `rounds`. No score is less than the true rank by more than its set's
    residual, and none is more. Sets are rows: work follows what is pushed, and a hub's edges are a join that Spark can split.
    """
    shared_dir(edges.sparkSession)
    out = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).where("w > 0")
    total = out.groupBy("src").agg(F.sum("w").alias("t"))
    share = out.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("share")).checkpoint()
    seeds = seeds.select("set", "id").distinct()
    start = seeds.join(seeds.groupBy("set").agg(F.count("*").alias("n")), "set").select("set", "id", (1 / F.col("n")).alias("r")).checkpoint()
    left, kept = start, None
    for _ in range(rounds):
        hot = left.where(F.col("r") > error)
        if hot.isEmpty():
            break
        own = hot.select("set", "id", (F.col("r") * (1 - damping)).alias("p"))
        kept = own if kept is None else kept.unionByName(own)
        moved = hot.select("set", F.col("id").alias("src"), (F.col("r") * damping).alias("m"))
        passed = moved.join(share, "src").select("set", F.col("dst").alias("id"), (F.col("m") * F.col("share")).alias("r"))
        ends = moved.join(share.select("src").distinct(), "src", "left_anti").groupBy("set").agg(F.sum("m").alias("m"))
        back = start.join(ends, "set").select("set", "id", (F.col("r") * F.col("m")).alias("r"))
        rest = left.where(F.col("r") <= error)
        left = rest.unionByName(passed).unionByName(back).groupBy("set", "id").agg(F.sum("r").alias("r")).checkpoint()
        kept = kept.groupBy("set", "id").agg(F.sum("p").alias("p")).checkpoint()
    kept = kept if kept is not None else start.select("set", "id", F.lit(0.0).alias("p")).where("false")
    return kept.withColumnRenamed("p", "score"), left.groupBy("set").agg(F.sum("r").alias("residual"))


def node_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def resolve_targets(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) edges: a raw target becomes the id that it is, or that of the one node of its last name in the source's file, or of the one of that name anywhere.

    Unresolved edges have `owners`, how many nodes could be meant: 0 for names that no node has, more where it is ambiguous.
    Nodes are first reduced to a row a name, and a name and file, so an edge meets three rows at most however common its name is.
    """
    name, file = F.regexp_extract("dst", r"([^.:/]+)$", 1), F.regexp_extract("src", r"^(.*?)(?::[^:/]*)?$", 1)
    n = nodes.select("id", "name", "file_path").distinct()
    one = lambda *by: n.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    exact = n.select(F.col("id").alias("_exact")).distinct()
    near = one("name", "file_path").select(F.col("name").alias("_name"), F.col("file_path").alias("_file"), F.col("n").alias("_near"), F.col("id").alias("_near_id"))
    far = one("name").select(F.col("name").alias("_name"), F.col("n").alias("_far"), F.col("id").alias("_far_id"))
    e = edges.withColumns({"_name": name, "_file": file})
    met = e.join(exact, F.col("dst") == F.col("_exact"), "left").join(near, ["_name", "_file"], "left").join(far, "_name", "left")
    target = F.coalesce("_exact", F.when(F.col("_near") == 1, F.col("_near_id")), F.when(F.col("_near").isNull() & (F.col("_far") == 1), F.col("_far_id")))
    met = met.withColumn("_target", target)
    found = met.where("_target is not null").withColumn("dst", F.col("_target")).select(*edges.columns)
    return found, met.where("_target is null").select(*edges.columns, F.coalesce("_near", "_far", F.lit(0)).alias("owners"))


def graph_from_entities(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of code entities: labels capitalised, docstrings cut to 100 characters."""
    nodes = entities.select("id", F.initcap("entity_type").alias("label"), "name", "parent_class", "file_path", "start_line", "end_line", "language", "content_hash", F.substring("docstring", 1, 100).alias("docstring_summary"), "signature", "modifiers")
    return nodes, relations.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation", F.lit(1.0).alias("weight"))
