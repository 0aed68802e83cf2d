"""Libraries, their API elements and error patterns, with the edges between them. Each function returns the tables as they will be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import checked, conform, latest
from .tables import upsert


def library_id(ecosystem: str, name: str, version: str) -> str:
    return f"{ecosystem}:{name}:{version}"


def add_libraries(libraries: DataFrame, new: DataFrame) -> DataFrame:
    """By id, which is `ecosystem:name:version` where it is missing."""
    rows = conform(new, "libraries").withColumn("id", F.coalesce("id", F.concat_ws(":", "ecosystem", "name", "version")))
    return upsert(conform(libraries, "libraries"), checked(rows, "libraries"), ("id",))


def _edges(edges: DataFrame, new: DataFrame, project_id: str) -> DataFrame:
    """edges and the new ones (src, dst, relation), each once."""
    rows = conform(new.withColumns({"project_id": F.lit(project_id), "weight": F.lit(1.0)}), "graph_edges")
    both = conform(edges, "graph_edges").withColumn("_o", F.lit(0)).unionByName(rows.withColumn("_o", F.lit(1)))
    return latest(both, ("project_id", "src", "dst", "relation"), [F.col("_o")]).drop("_o")


def add_api_elements(elements: DataFrame, edges: DataFrame, new: DataFrame, libraries: DataFrame, project_id: str = "knowledge") -> tuple[DataFrame, DataFrame]:
    """(elements, edges): upserted by id, with a CONTAINS edge from the library where that exists."""
    rows = conform(new, "api_elements")
    known = rows.join(libraries.select(F.col("id").alias("library_id")), "library_id", "left_semi")
    links = known.select(F.col("library_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("relation"))
    return upsert(conform(elements, "api_elements"), rows, ("id",)), _edges(edges, links, project_id)


def add_error_patterns(patterns: DataFrame, edges: DataFrame, new: DataFrame, elements: DataFrame, project_id: str = "knowledge") -> tuple[DataFrame, DataFrame]:
    """(patterns, edges): upserted by id, with a RAISES edge from the API element where one is named and exists."""
    rows = conform(new, "error_patterns").withColumn("times_encountered", F.coalesce("times_encountered", F.lit(0)))
    known = rows.join(elements.select(F.col("id").alias("api_element_id")), "api_element_id", "left_semi")
    links = known.select(F.col("api_element_id").alias("src"), F.col("id").alias("dst"), F.lit("RAISES").alias("relation"))
    return upsert(conform(patterns, "error_patterns"), rows, ("id",)), _edges(edges, links, project_id)


def get(table: DataFrame, id: str) -> DataFrame:
    """The row of an id; the filter reaches the scan."""
    return table.where(F.col("id") == id).limit(1)


def by_file(chunks: DataFrame, source_file: str) -> DataFrame:
    return chunks.where(F.col("source_file") == source_file).orderBy("chunk_index")


def repo_map(nodes: DataFrame, project_id: str | None = None) -> DataFrame:
    """(file_path, entities): each file's entities in order of line, as `name (kind, line)`."""
    rows = nodes if project_id is None else nodes.where(F.col("project_id") == project_id)
    line = F.format_string("%s (%s, %d)", F.coalesce("signature", "name"), "label", "start_line")
    per = rows.where("file_path is not null").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", line.alias("text")))).alias("e"))
    return per.select("file_path", F.transform("e", lambda x: x["text"]).alias("entities"))
