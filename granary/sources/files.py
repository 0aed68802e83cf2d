"""Files as rows: scans with exclusions, type detection, parsing into documents, sections, chunks and code entities.

A file that can't be parsed becomes a row with `error`; it never ends the scan.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import CODE_EXTENSION_LANGUAGE, detect_code_language, glob_regex, suffix
from . import code, html, markdown
from .chunks import Chunk, ChunkConfig, chunk_sections

# Extensions of document types, folders that code scans leave out.
DOCUMENT_TYPES = {".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".rest": "rst", ".pdf": "pdf", ".txt": "text"}
CODE_EXCLUDED = ("__pycache__", "node_modules", ".git")

SECTIONS = "array<struct<header:string,header_level:int,header_path:string,content:string,start_line:int,end_line:int>>"
DOCUMENT = f"source_file string, document_type string, title string, content string, sections {SECTIONS}, metadata map<string,string>, content_hash string, error string"
CHUNK = "source_file string, chunk_index int, header_path string, content string, start_line int, end_line int, token_count int, content_hash string"
ENTITY = "id string, entity_type string, name string, file_path string, start_line int, end_line int, language string, signature string, docstring string, parent_class string, modifiers array<string>, content_hash string"

#: About the bytes of the rows that are taken up at once; a longer one is alone. What a task holds follows from this, not from the rows of a batch.
BLOCK = 1 << 20


def _blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes by its second column, which are texts."""
    sizes = np.diff(np.asarray(_offsets(batch.column(1)), np.int64)) + 64
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    held = texts.buffers()[1]
    return np.frombuffer(held, kind, len(texts) + 1, texts.offset * width) if len(texts) and held else np.zeros(len(texts) + 1, kind)


def _mapped(rows: DataFrame, one: Callable[..., list[tuple]], ddl: str) -> DataFrame:
    """Rows of ddl, as many as `one` gives as tuples for the values of each of rows, made and handed on block by block."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                out = [x for values in zip(*(c.to_pylist() for c in b.columns)) for x in one(*values)]
                cols = zip(*out) if out else ([] for _ in schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], names=schema.names)

    return rows.mapInArrow(run, ddl)


def scan(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(source_file, text, length, modified) of the files in a folder; exclusions are globs over the whole path.

    Names and sizes are filtered before contents are read. Bytes that are no UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.regexp_replace("path", r"^file:/+", "/")
    for g in exclude:
        files = files.where(~path.rlike(glob_regex(g)))
    return files.select(path.alias("source_file"), F.expr("make_valid_utf8(cast(content as string))").alias("text"), "length", F.col("modificationTime").alias("modified"))


def scan_code(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Source files of known languages, with `file_path` relative to the folder; the usual caches are left out at any depth."""
    files = scan(spark, folder)
    top = F.lit(folder.removeprefix("file://").rstrip("/") + "/")
    rel = F.when(F.col("source_file").startswith(top), F.substr("source_file", F.length(top) + 1)).otherwise(F.col("source_file"))
    files = files.withColumn("file_path", rel).where(suffix("source_file").isin(*CODE_EXTENSION_LANGUAGE))
    files = files.where(~F.concat(F.lit("/"), "file_path").rlike("/(" + "|".join(x.replace(".", "\\.") for x in CODE_EXCLUDED) + ")/"))
    for g in exclude:
        files = files.where(~F.col("file_path").rlike(glob_regex(g)))
    return files


def document_type(path: Column | str, content: Column | str) -> Column:
    """By extension; else HTML by its doctype, markdown by a leading header, text."""
    table = F.create_map(*(F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv))
    content = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.element_at(table, suffix(path)), F.when(content.rlike(r"(?i)\A\s*<(!doctype html|html)"), "html").when(content.rlike(r"\A#{1,6}\s+\S"), "markdown").otherwise("text"))


def parse_document(path: str, text: str, kind: str, respect_fences: bool = False, exact_names: bool = True, pdf: Callable[[str], str] | None = None) -> dict:
    """One parsed document as a row of DOCUMENT."""
    meta: dict[str, str] = {}
    out = {"source_file": path, "document_type": kind, "error": None}
    if kind == "pdf" and pdf is None:
        return out | {"title": PurePosixPath(path).stem, "content": "[PDF parsing requires an extractor]", "sections": [], "metadata": {"error": "no_pdf_extractor"}, "content_hash": ""}
    if kind == "text":
        body = text.strip()
        lines = body.split("\n")
        parts = [markdown.Section("", 0, "", body, 0, len(lines) - 1)]
        title = lines[0].strip()
    else:
        if kind == "html":
            root, archive = html.parse(text)
            html.tidy(root, archive, exact_names)
            title = html.title(root)
            meta = {"is_singlefile": str(archive).lower()} | ({"original_title": title} if title else {})
            body = markdown.clean(html.to_markdown(html.main_part(root)))
        else:
            source = pdf(path) if kind == "pdf" else markdown.rst_to_markdown(text) if kind == "rst" else text
            front, body = markdown.front_matter(source) if kind == "markdown" else ({}, source)
            body = markdown.clean(body)
            meta = {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in front.items()}
            title = PurePosixPath(path).stem if kind == "pdf" else markdown.title_of(body, front)
        parts = markdown.sections(body, respect_fences)
    return out | {"title": title, "content": body, "sections": [vars(s) for s in parts], "metadata": meta, "content_hash": hashlib.sha256(body.encode()).hexdigest()[:16]}


def parse(files: DataFrame, **options) -> DataFrame:
    """Rows of DOCUMENT for files (source_file, text)."""
    rows = files.select("source_file", "text", document_type("source_file", F.coalesce("text", F.lit(""))).alias("kind"))
    names = ["source_file", "document_type", "title", "content", "sections", "metadata", "content_hash", "error"]

    def one(path: str, text: str | None, kind: str) -> list[tuple]:
        try:
            out = parse_document(path, text or "", kind, **options)
        except Exception as e:  # whatever a parser raises belongs to its file
            out = {"source_file": path, "document_type": kind, "title": None, "content": None, "sections": [], "metadata": {}, "content_hash": None, "error": f"{type(e).__name__}: {e}"}
        return [tuple(list(out[n].items()) if n == "metadata" else out[n] for n in names)]

    return _mapped(rows, one, DOCUMENT)


def sections(documents: DataFrame) -> DataFrame:
    return documents.select("source_file", F.posexplode("sections").alias("pos", "s")).select("source_file", "pos", "s.*")


def chunk(documents: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Rows of CHUNK for parsed documents; those with an error have none."""
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def one(path: str, text: str | None, parts: list[dict] | None) -> list[tuple]:
        found: list[Chunk] = chunk_sections([markdown.Section(**s) for s in parts or []], text or "", config)
        return [(path, *(getattr(c, n) for n in names[1:])) for c in found]

    rows = documents.where("error is null").select("source_file", "content", F.transform("sections", lambda s: F.struct(*(s[n].alias(n) for n in ("header", "header_level", "header_path", "content", "start_line", "end_line")))).alias("sections"))
    return _mapped(rows, one, CHUNK)


def index_code(files: DataFrame) -> DataFrame:
    """(file_path, entities, relations, error) for code files (file_path, text).

    Files are dealt by path to the session's number of shuffle partitions: reading a syntax tree takes far longer than moving
    its text, and a small table of many files would be one task's.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("file_path", "text", detect_code_language("file_path").alias("language")).repartition(tasks, "file_path")
    kinds = ENTITY.split(", ")
    entity = "struct<" + ",".join(x.replace(" ", ":", 1) for x in kinds) + ">"

    def one(path: str, text: str | None, language: str | None) -> list[tuple]:
        try:
            e, r = code.index(text or "", path, language)
            return [(path, [vars(x) for x in e], [vars(x) for x in r], None)]
        except (SyntaxError, ValueError, RecursionError) as x:
            return [(path, [], [], f"{type(x).__name__}: {x}")]

    return _mapped(rows, one, f"file_path string, entities array<{entity}>, relations array<struct<source:string,target:string,relation:string>>, error string")


def entities(indexed: DataFrame) -> DataFrame:
    return indexed.select(F.inline("entities"))


def relations(indexed: DataFrame) -> DataFrame:
    return indexed.select(F.inline("relations"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a folder by write_graph_json, or of a graph document {nodes: [...], links: [...]}."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/nodes")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return tuple(spark.read.json(f"{path.rstrip('/')}/{part}") for part in ("nodes", "links"))
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("links"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines under `<path>/nodes` and `<path>/links`, written in parallel: a graph of any size."""
    for part, df in (("nodes", nodes), ("links", edges)):
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{part}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a live database, read in ranges of `key` where its bounds are given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()
