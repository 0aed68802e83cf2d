"""Row types of the stored tables, their enumerations, keys and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

# The members of each enumeration.
MEMORY_TYPES = ("episodic", "semantic", "procedural")
KNOWLEDGE_TYPES = ("snippets", "library_docs", "guidance", "error_fixes", "memories")
ENTITY_TYPES = ("module", "class", "function", "method")
INGESTION_STATUS = ("pending", "processing", "completed", "failed")
ENRICHMENT_STATUS = ("pending", "processing", "completed", "failed", "skipped")
LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "csharp", "java")
ECOSYSTEMS = ("pypi", "npm", "crates", "go-modules", "nuget", "maven")
ELEMENT_TYPES = ("class", "function", "method", "interface", "struct", "enum", "constant", "type_alias", "trait", "impl")

_VECTOR = "array<double>"
_PARAMETER = "struct<name:string,type:string,default:string,description:string,required:boolean,is_variadic:boolean,is_keyword:boolean>"
_RETURNS = "struct<type:string,description:string>"
_EXAMPLE = "struct<code:string,description:string,language:string>"
_TIMES = "created_at timestamp, updated_at timestamp"
_LLM_CHUNK = "llm_summary string, llm_questions array<string>, llm_keywords array<string>, llm_domain_tags array<string>, llm_use_case_tags array<string>, llm_quality_score double, llm_enriched_at timestamp, llm_enrichment_model string, llm_enrichment_version int"
_LLM_CODE = "llm_summary string, llm_keywords array<string>, llm_quality_score double, llm_enriched_at timestamp, llm_enrichment_model string"

#: Table -> DDL of its columns.
TABLES = {
    "semantic_chunks": f"id string, source_file string, chunk_index int, header_path string, content string, embedding {_VECTOR}, metadata map<string,string>, content_hash string, start_line int, end_line int, token_count int, {_TIMES}, {_LLM_CHUNK}",
    "code_entities": f"id string, entity_type string, name string, file_path string, start_line int, end_line int, language string, signature string, docstring string, parent_class string, modifiers array<string>, docstring_embedding {_VECTOR}, metadata map<string,string>, content_hash string, {_TIMES}, {_LLM_CODE}",
    "memory_notes": f"id string, agent_id string, memory_type string, content string, context string, keywords array<string>, source_ref string, embedding {_VECTOR}, usage_count int, last_accessed timestamp, {_TIMES}, is_active boolean, deleted_reason string, restored_from string",
    "memory_checkpoints": "id string, checkpoint_name string, created_at timestamp, created_by string, reason string, memory_snapshot string, is_current boolean",
    "ingestion_manifest": f"source_file string, output_file string, file_type string, knowledge_type string, chunk_count int, status string, error_message string, content_hash string, ingested_at timestamp, {_TIMES}, llm_enrichment_status string, llm_enriched_at timestamp, llm_enrichment_error string",
    "libraries": f"id string, name string, version string, language string, ecosystem string, repository_url string, license string, homepage_url string, documentation_url string, metadata map<string,string>, documented_at timestamp, {_TIMES}",
    "api_elements": f"id string, library_id string, name string, element_type string, module string, parent string, visibility string, signature string, docstring string, docstring_embedding {_VECTOR}, parameters array<{_PARAMETER}>, returns {_RETURNS}, type_parameters array<string>, examples array<{_EXAMPLE}>, see_also array<string>, deprecated boolean, deprecation_message string, since_version string, source_file string, start_line int, end_line int, source_hash string, metadata map<string,string>, {_TIMES}, llm_usage_tips string, llm_common_patterns array<string>, llm_enriched_at timestamp, llm_enrichment_model string",
    "error_patterns": f"id string, library_id string, api_element_id string, exception_type string, message_pattern string, message_regex string, message_embedding {_VECTOR}, condition string, source_line int, language string, metadata map<string,string>, times_encountered int, last_seen timestamp, {_TIMES}, llm_explanation string, llm_fix_suggestions array<string>, llm_enriched_at timestamp",
    "error_fixes": f"id string, error_pattern_id string, fix_description string, fix_code string, source string, upvotes int, downvotes int, verified boolean, {_TIMES}",
    "graph_nodes": "project_id string, id string, label string, name string, parent_class string, file_path string, start_line int, end_line int, language string, content_hash string, docstring_summary string, signature string, modifiers array<string>",
    "graph_edges": "project_id string, src string, dst string, relation string, weight double, metadata map<string,string>",
}

#: Table -> natural key.
KEYS = {
    "semantic_chunks": ("source_file", "chunk_index"),
    "code_entities": ("id",),
    "memory_notes": ("id",),
    "memory_checkpoints": ("id",),
    "ingestion_manifest": ("source_file",),
    "libraries": ("id",),
    "api_elements": ("id",),
    "error_patterns": ("id",),
    "error_fixes": ("id",),
    "graph_nodes": ("project_id", "id"),
    "graph_edges": ("project_id", "src", "dst", "relation"),
}

#: Table -> columns that must hold one of some values when they are not null.
CHECKS = {
    "memory_notes": {"memory_type": MEMORY_TYPES},
    "ingestion_manifest": {"status": INGESTION_STATUS, "llm_enrichment_status": ENRICHMENT_STATUS, "knowledge_type": KNOWLEDGE_TYPES},
    "libraries": {"ecosystem": ECOSYSTEMS, "language": LANGUAGES},
    "api_elements": {"element_type": ELEMENT_TYPES},
    "code_entities": {"entity_type": ENTITY_TYPES},
}

#: Child table -> (column, parent table, what becomes of the child when its parent goes).
PARENTS = {
    "api_elements": [("library_id", "libraries", "cascade")],
    "error_patterns": [("library_id", "libraries", "cascade"), ("api_element_id", "api_elements", "set null")],
    "error_fixes": [("error_pattern_id", "error_patterns", "cascade")],
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))


def broken(table: str) -> Column:
    """What is wrong with a row by CHECKS, as text, or null."""
    faults = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.format_string(f"{c} '%s' is none of {', '.join(values)}", F.col(c))) for c, values in CHECKS.get(table, {}).items()]
    faults += [F.when(F.col(k).isNull(), F.lit(f"{k} is null")) for k in KEYS[table]]
    return F.coalesce(*faults)


def checked(df: DataFrame, table: str) -> DataFrame:
    """df, whose evaluation fails at the first row that breaks a check."""
    fault = broken(table)
    guard = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"{table}: "), fault)).cast("boolean")).otherwise(True)
    return df.where(guard)


def parse_member(value: str, members: tuple[str, ...], name: str) -> str:
    """A member by its name in any case; ValueError lists the valid ones."""
    if value.lower() in members:
        return value.lower()
    raise ValueError(f"Invalid {name} '{value}'. Must be: {', '.join(members)}")


def latest(df: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row for each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def delete_parents(tables: dict[str, DataFrame], parent: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after rows of `parent` with the ids in gone (id) go, children by the rule of PARENTS."""
    out = tables | {parent: tables[parent].join(gone.select("id"), "id", "left_anti")}
    for child, rules in PARENTS.items():
        for column, of, rule in rules:
            if of != parent or child not in out:
                continue
            hit = gone.select(F.col("id").alias("_gone"))
            rows = out[child]
            if rule == "cascade":
                lost = rows.join(hit, F.col(column) == F.col("_gone"), "left_semi").select("id")
                out = delete_parents(out, child, lost)
            else:
                kept = rows.join(hit, F.col(column) == F.col("_gone"), "left")
                out[child] = kept.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
    return out


def row_hash(df: DataFrame, names: tuple[str, ...] | None = None) -> Column:
    """A hash of a row's columns, for ties that must be broken alike wherever rows come from; maps count by their sorted entries."""
    kinds = {f.name: f.dataType for f in df.schema}
    plain = lambda c: F.array_sort(F.map_entries(c)) if isinstance(kinds[c], MapType) else F.col(c)
    return F.xxhash64(*(plain(c) for c in names or df.columns))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
