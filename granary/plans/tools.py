"""The tool surface: functions that take and return text, over a catalog."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import functions as F

from ..functions.vector import HashingEmbedder
from ..operators import memory
from ..operators.notelog import NoteLog
from ..operators.search import search
from ..operators.tables import Catalog
from ..schemas import MEMORY_TYPES, parse_member
from . import retrieval


class SearchTools:
    def __init__(self, catalog: Catalog, embedder: HashingEmbedder | None = None) -> None:
        self.catalog, self.embedder = catalog, embedder or HashingEmbedder()

    def search_codebase(self, query: str, advanced: bool = True) -> str:
        corpus = self.catalog.read("semantic_chunks")
        if advanced:
            r = retrieval.answer(corpus, query, embed=self.embedder.embed, nodes=self.catalog.read("graph_nodes"), edges=self.catalog.read("graph_edges"))
            return f"Answer: {r['answer']}\n\nEvidence Used: {r['verified_evidence_count']} chunks"
        rows = search(corpus, query, self.embedder.embed(query), limit=5).collect()
        if not rows:
            return "No results found."
        out = f"Search results for: '{query}'\n\n"
        for i, r in enumerate(rows, 1):
            where = f"{r['source_file']} > {r['header_path']}" if r["header_path"] else r["source_file"]
            out += f"{i}. [{r['combined_score']:.2f}] {where}\n   {r['content'][:200]}...\n\n"
        return out

    def get_file_context(self, file_path: str) -> str:
        rows = self.catalog.read("semantic_chunks").where(F.col("source_file") == file_path).orderBy("chunk_index").select("chunk_index", "content").collect()
        if not rows:
            return f"No context found for {file_path}"
        return f"File Context: {file_path}\nTotal Chunks: {len(rows)}\n\n" + "".join(f"--- Chunk {r['chunk_index']} ---\n{r['content']}\n\n" for r in rows)


# The messages are what callers of the tools see.
class MemoryTools:
    """Notes in a log of changes beside the catalog's tables."""

    def __init__(self, catalog: Catalog, embedder: HashingEmbedder | None = None) -> None:
        self.notes, self.embedder = NoteLog(catalog.spark, f"{catalog.root}/memory"), embedder or HashingEmbedder()

    def memory_add(self, content: str, memory_type: str = "episodic", context: str | None = None, keywords: list[str] | None = None, agent_id: str = "default") -> str:
        try:
            kind = parse_member(memory_type, MEMORY_TYPES, "memory_type")
        except ValueError as e:
            return f"Error: {e}"
        return f"Memory created with ID: {self.notes.add(content, kind, context, keywords or [], agent_id, self.embedder.embed(content))}"

    def remember(self, content: str, context: str = "", tags: str = "") -> str:
        return self.memory_add(content, context=context or None, keywords=[t.strip() for t in tags.split(",") if t.strip()])

    def memory_retrieve(self, query: str, agent_id: str = "default", limit: int = 5) -> str:
        rows = memory.search(self.notes.current(), self.embedder.embed(query), agent_id, limit, 0.4).collect()
        if not rows:
            return "No relevant memories found."
        out = f"Found {len(rows)} relevant memories:\n"
        for i, r in enumerate(rows, 1):
            out += f"{i}. [{r['memory_type']}] {r['content']} (ID: {r['id']})\n" + (f"   Context: {r['context']}\n" if r["context"] else "")
        return out

    recall = memory_retrieve

    def memory_update(self, memory_id: str, content: str | None = None, keywords: list[str] | None = None) -> str:
        if not _is_uuid(memory_id):
            return "Invalid UUID format."
        done = self.notes.change(memory_id, {"content": content, "keywords": keywords, "embedding": self.embedder.embed(content) if content else None})
        return f"Memory {memory_id} updated." if done else f"Memory {memory_id} not found."

    def memory_delete(self, memory_id: str, reason: str = "Deleted by user") -> str:
        if not _is_uuid(memory_id):
            return "Invalid UUID format."
        done = self.notes.change(memory_id, {"is_active": False, "deleted_reason": reason})
        return f"Memory {memory_id} deleted." if done else f"Memory {memory_id} not found."

    def memory_checkpoint(self, name: str, reason: str, agent_id: str = "default") -> str:
        return f"Checkpoint '{name}' created (ID: {self.notes.checkpoint(name, reason, agent_id)})"

    create_checkpoint = memory_checkpoint

    def memory_rollback(self, checkpoint_id: str, agent_id: str = "default") -> str:
        if not _is_uuid(checkpoint_id):
            return "Invalid UUID format."
        done = self.notes.rollback(checkpoint_id, agent_id)
        return f"Successfully rolled back to checkpoint {checkpoint_id}" if done else f"Checkpoint {checkpoint_id} not found."

    def memory_history(self, agent_id: str = "default", limit: int = 10) -> str:
        rows = memory.history(self.notes.checkpoints(), agent_id, limit).collect()
        if not rows:
            return "No checkpoints found."
        return "Recent Memory Checkpoints:\n" + "".join(f"- {r['created_at']} | {r['checkpoint_name']} | {r['reason']} (ID: {r['id']})\n" for r in rows)


def _is_uuid(text: str) -> bool:
    try:
        UUID(text)
    except ValueError:
        return False
    return True
