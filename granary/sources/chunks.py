"""Chunking of sections: whole sections that fit, packed paragraphs with overlap, split sentences."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from .markdown import Section


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 512
    min_tokens: int = 50
    overlap_tokens: int = 50
    chars_per_token: float = 4.0
    include_headers: bool = True
    preserve_tables: bool = True


@dataclass
class Chunk:
    chunk_index: int
    header_path: str
    content: str
    start_line: int
    end_line: int
    token_count: int
    content_hash: str


def estimate(text: str, config: ChunkConfig) -> int:
    return int(len(text) / config.chars_per_token)


def hash16(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def paragraphs(text: str, tables: bool = True) -> list[str]:
    """Blocks between blank lines. A code fence stays whole; a line with a pipe opens a table that a blank line ends."""
    blocks: list[list[str]] = [[]]
    fenced = table = False
    for line in text.split("\n"):
        mark, blank = line.lstrip().startswith("```"), not line.strip()
        if mark:
            fenced = not fenced
        elif tables and "|" in line:
            table = True
        if blank and table and not mark:
            table = False
            blocks.append([])
        elif blank and not fenced and not mark:
            blocks.append([])
        else:
            blocks[-1].append(line)
    return [p for p in ("\n".join(b).strip() for b in blocks) if p]


def _tail(block: list[str], config: ChunkConfig) -> list[str]:
    """The last whole paragraphs that fit into the overlap."""
    room, at = config.overlap_tokens, len(block)
    while at and (size := estimate(block[at - 1], config)) <= room:
        room, at = room - size, at - 1
    return block[at:]


def _sentences(text: str, config: ChunkConfig) -> list[str]:
    """Sentences packed by characters, each piece led by the end of the one before; a long sentence is kept whole."""
    most, over = int(config.max_tokens * config.chars_per_token), int(config.overlap_tokens * config.chars_per_token)
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if not now:
            now = s
        elif len(now) + len(s) > most:
            out.append(now)
            now = f"{now[max(0, len(now) - over):]} {s}"
        else:
            now = f"{now} {s}"
    return [x for x in map(str.strip, [*out, now]) if x]


def pack(text: str, config: ChunkConfig) -> list[str]:
    out: list[str] = []
    block: list[str] = []
    size = 0
    for p in paragraphs(text, config.preserve_tables):
        n = estimate(p, config)
        if n > config.max_tokens:
            if block:
                out.append("\n\n".join(block))
            out += _sentences(p, config)
            block, size = [], 0
            continue
        if block and size + n > config.max_tokens:
            out.append("\n\n".join(block))
            block = _tail(block, config)
            size = estimate("\n\n".join(block), config)
        block.append(p)
        size += n
    last = "\n\n".join(block)
    return [*out, last] if block and estimate(last, config) >= config.min_tokens else out


def chunk_sections(parts: list[Section], text: str, config: ChunkConfig = ChunkConfig()) -> list[Chunk]:
    """Chunks of a document in order, numbered over the document. Without sections the whole text is split.

    Sub-chunks start at their section's line; a section that fits but is below the least size is dropped.
    """
    out: list[Chunk] = []

    def add(content: str, path: str, line: int, end: int | None = None, hashed: str | None = None) -> None:
        out.append(Chunk(len(out), path, content, line, line + content.count("\n") if end is None else end, estimate(content, config), hash16(content if hashed is None else hashed)))

    for s in parts or [Section("", 0, "", text, 0, text.count("\n"))]:
        whole = f"{'#' * s.header_level} {s.header}\n\n{s.content}" if config.include_headers and s.header and parts else s.content
        if parts and estimate(whole, config) <= config.max_tokens:
            if estimate(whole, config) >= config.min_tokens:
                add(whole.strip(), s.header_path, s.start_line, s.end_line, whole)
            continue
        for piece in pack(whole, config):
            add(piece, s.header_path, s.start_line)
    return out
