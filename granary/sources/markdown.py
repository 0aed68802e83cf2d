"""Markdown: front matter, sections with breadcrumbs, plain text and RST. Pure functions, run in Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass

_HEADER = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"\s*(```|~~~)")
#: Characters that may underline an RST title.
_RST_LINE = re.compile(r"([=\-`:.'\"~^_*+#<>])\1{2,}\s*")


@dataclass
class Section:
    header: str
    header_level: int
    header_path: str
    content: str
    start_line: int
    end_line: int


def front_matter(text: str) -> tuple[dict, str]:
    """({}, text) where there is no block or its YAML is bad."""
    m = re.match(r"---\s*\n(.*?)\n---\s*\n", text, re.DOTALL)
    if m:
        import yaml

        try:
            found = yaml.safe_load(m.group(1))
            if found is None or isinstance(found, dict):
                return found or {}, text[m.end() :]
        except yaml.YAMLError:
            pass
    return {}, text


def clean(text: str) -> str:
    """The order is part of the rule: lines of blanks are emptied after long runs of line breaks were shortened."""
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = "\n".join(map(str.rstrip, text.split("\n")))
    for link in (r"\[Skip to .*?\]\(.*?\)", r"\[Back to top\]\(.*?\)"):
        text = re.sub(link, "", text)
    return text.strip()


def sections(text: str, respect_fences: bool = False) -> list[Section]:
    """Split at ATX headers; what precedes the first has an empty header at level 0. Lines count from 0.

    A `#` line in a code fence is a header unless respect_fences.
    """
    lines = text.split("\n")
    heads: list[tuple[int, int, str]] = []
    fenced = False
    for i, line in enumerate(lines):
        if respect_fences and _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := _HEADER.fullmatch(line)):
            heads.append((i, len(m.group(1)), m.group(2).strip()))
    out = []
    if not heads or heads[0][0] > 0:
        end = heads[0][0] if heads else len(lines)
        out.append(Section("", 0, "", "\n".join(lines[:end]).strip(), 0, end - 1))
    trail: list[tuple[int, str]] = []
    for k, (at, level, title) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        trail = [x for x in trail if x[0] < level] + [(level, title)]
        out.append(Section(title, level, " > ".join(t for _, t in trail), "\n".join(lines[at + 1 : end]).strip(), at, end - 1))
    return out


def title_of(text: str, meta: dict) -> str | None:
    if meta.get("title"):
        return str(meta["title"])
    m = re.match(r"#\s+(.+)$", text, re.MULTILINE)
    return m.group(1).strip() if m else None


def rst_to_markdown(text: str) -> str:
    """Underlined titles become ATX headers, levels in order of first use of their characters; all else stays."""
    lines, out, order = text.split("\n"), [], []
    i = 0
    while i < len(lines):
        line, below = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
        if line.strip() and not _RST_LINE.fullmatch(line) and _RST_LINE.fullmatch(below) and len(below.rstrip()) >= len(line.rstrip()):
            if below[0] not in order:
                order.append(below[0])
            out.append("#" * min(6, order.index(below[0]) + 1) + " " + line.strip())
            i += 2
            continue
        if not (_RST_LINE.fullmatch(line) and below.strip()):  # an overline
            out.append(line)
        i += 1
    return "\n".join(out)
