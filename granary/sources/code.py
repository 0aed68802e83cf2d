"""Code entities and relationships of a source file: Python by its syntax tree, other languages by a brace scanner."""

from __future__ import annotations

import ast
import hashlib
import re
from dataclasses import dataclass, field


@dataclass
class Entity:
    id: str
    entity_type: str
    name: str
    file_path: str
    start_line: int
    end_line: int
    language: str
    signature: str | None = None
    docstring: str | None = None
    parent_class: str | None = None
    modifiers: list[str] = field(default_factory=list)
    content_hash: str = ""


@dataclass
class Relation:
    source: str
    target: str
    relation: str


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


#: Lines as Python's parser counts them: they end with \n, \r\n or \r, and with no other character.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


class _Python(ast.NodeVisitor):
    """Classes, functions and methods with their calls; functions inside functions are part of the outer one."""

    def __init__(self, source: str, path: str) -> None:
        self.path = path
        # as bytes, since columns count them; lines end where the parser ends them
        self.lines = [x.encode() for x in _LINE.findall(source)]
        self.entities: list[Entity] = []
        self.relations: list[Relation] = []
        self.owner: str | None = None

    def _text(self, n: ast.AST) -> str:
        """What ast.get_source_segment gives, from lines that are split once a file."""
        a, z = n.lineno - 1, n.end_lineno - 1
        if a == z:
            return self.lines[a][n.col_offset : n.end_col_offset].decode() or ast.unparse(n)
        return b"".join([self.lines[a][n.col_offset :], *self.lines[a + 1 : z], self.lines[z][: n.end_col_offset]]).decode() or ast.unparse(n)

    def _arguments(self, n: ast.arguments) -> str:
        """What ast.unparse gives, at once where there are only names."""
        if n.posonlyargs or n.kwonlyargs or n.vararg or n.kwarg or n.defaults or any(a.annotation for a in n.args):
            return ast.unparse(n)
        return ", ".join(a.arg for a in n.args)

    def _add(self, n, kind: str, signature: str) -> Entity:
        inside = self.owner if kind == "method" else None
        e = Entity(f"{self.path}:{inside}.{n.name}" if inside else f"{self.path}:{n.name}", kind, n.name, self.path, n.lineno, n.end_lineno, "python", signature, ast.get_docstring(n), inside, [self._text(d) for d in n.decorator_list], _hash(self._text(n)))
        self.entities.append(e)
        return e

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        args = ", ".join(self._text(x) for x in [*n.bases, *(k.value for k in n.keywords)])
        e = self._add(n, "class", f"class {n.name}({args})" if args else f"class {n.name}")
        self.relations += [Relation(e.id, b.id, "INHERITS") for b in n.bases if isinstance(b, ast.Name)]
        outer, self.owner = self.owner, n.name
        for x in n.body:
            self.visit(x)
        self.owner = outer

    def visit_FunctionDef(self, n) -> None:
        returns = f" -> {self._text(n.returns)}" if n.returns else ""
        e = self._add(n, "method" if self.owner else "function", f"def {n.name}({self._arguments(n.args)}){returns}")
        calls = sorted((c for x in n.body for c in ast.walk(x) if isinstance(c, ast.Call)), key=lambda c: (c.lineno, c.col_offset))
        self.relations += [Relation(e.id, self._text(c.func), "CALLS") for c in calls]

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, n: ast.Import) -> None:
        self.relations += [Relation(self.path, a.name, "IMPORTS") for a in n.names]

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        self.relations.append(Relation(self.path, "." * n.level + (n.module or ""), "IMPORTS"))


def _blank(source: str) -> str:
    """The source with comments and string contents blanked, offsets unchanged, so that braces can be counted."""
    token = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`[^`]*`", re.DOTALL)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _close(code: str, at: int) -> int:
    """The end of the block that the first brace from `at` on opens, or of the line or statement without one."""
    start = code.find("{", at)
    stop = code.find(";", at)
    if start < 0 or 0 <= stop < start:
        return stop + 1 if stop >= 0 else len(code)
    depth = 0
    for m in re.compile("[{}]").finditer(code, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(code)


# Kind of entity (None: only an owner of what is inside) and expression, with groups `name` and maybe `owner`.
_RULES: dict[str, list[tuple[str | None, str]]] = {
    "javascript": [
        ("class", r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("function", r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?\("),
        ("function", r"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
        ("member", r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*\*?(?P<name>[\w$]+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{\n]+)?\{"),
    ],
    "go": [
        ("function", r"(?m)^func\s+(?P<name>\w+)\s*[(\[]"),
        ("method", r"(?m)^func\s+(?P<owner>\([^)]*\))\s*(?P<name>\w+)\s*\("),
        ("class", r"(?m)^[ \t]*type\s+(?P<name>\w+)\s+(?:struct|interface|func|map|\[|\*|\w)"),
    ],
    "rust": [
        ("class", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
        ("function", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<name>\w+)"),
        (None, r"(?m)^[ \t]*impl(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"),
    ],
}
_RULES["typescript"] = _RULES["javascript"]
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "with", "constructor_"}


def _scan(source: str, path: str, language: str) -> list[Entity]:
    code = _blank(source)
    found = []
    for kind, rule in _RULES[language]:
        for m in re.finditer(rule, code):
            if m["name"] not in _NO_NAMES:
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                found.append((start, _close(code, max(m.end() - 1, m.start())), kind, m["name"], m.groupdict().get("owner")))
    owners = [(s, e, n) for s, e, k, n, _ in found if k is None or (k == "class" and language != "go" and language != "rust")]
    out = []
    for s, e, kind, name, owner in sorted(found, key=lambda x: (x[0], -x[1])):
        if kind is None:
            continue
        around = [o for o in owners if o[0] < s and e <= o[1]]
        owner = owner or (max(around)[2] if around and kind in ("function", "member") else None)
        if kind == "member" and not owner:
            continue
        kind = "method" if owner and kind in ("function", "member", "method") else kind
        out.append(Entity(f"{path}:{owner}.{name}" if owner else f"{path}:{name}", kind, name, path, source.count("\n", 0, s) + 1, source.count("\n", 0, max(s, e - 1)) + 1, language, parent_class=owner, content_hash=_hash(source[s:e])))
    return out


def index(source: str, path: str, language: str | None) -> tuple[list[Entity], list[Relation]]:
    """Entities and relations of one file; nothing for languages that aren't known. Bad Python raises SyntaxError."""
    if language == "python":
        v = _Python(source, path)
        v.visit(ast.parse(source))
        return v.entities, v.relations
    return (_scan(source, path, language), []) if language in _RULES else ([], [])
