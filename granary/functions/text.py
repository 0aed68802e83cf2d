"""Scalar functions over texts and paths, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of languages, words of domains.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".pyi": "python",
    ".ipynb": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".cs": "csharp",
    ".java": "java",
}
CODE_EXTENSION_LANGUAGE = {
    ".py": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
}
DOMAIN_WORDS = {
    "backend": ["api", "server", "controller", "service", "storage", "db", "database", "model", "schema"],
    "frontend": ["ui", "view", "component", "page", "public", "assets", "style", "css", "html"],
    "testing": ["test", "spec", "fixture", "mock", "__tests__"],
    "config": ["config", "setting", "env", "docker", "k8s", "terraform"],
    "documentation": ["doc", "guide", "readme", "changelog", "license"],
    "security": ["auth", "security", "crypt", "secret", "token"],
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str) -> Column:
    """SHA-256 as 64 hex digits."""
    return F.sha2(_c(text), 256)


def content_hash16(text: Column | str) -> Column:
    return F.substring(content_hash(text), 1, 16)


def token_estimate(text: Column | str) -> Column:
    """A token for every four code points, rounded down."""
    return F.floor(F.length(_c(text)) / F.lit(4)).cast("long")


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def suffix(path: Column | str) -> Column:
    """Lower-case extension with its dot; none for names that only begin with dots or end in one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def _lookup(path: Column | str, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), suffix(path))


def detect_language(path: Column | str) -> Column:
    return _lookup(path, EXTENSION_LANGUAGE)


def detect_code_language(path: Column | str) -> Column:
    return _lookup(path, CODE_EXTENSION_LANGUAGE)


def detect_domains(path: Column | str) -> Column:
    """Domains whose words occur anywhere in the path, in fixed order."""
    p = F.replace(F.lower(_c(path)), F.lit("\\"), F.lit("/"))
    return F.array_compact(F.array(*(F.when(p.rlike("|".join(words)), F.lit(d)) for d, words in DOMAIN_WORDS.items())))


def knowledge_type(path: Column | str, content: Column | str) -> Column:
    p, c = F.lower(_c(path)), F.lower(_c(content))
    any_of = lambda words: reduce(lambda a, b: a | b, (p.contains(w) for w in words))
    return (
        F.when(any_of(["error", "traceback"]), "error_fixes")
        .when(any_of(list(EXTENSION_LANGUAGE)), "snippets")
        .when(any_of(["doc", ".md", ".txt"]) & (c.contains("api") | c.contains("reference")), "library_docs")
        .otherwise("guidance")
    )


def keywords(content: Column | str, most: int = 10) -> Column:
    """Distinct identifiers of four characters or more, in order of first occurrence."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_c(content), F.lit(r"\b[A-Za-z][A-Za-z0-9_]{3,}\b"), F.lit(0))), 1, most)


def universal_metadata(path: Column | str, content: Column | str, title: Column | None = None) -> Column:
    path = _c(path)
    language, ext = detect_language(path), suffix(path)
    name = basename(path)
    return F.struct(
        path.alias("source_file"),
        (F.coalesce(F.nullif(title, F.lit("")), name) if title is not None else name).alias("title"),
        knowledge_type(path, content).alias("knowledge_type"),
        detect_domains(path).alias("domain_tags"),
        F.array_compact(F.array(language)).alias("language_tags"),
        keywords(content).alias("keywords"),
        F.when(ext == "", "text").otherwise(F.substring(ext, 2, 100)).alias("original_format"),
        content_hash(content).alias("content_hash"),
    )


def clean_markdown(text: Column | str) -> Column:
    """Runs of blank lines shortened, line ends trimmed, skip and top links dropped, in this order; then stripped."""
    t = F.regexp_replace(_c(text), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?m)(?U)[\s&&[^\n]]+$", "")
    t = F.regexp_replace(t, r"\[Skip to .*?\]\(.*?\)", "")
    t = F.regexp_replace(t, r"\[Back to top\]\(.*?\)", "")
    return F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")


def split_tags(tags: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(tags), ","), lambda x: F.trim(x)), lambda x: x != "")


def preview(text: Column | str, n: int = 200) -> Column:
    return F.substring(_c(text), 1, n)


def truncated(text: Column | str, n: int = 500) -> Column:
    """The text, or its first n code points and an ellipsis."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def is_network_path(path: Column | str) -> Column:
    p = _c(path)
    return p.startswith("\\\\") | p.startswith("//") | F.lower(p).rlike("^https?://")


def glob_regex(glob: str) -> str:
    """fnmatch's pattern language as a Java regular expression over the whole string."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = end + 1
        else:
            out.append("\\" + c if not (c.isalnum() or c == "_") else c)
    return f"(?s)\\A{''.join(out)}\\z"


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda w: w != "")
    parts = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(parts))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def words(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits. Array functions stay in generated code, lambdas are interpreted."""
    return F.array_remove(F.split(F.lower(_c(text)), "[^a-z0-9]+"), "")


def json_contains(text: Column | str, wanted: dict) -> Column:
    """Whether a JSON object has all members of `wanted`, whose values are numbers, texts, booleans or such objects; broken JSON has none."""
    value = F.try_parse_json(_c(text))

    def has(at: str, part: dict) -> Column:
        out = F.lit(True)
        for k, v in part.items():
            path = f"{at}['{k}']"
            kind = "boolean" if isinstance(v, bool) else "double" if isinstance(v, (int, float)) else "string"
            out = out & (has(path, v) if isinstance(v, dict) else F.coalesce(F.try_variant_get(value, path, kind) == F.lit(v), F.lit(False)))
        return out

    return has("$", wanted)
