"""Guards around extractors of untrusted files: paths, sizes, time and recursion."""

from __future__ import annotations

import functools
import os
import sys
import tempfile
import threading
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_network_path as network_path_column
from ..functions.text import suffix


class SecurityError(Exception):
    """A file must not be processed."""


@dataclass(frozen=True)
class Guard:
    """max_size in bytes, timeout in seconds."""

    max_size: int = 100 << 20
    timeout: float = 60.0
    recursion: int = 100
    extensions: tuple[str, ...] = (".pdf",)
    block_network: bool = True


TRUSTED, UNTRUSTED = Guard(), Guard(max_size=50 << 20, timeout=30.0, recursion=50)


def is_network_path(path: str) -> bool:
    return path.startswith(("\\\\", "//")) or path.lower().startswith(("http://", "https://"))


def validate(path: str | Path, guard: Guard = TRUSTED) -> Path:
    if guard.block_network and is_network_path(str(path)):
        raise SecurityError(f"Network paths are blocked for security: {path}")
    p = Path(path)
    if not p.exists():
        raise SecurityError(f"File does not exist: {p}")
    if not p.is_file():
        raise SecurityError(f"Path is not a regular file: {p}")
    if p.suffix.lower() not in guard.extensions:
        raise SecurityError(f"File extension not allowed: {p.suffix}")
    if (size := p.stat().st_size) > guard.max_size:
        raise SecurityError(f"File too large: {size} bytes > {guard.max_size} bytes")
    return p


def rejected(files: DataFrame, guard: Guard = TRUSTED, path: str = "path", length: str = "length") -> Column:
    """Why a row of a file listing must not be read, or null: decided before `content` is."""
    del files
    return F.coalesce(
        F.when(F.lit(guard.block_network) & network_path_column(path), F.lit("network path")),
        F.when(~suffix(path).isin(*guard.extensions), F.lit("extension not allowed")),
        F.when(F.col(length) > guard.max_size, F.lit("file too large")),
    )


@contextmanager
def isolated():
    """A temporary folder as HOME and TMPDIR for the time of a call in a worker."""
    with tempfile.TemporaryDirectory() as d:
        old = {k: os.environ.get(k) for k in ("HOME", "TMPDIR")}
        os.environ |= {k: d for k in old}
        try:
            yield Path(d)
        finally:
            for k, v in old.items():
                os.environ.pop(k) if v is None else os.environ.__setitem__(k, v)


def with_timeout(seconds: float) -> Callable:
    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*a, **k):
            box: dict = {}

            def work() -> None:
                try:
                    box["value"] = f(*a, **k)
                except BaseException as e:
                    box["error"] = e

            t = threading.Thread(target=work, daemon=True)
            t.start()
            t.join(seconds)
            if t.is_alive():
                raise TimeoutError(f"{f.__name__} took more than {seconds} s")
            if "error" in box:
                raise box["error"]
            return box["value"]

        return run

    return wrap


def with_recursion_limit(depth: int) -> Callable:
    """At most `depth` frames below the call."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*a, **k):
            now, frame, old = 0, sys._getframe(), sys.getrecursionlimit()
            while frame:
                now, frame = now + 1, frame.f_back
            sys.setrecursionlimit(now + depth)
            try:
                return f(*a, **k)
            finally:
                sys.setrecursionlimit(old)

        return run

    return wrap


def guarded(extract: Callable, guard: Guard = UNTRUSTED) -> Callable:
    """An extractor (path -> anything) behind all guards."""

    def run(path: str | Path):
        p = validate(path, guard)
        with isolated():
            return with_timeout(guard.timeout)(with_recursion_limit(guard.recursion)(extract))(p)

    return run


def file_hash(files: DataFrame, content: str = "content", algorithm: str = "sha256") -> DataFrame:
    """A binaryFile listing with `file_hash`, the lower-case hex digest of each file: md5, sha1, sha224, sha256, sha384 or sha512."""
    c, bits = F.col(content), {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if algorithm not in ("md5", "sha1", *bits):
        raise ValueError(f"Unknown algorithm '{algorithm}'")
    return files.withColumn("file_hash", F.md5(c) if algorithm == "md5" else F.sha1(c) if algorithm == "sha1" else F.sha2(c, bits[algorithm]))
