"""Workspace configuration and exact source reading."""

from __future__ import annotations

import os
import re
import tempfile
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Authority names by rank, and the default bound of a source file.
AUTHORITIES = ["GENERATED", "INFORMAL", "HISTORICAL", "REFERENCE", "NORMATIVE"]
MAX_FILE_BYTES = 25 << 20
CONFIG = "provspark.toml"


class ConfigError(ValueError):
    pass


def normalize_path(value: str) -> str:
    """A relative POSIX path inside the workspace."""
    path = value.strip().replace("\\", "/")
    parts = path.split("/")
    if not path or "\0" in path or path.startswith("/") or re.match(r"[A-Za-z]:", path) or any(p in ("", ".", "..") for p in parts):
        raise ConfigError(f"not a relative path: {value!r}")
    return path


@dataclass(frozen=True)
class Document:
    path: str
    authority: int = 3
    priority: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "path", normalize_path(self.path))
        if not 0 <= self.authority < len(AUTHORITIES) or not -100 <= self.priority <= 100:
            raise ConfigError(f"authority or priority out of range: {self}")


@dataclass(frozen=True)
class Workspace:
    documents: tuple[Document, ...] = ()
    max_file_bytes: int = MAX_FILE_BYTES
    max_results: int = 1000
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [d.path.casefold() for d in self.documents]
        if len(set(names)) != len(names):
            raise ConfigError("paths must be unique, whatever their case")

    def with_document(self, document: Document) -> Workspace:
        rest = [d for d in self.documents if d.path.casefold() != document.path.casefold()]
        return replace(self, documents=tuple(sorted([*rest, document], key=lambda d: d.path)))

    def without_document(self, path: str) -> Workspace:
        rest = tuple(d for d in self.documents if d.path != normalize_path(path))
        if len(rest) == len(self.documents):
            raise ConfigError(f"not configured: {path}")
        return replace(self, documents=rest)


def load(root: str | Path) -> Workspace:
    data = tomllib.loads((Path(root) / CONFIG).read_text(encoding="utf-8"))
    if data.get("version") not in (1, 2):
        raise ConfigError(f"unknown version: {data.get('version')}")
    documents = tuple(Document(d["path"], AUTHORITIES.index(d.get("authority", "REFERENCE")), d.get("priority", 0)) for d in data.get("documents", []))
    return Workspace(documents, data.get("max_file_bytes", MAX_FILE_BYTES), data.get("max_results", 1000))


def save(root: str | Path, workspace: Workspace) -> None:
    """Write beside and rename: readers see the old file or the new one."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = ["version = 2", f"max_file_bytes = {workspace.max_file_bytes}", f"max_results = {workspace.max_results}"]
    for d in workspace.documents:
        lines += ["", "[[documents]]", f"path = {quote(d.path)}", f"authority = {quote(AUTHORITIES[d.authority])}", f"priority = {d.priority}"]
    handle, name = tempfile.mkstemp(dir=root)
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")
        file.flush()
        os.fsync(file.fileno())
    os.replace(name, Path(root) / CONFIG)


def initialize(root: str | Path) -> Workspace:
    Path(root).mkdir(parents=True, exist_ok=True)
    if not (Path(root) / CONFIG).exists():
        save(root, Workspace())
    return load(root)


def safe_source(root: str | Path, path: str, max_bytes: int) -> Path:
    """The file of a configured path: inside the root, Markdown, regular, not too large."""
    base = Path(root).resolve()
    target = base / normalize_path(path)
    if target.is_symlink() or not target.resolve().is_relative_to(base):
        raise ConfigError(f"outside the workspace: {path}")
    if target.suffix.lower() not in (".md", ".markdown"):
        raise ConfigError(f"not Markdown: {path}")
    if not target.is_file():
        raise ConfigError(f"no such file: {path}")
    if target.stat().st_size > max_bytes:
        raise ConfigError(f"larger than {max_bytes} bytes: {path}")
    return target


def read_sources(spark: SparkSession, root: str | Path, workspace: Workspace) -> DataFrame:
    """path, authority, priority, text, sha256 of all configured documents.

    Whole files as bytes: line ends stay as they are, and invalid UTF-8 fails.
    """
    schema = "path string, authority int, priority int, text string, sha256 string"
    if not workspace.documents:
        return spark.createDataFrame([], schema)
    files = {safe_source(root, d.path, workspace.max_file_bytes).as_uri().replace("file:///", "file:/"): d for d in workspace.documents}
    raw = spark.read.format("binaryFile").load(list(files))
    known = spark.createDataFrame([(u, d.path, d.authority, d.priority) for u, d in files.items()], "file string, doc string, authority int, priority int")
    name = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    valid = F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "doc")))
    joined = raw.withColumn("file", name).join(F.broadcast(known), "file")
    return joined.select(F.col("doc").alias("path"), "authority", "priority", valid.alias("text"), F.sha2("content", 256).alias("sha256"))
