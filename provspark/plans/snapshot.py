"""Immutable generations: tables in a folder of their own, made current by one exclusive file."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 2


class IndexGenerationChanged(RuntimeError):
    """Another writer committed since this generation was pinned."""


class SchemaTooNew(RuntimeError):
    """The index was written by a later version."""


class Writer:
    """Tables of the generation after ``expected``, unseen until they are committed."""

    def __init__(self, store: Store, expected: int) -> None:
        self.store, self.expected = store, expected
        self.folder, self.tables = f"gen={expected + 1}-{uuid.uuid4().hex}", []

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it back."""
        path = str(self.store.root / self.folder / name)
        df.write.parquet(path)
        self.tables.append(name)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def commit(self, metadata: dict) -> int:
        """Publish: only one writer can create the file of a generation."""
        n = self.expected + 1
        now = datetime.now(timezone.utc).isoformat()
        body = metadata | {"schema_version": SCHEMA_VERSION, "generation": n, "folder": self.folder, "tables": sorted(self.tables), "indexed_at": now}
        commits = self.store.root / "commits"
        commits.mkdir(parents=True, exist_ok=True)
        temporary = commits / f"{uuid.uuid4().hex}.tmp"
        with temporary.open("w") as file:
            json.dump(body, file, sort_keys=True)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(temporary, commits / f"{n}.json")
        except FileExistsError:
            shutil.rmtree(self.store.root / self.folder, ignore_errors=True)
            raise IndexGenerationChanged(f"generation {n} was committed by another writer") from None
        finally:
            temporary.unlink()
        return n


class Store:
    """Readers pin a generation once; a writer prepares the next one beside it.

    The root must be a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, Path(root) / ".provspark"

    def generation(self) -> int:
        return max((int(p.stem) for p in (self.root / "commits").glob("[0-9]*.json")), default=0)

    def manifest(self, generation: int | None = None) -> dict:
        n = self.generation() if generation is None else generation
        path = self.root / "commits" / f"{n}.json"
        body = json.loads(path.read_text()) if path.exists() else {}
        if body.get("schema_version", 0) > SCHEMA_VERSION:
            raise SchemaTooNew(f"generation {n} has schema {body['schema_version']}, known is {SCHEMA_VERSION}")
        return body

    def usable(self, generation: int | None = None) -> bool:
        """Whether the tables can be read; those of an older schema are built anew."""
        return self.manifest(generation).get("schema_version") == SCHEMA_VERSION

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        n = self.generation() if generation is None else generation
        body = self.manifest(n)
        if body.get("schema_version") != SCHEMA_VERSION:
            raise IndexGenerationChanged(f"generation {n} is absent or of another version")
        return self.spark.read.parquet(str(self.root / body["folder"] / name))

    def writer(self, expected: int) -> Writer:
        if self.generation() != expected:
            raise IndexGenerationChanged(f"expected {expected}, found {self.generation()}")
        return Writer(self, expected)

    def commit(self, tables: dict[str, DataFrame], metadata: dict, expected: int) -> int:
        writer = self.writer(expected)
        for name, df in tables.items():
            writer.write(name, df)
        return writer.commit(metadata)

    def log(self) -> DataFrame:
        """One row per generation: generation, indexed_at, provider, counters as JSON."""
        rows = []
        for path in (self.root / "commits").glob("[0-9]*.json"):
            body = json.loads(path.read_text())
            rows.append((body["generation"], body["indexed_at"], body.get("provider"), json.dumps(body.get("counters", {}), sort_keys=True)))
        return self.spark.createDataFrame(sorted(rows), "generation long, indexed_at string, provider string, counters string")

    def prune(self, keep: int = 2) -> int:
        """Delete the tables of all generations but the last ones; returns how many."""
        gone = 0
        for n in range(1, self.generation() - keep + 1):
            folder = self.root / self.manifest(n).get("folder", "none")
            if folder.is_dir():
                shutil.rmtree(folder)
                gone += 1
        return gone
