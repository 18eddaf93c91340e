"""Generated checkpoint artifacts: JSON files named by checkpoint, in a folder per document."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import ConfigError

FOLDER = "artifacts"
MAX_BYTES = 1_000_000


def artifact_path(root: str | Path, document_id: str, checkpoint_id: str) -> Path:
    """<root>/artifacts/<percent-encoded document>/<CP-n>.json"""
    if not re.fullmatch(r"CP-\d+", checkpoint_id):
        raise ConfigError(f"not a checkpoint id: {checkpoint_id!r}")
    return Path(root) / FOLDER / quote(document_id, safe="") / f"{checkpoint_id}.json"


def read_artifacts(spark: SparkSession, root: str | Path) -> DataFrame:
    """document_id, checkpoint_id, json, sha256 of all artifacts; larger or invalid ones fail."""
    schema = "document_id string, checkpoint_id string, json string, sha256 string"
    folder = Path(root) / FOLDER
    names = sorted(folder.glob("*/CP-*.json")) if folder.is_dir() else []
    if not names:
        return spark.createDataFrame([], schema)
    if any(n.is_symlink() or n.parent.is_symlink() for n in names):
        raise ConfigError("artifacts must not be links")
    if large := next((n for n in names if n.stat().st_size > MAX_BYTES), None):
        raise ConfigError(f"larger than {MAX_BYTES} bytes: {large.name}")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "CP-*.json").option("recursiveFileLookup", "true").load(str(folder))
    known = spark.createDataFrame([(n.parent.name, unquote(n.parent.name)) for n in {p.parent.name: p for p in names}.values()], "folder string, document_id string")
    parts = F.split(F.col("path"), "/")
    text = F.col("content").cast("string")
    valid = F.when(F.expr("is_valid_utf8(content)") & F.get_json_object(text, "$").isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), "path")))
    rows = raw.select(F.url_decode(F.element_at(parts, -2)).alias("decoded"), F.regexp_extract("path", r"(CP-\d+)\.json$", 1).alias("checkpoint_id"), valid.alias("json"), F.sha2("content", 256).alias("sha256"))
    return rows.join(F.broadcast(known), (F.col("decoded") == F.col("document_id")) | (F.col("decoded") == F.col("folder"))).select("document_id", "checkpoint_id", "json", "sha256")
