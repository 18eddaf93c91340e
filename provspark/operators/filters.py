"""FilterSet: which documents a search may see, applied before every cutoff."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower


@dataclass(frozen=True)
class FilterSet:
    """Empty fields don't restrict anything."""

    documents: frozenset[str] = field(default_factory=frozenset)  # paths or ids
    exclude_documents: frozenset[str] = field(default_factory=frozenset)  # paths
    authority_floor: int | None = None
    authorities: frozenset[int] = field(default_factory=frozenset)
    scope: str | None = None
    heading_prefix: tuple[str, ...] = ()  # canonical keys

    def predicate(self, document_id: str = "doc_id", heading_key: str = "heading_path_key") -> Column:
        parts: list[Column] = []
        if self.documents:
            names = sorted(self.documents)
            parts.append(F.col("path").isin(names) | F.col(document_id).cast("string").isin(names))
        if self.exclude_documents:
            parts.append(~F.col("path").isin(sorted(self.exclude_documents)))
        if self.authority_floor is not None:
            parts.append(F.col("authority") >= self.authority_floor)
        if self.authorities:
            parts.append(F.col("authority").isin(sorted(self.authorities)))
        if self.scope and self.scope.rstrip("/"):
            parts.append(ascii_lower(F.col("path")).startswith(self.scope.rstrip("/").lower() + "/"))
        if self.heading_prefix:
            prefix = "/".join(self.heading_prefix)
            parts.append((F.col(heading_key) == prefix) | F.col(heading_key).startswith(prefix + "/"))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, rows: DataFrame, **names: str) -> DataFrame:
        return rows.where(self.predicate(**names))
