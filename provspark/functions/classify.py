"""Query classification: which structural terms a query holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import QUERY_CLASSES


def query_class(query: Column, name: str) -> Column:
    """The query's terms of one class, in order (native regular expressions)."""
    pattern = QUERY_CLASSES[name]
    group = 1 if name in ("paths", "quoted_phrases") else 0
    found = F.regexp_extract_all(query, F.lit("(?U)" + pattern), F.lit(group))
    if name == "snake_case":
        found = F.filter(found, lambda w: w != F.upper(w))
    return found


def structural_terms(query: Column) -> Column:
    """Distinct terms of all classes, in class order."""
    return F.array_distinct(F.flatten(F.array(*[query_class(query, n) for n in QUERY_CLASSES])))
