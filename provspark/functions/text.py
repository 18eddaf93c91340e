"""Column functions over text: canonical headings, ids, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_heading(text: Column) -> Column:
    """NFKC, full case folding, runs of anything but letters, digits and marks to '-'.

    A key with nothing left is 'section'.  Spark's own ICU does the first two,
    so the expression needs no Python worker.
    """
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc, F.lit(True))
    key = F.btrim(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{M}]+", "-"), F.lit("-"))
    return F.when(key == "", F.lit("section")).otherwise(key)


def path_key(keys: Column) -> Column:
    """One string for a path of canonical headings."""
    return F.array_join(keys, "/")


def ascii_lower(text: Column) -> Column:
    """A-Z alone, as the index's case-insensitive equality has it."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def embedding_tokens(text: Column) -> Column:
    """Estimated tokens of an embedded text: a quarter of its bytes, plus two."""
    n = F.octet_length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.ceil(n / 4) + 2).cast("long")


def generic_tokens(text: Column) -> Column:
    """Estimated tokens for a budget: a third of the bytes."""
    return F.ceil(F.octet_length(text) / 3).cast("long")


def byte_bound(text: Column) -> Column:
    """A strict upper bound of tokens."""
    return F.octet_length(text).cast("long")


def section_id(document: Column, key: Column, occurrence: Column) -> Column:
    """sec:<path>[-n]:<16 hex digits over document, path and occurrence>."""
    suffix = F.when(occurrence > 1, F.concat(F.lit("-"), occurrence.cast("string"))).otherwise("")
    digest = F.substring(F.sha2(F.concat_ws(chr(0), document, key, occurrence.cast("string")), 256), 1, 16)
    return F.concat(F.lit("sec:"), key, suffix, F.lit(":"), digest)


def chunk_id(section: Column, ordinal: Column, text: Column) -> Column:
    return F.concat(F.lit("chk:"), section, F.lit(":"), ordinal.cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 12))
