"""Checkpoints, conflicts, coverage and budgeted context packs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CHECKPOINT_HEADING
from .extract import assertions_of, fields_of
from .markdown import subtree


class AmbiguousCheckpoint(ValueError):
    """Several documents of equal authority and priority hold the checkpoint."""


class ContextBudgetTooSmall(ValueError):
    """Not even the envelope, or the primary item, fits the budget."""


def checkpoints(sections: DataFrame) -> DataFrame:
    """(doc_id, checkpoint_id, title, root, authority, priority, fields) of sections with text."""
    roots = sections.where(F.col("heading").rlike(CHECKPOINT_HEADING) & (F.col("level") > 0)).select(
        "doc_id",
        F.col("ordinal").alias("root"),
        F.upper(F.regexp_extract("heading", CHECKPOINT_HEADING, 1)).alias("checkpoint_id"),
        F.regexp_extract("heading", CHECKPOINT_HEADING, 2).alias("title"),
        "authority",
        "priority",
    )
    inside = subtree(sections).unionByName(sections.select("doc_id", F.col("ordinal").alias("root"), F.col("ordinal").alias("member")))
    body = F.regexp_replace("source_text", r"^[^\n]*\n?", "")
    fields = sections.select("doc_id", F.col("ordinal").alias("member"), F.explode(fields_of("heading", body)).alias("f"))
    joined = roots.join(inside, ["doc_id", "root"]).join(fields, ["doc_id", "member"], "left")
    listed = joined.groupBy("doc_id", "checkpoint_id", "title", "root", "authority", "priority", "f.field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("member", F.col("f.position").alias("p"), F.col("f.value").alias("v")))), lambda x: x["v"]).alias("values")
    )
    pairs = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "values")))
    return listed.groupBy("doc_id", "checkpoint_id", "title", "root", "authority", "priority").agg(F.map_from_entries(F.array_sort(pairs)).alias("fields"))


def best_checkpoints(found: DataFrame) -> DataFrame:
    """Per checkpoint id the highest authority, then priority; ties count as ambiguous."""
    w = Window.partitionBy("checkpoint_id").orderBy(F.col("authority").desc(), F.col("priority").desc())
    first = found.withColumn("place", F.rank().over(w)).where("place = 1")
    return first.groupBy("checkpoint_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).withColumn("status", F.when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED"))


def conflicts(items: DataFrame, limit: int = 10) -> DataFrame:
    """items(item, heading, source_text): pairs that assert the opposite of one subject."""
    said = items.select("item", F.explode(assertions_of("heading", "source_text")).alias("a")).select("item", "a.*")
    return conflict_pairs(said, limit)


def conflict_pairs(said: DataFrame, limit: int = 10) -> DataFrame:
    """said(item, family, polarity, subject, property, clause): conflicts, the first ``limit``."""
    said = said.select("item", "family", "polarity", "subject", "property").distinct()
    # the first pairs of a subject have their left item among the first of its polarity
    order = Window.partitionBy("family", "subject", "property", "polarity").orderBy("item")
    x, y = said.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).alias("x"), said.alias("y")
    same = (F.col("x.family") == F.col("y.family")) & (F.col("x.subject") == F.col("y.subject")) & (F.col("x.property") == F.col("y.property"))
    pairs = x.join(y, same & (F.col("x.item") < F.col("y.item")) & (F.col("x.polarity") == -F.col("y.polarity")))
    columns = [F.col("x.item").alias("left_item"), F.col("y.item").alias("right_item"), F.col("x.family").alias("family"), F.col("x.subject").alias("subject"), F.col("x.property").alias("property")]
    return pairs.select(columns).distinct().orderBy("left_item", "right_item", "family", "subject", "property").limit(limit)


#: Fixed value: coverage categories, in the order of a report.
CATEGORIES = ["CHECKPOINT", "CHECKPOINT_DESCENDANTS", "DEPENDENCIES", "ARCHITECTURE", "SECURITY", "ACCEPTANCE", "VERIFICATION", "ERRORS", "REFERENCES", "DIRECT_EVIDENCE", "OPTIONAL"]


def coverage(candidates: DataFrame) -> DataFrame:
    """candidates(category, required, selected, ambiguous): one row per category with its status."""
    per = candidates.groupBy("category").agg(
        F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("selected")).alias("covered"), F.count_if("ambiguous").alias("n_ambiguous"), F.count_if("selected").alias("selected")
    )
    status = F.when(F.col("n_ambiguous") > 0, "AMBIGUOUS").when(F.col("covered") < F.col("required"), "PARTIAL").when(F.col("selected") > 0, "COMPLETE").otherwise("NOT_APPLICABLE")
    return per.withColumn("status", status)


@dataclass
class Pack:
    items: list[dict] = field(default_factory=list)
    omitted: list[str] = field(default_factory=list)
    tokens: int = 0

    def serialized(self) -> str:
        return json.dumps({"items": self.items, "omitted": self.omitted, "tokens": self.tokens}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def serialized_tokens(pack: Pack) -> int:
    """A third of the envelope's bytes and 15 percent, as a fixed point: the count is in the envelope."""
    pack.tokens = 0
    while True:
        n = math.ceil(math.ceil(len(pack.serialized().encode()) / 3) * 1.15)
        if n == pack.tokens:
            return n
        pack.tokens = n


def fill(candidates: list[dict], budget: int) -> Pack:
    """Greedy in the given order: required items as found, others also as an excerpt.

    What a candidate has as ``extra`` is part of its item, and counts.
    """
    pack = Pack()
    if serialized_tokens(pack) > budget:
        raise ContextBudgetTooSmall(f"the envelope takes {pack.tokens} tokens")
    for c in candidates:
        forms = [c["text"]] + ([c["excerpt"]] if not c["required"] and c.get("excerpt") else [])
        for text in forms:
            trial = Pack([*pack.items, {"id": c["id"], "required": c["required"], "text": text} | c.get("extra", {})], list(pack.omitted))
            if serialized_tokens(trial) <= budget:
                pack = trial
                break
        else:
            if c.get("primary"):
                raise ContextBudgetTooSmall(f"primary item {c['id']} does not fit")
            if c["required"]:
                pack.omitted.append(c["id"])
    # the names of what is left out take room too
    while serialized_tokens(pack) > budget:
        kept = [n for n, i in enumerate(pack.items) if n > 0]
        if len(pack.omitted) > 1:
            pack.omitted = [f"{len(pack.omitted)} required sections"]
        elif kept:
            out = pack.items.pop(next((n for n in reversed(kept) if not pack.items[n]["required"]), kept[-1]))
            if out["required"]:
                pack.omitted.append(out["id"])
        else:
            raise ContextBudgetTooSmall(f"the first item and the omissions take {pack.tokens} tokens")
    return pack
