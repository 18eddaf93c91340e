"""Typed reference graph: mentions joined with declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import canonical_heading
from .extract import dependencies_of, symbols_of


def parent_edges(sections: DataFrame) -> DataFrame:
    """sections(doc_id, ordinal, parent, id, heading): PARENT_OF and CHILD_OF."""
    p = sections.select(F.col("doc_id").alias("_d"), F.col("ordinal").alias("_o"), F.col("id").alias("p_id"), F.col("heading").alias("p_heading"))
    pairs = sections.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_o")))
    down = pairs.select(F.col("p_id").alias("source"), F.lit("PARENT_OF").alias("edge_type"), F.col("heading").alias("label"), F.col("id").alias("target"))
    up = pairs.select(F.col("id").alias("source"), F.lit("CHILD_OF").alias("edge_type"), F.col("p_heading").alias("label"), F.col("p_id").alias("target"))
    return down.unionByName(up)


def symbols(sections: DataFrame) -> DataFrame:
    """(symbol, kind, origin, section, confidence): one row per symbol, section, kind and origin."""
    head = sections.select("id", F.explode(symbols_of("heading")).alias("s")).select("id", "s.symbol", "s.kind", F.lit("HEADING").alias("origin"), F.lit(1.0).alias("confidence"))
    body = F.regexp_replace("source_text", r"^[^\n]*\n?", "")
    text = F.when(F.col("level") > 0, body).otherwise(F.col("source_text"))
    rest = sections.select("id", F.explode(symbols_of(text)).alias("s")).select("id", "s.symbol", "s.kind", "s.origin", F.lit(0.8).alias("confidence"))
    return head.unionByName(rest).groupBy("symbol", F.col("id").alias("section"), "kind", "origin").agg(F.max("confidence").alias("confidence"))


def mentions(sections: DataFrame) -> DataFrame:
    """(source, doc_id, edge_type, label, key): checkpoint and section marks, links,
    dependencies, and type names, which are edges only if another section owns them."""
    explode = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all("source_text", F.lit("(?U)" + pattern), F.lit(0))))
    base = sections.select(F.col("id").alias("source"), "doc_id", "heading", "source_text")
    upper = lambda rows, kind: rows.withColumn("edge_type", F.lit(kind))
    cp = upper(base.select("source", "doc_id", "heading", explode(P.SYMBOLS["checkpoint"]).alias("label")), "REFERENCES").withColumn("key", F.concat(F.lit("cp:"), F.upper("label"))).where(~F.contains(F.upper("heading"), F.upper("label")))
    mark = upper(base.select("source", "doc_id", "heading", explode(P.SECTION_MARK).alias("label")), "REFERENCES").withColumn("key", F.concat(F.lit("mark:"), F.lower(F.regexp_replace("label", r"\s", "")))).where(~F.contains(F.lower("heading"), F.lower("label")))
    dest, anchor = (F.regexp_extract_all("source_text", F.lit(P.LINK), F.lit(g)) for g in (1, 2))
    links = upper(base.select("source", "doc_id", "heading", F.explode(F.arrays_zip(dest.alias("d"), anchor.alias("a"))).alias("x")), "RELATED_SECTION")
    links = links.select("source", "doc_id", "heading", F.concat("x.d", F.lit("#"), "x.a").alias("label"), "edge_type", F.when(F.col("x.d") == "", F.concat(F.lit("slug:"), canonical_heading(F.col("x.a")))).otherwise(F.lit("none:")).alias("key"))
    named = base.select("source", "doc_id", "heading", F.explode(dependencies_of("heading", "source_text")).alias("label"))
    marked = F.concat(F.lit("mark:"), F.lower(F.regexp_replace("label", r"\s", "")))
    key = F.when(F.col("label").rlike(r"(?i)^CP-\d+$"), F.concat(F.lit("cp:"), F.upper("label"))).when(F.col("label").rlike("^" + P.SECTION_MARK + "$"), marked)
    depends = upper(named, "DEPENDS_ON").withColumn("key", key.otherwise(F.concat(F.lit("sym:"), F.lower("label"))))
    types = "^(?:" + "|".join(f"(?:{P.SYMBOLS[n]})" for n in ("camel", "error", "dotted")) + ")$"
    used = base.select("source", "doc_id", "heading", F.explode(F.array_distinct(F.transform(symbols_of("source_text"), lambda s: s["symbol"]))).alias("label"))
    uses = upper(used.where(F.col("label").rlike(types)), "USES_TYPE").withColumn("key", F.concat(F.lit("sym:"), F.lower("label")))
    columns = ["source", "doc_id", "edge_type", "label", "key"]
    every = cp.unionByName(mark)
    for rows in (links, depends, uses):
        every = every.unionByName(rows.select(cp.columns))
    return every.select(columns).distinct()


def declarations(sections: DataFrame) -> DataFrame:
    """(key, target, doc_id, authority, priority, ordinal) of headings."""
    keep = [F.col("id").alias("target"), "doc_id", "authority", "priority", "ordinal"]
    h = sections.where("level > 0")
    cp = h.where(F.col("heading").rlike(r"(?i)^\s*CP-\d+")).select(F.concat(F.lit("cp:"), F.upper(F.regexp_extract("heading", r"(?i)CP-\d+", 0))).alias("key"), *keep)
    mark = h.select(F.explode(F.regexp_extract_all("heading", F.lit(P.SECTION_MARK), F.lit(0))).alias("m"), *keep).select(F.concat(F.lit("mark:"), F.lower(F.regexp_replace("m", r"\s", ""))).alias("key"), "target", "doc_id", "authority", "priority", "ordinal")
    slug = h.select(F.concat(F.lit("slug:"), canonical_heading(F.col("heading"))).alias("key"), *keep)
    return cp.unionByName(mark).unionByName(slug).unionByName(owners(sections))


def owners(sections: DataFrame) -> DataFrame:
    """(key, target, ...) of symbols: a section owns those of its heading and those it declares by a keyword."""
    keep = [F.col("id").alias("target"), "doc_id", "authority", "priority", "ordinal"]
    found = F.array_distinct(F.transform(symbols_of("source_text"), lambda s: s["symbol"]))
    declared = F.transform(F.regexp_extract_all("source_text", F.lit(P.DECLARATION), F.lit(1)), F.lower)
    rows = sections.select(*keep, "heading", declared.alias("declared"), F.explode(found).alias("symbol"))
    own = rows.where(F.contains("heading", "symbol") | F.array_contains("declared", F.lower("symbol")))
    return own.select(F.concat(F.lit("sym:"), F.lower("symbol")).alias("key"), "target", "doc_id", "authority", "priority", "ordinal").distinct()


def resolve(mentioned: DataFrame, declared: DataFrame) -> DataFrame:
    """Every mention with its status and targets.

    Itself aside, the same document is preferred, then authority, then priority;
    one left is RESOLVED, more AMBIGUOUS, none UNRESOLVED.
    """
    d = declared.select("key", "target", F.col("doc_id").alias("_doc"), "authority", "priority", "ordinal")
    pool = mentioned.join(d, "key").where(F.col("target") != F.col("source"))
    best = Window.partitionBy("source", "edge_type", "label").orderBy((F.col("_doc") == F.col("doc_id")).desc(), F.col("authority").desc(), F.col("priority").desc())
    first = pool.withColumn("place", F.rank().over(best)).where("place = 1")
    targets = F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "target"))), lambda x: x["target"])
    found = first.groupBy("source", "edge_type", "label").agg(targets.alias("targets"))
    joined = mentioned.select("source", "edge_type", "label").distinct().join(found, ["source", "edge_type", "label"], "left")
    n = F.coalesce(F.size("targets"), F.lit(0))
    joined = joined.where((F.col("edge_type") != "USES_TYPE") | (n > 0))
    return joined.select("source", "edge_type", "label", F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("status"), F.array_join(F.coalesce("targets", F.array().cast("array<string>")), ",").alias("targets"))
