"""Deterministic views of the parquet tables, and the same views in DuckDB SQL.

The tables hold no Markdown; these views give them paths, authorities, lines,
windows, tokens and one Markdown document per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_CHARS = 1200
WINDOW_STRIDE = 1020
#: Fixed value: what the index calls a token.
TOKEN = r"[\p{L}\p{N}_.@:-]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, authority (0-4), priority (-100..100), sha256, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        (F.col("doc_id") % 5).alias("authority"),
        (F.col("doc_id") % 201 - 100).alias("priority"),
        F.sha2("text", 256).alias("sha256"),
        "text",
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown document per conversation: conv_id, path, text."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    return grouped.select(
        "conv_id",
        F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), body).alias("text"),
    )


def windows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Overlapping fixed windows of rows(text, ...): keep..., ordinal, start_offset, chunk."""
    n = F.length("text")
    count = F.greatest(F.lit(1), F.ceil((n - (WINDOW_CHARS - WINDOW_STRIDE)) / WINDOW_STRIDE)).cast("int")
    cut = rows.select(*keep, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal"))
    start = F.col("ordinal") * WINDOW_STRIDE
    return cut.select(*keep, F.col("ordinal").cast("long").alias("ordinal"), start.cast("long").alias("start_offset"), F.substring(F.col("text"), start + 1, F.lit(WINDOW_CHARS)).alias("chunk"))


def tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def queries(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """query_id, terms: the first five distinct tokens of each benchmark text, or all of them."""
    b = table(spark, sf_dir, "benchmark")
    terms = F.array_distinct(tokens(F.col("text")))
    return b.select(F.col("item_id").alias("query_id"), (terms if whole else F.slice(terms, 1, 5)).alias("terms"))


#: The same views as DuckDB common table expressions.
SQL = {
    "v_docs": "SELECT doc_id, 'docs/' || source || '/' || doc_id || '.md' AS path, doc_id % 5 AS authority, doc_id % 201 - 100 AS priority, sha256(text) AS sha256, text FROM documents",
    "v_md": """SELECT conv_id, 'conversations/' || conv_id || '.md' AS path,
        '# Conversation ' || conv_id || chr(10) || string_agg('## Turn ' || turn || ' ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "v_windows": f"""SELECT doc_id, path, authority, priority, CAST(i AS BIGINT) AS ordinal, CAST(i * {WINDOW_STRIDE} AS BIGINT) AS start_offset,
        substring(text, CAST(i * {WINDOW_STRIDE} + 1 AS BIGINT), {WINDOW_CHARS}) AS chunk
        FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - {WINDOW_CHARS - WINDOW_STRIDE}) / {WINDOW_STRIDE}.0) AS BIGINT)))) AS i FROM v_docs)""",
    "v_terms": rf"SELECT doc_id, ordinal, unnest(regexp_extract_all(lower(chunk), '{TOKEN}')) AS term FROM v_windows",
    "v_query_terms": rf"""SELECT query_id, term FROM (
        SELECT item_id AS query_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS k FROM (
          SELECT item_id, ts[i] AS term, i AS pos FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS i
            FROM (SELECT item_id, regexp_extract_all(lower(text), '{TOKEN}') AS ts FROM benchmark)))
        GROUP BY item_id, term) WHERE k <= 5""",
    "v_lines": """SELECT conv_id, path, i - 1 AS line, ls[i] AS content FROM (SELECT conv_id, path, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT conv_id, path, string_split(text, chr(10)) AS ls FROM v_md))""",
    "v_headings": r"""SELECT conv_id, path, line, length(regexp_extract(content, '^(#+) ', 1)) AS level, trim(regexp_replace(content, '^#+ ', '')) AS heading
        FROM v_lines WHERE regexp_matches(content, '^#{1,6} ')""",
    "v_sections": """SELECT s.conv_id, s.path, s.ordinal, s.level, s.heading, s.line AS start_line, s.end_line
        FROM (SELECT conv_id, path, row_number() OVER w - 1 AS ordinal, level, heading, line,
              coalesce(lead(line) OVER w, (SELECT count(*) FROM v_lines l WHERE l.conv_id = h.conv_id)) AS end_line
              FROM v_headings h WINDOW w AS (PARTITION BY conv_id ORDER BY line)) s""",
}

def sql(body: str, *names: str) -> str:
    """body behind the named views, in order."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
