"""Lookup, search and ranking over items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelake.functions.text import glob_to_regex

_CREATE = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+|UNIQUE\s+)?"
_KIND = r"(TABLE|VIEW|FUNCTION|TRIGGER|INDEX|POLICY)\b"


def glob(items: DataFrame, pattern: str) -> DataFrame:
    """Items whose name, qualified name or kind meets a shell glob; null names meet none."""
    p = glob_to_regex(pattern)
    return items.filter(F.col("name").rlike(p) | F.col("qualified_name").rlike(p) | F.col("block_type").rlike(p))


def best_tier(rows: DataFrame) -> DataFrame:
    """Rows of the least tier that occurs; rows without a tier never count."""
    least = F.broadcast(rows.agg(F.min("tier").alias("least")))  # one row
    return rows.crossJoin(least).filter("tier = least").drop("least")


def search(items: DataFrame, query: str, block_type: str | None = None, language: str | None = None, top: int = 20) -> DataFrame:
    """The first items, by ordinal, that hold the query in a name, of a kind and language if given."""
    q = query.lower()
    out = items.filter(F.lower("qualified_name").contains(q) | F.lower("name").contains(q))
    if block_type:
        out = out.filter(F.col("block_type") == block_type)
    if language:
        out = out.filter(F.col("language") == language.lower())
    return out.orderBy("ordinal").limit(top)


def resolve(items: DataFrame, queries: DataFrame, substring: bool = False) -> DataFrame:
    """The best item for each query: exact (1), case-blind (2), and with ``substring`` part of a name (3); the first of several.

    The first two tiers are an equi-join on the lower-case name. The third one
    runs only for queries that these leave open, against each item's name, and
    expects a short list of queries.
    """
    key = items.select("item_id", "ordinal", "name", "qualified_name", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("k"))
    hit = queries.withColumn("k", F.lower("query")).join(key, "k").withColumn("tier", F.when((F.col("name") == F.col("query")) | (F.col("qualified_name") == F.col("query")), 1).otherwise(2))
    w = Window.partitionBy("query").orderBy("tier", "ordinal")
    out = hit.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query", "item_id", "tier")
    if not substring:
        return out
    left = F.broadcast(queries.join(out, "query", "left_anti"))
    part = items.join(left, F.lower("qualified_name").contains(F.lower("query"))).groupBy("query").agg(F.min_by("item_id", "ordinal").alias("item_id")).withColumn("tier", F.lit(3))
    return out.unionByName(part)


def relevance(items: DataFrame, query: str, problematic: DataFrame | None = None, top: int = 20) -> DataFrame:
    """Items by how well they fit the words of a query; ``problematic`` (item_id) adds three points; an empty query gives the first ones."""
    words = query.lower().split()
    score = F.lit(0.1)
    last = F.lower(F.element_at(F.split("qualified_name", r"\."), -1))
    for w in words:
        score = score + F.when((F.lower("name") == w) | (last == w), 10.0).when(F.lower("qualified_name").contains(w), 5.0).otherwise(0.0)
        score = score + F.when(F.lower("block_type").contains(w), 2.0).otherwise(0.0) + F.when(F.lower(F.coalesce("language", F.lit(""))).contains(w), 1.0).otherwise(0.0) + F.when(F.lower("file_path").contains(w), 3.0).otherwise(0.0)
    out = items
    if problematic is not None:
        out = out.join(problematic.select("item_id").distinct().withColumn("_p", F.lit(3.0)), "item_id", "left")
        score = score + F.coalesce("_p", F.lit(0.0))
    return out.withColumn("score", F.round(score, 1)).orderBy(F.desc("score"), "ordinal").limit(top)


def neighbours(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Names that each item depends on, the first ``top`` by ordinal."""
    n = nodes.select(F.col("item_id").alias("dst"), F.col("qualified_name").alias("name"), "ordinal")
    w = Window.partitionBy("src").orderBy("ordinal")
    return edges.select("src", "dst").join(n, "dst").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select(F.col("src").alias("item_id"), "name")


def preview(items: DataFrame, files: DataFrame, more: int = 100) -> DataFrame:
    """Lines of each item cut from its file; an open end takes ``more`` lines; files without text give nothing."""
    f = files.filter("source_code is not null").select("scan_id", "file_path", F.split("source_code", "\n").alias("l"))
    n = F.coalesce("end_line", F.col("line_number") + more) - F.col("line_number") + 1
    return items.join(f, ["scan_id", "file_path"]).select("ordinal", F.array_join(F.slice("l", F.col("line_number"), F.greatest(n, F.lit(0))), "\n").alias("preview"))


def ddl(files: DataFrame) -> DataFrame:
    """Data definitions by line: ordinal, line, kind, name."""
    line = files.filter("source_code is not null").select("ordinal", F.posexplode(F.split("source_code", "\n")).alias("pos", "s")).filter(F.col("s").rlike(_CREATE + _KIND))
    name = _CREATE + r'(?:TABLE|VIEW|FUNCTION|TRIGGER|INDEX|POLICY)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:"?\w+"?\.)?"?(\w+)"?'
    return line.select("ordinal", (F.col("pos") + 1).alias("line"), F.lower(F.regexp_extract("s", _CREATE + _KIND, 1)).alias("kind"), F.regexp_extract("s", name, 1).alias("name"))
