"""Queries over scanning, extraction, cleaning, formatting, export and streaming."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import tables as T
from codelake.operators import analysis as A
from codelake.operators import ingest as I
from codelake.plans.sql import EVENTS, w
from codelake.registry import op
from codelake.sinks import export as X

AS_OF = "2026-01-01"


@op("scan_items", "scan")
def scan_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that the parsers find in all stored files."""
    return I.scan(T.files(spark, d)).drop("scanner", "place")


@op("scan_agreement", "scan")
def scan_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Items found by the scanners against the stored ones: by language and kind, how many are in both, and in one alone."""
    key = ["item_id", "name", "block_type", "language"]
    found = I.scan(T.files(spark, d)).select(*key).distinct().withColumn("f", F.lit(1))
    held = T.items(spark, d).select(*key).distinct().withColumn("h", F.lit(1))
    where = F.when(F.col("h").isNull(), "parser").when(F.col("f").isNull(), "stored").otherwise("both")
    return found.join(held, key, "full").groupBy("language", "block_type", where.alias("found_in")).agg(F.count("*").alias("items"))


@op("scan_numbered", "scan")
def scan_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Items with their place in the order of their scan."""
    return I.numbered(I.scan(T.files(spark, d)))


@op("extract_blocks", "extract")
def extract_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks cut from all stored files."""
    return I.scan(T.files(spark, d), with_code=True).drop("scanner", "place")


@op("clean_blocks", "clean")
def clean_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks without metadata and unused imports, relative imports noted."""
    return I.cleaned(T.blocks(spark, d))


@op("format_blocks", "format")
def format_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks formatted and validated."""
    return I.formatted(T.blocks(spark, d), AS_OF)


@op("validation_rates", "format")
def validation_rates(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed blocks by language."""
    return I.formatted(T.blocks(spark, d), AS_OF).groupBy("language").agg(F.count("*").alias("blocks"), F.count_if("is_valid").alias("valid"))


@op("export_files", "export")
def export_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder export with path and content."""
    return X.exported_files(I.formatted(T.blocks(spark, d), AS_OF))


@op("export_index", "export")
def export_index(spark: SparkSession, d: str) -> DataFrame:
    """Index text of each language."""
    return X.index_lines(T.blocks(spark, d))


@op("export_manifest", "export")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest of an export as JSON."""
    return X.manifest(I.formatted(T.blocks(spark, d), AS_OF), "/srv/scan", AS_OF)


@op("export_readme", "export")
def export_readme(spark: SparkSession, d: str) -> DataFrame:
    """Summary of an export as Markdown."""
    return X.readme(I.formatted(T.blocks(spark, d), AS_OF))


@op("primary_language", "export", "WITH b AS (SELECT DISTINCT ON (ordinal) ordinal, nullif(lower(regexp_replace(language, '^[\\s.]+|[\\s.]+$', '', 'g')), '') AS language FROM blocks ORDER BY ordinal) SELECT language FROM b GROUP BY 1 ORDER BY count(*) DESC, min(ordinal) LIMIT 1")
def primary_language(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent language."""
    return X.primary_language(T.blocks(spark, d))


@op("docs_markdown", "docs")
def docs_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documentation as Markdown by kind."""
    return X.docs_markdown(A.docs_sections(T.blocks(spark, d)))


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream over all that is available gives.

    Appended rows go to files beside the checkpoints, as there may be one for
    each event; the memory sink keeps its rows in the driver and takes only
    complete results, which are small.
    """
    from codelake.operators.graph import checkpoint_folder, cut_lineage

    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        spark.sql(f"DROP VIEW IF EXISTS {name}")
        writer.format("memory").queryName(name).start().awaitTermination()
        return cut_lineage(spark.table(name))
    at = f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"
    try:
        writer.format("parquet").option("checkpointLocation", f"{at}/state").start(f"{at}/rows").awaitTermination()
        return cut_lineage(spark.read.schema(stream.schema).parquet(f"{at}/rows"))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    e = spark.readStream.schema(T.read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("tool_name"), F.col("user_id").cast("string").alias("key"), (F.col("value") / 10).alias("execution_time"), (F.col("event_type") != "error").alias("success"), F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@op("stream_tool_stats", "stream", w(EVENTS) + "SELECT tool_name, count(*) AS uses, round(avg(success::INT::DOUBLE), 6) AS success_rate FROM ev GROUP BY 1")
def stream_tool_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each tool from the event log read as a stream."""
    from codelake.streaming.jobs import tool_stats

    return _drained(tool_stats(_stream(spark, d)), "complete", "stream_tool_stats").select("tool_name", "uses", "success_rate")


@op("stream_rate_limit", "stream")
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the limiter from the event log read as a stream."""
    from codelake.streaming.jobs import rate_limited

    return _drained(rate_limited(_stream(spark, d).select("key", "seq", "t").filter("key is not null"), 3, 86_400.0), "append", "stream_rate_limit")


@op("stream_slow_tools", "stream")
def stream_slow_tools(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on slow tools from the event log read as a stream."""
    from codelake.streaming.jobs import slow_tool_alerts

    return _drained(slow_tool_alerts(_stream(spark, d).select("tool_name", "seq", "execution_time")), "append", "stream_slow_tools")


@op("events_before", "stream", w(EVENTS) + "SELECT seq, tool_name FROM ev WHERE seq <= 1000")
def events_before(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand events by time."""
    return T.events(spark, d).filter("seq <= 1000").select("seq", "tool_name")


