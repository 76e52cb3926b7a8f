"""Typed views of the stored tables: late and repeated rows settled, languages normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.functions.text import language

ITEM = T.StructType([T.StructField(n, t) for n, t in (
    ("scan_id", T.StringType()), ("item_id", T.StringType()), ("name", T.StringType()), ("qualified_name", T.StringType()), ("block_type", T.StringType()), ("language", T.StringType()),
    ("file_path", T.StringType()), ("line_number", T.IntegerType()), ("end_line", T.IntegerType()), ("parent", T.StringType()), ("ordinal", T.LongType()))])
BLOCK = T.StructType([*ITEM.fields, T.StructField("source_code", T.StringType()), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("imports", "decorators", "type_references"))])
EDGE = "src string, dst string, edge_type string, reference_name string"
EVENT = "seq long, tool_name string, user_id string, context string, parameters string, result string, execution_time double, success boolean, ts timestamp"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_each(df: DataFrame) -> DataFrame:
    """One row for each ordinal; repeated rows differ in the time of loading alone, which is left out."""
    return df.drop("loaded_at").dropDuplicates(["ordinal"])


def _settled(df: DataFrame, where: str | Column | None) -> DataFrame:
    """Normalised languages and one row for each ordinal; a condition is met before, as repeated rows agree, and so reaches the scan."""
    df = df.withColumn("language", language())
    return one_each(df if where is None else df.filter(where))


def blocks(spark: SparkSession, folder: str, where: str | Column | None = None) -> DataFrame:
    return _settled(read(spark, folder, "blocks"), where)


def items(spark: SparkSession, folder: str, where: str | Column | None = None) -> DataFrame:
    return _settled(read(spark, folder, "items"), where)


def files(spark: SparkSession, folder: str, where: str | Column | None = None) -> DataFrame:
    return _settled(read(spark, folder, "source_files"), where)


def last_by_item(df: DataFrame) -> DataFrame:
    """One row for each item_id: that of the greatest ordinal, as a later write wins."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("item_id").orderBy(F.desc("ordinal"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the dependency graph: blocks by item_id."""
    return last_by_item(blocks(spark, folder))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Stored edges without repetition: one for each ordered pair, type references before imports before parents; no loops."""
    from codelake.operators.graph import first_edge

    return first_edge(read(spark, folder, "edges").withColumn("pos", F.lit(0)))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Tool-usage events from the stored event log: seq in the order of time, the event type as tool."""
    from codelake.operators.usage import sequenced

    e = read(spark, folder, "events")
    return sequenced(e.select(
        F.col("event_id"), F.col("event_type").alias("tool_name"), F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("context"), F.col("props").alias("parameters"),
        F.lit(None).cast("string").alias("result"), (F.col("value") / 10).alias("execution_time"), (F.col("event_type") != "error").alias("success"), "ts"))
