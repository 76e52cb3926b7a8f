"""Token estimates and windows over ordered messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelake.functions.text import est_tokens


def messages_of(documents: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) of chat documents: one message for each line with text; a line without a role has none."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x != "")
    m = documents.filter("doc_kind = 'chat' and text is not null").select(F.col("doc_id").alias("conv_id"), F.posexplode(lines).alias("pos", "line"))
    role = F.nullif(F.regexp_extract("line", r"^(user|assistant|system): ", 1), F.lit(""))
    return m.select("conv_id", (F.col("pos") + 1).alias("turn"), role.alias("role"), F.when(role.isNotNull(), F.regexp_replace("line", r"^(?:user|assistant|system): ", "")).otherwise(F.col("line")).alias("content"))


def truncated(text: Column, tokens: int) -> Column:
    """The part of a text that an estimate of ``tokens`` allows."""
    return F.left(text, F.lit(int(max(tokens, 0) * 3.5)))


def conversation_tokens(messages: DataFrame) -> DataFrame:
    """Four tokens for each message and its content."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(4 + est_tokens("content")).alias("tokens"))


def tail(messages: DataFrame, keep: int = 12) -> DataFrame:
    """The last ``keep`` messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).drop("r")


def summarised(messages: DataFrame, keep: int = 12, chars: int = 80) -> DataFrame:
    """For conversations longer than ``keep``: the older user messages as a list of their first characters."""
    w = Window.partitionBy("conv_id")
    old = messages.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("turn")))).filter((F.col("n") > keep) & (F.col("r") > keep) & (F.col("role") == "user"))
    bullets = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.left("content", F.lit(chars)).alias("c")))), lambda x: F.concat(F.lit("- "), x["c"]))
    return old.groupBy("conv_id").agg(F.array_join(bullets, "\n").alias("summary"))


def within_budget(messages: DataFrame, limit: int, share: float = 0.8) -> DataFrame:
    """Messages up to the point where the running total passes a share of the limit."""
    run = F.sum(4 + est_tokens("content")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("running", run).filter(F.col("running") <= share * limit)
