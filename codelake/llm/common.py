"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.batches import rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(column: str | Column = "language") -> Column:
    """Normalised language: blanks and dots cut off, lower case; an empty name is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"^[\s.]+|[\s.]+$", ""))), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) may that be unset: then a
    folder below the temporary space is set. On a cluster it is an error, since
    executors could not read each other's folders.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


__all__ = ["checkpointed", "language", "rows", "table"]
