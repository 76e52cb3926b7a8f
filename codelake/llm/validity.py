"""Problem 2: source files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import language, rows
from codelake.llm.grammar import verdict


def parse_flags(files: DataFrame) -> DataFrame:
    """One row for each ordinal: language, valid, parses_as, reason.

    Every text is parsed with the grammar of its normalised language; if that
    fails, with all other grammars in the order of a token-based ranking. A
    foreign parse gives reason ``wrong_extension`` and the language in
    ``parses_as``; if no grammar accepts the text the reason is ``corrupt``.
    Null or blank texts, HTML, unknown and null languages are valid and have no
    reason. Repeated rows of one ordinal are one row; further columns of the
    input are ignored. An empty table gives an empty table.
    """
    def check(b: dict[str, list]) -> dict[str, list]:
        got = [verdict(x, t) for x, t in zip(b["language"], b["source_code"], strict=True)]
        return {
            "ordinal": b["ordinal"], "scan_id": b["scan_id"], "language": b["language"], "valid": [v for v, _ in got],
            "parses_as": [p if not v else None for v, p in got], "reason": [None if v else "wrong_extension" if p else "corrupt" for v, p in got],
        }

    picked = files.select("ordinal", "scan_id", language().alias("language"), "source_code")
    return rows(picked, check, "ordinal long, scan_id string, language string, valid boolean, parses_as string, reason string").dropDuplicates(["ordinal"])


def invalid_rates(flags: DataFrame, scans: DataFrame) -> DataFrame:
    """Files, invalid files and rate for each repository (project_name) and language.

    A file whose scan is unknown counts under a null project; null languages
    form a group of their own. Repositories of one name are one group.
    """
    names = scans.select("scan_id", "project_name").dropDuplicates(["scan_id"])
    return (
        flags.groupBy("scan_id", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
        .join(names, "scan_id", "left").groupBy("project_name", "language")
        .agg(F.sum("files").alias("files"), F.sum("invalid").alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
