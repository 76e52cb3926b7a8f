"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import abuse, functions_docs, leakage, mixing, neardup, origin, secrets, split, validity
from codelake.llm.common import checkpointed, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_blocks(table(spark, d, "blocks"), table(spark, d, "split_limits")).select("ordinal").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_blocks(table(spark, d, "blocks"), table(spark, d, "split_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.parse_flags(table(spark, d, "source_files")).filter("language is not null and not valid").select("ordinal")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return validity.parse_flags(table(spark, d, "source_files"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.invalid_rates(p2_flags(spark, d), table(spark, d, "scans"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*neardup.similar_pairs(table(spark, d, "blocks")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = neardup.similar_pairs(table(spark, d, "blocks"))
    return neardup.groups(members, checkpointed(pairs))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return functions_docs.documented_functions(table(spark, d, "source_files"), with_text=False).filter("not is_inherited").select("ordinal", "line_number").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return functions_docs.documented_functions(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.origin_flags(table(spark, d, "source_files"), table(spark, d, "scans")).filter("language is not null and not hand_written").select("ordinal")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return origin.origin_flags(table(spark, d, "source_files"), table(spark, d, "scans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(table(spark, d, "source_files")).select("ordinal", "line_number").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(table(spark, d, "source_files"), with_text=True)


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return secrets.credential_rates(secrets.credentials(files), files)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("longest_run >= 15").select("doc_id", "eval_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_suites(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_rates(p7_report(spark, d), table(spark, d, "eval_items"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(checkpointed(mixing.token_counts(table(spark, d, "documents"))), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "documents")).filter("flagged").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(p9_scores(spark, d))


def p9_against_labels(spark: SparkSession, d: str) -> DataFrame:
    """How the flags agree with the reviewers' verdicts; ``unsure`` and null verdicts don't vote, ties count as abusive."""
    votes = (
        table(spark, d, "review_labels").filter("verdict in ('abuse', 'hate', 'sexual', 'clean')").groupBy("doc_id")
        .agg(F.avg((F.col("verdict") != "clean").cast("double")).alias("bad")).select("doc_id", (F.col("bad") >= 0.5).alias("labelled"))
    )
    return p9_scores(spark, d).join(votes, "doc_id").groupBy("labelled", "flagged").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_pieces, p2_found, p2_flags, p2_rates, p3_found, p3_groups, p4_found, p4_pairs, p5_found, p5_flags, p6_found, p6_redacted, p6_rates,
        p7_found, p7_report, p7_suites, p8_mixture, p8_shares, p9_found, p9_scores, p9_rates, p9_against_labels)
}

ORACLE: dict[str, str] = {
    "p1_found": """
        WITH lim AS (SELECT DISTINCT lower(trim(language, ' .')) AS lang, max_chars FROM split_limits),
        b AS (SELECT DISTINCT ordinal, lower(trim(language, ' .')) AS lang, length(source_code) AS n FROM blocks WHERE source_code IS NOT NULL)
        SELECT DISTINCT b.ordinal FROM b LEFT JOIN lim ON lim.lang = b.lang AND lim.lang <> '*'
        WHERE b.n > coalesce(lim.max_chars, (SELECT max_chars FROM lim WHERE lang = '*'))""",
    "p3_found": r"""
        WITH t AS (SELECT DISTINCT ordinal, source_code FROM blocks WHERE source_code IS NOT NULL),
        w AS (SELECT ordinal, unnest(regexp_extract_all(source_code, '[a-zA-Z_][\p{L}\p{N}_]+')) AS w0 FROM t),
        c AS (SELECT ordinal, lower(w0) AS word, count(*) AS n FROM w GROUP BY 1, 2),
        s AS (SELECT ordinal, sum(n)::BIGINT AS total FROM c GROUP BY 1 HAVING sum(n) >= 25),
        e AS (SELECT c.*, s.total FROM c JOIN s USING (ordinal)),
        i AS (SELECT a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, a.total AS ta, b.total AS tb, sum(least(a.n, b.n))::BIGINT AS inner_n
              FROM e a JOIN e b ON a.word = b.word AND a.ordinal < b.ordinal AND least(a.total, b.total) >= 0.75 * greatest(a.total, b.total) GROUP BY 1, 2, 3, 4)
        SELECT ordinal_a, ordinal_b FROM i WHERE inner_n::DOUBLE / (ta + tb - inner_n) >= 0.75""",
}
