"""Column expressions with Python's text semantics: strip, splitlines, word patterns, case variants, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?U)[a-zA-Z_]\w+"
_SPACE = r"(?U)[\s\x1c-\x1f]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language(x: str | Column = "language") -> Column:
    """Normalised language: blanks and dots cut off, lower case; empty is null."""
    return F.nullif(F.lower(F.regexp_replace(_c(x), r"^[\s.]+|[\s.]+$", "")), F.lit(""))


def strip(x: str | Column) -> Column:
    """Leading and trailing Unicode white space cut off."""
    return F.regexp_replace(F.regexp_replace(_c(x), rf"^{_SPACE}+", ""), rf"{_SPACE}+$", "")


def n_lines(x: str | Column) -> Column:
    """Lines as splitlines counts them: any line separator, no line after a last one; null stays null."""
    c = _c(x)
    breaks = F.regexp_count(c, F.lit(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"))
    return F.when(c == "", 0).otherwise(breaks + F.when(c.rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]\z"), 0).otherwise(1)).cast("int")


def tokens(x: str | Column) -> Column:
    """Lower-cased words of at least two characters that start with a letter or an underscore."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(TOKEN), F.lit(0)), F.lower)


def glob_to_regex(pattern: str) -> str:
    """Anchored Java pattern for a shell glob with ``* ? [seq] [!seq]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")) + "]"
            i = j
        else:
            out += re.sub(r"([^A-Za-z0-9_])", r"\\\1", c)
        i += 1
    return f"(?s)^{out}$"


def est_tokens(x: str | Column) -> Column:
    """Estimated model tokens: 3.5 characters each, at least one; nothing for null and empty texts."""
    n = F.length(_c(x))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(3.5)).cast("int")))


def path_parts(x: str | Column) -> Column:
    """Components of a path without empty ones and single dots; either slash."""
    return F.filter(F.split(F.regexp_replace(_c(x), r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def words_of_name(x: str | Column) -> Column:
    """Words of a snake, kebab, Pascal or camel case name."""
    c = _c(x)
    camel = F.split(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1\u0001$2"), r"([A-Z])([A-Z][a-z])", "$1\u0001$2"), "\u0001")
    parts = F.when(c.contains("_"), F.split(c, "_")).when(c.contains("-"), F.split(c, "-")).otherwise(camel)
    return F.filter(parts, lambda w: w != "")


def _cap(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))


def case_variants(x: str | Column) -> Column:
    """Struct of the pascal, camel, snake, upper and kebab spelling of a name."""
    w = words_of_name(x)
    rest = F.transform(F.slice(w, 2, 1 << 20), _cap)
    return F.struct(
        F.array_join(F.transform(w, _cap), "").alias("pascal"), F.concat(F.lower(F.get(w, F.lit(0))), F.array_join(rest, "")).alias("camel"),
        F.array_join(F.transform(w, F.lower), "_").alias("snake"), F.array_join(F.transform(w, F.upper), "_").alias("upper"), F.array_join(F.transform(w, F.lower), "-").alias("kebab"))


def safe_filename(x: str | Column) -> Column:
    """Snake case of a name with everything but letters, figures and underscores replaced."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(x), r"(?U)(\p{Lower})(\p{Upper})", "$1_$2")), r"[^\p{L}\p{N}_]", "_")


def occurrences(x: str | Column, what: str | Column) -> Column:
    """How often a text holds another, without overlap; none for an empty one."""
    c, w = _c(x), what if isinstance(what, Column) else F.lit(what)
    return F.when(F.length(w) > 0, ((F.length(c) - F.length(F.replace(c, w, F.lit("")))) / F.length(w)).cast("int")).otherwise(0)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; null where one of them is zero."""
    x, y = _c(a), _c(b)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))
