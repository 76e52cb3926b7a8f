"""Problem 1: splitting oversized blocks at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import language, rows

WINDOW = 32  # characters under the rolling hash
_RNG = np.random.default_rng(20240501)
_GEAR = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_LINE = re.compile(r"\n")
_BLANK = re.compile(r"\n[ \t\r]*\n")
_STEP = re.compile(r"(?<=[;,{}.)\]>])[ \t]+|[ \t]+")


def landmarks(text: str, every: int) -> np.ndarray:
    """Offsets after which the rolling hash of the last ``WINDOW`` characters hits its target.

    The hash depends on those characters alone, so an edit moves no landmark
    that is further away than the window; one comes every ``every`` characters
    on average.
    """
    n = len(text)
    if n <= WINDOW:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gear = _GEAR[codes & 255] ^ (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):  # the hash of each window: its codes rotated by their place
        r = np.uint64(k + 1)
        part = gear[k : n - WINDOW + 1 + k]
        h ^= (part << r) | (part >> (np.uint64(64) - r))
    h ^= h >> np.uint64(31)
    return np.flatnonzero(h % np.uint64(max(2, every)) == 0) + WINDOW


def _boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Offsets of natural boundaries: after blank lines, line starts, after blanks within a line."""
    blank = [m.end() for m in _BLANK.finditer(text)]
    line = [m.end() for m in _LINE.finditer(text)]
    return blank, line, [m.end() for m in _STEP.finditer(text)]


def _nearest(points: list[int], at: int, low: int, high: int) -> int | None:
    """The point nearest to ``at`` within [low, high], the smaller one of two."""
    i, j = bisect_left(points, low), bisect_right(points, high)
    if i >= j:
        return None
    k = bisect_left(points, at, i, j)
    near = [points[x] for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda p: (abs(p - at), p))


def pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each at most ``max_chars`` long and together the whole text.

    A cut lies at the first landmark after a third of the size limit, moved to
    the nearest natural boundary between that and the limit: a blank line, else
    a line start, else a blank, else the landmark itself; without a landmark
    the last boundary before the limit counts. Consecutive pieces share about
    ``overlap`` characters, from the line start nearest to that. A text within
    the limit is one piece; an empty text is one empty piece.
    """
    n = len(text)
    if n <= max_chars or max_chars < 2:
        return [(0, n)]
    overlap = max(0, min(overlap, max_chars // 3))
    slack = overlap // 2
    core = max(1, max_chars - overlap - slack)
    least = max(1, core // 3)
    blank, line, step = _boundaries(text)
    marks = landmarks(text, max(2, core // 2)).tolist()
    cuts, pos = [], 0
    first = True
    while True:
        limit = pos + (max_chars if first else core)
        if n <= limit:
            break
        low = pos + least
        i = bisect_left(marks, low)
        mark = marks[i] if i < len(marks) and marks[i] <= limit else None
        at = limit if mark is None else mark
        cut = None
        for points in (blank, line, step):
            cut = _nearest(points, at, low, limit)
            if cut is not None:
                break
        if cut is None:
            cut = at
            if text[cut - 1 : cut + 1] == "\r\n" and cut - 1 > pos:
                cut -= 1
        cuts.append(cut)
        pos, first = cut, False
    out, start = [], 0
    for cut in [*cuts, n]:
        out.append((start, cut))
        back = cut - overlap
        near = _nearest(line, back, back - slack, min(cut - 1, back + slack)) if overlap else cut
        start = max(0, back if near is None else near)
        if cut - start > overlap + slack:
            start = back
    return out


def split_blocks(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every block longer than max_chars of its normalised language.

    ``limits``: language, max_chars, overlap_chars; ``*`` stands for all
    languages not listed, null ones included; without it such blocks are never
    cut. Lengths are code points. Result: ordinal, position (from 0), start,
    piece. Null and short texts give nothing; repeated rows of one ordinal
    count once; further columns of the input are ignored. The table of limits
    has a row for each language (of several the smallest limit counts) and is
    read once by each task.
    """
    lim = limits.select(F.coalesce(language(), F.lit("*")).alias("of"), "max_chars", "overlap_chars").groupBy("of").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("least")).select("of", "least.*")
    named, other = lim.filter("of <> '*'"), lim.filter("of = '*'").select(F.col("max_chars").alias("any_max"), F.col("overlap_chars").alias("any_overlap"))
    long = (
        blocks.select("ordinal", language().alias("of"), "source_code").filter("source_code is not null")
        .join(F.broadcast(named), "of", "left").join(F.broadcast(other.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"), "left")
        .select("ordinal", "source_code", F.coalesce("max_chars", "any_max").alias("max_chars"), F.coalesce("overlap_chars", "any_overlap", F.lit(0)).alias("overlap"))
        .filter(F.col("max_chars").isNotNull() & (F.length("source_code") > F.col("max_chars")))
    )

    def cut(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("ordinal", "position", "start", "piece")}
        for o, t, m, v in zip(b["ordinal"], b["source_code"], b["max_chars"], b["overlap"], strict=True):
            for k, (a, z) in enumerate(pieces(t, m, v)):
                out["ordinal"].append(o)
                out["position"].append(k)
                out["start"].append(a)
                out["piece"].append(t[a:z])
        return out

    return rows(long, cut, "ordinal long, position int, start int, piece string").dropDuplicates(["ordinal", "position"])
